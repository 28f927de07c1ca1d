"""A small gated recurrent language model in numpy: training windows and whole-document scores.

The vocabulary is cut into classes of about equal frequency, and the classes into
groups, so that a word costs about three times the cube root of the vocabulary's
size; its probability is that of its group, times that of its class within the
group, times its own within the class.  Word 0 is the end of a document, word 1
stands for all rarer words.
"""

from __future__ import annotations

import numpy as np

END, RARE = 0, 1
HIDDEN = 16
FIXED = ("cuts", "group_cuts")  # first words of the classes and first classes of the groups, which aren't trained
LEVELS = ("group", "class", "word")
LOGITS = 32_768  # logits held at a time, few enough for a core's own cache
MODERATE = 60  # greatest exponent that is safe without looking at each row


def balanced(frequency: np.ndarray) -> np.ndarray:
    """First word of each class, and the number of words: classes of about equal frequency."""
    mass = np.cumsum(frequency)
    share = (mass - frequency) / mass[-1]
    label = (share * np.ceil(len(frequency) ** (2 / 3))).astype(np.int64)
    return np.concatenate(([0], np.flatnonzero(np.diff(label)) + 1, [len(frequency)]))


def start(frequency: np.ndarray, hidden: int = HIDDEN, seed: int = 7) -> dict[str, np.ndarray]:
    """Parameters before training: output biases give the unigram model."""
    rng = np.random.default_rng(seed)
    words = len(frequency)
    grown = frequency + 1.0
    cuts = balanced(grown)
    of_class = np.add.reduceat(grown, cuts[:-1])
    group_cuts = np.unique(np.linspace(0, len(of_class), int(np.ceil(np.sqrt(len(of_class)))) + 1).round().astype(np.int64))
    made = {
        "into": rng.normal(0, 0.1, (words, 3 * hidden)),
        "back": rng.normal(0, 0.3 / np.sqrt(hidden), (hidden, 3 * hidden)),
        "bias": np.zeros(3 * hidden),
        "group_w": np.zeros((len(group_cuts) - 1, hidden)),
        "group_b": np.log(np.add.reduceat(of_class, group_cuts[:-1])),
        "class_w": np.zeros((len(of_class), hidden)),
        "class_b": np.log(of_class),
        "word_w": np.zeros((words, hidden)),
        "word_b": np.log(grown),
        "cuts": cuts,
        "group_cuts": group_cuts,
    }
    return {k: v.astype(np.int64 if k in FIXED else np.float32) for k, v in made.items()}


def step(p: dict, words: np.ndarray, h: np.ndarray) -> tuple:
    """The next state, and what its gradient needs; columns are streams, so that gates lie in a row."""
    n = len(h)
    entered = p["into"].take(words, axis=0).T
    kept = p["back"].T @ h
    kept += p["bias"][:, None]
    gates = np.add(entered[: 2 * n], kept[: 2 * n], order="C")
    np.negative(gates, out=gates)
    np.minimum(gates, 80, out=gates)  # beyond, a gate is shut to single precision
    np.exp(gates, out=gates)
    gates += 1
    np.reciprocal(gates, out=gates)
    z, r = gates[:n], gates[n:]
    new = np.multiply(r, kept[2 * n :], order="C")
    new += entered[2 * n :]
    np.tanh(new, out=new)
    after = h - new
    after *= z
    after += new
    return after, z, r, new, kept[2 * n :]


def blocks(family: np.ndarray, cuts: np.ndarray):
    """Runs of rows of one family, as first and last row and member; so many in a row as have no more than LOGITS logits."""
    heads = np.flatnonzero(np.diff(family, prepend=-1))
    own = family[heads]
    bounds = zip(heads.tolist(), [*heads[1:].tolist(), len(family)], cuts[own].tolist(), cuts[own + 1].tolist(), strict=True)
    held, logits = [], 0
    for at, end, first, last in bounds:
        size = max(1, LOGITS // (last - first))
        for begin in range(at, end, size):
            part = begin, min(begin + size, end), first, last
            more = (part[1] - begin) * (last - first)
            if held and logits + more > LOGITS:
                yield held
                held, logits = [], 0
            held.append(part)
            logits += more
    if held:
        yield held


def in_order(values: np.ndarray) -> np.ndarray:
    """A stable argsort of numbers below 2 ** 32, by halves, which numpy sorts by radix."""
    order = np.argsort((values & 0xFFFF).astype(np.uint16), kind="stable")
    high = (values >> 16).astype(np.uint16)
    return order[np.argsort(high[order], kind="stable")] if high.any() else order


def log_probabilities(p: dict, states: np.ndarray, targets: np.ndarray, grads: dict | None = None):
    """Natural log of every target's probability; with ``grads``, also the states' gradient.

    Rows are put in the order of their targets, so that those of one class, and
    of one group, lie side by side at every level.  Exponentials are divided by
    their total only where few columns are left.
    """
    n = states.shape[1]
    order = in_order(targets)
    word = targets[order]
    of_class = np.repeat(np.arange(len(p["class_b"])), np.diff(np.searchsorted(word, p["cuts"])))
    of_group = np.repeat(np.arange(len(p["group_b"])), np.diff(np.searchsorted(of_class, p["group_cuts"])))
    whole = np.array([0, len(p["group_w"])])
    h = np.ones((len(word), n + 1), states.dtype)  # the last column takes the biases
    h[:, :n] = states.take(order, axis=0)
    out = np.zeros(len(word))
    d_h = None if grads is None else np.zeros((len(word), n), states.dtype)
    reach = np.einsum("ij,ij->i", states, states).max(initial=0)
    levels = (
        (np.zeros(len(word), np.int64), whole, of_group),
        (of_group, p["group_cuts"], of_class),
        (of_class, p["cuts"], word),
    )
    for name, (family, cuts, member) in zip(LEVELS, levels, strict=True):
        weights, b, members = p[f"{name}_w"], p[f"{name}_b"], np.diff(cuts)
        # a family's greatest bias counts as zero: no exponential overflows as long as weights are moderate
        w = np.column_stack([weights, b - np.repeat(np.maximum.reduceat(b, cuts[:-1]), members)])
        moderate = np.einsum("ij,ij->i", weights, weights).max() * reach < MODERATE**2
        size = members[family]
        rows = np.flatnonzero(size > 1)  # an only member has probability one
        if not len(rows):
            if grads is not None:
                grads[f"{name}_w"], grads[f"{name}_b"] = np.zeros_like(weights), np.zeros_like(b)
            continue
        own, family, size, place = h.take(rows, axis=0), family[rows], size[rows], (member - cuts[family])[rows]
        begins = np.cumsum(size) - size
        picked, total = np.empty(len(rows), h.dtype), np.empty(len(rows), h.dtype)
        if grads is not None:
            d_w, d_own = np.zeros_like(w), np.zeros((len(rows) + 1, n), h.dtype)  # the last row is that of all others
        for block in blocks(family, cuts):
            at, end = block[0][0], block[-1][1]
            heads = begins[at:end] - begins[at]
            logits = np.empty(heads[-1] + size[end - 1], h.dtype)
            tables, used = [], 0
            for begin, stop, first, last in block:
                next_used = used + (stop - begin) * (last - first)
                tables.append(logits[used:next_used].reshape(stop - begin, last - first))
                np.matmul(own[begin:stop], w[first:last].T, out=tables[-1])
                used = next_used
            if not moderate:
                logits -= np.repeat(np.maximum.reduceat(logits, heads), size[at:end])
            chosen = heads + place[at:end]
            picked[at:end] = logits.take(chosen)
            np.exp(logits, out=logits)
            sums = np.add.reduceat(logits, heads, out=total[at:end])
            if grads is not None:
                logits[chosen] -= sums
                shared = own[at:end] / sums[:, None]
                for table, (begin, stop, first, last) in zip(tables, block, strict=True):
                    d_w[first:last] += table.T @ shared[begin - at : stop - at]
                    np.matmul(table, weights[first:last], out=d_own[begin:stop])
        out[rows] += picked - np.log(total)
        if grads is not None:
            grads[f"{name}_w"], grads[f"{name}_b"] = d_w[:, :n].copy(), d_w[:, n].copy()
            d_own[:-1] /= total[:, None]
            source = np.full(len(word), len(rows))
            source[rows] = np.arange(len(rows))
            d_h += d_own.take(source, axis=0)
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return out[back], None if d_h is None else d_h.take(back, axis=0)


def window(p: dict, words: np.ndarray, targets: np.ndarray, h: np.ndarray, read: np.ndarray | None = None) -> tuple[float, np.ndarray, dict]:
    """Loss, last state and gradients of one training window; rows are steps, columns streams.

    The state restarts where the word read is the end of a document.  Of ``into``,
    only the rows of the words ``read`` have a gradient if they are given.
    """
    steps, streams = words.shape
    n = h.shape[1]
    kind = p["into"].dtype
    tape, states = [], np.empty((steps, streams, n), kind)
    h = h.T
    for t in range(steps):
        go_on = (words[t] != END).astype(kind)
        before = h * go_on
        h, *rest = step(p, words[t], before)
        tape.append((go_on, before, *rest))
        states[t] = h.T
    grads = {k: np.zeros_like(p[k]) for k in ("back", "bias")}
    logs, d_states = log_probabilities(p, states.reshape(-1, n), targets.ravel(), grads)
    d_states = d_states.reshape(steps, streams, n).transpose(0, 2, 1)
    d_entered = np.empty((3 * n, steps, streams), kind)
    d_next = np.zeros((n, streams), kind)
    d_kept = np.empty((3 * n, streams), kind)
    for t in reversed(range(steps)):
        go_on, before, z, r, new, kept = tape[t]
        d = d_next
        d += d_states[t]
        d_z, d_r, d_new = (d_kept[i * n : (i + 1) * n] for i in range(3))
        through = d * z
        np.subtract(d, through, out=d_new)
        np.subtract(before, new, out=d_z)
        d_z *= d_new
        d_z *= z
        d_new *= 1 - new * new
        np.multiply(d_new, kept, out=d_r)
        d_r *= r
        d_r *= 1 - r
        d_entered[: 2 * n, t] = d_kept[: 2 * n]
        d_entered[2 * n :, t] = d_new
        d_new *= r
        grads["back"] += before @ d_kept.T
        grads["bias"] += d_kept.sum(axis=1)
        d_next = p["back"] @ d_kept
        d_next += through
        d_next *= go_on
    if read is None:
        read = np.arange(len(p["into"]))
    row = np.empty(len(p["into"]), np.int64)
    row[read] = np.arange(len(read))
    row = row[words.ravel()]
    grads["into"] = np.stack([np.bincount(row, x.ravel(), len(read)) for x in d_entered], axis=1).astype(kind)
    return -logs.sum(), h.T, grads


class Trainer:
    """Adagrad over truncated windows of parallel streams; streams are cut from documents in a row."""

    def __init__(self, p: dict, streams: int = 256, steps: int = 16, rate: float = 0.1):
        self.p = {k: v.copy() for k, v in p.items()}
        self.streams, self.steps, self.rate = streams, steps, rate
        self.squares = {k: np.full_like(v, 1e-6) for k, v in p.items()}
        self.tokens, self.loss = 0, 0.0

    def learn(self, ids: np.ndarray) -> None:
        """Documents in a row, each closed by END."""
        streams = max(1, min(self.streams, len(ids) // (4 * self.steps)))
        length = len(ids) // streams
        if length < 1:
            return
        targets = ids[: streams * length].reshape(streams, length).T
        words = np.concatenate([np.full((1, streams), END), targets[:-1]])
        h = np.zeros((streams, self.p["back"].shape[0]), np.float32)
        for at in range(0, length, self.steps):
            now = words[at : at + self.steps]
            read = np.flatnonzero(np.bincount(now.ravel()))
            loss, h, grads = window(self.p, now, targets[at : at + self.steps], h, read)
            self.tokens, self.loss = self.tokens + now.size, self.loss + loss
            for k, g in grads.items():
                only = k == "into"  # its other rows have no gradient
                g /= now.size
                squares = self.squares[k].take(read, axis=0) if only else self.squares[k]
                squares += g * g
                g *= self.rate
                g /= np.sqrt(squares)
                if only:
                    self.squares[k][read] = squares
                    self.p[k][read] = self.p[k].take(read, axis=0) - g
                else:
                    self.p[k] -= g
        self.learn(ids[streams * length :])  # what streams of equal length left over


def score(p: dict, ids: np.ndarray, sizes: np.ndarray, rows: int = 131_072) -> np.ndarray:
    """Natural log probability of each document; ``ids`` holds them in a row, each closed by END.

    Documents run side by side, longest first; states are carried from window to
    window, so a document of any length is scored whole.
    """
    order = np.argsort(-sizes, kind="stable")
    begins = (np.cumsum(sizes) - sizes)[order]
    longest_first = sizes[order]
    out = np.zeros(len(sizes))
    n = p["back"].shape[0]
    h = np.zeros((n, len(sizes)), np.float32)
    words = np.full(len(sizes), END)
    # states, targets and documents of the tokens held
    states = np.empty((min(rows + len(sizes), len(ids)), n), np.float32)
    targets = np.empty(len(states), np.int64)
    who = np.empty(len(states), np.int64)
    places = np.arange(len(sizes))
    held = 0
    longest = int(longest_first[0]) if len(sizes) else 0
    running = np.searchsorted(-longest_first, -np.arange(longest), side="left").tolist()
    for t, active in enumerate(running):
        h = step(p, words[:active], h[:, :active])[0]
        words = ids[begins[:active] + t]
        own = slice(held, held + active)
        states[own], targets[own], who[own] = h.T, words, places[:active]
        held += active
        if held >= rows or t == longest - 1:
            logs, _ = log_probabilities(p, states[:held], targets[:held])
            out[order] += np.bincount(who[:held], logs, len(sizes))
            held = 0
    return out
