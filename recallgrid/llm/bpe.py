"""Byte-level BPE over many words at once, as rank-synchronous merging of ragged arrays.

All distinct words of a batch lie one after the other in flat arrays.  In each
round every word finds the lowest rank among its neighbouring pairs and merges
all occurrences of that pair, all words at the same time; finished words leave
the arrays.  A pair made by a merge always ranks behind that merge, so this
equals merging pair by pair.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

import numpy as np
import regex

SPECIAL = "<|endoftext|>"
NONE = np.int32(2**31 - 1)
# A space between two white characters, or between one and the end, belongs to
# a longer run; any other space starts a new pre-token.
RUN = re.compile(r"\s (?:\s|\Z)")


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies, to the byte."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Numbers(dict):
    """Numbers of words as they come; those met for the first time are listed."""

    def __init__(self, known: Iterable[str] = ()):
        super().__init__((word, n) for n, word in enumerate(known))
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number


class Merges:
    """Merge ranks of a vocabulary file, as sorted arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab = spec["model"]["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        keys = left << 20 | right
        self.rank_of = np.argsort(keys).astype(np.int32)
        self.keys = keys[self.rank_of]
        self.first = np.zeros(256, np.int32)
        for letter, byte in byte_letters().items():
            self.first[byte] = vocab[letter]
        pair = np.arange(256)
        self.byte_ranks = self.ranks(*np.meshgrid(self.first[pair], self.first[pair], indexing="ij"))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}.get(SPECIAL)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 20 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.rank_of[at], NONE)

    def encode(self, raw: bytes, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words that ``raw`` holds in a row, and where each word's ids begin (one more at the end)."""
        octets = np.frombuffer(raw, np.uint8)
        symbols = self.first[octets]
        word = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        rank = np.full(len(symbols), NONE, np.int32)
        rank[:-1] = np.where(word[1:] == word[:-1], self.byte_ranks[octets[:-1], octets[1:]], NONE)
        done_ids, done_words = [], []
        while len(symbols):
            starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            lengths = np.diff(starts, append=len(word))
            lowest = np.minimum.reduceat(rank, starts)
            target = np.repeat(lowest, lengths)
            over = target == NONE
            if over.any():
                done_ids.append(symbols[over])
                done_words.append(word[over])
                going = ~over
                symbols, word, rank, target = symbols[going], word[going], rank[going], target[going]
                if not len(symbols):
                    break
            hit = rank == target
            if (hit[1:] & hit[:-1]).any():  # runs of one symbol: every second pair merges
                at = np.arange(len(hit))
                hit &= (at - np.maximum.accumulate(np.where(hit, -1, at))) % 2 == 1
            merged = np.flatnonzero(hit)
            symbols[merged] = self.made[rank[merged]]
            stay = np.ones(len(symbols), bool)
            stay[merged + 1] = False
            symbols, word, rank = symbols[stay], word[stay], rank[stay]
            new = merged - np.arange(len(merged))  # each earlier merge took one place
            touched = np.zeros(len(symbols) + 1, bool)
            touched[new] = touched[new - 1] = True  # -1 falls on the spare last place
            touched = np.flatnonzero(touched[: len(symbols) - 1])
            same = word[touched] == word[touched + 1]
            rank[touched[~same]] = NONE
            touched = touched[same]
            rank[touched] = self.ranks(symbols[touched], symbols[touched + 1])
            rank[-1] = NONE
        ids = np.concatenate(done_ids) if done_ids else np.zeros(0, np.int32)
        owner = np.concatenate(done_words) if done_words else np.zeros(0, np.int32)
        offsets = np.zeros(len(sizes) + 1, np.int64)
        np.cumsum(np.bincount(owner, minlength=len(sizes)), out=offsets[1:])
        return ids[np.argsort(owner, kind="stable")].astype("<u4"), offsets


class TextEncoder:
    """Ids (or their number) of whole texts.

    A text falls into chunks that begin at a space; chunks repeat, so each
    distinct one is cut into pre-tokens and merged once.  At most ``keep``
    chunks, of 16 characters on average, stay between calls.
    """

    def __init__(self, path: str, pattern: str, counts: bool, keep: int = 600_000):
        self.merges, self.pattern = Merges(path), regex.compile(pattern)
        self.counts, self.keep = counts, keep
        self.forget()

    def forget(self) -> None:
        self.known = Numbers()  # of chunks without their leading space; by number, where their ids begin and how many they are
        self.begins, self.sizes, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")
        self.held = 0  # characters of these chunks

    def values(self, pieces: list[str], rest: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of pieces that don't depend on each other, and of chunks behind a space; where those of each begin and end."""
        # Chunks that neither begin nor end with white space are cut in a row: the space before the next one parts them.
        strict = all(rest) and list(map(str.strip, rest)) == rest
        lone = [] if strict else [n for n, x in enumerate(rest) if not x or x.strip() != x]
        row = rest
        if lone:
            out = set(lone)
            row = [x for n, x in enumerate(rest) if n not in out]
        tokens, stops = [], [0]
        for piece in [*pieces, *[" " + rest[n] for n in lone]]:
            tokens += self.pattern.findall(piece)
            stops.append(len(tokens))
        in_row = self.pattern.findall(" " + " ".join(row)) if row else []
        tokens += in_row
        raw = "".join(tokens).encode("utf-8", "surrogatepass")
        sizes = list(map(len, tokens))
        if len(raw) > sum(sizes):
            sizes = [len(x.encode("utf-8", "surrogatepass")) for x in tokens]
        ids, offsets = self.merges.encode(raw, sizes)
        # the tokens at which each chunk of the row ends
        lengths = np.cumsum(np.fromiter(map(len, in_row), np.int64, len(in_row)))
        ends = np.cumsum(np.fromiter(map(len, row), np.int64, len(row)) + 1)
        ends = np.searchsorted(lengths, ends) + 1 + stops[-1]
        bounds = offsets[np.concatenate([np.array(stops, np.int64), ends])]
        begins, ends = bounds[:-1], bounds[1:]
        if lone:
            place = np.concatenate([np.array(lone), np.setdiff1d(np.arange(len(rest)), lone)])
            order = np.concatenate([np.arange(len(pieces)), len(pieces) + np.argsort(place)])
            begins, ends = begins[order], ends[order]
        return ids, begins, ends

    def encode(self, texts: list[str]) -> list:
        parts, owner = [], []
        for i, text in enumerate(texts):
            for n, part in enumerate(text.split(SPECIAL) if SPECIAL in text else (text,)):
                owner.append((i, n))
                parts.append(part)
        special = 1 if self.counts else np.array([self.merges.special], "<u4").tobytes()
        out = [0 if self.counts else b""] * len(texts)
        for (i, n), value in zip(owner, self.encode_plain(parts), strict=True):
            out[i] = out[i] + special + value if n else value
        return out

    def encode_plain(self, texts: list[str]) -> list:
        # Heads have no leading space, and texts with runs of white space are taken whole.
        split = [[text] if RUN.search(text) else text.split(" ") for text in texts]
        known = self.known
        words = [x for own in split for x in own[1:]]
        numbers = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        stops = np.cumsum([0, *[len(own) - 1 for own in split]])
        new, known.new = known.new, []
        ids, begins, ends = self.values([own[0] for own in split], new)
        heads = (ends - begins)[: len(split)]
        # Ids of new chunks, which lie behind those of the heads, go behind those of the chunks that are known.
        kept_from = int(heads.sum())
        self.begins = np.concatenate([self.begins, begins[len(split) :] + len(self.ids) - kept_from])
        self.sizes = np.concatenate([self.sizes, (ends - begins)[len(split) :]])
        sizes = self.sizes[numbers]
        done = np.concatenate([[0], np.cumsum(sizes)])
        at = done[stops]
        if self.counts:
            out = (heads + np.diff(at)).tolist()
        else:
            self.ids = np.concatenate([self.ids, ids[kept_from:]])
            taken = self.ids[np.repeat(self.begins[numbers] - done[:-1], sizes) + np.arange(done[-1])].tobytes()
            flat, cuts = ids.tobytes(), (4 * at).tolist()
            first = zip((4 * begins).tolist(), (4 * ends).tolist(), strict=True)
            out = [flat[a:b] + taken[c:d] for (a, b), c, d in zip(first, cuts, cuts[1:], strict=False)]
        self.held += sum(map(len, new))
        if len(known) > self.keep or self.held > 16 * self.keep:
            self.forget()
        return out
