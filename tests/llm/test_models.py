import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from tests.llm.conftest import EDGE, prose

from recallgrid.llm import gated_model as gm
from recallgrid.llm import lm_scoring, quality_classifier


def test_probabilities_sum_to_one_and_gradients_are_right():
    rng = np.random.default_rng(0)
    p = {k: v if k in gm.FIXED else v.astype(np.float64) for k, v in gm.start(np.arange(1, 131)).items()}
    for k in ("group_w", "class_w", "word_w", "bias"):
        p[k] = rng.normal(0, 0.3, p[k].shape)
    h = rng.normal(size=(1, gm.HIDDEN))
    logs, _ = gm.log_probabilities(p, np.repeat(h, 130, 0), np.arange(130))
    assert abs(np.exp(logs).sum() - 1) < 1e-3
    words, targets = rng.integers(0, 130, (3, 5)), rng.integers(0, 130, (3, 5))
    start = rng.normal(size=(5, gm.HIDDEN))
    _, _, grads = gm.window(p, words, targets, start)
    for name in grads:
        at = tuple(rng.integers(0, s) for s in p[name].shape)
        if name == "into":
            at = (words[0, 0], at[1])
        moved = {k: v.copy() for k, v in p.items()}
        moved[name][at] += 1e-4
        up = gm.window(moved, words, targets, start)[0]
        moved[name][at] -= 2e-4
        down = gm.window(moved, words, targets, start)[0]
        assert abs((up - down) / 2e-4 - grads[name][at]) < 1e-2, name


def test_learning_beats_unigrams_and_windows_do_not_matter():
    rng = np.random.default_rng(1)
    ids = np.concatenate([np.r_[np.tile([2, 3, 4, 5], rng.integers(1, 20)), 0] for _ in range(800)])
    p = gm.start(np.bincount(ids, minlength=70).astype(float))
    trainer = gm.Trainer(p, streams=32)
    for _ in range(4):
        trainer.learn(ids)
    sizes = np.diff(np.r_[0, np.flatnonzero(ids == 0) + 1])
    before, after = gm.score(p, ids, sizes), gm.score(trainer.p, ids, sizes)
    assert after.sum() > 0.6 * before.sum()
    assert np.allclose(after, gm.score(trainer.p, ids, sizes, rows=7), atol=1e-3)
    one = gm.score(trainer.p, ids[: sizes[0]], sizes[:1])
    assert np.allclose(one, after[:1], atol=1e-3)


def score_by_hand(p, ids):
    """Log10 probability of one document: a plain loop over its words and the levels of each."""

    def softmax(logits):
        e = [math.exp(x - max(logits)) for x in logits]
        return [x / sum(e) for x in e]

    def member(name, first, last, chosen, h):
        logits = [float(p[f"{name}_w"][m] @ h + p[f"{name}_b"][m]) for m in range(first, last)]
        return softmax(logits)[chosen - first]

    n, total = p["back"].shape[0], 0.0
    h, read = np.zeros(n), gm.END
    for word in ids:
        x, kept = p["into"][read].astype(float), h @ p["back"] + p["bias"]
        z, r = (1 / (1 + np.exp(-(x[i * n : (i + 1) * n] + kept[i * n : (i + 1) * n]))) for i in (0, 1))
        new = np.tanh(x[2 * n :] + r * kept[2 * n :])
        h = new + z * (h - new)
        own = max(c for c in range(len(p["cuts"]) - 1) if p["cuts"][c] <= word)
        group = max(g for g in range(len(p["group_cuts"]) - 1) if p["group_cuts"][g] <= own)
        total += math.log10(member("group", 0, len(p["group_w"]), group, h))
        total += math.log10(member("class", p["group_cuts"][group], p["group_cuts"][group + 1], own, h))
        total += math.log10(member("word", p["cuts"][own], p["cuts"][own + 1], word, h))
        read = word
    return total


def test_document_scores_equal_a_plain_loop(monkeypatch):
    rng = np.random.default_rng(8)
    p = gm.start(1e5 / np.arange(1, 301))
    for k in p.keys() - set(gm.FIXED):
        p[k] = (p[k] + rng.normal(0, 0.3, p[k].shape)).astype(np.float32)
    documents = [[*rng.integers(1, 300, n).tolist(), gm.END] for n in (0, 1, 40, 7, 40)]
    sizes = np.array([*map(len, documents)])
    want = [score_by_hand(p, d) for d in documents]
    for logits in (gm.LOGITS, 50):
        monkeypatch.setattr(gm, "LOGITS", logits)
        got = gm.score(p, np.concatenate(documents), sizes) / np.log(10)
        assert np.allclose(got, want, atol=1e-3)


def test_exponentials_of_many_classes_are_taken_at_once(monkeypatch):
    calls = []

    class Counting:
        def __getattr__(self, name):
            return getattr(np, name)

        def exp(self, x, **more):
            calls.append(x.size)
            return np.exp(x, **more)

    rng = np.random.default_rng(4)
    p = gm.start(1e6 / np.arange(1, 3_001))
    h, targets = np.tanh(rng.normal(size=(3_000, gm.HIDDEN))).astype(np.float32), np.arange(3_000)
    want = gm.log_probabilities(p, h, targets)[0]
    monkeypatch.setattr(gm, "np", Counting())
    got = gm.log_probabilities(p, h, targets, {})[0]
    assert np.allclose(got, want) and len(p["cuts"]) > 100
    assert len(calls) <= 3 + 2 * sum(calls) / gm.LOGITS and max(calls) <= gm.LOGITS


def test_great_weights_and_words_not_read():
    rng = np.random.default_rng(9)
    p = gm.start(np.arange(1, 131))
    h = np.tanh(rng.normal(size=(1, gm.HIDDEN))).astype(np.float32)
    for name in ("group_w", "class_w", "word_w"):
        p[name] = rng.normal(0, 60, p[name].shape).astype(np.float32)
    logs, d = gm.log_probabilities(p, np.repeat(h, 130, 0), np.arange(130), {})
    assert np.isfinite(logs).all() and np.isfinite(d).all() and abs(np.exp(logs).sum() - 1) < 1e-3
    p, (words, targets) = gm.start(np.arange(1, 131)), rng.integers(0, 130, (2, 3, 5))
    start, read = rng.normal(size=(5, gm.HIDDEN)).astype(np.float32), np.unique(words)
    whole, some = (gm.window(p, words, targets, start, *x)[2] for x in ((), (read,)))
    assert np.allclose(whole["into"][read], some["into"]) and len(some["into"]) == len(read)
    assert np.abs(whole["into"]).sum(axis=1).astype(bool).sum() <= len(read)
    for order in (rng.integers(0, 130, 999), rng.integers(0, 1 << 20, 999)):
        assert (gm.in_order(order) == np.argsort(order, kind="stable")).all()


def test_words_of_many_texts_are_those_of_each():
    rng = random.Random(10)
    signs = [*" \t\n\x0b\x0c\r", *"\x00\x1c\x1f\x85\xa0\u2003", *"aAzZÉßİ中😀"]
    texts = ["", " ", *("".join(rng.choices(signs, k=rng.randrange(30))) for _ in range(2_000))]
    found, sizes = lm_scoring.words(pa.array(texts))
    want = [t.encode().lower().split() for t in texts]
    assert [w.encode() for w in found.to_pylist()] == [w for own in want for w in own]
    assert sizes.tolist() == [len(own) for own in want]
    assert lm_scoring.words(pa.array(texts).slice(5, 90))[1].tolist() == sizes[5:95].tolist()
    assert [len(x) for x in lm_scoring.words(pa.array([], pa.string()))] == [0, 0]


def base_by_hand(rows):
    split = lambda t: [w for w in (t or "").encode().lower().split()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter()
    for i, t in rows:
        if not held(i):
            counts.update(split(t))
            counts[b""] += 1
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, t in rows:
        tokens = [*split(t), b""]
        score = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens)
        out.append((str(i), held(i), len(tokens), sum(counts[w] > 0 for w in tokens), n, round(score, 4)))
    return sorted(out)


def test_base_scores_equal_brute_force(docs):
    rng = random.Random(3)
    rows = EDGE + [(100 + i, prose(rng, rng.randrange(60)) + f" own{rng.randrange(300)}") for i in range(200)]
    for keep in (200_000, 10):
        scored = lm_scoring.score_documents(docs(rows), keep=keep, model_words=8, lanes=2, share=1.0).collect()
        got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in scored)
        assert got == base_by_hand(rows)
        assert all(math.isfinite(r.score) and r.score < 0 for r in scored)
    assert lm_scoring.score_documents(docs([])).count() == 0


def test_counting_hands_words_on_within_a_batch():
    texts = [" ".join(f"w{i}x{j}" for j in range(30)) + " the" for i in range(8_000)]
    made = list(lm_scoring.counted(iter([pa.record_batch([pa.array(texts)], ["text"])])))
    assert max(b.num_rows for b in made) <= lm_scoring.WORDS_HELD + 31 * lm_scoring.GROUP
    counts = Counter()
    for b in made:
        for word, n in zip(b["word"].to_pylist(), b["n"].to_pylist(), strict=True):
            counts[word] += n
    assert counts["the"] == counts[""] == 8_000 and len(counts) == 240_002


def test_every_training_token_is_learned_from(docs):
    trainer = gm.Trainer(gm.start(np.ones(70)), streams=32)
    trainer.learn(np.random.default_rng(2).integers(0, 70, 5_003))
    assert trainer.tokens == 5_003
    rng = random.Random(6)
    frame = docs([(i, prose(rng, rng.randrange(60))) for i in range(200)])
    scores = [sorted((r.doc_id, r.score) for r in lm_scoring.score_documents(frame, lanes=2, **own).collect()) for own in ({}, {"share": 1.0})]
    assert scores[0] == scores[1]


def test_the_model_names_every_word_of_enough_examples(docs, monkeypatch):
    held = []
    train = lm_scoring.train
    monkeypatch.setattr(lm_scoring, "train", lambda *a: held.append(a[1]) or train(*a))
    rows = [(None, " ".join(f"w{i}" for i in range(2_500)) + (" seldom" if n < 4 else "")) for n in range(6)]
    assert all(r.score < 0 for r in lm_scoring.score_documents(docs(rows), lanes=2).collect())
    assert set(held[0].model) == {f"w{i}".encode() for i in range(2_500)}
    assert lm_scoring.least_count(10**6) < lm_scoring.least_count(10**8) < 10 * lm_scoring.least_count(10**6)
    p = gm.start(1e6 / np.arange(1, 2_503))
    mass = np.add.reduceat(1e6 / np.arange(1, 2_503), p["cuts"][:-1])
    assert np.diff(p["cuts"]).max() > 30 and np.median(mass) < 3 * mass.min() and len(mass) < 200


def test_classifier_separates_held_out_junk(docs, llm_spark):
    rng = random.Random(5)
    rows = [(i, None if i == 0 else "" if i == 1 else prose(rng, 60) + "." if i % 2 else "!! ".join(["BUY"] * rng.randrange(5, 60))) for i in range(400)]
    labels = [(i, i % 2, 0) for i in range(400)] + [(2, None, 1), (3, 1, 0)]
    frame = llm_spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality_classifier.quality(docs(rows + [(None, "a text without id")]), frame).collect()
    assert len(got) == 401
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    held = [r for r in got if r.held_out and r.doc_id > 1]
    assert len(held) > 50 and sum(r.predicted == r.doc_id % 2 for r in held) >= 0.95 * len(held)
    assert {r.score for r in quality_classifier.quality(docs(rows), frame.limit(0)).collect()} == {0.5}
    assert quality_classifier.quality(docs([]), frame).count() == 0
