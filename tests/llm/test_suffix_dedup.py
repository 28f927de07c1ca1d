import hashlib
import random

import numpy as np
import pytest
from tests.llm.conftest import EDGE, prose

from recallgrid.llm import suffix_dedup
from recallgrid.llm.suffix_family import Family


def by_hand(rows, width=100):
    """Windows in document order; rows of one id in the order the operator states."""
    tie = suffix_dedup.xxhash.xxh3_64_intdigest
    octets = [(i, (t or "").encode()) for i, t in rows]
    octets.sort(key=lambda d: (d[0] is None, d[0] or 0, tie(d[1]) % suffix_dedup.TIES))
    seen, made = set(), []
    for doc_id, raw in octets:
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - width + 1):
            window = raw[s : s + width]
            if window in seen:
                gone[s : s + width] = True
            seen.add(window)
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        made.append((str(doc_id), len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(made)


def result(df):
    rows = df.collect()
    for r in rows:
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows)


@pytest.fixture
def corpus():
    rng = random.Random(7)
    passages = [prose(rng, n) for n in (18, 25, 60, 200)]
    rows = [*EDGE[:-2], (6, "word " * 800), (7, "a" * 700), (8, "ab" * 300)]
    for i in range(70):
        parts = [prose(rng, rng.randrange(30)), rng.choice(passages), prose(rng, rng.randrange(30))]
        if rng.random() < 0.4:
            parts.insert(1, rng.choice(passages)[rng.randrange(40) :])
        rows.append((100 + i, "".join(parts) if rng.random() < 0.5 else " ".join(parts)))
    rows += [(500 + i, rows[20 + i][1]) for i in range(10)]
    rows += [(30, rows[25][1]), (30, rows[26][1]), (130, "x" + rows[40][1]), (130, rows[41][1]), (None, rows[30][1])]
    rows += [rows[50], rows[50], (None, "ü" * 60 + passages[2]), (900, passages[2] + "ü" * 60 + passages[2])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("block", "shard", "batch", "frequent"), [(1 << 24, 1 << 24, 32_768, 2_000), (3_000, 4_000, 64, 2_000), (3_000, 1 << 24, 64, 10**9), (6_000, 9_000, 200, 10**9)])
def test_removal_equals_brute_force(docs, corpus, monkeypatch, block, shard, batch, frequent):
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    monkeypatch.setattr(suffix_dedup, "SHARD", shard)
    monkeypatch.setattr(suffix_dedup, "BATCH", batch)
    if frequent > 10**6:  # every anchor that two sampled documents share goes window by window
        monkeypatch.setattr(suffix_dedup, "SAMPLED", 1)
        everywhere = suffix_dedup.frequent_anchors.__code__
        monkeypatch.setattr(suffix_dedup.frequent_anchors, "__code__", everywhere.replace(co_consts=tuple(3 if c == 32 else c for c in everywhere.co_consts)))
        monkeypatch.setattr(suffix_dedup, "FREQUENT", frequent)
    assert result(suffix_dedup.remove_repeats(docs(corpus).repartition(4))) == by_hand(corpus)


def test_other_widths(docs, corpus):
    for width in (20, 60, 146):
        assert result(suffix_dedup.remove_repeats(docs(corpus[:30]), width)) == by_hand(corpus[:30], width)


def test_no_rows(docs):
    assert suffix_dedup.remove_repeats(docs([])).collect() == []


def test_family_marks_what_stands_earlier():
    rng = random.Random(3)
    strings = ["".join(rng.choice("ab\0") for _ in range(rng.randrange(30))).encode() for _ in range(200)]
    family, seen, at = Family(8), set(), 0
    while at < len(strings):
        some = strings[at : at + rng.randrange(1, 9)]
        for string, earlier in zip(some, family.add(some), strict=True):
            for s in range(max(0, len(string) - 7)):
                assert earlier[s] == (string[s : s + 8] in seen)
                seen.add(string[s : s + 8])
        at += len(some)
    held = [k for level in family.levels for k in level.keys().tolist()]
    assert len(held) == len(seen)
    assert all((np.diff(np.argsort(level.keys(), kind="stable")) == 1).all() for level in family.levels)
    sizes = [len(level) for level in family.levels]
    assert all(a > 2 * b for a, b in zip(sizes, sizes[1:], strict=False))
