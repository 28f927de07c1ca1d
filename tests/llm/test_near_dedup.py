import random

import numpy as np
import pytest
import xxhash
from tests.llm.conftest import EDGE, prose

from recallgrid.llm import near_dedup


def by_hand(text):
    words = [w for w in (text or "").encode().lower().replace(b"\x0b", b" ").split() if w]
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    bits = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            bits[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(shingles))


def classes(rows, radius=4):
    prints = [by_hand(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        r = find(i)
        if doc is not None:
            least[r] = min(least.get(r, doc), doc)
    return sorted((str(doc), f"{prints[i]:016x}", str(least.get(find(i)))) for i, (doc, _) in enumerate(rows))


def result(df):
    return sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in df.collect())


@pytest.mark.parametrize("shard", [16_384, 8])
def test_components_equal_brute_force(docs, monkeypatch, shard):
    monkeypatch.setattr(near_dedup, "SHARD", shard)
    monkeypatch.setattr(near_dedup, "LEAF", 4)
    rng = random.Random(shard)
    rows = [r for r in EDGE if r[0] != 6]
    for i in range(40):
        base = prose(rng, 120).split()
        rows.append((100 + 10 * i, " ".join(base)))
        for n in range(rng.randrange(4)):
            changed = list(base)
            for _ in range(n):
                changed[rng.randrange(len(changed))] = "changed"
            rows.append((100 + 10 * i + n + 1, "  ".join(changed).upper()))
    rows += [(900 + i, "the same text again and again") for i in range(30)]
    assert result(near_dedup.near_duplicates(docs(rows))) == classes(rows)


def test_links_in_dense_groups_equal_brute_force(llm_spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SHARD", 64)
    rng = random.Random(1)
    points = {rng.getrandbits(64) for _ in range(300)}
    for _ in range(3):
        centre = rng.getrandbits(64)
        for _ in range(150):
            near = centre
            for _ in range(rng.randrange(6)):
                near ^= 1 << rng.randrange(64)
            points.add(near)
    points = sorted(points)
    signed = np.array(points, np.uint64).view(np.int64).tolist()
    frame = llm_spark.createDataFrame([(p,) for p in signed], "fp long")
    roots = {r.node: r.root for r in near_dedup.components(near_dedup.close_links(frame, 4)).collect()}
    label = {p: roots.get(s, s) for p, s in zip(points, signed, strict=True)}
    groups = {}
    left = set(points)
    while left:
        front, group = [left.pop()], set()
        while front:
            x = front.pop()
            group.add(x)
            near = {y for y in left if (x ^ y).bit_count() <= 4}
            left -= near
            front += near
        groups[min(np.array(sorted(group), np.uint64).view(np.int64).tolist())] = group
    assert {r: {p for p in points if label[p] == r} for r in set(label.values())} == groups


def test_empty_table(docs):
    assert near_dedup.near_duplicates(docs([])).count() == 0
