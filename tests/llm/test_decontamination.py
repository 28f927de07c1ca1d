import hashlib
import random
import re

import pytest
from tests.llm.conftest import EDGE, prose

from recallgrid.llm import decontamination as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def by_hand(rows, items):
    windows = [(str(i), w[k : k + 13]) for i, t in items for w in [words(t)] if w for k in range(max(1, len(w) - 12))]
    out = []
    for doc, text in rows:
        own, hit, found = words(text), set(), set()
        for item, window in windows:
            for at in range(len(own) - len(window) + 1):
                if own[at : at + len(window)] == window:
                    hit.update(range(at, at + len(window)))
                    found.add(item)
        mark = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((str(doc), len(own), len(hit), len(found), mark, bool(hit) and 20 * len(hit) >= len(own)))
    return sorted(out)


@pytest.mark.parametrize("block", [10**6, 40])
def test_report_equals_brute_force(docs, llm_spark, monkeypatch, block):
    monkeypatch.setattr(dc, "CANDIDATES", 50)
    rng = random.Random(7)
    items = [(i, prose(rng, rng.choice([3, 13, 20, 40]))) for i in range(12)]
    items += [(50, None), (51, "..."), (52, "one"), (53, items[0][1]), (54, "the the the the")]
    rows = [r for r in EDGE if r[0] not in (6, 7)] + [(7, "the " * 50)]
    for i in range(60):
        text = prose(rng, rng.randrange(5, 200))
        if i % 3 == 0:
            text += "!! " + rng.choice(items[:12])[1].upper().replace(" ", ", ") + " " + prose(rng, 5)
        rows.append((100 + i, text))
    bench = llm_spark.createDataFrame(items, "item_id long, text string")
    found = dc.find_passages(docs(rows), bench, block_words=block)
    got = sorted((str(r[0]), *r[1:]) for r in dc.report(found).collect())
    assert got == by_hand(rows, items)


def test_proximity_matches_are_reported_apart(docs, llm_spark):
    phrase = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"
    moved = phrase.replace("gamma delta", "gamma some delta")
    bench = llm_spark.createDataFrame([(1, phrase)], "item_id long, text string")
    rows = {r.doc_id: r for r in dc.find_passages(docs([(1, phrase), (2, moved), (3, "alpha nu")]), bench).collect()}
    assert rows[1]["items"] == ["1"] and rows[1].near_items == []
    assert rows[2]["items"] == [] and rows[2].near_items == ["1"] and rows[2].n_hit == 0
    assert rows[3].near_items == []
    assert [(s["from"], s["to"]) for s in rows[1].spans] == [(0, 13)]


def near_by_hand(text, items):
    own, found = words(text), set()
    for item, t in items:
        ws = words(t)
        for k in range(max(1, len(ws) - 12)):
            window = ws[k : k + 13]
            for s in range(-13, len(own) + 13) if len(window) > 2 else ():
                missing = sum(w not in own[max(0, s + i - 2) : max(0, s + i + 3)] for i, w in enumerate(window))
                if missing <= (len(window) >= 8):
                    found.add(str(item))
                    break
    return found


def test_proximity_equals_brute_force_however_documents_are_dealt(docs, llm_spark, monkeypatch):
    monkeypatch.setattr(dc, "CANDIDATES", 50)
    rng = random.Random(9)
    own = [f"w{i}" for i in range(60)]
    items = [(i, prose(rng, rng.choice([3, 7, 8, 13, 16]), own)) for i in range(10)] + [(20, " ".join(own[:13]))]
    rows = [(1, " ".join(own[:12])), (2, " ".join(own[1:13])), (3, " ".join(own[:5])), (4, " ".join(own[5:13]))]
    for i in range(60):
        near = words(items[i % 11][1])
        for _ in range(i % 4):
            at = rng.randrange(len(near))
            near[at : at + 1] = rng.choice([["other"], [rng.choice(own)], [], [near[at], "more"]])
        rows.append((10 + i, " ".join([prose(rng, rng.randrange(4), own), *near, prose(rng, rng.randrange(4), own)])))
    bench = llm_spark.createDataFrame(items, "item_id long, text string")
    want = None
    for parts, block in ((1, 10**6), (7, 10**6), (64, 40)):
        found = dc.find_passages(docs(rows).repartition(parts), bench, block_words=block).collect()
        if want is None:
            exact = {r.doc_id: set(r["items"]) for r in found}
            want = {i: near_by_hand(t, items) - exact[i] for i, t in rows}
            assert sum(map(len, want.values())) > 20
        assert {r.doc_id: set(r.near_items) for r in found} == want


def test_one_block_is_held_at_a_time(docs, llm_spark, monkeypatch):
    seen = []
    match, stage = dc.match_block, dc.stage
    monkeypatch.setattr(dc, "match_block", lambda *a: seen.append("read") or match(*a))
    monkeypatch.setattr(dc, "stage", lambda df, name: seen.append(name) or stage(df, name))
    bench = llm_spark.createDataFrame([(i, f"a{i} b{i} c{i}") for i in range(6)], "item_id long, text string")
    found = dc.find_passages(docs([(1, "a1 b1 c1"), (2, "x")]), bench, block_words=6).collect()
    assert {r.doc_id: r["items"] for r in found} == {1: ["1"], 2: []}
    assert seen == ["numbered", *["read", "block"] * 3]


def test_empty_tables(docs, llm_spark):
    none = llm_spark.createDataFrame([], "item_id long, text string")
    assert dc.report(dc.find_passages(docs([]), none)).count() == 0
    assert dc.report(dc.find_passages(docs([(1, "a b")]), none)).first()[1:4] == (2, 0, 0)
