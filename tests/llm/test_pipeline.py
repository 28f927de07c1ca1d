import random

import corpus_pipeline
import pytest
from tests.llm.conftest import prose
from tests.llm.test_decontamination import by_hand as contaminated
from tests.llm.test_native import lines_by_hand, rules_by_hand
from tests.llm.test_near_dedup import classes


@pytest.fixture
def corpus(docs, llm_spark, tmp_path):
    rng = random.Random(11)
    items = [(i, prose(rng, 20)) for i in range(5)]
    rows = [(None, "no words"), (None, prose(rng, 40)), (1, None), (2, "")]
    for i in range(60):
        own = [prose(rng, 30) for _ in range(3)]
        own.insert(0, "Subscribe to our newsletter")
        if i % 10 == 0:
            own.append(items[i // 10 % 5][1])  # on too few pages to be boilerplate
        rows.append((100 + i, "\n".join(own)))
    rows += [(300 + i, rows[14][1]) for i in range(5)] + [rows[14], (400, "too short")]
    frame = docs(rows).select("doc_id", "text", "lang", "source", "n_chars")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    llm_spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return frame, rows, items, str(tmp_path)


def pairs(frame):
    return sorted(((r.doc_id, r.text) for r in frame.collect()), key=str)


def test_each_stage_equals_brute_force_on_what_it_gets(corpus, llm_spark):
    frame, rows, items, folder = corpus
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality"](llm_spark, frame, folder)
    assert kept.columns == frame.columns
    assert pairs(kept) == sorted(((i, t) for i, t in rows if rules_by_hand(t)[-1]), key=str)
    clean = stages["lines"](llm_spark, kept, folder)
    want = sorted(((i, t) for i, _, t, *_ in lines_by_hand([(i, t, "s") for i, t in pairs(kept)], 0.05, 5)), key=str)
    assert [(str(i), t) for i, t in pairs(clean)] == want and clean.columns == frame.columns
    assert not any("newsletter" in (t or "") for _, t in pairs(clean))
    single = stages["near_copies"](llm_spark, clean, folder)
    named = [r for r in classes(pairs(clean)) if r[0] == r[2]]
    assert sorted(str(i) for i, _ in pairs(single)) == sorted({r[0] for r in named})
    assert set(pairs(single)) <= set(pairs(clean)) and single.columns == frame.columns
    good = stages["benchmark"](llm_spark, single, folder)
    bad = {r[0] for r in contaminated(pairs(single), items) if r[-1]}
    assert bad and sorted(str(i) for i, _ in pairs(good)) == sorted(str(i) for i, _ in pairs(single) if str(i) not in bad)
    packed = corpus_pipeline.run(llm_spark, folder)
    assert sorted({str(r.doc_id) for r in packed.collect()}) == sorted(str(i) for i, _ in pairs(good))


def test_empty_table(corpus, llm_spark, tmp_path):
    frame, _, _, folder = corpus
    for _, stage in corpus_pipeline.STAGES:
        assert stage(llm_spark, frame.limit(0), folder).count() == 0


def test_one_id_on_two_texts(docs, llm_spark, tmp_path):
    rng = random.Random(12)
    a, b, c = (prose(rng, 60) for _ in range(3))
    llm_spark.createDataFrame([(0, a)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    copies = docs([(5, a), (5, b), (3, b)]).select(*columns)
    assert pairs(stages["near_copies"](llm_spark, copies, str(tmp_path))) == sorted([(5, a), (3, b)], key=str)
    mixed = docs([(5, a), (5, b), (3, c), (None, a), (None, c)]).select(*columns)
    good = stages["benchmark"](llm_spark, mixed, str(tmp_path))
    assert good.columns == columns and pairs(good) == sorted([(5, b), (3, c), (None, c)], key=str)
