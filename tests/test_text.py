import json

import pytest
from pyspark.sql import functions as F

from recallgrid.functions import metadata, text
from recallgrid.functions.stemming import porter_stem
from recallgrid.operators import notes as notes_ops


def one(spark, make, *values):
    columns = [f"c{i}" for i in range(len(values))]
    schema = ", ".join(f"{c} {'array<string>' if isinstance(v, list) else 'string'}" for c, v in zip(columns, values))
    df = spark.createDataFrame([tuple(values)], schema)
    return df.select(make(*[F.col(c) for c in columns]).alias("v")).first().v


def test_normalize_folds_quotes_spaces_case_and_compatibility_forms(spark):
    assert one(spark, text.normalize_text, " “It’s A\t\nTEST” ") == "\"it's a test\""
    assert one(spark, text.normalize_text, "ﬁne ２０") == "fine 20"
    assert one(spark, lambda c: text.normalize_text(c, nfkc=False), "ﬁne") == "ﬁne"


def test_speakers_are_stripped_anywhere(spark):
    assert one(spark, text.strip_speakers, "User: hi\nASSISTANT :  yo superuser: x") == "hi\nyo superuser: x"


def test_word_tokens_keep_accents(spark):
    assert one(spark, text.word_tokens, "élan vital_1, x") == ["élan", "vital_1", "x"]


@pytest.mark.parametrize("found, want", [(6, True), (5, False)])
def test_coverage_threshold(spark, found, want):
    evidence = "a b c d e f g" if found == 6 else "a b c d e f"
    chunk = " ".join(evidence.split()[:found]) + " zz" if found == 6 else "e d c b a zz"
    assert one(spark, text.contains_or_covers, chunk, evidence) is want


def test_coverage_counts_repeats(spark):
    # Six of seven tokens are "a": present six times over.
    assert one(spark, text.contains_or_covers, "a", "a a a a a a b") is True
    assert one(spark, text.contains_or_covers, "b", "a a a a a a b") is False


def test_empty_evidence_is_everywhere_but_bare_punctuation_is_not(spark):
    assert one(spark, text.contains_or_covers, "anything", "") is True
    assert one(spark, text.contains_or_covers, "anything", "?!") is False


def test_token_f1_divides_by_list_lengths(spark):
    assert one(spark, text.token_f1, "the cat the", "the cat") == pytest.approx(0.8)
    assert one(spark, text.token_f1, "", "x") == 0.0


def test_context_drops_time_prefixes_and_empty_lines(spark):
    chunks = ["2023-01-15 14:30: hi\n\n  there ", "next", "never"]
    assert one(spark, lambda c: text.build_context(c, 2), chunks) == "hi\nthere\nnext"


@pytest.mark.parametrize(
    "reply, want",
    [
        ("<think>x</think> Paris", "Paris"),
        ("Paris <think>x", "Paris"),
        ("<b></b>", "N/A"),
        ("<i>Rome</i>\n", "Rome"),
        ("a</think>b", "ab"),
    ],
)
def test_clean_answer(spark, reply, want):
    assert one(spark, text.clean_answer, reply) == want


@pytest.mark.parametrize(
    "reply", ['x\n```json\n{"a": 1}\n```\ny', '```\n{"a": 1}\n```', '{"a": 1}', '```json\n{"a": 1}']
)
def test_code_fence(spark, reply):
    assert json.loads(one(spark, text.strip_code_fence, reply)) == {"a": 1}


@pytest.mark.parametrize(
    "stored, want",
    [
        ('["test", "memory"]', ["test", "memory"]),
        ('{"key": "value"}', {"key": "value"}),
        ("42", 42),
        ("3.14", 3.14),
        ("-10", -10),
        ("hello", "hello"),
        ('say "hi"', 'say "hi"'),
    ],
)
def test_metadata_decoding(spark, stored, want):
    assert json.loads(one(spark, lambda c: F.to_json(metadata.decode_value(c)), stored)) == want


def test_metadata_round_trip(spark):
    df = spark.createDataFrame(
        [(["a", "b"], {"k": "v"}, 42, 0.95, "2024-01-01T00:00:00", None)],
        "tags array<string>, config map<string,string>, count int, score double, timestamp string, gone string",
    ).select(F.struct("*").alias("m"))
    kind = df.schema["m"].dataType
    encoded = df.select(metadata.encode_metadata(F.col("m"), kind).alias("e"))
    row = encoded.select(
        "e", F.to_json(metadata.decode_metadata(F.col("e"))).alias("d")
    ).first()
    assert row.e["tags"] == '["a","b"]' and row.e["count"] == "42" and "gone" not in row.e
    assert json.loads(row.d)["config"] == {"k": "v"} and json.loads(row.d)["score"] == 0.95


def test_note_defaults_and_ids(spark):
    df = spark.createDataFrame([("c", 0, "hi", ""), ("c", 1, "hi", "ctx")], "conv_id string, seq int, content string, context string")
    rows = notes_ops.note_defaults(df).orderBy("seq").collect()
    assert [r.context for r in rows] == ["General", "ctx"]
    assert rows[0].category == "Uncategorized" and rows[0].links == [] and rows[0].retrieval_count == 0
    assert len(rows[0].timestamp) == 12 and rows[0].id != rows[1].id
    again = notes_ops.note_defaults(df).orderBy("seq").collect()
    assert [r.id for r in again] == [r.id for r in rows]


def test_times(spark):
    got = one(spark, lambda c: text.parse_time(c).cast("string"), "202301151430")
    assert got == "2023-01-15 14:30:00"
    assert one(spark, text.parse_time, "1:56 pm on 8 May, 2023") is None


@pytest.mark.parametrize(
    "word, stem",
    [
        ("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("plastered", "plaster"),
        ("motoring", "motor"), ("conflated", "conflat"), ("hopping", "hop"), ("falling", "fall"),
        ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"),
        ("conditional", "condit"), ("vietnamization", "vietnam"), ("formalize", "formal"),
        ("electrical", "electr"), ("goodness", "good"), ("revival", "reviv"), ("adjustment", "adjust"),
        ("adoption", "adopt"), ("probate", "probat"), ("rate", "rate"), ("controll", "control"),
        ("dies", "die"), ("died", "die"), ("cried", "cri"), ("enjoy", "enjoy"), ("dying", "die"),
        ("hopefully", "hope"), ("analogy", "analog"), ("generalization", "gener"), ("oscillators", "oscil"),
    ],
)
def test_porter_stems(word, stem):
    assert porter_stem(word) == stem
