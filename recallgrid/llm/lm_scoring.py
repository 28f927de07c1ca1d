"""Language-model scores of whole documents.

Every training document is counted: tokens are summed per task, then by word.
The ``keep`` most frequent words travel to the tasks; what a document has
beyond them goes through a join with the counts.  A gated recurrent model
(``gated_model``) has every word that is counted at least ``least_count`` times
(or the ``model_words`` most frequent ones), so its vocabulary grows with the
corpus, and one word for all others, whose probability is shared out by count
plus one.  It is trained
on all training documents, or on ``share`` of them by hash, by truncated backpropagation in
tasks (``lanes`` at least, more as there are more tokens) whose parameters are
summed in groups and then averaged; counts and statistics cover all of them.
Documents are scored whole, states being carried from window to window.

A null or empty text is its end token alone; a null doc_id has no remainder and
so is learned from; repeated rows are counted and scored each;
without training rows counts are zero; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallgrid.llm import gated_model as gm
from recallgrid.llm.tables import stage
from recallgrid.llm.worker import id_type, texts_of

FOLDS, HELD = 7, 2
KEEP = 100_000
LEAST = 5  # words seen less often have too few examples to be told apart
LANES = 1
LANE_TOKENS = 4_000_000  # tokens aimed at in a lane, or so many for every word of the model
WORD_TOKENS = 128
PART = 262_144  # parameters summed at a time
STREAMS = 2_048
FLUSH = 1_000_000  # tokens held at a time in training, and
SIDE_BY_SIDE = 2_000_000  # in scoring, where a step costs less a token the more documents there are
WORDS_HELD = 100_000  # distinct words a task counts before it hands them on, and
GROUP = 1_024  # rows of a batch taken apart together
END_WORD = ""  # no word is empty


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD, F.lit(False))


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, GROUP):
            yield batch.slice(at, GROUP)


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased words of all texts in a row, and how many each text has."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.string())))
    found = split.flatten()
    real = pc.not_equal(pc.binary_length(found), 0)  # none lies before, after or between spaces
    own = pc.list_parent_indices(split).filter(real).to_numpy(zero_copy_only=False)
    return found.filter(real), np.bincount(own, minlength=len(texts))


def numbers(found: pa.Array, among: pa.Array) -> np.ndarray:
    """Each word's place ``among`` distinct ones, or -1."""
    return pc.fill_null(pc.index_in(found, value_set=among), -1).to_numpy(zero_copy_only=False)


def least_count(total: int) -> int:
    """How often a word of the model occurs: the root of the tokens over 64, so words grow with about the root."""
    return max(LEAST, math.ceil(math.sqrt(total) / 64))


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n), handed on whenever many words are held."""
    held: list[pa.Table] = []

    def rows() -> pa.RecordBatch:
        return pa.record_batch([c.combine_chunks() for c in held[0].columns], ["word", "n"])

    def merge() -> None:
        summed = pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")])
        held[:] = [summed.select(["word", "n_sum"]).rename_columns(["word", "n"])]

    for batch in slices(batches):
        found = words(batch["text"])[0].value_counts()
        held.append(pa.table([found.field(0), found.field(1)], ["word", "n"]))
        held.append(pa.table([pa.array([END_WORD]), pa.array([batch.num_rows], pa.int64())], ["word", "n"]))
        if sum(t.num_rows for t in held) > WORDS_HELD:
            merge()
            if held[0].num_rows > WORDS_HELD:
                yield rows()
                held.clear()
    if held:
        merge()
        yield rows()


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) over all rows of ``docs``, with the end of each document as the empty word."""
    parts = docs.select("text").mapInArrow(counted, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """Model ids and counts of the frequent words."""

    def __init__(self, frequent: list[tuple[str, int]], total: int, distinct: int, model_words: int):
        counts = dict(frequent)
        self.total, self.distinct = total, distinct
        named = [w for w, _ in frequent if w != END_WORD][: model_words - 2]
        self.model = [w.encode() for w in named]  # from id 2 on
        self.named = pa.array(named, pa.string())
        inside = [counts.get(END_WORD, 0), 0, *[counts[w] for w in named]]
        self.tail_total = total - sum(inside) + distinct - (len(named) + (END_WORD in counts)) + 1
        inside[gm.RARE] = self.tail_total
        self.frequency = np.array(inside, np.float64)
        self.end_count = counts.get(END_WORD, 0)

    def ids(self, place: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Model ids of documents in a row, each closed by END, from their words' places among the frequent ones."""
        made = np.full(len(place) + len(sizes), gm.END, np.int32)
        at = np.arange(len(place)) + np.repeat(np.arange(len(sizes)), sizes)
        made[at] = np.where(place < len(self.named), place + 2, gm.RARE)  # no place is -1, and RARE is 1
        return made


def train(docs: DataFrame, vocabulary: Vocabulary, lanes: int, share: float) -> dict[str, np.ndarray]:
    """Averaged parameters of at least ``lanes`` tasks; each reads its part of ``share`` of the documents."""
    first = gm.start(vocabulary.frequency)
    size = max(LANE_TOKENS, WORD_TOKENS * len(vocabulary.frequency))
    lanes = max(lanes, math.ceil(share * vocabulary.total / size))
    trained = [k for k in first if k not in gm.FIXED]
    chosen = docs.withColumn("mark", F.xxhash64("doc_id", "text"))
    if share < 1:
        chosen = chosen.filter(F.pmod("mark", F.lit(1 << 20)) < int(share * (1 << 20)))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found, sizes = words(batch["text"])
            ids = vocabulary.ids(numbers(found, vocabulary.named), sizes).astype("<u4")
            ends = np.concatenate(([0], np.cumsum(4 * (sizes + 1)))).astype(np.int32)
            coded = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(ids)])
            yield pa.record_batch([batch["mark"], coded], ["mark", "ids"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer, held, size = gm.Trainer(first, streams=STREAMS), [], 0
        for batch in slices(batches):
            for ids in batch["ids"].to_pylist():
                held.append(ids)
                size += len(ids) // 4
                if size >= FLUSH:
                    trainer.learn(np.frombuffer(b"".join(held), "<u4").astype(np.int64))
                    held, size = [], 0
        if held:
            trainer.learn(np.frombuffer(b"".join(held), "<u4").astype(np.int64))
        if trainer.tokens:
            flat = np.concatenate([trainer.p[k].ravel() for k in trained])
            for part, at in enumerate(range(0, len(flat), PART)):
                yield packed(part, TaskContext.get().partitionId(), flat[at : at + PART], trainer.tokens)

    def packed(part: int, lane: int, values: np.ndarray, tokens: int) -> pa.RecordBatch:
        columns = [pa.array([x], t) for x, t in ((part, pa.int64()), (lane, pa.int64()), (values.tobytes(), pa.binary()), (tokens, pa.int64()))]
        return pa.record_batch(columns, ["part", "lane", "model", "tokens"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The average of each part, weighted by tokens; lanes of a part come in a row."""
        rows = (r for b in batches for r in zip(*(b[k].to_pylist() for k in ("part", "model", "tokens")), strict=True))
        for part, own in groupby(rows, itemgetter(0)):
            total, tokens = 0.0, 0
            for _, values, n in own:
                total, tokens = total + np.frombuffer(values, "<f4").astype(np.float64) * n, tokens + n
            yield packed(part, -1, (total / tokens).astype("<f4"), tokens)

    coded = chosen.select("mark", "text").mapInArrow(encode, "mark long, ids binary")
    # one lane a task, as each task writes a whole model
    lane = F.pmod(F.hash("mark"), F.lit(lanes)).cast("int")
    dealt = coded.withColumn("lane", lane).repartitionById(lanes, "lane").drop("lane").sortWithinPartitions("mark", "ids")
    schema = "part long, lane long, model binary, tokens long"
    made = stage(dealt.mapInArrow(learn, schema), "lanes")
    parts = -(-sum(first[k].size for k in trained) // PART)
    grouped = made.repartition(parts, "part").sortWithinPartitions("part", "lane")
    sums = stage(grouped.mapInArrow(merge, schema), "lane-sums")
    done = {row["part"]: row["model"] for row in sums.toLocalIterator()}
    if not done:
        return first
    flat = np.frombuffer(b"".join(done[k] for k in sorted(done)), "<f4")
    cuts = np.cumsum([first[k].size for k in trained])[:-1]
    return first | {k: v.reshape(first[k].shape) for k, v in zip(trained, np.split(flat, cuts), strict=True)}


def score_documents(
    df: DataFrame,
    keep: int = KEEP,
    model_words: int | None = None,
    lanes: int = LANES,
    share: float = 1.0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10)."""
    own = id_type(df, id_col)
    docs = texts_of(df, id_col, text_col)
    taught = docs.filter(~held_out(F.col("doc_id")))
    counts = stage(count_words(taught), "word-counts")
    total, distinct = counts.agg(F.sum("n"), F.count("*")).first()
    total = total or 0
    if model_words is None:
        model_words = 2 + counts.filter((F.col("word") != END_WORD) & (F.col("n") >= least_count(total))).count()
        keep = max(keep, model_words)
    # the end of a document, which every text needs, and at most keep other words
    ends = counts.filter(F.col("word") == END_WORD)
    frequent = counts.filter(F.col("word") != END_WORD).orderBy(F.desc("n"), "word").limit(keep)
    frequent = [(r["word"], r["n"]) for r in ends.union(frequent).collect()]
    vocabulary = Vocabulary(frequent, total, distinct, model_words)
    model = train(taught, vocabulary, lanes, share)
    log_unit = float(np.log10(total + distinct + 1))
    tail_unit = float(np.log10(vocabulary.tail_total))
    # what a word adds: its base term, and nothing if it isn't frequent
    known = pa.array([w for w, _ in frequent if w != END_WORD], pa.string())
    terms = np.log10(np.array([n for w, n in frequent if w != END_WORD] + [0], np.float64) + 1)
    del frequent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = float(np.log10(vocabulary.end_count + 1))
        number = TaskContext.get().partitionId() << 33

        def part(batch: pa.RecordBatch) -> tuple:
            """Of each document: id, tokens, frequent ones, base terms, what is added to the model's score, other words; and all ids."""
            found, sizes = words(batch["text"])
            place = numbers(found, known)
            own, n = np.repeat(np.arange(len(sizes)), sizes), len(sizes)
            other, rare = place < 0, (place < 0) | (place >= len(vocabulary.named))
            others = np.bincount(own[other], minlength=n)
            base = np.bincount(own, terms[place], n) + end
            shared = np.bincount(own[rare], terms[place[rare]] - tail_unit, n)
            ends = np.concatenate(([0], np.cumsum(others))).astype(np.int32)
            rest = pa.ListArray.from_arrays(pa.array(ends), found.filter(pa.array(other)))
            known_n = sizes - others + (vocabulary.end_count > 0)
            doc_id = batch["doc_id"].take(pa.array(np.arange(n)))  # a copy, as the batch's own column holds on to its texts
            return doc_id, sizes + 1, known_n, base, shared, rest, vocabulary.ids(place, sizes)

        def flush(held: list[tuple]) -> pa.RecordBatch:
            nonlocal number
            doc_id, sizes, known_n, base, shared, rest, ids = zip(*held, strict=True)
            sizes, known_n, base, shared, ids = map(np.concatenate, (sizes, known_n, base, shared, ids))
            logs = gm.score(model, ids, sizes) / np.log(10)
            columns = [
                pa.array(range(number, number + len(sizes)), pa.int64()),
                pa.concat_arrays(doc_id),
                pa.array(sizes, pa.int64()),
                pa.array(known_n, pa.int64()),
                pa.array(base),
                pa.array(logs + shared),
                pa.concat_arrays(rest),
            ]
            number += len(sizes)
            return pa.record_batch(columns, names)

        names = ["row", "doc_id", "n_tokens", "n_frequent", "base", "model", "rest"]
        held, tokens = [], 0
        for batch in slices(batches):
            held.append(part(batch))
            tokens += len(held[-1][-1])
            if tokens >= SIDE_BY_SIDE:
                yield flush(held)
                held, tokens = [], 0
        if held:
            yield flush(held)

    schema = f"row long, doc_id {own}, n_tokens long, n_frequent long, base double, model double, rest array<string>"
    scored = stage(docs.mapInArrow(run, schema), "scored")
    # Tokens beyond the frequent words: their counts come by join; an unseen word adds log10(1) = 0.
    rest = scored.select("row", F.explode("rest").alias("word"))
    met = rest.join(counts, "word").groupBy("row").agg(F.count("*").alias("seen"), F.sum(F.log10(F.col("n") + 1)).alias("more"))
    more, seen = F.coalesce("more", F.lit(0.0)), F.coalesce("seen", F.lit(0))
    return scored.drop("rest").join(met, "row", "left").select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        (F.col("n_frequent") + seen).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * F.lit(log_unit)).alias("base_score"),
        (F.col("model") + more).alias("score"),
    )
