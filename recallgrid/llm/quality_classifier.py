"""Document quality by histogram gradient-boosted trees over text statistics.

Statistics of whole texts are computed once, in Arrow batches, and written as a
narrow table.  Trees are fitted by logistic loss on binned statistics of at
most ``fit_rows`` labelled rows (those with the least id hashes), which is the
only thing that reaches the driver.  A fitted model is a few flat arrays:
complete trees of one depth, walked by all rows of a batch at once.

A null text counts as empty and is scored too; repeated rows are scored each;
labels repeated for an id count by their mean, null labels not at all; without
labels of both kinds the score is the mean label (0.5 without any); an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallgrid.llm.tables import stage
from recallgrid.llm.worker import id_type, map_batches, texts_of

FIT_ROWS = 20_000
HASHES = 1 << 40
ROUNDS, DEPTH, RATE, BINS, LEAST = 120, 4, 0.1, 64, 20.0
FOLDS, HELD = 4, 2
BAR = 0.7
BLOCK = 4_096  # bytes that are compressed on their own, throughout the text

GROUPS = {
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "space": b" \t\r\n",
    "stop": b".!?",
    "comma": b",;:",
    "quote": b"\"'()",
    "mark": b"#*$%&|<>{}[]=_/\\@~^`+",
}
CLASS = np.full(256, len(GROUPS), np.int64)
for _n, _members in enumerate(GROUPS.values()):
    CLASS[list(_members)] = _n
CLASS[128:] = len(GROUPS) + 1
WIDTH = len(GROUPS) + 2 + 14


def statistics(text: str) -> list[float]:
    """Shares of byte classes, and figures of words and lines."""
    raw = text.encode("utf-8", "surrogatepass")
    if not raw.strip():
        return [0.0] * WIDTH
    shares = np.bincount(CLASS[np.frombuffer(raw, np.uint8)], minlength=len(GROUPS) + 2) / len(raw)
    words = raw.split()
    n = len(words)
    sizes = np.fromiter(map(len, words), np.int64, n)
    distinct = len(set(words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    line_sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    pairs = len(set(zip(words, words[1:], strict=False)))
    packed = sum(len(zlib.compress(raw[i : i + BLOCK], 1)) for i in range(0, len(raw), BLOCK))
    return [
        *shares.tolist(),
        np.log1p(len(raw)),
        np.log1p(n),
        sizes.mean(),
        sizes.std(),
        float(sizes.max()),
        (sizes <= 3).mean(),
        distinct / n,
        pairs / max(1, n - 1),
        np.log1p(len(lines)),
        line_sizes.mean(),
        len(set(lines)) / len(lines),
        sum(x.rstrip()[-1:] in b".!?" for x in lines) / len(lines),
        len(zlib.compress(raw, 1)) / len(raw),
        packed / len(raw),
    ]


@dataclass
class Forest:
    """Complete trees: node i has the children 2i+1 and 2i+2; a row goes right above the threshold."""

    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    value: np.ndarray  # trees x leaves
    start: float

    def scores(self, rows: np.ndarray) -> np.ndarray:
        total = np.full(len(rows), self.start)
        inner = self.feature.shape[1]
        every = np.arange(len(rows))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(rows), np.int64)
            while inner and node[:1].size and node[0] < inner:
                node = 2 * node + 1 + (rows[every, feature[node]] > threshold[node])
            total += value[node - inner]
        return 1 / (1 + np.exp(-total))


def best_splits(binned: np.ndarray, node: np.ndarray, nodes: int, grad: np.ndarray, hess: np.ndarray) -> tuple:
    """(feature, bin) of the best split of each node from its gradient histograms; bin BINS: none."""
    best = np.zeros(nodes)
    feature, cut = np.zeros(nodes, np.int64), np.full(nodes, BINS)
    for f in range(binned.shape[1]):
        cell = node * BINS + binned[:, f]
        g = np.bincount(cell, grad, nodes * BINS).reshape(nodes, BINS).cumsum(axis=1)
        h = np.bincount(cell, hess, nodes * BINS).reshape(nodes, BINS).cumsum(axis=1)
        all_g, all_h = g[:, -1:], h[:, -1:]
        gain = g**2 / (h + 1) + (all_g - g) ** 2 / (all_h - h + 1) - all_g**2 / (all_h + 1)
        gain[(h < LEAST / 4) | (all_h - h < LEAST / 4)] = 0
        at = gain.argmax(axis=1)
        value = gain[np.arange(nodes), at]
        better = value > best + 1e-9
        best[better], feature[better], cut[better] = value[better], f, at[better]
    return feature, cut


def fit(rows: np.ndarray, labels: np.ndarray) -> Forest:
    mean = labels.mean() if len(labels) else 0.5
    none = np.zeros((0, 0))
    if not len(labels) or mean in (0.0, 1.0):
        start = 0.0 if not len(labels) else (40.0 if mean else -40.0)
        return Forest(none, none, none, start)
    edges = [np.unique(np.quantile(rows[:, f], np.arange(1, BINS) / BINS)) for f in range(rows.shape[1])]
    binned = np.stack([np.searchsorted(e, rows[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    start = float(np.log(mean / (1 - mean)))
    total = np.full(len(labels), start)
    features, thresholds, values = [], [], []
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-total))
        grad, hess = p - labels, p * (1 - p)
        node = np.zeros(len(labels), np.int64)
        feature, threshold = [], []
        for level in range(DEPTH):
            own, cut = best_splits(binned, node, 2**level, grad, hess)
            feature += own.tolist()
            threshold += [edges[f][c] if c < len(edges[f]) else np.inf for f, c in zip(own, cut, strict=True)]
            node = 2 * node + (binned[np.arange(len(node)), own[node]] > cut[node])
        g, h = np.bincount(node, grad, 2**DEPTH), np.bincount(node, hess, 2**DEPTH)
        value = -RATE * g / (h + 1)
        total += value[node]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Forest(np.array(features), np.array(thresholds), np.array(values), start)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD, F.lit(False))


def quality(
    documents: DataFrame,
    labels: DataFrame,
    fit_rows: int = FIT_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    own = id_type(documents, id_col)

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = np.array([statistics(t) for t in batch["text"].to_pylist()], np.float64)
        packed = pa.FixedSizeListArray.from_arrays(pa.array(made.ravel()), WIDTH).cast(pa.list_(pa.float64()))
        return pa.record_batch([batch["doc_id"], packed], ["doc_id", "stats"])

    narrow = map_batches(texts_of(documents, id_col, text_col), measure, f"doc_id {own}, stats array<double>")
    measured = stage(narrow, "statistics")
    known = (
        labels.select(F.col("doc_id"), F.col(label_col).cast("double").alias("label"))
        .filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    )
    labelled = stage(measured.join(known, "doc_id"), "labelled")
    # The least hashes, in two steps: a share that surely holds fit_rows, then the exact ones, merged in one small task.
    order = F.pmod(F.xxhash64("doc_id"), F.lit(HASHES))
    share = min(1.0, (1.25 * fit_rows + 1_000) / max(1, labelled.count()))
    near = labelled.filter(order <= int(share * HASHES))
    taught = stage(near.orderBy(order, "doc_id", "stats").limit(fit_rows).select("stats", "label"), "taught")
    rows = taught.collect()  # at most fit_rows
    forest = fit(np.array([r["stats"] for r in rows], np.float64).reshape(-1, WIDTH), np.array([r["label"] for r in rows], np.float64))

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        stats = batch["stats"].flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH)
        return pa.record_batch([batch["doc_id"], pa.array(forest.scores(stats))], ["doc_id", "score"])

    scored = map_batches(measured, score, f"doc_id {own}, score double")
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= BAR).cast("int").alias("predicted"),
    )
