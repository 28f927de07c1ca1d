"""Removal of byte strings that stand earlier in the corpus, by families of suffix arrays.

Every window of 100 bytes that also starts earlier (in a document before, or
further up in the same one) is removed; windows may overlap.

1. Documents are packed in blocks of bounded size.  In each, windows that share
   their least 20-byte hash are one record: equal windows always fall in records
   of the same anchor.  Records repeated inside a block are marked at once.
2. Records of an anchor that stands once in the corpus can't match and go no
   further.  The others meet in shards by anchor, in document order.  Equal
   records are known by their hash and collapse; different ones under one anchor
   bring their bytes, and a logarithmic family of suffix arrays (``Family``) finds
   which of their windows the shard has seen.  Batches and levels are bounded by
   the shard, and shards grow in number with the corpus.
3. Blocks collect their marked windows and cut the texts.

An anchor that heads very many records (a phrase that a large part of all pages
share, each going on in its own way) is found on a sample and goes window by
window, each under its own hash, so no shard holds them all.  The sample decides
where windows meet, not what is found.

Documents count in order of their id, null ids last; rows of one id in order of
their texts' hashes, and of repeated rows any one is the first.  Null and empty
texts have no bytes; texts under 100 bytes lose nothing.  An empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recallgrid.llm.suffix_family import Family
from recallgrid.llm.tables import stage
from recallgrid.llm.worker import id_type, texts_of

WIDTH = 100
GRAM = 20  # bytes of an anchor: 16 + 4
BLOCK = 1 << 24  # bytes of a block, unless one text alone has more
STRIPE = 1 << 20  # bytes hashed at a time
SHARD = 1 << 24  # bytes of the corpus for each shard of anchors
BATCH = 32_768  # windows of a batch
TASKS = 20_000
SAMPLED = 32  # one document of so many shows which anchors are frequent
FREQUENT = 2_000  # an anchor that heads more than one of so many records goes window by window
TIES = 1 << 16  # rows of one id go by so much of their texts' hashes, then by place
RECORD, SPAN = 0, 1

_rng = np.random.default_rng(11)
LETTERS = _rng.integers(0, 1 << 64, 256, np.uint64)
STEPS = _rng.integers(0, 1 << 63, 5, np.uint64) * np.uint64(2) + np.uint64(1)


# Anchors


def gram_hashes(octets: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the 20 bytes from each place on."""
    held = {1: LETTERS[octets]}
    for step, size in enumerate((1, 2, 4, 8)):
        last = held[size]
        held[2 * size] = last[:-size] * STEPS[step] + last[size:]
    both = held[16][:-4] * STEPS[4] + held[4][16:]
    both ^= both >> np.uint64(31)
    both *= np.uint64(0x9E3779B97F4A7C15)
    both ^= both >> np.uint64(29)
    return both


def least_places(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each window, the place of its least hash (upper half), the leftmost of equal ones."""
    keys = hashes >> np.uint64(32) << np.uint64(32) | np.arange(len(hashes), dtype=np.uint64)
    span, size = width - GRAM + 1, 1
    while 2 * size <= span:
        keys = np.minimum(keys[:-size], keys[size:])
        size *= 2
    if size < span:
        keys = np.minimum(keys[: len(keys) - (span - size)], keys[span - size :])
    return (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)


def records(octets: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, anchor's hash) of every record of documents that lie in a row."""
    if len(octets) < width:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    hashes = gram_hashes(octets)
    place = least_places(hashes, width)
    count = np.diff(ends, prepend=0)
    own = np.repeat(ends, count)[: len(place)]
    inside = np.flatnonzero(np.arange(len(place)) + width <= own)
    if not len(inside):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    # Windows of one document never share a place with those of the next, which start beyond it.
    head = np.concatenate([[True], (np.diff(inside) > 1) | (np.diff(place[inside]) != 0)])
    at = np.flatnonzero(head)
    return inside[at], np.diff(at, append=len(inside)), hashes[place[inside[at]]]


def block_records(raw: bytes, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``records`` of a whole block, some documents at a time."""
    octets = np.frombuffer(raw, np.uint8)
    found, first, at = [], 0, 0
    while first < len(ends):
        last = max(first + 1, int(np.searchsorted(ends, at + STRIPE, side="right")))
        starts, sizes, hashes = records(octets[at : ends[last - 1]], ends[first:last] - at, width)
        found.append((starts + at, sizes, hashes))
        first, at = last, int(ends[last - 1])
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def signed(values) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def marked(raw: bytes, ends: np.ndarray, frequent: frozenset, width: int) -> tuple[np.ndarray, ...]:
    """(start, size, hash, content hash) of the block's distinct records, and (start, end) of repeated windows."""
    starts, sizes, hashes = block_records(raw, ends, width)
    if frequent:
        apart = np.isin(hashes, np.array(sorted(frequent), np.uint64))
        if apart.any():
            each = np.repeat(starts[apart] - np.cumsum(sizes[apart]) + sizes[apart], sizes[apart]) + np.arange(sizes[apart].sum())
            own = np.array([xxhash.xxh3_64_intdigest(raw[s : s + width], 1) for s in each.tolist()], np.uint64)
            starts = np.concatenate([starts[~apart], each])
            sizes = np.concatenate([sizes[~apart], np.ones(len(each), np.int64)])
            hashes = np.concatenate([hashes[~apart], own])
    digest, tail = xxhash.xxh3_64_intdigest, width - 1
    content = [digest(raw[s : s + n + tail]) for s, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
    content = np.array(content, np.uint64) >> np.uint64(16)  # 48 bits beside the anchor's 64
    order = np.lexsort((starts, content, hashes))
    starts, sizes, hashes, content = starts[order], sizes[order], hashes[order], content[order]
    again = np.zeros(len(starts), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (content[1:] == content[:-1])
    spans = merged(starts[again], starts[again] + sizes[again])
    return starts[~again], sizes[~again], hashes[~again], content[~again], *spans


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of windows that follow each other as one."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], ends[order]
    if not len(starts):
        return starts, ends
    reach = np.maximum.accumulate(ends)
    head = np.concatenate([[True], starts[1:] > reach[:-1]])
    at = np.flatnonzero(head)
    return starts[at], reach[np.concatenate([at[1:], [len(starts)]]) - 1]


# Blocks


def blocks(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, size: int | None = None) -> DataFrame:
    """One row for every block: its documents in order, their bytes packed, and the anchors of some of them."""
    own, limit = id_type(df, id_col), size or BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, length, kind = TaskContext.get().partitionId() << 20, [], 0, pa.int64()

        def record() -> pa.RecordBatch:
            held.sort(key=lambda d: (d[0] is None, 0 if d[0] is None else d[0], d[1]))
            raw = b"".join(d[2] for d in held)
            seen: list = []
            for _, tie, octets in held:
                if tie % SAMPLED == 0:
                    seen.append(np.unique(block_records(octets, np.array([len(octets)]), width)[2]))
            columns = {
                "block": pa.array([number], pa.int64()),
                "doc_ids": pa.array([[d[0] for d in held]], pa.list_(kind)),
                "ties": pa.array([[d[1] for d in held]], pa.list_(pa.int64())),
                "sizes": pa.array([[len(d[2]) for d in held]], pa.list_(pa.int64())),
                "raw": pa.array([packer().compress(raw)], pa.binary()),
                "sampled": pa.array([signed(np.concatenate([np.zeros(0, np.uint64), *seen])).tolist()], pa.list_(pa.int64())),
            }
            return pa.record_batch(list(columns.values()), list(columns))

        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                octets = text.encode("utf-8", "surrogatepass")
                if held and length + len(octets) > limit:
                    yield record()
                    number, held, length = number + 1, [], 0
                held.append((doc_id, xxhash.xxh3_64_intdigest(octets) % TIES, octets))
                length += len(octets)
        if held:
            yield record()

    schema = f"block long, doc_ids array<{own}>, ties array<long>, sizes array<long>, raw binary, sampled array<long>"
    return texts_of(df, id_col, text_col).mapInArrow(run, schema)


def packer() -> zstandard.ZstdCompressor:
    """Looks for matches over a whole block: blocks are written once and shuffled twice."""
    return zstandard.ZstdCompressor(compression_params=zstandard.ZstdCompressionParameters.from_level(9, window_log=24, enable_ldm=True))


def frequent_anchors(packed: DataFrame) -> frozenset[int]:
    """Anchors of a good share of the sampled records: by that share, at most 2,000."""
    seen = packed.select(F.explode("sampled").alias("h"))
    total = seen.count()
    rows = seen.groupBy("h").count().filter(F.col("count") > max(32, total // FREQUENT)).collect()
    return frozenset(r["h"] % (1 << 64) for r in rows)


def unpacked(raw: pa.Scalar, sizes) -> tuple[bytes, np.ndarray]:
    return zstandard.decompress(raw.as_py()), np.cumsum(np.array(sizes.as_py(), np.int64))


def repeated_records(packed: DataFrame, frequent: frozenset[int], width: int = WIDTH) -> DataFrame:
    """block, at, h, about and other: records whose anchor other blocks hold, too, and a block's own repeats.

    ``other`` says that the anchor heads different records, and that this is the
    one of several equal ones that is to bring the bytes.  ``h`` of a repeat is
    the end of its windows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = batch["block"][i].as_py()
                raw, ends = unpacked(batch["raw"][i], batch["sizes"][i])
                starts, sizes, hashes, content, first, last = marked(raw, ends, frequent, width)
                about = content.astype(np.int64) << 9 | sizes << 2 | RECORD
                yield pa.record_batch(
                    [
                        pa.array(np.full(len(starts) + len(first), block)),
                        pa.array(np.concatenate([starts, first])),
                        pa.array(np.concatenate([signed(hashes), last])),
                        pa.array(np.concatenate([about, np.full(len(first), SPAN)])),
                    ],
                    ["block", "at", "h", "about"],
                )

    made = packed.select("block", "sizes", "raw").mapInArrow(run, "block long, at long, h long, about long")
    anchor, equal = Window.partitionBy("h"), Window.partitionBy("h", "about")
    # A block has a record once, so its number tells equal ones apart.
    counted = made.withColumn("least", F.min("block").over(equal)).select(
        "block",
        "at",
        "h",
        "about",
        F.count("*").over(anchor).alias("n"),
        ((F.min("about").over(anchor) != F.max("about").over(anchor)) & (F.col("least") == F.col("block"))).alias("other"),
    )
    span = F.col("about") == SPAN
    return counted.filter(span | (F.col("n") > 1)).drop("n")


# Matches


def with_bytes(packed: DataFrame, repeated: DataFrame, shards: int, width: int = WIDTH) -> DataFrame:
    """Records with their document's place in order, and their bytes if they need them."""
    own = packed.schema["doc_ids"].dataType.elementType.simpleString()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        raw, ends = unpacked(left["raw"][0], left["sizes"][0])
        at, about, h = (right[c].to_numpy() for c in ("at", "about", "h"))
        doc = np.searchsorted(ends, at, side="right")
        size = about >> 2 & 127
        wanted = right["other"].to_numpy() & (about != SPAN)
        contents = [raw[s : s + n + width - 1] if w else None for s, n, w in zip(at.tolist(), size.tolist(), wanted.tolist(), strict=True)]
        shard = np.where(about == SPAN, at, h) % shards
        ids = left["doc_ids"].combine_chunks().flatten().take(pa.array(doc))
        ties = left["ties"].combine_chunks().flatten().take(pa.array(doc))
        return pa.table(
            [pa.array(shard), ids, ties, right["block"], right["at"], right["h"], right["about"], pa.array(contents, pa.binary())],
            ["shard", "doc_id", "tie", "block", "at", "h", "about", "content"],
        )

    schema = f"shard long, doc_id {own}, tie long, block long, at long, h long, about long, content binary"
    left = packed.select("block", "doc_ids", "ties", "sizes", "raw").groupBy("block")
    return left.cogroup(repeated.groupBy("block")).applyInArrow(_if_any(run, schema), schema)


def _if_any(work, schema: str):
    """``work`` on blocks that have rows on the right; none for the others."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return work(left, right) if right.num_rows else _empty(left)

    def _empty(left: pa.Table) -> pa.Table:
        kind = left.schema.field("doc_ids").type.value_type
        long, names = pa.int64(), ["shard", "doc_id", "tie", "block", "at", "h", "about", "content"]
        return pa.table([pa.array([], k) for k in (long, kind, long, long, long, long, long, pa.binary())], names)

    return run


class Shard:
    """Records of a shard: collected, then looked through in document order."""

    def __init__(self, width: int):
        self.width = width
        self.rows: list[tuple[int, int, int, int]] = []
        self.contents: dict[tuple[int, int], bytes] = {}

    def add(self, block: int, at: int, h: int, about: int, content: bytes | None) -> None:
        self.rows.append((block, at, h, about))
        if content is not None:
            self.contents[h, about] = content

    def removed(self) -> list[tuple[int, int, int]]:
        """What stands earlier: (block, first window, end)."""
        family, known = Family(self.width), set()
        made: list[tuple[int, int, int]] = []
        waiting: list[tuple[int, int, bytes]] = []
        windows = 0

        def settle() -> None:
            for (block, at, _), earlier in zip(waiting, family.add([w[2] for w in waiting]), strict=True):
                edges = np.flatnonzero(np.diff(np.concatenate([[0], earlier.view(np.int8), [0]])))
                made.extend((block, at + a, at + b) for a, b in edges.reshape(-1, 2).tolist())

        for block, at, h, about in self.rows:
            size = about >> 2 & 127
            if about == SPAN:
                made.append((block, at, h))
            elif (h, about) in known:
                made.append((block, at, at + size))
            else:
                known.add((h, about))
                if (h, about) in self.contents:
                    waiting.append((block, at, self.contents[h, about]))
                    windows += size
                    if windows >= BATCH:
                        settle()
                        waiting, windows = [], 0
        if waiting:
            settle()
        return made


def removed_windows(records: DataFrame, shards: int, width: int = WIDTH) -> DataFrame:
    """block, first and last (exclusive) of windows that stand earlier."""
    order = [F.col("shard"), F.col("doc_id").asc_nulls_last(), F.col("tie"), F.col("block"), F.col("at")]
    dealt = records.repartition(min(shards, TASKS), "shard").sortWithinPartitions(*order)
    names = ["block", "at", "h", "about", "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard = None, None
        for batch in batches:
            for own, *row in zip(batch["shard"].to_pylist(), *(batch[c].to_pylist() for c in names), strict=True):
                if own != number:
                    if shard:
                        yield as_spans(shard.removed())
                    number, shard = own, Shard(width)
                shard.add(*row)
        if shard:
            yield as_spans(shard.removed())

    return dealt.select("shard", *names).mapInArrow(run, "block long, first long, last long")


def as_spans(found: list[tuple[int, int, int]]) -> pa.RecordBatch:
    table = np.array(found, np.int64).reshape(-1, 3)
    return pa.record_batch([pa.array(table[:, i]) for i in range(3)], ["block", "first", "last"])


def cut(packed: DataFrame, removed: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept, the remaining bytes."""
    own = packed.schema["doc_ids"].dataType.elementType.simpleString()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        raw, ends = unpacked(left["raw"][0], left["sizes"][0])
        first, last = merged(right["first"].to_numpy(), right["last"].to_numpy())
        gone = np.zeros(len(raw) + 1, np.int8)
        for a, b in zip(first.tolist(), last.tolist(), strict=True):
            gone[a : b + width - 1] = 1
        octets, at, rows = np.frombuffer(raw, np.uint8), 0, []
        for end in ends.tolist():
            mask = gone[at:end]
            n = int(mask.sum())
            kept = raw[at:end] if not n else octets[at:end][mask == 0].tobytes()
            spans = int((np.diff(mask, prepend=np.int8(0)) == 1).sum()) if n else 0
            rows.append((end - at, n, spans, hashlib.sha256(kept).hexdigest(), kept))
            at = end
        columns = [pa.array(c) for c in zip(*rows, strict=True)]
        return pa.table([left["doc_ids"].combine_chunks().flatten(), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    schema = f"doc_id {own}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    left = packed.select("block", "doc_ids", "sizes", "raw").groupBy("block")
    return left.cogroup(removed.groupBy("block")).applyInArrow(run, schema)


def remove_repeats(df: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept of every row.

    Strings of ``width`` bytes (20 to 146) that also start earlier are removed.
    """
    if not GRAM <= width <= GRAM + 126:
        raise ValueError("width must be between 20 and 146")
    packed = stage(blocks(df, id_col, text_col, width), "blocks")
    total = packed.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b))).first()[0] or 0
    shards = max(1, -(-total // SHARD))
    repeated = repeated_records(packed, frequent_anchors(packed), width)
    removed = removed_windows(with_bytes(packed, repeated, shards, width), shards, width)
    return cut(packed, removed, width)
