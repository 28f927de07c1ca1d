"""Benchmark passages in training documents, through a positional inverted index.

The index is transient and partitioned by document: a task holds, for about
``INDEX_WORDS`` words of its documents at a time, the positions of every token that some test window has, sorted by token (a token
of no window can take no part in a match).  A window is searched from its
rarest token in that index: the token's positions, less its place in the
window, are candidate starts, at which the text itself is compared with the
window's other tokens, rarest first.  What is left are exact phrase matches.
A proximity match is a place in a document where all words of a window lie
within ``slop`` words of their places; one may be missing if the window has
``SPARED`` words or more.  Candidates come from the two rarest words, one of
which must be there (from the rarest where none may miss), so whichever words
these are, no match is lost: results don't depend on how documents are dealt
to tasks.  All windows are searched together, so a task takes a few passes
over arrays and nothing is shuffled.

Test items are the stated query set.  They travel to the tasks in blocks of at
most ``block_words`` words; results of several blocks are merged per document.

Words are lower-cased in A-Z.  A null text or one without words has no words, no
hits and is not contaminated; items without words are skipped, and a
null item id is named by the empty string; an item of
fewer than ``width`` words is one window.  Repeated documents are judged each
(with several blocks, rows that agree in id and text are told apart by a
number).  Extra columns are ignored; empty tables give no rows or no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallgrid.llm.tables import stage
from recallgrid.llm.worker import id_type, texts_of

BLOCK_WORDS = 1_000_000
INDEX_WORDS = 2_000_000  # document words in one index
SLOP = 2
SPARED = 8  # words of a window of which one may be missing in a proximity match
CANDIDATES = 2_000_000  # candidate starts held at a time, but for one window's own list
# Letters, digits and all bytes of characters beyond ASCII are parts of words.
FOLD = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in bytes(range(256)).lower())


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


class Windows:
    """Windows of a block of test items, as arrays of token numbers."""

    def __init__(self, items: list[tuple], width: int):
        self.names = [name for name, _ in items]
        self.vocabulary: dict[bytes, int] = {}
        grown, item, size = [], [], []
        for n, (_, text) in enumerate(items):
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text)]
            for at in range(max(1, len(ids) - width + 1) if ids else 0):
                own = ids[at : at + width]
                grown.append(own + [-1] * (width - len(own)))
                item.append(n)
                size.append(len(own))
        self.tokens = np.array(grown, np.int64).reshape(-1, width)
        self.item, self.size = np.array(item, np.int64), np.array(size, np.int64)


class Index:
    """Positions of test tokens in some documents: postings sorted by token, then position."""

    def __init__(self, coded: np.ndarray, n_tokens: int):
        self.coded = coded
        known = np.flatnonzero(coded >= 0)
        self.positions = known[np.argsort(coded[known], kind="stable")]
        self.counts = np.bincount(coded[known], minlength=n_tokens)
        self.starts = np.concatenate(([0], np.cumsum(self.counts)))
        self.keys = coded[self.positions] * len(coded) + self.positions
        self.ends = np.flatnonzero(coded == -2)  # a separator lies behind each document
        self.begins = np.concatenate(([0], self.ends + 1))

    def near(self, token: np.ndarray, at: np.ndarray, slop: int, doc: np.ndarray) -> np.ndarray:
        """Whether the token's list has a position of the document within ``slop`` of ``at``."""
        low = np.maximum(at - slop, self.begins[doc])
        high = token * len(self.coded) + np.minimum(at + slop, self.ends[doc] - 1)
        place = np.searchsorted(self.keys, token * len(self.coded) + low)
        found = np.minimum(place, len(self.keys) - 1)
        return (place < len(self.keys)) & (self.keys[found] <= high)

    def search(self, windows: Windows, slop: int) -> tuple[np.ndarray, ...]:
        """Window and start of exact matches, then window and document of proximity matches."""
        nothing = np.zeros(0, np.int64)
        if not len(windows.tokens) or not len(self.keys):
            return nothing, nothing, nothing, nothing
        frequency = np.where(windows.tokens >= 0, self.counts[windows.tokens], np.iinfo(np.int64).max)
        rarest = np.argsort(frequency, axis=1, kind="stable")
        every = np.flatnonzero(frequency.min(axis=1) > 0)
        exact = [self.exact(windows, rarest, own) for own in self.some(every, frequency[every, rarest[every, 0]])]
        spare = (windows.size >= SPARED).astype(np.int64)
        near = []
        for step in (0, 1):
            # a window is left out if more of its words are nowhere than may be missing
            able = (windows.size > 2) & (spare >= step) & ((frequency == 0).sum(axis=1) <= spare)
            able = np.flatnonzero(able)
            lists = frequency[able, rarest[able, min(step, windows.tokens.shape[1] - 1)]]
            near += [self.close(windows, rarest, own, step, slop) for own in self.some(able, lists)]
        parts = [[np.concatenate([nothing, *c]) for c in zip(*found, strict=True)] or [nothing] * 2 for found in (exact, near)]
        return *parts[0], *parts[1]

    @staticmethod
    def some(windows: np.ndarray, lists: np.ndarray) -> list[np.ndarray]:
        """Windows in groups, so that candidate starts are held for some at a time."""
        cuts = np.flatnonzero(np.diff(np.cumsum(lists) // CANDIDATES)) + 1
        return [own for own in np.split(windows, cuts) if len(own)]

    def starts_of(self, windows: Windows, window: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each position of each window's anchor: which window, and the position."""
        token = windows.tokens[window, anchor]
        lists = self.counts[token]
        which = np.repeat(np.arange(len(window)), lists)
        within = np.arange(len(which)) - np.repeat(np.cumsum(lists) - lists, lists)
        return which, self.positions[self.starts[token][which] + within]

    def exact(self, windows: Windows, rarest: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        width, last = windows.tokens.shape[1], len(self.coded) - 1
        anchor = rarest[window, 0]
        which, at = self.starts_of(windows, window, anchor)
        window, start = window[which], at - anchor[which]
        inside = (start >= 0) & (start + windows.size[window] <= len(self.coded))
        window, start = window[inside], start[inside]
        for step in range(1, width):
            if not len(window):
                break
            place = rarest[window, step]
            wanted = windows.tokens[window, place]
            same = (wanted < 0) | (self.coded[np.minimum(start + place, last)] == wanted)
            window, start = window[same], start[same]
        return window, start

    def close(
        self, windows: Windows, rarest: np.ndarray, window: np.ndarray, step: int, slop: int
    ) -> tuple[np.ndarray, np.ndarray]:
        anchor = rarest[window, step]
        which, at = self.starts_of(windows, window, anchor)
        window, start = window[which], at - anchor[which]
        doc = np.searchsorted(self.ends, at, side="right")
        # The anchor may itself be out of place by ``slop``: others are off by twice that at most.
        window, start, doc = self.all_near(windows, rarest, window, start, doc, 2 * slop)
        moves = np.arange(-slop, slop + 1)
        window, doc = np.repeat(window, len(moves)), np.repeat(doc, len(moves))
        start = (start[:, None] + moves).ravel()
        window, _, doc = self.all_near(windows, rarest, window, start, doc, slop)
        pairs = np.unique(np.stack([window, doc], axis=1), axis=0)
        return pairs[:, 0], pairs[:, 1]

    def all_near(self, windows: Windows, rarest: np.ndarray, window, start, doc, slop: int) -> tuple[np.ndarray, ...]:
        """Candidates of which all words but the spare one are within ``slop`` of their places."""
        spare = (windows.size[window] >= SPARED).astype(np.int64)
        for step in range(windows.tokens.shape[1]):
            if not len(window):
                break
            place = rarest[window, step]
            wanted = windows.tokens[window, place]
            there = (wanted < 0) | self.near(np.maximum(wanted, 0), start + place, slop, doc)
            spare = spare - ~there
            left = spare >= 0
            window, start, spare, doc = window[left], start[left], spare[left], doc[left]
        return window, start, doc


def judged(coded: np.ndarray, ends: np.ndarray, windows: Windows, slop: int) -> list[tuple]:
    """For each document: words, hit words, hit positions as [from, to) pairs, items, near items."""
    index = Index(coded, len(windows.vocabulary))
    window, start, near_w, near_d = index.search(windows, slop)
    size = windows.size[window]
    change = np.zeros(len(coded) + 1, np.int64)
    np.add.at(change, start, 1)
    np.add.at(change, start + size, -1)
    hit = np.cumsum(change)[:-1] > 0
    begins = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    hits = np.concatenate(([0], np.cumsum(hit)))
    totals = hits[ends] - hits[begins] if len(ends) else []
    # A match can't cross documents: a separator lies behind each.
    found: dict[int, tuple[set, set]] = {}
    for slot, own, doc in ((0, window, np.searchsorted(ends, start, side="right")), (1, near_w, near_d)):
        pairs = np.unique(doc * (len(windows.names) + 1) + windows.item[own])
        for pair in pairs.tolist():
            d, item = divmod(pair, len(windows.names) + 1)
            found.setdefault(d, (set(), set()))[slot].add(windows.names[item])
    out = []
    for d, (a, b) in enumerate(zip(begins.tolist(), ends.tolist(), strict=True)):
        items, close = found.get(d, (set(), set()))
        spans = []
        if items:
            flips = np.flatnonzero(np.diff(np.concatenate(([0], hit[a:b].astype(np.int8), [0]))))
            spans = [{"from": x, "to": y} for x, y in flips.reshape(-1, 2).tolist()]
        out.append((b - a - 1, int(totals[d]), spans, sorted(items), sorted(close - items)))
    return out


SPANS = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
NAMES = pa.list_(pa.string())


def match_block(docs: DataFrame, items: list[tuple], width: int, slop: int, keys: list[str]) -> DataFrame:
    fields = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(items, width)
        get = windows.vocabulary.get

        def flush(rows: list[pa.RecordBatch], coded: list, ends: list) -> pa.RecordBatch:
            held = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
            made = zip(*judged(np.array(coded, np.int64), np.array(ends, np.int64), windows, slop), strict=True)
            kinds = [pa.int64(), pa.int64(), SPANS, NAMES, NAMES]
            return pa.record_batch(
                [*[held[k] for k in keys], *[pa.array(list(c), t) for c, t in zip(made, kinds, strict=True)]],
                [*keys, "n_words", "n_hit", "spans", "items", "near_items"],
            )

        rows, coded, ends = [], [], []
        for batch in batches:
            narrow = batch.select(keys)
            for i, text in enumerate(batch["text"].to_pylist()):
                coded += [get(w, -1) for w in words(text)]
                coded.append(-2)
                ends.append(len(coded))
                rows.append(narrow.slice(i, 1))
                if len(coded) >= INDEX_WORDS:
                    yield flush(rows, coded, ends)
                    rows, coded, ends = [], [], []
        if rows:
            yield flush(rows, coded, ends)

    schema = f"{fields}, n_words long, n_hit long, spans array<struct<`from`:bigint,`to`:bigint>>, items array<string>, near_items array<string>"
    return docs.mapInArrow(run, schema)


def find_passages(
    documents: DataFrame,
    benchmark: DataFrame,
    width: int = 13,
    slop: int = SLOP,
    block_words: int = BLOCK_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
) -> DataFrame:
    """doc_id, n_words, n_hit, spans of hit words, items (exact), near_items (proximity only)."""
    queries = texts_of(benchmark, item_col, text_col).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("item"), "text")
    n_words = F.size(F.split("text", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
    total = queries.agg(F.sum(n_words)).first()[0] or 0
    blocks = max(1, -(-total // block_words))
    docs = texts_of(documents, id_col, text_col)

    def items_of(block: int) -> list[tuple]:
        own = queries.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block)
        return [(r["item"], r["text"]) for r in own.toLocalIterator()]

    if blocks == 1:
        return match_block(docs, items_of(0), width, slop, ["doc_id"])
    # Written once, so that a row has the same number in every block's pass.
    numbered = stage(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    keys = ["doc_id", "_row"]
    # Each block is matched and written before the next is read, so the driver holds one.
    parts = [stage(match_block(numbered, items_of(b), width, slop, keys), "block") for b in range(blocks)]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return merged(union, keys).drop("_row")


def merged(parts: DataFrame, keys: list[str]) -> DataFrame:
    """One row per document from the rows of several blocks: spans are united, items too."""
    spans = F.array_sort(F.flatten(F.collect_list("spans")))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))

    def grow(state, span):
        fresh = F.greatest(span["to"] - F.greatest(span["from"], state["end"]), F.lit(0).cast("long"))
        return F.struct((state["n"] + fresh).alias("n"), F.greatest(state["end"], span["to"]).alias("end"))

    items = F.array_sort(F.array_distinct(F.flatten(F.collect_list("items"))))
    near = F.array_sort(F.array_distinct(F.flatten(F.collect_list("near_items"))))
    return (
        parts.groupBy(*keys)
        .agg(F.first("n_words").alias("n_words"), spans.alias("spans"), items.alias("items"), near.alias("near_items"))
        .withColumn("n_hit", F.aggregate("spans", start, grow)["n"])
        .withColumn("near_items", F.array_except("near_items", "items"))
        .select(*keys, "n_words", "n_hit", "spans", "items", "near_items")
    )


def report(found: DataFrame) -> DataFrame:
    """The digest columns and the verdict: at least a twentieth of the words is hit."""
    names = F.array_join(F.array_sort(F.array_distinct("items")), ",")
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size(F.array_distinct("items")).cast("long").alias("n_items"),
        F.sha2(names.cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )
