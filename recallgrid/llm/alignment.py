"""Two tokenizers' tokens over the same text, aligned by byte ranges.

A is a ``tokenizers`` vocabulary of byte-level BPE and reads space+text; B is a
``sentencepiece`` BPE model with byte fallback and reads the text, to which it
adds that space.  Both cut before a space that follows another character, so a
text falls apart there into stretches that each vocabulary encodes alike wherever
they stand.  They also cut between a letter and a mark such as a comma, and
before a line end, unless a piece of B holds both.  A worker aligns every distinct stretch once: A's character offsets
and B's spans are coarse cuts, and tokens that share a multibyte character or a
byte fallback are refined by their decoded bytes.

Documents travel in blocks of bounded size, as numbers of stretches.  Blocks
count their id pairs, Spark adds the counts up, and each block gets back the
counts of its own pairs, so no table of all pairs is ever in one place.  A block
is written as many short rows in small row groups: Spark reads a row group's rows
at once, and those of a whole file would not fit an executor.

Null and empty texts, and texts whose joined tokens are not space+text (such as
those holding U+2581), have no tokens: zeros, and an empty digest.  Repeated rows
get a row each and count each.  An empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallgrid.llm.bpe import Numbers, byte_letters
from recallgrid.llm.tables import stage
from recallgrid.llm.worker import dropped, id_type, kept, texts_of, trim

SPACE = "▁"
BLOCK = 300_000  # stretches of a block, unless one text alone has more
GROUP = 256  # texts looked at together, at most
BYTES = 1_000_000  # of them, unless one text alone has more
SLICE = 2048  # elements of a list in one row of a block
ROWS = 64  # rows of a row group
RUN = 512  # stretches encoded in a row
KEPT = 2_000_000  # links of the stretches a worker remembers, each stretch counting for 10 more
PAIR = 1 << 32  # a pair of ids as one number: A's times this, plus B's

ODD = re.compile(r"\s |\A | \Z")  # a space that is not the first after a word, or the last character


LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
LETTER = frozenset(c for c in map(chr, range(256)) if re.match(f"[{LETTERS}]", c))
MARKS = ".,;:!?$#*%&()\""  # cut off a letter before them, if neither vocabulary joins the two; so are line ends


def cuts(marks: str) -> re.Pattern:
    """Where a text falls apart within a word: between a letter and a mark, and before a line end that follows no white space."""
    return re.compile(rf"(?<=[{LETTERS}])(?=[{re.escape(marks)}])|(?<=\S)(?=\n)")


def stretches(text: str, marks: str = "", within: re.Pattern | None = None) -> list[str]:
    """Space+text, cut before every space that follows a character other than white space.

    A single space at the end stays with what it follows.  With ``within`` (the
    cuts of ``marks``), words are cut, too.
    """
    words = text.split(" ")
    if ODD.search(text):
        parts = [" " + words[0]]
        for word in words[1:]:
            if parts[-1][-1].isspace():
                parts[-1] += " " + word
            else:
                parts.append(" " + word)
        if len(parts) > 1 and parts[-1] == " ":
            del parts[-1]
            parts[-1] += " "
        return [x for part in parts for x in within.split(part)] if within else parts
    if not within:
        return [" " + w for w in words]
    parts = []
    for word in words:
        if word.isalpha():
            parts.append(" " + word)
        elif word[-1:] in marks and word[-2:-1] in LETTER and word[:-1].isalpha():
            parts += " " + word[:-1], word[-1]
        else:
            parts += within.split(" " + word)
    return parts


def refined_ends(coarse: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Byte ends of tokens from the coarse ends of their spans.

    A token whose span has as many bytes as it decodes to ends where the span
    does.  Tokens inside one character share a span: they end one after the
    other, by their decoded bytes, from the last sure end on.
    """
    done = np.cumsum(lengths)
    sure = np.diff(coarse, prepend=0) == lengths
    last = np.maximum.accumulate(np.where(sure, np.arange(len(coarse)), -1))
    return np.where(last >= 0, coarse[last] + done - done[last], done)


class Aligned:
    """Stretches that lie in a row: tokens of both sides, the groups that their ends cut, and the links.

    Byte ends rise over all stretches, each of which begins where the one before
    it ends, so one sorted merge serves all of them.
    """

    def __init__(self, a_ids: np.ndarray, a_ends: np.ndarray, b_ids: np.ndarray, b_ends: np.ndarray, ends: np.ndarray):
        self.a_ids, self.b_ids, self.ends = a_ids, b_ids, ends
        self.cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)
        self.a_group, self.b_group = np.searchsorted(self.cuts, a_ends), np.searchsorted(self.cuts, b_ends)
        self.a_last, self.b_last = self.cuts[self.a_group] == a_ends, self.cuts[self.b_group] == b_ends
        # Between neighbouring ends lies exactly one pair of tokens whose ranges overlap.
        both = np.union1d(a_ends, b_ends)
        self.links = a_ids[np.searchsorted(a_ends, both)] * PAIR + b_ids[np.searchsorted(b_ends, both)]
        at = [np.searchsorted(e, ends, side="right") for e in (a_ends, b_ends, self.cuts, both)]
        self.counts = np.diff(np.stack(at, axis=1), axis=0, prepend=0)

    def groups(self, tables: list[np.ndarray]) -> list[str]:
        """a1,a2|b1;a3|b2,b3 for every stretch."""
        made = np.empty(len(self.a_ids) + len(self.b_ids), object)
        a_at = np.arange(len(self.a_ids)) + np.searchsorted(self.b_group, self.a_group, side="left")
        b_at = np.arange(len(self.b_ids)) + np.searchsorted(self.a_group, self.b_group, side="right")
        made[a_at] = np.where(self.a_last, tables[1][self.a_ids], tables[0][self.a_ids])
        made[b_at] = np.where(self.b_last, tables[2][self.b_ids], tables[0][self.b_ids])
        parts, stops = made.tolist(), np.cumsum(self.counts[:, 0] + self.counts[:, 1]).tolist()
        return ["".join(parts[x:y])[:-1] for x, y in zip([0, *stops], stops, strict=False)]


class Aligner:
    """Both vocabularies, with the bytes of every id."""

    def __init__(self, a_path: str, b_path: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = SentencePieceProcessor(model_file=b_path)
        with open(a_path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        vocabulary = {t["content"]: t["id"] for t in spec.get("added_tokens", [])} | spec["model"]["vocab"]
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            if letters.keys() >= set(entry):
                self.a_bytes[i] = bytes(map(letters.__getitem__, entry))
        self.b_bytes = [b""] * self.b.get_piece_size()
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes[i] = bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(SPACE, " ").encode()
            if re.search(f"[^{SPACE}]{SPACE}", piece):
                raise ValueError(f"a piece that spans a space, so texts can't be cut there: {piece!r}")
        # The cuts within words hold for the pattern of ByteLevel, and where no piece spans them.
        plain = (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and spec["pre_tokenizer"].get("use_regex", True)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size()) if not self.b.is_control(i) and not self.b.is_unknown(i)]
        self.marks = "".join(m for m in MARKS if not any(re.search(f"[{LETTERS}]{re.escape(m)}", p) for p in pieces if m in p))
        self.within = cuts(self.marks) if plain and self.marks and not any("\n" in p for p in pieces) else None
        self.a_sizes, self.b_sizes = (np.array([*map(len, t)], np.int64) for t in (self.a_bytes, self.b_bytes))
        ids = range(max(len(self.a_bytes), len(self.b_bytes)))
        self.tables = [np.array([f"{i}{mark}" for i in ids], object) for mark in ",|;"]

    def stretches(self, text: str) -> list[str]:
        return stretches(text, self.marks, self.within)

    def align(self, parts: list[str]) -> tuple[list[int], Aligned | None]:
        """Stretches on both sides: numbers of those whose bytes agree, and these aligned."""
        # Stretches are encoded in a row, as both vocabularies cut between them, but for those after which they might not.
        runs, open_run = [], False
        for n, part in enumerate(parts):
            joins = part[0] in " \n" and not part[-1].isspace() and SPACE not in part
            if joins and open_run and len(runs[-1]) < RUN:
                runs[-1].append(n)
            else:
                runs.append([n])
            open_run = joins
        runs.reverse()
        good, a_lists, b_lists, a_ends, b_ends, ends, base = [], [], [], [], [], [], 0
        while runs:
            run = runs.pop()
            raws = [parts[n].encode("utf-8", "surrogatepass") for n in run]
            found = self.encoded("".join([parts[n] for n in run]), b"".join(raws))
            stops = np.cumsum([*map(len, raws)])
            if found is None or any((side[np.searchsorted(side, stops)] != stops).any() for side in found[1::2]):
                runs += [[n] for n in reversed(run)] if len(run) > 1 else []
                continue
            good += run
            for all_of, own in zip((a_lists, a_ends, b_lists, b_ends, ends), (found[0], found[1] + base, found[2], found[3] + base, stops + base), strict=True):
                all_of.append(own)
            base += int(stops[-1])
        if not good:
            return good, None
        return good, Aligned(*map(np.concatenate, (a_lists, a_ends, b_lists, b_ends, ends)))

    def encoded(self, text: str, raw: bytes) -> tuple | None:
        """Ids and byte ends of a text on both sides; none if the bytes don't agree.

        What begins within a word is read behind a letter, whose tokens are left out.
        """
        lead = 0 if text[0] == " " else 2
        if lead:
            text, raw = " x" + text, b" x" + raw
        a_side = self.a.encode(text, add_special_tokens=False)
        b_side = [(p.id, p.end) for p in self.b.encode_as_proto(text[1:]).pieces]
        a_list, b_list = a_side.ids, [i for i, _ in b_side]
        for table, ids in ((self.a_bytes, a_list), (self.b_bytes, b_list)):
            if b"".join(map(table.__getitem__, ids)) != raw:
                return None
        a_spans = np.array([end for _, end in a_side.offsets], np.int64)
        if len(text) < len(raw):  # A's spans are characters
            points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
            octets = np.concatenate([[0], np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))])
            a_spans = octets[a_spans]
        # B's spans are bytes of the text without the space that it adds.
        b_spans = np.array([end for _, end in b_side], np.int64) + 1
        made = []
        for ids, spans, sizes in ((np.array(a_list, np.int64), a_spans, self.a_sizes), (np.array(b_list, np.int64), b_spans, self.b_sizes)):
            ends = refined_ends(spans, sizes[ids]) - lead
            first = int(np.searchsorted(ends, 0, side="right"))
            if lead and (first == 0 or ends[first - 1] != 0):
                return None
            made += ids[first:], ends[first:]
        return tuple(made)


class Memory:
    """What a worker knows of stretches, by number: counts, group strings and links."""

    def __init__(self, aligner: Aligner):
        self.aligner = aligner
        self.forget()

    def forget(self) -> None:
        self.number = Numbers()
        self.groups: list[str] = []
        self.counts = np.zeros((0, 4), np.int64)  # A tokens, B tokens, groups, links; zeros: not aligned
        self.links = np.zeros(0, np.int64)  # one stretch after the other
        self.uses = np.zeros(0, np.int64)
        self.size = 0

    def tidy(self) -> None:
        """Once full, keep only what was met several times; numbers change."""
        if self.size <= KEPT:
            return
        often = np.flatnonzero((self.uses > 1) & (self.counts[:, 3] < 100))
        most = np.argsort(-self.uses[often], kind="stable")[: KEPT // 30]
        often = often[np.sort(most)]
        number, groups, counts, links = list(self.number), self.groups, self.counts, self.links_of(often)
        self.forget()
        self.number = Numbers([number[i] for i in often.tolist()])
        self.groups = [groups[i] for i in often.tolist()]
        self.counts, self.links = counts[often], links
        self.uses = np.zeros(len(often), np.int64)
        self.size = 10 * len(often) + len(links)

    def links_of(self, which: np.ndarray) -> np.ndarray:
        sizes = self.counts[which, 3]
        firsts = (np.cumsum(self.counts[:, 3]) - self.counts[:, 3])[which]
        return self.links[np.repeat(firsts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]

    def numbers(self, parts: list[str]) -> np.ndarray:
        """The numbers of stretches, all of them known from now on."""
        made = np.fromiter(map(self.number.__getitem__, parts), np.int64, len(parts))
        new, self.number.new = self.number.new, []
        counts, links = [self.counts], [self.links]
        for at in range(0, len(new), 4096):
            some = new[at : at + 4096]
            good, aligned = self.aligner.align(some)
            found, groups = np.zeros((len(some), 4), np.int64), [""] * len(some)
            if aligned is not None:
                found[good] = aligned.counts
                links.append(aligned.links)
                for n, text in zip(good, aligned.groups(self.aligner.tables), strict=True):
                    groups[n] = text
            self.groups += groups
            counts.append(found)
        if new:
            self.counts, self.links = np.concatenate(counts), np.concatenate(links)
            self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int64)])
            self.size = 10 * len(self.number) + len(self.links)
        self.uses += np.bincount(made, minlength=len(self.uses))
        return made


def parts_of(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Begin and end of the runs of texts that are looked at together."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        fit = int(np.searchsorted(ends, before + BYTES, side="right"))
        stop = min(start + GROUP, max(start + 1, fit))
        yield start, stop
        start = stop


class Block:
    """Documents of a block, the stretches they hold and the pairs these hold."""

    def __init__(self, memory: Memory):
        self.memory = memory
        self.rows: list[tuple] = []
        self.docs: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_ids: list, texts: list[list[str]]) -> None:
        memory = self.memory
        numbers = memory.numbers([s for parts in texts for s in parts])
        ends = np.cumsum([*map(len, texts)])
        self.size += len(numbers) + len(texts)
        counts = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(memory.counts[numbers], axis=0)])
        missing = np.concatenate([[0], np.cumsum(memory.counts[numbers, 0] == 0)])
        first = np.concatenate([[0], ends[:-1]])
        totals, bad = (counts[ends] - counts[first]).tolist(), (missing[ends] > missing[first]) | (ends == first)
        groups = list(map(memory.groups.__getitem__, numbers.tolist()))
        for n, (a, b) in enumerate(zip(first.tolist(), ends.tolist(), strict=True)):
            if bad[n]:
                self.rows.append((doc_ids[n], 0, 0, 0, 0, ""))
                self.docs.append(numbers[:0])
            else:
                self.rows.append((doc_ids[n], *totals[n], hashlib.sha256(";".join(groups[a:b]).encode()).hexdigest()))
                self.docs.append(numbers[a:b])

    def record(self, number: int, id_kind: pa.DataType) -> pa.RecordBatch:
        """What the documents show already, and what their links are counted by; every list is cut into as many rows."""
        doc_ids, n_a, n_b, n_groups, n_links, digests = zip(*self.rows, strict=True)
        # Each document's stretches once, with how often it has them.
        which, local = np.unique(np.concatenate(self.docs), return_inverse=True)
        owner = np.repeat(np.arange(len(self.docs)), [*map(len, self.docs)])
        cells, times = np.unique(owner * max(1, len(which)) + local, return_counts=True)
        owner, docs = np.divmod(cells, max(1, len(which)))
        held = np.bincount(owner, minlength=len(self.docs))
        pairs, at = np.unique(self.memory.links_of(which), return_inverse=True)
        sizes = self.memory.counts[which, 3]
        met = np.zeros(len(which), np.int64)
        np.add.at(met, docs, times)
        counts = np.zeros(len(pairs), np.int64)
        np.add.at(counts, at, np.repeat(met, sizes))

        rows = max(1, -(-max(map(len, (doc_ids, docs, which, at, pairs))) // SLICE))

        def one(values, kind: pa.DataType) -> pa.Array:
            flat = pa.array(values, kind)
            return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * len(flat) // rows, pa.int32()), flat)

        columns = {
            "block": pa.array([number] * rows, pa.int64()),
            "part": pa.array(np.arange(rows), pa.int32()),
            "doc_ids": one(doc_ids, id_kind),
            "n_a": one(n_a, pa.int64()),
            "n_b": one(n_b, pa.int64()),
            "n_groups": one(n_groups, pa.int64()),
            "n_links": one(n_links, pa.int64()),
            "digests": one(digests, pa.string()),
            "held": one(held, pa.int32()),
            "stretches": one(docs, pa.int32()),
            "times": one(times, pa.int32()),
            "sizes": one(sizes, pa.int32()),
            "at": one(at, pa.int32()),
            "pairs": one(pairs, pa.int64()),
            "counts": one(counts, pa.int64()),
        }
        return pa.record_batch(list(columns.values()), list(columns))


def blocks(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", size: int = BLOCK) -> DataFrame:
    """Blocks of documents, aligned, a few rows each; no shuffle."""
    own = id_type(df, id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = kept(("aligned", a_path, b_path), lambda: Memory(Aligner(a_path, b_path)))
        memory.tidy()
        number, block, kind = TaskContext.get().partitionId() << 32, Block(memory), pa.int64()
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for start, stop in parts_of(batch["text"]):
                part = batch.slice(start, stop - start)
                block.add(part["doc_id"].to_pylist(), [memory.aligner.stretches(t) if t else [] for t in part["text"].to_pylist()])
                if block.size >= size or memory.size > KEPT:
                    yield block.record(number, kind)
                    memory.tidy()
                    number, block = number + 1, Block(memory)
                    trim()
        if block.rows:
            yield block.record(number, kind)

    longs = ", ".join(f"{c} array<long>" for c in ("n_a", "n_b", "n_groups", "n_links"))
    ints = ", ".join(f"{c} array<int>" for c in ("held", "stretches", "times", "sizes", "at"))
    schema = f"block long, part int, doc_ids array<{own}>, {longs}, digests array<string>, {ints}, pairs array<long>, counts array<long>"
    return texts_of(df, id_col, text_col).mapInArrow(run, schema)


def pair_counts(made: DataFrame) -> DataFrame:
    """pair, count over all blocks, and best: whether it is the highest of its B id."""
    counted = (
        made.select(F.explode(F.arrays_zip("pairs", "counts")).alias("p"))
        .groupBy(F.col("p.pairs").alias("pair"))
        .agg(F.sum("p.counts").alias("count"))
        .withColumn("b", F.pmod("pair", F.lit(PAIR)))
    )
    counted = stage(counted, "pair_counts")
    highest = counted.groupBy("b").agg(F.max("count").alias("highest"))
    return counted.join(highest, "b").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def scored(made: DataFrame, counts: DataFrame) -> DataFrame:
    """One row a document: each block meets the counts of its own pairs."""
    wanted = made.select(F.col("block").alias("cell"), F.explode("pairs").alias("pair")).join(counts, "pair")
    own = made.schema["doc_ids"].dataType.elementType.simpleString()
    columns = ["doc_ids", "n_a", "n_b", "n_groups", "n_links", "digests"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        dropped("aligned")  # the stretches this worker remembers aren't needed any more
        left = left.take(pc.sort_indices(left["part"]))
        row = {c: left[c].combine_chunks().flatten() for c in left.column_names if c not in ("block", "part")}
        number = {c: row[c].to_numpy(zero_copy_only=False) for c in ("held", "stretches", "times", "sizes", "at")}
        pair = right["pair"].to_numpy()
        order = np.argsort(pair)  # the block's pairs are sorted, too
        count, best = right["count"].to_numpy()[order], right["best"].to_numpy()[order].astype(np.int64)
        of = np.repeat(np.arange(len(number["sizes"])), number["sizes"])
        totals = []
        for value in (count[number["at"]], best[number["at"]]):
            stretch = np.zeros(len(number["sizes"]), np.int64)
            np.add.at(stretch, of, value)
            document = np.zeros(len(number["held"]), np.int64)
            np.add.at(document, np.repeat(np.arange(len(document)), number["held"]), stretch[number["stretches"]] * number["times"])
            totals.append(pa.array(document))
        names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "count_sum", "n_best"]
        return pa.table([row[c] for c in columns] + totals, names)

    schema = f"doc_id {own}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, count_sum long, n_best long"
    fields = made.select("block", "part", *columns, "held", "stretches", "times", "sizes", "at")
    return fields.groupBy("block").cogroup(wanted.groupBy("cell")).applyInArrow(run, schema)


def align_documents(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; paths are ones every worker can read."""
    made = stage(blocks(df, a_path, b_path, id_col, text_col), "aligned", {"parquet.block.row.count.limit": ROWS})
    found = scored(made, pair_counts(made))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def spans(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The aligned groups themselves: doc_id, start and end (bytes of space+text), a_ids, b_ids.

    A document without tokens has no rows.
    """
    own = id_type(df, id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = kept(("aligner", a_path, b_path), lambda: Aligner(a_path, b_path))
        lists, kind = pa.list_(pa.int32()), None
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                parts = aligner.stretches(text) if text else []
                good, found = aligner.align(parts) if parts else ([], None)
                if found is None or len(good) < len(parts):
                    continue
                n = len(found.cuts)
                starts = np.concatenate([[0], found.cuts[:-1]])
                sides = [
                    pa.array([x.tolist() for x in np.split(ids, np.searchsorted(group, np.arange(1, n)))], lists)
                    for ids, group in ((found.a_ids, found.a_group), (found.b_ids, found.b_group))
                ]
                columns = [pa.array([doc_id] * n, kind), pa.array(starts, pa.int64()), pa.array(found.cuts, pa.int64()), *sides]
                yield pa.record_batch(columns, ["doc_id", "start", "end", "a_ids", "b_ids"])

    schema = f"doc_id {own}, start long, end long, a_ids array<int>, b_ids array<int>"
    return texts_of(df, id_col, text_col).mapInArrow(run, schema)
