"""Secrets in whole texts: fixed patterns, and a token-efficiency test for random strings.

Fixed patterns give ``assign`` (a named value), ``access`` (a key id) and
``hex`` spans.  The efficiency test looks at every other run of 16 or more key
characters: natural words come out of a tiktoken vocabulary at four or more
characters a token, random strings at about two, so a run that without its
separators has few characters per token is reported as ``random``, whatever the
case of its letters.  Known digests and identifiers are excluded: whole hex
digests, UUIDs, numbers and dates, and runs of several parts that are each a
number or a single token of letters (paths, snake_case; so ``to-be-or-not-to-be``
is none, but neither are random groups that all happen to be tokens).

Spans count code points, the end excluded.  A null or empty text has none;
repeated rows are searched each; an empty table gives an empty result; other
columns are ignored.  Work is linear in a text's length and nothing is shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from recallgrid.llm.worker import id_type, kept, map_batches, texts_of

# fixed values: the patterns of the three base kinds, and their least lengths
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.ASCII | re.IGNORECASE,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "random")

RUN = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{16,}")
KNOWN = re.compile(
    r"(?:sha\d+[-:=])?(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128})"
    r"|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"
    r"|[0-9+/_.=-]+"
    r"|[0-9]{4}-?[0-9]{2}-?[0-9]{2}T[0-9.+-]+Z?"
)
PART = re.compile(r"[A-Za-z0-9]+")
MAX_RATIO = 2.4
PIECE = 4_096  # characters encoded at a time, for runs of any length


def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("secrets", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by the fixed patterns; failing matches still consume their text."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12] if ("=" in text or ":" in text) else []
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    return found + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def is_random(run: str, coder: tiktoken.Encoding, max_ratio: float) -> bool:
    if KNOWN.fullmatch(run):
        return False
    parts = PART.findall(run)
    joined = "".join(parts)
    tokens = sum(len(coder.encode_ordinary(joined[i : i + PIECE])) for i in range(0, len(joined), PIECE))
    return len(joined) < max_ratio * tokens and not is_name(parts, coder)


def is_name(parts: list[str], coder: tiktoken.Encoding) -> bool:
    """Whether a run is an identifier: words between separators, each a single token of letters, or a number."""
    return len(parts) > 1 and all(p.isdigit() or (p.isalpha() and len(p) < PIECE and len(coder.encode_ordinary(p)) == 1) for p in parts)


def spans_of(text: str, coder: tiktoken.Encoding, max_ratio: float) -> list[tuple[int, int, int]]:
    base = base_spans(text)
    taken = sorted((a, b) for a, _, b in base)
    random = []
    at, reach = 0, 0  # spans that begin before the run's end, and how far they go
    for run in RUN.finditer(text):
        a, b = run.span()
        while at < len(taken) and taken[at][0] < b:
            reach = max(reach, taken[at][1])
            at += 1
        if reach <= a and is_random(run[0], coder, max_ratio):
            random.append((a, 3, b))
    return sorted(base + random)


def find_secrets(
    df: DataFrame,
    ranks: str,
    pattern: str,
    max_ratio: float = MAX_RATIO,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, found (kind, start, end) and the digest columns n_assign, n_access, n_hex, n_random, base_sha256, spans."""
    own = id_type(df, id_col)
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder = kept(("secrets", ranks, pattern), lambda: encoding(ranks, pattern))
        found, counts, marks, spans = [], [], [], []
        for text in batch["text"].to_pylist():
            all_spans = spans_of(text, coder, max_ratio)
            written = [f"{KINDS[k]}:{a}:{b}" for a, k, b in all_spans]
            base = [w for w, (_, k, _) in zip(written, all_spans, strict=True) if k < 3]
            counts.append([sum(k == n for _, k, _ in all_spans) for n in range(4)])
            marks.append(hashlib.sha256(",".join(base).encode()).hexdigest())
            spans.append(",".join(written))
            found.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in all_spans])
        columns = [pa.array(c, pa.int64()) for c in zip(*counts, strict=True)]
        return pa.record_batch(
            [batch["doc_id"], *columns, pa.array(marks), pa.array(spans), pa.array(found, pa.list_(span))],
            ["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans", "found"],
        )

    schema = (
        f"doc_id {own}, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string, "
        "found array<struct<kind:string,start:bigint,end:bigint>>"
    )
    return map_batches(texts_of(df, id_col, text_col), work, schema)
