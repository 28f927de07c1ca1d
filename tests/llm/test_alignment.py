import hashlib
import random
from collections import Counter

import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tests.llm.conftest import EDGE, prose

from recallgrid.llm import alignment, worker
from recallgrid.llm.bpe import byte_letters

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    (20, "▁ here"),
    (21, "x▁ y"),
    (22, " "),
    (23, "   lead  and trail   "),
    (24, "\n\n  \t mixed \r\n lines \n"),
    (25, "😀😀 𐍈 é é ﬁ ​ x　y <0x41> <s> </s> <unk> <|endoftext|>"),
    (26, "中文字符和한국어와日本語の混ざった文"),
    (27, "a\x00b \x07"),
    (28, "it's we'll I'D 12345 ... --- ___"),
    (29, "﻿ bom nbsp  em"),
]


@pytest.fixture(scope="module")
def tools():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=B)


def whole(tools, text):
    """Ids and bytes of both sides of a whole text, without cutting it."""
    a, b = tools
    letters = byte_letters()
    a_ids = a.encode(" " + text, add_special_tokens=False).ids
    a_bytes = [bytes(letters[c] for c in a.id_to_token(i)) for i in a_ids]
    b_ids = b.encode(text)
    b_bytes = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in b_ids]
    return a_ids, a_bytes, b_ids, b_bytes


def by_hand(tools, rows):
    counts, kept = Counter(), []
    for doc_id, text in rows:
        a_ids, a_bytes, b_ids, b_bytes = whole(tools, text) if text else ([], [], [], [])
        raw = (" " + (text or "")).encode()
        if not text or b"".join(a_bytes) != raw or b"".join(b_bytes) != raw:
            kept.append((doc_id, None))
            continue
        links, groups, i, j, x, y, a0, b0 = [], [], 0, 0, 0, 0, 0, 0
        x, y = len(a_bytes[0]), len(b_bytes[0])
        while True:
            links.append((a_ids[i], b_ids[j]))
            if x == y:
                groups.append(",".join(map(str, a_ids[a0 : i + 1])) + "|" + ",".join(map(str, b_ids[b0 : j + 1])))
                a0, b0 = i + 1, j + 1
            step_a, step_b = x <= y, y <= x
            if step_a:
                i += 1
                x += len(a_bytes[i]) if i < len(a_ids) else 0
            if step_b:
                j += 1
                y += len(b_bytes[j]) if j < len(b_ids) else 0
            if i == len(a_ids):
                break
        counts.update(links)
        kept.append((doc_id, (len(a_ids), len(b_ids), groups, links)))
    highest = {}
    for (_, b), n in counts.items():
        highest[b] = max(highest.get(b, 0), n)
    made = []
    for doc_id, found in kept:
        if found is None:
            made.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = found
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
        best = sum(counts[p] == highest[p[1]] for p in links)
        made.append((doc_id, n_a, n_b, len(groups), len(links), best, sum(counts[p] for p in links), digest))
    return sorted(made, key=str)


@pytest.mark.parametrize("size", [50, alignment.BLOCK])
def test_alignment_equals_whole_texts(docs, tools, size, monkeypatch):
    monkeypatch.setattr(alignment.blocks, "__defaults__", ("doc_id", "text", size))
    rng = random.Random(size)
    rows = EDGE + ODD + [ODD[5], (5, "another text of this id")]
    rows += [(100 + i, prose(rng, rng.randrange(1, 60)) + rng.choice(["", "\n", " ", " ü中"])) for i in range(60)]
    alphabet = "ab Z9.,'\n\t é中😀́▁"
    rows += [(300 + i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(40)))) for i in range(200)]
    made = alignment.align_documents(docs(rows).repartition(3), A, B).collect()
    assert sorted((tuple(r) for r in made), key=str) == by_hand(tools, rows)


def test_words_with_marks_equal_whole_texts(docs, tools):
    rng, alphabet = random.Random(9), "abcdetsZ é²ª.,'\n" + alignment.MARKS
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))) for i in range(300)]
    made = alignment.align_documents(docs(rows).repartition(3), A, B).collect()
    assert sorted((tuple(r) for r in made), key=str) == by_hand(tools, rows)


def test_words_are_aligned_once_and_in_a_row(monkeypatch):
    aligner = alignment.Aligner(A, B)
    assert aligner.stretches('stone, stone.\nLight... x$$$ 9. "é"') == [" stone", ",", " stone", ".", "\nLight", "...", " x", "$$$", " 9.", ' "é', '"']
    calls = []
    encode = alignment.Aligner.encoded
    monkeypatch.setattr(alignment.Aligner, "encoded", lambda self, *own: calls.append(own) or encode(self, *own))
    words = [f" w{i}" for i in range(2_000)]
    good, made = aligner.align(words)
    assert good == list(range(2_000)) and len(calls) == -(-2_000 // alignment.RUN)
    bad = [*words[:3], " ▁", ",", *words[3:6], "...\n"]
    assert aligner.align(bad)[0] == [0, 1, 2, 4, 5, 6, 7, 8]
    alone = [aligner.align([w])[1] for w in bad if w != " ▁"]
    assert aligner.align(bad)[1].groups(aligner.tables) == [w.groups(aligner.tables)[0] for w in alone]


def test_groups_cover_the_text(docs, tools):
    rows = [(1, "Some wörds 😀 here\n"), (2, "▁"), (3, None)]
    made = alignment.spans(docs(rows), A, B).orderBy("start").collect()
    raw = b" " + "Some wörds 😀 here\n".encode()
    assert {r.doc_id for r in made} == {1}
    assert [made[0].start, made[-1].end] == [0, len(raw)]
    assert all(x.end == y.start for x, y in zip(made, made[1:], strict=False))
    a_ids, a_bytes, b_ids, b_bytes = whole(tools, "Some wörds 😀 here\n")
    assert [i for r in made for i in r.a_ids] == a_ids
    assert [i for r in made for i in r.b_ids] == b_ids


def test_blocks_are_written_as_short_rows_in_small_row_groups(docs, tools, monkeypatch):
    found = []
    stage = alignment.stage
    monkeypatch.setattr(alignment, "stage", lambda *own: found.append(stage(*own)) or found[-1])
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(3_000))) for i in range(60)]
    made = alignment.align_documents(docs(rows).coalesce(1), A, B).collect()
    assert sorted((tuple(r) for r in made), key=str) == by_hand(tools, rows)
    lists = [n for n, kind in found[0].dtypes if kind.startswith("array")]
    longest = found[0].selectExpr(*[f"max(size({n}))" for n in lists]).first()
    assert 1_000 < max(longest) <= 2_048
    groups = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in found[0].inputFiles()]
    sizes = [m.row_group(i).num_rows for m in groups for i in range(m.num_row_groups)]
    assert len(sizes) > 1 and max(sizes) <= 64


def test_slices_of_a_block_go_together_again(docs, tools, monkeypatch):
    for name, value in (("SLICE", 3), ("ROWS", 2), ("BYTES", 40)):
        monkeypatch.setattr(alignment, name, value)
    rng = random.Random(3)
    rows = [*EDGE[:7], *ODD, *[(100 + i, prose(rng, rng.randrange(20))) for i in range(40)]]
    made = alignment.align_documents(docs(rows).repartition(3), A, B).collect()
    assert sorted((tuple(r) for r in made), key=str) == by_hand(tools, rows)


def test_long_texts_are_looked_at_apart():
    texts = pa.array(["", "a" * 600_000, "b" * 500_000, "c", "d" * 3_000_000, *["e"] * 300])
    assert list(alignment.parts_of(texts)) == [(0, 2), (2, 4), (4, 5), (5, 261), (261, 305)]
    assert list(alignment.parts_of(texts.slice(3, 2))) == [(0, 1), (1, 2)]
    assert list(alignment.parts_of(texts[:0])) == []


def test_workers_give_back_what_they_kept_of_a_kind():
    made = [worker.kept((kind, "x"), object) for kind in ("aligned", "other")]
    worker.dropped("aligned")
    assert worker.kept(("aligned", "x"), object) is not made[0]
    assert worker.kept(("other", "x"), object) is made[1]
    worker.dropped("aligned"), worker.dropped("other"), worker.dropped("none")


def test_no_rows(docs):
    assert alignment.align_documents(docs([]), A, B).collect() == []
