import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
from tests.llm.conftest import EDGE, prose
from tokenizers import Tokenizer

from recallgrid.llm import packing, token_counts
from recallgrid.llm.bpe import TextEncoder

PATH = P.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_the_library_on_awkward_texts():
    rng = random.Random(3)
    letters = list("abAB'sdtlrevm  \n\n\t\r\x0b\x1c\x85\xa0　.,!?-_<|>12²é中😀​aaa") + ["<|endoftext|>", "'ll", " the"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(4000)]
    texts += ["a" * 3000, "ab" * 2000, " " * 500, "\n " * 50, ""]
    for keep in (600_000, 10):  # also with a cache that overflows at once
        coded = TextEncoder(PATH, P.PATTERN, False, keep).encode(texts)
        assert [np.frombuffer(c, "<u4").tolist() for c in coded] == [ids(t) for t in texts]
    assert TextEncoder(PATH, P.PATTERN, True).encode(texts) == [len(ids(t)) for t in texts]


def test_chunks_are_cut_in_a_row_and_little_is_kept():
    calls = []

    class Counted:
        def __init__(self, pattern):
            self.pattern = pattern

        def findall(self, text):
            calls.append(text)
            return self.pattern.findall(text)

    encoder = TextEncoder(PATH, P.PATTERN, False, 500)
    encoder.pattern = Counted(encoder.pattern)
    texts = ["head " + " ".join(f"w{i}é.\nx-{i}" for i in range(1_000)), "a\n b \nc\x1c d\x85 it's"]
    assert [np.frombuffer(c, "<u4").tolist() for c in encoder.encode(texts)] == [ids(t) for t in texts]
    assert len(calls) < 10 and len(encoder.known) == len(encoder.ids) == 0
    long = ["x " + "ab" * 9_000]
    assert np.frombuffer(encoder.encode(long)[0], "<u4").tolist() == ids(long[0])
    assert len(encoder.known) == 0  # a long chunk isn't kept
    whole = ["two  spaces and more  " * 50] * 20
    assert [np.frombuffer(c, "<u4").tolist() for c in encoder.encode(whole)] == [ids(t) for t in whole]
    assert len(encoder.ids) == 0  # nor are texts taken whole


def test_token_counts_on_edge_rows(docs):
    got = token_counts.count_tokens(docs(EDGE), PATH, P.PATTERN).collect()
    want = [(i, len((t or "").encode()), len(ids(t)), len(ids(t)) > 1024) for i, t in EDGE]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert token_counts.count_tokens(docs([]), PATH, P.PATTERN).count() == 0


def test_packing_is_a_gapless_cover(docs):
    rng = random.Random(5)
    rows = EDGE + [(100 + i, prose(rng, rng.choice([3, 50, 400, 900, 3000]))) for i in range(200)]
    cut = packing.pieces(docs(rows), PATH, P.PATTERN, with_ids=True)
    packed = packing.pack(cut, per_task=10**6)
    got = packed.collect()
    text_of = {}
    for i, t in rows:
        text_of.setdefault(i, []).append(t)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        assert r.ids_crc32 == zlib.crc32(bytes(r.ids)) and r.length == len(r.ids) // 4
    for i, texts in text_of.items():
        whole = np.array(ids(texts[0]) + [0], "<u4").tobytes()
        mine = sorted(by_doc[i], key=lambda r: r.piece)
        if len(texts) == 1:
            assert [r.piece for r in mine] == list(range(len(mine)))
            assert b"".join(bytes(r.ids) for r in mine) == whole
            assert all(r.length == 2048 for r in mine[1:])
            assert [r.start for r in mine] == np.cumsum([0, *[r.length for r in mine[:-1]]]).tolist()
        else:
            assert len(mine) == len(texts)
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0, *[r.length for r in own[:-1]]]).tolist()
        assert sum(r.length for r in own) <= 2048
    least = -(-sum(r.length for r in got) // 2048)
    assert len(by_sequence) <= least * 1.05 + 1
    joined = {r.sequence_id: bytes(r.ids) for r in packing.sequences(packed).collect()}
    assert joined == {s: b"".join(bytes(r.ids) for r in own) for s, own in by_sequence.items()}
    assert packing.pack(packing.pieces(docs([]), PATH, P.PATTERN)).count() == 0


def test_open_bins_are_bounded_and_the_fullest_closes_first():
    bins = packing.Bins(100, 2, 0)
    assert bins.place(60) == (0, 0)
    assert bins.place(80) == (1, 0)
    assert bins.place(90) == (2, 0)  # bin 1, the fullest, closes
    assert bins.place(15) == (0, 60)  # 40 free there; bin 2 has 10
    assert bins.open == 2
