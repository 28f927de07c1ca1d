import hashlib
import random
import re

import public_tokenizers as P
from tests.llm.conftest import EDGE

from recallgrid.llm import secrets

RANKS = P.path("byte_bpe_50k.tiktoken")
ASSIGN = re.compile(
    r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)


def by_hand(text):
    text = text or ""
    found = [("assign", m) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [("access", m) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [("hex", m) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    order = {"assign": 0, "access": 1, "hex": 2}
    found.sort(key=lambda f: (f[1].start(), order[f[0]]))
    count = [sum(k == n for k, _ in found) for n in order]
    written = ",".join(f"{k}:{m.start()}:{m.end()}" for k, m in found)
    return (*count, hashlib.sha256(written.encode()).hexdigest()), set(written.split(",")) - {""}


def test_base_spans_equal_brute_force_and_stay(docs):
    rng = random.Random(2)
    bits = ["token", "Secret=", "PASSWORD : ", "api_key='", "apikey\"= \"", "AKIA", "ſecret=abcdefghijklmnop", "0123456789abcdef",
            "abcdefghijklmnop", "ABCDEFGHIJKLMNOP12", "toKen=", "=", ":", " ", "é", "😀", "deadbeef", "\n", "."]
    rows = EDGE + [(100 + i, "".join(rng.choice(bits) for _ in range(rng.randrange(30)))) for i in range(800)]
    rows += [(2000, "secret: token: abcdefghijklmnop AKIA" + "A" * 40_000)]
    got = sorted(secrets.find_secrets(docs(rows), RANKS, P.PATTERN).collect(), key=str)
    want = sorted(((i, *by_hand(t)[0], by_hand(t)[1]) for i, t in rows), key=str)
    assert len(got) == len(want)
    by_id = {r.doc_id: r for r in got}
    for i, n_assign, n_access, n_hex, mark, base in want:
        r = by_id[i]
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == (n_assign, n_access, n_hex, mark), i
        assert base <= set(r.spans.split(","))
    assert secrets.find_secrets(docs([]), RANKS, P.PATTERN).count() == 0


def test_random_strings_are_found_and_known_shapes_are_not(docs):
    rng = random.Random(4)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = ["".join(rng.choice(letters) for _ in range(40)) for _ in range(30)]
    known = ["D41D8CD98F00B204E9800998ECF8427E", "123E4567-E89B-12D3-A456-426614174000", "getUserNameFromRepository", "some/path/to/my_file_name.txt", "internationalization_of_words", "2024-01-02.10.11.12.13.14"]
    rows = [(i, f"here {k} there") for i, k in enumerate(keys)] + [(100 + i, f"here {k} there") for i, k in enumerate(known)]
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.found] for r in secrets.find_secrets(docs(rows), RANKS, P.PATTERN).collect()}
    assert all(got[i] == [("random", 5, 45)] for i in range(30))
    assert all(("random" not in [k for k, _, _ in got[100 + i]]) for i in range(len(known)))


def test_the_ratio_decides_on_grouped_and_single_case_and_shorter_keys():
    coder = secrets.encoding(RANKS, P.PATTERN)
    rng = random.Random(8)
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    keys = ["A1B2C-D3E4F-G5H6I-J7K8L", "kq7x-9zvb-w3jr-p8ty"]
    keys += ["".join(rng.choice(own) for _ in range(n)) for own in (lower, upper, upper + digits, lower + upper) for n in (16, 19, 40) for _ in range(20)]
    keys += ["".join(rng.choice(lower) for _ in range(8)) + "20240117" for _ in range(20)]
    for key in keys:
        assert secrets.spans_of(f"here {key} there", coder, secrets.MAX_RATIO) == [(5, 3, 5 + len(key))], key
    for name in ("to-be-or-not-to-be", "www.example.com/index.html", "HTTPServerRequestHandler", "2024-01-02T10.11.12Z", "a-b-c-d-e-f-g-h-i-j"):
        assert secrets.spans_of(f"here {name} there", coder, secrets.MAX_RATIO) == [], name


def test_work_stays_linear_in_long_runs_and_many_spans():
    coder = secrets.encoding(RANKS, P.PATTERN)
    digits = "abc" + "1" * 5_000 + "X_" + "a" * 20
    assert secrets.spans_of(digits, coder, secrets.MAX_RATIO)[0] == (0, 2, 5_003)
    letters = "x" + "1" * 5_000 + "Xy" * 2_000 + "-Zz"
    assert (1, 2, 5_001) in secrets.spans_of(letters, coder, secrets.MAX_RATIO)
    many = "secret=abcdefghijklmnop some_long_path/to_my_file_name.txt " * 20_000
    found = secrets.spans_of(many, coder, secrets.MAX_RATIO)
    assert sum(k == 0 for _, k, _ in found) == 20_000


def test_runs_that_touch_a_base_span_are_left_to_it():
    coder = secrets.encoding(RANKS, P.PATTERN)
    odd = "q7Rk2ZpX9vLw4TnB8sYd1HcJ6mGf3KuE"
    text = f"{odd} token={odd} {odd}"
    kinds = [(secrets.KINDS[k], a) for a, k, _ in secrets.spans_of(text, coder, secrets.MAX_RATIO)]
    assert kinds == [("random", 0), ("assign", 33), ("random", 72)]
