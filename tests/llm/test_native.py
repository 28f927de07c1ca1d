import random
import re
from collections import Counter

from pyspark.sql import functions as F
from tests.llm.conftest import EDGE, prose

from recallgrid.llm import line_dedup, quality_rules, url_filters


def rules_by_hand(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in twice for k in range(5)}
    n, chars, marks = len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text))
    dups = len(lines) - len(set(lines))
    failed = n < 10 or 100 * len(covered) > 20 * n
    kept = not (failed or chars < 2 * n or chars > 25 * n or marks > n or 10 * len(set(lines)) < 3 * len(lines) or not any(c.isalpha() for c in text))
    return n, chars, marks, dups, len(covered), failed, kept


def sample(rng):
    rows = [(i, t if i != 6 else "word " * 3000) for i, t in EDGE]
    for i in range(150):
        words = prose(rng, rng.randrange(1, 80)).split()
        if i % 3 == 0:
            words += words[: rng.randrange(1, 12)]
        text = " ".join(words)
        if i % 4 == 0:
            text = "\n".join([text, rng.choice(["same line", "", " \t"]), "same line", text[:30]])
        if i % 10 == 0:
            text = " | ".join(text.split())
        rows.append((100 + i, text.replace(" ", rng.choice([" ", "  ", "\t", " \x0b"]), 3)))
    return rows


def test_quality_rules_equal_brute_force(docs):
    rows = sample(random.Random(1))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    got = sorted((str(r.doc_id), *[r[n] for n in names]) for r in quality_rules.judge(docs(rows)).collect())
    assert got == sorted((str(i), *rules_by_hand(t)) for i, t in rows)
    kept = quality_rules.keep_good(docs(rows))
    assert kept.columns == docs(rows).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, t in rows if rules_by_hand(t)[-1])
    assert quality_rules.judge(docs([])).count() == 0 and quality_rules.keep_good(docs([])).count() == 0


def test_rules_that_reject_more_per_second_come_first(docs):
    frame = docs([(i, "plain words") for i in range(300)])
    rules = {"never": F.length("text") < 0, "always": F.length("text") > 0}
    assert list(quality_rules.ordered(frame, rules)) == ["always", "never"]


def test_rule_sample_is_bounded_and_from_all_rows(docs):
    frame = docs([(i, f"text number {i}") for i in range(5_000)])
    some = [r.doc_id for r in quality_rules.sampled(frame, 500).select("doc_id").collect()]
    assert 350 < len(some) < 650 and min(some) < 100 and max(some) > 4_900
    assert quality_rules.sampled(frame, 5_000).count() == 5_000


def lines_by_hand(rows, ratio, least):
    single = {(t, h) for _, t, h in rows}  # copies of a page count as one
    pages, counts = Counter(h for _, h in single), Counter()
    for text, host in single:
        counts.update({(host, x) for x in (text or "").split("\n")} if text is not None else ())
    out = []
    for i, text, host in rows:
        own = None if text is None else text.split("\n")
        bad = lambda x: re.search(r"[^\x20\x09-\x0D]", x) and counts[host, x] >= least and counts[host, x] > ratio * pages[host]  # noqa: B023, E731
        rest = None if own is None else [x for x in own if not bad(x)]
        out.append((str(i), str(host), None if own is None else "\n".join(rest), len(own or []), len(own or []) - len(rest or [])))
    return sorted(out, key=str)


def test_line_dedup_equals_brute_force(docs):
    rng = random.Random(9)
    rows = [(i, t, "edge") for i, t in EDGE]
    for i in range(120):
        own = [prose(rng, 6) for _ in range(rng.randrange(1, 5))]
        if rng.random() < 0.5:
            own.insert(0, "All rights reserved")
        if rng.random() < 0.1:
            own.append("rare notice")
        rows.append((100 + i, "\n".join(own), rng.choice(["a", "b", None])))
    rows += [(500 + i, "All rights reserved", "a") for i in range(3)]
    rows += [(600 + i, "one page\nof which\nthere are copies", "b") for i in range(40)]
    frame = docs([])
    for host in {h for _, _, h in rows}:
        frame = frame.union(docs([(i, t) for i, t, h in rows if h == host], host))
    cleaned = line_dedup.drop_boilerplate(frame, F.col("source"), max_ratio=0.2, min_pages=3)
    got = sorted(((str(r.doc_id), str(r.source), r.text, r.n_lines, r.n_dropped) for r in cleaned.collect()), key=str)
    assert got == lines_by_hand(rows, 0.2, 3)
    assert any(r[-1] for r in got)


def judged_by_hand(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(len(h + p), h + p, v) for h, p, v in url_filters.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else None


def test_url_rules_and_mined_rules(llm_spark):
    urls = [None, "", "no scheme", "http://", "https://EXAMPLE.net/en/x?a=/fr/#b", "http://www.example.net/de/", "http://a.org/fr/", "http://a.org/frx/", "http://org/fr/1",
            "x://example.com/de/y://z", "http://badexample.com/de/", "http://m.example.com/de/?q", "http://h.net?x", "http://ÀB.org/fr/ü"]
    spam = [f"http://{s}.example.com/en/{n}" for n in range(60) for s in ("cheap-pills", "quiet-garden")]
    rows = list(enumerate(urls + spam))
    pages = llm_spark.createDataFrame([(i, u, "h", "x", "y") for i, u in rows + rows[:3]], "page_id long, url string, html string, host string, tokens string")
    labels = llm_spark.createDataFrame([(i, 0 if u and "pills" in u else 1, 0) for i, u in rows if i % 5] + [(1, None, None)], "doc_id long, quality int, toxic int")
    got = url_filters.judge_urls(pages, labels).collect()
    assert len(got) == len(rows) + 3
    for r in got:
        url = dict(rows)[r.page_id]
        host, path, rule, verdict = judged_by_hand(url)
        assert (r.host, r.path, r.rule) == (host, path, rule), url
        assert r.verdict == (verdict or ("block" if "pills" in (url or "") else "allow")), url
    empty = url_filters.judge_urls(pages.limit(0), labels)
    assert empty.count() == 0
    assert {r.verdict for r in url_filters.judge_urls(pages, labels.limit(0)).filter("rule is null").collect()} == {"allow"}
