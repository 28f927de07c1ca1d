"""DuckDB twins of the queries: plain SQL over whole tables, no shared code with Spark."""

from __future__ import annotations

LETTERS = ", ".join(f"'{c}'" for c in "abcdefghijklmnopqrstuvwxyz")
SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]+"
WORD = r"[\p{L}\p{N}_]+"


def letters(expr: str) -> str:
    return (
        f"list_transform([{LETTERS}], lambda c: "
        f"(length(lower({expr})) - length(replace(lower({expr}), c, '')))::DOUBLE)"
    )


def nonneg(expr: str) -> str:
    """Round to six decimals without negative zero."""
    return f"(CASE WHEN round({expr}, 6) = 0 THEN 0.0 ELSE round({expr}, 6) END)"


def cosine(a: str, b: str) -> str:
    aa, bb = f"list_inner_product({a}, {a})", f"list_inner_product({b}, {b})"
    norms = f"(sqrt({aa}) * sqrt({bb}))"
    return nonneg(
        f"CASE WHEN {norms} > 0 THEN 1 - list_inner_product({a}, {b}) / {norms} ELSE 1.0 END"
    )


def l2sq(a: str, b: str) -> str:
    gaps = f"list_transform(list_zip({a}, {b}), lambda z: z[1] - z[2])"
    return nonneg(f"list_inner_product({gaps}, {gaps})")


def norm(expr: str) -> str:
    """Evidence form without compatibility folding."""
    bare = f"regexp_replace({expr}, '(?i)\\b(user|assistant)\\s*:\\s*', '', 'g')"
    plain = f"translate({bare}, '’“”' || chr(160), '''\"\" ')"
    return f"lower(trim(regexp_replace({plain}, '{SPACE}', ' ', 'g')))"


def words(expr: str) -> str:
    return f"regexp_extract_all({expr}, '{WORD}')"


def spaced(expr: str, fold: bool = True) -> str:
    value = f"lower({expr})" if fold else expr
    return f"list_filter(regexp_split_to_array({value}, '{SPACE}'), lambda t: t <> '')"


def covers(have: str, want: str) -> str:
    """Share of the tokens in ``want`` found in ``have`` is at least 0.85."""
    return (
        f"(len({want}) > 0 AND len(list_filter({want}, lambda t: list_contains({have}, t))) "
        f"/ greatest(len({want}), 1)::DOUBLE >= 0.85)"
    )


def strip(expr: str) -> str:
    return f"regexp_replace({expr}, '\\A{SPACE}|{SPACE}\\z', '', 'g')"


def line(alias: str = "", index: str | None = None) -> str:
    a = f"{alias}." if alias else ""

    def items(name: str) -> str:
        return (
            f"'[' || list_aggregate(list_transform({a}{name}, lambda x: '''' || x || ''''), "
            "'string_agg', ', ') || ']'"
        )

    def brackets(name: str) -> str:
        return f"(CASE WHEN len({a}{name}) = 0 THEN '[]' ELSE {items(name)} END)"

    head = f"'memory index:' || ({index}) || chr(9) || " if index else ""
    return (
        f"{head}'talk start time:' || {a}timestamp || chr(9) || 'memory content: ' || {a}content "
        f"|| chr(9) || 'memory context: ' || {a}context || chr(9) || 'memory keywords: ' || "
        f"{brackets('keywords')} || chr(9) || 'memory tags: ' || {brackets('tags')} || chr(10)"
    )


# ---- shared table expressions, in order of dependence ---------------------------------

CTES: dict[str, tuple[list[str], str]] = {
    "m": (
        [],
        """SELECT conv_id, turn AS pos, role, text, lead(role) OVER w AS nrole,
               lead(text) OVER w AS ntext
           FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
    ),
    "p": (
        ["m"],
        """SELECT *, role NOT IN ('assistant', 'Assistant', 'system', 'System', 'model', 'Model')
               AS starter,
               role NOT IN ('assistant', 'Assistant', 'system', 'System', 'model', 'Model')
               AND nrole IS NOT NULL AND nrole <> role AS pairs FROM m""",
    ),
    "l": (
        ["p"],
        """SELECT *, max(CASE WHEN NOT pairs THEN pos END) OVER (PARTITION BY conv_id ORDER BY pos
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS single FROM p""",
    ),
    "turns": (
        ["l"],
        """SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY pos) - 1 AS turn_idx,
               role AS user_role, text AS user_text,
               CASE WHEN pairs AND ntext <> '' THEN nrole END AS assistant_role,
               CASE WHEN pairs THEN ntext ELSE '' END AS reply_text,
               'User: ' || text || CASE WHEN pairs AND ntext <> ''
                   THEN chr(10) || 'Assistant: ' || ntext ELSE '' END AS content,
               'd' || conv_id AS timestamp
           FROM l WHERE starter AND text <> '' AND (pos - coalesce(single, -1) - 1) % 2 = 0""",
    ),
    "cturns": (
        ["turns"],
        """SELECT *, conv_id // 10 AS coll, row_number() OVER (PARTITION BY conv_id // 10
               ORDER BY conv_id, turn_idx) - 1 AS seq FROM turns""",
    ),
    "notes": (
        ["cturns"],
        f"""SELECT coll, conv_id, seq, content, timestamp,
               sha256(coll || chr(31) || seq || chr(31) || content) AS id,
               'd' AS last_accessed, conv_id::VARCHAR AS note_category, 'General' AS context,
               ['conv_' || conv_id, 'session_s0'] AS tags, []::VARCHAR[] AS keywords,
               0 AS retrieval_count, {letters('content')} AS v
           FROM cturns""",
    ),
    "qas": (
        ["cturns"],
        f"""SELECT coll, conv_id, seq AS q_idx, coll || '_q' || seq AS question_id, user_text AS question,
               reply_text AS answer, (conv_id % 5)::VARCHAR AS category,
               coll * 1000000 + seq AS idx, {letters('user_text')} AS v
           FROM cturns WHERE reply_text <> ''""",
    ),
    "ranked": (
        ["qas", "notes"],
        f"""SELECT q.coll, q_idx, idx, question_id, category, q.conv_id, seq, id, content,
               {cosine('q.v', 'n.v')} AS distance,
               row_number() OVER (PARTITION BY q.coll, q_idx
                   ORDER BY {cosine('q.v', 'n.v')}, seq) AS rank
           FROM qas q JOIN notes n ON q.coll = n.coll""",
    ),
    "sqranked": (
        ["qas", "notes"],
        f"""SELECT q.coll, q_idx, idx, question_id, category, q.conv_id, seq, id, content,
               {l2sq('q.v', 'n.v')} AS distance,
               row_number() OVER (PARTITION BY q.coll, q_idx
                   ORDER BY {l2sq('q.v', 'n.v')}, seq) AS rank
           FROM qas q JOIN notes n ON q.coll = n.coll""",
    ),
    "own": (
        ["qas", "notes"],
        f"""SELECT q.conv_id, q_idx, id, {nonneg('1 - ' + cosine('q.v', 'n.v'))} AS score,
               row_number() OVER (PARTITION BY q.conv_id, q_idx
                   ORDER BY {cosine('q.v', 'n.v')}, seq) AS rank
           FROM qas q JOIN notes n ON q.conv_id = n.conv_id""",
    ),
    "near": (
        ["notes"],
        f"""SELECT * FROM (SELECT a.coll, a.seq, a.id AS note_id, b.seq AS neighbor_seq, b.id,
               {cosine('a.v', 'b.v')} AS distance,
               row_number() OVER (PARTITION BY a.coll, a.seq
                   ORDER BY {cosine('a.v', 'b.v')}, b.seq) AS rank
           FROM notes a JOIN notes b ON a.coll = b.coll AND b.seq < a.seq) WHERE rank <= 5""",
    ),
    "linked": (
        ["notes", "near"],
        """SELECT n.*, coalesce(x.ids, ['lost-' || n.coll]) AS links FROM notes n LEFT JOIN (
               SELECT note_id, list(id ORDER BY rank) AS ids FROM near WHERE rank <= 2 GROUP BY 1
           ) x ON x.note_id = n.id""",
    ),
    "edges": (
        ["linked"],
        """SELECT id AS src, unnest(links) AS dst, generate_subscripts(links, 1) - 1 AS pos
           FROM linked""",
    ),
    "rule": (
        ["near"],
        """SELECT note_id AS id, seq, min(distance) <= 0.02 AS should_evolve,
               list(id ORDER BY rank) AS connections, list('t' || rank ORDER BY rank) AS tags
           FROM near WHERE rank <= 2 GROUP BY note_id, seq""",
    ),
    "said": (
        ["notes"],
        """SELECT id, s.context AS news FROM notes n JOIN (
               SELECT conv_id, min(text) AS context FROM conversations WHERE role = 'system'
               GROUP BY 1) s USING (conv_id)""",
    ),
    # Matching of every retrieved chunk with the evidences, at ten chunks per question.
    "ev": (
        ["qas"],
        f"SELECT idx, norm, {words('norm')} AS toks FROM (SELECT idx, {norm('answer')} AS norm FROM qas)",
    ),
    "chunks": (
        ["ranked"],
        f"""SELECT *, {words('norm')} AS toks FROM (SELECT idx, question_id, category, rank,
               {norm('content')} AS norm FROM ranked WHERE rank <= 10)""",
    ),
    "ks": ([], "SELECT * FROM (VALUES (3, '3'), (5, '5'), (10, '10'), (1000000000, 'ALL')) t(k, k_label)"),
    "hit": (
        ["chunks", "ev"],
        f"""SELECT c.idx, question_id, category, rank,
               (contains(c.norm, e.norm) OR {covers('c.toks', 'e.toks')})::INT AS rel
           FROM chunks c JOIN ev e USING (idx)""",
    ),
    "per_k": (
        ["hit", "ks"],
        """SELECT idx, question_id, category, k, k_label, max(rel)::DOUBLE AS tp_evidence,
               count(*)::DOUBLE AS retrieved, 1.0::DOUBLE AS gold, sum(rel)::DOUBLE AS rel_chunks,
               sum(rel / log2(rank + 1)) AS dcg,
               coalesce((SELECT sum(1 / log2(r + 1)) FROM range(1, 11) t(r) WHERE r <= sum(rel)), 0) AS idcg
           FROM hit JOIN ks ON rank <= k GROUP BY ALL""",
    ),
    "scores": (
        ["per_k"],
        """SELECT *, CASE WHEN precision + recall > 0
               THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1
           FROM (SELECT *, rel_chunks / retrieved AS precision, tp_evidence / gold AS recall,
               CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0.0 END AS ndcg FROM per_k)""",
    ),
    "sums": (
        ["scores"],
        """SELECT CASE WHEN grouping(category) = 1 THEN 'overall' ELSE 'category' END AS section,
               category, k_label, count(*) AS n, avg(precision) AS macro_precision,
               avg(recall) AS macro_recall, avg(f1) AS macro_f1, avg(ndcg) AS macro_ndcg,
               sum(rel_chunks) / sum(retrieved) AS micro_precision,
               sum(tp_evidence) / sum(gold) AS micro_recall,
               CASE WHEN sum(idcg) > 0 THEN sum(dcg) / sum(idcg) ELSE 0.0 END AS micro_ndcg
           FROM scores GROUP BY GROUPING SETS ((k_label), (k_label, category))""",
    ),
    "avgs": (
        ["sums"],
        """SELECT *, CASE WHEN micro_precision + micro_recall > 0 THEN 2 * micro_precision *
               micro_recall / (micro_precision + micro_recall) ELSE 0.0 END AS micro_f1 FROM sums""",
    ),
    # Predictions: the whole text of the best chunk, cleaned.
    "pred": (
        ["ranked", "qas"],
        f"""SELECT q.idx AS row_id, q.category, CASE WHEN body = '' THEN 'N/A' ELSE body END AS prediction,
               q.answer AS reference
           FROM qas q JOIN (SELECT idx, {strip("regexp_replace(" + strip("array_to_string(list_filter(list_transform(string_split(content, chr(10)), lambda x: " + strip("x") + "), lambda x: x <> ''), chr(10))") + ", '<[^>]+>', '', 'g')")} AS body
               FROM ranked WHERE rank = 1) r ON q.idx = r.idx""",
    ),
}


def ngram_ctes(prefix: str, pred: str, ref: str, max_n: int) -> dict[str, tuple[list[str], str]]:
    """Token lists, n-grams and overlaps of predictions and references."""
    return {
        f"{prefix}_tok": (
            ["pred"],
            f"SELECT row_id, category, {pred} AS p, {ref} AS r FROM pred",
        ),
        f"{prefix}_grams": (
            [f"{prefix}_tok"],
            f"""SELECT row_id, category, n, side, unnest(list_transform(range(1, len(toks) - n + 2),
                   lambda i: array_to_string(toks[i:i + n - 1], ' '))) AS gram
               FROM (SELECT row_id, category, 'p' AS side, p AS toks FROM {prefix}_tok
                     UNION ALL SELECT row_id, category, 'r', r FROM {prefix}_tok),
                    range(1, {max_n + 1}) t(n)
               WHERE len(toks) >= n""",
        ),
        f"{prefix}_over": (
            [f"{prefix}_grams"],
            f"""SELECT row_id, category, n, sum(least(pc, rc)) AS overlap, sum(pc) AS pred_total,
                   sum(rc) AS ref_total
               FROM (SELECT row_id, category, n, gram, count(*) FILTER (side = 'p') AS pc,
                         count(*) FILTER (side = 'r') AS rc FROM {prefix}_grams GROUP BY ALL)
               GROUP BY row_id, category, n""",
        ),
    }


CTES |= ngram_ctes("ws", spaced("prediction"), spaced("reference"), 4)
CTES |= ngram_ctes("bl", spaced("prediction", False), spaced("reference", False), 4)


def spread_13a(name: str) -> str:
    """Punctuation set apart, ahead of splitting at spaces."""
    out = name
    for old, new in (
        ("'<skipped>'", "''"), ("'-' || chr(10)", "''"), ("chr(10)", "' '"), ("'&quot;'", "'\"'"),
        ("'&amp;'", "'&'"), ("'&lt;'", "'<'"), ("'&gt;'", "'>'"),
    ):
        out = f"replace({out}, {old}, {new})"
    out = f"(' ' || {out} || ' ')"
    for pattern, new in (
        (r"([!-&(-+/:-@\[-`{-~])", r" \1 "),
        (r"([^0-9])([.,])", r"\1 \2 "),
        (r"([.,])([^0-9])", r" \1 \2"),
        (r"([0-9])(-)", r"\1 \2 "),
    ):
        out = f"regexp_replace({out}, '{pattern}', '{new}', 'g')"
    return out


CTES |= ngram_ctes(
    "b13", spaced(spread_13a("prediction"), False), spaced(spread_13a("reference"), False), 4
)


def rouge_split(name: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({name}), '[^a-z0-9]+'), lambda t: t <> '')"


CTES |= ngram_ctes("ro", rouge_split("prediction"), rouge_split("reference"), 2)

# Longest common subsequence, one reference token per step: a cell is the running
# maximum of the cell above and, where tokens are equal, the upper left cell plus one.
CTES["lcs_refs"] = (
    ["ro_tok"],
    "SELECT row_id, unnest(r) AS tok, generate_subscripts(r, 1) AS i FROM ro_tok",
)
CTES["lcs_run"] = (
    ["lcs_refs"],
    """SELECT row_id, hash(unnest(p)) AS tok, generate_subscripts(p, 1) AS j, 0::BIGINT AS i,
           0::BIGINT AS best FROM ro_tok
       UNION ALL
       SELECT row_id, tok, j, i + 1, max(up) OVER (PARTITION BY row_id ORDER BY j)
       FROM (SELECT c.row_id, c.tok, c.j, c.i, greatest(best, CASE WHEN c.tok = hash(f.tok)
                 THEN coalesce(lag(best) OVER (PARTITION BY c.row_id ORDER BY j), 0) + 1 ELSE 0 END) AS up
             FROM lcs_run c JOIN lcs_refs f ON f.row_id = c.row_id AND f.i = c.i + 1)""",
)
CTES["lcs"] = (
    ["lcs_run"],
    "SELECT row_id, max(best) AS lcs FROM lcs_run GROUP BY row_id",
)


def f_score(overlap: str, pred: str, ref: str) -> str:
    o, p, r = f"({overlap})::DOUBLE", f"({pred})::DOUBLE", f"({ref})::DOUBLE"
    return f"(CASE WHEN {o} > 0 THEN 2 * ({o} / {p}) * ({o} / {r}) / ({o} / {p} + {o} / {r}) ELSE 0.0 END)"


CTES["rouge_rows"] = (
    ["ro_tok", "ro_over", "lcs"],
    f"""SELECT t.row_id, t.category,
           {f_score('coalesce(a.overlap, 0)', 'a.pred_total', 'a.ref_total')} AS rouge1,
           {f_score('coalesce(b.overlap, 0)', 'b.pred_total', 'b.ref_total')} AS rouge2,
           {f_score('coalesce(lcs, 0)', 'len(p)', 'len(r)')} AS "rougeL"
       FROM ro_tok t
       LEFT JOIN (SELECT * FROM ro_over WHERE n = 1) a ON a.row_id = t.row_id
       LEFT JOIN (SELECT * FROM ro_over WHERE n = 2) b ON b.row_id = t.row_id
       LEFT JOIN lcs ON lcs.row_id = t.row_id""",
)
CTES["f1_rows"] = (
    ["pred"],
    f"""SELECT row_id, category, CASE WHEN common = 0 THEN 0.0 ELSE
           2 * (common / len(p)) * (common / len(r)) / (common / len(p) + common / len(r)) END AS f1
       FROM (SELECT *, len(list_intersect(p, r))::DOUBLE AS common FROM (
           SELECT row_id, category, {spaced('prediction')} AS p, {spaced('reference')} AS r FROM pred))""",
)


def bleu(source: str, keys: str) -> str:
    """BLEU from overlaps grouped by ``keys``; zero orders get halving floors."""
    over = [f"coalesce(sum(overlap) FILTER (n = {n}), 0)" for n in range(1, 5)]
    total = [f"coalesce(sum(pred_total) FILTER (n = {n}), 0)" for n in range(1, 5)]
    cols = ", ".join(
        [f"{o} AS o{i}" for i, o in enumerate(over, 1)] + [f"{t} AS t{i}" for i, t in enumerate(total, 1)]
    )
    parts = []
    for i in range(1, 5):
        zeros = " + ".join(f"(o{j} = 0)::INT" for j in range(1, i + 1))
        parts.append(
            f"ln(CASE WHEN o{i} > 0 THEN o{i} / t{i}::DOUBLE ELSE 1 / (pow(2.0, {zeros}) * t{i}) END)"
        )
    logs = " + ".join(parts)
    return f"""SELECT *, CASE WHEN greatest(o1, o2, o3, o4) = 0 OR least(t1, t2, t3, t4) = 0 THEN 0.0
        ELSE (CASE WHEN t1 >= rl THEN 1.0 ELSE exp(1 - rl / t1::DOUBLE) END) * exp(({logs}) / 4) END AS bleu
        FROM (SELECT {keys} {cols}, coalesce(sum(ref_total) FILTER (n = 1), 0) AS rl
              FROM {source}"""


CTES["gen_bleu"] = (
    ["bl_over"],
    bleu("bl_over", "CASE WHEN grouping(category) = 1 THEN 'overall' ELSE 'category' END AS section, category,")
    + " GROUP BY GROUPING SETS ((), (category)))",
)
CTES["gen"] = (
    ["gen_bleu", "rouge_rows", "f1_rows"],
    """SELECT a.section, a.category, a.count, a.f1, b.bleu, a.rouge1, a.rouge2, a."rougeL" FROM (
           SELECT CASE WHEN grouping(f.category) = 1 THEN 'overall' ELSE 'category' END AS section,
               f.category, count(*) AS count, avg(f1) AS f1, avg(rouge1) AS rouge1,
               avg(rouge2) AS rouge2, avg("rougeL") AS "rougeL"
           FROM f1_rows f JOIN rouge_rows r USING (row_id)
           GROUP BY GROUPING SETS ((), (f.category))) a
       JOIN gen_bleu b ON a.section = b.section AND a.category IS NOT DISTINCT FROM b.category""",
)

RECURSIVE = {"lcs_run"}


def with_(names: list[str], body: str) -> str:
    """``body`` after the table expressions it needs."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for need in CTES[name][0]:
            visit(need)
        ordered.append(name)

    for name in names:
        visit(name)
    if not ordered:
        return body
    # Materialised once, as several are used more than once.
    parts = [
        f"{n} AS {'' if n in RECURSIVE else 'MATERIALIZED '}({CTES[n][1]})" for n in ordered
    ]
    head = "WITH RECURSIVE " if RECURSIVE & set(ordered) else "WITH "
    return head + ",\n".join(parts) + "\n" + body


def joined(name: str, alias: str | None = None) -> str:
    return f"coalesce(array_to_string({name}, ','), '') AS {alias or name}"


SIX = ["precision", "recall", "f1", "ndcg"]
AVERAGES = ", ".join(f"{nonneg(f'{s}_{m}')} AS {s}_{m}" for s in ("macro", "micro") for m in SIX)
AVG_NAMES = [f"{s}_{m}" for s in ("macro", "micro") for m in SIX]


def long(source: str, prefix: str, names: list[str], k: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{prefix}_' || section AS section, coalesce(category, 'ALL') AS category,
            {k} AS k_label, '{m}' AS metric, {nonneg(f'"{m}"::DOUBLE')} AS value FROM {source}"""
        for m in names
    )


CTES["long_avgs"] = (["avgs"], long("avgs", "retrieval", ["n", *AVG_NAMES], "k_label"))
CTES["long_gen"] = (
    ["gen"], long("gen", "generation", ["count", "f1", "bleu", "rouge1", "rouge2", "rougeL"], "'-'")
)


def renamed(names: list[str], suffix: str, source: str) -> None:
    """Copies of the evaluation chain over another ranked table."""
    chain = ["chunks", "hit", "per_k", "scores", "sums", "avgs", "long_avgs"]
    swap = {"ranked": source} | {n: f"{n}_{suffix}" for n in chain}
    for name in names:
        needs, body = CTES[name]
        for old in needs:
            if old in swap:
                for left in ("FROM ", "JOIN "):
                    body = body.replace(f"{left}{old} ", f"{left}{swap[old]} ").replace(
                        f"{left}{old})", f"{left}{swap[old]})"
                    )
                if body.endswith(f"FROM {old}"):
                    body = body[: -len(old)] + swap[old]
        CTES[f"{name}_{suffix}"] = ([swap.get(n, n) for n in needs], body)


renamed(["chunks", "hit", "per_k", "scores", "sums", "avgs", "long_avgs"], "sq", "sqranked")


SHORT_EVIDENCES = """SELECT item_id || '-part' AS item_id, substr(text, 3, 5) AS text FROM benchmark
    UNION ALL SELECT item_id || '-word', string_split(text, ' ')[1] FROM benchmark
    UNION ALL SELECT item_id || '-pair', substr(text, 1, 14) FROM benchmark
    UNION ALL SELECT 'empty-' || r_regionkey, '' FROM region"""


def corpus_matches(evidences: str) -> str:
    """Documents and the evidences (item_id, text) that they hold."""
    return f"""WITH d AS MATERIALIZED (
        SELECT doc_id, norm, list_distinct({words('norm')}) AS toks
        FROM (SELECT doc_id, {norm('text')} AS norm FROM documents)),
    b AS MATERIALIZED (
        SELECT item_id, norm, {words('norm')} AS toks
        FROM (SELECT item_id, {norm('text')} AS norm FROM ({evidences}))),
    need AS MATERIALIZED (
        SELECT item_id, len(toks) AS n, unnest(toks) AS tok FROM b),
    have AS MATERIALIZED (SELECT doc_id, unnest(toks) AS tok FROM d),
    share AS (
        SELECT doc_id, item_id FROM need JOIN have USING (tok)
        GROUP BY doc_id, item_id, n HAVING count(*) / n::DOUBLE >= 0.85)
    SELECT doc_id, item_id FROM share
    UNION
    SELECT doc_id, item_id FROM d JOIN b ON contains(d.norm, b.norm)"""


def build() -> dict[str, str]:
    cut = "list_filter(list_transform(string_split({x}, chr(10)), lambda x: {s}), lambda x: x <> '')"
    context = f"array_to_string({cut.format(x='chunk_text', s=strip('x'))}, chr(10))"

    def cleaned(kept: str) -> str:
        bare = strip(f"regexp_replace({strip(kept)}, '<[^>]+>', '', 'g')")
        return f"(CASE WHEN {bare} = '' THEN 'N/A' ELSE {bare} END)"

    sql = {
        "pair_turns": with_(
            ["turns"],
            "SELECT conv_id, turn_idx, 's0' AS session_id, user_role, assistant_role, content FROM turns",
        ),
        "turn_metadata": with_(
            ["turns"],
            """SELECT conv_id, turn_idx || '_' || timestamp AS turn_key,
                   'conv_' || conv_id || ',session_s0' AS tags,
                   sha256(conv_id || chr(31) || turn_idx || chr(31) || content) AS id FROM turns""",
        ),
        "conversations_without_turns": with_(
            ["turns"],
            """SELECT DISTINCT conv_id FROM conversations WHERE conv_id NOT IN
                   (SELECT conv_id FROM turns WHERE assistant_role = 'assistant')""",
        ),
        "shard_filter": with_(
            ["turns"], "SELECT conv_id, turn_idx, (conv_id % 3)::INT AS shard FROM turns"
        ),
        "skip_processed": with_(
            ["turns"],
            """SELECT conv_id, turn_idx, turn_idx || '_' || timestamp AS turn_key FROM turns
               WHERE reply_text <> '' AND conv_id NOT IN
                   (SELECT conv_id FROM conversations WHERE role = 'system')""",
        ),
        "explode_messages": """SELECT doc_id AS conv_id, session_pos, 'unknown' AS session_id,
                   lang AS timestamp, generate_subscripts(w, 1) - 1 AS msg_pos, unnest(w) AS content
               FROM (SELECT doc_id, lang, pos - 1 AS session_pos, string_split(line, ' ') AS w
                     FROM (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line,
                               generate_subscripts(string_split(text, chr(10)), 1) AS pos
                           FROM documents))""",
        "derive_questions": """SELECT doc_id AS conv_id, pos - 1 AS q_idx,
                   doc_id || '_q' || (pos - 1) AS question_id, line AS question, source AS answer,
                   lang AS evidences, 'unknown' AS category
               FROM (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS line,
                         generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)
               WHERE line <> ''""",
        "unindexed_questions": with_(
            ["qas"],
            """SELECT question_id FROM qas WHERE conv_id NOT IN
                   (SELECT conv_id FROM conversations WHERE role = 'system')""",
        ),
        "take_conversations": with_(
            ["turns"],
            """SELECT conv_id, turn_idx FROM turns WHERE conv_id IN
                   (SELECT DISTINCT conv_id FROM turns ORDER BY conv_id LIMIT 20)""",
        ),
        "limit_questions": with_(
            ["qas"],
            "SELECT conv_id, q_idx, question_id FROM qas ORDER BY conv_id, q_idx LIMIT 100",
        ),
        "normalize_text": f"""SELECT doc_id, norm, len({words('norm')}) AS n_words,
                   array_to_string(list_sort(list_distinct({words('norm')})), ' ') AS vocabulary
               FROM (SELECT doc_id, {norm('text')} AS norm FROM documents)""",
        "clean_answers": f"""SELECT page_id, {cleaned('html')} AS plain,
                   {cleaned('html')} AS after_thought, {cleaned('html')} AS before_thought,
                   'N/A' AS nothing FROM pages""",
        "token_f1": with_(["f1_rows"], f"SELECT row_id, {nonneg('f1')} AS f1 FROM f1_rows"),
        "note_lines": with_(
            ["notes"], f"SELECT id, {line()} AS line, {line(index='seq')} AS numbered FROM notes"
        ),
        "encode_metadata": with_(
            ["notes"],
            """SELECT id, id AS id_text, '["' || array_to_string(tags, '","') || '"]' AS tags_text,
                   '[]' AS keywords_text, context AS context_text, '0' AS retrieval_count_text FROM notes""",
        ),
        "decode_metadata": """SELECT event_id, (props->>'$.k')::BIGINT AS k, user_id AS user_number,
                   'BIGINT' AS user_type, event_type AS kind, 'STRING' AS kind_type FROM events""",
        "embed_letters": f"""SELECT doc_id, array_to_string(list_transform({letters('text')},
                   lambda x: x::INT), ',') AS v FROM documents""",
        "retrieve_topk": with_(
            ["ranked"],
            f"""SELECT coll, q_idx, seq, rank, distance, {nonneg('1 - distance')} AS score
                FROM ranked WHERE rank <= 10""",
        ),
        "retrieve_topk_vectors": f"""SELECT coll, q_id, vec_id, rank, distance,
                   {nonneg('1 - distance')} AS score FROM (
               SELECT a.label AS coll, a.vec_id AS q_id, b.vec_id, {l2sq('a.v', 'b.v')} AS distance,
                   row_number() OVER (PARTITION BY a.label, a.vec_id
                       ORDER BY {l2sq('a.v', 'b.v')}, b.vec_id) AS rank
               FROM (SELECT *, embedding::DOUBLE[] AS v FROM embeddings) a
               JOIN (SELECT *, embedding::DOUBLE[] AS v FROM embeddings) b ON a.label = b.label)
               WHERE rank <= 10""",
        "asof_neighbors": with_(
            ["near"],
            "SELECT coll, seq, neighbor_seq, rank - 1 AS neighbor_idx, distance FROM near",
        ),
        "asof_neighbors_vectors": f"""SELECT coll, vec_id, neighbor_seq, rank - 1 AS neighbor_idx,
                   distance FROM (
               SELECT a.label AS coll, a.vec_id, b.vec_id AS neighbor_seq,
                   {l2sq('a.v', 'b.v')} AS distance,
                   row_number() OVER (PARTITION BY a.label, a.vec_id
                       ORDER BY {l2sq('a.v', 'b.v')}, b.vec_id) AS rank
               FROM (SELECT *, embedding::DOUBLE[] AS v FROM embeddings) a
               JOIN (SELECT *, embedding::DOUBLE[] AS v FROM embeddings) b
                   ON a.label = b.label AND b.vec_id < a.vec_id) WHERE rank <= 5""",
        "search_hydrate": with_(
            ["ranked"],
            """SELECT coll, q_idx, rank, id, content, 'General' AS context, '' AS keywords, distance
               FROM ranked WHERE rank <= 5""",
        ),
        "related_text": with_(
            ["ranked", "notes"],
            f"""SELECT r.coll, q_idx, string_agg({line('n', 'rank - 1')}, '' ORDER BY rank) AS text,
                    count(*) AS n_lines
                FROM ranked r JOIN notes n ON n.id = r.id WHERE rank <= 5 GROUP BY ALL""",
        ),
        "search_with_links": with_(
            ["own", "edges", "notes"],
            """SELECT conv_id, q_idx, rank, id, score, is_neighbor FROM (
                   SELECT conv_id, q_idx, id, score, is_neighbor, row_number() OVER (
                       PARTITION BY conv_id, q_idx ORDER BY is_neighbor, a, b) AS rank
                   FROM (SELECT conv_id, q_idx, id, score, false AS is_neighbor, rank AS a, 0 AS b
                         FROM own WHERE rank <= 5
                         UNION ALL
                         SELECT conv_id, q_idx, dst, NULL, true, place.a, place.b FROM (
                             SELECT conv_id, q_idx, dst, min({'a': rank, 'b': pos}) AS place
                             FROM own JOIN edges ON src = own.id
                             WHERE rank <= 5 AND dst IN (SELECT id FROM notes)
                                 AND (conv_id, q_idx, dst) NOT IN
                                     (SELECT (conv_id, q_idx, id) FROM own WHERE rank <= 5)
                             GROUP BY ALL)))
               WHERE rank <= 5""",
        ),
        "related_with_links": with_(
            ["own", "edges", "notes"],
            f"""SELECT conv_id, q_idx, string_agg(line, '' ORDER BY rank, step) AS text,
                    count(*) AS n_lines
                FROM (SELECT o.conv_id, q_idx, rank, step, {line('n')} AS line FROM (
                    SELECT conv_id, q_idx, rank, 0 AS step, id FROM own WHERE rank <= 5
                    UNION ALL
                    SELECT conv_id, q_idx, rank, row_number() OVER (
                        PARTITION BY conv_id, q_idx, rank ORDER BY pos), dst
                    FROM own JOIN edges ON src = own.id
                    WHERE rank <= 5 AND dst IN (SELECT id FROM notes)) o
                    JOIN notes n ON n.id = o.id WHERE step <= 5)
                GROUP BY conv_id, q_idx""",
        ),
        "dangling_links": with_(
            ["edges", "notes"],
            "SELECT src, pos, dst FROM edges WHERE dst NOT IN (SELECT id FROM notes)",
        ),
        "hybrid_union": with_(
            ["ranked", "sqranked"],
            f"""SELECT coll, q_idx, rank, id, score, source FROM (
                    SELECT coll, q_idx, id, source, score, row_number() OVER (
                        PARTITION BY coll, q_idx ORDER BY source, r) AS rank
                    FROM (SELECT coll, q_idx, id, {nonneg('1 - distance')} AS score, rank AS r,
                              0 AS source FROM ranked WHERE rank <= 5
                          UNION ALL
                          SELECT s.coll, s.q_idx, s.id, {nonneg('1 - s.distance')}, s.rank, 1
                          FROM sqranked s WHERE s.rank <= 5 AND NOT EXISTS (
                              SELECT 1 FROM ranked r WHERE r.rank <= 5 AND r.coll = s.coll
                                  AND r.q_idx = s.q_idx AND r.id = s.id)))
                WHERE rank <= 8""",
        ),
        "update_notes": with_(
            ["notes", "said"],
            f"""SELECT id, content, context, category, array_to_string(list_transform(
                    {letters('content')}, lambda x: x::INT), ',') AS v
                FROM (SELECT n.id, CASE WHEN news IS NULL THEN content ELSE n.id || ' revised' END AS content,
                          coalesce(news, context) AS context, note_category AS category
                      FROM notes n LEFT JOIN said s ON s.id = n.id)""",
        ),
        "unknown_ids": with_(
            ["edges", "notes"],
            "SELECT DISTINCT dst AS id FROM edges WHERE dst NOT IN (SELECT id FROM notes)",
        ),
        "delete_notes": with_(
            ["notes", "said"], "SELECT id, content FROM notes WHERE id NOT IN (SELECT id FROM said)"
        ),
        "deletion_report": with_(
            ["edges", "notes"],
            """SELECT id, id IN (SELECT id FROM notes) AS found
               FROM (SELECT DISTINCT dst AS id FROM edges)""",
        ),
        "get_by_ids": with_(
            ["notes", "said"], "SELECT id, content FROM notes WHERE id IN (SELECT id FROM said)"
        ),
        "usage_counts": with_(
            ["notes", "ranked"],
            """SELECT n.id, coalesce(c, 0) AS retrieval_count, coalesce(t, 'd') AS last_accessed
               FROM notes n LEFT JOIN (SELECT id, count(*) AS c, max(lpad(q_idx::VARCHAR, 6, '0')) AS t
                   FROM ranked WHERE rank <= 5 GROUP BY 1) u ON u.id = n.id""",
        ),
        "consolidation_points": with_(
            ["notes", "rule"],
            """SELECT coll, seq, evolved_count::BIGINT AS evolved_count FROM (
                   SELECT coll, n.seq, should_evolve, sum(coalesce(should_evolve, false)::INT) OVER (
                       PARTITION BY coll ORDER BY n.seq) AS evolved_count
                   FROM notes n LEFT JOIN rule r ON r.id = n.id)
               WHERE should_evolve AND evolved_count % 3 = 0""",
        ),
        "consolidate": with_(
            ["notes", "said"],
            """SELECT n.id, content, coalesce(news, context) AS context,
                   CASE WHEN news IS NULL THEN note_category ELSE 'kept' END AS category
               FROM notes n LEFT JOIN said s ON s.id = n.id""",
        ),
        "evolution_rule": with_(
            ["rule"],
            f"SELECT id, seq, should_evolve, {joined('connections')}, {joined('tags')} FROM rule",
        ),
        "apply_evolution": with_(
            ["linked", "near", "rule"],
            f"""SELECT n.id, array_to_string(CASE WHEN o.id IS NULL THEN n.links
                       ELSE list_concat(n.links, o.connections) END, ',') AS links,
                    array_to_string(coalesce(t.tags, n.tags), ',') AS tags,
                    coalesce(c.context, n.context) AS context
                FROM linked n
                LEFT JOIN (SELECT * FROM rule WHERE should_evolve) o ON o.id = n.id
                LEFT JOIN (SELECT id, arg_max(tags, seq) AS tags FROM (
                    SELECT id, seq, tags FROM rule WHERE should_evolve
                    UNION ALL
                    SELECT x.id, r.seq, CASE WHEN rank = 1 THEN ['a' || r.seq]
                        ELSE ['b' || r.seq, 'near'] END
                    FROM rule r JOIN near x ON x.note_id = r.id WHERE should_evolve AND rank <= 2)
                    GROUP BY id) t ON t.id = n.id
                LEFT JOIN (SELECT x.id, arg_max('seen by ' || r.seq, r.seq) AS context
                    FROM rule r JOIN near x ON x.note_id = r.id WHERE should_evolve AND rank = 1
                    GROUP BY x.id) c ON c.id = n.id""",
        ),
        "frequent_terms": with_(
            ["notes"],
            f"""SELECT id, term, n_seen, term_rank FROM (
                    SELECT id, term, count(*) AS n_seen, row_number() OVER (
                        PARTITION BY id ORDER BY count(*) DESC, term) AS term_rank
                    FROM (SELECT id, unnest({words('lower(content)')}) AS term FROM notes)
                    GROUP BY id, term) WHERE term_rank <= 5""",
        ),
        "parse_decisions": """SELECT event_id,
                   CASE event_id % 3 WHEN 0 THEN replace(props, '"k":', '"should_evolve": true, "actions": [], "k":')
                       WHEN 1 THEN props ELSE left(props, -1) END AS inside,
                   event_id % 3 < 2 AS readable, event_id % 3 = 0 AS should_evolve,
                   0 AS n_actions FROM events""",
        "match_evidence": with_(
            ["hit"], "SELECT question_id, rank, rel AS n_held FROM hit"
        ),
        "match_evidence_corpus": corpus_matches("SELECT item_id, text FROM benchmark"),
        "match_evidence_short": corpus_matches(SHORT_EVIDENCES),
        "skipped_no_evidence": with_(
            ["turns"], "SELECT conv_id, turn_idx FROM turns WHERE reply_text = ''"
        ),
        "expand_cutoffs": with_(
            ["ranked", "ks"],
            """SELECT coll, q_idx, rank, seq, k_label FROM ranked JOIN ks ON rank <= k
               WHERE rank <= 10""",
        ),
        "retrieval_eval": with_(
            ["avgs"], f"SELECT section, category, k_label, n, {AVERAGES} FROM avgs"
        ),
        "retrieval_eval_empty": with_(
            ["ks"],
            "SELECT 'overall' AS section, NULL::VARCHAR AS category, k_label, 0 AS n, "
            + ", ".join(f"0.0::DOUBLE AS {n}" for n in AVG_NAMES)
            + " FROM ks",
        ),
        "bad_cases": with_(
            ["scores", "qas"],
            f"""SELECT k_label, b.idx, b.question_id, reason, question,
                    {', '.join(f'b.{m}' for m in SIX)}
                FROM (SELECT *, CASE WHEN recall < 0.5 THEN 'thresh:recall<0.5'
                          WHEN ndcg < 0.6 THEN 'thresh:ndcg<0.6' WHEN rf <= 20 THEN 'bottom:f1@20'
                          WHEN rp <= 30 THEN 'bottom:precision@30' END AS reason
                      FROM (SELECT *, row_number() OVER (PARTITION BY k_label ORDER BY f1, idx) AS rf,
                                row_number() OVER (PARTITION BY k_label ORDER BY precision, idx) AS rp
                            FROM (SELECT idx, question_id, k_label,
                                      {', '.join(f'{nonneg(m)} AS {m}' for m in SIX)} FROM scores))) b
                JOIN qas q ON q.idx = b.idx WHERE reason IS NOT NULL""",
        ),
        "ground_truth": with_(
            ["qas"],
            """SELECT w.conv_id, w.question_id, w.question, w.ground_truth FROM (
                   SELECT q.conv_id, CASE WHEN category < '3' THEN question_id
                           ELSE 'other-' || question_id END AS question_id,
                       CASE WHEN category = '4' THEN 'something else' ELSE question END AS question,
                       CASE WHEN category < '3' THEN answer WHEN category = '4' THEN NULL
                           ELSE (SELECT arg_max(answer, {'a': x.conv_id, 'b': x.q_idx}) FROM qas x
                                 WHERE x.question = q.question) END AS ground_truth
                   FROM qas q) w WHERE ground_truth IS NOT NULL""",
        ),
        "missing_ground_truth": with_(
            ["qas"],
            "SELECT conv_id, 'other-' || question_id AS question_id FROM qas WHERE category = '4'",
        ),
        "answer_prompts": with_(
            ["ranked", "qas"],
            f"""SELECT question_id, context, 'Use only these remembered notes to answer.' || chr(10)
                    || chr(10) || 'Notes:' || chr(10) || context || chr(10) || chr(10) || 'Question: '
                    || question || chr(10) || chr(10)
                    || 'Give the answer itself, short and without reasons:' AS prompt
                FROM (SELECT r.idx, {context} AS context FROM (
                    SELECT idx, string_agg(content, chr(10) || chr(10) ORDER BY rank) AS chunk_text
                    FROM ranked WHERE rank <= 5 GROUP BY idx) r) c JOIN qas q ON q.idx = c.idx""",
        ),
        "default_answers": with_(["pred"], "SELECT row_id, prediction FROM pred"),
        "ngram_overlap": with_(
            ["ws_over"],
            """SELECT row_id, n, overlap::BIGINT AS overlap, pred_total::BIGINT AS pred_total,
                   ref_total::BIGINT AS ref_total FROM ws_over""",
        ),
        "rouge": with_(
            ["rouge_rows"],
            f"""SELECT row_id, {nonneg('rouge1')} AS rouge1, {nonneg('rouge2')} AS rouge2,
                    {nonneg('"rougeL"')} AS "rougeL" FROM rouge_rows""",
        ),
        "bleu": with_(
            ["bl_over"], f"SELECT {nonneg('bleu')} AS bleu FROM ({bleu('bl_over', '')}))"
        ),
        "bleu_13a": with_(
            ["b13_over"], f"SELECT {nonneg('bleu')} AS bleu FROM ({bleu('b13_over', '')}))"
        ),
        "snapshot_copy": with_(["notes"], "SELECT id, content, coll AS conv_id FROM notes"),
        "evolution_prompts": with_(
            ["near", "notes"],
            f"""SELECT a.id, n_lines, 'A new note joins a collection of notes.' || chr(10) || 'Context: '
                    || a.context || chr(10) || 'Content: ' || a.content || chr(10) || 'Keywords: []'
                    || chr(10) || 'Its nearest notes:' || chr(10) || lines || chr(10)
                    || 'Decide whether the collection should change. The action ''strengthen'' links '
                    || 'the new note to others and sets its tags; the action ''update_neighbor'' gives '
                    || 'each nearest note new tags and a new context, in the order shown. '
                    || 'Number of nearest notes: ' || n_lines || chr(10)
                    || 'Reply with a JSON object holding should_evolve, actions, '
                    || 'suggested_connections, tags_to_update, new_context_neighborhood and '
                    || 'new_tags_neighborhood.' AS prompt
                FROM notes a JOIN (
                    SELECT note_id, count(*) AS n_lines, string_agg({line('n', 'x.rank - 1')}, '' ORDER BY x.rank) AS lines
                    FROM near x JOIN notes n ON n.id = x.id GROUP BY note_id) l ON l.note_id = a.id""",
        ),
        "greedy_match": f"""WITH t AS (SELECT vec_id // 10 AS row_id, vec_id % 2 AS side,
                   embedding::DOUBLE[] AS v, vec_id FROM embeddings),
               pairs AS MATERIALIZED (SELECT p.row_id, p.vec_id AS p, r.vec_id AS r,
                   {cosine('p.v', 'r.v')} AS d
                   FROM t p JOIN t r ON p.row_id = r.row_id AND p.side = 0 AND r.side = 1),
               s AS (SELECT * FROM
                   (SELECT row_id, avg(1 - d) AS precision FROM
                       (SELECT row_id, p, min(d) AS d FROM pairs GROUP BY ALL) GROUP BY 1)
                   JOIN (SELECT row_id, avg(1 - d) AS recall FROM
                       (SELECT row_id, r, min(d) AS d FROM pairs GROUP BY ALL) GROUP BY 1) USING (row_id))
               SELECT row_id, {nonneg('precision')} AS precision, {nonneg('recall')} AS recall,
                   {nonneg('CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END')} AS f1
               FROM s""",
        "generation_eval": with_(
            ["gen"],
            "SELECT section, category, count, "
            + ", ".join(f"{nonneg(f'{chr(34)}{m}{chr(34)}')} AS \"{m}\"" for m in ("f1", "bleu", "rouge1", "rouge2", "rougeL"))
            + " FROM gen",
        ),
        "index_summary": with_(
            ["turns"],
            """SELECT conv_id, count(*) AS num_turns, count(*) AS num_indexed, 'letters' AS encoder
               FROM turns GROUP BY conv_id""",
        ),
        "run_totals": with_(
            ["qas", "ranked"],
            """SELECT count(DISTINCT conv_id) AS conversations, count(*) AS questions_total,
                   count(*) AS questions_processed,
                   (SELECT count(*) FROM ranked WHERE rank <= 10) AS chunks_total FROM qas""",
        ),
        "scoreboard": with_(
            ["long_avgs", "long_gen"], "SELECT * FROM long_avgs UNION ALL SELECT * FROM long_gen"
        ),
        "compare_runs": with_(
            ["long_avgs", "long_avgs_sq"],
            f"""SELECT a.section, a.category, a.k_label, a.metric, a.value AS value_a,
                    b.value AS value_b, {nonneg('b.value - a.value')} AS delta
                FROM long_avgs a JOIN long_avgs_sq b USING (section, category, k_label, metric)""",
        ),
    }
    counts = f"""SELECT question_id, k_label, {{}} FROM (
        SELECT *, CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0.0 END AS ndcg,
            rel_chunks / retrieved AS precision, tp_evidence / gold AS recall,
            tp_evidence / retrieved AS legacy_precision
        FROM (SELECT question_id, k_label, count(DISTINCT CASE WHEN rel = 1 THEN norm END)::DOUBLE AS tp_evidence,
            count(DISTINCT rank)::DOUBLE AS retrieved, 3.0::DOUBLE AS gold,
            count(DISTINCT CASE WHEN rel = 1 THEN rank END)::DOUBLE AS rel_chunks,
            coalesce(sum(CASE WHEN first AND any_rel = 1 THEN 1 / log2(rank + 1) END), 0) AS dcg,
            coalesce((SELECT sum(1 / log2(r + 1)) FROM range(1, 11) t(r)
                      WHERE r <= count(DISTINCT CASE WHEN rel = 1 THEN rank END)), 0) AS idcg
        FROM (SELECT *, max(rel) OVER (PARTITION BY idx, rank) AS any_rel,
                  row_number() OVER (PARTITION BY idx, rank ORDER BY norm) = 1 AS first FROM two)
        JOIN ks ON rank <= k GROUP BY question_id, k_label))"""
    CTES["two"] = (
        ["chunks", "qas"],
        f"""SELECT c.idx, c.question_id, c.rank, e.norm,
                (contains(c.norm, e.norm) OR {covers('c.toks', 'e.toks')})::INT AS rel
            FROM chunks c JOIN (SELECT DISTINCT idx, norm, {words('norm')} AS toks FROM (
                SELECT idx, {norm('answer')} AS norm FROM qas
                UNION ALL SELECT idx, {norm('question')} FROM qas)) e USING (idx)""",
    )
    names = ["tp_evidence", "retrieved", "gold", "rel_chunks", "dcg", "idcg"]
    sql["retrieval_counts"] = with_(
        ["two", "ks"], counts.format(", ".join(f"{nonneg(n)} AS {n}" for n in names))
    )

    def f1(p: str) -> str:
        return f"CASE WHEN {p} + recall > 0 THEN 2 * {p} * recall / ({p} + recall) ELSE 0.0 END"

    metrics = {
        "legacy_precision": "legacy_precision",
        "legacy_f1": f1("legacy_precision"),
        "precision": "precision",
        "recall": "recall",
        "f1": f1("precision"),
        "ndcg": "ndcg",
    }
    sql["retrieval_metrics_per_record"] = with_(
        ["two", "ks"], counts.format(", ".join(f"{nonneg(e)} AS {n}" for n, e in metrics.items()))
    )
    return sql
