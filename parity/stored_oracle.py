"""DuckDB twins of ``parity.stored``: what the written and streamed forms must amount to."""

from __future__ import annotations

import re

from parity.oracle import AVERAGES, AVG_NAMES, CTES, RECURSIVE, SIX, SPACE, covers, ngram_ctes, nonneg, with_, words

# Records by file: which chunks are readable, and their ranks once the others are left out.
CTES["s_chunks"] = (
    ["chunks"],
    """SELECT CASE WHEN category::INT < 2 THEN 'plain' ELSE 'objects' END AS source, idx, question_id, category,
           row_number() OVER (PARTITION BY idx ORDER BY rank) AS rank, norm, toks
       FROM chunks WHERE category::INT < 2 OR (category::INT < 4 AND (rank - 1) % 6 < 5)""",
)
CTES["s_hit"] = (
    ["s_chunks", "ev"],
    f"""SELECT c.source, c.idx, question_id, category, rank,
           (contains(c.norm, e.norm) OR {covers('c.toks', 'e.toks')})::INT AS rel
       FROM s_chunks c JOIN ev e USING (idx)""",
)
CTES["s_per_k"] = (
    ["s_hit", "ks"],
    """SELECT source, idx, question_id, category, k, k_label, max(rel)::DOUBLE AS tp_evidence,
           count(*)::DOUBLE AS retrieved, 1.0::DOUBLE AS gold, sum(rel)::DOUBLE AS rel_chunks,
           sum(rel / log2(rank + 1)) AS dcg,
           coalesce((SELECT sum(1 / log2(r + 1)) FROM range(1, 11) t(r) WHERE r <= sum(rel)), 0) AS idcg
       FROM s_hit JOIN ks ON rank <= k GROUP BY ALL""",
)
CTES["s_scores"] = (
    ["s_per_k"],
    """SELECT *, CASE WHEN precision + recall > 0
           THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1
       FROM (SELECT *, rel_chunks / retrieved AS precision, tp_evidence / gold AS recall,
           CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0.0 END AS ndcg FROM s_per_k)""",
)
CTES["s_sums"] = (
    ["s_scores"],
    """SELECT source, CASE WHEN grouping(category) = 1 THEN 'overall' ELSE 'category' END AS section,
           category, k_label, count(*) AS n, avg(precision) AS macro_precision,
           avg(recall) AS macro_recall, avg(f1) AS macro_f1, avg(ndcg) AS macro_ndcg,
           sum(rel_chunks) / sum(retrieved) AS micro_precision,
           sum(tp_evidence) / sum(gold) AS micro_recall,
           CASE WHEN sum(idcg) > 0 THEN sum(dcg) / sum(idcg) ELSE 0.0 END AS micro_ndcg
       FROM s_scores GROUP BY GROUPING SETS ((source, k_label), (source, k_label, category))""",
)
CTES["s_avgs"] = (
    ["s_sums"],
    """SELECT *, CASE WHEN micro_precision + micro_recall > 0 THEN 2 * micro_precision *
           micro_recall / (micro_precision + micro_recall) ELSE 0.0 END AS micro_f1 FROM s_sums""",
)
CTES["s_lists"] = (
    ["ranked", "qas"],
    """SELECT q.question_id, q.question, q.answer, q.category, q.coll, r.content, r.rank, r.id
       FROM ranked r JOIN qas q USING (idx) WHERE rank <= 10""",
)


# ---- stems, as a dictionary of the distinct tokens -----------------------------------
# Porter's rules step by step on (w, sh): the word, and its letters as v or c.

IRREGULAR = {
    "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news",
    "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
    "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed",
    "exceed": "exceed", "succeed": "succeed",
}
SECOND = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble",
    "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate",
    "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al",
    "iviti": "ive", "biliti": "ble", "fulli": "ful", "logi": "log",
}
THIRD = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
FOURTH = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism",
    "ate", "iti", "ous", "ive", "ize",
]


def shape(word: str) -> str:
    """Consonants c, vowels v; of a run of y, resolved from the left, every one depends on the letter before."""
    out = f"regexp_replace(regexp_replace({word}, '[^aeiouy]', 'c', 'g'), '[aeiou]', 'v', 'g')"
    out = f"regexp_replace({out}, '^y', 'c')"
    for _ in range(6):
        out = f"replace(replace({out}, 'cy', 'cv'), 'vy', 'vc')"
    return out


def head(cut: int, what: str = "w") -> str:
    return f"left({what}, length(w)::INT - {cut})"


def measure(cut: int) -> str:
    return f"len(regexp_extract_all({head(cut, 'sh')}, 'v+c+'))"


def short_end(cut: int) -> str:
    return f"({head(cut, 'sh')} = 'vc' OR (ends_with({head(cut, 'sh')}, 'cvc') AND right({head(cut)}, 1) NOT IN ('w', 'x', 'y')))"


def swap(table: dict[str, str]) -> str:
    cases = []
    for suffix in sorted(table, key=len, reverse=True):
        kept = len(suffix) - (suffix == "logi")
        cases.append(f"WHEN ends_with(w, '{suffix}') THEN CASE WHEN {measure(kept)} > 0 THEN {head(len(suffix))} || '{table[suffix]}' ELSE w END")
    return f"CASE {' '.join(cases)} ELSE w END"


def past() -> str:
    cases = [
        "WHEN ends_with(w, 'ied') THEN " + f"CASE WHEN length(w) = 4 THEN {head(1)} ELSE {head(2)} END",
        "WHEN ends_with(w, 'eed') THEN " + f"CASE WHEN {measure(3)} > 0 THEN {head(1)} ELSE w END",
    ]
    for suffix in ("ed", "ing"):
        n = len(suffix)
        double = f"length(w) > {n + 1} AND right({head(n)}, 1) = right({head(n + 1)}, 1) AND right({head(n, 'sh')}, 1) = 'c'"
        cases.append(
            f"WHEN ends_with(w, '{suffix}') AND contains({head(n, 'sh')}, 'v') THEN CASE "
            f"WHEN regexp_matches({head(n)}, '(at|bl|iz)$') THEN {head(n)} || 'e' "
            f"WHEN {double} THEN CASE WHEN right({head(n)}, 1) IN ('l', 's', 'z') THEN {head(n)} ELSE {head(n + 1)} END "
            f"WHEN {measure(n)} = 1 AND {short_end(n)} THEN {head(n)} || 'e' ELSE {head(n)} END"
        )
    return f"CASE {' '.join(cases)} ELSE w END"


def residue() -> str:
    cases = []
    for suffix in sorted(FOURTH, key=len, reverse=True):
        n = len(suffix)
        ion = f" AND right({head(n)}, 1) IN ('s', 't')" if suffix == "ion" else ""
        cases.append(f"WHEN ends_with(w, '{suffix}') THEN CASE WHEN {measure(n)} > 1{ion} THEN {head(n)} ELSE w END")
    return f"CASE {' '.join(cases)} ELSE w END"


STEPS = [
    f"""CASE WHEN length(w) = 4 AND ends_with(w, 'ies') THEN {head(1)}
        WHEN ends_with(w, 'sses') OR ends_with(w, 'ies') THEN {head(2)}
        WHEN ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN {head(1)} ELSE w END""",
    past(),
    f"CASE WHEN ends_with(w, 'y') AND length(w) > 2 AND right({head(1, 'sh')}, 1) = 'c' THEN {head(1)} || 'i' ELSE w END",
    swap(SECOND),
    f"CASE WHEN again THEN {swap(SECOND)} ELSE w END",  # what is left of an alli once more
    swap(THIRD),
    residue(),
    f"""CASE WHEN ends_with(w, 'e') AND ({measure(1)} > 1 OR ({measure(1)} = 1 AND NOT {short_end(1)}))
        THEN {head(1)} ELSE w END""",
    f"CASE WHEN ends_with(w, 'll') AND {measure(0)} > 1 THEN {head(1)} ELSE w END",
]
CTES["stem0"] = (
    ["ro_tok"],
    f"""SELECT tok, tok AS w, {shape('tok')} AS sh, false AS again FROM (
           SELECT DISTINCT unnest(list_concat(p, r)) AS tok FROM ro_tok)
       WHERE length(tok) > 3 AND tok NOT IN ({', '.join(f"'{w}'" for w in IRREGULAR)})""",
)
for number, step in enumerate(STEPS, 1):
    CTES[f"stem{number}"] = (
        [f"stem{number - 1}"],
        f"""SELECT tok, w, {shape('w')} AS sh, again FROM (
               SELECT tok, {step} AS w, ends_with(w, 'alli') AND w <> {step} AS again FROM stem{number - 1})""",
    )
CTES["stems"] = (
    [f"stem{len(STEPS)}"],
    f"SELECT tok, w FROM stem{len(STEPS)} UNION ALL SELECT * FROM (VALUES {', '.join(str((a, b)) for a, b in IRREGULAR.items())}) t(tok, w)",
)
CTES["ros_long"] = (
    ["ro_tok"],
    """SELECT row_id, category, 'p' AS side, unnest(p) AS tok, generate_subscripts(p, 1) AS i FROM ro_tok
       UNION ALL SELECT row_id, category, 'r', unnest(r), generate_subscripts(r, 1) FROM ro_tok""",
)
CTES |= {name: body for name, body in ngram_ctes("ros", "prediction", "reference", 2).items() if name != "ros_tok"}
CTES["ros_tok"] = (
    ["ros_long", "stems", "ro_tok"],
    """SELECT t.row_id, t.category, coalesce(s.p, []) AS p, coalesce(s.r, []) AS r FROM ro_tok t LEFT JOIN (
           SELECT row_id, list(coalesce(w, tok) ORDER BY i) FILTER (side = 'p') AS p,
               list(coalesce(w, tok) ORDER BY i) FILTER (side = 'r') AS r
           FROM (SELECT l.*, s.w FROM ros_long l LEFT JOIN stems s ON s.tok = l.tok) GROUP BY row_id) s
       ON s.row_id = t.row_id""",
)
for name in ("lcs_refs", "lcs_run", "lcs", "rouge_rows"):
    needs, body = CTES[name]
    swaps = {"ro_tok": "ros_tok", "ro_over": "ros_over", "lcs_refs": "slcs_refs", "lcs_run": "slcs_run", "lcs": "slcs"}
    for old, new in swaps.items():
        body = re.sub(rf"\b(FROM|JOIN) {old}\b", rf"\1 {new}", body)
    body = body.replace("lcs.row_id", "slcs.row_id")
    CTES[f"s{name}"] = ([swaps.get(n, n) for n in needs], body)
RECURSIVE.add("slcs_run")


def build(sql: dict[str, str]) -> dict[str, str]:
    """The twins; ``sql`` has those of the unstored forms."""
    six = ", ".join(f"{nonneg(m)} AS {m}" for m in SIX)
    zeros = ", ".join(f"0.0::DOUBLE AS {name}" for name in AVG_NAMES)
    label = "'(?i)\\b(user|assistant)\\s*:\\s*'"
    folded = f"nfc_normalize(regexp_replace(text, {label}, '', 'g'))"
    return {
        "stored_update": sql["update_notes"],
        "stored_delete": sql["delete_notes"],
        "stored_consolidate": sql["consolidate"],
        "stored_conversations": with_(
            ["notes"], "SELECT coll AS conv_id, 1 AS n, id FROM notes WHERE seq = 0 AND coll % 2 = 1"
        ),
        "streamed_turns": with_(["notes"], "SELECT coll, seq, id, content FROM notes"),
        "streamed_sessions": with_(
            ["cturns"],
            """SELECT c.coll, sessions, coalesce(turns, 0) AS turns
               FROM (SELECT conv_id // 10 AS coll, count(DISTINCT conv_id) AS sessions FROM conversations GROUP BY 1) c
               LEFT JOIN (SELECT coll, count(*) AS turns FROM cturns GROUP BY 1) t USING (coll)""",
        ),
        "streamed_notes": with_(
            ["notes"], "SELECT coll, seq, id, content, seq || '_' || timestamp AS turn_key FROM notes"
        ),
        "streamed_neighbors": sql["asof_neighbors"],
        "streamed_consolidation_points": sql["consolidation_points"],
        "dataset_messages": """SELECT conv_id::VARCHAR AS conv_id, 0 AS session_pos, 's0' AS session_id,
                   'd' || conv_id AS timestamp, turn AS msg_pos, role, text AS content FROM conversations""",
        "dataset_questions": """SELECT conv_id::VARCHAR AS conv_id, 0 AS q_idx, conv_id || '_q0' AS question_id,
                   'what ' || conv_id AS question, conv_id::VARCHAR AS answer,
                   coalesce(arg_min(text, turn), '') AS evidences, 'unknown' AS category
               FROM conversations GROUP BY conv_id""",
        "quarantined_lines": """SELECT '{"conv_id": "' || conv_id AS line
               FROM (SELECT DISTINCT conv_id FROM conversations WHERE role = 'system')""",
        "mixed_records": with_(
            ["s_lists"],
            """SELECT source, question_id, question, answer, CASE WHEN source = 'bare' THEN 'unknown' ELSE category END AS category,
                   coll::VARCHAR AS conv_id, string_agg(content, '|' ORDER BY rank) AS chunks,
                   CASE WHEN source = 'bare' THEN '' ELSE answer END AS evidences
               FROM (SELECT *, CASE WHEN category::INT < 2 THEN 'plain' WHEN category::INT < 4 THEN 'objects'
                         ELSE 'bare' END AS source FROM s_lists)
               WHERE source <> 'objects' OR (rank - 1) % 6 < 5
               GROUP BY source, question_id, question, answer, category, coll""",
        ),
        "failed_records": with_(
            ["qas"],
            """SELECT 'plain' AS source, '{"question_id": "' || question_id AS line FROM qas WHERE category = '0'""",
        ),
        "retrieval_eval_by_source": with_(
            ["s_avgs", "ks", "qas"],
            f"""SELECT source, section, category, k_label, n, {AVERAGES} FROM s_avgs
                UNION ALL SELECT 'bare', 'overall', NULL, k_label, 0, {zeros} FROM ks
                WHERE EXISTS (SELECT 1 FROM qas WHERE category = '4')""",
        ),
        "skipped_by_source": with_(["qas"], "SELECT 'bare' AS source, question_id FROM qas WHERE category = '4'"),
        "bad_cases_by_source": with_(
            ["s_scores", "qas"],
            f"""SELECT b.source, b.k_label AS k, b.question_id, reason, question, {', '.join(f'b.{m}' for m in SIX)}, b.f1 AS flat_f1
                FROM (SELECT *, CASE WHEN recall < 0.5 THEN 'thresh:recall<0.5' WHEN place <= 7 THEN 'bottom:f1@7' END AS reason
                      FROM (SELECT *, row_number() OVER (PARTITION BY source, k_label ORDER BY f1, question_id) AS place
                            FROM (SELECT source, question_id, k_label, {six} FROM s_scores))) b
                JOIN qas q ON q.question_id = b.question_id WHERE reason IS NOT NULL""",
        ),
        "records_round_trip": with_(
            ["s_lists"],
            """SELECT question_id, coll::VARCHAR AS conv_id, question, answer, category,
                   string_agg(content, '|' ORDER BY rank) AS chunks, answer AS evidences
               FROM s_lists WHERE rank <= 5 GROUP BY question_id, coll, question, answer, category""",
        ),
        "projected_chunks": with_(
            ["notes"],
            """SELECT id, content, CASE WHEN seq % 3 = 1 THEN array_to_string(tags, ',') ELSE '' END AS tags,
                   '' AS keywords, CASE WHEN seq % 3 = 0 THEN context ELSE '' END AS context FROM notes""",
        ),
        "eval_report": with_(
            ["s_scores", "qas", "ks"],
            f"""SELECT k_label, count(s.idx) AS n, {nonneg('coalesce(avg(f1), 0)')} AS macro_f1
                FROM ks LEFT JOIN s_scores s USING (k_label) GROUP BY k_label
                UNION ALL SELECT 'meta', 1, 0.0
                UNION ALL SELECT 'category', count(DISTINCT k_label || '/' || category), 0.0 FROM s_scores
                UNION ALL SELECT 'per_record', count(*), 0.0 FROM s_scores
                UNION ALL SELECT 'skipped', count(*), 0.0 FROM qas WHERE category = '4'
                UNION ALL SELECT 'failed', count(*), 0.0 FROM qas WHERE category = '0'""",
        ),
        "generation_report": with_(
            ["gen", "pred"],
            "SELECT coalesce(g.category, 'ALL') AS category, g.count, "
            + ", ".join(f"{nonneg(f'g.{chr(34)}{m}{chr(34)}')} AS \"{m}\"" for m in ("f1", "bleu", "rouge1", "rouge2", "rougeL"))
            + """, answers FROM gen g
                 LEFT JOIN (SELECT category, count(*) AS answers FROM pred GROUP BY 1) p ON p.category = g.category""",
        ),
        "report_order": with_(
            ["long_avgs"],
            """SELECT section, category, k_label, row_number() OVER (ORDER BY section DESC, category NULLS FIRST,
                   try_cast(k_label AS INT) NULLS LAST) AS line FROM long_avgs WHERE metric = 'macro_f1'""",
        ),
        "analyzed_notes": with_(
            ["notes"],
            f"""SELECT n.id, coalesce(k.keywords, '') AS keywords, 'General' AS context, '' AS tags FROM notes n
                LEFT JOIN (SELECT id, string_agg(term, ',' ORDER BY place) AS keywords FROM (
                    SELECT id, term, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, term) AS place
                    FROM (SELECT id, unnest({words('lower(content)')}) AS term FROM notes) GROUP BY id, term)
                    WHERE place <= 4 GROUP BY id) k ON k.id = n.id""",
        ),
        "parsed_analysis": """SELECT event_id, CASE WHEN event_id % 4 < 2 THEN event_type || ',b' ELSE '' END AS keywords,
                   CASE WHEN event_id % 4 < 2 THEN 'about ' || event_type ELSE 'General' END AS context,
                   CASE WHEN event_id % 4 < 2 THEN 'x' ELSE '' END AS tags FROM events""",
        "analysis_prompts": with_(
            ["notes"],
            """SELECT id, 'Read the note and describe it as a JSON object with these fields:' || chr(10)
                   || 'keywords: list of its key terms, the most telling first;' || chr(10)
                   || 'context: one sentence on topic, main points and purpose;' || chr(10)
                   || 'tags: list of broad labels for sorting it.' || chr(10) || chr(10) || 'Note:' || chr(10)
                   || content AS prompt FROM notes""",
        ),
        "empty_replies": """SELECT event_id, '{"should_evolve":false,"actions":[],"suggested_connections":[],'
                   || '"tags_to_update":[],"new_context_neighborhood":[],"new_tags_neighborhood":[]}' AS reply FROM events""",
        "note_times": """SELECT event_id, CASE event_id % 3 WHEN 0 THEN strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S')
                   WHEN 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS time FROM events""",
        "folded_text": f"""SELECT doc_id, lower(trim(regexp_replace(translate({folded}, '’“”' || chr(160), '''\"\" '),
                   '{SPACE}', ' ', 'g'))) AS norm FROM documents""",
        "rouge_stemmed": with_(
            ["srouge_rows"],
            f"""SELECT row_id, {nonneg('rouge1')} AS rouge1, {nonneg('rouge2')} AS rouge2,
                    {nonneg('"rougeL"')} AS "rougeL" FROM srouge_rows""",
        ),
        "coerced_evidences": with_(["s_hit"], "SELECT question_id, rank, rel AS n_held FROM s_hit"),
    }
