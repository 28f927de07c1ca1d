"""One query per operator, each over whole driver tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parity import fixtures as fx
from recallgrid.functions import metadata, text
from recallgrid.functions.vectors import embed, letter_counts, letter_encoder
from recallgrid.operators import (
    answer_metrics,
    answers,
    evolution,
    ledger,
    matching,
    neighbors,
    questions,
    reports,
    retrieval_metrics,
    search,
    turns,
)
from recallgrid.operators import notes as notes_ops
from recallgrid.session import shared_dir
from recallgrid.sources import collections

Query = Callable[[SparkSession, str], DataFrame]
KS = retrieval_metrics.parse_cutoffs([3, 5, 10, "all"])
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def six(name: str):
    """A double at six decimals, without negative zero."""
    value = F.round(F.col(name), 6)
    return F.when(value == 0, F.lit(0.0)).otherwise(value).alias(name)


def joined(name: str):
    return F.array_join(name, ",").alias(name)


# ---- turns and progress -----------------------------------------------------------


@query
def pair_turns(spark, sf):
    return fx.turns(spark, sf).select(
        "conv_id", "turn_idx", "session_id", "user_role", "assistant_role", "content"
    )


@query
def turn_metadata(spark, sf):
    made = ledger.with_turn_key(fx.turns(spark, sf))
    tags = turns.turn_tags(F.col("conv_id"), F.col("session_id"))
    note = text.note_id(F.col("conv_id"), F.col("turn_idx"), F.col("content"))
    return made.select(
        "conv_id", "turn_key", F.array_join(tags, ",").alias("tags"), note.alias("id")
    )


@query
def conversations_without_turns(spark, sf):
    messages = fx.messages(spark, sf)
    kept = fx.turns(spark, sf).filter(F.col("assistant_role") == "assistant")
    return turns.conversations_without_turns(messages.select("conv_id").distinct(), kept)


@query
def shard_filter(spark, sf):
    found = fx.turns(spark, sf).select("conv_id", "turn_idx")
    shards = [
        ledger.shard_filter(found, 3, i, "conv_id").withColumn("shard", F.lit(i)) for i in range(3)
    ]
    return shards[0].unionByName(shards[1]).unionByName(shards[2])


@query
def skip_processed(spark, sf):
    """Conversations with a system message are done; so are turns without a reply."""
    found = fx.turns(spark, sf)
    done = fx.messages(spark, sf).filter(F.col("role") == "system")
    processed = ledger.with_turn_key(found.filter(F.col("reply_text") == ""))
    left = ledger.skip_processed_turns(ledger.skip_completed(found, done), processed)
    return left.select("conv_id", "turn_idx", "turn_key")


@query
def explode_messages(spark, sf):
    """Every document read as a conversation: lines are sessions, words are messages."""
    docs = fx.texts(spark, sf, "documents")
    sessions = F.transform(
        F.split("text", "\n"),
        lambda line: F.struct(
            F.lit(None).cast("string").alias("session_id"),
            F.col("lang").alias("datetime"),
            F.transform(
                F.split(line, " "),
                lambda w: F.struct(F.lit(None).cast("string").alias("role"), w.alias("content")),
            ).alias("messages"),
        ),
    )
    data = docs.select(F.col("doc_id").alias("conv_id"), sessions.alias("dialogs"))
    return turns.explode_messages(data).select(
        "conv_id", "session_pos", "session_id", "timestamp", "msg_pos", "content"
    )


@query
def derive_questions(spark, sf):
    """Every document read as a conversation whose lines are its questions."""
    docs = fx.texts(spark, sf, "documents")
    none = F.lit(None).cast("string")
    qas = F.transform(
        F.split("text", "\n"),
        lambda line: F.struct(
            none.alias("question_id"),
            line.alias("question"),
            F.col("source").alias("answer"),
            F.array(F.col("lang")).alias("evidences"),
            none.alias("category"),
        ),
    )
    data = docs.select(F.col("doc_id").alias("conv_id"), qas.alias("qas"))
    asked = questions.askable(questions.explode_questions(data))
    return asked.select(
        "conv_id", "q_idx", "question_id", "question", "answer", joined("evidences"), "category"
    )


@query
def unindexed_questions(spark, sf):
    """Questions against an index that holds only conversations with a system message."""
    stored = fx.messages(spark, sf).filter(F.col("role") == "system")
    return questions.unindexed_questions(fx.questions(spark, sf), stored).select("question_id")


@query
def take_conversations(spark, sf):
    found = fx.turns(spark, sf).select("conv_id", "turn_idx")
    return questions.take_conversations(found, 20, "conv_id")


@query
def limit_questions(spark, sf):
    asked = fx.questions(spark, sf).select("conv_id", "q_idx", "question_id")
    return questions.limit_questions(asked, 100, "conv_id", "q_idx")


# ---- text ---------------------------------------------------------------------------


@query
def normalize_text(spark, sf):
    docs = fx.texts(spark, sf, "documents")
    norm = text.evidence_form(F.col("text"), nfkc=False)
    words = text.word_tokens(norm)
    return docs.select(
        "doc_id",
        norm.alias("norm"),
        F.size(words).alias("n_words"),
        F.array_join(F.array_sort(F.array_distinct(words)), " ").alias("vocabulary"),
    )


@query
def clean_answers(spark, sf):
    pages = fx.texts(spark, sf, "pages").select("page_id", "url", "html")
    replies = F.concat(F.lit("<think>"), "url", F.lit("</think>"), "html")
    open_ended = F.concat("html", F.lit("<think>"), "url")
    return pages.select(
        "page_id",
        text.clean_answer(F.col("html")).alias("plain"),
        text.clean_answer(replies).alias("after_thought"),
        text.clean_answer(open_ended).alias("before_thought"),
        text.clean_answer(F.lit("<b></b>")).alias("nothing"),
    )


@query
def token_f1(spark, sf):
    scores = fx.answers(spark, sf).withColumn(
        "f1", text.token_f1(F.col("prediction"), F.col("reference"))
    )
    return scores.select("row_id", six("f1"))


@query
def note_lines(spark, sf):
    return fx.notes(spark, sf).select(
        "id", text.note_line().alias("line"), text.note_line(F.col("seq")).alias("numbered")
    )


@query
def encode_metadata(spark, sf):
    """Note fields as the string map a collection stores."""
    fields = ["id", "tags", "keywords", "context", "retrieval_count"]
    stored = fx.notes(spark, sf).select("id", F.struct(*fields).alias("m"))
    encoded = stored.select("id", metadata.encode_metadata(F.col("m"), stored.schema["m"].dataType).alias("e"))
    return encoded.select("id", *[F.col("e")[f].alias(f"{f}_text") for f in fields])


@query
def decode_metadata(spark, sf):
    """Event properties and plain fields read back with their types."""
    events = fx.table(spark, sf, "events")
    props = metadata.decode_value(F.col("props"))
    user = metadata.decode_value(F.col("user_id").cast("string"))
    kind = metadata.decode_value(F.col("event_type"))
    return events.select(
        "event_id",
        F.variant_get(props, "$.k", "long").alias("k"),
        F.variant_get(user, "$", "long").alias("user_number"),
        F.schema_of_variant(user).alias("user_type"),
        F.variant_get(kind, "$", "string").alias("kind"),
        F.schema_of_variant(kind).alias("kind_type"),
    )


# ---- vectors and search ----------------------------------------------------------------


@query
def embed_letters(spark, sf):
    docs = embed(fx.texts(spark, sf, "documents").select("doc_id", "text"), letter_encoder, "text", "v")
    return docs.select(
        "doc_id", F.array_join(F.transform("v", lambda x: x.cast("int").cast("string")), ",").alias("v")
    )


@query
def retrieve_topk(spark, sf):
    return fx.hits(spark, sf).select("coll", "q_idx", "seq", "rank", "distance", "score")


@query
def retrieve_topk_vectors(spark, sf):
    vectors = fx.table(spark, sf, "embeddings").withColumnRenamed("label", "coll")
    return neighbors.retrieve_topk(
        vectors.withColumnRenamed("vec_id", "q_id"),
        vectors,
        10,
        group=("coll",),
        question_key="q_id",
        note_key="vec_id",
    ).select("coll", "q_id", "vec_id", "rank", "distance", "score")


@query
def asof_neighbors(spark, sf):
    return neighbors.asof_neighbors(fx.notes(spark, sf), 5, metric="cosine", group=fx.COLL).select(
        "coll", "seq", "neighbor_seq", "neighbor_idx", "distance"
    )


@query
def asof_neighbors_vectors(spark, sf):
    vectors = fx.table(spark, sf, "embeddings").withColumnRenamed("label", "coll")
    return neighbors.asof_neighbors(vectors, 5, group=("coll",), note_key="vec_id").select(
        "coll", "vec_id", "neighbor_seq", "neighbor_idx", "distance"
    )


@query
def search_hydrate(spark, sf):
    found = search.hydrate_hits(fx.hits(spark, sf, 5), fx.notes(spark, sf))
    return found.select("coll", "q_idx", "rank", "id", "content", "context", joined("keywords"), "distance")


@query
def related_text(spark, sf):
    found = fx.hits(spark, sf, 5)
    asked = fx.questions(spark, sf)
    return search.related_notes_text(found, fx.notes(spark, sf), ["coll", "q_idx"], 5, asked)


@query
def search_with_links(spark, sf):
    found = fx.conversation_hits(spark, sf)
    return search.search_with_links(
        found, fx.linked_notes(spark, sf), ["conv_id", "q_idx"], 5
    ).select("conv_id", "q_idx", "rank", "id", "score", "is_neighbor")


@query
def related_with_links(spark, sf):
    found = fx.conversation_hits(spark, sf)
    return search.related_with_links(found, fx.linked_notes(spark, sf), ["conv_id", "q_idx"], 5)


@query
def dangling_links(spark, sf):
    return search.dangling_links(fx.linked_notes(spark, sf))


@query
def hybrid_union(spark, sf):
    """Hits by angle, then hits by squared distance not listed yet."""
    angle = fx.hits(spark, sf, 5)
    squared = fx.hits(spark, sf, 5, "l2sq")
    return search.hybrid_union(angle, squared, ["coll", "q_idx"], 8).select(
        "coll", "q_idx", "rank", "id", "score", "source"
    )


# ---- notes -------------------------------------------------------------------------------


def _reply_changes(spark, sf):
    """Notes whose conversation has a system message get that message as context."""
    said = (
        fx.messages(spark, sf)
        .filter(F.col("role") == "system")
        .groupBy("conv_id")
        .agg(F.min("content").alias("context"))
    )
    return fx.notes(spark, sf).select("id", "conv_id").join(said, "conv_id")


@query
def update_notes(spark, sf):
    """Contexts from system messages; contents of the same notes get a mark."""
    stored = fx.notes(spark, sf)
    changes = _reply_changes(spark, sf).select(
        "id", "context", F.concat("id", F.lit(" revised")).alias("content"), F.lit("x").alias("unknown")
    )
    new = notes_ops.update_notes(stored, changes, letter_counts)
    vector = F.array_join(F.transform("embedding", lambda x: x.cast("int").cast("string")), ",")
    return new.select("id", "content", "context", "category", vector.alias("v"))


@query
def unknown_ids(spark, sf):
    lost = search.link_edges(fx.linked_notes(spark, sf)).select(F.col("dst").alias("id"))
    return notes_ops.unknown_ids(fx.notes(spark, sf), lost)


@query
def delete_notes(spark, sf):
    return notes_ops.delete_notes(fx.notes(spark, sf), _reply_changes(spark, sf)).select("id", "content")


@query
def deletion_report(spark, sf):
    asked = search.link_edges(fx.linked_notes(spark, sf)).select(F.col("dst").alias("id"))
    return notes_ops.deletion_report(fx.notes(spark, sf), asked)


@query
def get_by_ids(spark, sf):
    return notes_ops.get_by_ids(fx.notes(spark, sf), _reply_changes(spark, sf)).select("id", "content")


@query
def snapshot_copy(spark, sf):
    """Notes added to a new collection twice (the second time changes nothing), then copied."""
    root = f"{shared_dir(spark)}/recallgrid/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    stored = fx.notes(spark, sf).select("id", "content", F.col("coll").alias("conv_id"))
    source = collections.open_collection(spark, f"{root}/source", partitions=8)
    source.add(stored)
    source.add(stored)
    return source.snapshot(f"{root}/copy").read().select("id", "content", "conv_id")


@query
def usage_counts(spark, sf):
    log = fx.hits(spark, sf, 5).select("id", F.lpad(F.col("q_idx").cast("string"), 6, "0").alias("ts"))
    return notes_ops.usage_counts(fx.notes(spark, sf), log).select(
        "id", "retrieval_count", "last_accessed"
    )


@query
def consolidation_points(spark, sf):
    stored = fx.notes(spark, sf).select("coll", "seq", "id")
    made = fx.decisions(spark, sf).select("id", F.col("decision.should_evolve"))
    flagged = stored.join(made, "id", "left").fillna(False, ["should_evolve"])
    return notes_ops.consolidation_points(flagged, 3, fx.COLL).select(
        "coll", "seq", "evolved_count"
    )


@query
def consolidate(spark, sf):
    """Two logged changes for some notes, the later one without a category."""
    base = _reply_changes(spark, sf)
    none = F.lit(None).cast("string")
    log = base.select(
        "id", F.lit(1).alias("version"), F.lit("early").alias("context"), F.lit("kept").alias("category")
    ).unionByName(base.select("id", F.lit(2).alias("version"), "context", none.alias("category")))
    return notes_ops.consolidate(fx.notes(spark, sf), log).select("id", "content", "context", "category")


# ---- evolution -----------------------------------------------------------------------------


@query
def evolution_rule(spark, sf):
    d = F.col("decision")
    return fx.decisions(spark, sf).select(
        "id",
        "seq",
        d["should_evolve"].alias("should_evolve"),
        F.array_join(d["suggested_connections"], ",").alias("connections"),
        F.array_join(d["tags_to_update"], ",").alias("tags"),
    )


@query
def apply_evolution(spark, sf):
    new = evolution.apply_evolution(
        fx.linked_notes(spark, sf), fx.decisions(spark, sf), fx.neighbor_table(spark, sf)
    )
    return new.select("id", joined("links"), joined("tags"), "context")


@query
def evolution_prompts(spark, sf):
    made = evolution.evolution_prompts(fx.notes(spark, sf), fx.neighbor_table(spark, sf))
    return made.select("id", "n_lines", "prompt")


@query
def frequent_terms(spark, sf):
    return evolution.frequent_terms(fx.notes(spark, sf).select("id", "content"), 5).select(
        "id", "term", "n_seen", "term_rank"
    )


@query
def parse_decisions(spark, sf):
    """Event properties as replies: fenced, bare, and cut short."""
    events = fx.table(spark, sf, "events")
    kind = F.col("event_id") % 3
    flag = F.replace("props", F.lit('"k":'), F.lit('"should_evolve": true, "actions": [], "k":'))
    reply = (
        F.when(kind == 0, F.concat(F.lit("Sure:\n```json\n"), flag, F.lit("\n```\nDone.")))
        .when(kind == 1, F.col("props"))
        .otherwise(F.substring("props", F.lit(1), F.length("props") - 1))
    )
    parsed = evolution.parse_decisions(events.select("event_id", reply.alias("reply")))
    d = F.col("decision")
    return parsed.select(
        "event_id",
        text.strip_code_fence(F.col("reply")).alias("inside"),
        "readable",
        d["should_evolve"].alias("should_evolve"),
        F.size(d["actions"]).alias("n_actions"),
    )


# ---- retrieval evaluation --------------------------------------------------------------------


@query
def match_evidence(spark, sf):
    found = matching.match_in_record(fx.records(spark, sf), nfkc=False)
    return found.select(
        "question_id", F.posexplode("hits").alias("pos", "held")
    ).select("question_id", (F.col("pos") + 1).alias("rank"), F.size("held").alias("n_held"))


@query
def match_evidence_corpus(spark, sf):
    return matching.match_corpus(
        fx.texts(spark, sf, "documents").select("doc_id", "text"),
        fx.table(spark, sf, "benchmark").select("item_id", "text"),
        nfkc=False,
    )


@query
def match_evidence_short(spark, sf):
    """Parts of words, words, cut pairs of words and empty evidences."""
    items, name = fx.table(spark, sf, "benchmark"), F.col("item_id").cast("string")
    short = [
        items.select(F.concat(name, F.lit("-part")).alias("item_id"), F.substring("text", 3, 5).alias("text")),
        items.select(F.concat(name, F.lit("-word")), F.split("text", " ")[0]),
        items.select(F.concat(name, F.lit("-pair")), F.substring("text", 1, 14)),
        fx.table(spark, sf, "region").select(F.concat(F.lit("empty-"), F.col("r_regionkey").cast("string")), F.lit("")),
    ]
    documents = fx.texts(spark, sf, "documents").select("doc_id", "text")
    return matching.match_corpus(documents, reduce(DataFrame.unionAll, short), nfkc=False)


@query
def skipped_no_evidence(spark, sf):
    """Turns without a reply have no evidence."""
    found = fx.turns(spark, sf).withColumn(
        "evidences", F.filter(F.array("reply_text"), lambda e: e != "")
    )
    return matching.split_no_evidence(found)[1].select("conv_id", "turn_idx")


@query
def expand_cutoffs(spark, sf):
    ranked = fx.hits(spark, sf, 10).select("coll", "q_idx", "rank", "seq")
    return retrieval_metrics.expand_cutoffs(ranked, KS).select("coll", "q_idx", "rank", "seq", "k_label")


def _counts(spark, sf):
    """Evidences of a question: its reply (twice) and the user's text."""
    made = fx.records(spark, sf).withColumn("evidences", F.array("answer", "answer", "question"))
    return retrieval_metrics.retrieval_counts(made, KS, nfkc=False)


@query
def retrieval_counts(spark, sf):
    return _counts(spark, sf).select(
        "question_id", "k_label", *[six(c) for c in retrieval_metrics.COUNTS]
    )


@query
def retrieval_metrics_per_record(spark, sf):
    legacy = retrieval_metrics.counts_to_metrics(_counts(spark, sf), "legacy", "legacy_")
    both = retrieval_metrics.counts_to_metrics(legacy)
    return both.select(
        "question_id",
        "k_label",
        six("legacy_precision"),
        six("legacy_f1"),
        *[six(m) for m in retrieval_metrics.METRICS],
    )


def _per_record(spark, sf, metric="cosine"):
    """Search hits carry keys only; each note's text is put into normal form once."""
    asked = fx.questions(spark, sf).drop("embedding").withColumn("idx", F.col("coll") * 1_000_000 + F.col("q_idx"))
    matched = matching.match_hits(
        fx.search(spark, sf, 10, metric), fx.notes(spark, sf), asked, ("coll", "q_idx"), ("coll", "seq"), nfkc=False
    )
    return retrieval_metrics.counts_to_metrics(retrieval_metrics.counts_at(matched, KS))


AVERAGES = [f"{s}_{m}" for s in ("macro", "micro") for m in retrieval_metrics.METRICS]


@query
def retrieval_eval(spark, sf):
    """The flagship: search every question, match evidences, average all metrics."""
    out = retrieval_metrics.average_metrics(_per_record(spark, sf), KS)
    return out.select("section", "category", "k_label", "n", *[six(m) for m in AVERAGES])


@query
def retrieval_eval_empty(spark, sf):
    """No record has evidences from an unknown speaker: zeros for every cut-off."""
    none = _per_record(spark, sf).filter(F.col("category") == "nobody")
    out = retrieval_metrics.average_metrics(none, KS)
    return out.select("section", "category", "k_label", "n", *[six(m) for m in AVERAGES])


@query
def bad_cases(spark, sf):
    scores = _per_record(spark, sf)
    rounded = scores.select(
        "idx", "question_id", "k_label", *[six(m) for m in retrieval_metrics.METRICS]
    )
    picked = retrieval_metrics.bad_cases(
        rounded, {"recall": 0.5, "ndcg": 0.6}, {"f1": 20, "precision": 30}
    )
    return retrieval_metrics.attach_question_text(picked, fx.records(spark, sf)).select(
        "k_label", "idx", "question_id", "reason", "question", *retrieval_metrics.METRICS
    )


# ---- answer evaluation ---------------------------------------------------------------------------


def _truth(spark, sf):
    """Answers known under half of the ids, under texts otherwise."""
    asked = fx.questions(spark, sf)
    by_id = F.when(F.col("category") < "3", F.col("question_id")).otherwise(
        F.concat(F.lit("other-"), "question_id")
    )
    wanted = asked.select(
        "conv_id",
        by_id.alias("question_id"),
        F.when(F.col("category") == "4", F.lit("something else")).otherwise(F.col("question")).alias("question"),
    )
    return questions.attach_ground_truth(wanted, asked, "conv_id")


@query
def ground_truth(spark, sf):
    return questions.drop_missing_ground_truth(_truth(spark, sf)).select(
        "conv_id", "question_id", "question", "ground_truth"
    )


@query
def missing_ground_truth(spark, sf):
    return questions.missing_ground_truth(_truth(spark, sf)).select("conv_id", "question_id")


@query
def answer_prompts(spark, sf):
    return answers.answer_prompts(fx.records(spark, sf), 5).select("question_id", "context", "prompt")


@query
def default_answers(spark, sf):
    return fx.answers(spark, sf).select("row_id", "prediction")


@query
def ngram_overlap(spark, sf):
    rows = fx.answers(spark, sf).select(
        "row_id",
        text.space_tokens(F.col("prediction")).alias("p"),
        text.space_tokens(F.col("reference")).alias("r"),
    )
    return answer_metrics.ngram_overlap(rows, "row_id", {"ws": ("p", "r", 4)}).select(
        "row_id", "n", "overlap", "pred_total", "ref_total"
    )


@query
def rouge(spark, sf):
    scores = answer_metrics.answer_scores(fx.answers(spark, sf), stem=False, with_bleu=False)
    return scores.select("row_id", six("rouge1"), six("rouge2"), six("rougeL"))


@query
def rouge_stemmed(spark, sf):
    scores = answer_metrics.answer_scores(fx.answers(spark, sf), with_bleu=False)
    return scores.select("row_id", six("rouge1"), six("rouge2"), six("rougeL"))


@query
def bleu(spark, sf):
    return answer_metrics.corpus_bleu(fx.answers(spark, sf), tokenize="ws").select(six("bleu"))


@query
def bleu_13a(spark, sf):
    return answer_metrics.corpus_bleu(fx.answers(spark, sf)).select(six("bleu"))


@query
def greedy_match(spark, sf):
    scores = answer_metrics.greedy_match(fx.token_vectors(spark, sf))
    return scores.select("row_id", six("precision"), six("recall"), six("f1"))


@query
def generation_eval(spark, sf):
    out = answer_metrics.generation_metrics(fx.answers(spark, sf), tokenize="ws", stem=False)
    return out.select(
        "section", "category", "count", *[six(m) for m in ("f1", "bleu", "rouge1", "rouge2", "rougeL")]
    )


# ---- reports -----------------------------------------------------------------------------------------


@query
def index_summary(spark, sf):
    return reports.index_summary(fx.turns(spark, sf), fx.notes(spark, sf), encoder="letters")


@query
def run_totals(spark, sf):
    return reports.run_totals(fx.records(spark, sf))


def _scores(spark, sf):
    retrieval = retrieval_metrics.average_metrics(_per_record(spark, sf), KS)
    generation = answer_metrics.generation_metrics(fx.answers(spark, sf), tokenize="ws", stem=False)
    return reports.scoreboard(retrieval, generation)


@query
def scoreboard(spark, sf):
    return _scores(spark, sf).select("section", "category", "k_label", "metric", six("value"))


@query
def compare_runs(spark, sf):
    """The search by angle against the search by squared distance."""
    other = _per_record(spark, sf, "l2sq")
    boards = [
        reports.scoreboard(retrieval_metrics.average_metrics(scores, KS)).withColumn("value", six("value"))
        for scores in (_per_record(spark, sf), other)
    ]
    return reports.compare_runs(*boards).select(
        "section", "category", "k_label", "metric", six("value_a"), six("value_b"), six("delta")
    )
