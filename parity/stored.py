"""Queries over what is written first: collections, files and streams, each derived from whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parity import fixtures as fx
from parity import queries as q
from recallgrid.functions import prompts, text
from recallgrid.functions.vectors import letter_counts
from recallgrid.operators import evolution, matching, questions, reports, retrieval_metrics, search, turns
from recallgrid.plans import evaluate
from recallgrid.schemas import DECISION
from recallgrid.session import shared_dir
from recallgrid.sources import collections, datasets, sinks
from recallgrid.sources.stages import stage
from recallgrid.streaming import counting, ingest, numbering, pairing, sessions

QUERIES: dict[str, q.Query] = {}
PARTS = 8  # files of a streamed part
SHAPES = ("plain", "objects", "bare")  # of record files


def query(fn: q.Query) -> q.Query:
    QUERIES[fn.__name__] = fn
    return fn


def folder(spark: SparkSession) -> str:
    """A folder of its own in the shared file system."""
    return f"{shared_dir(spark)}/recallgrid/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


# ---- stored collections -----------------------------------------------------------


def _collection(spark: SparkSession, sf: str) -> collections.Collection:
    made = collections.open_collection(spark, folder(spark), partitions=16)
    made.add(fx.notes(spark, sf).withColumn("conv_id", F.col("coll")))
    return made


@query
def stored_update(spark, sf):
    """A collection whose notes are changed in place, with vectors made anew."""
    made = _collection(spark, sf)
    changes = q._reply_changes(spark, sf).select("id", "context", F.concat("id", F.lit(" revised")).alias("content"))
    made.update(changes, letter_counts)
    vector = F.array_join(F.transform("embedding", lambda x: x.cast("int").cast("string")), ",")
    return made.read().select("id", "content", "context", "category", vector.alias("v"))


@query
def stored_delete(spark, sf):
    """A collection after deletion, opened again; ids that are gone are deleted once more."""
    made = _collection(spark, sf)
    gone = q._reply_changes(spark, sf).select("id")
    made.delete(gone)
    made.delete(gone)
    again = collections.open_collection(spark, made.path, extend=True, partitions=16)
    return again.read().select("id", "content")


@query
def stored_consolidate(spark, sf):
    """A collection rebuilt from its notes and two logged changes of some of them."""
    made = _collection(spark, sf)
    base = q._reply_changes(spark, sf).select("id", "context")
    none = F.lit(None).cast("string")
    log = base.select("id", F.lit(1).alias("version"), F.lit("early").alias("context"), F.lit("kept").alias("category"))
    made.consolidate(log.unionByName(base.select("id", F.lit(2).alias("version"), "context", none.alias("category"))))
    return made.read().select("id", "content", "context", "category")


@query
def stored_conversations(spark, sf):
    """What is left of each conversation after a deletion; emptied ones have no row."""
    made = _collection(spark, sf)
    all_but_first = fx.notes(spark, sf).filter((F.col("seq") > 0) | (F.col("coll") % 2 == 0))
    made.delete(all_but_first.select("id", F.col("coll").alias("conv_id")))
    return made.read().groupBy("conv_id").agg(F.count("*").alias("n"), F.min("id").alias("id"))


# ---- streams ----------------------------------------------------------------------


def _run(query) -> None:
    query.awaitTermination()


def _stream(spark: SparkSession, path: str, schema, files: int = PARTS) -> DataFrame:
    """A stream over the files of ``path`` in the order in which they were written."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


@fx.plan
def numbered_turns(spark: SparkSession, sf: str) -> str:
    """Turns that were paired and numbered by streams: messages in two parts, with gaps, then the ends of sessions."""
    root = folder(spark)
    own = sessions.streaming_session(spark)
    said = fx.messages(spark, sf).withColumn("coll", F.expr("conv_id div 10"))
    order = Window.partitionBy("coll").orderBy("conv_id")
    places = said.select("coll", "conv_id").distinct().withColumn("session_pos", F.row_number().over(order).cast("long") - 1)
    said = said.drop("session_pos").join(places, ["coll", "conv_id"])
    fields = ["session_id", "timestamp", "msg_pos", "role", "content"]
    rows = said.select(F.col("coll").cast("string").alias("conv_id"), "session_pos", *fields, F.lit("message").alias("kind"))
    none = [F.lit(None).cast(rows.schema[f].dataType).alias(f) for f in fields]
    ends = rows.select("conv_id", "session_pos").distinct().select("conv_id", "session_pos", *none, F.lit(pairing.END).alias("kind"))
    gap = F.col("msg_pos") % 3 == 1
    for part in (rows.filter(~gap), rows.filter(gap), ends):
        part.repartition(PARTS).write.mode("append").parquet(f"{root}/messages")
    paired = pairing.pair_turns_stream(_stream(own, f"{root}/messages", rows.schema))
    made = numbering.number_turns_stream(paired)
    _run(
        made.writeStream.format("parquet").option("path", f"{root}/turns")
        .option("checkpointLocation", f"{root}/turns-state").outputMode("append").trigger(availableNow=True).start()
    )
    return f"{root}/turns"


@fx.plan
def ingested(spark: SparkSession, sf: str) -> tuple[str, str]:
    """Streamed turns as stored notes, with the neighbours found batch by batch; the whole stream is read twice over."""
    root, turned = folder(spark), numbered_turns(spark, sf)
    own = sessions.streaming_session(spark)
    made = collections.Collection(own, f"{root}/notes", 16)

    def after(notes: DataFrame, batch_id: int) -> None:
        found = ingest.batch_neighbors(notes, made, batch_id, 5, "cosine")
        ingest.write_batch(found, f"{root}/near", batch_id)

    schema = own.read.parquet(turned).schema
    for attempt in ("first", "replayed"):
        found = _stream(own, turned, schema).filter("kind = 'turn'")
        _run(ingest.ingest_turns(found, made, f"{root}/state-{attempt}", letter_counts, after if attempt == "first" else None))
    return f"{root}/notes", f"{root}/near"


@query
def streamed_turns(spark, sf):
    """Turns paired and numbered by keyed state, with the ids of their notes."""
    made = spark.read.parquet(numbered_turns(spark, sf)).filter("kind = 'turn'")
    note = text.note_id(F.col("conv_id"), F.col("turn_idx"), F.col("content"))
    return made.select(F.col("conv_id").cast("long").alias("coll"), F.col("turn_idx").alias("seq"), note.alias("id"), "content")


@query
def streamed_sessions(spark, sf):
    """The marks of closed sessions: turns so far, by which a conversation's completion is told."""
    made = spark.read.parquet(numbered_turns(spark, sf)).filter("kind = 'closed'")
    return made.groupBy(F.col("conv_id").cast("long").alias("coll")).agg(
        F.count("*").alias("sessions"), F.max("turn_idx").alias("turns")
    )


@query
def streamed_notes(spark, sf):
    """Notes of a stream that was replayed in full: each is stored once."""
    stored = collections.Collection(spark, ingested(spark, sf)[0], 16).read()
    return stored.select(F.col("conv_id").cast("long").alias("coll"), "seq", "id", "content", "turn_key")


@query
def streamed_neighbors(spark, sf):
    """Earlier notes nearest to each streamed note, found when it came."""
    found = spark.read.parquet(ingested(spark, sf)[1])
    return found.select(
        F.col("conv_id").cast("long").alias("coll"), "seq", "neighbor_seq", (F.col("rank") - 1).alias("neighbor_idx"), "distance"
    )


@query
def streamed_consolidation_points(spark, sf):
    """Running counts of evolved notes as keyed state, over parts that arrive out of order."""
    root = folder(spark)
    own = sessions.streaming_session(spark)
    stored = fx.notes(spark, sf).select("coll", "seq", "id")
    made = fx.decisions(spark, sf).select("id", F.col("decision.should_evolve"))
    flagged = stored.join(made, "id", "left").select(F.col("coll").alias("conv_id"), "seq", "should_evolve")
    for part in (2, 0, 1):
        flagged.filter(F.col("seq") % 3 == part).repartition(PARTS).write.mode("append").parquet(f"{root}/evolved")
    points = counting.consolidation_points_stream(_stream(own, f"{root}/evolved", flagged.schema), 3)
    _run(
        points.writeStream.format("parquet").option("path", f"{root}/points")
        .option("checkpointLocation", f"{root}/state").outputMode("append").trigger(availableNow=True).start()
    )
    return spark.read.schema("conv_id string, seq long, evolved_count long").parquet(f"{root}/points").select(
        F.col("conv_id").cast("long").alias("coll"), "seq", "evolved_count"
    )


# ---- files that are damaged or of mixed shape ----------------------------------------


def _json(*fields: Column) -> Column:
    return F.to_json(F.struct(*fields))


def _write_lines(lines: DataFrame, path: str) -> str:
    lines.select("value").write.text(path)
    return path


@fx.plan
def dataset_file(spark: SparkSession, sf: str) -> str:
    """Conversations as JSON Lines; those with a system message are followed by a line cut short."""
    said = fx.messages(spark, sf)
    ordered = F.array_sort(F.collect_list(F.struct("msg_pos", "role", "content")))
    messages = F.transform(ordered, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    rows = said.groupBy("conv_id").agg(messages.alias("messages"), F.bool_or(F.col("role") == "system").alias("odd"))
    session = F.struct(F.lit("s0").alias("session_id"), F.concat(F.lit("d"), "conv_id").alias("datetime"), F.col("messages"))
    qa = F.struct(
        F.concat(F.lit("what "), F.col("conv_id").cast("string")).alias("question"),
        F.col("conv_id").alias("answer"),  # a number in the file
        F.array(F.col("messages")[0]["content"]).alias("evidences"),
    )
    whole = rows.withColumn("value", _json(F.col("conv_id").cast("string").alias("conv_id"), F.array(session).alias("dialogs"), F.array(qa).alias("qas")))
    cut = rows.filter("odd").withColumn("value", F.concat(F.lit('{"conv_id": "'), F.col("conv_id").cast("string")))
    return _write_lines(whole.select("value").unionByName(cut.select("value")), folder(spark))


@query
def dataset_messages(spark, sf):
    """Messages read back from a dataset file, broken lines put aside."""
    good, _ = datasets.quarantine(datasets.read_dataset(spark, dataset_file(spark, sf), lines=True))
    return turns.explode_messages(good).select("conv_id", "session_pos", "session_id", "timestamp", "msg_pos", "role", "content")


@query
def dataset_questions(spark, sf):
    """Questions read back from a dataset file, with answers as text and defaults for what is missing."""
    good, _ = datasets.quarantine(datasets.read_dataset(spark, dataset_file(spark, sf), lines=True))
    return questions.explode_questions(good).select(
        "conv_id", "q_idx", "question_id", "question", "answer", q.joined("evidences"), "category"
    )


@query
def quarantined_lines(spark, sf):
    """The text of every broken line."""
    _, bad = datasets.quarantine(datasets.read_dataset(spark, dataset_file(spark, sf), lines=True))
    return bad.select(F.col("_corrupt").alias("line"))


@fx.plan
def records_folder(spark: SparkSession, sf: str) -> str:
    """Retrieval records in files of three shapes, by category; some lines are cut short.

    ``plain``: string chunks, ``evidences``.  ``objects``: chunk objects with
    their text in various fields, some without any, and ``evidence`` beside other
    ``evidences``.  ``bare``: no evidence at all.
    """
    root = folder(spark)
    rows = fx.records(spark, sf)
    number = F.col("category").cast("int")
    base = [F.col(c) for c in ("question_id", "question", "answer", "category")]
    conv = F.col("coll").cast("string").alias("conv_id")
    kinds = ["chunk_content", "content", "text", "raw", "value", "other"]

    def piece(chunk: Column, i: Column) -> Column:
        fields = [F.when(i % 6 == n, chunk).alias(name) for n, name in enumerate(kinds)]
        return F.struct(*fields, i.alias("score"))

    plain = _json(*base, conv, F.col("chunks"), F.col("evidences"))
    odd = _json(
        *base, conv, F.transform("chunks", piece).alias("chunks"),
        F.col("evidences").alias("evidence"), F.array(F.lit("not this")).alias("evidences"),
    )
    bare = _json(*base[:3], conv, F.col("chunks"))
    cut = F.concat(F.lit('{"question_id": "'), "question_id")
    shape = F.when(number < 2, "plain").when(number.isin(2, 3), "objects").when(number == 4, "bare")
    # A broken line follows its record inside one value, so no text is made twice.
    lines = (
        F.when(number == 0, F.concat_ws("\n", plain, cut)).when(number < 2, plain)
        .when(number.isin(2, 3), odd).when(number == 4, bare)
    )
    # One search serves all files; a shape without records has an empty folder.
    for name in SHAPES:
        spark.createDataFrame([], "value string").write.text(f"{root}/shape={name}")
    made = rows.filter(shape.isNotNull()).select(shape.alias("shape"), lines.alias("value"))
    made.write.mode("append").partitionBy("shape").text(root)
    return root


def _read_records(spark, sf) -> tuple[DataFrame, DataFrame]:
    root = records_folder(spark, sf)
    good, bad = datasets.read_retrieval_records(spark, [f"{root}/shape={n}" for n in SHAPES], lines=True)
    kind = F.regexp_extract("source", "/shape=(plain|objects|bare)/", 1)
    return good.withColumn("source", kind), bad.withColumn("source", kind)


@query
def mixed_records(spark, sf):
    """Records of all shapes as plain string lists."""
    good, _ = _read_records(spark, sf)
    chunks = F.array_join("chunks", "|").alias("chunks")
    return good.select("source", "question_id", "question", "answer", "category", "conv_id", chunks, F.array_join("evidences", "|").alias("evidences"))


@query
def failed_records(spark, sf):
    """Lines of record files that could not be read."""
    return _read_records(spark, sf)[1].select("source", F.col("_corrupt").alias("line"))


def _evaluated(spark, sf) -> dict[str, DataFrame]:
    return evaluate.evaluate_retrieval(_read_records(spark, sf)[0], q.KS, nfkc=False, by=("source",))


@query
def retrieval_eval_by_source(spark, sf):
    """Averages for each file, also for the one whose records have no evidence."""
    out = _evaluated(spark, sf)["averages"]
    return out.select("source", "section", "category", "k_label", "n", *[q.six(m) for m in q.AVERAGES])


@query
def skipped_by_source(spark, sf):
    """Records left out of the evaluation, by file."""
    return _evaluated(spark, sf)["skipped"].select("source", "question_id")


@query
def bad_cases_by_source(spark, sf):
    """The worst records of each file, written as JSON and as CSV, read back and put side by side."""
    root = folder(spark)
    good, _ = _read_records(spark, sf)
    # Places in a file depend on how it was written: the question id orders here.
    scores = _evaluated(spark, sf)["per_record"].withColumn("idx", F.col("question_id"))
    # Staged, as every limit reads the scores, and every file the cases.
    rounded = scores.select("source", "idx", "question_id", "k_label", *[q.six(m) for m in retrieval_metrics.METRICS])
    cases = retrieval_metrics.bad_cases(stage(rounded, "scores", heavy=False), {"recall": 0.5}, {"f1": 7}, by=("source",))
    cases = retrieval_metrics.attach_question_text(cases, good.withColumn("idx", F.col("question_id")), by=("source",))
    cases = stage(cases, "cases", heavy=False)
    sinks.write_bad_cases(cases, f"{root}/json")
    sinks.write_bad_cases_csv(cases, f"{root}/csv")
    nested = spark.read.option("recursiveFileLookup", False).json(f"{root}/json")
    flat = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(f"{root}/csv")
    keys = ["source", "k", "question_id"]
    marks = flat.select(*keys, F.col("f1").cast("double").alias("flat_f1"))
    return nested.withColumn("k", F.col("k").cast("string")).join(marks, keys).select(
        *keys, "reason", F.coalesce("question", F.lit("")).alias("question"),
        *[F.col(f"metrics.{m}").alias(m) for m in retrieval_metrics.METRICS], "flat_f1",
    )


@query
def records_round_trip(spark, sf):
    """Nested records as a search writes them, read back with their chunk texts."""
    root = folder(spark)
    hits = fx.hits(spark, sf, 5).select(F.col("coll").alias("conv_id"), "q_idx", "rank", "id", "score")
    stored = fx.notes(spark, sf).drop("conv_id", "embedding").withColumnRenamed("coll", "conv_id")
    fields = [f for f in sinks.CHUNK_FIELDS if f != "score"]
    chunks = search.project_chunks(search.hydrate_hits(hits, stored, ("id",), fields))
    asked = fx.questions(spark, sf).select("q_idx", "question_id", "question", "answer", "evidences", "category", F.col("coll").alias("conv_id"))
    sinks.write_retrieval_records(sinks.nest_records(chunks, asked), f"{root}/records")
    back, _ = datasets.read_retrieval_records(spark, f"{root}/records", lines=True)
    return back.select(
        "question_id", "conv_id", "question", "answer", "category",
        F.array_join("chunks", "|").alias("chunks"), F.array_join("evidences", "|").alias("evidences"),
    )


@query
def projected_chunks(spark, sf):
    """Stored string metadata as chunk fields: lists in JSON, broken lists, missing texts."""
    kind = F.col("seq") % 3
    tags = F.to_json("tags")
    stored = fx.notes(spark, sf).select(
        "id",
        F.when(kind != 0, F.col("content")).alias("content"),
        F.col("content").alias("document"),
        F.when(kind == 1, tags).when(kind == 2, F.substring(tags, F.lit(1), F.length(tags) - 2)).alias("tags"),
        F.lit("[]").alias("keywords"),
        F.when(kind == 0, F.col("context")).alias("context"),
        "timestamp",
        "category",
    )
    return search.project_chunks(stored).select("id", "content", q.joined("tags"), q.joined("keywords"), "context")


# ---- reports ------------------------------------------------------------------------


@query
def eval_report(spark, sf):
    """All sections of a written evaluation report: rows and the sum of their numbers."""
    root = folder(spark)
    rows = _evaluated(spark, sf)
    fields = ["source", "question_id", "category", "k_label", *retrieval_metrics.METRICS, *retrieval_metrics.COUNTS]
    scores = stage(rows["per_record"].select(*fields), "scores", heavy=False)
    per_record = scores.select("source", "question_id", "k_label", q.six("f1"))
    averages = retrieval_metrics.average_metrics(scores, q.KS)
    meta = spark.range(1).select(F.lit("ir").alias("precision_mode"))
    failed = _read_records(spark, sf)[1].select("source")
    sections = sinks.eval_sections(meta, averages, per_record, rows["skipped"].select("question_id"), failed)
    sinks.write_eval_report(sections, f"{root}/report")
    macro = spark.read.parquet(f"{root}/report/section=macro").select("k_label", "n", q.six("macro_f1"))
    sizes = [
        spark.read.parquet(f"{root}/report/section={name}").agg(F.count("*").alias("n")).select(F.lit(name).alias("k_label"), "n", F.lit(0.0).alias("macro_f1"))
        for name in ("meta", "category", "per_record", "skipped", "failed")
    ]
    for size in sizes:
        macro = macro.unionByName(size)
    return macro


@query
def generation_report(spark, sf):
    """A written report on answers, its parts read back as one table."""
    root = folder(spark)
    answers = stage(fx.answers(spark, sf), "answers", heavy=False)
    metrics = q.answer_metrics.generation_metrics(answers, tokenize="ws", stem=False)
    config = spark.range(1).select(F.lit(5).alias("context_k"))
    sinks.write_generation_report(config, metrics, answers, f"{root}/report")
    names = ["f1", "bleu", "rouge1", "rouge2", "rougeL"]
    columns = ["count", *[q.six(m) for m in names]]
    overall = spark.read.parquet(f"{root}/report/section=overall").select(F.lit("ALL").alias("category"), *columns)
    by_category = spark.read.parquet(f"{root}/report/section=by_category").select("category", *columns)
    asked = spark.read.parquet(f"{root}/report/section=per_question").groupBy(F.coalesce("category", F.lit("")).alias("category"))
    sizes = asked.agg(F.count("*").alias("answers"))
    return overall.unionByName(by_category).join(sizes, "category", "left")


@query
def report_order(spark, sf):
    """The lines of a report in their order."""
    rows = q._scores(spark, sf).filter("metric = 'macro_f1'").select("section", "category", "k_label")
    ordered = reports.in_report_order(rows).withColumn("_at", F.monotonically_increasing_id())
    return ordered.withColumn("line", F.row_number().over(Window.orderBy("_at"))).drop("_at")


# ---- replies and notes --------------------------------------------------------------


@query
def analyzed_notes(spark, sf):
    """Keywords, context and tags without a text model."""
    made = evolution.analyze(fx.notes(spark, sf).drop("keywords", "context", "tags"), n=4)
    return made.select("id", q.joined("keywords"), "context", q.joined("tags"))


@query
def parsed_analysis(spark, sf):
    """Analysis replies: whole, fenced, cut short and none at all."""
    pages = fx.table(spark, sf, "events").select("event_id", "event_type")
    whole = _json(
        F.array("event_type", F.lit("b")).alias("keywords"), F.concat(F.lit("about "), "event_type").alias("context"),
        F.array(F.lit("x")).alias("tags"),
    )
    kind = F.col("event_id") % 4
    reply = (
        F.when(kind == 0, whole)
        .when(kind == 1, F.concat(F.lit("```json\n"), whole, F.lit("\n```")))
        .when(kind == 2, F.substring(whole, F.lit(1), F.length(whole) - 1))
    )
    made = evolution.parse_analysis(pages.withColumn("reply", reply))
    return made.select("event_id", q.joined("keywords"), "context", q.joined("tags"))


@query
def analysis_prompts(spark, sf):
    return fx.notes(spark, sf).select("id", prompts.analysis_prompt(F.col("content")).alias("prompt"))


@query
def empty_replies(spark, sf):
    """What a failed call stands for, beside every event."""
    reply = evolution.empty_reply(DECISION)
    return fx.table(spark, sf, "events").select("event_id", F.to_json(reply).alias("reply"))


@query
def note_times(spark, sf):
    """Times read from the note format, from ISO texts and from texts without one."""
    kind = F.col("event_id") % 3
    events = fx.table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    told = F.when(kind == 0, F.date_format("ts", text.TIMESTAMP_FORMAT)).when(kind == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise(F.lit("no time"))
    return events.select("event_id", F.date_format(text.parse_time(told), "yyyy-MM-dd HH:mm:ss").alias("time"))


@query
def folded_text(spark, sf):
    """Evidence form with compatibility folding."""
    docs = fx.texts(spark, sf, "documents")
    return docs.select("doc_id", text.evidence_form(F.col("text")).alias("norm"))


@query
def coerced_evidences(spark, sf):
    """Distinct evidences that a chunk holds, over records of all shapes."""
    good, _ = _read_records(spark, sf)
    judged, _ = matching.split_no_evidence(good)
    found = matching.match_in_record(judged, nfkc=False)
    return found.select("question_id", F.posexplode("hits").alias("pos", "held")).select(
        "question_id", (F.col("pos") + 1).alias("rank"), F.size("held").alias("n_held")
    )
