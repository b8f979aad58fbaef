"""Queries of readers, sinks, streams and user functions, and their SQL.

Each derives files from the given tables, writes them to the shared folder and
reads them back through the library.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sievewright.functions import udfs
from sievewright.operators import evidence, profiles
from sievewright.plans.base import oracle, sql
from sievewright.sources import readers, sinks
from sievewright.sources.scratch import new_folder
from sievewright.streaming import live


def _lines(d, spark, name, column):
    """The folder of a text file of one column."""
    folder = new_folder(spark, name)
    d.select(column.alias("value")).write.text(folder)
    return folder


def src1_files(spark, sf):
    """Inventory of the documents' texts as files, a folder for each language."""
    folder = new_folder(spark, "files")
    sql(spark, sf, "SELECT coalesce(lang, 'none') AS lang, text FROM documents").write.partitionBy("lang").text(folder)
    d = readers.files(spark, folder).withColumn("lang", F.regexp_extract("path", "/lang=([^/]+)/", 1))
    return d.groupBy("lang", "kind", "status").agg(F.sum("size_bytes").alias("size_bytes"))


def src6_prior_scans(spark, sf):
    """Items of scan documents, some of them malformed."""
    d = sql(spark, sf, """
        SELECT doc_id, to_json(named_struct('schema_version', 1, 'items', array(named_struct(
            'path', source || '/' || doc_id, 'kind', 'text', 'status', CASE WHEN doc_id % 5 > 0 THEN 'analyzed' END,
            'size_bytes', CASE WHEN doc_id % 4 = 0 THEN 'n/a' ELSE CAST(n_chars AS STRING) END,
            'result', CASE WHEN doc_id % 7 > 0 THEN named_struct(
                'score', CASE doc_id % 3 WHEN 0 THEN 'x' WHEN 1 THEN CAST(n_chars AS STRING) ELSE CAST(n_chars % 101 AS STRING) || '.5' END,
                'band', CASE WHEN doc_id % 2 = 0 THEN 'high' END,
                'signals', array(named_struct('title', lang, 'weight', CASE WHEN doc_id % 6 = 0 THEN 'heavy' ELSE CAST(doc_id % 50 AS STRING) END))) END)))) AS line
        FROM documents""")  # fmt: skip
    items = readers.scan_items(spark, _lines(d, spark, "scans", F.col("line")), lines=True)
    return items.select("path", "status", "size_bytes", "score", "band", F.size("signals").alias("n_signals"), F.get("signals", F.lit(0))["weight"].alias("weight"))


def src7_feedback(spark, sf):
    """Examiner labels in their several spellings, a JSON object a line."""
    path = F.concat_ws("/", "source", F.col("doc_id").cast("string"))
    form = F.col("doc_id") % 5
    line = (
        F.when(form == 0, F.to_json(F.struct(path.alias("path"), F.lit("AI").alias("label"))))
        .when(form == 1, F.to_json(F.struct(path.alias("file"), F.lit("real ").alias("expected"))))
        .when(form == 2, F.to_json(F.struct(path.alias("path"), F.lit("maybe").alias("verdict"))))
        .when(form == 3, F.to_json(F.struct(F.array(F.struct(path.alias("path"), F.lit("Human").alias("expected_label"), F.col("lang").alias("notes"))).alias("records"))))
        .otherwise(F.to_json(F.struct(F.lit("ai").alias("label"))))
    )
    d = sql(spark, sf, "SELECT doc_id, source, lang FROM documents")
    return readers.feedback(spark, _lines(d, spark, "feedback", line), lines=True).select("path", "label", "notes")


def src8_label_csv(spark, sf):
    """A label table as CSV, names with commas and quotes among them."""
    folder = new_folder(spark, "labels")
    sql(spark, sf, """SELECT CASE WHEN doc_id % 7 > 0 THEN source || ', "' || doc_id || '"' END AS path, CASE WHEN doc_id % 2 = 0 THEN 'ai' ELSE 'real' END AS label FROM documents""").write.option("escape", '"').csv(folder, header=True)
    return readers.label_csv(spark, folder)


def src9_manifest(spark, sf):
    sample = F.struct(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.when(F.col("doc_id") % 3 == 0, "ai").otherwise("human").alias("label"), F.when(F.col("doc_id") % 3 == 0, F.col("source")).alias("generator"), F.col("lang").alias("language"))
    d = sql(spark, sf, "SELECT doc_id, source, lang FROM documents")
    return readers.manifest(spark, _lines(d, spark, "manifest", F.to_json(F.struct(F.array(sample).alias("samples")))), lines=True)


def src11_profile(spark, sf):
    """Numbers of profiles of the right version, a profile a language."""
    d = sql(spark, sf, "SELECT lang, CAST(count(*) AS DOUBLE) AS n, CAST(max(n_chars) AS DOUBLE) AS longest FROM documents WHERE lang IS NOT NULL GROUP BY lang")
    line = F.to_json(F.struct(F.when(F.col("lang") >= "e", "v2").otherwise("v1").alias("version"), F.create_map(F.concat("lang", F.lit(".n")), "n", F.concat("lang", F.lit(".longest")), "longest").alias("values")))
    return readers.profile(spark, _lines(d, spark, "profile", line), "v2", lines=True)


def snk1_scan(spark, sf):
    """A scan's summary, and its items by kind, read back from what was written."""
    folder = new_folder(spark, "scan")
    sinks.write_scan(sql(spark, sf, "SELECT item_id, kind, status, score, band FROM (SELECT item_id, CASE WHEN path LIKE '%.png' THEN 'image' ELSE 'text' END AS kind, status, score, band FROM items_base)"), folder)
    names = ("total", "analyzed", "high", "medium", "unknown", "low", "unsupported_or_failed", "duplicates", "skipped", "schema_version")
    head = spark.read.schema(", ".join(f"{n} long" for n in names)).json(f"{folder}/summary")
    items = spark.read.parquet(f"{folder}/items").groupBy("kind").agg(F.count("*").alias("n"))
    stacked = [F.struct(F.lit(n).alias("name"), F.col(n).alias("n")) for n in names]
    return head.select(F.inline(F.array(*stacked))).unionByName(items.select(F.concat(F.lit("kind "), "kind").alias("name"), "n"))


REVIEWED = """SELECT path, 'text' AS kind, status, score, band, CASE item_id % 3 WHEN 0 THEN named_struct('available', item_id % 2 = 0, 'score', score, 'confidence', band, 'model', 'px', 'fusion', 'mean', 'heatmap_path', CASE WHEN item_id % 4 = 0 THEN concat('h/', path) END,
  'experts', array(named_struct('name', 'a', 'available', true, 'score', score), named_struct('name', 'b', 'available', item_id % 5 > 0, 'score', score + 1), named_struct('name', 'c', 'available', true, 'score', 60), named_struct('name', 'd', 'available', true, 'score', score))) END AS pixel,
  CASE WHEN item_id % 5 < 2 THEN named_struct('available', item_id % 5 = 0, 'model', lang, 'score', 100 - score) END AS model, named_struct('label', source, 'confidence', CASE WHEN item_id % 2 = 0 THEN 'high' ELSE 'unknown' END) AS source_guess,
  CASE WHEN item_id % 7 > 0 THEN array(named_struct('title', concat('the "', lang, '", first'), 'detail', '', 'weight', 3), named_struct('title', 'second', 'detail', '', 'weight', 9)) ELSE array() END AS signals, CASE WHEN status = 'failed' THEN 'no reader, damaged' END AS error FROM items_base"""


def snk2_review_sheet(spark, sf):
    """The review sheet's 17 columns, written as CSV and read back."""
    folder = new_folder(spark, "review")
    sinks.write_review(sql(spark, sf, REVIEWED), folder)
    kinds = ", ".join(f"{c} {'int' if c in ('score', 'pixel_score', 'external_model_score') else 'string'}" for c in sinks.REVIEW_COLUMNS)
    return spark.read.csv(folder, header=True, escape='"', schema=kinds)


def evd2_rejects(spark, sf):
    """Custody chains from lines, by why they were rejected."""
    path = F.concat_ws("/", "source", F.col("doc_id").cast("string"))
    form = F.col("doc_id") % 4
    line = (
        F.when(form == 0, F.to_json(F.struct(F.sha2("text", 256).alias("file_hash"), path.alias("path"))))
        .when(form == 1, F.to_json(F.struct(F.sha2(F.lit("x"), 256).alias("file_hash"))))
        .when(form == 2, F.to_json(F.struct(path.alias("path"))))
        .otherwise(F.concat(F.lit("{ no json "), path))
    )
    d = sql(spark, sf, "SELECT doc_id, source, coalesce(text, '') AS text FROM documents")
    good, bad = evidence.load_chains(spark.read.text(_lines(d, spark, "chains", line)))
    return good.groupBy(F.lit("loaded").alias("outcome")).agg(F.count("*").alias("n"), F.countDistinct("file_hash").alias("hashes")).unionByName(bad.groupBy(F.col("why").alias("outcome")).agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("hashes")))


def _ratio(row: dict) -> str:
    return str(len(row["text"]) // row["part"])


def udf1_process(spark, sf):
    """A user function of each document; where it fails the row says why."""
    d = sql(spark, sf, "SELECT doc_id, CAST(doc_id % 5 AS INT) AS part, coalesce(text, '') AS text FROM documents")
    return udfs.process(d, _ratio, keep=("doc_id",)).select("doc_id", "status", "result", "error")


def udf2_members(spark, sf):
    """Two detectors of each document: one by length, one whose model cannot be loaded."""
    d = sql(spark, sf, "SELECT doc_id AS item_id, coalesce(text, '') AS text FROM documents")
    by_length = udfs.detector(lambda: lambda batch: batch.str.len() % 120)
    return udfs.member_scores(d, {"length": (by_length, "text"), "absent": (udfs.detector(lambda: 1 / 0), "text")})


def str5_incremental(spark, sf):
    """A scan of the events as micro-batches: rows by type in its sink, and rows in its progress."""
    folder = new_folder(spark, "incremental")
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "event_type", "value")
    events.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 4).parquet(f"{folder}/in")
    live.incremental(stream, lambda d: d.withColumn("high", F.col("value") >= 50), f"{folder}/out", f"{folder}/state").awaitTermination()
    rows = spark.read.parquet(f"{folder}/out").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if("high").alias("high"))
    return rows.unionByName(spark.read.parquet(f"{folder}/out_progress").select(F.lit("progress").alias("event_type"), F.col("rows").alias("n"), F.lit(0).cast("long").alias("high")).groupBy("event_type").agg(F.sum("n").alias("n"), F.sum("high").alias("high")))


def str6_resumed(spark, sf):
    """Events that arrive in two parts, each scanned once: the second scan resumes where the first stopped."""
    folder = new_folder(spark, "resumed")
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "event_type", "value")
    late = F.coalesce(F.col("value") >= 50, F.lit(False))
    for part in (~late, late):
        events.where(part).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(events.schema).parquet(f"{folder}/in")
        live.incremental(stream, lambda d: d, f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("events"))


def str4_stream(spark, sf):
    """States of live streams with resets: files arrive in two parts, and between them the stream ends and starts again from its checkpoint."""
    folder = new_folder(spark, "live")
    rows = sql(spark, sf, "SELECT stream_id, event_id, CAST(ts AS TIMESTAMP) AS ts, CAST(least(100, score * 2) AS INTEGER) AS score, event_id % 13 = 0 AS reset FROM stream_base")
    middle = rows.agg(F.timestamp_seconds((F.min("ts").cast("double") + F.max("ts").cast("double")) / 2)).first()[0]
    for part in (F.col("ts") < F.lit(middle), F.col("ts") >= F.lit(middle)):
        rows.where(part).write.mode("append").parquet(f"{folder}/in")
        live.run_states(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"), f"{folder}/out", f"{folder}/state")
    return spark.read.parquet(f"{folder}/out").select("stream_id", "event_id", F.round("mean", 6).alias("mean"), "frame_count", "band", "alert")


def str5_cancelled(spark, sf):
    """A scan that is cancelled after its first batch, what can be read of it then, and all of it after it was resumed."""
    folder = new_folder(spark, "cancelled")
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "event_type", "value")
    for part in range(4):  # four files each: a batch
        events.where(F.col("event_id") % 4 == part).repartition(4).write.mode("append").parquet(f"{folder}/in")

    def scan(after=None):
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 4).parquet(f"{folder}/in")
        query = live.incremental(stream, lambda d: d.withColumn("high", F.col("value") >= 50), f"{folder}/out", f"{folder}/state", f"{folder}/cancel", after)
        ended = live.outcome(query)
        d = live.partial_results(spark, f"{folder}/out").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("events"), F.count_if("high").alias("high"))
        return d.select(F.lit(ended).alias("ended"), "*")

    def stop(number):
        if number == 0:
            live.cancel(spark, f"{folder}/cancel")

    first = spark.createDataFrame(scan(stop).collect(), "ended string, event_type string, n long, events long, high long")  # a row for each type
    live.allow(spark, f"{folder}/cancel")
    return first.unionByName(scan())


#: Rules of three profiles, as rows of the given tables; some are no rules.
PROFILES = """
SELECT DISTINCT 'first' AS profile, 'v1' AS version, 'term' AS kind, 'opening' AS component, lower(split_part(text, ' ', 1)) AS key, 1.5 AS value FROM benchmark
UNION ALL SELECT DISTINCT 'first', 'v1', 'term', 'lang', lang, 4.0 FROM documents
UNION ALL SELECT 'first', 'v1', 'fusion', CASE r_regionkey WHEN 0 THEN 'opening' WHEN 1 THEN 'lang' ELSE lower(r_name) END, CAST(NULL AS VARCHAR(9)), 1.0 + r_regionkey FROM region
UNION ALL SELECT 'first', 'v1', 'threshold', NULL, CASE r_regionkey WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'unknown_below' ELSE r_name END, CASE r_regionkey WHEN 0 THEN 60.0 WHEN 1 THEN 20.0 ELSE 5.0 END FROM region
UNION ALL SELECT DISTINCT 'second', 'v1', 'term', 'role', role, 10.0 FROM conversations
UNION ALL SELECT DISTINCT 'second', 'v1', 'term', 'ending', lower(split_part(text, ' ', 3)), CASE WHEN length(split_part(text, ' ', 3)) > 4 THEN 2.0 ELSE -0.5 END FROM benchmark WHERE split_part(text, ' ', 3) <> '' AND split_part(text, ' ', 3) = lower(split_part(text, ' ', 3))
UNION ALL SELECT 'second', 'v1', 'cap', 'ending', r_name, r_regionkey * 50.0 - 10.0 FROM region WHERE r_regionkey < 2
UNION ALL SELECT 'second', 'v1', 'threshold', NULL, CASE r_regionkey WHEN 0 THEN 'high' ELSE 'medium' END, r_regionkey * 40.0 + 10.0 FROM region WHERE r_regionkey < 2
UNION ALL SELECT 'third', CASE WHEN n_nationkey % 2 = 0 THEN 'v2' ELSE 'v1' END, CASE WHEN n_nationkey % 3 = 0 THEN 'regex' ELSE 'term' END, CASE WHEN n_nationkey % 5 = 0 THEN ' ' ELSE 'nation' END, CASE WHEN n_nationkey % 7 = 0 THEN NULL ELSE lower(n_name) END, CASE WHEN n_nationkey % 11 = 0 THEN NULL ELSE 1.0 END FROM nation
"""


def udf3_profiles(spark, sf):
    """Every document under each profile of a table of rules."""
    d = profiles.scan(sql(spark, sf, "SELECT doc_id, text FROM documents"), sql(spark, sf, PROFILES))
    return d.select("doc_id", "profile", F.array_join(F.array_sort(F.transform(F.map_entries("components"), lambda e: F.concat(e["key"], F.lit("="), F.round(e["value"] * 2).cast("long").cast("string")))), ",").alias("components"), "score", "band")


def udf3_rejects(spark, sf):
    """The rows of the table that are no rules, by reason."""
    return profiles.rejected(sql(spark, sf, PROFILES)).groupBy("profile", "kind", "why").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (src1_files, src6_prior_scans, src7_feedback, src8_label_csv, src9_manifest, src11_profile, snk1_scan, evd2_rejects, udf1_process, udf2_members, str5_incremental, str6_resumed, str4_stream, str5_cancelled, udf3_profiles, udf3_rejects, snk2_review_sheet)}
_STATS = ", ".join(f"count(*) FILTER (WHERE status = 'analyzed' AND band = '{b}') AS {b}" for b in ("high", "medium", "unknown", "low"))
_JUDGED = f"""t AS ({PROFILES}), w AS (SELECT *, count(*) OVER (PARTITION BY profile, kind, component, key) AS same,
  coalesce(max(CASE WHEN kind = 'threshold' AND key = 'medium' THEN value END) OVER (PARTITION BY profile), 35) > coalesce(max(CASE WHEN kind = 'threshold' AND key = 'high' THEN value END) OVER (PARTITION BY profile), 67) AS turned,
  max(CASE WHEN kind = 'term' AND trim(coalesce(key, '')) <> '' THEN 1 END) OVER (PARTITION BY profile, component) AS has FROM t),
j AS (SELECT profile, kind, component, key, CAST(value AS DOUBLE) AS value, CASE WHEN trim(coalesce(profile, '')) = '' THEN 'no profile' WHEN version IS NULL OR version <> 'v1' THEN 'version' WHEN kind IS NULL OR kind NOT IN ('term', 'cap', 'fusion', 'threshold') THEN 'kind' WHEN value IS NULL THEN 'no number'
  WHEN kind <> 'threshold' AND trim(coalesce(component, '')) = '' THEN 'no component' WHEN kind = 'term' AND trim(coalesce(key, '')) = '' THEN 'no term' WHEN kind <> 'term' AND value < 0 THEN 'negative' WHEN kind = 'threshold' AND (key IS NULL OR key NOT IN ('high', 'medium', 'unknown_below')) THEN 'threshold'
  WHEN same > 1 THEN 'repeated' WHEN kind = 'threshold' AND key IN ('high', 'medium') AND turned THEN 'order' WHEN kind IN ('cap', 'fusion') AND has IS NULL THEN 'no terms' END AS why FROM w), ok AS (SELECT * FROM j WHERE why IS NULL)"""
SQL = {
    "src1_files": "SELECT coalesce(lang, 'none') AS lang, 'text' AS kind, 'pending' AS status, CAST(sum(coalesce(strlen(text), 0) + 1) AS BIGINT) AS size_bytes FROM documents GROUP BY 1",
    "src6_prior_scans": """SELECT coalesce(source || '/' || doc_id, '') AS path, CASE WHEN doc_id % 5 > 0 THEN 'analyzed' ELSE 'failed' END AS status, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE coalesce(n_chars, 0) END AS size_bytes,
        CAST(CASE WHEN doc_id % 7 = 0 OR doc_id % 3 = 0 THEN 0 WHEN doc_id % 3 = 1 THEN least(coalesce(n_chars, 0), 100) ELSE least(coalesce(n_chars, 0) % 101, 100) END AS INTEGER) AS score, CASE WHEN doc_id % 7 > 0 AND doc_id % 2 = 0 THEN 'high' ELSE 'unknown' END AS band,
        CASE WHEN doc_id % 7 > 0 THEN 1 ELSE 0 END AS n_signals, CAST(CASE WHEN doc_id % 7 > 0 THEN CASE WHEN doc_id % 6 = 0 THEN 0 ELSE doc_id % 50 END END AS INTEGER) AS weight FROM documents""",
    "src7_feedback": "SELECT concat_ws('/', source, doc_id) AS path, CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS label, CASE WHEN doc_id % 5 = 3 THEN coalesce(lang, '') ELSE '' END AS notes FROM documents WHERE doc_id % 5 IN (0, 1, 3)",
    "src8_label_csv": """SELECT source || ', "' || doc_id || '"' AS path, CASE WHEN doc_id % 2 = 0 THEN 'ai' ELSE 'real' END AS label FROM documents WHERE doc_id % 7 > 0""",
    "src9_manifest": "SELECT concat_ws('/', source, doc_id) AS path, CASE WHEN doc_id % 3 = 0 THEN 'ai' ELSE 'human' END AS label, CASE WHEN doc_id % 3 = 0 THEN source END AS generator, lang AS language FROM documents",
    "src11_profile": "SELECT lang || '.n' AS key, CAST(count(*) AS DOUBLE) AS value FROM documents WHERE lang >= 'e' GROUP BY lang UNION ALL SELECT lang || '.longest', CAST(max(n_chars) AS DOUBLE) FROM documents WHERE lang >= 'e' GROUP BY lang",
    "snk1_scan": oracle(f"WITH s AS (SELECT count(*) AS total, count(*) FILTER (WHERE status = 'analyzed') AS analyzed, {_STATS}, count(*) FILTER (WHERE status NOT IN ('analyzed', 'duplicate', 'skipped')) AS unsupported_or_failed, count(*) FILTER (WHERE status = 'duplicate') AS duplicates, count(*) FILTER (WHERE status = 'skipped') AS skipped, CAST(1 AS BIGINT) AS schema_version FROM items_base) SELECT name, n FROM s UNPIVOT (n FOR name IN (total, analyzed, high, medium, unknown, low, unsupported_or_failed, duplicates, skipped, schema_version)) UNION ALL SELECT 'kind ' || CASE WHEN path LIKE '%.png' THEN 'image' ELSE 'text' END, count(*) FROM items_base GROUP BY 1"),
    "evd2_rejects": "SELECT CASE doc_id % 4 WHEN 0 THEN 'loaded' WHEN 1 THEN 'no path' WHEN 2 THEN 'no file_hash' ELSE 'not JSON' END AS outcome, count(*) AS n, count(DISTINCT coalesce(text, '')) FILTER (WHERE doc_id % 4 = 0) AS hashes FROM documents GROUP BY 1",
    "udf1_process": "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'failed' ELSE 'completed' END AS status, CASE WHEN doc_id % 5 > 0 THEN CAST(length(coalesce(text, '')) // (doc_id % 5) AS VARCHAR) END AS result, CASE WHEN doc_id % 5 = 0 THEN 'ZeroDivisionError: integer division or modulo by zero' END AS error FROM documents",
    "udf2_members": "SELECT doc_id AS item_id, 'length' AS member, CAST(least(length(coalesce(text, '')) % 120, 100) AS DOUBLE) AS score, TRUE AS available FROM documents UNION ALL SELECT doc_id, 'absent', NULL, FALSE FROM documents",
    "str5_incremental": "SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value >= 50) AS high FROM events GROUP BY event_type UNION ALL SELECT 'progress', count(*), 0 FROM events",
    "str6_resumed": "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS events FROM events GROUP BY event_type",
    "str4_stream": oracle("""WITH RECURSIVE e AS (SELECT stream_id, event_id, ts, least(100, score * 2) AS score, event_id % 13 = 0 AS reset FROM stream_base),
        s AS (SELECT *, count(*) FILTER (WHERE reset) OVER (PARTITION BY stream_id ORDER BY ts, event_id) AS part FROM e),
        d AS (SELECT *, avg(score) OVER (PARTITION BY stream_id, part ORDER BY ts, event_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS m, row_number() OVER (PARTITION BY stream_id, part ORDER BY ts, event_id) AS frame_count FROM s WHERE NOT reset),
        h AS (SELECT stream_id, part, event_id, ts, row_number() OVER (PARTITION BY stream_id, part ORDER BY ts, event_id) AS r FROM d WHERE m >= 67),
        f AS (SELECT stream_id, part, event_id, r, ts AS last, TRUE AS fires FROM h WHERE r = 1 UNION ALL SELECT h.stream_id, h.part, h.event_id, h.r, CASE WHEN epoch(h.ts) - epoch(f.last) > 5 THEN h.ts ELSE f.last END, epoch(h.ts) - epoch(f.last) > 5 FROM f JOIN h ON h.stream_id = f.stream_id AND h.part = f.part AND h.r = f.r + 1)
        SELECT stream_id, event_id, round(m, 6) AS mean, frame_count, CASE WHEN m >= 67 THEN 'high' WHEN m >= 35 THEN 'medium' ELSE 'low' END AS band, coalesce(fires, FALSE) AS alert FROM d LEFT JOIN f USING (stream_id, part, event_id)"""),
    "str5_cancelled": """SELECT 'cancelled' AS ended, event_type, count(*) AS n, count(DISTINCT event_id) AS events, count(*) FILTER (WHERE value >= 50) AS high FROM events WHERE event_id % 4 = 0 GROUP BY event_type
        UNION ALL SELECT 'done', event_type, count(*), count(DISTINCT event_id), count(*) FILTER (WHERE value >= 50) FROM events GROUP BY event_type""",
    "udf3_rejects": f"WITH {_JUDGED} SELECT profile, kind, why, count(*) AS n FROM j WHERE why IS NOT NULL GROUP BY profile, kind, why",
    "udf3_profiles": f"""WITH {_JUDGED}, d AS (SELECT doc_id, lower(coalesce(text, '')) AS low FROM documents),
        points AS (SELECT doc_id, profile, component, greatest(0, least(coalesce((SELECT max(value) FROM ok c WHERE c.kind = 'cap' AND c.profile = o.profile AND c.component = o.component), 100), sum(value * ((length(low) - length(replace(low, lower(key), ''))) // length(key))))) AS s FROM d CROSS JOIN (SELECT * FROM ok WHERE kind = 'term') o GROUP BY doc_id, profile, component),
        weighed AS (SELECT p.*, CASE WHEN (SELECT count(*) FROM ok f WHERE f.kind = 'fusion' AND f.profile = p.profile) = 0 THEN 1.0 ELSE coalesce(f.value, 0) END AS w FROM points p LEFT JOIN ok f ON f.kind = 'fusion' AND f.profile = p.profile AND f.component = p.component),
        fused AS (SELECT doc_id, profile, string_agg(component || '=' || CAST(round(s * 2) AS BIGINT), ',' ORDER BY component || '=' || CAST(round(s * 2) AS BIGINT)) AS components, CAST(least(100, greatest(0, round_even(round(sum(s * w) / sum(w), 9), 0))) AS INTEGER) AS score, max(s) AS most FROM weighed GROUP BY doc_id, profile),
        lim AS (SELECT profile, coalesce(max(value) FILTER (WHERE kind = 'threshold' AND key = 'high'), 67) AS hi, coalesce(max(value) FILTER (WHERE kind = 'threshold' AND key = 'medium'), 35) AS mid, coalesce(max(value) FILTER (WHERE kind = 'threshold' AND key = 'unknown_below'), 8) AS low FROM ok GROUP BY profile)
        SELECT doc_id, profile, components, score, CASE WHEN score < low AND most = 0 THEN 'unknown' WHEN score >= hi THEN 'high' WHEN score >= mid THEN 'medium' ELSE 'low' END AS band FROM fused JOIN lim USING (profile)""",
    "snk2_review_sheet": oracle("""WITH e AS (SELECT *, list_filter([{'s': score, 'i': 0, 'n': 'a', 'ok': TRUE}, {'s': score + 1, 'i': 1, 'n': 'b', 'ok': item_id % 5 > 0}, {'s': 60, 'i': 2, 'n': 'c', 'ok': TRUE}, {'s': score, 'i': 3, 'n': 'd', 'ok': TRUE}], lambda x: x.ok AND x.s >= 45) AS ex, item_id % 3 = 0 AND item_id % 2 = 0 AS px, item_id % 5 = 0 AS om, status = 'analyzed' AS done FROM items_base)
        SELECT path, 'text' AS kind, status, CASE WHEN done THEN score END AS score, CASE WHEN done THEN CASE band WHEN 'high' THEN '높음' WHEN 'medium' THEN '주의' WHEN 'low' THEN '낮음' ELSE '판단 어려움' END END AS risk,
        CASE WHEN px THEN score END AS pixel_score, CASE WHEN px THEN band END AS pixel_confidence, CASE WHEN px THEN 'px' END AS pixel_model, CASE WHEN px THEN 'mean' END AS pixel_fusion, CASE WHEN px AND len(ex) > 0 THEN array_to_string(list_transform(list_sort(list_transform(ex, lambda x: {'k': -x.s, 'i': x.i, 'n': x.n})), lambda x: x.n), ';') END AS pixel_top_experts,
        CASE WHEN om THEN lang END AS external_model, CASE WHEN om THEN 100 - score END AS external_model_score, CASE WHEN item_id % 3 = 0 AND item_id % 4 = 0 THEN 'h/' || path END AS heatmap_path, CASE WHEN done THEN source END AS source, CASE WHEN done THEN CASE WHEN item_id % 2 = 0 THEN 'high' ELSE 'unknown' END END AS source_confidence,
        CASE WHEN done AND item_id % 7 > 0 THEN 'the "' || lang || '", first' END AS top_signal, CASE WHEN status = 'failed' THEN 'no reader, damaged' END AS error FROM e"""),
}
