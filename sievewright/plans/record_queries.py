"""Queries of scan records and corpora, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sievewright.functions.catalogue import TOOLS
from sievewright.operators import records as R
from sievewright.plans.base import oracle, sql
from sievewright.sources import readers

#: The tool catalogue, and tools whose names the tables' own words stand in for.
_ROWS = ", ".join("('{}', '{}')".format(name.replace("'", "''"), marker.replace("'", "''")) for name, _, markers, _ in TOOLS for marker in markers)
LEXICON = "SELECT * FROM (VALUES ('alpha', 'the'), ('alpha', 'ation'), ('beta', 'and of'), ('beta', 'ing'), ('gamma', 'ción'), ('gamma', 'de la'), ('delta', 'över'), ('delta', 'der'), ('epsilon', 'mit license'), ('epsilon', 'gpl'), " + _ROWS + ") AS l(tool, marker)"
CORPUS = """SELECT doc_id AS item_id, CASE doc_id % 4 WHEN 0 THEN 'train/1_fake/' WHEN 1 THEN 'valid/0_real/' WHEN 2 THEN 'test/ai/edited/' ELSE 'misc/' END || source || '/' || CAST(doc_id AS VARCHAR(20)) || CASE WHEN doc_id % 6 = 0 THEN '_mask.png' ELSE '.png' END AS path, text, source FROM documents"""
EDGES = "SELECT doc_id AS src, CAST(floor(doc_id / 3) AS BIGINT) AS dst FROM documents WHERE doc_id > 0"
REVIEWS = """SELECT event_id, user_id AS artifact_id, ts, CASE WHEN event_type = 'click' THEN TRUE WHEN event_type = 'error' THEN FALSE END AS star, CASE WHEN event_id % 3 = 0 THEN 'n' || CAST(event_id AS VARCHAR(20)) END AS note,
  CASE WHEN event_id % 5 = 0 THEN 'a' || CAST(event_id % 7 AS VARCHAR(20)) END AS analyst_id, CASE WHEN event_id % 4 = 0 THEN event_type END AS verdict, user_id % 6 = 0 AND event_id % 2 = 0 AS deleted FROM events"""


def _items(spark, sf):
    return sql(spark, sf, "SELECT * FROM items_base")


def _corpus(spark, sf):
    return sql(spark, sf, CORPUS)


def src2_kinds(spark, sf):
    d = sql(spark, sf, "SELECT path FROM items_base UNION ALL SELECT url AS path FROM pages")
    return d.groupBy(R.kind(F.col("path")).alias("kind")).agg(F.count("*").alias("n"))


def src3_guard(spark, sf):
    return R.guarded(_items(spark, sf), 5000).groupBy("status").agg(F.count("*").alias("n"))


def src3_capped(spark, sf):
    """A scan of at most 40 items of all, with the flag that says there are more, and one of as many as there may be."""
    items = R.guarded(sql(spark, sf, "SELECT path, status, size_bytes FROM items_base"), 5000)
    nations = sql(spark, sf, "SELECT n_name AS path, 'pending' AS status, CAST(n_nationkey AS BIGINT) AS size_bytes FROM nation")
    return readers.capped(items, "path", 40).unionByName(readers.capped(nations, "path", 40))


def src4_prefix(spark, sf):
    d = sql(spark, sf, "SELECT doc_id, text FROM documents").withColumn("content", F.encode("text", "UTF-8"))
    return d.select("doc_id", F.md5(F.substring("text", 1, 65536)).alias("prefix_md5"), F.md5(readers.text_prefix(F.col("content"))).alias("bytes_md5"), F.length(readers.text_prefix(F.col("content"), 1001)).alias("letters_of_1001"))


def src5_labels(spark, sf):
    return R.path_labels(_corpus(spark, sf)).groupBy("label", "split").agg(F.count("*").alias("n"), F.countDistinct("group_source").alias("sources"))


def src10_scores(spark, sf):
    """Detector scores by full path, then by basename; shares of one count as percent."""
    items = sql(spark, sf, "SELECT item_id, path FROM items_base")
    scores = sql(spark, sf, "SELECT CASE item_id % 2 WHEN 0 THEN path ELSE 'old/f' || CAST(item_id AS VARCHAR(20)) || '.png' END AS k, CASE item_id % 3 WHEN 0 THEN score / 100.0 ELSE score + 0.5 END AS value FROM items_base WHERE item_id % 5 <> 0")
    by_path = scores.select(F.col("k").alias("path"), F.col("value").alias("v1"))
    by_name = scores.groupBy(R.display_path(F.col("k")).alias("base")).agg(F.max("value").alias("v2"))
    d = items.join(by_path, "path", "left").withColumn("base", R.display_path(F.col("path"))).join(by_name, "base", "left")
    v = F.coalesce("v1", "v2").cast("double")
    return d.select("item_id", F.least(F.greatest(F.bround(F.when(v.between(0, 1), v * 100).otherwise(v)), F.lit(0)), F.lit(100)).cast("int").alias("score"))


def snk2_review_rows(spark, sf):
    d = _items(spark, sf)
    return d.select("path", R.kind(F.col("path")).alias("kind"), "status", F.when(F.col("status") == "analyzed", F.col("score")).alias("score"), F.when(F.col("status") == "analyzed", F.col("band")).alias("band"), "size_bytes")


def snk3_cases(spark, sf):
    s = sql(spark, sf, "SELECT * FROM scored_base")
    case = F.when((F.col("score") >= 67) & (F.col("label") == 0), "false_positive").when((F.col("score") < 67) & (F.col("label") == 1), "false_negative")
    return s.withColumn("case_type", case).where("case_type IS NOT NULL").select("case_type", "item_id", "score", "label")


def snk4_reviews(spark, sf):
    return R.reviews(sql(spark, sf, REVIEWS))


def flt1_bands(spark, sf):
    from sievewright.functions.columns import band

    return _items(spark, sf).select("item_id", band(F.col("score")).alias("scan_band"), band(F.col("score"), 35, 20).alias("screen_band"), band(F.col("score"), 50, 20, F.col("status") != "analyzed").alias("marker_band"))


def flt3_priority(spark, sf):
    return _items(spark, sf).where((F.col("status") == "analyzed") & F.col("band").isin("high", "medium", "unknown")).select("item_id", "band")


def flt4_display(spark, sf):
    return _items(spark, sf).select("item_id", R.display_path(F.col("path")).alias("name"), R.display_path(F.col("path"), "src0").alias("relative"))


def flt5_catalogue(spark, sf):
    focus = "BRAND#1"
    d = sql(spark, sf, "SELECT p_partkey, p_name, p_type, p_brand FROM part")
    return d.where(F.contains(F.lower(F.concat_ws(" ", "p_name", "p_type", "p_brand")), F.lit(focus.lower()))).select("p_partkey")


def flt6_modality(spark, sf):
    """Members that fit an item's kind: the declared modality, else the runtime's, else any."""
    members = sql(spark, sf, "SELECT * FROM (VALUES ('m1', 'image', 'onnx'), ('m2', NULL, 'aasist'), ('m3', NULL, 'other'), ('m4', 'text', 'hf')) AS m(member, declared, runtime)")
    runtime = F.when(F.col("runtime") == "aasist", "audio")
    members = members.withColumn("modality", F.coalesce("declared", runtime, F.lit("any")))
    items = _items(spark, sf).withColumn("kind", R.kind(F.col("path")))
    fit = (F.col("modality") == F.col("kind")) | (F.col("modality") == "any")
    return items.join(F.broadcast(members), fit).select("item_id", "member")


def flt8_cutoffs(spark, sf):
    """Each source's cutoffs from a profile of measured values, else the defaults."""
    defaults = sql(spark, sf, "SELECT * FROM (VALUES ('high', 67.0), ('medium', 35.0), ('seam', 1.5)) AS d(key, value)")
    profile = sql(spark, sf, "SELECT source, 'high' AS key, CAST(max(n_chars % 101) AS DOUBLE) AS measured FROM documents WHERE doc_id % 3 = 0 GROUP BY source")
    groups = sql(spark, sf, "SELECT DISTINCT source FROM documents")
    d = groups.crossJoin(F.broadcast(defaults)).join(profile, ["source", "key"], "left")
    return d.groupBy("source").pivot("key", ["high", "medium", "seam"]).agg(F.max(F.coalesce("measured", F.col("value").cast("double"))))


def jn1_duplicates(spark, sf):
    return R.duplicates(sql(spark, sf, "SELECT doc_id, text FROM documents"), "text", "doc_id").select("doc_id", "content_hash", "duplicate_of")


def jn2_known(spark, sf):
    items = R.duplicates(sql(spark, sf, "SELECT doc_id, text FROM documents WHERE doc_id % 3 > 0"), "text", "doc_id").drop("text")
    known = R.duplicates(sql(spark, sf, "SELECT doc_id, text FROM documents WHERE doc_id % 3 = 0"), "text", "doc_id").where("duplicate_of IS NULL").select("content_hash", "doc_id")
    marked, new = R.against_known(items, known, "doc_id")
    return marked.select("doc_id", "duplicate_of", F.lit("item").alias("part")).unionByName(new.select("doc_id", F.lit(None).cast("long").alias("duplicate_of"), F.lit("append").alias("part")))


def jn3_cache(spark, sf):
    d = sql(spark, sf, "SELECT doc_id, source, n_chars FROM documents")
    keyed = d.withColumn("cache_key", R.cache_key(F.col("source"), F.col("doc_id"), F.col("n_chars"), F.lit("v1")))
    cache = keyed.where("doc_id % 4 <> 0").select("cache_key", (F.col("n_chars") % 101).alias("cached_score"))
    work, reused = R.with_cache(keyed, cache)
    return work.select("doc_id", F.lit(None).cast("long").alias("cached_score")).unionByName(reused.select("doc_id", "cached_score"))


def jn5_markers(spark, sf):
    return R.marker_hits(sql(spark, sf, "SELECT doc_id, text FROM documents"), sql(spark, sf, LEXICON), "doc_id", "text")


def prv1_tools(spark, sf):
    hits = R.marker_hits(sql(spark, sf, "SELECT doc_id, text FROM documents"), sql(spark, sf, LEXICON), "doc_id", "text")
    d = R.tool_matches(hits, "doc_id")
    return d.select("doc_id", "tool", "hits", F.round("confidence", 6).alias("confidence"), "label", "place")


def jn7_masks(spark, sf):
    return R.masks(sql(spark, sf, f"SELECT path FROM ({CORPUS}) UNION ALL SELECT replace(path, '_mask.png', '.png') FROM ({CORPUS}) WHERE path LIKE '%_mask.png'"))


def jn10_containers(spark, sf):
    d = sql(spark, sf, "SELECT source || '/a' || CAST(item_id % 40 AS VARCHAR(20)) || '.zip::f' || CAST(item_id AS VARCHAR(20)) AS path, CASE WHEN item_id % 40 = 7 THEN 'failed' ELSE status END AS status, score, band FROM items_base")
    return R.containers(d)


def jn11_orphans(spark, sf):
    return R.orphans(sql(spark, sf, "SELECT doc_id AS item_id FROM documents WHERE doc_id % 7 <> 0"), sql(spark, sf, EDGES))


def jn11_ancestors(spark, sf):
    return R.ancestors(sql(spark, sf, EDGES))


def agg1_summary(spark, sf):
    return R.summary(_items(spark, sf), ["lang"])


def agg14_sources(spark, sf):
    d = sql(spark, sf, "SELECT *, CASE item_id % 5 WHEN 0 THEN 'unknown' WHEN 1 THEN source ELSE 'src1' END AS guess, CASE item_id % 3 WHEN 0 THEN 'high' ELSE 'medium' END AS confidence FROM scored_base")
    known = F.col("guess") != "unknown"
    return d.groupBy("source").agg(F.count("*").alias("samples"), F.count_if(known).alias("with_guess"), F.count_if(known & (F.col("confidence") == "high")).alias("high_guess"), F.round(F.count_if(~known) / F.greatest(F.lit(1), F.count("*")), 6).alias("unknown_rate"))


def agg15_audit(spark, sf):
    c = R.path_labels(sql(spark, sf, CORPUS)).withColumn("content_hash", F.sha2("text", 256))
    return R.audit(c)


def agg16_fingerprint(spark, sf):
    c = sql(spark, sf, "SELECT doc_id, source, lang, text FROM documents").withColumn("content_hash", F.sha2("text", 256))
    return R.fingerprint(c, ["source"], "lang", "content_hash")


def agg16_bucketed(spark, sf):
    c = sql(spark, sf, "SELECT lang, text FROM documents").withColumn("content_hash", F.sha2("text", 256))
    return R.fingerprint(c, [], "lang", "content_hash")


def agg16_tree(spark, sf):
    """The root of the tree of digests of each source's items in path order, and of all items'."""
    d = _items(spark, sf).select(F.explode(F.array("source", F.lit("<all>"))).alias("source"), "path", "band", F.sha2("text", 256).alias("content_hash"))
    return R.tree_root(d, ["source"], "path", "band", "content_hash")


def agg17_gaps(spark, sf):
    need = sql(spark, sf, "SELECT source, CAST(20 + length(source) * 10 AS BIGINT) AS required FROM (SELECT DISTINCT source FROM documents)")
    have = sql(spark, sf, "SELECT d.source, count(*) AS present FROM documents d JOIN labels l ON l.doc_id = d.doc_id GROUP BY d.source")
    return need.join(have, "source", "left").select("source", "required", F.coalesce("present", F.lit(0)).alias("present"), F.greatest(F.col("required") - F.coalesce("present", F.lit(0)), F.lit(0)).alias("missing"))


def agg18_cube(spark, sf):
    d = sql(spark, sf, "SELECT label, lang, split FROM scored_base")
    return d.cube("label", "lang", "split").agg(F.count("*").alias("n"))


def agg19_throughput(spark, sf):
    d = sql(spark, sf, "SELECT user_id % 10 AS run, event_type, value, event_id FROM events")
    n = F.greatest(F.lit(1), F.count("*"))
    return d.groupBy("run").agg(
        F.count("*").alias("files"), F.round(F.count("*") / F.greatest(F.sum("value") / 1000, F.lit(0.000001)), 4).alias("files_per_second"),
        F.round(F.count_if(F.col("event_type") == "view") / n, 6).alias("cache_rate"), F.round(F.count_if(F.col("event_id") % 7 == 0) / n, 6).alias("duplicate_rate"),
    )


def agg20_jobs(spark, sf):
    d = sql(spark, sf, "SELECT user_id % 12 AS job, event_type, value FROM events")
    ok = F.col("event_type") != "error"
    return d.groupBy("job").agg(F.count("*").alias("total"), F.count_if(ok).alias("succeeded"), F.round(F.count_if(ok) / F.greatest(F.lit(1), F.count("*")), 6).alias("success_rate"), F.round(F.avg("value"), 4).alias("mean_time"), F.round(F.sum("value"), 2).alias("total_time"))


def srt1_review_order(spark, sf):
    d = _items(spark, sf).select("item_id", "source", "path", "status", "band", "score")
    return R.review_order(d, ["source"]).select("item_id", "source", "place")


def srt1_review_list(spark, sf):
    """One review list over all sources."""
    d = _items(spark, sf).select("item_id", "path", "status", "band", "score")
    return R.review_order(d).select("item_id", "place")


def srt2_worst(spark, sf):
    c = snk3_cases(spark, sf).join(sql(spark, sf, "SELECT item_id, source FROM scored_base"), "item_id")
    key = F.when(F.col("case_type") == "false_positive", -F.col("score")).otherwise(F.col("score"))
    return c.withColumn("place", F.row_number().over(Window.partitionBy("source", "case_type").orderBy(key, "item_id"))).where("place <= 5").select("source", "case_type", "item_id", "place")


def srt3_top_experts(spark, sf):
    d = sql(spark, sf, "SELECT l_orderkey AS item_id, l_linenumber AS expert, CAST((l_partkey + l_suppkey) % 101 AS INTEGER) AS score FROM lineitem")
    return d.where("score >= 45").withColumn("place", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "expert"))).where("place <= 5")


def set1_missing_splits(spark, sf):
    d = sql(spark, sf, "SELECT source, lang, label, split FROM scored_base")
    have = d.groupBy("source", "lang", "label").agg(F.collect_set("split").alias("have"))
    return have.select("source", "lang", "label", F.array_join(F.array_sort(F.array_except(F.array(*map(F.lit, R.REQUIRED_SPLITS)), "have")), ",").alias("missing"))


def set2_union(spark, sf):
    a = sql(spark, sf, "SELECT doc_id AS item_id, source, lang FROM documents")
    b = sql(spark, sf, "SELECT conv_id AS item_id, role AS source, turn FROM conversations")
    return a.unionByName(b, allowMissingColumns=True).groupBy("source").agg(F.count("*").alias("n"), F.count("lang").alias("with_lang"), F.count("turn").alias("with_turn"))


def set3_leaks(spark, sf):
    d = sql(spark, sf, "SELECT text, CASE WHEN doc_id % 10 < 7 THEN 'train' ELSE 'test' END AS split FROM documents").select(F.sha2("text", 256).alias("content_hash"), "split")
    return d.groupBy("content_hash").agg(F.countDistinct("split").alias("splits"), F.count("*").alias("n")).where("splits > 1")


def smp1_split(spark, sf):
    d = sql(spark, sf, "SELECT doc_id FROM documents")
    return d.select("doc_id", R.split("seed", F.col("doc_id")).alias("split"), F.round(R.unit_interval("seed", F.col("doc_id")), 9).alias("unit"))


def smp2_per_class(spark, sf):
    d = sql(spark, sf, "SELECT item_id, label, source FROM scored_base")
    place = F.row_number().over(Window.partitionBy("source", "label").orderBy(F.sha2(F.concat(F.lit("7:"), F.col("item_id").cast("string")), 256)))
    return d.withColumn("place", place).where("place <= 3").select("source", "label", "item_id")


QUERIES = {k: f for k, f in list(globals().items()) if k[:3] in ("src", "snk", "flt", "srt", "set", "smp", "agg", "prv") and callable(f) or k[:2] == "jn" and callable(f)}

_KIND = "CASE " + " ".join(f"WHEN lower(regexp_extract(path, '(\\.[^./]+)$', 1)) IN ({', '.join(repr(e) for e in v)}) THEN '{k}'" for k, v in R.KINDS.items()) + " ELSE 'unsupported' END"
_CASES = "SELECT CASE WHEN score >= 67 AND label = 0 THEN 'false_positive' WHEN score < 67 AND label = 1 THEN 'false_negative' END AS case_type, item_id, score, label, source FROM scored_base"
_PARTS = f"""c AS ({CORPUS}), p AS (SELECT *, list_transform(string_split(lower(path), '/')[1:len(string_split(path, '/')) - 1], lambda x: regexp_replace(x, '^\\d+_', '')) AS parts FROM c),
lab AS (SELECT *, CASE WHEN list_has_any(parts, ['edited', 'tampered', 'manipulated']) THEN 'edited' WHEN list_has_any(parts, ['ai', 'fake', 'synthetic', 'generated']) THEN 'ai' WHEN list_has_any(parts, ['real', 'human', 'camera', 'authentic']) THEN 'human' ELSE 'unknown' END AS label,
 CASE WHEN list_contains(parts, 'train') THEN 'train' WHEN list_has_any(parts, ['val', 'valid', 'validation']) THEN 'val' WHEN list_contains(parts, 'test') THEN 'test' ELSE 'unspecified' END AS split FROM p)"""
_HITS = f"l AS ({LEXICON}), h AS (SELECT doc_id, tool, marker FROM documents, l WHERE contains(lower(text), marker) AND (NOT regexp_matches(marker, '^[\\x00-\\x7F]*$') OR regexp_matches(lower(text), '(^|[^a-z0-9])' || regexp_escape(marker) || '($|[^a-z0-9])')))"

_BUCKETS = "WITH h AS (SELECT source, sha256(lang || ':' || sha256(text)) AS d FROM documents), d AS (SELECT source, left(d, 3) AS b, ('0x' || substring(d, 4, 15))::UBIGINT AS x, ('0x' || substring(d, 19, 15))::UBIGINT AS y FROM h)"
_SUMS = "b || ',' || count(*) || ',' || sum(x) || ',' || sum(y) AS line"


def _bytes(n: int) -> str:
    """The first n bytes of a text, a letter that they cut through as a replacement letter."""
    cut = lambda t: f"TRY(decode(unhex(left(hex(encode(text)), {2 * (n - t)}))))"
    return f"CASE WHEN strlen(text) <= {n} THEN text ELSE coalesce({cut(0)}, {cut(1)} || chr(65533), {cut(2)} || chr(65533), {cut(3)} || chr(65533)) END"


SQL = {
    "src2_kinds": oracle(f"SELECT {_KIND} AS kind, count(*) AS n FROM (SELECT path FROM items_base UNION ALL SELECT url FROM pages) GROUP BY 1"),
    "src3_guard": oracle("SELECT CASE WHEN size_bytes > 5000 THEN 'skipped' ELSE status END AS status, count(*) AS n FROM items_base GROUP BY 1"),
    "src4_prefix": f"SELECT doc_id, md5(left(text, 65536)) AS prefix_md5, md5({_bytes(65536)}) AS bytes_md5, length({_bytes(1001)}) AS letters_of_1001 FROM documents",
    "src3_capped": oracle("WITH i AS (SELECT path, CASE WHEN size_bytes > 5000 THEN 'skipped' ELSE status END AS status, size_bytes FROM items_base), a AS (SELECT *, count(*) OVER () > 40 AS capped FROM i ORDER BY path LIMIT 40) SELECT * FROM a UNION ALL SELECT n_name, 'pending', CAST(n_nationkey AS BIGINT), FALSE FROM nation"),
    "src5_labels": f"WITH {_PARTS} SELECT label, split, count(*) AS n, count(DISTINCT coalesce(list_filter(parts, lambda x: NOT list_contains(['edited', 'ai', 'fake', 'real', 'train', 'val', 'valid', 'test', ''], x))[1], 'unknown')) AS sources FROM lab GROUP BY label, split",
    "src10_scores": oracle("WITH s AS (SELECT CASE item_id % 2 WHEN 0 THEN path ELSE 'old/f' || item_id || '.png' END AS k, CASE item_id % 3 WHEN 0 THEN score / 100.0 ELSE score + 0.5 END AS value FROM items_base WHERE item_id % 5 <> 0), n AS (SELECT string_split(k, '/')[-1] AS base, max(value) AS v FROM s GROUP BY 1), j AS (SELECT item_id, coalesce(s.value, n.v) AS v FROM items_base i LEFT JOIN s ON s.k = i.path LEFT JOIN n ON n.base = string_split(i.path, '/')[-1]) SELECT item_id, CASE WHEN v IS NOT NULL THEN CAST(least(100, greatest(0, round_even(CAST(CASE WHEN v BETWEEN 0 AND 1 THEN v * 100 ELSE v END AS DOUBLE), 0))) AS INT) ELSE 0 END AS score FROM j"),
    "snk2_review_rows": oracle(f"SELECT path, {_KIND} AS kind, status, CASE WHEN status = 'analyzed' THEN score END AS score, CASE WHEN status = 'analyzed' THEN band END AS band, size_bytes FROM items_base"),
    "snk3_cases": oracle(f"WITH c AS ({_CASES}) SELECT case_type, item_id, score, label FROM c WHERE case_type IS NOT NULL"),
    "snk4_reviews": f"""WITH r AS ({REVIEWS}), f AS (SELECT artifact_id, min(ts) AS created_at, max(ts) AS updated_at, arg_max(star, (ts, event_id)) FILTER (WHERE star IS NOT NULL) AS star, arg_max(note, (ts, event_id)) FILTER (WHERE note IS NOT NULL) AS note, arg_max(analyst_id, (ts, event_id)) FILTER (WHERE analyst_id IS NOT NULL) AS analyst_id, arg_max(verdict, (ts, event_id)) FILTER (WHERE verdict IS NOT NULL) AS verdict, arg_max(deleted, (ts, event_id)) AS deleted FROM r GROUP BY artifact_id)
        SELECT artifact_id, created_at, updated_at, star, note, analyst_id, verdict FROM f WHERE NOT deleted AND (coalesce(star, FALSE) OR coalesce(note, analyst_id, verdict) IS NOT NULL)""",
    "flt1_bands": oracle("SELECT item_id, CASE WHEN score >= 67 THEN 'high' WHEN score >= 35 THEN 'medium' ELSE 'low' END AS scan_band, CASE WHEN score >= 35 THEN 'high' WHEN score >= 20 THEN 'medium' ELSE 'low' END AS screen_band, CASE WHEN status <> 'analyzed' THEN 'unknown' WHEN score >= 50 THEN 'high' WHEN score >= 20 THEN 'medium' ELSE 'low' END AS marker_band FROM items_base"),
    "flt3_priority": oracle("SELECT item_id, band FROM items_base WHERE status = 'analyzed' AND band <> 'low'"),
    "flt4_display": oracle("SELECT item_id, string_split(path, '/')[-1] AS name, regexp_replace(path, '^src0/', '') AS relative FROM items_base"),
    "flt5_catalogue": "SELECT p_partkey FROM part WHERE contains(lower(p_name || ' ' || p_type || ' ' || p_brand), 'brand#1')",
    "flt6_modality": oracle(f"SELECT item_id, member FROM (SELECT item_id, {_KIND} AS kind FROM items_base) i JOIN (VALUES ('m1', 'image'), ('m2', 'audio'), ('m3', 'any'), ('m4', 'text')) m(member, modality) ON modality = kind OR modality = 'any'"),
    "flt8_cutoffs": "SELECT s.source, CAST(coalesce(max(n_chars % 101) FILTER (WHERE doc_id % 3 = 0), 67) AS DOUBLE) AS high, CAST(35 AS DOUBLE) AS medium, CAST(1.5 AS DOUBLE) AS seam FROM documents s GROUP BY s.source",
    "jn1_duplicates": "SELECT doc_id, sha256(text) AS content_hash, CASE WHEN doc_id <> min(doc_id) OVER (PARTITION BY text) THEN min(doc_id) OVER (PARTITION BY text) END AS duplicate_of FROM documents",
    "jn2_known": "WITH i AS (SELECT doc_id, text, min(doc_id) OVER (PARTITION BY text) AS k FROM documents WHERE doc_id % 3 > 0), old AS (SELECT text, min(doc_id) AS o FROM documents WHERE doc_id % 3 = 0 GROUP BY text) SELECT doc_id, coalesce(CASE WHEN k <> doc_id THEN k END, o) AS duplicate_of, 'item' AS part FROM i LEFT JOIN old USING (text) UNION ALL SELECT doc_id, NULL, 'append' FROM i WHERE k = doc_id AND text NOT IN (SELECT text FROM old)",
    "jn3_cache": "SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN n_chars % 101 END AS cached_score FROM documents",
    "jn5_markers": f"WITH {_HITS} SELECT * FROM h",
    "prv1_tools": f"WITH {_HITS}, c AS (SELECT doc_id, tool, count(DISTINCT marker) AS hits FROM h GROUP BY ALL), d AS (SELECT *, least(1.0, 0.6 + (hits - 1) * 0.15) AS confidence FROM c) SELECT doc_id, tool, hits, CAST(round(confidence, 6) AS DOUBLE) AS confidence, CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' ELSE 'low' END AS label, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, tool) AS place FROM d QUALIFY place <= 5",
    "jn7_masks": f"WITH c AS ({CORPUS}), p AS (SELECT path FROM c UNION ALL SELECT replace(path, '_mask.png', '.png') FROM c WHERE path LIKE '%\\_mask.png' ESCAPE '\\') SELECT a.path, b.path AS mask_path FROM p a JOIN p b ON b.path = regexp_replace(a.path, '\\.[^./]+$', '') || '_mask.png'",
    "jn10_containers": oracle("WITH m AS (SELECT source || '/a' || item_id % 40 || '.zip' AS archive, CASE WHEN item_id % 40 = 7 THEN 'failed' ELSE status END AS status, score, band FROM items_base), a AS (SELECT archive, count(*) AS members, count(*) FILTER (WHERE status = 'analyzed') AS analyzed, coalesce(max(score) FILTER (WHERE status = 'analyzed'), 0) AS score, max(CASE band WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END) FILTER (WHERE status = 'analyzed') AS r FROM m GROUP BY archive) SELECT archive, members, analyzed, score, CASE r WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' ELSE 'unknown' END AS band FROM a"),
    "jn11_orphans": f"WITH e AS ({EDGES}), i AS (SELECT doc_id FROM documents WHERE doc_id % 7 <> 0) SELECT src, dst, 'src' AS missing FROM e WHERE src NOT IN (SELECT doc_id FROM i) UNION ALL SELECT src, dst, 'dst' FROM e WHERE dst NOT IN (SELECT doc_id FROM i)",
    "jn11_ancestors": f"WITH RECURSIVE e AS ({EDGES}), up(src, ancestor, depth) AS (SELECT src, dst, 1 FROM e UNION ALL SELECT u.src, e.dst, u.depth + 1 FROM up u JOIN e ON e.src = u.ancestor WHERE u.depth < 32) SELECT src, ancestor, min(depth) AS depth FROM up GROUP BY src, ancestor",
    "agg1_summary": oracle("SELECT lang, count(*) AS total, count(*) FILTER (WHERE status = 'analyzed') AS analyzed, " + ", ".join(f"count(*) FILTER (WHERE status = 'analyzed' AND band = '{b}') AS {b}" for b in ("high", "medium", "unknown", "low")) + ", count(*) FILTER (WHERE status NOT IN ('analyzed', 'duplicate', 'skipped')) AS unsupported_or_failed, count(*) FILTER (WHERE status = 'duplicate') AS duplicates, count(*) FILTER (WHERE status = 'skipped') AS skipped FROM items_base GROUP BY lang"),
    "agg14_sources": oracle("SELECT source, count(*) AS samples, count(*) FILTER (WHERE item_id % 5 <> 0) AS with_guess, count(*) FILTER (WHERE item_id % 5 <> 0 AND item_id % 3 = 0) AS high_guess, round(count(*) FILTER (WHERE item_id % 5 = 0) / count(*), 6) AS unknown_rate FROM scored_base GROUP BY source"),
    "agg15_audit": f"""WITH {_PARTS} SELECT source, 'missing_split' AS issue, s AS detail, 0 AS n FROM (SELECT DISTINCT source FROM lab) CROSS JOIN (VALUES ('train'), ('val'), ('test')) v(s) WHERE (source, s) NOT IN (SELECT source, split FROM lab)
        UNION ALL SELECT source, 'unknown_label', '', count(*) FROM lab WHERE label = 'unknown' GROUP BY source
        UNION ALL SELECT source, 'duplicate_groups', '', count(*) FROM (SELECT source, text FROM lab GROUP BY ALL HAVING count(*) > 1) GROUP BY source
        UNION ALL SELECT '', 'split_leak', '', count(*) FROM (SELECT text FROM lab GROUP BY text HAVING count(DISTINCT split) > 1) HAVING count(*) > 0""",
    "agg16_fingerprint": f"{_BUCKETS} SELECT source, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(line, ';' ORDER BY b)) AS fingerprint FROM (SELECT source, b, count(*) AS n, {_SUMS} FROM d GROUP BY source, b) GROUP BY source",
    "agg16_bucketed": f"{_BUCKETS} SELECT CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(line, ';' ORDER BY b)) AS fingerprint FROM (SELECT b, count(*) AS n, {_SUMS} FROM d GROUP BY b)",
    "agg17_gaps": "WITH h AS (SELECT d.source, count(*) AS present FROM documents d JOIN labels USING (doc_id) GROUP BY d.source) SELECT s.source, 20 + length(s.source) * 10 AS required, coalesce(present, 0) AS present, greatest(20 + length(s.source) * 10 - coalesce(present, 0), 0) AS missing FROM (SELECT DISTINCT source FROM documents) s LEFT JOIN h ON h.source = s.source",
    "agg18_cube": oracle("SELECT label, lang, split, count(*) AS n FROM scored_base GROUP BY CUBE (label, lang, split)"),
    "agg19_throughput": "SELECT user_id % 10 AS run, count(*) AS files, round(count(*) / greatest(sum(value) / 1000, 0.000001), 4) AS files_per_second, round(count(*) FILTER (WHERE event_type = 'view') / count(*), 6) AS cache_rate, round(count(*) FILTER (WHERE event_id % 7 = 0) / count(*), 6) AS duplicate_rate FROM events GROUP BY 1",
    "agg20_jobs": "SELECT user_id % 12 AS job, count(*) AS total, count(*) FILTER (WHERE event_type <> 'error') AS succeeded, round(count(*) FILTER (WHERE event_type <> 'error') / count(*), 6) AS success_rate, round(avg(value), 4) AS mean_time, round(sum(value), 2) AS total_time FROM events GROUP BY 1",
    "srt1_review_order": oracle("SELECT item_id, source, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN status <> 'analyzed' THEN 4 WHEN band = 'high' THEN 0 WHEN band = 'medium' THEN 1 WHEN band = 'unknown' THEN 2 ELSE 3 END, CASE WHEN status = 'analyzed' THEN score END DESC NULLS LAST, lower(path), path) AS place FROM items_base"),
    "srt2_worst": oracle(f"WITH c AS ({_CASES}) SELECT source, case_type, item_id, row_number() OVER (PARTITION BY source, case_type ORDER BY CASE WHEN case_type = 'false_positive' THEN -score ELSE score END, item_id) AS place FROM c WHERE case_type IS NOT NULL QUALIFY place <= 5"),
    "srt3_top_experts": "SELECT l_orderkey AS item_id, l_linenumber AS expert, CAST((l_partkey + l_suppkey) % 101 AS INTEGER) AS score, row_number() OVER (PARTITION BY l_orderkey ORDER BY (l_partkey + l_suppkey) % 101 DESC, l_linenumber) AS place FROM lineitem WHERE (l_partkey + l_suppkey) % 101 >= 45 QUALIFY place <= 5",
    "set1_missing_splits": oracle("SELECT source, lang, label, array_to_string(list_sort(list_filter(['train', 'val', 'test'], lambda x: NOT list_contains(have, x))), ',') AS missing FROM (SELECT source, lang, label, list(DISTINCT split) AS have FROM scored_base GROUP BY source, lang, label)"),
    "set2_union": "SELECT source, count(*) AS n, count(lang) AS with_lang, count(turn) AS with_turn FROM (SELECT doc_id, source, lang, NULL AS turn FROM documents UNION ALL SELECT conv_id, role, NULL, turn FROM conversations) GROUP BY source",
    "set3_leaks": "SELECT sha256(text) AS content_hash, count(DISTINCT doc_id % 10 < 7) AS splits, count(*) AS n FROM documents GROUP BY text HAVING count(DISTINCT doc_id % 10 < 7) > 1",
    "smp1_split": "WITH u AS (SELECT doc_id, CAST(('0x' || left(sha256('seed:' || doc_id), 16))::UBIGINT AS DOUBLE) / 18446744073709551615 AS x FROM documents) SELECT doc_id, CASE WHEN x < 0.7 THEN 'train' WHEN x < 0.85 THEN 'val' ELSE 'test' END AS split, round(x, 9) AS unit FROM u",
    "smp2_per_class": oracle("SELECT source, label, item_id FROM scored_base QUALIFY row_number() OVER (PARTITION BY source, label ORDER BY sha256('7:' || item_id)) <= 3"),
    "srt1_review_list": oracle("SELECT item_id, row_number() OVER (ORDER BY CASE WHEN status <> 'analyzed' THEN 4 WHEN band = 'high' THEN 0 WHEN band = 'medium' THEN 1 WHEN band = 'unknown' THEN 2 ELSE 3 END, CASE WHEN status = 'analyzed' THEN score END DESC NULLS LAST, lower(path), path) AS place FROM items_base"),
    "agg16_tree": oracle("""WITH c AS (SELECT unnest([source, '<all>']) AS source, coalesce(path, '') AS p, coalesce(band, '') AS l, coalesce(sha256(text), '') AS h FROM items_base),
        l0 AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY p, l, h) - 1 AS i, count(*) OVER (PARTITION BY source) AS n, sha256(p || '|' || l || '|' || h) AS d FROM c),
        l1 AS (SELECT source, n, i // 256 AS i, sha256(string_agg(d, '' ORDER BY i)) AS d FROM l0 GROUP BY source, n, i // 256),
        l2 AS (SELECT source, n, i // 256 AS i, CASE WHEN n <= 256 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY i)) END AS d FROM l1 GROUP BY source, n, i // 256),
        l3 AS (SELECT source, n, i // 256 AS i, CASE WHEN n <= 65536 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY i)) END AS d FROM l2 GROUP BY source, n, i // 256),
        l4 AS (SELECT source, n, i // 256 AS i, CASE WHEN n <= 16777216 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY i)) END AS d FROM l3 GROUP BY source, n, i // 256)
        SELECT source, n, d AS root FROM l4"""),
}
