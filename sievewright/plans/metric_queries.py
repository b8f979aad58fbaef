"""Queries of metrics, calibration and feedback, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievewright.functions.columns import clamp
from sievewright.operators import calibrate, feedback, metrics
from sievewright.plans.base import oracle, sql
from sievewright.plans.text_queries import SIGNALS


def _scored(spark, sf):
    return sql(spark, sf, "SELECT * FROM scored_base")


def _rounded(df, *keep):
    return df.select(*[F.round(F.col(c), 6).alias(c) if k == "double" and c not in keep else F.col(c) for c, k in df.dtypes])


MEMBERS = """
SELECT item_id, label, 'm' || CAST(k AS VARCHAR(2)) AS member, CAST((score * (k + 3) + item_id * k) % 101 AS INTEGER) AS score, (item_id + k) % 9 <> 0 AS available
FROM scored_base CROSS JOIN (VALUES (1), (2), (3), (4)) AS ks(k)
"""
CONFIGS = "SELECT item_id, label, 'c' || CAST(k AS VARCHAR(2)) AS config, CAST((score * k + 11 * k) % 101 AS INTEGER) AS score FROM scored_base CROSS JOIN (VALUES (1), (2), (3), (5)) AS ks(k)"
LAYERS = """
SELECT 'seam' AS metric, 'ratio' AS kind, 0.5 + score / 50.0 AS value, label FROM scored_base
UNION ALL SELECT 'face', 'score', CAST(score AS DOUBLE) + label * 40, label FROM scored_base
UNION ALL SELECT 'noise', 'one', CAST(score AS DOUBLE) / 7 + label * 3, label FROM scored_base
"""
OBSERVED = "SELECT item_id, label, score AS metadata, CAST((score * 3 + label * 20) % 101 AS INTEGER) AS pixel, CAST((score + label * 50) % 101 AS INTEGER) AS external_model, CASE item_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 35 WHEN 2 THEN 65 ELSE 100 END AS source FROM scored_base"

_COUNTS = "count(*) AS n, count(*) FILTER (WHERE score >= {t} AND label = 1) AS tp, count(*) FILTER (WHERE score >= {t} AND label = 0) AS fp, count(*) FILTER (WHERE score < {t} AND label = 0) AS tn, count(*) FILTER (WHERE score < {t} AND label = 1) AS fn"
_RATES = "round(tp / greatest(1, tp + fp), 6) AS precision, round(tp / greatest(1, tp + fn), 6) AS recall, round((tp + tn) / greatest(1, tp + fp + tn + fn), 6) AS accuracy, round(fp / greatest(1, fp + tn), 6) AS fpr"


def _auroc(rows: str, by: str) -> str:
    return f"SELECT {by}, avg(CASE WHEN p.score > q.score THEN 1.0 WHEN p.score = q.score THEN 0.5 ELSE 0.0 END) AS auroc FROM (SELECT * FROM {rows} WHERE label = 1) p JOIN (SELECT * FROM {rows} WHERE label = 0) q USING ({by}) GROUP BY {by}"


def _roc(rows: str, by: str) -> str:
    """ROC points of DuckDB rows: every distinct score as threshold, by counting."""
    return f"""SELECT t.{by}, t.score AS threshold, count(*) FILTER (WHERE r.label = 1 AND r.score >= t.score) AS tp, count(*) FILTER (WHERE r.label = 0 AND r.score >= t.score) AS fp,
      count(*) FILTER (WHERE r.label = 1) AS p, count(*) FILTER (WHERE r.label = 0) AS q
      FROM (SELECT DISTINCT {by}, score FROM {rows}) t JOIN {rows} r ON r.{by} = t.{by} GROUP BY t.{by}, t.score"""


def agg2_binary(spark, sf):
    return _rounded(metrics.at_threshold(_scored(spark, sf), 67, ["lang"]))


def agg3_auroc(spark, sf):
    return _rounded(metrics.auroc(metrics.validated(_scored(spark, sf)), ["lang"]))


def agg4_roc(spark, sf):
    r = metrics.roc(_scored(spark, sf), ["split"])
    return r.select("split", F.round("threshold", 6).alias("threshold"), "tp", "fp", F.round("fpr", 6).alias("fpr"), F.round("fnr", 6).alias("fnr"))


def agg5_eer(spark, sf):
    return _rounded(metrics.interpolated_eer(_scored(spark, sf), ["lang"]))


def agg6_grid_eer(spark, sf):
    return _rounded(metrics.grid_eer(_scored(spark, sf), ["lang"]))


def agg7_threshold(spark, sf):
    s = metrics.curve(_scored(spark, sf), ["lang"])
    out = None
    for target in (0.01, 0.05, 0.2):
        one = metrics.threshold_at_fpr(s, target, ["lang"]).select("lang", F.lit(target).alias("target"), F.round("threshold", 6).alias("threshold"))
        out = one if out is None else out.unionByName(one)
    return out


def agg8_calibrated(spark, sf):
    return metrics.calibrated_threshold(_scored(spark, sf), 0.2, ["lang"]).select("lang", "threshold", "target_fpr_met", "tp", "fp")


def agg9_reasons(spark, sf):
    """Why a source, language and split has no AUROC; small groups lack a class."""
    return _rounded(metrics.auroc(_scored(spark, sf), ["source", "lang", "split"])).select("source", "lang", "split", "n", "reason")


def agg10_isotonic(spark, sf):
    """Fitted value of each distinct score: that of the first knot at or above it."""
    s = _scored(spark, sf)
    knots = calibrate.isotonic_knots(s, ["lang"])
    above = s.select("lang", "score").distinct().join(knots, "lang").where("knot >= score")
    return above.groupBy("lang", "score").agg(F.round(F.min_by("value", "knot"), 6).alias("fitted"))


def agg11_fpr_table(spark, sf):
    return _rounded(calibrate.fpr_table(_scored(spark, sf), ["lang"]))


def jn9_fpr_bands(spark, sf):
    s = _scored(spark, sf)
    return calibrate.with_fpr_band(s.select("item_id", "lang", "score"), calibrate.fpr_table(s, ["lang"]), ["lang"])


#: Real-valued scores, one group of all events.
REAL = "SELECT event_id, value AS score, CASE WHEN event_id % 5 = 0 OR value > 90 THEN 1 ELSE 0 END AS label FROM events WHERE value IS NOT NULL"


def agg4_real_roc(spark, sf):
    """The ROC of one group of unrounded scores."""
    r = metrics.roc(metrics.validated(sql(spark, sf, REAL)))
    return r.select("threshold", "tp", "fp", F.round("fpr", 9).alias("fpr"), F.round("fnr", 9).alias("fnr"))


def agg5_real_summary(spark, sf):
    """AUROC, EER and thresholds of one group of unrounded scores, from one curve."""
    points = metrics.curve(sql(spark, sf, REAL))
    out = metrics.auroc(points).crossJoin(metrics.interpolated_eer(points))  # one row each
    for name, target in (("thr_fpr1", 0.01), ("thr_fpr5", 0.05)):
        out = out.crossJoin(metrics.threshold_at_fpr(points, target).withColumnRenamed("threshold", name))
    return out.select("n", "pos", "neg", F.round("auroc", 9).alias("auroc"), F.round("eer", 9).alias("eer"), "thr_fpr1", "thr_fpr5")


def agg11_real_fpr(spark, sf):
    t = calibrate.fpr_table(sql(spark, sf, REAL))
    return t.select("threshold", F.round("fpr", 9).alias("fpr"))


def agg10_real_knots(spark, sf):
    """Knots of one group of unrounded scores."""
    return calibrate.isotonic_knots(sql(spark, sf, REAL), [])


def jn9_calibrated(spark, sf):
    """Every scored row by the knots of its language."""
    s = _scored(spark, sf).select("item_id", "lang", "score", "label")
    return calibrate.apply_knots(s.drop("label"), calibrate.isotonic_knots(s, ["lang"]), ["lang"])


def agg12_groups(spark, sf):
    s = _scored(spark, sf)
    flat = s.select("*", F.explode(F.array(*[F.struct(F.lit(g).alias("grouping_name"), (F.lit("all") if g == "all" else F.col(g)).alias("value")) for g in ("all", "source", "split", "transform", "lang")])).alias("g")).select("score", "label", "g.*")
    return _rounded(metrics.report(flat, ["grouping_name", "value"])).drop("reason")


def agg13_confusion(spark, sf):
    s = sql(spark, sf, "SELECT *, item_id % 11 <> 0 AS available FROM scored_base")
    return (
        s.where("available").groupBy("label", (F.col("score") >= 67).cast("int").alias("predicted")).agg(F.count("*").alias("n"))
    )


def agg21_benchmark(spark, sf):
    s = sql(spark, sf, CONFIGS)
    from pyspark.sql import Window

    m = metrics.at_threshold(s, 67, ["config"]).join(metrics.auroc(s, ["config"]).select("config", "auroc"), "config")
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    m = m.withColumn("f1", f1)
    place = F.row_number().over(Window.orderBy(F.desc("auroc"), F.desc("f1"), "fpr", "config"))  # a row for each configuration
    return _rounded(m.withColumn("place", place).select("config", "auroc", "f1", "fpr", "place"))


def agg22_members(spark, sf):
    return _rounded(metrics.member_table(sql(spark, sf, f"SELECT * FROM ({MEMBERS}) WHERE available")).select("member", "n", "pos", "neg", "auroc", "eer", "thr_fpr5", "fpr_at", "recall_at"))


def agg23_weights(spark, sf):
    m = metrics.member_table(sql(spark, sf, f"SELECT * FROM ({MEMBERS}) WHERE available"))
    return _rounded(m.select("member", metrics.suggested_weight(F.col("auroc"), F.col("fpr_at"), F.col("pos"), F.col("neg")).alias("weight")))


def agg24_components(spark, sf):
    return _rounded(feedback.per_component(sql(spark, sf, OBSERVED), ["metadata", "pixel", "external_model", "source"]))


def agg24_signals(spark, sf):
    from sievewright.operators import text

    scanned = text.scan(sql(spark, sf, "SELECT n.*, l.toxic AS label FROM notes_base n JOIN labels l ON n.doc_id = l.doc_id"))
    return _rounded(feedback.per_signal(scanned.select("label", "signals")))


def agg25_fusion_weights(spark, sf):
    c = feedback.per_component(sql(spark, sf, OBSERVED), ["metadata", "pixel", "external_model", "source"])
    return feedback.suggest_weights(c, {"metadata": 0.35, "pixel": 0.25, "external_model": 0.3, "source": 0.1})


def agg26_layers(spark, sf):
    return _rounded(calibrate.layer_thresholds(sql(spark, sf, LAYERS)))


def agg27_provisional(spark, sf):
    s = _scored(spark, sf)
    a = metrics.auroc(s, ["source"])
    return a.select("source", "n", metrics.provisional_reason(F.col("n"), F.col("auroc")).alias("why"))


def agg28_scope(spark, sf):
    scope = metrics.fit_scope(_scored(spark, sf))
    return scope.groupBy("fit_policy", "split").agg(F.count("*").alias("n"))


def fus3_fusion_threshold(spark, sf):
    o = sql(spark, sf, OBSERVED)
    fused = F.bround(o["metadata"] * 0.35 + o["pixel"] * 0.25 + o["external_model"] * 0.3 + o["source"] * 0.1, 6)
    s = o.select("label", clamp(F.bround(fused).cast("int"), 0, 100).alias("score"))
    return metrics.calibrated_threshold(s, 0.2).select("threshold", "target_fpr_met", "tp", "fp")


def set4_union_recall(spark, sf):
    m = sql(spark, sf, f"SELECT * FROM ({MEMBERS}) WHERE available")
    either = m.groupBy("item_id", "label").agg(F.bool_or(F.col("score") >= 50).alias("hit"))
    return either.groupBy("label").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"))


def jn4_feedback(spark, sf):
    """Entries by path, by a basename that one item has, and by one that none has."""
    items = sql(spark, sf, "SELECT path, score, status FROM items_base WHERE status = 'analyzed'")
    entries = sql(spark, sf, "SELECT CASE l.doc_id % 3 WHEN 0 THEN i.path WHEN 1 THEN 'elsewhere/f' || CAST(l.doc_id AS VARCHAR(20)) || '.png' ELSE 'gone/x' || CAST(l.doc_id AS VARCHAR(20)) END AS path, l.toxic AS label FROM labels l JOIN items_base i ON i.item_id = l.doc_id")
    matched, unmatched = feedback.match(entries, items)
    return matched.select("path", "label", F.col("item.path").alias("item_path"), F.col("item.score").alias("score")).unionByName(unmatched.select("path", "label", F.lit(None).cast("string").alias("item_path"), F.lit(None).cast("int").alias("score")))


QUERIES = {
    f.__name__: f
    for f in (
        agg2_binary, agg3_auroc, agg4_roc, agg5_eer, agg6_grid_eer, agg7_threshold, agg8_calibrated, agg9_reasons, agg10_isotonic, agg11_fpr_table, agg4_real_roc, agg5_real_summary, agg11_real_fpr, agg10_real_knots, jn9_calibrated, jn9_fpr_bands, agg12_groups, agg13_confusion,
        agg21_benchmark, agg22_members, agg23_weights, agg24_components, agg24_signals, agg25_fusion_weights, agg26_layers, agg27_provisional, agg28_scope, fus3_fusion_threshold, set4_union_recall, jn4_feedback,
    )
}

_EER = """pts AS (SELECT {by}, threshold, fp / q AS fpr, (p - tp) / p AS fnr FROM r WHERE p > 0 AND q > 0 UNION ALL SELECT DISTINCT {by}, 1e9, 0.0, 1.0 FROM r WHERE p > 0 AND q > 0),
lagged AS (SELECT *, lag(fpr) OVER w AS f0, lag(fnr) OVER w AS m0 FROM pts WINDOW w AS (PARTITION BY {by} ORDER BY threshold DESC)),
hit AS (SELECT * FROM lagged WHERE fpr >= fnr QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY threshold DESC) = 1),
eers AS (SELECT {by}, CASE WHEN fpr = fnr THEN fpr ELSE f0 - (f0 - m0) / (fpr - fnr - (f0 - m0)) * (fpr - f0) END AS eer FROM hit)"""
_GRID = """g AS (SELECT s.{by}, t AS threshold, count(*) FILTER (WHERE score >= t AND label = 1) AS tp, count(*) FILTER (WHERE score >= t AND label = 0) AS fp,
  count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS q FROM {rows} s CROSS JOIN range(0, 101) r(t) GROUP BY s.{by}, t),
best AS (SELECT {by}, arg_min((fp / greatest(1, q) + 1 - tp / greatest(1, p)) / 2, (abs(fp / greatest(1, q) - 1 + tp / greatest(1, p)), threshold)) AS eer, max(p) AS p, max(q) AS q FROM g GROUP BY {by})"""
_MEMBERS = f"rows0 AS ({MEMBERS}), kept AS (SELECT item_id, label, member, CAST(score AS DOUBLE) AS score FROM rows0 WHERE available), rows AS (SELECT * FROM kept UNION ALL SELECT item_id, max(label), '<ensemble-mean>', avg(score) FROM kept GROUP BY item_id)"
_MEMBER_TABLE = f"""WITH {_MEMBERS}, r AS ({_roc('rows', 'member')}), {_EER.format(by='member')}, a AS ({_auroc('rows', 'member')}),
c AS (SELECT member, count(*) AS n, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg, count(*) FILTER (WHERE label = 1 AND score >= 50) AS tp, count(*) FILTER (WHERE label = 0 AND score >= 50) AS fp FROM rows GROUP BY member),
t5 AS (SELECT member, min(threshold) FILTER (WHERE fp / q <= 0.05) AS t FROM r GROUP BY member), top AS (SELECT member, max(score) AS m FROM rows GROUP BY member)"""
_FUSED = f"o AS ({OBSERVED}), s AS (SELECT label, least(100, greatest(0, CAST(round_even(round_even(metadata * 0.35 + pixel * 0.25 + external_model * 0.3 + source * 0.1, 6), 0) AS INT))) AS score, 1 AS one FROM o)"
_ISOTONIC = """h AS (SELECT lang, CAST(score AS DOUBLE) AS score, sum(label) AS p, count(*) AS n FROM scored_base GROUP BY lang, score),
ok AS (SELECT lang FROM h GROUP BY lang HAVING sum(n) >= 20 AND sum(p) >= 5 AND sum(n) - sum(p) >= 5),
cum AS (SELECT h.*, sum(p) OVER w AS cp, sum(n) OVER w AS cn FROM h JOIN ok USING (lang) WINDOW w AS (PARTITION BY lang ORDER BY score)),
ends AS (SELECT a.lang, a.score AS x, b.score AS hi, c.score AS lo, (b.cp - c.cp + c.p) / (b.cn - c.cn + c.n) AS m
  FROM cum a JOIN cum b ON b.lang = a.lang AND b.score >= a.score JOIN cum c ON c.lang = a.lang AND c.score <= a.score),
fit AS (SELECT lang, x, max(v) AS v FROM (SELECT lang, x, lo, min(m) AS v FROM ends GROUP BY lang, x, lo) GROUP BY lang, x)"""

_REAL = f"""r AS ({REAL}), hh AS (SELECT score, sum(label) AS pos, count(*) - sum(label) AS neg FROM r GROUP BY score),
c AS (SELECT score, pos, neg, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS q FROM hh WINDOW w AS (ORDER BY score DESC))"""
SQL = {
    "agg2_binary": oracle(f"WITH c AS (SELECT lang, {_COUNTS.format(t=67)} FROM scored_base GROUP BY lang) SELECT *, {_RATES} FROM c"),
    "agg3_auroc": oracle(f"WITH a AS ({_auroc('scored_base', 'lang')}), c AS (SELECT lang, count(*) AS n, CAST(sum(label) AS BIGINT) AS pos, CAST(count(*) - sum(label) AS BIGINT) AS neg FROM scored_base GROUP BY lang) SELECT c.*, round(auroc, 6) AS auroc, CASE WHEN pos = 0 THEN 'no_positive_samples' WHEN neg = 0 THEN 'no_negative_samples' END AS reason FROM c LEFT JOIN a USING (lang)"),
    "agg4_roc": oracle(f"WITH r AS ({_roc('scored_base', 'split')}) SELECT split, round(threshold, 6) AS threshold, tp, fp, round(fp / q, 6) AS fpr, round((p - tp) / p, 6) AS fnr FROM r UNION ALL SELECT split, CAST(max(threshold) AS DOUBLE), 0, 0, CASE WHEN max(q) > 0 THEN 0.0 END, CASE WHEN max(p) > 0 THEN 1.0 END FROM r GROUP BY split"),
    "agg5_eer": oracle(f"WITH r AS ({_roc('scored_base', 'lang')}), {_EER.format(by='lang')} SELECT l.lang, round(eer, 6) AS eer FROM (SELECT DISTINCT lang FROM scored_base) l LEFT JOIN eers USING (lang)"),
    "agg6_grid_eer": oracle(f"WITH {_GRID.format(by='lang', rows='scored_base')} SELECT lang, CASE WHEN p > 0 AND q > 0 THEN round(eer, 6) END AS eer FROM best"),
    "agg7_threshold": oracle(f"WITH r AS ({_roc('scored_base', 'lang')}), top AS (SELECT lang, max(threshold) AS m FROM r GROUP BY lang) SELECT top.lang, CAST(v.target AS DOUBLE) AS target, round(coalesce(min(threshold) FILTER (WHERE fp / q <= target), CASE WHEN max(q) > 0 THEN any_value(m) END), 6) AS threshold FROM top JOIN r ON r.lang = top.lang CROSS JOIN (VALUES (0.01), (0.05), (0.2)) v(target) GROUP BY ALL"),
    "agg8_calibrated": oracle(f"WITH {_GRID.format(by='lang', rows='scored_base')}, x AS (SELECT lang, arg_max(threshold, (tp / greatest(1, p), -threshold)) FILTER (WHERE fp / greatest(1, q) <= 0.2) AS t FROM g GROUP BY lang) SELECT x.lang, coalesce(t, 100) AS threshold, CAST(t IS NOT NULL AS INT) AS target_fpr_met, tp, fp FROM x JOIN g ON g.lang = x.lang AND g.threshold = coalesce(t, 100)"),
    "agg9_reasons": oracle("SELECT source, lang, split, count(*) AS n, CASE WHEN sum(label) = 0 THEN 'no_positive_samples' WHEN sum(label) = count(*) THEN 'no_negative_samples' END AS reason FROM scored_base GROUP BY source, lang, split"),
    "agg10_isotonic": oracle(f"WITH {_ISOTONIC} SELECT lang, CAST(x AS INTEGER) AS score, round(v, 6) AS fitted FROM fit"),
    "agg11_fpr_table": oracle("SELECT t.lang, CAST(t.score AS DOUBLE) AS threshold, round(count(*) FILTER (WHERE r.label = 0 AND r.score >= t.score) / greatest(1, count(*) FILTER (WHERE r.label = 0)), 6) AS fpr FROM (SELECT DISTINCT lang, score FROM scored_base) t JOIN scored_base r ON r.lang = t.lang GROUP BY t.lang, t.score"),
    "jn9_fpr_bands": oracle("WITH f AS (SELECT t.lang, t.score, count(*) FILTER (WHERE r.label = 0 AND r.score >= t.score) / greatest(1, count(*) FILTER (WHERE r.label = 0)) AS fpr FROM (SELECT DISTINCT lang, score FROM scored_base) t JOIN scored_base r ON r.lang = t.lang GROUP BY t.lang, t.score) SELECT item_id, s.lang, s.score, CASE WHEN fpr <= 0.05 THEN 'low' WHEN fpr <= 0.2 THEN 'moderate' ELSE 'high' END AS fpr_band FROM scored_base s JOIN f ON f.lang = s.lang AND f.score = s.score"),
    "agg12_groups": oracle(f"""WITH rows AS (SELECT score, label, unnest([{{'grouping_name': 'all', 'value': 'all'}}, {{'grouping_name': 'source', 'value': source}}, {{'grouping_name': 'split', 'value': split}}, {{'grouping_name': 'transform', 'value': transform}}, {{'grouping_name': 'lang', 'value': lang}}], recursive := true) FROM scored_base),
        keyed AS (SELECT grouping_name || chr(1) || value AS k, * FROM rows), a AS ({_auroc('keyed', 'k')}), {_GRID.format(by='k', rows='keyed')}, c AS (SELECT k, any_value(grouping_name) AS grouping_name, any_value(value) AS value, {_COUNTS.format(t=67)} FROM keyed GROUP BY k)
        SELECT grouping_name, value, n, tp, fp, tn, fn, {_RATES}, round(auroc, 6) AS auroc, CASE WHEN p > 0 AND q > 0 THEN round(eer, 6) END AS eer FROM c LEFT JOIN a USING (k) JOIN best USING (k)"""),
    "agg13_confusion": oracle("SELECT label, CAST(score >= 67 AS INT) AS predicted, count(*) AS n FROM scored_base WHERE item_id % 11 <> 0 GROUP BY ALL"),
    "agg21_benchmark": oracle(f"WITH rows AS ({CONFIGS}), a AS ({_auroc('rows', 'config')}), c AS (SELECT config, {_COUNTS.format(t=67)} FROM rows GROUP BY config), m AS (SELECT config, auroc, CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1, fp / greatest(1, fp + tn) AS fpr FROM c JOIN a USING (config)) SELECT config, round(auroc, 6) AS auroc, round(f1, 6) AS f1, round(fpr, 6) AS fpr, row_number() OVER (ORDER BY auroc DESC, f1 DESC, fpr, config) AS place FROM m"),
    "agg22_members": oracle(f"{_MEMBER_TABLE} SELECT member, n, pos, neg, round(auroc, 6) AS auroc, round(eer, 6) AS eer, round(coalesce(t, m), 6) AS thr_fpr5, round(fp / greatest(1, neg), 6) AS fpr_at, round(tp / greatest(1, pos), 6) AS recall_at FROM c JOIN a USING (member) JOIN eers USING (member) JOIN t5 USING (member) JOIN top USING (member)"),
    "agg23_weights": oracle(f"{_MEMBER_TABLE} SELECT member, round(CASE WHEN pos >= 20 AND neg >= 20 THEN least(4.0, greatest(0.05, 4 * (auroc - 0.5) * greatest(0.05, 1 - fp / greatest(1, neg)))) END, 6) AS weight FROM c JOIN a USING (member)"),
    "agg24_components": oracle(f"WITH o AS ({OBSERVED}), rows AS (SELECT label, unnest([{{'component': 'metadata', 'score': metadata}}, {{'component': 'pixel', 'score': pixel}}, {{'component': 'external_model', 'score': external_model}}, {{'component': 'source', 'score': source}}], recursive := true) FROM o), a AS ({_auroc('rows', 'component')}) SELECT component, round(any_value(auroc), 6) AS auroc, round(avg(score) FILTER (WHERE label = 1), 6) AS mean_positive, round(avg(score) FILTER (WHERE label = 0), 6) AS mean_negative FROM rows JOIN a USING (component) GROUP BY component"),
    "agg25_fusion_weights": oracle(f"WITH o AS ({OBSERVED}), rows AS (SELECT label, unnest([{{'component': 'metadata', 'score': metadata}}, {{'component': 'pixel', 'score': pixel}}, {{'component': 'external_model', 'score': external_model}}, {{'component': 'source', 'score': source}}], recursive := true) FROM o), a AS ({_auroc('rows', 'component')}), b AS (SELECT component, greatest(0, auroc - 0.5) AS raw, CASE component WHEN 'metadata' THEN 0 WHEN 'pixel' THEN 1 WHEN 'external_model' THEN 2 ELSE 3 END AS i, CASE component WHEN 'metadata' THEN 0.35 WHEN 'pixel' THEN 0.25 WHEN 'external_model' THEN 0.3 ELSE 0.1 END AS base FROM a), u AS (SELECT component, i, CAST(round_even(10000 * CASE WHEN sum(raw) OVER () > 0 THEN raw / sum(raw) OVER () ELSE base / sum(base) OVER () END, 0) AS BIGINT) AS units FROM b) SELECT component, (units + CASE WHEN row_number() OVER (ORDER BY units DESC, i) = 1 THEN 10000 - sum(units) OVER () ELSE 0 END) / 10000 AS weight FROM u"),
    "agg26_layers": oracle(f"""WITH l AS ({LAYERS}), rows AS (SELECT metric, kind, CASE WHEN kind = 'ratio' THEN abs(ln(greatest(value, 1e-9))) ELSE value END AS score, label FROM l), r AS ({_roc('rows', 'metric')}), a AS ({_auroc('rows', 'metric')}), top AS (SELECT metric, any_value(kind) AS kind, max(score) AS m FROM rows GROUP BY metric),
        t AS (SELECT metric, min(threshold) FILTER (WHERE fp / q <= 0.01) AS t1, min(threshold) FILTER (WHERE fp / q <= 0.1) AS t10 FROM r GROUP BY metric)
        SELECT metric, kind, round(auroc, 6) AS auroc, round(CASE WHEN auroc >= 0.55 AND kind <> 'ratio' THEN coalesce(t1, m) END, 6) AS threshold, round(CASE WHEN auroc < 0.55 THEN NULL WHEN kind = 'ratio' THEN exp(-coalesce(t1, m)) WHEN kind = 'score' THEN coalesce(t10, m) END, 6) AS low,
        round(CASE WHEN auroc < 0.55 THEN NULL WHEN kind = 'ratio' THEN exp(coalesce(t1, m)) WHEN kind = 'score' THEN coalesce(t1, m) END, 6) AS high FROM top JOIN t USING (metric) JOIN a USING (metric)"""),
    "agg27_provisional": oracle(f"WITH a AS ({_auroc('scored_base', 'source')}), c AS (SELECT source, count(*) AS n FROM scored_base GROUP BY source) SELECT source, n, CASE WHEN n < 20 THEN 'samples' WHEN auroc < 0.55 THEN 'auroc' END AS why FROM c LEFT JOIN a USING (source)"),
    "agg28_scope": oracle("SELECT 'train' AS fit_policy, split, count(*) AS n FROM scored_base WHERE split = 'train' GROUP BY split"),
    "fus3_fusion_threshold": oracle(f"WITH {_FUSED}, {_GRID.format(by='one', rows='s')}, x AS (SELECT arg_max(threshold, (tp / greatest(1, p), -threshold)) FILTER (WHERE fp / greatest(1, q) <= 0.2) AS t FROM g) SELECT threshold, CAST(t IS NOT NULL AS INT) AS target_fpr_met, tp, fp FROM x JOIN g ON g.threshold = coalesce(t, 100)"),
    "set4_union_recall": oracle(f"WITH m AS ({MEMBERS}), e AS (SELECT item_id, label, bool_or(score >= 50) AS hit FROM m WHERE available GROUP BY ALL) SELECT label, count(*) AS n, count(*) FILTER (WHERE hit) AS hits FROM e GROUP BY label"),
    "jn4_feedback": oracle("""WITH i AS (SELECT path, score, string_split(path, '/')[-1] AS base FROM items_base WHERE status = 'analyzed'), one AS (SELECT base, any_value(path) AS path, any_value(score) AS score FROM i GROUP BY base HAVING count(*) = 1),
        e AS (SELECT CASE l.doc_id % 3 WHEN 0 THEN b.path WHEN 1 THEN 'elsewhere/f' || l.doc_id || '.png' ELSE 'gone/x' || l.doc_id END AS path, l.toxic AS label FROM labels l JOIN items_base b ON b.item_id = l.doc_id)
        SELECT e.path, label, coalesce(i.path, one.path) AS item_path, CASE WHEN i.path IS NOT NULL THEN i.score ELSE one.score END AS score FROM e LEFT JOIN i ON i.path = e.path LEFT JOIN one ON one.base = string_split(e.path, '/')[-1]"""),
    "agg4_real_roc": oracle(f"WITH {_REAL} SELECT score AS threshold, tp, fp, round(fp / q, 9) AS fpr, round((p - tp) / p, 9) AS fnr FROM c UNION ALL SELECT nextafter(max(score), 1e300), 0, 0, 0.0, 1.0 FROM c"),
    "agg5_real_summary": oracle(f"""WITH {_REAL}, e AS (SELECT *, fp / q AS fpr, (p - tp) / p AS fnr, (fp - neg) / q AS f0, (p - tp + pos) / p AS m0 FROM c),
        x AS (SELECT * FROM e WHERE fpr >= fnr ORDER BY score DESC LIMIT 1)
        SELECT (SELECT count(*) FROM r) AS n, (SELECT sum(label) FROM r)::BIGINT AS pos, (SELECT count(*) - sum(label) FROM r)::BIGINT AS neg, round((SELECT sum(pos * (q - fp + neg / 2)) / max(p * q) FROM c), 9) AS auroc,
        round((SELECT CASE WHEN fpr = fnr THEN fpr ELSE f0 - (f0 - m0) / (fpr - fnr - (f0 - m0)) * (fpr - f0) END FROM x), 9) AS eer,
        (SELECT coalesce(min(score) FILTER (WHERE fp / q <= 0.01), nextafter(max(score), 1e300)) FROM c) AS thr_fpr1, (SELECT coalesce(min(score) FILTER (WHERE fp / q <= 0.05), nextafter(max(score), 1e300)) FROM c) AS thr_fpr5"""),
    "agg11_real_fpr": oracle(f"WITH {_REAL} SELECT score AS threshold, round(fp / greatest(1, q), 9) AS fpr FROM c"),
    "jn9_calibrated": oracle(f"""WITH {_ISOTONIC},
        upto AS (SELECT f.lang, f.x, f.v, abs(sum(f.v * h.n) OVER w - sum(h.p) OVER w) < 1e-7 AS ends FROM fit f JOIN h ON h.lang = f.lang AND h.score = f.x WINDOW w AS (PARTITION BY f.lang ORDER BY f.x)),
        k AS (SELECT lang, x AS k1, v AS v1, lag(x) OVER w AS k0, lag(v) OVER w AS v0, lead(x) OVER w IS NULL AS last FROM upto WHERE ends WINDOW w AS (PARTITION BY lang ORDER BY x))
        SELECT s.item_id, s.lang, s.score, round_even(CASE WHEN k0 IS NULL OR s.score > k1 THEN v1 ELSE v0 + (s.score - k0) / (k1 - k0) * (v1 - v0) END, 4) AS calibrated
        FROM scored_base s LEFT JOIN k ON k.lang = s.lang AND (k0 IS NULL OR s.score > k0) AND (last OR s.score <= k1)"""),
    "agg10_real_knots": oracle(f"""WITH {_REAL}, pts AS (SELECT score, tp AS up, tp + fp AS un, p, p + q AS n, pos, neg FROM c),
        cum AS (SELECT score, p - up + pos AS y, n - un + pos + neg AS x FROM pts UNION ALL SELECT NULL, 0, 0),
        lefts AS (SELECT b.score, max((b.y - a.y) / (b.x - a.x)) AS m FROM cum b JOIN cum a ON a.x < b.x GROUP BY b.score),
        rights AS (SELECT a.score, min((b.y - a.y) / (b.x - a.x)) AS m FROM cum a JOIN cum b ON a.x < b.x GROUP BY a.score),
        hull AS (SELECT cum.* FROM cum LEFT JOIN lefts USING (score) LEFT JOIN rights USING (score) WHERE cum.score IS NULL OR rights.m IS NULL OR lefts.m <= rights.m)
        SELECT score AS knot, (y - lag(y) OVER w) / (x - lag(x) OVER w) AS value FROM hull WINDOW w AS (ORDER BY x) QUALIFY score IS NOT NULL"""),
    "agg24_signals": oracle(f"""WITH {SIGNALS}, f AS (SELECT l.toxic AS label, title, weight FROM signals s JOIN labels l ON l.doc_id = s.doc_id WHERE weight IS NOT NULL),
        g AS (SELECT title, count(*) AS items, coalesce(avg(weight) FILTER (WHERE label = 1), 0.0) AS p, coalesce(avg(weight) FILTER (WHERE label = 0), 0.0) AS q FROM f GROUP BY title)
        SELECT title, items, round(p, 6) AS mean_positive, round(q, 6) AS mean_negative, round(p - q, 6) AS separation FROM g"""),
}
