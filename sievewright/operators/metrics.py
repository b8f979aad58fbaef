"""Metrics of scores against labels, by any grouping, from one histogram.

All functions take scored rows (score, label 0/1, group columns) and begin with
a histogram by group and score, whose size is bounded by the distinct scores.
Counts above a score come from ranges of the histogram (:func:`curve`), so a
group is no task of its own, whatever its scores are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievewright.functions.columns import safe_divide
from sievewright.operators import ordered


def validated(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """The rows, or an error for labels other than 0 and 1 and for scores that are not finite."""
    bad_label = F.col(label).isNull() | ~F.col(label).isin(0, 1)
    s = F.col(score).cast("double")
    bad_score = s.isNull() | F.isnan(s) | (F.abs(s) == float("inf"))
    checked = F.when(bad_label, F.raise_error(F.lit("labels must be binary (0 or 1)"))).when(bad_score, F.raise_error(F.lit("scores must be finite"))).otherwise(F.lit(True))
    return scored.where(checked)


def histogram(scored: DataFrame, by: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """Rows (by, score, pos, neg)."""
    return scored.groupBy(*by, F.col(score).cast("double").alias("score")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.sum(1 - F.col(label).cast("long")).alias("neg"))


def curve(scored: DataFrame, by: list[str] = (), score: str = "score", label: str = "label", ranges: int | None = None) -> DataFrame:
    """Rows (by, score, pos, neg, tp, fp, all_pos, all_neg): of each distinct score its labels, those at or above it, and the group's.

    The histogram of the scores, however many they are, is cut into ranges whose
    totals are put together, so one group of real-valued scores is many tasks
    (see :mod:`ordered`).  The metrics below take it instead of scored rows
    where several are wanted.
    """
    d = ordered.running(histogram(scored, list(by), score, label), list(by), [F.desc("score")], {"tp": F.col("pos"), "fp": F.col("neg")}, ranges, totals=True)
    return d.withColumnsRenamed({"tp_all": "all_pos", "fp_all": "all_neg"})


def _curve(rows: DataFrame, by: list[str], score: str, label: str) -> DataFrame:
    """rows if they are a curve, else the curve of scored rows."""
    return rows if {"tp", "fp", "all_pos", "all_neg"} <= set(rows.columns) else curve(rows, by, score, label)


def roc(scored: DataFrame, by: list[str] = (), score: str = "score", label: str = "label") -> DataFrame:
    """Rows (by, threshold, tp, fp, fpr, fnr): one for each distinct score, ties together, and one beyond the highest.

    The first point's threshold is the next number above the highest score.
    """
    by = list(by)
    points = _curve(scored, by, score, label).select(*by, F.col("score").alias("threshold"), "tp", "fp", "all_pos", "all_neg")
    top = points.groupBy(*by).agg(F.max("threshold").alias("threshold"), F.first("all_pos").alias("all_pos"), F.first("all_neg").alias("all_neg")).where("threshold IS NOT NULL")
    above = top.select(*by, next_above(F.col("threshold")).alias("threshold"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"), "all_pos", "all_neg")
    return points.unionByName(above).withColumns({"fpr": _fpr("fp"), "fnr": _fnr("tp")})


def _fpr(fp: str) -> Column:
    return F.when(F.col("all_neg") > 0, F.col(fp) / F.greatest(F.col("all_neg"), F.lit(1)))


def _fnr(tp: str) -> Column:
    return F.when(F.col("all_pos") > 0, (F.col("all_pos") - F.col(tp)) / F.greatest(F.col("all_pos"), F.lit(1)))


def next_above(x: Column) -> Column:
    """The next double above a finite one."""
    size = F.greatest(F.abs(x), F.lit(2.2250738585072014e-308))
    step = F.pow(F.lit(2.0), F.floor(F.log2(size)) - 52)
    low = F.when((x < 0) & (F.abs(x) == F.pow(F.lit(2.0), F.floor(F.log2(size)))), step / 2).otherwise(step)
    return F.when(x == 0, F.lit(5e-324)).otherwise(x + low)


def reason(n: Column, pos: Column, neg: Column) -> Column:
    """Why metrics of both classes are undefined, or null."""
    return F.when(n == 0, "empty_input").when(pos == 0, "no_positive_samples").when(neg == 0, "no_negative_samples")


def auroc(scored: DataFrame, by: list[str] = (), score: str = "score", label: str = "label") -> DataFrame:
    """Rows (by, n, pos, neg, auroc, reason); ties count a half; null with a reason if a class is missing."""
    by = list(by)
    below = F.col("all_neg") - F.col("fp")
    wins = _curve(scored, by, score, label).withColumn("wins", F.col("pos") * (below + F.col("neg") / 2))
    out = wins.groupBy(*by).agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("pos"), F.coalesce(F.sum("neg"), F.lit(0)).alias("neg"), F.sum("wins").alias("wins"))
    both = (F.col("pos") > 0) & (F.col("neg") > 0)
    out = out.withColumn("n", F.col("pos") + F.col("neg"))
    return out.select(*by, "n", "pos", "neg", F.when(both, F.col("wins") / F.greatest(F.col("pos").cast("double") * F.col("neg"), F.lit(1))).alias("auroc"), reason(F.col("n"), F.col("pos"), F.col("neg")).alias("reason"))


def at_threshold(scored: DataFrame, threshold, by: list[str] = (), score: str = "score", label: str = "label") -> DataFrame:
    """tp, fp, tn, fn and rates where a score of at least the threshold predicts label 1; denominators are 1 at least."""
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    p, y = F.col(score) >= t, F.col(label) == 1
    out = scored.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & ~y).alias("tn"), F.count_if(~p & y).alias("fn")
    )
    return with_rates(out)


def with_rates(counts: DataFrame) -> DataFrame:
    c = F.col
    return counts.withColumns(
        {
            "precision": safe_divide(c("tp"), c("tp") + c("fp")),
            "recall": safe_divide(c("tp"), c("tp") + c("fn")),
            "accuracy": safe_divide(c("tp") + c("tn"), c("tp") + c("fp") + c("tn") + c("fn")),
            "fpr": safe_divide(c("fp"), c("fp") + c("tn")),
        }
    )


def interpolated_eer(scored: DataFrame, by: list[str] = (), score: str = "score", label: str = "label") -> DataFrame:
    """Rows (by, eer): where false positive and miss rate cross, between neighbouring ROC points; null if a class is missing.

    The point before a curve's point has its counts less its own labels, so no
    row looks at another.
    """
    by = list(by)
    c = _curve(scored, by, score, label).withColumns({"tp0": F.col("tp") - F.col("pos"), "fp0": F.col("fp") - F.col("neg")})
    c = c.withColumns({"fpr": _fpr("fp"), "fnr": _fnr("tp"), "fpr0": _fpr("fp0"), "fnr0": _fnr("tp0")})
    crossing = F.max_by(F.when(F.col("fpr") >= F.col("fnr"), F.struct("fpr", "fnr", "fpr0", "fnr0")), F.when(F.col("fpr") >= F.col("fnr"), F.col("score"))).alias("x")
    d0 = F.col("x.fpr0") - F.col("x.fnr0")
    step = F.col("x.fpr") - F.col("x.fnr") - d0
    value = F.when(F.col("x.fpr") == F.col("x.fnr"), F.col("x.fpr")).otherwise(F.col("x.fpr0") - d0 / step * (F.col("x.fpr") - F.col("x.fpr0")))
    return c.groupBy(*by).agg(crossing).select(*by, value.alias("eer"))


def grid(scored: DataFrame, by: list[str] = (), score: str = "score", label: str = "label") -> DataFrame:
    """Metrics at each whole threshold 0..100, from cumulative counts; not a pass over the rows for each."""
    by = list(by)
    cell = F.least(F.greatest(F.floor(F.col(score)), F.lit(-1)), F.lit(100)).cast("int")
    h = scored.groupBy(*by, cell.alias("t")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.sum(1 - F.col(label).cast("long")).alias("neg"))
    totals = h.groupBy(*by).agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    full = totals.select("*", F.explode(F.sequence(F.lit(-1), F.lit(100))).alias("t")).join(h, [*by, "t"], "left").fillna(0, ["pos", "neg"])
    up = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)
    counted = full.withColumns({"tp": F.sum("pos").over(up), "fp": F.sum("neg").over(up)}).where("t >= 0")
    return with_rates(counted.select(*by, F.col("t").alias("threshold"), "tp", "fp", (F.col("all_neg") - F.col("fp")).alias("tn"), (F.col("all_pos") - F.col("tp")).alias("fn")))


def grid_eer(scored: DataFrame, by: list[str] = (), score: str = "score", label: str = "label") -> DataFrame:
    """Rows (by, eer): the middle of both rates at the whole threshold where they are closest, the lowest of ties."""
    g = grid(scored, by, score, label).withColumn("fnr", 1 - F.col("recall"))
    best = g.groupBy(*by).agg(F.min_by((F.col("fpr") + F.col("fnr")) / 2, F.struct(F.abs(F.col("fpr") - F.col("fnr")), F.col("threshold"))).alias("eer"), F.max(F.col("tp") + F.col("fn")).alias("p"), F.max(F.col("fp") + F.col("tn")).alias("q"))
    return best.select(*by, F.when((F.col("p") > 0) & (F.col("q") > 0), F.col("eer")).alias("eer"))


def threshold_at_fpr(scored: DataFrame, target: float, by: list[str] = (), score: str = "score", label: str = "label") -> DataFrame:
    """Rows (by, threshold): the lowest ROC threshold whose false positive rate is within the target; null without negatives."""
    met = F.min(F.when(_fpr("fp") <= target, F.col("score")))
    above = F.when(F.max("all_neg") > 0, next_above(F.max("score")))
    return _curve(scored, list(by), score, label).groupBy(*by).agg(F.coalesce(met, above).alias("threshold"))


def calibrated_threshold(scored: DataFrame, target: float = 0.05, by: list[str] = (), score: str = "score", label: str = "label", default: int = 67) -> DataFrame:
    """The whole threshold of best recall within the target rate, the lowest of ties.

    If none is within it, threshold 100 with target_fpr_met 0.  Without rows the
    ungrouped form returns the default threshold and no samples.
    """
    by = list(by)
    g = grid(scored, by, score, label)
    picked = F.max_by(F.struct("threshold", "tp", "fp", "tn", "fn"), F.when(F.col("fpr") <= target, F.struct(F.col("recall"), -F.col("threshold"))))
    last = F.max_by(F.struct("threshold", "tp", "fp", "tn", "fn"), F.col("threshold"))
    best = g.groupBy(*by).agg(picked.alias("p"), last.alias("q"))
    met = F.col("p").isNotNull()
    out = best.select(*by, met.cast("int").alias("target_fpr_met"), F.coalesce("p", "q").alias("x"))
    out = with_rates(out.select(*by, "target_fpr_met", "x.*"))
    out = out.withColumn("samples", F.coalesce(F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn"), F.lit(0)))
    return out.withColumn("threshold", F.when(F.col("samples") == 0, default).otherwise(F.col("threshold")))


def report(scored: DataFrame, by: list[str], threshold: int = 67, score: str = "score", label: str = "label") -> DataFrame:
    """Counts, rates, AUROC, grid EER and reason for each group."""
    parts = at_threshold(scored, threshold, by, score, label).join(auroc(scored, by, score, label).select(*by, "auroc", "reason"), by).join(grid_eer(scored, by, score, label), by)
    return parts


def member_table(members: DataFrame, threshold: int = 50) -> DataFrame:
    """Member evaluation, with a row for the mean over each item's members.

    Input rows (item_id, member, score, label).  Output: n, AUROC, EER,
    thresholds at 1 and 5 % false positives, rates at the threshold.
    """
    mean = members.groupBy("item_id").agg(F.avg("score").alias("score"), F.max("label").alias("label")).withColumn("member", F.lit("<ensemble-mean>"))
    both = members.select("item_id", "member", F.col("score").cast("double").alias("score"), "label").unionByName(mean.select("item_id", "member", "score", "label"))
    by = ["member"]
    points = curve(both, by)
    out = auroc(points, by).join(interpolated_eer(points, by), by)
    for name, target in (("thr_fpr1", 0.01), ("thr_fpr5", 0.05)):
        out = out.join(threshold_at_fpr(points, target, by).withColumnRenamed("threshold", name), by)
    return out.join(at_threshold(both, threshold, by).select("member", F.col("fpr").alias("fpr_at"), F.col("recall").alias("recall_at")), by)


def suggested_weight(auroc_col: Column, fpr: Column, pos: Column, neg: Column, least: int = 20) -> Column:
    """clamp(4 (auroc - .5) max(.05, 1 - fpr), .05, 4); null under ``least`` rows of a class."""
    raw = 4 * (auroc_col - 0.5) * F.greatest(F.lit(0.05), 1 - fpr)
    return F.when((pos >= least) & (neg >= least), F.least(F.greatest(raw, F.lit(0.05)), F.lit(4.0)))


def provisional_reason(samples: Column, score_auroc: Column, least: int = 20, floor: float = 0.55) -> Column:
    """Why a threshold profile is not trusted yet, or null."""
    return F.when(samples < least, "samples").when(score_auroc < floor, "auroc")


def fit_scope(rows: DataFrame, split: str = "split") -> DataFrame:
    """The train rows if there are any, else all rows; column fit_policy says which."""
    has = rows.agg(F.coalesce(F.bool_or(F.col(split) == "train"), F.lit(False)).alias("has_train"))
    out = rows.join(F.broadcast(has), F.lit(True))  # one row
    return out.where((F.col(split) == "train") | ~F.col("has_train")).withColumn("fit_policy", F.when(F.col("has_train"), "train").otherwise("all")).drop("has_train")
