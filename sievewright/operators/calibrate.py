"""Isotonic calibration of scores, empirical false positive bands, layer thresholds."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievewright.operators import metrics, ordered
from sievewright.operators.ordered import RANGE
from sievewright.sources.scratch import written


def pooled(blocks: Iterable[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """Adjacent violators pooled: (positives, rows, highest score) of blocks in score order, compared in whole numbers."""
    out: list[tuple[int, int, float]] = []
    for p, n, top in blocks:
        while out and out[-1][0] * n > p * out[-1][1]:
            q, m, _ = out.pop()
            p, n = p + q, n + m
        out.append((p, n, top))
    return out


def isotonic_knots(scored: DataFrame, by: list[str], score: str = "score", label: str = "label", least: int = 20, least_class: int = 5, ranges: int | None = None) -> DataFrame:
    """Rows (by, knot, value): pooled adjacent violators over the histogram of each group.

    A knot is a block's highest score and its share of label 1; neighbours of
    equal share stay apart.  Groups under ``least`` rows or ``least_class`` of a
    class have none.

    Pooling can be done piece by piece: each range of scores is pooled by
    itself.  A block of no smaller share than any block of an earlier range and
    no larger one than any of a later range is final and parts what is before
    it from what is after; the blocks between two final ones are pooled
    together.  The knots do not depend on the cuts.  A task sees the scores of a
    range, or the blocks of neighbouring ranges whose shares overlap.
    """
    h = metrics.histogram(scored, by, score, label)
    enough = h.groupBy(*by).agg(F.sum("pos").alias("p"), F.sum("neg").alias("q")).where(f"p + q >= {least} AND p >= {least_class} AND q >= {least_class}").select(*by)
    kinds = dict(h.dtypes)
    groups = [f"{c} {kinds[c]}" for c in by]

    def pool(pdf: pd.DataFrame) -> pd.DataFrame:
        d = pdf.sort_values("top")
        out = pd.DataFrame(pooled(zip(d["pos"].tolist(), d["n"].tolist(), d["top"].tolist(), strict=True)), columns=["pos", "n", "top"])
        for c in [*by, *(c for c in (RANGE, "run") if c in pdf.columns)]:
            out[c] = pd.Series([pdf[c].iloc[0]] * len(out), dtype=pdf[c].dtype)
        return out

    counts = h.select(*by, "pos", (F.col("pos") + F.col("neg")).alias("n"), F.col("score").alias("top"))
    kept = ordered.same_keys(counts, enough, by) if by else counts.join(enough, F.lit(True), "left_semi")
    cut = ordered.ranged(kept, by, ["top"], ranges)
    blocks = written(cut.groupBy(*by, RANGE).applyInPandas(pool, ", ".join(["pos long", "n long", "top double", *groups, f"{RANGE} int"])), "blocks")
    share = F.col("pos") / F.col("n")
    ends = blocks.groupBy(*by, RANGE).agg(F.min(share).alias("least"), F.max(share).alias("most"))
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(RANGE)  # a row for each range
    ends = ends.select(*by, RANGE, F.max("most").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("m0"), F.min("least").over(w.rowsBetween(1, Window.unboundedFollowing)).alias("m1"))
    # Shares are compared with a margin for rounding; 0 and 1 are exact.
    final = (F.col("m0").isNull() | (share > F.col("m0") + 1e-9) | ((share == F.col("m0")) & share.isin(0.0, 1.0))) & (F.col("m1").isNull() | (share < F.col("m1") - 1e-9) | ((share == F.col("m1")) & share.isin(0.0, 1.0)))
    marked = ordered.same_keys(blocks, ends, [*by, RANGE]).withColumn("final", final.cast("long")).drop("m0", "m1")
    before = ordered.offsets(marked, by, {"final": F.col("final")})
    inside = marked.withColumn("i", F.sum("final").over(Window.partitionBy(*by, RANGE).orderBy("top")))
    run = ordered.same_keys(inside, before, [*by, RANGE]).withColumn("run", F.col("i") + F.col("final_before"))
    open_ = run.where("final = 0").select(*by, "run", "pos", "n", "top").groupBy(*by, "run").applyInPandas(pool, ", ".join(["pos long", "n long", "top double", *groups, "run long"]))
    done = run.where("final = 1").select(*by, "pos", "n", "top").unionByName(open_.drop("run"))
    return done.select(*by, F.col("top").alias("knot"), share.alias("value"))


def first_at_least(keys: Column, x: Column) -> Column:
    """The place from 0 of the first of sorted ``keys`` that is at least x, or their number: a binary search in the row."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(keys) + 1)).cast("int"))
    begin = F.struct(F.lit(0).alias("lo"), F.size(keys).alias("hi"))
    middle = lambda a: F.shiftright(a["lo"] + a["hi"], 1)
    right = lambda a: F.struct((middle(a) + 1).alias("lo"), a["hi"].alias("hi"))
    left = lambda a: F.struct(a["lo"].alias("lo"), middle(a).alias("hi"))
    return F.aggregate(steps, begin, lambda a, _: F.when(a["lo"] >= a["hi"], a).when(F.get(keys, middle(a)) < x, right(a)).otherwise(left(a)), lambda a: a["lo"])


def apply_knots(rows: DataFrame, knots: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """Adds calibrated: linear between knots, flat beyond the ends, null without knots or score; rounded to 4 places.

    A group's knots become one sorted array (blocks that are left of its scores,
    few beside them); a row meets its group's array once and searches it.
    """
    arrays = knots.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("knot", "value"))).alias("_k"))
    arrays = arrays.select(*by, F.col("_k.knot").alias("_knots"), F.col("_k.value").alias("_values")).withColumnsRenamed({c: f"_k_{c}" for c in by})
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    x = F.least(F.greatest(F.col(score).cast("double"), F.lit(0.0)), F.lit(100.0))
    out = rows.join(arrays, on, "left").withColumn("_i", first_at_least(F.col("_knots"), x))
    k = lambda i: F.get("_knots", i)
    v = lambda i: F.get("_values", i)
    i = F.col("_i")
    value = F.when(i == 0, v(i)).when(i >= F.size("_knots"), v(F.size("_knots") - 1)).otherwise(v(i - 1) + (x - k(i - 1)) / (k(i) - k(i - 1)) * (v(i) - v(i - 1)))
    known = F.col("_knots").isNotNull() & F.col(score).isNotNull()
    return out.withColumn("calibrated", F.when(known, F.bround(value, 4))).drop("_i", "_knots", "_values", *[f"_k_{c}" for c in by])


def fpr_table(scored: DataFrame, by: list[str] = (), score: str = "score", label: str = "label") -> DataFrame:
    """Rows (by, threshold, fpr): share of negatives at or above each distinct score."""
    by = list(by)
    return metrics._curve(scored, by, score, label).select(*by, F.col("score").alias("threshold"), (F.col("fp") / F.greatest(F.col("all_neg"), F.lit(1))).alias("fpr"))


def with_fpr_band(rows: DataFrame, table: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """Adds fpr_band by the first table score at or above each score: low to .05, moderate to .2, else high.

    Scores above the table, and of groups without one, are low.  Rates fall as
    scores rise, so a band ends at the highest table score of too high a rate:
    two numbers for a group, and no join by interval.
    """
    ends = table.groupBy(*by).agg(F.max(F.when(F.col("fpr") > 0.05, F.col("threshold"))).alias("_low"), F.max(F.when(F.col("fpr") > 0.2, F.col("threshold"))).alias("_moderate"))
    ends = ends.withColumnsRenamed({c: f"_k_{c}" for c in by})
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    x = F.col(score).cast("double")
    beyond = lambda c: F.coalesce(x > F.col(c), F.lit(True))
    band = F.when(beyond("_low"), "low").when(beyond("_moderate"), "moderate").otherwise("high")
    return rows.join(ends, on, "left").withColumn("fpr_band", band).drop("_low", "_moderate", *[f"_k_{c}" for c in by])


def layer_thresholds(long: DataFrame, min_auroc: float = 0.55) -> DataFrame:
    """Rows (metric, kind, auroc, threshold, low, high): cutoffs of unpivoted layer metrics.

    Input rows (metric, kind, value, label).  Kind ``ratio`` is judged by the
    distance from 1 on the log scale and gets a symmetric pair of cutoffs; kind
    ``score`` cutoffs at 1 and 10 % false positives; others one at 1 %.  All are
    null where the AUROC is under the floor.
    """
    signed = long.withColumn("score", F.when(F.col("kind") == "ratio", F.abs(F.ln(F.greatest(F.col("value"), F.lit(1e-9))))).otherwise(F.col("value")).cast("double"))
    by = ["metric", "kind"]
    points = metrics.curve(signed, by)
    a = metrics.auroc(points, by).select(*by, "auroc")
    t1 = metrics.threshold_at_fpr(points, 0.01, by).withColumnRenamed("threshold", "t1")
    t10 = metrics.threshold_at_fpr(points, 0.10, by).withColumnRenamed("threshold", "t10")
    d = a.join(t1, by).join(t10, by)
    good = F.col("auroc") >= min_auroc
    ratio, scored = F.col("kind") == "ratio", F.col("kind") == "score"
    return d.select(
        *by,
        "auroc",
        F.when(good & ~ratio, F.col("t1")).alias("threshold"),
        F.when(good & ratio, F.exp(-F.col("t1"))).when(good & scored, F.col("t10")).alias("low"),
        F.when(good & ratio, F.exp(F.col("t1"))).when(good & scored, F.col("t1")).alias("high"),
    )
