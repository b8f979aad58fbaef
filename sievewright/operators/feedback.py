"""Examiner feedback: joins to scan items, per-signal and per-component statistics, weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievewright.operators import metrics

POSITIVE = ("ai", "fake", "synthetic", "generated", "edited", "1")
NEGATIVE = ("human", "real", "camera", "authentic", "0")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def match(entries: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(matched, unmatched): entries (path, …) with the item's columns, by path, else by a basename that one item has.

    Items of one path must be one row.  Three hash joins, no loop over entries.
    """
    right = items.select(F.col("path").alias("item_path"), F.struct(*[c for c in items.columns]).alias("item"))
    exact = entries.join(right, entries["path"] == right["item_path"], "left")
    single = items.groupBy(basename(F.col("path")).alias("base")).agg(F.count("*").alias("n"), F.any_value(F.struct(*items.columns)).alias("by_name")).where("n = 1").drop("n")
    both = exact.join(single, basename(exact["path"]) == single["base"], "left").withColumn("item", F.coalesce("item", "by_name")).drop("item_path", "base", "by_name")
    return both.where("item IS NOT NULL"), both.where("item IS NULL").drop("item")


def per_signal(observations: DataFrame) -> DataFrame:
    """Rows (title, items, mean_positive, mean_negative, separation) of observations (label, signals)."""
    # The outer form: no filter on the array is inferred, which would repeat a long expression.
    flat = observations.select("label", F.explode_outer("signals").alias("s")).select("label", "s.title", "s.weight").where("title IS NOT NULL")
    out = flat.groupBy("title").agg(
        F.count("*").alias("items"),
        F.coalesce(F.avg(F.when(F.col("label") == 1, F.col("weight"))), F.lit(0.0)).alias("mean_positive"),
        F.coalesce(F.avg(F.when(F.col("label") == 0, F.col("weight"))), F.lit(0.0)).alias("mean_negative"),
    )
    return out.withColumn("separation", F.col("mean_positive") - F.col("mean_negative"))


def per_component(observations: DataFrame, components: list[str]) -> DataFrame:
    """Rows (component, auroc, mean_positive, mean_negative) of observations (label, component columns)."""
    long = observations.unpivot("label", components, "component", "score")
    means = long.groupBy("component").agg(F.avg(F.when(F.col("label") == 1, F.col("score"))).alias("mean_positive"), F.avg(F.when(F.col("label") == 0, F.col("score"))).alias("mean_negative"))
    return metrics.auroc(long, ["component"]).select("component", "auroc").join(means, "component")


def suggest_weights(components: DataFrame, base: dict[str, float]) -> DataFrame:
    """Rows (component, weight): shares of max(0, AUROC - .5) in units of 1e-4 that sum to 1.

    The rest of rounding goes to the largest share, the first in the base's
    order of ties; if nothing separates, the base weights are normalised.
    """
    order = F.create_map(*[x for i, k in enumerate(base) for x in (F.lit(k), F.lit(i))])
    weight = F.create_map(*[x for k, v in base.items() for x in (F.lit(k), F.lit(max(0.0, float(v))))])
    d = components.where(F.col("component").isin(*base)).select("component", order[F.col("component")].alias("i"), weight[F.col("component")].alias("b"), F.greatest(F.coalesce("auroc", F.lit(0.0)) - 0.5, F.lit(0.0)).alias("raw"))
    w = Window.partitionBy(F.lit(0))  # a row for each component
    share = F.when(F.sum("raw").over(w) > 0, F.col("raw") / F.sum("raw").over(w)).otherwise(F.col("b") / F.sum("b").over(w))
    d = d.withColumn("units", F.bround(share * 10000).cast("long"))
    rest = F.lit(10000) - F.sum("units").over(w)
    first = F.row_number().over(w.orderBy(F.desc("units"), "i")) == 1
    return d.withColumn("rest", rest).select("component", ((F.col("units") + F.when(first, F.col("rest")).otherwise(0)) / 10000).alias("weight"))
