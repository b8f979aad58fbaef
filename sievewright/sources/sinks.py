"""Sinks: scan documents, review tables, case exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievewright.operators.records import summary

# Columns of the review sheet, labels of the bands.
REVIEW_COLUMNS = (
    "path", "kind", "status", "score", "risk", "pixel_score", "pixel_confidence", "pixel_model", "pixel_fusion", "pixel_top_experts",
    "external_model", "external_model_score", "heatmap_path", "source", "source_confidence", "top_signal", "error",
)
BAND_LABELS = {"unknown": "판단 어려움", "low": "낮음", "medium": "주의", "high": "높음"}

#: What review rows are made of; columns that items lack count as null.
REVIEW_ITEM = """path string, kind string, status string, score int, band string, signals array<struct<title:string,detail:string,weight:int>>,
 pixel struct<available:boolean,score:int,confidence:string,model:string,fusion:string,heatmap_path:string,experts:array<struct<name:string,available:boolean,score:int>>>,
 model struct<available:boolean,model:string,score:int>, source_guess struct<label:string,confidence:string>, error string"""


def write_scan(items: DataFrame, folder: str, capped: bool = False, version: int = 1) -> None:
    """Items as parquet by kind, and a summary of one row, each stamped with the schema version."""
    items.withColumn("schema_version", F.lit(version)).write.mode("overwrite").partitionBy("kind").parquet(f"{folder}/items")
    summary(items).withColumns({"capped": F.lit(capped), "schema_version": F.lit(version)}).coalesce(1).write.mode("overwrite").json(f"{folder}/summary")


def top_signal(signals: F.Column) -> F.Column:
    """Title of the heaviest signal, the first of ties."""
    best = F.array_max(F.transform(signals, lambda s, i: F.struct(s["weight"].alias("w"), (-i).alias("i"), s["title"].alias("t"))))
    return best["t"]


def review_rows(items: DataFrame, least: int = 45, most: int = 5) -> DataFrame:
    """The 17 columns of the review sheet; items carry the columns of REVIEW_ITEM, or some of them.

    Only analysed items have a score, a risk, a source and a top signal; pixel
    and external columns are filled where those analyses were available.
    pixel_top_experts names the available experts of at least ``least``, highest
    first, ``most`` of them, ties in their order.
    """
    wanted = {f.name: f.dataType for f in T._parse_datatype_string(REVIEW_ITEM)}
    d = items.withColumns({name: F.col(name).cast(kind) if name in items.columns else F.lit(None).cast(kind) for name, kind in wanted.items()})
    done, pixel, outer = F.col("status") == "analyzed", F.coalesce("pixel.available", F.lit(False)), F.coalesce("model.available", F.lit(False))
    named = F.array_sort(
        F.transform(F.filter("pixel.experts", lambda e: e["available"] & (e["score"] >= least)), lambda e, i: F.struct(e["name"].alias("name"), e["score"].alias("score"), i.alias("i"))),
        lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).otherwise(a["i"] - b["i"]),
    )
    labels = F.create_map(*[F.lit(x) for pair in BAND_LABELS.items() for x in pair])
    columns = {
        "score": F.when(done, F.col("score")),
        "risk": F.when(done, labels[F.col("band")]),
        "pixel_score": F.when(pixel, F.col("pixel.score")),
        "pixel_confidence": F.when(pixel, F.col("pixel.confidence")),
        "pixel_model": F.when(pixel, F.col("pixel.model")),
        "pixel_fusion": F.when(pixel, F.col("pixel.fusion")),
        "pixel_top_experts": F.when(pixel, F.coalesce(F.array_join(F.transform(F.slice(named, 1, most), lambda e: e["name"]), ";"), F.lit(""))),
        "external_model": F.when(outer, F.col("model.model")),
        "external_model_score": F.when(outer, F.col("model.score")),
        "heatmap_path": F.col("pixel.heatmap_path"),
        "source": F.when(done, F.col("source_guess.label")),
        "source_confidence": F.when(done, F.col("source_guess.confidence")),
        "top_signal": F.when(done, F.get("signals", F.lit(0))["title"]),
    }
    return d.select(*[columns.get(c, F.col(c)).alias(c) for c in REVIEW_COLUMNS])


def write_review(items: DataFrame, folder: str, provenance: dict[str, str] | None = None) -> None:
    """The review sheet as CSV with a header, and beside it, in ``<folder>_provenance``, what its weights and thresholds come from.

    Without a profile the thresholds are the built-in defaults and provisional.
    """
    review_rows(items).write.mode("overwrite").option("escape", '"').option("emptyValue", "").csv(folder, header=True)
    facts = {"thresholds_source": "builtin_defaults", "provisional": "true"} | (provenance or {})
    items.sparkSession.createDataFrame(sorted(facts.items()), "key string, value string").coalesce(1).write.mode("overwrite").csv(f"{folder}_provenance", header=True)


def write_cases(cases: DataFrame, folder: str) -> None:
    cases.write.mode("overwrite").partitionBy("case_type").json(folder)
