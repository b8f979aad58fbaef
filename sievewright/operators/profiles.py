"""Rules as data: a table of profiles compiled to column expressions, with what was rejected and why."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievewright.functions.columns import band, clamp
from sievewright.operators import fusion, matching

VERSIONS = ("v1",)
KINDS = ("term", "cap", "fusion", "threshold")
THRESHOLDS = {"high": 67.0, "medium": 35.0, "unknown_below": 8.0}
#: Accepted rows of all profiles at most; they are rules, not data.
MAX_RULES = 200_000


class Profile(NamedTuple):
    """Points of each component's terms, the most that a component counts, fusion weights and thresholds."""

    name: str
    terms: dict[str, dict[str, float]]
    caps: dict[str, float]
    weights: dict[str, float]
    thresholds: dict[str, float]


def judged(table: DataFrame) -> DataFrame:
    """Adds why: null for an accepted row, else the first reason that it is rejected for.

    Rows (profile, version, kind, component, key, value): ``term`` rows give the
    points of each occurrence of the lower-case phrase ``key``, ``cap`` rows the
    most a component counts, ``fusion`` rows its weight, ``threshold`` rows the
    scores of ``high`` and ``medium`` and ``unknown_below``.
    """
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    kind, value = F.col("kind"), F.col("value")
    same = Window.partitionBy("profile", "kind", "component", "key")
    own = Window.partitionBy("profile")
    limit = lambda key: F.max(F.when((kind == "threshold") & (F.col("key") == key), value)).over(own)
    upside_down = F.coalesce(limit("medium"), F.lit(THRESHOLDS["medium"])) > F.coalesce(limit("high"), F.lit(THRESHOLDS["high"]))
    has_terms = F.max(F.when((kind == "term") & ~blank("key"), 1)).over(Window.partitionBy("profile", "component")).isNotNull()
    why = (
        F.when(blank("profile"), "no profile")
        .when(F.col("version").isNull() | ~F.col("version").isin(*VERSIONS), "version")
        .when(kind.isNull() | ~kind.isin(*KINDS), "kind")
        .when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), "no number")
        .when((kind != "threshold") & blank("component"), "no component")
        .when((kind == "term") & blank("key"), "no term")
        .when((kind != "term") & (value < 0), "negative")
        .when((kind == "threshold") & (F.col("key").isNull() | ~F.col("key").isin(*THRESHOLDS)), "threshold")
        .when(F.count("*").over(same) > 1, "repeated")
        .when((kind == "threshold") & F.col("key").isin("high", "medium") & upside_down, "order")
        .when(kind.isin("cap", "fusion") & ~has_terms, "no terms")
    )
    return table.withColumn("value", value.cast("double")).withColumn("why", why)


def rejected(table: DataFrame) -> DataFrame:
    """The rows that are no rules, each with the reason."""
    return judged(table).where("why IS NOT NULL")


def compiled(table: DataFrame) -> list[Profile]:
    """The profiles of a table, by name, from its accepted rows; terms and components without a weight count alike.

    The rows come to the driver: over MAX_RULES of them are an error.
    """
    rows = judged(table).where("why IS NULL").select("profile", "kind", "component", "key", "value").limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"over {MAX_RULES} rules")
    made: dict[str, Profile] = {}
    for r in sorted(rows, key=lambda r: (r.profile, r.kind, r.component or "", r.key or "")):
        p = made.setdefault(r.profile, Profile(r.profile, {}, {}, {}, dict(THRESHOLDS)))
        if r.kind == "term":
            p.terms.setdefault(r.component, {})[r.key.lower()] = r.value
        elif r.kind == "threshold":
            p.thresholds[r.key] = r.value
        else:
            (p.caps if r.kind == "cap" else p.weights)[r.component] = r.value
    return [made[name] for name in sorted(made)]


def score_columns(spark: SparkSession, profiles: list[Profile], text: Column) -> tuple[Column, list[dict[str, Column]]]:
    """(a column to be named ``_points``, of each profile its components' scores as expressions over it).

    One automaton has the terms of all profiles, so a text is read once whatever
    their number.
    """
    lists = {f"p{i}_{j}": terms for i, p in enumerate(profiles) for j, terms in enumerate(p.terms.values())}
    points = matching.weighed(spark, lists)(F.lower(F.coalesce(text, F.lit(""))))
    scores = [{c: clamp(F.col(f"_points.p{i}_{j}"), 0.0, p.caps.get(c, 100.0)) for j, c in enumerate(p.terms)} for i, p in enumerate(profiles)]
    return points, scores


def scan(docs: DataFrame, table: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, profile, components, score, band): every document under every profile of the table.

    A component's score is its terms' points, 0 to its cap; the score is their
    mean by fusion weight (1 where a profile gives none), rounded half to even;
    bands follow the profile's thresholds, unknown below ``unknown_below`` where
    no component has a point.  Profiles without terms have no rows.
    """
    profiles = [p for p in compiled(table) if p.terms]
    kind = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, profile string, components map<string,double>, score int, band string"
    if not profiles:
        return docs.sparkSession.createDataFrame([], kind)
    points, scores = score_columns(docs.sparkSession, profiles, F.col(text_col))
    rows = []
    for p, parts in zip(profiles, scores, strict=True):
        weights = p.weights if p.weights else dict.fromkeys(p.terms, 1.0)
        score = fusion.fused(parts, weights)
        none = F.lit(True)
        for part in parts.values():
            none = none & (part == 0)
        level = band(score, p.thresholds["high"], p.thresholds["medium"], (score < p.thresholds["unknown_below"]) & none)
        components = F.create_map(*[x for c, part in parts.items() for x in (F.lit(c), part)])
        rows.append(F.struct(F.lit(p.name).alias("profile"), components.alias("components"), score.alias("score"), level.alias("band")))
    return docs.select(id_col, points.alias("_points")).select(id_col, F.inline(F.array(*rows)))
