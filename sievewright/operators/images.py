"""Image tables: histogram statistics, tiles, copied blocks, prototypes, sensor fingerprints, speakers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievewright.functions.columns import clamp, cosine


def histogram_statistics(h: DataFrame, id_col: str, bucket: str = "bucket", n: str = "n", fullest: int = 8) -> DataFrame:
    """Mean, deviation, entropy, skew, kurtosis and the share of the fullest buckets of each histogram."""
    w = Window.partitionBy(id_col)
    x = F.col(bucket).cast("double")
    d = h.withColumns({"all": F.sum(n).over(w), "mean": F.sum(x * F.col(n)).over(w) / F.sum(n).over(w), "place": F.row_number().over(w.orderBy(F.desc(n), bucket))})
    p, c = F.col(n) / F.col("all"), x - F.col("mean")
    m = lambda k: F.sum(p * F.pow(c, F.lit(k)))
    out = d.where(F.col(n) > 0).groupBy(id_col).agg(F.first("mean").alias("mean"), m(2).alias("m2"), m(3).alias("m3"), m(4).alias("m4"), (-F.sum(p * F.log2(p))).alias("entropy"), F.sum(F.when(F.col("place") <= fullest, p).otherwise(0.0)).alias("top_share"))
    sd = F.sqrt("m2")
    some = F.col("m2") > 1e-12
    return out.select(id_col, "mean", sd.alias("std"), "entropy", F.when(some, F.col("m3") / F.pow(sd, F.lit(3))).otherwise(0.0).alias("skew"), F.when(some, F.col("m4") / F.pow(F.col("m2"), F.lit(2))).otherwise(0.0).alias("kurtosis"), "top_share")


def tile_scores(tiles: DataFrame, id_col: str) -> DataFrame:
    """Adds score, normalised score and whether the tile is high; needs (edge_mean, edge_std)."""
    w = Window.partitionBy(id_col)
    d = tiles.withColumn("score", F.col("edge_mean") + 0.35 * F.col("edge_std"))
    low, high = F.min("score").over(w), F.max("score").over(w)
    return d.withColumns({"normal": F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(0.0), "is_high": F.col("score") > F.avg("score").over(w) + 1.4 * F.stddev_pop("score").over(w)})


def tile_anomaly(tiles: DataFrame, id_col: str) -> DataFrame:
    """Tiles, largest score by mean, share of high tiles, deviation, and the localisation score."""
    s = tile_scores(tiles, id_col).groupBy(id_col).agg(F.count("*").alias("tiles"), (F.max("score") / F.greatest(F.lit(1.0), F.avg("score"))).alias("anomaly_ratio"), (F.count_if("is_high") / F.count("*")).alias("high_ratio"), F.stddev_pop("score").alias("tile_std"))
    many = F.col("tiles") >= 12
    return s.withColumn("score", F.when(many & (F.col("anomaly_ratio") > 3.2) & (F.col("tile_std") > 7), 67).when(many & (F.col("anomaly_ratio") > 2.35) & (F.col("tile_std") > 5), 52).otherwise(0))


def copied_blocks(blocks: DataFrame, id_col: str = "image_id", flat: float = 6.0, step: float = 4.0, fullest: int = 32, far: float = 20.0, least_pairs: int = 6, near: float = 2.0) -> DataFrame:
    """Rows (id, dy, dx, pairs, coverage): offsets at which blocks of one image repeat.

    Blocks (y, x, mean, std, c01, c10, c11) meet by an equality join on quantised
    features; flat blocks and buckets over ``fullest`` blocks (flat or tiled
    areas) are left out, as the rule says, so pairs stay bounded by it.
    """
    q = lambda c: F.floor(F.col(c) / step).cast("long")
    keyed = blocks.where(F.col("std") >= flat).withColumn("key", F.concat_ws(",", *[q(c) for c in ("mean", "std", "c01", "c10", "c11")]))
    size = F.count("*").over(Window.partitionBy(id_col, "key"))
    keyed = keyed.withColumn("size", size).where(F.col("size") <= fullest)
    cols = ("y", "x", "mean", "std", "c01", "c10", "c11")
    a = keyed.select(id_col, "key", *[F.col(c).alias(f"{c}_a") for c in cols])
    b = keyed.select(id_col, "key", *[F.col(c).alias(f"{c}_b") for c in cols])
    dy, dx = F.col("y_b") - F.col("y_a"), F.col("x_b") - F.col("x_a")
    close = F.lit(True)
    for c in cols[2:]:
        close = close & (F.abs(F.col(f"{c}_a") - F.col(f"{c}_b")) <= near)
    pairs = a.join(b, [id_col, "key"]).where(((dy > 0) | ((dy == 0) & (dx > 0))) & (F.sqrt(dy * dy + dx * dx) >= far) & close)
    total = blocks.groupBy(id_col).agg(F.count("*").alias("blocks"))
    found = pairs.groupBy(id_col, dy.alias("dy"), dx.alias("dx")).agg(F.count("*").alias("pairs")).join(total, id_col)
    cover = 2 * F.col("pairs") / F.col("blocks")
    return found.withColumn("coverage", cover).where((F.col("pairs") >= least_pairs) & (cover < 0.6)).drop("blocks")


PROTOTYPES = {"synthetic_grid": (0.65, 0.82, 0.72, 0.80, 0.72), "synthetic_smooth": (0.34, 0.12, 0.18, 0.74, 0.10), "camera_like": (0.48, 0.38, 0.52, 0.38, 0.04)}


def prototype_score(features: list[Column]) -> tuple[Column, Column]:
    """(score, nearest): distance to camera-like against synthetic prototypes."""
    def distance(p):
        s = F.lit(0.0)
        for f, v in zip(features, p, strict=True):
            s = s + (f - v) * (f - v)
        return F.sqrt(s)

    d = {k: distance(p) for k, p in PROTOTYPES.items()}
    synthetic = F.least(d["synthetic_grid"], d["synthetic_smooth"])
    score = F.bround(clamp((d["camera_like"] - synthetic + 0.35) / 0.9, 0.0, 1.0) * 78).cast("int")
    nearest = F.when((d["synthetic_grid"] <= d["synthetic_smooth"]) & (d["synthetic_grid"] <= d["camera_like"]), "synthetic_grid").when(d["synthetic_smooth"] <= d["camera_like"], "synthetic_smooth").otherwise("camera_like")
    return score, nearest


def accumulated(*conditions: Column) -> Column:
    """min(74, 22 + 16 hits), 0 without a hit."""
    n = sum((c.cast("int") for c in conditions[1:]), conditions[0].cast("int"))
    return F.when(n > 0, F.least(F.lit(74), 22 + 16 * n)).otherwise(0)


def fingerprint(references: DataFrame, device: str, residual: str, least: int = 3) -> DataFrame:
    """Rows (device, pos, value): mean residual of each position over at least ``least`` references."""
    d = references.select(device, F.posexplode(residual).alias("pos", "v"))
    return d.groupBy(device, "pos").agg(F.avg("v").alias("value"), F.count("*").alias("n")).where(F.col("n") >= least).drop("n")


def sensor_match(targets: DataFrame, id_col: str, device: str, residual: str, prints: DataFrame, floor: float = 0.10, weight: int = 25) -> DataFrame:
    """Correlation of each target's residual with its device's fingerprint; under the floor it weighs."""
    d = targets.select(id_col, device, F.posexplode(residual).alias("pos", "v")).join(prints, [device, "pos"])
    out = d.groupBy(id_col, device).agg(F.corr("v", "value").alias("correlation"))
    return out.withColumn("weight", F.when(F.col("correlation") < floor, weight).otherwise(0))


def speaker_score(a: Column, b: Column) -> tuple[Column, Column]:
    """(score, band) of two embeddings: 160 times their cosine."""
    score = clamp(F.bround(F.round(cosine(a, b) * 160, 9)).cast("int"), 0, 100)
    return score, F.when(score >= 67, "same").when(score >= 35, "unclear").otherwise("different")


def speaker_scores(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """:func:`speaker_score` of each vector of a matrix with each of another, 0 where it has no cosine; both with their lengths, -1 for none."""
    (x, n), (y, m) = a, b
    with np.errstate(all="ignore"):
        size = np.sqrt((x * x).sum(axis=1))[:, None] * np.sqrt((y * y).sum(axis=1))[None]
        width = min(x.shape[1], y.shape[1])
        v = x[:, :width] @ y[:, :width].T / size * 160
        half = np.floor(v) + 0.5
        v = np.rint(np.where(np.abs(v - half) < 0.5e-9, half, v))
    good = (size > 0) & (n[:, None] == m[None]) & (n[:, None] >= 0) & np.isfinite(v)
    return np.where(good, np.clip(v, 0, 100), 0.0)


def z_classifier(rows: DataFrame, stats: DataFrame, features: list[str]) -> Column:
    """Sum of min(.25, .1 |z|) over features, 1 at most; stats is one row of mean_<f> and std_<f>."""
    s = F.lit(0.0)
    for f in features:
        z = F.abs((F.col(f) - F.col(f"mean_{f}")) / F.when(F.col(f"std_{f}") > 0, F.col(f"std_{f}")))
        s = s + F.coalesce(F.least(F.lit(0.25), 0.1 * z), F.lit(0.0))
    return F.least(F.lit(1.0), s)


def feature_statistics(rows: DataFrame, features: list[str]) -> DataFrame:
    return rows.agg(*[F.avg(f).alias(f"mean_{f}") for f in features], *[F.stddev_pop(f).alias(f"std_{f}") for f in features])
