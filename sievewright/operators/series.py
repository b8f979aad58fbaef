"""Time-series signals over frames, tracks and envelopes, by windows within a stream."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievewright.functions.columns import cosine


def frame_features(frames: DataFrame, stream: str = "video_id", order: str = "frame_number") -> DataFrame:
    """One row for each stream: spreads, steps, cuts, flicker and whether the footage stands still."""
    w = Window.partitionBy(stream).orderBy(order)
    d = frames
    for c in ("brightness", "contrast", "blur", "edges"):
        d = d.withColumn(f"d_{c}", F.col(c) - F.lag(c).over(w))
    moving = F.when(F.col("d_blur") != 0, F.signum("d_blur"))
    before = F.last(moving, True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumns({"turn": moving, "turn0": before})
    avg = {c: F.avg(c) for c in ("brightness", "contrast", "blur", "edges")}
    out = d.groupBy(stream).agg(
        F.count("*").alias("n"),
        *[F.stddev_pop(c).alias(f"{c}_std") for c in avg],
        *[a.alias(f"{c}_mean") for c, a in avg.items()],
        *[F.coalesce(F.max(F.abs(f"d_{c}")), F.lit(0.0)).alias(f"{c}_step") for c in avg],
        *[F.greatest(F.max(c) - F.avg(c), F.avg(c) - F.min(c)).alias(f"{c}_spread") for c in ("brightness", "contrast")],
        F.count_if(F.abs("d_brightness") > 50).alias("brightness_cuts"),
        F.count("turn").alias("turns"),
        (F.count_if(F.col("turn") != F.col("turn0")) / F.greatest(F.count("turn") - 1, F.lit(1))).alias("oscillation"),
        (F.avg(F.abs("d_blur")) / F.when(F.avg("blur") != 0, F.avg("blur"))).alias("amplitude"),
        (F.avg(F.abs("d_brightness")) / F.when(F.avg("brightness") == 0, F.lit(1.0)).otherwise(F.avg("brightness"))).alias("jitter"),
    )
    c = F.col
    still = (c("n") >= 10) & (c("brightness_step") < 3) & (c("brightness_spread") < 3) & (c("contrast_step") < 3) & (c("contrast_spread") < 3) & (c("blur_step") < 25) & (c("edges_step") < 0.01)
    return out.withColumn("still", still)


def track_drift(track: DataFrame, stream: str, order: str, embedding: str, box: str | None = None, least: int = 8) -> DataFrame:
    """Cosine distance of neighbouring embeddings (mean, max, std) and relative box area change; null under ``least`` frames."""
    w = Window.partitionBy(stream).orderBy(order)
    d = track.withColumn("drift", 1 - cosine(F.lag(embedding).over(w), F.col(embedding)))
    area = (lambda b: F.get(b, 2) * F.get(b, 3)) if box else None
    if box:
        old = area(F.lag(box).over(w))
        d = d.withColumn("area", F.when(old > 0, F.abs(area(F.col(box)) - old) / old))
    else:
        d = d.withColumn("area", F.lit(None).cast("double"))
    out = d.groupBy(stream).agg(F.count("*").alias("n"), F.avg("drift").alias("drift_mean"), F.max("drift").alias("drift_max"), F.stddev_pop("drift").alias("drift_std"), F.avg("area").alias("area_delta"))
    ok = F.col("n") >= least
    return out.select(stream, "n", *[F.when(ok, F.col(c)).alias(c) for c in ("drift_mean", "drift_max", "drift_std", "area_delta")])


TRACK_CUTOFFS = {"drift_mean_high": 0.35, "drift_mean_mid": 0.2, "drift_max": 0.6, "area_delta": 0.3}


def track_score(cutoffs: dict[str, float] | None = None) -> Column:
    """Points of drift and area change; null where the track is unavailable."""
    t = TRACK_CUTOFFS | (cutoffs or {})
    c = F.col
    points = F.when(c("drift_mean") > t["drift_mean_high"], 35).when(c("drift_mean") > t["drift_mean_mid"], 15).otherwise(0)
    points = points + F.when(c("drift_max") > t["drift_max"], 15).otherwise(0) + F.when(c("area_delta") > t["area_delta"], 15).otherwise(0)
    return F.when(c("drift_mean").isNotNull(), F.least(points, F.lit(100)))


def resampled(series: DataFrame, stream: str, step: str, value: str, from_rate: float, to_rate: float) -> DataFrame:
    """Linear resampling of whole-numbered steps 0..n-1 to another rate; the same rows where rates agree."""
    if abs(from_rate - to_rate) < 1e-9:
        return series.select(stream, F.col(step).cast("long").alias(step), F.col(value).cast("double").alias(value))
    n = series.groupBy(stream).agg((F.max(step) + 1).alias("n"))
    target = F.greatest(F.lit(1), F.bround(F.col("n") / from_rate * to_rate)).cast("long")
    grid = n.withColumn("m", target).select(stream, "n", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("k"))
    place = F.when(F.col("m") > 1, F.col("k") * (F.col("n") - 1) / (F.col("m") - 1)).otherwise(F.lit(0.0))
    grid = grid.select(stream, "k", place.alias("x")).withColumns({"i": F.floor("x"), "f": F.col("x") - F.floor("x")})
    at = series.select(stream, F.col(step).cast("long").alias("i"), F.col(value).cast("double").alias("a"), F.lead(value).over(Window.partitionBy(stream).orderBy(step)).cast("double").alias("b"))
    return grid.join(at, [stream, "i"]).select(stream, F.col("k").alias(step), (F.col("a") + F.col("f") * (F.coalesce("b", "a") - F.col("a"))).alias(value))


def lag_correlation(pairs: DataFrame, stream: str, step: str, a: str, b: str, rate: float, max_lag_seconds: float, least: int = 16, least_seconds: float = 3.0, normalised: bool = True) -> DataFrame:
    """Rows (stream, n, offset_seconds, correlation): the lag of best correlation of two series on one grid.

    A positive lag means that ``a`` is late.  Each row meets the rows of 2·lags+1
    steps in a window of its stream, which is shuffled once; pairs are summed by lag where they are made and are never written.
    With ``normalised`` the overlap's own norms divide and only positive peaks
    count (offset 0, correlation 0 if there is none); else both series are z-scored over the whole and the product sum is
    divided by the overlap's length.  Short or constant streams have no row.
    """
    whole = Window.partitionBy(stream)
    m = int(max_lag_seconds * rate)
    d = pairs.withColumns({"n": F.count("*").over(whole), "x": F.col(a) - F.avg(a).over(whole), "y": F.col(b) - F.avg(b).over(whole), "sx": F.stddev_pop(a).over(whole), "sy": F.stddev_pop(b).over(whole)})
    d = d.where((F.col("n") >= least) & (F.col("n") / rate >= least_seconds) & (F.col("sx") > 1e-9) & (F.col("sy") > 1e-9))
    if not normalised:
        d = d.withColumns({"x": F.col("x") / F.col("sx"), "y": F.col("y") / F.col("sy")})
    near = Window.partitionBy(stream).orderBy("t").rangeBetween(-m, m)
    d = d.where(F.col(step).isNotNull()).select(stream, F.col(step).cast("long").alias("t"), "n", "x", "y")
    met = d.select(stream, "n", "x", F.col("t").alias("_t"), F.collect_list(F.struct("t", "y")).over(near).alias("near"))
    met = met.select(stream, "n", "x", "_t", F.inline("near")).withColumn("lag", (F.col("_t") - F.col("t")).cast("int"))
    by_lag = met.groupBy(stream, "lag").agg(F.count("*").alias("k"), F.max("n").alias("n"), F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("y") * F.col("y")).alias("yy"))
    size = F.sqrt(F.col("xx")) * F.sqrt(F.col("yy"))
    value = F.when(size > 1e-9, F.col("xy") / size) if normalised else F.col("xy") / F.col("k")
    by_lag = by_lag.withColumn("r", F.when(F.col("k") >= least, F.round(value, 12)))
    good = F.col("r") > 0 if normalised else F.col("r").isNotNull()
    best = by_lag.groupBy(stream).agg(F.max("n").alias("n"), F.max_by(F.struct("lag", "r"), F.when(good, F.struct(F.col("r"), -F.col("lag")))).alias("best"))
    return best.select(stream, "n", (F.coalesce(F.col("best.lag"), F.lit(0)) / rate).alias("offset_seconds"), F.coalesce(F.col("best.r"), F.lit(0.0)).alias("correlation"))


def sync_score(weak: float = 0.15, late: float = 0.3, weight: int = 18, weak_weight: int = 0) -> Column:
    """Weight of an offset; a weak correlation weighs ``weak_weight``."""
    return F.when(F.col("correlation") < weak, weak_weight).when(F.abs("offset_seconds") > late, weight).otherwise(0)


def pulse_spectrum(series: DataFrame, stream: str, step: str, value: str, rate: float, low: float = 0.7, high: float = 4.0, grid: float = 0.05) -> DataFrame:
    """Rows (stream, bpm, snr, ok, re, im): the strongest frequency of a band by a relational Fourier sum.

    Each sample meets each frequency of the band (a fixed number); snr is the
    peak's power by the mean of the band's other powers; of equal peaks the lowest.
    """
    w = Window.partitionBy(stream)
    freqs = [round(low + k * grid, 6) for k in range(int(round((high - low) / grid)) + 1)]
    d = series.withColumn("x", F.col(value) - F.avg(value).over(w))
    flat = d.select(stream, step, "x", F.explode(F.array(*map(F.lit, freqs))).alias("f"))
    angle = 2 * math.pi * F.col("f") * F.col(step) / rate
    s = flat.groupBy(stream, "f").agg(F.sum(F.col("x") * F.cos(angle)).alias("re"), F.sum(F.col("x") * F.sin(angle)).alias("im")).withColumn("power", F.col("re") * F.col("re") + F.col("im") * F.col("im"))
    best = s.groupBy(stream).agg(F.max_by(F.struct("f", "re", "im", "power"), F.struct(F.col("power"), -F.col("f"))).alias("p"), F.sum("power").alias("all"), F.count("*").alias("k"))
    snr = F.col("p.power") / F.greatest((F.col("all") - F.col("p.power")) / (F.col("k") - 1), F.lit(1e-12))
    out = best.select(stream, (F.col("p.f") * 60).alias("bpm"), snr.alias("snr"), F.col("p.re").alias("re"), F.col("p.im").alias("im"))
    return out.withColumn("ok", F.col("bpm").between(45, 200) & (F.col("snr") >= 8))


def phase_coherence(peaks: DataFrame, subject: str) -> DataFrame:
    """Length of the mean phase vector of a subject's regions; under .5 weighs 20."""
    phase = F.atan2(F.col("im"), F.col("re"))
    out = peaks.groupBy(subject).agg(F.count("*").alias("regions"), F.sqrt(F.pow(F.avg(F.cos(phase)), 2) + F.pow(F.avg(F.sin(phase)), 2)).alias("coherence"))
    return out.withColumn("weight", F.when((F.col("regions") > 1) & (F.col("coherence") < 0.5), 20).otherwise(0))


def relative_variation(series: DataFrame, stream: str, order: list[str], value: str) -> DataFrame:
    """Mean absolute step by mean absolute value; 0 under 3 points."""
    w = Window.partitionBy(stream).orderBy(*order)
    d = series.withColumn("d", F.abs(F.col(value) - F.lag(value).over(w)))
    r = F.avg("d") / F.when(F.avg(F.abs(value)) > 0, F.avg(F.abs(value)))
    return d.groupBy(stream).agg(F.when(F.count("*") >= 3, F.coalesce(r, F.lit(0.0))).otherwise(0.0).alias("variation"))


def pauses(series: DataFrame, stream: str, order: list[str], rms: str, share: float = 0.2) -> DataFrame:
    """Rows (stream, ratio, runs, cv): silence up to a share of the loudest, its runs' length variation."""
    w = Window.partitionBy(stream).orderBy(*order)
    quiet = F.col(rms) <= F.max(rms).over(Window.partitionBy(stream)) * share
    d = series.withColumn("quiet", quiet).withColumns({"i": F.row_number().over(w), "j": F.row_number().over(Window.partitionBy(stream, "quiet").orderBy(*order))})
    runs = d.where("quiet").groupBy(stream, (F.col("i") - F.col("j")).alias("g")).agg(F.count("*").alias("n"))
    sums = runs.groupBy(stream).agg(F.count("*").alias("runs"), F.sum("n").alias("quiet"), (F.stddev_pop("n") / F.avg("n")).alias("cv"))
    n = series.groupBy(stream).agg(F.count("*").alias("all"))
    return n.join(sums, stream, "left").select(stream, (F.coalesce("quiet", F.lit(0)) / F.col("all")).alias("ratio"), F.coalesce("runs", F.lit(0)).alias("runs"), F.coalesce("cv", F.lit(0.0)).alias("cv"))


def quiet_spread(series: DataFrame, stream: str, order: list[str], rms: str, flatness: str) -> DataFrame:
    """Deviation of flatness over the quietest max(8, n/10) frames."""
    w = Window.partitionBy(stream)
    d = series.withColumns({"n": F.count("*").over(w), "r": F.row_number().over(w.orderBy(rms, *order))})
    return d.where(F.col("r") <= F.greatest(F.lit(8), F.floor(F.col("n") / 10))).groupBy(stream).agg(F.stddev_pop(flatness).alias("spread"))
