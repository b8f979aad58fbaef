"""Fusion of component, member, expert and modality scores, and explanations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievewright.functions.columns import SIGNALS, band, clamp, total, weight_of

FUSION_TITLE = "융합 점수"
SOURCE_TITLE = "생성 도구 메타데이터"
DEFAULT_WEIGHTS = {"metadata": 0.35, "pixel": 0.25, "external_model": 0.3, "source": 0.1}


def metadata_score(signals: Column) -> Column:
    """Weight of the signals that no other component counts, 0-100."""
    own = weight_of(signals, lambda s: ~(s["title"].startswith("픽셀") | s["title"].startswith("외부 모델") | s["title"].isin(SOURCE_TITLE, FUSION_TITLE)))
    return clamp(own, 0, 100)


def source_score(confidence: Column) -> Column:
    return F.when(confidence == "high", 100).when(confidence == "medium", 65).when(confidence == "low", 35).otherwise(0)


def fused(components: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """Weighted mean, rounded half to even; every weight stays in the denominator."""
    w = {k: max(0.0, v) for k, v in (DEFAULT_WEIGHTS if weights is None else weights).items()}
    total = sum(w.values())
    if total <= 0:
        return F.lit(0)
    parts = F.lit(0.0)
    for name, weight in w.items():
        parts = parts + F.coalesce(components[name].cast("double"), F.lit(0.0)) * weight if name in components else parts
    return clamp(F.bround(F.round(parts / total, 9)).cast("int"), 0, 100)


def apply_fusion(items: DataFrame, threshold: int = 67, unknown_below: int = 8, weights: dict[str, float] | None = None) -> DataFrame:
    """Replaces score, band and the fusion signal of items (signals, pixel_score, model_score, source_confidence).

    Older fusion signals go first, so a second application changes nothing.
    """
    base = F.filter("signals", lambda s: s["title"] != FUSION_TITLE)
    d = items.withColumn("signals", base).withColumn("metadata", metadata_score(F.col("signals")))
    d = d.withColumns({"pixel": clamp(F.coalesce("pixel_score", F.lit(0)), 0, 100), "external_model": clamp(F.coalesce("model_score", F.lit(0)), 0, 100), "source_points": source_score(F.col("source_confidence"))})
    score = fused({"metadata": F.col("metadata"), "pixel": F.col("pixel"), "external_model": F.col("external_model"), "source": F.col("source_points")}, weights)
    d = d.withColumn("score", score)
    d = d.withColumn("band", band(F.col("score"), threshold, max(35, threshold // 2), (F.col("score") < unknown_below) & (F.coalesce("source_confidence", F.lit("unknown")) == "unknown")))
    row = F.struct(F.lit(FUSION_TITLE).alias("title"), F.lit("").alias("detail"), F.col("score").alias("weight"))
    return d.withColumn("signals", F.concat(F.array(row), "signals").cast(SIGNALS)).drop("metadata", "pixel", "external_model", "source_points")


def ensemble(members: DataFrame, profiles: DataFrame, id_col: str = "item_id") -> DataFrame:
    """Weighted mean of each item's members, with agreement.

    members (item, member, available, score, hangul, jpeg_quality); profiles
    (member, weight, degraded_weight, languages array, runtime), a bounded list.
    Weights are clamped to .05-4; members of other languages leave Hangul-heavy
    items; JPEG quality under 75 takes the degraded weight if that is lower.
    Spread and availability are over the members kept.
    """
    weight = clamp(F.coalesce("weight", F.lit(1.0)), 0.05, 4.0)
    default = F.when(F.col("runtime").isin("torchvision", "aide"), clamp(weight * 0.35, 0.05, 4.0))
    low = F.when(F.col("degraded_weight").isNotNull(), clamp(F.col("degraded_weight"), 0.05, 4.0)).otherwise(default)
    p = profiles.select("member", weight.alias("w"), low.alias("w_low"), "languages")
    d = members.where("available").join(p, "member", "left")
    foreign = (F.col("hangul") > 0.3) & (F.size("languages") > 0) & ~F.array_contains("languages", "ko")
    d = d.where(~F.coalesce(foreign, F.lit(False)))
    w = F.coalesce("w", F.lit(1.0))
    w = F.when((F.col("jpeg_quality") < 75) & (F.col("w_low") < w), F.col("w_low")).otherwise(w)
    kept = d.withColumn("w", w).groupBy(id_col).agg(F.count("*").alias("kept"), (F.sum(F.col("score") * F.col("w")) / F.sum("w")).alias("mean"), (F.max("score") - F.min("score")).alias("spread"))
    out = members.groupBy(id_col).agg(F.count("*").alias("members")).join(kept, id_col, "left").fillna(0, ["kept"])
    score = F.coalesce(F.bround(F.round("mean", 9)).cast("int"), F.lit(0))
    agree = F.when(F.col("kept") < 2, "n/a").when(F.col("spread") <= 20, "high").otherwise("low")
    level = F.when(F.col("kept") == 0, "unavailable").when(agree == "low", "low").when(score >= 80, "high").when(score >= 50, "medium").otherwise("low")
    return out.select(id_col, "members", "kept", score.alias("score"), F.when(F.col("kept") > 1, F.col("spread")).otherwise(0).alias("spread"), agree.alias("agreement"), level.alias("confidence"))


def output_score(values: Column, index: int = 1, activation: str = "softmax", bias: float = 0.0) -> Column:
    """0-100 from a model's outputs: softmax or sigmoid with exponents within ±80, then the bias off."""
    at = F.least(F.lit(index), F.size(values) - 1)
    x = F.get(values, at).cast("double")
    safe = lambda v: clamp(v.cast("double"), -80.0, 80.0)
    if activation == "softmax":
        top = F.array_max(values)
        total = F.aggregate(values, F.lit(0.0), lambda a, v: a + F.exp(safe(v - top)))
        share = F.exp(safe(x - top)) / F.greatest(total, F.lit(1e-12))
        share = F.when(F.size(values) > 1, share).otherwise(1 / (1 + F.exp(-safe(x))))
    elif activation == "sigmoid":
        share = 1 / (1 + F.exp(-safe(x)))
    else:
        share = x
    percent = F.bround(F.when(share.between(0, 1), share * 100).otherwise(share))
    return F.when(F.size(values) > 0, clamp(clamp(percent, 0, 100) - round(bias), 0, 100).cast("int")).otherwise(0)


def expert_fusion(experts: DataFrame, id_col: str = "item_id") -> DataFrame:
    """One score of an item's experts (family, score, weight, available) by how many are high, medium and of which families."""
    s, f = F.col("score"), F.col("family")
    c = experts.where("available").groupBy(id_col).agg(
        F.count_if(s >= 67).alias("high"),
        F.count_if((s >= 45) & (s < 67)).alias("medium"),
        F.count_if((f == "retrieval") & (s >= 45)).alias("retrieval"),
        F.count_if(f.isin("localization", "compositing") & (s >= 45)).alias("local"),
        F.count_if(f.isin("spectral", "statistical", "reconstruction") & (s >= 45)).alias("statistical"),
        (F.sum(s * F.col("weight")) / F.greatest(F.sum("weight"), F.lit(0.001))).alias("mean"),
    )
    return _voted(c).select(id_col, "high", "medium", "score")


def expert_fusion_wide(rows: DataFrame, experts: dict[str, tuple[str, float]], id_col: str = "item_id") -> DataFrame:
    """:func:`expert_fusion` of rows that hold each expert's score as a column, (family, weight) by name: no shuffle.

    A null score is an expert that was not available.
    """
    def count(condition, families=None) -> Column:
        chosen = [c for c, (family, _) in experts.items() if families is None or family in families]
        return total([F.coalesce(condition(F.col(c)), F.lit(False)).cast("long") for c in chosen]).cast("long")

    weight = total([F.when(F.col(c).isNotNull(), w).otherwise(0.0) for c, (_, w) in experts.items()])
    mean = total([F.coalesce(F.col(c), F.lit(0)) * w for c, (_, w) in experts.items()]) / F.greatest(weight, F.lit(0.001))
    c = rows.select(
        id_col,
        count(lambda s: s >= 67).alias("high"),
        count(lambda s: (s >= 45) & (s < 67)).alias("medium"),
        count(lambda s: s >= 45, ("retrieval",)).alias("retrieval"),
        count(lambda s: s >= 45, ("localization", "compositing")).alias("local"),
        count(lambda s: s >= 45, ("spectral", "statistical", "reconstruction")).alias("statistical"),
        mean.alias("mean"),
    )
    return _voted(c).select(id_col, "high", "medium", "score")


def _voted(c: DataFrame) -> DataFrame:
    """Adds the score by the counts of high and medium experts and the mean."""
    h, m, r, lo, st = (F.col(x) for x in ("high", "medium", "retrieval", "local", "statistical"))
    near = lambda plus, low, high: clamp(F.bround(F.round(F.col("mean") + plus, 9)).cast("int"), low, high)
    score = (
        F.when((h >= 2) | ((h > 0) & (r > 0) & (st > 0)), near(16, 72, 96))
        .when((h > 0) & ((m > 0) | (lo > 0)), near(10, 66, 88))
        .when(m >= 3, near(8, 54, 78))
        .when(m >= 1, near(3, 34, 62))
        .otherwise(near(0, 0, 32))
    )
    return c.withColumn("score", score)


def multimodal(scores: DataFrame, id_col: str = "subject_id") -> DataFrame:
    """One row for each subject of modality rows (modality, score, source, sync_weight).

    The mean score plus 20 for a spread over 40, else 15 for differing sources,
    plus sync weights; consistency 1 - deviation/50, .2 more for one source.
    """
    known = F.when(F.col("source") != "unknown", F.col("source"))
    d = scores.groupBy(id_col).agg(
        F.count("score").alias("modalities"), F.avg("score").alias("mean"), (F.max("score") - F.min("score")).alias("spread"), F.stddev_pop("score").alias("deviation"),
        F.count(known).alias("named"), F.countDistinct(known).alias("sources"), F.coalesce(F.sum("sync_weight"), F.lit(0)).alias("sync"),
    )
    cross = F.when(F.col("modalities") < 2, 0).when(F.col("spread") > 40, 20).when((F.col("named") >= 2) & (F.col("sources") > 1), 15).otherwise(0)
    score = F.coalesce(F.least(F.lit(100), F.bround(F.round(F.col("mean") + cross + F.col("sync"), 9)).cast("int")), F.lit(0))
    same = F.when((F.col("named") >= 2) & (F.col("sources") == 1), 0.2).otherwise(0.0)
    consistency = F.when(F.col("modalities") < 2, 0.5).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.col("deviation") / 50) + same))
    return d.select(id_col, "modalities", score.alias("score"), band(score).alias("band"), consistency.alias("consistency"))


def frame_mean(frames: DataFrame, id_col: str, how: str = "mean", spread: float = 40) -> DataFrame:
    """Mean (or max) over frames or crops, with a warning of wide spread."""
    value = F.max("score") if how == "max" else F.avg("score")
    return frames.groupBy(id_col).agg(F.count("*").alias("frames"), F.bround(F.round(value, 9)).cast("int").alias("score"), ((F.max("score") - F.min("score")) > spread).alias("wide"))


def capped_layers(layers: DataFrame, caps: dict[str, int], id_col: str = "item_id") -> DataFrame:
    """Sum of layer scores, each up to its cap; layers without a cap count whole."""
    cap = F.create_map(*[x for k, v in caps.items() for x in (F.lit(k), F.lit(v))])
    return layers.groupBy(id_col).agg(F.sum(F.least("score", F.coalesce(F.try_element_at(cap, F.col("layer")), F.col("score")))).alias("added"))


# Texts of explanations by band.
PATHS = {
    "high": ("높은 점수 임계값(67+) 도달", "여러 의심 신호가 동시에 활성화됨", "AI 생성 가능성 높음으로 판단"),
    "medium": ("중간 점수 임계값(35-66) 범위", "일부 의심 신호가 감지됨", "추가 확인 권장"),
    "low": ("낮은 점수 임계값(35 미만)", "뚜렷한 의심 신호 부족", "자연스러운 콘텐츠로 판단"),
}
SUMMARIES = {
    "high": ("이 콘텐츠는 ", "점으로 높은 AI 생성 의심 점수를 받았습니다. "),
    "medium": ("이 콘텐츠는 ", "점으로 중간 수준의 의심 신호를 보입니다. 추가 검토가 필요합니다."),
    "low": ("이 콘텐츠는 ", "점으로 낮은 의심 점수를 받았습니다. 자연스러운 콘텐츠로 보입니다."),
}
LIMITATIONS = ("이 설명은 휴리스틱 기반 분석 결과에 기반합니다.", "확정적 판별이 아닌 선별 도구로 활용해야 합니다.", "메타데이터가 없어 분석이 제한적일 수 있습니다.")


def explanation(items: DataFrame, n: int = 10, form: str = "general", has_metadata: Column | None = None) -> DataFrame:
    """Adds features, confidence, summary, decision_path and limitations to items (score, signals).

    features are the n heaviest signals with their importance, ties by title;
    confidence goes by score and number of signals.  The summary of a high score
    names the three heaviest.  Form ``face`` adds what ``face_count`` and
    ``manipulation_type`` say, ``video`` what ``frame_count`` and ``duration``
    do, where there are faces or frames; ``general`` and ``audio`` add nothing.
    """
    if form not in ("general", "audio", "face", "video"):
        raise ValueError(f"no form {form}")
    order = lambda a, b: F.when(a["weight"] > b["weight"], -1).when(a["weight"] < b["weight"], 1).when(a["title"] < b["title"], -1).when(a["title"] > b["title"], 1).otherwise(0)
    sorted_ = F.array_sort("signals", order)
    rows = F.transform(F.slice(sorted_, 1, n), lambda s: F.struct(s["title"].alias("feature"), (s["weight"] / 100.0).alias("importance")))
    high, medium = F.col("score") >= 67, F.col("score") >= 35
    level = F.when(high & (F.size("signals") >= 3), "high").when(medium & (F.size("signals") >= 1), "medium").otherwise("low")
    by_band = lambda of: F.when(high, of("high")).when(medium, of("medium")).otherwise(of("low"))
    top = F.array_join(F.transform(F.slice(sorted_, 1, 3), lambda s: s["title"]), ", ")
    named = F.when(high & (F.size("signals") > 0), F.concat(F.lit("주요 요인: "), top, F.lit("."))).otherwise("")
    said = F.concat(by_band(lambda b: F.concat(F.lit(SUMMARIES[b][0]), F.col("score").cast("string"), F.lit(SUMMARIES[b][1]))), named)
    path = by_band(lambda b: F.array(*map(F.lit, PATHS[b])))
    if form == "face":
        some = F.coalesce(F.col("face_count") > 0, F.lit(False))
        said = F.when(some, F.concat(said, F.lit(" "), F.col("face_count").cast("string"), F.lit("개의 얼굴이 감지되었습니다."))).otherwise(said)
        path = F.when(some, F.concat(path, F.array(F.concat(F.lit("얼굴 조작 유형: "), F.coalesce("manipulation_type", F.lit("unknown")))))).otherwise(path)
    elif form == "video":
        some = F.coalesce(F.col("frame_count") > 0, F.lit(False))
        said = F.when(some, F.concat(said, F.lit(" "), F.col("frame_count").cast("string"), F.lit("개 프레임 분석 (재생시간: "), F.format_string("%.1f", F.bround(F.coalesce(F.col("duration").cast("double"), F.lit(0.0)), 1)), F.lit("초)."))).otherwise(said)
    limits = F.array(*map(F.lit, LIMITATIONS[:2]))
    known = F.lit(False) if has_metadata is None else F.coalesce(has_metadata, F.lit(False))
    limits = F.when(known, limits).otherwise(F.concat(limits, F.array(F.lit(LIMITATIONS[2]))))
    return items.withColumns({"features": rows, "confidence": level, "summary": said, "decision_path": path, "limitations": limits})


def top_per_item(rows: DataFrame, id_col: str, least: int, n: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("score"), "name"))
    return rows.where(F.col("score") >= least).withColumn("place", place).where(F.col("place") <= n)
