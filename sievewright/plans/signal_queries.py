"""Queries of rule sets, series, fusion, provenance, images and evidence, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sievewright.functions import catalogue as C
from sievewright.operators import evidence as E
from sievewright.operators import fusion as FU
from sievewright.operators import images as I
from sievewright.operators import provenance as P
from sievewright.operators import rules as R
from sievewright.operators import series as S
from sievewright.plans.base import oracle, sql


def _features(**ranges) -> str:
    """Feature rows from line items: each feature a multiple of the row's numbers within a range."""
    cols = [f"CAST({low} AS DOUBLE) + CAST({round(high - low, 6)} AS DOUBLE) * (CAST((l_partkey * {7 + 4 * i} + l_suppkey * {3 + 2 * i} + l_linenumber * {11 + i}) % 997 AS DOUBLE) / 996) AS {name}" for i, (name, (low, high)) in enumerate(ranges.items())]
    return f"SELECT l_orderkey * 10 + l_linenumber AS item_id, {', '.join(cols)} FROM lineitem"


AUDIO = _features(pitch_mean=(0.0, 500.0), pitch_std=(0.0, 120.0), duration=(1.0, 20.0), bandwidth=(500.0, 4000.0), centroid=(500.0, 4000.0), flatness=(0.0, 1.0), rolloff=(1000.0, 8000.0), onset_rate=(0.0, 20.0), tempo=(0.0, 200.0), mfcc_std=(0.0, 20.0), rms=(0.0, 0.1), zero_crossings=(0.0, 0.2), jitter=(0.0, 0.03), shimmer=(0.0, 0.08), pause_ratio=(0.0, 0.3), pause_cv=(0.0, 1.0), noise_floor_std=(0.0, 0.3), harmonic_cv=(0.0, 0.8))
SCREEN = _features(freq_std=(0.0, 9000.0), edge_density=(0.0, 0.5), hist_entropy=(4.0, 8.0), texture_variance=(0.0, 2000.0), std=(5.0, 80.0), saturation_mean=(0.0, 200.0), saturation_std=(0.0, 100.0), texture_mean=(0.0, 40.0))
MOBILE = _features(edge_density=(0.0, 0.5), entropy=(0.0, 4.0), saturation_mean=(0.0, 1.0), saturation_std=(0.0, 0.4), grid_similarity=(0.5, 1.0), width=(200.0, 1200.0), height=(200.0, 1200.0))
SEAM = _features(seam_ratio=(0.0, 5.0), inner_var=(0.0, 200.0), noise_ratio=(0.0, 3.0), chroma_delta=(0.0, 20.0), corneal_asymmetry=(0.0, 8.0)).replace("SELECT ", "SELECT " + ", ".join(f"{v} AS {k}" for k, v in R.SEAM_CUTOFFS.items()) + ", ", 1)
FACE = _features(boundary_ratio=(0.0, 1.0), left_eye=(0.0, 255.0), right_eye=(0.0, 255.0), face_hue=(0.0, 179.0), scene_hue=(0.0, 179.0), scene_strength=(0.0, 0.1), face_angle=(0.0, 360.0), scene_angle=(0.0, 360.0), faces=(0.0, 6.0), min_size=(50.0, 100.0), max_size=(80.0, 120.0))
INPAINT = _features(mean_variance=(0.0, 60.0), std_variance=(0.0, 30.0), regions=(0.0, 20.0), noise_mean=(0.0, 20.0), noise_std=(0.0, 10.0), lines=(0.0, 60.0), top_bin=(0.0, 30.0), gradient_std=(0.0, 4.0), gradient_mean=(0.0, 15.0), flat_patches=(0.0, 12.0))
EXPERT = _features(unique_ratio=(0.0, 0.6), stdev=(0.0, 70.0), quantized=(0.0, 1.0), edge_mean=(0.0, 80.0), spike_count=(-2.0, 5.0), spike=(0.0, 12.0), npr=(0.0, 1.0), dct_high=(0.0, 0.1), dct_uniformity=(0.0, 0.05), djc=(0.0, 0.7), ela_ratio=(0.0, 4.0), copy_move=(0.0, 0.2), residual_mean=(0.0, 60.0), residual_std=(0.0, 40.0), did_gap=(0.0, 25.0), correlation=(0.0, 1.0), fractal=(0.9, 2.0), high_ratio=(0.0, 0.5), boundary_jump=(0.5, 2.5), tile_std=(0.0, 15.0), outlier_ratio=(0.0, 0.6), mad=(0.0, 2.0), period_ratio=(0.2, 1.0), shift_base=(0.0, 30.0), tiles=(4.0, 40.0), anomaly_ratio=(1.0, 4.0)).replace("SELECT ", "SELECT l_linenumber % 2 = 0 AS localized, ", 1)
CONTAINER = _features(fps=(0.0, 80.0), width=(0.0, 4000.0), height=(0.0, 2400.0))


def _rule_query(base: str, rules: R.Rules, high: int = 67, medium: int = 35):
    def query(spark, sf):
        return R.apply(sql(spark, sf, base), rules, high, medium).select("item_id", F.size("signals").alias("n_signals"), "score", "band")

    weights = [R.probe_weight(cases) for cases in rules.values()]
    n = " + ".join(f"CAST(({w}) > 0 AS INT)" for w in weights)
    return query, oracle(f"WITH b AS ({base}), s AS (SELECT item_id, {n} AS n_signals, least(100, {' + '.join(f'({w})' for w in weights)}) AS score FROM b) SELECT *, CASE WHEN score >= {high} THEN 'high' WHEN score >= {medium} THEN 'medium' ELSE 'low' END AS band FROM s")


def img2_experts(spark, sf):
    return R.long_scores(sql(spark, sf, EXPERT), R.EXPERTS, "item_id", R.FLOORS)


def _expert_score(name: str) -> str:
    s = R.probe_weight(R.EXPERTS[name])
    for condition, least in R.FLOORS.get(name, []):
        s = f"CASE WHEN {condition} THEN greatest({s}, {least}) ELSE {s} END"
    return s


def _expert_sql() -> str:
    out = [f"SELECT item_id, '{name}' AS name, '{R.FAMILIES[name]}' AS family, {_expert_score(name)} AS score FROM b" for name in R.EXPERTS]
    return f"b AS ({EXPERT}), e AS ({' UNION ALL '.join(out)})"


_USED = {name: _expert_score(name) for name in R.EXPERTS if name != "periodicity"}


def _votes(condition: str, names=tuple(_USED)) -> str:
    return "(" + " + ".join(f"CAST(s_{n} {condition} AS BIGINT)" for n in names) + ")"


def fus7_expert_fusion(spark, sf):
    families = R.FAMILIES | {"baseline": "retrieval"}
    used = [name for name in R.EXPERTS if name != "periodicity"]
    d = R.wide_scores(sql(spark, sf, EXPERT), R.EXPERTS, R.FLOORS)
    return FU.expert_fusion_wide(d, {f"score_{name}": (families[name], 0.2) for name in used})


def srt3_experts(spark, sf):
    e = R.long_scores(sql(spark, sf, EXPERT), R.EXPERTS, "item_id", R.FLOORS)
    return FU.top_per_item(e, "item_id", 45, 5).select("item_id", "name", "score", "place")


def _frame_features(spark, sf):
    return S.frame_features(sql(spark, sf, "SELECT * FROM frames_base"))


def win1_frames(spark, sf):
    d = _frame_features(spark, sf)
    names = ["brightness_std", "contrast_std", "blur_std", "blur_mean", "edges_std", "brightness_step", "blur_step", "oscillation", "amplitude", "jitter"]
    return d.select("video_id", "n", "brightness_cuts", "turns", "still", *[F.round(c, 6).alias(c) for c in names])


def win5_video_score(spark, sf):
    d = R.apply(_frame_features(spark, sf), R.FRAMES)
    return d.select("video_id", F.when(F.col("still"), 0).otherwise(F.col("score")).alias("score"))


def win7_track(spark, sf):
    d = S.track_drift(sql(spark, sf, "SELECT label, vec_id, embedding FROM embeddings"), "label", "vec_id", "embedding")
    return d.select("label", "n", *[F.round(c, 5).alias(c) for c in ("drift_mean", "drift_max", "drift_std")], S.track_score().alias("score"))


#: Two series of each user: the value, and the value two steps later with some of its own.
ENVELOPES = "SELECT video_id AS stream_id, frame_number AS t, brightness AS motion, coalesce(lag(brightness, 3) OVER (PARTITION BY video_id ORDER BY frame_number), 0) * 0.9 + contrast * 0.5 AS audio FROM frames_base"


def win8_av_sync(spark, sf):
    d = S.lag_correlation(sql(spark, sf, ENVELOPES), "stream_id", "t", "audio", "motion", 8.0, 1.0)
    return d.select("stream_id", "n", "offset_seconds", F.round("correlation", 6).alias("correlation"), S.sync_score().alias("weight"))


def win9_lipsync(spark, sf):
    d = S.lag_correlation(sql(spark, sf, ENVELOPES), "stream_id", "t", "audio", "motion", 4.0, 2.0, 20, 0.0, False)
    return d.select("stream_id", "n", "offset_seconds", F.round("correlation", 6).alias("correlation"), S.sync_score(0.12, 0.5, 25, 30).alias("weight"))


def win10_pulse(spark, sf):
    d = S.pulse_spectrum(sql(spark, sf, "SELECT video_id, frame_number, brightness FROM frames_base"), "video_id", "frame_number", "brightness", 30.0)
    return d.select("video_id", F.round("bpm", 3).alias("bpm"), F.round("snr", 4).alias("snr"), "ok")


def win11_phase(spark, sf):
    peaks = S.pulse_spectrum(sql(spark, sf, "SELECT video_id, frame_number, brightness FROM frames_base"), "video_id", "frame_number", "brightness", 30.0)
    d = S.phase_coherence(peaks.withColumn("subject", F.col("video_id") % 30), "subject")
    return d.select("subject", "regions", F.round("coherence", 5).alias("coherence"), "weight")


def win12_variation(spark, sf):
    return S.relative_variation(sql(spark, sf, "SELECT user_id, ts, event_id, value FROM events"), "user_id", ["ts", "event_id"], "value").select("user_id", F.round("variation", 6).alias("variation"))


def win13_pauses(spark, sf):
    d = S.pauses(sql(spark, sf, "SELECT user_id, ts, event_id, value FROM events"), "user_id", ["ts", "event_id"], "value")
    return d.select("user_id", F.round("ratio", 6).alias("ratio"), "runs", F.round("cv", 6).alias("cv"))


def win14_floor(spark, sf):
    d = S.quiet_spread(sql(spark, sf, "SELECT user_id, event_id, value, value * 0.013 % 1.0 AS flatness FROM events"), "user_id", ["event_id"], "value", "flatness")
    return d.select("user_id", F.round("spread", 6).alias("spread"))


def str1_rolling(spark, sf):
    w = Window.partitionBy("stream_id").orderBy("ts", "event_id")
    d = sql(spark, sf, "SELECT * FROM stream_base").withColumns({"mean": F.avg("score").over(w.rowsBetween(-29, 0)), "frame_count": F.row_number().over(w)})
    return d.select("stream_id", "event_id", F.round("mean", 6).alias("mean"), "frame_count", F.when(F.col("mean") >= 67, "high").when(F.col("mean") >= 35, "medium").otherwise("low").alias("band"))


def str2_alerts(spark, sf):
    from sievewright.streaming import live

    return live.alerts_batch(sql(spark, sf, "SELECT stream_id, event_id, ts, CAST(least(100, score * 2) AS INTEGER) AS score FROM stream_base"))


def str3_summary(spark, sf):
    from sievewright.streaming import live

    d = live.summary(sql(spark, sf, "SELECT * FROM stream_base"))
    return d.select("stream_id", "frame_count", F.round("average_score", 6).alias("average_score"), "max_score", "min_score")


FUSED_ITEMS = """SELECT item_id, score AS pixel_score, CASE WHEN item_id % 3 = 0 THEN 90 WHEN item_id % 3 = 1 THEN 30 END AS model_score, CASE item_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE 'unknown' END AS source_confidence, CAST(item_id % 40 AS INTEGER) AS own, CAST(item_id % 17 AS INTEGER) AS dots FROM items_base"""


def fus1_components(spark, sf):
    d = _fused_items(spark, sf)
    return d.select("item_id", FU.metadata_score(F.col("signals")).alias("metadata"), FU.source_score(F.col("source_confidence")).alias("source"))


def _fused_items(spark, sf):
    d = sql(spark, sf, FUSED_ITEMS)
    row = lambda t, w: F.struct(F.lit(t).alias("title"), F.lit("").alias("detail"), w.alias("weight"))
    return d.withColumn("signals", F.array(row("반복 어구", F.col("own")), row("픽셀 앙상블 의심", F.col("dots")), row("외부 모델 의심", F.lit(24)), row("생성 도구 메타데이터", F.lit(67)), row("융합 점수", F.lit(50))))


def fus2_fused(spark, sf):
    once = FU.apply_fusion(_fused_items(spark, sf))
    twice = FU.apply_fusion(once)
    return twice.select("item_id", "score", "band", F.size("signals").alias("n_signals"))


ENSEMBLE = "SELECT item_id, 'm' || CAST(k AS VARCHAR(2)) AS member, (item_id + k) % 9 <> 0 AS available, CAST((score * (k + 3) + item_id * k) % 101 AS INTEGER) AS score, CASE WHEN item_id % 5 = 0 THEN 0.6 ELSE 0.0 END AS hangul, CASE WHEN item_id % 7 = 0 THEN 50.0 WHEN item_id % 7 = 1 THEN 90.0 END AS jpeg_quality FROM items_base CROSS JOIN (VALUES (1), (2), (3), (4)) AS ks(k)"


def fus4_ensemble(spark, sf):
    profiles = spark.createDataFrame([("m1", 1.0, None, ["en"], "hf"), ("m2", 9.0, 0.3, [], "onnx"), ("m3", 0.01, None, ["en", "ko"], "hf"), ("m4", 2.0, None, [], "aide")], "member string, weight double, degraded_weight double, languages array<string>, runtime string")
    return FU.ensemble(sql(spark, sf, ENSEMBLE), profiles)


OUTPUTS = "SELECT item_id, score / 10.0 - 5 AS a, (item_id % 100) / 20.0 - 2 AS b, score / 100.0 AS c FROM items_base"


def fus5_outputs(spark, sf):
    d = sql(spark, sf, OUTPUTS)
    v = F.array(F.col("a").cast("double"), F.col("b").cast("double"))
    return d.select("item_id", FU.output_score(v).alias("softmax"), FU.output_score(F.array(F.col("a").cast("double")), 0, "sigmoid", 5).alias("sigmoid"), FU.output_score(F.array(F.col("c").cast("double")), 0, "none").alias("plain"))


def fus6_frames(spark, sf):
    d = sql(spark, sf, "SELECT * FROM stream_base")
    m = FU.frame_mean(d, "stream_id").select("stream_id", "frames", F.col("score").alias("mean_score"), "wide")
    return m.join(FU.frame_mean(d, "stream_id", "max").select("stream_id", F.col("score").alias("max_score")), "stream_id")


MODAL = "SELECT conv_id AS subject_id, role || CAST(turn AS VARCHAR(9)) AS modality, CAST(length(text) % 101 AS INTEGER) AS score, CASE WHEN turn % 3 = 0 THEN 'unknown' ELSE 's' || CAST((conv_id + CASE WHEN conv_id % 2 = 0 THEN turn ELSE 0 END) % 3 AS VARCHAR(9)) END AS source, CASE WHEN conv_id % 11 = 0 AND turn = 0 THEN 18 ELSE 0 END AS sync_weight FROM conversations"


def fus8_multimodal(spark, sf):
    d = FU.multimodal(sql(spark, sf, MODAL))
    return d.select("subject_id", "modalities", "score", "band", F.round("consistency", 6).alias("consistency"))


def fus9_explanation(spark, sf):
    d = FU.explanation(R.apply(sql(spark, sf, AUDIO), R.AUDIO), 3)
    return d.select("item_id", F.array_join(F.col("features.feature"), ",").alias("features"), "confidence")


def fus9_forms(spark, sf):
    """Explanations of each form: audio, face and video."""
    d = R.apply(sql(spark, sf, AUDIO), R.AUDIO).withColumns({"face_count": (F.col("item_id") % 4).cast("int"), "manipulation_type": F.when(F.col("item_id") % 3 == 0, "swap"), "frame_count": (F.col("item_id") % 5 * 30).cast("int")})
    out = None
    for form in ("audio", "face", "video"):
        one = FU.explanation(d, 3, form, F.col("item_id") % 2 == 0).select("item_id", F.lit(form).alias("form"), "summary", F.array_join("decision_path", "|").alias("path"), F.size("limitations").alias("limits"))
        out = one if out is None else out.unionByName(one)
    return out


def med2_audio_source(spark, sf):
    d = sql(spark, sf, AUDIO)
    guess = F.when(F.col("flatness") > 0.7, "noise").when((F.col("pitch_std") < 3) & (F.col("duration") > 5), "speech synthesis").when(F.col("bandwidth") < 800, "compressed").otherwise("unknown")
    return d.select("item_id", guess.alias("guess"))


def med3_speakers(spark, sf):
    """Each vector whose id is divisible by 20 against all others of its label: how many, how many of the same speaker, and the nearest."""
    from sievewright.operators.records import vector_search

    v = sql(spark, sf, "SELECT vec_id, label, embedding FROM embeddings")
    d = vector_search(v, v.where("vec_id % 20 = 0"), "vec_id", "embedding", ["label"], I.speaker_scores, lambda s: s >= 67)
    return d.select("vec_id", "compared", "matched", "best_id", F.col("best_score").cast("int").alias("score"))


def med5_classifier(spark, sf):
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    d = sql(spark, sf, "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS l_quantity, CAST(l_extendedprice AS DOUBLE) AS l_extendedprice, CAST(l_discount AS DOUBLE) AS l_discount, CAST(l_tax AS DOUBLE) AS l_tax FROM lineitem")
    stats = I.feature_statistics(d, names)
    out = d.join(F.broadcast(stats), F.lit(True))
    return out.select("l_orderkey", "l_linenumber", F.round(I.z_classifier(out, stats, names), 5).alias("score"))


def med6_spectral(spark, sf):
    d = sql(spark, sf, AUDIO)
    flat, steady = F.col("flatness") > 0.7, (1 - F.col("pitch_std") / 120) > 0.9
    return d.select("item_id", F.when(flat, "Synthetic Audio").when(steady, "TTS Engine").alias("tool"), F.when(flat, 0.6).when(steady, 0.5).alias("confidence"))


def med10_layers(spark, sf):
    d = sql(spark, sf, "SELECT l_orderkey AS item_id, CASE l_linenumber % 4 WHEN 0 THEN 'pulse' WHEN 1 THEN 'avatar' WHEN 2 THEN 'lips' ELSE 'track' END AS layer, CAST(l_quantity AS INTEGER) AS score FROM lineitem")
    return FU.capped_layers(d, {"pulse": 20, "avatar": 25, "lips": 30, "track": 35})


def med11_sensor(spark, sf):
    refs = sql(spark, sf, "SELECT vec_id, label, embedding FROM embeddings WHERE vec_id % 5 > 0")
    targets = sql(spark, sf, "SELECT vec_id, label, embedding FROM embeddings WHERE vec_id % 5 = 0")
    d = I.sensor_match(targets, "vec_id", "label", "embedding", I.fingerprint(refs, "label", "embedding"))
    return d.select("vec_id", "label", F.round("correlation", 5).alias("correlation"))


HIST = "SELECT l_suppkey AS image_id, l_quantity AS bucket, count(*) AS n FROM lineitem GROUP BY l_suppkey, l_quantity"
TILES = "SELECT l_suppkey AS image_id, l_orderkey AS ty, l_linenumber AS tx, CAST(l_quantity AS DOUBLE) + CASE WHEN l_suppkey % 3 = 0 AND l_orderkey % 50 = 0 THEN 150 ELSE 0 END AS edge_mean, CAST(l_tax AS DOUBLE) * 100 AS edge_std FROM lineitem"


def img1_histograms(spark, sf):
    d = I.histogram_statistics(sql(spark, sf, HIST), "image_id")
    return d.select("image_id", *[F.round(c, 5).alias(c) for c in d.columns if c != "image_id"])


def img3_tiles(spark, sf):
    d = I.tile_anomaly(sql(spark, sf, TILES), "image_id")
    return d.select("image_id", "tiles", *[F.round(c, 5).alias(c) for c in ("anomaly_ratio", "high_ratio", "tile_std")], "score")


BLOCKS = "SELECT l_suppkey AS image_id, l_orderkey % 64 * 8 AS y, l_linenumber * 8 AS x, CAST(l_quantity AS DOUBLE) AS mean, 8.0 + l_linenumber AS std, CAST(l_discount AS DOUBLE) * 100 AS c01, CAST(l_tax AS DOUBLE) * 100 AS c10, 1.0 AS c11 FROM lineitem"


def img4_copy_move(spark, sf):
    return I.copied_blocks(sql(spark, sf, BLOCKS), least_pairs=2).select("image_id", "dy", "dx", "pairs", F.round("coverage", 6).alias("coverage"))


PROTO = _features(f1=(0.0, 1.0), f2=(0.0, 1.0), f3=(0.0, 1.0), f4=(0.0, 1.0), f5=(0.0, 1.0))


def img5_prototypes(spark, sf):
    d = sql(spark, sf, PROTO)
    score, nearest = I.prototype_score([F.col(f"f{i}").cast("double") for i in range(1, 6)])
    return d.select("item_id", score.alias("score"), nearest.alias("nearest"))


def img6_accumulated(spark, sf):
    d = sql(spark, sf, PROTO)
    return d.select("item_id", I.accumulated(F.col("f1") > 0.5, F.col("f2") > 0.68, F.col("f3") > 0.8).alias("score"))


def img7_variants(spark, sf):
    """Accuracy of each transform against the clean variant."""
    s = sql(spark, sf, "SELECT * FROM scored_base")
    ok = ((F.col("score") >= 50).cast("int") == F.col("label")).cast("int")
    m = s.groupBy("transform").agg(F.count("*").alias("n"), F.avg(ok).alias("accuracy"))
    clean = m.where("transform = 'clean'").select(F.col("accuracy").alias("clean"))
    return m.join(F.broadcast(clean), F.lit(True)).select("transform", "n", F.round("accuracy", 6).alias("accuracy"), F.round(F.col("clean") - F.col("accuracy"), 6).alias("loss"))


META = "SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'png.parameters: negative prompt x, steps: 20, sampler: euler, seed: 1' WHEN 1 THEN 'png.workflow: {\"class_type\": \"KSampler\"} ' || substring(text, 1, 9) WHEN 2 THEN 'software: midjourney v6' WHEN 3 THEN 'software: adobe firefly' WHEN 4 THEN 'prompt: a seed: 2' WHEN 5 THEN 'camera: nikon' ELSE 'comment: ' || substring(text, 1, 20) END AS blob, CAST(n_chars % 3 * 512 AS INTEGER) AS width, CAST(n_chars % 2 * 512 + 512 AS INTEGER) AS height, CAST(n_chars % 101 AS INTEGER) AS pixel, CAST(n_chars * 7 % 101 AS INTEGER) AS model FROM documents"


def prv2_image_source(spark, sf):
    d = sql(spark, sf, META)
    label, level = P.image_source(F.lower("blob"))
    return d.select("doc_id", label.alias("label"), level.alias("confidence"))


def prv3_image_score(spark, sf):
    d = sql(spark, sf, META)
    _, level = P.image_source(F.lower("blob"))
    return d.select("doc_id", P.image_score(level, F.col("width"), F.col("height"), F.col("pixel"), F.col("model")).alias("score"))


def prv4_strings(spark, sf):
    d = sql(spark, sf, "SELECT page_id, html FROM pages")
    return d.select("page_id", F.size(P.printable_strings(F.encode("html", "UTF-8"), ("script", "title"))).alias("n"))


#: The provenance families, and some whose markers the pages hold.
FAMILIES = C.PROVENANCE | {"lang": ("lang=\"en\"",), "other": ("lang=\"fr\"", "Êen"), "frame": ("<nav>",), "ad": ("class=\"ad\"",)}


def prv5_markers(spark, sf):
    d = sql(spark, sf, "SELECT page_id, html FROM pages").withColumn("content", F.encode("html", "UTF-8"))
    score, kind = P.marker_score(F.col("content"), FAMILIES)
    return d.select("page_id", score.alias("score"), kind.alias("band"))


#: Pages with marks of provenance put into most of them.
MARKED = """SELECT page_id, CASE page_id % 8 WHEN 0 THEN html || '<p>c2pa signed by http://example.org/claim' || page_id || '</p>' WHEN 1 THEN 'jumbf' || html WHEN 2 THEN html || ' made with Adobe Firefly' WHEN 3 THEN 'SynthID ' || html
  WHEN 4 THEN repeat(chr(1), 120) || 'deepmind' || repeat(chr(2), 200) || ' Recraft ' || html WHEN 5 THEN html || ' Content Credentials' ELSE html END AS html FROM pages"""


def prv5_records(spark, sf):
    d = sql(spark, sf, MARKED)
    r = P.provenance_records(F.encode("html", "UTF-8"))
    return d.select("page_id", r["manifest"]["marker"].alias("manifest"), r["manifest"]["signed"].alias("signed"), r["manifest"]["claim_url"].alias("claim_url"), r["tool"]["marker"].alias("tool"), r["vendor"]["provider"].alias("vendor"), r["confidence"].alias("confidence"))


def prv6_status(spark, sf):
    return P.status_counts(sql(spark, sf, "SELECT lang, CASE doc_id % 6 WHEN 0 THEN 'valid' WHEN 1 THEN 'absent' WHEN 2 THEN 'invalid' WHEN 3 THEN NULL ELSE 'other' END AS provenance_status FROM documents"), ["lang"])


def prv7_folded(spark, sf):
    d = sql(spark, sf, "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'ChatGPT export' WHEN 1 THEN 'Word' WHEN 2 THEN 'Stable Diffusion' END AS creator, CASE WHEN doc_id % 2 = 0 THEN 'unknown' ELSE 'high' END AS confidence FROM documents")
    label, level, hints = P.folded_source(F.lit("x"), F.col("confidence"), F.create_map(F.lit("pdf.creator"), F.col("creator"), F.lit("other"), F.lit("gemini")))
    return d.select("doc_id", label.alias("label"), level.alias("confidence"), F.size(hints).alias("hints"))


#: 3-D and avatar families over text and metadata, and two whose markers the pages hold.
FIELD_FAMILIES = {f: {"metadata": m, "text": m} for f, m in (C.THREED | C.AVATAR).items()} | {"a": {"metadata": ("html lang=\"en\"",), "text": ("blog",), "extension": (".html",)}, "b": {"text": ("www",), "extension": ("/",)}}


def _family_sql(fields: dict[str, str], weights: dict[str, int]) -> str:
    parts = []
    for markers in FIELD_FAMILIES.values():
        parts += [f"{weights[k]} * CAST(({' OR '.join(f'contains({c}, {chr(39)}{m}{chr(39)})' for m in markers[k])}) AS INT)" for k, c in fields.items() if markers.get(k)]
        parts += [f"{weights['extension']} * CAST(ends_with(lower(url), '{e}') AS INT)" for e in markers.get("extension", ())]
    return "least(100, " + " + ".join(parts) + ")"


def prv8_families(spark, sf):
    d = sql(spark, sf, "SELECT page_id, url, html FROM pages")
    fam = FIELD_FAMILIES
    return d.select("page_id", P.family_score(F.col("url"), F.col("html"), F.col("url"), fam, {"metadata": 25, "text": 20, "extension": 10}).alias("score"))


def prv9_confidence(spark, sf):
    d = sql(spark, sf, "SELECT source, CASE doc_id % 3 WHEN 0 THEN 'C2PA' WHEN 1 THEN 'ExifTool' ELSE 'tool' END AS standard, doc_id % 2 = 0 AS present, CASE WHEN doc_id % 4 = 0 THEN 'Valid' ELSE 'invalid' END AS state FROM documents")
    return d.withColumn("c", P.evidence_confidence(F.col("standard"), F.col("present"), F.col("state"))).groupBy("source").agg(F.round(F.avg("c"), 6).alias("confidence"))


AGENT_TEXT = "SELECT conv_id, turn, CASE (conv_id + turn) % 7 WHEN 0 THEN text || ' Step 1: executing task. done' WHEN 1 THEN text || ' built with LangChain pipeline' WHEN 2 THEN 'the openai agent will: I have now completed task. ' || text ELSE text END AS text FROM conversations"


def txt30_agents(spark, sf):
    d = sql(spark, sf, AGENT_TEXT)
    a = P.agent_analysis(F.col("text"))
    return d.select("conv_id", "turn", *[c.alias(n) for n, c in a.items()])


def _tokens(spark, sf):
    return P.tokens(sql(spark, sf, "SELECT conv_id * 100 + turn AS item_id, text FROM conversations"), "item_id", "text")


def txt31_green(spark, sf):
    d = P.green_test(_tokens(spark, sf), "item_id", "secret")
    return d.select("item_id", "n", "greens", F.round("z", 6).alias("z"), "score")


def txt32_mean_g(spark, sf):
    d = P.mean_g_test(_tokens(spark, sf), "item_id", ["k1", "k2", "k3"])
    return d.select("item_id", "trials", F.round("mean_g", 6).alias("mean_g"), F.round("z", 5).alias("z"))


NLL = "SELECT l_suppkey AS doc_id, 'v' || CAST(l_linenumber % 2 AS VARCHAR(2)) AS view, row_number() OVER (PARTITION BY l_suppkey, l_linenumber % 2 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_tax) - 1 AS pos, CAST(l_quantity AS DOUBLE) / 15 AS nll, CAST(l_quantity AS DOUBLE) / 15 + CAST(l_tax AS DOUBLE) AS xnll FROM lineitem"


def txt33_perplexity(spark, sf):
    d = P.perplexity(sql(spark, sf, NLL), "doc_id", window=64)
    return d.select("doc_id", F.round("ppl", 5).alias("ppl"), F.round("burst_cv", 6).alias("burst_cv"), "ppl_score", F.round("ratio", 6).alias("ratio"), "ratio_score")




def evd1_integrity(spark, sf):
    then = sql(spark, sf, "SELECT CAST(doc_id AS VARCHAR(20)) AS path, source, CASE WHEN doc_id % 11 = 0 THEN '' ELSE md5(text) END AS file_hash FROM documents")
    now = sql(spark, sf, "SELECT CAST(doc_id AS VARCHAR(20)) AS path, CASE WHEN doc_id % 7 = 0 THEN md5(text || 'x') ELSE md5(text) END AS file_hash FROM documents WHERE doc_id % 13 > 0")
    d = E.integrity(E.verified(then, now), ["source"])
    return d.select("source", "items", "verified", F.round("integrity_score", 6).alias("integrity_score"))


def evd3_signatures(spark, sf):
    rows = E.signed(sql(spark, sf, "SELECT doc_id, lang, n_chars FROM documents"), ["doc_id", "lang", "n_chars"], "key")
    rows = rows.withColumns({"n_chars": F.when(F.col("doc_id") % 5 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")), "signature": F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.col("signature"))})
    return rows.select("doc_id", E.signature_state(["doc_id", "lang", "n_chars"], "key").alias("state"))


def evd4_exhibits(spark, sf):
    return E.exhibits(sql(spark, sf, "SELECT item_id, source AS case_id, path, band FROM items_base")).select("item_id", "exhibit", "purpose", "references_due")


def evd5_violations(spark, sf):
    d = sql(spark, sf, "SELECT doc_id AS item_id, CASE doc_id % 5 WHEN 0 THEN 'observed' WHEN 1 THEN 'model-assisted' WHEN 2 THEN 'derived' WHEN 3 THEN 'guess' END AS trust_level, n_chars FROM documents")
    return E.violations(d.withColumn("limitations", F.when(F.col("n_chars") % 2 == 0, F.array(F.lit("x")))))


def evd6_cases(spark, sf):
    items = sql(spark, sf, "SELECT source AS case_id, doc_id AS item_id, CASE WHEN doc_id % 2 = 0 THEN 'observed' ELSE 'derived' END AS trust_level FROM documents")
    edges = sql(spark, sf, "SELECT source AS case_id, doc_id AS src, CAST(floor(doc_id / 2) AS BIGINT) AS dst, 'derived_from' AS relation FROM documents WHERE doc_id > 0")
    return E.case_lines(items, edges)


_RULES = {
    "med1_audio": _rule_query(AUDIO, R.AUDIO), "med4_screen": _rule_query(SCREEN, R.SCREEN, 35, 20), "med7_seam": _rule_query(SEAM, R.SEAM, 50, 25), "med8_face": _rule_query(FACE, R.FACE),
    "med9_inpaint": _rule_query(INPAINT, R.INPAINT), "img8_mobile": _rule_query(MOBILE, R.MOBILE), "win6_container": _rule_query(CONTAINER, R.CONTAINER),
}
QUERIES = {k: q for k, (q, _) in _RULES.items()} | {k: f for k, f in list(globals().items()) if callable(f) and k[:3] in ("img", "fus", "srt", "win", "str", "med", "prv", "txt", "evd")}

_FR = """f0 AS (SELECT *, brightness - lag(brightness) OVER w AS db, contrast - lag(contrast) OVER w AS dc, blur - lag(blur) OVER w AS dl, edges - lag(edges) OVER w AS de FROM frames_base WINDOW w AS (PARTITION BY video_id ORDER BY frame_number)),
turns AS (SELECT video_id, sign(dl) AS s, lag(sign(dl)) OVER (PARTITION BY video_id ORDER BY frame_number) AS s0 FROM f0 WHERE dl <> 0), tn AS (SELECT video_id, count(*) AS turns, count(*) FILTER (WHERE s <> s0) / greatest(count(*) - 1, 1) AS oscillation FROM turns GROUP BY video_id),
ff AS (SELECT f0.video_id, count(*) AS n, stddev_pop(brightness) AS brightness_std, stddev_pop(contrast) AS contrast_std, stddev_pop(blur) AS blur_std, avg(blur) AS blur_mean, stddev_pop(edges) AS edges_std, coalesce(max(abs(db)), 0) AS brightness_step, coalesce(max(abs(dl)), 0) AS blur_step, coalesce(max(abs(dc)), 0) AS contrast_step, coalesce(max(abs(de)), 0) AS edges_step,
 greatest(max(brightness) - avg(brightness), avg(brightness) - min(brightness)) AS bs, greatest(max(contrast) - avg(contrast), avg(contrast) - min(contrast)) AS cs, count(*) FILTER (WHERE abs(db) > 50) AS brightness_cuts, coalesce(any_value(turns), 0) AS turns, coalesce(any_value(oscillation), 0.0) AS oscillation, avg(abs(dl)) / nullif(avg(blur), 0) AS amplitude, avg(abs(db)) / CASE WHEN avg(brightness) = 0 THEN 1.0 ELSE avg(brightness) END AS jitter FROM f0 LEFT JOIN tn USING (video_id) GROUP BY f0.video_id),
fs AS (SELECT *, n >= 10 AND brightness_step < 3 AND bs < 3 AND contrast_step < 3 AND cs < 3 AND blur_step < 25 AND edges_step < 0.01 AS still FROM ff)"""


def _lag_sql(rate: float, seconds: float, least: int, need: float, normalised: bool) -> str:
    m = int(rate * seconds)
    value = "CASE WHEN sqrt(sum(a.x * a.x)) * sqrt(sum(b.y * b.y)) > 1e-9 THEN sum(a.x * b.y) / (sqrt(sum(a.x * a.x)) * sqrt(sum(b.y * b.y))) END" if normalised else "sum(a.x * b.y) / count(*)"
    z = "" if normalised else " / stddev_pop({c}) OVER w"
    return f"""WITH e AS ({ENVELOPES}), d AS (SELECT stream_id, t, count(*) OVER w AS n, (audio - avg(audio) OVER w){z.format(c='audio')} AS x, (motion - avg(motion) OVER w){z.format(c='motion')} AS y, stddev_pop(audio) OVER w AS sx, stddev_pop(motion) OVER w AS sy FROM e WINDOW w AS (PARTITION BY stream_id)),
    k AS (SELECT * FROM d WHERE n >= {least} AND n / {rate} >= {need} AND sx > 1e-9 AND sy > 1e-9), r AS (SELECT a.stream_id, max(a.n) AS n, l AS lag, round(CASE WHEN count(*) >= {least} THEN {value} END, 12) AS r FROM k a CROSS JOIN range(-{m}, {m + 1}) g(l) JOIN k b ON b.stream_id = a.stream_id AND b.t = a.t - l GROUP BY a.stream_id, l),
    b AS (SELECT stream_id, max(n) AS n, arg_max(lag, (r, -lag)) FILTER (WHERE r IS NOT NULL{' AND r > 0' if normalised else ''}) AS lag, max(r) FILTER (WHERE r IS NOT NULL{' AND r > 0' if normalised else ''}) AS r FROM r GROUP BY stream_id)"""


_UNIT = "CAST(('0x' || left(sha256('{key}:' || b || ':' || token), 8))::UBIGINT AS DOUBLE) / 4294967296"
_TOK = """t0 AS (SELECT conv_id * 100 + turn AS item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS ws FROM conversations), t1 AS (SELECT item_id, unnest(ws) AS w, unnest(range(len(ws))) AS pos FROM t0),
t2 AS (SELECT item_id, pos, ('0x' || left(sha256(w), 8))::UBIGINT % 1000 AS token FROM t1), tk AS (SELECT *, lag(token) OVER (PARTITION BY item_id ORDER BY pos) AS b FROM t2 QUALIFY b IS NOT NULL)"""
_ROUND = "CAST(round_even(round({}, 9), 0) AS INT)"
_IMG_SOURCE = "CASE WHEN (contains(b, 'png.workflow') OR contains(b, 'png.prompt') OR contains(b, '\"workflow\"') OR contains(b, 'comfyui')) AND (" + " OR ".join(f"contains(b, '{m}')" for m in ("ksampler", "checkpointloadersimple", "loraloader", '"class_type"', '"inputs"', '"widgets_values"')) + ") THEN 'ComfyUI 추정' WHEN (contains(b, 'negative prompt') OR contains(b, 'png.parameters')) AND " + " + ".join(f"CAST(contains(b, '{m}') AS INT)" for m in ("steps:", "sampler:", "cfg scale", "seed:", "model hash", "model:")) + " >= 2 THEN 'AUTOMATIC1111 추정' " + " ".join(f"WHEN regexp_matches(b, '(^|\\s)({'|'.join(m.replace('.', chr(92) + '.') for m in ms)})(\\s|$)') THEN '{n}'" for n, ms in P.DIRECT_TOOLS) + " WHEN " + " + ".join(f"CAST(contains(b, '{m}') AS INT)" for m in ("prompt", "negative prompt", "seed", "cfg", "sampler", "model hash", "model_name", "lora", "checkpoint")) + " >= 2 THEN '생성 메타데이터 추정' ELSE '알 수 없음' END"
_LEVEL = "CASE label WHEN '알 수 없음' THEN 'unknown' WHEN '생성 메타데이터 추정' THEN 'medium' ELSE 'high' END"
_META = f"m AS (SELECT *, lower(blob) AS b FROM ({META})), s AS (SELECT *, {_IMG_SOURCE} AS label FROM m), c AS (SELECT *, {_LEVEL} AS confidence FROM s)"
_AG_N = {n: "(" + " OR ".join(f"contains(t, '{m}')" for m in ms) + ")" for n, ms in P.AGENTS.items()}
_any = lambda word: "(" + " OR ".join(v for k, v in _AG_N.items() if word in k) + ")"
_AGENT = f"""a AS ({AGENT_TEXT}), l AS (SELECT conv_id, turn, lower(text) AS t FROM a), c AS (SELECT *, {' + '.join(f'CAST({v} AS INT)' for v in _AG_N.values())} AS names, {' + '.join(f"CAST(regexp_matches(t, '{p}') AS INT)" for p in P.WORKFLOW)} AS flows, {' + '.join(f"CAST(regexp_matches(t, '{p}') AS INT)" for p in P.AUTOMATIC)} AS autos,
 CASE WHEN {_any('openai')} THEN 'openai_agent' WHEN {_any('anthropic')} THEN 'anthropic_agent' WHEN {_any('google')} THEN 'google_agent' WHEN {_any('microsoft')} THEN 'microsoft_agent' WHEN {_AG_N['langchain']} OR {_AG_N['crewai']} THEN 'framework_agent' ELSE 'unknown' END AS agent_type FROM l), s AS (SELECT *, least(100, names * 30 + flows * 20 + autos * 15) AS score, names + flows + autos AS n_signals FROM c)"""

_PULSE = """xs AS (SELECT video_id, frame_number AS t, brightness - avg(brightness) OVER (PARTITION BY video_id) AS x FROM frames_base),
fs AS (SELECT CAST(0.7 + k * 0.05 AS DOUBLE) AS f FROM range(67) r(k)),
waves AS (SELECT video_id, f, sum(x * cos(2 * pi() * f * t / 30.0)) AS re, sum(x * sin(2 * pi() * f * t / 30.0)) AS im FROM xs CROSS JOIN fs GROUP BY video_id, f),
powers AS (SELECT *, re * re + im * im AS power FROM waves),
peaks AS (SELECT video_id, arg_max({'f': f, 're': re, 'im': im, 'power': power}, (power, -f)) AS p, (max(power)) / greatest((sum(power) - max(power)) / (count(*) - 1), 1e-12) AS snr FROM powers GROUP BY video_id)"""
_EXPLAINED = f"b AS ({AUDIO}), s AS (SELECT item_id, duration, list_filter([" + ", ".join("CASE " + " ".join("WHEN {} THEN {{'t': '{}', 'w': {}}}".format(c, t.replace("'", "''"), w) for t, c, w in cases) + " END" for cases in R.AUDIO.values()) + "], lambda x: x IS NOT NULL) AS own FROM b), x AS (SELECT item_id, duration, least(100, coalesce(list_sum(list_transform(own, lambda x: x.w)), 0))::INTEGER AS score, list_transform(list_sort(list_transform(own, lambda x: {'k': -x.w, 't': x.t})), lambda x: {'t': x.t, 'w': -x.k}) AS sorted FROM s)"


def _first(text: str, markers) -> str:
    return "CASE " + " ".join(f"WHEN contains({text}, '{m}') THEN '{m}'" for m in markers) + " END"


def _near_tool() -> str:
    cases = []
    for m in C.GOOGLE:
        at = f"position('{m}' IN html)"
        near = f"substring(html, greatest({at} - 50, 1), {at} + 100 - greatest({at} - 50, 1))"
        cases.append(f"WHEN {at} > 0 AND len(regexp_extract_all({near}, '[^\\x00-\\x1f\\x7f]')) > 0.5 * length({near}) THEN '{m}'")
    return "CASE " + " ".join(cases) + " END"



SQL = {k: s for k, (_, s) in _RULES.items()} | {
    "img2_experts": f"WITH {_expert_sql()} SELECT * FROM e",
    "fus7_expert_fusion": f"""WITH {_expert_sql()}, w AS (SELECT item_id, {', '.join(f'{v} AS s_{k}' for k, v in _USED.items())} FROM b),
        c AS (SELECT item_id, {_votes('>= 67')} AS high, {_votes('BETWEEN 45 AND 66')} AS medium, {_votes('>= 45', ('baseline',))} AS r, {_votes('>= 45', ('alpha', 'error_level', 'localization'))} AS l, {_votes('>= 45', ('frequency', 'reconstruction', 'fractal'))} AS s, ({' + '.join(f's_{k} * 0.2' for k in _USED)}) / {0.2 * len(R.EXPERTS) - 0.2} AS m FROM w)
        SELECT item_id, high, medium, CASE WHEN high >= 2 OR (high > 0 AND r > 0 AND s > 0) THEN greatest(72, least(96, {_ROUND.format('m + 16')})) WHEN high > 0 AND (medium > 0 OR l > 0) THEN greatest(66, least(88, {_ROUND.format('m + 10')})) WHEN medium >= 3 THEN greatest(54, least(78, {_ROUND.format('m + 8')})) WHEN medium >= 1 THEN greatest(34, least(62, {_ROUND.format('m + 3')})) ELSE greatest(0, least(32, {_ROUND.format('m')})) END AS score FROM c""",
    "srt3_experts": f"WITH {_expert_sql()} SELECT item_id, name, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, name) AS place FROM e WHERE score >= 45 QUALIFY place <= 5",
    "win1_frames": oracle(f"WITH {_FR} SELECT video_id, n, brightness_cuts, turns, still, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("brightness_std", "contrast_std", "blur_std", "blur_mean", "edges_std", "brightness_step", "blur_step", "oscillation", "amplitude", "jitter")) + " FROM fs"),
    "win5_video_score": oracle(f"WITH {_FR} SELECT video_id, CASE WHEN still THEN 0 ELSE least(100, {' + '.join('(' + R.probe_weight(c) + ')' for c in R.FRAMES.values())}) END AS score FROM fs"),
    "win7_track": """WITH d AS (SELECT label, embedding AS e, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM embeddings), c AS (SELECT label, CASE WHEN p IS NOT NULL THEN 1 - list_cosine_similarity(CAST(e AS DOUBLE[]), CAST(p AS DOUBLE[])) END AS x FROM d),
        s AS (SELECT label, count(*) AS n, avg(x) AS m, max(x) AS h, stddev_pop(x) AS s FROM c GROUP BY label) SELECT label, n, CASE WHEN n >= 8 THEN round(m, 5) END AS drift_mean, CASE WHEN n >= 8 THEN round(h, 5) END AS drift_max, CASE WHEN n >= 8 THEN round(s, 5) END AS drift_std, CASE WHEN n >= 8 THEN CASE WHEN m > 0.35 THEN 35 WHEN m > 0.2 THEN 15 ELSE 0 END + CASE WHEN h > 0.6 THEN 15 ELSE 0 END END AS score FROM s""",
    "win8_av_sync": oracle(_lag_sql(8.0, 1.0, 16, 3.0, True) + " SELECT stream_id, n, coalesce(lag, 0) / 8.0 AS offset_seconds, round(coalesce(r, 0.0), 6) AS correlation, CASE WHEN coalesce(r, 0.0) < 0.15 THEN 0 WHEN abs(coalesce(lag, 0) / 8.0) > 0.3 THEN 18 ELSE 0 END AS weight FROM b"),
    "win9_lipsync": oracle(_lag_sql(4.0, 2.0, 20, 0.0, False) + " SELECT stream_id, n, coalesce(lag, 0) / 4.0 AS offset_seconds, round(coalesce(r, 0.0), 6) AS correlation, CASE WHEN coalesce(r, 0.0) < 0.12 THEN 30 WHEN abs(coalesce(lag, 0) / 4.0) > 0.5 THEN 25 ELSE 0 END AS weight FROM b"),
    "win12_variation": "WITH d AS (SELECT user_id, value, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS d FROM events) SELECT user_id, round(CASE WHEN count(*) >= 3 THEN coalesce(avg(d) / nullif(avg(abs(value)), 0), 0.0) ELSE 0.0 END, 6) AS variation FROM d GROUP BY user_id",
    "win13_pauses": "WITH q AS (SELECT *, value <= max(value) OVER (PARTITION BY user_id) * 0.2 AS quiet FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, quiet ORDER BY ts, event_id) AS g FROM q), r AS (SELECT user_id, g, count(*) AS k FROM n WHERE quiet GROUP BY user_id, g), s AS (SELECT user_id, count(*) AS runs, sum(k) AS quiet, stddev_pop(k) / avg(k) AS cv FROM r GROUP BY user_id), a AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) SELECT a.user_id, round(coalesce(quiet, 0) / n, 6) AS ratio, coalesce(runs, 0) AS runs, round(coalesce(cv, 0.0), 6) AS cv FROM a LEFT JOIN s ON s.user_id = a.user_id",
    "win14_floor": "WITH d AS (SELECT user_id, value * 0.013 % 1.0 AS f, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS r FROM events) SELECT user_id, round(stddev_pop(f), 6) AS spread FROM d WHERE r <= greatest(8, n // 10) GROUP BY user_id",
    "str1_rolling": oracle("WITH d AS (SELECT *, avg(score) OVER (PARTITION BY stream_id ORDER BY ts, event_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS m, row_number() OVER (PARTITION BY stream_id ORDER BY ts, event_id) AS frame_count FROM stream_base) SELECT stream_id, event_id, round(m, 6) AS mean, frame_count, CASE WHEN m >= 67 THEN 'high' WHEN m >= 35 THEN 'medium' ELSE 'low' END AS band FROM d"),
    "str2_alerts": oracle("""WITH RECURSIVE d AS (SELECT stream_id, event_id, ts, avg(least(100, score * 2)) OVER (PARTITION BY stream_id ORDER BY ts, event_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS m FROM stream_base),
        h AS (SELECT stream_id, event_id, ts, row_number() OVER (PARTITION BY stream_id ORDER BY ts, event_id) AS r FROM d WHERE m >= 67),
        f AS (SELECT stream_id, event_id, ts, r, ts AS last, TRUE AS fires FROM h WHERE r = 1 UNION ALL SELECT h.stream_id, h.event_id, h.ts, h.r, CASE WHEN epoch(h.ts) - epoch(f.last) > 5 THEN h.ts ELSE f.last END, epoch(h.ts) - epoch(f.last) > 5 FROM f JOIN h ON h.stream_id = f.stream_id AND h.r = f.r + 1),
        p AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY r DESC) AS back, count(*) OVER (PARTITION BY stream_id) AS alerts FROM f WHERE fires)
        SELECT stream_id, max(alerts) AS alerts, string_agg(event_id, ',' ORDER BY r) AS last FROM p WHERE back <= 10 GROUP BY stream_id"""),
    "str3_summary": oracle("WITH d AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY ts DESC, event_id DESC) AS r, count(*) OVER (PARTITION BY stream_id) AS n FROM stream_base) SELECT stream_id, max(n) AS frame_count, round(avg(score), 6) AS average_score, max(score) AS max_score, min(score) AS min_score FROM d WHERE r <= 30 GROUP BY stream_id"),
    "fus1_components": oracle(f"SELECT item_id, own AS metadata, CASE source_confidence WHEN 'high' THEN 100 WHEN 'medium' THEN 65 WHEN 'low' THEN 35 ELSE 0 END AS source FROM ({FUSED_ITEMS})"),
    "fus2_fused": oracle(f"WITH d AS ({FUSED_ITEMS}), s AS (SELECT *, {_ROUND.format('own * 0.35 + pixel_score * 0.25 + coalesce(model_score, 0) * 0.3 + (CASE source_confidence WHEN $$high$$ THEN 100 WHEN $$medium$$ THEN 65 WHEN $$low$$ THEN 35 ELSE 0 END) * 0.1')} AS score FROM d) SELECT item_id, score, CASE WHEN score < 8 AND source_confidence = 'unknown' THEN 'unknown' WHEN score >= 67 THEN 'high' WHEN score >= 35 THEN 'medium' ELSE 'low' END AS band, 5 AS n_signals FROM s"),
    "fus4_ensemble": oracle(f"""WITH e AS ({ENSEMBLE}), p AS (SELECT * FROM (VALUES ('m1', 1.0, NULL, TRUE), ('m2', 4.0, 0.3, FALSE), ('m3', 0.05, NULL, FALSE), ('m4', 2.0, 0.7, FALSE)) v(member, w, lo, en)), k AS (SELECT item_id, score, CASE WHEN jpeg_quality < 75 AND lo < w THEN lo ELSE w END AS w FROM e JOIN p USING (member) WHERE available AND NOT (hangul > 0.3 AND en)),
        a AS (SELECT item_id, count(*) AS kept, sum(score * w) / sum(w) AS m, max(score) - min(score) AS spread FROM k GROUP BY item_id), t AS (SELECT item_id, count(*) AS members FROM e GROUP BY item_id), j AS (SELECT t.*, coalesce(kept, 0) AS kept, coalesce({_ROUND.format('m')}, 0) AS score, CASE WHEN kept > 1 THEN spread ELSE 0 END AS spread, CASE WHEN coalesce(kept, 0) < 2 THEN 'n/a' WHEN spread <= 20 THEN 'high' ELSE 'low' END AS agreement FROM t LEFT JOIN a ON a.item_id = t.item_id)
        SELECT *, CASE WHEN kept = 0 THEN 'unavailable' WHEN agreement = 'low' THEN 'low' WHEN score >= 80 THEN 'high' WHEN score >= 50 THEN 'medium' ELSE 'low' END AS confidence FROM j"""),
    "fus5_outputs": oracle(f"WITH o AS ({OUTPUTS}) SELECT item_id, CAST(round_even(100 * exp(b - greatest(a, b)) / (exp(a - greatest(a, b)) + exp(b - greatest(a, b))), 0) AS INT) AS softmax, greatest(0, CAST(round_even(100 / (1 + exp(-a)), 0) AS INT) - 5) AS sigmoid, CAST(round_even(CAST(c AS DOUBLE) * 100, 0) AS INT) AS plain FROM o"),
    "fus6_frames": oracle(f"SELECT stream_id, count(*) AS frames, {_ROUND.format('avg(score)')} AS mean_score, max(score) - min(score) > 40 AS wide, max(score) AS max_score FROM stream_base GROUP BY stream_id"),
    "fus8_multimodal": f"""WITH m AS ({MODAL}), s AS (SELECT subject_id, count(*) AS modalities, avg(score) AS m, max(score) - min(score) AS spread, stddev_pop(score) AS sd, count(*) FILTER (WHERE source <> 'unknown') AS named, count(DISTINCT source) FILTER (WHERE source <> 'unknown') AS sources, sum(sync_weight) AS sync FROM m GROUP BY subject_id),
        c AS (SELECT *, least(100, {_ROUND.format('m + sync + CASE WHEN modalities < 2 THEN 0 WHEN spread > 40 THEN 20 WHEN named >= 2 AND sources > 1 THEN 15 ELSE 0 END')}) AS score FROM s) SELECT subject_id, modalities, score, CASE WHEN score >= 67 THEN 'high' WHEN score >= 35 THEN 'medium' ELSE 'low' END AS band, round(CASE WHEN modalities < 2 THEN 0.5 ELSE least(1.0, greatest(0.0, 1 - sd / 50) + CASE WHEN named >= 2 AND sources = 1 THEN 0.2 ELSE 0.0 END) END, 6) AS consistency FROM c""",
    "med2_audio_source": f"WITH b AS ({AUDIO}) SELECT item_id, CASE WHEN flatness > 0.7 THEN 'noise' WHEN pitch_std < 3 AND duration > 5 THEN 'speech synthesis' WHEN bandwidth < 800 THEN 'compressed' ELSE 'unknown' END AS guess FROM b",
    "med3_speakers": f"WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT a.vec_id, b.vec_id AS other_id, greatest(0, least(100, {_ROUND.format('list_cosine_similarity(a.e, b.e) * 160')})) AS score FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0) SELECT vec_id, count(*) AS compared, count(*) FILTER (WHERE score >= 67) AS matched, arg_max(other_id, (score, -other_id)) AS best_id, max(score) AS score FROM s GROUP BY vec_id",
    "med5_classifier": "WITH s AS (SELECT " + ", ".join(f"avg(CAST({c} AS DOUBLE)) AS m_{c}, stddev_pop(CAST({c} AS DOUBLE)) AS s_{c}" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")) + " FROM lineitem) SELECT l_orderkey, l_linenumber, round(least(1.0, " + " + ".join(f"coalesce(least(0.25, 0.1 * abs((CAST({c} AS DOUBLE) - m_{c}) / nullif(s_{c}, 0))), 0)" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")) + "), 5) AS score FROM lineitem, s",
    "med6_spectral": f"WITH b AS ({AUDIO}) SELECT item_id, CASE WHEN flatness > 0.7 THEN 'Synthetic Audio' WHEN 1 - pitch_std / 120 > 0.9 THEN 'TTS Engine' END AS tool, CAST(CASE WHEN flatness > 0.7 THEN 0.6 WHEN 1 - pitch_std / 120 > 0.9 THEN 0.5 END AS DOUBLE) AS confidence FROM b",
    "med10_layers": "SELECT l_orderkey AS item_id, CAST(sum(least(CAST(l_quantity AS INTEGER), CASE l_linenumber % 4 WHEN 0 THEN 20 WHEN 1 THEN 25 WHEN 2 THEN 30 ELSE 35 END)) AS BIGINT) AS added FROM lineitem GROUP BY l_orderkey",
    "med11_sensor": "WITH r AS (SELECT label, unnest(embedding) AS v, unnest(range(len(embedding))) AS pos FROM embeddings WHERE vec_id % 5 > 0), f AS (SELECT label, pos, avg(CAST(v AS DOUBLE)) AS m FROM r GROUP BY ALL HAVING count(*) >= 3), t AS (SELECT vec_id, label, unnest(embedding) AS v, unnest(range(len(embedding))) AS pos FROM embeddings WHERE vec_id % 5 = 0) SELECT vec_id, label, round(corr(CAST(v AS DOUBLE), m), 5) AS correlation FROM t JOIN f USING (label, pos) GROUP BY vec_id, label",
    "img1_histograms": f"""WITH h AS ({HIST}), a AS (SELECT *, sum(n) OVER w AS a, sum(bucket * n) OVER w / sum(n) OVER w AS mean, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, bucket) AS r FROM h WINDOW w AS (PARTITION BY image_id)), m AS (SELECT image_id, any_value(mean) AS mean, sum(n / a * pow(bucket - mean, 2)) AS m2, sum(n / a * pow(bucket - mean, 3)) AS m3, sum(n / a * pow(bucket - mean, 4)) AS m4, -sum(n / a * log2(n / a)) AS entropy, sum(CASE WHEN r <= 8 THEN n / a ELSE 0 END) AS top_share FROM a GROUP BY image_id)
        SELECT image_id, round(mean, 5) AS mean, round(sqrt(m2), 5) AS std, round(entropy, 5) AS entropy, round(CASE WHEN m2 > 1e-12 THEN m3 / pow(sqrt(m2), 3) ELSE 0 END, 5) AS skew, round(CASE WHEN m2 > 1e-12 THEN m4 / (m2 * m2) ELSE 0 END, 5) AS kurtosis, round(top_share, 5) AS top_share FROM m""",
    "img3_tiles": f"WITH t AS (SELECT image_id, edge_mean + 0.35 * edge_std AS s FROM ({TILES})), w AS (SELECT *, avg(s) OVER p AS m, stddev_pop(s) OVER p AS d FROM t WINDOW p AS (PARTITION BY image_id)), a AS (SELECT image_id, count(*) AS tiles, max(s) / greatest(1.0, avg(s)) AS anomaly_ratio, count(*) FILTER (WHERE s > m + 1.4 * d) / count(*) AS high_ratio, stddev_pop(s) AS tile_std FROM w GROUP BY image_id) SELECT image_id, tiles, round(anomaly_ratio, 5) AS anomaly_ratio, round(high_ratio, 5) AS high_ratio, round(tile_std, 5) AS tile_std, CASE WHEN tiles >= 12 AND anomaly_ratio > 3.2 AND tile_std > 7 THEN 67 WHEN tiles >= 12 AND anomaly_ratio > 2.35 AND tile_std > 5 THEN 52 ELSE 0 END AS score FROM a",
    "img5_prototypes": f"""WITH b AS ({PROTO}), d AS (SELECT item_id, {', '.join('sqrt(' + ' + '.join(f'pow(f{i + 1} - {v}, 2)' for i, v in enumerate(p)) + f') AS {k}' for k, p in I.PROTOTYPES.items())} FROM b) SELECT item_id, CAST(round_even(least(1.0, greatest(0.0, (camera_like - least(synthetic_grid, synthetic_smooth) + 0.35) / 0.9)) * 78, 0) AS INT) AS score, CASE WHEN synthetic_grid <= synthetic_smooth AND synthetic_grid <= camera_like THEN 'synthetic_grid' WHEN synthetic_smooth <= camera_like THEN 'synthetic_smooth' ELSE 'camera_like' END AS nearest FROM d""",
    "img6_accumulated": f"WITH b AS ({PROTO}), n AS (SELECT item_id, CAST(f1 > 0.5 AS INT) + CAST(f2 > 0.68 AS INT) + CAST(f3 > 0.8 AS INT) AS n FROM b) SELECT item_id, CASE WHEN n > 0 THEN least(74, 22 + 16 * n) ELSE 0 END AS score FROM n",
    "img7_variants": oracle("WITH m AS (SELECT transform, count(*) AS n, avg(CAST(CAST(score >= 50 AS INT) = label AS INT)) AS a FROM scored_base GROUP BY transform) SELECT transform, n, round(a, 6) AS accuracy, round((SELECT a FROM m WHERE transform = 'clean') - a, 6) AS loss FROM m"),
    "prv2_image_source": f"WITH {_META} SELECT doc_id, label, confidence FROM c",
    "prv3_image_score": f"WITH {_META} SELECT doc_id, least(100, CASE confidence WHEN 'high' THEN 67 WHEN 'medium' THEN 36 ELSE 0 END + CASE WHEN width = height AND width >= 512 AND width % 64 = 0 THEN 9 ELSE 0 END + CASE WHEN pixel >= 82 THEN 61 WHEN pixel >= 68 THEN 47 WHEN pixel >= 48 THEN 35 WHEN pixel >= 32 THEN 18 ELSE 0 END + CASE WHEN model >= 82 THEN 67 WHEN model >= 65 THEN 42 WHEN model >= 45 THEN 24 ELSE 0 END) AS score FROM c",
    "prv5_markers": "WITH s AS (SELECT page_id, least(100, 10 * (" + " + ".join("CAST(" + " OR ".join(f"contains(html, '{m}')" for m in ms) + " AS INT)" for ms in FAMILIES.values()) + ")) AS score FROM pages) SELECT *, CASE WHEN score >= 50 THEN 'high' WHEN score >= 20 THEN 'medium' ELSE 'low' END AS band FROM s",
    "prv6_status": "SELECT lang, CASE doc_id % 6 WHEN 0 THEN 'valid' WHEN 1 THEN 'absent' WHEN 2 THEN 'invalid' ELSE 'unavailable' END AS status, count(*) AS n FROM documents GROUP BY ALL",
    "prv7_folded": "SELECT doc_id, CASE WHEN doc_id % 5 IN (0, 2) AND doc_id % 2 = 0 THEN 'AI 도구 생성 메타데이터 추정' ELSE 'x' END AS label, CASE WHEN doc_id % 2 = 1 THEN 'high' WHEN doc_id % 5 IN (0, 2) THEN 'medium' ELSE 'unknown' END AS confidence, CAST(doc_id % 5 <= 2 AS INT) AS hints FROM documents",
    "prv8_families": f"SELECT page_id, {_family_sql({'metadata': 'lower(html)', 'text': 'lower(url)'}, {'metadata': 25, 'text': 20, 'extension': 10})} AS score FROM pages",
    "prv9_confidence": "SELECT source, round(avg(CASE WHEN doc_id % 3 = 0 AND doc_id % 4 = 0 THEN 0.9 WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN 0.5 WHEN doc_id % 3 = 0 THEN 0.3 ELSE 0.4 END), 6) AS confidence FROM documents GROUP BY source",
    "txt30_agents": f"WITH {_AGENT} SELECT conv_id, turn, score, n_signals, agent_type, CASE WHEN score >= 67 THEN 'high' WHEN score >= 35 THEN 'medium' ELSE 'low' END AS band, CASE WHEN score >= 67 AND n_signals >= 3 THEN 'high' WHEN score >= 35 THEN 'medium' ELSE 'low' END AS confidence FROM s",
    "txt31_green": f"WITH {_TOK}, g AS (SELECT item_id, count(*) AS n, count(*) FILTER (WHERE {_UNIT.format(key='secret')} < 0.25) AS greens FROM tk GROUP BY item_id HAVING count(*) >= 32), z AS (SELECT *, (greens - 0.25 * n) / sqrt(n * 0.25 * 0.75) AS z FROM g) SELECT item_id, n, greens, round(z, 6) AS z, greatest(0, least(100, CAST(trunc(z / 8 * 100) AS INT))) AS score FROM z",
    "txt32_mean_g": f"WITH {_TOK}, g AS (SELECT item_id, count(*) * 3 AS trials, avg(({' + '.join(_UNIT.format(key=k) for k in ('k1', 'k2', 'k3'))}) / 3) AS m FROM tk GROUP BY item_id) SELECT item_id, trials, round(m, 6) AS mean_g, round((m - 0.5) / sqrt(1 / (12.0 * trials)), 5) AS z FROM g",
    "txt33_perplexity": f"""WITH t AS ({NLL}), p AS (SELECT doc_id, view, pos // 64 AS w, avg(nll) AS m, sum(nll) AS s, sum(xnll) AS x, count(*) AS n FROM t GROUP BY ALL), v AS (SELECT doc_id, view, exp(least(20.0, sum(s) / sum(n))) AS ppl, sum(s) / greatest(1e-9, sum(x)) AS ratio, CASE WHEN count(*) >= 3 THEN stddev_pop(m) / greatest(1e-9, avg(m)) ELSE 0.0 END AS cv FROM p GROUP BY doc_id, view HAVING sum(n) >= 32),
        b AS (SELECT doc_id, min(ppl) AS ppl, arg_min(cv, (ppl, view)) AS cv, min(ratio) AS ratio FROM v GROUP BY doc_id) SELECT doc_id, round(ppl, 5) AS ppl, round(cv, 6) AS burst_cv, CAST(round_even(least(100.0, greatest(0.0, 100 * (ln(60.0) - ln(ppl)) / (ln(60.0) - ln(8.0)))), 0) AS INT) AS ppl_score, round(ratio, 6) AS ratio, CAST(round_even(least(100.0, greatest(0.0, 100 * (1.05 - ratio) / (1.05 - 0.85))), 0) AS INT) AS ratio_score FROM b""",
    "evd1_integrity": "SELECT source, count(*) AS items, count(*) FILTER (WHERE doc_id % 11 > 0 AND doc_id % 13 > 0 AND doc_id % 7 > 0) AS verified, round(count(*) FILTER (WHERE doc_id % 11 > 0 AND doc_id % 13 > 0 AND doc_id % 7 > 0) / count(*), 6) AS integrity_score FROM documents GROUP BY source",
    "evd3_signatures": "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'unsigned' WHEN doc_id % 5 = 0 THEN 'tampered' ELSE 'verified' END AS state FROM documents",
    "evd4_exhibits": oracle("SELECT item_id, row_number() OVER (PARTITION BY source ORDER BY path) AS exhibit, CASE band WHEN 'high' THEN 'priority review' WHEN 'medium' THEN 'further check' WHEN 'unknown' THEN 'more material' ELSE 'record' END AS purpose, band IN ('high', 'medium') AS references_due FROM items_base"),
    "evd6_cases": """SELECT source AS case_id, 'item' AS part, '{"schema":"evidence-case-v1","case_id":"' || source || '","item_id":' || doc_id || ',"trust_level":"' || CASE WHEN doc_id % 2 = 0 THEN 'observed' ELSE 'derived' END || '"}' AS line FROM documents
        UNION ALL SELECT source, 'lineage', '{"schema":"evidence-case-v1","case_id":"' || source || '","src":' || doc_id || ',"dst":' || CAST(floor(doc_id / 2) AS BIGINT) || ',"relation":"derived_from"}' FROM documents WHERE doc_id > 0""",
    "evd5_violations": "SELECT doc_id AS item_id, CASE WHEN doc_id % 5 IN (3, 4) THEN 'trust_level' ELSE 'limitations' END AS violation FROM documents WHERE doc_id % 5 IN (3, 4) OR (doc_id % 5 = 1 AND n_chars % 2 = 1)",
    "win10_pulse": oracle(f"WITH {_PULSE} SELECT video_id, round(p.f * 60, 3) AS bpm, round(snr, 4) AS snr, round(p.f * 60, 9) BETWEEN 45 AND 200 AND snr >= 8 AS ok FROM peaks"),
    "win11_phase": oracle(f"WITH {_PULSE}, c AS (SELECT video_id % 30 AS subject, count(*) AS regions, sqrt(pow(avg(cos(atan2(p.im, p.re))), 2) + pow(avg(sin(atan2(p.im, p.re))), 2)) AS c FROM peaks GROUP BY 1) SELECT subject, regions, round(c, 5) AS coherence, CASE WHEN regions > 1 AND c < 0.5 THEN 20 ELSE 0 END AS weight FROM c"),
    "prv4_strings": "SELECT page_id, least(80, len(list_filter(regexp_extract_all(html, '[ -~]{4,}'), lambda x: regexp_matches(lower(x), 'script|title')))) AS n FROM pages",
    "img4_copy_move": f"""WITH b AS ({BLOCKS}), total AS (SELECT image_id, count(*) AS blocks FROM b GROUP BY image_id),
        k AS (SELECT *, concat_ws(',', floor(mean / 4)::BIGINT, floor(std / 4)::BIGINT, floor(c01 / 4)::BIGINT, floor(c10 / 4)::BIGINT, floor(c11 / 4)::BIGINT) AS key FROM b WHERE std >= 6), kept AS (SELECT * FROM k QUALIFY count(*) OVER (PARTITION BY image_id, key) <= 32),
        p AS (SELECT a.image_id, c.y - a.y AS dy, c.x - a.x AS dx FROM kept a JOIN kept c ON a.image_id = c.image_id AND a.key = c.key WHERE (c.y > a.y OR (c.y = a.y AND c.x > a.x)) AND sqrt((c.y - a.y) * (c.y - a.y) + (c.x - a.x) * (c.x - a.x)) >= 20
          AND abs(a.mean - c.mean) <= 2 AND abs(a.std - c.std) <= 2 AND abs(a.c01 - c.c01) <= 2 AND abs(a.c10 - c.c10) <= 2 AND abs(a.c11 - c.c11) <= 2)
        SELECT image_id, dy, dx, count(*) AS pairs, round(2 * count(*) / max(blocks), 6) AS coverage FROM p JOIN total USING (image_id) GROUP BY image_id, dy, dx HAVING count(*) >= 2 AND 2 * count(*) / max(blocks) < 0.6""",
    "fus9_explanation": oracle(f"WITH {_EXPLAINED} SELECT item_id, array_to_string(list_transform(sorted[1:3], lambda s: s.t), ',') AS features, CASE WHEN score >= 67 AND len(sorted) >= 3 THEN 'high' WHEN score >= 35 AND len(sorted) >= 1 THEN 'medium' ELSE 'low' END AS confidence FROM x"),
    "fus9_forms": oracle(f"""WITH {_EXPLAINED}, y AS (SELECT *, CASE WHEN score >= 67 THEN '{FU.SUMMARIES["high"][0]}' || score || '{FU.SUMMARIES["high"][1]}' || CASE WHEN len(sorted) > 0 THEN '주요 요인: ' || array_to_string(list_transform(sorted[1:3], lambda s: s.t), ', ') || '.' ELSE '' END
          WHEN score >= 35 THEN '{FU.SUMMARIES["medium"][0]}' || score || '{FU.SUMMARIES["medium"][1]}' ELSE '{FU.SUMMARIES["low"][0]}' || score || '{FU.SUMMARIES["low"][1]}' END AS said,
          CASE WHEN score >= 67 THEN '{"|".join(FU.PATHS["high"])}' WHEN score >= 35 THEN '{"|".join(FU.PATHS["medium"])}' ELSE '{"|".join(FU.PATHS["low"])}' END AS path, CASE WHEN item_id % 2 = 0 THEN 2 ELSE 3 END AS limits FROM x)
        SELECT item_id, 'audio' AS form, said AS summary, path, limits FROM y
        UNION ALL SELECT item_id, 'face', said || CASE WHEN item_id % 4 > 0 THEN ' ' || item_id % 4 || '개의 얼굴이 감지되었습니다.' ELSE '' END, path || CASE WHEN item_id % 4 > 0 THEN '|얼굴 조작 유형: ' || CASE WHEN item_id % 3 = 0 THEN 'swap' ELSE 'unknown' END ELSE '' END, limits FROM y
        UNION ALL SELECT item_id, 'video', said || CASE WHEN item_id % 5 > 0 THEN ' ' || item_id % 5 * 30 || '개 프레임 분석 (재생시간: ' || printf('%.1f', duration) || '초).' ELSE '' END, path, limits FROM y"""),
    "prv5_records": f"""WITH d AS ({MARKED}), m AS (SELECT page_id, html, {_first('html', C.MANIFEST)} AS manifest, {_first('html', C.VENDORS.values())} AS v, {_near_tool()} AS tool FROM d),
        r AS (SELECT *, CASE WHEN manifest IS NOT NULL THEN substring(html, greatest(position(manifest IN html) - 200, 1), position(manifest IN html) + 500 - greatest(position(manifest IN html) - 200, 1)) END AS region FROM m),
        s AS (SELECT *, CASE WHEN region IS NOT NULL THEN contains(lower(region), 'signature') OR contains(lower(region), 'signed') END AS signed FROM r)
        SELECT page_id, manifest, signed, nullif(regexp_extract(region, 'http[^\\x00 "''><]{{0,196}}'), '') AS claim_url, tool, CASE {" ".join(f"WHEN v = '{m}' THEN '{n}'" for n, m in C.VENDORS.items())} END AS vendor, CAST(CASE WHEN signed THEN 0.5 WHEN manifest IS NOT NULL THEN 0.3 WHEN tool IS NOT NULL OR v IS NOT NULL THEN 0.4 END AS DOUBLE) AS confidence FROM s""",
}
