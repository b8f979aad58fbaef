"""Rule sets over feature rows: probes of ordered cases as SQL conditions, scores and bands.

A rule set maps a probe to its cases (title, condition, weight); the first case
that holds gives the probe's signal.  Conditions are plain SQL over the feature
columns, so a rule set is data that a caller may replace.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.functions.columns import SIGNALS, band, weight_of

Rules = dict[str, list[tuple[str, str, int]]]

AUDIO: Rules = {
    "pitch": [("stable pitch", "pitch_std < 2.0 AND duration > 5.0 AND NOT (pitch_mean = 0 AND pitch_std = 0)", 25), ("unsteady pitch", "pitch_std > 80.0", 20), ("high steady pitch", "pitch_mean > 400 AND pitch_std < 5", 18)],
    "spectrum": [("smooth spectrum", "bandwidth < 1000 AND centroid > 2000", 22), ("flat spectrum", "flatness > 0.8", 15), ("missing highs", "rolloff < 3000 AND centroid > 1500", 12)],
    "rhythm": [("fast onsets", "onset_rate > 15 AND tempo > 140", 18), ("even rhythm", "tempo > 0 AND onset_rate > 0 AND onset_rate / (greatest(tempo, 0.001) / 60.0) > 0.8 AND onset_rate / (greatest(tempo, 0.001) / 60.0) < 1.2 AND duration > 10", 10)],
    "mfcc": [("stable timbre", "mfcc_std < 1.0 AND duration > 5.0", 20), ("unsteady timbre", "mfcc_std > 15.0", 15)],
    "energy": [("low energy", "rms < 0.001 AND duration > 5", 10), ("steady energy", "zero_crossings < 0.02 AND rms > 0.01", 8)],
    "noise": [("high noise floor", "flatness > 0.6", 12), ("too clean", "flatness < 0.01 AND centroid > 2000", 10)],
    "regularity": [("regular pitch", "duration >= 5.0 AND jitter > 0 AND jitter < 0.004 AND pitch_mean > 0", 12), ("regular loudness", "duration >= 5.0 AND shimmer > 0 AND shimmer < 0.01", 8)],
    "pauses": [("no pauses", "duration >= 3.0 AND pause_ratio < 0.01 AND duration > 8", 14), ("even pauses", "duration >= 3.0 AND pause_ratio > 0.02 AND pause_cv > 0 AND pause_cv < 0.25", 10)],
    "floor": [("stepped noise floor", "duration >= 5.0 AND noise_floor_std > 0.15", 12)],
    "harmonics": [("steady harmonics", "duration >= 3.0 AND pitch_mean > 0 AND harmonic_cv > 0 AND harmonic_cv < 0.15", 12)],
}
SCREEN: Rules = {
    "spectrum": [("even frequencies", "freq_std > 5000 AND edge_density < 0.2", 25), ("low entropy", "hist_entropy < 6.0", 20)],
    "noise": [("low noise", "texture_variance < 500 AND std > 20", 18)],
    "edges": [("edges without contrast", "edge_density > 0.15 AND std < 35", 15)],
    "colour": [("even saturation", "saturation_mean > 100 AND saturation_std < 50", 15)],
    "texture": [("even texture", "texture_mean < 10 AND std > 30", 12)],
}
MOBILE: Rules = {
    "smooth": [("smooth", "edge_density < 0.018 AND entropy < 2.25", 10)],
    "texture": [("dense texture", "edge_density > 0.34 AND entropy > 0.75", 9)],
    "colour": [("even colour", "saturation_mean > 0.42 AND saturation_std < 0.17 AND edge_density < 0.12", 12)],
    "grid": [("repeated grid", "grid_similarity > 0.82 AND width >= 512 AND height >= 512", 11)],
}
SEAM: Rules = {
    "seam": [("hard seam", "seam_ratio > seam_ratio_high", 30), ("feathered seam", "seam_ratio < seam_ratio_low AND inner_var > seam_inner_var_min", 25)],
    "noise": [("smooth face", "noise_ratio < noise_ratio_low", 28), ("noisy face", "noise_ratio > noise_ratio_high", 24)],
    "chroma": [("chin and neck differ", "chroma_delta > chroma_delta_max", 22)],
    "cornea": [("highlights differ", "corneal_asymmetry > corneal_asymmetry_max", 20)],
}
SEAM_CUTOFFS = {"seam_ratio_high": 3.0, "seam_ratio_low": 0.3, "seam_inner_var_min": 50.0, "noise_ratio_low": 0.5, "noise_ratio_high": 2.0, "chroma_delta_max": 12.0, "corneal_asymmetry_max": 4.0}
FACE: Rules = {
    "boundary": [("boundary blending", "boundary_ratio > 0.7", 18)],
    "eyes": [("eye brightness", "abs(left_eye - right_eye) > 40", 15)],
    "hue": [("hue", "least(abs(face_hue - scene_hue), 180.0 - abs(face_hue - scene_hue)) > 15", 12)],
    "light": [("light direction", "scene_strength >= 0.02 AND least(abs(face_angle - scene_angle), 360.0 - abs(face_angle - scene_angle)) >= 60", 14)],
    "sizes": [("face sizes", "faces > 2 AND (max_size - min_size) / greatest(1, max_size) < 0.1", 8)],
}
INPAINT: Rules = {
    "blocks": [("even blocks", "mean_variance < 10 AND std_variance < 5", 20)],
    "noise": [("uneven noise", "regions >= 4 AND noise_mean > 0 AND noise_std / greatest(noise_mean, 0.000001) > 0.5", 18)],
    "orientation": [("one direction", "lines > 10 AND top_bin / greatest(lines, 1) > 0.6", 15)],
    "gradient": [("smooth gradient", "gradient_std < 1.0 AND gradient_mean > 5", 12)],
    "patches": [("flat patches", "flat_patches > 5", 15)],
}
EXPERTS: Rules = {
    "baseline": [("few colours", "unique_ratio < 0.08 AND stdev > 12", 62), ("quantised", "quantized > 0.72 AND stdev > 18", 56), ("oversmooth", "edge_mean < 1.8 AND stdev > 10", 48), ("sharp", "edge_mean > 58 AND stdev > 35", 46)],
    "frequency": [("spikes", "spike_count > 0 AND spike >= 8.0", 72), ("weak spikes", "spike >= 5.0", 48), ("interpolated", "npr > 0.55", 55), ("no highs", "dct_high < 0.02 AND dct_uniformity < 0.01", 45)],
    "reconstruction": [("low residual", "residual_mean < 1.2 AND stdev > 12", 58), ("even residual", "residual_mean > 36 AND residual_std < 12", 54), ("high residual", "residual_mean > 48 OR did_gap > 18", 50)],
    "fractal": [("noise", "correlation < 0.18 AND fractal > 1.72 AND edge_mean > 22", 68), ("rough", "correlation < 0.28 AND edge_mean / greatest(1.0, stdev) > 0.9", 54), ("low dimension", "fractal < 1.08 AND stdev > 18", 46)],
    "alpha": [("tile edges", "high_ratio >= 0.04 AND high_ratio <= 0.22 AND boundary_jump > 1.65", 66), ("edges", "boundary_jump > 1.35 AND tile_std > 5", 49)],
    "error_level": [("local blocks", "outlier_ratio >= 0.02 AND outlier_ratio <= 0.30 AND localized AND mad > 0", 62), ("blocks", "outlier_ratio >= 0.01 AND outlier_ratio <= 0.40 AND mad > 0", 41)],
    "periodicity": [("period", "period_ratio < 0.44 AND shift_base > 8", 72), ("weak period", "period_ratio < 0.58 AND shift_base > 12", 55)],
    "localization": [("tiles", "tiles >= 12 AND anomaly_ratio > 3.2 AND tile_std > 7", 67), ("weak tiles", "tiles >= 12 AND anomaly_ratio > 2.35 AND tile_std > 5", 52)],
}
FLOORS = {"frequency": [("djc >= 0.5", 50), ("ela_ratio >= 3.0", 45), ("copy_move >= 0.12", 55)]}
FAMILIES = {"baseline": "pixel", "frequency": "spectral", "reconstruction": "reconstruction", "fractal": "statistical", "alpha": "compositing", "error_level": "localization", "periodicity": "spectral", "localization": "localization"}
CONTAINER: Rules = {
    "fps": [("frame rate", "fps > 0 AND least(abs(fps - 23.976), abs(fps - 24), abs(fps - 25), abs(fps - 29.97), abs(fps - 30), abs(fps - 50), abs(fps - 59.94), abs(fps - 60)) > 1.0", 8)],
    "size": [("resolution", "width > 0 AND height > 0 AND " + " AND ".join(f"abs(width - {w}) >= 10" for w in (320, 480, 640, 720, 1280, 1920, 2560, 3840)) + " AND " + " AND ".join(f"abs(height - {h}) >= 10" for h in (240, 360, 480, 720, 1080, 1440, 2160)), 5)],
}
FRAMES: Rules = {
    "brightness": [("stable brightness", "n > 20 AND brightness_std < 2.0", 18), ("single cut", "n >= 5 AND brightness_step > 50 AND brightness_cuts = 1", 15)],
    "contrast": [("stable contrast", "n > 20 AND contrast_std < 1.0", 15)],
    "blur": [("even blur", "n > 20 AND blur_std < 10 AND blur_mean > 100", 12), ("blur jump", "n >= 5 AND blur_step > 500", 10)],
    "edges": [("stable edges", "n > 20 AND edges_std < 0.01", 12)],
    "flicker": [("flicker", "n >= 8 AND blur_mean >= 20 AND turns >= 4 AND oscillation >= 0.60 AND amplitude >= 0.12 AND jitter < amplitude * 0.6", 32), ("slight flicker", "n >= 8 AND blur_mean >= 20 AND turns >= 4 AND oscillation >= 0.50 AND amplitude >= 0.08 AND jitter < amplitude * 0.6", 18)],
}


def probe_weight(cases: list[tuple[str, str, int]], default: int | None = 0) -> str:
    """SQL of a probe's weight."""
    return "CASE " + " ".join(f"WHEN {condition} THEN {weight}" for _, condition, weight in cases) + (f" ELSE {default} END" if default is not None else " END")


def apply(rows: DataFrame, rules: Rules, high: int = 67, medium: int = 35) -> DataFrame:
    """Adds signals, score (100 at most) and band; a condition over nulls does not hold."""
    made = []
    for cases in rules.values():
        case = "CASE " + " ".join("WHEN {} THEN named_struct('title', '{}', 'detail', '', 'weight', {})".format(c, t.replace("'", "\\'"), w) for t, c, w in cases) + " END"
        made.append(F.expr(case))
    d = rows.withColumn("signals", F.array_compact(F.array(*made)).cast(SIGNALS))
    return d.withColumn("score", F.least(F.lit(100), weight_of(F.col("signals")))).withColumn("band", band(F.col("score"), high, medium))


def wide_scores(rows: DataFrame, rules: Rules, floors=None) -> DataFrame:
    """Adds score_<probe> for every probe, raised to the floors whose condition holds."""
    scores = {}
    for name, cases in rules.items():
        score = F.expr(probe_weight(cases))
        for condition, least in (floors or {}).get(name, []):
            score = F.when(F.expr(condition), F.greatest(score, F.lit(least))).otherwise(score)
        scores[f"score_{name}"] = score
    return rows.withColumns(scores)


def long_scores(rows: DataFrame, rules: Rules, id_col: str, floors=None) -> DataFrame:
    """Rows (id, name, family, score): every expert's score of every feature row."""
    d = wide_scores(rows, rules, floors)
    out = [F.struct(F.lit(name).alias("name"), F.lit(FAMILIES.get(name, "")).alias("family"), F.col(f"score_{name}").alias("score")) for name in rules]
    return d.select(id_col, F.explode(F.array(*out)).alias("e")).select(id_col, "e.*")
