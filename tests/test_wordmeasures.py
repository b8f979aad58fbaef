"""Measures over bytes against Spark's expressions, on odd texts."""

import random

from pyspark.sql import functions as F

from sievewright.functions import lexicons as L
from sievewright.functions.columns import WORD, alternation, deviation, hangul_share, matches, mean
from sievewright.operators import text as T
from sievewright.operators import wordmeasures
from sievewright.operators.wordstats import FIELDS, word_statistics

PIECES = ["however", "However,", "In addition", "또한 ", "하지만", "학교에서", "친구를", "할 수 있습니다", "의", "ㄱ", "ᄀ", "é", "İn", "K", "ß", "Σ", "𝒜", "٣", "½", "_", "'", "don't", "i'm", "my", "delve", "…", "—", "·", ".", "!", "?", "。", "！", "？", "\n", "\r", "\t", " ", "  ", "\x0b", " ", " ", "-", '"', "12", "x", "we", "日本", "\U0001f600", "é"]


def texts():
    rng = random.Random(7)
    out = [None, "", " ", ".", "'", "학교에서", "a" * 9, "...\n\n", "however is it so. Thus it is.", "𝒜" * 8 + "."]
    return out + ["".join(rng.choice(PIECES) + rng.choice(("", " ", " ")) for _ in range(rng.randrange(1, 120))) for _ in range(400)]


def test_measures_equal_the_expressions(spark, monkeypatch):
    df = spark.createDataFrame(list(enumerate(texts())), "i int, text string").repartition(3)
    trimmed, low = F.col("trimmed"), F.col("lower")
    starter = lambda x, known: F.lower(x).rlike(f"^[\"'\\-–— ]*({alternation(known)})")
    for jamo, least in ((False, 8), (True, 5)):
        d = T.prepare_advanced(df).withColumn("hangul", hangul_share(trimmed, jamo)).withColumn("s", T.sentences(trimmed, least))
        if not jamo:
            d = d.withColumn("words", T.words(low))
        d = d.withColumn("plain", F.concat("words", F.flatten(F.transform("words", lambda x: F.split(x, "'"))))).withColumn("w", word_statistics("words"))
        d = d.withColumn("lengths", F.transform("s", lambda x: F.greatest(F.lit(1), matches(x, WORD))))
        ko = F.col("hangul") > 0.3
        want = {
            "n_words": F.size("words"), "n_sentences": F.size("s"), "sentence_words": F.aggregate("lengths", F.lit(0), lambda a, v: a + v), "sentence_squares": F.aggregate("lengths", F.lit(0), lambda a, v: a + v * v),
            "typographic": matches(trimmed, L.TYPOGRAPHIC), "vocabulary": F.size(F.filter("words", lambda x: x.isin(*L.VOCABULARY_EN))), "anchors": F.size(F.array_intersect("plain", F.array(*map(F.lit, L.PERSONAL_ANCHORS)))),
            "starters": F.when(ko, F.size(F.filter("s", lambda x: starter(x, L.STARTERS_KO)))).otherwise(F.size(F.filter("s", lambda x: starter(x, L.STARTERS_EN)))), "endings": F.size(F.filter("s", lambda x: x.rlike(alternation(L.KO_ENDINGS)))),
        } | {f: F.col(f"w.{f}") for f in FIELDS}
        measure = wordmeasures.measured(spark, {"vocabulary": L.VOCABULARY_EN}, {"anchors": L.PERSONAL_ANCHORS}, jamo, least, L.KO_ENDINGS)
        d = d.withColumn("_m", measure(trimmed, low))
        rows = d.select("i", "trimmed", "hangul", T.measured_hangul(jamo).alias("share"), "_m", F.struct(*[c.cast("double").alias(n) for n, c in want.items()]).alias("want")).collect()
        assert len(rows) == len(texts())
        for r in rows:
            differ = {n: (r._m[n], r.want[n]) for n in want if round(float(r._m[n]), 9) != round(r.want[n], 9)}
            assert r.hangul == r.share and not differ, (ascii(r.trimmed), differ)


def test_lengths_of_sentences(spark):
    df = spark.createDataFrame(list(enumerate(texts())), "i int, text string")
    d = T.features(df).withColumn("lengths", F.transform("sentences", lambda x: F.greatest(F.lit(1), matches(x, WORD))))
    for r in d.select("mean_length", "length_cv", mean(F.col("lengths")).alias("m"), (deviation(F.col("lengths")) / F.greatest(F.lit(1.0), mean(F.col("lengths")))).alias("cv")).collect():
        assert (r.mean_length, r.length_cv) == (r.m, r.cv)


def test_a_scan_makes_no_array_of_words(spark):
    df = spark.createDataFrame([(1, "a text")], "i int, text string")
    plan = T.scan(df).select("i", "score", "signals")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan.lower()


def test_korean_rules_count_no_grams(spark):
    df = spark.createDataFrame([(1, "a text")], "i int, text string")
    measures = ("translationese", "endings", "stock", "n_words", "n_sentences", "hangul")
    plan = T.advanced_features(df).select("i", *measures)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_count" in plan.lower() or "regexp_extract_all" in plan.lower()  # one pattern is left
    assert "bigram_entropy" not in plan and plan.count("measure(") <= 2 and "split(" not in plan
