import math
import random

import pytest
from pyspark.sql import functions as F

from sievewright.operators import evidence, fusion, images, series, text


def test_text_cases(spark):
    uniform = ("one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen. " * 6)
    cases = [
        ("identity", "I answer this as an AI language model of some kind.", 35, "medium"),
        ("phrase", "In conclusion, this text is short and says little.", 0, "low"),
        ("empty", "", 0, "unknown"), ("blank", "   ", 0, "unknown"), ("null", None, 0, "unknown"), ("short", "hello", 0, "unknown"),
        ("list", "\n".join(f"- item {i}" for i in range(6)), 18, "low"),
    ]
    df = spark.createDataFrame([(n, t) for n, t, *_ in cases] + [("uniform", uniform)], "item_id string, text string")
    got = {r.item_id: r for r in text.scan(df).collect()}
    for n, _, score, band in cases:
        assert (got[n].score, got[n].band) == (score, band), n
    assert {s.title: s.weight for s in got["uniform"].signals}["문장 길이 균일성"] == 15
    assert got["list"].signals[0].title == "과도하게 균일한 목록 구조"


def test_mtld_equals_a_loop(spark):
    rng = random.Random(0)
    words = [rng.choice("a b c d e f g h".split()) for _ in range(300)]
    factors, n, seen = 0.0, 0, set()
    for w in words:
        seen.add(w)
        n += 1
        if len(seen) / n <= 0.72:
            factors, n, seen = factors + 1, 0, set()
    factors += (1 - len(seen) / n) / (1 - 0.72) if n else 0
    (row,) = spark.createDataFrame([(words,)], "w array<string>").select(text.mtld(F.col("w")).alias("m")).collect()
    assert row.m == pytest.approx(len(words) / factors)


def test_planted_lag_is_found(spark):
    rng = random.Random(1)
    motion = [rng.random() for _ in range(200)]
    rows = [("late", t, motion[t - 5] if t >= 5 else 0.5, motion[t]) for t in range(200)] + [("flat", t, 1.0, motion[t]) for t in range(200)] + [("tiny", t, motion[t], motion[t]) for t in range(10)]
    df = spark.createDataFrame(rows, "id string, t int, a double, b double")
    got = {r.id: r for r in series.lag_correlation(df, "id", "t", "a", "b", 10.0, 1.0).collect()}
    assert set(got) == {"late"} and got["late"].offset_seconds == 0.5 and got["late"].correlation > 0.99


def test_pulse_and_phase(spark):
    rng = random.Random(2)
    rows = []
    for roi, phase in (("a", 0.0), ("b", 0.1), ("c", 3.1)):
        rows += [(roi, t, math.sin(2 * math.pi * 1.2 * t / 30 + phase) + rng.gauss(0, 0.05)) for t in range(300)]
    rows += [("noise", t, rng.gauss(0, 1)) for t in range(300)]
    peaks = series.pulse_spectrum(spark.createDataFrame(rows, "roi string, t int, x double"), "roi", "t", "x", 30.0)
    got = {r.roi: r for r in peaks.collect()}
    assert got["a"].bpm == pytest.approx(72) and got["a"].ok and not got["noise"].ok
    together = series.phase_coherence(peaks.where("roi IN ('a', 'b')").withColumn("s", F.lit(1)), "s").first()
    apart = series.phase_coherence(peaks.where("roi IN ('a', 'c')").withColumn("s", F.lit(1)), "s").first()
    assert together.coherence > 0.9 and together.weight == 0 and apart.coherence < 0.5 and apart.weight == 20


def test_cloned_blocks_are_found(spark):
    rng = random.Random(3)
    rows = [("x", y, x, *[rng.uniform(20, 200) for _ in range(5)]) for y in range(0, 160, 8) for x in range(0, 160, 8)]
    cloned = [("x", r[1] + 400, r[2] + 32, *r[3:]) for r in rows[:40]]
    flat = [("x", 900, 8 * i, 5.0, 1.0, 0.0, 0.0, 0.0) for i in range(200)]
    df = spark.createDataFrame(rows + cloned + flat, "image_id string, y int, x int, mean double, std double, c01 double, c10 double, c11 double")
    (row,) = images.copied_blocks(df).collect()
    assert (row.dy, row.dx, row.pairs) == (400, 32, 40)


def test_fusion_is_idempotent_and_rounds_to_even(spark):
    df = spark.createDataFrame([(1, [("반복 어구", "", 30), ("픽셀 앙상블 의심", "", 47)], 50, 10, "unknown")], "item_id int, signals array<struct<title:string,detail:string,weight:int>>, pixel_score int, model_score int, source_confidence string")
    once = fusion.apply_fusion(df).drop("_").collect()
    twice = fusion.apply_fusion(fusion.apply_fusion(df)).collect()
    assert once == twice and once[0].score == 26


def test_search_equals_brute_force(spark):
    from sievewright.operators.records import search

    rng = random.Random(5)
    rows = [(i, "hot" if i % 3 else rng.choice("ab"), float(rng.randint(0, 30))) for i in range(200)] + [(900, None, 1.0), (920, "alone", 1.0)]
    df = spark.createDataFrame(rows, "k long, b string, v double")
    score = lambda x, y: -F.abs(x - y)
    got = {r.k: tuple(r)[1:] for r in search(df, df.where("k % 20 = 0"), "k", "v", ["b"], score, lambda s: s >= -1, salts=3).collect()}
    want = {}
    for k, b, v in rows:
        others = [(-abs(v - w), -j) for j, c, w in rows if c == b and b is not None and j != k]
        if k % 20 == 0 and others:
            best = max(others)
            want[k] = (len(others), sum(s >= -1 for s, _ in others), -best[1], best[0])
    assert got == want


def test_alerts_of_long_streams(spark):
    import datetime

    from sievewright.streaming import live

    start = datetime.datetime(2024, 1, 1)
    rng = random.Random(6)
    rows = [(s, s * 10000 + i, start + datetime.timedelta(seconds=i), rng.randint(60, 100) if s else 10) for s in range(4) for i in range(500)]
    got = {r.stream_id: (r.alerts, r.last) for r in live.alerts_batch(spark.createDataFrame(rows, "stream_id long, event_id long, ts timestamp, score int")).collect()}
    for s in range(4):
        mine, ids, last = [r for r in rows if r[0] == s], [], None
        for i, r in enumerate(mine):
            window = [x[3] for x in mine[max(0, i - 29) : i + 1]]
            if sum(window) / len(window) >= 67 and (last is None or (r[2] - last).total_seconds() > 5):
                ids.append(r[1])
                last = r[2]
        assert got.get(s) == ((len(ids), ",".join(map(str, ids[-10:]))) if ids else None)


def test_markers_overlap_and_bounds(spark):
    from sievewright.operators.records import marker_hits

    lexicon = spark.createDataFrame([("a", "gpt"), ("a", "chat gpt"), ("b", "c++"), ("k", "생성"), ("n", "")], "tool string, marker string")
    texts = [(1, "Chat GPT x"), (2, "egpt"), (3, "c++, gpt."), (4, "그림생성기"), (5, None), (6, "")]
    got = sorted(tuple(r) for r in marker_hits(spark.createDataFrame(texts, "id int, t string"), lexicon, "id", "t").collect())
    assert got == [(1, "a", "chat gpt"), (1, "a", "gpt"), (3, "a", "gpt"), (3, "b", "c++"), (4, "k", "생성")]
    assert marker_hits(spark.createDataFrame(texts, "id int, t string"), lexicon.limit(0), "id", "t").collect() == []


def test_signatures(spark):
    import hashlib
    import hmac

    df = spark.createDataFrame([("ä", 1)], "b string, a int")
    (row,) = df.select(evidence.canonical(["b", "a"]).alias("j"), evidence.hmac_sha256("k", evidence.canonical(["b", "a"])).alias("h")).collect()
    assert row.j == '{"a":1,"b":"ä"}' and row.h == hmac.new(b"k", row.j.encode(), hashlib.sha256).hexdigest()


def test_chains_with_rejects(spark):
    lines = ['{"file_hash": "x", "path": "p", "file_size": 3, "parameters": {"a": "1"}}', "not json", '{"file_hash": "x"}', '{"path": "q"}']
    good, bad = evidence.load_chains(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert [r.path for r in good.collect()] == ["p"] and sorted(r.why for r in bad.collect()) == ["no file_hash", "no path", "not JSON"]


def test_lags_by_a_window_equal_brute_force(spark):
    """Gaps, repeated and unknown steps; pairs come from a window, no join writes them."""
    from sievewright.operators.series import lag_correlation

    rng = random.Random(8)
    rows = []
    for s in range(4):
        steps = sorted(rng.sample(range(90), 60)) + [17, 17, None]
        rows += [(s, t, rng.random(), rng.random()) for t in steps]
    d = lag_correlation(spark.createDataFrame(rows, "s int, t long, a double, b double"), "s", "t", "a", "b", 8.0, 1.0)
    assert "Join" not in d._jdf.queryExecution().toString()
    got = {r.s: (r.n, r.offset_seconds, round(r.correlation, 9)) for r in d.collect()}
    for s in range(4):
        own = [r for r in rows if r[0] == s]
        ma, mb = (sum(r[i] for r in own) / len(own) for i in (2, 3))
        best = (0.0, 0)
        for lag in range(-8, 9):
            pairs = [(x[2] - ma, y[3] - mb) for x in own for y in own if None not in (x[1], y[1]) and x[1] == y[1] + lag]
            r = sum(x * y for x, y in pairs) / (sum(x * x for x, _ in pairs) ** 0.5 * sum(y * y for _, y in pairs) ** 0.5)
            best = max(best, (round(r, 12), -lag)) if len(pairs) >= 16 and r > 0 else best
        assert got[s] == (len(own), -best[1] / 8.0, round(best[0], 9))
