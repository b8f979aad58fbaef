import itertools
import math
import random

import pytest

from sievewright.operators import calibrate, feedback, metrics

def frame(spark, groups):
    rows = [(g, float(s), y) for g, pairs in enumerate(groups) for s, y in pairs]
    return spark.createDataFrame(rows, "g int, score double, label int")


def crossing(pairs):
    """Where the false negative and false positive rates of the ROC polyline meet, by bisection along it."""
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    points = [(0.0, 1.0)] + [(sum(s >= t for s in neg) / len(neg), sum(s < t for s in pos) / len(pos)) for t in sorted({s for s, _ in pairs}, reverse=True)]
    for (a, b), (c, d) in itertools.pairwise(points):
        if a <= b and c >= d:
            low, high = 0.0, 1.0
            for _ in range(60):
                mid = (low + high) / 2
                low, high = (mid, high) if a + mid * (c - a) < b + mid * (d - b) else (low, mid)
            return a + high * (c - a)


def test_equal_error_rate_of_random_scores(spark):
    rng = random.Random(4)
    groups = [[(rng.randint(0, 6) + 2 * y, y) for y in (0, 1, *(rng.randint(0, 1) for _ in range(rng.randint(0, 30))))] for _ in range(40)]
    got = {r.g: r.eer for r in metrics.interpolated_eer(frame(spark, groups), ["g"]).collect()}
    for g, pairs in enumerate(groups):
        assert got[g] == pytest.approx(crossing(pairs), abs=1e-6), pairs


def test_every_small_multiset(spark):
    groups = [list(c) for c in itertools.combinations_with_replacement(itertools.product((0, 0.5, 1), (0, 1)), 4)]
    got = {r.g: r for r in metrics.auroc(frame(spark, groups), ["g"]).collect()}
    for g, pairs in enumerate(groups):
        pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
        if pos and neg:
            assert got[g].auroc == pytest.approx(sum((p > q) + (p == q) / 2 for p in pos for q in neg) / len(pos) / len(neg)) and got[g].reason is None
        else:
            assert got[g].auroc is None and got[g].reason == ("no_positive_samples" if not pos else "no_negative_samples")


def test_undefined_and_invalid(spark):
    empty = frame(spark, [])
    (row,) = metrics.auroc(empty).collect()
    assert (row.n, row.auroc, row.reason) == (0, None, "empty_input")
    (row,) = metrics.calibrated_threshold(empty).collect()
    assert (row.threshold, row.samples) == (67, 0)
    for bad in ([(0.5, 2)], [(float("nan"), 1)], [(float("inf"), 0)]):
        with pytest.raises(Exception, match="labels must|scores must"):
            metrics.validated(frame(spark, [bad])).collect()


def test_thresholds(spark):
    df = frame(spark, [[(0, 0), (0.5, 0), (1, 1)], [(1, 0), (1, 1)]])
    for target, want in ((0.49, 1.0), (0.5, 0.5), (1.0, 0.0)):
        assert {r.g: r.threshold for r in metrics.threshold_at_fpr(df, target, ["g"]).collect()}[0] == want
    assert {r.g: r.threshold for r in metrics.threshold_at_fpr(df, 0.0, ["g"]).collect()}[1] == math.nextafter(1.0, math.inf)
    (row,) = metrics.calibrated_threshold(frame(spark, [[(100, 0)]])).collect()
    assert (row.threshold, row.target_fpr_met) == (100, 0)


def test_next_above(spark):
    xs = [0.0, 1.0, -1.0, 67.0, 0.1, -0.1, 1e300, -2.0, 3.5e-7]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(metrics.next_above(__import__("pyspark").sql.functions.col("x"))).collect()
    assert [r[0] for r in got] == [math.nextafter(x, math.inf) for x in xs]


def test_knots_ties_and_equal_means(spark):
    rows = [("a", s, y) for s, ys in ((10, (0, 0, 1)), (20, (0, 1, 1)), (30, (0, 0, 1)), (40, (1, 1, 1)), (50, (1, 1, 1)), (5, (0,) * 9)) for y in ys] + [("few", 1, 1)]
    df = spark.createDataFrame(rows, "g string, score int, label int")
    knots = calibrate.isotonic_knots(df, ["g"]).orderBy("knot").collect()
    assert [(k.g, k.knot, round(k.value, 6)) for k in knots] == [("a", 5, 0.0), ("a", 10, round(1 / 3, 6)), ("a", 30, 0.5), ("a", 40, 1.0), ("a", 50, 1.0)]
    points = spark.createDataFrame([("a", 0), ("a", 20), ("a", 35), ("a", 99), ("few", 3)], "g string, score int")
    got = {(r.g, r.score): r.calibrated for r in calibrate.apply_knots(points, calibrate.isotonic_knots(df, ["g"]), ["g"]).collect()}
    assert got == {("a", 0): 0.0, ("a", 20): 0.4167, ("a", 35): 0.75, ("a", 99): 1.0, ("few", 3): None}


def test_weights_sum_to_one(spark):
    base = {"metadata": 0.35, "pixel": 0.25, "external_model": 0.3, "source": 0.1}
    for aurocs in ((0.9, 0.61, 0.7, 0.5), (0.4, 0.5, None, 0.2), (2 / 3, 2 / 3, 2 / 3, 0.5)):
        df = spark.createDataFrame(list(zip(base, aurocs)), "component string, auroc double")
        assert sum(round(r.weight * 10000) for r in feedback.suggest_weights(df, base).collect()) == 10000


def test_knots_do_not_depend_on_the_cuts(spark):
    import random

    from sievewright.operators import calibrate

    rng = random.Random(4)
    rows = [(g, s, int(rng.random() < (s / 400 if g == "rising" else 1 - s / 400 if g == "falling" else (s % 100) / 100 if g == "teeth" else 0.5))) for g in ("rising", "falling", "teeth", None) for s in [rng.randrange(400) for _ in range(1500)]]
    rows += [("rising", s, 0) for s in range(-40, 0)] + [("rising", s, 1) for s in range(400, 440)] + [("few", 1, 1)]
    df = spark.createDataFrame(rows, "g string, score int, label int")
    want = {}
    for g in ("rising", "falling", "teeth", None):
        at = {}
        for own, s, y in rows:
            if own == g:
                p, n = at.get(s, (0, 0))
                at[s] = (p + y, n + 1)
        want |= {(g, top): p / n for p, n, top in calibrate.pooled([(p, n, s) for s, (p, n) in sorted(at.items())])}
    for ranges in (1, 3, 7, 40):
        got = {(r.g, r.knot): r.value for r in calibrate.isotonic_knots(df, ["g"], ranges=ranges).collect()}
        assert got == want


def test_binary_search_in_the_row(spark):
    from pyspark.sql import functions as F

    from sievewright.operators import calibrate

    for n in (0, 1, 2, 3, 7, 8, 9, 33):
        keys = [3.0 * k for k in range(n)]
        rows = [(keys, x) for x in [-1.0, *[k + d for k in keys for d in (-0.5, 0.0, 0.5)], 1e9]]
        got = spark.createDataFrame(rows, "k array<double>, x double").select("x", calibrate.first_at_least(F.col("k"), F.col("x")).alias("i")).collect()
        assert all(r.i == sum(k < r.x for k in keys) for r in got)


def test_running_sums_over_ranges(spark):
    import random

    from sievewright.operators import ordered

    rng = random.Random(9)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(50), i) for i in range(700)]
    df = spark.createDataFrame(rows, "g string, x int, i int")
    for ranges in (1, 5, 30):
        got = ordered.ranked(df, ["x", "i"], ["g"], ranges=ranges).collect()
        for g in ("a", "b", None):
            mine = sorted((x, i) for h, x, i in rows if h == g)
            assert sorted((r.place, r.i) for r in got if r.g == g) == [(k + 1, i) for k, (_, i) in enumerate(mine)]
    assert ordered.ranked(df.limit(0), ["x"]).collect() == []


def test_tree_of_digests(spark):
    import hashlib

    from sievewright.operators import records

    rows = [("s" if i % 5 else "t", f"p/{i:05d}", "ai" if i % 3 else None, f"{i:064x}") for i in range(1100)]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()

    def root(own):
        level = [sha("|".join((p, lab or "", h))) for p, lab, h in sorted((p, lab or "", h) for _, p, lab, h in own)]
        while True:
            level = [sha("".join(level[k : k + 256])) for k in range(0, len(level), 256)]
            if len(level) == 1:
                return level[0]

    def tree(own, ranges):
        df = spark.createDataFrame(own, "source string, path string, label string, content_hash string")
        return {r.source: (r.n, r.root) for r in records.tree_root(df, ["source"], "path", "label", "content_hash", ranges=ranges).collect()}

    want = {s: (len(own), root(own)) for s in "st" for own in [[r for r in rows if r[0] == s]]}
    assert tree(rows, 1) == tree(list(reversed(rows)), 6) == want
    swapped = [("s", "p/00001", "ai", rows[2][3]), ("s", "p/00002", "ai", rows[1][3])]
    for change in ([*rows[:1], *swapped, *rows[3:]], [*rows[:-1], (*rows[-1][:2], "human", rows[-1][3])], [(rows[0][0], "p/x", *rows[0][2:]), *rows[1:]]):
        assert tree(change, 4) != want
    df = spark.createDataFrame(rows, "source string, path string, label string, content_hash string")
    from pyspark.sql import functions as F

    levels = records.tree_levels(df, ["source"], "path", "label", "content_hash", ranges=4)
    leaf = sha("|".join((rows[7][1], rows[7][2] or "", rows[7][3])))
    proof = records.tree_proof(levels, leaf, F.col("source") == "s")
    assert records.tree_verify(proof, leaf, want["s"][1]) and len(proof) == 2
    assert not records.tree_verify(proof, sha("other"), want["s"][1]) and records.tree_proof(levels, sha("other")) == []
