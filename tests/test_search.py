"""Searches of vectors against brute force: odd vectors, chunks of any size, no pair as a row."""

import math
import random

from pyspark.sql import functions as F

from sievewright.operators import images, text
from sievewright.operators.records import search, vector_search
from sievewright.plans import signal_queries, text_queries

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().toString()


def rows(d):
    return sorted(map(tuple, d.collect()))


def test_speakers_equal_the_pairwise_score(spark):
    rng = random.Random(3)
    made = [(i, "hot" if i % 4 else rng.choice("ab"), [float(rng.choice((-1, 0, 1))) for _ in range(16)]) for i in range(120)]  # many halves and ties
    made += [(i + 200, "hot", list(made[i][2])) for i in range(1, 60)]
    odd = [(300, "hot", None), (301, "hot", []), (302, "hot", [1.0]), (320, "hot", [1.0, None]), (340, "hot", [0.0] * 16), (360, None, [1.0] * 16), (380, "alone", [1.0] * 16), (20, "hot", [1.0] * 16)]
    df = spark.createDataFrame(made + odd, "k long, b string, v array<float>")
    asked = df.where("k % 20 = 0")
    want = search(df, asked, "k", "v", ["b"], lambda a, b: images.speaker_score(a, b)[0], lambda s: s >= 67)
    for chunk in (7, 1000):
        assert rows(vector_search(df, asked, "k", "v", ["b"], images.speaker_scores, lambda s: s >= 67, chunk)) == rows(want)


def test_a_vector_with_nan_fits_nobody(spark):
    df = spark.createDataFrame([(0, "a", [1.0, 2.0]), (1, "a", [math.nan, 1.0]), (2, "a", [2.0, 4.0]), (20, "a", [math.inf, 1.0])], "k long, b string, v array<double>")
    got = rows(vector_search(df, df.where("k % 20 = 0"), "k", "v", ["b"], images.speaker_scores, lambda s: s >= 67))
    assert got == [(0, 3, 1, 2, 100.0), (20, 3, 0, 0, 0.0)]


def test_styles_equal_the_pairwise_distance(spark):
    rng = random.Random(4)
    made = [(i, rng.choice("ab"), [rng.choice((0.0, 0.25, rng.random())) for _ in range(9)]) for i in range(300)]
    df = spark.createDataFrame(made + [(400, "a", made[3][2])], "k long, b string, v array<double>")
    asked = df.where("k % 20 = 0")
    pair = lambda a, b: -F.round(text.style_distance(a, b), 6)
    want = search(df, asked, "k", "v", ["b"], pair, lambda s: text.same_author(-s)[0] >= 67)
    got = vector_search(df, asked, "k", "v", ["b"], lambda a, b: -text.style_distances(a, b), lambda s: text.same_authors(-s), 50)
    assert rows(got) == rows(want)


def test_txt28_makes_no_row_of_a_pair(spark):
    assert "Join" not in plan(text_queries.txt28_stylometry(spark, SF))


def test_med3_makes_no_row_of_a_pair(spark):
    assert "Join" not in plan(signal_queries.med3_speakers(spark, SF))
