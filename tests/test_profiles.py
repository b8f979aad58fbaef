"""Rules as data, review sheets, explanations and provenance records on planted rows."""

import pytest
from pyspark.sql import functions as F

from sievewright.operators import fusion, profiles, provenance
from sievewright.sources import readers, sinks

RULES = "profile string, version string, kind string, component string, key string, value double"


def rules(spark, *rows):
    return spark.createDataFrame(list(rows), RULES)


def test_two_profiles_give_two_scans(spark):
    table = rules(
        spark,
        ("a", "v1", "term", "x", "Foo", 30.0),
        ("a", "v1", "term", "x", "bar", -5.0),
        ("a", "v1", "term", "y", "foo", 50.0),
        ("a", "v1", "cap", "x", None, 40.0),
        ("a", "v1", "fusion", "x", None, 1.0),
        ("a", "v1", "fusion", "y", None, 3.0),
        ("a", "v1", "threshold", None, "high", 50.0),
        ("b", "v1", "term", "x", "foo", 10.0),
        ("b", "v1", "threshold", None, "medium", 10.0),
        ("c", "v1", "threshold", None, "high", 50.0),
    )
    texts = [None, "", "FOO foo", "bar bar foo", "foofoo foo foo", "none"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("profile", F.lit("clash"))
    got = {(r.doc_id, r.profile): (r.components, r.score, r.band) for r in profiles.scan(docs, table).collect()}
    for i, t in enumerate(texts):
        low = (t or "").lower()
        foo, bar = low.count("foo"), low.count("bar")
        x, y = max(0, min(40, 30 * foo - 5 * bar)), min(100, 50 * foo)
        a = round((x + 3 * y) / 4)
        b = min(100, 10 * foo)
        none = "unknown" if foo == 0 and x == 0 else "low"
        assert got[i, "a"] == ({"x": x, "y": y}, a, "high" if a >= 50 else "medium" if a >= 35 else none)
        assert got[i, "b"] == ({"x": b}, b, "high" if b >= 67 else "medium" if b >= 10 else none)
    assert {p for _, p in got} == {"a", "b"}  # a profile without terms has no rows
    assert profiles.scan(docs, rules(spark).limit(0)).collect() == []


def test_every_reject_has_its_reason(spark):
    nan = float("nan")
    table = rules(
        spark,
        ("", "v1", "term", "x", "k", 1.0), ("p", "v9", "term", "x", "k", 1.0), ("p", None, "term", "x", "k2", 1.0), ("p", "v1", "regex", "x", "k", 1.0), ("p", "v1", "term", "x", "k3", nan), ("p", "v1", "term", "x", "k4", None),
        ("p", "v1", "term", " ", "k5", 1.0), ("p", "v1", "term", "x", "  ", 1.0), ("p", "v1", "fusion", "x", None, -1.0), ("p", "v1", "threshold", None, "top", 1.0), ("p", "v1", "term", "x", "twice", 1.0), ("p", "v1", "term", "x", "twice", 2.0),
        ("p", "v1", "threshold", None, "high", 20.0), ("p", "v1", "threshold", None, "medium", 30.0), ("p", "v1", "cap", "none", None, 5.0), ("p", "v1", "term", "x", "good", 1.0),
    )
    got = sorted(r.why for r in profiles.rejected(table).collect())
    assert got == sorted(["no profile", "version", "version", "kind", "no number", "no number", "no component", "no term", "negative", "threshold", "repeated", "repeated", "order", "order", "no terms"])
    (p,) = profiles.compiled(table)
    assert p.terms == {"x": {"good": 1.0}} and p.thresholds == profiles.THRESHOLDS and not p.caps and not p.weights


def test_review_sheet_has_its_columns(spark, tmp_path):
    items = spark.sql("""SELECT 'a' AS path, 'image' AS kind, 'analyzed' AS status, 70 AS score, 'high' AS band, array(named_struct('title', 'first', 'detail', '', 'weight', 1)) AS signals,
        named_struct('available', true, 'score', 5, 'confidence', 'low', 'model', 'm', 'fusion', 'f', 'heatmap_path', null, 'experts', array(named_struct('name', 'x', 'available', true, 'score', 45), named_struct('name', 'y', 'available', true, 'score', 90), named_struct('name', 'z', 'available', false, 'score', 99), named_struct('name', 'w', 'available', true, 'score', 44))) AS pixel
        UNION ALL SELECT 'b', 'text', 'failed', 3, 'low', array(), null""")
    got = {r.path: r.asDict() for r in sinks.review_rows(items).collect()}
    assert tuple(got["a"]) == sinks.REVIEW_COLUMNS and len(sinks.REVIEW_COLUMNS) == 17
    assert got["a"]["pixel_top_experts"] == "y;x" and got["a"]["risk"] == "높음" and got["a"]["top_signal"] == "first" and got["a"]["external_model"] is None
    assert all(got["b"][c] is None for c in ("score", "risk", "pixel_score", "source", "top_signal"))
    sinks.write_review(items, f"file://{tmp_path}/sheet", {"weights_available": "3"})
    assert spark.read.csv(f"file://{tmp_path}/sheet", header=True).columns == list(sinks.REVIEW_COLUMNS)
    facts = {r.key: r.value for r in spark.read.csv(f"file://{tmp_path}/sheet_provenance", header=True).collect()}
    assert facts == {"thresholds_source": "builtin_defaults", "provisional": "true", "weights_available": "3"}


def test_capped_scans_say_so(spark):
    rows = spark.createDataFrame([(f"p{i}",) for i in range(5)], "path string")
    assert [(r.path, r.capped) for r in readers.capped(rows, "path", 3).orderBy("path").collect()] == [("p0", True), ("p1", True), ("p2", True)]
    assert {r.capped for r in readers.capped(rows, "path", 5).collect()} == {False}
    assert readers.capped(rows.limit(0), "path", 5).collect() == []


def test_explanations_by_form(spark):
    items = spark.createDataFrame([(1, 80, [("b", "", 40), ("a", "", 40), ("c", "", 5)], 2, "swap", 30, 1.25), (2, 40, [("b", "", 40)], 0, None, 0, None), (3, 0, [], 1, None, 5, None)], "item_id int, score int, signals array<struct<title:string,detail:string,weight:int>>, face_count int, manipulation_type string, frame_count int, duration double")
    got = {f: {r.item_id: r for r in fusion.explanation(items, 2, f).collect()} for f in ("general", "face", "video")}
    assert [(x.feature, x.importance) for x in got["general"][1].features] == [("a", 0.4), ("b", 0.4)]
    assert got["general"][1].summary.endswith("주요 요인: a, b, c.") and [got["general"][i].confidence for i in (1, 2, 3)] == ["high", "medium", "low"]
    assert got["face"][1].decision_path[-1] == "얼굴 조작 유형: swap" and got["face"][3].decision_path[-1] == "얼굴 조작 유형: unknown" and len(got["face"][2].decision_path) == 3
    assert got["video"][1].summary.endswith("30개 프레임 분석 (재생시간: 1.2초).") and got["video"][2].summary == got["general"][2].summary
    assert len(got["general"][1].limitations) == 3
    with pytest.raises(ValueError):
        fusion.explanation(items, 2, "radio")


def test_records_of_provenance(spark):
    blobs = [b"x" * 300 + b"c2pa SIGNED http://a.b/c?d 'q" + b"y" * 900, b"jumbf" + b"z" * 600 + b"signed", b"\x00" * 60 + b"deepmind" + b"\x01" * 99, b"about deepmind here", b"Adobe Firefly", b"", None]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(blobs)], "i int, content binary")
    r = provenance.provenance_records(F.col("content"))
    got = [row for row in df.select("i", *[c.alias(n) for n, c in r.items()]).orderBy("i").collect()]
    assert (got[0].manifest.marker, got[0].manifest.signed, got[0].manifest.claim_url, got[0].confidence) == ("c2pa", True, "http://a.b/c?d", 0.5)
    assert (got[1].manifest.marker, got[1].manifest.signed, got[1].manifest.claim_url, got[1].confidence) == ("jumbf", False, None, 0.3)
    assert got[2].tool is None and got[2].confidence is None
    assert got[3].tool.marker == "deepmind" and got[3].confidence == 0.4 and got[4].vendor.provider == "Adobe"
    assert got[5].confidence is None and got[6].confidence is None
