import datetime
import json

from pyspark.sql import functions as F

from sievewright.functions import udfs
from sievewright.operators import records
from sievewright.sources import readers, sinks
from sievewright.streaming import live


def test_files_and_prefix(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "a.txt").write_bytes(b"hello \xff")
    (tmp_path / "d" / "b.png").write_bytes(b"x" * 100)
    (tmp_path / "b.png.model.json").write_text("{}")
    got = {r.path.rsplit("/", 1)[1]: r for r in readers.files(spark, f"file://{tmp_path}", max_bytes=50).collect()}
    assert {k: (r.kind, r.status) for k, r in got.items()} == {"a.txt": ("text", "pending"), "b.png": ("image", "skipped")} and got["b.png"].content is None
    (row,) = readers.files(spark, f"file://{tmp_path}").where("kind = 'text'").select(readers.text_prefix(F.col("content")).alias("t")).collect()
    assert row.t == "hello �"


def test_feedback_forms(spark, tmp_path):
    rows = [{"path": "a", "label": "AI"}, {"file": "b", "expected": "real "}, {"path": "c", "verdict": "maybe"}, {"label": "ai"}]
    forms = {"lines": "\n".join(json.dumps(r) for r in rows), "array": json.dumps(rows), "boxed": json.dumps({"feedback": rows}), "lone": json.dumps(rows[0])}
    for name, body in forms.items():
        (tmp_path / name).write_text(body)
        got = [(r.path, r.label) for r in readers.feedback(spark, f"file://{tmp_path}/{name}").orderBy("path").collect()]
        assert got == ([("a", 1)] if name == "lone" else [("a", 1), ("b", 0)]), name


def test_scan_round_trip_and_loose_numbers(spark, tmp_path):
    doc = {"schema_version": 1, "items": [{"path": "p", "status": "analyzed", "size_bytes": "12", "result": {"score": "x", "band": "low", "signals": [{"title": "t", "weight": "7"}]}}, {"name": "n"}]}
    (tmp_path / "s.json").write_text(json.dumps(doc))
    got = readers.scan_items(spark, f"file://{tmp_path}/s.json").orderBy("path").collect()
    assert [(r.path, r.status, r.size_bytes, r.score, r.band) for r in got] == [("", "failed", 0, 0, "unknown"), ("p", "analyzed", 12, 0, "low")]
    assert got[1].signals[0].weight == 7
    items = spark.createDataFrame([("p", "text", "analyzed", 70, "high"), ("q", "image", "skipped", None, None)], "path string, kind string, status string, score int, band string")
    sinks.write_scan(items, f"file://{tmp_path}/out")
    assert spark.read.parquet(f"file://{tmp_path}/out/items").count() == 2
    assert json.loads(next((tmp_path / "out" / "summary").glob("*.json")).read_text())["high"] == 1


def test_profiles(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"version": "v1", "values": {"a": 1.5}}))
    assert [tuple(r) for r in readers.profile(spark, f"file://{tmp_path}/p.json", "v1").collect()] == [("a", 1.5)]
    assert readers.profile(spark, f"file://{tmp_path}/p.json", "v2").collect() == []


def test_user_functions(spark):
    df = spark.createDataFrame([(1, "a"), (2, "")], "i int, x string")
    got = {r.i: r for r in udfs.process(df, lambda row: row["x"][0].upper()).collect()}
    assert got[1].result == "A" and got[2].status == "failed" and "IndexError" in got[2].error
    good = udfs.detector(lambda: lambda batch: batch.str.len() * 60)
    bad = udfs.detector(lambda: 1 / 0)
    rows = udfs.member_scores(df.withColumnRenamed("i", "item_id"), {"g": (good, "x"), "b": (bad, "x")}).collect()
    assert {(r.item_id, r.member): (r.available, r.score) for r in rows} == {(1, "g"): (True, 60.0), (2, "g"): (True, 0.0), (1, "b"): (False, None), (2, "b"): (False, None)}


def test_stream_equals_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    start = datetime.datetime(2024, 1, 1)
    rows = [(s, s * 1000 + i, start + datetime.timedelta(seconds=i * 2), 80 if 10 <= i < 60 else (i * 7 + s) % 60) for s in (1, 2) for i in range(90)]
    df = spark.createDataFrame(rows, "stream_id long, event_id long, ts timestamp, score int")
    src = f"file://{tmp_path}/src"
    for part in range(3):
        df.where((F.col("event_id") % 1000).between(part * 30, part * 30 + 29)).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = live.stream_states(stream).writeStream.format("memory").queryName("live_out").option("checkpointLocation", f"file://{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.stream_id, r.event_id): r for r in spark.table("live_out").collect()}
    want = {(r.stream_id, r.event_id): r for r in live.states(df).collect()}
    assert set(got) == set(want)
    for k, r in want.items():
        assert (round(got[k].mean, 9), got[k].frame_count, got[k].band) == (round(r.mean, 9), r.frame_count, r.band)
    alerts = {r.stream_id: r.alerts for r in live.alerts_batch(df).collect()}
    for s in (1, 2):
        assert sum(r.alert for (i, _), r in got.items() if i == s) == alerts.get(s, 0) > 0


def test_incremental_scan_resumes(spark, tmp_path):
    src, sink, cp = (f"file://{tmp_path}/{x}" for x in ("in", "out", "cp"))
    one = spark.createDataFrame([(1,)], "i int")
    for _ in range(2):
        one.write.mode("append").parquet(src)
        live.incremental(spark.readStream.schema("i int").parquet(src), lambda d: d.withColumn("j", F.col("i") + 1), sink, cp).awaitTermination()
    assert spark.read.parquet(sink).count() == 2


def test_lineage_and_duplicates(spark):
    e = spark.createDataFrame([(3, 2), (2, 1), (1, 3), (9, 8)], "src long, dst long")
    got = {(r.src, r.ancestor): r.depth for r in records.ancestors(e, 6).collect()}
    assert got[(3, 2)] == 1 and got[(3, 1)] == 2 and got[(3, 3)] == 3 and got[(9, 8)] == 1
    d = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None)], "k long, t string")
    assert {r.k: r.duplicate_of for r in records.duplicates(d, "t", "k").collect()} == {1: None, 2: 1, 3: None, 4: None}


def test_lineage_deeper_than_32_steps_and_of_many_ways(spark):
    chain = [(i + 1, i) for i in range(40)]
    # Twelve diamonds in a row have 4096 ways; a null end is an ancestor that leads nowhere.
    diamonds = [e for k in range(0, 36, 3) for e in ((100 + k, 101 + k), (100 + k, 102 + k), (101 + k, 103 + k), (102 + k, 103 + k))]
    rows = chain + chain[:3] + diamonds + [(0, None), (None, 5)]
    got = [tuple(r) for r in records.ancestors(spark.createDataFrame(rows, "src long, dst long")).collect()]
    want = {}
    for s in {s for s, _ in rows}:
        last, depth = {s}, 0
        while last:
            depth += 1
            last = {d for x, d in set(rows) if x in last and (x is not None or depth == 1)} - {a for q, a in want if q == s}
            want.update({(s, a): depth for a in last})
    assert len(got) == len(want) and {(s, a): d for s, a, d in got} == want and want[(40, 0)] == 40


def test_a_worker_holds_few_texts_at_once(spark):
    """64 MB of texts in one task reach the user function some MB at a time, and stay there."""
    import sys

    def held(row):  # bytes of the batch that the caller holds
        return str(int(sys._getframe(1).f_locals["batch"]["text"].str.len().sum()))

    from sievewright.functions import udfs

    df = spark.range(64, numPartitions=1).selectExpr("id", "repeat('a', 1000000) AS text")
    got = udfs.process(df, held, keep=("id",))
    assert got.columns == ["id", "status", "result", "error", "processing_time"]
    rows = got.collect()
    assert len(rows) == 64 and max(int(r.result) for r in rows) <= 8_000_000
    assert udfs.process(df.limit(2), held).columns == ["id", "text", "status", "result", "error", "processing_time"]
