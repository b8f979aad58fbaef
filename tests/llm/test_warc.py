import hashlib

import pytest
from pyspark.sql import functions as F

from sievewright.llm import warc
from sievewright.llm.common import open_fs, scratch_uri


def rows():
    big, small = "Ü" * 600, "s" * 999
    out = [(i, f"https://www.h{i % 7}.example.com:443/p{i % 5}?q={i}#f", f"<p>{i}</p>" * (i % 300)) for i in range(700)]
    out += [(1000 + i, "http://same.example.org/", big) for i in range(600)]
    out += [(2000, "http://a.b/", small), (2001, "http://a.b/", small), (2002, None, None), (2003, "", ""), (None, "http://n.b/", big), (2004, "http://long.b/", "é" * 300000)]
    return [(*r, "x") for r in out]


def test_round_trip(spark):
    data = rows()
    df = spark.createDataFrame(data, "page_id long, url string, html string, key string")
    got = warc.archive_and_read(df, with_payload=True).collect()
    last = {}
    for i, _, html, _ in data:
        if html and len(html.encode()) >= 1000 and i is not None:
            last[html] = max(last.get(html, i), i)
    want = []
    for i, url, html, _ in data:
        raw = (html or "").encode()
        refers = last.get(html) if i is not None else None
        refers = None if refers == i else refers
        want.append((i, url or "", len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if refers else "response", refers, b"" if refers else raw))
    assert sorted(((r.page_id, r.url, r.payload_bytes, r.digest, r.record_type, r.refers_to, bytes(r.payload)) for r in got), key=repr) == sorted(want, key=repr)
    assert warc.archive_and_read(df.limit(0)).collect() == []


def test_lookup_of_some_keys_and_damage(spark):
    df = spark.createDataFrame(rows(), "page_id long, url string, html string, key string")
    folder = scratch_uri(spark, "warc")
    warc.write(df, folder)
    keys = spark.createDataFrame([("org,example,same)/",), ("com,example,h3)/p0?q=10",), ("zz)/",), (None,), ("",)], "key string")
    got = warc.lookup(keys, folder).collect()
    assert sorted(r.key for r in got) == ["com,example,h3)/p0?q=10"] + ["org,example,same)/"] * 600
    fs, path = open_fs(folder)
    name = [f.path for f in fs.get_file_info(__import__("pyarrow.fs").fs.FileSelector(f"{path}/records"))][0]
    raw = bytearray(fs.open_input_file(name).read())
    raw[20] ^= 0xFF
    with pytest.raises(ValueError):
        warc.parse_record(bytes(raw))


def test_one_url_in_half_the_rows_is_read_in_slices(spark, monkeypatch):
    monkeypatch.setattr(warc, "TASK_BYTES", 1 << 13)
    rows = [(i, "http://hot.example.org/" if i % 2 else f"http://h{i}.example.org/", f"page {i} " * 20) for i in range(4000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = scratch_uri(spark, "warc")
    warc.write(df, folder)
    hot = warc.lookup(spark.createDataFrame([("org,example,hot)/",)], "key string"), folder)
    parts = hot.withColumn("part", F.spark_partition_id()).groupBy("part").count().collect()
    assert sum(p["count"] for p in parts) == 2000 and len(parts) >= 4 and max(p["count"] for p in parts) <= 1024
    assert sorted(int(r.page_id) for r in hot.collect()) == list(range(1, 4000, 2))
    assert sorted(r.page_id for r in warc.archive_and_read(df).collect()) == list(range(4000))
