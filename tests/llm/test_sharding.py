"""Sharding against one sort in Python."""

import hashlib
from collections import Counter

from sievewright.llm import sharding


def by_sort(rows, shards=8, seed=42):
    """(id, source, shard, slot) of (id, source, text) rows by sorting everything at once."""
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    key = lambda r: md5("|".join([str(seed), "" if r[0] is None else str(r[0]), "" if r[2] is None else md5(r[2])]))
    by_source = {}
    for r in rows:
        by_source.setdefault(r[1], []).append((key(r), r))
    every = []
    for source, own in by_source.items():
        for rank, (h, r) in enumerate(sorted(own, key=lambda x: x[0])):
            every.append(((2 * rank + 1) / (2 * len(own)), h, "-" if source is None else "+" + source, r))
    every.sort(key=lambda x: x[:3])
    n, out = len(every), []
    for place, (_, _, _, r) in enumerate(every):
        shard = place * shards // n
        out.append((r[0], r[1], shard, place - -(-shard * n // shards)))
    return out


def order(rows):
    return sorted(rows, key=repr)


def test_equals_one_sort(spark):
    rows = [(i, ["web", "web", "web", "books", None, "code"][i % 6], f"text {i % 97}") for i in range(1500)]
    rows += [(None, "web", None), (None, "web", ""), (7, "code", "text 7")] + [(9999, "web", "same")] * 9000
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "'x' AS shard", "1 AS slot", "2 AS h", "3 AS k0")
    got = sharding.interleaved(df.repartition(7)).select("doc_id", "source", "shard", "slot").collect()
    assert order(tuple(r) for r in got) == order(by_sort(rows))
    again = sharding.interleaved(df.repartition(2)).select("doc_id", "source", "shard", "slot").collect()
    assert order(tuple(r) for r in again) == order(tuple(r) for r in got)
    n, per_source = len(rows), Counter(r[1] for r in rows)
    in_shard, mixed = Counter(r.shard for r in got), Counter((r.shard, r.source) for r in got)
    assert max(in_shard.values()) - min(in_shard.values()) <= 1
    for (_, source), m in mixed.items():
        assert abs(m - per_source[source] / 8) <= 2 + per_source[source] * len(per_source) / n


def test_edges(spark):
    kind = "doc_id long, source string, text string"
    assert sharding.interleaved(spark.createDataFrame([], kind)).collect() == []
    few = sharding.interleaved(spark.createDataFrame([(1, "a", "x"), (2, None, None)], kind)).collect()
    assert sorted((r.doc_id, r.place, r.slot) for r in few) in ([(1, 0, 0), (2, 1, 0)], [(1, 1, 0), (2, 0, 0)])
    long = sharding.interleaved(spark.createDataFrame([(1, "a", "x" * 3_000_000)], kind), shards=1).collect()
    assert [(r.shard, r.slot) for r in long] == [(0, 0)]


def test_written_shards_hold_all_rows(spark, tmp_path):
    rows = [(i, "ab"[i % 3 == 0], f"text {i}", i * 0.5) for i in range(700)] + [(1, "b", "text 1", 7.0), (3, "a", "text 3", 1.5)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, extra double")
    path = f"file://{tmp_path}/out"
    sharding.write_shards(df, path, shards=4, rows_per_file=50)
    back = spark.read.parquet(path).selectExpr("*", "_metadata.file_path AS file").collect()
    assert order((r.doc_id, r.source, r.text, r.extra) for r in back) == order(rows)
    assert order((r.doc_id, r.source, r.shard, r.slot) for r in back) == order(by_sort([r[:3] for r in rows], 4))
    files = {}
    for r in back:
        files.setdefault(r.file, []).append(r.slot)
    assert all(len(x) <= 50 and max(x) - min(x) == len(x) - 1 for x in files.values())
