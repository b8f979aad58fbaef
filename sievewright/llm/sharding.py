"""Sharding by proportional stratified interleaving: every shard has the mixture of sources."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievewright.llm.common import written

#: Copies of one row that one task spreads out again.
COPY_RUN = 4096


def _shuffled(seed: int, id_col: str, text_col: str) -> Column:
    """A row's place in the seeded shuffle: 32 hex digits from seed, id and text."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.md5(F.col(text_col).cast("string")), F.lit(""))))


def _buckets(n: int) -> int:
    """About as many buckets as rows in each, so that neither grows with n alone."""
    return max(1, isqrt(n))


def interleaved(
    docs: DataFrame,
    shards: int = 8,
    seed: int = 42,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Rows (<id>, <source>, *keep, place, shard, slot): each row of docs with its shard and its place there.

    Rows are shuffled by a seeded hash within each source; rank r of a source's n
    rows gives the fractional rank (2r + 1) / 2n; all rows in the order of these
    are cut into ``shards`` runs whose counts differ by one at most.  A source's
    part of any shard is its part of the whole, but for at most two rows and
    its share of one row of each source.  ``place`` counts in the common order from 0,
    ``slot`` in the shard from 0.

    No window holds a source or a shard: ranks are counted in about sqrt(rows)
    buckets of the hash, and of the fractional rank, plus the counts of the
    buckets before.  Equal rows (id, source, text hash and kept columns) are
    counted once and spread out again in runs, so copies of one row do not meet
    in one task.  Kept columns go through four shuffles: keep small ones.  A null source is a source, a null text or id is a value of its own;
    empty tables give empty results; only the row count comes to the driver.
    """
    columns = list(dict.fromkeys((id_col, source_col, *keep)))
    names = [f"k{i}" for i in range(len(columns))]
    light = docs.select(*[F.col(c).alias(k) for c, k in zip(columns, names, strict=True)], _shuffled(seed, id_col, text_col).alias("h"))
    light = light.withColumn("s", F.coalesce(F.concat(F.lit("+"), F.col(names[columns.index(source_col)]).cast("string")), F.lit("-")))
    rows = written(light.groupBy("s", "h", *names).agg(F.count("*").alias("copies")), "shuffled")
    total = rows.agg(F.sum("copies")).first()[0] or 0
    width = _buckets(total)

    bucketed = rows.withColumn("b", (F.conv(F.left("h", F.lit(8)), 16, 10).cast("long") * width / (1 << 32)).cast("long"))
    of_source = Window.partitionBy("s")  # over counts: at most sqrt(rows) of them
    before = F.sum("m").over(of_source.orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
    counts = bucketed.groupBy("s", "b").agg(F.sum("copies").alias("m"))
    offsets = counts.select("s", "b", F.coalesce(before, F.lit(0)).alias("off"), F.sum("m").over(of_source).alias("n"))
    # Rows of one hash and different kept columns are told apart by those.
    order = Window.partitionBy("s", "b").orderBy("h", *names)
    inside = F.coalesce(F.sum("copies").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = bucketed.withColumn("r", inside).join(offsets, ["s", "b"]).withColumn("r", F.col("off") + F.col("r"))
    last = F.col("r") + F.col("copies") - 1
    runs = ranked.select("s", "h", "n", *names, last.alias("last"), F.explode(F.sequence("r", last, F.lit(COPY_RUN))).alias("r"))
    runs = runs.repartition(F.col("h"), F.col("r"))  # the runs of a row that occurs often part here
    copies = runs.select("s", "h", "n", *names, F.explode(F.sequence("r", F.least(F.col("last"), F.col("r") + COPY_RUN - 1))).alias("r"))
    fraction = copies.withColumn("f", (2 * F.col("r") + 1).cast("double") / (2 * F.col("n")).cast("double"))
    cut = written(fraction.withColumn("g", F.floor(F.col("f") * width)).drop("n"), "fractions")

    earlier = F.sum("m").over(Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1))  # sqrt(rows) counts
    starts = cut.groupBy("g").agg(F.count("*").alias("m")).select("g", F.coalesce(earlier, F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("g").orderBy("f", "h", "s", "r")) - 1
    placed = cut.withColumn("w", within).join(starts, "g").withColumn("place", F.col("start") + F.col("w"))
    shard = F.expr(f"place * {shards} div {max(total, 1)}")
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    placed = placed.withColumn("shard", shard).withColumn("slot", F.col("place") - first)
    return placed.select(*[F.col(k).alias(c) for c, k in zip(columns, names, strict=True)], "place", F.col("shard").cast("int").alias("shard"), "slot")


def write_shards(docs: DataFrame, path: str, shards: int = 8, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", rows_per_file: int = 100_000) -> None:
    """Writes docs, whole rows, as Parquet under ``path``/shard=k/, each file a run of slots in order.

    Places are found with hashes for the rows; the rows themselves are dealt
    twice: once to meet their places and once to their files.  Columns of docs
    named ``shard``, ``slot``, ``place`` or beginning with ``_`` are not kept.
    """
    others = [c for c in docs.columns if c not in ("place", "shard", "slot") and not c.startswith("_")]
    keyed = docs.select(*others).withColumn("_h_", _shuffled(seed, id_col, text_col)).withColumn("_row_", F.xxhash64(*others))
    places = interleaved(keyed, shards, seed, id_col, text_col, source_col, keep=("_h_", "_row_")).select("_h_", "_row_", "shard", "slot")
    out = keyed.dropDuplicates(["_h_", "_row_"]).join(places, ["_h_", "_row_"]).withColumn("_run_", F.floor(F.col("slot") / rows_per_file))
    dealt = out.repartition("shard", "_run_").sortWithinPartitions("shard", "_run_", "slot").select(*others, "slot", "shard")
    dealt.write.partitionBy("shard").option("maxRecordsPerFile", rows_per_file).parquet(path)
