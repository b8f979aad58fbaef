"""Evidence tables: hashes re-verified, signatures, exhibits, vocabulary checks, case documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRUST_LEVELS = ("observed", "derived", "model-assisted", "human-reviewed")


def verified(then: DataFrame, now: DataFrame, path: str = "path") -> DataFrame:
    """Adds integrity_verified to the recorded rows: the hash is not empty and still the same."""
    later = now.select(F.col(path).alias("p2"), F.col("file_hash").alias("hash_now"))
    d = then.join(later, then[path] == later["p2"], "left").drop("p2")
    return d.withColumn("integrity_verified", F.coalesce((F.col("file_hash") != "") & (F.col("file_hash") == F.col("hash_now")), F.lit(False)))


def integrity(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("items"), F.count_if("integrity_verified").alias("verified"), (F.count_if("integrity_verified") / F.count("*")).alias("integrity_score"))


def hmac_sha256(key: str, message: Column) -> Column:
    """HMAC-SHA-256 (lower-case hex) of a text under a literal key, from sha2 alone."""
    import hashlib

    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\x00")
    inner, outer = bytes(b ^ 0x36 for b in raw), bytes(b ^ 0x5C for b in raw)
    first = F.unhex(F.sha2(F.concat(F.lit(inner), F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(F.lit(outer), first), 256)


def canonical(columns: list[str]) -> Column:
    """A row as JSON with sorted keys; nulls stay."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def signed(rows: DataFrame, columns: list[str], key: str) -> DataFrame:
    return rows.withColumn("signature", hmac_sha256(key, canonical(columns)))


def signature_state(columns: list[str], key: str | None) -> Column:
    """verified, tampered, unsigned or no-key."""
    if key is None:
        return F.when(F.col("signature").isNull() | (F.col("signature") == ""), "unsigned").otherwise("no-key")
    same = F.col("signature") == hmac_sha256(key, canonical(columns))
    return F.when(F.col("signature").isNull() | (F.col("signature") == ""), "unsigned").when(same, "verified").otherwise("tampered")


def exhibits(items: DataFrame, case: str = "case_id", order: str = "path") -> DataFrame:
    """Adds exhibit number, purpose by band, and whether references are due (high and medium only)."""
    n = F.row_number().over(Window.partitionBy(case).orderBy(order))
    purpose = F.when(F.col("band") == "high", "priority review").when(F.col("band") == "medium", "further check").when(F.col("band") == "unknown", "more material").otherwise("record")
    return items.withColumns({"exhibit": n, "purpose": purpose, "references_due": F.col("band").isin("high", "medium")})


def violations(items: DataFrame, levels: tuple[str, ...] = TRUST_LEVELS) -> DataFrame:
    """Rows (item_id, violation): unknown trust levels, and model-assisted rows without limitations."""
    bad = F.when(F.col("trust_level").isNull() | ~F.col("trust_level").isin(*levels), "trust_level").when((F.col("trust_level") == "model-assisted") & (F.coalesce(F.size("limitations"), F.lit(0)) <= 0), "limitations")
    return items.select("item_id", bad.alias("violation")).where("violation IS NOT NULL")


def case_lines(items: DataFrame, edges: DataFrame, case: str = "case_id") -> DataFrame:
    """Rows (case, part, line): a case document as JSON lines, one for each item and each edge of its lineage.

    A case may be of any size: nothing is grouped, and a writer that partitions
    by case gives one folder of lines for each.
    """
    head = (F.lit("evidence-case-v1").alias("schema"), F.col(case).alias("case_id"))
    rows = items.select(case, F.lit("item").alias("part"), F.to_json(F.struct(*head, "item_id", "trust_level")).alias("line"))
    return rows.unionByName(edges.select(case, F.lit("lineage").alias("part"), F.to_json(F.struct(*head, "src", "dst", "relation")).alias("line")))


def load_chains(lines: DataFrame, line: str = "value") -> tuple[DataFrame, DataFrame]:
    """(chains, rejects with row number and reason) of JSON lines."""
    schema = "file_hash string, path string, file_size bigint, analyst_id string, parameters map<string,string>, _bad string"
    d = lines.select(F.monotonically_increasing_id().alias("entry"), F.col(line).alias("raw")).withColumn("r", F.from_json("raw", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    why = F.when(F.col("r").isNull() | F.col("r._bad").isNotNull(), "not JSON").when(F.col("r.path").isNull(), "no path").when(F.col("r.file_hash").isNull(), "no file_hash")
    d = d.withColumn("why", why)
    return d.where("why IS NULL").select("entry", "r.file_hash", "r.path", "r.file_size", "r.analyst_id", "r.parameters"), d.where("why IS NOT NULL").select("entry", "why")
