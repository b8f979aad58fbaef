"""The registered queries of this subpackage, one for each operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.llm import alignment, bpe, decontam, langid, licenses, media, sharding, simhash, suffix_dedup, token_counts, toxicity, warc, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and the bytes that repeated passages of over 50 words cover, shorter ones than 400 bytes too."""
    out = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"), min_bytes=400, keep="none", passages_of=51)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), F.col("n_passage").alias("n_passage_bytes"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_table(spark, sf_dir, "documents"))
    names = F.array_join(F.array_sort(F.array_distinct(F.col("notices.license"))), ",")
    coverage = F.round(F.coalesce(F.array_max("notices.coverage"), F.lit(0.0)), 6)
    return found.select("doc_id", "n_words", F.size("notices").cast("long").alias("n_notices"), names.alias("licenses"), coverage.alias("coverage"))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store_and_describe(_table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), keep_tokens=False)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    net = langid.fit(docs.where(~held_out), "text", "lang")
    return langid.predict(docs, net).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.archive_and_read(_table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontam.contaminated_words(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return hits.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        decontam.is_contaminated().alias("contaminated"),
    )


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document after three edits: a cut at a third, its first words put in at two thirds, its source at the end."""
    n = F.coalesce(F.length("text"), F.lit(0))
    third = F.floor(n / 3).cast("int")
    change = lambda start, end, text: F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), text.alias("text"))
    edits = F.array(
        change(third, third + 12, F.lit("")),
        change(2 * third, 2 * third, F.concat(F.lit(" "), F.coalesce(F.left("text", F.lit(30)), F.lit("")))),
        change(n + 40, n + 40, F.concat(F.lit("\n"), F.coalesce("source", F.lit("")))),
    )
    docs = _table(spark, sf_dir, "documents").withColumn("edits", edits)
    return token_counts.counts_after_edits(docs, _vocabulary("byte_bpe_50k.json"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = toxicity.fit(toxicity.labelled_rows(docs.where(~held_out), _table(spark, sf_dir, "labels")), "t", "y")
    out = toxicity.score(docs, model)
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = _table(spark, sf_dir, "documents").withColumn("size", F.octet_length(text).cast("long") + 1).withColumn("text_crc32", F.crc32(text))
    out = sharding.interleaved(docs, keep=("size", "text_crc32"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), _vocabulary("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (op1_repeats, op2_licenses, op3_media, op4_simhash, op5_bpe, op6_language, op7_warc, op8_decontaminate, op9_token_counts, op10_toxicity, op11_whitening, op12_sharding, op13_alignment)}
SQL: dict[str, str] = {
    "op7_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages
        ), m AS (SELECT html, max(page_id) AS latest FROM p WHERE n >= 1000 GROUP BY html)
        SELECT page_id, n AS payload_bytes, sha1(p.html) AS payload_digest,
               CASE WHEN page_id < latest THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id < latest THEN latest END AS refers_to
        FROM p LEFT JOIN m ON p.html = m.html
    """,
    "op12_sharding": """
        WITH RECURSIVE bits AS (
            SELECT range AS byte, range::BIGINT AS c, 0 AS k FROM range(256)
            UNION ALL SELECT byte, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
        ), crc AS (SELECT list(c ORDER BY byte) AS t FROM bits WHERE k = 8),
        d AS (
            SELECT doc_id, source, coalesce(text, '') AS text, coalesce('+' || source, '-') AS s,
                   md5(concat_ws('|', '42', coalesce(doc_id::VARCHAR, ''), coalesce(md5(text), ''))) AS h
            FROM documents
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY s ORDER BY h) - 1 AS r, count(*) OVER (PARTITION BY s) AS n FROM d
        ), placed AS (
            SELECT *, row_number() OVER (ORDER BY (2 * r + 1)::DOUBLE / (2 * n)::DOUBLE, h, s, r) - 1 AS place, count(*) OVER () AS total FROM ranked
        ), dealt AS (SELECT *, place * 8 // total AS shard FROM placed)
        SELECT doc_id, strlen(text) + 1 AS size,
               xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT)),
                   lambda a, b: xor(a >> 8, crc.t[1 + (xor(a, b) & 255)]))) AS text_crc32,
               'rows' AS law, shard::INTEGER AS shard, place - (shard * total + 7) // 8 AS slot, NULL::INTEGER AS grown_shard
        FROM dealt, crc
    """,
}
