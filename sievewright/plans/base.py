"""Base tables that several queries derive from the given ones, as SQL that Spark and DuckDB both read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from sievewright.session import tuned

#: Whole documents with phrases the rules look for beside most of them, by id; short rows of
#: conversations, in which such phrases weigh more; nation names, blank and empty for some.
NOTES = """
SELECT doc_id, lang, source, CASE doc_id % 18
 WHEN 1 THEN text || ' As an AI language model, I cannot browse.'
 WHEN 2 THEN 'In conclusion, overall it is important to note the balanced approach. ' || text
 WHEN 3 THEN text || chr(10) || repeat('- item of a list' || chr(10), 7)
 WHEN 4 THEN repeat('However the words of this plain old sentence are all of one very similar and steady length just as before today. ', 12) || text
 WHEN 5 THEN repeat('we delve into the crucial realm — moreover a nuanced tapestry… ', 12) || text
 WHEN 6 THEN 'On the one hand it is so. On the other hand it is not so. However it is important to note this here. Although late, nevertheless good. ' || text
 WHEN 7 THEN repeat('Moreover this is so now. Furthermore it was good then and there for us. ', 9) || text
 WHEN 8 THEN '```' || chr(10) || text || chr(10) || '```' || chr(10) || '# head' || chr(10) || '| a | b |' || chr(10) || repeat('1. numbered **bold** line' || chr(10), 6)
 WHEN 9 THEN '[a link](http://example.org/a) `code` ' || text || ' https://example.org/b'
 WHEN 10 THEN '   ' || text || '   '
 WHEN 11 THEN text || chr(10) || chr(9) || chr(10)
 WHEN 12 THEN repeat('한편 이 방법은 장점이 있습니다. 반면 단점도 있습니다. 결론적으로 다양한 측면을 살펴보면 중요한 것은 문제들과 방안들입니다. 그것은 지속 가능한 시너지 효과를 통해 할 수 있습니다. ', 6) || text
 WHEN 13 THEN text || ' ChatGPT said so in the report that it announced.'
 WHEN 14 THEN '나는 오늘 학교에서 친구를 만났다. 우리의 선생님의 책은 좋았다. ' || repeat('또한 이것은 주의해야 합니다. ', 8) || text
 WHEN 15 THEN text || ' my friend and I met yesterday 2024-05-01, you know, so well, like then.'
 WHEN 16 THEN '- one' || chr(10) || '- two' || chr(10) || '- three' || chr(10) || '**a** **b** **c**' || chr(10) || text
 ELSE text END AS text
FROM documents
UNION ALL
SELECT 1000000000000 + conv_id * 1000 + turn AS doc_id, CAST(NULL AS VARCHAR(9)) AS lang, role AS source, CASE (conv_id + turn) % 7
 WHEN 0 THEN repeat('However the words of this plain old sentence are all of one very similar and steady length just as before today. ', 30) || text
 WHEN 1 THEN repeat('한편 이 방법은 장점이 있습니다. 반면 단점도 있습니다. 결론적으로 다양한 측면을 살펴보면 중요한 것은 문제들과 방안들입니다. 그것은 지속 가능한 시너지 효과를 통해 할 수 있습니다. ', 30) || text
 WHEN 2 THEN text || chr(10) || repeat('1. numbered **bold** line' || chr(10), 40)
 WHEN 3 THEN repeat('we delve into the crucial realm — moreover a nuanced tapestry… ', 30) || text
 WHEN 4 THEN repeat('나는 오늘 학교에서 친구를 만났다. 우리의 선생님의 책은 좋았다. 또한 이것은 주의해야 합니다. 이것을 기억하세요. ', 30) || text
 WHEN 5 THEN repeat('Moreover it is. Furthermore this was good then and there for us all. ', 30) || text
 ELSE text END AS text
FROM conversations
UNION ALL
SELECT 2000000000000 + n_nationkey AS doc_id, CAST(NULL AS VARCHAR(9)) AS lang, 'nation' AS source, CASE n_nationkey % 4 WHEN 0 THEN '' WHEN 1 THEN '   ' ELSE n_name END AS text
FROM nation
"""

#: A score of 0-100, a label, and groups for each labelled document.
SCORED = """
SELECT d.doc_id AS item_id, CAST((n_chars * 7 + l.quality * 13 + l.toxic * 29) % 101 AS INTEGER) AS score, l.toxic AS label, d.lang, d.source,
       CASE WHEN d.doc_id % 10 < 7 THEN 'train' WHEN d.doc_id % 10 < 9 THEN 'val' ELSE 'test' END AS split,
       CASE d.doc_id % 4 WHEN 0 THEN 'clean' WHEN 1 THEN 'jpeg' WHEN 2 THEN 'resize' ELSE 'crop' END AS transform
FROM documents d JOIN labels l ON d.doc_id = l.doc_id
"""

#: Scan items: every status and band.
ITEMS = """
SELECT doc_id AS item_id, source || '/' || lang || '/f' || CAST(doc_id AS VARCHAR(20)) || CASE doc_id % 5 WHEN 0 THEN '.TXT' WHEN 1 THEN '.png' WHEN 2 THEN '.mp3' WHEN 3 THEN '.mp4' ELSE '.zip' END AS path,
       CASE WHEN doc_id % 23 = 0 THEN 'failed' WHEN doc_id % 19 = 0 THEN 'skipped' WHEN doc_id % 17 = 0 THEN 'duplicate' WHEN doc_id % 29 = 0 THEN 'unsupported' ELSE 'analyzed' END AS status,
       CAST(n_chars % 101 AS INTEGER) AS score,
       CASE WHEN doc_id % 31 = 0 THEN 'unknown' WHEN n_chars % 101 >= 67 THEN 'high' WHEN n_chars % 101 >= 35 THEN 'medium' ELSE 'low' END AS band,
       n_chars AS size_bytes, text, lang, source
FROM documents
"""

#: A stream of scores for each user.
STREAM = "SELECT user_id AS stream_id, event_id, ts, CAST(least(100, floor(value)) AS INTEGER) AS score FROM events"

#: One series of frames for each user.
FRAMES = """
SELECT user_id AS video_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_number, ts,
       CASE WHEN user_id % 7 = 0 THEN 100.0 ELSE value END AS brightness,
       CASE WHEN user_id % 5 = 0 THEN 5.0 ELSE value / 10 END AS contrast,
       CASE WHEN user_id % 3 = 0 THEN 120.0 + value / 100 ELSE value * 12 END AS blur,
       CASE WHEN user_id % 4 = 0 THEN 0.1 ELSE value / 1000 END AS edges
FROM events
"""

BASES = {"notes": NOTES, "scored": SCORED, "items": ITEMS, "stream": STREAM, "frames": FRAMES}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def sql(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    """Runs Spark SQL over the given tables and the bases it names, without views; the session gets the library's settings."""
    spark = tuned(spark)
    for name, text in BASES.items():
        if re.search(rf"\b{name}_base\b", query):
            query = re.sub(rf"\b{name}_base\b", f"({text})", query)
    named = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if re.search(rf"(FROM|JOIN)\s+{t}\b", query)}
    query = query.replace("{", "{{").replace("}", "}}")
    for t in named:
        query = re.sub(rf"\b(FROM|JOIN)\s+{t}\b", rf"\1 {{{t}}}", query)
    return spark.sql(query, **named)


def oracle(query: str) -> str:
    """The query for DuckDB, its bases as common tables."""
    used = [f"{n}_base AS ({text})" for n, text in BASES.items() if re.search(rf"\b{n}_base\b", query)]
    if not used:
        return query
    query = query.strip()
    head = "WITH RECURSIVE " if query.upper().startswith("WITH RECURSIVE") else "WITH "
    rest = re.sub(r"(?is)^WITH\s+(RECURSIVE\s+)?", "", query) if query.upper().startswith("WITH") else None
    return head + ",\n".join(used) + (",\n" + rest if rest is not None else "\n" + query)
