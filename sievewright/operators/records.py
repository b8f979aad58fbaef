"""Scan records: routing, duplicates, caches, splits, audits, summaries, lexicon joins, lineage."""

from __future__ import annotations

import hashlib
import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievewright.operators import matching, ordered
from sievewright.sources.scratch import shared_folder, written

#: File kinds by extension.
KINDS = {
    "text": (".txt", ".md", ".csv", ".json", ".log"),
    "document": (".pdf", ".docx", ".pptx", ".xlsx", ".hwp", ".html"),
    "image": (".png", ".jpg", ".jpeg", ".webp", ".gif", ".bmp", ".tif", ".tiff"),
    "audio": (".wav", ".mp3", ".flac", ".ogg", ".m4a", ".aac"),
    "video": (".mp4", ".mov", ".mkv", ".avi", ".webm"),
    "archive": (".zip", ".tar", ".gz", ".7z", ".rar"),
}
REQUIRED_SPLITS = ("train", "val", "test")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def kind(path: Column, kinds: dict[str, tuple[str, ...]] | None = None) -> Column:
    """Kind by the path's extension, else unsupported."""
    out, ext = None, extension(path)
    for name, known in (kinds or KINDS).items():
        out = F.when(ext.isin(*known), name) if out is None else out.when(ext.isin(*known), name)
    return out.otherwise("unsupported")


def display_path(path: Column, root: str | None = None) -> Column:
    """The last part, or the path below a root."""
    return F.element_at(F.split(path, "/"), -1) if root is None else F.regexp_replace(path, "^" + re.escape(root.rstrip("/")) + "/", "")


def guarded(items: DataFrame, max_bytes: int, size: str = "size_bytes") -> DataFrame:
    """Items over the size become skipped."""
    return items.withColumn("status", F.when(F.col(size) > max_bytes, "skipped").otherwise(F.col("status")))


def duplicates(items: DataFrame, content: str, key: str) -> DataFrame:
    """Adds content_hash and duplicate_of: the least key of equal content, null for the keeper and null contents.

    The keeper comes from an aggregate that combines before the shuffle; the join
    back can be split where one content is very common.  Only hashes are shuffled
    for the aggregate.
    """
    d = items.withColumn("content_hash", F.sha2(F.col(content), 256))
    first = d.where("content_hash IS NOT NULL").groupBy("content_hash").agg(F.min(key).alias("keeper"))
    return d.join(first, "content_hash", "left").withColumn("duplicate_of", F.when(F.col("keeper") != F.col(key), F.col("keeper"))).drop("keeper")


def against_known(items: DataFrame, known: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(items with duplicate_of from a persisted hash table, hashes to append); items carry content_hash."""
    old = known.select("content_hash", F.col(key).alias("known_key"))
    marked = items.join(old, "content_hash", "left").withColumn("duplicate_of", F.coalesce("duplicate_of", F.when(F.col("known_key") != F.col(key), F.col("known_key")))).drop("known_key")
    new = items.where("duplicate_of IS NULL AND content_hash IS NOT NULL").select("content_hash", key).join(known, "content_hash", "left_anti")
    return marked, new


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def with_cache(work: DataFrame, cache: DataFrame, key: str = "cache_key") -> tuple[DataFrame, DataFrame]:
    """(rows still to analyse, rows answered by the cache): both sides of one key join."""
    return work.join(cache.select(key), key, "left_anti"), work.join(cache, key).withColumn("cached", F.lit(True))


#: Rows of a lexicon at most; it is a list of names, not a table that grows with the texts.
LEXICON_ROWS = 1_000_000


def marker_hits(docs: DataFrame, lexicon: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, tool, marker) of lexicon rows (tool, marker) found in lower-cased texts.

    ASCII markers stand between characters other than a-z and 0-9, others
    anywhere.  One automaton of all markers is broadcast and goes over each text
    once, so neither the number of markers nor of tools adds to the time; texts
    are neither joined nor shuffled.  A lexicon of over LEXICON_ROWS rows is an
    error; null and empty markers are left out.
    """
    rows = lexicon.select("tool", "marker").where("marker <> ''").distinct().limit(LEXICON_ROWS + 1).collect()
    if len(rows) > LEXICON_ROWS:
        raise ValueError(f"the lexicon has over {LEXICON_ROWS} rows")
    if not rows:
        return docs.select(id_col, F.lit("").alias("tool"), F.lit("").alias("marker")).where(F.lit(False))
    tools: dict[str, list[str | None]] = {}
    for r in sorted(rows, key=lambda r: (r.marker, r.tool or "")):
        tools.setdefault(r.marker, []).append(r.tool)
    markers = list(tools)
    found = matching.present(docs.sparkSession, markers, [m.isascii() for m in markers])
    named = F.array(*[F.array(*[F.struct(F.lit(t).cast("string").alias("tool"), F.lit(m).alias("marker")) for t in tools[m]]) for m in markers])
    hits = F.flatten(F.transform("_m", lambda k: F.get(named, k)))
    d = docs.select(id_col, found(F.lower(F.coalesce(F.col(text_col), F.lit("")))).alias("_m")).where(F.size("_m") > 0)
    return d.select(id_col, F.explode(hits).alias("_h")).select(id_col, "_h.tool", "_h.marker")


def tool_matches(hits: DataFrame, id_col: str, top: int = 5) -> DataFrame:
    """Rows (id, tool, hits, confidence, label, place): best tools of each text; ties by name."""
    c = hits.groupBy(id_col, "tool").agg(F.countDistinct("marker").alias("hits"))
    c = c.withColumn("confidence", F.least(F.lit(1.0), F.lit(0.6) + (F.col("hits") - 1) * F.lit(0.15)))
    c = c.withColumn("label", F.when(F.col("confidence") >= 0.8, "high").when(F.col("confidence") >= 0.5, "medium").otherwise("low"))
    place = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("confidence"), "tool"))
    return c.withColumn("place", place).where(F.col("place") <= top)


def unit_interval(seed: str, key: Column) -> Column:
    """The first 64 bits of sha256(seed:key), as a share of the largest."""
    bits = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256), 1, 16), 16, 10)
    return (bits.cast("decimal(20,0)") / F.lit("18446744073709551615").cast("decimal(20,0)")).cast("double")


def split(seed: str, key: Column, train: float = 0.7, val: float = 0.15) -> Column:
    u = unit_interval(seed, key)
    return F.when(u < train, "train").when(u < train + val, "val").otherwise("test")


def path_labels(paths: DataFrame, path: str = "path") -> DataFrame:
    """Adds label, split and source from folder names: edited before ai, numeric class prefixes dropped, valid is val."""
    parts = F.transform(F.slice(F.split(F.lower(path), "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))), lambda p: F.regexp_replace(p, r"^\d+_", ""))
    d = paths.withColumn("_p", parts)
    has = lambda *names: F.arrays_overlap("_p", F.array(*map(F.lit, names)))
    label = F.when(has("edited", "tampered", "manipulated"), "edited").when(has("ai", "fake", "synthetic", "generated"), "ai").when(has("real", "human", "camera", "authentic"), "human").otherwise("unknown")
    part = F.when(has("train"), "train").when(has("val", "valid", "validation"), "val").when(has("test"), "test").otherwise("unspecified")
    named = ("edited", "tampered", "manipulated", "ai", "fake", "synthetic", "generated", "real", "human", "camera", "authentic", "train", "val", "valid", "validation", "test")
    source = F.coalesce(F.get(F.filter("_p", lambda p: ~p.isin(*named) & (p != "")), F.lit(0)), F.lit("unknown"))
    return d.withColumns({"label": label, "split": part, "group_source": source}).drop("_p")


def masks(paths: DataFrame, path: str = "path") -> DataFrame:
    """Rows (path, mask_path): the first existing of stem_mask.png, stem.mask.png, masks/stem.png beside each file."""
    stem, base = F.regexp_replace(path, r"\.[^./]+$", ""), F.regexp_extract(F.regexp_replace(path, r"\.[^./]+$", ""), r"([^/]*)$", 1)
    folder = F.regexp_extract(path, r"^(.*/)?[^/]*$", 1)
    names = F.array(F.concat(stem, F.lit("_mask.png")), F.concat(stem, F.lit(".mask.png")), F.concat(folder, F.lit("masks/"), base, F.lit(".png")))
    wanted = paths.select(F.col(path).alias("path"), F.posexplode(names).alias("i", "mask_path"))
    return wanted.join(paths.select(F.col(path).alias("mask_path")), "mask_path", "left_semi").groupBy("path").agg(F.min_by("mask_path", "i").alias("mask_path"))


def summary(items: DataFrame, by: list[str] = ()) -> DataFrame:
    """Conditional counts of a scan in one pass."""
    done = F.col("status") == "analyzed"
    return items.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count_if(done).alias("analyzed"),
        *[F.count_if(done & (F.col("band") == b)).alias(b) for b in ("high", "medium", "unknown", "low")],
        F.count_if(~F.col("status").isin("analyzed", "duplicate", "skipped")).alias("unsupported_or_failed"),
        F.count_if(F.col("status") == "duplicate").alias("duplicates"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
    )


def review_bucket(status: Column, band: Column) -> Column:
    return F.when(status != "analyzed", 4).when(band == "high", 0).when(band == "medium", 1).when(band == "unknown", 2).otherwise(3)


def review_order(items: DataFrame, by: list[str] = (), ranges: int | None = None) -> DataFrame:
    """Adds place: high, medium, unknown, low, not analysed; then score down, then path; over all items or within groups.

    Places are counted over ranges of the order, so one list of all sources, or a
    source of any size, is many tasks.  Items go through two shuffles: select
    what is wanted of them before.
    """
    order = [review_bucket(F.col("status"), F.col("band")), F.when(F.col("status") == "analyzed", F.col("score")).desc_nulls_last(), F.lower("path"), F.col("path")]
    return ordered.ranked(items, order, list(by), "place", ranges)


def audit(corpus: DataFrame, required: tuple[str, ...] = REQUIRED_SPLITS) -> DataFrame:
    """Issue rows (source, issue, detail, n): missing splits, unknown labels, duplicate contents, leaks between splits."""
    missing = corpus.groupBy("source").agg(F.collect_set("split").alias("have")).select("source", F.explode(F.array_except(F.array(*map(F.lit, required)), "have")).alias("detail"))
    unknown = corpus.where("label IS NULL OR label = 'unknown'").groupBy("source").agg(F.count("*").alias("n"))
    same = corpus.groupBy("source", "content_hash").agg(F.count("*").alias("n")).where("n > 1").groupBy("source").agg(F.count("*").alias("n"))
    leaks = corpus.groupBy("content_hash").agg(F.countDistinct("split").alias("splits")).where("splits > 1")
    return (
        missing.select("source", F.lit("missing_split").alias("issue"), "detail", F.lit(0).cast("long").alias("n"))
        .unionByName(unknown.select("source", F.lit("unknown_label").alias("issue"), F.lit("").alias("detail"), "n"))
        .unionByName(same.select("source", F.lit("duplicate_groups").alias("issue"), F.lit("").alias("detail"), "n"))
        .unionByName(leaks.select(F.lit("").alias("source"), F.lit("split_leak").alias("issue"), F.lit("").alias("detail"), F.lit(1).cast("long").alias("n")).groupBy("source", "issue", "detail").agg(F.sum("n").alias("n")))
    )


def fingerprint(corpus: DataFrame, by: list[str], label: str, content_hash: str) -> DataFrame:
    """Rows (by, n, fingerprint): one digest of each group's (label, content hash) rows, whatever their order.

    The rows' digests are summed in 4096 buckets, which combine before the
    shuffle; a group's digest is over its buckets, so no task or row holds a
    group.  Rows repeat in it as often as they occur; null hashes count as empty.
    """
    line = F.sha2(F.concat_ws(":", F.col(label).cast("string"), F.col(content_hash)), 256)
    part = lambda i: F.conv(F.substring("d", i, 15), 16, 10).cast("decimal(38,0)")
    sums = corpus.select(*by, line.alias("d")).groupBy(*by, F.left("d", F.lit(3)).alias("b")).agg(F.count("*").alias("n"), F.sum(part(4)).alias("x"), F.sum(part(19)).alias("y"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("b", "n", "x", "y"))), lambda r: F.concat_ws(",", r["b"], r["n"], r["x"], r["y"])), ";")
    return sums.groupBy(*by).agg(F.sum("n").alias("n"), F.sha2(text, 256).alias("fingerprint"))


#: Nodes that one node of a tree of digests is over.
FAN = 256


def _levels(n_most: int, fan: int) -> int:
    levels = 1
    while n_most > fan**levels:
        levels += 1
    return levels


def tree_levels(rows: DataFrame, by: list[str], path: str, label: str, content_hash: str, fan: int = FAN, ranges: int | None = None) -> list[DataFrame]:
    """Levels of each group's tree of digests, leaves first: rows (by, n, i, digest); the last level has i = 0 alone.

    Leaves are SHA-256 of path, label and content hash in path order, numbered
    over ranges of it; node i of a level is SHA-256 of the ``fan`` digests from
    fan * i on of the level below, put together as hex.  A group whose level has
    one node keeps it.  Nulls count as empty; rows of one path go by label and hash.
    Each level is a table in the shared folder, 1/fan of the one below; only the
    largest group's count comes to the driver.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    leaves = rows.select(*by, part(path).alias("_p"), part(label).alias("_l"), part(content_hash).alias("_h"))
    leaves = ordered.running(leaves, by, ["_p", "_l", "_h"], {"i": F.lit(1).cast("long")}, ranges, totals=True)
    level = written(leaves.select(*by, F.col("i_all").alias("n"), (F.col("i") - 1).alias("i"), F.sha2(F.concat_ws("|", "_p", "_l", "_h"), 256).alias("digest")), "leaves")
    out = [level]
    for k in range(_levels(level.agg(F.max("n")).first()[0] or 0, fan)):
        below = F.sort_array(F.collect_list(F.struct("i", "digest")))
        node = F.sha2(F.array_join(F.transform(F.col("x"), lambda r: r["digest"]), ""), 256)
        alone = F.col("n") <= fan**k if k else F.lit(False)
        level = level.groupBy(*by, "n", F.expr(f"i div {fan}").alias("up")).agg(below.alias("x"))
        level = written(level.select(*by, "n", F.col("up").alias("i"), F.when(alone, F.col("x")[0]["digest"]).otherwise(node).alias("digest")), "level")
        out.append(level)
    return out


def tree_root(rows: DataFrame, by: list[str], path: str, label: str, content_hash: str, fan: int = FAN, ranges: int | None = None) -> DataFrame:
    """Rows (by, n, root): a digest of each group's (path, label, content hash) rows in path order.

    A change of a path, a label or a content changes it; how the rows are
    partitioned does not.
    """
    return tree_levels(rows, by, path, label, content_hash, fan, ranges)[-1].select(*by, "n", F.col("digest").alias("root"))


def tree_proof(levels: list[DataFrame], leaf: str, group: Column | None = None) -> list[tuple[int, list[str]]]:
    """Of a leaf's digest, on each level its place among its siblings and all their digests; [] if it is no leaf.

    With the group's condition where there are groups.  At most ``fan`` digests
    of each level come to the driver.
    """
    of = [d.where(group) if group is not None else d for d in levels]
    found = of[0].where(F.col("digest") == leaf).agg(F.min("i"), F.max("n")).first()
    if found[0] is None:
        return []
    i, n, out, fan, k = found[0], found[1], [], FAN, 0
    for k, d in enumerate(of[:-1]):
        if k and n <= fan**k:
            break
        near = d.where(F.expr(f"i div {fan}") == i // fan).orderBy("i").select("digest").collect()
        out.append((i % fan, [r.digest for r in near]))
        i //= fan
    return out


def tree_verify(proof: list[tuple[int, list[str]]], leaf: str, root: str) -> bool:
    """Whether a proof leads from the leaf's digest to the root."""
    for place, digests in proof:
        if place >= len(digests) or digests[place] != leaf:
            return False
        leaf = hashlib.sha256("".join(digests).encode()).hexdigest()
    return bool(proof) and leaf == root


#: Rows of one block that a task of a search holds queries against.
SEARCH_ROWS = 20_000


def search(rows: DataFrame, queries: DataFrame, id_col: str, value: str, block: list[str], score, match, salts: int | None = None) -> DataFrame:
    """Rows (id, compared, matched, best_id, best_score): each query against all other rows of its block.

    ``score`` is a column of two values, ``match`` says of a score whether it
    counts.  Rows are dealt by block and one of ``salts`` numbers, and queries
    to all of them, so a common block is many tasks: as many as leave a task
    SEARCH_ROWS rows of the most common block, if not given.  Only counts and
    the best go on.  Nulls in the block match nothing; ties go to the least id; queries
    without another row have no row.
    """
    if salts is None:
        most = rows.groupBy(*block).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        salts = max(1, -(-most // SEARCH_ROWS))
    salt = F.pmod(F.xxhash64(id_col), F.lit(salts))
    q = queries.select(*block, F.col(id_col).alias("_q"), F.col(value).alias("_v"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("_s"))
    pairs = rows.select(*block, id_col, value, salt.cast("long").alias("_s")).join(q, [*block, "_s"]).where(F.col(id_col) != F.col("_q"))
    pairs = pairs.select("_q", id_col, score(F.col("_v"), F.col(value)).alias("_score"))
    best = F.max(F.struct("_score", (-F.col(id_col)).alias("_id")))
    d = pairs.groupBy("_q").agg(F.count("*").alias("compared"), F.count_if(match(F.col("_score"))).alias("matched"), best.alias("_b"))
    return d.select(F.col("_q").alias(id_col), "compared", "matched", (-F.col("_b._id")).alias("best_id"), F.col("_b._score").alias("best_score"))


#: Pairs that one step of a vector search scores.
SEARCH_PAIRS = 1 << 17


def vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(matrix, lengths) of a list column, shorter rows filled with zeros; the length of a row that is null or holds a null is -1."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
    flat = column.flatten()
    row, first = np.repeat(np.arange(len(lengths)), lengths), np.cumsum(lengths) - lengths
    out = np.zeros((len(lengths), int(lengths.max(initial=0))))
    out[row, np.arange(len(row)) - first[row]] = np.asarray(flat.fill_null(0)).astype(np.float64)
    lengths[row[np.asarray(flat.is_null())]] = -1
    lengths[np.asarray(column.is_null())] = -1
    return out, lengths


def vector_search(rows: DataFrame, queries: DataFrame, id_col: str, value: str, block: list[str], score, match, chunk: int | None = None) -> DataFrame:
    """:func:`search` of vectors: rows (id, compared, matched, best_id, best_score), ids whole numbers, scores doubles.

    ``score`` gives a matrix of scores of two (matrix, lengths) as of
    :func:`vectors`, NaN for none; ``match`` says of such scores which count.
    Rows and queries of a block are cut into chunks of about ``chunk`` rows
    (SEARCH_ROWS) of the most common block, every chunk of rows meets every chunk
    of queries in one group, and a group scores SEARCH_PAIRS pairs at a time: a
    task holds two chunks whatever the block's size, and no pair becomes a row.
    """
    chunk = chunk or SEARCH_ROWS
    rows, queries = (d.dropna(subset=[*block, id_col]).select(*block, F.col(id_col).cast("long").alias("_id"), F.col(value).alias("_v")) for d in (rows, queries))
    most = lambda d: d.groupBy(*block).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    n, m = (max(1, -(-most(d) // chunk)) for d in (rows, queries))
    dealt = lambda k: F.pmod(F.xxhash64("_id"), F.lit(k)).cast("int")
    each = lambda k: F.explode(F.array(*map(F.lit, range(k))))
    left = rows.withColumn("_s", dealt(n)).withColumn("_t", each(m))
    right = queries.withColumn("_t", dealt(m)).withColumn("_s", each(n))
    step = SEARCH_PAIRS

    def meet(own: pa.Table, asked: pa.Table) -> pa.Table:
        order = np.argsort(np.asarray(own["_id"]), kind="stable")
        ids, q = np.asarray(own["_id"])[order], np.asarray(asked["_id"])
        (x, x_lengths), (y, y_lengths) = vectors(own["_v"]), vectors(asked["_v"])
        x, x_lengths = x[order], x_lengths[order]
        lo, hi = np.searchsorted(ids, q, "left"), np.searchsorted(ids, q, "right")
        matched, best, place = np.zeros(len(q), np.int64), np.full(len(q), -np.inf), np.where(lo > 0, 0, hi)
        wide = max(1, min(len(ids), 1 << 12))
        high = max(1, step // wide)
        for i in range(0, len(q) if len(ids) else 0, high):
            here = np.arange(i, min(i + high, len(q)))
            for j in range(0, len(ids), wide):
                s = score((y[here], y_lengths[here]), (x[j : j + wide], x_lengths[j : j + wide]))
                for k in here[(lo[here] < j + wide) & (hi[here] > j) & (hi[here] > lo[here])]:  # rows of the query's own id
                    s[k - i, max(lo[k] - j, 0) : hi[k] - j] = np.nan
                matched[here] += match(s).sum(axis=1)
                s[np.isnan(s)] = -np.inf
                top = s.argmax(axis=1)
                value = s[np.arange(len(here)), top]
                more = value > best[here]
                best[here[more]], place[here[more]] = value[more], top[more] + j
        compared = len(ids) - (hi - lo)
        some = compared > 0
        none = np.isneginf(best[some])
        columns = [q[some], compared[some], matched[some], ids[place[some]]]
        return pa.table([*map(pa.array, columns), pa.array(best[some], mask=none)], names=["_q", "compared", "matched", "best_id", "best_score"])

    keys = [*block, "_s", "_t"]
    parts = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "_q long, compared long, matched long, best_id long, best_score double")
    best = F.max(F.struct("best_score", (-F.col("best_id")).alias("_id")))
    d = parts.groupBy("_q").agg(F.sum("compared").alias("compared"), F.sum("matched").alias("matched"), best.alias("_b"))
    return d.select(F.col("_q").alias(id_col), "compared", "matched", (-F.col("_b._id")).alias("best_id"), F.col("_b.best_score").alias("best_score"))


def containers(items: DataFrame) -> DataFrame:
    """Rows (archive, members, analysed, score, band) of paths archive::inner; without an analysed member unknown."""
    rank = F.when(F.col("status") != "analyzed", None).when(F.col("band") == "high", 3).when(F.col("band") == "medium", 2).when(F.col("band") == "low", 1).otherwise(0)
    inner = items.where(F.col("path").contains("::")).withColumn("archive", F.element_at(F.split("path", "::"), 1))
    out = inner.groupBy("archive").agg(F.count("*").alias("members"), F.count_if(F.col("status") == "analyzed").alias("analyzed"), F.max(F.when(F.col("status") == "analyzed", F.col("score"))).alias("score"), F.max(rank).alias("rank"))
    band = F.when(F.coalesce(F.col("rank"), F.lit(0)) == 0, "unknown").otherwise(F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), F.greatest(F.col("rank"), F.lit(1))))
    return out.select("archive", "members", "analyzed", F.coalesce("score", F.lit(0)).alias("score"), band.alias("band"))


def orphans(items: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges (src, dst) with an end that is no item."""
    ids = items.select("item_id")
    miss = lambda c: edges.join(ids, edges[c] == ids["item_id"], "left_anti").withColumn("missing", F.lit(c))
    return miss("src").unionByName(miss("dst"))


def _checkpointed(df: DataFrame) -> DataFrame:
    """Cuts lineage by a checkpoint in the session's shared folder; a local session without one gets a local one."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def ancestors(edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Rows (src, ancestor, depth): the closure of edges (src derived from dst), the shortest way; cycles end.

    Each round carries the pairs that the last one found a step on and keeps
    those that no round had, so it ends when a round adds nothing; pairs of up
    to ``max_depth`` steps if that is given.  All state is checkpointed; only
    whether a round added rows comes to the driver.
    """
    edges = _checkpointed(edges.select("src", "dst").distinct())
    steps = edges.withColumnsRenamed({"src": "via", "dst": "next"})
    frontier = edges.select("src", F.col("dst").alias("ancestor"), F.lit(1).alias("depth"))
    found, depth = [frontier], 1
    while max_depth is None or depth < max_depth:
        depth += 1
        known = reduce(DataFrame.unionByName, found).select(F.col("src").alias("s"), F.col("ancestor").alias("a"))
        reached = frontier.join(steps, F.col("ancestor") == F.col("via")).select("src", F.col("next").alias("ancestor")).distinct()
        frontier = _checkpointed(reached.join(known, F.col("src").eqNullSafe(F.col("s")) & F.col("ancestor").eqNullSafe(F.col("a")), "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        found.append(frontier)
        if len(found) == 16:
            found = [_checkpointed(reduce(DataFrame.unionByName, found))]
    return reduce(DataFrame.unionByName, found)


def reviews(log: DataFrame) -> DataFrame:
    """The current record of each artefact from an event log (artifact_id, ts, star, note, analyst_id, verdict, deleted).

    Later fields override; fields an update leaves null stay; created_at is the
    first event's time; a record whose fields are all blank, or whose last event
    deletes, is gone.
    """
    w = Window.partitionBy("artifact_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = lambda c: F.last(c, True).over(w)
    d = log.select("artifact_id", F.first("ts").over(w).alias("created_at"), F.last("ts").over(w).alias("updated_at"), *[last(c).alias(c) for c in ("star", "note", "analyst_id", "verdict")], F.last("deleted").over(w).alias("deleted"), F.row_number().over(Window.partitionBy("artifact_id").orderBy("ts", "event_id")).alias("rn"))
    blank = F.coalesce("star", F.lit(False)) == False  # noqa: E712
    for c in ("note", "analyst_id", "verdict"):
        blank = blank & (F.trim(F.coalesce(c, F.lit(""))) == "")
    return d.where((F.col("rn") == 1) & ~F.coalesce("deleted", F.lit(False)) & ~blank).drop("rn", "deleted")
