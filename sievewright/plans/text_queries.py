"""Queries of the text rules and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievewright.functions import lexicons as L
from sievewright.functions.columns import mean
from sievewright.operators import text as T
from sievewright.plans.base import oracle, sql


def _notes(spark, sf):
    return sql(spark, sf, "SELECT * FROM notes_base")


def _quoted(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _hits(text: str, words) -> str:
    return " + ".join(f"CAST(contains({text}, '{w}') AS INT)" for w in words)


def _occurrences(text: str, words) -> str:
    return " + ".join(f"CAST((length({text}) - length(replace({text}, '{w}', ''))) // {len(w)} AS INT)" for w in words)


def _starts(words) -> str:
    return "^(" + "|".join(words) + ")"


_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_WORD = r"[\p{L}\p{N}_'']+"
_MEAN = "list_avg({})"

#: Measures of the scan rules in DuckDB.
FEATURES = rf"""
t0 AS (SELECT *, {_TRIM.format("coalesce(text, '')")} AS trimmed FROM notes_base),
t1 AS (SELECT *, regexp_replace(lower(trimmed), '\s+', ' ', 'g') AS normalized FROM t0),
t2 AS (SELECT *,
  list_filter(list_transform(string_split_regex(trimmed, '\r\n|\r|\n'), lambda x: {_TRIM.format("x")}), lambda x: x <> '') AS ls,
  list_filter(list_transform(string_split_regex(trimmed, '[.!?。！？\n]+'), lambda x: {_TRIM.format("x")}), lambda x: length(x) >= 8) AS ss,
  regexp_extract_all(normalized, '{_WORD}') AS ws,
  CASE WHEN len(regexp_extract_all(trimmed, '\p{{L}}')) > 0 THEN len(regexp_extract_all(trimmed, '[가-힣]')) / len(regexp_extract_all(trimmed, '\p{{L}}')) ELSE 0.0 END AS hangul
  FROM t1),
t3 AS (SELECT *,
  len(ws) AS n_words, len(ss) AS n_sentences, len(ls) AS n_lines,
  {_hits("normalized", L.AI_IDENTITY)} AS identity_hits,
  {_hits("normalized", L.TEMPLATE_PHRASES)} AS phrase_hits,
  len(list_filter(ls, lambda x: regexp_matches(x, '^(\d+[).]|[-*•])\s+.+'))) AS list_lines,
  list_transform(ss, lambda x: greatest(1, len(regexp_extract_all(x, '{_WORD}')))) AS lengths,
  len(regexp_extract_all(trimmed, '{L.TYPOGRAPHIC}')) AS typographic,
  list_transform(ls, lambda x: CASE WHEN starts_with(x, '```') THEN 2 WHEN regexp_matches(x, '^(#|\||>|- \[|\* \[)') OR regexp_matches(x, '^</?[a-zA-Z][^>]*>$') OR length(x) - length(replace(x, '`', '')) >= 2 THEN 1 ELSE 0 END) AS kinds,
  regexp_extract_all(normalized, '[\p{{L}}\p{{N}}_]+') AS plain,
  CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) ELSE [] END AS tri
  FROM t2),
feat AS (SELECT *,
  {_MEAN.format("lengths")} AS mean_length,
  list_stddev_pop(lengths) / greatest(1.0, {_MEAN.format("lengths")}) AS length_cv,
  CASE WHEN n_words >= 80 THEN (len(tri) - len(list_distinct(tri))) / greatest(1, len(tri)) END AS repeat_share,
  len(list_intersect(list_distinct(plain), {_quoted(L.PERSONAL_ANCHORS)})) AS anchors,
  regexp_matches(normalized, '\p{{Nd}}') AS has_number,
  CASE WHEN n_lines > 0 THEN len(list_filter(range(1, n_lines + 1), lambda i: kinds[i] > 0 OR len(list_filter(kinds[1:i - 1], lambda k: k = 2)) % 2 = 1)) / n_lines ELSE 0.0 END AS structure,
  CASE WHEN hangul > 0.3 THEN {_occurrences("normalized", L.CONNECTORS_KO)}
       ELSE len(list_filter(ws, lambda x: list_contains({_quoted(L.VOCABULARY_EN)}, x))) + {_occurrences("normalized", L.CONNECTORS_EN)} END AS vocabulary,
  CASE WHEN hangul > 0.3 THEN {" + ".join(f"CAST(contains(normalized, '{a}') AND contains(normalized, '{b}') AS INT)" for a, b in L.HEDGES_KO)}
       ELSE {" + ".join(f"CAST(contains(normalized, '{a}') AND contains(normalized, '{b}') AS INT)" for a, b in L.HEDGES_EN)} END AS hedges,
  CASE WHEN hangul > 0.3 THEN len(list_filter(ss, lambda x: regexp_matches(regexp_replace(lower(x), '^["''\-–— ]+', ''), '{_starts(L.STARTERS_KO)}')))
       ELSE len(list_filter(ss, lambda x: regexp_matches(regexp_replace(lower(x), '^["''\-–— ]+', ''), '{_starts(L.STARTERS_EN)}'))) END AS starters
  FROM t3)
"""

WEIGHTS = {
    "identity": "CASE WHEN identity_hits > 0 THEN 35 END",
    "template_strong": "CASE WHEN phrase_hits >= 4 THEN 22 END",
    "template": "CASE WHEN phrase_hits BETWEEN 2 AND 3 THEN 12 END",
    "list_strong": "CASE WHEN list_lines >= 6 THEN 18 END",
    "list": "CASE WHEN list_lines BETWEEN 3 AND 5 THEN 10 END",
    "uniform": "CASE WHEN n_sentences >= 5 AND mean_length >= 18 AND length_cv < 0.28 THEN 15 END",
    "flat": "CASE WHEN n_sentences >= 5 AND mean_length >= 14 AND length_cv < 0.38 AND NOT (mean_length >= 18 AND length_cv < 0.28) THEN 9 END",
    "repeat_strong": "CASE WHEN repeat_share >= 0.1 THEN 16 END",
    "repeat": "CASE WHEN repeat_share >= 0.055 AND repeat_share < 0.1 THEN 8 END",
    "generic": "CASE WHEN n_words >= 70 AND NOT has_number AND anchors = 0 THEN 8 END",
    "typographic": "CASE WHEN length(trimmed) >= 200 AND typographic >= 6 AND typographic / length(trimmed) > 0.002 THEN 12 END",
    "connectors_ko": "CASE WHEN hangul > 0.3 AND n_words >= 60 AND vocabulary >= 3 AND vocabulary * 1000 / greatest(n_words, 1) > 4 THEN 12 END",
    "vocabulary": "CASE WHEN hangul <= 0.3 AND n_words >= 60 AND vocabulary >= 4 AND vocabulary * 1000 / greatest(n_words, 1) > 5 THEN 15 END",
    "hedging": "CASE WHEN n_sentences >= 4 AND hedges >= 2 THEN 10 END",
    "starters": "CASE WHEN n_sentences >= 6 AND starters >= 3 AND starters / n_sentences > 0.3 THEN 10 END",
}
_STRUCTURE = ("list_strong", "list", "uniform", "flat")


def _gated(name: str) -> str:
    w = WEIGHTS[name]
    return f"coalesce(CASE WHEN structure >= 0.4 THEN greatest(2, CAST(trunc(({w}) * 0.4) AS INT)) ELSE {w} END * CAST(({w}) IS NOT NULL AS INT), 0)" if name in _STRUCTURE else f"coalesce({w}, 0)"


_REST = " + ".join(_gated(n) for n in WEIGHTS if n != "identity")
_VENDOR = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(normalized, {chr(39)}{n}{chr(39)})' for n in names)} THEN '{label}'" for label, names in L.TEXT_VENDORS) + " WHEN identity_hits > 0 THEN 'AI 어시스턴트 문체 추정' ELSE '알 수 없음' END"
SCAN = f"""{FEATURES},
part AS (SELECT *, {_gated("identity")} AS own, {_REST} AS rest, {" + ".join(f"CAST(({WEIGHTS[n]}) IS NOT NULL AS INT)" for n in WEIGHTS)} AS n_signals, {_VENDOR} AS guess FROM feat),
scanned AS (SELECT *, CASE WHEN length(trimmed) = 0 THEN 0 ELSE least(100, own + CASE WHEN length(trimmed) < 240 THEN least(rest, 66) ELSE rest END) END AS score FROM part),
banded AS (SELECT *, CASE WHEN length(trimmed) = 0 OR (length(trimmed) < 24 AND n_signals = 0 AND guess = '알 수 없음') THEN 'unknown' WHEN score >= 67 THEN 'high' WHEN score >= 35 THEN 'medium' ELSE 'low' END AS band FROM scanned)"""


def _measure(*columns, rules=()):
    """A query of some measures and rule weights over the notes, and its SQL."""

    def query(spark, sf):
        d = T.features(_notes(spark, sf))
        out = [F.round(F.col(c).cast("double"), 6).alias(c) for c in columns]
        return d.select("doc_id", *out, *[F.coalesce(T.rule_weights()[r][1], F.lit(0)).alias(f"w_{r}") for r in rules])

    picks = [f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in columns] + [f"coalesce({WEIGHTS[r]}, 0) AS w_{r}" for r in rules]
    return query, oracle(f"WITH {FEATURES} SELECT doc_id, {', '.join(picks)} FROM feat")


def txt26_scan(spark, sf):
    d = T.scan(_notes(spark, sf))
    return d.select("doc_id", "score", "band", F.size("signals").alias("n_signals"), F.col("source_guess.label").alias("guess"))


def flagship(spark, sf):
    """Scan scores of all texts, summed up by language."""
    d = T.scan(_notes(spark, sf))
    return d.groupBy("lang").agg(
        F.count("*").alias("items"),
        *[F.count_if(F.col("band") == b).alias(b) for b in ("high", "medium", "low", "unknown")],
        F.sum("score").alias("score_sum"),
    )


def flt2_capped(spark, sf):
    d = T.scan(_notes(spark, sf))
    return d.select("doc_id", (F.length("trimmed") < 240).alias("capped"), "score", F.size("signals").alias("n_signals"))


def txt3_particles(spark, sf):
    p = T.prepare_advanced(_notes(spark, sf))
    return p.select("doc_id", F.array_join("words", " ").alias("words"))


_PARTICLES = "CASE " + " ".join(
    f"WHEN right(w, {n}) IN ({', '.join(repr(p) for p in sorted(set(x for x in L.KO_PARTICLES if len(x) == n)))}) AND length(w) > {n + 1} THEN left(w, length(w) - {n})"
    for n in sorted({len(x) for x in L.KO_PARTICLES}, reverse=True)
) + " ELSE w END"

#: Measures of the advanced rules in DuckDB.
ADVANCED = rf"""
a0 AS (SELECT *, {_TRIM.format("coalesce(text, '')")} AS trimmed FROM notes_base),
a1 AS (SELECT *, lower(trimmed) AS low, CASE WHEN len(regexp_extract_all(trimmed, '\p{{L}}')) > 0 THEN len(regexp_extract_all(trimmed, '[가-힣ᄀ-ᇿ]')) / len(regexp_extract_all(trimmed, '\p{{L}}')) ELSE 0.0 END AS hangul FROM a0),
a2 AS (SELECT *,
  CASE WHEN hangul > 0.3 THEN list_transform(regexp_extract_all(low, '{_WORD}'), lambda w: {_PARTICLES}) ELSE regexp_extract_all(low, '{_WORD}') END AS ws,
  list_filter(list_transform(string_split_regex(trimmed, '[.!?。！？\n]+'), lambda x: {_TRIM.format("x")}), lambda x: length(x) >= 5) AS ss,
  list_filter(string_split_regex(low, '\s+'), lambda x: x <> '') AS tokens,
  list_filter(string_split_regex(trimmed, '\r\n|\r|\n'), lambda x: {_TRIM.format("x")} <> '') AS ls
  FROM a1),
a3 AS (SELECT *, len(ws) AS n_words, len(ss) AS n_sentences, len(ls) AS n_lines, len(tokens) AS n_tokens,
  list_transform(ss, lambda x: len(list_filter(string_split_regex(x, '\s+'), lambda y: y <> ''))) AS lengths,
  len(list_filter(ls, lambda x: regexp_matches(x, '^\s*(#{{1,6}}\s|[-*•]\s|\d+[.)]\s|>\s)') OR regexp_matches({_TRIM.format("x")}, '^```'))) AS n_marked,
  len(regexp_extract_all(trimmed, '\*\*[^*]+\*\*')) AS bold,
  len(regexp_extract_all(trimmed, '{L.TYPOGRAPHIC}')) AS typographic,
  len(list_filter(tokens, lambda x: list_contains({_quoted(L.TRANSITIONS)}, x))) AS transitions,
  len(list_filter(ws, lambda x: list_contains({_quoted(L.PERSONAL_ANCHORS_WIDE)}, x))) AS anchors,
  CASE WHEN hangul > 0.3 THEN {_occurrences("low", L.CONNECTORS_KO)}
       ELSE len(list_filter(ws, lambda x: list_contains({_quoted(L.VOCABULARY_EN_WIDE)}, x))) + {_occurrences("low", L.CONNECTORS_EN)} END AS vocabulary,
  CASE WHEN hangul > 0.3 THEN {" + ".join(f"CAST(contains(low, '{a}') AND contains(low, '{b}') AS INT)" for a, b in L.HEDGES_KO)}
       ELSE {" + ".join(f"CAST(contains(low, '{a}') AND contains(low, '{b}') AS INT)" for a, b in L.HEDGES_EN)} END AS hedges,
  CASE WHEN hangul > 0.3 THEN len(list_filter(ss, lambda x: regexp_matches(regexp_replace(lower(x), '^["''\-–— ]+', ''), '{_starts(L.STARTERS_KO)}')))
       ELSE len(list_filter(ss, lambda x: regexp_matches(regexp_replace(lower(x), '^["''\-–— ]+', ''), '{_starts(L.STARTERS_EN)}'))) END AS starters,
  {_occurrences("trimmed", (*L.KO_PLURALS, *L.KO_PASSIVES, *L.KO_PRONOUNS))} + len(regexp_extract_all(trimmed, '[가-힣]+의\s+[가-힣]+의\s+[가-힣]+')) AS translationese,
  len(list_filter(ss, lambda x: regexp_matches(x, '{"|".join(L.KO_ENDINGS)}'))) AS endings,
  {_hits("trimmed", L.KO_STOCK)} AS stock
  FROM a2),
words AS (SELECT doc_id, unnest(ws) AS g FROM a3),
pairs AS (SELECT doc_id, unnest(CASE WHEN n_words >= 2 THEN list_transform(range(1, n_words), lambda i: ws[i] || ' ' || ws[i + 1]) ELSE [] END) AS g FROM a3),
triples AS (SELECT doc_id, unnest(CASE WHEN n_words >= 3 THEN list_transform(range(1, n_words - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) ELSE [] END) AS g FROM a3),
c1 AS (SELECT doc_id, count(*) AS distinct_words, count(*) FILTER (WHERE c = 1) AS hapax FROM (SELECT doc_id, g, count(*) AS c FROM words GROUP BY ALL) GROUP BY doc_id),
c2 AS (SELECT doc_id, -sum(c / n * log2(c / n)) AS entropy FROM (SELECT doc_id, g, count(*) AS c, sum(count(*)) OVER (PARTITION BY doc_id) AS n FROM pairs GROUP BY doc_id, g) GROUP BY doc_id),
c3 AS (SELECT doc_id, count(*) AS trigrams, count(*) FILTER (WHERE c > 1) AS trigrams_repeated FROM (SELECT doc_id, g, count(*) AS c FROM triples GROUP BY ALL) GROUP BY doc_id),
adv AS (SELECT a3.*, coalesce(entropy, 0.0) AS entropy, coalesce(trigrams, 0) AS trigrams, coalesce(trigrams_repeated, 0) AS trigrams_repeated, coalesce(distinct_words, 0) AS distinct_words, coalesce(hapax, 0) AS hapax,
  list_stddev_pop(lengths) / greatest(1.0, list_avg(lengths)) AS burst,
  CASE WHEN n_sentences >= 3 THEN len(list_filter(range(3, n_sentences + 1), lambda i: (lengths[i] - lengths[i - 1]) * (lengths[i - 1] - lengths[i - 2]) < 0)) ELSE 0 END AS flips
  FROM a3 LEFT JOIN c1 USING (doc_id) LEFT JOIN c2 USING (doc_id) LEFT JOIN c3 USING (doc_id))
"""

ADVANCED_WEIGHTS = {
    "entropy_low": "n_words > 100 AND entropy < 4 THEN 20",
    "entropy_high": "n_words >= 20 AND entropy > 8 THEN 15",
    "burstiness": "n_sentences > 10 AND burst < 0.3 THEN 18",
    "alternation": "n_sentences >= 6 AND flips / greatest(n_sentences - 2, 1) > 0.85 THEN 10",
    "trigrams": "n_words > 100 AND trigrams_repeated / greatest(1, trigrams) > 0.3 THEN 15",
    "transitions": "n_tokens >= 30 AND transitions / greatest(n_tokens, 1) > 0.05 THEN 12",
    "anchors": "n_words > 200 AND anchors / n_words < 0.005 THEN 8",
    "markdown": "n_lines >= 4 AND (n_marked / greatest(1, n_lines) > 0.4 OR (n_marked / greatest(1, n_lines) > 0.25 AND bold >= 3)) THEN 14",
    "typographic": "length(trimmed) >= 200 AND typographic >= 6 AND typographic / length(trimmed) > 0.002 THEN 12",
    "connectors_ko": "hangul > 0.3 AND n_words >= 60 AND vocabulary >= 3 AND vocabulary * 1000 / greatest(n_words, 1) > 4 THEN 12",
    "vocabulary": "hangul <= 0.3 AND n_words >= 60 AND vocabulary >= 4 AND vocabulary * 1000 / greatest(n_words, 1) > 5 THEN 15",
    "hedging": "n_sentences >= 4 AND hedges >= 2 THEN 10",
    "starters": "n_sentences >= 6 AND starters >= 3 AND starters / n_sentences > 0.3 THEN 10",
    "translationese": "hangul > 0.3 AND n_words >= 20 AND translationese >= 3 THEN 14",
    "endings": "hangul > 0.3 AND n_sentences >= 4 AND endings >= 3 AND endings / n_sentences >= 0.28 THEN 14",
    "stock": "hangul > 0.3 AND n_words >= 20 AND stock >= 2 THEN 12",
    "diversity_ko": "hangul > 0.3 AND n_words >= 50 AND distinct_words / n_words > 0.8 AND hapax / n_words > 0.8 THEN 10",
}


def _advanced(*columns, rules=(), only=None):
    def query(spark, sf):
        d = T.advanced_features(_notes(spark, sf))
        out = [F.round(F.col(c).cast("double"), 6).alias(c) for c in columns]
        return d.select("doc_id", *out, *[F.coalesce(T.advanced_weights()[r][1], F.lit(0)).alias(f"w_{r}") for r in rules])

    picks = [f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in columns] + [f"CASE WHEN {ADVANCED_WEIGHTS[r]} ELSE 0 END AS w_{r}" for r in rules]
    return query, oracle(f"WITH {ADVANCED} SELECT doc_id, {', '.join(picks)} FROM adv")


def txt15_burstiness(spark, sf):
    d = T.advanced_features(_notes(spark, sf))
    return d.select("doc_id", F.round(mean(F.col("lengths")), 6).alias("mean_words"), F.coalesce(T.advanced_weights()["burstiness"][1], F.lit(0)).alias("w_burstiness"))


_STYLE = "CASE WHEN length(trimmed) = 0 THEN 'empty' WHEN n_words < 20 THEN 'short' " + " ".join(f"WHEN {_hits('low', m)} >= {n} THEN '{name}'" for name, n, m in L.STYLES) + " ELSE 'general' END"


def txt24_style(spark, sf):
    return T.advanced_features(_notes(spark, sf)).select("doc_id", T.style().alias("style"))


def txt25_advanced(spark, sf):
    """Advanced scan; the English diversity rule's MTLD is compared in txt17_mtld and left out of the compared sum."""
    d = T.scan_advanced(_notes(spark, sf))
    rest = F.aggregate(F.filter("signals", lambda s: s["title"] != "보통 어휘 다양성"), F.lit(0), lambda a, s: a + s["weight"])
    return d.select("doc_id", F.least(F.lit(100), rest).alias("score_without_mtld"), T.style().alias("style"))


def txt17_mtld(spark, sf):
    d = T.prepare_advanced(_notes(spark, sf))
    return d.select("doc_id", F.size("words").alias("n_words"), F.round(T.mtld(F.col("words")), 6).alias("mtld"))


def txt28_stylometry(spark, sf):
    """Each document whose id is divisible by 20 against all others of its source and language: how many it was held against, how many may be of its author, and the nearest."""
    from sievewright.operators.records import vector_search

    v = T.stylometry(sql(spark, sf, "SELECT doc_id, source, lang, text FROM documents"), keep=("source", "lang"))
    d = vector_search(v, v.where("doc_id % 20 = 0"), "doc_id", "vector", ["source", "lang"], lambda a, b: -T.style_distances(a, b), lambda s: T.same_authors(-s))
    score, kind = T.same_author(-F.col("best_score"))
    return d.select("doc_id", "compared", "matched", "best_id", (-F.col("best_score")).alias("distance"), score.alias("score"), kind.alias("band"))


def txt29_prose(spark, sf):
    return _notes(spark, sf).select("doc_id", T.prose(F.col("text")).alias("prose"))


def txt1_parts(spark, sf):
    d = T.prepare(_notes(spark, sf))
    return d.select("doc_id", F.size("lines").alias("n_lines"), F.size("sentences").alias("n_sentences"), F.size("words").alias("n_words"), F.md5("normalized").alias("normalized_md5"))


def txt2_hangul(spark, sf):
    d = T.prepare(_notes(spark, sf))
    from sievewright.functions.columns import hangul_share

    return d.select("doc_id", F.round("hangul", 6).alias("syllables"), F.round(hangul_share(F.col("trimmed"), True), 6).alias("with_jamo"))


def txt27_source(spark, sf):
    d = T.features(_notes(spark, sf))
    guess = T.text_source(F.col("vendors"), F.col("identity_hits"))
    return d.select("doc_id", guess["label"].alias("label"), guess["confidence"].alias("confidence"))


PAIRS = {
    "txt4_identity": _measure("identity_hits", rules=("identity",)),
    "txt5_templates": _measure("phrase_hits", rules=("template_strong", "template")),
    "txt6_lists": _measure("list_lines", rules=("list_strong", "list")),
    "txt7_uniformity": _measure("mean_length", "length_cv", rules=("uniform", "flat")),
    "txt8_shingles": _measure("repeat_share", rules=("repeat_strong", "repeat")),
    "txt9_anchors": _measure("anchors", rules=("generic",)),
    "txt10_typographic": _measure("typographic", rules=("typographic",)),
    "txt11_vocabulary": _measure("vocabulary", rules=("vocabulary", "connectors_ko")),
    "txt12_hedging": _measure("hedges", rules=("hedging",)),
    "txt13_starters": _measure("starters", rules=("starters",)),
    "flt7_structure": _measure("structure", "n_lines"),
    "txt14_entropy": _advanced("entropy", rules=("entropy_low", "entropy_high")),
    "txt16_diversity": _advanced("distinct_words", "hapax", rules=("diversity_ko",)),
    "txt18_alternation": _advanced("flips", rules=("alternation",)),
    "txt19_trigrams": _advanced("trigrams", "trigrams_repeated", rules=("trigrams",)),
    "txt20_transitions": _advanced("transitions", "n_tokens", rules=("transitions",)),
    "txt21_anchor_density": _advanced("anchors", rules=("anchors",)),
    "txt22_markdown": _advanced("n_marked", "bold", rules=("markdown",)),
    "txt23_korean": _advanced("translationese", "endings", "stock", rules=("translationese", "endings", "stock")),
}

QUERIES = {name: q for name, (q, _) in PAIRS.items()} | {
    f.__name__: f for f in (txt1_parts, txt2_hangul, txt3_particles, txt15_burstiness, txt17_mtld, txt24_style, txt25_advanced, txt26_scan, txt27_source, txt28_stylometry, txt29_prose, flt2_capped, flagship)
}

SQL = {name: s for name, (_, s) in PAIRS.items()} | {
    "txt1_parts": oracle(f"WITH {FEATURES} SELECT doc_id, n_lines, n_sentences, n_words, md5(normalized) AS normalized_md5 FROM feat"),
    "txt2_hangul": oracle(rf"WITH {FEATURES} SELECT doc_id, round(hangul, 6) AS syllables, round(CASE WHEN len(regexp_extract_all(trimmed, '\p{{L}}')) > 0 THEN len(regexp_extract_all(trimmed, '[가-힣ᄀ-ᇿ]')) / len(regexp_extract_all(trimmed, '\p{{L}}')) ELSE 0.0 END, 6) AS with_jamo FROM feat"),
    "txt3_particles": oracle(f"WITH {ADVANCED} SELECT doc_id, array_to_string(ws, ' ') AS words FROM a2"),
    "txt15_burstiness": oracle(f"WITH {ADVANCED} SELECT doc_id, round(list_avg(lengths), 6) AS mean_words, CASE WHEN {ADVANCED_WEIGHTS['burstiness']} ELSE 0 END AS w_burstiness FROM adv"),
    "txt24_style": oracle(f"WITH {ADVANCED} SELECT doc_id, {_STYLE} AS style FROM adv"),
    "txt25_advanced": oracle(f"WITH {ADVANCED} SELECT doc_id, least(100, {' + '.join(f'CASE WHEN {w} ELSE 0 END' for w in ADVANCED_WEIGHTS.values())}) AS score_without_mtld, {_STYLE} AS style FROM adv"),
    "txt26_scan": oracle(f"WITH {SCAN} SELECT doc_id, score, band, n_signals, guess FROM banded"),
    "txt27_source": oracle(f"WITH {SCAN} SELECT doc_id, guess AS label, CASE WHEN guess = '알 수 없음' THEN 'unknown' ELSE 'medium' END AS confidence FROM banded"),
    "flt2_capped": oracle(f"WITH {SCAN} SELECT doc_id, length(trimmed) < 240 AS capped, score, n_signals FROM banded"),
    "flagship": oracle(f"""WITH {SCAN} SELECT lang, count(*) AS items, count(*) FILTER (WHERE band = 'high') AS high, count(*) FILTER (WHERE band = 'medium') AS medium,
        count(*) FILTER (WHERE band = 'low') AS low, count(*) FILTER (WHERE band = 'unknown') AS unknown, CAST(sum(score) AS BIGINT) AS score_sum FROM banded GROUP BY lang"""),
    "txt17_mtld": oracle(f"""WITH RECURSIVE {ADVANCED},
        w AS (SELECT doc_id, generate_subscripts(ws, 1) AS i, unnest(ws) AS g FROM a3),
        p AS (SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id, g ORDER BY i), 0) AS last, count(*) OVER (PARTITION BY doc_id) AS n FROM w),
        walk AS (SELECT doc_id, CAST(0 AS BIGINT) AS i, CAST(1 AS BIGINT) AS s, CAST(0 AS BIGINT) AS kinds, 0.0::DOUBLE AS f FROM a3 WHERE n_words > 0
          UNION ALL SELECT p.doc_id, p.i, CASE WHEN ended THEN p.i + 1 ELSE s END, CASE WHEN ended THEN 0 ELSE k END, CASE WHEN ended THEN f + 1 ELSE f END
          FROM (SELECT p.doc_id, p.i, s, f, kinds + CAST(p.last < s AS BIGINT) AS k, (kinds + CAST(p.last < s AS BIGINT)) / (p.i - s + 1) <= 0.72 AS ended FROM walk JOIN p ON p.doc_id = walk.doc_id AND p.i = walk.i + 1) p),
        ends AS (SELECT doc_id, i AS n, f + CASE WHEN s <= i THEN (1 - kinds / (i - s + 1)) / (1 - 0.72) ELSE 0 END AS f FROM walk JOIN (SELECT DISTINCT doc_id, n FROM p) USING (doc_id) WHERE i = n)
        SELECT a3.doc_id, n_words, round(CASE WHEN coalesce(f, 0) > 0 THEN n_words / f ELSE CAST(n_words AS DOUBLE) END, 6) AS mtld FROM a3 LEFT JOIN ends USING (doc_id)"""),
    "txt29_prose": oracle(rf"""WITH a AS (SELECT doc_id, text, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?s)```.*?```', ' ', 'g'), '`[^`\n]*`', ' ', 'g'), '!?\[([^\]]*)\]\([^)]*\)', '\1', 'g'), 'https?://\S+', ' ', 'g'), '<[^>]+>', ' ', 'g') AS x FROM notes_base),
        b AS (SELECT doc_id, text, {_TRIM.format("regexp_replace(array_to_string(list_transform(list_filter(string_split(x, chr(10)), lambda s: NOT regexp_matches(" + _TRIM.format("s") + r", '^\|')), lambda s: regexp_replace(s, '^\s*(#{1,6}\s+|[-*•]\s+|\d+[.)]\s+|>\s*)', '')), chr(10)), '\*\*|__', '', 'g')")} AS o FROM a)
        SELECT doc_id, CASE WHEN length(o) < 200 THEN text ELSE o END AS prose FROM b"""),
}
SIGNALS = f"{SCAN}, signals AS (SELECT doc_id, unnest([" + ", ".join(f"{{'title': '{T.RULE_TITLES[n]}', 'weight': CASE WHEN ({WEIGHTS[n]}) IS NOT NULL THEN {_gated(n)} END}}" for n in WEIGHTS) + "], recursive := true) FROM banded)"
