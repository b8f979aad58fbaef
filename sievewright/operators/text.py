"""Text rules: features of a text as columns, rules as cases, scores and bands."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.functions import lexicons as L
from sievewright.functions.columns import (
    WORD,
    alternation,
    band,
    capped_score,
    deviation,
    hangul_share,
    matches,
    mean,
    occurrences,
    safe_divide,
    signal,
    signals,
    total,
    trimmed,
    weighed,
)
from sievewright.operators import matching
from sievewright.operators.wordmeasures import measured
from sievewright.operators.wordstats import word_statistics

SENTENCE_END = r"[.!?。！？\n]+"
STRUCTURE_TITLES = ("과도하게 균일한 목록 구조", "목록 중심 구성", "문장 길이 균일성", "낮은 문장 변주")


def sentences(text: Column, least: int = 1) -> Column:
    """Trimmed pieces between sentence ends, of at least so many letters."""
    return F.filter(F.transform(F.split(text, SENTENCE_END), trimmed), lambda s: F.length(s) >= least)


def lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\r\n|\r|\n"), trimmed), lambda s: s != "")


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def grams(w: Column, n: int) -> Column:
    """64-bit hashes of the n-word shingles of a word array: short keys to count and to shuffle."""
    hashed = F.transform(w, lambda x: F.xxhash64(x))
    if n == 1:
        return hashed
    whole = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)]))
    return F.when(F.size(w) >= n, whole).otherwise(F.array().cast("array<bigint>"))


def prepare(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds trimmed, normalized, lines, sentences (8 letters or more), words and the Hangul share."""
    text = trimmed(F.coalesce(F.col(text_col), F.lit("")))
    out = docs.withColumn("trimmed", text).withColumn("normalized", F.regexp_replace(F.lower("trimmed"), r"[^\S ]\s*| \s+", " "))  # all runs but single spaces
    return out.withColumns({"lines": lines(F.col("trimmed")), "sentences": sentences(F.col("trimmed"), 8), "words": words(F.col("normalized")), "hangul": hangul_share(F.col("trimmed"))})


def structure_share(rows: Column) -> Column:
    """Share of lines that are fences, fenced, headings, tables, quotes, tags or inline code."""
    plain = lambda s: s.rlike(r"^(#|\||>|- \[|\* \[)") | s.rlike(r"^</?[a-zA-Z][^>]*>$") | (occurrences(s, "`") >= 2)
    state = F.struct(F.lit(False).alias("fenced"), F.lit(0).alias("n"))

    def step(a, s):
        fence = F.startswith(s, F.lit("```"))
        return F.struct((a["fenced"] != fence).alias("fenced"), (a["n"] + (fence | a["fenced"] | plain(s)).cast("int")).alias("n"))

    return F.when(F.size(rows) > 0, F.aggregate(rows, state, step)["n"] / F.size(rows)).otherwise(F.lit(0.0))


def features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds to the prepared columns the measures that the scan rules look at."""
    d = prepare(docs, text_col)
    n, rows = F.col("normalized"), F.col("lines")
    ko = F.col("hangul") > 0.3
    measure = measured(docs.sparkSession, {"vocabulary": L.VOCABULARY_EN}, {"anchors": L.PERSONAL_ANCHORS})
    d = d.withColumns({"_c": phrase_counts(docs)(n), "_m": measure(F.col("trimmed"), n)})
    d = d.withColumn("hangul", measured_hangul())
    d = d.withColumns(
        {
            "n_words": F.col("_m.n_words").cast("int"),
            "n_sentences": F.col("_m.n_sentences").cast("int"),
            "n_lines": F.size(rows),
            "identity_hits": F.col("_c.identity_kinds"),
            "phrase_hits": F.col("_c.template_kinds"),
            "vendors": F.array(*[F.col(f"_c.vendor{i}_kinds") for i in range(len(L.TEXT_VENDORS))]),
            "list_lines": F.size(F.filter(rows, lambda x: x.rlike(r"^(\d+[).]|[-*•])\s+.+"))),
            "mean_length": F.when(F.col("_m.n_sentences") > 0, F.col("_m.sentence_words") / F.col("_m.n_sentences")),
            "typographic": F.col("_m.typographic").cast("int"),
            "structure": structure_share(rows),
        }
    )
    return d.withColumns(
        {
            "length_cv": F.when(F.col("_m.n_sentences") > 0, F.sqrt(F.greatest(F.col("_m.sentence_squares") / F.when(F.col("_m.n_sentences") > 0, F.col("_m.n_sentences")) - F.col("mean_length") * F.col("mean_length"), F.lit(0.0))) / F.greatest(F.lit(1.0), "mean_length")),
            "repeat_share": F.when(F.col("n_words") >= 80, (F.col("_m.n_trigrams") - F.col("_m.trigrams")) / F.greatest(F.lit(1), F.col("_m.n_trigrams"))),
            "anchors": F.col("_m.anchors").cast("int"),
            "has_number": n.rlike(r"\p{Nd}"),
            "vocabulary": F.when(ko, F.col("_c.connectors_ko_times")).otherwise(F.col("_m.vocabulary").cast("int") + F.col("_c.connectors_en_times")),
            "hedges": hedges(ko),
            "starters": F.col("_m.starters").cast("int"),
        }
    ).drop("_c", "_m")


def measured_hangul(jamo: bool = False) -> Column:
    """The share of :func:`hangul_share` from the letters counted in ``_m``."""
    own = F.col("_m.hangul") + F.col("_m.jamo") if jamo else F.col("_m.hangul")
    return F.when(F.col("_m.letters") > 0, own / F.col("_m.letters")).otherwise(F.lit(0.0))


def phrase_counts(docs: DataFrame):
    """The function that counts the phrases of all lists of the text rules in one pass over a text."""
    lists = {"identity": L.AI_IDENTITY, "template": L.TEMPLATE_PHRASES, "connectors_ko": L.CONNECTORS_KO, "connectors_en": L.CONNECTORS_EN}
    lists |= {f"vendor{i}": names for i, (_, names) in enumerate(L.TEXT_VENDORS)}
    lists |= {f"style{i}": markers for i, (_, _, markers) in enumerate(L.STYLES)}
    lists |= {f"hedge_{lang}{i}{side}": (phrase,) for lang, pairs in (("ko", L.HEDGES_KO), ("en", L.HEDGES_EN)) for i, pair in enumerate(pairs) for side, phrase in zip("ab", pair, strict=True)}
    return matching.counted(docs.sparkSession, lists)


def hedges(ko: Column) -> Column:
    """Pairs of phrases that both occur, of :func:`phrase_counts` in ``_c``."""
    both = lambda lang, i: ((F.col(f"_c.hedge_{lang}{i}a_kinds") > 0) & (F.col(f"_c.hedge_{lang}{i}b_kinds") > 0)).cast("int")
    return F.when(ko, total([both("ko", i) for i in range(len(L.HEDGES_KO))])).otherwise(total([both("en", i) for i in range(len(L.HEDGES_EN))]))


#: Titles of the text scan's rules.
RULE_TITLES = {
    "identity": "AI 자기표현 문구",
    "template_strong": "템플릿형 문장 전개",
    "template": "정형화된 연결 문구",
    "list_strong": "과도하게 균일한 목록 구조",
    "list": "목록 중심 구성",
    "uniform": "문장 길이 균일성",
    "flat": "낮은 문장 변주",
    "repeat_strong": "반복 어구",
    "repeat": "약한 반복 패턴",
    "generic": "개인 맥락 부족",
    "typographic": "타이포그래픽 구두점",
    "connectors_ko": "모델형 연결어 밀도(한국어)",
    "vocabulary": "LLM 과용 어휘",
    "hedging": "양면 균형 헤징 구조",
    "starters": "문두 접속사 균일성",
}


def rule_weights() -> dict[str, tuple[str, Column]]:
    """The rules' names, titles and weights (null where a rule does not hold) over :func:`features`.

    A rule with two strengths has two entries, of which one at most holds.
    """
    c = F.col
    size = F.length("trimmed")
    per_thousand = c("vocabulary") * 1000 / F.greatest(c("n_words"), F.lit(1))
    ko = c("hangul") > 0.3
    strong_list, strong_repeat = c("list_lines") >= 6, c("repeat_share") >= 0.1
    even = (c("n_sentences") >= 5) & (c("mean_length") >= 18) & (c("length_cv") < 0.28)
    flat = (c("n_sentences") >= 5) & (c("mean_length") >= 14) & (c("length_cv") < 0.38) & ~even
    weights = {
        "identity": weighed((c("identity_hits") > 0, 35)),
        "template_strong": weighed((c("phrase_hits") >= 4, 22)),
        "template": weighed((c("phrase_hits").between(2, 3), 12)),
        "list_strong": weighed((strong_list, 18)),
        "list": weighed((c("list_lines").between(3, 5), 10)),
        "uniform": weighed((even, 15)),
        "flat": weighed((flat, 9)),
        "repeat_strong": weighed((strong_repeat, 16)),
        "repeat": weighed(((c("repeat_share") >= 0.055) & ~strong_repeat, 8)),
        "generic": weighed(((c("n_words") >= 70) & ~c("has_number") & (c("anchors") == 0), 8)),
        "typographic": weighed(((size >= 200) & (c("typographic") >= 6) & (c("typographic") / size > 0.002), 12)),
        "connectors_ko": weighed((ko & (c("n_words") >= 60) & (c("vocabulary") >= 3) & (per_thousand > 4), 12)),
        "vocabulary": weighed((~ko & (c("n_words") >= 60) & (c("vocabulary") >= 4) & (per_thousand > 5), 15)),
        "hedging": weighed(((c("n_sentences") >= 4) & (c("hedges") >= 2), 10)),
        "starters": weighed(((c("n_sentences") >= 6) & (c("starters") >= 3) & (c("starters") / c("n_sentences") > 0.3), 10)),
    }
    return {name: (RULE_TITLES[name], weight) for name, weight in weights.items()}


def model_weight(score: Column) -> Column:
    """Weight of an external model's score."""
    return weighed((score >= 82, 67), (score >= 65, 42), (score >= 45, 24))


def text_source(vendors: Column, identity_hits: Column) -> Column:
    """(label, confidence): a vendor's name in the text (``vendors``, names found of each), then a self-description, else unknown."""
    guess = lambda label, level: F.struct(F.lit(label).alias("label"), F.lit(level).alias("confidence"))
    out = None
    for i, (label, _) in enumerate(L.TEXT_VENDORS):
        found = F.get(vendors, F.lit(i)) > 0
        out = F.when(found, guess(label, "medium")) if out is None else out.when(found, guess(label, "medium"))
    return out.when(identity_hits > 0, guess("AI 어시스턴트 문체 추정", "medium")).otherwise(guess("알 수 없음", "unknown"))


def scan(docs: DataFrame, text_col: str = "text", model_score: Column | None = None) -> DataFrame:
    """Adds signals, score, band and source guess of the text scan to every row.

    Texts shorter than 240 letters are capped at 66 but for the self-description;
    structure rules count for 0.4 (2 at least) where 0.4 or more of the lines are
    technical structure.  Empty texts, and texts under 24 letters without any
    signal, source or model, are unknown.
    """
    d = features(docs, text_col)
    technical = F.col("structure") >= 0.4
    rows = []
    for title, weight in rule_weights().values():
        if title in STRUCTURE_TITLES:
            weight = F.when(technical & weight.isNotNull(), F.greatest(F.lit(2), (weight * 0.4).cast("int"))).otherwise(weight)
        rows.append(signal(title, weight))
    if model_score is not None:
        for title, low, high, weight in (("외부 모델 강한 의심", 82, 101, 67), ("외부 모델 의심", 65, 82, 42), ("외부 모델 약한 의심", 45, 65, 24)):
            rows.append(signal(title, weighed(((model_score >= low) & (model_score < high), weight))))
    d = d.withColumn("signals", signals(*rows)).withColumn("source_guess", text_source(F.col("vendors"), F.col("identity_hits")))
    size = F.length("trimmed")
    cap = F.when(size < 240, 66)
    bare = (F.size("signals") == 0) & (F.col("source_guess.confidence") == "unknown")
    unknown = (size == 0) | ((size < 24) & bare & (F.lit(True) if model_score is None else model_score.isNull()))
    d = d.withColumn("score", F.when(size == 0, 0).otherwise(capped_score(F.col("signals"), cap, ("AI 자기표현 문구",))))
    return d.withColumn("band", band(F.col("score"), unknown=unknown))


# Advanced rules


def advanced_words(text: Column, hangul: Column) -> Column:
    """Lower-cased words; in Hangul-heavy texts without one trailing particle, the longest that leaves two letters."""
    w = words(F.lower(text))

    def strip(x):
        out = x
        by_length: dict[int, list[str]] = {}
        for p in L.KO_PARTICLES:
            by_length.setdefault(len(p), []).append(p)
        for n in sorted(by_length):
            fits = F.right(x, F.lit(n)).isin(*sorted(set(by_length[n]))) & (F.length(x) > n + 1)
            out = F.when(fits, F.left(x, F.length(x) - n)).otherwise(out)
        return out

    return F.when(hangul > 0.3, F.transform(w, strip)).otherwise(w)


def mtld(w: Column) -> Column:
    """Words by factor count; a factor ends where distinct words are 0.72 of its words or fewer."""
    return word_statistics(w)["mtld"]


def prepare_advanced(docs: DataFrame, text_col: str = "text") -> DataFrame:
    text = trimmed(F.coalesce(F.col(text_col), F.lit("")))
    out = docs.withColumn("trimmed", text).withColumn("hangul", hangul_share(F.col("trimmed"), jamo=True))
    return out.withColumns({"words": advanced_words(F.col("trimmed"), F.col("hangul")), "sentences": sentences(F.col("trimmed"), 5), "lower": F.lower("trimmed")})


#: Measures of the advanced rules and the word statistics that they are.
GRAMS = {"entropy": "bigram_entropy"} | {n: n for n in ("trigrams", "trigrams_repeated", "distinct_words", "hapax", "mtld")}


def advanced_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds the measures of the advanced rules to every row."""
    p = prepare_advanced(docs, text_col)
    t, s, low = F.col("trimmed"), F.col("sentences"), F.col("lower")
    ko = F.col("hangul") > 0.3
    tokens = F.filter(F.split(low, r"\s+"), lambda x: x != "")
    rows = F.filter(F.split(t, r"\r\n|\r|\n"), lambda x: trimmed(x) != "")
    marked = F.filter(rows, lambda x: x.rlike(r"^\s*(#{1,6}\s|[-*•]\s|\d+[.)]\s|>\s)") | trimmed(x).rlike("^```"))
    lengths = F.transform(s, lambda x: F.size(F.filter(F.split(x, r"\s+"), lambda y: y != "")))
    flips = F.aggregate(
        F.sequence(F.lit(2), F.greatest(F.size("lengths") - 1, F.lit(2))),
        F.lit(0),
        lambda a, i: a + F.coalesce(((F.get("lengths", i) - F.get("lengths", i - 1)) * (F.get("lengths", i - 1) - F.get("lengths", i - 2)) < 0).cast("int"), F.lit(0)),
    )
    korean = {"translationese": (*L.KO_PLURALS, *L.KO_PASSIVES, *L.KO_PRONOUNS), "stock": L.KO_STOCK}
    spark = docs.sparkSession
    measure = measured(spark, {}, particles=True, least=5, endings=L.KO_ENDINGS, grams=False)
    grams = measured(spark, {"vocabulary": L.VOCABULARY_EN_WIDE, "anchors": L.PERSONAL_ANCHORS_WIDE}, particles=True, spans=False)  # left out where no measure needs it
    p = p.withColumns({"_c": phrase_counts(docs)(low), "_k": matching.counted(spark, korean)(t), "_m": measure(t, low), "_w": grams(t, low)})
    p = p.withColumns({"hangul": measured_hangul(jamo=True)} | {name: F.col(f"_w.{field}") for name, field in GRAMS.items()})
    d = p.withColumns(
        {
            "n_words": F.col("_m.n_words").cast("int"),
            "n_sentences": F.col("_m.n_sentences").cast("int"),
            "lengths": lengths,
            "n_lines": F.size(rows),
            "n_marked": F.size(marked),
            "bold": matches(t, r"\*\*[^*]+\*\*"),
            "typographic": F.col("_m.typographic").cast("int"),
            "n_tokens": F.size(tokens),
            "transitions": F.size(F.filter(tokens, lambda x: x.isin(*L.TRANSITIONS))),
            "anchors": F.col("_w.anchors").cast("int"),
            "vocabulary": F.when(ko, F.col("_c.connectors_ko_times")).otherwise(F.col("_w.vocabulary").cast("int") + F.col("_c.connectors_en_times")),
            "hedges": hedges(ko),
            "starters": F.col("_m.starters").cast("int"),
            "style_hits": F.array(*[F.col(f"_c.style{i}_kinds") for i in range(len(L.STYLES))]),
            "translationese": F.col("_k.translationese_times") + matches(t, r"[가-힣]+의\s+[가-힣]+의\s+[가-힣]+"),
            "endings": F.col("_m.endings").cast("int"),
            "stock": F.col("_k.stock_kinds"),
        }
    ).withColumn("flips", flips)
    return d.drop("_c", "_k", "_m", "_w")


def advanced_weights() -> dict[str, tuple[str, Column]]:
    c = F.col
    n, s = c("n_words"), c("n_sentences")
    ko = c("hangul") > 0.3
    cv = deviation(c("lengths")) / F.greatest(F.lit(1.0), mean(c("lengths")))
    ttr, once = c("distinct_words") / F.greatest(n, F.lit(1)), c("hapax") / F.greatest(n, F.lit(1))
    size = F.length("trimmed")
    marked = safe_divide(c("n_marked"), c("n_lines"))
    per_thousand = c("vocabulary") * 1000 / F.greatest(n, F.lit(1))
    return {
        "entropy_low": ("낮은 엔트로피", weighed(((n > 100) & (c("entropy") < 4), 20))),
        "entropy_high": ("높은 엔트로피", weighed(((n >= 20) & (c("entropy") > 8), 15))),
        "burstiness": ("낮은 버스티니스", weighed(((s > 10) & (cv < 0.3), 18))),
        "diversity": ("보통 어휘 다양성", weighed((~ko & (n >= 50) & (ttr > 0.4) & (ttr < 0.6) & (once < 0.5) & (c("mtld") < 50), 12))),
        "diversity_ko": ("높은 어휘 다양성(한국어)", weighed((ko & (n >= 50) & (ttr > 0.8) & (once > 0.8), 10))),
        "alternation": ("교대 문장 패턴", weighed(((s >= 6) & (c("flips") / F.greatest(s - 2, F.lit(1)) > 0.85), 10))),
        "trigrams": ("반복 3-그램", weighed(((n > 100) & (safe_divide(c("trigrams_repeated"), c("trigrams")) > 0.3), 15))),
        "transitions": ("높은 연결 표현 밀도", weighed(((c("n_tokens") >= 30) & (c("transitions") / F.greatest(c("n_tokens"), F.lit(1)) > 0.05), 12))),
        "anchors": ("낮은 개인 표현 밀도", weighed(((n > 200) & (c("anchors") / F.greatest(n, F.lit(1)) < 0.005), 8))),
        "markdown": ("구조화 마크업 밀도", weighed(((c("n_lines") >= 4) & ((marked > 0.4) | ((marked > 0.25) & (c("bold") >= 3))), 14))),
        "typographic": ("타이포그래픽 구두점", weighed(((size >= 200) & (c("typographic") >= 6) & (c("typographic") / size > 0.002), 12))),
        "connectors_ko": ("모델형 연결어 밀도(한국어)", weighed((ko & (n >= 60) & (c("vocabulary") >= 3) & (per_thousand > 4), 12))),
        "vocabulary": ("LLM 과용 어휘", weighed((~ko & (n >= 60) & (c("vocabulary") >= 4) & (per_thousand > 5), 15))),
        "hedging": ("양면 균형 헤징 구조", weighed(((s >= 4) & (c("hedges") >= 2), 10))),
        "starters": ("문두 접속사 균일성", weighed(((s >= 6) & (c("starters") >= 3) & (c("starters") / s > 0.3), 10))),
        "translationese": ("한국어 번역투 및 직역 문체", weighed((ko & (n >= 20) & (c("translationese") >= 3), 14))),
        "endings": ("한국어 AI 정형 종결어미", weighed((ko & (s >= 4) & (c("endings") >= 3) & (c("endings") / s >= 0.28), 14))),
        "stock": ("한국어 모델 상투어(Slop) 감지", weighed((ko & (n >= 20) & (c("stock") >= 2), 12))),
    }


def style() -> Column:
    """short, academic, news, blog, conversational or general, in that order."""
    out = F.when(F.length("trimmed") == 0, "empty").when(F.col("n_words") < 20, "short")
    for i, (name, least, _) in enumerate(L.STYLES):
        out = out.when(F.get("style_hits", F.lit(i)) >= least, name)
    return out.otherwise("general")


def scan_advanced(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds signals, score, band, probability and style of the advanced rules."""
    d = advanced_features(docs, id_col, text_col)
    d = d.withColumn("signals", signals(*[signal(t, w) for t, w in advanced_weights().values()]))
    empty = F.length("trimmed") == 0
    d = d.withColumn("score", F.when(empty, 0).otherwise(capped_score(F.col("signals")))).withColumn("style", style())
    return d.withColumns({"band": band(F.col("score"), unknown=empty), "probability": F.col("score") / 100.0})


def stylometry(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (id, <keep>, vector): nine style measures of each text."""
    measure = measured(docs.sparkSession, {"connectors": L.STYLE_CONNECTORS}, particles=True, spans=False)
    d = prepare_advanced(docs, text_col).withColumn("_m", measure(F.col("trimmed"), F.col("lower"))).withColumn("hangul", measured_hangul(jamo=True))
    d = d.withColumn("pieces", sentences(F.col("trimmed"), 1))
    d = d.withColumn("lengths", F.when(F.size("pieces") > 0, F.transform("pieces", lambda x: matches(F.lower(x), WORD))).otherwise(F.array(F.lit(0))))
    n = F.greatest(F.col("_m.n_words"), F.lit(1))
    size = F.greatest(F.length("trimmed"), F.lit(1))
    lengths = F.col("lengths")
    m = mean(lengths)
    vector = F.array(
        m / 40.0,
        deviation(lengths) / F.greatest(m, F.lit(1.0)),
        F.col("_m.distinct_words") / n,
        F.col("_m.hapax") / n,
        matches(F.col("trimmed"), "[,;:'\"—–\\-()]") / size * 100,
        F.col("_m.connectors") / n * 100,
        F.size("pieces") / size * 500,
        F.col("hangul"),
        F.col("_m.bigram_entropy") / 20.0,
    )
    zero = F.array(*[F.lit(0.0)] * 9)
    return d.select(id_col, *keep, F.when(F.length("trimmed") == 0, zero).otherwise(vector).alias("vector"))


def style_distance(a: Column, b: Column) -> Column:
    """Mean relative gap of two vectors."""
    gap = F.zip_with(a, b, lambda x, y: F.abs(x - y) / (F.abs(x) + F.abs(y) + 0.02))
    return F.aggregate(gap, F.lit(0.0), lambda s, v: s + v) / F.size(a)


def same_author(distance: Column) -> tuple[Column, Column]:
    """(score, band) of a style distance."""
    score = F.greatest(F.lit(0), F.least(F.lit(100), ((1 - distance / 0.35) * 100).cast("int")))
    return score, F.when(score >= 67, "same").when(score >= 35, "unclear").otherwise("different")


def style_distances(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """:func:`style_distance` of each vector of a matrix with each of another, to six digits, half up."""
    (x, _), (y, _) = a, b
    out = np.zeros((len(x), len(y)))
    gap, size = np.empty_like(out), np.empty_like(out)
    for i in range(x.shape[1]):
        np.subtract(x[:, i, None], y[None, :, i], out=gap)
        np.add(np.abs(x[:, i, None]), np.abs(y[None, :, i]), out=size)
        size += 0.02
        np.abs(gap, out=gap)
        gap /= size
        out += gap
    out /= max(x.shape[1], 1)
    np.multiply(out, 1e6, out=gap)
    np.floor(gap, out=size)
    gap -= size
    near = np.abs(gap - 0.5) < 1e-6  # the decimal digits decide
    exact = [float(Decimal(repr(v)).quantize(Decimal("0.000001"), ROUND_HALF_UP)) for v in out[near].tolist()]
    size += gap >= 0.5
    size /= 1e6
    size[near] = exact
    return size


def same_authors(distance: np.ndarray) -> np.ndarray:
    """Which of the distances are the same author's by :func:`same_author`."""
    return np.trunc((1 - distance / 0.35) * 100) >= 67


def prose(text: Column) -> Column:
    """Text without fences, inline code, link targets, addresses, tags, tables and list marks; the text itself if under 200 letters remain."""
    x = F.regexp_replace(text, r"(?s)```.*?```", " ")
    x = F.regexp_replace(x, r"`[^`\n]*`", " ")
    x = F.regexp_replace(x, r"!?\[([^\]]*)\]\([^)]*\)", "$1")
    x = F.regexp_replace(x, r"https?://\S+", " ")
    x = F.regexp_replace(x, r"<[^>]+>", " ")
    kept = F.filter(F.split(x, "\n"), lambda s: ~trimmed(s).rlike(r"^\|"))
    kept = F.transform(kept, lambda s: F.regexp_replace(s, r"^\s*(#{1,6}\s+|[-*•]\s+|\d+[.)]\s+|>\s*)", ""))
    out = trimmed(F.regexp_replace(F.array_join(kept, "\n"), r"\*\*|__", ""))
    return F.when(F.length(out) < 200, text).otherwise(out)
