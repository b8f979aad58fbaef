"""Column functions that the operators share."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_']+"
SIGNALS = "array<struct<title:string,detail:string,weight:int>>"


def total(columns: list[Column]) -> Column:
    """Sum of columns; zero for none."""
    return reduce(lambda a, b: a + b, columns, F.lit(0))


def band(score: Column, high: int = 67, medium: int = 35, unknown: Column | None = None) -> Column:
    """high, medium or low by score, or unknown where told so."""
    out = F.when(score >= high, "high").when(score >= medium, "medium").otherwise("low")
    return out if unknown is None else F.when(unknown, "unknown").otherwise(out)


def signal(title: str, weight: Column, detail: Column | None = None) -> Column:
    """A signal row; null where the weight is null."""
    made = F.struct(F.lit(title).alias("title"), (F.lit("") if detail is None else detail).alias("detail"), weight.cast("int").alias("weight"))
    return F.when(weight.isNotNull(), made)


def weighed(*cases: tuple[Column, int]) -> Column:
    """The weight of the first case that holds, else null."""
    out = F.when(cases[0][0], cases[0][1])
    for condition, weight in cases[1:]:
        out = out.when(condition, weight)
    return out


def signals(*rows: Column) -> Column:
    """The rows that are not null, as one array."""
    return F.array_compact(F.array(*rows)).cast(SIGNALS)


def weight_of(rows: Column, keep=None) -> Column:
    """Sum of the weights of the signals that ``keep`` holds for."""
    chosen = rows if keep is None else F.filter(rows, keep)
    return F.aggregate(chosen, F.lit(0), lambda a, s: a + s["weight"])


def capped_score(rows: Column, cap: Column | None = None, exempt: tuple[str, ...] = ()) -> Column:
    """min(100, exempt + min(rest, cap)); a null cap binds nothing."""
    if cap is None:
        return F.least(F.lit(100), weight_of(rows))
    named = weight_of(rows, lambda s: s["title"].isin(*exempt)) if exempt else F.lit(0)
    rest = weight_of(rows, lambda s: ~s["title"].isin(*exempt)) if exempt else weight_of(rows)
    return F.least(F.lit(100), named + F.when(cap.isNull(), rest).otherwise(F.least(rest, cap)))


def occurrences(text: Column, phrase: str) -> Column:
    """How often a phrase occurs without overlap; most texts are done after one search."""
    n = ((F.length(text) - F.length(F.replace(text, F.lit(phrase), F.lit("")))) / len(phrase)).cast("int")
    return F.when(F.contains(text, F.lit(phrase)), n).when(text.isNotNull(), 0)


def hits(text: Column, phrases) -> Column:
    """How many of the phrases occur."""
    return total([F.contains(text, F.lit(p)).cast("int") for p in phrases])


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def alternation(words) -> str:
    return "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w)))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+\z", "")  # $ would also stand before a last U+2028 or U+0085


def hangul_share(text: Column, jamo: bool = False) -> Column:
    """Hangul syllables (and jamo) among letters; 0 without letters."""
    others = "[^가-힣ᄀ-ᇿ]+" if jamo else "[^가-힣]+"
    # Whole runs of other letters go in one step each.
    letters = F.length(F.regexp_replace(text, r"\P{L}+", ""))
    return F.when(letters > 0, F.length(F.regexp_replace(text, others, "")) / letters).otherwise(F.lit(0.0))


def mean(x: Column) -> Column:
    """Mean of an array of numbers; null if empty."""
    return F.when(F.size(x) > 0, F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / F.size(x))


def deviation(x: Column) -> Column:
    """Population standard deviation of an array; null if empty. One pass: sums of values and squares."""
    state = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q"))
    n = F.when(F.size(x) > 0, F.size(x))
    return F.when(
        F.size(x) > 0,
        F.aggregate(
            x,
            state,
            lambda a, v: F.struct((a["s"] + v).alias("s"), (a["q"] + v.cast("double") * v).alias("q")),
            lambda a: F.sqrt(F.greatest(a["q"] / n - (a["s"] / n) * (a["s"] / n), F.lit(0.0))),
        ),
    )


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays; null if one is zero."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size)


def clamp(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def safe_divide(a: Column, b: Column) -> Column:
    """a / max(1, b)."""
    return a / F.greatest(F.lit(1), b)
