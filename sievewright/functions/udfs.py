"""User code in batches: processors whose bad rows do not fail, detectors whose model loads once a worker."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievewright.session import small_batches


def process(rows: DataFrame, function: Callable[[dict], str], keep: tuple[str, ...] | None = None) -> DataFrame:
    """Adds status, result, error and processing_time of a user function of each row; an exception becomes its row's error.

    Only the columns of ``keep`` come back from the workers, all if it is not
    given.  Batches are bounded by their bytes, so what a worker holds does not
    grow with the rows of a task.
    """
    small_batches(rows.sparkSession)
    keep = tuple(rows.columns) if keep is None else keep
    schema = T.StructType([*[rows.schema[c] for c in keep], T.StructField("status", T.StringType()), T.StructField("result", T.StringType()), T.StructField("error", T.StringType()), T.StructField("processing_time", T.DoubleType())])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                start = time.perf_counter()
                try:
                    out.append(("completed", str(function(row)), None, time.perf_counter() - start))
                except Exception as e:  # the row carries its error
                    out.append(("failed", None, f"{type(e).__name__}: {e}", time.perf_counter() - start))
            yield pd.concat([batch[list(keep)].reset_index(drop=True), pd.DataFrame(out, columns=["status", "result", "error", "processing_time"])], axis=1)

    return rows.mapInPandas(work, schema)


def detector(load: Callable[[], Callable[[pd.Series], pd.Series]]):
    """A column function of one column: ``load`` runs once a worker and gives a function of a batch to scores 0-100.

    A batch that fails has null scores: unavailable, not clean.
    """

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        try:
            model = load()
        except Exception:
            model = None
        for batch in batches:
            try:
                yield pd.Series(model(batch), dtype="float64").clip(0, 100) if model else pd.Series([None] * len(batch), dtype="float64")
            except Exception:
                yield pd.Series([None] * len(batch), dtype="float64")

    return score


def member_scores(items: DataFrame, members: dict[str, tuple[Callable, str]], id_col: str = "item_id") -> DataFrame:
    """Rows (id, member, available, score) of pluggable detectors: name -> (column function, input column)."""
    small_batches(items.sparkSession)
    rows = [F.struct(F.lit(n).alias("member"), f(F.col(c)).alias("score")) for n, (f, c) in members.items()]
    d = items.select(id_col, F.explode(F.array(*rows)).alias("m")).select(id_col, "m.*")
    return d.withColumn("available", F.col("score").isNotNull())
