"""Helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from splitfold.operators.views import fresh, quoted
from splitfold.shipping import shared_folder, ship

__all__ = ["FOLDS", "HELD_OUT", "bounded_sample", "class_sizes", "columns_of", "cut", "fresh", "held_out", "row_key", "sample_of_each", "scored", "table"]

#: A model learns labels only from rows whose remainder isn't HELD_OUT.
FOLDS, HELD_OUT = 5, 0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; the session's executors get this package."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True for the documents no model may learn a label from; a null id is held out."""
    rest = F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % FOLDS
    return F.coalesce(rest == HELD_OUT, F.lit(True))


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """16 bytes that tell a row's id and text from all others: MD5 of both. A null text counts as empty, a null id as none."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text), F.lit("")))))


def columns_of(df: DataFrame) -> list[Column]:
    """All columns of df by name, whatever characters the names have."""
    return [F.col(quoted(c)) for c in df.columns]


def cut(df: DataFrame) -> DataFrame:
    """The rows of df written to the cluster's shared checkpoint folder, so that a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def scored(column: str | Column, schema: str, load: Callable[[], Callable[[pd.Series], pd.DataFrame]]) -> Column:
    """A struct column that a vectorised Python function makes from a text column; load() runs once in each task."""
    ship(SparkSession.active())

    @F.pandas_udf(schema)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        f = load()
        for batch in batches:
            yield f(batch)

    return run(F.col(column) if isinstance(column, str) else column)


def class_sizes(rows: DataFrame, column: str) -> dict:
    """How many rows each value of column has; the values must be classes, whose number doesn't grow with the rows."""
    return {r[column]: r["n"] for r in rows.groupBy(column).agg(F.count("*").alias("n")).collect()}


def sample_of_each(rows: DataFrame, column: str, most: int, salt: str, sizes: dict | None = None) -> DataFrame:
    """(doc_id, column): ``most`` different ids of each value of column, or all if there are fewer; those with the least hashes.

    Of each value, only ids below a limit are drawn and told apart, so few rows are ranked however large the input. The first
    limit lets about twice as many rows pass as are asked for; where repeated rows leave too few ids, it is raised and they
    are drawn again. sizes: class_sizes() of rows, if known. The result is written to the shared folder.
    """
    sizes = class_sizes(rows, column) if sizes is None else sizes
    sizes = {k: n for k, n in sizes.items() if k is not None}
    if not sizes:
        return rows.select("doc_id", column).limit(0)
    whole = 1 << 30
    h = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(salt)), F.lit(whole))
    limits = {k: min(whole, 1 + whole * 2 * most // n) for k, n in sizes.items()}
    while True:
        known = F.create_map(*(F.lit(x) for pair in limits.items() for x in pair))
        few = cut(rows.select("doc_id", column).where(h < known[F.col(column)]).distinct())
        drawn = class_sizes(few, column)
        short = [k for k in limits if drawn.get(k, 0) < most and limits[k] < whole]
        if not short:
            break
        limits |= {k: min(whole, 8 * limits[k]) for k in short}
    place, ranked = F.row_number().over(W.partitionBy(column).orderBy(h, "doc_id")), fresh("place")
    return few.withColumn(ranked, place).where(F.col(ranked) <= most).drop(ranked)


def bounded_sample(labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """(doc_id, label) of at most per_class learnable rows of each class; an id with both labels counts as 1."""
    rows = labels.where(~held_out() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    return sample_of_each(rows, "label", per_class, "sample")
