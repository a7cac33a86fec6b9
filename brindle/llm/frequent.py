"""Most frequent values of columns with very many distinct ones (problem 3).

Exact counts by spillable aggregation: Spark's hash aggregation combines equal values before the shuffle (and turns to
sorted runs on disk where its memory ends), values are hash-partitioned, and each partition finishes its counts on its own.
The ranking keeps the best ``k`` of every partition and merges these, at most k x partitions rows, for the final limit.
No step holds all distinct values in memory, and nothing is sent to the driver.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def count_values(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, item, n): how often each value of each column in ``fields`` occurs, compared exactly.

    Columns are compared as strings. Nulls are counted under a null item, so the counts of a field add up to the rows.
    A hot value is combined in every map task before the shuffle: it arrives as one row per task.
    """
    pairs = ", ".join(f"'{name}', cast(`{name}` as string)" for name in fields)
    long = df.select(F.expr(f"stack({len(fields)}, {pairs}) as (field, item)"))
    return long.groupBy("field", "item").agg(F.count(F.lit(1)).alias("n"))


def top_values(df: DataFrame, fields: list[str], k: int) -> DataFrame:
    """(field, item, n, rank): the ``k`` most frequent non-null values of each field with their exact counts.

    Ties are ordered by the value, so that the result is defined; ranks are 1, 2, ... An empty table gives no rows, a
    field with fewer than ``k`` values gives all of them. Each field is an aggregation of its own column; its ordered limit
    (TakeOrderedAndProject) holds the best k of a partition in a heap, without sorting the rest, and merges k rows from
    each partition. Ranks are given to those k rows only.
    """
    best = None
    for name in fields:
        item = F.col(f"`{name}`").cast("string").alias("item")
        counts = df.select(item).where("item is not null").groupBy("item").agg(F.count(F.lit(1)).alias("n"))
        one = counts.orderBy(F.desc("n"), F.asc("item")).limit(k).select(F.lit(name).alias("field"), "item", "n")
        best = one if best is None else best.unionByName(one)
    order = Window.partitionBy("field").orderBy(F.desc("n"), F.asc("item"))
    return best.withColumn("rank", F.row_number().over(order))


def frequent_values(df: DataFrame, fields: list[str], share: float) -> DataFrame:
    """(field, item, n): the non-null values that occur in at least ``share`` of all rows of ``df``.

    At most 1/share values of a field can reach the share, so the top 1/share of the exact ranking hold them all: the
    result comes out of ``top_values`` and is then compared with the exact number of rows, in whole numbers.
    """
    part = Fraction(str(share))
    rows = df.agg((F.count(F.lit(1)) * part.numerator).alias("rows"))
    best = top_values(df, fields, int(1 / part))
    return best.where(F.col("n") * part.denominator >= rows.scalar()).select("field", "item", "n")
