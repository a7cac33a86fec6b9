"""Results for each key where a few keys hold most rows (problem 4): eager aggregation through joins.

Both inputs are first aggregated by what the result needs of them, so a key that holds a third of all rows reaches the
join as one compact state. The states are joined, their counts multiplied or their sums scaled, and the products rolled
up. Spark combines each aggregation in the map tasks, so of a hot key one row for each task is shuffled, never its rows.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pair_counts(df: DataFrame, left: str, right: str) -> DataFrame:
    """(left, right, n): the rows of each pair of values, nulls being values of their own.

    Equal pairs are combined before the shuffle; the pairs of a hot key are spread over all partitions, as the pair is
    the key of this aggregation.
    """
    return df.groupBy(left, right).agg(F.count(F.lit(1)).alias("n"))


def key_states(pairs: DataFrame, key: str, partner: str) -> DataFrame:
    """(k, n_rows, n_partners) of every key of ``pairs`` (key, partner, n), null included, whose rows are distinct pairs.

    As pairs are distinct, the number of distinct non-null partners is their plain count: a state of two numbers that
    combines before the shuffle, where a set of partners would grow with the key.
    """
    return pairs.groupBy(F.col(key).alias("k")).agg(F.sum("n").alias("n_rows"), F.count(partner).alias("n_partners"))


def key_profile(df: DataFrame, left: str, right: str) -> DataFrame:
    """(k, s_rows, s_partners, o_rows, o_partners, paths): every id that occurs in either column, with both its states.

    s_ counts the rows with k in ``left`` and their distinct non-null partners in ``right``, o_ the reverse; a side on
    which the id doesn't occur has 0. paths is the number of pairs of rows in which k ends the one and begins the other:
    the size of the self join on k, from the product of two counts instead of that join. A null id is no key and no
    partner, but a row with a null partner is a row. An empty table gives no rows.
    """
    pairs = pair_counts(df.select(F.col(left).alias("a"), F.col(right).alias("b")), "a", "b")
    one = key_states(pairs, "a", "b").select("k", F.col("n_rows").alias("s_rows"), F.col("n_partners").alias("s_partners"))
    two = key_states(pairs, "b", "a").select("k", F.col("n_rows").alias("o_rows"), F.col("n_partners").alias("o_partners"))
    zero = {name: F.coalesce(F.col(name), F.lit(0)) for name in ("s_rows", "s_partners", "o_rows", "o_partners")}
    # The null key is dropped after the join only: a filter on either side would reach the scan and make two different
    # aggregations by pair of what both sides can share as one exchange.
    joined = one.join(two, "k", "full").where("k is not null").select("k", *(value.alias(name) for name, value in zero.items()))
    return joined.withColumn("paths", F.col("s_rows").cast("decimal(38,0)") * F.col("o_rows"))


def side_rows(profile: DataFrame) -> DataFrame:
    """(side, k, n_rows, n_partners, paths): a ``key_profile`` with one row for each side on which a key occurs.

    The joined states are multiplied by the weights of a side, 1 for its own numbers and 0 for those of the other, and the
    products are rolled up by side and key: a key has one joined state, so this moves two small rows for it at most.
    """
    weights = F.array(*(F.struct(F.lit(side).alias("side"), F.lit(s).cast("long").alias("ws"), F.lit(1 - s).cast("long").alias("wo")) for side, s in (("s", 1), ("o", 0))))
    weighed = profile.select("*", F.explode(weights).alias("w")).select("w.*", "k", "s_rows", "o_rows", "s_partners", "o_partners", "paths")
    sums = [F.sum(F.col(f"s_{what}") * F.col("ws") + F.col(f"o_{what}") * F.col("wo")).alias(f"n_{what}") for what in ("rows", "partners")]
    return weighed.groupBy("side", "k").agg(*sums, F.max("paths").alias("paths")).where("n_rows > 0")


def frequent_keys(df: DataFrame, left: str, right: str, share: float) -> DataFrame:
    """(side, k, n_rows, n_partners, paths): the keys that hold at least ``share`` of all rows of ``df`` on a side."""
    part = Fraction(str(share))
    rows = df.agg((F.count(F.lit(1)) * part.numerator).alias("rows"))
    return side_rows(key_profile(df, left, right)).where(F.col("n_rows") * part.denominator >= rows.scalar())


def join_counts(left: DataFrame, right: DataFrame, on: str, by_left: list[str], by_right: list[str]) -> DataFrame:
    """(*by_left, *by_right, n): how many rows the inner join on ``on`` has for each group, without making that join.

    Each input is aggregated by (on, its grouping columns) first; the states are joined and their counts multiplied. Null
    keys join nothing. The grouping columns of both sides must have different names. A key with l and r rows costs one
    state for each of its groups instead of l x r rows.
    """
    return _eager(left, right, on, by_left, by_right, None, None)


def join_sums(left: DataFrame, right: DataFrame, on: str, by_left: list[str], by_right: list[str], value: Column, name: str = "total") -> DataFrame:
    """(*by_left, *by_right, n, name): as ``join_counts``, with the sum of ``value`` of the left side over the joined rows."""
    return _eager(left, right, on, by_left, by_right, value, name)


def _eager(left: DataFrame, right: DataFrame, on: str, by_left: list[str], by_right: list[str], value: Column | None, name: str | None) -> DataFrame:
    if set(by_left) & set(by_right) or on in (*by_left, *by_right):
        raise ValueError("grouping columns must be named differently from each other and from the key")
    sums = [] if value is None else [F.sum(value).alias("v_left")]
    one = left.where(F.col(on).isNotNull()).groupBy(on, *by_left).agg(F.count(F.lit(1)).alias("n_left"), *sums)
    two = right.where(F.col(on).isNotNull()).groupBy(on, *by_right).agg(F.count(F.lit(1)).alias("n_right"))
    product = F.sum(F.col("n_left").cast("decimal(38,0)") * F.col("n_right")).alias("n")
    scaled = [] if value is None else [F.sum(F.col("v_left") * F.col("n_right")).alias(name)]
    return one.join(two, on).groupBy(*by_left, *by_right).agg(product, *scaled)
