"""Optional numbers for terms: a dictionary between terms and dense ids.

Queries don't need it, as strings join well and come out decoded; it is for users who keep their triples as numbers. Terms
are of three zones: shared (subject and object), subject, object. Ids begin at 1 and are dense: the shared terms come
first, then the subjects, then the objects, each in the order of their text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_INSIDE = (1 << 33) - 1


def term_zones(triples: DataFrame) -> DataFrame:
    """(term, zone) of each distinct subject and object of ``triples`` (s, p, o); nulls are no terms.

    One aggregation that combines before the shuffle, so a term that recurs everywhere costs one row for each task.
    """
    ends = F.array(F.struct(F.col("s").alias("term"), F.lit(1).alias("s"), F.lit(0).alias("o")), F.struct(F.col("o").alias("term"), F.lit(0).alias("s"), F.lit(1).alias("o")))
    long = triples.select(F.explode(ends).alias("e")).select("e.*").where("term is not null")
    seen = long.groupBy("term").agg(F.max("s").alias("s"), F.max("o").alias("o"))
    return seen.select("term", F.when(F.expr("s + o = 2"), "shared").when(F.col("s") == 1, "subject").otherwise("object").alias("zone"))


def number_terms(spark: SparkSession, triples: DataFrame, path: str) -> DataFrame:
    """(term_id, term, zone) of all terms of ``triples``, written to ``path`` first.

    Terms are range-partitioned by (zone, term) and sorted; a term's id is the number of terms in the partitions before its
    own plus its place there. The places are written before they are used, so a repeated task can't change them; only one
    count for each partition is gathered.
    """
    rank = F.when(F.col("zone") == "shared", 0).when(F.col("zone") == "subject", 1).otherwise(2)
    ranked = term_zones(triples).withColumn("rank", rank)
    placed = ranked.repartitionByRange("rank", "term").sortWithinPartitions("rank", "term")
    numbered = placed.withColumn("place", F.monotonically_increasing_id())
    numbered.select("term", "zone", F.shiftright("place", 33).alias("part"), F.col("place").bitwiseAND(F.lit(_INSIDE)).alias("place")).write.mode("overwrite").parquet(path)
    written = spark.read.parquet(path)
    counts = written.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # A row for each partition that was written: its size is bounded by their number.
    starts = F.broadcast(counts.select("part", before.alias("start")))
    return written.join(starts, "part").select((F.col("start") + F.col("place") + 1).alias("term_id"), "term", "zone")


def encode_triples(triples: DataFrame, terms: DataFrame) -> DataFrame:
    """(s_id, p, o_id) of the triples whose terms are all in ``terms`` (term_id, term)."""
    ids = terms.select("term_id", "term")
    s = ids.select(F.col("term_id").alias("s_id"), F.col("term").alias("s"))
    o = ids.select(F.col("term_id").alias("o_id"), F.col("term").alias("o"))
    return triples.select("s", "p", "o").join(s, "s").join(o, "o").select("s_id", "p", "o_id")


def decode_triples(numbers: DataFrame, terms: DataFrame) -> DataFrame:
    """(s, p, o) of numbered triples, the inverse of ``encode_triples``."""
    ids = terms.select("term_id", "term")
    s = ids.select(F.col("term_id").alias("s_id"), F.col("term").alias("s"))
    o = ids.select(F.col("term_id").alias("o_id"), F.col("term").alias("o"))
    return numbers.join(s, "s_id").join(o, "o_id").select("s", "p", "o")
