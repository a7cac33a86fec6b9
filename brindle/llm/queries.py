"""Queries of this subpackage for the driver, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.llm.encode import decode_texts, encode_texts
from brindle.llm.frequent import count_values, frequent_values, top_values
from brindle.llm.glyphs import consistent, forms_sql, same_looking_classes, same_looking_pairs
from brindle.llm.packing import pack_documents
from brindle.llm.residue import find_residue, without_residue
from brindle.session import table


def _text_rows(spark: SparkSession, root: str) -> DataFrame:
    """Rows of ``dictionary`` whose predicate is of kind text; ``predicates`` has one row for each predicate."""
    kinds = table(spark, root, "predicates").where("kind = 'text'").select("p")
    return table(spark, root, "dictionary").select("row_id", "p", "o").join(kinds, "p", "left_semi")


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """(row_a, row_b): pairs of text rows whose o look the same but differ."""
    return same_looking_pairs(_text_rows(spark, root), "row_id", "o")


def p1_classes(spark: SparkSession, root: str) -> DataFrame:
    """(row_id, class_id, n_links): every text row that looks like a different one, its class and its number of such rows."""
    return same_looking_classes(_text_rows(spark, root), "row_id", "o")


def p1_forms(spark: SparkSession, root: str) -> DataFrame:
    """(row_id, form): every text row with its o in consistent form; null for null."""
    return _text_rows(spark, root).select("row_id", consistent(F.col("o")).alias("form"))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """(field, item): values in at least 0.5 % of all rows of ``dictionary``."""
    return frequent_values(table(spark, root, "dictionary"), ["p", "o"], 0.005).select("field", "item")


def p3_top(spark: SparkSession, root: str) -> DataFrame:
    """(field, item, n, rank): the 100 most frequent values of p and of o with their exact counts."""
    return top_values(table(spark, root, "dictionary"), ["p", "o"], 100)


def p3_counts(spark: SparkSession, root: str) -> DataFrame:
    """(field, item, n): every value of p and of o with its exact count; nulls have a null item."""
    return count_values(table(spark, root, "dictionary"), ["p", "o"])


def p6_ids(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, ids): every document in byte_bpe_50k, without special tokens."""
    return encode_texts(table(spark, root, "documents"))


def p7_containers(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, part, start, length, container): all documents in containers of 2,048 tokens of byte_bpe_50k."""
    return pack_documents(table(spark, root, "documents"), 2048)


def p6_texts(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, text): every document from its ids, which gives its text again."""
    return decode_texts(p6_ids(spark, root))


def p7_whole(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, whole): of every document with tokens, whether its parts follow each other without a gap, none of its containers
    holds more than the capacity, and it is cut only if it is longer than that."""
    placed = p7_containers(spark, root).where("container is not null")
    loaded = placed.withColumn("load", F.sum("length").over(Window.partitionBy("container")))
    by_document = loaded.groupBy("doc_id").agg(
        F.sum("length").alias("total"), F.count(F.lit(1)).alias("parts"), F.max("part").alias("last"), F.min("start").alias("first"), F.max(F.col("start") + F.col("length")).alias("end"), F.max("load").alias("load")
    )
    return by_document.select("doc_id", F.expr("first = 0 and end = total and last + 1 = parts and load <= 2048 and (parts = 1 or total > 2048)").alias("whole"))


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id): documents with residue in place of content."""
    return find_residue(table(spark, root, "documents")).select("doc_id")


def p8_kept(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, n_chars): the documents that remain when those are excluded."""
    return without_residue(table(spark, root, "documents")).select("doc_id", "n_chars")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_classes, p1_forms, p3_found, p3_top, p3_counts, p6_ids, p6_texts, p7_containers, p7_whole, p8_found, p8_kept)}


def oracle_sql() -> dict[str, str]:
    counts = """
        with long as (select 'p' as field, p as item from dictionary union all select 'o', o from dictionary),
        n as (select field, item, count(*) as n from long where item is not null group by field, item)
    """
    return {
        "p1_forms": f"select row_id, {forms_sql('o')} as form from dictionary where p in (select p from predicates where kind = 'text')",
        "p6_texts": "select doc_id, coalesce(text, '') as text from documents",
        "p7_whole": "select doc_id, true as whole from documents where length(text) > 0",
        "p3_found": counts + "select field, item from n where n >= 0.005 * (select count(*) from dictionary)",
        "p3_counts": "select 'p' as field, p as item, count(*) as n from dictionary group by p union all select 'o', o, count(*) from dictionary group by o",
        "p3_top": counts
        + """
        , r as (select field, item, n, row_number() over (partition by field order by n desc, item) as rank from n)
        select field, item, n, cast(rank as integer) as rank from r where rank <= 100
        """,
    }
