"""Databases of triples in Parquet: create, open, describe, list, delete.

Layout of ``<root>/<name>``:

* ``pso`` - all triples, partitioned by ``part`` and sorted by (p, s, o) in each file; ``pos`` - the same sorted by (p, o, s).
  A predicate with many rows has a part of its own, of as many files as it needs; the many small predicates share a fixed number
  of parts, so that the number of folders has a bound. A pattern with a known predicate reads one part, one with a
  known subject or object skips by the row groups' statistics.
* ``predicates`` - (p, part, rows, subjects, objects, most_s, most_o), the statistics for the planner.
* ``info`` - one row (triplets, triples, predicates, entities); triplets counts the input rows with repetitions.
* ``READY`` - written last: a database without it is not complete and can't be opened.

A database is written to a folder of its own and takes its name when it is complete; the old one of that name stays until then.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators.rejects import good_triples, load_lines
from brindle.plans.order import Statistics
from brindle.sources.graph import StoredGraph

#: Most predicates with a part of their own, rows from which one gets it, and parts that the others share.
HEAVY_MOST, HEAVY_ROWS, TAIL_PARTS = 256, 100_000, 16

#: Most predicates whose statistics the planner keeps, the largest first.
KNOWN_MOST = 10_000

_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9_.-]{0,99}")


class StoreError(ValueError):
    """A database can't be created, found or opened."""


def valid_name(name: str) -> str:
    """``name`` if it can name a database; never a path."""
    if not isinstance(name, str) or not _NAME.fullmatch(name) or ".." in name:
        raise StoreError(f"{name!r} is no database name")
    return name


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """(s, p, o) of the good lines of text files; broken lines, comments and blank lines are left out."""
    return good_triples(load_lines(spark.read.text(path).select(F.lit(0).alias("line_id"), F.col("value").alias("line")))).drop("line_id")


def read_rejects(spark: SparkSession, path: str) -> DataFrame:
    """(line, reason) of the lines of text files that ``read_triples`` leaves out as broken."""
    lines = spark.read.text(path).select(F.col("value").alias("line"))
    return load_lines(lines.select(F.col("line").alias("line_id"), "line")).where("reason is not null").select(F.col("line_id").alias("line"), "reason")


def triple_counts(triples: DataFrame) -> DataFrame:
    """(s, p, o, n): the set of ``triples`` with the number of rows of each; rows with a null are no triples."""
    whole = triples.select("s", "p", "o").where("s is not null and p is not null and o is not null")
    return whole.groupBy("s", "p", "o").agg(F.count(F.lit(1)).alias("n"))


def predicate_counts(counted: DataFrame) -> DataFrame:
    """(p, rows, subjects, objects, most_s, most_o) of ``triple_counts``, all exact; most_s and most_o are the rows of the most
    frequent subject and object.

    Counted in levels instead of by sets: the distinct ends of a predicate are rows of their own, so one that holds a third
    of all triples is spread over all tasks until only its counts are left.
    """
    ends = F.array(F.struct(F.lit("s").alias("end"), F.col("s").alias("x")), F.struct(F.lit("o").alias("end"), F.col("o").alias("x")))
    by_end = counted.select("p", F.explode(ends).alias("e")).groupBy("p", "e.end", "e.x").agg(F.count(F.lit(1)).alias("n"))
    one = F.col("end") == "s"
    return by_end.groupBy("p").agg(
        F.sum(F.when(one, F.col("n"))).alias("rows"),
        F.count(F.when(one, 1)).alias("subjects"),
        F.count(F.when(~one, 1)).alias("objects"),
        F.max(F.when(one, F.col("n"))).alias("most_s"),
        F.max(F.when(~one, F.col("n"))).alias("most_o"),
    )


def graph_info(counted: DataFrame) -> DataFrame:
    """One row (triplets, triples, predicates, entities) of ``triple_counts``: its rows with and without repetitions, and the
    distinct predicates and ends. Both branches ask for n, so that they share one aggregation."""
    by_p = counted.groupBy("p").agg(F.sum("n").alias("triplets"), F.count(F.lit(1)).alias("triples"))
    sums = by_p.agg(F.coalesce(F.sum("triplets"), F.lit(0)).alias("triplets"), F.coalesce(F.sum("triples"), F.lit(0)).alias("triples"), F.count(F.lit(1)).alias("predicates"))
    ends = counted.where("n > 0").select(F.explode(F.array("s", "o")).alias("x")).distinct()
    return sums.crossJoin(ends.agg(F.count(F.lit(1)).alias("entities")))  # one row each


class Store:
    """The databases below a root folder of any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, *steps: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path("/".join((self.root, *steps)))
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def list(self) -> list[str]:
        """The names of all complete databases, sorted."""
        path, files = self._path()
        if not files.exists(path):
            return []
        names = [x.getPath().getName() for x in files.listStatus(path) if x.isDirectory()]
        return sorted(name for name in names if _NAME.fullmatch(name) and self.exists(name))

    def exists(self, name: str) -> bool:
        path, files = self._path(valid_name(name), "READY")
        return files.exists(path)

    def delete(self, name: str) -> bool:
        """Delete a database; whether there was one."""
        path, files = self._path(valid_name(name))
        return files.exists(path) and files.delete(path, True)

    def create_from_file(self, name: str, file: str) -> dict[str, int]:
        return self.create(name, read_triples(self.spark, file))

    def create(self, name: str, triples: DataFrame, heavy_rows: int = HEAVY_ROWS) -> dict[str, int]:
        """Write the set of ``triples`` (s, p, o) as a database, in place of one of that name; its info.

        Rows with a null are left out. Each predicate's rows are range-partitioned by their sort order, so one that
        holds a third of all rows is spread over as many tasks as it needs. ``triples`` may be read from the old database.
        """
        draft = f".{valid_name(name)}.{uuid.uuid4().hex}"
        try:
            info = self._fill(draft, triples, heavy_rows)
            self.delete(name)
            (old, files), (new, _) = self._path(draft), self._path(name)
            if not files.rename(old, new):
                raise StoreError(f"{name!r} can't take the place of its draft")
            return info
        finally:
            path, files = self._path(draft)
            files.delete(path, True)

    def _fill(self, folder: str, triples: DataFrame, heavy_rows: int) -> dict[str, int]:
        path = f"{self.root}/{folder}"
        # The deduplicated set is written once and read for everything else: the input is parsed only once.
        triple_counts(triples).write.mode("overwrite").parquet(f"{path}/set")
        unique = self.spark.read.parquet(f"{path}/set")
        predicate_counts(unique).write.mode("overwrite").parquet(f"{path}/counted")
        counts = self.spark.read.parquet(f"{path}/counted")
        most = counts.where(F.col("rows") >= heavy_rows).orderBy(F.desc("rows"), "p").limit(HEAVY_MOST).collect()
        heavy = {row.p: k for k, row in enumerate(most)}
        tail = -1 - F.crc32(F.col("p").cast("binary")) % TAIL_PARTS
        # At most HEAVY_MOST rows: a broadcast of bounded size.
        own = F.broadcast(self.spark.createDataFrame(list(heavy.items()), "p string, own int"))
        placed = unique.join(own, "p", "left").select("s", "p", "o", F.coalesce("own", tail).cast("int").alias("part"))
        for name, order in (("pso", ["p", "s", "o"]), ("pos", ["p", "o", "s"])):
            sorted_rows = placed.repartitionByRange("part", *order).sortWithinPartitions("part", *order)
            sorted_rows.write.mode("overwrite").partitionBy("part").parquet(f"{path}/{name}")
        counts.join(own, "p", "left").withColumn("part", F.coalesce("own", tail).cast("int")).drop("own").coalesce(8).write.mode("overwrite").parquet(f"{path}/predicates")
        info = graph_info(unique).first().asDict()
        self._write(f"{path}/info", json.dumps(info).encode())
        for name in ("set", "counted"):
            part_path, files = self._path(folder, name)
            files.delete(part_path, True)
        self._write(f"{path}/READY", json.dumps({"heavy": heavy, "tail": TAIL_PARTS}).encode())
        return info

    def _write(self, path: str, data: bytes) -> None:
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        files = target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        stream = files.create(target, True)
        stream.write(bytearray(data))
        stream.close()

    def upload(self, folder: str, name: str, data: bytes) -> str:
        """Write a file to ``folder`` of the databases' file system, where executors can read it; its path."""
        self._write(f"{folder.rstrip('/')}/{name}", data)
        return f"{folder.rstrip('/')}/{name}"

    def _read(self, *steps: str) -> dict:
        path, files = self._path(*steps)
        if not files.exists(path):
            raise StoreError(f"there is no database {steps[0]!r}")
        stream = files.open(path)
        try:
            text = bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()
        return json.loads(text)

    def info(self, name: str) -> dict[str, int]:
        return self._read(valid_name(name), "info")

    def open(self, name: str) -> StoredGraph:
        """The graph of a database with the statistics of its largest predicates."""
        ready, info = self._read(valid_name(name), "READY"), self._read(name, "info")
        path = f"{self.root}/{name}"
        rows = self.spark.read.parquet(f"{path}/predicates").orderBy(F.desc("rows"), "p").limit(KNOWN_MOST).collect()
        known = {row.p: Statistics(row.rows, row.subjects, row.objects, row.most_s, row.most_o) for row in rows}
        sums = Statistics(info["triples"], info["entities"], info["entities"])
        return StoredGraph(self.spark, path, ready["heavy"], ready["tail"], known, sums)

    def export(self, name: str, path: str) -> None:
        """Write the triples (s, p, o) of a database as plain Parquet."""
        self._read(valid_name(name), "READY")
        self.spark.read.parquet(f"{self.root}/{name}/pso").select("s", "p", "o").write.parquet(path)

    def predicate_statistics(self, name: str) -> DataFrame:
        """(p, part, rows, subjects, objects, most_s, most_o), all exact."""
        self._read(valid_name(name), "READY")
        return self.spark.read.parquet(f"{self.root}/{name}/predicates")
