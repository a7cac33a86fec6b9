"""Filling containers of fixed capacity with whole documents (problem 7).

Sum-of-squares packing: a document goes where the sum of the squared numbers of open containers per residual gap becomes
smallest; that keeps no gap frequent, so that documents to come find a gap of their size. A text longer than the capacity is the
only one that may be cut; as its cuts are free, its parts first complete containers that short texts left open.

The documents are spread over shards by a hash of their key. A shard holds about ``SHARD`` documents whatever the size of the corpus: the
number of shards follows from the number of rows, so no task ever sees an unbounded group: equal rows are counted and numbered, so
that the rows of a repeated key are spread as well. Only (key, size) is shuffled, never the text. A shard leaves a few partly filled containers, a share of the space that falls with ``SHARD``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.encode import VOCABULARIES, count_tokens

#: Documents in a shard, about.
SHARD = 50_000

#: Tokens of the smallest part into which a long text is cut in order to complete a container.
LEAST_PART = 64


class SumOfSquares:
    """Open containers by residual gap, and the choice of the gap for the next item."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1)
        #: The counts again, but minus infinity for a gap that no container has: such a gap is never the best.
        self.offer = np.full(capacity + 1, -np.inf)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.opened = 0

    def _move(self, gap: int, by: int) -> None:
        self.count[gap] += by
        self.offer[gap] = self.count[gap] or -np.inf

    def put(self, size: int, gap: int) -> int:
        """Put an item of ``size`` into a container with ``gap`` left (a new one where gap is the capacity); its number."""
        if gap == self.capacity:
            number, self.opened = self.opened, self.opened + 1
        else:
            number = self.open[gap].pop()
            self._move(gap, -1)
        if gap > size:
            self.open[gap - size].append(number)
            self._move(gap - size, 1)
        return number

    def best(self, size: int) -> int:
        """The gap whose use makes the sum of squares smallest; of equal ones the tightest, a new container last."""
        c = self.capacity
        if size >= c:
            return c
        # One container moves from gap g to g - size: the sum changes by 2 (count[g - size] - count[g]) + 2. Full containers aren't counted.
        change = 2 * (self.count[: c - size] - self.offer[size:c]) + 2
        change[0] = 1 - 2 * self.offer[size]
        k = int(change.argmin())
        return k + size if change[k] <= 2 * self.count[c - size] + 1 else c

    def place(self, size: int) -> int:
        return self.put(size, self.best(size))

    def widest(self) -> int:
        """The largest residual gap of an open container, 0 if none is open."""
        held = np.flatnonzero(self.count)
        return int(held[-1]) if len(held) else 0


def pack(sizes: np.ndarray, capacity: int, least_part: int = LEAST_PART) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(item, start, length, container) of every part: each item once and whole, but those beyond the capacity in parts.

    Items are placed by falling size. An item of size 0 needs no space and gets container -1. The parts of a long item
    follow each other without gap or overlap, and no container ever holds more than the capacity.
    """
    order = np.argsort(-sizes, kind="stable")
    long, short = order[sizes[order] > capacity], order[(sizes[order] <= capacity) & (sizes[order] > 0)]
    state, out = SumOfSquares(capacity), []
    for k in short:
        out.append((k, 0, sizes[k], state.place(int(sizes[k]))))
    gaps = sum(int(state.count[g]) for g in range(least_part, capacity))
    share = -(-gaps // max(1, len(long))) + 1
    for k in long:
        at, size = 0, int(sizes[k])
        for _ in range(share):
            gap = state.widest()
            if gap < least_part or gap >= size - at:
                break
            out.append((k, at, gap, state.put(gap, gap)))
            at += gap
        while at < size:
            part = min(capacity, size - at)
            out.append((k, at, part, state.place(part)))
            at += part
    out += [(k, 0, 0, -1) for k in order[sizes[order] <= 0]]
    table = np.array(out, np.int64).reshape(-1, 4)
    return table[:, 0], table[:, 1], table[:, 2], table[:, 3]


#: Copies of one row that are numbered at once.
BLOCK = 10_000


def _numbered(df: DataFrame, key: str, size: str) -> DataFrame:
    """(key, _size, _copy) of every row of ``df``, equal rows being numbered from 0. They are counted first, which combines in the
    map tasks, and written out again block by block, so that a repeated row is never one long list."""
    counts = df.select(F.col(key), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("_size")).groupBy(key, "_size").agg(F.count(F.lit(1)).alias("_n"))
    blocks = counts.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_n - 1) div {BLOCK}"))))
    left = F.least(F.col("_n") - F.col("_block") * BLOCK, F.lit(BLOCK))
    place = F.explode(F.sequence(F.lit(0).cast("long"), left - 1))
    return blocks.withColumn("_place", place).select(key, "_size", (F.col("_block") * BLOCK + F.col("_place")).alias("_copy"))


def pack_sizes(df: DataFrame, key: str, size: str, capacity: int, rows: int | None = None, shard: int = SHARD, least_part: int = LEAST_PART) -> DataFrame:
    """(key, part, start, length, container): the containers of rows with a given size.

    part numbers the parts of an item from 0, start and length are in units of ``size``. container is null where nothing
    is to be placed (size 0 or null). Rows with equal or null keys are items of their own. An empty table gives no rows.
    ``rows`` is the number of rows of ``df`` if the caller knows it; else they are counted first. An item beyond the capacity may
    be cut into parts of ``least_part`` or more to complete containers; from the capacity on it is cut as seldom as can be.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    shards = max(1, -(-(df.count() if rows is None else rows) // shard))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["_tie", "_copy"], kind="stable", ignore_index=True)
        item, start, length, container = pack(group["_size"].to_numpy(np.int64), capacity, least_part)
        out = pd.DataFrame({"item": item, "start": start, "length": length, "container": container})
        out = out.sort_values(["item", "start"], ignore_index=True)
        out["part"] = out.groupby("item").cumcount()
        out[key] = group[key].take(out["item"]).array
        number = (group["_shard"].iloc[0].astype(np.int64) << 32) + out["container"]
        out["container"] = number.astype("Int64").where(out["container"] >= 0)
        return out[[key, "part", "start", "length", "container"]]

    schema = T.StructType([df.schema[key], *(T.StructField(name, T.LongType(), True) for name in ("part", "start", "length", "container"))])
    # A null key has no hash of its own: size and number of the copy spread its rows.
    tied = _numbered(df, key, size).withColumn("_tie", F.xxhash64(key, "_size"))
    sharded = tied.withColumn("_shard", F.pmod(F.xxhash64(F.lit(7), F.col(key), F.when(F.col(key).isNull(), F.col("_size")), F.when(F.col("_copy") > 0, F.col("_copy"))), F.lit(shards)).cast("int"))
    return sharded.groupBy("_shard").applyInPandas(run, schema)


def pack_documents(df: DataFrame, capacity: int = 2048, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = VOCABULARIES, least_part: int = LEAST_PART) -> DataFrame:
    """(key, part, start, length, container) of every document, measured in tokens of ``name``.

    Null and empty texts come out with length 0 and a null container. Other columns of ``df`` are ignored.
    """
    return pack_sizes(count_tokens(df, key, text, name, folder), key, "n_tokens", capacity, df.count(), least_part=least_part)
