from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brindle.llm.encode import encode
from brindle.llm.packing import SumOfSquares, pack, pack_documents, pack_sizes


def check(sizes, capacity, item, start, length, container):
    sizes = np.asarray(sizes)
    assert np.array_equal(np.bincount(item, length, len(sizes)).astype(int), sizes)
    used = container >= 0
    assert (length[used] > 0).all() and (length[~used] == 0).all()
    if used.any():
        assert np.bincount(container[used], length[used]).max() <= capacity
    for k in range(len(sizes)):
        mine = np.flatnonzero(item == k)
        mine = mine[np.argsort(start[mine])]
        assert len(mine) == 1 or sizes[k] > capacity
        assert np.array_equal(start[mine], np.concatenate(([0], np.cumsum(length[mine])[:-1])))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 60), max_size=40), st.integers(1, 20), st.integers(1, 5))
def test_nothing_is_lost_split_or_overfull(sizes, capacity, least):
    check(sizes, capacity, *pack(np.array(sizes, int), capacity, least))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 11), min_size=1, max_size=40))
def test_choice_minimises_the_sum_of_squares(sizes):
    state = SumOfSquares(12)
    for size in sizes:
        def total(gap):
            count = state.count.copy()
            if gap < 12:
                count[gap] -= 1
            if gap > size:
                count[gap - size] += 1
            return int((count[1:12] ** 2).sum())

        allowed = [g for g in range(size, 12) if state.count[g]] + [12]
        best = state.best(size)
        assert best in allowed and total(best) == min(map(total, allowed))
        state.put(size, best)
        assert [len(x) for x in state.open] == state.count.astype(int).tolist()


def test_little_space_is_unused():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 1500, 5000)
    *_, container = pack(sizes, 2048)
    assert sizes.sum() / ((container.max() + 1) * 2048) > 0.99


def test_tables(spark):
    rows = [(k, n, "clash", 0) for k, n in enumerate([5, 0, None, 25, 10, 10, 3, 7, 4])] + [(0, 5, "clash", 0), (None, 2, "clash", 0)]
    df = spark.createDataFrame(rows, "id long, size long, part string, container int")
    out = pack_sizes(df, "id", "size", 10).collect()
    assert sum(r.length for r in out) == sum(r[1] or 0 for r in rows)
    load = {}
    for r in out:
        assert (r.container is None) == (r.length == 0)
        if r.length:
            load[r.container] = load.get(r.container, 0) + r.length
    assert max(load.values()) <= 10 and sum(1 for r in out if r.id == 3) >= 3 and sum(1 for r in out if r.id == 0) == 2
    many = pack_sizes(df, "id", "size", 10, shard=3)
    assert len({r.container >> 32 for r in many.collect() if r.container is not None}) > 1
    assert sorted((r.id is None, r.id or 0, r.length) for r in many.where("id <> 3").collect()) == sorted((r.id is None, r.id or 0, r.length) for r in out if r.id != 3 and r.id is not None)
    assert pack_sizes(df.limit(0), "id", "size", 10).collect() == []
    with pytest.raises(ValueError):
        pack_sizes(df, "id", "size", 0)


def test_documents_are_measured_in_tokens(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = pack_documents(docs, 512).groupBy("doc_id").agg({"length": "sum"}).collect()
    want = {r.doc_id: len(encode(r.text)) for r in docs.select("doc_id", "text").collect()}
    assert {r[0]: r[1] for r in out} == want


def test_repeated_rows_are_spread(spark):
    rows = spark.range(3000).selectExpr("case when id < 2500 then 7 else id end as k", "cast(case when id < 2500 then 30 else 10 + id % 90 end as int) as n")
    rows = rows.unionByName(spark.range(700).selectExpr("cast(null as long) as k", "40 as n"))
    parts = pack_sizes(rows, "k", "n", 100, shard=50).collect()
    assert len(parts) == 3700 and sum(r.length for r in parts) == rows.agg({"n": "sum"}).first()[0]
    assert Counter(r.k for r in parts)[7] == 2500 and Counter(r.k for r in parts)[None] == 700
    load = Counter()
    for r in parts:
        load[r.container] += r.length
    assert max(load.values()) <= 100
    by_shard = Counter(r.container >> 32 for r in parts)
    assert len(by_shard) > 60 and max(by_shard.values()) < 150


def test_least_part(spark):
    rows = spark.createDataFrame([(1, 250), (2, 60), (3, 30)], "k long, n int")
    cut = {row.k: [] for row in rows.collect()}
    for row in pack_sizes(rows, "k", "n", 100, least_part=100).collect():
        cut[row.k].append((row.start, row.length))
    assert sorted(cut[1]) == [(0, 100), (100, 100), (200, 50)] and cut[2] == [(0, 60)]
