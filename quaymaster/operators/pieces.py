"""Components, and work on each of them in one task: those of HELD edges at most are dealt out whole and worked out in memory, some at a time;
larger ones are left to programs that hold no component in one place."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..plans.staging import drop, staged

#: So many edges are joined in one task, and components of so many go out whole.
HELD = 1 << 20


def labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number that each one hangs together with, by links (a, b) and by the labels of earlier ones."""
    label = label.copy()
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


def numbers(*columns: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The columns' values as numbers in their order, and the values."""
    import pandas as pd

    code, value = pd.factorize(np.concatenate(columns), sort=True)
    return np.split(code, np.cumsum([len(c) for c in columns])[:-1]), value


def _column(c) -> np.ndarray:
    return c.to_numpy(zero_copy_only=False)


def chunks(batches: Iterator, most: int) -> Iterator[list[np.ndarray]]:
    """The columns of batches whose rows stand together by the first one, `most` rows or so at a time and no value of it in two."""
    held, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([_column(c) for c in batch.columns])
        n += batch.num_rows
        if n >= most:
            rows = [np.concatenate(x) for x in zip(*held, strict=True)]
            other = np.flatnonzero(rows[0] != rows[0][-1])
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield [x[:cut] for x in rows]
            held, n = [[x[cut:] for x in rows]], n - cut
    if n:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _joined(live: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, root) of edges (keys, a, b) that one task holds; roots are the smallest nodes."""
    kinds = live.schema
    schema = StructType([*(kinds[k] for k in keys), StructField("node", kinds["a"].dataType), StructField("root", kinds["a"].dataType)])

    def run(batches):
        import pyarrow as pa

        held = [[_column(c) for c in b.columns] for b in batches if b.num_rows]
        if not held:
            return
        *key, a, b = (np.concatenate(x) for x in zip(*held, strict=True))
        (a, b), node = numbers(a, b)
        place = np.zeros(len(a), np.int64)
        values = []
        for k in key:
            (code,), value = numbers(k)
            place = place * len(value) + code
            values.append(value)
        pair, at = np.unique(np.concatenate([place * len(node) + a, place * len(node) + b]), return_inverse=True)
        root = pair[labels(np.arange(len(pair)), *np.split(at, 2))]
        out, place = [], pair // len(node)
        for value in reversed(values):
            out.insert(0, value[place % len(value)])
            place //= len(value)
        yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip([*out, node[pair % len(node)], node[root % len(node)]], arrow, strict=True)], names=schema.names)

    from pyspark.sql.pandas.types import to_arrow_type

    arrow = [to_arrow_type(f.dataType) for f in schema]
    return live.select(*keys, "a", "b").repartition(1).mapInArrow(run, schema)


def contracted(edges: DataFrame, keys: list[str], held: int = HELD, ready: bool = False, rounds: int = 100) -> tuple[DataFrame, bool]:
    """(keys, node, root) for all nodes of edges (keys, src, dst) but those that roots are named by, or for all, with the smallest nodes as
    roots, if the second value says so. `ready` edges are a table that is cheap to read again. In a round a part of the nodes, drawn by a hash, hang on the least of their neighbours of the other part; edges get
    the new ends, and those within one drop out, so that each round has fewer. The last `held` edges are joined in one task."""
    live = edges.where("src <> dst").select(*keys, F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b"))
    old = None
    if not ready:
        live = old = staged(live, "contracted")
    maps: list[DataFrame] = []
    for k in range(rounds):
        n, nodes = live.select(F.explode(F.array(F.xxhash64(*keys, "a"), F.xxhash64(*keys, "b"))).alias("x")).agg(F.count("x") / 2, F.approx_count_distinct("x")).first()
        if n <= held:
            last = staged(_joined(live, keys), "joined")
            break
        each = int(min(64, max(2, n // nodes)))  # one node in so many stays: where nodes have many neighbours, few need to
        stays = lambda c, k=k, each=each: F.pmod(F.xxhash64(F.lit(k), *keys, c), F.lit(each)) == 0
        ends = live.select(*keys, F.col("a").alias("c"), F.col("b").alias("o")).unionAll(live.select(*keys, F.col("b").alias("c"), F.col("a").alias("o")))
        hang = staged(ends.where(~stays("c") & stays("o")).groupBy(*keys, "c").agg(F.min("o").alias("o")), "hang")
        maps.append(hang)
        for end in ("a", "b"):
            live = live.join(hang.select(*keys, F.col("c").alias(end), "o"), [*keys, end], "left").withColumn(end, F.coalesce("o", end)).drop("o")
        live = live.where("a <> b").select(*keys, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        new = staged(live.distinct() if n > nodes else live, "contracted")
        if old is not None:
            drop(old)
        live = old = new
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    if not maps:
        return last, True
    named = [last]
    for hang in reversed(maps):
        later = named[0]
        for t in named[1:]:
            later = later.unionByName(t)
        up = hang.join(later.select(*keys, F.col("node").alias("o"), "root"), [*keys, "o"], "left").select(*keys, F.col("c").alias("node"), F.coalesce("root", "o").alias("root"))
        named.append(staged(up, "named"))
        drop(hang)
    out = named[0].where("node <> root")
    for t in named[1:]:
        out = out.unionByName(t)
    return out, False


def stars(edges: DataFrame, keys: list[str], held: int = HELD, ready: bool = False) -> DataFrame:
    """(keys, node, root) for all nodes of edges (keys, src, dst); root is the smallest node of the component."""
    named, smallest = contracted(edges, keys, held, ready)
    if smallest:
        return named
    least = named.groupBy(*keys, "root").agg(F.min("node").alias("m"))
    least = staged(least.select(*keys, "root", F.least("m", "root").alias("m")), "least")
    every = named.join(least, [*keys, "root"]).select(*keys, "node", F.col("m").alias("root"))
    return every.unionByName(least.select(*keys, F.col("root").alias("node"), F.col("m").alias("root")))


def parted(edges: DataFrame, held: int = HELD, ready: bool = False, loops: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """edges (src, dst, ...), loops only if asked for, with a number c of their component: those of components of `held` edges at most, and the
    others, if there are any."""
    named, _ = contracted(edges, [], held, ready)
    own = (edges if loops else edges.where("src <> dst")).join(named.select(F.col("node").alias("src"), "root"), "src", "left")
    own = staged(own.withColumn("c", F.xxhash64(F.coalesce("root", "src"))).drop("root").select("c", *edges.columns), "parted")
    big = staged(own.groupBy("c").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > held).select("c"), "big")  # as many as `held` goes into all edges, at most
    if big.isEmpty():
        return own, None
    return own.join(F.broadcast(big), "c", "left_anti"), own.join(F.broadcast(big), "c", "left_semi")


def worked(small: DataFrame, columns: list[str], run: Callable, schema: str, held: int = HELD) -> DataFrame:
    """run(c, *columns), some whole components of `parted` at a time, rows of one together; it gives tables of arrays in the schema's order."""
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = [(f.name, to_arrow_type(f.dataType)) for f in StructType.fromDDL(schema)]

    def each(batches):
        import pyarrow as pa

        for rows in chunks(batches, held):
            for out in run(*rows):
                yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, (_, t) in zip(out, arrow, strict=True)], names=[n for n, _ in arrow])

    return small.select("c", *columns).repartition("c").sortWithinPartitions("c").mapInArrow(each, schema)
