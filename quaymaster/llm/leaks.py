"""Benchmark decontamination by greedy string tiling (operator 5).

Words are runs of letters and digits in lower case. A document and a benchmark item that share a seed (MIN_MATCH words in a row) are
tiled: Running Karp-Rabin finds the longest match of words not yet marked (window hashes of both sides are compared at the lengths of a
bisection), marks all matches of that length that do not overlap, and goes on until none of MIN_MATCH words is left. An item counts as
leaked where its tiles cover at least COVER of its words, in whatever order they stand in the document. Only the parts of a document
that share seeds with the item take part, and each round marks a shorter length than the one before, so repeated words cost no more.

The benchmark is a stated query set: it is indexed in blocks of at most BLOCK_WORDS words (or one item), and each block is sent to all
tasks and run against all documents; where there are several, each one's result is staged before the next is sent. Documents are never
dealt by a seed, so a passage in any number of documents makes no hot key.

Cases: null texts and texts of fewer than MIN_MATCH words have no seeds and no rows; so have items of fewer than MIN_MATCH words, as
MIN_MATCH is the shortest tile that the method takes for more than chance (a smaller `least` finds shorter items); ties go to the
earliest place in the item, then in the document; repeated rows give repeated pairs; empty tables give an empty result; other columns
are ignored.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

MIN_MATCH, COVER = 5, 0.5
BLOCK_WORDS = 2_000_000
_WORDS = re.compile(r"[^\W_]+").findall
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return _WORDS(text.lower()) if text else []


def prefix_hash(ids: np.ndarray) -> np.ndarray:
    """Karp-Rabin hashes of all prefixes, modulo 2^64: h[i] is that of ids[:i] (word i weighs BASE^i, so windows are compared scaled)."""
    n = len(ids)
    power = np.ones(n + 1, np.uint64)
    power[1:] = np.multiply.accumulate(np.full(n, _BASE, np.uint64)) if n else 1
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    out = np.zeros(n + 1, np.uint64)
    np.cumsum(mixed * power[:-1], out=out[1:], dtype=np.uint64)
    return out


_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all windows of k words, wherever they stand."""
    n = len(h) - 1 - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    back = np.ones(n, np.uint64)
    back[1:] = np.multiply.accumulate(np.full(n - 1, _INVERSE, np.uint64)) if n > 1 else 1
    return (h[k:] - h[:-k]) * back


def tiles(doc: np.ndarray, item: np.ndarray, least: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in the item, place in doc, length) of each tile. Words below 0 match nothing."""
    hd, hi = prefix_hash(doc), prefix_hash(item)
    taken_d, taken_i = doc < 0, np.zeros(len(item), bool)
    out: list[tuple[int, int, int]] = []

    def free(taken: np.ndarray, n: int) -> np.ndarray:
        """The places where n words that are not taken begin."""
        before = np.zeros(len(taken) + 1, np.int64)
        np.cumsum(taken, out=before[1:])
        return np.flatnonzero(before[n:] == before[:-n]) if n <= len(taken) else np.zeros(0, np.int64)

    def shared(n: int):
        """Places in the item and in doc of free windows of n words that both have, and the windows' hashes."""
        p, t = free(taken_i, n), free(taken_d, n)
        wp, wt = windows(hi, n)[p], windows(hd, n)[t]
        t = t[np.isin(wt, wp)]
        wt = windows(hd, n)[t]
        p = p[np.isin(wp, wt)]
        return p, windows(hi, n)[p], t, wt

    longest = min(len(item), len(doc))
    while longest >= least and len((found := shared(least))[0]):
        low, high = least, longest
        while low < high:  # the longest length at which both have a free window in common
            mid = (low + high + 1) // 2
            if len((more := shared(mid))[0]):
                low, found = mid, more
            else:
                high = mid - 1
        longest = low
        p, wp, t, wt = found
        # each window's places in doc, in order; a place that is taken once stays so
        order = np.argsort(wt, kind="stable")
        t, wt = t[order].tolist(), wt[order]
        next_of = dict(zip(wp.tolist(), np.searchsorted(wt, wp, "left").tolist(), strict=True))
        end_of = dict(zip(wp.tolist(), np.searchsorted(wt, wp, "right").tolist(), strict=True))
        upto = 0
        for at, h in zip(p.tolist(), wp.tolist(), strict=True):
            if at < upto:
                continue
            k = next_of[h]
            while k < end_of[h] and (taken_d[t[k]] or taken_d[t[k] + longest - 1]):  # tiles of this round have this length
                k += 1
            next_of[h] = k
            if k < end_of[h] and np.array_equal(doc[t[k] : t[k] + longest], item[at : at + longest]):
                taken_i[at : at + longest] = taken_d[t[k] : t[k] + longest] = True
                out.append((at, t[k], longest))
                upto = at + longest
        longest -= 1
    return out


class Index:
    """A block of benchmark items: their words as numbers, and where each seed stands."""

    def __init__(self, items: list[tuple[int, str | None]], least: int = MIN_MATCH):
        self.least = least
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        seeds, owner, place = [], [], []
        number = self.vocabulary.setdefault
        for item_id, text in items:
            ids = np.array([number(w, len(self.vocabulary)) for w in words_of(text)], np.int64)
            if len(ids) < least:
                continue
            s = windows(prefix_hash(ids), least)
            seeds.append(s)
            owner.append(np.full(len(s), len(self.items)))
            place.append(np.arange(len(s)))
            self.items.append((item_id, ids))
        cat = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
        seed = cat(seeds, np.uint64)
        order = np.argsort(seed, kind="stable")
        self.seed, self.owner, self.place = seed[order], cat(owner, np.int64)[order], cat(place, np.int64)[order]

    def hits(self, text: str | None, cover: float = COVER) -> list[tuple]:
        """(item_id, n_words, covered, tiles, longest) of each item that the text leaks."""
        words = words_of(text)
        if len(words) < self.least or not len(self.seed):
            return []
        get = self.vocabulary.get
        doc = np.array([get(w, -1) for w in words], np.int64)
        known = doc >= 0
        if np.count_nonzero(known) < self.least:
            return []
        h = prefix_hash(doc)
        run = np.cumsum(np.concatenate([[0], known]))
        full = np.flatnonzero(run[self.least :] - run[: -self.least] == self.least)
        if not len(full):
            return []
        w = windows(h, self.least)[full]
        left = np.searchsorted(self.seed, w, "left")
        w = w[(left < len(self.seed)) & (self.seed[np.minimum(left, len(self.seed) - 1)] == w)]
        if not len(w):
            return []
        met = np.unique(w)
        a, b = np.searchsorted(self.seed, met, "left"), np.searchsorted(self.seed, met, "right")
        at = np.repeat(b - np.cumsum(b - a), b - a) + np.arange(int((b - a).sum()))
        owner, place, seed = self.owner[at], self.place[at], self.seed[at]
        order = np.lexsort((place, owner))
        owner, place, seed = owner[order], place[order], seed[order]
        # no tiling covers more than all shared seeds do
        edge = np.flatnonzero(np.diff(owner, append=-1))
        gap = np.minimum(np.diff(place, append=0), self.least)
        gap[edge] = self.least
        could = np.add.reduceat(gap, np.concatenate([[0], edge[:-1] + 1]))
        out = []
        for e, most in zip(edge.tolist(), could.tolist(), strict=True):
            item_id, ids = self.items[owner[e]]
            if most < cover * len(ids):
                continue
            own = seed[np.searchsorted(owner, owner[e], "left") : e + 1]
            inside = np.zeros(len(doc) + 1, np.int64)
            starts = full[np.isin(windows(h, self.least)[full], own)]
            np.add.at(inside, starts, 1)
            np.add.at(inside, starts + self.least, -1)
            part = np.flatnonzero(np.cumsum(inside[:-1]))  # the words of doc in shared seeds; -1 parts what does not stand together
            cut = np.flatnonzero(np.diff(part) > 1) + 1
            got = tiles(np.insert(doc[part], cut, -1), ids, self.least)
            covered = sum(x[2] for x in got)
            if covered >= cover * len(ids):
                out.append((item_id, len(ids), covered, len(got), max(x[2] for x in got)))
        return out


def blocks(benchmark: DataFrame, most: int = BLOCK_WORDS):
    """The benchmark's items in blocks of at most `most` words (or one item), read in doses."""
    now, n = [], 0
    for r in benchmark.select("item_id", "text").orderBy("item_id").toLocalIterator():
        size = len(words_of(r["text"]))
        if now and n + size > most:
            yield now
            now, n = [], 0
        now.append((r["item_id"], r["text"]))
        n += size
    yield now


_INDEX: dict[str, Index] = {}


def _index(sent, token: str, least: int) -> Index:
    """The index of the block sent, one for each Python worker, kept between tasks."""
    C.claim("leaks", _INDEX.clear)
    if token not in _INDEX:
        _INDEX.clear()
        _INDEX[token] = Index(sent.value, least)
    return _INDEX[token]


def _by_block(benchmark: DataFrame, work):
    """work(broadcast, token) for each block. If there are several, each one's result is staged and its broadcast ends."""
    sc, todo = benchmark.sparkSession.sparkContext, blocks(benchmark)
    now = next(todo)
    while now is not None:
        after = next(todo, None)
        sent = sc.broadcast(now)
        part = work(sent, uuid.uuid4().hex)
        if after is not None:
            part = C.staged(part, "leaks")
            sent.unpersist()
        yield part
        now = after


def leaked(docs: DataFrame, benchmark: DataFrame, least: int = MIN_MATCH, cover: float = COVER) -> DataFrame:
    """doc_id, item_id, n_words (of the item), covered, coverage, tiles and longest for each leaked pair of docs (doc_id, text) and benchmark (item_id, text)."""
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("item_id", benchmark.schema["item_id"].dataType), *(T.StructField(k, C.LONG) for k in ("n_words", "covered", "tiles", "longest"))])

    def work(sent, token):
        def run(batches):
            import pyarrow as pa

            index = _index(sent, token, least)
            for batch in batches:
                for part in C.slices(batch):
                    take, rows = [], []
                    for i, text in enumerate(part.column(1).to_pylist()):
                        for r in index.hits(text, cover):
                            take.append(i)
                            rows.append(r)
                    if rows:
                        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(take)), pa.array([r[0] for r in rows], item_type), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(1, 5))], names=schema.names)

        return docs.select("doc_id", "text").mapInArrow(run, schema)

    from pyspark.sql.pandas.types import to_arrow_type

    item_type = to_arrow_type(schema["item_id"].dataType)
    out = None
    for part in _by_block(benchmark, work):
        out = part if out is None else out.unionByName(part)
    return out.select("doc_id", "item_id", "n_words", "covered", (F.col("covered") / F.col("n_words")).alias("coverage"), "tiles", "longest")


def without_leaks(docs: DataFrame, benchmark: DataFrame, least: int = MIN_MATCH, cover: float = COVER) -> DataFrame:
    """The rows of docs (with any columns, `text` among them) that leak no item. Rows are sifted where they lie; nothing is shuffled."""
    schema, at = docs.schema, docs.columns.index("text")
    left = docs

    def work(sent, token):
        def run(batches):
            import pyarrow as pa

            index = _index(sent, token, least)
            for batch in batches:
                for part in C.slices(batch):
                    yield part.filter(pa.array([not index.hits(t, cover) for t in part.column(at).to_pylist()], pa.bool_()))

        return left.mapInArrow(run, schema)

    for part in _by_block(benchmark, work):
        left = part
    return left


def op5_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked(C.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op5_benchmark_leaks": op5_leaks}
SQL: dict[str, str] = {}
