"""Best-fit packing by a grouping genetic algorithm (operator 1).

Pieces of at most `capacity` ids are packed into sequences. Only the number of pieces of each length matters for that, so a
chromosome is a list of *patterns* (a multiset of lengths, and how many sequences are filled that way). A histogram has at most
`capacity` lengths and a best-fit pass adds at most four patterns for each length, so a chromosome has a bounded size however large
the corpus is; that is all that the driver and the islands hold. Pieces then take their places by their rank among the pieces of
their length, which is found block by block (common.ranked), so no length is ever brought together in one task.

Cases: null or empty text is a document of the end id alone; texts of any length are cut into full pieces; repeated rows are packed
like any other row; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

Pattern = tuple[tuple[int, int], ...]  # ((length, times), ...), longest first
Chromosome = dict[Pattern, int]


def used(p: Pattern) -> int:
    return sum(length * m for length, m in p)


def best_fit(loads: Chromosome, supply: dict[int, int], order: list[int], capacity: int) -> Chromosome:
    """Places `supply` (length -> pieces) into the open sequences of `loads` or new ones; in the given order of lengths, each into
    the sequences with the least room that is enough. Equal sequences are filled together."""
    rooms: dict[int, Counter] = {}
    for p, n in loads.items():
        rooms.setdefault(capacity - used(p), Counter())[p] += n
    # room -> patterns; a bitset of rooms finds the least room that is enough
    have = 0
    for r in rooms:
        have |= 1 << r

    def put(room: int, p: Pattern, n: int) -> None:
        nonlocal have
        rooms.setdefault(room, Counter())[p] += n
        have |= 1 << room

    for length in order:
        n = supply.get(length, 0)
        while n > 0:
            fits = have >> length
            if not fits:
                m = min(capacity // length, n)
                bins = n // m
                put(capacity - m * length, ((length, m),), bins)
                n -= bins * m
                continue
            room = length + ((fits & -fits).bit_length() - 1)
            group = rooms[room]
            p, copies = next(iter(group.items()))
            m = min(room // length, n)
            bins = min(copies, n // m)
            if bins == copies:
                del group[p]
                if not group:
                    del rooms[room]
                    have &= ~(1 << room)
            else:
                group[p] -= bins
            d = dict(p)
            d[length] = d.get(length, 0) + m
            put(room - m * length, tuple(sorted(d.items(), reverse=True)), bins)
            n -= bins * m
    out: Chromosome = {}
    for group in rooms.values():
        for p, n in group.items():
            out[p] = out.get(p, 0) + n
    return out


def cost(c: Chromosome, capacity: int) -> tuple[int, float]:
    """Fewer sequences first; among equals the one whose fill is more uneven, as that leaves room in one place."""
    bins = sum(c.values())
    return bins, -sum(n * (used(p) / capacity) ** 2 for p, n in c.items()) / max(1, bins)


def crossover(a: Chromosome, b: Chromosome, supply: dict[int, int], capacity: int, rng: random.Random) -> Chromosome:
    """Injects well-filled patterns of b into a, removes the sequences of a that hold pieces now placed twice, and best-fits the
    pieces displaced by that."""
    left = dict(supply)
    child: Chromosome = {}

    def take(p: Pattern, n: int) -> int:
        for length, m in p:
            n = min(n, left[length] // m)
        if n > 0:
            for length, m in p:
                left[length] -= m * n
            child[p] = child.get(p, 0) + n
        return n

    donors = sorted(b, key=used, reverse=True)
    full = [p for p in donors if used(p) >= 0.995 * capacity] or donors[: max(1, len(donors) // 4)]
    for p in rng.sample(full, max(1, len(full) // 2)):
        take(p, b[p])
    for p in sorted(a, key=used, reverse=True):
        if used(p) >= 0.9 * capacity or rng.random() < 0.7:
            take(p, a[p])
    rest = {length: n for length, n in left.items() if n}
    return best_fit(child, rest, sorted(rest, reverse=True), capacity)


def mutate(c: Chromosome, capacity: int, rng: random.Random) -> Chromosome:
    """Opens the worst-filled sequences and some others, and best-fits their pieces anew."""
    kept, rest = dict(c), Counter()
    worst = sorted(c, key=used)[: max(1, len(c) // 20)]
    for p in {*worst, *rng.sample(list(c), max(1, len(c) // 20))}:
        n = kept.pop(p)
        for length, m in p:
            rest[length] += m * n
    return best_fit(kept, rest, sorted(rest, reverse=True), capacity)


def evolve(supply: dict[int, int], capacity: int, population: list[Chromosome], generations: int, size: int, seed: int) -> list[Chromosome]:
    """One island for some generations, best first."""
    rng = random.Random(seed)
    floor = -(-sum(k * n for k, n in supply.items()) // capacity)
    lengths = sorted(supply, reverse=True)
    pop = list(population)
    while len(pop) < size:
        order = lengths
        if pop:  # after the plain best fit: long pieces first, the others in any order
            cut = rng.choice([capacity // 2, capacity // 3, capacity // 4])
            short = [x for x in lengths if x <= cut]
            rng.shuffle(short)
            order = [x for x in lengths if x > cut] + short
        pop.append(best_fit({}, supply, order, capacity))
        if sum(pop[-1].values()) == floor:
            return [pop[-1]]  # no packing has fewer sequences
    key = lambda c: cost(c, capacity)
    for _ in range(generations):
        pop.sort(key=key)
        if sum(pop[0].values()) == floor:
            break
        a, b = sorted(rng.sample(range(len(pop)), 2))
        child = crossover(pop[a], pop[b], supply, capacity, rng)
        if rng.random() < 0.5:
            child = mutate(child, capacity, rng)
        if key(child) < key(pop[-1]):
            pop[-1] = child
    return sorted(pop, key=key)


def _dump(c: Chromosome) -> bytes:
    return zlib.compress(repr(list(c.items())).encode())


def _load(b: bytes) -> Chromosome:
    import ast

    return dict(ast.literal_eval(zlib.decompress(b).decode()))


def plan(spark: SparkSession, supply: dict[int, int], capacity: int, islands: int = 4, epochs: int = 3, generations: int = 12, size: int = 6) -> Chromosome:
    """The best chromosome of `islands` populations, each evolved in a task of its own; after each epoch the islands' best move on to
    the next island in the ring. What moves is bounded by `capacity`, not by the corpus."""
    if not supply:
        return {}
    floor = -(-sum(k * n for k, n in supply.items()) // capacity)
    first = best_fit({}, supply, sorted(supply, reverse=True), capacity)
    if sum(first.values()) == floor:
        return first
    pops = [[_dump(first)] for _ in range(islands)]
    for epoch in range(epochs):
        sent = spark.sparkContext.broadcast((supply, pops))

        def run(batches, epoch=epoch, sent=sent):
            import pyarrow as pa

            for b in batches:
                for k in b.column(0).to_pylist():
                    own, populations = sent.value
                    best = evolve(own, capacity, [_load(x) for x in populations[k]], generations, size, 1000 * epoch + k)
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([[_dump(c) for c in best]], pa.list_(pa.binary()))], names=["island", "population"])

        # a partition for each island, dealt out without a hash, so that all run side by side
        got = dict(spark.range(0, islands, 1, islands).mapInArrow(run, "island long, population array<binary>").collect())
        sent.unpersist()
        pops = [[bytes(x) for x in got[k]] for k in range(islands)]
        best = min((_load(p[0]) for p in pops), key=lambda c: cost(c, capacity))
        if sum(best.values()) == floor:
            return best
        elites = [p[0] for p in pops]
        pops = [[*p[:-1], elites[k - 1]] if len(p) > 1 else [p[0], elites[k - 1]] for k, p in enumerate(pops)]
    return best


def places(c: Chromosome) -> dict[str, np.ndarray]:
    """The chromosome as intervals of ranks: pieces of `length` with ranks from `first` on go, `times` to a sequence, to the sequences
    from `sequence` on, at `offset`."""
    rows, seq, rank = [], 0, Counter()
    for p in sorted(c, key=lambda p: (-used(p), p)):
        offset = 0
        for length, m in p:
            rows.append((length, rank[length], m, seq, offset))
            rank[length] += m * c[p]
            offset += m * length
        seq += c[p]
    rows.sort()
    a = np.array(rows, np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "times", "sequence", "offset"), a.T, strict=True))


def pieces(docs: DataFrame, spec: str, capacity: int, end_id: int) -> DataFrame:
    """Each document's pieces: doc_id, piece, start, length, ids_crc32."""
    spec_b = docs.sparkSession.sparkContext.broadcast(spec)
    schema = C.schema_of(docs, "doc_id", piece=C.INT, start=C.LONG, length=C.LONG, ids_crc32=C.LONG)

    def run(batches):
        import pyarrow as pa

        enc = C.encoder(spec_b.value, end_id)
        for batch in batches:
            for part in C.slices(batch, C.ENCODE_BYTES):
                take, piece, start, length, crc = [], [], [], [], []
                for i, raw in enumerate(enc.encode(part.column(1).to_pylist())):
                    for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                        own = raw[at : at + 4 * capacity]
                        take.append(i)
                        piece.append(k)
                        start.append(at // 4)
                        length.append(len(own) // 4)
                        crc.append(zlib.crc32(own))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(take, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pack(docs: DataFrame, spec: str | None = None, capacity: int = 4096, end_id: int = 1, islands: int = 4, epochs: int = 3) -> DataFrame:
    """Packs the documents (doc_id, text) into as few sequences of `capacity` ids as it can."""
    spark = docs.sparkSession
    rows = C.staged(pieces(docs, spec or C.tokenizer_spec(), capacity, end_id).withColumn("_tie", F.monotonically_increasing_id()), "pieces")  # rows alike in all else do not share a block
    supply = {int(r["length"]): r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    at = places(plan(spark, supply, capacity, islands, epochs))
    got = C.ranked(rows, ["length"], ["doc_id", "piece", "ids_crc32", "_tie"], C.blocks_for(spark, sum(supply.values()), 200_000))
    schema = C.schema_of(docs, "doc_id", piece=C.INT, start=C.LONG, length=C.LONG, ids_crc32=C.LONG, sequence_id=C.LONG, offset=C.LONG)

    def place(batches):
        import pyarrow as pa

        key = at["length"] * (1 << 44) + at["first"]
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            i = np.searchsorted(key, length * (1 << 44) + rank, side="right") - 1
            k = rank - at["first"][i]
            seq = at["sequence"][i] + k // at["times"][i]
            offset = at["offset"][i] + k % at["times"][i] * length
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in schema.names[:5]), pa.array(seq), pa.array(offset)], names=schema.names)

    return got.select(*schema.names[:5], "rank").mapInArrow(place, schema)


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(C.documents(spark, sf_dir))


QUERIES = {"op1_best_fit_packing": op1_pack}
SQL: dict[str, str] = {}
