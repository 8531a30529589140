"""SimHash near-duplicates by pivot distance tables (operator 2).

A fingerprint has a bit for each bit of XXH64 that is set in over half of the text's word shingles. Fingerprints within `RADIUS`
differing bits are linked, and linked documents form components.

How links are found, on distinct fingerprints only (copies are folded before), from a table of each one's Hamming distances to fixed
reference fingerprints, the pivots. Pivots come in families: a base, and the base with one of eight blocks of bits inverted. The
difference of the distances to a base and to such a variant counts the disagreements with the base in that block alone, and the block's
profile is these differences over all families. Two differing bits leave the profiles of six blocks equal at least, so each fingerprint
is dealt out under the profiles of each choice of six blocks, 28 ways. The families' bases are the rows of a Hadamard matrix, so a
profile tells its block: a group has 65,536 fingerprints at most, whatever the corpus holds, and unrelated ones hardly meet. (Grid cells
of plain pivot distances would have to be dealt to all neighbouring cells, and random fingerprints all lie within a few units of 32 from
any pivot: at ten million fingerprints that is thousands of times as many pairs or rows.)

In a task each group is sorted by the distance to its first pivot; pairs are discarded where any coordinate of the table differs by
more than the radius (the triangle inequality), and what survives is verified. Each group gives at most one link a member, to the
smallest fingerprint that it reaches in the group, so links do not grow with the square of a group. Components come from alternating
large and small stars, each round in a checkpoint. Rows get their component by a join on the fingerprint, except for fingerprints of more
than a HOT-th of all rows, which are HOT at most and broadcast.

Cases: null and wordless texts have fingerprint zero and are linked like any other; fewer words than a shingle make one shingle of
all; very long texts are counted in stretches; repeated rows are linked; a null doc_id never is a component_id unless its component
has no other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.pieces import stars
from . import common as C

RADIUS = 2
BLOCKS = 8
#: So many coordinates are compared in a group, those of the bases and of the first variants.
TABLE = 24
CHUNK = 1 << 18


def fingerprint_of(text: str | None, words: int = 3) -> int:
    """The 64-bit fingerprint of a whole text, unsigned."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    w = text.encode().lower().split() if text else []  # bytes: only A-Z change case, and words end at the six ASCII white-space characters
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)]
    n, ones = 0, np.zeros(64, np.int64)
    it = iter(shingles)
    while part := [digest(x, 42) for x in itertools.islice(it, 1 << 16)]:
        bits = np.unpackbits(np.array(part, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.uint32)
        n += len(part)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes())


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and fp, the fingerprint's bits as a signed 64-bit integer."""
    schema = C.schema_of(docs, "doc_id", fp=C.LONG)

    def run(batches):
        import pyarrow as pa

        C.claim("fingerprints", dict)  # nothing is remembered here, nor what others did
        for batch in batches:
            for part in C.slices(batch):
                fp = np.array([fingerprint_of(t, words) for t in part.column(1).to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp)], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def families(blocks: int = BLOCKS) -> list[list[int]]:
    """The pivots: families of a base and its variants with one block inverted. The bases repeat a row of the Hadamard matrix of the
    blocks' size (a bit is the parity of the common ones of its place and the row's number)."""
    size = 64 // blocks
    out = []
    for row in range(size):
        base = sum((((k % size) & row).bit_count() & 1) << k for k in range(64))
        out.append([base, *(base ^ ((1 << size) - 1) << size * b for b in range(blocks))])
    return out


def pivots() -> np.ndarray:
    """All pivots, one of each family first."""
    own = families()
    return np.array([f[k] for k in range(len(own[0])) for f in own], np.uint64)


def profiles(fp: Column, blocks: int = BLOCKS) -> list[Column]:
    """For each block: the differences of the pivot distances that tell it, a byte for each family."""
    def distance(p: int) -> Column:
        return F.bit_count(fp.bitwiseXOR(F.lit(_signed(p)))).cast("long")

    own, size = families(blocks), 64 // blocks
    out = []
    for b in range(blocks):
        at = F.lit(0).cast("long")
        for k, f in enumerate(own):  # the difference is even, from -size to size
            at = at.bitwiseOR(F.shiftleft(F.shiftright(distance(f[0]) - distance(f[b + 1]) + size, 1), 64 // size * k))
        out.append(at)
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def group_links(key: np.ndarray, fp: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, a smaller one that it reaches in its group). Rows of a key stand together, by their distance to the first pivot."""
    n = len(key)
    all_pivots = pivots()
    table = np.stack([np.bitwise_count(fp ^ p) for p in all_pivots[:TABLE]]).astype(np.int16)
    label = np.arange(n)

    def contract(a: np.ndarray, b: np.ndarray) -> None:
        while True:  # smaller labels spread along the links, and labels of labels are followed
            x, y = label[a], label[b]
            if (x == y).all():
                return
            low = np.minimum(x, y)
            np.minimum.at(label, x, low)
            np.minimum.at(label, y, low)
            while (label[label] != label).any():
                label[:] = label[label]

    pend: list[tuple[np.ndarray, np.ndarray]] = []
    i, s = np.arange(n), 1
    while len(i):
        i = i[i + s < n]
        i = i[(key[i] == key[i + s]) & (table[0, i + s] - table[0, i] <= radius)]
        a, b = i, i + s
        for row in table[1:]:
            if not len(a):
                break
            keep = np.abs(row[a] - row[b]) <= radius
            a, b = a[keep], b[keep]
        near = np.bitwise_count(fp[a] ^ fp[b]) <= radius
        if near.any():
            pend.append((a[near], b[near]))
            if sum(len(x) for x, _ in pend) > 1 << 20:
                contract(*map(np.concatenate, zip(*pend, strict=True)))
                pend = []
        s += 1
    if pend:
        contract(*map(np.concatenate, zip(*pend, strict=True)))
    # each component of the chunk hangs on its smallest fingerprint
    order = np.lexsort((fp, label))
    first = np.flatnonzero(np.diff(label[order], prepend=-1))
    root = np.empty(n, np.uint64)
    root[order] = np.repeat(fp[order][first], np.diff(np.append(first, n)))
    other = root != fp
    return fp[other], root[other]


def links(fps: DataFrame) -> DataFrame:
    """Links a > b between distinct fingerprints (column fp) within the radius, enough to connect all that are."""
    told = fps.select("fp", *[p.alias(f"p{b}") for b, p in enumerate(profiles(F.col("fp")))])
    choices = itertools.combinations(range(BLOCKS), BLOCKS - RADIUS)
    keys = F.array(*[F.xxhash64(F.lit(k), *[f"p{b}" for b in own]) for k, own in enumerate(choices)])
    first = F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(int(pivots()[0])))))
    dealt = told.select("fp", F.explode(keys).alias("key")).repartition("key").withColumn("d", first).sortWithinPartitions("key", "d").select("key", "fp")

    def run(batches):
        import pyarrow as pa

        def out(key, fp):
            a, b = group_links(key, fp.view(np.uint64))
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        keys, fp, n = [], [], 0
        for batch in batches:
            keys.append(batch.column(0).to_numpy())
            fp.append(batch.column(1).to_numpy())
            n += len(keys[-1])
            if n >= CHUNK:
                k, f = np.concatenate(keys), np.concatenate(fp)
                cut = int(np.flatnonzero(k != k[-1])[-1]) + 1 if k[0] != k[-1] else 0
                if cut:
                    yield out(k[:cut], f[:cut])
                keys, fp, n = [k[cut:]], [f[cut:]], len(k) - cut
        if n:
            yield out(np.concatenate(keys), np.concatenate(fp))

    return dealt.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node of its component) for all nodes of edges (a, b)."""
    return stars(edges.select(F.col("a").alias("src"), F.col("b").alias("dst")), [])


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest doc_id reachable) for each row of docs (doc_id, text)."""
    rows = C.staged(fingerprints(docs, words), "fps")
    fps = C.staged(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "distinct")
    roots = components(links(fps.select("fp")))
    named = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))
    linked = named.where(F.col("root") != F.col("fp")).select("root").distinct()
    best = named.join(linked, "root", "left_semi").groupBy("root").agg(F.min("first").alias("component"))
    table = C.staged(named.join(best, "root", "left").select("fp", "n", F.coalesce("component", "first").alias("component_id")), "components")
    C.drop_stage(fps)
    return C.joined(rows, table, "fp", "n").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: For similar texts: words of 64 bits in a long fingerprint, keys and blocks of a key, and the share of differing bits that
#: texts of a Jaccard similarity of 0.8 are expected to have (the angle between their shingle sets, over a half turn).
WORDS64, KEYS, KEY_BLOCKS = 4, 128, 4
SIMILARITY = 0.8
#: Classes in which hot keys are looked for; what they are decides how links are found, not which.
HOT_SAMPLE = 100_000
_MIX = [0, *(int(x) | 1 for x in np.random.default_rng(5).integers(0, 1 << 63, WORDS64 - 1))]


def hashes(text: str | None, words: int = 5) -> np.ndarray:
    """XXH64 of all shingles of a whole text, in its order."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    w = text.encode().lower().split() if text else []
    if not w:
        return np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)]
    return np.fromiter((digest(x, 42) for x in shingles), np.uint64)


def long_fingerprint(text: str | None, words: int = 5) -> np.ndarray:
    """WORDS64 words: the 64-bit fingerprint, and those of WORDS64 - 1 other hashes of the shingles, mixed from the first."""
    return _long_fingerprint(hashes(text, words))


def _long_fingerprint(own: np.ndarray) -> np.ndarray:
    if not len(own):
        return np.zeros(WORDS64, np.uint64)
    ones = np.zeros(64 * WORDS64, np.int64)
    for i in range(0, len(own), 1 << 14):
        h = own[i : i + (1 << 14)]
        every = np.empty((len(h), WORDS64), np.uint64)
        for k, m in enumerate(_MIX):
            every[:, k] = _mixed(h, m) if m else h
        ones += np.unpackbits(every.astype(">u8").view(np.uint8), axis=1).sum(axis=0, dtype=np.uint32)
    return np.packbits(2 * ones > len(own)).view(">u8").astype(np.uint64)


def set_digest(own: np.ndarray) -> bytes:
    """128 bits that tell a set of shingles, given by its distinct hashes in ascending order."""
    import hashlib

    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def _mixed(h: np.ndarray, m: int) -> np.ndarray:
    x = h * np.uint64(m)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


def _words() -> list[str]:
    return [f"fp{k}" for k in range(WORDS64)]


def long_fingerprints(docs: DataFrame, words: int = 5) -> DataFrame:
    """doc_id, a hash t of the text, the words of the long fingerprint, and the digest of the set of shingles (d0, d1)."""
    schema = C.schema_of(docs, "doc_id", **{k: C.LONG for k in ("t", *_words(), "d0", "d1")})

    def run(batches):
        import pyarrow as pa

        C.claim("fingerprints", dict)  # nothing is remembered here, nor what others did
        for batch in batches:
            pa.default_memory_pool().release_unused()
            for part in C.slices(batch, SET_BYTES):
                own = [hashes(t, words) for t in part.column(1).to_pylist()]
                fp = np.array([_long_fingerprint(h) for h in own], np.uint64).reshape(-1, WORDS64).view(np.int64)
                d = _digests(map(np.unique, own))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *(pa.array(np.ascontiguousarray(x)) for x in (*fp.T, *d.T))], names=schema.names)

    return docs.select("doc_id", "text", F.xxhash64("text").alias("t")).mapInArrow(run, schema)


def _digests(sets) -> np.ndarray:
    return np.frombuffer(b"".join(map(set_digest, sets)), "<i8").reshape(-1, 2)


def farthest(similarity: float = SIMILARITY) -> int:
    """So many bits of a long fingerprint may differ: what texts of this similarity are expected to differ by, and one deviation more."""
    n = 64 * WORDS64
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(n * p + math.sqrt(n * p * (1 - p)))


def block_profiles() -> np.ndarray:
    """The pivot profile of a block by its eight bits (blocks are alike, as bases repeat in each): see profiles."""
    x = np.arange(256, dtype=np.uint64)
    out = np.zeros(256, np.uint64)
    for k, f in enumerate(families()):
        gap = np.bitwise_count(x ^ np.uint64(f[0])).astype(np.int64) - np.bitwise_count(x ^ np.uint64(f[1])).astype(np.int64)
        out |= ((gap + 8) // 2).astype(np.uint64) << np.uint64(8 * k)
    return out


def rng_odd(n: int) -> np.ndarray:
    return np.random.default_rng(11).integers(0, 1 << 63, n, dtype=np.uint64) | np.uint64(1)


def similar_links(classes: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """First links (a, b), a > b, between classes (cid and the words of a long fingerprint): most of the similar ones, cheaply. Neither all
    nor only those: jaccard_links verifies them by their shingles and finds the rest.

    Each class is dealt out under KEYS keys, each of the pivot profiles of KEY_BLOCKS blocks drawn from all of the fingerprint's: classes
    that differ in a tenth of their bits share a key with a chance of 0.99, those that differ in a fourth with one of 0.01. Of those that share a key,
    each is compared with one, so links do not grow with the square of a group: pairs whose pivot distances differ by more than the bound
    are discarded, the others are verified. Keys that more than a HOT-th of the classes share, fewer than HOT for each of KEYS, are
    told from a sample and their classes compared with one of the sample where they lie; no other key brings so many together."""
    from pyspark.sql import Window as W

    rng = np.random.default_rng(7)
    chosen = np.array([rng.choice(BLOCKS * WORDS64, KEY_BLOCKS, replace=False) for _ in range(KEYS)])

    def run(batches):
        import pyarrow as pa

        table, odd = block_profiles(), rng_odd(KEY_BLOCKS)
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                fp = np.stack([part.column(1 + k).to_numpy() for k in range(WORDS64)], axis=1)
                own = table[np.ascontiguousarray(fp.astype("<i8")).view(np.uint8)]  # a row's profiles, block by block
                key = np.zeros((len(fp), KEYS), np.uint64) + np.arange(KEYS, dtype=np.uint64)
                for j in range(KEY_BLOCKS):
                    key = _mixed(key ^ own[:, chosen[:, j]], int(odd[j]))
                cid = np.repeat(part.column(0).to_numpy(), KEYS)
                yield pa.RecordBatch.from_arrays([pa.array(cid), pa.array(key.reshape(-1).view(np.int64))], names=["cid", "key"])

    dealt = classes.select("cid", *_words()).mapInArrow(run, "cid long, key long")
    n = classes.count()
    share = max(1, n // HOT_SAMPLE)
    sampled = dealt.where(F.pmod(F.xxhash64("cid"), F.lit(share)) == 0).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("cid").alias("b"))
    hot = C.staged(sampled.where(F.col("n") * C.HOT > max(20_000, n // share)).select("key", "b"), "hot-keys")
    first = F.min("cid").over(W.partitionBy("key"))
    if hot.isEmpty():
        found = dealt.withColumn("b", first)
    else:
        small = F.broadcast(hot)
        found = dealt.join(F.broadcast(hot.select("key")), "key", "left_anti").withColumn("b", first).select("cid", "b").unionByName(dealt.join(small, "key").select("cid", "b"))
    pairs = C.staged(found.where("cid <> b").select(F.greatest("cid", "b").alias("a"), F.least("cid", "b").alias("b")).distinct(), "pairs")
    own = [F.col(w).alias(f"{w}_b") for w in _words()]
    both = pairs.join(classes.select(F.col("cid").alias("a"), *_words()), "a").join(classes.select(F.col("cid").alias("b"), *own), "b")
    most = farthest(similarity)
    table = [F.abs(sum(F.bit_count(F.col(w).bitwiseXOR(F.lit(p))) - F.bit_count(F.col(f"{w}_b").bitwiseXOR(F.lit(p))) for w in _words())) for p in (_signed(f[0]) for f in families())]
    apart = sum(F.bit_count(F.col(w).bitwiseXOR(F.col(f"{w}_b"))) for w in _words())
    return both.where((F.greatest(*table) <= most) & (apart <= most)).select("a", "b")


#: So many classes are looked at for frequent shingles, those in so many of them count, and so many are told to the workers. What they
#: are decides how many pairs are compared, not which are linked.
FREQUENT_SAMPLE, FREQUENT_IN, FREQUENT = 30_000, 4, 100_000
#: Words in a sketch at most: the parities of how many shingles fall to each of its bits. One of fewer words has a bit for each shingle.
SKETCH = 16
#: So many classes' digests are broadcast at most.
FEW = 500_000
#: So many pairs of a group are formed at a time, and sets go out by so many bytes of text.
PAIRS, SET_BYTES = 1 << 20, 1 << 20
#: Rows that a task holds at a time, or those of one key if they are more.
MET = 1 << 16


def shingle_sets(docs: DataFrame, words: int = 5) -> DataFrame:
    """The set of shingles of each row: its digest (d0, d1) and its hashes in ascending order (as signed integers)."""
    def run(batches):
        import pyarrow as pa

        C.claim("fingerprints", dict)
        for batch in batches:
            pa.default_memory_pool().release_unused()
            for part in C.slices(batch, SET_BYTES):
                own = [np.unique(hashes(t, words)) for t in part.column(0).to_pylist()]
                d = _digests(own)
                yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(x)) for x in d.T), _lists(own)], names=["d0", "d1", "shingles"])

    return docs.select("text").mapInArrow(run, "d0 long, d1 long, shingles array<long>")


def _lists(parts: list[np.ndarray]):
    import pyarrow as pa

    edge = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(edge), pa.array(np.concatenate([*parts, np.zeros(0, np.uint64)]).view(np.int64)))


def frequent_shingles(docs: DataFrame, classes: int, words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, of shingles that many sets hold, and in how many of the sample they are. Equal sets count once."""
    share = -(-max(classes, 1) // FREQUENT_SAMPLE)
    some = shingle_sets(docs.where(F.pmod(C.crc_of_text(), F.lit(share)) == 0), words).groupBy("d0", "d1").agg(F.first("shingles").alias("shingles"))
    counts = some.select(F.explode("shingles").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= FREQUENT_IN)
    got = counts.orderBy(F.desc("n"), "h").limit(FREQUENT).toArrow()
    h, n = got.column("h").to_numpy().astype(np.int64).view(np.uint64), got.column("n").to_numpy().astype(np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def ratio(similarity: float) -> tuple[int, int]:
    """The similarity as a fraction, as it is written."""
    f = Fraction(str(similarity))
    if not 0 < f <= 1:
        raise ValueError("a similarity is above 0 and 1 at most")
    return f.numerator, f.denominator


def prefix_of(own: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], similarity: float = SIMILARITY) -> np.ndarray:
    """The first of a set's shingles in an order that all sets share (rare ones by hash, then frequent ones by frequency), so many that two
    similar sets have the first shingle that they share among them: a set that shares fewer than similarity x size cannot be similar."""
    p, q = ratio(similarity)
    if len(frequent[0]) and len(own):
        at = np.minimum(np.searchsorted(frequent[0], own), len(frequent[0]) - 1)
        rank = np.where(frequent[0][at] == own, frequent[1][at], 0)
        if rank.any():
            own = own[np.argsort(rank, kind="stable")]
    return own[: len(own) + 1 - -(-p * len(own) // q)] if len(own) else own


def sketch_of(own: np.ndarray) -> np.ndarray:
    """Up to SKETCH words, a power of two, whose bits are the parities of the shingles that fall to them: two sketches, folded to the words of
    the shorter one, differ in no more bits than their sets in shingles."""
    words = 1
    while words < SKETCH and 64 * words < len(own):
        words *= 2
    at = (own * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(64 * words)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=64 * words) & 1).astype(np.uint8)).view("<u8").astype(np.uint64)


def _padded(lists) -> np.ndarray:
    """Sketches as rows of SKETCH words, and each one's number of words as the last column."""
    n = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    out = np.zeros((len(n), SKETCH + 1), np.uint64)
    out[:, :SKETCH][np.arange(SKETCH) < n[:, None]] = lists.flatten().to_numpy().view(np.uint64)
    out[:, SKETCH] = n
    return out


def differing(sketch: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """In how many bits the padded sketches of rows i and j differ, each pair at the words of its shorter one."""
    own, words = np.minimum(sketch[i, SKETCH], sketch[j, SKETCH]), SKETCH
    apart, at = np.zeros(len(i), np.int64), sketch[:, :SKETCH]
    while words:
        here = np.flatnonzero(own == words)
        for k in range(words if len(here) else 0):
            apart[here] += np.bitwise_count(at[i[here], k] ^ at[j[here], k])
        words //= 2
        at = at[:, :words] ^ at[:, words : 2 * words]
    return apart


def prefixes(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], words: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """For each distinct set of shingles: its digest (d0, d1), size, prefix and sketch."""
    def run(batches):
        import pyarrow as pa

        C.claim("fingerprints", dict)
        for batch in batches:
            pa.default_memory_pool().release_unused()
            for part in C.slices(batch, SET_BYTES):
                own = [np.unique(hashes(t, words)) for t in part.column(0).to_pylist()]
                d = _digests(own)
                size = np.array([len(h) for h in own], np.int64)
                told = [_lists([prefix_of(h, frequent, similarity) for h in own]), _lists([sketch_of(h) for h in own])]
                yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(x)) for x in d.T), pa.array(size), *told], names=["d0", "d1", "size", "prefix", "sketch"])

    every = docs.select("text").mapInArrow(run, "d0 long, d1 long, size long, prefix array<long>, sketch array<long>")
    return every.groupBy("d0", "d1").agg(*[F.first(c).alias(c) for c in ("size", "prefix", "sketch")])


def group_pairs(key: np.ndarray, root: np.ndarray, cid: np.ndarray, size: np.ndarray, pos: np.ndarray, sketch: np.ndarray | None = None, similarity: float = SIMILARITY):
    """Pairs (a, b) of classes of a key and of different roots that may be similar by their sizes, by the places of the shared shingle in
    their prefixes and by their sketches, some at a time. Rows of a key stand together, by root; pairs of one root are linked already and never formed."""
    p, q = ratio(similarity)

    def ends(new: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(np.append(True, new))
        return np.repeat(np.append(at[1:], len(key)), np.diff(np.append(at, len(key))))

    other = key[1:] != key[:-1]
    end, own = ends(other), ends(other | (root[1:] != root[:-1]))
    rows = np.flatnonzero(end > own)
    total = np.cumsum((end - own)[rows])
    at = 0
    while at < len(rows):
        upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right")))
        i = rows[at:upto]
        n = (end - own)[i]
        j = np.repeat(own[i] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        i = np.repeat(i, n)
        both = size[i] + size[j]
        keep = q * np.minimum(size[i], size[j]) >= p * np.maximum(size[i], size[j])
        keep &= (p + q) * np.minimum(size[i] - pos[i], size[j] - pos[j]) >= p * both
        i, j = i[keep], j[keep]
        if sketch is not None:
            keep = (p + q) * differing(sketch, i, j) <= (q - p) * both[keep]
            i, j = i[keep], j[keep]
        i, j = cid[i], cid[j]
        if len(i):
            yield np.maximum(i, j), np.minimum(i, j)
        at = upto


def other_pairs(own: DataFrame, roots: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Pairs (a, b), a > b, of classes (cid, size, prefix, sketch) with different roots (of node, if it has one but itself), all that are
    similar among them."""
    from pyspark.sql import Window as W

    dealt = own.select("cid", "size", F.posexplode("prefix").alias("pos", "key")).select("key", "cid", F.shiftleft("size", 32).bitwiseOR(F.col("pos").cast("long")).alias("at"))
    met = C.staged(dealt.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("key"))).where("n > 1").drop("n"), "met")  # most shingles are one set's only
    told = own.select("cid", "sketch").join(roots, F.col("cid") == F.col("node"), "left").select("cid", "sketch", F.coalesce("root", "cid").alias("root"))
    rows = met.join(told, "cid").select("key", "root", "cid", "at", "sketch").repartition("key").sortWithinPartitions("key", "root")

    def run(batches):
        import pyarrow as pa

        def out(key, root, cid, at, sketch):
            for a, b in group_pairs(key, root, cid, at >> 32, at & 0xFFFFFFFF, sketch, similarity):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        held, n = [], 0
        for batch in batches:
            held.append([*(batch.column(k).to_numpy() for k in range(4)), _padded(batch.column(4))])
            n += batch.num_rows
            if n >= MET:
                rows = [np.concatenate(x) for x in zip(*held, strict=True)]
                k = rows[0]
                cut = int(np.flatnonzero(k != k[-1])[-1]) + 1 if k[0] != k[-1] else 0
                if cut:
                    yield from out(*(x[:cut] for x in rows))
                held, n = [[x[cut:] for x in rows]], n - cut
        if n:
            yield from out(*(np.concatenate(x) for x in zip(*held, strict=True)))

    pairs = C.staged(rows.mapInArrow(run, "a long, b long").distinct(), "other-pairs")
    C.drop_stage(met)
    return pairs


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, words: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """Those pairs (a, b) of classes (cid, d0, d1, and the hash t of a text) whose sets of shingles are similar, staged."""
    pairs = C.staged(pairs, "to-verify")
    uses = pairs.select(F.col("b").alias("cid"), F.lit(1).alias("n")).unionAll(pairs.select(F.col("a").alias("cid"), F.lit(0).alias("n"))).groupBy("cid").agg(F.sum("n").alias("n"))
    wanted = C.staged(classes.select("cid", "d0", "d1", "t").join(uses, "cid"), "wanted")
    lent = F.broadcast if wanted.count() <= FEW else lambda x: x
    texts = docs.select("text", F.xxhash64("text").alias("t")).join(lent(wanted.select("t")), "t", "left_semi")  # one text of each class, and its copies
    sets = shingle_sets(texts, words).join(lent(wanted.drop("t")), ["d0", "d1"]).groupBy("cid").agg(F.first("n").alias("n"), F.first("shingles").alias("shingles"))
    sets = C.staged(sets, "sets")
    C.drop_stage(wanted)
    p, q = ratio(similarity)
    both = C.joined(pairs, sets.select(F.col("cid").alias("b"), F.col("shingles").alias("y"), "n"), "b", "n")
    both = both.join(sets.select(F.col("cid").alias("a"), F.col("shingles").alias("x")), "a")
    shared = F.size(F.array_intersect("x", "y"))
    out = C.staged(both.where(shared * (p + q) >= (F.size("x") + F.size("y")) * p).select("a", "b"), "links")
    C.drop_stage(sets)
    C.drop_stage(pairs)
    return out


def jaccard_links(docs: DataFrame, classes: DataFrame, words: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """Links (a, b), a > b, between classes (cid, d0, d1, t, the words of a long fingerprint) of docs whose sets of shingles have this Jaccard
    similarity or more: only such, and enough to connect all that are.

    The first links are told by fingerprints and verified. The rest is found for certain: similar sets share a shingle of their prefixes,
    so classes meet under each shingle of theirs, and pairs that the first links do not connect are compared, by sizes, by the places of
    the shingle, by sketches (none of which discards a similar pair), and at last by all their shingles."""
    own = prefixes(docs, frequent_shingles(docs, classes.count(), words), words, similarity)
    own = C.staged(own.join(classes.select("cid", "d0", "d1"), ["d0", "d1"]).drop("d0", "d1"), "prefixes")
    first = verified(similar_links(classes, similarity), docs, classes, words, similarity)
    rest = verified(other_pairs(own, components(first), similarity), docs, classes, words, similarity)
    C.drop_stage(own)
    return first.unionAll(rest)


def similar(docs: DataFrame, words: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id and component_id (the smallest doc_id reachable) of texts whose sets of shingles have this Jaccard similarity or more, all of
    them: see jaccard_links. Texts with equal sets are of one class; wordless texts are one class."""
    rows = C.staged(long_fingerprints(docs, words), "long-fps")
    classes = rows.groupBy("d0", "d1").agg(F.min(F.struct(*_words())).alias("fp"), F.min("t").alias("t"), F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
    classes = C.staged(classes.select(F.monotonically_increasing_id().alias("cid"), "d0", "d1", "t", "fp.*", "first", "n"), "classes")
    roots = components(jaccard_links(docs, classes, words, similarity))
    named = classes.join(roots.withColumnRenamed("node", "cid"), "cid", "left").select("cid", "d0", "d1", "first", "n", F.coalesce("root", "cid").alias("root"))
    linked = named.where(F.col("root") != F.col("cid")).select("root").distinct()
    best = named.join(linked, "root", "left_semi").groupBy("root").agg(F.min("first").alias("component"))
    own = F.struct("d0", "d1").alias("own")
    table = C.staged(named.join(best, "root", "left").select(own, "n", F.coalesce("component", "first").alias("component_id")), "components")
    C.drop_stage(classes)
    return C.joined(rows.select("doc_id", own), table, "own", "n").select("doc_id", "component_id")


def one_of_each(docs: DataFrame, words: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one document of each group of similar ones, the one with the smallest doc_id. Rows of one doc_id are one document, of which the row
    with the smallest hash stays; rows without a doc_id stay, as nothing tells them apart."""
    kept = similar(docs, words, similarity).where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi")
    told = [F.col(f"`{f.name}`") for f in docs.schema if f.dataType.typeName() not in ("map", "variant")]
    one = named.groupBy(F.col("doc_id").alias("_id")).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.xxhash64(*told)).alias("_row"))
    return one.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns]).unionByName(docs.where("doc_id is null"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(C.documents(spark, sf_dir))


QUERIES = {"op2_simhash_near_duplicates": op2_near_duplicates}
SQL: dict[str, str] = {}
