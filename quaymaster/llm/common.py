"""What the corpus operators share: staged tables, block-wise ranks, worker-side tokenisation."""

from __future__ import annotations

import gc
import itertools
import json
import os
import re
import struct

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.staging import drop as drop_stage
from ..plans.staging import new_path, staged

#: Arrow batches are cut to about so many bytes of text before Python strings are made of them.
SLICE_BYTES = 4 << 20
#: The encoder tells equal words apart slice by slice, so its slices are larger.
ENCODE_BYTES = 8 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def blocks_for(spark: SparkSession, rows: int, per_block: int) -> int:
    """How many blocks of about per_block rows, and never fewer than two for each shuffle partition."""
    return max(2 * shuffle_parts(spark), -(-rows // per_block))


def ranked(df: DataFrame, group: list[str], order: list[str], blocks: int, name: str = "rank") -> DataFrame:
    """Adds a gapless rank from 0 in each group without bringing a group together: rows are dealt to blocks by a hash of the order
    columns, ranked in (group, block), and moved up by what the group has in earlier blocks. Rows equal in all of `order` would share a
    block, so where rows may repeat in masses its last column tells them apart. df is read twice, so it must be a staged table."""
    df = df.withColumn("_block", F.pmod(F.xxhash64(*order), F.lit(blocks)).cast("int"))
    from pyspark.sql import Window as W

    counts = df.groupBy(*group, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*group).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select(*[F.col(g).alias(f"_g_{g}") for g in group], F.col("_block").alias("_g_block"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = df.withColumn("_rn", F.row_number().over(W.partitionBy(*group, "_block").orderBy(*order)) - 1)
    on = [own[g].eqNullSafe(counts[f"_g_{g}"]) for g in group] + [own["_block"] == counts["_g_block"]]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    kept = [c for c in df.columns if c != "_block"]
    return own.join(counts, cond, "left").select(*kept, (F.col("_rn") + F.col("_before")).cast("long").alias(name))


#: A key with more than one HOT-th of all rows is hot; there are fewer than HOT such keys.
HOT = 1000


def joined(rows: DataFrame, table: DataFrame, key: str, count: str) -> DataFrame:
    """rows with what `table` says of their key. table has one row for each key of rows, and in `count` how many rows have it. Hot keys,
    fewer than HOT, are broadcast; no other key has more than a HOT-th of the rows. Both are read twice and should be staged."""
    total = table.agg(F.sum(count)).first()[0] or 0
    hot = table.where(F.col(count) * HOT > F.lit(total)).drop(count)
    if hot.isEmpty():
        return rows.join(table.drop(count), key)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table.where(F.col(count) * HOT <= F.lit(total)).drop(count), key)
    return rows.join(F.broadcast(hot), key).unionByName(cold)


def slices(batch, size: int = SLICE_BYTES):
    """An Arrow batch in pieces whose buffers hold about `size` bytes."""
    n = max(1, -(-batch.nbytes // size))
    step = max(1, -(-batch.num_rows // n))
    for i in range(0, batch.num_rows, step):
        yield batch.slice(i, step)


def crc_of_text() -> Column:
    """Unsigned CRC-32 of the UTF-8 text, null as empty."""
    return F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))


# ---------------------------------------------------------------------------------------------------------------- tokens

#: Pre-tokens of word_bpe_49k.json as the file states them (fixed value).
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Texts with other characters than these, or with the opening of a special token, go to the library whole.
_ODD = re.compile("[^\\x00-\\x1b\\x20-\\u012f\\u0131-\\u0148\\u014a-\\u017e]|<\\|")
#: The pattern above, for lower-cased texts of those characters.
_LATIN_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u017e]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\\sa-z\xaa\xb5\xba\xdf-\xf6\xf8-\u017e0-9\xb2\xb3\xb9\xbc-\xbe]+").findall
#: Words in a generation of what a worker remembers.
CACHE_WORDS = 240_000

_ENCODERS: dict[str, "WordEncoder"] = {}


def told_apart(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The texts split at ASCII white space: the distinct chunks, each chunk's number in text order, and where each text's chunks begin
    (one more at the end). Splitting and telling apart happen outside Python; only distinct chunks become Python strings."""
    import pyarrow as pa
    import pyarrow.compute as pc

    lists = pc.ascii_split_whitespace(pa.array(texts, pa.string()))
    told = lists.flatten().dictionary_encode()
    return told.dictionary.to_pylist(), told.indices.to_numpy(zero_copy_only=False), lists.offsets.to_numpy() - lists.offsets[0].as_py()


class Recent(dict):
    """A dictionary of what was asked for lately: when it has `size` entries it starts anew, and entries of the last generation come
    back as they are asked for."""

    def __init__(self, size: int):
        super().__init__()
        self.size, self.old = size, {}

    def missing(self, keys: set) -> list:
        """Those keys that are in neither generation; the others are in this one from now on."""
        if len(self) > self.size:
            self.old = dict(self)
            self.clear()
        new = keys.difference(self)
        if self.old and (back := new & self.old.keys()):
            self.update((k, self.old[k]) for k in back)
            new -= back
        return list(new)


def _doubtful(text: str) -> bool:
    """Whether the text has characters whose normal form, case or white space this module does not vouch for."""
    if any(c in text for c in ("<|", "\x1c", "\x1d", "\x1e", "\x1f")):
        return True
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return bool(_ODD.search(text))
    return False


class WordEncoder:
    """Encodes texts with the tokenizers library, each distinct word once: this vocabulary's pre-tokenizer drops white space and merges
    nothing across it, so a text's ids are those of its white-space separated words in a row. Texts are split here only if their
    characters' normal form, case and white space are beyond doubt; any other text is handed to the library as it is."""

    def __init__(self, spec: str, end_id: int = 1):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(spec)
        form = json.loads(spec)
        steps = [x.get("type") for x in (form.get("normalizer") or {}).get("normalizers", [])]
        cuts = (form.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        self.plain = steps == ["NFC", "Replace", "Lowercase"] and cuts[0].get("pattern", {}).get("Regex") == WORD_PATTERN
        self.size = 1 + max(int(end_id), *form["model"]["vocab"].values(), *(x["id"] for x in form.get("added_tokens", [])))
        self.end = int(end_id).to_bytes(4, "little")
        suffix = form["model"].get("end_of_word_suffix") or ""
        self.ends = np.zeros(self.size, bool)
        self.ends[[i for p, i in form["model"]["vocab"].items() if suffix and p.endswith(suffix)]] = True
        self.words = Recent(CACHE_WORDS)

    def _ids(self, chunks: list[str]) -> list[bytes]:
        """The ids of white-space separated chunks: each is cut into words by the vocabulary's own pattern, and new words are encoded."""
        known, cut = self.words, _LATIN_WORDS
        # the commonest forms need no pattern: letters only, and letters before one mark
        parts = [(c,) if c.isalpha() else () if not c else (c[:-1], c[-1]) if c[-1] in ",.;:!?" and c[:-1].isalpha() else cut(c) for c in chunks]
        new = known.missing(set().union(*parts))
        groups = [new[i : i + 500] for i in range(0, len(new), 500)]
        for part, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join(x) for x in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            ends = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
            if len(ends) == len(part):
                raw = ids.tobytes()
                known.update(zip(part, [raw[a:b] for a, b in itertools.pairwise([0, *ends])], strict=True))
            else:  # not every word ends in a piece that marks a word's end
                known.update((w, _u4(x.ids)) for w, x in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True))
        get = known.__getitem__
        return [get(p[0]) if len(p) == 1 else b"".join(map(get, p)) for p in parts]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids and the end id, as little-endian unsigned 32-bit integers."""
        was = gc.isenabled()
        gc.disable()  # many small lists and no cycles: collections would only cost time
        try:
            return self._encode(texts)
        finally:
            if was:
                gc.enable()

    def _encode(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        plain = []
        for i, t in enumerate(texts):
            if not t:
                out[i] = self.end
            elif self.plain and not _doubtful(t):
                plain.append(i)
            else:
                out[i] = _u4(self.tokenizer.encode(t, add_special_tokens=False).ids) + self.end
        if plain:
            chunks, at, edge = told_apart([texts[i].lower() for i in plain])
            ids = self._ids(chunks)
            size = np.fromiter(map(len, ids), np.int32, len(ids)) >> 2
            first = np.cumsum(size, dtype=np.int32) - size
            table = np.frombuffer(b"".join(ids), "<u4")
            own = size[at]
            end = np.cumsum(own, dtype=np.int32)
            where = np.repeat(first[at] - (end - own), own)
            where += np.arange(len(where), dtype=np.int32)
            flat = table[where]
            edge = np.concatenate([[0], end])[edge].tolist()
            for k, i in enumerate(plain):
                out[i] = flat[edge[k] : edge[k + 1]].tobytes() + self.end
        return out  # type: ignore[return-value]


def _u4(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


_CLAIM: list = [None, None]


def claim(owner: str, clear) -> None:
    """Python workers live on from task to task; what one operator remembers there goes when another begins."""
    if _CLAIM[0] not in (None, owner):
        _CLAIM[1]()
    _CLAIM[:] = [owner, clear]


def encoder(spec: str, end_id: int) -> WordEncoder:
    """One encoder for each Python worker, kept between tasks."""
    claim("tokens", _ENCODERS.clear)
    key = f"{hash(spec)}-{end_id}"
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = WordEncoder(spec, end_id)
    return _ENCODERS[key]


def tokenizer_spec(path: str | None = None) -> str:
    """The vocabulary file's text, read on the driver and sent to the workers (a fixed file of 2 MB)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


LONG, STR, INT, DOUBLE, BIN = T.LongType(), T.StringType(), T.IntegerType(), T.DoubleType(), T.BinaryType()


def schema_of(df: DataFrame, column: str, **more: T.DataType) -> T.StructType:
    """The type of one column as df has it, and more columns."""
    return T.StructType([T.StructField(column, df.schema[column].dataType)] + [T.StructField(k, v) for k, v in more.items()])
