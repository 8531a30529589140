"""Language identification by segmentation-marginalised unigrams (operator 3).

Each language has a probability for every piece of a fixed public vocabulary. A word's probability is the sum over all ways to cut
it into pieces, found by the forward algorithm; a text's is the product over its words (pieces never cross words, so this is the sum
over all segmentations of the text). The pieces' probabilities are fitted by expectation-maximisation (forward-backward) on the word
counts of a bounded sample of labelled documents. Each round of the fit is a job over the staged word counts; the driver holds the
probabilities only.

The one bound of the fit: about FIT_DOCS documents of each language, drawn by a hash of the doc_id (documents with fewer labels are all
taken); all words of these documents count. Prediction covers every word of every whole text, however long the word.

A word is a letter and the letters and combining marks that follow it, in lower case.

Cases: null text or text without a letter (Unicode category L) is `und` with score 0, as is every text when there is no labelled document
to learn from; words over BATCH_CHARS characters take the same sums in logarithms, one word at a time; ties go to the language that sorts
first; rows alike in doc_id, lang and text are learned from once, and predicted each; null doc_ids are predicted like any other (a null
doc_id is not held out and not learned from); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
import re
from array import array
from collections import deque

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

FIT_DOCS, ROUNDS = 1_500, 4
MIN_SCORE = 0.5
#: Words up to this length are summed many at a time, in scaled numbers; longer ones in logarithms.
BATCH_CHARS = 40
#: A text's score is its posterior as if it had so many words of its average evidence, or fewer if it is shorter: with hundreds of
#: words every posterior would be 0 or 1. All words count in the average.
EVIDENCE_WORDS = 20
#: Staged word counts of the fit lie in so many parts, whose sums are added in order, so the fit does not depend on the cluster.
FIT_PARTS = 16
#: A factor for each character, so that products of probabilities stay in range.
SCALE = 64.0
#: Words, and characters of words, that a worker remembers.
CACHE, CACHE_CHARS = 400_000, 6_000_000
_ASCII_WORDS = re.compile("[a-z]+").findall
_WORDS = regex.compile(r"\p{L}[\p{L}\p{M}]*").findall


def words_of(text: str | None) -> list[str]:
    """The text's words in lower case."""
    if not text:
        return []
    text = text.lower()
    return _ASCII_WORDS(text) if text.isascii() else _WORDS(text)


def vocabulary(path: str | None = None) -> list[str]:
    """The pieces of lower-case letters, with or without the word-start mark, of a sentencepiece model."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
    return sorted(p for p in pieces if (w := p.removeprefix("▁")).isalpha() and w == w.lower() or p == "▁")


class Lattice:
    """All pieces of many words: edges from a character's place to a later one. Place 0 of each word begins before its start mark."""

    def __init__(self, words: list[str], index: dict[str, int]):
        unknown = len(index)
        longest = max(map(len, index), default=1)
        src, dst, pid, level = array("q"), array("q"), array("i"), array("i")
        base = 0
        self.base = np.zeros(len(words), np.int64)
        self.end = np.zeros(len(words), np.int64)
        get = index.get
        for k, w in enumerate(words):
            s = "▁" + w
            n = len(s)
            self.base[k] = base
            for i in range(n):
                for j in range(i + 1, min(i + longest, n) + 1):
                    p = get(s[i:j])
                    if p is None:
                        if j > i + 1:
                            continue
                        p = unknown  # any character that is no piece itself
                    src.append(base + i)
                    dst.append(base + j)
                    pid.append(p)
                    level.append(j)
            base += n + 1
            self.end[k] = base - 1
        self.size = base
        order = np.lexsort((np.array(dst), np.array(level)))
        self.src, self.dst, self.pid = (np.array(x)[order] for x in (src, dst, pid))
        lv = np.array(level)[order]
        self.levels = np.searchsorted(lv, np.arange(1, (lv[-1] if len(lv) else 0) + 2))

    def _flow(self, at: np.ndarray, into: np.ndarray, add: np.ndarray) -> None:
        if len(into):
            first = np.flatnonzero(np.diff(into, prepend=-1))
            at[into[first]] += np.add.reduceat(add, first, axis=0)

    def forward(self, prob: np.ndarray) -> np.ndarray:
        """Scaled sums over all segmentations up to each place, a column for each language."""
        at = np.zeros((self.size, prob.shape[1]))
        at[self.base] = 1
        for a, b in itertools.pairwise(self.levels):
            s = slice(a, b)
            self._flow(at, self.dst[s], at[self.src[s]] * prob[self.pid[s]])
        return at

    def expected(self, prob: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """How often each piece is expected in the words, each counted as often as counts (word, language) say."""
        fore = self.forward(prob)
        back = np.zeros_like(fore)
        back[self.end] = counts / np.maximum(fore[self.end], 1e-300)
        total = np.zeros_like(prob)
        for a, b in reversed(list(itertools.pairwise(self.levels))):
            s = slice(a, b)
            through = back[self.dst[s]] * prob[self.pid[s]]
            use = fore[self.src[s]] * through
            for k in range(prob.shape[1]):
                total[:, k] += np.bincount(self.pid[s], use[:, k], len(prob))
            np.add.at(back, self.src[s], through)
        return total


def sums_in_logs(word: str, index: dict[str, int], log_prob: np.ndarray, whole: bool = False) -> list[np.ndarray]:
    """Logarithms of the (scaled) sums over all segmentations up to each place of one word, for each language; only the last one unless
    `whole`."""
    s, longest, unknown = "▁" + word, max(map(len, index), default=1), len(index)
    at = [np.zeros(log_prob.shape[1])] if whole else deque([np.zeros(log_prob.shape[1])], maxlen=longest)
    none = np.full(log_prob.shape[1], -np.inf)
    for j in range(1, len(s) + 1):
        acc = none
        for back in range(1, min(longest, j) + 1):
            p = index.get(s[j - back : j], unknown if back == 1 else None)
            if p is not None:
                acc = np.logaddexp(acc, at[-back] + log_prob[p])
        at.append(acc)
    return at if whole else [at[-1]]


def expected_in_logs(word: str, index: dict[str, int], log_prob: np.ndarray, counts: np.ndarray, total: np.ndarray) -> None:
    """Adds to total how often each piece is expected in one word that is counted as often as `counts` says."""
    s, longest, unknown = "▁" + word, max(map(len, index), default=1), len(index)
    fore = sums_in_logs(word, index, log_prob, True)
    back = [np.full(log_prob.shape[1], -np.inf) for _ in s] + [np.zeros(log_prob.shape[1])]
    for j in range(len(s), 0, -1):
        for k in range(1, min(longest, j) + 1):
            p = index.get(s[j - k : j], unknown if k == 1 else None)
            if p is not None:
                through = back[j] + log_prob[p]
                back[j - k] = np.logaddexp(back[j - k], through)
                total[p] += counts * np.exp(np.minimum(fore[j - k] + through - fore[-1], 0))


def first_guess(pieces: list[str], langs: int) -> np.ndarray:
    length = np.array([len(p) for p in pieces] + [1])
    return np.repeat((SCALE / 1000.0) ** length[:, None] / 30.0, langs, axis=1)


def expected_pieces(words: list[str], counts: np.ndarray, index: dict[str, int], prob: np.ndarray, step: int = 8_000) -> np.ndarray:
    """How often each piece is expected in the words, counted (word, language) as counts says."""
    total = np.zeros_like(prob)
    short = [k for k, w in enumerate(words) if len(w) <= BATCH_CHARS]
    for i in range(0, len(short), step):
        part = short[i : i + step]
        total += Lattice([words[k] for k in part], index).expected(prob, counts[part])
    if len(short) < len(words):
        logs = np.log(np.maximum(prob, 1e-300))
        for k, w in enumerate(words):
            if len(w) > BATCH_CHARS:
                expected_in_logs(w, index, logs, counts[k], total)
    return total


def improved(got: np.ndarray, pieces: list[str], smooth: float = 0.05) -> np.ndarray:
    """Scaled probabilities (piece, language) from expected counts, the last row for unknown characters."""
    length = np.array([len(p) for p in pieces] + [1])
    return (got + smooth) / (got + smooth).sum(axis=0) * SCALE ** length[:, None]


def training(docs: DataFrame) -> DataFrame:
    return docs.where((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull())


def share_of(n: int, fit_docs: int = FIT_DOCS) -> int:
    """The bound under which a 63-bit hash must lie so that about fit_docs of n documents are drawn, whatever n is."""
    return min(1 << 63, fit_docs * (1 << 63) // max(n, 1)) - 1


def word_counts(docs: DataFrame, langs: dict[str, int], fit_docs: int = FIT_DOCS) -> DataFrame:
    """part, word, and a count for each of langs (language -> documents), over the sample of the training documents, staged."""
    own = training(docs.select("doc_id", "text", "lang"))
    share = F.create_map(*[x for k, n in langs.items() for x in (F.lit(k), F.lit(share_of(n, fit_docs)).cast("long"))])
    sample = own.where(F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 63) - 1)) <= share[F.col("lang")]).dropDuplicates(["doc_id", "lang", "text"])
    number = {x: k for k, x in enumerate(langs)}

    def run(batches):
        from collections import Counter

        import pyarrow as pa

        for batch in batches:
            for part in C.slices(batch):
                total = Counter()
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    k = number[lang]
                    total.update((k, w) for w in words_of(text))
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.int32()), pa.array([k[1] for k in total], pa.string()), pa.array(list(total.values()), pa.int64())], names=["lang", "word", "n"])

    per = sample.select("lang", "text").mapInArrow(run, "lang int, word string, n long")
    wide = per.groupBy("word").agg(*[F.sum(F.when(F.col("lang") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(len(langs))])
    wide = wide.withColumn("part", F.pmod(F.xxhash64("word"), F.lit(FIT_PARTS)).cast("int"))
    return C.staged(wide.repartition(FIT_PARTS, "part").sortWithinPartitions("part", "word").select("part", "word", F.array(*[f"n{k}" for k in range(len(langs))]).alias("n")), "words")


def _round(sent):
    """One part's expected pieces under the probabilities sent."""
    def run(key, table):
        import pyarrow as pa

        pieces, prob = sent.value
        words = table.column("word").to_pylist()
        order = sorted(range(len(words)), key=words.__getitem__)
        n = np.array(table.column("n").to_pylist(), float).reshape(-1, prob.shape[1])[order]
        got = expected_pieces([words[k] for k in order], n, {p: i for i, p in enumerate(pieces)}, prob)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "got": pa.array([got.tobytes()], pa.binary())})

    return run


def fit(counts: DataFrame, pieces: list[str], langs: int, rounds: int = ROUNDS) -> np.ndarray:
    """Scaled probabilities (piece, language) after some rounds of expectation-maximisation over staged word counts (part, word, n). A
    round brings one table of the size of the probabilities from each of FIT_PARTS parts to the driver."""
    prob = first_guess(pieces, langs)
    sc = counts.sparkSession.sparkContext
    dealt = counts.groupBy("part")
    for _ in range(rounds):
        sent = sc.broadcast((pieces, prob))

        got = sorted((r["part"], bytes(r["got"])) for r in dealt.applyInArrow(_round(sent), "part int, got binary").collect())
        prob = improved(sum((np.frombuffer(b).reshape(prob.shape) for _, b in got), np.zeros_like(prob)), pieces)
        sent.unpersist()
    return prob


class Scorer:
    """Log probabilities of texts in each language; a worker remembers the words it has met."""

    def __init__(self, pieces: list[str], prob: np.ndarray):
        self.index = {p: i for i, p in enumerate(pieces)}
        self.prob = prob
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.chars = 0
        self.logs = np.zeros((1 << 12, self.prob.shape[1]), np.float64)

    def learn(self, words: set[str]) -> None:
        if len(self.at) > CACHE or self.chars > CACHE_CHARS:
            self.clear()
        new = list(words.difference(self.at))
        long = [w for w in new if len(w) > BATCH_CHARS]
        new = [w for w in new if len(w) <= BATCH_CHARS] if long else new
        for k in range(0, len(new), 8_000):
            part = new[k : k + 8_000]
            lattice = Lattice(part, self.index)
            self._keep(part, np.log(np.maximum(lattice.forward(self.prob)[lattice.end], 1e-300)))
        if long:
            log_prob = np.log(np.maximum(self.prob, 1e-300))
            for w in long:
                self._keep([w], sums_in_logs(w, self.index, log_prob)[0][None, :])

    def _keep(self, part: list[str], sums: np.ndarray) -> None:
        sums -= (np.array([len(w) for w in part]) + 1)[:, None] * np.log(SCALE)
        n = len(self.at)
        while n + len(part) > len(self.logs):
            self.logs = np.concatenate([self.logs, np.zeros_like(self.logs)])
        self.logs[n : n + len(part)] = sums
        self.at.update(zip(part, range(n, n + len(part)), strict=True))
        self.chars += sum(map(len, part))

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Each text's log probability by language, and its number of words."""
        chunks, number, edge = C.told_apart([(t or "").lower() for t in texts])
        words = [(c,) if c.isalpha() else words_of(c) for c in chunks]  # words never cross white space
        self.learn(set().union(*words))
        flat = np.fromiter(map(self.at.__getitem__, itertools.chain.from_iterable(words)), np.int64)
        per = np.fromiter(map(len, words), np.int64, len(words))
        size = _sums(per[number], edge)
        out = np.empty((len(texts), self.prob.shape[1]))
        inner = np.concatenate([[0], np.cumsum(per)])
        for k in range(out.shape[1]):
            out[:, k] = _sums(_sums(self.logs[flat, k], inner)[number], edge)
        return out, size


def _sums(x: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Sums of x between neighbouring edges; 0 where there is nothing between."""
    out = np.zeros(len(edge) - 1, x.dtype)
    some = np.flatnonzero(edge[1:] > edge[:-1])
    if len(some):
        out[some] = np.add.reduceat(x, edge[:-1][some])
    return out


_SCORERS: dict[int, Scorer] = {}


def predict(docs: DataFrame, langs: list[str], pieces: list[str], prob: np.ndarray, keep: list[str] | None = None) -> DataFrame:
    """docs' columns `keep` (all by default), lang_pred and score. Score: the language's posterior, weighed as EVIDENCE_WORDS says."""
    from pyspark.sql import types as T

    keep = [c for c in (keep or docs.columns) if c not in ("lang_pred", "score")]
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField("lang_pred", C.STR), T.StructField("score", C.DOUBLE)])
    model = docs.sparkSession.sparkContext.broadcast((langs, pieces, prob))
    token = id(model)

    def run(batches):
        import pyarrow as pa

        names, own, table = model.value
        C.claim("language", _SCORERS.clear)
        if token not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[token] = Scorer(own, table)
        scorer = _SCORERS[token]
        for batch in batches:
            for part in C.slices(batch, C.ENCODE_BYTES):
                logs, n = scorer.score(part.column(len(keep)).to_pylist())
                if names:
                    mean = logs / np.maximum(n, 1)[:, None] * np.minimum(n, EVIDENCE_WORDS)[:, None]
                    post = np.exp(mean - mean.max(axis=1, keepdims=True))
                    post /= post.sum(axis=1, keepdims=True)
                    best = logs.argmax(axis=1)
                    pred = [names[b] if m else "und" for b, m in zip(best, n, strict=True)]
                    score = np.where(n > 0, post[np.arange(len(n)), best], 0.0)
                else:
                    pred, score = ["und"] * part.num_rows, np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), pa.array(pred, pa.string()), pa.array(score)], names=schema.names)

    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, schema)


def identify(docs: DataFrame, keep: list[str] | None = None, path: str | None = None, fit_docs: int = FIT_DOCS) -> DataFrame:
    """Learns from docs (doc_id, text, lang) and predicts the language of each of their texts."""
    got = training(docs.select("doc_id", "text", "lang")).groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each language
    langs = {r["lang"]: r["n"] for r in sorted(got, key=lambda r: r["lang"])}
    pieces = vocabulary(path)
    prob = np.zeros((len(pieces) + 1, 0))
    if langs:
        counts = word_counts(docs, langs, fit_docs)
        prob = fit(counts, pieces, len(langs))
        C.drop_stage(counts)
    return predict(docs, list(langs), pieces, prob, keep)


def with_language(docs: DataFrame, least: float = MIN_SCORE) -> DataFrame:
    """docs without those that have no letter or whose language is uncertain (a score under `least`)."""
    got = identify(docs.withColumn("_row", F.struct(*docs.columns)).select("doc_id", "text", "lang", "_row"), ["_row"])
    return got.where((F.col("lang_pred") != "und") & (F.col("score") >= least)).select("_row.*")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = identify(C.documents(spark, sf_dir), ["doc_id"])
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return got.select("doc_id", held.alias("held_out"), "lang_pred", "score")


QUERIES = {"op3_language_id": op3_language}
SQL: dict[str, str] = {}
