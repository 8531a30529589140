"""The corpus operators against plain counterparts, at sizes and on inputs where shortcuts would show."""

import itertools
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaymaster.llm import language, leaks


# ------------------------------------------------------------------------------------------------------------- language

def all_cuts(s, index, prob, unknown):
    """The sum over all ways to cut s, by trying each set of cuts."""
    total = 0
    for n in range(len(s)):
        for cuts in itertools.combinations(range(1, len(s)), n):
            p = 1
            for a, b in itertools.pairwise([0, *cuts, len(s)]):
                p = p * (prob[index[s[a:b]]] if s[a:b] in index else prob[unknown] if b == a + 1 else 0)
            total = total + p
    return total


def test_sums_against_all_segmentations():
    rnd = random.Random(7)
    for _ in range(30):
        pieces = sorted({"".join(rnd.choice("ab▁") for _ in range(rnd.randint(1, 4))) for _ in range(12)})
        index = {p: i for i, p in enumerate(pieces)}
        prob = np.random.default_rng(rnd.randrange(1000)).random((len(pieces) + 1, 2)) + 1e-3
        words = ["".join(rnd.choice("abc") for _ in range(rnd.randint(1, 7))) for _ in range(5)]
        lattice = language.Lattice(words, index)
        want = np.array([all_cuts("▁" + w, index, prob, len(pieces)) for w in words])
        assert np.allclose(lattice.forward(prob)[lattice.end], want)
        logs = np.log(prob)
        assert np.allclose([np.exp(language.sums_in_logs(w, index, logs)[0]) for w in words], want)
        n = np.random.default_rng(1).random((len(words), 2))
        total = np.zeros_like(prob)
        for w, c in zip(words, n, strict=True):
            language.expected_in_logs(w, index, logs, c, total)
        assert np.allclose(lattice.expected(prob, n), total)


def test_long_words_are_summed_whole():
    pieces = ["a", "aa", "b", "▁a"]
    prob = np.array([[0.2, 0.1], [0.1, 0.3], [0.3, 0.2], [0.3, 0.2], [0.1, 0.1]]) * language.SCALE
    s = language.Scorer(pieces, prob)
    word = "ab" * 4000
    logs, n = s.score([word, word[:8], "aab"])
    assert n.tolist() == [1, 1, 1] and np.isfinite(logs).all() and (logs[0] < 100 * logs[1]).all()
    one = language.Scorer(pieces, prob).score([word[:40], word[:42]])[0]
    assert np.allclose(one[1] - one[0], np.log(prob[0] * prob[2] / language.SCALE**2))  # a and b have one way each


def test_samples_of_any_size():
    for n in (1, 1500, 10**6, 2 * 10**9, 10**12, 10**15):
        drawn = n * (language.share_of(n) + 1) / 2**63
        assert abs(drawn - min(n, language.FIT_DOCS)) < 1


def test_words_are_letters_with_their_marks(spark):
    assert language.words_of("²½Ⅷ _ 12 ٣") == [] and language.words_of("हिन्दी İx a1b é") == ["हिन्दी", "i̇x", "a", "b", "é"]
    texts = ["²", "½ Ⅷ", "٣ 12", "हिन्दी", "́", "ª"]
    rows = [(i, t, None) for i, t in enumerate(texts)] + [(100 + i, "der und die das" if i % 2 else "the and of to", "de" if i % 2 else "en") for i in range(40)]
    got = {r.doc_id: r.lang_pred for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert [got[i] == "und" for i in range(6)] == [True, True, True, False, True, False]


def test_prediction_against_plain_sums(spark):
    rnd = random.Random(3)
    texts = [(" ".join(rnd.choice(["der", "und", "keit", "wasser", "the", "water", "ing", "of"]) for _ in range(rnd.randint(1, 12))), rnd.choice(["de", "en"])) for _ in range(120)]
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    langs = {"de": 1, "en": 1}
    counts = language.word_counts(df, langs, 10**9)
    want = Counter((w, lang) for i, (t, lang) in enumerate(texts) if zlib.crc32(str(i).encode()) % 3 != 1 for w in t.split())
    assert {(r.word, x): n for r in counts.collect() for x, n in zip(langs, r.n, strict=True) if n} == want
    pieces = language.vocabulary()
    prob = language.fit(counts, pieces, 2, 2)
    index = {p: i for i, p in enumerate(pieces)}
    plain = language.first_guess(pieces, 2)
    words = sorted({w for w, _ in want})
    for _ in range(2):
        plain = language.improved(language.expected_pieces(words, np.array([[want[w, x] for x in langs] for w in words], float), index, plain), pieces)
    assert np.allclose(prob, plain)
    got = {r.doc_id: r.lang_pred for r in language.predict(df, list(langs), pieces, prob).collect()}
    for i, (t, _) in enumerate(texts):
        logs = sum(np.log(all_cuts("▁" + w, index, prob, len(pieces))) - (len(w) + 1) * np.log(language.SCALE) for w in t.split())
        assert got[i] == list(langs)[int(np.argmax(logs))]


# ---------------------------------------------------------------------------------------------------------------- pages

def test_pages_of_any_depth_and_span():
    from quaymaster.llm import pages

    cases = {
        "<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>": "a  b\n   c\nd  e",
        "<table><tr><td>a<td rowspan=2>b<td>c<tr><td>d<td>e</table>": "a  b  c\nd     e",
        "<table><tr><td rowspan=0>x<td>1<tr><td>2<tr><td>3<tbody><tr><td>n</table>": "x  1\n   2\n   3\nn",
        "<table><tr><td colspan=2>wide one<td>z<tr><td>1<td>2<td>3</table>": "wide one  z\n1  2      3",
        "<div style='visibility:hidden'>no<p style='visibility:visible'>yes</p>no</div>end": "yes\n\nend",
        "<table><tr style='visibility:collapse'><td>no<tr><td>yes</table>": "yes", "<style>.s{display:block}</style><p hidden>no<p hidden class=s>yes": "yes",
        "<tr>x<table><tr><td>y</table>": "x\n\ny", "<select><option>a<select>b": "a b", "<ul><li style='visibility:hidden'>no<li>yes</ul>": "* yes",
    }
    for html, want in cases.items():
        assert pages.text_of(html)[1] == want, html
    deep = pages.text_of("<table><tr><td>a<td>" * 400 + "in")[1]
    assert deep == "a  " * 400 + "in"


@pytest.mark.parametrize("page", [
    "<div>" * 200_000 + "deep", "<p><button>" + "<div>" * 100_000 + "deep", "<b>" * 50_000 + "</i>" * 50_000 + "deep", "<div><table><tr><td>" + "<b>" * 50_000 + "</div>" * 50_000 + "deep",
    "<table><tr><td>" * 3000 + "deep", "<select>" * 50_000 + "<p>deep", "<table><tr>" + "<td colspan=1000 rowspan=9>x" * 4000 + "<tr>" + "<td colspan=999>y" * 4000 + "</table>deep", "<table><tr><td>" + " " * 200_000 + "deep",
    "<style>" + "".join(f".c{i}{{color:red}}" for i in range(10_000)) + "</style>" + "<p class=c1>x" * 10_000 + "<p>deep",
], ids=range(9))
def test_pages_take_time_in_proportion(page):
    from quaymaster.llm import pages

    began = time.process_time()
    assert "deep" in pages.text_of(page)[1]
    assert time.process_time() - began < 8


# ---------------------------------------------------------------------------------------------------------------- leaks

def test_tiles_are_those_of_all_pairs():
    from test_corpus import slow_tiles

    rnd = random.Random(18)
    for n in range(300):
        words = rnd.choice([1, 2, 4])
        item = [rnd.randrange(words) for _ in range(rnd.randint(1, 30))]
        doc = [rnd.randrange(-1, words) for _ in range(rnd.randint(1, 40))]
        got = leaks.tiles(np.array(doc), np.array(item), 3)
        assert [tuple(map(int, x)) for x in got] == slow_tiles(doc, item, 3), (doc, item)


def test_hits_against_tiles_of_the_whole_text():
    rnd = random.Random(19)
    words = [f"w{i}" for i in range(12)]
    items = [" ".join(rnd.choice(words) for _ in range(rnd.randint(3, 40))) for _ in range(12)]
    index = leaks.Index(list(enumerate(items)))
    met = 0
    for _ in range(120):
        parts = rnd.choice(items).split()
        cut = rnd.randrange(1, len(parts))
        doc = " ".join([*parts[cut:], *(rnd.choice([*words, "x"]) for _ in range(rnd.randint(0, 30))), *parts[:cut]])
        want = []
        ids = np.array([index.vocabulary.get(w, -1) for w in doc.split()])
        for item_id, own in index.items:
            got = leaks.tiles(ids, own)
            if (covered := sum(x[2] for x in got)) >= 0.5 * len(own):
                want.append((item_id, len(own), covered, len(got), max(x[2] for x in got)))
        assert sorted(index.hits(doc)) == sorted(want)
        met += len(want)
    assert met > 50


def test_repeated_words_take_time_in_proportion():
    began = time.process_time()
    index = leaks.Index([(1, "spam " * 1000), (2, "spam " * 500 + "eggs " * 500), (3, " ".join(["a b"] * 700))])
    got = {r[0]: r for r in index.hits("spam " * 20_000)}
    assert got[1][2] == 1000 and got[2][2] == 500 and 3 not in got
    assert {r[0]: r[2] for r in index.hits("a b " * 5000 + "eggs " * 300)} == {3: 1400}
    assert time.process_time() - began < 3


def test_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(leaks, "blocks", lambda b, f=leaks.blocks: f(b, 8))
    bench = spark.createDataFrame([(i, " ".join(f"q{i}w{k}" for k in range(7))) for i in range(5)], "item_id long, text string")
    docs = spark.createDataFrame([(i, " ".join(f"q{i}w{k}" for k in range(7)) + " more") for i in range(7)], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in leaks.leaked(docs, bench).collect()) == [(i, i) for i in range(5)]
    assert sorted(r.doc_id for r in leaks.without_leaks(docs, bench).collect()) == [5, 6]


# -------------------------------------------------------------------------------------------------------------- simhash

def test_profiles_tell_their_block_and_nothing_else(spark):
    from quaymaster.llm import simhash

    assert len(set(simhash.pivots().tolist())) == 72
    rnd = random.Random(4)
    base = [rnd.getrandbits(64) for _ in range(6)]
    rows = [(i, b, x) for i, f in enumerate(base) for b in range(8) for x in range(256)]
    fps = [f & ~(255 << 8 * b) & (1 << 64) - 1 | x << 8 * b for f, (_, b, x) in ((base[r[0]], r) for r in rows)]
    df = spark.createDataFrame([(*r, simhash._signed(f)) for r, f in zip(rows, fps, strict=True)], "base int, block int, x int, fp long")
    told = {}
    for r in df.select("*", *[p.alias(f"p{k}") for k, p in enumerate(simhash.profiles(F.col("fp")))]).collect():
        for k in range(8):
            byte = r.fp >> 8 * k & 255
            assert told.setdefault((k, byte), r[f"p{k}"]) == r[f"p{k}"]  # the profile depends on the block alone
    assert len(set(told.items())) == len({(k, v) for (k, _), v in told.items()})  # and tells it


def test_links_of_all_pairs_in_reach(spark):
    from quaymaster.llm import simhash

    rnd, fps = random.Random(5), set()
    for _ in range(300):
        x = rnd.getrandbits(64)
        a, b = rnd.sample(range(64), 2)
        fps |= {x, x ^ 1 << a ^ 1 << b, x ^ rnd.choice([1 << a, 7 << 20, 1 << 63 | 1 | 2])}
    df = spark.createDataFrame([(simhash._signed(x),) for x in sorted(fps)], "fp long")
    got = {r.node: r.root for r in simhash.components(simhash.links(df)).collect()}
    near = Counter()
    fps = sorted(fps)
    parent = {x: x for x in fps}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(fps):
        for y in fps[:i]:
            if (x ^ y).bit_count() <= 2:
                near[(x ^ y).bit_count()] += 1
                parent[top(x)] = top(y)
    assert near[1] > 50 and near[2] > 250
    root = lambda x: got.get(simhash._signed(x), simhash._signed(x))
    assert all((root(x) == root(y)) == (top(x) == top(y)) for x in fps for y in fps)


def test_hot_keys_join_like_others(spark):
    from quaymaster.llm import common as C

    rows = spark.createDataFrame([(0 if i % 2 else i, i) for i in range(4000)], "k long, x long")
    table = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("y", -F.col("k"))
    got = C.joined(rows, table, "k", "n")
    assert sorted(tuple(r) for r in got.select("k", "x", "y").collect()) == sorted((k, i, -k) for k, i in ((0 if i % 2 else i, i) for i in range(4000)))
    assert C.joined(rows.limit(0), table.limit(0), "k", "n").count() == 0


# ------------------------------------------------------------------------------------------------------ packing, sharding

def test_islands_do_better_than_best_fit(spark):
    from quaymaster.llm import packing

    rnd, supply = random.Random(1), Counter()
    for _ in range(60):  # triples that fill a sequence exactly
        a, b = rnd.randint(260, 380), rnd.randint(260, 380)
        supply.update((a, b, 1000 - a - b))
    first = packing.best_fit({}, dict(supply), sorted(supply, reverse=True), 1000)
    best = packing.plan(spark, dict(supply), 1000, islands=3, epochs=2, generations=40)
    assert 60 <= sum(best.values()) < sum(first.values())
    held = Counter()
    for p, n in best.items():
        held.update({x: m * n for x, m in p})
        assert packing.used(p) <= 1000
    assert held == supply


def test_packing_is_near_the_least_by_all_ways(spark):
    from quaymaster.llm import packing

    def least(sizes, room):  # by trying all partitions into bins
        best = len(sizes)

        def go(k, bins):
            nonlocal best
            if len(bins) >= best:
                return
            if k == len(sizes):
                best = len(bins)
                return
            for i in range(len(bins)):
                if bins[i] + sizes[k] <= room and bins[i] not in bins[:i]:
                    bins[i] += sizes[k]
                    go(k + 1, bins)
                    bins[i] -= sizes[k]
            go(k + 1, [*bins, sizes[k]])

        go(0, [])
        return best

    rnd, off = random.Random(2), 0
    for _ in range(40):
        sizes = sorted((rnd.randint(15, 60) for _ in range(10)), reverse=True)
        supply = dict(Counter(sizes))
        want = least(sizes, 100)
        got = min(sum(c.values()) for c in packing.evolve(supply, 100, [packing.best_fit({}, supply, sorted(supply, reverse=True), 100)], 30, 6, 1))
        assert want <= got <= want + 1
        off += got - want
    assert off <= 1


def test_equal_rows_in_masses_are_ranked_apart(spark):
    from quaymaster.llm import common as C, sharding

    df = C.staged(spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same").alias("text"), F.monotonically_increasing_id().alias("_tie")), "t")
    got = C.ranked(df, ["text"], ["doc_id", "_tie"], 16)
    assert sorted(r["rank"] for r in got.collect()) == list(range(3000))
    deal = df.groupBy(F.pmod(F.xxhash64("doc_id", "_tie"), F.lit(16))).count().collect()
    assert len(deal) == 16 and max(r["count"] for r in deal) < 400
    docs = df.select("doc_id", "text").unionByName(spark.createDataFrame([(i, f"text {i}") for i in range(500)] + [(5, None), (6, "")], "doc_id long, text string"))
    out = sharding.sharded(docs).collect()
    assert len(out) == 3502 and len({r.shard for r in out if r.size == 5}) == 1
    for k in range(8):
        assert sorted(r.slot for r in out if r.shard == k) == list(range(sum(r.shard == k for r in out)))


def test_differencing_against_all_partitions():
    from quaymaster.llm import sharding

    rnd = random.Random(3)
    off = 0
    for _ in range(40):
        sizes = [rnd.randint(1, 40) for _ in range(8)]
        at = sharding.differencing([(x, 0) for x in sizes])
        total = [0, 0]
        for x, a in zip(sizes, at, strict=True):
            total[a[0]] += x
        best = min(abs(2 * sum(x for k, x in enumerate(sizes) if m >> k & 1) - sum(sizes)) for m in range(256))
        # plain differencing of two-way partitions: the largest two are replaced by their difference
        own = sorted(sizes)
        while len(own) > 1:
            a, b = own.pop(), own.pop()
            own = sorted([*own, a - b])
        assert abs(total[0] - total[1]) == own[0] >= best
        off += own[0] - best
    assert off < 40 * 4


# -------------------------------------------------------------------------------------------------------------- privacy

def valid_iban(s):
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def test_names_have_two_parts(spark):
    from quaymaster.llm import privacy

    old = ["Mr John Smith", "Mr Peter Smith", "Mr Smith", "Mrs Anna Smith", "Mr John Miller", "Dr Anna Maria Smith", "Mr J. R. Smith", "Mr. J. R. Smith", "Mr SMITH", "Mr JOHN SMITH", "Herr Ötzi Jäger", "Mr O'Neil"]
    df = spark.createDataFrame(list(enumerate(old)), "doc_id long, text string")
    got = [r.text for r in privacy.pseudonymised(df, "k").orderBy("doc_id").collect()]
    tail = [x.split()[-1] for x in got]
    assert tail[0] == tail[1] == tail[2] == tail[3] == tail[5] == tail[6] == tail[7] != tail[4]
    assert len(set(got)) == len(got) and got[0].split()[1] == got[4].split()[1] != got[1].split()[1]
    assert got[9].split()[1:] == [got[0].split()[1].upper(), tail[0].upper()] and got[6].removeprefix("Mr") == got[7].removeprefix("Mr.")
    assert re.fullmatch(r"Mr [A-Z]\. [A-Z]\. \w+", got[6]) and all(not set(a.split()[1:]) & set(b.split()[1:]) for a, b in zip(got, old, strict=True))


def test_many_names_stay_distinct(spark):
    from quaymaster.llm import privacy

    syl = ["ka", "lo", "mi", "ne", "ru", "sa", "to", "vi", "ze", "bo", "da", "fu"]
    names = ["".join(x).capitalize() for x in itertools.product(syl, repeat=3)]
    rnd = random.Random(1)
    old = sorted({f"{rnd.choice(['Mr', 'Mrs', 'Dr'])} {rnd.choice(names)} {rnd.choice(names)}" for _ in range(6000)})
    df = spark.createDataFrame(list(enumerate(old)), "doc_id long, text string")
    got = [r.text for r in privacy.pseudonymised(df, "k").orderBy("doc_id").collect()]
    assert len(set(got)) == len(old)
    family, first = {}, {}
    for a, b in zip(old, got, strict=True):  # each part is replaced one to one
        (t, f, n), (t2, f2, n2) = a.split(), b.split()
        assert t == t2 and family.setdefault(n, n2) == n2 and first.setdefault((t, f), f2) == f2
    assert len(set(family.values())) == len(family) and len({(k[0], v) for k, v in first.items()}) == len(first)


def test_ibans_stay_valid(spark):
    from quaymaster.llm import privacy

    old = ["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "FR1420041010050500013M02606", "GB00WEST12345698765432"]
    df = spark.createDataFrame(list(enumerate(old)), "doc_id long, text string")
    got = [r.text for r in privacy.pseudonymised(df, "k").orderBy("doc_id").collect()]
    for a, b in zip(old, got, strict=True):
        assert a != b and a[:2] == b[:2] and [c == " " for c in a] == [c == " " for c in b]
        assert valid_iban(b.replace(" ", "")) == valid_iban(a.replace(" ", ""))


def test_names_without_case(spark):
    from quaymaster.llm import privacy

    old = ["السيد محمد", "גברת כהן", "श्री मोहन", "王小明先生", "田中さん", "김철수 씨", "见面 王小明先生, 你好"]
    df = spark.createDataFrame(list(enumerate(old)), "doc_id long, text string")
    got = [r.text for r in privacy.pseudonymised(df, "k").orderBy("doc_id").collect()]
    assert all(a != b and len(a) == len(b) for a, b in zip(old, got, strict=True))
    assert got[0].startswith("السيد ") and got[3].endswith("先生") and got[4].endswith("さん") and got[5].endswith(" 씨") and got[6] == f"见面 {got[3]}, 你好"


def test_keys_come_from_the_caller_the_session_or_chance(spark):
    from quaymaster.llm import privacy

    df = spark.createDataFrame([(1, "me@mail.example.com")], "doc_id long, text string")
    one = lambda *a: privacy.pseudonymised(df, *a).first().text
    drawn = one()
    assert drawn == one() != one("k") and len(privacy.surrogate_key(spark)) == 64
    spark.conf.set("spark.quaymaster.surrogateKey", "k")
    try:
        assert one() == one("k")
    finally:
        spark.conf.unset("spark.quaymaster.surrogateKey")


def test_replacement_against_a_plain_one(spark):
    """What is replaced, by a plain scan of the whole text; what stands around it stays."""
    import regex

    from quaymaster.llm import privacy

    rnd = random.Random(6)
    bits = ["me@mail.example.com", "Mr John Smith", "call +33 6 12 34 56 78", "10.2.3.4", "4111 1111 1111 1111", "123-45-6789", "password: hunter22x", "plain words", "in 2020", "and", "a@b", "É. Dupont", "\n", "«", "DE89370400440532013000"]
    texts = [" | ".join(rnd.choice(bits) for _ in range(rnd.randint(0, 12))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in privacy.pseudonymised(df, "k").collect()}
    pattern = regex.compile(privacy.PATTERN.replace(r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}", r"\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}"))
    new = {}
    for i, t in enumerate(texts):
        assert got[i].n_entities == len(pattern.findall(t))
        for a, b in zip(t.split(" | "), got[i].text.split(" | "), strict=True):
            if m := pattern.search(a):
                head, tail = a[: m.start()], a[m.end() :]
                assert b.startswith(head) and b.endswith(tail)
                own = b[len(head) : len(b) - len(tail)]
                assert new.setdefault(m[0], own) == own != m[0]
            else:
                assert a == b
    assert len(set(new.values())) == len(new) == 8


def test_numbers_that_are_none(spark):
    from quaymaster.llm import privacy

    old = ["order 9807915762804490 of 2020", "9807 9157 6280 4490", "+1 (843) 555-7672 170.106.47.218", "+33 6 12 34 56 78 10.2.3.4", "+1 843 555 7672 17 apples"]
    df = spark.createDataFrame(list(enumerate(old)), "doc_id long, text string")
    got = [(r.text, r.n_entities, r.kinds) for r in privacy.pseudonymised(df, "k").orderBy("doc_id").collect()]
    assert got[0] == (old[0], 0, "") and got[1] == (old[1], 0, "")
    assert [x[1:] for x in got[2:]] == [(2, "ip,phone"), (2, "ip,phone"), (1, "phone")] and got[4][0].endswith(" 17 apples")
    assert all(re.fullmatch(r"\+\d+ .* \d+\.\d+\.\d+\.\d+", x[0]) for x in got[2:4])


# ------------------------------------------------------------------------------------------------------------- clashes

def test_quality_keeps_columns_of_any_name(spark):
    from quaymaster.llm import quality

    good = "\n".join(" ".join(f"word{i}n{k}" for k in range(20)) + "." for i in range(4))
    df = spark.createDataFrame([(1, good + "\nHome | About | Contact | Help")], "doc_id long, text string").select("*", *[F.lit("own").alias(c) for c in ("_q", "kept", "n_words", "cleaned", "_row", "a.b")])
    r = quality.clean(df)
    assert r.columns == df.columns and tuple(r.first()) == (1, good, *["own"] * 6)
    assert quality.judged(df.drop("a.b")).first().kept is True


def test_one_row_of_each_document(spark):
    from quaymaster.llm import simhash

    rows = [(1, "some words of a text", "b"), (1, "some words of a text", "a"), (1, "other words than those", "c"), (2, "quite another thing it is", "d"), (None, "some words of a text", "e"), (None, None, "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, `x.y` string").withColumn("m", F.create_map(F.lit(1), F.lit(2)))
    first = None
    for k in range(3):
        got = simhash.one_of_each(df.repartition(k + 1))
        assert got.columns == df.columns
        own = sorted((str(r.doc_id), str(r.text), r["x.y"]) for r in got.collect())
        assert first in (None, own)
        first = own
    assert len(first) == 4


def test_token_files_want_whole_numbers(spark):
    from quaymaster.llm import common as C, huffman

    with pytest.raises(TypeError):
        huffman.write(spark.createDataFrame([("a", "b")], "doc_id string, text string"), C.new_path(spark, "t"))


# ------------------------------------------------------------------------------------------------------------- licences

def expression(wording):
    """The template as a regular expression over words with a space before each."""
    out = []
    for t in re.findall(r"\[\[|\]\]|\(\(|\)\)|/|\{\d+\}|[^\s\[\]{}()/]+", wording):
        out.append({"[[": "(?:", "]]": ")?", "((": "(?:", "))": ")", "/": "|", "$": "$"}.get(t) or (rf"(?: \S+){{0,{t[1:-1]}}}" if t[0] == "{" else f" (?:{t})(?= |$)" if "|" in t else f" {re.escape(t)}(?= |$)"))
    return re.compile("".join(out))


def drawn(wording, rnd):
    """Words that the template accepts."""
    out, todo = [], re.findall(r"\[\[|\]\]|\(\(|\)\)|/|\{\d+\}|[^\s\[\]{}()/]+", wording)
    keep, skip = [True], 0
    fork = []
    for t in todo:
        if t == "[[":
            keep.append(keep[-1] and rnd.random() < 0.5)
        elif t == "]]":
            keep.pop()
        elif t == "((":
            fork.append(rnd.random() < 0.5)
            keep.append(keep[-1] and fork[-1])
        elif t == "/":
            keep[-1] = keep[-2] and not fork[-1]
        elif t == "))":
            keep.pop()
            fork.pop()
        elif keep[-1] and t != "$":
            out += [f"name{k}" for k in range(rnd.randint(0, int(t[1:-1])))] if t[0] == "{" else [rnd.choice(t.split("|"))]
    return out


def test_templates_against_regular_expressions():
    from quaymaster.llm import licenses

    rnd = random.Random(13)
    hits = misses = 0
    for label, wording in licenses.TEMPLATES:
        one, automaton = expression(wording), licenses.Automaton(wording)
        for k in range(24):
            words = drawn(wording, rnd)
            if k >= 4:  # a word lost, changed, added, doubled or two changed over
                at = rnd.randrange(len(words))
                words = [words[:at] + words[at + 1 :], [*words[:at], "other", *words[at + 1 :]], [*words[:at], "not", *words[at:]], [*words[: at + 1], *words[at:]], [*words[:at], *words[at : at + 2][::-1], *words[at + 2 :]]][k % 5]
            text = " ".join([*(["some", "text"] if k % 2 else []), *words, *(["and", "more"] if k % 3 == 0 and "$" not in wording else [])])
            want = bool(one.search(" " + text))
            got = label in licenses.scan(text, [(label, automaton)])[5].split(",") if label not in licenses.PHRASES.values() else licenses.scan(text, [(label, automaton)])[6] == 1.0
            assert got == want, (label, text)
            assert want or k >= 4
            hits, misses = hits + want, misses + (not want)
    assert hits > 150 and misses > 400


def test_one_wording_for_another():
    from quaymaster.llm import licenses

    a = licenses.Automaton("this|that work is ((free/without any cost [[at all]])) for {1} use")
    ok = lambda s: licenses.scan(s, [("x", a)])[5] == "x"
    assert all(map(ok, ("This work is free for use", "that work is without any cost for home use", "x that work is without any cost at all for use y")))
    assert not any(map(ok, ("a work is free for use", "this work is free at all for use", "this work is for use", "this work is without any for use", "this work is free without any cost for use")))


def test_similar_texts(spark):
    from quaymaster.llm import simhash

    assert len(set(simhash.block_profiles().tolist())) == 256 and simhash.farthest(1.0) == 0 and 38 < simhash.farthest() < 50
    rnd = random.Random(8)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "ru", "sa") for b in ("to", "vi", "ze", "bo", "da", "fu")]
    text = lambda n: [rnd.choice(words) for _ in range(n)]
    rows, near, apart = [], [], []
    for i in range(150):
        own = text(rnd.randint(80, 300))
        copy, far = list(own), list(own)
        for _ in range(max(1, len(own) // 100)):
            copy[rnd.randrange(len(own))] = "other"
        for k in range(0, len(own), 6):  # a word in six: hardly a shingle is left
            far[k] = "changed"
        rows += [(10 * i, " ".join(own)), (10 * i + 1, " ".join(copy)), (10 * i + 2, " ".join(far)), (10 * i + 3, " ".join(own))]
    rows += [(9000, None), (9001, ""), (9002, " \n"), (None, rows[0][1]), (9003, "one two"), (9004, "one two")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in simhash.similar(df).collect()}

    def jaccard(a, b):
        a, b = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (a.split(), b.split()))
        return len(a & b) / len(a | b)

    texts = dict(rows)
    near = [i for i in range(150) if jaccard(texts[10 * i], texts[10 * i + 1]) >= 0.85]
    assert len(near) > 100 and sum(got[10 * i] == got[10 * i + 1] for i in near) >= 0.9 * len(near)
    assert all(got[10 * i + 3] == got[10 * i] for i in range(150)) and sum(got[10 * i + 2] == 10 * i + 2 for i in range(150)) == 150
    assert all(got[d] in (10 * (d // 10), d) for d in got if d is not None and d < 9000)
    assert got[9000] == got[9001] == got[9002] == 9000 and got[9003] == got[9004] == 9003 and got[None] == 0
    assert simhash.similar(df.limit(0)).count() == 0


def test_similar_texts_in_one_large_group(spark, monkeypatch):
    from quaymaster.llm import common as C, simhash

    monkeypatch.setattr(C, "HOT", 2000)
    rnd = random.Random(9)
    base = [rnd.choice(["ka", "lo", "mi", "ne", "ru"]) + rnd.choice(["to", "vi", "ze"]) for _ in range(400)]
    rows = []
    for i in range(600):
        own = list(base)
        for _ in range(3):
            own[rnd.randrange(400)] = f"x{rnd.randrange(9)}"
        rows.append((i, " ".join(own)))
    rows += [(1000 + i, " ".join(f"w{rnd.randrange(500)}" for _ in range(60))) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    links = simhash.similar_links(C.staged(simhash.long_fingerprints(df).select(F.col("doc_id").alias("cid"), "fp0", "fp1", "fp2", "fp3"), "c")).count()
    assert links < 128 * 700
    got = {r.doc_id: r.component_id for r in simhash.similar(df).collect()}
    assert sum(got[i] == 0 for i in range(600)) >= 590 and all(got[i] == i for i in range(1000, 1100))


def test_similar_texts_are_all_found(spark):
    """Components by brute force over the sets of shingles, most pairs close to the bound on either side; a text that many share parts of."""
    from quaymaster.llm import simhash

    rnd = random.Random(21)
    word = lambda: f"w{rnd.randrange(4000)}"
    texts, line = [], [word() for _ in range(40)]
    for i in range(220):
        own = [word() for _ in range(rnd.choice([6, 12, 30, 60, 120, 300]))]
        family = [own]
        for _ in range(rnd.randint(1, 3)):
            copy = list(rnd.choice(family))
            for _ in range(max(1, round(len(copy) * rnd.uniform(0.005, 0.03)))):
                copy[rnd.randrange(len(copy))] = word()
            family.append(copy[: rnd.randint(max(1, int(len(copy) * 0.93)), len(copy))])
        texts += [x + line if i % 4 == 0 else x for x in family]
    texts += [["a"] * k for k in (3, 4, 5, 9)] + [[], [], *[["b", "c", "d", "e", "f", "g"][:k] for k in range(1, 7)]]
    rnd.shuffle(texts)
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()} for w in texts]
    label = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both) and label[a] != label[b]:
            low, high = sorted((label[a], label[b]))
            label = [low if x == high else x for x in label]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in simhash.similar(df).collect()}
    assert [got[i] for i in range(len(texts))] == label and len(set(label)) < len(texts) - 100


def test_pairs_of_a_key():
    from quaymaster.llm import simhash

    rng = np.random.default_rng(3)
    for pairs in (7, 1 << 20):
        simhash.PAIRS, was = pairs, simhash.PAIRS
        key, root = np.sort(rng.integers(0, 9, 90)), rng.integers(0, 4, 90)
        order = np.lexsort((root, key))
        key, root, cid, size, pos = key[order], root[order], rng.permutation(90), rng.integers(8, 14, 90), rng.integers(0, 3, 90)
        got = [(x, y) for a, b in simhash.group_pairs(key, root, cid, size, pos) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
        simhash.PAIRS = was
        want = [
            (max(cid[i], cid[j]), min(cid[i], cid[j])) for i, j in itertools.combinations(range(90), 2)
            if key[i] == key[j] and root[i] != root[j] and 5 * min(size[i], size[j]) >= 4 * max(size[i], size[j]) and 9 * min(size[i] - pos[i], size[j] - pos[j]) >= 4 * (size[i] + size[j])
        ]
        assert sorted(got) == sorted(want) and len(want) > 20


def test_short_sketches_discard_no_similar_sets():
    from quaymaster.llm import simhash

    r = np.random.default_rng(3)
    sets = []
    for n in (1, 30, 64, 65, 130, 260, 500, 513, 900, 3000):
        x = r.integers(0, 1 << 63, n, dtype=np.uint64)
        sets += [np.unique(x), np.unique(np.concatenate([x[: n - n // 9], r.integers(0, 1 << 63, n // 12 + 1, dtype=np.uint64)]))]
    lists = simhash._lists([simhash.sketch_of(x) for x in sets])
    assert len(lists.flatten()) < 10 * len(sets)  # a sketch is as long as its set needs
    p, (i, j) = simhash._padded(lists), np.triu_indices(len(sets), 1)
    apart = simhash.differing(p, i, j)
    assert all(d <= len(np.setxor1d(sets[a], sets[b])) for d, a, b in zip(apart, i, j, strict=True))
