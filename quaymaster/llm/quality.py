"""Quality rules, line first (operator 7), in DataFrame functions only.

Each line with a word is tried against three rules; a line that breaks one is removed:

* punctuation: at least LONG_LINE words and no sentence mark at all, or symbols on more than a tenth of its characters, or more than
  one exclamation mark for three words;
* navigation: at least three separators of menus and tables, or a line of menu words only;
* boilerplate: one of the stock phrases of page frames.

A document is rejected if the lines removed hold more than half of its words, or if it fails the base rules (fewer than 50 words, or
more than half of the words in repeated three-word windows).

Everything is found row by row; no text is shuffled. Cases: null text is empty (no words, base rules fail); long texts cost n log n;
repeated rows alike; an empty table gives an empty result; other columns are ignored by the query and kept by `clean`, whatever their
names; in `judged` the operator's own names win.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

MIN_WORDS, MAX_REPEAT, MAX_LOST, LONG_LINE = 50, 50, 50, 8
WS = r"\x20\x09-\x0D"
SYMBOLS = "#*$%&|<>"
#: Marks that end or part sentences; separators of menus; menu words and stock phrases (fixed values).
SENTENCE = r"[.!?…:;。！？]"
SEPARATOR = r"[|»›·•]|&gt;|>>"
MENU = r"(?i)^(?:home|menu|about|about us|contact|contact us|login|log in|sign in|sign up|search|next|previous|back|top|share|print|sitemap|help|faq)(?: +(?:home|menu|about|us|contact|login|search|next|previous|back|top|share|print|sitemap|help|faq))*$"
BOILERPLATE = r"(?i)all rights reserved|cookie policy|use of cookies|accept cookies|privacy policy|terms of (?:use|service)|subscribe to our|sign up for our|newsletter|click here|read more|javascript (?:is|must be)|enable javascript|lorem ipsum|powered by|share this|follow us"


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, f"[{WS}]+"), "")


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def repeated_words(words: Column) -> Column:
    """How many words stand in a three-word window that is found at least twice."""

    def covered(windows: Column) -> Column:
        def places(s: Column) -> Column:
            same = F.transform(s, lambda x, k: F.when((x["g"] == F.get(s, k - 1)["g"]) | (x["g"] == F.get(s, k + 1)["g"]), x["i"]))
            return F.sort_array(F.array_compact(same))

        def total(p: Column) -> Column:
            gaps = F.zip_with(F.slice(p, F.lit(1), F.size(p) - 1), F.slice(p, F.lit(2), F.size(p) - 1), lambda a, b: F.least(F.lit(3), b - a))
            return F.when(F.size(p) > 0, F.aggregate(gaps, F.lit(3), lambda acc, x: acc + x)).otherwise(F.lit(0))

        ordered = F.sort_array(F.arrays_zip(windows.alias("g"), F.sequence(F.lit(1), F.size(windows)).alias("i")))
        named = ordered.cast("array<struct<g:string,i:int>>")
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(named, lambda s: let(places(s), total)))

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 3, F.lit(0)).otherwise(let(windows, covered))


def line_fails(line: Column, n_words: Column) -> Column:
    chars = F.length(line)
    punctuation = ((n_words >= LONG_LINE) & ~line.rlike(SENTENCE)) | (10 * count_of(line, f"[{SYMBOLS}]") > chars) | (3 * count_of(line, "!") > n_words)
    navigation = (count_of(line, SEPARATOR) >= 3) | F.trim(line).rlike(MENU)
    return (n_words > 0) & (punctuation | navigation | line.rlike(BOILERPLATE))


def measured(docs: DataFrame) -> DataFrame:
    """docs with `_q`: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lost (words of the lines removed) and cleaned."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def of_lines(lines: Column) -> Column:
        real = F.filter(lines, lambda x: x["n"] > 0)
        own = F.transform(real, lambda x: x["line"])
        kept = F.filter(lines, lambda x: ~x["bad"])
        return F.struct(
            (F.size(real) - F.size(F.array_distinct(own))).alias("n_dup_lines"),
            F.aggregate(F.filter(lines, lambda x: x["bad"]), F.lit(0), lambda a, x: a + x["n"]).alias("n_lost"),
            F.array_join(F.transform(kept, lambda x: x["line"]), "\n").alias("cleaned"),
        )

    lines = F.transform(F.split(text, "\n"), lambda x: let(count_of(x, f"[^{WS}]+"), lambda n: F.struct(x.alias("line"), n.alias("n"), line_fails(x, n).alias("bad"))))
    of_words = let(words_of(text), lambda w: F.struct(F.size(w).alias("n_words"), F.length(F.array_join(w, "")).alias("word_chars"), repeated_words(w).alias("n_repeat_words")))
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != "_q"], F.struct(of_words.alias("w"), let(lines, of_lines).alias("l"), count_of(text, f"[{SYMBOLS}]").alias("n_symbols")).alias("_q"))


def judged(docs: DataFrame) -> DataFrame:
    """docs with the counts, base_failed, kept and cleaned."""
    q = measured(docs)
    n = F.col("_q.w.n_words").cast("long")
    failed = (n < MIN_WORDS) | (100 * F.col("_q.w.n_repeat_words") > MAX_REPEAT * n)
    return q.select(
        *[F.col(f"`{c}`") for c in docs.columns if c not in (*NAMES, "_q")], n.alias("n_words"), F.col("_q.w.word_chars").cast("long").alias("word_chars"), F.col("_q.n_symbols").cast("long").alias("n_symbols"),
        F.col("_q.l.n_dup_lines").cast("long").alias("n_dup_lines"), F.col("_q.w.n_repeat_words").cast("long").alias("n_repeat_words"),
        failed.alias("base_failed"), (~failed & (100 * F.col("_q.l.n_lost") <= MAX_LOST * n)).alias("kept"), F.col("_q.l.cleaned").alias("cleaned"),
    )


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "cleaned")


def clean(docs: DataFrame) -> DataFrame:
    """The documents kept, with the lines that failed removed from their text."""
    aside = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))  # so that no name can clash with the operator's own
    return judged(aside).where("kept").select(*[F.col("cleaned").alias("text") if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(C.documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", *NAMES[:-1])


QUERIES = {"op7_line_quality": op7_quality}

SQL = {
    "op7_line_quality": rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d),
m AS (SELECT rid, line, len(regexp_extract_all(line, '[^{WS}]+')) AS n, length(line) AS chars,
        len(regexp_extract_all(line, '[{SYMBOLS}]')) AS symbols, len(regexp_extract_all(line, '!')) AS shouts,
        len(regexp_extract_all(line, '{SEPARATOR}')) AS separators FROM l),
f AS (SELECT *, n > 0 AND ((n >= {LONG_LINE} AND NOT regexp_matches(line, '{SENTENCE}')) OR 10 * symbols > chars OR 3 * shouts > n
        OR separators >= 3 OR regexp_matches(trim(line, ' '), '{MENU}') OR regexp_matches(line, '{BOILERPLATE}')) AS bad FROM m),
g AS (SELECT rid, sum(CASE WHEN bad THEN n ELSE 0 END) AS lost, count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) AS dup FROM f GROUP BY rid),
w0 AS (SELECT rid, list_filter(regexp_split_to_array(t, '[{WS}]+'), lambda x: x <> '') AS ws FROM d),
w AS (SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w0),
tri AS (SELECT rid, i, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o AS g FROM w WINDOW o AS (PARTITION BY rid ORDER BY i)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM tri WHERE g IS NOT NULL) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY rid),
r AS (SELECT d.rid, d.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, len(regexp_extract_all(t, '[{SYMBOLS}]')) AS n_symbols,
        dup, coalesce(cov.n, 0) AS rep, lost FROM d JOIN w0 USING (rid) JOIN g USING (rid) LEFT JOIN cov USING (rid))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(dup AS BIGINT) AS n_dup_lines,
    CAST(rep AS BIGINT) AS n_repeat_words, (n_words < {MIN_WORDS} OR 100 * rep > {MAX_REPEAT} * n_words) AS base_failed,
    NOT (n_words < {MIN_WORDS} OR 100 * rep > {MAX_REPEAT} * n_words) AND 100 * lost <= {MAX_LOST} * n_words AS kept
FROM r
"""
}
