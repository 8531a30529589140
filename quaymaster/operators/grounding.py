"""Free text to packages: package URLs, advisory ids, incident names, exact and squashed package names, for many questions at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scores import normalised, squashed
from ..plans.staging import staged

#: Id forms, URL types, incidents, and words that name nothing.
ADVISORY_ID = r"(?i)\b(CVE-\d{4}-\d{3,7}|GHSA-[0-9a-z]{4}-[0-9a-z]{4}-[0-9a-z]{4}|RUSTSEC-\d{4}-\d{4}|PYSEC-\d{4}-\d+|GO-\d{4}-\d+)\b"
PURL = r"pkg:([a-zA-Z]+)/([^/@]+/)?([^@]+)(?:@(.+))?"
PURL_TYPES = {"npm": "npm", "pypi": "pypi", "maven": "maven", "cargo": "cargo", "golang": "go", "go": "go", "gem": "rubygems", "composer": "packagist"}
INCIDENTS = [
    ("log4shell", "maven", "org.apache.logging.log4j:log4j-core"), ("log4j", "maven", "org.apache.logging.log4j:log4j-core"),
    ("spring4shell", "maven", "org.springframework:spring-core"), ("spring4shell", "maven", "org.springframework:spring-beans"),
    ("spring4shell rce", "maven", "org.springframework:spring-core"), ("text4shell", "maven", "org.apache.commons:commons-text"),
    ("xz backdoor", "cargo", "xz2"), ("xz backdoor", "pypi", "xz"), ("left pad", "npm", "left-pad"), ("shai hulud", "npm", "chalk"), ("shai hulud", "npm", "debug"),
    ("event stream", "npm", "event-stream"), ("colors js", "npm", "colors"), ("ua parser", "npm", "ua-parser-js"), ("prototype pollution", "npm", "lodash"), ("prototype pollution", "npm", "minimist"),
]
COMMON = (
    "the a an is are was were our we my in to of and or for vulnerable affected exposed exposure risk issue problem bug attack thing does do have has any which what "
    "package library dependency version code app application service system server client module current latest security advisory cve patch fix update"
).split()


def purl(text: Column) -> Column:
    """struct(ecosystem, name, version) of the first package URL; ecosystem is null for types that are not kept."""
    types = F.create_map(*[F.lit(x) for kv in PURL_TYPES.items() for x in kv])
    g = lambda i: F.regexp_extract(text, PURL, i)
    version = F.when(g(4) != "", g(4))
    return F.when(text.rlike(PURL), F.struct(types[F.lower(g(1))].alias("ecosystem"), F.regexp_replace(F.concat(g(2), g(3)), "/+$", "").alias("name"), version.alias("version")))


def advisory_ids(text: Column) -> Column:
    """Advisory ids in order, upper case."""
    return F.transform(F.regexp_extract_all(text, F.lit(ADVISORY_ID), F.lit(1)), F.upper)


def name_forms(name: Column) -> Column:
    """A package's name, what follows the first colon, and what follows the last slash, in lower case."""
    after = F.when(name.contains(":"), F.substr(name, F.instr(name, ":") + 1))
    last = F.when(name.contains("/"), F.substring_index(name, "/", -1))
    return F.array_distinct(F.transform(F.array_compact(F.array(name, after, last)), F.lower))


def grams(text: Column) -> Column:
    """The words of a normal text that may name something, and pairs of neighbours joined by a space, a slash and a colon."""
    words = F.filter(F.split(text, " +"), lambda w: ~w.isin(*COMMON) & (w != ""))

    def pairs(w: Column) -> Column:
        two = lambda s: F.zip_with(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(s), b))
        return F.array_distinct(F.concat(w, two(" "), two("/"), two(":")))

    return F.transform(F.array(words), pairs)[0]


class Grounder:
    """The indexes of a graph's packages and advisories; only packages with a version are indexed."""

    def __init__(self, packages: DataFrame, versions: DataFrame, advisory_packages: DataFrame, incidents: list[tuple] | None = None):
        """advisory_packages (id, pkg_id): upper-case advisory ids and the packages they affect."""
        real = packages.join(versions.select("pkg_id").distinct(), "pkg_id", "left_semi")
        self.names = staged(real.select("pkg_id", "ecosystem", "name", F.explode(name_forms(F.col("name"))).alias("form")), "names")
        self.squashed = self.names.withColumn("form", squashed(F.col("form"))).where(F.length("form") >= 4).distinct()
        self.packages, self.advisories = packages, advisory_packages
        self.incidents = [*INCIDENTS, *(incidents or [])]

    def ground(self, questions: DataFrame, max_terms: int = 8) -> DataFrame:
        """questions (qid, question) -> qid, pos, ecosystem, name, surface, via: at most max_terms packages of each, in the order of the
        ways they are found by, longer words first."""
        q = staged(questions.select("qid", F.coalesce("question", F.lit("")).alias("question")).withColumn("norm", normalised(F.col("question"))), "questions")
        cols = ["qid", "stage", "o1", "o2", "o3", "ecosystem", "name", "surface", "via"]
        row = lambda df, stage, o1, o2, o3, surface, via: df.select("qid", F.lit(stage).alias("stage"), o1.cast("int").alias("o1"), o2.cast("string").alias("o2"), o3.cast("string").alias("o3"), "ecosystem", "name", surface.alias("surface"), F.lit(via).alias("via"))
        urls = q.withColumn("p", purl(F.col("question"))).where("p.ecosystem IS NOT NULL").select("qid", "p.ecosystem", "p.name", F.regexp_extract("question", f"({PURL})", 1).alias("surface"))
        out = [row(urls, 1, F.lit(0), F.lit(""), F.lit(""), F.col("surface"), "purl")]
        ids = q.select("qid", F.posexplode(advisory_ids(F.col("question"))).alias("k", "id")).join(self.advisories, "id").join(self.packages, "pkg_id")
        out.append(row(ids, 2, F.col("k"), F.col("ecosystem"), F.col("name"), F.col("id"), "advisory"))
        # incidents are a short list of words, matched in place
        table = F.array(*[F.struct(F.lit(a).alias("alias"), F.lit(e).alias("ecosystem"), F.lit(n).alias("name"), F.lit(i).alias("i")) for i, (a, e, n) in enumerate(self.incidents)])
        inc = q.select("qid", F.explode(F.filter(table, lambda x: F.contains(F.col("norm"), x["alias"]))).alias("x")).select("qid", "x.*").join(self.packages.select("ecosystem", "name"), ["ecosystem", "name"], "left_semi")
        out.append(row(inc, 3, -F.length("alias") * 1000 + F.col("i"), F.lit(""), F.lit(""), F.col("alias"), "incident"))
        g = staged(q.select("qid", F.explode(grams(F.col("norm"))).alias("gram")), "grams")
        exact = g.where(F.length("gram") >= 3).join(self.names, g["gram"] == self.names["form"])
        out.append(row(exact, 4, -F.length("gram"), F.concat("gram", F.lit("\u00010")), F.concat("ecosystem", F.lit("\u0001"), "name"), F.col("gram"), "name"))
        sq = g.withColumn("sq", squashed(F.col("gram"))).where(F.length("sq") >= 4)
        loose = sq.join(self.squashed, sq["sq"] == self.squashed["form"])
        out.append(row(loose, 4, -F.length("gram"), F.concat("gram", F.lit("\u00011")), F.concat("ecosystem", F.lit("\u0001"), "name"), F.col("gram"), "name-squashed"))
        every = out[0].select(cols)
        for t in out[1:]:
            every = every.unionByName(t.select(cols))
        first = every.groupBy("qid", "ecosystem", "name").agg(F.min(F.struct("stage", "o1", "o2", "o3", "surface", "via")).alias("x"))
        pos = W.partitionBy("qid").orderBy("x.stage", "x.o1", "x.o2", "x.o3", "ecosystem", "name")
        return first.withColumn("pos", F.row_number().over(pos)).where(F.col("pos") <= max_terms).select("qid", "pos", "ecosystem", "name", "x.surface", "x.via")
