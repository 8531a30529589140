"""Surrogates for personal data (operator 9), in DataFrame functions only.

Entities are found by one pattern: assigned secrets, e-mail addresses, IBANs, keys and long hexadecimal tokens, IP addresses, card
numbers that pass the Luhn test, social security numbers, phone numbers, and names beside a form of address. Each is replaced by a surrogate of the same
kind that is computed from a secret key and the entity's canonical form (case and separators do not count), so that mentions of one
entity get the same surrogate in all documents, written as the mention was: digits stay digits, letters keep their script and case,
separators, the keyword of a secret, the top-level domain and the country code stay, card numbers, and IBANs that pass the mod-97 test,
still pass, and addresses stay valid. A name is two entities, the family name and what stands before it; the
latter is drawn from names of the gender that the form of address shows, so `Mr John Smith` and `Mr Peter Smith` stay two persons of one
family, and `Mr Smith` has their family name. The surrogate is drawn from the canonical form alone; a mention only lends it its
separators and case, so what is compared for collisions is what is written.

The key comes from the caller or from `spark.quaymaster.surrogateKey` of the session. Where neither is set, it is drawn at random once
for each application: nobody can tell an original from its surrogate by trying all, and another run gives other surrogates.

Collisions: over the distinct entities of the whole corpus, surrogates that two entities share, or that some entity has itself (given
names, which many persons share anyway, may be another's), are drawn again (a counter goes into the digest) until there are none. Where
a form is so short that its surrogates run out, later draws are longer: from the PLAIN-th on, each has a letter, digit or syllable more
than the one before, so that however many entities share a form, all get one; IP addresses become IPv6 addresses of the documentation's
prefix then. Those drawn again are few; up to MAP_ENTRIES of them travel as a literal, more are joined.

Names in scripts without case are found by a form of address before (Arabic, Hebrew, Devanagari) or after them (Han, Kana, Hangul).

Cases: null text stays null with no entities; long texts are searched whole; repeated rows alike; empty tables give an empty result;
a doc_id may be null or repeated; other columns are kept by `pseudonymised` (its own names win).
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .quality import let

MAP_ENTRIES = 2_000
#: Draws in the entity's own form before the form grows; addresses, which cannot grow by a digit, have more.
PLAIN, PLAIN_IP = 3, 16

_B, _A = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
SECRET_WORD = r"(?i:token|secret|api[_-]?key|access[_-]?key|password|passwd|pwd)[\"']?\s{0,3}[:=]\s{0,3}[\"']?"
#: Forms of address by gender (fixed values).
FEMALE, MALE, NEUTRAL = r"Mrs|Ms|Miss|Frau|Mme|Mlle|Madame|Señora|Sra", r"Mr|Herr|Monsieur|Señor|Sr", r"Dr|Prof"
_NAME = r"\p{Lu}[\p{L}'’-]+"
#: Forms of address in scripts without case, before or after a name (fixed values).
#: letters of Han, Kana and Hangul, and those that a form of address without case begins with.
CJK, FIRST = "\u3040-\u30ff\u3400-\u9fff\uac00-\ud7a3", "\u0627\u05d2\u05de\u0936先女小太さ様氏씨님"
BEFORE, AFTER = r"السيدة|السيد|الدكتورة|الدكتور|גברת|מר|श्रीमती|श्री", r"先生|女士|小姐|太太|さん|様|氏|씨|님"
KINDS = {
    "secret": f"{_B}{SECRET_WORD}[^\\s\"'<>,;]{{6,}}",
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[\p{L}\p{N}-]++\.)+\p{L}{2,}+",
    "iban": _B + r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + _A,
    "key": _B + r"(?:[0-9a-fA-F]{32,128}|(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,})" + _A,
    "ip": r"(?<![\p{L}\p{N}.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\p{L}\p{N}]|\.\d)",
    "card": _B + r"(?:\d{13,19}|\d{4}(?: \d{4}){3}|\d{4}(?:-\d{4}){3}|\d{4} \d{6} \d{5}|\d{4}-\d{6}-\d{5})" + _A,
    "ssn": r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}-])",
    "phone": r"(?<![\p{L}\p{N}+])(?:\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}|\+(?:[ .()-]{0,2}\d){8,15}(?!\.\d)|0\d(?:[ .-]\d{2}){4}|(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4})" + _A,
    "name": f"{_B}(?:{FEMALE}|{MALE}|{NEUTRAL})\\.? (?:(?:\\p{{Lu}}\\. ?){{1,3}})?{_NAME}(?: {_NAME}){{0,2}}",
    "uncased": f"(?=[{FIRST[:4]}{CJK}]){_B}(?:(?:{BEFORE}) [\\p{{L}}\\p{{M}}]{{2,}}|[{CJK}]{{1,6}}? ?(?:{AFTER})){_A}",
}
PATTERN = "|".join(KINDS.values())
#: What looks like an entity and is none.
NONE = "none"
#: Country codes of telephone numbers: no code begins another.
COUNTRY_CODE = r"^\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
#: No text without one of these has an entity.
HINT = f"[0-9@{FIRST}]|{SECRET_WORD}|\\b(?:{FEMALE}|{MALE}|{NEUTRAL})\\.? \\p{{Lu}}"

#: Letters by script and case; names by gender; syllables of family names (fixed values).
LETTERS = {
    "[a-z]": "abcdefghijklmnopqrstuvwxyz", "[A-Z]": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "[ß-öø-ɏ]": "àáâäçèéêëíîïñóôöúûü", "[À-ÖØ-Þ]": "ÀÁÂÄÇÈÉÊËÍÎÏÑÓÔÖÚÛÜ",
    "[α-ω]": "αβγδεζηθικλμνξοπρστυφχψω", "[Α-Ω]": "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
    "[а-яё]": "абвгдежзиклмнопрстуфхцчшюя", "[А-ЯЁ]": "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЮЯ",
    "[ء-ي]": "ابتثجحخدذرزسشصضطظعغفقكلمنهوي", "[א-ת]": "אבגדהוזחטיכלמנסעפצקרשת", "[अ-ह]": "कखगघचछजटठडतथदधनपफबभमयरलवसह",
    "[ぁ-ん]": "あいうえおかきくけこさしすせそたちつてとなにぬねのはひふほまみむめもやゆよらりるれろ", "[ァ-ヶ]": "アイウエオカキクケコサシスセソタチツテトナニヌネノハヒフホマミムメモヤユヨラリルレロ",
    "[가-힣]": "가나다라마바사아자차카타파하고노도로모보소오조",
}
OTHER_LETTERS = "一人天山水月日木火土金花風雨雪石田川林森竹海空星"
GIVEN = {
    "f": ["Anna", "Clara", "Elena", "Emma", "Helen", "Ida", "Julia", "Laura", "Lea", "Maria", "Nora", "Olga", "Paula", "Rosa", "Sara", "Vera"],
    "m": ["Adam", "Anton", "Carl", "Daniel", "Emil", "Felix", "Hugo", "Ivan", "Jonas", "Leon", "Martin", "Oscar", "Paul", "Simon", "Thomas", "Victor"],
    "n": ["Alex", "Andrea", "Charlie", "Dominique", "Kim", "Kai", "Luca", "Noa", "Robin", "Sam", "Sascha", "Toni"],
}
SYLLABLES = ["Bal", "Bren", "Cor", "Dal", "Dor", "Fal", "Gar", "Hal", "Jor", "Kel", "Lan", "Mar", "Nor", "Pel", "Ros", "Sol", "Tor", "Val", "Wen", "Zel"]
#: Endings of given names that are put together once the list is used up.
GIVEN_ENDINGS = {"f": ["a", "ia", "ina", "ella", "ette", "ana", "issa", "elle"], "m": ["o", "us", "an", "er", "ard", "in", "ik", "eo"], "n": ["is", "y", "el", "u", "en", "i", "ey", "ael"]}
MIDDLE, ENDINGS = ["a", "be", "da", "fi", "go", "ki", "lo", "mi", "no", "po", "ra", "se", "ti", "vo"], ["berg", "dale", "feld", "ford", "lin", "man", "mont", "nell", "rano", "rez", "son", "stein", "ton", "var", "ville", "wick"]


def entities(text: Column) -> Column:
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))


def kind_of(e: Column) -> Column:
    """The first kind whose whole pattern the entity is, as in the alternation (look-around does not matter on the entity alone). Numbers
    like those of cards that fail the Luhn test are none and stay."""
    out = None
    for k, p in KINDS.items():
        own = F.when(F.pmod(luhn_sum(F.regexp_replace(e, "[^0-9]", "")), F.lit(10)) == 0, k).otherwise(NONE) if k == "card" else F.lit(k)
        out = F.when(e.rlike(f"^(?:{p})$"), own) if out is None else out.when(e.rlike(f"^(?:{p})$"), own)
    return out.otherwise(NONE)


def canonical(e: Column, kind: Column) -> Column:
    """What mentions of one entity have in common."""
    return (
        F.when(kind == "secret", F.regexp_replace(e, f"^{SECRET_WORD}", ""))
        .when(kind == "email", F.lower(e))
        .when(kind.isin("card", "ssn"), F.regexp_replace(e, "[^0-9]", ""))
        .when(kind == "phone", F.regexp_replace(e, "[^0-9+]", ""))
        .when(kind == "iban", F.regexp_replace(e, " ", ""))
        .when(kind == "name", F.lower(F.regexp_extract(e, f"({_NAME})$", 1)))
        .when(kind == "uncased", F.regexp_replace(e, f"^(?:{BEFORE}) | ?(?:{AFTER})$", ""))
        .otherwise(F.when(e.rlike("^[0-9a-fA-F]+$"), F.lower(e)).otherwise(e))
    )


ADDRESS = f"^(?:{FEMALE}|{MALE}|{NEUTRAL})\\.? "


def given_kind(e: Column) -> Column:
    """The kind of the given name in a mention of a name: the gender that its form of address shows."""
    return F.when(e.rlike(f"^(?:{FEMALE})\\b"), "given-f").when(e.rlike(f"^(?:{MALE})\\b"), "given-m").otherwise("given-n")


def given(e: Column, kind: Column) -> Column:
    """What stands between the form of address and the family name, in lower case; empty for other kinds."""
    return F.when(kind == "name", F.lower(F.trim(F.regexp_replace(F.regexp_replace(e, ADDRESS, ""), f"{_NAME}$", "")))).otherwise("")


def stream_of(key: str, *parts: Column) -> Column:
    """256 hexadecimal digits that only the holder of the key can tell."""
    seed = F.concat_ws("\u001f", F.lit(key), *parts)
    return F.concat(F.sha2(F.concat(seed, F.lit("/0")), 512), F.sha2(F.concat(seed, F.lit("/1")), 512))


def draw(stream: Column, k: Column) -> Column:
    return F.conv(F.substring(stream, F.pmod(4 * k, F.lit(252)) + 1, F.lit(4)), 16, 10).cast("int")


def pick(alphabet: str, n: Column) -> Column:
    return F.substring(F.lit(alphabet), F.pmod(n, F.lit(len(alphabet))) + 1, F.lit(1))


def among(names: list[str], n: Column) -> Column:
    return F.get(F.array(*map(F.lit, names)), F.pmod(n, F.lit(len(names))))


def rewritten(s: Column, stream: Column) -> Column:
    """s with each letter and digit replaced by one of its kind; other characters stay and do not count."""
    hexish = s.rlike("^[^0-9a-fA-F]*(?:[0-9a-f]{32,}|[0-9A-F]{32,})[^0-9a-fA-F]*$")

    def other(c: Column, n: Column) -> Column:
        out = F.when(c.rlike("[0-9]"), pick("0123456789", n)).when(hexish & c.rlike("[a-f]"), pick("abcdef", n)).when(hexish & c.rlike("[A-F]"), pick("ABCDEF", n))
        for k, alphabet in LETTERS.items():
            out = out.when(c.rlike(k), pick(alphabet, n))
        return out.when(c.rlike(r"\p{Nd}"), pick("0123456789", n)).otherwise(pick(OTHER_LETTERS, n))

    def step(acc: Column, c: Column) -> Column:
        counts = c.rlike(r"[\p{L}\p{N}]")
        return F.struct(F.concat(acc["s"], F.when(counts, other(c, draw(stream, acc["k"]))).otherwise(c)).alias("s"), (acc["k"] + counts.cast("int")).alias("k"))

    return F.aggregate(F.split(s, ""), F.struct(F.lit("").alias("s"), F.lit(0).alias("k")), step, lambda acc: acc["s"])


def longer(s: Column, more: Column) -> Column:
    """s with its last letter or digit repeated `more` times at the end (an x, if it has none)."""
    last = F.regexp_extract(s, r"([\p{L}\p{N}])[^\p{L}\p{N}]*$", 1)
    return F.when(more > 0, F.concat(s, F.repeat(F.when(last == "", "x").otherwise(last), more))).otherwise(s)


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a string of digits, its last digit being the check digit."""
    n = F.length(digits)
    each = F.transform(F.split(digits, ""), lambda c, i: let(c.cast("int") * F.when(F.pmod(n - i, F.lit(2)) == 0, 2).otherwise(1), lambda v: F.when(v > 9, v - 9).otherwise(v)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def luhn_kept(e: Column, new: Column) -> Column:
    """new with its last digit set so that it passes the Luhn test if e does."""
    zero = F.concat(F.regexp_replace(F.substring(new, F.lit(1), F.length(new) - 1), "[^0-9]", ""), F.lit("0"))
    check = F.pmod(10 - F.pmod(luhn_sum(zero), F.lit(10)), F.lit(10)).cast("string")
    return F.when(F.pmod(luhn_sum(F.regexp_replace(e, "[^0-9]", "")), F.lit(10)) == 0, F.concat(F.substring(new, F.lit(1), F.length(new) - 1), check)).otherwise(new)


def mod_97(s: Column) -> Column:
    """The remainder of an IBAN, its first four characters moved to the end."""
    moved = F.concat(F.substr(s, F.lit(5)), F.substring(s, 1, 4))
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda a, c: F.pmod(F.when(c.rlike("[0-9]"), a * 10 + c.cast("int")).otherwise(a * 100 + F.ascii(c) - 55), F.lit(97)))


def iban_kept(e: Column, new: Column) -> Column:
    """new with the check digits that make it valid if e is."""
    check = F.lpad((98 - mod_97(F.concat(F.substring(new, 1, 2), F.lit("00"), F.substr(new, F.lit(5))))).cast("string"), 2, "0")
    return F.when(mod_97(e) == 1, F.concat(F.substring(new, 1, 2), check, F.substr(new, F.lit(5)))).otherwise(new)


def surrogate(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    """The surrogate for the entity (kind, canon), in canonical form."""
    stream = stream_of(key, kind, canon, attempt.cast("string"))
    more = F.greatest(attempt - (PLAIN - 1), F.lit(0))

    def made(s: Column) -> Column:
        at = F.instr(canon, "@")
        domain = F.substr(canon, at + 1)
        last = F.concat(F.lit("."), F.element_at(F.split(domain, r"\."), -1))
        hosts = F.substring(domain, F.lit(1), F.length(domain) - F.length(last))
        ip = F.array_join(F.transform(F.split(canon, r"\."), lambda _, i: (1 + F.pmod(draw(s, i), F.lit(254))).cast("string")), ".")
        ip = F.when(attempt < PLAIN_IP, ip).otherwise(F.concat_ws(":", F.lit("2001:db8"), *[F.substring(s, 4 * i + 1, 4) for i in range(6)]))
        syllables = F.when(more > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(more, F.lit(1))), lambda i: among(MIDDLE, draw(s, i + 3))), "")).otherwise("")
        latin = F.lower(F.concat(among(SYLLABLES, draw(s, F.lit(0))), among(MIDDLE, draw(s, F.lit(1))), among(MIDDLE, draw(s, F.lit(2))), syllables, among(ENDINGS, draw(s, F.lit(3)))))
        made_up = F.lower(F.concat(among(SYLLABLES, draw(s, F.lit(0))), among(MIDDLE, draw(s, F.lit(1))), syllables))
        first = None
        for g, names in GIVEN.items():
            one = F.when(attempt == 0, among([x.lower() for x in names], draw(s, F.lit(0)))).otherwise(F.concat(made_up, among(GIVEN_ENDINGS[g], draw(s, F.lit(2)))))
            first = F.when(kind == f"given-{g}", one) if first is None else first.when(kind == f"given-{g}", one)
        head = F.when(kind == "phone", F.regexp_extract(canon, COUNTRY_CODE, 0)).when(kind == "iban", F.substring(canon, 1, 2)).otherwise("")
        body = F.when(kind == "email", F.substring(canon, F.lit(1), at - 1)).otherwise(F.substr(canon, F.length(head) + 1))
        return (
            F.when(kind == "ip", ip).when((kind == "name") & canon.rlike("^[a-z]"), latin).when(kind.startswith("given") & canon.rlike("^[a-z][^.]"), first)
            .otherwise(let(rewritten(longer(body, more), s), lambda new: (
                F.when(kind == "email", F.concat(new, F.lit("@"), rewritten(hosts, stream_of(key, F.lit("domain"), domain)), last))
                .when(kind == "card", luhn_kept(canon, new)).when(kind == "ssn", F.concat(F.lit("9"), F.substr(new, F.lit(2)))).when(kind == "iban", iban_kept(canon, F.concat(head, new))).otherwise(F.concat(head, new))
            )))
        )

    return let(stream, made)


def spaced(e: Column, new: Column) -> Column:
    """The letters and digits of new in the places of those of e; what is left over follows."""
    def step(acc: Column, c: Column) -> Column:
        counts = c.rlike("[A-Za-z0-9]")
        return F.struct(F.concat(acc["s"], F.when(counts, F.substring(new, acc["k"] + 1, F.lit(1))).otherwise(c)).alias("s"), (acc["k"] + counts.cast("int")).alias("k"))

    return F.aggregate(F.split(e, ""), F.struct(F.lit("").alias("s"), F.lit(0).alias("k")), step, lambda acc: F.concat(acc["s"], F.substr(new, acc["k"] + 1)))


def cased(e: Column, new: Column) -> Column:
    """new with capitals where e has them."""
    def one(c: Column, i: Column) -> Column:
        old = F.substring(e, i + 1, F.lit(1))
        return F.when(F.lower(old) != old, F.upper(c)).otherwise(c)

    return F.array_join(F.transform(F.split(new, ""), one), "")


def written(e: Column, kind: Column, canon: Column, new: Column, new_given: Column) -> Column:
    """The entity's surrogate new (and for a name that of what stands before it) as its mention e is written."""
    at, new_at = F.instr(e, "@"), F.instr(new, "@")
    email = F.concat(cased(F.substring(e, F.lit(1), at - 1), F.substring(new, F.lit(1), new_at - 1)), F.lit("@"), cased(F.substr(e, at + 1), F.substr(new, new_at + 1)))
    address = F.regexp_extract(e, ADDRESS, 0)
    family = F.regexp_extract(e, f"({_NAME})$", 1)
    first = F.substring(e, F.length(address) + 1, F.length(e) - F.length(address) - F.length(family))  # with the space after it

    def like(old: Column, own: Column) -> Column:
        capital = F.concat(F.upper(F.substring(own, 1, 1)), F.substr(own, F.lit(2)))
        return F.when((F.upper(old) == old) & (F.length(old) > 2), F.upper(own)).when(own.rlike("^[a-z][^.]"), capital).otherwise(cased(old, own))

    name = F.concat(address, F.when(first == "", "").otherwise(F.concat(like(F.trim(first), new_given), F.regexp_extract(first, " *$", 0))), like(family, new))
    uncased = F.concat(F.regexp_extract(e, f"^(?:{BEFORE}) ", 0), new, F.regexp_extract(e, f" ?(?:{AFTER})$", 0))
    return (
        F.when(kind == "secret", F.concat(F.regexp_extract(e, f"^{SECRET_WORD}", 0), new)).when(kind == "name", name).when(kind == "uncased", uncased).when(e == canon, new)
        .when(kind == "email", email).when(kind.isin("card", "ssn", "phone", "iban"), spaced(e, F.ltrim(new, F.lit("+")))).when(kind == "key", cased(e, new)).otherwise(new)
    )


def surrogate_key(spark: SparkSession) -> str:
    """The session's key, or one drawn at random for the application."""
    if key := spark.conf.get("spark.quaymaster.surrogateKey", None):
        return key
    return spark.sparkContext.__dict__.setdefault("_qm_surrogate_key", secrets.token_hex(32))


def _id(kind: Column, canon: Column) -> Column:
    return F.concat_ws("\u001f", kind, canon)


#: Entities whose surrogates one task draws.
ENTITIES = 20_000


def resolved(docs: DataFrame, key: str) -> DataFrame | None:
    """The entities (id, attempt) whose first surrogate collides, with the attempt that does not; None if there is none. Distinct
    entities only are shuffled, after they are folded in each task."""
    mention = docs.select(F.explode(F.array_distinct(entities(F.col("text")))).alias("e")).distinct()
    mention = mention.select("e", kind_of(F.col("e")).alias("kind")).where(F.col("kind") != NONE).select("e", "kind", canonical(F.col("e"), F.col("kind")).alias("canon"), given(F.col("e"), F.col("kind")).alias("given"))
    one, two = F.struct("kind", "canon"), F.struct(given_kind(F.col("e")).alias("kind"), F.col("given").alias("canon"))
    told = C.staged(mention.select(F.explode(F.when(F.col("given") == "", F.array(one)).otherwise(F.array(one, two))).alias("x")).select("x.*").distinct(), "entities")
    # drawing takes a fraction of a millisecond each, far more than its bytes tell
    now = told.repartition(max(C.shuffle_parts(docs.sparkSession), told.count() // ENTITIES), "kind", "canon").withColumn("attempt", F.lit(0))

    def compared(c: Column) -> Column:
        # numbers are told apart by their digits even if only one is written with a plus
        return F.when(F.col("kind") == "phone", F.ltrim(c, F.lit("+"))).otherwise(c)

    def drawn(attempt: Column) -> Column:
        return compared(surrogate(F.col("kind"), F.col("canon"), attempt, key))

    now = C.staged(now.withColumn("s", drawn(F.col("attempt"))), "surrogates")
    first = True
    while True:  # ends: of those that share a surrogate one stays, and the others' forms grow
        shared = now.groupBy("kind", "s").agg(F.min("canon").alias("one"), F.count(F.lit(1)).alias("n")).where("n > 1").select("kind", "s", "one")
        twice = now.join(shared, ["kind", "s"]).where("canon <> one").select("kind", "canon")
        taken = now.where(~F.col("kind").startswith("given")).join(now.select("kind", compared(F.col("canon")).alias("s")), ["kind", "s"], "left_semi").select("kind", "canon")
        taken = taken.unionByName(now.where(F.col("kind").startswith("given") & (F.col("s") == F.col("canon"))).select("kind", "canon"))
        bad = C.staged(twice.unionByName(taken).distinct(), "collisions")
        if bad.isEmpty():
            return None if first else now.where("attempt > 0").select(_id(F.col("kind"), F.col("canon")).alias("id"), "attempt")
        first = False
        moved = now.join(bad.withColumn("again", F.lit(1)), ["kind", "canon"], "left").withColumn("attempt", F.col("attempt") + F.coalesce("again", F.lit(0)))
        now = C.staged(moved.withColumn("s", F.when(F.col("again").isNotNull(), drawn(F.col("attempt"))).otherwise(F.col("s"))).drop("again"), "surrogates")


def pseudonymised(docs: DataFrame, key: str | None = None, resolve: bool = True) -> DataFrame:
    """docs with the entities in `text` replaced, and n_entities, n_distinct and kinds (of the original text). key: see surrogate_key."""
    text = F.col("text")
    key = key or surrogate_key(docs.sparkSession)
    again = resolved(docs, key) if resolve else None
    attempts: Column | None = None
    own = [c for c in docs.columns if c not in ("n_entities", "n_distinct", "kinds", "_attempts", "_digest")]
    docs = docs.select(*own)
    if again is not None and len(few := again.limit(MAP_ENTRIES + 1).collect()) <= MAP_ENTRIES:
        attempts = F.create_map(*[F.lit(x) for r in few for x in (r["id"], r["attempt"])])
    elif again is not None:
        # texts that cannot have an entity get digests that meet nothing, and no two the same
        docs = docs.withColumn("_digest", F.when(text.rlike(HINT), F.sha2(text, 256)).otherwise(F.concat(F.lit("-"), F.monotonically_increasing_id())))
        e, kind = F.col("e"), F.col("kind")
        met = docs.where(text.rlike(HINT)).select(F.sha2(text, 256).alias("_digest"), F.explode(entities(text)).alias("e")).withColumn("kind", kind_of(e))
        met = met.select("_digest", F.explode(F.array(_id(kind, canonical(e, kind)), _id(given_kind(e), given(e, kind)))).alias("id")).distinct()
        maps = met.join(again, "id").groupBy("_digest").agg(F.map_from_entries(F.collect_list(F.struct("id", "attempt"))).alias("_attempts"))
        docs = docs.join(maps, "_digest", "left")
        attempts = F.col("_attempts")

    def one(e: Column) -> Column:
        def drawn(kind: Column, canon: Column) -> Column:
            attempt = F.lit(0) if attempts is None else F.coalesce(F.element_at(attempts, _id(kind, canon)), F.lit(0))
            return surrogate(kind, canon, attempt, key)

        def known(x: Column) -> Column:
            first = F.when(x["given"] == "", "").otherwise(let(F.struct(given_kind(e).alias("kind"), x["given"].alias("canon")), lambda g: drawn(g["kind"], g["canon"])))
            new = let(F.struct(drawn(x["kind"], x["canon"]).alias("new"), first.alias("first")), lambda d: written(e, x["kind"], x["canon"], d["new"], d["first"]))
            return F.struct(F.when(x["kind"] == NONE, e).otherwise(new).alias("s"), x["kind"].alias("kind"), x["canon"].alias("canon"))

        return let(let(kind_of(e), lambda k: F.struct(k.alias("kind"), canonical(e, k).alias("canon"), given(e, k).alias("given"))), known)

    def woven(found: Column) -> Column:
        parts, real = F.split(text, PATTERN, -1), F.filter(found, lambda x: x["kind"] != NONE)
        return F.struct(
            F.when(F.size(found) == 0, text).otherwise(F.array_join(F.zip_with(parts, found, lambda a, b: F.concat(a, F.coalesce(b["s"], F.lit("")))), "")).alias("text"),
            F.size(real).cast("long").alias("n_entities"),
            F.size(F.array_distinct(F.transform(real, lambda x: _id(x["kind"], x["canon"])))).cast("long").alias("n_distinct"),
            F.array_join(F.array_sort(F.array_distinct(F.transform(real, lambda x: x["kind"]))), ",").alias("kinds"),
        )

    done = let(F.transform(F.coalesce(entities(text), F.array().cast("array<string>")), one), woven)
    new = docs.select(*[c for c in own if c != "text"], F.when(text.isNotNull() & text.rlike(HINT), done).otherwise(F.struct(text.alias("text"), F.lit(0).cast("long").alias("n_entities"), F.lit(0).cast("long").alias("n_distinct"), F.lit("").alias("kinds"))).alias("_x"))
    return new.select(*[F.col("_x.text").alias("text") if c == "text" else F.col(c) for c in own], "_x.n_entities", "_x.n_distinct", "_x.kinds")


def op9_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymised(C.documents(spark, sf_dir).select("doc_id", "text"))


QUERIES = {"op9_pii_surrogates": op9_surrogates}
SQL: dict[str, str] = {}
