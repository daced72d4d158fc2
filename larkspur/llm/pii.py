r"""Personal data: detected entities get keyed surrogates of the same type and format.

Entities are found by one regular expression of anchored alternatives. A surrogate is drawn by
HMAC-SHA256 from a secret key, the entity's type and its canonical value (case, separators and
titles aside), so every mention of one entity in any document gets the same surrogate, in the
mention's own format: digits for digits, letters for letters of the same case and script,
separators kept. A number is a card if it begins as issuers' numbers do and passes the Luhn test;
its surrogate keeps the first two digits and passes it too. Telephone numbers keep the country
code; e-mail domains are replaced as wholes under reserved names; addresses stay addresses. Names
after a title are replaced word by word, so that "Mr John Smith" and "Mr Smith" keep what they
share: the last word is a family name, those before it are given names of the title's gender,
all in the word's own script (Latin, Cyrillic or Greek) and case.

Collision checks keep distinct entities distinct: all distinct entities of the input are held
against each other's surrogates and against each other's values, and those that clash draw anew
until none does. With each new draw, names, the local parts of addresses, secrets and (from the
fourth on) telephone numbers get longer by one syllable, letter or digit of the key's stream, so
that no number of distinct entities exhausts them; IP addresses, cards and social security
numbers keep their length, and have millions of values. Entities are few beside the texts, and
are combined before they are shuffled.
Only entities that had to draw anew travel back to documents; mostly there are none, and then the
texts are rewritten in one pass without any shuffle. Up to SMALL of them are broadcast, more are
joined.

DataFrame functions only. Texts are matched whole; every quantifier is bounded or possessive and
anchored at a token's start, so very long texts cost no more a character than short ones.

Defined results: null text stays null with no entities; text without entities is unchanged;
repeated rows are rewritten alike, whatever their doc_id, which is not read; an empty table gives
an empty result; extra columns are kept, and those made here replace clashing ones.
"""

from __future__ import annotations

import hashlib
import secrets

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .state import aside, cut

#: The setting that holds the secret key; where it is unset, a query draws one for its run.
KEY_SETTING = "spark.larkspur.pii.key"
SMALL = 100_000

# Titles and the gender that they tell.
FEMALE = ("Mrs", "Ms", "Miss", "Madame", "Mme", "Frau", "Señora", "Sra", "Госпожа", "Κυρία")
MALE = ("Mr", "Monsieur", "Herr", "Señor", "Sr", "Господин", "Κύριος")
# Given names by script and gender, family names by script.
GIVEN = {
    "latin_f": "Ada Alma Berta Carla Clara Dora Edith Elena Emma Flora Frida Greta Helga Ida Irma Julia Karin Laura Lena Lucia Marta Mina Nora Olga Paula Rita Rosa Sofia Tilda Vera Wilma Zoe".split(),
    "latin_m": "Adam Albert Anton Bruno Carl David Edgar Emil Erik Felix Frank Georg Gustav Hugo Ivan Jakob Jonas Karl Leo Lukas Marco Max Nils Otto Paul Peter Rolf Simon Theo Tomas Viktor Walter".split(),
    "cyrillic_f": "Анна Вера Дарья Елена Зоя Ирина Лидия Мария Нина Ольга Раиса Софья Тамара Юлия Яна Алла".split(),
    "cyrillic_m": "Антон Борис Виктор Глеб Денис Егор Захар Иван Кирилл Лев Макар Олег Павел Роман Семён Тимур".split(),
    "greek_f": "Άννα Ελένη Ειρήνη Ζωή Ιωάννα Μαρία Νίκη Σοφία".split(),
    "greek_m": "Άρης Γιάννης Ηλίας Κώστας Λουκάς Νίκος Πέτρος Σπύρος".split(),
}
FAMILY = {
    "latin": "Abel Adler Arnold Bauer Becker Berger Blanc Borg Braun Castro Cruz Dahl Dietz Duval Engel Ernst Faber Ferro Fisher Fontana Garnier Gomez Graf Haas Hahn Hoffman Jansen Keller Koch Kramer Lang Lopez Ludwig Marin Martin Mayer Moreau Morin Navarro Nilsen Olsen Ortega Pascal Perrin Petit Pohl Ramos Reyes Ritter Rossi Roux Sauer Serra Simon Sommer Stein Torres Vega Vogel Wagner Weber Winter Wolf Ziegler".split(),
    "cyrillic": "Белов Волков Громов Жуков Зимин Ильин Козлов Лапин Марков Носов Орлов Панов Рыбин Соколов Титов Фомин".split(),
    "greek": "Αλεξίου Βασιλείου Γεωργίου Δημητρίου Ιωάννου Κωνσταντίνου Νικολάου Παύλου".split(),
}
# Syllables that lengthen family names by script, letters and digits that lengthen other values.
SYLLABLES = {s: [a + b for a in onsets for b in vowels] for s, onsets, vowels in (
    ("latin", "bdfgklmnprstvz", "aeiou"),
    ("cyrillic", "бвгдзклмнпрстф", "аеиоу"),
    ("greek", "βγδζκλμνπρστφχ", "αεηιο"),
)}
LETTERS, DIGITS = list("bcdfghjklmnpqrst"), list("0123456789")

_TITLES = "|".join((*FEMALE, *MALE))
_NAME = r"\p{Lu}[\p{L}'’-]{1,30}"
#: Type and pattern; the first that matches at a place wins.
PATTERNS = [
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+){1,8}+"),
    ("password", r"(?<![A-Za-z])(?:password|passwd|pwd|secret|token|api_key)\s{0,3}[=:]\s{0,3}\"?[A-Za-z0-9_\-]{8,128}+"),
    ("key", r"(?<![A-Za-z0-9_])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,64}+|[0-9a-f]{32,64}+|[0-9A-F]{32,64}+)(?![A-Za-z0-9_])"),
    ("ip", r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d)"),
    ("card", r"(?<![\w+])\d(?:[ -]?\d){12,18}(?!\w|-\d)"),
    ("ssn", r"(?<!\w|\d-)\d{3}-\d{2}-\d{4}(?!\w|-\d)"),
    (
        "phone",
        r"(?<!\w)(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\w)|(?<!\w)\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\w)|(?<!\w|\d-)\d{3}[ .-]\d{3}[ .-]\d{4}(?!\w|-\d)",
    ),
    ("name", rf"(?<!\p{{L}})(?:{_TITLES})\.?[ ]{_NAME}(?:[ ]{_NAME}){{0,2}}"),
]
#: No pattern matches right after an ASCII letter, nor begins with another character than these: most places are left at once.
ENTITY = r"(?<![A-Za-z])(?=[\p{Lu}a-z0-9._%+(-])(?:" + "|".join(p for _, p in PATTERNS) + ")"
#: A cheap necessary condition: most texts need no matching at all.
HINT = r"[@\d]|(?<![A-Za-z])(?:" + _TITLES + r"|password|passwd|pwd|secret|token|api_key|AKIA|gh[pousr]_|sk-|[A-Fa-f]{32})"


def _luhn_sum(digits: Column, doubled: int) -> Column:
    """The Luhn sum of an array of digits from the right; places with the remainder `doubled` by 2 count double."""

    def worth(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 != doubled, d).otherwise(F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2))

    return F.aggregate(F.transform(digits, worth), F.lit(0), lambda a, x: a + x)


def is_card(e: Column) -> Column:
    digits = F.regexp_replace(e, "[^0-9]", "")
    issued = digits.rlike("^(?:4|5[0-9]|2[2-7]|3[0-9]|6)")
    return issued & (_luhn_sum(F.reverse(F.split(digits, "")), 1) % 10 == 0)


def kind_of(e: Column) -> Column:
    """The kind of a match, or none: a long number that is no card."""
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(PATTERNS):
        hit = e.rlike("^(?:" + pattern + ")$")
        out = F.when(hit, F.when(is_card(e), F.lit(kind)).otherwise(F.lit("none")) if kind == "card" else F.lit(kind)).otherwise(out)
    return F.coalesce(out, F.lit("phone"))


def canonical(kind: Column, e: Column) -> Column:
    """What mentions of one entity have in common; it begins with the kind."""
    digits = F.regexp_replace(e, r"[^0-9+]", "")
    secret = F.regexp_extract(e, r"([A-Za-z0-9_\-]+)$", 1)
    small = kind.isin("email", "given_f", "given_m", "family")
    value = F.when(small, F.lower(e)).when(kind.isin("card", "ssn", "phone"), digits).when(kind == "password", secret).otherwise(e)
    kept = F.when(kind == "password", F.lit("key")).otherwise(kind)  # one secret after a label or alone is one entity
    return F.concat(kept, F.lit(":"), value)


def _stream(key: str, *by: Column) -> Column:
    """64 hex digits: the HMAC-SHA256 of `by` under `key`."""
    block = key.encode()
    block = (hashlib.sha256(block).digest() if len(block) > 64 else block).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(x ^ pad for x in block)) for pad in (0x36, 0x5C))
    body = F.encode(F.concat_ws("\x01", *by), "UTF-8")
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, body), 256))), 256)


def _bound(value: Column, body) -> Column:
    """`body` of `value`, which is computed once however often `body` names it."""
    return F.get(F.transform(F.array(value), body), 0)


def _fit_format(e: Column, hexes: Column, keep: Column) -> Column:
    """`e` with its digits and ASCII letters replaced from a hex stream, the first `keep` of them kept.

    Stream places count replaceable characters only, so separators do not matter.
    """
    hex_only = ~e.rlike("[g-zG-Z]") & e.rlike(r"^[0-9a-fA-F]+$")
    small = F.when(hex_only, F.translate(hexes, "0123456789", "abcdefabcd")).otherwise(F.translate(hexes, "0123456789abcdef", "bcdfghjklmnpqrst"))
    streams = F.struct(e.alias("e"), keep.alias("keep"), F.translate(hexes, "abcdef", "274951").alias("numbers"), small.alias("small"))
    return _bound(streams, lambda v: _from_streams(v["e"], v["numbers"], v["small"], v["keep"]))


def _from_streams(e: Column, numbers: Column, small: Column, keep: Column) -> Column:
    def step(s: Column, c: Column) -> Column:
        at = F.substring(numbers, s["k"] % 64 + 1, F.lit(1))
        letter = F.substring(small, s["k"] % 64 + 1, F.lit(1))
        kind = F.when(c.rlike("[0-9]"), at).when(c.rlike("[a-z]"), letter).when(c.rlike("[A-Z]"), F.upper(letter))
        made = F.when(kind.isNull() | (s["k"] < keep), c).otherwise(kind)
        return F.struct(F.concat(s["out"], made).alias("out"), (s["k"] + F.when(kind.isNull(), 0).otherwise(1)).alias("k"))

    return F.aggregate(F.split(e, ""), F.struct(F.lit("").alias("out"), F.lit(0).alias("k")), step)["out"]


def _luhn(e: Column) -> Column:
    """`e` with its last digit set so that its digits pass the Luhn test."""
    head = F.substring(e, F.lit(1), F.length(e) - 1)
    total = _luhn_sum(F.reverse(F.split(F.regexp_replace(head, "[^0-9]", ""), "")), 0)
    return F.concat(head, ((10 - total % 10) % 10).cast("string"))


def _pick(values: list[str], hexes: Column, at: int) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), F.conv(F.substring(hexes, at, 6), 16, 10).cast("int") % len(values))


def _longer(hexes: Column, by: Column, values: list[str]) -> Column:
    """`by` of `values` joined, each from a stream of its own; empty for none."""
    drawn = F.transform(F.sequence(F.lit(1), by), lambda i: _pick(values, F.sha2(F.concat_ws(":", hexes, i.cast("string")), 256), 1))
    return F.when(by > 0, F.array_join(drawn, "")).otherwise("")


def _word(e: Column, kind: Column, hexes: Column, attempt: Column) -> Column:
    """A given or family name in the script and case of `e`, longer by a syllable for every new draw."""
    script = F.when(e.rlike(r"\p{IsCyrillic}"), "cyrillic").when(e.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    made = F.lit(None).cast("string")
    for s in FAMILY:
        first = F.when(kind == "given_f", _pick(GIVEN[f"{s}_f"], hexes, 1)).when(kind == "given_m", _pick(GIVEN[f"{s}_m"], hexes, 1)).otherwise(_pick(FAMILY[s], hexes, 8))
        made = F.when(script == s, F.concat(first, _longer(hexes, attempt, SYLLABLES[s]))).otherwise(made)
    return F.when((F.upper(e) == e) & (F.length(e) > 1), F.upper(made)).otherwise(made)


def _title(e: Column) -> Column:
    return F.regexp_extract(e, rf"^((?:{_TITLES})\.?[ ])", 1)


def _entities(e: Column, kind: Column) -> Column:
    """What a mention consists of, as an array of (e, kind, canon): the words of a name, else the mention itself."""
    title = _title(e)
    given = F.when(F.regexp_replace(title, r"[. ]", "").isin(*FEMALE), "given_f").otherwise("given_m")
    names = F.split(F.substring(e, F.length(title) + 1, F.length(e)), " ")
    kinds = F.transform(names, lambda w, i: F.struct(w.alias("e"), F.when(i + 1 == F.size(names), "family").otherwise(given).alias("kind")))
    whole = F.array(F.struct(e.alias("e"), kind.alias("kind")))
    parts = F.when(kind == "name", kinds).otherwise(whole)
    return F.transform(parts, lambda x: F.struct(x["e"].alias("e"), x["kind"].alias("kind"), canonical(x["kind"], x["e"]).alias("canon")))


def surrogate(e: Column, kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    """The surrogate of a mention `e`; the same for all mentions of one canonical value, but for format."""
    drawn = F.struct(e.alias("e"), kind.alias("kind"), attempt.alias("attempt"), _stream(key, canon, attempt.cast("string")).alias("hexes"))
    return _bound(drawn, lambda v: _drawn(v["e"], v["kind"], v["attempt"], v["hexes"], key))


def _drawn(e: Column, kind: Column, attempt: Column, hexes: Column, key: str) -> Column:
    none = F.lit(0)
    local, domain = F.substring_index(e, "@", 1), F.substring_index(F.lower(e), "@", -1)
    place = F.translate(F.substring(_stream(key, F.lit("domain"), domain), 1, 10), "0123456789abcdef", "bcdfghjklmnpqrst")
    label = F.regexp_extract(e, r"^(.*?)[A-Za-z0-9_\-]+$", 1)
    secret = F.regexp_extract(e, r"([A-Za-z0-9_\-]+)$", 1)
    prefix = F.when(secret.rlike("^AKIA"), 4).when(secret.rlike("^gh[pousr]_"), 3).when(secret.rlike("^sk-"), 2).otherwise(0)
    octet = lambda i: (F.conv(F.substring(hexes, i, 4), 16, 10).cast("int") % 254 + 1).cast("string")
    country = F.length(F.regexp_replace(F.regexp_extract(e, r"^\+(\d{1,3})", 1), r"\D", ""))
    return (
        F.when(kind == "email", F.concat(_fit_format(local, hexes, none), _longer(hexes, attempt, LETTERS), F.lit("@"), place, F.lit(".example.org")))
        .when(kind == "ip", F.concat_ws(".", octet(1), octet(5), octet(9), octet(13)))
        .when(kind == "card", _luhn(_fit_format(e, hexes, F.lit(2))))
        .when(kind == "none", e)
        .when(kind == "ssn", F.concat(F.lit("9"), F.substring(_fit_format(e, hexes, none), F.lit(2), F.length(e))))
        .when(kind == "phone", F.concat(_fit_format(e, hexes, country), _longer(hexes, attempt - 3, DIGITS)))
        .when(kind.isin("given_f", "given_m", "family"), _word(e, kind, hexes, attempt))
        .otherwise(F.concat(label, _fit_format(secret, hexes, prefix), _longer(hexes, attempt, LETTERS)))
    )


def _mentions(text: Column) -> Column:
    """All entities of a text in order; empty for most texts after a cheap test."""
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))).otherwise(F.expr("cast(array() as array<string>)"))


def redraws(docs: DataFrame, key: str) -> DataFrame | None:
    """(canon, attempt) of the entities whose first surrogate clashed, or None if there are none."""
    # explode() would have the texts searched twice more, by the filters that the optimizer derives from it
    found = docs.select(F.explode_outer(_mentions(F.col("text"))).alias("m")).where("m IS NOT NULL").select(F.explode_outer(_entities(F.col("m"), kind_of(F.col("m")))).alias("x"))
    found = found.where("x.kind <> 'none'").groupBy("x.canon").agg(F.min("x.e").alias("e"), F.min("x.kind").alias("kind"))
    drawn = cut(found.withColumn("attempt", F.lit(0)))
    while True:
        made = drawn.withColumn("made", surrogate(F.col("e"), F.col("kind"), F.col("canon"), F.col("attempt"), key))
        seen = cut(made.withColumn("new", canonical(F.col("kind"), F.col("made"))).drop("made"))
        first = seen.groupBy("new").agg(F.min("canon").alias("owner"), F.count(F.lit(1)).alias("n"))
        shared = first.where("n > 1")
        real = seen.select("canon").withColumnRenamed("canon", "new").join(first.select("new"), "new", "left_semi")
        both = shared.select("new", "owner").unionByName(real.select("new", F.lit(None).cast("string").alias("owner")))
        clash = cut(both.groupBy("new").agg(F.min("owner").alias("owner"), F.max(F.col("owner").isNull()).alias("real")))
        if clash.isEmpty():
            break
        again = seen.join(clash, "new", "left")
        anew = F.when(F.col("real") | (F.col("owner") != F.col("canon")), 1).otherwise(0)
        drawn = cut(again.select("canon", "e", "kind", (F.col("attempt") + anew).alias("attempt")))
    again = drawn.where("attempt > 0").select("canon", "attempt")
    return None if again.isEmpty() else again


def _attempts(body: DataFrame, again: DataFrame) -> DataFrame:
    """(__k, __m): for each text with entities that drew anew, by its hashes, their attempts by canonical value."""
    each = body.where(F.size("__e") > 0).select("__k", F.explode("__e").alias("m")).select("__k", F.explode(_entities(F.col("m"), kind_of(F.col("m")))).alias("x"))
    small = again.count() <= SMALL
    each = each.select("__k", "x.canon").join(F.broadcast(again) if small else again, "canon").distinct()
    return each.groupBy("__k").agg(F.map_from_entries(F.collect_list(F.struct("canon", "attempt"))).alias("__m"))


def pseudonymize(docs: DataFrame, key: str) -> DataFrame:
    """`docs` with its text rewritten under the secret `key`, and `n_entities`."""
    if not key:
        raise ValueError("surrogates need a secret key")
    docs, back = aside(docs)
    columns = [c for c in docs.columns if c != "n_entities"]
    again = redraws(docs.select("text"), key)
    body = docs.select(*columns, _mentions(F.col("text")).alias("__e"))
    if again is not None:
        body = body.withColumn("__k", F.struct(F.xxhash64("text"), F.xxhash64(F.lit(1), "text")))
        maps = cut(_attempts(body, again))
        body = body.join(F.broadcast(maps) if maps.count() <= SMALL else maps, "__k", "left").drop("__k")
    else:
        body = body.withColumn("__m", F.lit(None).cast("map<string,int>"))

    def replaced(x: Column) -> Column:
        return surrogate(x["e"], x["kind"], x["canon"], F.coalesce(F.try_element_at(F.col("__m"), x["canon"]), F.lit(0)), key)

    def of(e: Column) -> Column:
        def made(v: Column) -> Column:
            words = F.array_join(F.transform(_entities(v["e"], v["kind"]), replaced), " ")
            return F.when(v["kind"] == "name", F.concat(_title(v["e"]), words)).otherwise(words)

        return _bound(F.struct(e.alias("e"), kind_of(e).alias("kind")), made)

    parts = F.split(F.col("text"), ENTITY, -1)
    filled = F.transform(parts, lambda p, i: F.concat(p, F.coalesce(F.get(F.col("__s"), i), F.lit(""))))
    body = body.withColumn("__s", F.transform("__e", of))
    text = F.when(F.size("__e") > 0, F.array_join(filled, "")).otherwise(F.col("text"))
    n = F.coalesce(F.size(F.filter("__e", lambda e: kind_of(e) != "none")), F.lit(0)).cast("long").alias("n_entities")
    return back(body.select(*[text.alias("text") if c == "text" else F.col(c) for c in columns], n))


def op9_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pseudonymize(docs, spark.conf.get(KEY_SETTING, None) or secrets.token_hex(32))


QUERIES = {"op9_pii": op9_pii}
ORACLES: dict[str, str] = {}
