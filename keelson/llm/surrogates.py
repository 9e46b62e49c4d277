"""Surrogates for personal data: keyed, of the same type and format, distinct and the same at every mention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, written

#: Titles that announce a person, by gender. Fixed values.
MALE = ("Mr", "Sir", "Lord", "Herr", "Monsieur", "Señor", "Sr", "Don", "господин")
FEMALE = ("Mrs", "Ms", "Miss", "Lady", "Dame", "Frau", "Fräulein", "Madame", "Mme", "Mademoiselle", "Mlle", "Señora", "Sra", "Señorita", "Srta", "Doña", "госпожа")
#: Titles without a gender, also after another one; alone they count as the first list.
LEARNED = ("Dr", "Dra", "Prof", "Doctor", "Doctora", "Doktor", "Docteur", "Professor", "Professeur", "Profesor", "Profesora", "доктор", "профессор")
#: Given names by script and gender, and syllables of which family names are made. Fixed values.
GIVEN = {
    ("latin", "m"): ("Adam", "Bruno", "Carlos", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leon", "Marco", "Oscar", "Paul", "Simon"),
    ("latin", "f"): ("Alice", "Berta", "Clara", "Diana", "Emma", "Flora", "Greta", "Helen", "Irene", "Julia", "Karin", "Laura", "Marta", "Olga", "Petra", "Sofia"),
    ("cyrillic", "m"): ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл", "Лев", "Максим", "Никита", "Олег", "Павел", "Роман", "Сергей", "Фёдор"),
    ("cyrillic", "f"): ("Анна", "Вера", "Галина", "Дарья", "Елена", "Зоя", "Ирина", "Ксения", "Лидия", "Мария", "Нина", "Ольга", "Полина", "Раиса", "Софья", "Юлия"),
}
SYLLABLES = {
    "latin": ("ba", "ce", "di", "fo", "gu", "ha", "ke", "li", "mo", "nu", "pa", "re", "si", "to", "va", "wen"),
    "cyrillic": ("ба", "ве", "ги", "до", "жу", "за", "ке", "ли", "мо", "ну", "па", "ре", "си", "то", "фа", "хе"),
}

_TITLES = "|".join(MALE + FEMALE + LEARNED)
#: What announces a name: a title (M. with its full stop only), learned titles after it.
TITLED = rf"(?:(?:{_TITLES})\.? |M\. )(?:(?:{'|'.join(LEARNED)})\.? )*+"
#: A word of a name (initials, inner capitals, hyphens, apostrophes), with small words before it.
_WORD = r"(?:(?:von|van|vom|zu|zum|zur|de|del|della|der|den|des|di|da|do|dos|du|la|las|le|los|ten|ter|bin|ibn|al|el) ){0,3}(?:d['’]|al-|el-)?\p{Lu}(?:\.(?!\p{L})|[\p{L}\p{M}]*+(?:-\p{L}[\p{L}\p{M}]*+|['’]\p{Lu}[\p{L}\p{M}]*+)*+)"
#: A digit after at most one separator and a bracket.
_DIGIT = r"(?:(?:[ ./-]|[ ./-]?\(|\)[ ./-]?)?\d)"
#: Patterns by type; each begins with a character or look-behind that fails fast.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "secret": r"(?<![\p{L}\p{N}])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+|AKIA[0-9A-Z]{16})(?![\p{L}\p{N}])|(?<=\")(?=[^\"]*\d)[A-Za-z0-9_/+-]{20,}+(?=\")",
    "phone": r"(?:(?<![\d+])\+\d{1,3}[ .-]?)?(?<!\d)\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}(?!\d)"
    + rf"|\+\d{_DIGIT}{{6,14}}(?!\d)|\+\d{{1,3}}(?:[ .-]\d{{2,4}}){{2,4}}(?!\d)|(?<![\d.+-])00[1-9]\d{{0,2}}(?=[ ./-]){_DIGIT}{{5,12}}(?!\d)"
    + r"|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])|(?<![\d.-])(?<!\d )\d{3} \d{3} \d{4}(?! ?\d|-)|(?<![\d.-])(?<!\d )0[1-9](?:[ .-]?\d{2}){4}(?! ?\d|-)",
    "ip": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\d.-])\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?!\d)",
    "name": rf"(?<!\p{{L}}){TITLED}{_WORD}(?: {_WORD})*+",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A text without any of these holds no entity: each pattern needs a digit, an @, a title, or the letters of a key.
HINT = rf"[0-9@]|AKIA|[a-f]{{32}}|[A-F]{{32}}|{_TITLES}|M\. "
KEY = "surrogate-key-1"
#: Draws after which the check gives up.
DRAWS = 24


def entity_type(e: Column) -> Column:
    """The first type whose pattern is all of the entity."""
    out = F.lit("card")
    for name in reversed(("email", "name", "ip", "ssn", "phone", "iban", "secret")):
        out = F.when(e.rlike(rf"^(?:{PATTERNS[name]})$") if name != "secret" else e.rlike(r"^[A-Za-z0-9_/+-]{20,}$") & e.rlike(r"\D"), name).otherwise(out)
    return out


def canonical(e: Column, kind: Column) -> Column:
    """The form in which mentions of one entity agree: digits alone, lower case, a name with its gender."""
    gender = F.when(e.rlike(rf"^(?:{'|'.join(FEMALE)})\b"), "f").otherwise("m")
    return (
        F.when(kind == "phone", F.regexp_replace(F.regexp_replace(F.regexp_replace(e, r"\(0\)", ""), r"\D", ""), r"^(?:00(?=[1-9])|1(?=\d{10}$))", ""))
        .when(kind.isin("card", "ssn"), F.regexp_replace(e, r"\D", ""))
        .when(kind == "iban", F.regexp_replace(e, " ", ""))
        .when(kind == "name", F.concat(gender, F.lit(":"), F.lower(F.regexp_replace(e, "^" + TITLED, ""))))
        .otherwise(F.lower(e))
    )


def stream(kind: Column, canon: Column, draw: Column, key: str) -> Column:
    """64 keyed numbers from 0 to 15 (hex text) for an entity and a draw."""
    return F.sha2(F.concat_ws("|", F.lit(key), kind, canon, draw.cast("string")).cast("binary"), 256)


def at(s: Column, i: Column, n: int) -> Column:
    """A number below ``n`` (at most 60000) from place ``i`` of a stream, which is read round and round."""
    start = (F.pmod(i * 4, F.lit(61)) + 1).cast("int")
    return F.pmod(F.conv(F.substr(s, start, F.lit(4)), 16, 10).cast("int") + i * 7, F.lit(n)).cast("int")


def letters(e: Column, s: Column, spaced: bool = False) -> Column:
    """Every digit becomes a digit and every letter a letter of its case (of a-f, if the entity is hexadecimal); all else stays.

    ``spaced``: spaces don't count as places, so two forms of one entity change alike."""
    hexa = F.regexp_replace(e, " ", "").rlike(r"^[0-9a-fA-F]+$")
    low = lambda i: F.when(hexa, F.substr(F.lit("abcdef"), at(s, i, 6) + 1, F.lit(1))).otherwise(F.substr(F.lit("abcdefghijklmnopqrstuvwxyz"), at(s, i, 26) + 1, F.lit(1)))
    one = lambda c, i: F.when(c.rlike("[0-9]"), at(s, i, 10).cast("string")).when(c.rlike(r"\p{Lu}"), F.upper(low(i))).when(c.rlike(r"\p{L}"), low(i)).otherwise(c)
    place = lambda i: F.length(F.regexp_replace(F.substr(e, F.lit(1), i), " ", ""))
    return F.array_join(F.transform(F.split(e, ""), (lambda c, i: let(place(i), lambda k: one(c, k))) if spaced else one), "")


def digits(e: Column, s: Column, last: int) -> Column:
    """The ``last`` digits from the right change, the others and all else stay; two forms of one number change alike."""
    right = lambda i: F.length(F.regexp_replace(F.substr(e, i + 1), r"\D", ""))
    one = lambda c, i: F.when(c.rlike("[0-9]"), let(right(i), lambda k: F.when(k <= last, at(s, k, 10).cast("string")).otherwise(c))).otherwise(c)
    return F.array_join(F.transform(F.split(e, ""), one), "")


def luhn(body: Column) -> Column:
    """The check digit of a string of digits."""
    double = lambda d, i: F.when(F.pmod(i, F.lit(2)) == 0, F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)).otherwise(d)
    total = F.aggregate(F.transform(F.split(F.reverse(body), ""), lambda c, i: double(c.cast("int"), i)), F.lit(0), lambda a, x: a + x)
    return F.pmod(10 - F.pmod(total, F.lit(10)), F.lit(10))


def card(e: Column, s: Column) -> Column:
    """The first digit stays (issuer); a valid check digit is followed by a valid one, an invalid one by an invalid one."""
    plain = lambda x: F.regexp_replace(x, r"\D", "")
    body = lambda x: F.substr(x, F.lit(1), F.length(x) - 1)

    def put(pair):
        old, new = plain(pair["e"]), plain(pair["n"])
        off = F.right(old, F.lit(1)).cast("int") - luhn(body(old))
        check = F.pmod(luhn(body(new)) + off, F.lit(10))
        return F.concat(F.substr(pair["n"], F.lit(1), F.length(pair["n"]) - 1), check.cast("string"))

    first = F.substr(e, F.lit(1), F.lit(1))
    return let(F.struct(e.alias("e"), F.concat(first, F.substr(digits(e, s, 19), F.lit(2))).alias("n")), put)


def name(e: Column, canon: Column, s: Column, draw: Column) -> Column:
    """The title stays; a given name of the same gender and script, a made-up family name of the same script."""

    def of(script):
        pick = lambda g: F.element_at(F.array(*map(F.lit, GIVEN[script, g])), at(s, F.lit(1), 16) + 1)
        syllable = lambda i: F.element_at(F.array(*map(F.lit, SYLLABLES[script])), at(s, i + 2, 16) + 1)
        female = F.substr(canon, F.lit(1), F.lit(1)) == "f"
        family = F.initcap(F.array_join(F.transform(F.sequence(F.lit(1), draw + 4), syllable), ""))
        if script == "cyrillic":
            family = F.concat(family, F.when(female, "нова").otherwise("нов"))
        given = F.when(female, pick("f")).otherwise(pick("m"))
        parts = F.size(F.split(F.substring_index(canon, ":", -1), " "))
        return F.when(parts > 1, F.concat(given, F.lit(" "), family)).otherwise(family)

    title = F.regexp_extract(e, "^" + TITLED, 0)
    return F.concat(title, F.when(canon.rlike(r"\p{IsCyrillic}"), of("cyrillic")).otherwise(of("latin")))


def surrogate(e: Column, kind: Column, canon: Column, draw: Column, key: str) -> Column:
    """What stands for the mention ``e`` of an entity; a function of the entity, the key and the draw."""

    def made(s):
        user, host = F.substring_index(e, "@", 1), F.substring_index(e, "@", -1)
        more = F.when(draw > 0, letters(F.repeat(F.lit("a"), draw * 3), F.reverse(s))).otherwise(F.lit(""))  # short users would run out
        mail = F.concat(letters(user, s), more, F.lit("@"), letters(F.regexp_replace(host, r"\.[^.]+$", ""), F.sha2(F.concat(F.lit(key), F.lower(host)).cast("binary"), 256)), F.regexp_extract(host, r"\.[^.]+$", 0))
        octets = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: (at(s, i, 254) + 1).cast("string")), ".")
        return (
            F.when(kind == "email", mail).when(kind == "name", name(e, canon, s, draw)).when(kind == "ip", octets).when(kind == "phone", digits(e, s, 10))
            .when(kind == "ssn", digits(e, s, 9)).when(kind == "card", card(e, s)).when(kind == "iban", F.concat(F.substr(e, F.lit(1), F.lit(2)), letters(F.substr(e, F.lit(3)), s, spaced=True))).otherwise(letters(e, s))
        )

    return let(stream(kind, canon, draw, key), made)


def mentions(text: Column) -> Column:
    """All entities of a text in order."""
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def described(e: Column, body) -> Column:
    """``body(mention, type, canonical form)``."""
    return let(F.struct(e.alias("e"), entity_type(e).alias("k")), lambda x: body(x["e"], x["k"], canonical(x["e"], x["k"])))


def distinct_entities(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.explode(mentions(F.col("text"))).alias("e")).distinct()
    rows = rows.select(described(F.col("e"), lambda e, k, c: F.struct(k.alias("kind"), c.alias("canon"), e.alias("e"))).alias("x"))
    return rows.groupBy("x.kind", "x.canon").agg(F.min("x.e").alias("e"))


def checked(entities: DataFrame, key: str = KEY, draws: int = DRAWS) -> DataFrame | None:
    """(kind, canon, draw) of the entities whose first draw was taken already; None if there are none.

    ``entities``: kind, canon and one mention e. A surrogate is taken if an entity of the same type has it,
    or gets it with a smaller canonical form. Those that lose draw again until no surrogate is taken."""
    now = entities.withColumn("draw", F.lit(0))
    for _ in range(draws):
        s = surrogate(F.col("e"), F.col("kind"), F.col("canon"), F.col("draw"), key)
        now = written(now.withColumn("s", canonical(s, F.col("kind"))), "entities")
        shared = now.groupBy("kind", "s").agg(F.min(F.struct("draw", "canon")).alias("first"), F.count("*").alias("n")).filter("n > 1")
        losers = now.join(shared, ["kind", "s"]).filter("struct(draw, canon) > first").select("kind", "canon")
        real = now.join(now.select("kind", F.col("canon").alias("s")), ["kind", "s"], "left_semi").select("kind", "canon")
        taken = written(losers.union(real).distinct().withColumn("again", F.lit(1)), "taken")
        if taken.isEmpty():
            moved = now.filter("draw > 0").select("kind", "canon", "draw")
            return None if moved.isEmpty() else moved
        now = now.drop("s").join(taken, ["kind", "canon"], "left").withColumn("draw", F.col("draw") + F.coalesce("again", F.lit(0))).drop("again")
    raise ValueError(f"entities without a free surrogate after {draws} draws: longer formats are needed")


def replaced(text: Column, draws: Column | None, key: str) -> Column:
    """Struct of the text with surrogates and the number of mentions. draws: a map of 'kind|canon' to draw, or None."""

    def one(e):
        def body(e, k, c):
            n = F.lit(0) if draws is None else F.coalesce(F.try_element_at(draws, F.concat(k, F.lit("|"), c)), F.lit(0))
            return surrogate(e, k, c, n, key)

        return described(e, body)

    def joined(found):
        gaps = F.split(text, ANY, -1)
        new = F.transform(found, one)
        whole = F.array_join(F.zip_with(gaps, new, lambda g, n: F.concat(g, F.coalesce(n, F.lit("")))), "")
        return F.struct(F.when(F.size(found) > 0, whole).otherwise(text).alias("text"), F.size(found).cast("long").alias("n"))

    return let(mentions(text), joined)


def with_surrogates(docs: DataFrame, key: str = KEY, count: str | None = None) -> DataFrame:
    """``docs`` with every entity of ``text`` replaced; all other columns stay, n_chars follows the new text.

    One entity has one surrogate in the whole corpus, in whatever form it is written, and no two entities of
    a type share one; no surrogate is an entity of the corpus. Null texts stay null, texts without entities
    stay as they are, repeated rows are treated alike. ``count``: a column for the number of mentions."""
    moved = checked(distinct_entities(docs.filter(F.col("text").isNotNull())), key)
    rows, draws = docs, None
    if moved is not None:  # texts that mention an entity with a further draw bring the map of those draws
        some = docs.select("text").filter(F.col("text").rlike(HINT)).select(F.md5(F.col("text").cast("binary")).alias("__t"), F.explode(F.array_distinct(mentions(F.col("text")))).alias("e"))
        some = some.select("__t", described(F.col("e"), lambda e, k, c: F.struct(k.alias("kind"), c.alias("canon"))).alias("x")).select("__t", "x.*").distinct().join(moved, ["kind", "canon"])
        some = some.groupBy("__t").agg(F.map_from_entries(F.collect_set(F.struct(F.concat("kind", F.lit("|"), "canon"), "draw"))).alias("__draws"))
        rows = docs.withColumn("__t", F.md5(F.col("text").cast("binary"))).join(some, "__t", "left").drop("__t")
        draws = F.coalesce(F.col("__draws"), F.create_map().cast("map<string,int>"))
    rows = rows.withColumn("__new", replaced(F.col("text"), draws, key))
    new = {"text": F.when(F.col("text").isNotNull(), F.col("__new.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("text").isNotNull(), F.length("__new.text").cast("long")).otherwise(F.col("n_chars"))
    out = rows.select(*(new[c].alias(c) if c in new else F.col(c) for c in docs.columns), *([F.coalesce("__new.n", F.lit(0)).cast("long").alias(count)] if count else []))
    return out


def surrogate_documents(docs: DataFrame) -> DataFrame:
    return with_surrogates(docs.select("doc_id", "text", "lang", "source"), count="n_entities")
