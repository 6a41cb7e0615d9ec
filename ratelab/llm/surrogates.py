"""Surrogates for personal data, in DataFrame functions only.

Entities are found by patterns and reduced to a canonical form; every distinct form gets a keyed replacement
of its kind: the same gender and script for names, the same shape for numbers, addresses and keys. Replacements
are checked against each other and against all entities of the table, and those that meet another are drawn
again, so different entities stay different and mentions of one entity stay one.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelab.llm.frames import settle

KEY_SETTING = "spark.ratelab.surrogateKey"
PUBLIC_KEY = "surrogate-key"
#: From this attempt on a draw gets a keyed tail that grows with the attempts, so that every short form finds room.
TAIL_FROM = 3

# Name lists by script and gender, and forms of address.
FEMALE = "Alice Amelia Anna Bianca Carla Clara Diana Elena Emma Eva Fiona Gloria Hanna Ines Iris Julia Laura Lea Lucia Maria Nora Olivia Paula Rosa Sara Sofia Sonia Teresa Vera Victoria Yvonne Zoe".split()
MALE = "Adam Albert Anton Bruno Carlos Cesar Daniel David Edgar Emil Felix Frank Georg Hugo Ivan Jakob James Jonas Karl Leon Lucas Marco Martin Max Oscar Paul Peter Robert Samuel Simon Thomas Victor".split()
SURNAMES = "Abbott Becker Bennett Carter Castillo Costa Delgado Dubois Ellis Fischer Fontaine Garnier Harper Hoffmann Iglesias Keller Lambert Lindner Marchand Meyer Moreno Navarro Ortega Palmer Perrin Romero Roussel Schubert Sutton Vargas Wagner Webber".split()
CYRILLIC_FEMALE = "Анна Вера Елена Ирина Лидия Мария Нина Ольга".split()
CYRILLIC_MALE = "Антон Борис Виктор Иван Лев Олег Павел Юрий".split()
CYRILLIC_SURNAMES = "Бондаренко Гончар Дорошенко Коваль Мельник Савченко Ткач Шевчук".split()
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Doña", "Госпожа", "госпожа"]
MALE_TITLES = ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Don", "Господин", "господин"]
OTHER_TITLES = ["Dr", "Prof"]

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_CAPITAL = r"\p{Lu}[\p{L}'’-]+"
_TITLE = "(?:" + "|".join(FEMALE_TITLES + MALE_TITLES + OTHER_TITLES) + ")"
_GIVEN = "(?:" + "|".join(FEMALE + MALE + CYRILLIC_FEMALE + CYRILLIC_MALE) + ")"

# A look at the first character stands before each group of kinds, so that most places fail at once.
_KEYWORD = r"(?:password|passwd|pwd|token|secret|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?"

#: Pattern of each kind, the first that matches at a place counting.
KINDS = {
    "secret": rf"(?=[aptsk])(?<![A-Za-z]){_KEYWORD}[^\s\"',;]{{4,}}",
    "access_key": r"(?=A)(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "ip": rf"(?=\d)(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "iban": r"(?=[A-Z]{2}\d)(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?=[2-6])(?<![\d-])(?:[2-6]\d{3}[ -]?\d{4}[ -]?\d{4}[ -]?\d{1,7}|3\d{3}[ -]?\d{6}[ -]?\d{5})(?![\d-])",
    "ssn": r"(?=\d)(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?=[\d+(])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)"
             r"|(?<!\d)\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-]))",
    "person": rf"(?=[A-ZА-Яг])(?<!\p{{L}})(?:{_TITLE}\.?[  ]{_CAPITAL}(?:[  ]{_CAPITAL}){{0,2}}|{_GIVEN}[  ]{_CAPITAL})",
}
PATTERN = "|".join(KINDS.values())
_SECRET_HEAD = f"^{_KEYWORD}"
_PERSON_HEAD = rf"^(?:{_TITLE}\.?[  ])?"


def has_mention(text: Column) -> Column:
    """Whether a text has a mention; one without a digit, @, = or : can only hold a person or a key of letters."""
    return F.coalesce((text.rlike("[0-9@=:]") & text.rlike(PATTERN)) | text.rlike("AKIA|ASIA") & text.rlike(KINDS["access_key"])
                      | text.rlike(KINDS["person"]), F.lit(False))


def _kind(mention: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(KINDS.items()):
        out = F.when(mention.rlike(f"^(?:{pattern})$"), name).otherwise(out)
    return F.coalesce(out, F.lit("secret"))


def _canonical(kind: Column, mention: Column) -> Column:
    """One form for all spellings of an entity."""
    digits = F.regexp_replace(mention, r"[^0-9]", "")
    bare = F.regexp_replace(mention, _PERSON_HEAD, "")
    national = F.when((F.length(digits) == 11) & mention.startswith("+1"), F.substr(digits, F.lit(2), F.lit(10))).otherwise(digits)
    return (F.when(kind == "email", F.lower(mention)).when(kind == "phone", national).when(kind.isin("card", "ssn"), digits)
            .when(kind == "iban", F.regexp_replace(mention, " ", "")).when(kind == "secret", F.regexp_replace(mention, _SECRET_HEAD, ""))
            .when(kind == "person", F.lower(F.regexp_replace(bare, r"[  ]+", " "))).otherwise(mention))


def _gender(mention: Column) -> Column:
    titled = lambda titles: mention.rlike(r"^(?:" + "|".join(titles) + r")\.?[  ]")
    given = F.regexp_extract(F.regexp_replace(mention, _PERSON_HEAD, ""), rf"^({_CAPITAL})", 1)
    return (F.when(titled(FEMALE_TITLES) | given.isin(FEMALE + CYRILLIC_FEMALE), "f")
            .when(titled(MALE_TITLES) | given.isin(MALE + CYRILLIC_MALE), "m"))


def secret_key(spark: SparkSession) -> str:
    """The key that the session keeps in KEY_SETTING; without one a public key, good for trials only, and a warning."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        warnings.warn(f"replacements can be recomputed by anyone: set {KEY_SETTING} to a key of your own", stacklevel=2)
    return key or PUBLIC_KEY


def _stream(key: str, *parts: Column) -> Column:
    """Hexadecimal digits that depend on the key and the parts and nothing else, hashed twice with the key in front."""
    inner = F.sha2(F.concat_ws("\x1f", F.lit(key), *parts).cast("binary"), 512)
    return F.sha2(F.concat_ws("\x1f", F.lit(key), inner).cast("binary"), 512)


def _number(stream: Column, at: int, below: int) -> Column:
    return F.pmod(F.conv(F.substr(stream, F.lit(1 + at), F.lit(7)), 16, 10).cast("long"), F.lit(below)).cast("int")


def _like(value: Column, stream: Column) -> Column:
    """Every letter and digit replaced by a keyed one of its class; hexadecimal texts stay hexadecimal."""
    lower, upper = F.lit("abcdefghijklmnopqrstuvwxyz"), F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    is_hex = value.rlike("^(?=.*[a-f])[0-9a-f]{8,}$")

    def one(char: Column, i: Column) -> Column:
        # 32 draws of four digits each from a stream, further streams beyond
        block = F.sha2(F.concat(stream, F.floor(i / 32).cast("string")).cast("binary"), 512)
        draw = F.conv(F.substr(block, (i % 32) * 4 + 1, F.lit(4)), 16, 10).cast("long")
        pick = lambda letters, n: F.substr(letters, (draw % n + 1).cast("int"), F.lit(1))
        return (F.when(is_hex, pick(F.lit("0123456789abcdef"), 16)).when(char.rlike("[0-9]"), pick(F.lit("0123456789"), 10))
                .when(char.rlike("[a-z]"), pick(lower, 26)).when(char.rlike("[A-Z]"), pick(upper, 26))
                .when(char.rlike(r"\p{Lu}"), pick(upper, 26)).when(char.rlike(r"\p{L}"), pick(lower, 26)).otherwise(char))

    return F.array_join(F.transform(F.split(value, "(?<=.)(?=.)"), one), "")


def _luhn(number: Column) -> Column:
    """The number with its last digit set so that the check sum holds."""
    body = F.substr(number, F.lit(1), F.length(number) - 1)
    digits = F.reverse(F.split(body, "(?<=.)(?=.)"))
    doubled = F.transform(digits, lambda d, i: F.when(i % 2 == 0, F.when(d.cast("int") * 2 > 9, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)).otherwise(d.cast("int")))
    total = F.aggregate(doubled, F.lit(0), lambda a, d: a + d)
    return F.concat(body, ((10 - total % 10) % 10).cast("string"))


def _iban(country: Column, rest: Column) -> Column:
    """Country, check digits by the remainder of 97, account."""
    chars = F.split(F.concat(rest, country, F.lit("00")), "(?<=.)(?=.)")
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    left = F.aggregate(chars, F.lit(0), lambda a, c: (a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97)
    return F.concat(country, F.lpad((98 - left).cast("string"), 2, "0"), rest)


def _name(canonical: Column, gender: Column, stream: Column, attempt: Column) -> Column:
    cyrillic = canonical.rlike(r"\p{IsCyrillic}")
    pick = lambda names, at: F.element_at(F.array(*map(F.lit, names)), _number(stream, at, len(names)) + 1)
    either = F.when(gender == "f", True).when(gender == "m", False).otherwise(_number(stream, 40, 2) == 0)
    given = F.when(cyrillic, F.when(either, pick(CYRILLIC_FEMALE, 0)).otherwise(pick(CYRILLIC_MALE, 0))).otherwise(
        F.when(either, pick(FEMALE, 0)).otherwise(pick(MALE, 0)))
    family = F.when(cyrillic, pick(CYRILLIC_SURNAMES, 8)).otherwise(pick(SURNAMES, 8))
    second = F.when(cyrillic, pick(CYRILLIC_SURNAMES, 16)).otherwise(pick(SURNAMES, 16))
    third = F.when(cyrillic, pick(CYRILLIC_SURNAMES, 24)).otherwise(pick(SURNAMES, 24))
    family = F.when(attempt == 0, family).when(attempt <= 3, F.concat_ws("-", family, second)).otherwise(F.concat_ws("-", family, second, third))
    # past that a keyed tail makes room for any number of people
    tail = F.when(attempt > 6, F.translate(F.substr(stream, F.lit(60), F.lit(8)), "0123456789", "ghiklmnopr")).otherwise("")
    family = F.concat(family, tail)
    return F.when(canonical.contains(" "), F.concat_ws(" ", given, family)).otherwise(family)


def _surrogate(key: str) -> Column:
    """The replacement of a canonical form (columns kind, canonical, gender, attempt)."""
    kind, canonical, attempt = F.col("kind"), F.col("canonical"), F.col("attempt")
    stream = _stream(key, kind, canonical, attempt.cast("string"))
    like = _like(canonical, stream)
    user, domain = F.split_part(canonical, F.lit("@"), F.lit(1)), F.split_part(canonical, F.lit("@"), F.lit(2))
    host = _stream(key, F.lit("host"), domain)
    top = F.element_at(F.array(F.lit("com"), F.lit("net"), F.lit("org")), _number(host, 0, 3) + 1)
    # a short form can run out of room, or all of its room can be taken by real forms: later draws are longer
    digits = F.translate(F.substr(stream, F.lit(65), F.least(attempt, F.lit(60))), "abcdef", "012345")
    tail = F.when(attempt >= TAIL_FROM, digits).otherwise("")
    mail = F.concat(_like(user, stream), tail, F.lit("@"), F.lit("mail"), F.substr(host, F.lit(9), F.lit(6)), F.lit(".example."), top)
    octets = F.concat_ws(".", F.lit("10"), *[_number(stream, i * 8, 256).cast("string") for i in range(3)])
    octets = F.concat(octets, F.when(attempt >= TAIL_FROM, F.concat(F.lit(":"), digits)).otherwise(""))
    first = F.substr(canonical, F.lit(1), F.lit(1))
    card = _luhn(F.concat(first, F.substr(like, F.lit(2), F.length(like))))
    # numbers start like no service number, and calls keep the digits of the country
    lead = F.element_at(F.array(*[F.lit(str(d)) for d in range(2, 10)]), _number(stream, 48, 8) + 1)
    keep = F.greatest(F.length(canonical) - 10, F.lit(0))
    phone = F.concat(F.substr(canonical, F.lit(1), keep), lead, F.substr(like, keep + 2, F.length(like)))
    ssn = F.concat(F.lit("9"), F.substr(like, F.lit(2), F.length(like)))
    access = F.concat(F.substr(canonical, F.lit(1), F.lit(4)), F.substr(like, F.lit(5), F.length(like)))
    iban = _iban(F.substr(canonical, F.lit(1), F.lit(2)), F.substr(like, F.lit(5), F.length(like)))
    longer = F.concat(like, F.when(attempt > 2, F.substr(stream, F.lit(1), F.least(attempt, F.lit(40)) * 2)).otherwise(""))
    return (F.when(kind == "email", mail).when(kind == "ip", octets).when(kind == "card", F.concat(card, tail)).when(kind == "phone", F.concat(phone, tail))
            .when(kind == "ssn", F.concat(ssn, tail)).when(kind == "access_key", access).when(kind == "iban", iban)
            .when(kind == "person", _name(canonical, F.col("gender"), stream, attempt)).otherwise(longer))


def _entities(mentions: DataFrame) -> DataFrame:
    """(kind, canonical, gender): one row per entity; a person takes the gender that most mentions tell."""
    counted = mentions.groupBy("kind", "canonical").agg(
        F.sum((F.col("gender") == "f").cast("int")).alias("f"), F.sum((F.col("gender") == "m").cast("int")).alias("m"))
    gender = F.when(F.col("f") >= F.col("m"), "f").when(F.col("m") > 0, "m").when(F.col("f") > 0, "f")
    return counted.select("kind", "canonical", gender.alias("gender"))


def assign(mentions: DataFrame, key: str = PUBLIC_KEY) -> DataFrame:
    """(kind, canonical, surrogate) for distinct mentions (kind, canonical, gender): no two entities share one.

    A draw fails when it equals the draw of an entity with a smaller canonical form, an accepted surrogate or
    any entity's own form; failed entities draw again with the next attempt number. Later draws are longer, ten times
    the room with every attempt, so the rounds end however short the forms are and however many of them are taken.
    """
    entities = settle(_entities(mentions).withColumn("attempt", F.lit(0)))
    folded = lambda c: F.lower(F.col(c))
    real = entities.select("kind", folded("canonical").alias("taken")).distinct()
    done, open_ = None, entities
    while done is None or not open_.isEmpty():
        drawn = settle(open_.withColumn("surrogate", _surrogate(key)).withColumn("taken", folded("surrogate")))
        taken = real if done is None else real.unionByName(done.select("kind", folded("surrogate").alias("taken")))
        owner = drawn.groupBy("kind", "taken").agg(F.min("canonical").alias("canonical"))
        owner = owner.join(taken, ["kind", "taken"], "left_anti").withColumn("mine", F.lit(True)).drop("taken")
        judged = settle(drawn.join(owner, ["kind", "canonical"], "left"))
        won = judged.where("mine").select("kind", "canonical", "surrogate")
        done = won if done is None else settle(done.unionByName(won))
        open_ = judged.where("mine IS NULL").select("kind", "canonical", "gender", (F.col("attempt") + 1).alias("attempt"))
    return done


def _rendered(kind: Column, mention: Column, canonical: Column, surrogate: Column) -> Column:
    """The surrogate in the spelling of a mention: its separators, title, head and letter case."""
    # the digits or letters of the surrogate flow into the last places that the mention has for them; a country code stays,
    # and what the surrogate has beyond the length of its entity stands behind
    tail = F.when(kind.isin("card", "ssn", "phone"), F.substr(surrogate, F.length(canonical) + 1, F.length(surrogate))).otherwise("")
    surrogate = F.when(kind.isin("card", "ssn", "phone"), F.substr(surrogate, F.lit(1), F.length(canonical))).otherwise(surrogate)
    chars = F.split(mention, "(?<=.)(?=.)")
    slot = F.when(kind == "iban", "[A-Z0-9]").otherwise("[0-9]")
    places = F.size(F.filter(chars, lambda c: F.regexp_like(c, slot)))
    start = F.struct(F.lit("").alias("out"), (F.length(surrogate) - places + 1).alias("next"))
    flow = F.aggregate(chars, start, lambda s, c: F.when(
        F.regexp_like(c, slot), F.struct(F.concat(s["out"], F.when(s["next"] < 1, c).otherwise(
            F.substr(surrogate, s["next"], F.lit(1)))).alias("out"), (s["next"] + 1).alias("next"))
    ).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["next"].alias("next"))))["out"]
    head = lambda pattern: F.regexp_extract(mention, pattern, 0)
    bare = F.regexp_replace(mention, _PERSON_HEAD, "")
    person = F.concat(head(_PERSON_HEAD), F.when(bare == F.upper(bare), F.upper(surrogate)).otherwise(surrogate))
    email = F.when(mention == F.upper(mention), F.upper(surrogate)).otherwise(surrogate)
    return (F.when(kind.isin("card", "ssn", "phone", "iban"), F.concat(flow, tail)).when(kind == "secret", F.concat(head(_SECRET_HEAD), surrogate))
            .when(kind == "person", person).when(kind == "email", email).otherwise(surrogate))


def replacements(docs: DataFrame, text_col: str = "text", key: str = PUBLIC_KEY) -> DataFrame:
    """(mention, kind, replacement) of every distinct mention in the table."""
    found = F.explode(F.array_distinct(F.regexp_extract_all(F.col(f"`{text_col}`"), F.lit(PATTERN), F.lit(0))))
    mentions = docs.where(has_mention(F.col(f"`{text_col}`"))).select(found.alias("mention")).groupBy("mention").agg(F.count("*").alias("n"))
    mention = F.col("mention")
    mentions = mentions.withColumn("kind", _kind(mention))
    mentions = mentions.select("mention", "kind", _canonical(F.col("kind"), mention).alias("canonical"),
                               F.when(F.col("kind") == "person", _gender(mention)).alias("gender"))
    mentions = settle(mentions)
    joined = mentions.join(assign(mentions, key), ["kind", "canonical"])
    text = _rendered(F.col("kind"), mention, F.col("canonical"), F.col("surrogate"))
    return joined.select("mention", "kind", text.alias("replacement"))


def pseudonymize(docs: DataFrame, text_col: str = "text", key: str | None = None, details: str | None = None) -> DataFrame:
    """docs with every mention of personal data in text_col replaced; all other columns as they are.

    The key is an argument or the session's secret_key(); who does not have it cannot recompute a replacement.
    details names a further column array<struct<kind, replacement>> with the replacements in order of place.
    Null and empty texts stay; rows with null ids, repeated rows and any other columns are kept as they are. Texts
    without mentions are not shuffled; the others are joined to the replacements of their text by its hash.
    """
    table = settle(replacements(docs, text_col, secret_key(docs.sparkSession) if key is None else key))
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    inner = inner.withColumn("text", F.col("row").getField(text_col).cast("string"))
    has = has_mention(F.col("text"))
    with_any = inner.where(has).withColumn("hash", F.xxhash64("text"))
    mention = F.explode(F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)))
    pairs = with_any.select("hash", mention.alias("mention")).groupBy("hash", "mention").agg(F.count("*").alias("n"))
    entry = F.struct("mention", F.struct("kind", "replacement").alias("new"))
    maps = pairs.join(table, "mention").groupBy("hash").agg(F.map_from_entries(F.collect_list(entry)).alias("map"))
    joined = with_any.join(maps, "hash", "left")
    gaps, mentions = F.split("text", PATTERN, -1), F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))
    joined = joined.withColumn("news", F.transform(mentions, lambda m: F.col("map")[m]))
    joined = joined.withColumn("text", F.array_join(F.flatten(F.zip_with(
        gaps, F.col("news"), lambda gap, new: F.array(gap, F.coalesce(new["replacement"], F.lit(""))))), ""))
    none = F.array().cast("array<struct<kind:string,replacement:string>>")
    plain = inner.where(~has).select("row", "text", none.alias("news"))
    both = plain.unionByName(joined.select("row", "text", "news"))
    columns = [F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns]
    return both.select(*columns, *([F.col("news").alias(details)] if details else []))
