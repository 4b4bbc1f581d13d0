"""Personal data replaced by surrogates (operator 9), in DataFrame operations only.

E-mail addresses, IPv4 addresses, payment cards, social security numbers,
phone numbers and the names after a title are found by one Java regular
expression. A name found so is then looked for among all capitalised words of
the same text, titled or not. Every distinct entity (its canonical form, so spellings of one
number or address are one entity) gets one surrogate for the whole corpus,
derived from a keyed SHA-512: an address of the same shape, a number in the
same format (cards keep their network and a right check digit, private IPv4
ranges stay private), a given name of the same gender and script, a surname of
the same script. So mentions of one entity stay mentions of one.

Collisions are checked over all entities: a surrogate that another entity
holds, or that occurs as a real entity, is derived again with the next
attempt. Texts without a match are passed through unshuffled; the others are
taken apart once per distinct text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxpop.llm.common import written
from voxpop.session import drop_scratch

# a domain has at most 253 characters, so no more than 127 labels; without that bound a long row of labels would use up the stack
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){0,125}\.[A-Za-z]{2,}"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IPV4 = rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])"
_IIN = r"(?:[3-6][0-9]{3}|222[1-9]|22[3-9][0-9]|2[3-6][0-9]{2}|27[01][0-9]|2720)"
# 16 digits, 15 (34, 37) and 14 (300 to 305, 36, 38)
CARD = (
    rf"(?<![0-9])(?:{_IIN}(?:[0-9]{{12}}|(?: [0-9]{{4}}){{3}}|(?:-[0-9]{{4}}){{3}})"
    r"|3[47][0-9]{2}(?:[0-9]{11}| [0-9]{6} [0-9]{5}|-[0-9]{6}-[0-9]{5})"
    r"|3(?:0[0-5]|[68][0-9])[0-9](?:[0-9]{10}| [0-9]{6} [0-9]{4}|-[0-9]{6}-[0-9]{4}))(?![0-9])"
)
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
PHONE = r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|(?<![0-9]{2}[.-])[0-9]{3}([ .-])[0-9]{3}\1[0-9]{4}(?![.-][0-9]))(?![0-9])"
# Titles that tell a gender, and titles that don't.
FEMALE = "Mrs|Ms|Miss|Frau|Mme|Madame|Señora|Sra|г-жа"
MALE = "Mr|Herr|Monsieur|Señor|Sr|г-н"
NEUTRAL = "Dr|Prof"
_TITLE = rf"(?<![\p{{L}}0-9])(?:{FEMALE}|{MALE}|{NEUTRAL})\.?"
# inner capitals, and parts (written out, for looking behind) behind an apostrophe or a hyphen that start with a capital; no title
_L = r"[\p{L}\p{M}]"
_PART = rf"(?:['’]\p{{Lu}}{_L}{{0,20}}|-\p{{Lu}}{_L}{{0,20}})"
_WORD = rf"(?!(?:{FEMALE}|{MALE}|{NEUTRAL})(?!{_L}))\p{{Lu}}(?:{_L}{{1,20}}{_PART}?{_PART}?|{_PART}{_PART}?)(?!{_L})"
# the capital is looked at first: looking behind at every place would be slow
NAME = rf"(?=\p{{Lu}})(?<= )(?:(?<={_TITLE} )|(?<={_TITLE} {_WORD} )){_WORD}"
PATTERN = "|".join((EMAIL, IPV4, CARD, SSN, PHONE, NAME))
#: Any capitalised word, which may be a further mention of a name.
FURTHER = rf"(?=\p{{Lu}})(?<![\p{{L}}\p{{M}}\p{{N}}]){_WORD}"
#: From this attempt on, stand-ins of private IPv4 addresses in smaller ranges come from 10/8.
SPILL = 8
ATTEMPTS = 40
#: Syllables of surrogate names: consonants, vowels, and the endings of female, male and other names.
_SOUNDS = {
    "latin": ("bcdfghklmnprstvz", "aeiou", "a", "n", "er"),
    "cyrillic": ("бвгдзклмнпрстфхж", "аеиоу", "а", "н", "ов"),
    "greek": ("βγδζθκλμνπρστφχξ", "αειου", "α", "ν", "ης"),
}


def _kind(mention: Column, before: Column, after: Column) -> Column:
    """The type of a mention; a name is told by the text before it, and is a given name if another name follows."""
    title = lambda t: before.rlike(rf"(?<![\p{{L}}0-9])(?:{t})\.? $")
    given = title(f"{FEMALE}|{MALE}|{NEUTRAL}") & (after == " ")
    return (
        F.when(mention.contains("@"), "email")
        .when(mention.rlike(f"^{IPV4}$"), "ipv4")
        .when(mention.rlike(f"^{CARD}$"), "card")
        .when(mention.rlike(f"^{SSN}$"), "ssn")
        .when(mention.rlike("[0-9]"), "phone")
        .when(given & title(FEMALE), "given_f")
        .when(given & title(MALE), "given_m")
        .when(given, "given_x")
        .otherwise("surname")
    )


def _canonical(kind: Column, mention: Column) -> Column:
    digits = F.regexp_replace(mention, "[^0-9+]", "")
    return F.when(kind.isin("card", "ssn", "phone"), digits).when(kind == "ipv4", mention).otherwise(F.lower(mention))


def _surrogate(kind: Column, canon: Column, attempt: int, key: str) -> Column:
    """The canonical form of the stand-in for an entity."""
    h = F.sha2(F.concat_ws("\u0001", F.lit(key), kind, canon, F.lit(str(attempt))).cast("binary"), 512)
    byte = lambda i: F.conv(h.substr(F.pmod(i, F.lit(64)) * 2 + 1, F.lit(2)), 16, 10).cast("int")
    pick = lambda letters, i: F.lit(letters).substr(F.pmod(byte(i), F.lit(len(letters))) + 1, F.lit(1))

    def each(text: Column) -> Column:
        """Letters by letters, digits by digits, all else as it is."""
        places = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text))).otherwise(F.array().cast("array<int>"))
        char = lambda i: text.substr(i, F.lit(1))
        mapped = F.transform(
            places,
            lambda i: F.when(char(i).rlike("[a-z]"), pick("abcdefghijklmnopqrstuvwxyz", i))
            .when(char(i).rlike("[0-9]"), pick("0123456789", i))
            .otherwise(char(i)),
        )
        return F.array_join(mapped, "")

    def first(low: int, n: int) -> Column:
        return (byte(F.lit(0)) % n + low).cast("string")

    tail = F.regexp_extract(canon, r"\.[a-z]+$", 0)
    more = each(F.lit("z" * max(0, attempt - 3)))  # short addresses get longer before the space runs out
    email = F.concat(more, each(canon.substr(F.lit(1), F.length(canon) - F.length(tail))), tail)
    octet = lambda i: byte(F.lit(i)).cast("string")
    inner = F.regexp_extract(canon, r"^(10\.|127\.|192\.168\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|169\.254\.)", 1)
    public = F.concat((byte(F.lit(0)) % 89 + 11).cast("string"), F.lit("."))
    if attempt >= SPILL:
        inner = F.when(inner.rlike(r"^[0-9]+\.[0-9]+\."), "10.").otherwise(inner)
    head = F.when(inner != "", inner).otherwise(public)
    dots = F.length(head) - F.length(F.regexp_replace(head, r"\.", ""))
    ipv4 = F.when(dots == 1, F.concat(head, octet(1), F.lit("."), octet(2), F.lit("."), octet(3))).otherwise(
        F.concat(head, octet(1), F.lit("."), octet(2))
    )
    kept = F.when(F.length(canon) == 14, 3).when(F.length(canon) == 15, 2).when(canon.startswith("2"), 4).otherwise(1)
    body = F.concat(canon.substr(F.lit(1), kept), each(canon.substr(kept + 1, F.length(canon) - kept - 1)))
    doubled = F.transform(
        F.sequence(F.lit(1), F.length(body)),
        lambda i: F.when(
            F.pmod(F.length(body) - i, F.lit(2)) == 0,
            F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), body.substr(i, F.lit(1)).cast("int") + 1),
        ).otherwise(body.substr(i, F.lit(1)).cast("int")),
    )
    check = F.pmod(-F.aggregate(doubled, F.lit(0), lambda a, x: a + x), F.lit(10))
    card = F.concat(body, check.cast("string"))
    code = F.regexp_extract(canon, r"^(\+(?:1|7|[0-9]{2}))?", 0)
    phone = F.concat(code, first(2, 8), each(canon.substr(F.length(code) + 2, F.length(canon))))
    ssn = F.concat(first(1, 8), each(canon.substr(F.lit(2), F.length(canon))))

    def name(sounds: tuple[str, ...]) -> Column:
        consonants, vowels, female, male, other = sounds
        n = 2 + max(0, attempt - 3)
        syllables = [x for k in range(n) for x in (pick(consonants, F.lit(2 * k)), pick(vowels, F.lit(2 * k + 1)))]
        last = pick(consonants, F.lit(2 * n))
        ending = F.when(kind == "given_f", female).when(kind == "given_m", F.lit(vowels[3] + male)).otherwise(other)
        return F.concat(*syllables, last, ending)

    named = F.when(canon.rlike(r"\p{IsCyrillic}"), name(_SOUNDS["cyrillic"])).when(canon.rlike(r"\p{IsGreek}"), name(_SOUNDS["greek"]))
    return (
        F.when(kind == "email", email).when(kind == "ipv4", ipv4).when(kind == "card", card)
        .when(kind == "ssn", ssn).when(kind == "phone", phone).otherwise(named.otherwise(name(_SOUNDS["latin"])))
    )


def _written_like(kind: Column, mention: Column, stand_in: Column) -> Column:
    """A canonical stand-in in the format of the mention."""
    places = F.sequence(F.lit(1), F.length(mention))
    start = F.struct(F.when(stand_in.startswith("+"), 2).otherwise(1).alias("at"), F.lit("").alias("out"))

    def step(acc, i):
        char = mention.substr(i, F.lit(1))
        digit = char.rlike("[0-9]")
        return F.struct(
            F.when(digit, acc["at"] + 1).otherwise(acc["at"]).alias("at"),
            F.concat(acc["out"], F.when(digit, stand_in.substr(acc["at"], F.lit(1))).otherwise(char)).alias("out"),
        )

    numbers = F.aggregate(places, start, step, lambda acc: acc["out"])
    capital = F.when(mention == F.upper(mention), F.upper(stand_in)).otherwise(F.initcap(stand_in))
    return (
        F.when(kind.isin("card", "ssn", "phone"), numbers)
        .when(kind == "ipv4", stand_in)
        .when(kind == "email", F.when(mention == F.upper(mention), F.upper(stand_in)).otherwise(stand_in))
        .otherwise(capital)
    )


def assign(entities: DataFrame, key: str) -> DataFrame:
    """``entities(kind, canon)``, distinct, with one ``stand_in`` each: distinct within a kind, and never itself an entity.

    Each attempt is one written table. After ``ATTEMPTS`` attempts the space of
    a kind counts as full, which is an error.
    """
    spark = entities.sparkSession
    entities, _ = written(entities, "entities")
    pending, done = entities, None
    for attempt in range(ATTEMPTS):
        tried = pending.withColumn("stand_in", _surrogate(F.col("kind"), F.col("canon"), attempt, key))
        won = tried.groupBy("kind", "stand_in").agg(F.min("canon").alias("canon"))
        won = won.join(entities.select("kind", F.col("canon").alias("stand_in")), ["kind", "stand_in"], "left_anti")
        if done is not None:
            won = won.join(done.select("kind", "stand_in"), ["kind", "stand_in"], "left_anti")
        won, _ = written(won.select("kind", "canon", "stand_in"), "stand-ins")
        done = won if done is None else done.unionByName(won)
        rest, path = written(pending.join(won, ["kind", "canon"], "left_anti"), "pending")
        pending = rest
        if pending.isEmpty():
            drop_scratch(spark, path)
            return done
    raise RuntimeError("too many entities for the space of their surrogates")


def replace_private(docs: DataFrame, text_col: str = "text", *, key: str = "voxpop", count_col: str = "n_private") -> DataFrame:
    """``docs`` with every entity in ``text_col`` replaced, and the number of replacements in ``count_col`` (long).

    ``key`` is the secret that the surrogates depend on. Null and empty texts
    stay; equal texts become equal texts; repeated rows stay, as do rows with a
    null id. Other columns are carried along, an old ``count_col`` is replaced.
    An empty table gives an empty result.
    """
    text = F.col(text_col)
    has = F.coalesce(text.rlike("[@0-9]|" + _TITLE) & text.rlike(PATTERN), F.lit(False))
    clean = docs.where(~has).withColumn(count_col, F.lit(0).cast("long"))
    # a row travels as one value: its columns may have any names
    hits = docs.where(has).select(F.struct(*docs.columns).alias("row"), F.sha2(text.cast("binary"), 256).alias("_blob"))
    hits, _ = written(hits, "private")

    found = hits.select("_blob", F.col("row")[text_col].alias("t")).dropDuplicates(["_blob"])
    # capitalised words are looked at only in texts with a titled name
    cut = lambda p, named: found.where(F.col("t").rlike(NAME) == named).select(
        "_blob", F.regexp_extract_all("t", F.lit(p), 0).alias("mentions"), F.split("t", p, -1).alias("gaps")
    )
    found = cut(f"{PATTERN}|{FURTHER}", True).unionByName(cut(PATTERN, False))
    parts = found.select("_blob", "gaps", "mentions", F.posexplode("mentions").alias("at", "mention"))
    before = F.when(F.col("at") > 0, F.col("gaps")[F.col("at") - 1])
    parts = parts.select(
        "_blob", "at", "mention", F.col("gaps")[F.col("at")].alias("gap"), F.col("gaps")[F.col("at") + 1].alias("after"),
        (F.col("gaps")[F.col("at")] == " ").alias("joined"), F.coalesce(before.rlike(f"{_TITLE} $"), F.lit(False)).alias("second"),
    )
    parts = parts.withColumn("kind", _kind(F.col("mention"), F.col("gap"), F.col("after")))
    titled = F.col("gap").rlike(f"{_TITLE} $") | (F.col("joined") & F.col("second"))
    further = F.when((F.col("kind") == "surname") & ~titled, "further").otherwise(F.col("kind"))
    parts = parts.withColumn("kind", further).drop("joined", "second")
    parts, _ = written(parts.withColumn("canon", _canonical(F.col("kind"), F.col("mention"))), "mentions")
    names = parts.where(F.col("kind").isin("given_f", "given_m", "given_x", "surname"))
    names = names.groupBy("_blob", "canon").agg(F.min("kind").alias("_kind"))
    resolved = parts.where("kind = 'further'").join(names, ["_blob", "canon"], "left")
    resolved = resolved.withColumn("kind", F.coalesce("_kind", "kind")).select(*parts.columns)
    words = resolved.where("kind = 'further'").select("_blob", "at", "after", F.concat("gap", "mention").alias("new"), F.lit(0).alias("hit"))
    parts = parts.where("kind <> 'further'").unionByName(resolved.where("kind <> 'further'"))

    stand_ins = assign(parts.select("kind", "canon").distinct(), key)
    new = parts.join(stand_ins, ["kind", "canon"])
    new = new.withColumn("new", F.concat("gap", _written_like(F.col("kind"), F.col("mention"), F.col("stand_in"))))
    new = new.select("_blob", "at", "after", "new", F.lit(1).alias("hit")).unionByName(words)
    pieces = F.array_sort(F.collect_list(F.struct("at", "new", "after")))  # of one text
    whole = new.groupBy("_blob").agg(pieces.alias("p"), F.sum("hit").alias("_n"))
    whole = whole.select(
        "_blob",
        F.concat(F.array_join(F.col("p.new"), ""), F.element_at("p", -1)["after"]).alias("_new"),
        F.col("_n").cast("long").alias("_n"),
    )
    value = {text_col: F.col("_new"), count_col: F.col("_n")}
    done = hits.join(whole, "_blob").select(*[value.get(c, F.col("row")[c]).alias(c) for c in clean.columns])
    return clean.unionByName(done)
