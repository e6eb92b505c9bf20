"""Surrogates for personal data.

Entities are found by patterns and each distinct value gets a surrogate drawn from a keyed hash: of the same type,
letter case, script, length and separators, names by gender. One value has one surrogate in all texts (coreference);
rounds of collision checks make sure that no two values of a type share one and that none is a value that occurs. The
texts then take their surrogates by doc_id. DataFrame functions only.
"""

from __future__ import annotations

import hashlib
import secrets
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from momenta.llm.common import let, saved

#: The session's setting that holds the key of the surrogates. Who knows the key can tell which surrogate a guessed value has.
#: Its name is one that Spark's redaction of settings catches.
KEY_SETTING = "spark.momenta.pii.secret"
#: Attempts in a value's own format; each one after them draws a further syllable or character, so that room outgrows the values.
OWN_FORMAT = 6

_MALE = "Mr|Herr|Herrn|Monsieur|Señor|Sr|Signor|Господин|г-н|Κύριος"
_FEMALE = "Mrs|Ms|Miss|Frau|Madame|Mme|Mademoiselle|Señora|Señorita|Sra|Signora|Госпожа|г-жа|Κυρία"
_NEUTRAL = "Dr|Prof"
#: Two letters or more with inner capitals, apostrophes and hyphens, to the end of the word; a possessive 's is not part of it.
_NAME = r"\p{Lu}(?:[\p{L}\p{M}]++|(?=['’-]\p{L}))(?:['’-](?![sS](?![\p{L}\p{M}]))[\p{L}\p{M}]++)*+(?![\p{L}\p{M}])"

#: type -> pattern. Quantifiers are possessive or bounded and starts are tied down, so time is linear in a text without blanks too.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@[\p{L}\p{N}-]{1,63}(?:\.[\p{L}\p{N}-]{1,63}){1,8}",
    "ip": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)",
    "secret": r"(?<=(?i:token|secret|password|passwd|api_key|apikey|api-key) {0,2}[=:] {0,2}[\"'])[^\"'\s]{6,}+(?=[\"'])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?!-?\d)",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .-]?\(\d{1,4}\)|\+\d{1,3}|\(\d{2,4}\))(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![.-]?\d)",
    "card": r"(?<![\d.])\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?!\d)",
    "person": rf"(?<![\p{{L}}\p{{N}}])(?:{_MALE}|{_FEMALE}|{_NEUTRAL})\.? {_NAME}(?: {_NAME})?",
}
#: What a text without any of these can't have an entity: a digit or @, a quote behind = or :, a title.
_GATES = ("[0-9@]", "[=:] {0,2}[\"']", rf"(?=[MHSFDPГгΚ])(?:{_MALE}|{_FEMALE}|{_NEUTRAL})\.? \p{{Lu}}")
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What a match alone looks like; the first that fits is its type, and what fits none is a secret.
_LOOKS = {
    "email": r"^[^@\s]+@[^@\s]+$",
    "ip": r"^(?:\d{1,3}\.){3}\d{1,3}$",
    "person": rf"^(?:{_MALE}|{_FEMALE}|{_NEUTRAL})\.? ",
    "iban": r"^[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?$",
    "ssn": r"^\d{3}-\d{2}-\d{4}$",
    "phone": r"^[+(]|^\d{3}[.-]\d{3}[.-]\d{4}$",
    "card": r"^\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}$",
}
#: Letters and digits stay in their class: pattern of a character -> what it is drawn from.
_CLASSES = (
    ("[0-9]", "0123456789"),
    ("[a-z]", "abcdefghijklmnopqrstuvwxyz"),
    ("[A-Z]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    (r"[\p{IsCyrillic}&&\p{Ll}]", "абвгдежзиклмнопрстуфхцчшэюя"),
    (r"[\p{IsCyrillic}&&\p{Lu}]", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ"),
    (r"[\p{IsGreek}&&\p{Ll}]", "αβγδεζηθικλμνξοπρστυφχψω"),
    (r"[\p{IsGreek}&&\p{Lu}]", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"),
    (r"\p{Lu}", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    (r"\p{L}", "abcdefghijklmnopqrstuvwxyz"),
    (r"\p{N}", "0123456789"),
)
#: Syllables of names by script, and endings by gender (m, f, n: none known) and of last names (l: any, lf and lm: of a
#: script whose last names tell the gender by their own ending).
_SYLLABLES = {
    "latin": ("bel dar fen gal hen jor kal lan mar nor pel ran sel tor val wen bri cla dre fio gre lio mon ner", {"m": "an en in or ric mund bert ton", "f": "a ia ina elle ette ana issa ena", "n": "y ey is el", "l": "er mann son field well sen ton berg"}),
    "cyrillic": ("бел дар фен гал ген жор кал лан мар нор пел ран сел тор вал вен бри кла дре гре лио мон нер рос", {"m": "ан ен ин ор ей ий ислав мир", "f": "а ия ина ена ана иса ета юша", "n": "и е о у", "l": "енко чук ман дзе", "lf": "ова ева ина ская", "lm": "ов ев ин ский"}),
    "greek": ("βελ δαρ φεν γαλ κεν γιορ καλ λαν μαρ νορ πελ ραν σελ τορ βαλ βεν βρι κλα δρε γρε λιο μον νερ ροσ", {"m": "ας ης ος ων", "f": "α η ω ια", "n": "ι ου", "l": "ογλου", "lf": "ιδου πουλου ακη", "lm": "ιδης πουλος ακης"}),
}
#: Last names that tell the gender.
_GENDERED = {"cyrillic": {"lf": "(?:[оеё]ва|[иы]на|[сц]кая|ая)$", "lm": "(?:[оеё]в|[иы]н|[сц]кий|[ыо]й)$"}, "greek": {"lf": "(?:ου|η|α)$", "lm": "ς$"}, "latin": {}}


def session_key(spark: SparkSession) -> str:
    """The key in KEY_SETTING; where none is set, a random one for this session, so surrogates can't be told by who hasn't seen it."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, key)
    return key


def _type(match: Column) -> Column:
    return F.coalesce(*(F.when(match.rlike(p), F.lit(t)) for t, p in _LOOKS.items()), F.lit("secret"))


def _parts(match: Column) -> Column:
    """A match as array<struct<type, value>>: type is null for what stays. A person is title, first name and last name; the others are one part."""
    part = lambda t, v: F.struct(t.cast("string").alias("type"), v.alias("value"))

    def person(w: Column) -> Column:
        gender = F.when(w[0].rlike(rf"^(?:{_MALE})\.?$"), "m").when(w[0].rlike(rf"^(?:{_FEMALE})\.?$"), "f").otherwise("n")
        title = part(F.lit(None), F.concat(w[0], F.lit(" ")))
        last = lambda v: part(F.lit("name_l"), v)
        full = F.array(title, part(F.concat(F.lit("name_"), gender), F.get(w, 1)), part(F.lit(None), F.lit(" ")), last(F.get(w, 2)))
        return F.when(F.size(w) > 2, full).otherwise(F.array(title, last(F.get(w, 1))))

    # a masked secret (no letter or digit) hides nothing
    one = lambda t: F.array(part(F.when(match.rlike(r"[\p{L}\p{N}]"), t), match))
    return let(_type(match), lambda t: F.when(t == "person", let(F.split(match, " "), person)).otherwise(one(t)))


def entities(text: Column) -> Column:
    """The parts of every match in text, in order: array<array<struct<type, value>>>. Most texts end at the gates."""
    may = reduce(lambda a, g: a | text.rlike(g), _GATES[1:], text.rlike(_GATES[0]))
    return F.transform(F.when(may, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>")), _parts)


def _byte(stream: Column, i: Column) -> Column:
    return F.conv(F.substring(stream, 2 * i + 1, F.lit(2)), 16, 10).cast("int")


#: The pads of the keyed hash: the key as text, or columns with both pads, so that no plan has it.
Key = str | tuple[Column, Column]


def _pads(key: str) -> tuple[bytes, bytes]:
    """The inner and the outer pad of HMAC-SHA256."""
    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner, outer = (bytes(b ^ pad for b in raw) for pad in (0x36, 0x5C))
    return inner, outer


def _mac(key: Key, message: Column) -> Column:
    """HMAC-SHA256 in hex."""
    inner, outer = map(F.lit, _pads(key)) if isinstance(key, str) else key
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def drawn(values: DataFrame, key: str) -> DataFrame:
    """values (type, value, attempt) with their surrogates. The key comes as a row beside them: plans, logs and the UI show names of columns, not what is in them."""
    spark = values.sparkSession
    row = F.broadcast(spark.createDataFrame([tuple(map(bytearray, _pads(key)))], "inner_ binary, outer_ binary"))
    pads = (F.col("inner_"), F.col("outer_"))
    return values.crossJoin(row).withColumn("surrogate", surrogate(F.col("type"), F.col("value"), F.col("attempt"), pads)).drop("inner_", "outer_")


def _stream(key: Key, seed: Column, size: Column) -> Column:
    """Hex digits from the keyed hash of seed, two for each of size places."""
    return F.array_join(F.transform(F.sequence(F.lit(0), (size / 32).cast("int")), lambda b: _mac(key, F.concat_ws("|", seed, b.cast("string")))), "")


def _texts(options: list[str]) -> Column:
    return F.array(*map(F.lit, options))


def _pick(options: list[str], byte: Column) -> Column:
    return F.element_at(_texts(options), byte % len(options) + 1)


def _shaped(key: Key, value: Column, seed: Column) -> Column:
    """value with each letter and digit drawn anew from its class."""
    hex_only = value.rlike("^[0-9a-f]{6,}$") & value.rlike("[a-f]")

    def chars(stream: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            b = _byte(stream, i)
            drawn = F.when(hex_only & c.rlike("[a-f]"), F.substring(F.lit("abcdef"), b % 6 + 1, F.lit(1)))
            for pattern, letters in _CLASSES:
                drawn = drawn.when(c.rlike(pattern), F.substring(F.lit(letters), b % len(letters) + 1, F.lit(1)))
            return drawn.otherwise(c)

        return F.array_join(F.transform(F.split(value, ""), one), "")

    return let(_stream(key, seed, F.length(value)), chars)


def _luhn(number: Column) -> Column:
    """number with its last digit so that the card checksum holds."""
    digits = F.reverse(F.split(F.regexp_replace(F.substring(number, F.lit(1), F.length(number) - 1), "[^0-9]", ""), ""))
    double = lambda x: F.when(x > 4, 2 * x - 9).otherwise(2 * x)
    total = F.aggregate(F.transform(digits, lambda d, i: F.when(i % 2 == 0, double(d.cast("int"))).otherwise(d.cast("int"))), F.lit(0), lambda a, x: a + x)
    return F.concat(F.substring(number, F.lit(1), F.length(number) - 1), ((10 - total % 10) % 10).cast("string"))


def _wider(key: Key, options: Column, seed: Column, attempt: Column) -> Column:
    """What a surrogate is widened by: one of options for each attempt beyond OWN_FORMAT."""
    more = F.greatest(attempt - (OWN_FORMAT - 1), F.lit(0))
    drawn = lambda stream: F.transform(F.sequence(F.lit(1), more), lambda i: F.element_at(options, _byte(stream, i) % F.size(options) + 1))
    return F.when(more > 0, F.array_join(let(_stream(key, F.concat_ws("|", seed, F.lit("wider")), more), drawn), "")).otherwise("")


def _name(key: Key, kind: Column, value: Column, seed: Column, attempt: Column) -> Column:
    """A name of the value's script and gender; one in capitals stays in capitals."""

    def drawn(stream: Column) -> Column:
        out = None
        for script, pattern in (("cyrillic", r"\p{IsCyrillic}"), ("greek", r"\p{IsGreek}"), ("latin", "")):
            syllables, endings = _SYLLABLES[script]
            pick = lambda e: _pick(endings[e].split(), _byte(stream, F.lit(3)))  # noqa: E731, B023
            last = reduce(lambda a, e: F.when(F.lower(value).rlike(e[1]), pick(e[0])).otherwise(a), _GENDERED[script].items(), pick("l"))  # noqa: B023
            end = reduce(lambda a, g: F.when(kind == f"name_{g}", pick(g)).otherwise(a), "mfn", last)  # noqa: B023
            stem = [_pick(syllables.split(), _byte(stream, F.lit(k))) for k in range(3)]
            name = F.initcap(F.concat(stem[0], stem[1], F.when(_byte(stream, F.lit(4)) % 2 == 0, stem[2]).otherwise(""), _wider(key, _texts(syllables.split()), seed, attempt), end))
            name = F.when((F.upper(value) == value) & (F.length(value) > 1), F.upper(name)).otherwise(name)
            out = F.when(value.rlike(pattern), name) if out is None else out.when(value.rlike(pattern), name)
        return out

    return let(_stream(key, seed, F.lit(8)), drawn)


def surrogate(kind: Column, value: Column, attempt: Column, key: Key) -> Column:
    """The surrogate of a value; another attempt gives another. An e-mail keeps its top-level domain, and one domain always becomes the same.

    From attempt OWN_FORMAT on it has that many more syllables (names), letters (e-mails, before the @) or digits.
    """
    seed = F.concat_ws("|", kind, value, attempt.cast("string"))
    octets = let(_stream(key, seed, F.lit(4)), lambda s: F.concat_ws(".", *((_byte(s, F.lit(k)) % 254 + 1).cast("string") for k in range(4))))
    domain = F.regexp_extract(value, r"@(.*)\.[^.]*$", 1)
    letters, digits = (_wider(key, _texts(list(c)), seed, attempt) for c in ("abcdefghijklmnopqrstuvwxyz", "0123456789"))
    mail = F.concat(_shaped(key, F.regexp_extract(value, "^([^@]*)@", 1), seed), letters, F.lit("@"), _shaped(key, domain, F.concat_ws("|", F.lit("domain"), domain)), F.regexp_extract(value, r"(\.[^.]*)$", 1))
    iban = F.concat(F.substring(value, 1, 2), _shaped(key, F.substring(value, F.lit(3), F.length(value) - 2), seed))
    code = F.regexp_extract(value, r"^(\+\d{1,3}(?=[ .(-]))", 1)
    phone = F.concat(code, _shaped(key, F.substring(value, F.length(code) + 1, F.length(value)), seed))
    name = _name(key, kind, value, seed, attempt)
    out = F.when(kind == "email", mail).when(kind == "card", _luhn(F.concat(_shaped(key, value, seed), digits))).when(kind.startswith("name_"), name)
    own = F.when(kind == "ip", octets).when(kind == "iban", iban).when(kind == "phone", phone).otherwise(_shaped(key, value, seed))
    return out.otherwise(F.concat(own, digits))


def assign(values: DataFrame, key: str | None = None) -> DataFrame:
    """(type, value, surrogate) for the distinct (type, value): no surrogate twice in a type, none that is a value of the type; all kinds of names are one type for that.

    Each round hashes anew the values that collide: of values with one surrogate those that had it before keep it, else
    the smallest does. Rounds work on all values by aggregation; they end as collisions are rare or, where a format
    has hardly more room than values, as the attempts from OWN_FORMAT on widen it by a factor of ten or more each.
    """
    key = key or session_key(values.sparkSession)
    space = F.regexp_replace("type", "^name_.*", "name").alias("space")
    draw = lambda df: drawn(df, key)
    state = saved(draw(values.select("type", "value").withColumn("attempt", F.lit(0))), "surrogates")
    taken = values.select(space, F.col("value").alias("surrogate"), F.lit(None).cast("struct<attempt:int,value:string,type:string>").alias("who"))
    while True:
        claims = state.select(space, "surrogate", F.struct("attempt", "value", "type").alias("who")).unionByName(taken)
        groups = claims.groupBy("space", "surrogate").agg(F.count("*").alias("n"), F.count("who").alias("m"), F.min("who").alias("keeps"))
        clash = groups.where("n > 1 and m > 0").select("space", "surrogate", F.when(F.col("n") == F.col("m"), F.col("keeps")).alias("keeps"))
        lost = state.withColumn("space", space).join(clash, ["space", "surrogate"]).where(~F.struct("attempt", "value", "type").eqNullSafe(F.col("keeps"))).select("type", "value", (F.col("attempt") + 1).alias("attempt"))
        lost = saved(lost, "collisions")
        if lost.isEmpty():
            return state.select("type", "value", "surrogate")
        state = saved(state.join(lost, ["type", "value"], "left_anti").unionByName(draw(lost)), "surrogates")


def pseudonymize(docs: DataFrame, key: str | None = None) -> DataFrame:
    """(doc_id, text, n_entities, types) of every row of docs (doc_id, text; other columns are not read).

    text has every entity replaced, n_entities counts them (a name's first and last part are two), types are the
    distinct types, sorted. A name found behind a title is replaced (and counted) wherever it is a word of that text. A
    null text stays null; texts without entities stay as they are. One value has one surrogate in the whole table, and
    the same key gives the same surrogates for the same table; without one it is session_key(). Rows that repeat a
    doc_id each come back. Rows without doc_id are replaced like the others. An empty table gives none.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # a row without doc_id is known by its text
    rows = rows.withColumn("row_key", F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.sha2("text", 256))))
    found = rows.select("row_key", F.explode(F.array_distinct(F.flatten(entities(F.col("text"))))).alias("e")).select("row_key", "e.*").where("type is not null")
    found = saved(found, "entities")
    # one gender for a first name, whatever its titles: f, m or, if no title tells, n
    first = found.where("type in ('name_f', 'name_m', 'name_n')").groupBy("value").agg(F.min("type").alias("gender"))
    kinds = found.select("type", "value").distinct().join(first, "value", "left")
    kinds = kinds.select("type", "value", F.when(F.col("type") == "name_l", "name_l").otherwise(F.when(F.col("type").startswith("name_"), F.col("gender")).otherwise(F.col("type"))).alias("as"))
    kinds = saved(kinds, "values")
    found_for = assign(kinds.select(F.col("as").alias("type"), "value").distinct(), key).withColumnRenamed("type", "as")
    found_for = kinds.join(found_for, ["as", "value"]).drop("as")
    name = F.concat_ws(":", "type", "value")
    maps = found.distinct().join(found_for, ["type", "value"]).groupBy("row_key").agg(F.map_from_entries(F.collect_list(F.struct(name, F.col("surrogate")))).alias("to"))
    out = rows.join(maps.withColumnRenamed("row_key", "map_key"), rows["row_key"] == F.col("map_key"), "left")

    # mentions without a title of the names found in the text: last names before first names, longer ones first
    names = F.filter(F.map_keys("to"), lambda k: k.startswith("name_"))
    values = F.reverse(F.array_sort(F.array_distinct(F.transform(names, lambda k: F.substring(k, F.lit(8), F.length(k))))))
    mention = F.concat(F.lit(r"(?<![\p{L}\p{M}\p{N}])(?:"), F.array_join(values, "|"), F.lit(r")(?![\p{L}\p{M}\p{N}])"))

    def named(v: Column) -> Column:
        return F.coalesce(*(F.try_element_at(F.col("to"), F.concat(F.lit(f"name_{g}:"), v)) for g in "lfmn"))

    def gap(g: Column) -> Column:
        new = F.transform(F.regexp_extract_all(g, F.col("mention"), F.lit(0)), named)
        return F.array_join(F.flatten(F.zip_with(F.split(g, F.col("mention"), -1), new, lambda x, y: F.array(x, F.coalesce(y, F.lit(""))))), "")

    def replaced(e: Column) -> Column:
        one = lambda p: F.when(p["type"].isNull(), p["value"]).otherwise(F.try_element_at(F.col("to"), F.concat_ws(":", p["type"], p["value"])))
        new = F.transform(e, lambda m: F.array_join(F.transform(m, one), ""))
        gaps = F.col("gaps")
        gaps = F.when(F.col("mention").isNull(), gaps).otherwise(F.transform(gaps, gap))
        return F.array_join(F.flatten(F.zip_with(gaps, new, lambda g, s: F.array(g, F.coalesce(s, F.lit(""))))), "")

    out = out.withColumns({"mention": F.when(F.size(names) > 0, mention), "gaps": F.when(F.col("to").isNotNull(), F.split("text", ANY, -1))})
    mentions = F.aggregate(F.transform("gaps", lambda g: F.size(F.regexp_extract_all(g, F.col("mention"), F.lit(0)))), F.lit(0), lambda a, n: a + n)
    out = out.withColumn("e", F.when(F.col("to").isNotNull(), entities(F.col("text"))))
    kinds = F.filter(F.transform(F.flatten("e"), lambda p: p["type"]), lambda t: t.isNotNull())
    return out.select(
        "doc_id",
        F.when(F.col("to").isNull(), F.col("text")).otherwise(replaced(F.col("e"))).alias("text"),
        (F.coalesce(F.size(kinds), F.lit(0)) + F.when(F.col("mention").isNotNull(), mentions).otherwise(0)).cast("long").alias("n_entities"),
        F.coalesce(F.array_sort(F.array_distinct(kinds)), F.array().cast("array<string>")).alias("types"),
    )
