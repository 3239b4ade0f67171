"""Surrogates for personal data, in DataFrame functions only.

Patterns find entities. Each distinct entity (its kind and canonical form: case,
separators and honorifics aside) gets a replacement made from a keyed hash: the same
kind, script, length and layout, given names of the same gender. Replacements are
checked in rounds over all entities: no two share one, and none equals an entity that
occurs. So what was distinct stays distinct, and the same entity gets the same
replacement in every document.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import stash, table, unstash

# Given names by gender and script, honorifics, and syllables for made-up names.
MALE = "James John Robert Michael William David Richard Thomas Charles Daniel Matthew Anthony Peter Hans Klaus Jürgen Wolfgang Pierre Jean Luc Michel André José Juan Carlos Luis Miguel Javier Ivan Sergei Dmitri Nikolai Andrei Alexander Mohammed Ahmed Ali Kofi".split()
FEMALE = "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Emma Anna Julia Petra Ursula Monika Marie Claire Sophie Camille Isabelle María Carmen Ana Lucía Elena Laura Angela Olga Natalia Tatiana Irina Svetlana Fatima Aisha Ingrid Helga".split()
MALE_CYRILLIC = "Иван Сергей Алексей Дмитрий Николай Андрей Михаил Павел".split()
FEMALE_CYRILLIC = "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана".split()
MALE_TITLES = "Mr Mister Herr Monsieur Señor Sr Sir".split()
FEMALE_TITLES = "Mrs Ms Miss Frau Madame Mme Mademoiselle Señora Sra Lady".split()
OTHER_TITLES = "Dr Prof Doctor Professor".split()
SYLLABLES = "ba be bo da de do fa fe ga ge ha he ka ke ko la le lo ma me mo na ne no ra re ro sa se ta te to va".split()
SYLLABLES_CYRILLIC = "ба бе бо да де до га ка ке ко ла ле ло ма ме мо на не но ра ре ро са се та те то ва".split()

SYLLABLES_GREEK = "βα βε δα δε κα κε κο λα λε λο μα με μο να νε νο ρα ρε ρο σα σε τα τε το".split()
#: Letters by which those of a script are replaced.
ALPHABETS = {"Cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "Greek": "αβγδεζηθικλμνξοπρστυφχψω", "Arabic": "ابتثجحخدذرزسشصضطظعغفقكلمنهوي", "Han": "天地人山水火木金土日月星雨雪風花草石田林", "Hiragana": "あいうえおかきくけこさしすせそ", "Katakana": "アイウエオカキクケコサシスセソ", "Hangul": "가나다라마바사아자차카타파하"}

#: A word of a name: O'Neill, McDonald and Smith-Jones are one, a possessive ending is none of it.
_WORD = r"(?:\p{Lu}['’])?\p{Lu}\p{Ll}+(?:\p{Lu}\p{Ll}+)?"
_NAME = rf"{_WORD}(?:-{_WORD})?"
_CAPITALS = r"(?:\p{Lu}['’])?\p{Lu}{2,}(?:-\p{Lu}{2,})?"
_TITLE = "|".join([*MALE_TITLES, *FEMALE_TITLES, *OTHER_TITLES])
_TITLE_CAPITALS = "|".join(t.upper() for t in [*MALE_TITLES, *FEMALE_TITLES, *OTHER_TITLES])
_GIVEN = "|".join([*MALE, *FEMALE, *MALE_CYRILLIC, *FEMALE_CYRILLIC])
_START, _END = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_GROUPS = r"(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})"
#: IPv6 with a run of zeros left out, but for :: alone.
_SHORT_IPV6 = rf"(?<![\p{{L}}\p{{N}}:])(?=:{{0,2}}[0-9A-Fa-f])(?=(?:[0-9A-Fa-f]{{0,4}}:){{2,8}}[0-9A-Fa-f]{{0,4}}(?![\p{{L}}\p{{N}}:])){_GROUPS}?::{_GROUPS}?(?![\p{{L}}\p{{N}}:])"

# What keys of some services begin with.
_KEY_PREFIX = r"(?:AKIA|ASIA)(?=[0-9A-Z]{16})|gh[pousr]_(?=[A-Za-z0-9]{36})|sk-(?=[A-Za-z0-9_\-]{20})|xox[abprs]-(?=[A-Za-z0-9\-]{10})|AIza(?=[0-9A-Za-z_\-]{35})"

#: Setting of the session that holds the key.
KEY_SETTING = "spark.sparkloom.surrogateKey"

#: In order of precedence at one place.
PATTERNS = {
    "secret": r"""(?<=(?i:token|secret|password|passwd|api[_-]?key|access[_-]?key)["']?\s{0,2}[=:]\s{0,2}["']?)[A-Za-z0-9+/_\-]{12,}|""" + _START + rf"(?:{_KEY_PREFIX})[A-Za-z0-9_\-]+|" + _START + r"(?=[0-9A-Fa-f]*[0-9])(?:[0-9a-f]{32,}|[0-9A-F]{32,})" + _END,
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}][\p{L}\p{N}._%+\-]*+@[\p{L}\p{N}\-]+(?:\.[\p{L}\p{N}\-]+)*\.\p{L}{2,}" + _END,
    "ip": r"(?<![\p{L}\p{N}.])(?<!(?i:version |release |revision |ver\. |firmware ))" + _OCTET + r"(?:\." + _OCTET + r"){3}(?![\p{L}\p{N}]|\.\d)|(?<![\p{L}\p{N}:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\p{L}\p{N}:])|" + _SHORT_IPV6,
    "iban": _START + r"(?:[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?|[a-z]{2}\d{2}(?: ?\d{4}){3,7}(?: ?\d{1,3})?)" + _END,
    "phone": r"(?<![\p{L}\p{N}+])\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .\-]?\d{2,4}){2,4}" + _END + r"|(?<![\p{L}\p{N}(])(?:\(\d{3}\) ?|\d{3}[.\-])\d{3}[.\-]\d{4}" + _END + r"|(?<![\p{L}\p{N}(.,:+\-])(?:\(0\d{1,4}\) ?\d{3,4}[ .\-]?\d{3,5}|0\d{2,4}[ /\-]\d{5,8})(?![\p{L}\p{N}]|[.,\-]\d)",
    "ssn": r"(?<![\p{L}\p{N}\-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}\-])",
    "card": _START + r"\d(?:[ \-]?\d){12,18}" + _END,
    "name": _START + rf"(?:(?:{_TITLE})\.? {_NAME}(?: {_NAME}){{0,2}}|(?:{_TITLE_CAPITALS})\.? {_CAPITALS}(?: {_CAPITALS}){{0,2}}|(?:{_GIVEN}) {_NAME})" + _END,
}
ALL = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What every entity has: a digit, an at sign, two colons about hexadecimal digits, a word for a secret in any case, a title or a given name. Rows without one are not searched further.
HINT = rf"[0-9@]|\p{{N}}|:[0-9A-Fa-f]{{0,4}}:|(?i:token|secret|passw|key)|{_KEY_PREFIX}|{_START}(?:{_TITLE}|{_TITLE_CAPITALS}|{_GIVEN})\.? \p{{Lu}}"

#: Secrets in which case means nothing.
_HEX = r"^(?:[0-9a-f]{32,}|[0-9A-F]{32,})$"
_DIGITS = ("phone", "ssn", "card")


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body).getItem(0)


def _kind(surface: Column) -> Column:
    """The first pattern that matches all of a match. Secrets may be known by what stands before them only: the rest."""
    out = None
    for kind, pattern in PATTERNS.items():
        if kind != "secret":
            whole = surface.rlike(f"^(?:{pattern})$")
            out = F.when(whole, kind) if out is None else out.when(whole, kind)
    return F.when(surface.rlike(_HEX), "secret").otherwise(out.otherwise("secret"))


def _name_words(surface: Column) -> Column:
    """The words of a name, without an honorific."""
    return F.split(F.regexp_replace(surface, rf"^(?:{_TITLE}|{_TITLE_CAPITALS})\.? ", ""), " ")


def _gender(surface: Column) -> Column:
    title = F.initcap(F.regexp_extract(surface, rf"^({_TITLE}|{_TITLE_CAPITALS})\.? ", 1))
    given = F.initcap(_name_words(surface).getItem(0))
    return (
        F.when(title.isin(MALE_TITLES), "m").when(title.isin(FEMALE_TITLES), "f").when(given.isin([*MALE, *MALE_CYRILLIC]), "m").when(given.isin([*FEMALE, *FEMALE_CYRILLIC]), "f").otherwise("n")
    )


def parts(surface: Column) -> Column:
    """The entities of a match: an array of (kind, value, gender). A name gives its family name and each given name, an address of mail itself and its domain.

    Digits that look like a card but have a wrong check digit are of kind ``number``: no entity.
    """
    kind = _kind(surface)
    entity = lambda k, v, g=F.lit("n"): F.struct(k.alias("kind"), v.alias("value"), g.alias("gender"))
    words, digits = _name_words(surface), F.regexp_replace(surface, r"[^0-9]", "")
    gender = _gender(surface)
    names = F.transform(words, lambda w, i: F.when(i == F.size(words) - 1, entity(F.lit("family"), F.lower(w))).otherwise(entity(F.lit("given"), F.lower(w), gender)))
    mail = F.array(entity(F.lit("mail"), F.lower(surface)), entity(F.lit("domain"), F.regexp_extract(F.lower(surface), "@(.*)$", 1)))
    # The country code of a telephone number is kept, so it is marked off.
    code = F.regexp_extract(surface, r"^\+(\d{1,3})[ .\-(]", 1)
    phone = F.when(code == "", digits).otherwise(F.concat(code, F.lit("|"), F.substring(digits, F.length(code) + 1, F.length(digits))))
    plain = (
        F.when(kind == "phone", phone).when(kind.isin(*_DIGITS), digits).when(kind == "iban", F.upper(F.regexp_replace(surface, " ", ""))).when((kind == "secret") & ~surface.rlike(_HEX), surface).otherwise(F.lower(surface))
    )
    checked = F.when((kind == "card") & (_luhn_sum(digits) % 10 != 0), F.lit("number")).otherwise(kind)
    return F.when(kind == "name", names).when(kind == "email", mail).otherwise(F.array(entity(checked, plain)))


def _stream(key: str, kind: Column, value: Column, attempt: Column, times: int = 1) -> Column:
    """Hexadecimal digits from a keyed hash, 64 each time."""
    seed = F.concat_ws("\x1f", F.lit(key), kind, value, attempt.cast("string"))
    return F.concat(*[F.sha2(F.concat(seed, F.lit(f"\x1f{i}"), F.lit(f"\x1f{key}")), 256) for i in range(times)])


def _nibble(stream: Column, at: Column) -> Column:
    """Two hexadecimal digits as a number from 0 to 255."""
    return F.conv(F.substring(stream, at * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(values: list[str], number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number % len(values)) + 1)


def _by_class(value: Column, stream: Column) -> Column:
    """Each letter and digit replaced by another of its class; the rest stays. Longer values use the stream again, with other steps."""

    def one(c: Column, i: Column) -> Column:
        n = (_nibble(stream, i % 96) + F.floor(i / 96) * 7).cast("int")
        letter = lambda first, size: F.char(F.lit(ord(first)) + n % size)
        out = F.when(c.rlike("[0-9]"), letter("0", 10)).when(c.rlike("[a-z]"), letter("a", 26)).when(c.rlike("[A-Z]"), letter("A", 26))
        for script, letters in ALPHABETS.items():
            out = out.when(c.rlike(rf"\p{{Is{script}}}"), F.substring(F.lit(letters), n % len(letters) + 1, F.lit(1)))
        return out.when(c.rlike(r"\p{L}"), letter("a", 26)).otherwise(c)

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _hexes(value: Column, stream: Column) -> Column:
    return F.array_join(F.transform(F.split(value, ""), lambda c, i: F.substring(F.lit("0123456789abcdef"), _nibble(stream, i % 96) % 16 + 1, F.lit(1))), "")


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of a digit string."""
    n = F.length(digits)
    doubled = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    return F.aggregate(F.transform(F.split(digits, ""), lambda c, i: F.when((n - i) % 2 == 0, doubled(c.cast("int"))).otherwise(c.cast("int"))), F.lit(0), lambda a, x: a + x)


def _card(value: Column, stream: Column) -> Column:
    """As many digits; the check digit is right if it was."""
    body = F.concat(F.substring(_by_class(value, stream), F.lit(1), F.length(value) - 1), F.lit("0"))
    check = F.concat(F.substring(body, F.lit(1), F.length(value) - 1), ((10 - _luhn_sum(body) % 10) % 10).cast("string"))
    return F.when(_luhn_sum(value) % 10 == 0, check).otherwise(_by_class(value, stream))


def _octets(value: Column, stream: Column, attempt: Column) -> Column:
    """Numbers of as many digits; after 16 attempts of any, and IPv6 in full."""

    def one(o: Column, i: Column) -> Column:
        n = _nibble(stream, i)
        return F.when(attempt >= 16, n % 254 + 1).when(F.length(o) == 1, n % 9 + 1).when(F.length(o) == 2, n % 90 + 10).otherwise(n % 155 + 100).cast("string")

    groups = F.array_join(F.transform(F.split(value, ":"), lambda g, i: F.substring(stream, i * 4 + 1, F.length(g))), ":")
    full = F.concat_ws(":", *[F.substring(stream, i * 4 + 1, 4) for i in range(8)])
    return F.when(value.contains(":"), F.when(attempt >= 16, full).otherwise(groups)).otherwise(F.array_join(F.transform(F.split(value, r"\."), one), "."))


def _syllables(value: Column, stream: Column, attempt: Column, first: int) -> Column:
    """A made-up name of about the same length, in the same script; longer after some attempts."""
    count = F.greatest(F.lit(2), F.least(F.lit(10), F.floor((F.length(value) + 1) / 2).cast("int"))) + F.floor(attempt / 6).cast("int")
    made = lambda values: F.array_join(F.transform(F.sequence(F.lit(0), count - 1), lambda i: _pick(values, _nibble(stream, i + first))), "")
    return F.when(value.rlike(r"\p{IsCyrillic}"), made(SYLLABLES_CYRILLIC)).when(value.rlike(r"\p{IsGreek}"), made(SYLLABLES_GREEK)).otherwise(made(SYLLABLES))


def _given(value: Column, kind: Column, stream: Column, attempt: Column) -> Column:
    """A given name of the gender; after a few attempts with a second one, then made up with the gender's ending."""
    n = _nibble(stream, F.lit(0)) * 256 + _nibble(stream, F.lit(1))
    m = _nibble(stream, F.lit(2))
    cyrillic = value.rlike(r"\p{IsCyrillic}")
    lists = {"given-m": (MALE, MALE_CYRILLIC), "given-f": (FEMALE, FEMALE_CYRILLIC), "given-n": (MALE + FEMALE, MALE_CYRILLIC + FEMALE_CYRILLIC)}
    out = None
    for k, (latin, other) in lists.items():
        name = F.when(cyrillic, F.lower(_pick(other, n))).otherwise(F.lower(_pick(latin, n)))
        second = F.when(cyrillic, F.lower(_pick(other, m))).otherwise(F.lower(_pick(latin, m)))
        ending = {"given-m": F.when(cyrillic, "ов").otherwise("us"), "given-f": F.when(cyrillic, "ия").otherwise("ia"), "given-n": F.lit("")}[k]
        made = F.when(attempt < 4, name).when(attempt < 8, F.concat_ws("-", name, second)).otherwise(F.concat(_syllables(value, stream, attempt, 3), ending))
        out = F.when(kind == k, made) if out is None else out.when(kind == k, made)
    return out


def candidate(key: str, kind: Column, value: Column, attempt: Column) -> Column:
    """The replacement of an entity at the given attempt, in canonical form."""

    def of(stream: Column) -> Column:
        longer = lambda part: _by_class(F.concat(part, F.repeat(F.lit("a"), F.floor(attempt / 6).cast("int"))), stream)
        domain = F.concat(longer(F.regexp_extract(value, r"^(.*)\.[^.]+$", 1)), F.regexp_extract(value, r"(\.[^.]+)$", 1))
        prefix = F.regexp_extract(value, f"^(?:{_KEY_PREFIX})", 0)  # says what kind of key it is
        phone = F.concat(F.regexp_extract(value, r"^(\d+\|)?", 0), _by_class(F.regexp_replace(value, r"^\d+\|", ""), stream))
        return (
            F.when(kind == "mail", longer(F.regexp_extract(value, r"^(.*)@", 1))).when(kind == "domain", domain).when(kind == "ip", _octets(value, stream, attempt)).when(kind == "card", _card(value, stream)).when(kind == "phone", phone).when(kind == "ssn", _by_class(value, stream))
            .when(kind == "iban", F.concat(F.substring(value, 1, 2), _by_class(F.substring(value, F.lit(3), F.length(value)), stream))).when(kind == "family", _syllables(value, stream, attempt, 0))
            .when(kind == "secret", F.when(value.rlike("^[0-9a-f]+$"), _hexes(value, stream)).otherwise(F.concat(prefix, _by_class(F.substring(value, F.length(prefix) + 1, F.length(value)), stream)))).otherwise(_given(value, kind, stream, attempt))
        )

    return _let(_stream(key, kind, value, attempt, 3), of)


def assign(entities: DataFrame, key: str) -> DataFrame:
    """entities: kind, value, distinct, and form (what kind of candidate; the kind itself if there is no such column). A written table with a column ``surrogate``, different for any two entities of a kind and never an entity.

    Each kind is checked on its own; given names are one kind, whatever their gender. Entities whose candidate is taken try again with the next
    attempt; of several with one candidate the least value has it. Kinds with few forms
    (short names, addresses of few digits) get longer ones after some attempts, so the rounds end.
    """
    settled = None
    form = "form" if "form" in entities.columns else "kind"
    open_ = stash(entities.select("kind", "value", F.col(form).alias("form"), F.lit(0).alias("attempt")), "entities")
    while True:
        named = open_.withColumn("surrogate", candidate(key, F.col("form"), F.col("value"), F.col("attempt")))
        named = stash(named, "candidates")
        taken = entities.select("kind", F.col("value").alias("surrogate"))
        taken = taken if settled is None else taken.unionByName(settled.select("kind", "surrogate"))
        best = named.groupBy("kind", "surrogate").agg(F.min("value").alias("best"))
        free = best.join(taken.distinct(), ["kind", "surrogate"], "left_anti")
        held = named.join(free, ["kind", "surrogate"], "left").withColumn("ok", F.coalesce(F.col("best") == F.col("value"), F.lit(False)))
        held = stash(held.select("kind", "value", "form", "attempt", "surrogate", "ok"), "checked")
        good = held.where("ok").select("kind", "value", "surrogate")
        settled_now = stash(good if settled is None else settled.unionByName(good), "surrogates")
        left = stash(held.where("not ok").select("kind", "value", "form", (F.col("attempt") + 1).alias("attempt")), "entities")
        for t in (open_, named, held, settled):
            if t is not None:
                unstash(t)
        settled, open_ = settled_now, left
        if open_.isEmpty():
            unstash(open_)
            return settled


def _dress(surface: Column, found: Column) -> Column:
    """The canonical replacements of a match's parts in the layout and case of the match."""
    kind, first = found.getItem(0)["kind"], found.getItem(0)["surrogate"]
    first = F.when(kind == "phone", F.regexp_replace(first, r"\|", "")).when(kind == "mail", F.concat(first, F.lit("@"), F.get(found, F.lit(1))["surrogate"])).otherwise(first)

    def digits(c: Column, i: Column) -> Column:
        before = F.length(F.regexp_replace(F.substring(surface, F.lit(1), i + 1), "[^0-9]", ""))
        return F.when(c.rlike("[0-9]"), F.substring(first, before, F.lit(1))).otherwise(c)

    numbers = F.array_join(F.transform(F.split(surface, ""), digits), "")
    spaced = F.array_join(F.transform(F.split(surface, ""), lambda c, i: F.when(c == " ", c).otherwise(F.substring(first, F.length(F.regexp_replace(F.substring(surface, F.lit(1), i + 1), " ", "")), F.lit(1)))), "")
    title = F.regexp_extract(surface, rf"^((?:{_TITLE}|{_TITLE_CAPITALS})\.? )", 1)
    names = F.array_join(F.transform(found, lambda p: F.initcap(F.regexp_replace(p["surrogate"], "-", " "))), " ")
    names = F.concat(title, F.when(surface == F.upper(surface), F.upper(names)).otherwise(names))
    cased = F.when((surface == F.upper(surface)) & ((kind != "secret") | surface.rlike(_HEX)), F.upper(first)).otherwise(first)
    return F.when(kind.isin("phone", "ssn", "card"), numbers).when(kind == "iban", F.when(surface == F.lower(surface), F.lower(spaced)).otherwise(spaced)).when(kind.isin("family", "given"), names).otherwise(cased)


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the id, text with surrogates, n_entities long (matches), n_distinct long.

    Texts without an entity, empty texts and null ones come back as they are. Repeated
    rows are treated alike, as are ties; null ids are kept; very long texts are searched whole; other
    columns are not read, whatever their names; an empty table gives no rows. Only rows with an entity are shuffled.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = F.when(F.col("text").rlike(HINT), F.regexp_extract_all("text", F.lit(ALL), F.lit(0)))
    searched = rows.select("id", "text", F.coalesce(found, F.array().cast("array<string>")).alias("matches"), F.monotonically_increasing_id().alias("row"))
    searched = stash(searched, "pii-rows")
    hits = searched.where(F.size("matches") > 0)
    surfaces = stash(hits.select("row", F.explode(F.array_distinct("matches")).alias("surface")).select("row", "surface", parts(F.col("surface")).alias("parts")), "pii-matches")
    single = surfaces.select("surface", F.posexplode("parts").alias("at", "part")).select("surface", "at", "part.*").where("kind <> 'number'").distinct()
    # One person's given name after a title of a gender, after another and by itself is one entity; gender as far as all agree.
    known = F.when(F.col("gender") != "n", F.col("gender"))
    agreed = F.when(F.min(known) == F.max(known), F.min(known)).otherwise("n")
    form = F.when(F.col("kind") == "given", F.concat(F.lit("given-"), F.col("gender"))).otherwise(F.col("kind"))
    named = assign(single.groupBy("kind", "value").agg(agreed.alias("gender")).select("kind", "value", form.alias("form")), key)
    # One row for each distinct match, whatever the number of documents with it.
    dressed = single.join(named, ["kind", "value"]).groupBy("surface").agg(F.sort_array(F.collect_list(F.struct("at", "kind", "surrogate"))).alias("found"))
    dressed = dressed.select("surface", _dress(F.col("surface"), F.col("found")).alias("new"))
    maps = surfaces.select("row", "surface").join(dressed, "surface").groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("surface", "new"))).alias("new"))
    filled = hits.join(maps, "row", "left")
    new = lambda m: F.try_element_at(F.col("new"), m)
    held = F.filter("matches", lambda m: new(m).isNotNull())
    pieces = F.split("text", ALL, -1)
    text = _let(pieces, lambda p: F.concat(F.get(p, F.lit(0)), F.array_join(F.transform("matches", lambda m, i: F.concat(F.coalesce(new(m), m), F.get(p, i + 1))), "")))
    columns = lambda t, m: ("id", t.alias("text"), F.size(m).cast("long").alias("n_entities"), F.size(F.array_distinct(m)).cast("long").alias("n_distinct"))
    out = filled.select(*columns(text, held)).unionByName(searched.where(F.size("matches") == 0).select(*columns(F.col("text"), F.col("matches"))))
    return out.withColumnsRenamed({"id": id_col, "text": text_col})


def op6_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key comes from the session's KEY_SETTING. Only a session on one machine (tests) may go without: anyone could undo a key that stands here."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        if not re.match(r"local(-cluster)?\b", spark.sparkContext.master):
            raise RuntimeError(f"set {KEY_SETTING} to a secret")
        key = "key for tests"
    return pseudonymise(table(spark, sf_dir, "documents"), key=key)
