"""Surrogates for personal data, with column functions only.

Entities are found by one pattern: e-mail addresses, phone numbers, IPv4 addresses, card
numbers, social security numbers, IBANs and names behind a title.  Each has a normal form
(digits of a number, lower case of an address or of a name word), so that one entity
gets one replacement however it is written.  The replacement comes from a keyed digest of
kind, normal form and attempt, and is written back in the format of the original: the
separators of a number, upper case, the title.  A card number or IBAN with right check
digits gets a replacement with right ones, one with wrong digits may get either; a phone
number keeps its country code and is another entity under another code (code 1 may be left out).  Names keep script and gender of the
original.  All distinct entities of the corpus are compared: a replacement that two
entities share, or that is itself an entity of the corpus, is drawn again for the loser
with the next attempt, until all differ.

Only entities drawn again are joined back to the documents that hold them; usually there
are none and texts are not shuffled.

Defined cases: a null text stays null; texts without entities stay as they are; equal
texts get equal results; ids may be null or repeat; an empty table gives no rows; other
columns are carried unchanged except ``n_chars``, which follows the new text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evgraph.session import cut_lineage, stored

#: Kinds by pattern, tried in this order at each place.
#: An address starts where its letters do, or right behind another entity: an unbroken run is tried once.
EMAIL = r"(?:\G|(?<![\p{L}\p{N}._%+-]))[\p{L}\p{N}._%+-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}"
IP = r"(?<![\p{L}\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\p{L}\d]|\.\d)"
SSN = r"(?<![\p{L}\d-])\d{3}-\d{2}-\d{4}(?![\p{L}\d]|-\d)"
CARD = r"(?<![\p{L}\d])(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?![\p{L}\d])"
PHONE = (r"(?<![\p{L}\d+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}"
         r"|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\p{L}\d])")
IBAN = r"(?<![\p{L}\d])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\d])"
#: Titles by the gender they tell (m, f) or leave open (u).
TITLES = {
    "m": ("Mr", "Herr", "Herrn", "Señor", "Sr", "Monsieur", "Господин", "Κύριος"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Señorita", "Madame", "Mme", "Mademoiselle", "Госпожа", "Κυρία"),
    "u": ("Dr", "Prof", "Доктор"),
}
_TITLE = "(?:" + "|".join(sorted((t for v in TITLES.values() for t in v), key=lambda t: (-len(t), t))) + ")"
NAME = rf"(?<!\p{{L}}){_TITLE}\.?\x20+\p{{Lu}}[\p{{L}}'-]+(?:\x20\p{{Lu}}[\p{{L}}'-]+){{0,2}}"
ENTITY = "|".join(f"(?:{p})" for p in (EMAIL, NAME, IBAN, SSN, PHONE, IP, CARD))

#: Given names by script and gender, and parts of family names by script.
GIVEN = {
    "latin": {
        "m": ("Adam", "Bruno", "Carl", "David", "Erik", "Felix", "Georg", "Henry", "Ivan", "Jonas", "Karel", "Louis", "Martin", "Noel", "Oscar", "Paul"),
        "f": ("Alice", "Berta", "Clara", "Diana", "Emma", "Flora", "Greta", "Helen", "Irene", "Julia", "Karin", "Laura", "Maria", "Nina", "Olga", "Paula"),
        "u": ("Alex", "Andrea", "Chris", "Dana", "Robin", "Kim", "Jules", "Sasha"),
    },
    "cyrillic": {
        "m": ("Андрей", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл"),
        "f": ("Анна", "Вера", "Галина", "Дарья", "Елена", "Зоя", "Ирина", "Ксения"),
        "u": ("Саша", "Женя", "Валя"),
    },
    "greek": {
        "m": ("Ανδρέας", "Γιώργος", "Νίκος", "Πέτρος"), "f": ("Άννα", "Ελένη", "Μαρία", "Σοφία"), "u": ("Άρτεμις", "Φοίβη"),
    },
}
FAMILY = {
    "latin": ("ba", "den", "fel", "gar", "hol", "ker", "lin", "mar", "nor", "pet", "ros", "sten", "tor", "val", "wes", "zim"),
    "cyrillic": ("бел", "вор", "гор", "дем", "жар", "зим", "кор", "лав", "мор", "нов", "пет", "рог", "сок", "тим", "фед", "чер"),
    "greek": ("αλ", "βασ", "γερ", "δημ", "ζαφ", "καρ", "λαμ", "μαν", "νικ", "παπ", "ραλ", "σαρ", "τασ", "φιλ", "χατ", "ψαρ"),
}
_RESERVED = ("com", "net", "org")
# --- fixed values: telephone country codes of one and two digits; all others have three ---
_CODE = r"^(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: a transform over a single element."""
    return F.get(F.transform(F.array(value), body), 0)


def _digest(key: Column, kind: Column, value: Column, attempt: Column) -> Column:
    """64 hex digits that depend on the key: inner and outer digest around the message."""
    inner = F.sha2(F.concat_ws("\n", key, kind, value, attempt.cast("string")), 256)
    return F.sha2(F.concat(key, F.lit("|"), inner), 256)


def _number(hexa: Column, at: int, size: int = 6) -> Column:
    return F.conv(F.substring(hexa, at + 1, size), 16, 10).cast("long")


def _pick(values: tuple[str, ...], number: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), (number % len(values)).cast("int"))


def _digits(hexa: Column) -> Column:
    """64 decimal digits of a digest."""
    return F.translate(hexa, "abcdef", "246813")


def _letters(value: Column, hexa: Column) -> Column:
    """Each letter becomes another of its sort, each digit a digit; other signs stay."""
    def one(c: Column, i: Column) -> Column:
        n = F.conv(F.substring(hexa, 1, 64).substr(F.pmod(i * 3, F.lit(62)) + 1, F.lit(2)), 16, 10).cast("int")
        vowels, others = "aeiou", "bcdfghjklmnprstvwz"
        return (
            F.when(c.rlike("^[0-9]$"), (n % 10).cast("string"))
            .when(c.rlike("^[aeiouyàâäéèêëíîïóôöúùûü]$"), F.lit(vowels).substr(n % len(vowels) + 1, F.lit(1)))
            .when(c.rlike(r"^\p{L}$"), F.lit(others).substr(n % len(others) + 1, F.lit(1)))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"^\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"^\p{IsGreek}"), "greek").otherwise("latin")


def _kind(found: Column) -> Column:
    return (
        F.when(found.contains("@"), "email").when(found.rlike(r"^\p{L}{2,}[\p{L}.]*\x20"), F.when(found.rlike(r"^[A-Z]{2}\d"), "iban").otherwise("name"))
        .when(found.rlike(r"^[A-Z]{2}\d"), "iban").when(found.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(found.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$"), "ip").when(found.rlike(r"^[+(]|^\d{3}[.-]\d{3}[.-]"), "phone").otherwise("card")
    )


def _phone(found: Column) -> Column:
    """All digits of a phone number: "+code rest", the rest alone where the code is 1 or not given."""
    digits = F.regexp_replace(found, r"[^0-9]", "")
    coded = F.regexp_replace(F.regexp_replace(digits, _CODE, "+$1 "), r"^\+1 ", "")
    return F.when(found.startswith("+"), coded).otherwise(digits)


def _luhn(digits: Column) -> Column:
    """Sum of a card number modulo 10; 0 where its check digit is right."""
    n = F.length(digits)

    def part(i: Column) -> Column:
        d = digits.substr(i, F.lit(1)).cast("int") * (F.pmod(n - i, F.lit(2)) + 1)
        return d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), part), F.lit(0), lambda a, b: a + b) % 10


def _mod97(iban: Column) -> Column:
    """An IBAN with its first four signs moved to the end, letters as 10 to 35, modulo 97; 1 where it is right."""
    moved = F.concat(iban.substr(F.lit(5), F.length(iban)), F.substring(iban, 1, 4))

    def step(a: Column, i: Column) -> Column:
        v = F.conv(moved.substr(i, F.lit(1)), 36, 10).cast("int")
        return (a * F.when(v > 9, 100).otherwise(10) + v) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(iban)), F.lit(0), step)


def _gender(found: Column) -> Column:
    title = F.regexp_extract(found, r"^([\p{L}]+)", 1)
    return F.when(title.isin(*TITLES["m"]), "m").when(title.isin(*TITLES["f"]), "f").otherwise("u")


def _words(found: Column) -> Column:
    """Name words behind the title."""
    return F.split(F.regexp_replace(found, rf"^{_TITLE}\.?\x20+", ""), r"\x20")


def entities(found: Column) -> Column:
    """Array of (kind, value) in normal form of one match: one, or one per word of a name."""
    def of_name(words: Column) -> Column:
        return F.transform(words, lambda w, i: F.struct(
            F.when(i == F.size(words) - 1, F.concat(F.lit("family_"), _script(w)))
            .otherwise(F.concat_ws("_", F.lit("given"), _gender(found), _script(w))).alias("kind"),
            F.lower(w).alias("value")))

    def of_kind(kind: Column) -> Column:
        value = (
            F.when(kind == "email", F.lower(found)).when(kind == "phone", _phone(found)).when(kind == "ip", found)
            .when(kind == "iban", F.regexp_replace(found, " ", "")).otherwise(F.regexp_replace(found, r"[^0-9]", ""))
        )
        one = F.array(F.struct(kind.alias("kind"), value.alias("value")))
        return F.when(kind == "name", _let(_words(found), of_name)).otherwise(one)

    return _let(_kind(found), of_kind)


def replacement(kind: Column, value: Column, attempt: Column, key: Column) -> Column:
    """Normal form of the replacement of an entity."""
    return _let(_digest(key, kind, value, attempt), lambda hexa: _drawn(kind, value, attempt, key, hexa))


def _drawn(kind: Column, value: Column, attempt: Column, key: Column, hexa: Column) -> Column:
    def mail(domain: Column) -> Column:
        # All addresses of a domain share the replaced domain, which lies under a reserved name.
        top = F.substring_index(domain, ".", -1)
        name = _let(_digest(key, F.lit("domain"), domain, F.lit(0)), lambda site: _letters(F.substring_index(domain, ".", 1), site))
        return F.concat(
            _letters(F.substring_index(value, "@", 1), hexa), F.when(attempt > 0, attempt.cast("string")).otherwise(""), F.lit("@"),
            name, F.lit(".example."), F.when(top.isin(*_RESERVED), top).otherwise("com"))

    def digits_for(plain: Column, old: Column) -> Column:
        first = F.when(F.substring(old, 1, 1) == "0", F.lit("0")).otherwise(_number(hexa, 0) % 9 + 1)
        return F.concat(first, plain.substr(F.lit(8), F.length(old) - 1))

    def number(plain: Column) -> Column:
        return digits_for(plain, value)

    def coded(plain: Column) -> Column:
        return F.concat(F.substring_index(value, " ", 1), F.lit(" "), digits_for(plain, F.substring_index(value, " ", -1)))

    def card(made: Column) -> Column:
        body = made.substr(F.lit(1), F.length(made) - 1)
        last = F.pmod(10 - _luhn(F.concat(body, F.lit("0"))), F.lit(10)).cast("string")
        return F.when(_luhn(value) == 0, F.concat(body, last)).otherwise(made)

    def checked(made: Column) -> Column:
        open_ = F.concat(F.substring(made, 1, 2), F.lit("00"), made.substr(F.lit(5), F.length(made)))
        check = F.lpad((98 - _mod97(open_)).cast("string"), 2, "0")
        return F.when(_mod97(value) == 1, F.overlay(made, check, 3)).otherwise(made)

    def account(plain: Column) -> Column:
        def sign(c: Column, i: Column) -> Column:
            letter = F.translate(hexa.substr(F.pmod(i, F.lit(60)) + 1, F.lit(1)), "0123456789abcdef", "ABCDEFGHIJKLMNOP")
            return F.when(c.rlike("^[0-9]$"), plain.substr(F.pmod(i, F.lit(60)) + 1, F.lit(1))).otherwise(letter)

        return F.concat(F.substring(value, 1, 2), F.array_join(F.transform(F.split(value.substr(F.lit(3), F.length(value)), ""), sign), ""))

    def many(values: tuple[str, ...], least: int, between: str) -> Column:
        """``least`` parts and one more for each attempt."""
        return F.array_join(F.transform(F.sequence(F.lit(1), attempt + least), lambda i: F.lower(_pick(values, F.conv(
            hexa.substr(F.pmod(i * 4, F.lit(56)) + 1, F.lit(6)), 16, 10).cast("long")))), between)

    address = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (
        F.conv(hexa.substr(i * 6 + 1, F.lit(6)), 16, 10).cast("long") % 254 + 1).cast("string")), ".")
    out = (
        F.when(kind == "email", _let(F.substring_index(value, "@", -1), mail)).when(kind == "ip", address)
        .when(kind == "iban", _let(_let(_digits(hexa), account), checked)).when(kind == "card", _let(_let(_digits(hexa), number), card))
        .when(value.startswith("+"), _let(_digits(hexa), coded))
    )
    for script, parts in FAMILY.items():
        out = out.when(kind == f"family_{script}", many(parts, 3, ""))
        for gender, names in GIVEN[script].items():
            out = out.when(kind == f"given_{gender}_{script}", many(names, 1, "-"))
    return out.otherwise(_let(_digits(hexa), number))


def _written(found: Column, kind: Column, new: Column) -> Column:
    """A replaced number in the format of the original, digit for digit from the right."""
    plain = F.regexp_replace(new, r"[^0-9]", "")

    def digit(c: Column, i: Column) -> Column:
        right = F.length(F.regexp_replace(found.substr(i + 1, F.length(found)), r"[^0-9]", ""))  # digits from here on
        at = F.length(plain) - right + 1
        return F.when(c.rlike("^[0-9]$") & (at >= 1), plain.substr(at, F.lit(1))).otherwise(c)

    numbers = F.array_join(F.transform(F.split(found, ""), digit), "")
    spaced = F.array_join(F.transform(F.split(found, ""), lambda c, i: F.when(c == " ", c).otherwise(
        new.substr(F.length(F.regexp_replace(found.substr(F.lit(1), i + 1), " ", "")), F.lit(1)))), "")
    return (
        F.when(kind == "email", F.when(F.upper(found) == found, F.upper(new)).otherwise(new)).when(kind == "ip", new)
        .when(kind == "iban", spaced).otherwise(numbers)
    )


def _cased(word: Column, new: Column) -> Column:
    whole = F.transform(F.split(new, "-"), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), p.substr(F.lit(2), F.length(p))))
    return F.when((F.upper(word) == word) & (F.length(word) > 1), F.upper(new)).otherwise(F.array_join(whole, "-"))


def surrogate(found: Column, key: Column, attempts: Column | None = None) -> Column:
    """Text that takes the place of one match; ``attempts`` maps "kind value" to later draws."""
    def drawn(e: Column) -> Column:
        attempt = F.lit(0) if attempts is None else F.coalesce(F.element_at(attempts, F.concat_ws(" ", e["kind"], e["value"])), F.lit(0))
        return F.struct(e["kind"].alias("kind"), replacement(e["kind"], e["value"], attempt, key).alias("new"))

    def put(parts: Column) -> Column:
        first = parts[0]
        title = F.regexp_extract(found, rf"^({_TITLE}\.?\x20+)", 1)
        name = F.concat(title, F.array_join(F.zip_with(_words(found), parts, lambda w, p: _cased(w, p["new"])), " "))
        return F.when(first["kind"].rlike("^(family|given)_"), name).otherwise(_written(found, first["kind"], first["new"]))

    return _let(F.transform(entities(found), drawn), put)


def matches(text: Column) -> Column:
    """All matches of the entity pattern, from the left, without overlap."""
    return F.when(text.rlike(r"[0-9@]|" + _TITLE), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)))


def found_entities(docs: DataFrame, text: str = "text") -> DataFrame:
    """kind, value of every distinct entity of the corpus."""
    return _entities_of(docs.select(matches(F.col(text)).alias("found")))


def _entities_of(rows: DataFrame) -> DataFrame:
    each = rows.select(F.explode("found").alias("m")).select(F.explode(entities(F.col("m"))).alias("e"))
    return each.select("e.kind", "e.value").distinct()


def redrawn(found: DataFrame, key: str, max_rounds: int = 64) -> DataFrame:
    """kind, value, attempt of the entities whose first replacement collides.

    ``found`` holds each distinct entity once.  A replacement counts as taken if it is an
    entity of the corpus or the replacement of another entity; among entities that meet,
    the one with the smallest digest keeps it.
    """
    real = found.select("kind", F.col("value").alias("new")).distinct()
    open_ = found.withColumn("attempt", F.lit(0))
    settled: DataFrame | None = None
    for _ in range(max_rounds):
        drawn = open_.withColumn("new", replacement(F.col("kind"), F.col("value"), F.col("attempt"), F.lit(key)))
        drawn = drawn.join(real.withColumn("is_real", F.lit(True)), ["kind", "new"], "left")
        if settled is not None:
            used = settled.select("kind", "new", F.lit(True).alias("is_used"))
            drawn = drawn.join(used, ["kind", "new"], "left")
        else:
            drawn = drawn.withColumn("is_used", F.lit(None).cast("boolean"))
        first = drawn.groupBy("kind", "new").agg(F.min_by("value", F.struct(F.xxhash64("value"), "value")).alias("first"))
        drawn = cut_lineage(drawn.join(first, ["kind", "new"]).withColumn(
            "ok", F.col("is_real").isNull() & F.col("is_used").isNull() & (F.col("value") == F.col("first"))))
        good = drawn.filter("ok").select("kind", "value", "attempt", "new")
        settled = good if settled is None else settled.unionByName(good)
        lost = drawn.filter("not ok")
        if lost.isEmpty():
            return settled.filter("attempt > 0").select("kind", "value", "attempt")
        open_ = lost.select("kind", "value", (F.col("attempt") + 1).alias("attempt"))
    raise RuntimeError("replacements still collide; raise max_rounds")


def replace_personal_data(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with personal data replaced, n_chars to match, and n_entities of each row.

    A column n_entities of the input gives way to the new one.  Texts are searched once: rows are written
    with their matches, of which first the distinct entities and then the surrogates are made.
    """
    names = [c for c in docs.columns if c != "n_entities"]
    void = {name for name, kind in docs.dtypes if kind == "void"}  # no file can hold these
    # The row travels as one struct, so its column names cannot meet those used here.
    rows = stored(docs.select(F.struct(*[docs[c] for c in names if c not in void]).alias("row"), matches(docs[text]).alias("found")))
    again = redrawn(cut_lineage(_entities_of(rows)), key)
    rows = rows.withColumn("old", F.col("row").getField(text))
    attempts = None
    if not again.isEmpty():
        # Texts that hold an entity drawn again, by digest: equal texts share one map.
        held = rows.select(F.sha2("old", 256).alias("digest"), F.explode("found").alias("m"))
        held = held.select("digest", F.explode(entities(F.col("m"))).alias("e")).select("digest", "e.kind", "e.value").distinct()
        maps = held.join(again, ["kind", "value"]).groupBy("digest").agg(
            F.map_from_entries(F.collect_list(F.struct(F.concat_ws(" ", "kind", "value"), "attempt"))).alias("attempts"))
        rows = rows.withColumn("digest", F.sha2("old", 256)).join(maps, "digest", "left")
        attempts = F.coalesce("attempts", F.create_map().cast("map<string,int>"))
    between = F.split("old", ENTITY, -1)
    new = F.transform("found", lambda m: surrogate(m, F.lit(key), attempts))
    joined = F.array_join(F.flatten(F.zip_with(between, new, lambda b, n: F.array(b, F.coalesce(n, F.lit(""))))), "")
    some = F.coalesce(F.size("found"), F.lit(0)) > 0
    rows = rows.withColumn("new", F.when(some, joined).otherwise(F.col("old")))

    def column(name: str) -> Column:
        if name == text:
            return F.col("new").alias(name)
        value = F.lit(None) if name in void else F.col("row").getField(name)
        if name == "n_chars":
            value = F.when(some, F.length("new").cast(docs.schema[name].dataType)).otherwise(value)
        return value.alias(name)

    counted = F.when(some, F.size("found")).otherwise(0).cast("long").alias("n_entities")
    return rows.select(*[column(c) for c in names], counted)
