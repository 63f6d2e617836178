"""Names, addresses and contacts as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ROMAN = ((10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i"))


def name_key(name: Column) -> Column:
    """Key under which names of buildings meet: spaces of any kind folded, quotes and generic prefixes gone, lower case."""
    folded = F.regexp_replace(F.coalesce(name, F.lit("")), r"[\s ]+", " ")
    bare = F.regexp_replace(folded, "[\"'«»“”]", "")
    return F.trim(F.regexp_replace(F.lower(F.trim(bare)), r"^(residential complex|complex|block) ", ""))


def normal_address(address: Column) -> Column:
    """Lower case, dashes folded, noise words and punctuation gone."""
    low = F.regexp_replace(F.lower(F.coalesce(address, F.lit(""))), "[–—−]", "-")
    quiet = F.regexp_replace(low, r"\b(street|st|avenue|ave|house|building|city)\b\.?", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(quiet, r"[^\p{L}\p{N}\-/ ]", " "), " +", " "))


def tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(normal_address(text), " "), lambda w: w != ""))


def token_overlap(a: Column, b: Column) -> Column:
    """Shared tokens over the shorter side; null if a side has none."""
    x, y = tokens(a), tokens(b)
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.least(F.size(x), F.size(y)))


def house_number(address: Column) -> Column:
    found = F.regexp_extract(F.coalesce(address, F.lit("")), r"(?i)\b(\d{1,4}(?:/\d{1,3})?[a-z]?)\b", 1)
    return F.when(found != "", F.lower(found))


def roman(number: int) -> str:
    """Small numbers as Roman numerals, by rule."""
    out = ""
    for value, letters in _ROMAN:
        while number >= value:
            out, number = out + letters, number - value
    return out


def roman_value(token: Column, most: int = 49) -> Column:
    table = F.create_map(*[F.lit(x) for n in range(1, most + 1) for x in (("x" * (n // 10) if n >= 10 else "") + roman(n % 10), n)])
    return F.element_at(table, F.lower(token))


#: Cyrillic letters by rows of the alphabet, and what each becomes. Fixed values.
_CYRILLIC = "абвгдеёжзийклмнопрстуфхцчшщъыьэюя"
_LATIN = "a b v g d e e zh z i y k l m n o p r s t u f kh ts ch sh shch  y  e yu ya".split(" ")


def transliterate(text: Column) -> Column:
    """Lower case, Cyrillic letters in Latin ones."""
    out = F.lower(text)
    for letter, latin in zip(_CYRILLIC, _LATIN, strict=True):
        out = F.replace(out, F.lit(letter), F.lit(latin))
    return out


def phase_and_base(name: Column) -> Column:
    """Struct of the phase of a building's name (an Arabic or Roman number at its end, with or without a word for it) and the rest."""
    low = F.trim(F.regexp_replace(transliterate(name), r"\s+", " "))
    pattern = r"^(.*?)[ ,\-]+(?:(?:phase|stage|queue|block) )?(\d{1,2}|[ivxl]{1,6})$"
    token, rest = F.regexp_extract(low, pattern, 2), F.trim(F.regexp_extract(low, pattern, 1))
    number = F.when(token.rlike(r"^\d+$"), F.when(token.rlike(r"^\d+$"), token).cast("int")).otherwise(roman_value(token))
    return F.struct(number.alias("phase"), F.when(number.isNotNull(), rest).otherwise(low).alias("base"))


def street_key(address: Column) -> Column:
    """What stands before the first number of an address, normalised."""
    return F.nullif(F.trim(F.regexp_extract(normal_address(address), r"^([^0-9]*)", 1)), F.lit(""))


def address_hash(address: Column, floor: Column, area: Column) -> Column:
    return F.sha2(F.concat_ws("|", normal_address(address), floor.cast("string"), F.bround(area, 0).cast("long").cast("string")), 256)


def scrub(text: Column) -> Column:
    """Without markup, control characters, addresses of mail, handles and phone numbers."""
    out = F.regexp_replace(text, "<[^>]*>", " ")
    out = F.regexp_replace(out, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    out = F.regexp_replace(out, r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}", "[mail]")
    out = F.regexp_replace(out, r"(^|[^A-Za-z0-9_])@[A-Za-z0-9_]{3,}", "$1[handle]")
    return F.regexp_replace(out, r"\+?[0-9][0-9()\- ]{8,}[0-9]", "[phone]")


def first_hit(text: Column, rules: list[tuple[str, str]], otherwise: str) -> Column:
    """Ordered keyword rules: the first pattern that occurs decides."""
    out = None
    for label, pattern in rules:
        hit = text.rlike(f"(?i){pattern}")
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(otherwise)


def only_hit(text: Column, rules: list[tuple[str, str]], otherwise: str) -> Column:
    """Conflict rules: a label only if exactly one pattern occurs."""
    hits = F.array_compact(F.array(*[F.when(text.rlike(f"(?i){p}"), label) for label, p in rules]))
    return F.when(F.size(hits) == 1, hits[0]).otherwise(otherwise)


def hamming_hex(a: Column, b: Column) -> Column:
    """Places in which two hex strings differ."""
    letters = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (~x.eqNullSafe(y)).cast("int"))
    return F.aggregate(letters, F.lit(0), lambda s, x: s + x)


def text_flags(text: Column, rules: dict[str, str]) -> Column:
    """Names of all rules, in their order, whose pattern the text holds."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_compact(F.array(*[F.when(low.rlike(pattern), F.lit(name)) for name, pattern in rules.items()]))


def fold(key: Column, folds: int = 10) -> Column:
    """Stable fold of a key by its digest."""
    return (F.conv(F.substring(F.sha2(key, 256), 1, 15), 16, 10).cast("long") % folds).cast("int")
