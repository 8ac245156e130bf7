"""Scalar functions beyond single built-ins; all are column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def without_zeros(text: Column) -> Column:
    """Leading zeros dropped through a whole number."""
    return text.cast("long").cast("string")


def insert_self(text: Column, position: Column) -> Column:
    """text with a copy of itself inserted after the 0-based position."""
    return F.concat(F.substring(text, F.lit(1), position + 1), text, F.substring(text, position + 2, F.length(text)))


def doubled(text: Column, positions: Column) -> Column:
    """insert_self() for each position in turn: every step doubles the string."""
    return F.aggregate(positions, text, lambda s, p: F.concat(s.substr(F.lit(1), p + 1), s, s.substr(p + 2, F.length(s))))


def trailing_zeros(n: Column) -> Column:
    """Zero bits at the end; 0 for 0."""
    text = F.bin(n)
    return F.when(n == 0, F.lit(0)).otherwise(F.length(text) - F.length(F.rtrim(text, F.lit("0"))))


def linear_hash(x: Column, a: int, b: int, p: int, n: int) -> Column:
    """((a x + b) mod p) mod n; a, b and x below 2**31 keep it in 64 bits."""
    return F.pmod(F.pmod(F.lit(a).cast("long") * x + F.lit(b).cast("long"), F.lit(p).cast("long")), F.lit(n).cast("long"))


def md5_number(text: Column, digits: int = 8) -> Column:
    """The first hex digits of md5 as a number: a string hash that other engines share."""
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def digits_key(text: Column) -> Column:
    """The digits of the text, one after the other, as a number of up to 38 digits."""
    return F.regexp_replace(text, "[^0-9]", "").cast("decimal(38,0)")


def bytes_modulo(text: Column, n: int) -> Column:
    """The UTF-8 bytes of the text read as one large number, modulo n (below 2**48), however long the text is."""
    digits = F.split(F.hex(F.encode(text, "UTF-8")), "")
    return F.aggregate(digits, F.lit(0).cast("long"), lambda acc, d: F.pmod(acc * 16 + F.conv(d, 16, 10).cast("long"), F.lit(n).cast("long")))


def java_hash(text: Column) -> Column:
    """The JVM's 32-bit hash of a string of the Basic Multilingual Plane's first half: 31 * h + code, with overflow."""
    wrapped = lambda h: F.pmod(h + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)
    return F.aggregate(F.split(text, ""), F.lit(0).cast("long"), lambda h, c: wrapped(h * 31 + F.ascii(c)))


def list_text(items: Column) -> Column:
    """The items of a list as its literal without the brackets."""
    return F.array_join(F.transform(items.cast("array<string>"), lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", ")


def pairs(items: Column) -> Column:
    """All pairs of a sorted array, as an array of two-element arrays."""
    return F.flatten(F.transform(items, lambda x, i: F.transform(F.slice(items, i + 2, F.size(items)), lambda y: F.array(x, y))))


def without_each(items: Column) -> Column:
    """The subsets that lack one element."""
    return F.transform(F.sequence(F.lit(1), F.size(items)), lambda i: F.concat(F.slice(items, F.lit(1), i - 1), F.slice(items, i + 1, F.size(items))))


def position(items: Column, value: Column) -> Column:
    """0-based position, or -1."""
    return F.array_position(items, value) - 1


def is_subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def padded_desc(items: Column, n: int, filler: float) -> Column:
    """Filled up to n elements, largest first."""
    return F.slice(F.sort_array(F.concat(items, F.array_repeat(F.lit(filler), F.greatest(F.lit(0), F.lit(n) - F.size(items)))), asc=False), 1, n)


def upper_median(items: Column) -> Column:
    ordered = F.array_sort(items)
    return F.element_at(ordered, (F.floor(F.size(items) / 2) + 1).cast("int"))


def scaled_distance(a: Column, b: Column, scale: Column) -> Column:
    """Euclidean distance after dividing each coordinate by its scale."""
    steps = F.zip_with(F.zip_with(a, b, lambda x, y: x - y), scale, lambda d, s: d / s)
    return F.sqrt(F.aggregate(steps, F.lit(0.0), lambda acc, x: acc + x * x))


def add_maps(a: Column, b: Column) -> Column:
    """Values of equal keys added."""
    return F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def right_wins(a: Column, b: Column) -> Column:
    """Map union in which the second map's values stay."""
    return F.map_zip_with(a, b, lambda k, x, y: F.coalesce(y, x))


def by_value(m: Column) -> Column:
    """Entries of a map by value, largest first, then key."""
    flipped = F.transform(F.map_entries(m), lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("key")))
    return F.transform(F.array_sort(flipped), lambda e: e["key"])


def inverted(m: Column) -> Column:
    return F.map_from_entries(F.transform(F.map_entries(m), lambda e: F.struct(e["value"], e["key"])))


def repaired_literal(text: Column) -> Column:
    """A dict literal with single quotes and capital booleans as JSON."""
    out = F.replace(text, F.lit("'"), F.lit('"'))
    for a, b in (("True", "true"), ("False", "false"), ("None", "null")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def is_object(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull() & F.startswith(F.ltrim(text), F.lit("{"))


def listed(text: Column) -> Column:
    """How many entries a comma list has; null, empty and 'None' have none."""
    return F.when(text.isNull() | (text == "") | (text == "None"), F.lit(0)).otherwise(F.size(F.split(text, ",")))


def age_years(since: Column, as_of: str) -> Column:
    """Whole days up to as_of, in years of 365 days."""
    return F.datediff(F.lit(as_of).cast("date"), F.to_date(since)) / F.lit(365.0)


def amplified(sim: Column, negative: float = 0.1, positive: float = 1.1) -> Column:
    return F.when(sim < 0, sim * negative).otherwise(sim * positive)


def canonical(a: Column, b: Column) -> Column:
    return F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
