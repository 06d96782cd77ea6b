"""Names, units and free-form metadata as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# A leading number and the unit behind it.
NUMBER_UNIT = r"^([-+]?\d*\.?\d+)\s*([a-z%]*)"

# Accepted key names after normalisation, and nesting keys.
SEX_KEYS = ["sex", "gender", "biologicalsex"]
HEIGHT_KEYS = ["heightm", "height", "stature", "bodyheight", "bodyheightm", "staturem", "bodyheightmeter"]
MASS_KEYS = ["masskg", "mass", "weightkg", "weight", "bodymass", "bodyweight", "bodymasskg"]
NESTS = ["subject", "participant", "patient", "person"]

# Tool suffixes dropped from marker names, in order.
TOOL_SUFFIXES = ["_augmenter", "augmenter", "_mmpose", "mmpose", "_openpose", "openpose"]


def key_name(c: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def clean_name(c: Column) -> Column:
    """Lower case; letters, digits, dots and underscores stay."""
    return F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9_.]+", "")


def canon_name(c: Column) -> Column:
    """Lower case with blanks and dashes as underscores, dots dropped."""
    return F.replace(F.translate(F.lower(c), " -", "__"), F.lit("."), F.lit(""))


def native_name(c: Column) -> Column:
    """Marker name without tool suffix, letters and digits only."""
    s = F.lower(c)
    for suffix in TOOL_SUFFIXES:
        s = F.regexp_replace(s, suffix + "$", "")
    return F.regexp_replace(s, "[^a-z0-9]", "")


def label_name(c: Column) -> Column:
    return F.upper(F.trim(c))


def number_of(c: Column) -> Column:
    return F.nullif(F.regexp_extract(F.lower(F.trim(c)), NUMBER_UNIT, 1), F.lit("")).try_cast("double")


def unit_of(c: Column) -> Column:
    return F.nullif(F.regexp_extract(F.lower(F.trim(c)), NUMBER_UNIT, 2), F.lit(""))


def sex_of(c: Column) -> Column:
    s = F.lower(F.trim(c))
    return F.when(s.isin("m", "male", "man"), "male").when(s.isin("f", "female", "woman"), "female").otherwise(c)


def height_m(c: Column) -> Column:
    """Metres from a unit, or from the plausible range of a bare number."""
    v, u = number_of(c), unit_of(c)
    bare = u.isNull()
    return (
        F.when((u == "m") | (bare & v.between(0.5, 2.6)), v)
        .when((u == "cm") | (bare & v.between(50, 260)), v / 100.0)
        .when((u == "mm") | (bare & v.between(500, 2600)), v / 1000.0)
    )


def mass_kg(c: Column) -> Column:
    v, u = number_of(c), unit_of(c)
    bare = u.isNull()
    return F.when((u == "kg") | (bare & v.between(20, 300)), v).when(
        (u == "g") | (bare & v.between(20000, 300000)), v / 1000.0
    )


def lookup(flat: Column, nested: Column, keys: Sequence[str]) -> Column:
    """First value whose normalised key is wanted: in the flat map, else in the
    nested maps in their fixed order."""
    hit = lambda m: F.get(
        F.filter(F.map_entries(m), lambda e: key_name(e["key"]).isin(list(keys))), F.lit(0)
    )["value"]
    return F.coalesce(hit(flat), *[hit(F.try_element_at(nested, F.lit(n))) for n in NESTS])


def split_list(c: Column) -> Column:
    """Comma separated names, trimmed, empties dropped."""
    return F.filter(F.transform(F.split(c, ","), lambda s: F.trim(s)), lambda s: s != "")


def fixed(c: Column, digits: int = 5) -> Column:
    """Fixed-point text; empty when missing or not finite.

    The exact binary value is rounded, a tie to the even digit, as C and Python do;
    ``format_string`` rounds the shortest decimal text, ties up. The fraction times the power
    of ten is kept exactly, as a product and its error."""
    split = lambda v: 134217729.0 * v - (134217729.0 * v - v)
    ten = 10.0**digits
    th = split(ten)
    bad = c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    size = F.abs(c)
    whole = F.floor(size)
    part = size - whole
    ph = split(part)
    p = part * ten
    err = ((ph * th - p) + ph * (ten - th) + (part - ph) * th) + (part - ph) * (ten - th)
    n = F.floor(p)
    rest = p - n
    up = (rest > 0.5) | ((rest == 0.5) & ((err > 0) | ((err == 0) & ((n if digits else whole) % 2 == 1))))
    n = n + up.cast("long")
    over = (n >= int(ten)).cast("long")
    point = F.concat(F.lit("."), F.lpad((n - over * int(ten)).cast("string"), digits, "0")) if digits else F.lit("")
    plain = F.concat(F.when(c.cast("string").startswith("-"), F.lit("-")).otherwise(F.lit("")), (whole + over).cast("string"), point)
    # from 2^53 on there is no fraction
    return F.when(bad, F.lit("")).when(size >= 2.0**53, F.format_string(f"%.{digits}f", c)).otherwise(plain)


def reshape3(flat: Column) -> Column:
    """Flat array to K points; NULL unless its length is a multiple of three."""
    pts = F.transform(
        F.sequence(F.lit(0), (F.size(flat) / 3).cast("int") - 1),
        lambda i: F.array(flat[3 * i], flat[3 * i + 1], flat[3 * i + 2]),
    )
    return F.when((F.size(flat) > 0) & (F.size(flat) % 3 == 0), pts)
