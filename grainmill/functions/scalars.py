"""Column functions on texts, numbers, arrays and maps. All run in the JVM."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from string import punctuation

from pyspark.sql import Column
from pyspark.sql import functions as F

_PUNCT = r"[\p{Punct}]"


def strip_punctuation(s: Column, everywhere: bool = False) -> Column:
    """Lower case, trimmed, without ASCII punctuation at the ends or anywhere."""
    low = F.lower(F.trim(s))
    return F.regexp_replace(low, _PUNCT, "") if everywhere else F.btrim(low, F.lit(punctuation))


def chunks(a: Column, size: int) -> Column:
    """An array cut into arrays of a size; the last may be shorter."""
    starts = F.when(F.size(a) > 0, F.sequence(F.lit(0), F.floor((F.size(a) - 1) / size).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(a, i * size + 1, size))


def is_number(s: Column) -> Column:
    return F.coalesce(F.trim(s).try_cast("double").isNotNull(), F.lit(False))


def numbers_in(s: Column) -> Column:
    """All numeric literals as doubles; a lone point is 0."""
    return F.transform(F.regexp_extract_all(s, F.lit(r"(\d*\.?\d+|\d+\.?\d*|\.)"), 1), lambda x: F.coalesce(x.try_cast("double"), F.lit(0.0)))


def squeeze(s: Column) -> Column:
    return F.regexp_replace(s, r"\s+", " ")


def without_chars(s: Column, chars: str) -> Column:
    return F.translate(s, chars, "")


def swap_prefix(s: Column, prefix: str, other: str) -> Column:
    return F.when(F.startswith(s, F.lit(prefix)), F.concat(F.lit(other), F.substr(s, F.lit(len(prefix) + 1)))).otherwise(s)


def split_camel(a: Column) -> Column:
    """Each text of an array cut before its capitals, in one array without empty texts."""
    return F.filter(F.flatten(F.transform(a, lambda x: F.split(x, r"(?=[A-Z])"))), lambda x: x != "")


def stars(p: Column) -> Column:
    """*** below .001, ** below .01, * below .05."""
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def starred(coefficient_and_p: Column) -> Column:
    """A text 'coef (p)' as 'coef***'."""
    p = F.regexp_extract(coefficient_and_p, r"\(([^)]*)\)", 1).try_cast("double")
    return F.concat(F.trim(F.regexp_extract(coefficient_and_p, r"^([^(]*)", 1)), stars(p))


def coefficient_text(coef: Column, t: Column, p: Column) -> Column:
    """coef(t)*** with three decimals; thresholds count as below."""
    mark = F.when(p <= 0.001, "***").when(p <= 0.01, "**").when(p <= 0.05, "*").otherwise("")
    return F.concat(F.format_string("%.3f", coef), F.lit("("), F.format_string("%.3f", t), F.lit(")"), mark)


def parse_starred(s: Column) -> tuple[Column, Column]:
    """The value and the number of stars of '12.3***'."""
    return F.regexp_replace(s, r"\*", "").try_cast("double"), F.length(F.regexp_replace(s, r"[^*]", ""))


def id_of(*parts: Sequence[Column], length: int = 6) -> Column:
    """md5 prefixes of several texts, joined by a hyphen; None for a null."""
    return F.concat_ws("-", *(F.coalesce(F.substring(F.md5(p.cast("binary")), 1, length), F.lit("None")) for p in parts))


def inverted(m: Column) -> Column:
    """Values to keys; of equal values the greatest key stays."""
    entries = F.array_sort(F.transform(F.map_entries(m), lambda e: F.struct(e["value"].alias("value"), e["key"].alias("key"))))
    last = F.filter(entries, lambda e, i: F.get(entries, i + 1).isNull() | (F.get(entries, i + 1)["value"] != e["value"]))
    return F.map_from_entries(last)


def sorted_map(m: Column) -> Column:
    """Entries sorted by key, as an array of structs."""
    return F.array_sort(F.map_entries(m))


def all_ints(a: Column) -> Column:
    return F.forall(a, lambda x: x.try_cast("long").isNotNull())


def plain_country(s: Column) -> Column:
    """Lower case without accents; other characters become spaces; trimmed."""
    accents = ("áàâäãåéèêëíìîïóòôöõúùûüçñ", "aaaaaaeeeeiiiiooooouuuucn")
    return F.trim(F.regexp_replace(F.translate(F.lower(s), *accents), r"[^a-z\s]", " "))


def metres_to_degrees(metres: Column, latitude: Column) -> Column:
    """The larger of the steps in latitude and longitude; null outside its domain."""
    k = 111_132.95
    step = F.greatest(metres / k, metres / (F.lit(k) * F.cos(F.radians(latitude))))
    return F.when((metres >= 0) & (F.abs(latitude) < 90), step)


def time_id(first: Column, last: Column) -> Column:
    """1995 and 2020 as 199520."""
    return F.concat(first.cast("string"), F.substring(last.cast("string"), -2, 2))


def tag(c: Column, source: Mapping[str, str], target: Mapping[str, str]) -> Column:
    """A tag of one set in another through a common set; X if unknown."""
    to = {k: target.get(v, "X") for k, v in source.items()}
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in to.items() for x in kv)), c), F.lit("X"))


def beta_density(x: Column, alpha: float, beta: float, a: float, b: float) -> Column:
    """The generalised beta density on [a, b], 0 outside."""
    constant = math.exp(math.lgamma(alpha + beta) - math.lgamma(alpha) - math.lgamma(beta)) / (b - a) ** (alpha + beta - 1)
    return F.when((x >= a) & (x <= b), constant * F.pow(x - a, F.lit(alpha - 1)) * F.pow(b - x, F.lit(beta - 1))).otherwise(0.0)


def decoded(b: Column) -> Column:
    """Bytes as UTF-8, or as windows-1252 where they are not valid."""
    high = [(chr(i), bytes([i]).decode("windows-1252", "ignore")) for i in range(0x80, 0xA0)]  # where it differs from Latin-1
    high = [(x, y) for x, y in high if y]
    latin = F.translate(F.decode(b, "iso-8859-1"), "".join(x for x, _ in high), "".join(y for _, y in high))
    return F.coalesce(F.try_validate_utf8(b.cast("string")), latin)
