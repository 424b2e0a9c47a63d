"""Search requests as JSON columns, checked while the plan is built."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ArgumentTypeError, ArgumentValueError


def _checked(metres: float, language: str) -> None:
    if metres <= 0:
        raise ArgumentValueError("the distance must be positive")
    if not isinstance(language, str):
        raise ArgumentTypeError("the language is a text")


def nearby(lon: Column, lat: Column, metres: float, kind: str, key: str = "", language: str = "en") -> Column:
    """The older form: every value a text."""
    _checked(metres, language)
    if not isinstance(kind, str) or not kind:
        raise ArgumentValueError("the type is a text that is not empty")
    at = F.concat_ws(", ", lat.cast("string"), lon.cast("string"))
    return F.to_json(F.struct(at.alias("location"), F.lit(str(metres)).alias("radius"), F.lit(kind).alias("type"), F.lit(key).alias("key"), F.lit(language).alias("language")))


def nearby_circle(lon: Column, lat: Column, metres: float, kinds: Sequence[str] = (), most: int = 20, language: str = "en") -> Column:
    """The newer form: types, a bound on the results, and a circle."""
    _checked(metres, language)
    if len(language) != 2 or most <= 0:
        raise ArgumentValueError("a language of two letters and a positive number of results")
    center = F.struct(lat.cast("double").alias("latitude"), lon.cast("double").alias("longitude"))
    circle = F.struct(F.struct(center.alias("center"), F.lit(float(metres)).alias("radius")).alias("circle"))
    types = F.array(*(F.lit(k) for k in kinds)).cast("array<string>")
    return F.to_json(F.struct(types.alias("includedTypes"), F.lit(most).alias("maxResultCount"), circle.alias("locationRestriction"), F.lit(language).alias("languageCode")))
