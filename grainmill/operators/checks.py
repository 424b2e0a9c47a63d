"""Checks of a table's shape and content: one small job each, or none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ArgumentStructureError

PERIOD, GRAM = r"^\(\d{4}, \d{4}\)$", r"^(\d+)_(\d+)-Gram$"


def flow_problems(flows: DataFrame) -> DataFrame:
    """(period, ngram, problem) for what is wrong in a long table of flows (period, ngram, gram, count)."""
    low, high = (F.regexp_extract("ngram", GRAM, k).cast("int") for k in (1, 2))
    problem = (
        F.when(~F.coalesce(F.col("period").rlike(PERIOD), F.lit(False)), "period").when(~F.coalesce(F.col("ngram").rlike(GRAM), F.lit(False)), "ngram").when(low > high, "order")
    )
    return flows.select("period", "ngram", problem.alias("problem")).where("problem IS NOT NULL").distinct()


def check_flows(flows: DataFrame) -> DataFrame:
    """The table itself, or an error that names the first problem."""
    missing = [c for c in ("period", "ngram", "gram", "count") if c not in flows.columns]
    if missing:
        raise ArgumentStructureError(f"no column {', '.join(missing)}")
    if not isinstance(flows.schema["gram"].dataType, T.StringType):
        raise ArgumentStructureError("gram must be text")
    if not isinstance(flows.schema["count"].dataType, T.NumericType):
        raise ArgumentStructureError("count must be a number")
    bad = flow_problems(flows).orderBy("period", "ngram").first()
    if bad:
        raise ArgumentStructureError(f"{bad.problem} of {bad.period}, {bad.ngram}")
    return flows
