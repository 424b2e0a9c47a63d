"""Rows from texts of records: calendars and regression logs, parsed by table functions, and nested JSON."""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Names of an event's properties and the columns they go to: first texts, then times.
TEXTS = {
    "UID": "uid", "SUMMARY": "summary", "ORGANIZER": "organizer", "LOCATION": "location", "STATUS": "status", "DESCRIPTION": "description", "URL": "url", "TRANSP": "transp",
    "SEQUENCE": "sequence", "RRULE": "rrule", "RECURRENCE-ID": "recurrence_id", "EXDATE": "exdate", "CLASS": "class", "ATTACH": "attach",
}
TIMES = {"DTSTART": "start", "DTEND": "end", "LAST-MODIFIED": "last_modified", "DTSTAMP": "dtstamp", "CREATED": "created"}


def calendar_events(text: str) -> Iterator[tuple]:
    """The texts, times and attendees of each event of an iCalendar text; texts that are not there are empty, times null."""
    lines = re.sub(r"\r?\n[ \t]", "", text or "").splitlines()  # a line that begins with a space goes on the one before
    now: dict | None = None
    for line in lines:
        name, _, value = line.partition(":")
        key = name.split(";")[0].upper()
        if line.strip().upper() == "BEGIN:VEVENT":
            now = {"ATTENDEE": []}
        elif line.strip().upper() == "END:VEVENT" and now is not None:
            yield (*(now.get(k, "") for k in TEXTS), *(_time(now.get(k)) for k in TIMES), now["ATTENDEE"])
            now = None
        elif now is not None and value:
            value = re.sub(r"(?i)^mailto:", "", value).replace("\\,", ",").replace("\\n", "\n").replace("\\;", ";")
            if key == "ATTENDEE":
                now[key].append(value)
            else:
                now.setdefault(key, value)


def _time(value: str | None) -> datetime | None:
    for form in ("%Y%m%dT%H%M%SZ", "%Y%m%dT%H%M%S", "%Y%m%d"):
        try:
            return datetime.strptime(value or "", form)
        except ValueError:
            continue
    return None


EVENT_SCHEMA = ", ".join([*(f"`{c}` string" for c in TEXTS.values()), *(f"`{c}` timestamp" for c in TIMES.values()), "attendees array<string>"])


class CalendarEvents:
    def eval(self, text: str):
        yield from calendar_events(text)


#: A row of a coefficient table: name | coefficient, standard error, statistic, p value, interval.
COEFFICIENT = re.compile(r"^\s*([\w.~]+)\s*\|\s*(-?[\d.]+(?:e[+-]?\d+)?)\s+(-?[\d.]+(?:e[+-]?\d+)?)\s+(-?[\d.]+)\s+([\d.]+)\s+(-?[\d.]+(?:e[+-]?\d+)?)\s+(-?[\d.]+(?:e[+-]?\d+)?)\s*$", re.M)
MODEL = re.compile(r"^\. ?(\w+) +(\w+) +(.*)$", re.M)


def log_coefficients(text: str) -> Iterator[tuple]:
    """(model, command, dependent, term, coef, se, t, p, low, high) of each coefficient row of a regression log."""
    marks = [*MODEL.finditer(text or "")]
    for k, m in enumerate(marks):
        end = marks[k + 1].start() if k + 1 < len(marks) else len(text)
        for row in COEFFICIENT.finditer(text, m.end(), end):
            yield (k, m[1], m[2], row[1], *(float(x) for x in row.groups()[1:]))


LOG_SCHEMA = "model int, command string, dependent string, term string, coef double, se double, t double, p double, low double, high double"


class LogCoefficients:
    def eval(self, text: str):
        yield from log_coefficients(text)


#: 'Name = number' in a model's head, and rows like 'sigma_u | 1.5' below its coefficients.
PAIR = re.compile(r"([A-Za-z][\w.,()\-> |]*?)\s*=\s*(-?[\d,]*\.?\d+(?:e[+-]?\d+)?)(?![\w.])")
TAIL = re.compile(r"^\s*(sigma_u|sigma_e|rho)\s*\|\s*(-?[\d.]+(?:e[+-]?\d+)?)", re.M)
CELL = re.compile(r"-?(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?\*?|\.")


def _parts(text: str | None) -> Iterator[tuple[int, str, str, str]]:
    """(number, command, first argument, text) of each command of a log."""
    marks = [*MODEL.finditer(text or "")]
    for k, m in enumerate(marks):
        yield k, m[1], m[2], text[m.end() : marks[k + 1].start() if k + 1 < len(marks) else len(text)]


def log_statistics(text: str) -> Iterator[tuple]:
    """(model, command, name, value) of the numbers that a log gives by name: rows, groups, R-squared, tests, variances."""
    for k, command, _, part in _parts(text):
        for m in PAIR.finditer(part):
            yield k, command, re.sub(r"\s+", " ", m[1]).strip(" |"), float(m[2].replace(",", ""))
        for m in TAIL.finditer(part):
            yield k, command, m[1], float(m[2])


def log_tables(text: str) -> Iterator[tuple]:
    """(model, command, row, column, value, marked) of tables 'names | columns': summaries, correlations, inflation factors, unit roots.

    A row that a table has no headings for is left to log_coefficients; '.' is a missing value.
    """
    for k, command, _, part in _parts(text):
        heads: list[str] = []
        for line in part.splitlines():
            left, bar, right = line.partition("|")
            if not bar:
                continue
            cells = right.split()
            if cells and not all(CELL.fullmatch(c) for c in cells):
                heads = re.split(r"\s{2,}", right.strip())
            elif heads and cells and left.strip():
                for head, cell in zip(heads, cells, strict=False):
                    yield k, command, left.strip(), head, None if cell == "." else float(cell.rstrip("*")), cell.endswith("*")


class LogStatistics:
    def eval(self, text: str):
        yield from log_statistics(text)


class LogTables:
    def eval(self, text: str):
        yield from log_tables(text)


def log_identity(path: Column) -> Column:
    """(tag, type, group, id) of a log from its file name tag_type_group_id.log."""
    parts = F.split(F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.log$", ""), "_")
    return F.struct(*(F.get(parts, F.lit(k)).alias(n) for k, n in enumerate(("tag", "type", "group", "id"))))


def register(spark: SparkSession) -> None:
    """Make calendar_events(text) and log_coefficients(text) table functions of the session."""
    spark.udtf.register("calendar_events", F.udtf(CalendarEvents, returnType=EVENT_SCHEMA))
    spark.udtf.register("log_coefficients", F.udtf(LogCoefficients, returnType=LOG_SCHEMA))
    spark.udtf.register("log_statistics", F.udtf(LogStatistics, returnType="model int, command string, name string, value double"))
    spark.udtf.register("log_tables", F.udtf(LogTables, returnType="model int, command string, row string, column string, value double, marked boolean"))


def parsed(df: DataFrame, function: str, text: str, keys: list[str]) -> DataFrame:
    """The keys beside the rows of a registered table function of a text column."""
    register(df.sparkSession)
    cols = ", ".join(f"s.`{k}`" for k in keys)
    return df.sparkSession.sql(f"SELECT {cols}{', ' if cols else ''}r.* FROM {{df}} s, LATERAL {function}(s.`{text}`) r", df=df)


PLACES = "places array<struct<id: string, displayName: struct<text: string>, location: struct<latitude: double, longitude: double, lat: double, lng: double>, types: array<string>, rating: double, userRatingCount: int>>"


def places(df: DataFrame, keys: list[str], json: str) -> DataFrame:
    """(keys, id, name, latitude, longitude, types, rating, ratings) of each place of a response; absent fields get '', 0 or -1."""
    each = df.select(*keys, F.explode(F.from_json(json, PLACES)["places"]).alias("p"))
    loc = F.col("p.location")
    return each.select(
        *keys, F.coalesce("p.id", F.lit("")).alias("id"), F.coalesce("p.displayName.text", F.lit("")).alias("name"),
        F.coalesce(loc["latitude"], loc["lat"], F.lit(0.0)).alias("latitude"), F.coalesce(loc["longitude"], loc["lng"], F.lit(0.0)).alias("longitude"),
        F.coalesce(F.concat_ws(",", "p.types"), F.lit("")).alias("types"), F.coalesce("p.rating", F.lit(-1.0)).alias("rating"),
        F.coalesce("p.userRatingCount", F.lit(0)).alias("ratings"),
    )


def json_number(c: Column, path: str) -> Column:
    return F.get_json_object(c, path).try_cast("double")
