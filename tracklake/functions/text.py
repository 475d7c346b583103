"""Text expressions: labels, categories, file names and names with accents."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@cache
def _marks() -> re.Pattern:
    """All non-spacing marks, in ranges."""
    codes = [k for k in range(sys.maxunicode + 1) if unicodedata.category(chr(k)) == "Mn"]
    known = set(codes)
    starts, ends = ([k for k in codes if k + step not in known] for step in (-1, 1))
    return re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(starts, ends)) + "]+")


def _plain(text: str | None) -> str | None:
    return text if text is None or text.isascii() else _marks().sub("", unicodedata.normalize("NFD", text))


def strip_accents(text: Column) -> Column:
    """The text decomposed canonically, without its non-spacing marks (Unicode's as Python has them)."""
    return F.pandas_udf(lambda texts: texts.map(_plain), "string")(text)


def normalize_number(text: Column) -> Column:
    """Trimmed; empty becomes null; a whole number written as 9.0 becomes 9."""
    trimmed = F.trim(text.cast("string"))
    return F.when(trimmed == "", F.lit(None).cast("string")).otherwise(F.regexp_replace(trimmed, r"^([0-9]+)\.0+$", "$1"))


def player_key(team: Column, name: Column, number: Column) -> Column:
    joined = F.concat_ws("|", F.coalesce(team, F.lit("")), F.coalesce(name, F.lit("")), F.coalesce(number, F.lit("NA")))
    return F.translate(joined, "/", "_")


def display_name(name: Column, number: Column) -> Column:
    return F.when(number.isNull(), name).otherwise(F.concat(F.lit("#"), number, F.lit(" "), name))


def parse_category(category: Column) -> Column:
    """struct(jersey, name, visible, role) of an annotation category.

    Without a number the remaining text is the name; the root category has neither.
    """
    text = F.trim(category)
    tracked, keeper = text.startswith("for tracker "), text.startswith("Goalkeeper ")
    rest = F.when(tracked | keeper, F.regexp_replace(text, r"^(for tracker|Goalkeeper) ", "")).otherwise(text)
    number = F.nullif(F.regexp_extract(rest, r"^([0-9]+)\s+.", 1), F.lit(""))
    after = F.trim(F.regexp_extract(rest, r"^[0-9]+\s+(.+)", 1))
    unnumbered = F.when(tracked, F.trim(rest)).otherwise(text)
    root, referee = text == "Player-Detection", text == "referee"
    name = F.when(root, F.lit(None).cast("string")).when(referee, "Referee").when(number.isNotNull(), after).otherwise(unnumbered)
    return F.struct(
        number.alias("jersey"),
        strip_accents(name).alias("name"),
        (number.isNotNull() & ~tracked).alias("visible"),
        F.when(root, "root").when(referee, "referee").when(keeper & number.isNotNull(), "goalkeeper").otherwise("player").alias("role"),
    )


def frame_of_file(file_name: Column, per_second: int = 30, last: int = 899) -> Column:
    """Frame from the second in a file name, at most ``last``; -1 without one."""
    second = F.regexp_extract(file_name, r"mp4-([0-9]{4})", 1)
    return F.when(second == "", F.lit(-1)).otherwise(F.least(F.lit(last), second.try_cast("int") * per_second))


def digit_runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"([0-9]+)"), F.lit(1))


def digit_run_places(text: Column) -> Column:
    """array<struct(start, run)> of the digit runs, starts from 0 in characters."""
    parts = F.regexp_extract_all(text, F.lit(r"([^0-9]+|[0-9]+)"), F.lit(1))
    none = F.array().cast("array<struct<start:int,run:string>>")

    def step(a: Column, part: Column) -> Column:
        found = F.array(F.struct(a["at"].alias("start"), part.alias("run")))
        return F.struct((a["at"] + F.length(part)).alias("at"), F.when(part.rlike("^[0-9]"), F.concat(a["out"], found)).otherwise(a["out"]).alias("out"))

    return F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda a: a["out"])


def contains_either(a: Column, b: Column) -> Column:
    return F.contains(a, b) | F.contains(b, a)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(strip_accents(text)), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")
