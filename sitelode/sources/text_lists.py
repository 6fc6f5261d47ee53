"""Seed lists and pattern files."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from sitelode.operators.quality import address_error

MOST_PATTERNS = 2000
FLAGS = "ims"


@dataclass(frozen=True)
class Pattern:
    category_no: int
    category: str
    regex: str
    flags: str


def seed_parse(lines: DataFrame) -> DataFrame:
    """(line, address, error, is_valid) of the entries of a seed list (column `value`).

    Blank lines and lines that start with `#` carry no entry; the address is the
    host of the line's URL, or the bare line when it has no scheme.
    """
    text = F.trim("value")
    entry = lines.select(text.alias("line")).filter((F.col("line") != "") & ~F.col("line").startswith("#"))
    address = F.regexp_extract("line", r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/?#@\s]*@)?([^/:?#\s]+)", 1)
    return (
        entry.withColumn("address", F.lower(address))
        .withColumn("error", address_error("address"))
        .withColumn("is_valid", F.col("error").isNull())
    )


def pattern_parse(text: str) -> list[Pattern]:
    """Patterns of a pattern file: `# Category N: name` heads a group of `/regex/flags` lines.

    Matching ignores case; further flags are `m` and `s`. Blank lines and other lines that
    start with `#` are passed over. Any line that is none of these raises with its number, so no
    pattern is lost unnoticed.
    """
    patterns: list[Pattern] = []
    number, name = 0, ""
    for at, line in enumerate(map(str.strip, text.splitlines()), 1):
        heading = re.fullmatch(r"#\s*Category\s+(\d+)\s*:\s*(.+)", line)
        entry = re.fullmatch(r"/(.+)/([A-Za-z]*)", line)
        if heading:
            number, name = int(heading[1]), heading[2].strip()
        elif entry and set(entry[2]) <= set(FLAGS) and number:
            patterns.append(Pattern(number, name, entry[1], "".join(f for f in FLAGS if f == "i" or f in entry[2])))
        elif line and not line.startswith("#"):
            raise ValueError(f"line {at} of the pattern file is no pattern under a category: {line!r}")
    return patterns


def read_patterns(spark: SparkSession, path: str, most: int = MOST_PATTERNS) -> list[Pattern]:
    """Read a pattern file. Each pattern becomes a column of the query plan, so their number is checked."""
    patterns = pattern_parse(spark.read.text(path, wholetext=True).first()["value"])
    if len(patterns) > most:
        raise ValueError(f"{len(patterns)} patterns, more than {most}")
    return patterns


def patterns_frame(spark: SparkSession, patterns: list[Pattern]) -> DataFrame:
    rows = [(p.category_no, p.category, p.regex, p.flags) for p in patterns]
    return spark.createDataFrame(rows, "category_no int, category string, pattern string, flags string")
