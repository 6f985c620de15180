"""Column functions on text: chunks, word prefixes, versions, number lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def chunks(text: Column, size: int = 700, overlap: int = 70, most: int | None = None) -> Column:
    """Array of overlapping chunks of a whole text, or of its first ``most`` ones; none of a null text.

    A text is cut into stretches of 64 chunks first, as the place of a character
    is found by counting from the start of a string.
    """
    step = size - overlap
    n = F.ceil(F.length(text) / step)
    n = F.least(n, F.lit(most)) if most is not None else n

    def upto(last: Column) -> Column:
        return F.when(last > 0, F.sequence(F.lit(0).cast("long"), last - 1)).otherwise(F.array().cast("array<bigint>"))

    def stretch(b: Column) -> Column:
        part = F.substring(text, (b * 64 * step + 1).cast("int"), F.lit(64 * step + overlap))
        return F.transform(upto(F.least(F.lit(64).cast("long"), n - b * 64)), lambda i: F.substring(part, (i * step + 1).cast("int"), F.lit(size)))

    return F.flatten(F.transform(upto(F.ceil(n / 64)), stretch))


def words(query: str) -> list[str]:
    """Lower-case words of a query, white space simplified."""
    return query.lower().split()


def prefix_match(name: Column, query: str) -> Column:
    """2 if a query of several words starts the name, 1 if a word of the name starts with its last word, else 0."""
    typed = words(query)
    low = F.lower(name)
    any_word = F.exists(F.split(low, r"[\s,/_-]+"), lambda w: w.startswith(typed[-1]))
    phrase = low.startswith(" ".join(typed)) if len(typed) > 1 else F.lit(False)
    return F.when(phrase, 2).when(any_word, 1).otherwise(0)


def version_key(text: Column) -> Column:
    """Sortable (valid, major, minor, patch, release) of a version like v1.2.3-beta; null parts of an invalid one."""
    form = r"^v?(\d+)\.(\d+)\.(\d+)(-[0-9A-Za-z.-]+)?$"
    part = [F.nullif(F.regexp_extract(text, form, i), F.lit("")).try_cast("long") for i in (1, 2, 3)]
    valid = F.coalesce(text.rlike(form), F.lit(False))
    release = valid & (F.regexp_extract(text, form, 4) == "")
    return F.struct(valid.alias("valid"), *[p.alias(n) for p, n in zip(part, ("major", "minor", "patch"), strict=True)], release.alias("release"))


def numbers_of(csv: Column) -> Column:
    return F.transform(F.filter(F.split(csv, ","), lambda x: x != ""), lambda x: x.try_cast("double"))


def csv_of(numbers: Column, most: int = 400) -> Column:
    """The last ``most`` numbers with four decimals, comma-joined."""
    last = F.when(F.size(numbers) > most, F.slice(numbers, -most, most)).otherwise(numbers)
    return F.array_join(F.transform(last, lambda x: F.format_string("%.4f", x)), ",")


def section(text: Column, part: int) -> Column:
    """First (1) or last (-1) part of a ", "-separated text."""
    return F.element_at(F.split(text, ", "), part)
