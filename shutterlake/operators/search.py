"""Keyword search over a library and its suggestions.

The query is short and typed by hand; what it names is resolved against small
dimension tables, and the result is one lazy plan of predicates and semi-joins.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterlake.functions import dates, paths
from shutterlake.functions.media import COLOURS
from shutterlake.functions.text import prefix_match, words
from shutterlake.operators.filters import media_where, path_contains

# English month names.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


@dataclass
class Facets:
    """What a query asks for besides free words."""

    colours: list[int] = field(default_factory=list)
    years: list[int] = field(default_factory=list)
    months: list[int] = field(default_factory=list)
    rest: list[str] = field(default_factory=list)


def month_of(word: str) -> int | None:
    """A month by a prefix of three letters or more."""
    return next((i for i, m in enumerate(MONTHS, 1) if len(word) >= 3 and m.startswith(word)), None)


def parse(query: str) -> Facets:
    """Colours, years and months of a query; other words stay."""
    out = Facets()
    for w in words(query):
        if w in COLOURS or w == "grey":
            out.colours.append(12 if w == "grey" else COLOURS.index(w) + 1)
        elif re.fullmatch(r"(19|20)\d\d", w):
            out.years.append(int(w))
        elif month_of(w):
            out.months.append(month_of(w))
        else:
            out.rest.append(w)
    return out


def people_named(persons: DataFrame, query: str) -> DataFrame:
    """Visible people whose full name stands in the query, or whose first name (three letters or more) is a word of it."""
    name = F.lower(F.trim("name"))
    first = F.substring_index(name, " ", 1)
    q = " ".join(words(query))
    named = F.contains(F.lit(f" {q} "), F.concat(F.lit(" "), name, F.lit(" "))) | ((F.length(first) >= 3) & first.isin(*words(query)))
    return persons.filter((F.col("hidden") == 0) & (F.trim(F.coalesce("name", F.lit(""))) != "") & named)


def words_of_names(people: DataFrame, query: str) -> set[str]:
    """Words of the query that stand in a name of ``people``, over all of them; no more come back than the query has."""
    own = F.array_intersect(F.split(F.lower(F.trim("name")), r"(?U)[\s\x1c-\x1f]+"), F.array(*map(F.lit, words(query))).cast("array<string>"))
    return {r["w"] for r in people.select(F.explode(own).alias("w")).distinct().collect()}


def places_named(places: DataFrame, rest: list[str]) -> DataFrame:
    """Media (id) whose town (three letters or more) or country (four or more) stands in the rest of the query."""
    phrase = " ".join(rest)

    def said(c: str, least: int) -> Column:
        return (F.length(c) >= least) & F.contains(F.lit(phrase), F.lower(c))

    return places.filter(said("city", 3) | said("country", 4)).select("id")


def search(media: DataFrame, query: str, persons: DataFrame, faces: DataFrame, analysis: DataFrame, places: DataFrame) -> DataFrame:
    """Media that meet every facet of the query (any value within a facet); without one, a file name search."""
    people = people_named(persons, query)
    consumed = words_of_names(people, query)
    facets = parse(" ".join(w for w in words(query) if w not in consumed))
    out, structured = media, False
    if consumed:  # whoever is named shares a word with the query
        ids = faces.join(people.select(F.col("id").alias("person_id")), "person_id", "left_semi").select(F.col("media_id").alias("id"))
        out, structured = out.join(ids, "id", "left_semi"), True
    if facets.colours:
        ids = analysis.filter(F.col("color_bucket").isin(*facets.colours)).select(F.col("media_id").alias("id"))
        out, structured = out.join(ids, "id", "left_semi"), True
    where = F.lit(True)
    for values, pattern in ((facets.years, "yyyy"), (facets.months, "MM")):
        if values:
            where = where & (F.col("creation_date") > 0) & dates.key(F.col("creation_date"), pattern).isin(*[f"{v:0{len(pattern)}d}" for v in values])
            structured = True
    found = places_named(places, facets.rest) if facets.rest else None
    if found is not None and found.limit(1).count():
        out, structured = out.join(found, "id", "left_semi"), True
    if structured:
        return media_where(out, where)
    return media_where(media, path_contains(" ".join(facets.rest)), limit=600)


def album_chips(media: DataFrame, rest: str, n: int = 6) -> DataFrame:
    """Folders whose name holds the rest of a query of three letters or more."""
    leaf = paths.base_name(F.col("folder_path"))
    rows = media.select("folder_path").distinct().filter(F.contains(F.lower(leaf), F.lit(rest.lower())) & F.lit(len(rest) >= 3))
    return rows.orderBy("folder_path").limit(n)


def suggest(query: str, persons: DataFrame, places: DataFrame, media: DataFrame, n: int = 8) -> DataFrame:
    """kind, label: completions in the order of kinds; nothing once the last word is finished."""
    spark = media.sparkSession
    fixed = [(4, "colour", c) for c in COLOURS] + [(5, "month", m.capitalize()) for m in MONTHS]
    months = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(p).alias("prio"), F.lit(k).alias("kind"), F.lit(x).alias("label")) for p, k, x in fixed])).alias("c")).select("c.*")
    arms = [
        persons.filter("hidden = 0 and name is not null").select(F.lit(0).alias("prio"), F.lit("person").alias("kind"), F.trim("name").alias("label")),
        places.select(F.lit(1).alias("prio"), F.lit("place").alias("kind"), F.col("city").alias("label")).distinct(),
        places.select(F.lit(2).alias("prio"), F.lit("country").alias("kind"), F.col("country").alias("label")).distinct(),
        media.select(F.lit(3).alias("prio"), F.lit("album").alias("kind"), paths.base_name(F.col("folder_path")).alias("label")).distinct(),
        months,
        media.filter("creation_date > 0").select(F.lit(6).alias("prio"), F.lit("year").alias("kind"), dates.key(F.col("creation_date"), "yyyy").alias("label")).distinct(),
    ]
    rows = arms[0]
    for more in arms[1:]:
        rows = rows.unionByName(more)
    typed = query.strip() != "" and not query.endswith(" ")
    rows = rows.filter(F.lit(typed) & (prefix_match(F.col("label"), query if query.strip() else "?") > 0))
    best = rows.groupBy(F.lower("label").alias("key")).agg(F.min(F.struct("prio", "kind", "label")).alias("b")).select("b.*")
    return best.orderBy("prio", "label").limit(n)
