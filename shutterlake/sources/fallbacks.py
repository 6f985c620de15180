"""Media fields from one reader after another: headers, XMP packets, IPTC dates.

Only what a reader leaves open is asked of the next one. All readers are
expressions on one row, so a file's bytes are neither shuffled nor read again,
and a file that is complete never has its packet looked for. What several fields
are taken from (a packet's parsed tree, a property's text) is a column of its own:
an expression that is repeated in a branch is computed as often as it stands there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterlake.functions.geo import iso6709
from shutterlake.sources import headers

# Names of XMP properties by field, the better first.
XMP = {"width": ("PixelXDimension", "ImageWidth"), "height": ("PixelYDimension", "ImageLength"), "taken": ("DateTimeOriginal", "CreateDate"), "lat": ("GPSLatitude",), "lon": ("GPSLongitude",)}
FIELDS = ("width", "height", "orientation", "taken", "lat", "lon", "seconds")


def _packet(content: Column) -> Column:
    """The text of the first XMP packet; null if there is none."""
    text = F.decode(content, "ISO-8859-1")
    start = F.instr(text, "<x:xmpmeta")
    rest = text.substr(start, F.length(text))
    end = F.instr(rest, "</x:xmpmeta>")
    return F.when((start > 0) & (end > 0), rest.substr(F.lit(1), end + 11))


def _descriptions(content: Column) -> Column:
    """The descriptions of the first XMP packet, an array of its properties as text."""
    names = [n for some in XMP.values() for n in some]
    description = ", ".join(f"`_{n}`: string, `{n}`: string" for n in names)
    return F.from_xml(_packet(content), f"RDF struct<Description: array<struct<{description}>>>", {"ignoreNamespace": "true"})["RDF"]["Description"]


def _first(every: Column, some: tuple[str, ...]) -> Column:
    """The first text of the properties ``some``; each is an attribute or an element of any description."""
    found = [F.filter(F.transform(every[c], lambda x: F.trim(x)), lambda x: x != "") for n in some for c in (f"_{n}", n)]
    return F.coalesce(*[F.get(e, 0) for e in found])


def _degrees(text: Column, letters: str) -> Column:
    """Degrees of "48,51.396N" or "48,51,24N"; null else."""
    form = rf"^(\d{{1,3}}),(\d{{1,2}}(?:\.\d+)?)(?:,(\d{{1,2}}(?:\.\d+)?))?([{letters}])$"
    part = [F.regexp_extract(text, form, i) for i in range(1, 5)]
    size = part[0].try_cast("double") + part[1].try_cast("double") / 60 + F.coalesce(part[2].try_cast("double"), F.lit(0.0)) / 3600
    most = 90 if "N" in letters else 180
    return F.when(text.rlike(form) & (size <= most), F.when(part[3].isin("S", "W"), -size).otherwise(size))


def _iso_date(text: Column) -> Column:
    form = r"^\d{4}-\d\d-\d\dT\d\d:\d\d(?::(\d\d))?"
    day = F.translate(F.substring(text, 1, 16), "-T", ": ")
    second = F.regexp_extract(text, form, 1)
    return F.when(text.rlike(form), F.concat(day, F.lit(":"), F.rpad(second, 2, "0")))


def _iptc_date(content: Column) -> Column:
    """Date and time of creation in a Photoshop resource of IPTC records; midnight if it has a date alone."""
    text = F.decode(content, "ISO-8859-1")
    start = F.instr(text, "8BIM\x04\x04")
    rest = F.when(start > 0, text.substr(start, F.length(text)))
    day, at = (F.regexp_extract(rest, form, 1) for form in ("\x1c\x027\x00\x08(\\d{8})", "\x1c\x02<\x00\x0b(\\d{6})[+-]\\d{4}"))
    at = F.when(at == "", "000000").otherwise(at)

    def cut(x: Column, *ends: int) -> Column:
        return F.concat_ws(":", *[F.substring(x, a + 1, b - a) for a, b in zip(ends, ends[1:])])

    return F.when(day != "", F.concat(cut(day, 0, 4, 6, 8), F.lit(" "), cut(at, 0, 2, 4, 6)))


def probed_in_turn(files: DataFrame) -> DataFrame:
    """path, FIELDS, size_by, taken_by, place_by, asked of media files (path, content), all of them.

    ``*_by`` names the reader (header, xmp, iptc) that had the size, the date and
    the place; a size and a place come whole from one reader. ``asked`` is the
    number of readers that a file needed: XMP is asked for what headers leave
    open, IPTC for a date. Damaged packets and null contents give nulls.
    """
    c = F.col("content")
    read = headers.fixed_sizes(files)
    chained = F.when(F.col("kind").isin(*headers.CHAINED), c)
    read = read.withColumn("_h", headers.fields(chained))
    spot = iso6709(F.col("_h.place"))
    own = {n: F.col(f"_h.{n}") for n in FIELDS}
    own |= {n: F.coalesce(own[n], F.col(n)) for n in ("width", "height")} | {n: F.coalesce(own[n], spot[n]) for n in ("lat", "lon")}
    rows = read.withColumns({f"_{n}": x for n, x in own.items()})

    sized, dated, there = (F.col("_width") > 0) & (F.col("_height") > 0), F.col("_taken").isNotNull(), F.col("_lat").isNotNull() & F.col("_lon").isNotNull()
    sized = F.coalesce(sized, F.lit(False))
    rows = rows.withColumn("_open", ~(sized & dated & there))
    rows = rows.withColumn("_every", F.when(F.col("_open"), _descriptions(c)))
    rows = rows.withColumns({f"_x_{n}": _first(F.col("_every"), some) for n, some in XMP.items()})
    x = {n: F.col(f"_x_{n}").try_cast("int") for n in ("width", "height")} | {"taken": _iso_date(F.col("_x_taken")), "lat": _degrees(F.col("_x_lat"), "NS"), "lon": _degrees(F.col("_x_lon"), "EW")}
    rows = rows.withColumns({f"_x_{n}": e for n, e in x.items()})
    x = {n: F.col(f"_x_{n}") for n in x}
    x_size, x_place = (x["width"] > 0) & (x["height"] > 0), x["lat"].isNotNull() & x["lon"].isNotNull()
    size_by = F.when(sized, "header").when(x_size, "xmp")
    place_by = F.when(there, "header").when(x_place, "xmp")
    rows = rows.withColumns({"size_by": size_by, "place_by": place_by, "_dated": F.when(dated, "header").when(x["taken"].isNotNull(), "xmp")})
    rows = rows.withColumn("_i", F.when(F.col("_dated").isNull(), _iptc_date(c)))

    def chosen(n: str, by: str) -> Column:
        return F.when(F.col(by) == "header", F.col(f"_{n}")).when(F.col(by) == "xmp", x[n]).alias(n)

    taken = F.coalesce("_taken", "_x_taken", "_i").alias("taken")
    taken_by = F.coalesce("_dated", F.when(F.col("_i").isNotNull(), "iptc")).alias("taken_by")
    asked = F.when(~F.col("_open"), 1).when(F.col("_dated").isNotNull(), 2).otherwise(3).alias("asked")
    return rows.select("path", chosen("width", "size_by"), chosen("height", "size_by"), F.col("_orientation").alias("orientation"), taken, chosen("lat", "place_by"), chosen("lon", "place_by"), F.col("_seconds").alias("seconds"), "size_by", taken_by, "place_by", asked)
