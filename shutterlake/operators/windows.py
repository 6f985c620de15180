"""Runs, sessions, offsets and interleavings over ordered media."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shutterlake.functions import dates, geo
from shutterlake.operators import sorting
from shutterlake.operators.aggregates import home_cell
from shutterlake.operators.filters import alive

TRIP_KM, TRIP_GAP, TRIP_LEAST, TRIPS = 120.0, 259200, 4, 12


def month_rows(media: DataFrame, block_rows: int = sorting.BLOCK_ROWS) -> DataFrame:
    """id, month, position (and all columns) of media newest first: position counts within the month.

    A month's media are consecutive in this order, so a position is the place in
    the whole order less the month's start; no window holds a month.
    """
    rows = media.withColumn("month", dates.key(F.col("creation_date"), "yyyy-MM"))
    rows = sorting.placed(rows, [(F.col("creation_date"), False), (F.col("id"), False)], block_rows)
    starts = month_starts(media).select(F.col("month").alias("_month"), F.col("start").alias("_start"))
    return rows.join(starts, F.col("month").eqNullSafe(F.col("_month"))).withColumn("position", F.col("place") - 1 - F.col("_start")).drop("place", "_month", "_start")


def month_starts(media: DataFrame) -> DataFrame:
    """Each month's header: label, media, and how many media stand before it, newest month first."""
    by = media.groupBy(dates.key(F.col("creation_date"), "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.max("creation_date").alias("newest"))
    before = Window.orderBy(F.desc("month")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each month
    return by.select("month", dates.key(F.col("newest"), "MMMM yyyy").alias("label"), "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))


def flat_index(media: DataFrame) -> DataFrame:
    """id and 0-based place of media newest first."""
    order = [(F.col("creation_date"), False), (F.col("id"), False)]
    return sorting.placed(media.select("id", "creation_date"), order).select("id", (F.col("place") - 1).alias("flat_index"))


def grid(media: DataFrame, columns: int) -> DataFrame:
    """Row and column of each media in a grid that starts anew every month."""
    rows = month_rows(media)
    return rows.select("id", "month", F.floor(F.col("position") / columns).alias("row"), (F.col("position") % columns).alias("col"))


def row_offsets(media: DataFrame, columns: int, height: float, header: float, spacing: float) -> DataFrame:
    """Top of each month's header in the grid: headers and rows above it, each with its spacing."""
    months = month_starts(media)
    tall = F.lit(header + spacing) + F.ceil(F.col("n") / columns) * (height + spacing)
    above = Window.orderBy(F.desc("month")).rowsBetween(Window.unboundedPreceding, -1)
    return months.select("month", "n", F.coalesce(F.sum(tall).over(above), F.lit(0.0)).alias("top"))


def row_at(offsets: DataFrame, y: float) -> DataFrame:
    """The last row whose top is not below y."""
    return offsets.filter(F.col("top") <= y).orderBy(F.desc("top"), "month").limit(1)


def carried_forward(rows: DataFrame, keys: sorting.Keys, column: str, by: str, name: str, block_rows: int = sorting.BLOCK_ROWS) -> DataFrame:
    """``rows`` with ``name``: the last value of ``column`` so far in its group, in the order of ``keys``.

    A group is looked at in blocks, and what a block ends with is carried over by
    a window of a row for each block.
    """
    rows = sorting.blocked(rows, [(F.col(by), True), *keys], block_rows)
    inside = Window.partitionBy("_block", by).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    own = F.last(column, ignorenulls=True).over(inside)
    ends = rows.filter(F.col(column).isNotNull()).groupBy("_block", by).agg(F.max_by(column, "_at").alias("_end"))
    parts = rows.select("_block", by).distinct().join(ends, ["_block", by], "left")
    before = Window.partitionBy(by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    parts = parts.select(F.col("_block").alias("_b"), F.col(by).alias("_by"), F.last("_end", ignorenulls=True).over(before).alias("_carried"))
    out = rows.withColumn("_own", own).join(parts, (F.col("_block") == F.col("_b")) & F.col(by).eqNullSafe(F.col("_by")))
    return out.withColumn(name, F.coalesce("_own", "_carried")).drop("_own", "_carried", "_b", "_by", "_block", "_at")


def trips(media: DataFrame, least: int = TRIP_LEAST) -> DataFrame:
    """Runs of geotagged media 120 km or more from the home cell without a gap of three days.

    ``lag`` looks at the point before in time, whether away or not. Points are
    cut into stretches at every gap of three days first, by per-day counts, so
    the window runs within a stretch of days and not over the whole table.
    """
    rows = media.filter(alive() & F.col("latitude").isNotNull() & F.col("longitude").isNotNull() & ~((F.col("latitude") == 0) & (F.col("longitude") == 0)) & (F.col("creation_date") > 0))
    rows = rows.select("id", F.col("creation_date").alias("t"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), F.floor(F.col("creation_date") / dates.DAY).alias("day"))
    home = home_cell(rows.select(F.col("lat").alias("latitude"), F.col("lon").alias("longitude"))).select((F.col("cell_lat") + 0.5).alias("home_lat"), (F.col("cell_lon") + 0.5).alias("home_lon"))
    rows = rows.crossJoin(F.broadcast(home))  # one row
    rows = rows.withColumn("away", geo.haversine_km(F.col("lat"), F.col("lon"), F.col("home_lat"), F.col("home_lon")) >= TRIP_KM)
    # a day's last point is what the next day's first one looks back to
    in_day = Window.partitionBy("day").orderBy("t", "id")
    days = rows.groupBy("day").agg(F.max(F.struct("t", "id", "away")).alias("last"))
    across = Window.orderBy("day")  # a row for each day
    days = days.select("day", F.lag("last.t").over(across).alias("day_t"), F.lag("last.away").over(across).alias("day_away"))
    rows = rows.join(days, "day")
    before_t = F.coalesce(F.lag("t").over(in_day), F.col("day_t"))
    before_away = F.coalesce(F.lag("away").over(in_day), F.col("day_away"), F.lit(False))
    rows = rows.withColumns({"before_t": before_t, "before_away": before_away})
    starts = F.col("away") & (~F.col("before_away") | F.coalesce(F.col("t") - F.col("before_t") >= TRIP_GAP, F.lit(False)))
    rows = rows.withColumn("starts", starts.cast("int"))
    per_day = rows.groupBy("day").agg(F.sum("starts").alias("n"))
    per_day = per_day.select("day", F.coalesce(F.sum("n").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    rows = rows.join(per_day, "day").withColumn("trip", F.sum("starts").over(in_day.rowsBetween(Window.unboundedPreceding, 0)) + F.col("earlier"))
    by = rows.filter("away").groupBy("trip").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first"), F.max("t").alias("last"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    return by.filter(F.col("n") >= least).withColumn("days", dates.days_span(F.col("first"), F.col("last")))


def newest_trips(media: DataFrame, n: int = TRIPS) -> DataFrame:
    return trips(media).orderBy(F.desc("first")).limit(n)


def trip_names(places: DataFrame, trip_list: DataFrame) -> DataFrame:
    """A trip's town if it has half of the placed media; else its country if alone or 60 %; else two countries."""
    trip = F.broadcast(trip_list.select("trip", "first", "last"))  # at most TRIPS rows
    here = places.join(trip, places["creation_date"].between(trip["first"], trip["last"]))
    n = here.groupBy("trip").agg(F.count(F.lit(1)).alias("all"), F.countDistinct("country").alias("countries"))
    out = n
    for kind, k in (("city", 1), ("country", 2)):
        by = here.groupBy("trip", kind).agg(F.count(F.lit(1)).alias("c"))
        nth = F.row_number().over(Window.partitionBy("trip").orderBy(F.desc("c"), kind))
        by = by.withColumn("nth", nth).filter(F.col("nth") <= k)
        for i in range(1, k + 1):
            out = out.join(by.filter(F.col("nth") == i).select("trip", F.col(kind).alias(f"{kind}{i}"), F.col("c").alias(f"{kind}{i}_n")), "trip", "left")
    name = F.when(F.col("city1_n") * 2 >= F.col("all"), F.col("city1"))
    name = name.when((F.col("countries") == 1) | (F.col("country1_n") >= F.col("all") * 0.6), F.col("country1"))
    return out.select("trip", name.otherwise(F.concat("country1", F.lit(" & "), "country2")).alias("name"))


def interleaved(rows: DataFrame, deck: str, keys: sorting.Keys) -> DataFrame:
    """``rows`` with their 1-based ``place``, round robin over decks: element i of every deck before element i + 1.

    ``keys`` order a deck and must be total. A deck's first place in the order by
    deck comes from the sizes of the decks, so no window holds a whole deck.
    """
    sizes = rows.groupBy(deck).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(deck).rowsBetween(Window.unboundedPreceding, -1)  # a row for each deck
    starts = sizes.select(deck, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    dealt = sorting.placed(rows, [(F.col(deck), True), *keys]).join(starts, deck)
    dealt = dealt.withColumn("_nth", F.col("place") - F.col("_start")).drop("place", "_start")
    return sorting.placed(dealt, [(F.col("_nth"), True), (F.col(deck), True)]).drop("_nth")


def alternating(mine: DataFrame, others: DataFrame, n: int) -> DataFrame:
    """Even slots take from ``mine``, odd ones from ``others``, the rest of the longer list follows; (position, ...)."""
    shorter = mine.agg(F.count(F.lit(1)).alias("a")).crossJoin(others.agg(F.count(F.lit(1)).alias("b"))).select(F.least("a", "b").alias("_c"))
    both = mine.withColumn("_odd", F.lit(0)).unionByName(others.withColumn("_odd", F.lit(1))).crossJoin(F.broadcast(shorter))
    p = F.col("position")
    slot = F.when(p < F.col("_c"), p * 2 + F.col("_odd")).otherwise(F.col("_c") + p)
    return both.withColumn("slot", slot).drop("_odd", "_c").orderBy("slot").limit(n)


def clip_timeline(clips: DataFrame, by: str, fade: float = 0.6, block_rows: int = sorting.BLOCK_ROWS) -> DataFrame:
    """Start of each clip (position, seconds) of a film: what went before, less a crossfade each; long films are added in blocks."""
    rows = sorting.blocked(clips, [(F.col(by), True), (F.col("position"), True)], block_rows)
    inside = Window.partitionBy("_block", by).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("_block", by).agg(F.sum(F.col("seconds") - fade).alias("_sum"))
    before = Window.partitionBy(by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    sums = sums.select(F.col("_block").alias("_b"), F.col(by).alias("_by"), F.coalesce(F.sum("_sum").over(before), F.lit(0.0)).alias("_start"))
    out = rows.withColumn("_own", F.coalesce(F.sum(F.col("seconds") - fade).over(inside), F.lit(0.0))).join(sums, (F.col("_block") == F.col("_b")) & F.col(by).eqNullSafe(F.col("_by")))
    return out.withColumn("start", F.col("_own") + F.col("_start")).drop("_own", "_start", "_b", "_by", "_block", "_at")


def adaptive_top(scored: DataFrame, sigma: float = 1.6, least: int = 12, most: int = 240) -> DataFrame:
    """The best rows (id, score): the first ``least``, and those ``sigma`` deviations above the mean, ``most`` at the most."""
    stats = scored.agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("sd"))
    best = scored.orderBy(F.desc("score"), "id").limit(most)  # at most ``most`` rows go on
    best = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id"))).crossJoin(F.broadcast(stats))
    return best.filter((F.col("rank") <= least) | (F.col("score") >= F.col("mean") + F.col("sd") * sigma)).select("id", "score", "rank")
