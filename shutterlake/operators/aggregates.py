"""Rollups of a media library: albums, storage, duplicates, people, colours, dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shutterlake.functions import dates, geo, paths
from shutterlake.operators.filters import alive, flag, live, usable, without_ignored_folders


def album_rollup(media: DataFrame, albums: DataFrame) -> DataFrame:
    """One row per folder: count, size, cover and the album's own fields."""
    rows = without_ignored_folders(media.filter(live() & (flag("is_hidden") == 0) & (flag("is_ignored") == 0)), albums)
    by = rows.groupBy("folder_path").agg(F.count(F.lit(1)).alias("n"), F.sum("file_size").alias("size"), F.min("file_path").alias("cover"))
    own = albums.select(F.col("path_prefix").alias("folder_path"), "custom_name", "is_pinned", "cover_path", "description")
    return by.join(own, "folder_path", "left")


def all_albums(media: DataFrame, albums: DataFrame) -> DataFrame:
    """Folder albums and virtual ones, with display names, pinned first."""
    folders = album_rollup(media, albums)
    folders = folders.select("folder_path", "n", "size", F.coalesce("cover_path", "cover").alias("cover"), "custom_name", F.coalesce("is_pinned", F.lit(0)).alias("is_pinned"), "description")
    virtual = albums.filter(F.col("path_prefix").startswith(paths.VIRTUAL) & (F.col("is_ignored") == 0))
    virtual = virtual.select(F.col("path_prefix").alias("folder_path"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("size"), F.col("cover_path").alias("cover"), F.col("name").alias("custom_name"), "is_pinned", "description")
    out = folders.unionByName(virtual)
    return out.withColumn("name", paths.leaf_name(F.col("folder_path"), F.col("custom_name")))


def geo_cells(media: DataFrame, limit: int = 500) -> DataFrame:
    """Live geotagged media by cells of a hundredth of a degree, largest first; hidden and ignored media count."""
    points = media.filter(live() & (F.col("latitude") != 0) & (F.col("longitude") != 0))
    by = points.groupBy(geo.hundredths(F.col("latitude")).alias("lat"), geo.hundredths(F.col("longitude")).alias("lon"))
    return by.agg(F.count(F.lit(1)).alias("n"), F.min("file_path").alias("sample")).orderBy(F.desc("n"), "lat", "lon").limit(limit)


def storage_totals(media: DataFrame) -> DataFrame:
    """Bytes of all, photo and video media; a null type is neither."""
    video = F.col("mime_type").startswith("video/")
    sums = {"total": F.col("file_size"), "photos": F.when(~video, F.col("file_size")), "videos": F.when(video, F.col("file_size"))}
    return media.filter(live()).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in sums.items()])


def counts(media: DataFrame) -> DataFrame:
    video = F.col("mime_type").startswith("video/")
    return media.filter(live() & (flag("is_hidden") == 0)).agg(F.count_if(~video).alias("photos"), F.count_if(video).alias("videos"))


def overview(media: DataFrame, disk_total: int, disk_free: int) -> DataFrame:
    """One pass: bytes of photos, videos, raw files and trash, trash count, and what else fills the disk."""
    video, raw, size = F.col("mime_type").startswith("video/"), paths.is_raw(F.col("file_path"), paths.RAW_REPORT), F.col("file_size")

    def total(test: Column) -> Column:
        return F.coalesce(F.sum(F.when(test, size)), F.lit(0))

    out = media.agg(total(live() & ~video & ~raw).alias("photos"), total(live() & video).alias("videos"), total(live() & raw).alias("raw"), total(~live()).alias("trash"), F.count_if(~live()).alias("trash_count"))
    used = F.col("photos") + F.col("videos") + F.col("raw") + F.col("trash")
    return out.withColumn("other", F.greatest(F.lit(0).cast("long"), F.lit(disk_total - disk_free) - used))


def by_folder(media: DataFrame, n: int = 8) -> DataFrame:
    by = media.filter(live()).groupBy("folder_path").agg(F.sum("file_size").alias("size"), F.count(F.lit(1)).alias("n"))
    return by.orderBy(F.desc("size"), "folder_path").limit(n).withColumn("name", paths.base_name(F.col("folder_path")))


def by_year(media: DataFrame, keep: Column | None = None) -> DataFrame:
    rows = media.filter((live() if keep is None else keep) & (F.col("creation_date") > 0))
    return rows.groupBy(dates.key(F.col("creation_date"), "yyyy").alias("year")).agg(F.sum("file_size").alias("size"), F.count(F.lit(1)).alias("n"))


def by_type(media: DataFrame) -> DataFrame:
    by = media.filter(live()).groupBy(paths.extension(F.col("file_path")).alias("ext")).agg(F.sum("file_size").alias("size"), F.count(F.lit(1)).alias("n"))
    return by.withColumn("raw", F.col("ext").isin(*paths.RAW_REPORT))


def duplicate_groups(media: DataFrame, limit: int = 40) -> DataFrame:
    """Files that share name and size, most wasted bytes first; copies oldest first, |-joined.

    Groups are chosen by their counts; only members of the chosen ones are gathered.
    """
    rows = _sized(media).select("name", "file_size", "creation_date", "id")
    wasted, order = F.col("file_size") * (F.col("copies") - 1), (F.desc("wasted"), "name", "file_size")
    best = rows.groupBy("name", "file_size").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1").withColumn("wasted", wasted).orderBy(*order).limit(limit)
    members = rows.join(F.broadcast(best), ["name", "file_size"])  # at most ``limit`` groups
    by = members.groupBy("name", "file_size", "copies", "wasted").agg(F.sort_array(F.collect_list(F.struct("creation_date", "id"))).alias("all"))
    return by.withColumn("ids", F.array_join(F.transform("all", lambda m: m["id"].cast("string")), "|")).drop("all").orderBy(*order)


def _sized(media: DataFrame) -> DataFrame:
    return media.filter(live() & (F.col("file_size") > 0)).withColumn("name", paths.base_name(F.col("file_path")))


def extra_copies(media: DataFrame) -> DataFrame:
    """Every copy but the oldest of its group.

    A group is ranked in blocks, so a large one is spread over tasks: days, and
    ranges of ids where there is no date. Blocks of a group follow each other in
    the order of its copies; a copy's place is what stands in earlier blocks and
    its place in its own.
    """
    day = F.coalesce(F.floor(F.col("creation_date") / dates.DAY), F.lit(-(2**62)))
    undated = F.coalesce(F.col("creation_date") == 0, F.lit(True))
    part = F.when(undated, F.floor(F.col("id") / 2**20)).otherwise(F.lit(2**62))
    group, block = ["name", "file_size"], ["name", "file_size", "_day", "_part"]
    rows = _sized(media).select("id", *group, "creation_date", day.alias("_day"), part.alias("_part"))
    earlier = Window.partitionBy(*group).orderBy("_day", "_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    totals = rows.groupBy(*block).agg(F.count(F.lit(1)).alias("_n")).withColumn("_earlier", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    nth = F.row_number().over(Window.partitionBy(*block).orderBy("creation_date", "id")) + F.col("_earlier")
    return rows.join(totals.drop("_n"), block).withColumn("nth", nth.cast("int")).filter("nth > 1").select("id", *group, "nth")


def people(faces: DataFrame, persons: DataFrame, media: DataFrame) -> DataFrame:
    """Faces and photos of each visible person; unnamed people need two faces."""
    seen = faces.join(media.filter(alive()).select(F.col("id").alias("media_id")), "media_id")
    by = seen.groupBy("person_id").agg(F.count(F.lit(1)).alias("faces"), F.countDistinct("media_id").alias("photos"))
    out = persons.filter("hidden = 0").join(by, F.col("id") == F.col("person_id"))
    return out.filter((F.col("faces") >= 2) | F.col("name").isNotNull()).select("id", "name", "faces", "photos")


def colour_groups(media: DataFrame, analysis: DataFrame, covers: int = 4) -> DataFrame:
    """Colour buckets of three or more alive media, with the media of the largest share as covers."""
    rows = analysis.filter("color_bucket > 0").join(media.filter(alive()).select(F.col("id").alias("media_id")), "media_id")
    nth = F.row_number().over(Window.partitionBy("color_bucket").orderBy(F.desc("color_frac"), "media_id"))
    # the rank limit keeps a few rows a bucket and task before the shuffle
    best = rows.withColumn("nth", nth).filter(F.col("nth") <= covers)
    best = best.groupBy("color_bucket").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nth", "media_id"))), lambda c: c["media_id"].cast("string")), "|").alias("covers"))
    by = rows.groupBy("color_bucket").agg(F.count(F.lit(1)).alias("n")).filter("n >= 3")
    return by.join(best, "color_bucket")


def on_this_day(media: DataFrame, year: int, month: int, day: int, least: int = 2) -> DataFrame:
    """Earlier years with media within three days of the day."""
    near = dates.near_anniversary(F.col("creation_date"), year, month, day)
    rows = media.filter(alive() & (F.col("creation_date") > 0) & near)
    by = rows.groupBy(dates.key(F.col("creation_date"), "yyyy").alias("year")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return by.withColumn("years_ago", F.lit(year) - F.col("year").cast("int"))


def home_cell(points: DataFrame) -> DataFrame:
    """The whole-degree cell with most points; ties go to the lesser cell."""
    cells = points.groupBy(F.floor("latitude").alias("cell_lat"), F.floor("longitude").alias("cell_lon")).agg(F.count(F.lit(1)).alias("n"))
    return cells.orderBy(F.desc("n"), "cell_lat", "cell_lon").limit(1)


def memory_candidates(media: DataFrame, day_least: int = 8, month_least: int = 16) -> DataFrame:
    """Days and months with enough usable media."""
    rows = media.filter(usable())
    out = None
    for kind, pattern, least in (("day", "yyyy-MM-dd", day_least), ("month", "yyyy-MM", month_least)):
        by = rows.groupBy(dates.key(F.col("creation_date"), pattern).alias("date")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
        by = by.select(F.lit(kind).alias("kind"), "date", "n")
        out = by if out is None else out.unionByName(by)
    return out


def memory_batch(media: DataFrame, used: DataFrame, seed: int = 7, most: int = 5, clips: int = 3) -> DataFrame:
    """place, kind, date, stale, id: the media of up to ``most`` memories.

    Candidates that no memory had before (``used``: date) come before stale
    ones, each in an order drawn by ``seed``; one a month is taken first, then
    what is left. Each gets 8 to 12 of its media, at most ``clips`` of them
    videos; one that has fewer than six such media is skipped.
    """
    video = F.col("mime_type").startswith("video/")
    rows = media.filter(usable()).select("id", "file_path", video.alias("video"), F.col("creation_date"))
    kinds = [F.struct(F.lit(k).alias("kind"), dates.key(F.col("creation_date"), p).alias("date"), F.lit(n).alias("least")) for k, p, n in (("day", "yyyy-MM-dd", 8), ("month", "yyyy-MM", 16))]
    keyed = rows.select("id", "file_path", "video", F.inline(F.array(*kinds)))
    by = keyed.groupBy("kind", "date").agg(F.count(F.lit(1)).alias("n"), F.count_if("video").alias("videos"), F.max("least").alias("least"))
    by = by.filter((F.col("n") >= F.col("least")) & (F.col("n") - F.col("videos") + F.least("videos", F.lit(clips)) >= 6))
    by = by.join(used.select("date", F.lit(1).alias("_used")).distinct(), "date", "left").withColumn("stale", F.col("_used").isNotNull())
    drawn = F.md5(F.concat(F.lit(str(seed)), "kind", "date").cast("binary"))
    by = by.select("kind", "date", "stale", drawn.alias("drawn"))
    month = Window.partitionBy(F.substring("date", 1, 7)).orderBy("stale", "drawn")  # at most a month and its days
    chosen = by.withColumn("later", F.row_number().over(month) > 1).orderBy("later", "stale", "drawn").limit(most)
    chosen = chosen.withColumn("place", F.row_number().over(Window.orderBy("later", "stale", "drawn")))
    chosen = chosen.select("place", "kind", "date", "stale", (F.lit(8) + F.ascii("drawn") % 5).alias("want"))
    pool = keyed.join(F.broadcast(chosen), ["kind", "date"]).withColumn("drawn", F.md5(F.concat(F.lit(str(seed)), "file_path").cast("binary")))  # ``most`` rows
    # twelve of each kind are enough, so a task sends no more
    of_kind = F.row_number().over(Window.partitionBy("place", "video").orderBy("drawn", "id"))
    pool = pool.withColumn("k", of_kind).filter(F.col("k") <= 12).filter(~F.col("video") | (F.col("k") <= clips))
    nth = F.row_number().over(Window.partitionBy("place").orderBy("drawn", "id"))
    return pool.withColumn("nth", nth).filter(F.col("nth") <= F.col("want")).select("place", "kind", "date", "stale", "id")


def bucket_peaks(samples: DataFrame, buckets: int) -> DataFrame:
    """Largest amplitude of each of ``buckets`` slices of a signal (idx, s), relative to the loudest."""
    n = samples.agg(F.count(F.lit(1)).alias("total"))
    rows = samples.crossJoin(F.broadcast(n))  # one row
    # slice b holds [n*b/B, n*(b+1)/B): the last b whose start is not after idx
    bucket = F.floor(((F.col("idx") + 1) * buckets - 1) / F.col("total"))
    peaks = rows.groupBy(bucket.alias("bucket")).agg(F.max(F.abs("s")).alias("peak"))
    return peaks.withColumn("level", F.col("peak") / F.greatest(F.max("peak").over(Window.partitionBy(F.lit(1))), F.lit(1e-6)))


def upper_median(df: DataFrame, column: str, width: int = 86400) -> DataFrame:
    """Element n/2 of the sorted values, counted from 0.

    Counts by ranges of ``width`` find the range that holds it, and only that
    range is ranked, so no task sees all values.
    """
    value = F.col(column)
    ranges = df.groupBy(F.floor(value / width).alias("_range")).agg(F.count(F.lit(1)).alias("_c"))
    order = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    ranges = ranges.withColumns({"_below": F.coalesce(F.sum("_c").over(order), F.lit(0)), "_middle": F.floor(F.sum("_c").over(Window.partitionBy(F.lit(1))) / 2)})
    ranges = ranges.filter((F.col("_below") <= F.col("_middle")) & (F.col("_middle") < F.col("_below") + F.col("_c")))
    rows = df.select(value.alias("median"), F.floor(value / width).alias("_range")).join(F.broadcast(ranges), "_range")
    rank = F.row_number().over(Window.partitionBy("_range").orderBy("median")) - 1 + F.col("_below")
    return rows.withColumn("_rank", rank).filter(F.col("_rank") == F.col("_middle")).select("median")


def histogram(pixels: DataFrame) -> DataFrame:
    """Colour buckets of each image: count, share and colour sums."""
    from shutterlake.functions.media import colour_bucket

    part = [F.col(c) / 255.0 for c in ("r", "g", "b")]
    by = pixels.groupBy("img", colour_bucket(*part).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"sum_{c}") for c in ("r", "g", "b")])
    return by.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("img")))


def dominant_colour(pixels: DataFrame) -> DataFrame:
    """The naming rule: a clear lead among the chromatic buckets, else a neutral majority, else 0."""
    n = {b: F.coalesce(F.max(F.when(F.col("bucket") == b, F.col("n"))), F.lit(0)).alias(f"n{b}") for b in range(1, 13)}
    by = histogram(pixels).groupBy("img").agg(F.sum("n").alias("total"), *n.values())
    # ties: the lowest chromatic bucket, the highest neutral one
    chroma = F.sort_array(F.array(*[F.struct((-F.col(f"n{b}")).alias("neg"), F.lit(b).alias("b")) for b in range(1, 10)]))
    neutral = F.array_max(F.array(*[F.struct(F.col(f"n{b}").alias("n"), F.lit(b).alias("b")) for b in (10, 11, 12)]))
    by = by.withColumns({"c": chroma, "z": neutral})
    first, second = -F.col("c")[0]["neg"] / F.col("total"), -F.col("c")[1]["neg"] / F.col("total")
    need = F.when(F.col("c")[0]["b"] == 9, 0.45).otherwise(0.28)
    named = F.when((first >= need) & (first >= second * 1.5), F.col("c")[0]["b"]).when(F.col("z")["n"] / F.col("total") >= 0.55, F.col("z")["b"]).otherwise(0)
    return by.select("img", named.alias("bucket"))


def type_groups(media: DataFrame) -> DataFrame:
    """Everyday type names and the MIME types behind each, |-joined in order."""
    from shutterlake.functions.media import type_label

    types = media.filter(F.col("mime_type").isNotNull()).select("mime_type").distinct()
    by = types.groupBy(type_label(F.col("mime_type")).alias("label")).agg(F.sort_array(F.collect_list("mime_type")).alias("all"))
    return by.select("label", F.array_join("all", "|").alias("filter"))


def screen_clusters(points: DataFrame, zoom: float, cell: int = 64) -> DataFrame:
    """Weighted points (lat, lon, n, id) by screen cells of a Mercator map; the largest leads, first wins ties."""
    scale = 256.0 * 2**zoom
    x = (F.col("lon") + 180) / 360.0 * scale
    sin = F.sin(F.radians("lat"))
    y = (F.lit(0.5) - F.log((1 + sin) / (1 - sin)) / (4 * 3.141592653589793)) * scale
    by = points.groupBy(F.floor(x / cell).alias("cx"), F.floor(y / cell).alias("cy"))
    lead = F.max(F.struct("n", (-F.col("id")).alias("neg")))
    return by.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("members"), lead.alias("lead")).withColumn("lead", -F.col("lead.neg"))
