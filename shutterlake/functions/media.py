"""Column functions on media attributes: labels, sizes, shapes, colours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Everyday names of MIME types.
TYPE_LABELS = {
    "image/jpeg": "JPEG",
    "image/png": "PNG",
    "image/gif": "GIF",
    "image/webp": "WebP",
    "image/heic": "HEIC",
    "image/heif": "HEIF",
    "image/avif": "AVIF",
    "image/tiff": "TIFF",
    "image/bmp": "BMP",
    "image/x-adobe-dng": "DNG",
    "image/x-canon-cr2": "Canon RAW",
    "image/x-canon-cr3": "Canon RAW",
    "image/x-nikon-nef": "Nikon RAW",
    "image/x-sony-arw": "Sony RAW",
    "image/x-fuji-raf": "Fujifilm RAW",
    "image/x-olympus-orf": "Olympus RAW",
    "image/x-panasonic-rw2": "Panasonic RAW",
    "video/mp4": "MP4",
    "video/quicktime": "MOV",
    "video/webm": "WebM",
    "video/x-matroska": "MKV",
    "video/matroska": "MKV",
    "video/mkv": "MKV",
    "video/x-msvideo": "AVI",
    "video/vnd.avi": "AVI",
    "video/avi": "AVI",
    "video/msvideo": "AVI",
}
# Names of the colour buckets 1 to 12, and aspect ratios for media of unknown size.
COLOURS = ("red", "orange", "yellow", "green", "cyan", "blue", "purple", "pink", "brown", "black", "white", "gray")
RATIOS = (4 / 3, 3 / 2, 16 / 9, 1.0, 3 / 4, 2 / 3, 5 / 4, 4 / 5, 3 / 2, 16 / 9)


def type_label(mime: Column) -> Column:
    """Everyday name of a MIME type; else its subtype in capitals without x-, vnd. and ms-."""
    known = F.create_map(*[F.lit(x) for pair in TYPE_LABELS.items() for x in pair])
    rest = F.substring_index(mime, "/", -1)
    for junk in ("x-", "vnd\\.", "ms-"):
        rest = F.regexp_replace(rest, f"^{junk}", "")
    return F.coalesce(F.try_element_at(known, mime), F.upper(rest))


def halves_up(x: Column, digits: int) -> Column:
    return F.floor(x * 10.0**digits + 0.5) / 10.0**digits


def size_text(size: Column) -> Column:
    """B, KB, MB or GB with one decimal, halves up."""
    out = F.format_string("%d B", size)
    for n, unit in ((1, "KB"), (2, "MB"), (3, "GB")):
        out = F.when(size >= 1024**n, F.format_string(f"%.1f {unit}", halves_up(size / 1024.0**n, 1))).otherwise(out)
    return out


def short_size_text(size: Column) -> Column:
    """Up to TB with about three digits."""
    n = F.coalesce(size, F.lit(0))
    out = F.format_string("%d B", n)
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB"), (4, "TB")):
        v = n / 1024.0**power
        said = F.when(v >= 100, F.format_string("%.0f", halves_up(v, 0))).when(v >= 10, F.format_string("%.1f", halves_up(v, 1))).otherwise(F.format_string("%.2f", halves_up(v, 2)))
        out = F.when(n >= 1024**power, F.concat(said, F.lit(" " + unit))).otherwise(out)
    return out


def area(width: Column, height: Column) -> Column:
    return F.coalesce(width, F.lit(0)) * F.coalesce(height, F.lit(0))


def orientation(width: Column, height: Column) -> Column:
    """0 landscape, 1 square, 2 portrait, 3 unknown."""
    unknown = (F.coalesce(width, F.lit(0)) == 0) | (F.coalesce(height, F.lit(0)) == 0)
    return F.when(unknown, 3).when(width > height, 0).when(width == height, 1).otherwise(2)


def display_size(width: Column, height: Column, turn: Column) -> Column:
    """Size as shown: EXIF orientations 5 to 8 swap the sides."""
    swap = turn.between(5, 8)
    return F.struct(F.when(swap, height).otherwise(width).alias("width"), F.when(swap, width).otherwise(height).alias("height"))


def aspect_ratio(width: Column, height: Column, index: Column) -> Column:
    """width / height, or one of ten ratios by index where the size is unknown."""
    table = F.array(*[F.lit(float(r)) for r in RATIOS])
    return F.when((width > 0) & (height > 0), width / height).otherwise(F.element_at(table, (index % len(RATIOS) + 1).cast("int")))


def clip_seconds(mime: Column, duration: Column, slide: float = 3.2) -> Column:
    """Seconds on screen: 3.2 for a photo, up to 6 of a video, null for videos under 1.5."""
    video = mime.startswith("video/")
    return F.when(~F.coalesce(video, F.lit(False)), F.lit(slide)).when(duration >= 1.5, F.least(duration, F.lit(6.0)))


def packed_rgb(r: Column, g: Column, b: Column) -> Column:
    return F.shiftleft(r, 16).bitwiseOR(F.shiftleft(g, 8)).bitwiseOR(b)


def colour_bucket(r: Column, g: Column, b: Column) -> Column:
    """Bucket 1 to 12 of a colour with parts 0 to 1: black, white and gray by value and saturation, the rest by hue."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    spread = top - low
    sat = F.when(top > 0, spread / top).otherwise(0.0)
    hue = F.when(top == r, (g - b) / spread).when(top == g, (b - r) / spread + 2).otherwise((r - g) / spread + 4) * 60.0
    hue = F.when(hue < 0, hue + 360).otherwise(hue)
    by_hue = F.when((hue < 15) | (hue >= 345), 1)
    for n, bound in ((2, 40), (3, 68), (4, 160), (5, 195), (6, 255), (7, 290)):
        by_hue = by_hue.when(hue < bound, n)
    brown = ((hue < 45) | (hue >= 345)) & (top < 0.58) & (sat < 0.85)
    grey = F.when(top > 0.86, 11).otherwise(12)
    return F.when(top < 0.16, 10).when((sat < 0.16) | (spread < 0.06), grey).when(brown, 9).otherwise(by_hue.otherwise(8))
