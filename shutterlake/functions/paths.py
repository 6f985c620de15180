"""Column functions on file paths, names and URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VIRTUAL = "__virtual__"


def extension(path: Column) -> Column:
    """What follows the last dot, in lower case; a path without a dot is its own extension."""
    return F.lower(F.substring_index(path, ".", -1))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dir_name(path: Column) -> Column:
    """What stands before the last slash; "/" if that slash is the first character or absent."""
    return F.when(F.instr(F.substr(path, F.lit(2)), "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("/"))


def leaf_name(prefix: Column, custom: Column) -> Column:
    """Display name of an album: its custom name, its virtual name, or its folder's name."""
    return F.when(F.length(custom) > 0, custom).when(prefix.startswith(VIRTUAL), F.substr(prefix, F.lit(len(VIRTUAL) + 1))).otherwise(base_name(prefix))


def virtual_prefix(name: Column) -> Column:
    return F.concat(F.lit(VIRTUAL), F.regexp_replace(simplified(name), "[ /]", "_"))


def simplified(text: Column) -> Column:
    """White space runs to one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def percent_encoded(path: Column) -> Column:
    """Percent-encoding that keeps slashes and colons."""
    out = F.replace(F.url_encode(path), F.lit("+"), F.lit("%20"))
    for code, sign in (("%2F", "/"), ("%3A", ":"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(sign))
    return F.replace(out, F.lit("*"), F.lit("%2A"))


def file_url(path: Column) -> Column:
    return F.concat(F.lit("file://"), percent_encoded(path))


def path_of_url(url: Column) -> Column:
    return F.when(url.startswith("file://"), F.url_decode(F.replace(F.substr(url, F.lit(8)), F.lit("+"), F.lit("%2B")))).otherwise(url)


def natural_key(name: Column) -> Column:
    """Sort key under which digit runs compare as numbers and letters without case."""
    tokens = F.regexp_extract_all(F.lower(name), F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    return F.array_join(F.transform(tokens, lambda t: F.when(t.rlike("^[0-9]"), F.lpad(t, 20, "0")).otherwise(t)), "")


# Extensions of raw photographs, of the raw filter and of the storage report (two lists by design),
# and of all media files.
RAW_FILTER = ("nef", "cr2", "cr3", "arw", "dng", "raf", "orf", "rw2", "pef", "srw", "3fr", "raw", "rw1", "mrw", "x3f", "dcr")
RAW_REPORT = ("cr2", "cr3", "nef", "nrw", "arw", "srf", "sr2", "dng", "orf", "rw2", "raf", "pef", "srw", "x3f", "3fr", "iiq", "erf", "kdc", "mrw", "rwl")
MEDIA = ("jpg", "jpeg", "png", "webp", "gif", "bmp", "tiff", "tif", "heic", "heif", "mp4", "mkv", "mov", "avi", "webm", *RAW_FILTER)


def is_raw(path: Column, kinds: tuple[str, ...] = RAW_FILTER) -> Column:
    return extension(path).isin(*kinds)
