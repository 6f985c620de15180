"""Column functions on coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.sin(dlat / 2) * F.sin(dlat / 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon / 2) * F.sin(dlon / 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def great_circle_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """By the angle between unit vectors."""
    p, q, dlon = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    dot = F.sin(p) * F.sin(q) + F.cos(p) * F.cos(q) * F.cos(dlon)
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))) * EARTH_KM


def valid_point(lat: Column, lon: Column) -> Column:
    """In range and not at (0, 0); null counts as invalid."""
    there = ~((F.abs(lat) < 1e-9) & (F.abs(lon) < 1e-9))
    return F.coalesce((F.abs(lat) <= 90) & (F.abs(lon) <= 180) & there, F.lit(False))


def hundredths(x: Column) -> Column:
    """Rounded to two decimals, halves up; the same in every engine."""
    return F.floor(x * 100 + 0.5) / 100.0


def degrees(d: Column, m: Column, s: Column, ref: Column) -> Column:
    """Signed degrees from degrees, minutes and seconds; S and W are negative."""
    return (d + m / 60.0 + s / 3600.0) * F.when(ref.isin("S", "W"), -1).otherwise(1)


def iso6709(text: Column) -> Column:
    """(lat, lon) of strings like +48.8584+002.2945+035.000/, else nulls."""
    form = r"^([+-][0-9.]+)([+-][0-9.]+)"
    return F.struct(*[F.nullif(F.regexp_extract(text, form, i), F.lit("")).try_cast("double").alias(n) for i, n in ((1, "lat"), (2, "lon"))])


def coordinate_label(lat: Column, lon: Column) -> Column:
    """48.86° N, 2.35° E."""
    ns, ew = F.when(lat >= 0, "N").otherwise("S"), F.when(lon >= 0, "E").otherwise("W")
    return F.format_string("%.2f° %s, %.2f° %s", hundredths(F.abs(lat)), ns, hundredths(F.abs(lon)), ew)


def place_text(city: Column, country: Column) -> Column:
    """city, country; the city alone if there is no other country name."""
    return F.when((F.coalesce(country, F.lit("")) == "") | (country == city), city).otherwise(F.concat(city, F.lit(", "), country))


def is_land(toggles: Column, x: Column) -> Column:
    """An odd number of toggles at or before x means land (row run-length coding)."""
    return F.size(F.filter(toggles, lambda t: t <= x)) % 2 == 1
