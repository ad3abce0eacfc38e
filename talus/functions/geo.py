"""Column functions on places, names and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance on a sphere of 6371 km."""
    x = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2))
    return 2 * 6371.0 * F.asin(F.least(F.lit(1.0), F.sqrt(x)))


def planar_m(dlon: Column, dlat: Column) -> Column:
    """Distance in metres of small differences in degrees, at the latitudes served."""
    return F.hypot(dlon * 93_000.0, dlat * 111_000.0)


def pixel_centre(index: Column, origin: float, step: float) -> Column:
    """World coordinate of the middle of a row or column."""
    return F.lit(float(origin)) + (index + 0.5) * step


def pixel_of(world: Column, origin: float, step: float) -> Column:
    """Row or column of a world coordinate."""
    return F.floor((world - origin) / step).cast("int")


def utm_to_lonlat(easting: Column, northing: Column, zone: int) -> tuple[Column, Column]:
    """Longitude and latitude of northern UTM coordinates, by a series exact to some 1e-7 degrees."""
    e, r1, k0 = 0.00669438, 6378137.0, 0.9996
    ep = e / (1 - e)
    e1 = (1 - (1 - e) ** 0.5) / (1 + (1 - e) ** 0.5)
    x = easting - 500_000.0
    mu = northing / k0 / (r1 * (1 - e / 4 - 3 * e**2 / 64 - 5 * e**3 / 256))
    p = (
        mu + (3 / 2 * e1 - 27 / 32 * e1**3) * F.sin(2 * mu) + (21 / 16 * e1**2 - 55 / 32 * e1**4) * F.sin(4 * mu)
        + 151 / 96 * e1**3 * F.sin(6 * mu) + 1097 / 512 * e1**4 * F.sin(8 * mu)
    )
    s, c, t = F.sin(p), F.cos(p), F.tan(p)
    n = r1 / F.sqrt(1 - e * s * s)
    r = r1 * (1 - e) / F.pow(1 - e * s * s, F.lit(1.5))
    tt, cc, d = t * t, ep * c * c, x / (n * k0)
    d2 = d * d
    lat = p - n * t / r * (d2 / 2 - d2 * d2 / 24 * (5 + 3 * tt + 10 * cc - 4 * cc * cc - 9 * ep) + d2 * d2 * d2 / 720 * (61 + 90 * tt + 298 * cc + 45 * tt * tt - 252 * ep - 3 * cc * cc))
    lon = (d - d2 * d / 6 * (1 + 2 * tt + cc) + d2 * d2 * d / 120 * (5 - 2 * cc + 28 * tt - 3 * cc * cc + 8 * ep + 24 * tt * tt)) / c
    return F.degrees(lon) + (zone * 6 - 183), F.degrees(lat)


def lonlat_to_utm(lon: Column, lat: Column, zone: int) -> tuple[Column, Column]:
    """Easting and northing in a northern UTM zone, by a series exact to some millimetres within a zone, and to some decimetres one zone beside it."""
    e, a, k0 = 0.00669438, 6378137.0, 0.9996
    ep = e / (1 - e)
    p = F.radians(lat)
    s, c, t = F.sin(p), F.cos(p), F.tan(p)
    n, tt, cc = a / F.sqrt(1 - e * s * s), t * t, ep * c * c
    d = F.radians(lon - (zone * 6 - 183)) * c
    d2 = d * d
    arc = a * (
        (1 - e / 4 - 3 * e**2 / 64 - 5 * e**3 / 256) * p - (3 * e / 8 + 3 * e**2 / 32 + 45 * e**3 / 1024) * F.sin(2 * p)
        + (15 * e**2 / 256 + 45 * e**3 / 1024) * F.sin(4 * p) - 35 * e**3 / 3072 * F.sin(6 * p)
    )
    easting = k0 * n * (d + (1 - tt + cc) * d2 * d / 6 + (5 - 18 * tt + tt * tt + 72 * cc - 58 * ep) * d2 * d2 * d / 120) + 500_000.0
    northing = k0 * (arc + n * t * (d2 / 2 + (5 - tt + 9 * cc + 4 * cc * cc) * d2 * d2 / 24 + (61 - 58 * tt + tt * tt + 600 * cc - 330 * ep) * d2 * d2 * d2 / 720))
    return easting, northing


def stack_label(direction: Column, path: Column, frame: Column) -> Column:
    """Label of a stack, e.g. ASC_path27_frame106."""
    d = F.upper(direction)
    short = F.when(d == "ASCENDING", "ASC").when(d == "DESCENDING", "DESC").otherwise(d)
    return F.concat(short, F.lit("_path"), path.cast("string"), F.lit("_frame"), frame.cast("string"))


_JOB = r"(?i)(ASCENDING|DESCENDING|ASC|DESC)_path(\d+)_frame(\d+)"


def label_of_job(name: Column, prefix: str) -> Column:
    """Label of the stack that a job's name states after the prefix; `unknown` if it states none."""
    rest = F.when(F.startswith(name, F.lit(prefix)), F.substring(name, len(prefix) + 1, 1_000_000)).otherwise(name)
    part = lambda i: F.regexp_extract(rest, _JOB, i)
    return F.when(F.regexp_like(rest, F.lit(_JOB)), stack_label(part(1), part(2), part(3))).otherwise("unknown")


def label_parts(label: Column) -> tuple[Column, Column, Column]:
    """Direction, path and frame of a label."""
    pattern = r"^(ASC|DESC)_path(\d+)_frame(\d+)$"
    part = lambda i: F.regexp_extract(label, pattern, i)
    direction = F.when(part(1) == "ASC", "ASCENDING").when(part(1) == "DESC", "DESCENDING").otherwise("unknown")
    return direction, part(2).try_cast("int"), part(3).try_cast("int")


def pair_dates(product: Column) -> tuple[Column, Column]:
    """The two acquisition times in a product's name; null if there are not two."""
    found = F.regexp_extract_all(product, F.lit(r"(\d{8}T\d{6})"), F.lit(1))
    at = lambda i: F.try_to_timestamp(F.get(found, F.lit(i)), F.lit("yyyyMMdd'T'HHmmss"))
    return at(0), at(1)


def number(text: Column) -> Column:
    """A number, or null if the text is none."""
    return text.try_cast("double")


def utc(text: Column) -> Column:
    """A timestamp of an ISO text with or without `Z`."""
    return F.try_to_timestamp(F.regexp_replace(text, "Z$", ""))


def joined_reasons(*reasons: Column) -> Column:
    """Reasons that hold, joined; empty if none does."""
    return F.array_join(F.filter(F.array(*reasons), lambda x: x.isNotNull()), "; ")
