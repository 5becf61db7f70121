"""Date, time zone and daylight expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted capture-time formats and the default place (longitude, latitude, offset).
FORMATS = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy:MM:dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss")
DEFAULT_LONGITUDE, DEFAULT_LATITUDE, DEFAULT_OFFSET = 116.4, 39.9, 8.0


def parse_time(text: Column) -> Column:
    """The first format that fits, as a time without zone; a trailing Z is dropped."""
    bare = F.regexp_replace(F.trim(text), "Z$", "")
    return F.coalesce(*[F.try_to_timestamp(bare, F.lit(f)) for f in FORMATS])


def parse_offset(text: Column) -> Column:
    """`+08:00` as 8.0 hours."""
    form = r"^([+-])([0-9]{2}):?([0-9]{2})$"
    hours = F.regexp_extract(text, form, 2).try_cast("double") + F.regexp_extract(text, form, 3).try_cast("double") / 60
    return F.when(text.rlike(form), F.when(F.regexp_extract(text, form, 1) == "-", -hours).otherwise(hours))


def format_offset(hours: Column) -> Column:
    minutes = F.abs(F.round(hours * 60)).cast("int")
    return F.concat(F.when(hours < 0, "-").otherwise("+"), F.lpad(F.floor(minutes / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((minutes % 60).cast("string"), 2, "0"))


def declination(day_of_year: Column) -> Column:
    return 23.44 * F.sin(F.radians(360.0 / 365.0 * (day_of_year - 81)))


def hour_angle(latitude: Column, decl: Column, elevation: float) -> Column:
    """Degrees between noon and the sun at an elevation, cut where it never gets there."""
    part = (F.sin(F.radians(F.lit(elevation))) - F.sin(F.radians(latitude)) * F.sin(F.radians(decl))) / (F.cos(F.radians(latitude)) * F.cos(F.radians(decl)))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), part))))


def daylight(day_of_year: Column, offset: Column, latitude: Column, longitude: Column) -> dict[str, Column]:
    """Local hours of dawn, sunrise, sunset and dusk."""
    noon = 12 - longitude / 15 + offset
    decl = declination(day_of_year)
    sun, civil = hour_angle(latitude, decl, -0.833) / 15, hour_angle(latitude, decl, -6.0) / 15
    return {"dawn": noon - civil, "sunrise": noon - sun, "sunset": noon + sun, "dusk": noon + civil}


def classify(hour: Column, times: dict[str, Column]) -> Column:
    """night, golden_hour (an hour within sunrise or sunset, from dawn to dusk) or day."""
    night = (hour < times["dawn"]) | (hour > times["dusk"])
    return F.when(night, "night").when((hour < times["sunrise"] + 1) | (hour > times["sunset"] - 1), "golden_hour").otherwise("day")
