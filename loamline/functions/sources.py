"""Rules of photo sources: licences, credits, dates, places and names, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Allowed licences, the marks of their addresses and their short names; licences that forbid commercial use.
ALLOWED_LICENSES = {"CC0_1_0": "creativecommons.org/publicdomain/zero/1.0", "CC_BY_4_0": "creativecommons.org/licenses/by/4.0"}
SHORT_LICENSES = {"CC0_1_0": "CC0-1.0", "CC_BY_4_0": "CC-BY-4.0"}
NONCOMMERCIAL = ("cc-by-nc", "cc-by-nc-sa", "cc-by-nc-nd")


def first_filled(*columns: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def normalize_license(text: Column) -> Column:
    """The allowed licence that an address or code names; null for any other."""
    low = F.lower(text)
    out = F.lit(None).cast("string")
    for code, mark in reversed(ALLOWED_LICENSES.items()):
        out = F.when(low.contains(mark) | low.contains(code.lower()), code).otherwise(out)
    return out


def media_license(media: Column, occurrence: Column) -> Column:
    """The licence of an image; it has its occurrence's only if it names none itself."""
    own = normalize_license(media)
    return F.when(F.coalesce(media, F.lit("")) != "", own).otherwise(normalize_license(occurrence))


def attribution(license_code: Column, occurrence_id: Column, *holders: Column) -> Column:
    """Credit line with the first known holder of the rights."""
    short = license_code
    for code, name in SHORT_LICENSES.items():
        short = F.when(license_code == code, name).otherwise(short)
    return F.concat(F.lit("© "), F.coalesce(first_filled(*holders), F.lit("unknown")), F.lit(", licensed "), short, F.lit(" (via GBIF, occurrence "), occurrence_id.cast("string"), F.lit(")"))


def still_images(media: Column) -> Column:
    """Entries of an array of media structs that are still images, or of no type, and have an address."""
    return F.filter(media, lambda m: (m["type"].isNull() | (m["type"] == "StillImage")) & (F.coalesce(m["identifier"], F.lit("")) != ""))


def event_date(raw: Column) -> Column:
    """The first day of a date, a time or a range of them; null if there is none."""
    return F.nullif(F.trim(F.get(F.split(F.get(F.split(raw, "/"), 0), "T"), 0)), F.lit(""))


def usable_place(latitude: Column, longitude: Column) -> Column:
    """Whether a place is finite, in range and not exactly 0, 0."""
    there = ~F.isnan(latitude) & ~F.isnan(longitude) & ((F.abs(latitude) > 1e-9) | (F.abs(longitude) > 1e-9))
    return F.coalesce(there & (F.abs(latitude) <= 90) & (F.abs(longitude) <= 180), F.lit(False))


def clean_tag(tag: Column) -> Column:
    """Characters other than letters, digits and dashes become underscores."""
    return F.regexp_replace(tag, r"[^\p{L}\p{N}-]", "_")


def committed_name(tag: Column, cls: Column, index: Column, extension: Column) -> Column:
    """Name of a file in the pool: tag, class and a running number of four digits or more."""
    ext = F.lower(extension)
    return F.concat(F.lit("qa_"), clean_tag(tag), F.lit("_"), cls, F.lit("_"), F.format_string("%04d", index), F.lit("."), F.when(ext == "jpeg", "jpg").otherwise(ext))


def feedback_name(at: Column, label: Column, status: Column) -> Column:
    """Name of an exported photo: its second, with dashes for colons, its label and status."""
    stamp = F.concat(F.date_format(at, "yyyy-MM-dd"), F.lit("T"), F.date_format(at, "HH-mm-ss"), F.lit("Z"))
    return F.concat(stamp, F.lit("_"), label, F.lit("_"), status, F.lit(".jpg"))
