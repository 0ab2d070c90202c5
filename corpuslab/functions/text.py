"""Path, name, URL, size and duration expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def normalise_url(url: Column, host: str) -> Column:
    """Absolute https URL from an escaped, protocol-relative, rooted or bare one."""
    clean = F.replace(url, F.lit("\\/"), F.lit("/"))
    return (
        F.when(clean.startswith("//"), F.concat(F.lit("https:"), clean))
        .when(clean.startswith("/"), F.concat(F.lit(f"https://{host}"), clean))
        .when(~clean.startswith("http"), F.concat(F.lit(f"https://{host}/"), clean))
        .otherwise(clean)
    )


def to_rel_posix(path: Column, root: str = "") -> Column:
    """Forward slashes, trimmed, relative to ``root``; blank becomes null."""
    clean = F.trim(F.replace(path, F.lit("\\"), F.lit("/")))
    root = root.replace("\\", "/").rstrip("/")
    if root:
        prefix = root + "/"
        clean = F.when(clean.startswith(prefix), F.substring(clean, len(prefix) + 1, 2**31 - 1)).otherwise(clean)
    clean = F.regexp_replace(clean, r"^(\./)+", "")
    return F.nullif(clean, F.lit(""))


# Each of these names its argument once: a filter on the result is pushed below the projection,
# and an argument named twice would be evaluated twice there.


def _posix(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def basename(path: Column) -> Column:
    return F.substring_index(_posix(path), "/", -1)


def folder(path: Column) -> Column:
    """Everything before the base name, without the separator."""
    return F.regexp_replace(_posix(path), r"/?[^/]*$", "")


def raw_suffix(path: Column) -> Column:
    """Last suffix of the base name with its dot, empty when there is none; leading dots start no suffix."""
    return F.regexp_extract(basename(path), r"^\.*[^.].*(\.[^.]*)$", 1)


def suffix(path: Column) -> Column:
    """:func:`raw_suffix` in lower case."""
    return F.lower(raw_suffix(path))


def store_key(path: Column) -> Column:
    """Base name without its last suffix: ``a.b.png`` gives ``a.b``."""
    return F.regexp_replace(basename(path), r"^(\.*[^.].*)\.[^.]*$", "$1")


def safe_filename(path: Column) -> Column:
    """Download-safe PNG name that does not trust the uploaded path."""
    cleaned = F.regexp_replace(store_key(path), r"[^A-Za-z0-9._-]+", "_")
    cleaned = F.regexp_replace(cleaned, r"^[._]+|[._]+$", "")
    return F.concat(F.lit("enhanced_"), F.coalesce(F.nullif(cleaned, F.lit("")), F.lit("portrait")), F.lit(".png"))


# Binary units.
UNITS = ("B", "KB", "MB", "GB", "TB", "PB", "EB")


def human_bytes(size: Column) -> Column:
    """One-decimal size of a whole number of bytes in binary units; halves go to the even digit.

    The unit is the tenth part of the position of the highest bit.
    """
    step = F.floor((F.length(F.bin(F.abs(size))) - 1) / 10).cast("int")
    scaled = F.bround(size.cast("double") / F.pow(F.lit(1024.0), step), 1)
    return F.format_string("%.1f %s", scaled, F.get(F.lit(list(UNITS)), step))


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a timestamp with or without zone."""
    return F.unix_micros(ts.cast("timestamp"))


def duration_seconds(text: Column) -> Column:
    """Seconds in ``H:MM:SS`` or ``N day(s), H:MM:SS``; null when it is neither."""
    pattern = r"^\s*(?:(\d+) days?, )?(\d+):(\d{2}):(\d{2}).*$"
    fields = F.split(F.regexp_replace(text, pattern, "0$1:$2:$3:$4"), ":")
    return F.aggregate(
        F.zip_with(fields, F.array(F.lit(86400), F.lit(3600), F.lit(60), F.lit(1)), lambda v, s: v.try_cast("bigint") * s),
        F.lit(0).cast("bigint"),
        lambda total, v: total + v,
    )
