"""Column expressions over names, paths, versions and loosely typed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def same_text(column: Column, value: str) -> Column:
    """Equality that ignores case and outer blanks."""
    return F.lower(F.trim(column.cast("string"))) == value.strip().lower()


def matches(column: Column, pattern: str) -> Column:
    """Whether a regular expression is found, in either case; null is false."""
    return F.coalesce(column.rlike(f"(?i){pattern}"), F.lit(False))


def normal_name(column: Column, aliases: dict[str, str] | None = None) -> Column:
    """Outer and repeated blanks collapsed, a parenthetical cut off, and aliases (in either case) replaced."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.trim(column), r"\s+", " "), r"\s*\(.*$", ""))
    if not aliases:
        return plain
    known = F.create_map(*(F.lit(x) for k, v in aliases.items() for x in (k.lower(), v)))
    return F.coalesce(known[F.lower(plain)], plain)


def index_type_of(path: Column) -> Column:
    """NDVI or EVI, from the deepest part of the path that names one."""
    part = F.try_element_at(F.filter(F.reverse(F.split(F.upper(path), "/")), lambda p: p.rlike("NDVI|EVI")), F.lit(1))
    return F.nullif(F.regexp_extract(part, "(NDVI|EVI)", 1), F.lit(""))


def resolution_of(path: Column) -> Column:
    """R10m or R20m, however it is spaced or cased."""
    metres = F.regexp_extract(path, r"(?i)R[\s_-]?(10|20)\s?m", 1)
    return F.when(metres != "", F.concat(F.lit("R"), metres, F.lit("m")))


def year_of(text: Column) -> Column:
    """The first year of 1950 to 2100 that no digit touches."""
    return F.regexp_extract(text, r"(?<!\d)(19[5-9]\d|20\d{2}|2100)(?!\d)", 1).try_cast("int")


def date_of(text: Column) -> Column:
    """The first date written YYYY-MM-DD or YYYY_MM_DD; null if there is no such day."""
    found = F.regexp_extract(text, r"(?<!\d)(\d{4}[-_]\d{2}[-_]\d{2})(?!\d)", 1)
    return F.regexp_replace(found, "_", "-").try_cast("date")


def readable_size(bytes_: Column) -> Column:
    """Binary units, one decimal."""
    x = bytes_.cast("double")
    shown = F.format_string("%.1f TB", x / 1024**4)
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB")):
        shown = F.when(x < 1024.0 ** (power + 1), F.format_string(f"%.1f {unit}", x / 1024**power)).otherwise(shown)
    return F.when(x < 1024, F.format_string("%d B", bytes_.cast("long"))).otherwise(shown)


def as_double(column: Column) -> Column:
    """A finite number, else null; blanks and text are null."""
    x = F.nullif(F.trim(column.cast("string")), F.lit("")).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def as_year(column: Column) -> Column:
    """A whole year of 1900 to 2100, else null."""
    year = as_double(column).try_cast("int")
    return F.when(year.between(1900, 2100), year)


def version_key(version: Column) -> Column:
    """Sortable (major, minor, patch) of a strict three-part version, else null."""
    return F.when(version.rlike(r"^\d+\.\d+\.\d+$"), F.transform(F.split(version, r"\."), lambda p: p.cast("int")))


def bumped(version: Column, part: str) -> Column:
    """The version with one part raised and the later ones at zero."""
    v, at = version_key(version), ("major", "minor", "patch").index(part)
    return F.concat_ws(".", *(v[i] if i < at else v[i] + 1 if i == at else F.lit(0) for i in range(3)))


def stable_hash(*columns: Column, digits: int = 16) -> Column:
    """Leading hex digits of SHA-256 over the columns, separated by a bar."""
    return F.substring(F.sha2(F.concat_ws("|", *columns), 256), 1, digits)
