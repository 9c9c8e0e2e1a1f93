"""Column functions for names, keys, flags and amounts."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _folds() -> tuple[str, str]:
    """Letters that decompose into an ASCII letter and marks, with that letter; by rule, not by list."""
    source, target = ["đ"], ["d"]
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(plain) == 1 and plain.isascii() and plain.islower():
            source.append(chr(code))
            target.append(plain)
    return "".join(source), "".join(target)


_SOURCE, _TARGET = _folds()


def normalize_text(c: Column) -> Column:
    """Lower-case ASCII letters, digits, slashes and single spaces; district and ward abbreviations spelt out; null gives ''."""
    t = F.regexp_replace(F.translate(F.lower(F.coalesce(c.cast("string"), F.lit(""))), _SOURCE, _TARGET), r"\p{M}+", "")
    t = F.regexp_replace(F.trim(t), r"\bq(?:\.\s*|\s+)", "quan ")
    t = F.regexp_replace(t, r"\bp(?:\.\s*|\s+)", "phuong ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, "[^0-9a-z/ ]+", " "), r"\s+", " "))


def normalize_admin(c: Column, prefix: str) -> Column:
    """normalize_text with `prefix ` in front, once; '' stays ''."""
    t = normalize_text(c)
    return F.when((t == "") | t.startswith(f"{prefix} "), t).otherwise(F.concat(F.lit(f"{prefix} "), t))


def segment_key(district: Column, ward: Column, street: Column) -> Column:
    return F.concat_ws("|", normalize_admin(district, "quan"), normalize_admin(ward, "phuong"), normalize_text(street))


def flags(**conditions: Column) -> Column:
    """Array of the names whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in conditions.items()]))


def render_flags(c: Column) -> Column:
    """'A|B', or 'OK' for no flags; empty, null and 'OK' entries and repeats go."""
    kept = F.array_distinct(F.filter(c, lambda f: f.isNotNull() & (f != "") & (f != "OK")))
    return F.when(F.size(F.coalesce(kept, F.array())) < 1, "OK").otherwise(F.array_join(kept, "|"))


def parse_coordinate(c: Column) -> Column:
    """Degrees; numbers beyond 1000 are micro-degrees; anything else is null."""
    x = c.try_cast("double")
    x = F.when(~F.isnan(x), x)
    return F.when(F.abs(x) > 1000, x / 1e6).otherwise(x)


def format_money(c: Column) -> Column:
    return F.coalesce(F.format_number(F.bround(c), 0), F.lit("NA"))
