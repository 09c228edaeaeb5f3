"""Keys and blanks as the tables spell them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space and characters that show nothing, as a Java character class body.
BLANK = (
    r"\s\x{0085}\x{00A0}\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{1680}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{2000}-\x{200F}"
    r"\x{2028}-\x{202F}\x{205F}-\x{206F}\x{2800}\x{3000}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}\x00-\x1F\x7F"
)


def strip(text: Column) -> Column:
    """``text`` without blanks at either end."""
    return F.regexp_replace(text, f"^[{BLANK}]+|[{BLANK}]+$", "")


def is_blank(text: Column) -> Column:
    """True for null and for text of nothing but white space and invisible characters."""
    return text.isNull() | text.rlike(f"^[{BLANK}]*$")


def key(text: Column) -> Column:
    """An id without regard to letter case and surrounding blanks; null if blank."""
    bare = F.trim(text)
    clean = F.when(bare.rlike("^[!-~]+$"), F.lower(bare)).otherwise(F.lower(strip(text)))  # most ids need no look at every blank
    return F.when(clean != "", clean)


def metadata_matches(metadata: Column, wanted: dict[str, str]) -> Column:
    """True where JSON ``metadata`` has every wanted key with just this value; a missing key or no metadata is no match."""
    found = F.lit(True)
    for name, value in wanted.items():
        found = found & F.coalesce(F.get_json_object(metadata, f"$.{name}") == value, F.lit(False))
    return found


def without_key(metadata: Column, name: str) -> Column:
    """A JSON map of strings without one of its keys."""
    return F.to_json(F.map_filter(F.from_json(metadata, "map<string,string>"), lambda k, v: k != name))


def first_of(*lists: Column) -> Column:
    """The first of several lists that is neither null nor empty, else an empty one."""
    out = F.array().cast("array<string>")
    for x in reversed(lists):
        out = F.when(F.coalesce(F.size(x), F.lit(0)) > 0, x).otherwise(out)
    return out
