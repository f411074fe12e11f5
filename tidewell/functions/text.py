"""String columns: trimming, names, links, lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without any white space at the ends; SQL's trim takes spaces only."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def null_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def first_filled(*cols: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[null_if_empty(c) for c in cols])


def org_key(c: Column) -> Column:
    """A name for comparison: trimmed, lower case, without a leading article."""
    return F.regexp_replace(F.lower(strip(F.coalesce(c, F.lit("")))), r"^the\s+", "")


def link(c: Column) -> Column:
    """A link with a scheme; an empty one stays empty."""
    s = strip(c)
    return F.when((s == "") | s.rlike("(?i)^https?://"), s).otherwise(F.concat(F.lit("https://"), s))


def link_label(c: Column) -> Column:
    return F.regexp_replace(c, "^https?://", "")


def initials(c: Column, separators: str = r"[\s@.]+") -> Column:
    """Upper-case first characters of the first two words; '?' for none."""
    words = F.filter(F.split(F.coalesce(c, F.lit("")), separators), lambda w: w != "")
    letters = F.array_join(F.transform(F.slice(words, 1, 2), lambda w: F.upper(F.substring(w, 1, 1))), "")
    return F.when(letters == "", "?").otherwise(letters)


def greeting_name(email: Column) -> Column:
    """The part before @ as a name: dots and underscores are spaces, the first letter is upper case."""
    s = strip(F.regexp_replace(F.split_part(email, F.lit("@"), F.lit(1)), "[._]+", " "))
    return F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 1 << 20))


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def comma_list(c: Column) -> Column:
    """Trimmed entries without empty ones; null for an empty or null string."""
    parts = F.filter(F.transform(F.split(c, ","), strip), lambda x: x != "")
    return F.when(F.coalesce(c, F.lit("")) != "", parts)


def line_list(c: Column) -> Column:
    """Trimmed lines without blank ones; null if there is none."""
    parts = F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(parts) > 0, parts)


def sentences(c: Column) -> Column:
    """Split after a full stop, question or exclamation mark that white space and a capital follow."""
    return F.filter(F.transform(F.split(c, r"(?<=[.?!])\s+(?=[A-Z])"), strip), lambda x: x != "")


def contains_ignoring_case(c: Column, wanted: Column) -> Column:
    return F.contains(F.lower(c), F.lower(wanted))


def plural(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))


# What a URL's part may hold though form encoding replaces it.
KEPT_IN_URLS = (("!", "%21"), ("'", "%27"), ("(", "%28"), (")", "%29"), ("~", "%7E"))


def url_query(c: Column) -> Column:
    """Percent-encoded as a part of a URL: %20 for a space, and ' ( ) ! ~ * as they are."""
    out = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    for plain, code in KEPT_IN_URLS:
        out = F.replace(out, F.lit(code), F.lit(plain))
    return out
