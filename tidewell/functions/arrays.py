"""Arrays, structs and JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def null_if_none(a: Column) -> Column:
    """Null for an empty array."""
    return F.when(F.size(a) > 0, a)


def size_or_zero(a: Column) -> Column:
    return F.coalesce(F.when(a.isNotNull(), F.size(a)), F.lit(0))


def add_distinct(a: Column, x: Column) -> Column:
    """With a trimmed entry at the end, unless it is empty or there already."""
    x = F.trim(x)
    return F.when((x == "") | F.array_contains(a, x), a).otherwise(F.array_append(a, x))


def toggle(a: Column, x: Column) -> Column:
    return F.when(F.array_contains(a, x), F.array_remove(a, x)).otherwise(F.array_append(a, x))


def filled(a: Column) -> Column:
    """Without null and empty strings."""
    return F.filter(a, lambda x: x.isNotNull() & (x != ""))


def named_places(a: Column) -> Column:
    """'name (location)' of each struct, joined by commas; the name alone without a location."""
    return F.array_join(F.transform(a, lambda f: F.when(F.coalesce(f["location"], F.lit("")) != "", F.concat(f["name"], F.lit(" ("), f["location"], F.lit(")"))).otherwise(f["name"])), ", ")


def people(a: Column) -> Column:
    """'name (role) [phone: ...]' of each struct."""
    phone = lambda p: F.when(F.coalesce(p["phone"], F.lit("")) != "", F.concat(F.lit(" [phone: "), p["phone"], F.lit("]"))).otherwise("")
    return F.array_join(F.transform(a, lambda p: F.concat(p["name"], F.lit(" ("), p["role"], F.lit(")"), phone(p))), ", ")


def fill_gaps(own: Column, found: Column) -> Column:
    """The own text if filled, else the found one, else empty."""
    return F.coalesce(F.nullif(own, F.lit("")), F.nullif(found, F.lit("")), F.lit(""))


def fill_list(own: Column, found: Column) -> Column:
    return F.when(size_or_zero(own) > 0, own).otherwise(F.coalesce(found, F.array().cast("array<string>")))


def json_text(c: Column, path: str) -> Column:
    """A string at a path; null for numbers, objects and the like."""
    value = F.try_variant_get(F.try_parse_json(c), path, "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(F.try_parse_json(c), path, "string"))


def json_number(c: Column, path: str) -> Column:
    return F.get_json_object(c, path).try_cast("double")


def json_list(c: Column, item: str) -> Column:
    """An array of structs from JSON text; empty for null, for text that isn't such an array, and for other shapes."""
    kind = f"array<{item}>"
    return F.coalesce(F.from_json(c, kind), F.array().cast(kind))


def with_links(a: Column) -> Column:
    """Structs whose ``url`` is a link with a scheme."""
    from tidewell.functions.text import link

    return F.transform(a, lambda x: x.withField("url", link(x["url"])))


def named_only(a: Column) -> Column:
    """Structs that have a name."""
    return F.filter(a, lambda x: F.coalesce(x["name"], F.lit("")) != "")


def high_confidence_first(a: Column) -> Column:
    """Recommended evaluations, those of high confidence first, otherwise in their order."""
    wanted = F.filter(a, lambda e: F.coalesce(e["recommended"], F.lit(False)))
    high = lambda e: F.coalesce(e["confidence"] == "high", F.lit(False))
    return F.concat(F.filter(wanted, high), F.filter(wanted, lambda e: ~high(e)))


def default_selection(approved: Column, evaluations: Column) -> Column:
    """The approved channels, or the recommended ones where nothing was approved yet."""
    return F.coalesce(approved, F.transform(F.filter(evaluations, lambda e: F.coalesce(e["recommended"], F.lit(False))), lambda e: e["channel"]))


def has_substance(*cols: Column) -> Column:
    """Whether any of the texts has more than white space."""
    out = F.lit(False)
    for c in cols:
        out = out | (F.length(F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")) > 0)
    return out
