"""How much of an organization's profile is filled in, and its summary for a prompt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.arrays import filled, named_places, people, size_or_zero
from tidewell.functions.numbers import thousands

# The fields that count.
SCALARS = ("name", "org_type", "year_founded", "website", "annual_budget", "funding_need", "problem_statement", "mission", "programs", "who_we_serve", "hq_location")
LISTS = ("key_people", "geographic_areas", "cause_areas", "org_values", "outcomes", "notable_funders")


def truthy(df: DataFrame, name: str) -> Column:
    """Neither null, nor empty, nor zero."""
    kind = dict(df.dtypes)[name]
    c = F.col(name)
    if kind.startswith("array"):
        return size_or_zero(c) > 0
    return F.coalesce(c != ("" if kind == "string" else 0), F.lit(False))


def completeness(df: DataFrame) -> Column:
    """The share of the fields that are filled."""
    return sum((truthy(df, c).cast("int") for c in (*SCALARS, *LISTS)), F.lit(0)) / F.lit(float(len(SCALARS) + len(LISTS)))


def health(df: DataFrame) -> dict[str, Column]:
    """Five sections, each complete if the fields that prompts read are filled."""
    t = lambda c: truthy(df, c)
    return {
        "mission": t("mission") & t("problem_statement"), "financial": t("annual_budget") & t("funding_need"), "people": t("key_people"),
        "geography": t("geographic_areas"), "track_record": t("outcomes"),
    }


def summary(df: DataFrame) -> Column:
    """One line for each filled field."""

    def line(name: str, title: str, body: Column | None = None) -> Column:
        return F.when(truthy(df, name), F.concat(F.lit(f"{title}: "), F.col(name).cast("string") if body is None else body))

    other = F.when((F.col("org_type") == "other") & truthy(df, "org_type_other"), F.concat(F.lit(" ("), F.col("org_type_other"), F.lit(")"))).otherwise("")
    causes = filled(F.concat(F.coalesce("cause_areas", F.array().cast("array<string>")), F.array(F.col("cause_area_other"))))
    return F.concat_ws(
        "\n",
        line("name", "Organization"), line("org_type", "Legal status", F.concat(F.col("org_type"), other)), line("year_founded", "Founded"),
        line("annual_budget", "Annual budget", F.concat(F.lit("$"), thousands(F.col("annual_budget")))), line("funding_need", "Current funding need"),
        line("problem_statement", "Problem statement"), line("mission", "Mission"), line("vision", "Vision"), line("programs", "Programs"),
        F.when(F.size(causes) > 0, F.concat(F.lit("Cause area(s): "), F.array_join(causes, ", "))), line("who_we_serve", "Population(s) served"),
        line("geographic_areas", "Geographic area served", F.array_join("geographic_areas", ", ")), line("hq_location", "HQ location"),
        line("org_values", "Core values", F.array_join("org_values", "; ")), line("outcomes", "Key outcomes", F.array_join("outcomes", "; ")),
        line("notable_funders", "Notable funders", named_places(F.col("notable_funders"))), line("key_people", "Key people", people(F.col("key_people"))),
    )
