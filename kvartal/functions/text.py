"""Parsers of tag texts as column expressions: heights, ways, identifiers, clocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kvartal.functions.rounding import half_away

_NUM = r"([0-9]+(?:\.[0-9]+)?)"


def metres(text: Column) -> Column:
    """A height in metres from '12', '12.5 m', '40 ft' or feet and inches; null for anything else."""
    t = F.trim(text)
    part = lambda p, i: F.regexp_extract(t, p, i).try_cast("double")
    plain, feet, both = rf"^{_NUM} ?m?$", rf"^{_NUM} ?ft$", r"^([0-9]+)'(?: ?([0-9]+)\")?$"
    return (
        F.when(t.rlike(plain), part(plain, 1))
        .when(t.rlike(feet), part(feet, 1) * 0.3048)
        .when(t.rlike(both), part(both, 1) * 0.3048 + F.coalesce(part(both, 2), F.lit(0.0)) * 0.0254)
    )


def levels(text: Column) -> Column:
    """A single number of levels; lists and ranges are none."""
    return F.trim(text).try_cast("double")


def direction(oneway: Column, highway: Column, junction: Column) -> Column:
    """1 with the way, -1 against it, 0 both: the tag first, then what roundabouts and motorways mean."""
    o = F.lower(F.coalesce(oneway, F.lit("")))
    default = F.when(junction.isin("roundabout", "circular") | highway.isin("motorway", "motorway_link"), 1).otherwise(0)
    return F.when(o.isin("yes", "true", "1"), 1).when(o.isin("-1", "reverse"), -1).when(o.isin("no", "false", "0"), 0).otherwise(default)


def object_type(text: Column) -> Column:
    """Code of the first letter of an object id: n, w or r; null if it is no id."""
    return F.when(text.rlike("^[nwr][0-9]+$"), F.call_function("instr", F.lit("nwr"), F.substring(text, 1, 1)) - 1)


def object_id(text: Column) -> Column:
    return F.when(text.rlike("^[nwr][0-9]+$"), F.substring(text, 2, 30).try_cast("long"))


def role(text: Column) -> Column:
    """A member's role without a trailing number."""
    return F.regexp_replace(text, r"_[0-9]+$", "")


def squeeze(text: Column, most: int) -> Column:
    """White space collapsed, cut to ``most`` characters with an ellipsis."""
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most - 1), F.lit("…"))).otherwise(t)


def clock_seconds(text: Column) -> Column:
    """Seconds of 'HH:MM'; null for anything else."""
    p = r"^([01][0-9]|2[0-4]):([0-5][0-9])$"
    return F.when(text.rlike(p), F.regexp_extract(text, p, 1).try_cast("long") * 3600 + F.regexp_extract(text, p, 2).try_cast("long") * 60)


def speed(km_h: Column) -> Column:
    """km/h as whole mm/s."""
    return half_away(km_h * 1_000_000 / 3600)


def number(x: Column, digits: int) -> Column:
    """A number in fixed format without trailing zeros, minus zero as zero: what the text sinks write."""
    t = F.regexp_replace(F.regexp_replace(F.format_number(x, digits), ",", ""), r"(\.[0-9]*?)0+$", "$1")
    t = F.regexp_replace(t, r"\.$", "")
    return F.when(t == "-0", "0").otherwise(t)
