"""Identifiers, labels and tag rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kerbline.constants import NON_REVENUE_ROUTES, SIGNAL_TYPES


def shape_id_for_pattern(pattern: Column) -> Column:
    """Bus shapes are named 678 plus the pattern padded to five digits."""
    return F.concat(F.lit("678"), F.lpad(pattern.cast("string"), 5, "0"))


def pattern_of_shape(shape: Column) -> Column:
    fits = (F.length(shape) == 8) & shape.startswith("678")
    return F.when(fits, F.substring(shape, 4, 5).try_cast("int").cast("string"))


def route_direction_key(route: Column, direction: Column) -> Column:
    return F.concat_ws("_", route, direction)


def trip_uid(trip: Column, vehicle: Column, local_date: Column) -> Column:
    return F.concat_ws("_", trip, vehicle, F.date_format(local_date, "yyyy-MM-dd"))


def utc_day_uid(ts: Column, trip: Column) -> Column:
    return F.concat_ws("_", F.date_format(ts, "yyyyMMdd"), trip)


def trip_key(bus: Column, trip: Column, start: Column) -> Column:
    return F.concat_ws("_", bus, trip, F.date_format(start, "yyyyMMddHHmmss"))


def trailing_digits(text: Column) -> Column:
    found = F.regexp_extract(text, r"(\d+)\D*$", 1)
    return F.when(found != "", found)


def bandwidth_from_name(name: Column) -> Column:
    return F.regexp_extract(name, r"bw(\d+)", 1).try_cast("int")


def strip_agency_prefix(text: Column) -> Column:
    return F.split_part(text, F.lit("_"), F.lit(-1))


def valid_vehicle_id(text: Column, max_digits: int = 5) -> Column:
    return text.rlike(rf"^\d{{1,{max_digits}}}$")


def safe_int(text: Column) -> Column:
    return F.coalesce(text.cast("string").try_cast("double").try_cast("int"), F.lit(0))


def eta_from_countdown(text: Column) -> Column:
    """Minutes from a countdown: DUE is 0, text without leading digits is null."""
    digits = F.regexp_extract(F.trim(text), r"^(\d+)", 1)
    return F.when(F.upper(F.trim(text)) == "DUE", 0).otherwise(digits.try_cast("int"))


def eta_from_time(at: Column, now: Column) -> Column:
    seconds = (F.unix_millis(at) - F.unix_millis(now)) / F.lit(1000.0)
    minutes = F.floor(seconds / 60 + 0.5).cast("int")
    return F.when(minutes < 0, 0).otherwise(minutes)


def is_revenue(route: Column) -> Column:
    name = F.trim(F.coalesce(route, F.lit("None")))
    return ~name.isin(*NON_REVENUE_ROUTES) & ~name.rlike("^(PI|PO|DH)")


def is_signal(control_type: Column) -> Column:
    return control_type.isin(*SIGNAL_TYPES)


def signal_id(node: Column) -> Column:
    return F.concat(F.lit("SIG_"), node.cast("string"))


def crossing_id(node: Column) -> Column:
    return F.concat(F.lit("CX_"), node.cast("string"))


def control_facility_id(control_type: Column, node: Column) -> Column:
    return F.when(is_signal(control_type), signal_id(node)).otherwise(crossing_id(node))


def segment_id(upstream: Column, downstream: Column) -> Column:
    return F.concat(signal_id(upstream), F.lit("__"), signal_id(downstream))


def cross_streets(names: Column, between: str, empty: str) -> Column:
    return F.when(F.size(names) > 0, F.array_join(names, between)).otherwise(empty)


def facility_label(control_type: Column, names: Column) -> Column:
    kind = (
        F.when(control_type == "traffic_signals", "Traffic Signal")
        .when(control_type == "ped_crossing_signal", "Ped Signal")
        .when(control_type == "ped_crossing_marked", "Crosswalk")
        .when(control_type == "stop", "Stop Sign")
        .otherwise("Crossing")
    )
    return F.concat(kind, F.lit(" @ "), cross_streets(names, " / ", "(unnamed)"))


def feature_label(control_type: Column, names: Column) -> Column:
    kind = (
        F.when(is_signal(control_type), "Signal")
        .when(control_type == "ped_crossing_marked", "Crosswalk")
        .when(control_type == "stop", "Stop sign")
        .when(control_type == "give_way", "Yield")
        .otherwise(control_type)
    )
    return F.concat(kind, F.lit(" @ "), cross_streets(names, " & ", "mid-block"))


def tag(tags: Column, key: str) -> Column:
    return F.lower(F.coalesce(F.element_at(tags, key), F.lit("")))


def crossing_type(tags: Column) -> Column:
    """Variant of a crossing node; null when unmarked or no crossing."""
    kind, ref = tag(tags, "crossing"), tag(tags, "crossing_ref")
    marks = tag(tags, "crossing:markings")
    signal = (kind == "traffic_signals") | ref.isin("pelican", "puffin", "toucan", "pegasus", "signals")
    marked = (
        kind.isin("marked", "zebra", "uncontrolled")
        | (ref == "zebra")
        | marks.isin("yes", "zebra", "lines", "dashes", "ladder")
    )
    return F.when(
        tag(tags, "highway") == "crossing",
        F.when(signal, "ped_crossing_signal").when(marked, "ped_crossing_marked"),
    )


def crossing_markings(tags: Column) -> Column:
    marks = F.trim(tag(tags, "crossing:markings"))
    return (
        F.when(marks != "", marks)
        .when(tag(tags, "crossing").isin("zebra", "marked", "uncontrolled"), "yes")
        .when(tag(tags, "crossing_ref") == "zebra", "zebra")
        .otherwise("")
    )


def has_island(tags: Column) -> Column:
    return tag(tags, "crossing:island") == "yes"


def direction_applies(sign: Column, travel: Column) -> Column:
    """Whether a sign's direction tag concerns a vehicle travelling that way."""
    free = sign.isNull() | sign.isin("", "both") | (travel == "unknown")
    return (
        F.when(free, True)
        .when(sign == "forward", travel == "forward")
        .when(sign == "backward", travel == "reverse")
        .otherwise(True)
    )
