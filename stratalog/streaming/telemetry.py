"""Event counts and latencies by window, for tables and streams alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The events that are kept and the fields each must have.
EVENT_FIELDS = {"search": ("user_id", "value"), "click": ("user_id",), "view": ("user_id",), "purchase": ("user_id", "value"), "signup": ("user_id",), "error": ()}
OTHER = "other"


def valid_event(event_type: Column, fields: dict[str, Column]) -> Column:
    """Whether an event is of a known type and has the fields of that type."""
    out = F.lit(False)
    for name, needs in EVENT_FIELDS.items():
        ok = event_type == name
        for f in needs:
            ok = ok & fields[f].isNotNull()
        out = out | ok
    return F.coalesce(out, F.lit(False))


def sanitized(events: DataFrame, rules: dict[str, dict[str, tuple[bool, Callable[[Column], Column]]]], event: str = "event_type", props: str = "props") -> DataFrame:
    """``events`` with ``fault``: null for an event that may be kept, else why it goes to the quarantine.

    ``rules`` names the known events and for each its fields: whether it must
    be there, and a test of its value as text. An event of another type, with
    a field that isn't named, without one it must have, or with a value that
    fails its test, isn't kept. ``props`` is a JSON object; works on streams.
    """
    given = F.from_json(F.col(props), "map<string,string>")
    out = F.when(~F.coalesce(F.col(event).isin(*rules), F.lit(False)), "unknown event").when(given.isNull(), "no object")
    for name, fields in rules.items():
        here = F.col(event) == name
        known = F.array(*[F.lit(f) for f in fields]) if fields else F.array().cast("array<string>")
        out = out.when(here & (F.size(F.array_except(F.map_keys(given), known)) > 0), "unknown field")
        for f, (must, test) in fields.items():
            value = F.try_element_at(given, F.lit(f))
            if must:
                out = out.when(here & ~F.array_contains(F.map_keys(given), f), f"no {f}")
            out = out.when(here & F.array_contains(F.map_keys(given), f) & ~F.coalesce(test(value), F.lit(False)), f"bad {f}")
    return events.withColumn("fault", out)


def counted(most: int = 10_000) -> Callable[[Column], Column]:
    """A test for a whole number from 0 to ``most``."""
    return lambda v: v.rlike("^[0-9]{1,9}$") & (v.cast("int") <= most)


def status_class(status: Column) -> Column:
    """2xx, 4xx or 5xx of an HTTP status, other for other numbers, unknown for none."""
    return F.when(status.between(200, 299), "2xx").when(status.between(400, 499), "4xx").when(status.between(500, 599), "5xx").when(status.isNotNull(), "other").otherwise("unknown")


def safe_label(label: Column, known: tuple[str, ...]) -> Column:
    """A label, or ``other`` for one that isn't known."""
    return F.when(label.isin(*known), label).otherwise(F.lit(OTHER))


def events_per_window(events: DataFrame, width: str = "5 minutes", late: str | None = None) -> DataFrame:
    """Events by window and type. On a stream give ``late``, how long a window waits."""
    own = events.withWatermark("ts", late) if late else events
    out = own.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("events"))
    return out.select(F.col("window.start").alias("window_start"), "event_type", "events")


def latency_by_window(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """Median, 95th percentile and mean by window."""
    out = events.groupBy(F.window("ts", width)).agg(F.percentile("value", F.lit(0.5)).alias("p50"), F.percentile("value", F.lit(0.95)).alias("p95"), (F.sum("value") / F.count("value")).alias("mean"))
    return out.select(F.col("window.start").alias("window_start"), *[F.round(c, 6).alias(c) for c in ("p50", "p95", "mean")])


def status_snapshot(events: DataFrame) -> DataFrame:
    """The last time, events and users of each type."""
    return events.groupBy("event_type").agg(F.max("ts").alias("last_seen"), F.count("*").alias("events"), F.countDistinct("user_id").alias("users"))
