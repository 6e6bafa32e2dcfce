"""Canonical columns, texts and identifiers of windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEGMENT = "struct<name:string,value_type:string,value:string,parent_name:string>"
TAG = "struct<name:string,value_type:string,value:string>"
CHANGE = "struct<segment_name:string,previous_value:string,current_value:string>"
WINDOWS = (
    "window_name string, key string, source string, partition string, start_position long, end_position long, "
    f"start_time timestamp, end_time timestamp, segments array<{SEGMENT}>, tags array<{TAG}>, "
    f"boundary_reason string, boundary_changes array<{CHANGE}>, segment_key string, record_id string"
)
COLUMNS = [
    "window_name", "key", "source", "partition", "start_position", "end_position", "start_time", "end_time",
    "segments", "tags", "boundary_reason", "boundary_changes", "segment_key", "record_id",
]

#: Type names in canonical texts.
TYPE_NAMES = {"string": "System.String", "long": "System.Int64", "double": "System.Double", "bool": "System.Boolean"}


def no_segments() -> Column:
    return F.array().cast(f"array<{SEGMENT}>")


def no_tags() -> Column:
    return F.array().cast(f"array<{TAG}>")


def segment(name: str, value: Column, parent: str | None = None, value_type: str = "string") -> Column:
    return F.struct(F.lit(name).alias("name"), F.lit(value_type).alias("value_type"), value.cast("string").alias("value"), F.lit(parent).cast("string").alias("parent_name"))


def tag(name: str, value: Column, value_type: str = "string") -> Column:
    return F.struct(F.lit(name).alias("name"), F.lit(value_type).alias("value_type"), value.cast("string").alias("value"))


def value_text(value_type: Column, value: Column) -> Column:
    """``type:value``, with the canonical type name; null is ``<null>``."""
    names = F.create_map(*[F.lit(x) for kv in TYPE_NAMES.items() for x in kv])
    return F.when(value.isNull(), F.lit("<null>")).otherwise(F.concat(F.coalesce(names[value_type], value_type), F.lit(":"), value))


def segment_key(segments: Column) -> Column:
    """``parent/name=type:value;`` of every segment, in order: equal exactly where the contexts are."""
    return F.array_join(F.transform(segments, lambda s: F.concat(F.coalesce(s["parent_name"], F.lit("")), F.lit("/"), s["name"], F.lit("="), value_text(s["value_type"], s["value"]), F.lit(";"))), "")


def _field(name: str, value: Column) -> Column:
    return F.concat(F.lit(name + "="), F.length(value).cast("string"), F.lit(":"), value, F.lit(";"))


def record_id() -> Column:
    """SHA-256 of the length-prefixed canonical fields of a window row."""
    text = lambda c: F.coalesce(F.concat(F.lit("System.String:"), F.col(c)), F.lit("<null>"))
    number = lambda c, none: F.coalesce(F.col(c).cast("string"), F.lit(none))
    time = lambda c: F.coalesce(F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("0+00:00")), F.lit("<null>"))
    plain = lambda v: F.coalesce(v, F.lit("<null>"))
    segments = F.array_join(F.transform("segments", lambda s: F.concat(_field("segment-name", s["name"]), _field("segment-value", value_text(s["value_type"], s["value"])), _field("segment-parent", plain(s["parent_name"])))), "")
    tags = F.array_join(F.transform("tags", lambda t: F.concat(_field("tag-name", t["name"]), _field("tag-value", value_text(t["value_type"], t["value"])))), "")
    typed = lambda v: F.coalesce(F.concat(F.lit("System.String:"), v), F.lit("<null>"))
    changes = F.array_join(F.transform("boundary_changes", lambda c: F.concat(_field("boundary-change-name", c["segment_name"]), _field("boundary-change-previous", typed(c["previous_value"])), _field("boundary-change-current", typed(c["current_value"])))), "")
    count = lambda c: F.greatest(F.size(c), F.lit(0)).cast("string")
    return F.sha2(
        F.concat(
            _field("window", F.col("window_name")), _field("key", text("key")), _field("source", text("source")), _field("partition", text("partition")),
            _field("start-position", number("start_position", "<null>")), _field("end-position", number("end_position", "<open>")),
            _field("start-time", time("start_time")), _field("end-time", time("end_time")),
            _field("end-status", F.when(F.col("end_position").isNull(), "open").otherwise("closed")),
            _field("segments-count", count("segments")), segments, _field("tags-count", count("tags")), tags,
            _field("boundary-reason", plain(F.col("boundary_reason"))), _field("boundary-changes-count", count("boundary_changes")), changes,
        ), 256,
    )


def completed(df: DataFrame) -> DataFrame:
    """The canonical columns from a table that has at least window_name, key and start_position."""
    defaults = {
        "source": F.lit(None).cast("string"), "partition": F.lit(None).cast("string"), "end_position": F.lit(None).cast("long"),
        "start_time": F.lit(None).cast("timestamp"), "end_time": F.lit(None).cast("timestamp"), "segments": no_segments(), "tags": no_tags(),
        "boundary_reason": F.lit(None).cast("string"), "boundary_changes": F.array().cast(f"array<{CHANGE}>"),
    }
    df = df.withColumns({c: v for c, v in defaults.items() if c not in df.columns})
    df = df.withColumns({c: F.coalesce(F.col(c), defaults[c]) for c in ("segments", "tags", "boundary_changes")})
    return df.withColumn("segment_key", segment_key(F.col("segments"))).withColumn("record_id", record_id()).select(*COLUMNS)
