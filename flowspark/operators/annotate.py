"""Manual labels kept in an append-only table and joined back by flow key."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.functions.exprs import col, flow_key
from flowspark.operators.ordered import lookup_join, number_rows, slice_number
from flowspark.schema import ANNOTATION_SCHEMA


def with_flow_key(df: DataFrame, out: str = "flow_key") -> DataFrame:
    return df.withColumn(out, flow_key(df.columns))


def annotation_records(rows: DataFrame, label: float, annotator: str | None = None, notes: str | None = None) -> DataFrame:
    """Rows to append when flows get a manual label."""
    now = F.concat(F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
    return rows.select(flow_key(rows.columns).alias("flow_key"), F.lit(float(label)).alias("label"),
                       F.lit(annotator or "ui").alias("annotator"), F.lit(notes or "").alias("notes"), now.alias("timestamp"))


def latest_annotations(table: DataFrame, order: list[str] | None = None) -> DataFrame:
    """The newest row of every flow key; rows without a key are dropped, labels that are no number become null."""
    have = set(table.columns)
    order = order or ["timestamp"]
    fields = [(col(f.name).try_cast("double") if f.name == "label" else col(f.name).cast("string")).alias(f.name)
              if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in ANNOTATION_SCHEMA if f.name != "flow_key"]
    rows = table.where(F.col("flow_key").isNotNull())
    newest = rows.groupBy("flow_key").agg(F.max_by(F.struct(*fields), F.struct(*[col(c) for c in order])).alias("r"))
    return newest.select("flow_key", "r.*")


def apply_annotations(df: DataFrame, annotations: DataFrame, out: str = "manual_label") -> DataFrame:
    """Manual label of every flow, null where there is none."""
    side = annotations.select("flow_key", F.col("label").alias(out))
    keyed = df if "flow_key" in df.columns else with_flow_key(df)
    return lookup_join(keyed, side, ["flow_key"])


def annotation_summary(annotations: DataFrame) -> DataFrame:
    label = F.coalesce(F.col("label"), F.lit(-1.0))
    return annotations.agg(F.count(F.lit(1)).alias("total"), F.count_if(label > 0.5).alias("anomalies"),
                           F.count_if(label == 0).alias("normals"))


# Key sets for finding a selected row again, best first.
MATCH_KEYS = [
    ["__source_path__", "flow_id"], ["__source_file__", "flow_id"], ["pcap_file", "flow_id"], ["pcap_name", "flow_id"],
    ["flow_id"], ["frame_time_epoch", "src_ip", "dst_ip", "src_port", "dst_port"],
]


def match_rows(selected: DataFrame, reference: DataFrame, selected_id: str, reference_id: str,
               key_sets: list[list[str]] | None = None) -> DataFrame:
    """One reference row per selected row: columns `selected_id`, `reference_id`, `matched_by`.

    Key sets are tried in turn on the rows still open; within a key, the n-th
    selected row takes the n-th reference row, so no reference row is used twice.
    """
    usable = [k for k in key_sets or MATCH_KEYS if all(c in selected.columns and c in reference.columns for c in k)]
    if not usable:
        raise ValueError("no common key columns")
    done = None
    asked, known = selected.count(), reference.count()
    for keys in usable:
        complete = [col(c).isNotNull() for c in keys]
        left = selected.select(F.col(selected_id), *[c for c in keys])
        right = reference.select(F.col(reference_id), *[c for c in keys])
        for condition in complete:
            left, right = left.where(condition), right.where(condition)
        if done is not None:
            left = left.join(done.select(selected_id), selected_id, "left_anti")
            right = right.join(done.select(reference_id), reference_id, "left_anti")
        left = number_rows(left, keys, [F.col(selected_id)], partial(slice_number, left, selected_id), "__no", most=asked)
        right = number_rows(right, keys, [F.col(reference_id)], partial(slice_number, right, reference_id), "__no", most=known)
        found = left.join(right, keys + ["__no"]).select(selected_id, reference_id, F.lit("+".join(keys)).alias("matched_by"))
        done = found if done is None else done.unionByName(found)
    return done
