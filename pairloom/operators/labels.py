"""Labelled series: members (series, series_ord, pos, idx) and their mapping from paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREVIEW = 20


def map_paths(labels: DataFrame, items: DataFrame) -> DataFrame:
    """Labels (series, series_ord, pos, path) with the idx of their path in items (idx, path); of a
    repeated path the last idx counts. Order and repeats of labels are kept."""
    last = items.groupBy("path").agg(F.max("idx").alias("idx"))
    return labels.join(last, "path").select("series", "series_ord", "pos", "idx")


def missing_paths(labels: DataFrame, items: DataFrame) -> DataFrame:
    return labels.join(items.select("path").distinct(), "path", "left_anti")


def require_all(labels: DataFrame, items: DataFrame) -> None:
    """ValueError that names the first paths which no item has."""
    missing = missing_paths(labels, items)
    n = missing.count()
    if n:
        shown = [r.path for r in missing.orderBy("series_ord", "pos").limit(PREVIEW).collect()]
        more = f"\n  ... and {n - PREVIEW} more" if n > PREVIEW else ""
        raise ValueError("labelled paths that are not among the items:\n  " + "\n  ".join(shown) + more)


def distinct_members(members: DataFrame) -> DataFrame:
    return members.groupBy("series", "idx").agg(F.min("series_ord").alias("series_ord"))


def check_members(members: DataFrame, n: int) -> None:
    """ValueError where an idx is out of bounds, a series has under two members, or there is none."""
    bad = members.where((F.col("idx") < 0) | (F.col("idx") >= n)).select("series", "idx").first()
    if bad:
        raise ValueError(f"index {bad.idx} in series '{bad.series}' is out of bounds for {n} items")
    sizes = series_sizes(members)
    if sizes.isEmpty():
        raise ValueError("there is no series")
    small = sizes.where("size < 2").first()
    if small:
        raise ValueError(f"series '{small.series}' must have at least two distinct items")


def series_sizes(members: DataFrame) -> DataFrame:
    return members.groupBy("series").agg(F.countDistinct("idx").alias("size"))


def largest_series(members: DataFrame) -> DataFrame:
    return series_sizes(members).agg(F.coalesce(F.max("size"), F.lit(0)).alias("largest"))


def labelled_union(members: DataFrame) -> DataFrame:
    return members.select("idx").distinct()


def positives(members: DataFrame) -> DataFrame:
    """(series, q, j): for each member the other members of its series."""
    m = distinct_members(members)
    q = m.select("series", F.col("idx").alias("q"))
    return q.join(m.select("series", F.col("idx").alias("j")), "series").where("q <> j")


def indices_by_series(members: DataFrame) -> DataFrame:
    """(series, series_ord, indices) in label order, repeats kept."""
    return members.groupBy("series", "series_ord").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "idx"))), lambda x: x["idx"]).alias("indices")
    )
