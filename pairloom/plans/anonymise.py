"""Series indices of labels, for sharing without paths."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

from ..operators import labels
from ..sources import json_files


def anonymise(spark: SparkSession, output_dir: str | Path, labels_path: str | Path, overwrite: bool = False) -> dict[str, list[int]]:
    """Write series_to_indices.json of a run directory from its image_paths.json."""
    order, out = Path(output_dir) / "image_paths.json", Path(output_dir) / "series_to_indices.json"
    if not order.is_file():
        raise FileNotFoundError(f"no image_paths.json in {output_dir}: is it a run directory?")
    if not Path(labels_path).is_file():
        raise FileNotFoundError(f"no labels file at {labels_path}")
    if out.exists() and not overwrite:
        raise FileExistsError(f"{out} already exists; overwriting was not asked for")
    items = json_files.read_item_order(spark, order)
    marked = json_files.read_labels(spark, labels_path)
    labels.require_all(marked, items)
    return json_files.write_series_indices(labels.indices_by_series(labels.map_paths(marked, items)), out)
