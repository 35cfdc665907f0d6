"""Items from files: recursive scan with component-wise path order."""

from __future__ import annotations

from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import normalise_extensions, suffix

# fixed values: the usual image formats
DEFAULT_EXTENSIONS = (".jpg", ".jpeg", ".png", ".bmp", ".webp", ".tif", ".tiff")


def find_files(root: str | Path, extensions: Iterable[str] = DEFAULT_EXTENSIONS) -> list[Path]:
    """Regular files under ``root`` with one of the extensions in any case, absolute, symlinks
    resolved, sorted by path components. Hidden, underscored and empty files count (Spark's own file
    sources skip them), which is why the listing is made on the driver."""
    wanted = set(normalise_extensions(extensions))
    return sorted(p.resolve() for p in Path(root).rglob("*") if p.is_file() and p.suffix.lower() in wanted)


def items_from_paths(spark: SparkSession, paths: Iterable[str | Path]) -> DataFrame:
    """(idx, path) in the given order."""
    rows = [(i, Path(p).as_posix()) for i, p in enumerate(paths)]
    return spark.createDataFrame(rows, "idx bigint, path string")


def items_from_store(spark: SparkSession, root: str, extensions: Iterable[str] = DEFAULT_EXTENSIONS) -> DataFrame:
    """(idx, path) of the files under a folder in any store that Spark reads, in path order. Spark lists it,
    in a job of its own for large trees; it skips empty files and hidden and underscored names."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    return with_index(filter_extensions(files, extensions))


def read_binary_from_store(spark: SparkSession, root: str, items: DataFrame) -> DataFrame:
    """(idx, path, content) of items (idx, path) from ``items_from_store``, read by Spark's tasks."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "content")
    return files.join(items, "path").select("idx", "path", "content")


def filter_extensions(files: DataFrame, extensions: Iterable[str]) -> DataFrame:
    return files.where(suffix(F.col("path")).isin(list(normalise_extensions(extensions))))


def with_index(paths: DataFrame) -> DataFrame:
    """Number paths from 0 in component order. The order is global, so rows are sorted by ranges and
    numbered by their range's offset: no task sorts all rows."""
    parts = F.split("path", "/")
    ordered = paths.withColumn("part_key", parts).repartitionByRange("part_key").sortWithinPartitions("part_key")
    numbered = ordered.withColumn("mid", F.monotonically_increasing_id()).withColumn("chunk", F.shiftright("mid", 33))
    numbered = numbered.withColumn("within", F.col("mid").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = numbered.groupBy("chunk").agg(F.count(F.lit(1)).alias("size"))
    offset = F.sum("size").over(Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))  # one row a partition
    offsets = sizes.select("chunk", F.coalesce(offset, F.lit(0)).alias("offset"))
    return numbered.join(F.broadcast(offsets), "chunk").select((F.col("offset") + F.col("within")).alias("idx"), "path")


def read_binary(spark: SparkSession, items: DataFrame) -> DataFrame:
    """(idx, path, content) of items (idx, path): the file is read where the row is."""

    def run(batches):
        for batch in batches:
            batch = batch.copy()
            batch["content"] = [Path(p).read_bytes() for p in batch["path"]]
            yield batch[["idx", "path", "content"]]

    return items.select("idx", "path").mapInPandas(run, "idx bigint, path string, content binary")
