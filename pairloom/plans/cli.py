"""Command lines: ``python -m pairloom run | anonymize-labels | map``."""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import SparkSession

from ..functions.text import split_extensions
from ..operators.encode import default_device
from ..sources.scan import DEFAULT_EXTENSIONS
from .anonymise import anonymise
from .config import DEFAULT_MODEL, DTYPES, RunConfig
from .evaluate import evaluate
from .pairwise import run


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="pairloom")
    commands = out.add_subparsers(dest="command", required=True)
    p = commands.add_parser("run", help="pairwise distances of the images in a folder")
    p.add_argument("--input-dir", "-i", required=True)
    p.add_argument("--output-dir", "-o", required=True)
    p.add_argument("--model", "-m", default=DEFAULT_MODEL)
    p.add_argument("--batch-size", "-b", type=int, default=32)
    p.add_argument("--device", "-d")
    p.add_argument("--image-exts", default=",".join(DEFAULT_EXTENSIONS))
    p.add_argument("--pairwise-dtype", choices=DTYPES, default="float32")
    p.add_argument("--top-k", type=int)
    p.add_argument("--anonymize-labels")
    p.add_argument("--overwrite", action="store_true")
    p.add_argument("--no-npz", action="store_true", help="leave the distances as a Parquet table")
    p = commands.add_parser("anonymize-labels", help="series indices from labels and a run directory")
    p.add_argument("--output-dir", "-o", required=True)
    p.add_argument("--labels", "-l", required=True)
    p.add_argument("--overwrite", action="store_true")
    p = commands.add_parser("map", help="mAP report from stored distances or neighbours")
    p.add_argument("--distances")
    p.add_argument("--topk")
    p.add_argument("--series-indices")
    p.add_argument("--labels")
    p.add_argument("--image-paths")
    p.add_argument("--output_csv", required=True)
    p.add_argument("--labeled-images-only", action="store_true")
    return out


def config_from(args: argparse.Namespace) -> RunConfig:
    return RunConfig(
        input_dir=Path(args.input_dir).resolve(),
        output_dir=Path(args.output_dir),
        model_id=args.model,
        batch_size=args.batch_size,
        device=args.device or default_device(),
        image_exts=split_extensions(args.image_exts) or DEFAULT_EXTENSIONS,
        pairwise_dtype=args.pairwise_dtype,
        top_k=args.top_k,
        labels_path=Path(args.anonymize_labels) if args.anonymize_labels else None,
        overwrite=args.overwrite,
        npz=not args.no_npz,
    )


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("pairloom").getOrCreate()
    if args.command == "run":
        run(spark, config_from(args))
    elif args.command == "anonymize-labels":
        done = anonymise(spark, args.output_dir, args.labels, args.overwrite)
        print(f"Mapped {len(done)} series to indices.")
    else:
        evaluate(spark, args.output_csv, args.distances, args.topk, args.series_indices, args.labels, args.image_paths, args.labeled_images_only)
