from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from ..functions import normalise_extensions
from ..sources.scan import DEFAULT_EXTENSIONS

DEFAULT_MODEL = "hf-hub:apple/DFN5B-CLIP-ViT-H-14-384"
DTYPES = ("float32", "float16")


@dataclass(frozen=True)
class RunConfig:
    """A pairwise run. ``top_k`` stores neighbours in place of the packed triangle. ``npz``: write the exchange
    file too, in parts through the driver; the Parquet table is always written."""

    input_dir: Path
    output_dir: Path
    model_id: str = DEFAULT_MODEL
    batch_size: int = 32
    device: str = "cpu"
    image_exts: tuple[str, ...] = DEFAULT_EXTENSIONS
    pairwise_dtype: str = "float32"
    top_k: int | None = None
    labels_path: Path | None = None
    overwrite: bool = False
    npz: bool = True

    def __post_init__(self) -> None:
        if not Path(self.input_dir).is_dir():
            raise ValueError(f"the input directory does not exist or is no directory: {self.input_dir}")
        put = lambda name, value: object.__setattr__(self, name, value)
        put("input_dir", Path(self.input_dir))
        put("output_dir", Path(self.output_dir).resolve())
        put("image_exts", normalise_extensions(self.image_exts))
        put("pairwise_dtype", self.pairwise_dtype.lower())
        if self.labels_path:
            put("labels_path", Path(self.labels_path).resolve())
        if self.pairwise_dtype not in DTYPES:
            raise ValueError(f"pairwise_dtype must be one of {DTYPES}")
        if self.top_k is not None and self.top_k <= 0:
            raise ValueError("top_k must be positive")
        if self.batch_size < 1:
            raise ValueError("batch_size must be positive")

    def ensure_output_dir(self) -> None:
        self.output_dir.mkdir(parents=True, exist_ok=True)
