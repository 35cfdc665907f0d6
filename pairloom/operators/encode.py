"""Embedding of items by a pluggable encoder, one model for each Python worker."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol, TypeVar

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

T = TypeVar("T")


class Encoder(Protocol):
    """Made inside a worker by a factory; ``encode`` maps contents to one vector each."""

    def encode(self, batch: Sequence[bytes]) -> np.ndarray: ...

    def close(self) -> None: ...


class HashEncoder:
    """Deterministic stand-in for a model: pseudo-random unit vectors seeded by the content."""

    def __init__(self, dim: int = 16):
        self.dim = dim

    def encode(self, batch: Sequence[bytes]) -> np.ndarray:
        seeds = (int.from_bytes(hashlib.sha256(x).digest()[:8], "big") for x in batch)
        rows = [np.random.default_rng(s).standard_normal(self.dim) for s in seeds]
        out = np.array(rows).reshape(len(batch), self.dim)
        return (out / np.linalg.norm(out, axis=1, keepdims=True)).astype(np.float32)

    def close(self) -> None:
        pass


class ByteEncoder:
    """Stand-in whose vectors are plain to check: size, first and last byte, each doubled."""

    def encode(self, batch: Sequence[bytes]) -> np.ndarray:
        rows = [[len(x), x[0] if x else 0, x[-1] if x else 0] for x in batch]
        return 2 * np.array(rows, np.float32).reshape(len(batch), 3)

    def close(self) -> None:
        pass


class OpenClipEncoder:
    """Image encoder by model id, for environments that have its libraries."""

    def __init__(self, model_id: str, device: str | None = None):
        import open_clip
        import torch

        self.torch = torch
        self.device = device or default_device()
        self.model, self.preprocess = open_clip.create_model_from_pretrained(model_id)
        self.model.to(self.device)
        self.model.eval()

    def encode(self, batch: Sequence[bytes]) -> np.ndarray:
        import io

        from PIL import Image

        with self.torch.no_grad():
            images = [self.preprocess(Image.open(io.BytesIO(x)).convert("RGB")) for x in batch]
            return self.model.encode_image(self.torch.stack(images).to(self.device)).float().cpu().numpy()

    def close(self) -> None:
        self.model = None
        if self.device.startswith("cuda"):
            self.torch.cuda.empty_cache()


def default_device() -> str:
    try:
        import torch
    except ImportError:
        return "cpu"
    return "cuda" if torch.cuda.is_available() else "cpu"


def batched(rows: Sequence[T], size: int) -> Iterator[Sequence[T]]:
    """Consecutive slices of at most ``size``; the last may be short."""
    if size < 1:
        raise ValueError(f"batch size must be positive; got {size}")
    return (rows[at : at + size] for at in range(0, len(rows), size))


def encode(items: DataFrame, factory: Callable[[], Encoder], batch_size: int = 32, content: str = "content") -> DataFrame:
    """(idx, embedding) of items (idx, content). A content that cannot be decoded fails the run."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = factory()
        try:
            for frame in frames:
                for part in batched(range(len(frame)), batch_size):
                    rows = frame.iloc[part.start : part.stop]
                    vectors = encoder.encode([bytes(x) for x in rows[content]])
                    yield pd.DataFrame({"idx": rows["idx"].to_numpy(), "embedding": list(np.asarray(vectors, np.float32))})
        finally:
            encoder.close()

    return items.select("idx", content).mapInPandas(run, "idx bigint, embedding array<float>")
