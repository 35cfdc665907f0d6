"""Scalar expressions: vectors, half precision and text helpers."""

from .text import index_dtype, normalise_extensions, plural, plural_phrase, suffix
from .vectors import dot, l2_norm, rounded, to_half, unit

__all__ = ["dot", "index_dtype", "l2_norm", "normalise_extensions", "plural", "plural_phrase", "rounded", "suffix", "to_half", "unit"]
