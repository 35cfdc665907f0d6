"""End-to-end plans: pairwise run, label anonymiser, evaluation, and their command lines."""

from .config import RunConfig
from .pairwise import run

__all__ = ["RunConfig", "run"]
