"""Run log: timestamped lines to stdout and, once configured, to a file."""

from __future__ import annotations

from datetime import datetime
from pathlib import Path

_file: Path | None = None


def configure(path: str | Path | None) -> None:
    global _file
    _file = Path(path) if path else None
    if _file:
        _file.parent.mkdir(parents=True, exist_ok=True)


def log(message: str, to_file: bool = True) -> None:
    """``to_file=False`` keeps private lines, such as paths, out of the file."""
    line = f"[{datetime.now():%H:%M:%S}] {message}"
    print(line, flush=True)
    if to_file and _file:
        with _file.open("a", encoding="utf-8") as f:
            f.write(line + "\n")
