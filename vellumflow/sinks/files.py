"""Files beside a report: copies of documents under unique names, markers, JSON."""

from __future__ import annotations

import json
import shutil
from collections.abc import Callable, Iterable
from contextlib import suppress
from pathlib import Path

from vellumflow.operators.ordering import unique_names


def write_json(path: str | Path, value: object) -> None:
    """Indented, keys sorted, with a final line end."""
    Path(path).write_text(json.dumps(value, indent=2, sort_keys=True) + "\n", encoding="utf-8")


def write_marker(directory: str | Path, marker: str = ".pdfdata", payload: object | None = None) -> None:
    """Marks an output directory, so that scans leave it out and version control ignores it."""
    target = Path(directory)
    target.mkdir(parents=True, exist_ok=True)
    write_json(target / marker, payload or {"generated": True})
    (target / ".gitignore").write_text("*\n", encoding="utf-8")


def copy_documents(paths: Iterable[str | Path], target: str | Path, normalise: Callable[[Path], object] | None = None) -> dict[str, str]:
    """Copies of one report's documents in a folder made anew: source path -> name there.

    Each copy is put in order by ``normalise`` where one is given; a copy that can't be stays as it is.
    """
    paths, folder = list(paths), Path(target)
    shutil.rmtree(folder, ignore_errors=True)
    folder.mkdir(parents=True)
    names = unique_names([Path(p).name for p in paths])
    for source, name in zip(paths, names):
        shutil.copyfile(source, folder / name)
        if normalise:
            with suppress(Exception):
                normalise(folder / name)
    return {str(p): n for p, n in zip(paths, names)}
