"""The HTML report: driver-side rendering of already sorted tables, row by row; every value is escaped."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from html import escape
from pathlib import Path

#: Sections in the order they stand; each is a title and the key of its rows in the payload.
SECTIONS = (("Run Summary", "summary"), ("Project Answer", "answer"), ("Responsive Index", "index"), ("People", "people"), ("Evidence Timeline", "timeline"), ("Responsive Documents", "documents"), ("Errors", "errors"))


def _table(rows: Iterable[dict]) -> Iterator[str]:
    columns = None
    for row in rows:
        if columns is None:
            columns = [c for c in row if not c.startswith("_")]
            head = "".join(f"<th>{escape(c.replace('_', ' '))}</th>" for c in columns)
            yield f"<table><thead><tr>{head}</tr></thead><tbody>"
        anchor = f' id="{escape(str(row["_anchor"]), quote=True)}"' if row.get("_anchor") else ""
        cells = "".join(f"<td>{_cell(row.get(c))}</td>" for c in columns)
        yield f"<tr{anchor}>{cells}</tr>"
    yield "<p>Nothing to show.</p>" if columns is None else "</tbody></table>"


def _cell(value: object) -> str:
    if value is None:
        return ""
    if isinstance(value, dict):
        return f'<a href="{escape(str(value["href"]), quote=True)}">{escape(str(value["text"]))}</a>' if value.get("href") else escape(str(value["text"]))
    if isinstance(value, (list, tuple)):
        return "; ".join(escape(str(v)) for v in value if v)
    return escape(str(value))


def _page(title: str, payload: dict[str, Iterable[dict]]) -> Iterator[str]:
    style = "body{font:15px/1.5 sans-serif;max-width:70em;margin:2em auto}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:.3em .6em;text-align:left;vertical-align:top}"
    yield f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{escape(title)}</title><style>{style}</style></head><body><h1>{escape(title)}</h1>'
    for name, key in SECTIONS:
        yield f"<section><h2>{escape(name)}</h2>"
        yield from _table(payload.get(key, ()))
        if key == "people" and "mentions" in payload:
            yield from _table(payload["mentions"])
        yield "</section>"
    yield "</body></html>\n"


def render_report(title: str, payload: dict[str, Iterable[dict]]) -> str:
    """A whole page; sections without rows say so."""
    return "".join(_page(title, payload))


def write_report(path: str | Path, title: str, payload: dict[str, Iterable[dict]]) -> Path:
    """:func:`render_report` written row by row, so that sections may be iterators of any length."""
    target = Path(path)
    with target.open("w", encoding="utf-8") as f:
        f.writelines(_page(title, payload))
    return target
