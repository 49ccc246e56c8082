"""Workbooks written with the standard library alone: strings, numbers and booleans on named sheets."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterable, Mapping, Sequence
from html import escape
from itertools import chain, islice
from pathlib import Path

#: Rows of a sheet below its columns, at most; what the format allows.
SHEET_ROWS = 1_048_575
_ILLEGAL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f]")
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PKG = "http://schemas.openxmlformats.org/package/2006"


def _column(i: int) -> str:
    name = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        name = chr(65 + r) + name
    return name


def _cell(ref: str, value: object) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return f'<c r="{ref}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)) and value == value and abs(value) != float("inf"):
        return f'<c r="{ref}"><v>{value!r}</v></c>'
    if isinstance(value, (list, tuple)):
        value = "; ".join(str(v) for v in value if v)
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(_ILLEGAL.sub("", str(value)), quote=False)}</t></is></c>'


def write_workbook(path: str | Path, sheets: Mapping[str, tuple[Sequence[str], Iterable[Sequence[object]]]]) -> Path:
    """``sheets``: name -> (columns, rows). The first row of a sheet holds the columns; control characters are left out.

    Rows are written as they come. More than SHEET_ROWS go on in further sheets, named with 2, 3, ... behind.
    """
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    names: list[str] = []
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for title, (columns, rows) in sheets.items():
            rest, part = iter(rows), 0
            while (first := next(rest, None)) is not None or not part:
                part += 1
                names.append(title if part == 1 else f"{title} {part}")
                with z.open(f"xl/worksheets/sheet{len(names)}.xml", "w", force_zip64=True) as f:
                    f.write(f'{head}<worksheet xmlns="{_MAIN}"><sheetData>'.encode())
                    for r, row in enumerate(chain([columns], [] if first is None else [first], islice(rest, SHEET_ROWS - 1)), 1):
                        f.write(f'<row r="{r}">{"".join(_cell(f"{_column(c)}{r}", v) for c, v in enumerate(row))}</row>'.encode())
                    f.write(b"</sheetData></worksheet>")
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(names) + 1))
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="{_PKG}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{_PKG}/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        listed = "".join(f'<sheet name="{escape(n[:31], quote=True)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1))
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>{listed}</sheets></workbook>')
        rels = "".join(f'<Relationship Id="rId{i}" Type="{_REL}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{_PKG}/relationships">{rels}</Relationships>')
    return Path(path)
