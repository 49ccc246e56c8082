"""A small reader of PDF files: objects, pages, what a policy forbids, images drawn, page ranges written anew.

Reads classical and compressed object storage by looking for the objects themselves, so that damaged cross-reference tables
do no harm. Encrypted files are recognised, not decrypted. Only the standard library is used; the functions take bytes and
are meant for ``mapInPandas``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import hypot

import pandas as pd
from pyspark.sql import DataFrame

#: Names of what a policy may forbid, in the order reports give them.
ISSUES = ("not_pdfa", "encrypted", "javascript", "digital_signatures", "embedded_files", "launch_actions", "multimedia", "uri_actions", "interactive_forms", "external_dependencies")
# Annotation and action types that play media.
_MEDIA_ANNOTATIONS = {"Movie", "Sound", "Screen", "RichMedia", "3D"}
_MEDIA_ACTIONS = {"Movie", "Sound", "Rendition", "GoTo3DView", "RichMediaExecute"}
#: Keys a sanitised file loses wherever they stand.
_UNSAFE_KEYS = {"JS", "JavaScript", "OpenAction", "AA", "AcroForm", "AF", "EmbeddedFiles", "Perms", "F", "FFilter", "FDecodeParms", "RichMediaContent", "XFA"}
_UNSAFE_ACTIONS = {"JavaScript", "Launch", "URI", "SubmitForm", "ImportData", "Movie", "Sound", "Rendition", "RichMediaExecute", "GoToR", "GoToE"}

_SPACE, _DELIM = b"\x00\t\n\x0c\r ", b"()<>[]{}/%"


class Name(str):
    """A PDF name, without its slash."""


@dataclass(frozen=True)
class Ref:
    number: int
    generation: int = 0


@dataclass
class Stream:
    info: dict
    raw: bytes


@dataclass
class Operator:
    text: str


class PdfError(ValueError):
    pass


class Lexer:
    """Values one after the other; ``Operator`` for bare words."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def _skip(self) -> None:
        d, n = self.data, len(self.data)
        while self.at < n:
            c = d[self.at]
            if c in _SPACE:
                self.at += 1
            elif c == 0x25:
                while self.at < n and d[self.at] not in b"\r\n":
                    self.at += 1
            else:
                return

    def value(self) -> object:
        """The next value; raises StopIteration at the end."""
        self._skip()
        d = self.data
        if self.at >= len(d):
            raise StopIteration
        c = d[self.at : self.at + 1]
        if d[self.at : self.at + 2] == b"<<":
            return self._dict()
        if c == b"<":
            end = d.find(b">", self.at)
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", d[self.at + 1 : end])
            self.at = (end if end >= 0 else len(d)) + 1
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if c == b"(":
            return self._string()
        if c == b"[":
            self.at += 1
            out = []
            while True:
                self._skip()
                if self.at >= len(d):
                    return out
                if d[self.at] == 0x5D:
                    self.at += 1
                    return out
                x = self.value()
                out.append(x)
                self._reference(out)
        if c == b"/":
            end = self.at + 1
            while end < len(d) and d[end] not in _SPACE and d[end] not in _DELIM:
                end += 1
            raw, self.at = d[self.at + 1 : end], end
            return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m.group(1), 16)]), raw).decode("latin-1"))
        if c in (b")", b">", b"]", b"{", b"}"):
            self.at += 1
            return Operator(c.decode())
        end = self.at
        while end < len(d) and d[end] not in _SPACE and d[end] not in _DELIM:
            end += 1
        word, self.at = d[self.at : end], end
        if re.fullmatch(rb"[+-]?\d+", word):
            return int(word)
        if re.fullmatch(rb"[+-]?(?:\d+\.\d*|\.\d+)", word):
            return float(word)
        return {b"true": True, b"false": False, b"null": None}.get(word, Operator(word.decode("latin-1")))

    @staticmethod
    def _reference(out: list) -> None:
        if isinstance(out[-1], Operator) and out[-1].text == "R" and len(out) > 2 and isinstance(out[-2], int) and isinstance(out[-3], int):
            out[-3:] = [Ref(out[-3], out[-2])]

    def _dict(self) -> dict:
        self.at += 2
        flat: list = []
        while True:
            self._skip()
            if self.at >= len(self.data):
                break
            if self.data[self.at : self.at + 2] == b">>":
                self.at += 2
                break
            flat.append(self.value())
            self._reference(flat)
        out, i = {}, 0
        while i + 1 < len(flat):
            if isinstance(flat[i], Name):
                out[str(flat[i])] = flat[i + 1]
                i += 2
            else:
                i += 1
        return out

    def _string(self) -> bytes:
        d, depth, out = self.data, 0, bytearray()
        while self.at < len(d):
            c = d[self.at]
            if c == 0x5C:
                out += d[self.at : self.at + 2]
                self.at += 2
                continue
            depth += (c == 0x28) - (c == 0x29)
            self.at += 1
            if depth == 0:
                return bytes(out[1:])
            out.append(c)
        return bytes(out[1:])


def _inflate(stream: Stream, resolve) -> bytes:
    filters = resolve(stream.info.get("Filter"))
    names = [filters] if isinstance(filters, Name) else [resolve(f) for f in filters or []]
    data = stream.raw
    for name in names:
        if name in ("FlateDecode", "Fl"):
            data = zlib.decompressobj().decompress(data)
        elif name in ("ASCIIHexDecode", "AHx"):
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", data.split(b">")[0])
            data = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        else:
            raise PdfError(f"filter {name}")
    return data


class Pdf:
    """The objects of one file."""

    def __init__(self, data: bytes):
        if b"%PDF-" not in data[:1024]:
            raise PdfError("no PDF header")
        self.data = data
        self.objects: dict[int, object] = {}
        self.trailer: dict = {}
        for m in re.finditer(rb"(?<!\d)(\d+)\s+(\d+)\s+obj\b", data):
            try:
                self.objects[int(m.group(1))] = self._object(m.end())
            except StopIteration:
                continue
        for m in re.finditer(rb"\btrailer\b", data):
            try:
                found = Lexer(data, m.end()).value()
            except StopIteration:
                continue
            if isinstance(found, dict):
                self.trailer = self.trailer | found
        for obj in list(self.objects.values()):
            if isinstance(obj, Stream) and obj.info.get("Type") == "XRef":
                self.trailer = obj.info | self.trailer if "Root" in self.trailer else self.trailer | obj.info
            elif isinstance(obj, Stream) and obj.info.get("Type") == "ObjStm" and not self.encrypted:
                self._unpack(obj)

    @property
    def encrypted(self) -> bool:
        return "Encrypt" in self.trailer

    def _object(self, at: int) -> object:
        lexer = Lexer(self.data, at)
        value = lexer.value()
        if not isinstance(value, dict):
            return value
        lexer._skip()
        if self.data[lexer.at : lexer.at + 6] != b"stream":
            return value
        start = lexer.at + 6
        start += 2 if self.data[start : start + 2] == b"\r\n" else 1
        length = value.get("Length")
        end = start + length if isinstance(length, int) else -1
        if end < 0 or self.data[end : end + 20].lstrip(b"\r\n \t")[:9] != b"endstream":
            end = self.data.find(b"endstream", start)
            end = len(self.data) if end < 0 else end
            while isinstance(length, Ref) and end > start and self.data[end - 1] in b"\r\n":
                end -= 1
        return Stream(value, self.data[start:end])

    def _unpack(self, stream: Stream) -> None:
        try:
            data = _inflate(stream, self.get)
            count, first = int(self.get(stream.info["N"])), int(self.get(stream.info["First"]))
            head = Lexer(data)
            places = [(head.value(), head.value()) for _ in range(count)]
            for number, offset in places:
                self.objects.setdefault(int(number), Lexer(data, first + int(offset)).value())
        except (PdfError, zlib.error, KeyError, StopIteration, TypeError, ValueError):
            return

    def get(self, value: object) -> object:
        """``value``, or what it refers to; null where that is missing or goes in a circle."""
        seen = set()
        while isinstance(value, Ref):
            if value.number in seen:
                return None
            seen.add(value.number)
            value = self.objects.get(value.number)
        return value

    def mapping(self, value: object) -> dict:
        got = self.get(value)
        return got.info if isinstance(got, Stream) else got if isinstance(got, dict) else {}

    @property
    def root(self) -> dict:
        root = self.mapping(self.trailer.get("Root"))
        if root:
            return root
        return next((o for o in self.objects.values() if isinstance(o, dict) and o.get("Type") == "Catalog"), {})

    def pages(self) -> list[tuple[Ref | None, dict]]:
        """Pages in order with what they inherit from their tree."""
        out: list[tuple[Ref | None, dict]] = []
        stack: list[tuple[object, dict]] = [(self.root.get("Pages"), {})]
        seen = set()
        while stack:
            node, inherited = stack.pop()
            if isinstance(node, Ref):
                if node.number in seen:
                    continue
                seen.add(node.number)
            info = self.mapping(node)
            passed = inherited | {k: info[k] for k in ("Resources", "MediaBox", "CropBox", "Rotate") if k in info}
            kids = self.get(info.get("Kids"))
            if isinstance(kids, list):
                stack += [(k, passed) for k in reversed(kids)]
            elif info:
                out.append((node if isinstance(node, Ref) else None, passed | info))
        return out

    def walk(self, start: object) -> Iterator[tuple[object, bool]]:
        """Every value reachable from ``start`` once, with whether it is a stream."""
        stack, seen = [start], set()
        while stack:
            value = stack.pop()
            if isinstance(value, Ref):
                if value.number in seen:
                    continue
                seen.add(value.number)
                value = self.get(value)
            streamed = isinstance(value, Stream)
            info = value.info if streamed else value
            if isinstance(info, dict):
                yield info, streamed
                stack.extend(info.values())
            elif isinstance(info, list):
                stack.extend(info)


def page_count(data: bytes) -> int | None:
    """Pages of a file; null for what is no PDF or is encrypted."""
    try:
        pdf = Pdf(data)
        return None if pdf.encrypted else len(pdf.pages())
    except (PdfError, RecursionError):
        return None


def policy_flags(data: bytes) -> dict[str, bool]:
    """One flag for each of ISSUES. Conformity to PDF/A is judged by an outside validator only, so 'not_pdfa' is always set
    here; an encrypted file tells nothing else."""
    flags = dict.fromkeys(ISSUES, False) | {"not_pdfa": True}
    pdf = Pdf(data)
    if pdf.encrypted:
        return flags | {"encrypted": True}
    for info, streamed in pdf.walk(pdf.root):
        action, kind, subtype = pdf.get(info.get("S")), pdf.get(info.get("Type")), pdf.get(info.get("Subtype"))
        names = pdf.mapping(info.get("Names"))
        flags["javascript"] |= "JS" in info or "JavaScript" in info or action == "JavaScript" or "JavaScript" in names
        flags["digital_signatures"] |= pdf.get(info.get("FT")) == "Sig" or kind == "Sig" or {"ByteRange", "Contents"} <= info.keys() or bool(pdf.mapping(info.get("Perms")))
        flags["embedded_files"] |= "AF" in info or subtype == "FileAttachment" or kind == "Filespec" and "EF" in info or "EmbeddedFiles" in names
        flags["launch_actions"] |= action == "Launch"
        flags["uri_actions"] |= action == "URI"
        flags["multimedia"] |= subtype in _MEDIA_ANNOTATIONS or action in _MEDIA_ACTIONS or bool({"MediaClip", "RichMediaContent", "3DD"} & info.keys())
        flags["external_dependencies"] |= streamed and bool({"F", "FFilter", "FDecodeParms"} & info.keys()) or kind == "Filespec" and "F" in info and "EF" not in info
    flags["interactive_forms"] = "AcroForm" in pdf.root
    return flags


def issue_names(flags: dict[str, bool]) -> list[str]:
    return [name for name in ISSUES if flags[name]]


def analyse_files(files: DataFrame) -> DataFrame:
    """(path, issues, page_count, error) of files given as (path, content); what can't be read has an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    rows.append((path, issue_names(policy_flags(content)), page_count(content), None))
                except (PdfError, RecursionError, TypeError) as e:
                    rows.append((path, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "issues", "page_count", "error"]).astype({"page_count": "Int32"})

    return files.select("path", "content").mapInPandas(run, "path string, issues array<string>, page_count int, error string")


Matrix = tuple[float, float, float, float, float, float]


def multiply(left: Matrix, right: Matrix) -> Matrix:
    """The transform that applies ``right`` first, then ``left``."""
    a, b, c, d, e, f = left
    p, q, r, s, t, u = right
    return (a * p + c * q, b * p + d * q, a * r + c * s, b * r + d * s, a * t + c * u + e, b * t + d * u + f)


@dataclass
class ImageUse:
    page: int
    object_id: str
    width: int
    height: int
    size: int
    dpi: float | None


def image_uses(data: bytes) -> list[ImageUse]:
    """Every drawing of an image on every page, with the resolution it is shown at (the larger of both directions)."""
    pdf = Pdf(data)
    out: list[ImageUse] = []
    if pdf.encrypted:
        return out
    for number, (_, page) in enumerate(pdf.pages(), 1):
        contents = pdf.get(page.get("Contents"))
        parts = contents if isinstance(contents, list) else [page.get("Contents")]
        code = b"\n".join(_content(pdf, p) for p in parts)
        _draw(pdf, code, pdf.mapping(page.get("Resources")), (1.0, 0.0, 0.0, 1.0, 0.0, 0.0), number, set(), out)
    return out


def _content(pdf: Pdf, value: object) -> bytes:
    stream = pdf.get(value)
    try:
        return _inflate(stream, pdf.get) if isinstance(stream, Stream) else b""
    except (PdfError, zlib.error):
        return b""


def _draw(pdf: Pdf, code: bytes, resources: dict, base: Matrix, page: int, forms: set, out: list[ImageUse]) -> None:
    objects = pdf.mapping(resources.get("XObject"))
    lexer, held, ctm, saved = Lexer(code), [], base, []
    while True:
        try:
            x = lexer.value()
        except StopIteration:
            return
        if not isinstance(x, Operator):
            held.append(x)
            continue
        operands, held = held, []
        if x.text == "q":
            saved.append(ctm)
        elif x.text == "Q":
            ctm = saved.pop() if saved else base
        elif x.text == "cm" and len(operands) == 6:
            ctm = multiply(ctm, tuple(float(o) for o in operands))
        elif x.text == "ID":
            end = code.find(b"EI", lexer.at)
            lexer.at = len(code) if end < 0 else end + 2
        elif x.text == "Do" and operands:
            ref = objects.get(str(operands[0]))
            target = pdf.get(ref)
            if not isinstance(target, Stream):
                continue
            key = f"{ref.number}:{ref.generation}" if isinstance(ref, Ref) else f"direct:{page}:{operands[0]}"
            kind = pdf.get(target.info.get("Subtype"))
            if kind == "Image":
                w, h = (int(pdf.get(target.info.get(k)) or 0) for k in ("Width", "Height"))
                shown = (hypot(ctm[0], ctm[1]), hypot(ctm[2], ctm[3]))
                dpis = [px / (pts / 72.0) for px, pts in zip((w, h), shown) if px > 0 and pts > 0]
                out.append(ImageUse(page, key, w, h, len(target.raw), max(dpis, default=None)))
            elif kind == "Form" and key not in forms:
                forms.add(key)
                matrix = pdf.get(target.info.get("Matrix"))
                inner = multiply(ctm, tuple(float(pdf.get(v)) for v in matrix)) if isinstance(matrix, list) and len(matrix) == 6 else ctm
                _draw(pdf, _content(pdf, ref), pdf.mapping(target.info.get("Resources")) or resources, inner, page, forms, out)


def _write(value: object, number: dict[int, int], pdf: Pdf, drop) -> bytes:
    if isinstance(value, Ref):
        return b"%d 0 R" % number[value.number] if value.number in number else b"null"
    if value is None or value is True or value is False:
        return {None: b"null", True: b"true", False: b"false"}[value]
    if isinstance(value, Name):
        return b"/" + b"".join(bytes([c]) if 33 <= c <= 126 and c not in _DELIM and c != 0x23 else b"#%02X" % c for c in value.encode("latin-1"))
    if isinstance(value, int):
        return b"%d" % value
    if isinstance(value, float):
        return f"{value:.6f}".rstrip("0").rstrip(".").encode() or b"0"
    if isinstance(value, bytes):
        return b"<" + value.hex().encode() + b">"
    if isinstance(value, list):
        return b"[" + b" ".join(_write(v, number, pdf, drop) for v in value if not drop("", v)) + b"]"
    if isinstance(value, dict):
        kept = [(k, v) for k, v in value.items() if not drop(k, v)]
        return b"<<" + b" ".join(_write(Name(k), number, pdf, drop) + b" " + _write(v, number, pdf, drop) for k, v in kept) + b">>"
    return b"null"


@dataclass
class _Copy:
    """A new file out of values of another."""

    pdf: Pdf
    drop: object = field(default=lambda key, value: False)
    number: dict[int, int] = field(default_factory=dict)
    bodies: list[bytes] = field(default_factory=list)

    def need(self, start: object, stop: set[int]) -> None:
        """Gives numbers to everything reachable, but for objects in ``stop``."""
        stack = [start]
        while stack:
            v = stack.pop()
            if isinstance(v, Ref):
                if v.number in self.number or v.number in stop or v.number not in self.pdf.objects:
                    continue
                self.number[v.number] = len(self.number) + 3
                v = self.pdf.objects[v.number]
            v = v.info if isinstance(v, Stream) else v
            if isinstance(v, dict):
                stack += [x for k, x in v.items() if not self.drop(k, x)]
            elif isinstance(v, list):
                stack += [x for x in v if not self.drop("", x)]

    def finish(self, catalog: dict, pages: list[dict]) -> bytes:
        w = lambda v: _write(v, self.number, self.pdf, self.drop)
        kids = range(len(self.number) + 3, len(self.number) + 3 + len(pages))
        objects = {1: w(catalog)[:-2] + b" /Type /Catalog /Pages 2 0 R>>", 2: b"<</Type /Pages /Count %d /Kids [%s]>>" % (len(pages), b" ".join(b"%d 0 R" % k for k in kids))}
        for old, new in self.number.items():
            v = self.pdf.objects[old]
            if isinstance(v, Stream):
                objects[new] = w(v.info | {"Length": len(v.raw)}) + b"\nstream\n" + v.raw + b"\nendstream"
            else:
                objects[new] = w(v)
        for k, page in zip(kids, pages):
            objects[k] = w({x: y for x, y in page.items() if x not in ("Parent", "Type")})[:-2] + b" /Type /Page /Parent 2 0 R>>"
        out, places = bytearray(b"%PDF-1.7\n"), {}
        for n in sorted(objects):
            places[n] = len(out)
            out += b"%d 0 obj\n" % n + objects[n] + b"\nendobj\n"
        at, size = len(out), max(objects) + 1
        out += b"xref\n0 %d\n0000000000 65535 f \n" % size + b"".join(b"%010d 00000 n \n" % places[n] for n in range(1, size))
        return bytes(out + b"trailer\n<</Size %d /Root 1 0 R>>\nstartxref\n%d\n%%%%EOF\n" % (size, at))


def _page_refs(pdf: Pdf) -> set[int]:
    tree = {o for o, v in pdf.objects.items() if isinstance(v, dict) and v.get("Type") in ("Pages", "Catalog")}
    return tree | {r.number for r, _ in pdf.pages() if r is not None}


def write_range(data: bytes, first: int, last: int) -> bytes:
    """Pages ``first`` to ``last`` (from 1) as a file of their own, with what they need and nothing else."""
    pdf = Pdf(data)
    pages = [p for _, p in pdf.pages()][first - 1 : last]
    if pdf.encrypted or not pages:
        raise PdfError("no such pages")
    copy, stop = _Copy(pdf), _page_refs(pdf)
    for p in pages:
        copy.need({k: v for k, v in p.items() if k != "Parent"}, stop)
    return copy.finish({}, pages)


def split_file(data: bytes, limit: int = 50_000_000) -> list[tuple[str, int, int, bytes]]:
    """(chunk id, first page, last page, content): the file halved until every part, as written, is within ``limit``."""
    out: list[tuple[str, int, int, bytes]] = []
    todo = [("001", 1, len(Pdf(data).pages()))]
    while todo:
        chunk, a, b = todo.pop(0)
        part = write_range(data, a, b)
        if len(part) <= limit:
            out.append((chunk, a, b, part))
        elif a == b:
            raise PdfError(f"page {a} alone is above the limit")
        else:
            m = (a + b) // 2
            todo[:0] = [(chunk + "_0", a, m), (chunk + "_1", m + 1, b)]
    return out


def sanitise(data: bytes) -> bytes:
    """The file without scripts, actions that reach outside, forms, attachments and signatures."""
    pdf = Pdf(data)
    if pdf.encrypted:
        raise PdfError("encrypted")

    def drop(key: str, value: object) -> bool:
        info = pdf.mapping(value) if isinstance(value, (Ref, dict, Stream)) else {}
        if pdf.get(info.get("Subtype")) in _MEDIA_ANNOTATIONS | {"FileAttachment"}:
            return True
        return key in _UNSAFE_KEYS or pdf.get(info.get("S")) in _UNSAFE_ACTIONS or key == "Names" and bool({"JavaScript", "EmbeddedFiles"} & info.keys())

    pages = []
    for _, page in pdf.pages():
        annotations = pdf.get(page.get("Annots"))
        if isinstance(annotations, list):
            kept = [a for a in annotations if pdf.get(pdf.mapping(a).get("Subtype")) != "Widget"]
            page = page | {"Annots": kept}
        pages.append(page)
    copy, stop = _Copy(pdf, drop), _page_refs(pdf)
    catalog = {k: v for k, v in pdf.root.items() if k not in ("Pages", "Type", "Names") and not drop(k, v)}
    for v in (*pages, catalog):
        copy.need({k: x for k, x in v.items() if k != "Parent"}, stop)
    return copy.finish(catalog, pages)
