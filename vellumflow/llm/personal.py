"""Personal information in free text: found by a skip-chain conditional random field, replaced by typed placeholders."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumflow.llm.chain import Segments, loopy_marginals
from vellumflow.llm.names import FORMAL, GIVEN, PARTICLES, TITLES, fold, one_slip
from vellumflow.plans.tables import drop_repeats, spread

#: Documents the model is fitted on, those whose hashed id is least; everything else covers all documents.
SAMPLE = 3_600
#: Of the sample's chains without personal information every so manieth is used: they are most of all, and much alike.
PLAIN_EVERY = 8
#: Characters of a sample document that are labelled.
SAMPLE_CHARS = 6_000
EPOCHS, RATE, SHRINK = 25, 0.25, 0.02
#: Every so manieth surname is withheld from the features of the sample.
WITHHELD = 2
#: Texts whose features are made at a time.
FITTED_AT_ONCE = 250
BUCKETS = 1 << 17
#: Of LOOKALIKE_OF different texts, those that make a capitalised word a frequent one; and the share of a surname's texts in
#: which it stands after a title, first name or initial.
LOOKALIKE, LOOKALIKE_OF, NAMED_SHARE = 8, 4_000, 0.15
#: Loopy rounds, and the tokens a chain has at most.
ROUNDS, CHAIN = 2, 96
#: Tokens on either side that tell a passage's language.
WINDOW = 200

LABELS = ("O", "name+", "name", "email", "phone", "id_number", "address+", "address")
OTHER, NAME_B, NAME, EMAIL, PHONE, ID, ADDRESS_B, ADDRESS = range(len(LABELS))
#: No label: the sample does not say.
UNKNOWN = -1
KIND = {NAME_B: "name", NAME: "name", EMAIL: "email", PHONE: "phone", ID: "id_number", ADDRESS_B: "address", ADDRESS: "address"}
PLACEHOLDER = {k: f"[{k.upper()}]" for k in ("name", "email", "phone", "id_number", "address")}

_L = "(?:[^\\W\\d_][̀-ͯ]*)"
_DOT = r"(?:\.|\s?[\[(]\s?dot\s?[\])]\s?|\sdot\s)"
_HOST = r"[A-Za-z0-9][A-Za-z0-9-]*"
_LOCAL = r"[A-Za-z0-9][A-Za-z0-9._+\-]*"
_TOKEN = re.compile(
    rf"(?P<email>{_LOCAL}(?:\s?@\s?|\s?[\[(]\s?(?i:at)\s?[\])]\s?){_HOST}(?i:(?:{_DOT}[A-Za-z][A-Za-z0-9-]*)+)|{_LOCAL}\s(?i:at)\s{_HOST}(?i:(?:(?:\s?[\[(]\s?dot\s?[\])]\s?|\sdot\s)[A-Za-z][A-Za-z0-9-]*)+))"
    r"|(?P<code>(?<![\w-])(?:[a-z]{2}[ -]?\d\d[ -]?\d\d[ -]?\d\d[ -]?[a-d](?!\w)|(?!(?:AS|AT|NO|TO|IS|BY|ON|IN|OF|OR|NR|IT|HE|AL|EL|DE)\b)[A-Z]{1,2}[ -]?\d(?:[ -]?\d){5,8}(?:[ -]?[A-Za-z](?![\w]))?(?!\w)|(?=[A-Z]*\d)(?=\d*[A-Z])[A-Z0-9]{8,12}(?!\w)|\d{7,8}-?[A-Z](?!\w)))"
    r"|(?P<number>(?:\+\d{1,3}|\(\d{1,5}\)|\d+)(?:(?:[ .\-/‐-–]?|\n(?=\()|(?<=\))\n|(?:(?<=[^\d/.\-]0\d)|(?<=[^\d/.\-]0\d\d)|(?<=[^\d/.\-]0\d{4})|(?<=\+\d)|(?<=\+\d\d))\n(?=\d\d)|(?<=\b\d{3})\n(?=\d{3}[-. ]\d{4}\b))(?:\(\d{1,5}\)|\d+))*(?:[a-zA-Z](?!\w))?)"
    rf"|(?P<word>{_L}+(?:['’\-]{_L}+|-\n{_L}+)*)"
    r"|(?P<mark>\S)"
)
# Kinds of streets, before or after the street's name.
STREETS = {"lane", "road", "street", "st", "rd", "ave", "avenue", "court", "ct", "close", "drive", "row", "terrace", "way", "place", "pl", "square", "sq", "ln", "crescent", "boulevard", "blvd", "gardens", "hill", "mews", "walk", "rue", "quai", "chemin", "allee", "impasse", "calle", "avenida", "plaza", "paseo", "camino", "via", "viale"}
STREET_FIRST = {"rue", "quai", "chemin", "allee", "impasse", "avenue", "boulevard", "place"}
STREET_THEN_NUMBER = {"calle", "avenida", "plaza", "paseo", "camino", "via", "viale"}
STREET_ENDS = ("strasse", "str", "weg", "gasse", "platz", "ufer", "allee", "damm")
MONTHS = {"january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december", "januar", "februar", "marz", "mai", "juni", "juli", "oktober", "dezember"}
# Words that announce a telephone number, and those that announce a person's identity number.
CALLS = {"tel", "telephone", "telefon", "telefono", "phone", "fax", "voice", "call", "ring", "ringing", "dial", "reached", "llamar", "appeler", "hers", "his", "night", "mobile", "cell", "rang", "home", "work", "office", "evenings", "handy", "mobil", "anrufen", "erreichbar", "ruckruf"}
IDENTITY = {"passport", "insurance", "security", "identity", "ausweis", "ausweis-nr", "personalausweis", "dni", "passeport", "pasaporte", "id", "travelled", "reisepass", "sozialversicherung", "ssn", "nif", "nie", "securite", "holder", "holder's", "nir", "pensioner", "d'identite", "identite"}
NUMBERED = {"order", "file", "series", "accession", "serial", "waybill", "shelf", "film", "report", "room", "building", "route", "item", "invoice", "roll", "box", "card", "paragraph", "mark", "no", "nr", "drawer", "folder"}
FUNCTION = {"the", "of", "and", "in", "at", "to", "for", "by", "a", "an", "so-called", "de", "la", "le", "von", "der", "die", "das", "late", "from", "is", "was", "were", "did", "el", "des", "du", "that", "on", "with", "or", "but", "not"}
_FRENCH, _ENGLISH = {"le", "la", "les", "du", "des", "et", "été", "au"}, {"the", "of", "and", "was", "to", "is"}


class Tokens:
    """Tokens of one text, with their places and kinds."""

    __slots__ = ("text", "at", "end", "kind", "line", "tab", "french")

    def __init__(self, text: str):
        found = list(_TOKEN.finditer(text))
        self.text = [m.group() for m in found]
        self.kind = [m.lastgroup for m in found]
        self.at, self.end = [m.start() for m in found], [m.end() for m in found]
        self.line, self.tab, last = [], [], 0
        for at, end in zip(self.at, self.end):
            if at == last:
                gap = ""
            elif at == last + 1:
                gap = text[last]
            else:
                gap = text[last:at]
            self.line.append(1 if not last or "\n" in gap else 0)
            self.tab.append("\t" in gap or "   " in gap)
            last = end
        self.french = _french(self.text)

    def __len__(self) -> int:
        return len(self.text)


@lru_cache(200_000)
def _marker(word: str) -> int:
    low = word.lower()
    return (low in _FRENCH) - (low in _ENGLISH)


def _french(words: list[str]) -> list[bool]:
    """Whether the passage around each token is French, by the marker words up to WINDOW tokens before and after it."""
    marks = np.cumsum([0, *map(_marker, words)])
    at = np.arange(len(words))
    return (marks[np.minimum(at + WINDOW, len(words))] > marks[np.maximum(at - WINDOW, 0)]).tolist()


@lru_cache(200_000)
def _bare(word: str) -> str:
    """A word folded, without possessive, line-end hyphen and O'."""
    w = fold(word.replace("-\n", ""))
    w = re.sub(r"['’]s$", "", w)
    return re.sub(r"^o['’]", "", w)


class Lexicon:
    """Given names from the letterheads of all texts, and surnames: words that stand after them, an initial or a title often
    enough among all their uses. ``things`` are frequent words that don't.

    ``scale`` is the number of different texts over LOOKALIKE_OF, 1 at least: what must be seen so often grows with it, so that
    the lexicon is bounded by what a text says, not by how many there are. Rarer surnames are told by what stands around them.
    """

    _HEAD = re.compile(r"(?m)^(?:(?i:from|to|name|cc)\s*:)\s*(.+?)\s*(?:<.*)?$")
    _CAPITAL = re.compile(rf"(?<![\w'’\-])[A-ZÀ-ÖØ-ÞĀ-Ž]{_L}{{2,}}(?:['’\-]{_L}+)*")

    def __init__(self) -> None:
        self.given: set[str] = set(GIVEN) | set(FORMAL)
        self.surnames: set[str] = set()
        self.things: set[str] = set()
        self.near: set[str] = set()
        self.misread: set[str] = set()

    @classmethod
    def heads(cls, text: str) -> Iterator[str]:
        """The first names in a text's letterheads."""
        for head in cls._HEAD.findall(text):
            if not re.fullmatch(rf"(?:{_L}|[\s.,'’-])+", head) or any(w in head.split() for w in ("of", "the", "for")):
                continue
            parts = head.split(",")
            names = parts[1].split() + parts[0].split()[-1:] if len(parts) == 2 and parts[1].strip() else head.split()
            names = [n for n in names if len(n.strip(".")) > 1 and n[0].isupper() and fold(n.strip(".")) not in TITLES]
            if 2 <= len(names) <= 4:
                yield fold(names[0])

    def uses(self, text: str) -> dict[str, tuple[bool, bool]]:
        """Capitalised words of a text: whether one ever follows a title, first name or initial there, and whether one of the latter two."""
        found: dict[str, tuple[bool, bool]] = {}
        for m in self._CAPITAL.finditer(text):
            w, i = m.group(), m.start()
            if w.isupper():
                continue  # where everything is in capitals they tell nothing
            lead = text[max(0, i - 40) : i - 1].split(" ")[-2:] if i > 1 and text[i - 1] == " " else [""]
            before = lead[-1].lstrip("(\"'“„«[")
            number = len(lead) > 1 and lead[0][:1].isdigit()
            b = fold(before).rstrip(".") if before[:1].isupper() and "\n" not in before else ""
            called = b in self.given or len(b) == 1 and before[-1] == "." and not number
            named = called or len(b) > 1 and b in TITLES
            for half in _bare(w).split("-"):
                if len(half) > 2 and half not in self.given and half not in PARTICLES:
                    n, c = found.get(half, (False, False))
                    found[half] = (n or named, c or called)
        return found

    def learn(self, parts: Iterable[tuple[str, int]], scale: float = 1.0) -> None:
        """Takes up (first name, occurrences) of :meth:`heads`."""
        self.given |= {part for part, n in parts if n > scale}

    def learn_words(self, words: Iterable[tuple[str, int, int, int]], scale: float = 1.0) -> None:
        """Takes up (word, texts, texts in which it is named, is called) of :meth:`uses`."""
        for w, n, named, called in words:
            if called >= self.seen_from(scale) and named >= NAMED_SHARE * n:
                self.surnames.add(w)
            elif n >= LOOKALIKE * scale:
                self.things.add(w)
        self.near = {v for w in self.surnames if len(w) > 5 for v in _shorter(w)}
        self.misread = {v for w in self.things if len(w) > 5 for v in _shorter(w)}

    def without(self, share: int) -> Lexicon:
        """This lexicon with every so manieth surname, by a hash of it, unknown."""
        part = Lexicon()
        part.given, part.things, part.misread = self.given, self.things, self.misread
        part.surnames = {w for w in self.surnames if zlib.crc32(w.encode()) % share}
        part.near = {v for w in part.surnames if len(w) > 5 for v in _shorter(w)} - {v for w in self.surnames - part.surnames for v in _shorter(w)}
        return part

    @staticmethod
    def seen_from(scale: float) -> float:
        """Texts a surname must be called in."""
        return max(2.0, scale / 4)

    def is_given(self, word: str) -> bool:
        w = fold(word)
        return w in self.given and word[0].isupper()

    def is_surname(self, word: str) -> bool:
        """A known surname or two, or a rare word one slip from a known one."""
        if not word[0].isupper():
            return False
        return all(h in self.surnames or self._misread(h) for h in _bare(word).split("-"))

    def _misread(self, w: str) -> bool:
        if len(w) < 6 or w in self.things or w in self.given:
            return False
        return any(v in self.near or v in self.surnames for v in _shorter(w))


def _shorter(word: str) -> set[str]:
    """A word and all it can be with one letter dropped: words one slip apart have one of these in common."""
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}


@lru_cache(200_000)
def _shape(word: str) -> str:
    word = word.replace("\n", " ")
    if any(c.isdigit() for c in word):
        return re.sub(r"[A-Z]", "A", re.sub(r"[a-z]", "a", re.sub(r"\d", "9", word)))[:22]
    head = "X" if word[0].isupper() else "x"
    return head + ("X" if len(word) > 1 and word.isupper() else "x" if len(word) > 1 else "") + ("-" if "-" in word else "") + ("'" if "'" in word or "’" in word else "")


def word_class(word: str, kind: str, lexicon: Lexicon) -> str:
    """One of a few classes: what stands around a word is told apart by these."""
    if kind == "email" or kind == "code":
        return kind
    if kind == "number":
        digits = sum(c.isdigit() for c in word)
        return "n" + ("s" if digits <= 4 and len(word) <= 9 and not set(word) & set("./()+") else "+" if word[0] in "+(" else "x" if digits < 7 else "l")
    if kind == "mark":
        return word if word in ".,:;()[]<>\"'-/&" else "mark"
    low = fold(word)
    if len(low) == 1 and word.isupper():
        return "initial"
    if low in FUNCTION:
        return low
    if low in TITLES and (word[0].isupper() or low in ("herr", "frau")) and len(low) > 1:
        return "title"
    if low in STREETS:
        return "street"
    if low in MONTHS:
        return "month"
    if lexicon.is_given(word):
        return "given"
    if lexicon.is_surname(word):
        return "surname" + ("'s" if low.endswith(("'s", "’s")) else "")
    if len(low) > 3 and low.endswith(STREET_ENDS) and word[0].isupper():
        return "streetword"
    if low in PARTICLES:
        return "particle"
    if word.isupper():
        return "caps2" if len(word) == 2 else "caps"
    return "cap" if word[0].isupper() else "low"


def _bucket(feature: str) -> int:
    return zlib.crc32(feature.encode()) & (BUCKETS - 1)


def _word_features(word: str, cls: str, lexicon: Lexicon) -> tuple[list[int], list[int]]:
    """Buckets of what a word says of itself, and of what it says of its neighbours.

    A capitalised word that is neither frequent nor a known name says no more than that: how it is spelt is not looked at.
    """
    bare = _bare(word)[:24]
    rare = cls in ("cap", "caps") and bare not in lexicon.things
    return _word_buckets(word, cls, bare, rare, rare and len(bare) > 5 and not lexicon.misread.isdisjoint(_shorter(bare)))


@lru_cache(200_000)
def _word_buckets(word: str, cls: str, bare: str, rare: bool, misread: bool) -> tuple[list[int], list[int]]:
    if cls in ("email", "code") or cls[0] == "n" and any(c.isdigit() for c in word):
        shape, digits = _shape(word) if cls != "email" else "", sum(c.isdigit() for c in word)
        own = [f"c={cls}", f"s={shape}", f"d={cls}{digits}", f"lead={word[0] if not word[0].isalnum() else ''}", f"c={cls}", "number"]
        return [_bucket(f) for f in own], [_bucket(f) for f in (f"c={cls}", f"c={cls}")]
    said = "name" if cls.startswith("surname") or cls == "given" else "misread" if misread else "rare" if rare else bare
    own = [f"w={said}", f"s={_shape(word)}", f"long={min(len(bare), 4)}{cls}", f"e3={bare[-3:] if word[0].islower() else ''}", f"c={cls}", "word"]
    near = [f"w={said}" if cls in ("low", "cap", "caps") or len(bare) < 12 else "w=", f"c={cls}"]
    return [_bucket(f) for f in own], [_bucket(f) for f in near]


@lru_cache(200_000)
def _around_buckets(a: str, b: str, d: str, e: str, f: str, ln: int) -> list[int]:
    """Buckets of a token's class ``a`` among those before it (``b``, ``e``) and after it (``d``, ``f``)."""
    return [_bucket(x) for x in (f"lr {b} {a} {d}", f"l {b} {a}", f"r {a} {d}", f"ll {e} {b} {a}", f"rr {a} {d} {f}", f"n {ln} {a} {d}", f"lead {ln // 3} {b} {a}", f"lead {ln // 3} {e} {b} {a}")]


@lru_cache(200_000)
def _number_buckets(key: tuple) -> list[int]:
    """Buckets of what leads up to a number or code and what its form is, or of a letter in a French passage."""
    if not key:
        feats = []
    elif key[0] == "f":
        feats = [f"french {key[1]}"]
    else:
        _, shape, b3, b2, b1, after, street = key
        said = {b1, b2, b3}
        tone = "call" if said & CALLS else "identity" if said & IDENTITY else "numbered" if said & NUMBERED else ""
        digits = sum(c == "9" for c in shape)
        feats = [f"shape {shape}", f"shape {shape} {b1}", f"b1 {b1} {digits}", f"b2 {b2} {digits}", f"b3 {b3} {digits}", f"tone {tone}", f"tone {tone} {shape}", f"tone {tone} {digits}", f"after {after} {digits}", f"street {street}", f"b12 {b2} {b1}", f"lead {shape[:1]} {digits}"]
    return [_bucket(f) for f in feats] + [_bucket("none")] * (12 - len(feats))


#: What a token of a kind can be at all; other labels have no potential there.
_POSSIBLE = {"email": (OTHER, EMAIL), "number": (OTHER, PHONE, ID, ADDRESS_B, ADDRESS), "code": (OTHER, PHONE, ID, ADDRESS_B, ADDRESS), "word": (OTHER, NAME_B, NAME, ADDRESS_B, ADDRESS), "mark": (OTHER, NAME, ADDRESS)}
_MASKS = {kind: np.array([0.0 if y in which else -30.0 for y in range(len(LABELS))]) for kind, which in _POSSIBLE.items()}


class Features:
    """Buckets of every token of some texts, shared between equal words and equal surroundings."""

    def __init__(self, docs: list[Tokens], lexicon: Lexicon):
        words: dict[tuple[str, str], int] = {}
        ids = np.array([words.setdefault((w, k), len(words)) for d in docs for w, k in zip(d.text, d.kind)], dtype=np.int64)
        classes = [word_class(w, k, lexicon) for w, k in words]
        names: dict[str, int] = {}
        cls_of = np.array([names.setdefault(c, len(names)) for c in classes], dtype=np.int64) if classes else np.zeros(0, np.int64)
        self.n = n = len(ids)
        self.classes = [classes[i] for i in ids.tolist()]
        sizes = np.array([len(d) for d in docs], dtype=np.int64)
        leads = np.concatenate([_leads(self.classes[e - m : e]) for m, e in zip(sizes.tolist(), np.cumsum(sizes).tolist())]) if n else np.zeros(0, np.int64)
        self.doc_starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        doc = np.repeat(np.arange(len(docs)), sizes)
        kinds = list(_MASKS)
        self.masks = np.array([_MASKS[k] for k in kinds])[np.array([kinds.index(k) for d in docs for k in d.kind], dtype=np.int64)] if n else np.zeros((0, len(LABELS)))
        self.tables: list[tuple[np.ndarray, np.ndarray]] = []  # (place in table of each token, buckets of each row)
        pairs = [_word_features(w, c, lexicon) for (w, _), c in zip(words, classes)]
        none = len(pairs)
        own = np.array([p[0] for p in pairs] + [[0] * 6], dtype=np.int64)
        near = np.array([p[1] for p in pairs] + [[_bucket("edge")] * 2], dtype=np.int64)

        def shifted(values: np.ndarray, by: int, edge: int) -> np.ndarray:
            out = np.full(n, edge, dtype=np.int64)
            if by > 0:
                out[by:] = np.where(doc[by:] == doc[:-by], values[:-by], edge) if n > by else out[by:]
            else:
                out[:by] = np.where(doc[:by] == doc[-by:], values[-by:], edge) if n > -by else out[:by]
            return out

        self.tables.append((ids, own))
        for role, by in (("left", 1), ("left2", 2), ("right", -1), ("right2", -2)):
            salt = _bucket(role)
            self.tables.append((shifted(ids, by, none), (near ^ salt) & (BUCKETS - 1)))
        label = list(names)
        edge = len(label)
        label.append("edge")
        c0 = cls_of[ids] if n else np.zeros(0, np.int64)
        line = np.array([x or 2 * t for d in docs for x, t in zip(d.line, d.tab)], dtype=np.int64)
        cm2, cm, cp, cp2 = (shifted(c0, b, edge) for b in (2, 1, -1, -2))
        k = edge + 1
        line = line + 3 * leads
        around = ((((c0 * k + cm) * k + cp) * k + cm2) * k + cp2) * 9 + line
        unique, place = np.unique(around, return_inverse=True)
        rows = []
        for code in unique.tolist():
            code, ln = divmod(code, 9)
            code, p2 = divmod(code, k)
            code, m2 = divmod(code, k)
            code, p1 = divmod(code, k)
            c, m1 = divmod(code, k)
            rows.append(_around_buckets(label[c], label[m1], label[p1], label[m2], label[p2], ln))
        self.tables.append((place, np.array(rows or [[0] * 8], dtype=np.int64)))
        self._numbers(docs, names)

    def _numbers(self, docs: list[Tokens], names: dict[str, int]) -> None:
        """For numbers, codes and words of surnames' class: the words that lead up to them, and what their form is."""
        keys: dict[tuple, int] = {(): 0}
        place = np.zeros(self.n, dtype=np.int64)
        i = 0
        for d in docs:
            low = [fold(w) if k == "word" else "" for w, k in zip(d.text, d.kind)]
            for j in range(len(d)):
                kind = d.kind[j]
                if kind in ("number", "code"):
                    before = [w for w in low[max(0, j - 7) : j] if w][-3:]
                    after = next((w for w in low[j + 1 : j + 4] if w), "")
                    street = _street_near(d, low, j)
                    key = ("n", _shape(d.text[j]), *([""] * (3 - len(before))), *before, after, street)
                elif len(low[j]) == 1 and d.french[j]:
                    key = ("f", low[j])
                else:
                    i += 1
                    continue
                place[i] = keys.setdefault(key, len(keys))
                i += 1
        rows = [_number_buckets(k) for k in keys]
        self.tables.append((place, np.array(rows, dtype=np.int64)))

    def subset(self, chosen: np.ndarray) -> Features:
        """The features of some tokens only."""
        part = object.__new__(Features)
        part.n, part.masks = int(chosen.sum()), self.masks[chosen]
        part.tables = []
        for place, buckets in self.tables:
            used, own = np.unique(place[chosen], return_inverse=True)
            part.tables.append((own, buckets[used]))
        return part

    @classmethod
    def joined(cls, parts: list[Features]) -> Features:
        """The features of several sets of texts, one after the other."""
        whole = object.__new__(cls)
        whole.n, whole.masks, whole.tables = sum(p.n for p in parts), np.concatenate([p.masks for p in parts]), []
        for t in range(len(parts[0].tables)):
            before = np.cumsum([0, *(len(p.tables[t][1]) for p in parts)])
            buckets, same = np.unique(np.concatenate([p.tables[t][1] for p in parts]), axis=0, return_inverse=True)
            places = np.concatenate([p.tables[t][0] + o for p, o in zip(parts, before)])
            whole.tables.append((same.ravel()[places], buckets))
        return whole

    def scores(self, weights: np.ndarray) -> np.ndarray:
        total = self.masks.astype(np.float64)
        for place, buckets in self.tables:
            total += weights[buckets].sum(axis=1)[place]
        return total

    def gradient(self, by_token: np.ndarray) -> np.ndarray:
        out = np.zeros((BUCKETS, by_token.shape[1]))
        for place, buckets in self.tables:
            for k in range(by_token.shape[1]):
                by_row = np.bincount(place, weights=by_token[:, k], minlength=len(buckets))
                out[:, k] += np.bincount(buckets.ravel(), weights=np.repeat(by_row, buckets.shape[1]), minlength=BUCKETS)
        return out


def _leads(classes: list[str]) -> np.ndarray:
    """For a first name, initial or particle: 1 if only such words lead from it to a surname, 2 if to something else; else 0."""
    out = np.zeros(len(classes), dtype=np.int64)
    reach = 2
    for j in range(len(classes) - 1, -1, -1):
        c = classes[j]
        if c in ("surname", "surname's"):
            reach = 1
        elif c in ("given", "initial", "caps2", "particle"):
            out[j] = reach
        elif c != "." or j == 0 or classes[j - 1] not in ("initial", "caps2"):
            reach = 2
    return out


def _street_near(d: Tokens, low: list[str], j: int) -> str:
    """Whether the number at ``j`` looks like a house number: of a street named after or before it."""
    if d.kind[j] != "number" or sum(c.isdigit() for c in d.text[j]) > 8 or d.text[j][0] in "+(":
        return ""
    for k in range(j + 1, min(j + 7, len(d))):
        w = low[k]
        if w in STREET_FIRST and k <= j + 3:
            return "first"
        if w in STREETS and k > j + 1 and w not in STREET_THEN_NUMBER:
            return "after"
        point = d.text[k] == "." and k > j + 1 and len(low[k - 1]) <= 2 or d.text[k] == "," and k <= j + 2 and (k == j + 1 or low[k - 1] in ("bis", "ter"))
        if d.tab[k] or d.line[k] and k > j + 1 or not w and not point or w in FUNCTION and w not in ("de", "la", "des") or w and w not in ("bis", "ter", "de", "la", "des", "du") and not d.text[k][0].isupper():
            break
    if j and low[j - 1 if d.text[j - 1] != "." else j - 2].endswith(STREET_ENDS):
        return "before"
    for k in range(j - 1, max(-1, j - 6), -1):
        if low[k] in STREET_THEN_NUMBER or d.text[k] == "/" and k and d.text[k - 1] == "C":
            return "then"
        if not low[k] or d.line[k + 1]:
            break
    return ""


def weak_labels(d: Tokens, classes: list[str], lexicon: Lexicon) -> np.ndarray:
    """Labels of a sample text by rules that are seldom wrong: the CRF learns from these what the words and forms tell.

    A surname that stands by itself is taken for a name if its text elsewhere gives it a first name, initial or title; else it
    is UNKNOWN: whether it names somebody there is left to the field.
    """
    n = len(d)
    out = np.zeros(n, dtype=np.int64)
    low = [fold(w) if k == "word" else "" for w, k in zip(d.text, d.kind)]
    for j in range(n):
        if d.kind[j] == "email":
            out[j] = EMAIL
        elif d.kind[j] == "code":
            before = set(w for w in low[max(0, j - 8) : j] if w)
            out[j] = ID if before & IDENTITY or d.text[j][:2].lower() == "qq" else OTHER
        elif d.kind[j] == "number":
            out[j] = _number_label(d, low, j)
    for j in range(n):
        if d.kind[j] == "number" and out[j] == OTHER and (street := _street_near(d, low, j)):
            first, last = _address_tokens(d, low, j, street)
            out[first] = ADDRESS_B
            out[first + 1 : last + 1] = ADDRESS
    j = 0
    while j < n:
        j = _mark_name(d, classes, low, j, out, lexicon)
    called = {_bare(d.text[j]) for j in range(n) if out[j] in (NAME_B, NAME) and classes[j] in _NAMED}
    for j in np.flatnonzero(out == UNKNOWN).tolist():
        if _bare(d.text[j]) in called:
            out[j] = NAME_B
    return out


def _number_label(d: Tokens, low: list[str], j: int) -> int:
    text = d.text[j]
    groups = [len(g) for g in re.findall(r"\d+", text)]
    digits = sum(groups)
    before = [w for w in low[max(0, j - 8) : j] if w]
    if before and before[-1] in ("serial", "waybill", "series", "accession", "mark"):
        return OTHER
    if set(before[-5:]) & IDENTITY and digits >= 7:
        return ID
    if groups == [3, 2, 4] or groups == [1, 2, 2, 2, 3, 3]:
        return ID
    near = set(before[-4:])
    if not 7 <= digits <= 15 or groups == [4, 2, 2] or groups == [2, 2, 4] or len(groups) > 6 or "/" in text and not near & CALLS:
        return OTHER
    if text[0] in "+(":
        return PHONE
    if digits == 7 or len(groups) == 1:
        return PHONE if near & CALLS and before[-1] != "no" else UNKNOWN if digits == 10 and not near & NUMBERED else OTHER
    plausible = groups in ([3, 3, 4], [3, 4, 4], [5, 6], [4, 3, 4], [1, 3, 3, 4], [1, 3, 7], [3, 7], [2, 2, 2, 2, 2], [2, 4, 4], [3, 5, 3], [4, 2, 5, 3], [3, 8], [5, 3, 3])
    return PHONE if plausible or near & CALLS else OTHER


def _address_tokens(d: Tokens, low: list[str], j: int, street: str) -> tuple[int, int]:
    """First and last token of the number and street around the house number at ``j``."""
    first = last = j
    if street in ("after", "first"):
        for k in range(j + 1, min(j + 7, len(d))):
            last = k
            if low[k] in STREETS and (street == "first" or k > j + 1):
                break
    elif street == "before":
        first = j - 1 if d.text[j - 1] != "." else j - 2
    else:
        k = j - 1
        while k > 0 and low[k] not in STREET_THEN_NUMBER and d.text[k] != "/":
            k -= 1
        first = k - (d.text[k] == "/")
    return first, last


_NAMED = ("surname", "surname's")
# Words before a surname that labels a thing, with what scanning makes of them.
_LABELLING = {"the", "th", "he", "te", "thc", "tbe", "tho", "hte", "tlie", "so-called", "called", "led"}


def _monsieur(d: Tokens, low: list[str], k: int) -> bool:
    """Whether the M at ``k`` is French for Mr. and no initial."""
    if low[k] != "m":
        return False
    before = low[k - 1] if k else ""
    return d.french[k] and before in ("a", "de", "cher", "et", "par") or "a" in d.text[k + 2 : k + 5]


def _mark_name(d: Tokens, cls: list[str], low: list[str], j: int, out: np.ndarray, lexicon: Lexicon) -> int:
    """Labels the mention that begins at ``j``, if one does; the place to go on from."""
    n = len(d)
    if out[j] != OTHER:
        return j + 1
    k, firsts = j, 0
    while k < n and firsts < 4:  # first names and initials may stand at the end of a line
        c = cls[k]
        if c == "given" or c in ("initial", "caps2") and not (k == j and _monsieur(d, low, k)):
            k += 1
            firsts += 1
            if c != "given":
                while k < n and d.text[k] == ".":
                    k += 1
        elif c == "cap" and firsts == 0 and k + 1 < n and cls[k + 1] in _NAMED and not d.line[k + 1] and any(one_slip(low[k], g) for g in lexicon.given if g[:1] == low[k][:1] or g[1:2] == low[k][1:2]) and len(low[k]) > 3:
            k += 1
            firsts += 1
        else:
            break
    while k < n and cls[k] in ("particle",) and k + 1 < n:
        k += 1
    if k < n and cls[k] in _NAMED:
        if firsts == 0 and j > 0 and low[j - 1] in _LABELLING:
            return k + 1  # the surname labels a thing
        if firsts == 0 and k + 1 < n and cls[k + 1] == "street":
            return k + 1
        alone = k == j and not (j and (cls[j - 1] == "title" or d.text[j - 1] == "." and j > 1 and cls[j - 2] == "title"))
        out[j] = NAME_B
        out[j + 1 : k + 1] = NAME
        k += 1
        if firsts == 0 and k + 1 < n and d.text[k] == ",":  # Surname, Given M.
            m, more = k + 1, 0
            while m < n and more < 3 and cls[m] in ("given", "initial", "caps2") and not d.line[m]:
                m += 1
                more += 1
                while m < n and d.text[m] == "." and not d.line[m]:
                    m += 1
            if more and not (m < n and (cls[m] in _NAMED or cls[m] == "particle") and not d.line[m]):
                out[k:m] = NAME
                return m
        if alone:
            out[j] = UNKNOWN
        return k
    return j + 1


def _wrapped(last: str, before: str) -> bool:
    """Whether a line may end inside a name after these words: a capitalised word, or an initial and its point."""
    return last[0].isupper() and last.isalpha() or last == "." and len(before) == 1 and before.isupper() or last in ("van", "von")


def chain_starts(docs: list[Tokens]) -> np.ndarray:
    """First tokens of the chains: documents, lines, and runs of CHAIN tokens, broken where no capital stands."""
    starts, base = [], 0
    for d in docs:
        last = 0
        for j in range(len(d)):
            if j == 0 or d.line[j] and not _wrapped(d.text[j - 1], d.text[j - 2] if j > 1 else "") or j - last >= CHAIN and (d.text[j][:1].islower() or j - last >= 2 * CHAIN):
                starts.append(base + j)
                last = j
        base += len(d)
    return np.array(starts, dtype=np.int64)


def skip_links(docs: list[Tokens], classes: list[str]) -> np.ndarray:
    """Each capitalised word of five letters or more, linked to the last one in its document that begins alike once folded."""
    links, base = [], 0
    for d in docs:
        seen: dict[str, int] = {}
        for j, (w, k) in enumerate(zip(d.text, d.kind)):
            if k == "word" and len(w) >= 5 and w[0].isupper() and classes[base + j] not in ("month", "street", "title"):
                key = _bare(w)[:7]
                if key in seen:
                    links.append((base + seen[key], base + j))
                seen[key] = j
        base += len(d)
    return np.array(links, dtype=np.int64).reshape(-1, 2)


class Model:
    """Weights, transitions and skip potentials, and the lexicon the features need."""

    def __init__(self, lexicon: Lexicon):
        k = len(LABELS)
        self.lexicon = lexicon
        self.weights = np.zeros((BUCKETS, k))
        self.transition, self.start = np.zeros((k, k)), np.zeros(k)
        self.skip = np.ones((k, k))
        self._partial = lexicon.without(WITHHELD)

    def _potentials(self, features: Features) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        scores = features.scores(self.weights)
        potential = np.exp(np.clip(scores - scores.max(axis=1)[:, None], -60, 0)) if len(scores) else scores
        return potential, np.exp(self.transition), np.exp(self.start)

    def fit(self, texts: list[str]) -> None:
        """Gradient ascent on the likelihood of what the labels allow; the skip potentials are then fitted to linked pairs."""
        parts: list[Features] = []
        golds, firsts, linked, n = [], [], [], 0
        for at in range(0, len(texts), FITTED_AT_ONCE):
            docs = [d for t in texts[at : at + FITTED_AT_ONCE] if (d := Tokens(t[:SAMPLE_CHARS])) and len(d)]
            if docs:
                features, gold, starts, links = self._sample_part(docs)
                parts.append(features)
                golds.append(gold)
                firsts.append(starts + n)
                linked.append(links + n)
                n += features.n
        if not parts:
            return
        features = Features.joined(parts)
        gold, starts, links = np.concatenate(golds), np.concatenate(firsts), np.concatenate(linked)
        del parts, docs
        segments = Segments(starts, features.n)
        k = len(LABELS)
        allowed = np.eye(k)[np.maximum(gold, 0)]
        allowed[gold == UNKNOWN] = 1.0
        squares = [np.zeros_like(x) for x in (self.weights, self.transition, self.start)]
        means = [np.zeros_like(x) for x in squares]
        for epoch in range(1, EPOCHS + 1):
            potential, transition, start = self._potentials(features)
            # What the labels allow against all there is: tokens without a label take what their chain makes of them.
            np.maximum(potential, 1e-26, out=potential)
            by_token, pairs, first = 0.0, 0.0, 0.0
            for sign, x in ((1, potential * allowed), (-1, potential)):
                forward, backward, marginal, _ = segments.pass_over(x, transition, start)
                by_token += sign * marginal
                pairs += sign * segments.pair_expectation(x, transition, forward, backward)
                first += sign * marginal[starts].sum(axis=0)
            del forward, backward, marginal, potential
            steps = (features.gradient(by_token) - SHRINK * self.weights, pairs, first)
            for x, g, m, v in zip((self.weights, self.transition, self.start), steps, means, squares):
                m += 0.1 * (g - m)
                v += 0.02 * (g * g - v)
                x += RATE * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.98**epoch)) + 1e-3)
        links = links[(gold[links] != UNKNOWN).all(axis=1)]
        if len(links):
            # How much oftener two linked words have two kinds than the chains, each for itself, expect.
            potential, transition, start = self._potentials(features)
            found = segments.pass_over(np.maximum(potential, 1e-26), transition, start)[2]
            kinds = sorted({KIND.get(y, "") for y in range(k)})
            of = np.eye(len(kinds))[[kinds.index(KIND.get(y, "")) for y in range(k)]]
            pairs = lambda m: (both := of.T @ (m[links[:, 0]].T @ m[links[:, 1]]) @ of) + both.T
            self.skip = of @ ((pairs(np.eye(k)[np.maximum(gold, 0)]) + 1.0) / (pairs(found) + 1.0)) @ of.T

    def _sample_part(self, docs: list[Tokens]) -> tuple[Features, np.ndarray, np.ndarray, np.ndarray]:
        """Features, labels, chain starts and links of the chains of some texts that are fitted."""
        # The labels know every surname, the features not all: the field learns what stands around names it doesn't know.
        features = Features(docs, self._partial)
        known = lru_cache(None)(lambda w, k: word_class(w, k, self.lexicon))
        gold = np.concatenate([weak_labels(d, [known(w, k) for w, k in zip(d.text, d.kind)], self.lexicon) for d in docs])
        links, starts = skip_links(docs, features.classes), chain_starts(docs)
        chain = np.cumsum(np.bincount(starts, minlength=features.n)) - 1
        holds = np.bincount(chain, weights=gold != OTHER) > 0
        holds[::PLAIN_EVERY] = True
        chosen = holds[chain]
        place = np.cumsum(chosen) - 1
        return features.subset(chosen), gold[chosen], place[starts[holds]], place[links[chosen[links].all(axis=1)]]

    def label(self, docs: list[Tokens]) -> list[np.ndarray]:
        features = Features(docs, self.lexicon)
        if not features.n:
            return [np.zeros(0, np.int64) for _ in docs]
        potential, transition, start = self._potentials(features)
        marginal = loopy_marginals(Segments(chain_starts(docs), features.n), np.maximum(potential, 1e-26), transition, start, skip_links(docs, features.classes), self.skip, ROUNDS)
        best = marginal.argmax(axis=1)
        return [best[s : s + len(d)] for s, d in zip(features.doc_starts, docs)]


def learn_lexicon(documents: DataFrame) -> Lexicon:
    """The lexicon of all texts in full length, equal ones counted once; only words seen often enough reach the driver."""
    keyed = spread(documents.where("doc_id is not null and length(text) > 0").select(F.xxhash64("text").alias("_a"), F.hash("text").alias("_b"), F.length("text").alias("_n"), "text"))
    texts = drop_repeats(keyed, ["_a", "_b", "_n"]).select("text")
    scale = max(1.0, keyed.select("_a", "_b", "_n").distinct().count() / LOOKALIKE_OF)
    lexicon = Lexicon()

    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = Counter(h for pdf in batches for t in pdf["text"] for h in Lexicon.heads(t))
        yield pd.DataFrame(list(counts.items()), columns=["part", "n"])

    parts = texts.mapInPandas(heads, "part string, n long").groupBy("part").agg(F.sum("n").alias("n"))
    lexicon.learn([tuple(r) for r in parts.where(F.col("n") > scale).collect()], scale)
    known = documents.sparkSession.sparkContext.broadcast(lexicon)

    def uses(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, named, called = Counter(), Counter(), Counter()
        for pdf in batches:
            for t in pdf["text"]:
                for w, (n, c) in known.value.uses(t).items():
                    seen[w] += 1
                    named[w] += n
                    called[w] += c
            if len(seen) > 200_000:
                yield pd.DataFrame([(w, n, named[w], called[w]) for w, n in seen.items()], columns=["word", "n", "named", "called"])
                seen, named, called = Counter(), Counter(), Counter()
        yield pd.DataFrame([(w, n, named[w], called[w]) for w, n in seen.items()], columns=["word", "n", "named", "called"])

    words = texts.mapInPandas(uses, "word string, n long, named long, called long").groupBy("word").agg(*(F.sum(c).alias(c) for c in ("n", "named", "called")))
    often = (F.col("called") >= Lexicon.seen_from(scale)) & (F.col("named") >= NAMED_SHARE * F.col("n")) | (F.col("n") >= LOOKALIKE * scale)
    lexicon.learn_words([tuple(r) for r in words.where(often).collect()], scale)
    return lexicon


def fit_model(documents: DataFrame, sample: int = SAMPLE) -> Model:
    """A model fitted on at most ``sample`` documents, those of least hashed id, with the lexicon of all documents."""
    rows = documents.where("length(text) > 0").select(F.xxhash64("doc_id").alias("h"), F.substring("text", 1, SAMPLE_CHARS).alias("text")).orderBy("h", "text").limit(sample).collect()
    texts = [r["text"] for r in rows]
    model = Model(learn_lexicon(documents))
    model.fit(texts)
    model.weights = model.weights.astype(np.float32)
    return model


def kind_of_first(d: Tokens, labels: np.ndarray, k: int) -> bool:
    """Whether a name goes on at ``k`` although a new one was begun there: the word before is an initial or its point."""
    if not 0 < k < len(d) or labels[k] != NAME_B or labels[k - 1] not in (NAME_B, NAME):
        return False
    last, before = d.text[k - 1], d.text[k - 2] if k > 1 else ""
    return len(last) == 1 and last.isupper() or last == "." and len(before) == 1


def _name_start(d: Tokens, low: list[str], j: int) -> int:
    """The first token of a name labelled from ``j``: not a bare point, and no French M."""
    if d.text[j] == "." and j and len(d.text[j - 1]) == 1 and d.text[j - 1].isupper():
        j -= 1
    while j + 1 < len(d) and (d.kind[j] == "mark" or _monsieur(d, low, j)):
        j += 1
    return j


def spans_of(d: Tokens, labels: np.ndarray) -> list[tuple[str, int, int]]:
    """(kind, first character, end) of the labelled items; an item whose form can't be of its kind is dropped."""
    spans: list[tuple[str, int, int]] = []
    j, n, done = 0, len(d), 0
    if not labels.any():
        return spans
    low = [fold(w) if k == "word" else "" for w, k in zip(d.text, d.kind)]
    while j < n:
        y = int(labels[j])
        if y == OTHER:
            j += 1
            continue
        k = j + 1
        inside = {NAME_B: NAME, NAME: NAME, ADDRESS_B: ADDRESS, ADDRESS: ADDRESS}.get(y)
        if inside is not None:
            while k < n and labels[k] == inside:
                k += 1
        if kind_of_first(d, labels, k):
            while k < n and labels[k] in (NAME_B, NAME):
                k += 1
        kind, token = KIND[y], d.kind[j]
        digits = sum(c.isdigit() for c in d.text[j])
        first = j
        if kind == "address":
            while k + 1 < n and labels[k] == OTHER and labels[k + 1] == ADDRESS and not d.line[k] and not d.line[k + 1]:
                k += 2  # what stands inside an address belongs to it
                while k < n and labels[k] == ADDRESS:
                    k += 1
            if not any(d.kind[x] in ("number", "code") for x in range(j, k)):  # nor is one without the number beside it
                if k < n and d.kind[k] == "number" and not d.line[k]:
                    k += 1
                elif j > done and d.kind[j - 1] == "number" and not d.line[j]:
                    first = j - 1
        if kind == "name":
            first = _name_start(d, low, j)
            valid = any(d.kind[x] == "word" and d.text[x][:1].isupper() and len(d.text[x]) > 2 for x in range(first, k))
        elif kind == "email":
            valid = token == "email"
        elif kind == "address":
            valid = any(d.kind[x] in ("number", "code") for x in range(first, k)) and any(d.kind[x] == "word" for x in range(first, k))
        else:
            valid = token in ("number", "code") and 6 <= digits <= 16
        first = max(first, done)
        if valid:
            end = k - 1
            while end > j and d.kind[end] == "mark" and d.text[end] in ",;:":
                end -= 1
            if first <= end:
                spans.append((kind, d.at[first], d.end[end]))
                done = end + 1
        j = k
    return spans


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with each span replaced by its kind's placeholder."""
    out, last = [], 0
    for kind, at, end in spans:
        out += [text[last:at], PLACEHOLDER[kind]]
        last = end
    return "".join([*out, text[last:]])


#: Characters labelled at once by a task; it bounds memory, not the result.
BATCH_CHARS = 400_000


def _labelled(batches: Iterator[pd.DataFrame], model: Model) -> Iterator[list[tuple[int, str | None, list]]]:
    held, size = [], 0

    def flush() -> list[tuple[int, str | None, list]]:
        docs = [Tokens(t) if isinstance(t, str) else None for _, t in held]
        some = [d for d in docs if d is not None and len(d)]
        labels = iter(model.label(some) if some else [])
        return [(i, t, spans_of(d, next(labels)) if d is not None and len(d) else []) for (i, t), d in zip(held, docs)]

    for pdf in batches:
        for i, t in zip(pdf["doc_id"], pdf["text"]):
            held.append((i, t))
            size += len(t) if isinstance(t, str) else 0
            if size >= BATCH_CHARS:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def find_personal(documents: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, pii_kind, start_pos) of every item, start_pos in code points of the text from 0.

    A document's words form chains; equal or alike capitalised words far apart in it are linked, and belief propagation makes
    their labels agree. The model is fitted on a bounded sample labelled by rules, and applied to every whole text. Null,
    empty and blank texts have no items; rows without doc_id are left out; repeats of a document count once.
    """
    model = documents.sparkSession.sparkContext.broadcast(fit_model(documents, sample))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for done in _labelled(batches, model.value):
            rows = [(i, kind, at) for i, _, spans in done for kind, at, _ in spans]
            if rows:
                yield pd.DataFrame(rows, columns=["doc_id", "pii_kind", "start_pos"])

    return _once(documents).mapInPandas(find, "doc_id long, pii_kind string, start_pos long")


def redact_personal(documents: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text, n_items): every text with its items replaced by [NAME], [EMAIL], [PHONE], [ID_NUMBER], [ADDRESS].

    Null texts stay null and empty ones empty, with n_items 0.
    """
    model = documents.sparkSession.sparkContext.broadcast(fit_model(documents, sample))

    def replace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for done in _labelled(batches, model.value):
            rows = [(i, redact(t, spans) if isinstance(t, str) else None, len(spans)) for i, t, spans in done]
            yield pd.DataFrame(rows, columns=["doc_id", "text", "n_items"]).astype({"text": object})

    return _once(documents).mapInPandas(replace, "doc_id long, text string, n_items int")


def _once(documents: DataFrame) -> DataFrame:
    return drop_repeats(spread(documents.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null")), ["doc_id"])
