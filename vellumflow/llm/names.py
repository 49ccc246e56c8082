"""Names as people write them, taken apart: parts, style and what was added."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

# Strings that stand in name columns and name nobody.
NOBODY = {"", "unknown", "?", "illegible", "n/a", "na", "none", "no named person", "the author", "author", "unnamed", "anonymous", "not stated", "various", "unidentified", "name illegible"}
# Titles, without points.
TITLES = {"mr", "mrs", "ms", "miss", "mx", "dr", "dra", "prof", "capt", "col", "maj", "adm", "gen", "lt", "sgt", "cpl", "cdr", "rev", "sir", "dame", "lady", "lord", "hon", "judge", "herr", "frau", "hr", "fr", "m", "mme", "mlle", "sr", "sra", "srta", "sig", "mister", "doctor", "professor", "captain", "colonel", "major", "admiral", "general", "lieutenant", "commander"}
# Generational suffixes, without points.
SUFFIXES = {"jr": "jr", "sr": "sr", "ii": "ii", "iii": "iii", "iv": "iv", "v": "v", "junior": "jr", "senior": "sr"}
# Surname particles.
PARTICLES = {"van", "von", "de", "der", "den", "di", "da", "del", "della", "du", "la", "le", "ten", "ter", "zu", "dos", "das", "af", "av"}
# Heads of organisation names and their abbreviations.
HEADS = {
    "institute": "institute", "inst": "institute", "department": "department", "dept": "department", "dep": "department", "board": "board", "bd": "board", "bureau": "bureau", "bur": "bureau",
    "commission": "commission", "comm": "commission", "committee": "committee", "cttee": "committee", "ctte": "committee", "directorate": "directorate", "dir": "directorate",
    "laboratory": "laboratory", "lab": "laboratory", "office": "office", "off": "office", "society": "society", "soc": "society", "keeper": "keeper", "registry": "registry", "house": "house",
    "ministry": "ministry", "min": "ministry", "agency": "agency", "association": "association", "assoc": "association", "council": "council", "university": "university", "univ": "university",
    "company": "company", "co": "company", "corporation": "corporation", "corp": "corporation", "foundation": "foundation", "centre": "centre", "center": "centre", "division": "division", "div": "division",
    "service": "service", "authority": "authority", "academy": "academy", "museum": "museum", "archive": "archive", "archives": "archive", "library": "library", "trust": "trust", "union": "union", "group": "group",
}
# Nicknames and the names they stand for.
NICKNAMES = {
    "al": "albert alan alfred", "alex": "alexander", "andy": "andrew", "art": "arthur", "becky": "rebecca", "ben": "benjamin", "beppe": "giuseppe", "bert": "albert herbert robert", "bess": "elizabeth", "beth": "elizabeth",
    "betsy": "elizabeth", "betty": "elizabeth", "bill": "william", "billy": "william", "bob": "robert", "bobby": "robert", "charlie": "charles", "chuck": "charles", "dan": "daniel", "dave": "david", "debbie": "deborah",
    "dick": "richard", "dolly": "dorothy", "don": "donald", "dot": "dorothy", "dottie": "dorothy", "drew": "andrew", "ed": "edward", "eddie": "edward", "ellie": "eleanor", "frank": "francis", "fran": "francis", "fred": "frederick",
    "fritz": "frederick", "gene": "eugene", "gerry": "gerald", "ginny": "virginia", "greg": "gregory", "hank": "henry", "hans": "johannes", "harry": "henry harold", "jack": "john", "jenny": "jennifer", "jerry": "gerald jerome",
    "jim": "james", "jimmy": "james", "joe": "joseph", "joey": "joseph", "john": "jonathan", "johnny": "john jonathan", "jon": "jonathan", "kate": "katherine", "kathy": "katherine", "katie": "katherine", "ken": "kenneth",
    "larry": "lawrence", "len": "leonard", "lenny": "leonard", "leo": "leonard", "liz": "elizabeth", "maggie": "margaret", "matt": "matthew", "meg": "margaret", "mike": "michael", "nat": "nathaniel", "nate": "nathaniel", "ned": "edward",
    "nell": "eleanor", "nick": "nicholas", "pat": "patricia patrick", "patty": "patricia", "peggy": "margaret", "pete": "peter", "phil": "philip", "ray": "raymond", "rich": "richard", "rick": "richard", "rob": "robert",
    "ron": "ronald", "sam": "samuel", "sandy": "alexander", "steve": "stephen", "sue": "susan", "susie": "susan", "ted": "theodore edward", "theo": "theodore", "tim": "timothy", "tom": "thomas", "tommy": "thomas", "tony": "anthony",
    "trish": "patricia", "trudy": "gertrude", "vicky": "victoria", "walt": "walter", "will": "william", "willy": "william",
}

_SPECIAL = str.maketrans({"ø": "o", "đ": "d", "ł": "l", "ß": "ss", "æ": "a", "œ": "o", "ð": "d", "þ": "th", "ı": "i", "1": "l", "0": "o", "’": "'", "‘": "'"})
_LETTERS = re.compile(r"[^\W\d_]+")
_NOTE = re.compile(r"\s*(?:\([^()]*\)|\[[^\[\]]*\]|\*+)\s*")
_QUOTED = re.compile(r"\s*[\"“”]([^\"“”]+)[\"“”]\s*")


@lru_cache(100_000)
def fold(text: str) -> str:
    """Lower case without accents; digits read as the letters they resemble."""
    return "".join(c for c in unicodedata.normalize("NFD", text.lower().translate(_SPECIAL)) if not unicodedata.combining(c))


@lru_cache(100_000)
def loose(folded: str) -> str:
    """A folded word with ae, oe and ue as the umlauts they may stand for, and rn as the m it may have been read from."""
    return folded.replace("ae", "a").replace("oe", "o").replace("ue", "u").replace("rn", "m")


FORMAL = {fold(k): frozenset(fold(x) for x in v.split()) for k, v in NICKNAMES.items()}
GIVEN = frozenset(x for v in FORMAL.values() for x in v)


@dataclass(frozen=True)
class Name:
    """A name string in parts. ``kind``: person, organisation, acronym or nobody; parts are as written, lower case."""

    kind: str
    given: str = ""  # a whole first name, or nothing
    initial: str = ""  # first letter of the first name, folded
    nickname: str = ""  # a known nickname in the place of the first name
    middle: tuple[str, ...] = ()  # whole middle names or single letters
    surname: str = ""
    suffix: str = ""
    words: tuple[str, ...] = ()  # of an organisation, heads spelt out, in order of the name
    style: tuple[str, ...] = ()  # what departs from the ordinary way to write the name


def _case(text: str) -> str | None:
    letters = [c for c in text if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() or not c.islower() for c in letters):
        return "upper"
    return "lower" if letters and not any(c.isupper() for c in letters) else None


@lru_cache(200_000)
def parse(raw: str) -> Name:
    """``raw`` taken apart; see :class:`Name`."""
    style: list[str] = []
    text = unicodedata.normalize("NFC", raw)
    clean = " ".join(text.split())
    if clean != raw.strip() or text != raw:
        style.append("spacing" if " ".join(raw.split()) != raw.strip() or "\xa0" in raw.strip() else "composition")
    if clean.lower().strip(" .") in NOBODY or not any(c.isalpha() for c in clean):
        return Name("nobody")
    bare = _NOTE.sub(" ", clean).strip()
    if bare != clean:
        style.append("note")
    if quoted := _QUOTED.search(bare):
        style.append("quoted")
        bare = _QUOTED.sub(" ", bare).strip()
    if not any(c.isalpha() for c in bare):
        return Name("nobody")
    if (case := _case(bare)) and not re.fullmatch(r"(?:[A-Z]\.?\s?){2,6}", bare):
        style.append(case)
    if re.match(r"(?i)the\s", bare):
        bare = bare[4:].strip()
        style.append("article")
    words = bare.split(" ")
    first, final = (fold(w.strip(".,")) for w in (words[0], words[-1]))
    linked = any(w.lower() in ("of", "for", "and", "&") for w in words[1:])
    if linked or len(words) > 2 and (first in HEADS or final in HEADS) and first not in TITLES:
        return _organisation(words, style)
    if len(words) == 1 and re.fullmatch(r"(?:[A-Z]\.?){2,6}", bare):
        letters = bare.replace(".", "").lower()
        return Name("acronym", words=tuple(letters), style=(*style, "acronym", *(["points"] if "." in bare else [])))
    return _person(bare, quoted.group(1) if quoted else "", style)


def _organisation(words: list[str], style: list[str]) -> Name:
    out, abbreviated = [], False
    for w in words:
        plain = w.strip(".,;:").lower()
        key = fold(plain)
        if plain in ("of", "for", "and", "the", "&"):
            continue
        if key in HEADS and HEADS[key] != key and w.endswith("."):
            abbreviated = True
            plain = HEADS[key]
        out.append(plain)
    if abbreviated:
        style.append("abbreviated")
    if not any(w.lower() in ("of", "for") for w in words) and out and fold(out[-1]) in HEADS:
        out = [out[-1], *out[:-1]]  # Northern Navigation Commission is the Commission of Northern Navigation
        style.append("reordered")
    return Name("organisation", words=tuple(out), style=tuple(style))


def _person(bare: str, quoted: str, style: list[str]) -> Name:
    if dotted := re.sub(r"(?<=[^\W\d_]{2})\.(?=[^\W\d_]['’]?[^\W\d_])", " ", bare):
        if dotted != bare:
            bare = dotted
            style.append("dotted")
    suffix = ""
    found = re.search(r"(?i)[,\s]\s*(jr|sr|ii|iii|iv|junior|senior)\.?$", bare)
    if found and re.search(r"[^\W\d_]{2}", bare[: found.start()]):
        suffix = SUFFIXES[found.group(1).lower()]
        if not bare[found.start() :].startswith(",") or suffix in ("jr", "sr") and not bare.endswith("."):
            style.append("punctuation")
        bare = bare[: found.start()].strip(" ,")
    inverted = False
    if "," in bare:
        left, right = (x.strip() for x in bare.split(",", 1))
        if right and right[0].islower() and "lower" not in style and not any(fold(w) in PARTICLES for w in right.split()):
            bare = left  # a role after the name
            style.append("note")
        elif right:
            inverted = True
            style.append("inverted")
            bare = f"{right} {left}"
            tail = left.split()
            count = len(tail)
        else:
            bare = left
    tokens = bare.split()
    if len(tokens) > 1 and fold(tokens[0].rstrip(".")) in TITLES and (len(tokens[0].rstrip(".")) > 1 or not inverted and len(tokens) == 2):
        style.append("title")
        tokens = tokens[1:]
    if inverted:
        n = min(count, len(tokens))
    else:
        n = 1
        # A small letter before the surname begins a particle, however it is spelt.
        while n < len(tokens) - 1 and ((t := tokens[-n - 1]).lower() in PARTICLES and ("upper" in style or not t.isupper()) or t.islower() and t.isalpha() and len(t) > 1 and "lower" not in style):
            n += 1
        if "title" in style and n == len(tokens) - 1 and tokens[0].lower() in PARTICLES:
            n += 1
    surname, front = " ".join(tokens[len(tokens) - n :]).lower(), tokens[: len(tokens) - n]
    given, initial, nickname, middle = "", "", "", []
    parts: list[str] = []
    shouted = "upper" in style
    for t in front:
        letters = t.replace(".", "")
        if "." in t and len(letters) > 1 and all(len(x) == 1 for x in t.strip(".").split(".")):
            parts += [x.lower() + "." for x in letters]
            style.append("joined")
        elif len(letters) in (2, 3) and letters.isupper() and "." not in t and (not shouted or len(front) == 1 and len(letters) == 2 and fold(letters) not in FORMAL):
            parts += [x.lower() + "." for x in letters]
            style.append("joined")
        elif len(letters) == 1:
            parts.append(letters.lower() + ".")
            if "." not in t:
                style.append("punctuation")
        elif letters:
            parts.append(letters.lower())
    if parts:
        head = parts[0]
        if head.endswith("."):
            initial = fold(head)[0]
            style.append("initial")
        elif fold(head) in FORMAL and fold(head) not in GIVEN:
            nickname = head
            style.append("nickname")
        else:
            given, initial = head, fold(head)[0]
        middle = [p.rstrip(".") for p in parts[1:]]
        if not nickname and quoted and fold(quoted) in FORMAL:
            nickname = quoted.lower()
    elif not style or "title" not in style:
        style.append("surname_only")
    return Name("person", given, initial, nickname, tuple(middle), surname, suffix, (), tuple(dict.fromkeys(style)))


@lru_cache(200_000)
def one_slip(a: str, b: str) -> bool:
    """Equal, or one letter added, dropped, replaced or two neighbours swapped."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return x[1:] == y[1:] or x[1:] == y or x == y[1:] or len(x) > 1 and len(y) > 1 and x[0] == y[1] and x[1] == y[0] and x[2:] == y[2:]


def alike(a: str, b: str) -> bool:
    """Two folded words that differ by a slip of the pen, a transliterated umlaut or a misread m at most."""
    return a == b or (min(len(a), len(b)) >= 4 or len(a) != len(b) and min(len(a), len(b)) == 3) and one_slip(a, b) or loose(a) == loose(b)


def core(surname: str) -> str:
    """The folded surname without particles."""
    parts = surname.split()
    return fold(parts[-1]) if parts else ""


def formal_names(name: Name) -> frozenset[str]:
    """First names the string can stand for, folded; nothing where only an initial or no first name is given."""
    if name.given:
        return frozenset((fold(name.given),))
    return FORMAL.get(fold(name.nickname), frozenset()) if name.nickname else frozenset()
