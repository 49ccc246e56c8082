"""Mixed timestamp formats and zones: every date entry as one unambiguous moment, or the reason why it is none."""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime, timedelta
from functools import lru_cache
from zoneinfo import ZoneInfo

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumflow.plans.tables import join_small

# Month names of the languages that occur, English and German and French.
MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "sept": 9, "oct": 10, "nov": 11, "dec": 12,
    "januar": 1, "jänner": 1, "februar": 2, "märz": 3, "mai": 5, "juni": 6, "juli": 7, "oktober": 10, "dezember": 12,
    "janvier": 1, "février": 2, "mars": 3, "avril": 4, "juin": 6, "juillet": 7, "août": 8, "septembre": 9, "octobre": 10, "novembre": 11, "décembre": 12,
}
# Minutes east of Greenwich of zone abbreviations, taken literally.
ZONES = {
    "Z": 0, "UT": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180, "IST": 330,
    "JST": 540, "KST": 540, "AWST": 480, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
    "NST": -210, "NDT": -150, "AST": -240, "ADT": -180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
    "AKST": -540, "AKDT": -480, "HST": -600,
}
#: Military zone letters: A-I, K-M east, N-Y west, Z Greenwich; J is the local clock.
LETTERS = {c: 60 * (i + 1) for i, c in enumerate("ABCDEFGHIKLM")} | {c: -60 * (i + 1) for i, c in enumerate("NOPQRSTUVWXY")} | {"Z": 0}

#: What else an abbreviation stands for in other countries, minutes east of Greenwich: fixed values as well.
OTHER_ZONES = {"CST": (480,), "IST": (120, 60), "BST": (360,), "AST": (180,), "EST": (600,), "MST": (480,), "PST": (480,)}

#: A reading is taken if its posterior reaches this; otherwise the entry stays marked ambiguous.
DECIDED = 0.95
#: Pseudo-counts of either order for a source that declares none.
PRIOR = 1.0
#: Share a convention leaves to its alternative: two-digit years are 20xx, abbreviations mean what ZONES says, of a repeated
#: hour the first is meant.
ODD = 0.005
#: Share a source that declares its order leaves to the other order, and how often a writer slips into an impossible date.
UNDECLARED, SLIP = 1e-6, 1e-3

_ZONE = r"(?:\s*(?P<off>[+-]\d{1,2}(?::?\d{2})?|Z)|\s+(?P<gmt>UTC|GMT|UT)\s?(?P<goff>[+-]\d{1,2}(?::?\d{2})?)?|\s+(?P<abbr>[A-Z]{2,4}T)|\s+[\[(]?(?P<iana>[A-Z][A-Za-z]+(?:/[A-Za-z_+-]+)+)[\])]?)?"
_TIME = r"(?P<h>\d{1,2}):(?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<f>\d+))?)?"
_AMPM = r"(?:\s?(?P<ap>[AaPp]\.?[Mm]\.?))?"
_DAY = r"(?P<d>\d{1,2})"
_MON = r"(?P<mon>[^\W\d_]{3,9})\.?"
_YEAR = r"(?P<y>\d{4})"
_WEEKDAY = r"(?:[A-Za-z]{2,9}\.?,?\s)?"
#: Forms in the order they are tried; the first that matches a whole entry is the only one that can.
FORMS: list[tuple[str, re.Pattern[str]]] = [
    (name, re.compile(pattern))
    for name, pattern in (
        ("iso", rf"{_YEAR}-(?P<m>\d{{1,2}})-{_DAY}[Tt ,]\s?{_TIME}{_AMPM}{_ZONE}"),
        ("slashed", rf"(?P<a>\d{{1,2}})/(?P<b>\d{{1,2}})/(?P<y>\d{{4}}|\d{{2}}),?\s{_TIME}{_AMPM}{_ZONE}"),
        ("dotted", rf"{_DAY}\.\s?(?P<m>\d{{1,2}})\.\s?(?P<y>\d{{4}}|\d{{2}}),?\s{_TIME}{_AMPM}(?:\sUhr)?{_ZONE}"),
        ("epoch", r"(?P<n>\d{9,10}|\d{13}|\d{16}|\d{19})(?:\.(?P<nf>\d+))?"),
        ("compact", rf"(?P<y>\d{{4}})(?P<m>\d\d)(?P<d>\d\d)T(?P<h>\d\d)(?P<mi>\d\d)(?P<s>\d\d)?(?:[.,](?P<f>\d+))?{_ZONE}"),
        ("day_of_year", rf"{_YEAR}-(?P<doy>\d{{3}})[T ]{_TIME}{_ZONE}"),
        ("dtg", r"(?P<d>\d\d)(?P<h>\d\d)(?P<mi>\d\d)(?P<letter>[A-Z])\s?(?P<mon>[A-Za-z]{3})\s?(?P<y>\d{4}|\d{2})"),
        ("ctime", rf"(?:[A-Za-z]{{3}}\s)?{_MON}\s{_DAY}\s{_TIME}(?:\s(?P<mid>[A-Z]{{3,4}}))?\s{_YEAR}{_ZONE}"),
        ("day_month", rf"{_WEEKDAY}{_DAY}\.?\s{_MON}\s{_YEAR},?(?:\s(?:at|um|à|T))?\s{_TIME}{_AMPM}(?:\s(?:Uhr|hrs|h))?{_ZONE}"),
        ("hrs", rf"{_WEEKDAY}{_DAY}\.?\s{_MON}\s{_YEAR},?(?:\sat)?\s(?P<h>\d\d)(?P<mi>\d\d)\s?(?:hrs|hours|h)\.?{_ZONE}"),
        ("french", rf"{_WEEKDAY}(?P<d>\d{{1,2}})(?:er)?\s{_MON}\s{_YEAR},?(?:\sà)?\s(?P<h>\d{{1,2}})\s?h\s?(?P<mi>\d{{2}}){_ZONE}"),
        ("month_day", rf"{_WEEKDAY}{_MON}\s(?P<d>\d{{1,2}})(?:st|nd|rd|th)?,?\s{_YEAR},?(?:\sat)?\s{_TIME}{_AMPM}{_ZONE}"),
        ("named_time", rf"{_WEEKDAY}(?:{_MON}\s{_DAY}(?:st|nd|rd|th)?|(?P<d2>\d{{1,2}})\.?\s(?P<mon2>[^\W\d_]{{3,9}})\.?),?\s{_YEAR},?(?:\sat)?\s(?P<word>noon|midnight){_ZONE}"),
    )
]

_EPOCH = datetime(1970, 1, 1)
_SPACE = re.compile(r"\s+")


_FRACTION = re.compile(r"([.,]\d{19})\d+")
_NINES = str.maketrans("012345678", "999999999")


_DATED = re.compile(r"9:9|9\s?h|noon|midnight|99T99|^9{6}")


@lru_cache(50_000)
def _form(shape: str) -> int | None:
    """The form of all entries that differ in digits only; forms name no particular digit, so one entry stands for all."""
    return next((i for i, (_, pattern) in enumerate(FORMS) if pattern.fullmatch(shape)), None)


@lru_cache(256)
def _zone(name: str | None) -> ZoneInfo | None:
    try:
        return ZoneInfo(name) if name else None
    except Exception:  # an unknown zone is a missing one
        return None


def _offset(text: str) -> int | None:
    if text == "Z":
        return 0
    digits = text[1:].replace(":", "")
    hours, minutes = (int(digits), 0) if len(digits) <= 2 else (int(digits[:-2]), int(digits[-2:]))
    return None if minutes > 59 or hours > 18 else (-1 if text[0] == "-" else 1) * (60 * hours + minutes)


#: One way to read an entry: what it takes for granted, the status it leads to, and the UTC instant if that is 'resolved'.
Reading = tuple[tuple[str, ...], str, str | None]


def _local(when: datetime, zone: ZoneInfo) -> list[tuple[str, str, datetime | None]]:
    """(which of a repeated hour, status, UTC) of a wall-clock time; no UTC where the clock jumped over it."""
    early, late = when.replace(tzinfo=zone, fold=0).utcoffset(), when.replace(tzinfo=zone, fold=1).utcoffset()
    if early < late:
        return [("", "nonexistent", None)]
    return [("", "resolved", when - early)] if early == late else [("hour:first", "resolved", when - early), ("hour:second", "resolved", when - late)]


def _instants(when: datetime, g: dict, tz_name: str | None) -> list[tuple[str, str, datetime | None]]:
    """(zone taken for granted, status, UTC) of a date and time under everything its zone can mean."""
    if g.get("off") or g.get("gmt"):
        minutes = _offset(g["off"] or g["goff"] or "Z") if g.get("off") or g.get("goff") else 0
        return [("", "impossible", None) if minutes is None else ("", "resolved", when - timedelta(minutes=minutes))]
    if short := g.get("abbr") or g.get("mid"):
        known = [ZONES[short], *OTHER_ZONES.get(short, ())] if short in ZONES else []
        return [(f"zone:{short}{m:+d}" if len(known) > 1 else "", "resolved", when - timedelta(minutes=m)) for m in known] or [("", "impossible", None)]
    if g.get("letter") and g["letter"] != "J":
        return [("", "resolved", when - timedelta(minutes=LETTERS[g["letter"]]))]
    zone = _zone(g.get("iana") or tz_name)
    if zone is None:
        return [("", "impossible" if g.get("iana") else "no_zone", None)]
    return _local(when, zone)


def _clock(g: dict) -> tuple[int, int, int, int] | None:
    if g.get("word"):
        return (12 if g["word"] == "noon" else 0), 0, 0, 0
    hour, minute, second = int(g["h"]), int(g["mi"]), int(g.get("s") or 0)
    if g.get("ap"):
        if not 1 <= hour <= 12:
            return None
        hour = hour % 12 + (12 if g["ap"][0] in "Pp" else 0)
    return hour, minute, second, int(((g.get("f") or "") + "000000")[:6])


def _days(g: dict, name: str) -> list[tuple[tuple[str, ...], int, int, int]] | None:
    """(order taken for granted, month, day, day of the year) of every way to read the day; none where the month is no word for one."""
    if g.get("doy"):
        return [((), 1, 1, int(g["doy"]))]
    if name == "slashed":
        a, b = int(g["a"]), int(g["b"])
        return [((), a, b, 0)] if a == b else [(("order:mdy",), a, b, 0), (("order:dmy",), b, a, 0)]
    day, word = int(g.get("d") or g.get("d2")), g.get("mon") or g.get("mon2")
    if not word:
        return [((), int(g["m"]), day, 0)]
    return [((), month, day, 0)] if (month := MONTHS.get(word.lower())) else None


def readings(entry: str | None, tz_name: str | None) -> tuple[str | None, list[Reading]]:
    """(format, every way to read an entry); no readings where it fixes no time of day.

    What a reading takes for granted: order:mdy or order:dmy of a slashed date, century:20 or century:19 of a two-digit year,
    zone:... of an abbreviation several countries use, hour:first or hour:second of a repeated hour.
    """
    text = _FRACTION.sub(r"\1", _SPACE.sub(" ", entry).strip()) if entry is not None else ""
    shape = text.translate(_NINES)
    form = _form(shape) if len(text) >= 9 and _DATED.search(shape) else None
    if form is None:
        return None, []
    name, pattern = FORMS[form]
    g = pattern.fullmatch(text).groupdict()
    if name == "epoch":
        digits = g["n"]
        micros = int(digits) * 10 ** (6 - max(0, len(digits) - 10)) if len(digits) <= 16 else int(digits) // 1000
        if g["nf"] and len(digits) <= 10:
            micros += int((g["nf"] + "000000")[:6])
        return name, [((), "resolved", _shown(_EPOCH + timedelta(microseconds=micros)))]
    clock, days = _clock(g), _days(g, name)
    if days is None:
        return None, []
    years = [((), int(g["y"]))] if len(g["y"]) == 4 else [(("century:20",), 2000 + int(g["y"])), (("century:19",), 1900 + int(g["y"]))]
    found: list[Reading] = []
    for order, month, day, nth in days:
        for century, year in years:
            taken = (*order, *century)
            try:
                when = datetime(year, month, day, *clock) if clock else None
                if when and nth:
                    when += timedelta(days=nth - 1)
                if when is None or when.year != year:
                    raise ValueError
                found += [((*taken, more) if more else taken, status, _shown(utc)) for more, status, utc in _instants(when, g, tz_name)]
            except (ValueError, OverflowError):
                found.append((taken, "impossible", None))
    return name, found


def _shown(utc: datetime | None) -> str | None:
    return utc and utc.isoformat(timespec="microseconds") + "Z"


def prior(key: str, order: str | None) -> tuple[float, bool]:
    """(share of what a reading takes for granted before any value is seen, whether that is settled)."""
    kind, _, value = key.partition(":")
    if kind == "order":
        return (0.5, False) if order not in ("MDY", "DMY") else (1 - UNDECLARED if value == order.lower() else UNDECLARED, True)
    usual = value in ("20", "first") if kind != "zone" else value[:-4] in ZONES and value == f"{value[:-4]}{ZONES[value[:-4]]:+d}"
    return (1 - ODD if usual else ODD), True


def _shares(found: list[Reading], share) -> list[float]:
    """Posterior of each reading: the product of the shares of what it takes for granted, times the likelihood of its date."""
    weights = [float(np.prod([share(k) for k in taken])) * (SLIP if status == "impossible" else 1.0) for taken, status, _ in found]
    total = sum(weights)
    return [w / total for w in weights]


def resolve_entry(entry: str | None, tz_name: str | None, order: str | None) -> tuple[str, str | None, str | None]:
    """(status, format, UTC instant) of one entry of a source that declares ``order``, or none and has no other values.

    Statuses: resolved; no_moment (a date alone, an undated note, a null or blank entry); impossible (no such date, time
    or offset); nonexistent (skipped by the clock); no_zone (nothing says whose clock); ambiguous (no reading reaches DECIDED).
    """
    name, found = readings(entry, tz_name)
    if not found:
        return "no_moment", None, None
    p, (_, status, instant) = max(zip(_shares(found, lambda k: prior(k, order)[0]), found), key=lambda x: x[0])
    return (status, name, instant) if p >= DECIDED else ("ambiguous", name, None)


READ = T.StructType([T.StructField(n, T.StringType()) for n in ("status", "date_format", "instant_utc", "readings")])


@F.pandas_udf(READ)
def read_entries(entry: pd.Series, tz_name: pd.Series) -> pd.DataFrame:
    """The reading of each entry, or all of them as one text where there are several: what one takes for granted, its status
    and its instant between bars, readings apart by semicolons."""
    rows = []
    for e, z in zip(entry, tz_name):
        name, found = readings(e if isinstance(e, str) else None, z if isinstance(z, str) else None)
        if len(found) < 2:
            rows.append((found[0][1] if found else "no_moment", name, found[0][2] if found else None, None))
        else:
            rows.append((None, name, None, ";".join(f"{' '.join(taken)}|{status}|{instant or ''}" for taken, status, instant in found)))
    return pd.DataFrame(rows, columns=READ.fieldNames(), dtype=object)


def format_mixture(sources: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Expectation-maximisation of each source's mixture of readings, from the numbers of its values of each pattern.

    A value's pattern is what its readings take for granted and which of them give a possible date. The E-step divides a value
    among its readings by the mixture and the likelihood of their dates (SLIP for an impossible one); the M-step makes the
    divided counts the mixture. What a source declares and what is a convention of the whole project stays as it is.
    """
    for pdf in sources:
        out = []
        for order, patterns in zip(pdf["date_order"], pdf["patterns"]):
            values = [([(tuple(x.split("|")[0].split(" ")), x.split("|")[1], None) for x in p["pattern"].split(";")], float(p["n"])) for p in (patterns if patterns is not None else ())]
            keys = sorted({k for found, _ in values for taken, _, _ in found for k in taken if k} | {"order:mdy", "order:dmy"})
            shares = {k: prior(k, order)[0] for k in keys}
            free = [k for k in keys if not prior(k, order)[1]]
            for _ in range(200 if free else 0):
                sums = dict.fromkeys(free, PRIOR)
                for found, n in values:
                    for (taken, _, _), p in zip(found, _shares(found, lambda k: shares.get(k, 1.0))):
                        for k in taken:
                            if k in sums:
                                sums[k] += n * p
                total = sum(sums.values())
                moved = max(abs(shares[k] - v / total) for k, v in sums.items())
                shares |= {k: v / total for k, v in sums.items()}
                if moved < 1e-9:
                    break
            out.append(shares)
        yield pd.DataFrame({"site_code": pdf["site_code"], "tz_name": pdf["tz_name"], "shares": out})


def source_formats(entries: DataFrame, sites: DataFrame) -> DataFrame:
    """(site_code, tz_name, shares map) of every source named in ``entries`` (site_code, entry) or ``sites``.

    Only slashed dates have an order to learn, so only they are read here. A source has no more patterns than there are
    combinations of orders, centuries and abbreviations.
    """
    known = sites.where("site_code is not null").groupBy("site_code").agg(F.max("tz_name").alias("tz_name"), F.max("date_order").alias("date_order"))
    slashed = entries.where(F.col("entry").rlike(r"^\s*\d{1,2}/\d{1,2}/\d") & F.col("site_code").isNotNull())
    read = slashed.select("site_code", read_entries("entry", F.lit("UTC"))["readings"].alias("r")).where("r is not null")
    pattern = F.concat_ws(";", F.transform(F.split("r", ";"), lambda x: F.substring_index(x, "|", 2)))
    counted = read.groupBy("site_code", pattern.alias("pattern")).agg(F.count(F.lit(1)).alias("n"))
    patterns = counted.groupBy("site_code").agg(F.collect_list(F.struct("pattern", "n")).alias("patterns"))
    return known.join(patterns, "site_code", "full").mapInPandas(format_mixture, "site_code string, tz_name string, shares map<string, double>")


def settle(read: Column, shares: Column) -> Column:
    """struct<status, date_format, instant_utc, posterior, alternatives> of a struct of :func:`read_entries`.

    The most probable reading is taken if its posterior reaches DECIDED. ``alternatives``: the readings not taken that give an
    instant, most probable first; what is taken for granted is spelt out, so that ambiguity shows even where it is settled.
    """

    def weigh(x: Column) -> Column:
        part = F.split(x, r"\|")
        usual = lambda k: F.coalesce(F.try_element_at(shares, k), F.when(k.startswith("order:"), F.lit(0.5)).when(k.isin(*USUAL), F.lit(1 - ODD)).otherwise(F.lit(ODD)))
        product = F.aggregate(F.split(part[0], " "), F.lit(1.0), lambda acc, k: acc * usual(k))
        return F.struct((product * F.when(part[1] == "impossible", F.lit(SLIP)).otherwise(F.lit(1.0))).alias("weight"), part[0].alias("taken"), part[1].alias("status"), F.nullif(part[2], F.lit("")).alias("instant"))

    weighed = F.sort_array(F.transform(F.split(read["readings"], ";"), weigh), False)
    total = F.aggregate(weighed, F.lit(0.0), lambda acc, x: acc + x["weight"])
    best = weighed[0]
    # Without a source there is no mixture to tell the orders by.
    sure = (best["weight"] >= DECIDED * total) & (shares.isNotNull() | ~read["readings"].contains("order:"))
    others = F.transform(F.filter(F.slice(weighed, F.when(sure, 2).otherwise(1), F.size(weighed)), lambda x: x["instant"].isNotNull()), lambda x: F.concat_ws(" ", x["instant"], x["taken"]))
    single = read["readings"].isNull()
    return F.struct(
        F.when(single, read["status"]).when(sure, best["status"]).otherwise("ambiguous").alias("status"), read["date_format"].alias("date_format"),
        F.when(single, read["instant_utc"]).when(sure, best["instant"]).alias("instant_utc"),
        F.when(~single, best["weight"] / total).when(read["status"] == "resolved", F.lit(1.0)).alias("posterior"),
        F.when(single, F.array().cast("array<string>")).otherwise(others).alias("alternatives"),
    )


#: What is taken for granted by convention.
USUAL = ["century:20", "hour:first", *(f"zone:{k}{ZONES[k]:+d}" for k in OTHER_ZONES)]


def date_entries(evidence: DataFrame, analyses: DataFrame) -> DataFrame:
    """(record_kind, record_id, pos, entry, site_code) of each list entry; evidence takes its analysis's site.

    Rows without key are left out, repeats of a record count once, null lists give nothing, null entries are kept.
    """
    own = analyses.select("analysis_id", "site_code", "dates").where("analysis_id is not null").dropDuplicates(["analysis_id"])
    theirs = evidence.select("evidence_id", "analysis_id", "dates").where("evidence_id is not null and size(dates) > 0").dropDuplicates(["evidence_id"])
    listed = theirs.join(own.select("analysis_id", "site_code"), "analysis_id", "left").select(F.lit("evidence").alias("record_kind"), F.col("evidence_id").alias("record_id"), "dates", "site_code")
    both = listed.unionByName(own.select(F.lit("analysis").alias("record_kind"), F.col("analysis_id").alias("record_id"), "dates", "site_code"))
    return both.select("record_kind", F.col("record_id").cast("long"), "site_code", F.posexplode("dates").alias("pos", "entry")).withColumn("pos", F.col("pos").cast("long"))


def normalise_moments(evidence: DataFrame, analyses: DataFrame, sites: DataFrame) -> DataFrame:
    """Every date entry with its status, format and UTC instant (null unless resolved), the posterior of the reading taken
    and the instants it could also mean.

    Columns: record_kind, record_id, pos, entry, site_code, status, date_format, instant_utc, posterior, alternatives.
    """
    entries = date_entries(evidence, analyses)
    sources = source_formats(
        evidence.select("analysis_id", F.explode("dates").alias("entry")).where(F.col("entry").contains("/")).join(analyses.select("analysis_id", "site_code").dropDuplicates(["analysis_id"]), "analysis_id").select("site_code", "entry").unionByName(analyses.select("site_code", F.explode("dates").alias("entry"))),
        sites,
    )
    joined = join_small(entries, sources, ["site_code"])
    settled = joined.withColumn("_read", read_entries("entry", "tz_name")).withColumn("_r", settle(F.col("_read"), F.col("shares")))
    return settled.select("record_kind", "record_id", "pos", "entry", "site_code", "_r.*")


def resolved_moments(evidence: DataFrame, analyses: DataFrame, sites: DataFrame) -> DataFrame:
    """(record_kind, record_id, pos, instant_utc) of the entries that fix a moment."""
    return normalise_moments(evidence, analyses, sites).where("status = 'resolved'").select("record_kind", "record_id", "pos", "instant_utc")
