"""One surviving record for each group of duplicate names, from a latent model of how far each recorder can be trusted."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumflow.llm.names import Name, alike, fold, parse
from vellumflow.plans.tables import cut_lineage, drop_repeats

#: Ways of writing; a string belongs to the first of its styles in this order, or to 'plain'.
HANDS = ("plain", "acronym", "abbreviated", "nickname", "surname_only", "joined", "initial", "upper", "lower", "dotted", "quoted", "note", "inverted", "title", "article", "reordered", "spacing", "composition", "punctuation")
#: Recorders are told apart by a hash of their name: their number is bounded whatever the column holds.
RECORDERS = 64
#: A source is a recorder's string in one way of writing; two more are the evidence rows and the corpus of all names.
EVIDENCE = RECORDERS * len(HANDS)
CORPUS, SOURCES = EVIDENCE + 1, EVIDENCE + 2
#: Beta pseudo-counts: (claimed, not claimed) of a true value, and (not claimed, claimed) of a false one.
SENSITIVITY, SPECIFICITY, TRUE_SHARE = (6.0, 4.0), (18.0, 2.0), (2.0, 2.0)
#: The iteration ends when no parameter moves further than this, or after so many rounds.
SETTLED, ROUNDS = 5e-3, 60
#: A multi-valued field keeps every value with at least this probability of being true.
TRUE_FROM = 0.5
#: What a value judged true is worth to the record that states it; a nickname or initial instead of a first name, and an
#: abbreviated organisation, are worth what they leave open.
WORTH = {"surname": 3, "given": 4, "middle": 1, "suffix": 1, "words": 1}
NICKNAME, INITIAL, ABBREVIATED = 2, 1, 0.5
FIELDS = tuple(WORTH)


def source_of(name: Name, recorder: str | None) -> int:
    hand = next((i for i, s in enumerate(HANDS) if s in name.style), 0)
    return (zlib.crc32(recorder.encode()) % RECORDERS if recorder else 0) * len(HANDS) + hand


def claims_of(name: Name) -> dict[str, set[str]]:
    """Values a string states of each field; fields it leaves out are absent, and nicknames and initials state no first name.

    Surname, middle name and an organisation's words hold several values: both halves of a double surname, every middle
    name, every word. A middle name spelt out also states its initial: both are true of one person.
    """
    said: dict[str, set[str]] = {}
    if name.kind == "organisation" and "abbreviated" not in name.style:
        said["words"] = set(name.words)
    if name.kind == "person":
        if name.surname:
            said["surname"] = {h for h in name.surname.split("-") if h}
        if name.given:
            said["given"] = {name.given}
        if name.middle:
            said["middle"] = {m for x in name.middle for m in (x, fold(x)[:1])}
        if name.suffix:
            said["suffix"] = {name.suffix}
    return said


def _grams(word: str) -> Counter:
    return Counter(zip("\x02" + word, word + "\x03"))


@lru_cache(200_000)
def rivals(field: str, a: str, b: str) -> bool:
    """Whether at most one of two values can be true: first names and suffixes always, others if one is a spelling of the other."""
    if a == b or field in ("given", "suffix"):
        return a != b
    x, y = (fold(v).replace(" ", "") for v in (a, b))
    if min(len(x), len(y)) < 2:
        return False
    return alike(x, y) or 2 * (_grams(x) & _grams(y)).total() >= 0.6 * (len(x) + len(y) + 2)


def facts_of(members: list[tuple[Name, float, str | None]], seen: dict[str, int]) -> dict[tuple[str, str], dict[int, tuple[float, float]]]:
    """(field, value) -> source -> (claims for, claims against) of one group; ``members``: name, evidence rows, recorder.

    Each member speaks for the values it states and against their rivals. The evidence speaks for the spelling most of its
    rows have, the corpus for a spelling no rival of which stands in three times as many names.
    """
    said = [(source_of(n, r), w, claims_of(n)) for n, w, r in members]
    facts: dict[tuple[str, str], dict[int, tuple[float, float]]] = {}
    for field in FIELDS:
        values = sorted({v for _, _, s in said for v in s.get(field, ())})
        rows = {v: sum(w for _, w, s in said if v in s.get(field, ())) for v in values}
        spelt = {v: min((seen.get(t, 0) for t in v.split()), default=0) for v in values}
        for v in values:
            against = [x for x in values if rivals(field, v, x)]
            fact: dict[int, list[float]] = defaultdict(lambda: [0.0, 0.0])
            for source, _, s in said:
                stated = s.get(field, ())
                if v in stated:
                    fact[source][0] += 1
                elif any(x in stated for x in against):
                    fact[source][1] += 1
            if against and (most := max(rows[x] for x in (v, *against))):
                fact[EVIDENCE][0 if rows[v] >= most else 1] += 1
            if against and len(v) > 1 and (most := max(spelt[x] for x in (v, *against))):
                fact[CORPUS][0 if 3 * spelt[v] >= most else 1] += 1
            facts[field, v] = {s: (a, b) for s, (a, b) in fact.items()}
    return facts


class Quality:
    """Sensitivity and specificity of each source, and the share of stated values that are true."""

    def __init__(self) -> None:
        self.sensitivity = np.full(SOURCES, SENSITIVITY[0] / sum(SENSITIVITY))
        self.specificity = np.full(SOURCES, SPECIFICITY[0] / sum(SPECIFICITY))
        self.true = TRUE_SHARE[0] / sum(TRUE_SHARE)

    def weights(self) -> tuple[np.ndarray, np.ndarray]:
        """What a claim for and a claim against of each source add to the log odds of a value."""
        return np.log(self.sensitivity / (1 - self.specificity)), np.log((1 - self.sensitivity) / self.specificity)

    def probability(self, claims: dict[int, tuple[float, float]]) -> float:
        """How probably a value is true, given who claims it and who claims a rival."""
        yes, no = self.weights()
        odds = np.log(self.true / (1 - self.true)) + sum(a * yes[s] + b * no[s] for s, (a, b) in claims.items())
        return float(1 / (1 + np.exp(-np.clip(odds, -500, 500))))

    def learn(self, sums: np.ndarray, true: float, facts: float) -> float:
        """M-step from expected counts (source, [claimed if true, not if true, claimed if false, not if false]); how far it moved."""
        before = (self.sensitivity, self.specificity, self.true)
        self.sensitivity = (sums[:, 0] + SENSITIVITY[0]) / (sums[:, 0] + sums[:, 1] + sum(SENSITIVITY))
        self.specificity = (sums[:, 3] + SPECIFICITY[0]) / (sums[:, 2] + sums[:, 3] + sum(SPECIFICITY))
        self.true = (true + TRUE_SHARE[0]) / (facts + sum(TRUE_SHARE))
        return max(float(np.max(np.abs(a - b))) for a, b in zip(before, (self.sensitivity, self.specificity, self.true)))


_PATTERN = "sources array<int>, yes array<int>, no array<int>"


def _patterns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Facts of each group as claim patterns; only their numbers matter to the model."""
    for pdf in batches:
        counts: Counter = Counter()
        for group, tokens in zip(pdf["members"], pdf["tokens"]):
            for claims in facts_of(_members(group), _seen(tokens)).values():
                counts[tuple(sorted((s, int(a), int(b)) for s, (a, b) in claims.items()))] += 1
        if counts:
            yield pd.DataFrame({"sources": [[s for s, _, _ in k] for k in counts], "yes": [[a for _, a, _ in k] for k in counts], "no": [[b for _, _, b in k] for k in counts], "n": list(counts.values())})


def _members(group) -> list[tuple[Name, float, str | None]]:
    return [(parse(m["name"]) if m["name"] is not None else Name("nobody"), float(m["rows"] or 0), m["origin"]) for m in group]


def _seen(tokens) -> dict[str, int]:
    return {t["token"]: int(t["n"]) for t in (tokens if tokens is not None else ())}


def expected(pdf: pd.DataFrame, quality: Quality) -> np.ndarray:
    """E-step over claim patterns: expected counts by source as :meth:`Quality.learn` takes them; the last row has the facts."""
    sums = np.zeros((SOURCES + 1, 4))
    if not len(pdf):
        return sums
    lengths = pdf["sources"].map(len).to_numpy()
    source, yes, no = (np.concatenate([np.asarray(x) for x in pdf[c]]).astype(t) for c, t in (("sources", np.int64), ("yes", float), ("no", float)))
    n, of = pdf["n"].to_numpy(dtype=float), np.repeat(np.arange(len(pdf)), lengths)
    up, down = quality.weights()
    odds = np.log(quality.true / (1 - quality.true)) + np.bincount(of, yes * up[source] + no * down[source], len(pdf))
    p = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
    true, false = (n * p)[of], (n * (1 - p))[of]
    for k, weight in enumerate((yes * true, no * true, yes * false, no * false)):
        sums[:, k] = np.bincount(source, weight, SOURCES + 1)
    sums[-1] = (n * p).sum(), n.sum(), 0, 0
    return sums


def infer_quality(patterns: DataFrame) -> Quality:
    """Expectation-maximisation over all claim patterns until it settles; each round is one pass that returns a row a source."""
    quality = Quality()
    for _ in range(ROUNDS):
        now = quality

        def expect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums = sum((expected(pdf, now) for pdf in batches), np.zeros((SOURCES + 1, 4)))
            at = np.flatnonzero(sums.any(axis=1))
            yield pd.DataFrame({"source": at, **{c: sums[at, k] for k, c in enumerate("abcd")}})

        rows = patterns.mapInPandas(expect, "source int, a double, b double, c double, d double").groupBy("source").agg(*(F.sum(c).alias(c) for c in "abcd")).collect()
        sums = np.zeros((SOURCES + 1, 4))
        for r in rows:
            sums[r["source"]] = [r[c] for c in "abcd"]
        if quality.learn(sums[:-1], sums[-1, 0], sums[-1, 1]) < SETTLED:
            break
    return quality


def judge(members: list[tuple[Name, float, str | None]], seen: dict[str, int], quality: Quality) -> dict[str, dict[str, float]]:
    """field -> value -> probability of being true."""
    out: dict[str, dict[str, float]] = defaultdict(dict)
    for (field, value), claims in facts_of(members, seen).items():
        out[field][value] = quality.probability(claims)
    return out


def held_true(truth: dict[str, dict[str, float]]) -> dict[str, set[str]]:
    """field -> every value judged true: probable itself, and no rival is more probable."""
    return {f: {v for v, p in values.items() if p >= TRUE_FROM and all(q <= p + 1e-9 for x, q in values.items() if rivals(f, v, x))} for f, values in truth.items()}


def choose(ids: list[int], members: list[tuple[Name, float, str | None]], seen: dict[str, int], quality: Quality) -> tuple[int, dict[str, set[str]]]:
    """(place of the surviving member, values held true).

    Field by field, the values the model holds true are what the group knows. The surviving member states the fewest values
    not held true and, of those, is worth most by the true ones; equals are told apart by having nothing added to the plain
    form, then by evidence rows, then by the lower id.
    """
    known = held_true(judge(members, seen, quality))

    def score(i: int) -> tuple:
        n, w, _ = members[i]
        said = claims_of(n)
        wrong = sum(v not in known[f] for f, values in said.items() for v in values)
        worth = sum(WORTH[f] for f, values in said.items() for v in values & known[f])
        if n.kind == "person" and not n.given:
            worth += NICKNAME if n.nickname else INITIAL if n.initial else 0
        if "abbreviated" in n.style:
            worth += ABBREVIATED
        return (-wrong, n.kind != "nobody", worth, -len(n.style), w, -ids[i])

    return max(range(len(members)), key=score), known


def _groups(clusters: DataFrame, names: DataFrame, evidence: DataFrame, analyses: DataFrame) -> DataFrame:
    """(cluster_id, run_id, members array<struct<name_id, name, rows, mentions, origin>>, tokens) of groups with several members."""
    listed = clusters.where("cluster_id is not null").groupBy("cluster_id").agg(F.max("run_id").alias("run_id"), F.first("member_name_ids").alias("member_name_ids"), F.first("member_names").alias("member_names"))
    listed = listed.where(F.size(F.filter(F.array_distinct("member_name_ids"), lambda x: x.isNotNull())) > 1)
    members = listed.select("cluster_id", "run_id", F.explode(F.arrays_zip("member_name_ids", F.coalesce("member_names", F.array().cast("array<string>")).alias("member_names"))).alias("m"))
    members = members.select("cluster_id", "run_id", F.col("m.member_name_ids").alias("name_id"), F.col("m.member_names").alias("listed")).where("name_id is not null").groupBy("cluster_id", "run_id", "name_id").agg(F.max("listed").alias("listed"))
    origin = F.col("origin").cast("string") if "origin" in names.columns else F.lit(None).cast("string").alias("origin")
    own = drop_repeats(names.select("name_id", "name_string", "mentions", origin).where("name_id is not null"), ["name_id"])
    members = members.join(own, "name_id", "left").withColumn("name", F.coalesce("name_string", "listed"))

    trim = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    runs = listed.select("run_id").distinct()
    of_run = analyses.select("analysis_id", "run_id").where("analysis_id is not null").dropDuplicates(["analysis_id"]).join(runs, "run_id", "left_semi")
    rows = drop_repeats(evidence.select("evidence_id", "analysis_id", "people").where("evidence_id is not null and size(people) > 0"), ["evidence_id"])
    rows = rows.join(of_run, "analysis_id").select("run_id", F.explode(F.array_distinct(F.transform(F.filter("people", lambda p: p.isNotNull()), trim))).alias("name")).groupBy("run_id", "name").agg(F.count(F.lit(1)).alias("rows"))
    counted = members.join(rows, ["run_id", "name"], "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    token = F.explode(F.filter(F.split(F.lower("name_string"), r"(?U)[^\w']+"), lambda t: F.length(t) > 1)).alias("token")
    corpus = own.select(token).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    used = members.select("cluster_id", F.explode(F.array_distinct(F.split(F.lower("name"), r"(?U)[^\w']+"))).alias("token")).distinct().join(corpus, "token").groupBy("cluster_id").agg(F.collect_list(F.struct("token", "n")).alias("tokens"))
    # As long as the member list of the cluster's own row.
    grouped = counted.groupBy("cluster_id").agg(F.max("run_id").alias("run_id"), F.sort_array(F.collect_list(F.struct("name_id", "name", "rows", "mentions", "origin"))).alias("members"))
    return grouped.join(used, "cluster_id", "left")


def surviving_names(clusters: DataFrame, names: DataFrame, evidence: DataFrame, analyses: DataFrame) -> DataFrame:
    """The best member of each group of at least two different member_name_ids, and what the group is judged to know.

    Columns: cluster_id, name_id, representative_name, n_members, evidence_rows (of the representative), mentions (largest
    recorded), given_names, middle_names, surnames (halves), suffixes, organisation_names (words): every value held true.

    A source is a recorder (``origin`` of name_records, where there is one) in one way of writing; sensitivity and
    specificity of all sources are inferred together with the truth of each stated value by expectation-maximisation over all
    groups until nothing moves. Groups with fewer different non-null ids are left out; members without a record take the
    listed name; null names can't be chosen before others; repeats of a row, record or evidence row count once; the stored
    representative plays no part.
    """
    groups = cut_lineage(_groups(clusters, names, evidence, analyses))
    patterns = groups.select("members", "tokens").mapInPandas(_patterns, _PATTERN + ", n long").groupBy("sources", "yes", "no").agg(F.sum("n").alias("n"))
    quality = infer_quality(cut_lineage(patterns))

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for cluster, group, tokens in zip(pdf["cluster_id"], pdf["members"], pdf["tokens"]):
                at, known = choose([int(m["name_id"]) for m in group], _members(group), _seen(tokens), quality)
                best = group[at]
                noted = [int(m["mentions"]) for m in group if m["mentions"] is not None]
                kept = [sorted(known.get(f, ())) for f in ("given", "middle", "surname", "suffix", "words")]
                out.append((cluster, int(best["name_id"]), best["name"], len(group), int(best["rows"]), max(noted, default=None), *kept))
            if out:
                yield pd.DataFrame(out, columns=["cluster_id", "name_id", "representative_name", "n_members", "evidence_rows", "mentions", "given_names", "middle_names", "surnames", "suffixes", "organisation_names"]).astype({"mentions": "Int64"})

    lists = ", ".join(f"{c} array<string>" for c in ("given_names", "middle_names", "surnames", "suffixes", "organisation_names"))
    return groups.select("cluster_id", "members", "tokens").mapInPandas(decide, f"cluster_id long, name_id long, representative_name string, n_members int, evidence_rows long, mentions long, {lists}")
