"""Variant spellings of one person or organisation linked within each run."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumflow.llm.names import Name, alike, core, fold, formal_names, loose, parse
from vellumflow.plans.tables import cut_lineage, drop_repeats

#: Padded q-grams, MinHash rows of a band, and the collision curve's two demands: pairs of at least this similarity are to
#: meet in some band with at least this probability. A slip in a six-letter name leaves 0.4.
Q, ROWS, SIMILARITY, RECALL = 2, 2, 0.4, 0.99
#: Different blocks a task compares; a run with more is spread over slices by band.
SLICE_BLOCKS = 2_000
#: Monge-Elkan similarity two strings of one entity reach, and what each of their parts reaches by itself.
VERIFIED, PART = 0.86, 0.5
#: Inner similarities of parts that are no two spellings: nothing to compare with, an initial, a nickname.
UNSAID, HALF, INITIAL, NICKNAME, SPELT_OUT = 0.95, 0.8, 0.9, 0.95, 0.97
#: Strings of a cluster that one task pairs with the whole cluster.
PAIRED = 1_000
_SEED = 20_011


def bands_needed(similarity: float = SIMILARITY, recall: float = RECALL, rows: int = ROWS) -> int:
    """Bands at which 1 - (1 - s**rows)**bands reaches ``recall`` for s = ``similarity``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


BANDS = bands_needed()
_PRIME = (1 << 31) - 1
_A, _B = np.random.default_rng(_SEED).integers(1, _PRIME, (2, BANDS * ROWS), dtype=np.int64)


def band_hashes(block: str) -> np.ndarray:
    """One hash for each band: the MinHash values of its rows over the padded q-grams of ``block``."""
    padded = "\x02" * (Q - 1) + block + "\x03" * (Q - 1)
    grams = {padded[i : i + Q] for i in range(len(padded) - Q + 1)}
    codes = np.array([(ord(g[0]) * 1_114_111 + ord(g[1])) % _PRIME for g in grams], dtype=np.int64)
    least = ((codes[:, None] * _A[None, :] + _B[None, :]) % _PRIME).min(axis=0).reshape(BANDS, ROWS)
    return (least[:, 0] * 1_000_003 + least[:, 1]) % ((1 << 61) - 1)


def blocks_of(name: Name) -> str:
    """What the bands are laid over: the surname without particles, or an organisation's words, its head first."""
    if name.kind == "person":
        return "p " + core(name.surname)
    if name.kind == "organisation":
        return "o " + " ".join(fold(w) for w in name.words)
    return "a " + "".join(name.words)


def node_key(name: Name) -> str:
    """Strings with the same parts are one node, whatever their case, order, titles and spacing."""
    if name.kind != "person":
        return blocks_of(name)
    return "|".join(("p", core(name.surname), fold(name.given), name.initial, fold(name.nickname), " ".join(fold(m) for m in name.middle), name.suffix))


def _from_key(key: str) -> dict:
    _, surname, given, initial, nickname, middle, suffix = key.split("|")
    name = Name("person", given, initial, nickname, surname=surname)
    formal = formal_names(name)
    initials = {f[0] for f in formal} | ({initial} if initial else set()) | ({nickname[0]} if nickname else set())
    return {"surname": surname, "given": given, "formal": formal, "initials": initials, "whole": bool(given or nickname), "middle": middle.split(), "suffix": suffix}


def edits(a: str, b: str) -> int:
    """Letters added, dropped, replaced or swapped with their neighbour to make ``b`` of ``a``."""
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y)))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[j] = min(row[j], last[j - 2] + 1)
    return row[-1]


@lru_cache(200_000)
def inner(a: str, b: str) -> float:
    """Character similarity of two folded words: a second slip costs three times the first, and short words bear fewer."""
    if a == b:
        return 1.0
    if loose(a) == loose(b):
        return SPELT_OUT
    shorter, longer = sorted((len(a), len(b)))
    return max(0.0, 1 - edits(a, b) ** 2 / longer) if shorter > 2 and longer > 3 else 0.0


def _first_name(a: dict, b: dict) -> float:
    """Similarity of two first names, of all the forms they can stand for."""
    if not a["initials"] or not b["initials"]:
        return UNSAID
    if a["whole"] and b["whole"]:
        if a["given"] and a["given"] == b["given"]:
            return 1.0
        best = max((inner(x, y) for x in a["formal"] for y in b["formal"]), default=0.0)
        return min(best, NICKNAME) if not (a["given"] and b["given"]) else best
    return INITIAL if a["initials"] & b["initials"] else 0.0


def _middle_names(a: list[str], b: list[str]) -> list[float]:
    if not a or not b:
        return [UNSAID] if a or b else []
    return [float(x == y) if len(x) == len(y) == 1 else SPELT_OUT * (x[0] == y[0]) if 1 in (len(x), len(y)) else inner(x, y) for x, y in zip(a, b)]


@lru_cache(200_000)
def _surname(a: str, b: str) -> tuple[float, ...]:
    """Similarities of the halves of two surnames; a missing half counts as HALF."""
    x, y = a.split("-"), b.split("-")
    whole = inner("".join(x), "".join(y))
    if len(x) == len(y):
        each = tuple(inner(p, q) for p, q in zip(x, y))
        return each if min(each) >= PART or whole < PART else (whole,)
    short, long = sorted((x, y), key=len)
    best = max(inner(short[0], long[0]), inner(short[-1], long[-1])) if len(short) == 1 else min(inner(p, q) for p, q in zip(short, long))
    return (best, HALF) if best >= whole else (whole,)


def person_similarity(a: dict, b: dict) -> float:
    """Monge-Elkan similarity: the mean, over the parts either name has, of each part's similarity to its best counterpart.

    A part the other leaves out costs little. Where a part is nothing like its counterpart (another first name, middle
    initial or suffix) the two are told apart, whatever the mean.
    """
    parts = [_first_name(a, b), *_middle_names(a["middle"], b["middle"]), *_surname(a["surname"], b["surname"])]
    if a["suffix"] or b["suffix"]:
        parts.append(1.0 if a["suffix"] == b["suffix"] else 0.0 if a["suffix"] and b["suffix"] else SPELT_OUT)
    return sum(parts) / len(parts) if min(parts) >= PART else 0.0


def organisation_similarity(a: str, b: str) -> float:
    """Monge-Elkan similarity of two organisations' words, none of which may lack a counterpart."""
    x, y = a[2:].split(), b[2:].split()
    if len(x) != len(y):
        return 0.0
    best = [max(inner(w, v) for v in y) for w in x]
    return sum(best) / len(best) if min(best) >= PART else 0.0


def star_clusters(nodes: list[tuple[str, int]], similarity: Callable[[int, int], float], rank: Callable[[int], tuple], absorb: Callable[[int, int], None] | None = None, near: Callable[[int], list] | None = None, keys: Callable[[int], list] = lambda i: [None]) -> list[int]:
    """Star clustering: places of the centres, one for each node.

    ``near`` gives the keys that all nodes similar to a node have one of; centres without such a key are not compared with it.

    Nodes are taken from the most complete to the least. A node similar to no centre becomes one; otherwise it joins the
    most similar. A node equally similar to several centres could be any of them and stays on its own without
    becoming a centre.
    """
    order = sorted(range(len(nodes)), key=rank)
    centres: dict[object, list[tuple[int, int]]] = {}
    at = list(range(len(nodes)))
    for k, i in enumerate(order):
        tried = {mc for x in (near(i) if near else [None]) for mc in centres.get(x, ())}
        found = sorted(((s, -m, c) for m, c in tried if (s := similarity(c, i)) >= VERIFIED), reverse=True)
        if not found:
            for x in keys(i):
                centres.setdefault(x, []).append((k, i))
        elif len(found) == 1 or found[0][0] > found[1][0] + 1e-9:
            at[i] = found[0][2]
            if absorb:
                absorb(found[0][2], i)
    return at


def join_bridged(at: list[int], similarity: Callable[[int, int], float], agree: Callable[[int, int], bool], near: Callable[[int], list] | None = None, keys: Callable[[int], list] = lambda i: [None]) -> list[int]:
    """``at`` with clusters joined whose centres are spelt too differently, but one of which fits a member of the other.

    A centre that fits members of several clusters joins none of them; ``agree`` tells whether two centres can be one at all.
    """
    members: dict[object, list[int]] = {}
    for i in range(len(at)):
        for x in keys(i):
            members.setdefault(x, []).append(i)
    size = Counter(at)
    top = {c: c for c in size}

    def root(c: int) -> int:
        while top[c] != c:
            c = top[c]
        return c

    for c in sorted(top):
        fits: set[int] = set()
        for x in near(c) if near else [None]:
            for m in members.get(x, ()):
                if at[m] != c and at[m] not in fits and similarity(m, c) >= VERIFIED:
                    fits.add(at[m])
        if len(fits) == 1 and agree(b := fits.pop(), c) and size[b] > 1:
            low, high = sorted((root(b), root(c)), key=lambda x: (size[x], -x))
            top[low] = high
    return [root(c) for c in at]


def _family(rows: list[tuple[str, int]]) -> list[str]:
    """Cluster of each (node key, mentions) of one family, named by the key of its centre."""
    if rows[0][0][0] != "p":
        similarity = lambda c, i: organisation_similarity(rows[c][0], rows[i][0])
        return [rows[c][0] for c in join_bridged(star_clusters(rows, similarity, lambda i: (-rows[i][1], rows[i][0])), similarity, lambda b, c: True)]
    parts = [_from_key(k) for k, _ in rows]

    def rank(i: int) -> tuple:
        p = parts[i]
        return (-(2 if p["given"] else 1 if p["whole"] else 0), -bool(p["suffix"]), -max((2 if len(m) > 1 else 1 for m in p["middle"]), default=0), -("-" in p["surname"]), not p["initials"], -rows[i][1], rows[i][0])

    def absorb(c: int, i: int) -> None:
        """The centre learns what its own string leaves out."""
        a, b = parts[c], parts[i]
        if not a["middle"] and b["middle"]:
            parts[c] = a = a | {"middle": b["middle"]}
        if not a["suffix"] and b["suffix"]:
            parts[c] = a | {"suffix": b["suffix"]}

    own = [dict(p) for p in parts]
    surnames = sorted({p["surname"] for p in parts})
    near = {a: [b for b in surnames if min(_surname(b, a)) >= PART] for a in surnames}
    # First names one can stand for another begin alike: of their first three letters one is the same, as few slips as they bear.
    letters = [sorted(p["initials"] | {x for f in p["formal"] for x in f[:3]}) or [""] for p in own]
    every = sorted({x for ls in letters for x in ls})
    sought = lambda i: [(s, x) for s in near[own[i]["surname"]] for x in ([*letters[i], ""] if letters[i] != [""] else every)]
    by_name = (sought, lambda i: [(own[i]["surname"], x) for x in letters[i]])

    def agree(b: int, c: int) -> bool:
        """Only the surname keeps the two apart, and their first names are not one slip apart as well."""
        return _first_name(parts[b], parts[c]) >= INITIAL and person_similarity(parts[b], parts[c] | {"surname": parts[b]["surname"]}) >= VERIFIED

    at = star_clusters(rows, lambda c, i: person_similarity(parts[c], own[i]), rank, absorb, *by_name)
    return [rows[c][0] for c in join_bridged(at, lambda m, c: person_similarity(own[m], own[c]), agree, *by_name)]


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        names = [parse(s) if isinstance(s, str) else Name("nobody") for s in pdf["name_string"]]
        keep = np.array([n.kind != "nobody" and bool(n.surname or n.words) for n in names], dtype=bool)
        named = [n for n, k in zip(names, keep) if k]
        if not named:
            continue
        yield pd.DataFrame({"run_id": pdf["run_id"][keep], "name_id": pdf["name_id"][keep], "mentions": pdf["mentions"][keep], "node": [node_key(n) for n in named], "block": [blocks_of(n) for n in named], "letters": [_letters(n) for n in named]})


def _letters(name: Name) -> str:
    if name.kind == "organisation":
        return "".join(fold(w)[:1] for w in name.words)
    return "".join(name.words) if name.kind == "acronym" else ""


def _sliced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each block once for each slice of its run that one of its bands falls into."""
    for pdf in batches:
        run, block, weight, slices = [], [], [], []
        for r in pdf.itertuples(index=False):
            into = {0} if r.slices == 1 else set((band_hashes(r.block) % r.slices).tolist())
            for s in into:
                run.append(r.run_id), block.append(r.block), weight.append(r.weight), slices.append((s, r.slices))
        yield pd.DataFrame({"run_id": run, "block": block, "weight": weight, "slice": [s for s, _ in slices], "slices": [n for _, n in slices]})


def _grouped(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[tuple[tuple, list]]:
    """Rows of each group of a stream sorted by ``by``, groups running on over batches."""
    rows = (r for pdf in batches for r in pdf.itertuples(index=False))
    for key, group in groupby(rows, key=lambda r: tuple(getattr(r, b) for b in by)):
        yield key, list(group)


def _verified_links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Similar blocks that share a band lead to each other: a link from every block of what hangs together to its weightiest."""
    out: list[tuple] = []
    for (run, slice_), group in _grouped(batches, ["run_id", "slice"]):
        if len(group) > 1:
            hashes = np.array([band_hashes(r.block) for r in group])
            # Of the blocks that meet in a band only those are compared that become one by dropping a letter of each.
            slips: dict[tuple[str, str], list[int]] = {}
            for i, r in enumerate(group):
                if r.block[0] != "a":
                    for k in _slip_keys(r.block):
                        slips.setdefault(k, []).append(i)
            tried = {(i, j) for same in slips.values() if len(same) > 1 for n, i in enumerate(same) for j in same[n + 1 :]}
            if tried and group[0].slices > 1:
                hashes = np.where(hashes % group[0].slices == slice_, hashes, -np.arange(1, len(group) + 1)[:, None])
            top = list(range(len(group)))

            def root(i: int) -> int:
                while top[i] != i:
                    top[i] = i = top[top[i]]
                return i

            for i, j in tried:
                a, b = group[i], group[j]
                if (x := root(i)) != (y := root(j)) and (hashes[i] == hashes[j]).any() and _blocks_alike(a.block[2:], b.block[2:]):
                    low, high = sorted((x, y), key=lambda i: (group[i].weight, group[i].block))
                    top[low] = high
            out += [(run, r.block, r.weight, group[x].block, group[x].weight) for i, r in enumerate(group) if (x := root(i)) != i]
        if len(out) > 20_000:
            yield pd.DataFrame(out, columns=["run_id", "block", "weight", "other", "other_weight"])
            out = []
    if out:
        yield pd.DataFrame(out, columns=["run_id", "block", "weight", "other", "other_weight"])


def _slip_keys(block: str) -> set[tuple[str, str]]:
    """What two blocks a slip apart have in common: the block, or the first half of a double one, less one letter or spelt loosely."""
    kind, text = block[0], block[2:]
    halves = text.split("-")
    whole = "".join(halves)
    keys = {(kind, whole[:i] + whole[i + 1 :]) for i in range(len(whole))} | {(kind, whole), (kind + "~", loose(whole))}
    if len(halves) == 2:
        first = halves[0]
        keys |= {(kind + "-", first[:i] + first[i + 1 :]) for i in range(len(first))} | {(kind + "-", first), (kind + "-~", loose(first))}
    return keys


def _blocks_alike(a: str, b: str) -> bool:
    if alike(a, b):
        return True
    x, y = a.split("-"), b.split("-")
    return len(x) == len(y) == 2 and all(alike(p, q) for p, q in zip(x, y)) or "-" in a + b and alike("".join(x), "".join(y))


def block_families(blocks: DataFrame) -> DataFrame:
    """(run_id, block, family) of blocks that similar spellings lead to: all that hang together by links are one family.

    ``blocks``: run_id, block, weight, all different. A family is named by its weightiest block, which is left out itself, as
    are blocks without neighbour.
    """
    per_run = blocks.groupBy("run_id").agg(F.ceil(F.count(F.lit(1)) / SLICE_BLOCKS).cast("long").alias("slices"))
    sliced = blocks.join(per_run, "run_id").mapInPandas(_sliced, "run_id long, block string, weight long, slice long, slices long")
    sorted_ = sliced.repartition("run_id", "slice").sortWithinPartitions("run_id", "slice")
    found = sorted_.mapInPandas(_verified_links, "run_id long, block string, weight long, other string, other_weight long")
    links = cut_lineage(found.select("run_id", F.struct("weight", "block").alias("low"), F.struct(F.col("other_weight").alias("weight"), F.col("other").alias("block")).alias("high")).distinct())
    while True:  # every link leads upwards; a block of several slices may have several, whose ends are then linked in turn
        top = links.groupBy("run_id", "low").agg(F.max("high").alias("top"), F.count(F.lit(1)).alias("_n"))
        up = top.select("run_id", F.col("low").alias("high"), F.col("top").alias("_next"))
        held = cut_lineage(links.join(top, ["run_id", "low"]).join(up, ["run_id", "high"], "left"))
        if not held.where("_n > 1 or _next is not null").limit(1).count():
            return links.select("run_id", "low.block", F.col("high.block").alias("family"))
        own = held.select("run_id", "low", F.when(F.col("high") == F.col("top"), F.coalesce("_next", "high")).otherwise(F.col("top")).alias("high"))
        aside = held.where("high <> top").select("run_id", F.col("high").alias("low"), F.col("top").alias("high"))
        links = cut_lineage(own.unionByName(aside).distinct())


def _clustered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    out: list[tuple] = []
    for (run, _), group in _grouped(batches, ["run_id", "family"]):
        own = [(r.node, int(r.weight)) for r in group]
        out += [(run, n, c) for (n, _), c in zip(own, _family(own))] if len(own) > 1 else [(run, own[0][0], own[0][0])]
        if len(out) > 20_000:
            yield pd.DataFrame(out, columns=["run_id", "node", "cluster"])
            out = []
    if out:
        yield pd.DataFrame(out, columns=["run_id", "node", "cluster"])


def link_names(names: DataFrame) -> DataFrame:
    """(run_id, name_id, cluster) of every string that names somebody; cluster is unique within its run.

    ``names``: run_id, name_id, name_string, mentions. Strings are taken apart once; strings with equal parts are one node,
    so copies never meet. Padded q-gram MinHash bands over surnames (organisations: over all their words) find the spellings
    that may be one, a slip of the pen verifies them, and all that hang together form a family; runs too large for a task are
    spread over slices by band. Within a family (whose size is the number of different part combinations, not of rows) the
    nodes of all alike surnames are star-clustered under Monge-Elkan similarity. Half-names of double surnames and acronyms are then given to the one
    cluster they fit, and stay alone where they fit several.

    Rows with null run, id or string, blank strings and those that say the name is unknown are left out; repeats of a
    name_id count once; null mentions count 1; other columns are ignored.
    """
    own = names.select("run_id", "name_id", "name_string", F.greatest(F.coalesce(F.col("mentions").cast("long"), F.lit(1)), F.lit(1)).alias("mentions")).where("run_id is not null and name_id is not null and name_string is not null")
    records = cut_lineage(drop_repeats(own, ["name_id"]).mapInPandas(_parsed, "run_id long, name_id long, mentions long, node string, block string, letters string"))
    nodes = records.groupBy("run_id", "node", "block", "letters").agg(F.sum("mentions").alias("weight"))
    blocks = nodes.groupBy("run_id", "block").agg(F.sum("weight").alias("weight"))
    families = block_families(blocks.where("block not like 'a %'"))
    placed = nodes.join(families, ["run_id", "block"], "left").withColumn("family", F.coalesce("family", "block"))
    placed = cut_lineage(placed)
    home = _cluster_families(placed)
    linked = _double_surnames(placed, home)
    linked = _acronyms(placed, linked)
    return records.select("run_id", "name_id", "node").join(linked, ["run_id", "node"]).select("run_id", "name_id", "cluster")


def _cluster_families(placed: DataFrame) -> DataFrame:
    ordered = placed.select("run_id", "family", "node", "weight").repartition("run_id", "family").sortWithinPartitions("run_id", "family")
    return cut_lineage(ordered.mapInPandas(_clustered, "run_id long, node string, cluster string"))


def _double_surnames(placed: DataFrame, home: DataFrame) -> DataFrame:
    """Clusters named by half of a double surname given to the double's cluster that fits their centre, if just one does."""
    double = placed.where("block like 'p %-%'").select("run_id", "node", F.explode(F.array(F.split(F.substring("block", 3, 1_000_000), "-")[0], F.element_at(F.split(F.substring("block", 3, 1_000_000), "-"), -1))).alias("half"))
    double = double.join(home, ["run_id", "node"]).select("run_id", F.concat(F.lit("p "), "half").alias("block"), F.col("cluster").alias("theirs")).distinct()
    single = placed.where("block like 'p %' and block not like '%-%'").join(home.where("node = cluster"), ["run_id", "node"], "left_semi")

    @F.pandas_udf("boolean")
    def fits(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([person_similarity(_from_key(x), _from_key(y)) >= VERIFIED for x, y in zip(a, b)], dtype=bool)

    found = single.select("run_id", F.col("node").alias("cluster"), "block").join(double, ["run_id", "block"]).where("theirs <> cluster").where(fits("theirs", "cluster"))
    given = found.groupBy("run_id", "cluster").agg(F.min("theirs").alias("theirs"), F.count_distinct("theirs").alias("n")).where("n = 1").drop("n")
    return home.join(given, ["run_id", "cluster"], "left").select("run_id", "node", F.coalesce("theirs", "cluster").alias("cluster"))


def _acronyms(placed: DataFrame, linked: DataFrame) -> DataFrame:
    """Acronyms given to the one organisation of their run whose first letters they are."""
    long = placed.where("block like 'o %'").select("run_id", "node", "letters").join(linked, ["run_id", "node"])
    one = long.groupBy("run_id", "letters").agg(F.min("cluster").alias("theirs"), F.count_distinct("cluster").alias("n")).where("n = 1").drop("n")
    given = placed.where("block like 'a %'").select("run_id", "node", "letters").join(one, ["run_id", "letters"]).select("run_id", "node", "theirs")
    return linked.join(given, ["run_id", "node"], "left").select("run_id", "node", F.coalesce("theirs", "cluster").alias("cluster"))


def linked_names(names: DataFrame) -> DataFrame:
    """(run_id, name_id, cluster, n_links): every string that names somebody, its cluster and how many others are in it."""
    linked = cut_lineage(link_names(names))
    sizes = linked.groupBy("run_id", "cluster").agg((F.count(F.lit(1)) - 1).alias("n_links"))
    return linked.join(sizes, ["run_id", "cluster"]).select("run_id", "name_id", "cluster", "n_links")


def variant_pairs(names: DataFrame, known: DataFrame, share: int = PAIRED) -> DataFrame:
    """(name_id_a, name_id_b), a < b, of all strings of one entity, for the runs that have no row in ``known`` clusters.

    A cluster is paired in shares of ``share`` strings, each of which meets the whole cluster in a task of its own.
    """
    runs = known.select("run_id").where("run_id is not null").distinct()
    linked = linked_names(names.join(runs, "run_id", "left_anti")).where("n_links > 0").withColumn("shares", F.ceil((F.col("n_links") + 1) / share).cast("int"))
    a = linked.select("run_id", "cluster", F.pmod(F.xxhash64("name_id"), "shares").cast("int").alias("share"), F.col("name_id").alias("name_id_a"))
    b = linked.select("run_id", "cluster", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.col("name_id").alias("name_id_b"))
    return a.join(b, ["run_id", "cluster", "share"]).where("name_id_a < name_id_b").select("name_id_a", "name_id_b")
