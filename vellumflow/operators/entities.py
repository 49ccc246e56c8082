"""Rule-based name linking: names sharing a first initial, compatible given names and (nearly) one surname are one person."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumflow.functions import people, text
from vellumflow.operators.components import component_roots
from vellumflow.operators.ordering import number_within
from vellumflow.plans.tables import cut_lineage


def name_classes(names: DataFrame, by: str) -> DataFrame:
    """Different combinations of the parts that linking looks at, with how many names have them: copies never meet."""
    p = people.name_parts("name_string")
    parts = names.select(by, "name_id", p.alias("p"))
    return parts.groupBy(by, F.col("p.surname").alias("surname"), F.col("p.first_token").alias("first_token"), F.col("p.first_initial").alias("first_initial"), F.col("p.middle_initial").alias("middle_initial")).agg(
        F.count(F.lit(1)).alias("n"), F.min("name_id").alias("least_id")
    )


def _segments(length: int, parts: int) -> list[tuple[int, int]]:
    """Start and length of the parts a word is divided into, the longer ones last."""
    short, more = divmod(length, parts)
    sizes = [short + (i >= parts - more) for i in range(parts)]
    return [(sum(sizes[:i]), n) for i, n in enumerate(sizes)]


def _partners(length: int) -> list[tuple[int, int]]:
    """(other length, letters at most unmatched) of every word that can be similar to one of ``length``."""
    slack = int(length / people.SIMILAR) + 2
    return [(other, over) for other in range(4, slack + length) if (over := int((1 - people.SIMILAR) * (length + other) + 1e-9)) >= abs(length - other)]


@lru_cache(100_000)
def similar_keys(word: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """(keys a word is found by, keys it looks for): two words that can be similar at all share one.

    Similar words have all but a few letters in common, in order. Divided into one part more than that, one part of the
    one stands whole in the other, shifted by no more than those few letters. Words under four letters have only themselves.
    """
    n = len(word)
    if n < 4:
        return (f"={word}",), (f"={word}",)
    found = [f"{n},{m},{i},{word[at : at + k]}" for m, over in _partners(n) for i, (at, k) in enumerate(_segments(n, over + 1))]
    sought = [f"{m},{n},{i},{word[x : x + k]}" for m, over in _partners(n) for i, (at, k) in enumerate(_segments(m, over + 1)) for x in range(max(0, at - over), min(n - k, at + over) + 1)]
    return tuple(dict.fromkeys(found)), tuple(dict.fromkeys(sought))


_KEYS = T.StructType([T.StructField(n, T.ArrayType(T.StringType())) for n in ("found", "sought")])


@F.pandas_udf(_KEYS)
def _similar_keys(surname: pd.Series) -> pd.DataFrame:
    keys = [similar_keys(s) for s in surname]
    return pd.DataFrame({"found": [list(f) for f, _ in keys], "sought": [list(s) for _, s in keys]})


def similar_surnames(rows: DataFrame) -> DataFrame:
    """(surname, other): different surnames of ``rows`` that are similar, each way round, as the measure has a direction.

    Each surname is taken once, whatever groups it stands in; those that share a key of :func:`similar_keys` are compared.
    """
    # So many partitions that the keys, of which a surname has dozens, are made on all cores.
    many = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = rows.select("surname").distinct().repartition(many, "surname").withColumn("_k", _similar_keys("surname"))
    place = lambda keys: F.explode(F.transform(keys, lambda k: F.xxhash64(k))).alias("_key")
    found = keyed.select(F.col("surname").alias("other"), place("_k.found"))
    met = keyed.select("surname", place("_k.sought")).join(found, "_key")
    met = met.where((F.col("surname") != F.col("other")) & people.could_be_similar(F.col("surname"), F.col("other"))).select("surname", "other").distinct()
    return met.repartition(many, "surname", "other").where(people.surnames_similar("surname", "other"))


def class_links(classes: DataFrame, by: str, fuzzy: bool) -> DataFrame:
    """Links between classes with one first initial, from the class with the lesser id to the other, and why they are linked.

    Names without a first initial link to nothing. Without ``fuzzy`` surnames must be equal; with it they may be similar,
    the surname of the lower id coming first.
    """
    own = classes.where("first_initial is not null").select(by, "first_initial", "surname", "least_id", F.struct("surname", "first_token", "first_initial", "middle_initial").alias("a"), F.col("n").alias("n_a"))
    other = own.select(by, "first_initial", F.col("surname").alias("other"), F.col("least_id").alias("other_id"), F.col("a").alias("b"), F.col("n_a").alias("n_b"))
    pairs = own.join(other.withColumnRenamed("other", "surname"), [by, "first_initial", "surname"]).drop("surname")
    if fuzzy:
        near = similar_surnames(own)
        pairs = pairs.unionByName(own.join(near, "surname").join(other, [by, "first_initial", "other"]).drop("surname", "other"))
    a, b = F.col("a"), F.col("b")
    fits = pairs.where("least_id < other_id").where(people.linked(a, b))
    return fits.select(by, "least_id", "other_id", "n_a", "n_b", people.link_reason(a, b).alias("reason"))


def link_counts(names: DataFrame, by: str, fuzzy: bool = False) -> DataFrame:
    """(by, name_id, n_links): one row a name with the number of other names it links to.

    Names of one class link to each other if they have a first initial; across classes the links of :func:`class_links` hold
    for every pair of their names, so counts are added up, not pairs spelt out.
    """
    classes = cut_lineage(name_classes(names, by))
    links = class_links(classes, by, fuzzy)
    toward = links.select(by, F.col("least_id").alias("id"), F.col("n_b").alias("n")).unionByName(links.select(by, F.col("other_id").alias("id"), F.col("n_a").alias("n")))
    outside = toward.groupBy(by, "id").agg(F.sum("n").alias("outside"))
    outside = outside.select(F.col(by).alias("_by"), "id", "outside")
    counted = classes.join(outside, (F.col(by) == F.col("_by")) & (F.col("least_id") == F.col("id")), "left").select(
        F.col(by).alias("_run"), F.col("surname").alias("_surname"), F.col("first_token").alias("_first"), F.col("middle_initial").alias("_middle"),
        F.when(F.col("first_initial").isNotNull(), F.col("n") - 1 + F.coalesce("outside", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"),
    )
    p = people.name_parts("name_string")
    parts = names.select(by, "name_id", p.alias("p")).select(by, "name_id", "p.surname", "p.first_token", "p.middle_initial")
    same = (F.col(by) == F.col("_run")) & (F.col("surname") == F.col("_surname")) & F.col("first_token").eqNullSafe(F.col("_first")) & F.col("middle_initial").eqNullSafe(F.col("_middle"))
    return parts.join(counted, same).select(by, "name_id", "n_links")


def clusters(names: DataFrame, by: str, fuzzy: bool = True, links: DataFrame | None = None) -> DataFrame:
    """(by, name_id, cluster_id): connected components of the links, each named by its least name_id.

    Components are found over classes of equal parts, in rounds of joins; names without a first initial stay alone.
    """
    classes = cut_lineage(name_classes(names, by))
    links = class_links(classes, by, fuzzy) if links is None else links
    roots = component_roots(links.select(by, F.col("least_id").alias("a"), F.col("other_id").alias("b")), by)
    p = people.name_parts("name_string")
    own = names.select(by, "name_id", p.alias("p"))
    key = [by, "surname", "first_token", "middle_initial"]
    parts = own.select(by, "name_id", "p.surname", F.coalesce("p.first_token", F.lit("")).alias("first_token"), F.coalesce("p.middle_initial", F.lit("")).alias("middle_initial"))
    ids = classes.select(by, "surname", F.coalesce("first_token", F.lit("")).alias("first_token"), F.coalesce("middle_initial", F.lit("")).alias("middle_initial"), F.col("least_id").alias("id"), "first_initial")
    joined = parts.join(ids, key).join(roots, [by, "id"], "left")
    return joined.select(by, "name_id", F.when(F.col("first_initial").isNull(), F.col("name_id")).otherwise(F.coalesce("root", "id")).alias("cluster_id"))


def dense_ids(clustered: DataFrame, by: str) -> DataFrame:
    """(by, cluster_id, cluster_no): numbers from 1 in each group, in the order of the clusters' least members."""
    least = clustered.groupBy(by, "cluster_id").agg(F.min("name_id").alias("least"))
    return number_within(least, by, [F.col("least")], "cluster_no").select(by, "cluster_id", F.col("cluster_no").cast("int").alias("cluster_no"))


def assembled(names: DataFrame, by: str, fuzzy: bool = True) -> DataFrame:
    """(by, cluster_no, representative_name_id, representative_name, member_name_ids, member_names, rationale): whole clusters.

    Members are in order of their ids. The rationale names links that hold a cluster together, in order: of the names with
    equal parts each to their least id, and the links between those; 'singleton' where there is none. Links that say no
    more (every name of a class to every other) are not spelt out, so that a rationale grows with its cluster.
    """
    classes = cut_lineage(name_classes(names, by))
    links = cut_lineage(class_links(classes, by, fuzzy))
    found = cut_lineage(clusters(names, by, fuzzy, links))
    p = people.name_parts("name_string")
    parts = names.select(by, "name_id", p.alias("p")).select(by, "name_id", "p.surname", "p.first_token", "p.middle_initial")
    same = [F.col(f"n.{by}") == F.col(f"c.{by}"), F.col("n.surname") == F.col("c.surname"), F.col("n.first_token").eqNullSafe(F.col("c.first_token")), F.col("n.middle_initial").eqNullSafe(F.col("c.middle_initial"))]
    of_class = parts.alias("n").join(classes.where("first_initial is not null").alias("c"), same).where("n.name_id > c.least_id")
    within = of_class.select(F.col(f"n.{by}").alias(by), F.col("c.least_id").alias("a"), F.col("n.name_id").alias("b"), F.lit(people.SAME).alias("reason"))
    every = within.unionByName(links.select(by, F.col("least_id").alias("a"), F.col("other_id").alias("b"), "reason"))
    said = every.join(found.select(by, F.col("name_id").alias("a"), "cluster_id"), [by, "a"]).groupBy(by, "cluster_id").agg(F.sort_array(F.collect_list(F.struct("a", "b", "reason"))).alias("r"))
    rationale = F.array_join(F.transform("r", lambda x: F.concat(x["a"].cast("string"), F.lit("-"), x["b"].cast("string"), F.lit(": "), x["reason"])), "; ")
    members = found.join(names.select(by, "name_id", "name_string"), [by, "name_id"]).groupBy(by, "cluster_id").agg(F.sort_array(F.collect_list(F.struct("name_id", "name_string"))).alias("m"))
    best = representatives(names, found, by).select(by, "cluster_id", F.col("name_id").alias("representative_name_id"), "representative_name")
    whole = members.join(dense_ids(found, by), [by, "cluster_id"]).join(best, [by, "cluster_id"]).join(said, [by, "cluster_id"], "left")
    return whole.select(by, "cluster_no", "representative_name_id", "representative_name", F.col("m.name_id").alias("member_name_ids"), F.col("m.name_string").alias("member_names"), F.coalesce(rationale, F.lit("singleton")).alias("rationale"))


def clustered_by(names: DataFrame, by: str, outside: Callable[[DataFrame], DataFrame] | None) -> tuple[str, DataFrame]:
    """('external' or 'local', clusters as by, cluster_id, members): the outside clustering if it is a partition of the names,
    else the rule-based one. ``outside`` may be missing or fail; what it returns is not trusted."""
    if outside is not None:
        try:
            got = cut_lineage(outside(names).select(by, "cluster_id", "members"))
            judged = names.select(by).distinct().join(got.select(by).distinct(), by, "left_anti")
            if not judged.limit(1).count() and not partition_faults(names, got, by).limit(1).count():
                return "external", got
        except Exception:  # whatever stops an outside service, the run goes on without it
            pass
    own = clusters(names, by)
    return "local", own.groupBy(by, "cluster_id").agg(F.sort_array(F.collect_list("name_id")).alias("members"))


def representatives(names: DataFrame, clustered: DataFrame, by: str) -> DataFrame:
    """(by, cluster_id, name_id, representative_name, members): most informative, then most mentioned, longest, last in
    alphabet, lowest id."""
    p = people.name_parts("name_string")
    rows = clustered.join(names.select(by, "name_id", "name_string", "mentions"), [by, "name_id"])
    score = F.struct(p["information"], F.coalesce("mentions", F.lit(0)), F.length("name_string"), text.casefold("name_string"), -F.col("name_id"))
    return rows.groupBy(by, "cluster_id").agg(F.max_by(F.struct("name_id", "name_string"), score).alias("r"), F.count(F.lit(1)).alias("members")).select(by, "cluster_id", F.col("r.name_id").alias("name_id"), F.col("r.name_string").alias("representative_name"), "members")


def partition_faults(expected: DataFrame, clustering: DataFrame, by: str) -> DataFrame:
    """What is wrong with an external clustering of ``expected`` (by, name_id): rows (by, fault, name_id).

    ``clustering``: by, cluster_id, member ids as array. Faults: empty (name_id null), unknown, repeated, omitted. Only
    groups that have a clustering are judged.
    """
    members = clustering.select(by, "cluster_id", F.explode("members").alias("name_id"))
    own = expected.join(clustering.select(by).distinct(), by, "left_semi").select(by, "name_id").distinct()
    fault = lambda df, name: df.select(by, F.lit(name).alias("fault"), "name_id")
    empty = clustering.where("members is null or size(members) = 0").select(by, F.lit(None).cast("long").alias("name_id"))
    unknown = members.join(own, [by, "name_id"], "left_anti").select(by, "name_id").distinct()
    repeated = members.groupBy(by, "name_id").count().where("count > 1")
    omitted = own.join(members, [by, "name_id"], "left_anti")
    return fault(empty, "empty").unionByName(fault(unknown, "unknown")).unionByName(fault(repeated, "repeated")).unionByName(fault(omitted, "omitted"))


def differing_clusters(a: DataFrame, b: DataFrame, by: str) -> DataFrame:
    """(by, side, members): member sets one clustering has and the other hasn't. Both: by, members array."""
    key = lambda df: df.select(by, F.array_sort(F.array_distinct("members")).alias("members")).distinct()
    x, y = key(a), key(b)
    only = lambda p, q, side: p.join(q, [by, "members"], "left_anti").select(by, F.lit(side).alias("side"), "members")
    return only(x, y, "first").unionByName(only(y, x, "second"))
