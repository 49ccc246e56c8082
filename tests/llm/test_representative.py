import numpy as np
import pandas as pd

from vellumflow.llm import representative
from vellumflow.llm.names import parse
from vellumflow.llm.representative import Quality, choose, claims_of, expected, facts_of, rivals, source_of, surviving_names

GROUPS = [
    (["Quenamoto, Hiroshi A.", "Hiroshi Quenamtoo", "Hiroshi Andrew Quenamoto", "hiroshi quenamoto", "Hiroshi Quenamoto"], "Hiroshi Andrew Quenamoto"),
    (["E. Y. Dunáková", "Elizabeth  Dunáková", "Elizabeth Y. Dunakova", "Elizabeth Y. Dunáková"], "Elizabeth Y. Dunáková"),
    (["Greg Luskosz", "Gregory J. Luskosz", 'Gregory "Greg" J. Luskosz'], "Gregory J. Luskosz"),
    (["F. H. Fennottel", "Fenottel, Francis", "Francis H. Fennottel, Jr.", "Francis H. Fennottel Jr"], "Francis H. Fennottel, Jr."),
    (["Leonard Rookerby", "Leonard Rookerby-Pellünger", "Leonard L. Rookerby-Pellünger"], "Leonard L. Rookerby-Pellünger"),
    (["I.J.S.", "Inst. of Joint Signals", "Institute of Joint Signa1s", "THE INSTITUTE OF JOINT SIGNALS", "Institute of Joint Signals", "Joint Signals Institute"], "Institute of Joint Signals"),
    (["María Ibsohlt", "Ibsholt, María", "María Ibsholt"], "María Ibsholt"),
]


def tables(spark, groups, evidence=(), extra=()):
    names, clusters, i = [], [], 0
    for c, (members, _) in enumerate(groups):
        ids = []
        for m in members:
            names.append((i, 1, m, None if i % 2 else 3, 0))
            ids.append(i)
            i += 1
        clusters.append((c, 1, [*ids, ids[0]], [*members, members[0]], 99, "x"))
    clusters += [clusters[0], (100, 1, [1, 1, None], ["a", "a", None], 1, "x"), (101, 1, None, None, 1, "x"), (102, 1, [5000, 5001], None, 1, "x"), (None, 1, [1, 2], ["a", "b"], 1, "x"), *extra]
    return (
        spark.createDataFrame(clusters, "cluster_id long, run_id long, member_name_ids array<long>, member_names array<string>, name_id long, rows string"),
        spark.createDataFrame([*names, names[0]], "name_id long, run_id long, name_string string, mentions int, rows int"),
        spark.createDataFrame(list(evidence), "evidence_id long, analysis_id long, people array<string>, name string"),
        spark.createDataFrame([(7, 1), (7, 1), (8, 2), (None, 1)], "analysis_id long, run_id long"),
    )


def test_best_members(spark):
    got = {r.cluster_id: r for r in surviving_names(*tables(spark, GROUPS)).collect()}
    assert {c: got[c].representative_name for c in range(len(GROUPS))} == {c: want for c, (_, want) in enumerate(GROUPS)}
    assert set(got) == {*range(len(GROUPS)), 102}
    assert got[102].name_id == 5000 and got[102].representative_name is None
    assert got[0].n_members == 5 and got[0].mentions == 3
    assert set(got[0].middle_names) >= {"a", "andrew"}


def test_evidence_decides_between_equals(spark):
    groups = [(["Anna Veckholt", "Anna Vockholt"], "")]
    rows = [(1, 7, [" Anna Vockholt", "Anna Vockholt", None], "x"), (2, 7, ["Anna ", "Anna Vockholt "], "x"), (3, 8, ["Anna Veckholt"], "x"), (4, 7, ["Anna Veckholt"], "x"), (1, 7, [" Anna Vockholt", "Anna Vockholt", None], "x"), (5, 7, None, "x")]
    r = surviving_names(*tables(spark, groups, rows)).where("cluster_id = 0").first()
    assert (r.name_id, r.evidence_rows) == (1, 2)


def test_nothing(spark):
    assert surviving_names(*(t.limit(0) for t in tables(spark, GROUPS))).collect() == []


def planted(unreliable):
    """Groups in which recorder 'a' spells rightly and two others wrongly together, after groups in which those two were found out."""
    names, clusters, i = [], [], 0
    letters = "bcdfghjklmnprstvwz"
    for c in range(80):
        stem = "".join(letters[(c // 18**k) % 18] + "aeo"[k] for k in range(3)) + "mund"
        right, wrong = f"Anna {stem.title()}", f"Anna {stem.title().replace('mund', 'munk')}"
        said = [(right, "a"), (wrong, unreliable), (wrong + " ", unreliable)] if c < 20 else [(right, "a"), (right.upper(), "a"), (right.lower(), "b"), (wrong, unreliable)]
        clusters.append((c, 1, list(range(i, i + len(said))), [n for n, _ in said]))
        for n, origin in said:
            names.append((i, n, 1, origin))
            i += 1
    return clusters, names


def test_an_unreliable_recorder_is_found_out(spark, monkeypatch):
    """The inferred quality decides: with it the single right spelling survives two wrong ones, with the prior alone it doesn't,
    and with a posterior of 0.5 for everything some rows change as well."""
    clusters, names = planted("careless")
    data = (
        spark.createDataFrame(clusters, "cluster_id long, run_id long, member_name_ids array<long>, member_names array<string>"),
        spark.createDataFrame(names, "name_id long, name_string string, mentions int, origin string"),
        spark.createDataFrame([], "evidence_id long, analysis_id long, people array<string>"),
        spark.createDataFrame([], "analysis_id long, run_id long"),
    )
    wrong = lambda: sum(r.representative_name.strip().endswith("munk") for r in surviving_names(*data).where("cluster_id < 20").collect())
    assert wrong() == 0
    monkeypatch.setattr(representative, "infer_quality", lambda patterns: Quality())
    assert wrong() == 20
    odd = [(parse("Anna Bacmunk"), 0.0, "careless"), (parse("ANNA BACMUND"), 0.0, "a"), (parse("Anna Bacmund, Jr."), 0.0, "a")]
    fitted = Quality()
    assert choose([1, 2, 3], odd[:2], {}, fitted)[0] == 0 and choose([1, 2, 3], odd, {}, fitted)[0] == 2
    monkeypatch.setattr(Quality, "probability", lambda self, claims: 0.5)
    assert all(values == set(p) for f, p in representative.judge(odd, {}, fitted).items() for values in [representative.held_true({f: p})[f]])


def test_model_learns_a_careless_source():
    good, bad = source_of(parse("Anna Veckholt"), "a"), source_of(parse("Anna Veckholt"), "careless")
    patterns = pd.DataFrame({"sources": [[good, bad], [good, bad], [good]], "yes": [[3, 0], [0, 1], [3]], "no": [[0, 1], [3, 0], [0]], "n": [40, 40, 40]})
    q = Quality()
    for _ in range(30):
        sums = expected(patterns, q)
        moved = q.learn(sums[:-1], sums[-1, 0], sums[-1, 1])
    assert q.specificity[good] > 0.9 > 0.5 > q.specificity[bad] and q.sensitivity[good] > 0.9 > q.sensitivity[bad] and moved < 1e-3
    each = [q.probability({good: (3, 0), bad: (0, 1)}), q.probability({good: (0, 3), bad: (1, 0)}), q.probability({good: (3, 0)})]
    assert np.allclose(sums[-1, 0], 40 * sum(each), atol=0.1)
    assert expected(patterns.iloc[:0], q).sum() == 0


def test_claims():
    assert claims_of(parse("Ted Oskoyd")) == {"surname": {"oskoyd"}}
    assert claims_of(parse("Theodore Quentin Oskoyd, Jr.")) == {"surname": {"oskoyd"}, "given": {"theodore"}, "middle": {"q", "quentin"}, "suffix": {"jr"}}
    assert claims_of(parse("Anna Maria Luise Veckholt-Rooker")) == {"surname": {"veckholt", "rooker"}, "given": {"anna"}, "middle": {"m", "maria", "l", "luise"}}
    assert facts_of([(parse("?"), 0.0, None)], {}) == {}
    assert choose([4, 3], [(parse("A B"), 1.0, None), (parse("A B"), 1.0, None)], {}, Quality())[0] == 1


def test_every_middle_name_counts(spark):
    """Two middle names are both held true, and the member that states both survives."""
    groups = [(["Anna Maria Veckholt", "Anna Luise Veckholt", "Anna Maria Luise Veckholt", "Anna M. Veckholt"], "Anna Maria Luise Veckholt")]
    r = surviving_names(*tables(spark, groups)).where("cluster_id = 0").first()
    assert r.representative_name == "Anna Maria Luise Veckholt" and {"maria", "luise"} <= set(r.middle_names)


def test_rivals():
    assert rivals("surname", "ibsholt", "ibsohlt") and rivals("surname", "pellünger", "pellunger") and rivals("given", "anna", "maria")
    assert not rivals("surname", "rookerby", "pellünger") and not rivals("middle", "a", "andrew") and not rivals("words", "joint", "joint")
