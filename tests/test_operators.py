import random
import unicodedata
from itertools import combinations

from pyspark.sql import functions as F

from vellumflow.functions import people, text
from vellumflow.operators import costs, entities, ordering, ranges, reports, state
from vellumflow.operators.components import component_roots

NAMES = ["Bernard A. Schriever", "Bernard A. Schreiver", "Gordon N. Thayer", "Gordon Thayer", "Albert G. Hill", "Albert Hill", "Albert R. Hill", "A. Hill", "Clair W. Halligan", "C. W. Halligan", "Clair Halligan", "John F. Jacobs", "J. F. Jacob", "Plato", "Plato", "", "John V", "Clair W. Halligan"]


def brute_links():
    from difflib import SequenceMatcher

    import re

    def parse(s):
        t = [x.lower() for x in re.findall("[A-Za-z]+", s)]
        core = t[:-1] if len(t) > 1 and t[-1] in ("jr", "sr", "ii", "iii", "iv", "v") else t
        return (core[-1] if core else "", core[:-1] if len(core) > 1 else [])

    def similar(a, b):
        return 1.0 if a == b else 0.0 if min(len(a), len(b)) < 4 else SequenceMatcher(a=a, b=b).ratio()

    parsed = [parse(s) for s in NAMES]
    links = set()
    for i, j in combinations(range(len(NAMES)), 2):
        (s, g), (t, h) = parsed[i], parsed[j]
        if not g or not h or g[0][0] != h[0][0] or len(g[0]) > 1 and len(h[0]) > 1 and g[0] != h[0]:
            continue
        m, n = (x[1][0] if len(x) > 1 else None for x in (g, h))
        if m and n and m != n or similar(s, t) < 0.88:
            continue
        if s == t or g[0] == h[0] or m and n:
            links.add((i, j))
    return links


def table(spark, names=NAMES):
    return spark.createDataFrame([(1, i, s, i % 3) for i, s in enumerate(names)], "run_id long, name_id long, name_string string, mentions int")


def test_links_and_clusters_against_all_pairs(spark):
    links, names = brute_links(), table(spark)
    counts = {r.name_id: r.n_links for r in entities.link_counts(names, "run_id", fuzzy=True).collect()}
    assert counts == {i: sum(i in x for x in links) for i in range(len(NAMES))}
    root = list(range(len(NAMES)))
    for _ in NAMES:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.name_id: r.cluster_id for r in entities.clusters(names, "run_id").collect()}
    assert got == dict(enumerate(root))
    best = {r.cluster_id: r.representative_name for r in entities.representatives(names, entities.clusters(names, "run_id"), "run_id").collect()}
    assert best[8] == "Clair W. Halligan" and best[11] == "John F. Jacobs" and len(best) == len(set(root))


def test_partition_faults_and_differences(spark):
    names = table(spark, ["a", "b", "c", "d"])
    c = spark.createDataFrame([(1, 1, [0, 1]), (1, 2, [1, 9]), (1, 3, []), (1, 4, None)], "run_id long, cluster_id long, members array<long>")
    got = sorted((r.fault, r.name_id) for r in entities.partition_faults(names, c, "run_id").collect())
    assert got == [("empty", None), ("empty", None), ("omitted", 2), ("omitted", 3), ("repeated", 1), ("unknown", 9)] or sorted(got, key=str) == sorted([("empty", None), ("empty", None), ("omitted", 2), ("omitted", 3), ("repeated", 1), ("unknown", 9)], key=str)
    a = spark.createDataFrame([(1, [1, 2]), (1, [3])], "run_id long, members array<long>")
    b = spark.createDataFrame([(1, [2, 1, 1]), (1, [4])], "run_id long, members array<long>")
    assert sorted((r.side, r.members) for r in entities.differing_clusters(a, b, "run_id").collect()) == [("first", [3]), ("second", [4])]


def test_upsert_modes(spark):
    old = spark.createDataFrame([("k", 1, "first", "x", 1), ("o", 1, "a", None, 1)], "key string, t int, seen string, size string, left int")
    new = spark.createDataFrame([("k", 2, "second", "y"), ("k", 3, "third", None), ("n", 1, "z", None)], "key string, t int, seen string, size string")
    got = {r.key: (r.t, r.seen, r.size, r.left) for r in state.upsert(old, new, ["key"], ["t"], keep_first=["seen"], coalesce=["size"]).collect()}
    assert got == {"k": (3, "first", "y", None), "o": (1, "a", None, 1), "n": (1, "z", None, None)}
    again = state.upsert(state.upsert(old, new, ["key"], ["t"]), new, ["key"], ["t"])
    assert sorted(map(str, again.collect())) == sorted(map(str, state.upsert(old, new, ["key"], ["t"]).collect()))
    assert sorted(r.seen for r in state.insert_absent(old, new, ["key"], ["t"]).collect()) == ["a", "first", "z"]
    kids = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "p int, ordinal int, s string")
    fresh = spark.createDataFrame([(1, [("n",)])], "p int, items array<struct<s:string>>")
    assert sorted((r.p, r.ordinal, r.s) for r in state.replace_children(kids, fresh, "p", "items").collect()) == [(1, 1, "n"), (2, 1, "c")]
    assert state.missing_references(kids, fresh, ["p"]).count() == 1


def test_store(spark, tmp_path):
    store = state.TableStore(spark, tmp_path)
    first = spark.createDataFrame([(1, "a", "2020")], "id int, v string, t string")
    store.upsert("x", first, ["id"], ["t"])
    store.upsert("x", spark.createDataFrame([(1, "b", "2021"), (2, "c", "2021")], first.schema), ["id"], ["t"], keep_first=["v"])
    assert sorted((r.id, r.v, r.t) for r in store.read("x").collect()) == [(1, "a", "2021"), (2, "c", "2021")]
    wider = spark.createDataFrame([], "id int, v string, t string, more int").schema
    assert store.read("x", wider).columns == ["id", "v", "t", "more"]
    store.append("x", first)
    assert store.read("x").count() == 3
    store.set_metadata("k", {"b": 1, "a": [2]})
    assert store.get_metadata("k") == {"a": [2], "b": 1} and store.get_metadata("z") is None


def test_costs(spark):
    prices = spark.createDataFrame([("m", 0.5, 3.0), ("m-lite", 9.0, 9.0), ("z", 1.0, 1.0)], "alias string, input_price double, output_price double")
    usage = spark.createDataFrame([(1, "m-lite-x", 1_000_000, 2_000_000, 0.0), (2, "z", 5, 5, 7.0), (3, "none", 1, 1, 0.0), (4, None, None, None, None)], "id int, model_name string, prompt_tokens long, candidate_tokens long, total_cost_usd double")
    alias = {r.model_name: r.alias for r in costs.priced_models(usage, prices).collect()}
    assert alias == {"m-lite-x": "m", "z": "z"}
    got = {r.id: r.total_cost_usd for r in costs.backfill(usage, prices).collect()}
    assert got == {1: 6.5, 2: 7.0, 3: 0.0, 4: None}
    analyses = spark.createDataFrame([("q", 1_000_000, 2_000_000)], "q string, prompt_tokens long, candidate_tokens long")
    synthesis = spark.createDataFrame([("q", 1_000, 2_000)], "q string, prompt_tokens long, candidate_tokens long")
    r = costs.summed_sources([analyses, synthesis], ["q"], ["prompt_tokens", "candidate_tokens"]).first()
    assert (r.prompt_tokens, r.candidate_tokens) == (1_001_000, 2_002_000)
    assert round(r.prompt_tokens / 1e6 * 0.5 + r.candidate_tokens / 1e6 * 3.0, 6) == 6.5065
    assert [tuple(x) for x in costs.rollup(analyses.limit(0), [], ["prompt_tokens"]).collect()] == [(0,)]


def test_numbering_and_paths(spark):
    df = spark.createDataFrame([(i % 7, i) for i in range(500)], "g int, v int")
    got = ordering.number_rows(df, [F.col("g"), F.col("v").desc()], "n", 5).collect()
    assert [(r.g, r.v) for r in sorted(got, key=lambda r: r.n)] == sorted(((i % 7, i) for i in range(500)), key=lambda x: (x[0], -x[1]))
    within = ordering.number_within(df, "g", [F.col("v")], "n").groupBy("g").agg(F.min("n").alias("a"), F.max("n").alias("b"), F.count("*").alias("c")).collect()
    assert all((r.a, r.b) == (1, r.c) for r in within)
    paths = spark.createDataFrame([("s", "long/dir/a.pdf"), ("s", "b.pdf"), ("s", "a.pdf"), (None, "x")], "sha string, path string")
    assert [tuple(r) for r in ordering.preferred_path(paths, "sha", "path").collect()] == [("s", "a.pdf")]
    assert ordering.unique_names(["a.pdf", "a.pdf", "a_1.pdf", "a.pdf", "b", "b"]) == ["a.pdf", "a_1.pdf", "a_1_1.pdf", "a_2.pdf", "b", "b_1"]
    assert ordering.number_rows(df.limit(0), [F.col("v")], "n").collect() == []


def test_ranges(spark):
    pages = spark.createDataFrame([("d", i, 10) for i in range(1, 6)] + [("e", 1, 100)], "document string, unit_no int, bytes long")
    got = sorted(tuple(r) for r in ranges.bisect_ranges(ranges.prefix_sums(pages), 20).collect())
    assert got == [("d", "001_0_0", 1, 2, 20), ("d", "001_0_1", 3, 3, 10), ("d", "001_1", 4, 5, 20), ("e", "001", 1, 1, 100)]
    c = spark.createDataFrame([("a", "x", "original", 5), ("a", "y", "qpdf", 3), ("b", "z", "original", 99), ("b", "w", "ebook", 4), ("c", "v", None, None)], "document_sha256 string, candidate_sha256 string, compression_method string, size_bytes long")
    assert {r.document_sha256: (r.choice, r.candidate_sha256) for r in ranges.choose_candidate(c, 50).collect()} == {"a": ("original", "x"), "b": ("compressed", "w"), "c": ("chunk", None)}


def test_reports(spark):
    docs = spark.createDataFrame([("s1", "a.pdf", 3), ("s2", "b.pdf", None), ("s3", "c.pdf", 4)], "sha256 string, canonical_filename string, page_count int")
    a = spark.createDataFrame([(1, 7, "s1", "failed", None, 0, None), (2, 8, "s2", "succeeded", True, 2, None)], "analysis_id int, query_id int, document_sha256 string, status string, responsive boolean, evidence_count int, relevance_score int")
    report = reports.document_report(docs, a, 7)
    assert report.count() == 3
    k = reports.key_figures(report).first()
    assert (k.total_documents, k.total_pages, k.failed_documents, k.unanalyzed_documents, k.errors_label) == (3, 7, 1, 3, "1 failure, 3 unanalyzeds")
    assert sorted(r.sha256 for r in reports.pending(docs, a).collect()) == ["s1", "s3"]
    assert reports.pending(docs, a, force=True).count() == 3
    rows = spark.createDataFrame([(1, 1, [" Clair W. Halligan", "C. W. Halligan", ""]), (1, 2, ["W. O. Baker", "W. O. Baker"])], "run int, id int, people array<string>")
    mapping = spark.createDataFrame([(1, "C. W. Halligan", "Clair W. Halligan")], "run int, name string, canonical string")
    assert {r.id: r.people for r in reports.canonical_people(rows, mapping, "id", "run").collect()} == {1: ["Clair W. Halligan"], 2: ["W. O. Baker"]}
    timeline = rows.selectExpr("run", "id as evidence_id", "people", "1960 as y", "id as m", "1 as d", "concat('l', id) as date_label")
    index = reports.people_index(timeline, mapping, "run").orderBy("surname_key", "given_key").collect()
    assert [(r.person, r.mention_count, r.variants) for r in index] == [("W. O. Baker", 1, ["W. O. Baker"]), ("Clair W. Halligan", 1, ["C. W. Halligan", "Clair W. Halligan"])]
    d = spark.createDataFrame([(False, False, 3, None, False), (False, False, 0, None, True), (False, True, 0, "x", True), (True, True, 9, None, None), (False, False, 0, "succeeded", False), (False, False, 0, "failed", True)], "o boolean, f boolean, n int, s string, w boolean")
    got = [r.x for r in d.select(reports.refresh_synthesis(F.col("o"), F.col("f"), F.col("n"), F.col("s")).alias("x")).collect()]
    assert got == [True, True, True, False, False, True]


def test_store_versions_and_buckets(spark, tmp_path):
    """Upserts rewrite only the buckets they touch; readers of an older version go on reading it; old versions end."""
    store = state.TableStore(spark, tmp_path / "s", buckets=8)
    rows = lambda pairs: spark.createDataFrame(pairs, "k long, v string, at int")
    store.upsert("t", rows([(i, "a", 1) for i in range(200)]), ["k"], ["at"])
    before = store.read("t")
    folders = {p for p in (tmp_path / "s/t").iterdir() if p.name.startswith("data-")}
    store.upsert("t", rows([(5, "b", 2), (5, "c", 1)]), ["k"], ["at"])
    fresh = [p for p in (tmp_path / "s/t").iterdir() if p.name.startswith("data-") and p not in folders]
    assert len([p for p in fresh[0].iterdir() if p.name.startswith("_bucket=")]) == 1
    assert before.where("v = 'b'").count() == 0 and before.count() == 200
    assert {tuple(r) for r in store.read("t").where("k = 5").collect()} == {(5, "b", 2)} and store.read("t").count() == 200
    store.upsert("t", rows([(5, "late", 0)]), ["k"], ["at"], compete=True)
    assert store.read("t").where("k = 5").first().v == "b"
    store.append("t", rows([(900, "x", 1)]).withColumn("more", F.lit(1)))
    assert store.read("t").count() == 201 and store.read("t").where("more is not null").count() == 1
    store.upsert("t", rows([(900, "y", 3)]), ["k"], ["at"])
    assert {tuple(r)[:2] for r in store.read("t").where("k = 900").collect()} == {(900, "y")} and store.read("t").count() == 201
    for i in range(6):
        store.write("t", rows([(i, "z", 1)]))
    assert len([p for p in (tmp_path / "s/t").iterdir() if p.name.startswith("manifest-")]) == state.KEPT
    assert len([p for p in (tmp_path / "s/t").iterdir() if p.name.startswith("data-")]) == state.KEPT and store.read("t").count() == 1
    store.upsert("e", rows([]), ["k"], ["at"])
    assert store.read("e").count() == 0


def test_similar_keys_miss_no_similar_pair():
    from difflib import SequenceMatcher

    rnd, words = random.Random(4), set()
    for _ in range(120):
        w = "".join(rnd.choice("abcde") for _ in range(rnd.randint(2, 16)))
        words.add(w)
        for _ in range(4):
            i = rnd.randrange(len(w))
            words.add(rnd.choice([w[:i] + w[i + 1 :], w[:i] + "x" + w[i:], w[:i] + "x" + w[i + 1 :], w[: i // 2] + w[i // 2 + 1 :]]) or "a")
    keys = {w: [set(k) for k in entities.similar_keys(w)] for w in words}
    similar = [(a, b) for a in words for b in words if a == b or min(len(a), len(b)) >= 4 and SequenceMatcher(a=a, b=b, autojunk=True).ratio() >= people.SIMILAR]
    assert len(similar) > 1.5 * len(words) and all(keys[a][1] & keys[b][0] for a, b in similar)
    assert sum(bool(keys[a][1] & keys[b][0]) for a in words for b in words) < 0.3 * len(words) ** 2


def test_components_against_union_find(spark):
    rnd = random.Random(7)
    links = [(rnd.randrange(3), rnd.randrange(150), rnd.randrange(150)) for _ in range(220)] + [(9, i, i + 1) for i in range(70)] + [(9, 3, 3)]
    top = {}

    def find(x):
        top.setdefault(x, x)
        while top[x] != x:
            x = top[x]
        return x

    for g, a, b in links:
        a, b = find((g, a)), find((g, b))
        top[max(a, b)] = min(a, b)
    want = {(g, i, find((g, i))[1]) for g, i in top if find((g, i)) != (g, i)}
    assert {tuple(r) for r in component_roots(spark.createDataFrame(links, "g int, a long, b long"), "g").collect()} == want
    assert component_roots(spark.createDataFrame([], "g int, a long, b long"), "g").count() == 0


def test_outside_clustering_is_not_trusted(spark):
    names = spark.createDataFrame([(1, 1, "Anna Karlholt", 1), (1, 2, "A. Karlholt", 1), (1, 3, "Bo Oskoyd", 1)], "run long, name_id long, name_string string, mentions int")
    groups = lambda rows: lambda n: spark.createDataFrame(rows, "run long, cluster_id long, members array<long>")
    good = entities.clustered_by(names, "run", groups([(1, 1, [1]), (1, 2, [2, 3])]))
    assert good[0] == "external" and {tuple(r.members) for r in good[1].collect()} == {(1,), (2, 3)}

    def broken(n):
        raise RuntimeError("no service")

    for outside in (None, broken, groups([(1, 1, [1, 2])]), groups([(1, 1, [1, 2, 3]), (1, 2, [3])]), groups([])):
        method, got = entities.clustered_by(names, "run", outside)
        assert method == "local" and {tuple(r.members) for r in got.collect()} == {(1, 2), (3,)}


def test_assembly(spark):
    names = spark.createDataFrame([(1, 4, "Anna Karlholt", 1), (1, 2, "A. Karlholt", 1), (1, 3, "Bo Oskoyd", 1), (1, 9, "anna karlholt", 5), (2, 1, "?", 1)], "run long, name_id long, name_string string, mentions int")
    got = {(r.run, r.cluster_no): r for r in entities.assembled(names, "run").collect()}
    assert got[1, 1].member_name_ids == [2, 4, 9] and got[1, 1].rationale == "2-4: same surname and compatible initials; 4-9: same surname and matching first name"
    assert (got[1, 1].representative_name_id, got[1, 2].rationale, got[1, 2].member_names, got[2, 1].member_name_ids) == (9, "singleton", ["Bo Oskoyd"], [1])


def test_long_documents_add_up_in_blocks(spark):
    pages = [(d, i, (i * 7) % 11) for d in range(2) for i in range(3, 9_500, 1 + d)]
    df = spark.createDataFrame([*pages, (7, 5, None)], "document int, unit_no int, bytes int")
    got = {(r.document, r.k): r.total for r in ranges.prefix_sums(df).collect()}
    for d in range(2):
        total = 0
        for k, (_, _, b) in enumerate([p for p in pages if p[0] == d], 1):
            total += b
            assert got[d, k] == total
    assert got[7, 1] == 0 and len(got) == len(pages) + 1
    parts = sorted((r.document, r.start_page, r.end_page) for r in ranges.bisect_ranges(ranges.prefix_sums(df), 4_000).collect() if r.document == 0)
    assert parts[0][1] == 1 and parts[-1][2] == 9_497 and all(a[2] + 1 == b[1] for a, b in zip(parts, parts[1:]))
    assert ranges.bisect_ranges(ranges.prefix_sums(df.limit(0))).count() == 0


def test_casefold(spark):
    """The rule of Unicode for every letter but Cherokee's."""
    letters = [chr(i) for i in range(1, 0x2FFFF) if not 0xD800 <= i <= 0xDFFF and not 0x13A0 <= i <= 0x13FF and not 0xAB70 <= i <= 0xABBF and unicodedata.category(chr(i)) in ("Lu", "Ll", "Lt")]
    df = spark.createDataFrame([(c,) for c in [*letters, "Straße İß", "", None, "ΟΔΟΣ"]], "x string")
    wrong = [r.x for r in df.select("x", text.casefold("x").alias("y")).collect() if r.x is not None and r.y != r.x.casefold()]
    assert len(wrong) <= 12 and not {"Straße İß", "ΟΔΟΣ", "ß"} & set(wrong), wrong
