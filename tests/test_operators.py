"""Behaviour of single operators on rows of our own."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from provisio.functions import citation, text
from provisio.operators import activity, answer, answer_cache, answering, catalog, currentlaw, evaluation, hierarchy, indexing, ingest, merge, retrieval
from provisio.sources import html_units, metadata, pdf_lines


def one(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("art. 471", ("471", None, None, None)),
        ("Art. 5 ust. 2 pkt 3 lit. B", ("5", "2", "3", "b")),
        ("§ 4 ust. 2 pkt 3", ("4", "2", "3", None)),
        ("§ 4", (None, "4", None, None)),
        ("art. 8 § 1 ust. 9", ("8", "1", None, None)),
        ("start 5", (None, None, None, None)),
    ],
)
def test_citation(spark, query, want):
    row = spark.range(1).select(*(c.alias(k) for k, c in citation.parsed(F.lit(query)).items())).first()
    assert tuple(row) == want


def test_text_functions(spark):
    row = spark.range(1).select(
        text.squeezed(F.lit("  a  b\n c ")), text.folded(F.lit("Zażółć gęślą")), text.utf16_length(F.lit("a😀")), text.is_iso_date(F.lit("2024-02-30")),
        text.after_first_underscore(F.lit("arti_5_a")), text.shortened(F.lit("abcdef"), 3), text.path_part(F.lit("a b/c")), F.array_join(text.tokens(F.lit("Łódź, x1!")), "|"),
    ).first()
    assert tuple(row) == ("a b c", "Zazolc gesla", 3, False, "5_a", "abc…", "a%20b%2Fc", "lodz|x1")


def test_lexical_needs_two_words(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "alpha only"), (3, "beta gamma alpha"), (4, None)], "id long, text string")
    asked = spark.createDataFrame([(1, "Alpha beta"), (2, "gamma"), (3, "")], "query_id long, query string")
    assert {(r.query_id, r.id) for r in retrieval.lexical_hits(docs, asked).collect()} == {(1, 1), (1, 3), (2, 3)}


def test_vector_search_and_guard(spark):
    docs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, None), (4, [0.0, 0.0]), (5, [-1.0, 0.1])], "id long, embedding array<float>")
    found = retrieval.vector_search(docs, {7: [1.0, 0.0]}, limit=3)
    assert [(r.id, r.vector_rank) for r in found.orderBy("vector_rank").collect()] == [(1, 1), (2, 2), (5, 3)]
    lexical = spark.createDataFrame([(7, 5, 1)], "query_id long, id long, lexical_rank int")
    kept = retrieval.fused(lexical, found, min_similarity=0.9)
    assert {r.id for r in kept.collect()} == {1, 5}  # a lexical hit is never dropped
    assert retrieval.vector_search(docs, {}).count() == 0
    with pytest.raises(ValueError, match="scope"):
        retrieval.in_scope(docs, [], "id")


NODES = [
    ("d", None, "division", None, None, None, None), ("a1", "d", "article", "1", None, None, None), ("a2", "d", "article", "2", None, None, None),
    ("c1", "a1", "clause", None, "1", None, None), ("c2", "a2", "clause", None, "1", None, None), ("p1", "c1", "point", None, None, "3", None), ("loop", "loop", "article", "9", None, None, None),
]


def test_citation_match_and_cycles(spark):
    nodes = spark.createDataFrame(NODES, "id string, parent_id string, provision_type string, article string, paragraph string, point string, letter string")
    match = lambda **c: {r.id for r in hierarchy.citation_matches(nodes, c).collect()}
    assert match(article="1", paragraph="1") == {"c1"}
    assert match(paragraph="1") == {"c1", "c2"}
    assert match(article="1", paragraph="1", point="3") == {"p1"}
    assert match(article="2", point="3") == set()  # no step back to a shallower unit
    assert match() == set()
    assert hierarchy.ancestors(nodes, nodes.where("id = 'loop'")).count() == 1  # a walk ends where it meets a node again
    assert {r.id for r in hierarchy.with_roots(nodes).where("is_root").collect()} == {"d"}


def test_merge_and_relations(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (3, None, 1)], "id long, v string, made int")
    new = spark.createDataFrame([(1, "a", 9), (2, "c", 9), (3, None, 9), (4, "d", 9)], "id long, v string, made int")
    out = merge.merged(old, new, ["id"], ["v"], kept=["made"])
    assert {(r.id, r.v, r.made, r.action) for r in out.collect()} == {(1, "a", 1, "unchanged"), (2, "c", 1, "updated"), (3, None, 1, "unchanged"), (4, "d", 9, "inserted")}
    assert {r.id for r in merge.state(merge.merged(new, old, ["id"], ["v"])).collect()} == {1, 2, 3}
    t0, t1 = datetime.datetime(2024, 1, 1), datetime.datetime(2024, 2, 1)
    schema = "legal_act_id long, relation_type string, related_source_id string, source_relation_type string, related_legal_act_id long, is_active boolean, discovered_at timestamp_ntz, refreshed_at timestamp_ntz"
    edges = spark.createDataFrame([(1, "x", "s1", "l", None, True, t0, t0), (1, "x", "s2", "l", 5, True, t0, t0)], schema)
    listed = spark.createDataFrame([(1, "x", "s1", "l"), (1, "x", "s3", "l")], "legal_act_id long, relation_type string, related_source_id string, source_relation_type string")
    acts = spark.createDataFrame([(77, "s1")], "id long, source_id string")
    out = {r.related_source_id: r for r in merge.merged_relations(edges, listed, acts, F.lit(t1).cast("timestamp_ntz")).collect()}
    assert (out["s1"].related_legal_act_id, out["s1"].refreshed_at, out["s1"].action) == (77, t1, "updated")
    assert (out["s2"].is_active, out["s2"].refreshed_at, out["s2"].related_legal_act_id, out["s2"].action) == (False, t0, 5, "deactivated")
    assert out["s3"].action == "inserted"


def test_shrink_guard(spark):
    rows = lambda n: spark.createDataFrame([("v", i) for i in range(n)], "version_id string, i int")
    assert merge.replaced_provisions(rows(11), rows(10), "v").count() == 10
    with pytest.raises(merge.ShrunkTooMuch):
        merge.replaced_provisions(rows(11), rows(6), "v")
    with pytest.raises(merge.ShrunkTooMuch):
        merge.replaced_provisions(rows(1), rows(0), "v", allow_shrink=True)


def test_index_difference(spark):
    old = spark.createDataFrame([(1, "h"), (2, "h"), (3, "h")], "id long, content_hash string")
    new = spark.createDataFrame([(1, "h"), (2, "x"), (4, "h")], "id long, content_hash string")
    assert {tuple(r) for r in indexing.difference(old, new).collect()} == {(1, "unchanged"), (2, "embedded"), (3, "removed"), (4, "embedded")}


def test_ladder_order(spark):
    base = dict(in_force=True, act_expires=None, as_of=datetime.date(2024, 1, 1), n_chain=1, n_unresolved_chain=0, n_applicable=1, n_versions=1, n_well_formed=1, newest_structured=True, n_amendment_unresolved=0, n_amendment_effective=0, n_correction=0, n_tribunal_unresolved=0, n_tribunal=0, state_date=None, tribunal_date=None)
    cases = [({}, "authoritative_current"), ({"in_force": None}, "act_not_in_force"), ({"n_chain": 0}, "no_official_consolidated_version"), ({"n_applicable": 2}, "metadata_incomplete"),
             ({"newest_structured": False}, "latest_tj_content_unavailable"), ({"n_amendment_unresolved": 1, "n_amendment_effective": 1}, "unresolved_temporal_effect"),
             ({"n_tribunal": 1}, "unresolved_constitutional_tribunal_effect")]
    schema = "k int, in_force boolean, act_expires date, as_of date, n_chain int, n_unresolved_chain int, n_applicable int, n_versions int, n_well_formed int, newest_structured boolean, n_amendment_unresolved int, n_amendment_effective int, n_correction int, n_tribunal_unresolved int, n_tribunal int, state_date date, tribunal_date date"
    rows = spark.createDataFrame([{"k": i, **base, **c} for i, (c, _) in enumerate(cases)], schema)
    assert [r.reason_code for r in currentlaw.decided(rows).orderBy("k").collect()] == [w for _, w in cases]


def test_packing_budgets(spark):
    pack = lambda sizes, **k: [r.id for r in answer.packed(spark.createDataFrame([(0, i, i, s) for i, s in enumerate(sizes)], "g int, rank int, id long, n_chars int"), "g", **k).orderBy("source_no").collect()]
    assert pack([10] * 17) == list(range(16))
    assert pack([20_000, 1]) == [0]
    assert pack([8_000, 5_000, 3_000]) == [0, 2]


def test_verification_gates(spark):
    """Requests: 1 passes and demotes by conclusion; 2 to 4 fail whole; 5 and 6 had an invalid response."""
    ids = {1: range(4), 2: (10, 11), 3: (20, 21), 4: (30, 31), 5: (40, 41), 6: (50, 51)}
    conclusions = spark.createDataFrame([(r, i, ["S1", "S2"], 1) for r, its in ids.items() for i in its], "request int, conclusion int, claimed array<string>, target int")
    verdicts = spark.createDataFrame([(i, "partial_support" if i in (1, 51) else "direct_support") for r, its in ids.items() for i in its if i not in (11, 40, 41)], "conclusion int, verdict string")
    quotes = spark.createDataFrame([(i, "S9" if i == 21 else "S1", "not_found" if i == 2 else "verbatim") for its in ids.values() for i in its], "conclusion int, source_id string, status string")
    skeptic = spark.createDataFrame([(i, i == 3) for its in ids.values() for i in its if i not in (31, 50, 51)], "conclusion int, leap boolean")
    batches = spark.createDataFrame([(5, False, True), (6, True, False)], "request int, verifier_valid boolean, skeptic_valid boolean")
    out = {r.conclusion: (r.outcome, r.support) for r in answering.gated(conclusions, verdicts, quotes, skeptic, batches).collect()}
    failed, demoted = ("error", []), ("demoted", [])
    assert out == {0: ("verified", ["S1"]), 1: demoted, 2: demoted, 3: demoted, **dict.fromkeys((10, 11, 20, 21, 30, 31), failed), **dict.fromkeys((40, 41, 50, 51), demoted)}


def test_recovery_only_adds(spark):
    first = spark.createDataFrame([(1, 1, 0, "verified", ["S1"]), (1, 2, 1, "demoted", []), (2, 3, 0, "demoted", []), (3, 4, None, "verified", ["S1"])], "request int, conclusion int, target int, outcome string, support array<string>")
    targets = spark.createDataFrame([(r, t, f"t{t}") for r in (1, 2, 3, 4) for t in (0, 1)], "request int, target int, text string")
    assert {r.request: r.mode for r in answering.recovery_modes(targets, first).collect()} == {1: "partial", 2: "full", 3: "none", 4: "full"}
    assert {tuple(r) for r in answering.open_targets(targets, first).collect()} == {(1, 1), (2, 0), (2, 1), (4, 0), (4, 1)}
    drafts = [(1, 10, 1), (1, 11, None), (2, 12, 0), (2, 13, 1), (3, 14, 0), (4, 15, 1)]
    own = [(c, "not_found" if c == 13 else "verbatim") for _, c, _ in drafts]
    run = lambda rows: answering.recovered(
        first, targets, spark.createDataFrame([(r, c, ["S1"], t) for r, c, t in rows], "request int, conclusion int, claimed array<string>, target int"),
        spark.createDataFrame(own, "conclusion int, status string"), spark.createDataFrame([(c, "direct_support") for _, c, _ in rows], "conclusion int, verdict string"),
        spark.createDataFrame([(c, "S1", "verbatim") for _, c, _ in rows], "conclusion int, source_id string, status string"), spark.createDataFrame([(c, False) for _, c, _ in rows], "conclusion int, leap boolean"),
        spark.createDataFrame([], "request int, verifier_valid boolean, skeptic_valid boolean"),
    )
    out = {r.conclusion: (r.phase, r.outcome) for r in run(drafts).collect()}
    assert out == {1: ("first", "verified"), 2: ("first", "demoted"), 3: ("first", "demoted"), 4: ("first", "verified"), **dict.fromkeys((10, 11, 12, 15), ("recovery", "verified"))}
    # a draft about a target that is done spoils its request's pass
    assert {r.conclusion for r in run([*drafts, (1, 16, 0)]).where("phase = 'recovery'").collect()} == {12, 15}


def test_packing_for_targets(spark):
    """Two targets whose best candidate is the same: the second one gets its next best."""
    hits = spark.createDataFrame(
        [(1, 10, 1, 1, 1, "most_likely", 0.9, False), (1, 10, 1, 2, 2, "most_likely", 0.9, False), (1, 11, 1, 3, 2, "most_likely", 0.1, False), (1, 12, 1, 4, 3, "possible", 0.95, False), (1, 13, 1, 5, 1, "possible", 0.01, True), (2, 14, 1, 6, 1, "most_likely", 0.2, False), (2, 15, 1, 7, 1, "most_likely", 0.2, False)],
        "request int, id long, issue_no int, query_no int, target int, likelihood string, score double, is_exact boolean",
    )
    sources = spark.createDataFrame([(i, "art. 2" if i == 14 else "art. 1", 9000 if i == 11 else 2000) for i in range(10, 16)], "id long, label string, n_chars int")
    pack = lambda **k: [(r.request, r.id, r.reserved_for) for r in answering.packed_for_targets(hits, sources, **k).orderBy("request", "source_no").collect()]
    assert pack() == [(1, 10, 1), (1, 11, 2), (2, 15, 1), (2, 14, None)]
    assert pack(most_chars=20_000) == [(1, 10, 1), (1, 11, 2), (1, 13, None), (1, 12, None), (2, 15, 1), (2, 14, None)]
    assert pack(most_chars=8_000) == [(1, 10, 1), (1, 13, None), (1, 12, None), (2, 15, 1), (2, 14, None)]
    assert pack(most_sources=1) == [(1, 10, 1), (2, 15, 1)]


def test_answer_texts(spark):
    done = spark.createDataFrame([(1, None, 1, "last", ["b"]), (1, 2, 2, "second", []), (1, 1, 9, "first", ["a", "b"])], "request int, target int, position int, statement string, labels array<string>")
    targets = spark.createDataFrame([(1, 1, "one", True), (1, 3, "three", False)], "request int, target int, text string, is_covered boolean")
    paths = spark.createDataFrame([(1, 1, "p", "why", ["c"]), (1, 2, "q", "", [])], "request int, position int, label string, explanation string, labels array<string>")
    doubts = spark.createDataFrame([(1, 1, "d")], "request int, position int, text string")
    asked = spark.createDataFrame([(1, "which?")], "request int, question string")
    text = answering.answer_texts(done, targets, paths, doubts, asked).first().answer
    assert text.split("\n\n") == [answering.INTRO, "first (a, b)", "second", "last (b)", f"{answering.UNSUPPORTED}\n- three", f"{answering.OTHER_PATHS}\n- p: why (c)", f"{answering.UNCERTAINTIES}\n- d", f"{answering.CLARIFICATION}which?"]


def plain_walk(parents: dict, leaf) -> list:
    found, at = [], parents[leaf]
    while at in parents and at not in found:
        found.append(at)
        at = parents[at]
    return found


def walked(nodes) -> dict:
    found = {}
    for r in hierarchy.ancestors(nodes, nodes).collect():
        found.setdefault(r.leaf, []).append((r.depth, r.id))
    return {k: [x for _, x in sorted(v)] for k, v in found.items()}


def test_walks_start_at_the_parent_and_end_at_what_they_met(spark):
    rows = [("a", "b"), ("b", "a"), ("c", "b"), ("d", "gone"), ("e", None), ("s", "s"), ("t", "s"), ("u", "t"), ("x", "z"), ("y", "x"), ("z", "y"), ("w", "x"), ("v", "w"), (None, "a")]
    found = walked(spark.createDataFrame(rows, "id string, parent_id string"))
    assert found["a"] == ["b", "a"] and found["b"] == ["a", "b"] and found["s"] == ["s"] and found["v"] == ["w", "x", "z", "y"]
    parents = {k: v for k, v in rows if k}
    assert found == {k: w for k in parents if (w := plain_walk(parents, k))}


def test_walks_of_any_tree_by_brute_force(spark):
    rng = random.Random(7)
    parents = {i: rng.choice([rng.randrange(220), max(0, i - 1), None, -1]) for i in range(200)}
    assert walked(spark.createDataFrame(list(parents.items()), "id long, parent_id long")) == {k: w for k in parents if (w := plain_walk(parents, k))}


def test_walks_have_any_depth(spark):
    chain = spark.range(1001).selectExpr("id", "case when id > 0 then id - 1 end as parent_id")
    rows = hierarchy.ancestors(chain, chain.where("id in (1000, 3)")).collect()
    assert sorted((r.leaf, r.depth, r.id) for r in rows) == sorted([(1000, i + 1, 999 - i) for i in range(1000)] + [(3, i + 1, 2 - i) for i in range(3)])


def plain_tree(rows: list[tuple], at) -> dict:
    below = sorted((o, i) for i, up, o in rows if up == at)
    own = next(o for i, _, o in rows if i == at)
    return {"id": at, "ordinal": own, "children": [plain_tree(rows, i) for _, i in below]}


def test_nesting_of_any_depth(spark):
    rng = random.Random(3)
    rows = [(f"n{i}", f"n{i - 1}" if 0 < i < 25 else f"n{rng.randrange(i)}" if i > 30 else None if i else "gone", rng.randrange(3)) for i in range(90)]
    rows[50] = ('q"\\', rows[50][1], 1)  # what JSON escapes
    rows = [r if r[1] != "n50" else (r[0], 'q"\\', r[2]) for r in rows]
    nodes = spark.createDataFrame([(1, *r) for r in rows], "version_id int, id string, parent_id string, ordinal int")
    got = {r.id: r for r in catalog.nested(nodes).collect()}
    ids = {r[0] for r in rows}
    assert set(got) == {i for i, up, _ in rows if up not in ids} and max(r.depth for r in got.values()) >= 24
    assert all(json.loads(r.tree) == plain_tree(rows, i) for i, r in got.items()) and sum(r.n_nodes for r in got.values()) == 90
    places = {r.id: r for r in catalog.numbered(nodes).collect()}
    for i, up, _ in rows:
        assert up not in ids or (places[up].preorder < places[i].preorder <= places[i].end <= places[up].end and places[i].depth == places[up].depth + 1)
    assert catalog.nested(nodes.limit(0)).collect() == []


def test_nesting_refuses_cycles(spark):
    for rows in ([("a", "b", 1), ("b", "a", 1)], [("s", "s", 1)], [("r", None, 0), ("c", "a", 1), ("a", "b", 1), ("b", "a", 1)]):
        nodes = spark.createDataFrame([(1, *r) for r in rows], "version_id int, id string, parent_id string, ordinal int")
        with pytest.raises(Exception, match="a cycle of parents"):
            catalog.nested(nodes).collect()


def test_vectors_that_are_not_finite_have_no_rank(spark):
    inf, nan = float("inf"), float("nan")
    docs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [inf, 1.0]), (3, [nan, 1.0]), (4, [0.0, 0.0]), (5, None), (6, [0.0, 1.0]), (7, [1.0])], "id long, embedding array<double>")
    rows = retrieval.vector_search(docs, {1: [1.0, 1.0], 2: [0.0, 0.0], 3: [inf, 1.0], 4: None})
    assert [(r.query_id, r.id, r.vector_rank) for r in rows.orderBy("query_id", "vector_rank").collect()] == [(1, 1, 1), (1, 6, 2)]


def test_lexical_hits_by_brute_force(spark):
    import random

    rng = random.Random(4)
    words = ["a", "b", "c", "d", "e", "zz"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 30)))) for i in range(60)] + [(99, None)]
    asked = [(1, "a"), (2, "a b"), (3, "c, d E zz"), (4, "none"), (5, ""), (6, "b b b")]
    hits = {(r.query_id, r.id): (r.n_lexemes, r.rank) for r in retrieval.lexical_hits(spark.createDataFrame(docs, "id long, text string").repartition(3), spark.createDataFrame(asked, "query_id long, query string")).collect()}
    want = {}
    for q, query in asked:
        own = set(query.lower().replace(",", " ").split())
        for i, t in docs:
            at = [(k, w) for k, w in enumerate((t or "").split()) if w in own]
            if own and len({w for _, w in at}) >= min(2, len(own)):
                rank = 0.1 * len(at) if len(own) == 1 else sum(0.1 / (b - a) for (a, x), (b, y) in zip(at, at[1:], strict=False) if x != y)
                want[q, i] = (len({w for _, w in at}), round(rank, 6))
    assert hits.keys() == want.keys() and all(hits[k] == pytest.approx(want[k]) for k in want)
    best = retrieval.lexical_search(spark.createDataFrame(docs, "id long, text string").repartition(3), spark.createDataFrame(asked, "query_id long, query string"), limit=3)
    top = {}
    for (q, i), (_, rank) in sorted(want.items(), key=lambda x: (x[0][0], -x[1][1], x[0][1])):
        top.setdefault(q, []).append(i)
    assert {(r.query_id, r.id, r.lexical_rank) for r in best.collect()} == {(q, i, k + 1) for q, its in top.items() for k, i in enumerate(its[:3])}


def test_deep_pages_are_read(spark):
    page = "<div>" * 3000 + "<p>x" + "</div>" * 3000
    assert html_units.element_counts(spark.createDataFrame([(1, page)], "page_id int, html string"), ["div", "p"]).first()[1:] == (3000, 1)


def test_snapshots_are_closed(spark):
    good = '{"status":"answered","answer":"a","conclusions":[],"alternativePaths":[],"uncertainties":[],"citedSources":[{"citationLabel":"art. 1"}],"clarificationQuestion":null}'
    bad = [good.replace('"answered"', '"other"'), good.replace('"answer":"a",', ""), good.replace('"uncertainties":[],', ""), good.replace('{"citationLabel":"art. 1"}', "{}"), "x", None]
    rows = spark.createDataFrame(list(enumerate([good, *bad])), "id int, result_snapshot string")
    assert [(r.id, r.status, r.n_sources, r.preview) for r in activity.list_rows(rows).collect()] == [(0, "answered", 1, "a")]
    assert [r.id for r in activity.recorded(rows.limit(0), rows).collect()] == [0]


def test_prepared_corpus(spark):
    """Acts that are only just inserted resolve the relations of the same run; a consolidated text becomes a revision once."""
    meta = spark.createDataFrame([("DU", 2000, 1, "base", "IN_FORCE"), ("DU", 2001, 2, "announcement", None)], "publisher string, year int, pos int, title string, inForce string")
    for c, kind in (("type", "string"), ("status", "string"), ("ELI", "string"), ("announcementDate", "string"), ("promulgation", "string"), ("entryIntoForce", "string"), ("validFrom", "string"), ("expirationDate", "string")):
        meta = meta.withColumn(c, F.lit(None).cast(kind))
    graph = [("DU/2000/1", '{"Inf. o tekście jednolitym": [{"act": {"publisher": "DU", "year": 2001, "pos": 2}}]}'), ("DU/2001/2", '{"Tekst jednolity dla aktu": [{"act": {"publisher": "DU", "year": 2000, "pos": 1}}]}')]
    references = spark.createDataFrame(graph, "legal_act_id string, json string")
    old_acts = spark.createDataFrame([("7", "DU/2000/1", "old title"), ("8", "DU/1999/9", "kept")], "id string, source_id string, title string")
    old_relations = spark.createDataFrame([], "legal_act_id string, relation_type string, related_source_id string, source_relation_type string, related_legal_act_id string, is_active boolean, discovered_at timestamp, refreshed_at timestamp")
    fields = "base string, announcement string, structural_path string, provision_type string, citation_label string, heading string, text string, article string, paragraph string, point string, letter string"
    parsed = spark.createDataFrame([("DU/2000/1", "DU/2001/2", f"p/{k}", "article", "art. 1", None, f"t{k}", "1", None, None, None) for k in range(3)] + [("DU/2000/1", "DU/1999/9", "p", "article", "x", None, "t", None, None, None, None)], fields)
    versions = spark.createDataFrame([], "legal_act_id string, source_announcement_legal_act_id string, content_hash string, id string")
    run = lambda v: ingest.prepared(meta, references, old_acts, old_relations, parsed, v, parsed, F.current_timestamp(), ["title"])
    out = run(versions)
    assert {r.source_id: r.action for r in out["acts"].collect()} == {"DU/2000/1": "updated", "DU/2001/2": "inserted", "DU/1999/9": "unchanged"}
    assert {r.related_source_id: r.related_legal_act_id for r in out["relations"].collect()} == {"DU/2001/2": "DU/2001/2", "DU/2000/1": "7"}
    assert {r.announcement: r.outcome for r in out["report"].collect()} == {"DU/2001/2": "inserted", "DU/1999/9": "not_mutual"}
    assert out["provisions"].count() == 3
    again = run(out["versions"].select(*versions.columns))
    assert {r.announcement: r.outcome for r in again["report"].collect()} == {"DU/2001/2": "reused", "DU/1999/9": "not_mutual"}
    assert again["provisions"].count() == again["versions"].count() == 0


def test_only_today(spark):
    row = lambda d: spark.range(1).select(currentlaw.only_today(F.lit(d).cast("date"), F.expr("timestamp '2024-05-06 07:08:09'")).alias("d"))
    assert str(row("2024-05-06").first().d) == "2024-05-06"
    with pytest.raises(Exception, match="only be made for today"):
        row("2024-05-07").collect()


def test_saved_admission(spark):
    rows = spark.createDataFrame([(1, "k", c, i) for i, c in enumerate("aabca")], "visitor_id int, kind string, content_key string, arrival int")
    assert [r.outcome for r in activity.admitted(rows, quota=2).orderBy("arrival").collect()] == ["saved", "already_saved", "saved", "quota_exceeded", "already_saved"]
    with pytest.raises(ValueError, match="positive"):
        activity.retained(rows, F.current_timestamp(), days=0)


def test_cache_lookup(spark):
    key = "question_hash string, corpus_run_id string, pipeline_version string, ruleset_version string, effective_as_of string, corpus_selection_hash string"
    asked = spark.createDataFrame([("q", "r", "p", "s", "d", "h"), ("q", "r", "p", "other", "d", "h")], key)
    cache = spark.createDataFrame([("q", "r", "p", "s", "d", "h", "answered", "x", ["v1"])], f"{key}, status string, answer_snapshot string, source_version_ids array<string>")
    scope = spark.createDataFrame([("r", ["v1", "v2"])], "corpus_run_id string, version_ids array<string>")
    assert [r.is_hit for r in answer_cache.looked_up(asked, cache, scope).orderBy("ruleset_version").collect()] == [False, True]


def test_label_prefix(spark):
    want = spark.createDataFrame([(1, "art. 5"), (1, "art. 6")], "question int, label string")
    got = spark.createDataFrame([(1, "art. 5 ust. 2"), (1, "art. 61")], "question int, label string")
    assert {(r.label, r.is_found) for r in evaluation.found_labels(want, got).collect()} == {("art. 5", True), ("art. 6", False)}


HTML = """<div class="parts"><section id="s1"><div class="part"><h2>Ustawa<a class="gloss-link">1) note</a></h2><div class="block">
<div class="unit unit_chpt" data-id="chpt_1"><h3><P>Rozdział 1</P><P class="pro-title-unit">Ogólne</P></h3><div class="unit-inner">
<div class="unit unit_arti" data-id="arti_5"><h3>Art. 5</h3><div class="unit-inner"><div data-template="xText">Tekst&nbsp; własny<a class="gloss-link">x</a>.</div>
<div class="unit unit_pint" data-id="pint_1"><div class="unit-inner"><div data-template="xText">punkt</div></div></div>
<div class="unit unit_zzz" data-id="z"><div class="unit-inner"><div class="unit unit_pint" data-id="pint_1"><div class="unit-inner"></div></div></div></div></div></div></div></div></div></div></section></div>"""


def test_html_units(spark):
    rows = html_units.units(spark.createDataFrame([(1, HTML), (2, None), (3, "<p>x")], "version_id int, html string")).orderBy("version_id", "ordinal").collect()
    assert [(r.provision_type, r.citation_label, r.text, r.structural_path) for r in rows] == [
        ("part", "Ustawa", "Ustawa", "s1"),
        ("chapter", "Rozdział 1 - Ogólne", "Rozdział 1 - Ogólne", "s1/chpt_1"),
        ("article", "art. 5", "Art. 5. Tekst własny.", "s1/chpt_1/arti_5"),
        ("point", "art. 5 pkt 1", "1) punkt", "s1/chpt_1/arti_5/pint_1"),
        ("point", "art. 5 pkt 1", "1)", "s1/chpt_1/arti_5/pint_1#5"),
    ]
    assert rows[3].parent_id == rows[2].id
    refused = html_units.units(spark.createDataFrame([(1, HTML)], "version_id int, html string"), annex=True).first()
    assert "0 sections" in refused.error


def test_pdf_units(spark):
    page = ["preface", "Załącznik do obwieszczenia", "Dział I", "2024-01-01", "Art. 43", "[9]", ". § 1. Firma nie mo-", "że być", "zbyta.", "1) raz", "a) lit"]
    size = [10, 10, 10, 10, 10, 6, 10, 10, 10, 10, 10]
    lines = spark.createDataFrame([(1, 1, i, float(s), t) for i, (s, t) in enumerate(zip(size, page, strict=True))] + [(2, 1, 0, 10.0, "none")], "version_id int, page int, line int, font_size double, text string")
    rows = pdf_lines.units(lines).where("error is null").orderBy("ordinal").collect()
    assert [(r.citation_label, r.text) for r in rows] == [("Dział I", "Dział I"), ("art. 43[9]", "Art. 43[9]."), ("art. 43[9] § 1", "§ 1. Firma nie może być zbyta."), ("art. 43[9] § 1 pkt 1", "1) raz"), ("art. 43[9] § 1 pkt 1 lit. a", "a) lit")]
    assert pdf_lines.units(lines).where("error is not null").count() == 1
    pieces = spark.createDataFrame([(1, 1, 0, 100.0, 10.0, 0.0, "a"), (1, 1, 1, 101.0, 10.0, 0.0, "b"), (1, 1, 2, 80.0, 3.0, 4.0, "c")], "document int, page int, position int, y double, a double, b double, text string")
    assert [(r.text, r.font_size) for r in pdf_lines.visual_lines(pieces).orderBy("line").collect()] == [("ab", 10.0), ("c", 5.0)]


def test_relations_from_json(spark):
    refs = '{"Akty zmieniające": [{"act": {"publisher": "DU", "year": 2020, "pos": 1}}, {"act": {"publisher": "DU", "year": 2020, "pos": 1}}], "Nowe": [{"act": {"publisher": "DU", "year": 2021, "pos": 2}}]}'
    rows = metadata.relations(spark.createDataFrame([(1, refs), (2, "{}")], "legal_act_id long, json string")).collect()
    assert {(r.relation_type, r.related_source_id, r.source_relation_type) for r in rows} == {("amending_act", "DU/2020/1", "Akty zmieniające"), ("unrecognized", "DU/2021/2", "Nowe")}


def test_packing_reads_requests_as_streams(spark):
    """A request's candidates are never one array, and its state goes on over batches."""
    n = 30000
    rows = spark.range(n).select(F.lit(1).alias("g"), (F.lit(n) - F.col("id")).alias("rank"), "id", F.when(F.col("id") % 7000 == 5, 100).otherwise(20000).alias("n_chars"))
    rows = rows.where("id < 29000").unionByName(spark.range(1).selectExpr("2 as g", "1L as rank", "7L as id", "50000 as n_chars"))
    out = answer.packed(rows, "g")
    assert "collect_list" not in out._jdf.queryExecution().toString()
    # the first one fills the budget; the other request's only candidate is taken
    assert [(r.g, r.id, r.source_no) for r in out.orderBy("g", "source_no").collect()] == [(1, 28999, 1), (2, 7, 1)]
    small = answer.packed(rows.where("n_chars = 100 and g = 1"), "g").orderBy("source_no").collect()
    assert [r.id for r in small] == [28005, 21005, 14005, 7005, 5]
    late = answer.packed(rows.where("g = 1 and (id < 28006)"), "g").orderBy("source_no").collect()
    assert [r.id for r in late] == [28005, 21005, 14005, 7005, 5]


def test_equal_newest_versions_are_decided_alike(spark):
    day = datetime.date(2020, 1, 1)
    acts = spark.createDataFrame([("a", True, None, None, None), ("x", True, day, None, None)], "id string, in_force boolean, promulgation_date date, expiration_date date, entry_into_force_date date")
    relations = spark.createDataFrame([("a", "consolidated_text_announcement", "x", True)], "legal_act_id string, relation_type string, related_legal_act_id string, is_active boolean")
    versions = [("v", "a", "consolidated", "tj", "authoritative", "x", structure, day, day) for structure in (True, False)]
    names = "id string, legal_act_id string, version_kind string, source_expression_id string, authority_class string, source_announcement_legal_act_id string, has_structure boolean, legal_state_date date, created_at date"
    for rows in (versions, versions[::-1]):
        decided = currentlaw.decided(currentlaw.candidates(acts, spark.createDataFrame(rows, names).coalesce(1), relations, F.expr("date '2024-01-01'")))
        assert [r.reason_code for r in decided.where("act = 'a'").collect()] == ["authoritative_current"]


def test_cache_lookup_of_large_scopes_joins_versions(spark):
    key = "question_hash string, corpus_run_id string, pipeline_version string, ruleset_version string, effective_as_of string, corpus_selection_hash string"
    packs = {"in": ["v1", "v2"], "out": ["v1", "v3"], "none": [], "null": ["v1", None], "run": ["v1"]}
    run = {"run": "unknown"}
    asked = spark.createDataFrame([(q, run.get(q, "r"), "p", "s", "d", "h") for q in packs], key)
    cache = spark.createDataFrame([(q, run.get(q, "r"), "p", "s", "d", "h", "answered", q, v) for q, v in packs.items()], f"{key}, status string, answer_snapshot string, source_version_ids array<string>")
    rows = spark.createDataFrame([("r", "v1"), ("r", "v2"), ("other", "v3")], "corpus_run_id string, version_id string")
    lists = rows.groupBy("corpus_run_id").agg(F.collect_list("version_id").alias("version_ids"))
    for scope in (rows, lists):
        looked = answer_cache.looked_up(asked, cache, scope)
        assert {r.question_hash: r.answer_snapshot for r in looked.collect()} == {q: q if q == "in" else None for q in packs}
        # no row carries a run's whole scope
        assert "array_contains" not in looked._jdf.queryExecution().optimizedPlan().toString()


def test_html_pieces_are_read_as_a_stream(spark):
    article = '<div class="unit unit_arti" data-id="arti_{0}"><h3>Art. {0}</h3><div class="unit-inner"><div data-template="xText">Tekst &amp; {0}</div></div></div>'
    pieces = ['<div class="parts"><section id="s1"><div class="part"><h2>Ustawa</h2><div class="block">', *(article.format(k) for k in range(3000)), "</div></div></section></div>"]
    seen = []
    rows = html_units.streamed(7, (seen.append(1) or x for x in pieces))
    assert [next(rows)["structural_path"] for _ in range(10)][-1] == "s1/arti_8"
    assert len(seen) == 10  # rows come before the rest is read
    want = [(r["structural_path"], r["text"], r["ordinal"], r["id"], r["parent_id"]) for r in html_units.parse("".join(pieces)).rows("7")]
    assert [(r["structural_path"], r["text"], r["ordinal"], r["id"], r["parent_id"]) for r in html_units.streamed(7, pieces)] == want
    frame = spark.createDataFrame([(k, i, x) for k in (7, None) for i, x in enumerate(pieces)], "version_id int, place int, html string").repartition(8)
    got = html_units.units_of_pieces(frame).orderBy("ordinal").select("version_id", "structural_path", "text", "ordinal", "id", "parent_id").collect()
    assert [tuple(r)[1:] for r in got if r.version_id == 7] == want
    assert sum(r.version_id is None for r in got) == len(want)


def test_html_streams_by_brute_force():
    rng = random.Random(5)
    tags = ["div", "section", "h2", "h3", "p", "li", "a", "br"]
    classes = ["parts", "part", "block", "unit unit_arti", "unit unit_pint", "unit unit_chpt", "unit", "unit-inner", "gloss-link", "block unit", "part block", ""]

    def tree(depth):
        out = []
        for _ in range(rng.randrange(4)):
            tag, cls = rng.choice(tags), rng.choice(classes)
            if depth and rng.random() < 0.4:
                out.append(f'<div class="unit unit_arti" data-id="arti_{rng.randrange(3)}"><h3>A</h3><div class="unit-inner">{tree(depth - 1)}</div></div>')
                continue
            out.append(f'<{tag} class="{cls}" data-id="x_{rng.randrange(3)}" data-template="xText">' + (tree(depth - 1) if depth else "t&lt;") + rng.choice([f"</{tag}>", f"</{tag}>", f"</{tag}>", "", "</div>"]))
        return "".join(out)

    found = 0
    for _ in range(2000):
        head = rng.choice(['<div class="parts"><section id="s"><div class="part">', '<div class="parts">', '<div class="parts"><section><div class="part"><h2>U</h2><div class="block">', ""])
        html = head + tree(3) + tree(4) + rng.choice(["", "</div></section>" + tree(3)])
        cut = sorted(rng.randrange(len(html) + 1) for _ in range(5))
        pieces = [html[a:b] for a, b in zip([0, *cut], [*cut, len(html)], strict=True)]
        want = html_units.parse(html).rows("k")
        assert [{k: v for k, v in r.items() if k not in ("key", "error")} for r in html_units.streamed("k", pieces)] == want
        found += len(want) > 2
    assert found > 200
