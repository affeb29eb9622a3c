"""Publication at once, digests that stand for all of a run, batches whose side writes may fail."""

import pytest
from pyspark.sql import functions as F

from provisio.operators import answer_cache, answering, currentlaw, publication
from provisio.streaming import merging


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), "id long, v string")


def ids(df):
    return sorted(r.id for r in df.collect())


def test_tables_become_current_together(spark, tmp_path):
    store = publication.Store(spark, f"file://{tmp_path}/s")
    assert store.table("a") is None and store.current().version == 0
    first = store.publish(store.current(), replaced={"a": frame(spark, (1, "x")), "b": frame(spark, (1, "y"))})
    second = store.publish(first, replaced={"a": frame(spark, (2, "x"))}, appended={"b": frame(spark, (3, "z"))})
    assert ids(store.table("a")) == [2] and ids(store.table("b")) == [1, 3]
    assert ids(store.table("a", first)) == [1] and ids(store.table("b", first)) == [1]  # an older reader sees its own version
    assert store.current() == second and second.version == 2


def test_a_crash_before_the_rename_changes_nothing(spark, tmp_path, monkeypatch):
    store = publication.Store(spark, f"file://{tmp_path}/s")
    held = store.publish(store.current(), replaced={"a": frame(spark, (1, "x"))})

    def stop(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(publication.Store, "_name", stop)
    with pytest.raises(KeyboardInterrupt):
        store.publish(held, replaced={"a": frame(spark, (2, "x"))}, appended={"b": frame(spark, (9, "y"))})
    monkeypatch.undo()
    again = publication.Store(spark, f"file://{tmp_path}/s")
    assert ids(again.table("a")) == [1] and again.table("b") is None
    again.publish(again.current(), appended={"b": frame(spark, (5, "y"))})
    assert ids(again.table("b")) == [5]


def test_of_two_writers_one_is_refused_and_tries_again(spark, tmp_path):
    one, two = (publication.Store(spark, f"file://{tmp_path}/s") for _ in range(2))
    seen = one.current()
    one.publish(seen, replaced={"a": frame(spark, (1, "x"))})
    with pytest.raises(publication.Conflict):
        two.publish(seen, replaced={"a": frame(spark, (2, "x"))})
    assert ids(one.table("a")) == [1]
    tries = []

    def made(now):
        if not tries:  # another writer comes in between
            one.publish(now, replaced={"a": frame(spark, (7, "x"))})
        tries.append(now.version)
        return {"replaced": {"a": two.table("a", two.current()).union(frame(spark, (8, "x")))}}

    two.change(made)
    assert tries == [1, 2] and ids(one.table("a")) == [7, 8]


def test_a_batch_that_is_sent_again_is_not_applied_again(spark, tmp_path):
    store = publication.Store(spark, f"file://{tmp_path}/s")
    for batch in (1, 2, 2, 1):
        store.change(lambda now: {"appended": {"a": frame(spark, (batch, "x"))}}, stream="s", batch=batch)  # noqa: B023
    assert ids(store.table("a")) == [1, 2] and store.current().version == 2
    store.change(lambda now: {"appended": {"a": frame(spark, (1, "y"))}}, stream="other", batch=1)
    assert ids(store.table("a")) == [1, 1, 2]


def test_a_stream_publishes_through_a_store(spark, tmp_path):
    store = publication.Store(spark, f"file://{tmp_path}/s")
    store.publish(store.current(), replaced={"a": frame(spark, (1, "x"))})
    run = merging(lambda: store.table("a"), lambda df: store.change(lambda now: {"replaced": {"a": df}}), lambda old, new: old.unionByName(new))
    run(spark.createDataFrame([(2, "y", "ok"), (3, "z", "failed")], "id long, v string, fetch_status string"), 0)
    assert ids(store.table("a")) == [1, 2]


def test_a_run_is_never_changed(spark, tmp_path):
    store = publication.Store(spark, f"file://{tmp_path}/s")
    run = lambda *r: spark.createDataFrame([(x,) for x in r], "run_id string")
    entries = lambda *e: spark.createDataFrame(list(e), "run_id string, act long, version_id string")
    publication.published_run(store, run("r1"), entries(("r1", 1, "a"), ("r1", 2, "b"), ("r9", 3, "c")))
    publication.published_run(store, run("r1", "r2"), entries(("r1", 1, "other"), ("r2", 1, "d")))
    assert {tuple(r) for r in store.table("entries").collect()} == {("r1", 1, "a"), ("r1", 2, "b"), ("r2", 1, "d")}
    assert sorted(r.run_id for r in store.table("runs").collect()) == ["r1", "r2"]


ENTRIES = [(i, "included" if i % 3 else "excluded", "authoritative_current" if i % 3 else "act_not_in_force", f"v{i}" if i % 3 else None) for i in range(40)]


def decisions(spark, rows):
    return spark.createDataFrame(rows, "act long, decision string, reason_code string, version_id string")


def digest(spark, rows, rules="s1", date="2024-01-01"):
    return currentlaw.selection_hash(decisions(spark, rows).repartition(3), rules, date).first().selection_hash


def test_a_run_digest_stands_for_every_field(spark):
    held = digest(spark, ENTRIES)
    assert digest(spark, ENTRIES[::-1]) == held
    act, decision, reason, version = ENTRIES[7]
    others = [(99, decision, reason, version), (act, "excluded", reason, version), (act, decision, "metadata_incomplete", version), (act, decision, reason, "v8"), (act, decision, reason, None)]
    changed = [digest(spark, [*ENTRIES[:7], o, *ENTRIES[8:]]) for o in others]
    changed += [digest(spark, ENTRIES, rules="s2"), digest(spark, ENTRIES, date="2024-01-02"), digest(spark, ENTRIES[1:]), digest(spark, [])]
    assert len({held, *changed}) == 1 + len(changed)


def test_changed_entries_are_found_by_descent(spark):
    new = [*ENTRIES[:5], (5, "included", "authoritative_current", "v5b"), *ENTRIES[6:-1], (77, "excluded", "metadata_incomplete", None)]
    found = {r.act: (r.was, r.now) for r in currentlaw.changed_entries(decisions(spark, ENTRIES), decisions(spark, new)).collect()}
    assert set(found) == {5, 39, 77} and found[39][1] is None and found[77][0] is None and "v5b" in found[5][1]
    tree = {r.prefix: r.n for r in currentlaw.hash_tree(decisions(spark, ENTRIES)).collect()}
    assert tree[""] == 40 and sum(n for p, n in tree.items() if len(p) == 3) == 40


KEY = "question_hash string, corpus_run_id string, pipeline_version string, ruleset_version string, effective_as_of string, corpus_selection_hash string"


def test_another_version_misses_the_cache(spark):
    scope = spark.createDataFrame([("r", ["v1", "v7"])], "corpus_run_id string, version_ids array<string>")
    was, now = digest(spark, ENTRIES), digest(spark, [*ENTRIES[:7], (7, "included", "authoritative_current", "v7b"), *ENTRIES[8:]])
    cache = spark.createDataFrame([("q", "r", "p", "s1", "d", was, "answered", "x", ["v1"])], f"{KEY}, status string, answer_snapshot string, source_version_ids array<string>")
    asked = spark.createDataFrame([("q", "r", "p", "s1", "d", h) for h in (was, now)], KEY)
    assert {r.corpus_selection_hash: r.is_hit for r in answer_cache.looked_up(asked, cache, scope).collect()} == {was: True, now: False}


def test_source_pack_hash_follows_provisions_and_labels(spark):
    import hashlib

    rows = [(1, 0, "b", "art. 2"), (1, 1, "a", 'art. "1"'), (2, 0, "a", 'art. "1"'), (2, 1, "b", "art. 2"), (3, 0, "a", "other"), (3, 1, "b", "art. 2")]
    got = {r.k: r.h for r in spark.createDataFrame(rows, "k int, source_no int, id string, label string").groupBy("k").agg(answer_cache.source_pack_hash().alias("h")).collect()}
    assert got[1] == got[2] != got[3]
    assert got[1] == hashlib.sha256(b'[{"legalProvisionId":"a","citationLabel":"art. \\"1\\""},{"legalProvisionId":"b","citationLabel":"art. 2"}]').hexdigest()


def test_side_writes_that_fail_take_no_answer_away(spark, tmp_path):
    run = ("r", "p", "s", "d", "h")
    asked = spark.createDataFrame([(1, "what is it?", *run), (2, "and that?", *run), (3, "x", *run), (4, "What  is it?", *run)], f"request long, query string, {KEY.split(', ', 1)[1]}")
    scope = spark.createDataFrame([("r", ["v1"])], "corpus_run_id string, version_ids array<string>")
    told = lambda q: q.selectExpr("request", "'answered' as status", "query as answer", "array(struct(request as id, 'l' as label, case when request = 2 then 'v2' else 'v1' end as version_id, 'd' as proven_as_of)) as sources")
    store, now = publication.Store(spark, f"file://{tmp_path}/s"), F.expr("timestamp_ntz '2024-01-01'")

    def broken(*_):
        raise OSError("full")

    outcomes = lambda rows: {r.request: r.outcome for r in rows.collect()}
    every, failed = answering.run_batch(asked, store, scope, told, now, 1, writers=dict.fromkeys(("cache", "hits", "history"), broken))
    assert outcomes(every) == {1: "answered", 2: "answered", 3: "invalid", 4: "answered"} and failed == dict.fromkeys(("cache", "hits", "history"), "OSError: full")
    assert store.current().version == 0
    every, failed = answering.run_batch(asked, store, scope, told, now, 1)
    assert not failed and outcomes(every)[1] == "answered"
    every, failed = answering.run_batch(asked, store, scope, told, now, 2)
    assert not failed and outcomes(every) == {1: "cached", 2: "answered", 3: "invalid", 4: "cached"}
    cache = store.table("cache").collect()
    assert len(cache) == 1 and cache[0].hit_count == 2 and cache[0].source_version_ids == ["v1"] and cache[0].last_hit_at is not None
    assert store.table("history").groupBy("batch").count().count() == 2 and store.table("history").count() == 6
