"""Settings, arguments, and what is composed of several operators."""

import pytest
from pyspark.sql import functions as F

from provisio import config
from provisio.operators import catalog, currentlaw, indexing, pipeline
from provisio.sources import files, metadata
from provisio.streaming import merging


def test_settings_and_arguments():
    own = config.Settings.parse({"MIN_VECTOR_SIMILARITY": "0.5", "SAVED_QUOTA": "x", "CANDIDATES": "-3", "RESULTS": " "})
    assert own == config.Settings(min_vector_similarity=0.5)
    assert config.act_arguments(["du", "1964", "93"]) == ("DU", 1964, 93)
    for bad in (["d1", "1964", "93"], ["du", "1700", "93"], ["du", "1964", "0"]):
        with pytest.raises(SystemExit):
            config.act_arguments(bad)
    one = "00000000-0000-0000-0000-00000000000A"
    assert config.version_ids(f" {one} ,{one.lower()}") == [one.lower()]
    for bad in ("", " , ", f"{one},x"):
        with pytest.raises(ValueError, match="version id"):
            config.version_ids(bad)
    assert [config.backoff_ms(k) for k in (1, 2, 3, 4, 9)] == [1000, 2000, 4000, 8000, 8000]
    assert config.may_retry(429) and config.may_retry(None) and config.may_retry(503) and not config.may_retry(401)
    assert "secret" not in config.safe_message(ValueError("secret")) and config.safe_message(config.EngineError("TIMEOUT", "secret")) == config.MESSAGES["TIMEOUT"]


def test_metadata_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"publisher": "DU", "year": 1964, "pos": 93, "title": "t", "inForce": "IN_FORCE", "promulgation": "1964-04-23", "textHTML": true, "texts": [{"fileName": "a.pdf", "type": "T"}, {"fileName": "a.pdf", "type": " o "}]}')
    (tmp_path / "b.json").write_text('{"publisher": "DU", "year": 1964, "pos": 94, "title": "t", "promulgation": "1964-13-01"}')
    rows = metadata.read_metadata(spark, str(tmp_path)).cache()
    assert sorted((r.pos, r.is_valid) for r in rows.collect()) == [(93, True), (94, False)]
    good = rows.where("is_valid")
    assert metadata.acts(good).first().in_force is True
    assert {(r.file_name, r.source_type_codes, r.representation_type) for r in metadata.resources(good).collect()} == {("a.pdf", "O,T", "pdf"), ("text.html", "UNKNOWN", "html")}


def test_files_and_embedder(spark, tmp_path):
    (tmp_path / "x.pdf").write_bytes(b"1")
    (tmp_path / "y.pdf").write_bytes(b"2")
    wanted = spark.createDataFrame([("x.pdf", "O,T"), ("y.pdf", "O")], "file_name string, source_type_codes string")
    assert [bytes(r.content) for r in files.read_attachments(spark, str(tmp_path), wanted, skip_refused=True).collect()] == [b"1"]
    with pytest.raises(files.RefusedAttachment, match="y.pdf"):
        files.read_attachments(spark, str(tmp_path), wanted)
    texts = spark.createDataFrame([(i, "x" * i) for i in range(5)], "id long, content string")
    out = files.embedded(texts, lambda ts: [[float(len(t))] for t in ts], batch=2)
    assert {(r.id, r.embedding[0]) for r in out.collect()} == {(i, float(i)) for i in range(5)}
    assert files.is_healthy(spark)


def test_index_is_updated(spark):
    old = spark.createDataFrame([(1, "a", "h1", [1.0]), (2, "b", "h2", [2.0]), (3, "c", "h3", [3.0])], "id long, content string, content_hash string, embedding array<float>")
    new = spark.createDataFrame([(1, "a", "h1"), (2, "bb", "x"), (4, "d", "h4")], "id long, content string, content_hash string")
    out = indexing.updated(old, new, lambda t: t.select("id", F.array(F.lit(9.0).cast("float")).alias("embedding")))
    assert {(r.id, r.content, r.embedding[0]) for r in out.collect()} == {(1, "a", 1.0), (2, "bb", 9.0), (4, "d", 9.0)}


def test_hybrid_search_without_vectors(spark):
    docs = spark.createDataFrame([(1, "alpha beta", [1.0, 0.0]), (2, "gamma", [0.0, 1.0])], "id long, text string, embedding array<float>")
    asked = spark.createDataFrame([(1, "alpha beta")], "query_id long, query string")
    rows = pipeline.hybrid_search(docs, asked, None).collect()
    assert [(r.id, r.vector_skipped) for r in rows] == [(1, True)]
    rows = pipeline.hybrid_search(docs, asked, {1: [0.0, 1.0]}).orderBy("final_rank").collect()
    assert {r.id for r in rows} == {1, 2} and not rows[0].vector_skipped


def test_display_version(spark):
    schema = "act int, id string, kind string, backed boolean, structured boolean, official boolean, state_date date"
    rows = spark.createDataFrame([(1, "p", "promulgated", False, True, True, None), (1, "c", "consolidated", True, False, True, None), (1, "u", "unified", False, True, True, None), (2, "x", "unknown", False, False, False, None)], schema)
    out = {r.act: r for r in currentlaw.display_version(rows).collect()}
    assert (out[1].authoritative, out[1].retrieval, out[1].default_id) == ("c", "u", "u")
    assert (out[2].authoritative, out[2].default_id, out[2].warning) == (None, "x", "no version has structure")


def test_catalogue_wildcards_and_limit(spark):
    acts = spark.createDataFrame([(i, f"Act {i}", None if i % 2 else "x%") for i in range(300)], "id int, title string, kind string")
    assert catalog.listed(acts, columns=["title"], order=["title", "id"]).count() == 200
    assert [r.id for r in catalog.listed(acts, "act 2_9", columns=["title", "kind"], order=["id"]).collect()] == [209, 219, 229, 239, 249, 259, 269, 279, 289, 299]
    assert catalog.listed(acts, " ", columns=["title"], order=["id"], equal={"kind": "x%"}).count() == 150


def test_failed_fetches_are_not_empty_ones(spark):
    seen = []
    batch = spark.createDataFrame([(1, "ok"), (2, "failed")], "id int, fetch_status string")
    merging(lambda: spark.createDataFrame([(9,)], "id int"), lambda df: seen.extend(sorted(r.id for r in df.collect())), lambda old, new: old.unionByName(new))(batch, 0)
    assert seen == [1, 9]


def test_embedding_service_retries_and_sorts():
    class Failed(Exception):
        def __init__(self, status):
            self.status = status

    calls, waits = [], []

    def call(statuses):
        def one():
            calls.append(1)
            if statuses:
                raise Failed(statuses.pop(0))
            return "done"

        return one

    assert files.tried(call([429, 503]), wait=waits.append) == "done" and waits == [1.0, 2.0]
    for statuses in ([401], [500, 500, 500]):
        with pytest.raises(Failed):
            files.tried(call(statuses), wait=waits.append)
    with pytest.raises(ZeroDivisionError):
        files.tried(lambda: 1 // 0, wait=waits.append)
    assert files.in_order([(1, [2.0]), (0, [1.0])], 2) == [[1.0], [2.0]] and files.in_order([[3.0]], 1) == [[3.0]]
    for bad in ([(0, [1.0]), (0, [2.0])], [[1.0]]):
        with pytest.raises(ValueError, match="texts"):
            files.in_order(bad, 2)
