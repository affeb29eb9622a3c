"""A corpus prepared twice: what failed changes nothing, what is equal stays, and texts become revisions once."""

import pytest
from provisio import shared
from provisio.operators import preparation
from provisio.plans.views import ANNEX_SHOWN, pdf_of
from provisio.sources import fetching
from pyspark.sql import functions as F

HTML = '<div class="parts"><section id="s"><div class="part"><h2>Załącznik - Tekst jednolity</h2><div class="block"><div class="unit unit_arti" data-id="arti_1"><h3>Art. 1</h3><div class="unit-inner"><div data-template="xText">{}</div></div></div></div></div></section></div>'
BASE, TEXTS = "DU/1990/1", ["DU/2000/1", "DU/2000/2", "DU/2000/3", "DU/2000/4"]
OLD = {
    "acts": "id string, source_id string, title string",
    "versions": "id string, legal_act_id string, expression string, source_announcement_legal_act_id string, content_hash string, version_kind string, authority_class string, canonical_uri string, effective_from date, source_updated_at timestamp, currentness_status string, is_current boolean",
    "resources": "source_id string, source_url string, expression string, file_name string, source_type_codes string, representation_type string",
    "relations": "legal_act_id string, relation_type string, related_source_id string, source_relation_type string, related_legal_act_id string, is_active boolean, discovered_at timestamp, refreshed_at timestamp",
    "provisions": "id string, parent_id string, version_id string, provision_type string, citation_label string, heading string, text string",
    "documents": "id string, version_id string, content_hash string",
}


def service(failing=(), undated=()):
    """Acts' titles, and references that can fail."""

    def fetch(method, url):
        if url in failing or url.split("acts/")[-1] in failing:
            raise TimeoutError
        if "http" not in url:
            return fetching.Reply(200 if url.endswith("/ogl") else 404)
        path = url.split("acts/")[1]
        named = lambda i: '{"act": {"publisher": "DU", "year": %s, "pos": %s}}' % tuple(i.split("/")[1:])  # noqa: E731, UP031
        if path.endswith("/references"):
            act = path.removesuffix("/references")
            if act == BASE:
                return fetching.Reply(200, f'{{"Inf. o tekście jednolitym": [{", ".join(map(named, TEXTS))}], "Orzeczenie TK": [{named("DU/2020/9")}]}}')
            return fetching.Reply(200, f'{{"Tekst jednolity dla aktu": [{named(BASE)}], "Nowelizacje po tekście jednolitym": [{named("DU/2010/5")}]}}')
        publisher, year, pos = path.split("/")
        n = int(pos)
        day = "" if path in undated else f'"promulgation": "{year}-01-{n:02d}", '
        return fetching.Reply(200, f'{{"title": "act {path}", "publisher": "{publisher}", "year": {year}, "pos": {n}, {day}"textHTML": {str(n == 1).lower()}, "textPDF": {str(n in (2, 4)).lower()}}}')

    return fetch


@pytest.fixture(scope="module")
def world(spark):
    scope = spark.createDataFrame([(BASE,)], "source_id string")
    html = spark.createDataFrame([(TEXTS[0], HTML.format("Tekst."))], "announcement string, html string")
    # the last one's bytes are no PDF file
    pdf = spark.createDataFrame([(TEXTS[1], ANNEX_SHOWN + "0 -14 Td (Art. 1. A) Tj 0 -14 Td (Art. 2. B) Tj ET")], "announcement string, shown string").select("announcement", pdf_of("shown").alias("content"))
    pdf = pdf.unionByName(spark.createDataFrame([(TEXTS[3], b"x")], "announcement string, content binary"))

    def run(old, service, **how):
        replies = preparation.requested(scope, service, shared.cut)
        return {k: shared.cut(v, k) for k, v in preparation.prepared(scope, replies, html, pdf, old, F.lit("2024-01-01").cast("timestamp"), ["title"], kept=shared.cut, **how).items()}

    empty = {k: spark.createDataFrame([], v) for k, v in OLD.items()}
    return run, empty, run(empty, service())


def after(spark, made):
    """The tables that a run leaves, as the next one's old ones."""
    of = lambda k, **more: made[k].where("action <> 'deleted'").drop("action").withColumns(more)
    none = F.lit(None).cast("string")
    versions = of("expressions", id=F.concat_ws(":", "source_id", "expression"), content_hash=none, source_announcement_legal_act_id=none).withColumnRenamed("source_id", "legal_act_id")
    columns = [c.split()[0] for c in OLD["versions"].split(", ")]
    fields = made["versions"].withColumnsRenamed({"source_expression_id": "expression"})
    versions = versions.select(*columns).unionByName(fields.select("id", "legal_act_id", "expression", "source_announcement_legal_act_id", "content_hash", "version_kind", "authority_class", "currentness_status"), allowMissingColumns=True)
    # contents are hashed again, as a stored index would hold them
    from provisio.operators import indexing

    titles = made["versions"].select(F.col("id").alias("version_id"), F.lit("act DU/1990/1").alias("title"))
    documents = indexing.drafts(made["provisions"], titles).select("id", "version_id", "content_hash")
    return {"acts": of("acts", id=F.col("source_id")), "versions": versions, "resources": of("resources"), "relations": of("relations"), "provisions": made["provisions"], "documents": documents}


def told(rows, *columns):
    return {tuple(r[c] for c in columns[:-1]) if len(columns) > 2 else r[columns[0]]: r[columns[-1]] for r in rows.collect()}


def test_a_corpus_from_nothing(world):
    made = world[2]
    assert told(made["acts"], "source_id", "action") == dict.fromkeys([BASE, *TEXTS, "DU/2010/5", "DU/2020/9"], "inserted")
    relations = made["relations"].where(F.col("legal_act_id") == BASE)
    # targets of this run's own acts are resolved at once
    assert told(relations, "related_source_id", "related_legal_act_id") == {i: i for i in [*TEXTS, "DU/2020/9"]}
    assert told(made["report"], "announcement", "outcome") == {TEXTS[0]: "inserted", TEXTS[1]: "inserted", TEXTS[2]: "unavailable", TEXTS[3]: "empty"}
    assert told(made["report"], "announcement", "error") == {TEXTS[0]: None, TEXTS[1]: None, TEXTS[2]: None, TEXTS[3]: "not a PDF file"}
    assert {(r.source_id, r.expression) for r in made["expressions"].collect()} == {(i, "ogl") for i in [BASE, *TEXTS, "DU/2010/5", "DU/2020/9"]}
    assert made["resources"].where("file_name = 'ogl.eli'").count() == 7
    assert made["provisions"].where("provision_type = 'article'").count() == 3 and made["versions"].count() == 2
    assert [r.action for r in made["documents"].collect()] == ["embedded"] * 3


def test_a_second_run_changes_nothing(spark, world):
    run, _, first = world
    again = run(after(spark, first), service())
    for name in ("acts", "expressions", "resources", "documents"):
        assert {r.action for r in again[name].collect()} == {"unchanged"}, name
    assert told(again["report"], "announcement", "outcome") == {TEXTS[0]: "reused", TEXTS[1]: "reused", TEXTS[2]: "unavailable", TEXTS[3]: "empty"}
    assert again["versions"].count() == again["provisions"].count() == 0 and again["relations"].where("is_active").count() == first["relations"].count()


@pytest.mark.parametrize("failing", [f"{BASE}/references", BASE, f"{BASE}/tj"])
def test_an_act_that_failed_changes_nothing(spark, world, failing):
    run, _, first = world
    old = after(spark, first)
    again = run(old, service([failing]))
    relations = again["relations"].where(F.col("legal_act_id") == BASE)
    assert relations.where("is_active").count() == 5 and {r.action for r in relations.collect()} == {"unchanged"}
    for name in ("acts", "expressions", "resources"):
        assert told(again[name].where(F.col("source_id") == BASE), "source_id", "action") == {BASE: "unchanged"}, name
    assert again["report"].count() == 0 and again["versions"].count() == 0


def test_only_the_latest_announcement(world):
    run, empty, _ = world
    made = run(empty, service(), current_only=True)
    assert told(made["report"], "announcement", "choice") == {TEXTS[0]: "skipped", TEXTS[1]: "skipped", TEXTS[2]: "skipped", TEXTS[3]: "pdf"}
    for how in ({"undated": [TEXTS[1]]}, {"failing": [TEXTS[1]]}):
        made = run(empty, service(**how), current_only=True)
        assert {r.choice for r in made["report"].collect()} == {"unresolved"} and made["versions"].count() == 0
