"""Queries over services' replies: a caller that answers from the address alone stands for the network."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provisio import shared
from provisio.operators import preparation, responses
from provisio.plans.views import ANNEX_SHOWN, pdf_of, table
from provisio.sources import fetching, metadata


def _number(url: str) -> int:
    return int(url.removesuffix("/references").rsplit("/", 1)[1])


def _act(method: str, url: str) -> fetching.Reply:
    """Some acts time out, are not found, refuse the connection, or answer what is no metadata."""
    n = _number(url)
    if n % 7 == 0:
        raise TimeoutError
    if n % 13 == 0:
        raise ConnectionResetError
    if n % 11 == 0:
        return fetching.Reply(404)
    if n % 5 == 0:
        return fetching.Reply(200, "<html>")
    title = "" if n % 3 == 0 else f'"title": "act {n}", '
    return fetching.Reply(200, f'{{{title}"publisher": "DU", "year": 2000, "pos": {n}, "promulgation": "2000-01-0{n % 9 + 1}"}}')


def _related(method: str, url: str) -> fetching.Reply:
    n = _number(url)
    if n % 7 == 0:
        return fetching.Reply(503)
    if n % 5 == 0:
        return fetching.Reply(200, "[]")
    entry = ", ".join(f'{{"act": {{"publisher": "DU", "year": 1999, "pos": {n + k}}}}}' for k in range(n % 3))
    return fetching.Reply(200, f'{{"Akty zmieniające": [{entry}]}}' if n % 3 else "{}")


def _expression(method: str, url: str) -> fetching.Reply:
    """HEAD is not supported for some, and some are not there."""
    act, kind = url.rsplit("/", 1)
    n = int(act.rsplit("/", 1)[1])
    if n % 7 == 0 and kind == "tj":
        raise TimeoutError
    if method == "HEAD" and n % 2 == 0:
        return fetching.Reply(405 if n % 4 else 501)
    return fetching.Reply(200 if (n + len(kind)) % 3 else 404)


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").selectExpr("'DU' as publisher", "2000 as year", "cast(o_orderkey as int) as pos")


def q120_fetched_metadata(spark: SparkSession, d: str) -> DataFrame:
    replies = fetching.fetched(fetching.requests(_orders(spark, d)), _act)
    return fetching.act_metadata(replies).select(F.col("asked.pos").alias("asked"), "http_status", "error", "title", F.to_date("promulgation").alias("promulgated"))


def q121_fetched_references(spark: SparkSession, d: str) -> DataFrame:
    """Failed, invalid, empty and filled replies, each told apart: relations are null, or counted."""
    told = fetching.act_references(fetching.fetched(fetching.requests(_orders(spark, d), references=True), _related)).select(F.col("asked.pos").cast("long").alias("legal_act_id"), "error", "json")
    found = metadata.relations(told).groupBy("legal_act_id").agg(F.count("*").alias("n"))
    n = F.when(F.col("error").isNull(), F.coalesce("n", F.lit(0)))
    return told.join(found, "legal_act_id", "left").select("legal_act_id", "error", n.alias("n"))


def q122_probed_expressions(spark: SparkSession, d: str) -> DataFrame:
    uris = _orders(spark, d).select("pos", F.explode(F.array(*map(F.lit, metadata.EXPRESSIONS))).alias("expression")).withColumn("uri", F.concat_ws("/", F.lit("DU/2000"), "pos", "expression"))
    return fetching.probed(uris, _expression).select("pos", "expression", "is_available", "error")


def q123_version_and_resource_drafts(spark: SparkSession, d: str) -> DataFrame:
    rows = fetching.act_metadata(fetching.fetched(fetching.requests(_orders(spark, d)), _act)).where("error is null")
    uris = rows.select(F.col("pos"), F.explode(F.array(*map(F.lit, metadata.EXPRESSIONS))).alias("expression")).withColumn("uri", F.concat_ws("/", F.lit("DU/2000"), "pos", "expression"))
    there = fetching.probed(uris, _expression).where("is_available")
    versions = metadata.version_drafts(rows, there).selectExpr("source_id", "'version' as part", "source_document_key as name", "concat_ws(' ', version_kind, authority_class, currentness_status, is_current) as told")
    files = metadata.resource_drafts(rows, there).selectExpr("source_id", "'resource' as part", "file_name as name", "concat_ws(' ', source_type_codes, representation_type, source_url) as told")
    return versions.unionByName(files)


def q124_detections(spark: SparkSession, d: str) -> DataFrame:
    """Envelopes of detections, each wrong in at most one place by its order's key."""
    told = """concat('{"summary":"', case when k % 5 = 0 then '' else 's' end, '","answerTargets":[', case when k % 7 = 0 then '' else '{"text":"a"},{"text":"b"}' end, '],"issues":[',
        case when k % 3 = 0 then '' else concat('{"label":"l","likelihood":"', case when k % 11 = 0 then 'certain' else 'possible' end, '","rationale":"r","answerTargetIndexes":[1],"retrievalQueries":[{"query":"q","answerTargetIndex":', k % 4, '}]}') end,
        ']', case when k % 2 = 0 then ',"clarificationQuestion":null' else '' end, case when k % 13 = 0 then ',"more":1' else '' end, '}')"""
    rows = table(spark, d, "orders").selectExpr("o_orderkey as k").selectExpr("k", f"{told} as told")
    sent = rows.select(F.col("k").alias("request"), F.to_json(F.struct(F.array(F.struct(F.struct(F.col("told").alias("content")).alias("message"), F.expr("case when k % 17 = 0 then 'length' else 'stop' end").alias("finish_reason"))).alias("choices"))).alias("json"))
    found = responses.completed(sent)
    return responses.detected(found).join(found.select("request", "error"), "request").select("request", "error", "is_valid", F.size("targets").alias("n_targets"), F.size("issues").alias("n_issues"), "clarification")


def q125_recoveries(spark: SparkSession, d: str) -> DataFrame:
    told = """concat('{"conclusions":[', case when k % 2 = 0 then concat('{"statement":"s","support":[{"sourceId":"S', k % 3, '","excerpt":"', case when k % 7 = 0 then '' else 'e' end, '"}],"answerTargetIndex":', case when k % 4 = 0 then 'null' else cast(k % 5 as string) end, '}') else '' end,
        '],"uncertainties":[', case when k % 11 = 0 then '""' else '"u"' end, ']}')"""
    rows = table(spark, d, "orders").selectExpr("o_orderkey as k").selectExpr("k as request", f"{told} as json")
    offered = rows.selectExpr("request", "array('S0', 'S1') as sources", "array(1L, 2L, 3L) as targets")
    return responses.recoveries(rows, offered).select("request", "is_valid", F.size("conclusions").alias("n"), F.element_at("uncertainties", 1).alias("doubt"))


def _corpus(method: str, url: str) -> fetching.Reply:
    """Acts of 1990 with up to two announcements of 2000, which name amendments of 2010; rulings are of 2020."""
    parts = url.removesuffix("/references").split("/")
    if "http" not in url:
        return fetching.Reply(200 if parts[-1] == ("tj" if parts[1] == "2000" else "ogl") else 404)
    year, n = int(parts[-2]), int(parts[-1])
    named = lambda year, pos: f'{{"act": {{"publisher": "DU", "year": {year}, "pos": {pos}}}}}'
    if not url.endswith("/references"):
        if (year, n % 17) == (1990, 0):
            raise ConnectionResetError
        if (year, n % 11) == (2000, 0):
            return fetching.Reply(404)
        return fetching.Reply(200, f'{{"title": "act {n}", "publisher": "DU", "year": {year}, "pos": {n}, "promulgation": "{year}-01-01", "textHTML": {str(n % 2 == 0).lower()}, "textPDF": {str(n % 9 > 0).lower()}}}')
    if (year, n % 13) == (1990, 0):
        raise TimeoutError
    if year == 1990:
        told = {"Inf. o tekście jednolitym": [named(2000, 10 * n + k) for k in range(n % 3)], "Orzeczenie TK": [named(2020, n)]}
    else:
        told = {"Tekst jednolity dla aktu": [named(1990, n // 10)] if n % 7 else [], "Nowelizacje po tekście jednolitym": [named(2010, n)]}
    return fetching.Reply(200, "{" + ", ".join(f'"{k}": [{", ".join(v)}]' for k, v in told.items()) + "}")


def q126_prepared_corpus(spark: SparkSession, d: str) -> DataFrame:
    """A corpus from nothing: customers are acts; texts of their announcements come as HTML or as the bytes of PDF files, and become revisions and documents to embed."""
    people = table(spark, d, "customer").select("c_custkey", "c_name")
    scope = people.select(F.concat(F.lit("DU/1990/"), F.col("c_custkey").cast("string")).alias("source_id"))
    texts = people.select(F.explode(F.expr("sequence(0, 1)")).alias("k"), "c_custkey", "c_name").withColumn("announcement", F.concat(F.lit("DU/2000/"), (10 * F.col("c_custkey") + F.col("k")).cast("string")))
    unit = """concat('<div class="parts"><section id="s"><div class="part"><h2>Załącznik - Tekst jednolity</h2><div class="block"><div class="unit unit_arti" data-id="arti_1"><h3>Art. 1</h3><div class="unit-inner"><div data-template="xText">', c_name, '</div></div></div></div></div></section></div>')"""
    html = texts.selectExpr("announcement", f"{unit} as html")
    shown = F.concat(F.lit(ANNEX_SHOWN + "0 -14 Td (Art. 1. "), "c_name", F.lit(") Tj 0 -14 Td (Art. 2. X) Tj ET"))
    pdf = texts.withColumn("shown", shown).select("announcement", pdf_of("shown").alias("content"))
    empty = lambda kind: spark.createDataFrame([], kind)
    versions = "id string, legal_act_id string, expression string, source_announcement_legal_act_id string, content_hash string, version_kind string, authority_class string, canonical_uri string, effective_from date, source_updated_at timestamp, currentness_status string, is_current boolean"
    old = {
        "acts": empty("id string, source_id string, title string"),
        "versions": empty(versions),
        "resources": empty("source_id string, source_url string, expression string, file_name string, source_type_codes string, representation_type string"),
        "relations": empty("legal_act_id string, relation_type string, related_source_id string, source_relation_type string, related_legal_act_id string, is_active boolean, discovered_at timestamp, refreshed_at timestamp"),
        "provisions": empty("id string, parent_id string, version_id string, provision_type string, citation_label string, heading string, text string"),
        "documents": empty("id string, version_id string, content_hash string"),
    }
    replies = preparation.requested(scope, _corpus, shared.cut)
    made = preparation.prepared(scope, replies, html, pdf, old, F.lit("2024-01-01").cast("timestamp"), ["title"], kept=shared.cut)
    n = made["documents"].where("action = 'embedded'").groupBy("version_id").agg(F.count("*").alias("n_documents"))
    return made["report"].join(n, "version_id", "left").select("base", "announcement", "choice", "outcome", F.col("version_id").isNotNull().alias("is_version"), "n_documents")


QUERIES = {k: v for k, v in list(globals().items()) if k[0] == "q" and k[1:3].isdigit()}
_ERROR = "case when k % 7 = 0 then 'TIMEOUT' when k % 13 = 0 or k % 11 = 0 then 'HTTP_ERROR' when k % 5 = 0 or k % 3 = 0 then 'INVALID_RESPONSE' end"
_THERE = """keys as (select cast(o_orderkey as integer) as k from orders), probe as (select k, e, case when k % 7 = 0 and e = 'tj' then null else (k + length(e)) % 3 <> 0 end as there from keys cross join (values ('ogl'), ('tj'), ('uj')) v(e))"""
_DETECTED = "k % 17 <> 0 and k % 5 <> 0 and k % 13 <> 0 and (k % 3 = 0 or (k % 7 <> 0 and k % 11 <> 0 and k % 4 in (1, 2)))"
_RECOVERED = "k % 11 <> 0 and (k % 2 = 1 or (k % 3 < 2 and k % 7 <> 0 and (k % 4 = 0 or k % 5 in (1, 2, 3))))"
SQL = {
    "q120_fetched_metadata": f"""with o as (select cast(o_orderkey as integer) as k from orders)
        select k as asked, case when k % 7 = 0 or k % 13 = 0 then null when k % 11 = 0 then 404 else 200 end as http_status, {_ERROR} as error, case when {_ERROR} is null then concat('act ', k) end as title,
        case when {_ERROR} is null then make_date(2000, 1, k % 9 + 1) end as promulgated from o""",
    "q121_fetched_references": """select o_orderkey as legal_act_id, case when o_orderkey % 7 = 0 then 'HTTP_ERROR' when o_orderkey % 5 = 0 then 'INVALID_RESPONSE' end as error,
        case when o_orderkey % 7 <> 0 and o_orderkey % 5 <> 0 then o_orderkey % 3 end as n from orders""",
    "q122_probed_expressions": f"with {_THERE} select k as pos, e as expression, there as is_available, case when there is null then 'TIMEOUT' end as error from probe",
    "q123_version_and_resource_drafts": f"""with {_THERE}, f as (select k, e, case e when 'ogl' then 'promulgated' when 'tj' then 'consolidated' else 'unified' end as kind from probe where there and {_ERROR} is null)
        select concat('DU/2000/', k) as source_id, 'version' as part, concat('expression:', e) as name, concat(kind, case when e = 'uj' then ' non_authoritative' else ' authoritative' end, ' unproven false') as told from f
        union all select concat('DU/2000/', k), 'resource', concat(e, '.eli'), concat('OFFICIAL_ELI_EXPRESSION eli_expression DU/2000/', k, '/', e) from f""",
    "q124_detections": f"""with o as (select o_orderkey as k from orders) select k as request, case when k % 17 = 0 then 'INVALID_RESPONSE' end as error, {_DETECTED} as is_valid,
        case when {_DETECTED} then case when k % 7 = 0 then 0 else 2 end end as n_targets, case when {_DETECTED} then case when k % 3 = 0 then 0 else 1 end end as n_issues, cast(null as varchar) as clarification from o""",
    "q126_prepared_corpus": """with a as (select c_custkey as c, 10 * c_custkey + k as n from customer cross join (values (0), (1)) v(k) where k < c_custkey % 3 and c_custkey % 13 <> 0 and c_custkey % 17 <> 0),
        t as (select *, case when n % 11 = 0 then 'failed' when n % 2 = 0 then 'html' when n % 9 > 0 then 'pdf' else 'unavailable' end as choice from a),
        o as (select *, case when choice not in ('html', 'pdf') then choice when n % 7 = 0 then 'not_mutual' else 'inserted' end as outcome from t)
        select concat('DU/1990/', c) as base, concat('DU/2000/', n) as announcement, choice, outcome, outcome = 'inserted' as is_version, case when outcome = 'inserted' then case choice when 'pdf' then 2 else 1 end end as n_documents from o""",
    "q125_recoveries": f"""with o as (select o_orderkey as k from orders) select k as request, {_RECOVERED} as is_valid, case when {_RECOVERED} then 1 - k % 2 end as n, case when {_RECOVERED} then 'u' end as doubt from o""",
}
