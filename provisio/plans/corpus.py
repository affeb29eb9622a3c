"""Merge, current-law, evidence, catalogue and activity queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provisio.functions import hashing, text
from provisio.functions.citation import parsed
from provisio.operators import activity, answer, answer_cache, catalog, currentlaw, merge
from provisio.plans.search import PER_QUERY_SQL, q04_vector_topk_per_query
from provisio.plans.views import ANNOUNCEMENTS_SQL, AS_OF, VERSIONS_SQL, announcements, table, versions
from provisio.sources import html_units, metadata, pdf_lines

_EDGE = "o_custkey as legal_act_id", "o_orderpriority as relation_type", "cast(o_orderkey as string) as related_source_id"


def q17_relation_snapshot_merge(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    then, now = F.lit("2024-01-01").cast("timestamp_ntz"), F.lit("2024-02-01").cast("timestamp_ntz")
    edge = [F.expr(e) for e in _EDGE]
    old = orders.where("o_orderdate < timestamp_ntz '1998-01-01'").select(
        *edge, F.lit("old label").alias("source_relation_type"), F.lit(None).cast("bigint").alias("related_legal_act_id"), F.expr("o_orderkey % 9 <> 0").alias("is_active"),
        then.alias("discovered_at"), then.alias("refreshed_at"),
    )
    new = orders.where("o_orderdate >= timestamp_ntz '1996-01-01'").select(*edge, F.lit("new label").alias("source_relation_type"))
    acts = orders.where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").cast("string").alias("source_id"))
    return merge.merged_relations(old, new, acts, now)


def q18_first_wins_dedup(spark: SparkSession, d: str) -> DataFrame:
    return merge.first_of(table(spark, d, "events"), ["user_id", "event_type"], "event_id", ["event_id", "value"])


def q19_latest_wins_dedup(spark: SparkSession, d: str) -> DataFrame:
    return merge.latest_of(table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"], ["event_id", "value"])


def q20_asof_applicable(spark: SparkSession, d: str) -> DataFrame:
    return currentlaw.applicable(announcements(spark, d), F.expr(AS_OF))


def q21_latest_announcement_closed(spark: SparkSession, d: str) -> DataFrame:
    return currentlaw.latest_announcement(announcements(spark, d))


def q22_version_representative(spark: SparkSession, d: str) -> DataFrame:
    return currentlaw.representatives(versions(spark, d)).select("act", "kind", "id", "structured", "n_backed")


def q23_display_version(spark: SparkSession, d: str) -> DataFrame:
    return currentlaw.display_version(versions(spark, d))


#: The ladder once more, for DuckDB alone: the first rung that has a reason names it.
LADDER_SQL = """coalesce(
    case when in_force is null or not in_force or act_expires <= as_of then 'act_not_in_force' end,
    if(n_chain < 1, 'no_official_consolidated_version', null),
    if(n_unresolved_chain >= 1, 'metadata_incomplete', null),
    case n_applicable when 1 then null when 0 then 'no_official_consolidated_version' else 'metadata_incomplete' end,
    if(n_versions >= 1 and n_well_formed < 1, 'metadata_incomplete', null),
    if(n_versions >= 1 and newest_structured is not null and newest_structured, null, 'latest_tj_content_unavailable'),
    if(n_amendment_unresolved >= 1, 'unresolved_temporal_effect', null), if(n_amendment_effective >= 1, 'effective_post_tj_amendment', null), if(n_correction >= 1, 'correction_unresolved', null),
    case when n_tribunal_unresolved >= 1 then 'unresolved_constitutional_tribunal_effect' when n_tribunal < 1 then null
         when state_date is not null and tribunal_date is not null and tribunal_date <= state_date then null else 'unresolved_constitutional_tribunal_effect' end,
    'authoritative_current')"""
_CANDIDATES_SQL = f"""
ann as ({ANNOUNCEMENTS_SQL}),
chain as (select act, count(*) as n_chain, count(*) filter (where announcement % 53 = 0) as n_unresolved_chain,
          count(*) filter (where promulgated <= {AS_OF} and (expires is null or expires > {AS_OF})) as n_applicable,
          max(case when promulgated <= {AS_OF} and (expires is null or expires > {AS_OF}) then announcement end) as announcement from ann group by act),
newest as (select l_orderkey, l_returnflag <> 'N' as newest_structured, cast(l_shipdate as date) as state_date from lineitem where l_linestatus = 'O'
           qualify row_number() over (partition by l_orderkey order by l_linenumber desc, l_partkey, l_suppkey) = 1),
lines as (select l_orderkey, count(*) as n_versions, count(*) filter (where l_linestatus = 'O') as n_well_formed, count(*) filter (where l_quantity = 1) as n_amendment_unresolved,
          count(*) filter (where l_quantity > 45 and l_shipdate <= {AS_OF}) as n_amendment_effective, count(*) filter (where l_tax >= 0.08) as n_correction,
          cast(max(l_shipdate) as date) as tribunal_date from lineitem group by l_orderkey),
candidates as (select c_custkey as act, c_acctbal >= 0 as in_force, cast(null as date) as act_expires, {AS_OF} as as_of, coalesce(n_chain, 0) as n_chain,
          coalesce(n_unresolved_chain, 0) as n_unresolved_chain, coalesce(n_applicable, 0) as n_applicable, coalesce(n_versions, 0) as n_versions, coalesce(n_well_formed, 0) as n_well_formed,
          newest_structured, state_date, tribunal_date, coalesce(n_amendment_unresolved, 0) as n_amendment_unresolved, coalesce(n_amendment_effective, 0) as n_amendment_effective,
          coalesce(n_correction, 0) as n_correction, 0 as n_tribunal_unresolved, coalesce(n_versions, 0) as n_tribunal, chain.announcement
          from customer left join chain on act = c_custkey left join lines on lines.l_orderkey = chain.announcement left join newest on newest.l_orderkey = chain.announcement),
decided as (select act, {LADDER_SQL} as reason_code, announcement from candidates)"""


def _decided(spark: SparkSession, d: str) -> DataFrame:
    """All acts at once: chain, applicable announcement, its versions and relations, then one ladder."""
    as_of, ann, line = F.expr(AS_OF), announcements(spark, d), table(spark, d, "lineitem")
    hit = currentlaw.applies(F.col("promulgated"), F.col("expires"), as_of)
    chain = ann.groupBy("act").agg(
        F.count("*").alias("n_chain"), F.count_if(F.col("announcement") % 53 == 0).alias("n_unresolved_chain"), F.count_if(hit).alias("n_applicable"), F.max(F.when(hit, F.col("announcement"))).alias("announcement")
    )
    newest = currentlaw.newest_well_formed(line, F.col("l_linestatus") == "O", ["l_orderkey"], [F.desc("l_linenumber"), F.asc("l_partkey"), F.asc("l_suppkey")])
    newest = newest.select(F.col("l_orderkey").alias("announcement"), F.expr("l_returnflag <> 'N'").alias("newest_structured"), F.col("l_shipdate").cast("date").alias("state_date"))
    lines = line.groupBy(F.col("l_orderkey").alias("announcement")).agg(
        F.count("*").alias("n_versions"), F.count_if(F.col("l_linestatus") == "O").alias("n_well_formed"), F.count_if(F.col("l_quantity") == 1).alias("n_amendment_unresolved"),
        F.count_if((F.col("l_quantity") > 45) & (F.col("l_shipdate") <= as_of)).alias("n_amendment_effective"), F.count_if(F.col("l_tax") >= 0.08).alias("n_correction"),
        F.max("l_shipdate").cast("date").alias("tribunal_date"),
    )
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("act"), (F.col("c_acctbal") >= 0).alias("in_force"), F.lit(None).cast("date").alias("act_expires"), as_of.alias("as_of"))
    rows = rows.join(chain, "act", "left").join(lines, "announcement", "left").join(newest, "announcement", "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("n_chain", "n_unresolved_chain", "n_applicable", "n_versions", "n_well_formed", "n_amendment_unresolved", "n_amendment_effective", "n_correction")}
    rows = rows.withColumns(zero).withColumns({"n_tribunal_unresolved": F.lit(0), "n_tribunal": F.col("n_versions")})
    rows = currentlaw.decided(rows)
    return rows.select("act", "reason_code", "decision", F.when(F.col("decision") == "included", F.col("announcement")).alias("version_id"))


def q24_decision_ladder(spark: SparkSession, d: str) -> DataFrame:
    return _decided(spark, d).drop("version_id")


def q25_reason_counts(spark: SparkSession, d: str) -> DataFrame:
    return currentlaw.run_summary(_decided(spark, d))


def q27_selection_hash(spark: SparkSession, d: str) -> DataFrame:
    """The run's digest over its rules, date, and every act's decision, reason and version."""
    return currentlaw.selection_hash(_decided(spark, d), "rules-1", "1998-01-01")


_LIKELIHOOD = "case conv_id % 3 when 0 then 'most_likely' when 1 then 'possible' else 'needs_more_information' end"


def _plan(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select(
        F.col("conv_id").alias("issue"), (F.col("turn") % 4 + 1).alias("target"), F.col("turn").alias("position"), F.expr(_LIKELIHOOD).alias("likelihood"), F.col("text").alias("query")
    )


def q28_plan_cap(spark: SparkSession, d: str) -> DataFrame:
    return answer.capped_plan(_plan(spark, d)).select("issue", "target", "position", "likelihood")


def q29_direct_target_backstop(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations")
    targets = turns.where("turn = 0").select(F.col("conv_id").alias("target"), "text")
    said = turns.where("conv_id % 4 = 0 or turn > 0").select(F.col("conv_id").alias("target"), F.concat(F.lit("  "), "text", F.lit(" ")).alias("query"))
    issues = turns.select((F.col("conv_id") * 100 + F.col("turn")).alias("issue"), F.col("turn").alias("position"), F.col("conv_id").alias("target"), F.expr("case when (conv_id + turn) % 3 = 0 then 'needs_more_information' else 'possible' end").alias("likelihood"))
    return answer.direct_targets(targets, said, issues).select("target", "issue", F.sha2("query", 256).alias("query_hash"))


def _hits(spark: SparkSession, d: str) -> DataFrame:
    return q04_vector_topk_per_query(spark, d).select(
        F.col("vec_id").alias("id"), F.expr("query_id div 100 % 2").alias("issue_no"), F.col("query_id").alias("query_no"), F.expr("query_id div 100 % 5").alias("target"),
        F.expr("case when query_id div 100 % 3 = 0 then 'most_likely' else 'possible' end").alias("likelihood"), F.round(1 / (60 + F.col("vector_rank")), 9).alias("score"), (F.col("vec_id") % 7 == 0).alias("is_exact"),
    )


_HITS_SQL = f"hits as (select vec_id as id, query_id // 100 % 2 as issue_no, query_id as query_no, query_id // 100 % 5 as target, case when query_id // 100 % 3 = 0 then 'most_likely' else 'possible' end as likelihood, round(1e0 / (60 + vector_rank), 9) as score, vec_id % 7 = 0 as is_exact from ({PER_QUERY_SQL}))"


def q30_provenance_collect(spark: SparkSession, d: str) -> DataFrame:
    rows = answer.with_provenance(_hits(spark, d))
    return rows.select("id", F.size("found_by").alias("n_found"), F.element_at("found_by", 1)["query_no"].alias("first_query"), F.array_join(F.col("targets").cast("array<string>"), ",").alias("targets"))


def q31_tier_weighted_rank(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of eight requests in their order."""
    rows = answer.tier_scores(_hits(spark, d), ["id"]).withColumns({"weighted": F.round("weighted", 8), "request": F.col("id") % 8})
    return rows.select("request", "id", "weighted", "any_exact", F.row_number().over(Window.partitionBy("request").orderBy(F.desc("any_exact"), F.desc("weighted"), "id")).alias("nth"))


def q32_greedy_pack(spark: SparkSession, d: str) -> DataFrame:
    """Each source's candidates are all its documents, ranked by a rule that has nothing to do with their sizes."""
    every = table(spark, d, "documents").select("source", F.expr("(doc_id * 7919) % 10007 * 1000000 + doc_id").alias("rank"), F.col("doc_id").alias("id"), F.col("n_chars").cast("int").alias("n_chars"))
    return answer.packed(every, "source").select("source", F.col("id").alias("doc_id"), "source_no")


def q33_target_reservation(spark: SparkSession, d: str) -> DataFrame:
    return answer.reserved(answer.tier_scores(_hits(spark, d), ["target", "id"]).withColumn("weighted", F.round("weighted", 8)))


_EXCERPT = "case when doc_id % 5 = 0 then 'no such words' when doc_id % 11 = 0 then ' ' else replace(substring(text, 10, 50), ' ', '  ') end"
_SOURCE = "case when doc_id % 7 = 0 then -doc_id - 1 else doc_id end"


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return answer.evidence_status(docs.select("doc_id", F.expr(_SOURCE).alias("source_id"), F.expr(_EXCERPT).alias("excerpt")), docs.select(F.col("doc_id").alias("source_id"), "text"))


def q34_evidence_verbatim(spark: SparkSession, d: str) -> DataFrame:
    return _evidence(spark, d).select("doc_id", "status")


_STATUS_SQL = f"""
evidence as (select doc_id, {_SOURCE} as source_id, {_EXCERPT} as excerpt from documents),
status as (select e.doc_id, case when d.doc_id is null then 'unknown_source' when trim(regexp_replace(excerpt, '\\s+', ' ', 'g')) = '' then 'empty'
           when contains(trim(regexp_replace(d.text, '\\s+', ' ', 'g')), trim(regexp_replace(excerpt, '\\s+', ' ', 'g'))) then 'verbatim' else 'not_found' end as status
           from evidence e left join documents d on e.source_id = d.doc_id)"""


def q35_target_coverage(spark: SparkSession, d: str) -> DataFrame:
    good = _evidence(spark, d).select((F.col("doc_id") % 1013).alias("target"), F.when(F.col("status") == "verbatim", "verified").otherwise("demoted").alias("outcome"))
    return answer.covered(table(spark, d, "documents").select((F.col("doc_id") % 1013).alias("target")).distinct(), good)


def q36_catalog_search(spark: SparkSession, d: str) -> DataFrame:
    found = catalog.listed(table(spark, d, "part"), "wid%t", columns=["p_name", "p_brand", "p_type"], order=["p_name", "p_partkey"], equal={"p_type": "PROMO"})
    return found.select("p_partkey", "p_name", "p_brand")


def q37_filter_options(spark: SparkSession, d: str) -> DataFrame:
    return catalog.options(table(spark, d, "part"), {"p_type": True, "p_brand": True, "p_size": False})


def q38_act_detail(spark: SparkSession, d: str) -> DataFrame:
    acts = table(spark, d, "orders").select(F.col("o_orderkey").alias("act"), F.col("o_orderpriority").alias("title"))
    line = table(spark, d, "lineitem")
    resources = line.select(F.col("l_orderkey").alias("act"), F.expr("case when l_returnflag <> 'N' then l_partkey end").alias("version"))
    return catalog.detail(acts, line.select(F.col("l_orderkey").alias("act")), resources, "act", "version")


def q39_history_list(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), "event_type", F.repeat("props", 30).alias("answer"))
    return activity.listed(rows, 500, activity.HISTORY_LISTED, F.expr("id % 13 <> 0")).select("id", "event_type", text.preview(F.col("answer")).alias("preview"))


_NOW = "timestamp_ntz '2024-01-30 12:00:00'"


def q40_history_buckets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(activity.bucket(F.col("ts"), F.expr(_NOW)).alias("bucket")).agg(F.count("*").alias("n"))


def q41_retention_and_cap(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("visitor_id"), F.col("ts").alias("created_at"))
    return activity.retained(rows, F.expr(_NOW), days=20, most=30).select("id", "visitor_id")


def q42_saved_dedup_quota(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.col("user_id").alias("visitor_id"), F.col("event_type").alias("kind"), F.floor("value").cast("string").alias("content_key"), F.col("event_id").alias("arrival"))
    return activity.admitted(rows, quota=20).select("arrival", "outcome")


def q43_cache_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", text.cache_key(F.col("text")).alias("question_hash"), hashing.content_key(F.lit("search"), text.query_form(F.col("text"))).alias("content_key"))


def q44_cache_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Customers ask; orders of the customers are the stored answers' sources, runs are the nations' scopes."""
    customer, orders = table(spark, d, "customer"), table(spark, d, "orders")
    scope = orders.where("o_orderkey % 10 <> 3").join(customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("corpus_run_id"), F.col("o_orderkey").alias("version_id"))
    cache = orders.groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("source_version_ids")).join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_custkey").alias("question_hash"), F.col("c_nationkey").alias("corpus_run_id"), F.lit("v1").alias("pipeline_version"), F.expr("case when c_custkey % 6 = 0 then 'r0' else 'r1' end").alias("ruleset_version"),
        F.lit("2024-01-30").alias("effective_as_of"), F.lit("h").alias("corpus_selection_hash"), F.expr("case when c_acctbal < 0 then 'insufficient_evidence' else 'answered' end").alias("status"),
        F.col("c_name").alias("answer_snapshot"), "source_version_ids",
    )
    asked = customer.select(F.col("c_custkey").alias("question_hash"), F.col("c_nationkey").alias("corpus_run_id"), F.lit("v1").alias("pipeline_version"), F.lit("r1").alias("ruleset_version"), F.lit("2024-01-30").alias("effective_as_of"), F.lit("h").alias("corpus_selection_hash"))
    return answer_cache.looked_up(asked, cache, scope).select("question_hash", "is_hit", "answer_snapshot")


def q45_html_units(spark: SparkSession, d: str) -> DataFrame:
    return html_units.element_counts(table(spark, d, "pages"), ["h1", "p", "li"])


def q46_paragraph_join(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.posexplode(F.split("text", "\n")).alias("line", "text"))
    rows = pdf_lines.joined_paragraphs(lines, "line = 0 or text rlike '^[A-Z]'")
    return rows.select(F.col("key").alias("doc_id"), "paragraph", F.sha2("text", 256).alias("text_hash"))


def q51_metadata_acts(spark: SparkSession, d: str) -> DataFrame:
    """Orders as metadata: ids, fallbacks of dates, the in-force flag."""
    rows = _metadata(spark, d)
    return metadata.acts(rows).select("source_id", "act_type", "entry_into_force_date", "in_force", "official_page_url")


def _metadata(spark: SparkSession, d: str) -> DataFrame:
    day = "case when o_orderkey % 4 = 0 then null else date_format(o_orderdate, 'yyyy-MM-dd') end"
    texts = "array(named_struct('fileName', concat('a b ', o_orderkey % 2, '.pdf'), 'type', ' t '), named_struct('fileName', 'a b 0.pdf', 'type', o_orderpriority), named_struct('fileName', concat('x', o_orderkey % 3, '.HTM'), 'type', ''))"
    return table(spark, d, "orders").selectExpr(
        "'DU' as publisher", "year(o_orderdate) as year", "cast(o_orderkey + 1 as int) as pos", "o_orderpriority as title", "nullif(o_orderstatus, 'O') as type", "cast(null as string) as status", "cast(null as string) as ELI",
        "cast(null as string) as announcementDate", "cast(null as string) as promulgation", f"{day} as entryIntoForce", "'2001-02-03' as validFrom", "cast(null as string) as legalStatusDate",
        "cast(null as string) as expirationDate", "cast(null as string) as changeDate", "case o_orderkey % 4 when 0 then 'in_force' when 1 then 'true' when 2 then 'REPEALED' end as inForce", "o_orderkey % 2 = 0 as textHTML", "true as textPDF",
        f"case when o_orderkey % 5 = 0 then null else {texts} end as texts",
    )


def q52_metadata_resources(spark: SparkSession, d: str) -> DataFrame:
    return metadata.resources(_metadata(spark, d)).drop("file_name")


def q53_citations_by_level(spark: SparkSession, d: str) -> DataFrame:
    """How many of the orders' citation strings name each set of levels."""
    marks = F.array(*(F.lit(m) for m in ("art. 3a", "§ 12", "ust. 4", "pkt 5", "lit. B")))
    s = F.array_join(F.transform(marks, lambda m, i: F.when(F.pmod(F.floor(F.col("o_orderkey") / F.pow(F.lit(2), i)), F.lit(2)) == 1, m).otherwise(F.lit("x"))), " ")
    rows = table(spark, d, "orders").select(s.alias("s"))
    return rows.select(*(c.alias(k) for k, c in parsed(F.col("s")).items())).groupBy("article", "paragraph", "point", "letter").agg(F.count("*").alias("n"))


QUERIES = {k: v for k, v in list(globals().items()) if k[0] == "q" and k[1:3].isdigit() and k != "q04_vector_topk_per_query"}
_APPLIES = f"promulgated <= {AS_OF} and (expires is null or expires > {AS_OF})"
_ONE = f"one as (select *, count(*) filter (where backed) over (partition by act) as n_backed, row_number() over (partition by act, kind order by backed desc, structured desc, official desc, state_date desc nulls last, id) as nth from ({VERSIONS_SQL}) qualify nth = 1)"
_FORM = "lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))"
_TIERS = "coalesce(max(case when likelihood = 'most_likely' then score end), 0e0) * 2 + coalesce(max(case when likelihood = 'possible' then score end), 0e0)"
_URL = "concat('https://api.sejm.gov.pl/eli/acts/DU/', year(o_orderdate), '/', o_orderkey + 1)"
_KINDS_IDS = ", ".join(f"max(id) filter (where kind = '{k}') as {k}_id, coalesce(bool_or(structured) filter (where kind = '{k}'), false) as {k}_structured" for k in ("promulgated", "consolidated", "unified"))
SQL = {
    "q17_relation_snapshot_merge": """with old as (select o_custkey as legal_act_id, o_orderpriority as relation_type, cast(o_orderkey as varchar) as related_source_id, o_orderkey % 9 <> 0 as is_active from orders where o_orderdate < timestamp '1998-01-01'),
        new as (select o_custkey as legal_act_id, o_orderpriority as relation_type, cast(o_orderkey as varchar) as related_source_id from orders where o_orderdate >= timestamp '1996-01-01')
        select coalesce(o.legal_act_id, n.legal_act_id) as legal_act_id, coalesce(o.relation_type, n.relation_type) as relation_type, coalesce(o.related_source_id, n.related_source_id) as related_source_id,
        case when n.legal_act_id is not null then 'new label' else 'old label' end as source_relation_type, case when n.legal_act_id is not null then a.o_orderkey end as related_legal_act_id, n.legal_act_id is not null as is_active,
        case when o.legal_act_id is not null then timestamp '2024-01-01' else timestamp '2024-02-01' end as discovered_at, case when n.legal_act_id is not null then timestamp '2024-02-01' else timestamp '2024-01-01' end as refreshed_at,
        case when n.legal_act_id is not null and o.legal_act_id is null then 'inserted' when n.legal_act_id is not null then 'updated' when o.is_active then 'deactivated' else 'unchanged' end as action
        from old o full join new n on o.legal_act_id = n.legal_act_id and o.relation_type = n.relation_type and o.related_source_id = n.related_source_id
        left join (select o_orderkey from orders where o_orderkey % 5 <> 0) a on cast(a.o_orderkey as varchar) = coalesce(o.related_source_id, n.related_source_id)""",
    "q18_first_wins_dedup": "select user_id, event_type, min(event_id) as event_id, arg_min(value, event_id) as value from events group by 1, 2",
    "q19_latest_wins_dedup": "select user_id, event_type, arg_max(event_id, {'a': ts, 'b': event_id}) as event_id, arg_max(value, {'a': ts, 'b': event_id}) as value from events group by 1, 2",
    "q20_asof_applicable": f"select act, count(*) filter (where {_APPLIES}) as n_applicable, case when count(*) filter (where {_APPLIES}) = 1 then max(case when {_APPLIES} then announcement end) end as announcement from ({ANNOUNCEMENTS_SQL}) group by act",
    "q21_latest_announcement_closed": f"select act, case when count(*) = count(promulgated) then arg_max(announcement, {{'a': promulgated, 'b': announcement}}) end as announcement from ({ANNOUNCEMENTS_SQL}) group by act",
    "q22_version_representative": f"with {_ONE} select act, kind, id, structured, n_backed from one",
    "q23_display_version": f"""with {_ONE}, wide as (select act, {_KINDS_IDS}, max(n_backed) as n_backed from one group by act),
        anyone as (select act, arg_min(id, {{'a': case when kind = 'unified' then 1 else 0 end, 'b': case kind when 'promulgated' then 1 when 'consolidated' then 2 else 3 end, 'c': id}}) as any_structured from ({VERSIONS_SQL}) where structured group by act),
        pref as (select *, coalesce(consolidated_id, promulgated_id) as authoritative, coalesce(unified_id, consolidated_id, promulgated_id) as retrieval,
          case when consolidated_id is not null then consolidated_structured else promulgated_structured end as a_ready,
          case when unified_id is not null then unified_structured when consolidated_id is not null then consolidated_structured else promulgated_structured end as r_ready from wide left join anyone using (act))
        select act, authoritative, retrieval, case when a_ready then authoritative when r_ready then retrieval else coalesce(any_structured, authoritative, retrieval) end as default_id,
        case when n_backed > 1 then 'several announcements' when a_ready then null when r_ready then 'authoritative version has no structure' when any_structured is not null then 'preferred versions have no structure' else 'no version has structure' end as warning from pref""",
    "q24_decision_ladder": f"with {_CANDIDATES_SQL} select act, reason_code, case when reason_code = 'authoritative_current' then 'included' else 'excluded' end as decision from decided",
    "q25_reason_counts": f"with {_CANDIDATES_SQL} select reason_code, count(*) as n from decided group by 1",
    "q27_selection_hash": f"""with {_CANDIDATES_SQL}, e as (select cast(act as varchar) as k, concat('{{"act":', act, ',"decision":"', case reason_code when 'authoritative_current' then 'included' else 'excluded' end, '","reason_code":"', reason_code, '","version_id":', case when reason_code = 'authoritative_current' then coalesce(cast(announcement as varchar), 'null') else 'null' end, '}}') as v from decided),
        a as (select left(sha256(k), 3) as p, sha256(string_agg(v, chr(10) order by k)) as h from e group by 1), b as (select left(p, 2) as p, sha256(string_agg(concat(p, ':', h), chr(10) order by p)) as h from a group by 1),
        c as (select left(p, 1) as p, sha256(string_agg(concat(p, ':', h), chr(10) order by p)) as h from b group by 1), root as (select sha256(string_agg(concat(p, ':', h), chr(10) order by p)) as h from c)
        select sha256(concat_ws(chr(10), 'rules-1', '1998-01-01', h)) as selection_hash from root""",
    "q28_plan_cap": f"select issue, target, position, likelihood from (select conv_id as issue, turn % 4 + 1 as target, turn as position, {_LIKELIHOOD} as likelihood, row_number() over (partition by conv_id, turn % 4 order by turn) as nth from conversations) where nth <= case likelihood when 'most_likely' then 3 when 'possible' then 1 else 0 end",
    "q29_direct_target_backstop": f"""with t as (select conv_id as target, text, {_FORM} as form from conversations where turn = 0), s as (select distinct conv_id as target, {_FORM} as form from conversations where conv_id % 4 = 0 or turn > 0),
        i as (select conv_id as target, arg_min(conv_id * 100 + turn, turn) as issue from conversations where (conv_id + turn) % 3 <> 0 group by 1)
        select t.target, i.issue, sha256(t.text) as query_hash from t join i on t.target = i.target where not exists (select 1 from s where s.target = t.target and s.form = t.form)""",
    "q30_provenance_collect": f"with {_HITS_SQL} select id, count(*) as n_found, arg_min(query_no, {{'a': issue_no, 'b': query_no}}) as first_query, array_to_string(list_sort(list(distinct target)), ',') as targets from hits group by id",
    "q31_tier_weighted_rank": f"with {_HITS_SQL}, t as (select id, round({_TIERS}, 8) as weighted, bool_or(is_exact) as any_exact from hits group by id) select id % 8 as request, *, row_number() over (partition by id % 8 order by any_exact desc, weighted desc, id) as nth from t",
    "q32_greedy_pack": """with recursive few as (select source, doc_id, n_chars, row_number() over (partition by source order by (doc_id * 7919) % 10007 * 1000000 + doc_id) as k
          from documents),
        pack as (select source, k, doc_id, true as taken, 1 as n, cast(n_chars as bigint) as used from few where k = 1
          union all select f.source, f.k, f.doc_id, p.n < 16 and p.used + f.n_chars <= 12000, p.n + case when p.n < 16 and p.used + f.n_chars <= 12000 then 1 else 0 end,
            p.used + case when p.n < 16 and p.used + f.n_chars <= 12000 then f.n_chars else 0 end from pack p join few f on f.source = p.source and f.k = p.k + 1)
        select source, doc_id, n as source_no from pack where taken""",
    "q33_target_reservation": f"with {_HITS_SQL}, t as (select target, id, round({_TIERS}, 8) as weighted, bool_or(is_exact) as any_exact, bool_or(likelihood = 'most_likely') as likely from hits group by 1, 2) select target, id from t where likely qualify row_number() over (partition by target order by any_exact desc, weighted desc, id) = 1",
    "q34_evidence_verbatim": f"with {_STATUS_SQL} select doc_id, status from status",
    "q35_target_coverage": f"with {_STATUS_SQL} select doc_id % 1013 as target, bool_or(status = 'verbatim') as is_covered from status group by 1",
    "q36_catalog_search": "select p_partkey, p_name, p_brand from part where p_type = 'PROMO' and (p_name ilike '%wid%t%' or p_brand ilike '%wid%t%' or p_type ilike '%wid%t%') order by p_name, p_partkey limit 200",
    "q37_filter_options": "select 'p_type' as column, p_type as value, row_number() over (order by p_type) as position from (select distinct p_type from part) union all select 'p_brand', p_brand, row_number() over (order by p_brand) from (select distinct p_brand from part) union all select 'p_size', cast(p_size as varchar), row_number() over (order by p_size desc) from (select distinct p_size from part)",
    "q38_act_detail": """with l as (select l_orderkey, count(*) as n, count(*) filter (where l_returnflag <> 'N') as r from lineitem group by 1)
        select o_orderkey as act, o_orderpriority as title, coalesce(n, 0) as n_versions, coalesce(r, 0) as n_resolved, coalesce(n - r, 0) as n_unresolved from orders left join l on l_orderkey = o_orderkey""",
    "q39_history_list": "select event_id as id, event_type, case when length(a) > 220 then concat(rtrim(substring(a, 1, 220)), '...') else a end as preview from (select *, repeat(props, 30) as a from events order by ts desc, event_id desc limit 100) where event_id % 13 <> 0",
    "q40_history_buckets": "select case when n <= 0 then 'today' when n = 1 then 'yesterday' when n <= 7 then 'this_week' else 'older' end as bucket, count(*) as n from (select date_diff('day', cast(ts as date), date '2024-01-30') as n from events) group by 1",
    "q41_retention_and_cap": "select event_id as id, user_id as visitor_id from events where ts >= timestamp '2024-01-10 12:00:00' qualify row_number() over (partition by user_id order by ts desc, event_id desc) <= 30",
    "q42_saved_dedup_quota": """with r as (select user_id, event_type, floor(value) as k, event_id, row_number() over (partition by user_id, event_type, floor(value) order by event_id) = 1 as fresh from events),
        n as (select *, sum(fresh::int) over (partition by user_id order by event_id) as nth from r), i as (select *, fresh and nth <= 20 as inside from n)
        select event_id as arrival, case when inside then 'saved' when max(inside::int) over (partition by user_id, event_type, k) = 1 then 'already_saved' else 'quota_exceeded' end as outcome from i""",
    "q43_cache_key": f"select conv_id, turn, sha256({_FORM.replace('text', 'nfkc')}) as question_hash, concat('search:', sha256({_FORM})) as content_key from (select *, text as nfkc from conversations)",
    "q44_cache_lookup": """with scope as (select c_nationkey as run, list(o_orderkey) as ids from orders join customer on o_custkey = c_custkey where o_orderkey % 10 <> 3 group by 1), c as (select o_custkey, list(o_orderkey) as sources from orders group by 1),
        j as (select *, coalesce(c_acctbal >= 0 and c_custkey % 6 <> 0 and list_has_all(ids, sources), false) as is_hit from customer left join c on o_custkey = c_custkey left join scope on run = c_nationkey)
        select c_custkey as question_hash, is_hit, case when is_hit then c_name end as answer_snapshot from j""",
    "q45_html_units": "select page_id, len(regexp_extract_all(html, '<h1[ >]')) as n_h1, len(regexp_extract_all(html, '<p[ >]')) as n_p, len(regexp_extract_all(html, '<li[ >]')) as n_li from pages",
    "q46_paragraph_join": """with l as (select doc_id, i, xs[i] as t from (select doc_id, xs, unnest(range(1, len(xs) + 1)) as i from (select doc_id, string_split(text, chr(10)) as xs from documents))),
        p as (select *, sum(case when i = 1 or regexp_matches(t, '^[A-Z]') then 1 else 0 end) over (partition by doc_id order by i) as paragraph from l)
        select doc_id, paragraph, sha256(string_agg(t, ' ' order by i)) as text_hash from p group by 1, 2""",
    "q51_metadata_acts": f"""select concat('DU/', year(o_orderdate), '/', o_orderkey + 1) as source_id, coalesce(nullif(o_orderstatus, 'O'), 'unknown') as act_type,
        case when o_orderkey % 4 = 0 then date '2001-02-03' else cast(o_orderdate as date) end as entry_into_force_date, case o_orderkey % 4 when 0 then true when 1 then true when 2 then false end as in_force, {_URL} as official_page_url from orders""",
    "q52_metadata_resources": f"""with r as (select concat('DU/', year(o_orderdate), '/', o_orderkey + 1) as source_id, {_URL} as base, o_orderkey as k, o_orderpriority as p from orders),
        t as (select source_id, concat(base, '/a%20b%20', k % 2, '.pdf') as source_url, 'T' as code, 'pdf' as kind from r where k % 5 <> 0 union all select source_id, concat(base, '/a%20b%200.pdf'), upper(trim(p)), 'pdf' from r where k % 5 <> 0
          union all select source_id, concat(base, '/x', k % 3, '.HTM'), 'UNKNOWN', 'html' from r where k % 5 <> 0 union all select source_id, concat(base, '/text.html'), 'UNKNOWN', 'html' from r where k % 5 = 0 and k % 2 = 0)
        select source_id, source_url, array_to_string(list_sort(list(distinct code)), ',') as source_type_codes, any_value(kind) as representation_type from t group by 1, 2""",
    "q53_citations_by_level": """with b as (select o_orderkey % 2 = 1 as a, (o_orderkey // 2) % 2 = 1 as s, (o_orderkey // 4) % 2 = 1 as u, (o_orderkey // 8) % 2 = 1 as p, (o_orderkey // 16) % 2 = 1 as l from orders)
        select case when a then '3a' when s and u then '12' end as article, case when a and s then '12' when a and u then '4' when a then null when s and u then '4' when s then '12' when u then '4' end as paragraph,
        case when p then '5' end as point, case when l then 'b' end as letter, count(*) as n from b group by 1, 2, 3, 4""",
}
