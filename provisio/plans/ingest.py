"""Ingest, lifecycle and composite queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provisio.functions import hashing, text
from provisio.operators import activity, answer, answering, catalog, currentlaw, evaluation, merge, pipeline
from provisio.plans.views import GEO_SQL, geo_tree, lexemes_sql, table, tokens_sql
from provisio.sources import metadata


def q54_act_upsert(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer")
    old = rows.where("c_custkey % 10 <> 1").selectExpr("c_custkey as id", "c_name as title", "case when c_custkey % 4 = 0 then null else c_mktsegment end as status")
    new = rows.where("c_custkey % 10 <> 2").selectExpr("c_custkey as id", "c_name as title", "c_mktsegment as status")
    return merge.merged(old, new, ["id"], ["title", "status"])


def q55_version_sync(spark: SparkSession, d: str) -> DataFrame:
    """Versions that an announcement backs take no part; the others are updated, inserted or deleted."""
    line = table(spark, d, "orders").selectExpr("o_custkey as act", "o_orderkey as expression", "o_orderpriority as state", "case when o_orderkey % 3 = 0 then o_orderkey end as source_announcement_legal_act_id")
    new = table(spark, d, "orders").where("o_orderkey % 7 <> 0").selectExpr("o_custkey as act", "o_orderkey as expression", "case when o_orderkey % 5 = 0 then 'changed' else o_orderpriority end as state")
    return merge.merged_versions(line, new, ["act", "expression"], ["state"])


def q56_resource_sync(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pages").selectExpr("page_id % 7 as act", "url", "length(html) as size")
    gone = table(spark, d, "pages").where("page_id % 3 = 0").selectExpr("page_id % 7 as act", "concat(url, '?old') as url", "0 as size")
    merged = merge.merged(rows.where("size % 2 = 0").unionByName(gone), rows, ["act", "url"], ["size"])
    return merged.groupBy("act", "action").agg(F.count("*").alias("n"))


def q57_replaced_provisions(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem").selectExpr("cast(l_linenumber as string) as version_id", "l_orderkey as ordinal")
    new = table(spark, d, "orders").selectExpr("'3' as version_id", "o_orderkey as ordinal")
    return merge.replaced_provisions(line, new, "3", allow_shrink=True).groupBy("version_id").agg(F.count("*").alias("n"), F.sum("ordinal").alias("total"))


def q58_find_or_create_revision(spark: SparkSession, d: str) -> DataFrame:
    """Revisions whose act, announcement and content are new."""
    have = table(spark, d, "lineitem").where("l_linestatus = 'O'").selectExpr("l_orderkey as act", "l_partkey as announcement", "l_returnflag as content_hash")
    new = table(spark, d, "lineitem").selectExpr("l_orderkey as act", "l_partkey as announcement", "l_returnflag as content_hash")
    return merge.appended_once(have, new, ["act", "announcement", "content_hash"])


def q59_unique_paths(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").selectExpr("user_id as version_id", "concat(event_type, '/', cast(floor(value) as bigint)) as structural_path", "event_id as ordinal")
    return merge.with_unique_paths(rows)


def q60_public_view(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "orders").selectExpr("case when o_orderstatus = 'F' then 'verified' else 'demoted' end as outcome", "array(cast(o_custkey as string)) as support")
    sources = table(spark, d, "customer").selectExpr("cast(c_custkey as string) as source_id", "c_name as label", "c_custkey as version_id", "c_custkey as provision_id")
    return pipeline.public_view(done, sources)


def q61_history_clear(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").selectExpr("event_id as id", "user_id as visitor_id", "ts as created_at")
    left = activity.cleared(rows, 3, F.expr("timestamp_ntz '2024-01-05'"), F.expr("timestamp_ntz '2024-01-20'"))
    return left.groupBy("visitor_id").agg(F.count("*").alias("n"))


def q62_folder_admission(spark: SparkSession, d: str) -> DataFrame:
    name = "case when event_id % 17 = 0 then ' ' when event_id % 2 = 0 then upper(concat(event_type, cast(floor(value) as bigint) % 9)) else concat(' ', event_type, cast(floor(value) as bigint) % 9) end"
    rows = table(spark, d, "events").selectExpr("user_id as visitor_id", f"{name} as name", "event_id as arrival")
    return activity.folders_admitted(rows, quota=15).select("arrival", "outcome")


def q63_saved_list(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").selectExpr("event_id as id", "ts as created_at", "event_type as kind", "props as title", "user_id % 3 as folder_id")
    return activity.saved_list(rows, kind="click", folder=1, term="K\": 1").select("id", "kind")


def q64_mutual_references(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders")
    there = rows.where("o_orderkey % 3 <> 0").selectExpr("cast(o_custkey as string) as legal_act_id", "'consolidated_text_announcement' as relation_type", "concat('o', o_orderkey) as related_source_id")
    back = rows.where("o_orderkey % 5 <> 0").selectExpr("concat('o', o_orderkey) as legal_act_id", "'consolidated_text_for_act' as relation_type", "cast(o_custkey as string) as related_source_id")
    return metadata.mutually_referenced(there.unionByName(back))


def q65_reachable_expressions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").selectExpr("'DU' as publisher", "year(o_orderdate) as year", "cast(o_orderkey as int) + 1 as pos", "cast(null as string) as ELI")
    up = rows.selectExpr("concat('DU/', year, '/', pos, '/', case pos % 3 when 0 then 'ogl' when 1 then 'tj' else 'uj' end) as uri")
    return metadata.expressions(rows, up)


def q69_caveats(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").selectExpr("o_custkey as request", "case when o_orderkey % 9 <> 0 then o_orderdate end as proven_as_of", "case when o_orderkey % 11 = 0 then 'unknown' else 'authoritative' end as authority_class")
    return answer.caveats(rows)


def q70_quality_report(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").selectExpr(
        "case when o_orderstatus = 'F' then 'answered' else 'insufficient_evidence' end as status", "case when o_orderkey % 2 = 0 then 'answered' end as expected_status",
        "o_orderkey % 17 as n_sources", "cast(o_totalprice as bigint) as n_chars", "cast(o_orderkey % 101 = 0 as int) as n_leaks",
    )
    return evaluation.quality(rows).withColumn("mean_sources", F.round("mean_sources", 6))


def q71_latest_usable_run(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "customer").selectExpr("c_custkey as run_id", "c_acctbal as generated_at")
    entries = table(spark, d, "orders").selectExpr("o_custkey as run_id", "case when o_orderstatus = 'O' then 'included' else 'excluded' end as decision", "o_orderkey % 50 = 0 as runtime_ready")
    return currentlaw.latest_usable_run(runs, entries)


def q72_parsed_content_hash(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").selectExpr(
        "o_custkey as version_id", "concat('p/', o_orderkey) as structural_path", "'article' as provision_type", "o_orderpriority as citation_label", "o_orderstatus as heading", "cast(o_orderkey as string) as text",
        "cast(o_orderkey % 100 as string) as article", "cast(null as string) as paragraph", "cast(null as string) as point", "cast(null as string) as letter",
    )
    return rows.groupBy("version_id").agg(hashing.parsed_content_hash().alias("content_hash"))


def q73_latest_revisions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").selectExpr("o_custkey as legal_act_id", "case when o_orderkey % 4 = 0 then null else o_orderpriority end as source_announcement_legal_act_id", "o_orderdate as created_at", "o_orderkey as id")
    return merge.latest_revisions(rows).select("legal_act_id", "source_announcement_legal_act_id", "id")


def q74_retrieval_signals(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "lineitem").selectExpr("l_orderkey % 5000 as target", "l_partkey as id", "l_discount as score", "l_quantity = 3 as is_backstop")
    return answer.retrieval_signals(spark.range(5100).select(F.col("id").alias("target")), hits)


def _hybrid(spark: SparkSession, d: str) -> DataFrame:
    """Every benchmark item with its whole text, and every vector whose id is divisible by 100."""
    vectors = table(spark, d, "embeddings")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text").join(vectors.select(F.col("vec_id").alias("id"), "embedding"), "id", "left")
    asked = {r["vec_id"]: r["embedding"] for r in vectors.where("vec_id % 100 = 0").collect()}
    return pipeline.hybrid_search(docs, table(spark, d, "benchmark").select(F.col("item_id").cast("long").alias("query_id"), F.col("text").alias("query")), asked)


def q75_hybrid_many_queries(spark: SparkSession, d: str) -> DataFrame:
    return _hybrid(spark, d).select("query_id", "id", "lexical_rank", "vector_rank", "score", "final_rank")


def q76_investigation_packed(spark: SparkSession, d: str) -> DataFrame:
    """Plan, hits, provenance and packing of all queries, in four requests of three targets each; many targets share their best candidate."""
    ids = table(spark, d, "benchmark").select(F.col("item_id").cast("long").alias("query_id")).union(table(spark, d, "embeddings").where("vec_id % 100 = 0").select("vec_id")).distinct()
    plan = ids.selectExpr("query_id", "query_id % 4 as request", "query_id % 2 as issue_no", "query_id as query_no", "query_id div 4 % 3 as target", "case when query_id % 5 <> 0 then 'most_likely' else 'possible' end as likelihood")
    hits = pipeline.investigation(plan, _hybrid(spark, d))
    sources = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.concat(F.lit("art. "), F.col("doc_id").cast("string")).alias("label"))
    sources = sources.select("id", "label", text.utf16_length(F.col("text")).alias("n_chars"))
    return answering.packed_for_targets(hits, sources).select("request", "id", "source_no", "reserved_for")


_HYBRID = f"""tok as ({tokens_sql()}),
asked as (select item_id as query_id, {lexemes_sql("text")} as toks from benchmark),
q as (select query_id, unnest(list_distinct(toks)) as tok, len(list_distinct(toks)) as n from asked),
hits as (select query_id, id, n, t.tok, pos, lag(t.tok) over w as before, pos - lag(pos) over w as gap from tok t join q on t.tok = q.tok window w as (partition by query_id, id order by pos)),
scored as (select query_id, id, n, count(distinct tok) as k, round(sum(case when n = 1 then 0.1e0 when before <> tok then 0.1e0 / gap else 0e0 end), 6) as rank from hits group by 1, 2, 3),
lexical as (select query_id, id, row_number() over (partition by query_id order by rank desc, id) as lexical_rank from scored where k >= least(2, n) qualify lexical_rank <= 30),
sims as (select q.vec_id as query_id, e.vec_id as id, list_cosine_similarity(cast(e.embedding as double[]), cast(q.embedding as double[])) as s from embeddings e join documents on doc_id = e.vec_id, (select vec_id, embedding from embeddings where vec_id % 100 = 0) q),
vector as (select query_id, id, s, row_number() over (partition by query_id order by round(s, 12) desc, id) as vector_rank from sims qualify vector_rank <= 30),
fused as (select coalesce(l.query_id, v.query_id) as query_id, coalesce(l.id, v.id) as id, lexical_rank, vector_rank, s, round(coalesce(1e0 / (60 + lexical_rank), 0e0) + coalesce(1e0 / (60 + vector_rank), 0e0), 9) as score
          from lexical l full join vector v on l.query_id = v.query_id and l.id = v.id),
final as (select *, row_number() over (partition by query_id order by score desc, lexical_rank nulls last, vector_rank nulls last, id) as final_rank from fused where lexical_rank is not null or s >= 0.35 qualify final_rank <= 10)"""


def q77_citations_of_many_queries(spark: SparkSession, d: str) -> DataFrame:
    """Citations as queries against the tree; labels of the tree are made into numbers."""
    nodes = geo_tree(spark, d)
    number = F.substring("id", 2, 20)
    own = lambda kind, c: F.when(F.col("provision_type") == kind, c)
    nodes = nodes.select("id", "parent_id", "provision_type", own("article", number).alias("article"), own("clause", F.pmod(number.cast("int"), F.lit(4)).cast("string")).alias("paragraph"), own("point", F.pmod(number.cast("int"), F.lit(3)).cast("string")).alias("point"), F.lit(None).cast("string").alias("letter"))
    asked = spark.createDataFrame([(1, "art. 3 ust. 2 pkt 1"), (2, "art. 7 pkt 2"), (3, "art. 4 ust. 9"), (4, "ust. 1"), (5, "art. 12"), (6, "nothing here")], "query_id long, query string")
    return pipeline.exact_matches(nodes, asked)


def q78_contexts_indexed(spark: SparkSession, d: str) -> DataFrame:
    """Searchable units with their context as they are indexed."""
    from provisio.operators import indexing

    nodes = geo_tree(spark, d).select("id", "parent_id", "provision_type", F.col("label").alias("citation_label"), F.col("label").alias("heading"), "text", F.lit(1).alias("version_id"))
    titles = spark.range(1).select(F.lit(1).alias("version_id"), F.lit("World").alias("title"))
    return indexing.drafts(nodes, titles).select("id", "content_hash")


def q79_provision_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").selectExpr("l_suppkey as version_id", "l_orderkey as id")
    return catalog.provision_counts(rows)


_TIER = "coalesce(max(score) filter (where l = 'most_likely'), 0e0) * 2 + coalesce(max(score) filter (where l = 'possible'), 0e0)"
QUERIES = {k: v for k, v in list(globals().items()) if k[0] == "q" and k[1:3].isdigit()}
_NUM = "cast(substring(id, 2) as int)"
SQL = {
    "q54_act_upsert": """with o as (select c_custkey as id, c_name as title, case when c_custkey % 4 = 0 then null else c_mktsegment end as status from customer where c_custkey % 10 <> 1), n as (select c_custkey as id, c_name as title, c_mktsegment as status from customer where c_custkey % 10 <> 2)
        select coalesce(o.id, n.id) as id, case when n.id is null then o.title else n.title end as title, case when n.id is null then o.status else n.status end as status,
        case when o.id is null then 'inserted' when n.id is null then 'deleted' when o.title is not distinct from n.title and o.status is not distinct from n.status then 'unchanged' else 'updated' end as action from o full join n on o.id = n.id""",
    "q55_version_sync": """with o as (select o_custkey as act, o_orderkey as expression, o_orderpriority as state from orders where o_orderkey % 3 <> 0), n as (select o_custkey as act, o_orderkey as expression, case when o_orderkey % 5 = 0 then 'changed' else o_orderpriority end as state from orders where o_orderkey % 7 <> 0)
        select coalesce(o.act, n.act) as act, coalesce(o.expression, n.expression) as expression, coalesce(n.state, o.state) as state, case when o.act is null then 'inserted' when n.act is null then 'deleted' when o.state = n.state then 'unchanged' else 'updated' end as action
        from o full join n on o.act = n.act and o.expression = n.expression""",
    "q56_resource_sync": """with r as (select page_id % 7 as act, url, length(html) as size from pages), o as (select * from r where size % 2 = 0 union all select page_id % 7, concat(url, '?old'), 0 from pages where page_id % 3 = 0)
        select coalesce(o.act, r.act) as act, case when o.url is null then 'inserted' when r.url is null then 'deleted' when o.size = r.size then 'unchanged' else 'updated' end as action, count(*) as n from o full join r on o.act = r.act and o.url = r.url group by 1, 2""",
    "q57_replaced_provisions": "select version_id, count(*) as n, cast(sum(ordinal) as bigint) as total from (select cast(l_linenumber as varchar) as version_id, l_orderkey as ordinal from lineitem where l_linenumber <> 3 union all select '3', o_orderkey from orders) group by 1",
    "q58_find_or_create_revision": "select distinct l_orderkey as act, l_partkey as announcement, l_returnflag as content_hash from lineitem a where not exists (select 1 from lineitem b where b.l_linestatus = 'O' and a.l_orderkey = b.l_orderkey and a.l_partkey = b.l_partkey and a.l_returnflag = b.l_returnflag)",
    "q59_unique_paths": "with r as (select user_id as version_id, concat(event_type, '/', cast(floor(value) as bigint)) as p, event_id as ordinal from events) select version_id, case when row_number() over (partition by version_id, p order by ordinal) > 1 then concat(p, '#', ordinal) else p end as structural_path, ordinal from r",
    "q60_public_view": "select cast(c_custkey as varchar) as source_id, c_name as label from customer where c_custkey in (select o_custkey from orders where o_orderstatus = 'F')",
    "q61_history_clear": "select user_id as visitor_id, count(*) as n from events where not (user_id = 3 and ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-20') group by 1",
    "q62_folder_admission": """with r as (select user_id, event_id, lower(trim(case when event_id % 17 = 0 then ' ' when event_id % 2 = 0 then upper(concat(event_type, cast(floor(value) as bigint) % 9)) else concat(' ', event_type, cast(floor(value) as bigint) % 9) end)) as k from events),
        f as (select *, row_number() over (partition by user_id, k order by event_id) = 1 as fresh from r where length(k) between 1 and 80), n as (select *, sum(fresh::int) over (partition by user_id order by event_id) as nth from f)
        select event_id as arrival, case when fresh and nth <= 15 then 'saved' when max((fresh and nth <= 15)::int) over (partition by user_id, k) = 1 then 'already_saved' else 'quota_exceeded' end as outcome from n union all select event_id, 'invalid_name' from r where length(k) = 0""",
    "q63_saved_list": "select event_id as id, event_type as kind from events where event_type = 'click' and user_id % 3 = 1 and contains(lower(props), 'k\": 1') order by ts desc, event_id desc limit 200",
    "q64_mutual_references": "select distinct cast(o_custkey as varchar) as act, concat('o', o_orderkey) as announcement from orders where o_orderkey % 3 <> 0 and o_orderkey % 5 <> 0",
    "q65_reachable_expressions": """select concat('DU/', year(o_orderdate), '/', o_orderkey + 1) as source_id, case (o_orderkey + 1) % 3 when 0 then 'ogl' when 1 then 'tj' else 'uj' end as expression, case (o_orderkey + 1) % 3 when 0 then 'promulgated' when 1 then 'consolidated' else 'unified' end as version_kind,
        case when (o_orderkey + 1) % 3 = 2 then 'non_authoritative' else 'authoritative' end as authority_class, concat('DU/', year(o_orderdate), '/', o_orderkey + 1, '/', case (o_orderkey + 1) % 3 when 0 then 'ogl' when 1 then 'tj' else 'uj' end) as uri from orders""",
    "q69_caveats": "select o_custkey as request, bool_or(o_orderkey % 9 = 0) as currentness, bool_or(o_orderkey % 11 = 0) as authority from orders group by 1",
    "q70_quality_report": """select count(*) as n, count(*) filter (where o_orderstatus = 'F') as n_answered, count(*) filter (where o_orderkey % 2 = 0 and o_orderstatus <> 'F') as n_unexpected, round(avg(o_orderkey % 17), 6) as mean_sources,
        max(cast(trunc(o_totalprice) as bigint)) as most_chars, count(*) filter (where o_orderkey % 101 = 0) as n_leaks from orders""",
    "q71_latest_usable_run": "select arg_max(c_custkey, {'a': c_acctbal, 'b': c_custkey}) as run_id from customer where c_custkey in (select o_custkey from orders where o_orderstatus = 'O' and o_orderkey % 50 = 0)",
    "q72_parsed_content_hash": """with r as (select o_custkey as version_id, concat('p/', o_orderkey) as p, concat('{"article":"', o_orderkey % 100, '","citation_label":"', o_orderpriority, '","heading":"', o_orderstatus, '","letter":null,"paragraph":null,"point":null,"provision_type":"article","structural_path":"p/', o_orderkey, '","text":"', o_orderkey, '"}') as j from orders)
        select version_id, sha256(concat('[', string_agg(j, ',' order by p), ']')) as content_hash from r group by 1""",
    "q73_latest_revisions": """with r as (select o_custkey as legal_act_id, case when o_orderkey % 4 = 0 then null else o_orderpriority end as a, o_orderdate, o_orderkey from orders)
        select legal_act_id, a as source_announcement_legal_act_id, o_orderkey as id from r where a is null union all select legal_act_id, a, arg_max(o_orderkey, {'x': o_orderdate, 'y': o_orderkey}) from r where a is not null group by 1, 2""",
    "q74_retrieval_signals": """with h as (select l_orderkey % 5000 as target, count(distinct l_partkey) as n, max(l_discount) as best, bool_or(l_quantity = 3) as b from lineitem group by 1)
        select r.target, coalesce(n, 0) as n_candidates, best as best_score, coalesce(b, false) as backstop from (select unnest(range(0, 5100)) as target) r left join h on h.target = r.target""",
    "q75_hybrid_many_queries": f"with {_HYBRID} select query_id, id, lexical_rank, vector_rank, score, final_rank from final",
    "q76_investigation_packed": f"""with recursive {_HYBRID}, h as (select id, query_id % 4 as request, query_id % 2 as issue_no, query_id as query_no, query_id // 4 % 3 as target, case when query_id % 5 <> 0 then 'most_likely' else 'possible' end as l, score from final),
        one as (select request, target, id, bool_or(l = 'most_likely') as likely, {_TIER} as w, min({{'a': issue_no, 'b': query_no}}) as f from h group by 1, 2, 3),
        every as (select request, id, {_TIER} as w, min({{'a': issue_no, 'b': query_no}}) as f from h group by 1, 2),
        rows as (select request, 0 as phase, target, id, w, f from one where likely union all select request, 1, null, id, w, f from every),
        ranked as (select r.*, n_chars, row_number() over (partition by request order by phase, target, round(w, 9) desc, concat('art. ', id), f, id) as k from rows r join documents on doc_id = id),
        pack as (select request, 0 as k, cast(null as bigint) as id, cast(null as bigint) as target, false as taken, cast([] as bigint[]) as ids, cast([] as bigint[]) as done, cast(0 as bigint) as used from (select distinct request from ranked)
          union all select request, k, id, target, taken, case when taken then list_append(ids, id) else ids end, case when phase = 0 and not skipped then list_append(done, target) else done end, used + case when taken then n_chars else 0 end
            from (select *, not skipped and len(ids) < 16 and (len(ids) = 0 or used + n_chars <= 12000) as taken
              from (select x.request, x.k, x.id, x.target, x.phase, x.n_chars, p.ids, p.done, p.used, list_contains(p.ids, x.id) or (x.phase = 0 and list_contains(p.done, x.target)) as skipped from pack p join ranked x on x.request = p.request and x.k = p.k + 1)))
        select request, id, len(ids) as source_no, target as reserved_for from pack where taken""",
    "q77_citations_of_many_queries": f"""with t as ({GEO_SQL}), n as (select id, parent_id, provision_type, case when provision_type = 'article' then {_NUM} end as a, case when provision_type = 'clause' then {_NUM} % 4 end as u, case when provision_type = 'point' then {_NUM} % 3 end as p from t)
        select 1 as query_id, o.id from n o join n c on o.parent_id = c.id join n x on c.parent_id = x.id where o.p = 1 and c.u = 2 and x.a = 3
        union all select 2, o.id from n o join n c on o.parent_id = c.id join n x on c.parent_id = x.id where o.p = 2 and x.a = 7
        union all select 4, id from n where u = 1 union all select 5, id from n where a = 12""",
    "q78_contexts_indexed": f"""with t as ({GEO_SQL}), l as (select id, parent_id, provision_type, label, trim(text) as text, case when provision_type in ('division', 'article') then label else concat(label, ' — ', text) end as line from t)
        select c.id, sha256(concat_ws(chr(10), 'World', r.line, n.line, c.label, c.text)) as content_hash from l c join l n on c.parent_id = n.id join l r on n.parent_id = r.id where c.provision_type = 'clause'
        union all select o.id, sha256(concat_ws(chr(10), 'World', r.line, n.line, c.line, o.label, o.text)) from l o join l c on o.parent_id = c.id join l n on c.parent_id = n.id join l r on n.parent_id = r.id where o.provision_type = 'point'""",
    "q79_provision_counts": "select l_suppkey as version_id, count(*) as n_provisions from lineitem group by 1",
}
