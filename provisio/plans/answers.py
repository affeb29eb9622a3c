"""Verification, recovery, answers, requests, ingest, runs and details: queries over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provisio import shared
from provisio.functions import hashing, text
from provisio.operators import activity, answer_cache, answering, catalog, currentlaw, evaluation, indexing, ingest, pipeline, publication, responses
from provisio.plans.corpus import LADDER_SQL
from provisio.plans.views import ANNEX_SHOWN, GEO_SQL, geo_tree, pdf_of, table
from provisio.sources import files, html_units, metadata, pdf_bytes, pdf_lines

# -- verification, recovery, answers: a customer is a request, an order a conclusion about one of three targets


def _targets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("request"), F.explode(F.array(*map(F.lit, (0, 1, 2))).cast("array<bigint>")).alias("target")).withColumn("text", F.concat(F.lit("target "), F.col("target").cast("string")))


def _batches(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").selectExpr("c_custkey as request", "c_custkey % 19 <> 0 as verifier_valid", "c_custkey % 23 <> 0 as skeptic_valid")


def _first_pass(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders")
    claimed = rows.selectExpr("o_custkey as request", "o_orderkey as conclusion", "array('A', 'F') as claimed", "case when o_orderkey % 10 = 0 then null else o_orderkey % 3 end as target")
    verdicts = rows.where("o_orderkey % 113 <> 0").selectExpr("o_orderkey as conclusion", "case when o_orderkey % 4 = 1 then 'partial_support' else 'direct_support' end as verdict")
    quotes = table(spark, d, "lineitem").selectExpr("l_orderkey as conclusion", "case when l_quantity = 7 and l_linenumber = 7 then 'X' else 'A' end as source_id", "case when l_quantity > 48 then 'not_found' else 'verbatim' end as status")
    skeptic = rows.where("o_orderkey % 127 <> 0").selectExpr("o_orderkey as conclusion", "o_orderkey % 5 = 0 as leap")
    return answering.gated(claimed, verdicts, quotes, skeptic, _batches(spark, d))


def q66_verification_gates(spark: SparkSession, d: str) -> DataFrame:
    return _first_pass(spark, d).select("request", "conclusion", "outcome", F.array_join("support", ",").alias("support"))


_GATES = """
quotes as (select l_orderkey as c, count(*) as n, count(*) filter (where l_quantity <= 48) as ok, bool_or(l_quantity = 7 and l_linenumber = 7) as foreigner,
           array_to_string(list_sort(list(distinct case when l_quantity = 7 and l_linenumber = 7 then 'X' else 'A' end) filter (where l_quantity <= 48)), ',') as confirmed from lineitem group by 1),
marked as (select o_custkey as request, o_orderkey as conclusion, case when o_orderkey % 10 = 0 then null else o_orderkey % 3 end as target, o_custkey % 19 <> 0 as vv, o_custkey % 23 <> 0 as sv, confirmed,
           o_custkey % 19 <> 0 and o_orderkey % 113 <> 0 and o_orderkey % 4 <> 1 and coalesce(n, 0) > 0 and n = ok as passed, o_custkey % 19 <> 0 and (o_orderkey % 113 = 0 or coalesce(foreigner, false)) as broken from orders left join quotes on c = o_orderkey),
gates as (select request, conclusion, target, case when bool_or(broken or (passed and sv and conclusion % 127 = 0)) over (partition by request) then 'error' when not passed or not sv or conclusion % 5 = 0 then 'demoted' else 'verified' end as outcome, confirmed from marked),
targets as (select c_custkey as request, unnest([0, 1, 2]) as target from customer),
hit as (select distinct request, target from gates where outcome = 'verified'),
modes as (select t.request, case when t.request not in (select request from hit) then 'full' when count(h.target) > 0 and count(h.target) < count(*) then 'partial' else 'none' end as mode from targets t left join hit h on h.request = t.request and h.target = t.target group by t.request)"""


def q67_recovery_mode(spark: SparkSession, d: str) -> DataFrame:
    return answering.recovery_modes(_targets(spark, d), _first_pass(spark, d))


def _recovered(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").where("o_orderkey % 4 = 1").selectExpr("o_custkey as request", "-o_orderkey - 1 as conclusion", "o_orderkey as k")
    drafts = rows.selectExpr("request", "conclusion", "array('A') as claimed", "(k + 1) % 3 as target")
    own = rows.selectExpr("conclusion", "case when k % 7 = 0 then 'not_found' else 'verbatim' end as status")
    verdicts = rows.selectExpr("conclusion", "case when k % 3 = 0 then 'no_support' else 'direct_support' end as verdict")
    quotes, skeptic = rows.selectExpr("conclusion", "'A' as source_id", "'verbatim' as status"), rows.selectExpr("conclusion", "k % 11 = 0 as leap")
    return answering.recovered(_first_pass(spark, d), _targets(spark, d), drafts, own, verdicts, quotes, skeptic, _batches(spark, d))


def q68_recovery_pass(spark: SparkSession, d: str) -> DataFrame:
    """What a recovery pass adds to the first one; a request whose drafts name a target that is done adds nothing."""
    return _recovered(spark, d).select("conclusion", "phase", "outcome")


_RECOVERED = f"""{_GATES},
drafts as (select o_custkey as request, -o_orderkey - 1 as conclusion, o_orderkey as k, (o_orderkey + 1) % 3 as target from orders join modes on request = o_custkey where o_orderkey % 4 = 1 and mode <> 'none'),
wrong as (select distinct x.request from drafts x join hit h on h.request = x.request and h.target = x.target),
every as (select conclusion, request, target, 'first' as phase, outcome from gates union all
          select conclusion, request, target, 'recovery', case when request % 19 <> 0 and request % 23 <> 0 and k % 3 <> 0 and k % 11 <> 0 then 'verified' else 'demoted' end from drafts where k % 7 <> 0 and request not in (select request from wrong))"""


def q80_answers_assembled(spark: SparkSession, d: str) -> DataFrame:
    """Every request's status and answer, from its verified conclusions, open targets, other paths, doubts and question."""
    customers, orders = table(spark, d, "customer"), table(spark, d, "orders")
    requests = customers.select(F.col("c_custkey").alias("request"))
    hits = orders.where("o_custkey % 13 <> 0").select(F.col("o_custkey").alias("request"))
    sources = customers.selectExpr("c_custkey as request", "explode(array('A', 'F')) as source_id", "c_nationkey").selectExpr("request", "source_id", "concat('art. ', source_id, c_nationkey) as label")
    numbers = orders.select(F.col("o_orderkey").alias("k")).union(orders.select(-F.col("o_orderkey") - 1))
    statements = numbers.selectExpr("k as conclusion", "k as position", "concat('order ', k) as statement")
    paths = customers.where("c_custkey % 5 = 0").selectExpr("c_custkey as request", "1 as position", "'path' as label", "case when c_custkey % 10 = 0 then '' else 'why' end as explanation", "array('art. 1') as labels")
    doubts = customers.where("c_custkey % 4 = 0").selectExpr("c_custkey as request", "explode(array(1, 2)) as position").withColumn("text", F.concat(F.lit("doubt "), F.col("position").cast("string")))
    questions = customers.where("c_custkey % 6 = 0").selectExpr("c_custkey as request", "'which one?' as question")
    rows = answering.assembled(requests, hits, sources, _targets(spark, d), _recovered(spark, d), statements, paths, doubts, questions)
    return rows.select("request", "status", "reason", "n_sources", "n_verified", F.sha2("answer", 256).alias("answer"))


def q81_run_queries(spark: SparkSession, d: str) -> DataFrame:
    """First turns as queries: some too short, some cached, the others answered."""
    return _run(spark, d)[0].select("request", "outcome")


def q82_run_history(spark: SparkSession, d: str) -> DataFrame:
    return _run(spark, d)[1].groupBy("status").agg(F.count("*").alias("n"))


def _run(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "conversations").where("turn = 0").selectExpr("conv_id as request", "case when conv_id % 7 = 0 then ' x ' else text end as query")
    run = [F.lit("r1").alias("corpus_run_id"), F.lit("p1").alias("pipeline_version"), F.lit("s1").alias("ruleset_version"), F.lit("2024-01-01").alias("effective_as_of"), F.lit("h1").alias("corpus_selection_hash")]
    cache = rows.where("request % 3 = 0").select(text.cache_key(F.col("query")).alias("question_hash"), *run, F.lit("answered").alias("status"), F.lit("kept").alias("answer_snapshot"), F.array(F.lit("v1")).alias("source_version_ids"))
    scope = spark.createDataFrame([("r1", ["v1", "v2"])], "corpus_run_id string, version_ids array<string>")
    told = lambda asked: asked.where("request % 5 <> 0").selectExpr("request", "case when request % 2 = 0 then 'answered' else 'insufficient_evidence' end as status", "'new' as answer")
    return answering.run_queries(rows.select("request", "query", *run), cache.dropDuplicates(["question_hash"]), scope, told)


_FORM = "lower(trim(regexp_replace(query, '\\s+', ' ', 'g')))"
_RUN = f"""asked as (select conv_id as request, case when conv_id % 7 = 0 then ' x ' else text end as query from conversations where turn = 0),
told as (select request, case when length(trim(query)) not between 3 and 2000 then 'invalid' when {_FORM} in (select {_FORM} from asked where request % 3 = 0) then 'cached' when request % 5 = 0 then 'failed' when request % 2 = 0 then 'answered' else 'insufficient_evidence' end as outcome from asked)"""


# -- ingest: an order's lines are a text, its number says which act, expression or announcement


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").selectExpr(
        "l_orderkey", "concat('p/', l_linenumber) as structural_path", "'article' as provision_type", "l_returnflag as citation_label",
        "l_linestatus as heading", "cast(l_partkey as string) as text", "cast(l_linenumber as string) as article", "cast(null as string) as paragraph", "cast(null as string) as point", "cast(null as string) as letter",
    )


def q83_into_existing_versions(spark: SparkSession, d: str) -> DataFrame:
    """Texts for versions that exist: refused where there is no act, no such version, or too little text."""
    orders = table(spark, d, "orders").select("o_orderkey")
    acts = orders.where("o_orderkey % 11 <> 0").selectExpr("concat('DU/', o_orderkey) as source_id", "o_orderkey as id")
    versions = orders.selectExpr("o_orderkey as legal_act_id", "'ogl' as source_expression_id", "concat('v', o_orderkey) as id", "case when o_orderkey % 7 = 0 then 'backed' end as source_announcement_legal_act_id")
    parsed = _lines(spark, d).withColumns({"source_id": F.concat(F.lit("DU/"), F.col("l_orderkey").cast("string")), "expression": F.lit("ogl")})
    old = parsed.select(F.concat(F.lit("v"), F.col("l_orderkey").cast("string")).alias("version_id"), "structural_path")
    more = old.where("cast(substring(version_id, 2) as bigint) % 5 = 0").withColumn("structural_path", F.concat(F.lit("old/"), "structural_path"))
    table_, report = ingest.into_existing(parsed.select("source_id", "expression", "structural_path"), acts, versions, old.unionByName(more))
    n = table_.groupBy("version_id").agg(F.count("*").alias("n"))
    return report.withColumn("version_id", F.concat(F.lit("v"), F.substring("source_id", 4, 20))).join(n, "version_id", "left").select("source_id", "outcome", "n")


def q84_immutable_revisions(spark: SparkSession, d: str) -> DataFrame:
    """Consolidated texts as revisions: inserted, reused, or refused for want of mutual references or of an act."""
    lines = _lines(spark, d).withColumns({"base": F.concat(F.lit("b"), (F.col("l_orderkey") % 500).cast("string")), "announcement": F.concat(F.lit("a"), F.col("l_orderkey").cast("string"))})
    pairs = lines.select("base", "announcement", "l_orderkey").distinct()
    there = pairs.where("l_orderkey % 3 <> 0").selectExpr("base as legal_act_id", "'consolidated_text_announcement' as relation_type", "announcement as related_source_id")
    back = pairs.where("l_orderkey % 7 <> 0").selectExpr("announcement as legal_act_id", "'consolidated_text_for_act' as relation_type", "base as related_source_id")
    acts = pairs.select("base").distinct().where("cast(substring(base, 2) as int) % 13 <> 0").selectExpr("base as source_id", "base as id")
    own = lines.where("l_orderkey % 2 = 0").groupBy("base", "announcement").agg(hashing.parsed_content_hash().alias("content_hash"))
    versions = own.selectExpr("base as legal_act_id", "announcement as source_announcement_legal_act_id", "content_hash", "concat('old-', announcement) as id")
    report, appended, provisions = ingest.revisions(lines.drop("l_orderkey"), acts, there.unionByName(back), versions, lines)
    n = provisions.groupBy("version_id").agg(F.count("*").alias("n"))
    return report.join(appended.select(F.col("id").alias("version_id"), "source_document_key"), "version_id", "left").join(n, "version_id", "left").select("announcement", "outcome", F.col("source_document_key").isNotNull().alias("is_new"), "n")


def q85_relations_from_json(spark: SparkSession, d: str) -> DataFrame:
    """Relation graphs as JSON, an order's lines by label."""
    lines = table(spark, d, "lineitem").selectExpr("l_orderkey", "case l_returnflag when 'A' then 'Akty zmieniające' when 'N' then 'Sprostowanie' else 'Nowe' end as label", "l_partkey", "l_linenumber")
    entry = F.struct(F.struct(F.lit("DU").alias("publisher"), F.lit(2000).alias("year"), F.col("l_partkey").cast("int").alias("pos")).alias("act"))
    graph = lines.groupBy("l_orderkey", "label").agg(F.array_sort(F.collect_list(entry)).alias("v")).groupBy(F.col("l_orderkey").alias("legal_act_id")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("label", "v")))).alias("json"))
    return metadata.relations(graph).select("legal_act_id", "relation_type", "related_source_id")


def q86_source_parts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").selectExpr("o_orderkey", "case o_orderkey % 4 when 0 then concat('DU/', o_orderkey % 3000, '/', o_custkey) when 1 then concat('/', o_orderkey, '/1') when 2 then concat('MP/x/', o_custkey) else 'DU' end as source_id")
    return ingest.with_source_parts(rows, "source_id").select("o_orderkey", "publisher", "year", "position")


# -- runs and details


def _corpus(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Customers are acts, their orders announcements and rulings, lines are versions and amendments."""
    customers, orders, lines = (table(spark, d, x) for x in ("customer", "orders", "lineitem"))
    none = "cast(null as date) as {}"
    acts = customers.selectExpr("concat('c', c_custkey) as id", "c_acctbal >= 0 as in_force", none.format("promulgation_date"), "case when c_custkey % 17 = 0 then date '1990-01-01' end as expiration_date", none.format("entry_into_force_date"), "c_name as title")
    acts = acts.unionByName(orders.where("o_orderkey % 29 <> 0").selectExpr("concat('o', o_orderkey) as id", "true as in_force", "cast(o_orderdate as date) as promulgation_date", "case when o_orderkey % 5 <> 0 then date '1996-01-01' end as expiration_date", "case when o_orderkey % 3 = 0 then cast(o_orderdate as date) end as entry_into_force_date", "o_orderpriority as title"))
    edge = lambda rows, kind: rows.withColumn("relation_type", F.lit(kind)).withColumn("is_active", F.expr("k % 31 <> 0")).drop("k")
    own = orders.selectExpr("concat('c', o_custkey) as legal_act_id", "concat('o', o_orderkey) as related_legal_act_id", "o_orderkey as k")
    relations = edge(own.where("k % 10 < 6"), "consolidated_text_announcement").unionByName(edge(own.where("k % 40 = 7"), "constitutional_tribunal")).unionByName(edge(own.where("k % 97 = 8"), "correction"))
    later = lines.selectExpr("concat('o', l_orderkey) as legal_act_id", "concat('o', l_partkey) as related_legal_act_id", "l_orderkey as k", "l_quantity")
    relations = relations.unionByName(edge(later.where("l_quantity = 50").drop("l_quantity"), "post_consolidated_amendment")).unionByName(edge(later.where("l_quantity = 49").drop("l_quantity"), "correction"))
    versions = lines.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).selectExpr(
        "concat('v', l_orderkey, '-', l_linenumber) as id", "concat('c', o_custkey) as legal_act_id", "'consolidated' as version_kind", "'tj' as source_expression_id", "case when l_linestatus = 'O' then 'authoritative' else 'unknown' end as authority_class",
        "concat('o', l_orderkey) as source_announcement_legal_act_id", "l_returnflag <> 'N' as has_structure", "cast(l_shipdate as date) as legal_state_date", "l_shipdate as created_at",
    )
    return acts, versions, relations


def q87_candidates_decided(spark: SparkSession, d: str) -> DataFrame:
    """Acts, versions and relations put together and decided, all acts at once."""
    acts, versions, relations = _corpus(spark, d)
    rows = currentlaw.decided(currentlaw.candidates(acts, versions, relations, F.expr("date '1998-01-01'")))
    return rows.select("act", "reason_code", F.when(F.col("decision") == "included", F.col("version_id")).alias("version_id"))


def q88_pinned_scope(spark: SparkSession, d: str) -> DataFrame:
    """What pinned runs hold, after runs were appended that may not change older ones."""
    rows = table(spark, d, "lineitem").selectExpr("l_suppkey as run_id", "l_orderkey as act", "concat('v', l_partkey) as version_id", "case when l_returnflag = 'N' then 'excluded' else 'included' end as decision", "l_linestatus = 'O' as runtime_ready", "l_linenumber as k")
    one = rows.groupBy("run_id", "act").agg(F.min_by(F.struct("version_id", "decision", "runtime_ready"), F.struct("k", "version_id")).alias("x")).select("run_id", "act", "x.*")
    entries = currentlaw.appended_run(one.where("run_id % 2 = 0"), one)
    runs = table(spark, d, "supplier").selectExpr("s_suppkey as run_id", "date '2024-01-01' as effective_as_of")
    return currentlaw.pinned_scope(runs, entries, runs.where("run_id % 3 <> 0")).select("run_id", F.size("version_ids").alias("n"), F.element_at("version_ids", 1).alias("first"))


_ID = "concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey, '-', l_quantity)"


def q89_act_details(spark: SparkSession, d: str) -> DataFrame:
    """Orders as acts: their lines as versions, newest first, and resources with and without one."""
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem")
    acts = orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"))
    versions = lines.selectExpr(f"{_ID} as id", "l_orderkey as legal_act_id", "l_partkey as source_announcement_legal_act_id", "cast(l_shipdate as date) as state_date")
    resources = lines.selectExpr("l_orderkey as legal_act_id", "case when l_returnflag <> 'N' then l_linenumber end as version_id", "concat('u', l_suppkey) as source_url")
    provisions = lines.where("l_quantity < 10").selectExpr(f"{_ID} as version_id")
    rows = catalog.assembled_detail(acts, versions, resources, provisions)
    listed = F.array_join(F.transform("versions", lambda v: F.concat_ws("/", v["id"], F.coalesce(v["announced_by"], F.lit("-")), v["n_provisions"].cast("string"))), ",")
    return rows.select("id", "title", listed.alias("versions"), F.array_join("resolved", ",").alias("resolved"), F.array_join("unresolved", ",").alias("unresolved"))


def q90_single_provisions(spark: SparkSession, d: str) -> DataFrame:
    """Units with what is above them; asked for in another version they are missing."""
    nodes = geo_tree(spark, d).select(F.lit(1).alias("version_id"), "id", "parent_id", "provision_type", F.col("label").alias("citation_label"), F.col("label").alias("heading"), "text")
    asked = table(spark, d, "customer").selectExpr("c_custkey as request", "case when c_custkey % 4 = 0 then 2 else 1 end as version_id", "concat('c', c_custkey) as id")
    return catalog.provision(nodes, asked).select("request", "id", F.array_join("hierarchy", " > ").alias("hierarchy"))


def q91_nested_contents(spark: SparkSession, d: str) -> DataFrame:
    """The whole tree, nested, with the broken branches as roots."""
    nodes = geo_tree(spark, d).where("not (provision_type = 'article' and cast(substring(id, 2) as int) % 5 = 0)")
    rows = catalog.nested(nodes.select(F.lit(1).alias("version_id"), "id", "parent_id", F.expr("cast(substring(id, 2) as int)").alias("ordinal")))
    return rows.select("id", "n_nodes", "depth", F.sha2("tree", 256).alias("tree_hash"))


def q92_contents(spark: SparkSession, d: str) -> DataFrame:
    nodes = geo_tree(spark, d).select(F.when(F.col("provision_type") == "point", 2).otherwise(1).alias("version_id"), "id", "parent_id", "provision_type", F.col("label").alias("citation_label"), F.lit(None).cast("string").alias("heading"), "text", F.xxhash64("id").alias("ordinal"))
    return catalog.contents(nodes, 1).select("id", "parent_id", "citation_label")


def q93_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """Parts as acts, their suppliers' lines as versions; what is wanted of the version is filtered after the limit."""
    acts = table(spark, d, "part").select(F.col("p_partkey").alias("act"), F.col("p_name").alias("title"), "p_type")
    lines = table(spark, d, "lineitem").selectExpr("l_partkey as act", f"{_ID} as id", "case l_returnflag when 'A' then 'promulgated' when 'N' then 'consolidated' else 'unified' end as kind", "false as backed", "l_linestatus = 'O' as structured", "true as official", "cast(l_shipdate as date) as state_date")
    provisions = lines.selectExpr("id as version_id").unionByName(lines.where("structured").selectExpr("id as version_id"))
    rows = catalog.catalogue(acts, lines, provisions, "a", columns=["title"], order=["title", "act"], wanted=F.col("n_provisions") > 1)
    return rows.select("act", "title", "n_provisions")


# -- visitors and caches


def _snapshots(spark: SparkSession, d: str) -> DataFrame:
    json = """concat('{"status":"', case when event_id % 5 = 0 then 'unknown' else 'answered' end, '","answer":', case when event_id % 7 = 0 then 'null' else concat('"', event_type, ' ', user_id, '"') end,
        ',"conclusions":[{"statement":"s"', case when event_id % 11 = 0 then '' else ',"citationLabels":["art. 1"]' end, '}],"alternativePaths":[],"uncertainties":[],"citedSources":[', case when event_id % 3 = 0 then '' else '{"citationLabel":"art. 1"}' end, '],"clarificationQuestion":null}')"""
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.expr(json).alias("result_snapshot"))


def q94_history_rows(spark: SparkSession, d: str) -> DataFrame:
    """Entries are checked before they are stored and again when they are read."""
    rows = _snapshots(spark, d)
    return activity.list_rows(activity.recorded(rows.where("id % 2 = 0"), rows.where("id % 2 = 1")))


def q95_items_moved_and_deleted(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    items = events.selectExpr("user_id as visitor_id", "event_id as id", "event_type as title", "cast(null as bigint) as folder_id")
    folders = events.where("event_id % 4 = 0").selectExpr("user_id as visitor_id", "event_id as id")
    moves = events.where("event_id % 3 = 0").selectExpr("case when event_id % 5 = 0 then user_id + 1 else user_id end as visitor_id", "event_id as item_id", "case when event_id % 2 = 0 then event_id div 4 * 4 end as folder_id", "event_id as arrival")
    gone = events.where("event_id % 10 = 7").selectExpr("case when event_id % 20 = 7 then user_id else user_id + 1 end as visitor_id", "event_id as item_id")
    return activity.deleted(activity.moved(items, moves, folders), gone).select("id", "folder_id")


def q96_folders_renamed(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    folders = events.where("event_id % 50 = 0").selectExpr("user_id as visitor_id", "event_id as id", "concat('Name ', event_id % 400) as name")
    asked = events.where("event_id % 25 = 0").selectExpr("user_id as visitor_id", "event_id as folder_id", "case when event_id % 350 = 0 then '  ' else concat(' NAME ', event_id % 300) end as name", "event_id as arrival")
    return activity.renamed(folders, asked).select("arrival", "outcome")


def q111_own_items(spark: SparkSession, d: str) -> DataFrame:
    """Items asked for by their visitors, with a summary by kind; those of others are missing."""
    rows = table(spark, d, "events").selectExpr(
        "event_id as id", "user_id as visitor_id", "case event_id % 3 when 0 then 'answer' when 1 then 'search' else 'provision' end as kind", "event_type as query",
        """concat('{"answer":"', repeat(concat(event_type, ' '), event_id % 60), '","citationLabel":"art. ', event_id, '"}') as snapshot""",
    )
    asked = table(spark, d, "events").selectExpr("case when event_id % 4 = 0 then user_id + 1 else user_id end as visitor_id", "event_id as id")
    return activity.summaries(activity.owned(rows, asked))


def q97_cache_hits(spark: SparkSession, d: str) -> DataFrame:
    key = [F.lit("r").alias("corpus_run_id"), F.lit("p").alias("pipeline_version")]
    cache = table(spark, d, "customer").select(F.col("c_custkey").alias("question_hash"), *key, F.lit(1).cast("long").alias("hit_count"), F.lit(None).cast("timestamp_ntz").alias("last_hit_at"))
    looked = table(spark, d, "orders").select(F.col("o_custkey").alias("question_hash"), *key, F.expr("o_orderkey % 2 = 0").alias("is_hit"))
    return answer_cache.counted_hits(cache, looked, F.expr("timestamp_ntz '2024-01-01'")).select("question_hash", "hit_count", "last_hit_at")


def q98_source_pack_hash(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").selectExpr("l_orderkey as request", "l_linenumber as source_no", "l_partkey as id", "concat('art. ', l_suppkey) as label")
    return rows.groupBy("request").agg(answer_cache.source_pack_hash().alias("source_pack_hash"))


def q99_expected_rates(spark: SparkSession, d: str) -> DataFrame:
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem")
    expected = orders.selectExpr("o_orderkey as question", "explode(array('art. A', 'art. N', 'art. R ust. 1')) as label")
    said = lines.selectExpr("l_orderkey as question", "concat('art. ', l_returnflag, ' ust. ', l_linenumber) as label", "l_quantity as q")
    return evaluation.expected_rates(expected, {"retrieved": said, "packed": said.where("q > 10"), "cited": said.where("q > 30")})


def q100_prioritised_sources(spark: SparkSession, d: str) -> DataFrame:
    sources = table(spark, d, "lineitem").selectExpr("l_orderkey as request", "l_linenumber as source_no", "cast(l_partkey % 3 as bigint) as reserved_for")
    targets = table(spark, d, "orders").selectExpr("o_orderkey as request", "o_custkey % 3 as target")
    return answering.prioritised(sources, targets).select("request", "source_no", "place")


def q101_history_filtered(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").selectExpr("event_id as id", "ts as created_at", "event_type as status", "props as query")
    return activity.filtered(rows, F.expr("timestamp_ntz '2024-01-30 12:00:00'"), status="click", day="older", term=" K\": 1").select("id")


def q102_sources_proven(spark: SparkSession, d: str) -> DataFrame:
    """Sources with the pinned run's date where the run includes their version."""
    packed = table(spark, d, "lineitem").selectExpr("l_orderkey as request", "l_partkey as id", "l_linenumber as source_no", "cast(null as bigint) as reserved_for")
    provisions = table(spark, d, "part").selectExpr("p_partkey as id", "p_size as version_id", "p_name as text")
    current = table(spark, d, "supplier").selectExpr("cast(s_suppkey % 25 as int) as version_id", "date '2024-01-01' as effective_as_of")
    return answering.source_rows(packed, provisions, current).select("request", "source_id", "version_id", F.col("proven_as_of").isNotNull().alias("is_proven"))


def q115_cache_rows(spark: SparkSession, d: str) -> DataFrame:
    """Orders as answers, their lines as sources: those that may be stored, all sources in scope and proven at the run's date."""
    line = F.expr("struct(l_linenumber as n, l_partkey as id, concat('art. ', l_suppkey) as label, concat('v', l_suppkey % 20) as version_id, case when l_quantity > 5 then '2024-01-01' end as proven_as_of)")
    sources = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("sources"))
    answers = table(spark, d, "orders").join(sources, F.col("o_orderkey") == F.col("l_orderkey")).selectExpr(
        "cast(o_orderkey as string) as question_hash", "concat('r', o_custkey % 5) as corpus_run_id", "'p1' as pipeline_version", "'s1' as ruleset_version", "'2024-01-01' as effective_as_of", "'h1' as corpus_selection_hash",
        "case when o_orderkey % 7 = 0 then 'insufficient_evidence' else 'answered' end as status", "o_orderpriority as answer", "sources",
    )
    runs = table(spark, d, "customer").selectExpr("concat('r', c_custkey % 5) as corpus_run_id", "c_custkey % 5 as run").distinct()
    scope = runs.join(table(spark, d, "supplier").selectExpr("s_suppkey % 20 as v").distinct(), F.col("v") != F.col("run")).groupBy("corpus_run_id").agg(F.collect_set(F.concat(F.lit("v"), "v")).alias("version_ids"))
    return answer_cache.rows_to_record(answers, scope).select("question_hash", "corpus_run_id", F.array_join("source_version_ids", ",").alias("versions"), "source_pack_hash", "hit_count")


def q116_batch_with_side_writes(spark: SparkSession, d: str) -> DataFrame:
    """Two batches of the same questions: the first one's answers are stored but its history can't be written, which takes no answer away; the second one's are read from the cache."""
    rows = table(spark, d, "conversations").where("turn = 0").selectExpr("conv_id as request", "case when conv_id % 7 = 0 then ' x ' else text end as query")
    run = [F.lit("r1").alias("corpus_run_id"), F.lit("p1").alias("pipeline_version"), F.lit("s1").alias("ruleset_version"), F.lit("2024-01-01").alias("effective_as_of"), F.lit("h1").alias("corpus_selection_hash")]
    asked, scope = rows.select("request", "query", *run), spark.createDataFrame([("r1", ["v1", "v2"])], "corpus_run_id string, version_ids array<string>")
    source = "array(struct(request as id, 'art. 1' as label, case when request % 3 = 0 then 'v9' else 'v1' end as version_id, '2024-01-01' as proven_as_of)) as sources"
    told = lambda q: q.where("request % 5 <> 0").selectExpr("request", "case when request % 2 = 0 then 'answered' else 'insufficient_evidence' end as status", "'new' as answer", source)

    def broken(history: DataFrame, _: DataFrame | None) -> DataFrame:
        raise OSError("the history can't be written")

    store, now = publication.Store(spark, shared.path(spark, "store")), F.expr("timestamp_ntz '2024-01-01'")
    first, failed = answering.run_batch(asked, store, scope, told, now, 1, writers={"history": broken})
    second, _ = answering.run_batch(asked, store, scope, told, now, 2)
    answering.run_batch(asked, store, scope, told, now, 2)  # sent again: writes nothing
    n = store.table("history").groupBy("request").agg(F.count("*").alias("n_history"))
    out = first.selectExpr("request", "outcome as first").join(second.selectExpr("request", "outcome as second"), "request").join(n, "request", "left")
    return out.select("request", "first", "second", F.coalesce("n_history", F.lit(0)).alias("n_history"), F.lit(",".join(sorted(failed))).alias("failed"))


def q117_published_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs that become current together with their entries; one that is sent again with other entries stays as it was."""
    store = publication.Store(spark, shared.path(spark, "store"))
    lines = table(spark, d, "lineitem")
    for run in (lines.where("l_suppkey % 2 = 0"), lines):
        entries = run.groupBy(F.expr("l_suppkey % 50").alias("run_id"), F.col("l_orderkey").alias("act")).agg(F.min("l_partkey").alias("version_id"))
        publication.published_run(store, entries.select("run_id").distinct(), entries)
    now = store.current()
    return store.table("entries", now).join(store.table("runs", now), "run_id").groupBy("run_id").agg(F.count("*").alias("n"), F.sum("version_id").alias("total"))


# -- sources and responses


def q103_statutes_from_html(spark: SparkSession, d: str) -> DataFrame:
    """A text for each nation, its customers as articles with a point each."""
    unit = """concat('<div class="unit unit_arti" data-id="arti_', c_custkey, '"><h3>Art. ', c_custkey, '</h3><div class="unit-inner"><div data-template="xText">', c_name, '&nbsp;<a class="gloss-link">1)</a></div>',
        '<div class="unit unit_pint" data-id="pint_1"><div class="unit-inner"><div data-template="xText">', c_mktsegment, '</div></div></div></div></div>')"""
    rows = table(spark, d, "customer").select(F.col("c_nationkey").alias("version_id"), F.struct(F.lit(1).alias("part"), F.col("c_custkey").alias("no")).alias("place"), F.expr(unit).alias("html"))
    ends = ((0, '<div class="parts"><section id="s1"><div class="part"><h2>Ustawa</h2><div class="block">'), (2, "</div></div></section></div>"))
    nations = rows.select("version_id").distinct()
    for part, html in ends:
        rows = rows.unionByName(nations.select("version_id", F.struct(F.lit(part).alias("part"), F.lit(None).cast("bigint").alias("no")).alias("place"), F.lit(html).alias("html")))
    return html_units.units_of_pieces(rows).select("version_id", "provision_type", "citation_label", "text", "structural_path")


def q104_statutes_from_lines(spark: SparkSession, d: str) -> DataFrame:
    """A printed text for each nation: the annex's heading, then its customers as articles."""
    rows = table(spark, d, "customer").selectExpr("c_nationkey as version_id", "c_custkey as line", "concat('Art. ', c_custkey, '. ', c_name) as text")
    head = table(spark, d, "customer").selectExpr("c_nationkey as version_id").distinct().selectExpr("version_id", "-1 as line", "'Załącznik do obwieszczenia' as text")
    lines = rows.unionByName(head).selectExpr("version_id", "1 as page", "cast(line as int) as line", "10.0D as font_size", "text")
    return pdf_lines.units(lines).select("version_id", "provision_type", "citation_label", "text")


def q119_statutes_from_pdf_bytes(spark: SparkSession, d: str) -> DataFrame:
    """The printed texts of q104 as the bytes of PDF files, their letters by an encoding's differences: bytes, pieces, lines, provisions."""
    rows = table(spark, d, "customer").selectExpr("c_nationkey", "struct(c_custkey, concat('0 -14 Td (Art. ', c_custkey, '. ) Tj (', c_name, ') Tj ') as shown) as u")
    shown = F.array_join(F.transform(F.array_sort(F.collect_list("u")), lambda x: x["shown"]), "")
    docs = rows.groupBy(F.col("c_nationkey").cast("string").alias("path")).agg(F.concat(F.lit(ANNEX_SHOWN), shown, F.lit("ET")).alias("shown"))
    found = pdf_bytes.pieces(docs.select("path", pdf_of("shown").alias("content")))
    lines = pdf_lines.visual_lines(found).withColumn("version_id", F.col("document").cast("int"))
    return pdf_lines.units(lines).select("version_id", "provision_type", "citation_label", "text")


def q105_lines_from_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of a page become lines by their height; size is the length of a matrix row."""
    rows = table(spark, d, "lineitem").selectExpr("l_orderkey as document", "1 as page", "cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) as int) as position", "l_partkey as p")
    pieces = rows.selectExpr("document", "page", "position", "700.0D - 20 * (position div 2) + position % 2 as y", "3.0D as a", "4.0D as b", "cast(p as string) as text")
    return pdf_lines.visual_lines(pieces).select("document", "text", "font_size")


def q106_search_index(spark: SparkSession, d: str) -> DataFrame:
    """The index after an update: what changed is embedded again, what is gone is removed."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.sha2("text", 256).alias("content_hash"))
    old = docs.where("id % 2 = 0").selectExpr("id", "content", "case when id % 6 = 0 then 'x' else content_hash end as content_hash", "array(1.0F) as embedding")
    gone = docs.where("id % 10 = 0").selectExpr("-id - 1 as id", "content", "content_hash", "array(1.0F) as embedding")
    fresh = lambda t: t.select("id", F.array(F.lit(2.0).cast("float")).alias("embedding"))
    return indexing.updated(old.unionByName(gone), docs.where("id % 7 <> 0"), fresh).select("id", "content_hash", F.element_at("embedding", 1).cast("double").alias("first"))


def q107_titles_and_sources(spark: SparkSession, d: str) -> DataFrame:
    """Titles of saved items, and sources as a prompt shows them."""
    rows = table(spark, d, "customer").withColumn("day", F.expr("case when c_custkey % 2 = 0 then date '2024-01-01' end"))
    answer_title, provision_title = activity.titles(F.repeat("c_name", 8), F.col("c_mktsegment"), F.col("c_name"))
    return rows.select("c_custkey", answer_title.alias("answer_title"), provision_title.alias("provision_title"), pipeline.source_text(F.col("c_mktsegment"), F.col("c_name"), F.lit("text"), F.col("day")).alias("source"))


def q108_attachments(spark: SparkSession, d: str) -> DataFrame:
    return files.attachments(table(spark, d, "orders").selectExpr("cast(o_orderkey as string) as file_name", "case o_orderkey % 4 when 0 then 'O,T' when 1 then 'T' when 2 then 'O' end as source_type_codes"))


def q109_verdict_responses(spark: SparkSession, d: str) -> DataFrame:
    """Verifiers' responses, an order's lines as conclusions; some are wrong in one place, and count for nothing."""
    lines = table(spark, d, "lineitem").selectExpr("l_orderkey as request", "l_linenumber as conclusion", "l_quantity as q").distinct().groupBy("request", "conclusion").agg(F.max("q").alias("q"))
    value = """concat('{"verdict":"', case when request % 11 = 0 then 'maybe' when q > 25 then 'direct_support' else 'no_support' end, '","evidence":[{"sourceId":"A"', case when request % 13 = 0 then '' else ',"excerpt":"e"' end, '}]', case when request % 17 = 0 then '' else ',"reason":"r"' end, case when request % 19 = 0 then ',"more":1' else '' end, '}')"""
    one = lines.where("request % 7 <> 0 or conclusion <> 1").select("request", F.concat(F.lit('"'), F.col("conclusion").cast("string"), F.lit('":'), F.expr(value)).alias("v"))
    sent = one.groupBy("request").agg(F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list("v")), ","), F.lit("}")).alias("json"))
    return responses.verdicts(sent, lines.select("request", F.col("conclusion").cast("long"))).select("request", "conclusion", "verdict", F.size("evidence").alias("n"), "is_valid")


def q110_draft_responses(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").selectExpr("o_orderkey as request", """concat('{"conclusions":[{"statement":"', case when o_orderkey % 5 = 0 then ' ' else 's' end, '","support":[', case when o_orderkey % 7 = 0 then '' else concat('{"sourceId":"S', o_orderkey % 4, '"}') end, '],"answerTargetIndex":', case when o_orderkey % 3 = 0 then 'null' else cast(o_orderkey % 6 as string) end, '}]', case when o_orderkey % 11 = 0 then ',"x":1' else '' end, '}') as json""")
    offered = rows.selectExpr("request", "array('S0', 'S1', 'S2') as sources", "array(0L, 1L, 2L, 4L) as targets")
    return responses.drafts(rows, offered).select("request", "is_valid", F.size("conclusions").alias("n"))


QUERIES = {k: v for k, v in list(globals().items()) if k[0] == "q" and k[1:3].isdigit()}
_NL = "chr(10)"
_PARSED = """parsed as (select l_orderkey as k, concat('b', l_orderkey % 500) as base, concat('a', l_orderkey) as announcement, count(*) as n from lineitem group by 1)"""
_FINE = "k % 11 <> 0 and k % 13 <> 0 and k % 17 <> 0 and k % 19 <> 0 and not (k % 7 = 0 and has_one)"
SQL = {
    "q103_statutes_from_html": """select c_nationkey as version_id, 'part' as provision_type, 'Ustawa' as citation_label, 'Ustawa' as text, 's1' as structural_path from customer group by 1
        union all select c_nationkey, 'article', concat('art. ', c_custkey), concat('Art. ', c_custkey, '. ', c_name), concat('s1/arti_', c_custkey) from customer
        union all select c_nationkey, 'point', concat('art. ', c_custkey, ' pkt 1'), concat('1) ', c_mktsegment), concat('s1/arti_', c_custkey, '/pint_1') from customer""",
    "q104_statutes_from_lines": "select c_nationkey as version_id, 'article' as provision_type, concat('art. ', c_custkey) as citation_label, concat('Art. ', c_custkey, '. ', c_name) as text from customer",
    "q119_statutes_from_pdf_bytes": "select c_nationkey as version_id, 'article' as provision_type, concat('art. ', c_custkey) as citation_label, concat('Art. ', c_custkey, '. ', c_name) as text from customer",
    "q105_lines_from_pieces": """with r as (select l_orderkey as document, l_partkey as p, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) as k from lineitem)
        select document, string_agg(cast(p as varchar), '' order by k) as text, 5e0 as font_size from r group by document, k // 2""",
    "q106_search_index": """with n as (select doc_id as id, sha256(text) as h from documents where doc_id % 7 <> 0) select id, h as content_hash, case when id % 2 = 0 and id % 6 <> 0 then 1e0 else 2e0 end as first from n""",
    "q107_titles_and_sources": "select c_custkey, case when length(repeat(c_name, 8)) > 120 then concat(rtrim(left(repeat(c_name, 8), 120)), '…') else repeat(c_name, 8) end as answer_title, concat(c_mktsegment, ' — ', c_name) as provision_title, concat(c_mktsegment, ', ', c_name, case when c_custkey % 2 = 0 then ' (current as of 2024-01-01)' else ' (currentness not proven)' end, chr(10), 'text') as source from customer",
    "q108_attachments": "select cast(o_orderkey as varchar) as file_name, case o_orderkey % 4 when 0 then 'O,T' when 1 then 'T' when 2 then 'O' end as source_type_codes, case when o_orderkey % 4 < 2 then 'accepted' else 'refused' end as outcome from orders",
    "q109_verdict_responses": f"""with l as (select l_orderkey as k, l_linenumber as c, max(l_quantity) as q, bool_or(l_linenumber = 1) over (partition by l_orderkey) as has_one from lineitem group by 1, 2)
        select k as request, c as conclusion, case when k % 11 = 0 then 'maybe' when q > 25 then 'direct_support' else 'no_support' end as verdict, 1 as n, {_FINE} as is_valid from l where k % 7 <> 0 or c <> 1""",
    "q110_draft_responses": """select o_orderkey as request, o_orderkey % 5 <> 0 and o_orderkey % 7 <> 0 and o_orderkey % 4 <> 3 and (o_orderkey % 3 = 0 or o_orderkey % 6 in (0, 1, 2, 4)) and o_orderkey % 11 <> 0 as is_valid,
        case when o_orderkey % 5 <> 0 and o_orderkey % 7 <> 0 and o_orderkey % 4 <> 3 and (o_orderkey % 3 = 0 or o_orderkey % 6 in (0, 1, 2, 4)) and o_orderkey % 11 <> 0 then 1 end as n from orders""",
    "q66_verification_gates": f"with {_GATES} select request, conclusion, outcome, case when outcome = 'verified' then confirmed else '' end as support from gates",
    "q67_recovery_mode": f"with {_GATES} select request, mode from modes",
    "q68_recovery_pass": f"with {_RECOVERED} select conclusion, phase, outcome from every",
    "q80_answers_assembled": f"""with {_RECOVERED},
        good as (select e.*, c_nationkey from every e join customer on c_custkey = request where outcome = 'verified'),
        a as (select request, count(*) as n, string_agg(concat('order ', conclusion, ' (art. A', c_nationkey, ')'), {_NL} || {_NL} order by target is null, target, conclusion) as a from good group by 1),
        b as (select t.request, string_agg(concat('- target ', t.target), {_NL} order by t.target) as b from targets t where not exists (select 1 from good g where g.request = t.request and g.target = t.target) group by 1),
        err as (select distinct request from every where outcome = 'error'),
        r as (select c_custkey as request, n, case when c_custkey % 13 = 0 or c_custkey not in (select o_custkey from orders) then 'nothing_retrieved' when c_custkey in (select request from err) then 'failed' when n is null then 'nothing_verified' end as reason,
          concat_ws({_NL} || {_NL}, '{answering.INTRO}', a, case when b is not null then concat('{answering.UNSUPPORTED}', {_NL}, b) end, case when c_custkey % 5 = 0 and c_custkey % 10 <> 0 then concat('{answering.OTHER_PATHS}', {_NL}, '- path: why (art. 1)') end,
          case when c_custkey % 4 = 0 then concat('{answering.UNCERTAINTIES}', {_NL}, '- doubt 1', {_NL}, '- doubt 2') end, case when c_custkey % 6 = 0 then '{answering.CLARIFICATION}which one?' end) as answer
          from customer left join a on a.request = c_custkey left join b on b.request = c_custkey)
        select request, case when reason is null then 'answered' when reason = 'failed' then 'failed' else 'insufficient_evidence' end as status, reason, 2 as n_sources, coalesce(n, 0) as n_verified, case when reason is null then sha256(answer) end as answer from r""",
    "q81_run_queries": f"with {_RUN} select request, outcome from told",
    "q82_run_history": f"with {_RUN} select case when outcome = 'cached' then 'answered' else outcome end as status, count(*) as n from told where outcome in ('cached', 'answered', 'insufficient_evidence') group by 1",
    "q83_into_existing_versions": """with p as (select l_orderkey as k, count(*) as n from lineitem group by 1)
        select concat('DU/', k) as source_id, case when k % 11 = 0 then 'no_act' when k % 7 = 0 then 'no_version' when k % 5 = 0 then 'refused' else 'replaced' end as outcome, case when k % 5 = 0 then 2 * n else n end as n from p""",
    "q84_immutable_revisions": f"with {_PARSED} select announcement, case when k % 3 = 0 or k % 7 = 0 then 'not_mutual' when k % 500 % 13 = 0 then 'no_base_act' when k % 2 = 0 then 'reused' else 'inserted' end as outcome, outcome = 'inserted' as is_new, case when outcome = 'inserted' then n end as n from parsed",
    "q85_relations_from_json": "select distinct l_orderkey as legal_act_id, case l_returnflag when 'A' then 'amending_act' when 'N' then 'correction' else 'unrecognized' end as relation_type, concat('DU/2000/', l_partkey) as related_source_id from lineitem",
    "q86_source_parts": "select o_orderkey, case when o_orderkey % 4 = 0 then 'DU' end as publisher, case when o_orderkey % 4 = 0 then o_orderkey % 3000 end as year, case when o_orderkey % 4 = 0 then o_custkey end as position from orders",
    "q87_candidates_decided": f"""with acts as (select concat('c', c_custkey) as id, c_acctbal >= 0 as in_force, cast(null as date) as pro, case when c_custkey % 17 = 0 then date '1990-01-01' end as ex, cast(null as date) as ent from customer
          union all select concat('o', o_orderkey), true, cast(o_orderdate as date), case when o_orderkey % 5 <> 0 then date '1996-01-01' end, case when o_orderkey % 3 = 0 then cast(o_orderdate as date) end from orders where o_orderkey % 29 <> 0),
        rel as (select concat('c', o_custkey) as a, concat('o', o_orderkey) as b, case when o_orderkey % 10 < 6 then 'chain' end as t from orders where o_orderkey % 31 <> 0 and o_orderkey % 10 < 6
          union all select concat('c', o_custkey), concat('o', o_orderkey), 'tk' from orders where o_orderkey % 31 <> 0 and o_orderkey % 40 = 7 union all select concat('c', o_custkey), concat('o', o_orderkey), 'cor' from orders where o_orderkey % 31 <> 0 and o_orderkey % 97 = 8
          union all select concat('o', l_orderkey), concat('o', l_partkey), 'am' from lineitem where l_orderkey % 31 <> 0 and l_quantity = 50 union all select concat('o', l_orderkey), concat('o', l_partkey), 'cor' from lineitem where l_orderkey % 31 <> 0 and l_quantity = 49),
        chain as (select r.a, count(*) as n_chain, count(*) filter (where x.id is null) as n_unresolved_chain, count(*) filter (where x.pro <= date '1998-01-01' and (x.ex is null or x.ex > date '1998-01-01')) as n_applicable, max(case when x.pro <= date '1998-01-01' and (x.ex is null or x.ex > date '1998-01-01') then r.b end) as ann
          from rel r left join acts x on x.id = r.b where t = 'chain' group by 1),
        one as (select a, ann from chain where n_applicable = 1),
        v as (select one.a, concat('v', l_orderkey, '-', l_linenumber) as id, l_linestatus = 'O' as ok, l_returnflag <> 'N' as st, cast(l_shipdate as date) as sd, l_shipdate from lineitem join one on ann = concat('o', l_orderkey)),
        vc as (select a, count(*) as n_versions, count(*) filter (where ok) as n_well_formed, arg_max(id, {{'x': l_shipdate, 'y': id}}) filter (where ok) as version_id, arg_max(st, {{'x': l_shipdate, 'y': id}}) filter (where ok) as newest_structured, arg_max(sd, {{'x': l_shipdate, 'y': id}}) filter (where ok) as state_date from v group by 1),
        lt as (select one.a, count(*) filter (where t = 'am' and x.ent is null) as n_amendment_unresolved, count(*) filter (where t = 'am' and x.ent <= date '1998-01-01') as n_amendment_effective, count(*) filter (where t = 'cor') as c1 from one join rel r on r.a = ann left join acts x on x.id = r.b where t in ('am', 'cor') group by 1),
        rl as (select r.a, count(*) filter (where t = 'cor') as c2, count(*) filter (where t = 'tk') as n_tribunal, count(*) filter (where t = 'tk' and x.ent is null) as n_tribunal_unresolved, max(x.ent) filter (where t = 'tk') as tribunal_date from rel r left join acts x on x.id = r.b where t in ('chain', 'cor', 'tk') group by 1),
        every as (select acts.id as act, in_force, ex as act_expires, date '1998-01-01' as as_of, coalesce(n_chain, 0) as n_chain, coalesce(n_unresolved_chain, 0) as n_unresolved_chain, coalesce(n_applicable, 0) as n_applicable, coalesce(n_versions, 0) as n_versions, coalesce(n_well_formed, 0) as n_well_formed, version_id, newest_structured, state_date,
          coalesce(n_amendment_unresolved, 0) as n_amendment_unresolved, coalesce(n_amendment_effective, 0) as n_amendment_effective, coalesce(c1, 0) + coalesce(c2, 0) as n_correction, coalesce(n_tribunal, 0) as n_tribunal, coalesce(n_tribunal_unresolved, 0) as n_tribunal_unresolved, tribunal_date
          from acts left join chain on chain.a = id left join vc on vc.a = acts.id left join lt on lt.a = acts.id left join rl on rl.a = acts.id)
        select act, {LADDER_SQL} as reason_code, case when reason_code = 'authoritative_current' then version_id end as version_id from every""",
    "q88_pinned_scope": """with one as (select l_suppkey as run_id, l_orderkey as act, arg_min({'v': concat('v', l_partkey), 'd': l_returnflag <> 'N', 'r': l_linestatus = 'O'}, {'a': l_linenumber, 'b': concat('v', l_partkey)}) as x from lineitem group by 1, 2)
        select run_id, count(distinct x.v) as n, min(x.v) as first from one where x.d and x.r and run_id % 3 <> 0 and run_id in (select s_suppkey from supplier) group by 1""",
    "q89_act_details": f"""with v as (select l_orderkey as k, string_agg(concat_ws('/', {_ID}, coalesce(a.o_orderpriority, '-'), case when l_quantity < 10 then 1 else 0 end), ',' order by cast(l_shipdate as date) desc, {_ID}) as versions,
          coalesce(array_to_string(list_sort(list(distinct concat('u', l_suppkey)) filter (where l_returnflag <> 'N')), ','), '') as resolved, coalesce(array_to_string(list_sort(list(distinct concat('u', l_suppkey)) filter (where l_returnflag = 'N')), ','), '') as unresolved from lineitem left join orders a on a.o_orderkey = l_partkey group by 1)
        select o_orderkey as id, o_orderpriority as title, versions, resolved, unresolved from orders left join v on k = o_orderkey""",
    "q90_single_provisions": "select c_custkey as request, concat('c', c_custkey) as id, concat(r_name, ' > ', n_name) as hierarchy from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey where c_custkey % 4 <> 0",
    "q91_nested_contents": f"""with recursive g as (select id, parent_id, cast(substring(id, 2) as int) as o from ({GEO_SQL}) where not (provision_type = 'article' and cast(substring(id, 2) as int) % 5 = 0)),
        t as (select g.id, p.id as up, g.o from g left join g p on p.id = g.parent_id),
        walk as (select id as root, id, o, [{{'o': o, 'i': id}}] as path from t where up is null union all select w.root, t.id, t.o, list_append(w.path, {{'o': t.o, 'i': t.id}}) from walk w join t on t.up = w.id),
        s as (select root, id, o, len(path) - 1 as depth, lag(len(path) - 1) over (partition by root order by path) as before, row_number() over (partition by root order by path) as nth from walk)
        select root as id, count(*) as n_nodes, max(depth) as depth, sha256(concat(string_agg(concat(case when before >= depth then concat(repeat(']}}', before - depth + 1), ',') else '' end, '{{"id":"', id, '","ordinal":', o, ',"children":['), '' order by nth), repeat(']}}', arg_max(depth, nth) + 1))) as tree_hash from s group by 1""",
    "q92_contents": f"select id, parent_id, label as citation_label from ({GEO_SQL}) where provision_type <> 'point'",
    "q93_catalogue": f"""with a as (select p_partkey as act, p_name as title from part where p_name ilike '%a%' order by title, act limit 200),
        v as (select l_partkey as act, {_ID} as id, case l_returnflag when 'A' then 'promulgated' when 'N' then 'consolidated' else 'unified' end as kind, l_linestatus = 'O' as s, cast(l_shipdate as date) as sd from lineitem where l_partkey in (select act from a)),
        rep as (select * from v qualify row_number() over (partition by act, kind order by s desc, sd desc nulls last, id) = 1),
        w as (select act, max(case when kind = 'promulgated' then id end) as p, coalesce(bool_or(s) filter (where kind = 'promulgated'), false) as ps, max(case when kind = 'consolidated' then id end) as c, coalesce(bool_or(s) filter (where kind = 'consolidated'), false) as cs, max(case when kind = 'unified' then id end) as u, coalesce(bool_or(s) filter (where kind = 'unified'), false) as us from rep group by 1),
        anys as (select act, arg_min(id, {{'a': case when kind = 'unified' then 1 else 0 end, 'b': case kind when 'promulgated' then 1 when 'consolidated' then 2 else 3 end, 'c': id}}) as id from v where s group by 1),
        shown as (select w.act, case when case when c is not null then cs else ps end then coalesce(c, p) when case when u is not null then us when c is not null then cs else ps end then coalesce(u, c, p) else coalesce(anys.id, c, p, u) end as id from w left join anys on anys.act = w.act)
        select a.act, title, 1 + s::int as n_provisions from a join shown on shown.act = a.act join v on v.id = shown.id and v.act = a.act where s""",
    "q94_history_rows": "select event_id as id, 'answered' as status, case when event_id % 3 = 0 then 0 else 1 end as n_sources, concat(event_type, ' ', user_id) as preview from events where event_id % 5 <> 0 and event_id % 7 <> 0 and event_id % 11 <> 0",
    "q95_items_moved_and_deleted": """with e as (select event_id as id, user_id as u from events), f as (select id, u from e where id % 4 = 0)
        select e.id, case when e.id % 3 = 0 and e.id % 5 <> 0 and e.id % 2 = 0 and exists (select 1 from f where f.id = e.id // 4 * 4 and f.u = e.u) then e.id // 4 * 4 end as folder_id from e where not (e.id % 20 = 7)""",
    "q96_folders_renamed": """with f as (select user_id as u, event_id as id, lower(concat('Name ', event_id % 400)) as k from events where event_id % 50 = 0),
        q as (select user_id as u, event_id as id, lower(trim(case when event_id % 350 = 0 then '  ' else concat(' NAME ', event_id % 300) end)) as k from events where event_id % 25 = 0),
        m as (select q.*, exists (select 1 from f where f.u = q.u and f.id = q.id) as own, length(k) between 1 and 80 as fine, exists (select 1 from f where f.u = q.u and f.k = q.k and f.id <> q.id) as clash from q),
        n as (select *, min(case when own and fine and not clash then id end) over (partition by u, k) as first from m)
        select id as arrival, case when not own then 'not_found' when not fine then 'invalid_name' when clash or first <> id then 'duplicate' else 'renamed' end as outcome from n""",
    "q111_own_items": """with r as (select event_id as id, case event_id % 3 when 0 then 'answer' when 1 then 'search' else 'provision' end as kind, event_type, repeat(concat(event_type, ' '), cast(event_id % 60 as int)) as a from events where event_id % 4 <> 0)
        select id, kind, case kind when 'answer' then case when length(a) > 220 then concat(rtrim(left(a, 220)), '...') else a end when 'search' then event_type else concat('art. ', id) end as summary from r""",
    "q97_cache_hits": "with h as (select o_custkey, count(*) as n from orders where o_orderkey % 2 = 0 group by 1) select c_custkey as question_hash, 1 + coalesce(n, 0) as hit_count, case when n is not null then timestamp '2024-01-01' end as last_hit_at from customer left join h on o_custkey = c_custkey",
    "q98_source_pack_hash": """select l_orderkey as request, sha256(concat('[', string_agg(concat('{"legalProvisionId":"', l_partkey, '","citationLabel":"art. ', l_suppkey, '"}'), ',' order by l_partkey::varchar, l_linenumber, l_suppkey::varchar), ']')) as source_pack_hash from lineitem group by 1""",
    "q99_expected_rates": """with e as (select o_orderkey as q, unnest(['art. A', 'art. N', 'art. R ust. 1']) as label from orders), l as (select l_orderkey as q, concat('art. ', l_returnflag, ' ust. ', l_linenumber) as said, l_quantity as n from lineitem),
        f as (select e.q, e.label, coalesce(bool_or(said = label or starts_with(said, label || ' ')), false) as a, coalesce(bool_or(n > 10 and (said = label or starts_with(said, label || ' '))), false) as b, coalesce(bool_or(n > 30 and (said = label or starts_with(said, label || ' '))), false) as c from e left join l on l.q = e.q group by 1, 2)
        select count(*) as n, round(avg(a::int), 6) as retrieved_rate, round(avg(b::int), 6) as packed_rate, round(avg(c::int), 6) as cited_rate from f""",
    "q100_prioritised_sources": "select l_orderkey as request, l_linenumber as source_no, row_number() over (partition by l_orderkey order by o_orderkey is null or l_partkey % 3 <> o_custkey % 3, l_linenumber) as place from lineitem left join orders on o_orderkey = l_orderkey",
    "q101_history_filtered": "select event_id as id from events where event_type = 'click' and date_diff('day', cast(ts as date), date '2024-01-30') > 7 and contains(lower(props), 'k\": 1')",
    "q102_sources_proven": "select l_orderkey as request, concat('SOURCE_', l_linenumber) as source_id, p_size as version_id, p_size in (select s_suppkey % 25 from supplier) as is_proven from lineitem join part on p_partkey = l_partkey",
    "q115_cache_rows": """with s as (select l_orderkey as k, bool_and(l_quantity > 5 and l_suppkey % 20 <> o_custkey % 5 and l_suppkey % 20 in (select s_suppkey % 20 from supplier)) as fine, array_to_string(list_sort(list(distinct concat('v', l_suppkey % 20))), ',') as versions,
          sha256(concat('[', string_agg(concat('{"legalProvisionId":"', l_partkey, '","citationLabel":"art. ', l_suppkey, '"}'), ',' order by l_partkey::varchar, l_linenumber, l_suppkey::varchar), ']')) as h from lineitem join orders on o_orderkey = l_orderkey group by 1)
        select cast(o_orderkey as varchar) as question_hash, concat('r', o_custkey % 5) as corpus_run_id, versions, h as source_pack_hash, 0 as hit_count from orders join s on k = o_orderkey where fine and o_orderkey % 7 <> 0""",
    "q116_batch_with_side_writes": f"""with asked as (select conv_id as request, case when conv_id % 7 = 0 then ' x ' else text end as query from conversations where turn = 0),
        t as (select request, {_FORM} as form, case when length(trim(query)) not between 3 and 2000 then 'invalid' when request % 5 = 0 then 'failed' when request % 2 = 0 then 'answered' else 'insufficient_evidence' end as first from asked),
        u as (select request, first, case when first <> 'invalid' and form in (select form from t where first = 'answered' and request % 3 <> 0) then 'cached' else first end as second from t)
        select *, case when second in ('cached', 'answered', 'insufficient_evidence') then 1 else 0 end as n_history, 'history' as failed from u""",
    "q117_published_runs": """with e as (select l_suppkey % 50 as run_id, l_orderkey as act, min(l_partkey) as v from lineitem where l_suppkey % 2 = 0 group by 1, 2 union all
          select l_suppkey % 50, l_orderkey, min(l_partkey) from lineitem where l_suppkey % 50 not in (select l_suppkey % 50 from lineitem where l_suppkey % 2 = 0) group by 1, 2)
        select run_id, count(*) as n, sum(v) as total from e group by 1""",
}
