"""Retrieval and index queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provisio.functions import citation, hashing, text
from provisio.operators import evaluation, hierarchy, indexing, lexical_index, retrieval, vector_index
from provisio.plans.views import GEO_SQL, documents_index, embeddings_index, geo_tree, lexemes_sql, table, tokens_sql

TERMS = ["the", "with", "that"]
_IN = lambda xs: ", ".join(f"'{x}'" for x in xs)
_TOKENS = tokens_sql("source is not null")
_SIM = "list_cosine_similarity(cast(e.embedding as double[]), cast(q.embedding as double[]))"


def _in_scope(spark: SparkSession, d: str) -> DataFrame:
    """Documents of all sources: the scope is a request's table, here of all sources that there are."""
    rows = table(spark, d, "documents")
    return retrieval.in_scope(rows, rows.select("source"), "source")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return _in_scope(spark, d).select(F.col("doc_id").alias("id"), "text")


def _query(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.lit(0).cast("long").alias("query_id"), F.lit(" ".join(TERMS)).alias("query"))


def _lexical(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.lexical_search(_docs(spark, d), _query(spark), limit=retrieval.CANDIDATES)


def _vectors(spark: SparkSession, d: str, limit: int, asked: str = "vec_id % 100 = 0") -> DataFrame:
    rows = table(spark, d, "embeddings")
    return retrieval.vector_search(rows, {r["vec_id"]: r["embedding"] for r in rows.where(asked).select("vec_id", "embedding").collect()}, id_col="vec_id", limit=limit)


def q01_lexical_match(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.lexical_hits(_docs(spark, d), _query(spark)).select(F.col("id").alias("doc_id"), F.col("n_lexemes").alias("n_terms"))


def q02_lexical_rank_topk(spark: SparkSession, d: str) -> DataFrame:
    hits = retrieval.lexical_hits(_docs(spark, d), _query(spark), limit=retrieval.CANDIDATES)
    return retrieval.top(hits, F.desc("rank"), retrieval.CANDIDATES, "nth").select(F.col("id").alias("doc_id"), "rank", "nth")


_RANKED = f"""
hits as (select *, lag(tok) over (partition by id order by pos) as before, pos - lag(pos) over (partition by id order by pos) as gap from ({_TOKENS}) where tok in ({_IN(TERMS)})),
scored as (select id, count(distinct tok) as n, round(sum(case when before <> tok then 0.1e0 / gap else 0e0 end), 6) as rank from hits group by id having count(distinct tok) >= 2),
lexical as (select id, rank, row_number() over (order by rank desc, id) as lexical_rank from scored qualify lexical_rank <= 30)"""
_VECTOR = f"""
vector as (select e.vec_id as id, {_SIM} as similarity, row_number() over (order by round({_SIM}, 12) desc, e.vec_id) as vector_rank
           from embeddings e, (select embedding from embeddings where vec_id = 0) q qualify vector_rank <= 30)"""
_FUSED = f"""
fused as (select coalesce(l.id, v.id) as id, lexical_rank, vector_rank, similarity,
          round(coalesce(1e0 / (60 + lexical_rank), 0e0) + coalesce(1e0 / (60 + vector_rank), 0e0), 9) as score from lexical l full join vector v on l.id = v.id)"""
_EXACT = f"""
exact as (select doc_id as id from documents where doc_id % 97 = 3 and source is not null),
every as (select coalesce(f.id, x.id) as id, lexical_rank, vector_rank, similarity, coalesce(score, 0e0) as score, x.id is not null as is_exact from fused f full join exact x on f.id = x.id),
final as (select *, row_number() over (order by is_exact desc, score desc, lexical_rank nulls last, vector_rank nulls last, id) as final_rank
          from every where lexical_rank is not null or is_exact or coalesce(similarity, 0) >= 0.35 qualify final_rank <= 10)"""


def q03_vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d, 30, "vec_id = 0").select(F.col("id").alias("vec_id"), F.round("similarity", 9).alias("similarity"), "vector_rank")


def q04_vector_topk_per_query(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d, 10).select("query_id", F.col("id").alias("vec_id"), F.round("similarity", 9).alias("similarity"), "vector_rank")


PER_QUERY_SQL = f"""select q.vec_id as query_id, e.vec_id as vec_id, round({_SIM}, 9) as similarity, row_number() over (partition by q.vec_id order by round({_SIM}, 12) desc, e.vec_id) as vector_rank
from embeddings e, (select vec_id, embedding from embeddings where vec_id % 100 = 0) q qualify vector_rank <= 10"""


def q05_rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    both = retrieval.fused(_lexical(spark, d), _vectors(spark, d, 30, "vec_id = 0"), min_similarity=None)
    return both.select(F.col("id").alias("doc_id"), "lexical_rank", "vector_rank", "score")


def q06_similarity_guard(spark: SparkSession, d: str) -> DataFrame:
    both = retrieval.fused(_lexical(spark, d), _vectors(spark, d, 30, "vec_id = 0"))
    return both.select(F.col("id").alias("doc_id"), "lexical_rank", "vector_rank", "score")


def _final(spark: SparkSession, d: str) -> DataFrame:
    exact = _in_scope(spark, d).where("doc_id % 97 = 3").select(F.lit(0).cast("long").alias("query_id"), F.col("doc_id").alias("id"))
    return retrieval.ranked(retrieval.fused(_lexical(spark, d), _vectors(spark, d, 30, "vec_id = 0"), exact))


def q07_exact_first_order(spark: SparkSession, d: str) -> DataFrame:
    return _final(spark, d).select(F.col("id").alias("doc_id"), "is_exact", "score", "final_rank")


def q08_hybrid_hydrated(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("labelled"), "quality")
    rows = retrieval.hydrated(_final(spark, d), (docs, "id", "doc_id")).join(labels, F.col("doc_id") == F.col("labelled"), "left")
    return rows.select("final_rank", "doc_id", "lang", "source", "n_chars", "quality", "score")


def q09_ancestors_root_first(spark: SparkSession, d: str) -> DataFrame:
    nodes = geo_tree(spark, d)
    walked = hierarchy.ancestors(nodes, nodes.where("provision_type = 'point'"))
    path = F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("k"), "id")))
    return walked.groupBy("leaf").agg(F.array_join(F.transform(path, lambda x: x["id"]), "/").alias("path"), F.count("*").alias("n"))


_WALK = f"""geo as ({GEO_SQL}),
walk as (select o.id as leaf, p.id as id, p.parent_id, 1 as depth from geo o join geo p on o.parent_id = p.id where o.provision_type = 'point'
         union all select w.leaf, p.id, p.parent_id, w.depth + 1 from walk w join geo p on w.parent_id = p.id)"""


def q10_ancestor_context(spark: SparkSession, d: str) -> DataFrame:
    nodes = geo_tree(spark, d).select("*", F.col("label").alias("citation_label"), F.col("label").alias("heading"))
    found = hierarchy.contexts(nodes, nodes.where("provision_type = 'point'"))
    return found.select("leaf", F.array_join("hierarchy", " > ").alias("context"))


_SPAN = "concat('art. ', cast(o_orderkey % 500 as varchar), ' ust. ', cast(o_orderkey % 7 as varchar), ' pkt ', cast(o_orderkey % 5 as varchar))"


def q11_citation_parse(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", F.expr(_SPAN.replace("varchar", "string")).alias("s"))
    return rows.select("o_orderkey", *(c.alias(k) for k, c in citation.parsed(F.col("s")).items()))


def _part(mark: str, value: str = r"(\d+[a-z]?)") -> str:
    return rf"nullif(regexp_extract({_SPAN}, '(?i)(?:^|[^A-Za-z0-9_]){mark}\s*{value}(?:$|[^A-Za-z0-9_])', 1), '')"


def q12_citation_match(spark: SparkSession, d: str) -> DataFrame:
    nodes = geo_tree(spark, d)
    own = lambda kind: F.when(F.col("provision_type") == kind, F.col("label"))
    nodes = nodes.select("id", "parent_id", "provision_type", own("article").alias("article"), own("clause").alias("paragraph"), own("point").alias("point"), F.lit(None).cast("string").alias("letter"))
    return hierarchy.citation_matches(nodes, {"article": "NATION_3", "point": "1-URGENT"})


def _broken_tree(spark: SparkSession, d: str) -> DataFrame:
    return geo_tree(spark, d).where("not (provision_type = 'article' and cast(substring(id, 2) as int) % 5 = 0)")


def q13_toc_roots(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.with_roots(_broken_tree(spark, d)).select("id", "provision_type", "is_root")


def q14_searchable_filter(spark: SparkSession, d: str) -> DataFrame:
    nodes = geo_tree(spark, d)
    return nodes.where(hierarchy.is_searchable(F.col("provision_type"), F.col("label"), F.col("text"))).select("id", "provision_type")


def _drafts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    content = hierarchy.document_content(F.col("source"), F.array("lang", F.lit(" ")), F.concat(F.lit("doc "), F.col("doc_id").cast("string")), F.col("text"))
    return docs.select("doc_id", content.alias("content"))


def q15_document_content_hash(spark: SparkSession, d: str) -> DataFrame:
    return _drafts(spark, d).select("doc_id", hashing.content_hash(F.col("content")).alias("content_hash"))


def q16_index_diff(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    old = docs.where("id % 2 = 0").select("id", F.sha2(F.when(F.col("id") % 4 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("content_hash"))
    gone = docs.where("id % 10 = 0").select((-F.col("id") - 1).alias("id"), F.sha2("text", 256).alias("content_hash"))
    return indexing.difference(old.unionByName(gone), docs.select("id", F.sha2("text", 256).alias("content_hash")))


def q26_runtime_ready(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source")
    have = docs.join(table(spark, d, "embeddings").select("vec_id"), F.col("doc_id") == F.col("vec_id"), "left_semi")
    return indexing.runtime_ready(docs, have, "source")


def q47_eval_rates(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id")
    return evaluation.rates(rows.select("source", (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic")), ["good", "toxic"], ["source"])


def q48_prefix_match(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    expected = part.select("p_brand").distinct().select(F.col("p_brand").alias("question"), F.explode(F.array(*map(F.lit, ["PROMO", "ECONOMY 3", "SMALL"]))).alias("label"))
    return evaluation.found_labels(expected, part.select(F.col("p_brand").alias("question"), F.concat_ws(" ", "p_type", F.col("p_size").cast("string")).alias("label")))


def _items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def q49_multi_query_lexical(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items, whole, as queries against all documents, through the index."""
    found = retrieval.top(lexical_index.hits(documents_index(spark, d), _items(spark, d), 10)[0], F.desc("rank"), 10, "nth")
    return found.groupBy("query_id").agg(F.count("*").alias("n"), F.max("n_lexemes").alias("most_lexemes"))


def q112_lexical_topk_by_index(spark: SparkSession, d: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    found = retrieval.top(lexical_index.hits(documents_index(spark, d), _items(spark, d), 10)[0], F.desc("rank"), 10, "nth")
    return found.select("query_id", F.col("id").alias("doc_id"), "rank", "n_lexemes", "nth")


def q113_vector_topk_by_index(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest vectors of every vector that asks, by balls."""
    asked = table(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    found = vector_index.search(embeddings_index(spark, d), asked, 10)
    return found.select("query_id", F.col("id").alias("vec_id"), F.round("similarity", 9).alias("similarity"), "vector_rank")


def q114_cycles_of_parents(spark: SparkSession, d: str) -> DataFrame:
    """Walks where parents are missing, above themselves, or in a cycle: every part's parent is another part."""
    nodes = table(spark, d, "part").selectExpr("p_partkey as id", "case p_partkey % 4 when 0 then p_partkey when 1 then p_partkey div 3 else (p_partkey * 7 + p_size) % 1500 + 1 end as parent_id")
    found = hierarchy.walks(nodes, nodes)
    return found.select(F.col("leaf").alias("id"), F.size("path").alias("n"), F.array_join(F.transform("path", lambda x: x["id"].cast("string")), "/").alias("path"))


def q50_query_forms(spark: SparkSession, d: str) -> DataFrame:
    """Squeezed, folded and counted texts of conversations."""
    rows = table(spark, d, "conversations")
    return rows.select("conv_id", "turn", F.sha2(text.query_form(F.col("text")), 256).alias("form"), F.size(text.tokens(F.col("text"))).alias("n_tokens"), text.is_valid_query(F.col("text")).alias("is_valid"))


_BEST = f"""with tok as ({tokens_sql()}),
        q as (select item_id as query_id, unnest(list_distinct(toks)) as tok, len(list_distinct(toks)) as n from (
          select item_id, {lexemes_sql("text")} as toks from benchmark)),
        hits as (select query_id, id, n, t.tok, pos, lag(t.tok) over w as before, pos - lag(pos) over w as gap from tok t join q on t.tok = q.tok window w as (partition by query_id, id order by pos)),
        scored as (select query_id, id, n, count(distinct tok) as n_lexemes, round(sum(case when n = 1 then 0.1e0 when before <> tok then 0.1e0 / gap else 0e0 end), 6) as rank from hits group by 1, 2, 3),
        best as (select *, row_number() over (partition by query_id order by rank desc, id) as nth from scored where n_lexemes >= least(2, n) qualify nth <= 10)"""
QUERIES = {k: v for k, v in list(globals().items()) if k[0] == "q" and k[1:3].isdigit()}
_BROKEN = f"select * from ({GEO_SQL}) where not (provision_type = 'article' and cast(substring(id, 2) as int) % 5 = 0)"
_NOT_SEARCHED = "provision_type not in ('part', 'book', 'title', 'division', 'chapter', 'section') and not starts_with(provision_type, 'unknown') and trim(text) <> '' and trim(text) <> trim(label)"
_CONTENT = "array_to_string(list_filter([trim(source), trim(lang), trim(' '), trim(concat('doc ', doc_id)), trim(text)], lambda x: x <> ''), chr(10))"
SQL = {
    "q01_lexical_match": f"select id as doc_id, count(distinct tok) as n_terms from ({_TOKENS}) where tok in ({_IN(TERMS)}) group by id having count(distinct tok) >= 2",
    "q02_lexical_rank_topk": f"with {_RANKED} select id as doc_id, rank, lexical_rank as nth from lexical",
    "q03_vector_topk": f"select e.vec_id, round({_SIM}, 9) as similarity, row_number() over (order by round({_SIM}, 12) desc, e.vec_id) as vector_rank from embeddings e, (select embedding from embeddings where vec_id = 0) q qualify vector_rank <= 30",
    "q04_vector_topk_per_query": PER_QUERY_SQL,
    "q05_rrf_fusion": f"with {_RANKED}, {_VECTOR}, {_FUSED} select id as doc_id, lexical_rank, vector_rank, score from fused",
    "q06_similarity_guard": f"with {_RANKED}, {_VECTOR}, {_FUSED} select id as doc_id, lexical_rank, vector_rank, score from fused where lexical_rank is not null or coalesce(similarity, 0) >= 0.35",
    "q07_exact_first_order": f"with {_RANKED}, {_VECTOR}, {_FUSED}, {_EXACT} select id as doc_id, is_exact, score, final_rank from final",
    "q08_hybrid_hydrated": f"with {_RANKED}, {_VECTOR}, {_FUSED}, {_EXACT} select final_rank, d.doc_id, lang, source, n_chars, quality, score from final f join documents d on f.id = d.doc_id left join labels l on l.doc_id = d.doc_id",
    "q09_ancestors_root_first": f"with recursive {_WALK} select leaf, string_agg(id, '/' order by depth desc) as path, count(*) as n from walk group by leaf",
    "q10_ancestor_context": f"with recursive {_WALK} select leaf, string_agg(case when {_NOT_SEARCHED} then concat(label, ' — ', trim(text)) else label end, ' > ' order by depth desc) as context from walk w join geo g on w.id = g.id group by leaf",
    "q11_citation_parse": f"select o_orderkey, {_part('art[.]?')} as article, {_part('ust[.]?')} as paragraph, {_part('pkt[.]?')} as point, lower({_part('lit[.]?', '([a-z])')}) as letter from orders",
    "q12_citation_match": f"with recursive {_WALK} select distinct o.id from geo o join walk w on w.leaf = o.id join geo a on a.id = w.id where o.provision_type = 'point' and o.label = '1-URGENT' and a.provision_type = 'article' and a.label = 'NATION_3'",
    "q13_toc_roots": f"with t as ({_BROKEN}) select t.id, t.provision_type, p.id is null as is_root from t left join t p on t.parent_id = p.id",
    "q14_searchable_filter": f"select id, provision_type from ({GEO_SQL}) where {_NOT_SEARCHED}",
    "q15_document_content_hash": f"select doc_id, sha256({_CONTENT}) as content_hash from documents",
    "q16_index_diff": """with old as (select doc_id as id, sha256(case when doc_id % 4 = 0 then text || 'x' else text end) as h from documents where doc_id % 2 = 0
        union all select -doc_id - 1, sha256(text) from documents where doc_id % 10 = 0), new as (select doc_id as id, sha256(text) as h from documents)
        select coalesce(o.id, n.id) as id, case when n.id is null then 'removed' when o.h = n.h then 'unchanged' else 'embedded' end as action from old o full join new n on o.id = n.id""",
    "q26_runtime_ready": "select source, count(*) as searchable, count(vec_id) as embedded, count(*) > 0 and count(*) = count(vec_id) as ready from documents left join embeddings on doc_id = vec_id group by source",
    "q47_eval_rates": "select source, count(*) as n, round(avg(case when quality = 1 then 1e0 else 0e0 end), 6) as good_rate, round(avg(case when toxic = 1 then 1e0 else 0e0 end), 6) as toxic_rate from documents join labels using (doc_id) group by source",
    "q48_prefix_match": """with e as (select question, unnest(['PROMO', 'ECONOMY 3', 'SMALL']) as label from (select distinct p_brand as question from part)),
        l as (select p_brand as question, concat(p_type, ' ', p_size) as label from part)
        select e.question, e.label, coalesce(bool_or(l.label = e.label or starts_with(l.label, e.label || ' ')), false) as is_found from e left join l on e.question = l.question group by 1, 2""",
    "q49_multi_query_lexical": f"{_BEST} select query_id, count(*) as n, max(n_lexemes) as most_lexemes from best group by query_id",
    "q112_lexical_topk_by_index": f"{_BEST} select query_id, id as doc_id, rank, n_lexemes, nth from best",
    "q113_vector_topk_by_index": PER_QUERY_SQL,
    "q114_cycles_of_parents": """with recursive n as (select p_partkey as id, case p_partkey % 4 when 0 then p_partkey when 1 then p_partkey // 3 else (p_partkey * 7 + p_size) % 1500 + 1 end as up from part),
        walk as (select a.id as leaf, [b.id] as path, b.up from n a join n b on a.up = b.id union all select leaf, list_append(path, b.id), b.up from walk w join n b on w.up = b.id where not list_contains(path, b.id))
        select leaf as id, max(len(path)) as n, array_to_string(arg_max(path, len(path)), '/') as path from walk group by 1""",
    "q50_query_forms": f"""select conv_id, turn, sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) as form,
        len({lexemes_sql("text")}) as n_tokens,
        length(trim(text)) between 3 and 2000 as is_valid from conversations""",
}
