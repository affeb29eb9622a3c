"""The subpackage's queries over the test tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from provisio.llm import (
    embedding_dedup, exact_dedup, jaccard_join, lm_scoring, packing, pii, quality_classifier, quality_rules, sentencepiece_codec, source_divergence, storage, substring_dedup, token_counts, vector_codes,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded and decoded again."""
    return sentencepiece_codec.checked(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(_table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache of its own for each call, so that a call never profits from an earlier one."""
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), storage.scratch(spark, "token-cache"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removed_words(_table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.neighbours(_table(spark, sf_dir, "embeddings"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(_table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(_table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(_table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compressed(_table(spark, sf_dir, "embeddings"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(_table(spark, sf_dir, "documents"))


_ALL = (
    op1_sentencepiece,
    op2_ngram_jaccard_join,
    op3_token_counts,
    op4_substring_dedup,
    op5_best_fit_packing,
    op6_quality_classifier,
    op7_embedding_dedup,
    op8_lm_scoring,
    op9_quality_rules,
    op10_pii,
    op11_source_divergence,
    op12_vector_codes,
    op13_exact_dedup,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

_WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _codebook_sql(rounds: int = 4) -> str:
    """Codebooks c0, c1, ... and assignments a0, a1, ... of the parts, a pair of them a round."""
    nearest = "a{k} as (select x.vec_id, x.part, min((x.own - 2 * list_inner_product(x.x, c.x) + list_inner_product(c.x, c.x))::hugeint * 256 + c.entry) as found from piece x join c{k} c on x.part = c.part group by 1, 2)"
    mean = """c{n} as (select c.part, c.entry, coalesce(m.x, c.x) as x from c{k} c left join (select part, entry, list(v order by pos) as x from (
        select part, entry, pos, ((sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*))::double as v from (
          select a.part, (a.found % 256)::bigint as entry, unnest(x.x)::hugeint as v, unnest(range(1, len(x.x) + 1)) as pos from a{k} a join piece x on x.vec_id = a.vec_id and x.part = a.part) group by 1, 2, 3) group by 1, 2) m
        on c.part = m.part and c.entry = m.entry)"""
    return ", ".join([*(s.format(k=k, n=k + 1) for k in range(rounds) for s in (nearest, mean)), nearest.format(k=rounds)])


#: Only results that SQL expresses in full are compared with it; the others are tested against brute force.
SQL: dict[str, str] = {
    # links from all shingles; components by the smallest id reachable
    "op2_ngram_jaccard_join": f"""with recursive words as (select doc_id, list_filter(regexp_split_to_array(coalesce({_LOWER}, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as w from documents),
        sh as (select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from words),
        n as (select doc_id, count(*) as n from sh group by 1),
        common as (select a.doc_id as a, b.doc_id as b, count(*) as k from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
        link as (select a, b from common join n x on a = x.doc_id join n y on b = y.doc_id where 100 * k >= 80 * (x.n + y.n - k)),
        edge as (select a, b from link union select b, a from link),
        reach as (select doc_id as a, doc_id as b from documents union select r.a, e.b from reach r join edge e on r.b = e.a)
        select d.doc_id, coalesce(n.n, 0) as n_shingles, min(r.b) as component_id from documents d left join n on n.doc_id = d.doc_id join reach r on r.a = d.doc_id group by 1, 2""",
    # windows are compared as texts
    "op4_substring_dedup": f"""with words as (select doc_id, {_WORDS} as w from documents),
        win as (select doc_id, i, array_to_string(w[i:i + 19], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 18)) as i from words where len(w) >= 20)),
        late as (select doc_id, i from (select *, row_number() over (partition by s order by doc_id, i) as nth from win) where nth > 1),
        gone as (select distinct doc_id, unnest(range(i, i + 20)) as p from late),
        lists as (select doc_id, list(p) as ps from gone group by 1),
        kept as (select x.doc_id, len(w) as n, len(coalesce(ps, [])) as removed, list_filter(w, lambda v, i: not list_contains(coalesce(ps, []), i)) as k from words x left join lists using (doc_id))
        select doc_id, n as n_words, removed as n_removed, sha256(array_to_string(k, ' ')) as kept_sha256 from kept""",
    # shares of every kept term in every group
    "op11_source_divergence": f"""with d as (select row_number() over () as row, coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source from documents),
        tok as (select lang, source, row, unnest(regexp_extract_all({_LOWER}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from d),
        kept as (select lang, term from (select distinct lang, row, term from tok) group by 1, 2 having count(*) >= 10),
        grp as (select distinct lang, source from d),
        cnt as (select lang, source, term, count(*) as n from tok join kept using (lang, term) group by 1, 2, 3),
        dense as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, sum(coalesce(c.n, 0)) over (partition by g.lang, g.source) + 2 * count(*) over (partition by g.lang, g.source) as whole
                  from grp g join kept k using (lang) left join cnt c on c.lang = g.lang and c.source = g.source and c.term = k.term),
        p as (select *, 1 + (1000000000 * (n + 2)::hugeint) // whole as p from dense),
        every as (select lang, term, sum(n) as n from cnt group by 1, 2),
        q as (select lang, term, 1 + (1000000000 * (n + 2)::hugeint) // (sum(n) over (partition by lang) + 2 * count(*) over (partition by lang)) as q from every),
        far as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
        pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(f.value, 0) as value from grp a join grp b on a.lang = b.lang and a.source <> b.source left join far f on f.lang = a.lang and f.source = a.source and f.item = b.source),
        terms as (select p.lang, p.source, 'term' as part, p.term as item, (p - q) * (p - q) // (p + q) as value from p join q on p.lang = q.lang and p.term = q.term where p.n > 0 and p.p > q.q)
        select lang, source, part, item, cast(value as bigint) as value, row_number() over (partition by lang, source, part order by value desc, item) as rank from (select * from pairs union all select * from terms) qualify part = 'pair' or rank <= 10""",
    # rounds unrolled; a distance and an entry are one number, so that ties go to the lower entry
    "op12_vector_codes": f"""with kept as (select vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::double)) as v from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)),
        piece as (select vec_id, part, x, list_inner_product(x, x) as own from (select vec_id, part, v[part * (len(v) // 4) + 1 : (part + 1) * (len(v) // 4)] as x from kept, (select unnest(range(4)) as part))),
        c0 as (select part, nth - 1 as entry, x from (select *, row_number() over (partition by part order by vec_id) as nth from piece) where nth <= 256), {_codebook_sql()},
        code as (select vec_id, string_agg(printf('%02x', (found % 256)::bigint), '' order by part) as code, sum(found // 256)::bigint as error from a4 group by 1),
        books as (select sha256(string_agg(v::bigint::varchar, ',' order by part, entry, pos)) as h from (select part, entry, unnest(x) as v, unnest(range(len(x))) as pos from c4))
        select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, h as codebooks_sha256 from code join kept using (vec_id), books""",
    # by the whole normalised text
    "op13_exact_dedup": """with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') as t from documents)
        select doc_id, min(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size, row_number() over (partition by t order by doc_id) = 1 as kept, sha256(t) as text_sha256 from t""",
}
