"""Views of the test tables that stand for the engine's own tables, in Spark and in SQL."""

from __future__ import annotations

from functools import lru_cache
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provisio.functions.text import FOLD_FROM, FOLD_TO

if TYPE_CHECKING:
    from provisio.operators.vector_index import VectorIndex

AS_OF = "date '1998-01-01'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A page's content up to its first line, an annex's heading in the letters of ``pdf_of``.
ANNEX_SHOWN = r"BT /F1 10 Tf 1 0 0 1 50 700 Tm (Za\263\271cznik do obwieszczenia) Tj "


def pdf_of(shown: str) -> Column:
    """The bytes of a PDF file of one page with the content of a column; 179 and 185 are letters by the encoding's differences."""
    head = (
        "%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n2 0 obj << /Type /Pages /Kids [3 0 R] /Count 1 >> endobj\n"
        "3 0 obj << /Type /Page /Contents 4 0 R /Resources << /Font << /F1 << /Type /Font /Subtype /Type1 /Encoding << /Differences [179 /lslash 185 /aogonek] >> >> >> >> >> endobj\n"
    )
    whole = F.concat(F.lit(head + "4 0 obj << /Length "), F.length(shown).cast("string"), F.lit(" >> stream\n"), shown, F.lit("\nendstream endobj\ntrailer << /Root 1 0 R >>\n%%EOF"))
    return F.encode(whole, "ISO-8859-1")


# The tree region > nation > customer > order; customers have text of their own.
GEO_SQL = """
select concat('r', r_regionkey) as id, cast(null as varchar) as parent_id, 'division' as provision_type, r_name as label, r_name as text from region
union all select concat('n', n_nationkey), concat('r', n_regionkey), 'article', n_name, n_name from nation
union all select concat('c', c_custkey), concat('n', c_nationkey), 'clause', c_name, concat(c_name, ' ', c_mktsegment) from customer
union all select concat('o', o_orderkey), concat('c', o_custkey), 'point', o_orderpriority, concat(o_orderpriority, ' ', o_orderstatus) from orders
"""


def geo_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lambda c: F.col(c).cast("string")

    def level(name: str, mark: str, key: str, parent: tuple[str, str] | None, kind: str, label: str, own: list[str]) -> DataFrame:
        up = F.concat(F.lit(parent[0]), s(parent[1])) if parent else F.lit(None).cast("string")
        return table(spark, sf_dir, name).select(
            F.concat(F.lit(mark), s(key)).alias("id"), up.alias("parent_id"), F.lit(kind).alias("provision_type"), F.col(label).alias("label"), F.concat_ws(" ", *own).alias("text")
        )

    return (
        level("region", "r", "r_regionkey", None, "division", "r_name", ["r_name"])
        .unionByName(level("nation", "n", "n_nationkey", ("r", "n_regionkey"), "article", "n_name", ["n_name"]))
        .unionByName(level("customer", "c", "c_custkey", ("n", "c_nationkey"), "clause", "c_name", ["c_name", "c_mktsegment"]))
        .unionByName(level("orders", "o", "o_orderkey", ("c", "o_custkey"), "point", "o_orderpriority", ["o_orderpriority", "o_orderstatus"]))
    )


# An act's chain of announcements: its customer's orders, valid until the next one; some dates are missing.
ANNOUNCEMENTS_SQL = """
select o_custkey as act, o_orderkey as announcement, case when o_orderkey % 37 = 0 then null else o_orderdate end as promulgated,
       case when o_orderkey % 11 = 0 then null else lead(o_orderdate) over (partition by o_custkey order by o_orderdate, o_orderkey) end as expires
from orders where o_custkey % 29 <> 0
"""


def announcements(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    by = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").where("o_custkey % 29 <> 0").select(
        F.col("o_custkey").alias("act"), F.col("o_orderkey").alias("announcement"),
        F.when(F.col("o_orderkey") % 37 != 0, F.col("o_orderdate")).alias("promulgated"), F.when(F.col("o_orderkey") % 11 != 0, F.lead("o_orderdate").over(by)).alias("expires"),
    )


# An order's lines as revisions of an act.
VERSION_ID = "concat_ws('-', l_linenumber, l_partkey, l_suppkey)"
VERSIONS_SQL = f"""
select l_orderkey as act, {VERSION_ID} as id, case l_partkey % 3 when 0 then 'promulgated' when 1 then 'consolidated' else 'unified' end as kind,
       l_suppkey % 5 = 0 as backed, l_returnflag <> 'N' as structured, l_linestatus = 'O' as official, cast(l_shipdate as date) as state_date
from lineitem
"""


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("l_partkey") % 3 == 0, "promulgated").when(F.col("l_partkey") % 3 == 1, "consolidated").otherwise("unified")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("act"), F.expr(VERSION_ID).alias("id"), kind.alias("kind"), F.expr("l_suppkey % 5 = 0").alias("backed"),
        F.expr("l_returnflag <> 'N'").alias("structured"), F.expr("l_linestatus = 'O'").alias("official"), F.col("l_shipdate").cast("date").alias("state_date"),
    )


# Tokens as lexemes with their places.
def lexemes_sql(column: str) -> str:
    """The lexemes of a text column as a list."""
    return f"list_filter(regexp_split_to_array(lower(translate({column}, '{FOLD_FROM}', '{FOLD_TO}')), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


def tokens_sql(where: str = "true") -> str:
    """(id, tok, pos) of the documents."""
    return (
        "select id, toks[i] as tok, i - 1 as pos from (select id, toks, unnest(range(1, len(toks) + 1)) as i "
        f"from (select doc_id as id, {lexemes_sql('text')} as toks from documents where {where}))"
    )


@lru_cache(maxsize=8)
def _lexical_index(application: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    from provisio.operators import lexical_index

    return lexical_index.built(table(spark, sf_dir, "documents"), id_col="doc_id")


def documents_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lexical index of the documents, built once by an application."""
    return _lexical_index(spark.sparkContext.applicationId, spark, sf_dir)


@lru_cache(maxsize=8)
def _vector_index(application: str, spark: SparkSession, sf_dir: str) -> VectorIndex:
    from provisio.operators import vector_index

    return vector_index.built(table(spark, sf_dir, "embeddings"), id_col="vec_id")


def embeddings_index(spark: SparkSession, sf_dir: str) -> VectorIndex:
    """The vector index of the embeddings, built once by an application."""
    return _vector_index(spark.sparkContext.applicationId, spark, sf_dir)
