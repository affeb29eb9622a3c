"""Act metadata, expressions, resources and relations from the official API's JSON, as DataFrames.

Responses come as files or rows; whoever fetches them is injected, so the plans have no hidden
network and a failed fetch (no row) never looks like an empty answer (a row without entries).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provisio.functions.text import is_iso_date, path_part

METADATA = (
    "publisher string, year int, pos int, title string, type string, status string, ELI string, announcementDate string, promulgation string, entryIntoForce string, "
    "validFrom string, legalStatusDate string, expirationDate string, changeDate string, inForce string, textHTML boolean, textPDF boolean, texts array<struct<fileName:string,type:string>>"
)
REFERENCES = "map<string,array<struct<act:struct<publisher:string,year:int,pos:int,title:string,type:string,status:string,promulgation:string,announcementDate:string,ELI:string>,date:string>>>"
API = "https://api.sejm.gov.pl/eli/acts"

# The labels of relations, the ids of expressions.
RELATIONS = {
    "Inf. o tekście jednolitym": "consolidated_text_announcement",
    "Tekst jednolity dla aktu": "consolidated_text_for_act",
    "Nowelizacje po tekście jednolitym": "post_consolidated_amendment",
    "Akty zmieniające": "amending_act",
    "Orzeczenie TK": "constitutional_tribunal",
    "Sprostowanie": "correction",
}
EXPRESSIONS = {"ogl": "promulgated", "tj": "consolidated", "uj": "unified"}


def lookup(c: Column, values: dict[str, str], other: str) -> Column:
    return F.coalesce(*(F.when(c == k, v) for k, v in values.items()), F.lit(other))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """One row per response with is_valid; what is not such JSON is kept as a row that is not valid."""
    rows = spark.read.schema(f"{METADATA}, _corrupt_record string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").option("multiLine", True).json(path)
    return rows.withColumn("is_valid", F.col("_corrupt_record").isNull() & valid())


def valid() -> Column:
    ok = F.col("title").isNotNull() & F.col("publisher").isNotNull() & (F.col("year") > 0) & (F.col("pos") > 0)
    for c in ("announcementDate", "promulgation", "entryIntoForce", "validFrom", "legalStatusDate", "expirationDate"):
        ok &= F.col(c).isNull() | is_iso_date(F.col(c))
    return F.coalesce(ok, F.lit(False))


def source_id() -> Column:
    return F.concat_ws("/", "publisher", F.col("year").cast("string"), F.col("pos").cast("string"))


def act_url() -> Column:
    return F.concat_ws("/", F.lit(API), path_part(F.col("publisher")), F.col("year").cast("string"), F.col("pos").cast("string"))


def acts(metadata: DataFrame) -> DataFrame:
    day = lambda c: F.try_to_date(c)
    text = F.lower("inForce")
    in_force = F.when(text.isin("true", "false"), text == "true").when(text.isNotNull(), text == "in_force")
    return metadata.select(
        F.lit("PL").alias("jurisdiction"), F.lit("eli").alias("source"), source_id().alias("source_id"), "title", F.coalesce("type", F.lit("unknown")).alias("act_type"),
        "publisher", F.col("year").alias("journal_year"), F.col("pos").alias("journal_position"), day(F.col("announcementDate")).alias("announcement_date"),
        day(F.col("promulgation")).alias("promulgation_date"), day(F.coalesce("entryIntoForce", "validFrom")).alias("entry_into_force_date"), day(F.col("expirationDate")).alias("expiration_date"),
        "status", in_force.alias("in_force"), F.coalesce("ELI", source_id()).alias("eli_uri"), act_url().alias("official_page_url"),
    )


def resources(metadata: DataFrame) -> DataFrame:
    """(source_id, source_url, file_name, representation_type, source_type_codes): a file's codes in order, joined."""
    rows = metadata.select(source_id().alias("source_id"), act_url().alias("base"), F.coalesce("textHTML", F.lit(False)).alias("has_html"), F.col("texts"))
    listed = rows.select("source_id", "base", F.explode("texts").alias("t"))
    code = F.coalesce(F.nullif(F.upper(F.trim("t.type")), F.lit("")), F.lit("UNKNOWN"))
    listed = listed.select("source_id", F.concat_ws("/", "base", path_part(F.col("t.fileName"))).alias("source_url"), F.col("t.fileName").alias("file_name"), code.alias("code"))
    html = F.coalesce(F.exists("texts", lambda t: F.lower(t["fileName"]).rlike(r"\.html?$")), F.lit(False))
    fallback = rows.where(F.col("has_html") & ~html).select("source_id", F.concat_ws("/", "base", F.lit("text.html")).alias("source_url"), F.lit("text.html").alias("file_name"), F.lit("UNKNOWN").alias("code"))
    grouped = listed.unionByName(fallback).groupBy("source_id", "source_url").agg(F.min("file_name").alias("file_name"), F.array_join(F.array_sort(F.collect_set("code")), ",").alias("source_type_codes"))
    name = F.lower("file_name")
    kind = F.when(name.endswith(".html") | name.endswith(".htm"), "html").when(name.endswith(".pdf"), "pdf").otherwise("other")
    return grouped.withColumn("representation_type", kind)


def expressions(metadata: DataFrame, reachable: DataFrame) -> DataFrame:
    """(source_id, expression, version_kind, authority_class, uri) of the expressions whose address answers; ``reachable``: uri."""
    uri = F.concat_ws("/", F.coalesce("ELI", source_id()), F.col("expression"))
    rows = metadata.withColumn("expression", F.explode(F.array(*map(F.lit, EXPRESSIONS)))).withColumn("uri", uri)
    kind = lookup(F.col("expression"), EXPRESSIONS, "unknown")
    return rows.join(reachable.select("uri").distinct(), "uri", "left_semi").select(source_id().alias("source_id"), "expression", kind.alias("version_kind"), authority(kind).alias("authority_class"), "uri")


def version_drafts(metadata: DataFrame, reachable: DataFrame) -> DataFrame:
    """A version for each expression that was found, none of them current: being reachable proves nothing.

    (source_id, expression, version_kind, authority_class, is_non_authoritative, canonical_uri,
    effective_from, source_document_key, source_updated_at, currentness_status, is_current)
    """
    dates = metadata.select(source_id().alias("source_id"), F.try_to_date(F.coalesce("validFrom", "entryIntoForce")).alias("effective_from"), F.try_to_timestamp("changeDate").alias("source_updated_at"))
    rows = expressions(metadata, reachable).join(dates.dropDuplicates(["source_id"]), "source_id")
    return rows.select(
        "source_id", "expression", "version_kind", "authority_class", (F.col("authority_class") == "non_authoritative").alias("is_non_authoritative"), F.col("uri").alias("canonical_uri"),
        "effective_from", F.concat(F.lit("expression:"), "expression").alias("source_document_key"), "source_updated_at", F.lit("unproven").alias("currentness_status"), F.lit(False).alias("is_current"),
    )


def resource_drafts(metadata: DataFrame, reachable: DataFrame) -> DataFrame:
    """(source_id, expression, source_url, file_name, source_type_codes, representation_type): one of each expression that was found, and the act's own files, which belong to no expression yet (null)."""
    found = expressions(metadata, reachable).select(
        "source_id", "expression", F.col("uri").alias("source_url"), F.concat("expression", F.lit(".eli")).alias("file_name"), F.lit("OFFICIAL_ELI_EXPRESSION").alias("source_type_codes"), F.lit("eli_expression").alias("representation_type"),
    )
    return found.unionByName(resources(metadata).withColumn("expression", F.lit(None).cast("string")))


def authority(kind: Column) -> Column:
    return F.when(kind == "unified", "non_authoritative").when(kind.isin("consolidated", "promulgated"), "authoritative").otherwise("unknown")


def relations(references: DataFrame) -> DataFrame:
    """(legal_act_id, relation_type, related_source_id, source_relation_type), the first label of each edge.

    ``references``: legal_act_id, json.  Unknown labels are kept as ``unrecognized``.
    """
    parsed = references.select("legal_act_id", F.from_json("json", REFERENCES).alias("m"))
    edges = parsed.select("legal_act_id", F.posexplode(F.map_entries("m")).alias("p", "e")).select("legal_act_id", "p", F.col("e.key").alias("label"), F.posexplode("e.value").alias("q", "x"))
    edges = edges.where("x.act is not null").select(
        "legal_act_id", lookup(F.col("label"), RELATIONS, "unrecognized").alias("relation_type"),
        F.concat_ws("/", "x.act.publisher", F.col("x.act.year").cast("string"), F.col("x.act.pos").cast("string")).alias("related_source_id"), "label", "p", "q",
    )
    return edges.groupBy("legal_act_id", "relation_type", "related_source_id").agg(F.min_by("label", F.struct("p", "q")).alias("source_relation_type"))


def mutually_referenced(edges: DataFrame) -> DataFrame:
    """Announcements that name their act and are named by it: (act, announcement)."""
    there = edges.where("relation_type = 'consolidated_text_announcement'").select(F.col("legal_act_id").alias("act"), F.col("related_source_id").alias("announcement"))
    back = edges.where("relation_type = 'consolidated_text_for_act'").select(F.col("related_source_id").alias("act"), F.col("legal_act_id").alias("announcement"))
    return there.join(back, ["act", "announcement"], "left_semi").distinct()
