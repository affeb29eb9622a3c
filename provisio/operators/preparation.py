"""A corpus prepared in one chain: what is fetched, what it changes, which texts become revisions, and what has to be indexed.

All acts of the scope go through each step together, three rounds of requests deep: the acts, their
announcements, and the amendments and rulings that these name.  An act whose requests failed
changes nothing; in particular its relations stay active, as a failed reply is no empty one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provisio.operators import indexing, ingest, merge
from provisio.sources import fetching, html_units, metadata, pdf_bytes, pdf_lines

ANNOUNCEMENT, AMENDMENT, RULING = "consolidated_text_announcement", "post_consolidated_amendment", "constitutional_tribunal"
VERSION = ["version_kind", "authority_class", "canonical_uri", "effective_from", "source_updated_at", "currentness_status", "is_current"]
RESOURCE = ["expression", "file_name", "source_type_codes", "representation_type"]
Kept = Callable[[DataFrame, str], DataFrame]


@dataclass(frozen=True)
class Replies:
    """``acts``: source_id, with_references, error and metadata; ``references``: legal_act_id, json; ``reachable``: uri."""

    acts: DataFrame
    references: DataFrame
    reachable: DataFrame

    def fine(self) -> DataFrame:
        return self.acts.where("error is null")


def _round(ids: DataFrame, fetch: fetching.Caller, kept: Kept, name: str, references: bool, **how) -> Replies:
    """One round: metadata, references if they are wanted, and probes of the expressions; an act has one error, its first."""
    asked = ingest.with_source_parts(ids.select("source_id").distinct(), "source_id").where("publisher is not null").withColumnRenamed("position", "pos")
    read = fetching.act_metadata(fetching.fetched(fetching.requests(asked), fetch, **how))
    own = kept(read.withColumn("asked_id", F.col("asked.source_id")).drop("asked", "http_status"), f"{name}_metadata")
    failed = own.where("error is not null").select("asked_id", "error")
    found = own.where("error is null")
    uris = found.select("asked_id", F.explode(F.array(*map(F.lit, metadata.EXPRESSIONS))).alias("expression"), F.coalesce("ELI", metadata.source_id()).alias("eli"))
    uris = uris.select("asked_id", F.concat_ws("/", "eli", "expression").alias("uri"))
    probes = kept(fetching.probed(uris, fetch, **how), f"{name}_probes")
    failed = failed.unionByName(probes.where("error is not null").select("asked_id", "error"))
    json = own.select(F.col("asked_id").alias("legal_act_id"), F.lit(None).cast("string").alias("json")).limit(0)
    if references:
        told = fetching.act_references(fetching.fetched(fetching.requests(asked, references=True), fetch, **how))
        told = kept(told.select(F.col("asked.source_id").alias("legal_act_id"), "error", "json"), f"{name}_references")
        failed = failed.unionByName(told.where("error is not null").select(F.col("legal_act_id").alias("asked_id"), "error"))
        json = told.where("error is null").select("legal_act_id", "json")
    errors = failed.groupBy("asked_id").agg(F.min("error").alias("error"))
    acts = own.drop("error").join(errors, "asked_id", "left").withColumn("with_references", F.lit(references)).withColumnRenamed("asked_id", "source_id")
    fine = json.join(errors, F.col("legal_act_id") == F.col("asked_id"), "left_anti")
    return Replies(acts, fine, probes.where("is_available").select("uri"))


def requested(scope: DataFrame, fetch: fetching.Caller, kept: Kept, **how) -> Replies:
    """Everything that a run over ``scope`` (source_id) asks for.

    ``kept`` writes a round's replies and reads them back, so that nothing is asked twice; ``how``:
    attempts and callers of ``fetching``.  An act is asked for in the first round that names it.
    """
    first = _round(scope, fetch, kept, "acts", True, **how)
    edges = metadata.relations(first.references)
    named = lambda of, kind: of.where(F.col("relation_type") == kind).select(F.col("related_source_id").alias("source_id")).distinct()
    second = _round(named(edges, ANNOUNCEMENT).join(scope, "source_id", "left_anti"), fetch, kept, "announcements", True, **how)
    others = named(metadata.relations(second.references), AMENDMENT).unionByName(named(edges, RULING)).distinct()
    known = first.acts.select("source_id").unionByName(second.acts.select("source_id"))
    third = _round(others.join(known, "source_id", "left_anti"), fetch, kept, "others", False, **how)
    rounds = (first, second, third)
    joined = [getattr(rounds[0], f).unionByName(getattr(rounds[1], f)).unionByName(getattr(rounds[2], f)) for f in ("acts", "references", "reachable")]
    return Replies(*joined)


def choices(scope: DataFrame, replies: Replies, *, current_only: bool = False) -> DataFrame:
    """(base, announcement, choice): html, or pdf if there is no HTML text, or unavailable, or failed if the announcement's metadata are not known.

    ``current_only``: of each act only the announcement that was promulgated last (of equals, the
    greatest id); the others are skipped, and all are unresolved if any one's date is not known.
    """
    edges = metadata.relations(replies.references).where(F.col("relation_type") == ANNOUNCEMENT)
    chain = edges.join(scope.select(F.col("source_id").alias("legal_act_id")).distinct(), "legal_act_id", "left_semi").select(F.col("legal_act_id").alias("base"), F.col("related_source_id").alias("announcement"))
    told = replies.acts.where("title is not null").select(F.col("source_id").alias("announcement"), F.coalesce("textHTML", F.lit(False)).alias("html"), F.coalesce("textPDF", F.lit(False)).alias("pdf"), "promulgation", F.lit(True).alias("known"))
    rows = chain.join(told, "announcement", "left")
    choice = F.when(F.col("known").isNull(), "failed").when(F.col("html"), "html").when(F.col("pdf"), "pdf").otherwise("unavailable")
    if current_only:
        last = rows.groupBy("base").agg(F.bool_and(F.col("promulgation").isNotNull()).alias("dated"), F.max(F.struct("promulgation", "announcement"))["announcement"].alias("last"))
        rows = rows.join(last, "base")
        choice = F.when(~F.col("dated"), "unresolved").when(F.col("announcement") != F.col("last"), "skipped").otherwise(choice)
    return rows.select("base", "announcement", choice.alias("choice"))


def parsed_texts(chosen: DataFrame, html: DataFrame, pdf: DataFrame) -> DataFrame:
    """(base, announcement, choice, provision columns, error) of the texts chosen: ``html`` (announcement, html), ``pdf`` (announcement, content); a text that did not come, or was refused, is one row with its error."""
    of = lambda kind: chosen.where(F.col("choice") == kind).select("announcement").distinct()
    a = html_units.units(html.join(of("html"), "announcement", "left_semi"), key="announcement", annex=True)
    pieces = pdf_bytes.pieces(pdf.join(of("pdf"), "announcement", "left_semi").select(F.col("announcement").alias("path"), "content"))
    b = pdf_lines.units(pdf_lines.visual_lines(pieces), key="document").unionByName(pdf_bytes.refused(pieces), allowMissingColumns=True).withColumnRenamed("document", "announcement")
    every = a.withColumn("choice", F.lit("html")).unionByName(b.withColumn("choice", F.lit("pdf")))
    rows = chosen.where("choice in ('html', 'pdf')").join(every, ["announcement", "choice"], "left")
    nothing = F.col("structural_path").isNull() & F.col("error").isNull()
    return rows.withColumn("error", F.when(nothing, "no text").otherwise(F.col("error")))


def _merged_of(old: DataFrame, new: DataFrame, synced: DataFrame, keys: list[str], compared: list[str]) -> DataFrame:
    """A merge of the rows of acts that were synced; others stay as they are."""
    rest = old.join(synced, "source_id", "left_anti").select(*keys, *compared).withColumn("action", F.lit("unchanged"))
    return merge.merged(old.join(synced, "source_id", "left_semi"), new, keys, compared).unionByName(rest)


def prepared(scope: DataFrame, replies: Replies, html: DataFrame, pdf: DataFrame, old: dict[str, DataFrame], now: Column, compared: list[str], *, kept: Kept, current_only: bool = False) -> dict[str, DataFrame]:
    """What a run changes, each table as the merge that results.

    ``old``: acts (id, source_id, ``compared``), versions (id, legal_act_id, expression,
    source_announcement_legal_act_id, content_hash, ``VERSION``), resources (source_id, source_url,
    ``RESOURCE``), relations (see ``merge.merged_relations``), provisions, documents (id, version_id,
    content_hash).  Acts are known by their source ids in versions and relations.

    Returns acts, expressions, resources, relations; report (base, announcement, choice, outcome,
    version_id, error), versions and provisions to append; documents (id, version_id, action) of the
    versions that the run reached, to be embedded, kept or removed.
    """
    fine = replies.fine()
    synced = fine.select("source_id").distinct()
    fresh = metadata.acts(fine.drop("source_id")).dropDuplicates(["source_id"])
    acts = _merged_of(old["acts"], fresh.select("source_id", *compared), synced, ["source_id"], compared)
    known = acts.select("source_id").join(old["acts"].select("source_id", "id"), "source_id", "left").select("source_id", F.coalesce("id", "source_id").alias("id"))

    rows = fine.drop("source_id")
    expressions = metadata.version_drafts(rows, replies.reachable)
    own = old["versions"].where("source_announcement_legal_act_id is null").withColumnRenamed("legal_act_id", "source_id")
    expressions = _merged_of(own, expressions, synced, ["source_id", "expression"], VERSION)
    resources = _merged_of(old["resources"], metadata.resource_drafts(rows, replies.reachable), synced, ["source_id", "source_url"], RESOURCE)

    # relations of acts whose references came; those of all others are left alone
    listed = replies.references.join(synced.withColumnRenamed("source_id", "legal_act_id"), "legal_act_id", "left_semi")
    asked = listed.select("legal_act_id").distinct()
    mine = merge.merged_relations(old["relations"].join(asked, "legal_act_id", "left_semi"), metadata.relations(listed), known, now)
    rest = old["relations"].join(asked, "legal_act_id", "left_anti").withColumn("action", F.lit("unchanged"))
    relations = kept(mine.unionByName(rest.select(*mine.columns)), "relations")

    chosen = kept(choices(scope, replies, current_only=current_only), "choices")
    texts = kept(parsed_texts(chosen, html, pdf), "texts")
    edges = relations.where("is_active").select("legal_act_id", "relation_type", "related_source_id")
    outcomes, appended, provisions = ingest.revisions(texts.drop("choice", "error"), known, edges, old["versions"], old["provisions"])
    outcomes = kept(outcomes, "outcomes")
    errors = texts.where("error is not null").select("base", "announcement", "error").distinct()
    report = chosen.join(outcomes.select("base", "announcement", "outcome", "version_id"), ["base", "announcement"], "left").join(errors, ["base", "announcement"], "left")
    report = report.withColumn("outcome", F.coalesce("outcome", "choice"))

    named = lambda c: F.concat_ws(":", "version_id", F.col(c)).alias(c)
    rest = [c for c in provisions.columns if c not in ("id", "parent_id")]
    provisions = kept(provisions.select(named("id"), F.when(F.col("parent_id").isNotNull(), F.concat_ws(":", "version_id", "parent_id")).alias("parent_id"), *rest), "provisions")
    reached = outcomes.where("version_id is not null").select("version_id", F.col("base").alias("source_id"))
    every = old["provisions"].join(reached, "version_id", "left_semi").unionByName(provisions, allowMissingColumns=True)
    titles = reached.join(fresh.select("source_id", "title"), "source_id").select("version_id", "title")
    drafts = indexing.drafts(every, titles)
    before = old["documents"].join(reached, "version_id", "left_semi")
    documents = indexing.difference(before, drafts).join(drafts.select("id", "version_id").unionByName(before.select("id", "version_id")).distinct(), "id")
    return {"acts": acts, "expressions": expressions, "resources": resources, "relations": relations, "report": report, "versions": appended, "provisions": provisions, "documents": documents}
