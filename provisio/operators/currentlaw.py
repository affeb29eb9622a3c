"""Which revision of each act is current law as of a date, decided for all acts at once and fail-closed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provisio import shared

#: Kinds of version in the order of preference.
KINDS = ("promulgated", "consolidated", "unified", "unknown")


def applies(promulgated: Column, expires: Column, as_of: Column) -> Column:
    return F.coalesce((promulgated <= as_of) & (expires.isNull() | (expires > as_of)), F.lit(False))


def applicable(announcements: DataFrame, as_of: Column) -> DataFrame:
    """(act, n_applicable, announcement): the announcement that applies if exactly one does.

    ``announcements``: act, announcement, promulgated, expires.
    """
    hit = applies(F.col("promulgated"), F.col("expires"), as_of)
    found = announcements.groupBy("act").agg(F.count_if(hit).alias("n_applicable"), F.max(F.when(hit, F.col("announcement"))).alias("announcement"))
    return found.withColumn("announcement", F.when(F.col("n_applicable") == 1, F.col("announcement")))


def latest_announcement(announcements: DataFrame) -> DataFrame:
    """(act, announcement): the last by date and id; none if any date of the chain is missing."""
    return announcements.groupBy("act").agg(
        F.when(F.count_if(F.col("promulgated").isNull()) == 0, F.max_by("announcement", F.struct("promulgated", "announcement"))).alias("announcement")
    )


def newest_well_formed(versions: DataFrame, well_formed: Column, keys: list[str], order: list[Column]) -> DataFrame:
    """The newest well-formed version of each key, whether structured or not: an older one never stands in for it."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return versions.where(well_formed).withColumn("__nth", nth).where("__nth = 1").drop("__nth")


def representatives(versions: DataFrame, act: str = "act") -> DataFrame:
    """One version of each act and kind, and n_backed, how many announcements back versions of the act.

    If any version of the kind is backed by an announcement, only those count; then structured ones
    come first, official ids, later state dates and smaller ids.
    """
    order = [F.desc("backed"), F.desc("structured"), F.desc("official"), F.desc_nulls_last("state_date"), F.asc("id")]
    nth = F.row_number().over(Window.partitionBy(act, "kind").orderBy(*order))
    backed = F.count_if("backed").over(Window.partitionBy(act))
    return versions.withColumns({"nth": nth, "n_backed": backed}).where("nth = 1").drop("nth")


def display_version(versions: DataFrame, act: str = "act") -> DataFrame:
    """(act, authoritative, retrieval, default_id, warning) from the representatives.

    ``retrieval`` prefers unified, then consolidated, then promulgated; ``authoritative`` consolidated,
    then promulgated.  By default the authoritative one is shown if it is structured, else the one for
    retrieval, else any structured version, else whatever there is.
    """
    one = representatives(versions, act)
    pick = lambda kind, field: F.max(F.when(F.col("kind") == kind, F.col(field)))
    wide = one.groupBy(act).agg(*(pick(k, f).alias(f"{k}_{f}") for k in KINDS for f in ("id", "structured")), F.max("n_backed").alias("n_backed"))
    first = lambda kinds: F.coalesce(*(F.col(f"{k}_id") for k in kinds))
    ready = lambda kinds: F.coalesce(*(F.when(F.col(f"{k}_id").isNotNull(), F.coalesce(f"{k}_structured", F.lit(False))) for k in kinds), F.lit(False))
    authority, retrieval = ("consolidated", "promulgated"), ("unified", "consolidated", "promulgated")
    structured = versions.where("structured").withColumn("rank", F.when(F.col("kind").isin(*authority), 0).otherwise(1))
    kind_order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    any_one = structured.groupBy(act).agg(F.min_by("id", F.struct("rank", kind_order, "id")).alias("any_structured"))
    wide = wide.join(any_one, act, "left")
    shown = F.when(ready(authority), first(authority)).when(ready(retrieval), first(retrieval)).otherwise(F.coalesce("any_structured", first(authority), first(retrieval), first(KINDS)))
    warning = (
        F.when(F.col("n_backed") > 1, "several announcements")
        .when(ready(authority), F.lit(None))
        .when(ready(retrieval), "authoritative version has no structure")
        .when(F.col("any_structured").isNotNull(), "preferred versions have no structure")
        .otherwise("no version has structure")
    )
    return wide.select(act, first(authority).alias("authoritative"), first(retrieval).alias("retrieval"), shown.alias("default_id"), warning.alias("warning"))


#: The ladder's steps in order: (reason, condition); the first that holds decides.  One text serves both engines.
LADDER = (
    ("act_not_in_force", "in_force is not true or coalesce(act_expires <= as_of, false)"),
    ("no_official_consolidated_version", "n_chain = 0"),
    ("metadata_incomplete", "n_unresolved_chain > 0"),
    ("no_official_consolidated_version", "n_applicable = 0"),
    ("metadata_incomplete", "n_applicable > 1"),
    ("metadata_incomplete", "n_versions > 0 and n_well_formed = 0"),
    ("latest_tj_content_unavailable", "n_versions = 0 or newest_structured is not true"),
    ("unresolved_temporal_effect", "n_amendment_unresolved > 0"),
    ("effective_post_tj_amendment", "n_amendment_effective > 0"),
    ("correction_unresolved", "n_correction > 0"),
    ("unresolved_constitutional_tribunal_effect", "n_tribunal_unresolved > 0 or (n_tribunal > 0 and (state_date is null or coalesce(tribunal_date > state_date, true)))"),
)
INCLUDED = "authoritative_current"


def ladder_sql() -> str:
    return "case " + " ".join(f"when {c} then '{r}'" for r, c in LADDER) + f" else '{INCLUDED}' end"


def decided(candidates: DataFrame) -> DataFrame:
    """``candidates`` (a row for each act with the ladder's inputs) with reason_code and decision."""
    rows = candidates.withColumn("reason_code", F.expr(ladder_sql()))
    return rows.withColumn("decision", F.when(F.col("reason_code") == INCLUDED, "included").otherwise("excluded"))


def run_summary(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("reason_code").agg(F.count("*").alias("n"))


#: Hexadecimal digits of an act's digest that say in which leaf of the tree it is.
LEVELS = 3


def hash_tree(decisions: DataFrame, act: str = "act") -> DataFrame:
    """(prefix, n, digest) of every range of acts, the ranges of a digest of the act: leaves of LEVELS digits, up to the empty prefix.

    ``decisions``: act, decision, reason_code, version_id.  A leaf's digest is that of its entries as
    JSON lines in the order of the acts, an inner node's that of its children's in order.  No row
    holds all acts, and the tree does not depend on how rows are dealt out.
    """
    entry = F.to_json(F.struct(F.col(act).alias("act"), "decision", "reason_code", "version_id"), {"ignoreNullFields": "false"})
    key = F.col(act).cast("string")
    rows = decisions.select(F.substring(F.sha2(key, 256), 1, LEVELS).alias("prefix"), F.struct(key.alias("k"), entry.alias("v")).alias("x"))
    level = rows.groupBy("prefix").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda r: r["v"]), "\n"), 256).alias("digest"))
    tree = level = shared.cut(level, "hash-leaves")
    for digits in range(LEVELS - 1, -1, -1):
        child = F.struct("prefix", "digest")
        level = level.groupBy(F.substring("prefix", 1, digits).alias("up")).agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(child)), lambda r: F.concat(r["prefix"], F.lit(":"), r["digest"])), "\n"), 256).alias("digest"))
        level = level.withColumnRenamed("up", "prefix")
        tree = tree.unionByName(level)
    return tree


def selection_hash(decisions: DataFrame, ruleset_version: str, effective_as_of: str, act: str = "act") -> DataFrame:
    """One row: digest of the rules, the date and the tree of all entries; a run without entries has one too."""
    root = hash_tree(decisions, act).where("prefix = ''").agg(F.coalesce(F.max("digest"), F.lit("")).alias("root"))
    return root.select(F.sha2(F.concat_ws("\n", F.lit(ruleset_version), F.lit(effective_as_of), "root"), 256).alias("selection_hash"))


def changed_entries(old: DataFrame, new: DataFrame, act: str = "act") -> DataFrame:
    """(act, was, now): entries that two runs do not share, as JSON, null where there is none; only leaves of the tree whose digests differ are compared."""
    leaf = lambda rows: hash_tree(rows, act).where(F.length("prefix") == LEVELS).select("prefix", "digest")
    same = leaf(old).join(leaf(new), ["prefix", "digest"]).select("prefix")
    entry = F.to_json(F.struct("decision", "reason_code", "version_id"), {"ignoreNullFields": "false"})
    of = lambda rows, name: rows.withColumn("prefix", F.substring(F.sha2(F.col(act).cast("string"), 256), 1, LEVELS)).join(same, "prefix", "left_anti").select(act, entry.alias(name))
    return of(old, "was").join(of(new, "now"), act, "full").where(~F.col("was").eqNullSafe(F.col("now")))


def latest_usable_run(runs: DataFrame, entries: DataFrame) -> DataFrame:
    """The newest run with an entry that is included and ready."""
    usable = runs.join(entries.where("decision = 'included' and runtime_ready").select("run_id").distinct(), "run_id", "left_semi")
    return usable.agg(F.max_by("run_id", F.struct("generated_at", "run_id")).alias("run_id"))


def only_today(effective: Column, now: Column) -> Column:
    """The date a run may be made for: today's, by the caller's clock; any other is an error."""
    return F.when(effective == F.to_date(now), effective).otherwise(F.raise_error(F.lit("a run can only be made for today")).cast("date"))


def is_well_formed(announcement: Column) -> Column:
    """A version that is what an announcement's consolidated text must be."""
    return (F.col("version_kind") == "consolidated") & (F.col("source_expression_id") == "tj") & (F.col("authority_class") == "authoritative") & (F.col("source_announcement_legal_act_id") == announcement)


# Relations that count for an act, and for its announcement.
ACT_RELATIONS = ("consolidated_text_announcement", "correction", "constitutional_tribunal")
ANNOUNCEMENT_RELATIONS = ("post_consolidated_amendment", "correction")


def active(relations: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """Active relations of the given types; those of an act and of its announcement are asked for apart and never mixed."""
    return relations.where(F.col("is_active") & F.col("relation_type").isin(*types))


def candidates(acts: DataFrame, versions: DataFrame, relations: DataFrame, as_of: Column) -> DataFrame:
    """The ladder's inputs for every act, for ``decided``: act, version_id and the counts and dates of ``LADDER``.

    ``acts``: id, in_force, promulgation_date, expiration_date, entry_into_force_date; ``versions``: id,
    legal_act_id, version_kind, source_expression_id, authority_class, source_announcement_legal_act_id,
    has_structure, legal_state_date, created_at; ``relations``: legal_act_id, relation_type,
    related_legal_act_id, is_active.  All acts are decided by the same joins; none is looped over.
    Of newest versions that share an id, structured ones come first, then later state dates, as in ``representatives``.
    """
    related = acts.select(F.col("id").alias("related_legal_act_id"), F.lit(True).alias("known"), F.col("promulgation_date").alias("promulgated"), F.col("expiration_date").alias("expires"), F.col("entry_into_force_date").alias("enters"))
    own = active(relations, ACT_RELATIONS).join(related, "related_legal_act_id", "left")
    chain = own.where("relation_type = 'consolidated_text_announcement'")
    hit = applies(F.col("promulgated"), F.col("expires"), as_of)
    chain = chain.groupBy(F.col("legal_act_id").alias("act")).agg(
        F.count("*").alias("n_chain"), F.count_if(F.col("known").isNull()).alias("n_unresolved_chain"), F.count_if(hit).alias("n_applicable"), F.max(F.when(hit, F.col("related_legal_act_id"))).alias("announcement"),
    )
    one = chain.where("n_applicable = 1").select("act", "announcement")
    # versions of the act that this announcement backs
    backed = versions.join(one, (F.col("legal_act_id") == F.col("act")) & (F.col("source_announcement_legal_act_id") == F.col("announcement")))
    counts = backed.groupBy("act").agg(F.count("*").alias("n_versions"), F.count_if(is_well_formed(F.col("announcement"))).alias("n_well_formed"))
    newest = newest_well_formed(backed, is_well_formed(F.col("announcement")), ["act"], [F.desc("created_at"), F.desc("id"), F.desc("has_structure"), F.desc("legal_state_date")])
    newest = newest.select("act", F.col("id").alias("version_id"), F.col("has_structure").alias("newest_structured"), F.col("legal_state_date").alias("state_date"))
    later = active(relations, ANNOUNCEMENT_RELATIONS).join(related, "related_legal_act_id", "left").join(one.withColumnRenamed("announcement", "legal_act_id"), "legal_act_id")
    amends = F.col("relation_type") == "post_consolidated_amendment"
    later = later.groupBy("act").agg(
        F.count_if(amends & F.col("enters").isNull()).alias("n_amendment_unresolved"), F.count_if(amends & (F.col("enters") <= as_of)).alias("n_amendment_effective"), F.count_if(~amends).alias("n_correction_there"),
    )
    rulings = own.groupBy(F.col("legal_act_id").alias("act")).agg(
        F.count_if(F.col("relation_type") == "correction").alias("n_correction_here"),
        F.count_if(F.col("relation_type") == "constitutional_tribunal").alias("n_tribunal"),
        F.count_if((F.col("relation_type") == "constitutional_tribunal") & F.col("enters").isNull()).alias("n_tribunal_unresolved"),
        F.max(F.when(F.col("relation_type") == "constitutional_tribunal", F.col("enters"))).alias("tribunal_date"),
    )
    rows = acts.select(F.col("id").alias("act"), "in_force", F.col("expiration_date").alias("act_expires"), as_of.alias("as_of"))
    for x in (chain.drop("announcement"), counts, newest, later, rulings):
        rows = rows.join(x, "act", "left")
    zero = ("n_chain", "n_unresolved_chain", "n_applicable", "n_versions", "n_well_formed", "n_amendment_unresolved", "n_amendment_effective", "n_correction_there", "n_correction_here", "n_tribunal", "n_tribunal_unresolved")
    rows = rows.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in zero})
    return rows.withColumn("n_correction", F.col("n_correction_here") + F.col("n_correction_there"))


def appended_run(entries: DataFrame, new: DataFrame) -> DataFrame:
    """Entries with those of a run appended; a run that is there already is never changed, and an act has one entry in a run."""
    fresh = new.dropDuplicates(["run_id", "act"]).join(entries.select("run_id").distinct(), "run_id", "left_anti")
    return entries.unionByName(fresh)


def pinned_scope(runs: DataFrame, entries: DataFrame, pinned: DataFrame) -> DataFrame:
    """(run_id, effective_as_of, version_ids) of pinned runs, never of the latest one: what is included and ready; a run without any, or unknown, has no row."""
    ready = entries.where("decision = 'included' and runtime_ready").groupBy("run_id").agg(F.array_sort(F.collect_set("version_id")).alias("version_ids"))
    return pinned.select("run_id").distinct().join(runs.select("run_id", "effective_as_of"), "run_id").join(ready, "run_id")
