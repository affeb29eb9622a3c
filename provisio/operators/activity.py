"""What visitors do: history, saved items and folders, with retention, quotas and first-come admission.

Requests are rows in order of arrival, so admission is a matter of windows; a visitor's rows never
meet another's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provisio.functions import text

# Limits.
HISTORY_LISTED, SAVED_LISTED, SAVED_QUOTA, FOLDER_QUOTA, RETENTION_DAYS, RETENTION_ROWS = 100, 200, 100, 25, 90, 300


def listed(rows: DataFrame, limit: int, most: int, valid: Column | None = None) -> DataFrame:
    """Newest first; malformed rows are dropped after the limit."""
    out = rows.orderBy(F.desc("created_at"), F.desc("id")).limit(min(limit, most))
    return out if valid is None else out.where(valid)


def bucket(created: Column, now: Column) -> Column:
    """today, yesterday, this_week or older, by calendar days."""
    days = F.datediff(F.to_date(now), F.to_date(created))
    return F.when(days <= 0, "today").when(days == 1, "yesterday").when(days <= 7, "this_week").otherwise("older")


def filtered(rows: DataFrame, now: Column, *, status: str | None = None, day: str | None = None, term: str | None = None) -> DataFrame:
    if status:
        rows = rows.where(F.col("status") == status)
    if day:
        rows = rows.where(bucket(F.col("created_at"), now) == day)
    if term and term.strip():
        rows = rows.where(F.contains(F.lower("query"), F.lit(term.strip().lower())))
    return rows


def retained(rows: DataFrame, now: Column, *, days: int = RETENTION_DAYS, most: int = RETENTION_ROWS, by: str = "visitor_id") -> DataFrame:
    """What clean-up leaves: rows not older than ``days``, of these the newest ``most`` of each visitor."""
    for limit in (days, most):
        if not isinstance(limit, int) or limit <= 0:
            raise ValueError("limits are positive whole numbers")
    young = rows.where(F.col("created_at") >= now - F.make_dt_interval(F.lit(days)))
    nth = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("created_at"), F.desc("id")))
    return young.withColumn("__nth", nth).where(F.col("__nth") <= most).drop("__nth")


def cleared(rows: DataFrame, visitor: object, start: Column | None = None, end: Column | None = None, by: str = "visitor_id") -> DataFrame:
    """What is left after a visitor clears [start, end) of the history; without bounds all of it."""
    inside = F.col(by) == visitor
    if start is not None:
        inside &= F.col("created_at") >= start
    if end is not None:
        inside &= F.col("created_at") < end
    return rows.where(~inside)


def admitted(requests: DataFrame, existing: DataFrame | None = None, *, quota: int = SAVED_QUOTA, keys: tuple[str, ...] = ("kind", "content_key"), by: str = "visitor_id", order: str = "arrival") -> DataFrame:
    """``requests`` with outcome saved, already_saved or quota_exceeded.

    The first request of a key is saved while the visitor has room; a repeated one is already saved if
    its first was, and else fails for the same reason.
    """
    key = [by, *keys]
    firsts = requests.groupBy(*key).agg(F.min(order).alias("__first"))
    rows = requests
    room = F.lit(quota)
    if existing is not None:
        present = existing.select(*key).distinct()
        firsts = firsts.join(present, key, "left_anti").join(existing.groupBy(by).agg(F.count("*").alias("__had")), by, "left")
        room = room - F.coalesce("__had", F.lit(0))
        rows = rows.join(present.withColumn("__present", F.lit(True)), key, "left")
    else:
        rows = rows.withColumn("__present", F.lit(None).cast("boolean"))
    # a visitor's first requests are combined before they are ordered, and only ``quota`` of them can pass
    nth = F.row_number().over(Window.partitionBy(by).orderBy("__first"))
    let_in = firsts.withColumn("__nth", nth).where(F.col("__nth") <= quota).where(F.col("__nth") <= room).select(*key, "__first")
    rows = rows.join(let_in, key, "left")
    outcome = F.when(F.col("__first") == F.col(order), "saved").when(F.col("__first").isNotNull() | F.col("__present").isNotNull(), "already_saved").otherwise("quota_exceeded")
    return rows.withColumn("outcome", outcome).drop("__present", "__first")


def folders_admitted(requests: DataFrame, existing: DataFrame | None = None, quota: int = FOLDER_QUOTA) -> DataFrame:
    """Folder names are trimmed, 1 to 80 characters, and unique whatever their case; others are invalid_name."""
    named = requests.withColumn("name", F.trim("name")).withColumn("content_key", F.lower("name")).withColumn("kind", F.lit("folder"))
    fine = F.char_length("name").between(1, 80)
    if existing is not None:
        existing = existing.withColumns({"content_key": F.lower("name"), "kind": F.lit("folder")})
    good = admitted(named.where(fine), existing, quota=quota)
    return good.unionByName(named.where(~fine).withColumn("outcome", F.lit("invalid_name"))).drop("content_key", "kind")


def without_folder(items: DataFrame, folder: object) -> DataFrame:
    """Items of a deleted folder stay, without one."""
    return items.withColumn("folder_id", F.when(F.col("folder_id") == folder, F.lit(None)).otherwise(F.col("folder_id")))


def moved(items: DataFrame, requests: DataFrame, folders: DataFrame) -> DataFrame:
    """``items`` after requests (visitor_id, item_id, folder_id, arrival) to move them: the last one that its visitor may make counts.

    Visitors move their own items into their own folders, or out of any (null); other requests change nothing.
    """
    owned = folders.select("visitor_id", F.col("id").alias("folder_id"), F.lit(True).alias("__own"))
    fine = requests.join(owned, ["visitor_id", "folder_id"], "left").where("folder_id is null or __own")
    last = fine.groupBy("visitor_id", F.col("item_id").alias("id")).agg(F.max_by(F.struct(F.col("folder_id").alias("to")), "arrival").alias("__last"))
    rows = items.join(last, ["visitor_id", "id"], "left")
    return rows.withColumn("folder_id", F.when(F.col("__last").isNotNull(), F.col("__last")["to"]).otherwise(F.col("folder_id"))).select(*items.columns)


def deleted(items: DataFrame, requests: DataFrame) -> DataFrame:
    """``items`` without those that their own visitors asked to delete (visitor_id, item_id)."""
    return items.join(requests.select("visitor_id", F.col("item_id").alias("id")).distinct(), ["visitor_id", "id"], "left_anti").select(*items.columns)


def renamed(folders: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests`` (visitor_id, folder_id, name, arrival) with outcome renamed, not_found, invalid_name or duplicate.

    Names are trimmed, 1 to 80 characters, and must differ from the visitor's other folders whatever
    their case; of several requests of a batch for one name the first is let in.
    """
    rows = requests.withColumn("name", F.trim("name"))
    own = folders.select("visitor_id", F.col("id").alias("folder_id"), F.lit(True).alias("__own"))
    taken = folders.select("visitor_id", F.lower("name").alias("__key"), F.col("id").alias("__other"))
    rows = rows.join(own, ["visitor_id", "folder_id"], "left").withColumn("__key", F.lower("name"))
    clash = rows.join(taken, ["visitor_id", "__key"]).where("__other <> folder_id").select("visitor_id", "arrival").distinct().withColumn("__clash", F.lit(True))
    fine = rows.where("__own").join(clash, ["visitor_id", "arrival"], "left_anti").where(F.char_length("name").between(1, 80))
    first = fine.groupBy("visitor_id", "__key").agg(F.min("arrival").alias("__first"))
    rows = rows.join(clash, ["visitor_id", "arrival"], "left").join(first, ["visitor_id", "__key"], "left")
    outcome = (
        F.when(F.col("__own").isNull(), "not_found").when(~F.coalesce(F.char_length("name").between(1, 80), F.lit(False)), "invalid_name")
        .when(F.col("__clash").isNotNull() | (F.col("__first") != F.col("arrival")), "duplicate").otherwise("renamed")
    )
    return rows.withColumn("outcome", outcome).select(*requests.columns, "outcome")


def owned(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (visitor_id, id) joined to its rows; a row of another visitor is as good as missing."""
    return asked.select("visitor_id", "id").join(rows, ["visitor_id", "id"])


#: A stored answer, field by field.
SNAPSHOT = (
    "status string, answer string, conclusions array<struct<statement:string,citationLabels:array<string>>>, alternativePaths array<struct<issueLabel:string,explanation:string,citationLabels:array<string>>>, "
    "uncertainties array<string>, citedSources array<struct<citationLabel:string,provenCurrentAsOf:string>>, clarificationQuestion string"
)


def snapshot(json: Column) -> Column:
    """A stored answer, read and checked against its closed schema; null unless every required field is there, so that what is malformed is never shown."""
    x = F.from_json(json, SNAPSHOT)
    no_null = lambda c, *fields: F.coalesce(F.forall(c, lambda v: F.lit(True) if not fields else ~F.exists(F.array(*(v[f].isNull() for f in fields)), lambda z: z)), F.lit(False))
    ok = x["status"].isin("answered", "insufficient_evidence") & x["answer"].isNotNull()
    ok &= no_null(x["conclusions"], "statement", "citationLabels") & no_null(x["alternativePaths"], "issueLabel", "explanation", "citationLabels") & no_null(x["citedSources"], "citationLabel")
    ok &= x["uncertainties"].isNotNull() & ~F.exists(x["uncertainties"], lambda v: v.isNull())
    return F.when(F.coalesce(ok, F.lit(False)), x)


def recorded(history: DataFrame, new: DataFrame) -> DataFrame:
    """``history`` with new entries appended, those whose snapshot is well formed; the others are not stored."""
    return history.unionByName(new.where(snapshot(F.col("result_snapshot")).isNotNull()))


def list_rows(entries: DataFrame) -> DataFrame:
    """(id, status, n_sources, preview) of entries (id, result_snapshot); malformed ones are left out."""
    x = snapshot(F.col("result_snapshot"))
    return entries.withColumn("__x", x).where("__x is not null").select("id", F.col("__x.status").alias("status"), F.size("__x.citedSources").alias("n_sources"), text.preview(F.col("__x.answer")).alias("preview"))


def summaries(items: DataFrame) -> DataFrame:
    """(id, kind, summary) of saved items: an answer's preview, a search's query, a provision's citation label."""
    answer = text.preview(F.get_json_object("snapshot", "$.answer"))
    label = F.get_json_object("snapshot", "$.citationLabel")
    return items.select("id", "kind", F.when(F.col("kind") == "answer", answer).when(F.col("kind") == "search", F.col("query")).otherwise(label).alias("summary"))


def saved_list(items: DataFrame, *, kind: str | None = None, folder: object = None, term: str | None = None, sort: str = "date_desc") -> DataFrame:
    if kind:
        items = items.where(F.col("kind") == kind)
    if folder is not None:
        items = items.where(F.col("folder_id") == folder)
    if term and term.strip():
        items = items.where(F.contains(F.lower("title"), F.lit(term.strip().lower())))
    order = {"date_desc": [F.desc("created_at"), F.desc("id")], "date_asc": [F.asc("created_at"), F.asc("id")], "title_asc": [F.expr("title collate UNICODE"), F.asc("id")]}
    return items.orderBy(*order[sort]).limit(SAVED_LISTED)


def titles(answer: Column, label: Column, act: Column) -> tuple[Column, Column]:
    """Titles of a saved answer and of a saved provision."""
    return text.shortened(answer, 120), F.concat_ws(" — ", label, act)
