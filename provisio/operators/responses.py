"""Models' responses as rows: JSON read against closed schemas, fail-closed by response.

A response that misses a field, holds an unknown one, names what was never offered, or answers
other conclusions than it was asked about is invalid as a whole; nothing of it is used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Closed vocabularies of verdicts and of issues' likelihoods, and the most targets of a request.
VERDICTS = ("direct_support", "partial_support", "no_support")
LIKELIHOODS = ("most_likely", "possible", "needs_more_information")
MOST_TARGETS = 4


def has_fields(json: Column, fields: tuple[str, ...]) -> Column:
    """Whether a JSON object has exactly these fields."""
    return F.coalesce(F.array_sort(F.json_object_keys(json)) == F.array(*map(F.lit, sorted(fields))), F.lit(False))


def keyed_rows(responses: DataFrame, by: str = "request") -> DataFrame:
    """(by, key, value) of responses (by, json) that are objects of objects, such as {"0": {...}, "1": {...}}; ``value`` is JSON text, null in a row of a response that is no object."""
    entries = F.map_entries(F.from_json("json", "map<string,string>"))
    rows = responses.select(by, F.explode_outer(entries).alias("e"))
    return rows.select(by, F.col("e.key").alias("key"), F.col("e.value").alias("value"))


def _checked(rows: DataFrame, expected: DataFrame, fine: Column, by: str) -> DataFrame:
    """Rows (by, conclusion, ...) with ``is_valid`` of their whole response: every row is fine, and the conclusions are those expected."""
    want = expected.groupBy(by).agg(F.array_sort(F.collect_set("conclusion")).alias("__want"))
    got = rows.groupBy(by).agg(F.array_sort(F.collect_list("conclusion")).alias("__got"), F.bool_and(F.coalesce(fine, F.lit(False))).alias("__fine"))
    told = got.join(want, by, "left").select(by, F.coalesce(F.col("__fine") & (F.col("__got") == F.col("__want")), F.lit(False)).alias("is_valid"))
    return rows.join(told, by)


def verdicts(responses: DataFrame, expected: DataFrame, by: str = "request") -> DataFrame:
    """(by, conclusion, verdict, reason, evidence, is_valid) of verifiers' responses; ``expected``: by, conclusion."""
    rows = keyed_rows(responses, by)
    x = F.from_json("value", "verdict string, reason string, evidence array<struct<sourceId:string,excerpt:string>>")
    rows = rows.select(by, F.expr("try_cast(key as bigint)").alias("conclusion"), "value", x.alias("x"))
    whole = F.forall("x.evidence", lambda e: e["sourceId"].isNotNull() & e["excerpt"].isNotNull())
    fine = has_fields(F.col("value"), ("verdict", "reason", "evidence")) & F.col("x.verdict").isin(*VERDICTS) & F.col("x.reason").isNotNull() & whole
    return _checked(rows, expected, fine, by).select(by, "conclusion", "x.verdict", "x.reason", "x.evidence", "is_valid")


def leaps(responses: DataFrame, expected: DataFrame, by: str = "request") -> DataFrame:
    """(by, conclusion, leap, reason, is_valid) of skeptics' responses."""
    rows = keyed_rows(responses, by)
    x = F.from_json("value", "hasUnsupportedLeap boolean, reason string")
    rows = rows.select(by, F.expr("try_cast(key as bigint)").alias("conclusion"), "value", x.alias("x"))
    fine = has_fields(F.col("value"), ("hasUnsupportedLeap", "reason")) & F.col("x.hasUnsupportedLeap").isNotNull() & F.col("x.reason").isNotNull()
    return _checked(rows, expected, fine, by).select(by, "conclusion", F.col("x.hasUnsupportedLeap").alias("leap"), "x.reason", "is_valid")


def drafts(responses: DataFrame, offered: DataFrame, by: str = "request") -> DataFrame:
    """(by, is_valid, conclusions) of generators' responses: {"conclusions": [{statement, support: [{sourceId}], answerTargetIndex}]}.

    Every conclusion needs a statement and support, only sources and targets that were offered
    (by, sources, targets) may be named; conclusions of an invalid response are null.
    """
    kind = "conclusions array<struct<statement:string,support:array<struct<sourceId:string>>,answerTargetIndex:bigint>>"
    rows = responses.join(offered, by, "left").withColumn("x", F.from_json("json", kind))
    one = lambda c: (F.coalesce(F.trim(c["statement"]), F.lit("")) != "") & (F.size(c["support"]) > 0) & F.forall(c["support"], lambda s: F.array_contains("sources", s["sourceId"])) & (c["answerTargetIndex"].isNull() | F.array_contains("targets", c["answerTargetIndex"]))
    fine = F.coalesce(has_fields(F.col("json"), ("conclusions",)) & F.forall("x.conclusions", lambda c: F.coalesce(one(c), F.lit(False))), F.lit(False))
    return rows.select(by, fine.alias("is_valid"), F.when(fine, F.col("x.conclusions")).alias("conclusions"))


def completed(envelopes: DataFrame, by: str = "request") -> DataFrame:
    """(by, json, error) of services' envelopes (by, json): the first choice's content, or INVALID_RESPONSE if there is none, it was declined, or it did not end normally."""
    x = F.from_json("json", "choices array<struct<message:struct<content:string,refusal:string>,finish_reason:string>>")
    rows = envelopes.select(by, F.get(x["choices"], F.lit(0)).alias("x"))
    none = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    fine = none("x.message.refusal") & (none("x.finish_reason") | (F.col("x.finish_reason") == "stop")) & ~none("x.message.content")
    return rows.select(by, F.when(fine, F.col("x.message.content")).alias("json"), F.when(~fine, "INVALID_RESPONSE").alias("error"))


def _said(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def detected(responses: DataFrame, by: str = "request") -> DataFrame:
    """(by, is_valid, summary, targets, issues, clarification) of detections.

    Every issue serves a target and asks something, and targets are named by their places, from 1, so
    an issue without any target at all is invalid.  No issues is a valid answer, and an empty or null
    question is none.  Of an invalid response nothing is kept.
    """
    query = "struct<query:string,answerTargetIndex:bigint>"
    kind = f"summary string, answerTargets array<struct<text:string>>, issues array<struct<label:string,likelihood:string,rationale:string,answerTargetIndexes:array<bigint>,retrievalQueries:array<{query}>>>, clarificationQuestion string"
    rows = responses.select(by, "json", F.from_json("json", kind).alias("x"))
    n = F.size("x.answerTargets")
    in_range = lambda i: F.coalesce(i.between(1, n), F.lit(False))

    def served(issue: Column) -> Column:
        asks = (F.size(issue["retrievalQueries"]) > 0) & F.forall(issue["retrievalQueries"], lambda q: _said(q["query"]) & in_range(q["answerTargetIndex"]))
        told = _said(issue["label"]) & _said(issue["rationale"]) & issue["likelihood"].isin(*LIKELIHOODS)
        return F.coalesce(told & (F.size(issue["answerTargetIndexes"]) > 0) & F.forall(issue["answerTargetIndexes"], in_range) & asks, F.lit(False))

    fields = ("summary", "answerTargets", "issues")
    shape = has_fields(F.col("json"), fields) | has_fields(F.col("json"), (*fields, "clarificationQuestion"))
    whole = _said(F.col("x.summary")) & (n <= MOST_TARGETS) & F.forall("x.answerTargets", lambda t: _said(t["text"])) & F.forall("x.issues", served)
    rows = rows.withColumn("is_valid", F.coalesce(shape & whole, F.lit(False)))
    kept = lambda c, name: F.when(F.col("is_valid"), c).alias(name)
    return rows.select(by, "is_valid", kept(F.col("x.summary"), "summary"), kept(F.col("x.answerTargets.text"), "targets"), kept(F.col("x.issues"), "issues"), kept(F.nullif("x.clarificationQuestion", F.lit("")), "clarification"))


def recoveries(responses: DataFrame, offered: DataFrame, by: str = "request") -> DataFrame:
    """(by, is_valid, conclusions, uncertainties) of recoveries: each conclusion with a statement, and support by quotes of sources that were offered (by, sources, targets)."""
    kind = "conclusions array<struct<statement:string,support:array<struct<sourceId:string,excerpt:string>>,answerTargetIndex:bigint>>, uncertainties array<string>"
    rows = responses.join(offered, by, "left").withColumn("x", F.from_json("json", kind))

    def fine(c: Column) -> Column:
        quoted = (F.size(c["support"]) > 0) & F.forall(c["support"], lambda s: F.array_contains("sources", s["sourceId"]) & _said(s["excerpt"]))
        return F.coalesce(_said(c["statement"]) & quoted & (c["answerTargetIndex"].isNull() | F.array_contains("targets", c["answerTargetIndex"])), F.lit(False))

    whole = has_fields(F.col("json"), ("conclusions", "uncertainties")) & F.forall("x.conclusions", fine) & F.forall("x.uncertainties", _said)
    rows = rows.withColumn("is_valid", F.coalesce(whole, F.lit(False)))
    return rows.select(by, "is_valid", F.when(F.col("is_valid"), F.col("x.conclusions")).alias("conclusions"), F.when(F.col("is_valid"), F.col("x.uncertainties")).alias("uncertainties"))
