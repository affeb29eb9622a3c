"""Answers: packing with reserved targets, verification by request, one recovery pass, assembly.

Requests are rows of one batch.  Models are outside: what they return comes as rows, and a response
that was no valid response is a row of ``batches`` that says so.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from provisio import shared
from provisio.functions import text
from provisio.operators import answer, answer_cache
from provisio.operators.publication import Store

# The headings of an answer's sections.
INTRO = "Na podstawie przeszukanych i zweryfikowanych przepisów można wskazać następujące ustalenia:"
UNSUPPORTED = "Następujących aspektów pytania nie udało się potwierdzić dostarczonymi, zweryfikowanymi przepisami:"
OTHER_PATHS = "Możliwe inne kwestie (niepotwierdzone dostarczonymi przepisami):"
UNCERTAINTIES = "Niepewności:"
CLARIFICATION = "Dodatkowe pytanie: "


def candidate_rank(label: str = "label") -> Column:
    """Order of candidates: exact ones, then by weight, label and first mention; a value to sort by."""
    return F.struct(~F.col("any_exact"), -F.round("weighted", 9), F.expr(f"collate({label}, 'UNICODE')"), F.col("first"), F.col("id"))


def ranked_candidates(hits: DataFrame, labels: DataFrame, by: list[str]) -> DataFrame:
    """(by, id, the columns of ``labels``, likely, rank) of what was hit, each as the hits of its group say.

    ``hits``: by, id, issue_no, query_no, likelihood, score, is_exact; ``labels``: id, label and more.
    """
    first = hits.groupBy(*by, "id").agg(F.min(F.struct("issue_no", "query_no")).alias("first"))
    rows = answer.tier_scores(hits, [*by, "id"]).join(first, [*by, "id"]).join(labels, "id")
    return rows.withColumn("rank", candidate_rank()).drop("weighted", "any_exact", "first")


def packed_for_targets(hits: DataFrame, sources: DataFrame, by: str = "request", *, most_sources: int = answer.MOST_SOURCES, most_chars: int = answer.MOST_CHARS) -> DataFrame:
    """(by, id, source_no, reserved_for): first the best candidate of each target that no earlier target has taken, then the others by rank.

    A source is taken while there are fewer than ``most_sources``, and if its characters fit; the
    first one always fits.  A target whose best candidate doesn't fit reserves nothing.
    ``hits``: as of ``ranked_candidates``, with target; ``sources``: id, label, n_chars.

    A request's candidates are read in order as a stream: what a task holds of a request is the
    sources taken.
    """
    each = ranked_candidates(hits, sources, [by, "target"]).where("likely")
    every = ranked_candidates(hits, sources, [by])
    row = lambda df, phase, target: df.select(by, F.lit(phase).alias("phase"), target.cast("long").alias("target"), "rank", F.col("id").cast("long").alias("id"), F.col("n_chars").cast("long").alias("n_chars"))
    rows = row(each, 0, F.col("target")).unionByName(row(every, 1, F.lit(None)))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, taken, used, done = object(), set(), 0, None
        for batch in batches:
            kept, nos, targets = [], [], []
            for i, (request, phase, target, name, n) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                if request != now:
                    now, taken, used, done = request, set(), 0, None
                if name in taken or (phase == 0 and target == done):
                    continue
                if phase == 0:
                    done = target
                n = n or 0
                if len(taken) < most_sources and (not taken or used + n <= most_chars):
                    taken.add(name)
                    used += n
                    kept.append(i)
                    nos.append(len(taken))
                    targets.append(target)
            held = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([held.column(0), held.column(3), pa.array(nos, pa.int32()), pa.array(targets, pa.int64())], names=[by, "id", "source_no", "reserved_for"])

    rows = rows.repartition(F.col(by)).sortWithinPartitions(by, "phase", "target", "rank").select(by, "phase", "target", "id", "n_chars")
    return rows.mapInArrow(fold, StructType([rows.schema[by], StructField("id", LongType()), StructField("source_no", IntegerType()), StructField("reserved_for", LongType())]))


def source_rows(packed: DataFrame, provisions: DataFrame, current: DataFrame | None = None, by: str = "request") -> DataFrame:
    """``packed`` with its texts, and proven_as_of: the pinned run's date where the run includes the version, else null.

    ``provisions``: id, version_id and more; ``current``: version_id, effective_as_of of the run's included entries.
    """
    rows = packed.join(provisions, "id").withColumn("source_id", F.concat(F.lit("SOURCE_"), F.col("source_no").cast("string")))
    if current is None:
        return rows.withColumn("proven_as_of", F.lit(None).cast("date"))
    return rows.join(current.select("version_id", F.col("effective_as_of").alias("proven_as_of")).distinct(), "version_id", "left")


def prioritised(sources: DataFrame, targets: DataFrame, by: str = "request") -> DataFrame:
    """``sources`` with ``place`` from 1: those reserved for one of the targets (by, target) first, the others after, each in their order."""
    wanted = targets.select(by, F.col("target").alias("reserved_for")).distinct().withColumn("__first", F.lit(True))
    rows = sources.join(wanted, [by, "reserved_for"], "left")
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.col("__first").isNull(), "source_no"))  # a request has few sources
    return rows.withColumn("place", place).drop("__first")


def gated(conclusions: DataFrame, verdicts: DataFrame, quotes: DataFrame, skeptic: DataFrame, batches: DataFrame, by: str = "request") -> DataFrame:
    """(by, conclusion, target, outcome, support): the gates of verification, fail-closed by request.

    ``conclusions``: by, conclusion, claimed, target; ``verdicts``: conclusion, verdict; ``quotes``:
    conclusion, source_id, status; ``skeptic``: conclusion, leap; ``batches``: by, verifier_valid,
    skeptic_valid.  An invalid response of the verifier demotes all conclusions of its request, one
    of the skeptic all that had passed the first gate.  A missing verdict, a quotation from a source
    that was not claimed, or a missing skeptic's row is an error of the whole request.
    """
    quoted = quotes.join(conclusions.select("conclusion", "claimed"), "conclusion").groupBy("conclusion").agg(
        F.count("*").alias("n"), F.count_if(F.col("status") == "verbatim").alias("n_verbatim"),
        F.bool_or(~F.array_contains("claimed", F.col("source_id"))).alias("foreign"),
        F.array_sort(F.collect_set(F.when(F.col("status") == "verbatim", F.col("source_id")))).alias("confirmed"),
    )
    rows = conclusions.join(verdicts.select("conclusion", "verdict"), "conclusion", "left").join(quoted, "conclusion", "left").join(skeptic.select("conclusion", "leap"), "conclusion", "left")
    rows = rows.join(batches.select(by, "verifier_valid", "skeptic_valid"), by, "left")
    valid = lambda c: F.coalesce(F.col(c), F.lit(True))
    fine = (F.col("verdict") == "direct_support") & (F.coalesce("n", F.lit(0)) > 0) & (F.col("n") == F.col("n_verbatim"))
    passed = valid("verifier_valid") & F.coalesce(fine, F.lit(False))
    broken = valid("verifier_valid") & (F.col("verdict").isNull() | F.coalesce("foreign", F.lit(False)))
    unheard = passed & valid("skeptic_valid") & F.col("leap").isNull()
    rows = rows.withColumns({"__passed": passed, "__broken": broken, "__unheard": unheard})
    rows = rows.withColumn("__failed", F.bool_or(F.col("__broken") | F.col("__unheard")).over(Window.partitionBy(by)))  # a request has few conclusions
    outcome = F.when(F.col("__failed"), "error").when(~F.col("__passed") | ~valid("skeptic_valid") | F.col("leap"), "demoted").otherwise("verified")
    support = F.when(F.col("outcome") == "verified", F.col("confirmed")).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("outcome", outcome).select(by, "conclusion", "target", "outcome", support.alias("support"))


def verified_targets(outcomes: DataFrame, by: str = "request") -> DataFrame:
    """(by, n_verified, hit, has_error) of requests that have conclusions; ``hit``: their targets with a verified one."""
    verified = F.col("outcome") == "verified"
    return outcomes.groupBy(by).agg(F.count_if(verified).alias("n_verified"), F.collect_set(F.when(verified, F.col("target"))).alias("hit"), F.bool_or(F.col("outcome") == "error").alias("has_error"))


def _open(targets: DataFrame, outcomes: DataFrame, by: str) -> DataFrame:
    """(by, mode, open): a request's mode of recovery, and the targets it is about."""
    every = targets.groupBy(by).agg(F.array_sort(F.collect_set("target")).alias("targets"))
    rows = every.join(verified_targets(outcomes, by), by, "left").withColumn("hit", F.coalesce(F.array_intersect("targets", "hit"), F.array().cast(every.schema["targets"].dataType)))
    some = (F.size("hit") > 0) & (F.size("hit") < F.size("targets"))
    mode = F.when(F.coalesce("n_verified", F.lit(0)) == 0, "full").when(some, "partial").otherwise("none")
    return rows.select(by, mode.alias("mode"), F.when(mode != "none", F.array_except("targets", "hit")).otherwise(F.slice("targets", 1, 0)).alias("open"))


def recovery_modes(targets: DataFrame, outcomes: DataFrame, by: str = "request") -> DataFrame:
    """(by, mode): full where nothing is verified, partial where a target is and another is not, else none."""
    return _open(targets, outcomes, by).select(by, "mode")


def open_targets(targets: DataFrame, outcomes: DataFrame, by: str = "request") -> DataFrame:
    """(by, target) that a recovery pass is about: all in a full one, those without a verified conclusion in a partial one."""
    return _open(targets, outcomes, by).select(by, F.explode("open").alias("target"))


def recovered(first: DataFrame, targets: DataFrame, drafts: DataFrame, own_quotes: DataFrame, verdicts: DataFrame, quotes: DataFrame, skeptic: DataFrame, batches: DataFrame, by: str = "request") -> DataFrame:
    """``first`` (of ``gated``) with phase ``first``, and what one recovery pass adds, with phase ``recovery``; nothing of the first pass is changed.

    ``drafts``: conclusions of the pass; ``own_quotes``: conclusion, status of the excerpts that they
    came with.  A request's recovery counts for nothing if a draft names a target that is not open;
    a draft one of whose own excerpts is not verbatim is dropped before the gates.
    """
    asked = drafts.join(_open(targets, first, by).where("mode <> 'none'"), by)
    foreign = F.bool_or(F.col("target").isNotNull() & ~F.array_contains("open", F.col("target"))).over(Window.partitionBy(by))
    asked = asked.withColumn("__foreign", foreign).where("not __foreign").drop("__foreign", "mode", "open")
    own = own_quotes.groupBy("conclusion").agg(F.bool_and(F.col("status") == "verbatim").alias("__own")).where("__own").select("conclusion")
    more = gated(asked.join(own, "conclusion", "left_semi"), verdicts, quotes, skeptic, batches, by)
    return first.withColumn("phase", F.lit("first")).unionByName(more.withColumn("phase", F.lit("recovery")))


def coverage(targets: DataFrame, verified: DataFrame, by: str = "request") -> DataFrame:
    """``targets`` (by, target, text) with is_covered, by ``verified_targets``."""
    hit = F.coalesce(F.array_contains("hit", F.col("target")), F.lit(False))
    return targets.join(verified.select(by, "hit"), by, "left").withColumn("is_covered", hit).drop("hit")


def _listed(rows: DataFrame, by: str, order: list, line: Column, name: str, join: str = "\n") -> DataFrame:
    lines = F.array_sort(F.collect_list(F.struct(*(c.alias(f"k{i}") for i, c in enumerate(order)), line.alias("v"))))
    return rows.groupBy(by).agg(F.array_join(F.transform(lines, lambda x: x["v"]), join).alias(name))


def cited(statement: Column, labels: Column) -> Column:
    """A statement with its citations in brackets, if it has any."""
    said = F.array_join(labels, ", ")
    return F.when(F.coalesce(said, F.lit("")) != "", F.concat(statement, F.lit(" ("), said, F.lit(")"))).otherwise(statement)


def answer_texts(conclusions: DataFrame, targets: DataFrame, paths: DataFrame, uncertainties: DataFrame, questions: DataFrame, by: str = "request") -> DataFrame:
    """(by, answer): what is verified in the order of the targets, those without one last; then what is not, a section each.

    ``conclusions``: by, target, position, statement, labels; ``targets``: by, target, text, is_covered;
    ``paths``: by, position, label, explanation, labels; ``uncertainties``: by, position, text;
    ``questions``: by, question.
    """
    statements = _listed(conclusions, by, [F.col("target").isNull(), F.col("target"), F.col("position")], cited(F.col("statement"), F.col("labels")), "a", "\n\n")
    dash = lambda c: F.concat(F.lit("- "), c)
    missing = _listed(targets.where("not is_covered"), by, [F.col("target")], dash(F.col("text")), "b")
    path = cited(F.concat("label", F.lit(": "), "explanation"), F.col("labels"))
    others = _listed(paths.where("explanation <> ''"), by, [F.col("position")], dash(path), "c")
    doubts = _listed(uncertainties, by, [F.col("position")], dash(F.col("text")), "d")
    rows = statements
    for x in (missing, others, doubts, questions.select(by, F.col("question").alias("e"))):
        rows = rows.join(x, by, "left")
    section = lambda head, c, sep="\n": F.when(F.col(c).isNotNull(), F.concat(F.lit(head + sep), F.col(c)))
    return rows.select(by, F.concat_ws("\n\n", F.lit(INTRO), "a", section(UNSUPPORTED, "b"), section(OTHER_PATHS, "c"), section(UNCERTAINTIES, "d"), section(CLARIFICATION, "e", "")).alias("answer"))


def assembled(requests: DataFrame, hits: DataFrame, sources: DataFrame, targets: DataFrame, outcomes: DataFrame, statements: DataFrame, paths: DataFrame, uncertainties: DataFrame, questions: DataFrame, by: str = "request") -> DataFrame:
    """(by, status, reason, answer, n_sources, n_verified) of every request.

    A request without hits has insufficient evidence whatever a model said; so has one without a
    verified conclusion; one with an error fails.  Only verified conclusions and what the model
    called other paths are in an answer, never a demoted statement.
    ``sources``: by, source_id, label; ``outcomes``: of ``recovered``; ``statements``: conclusion, position, statement.
    """
    label = sources.select(by, "source_id", "label")
    named = outcomes.where("outcome = 'verified'").select(by, "conclusion", "target", F.explode("support").alias("source_id")).join(label, [by, "source_id"])
    named = named.groupBy(by, "conclusion", "target").agg(F.array_sort(F.collect_set("label")).alias("labels")).join(statements, "conclusion")
    n = verified_targets(outcomes, by)
    texts = answer_texts(named, coverage(targets, n, by), paths, uncertainties, questions, by)
    found = hits.groupBy(by).agg(F.count("*").alias("__hits"))
    packed = sources.groupBy(by).agg(F.count("*").alias("n_sources"))
    rows = requests.select(by).join(found, by, "left").join(n, by, "left").join(packed, by, "left").join(texts, by, "left")
    reason = F.when(F.col("__hits").isNull(), "nothing_retrieved").when(F.coalesce("has_error", F.lit(False)), "failed").when(F.coalesce("n_verified", F.lit(0)) == 0, "nothing_verified")
    status = F.when(reason.isNull(), "answered").when(reason == "failed", "failed").otherwise("insufficient_evidence")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.select(by, status.alias("status"), reason.alias("reason"), F.when(status == "answered", F.col("answer")).alias("answer"), zero("n_sources"), zero("n_verified"))


def run_queries(queries: DataFrame, cache: DataFrame, scope: DataFrame, answer_all: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """What each query gets: (request, outcome, answer), and the rows for the history, (request, query, status).

    ``queries``: request, query and the cache's key and provenance columns but ``question_hash``;
    ``answer_all``: from queries to (request, status, answer).  A query of the wrong length is
    ``invalid``; one that the cache holds is ``cached`` and never reaches ``answer_all``; failed ones
    leave no history, and a cache hit is as much a visit as any other.
    """
    rows = queries.withColumn("is_valid", text.is_valid_query(F.col("query"))).withColumn("question_hash", text.cache_key(F.col("query")))
    seen = answer_cache.looked_up(rows.where("is_valid"), cache, scope)
    hits = seen.where("is_hit").select("request", "query", F.lit("cached").alias("outcome"), F.lit("answered").alias("status"), F.col("answer_snapshot").alias("answer"))
    asked = seen.where("not is_hit")
    told = asked.select("request", "query").join(answer_all(asked).select("request", "status", "answer"), "request", "left")
    status = F.coalesce("status", F.lit("failed"))
    told = told.select("request", "query", status.alias("outcome"), status.alias("status"), "answer")
    wrong = rows.where("not is_valid").select("request", "query", F.lit("invalid").alias("outcome"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("string").alias("answer"))
    every = hits.unionByName(told).unionByName(wrong)
    history = every.where("status in ('answered', 'insufficient_evidence')").select("request", "query", "status")
    return every.select("request", "outcome", "answer"), history


def run_batch(
    queries: DataFrame, store: Store, scope: DataFrame, answer_all: Callable[[DataFrame], DataFrame], now: Column, batch: int, *, writers: dict[str, Callable[[DataFrame, DataFrame | None], DataFrame]] | None = None
) -> tuple[DataFrame, dict[str, str]]:
    """What each query gets, as ``run_queries``, with its side writes: answers to the cache, its hit counts, the history.

    ``answer_all``: from queries to (request, status, answer, sources), sources as of
    ``answer_cache.rows_to_record``; ``store`` holds the tables ``cache`` and ``history``.  Outcomes are
    written first; then each side write is published by itself, once for a ``batch`` however often
    the batch is sent.  One that fails is told in the second result, by its name, and takes
    nothing from the outcomes or the other writes.  ``writers``: name to another way to make a write's
    table from its rows and what the table holds.
    """
    spark = queries.sparkSession
    key = [c for c in queries.columns if c not in ("request", "query")]
    none = spark.createDataFrame([], ", ".join(f"{c} string" for c in (*answer_cache.KEY, *answer_cache.PROVENANCE, "status", "answer_snapshot")) + ", source_version_ids array<string>, source_pack_hash string, hit_count long, last_hit_at timestamp_ntz")
    held = store.table("cache")
    told = {}

    def once(asked: DataFrame) -> DataFrame:
        told["answers"] = shared.cut(answer_all(asked).join(asked.select("request", "question_hash", *key), "request"), "answers")
        return told["answers"]

    every, history = run_queries(queries, none if held is None else held, scope, once)
    every, history = shared.cut(every, "outcomes"), shared.cut(history, "history")
    hits = queries.join(every.where("outcome = 'cached'").select("request"), "request").select(text.cache_key(F.col("query")).alias("question_hash"), *key, F.lit(True).alias("is_hit"))
    new = answer_cache.rows_to_record(told["answers"], scope)
    made = {
        "cache": lambda rows, table: answer_cache.recorded(table, rows) if table is not None else rows.dropDuplicates(list(answer_cache.KEY)),
        "hits": lambda rows, table: answer_cache.counted_hits(table, rows, now) if table is not None else none,
        "history": lambda rows, table: rows,
    } | (writers or {})
    failed = {}
    for name, rows, table, kind in (("cache", new, "cache", "appended"), ("hits", hits, "cache", "replaced"), ("history", history.withColumn("batch", F.lit(batch)), "history", "appended")):
        try:
            store.change(lambda at: {kind: {table: made[name](rows, store.table(table, at))}}, stream=name, batch=batch)  # noqa: B023
        except Exception as e:  # a side write never takes an answer away; what failed is told
            failed[name] = f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"
    return every, failed
