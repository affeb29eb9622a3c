"""How far the sources of a language differ in their terms, exactly, by a split of heavy and light terms.

Let p0 of a group be the share of a term that it does not hold.  The sum over all terms of two
groups a and b is the number of terms times f(p0a, p0b), plus a correction for each term that a
or b holds.  Terms that many groups hold are dense tiles: a matrix of shares, terms by groups, in
numpy.  Rare terms are postings: what one group's postings add against the p0 of every other
group depends on their counts only, so counts are added up first; and a pair of postings of one
term adds what both together change.  All sums are of whole numbers, and the parts are added.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provisio.llm import storage
from provisio.llm.words import trim

_TERM, _BREAK = re.compile(rb"[a-z\x80-\xff]+"), re.compile(rb"[^a-z\x80-\xff]")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Bytes of a text that are cut into terms at a time, and terms that a task counts before it sends them.
PIECE, HELD = 1 << 22, 300_000
#: Groups of a tile; postings of a block of terms; the share of groups (one in so many) that makes a term heavy.
TILE, BLOCK, HEAVY = 128, 50_000, 4
#: Groups (lang, source) of which the facts are broadcast; more are joined by a shuffle.
MOST_SENT = 100_000


def _counts(batches: Iterator[pa.RecordBatch], most: int, piece: int) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of some rows; the term '' says that the group occurs."""
    n: dict[tuple[str, str], Counter] = defaultdict(Counter)
    docs: dict[tuple[str, str], Counter] = defaultdict(Counter)

    def sent() -> Iterator[pa.RecordBatch]:
        for (lang, source), own in n.items():
            terms = [t.decode("utf-8", "replace") for t in own]
            size = len(terms) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()), pa.array([*terms, ""], pa.string()), pa.array([*own.values(), 0], pa.int64()), pa.array([*(docs[lang, source][t] for t in own), 0], pa.int64())],
                names=["lang", "source", "term", "n", "docs"],
            )
        n.clear()
        docs.clear()

    held = 0
    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own, its = n[lang, source], docs[lang, source]
            data, at, seen = text.encode("utf-8", "replace").translate(_LOWER), 0, set()
            before = len(own)
            while at < len(data):
                end = len(data) if len(data) - at <= piece else (m.start() if (m := _BREAK.search(data, at + piece)) else len(data))
                found = Counter(_TERM.findall(data, at, end))
                at = end
                for term, times in found.items():
                    own[term] += times
                seen.update(found)
            its.update(seen)
            held += len(own) - before
            if held >= most:
                yield from sent()
                held = 0
    yield from sent()
    trim()


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10**9 * (n + 2) / (total + 2 * terms)), in two steps, so that nothing exceeds 64 bits."""
    whole = total + 2 * terms
    a = (n + 2) * 31250
    return 1 + F.floor(_div(a, whole)) * 32000 + _div((a % whole) * 32000, whole)


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _f(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), p + q)


def _far(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def postings(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = 10) -> DataFrame:
    """(lang, source, term, n, n_lang, holders, first) of the terms kept, and a row with the term '' for each group.

    ``n_lang``: the term's occurrences in the language; ``holders``: groups that hold it; ``first``
    marks one of them.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    most, piece = HELD, PIECE  # read here: tasks have their own copy of the module
    found = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text")).mapInArrow(lambda rows: _counts(rows, most, piece), "lang string, source string, term string, n long, docs long")
    found = found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by = Window.partitionBy("lang", "term")
    found = found.withColumns({"all": F.sum("docs").over(by), "n_lang": F.sum("n").over(by), "holders": F.count("*").over(by), "first": F.row_number().over(by.orderBy("source")) == 1})
    return found.where((F.col("term") == "") | (F.col("all") >= least)).drop("docs", "all")


def _facts(held: DataFrame) -> DataFrame:
    """(lang, source, total, terms, groups, total_lang, p0, tile, pos, blocks) of each group."""
    is_term = F.col("term") != ""
    langs = held.groupBy("lang").agg(F.count(F.when(~is_term, 1)).alias("groups"), F.count(F.when(is_term & F.col("first"), 1)).alias("terms"), F.sum("n").alias("total_lang"))
    own = held.groupBy("lang", "source").agg(F.sum("n").alias("total")).join(langs, "lang")
    at = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    p0 = F.when(F.col("terms") > 0, _share(F.lit(0).cast("long"), F.col("total"), F.col("terms"))).otherwise(F.lit(1).cast("long"))
    own = own.withColumns({"at": at, "p0": p0, "blocks": 1 + _div(F.col("terms") * F.least("groups", F.lit(TILE)), F.lit(BLOCK))})
    return own.withColumns({"tile": _div(F.col("at"), F.lit(TILE)).cast("int"), "pos": (F.col("at") % TILE).cast("int"), "tiles": (1 + _div(F.col("groups") - 1, F.lit(TILE))).cast("int")}).drop("at")


def _tile(frame: pd.DataFrame) -> pd.DataFrame:
    """The sums of one tile over one block of terms; kind 0: a group, its p0 and its name; 1: a posting of a heavy term; 2: a count of light postings."""
    lang, low, high, block = frame[["lang", "low", "high", "block"]].iloc[0]
    sides = []
    for side in (0, 1) if low != high else (0,):
        own = frame[frame["side"] == side]
        facts = own[own["kind"] == 0].sort_values("pos")
        sides.append((facts["term"].to_numpy(), facts["p"].to_numpy(np.int64), own[own["kind"] == 1], own[own["kind"] == 2], int(facts["m"].iloc[0])))
    left, right = sides[0], sides[-1]
    base = _far(left[1][:, None], right[1][None, :])
    value = base * left[4] if block == 0 else np.zeros_like(base)
    terms = pd.unique(pd.concat([s[2]["term"] for s in sides]))
    row = {t: i for i, t in enumerate(terms)}
    shares = []
    for s in sides:
        m = np.tile(s[1], (len(terms), 1))
        m[s[2]["term"].map(row).to_numpy(np.int64), s[2]["pos"].to_numpy(np.int64)] = s[2]["p"].to_numpy(np.int64)
        shares.append(m)
    step = max(1, (1 << 20) // base.size)
    for i in range(0, len(terms), step):
        a, b = shares[0][i : i + step], shares[-1][i : i + step]
        value += (_far(a[:, :, None], b[:, None, :]) - base).sum(0)
    for s, other, across in ((left, right, False), (right, left, True)):
        step = max(1, (1 << 20) // len(other[1]))
        pos, p, m = (s[3][c].to_numpy(np.int64) for c in ("pos", "p", "m"))
        for i in range(0, len(pos), step):
            at = pos[i : i + step]
            more = m[i : i + step, None] * (_far(p[i : i + step, None], other[1][None, :]) - (base.T if across else base)[at])
            np.add.at(value.T if across else value, at, more)
    a, b = np.nonzero(np.ones_like(value) if low != high else ~np.eye(len(value), dtype=bool))
    out = pd.DataFrame({"lang": lang, "source": left[0][a], "item": right[0][b], "value": value[a, b]})
    return out if low == high else pd.concat([out, out.rename(columns={"source": "item", "item": "source"})])[["lang", "source", "item", "value"]]


def _tiles(facts: DataFrame, rows: DataFrame) -> DataFrame:
    """(lang, source, item, value) of every ordered pair: all but what pairs of light postings change."""
    name = ["lang", "tile", "tiles", "pos", "kind", "term", "p", "m", "block"]
    kind = lambda k: F.lit(k).alias("kind")
    one = F.lit(1).cast("long").alias("m")
    own = facts.select("lang", "tile", "tiles", "pos", kind(0), F.col("source").alias("term"), F.col("p0").alias("p"), F.col("terms").alias("m"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    heavy = rows.where("heavy").select("lang", "tile", "tiles", "pos", kind(1), "term", "p", one, F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block"))
    light = rows.where("not heavy").groupBy("lang", "tile", "tiles", "pos", "p", "blocks").agg(F.count("*").alias("m"))
    light = light.select("lang", "tile", "tiles", "pos", kind(2), F.lit("").alias("term"), "p", "m", F.pmod(F.xxhash64("pos", "p"), F.col("blocks")).alias("block"))
    every = own.select(name).unionByName(heavy.select(name)).unionByName(light.select(name))
    every = every.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    every = every.select("lang", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "block", (F.col("tile") > F.col("other")).cast("int").alias("side"), "pos", "kind", "term", "p", "m")
    return every.groupBy("lang", "low", "high", "block").applyInPandas(_tile, "lang string, source string, item string, value long")


def _posting_pairs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Of rows in order of (lang, term): what pairs of a term's postings change, summed by pair of groups."""
    total: dict[tuple[str, str, str], int] = defaultdict(int)

    def sent() -> pa.RecordBatch:
        keys = list(total)
        out = pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in keys], pa.string()) for i in range(3)), pa.array(list(total.values()), pa.int64())], names=["lang", "source", "item", "value"])
        total.clear()
        return out

    def added(frame: pd.DataFrame) -> None:
        run = (frame["lang"].ne(frame["lang"].shift()) | frame["term"].ne(frame["term"].shift())).cumsum().to_numpy()
        group, names = pd.factorize(pd.MultiIndex.from_frame(frame[["lang", "source"]]))
        p, p0 = frame["p"].to_numpy(np.int64), frame["p0"].to_numpy(np.int64)
        for step in range(1, int(np.bincount(run).max())):
            i = np.flatnonzero(run[step:] == run[:-step])
            j = i + step
            more = _far(p[i], p[j]) - _far(p[i], p0[j]) - _far(p0[i], p[j]) + _far(p0[i], p0[j])
            pair, at = np.unique(group[i] * len(names) + group[j], return_inverse=True)
            sums = np.zeros(len(pair), np.int64)
            np.add.at(sums, at, more)
            for k, s in zip(pair.tolist(), sums.tolist(), strict=True):
                (lang, a), (_, b) = names[k // len(names)], names[k % len(names)]
                total[lang, a, b] += s
                total[lang, b, a] += s

    kept = None
    for batch in batches:
        frame = batch.to_pandas()
        if not len(frame):
            continue
        if kept is not None:
            frame = pd.concat([kept, frame], ignore_index=True)
        last = (frame["lang"] == frame["lang"].iloc[-1]) & (frame["term"] == frame["term"].iloc[-1])  # may go on in the next batch
        kept = frame[last]
        if not last.all():
            added(frame[~last])
        if len(total) >= most:
            yield sent()
    if kept is not None:
        added(kept)
    yield sent()


def audit(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = 10, shown: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each group (lang, source) is from the others of its language.

    Part ``pair``: every other source of the language; part ``term``: the ``shown`` terms that the
    group uses most above the language's share.  Null texts, languages and sources are empty ones;
    groups without terms count; a language without kept terms has pairs of value 0; repeated rows
    count as often as they come.  An empty table gives an empty one; other columns, whatever their
    names, are not read.

    Tasks count terms before they send them, so a hot source or word costs a row a task.  Dense
    tiles have TILE groups on a side and blocks of terms of bounded size; postings of a light term
    are in at most a quarter of a language's groups.
    """
    held = storage.written(postings(docs, text_col=text_col, lang_col=lang_col, source_col=source_col, least=least), "postings")
    facts = storage.written(_facts(held), "groups")
    known = F.broadcast(facts) if facts.count() <= MOST_SENT else facts
    rows = held.where("term != ''").join(known, ["lang", "source"])
    rows = rows.withColumns({"p": _share(F.col("n"), F.col("total"), F.col("terms")), "q": _share(F.col("n_lang"), F.col("total_lang"), F.col("terms")), "heavy": F.col("holders") * HEAVY >= F.col("groups")})
    rows = storage.written(rows.select("lang", "source", "term", "p", "q", "p0", "holders", "heavy", "tile", "tiles", "pos", "blocks"), "shares")
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(by))
    terms = ranked(rows.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _f(F.col("p"), F.col("q")).alias("value"))).where(F.col("rank") <= shown)
    light = rows.where("not heavy and holders > 1").select("lang", "term", "source", "p", "p0")
    most, parts = HELD, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    light = light.repartition(parts, "lang", "term").sortWithinPartitions("lang", "term", "source").mapInArrow(lambda rows: _posting_pairs(rows, most), "lang string, source string, item string, value long")
    pairs = _tiles(facts, rows).unionByName(light).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    return ranked(pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value")).unionByName(terms).select("lang", "source", "part", "item", "value", "rank")
