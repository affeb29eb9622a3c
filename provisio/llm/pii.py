"""Personal data: fixed formats, and identifiers found by bootstrapped contextual extraction.

Each text is read once.  What matches a fixed format is a span and a seed; so is a part of what
has the form of a secret (32 or more hexadecimal characters, digits and letters).  Each seed, and
each other candidate (a token with a digit, or a value after ``=``, ``:`` or an opening quote), is a
node of a graph.  Its edges lead to the lexical patterns it stands in: the marks and one or two
words before it, those and what follows, and what follows with the marks before.  Spark scores the
graph in rounds, until no pattern is added: a pattern's confidence is the trusted share of what it
extracts, an instance's trust is how likely one of its confident patterns is right.  What stands in
a pattern of high confidence is a span of the kind ``found``.

A pattern extracts its distinct instances and every other word that stands where it does.  Those
are counted over all texts, for the patterns that would be confident without them.

``withheld`` of the secrets, by hash, are no seeds.  Patterns that find them again are shown to
find what they have not seen, in every run; those that no pattern finds are spans of the kind
``secret`` all the same, as the others are.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from provisio.llm import storage
from provisio.llm.words import slices, strings

# The formats of the kinds.
KINDS = ("email", "ip", "card", "phone")
EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SECRET = re.compile(r"[0-9A-Fa-f]{32,}")

_DIGIT = re.compile(r"[0-9]")
_TOKEN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-.+/=@")
_MARKS = re.compile(r"[^\w\s]*\Z")
_MARKS_AFTER = re.compile(r"[^\w\s]*")
#: A value after a mark that assigns or quotes: a quoted one of several words, or one word.
_VALUE = re.compile(r"[=:][\x20\t]{0,3}[\"'][^\"'\n]{3,64}[\"']|[=:][\x20\t]{0,3}[^\s\"'=:,;]{3,64}")
_VALUE_START = re.compile(r"[=:][\x20\t]{0,3}[\"']?")
#: Code points that are looked at on each side, of a word, and of marks.
WINDOW, WORD, MARKS = 160, 24, 8


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches; what stands left of an @ is the longest run that no earlier match has taken."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        m = EMAIL_DOMAIN.match(text, at + 1)
        if m:
            start = at
            while start > last and text[start - 1] in EMAIL_LOCAL:
                start -= 1
            if start < at:
                out.append((start, m.end()))
                last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of the fixed formats, each kind leftmost and without overlap; matches that fail are dropped."""
    digits = lambda m: "".join(c for c in m.group() if "0" <= c <= "9")
    out = {"email": emails(text), "ip": [], "card": [], "phone": []}
    if not _DIGIT.search(text):
        return out
    # an octet of more than three digits may still be small: 0127
    out["ip"] = [m.span() for m in IP.finditer(text) if all(len(x := p.lstrip("0")) <= 3 and int(x or "0") <= 255 for p in m.group().split("."))]
    out["card"] = [m.span() for m in CARD.finditer(text) if m.end() - m.start() >= 16 and 16 <= len(x := digits(m)) <= 19 and luhn(x)]
    if "+" in text:
        out["phone"] = [m.span() for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15]
    return out


def patterns(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns around a span, in lower case: marks and one word before, marks and two words, one word before and what follows, marks before and a word after.

    A word counts by its last (before) or first (after) ``WORD`` code points, marks by ``MARKS``.
    """
    before, after = text[max(0, start - WINDOW) : start].lower(), text[end : end + WINDOW].lower()
    marks = _MARKS.search(before).group()
    follow = _MARKS_AFTER.match(after).group()
    left, right = before[: len(before) - len(marks)].split(), after[len(follow) :].split(None, 1)
    gap = " " if before[: len(before) - len(marks)][-1:].isspace() else ""
    marks, follow = gap + marks[-MARKS:], follow[:MARKS]
    left, right = [x[-WORD:] for x in left[-2:]], right[0][:WORD] if right else ""
    near = " ".join(left[-1:])
    out = [f"{near}{marks}\t"]
    if len(left) == 2:
        out.append(f"{left[0]} {near}{marks}\t")
    if follow:
        out.append(f"{near}{marks}\t{follow}")
    if follow or right:
        out.append(f"{marks}\t{follow} {right}")
    return [x for x in out if x.strip()]


def tokens(text: str, least: int) -> Iterator[tuple[int, int]]:
    """Candidates: tokens of ``least`` characters or more with a digit, and values, leftmost and without overlap."""
    found, last = [], 0
    m = _DIGIT.search(text)
    while m:
        start, end = m.start(), m.end()
        while start > last and text[start - 1] in _TOKEN:
            start -= 1
        while end < len(text) and text[end] in _TOKEN:
            end += 1
        last = end
        while end > start and text[end - 1] in ".-+/=@":
            end -= 1
        while start < end and text[start] in "=/":
            start += 1
        if end - start >= least:
            found.append((start, end))
        m = _DIGIT.search(text, last)
    if "=" in text or ":" in text:
        for m in _VALUE.finditer(text):
            start, end = m.start() + _VALUE_START.match(m.group()).end(), m.end()
            if text[end - 1] in "\"'":
                end -= 1
            while end > start and text[end - 1] in ".!?)>]}*":
                end -= 1
            while start < end and text[start] in "<([{*":
                start += 1
            if end > start:
                found.append((start, end))
    last = 0
    for start, end in sorted(found):
        if start >= last:
            yield start, end
            last = end


def joined(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, held in spans.items() for a, b in held)


NODE = "array<struct<patterns:array<string>,instance:binary,seed:boolean,start:int,end:int>>"
#: Most confident patterns that are sent to every task; more of them are joined.
MOST_SENT = 20_000


def _known(text: str, start: int, end: int) -> bytes:
    """16 bytes of a digest that stand for an instance."""
    return hashlib.blake2b(text[start:end].lower().encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _extracted(docs: DataFrame, least: int, withheld: float) -> DataFrame:
    """Each row's base spans and graph nodes; rows know their texts by two hashes."""
    node = pa.list_(pa.struct([("patterns", pa.list_(pa.string())), ("instance", pa.binary()), ("seed", pa.bool_()), ("start", pa.int32()), ("end", pa.int32())]))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _ in slices(batch, "text"):
                counts, hashes, spans, nodes = [], [], [], []
                for text in strings(part, "text"):
                    base = base_spans(text)
                    taken = sorted(x for held in base.values() for x in held)
                    known = lambda a, b, seed, its, t=text: {"patterns": patterns(t, a, b), "instance": its, "seed": seed, "start": a, "end": b}
                    own = [known(a, b, True, _known(text, a, b)) for a, b in taken]
                    secret, i, last = [], 0, 0
                    for a, b in tokens(text, least):
                        while i < len(taken) and taken[i][1] <= a:
                            last = max(last, taken[i][1])
                            i += 1
                        if last > a or (i < len(taken) and taken[i][0] < b):
                            continue
                        its, x = _known(text, a, b), text[a:b]
                        hidden = bool(SECRET.fullmatch(x)) and not x.isdigit()
                        if hidden:
                            secret.append((a, b))
                        own.append(known(a, b, hidden and int.from_bytes(its[:4], "little") >= withheld * 2**32, its))
                    counts.append([len(base[k]) for k in KINDS])
                    hashes.append(hashlib.sha256(joined(base).encode()).hexdigest())
                    spans.append(joined({**base, "secret": secret}))
                    nodes.append(own)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *part.columns[2:], *(pa.array([c[i] for c in counts], pa.int64()) for i in range(4)), pa.array(hashes), pa.array(spans), pa.array(nodes, node)],
                    names=["id", "h1", "h2", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "nodes"],
                )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(extract, f"id {kind}, h1 long, h2 long, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string, nodes {NODE}")


def _with(rows: DataFrame, good: DataFrame, n: int) -> DataFrame:
    """``rows`` joined to the ``n`` confident patterns, which are sent to the tasks if they are few."""
    return rows.join(F.broadcast(good) if n <= MOST_SENT else good, "pattern")


#: Patterns' confidence, all together, that counts as grown.
GROWTH = 1e-6


def confident_patterns(edges: DataFrame, rounds: int | None, confidence: float, support: float, others: DataFrame | None = None) -> tuple[DataFrame, int]:
    """Patterns that extract what is trusted: (pattern, confidence) and their number, after rounds until trust grows no more (or ``rounds`` of them).

    From edges (pattern, instance, seed), and ``others`` (pattern, other): how many more words a pattern extracts.  With ``others``, only its patterns count.
    """
    if others is not None:
        edges = storage.written(edges.join(others, "pattern"), "counted-edges")
    else:
        edges = edges.withColumn("other", F.lit(0).cast("long"))

    def score(edges: DataFrame) -> DataFrame:
        found = edges.groupBy("pattern").agg((F.count("*") + F.max("other")).alias("n"), F.sum("trust").alias("s"))
        return found.where((F.col("s") >= support) & (F.col("s") >= confidence * F.col("n"))).select("pattern", (F.col("s") / F.col("n")).alias("confidence"))

    trusted, k, n, total = edges.withColumn("trust", F.col("seed").cast("double")), 0, -1, 0.0
    while True:
        good = storage.written(score(trusted), f"patterns-round-{k}")
        sums = good.agg(F.count("*").alias("n"), F.coalesce(F.sum("confidence"), F.lit(0.0)).alias("total")).collect()[0]
        # trust only grows, so patterns are added and never lost; as long as it grows, one more may pass
        still = sums["n"] == n and sums["total"] - total < GROWTH
        n, total, k = sums["n"], sums["total"], k + 1
        if still or k == rounds:
            return good, n
        wrong = F.exp(F.sum(F.log(1 - F.least(F.col("confidence"), F.lit(0.99)))))
        likely = storage.written(_with(edges, good, n).groupBy("instance").agg((1 - wrong).alias("likely")), f"instances-round-{k}")
        trusted = edges.join(likely, "instance", "left").withColumn("trust", F.greatest(F.col("seed").cast("double"), F.coalesce(F.col("likely"), F.lit(0.0)))).drop("likely")


def literals(pattern: str) -> list[str]:
    """What a pattern has on its sides, as it stands in a text in lower case with single spaces."""
    left, right = pattern.split("\t")
    first = left.split(" ")[0]
    left = " " + left if first and len(first) < WORD else left
    return [x for x in (left, right) if x.strip()]


def places(docs: DataFrame, good: DataFrame, n: int) -> DataFrame:
    """(pattern, places): how often a pattern's rarer side stands in the texts, for ``n`` patterns; one pass for each ``MOST_SENT`` of them."""
    spark, out = docs.sparkSession, None
    passes = max(1, -(-n // MOST_SENT))
    for k in range(passes):
        held = [r["pattern"] for r in good.where(F.pmod(F.xxhash64("pattern"), F.lit(passes)) == k).select("pattern").collect()]  # about MOST_SENT
        sides = sorted({x for p in held for x in literals(p)})
        shared = spark.sparkContext.broadcast(sides)

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own, total = ahocorasick.Automaton(), np.zeros(len(shared.value), np.int64)
            for i, x in enumerate(shared.value):
                own.add_word(x, i)
            own.make_automaton()
            for batch in batches:
                for part, _ in slices(batch, "text"):
                    for text in strings(part, "text"):
                        at = [i for _, i in own.iter(f" {' '.join(text.lower().split())} ")]
                        if at:
                            total += np.bincount(at, minlength=len(total))
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"side": pa.array([shared.value[i] for i in some], pa.string()), "n": pa.array(total[some])})

        if sides:
            counted = docs.select(F.lit(0).alias("id"), F.col("text")).mapInArrow(count, "side string, n long").groupBy("side").agg(F.sum("n").alias("n"))
            rows = spark.createDataFrame([(p, x) for p in held for x in literals(p)], "pattern string, side string")
            found = rows.join(counted, "side", "left").groupBy("pattern").agg(F.min(F.coalesce("n", F.lit(0))).alias("places"))
            found = storage.written(found, "pattern-places")
            out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], "pattern string, places long") if out is None else out


def _text(text_col: str) -> list:
    text = F.col(text_col).cast("string")
    return [text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("h1"), F.xxhash64(F.lit(1), F.coalesce(text, F.lit(""))).alias("h2")]


def _found(docs: DataFrame, id_col: str, text_col: str, rounds: int | None, confidence: float, support: float, least: int, withheld: float) -> DataFrame:
    """The rows of ``find`` with ``h1`` and ``h2``, hashes of their texts."""
    read = _extracted(docs.select(F.col(id_col).alias("id"), *_text(text_col)), least, withheld)
    read = storage.written(read.withColumn("row", F.monotonically_increasing_id()), "pii")
    nodes = read.select("row", F.explode("nodes").alias("x")).select("row", "x.instance", "x.seed", "x.start", "x.end", F.explode("x.patterns").alias("pattern"))
    edges = storage.written(nodes.groupBy("pattern", "instance").agg(F.bool_or("seed").alias("seed"), F.count("*").alias("times")), "pattern-edges")
    confidence *= 1 - withheld
    may, n = confident_patterns(edges, rounds, confidence, support)
    own = edges.join(may.select("pattern"), "pattern").groupBy("pattern").agg(F.sum("times").alias("own"))
    others = own.join(places(docs.select(*_text(text_col)[:1]), may, n), "pattern").select("pattern", F.greatest(F.lit(0), F.col("places") - F.col("own")).alias("other"))
    good, n = confident_patterns(edges, rounds, confidence, support, storage.written(others, "other-words"))
    found = _with(nodes.where(~F.col("seed")), good.select("pattern"), n).groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("found"))
    text = F.array_join(F.transform("found", lambda x: F.concat(F.lit("found:"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string"))), ",")
    spans = F.concat_ws(",", F.when(F.col("spans") != "", F.col("spans")), text)
    return read.drop("nodes").join(found, "row", "left").select(F.col("id").alias(id_col), *(f"n_{k}" for k in KINDS), "base_sha256", spans.alias("spans"), "h1", "h2")


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rounds: int | None = None, confidence: float = 0.6, support: float = 3.0, least: int = 6, withheld: float = 0.5) -> DataFrame:
    """One row per input row: id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    ``spans``: kind:start:end in code points, end exclusive; the base kinds as listed, then
    ``secret`` (by its form), then ``found`` (by patterns; a withheld secret may be both).  A null
    text is empty and has no spans (the digest of the empty string); repeated rows get the same
    spans; an empty table gives an empty one; other columns, whatever their names, are not read.

    ``confidence``: least trusted share of a pattern's distinct instances, were no seeds withheld;
    ``support``: least trust in sum.  Only nodes are shuffled: distinct edges, combined before they
    are dealt out, and the occurrences that are joined to the confident patterns.
    """
    return _found(docs, id_col, text_col, rounds, confidence, support, least, withheld).drop("h1", "h2")


def redacted(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", mark: str = "[{}]", rounds: int | None = None, confidence: float = 0.6, support: float = 3.0, least: int = 6, withheld: float = 0.5) -> DataFrame:
    """``docs`` with each span of ``find`` replaced by its kind; spans that overlap are replaced as one, by the first one's.

    Every row stays, once: spans belong to a text, known by 128 bits of hashes, so rows of one id
    with different texts, repeated rows and rows without an id get what is in their own texts.  A
    null text stays null.  The columns are those of ``docs``, whatever their names.
    """
    kinds = docs.schema
    held = _found(docs, id_col, text_col, rounds, confidence, support, least, withheld)
    held = storage.written(held.where("spans != ''").groupBy("h1", "h2").agg(F.min("spans").alias("spans")), "spans-by-text")
    text, *hashes = _text(text_col)
    # merged at every size: a small table would else be broadcast while it is small only
    rows = docs.select(F.struct("*").alias("row"), text, *hashes).join(held.hint("merge"), ["h1", "h2"], "left").select("row", "text", "spans")

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if text and spans:
                    done, last = [], 0
                    for a, b, kind in sorted((int(a), int(b), k) for k, a, b in (x.split(":") for x in spans.split(","))):
                        if a >= last:
                            done += [text[last:a], mark.format(kind)]
                        last = max(last, b)
                    text = "".join([*done, text[last:]])
                out.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["row", "text"])

    done = rows.mapInArrow(replace, StructType([StructField("row", kinds), StructField("text", StringType())]))
    return done.select(*(F.col("text").cast(f.dataType).alias(f.name) if f.name == text_col else F.col("row")[f.name].alias(f.name) for f in kinds))
