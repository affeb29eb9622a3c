"""Language-model scores by a hierarchical Pitman-Yor model of words.

Words are lower-cased (A-Z); each text ends with one end token.  Every previous word has a
restaurant of its own over all words; all of them share one parent restaurant, whose base is
uniform over the training words and one unknown word.  No pair, context or word is left out.

The restaurants lie on a grid of buckets: a pair of words belongs to the row of its context and
the column of its word, so a frequent context is spread over a whole row and a frequent word over
a column.  Texts are read once and become chunks of about ``CHUNK`` tokens.

1. Words get numbers, by shards of their 64-bit hashes; chunks learn the numbers of their words.
2. A chunk sends each bucket its distinct pairs, how often they were seen in training, and which
   of its texts hold them.  A bucket adds up its pairs.
3. Gibbs sweeps: buckets seat the customers of every pair anew, given the context's tables and the
   word's probability of the sweep before; rows add up the tables of contexts, columns those of
   words, whose customers are then seated in the parent.  Only pairs seen more than once take part:
   a pair seen once has one table in every sweep.
4. After the first sweeps each one is a sample.  Buckets average the predictive probabilities of
   all their pairs over the samples and add up their logarithms for each text.

Seating a pair's customers one after the other gives each a new table with the Chinese-restaurant
probability; beyond 64 customers they come in runs of an eighth of those seated, with a binomial
number of new tables.  Draws come from hashes of the pair and the sweep, so they don't depend on
how rows are dealt.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provisio.llm import storage
from provisio.llm.blobs import pack, unpack
from provisio.llm.words import Texts, mix, slices, trim

#: Stands for the end token; no word's hash is kept apart from it by chance only.
END = np.uint64(0x5BD1E9955BD1E995)
#: Tokens of a chunk, bits of a word's number within its column.
CHUNK, BITS = 1 << 20, 24
_MASK = (1 << BITS) - 1


def stream(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text's words and its end token, and where each text's begin."""
    low = texts.lower()
    start, end, first = low.split()
    n = np.diff(first)
    out = np.full(len(start) + len(n), END, np.uint64)
    out[np.arange(len(start)) + np.repeat(np.arange(len(n)), n)] = low.hashes(start, end)
    return out, first + np.arange(len(n) + 1)


class Drawn:
    """Draws that depend on a row's key and the number of the draw only."""

    def __init__(self, key: np.ndarray):
        self.key, self.i = key, 0

    def _next(self, k: int) -> np.ndarray:
        self.i += 1
        return mix(self.key[:k] + np.uint64(self.i * 0x9E3779B97F4A7C15 & (1 << 64) - 1))

    def random(self, k: int) -> np.ndarray:
        return (self._next(k) >> np.uint64(11)) * 2.0**-53

    def binomial(self, n: np.ndarray, p: np.ndarray) -> np.ndarray:
        return np.random.Generator(np.random.PCG64(int(self._next(1)[0]))).binomial(n, p).astype(np.float64)


def seat(n: np.ndarray, strength: np.ndarray, base: np.ndarray, discount: float, key: np.ndarray) -> np.ndarray:
    """Sampled numbers of tables for dishes with ``n`` customers each; ``strength``: theta + discount * the restaurant's tables."""
    order = np.lexsort((key, -n))
    n, new, rng = n[order].astype(np.float64), (strength * base)[order], Drawn(key[order])
    tables = np.minimum(n, 1)
    i = 1
    while True:
        k = int(np.searchsorted(-n, -i, "left"))  # dishes with more than i customers
        if not k:
            break
        step = 1 if i < 64 else i // 8
        run = 1 if i < 64 else np.minimum(n[:k] - i, step)
        here = i + (run - 1) / 2
        p = new[:k] / (new[:k] + np.maximum(here - discount * tables[:k], 1e-9))
        tables[:k] += rng.random(k) < p if i < 64 else rng.binomial(run.astype(np.int64), p)
        i += step
    out = np.empty(len(tables), np.int64)
    out[order] = tables
    return out


def discount_from(one: float, two: float) -> float:
    return min(0.95, max(0.05, (one + 0.5) / (one + 2 * two + 1)))


class Grid:
    """``side`` rows and columns of buckets; four shards of words make a row, and the same four a column."""

    def __init__(self, parts: int):
        self.side = 1
        while self.side**2 < parts and self.side < 256:
            self.side *= 2
        self.shards, self.buckets = 4 * self.side, self.side**2
        self.shift = np.uint64(64 - (self.shards.bit_length() - 1))

    def number(self, words: dict[int, int]) -> None:
        """``words``: the numbers of words of each shard."""
        n = np.array([words.get(s, 0) for s in range(self.shards)], np.int64).reshape(self.side, 4)
        self.offset = (np.cumsum(n, axis=1) - n).ravel()  # of a shard's words among those of its row
        self.sizes = n.sum(1)
        if self.sizes.max() > _MASK:
            raise ValueError("a row has too many words: raise spark.sql.shuffle.partitions")


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[dict]]]:
    """Rows of each value of ``key``, from batches sorted by it."""
    now, held = None, []
    for batch in batches:
        for i in range(batch.num_rows):  # a row holds a large piece
            row = {name: column[i].as_py() for name, column in zip(batch.schema.names, batch.columns, strict=True)}
            if held and row[key] != now:
                yield now, held
                held = []
            now = row[key]
            held.append(row)
    if held:
        yield now, held


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def _dealt(df: DataFrame, parts: int, key: str, *then: str) -> DataFrame:
    return df.repartition(parts, key).sortWithinPartitions(key, *then)


def chunks(docs: DataFrame, grid: Grid) -> DataFrame:
    """(chunk, ids, held, n, tokens, vocab): texts as numbers of their chunk's words; ``vocab``: those words by shard, and their training counts."""
    word = pa.list_(pa.struct([("shard", pa.int32()), ("words", pa.binary()), ("n", pa.binary())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name, held, size = TaskContext.get().partitionId() << 32, [], 0

        def whole() -> pa.RecordBatch:
            ids = pa.concat_arrays([x[0] for x in held])
            out, h, n = (np.concatenate([x[i] for x in held]) for i in (1, 2, 3))
            words, place = np.unique(h, return_inverse=True)
            seen = np.bincount(place, np.repeat(~out, n), len(words)).astype(np.int64)
            at = np.searchsorted(words >> grid.shift, np.arange(grid.shards + 1).astype(np.uint64))
            vocab = [{"shard": s, "words": pack(words[a:b], True), "n": pack(seen[a:b])} for s, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)) if b > a]
            one = np.array([0, len(n)], np.int32)
            lists = [pa.ListArray.from_arrays(one, x) for x in (ids, pa.array(out), pa.array(n.astype(np.int64)))]
            return pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), *lists, pa.array([pack(place)], pa.binary()), pa.array([vocab], word)], names=["chunk", "ids", "held", "n", "tokens", "vocab"])

        for batch in batches:
            for part, texts in slices(batch, "text"):
                h, at = stream(texts)
                held.append((part.column(0), part.column(1).to_numpy(zero_copy_only=False).astype(bool), h, np.diff(at)))
                size += len(h)
                if size >= CHUNK:
                    yield whole()
                    name, held, size = name + 1, [], 0
                    trim()
        if held:
            yield whole()

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(cut, f"chunk long, ids array<{kind}>, held array<boolean>, n array<long>, tokens binary, vocab array<struct<shard:int,words:binary,n:binary>>")


def numbered(held: DataFrame, grid: Grid, parts: int) -> DataFrame:
    """(shard, chunk, place, n, size, tokens, words): a chunk's words by their numbers, with their training counts; a shard's totals where ``chunk`` is null."""
    names = pa.schema([("shard", pa.int32()), ("chunk", pa.int64()), ("place", pa.binary()), ("n", pa.binary()), ("size", pa.int64()), ("tokens", pa.int64()), ("words", pa.int64())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _runs(batches, "shard"):
            words = [unpack(r["words"]).astype(np.uint64) for r in rows]
            every, place = np.unique(np.concatenate(words), return_inverse=True)
            n = np.bincount(place, np.concatenate([unpack(r["n"]) for r in rows]), len(every)).astype(np.int64)
            yield _table([(shard, None, None, None, len(every), int(n.sum()), int((n > 0).sum()))], names)
            at = 0
            for r, w in zip(rows, words, strict=True):
                own = place[at : at + len(w)]
                at += len(w)
                yield _table([(shard, r["chunk"], pack(own, True), pack(n[own]), None, None, None)], names)
        trim()

    rows = held.select("chunk", F.explode("vocab").alias("x")).select("chunk", "x.shard", "x.words", "x.n")
    return _dealt(rows, min(parts, grid.shards), "shard", "chunk").mapInArrow(number, "shard int, chunk long, place binary, n binary, size long, tokens long, words long")


_ASKED = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), *((x, pa.binary()) for x in ("codes", "n", "each", "doc", "times", "known", "base"))])


def met(held: DataFrame, words: DataFrame) -> DataFrame:
    """(chunk, held, n, tokens, words): chunks with the numbers of their words."""
    its = words.where(F.col("chunk").isNotNull()).groupBy("chunk").agg(F.collect_list(F.struct("shard", "place", "n")).alias("words"))
    return held.select("chunk", "held", "n", "tokens").join(its, "chunk").select("chunk", "held", "n", "tokens", "words")


def asked(rows: DataFrame, grid: Grid) -> DataFrame:
    """(bucket, chunk, codes, n, each, doc, times): a chunk's pairs, their training counts, how many of its texts hold each, which, and how often.

    One more row of a chunk, with ``known`` and ``base``, holds the sums of its texts that need no pairs.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                chunk, out, n, tokens, its = (batch.column(k)[i].as_py() for k in range(5))
                its.sort(key=lambda x: x["shard"])
                places = [unpack(x["place"]) for x in its]
                number = np.concatenate([grid.offset[x["shard"]] + p for x, p in zip(its, places, strict=True)]).astype(np.uint64)
                row = np.repeat(np.array([x["shard"] // 4 for x in its], np.uint64), [len(p) for p in places])
                seen = np.concatenate([unpack(x["n"]) for x in its])
                word, n = unpack(tokens), np.array(n)
                of = np.repeat(np.arange(len(n)), n)
                # every text ends with the end token, so it also stands before each text's first word
                before = np.concatenate((word[-1:], word[:-1]))
                known, base = np.bincount(of, seen[word] > 0, len(n)).astype(np.int64), np.bincount(of, np.log10(seen[word] + 1.0), len(n))
                yield _table([(int(chunk % grid.buckets), chunk, None, None, None, None, None, pack(known), pack(base))], _ASKED)
                key = (row[before] * np.uint64(grid.side) + row[word]) << np.uint64(2 * BITS) | number[before] << np.uint64(BITS) | number[word]
                order = np.argsort(key, kind="stable")
                key, of, trained = key[order], of[order], ~np.array(out, bool)[of[order]]
                new = np.append(True, key[1:] != key[:-1])
                entry = new | np.append(True, of[1:] != of[:-1])
                first, at = np.flatnonzero(new), np.flatnonzero(entry)
                times, doc = np.diff(at, append=len(key)), of[at]
                count = np.add.reduceat(trained.astype(np.int64), first)
                lead = np.searchsorted(at, first)
                each = np.diff(lead, append=len(at))
                bucket, code = key[first] >> np.uint64(2 * BITS), key[first] & np.uint64((1 << 2 * BITS) - 1)
                cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
                rows = []
                for a, b in zip(cut, np.append(cut[1:], len(first)), strict=True):
                    x, y = lead[a], lead[b] if b < len(lead) else len(at)
                    rows.append((int(bucket[a]), chunk, pack(code[a:b], True), pack(count[a:b]), pack(each[a:b]), pack(doc[x:y]), pack(times[x:y]), None, None))
                yield _table(rows, _ASKED)
        trim()

    return rows.mapInArrow(ask, "bucket int, chunk long, " + ", ".join(f"{x} binary" for x in _ASKED.names[2:]))


_MERGED = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("to", pa.int32()), *((x, pa.binary()) for x in "xyzt"), ("one", pa.int64()), ("two", pa.int64()), ("kind", pa.string())])


def merged(rows: DataFrame, grid: Grid, parts: int) -> DataFrame:
    """What the buckets hold, by kind.

    ``pairs``: codes and counts; ``more``: those counted more than once; ``doc``: of a chunk, the places of its pairs, and its texts;
    ``sum``: a chunk's other sums; ``to``: for a row, its contexts' customers, pairs seen once and more often; for a column, its words' pairs seen once and more often.
    """
    g = grid.side

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, every in _runs(batches, "bucket"):
            rows = [(bucket, r["chunk"], None, r["known"], r["base"], None, None, None, None, "sum") for r in every if r["known"] is not None]
            if rows:
                yield _table(rows, _MERGED)
            held = [r for r in every if r["codes"] is not None]
            if not held:
                continue
            lists = [unpack(r["codes"]) for r in held]
            codes, place = np.unique(np.concatenate(lists), return_inverse=True)
            n = np.bincount(place, np.concatenate([unpack(r["n"]) for r in held]), len(codes)).astype(np.int64)
            at = 0
            for r, own in zip(held, lists, strict=True):
                yield _table([(bucket, r["chunk"], None, pack(place[at : at + len(own)], True), r["each"], r["doc"], r["times"], None, None, "doc")], _MERGED)
                at += len(own)
            context, word, i, j = codes >> BITS, codes & _MASK, bucket // g, bucket % g
            once, more = n == 1, n > 1
            of = lambda what, by, k: np.bincount(by, what, grid.sizes[k]).astype(np.int64)  # noqa: E731, B023
            yield _table(
                [
                    (bucket, None, None, pack(codes, True), pack(n), None, None, int(once.sum()), int((n == 2).sum()), "pairs"),
                    (bucket, None, None, pack(codes[more], True), pack(n[more]), None, None, None, None, "more"),
                    (bucket, None, i, pack(np.concatenate((of(n, context, i), of(once, context, i), of(more, context, i)))), None, None, None, None, None, "to"),
                    (bucket, None, g + j, pack(np.concatenate((of(once, word, j), of(more, word, j)))), None, None, None, None, None, "to"),
                ],
                _MERGED,
            )
        trim()

    return _dealt(rows, parts, "bucket", "chunk").mapInArrow(merge, "bucket int, chunk long, to int, x binary, y binary, z binary, t binary, one long, two long, kind string")


class Sampler:
    """The grid's restaurants and their Gibbs sweeps."""

    def __init__(self, held: DataFrame, grid: Grid, parts: int, words: int, strength: float):
        self.grid, self.parts, self.strength, self.base = grid, parts, strength, 1.0 / (words + 1)
        kind = lambda k: held.where(F.col("kind") == k)
        self.more = kind("more").select("bucket", F.lit(0).alias("kind"), "x", "y")
        one, two = kind("pairs").agg(F.coalesce(F.sum("one"), F.lit(0)), F.coalesce(F.sum("two"), F.lit(0))).first()
        self.d2, self.d1 = discount_from(one, two), 0.5
        self.fixed = storage.Scratch(self._added(kind("to").select("to", F.lit(0).alias("kind"), "x"), lambda to, x, _: x), "lm-fixed")

    def _added(self, messages: DataFrame, close: Callable[[int, np.ndarray, np.ndarray | None], np.ndarray]) -> DataFrame:
        """(to, x, customers, tables, one, two): the sum of a row's or column's messages, closed by ``close``; the totals of a column's."""
        names = pa.schema([("to", pa.int32()), ("x", pa.binary()), *((c, pa.int64()) for c in ("customers", "tables", "one", "two"))])
        side = self.grid.side

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for to, rows in _runs(batches, "to"):
                total: dict[int, np.ndarray] = {}
                for r in rows:
                    x = unpack(r["x"])
                    total[r["kind"]] = total[r["kind"]] + x if r["kind"] in total else x
                x = close(to, total[0], total.get(1))
                served, tables = np.split(x, 2) if to >= side else (x[:0], x[:0])
                yield _table([(to, pack(x), int(served.sum()), int(tables.sum()), int((served == 1).sum()), int((served == 2).sum()))], names)

        return _dealt(messages, min(self.parts, 2 * side), "to").mapInArrow(add, "to int, x binary, customers long, tables long, one long, two long")

    def seat_parent(self, messages: DataFrame | None, sweep: int) -> storage.Scratch:
        """The tables of contexts, and customers and tables of words, after a sweep's messages; before the first sweep each pair has one table."""
        side, strength, base, d1, above = self.grid.side, self.strength, self.base, self.d1, getattr(self, "tables", None)

        def close(to: int, fixed: np.ndarray, more: np.ndarray | None) -> np.ndarray:
            fixed = np.split(fixed, 3 if to < side else 2)
            here = fixed[-2] + (fixed[-1] if above is None else 0 if more is None else more)
            if to < side:
                return here
            if above is None:
                return np.concatenate((here, np.minimum(here, 1)))
            key = mix(np.arange(len(here), dtype=np.uint64) + np.uint64((to + 1) << 40) + mix(np.array([sweep + 1], np.uint64)))
            return np.concatenate((here, seat(here, np.full(len(here), strength + d1 * above), np.full(len(here), base), d1, key)))

        rows = self.fixed.df.select("to", F.lit(0).alias("kind"), "x")
        out = storage.Scratch(self._added(rows if messages is None else rows.unionByName(messages), close), "lm-tables")
        self.customers, self.tables, one, two = (int(x or 0) for x in out.df.where(F.col("to") >= side).agg(*(F.sum(c) for c in ("customers", "tables", "one", "two"))).first())
        self.d1 = discount_from(one, two)
        return out

    def parent(self) -> Callable[[np.ndarray], np.ndarray]:
        """A function from a column's customers and tables to its words' probabilities."""
        d1, strength, base, customers, tables = self.d1, self.strength, self.base, self.customers, self.tables

        def p(x: np.ndarray) -> np.ndarray:
            served, t = np.split(x, 2)
            return (served - d1 * t + (strength + d1 * tables) * base) / (strength + customers)

        return p

    def to_buckets(self, vectors: DataFrame, row_kind: int, column_kind: int) -> DataFrame:
        """A row's vector for each of its buckets, and a column's."""
        g = self.grid.side
        of_row = F.transform(F.sequence(F.lit(0), F.lit(g - 1)), lambda k: F.col("to") * g + k)
        of_column = F.transform(F.sequence(F.lit(0), F.lit(g - 1)), lambda k: k * g + F.col("to") - g)
        at = F.when(F.col("to") < g, of_row).otherwise(of_column)
        return vectors.select(F.explode(at.cast("array<int>")).alias("bucket"), F.when(F.col("to") < g, row_kind).otherwise(column_kind).alias("kind"), "x", F.lit(None).cast("binary").alias("y"))

    def sweep(self, vectors: DataFrame, number: int) -> storage.Scratch:
        """(bucket, to, kind, x): messages to rows and columns, and each bucket's own tables where ``to`` is null."""
        grid, strength, d2, parent = self.grid, self.strength, self.d2, self.parent()
        names = pa.schema([("bucket", pa.int32()), ("to", pa.int32()), ("kind", pa.int32()), ("x", pa.binary())])

        def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for bucket, rows in _runs(batches, "bucket"):
                if rows[0]["kind"] != 0:
                    continue  # a bucket without pairs
                codes, n = unpack(rows[0]["x"]), unpack(rows[0]["y"])
                tables, p = unpack(rows[1]["x"]), parent(unpack(rows[2]["x"]))
                context, word = codes >> BITS, codes & _MASK
                key = mix(codes.astype(np.uint64) + np.uint64(bucket << 48) + mix(np.array([number + 1], np.uint64)))
                t = seat(n, strength + d2 * tables[context], p[word], d2, key)
                i, j = bucket // grid.side, bucket % grid.side
                for_row, for_column = (np.bincount(by, t, grid.sizes[k]).astype(np.int64) for by, k in ((context, i), (word, j)))
                yield _table([(bucket, None, 1, pack(t)), (bucket, i, 1, pack(for_row)), (bucket, grid.side + j, 1, pack(for_column))], names)
            trim()

        rows = self.more.unionByName(self.to_buckets(vectors, 1, 2))
        return storage.Scratch(_dealt(rows, self.parts, "bucket", "kind").mapInArrow(sample, "bucket int, to int, kind int, x binary"), "lm-sweep")

    def sampled(self, burn: int, kept: int) -> list[tuple[storage.Scratch, storage.Scratch, Callable]]:
        """Of each kept sweep: its seats, the tables after it, and the parent's probabilities."""
        out, now = [], self.seat_parent(None, 0)
        for k in range(burn + kept):
            seats = self.sweep(now.df, k)
            after = self.seat_parent(seats.df.where(F.col("to").isNotNull()).select("to", "kind", "x"), k + 1)
            if k <= burn:
                now.drop()
            if k >= burn:
                out.append((seats, after, self.parent()))
            else:
                seats.drop()
            now = after
        return out


def summed(held: DataFrame, sampler: Sampler, samples: list, parts: int) -> DataFrame:
    """(chunk, doc, sums): log10 probabilities of a chunk's texts by the pairs of each bucket."""
    strength, d2, parents = sampler.strength, sampler.d2, [p for _, _, p in samples]
    names = pa.schema([("chunk", pa.int64()), ("doc", pa.binary()), ("sums", pa.binary())])

    def price(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ready, held = None, None, {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: column[i].as_py() for name, column in zip(batch.schema.names, batch.columns, strict=True)}
                if row["bucket"] != now:
                    now, ready, held = row["bucket"], None, {}
                if row["kind"] < 1000:
                    held[row["kind"]] = (row["x"], row["y"])
                    continue
                if ready is None:
                    codes, n = (unpack(x) for x in held[0])
                    context, word, more = codes >> BITS, codes & _MASK, n > 1
                    customers = np.split(unpack(held[1][0]), 3)[0][context]
                    p = np.zeros(len(codes))
                    for k, parent in enumerate(parents):
                        t = np.minimum(n, 1)
                        t[more] = unpack(held[10 + 3 * k][0])
                        tables = unpack(held[11 + 3 * k][0])[context]
                        p += (n - d2 * t + (strength + d2 * tables) * parent(unpack(held[12 + 3 * k][0]))[word]) / (strength + customers)
                    ready = np.log10(p / len(parents))
                place, each, doc, times = (unpack(row[x]) for x in "xyzt")
                sums = np.bincount(doc, np.repeat(ready[place], each) * times)
                some = np.unique(doc)
                yield _table([(row["chunk"], pack(some, True), pack(sums[some]))], names)
        trim()

    none = lambda *names: [F.lit(None).cast("binary").alias(c) for c in names]
    kind = lambda k: held.where(F.col("kind") == k)
    no_chunk = F.lit(None).cast("long").alias("chunk")
    vectors = kind("pairs").select("bucket", F.lit(0).alias("kind"), "x", "y").unionByName(sampler.to_buckets(sampler.fixed.df.where(F.col("to") < sampler.grid.side), 1, 2))
    for k, (seats, after, _) in enumerate(samples):
        own = seats.df.where(F.col("to").isNull()).select("bucket", F.lit(10 + 3 * k).alias("kind"), "x", F.lit(None).cast("binary").alias("y"))
        vectors = vectors.unionByName(own).unionByName(sampler.to_buckets(after.df, 11 + 3 * k, 12 + 3 * k))
    rows = vectors.select("bucket", "kind", no_chunk, "x", "y", *none("z", "t")).unionByName(kind("doc").select("bucket", F.lit(1000).alias("kind"), "chunk", "x", "y", "z", "t"))
    return _dealt(rows, parts, "bucket", "kind").mapInArrow(price, "chunk long, doc binary, sums binary")


def gathered(sums: DataFrame, held: DataFrame, parts: int) -> DataFrame:
    """(chunk, known, base, score): lists over a chunk's texts."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, rows in _runs(batches, "chunk"):
            known, base = next((unpack(r["known"]), unpack(r["base"])) for r in rows if r["known"] is not None)
            score = np.zeros(len(known))
            for r in rows:
                if r["doc"] is not None:
                    score[unpack(r["doc"])] += unpack(r["sums"])
            one = np.array([0, len(known)], np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), *(pa.ListArray.from_arrays(one, pa.array(x)) for x in (known, base, score))], names=["chunk", "known", "base", "score"])

    none = lambda *names: [F.lit(None).cast("binary").alias(c) for c in names]
    others = held.where(F.col("kind") == "sum").select("chunk", F.col("x").alias("known"), F.col("y").alias("base"), *none("doc", "sums"))
    rows = others.unionByName(sums.select("chunk", *none("known", "base"), "doc", "sums"))
    return _dealt(rows, parts, "chunk").mapInArrow(add, "chunk long, known array<long>, base array<double>, score array<double>")


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held: int = 2, burn: int = 2, kept: int = 3, strength: float = 1.0) -> DataFrame:
    """One row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A null text is empty and has the end token only; a row without an id counts as held out;
    repeated rows are scored alike, and each of them counts in training.  Without any training
    text every word is unknown.  An empty table gives an empty one; other columns, whatever their
    names, are not read.
    """
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    grid = Grid(parts)
    out = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == held, F.lit(True))
    docs = docs.select(F.col(id_col).alias("id"), out.alias("held"), F.col(text_col).cast("string").alias("text"))
    cut = storage.Scratch(chunks(docs, grid), "lm-chunks")
    words = storage.Scratch(numbered(cut.df, grid, parts), "lm-words")
    totals = words.df.where(F.col("chunk").isNull()).select("shard", "size", "tokens", "words").collect()  # a row for each shard
    grid.number({r["shard"]: r["size"] for r in totals})
    n, v = sum(r["tokens"] for r in totals), sum(r["words"] for r in totals)
    storage.tidied(spark)
    # written, so that word lists and their shuffles leave the disk before the pairs come
    ready = storage.Scratch(met(cut.df, words.df), "lm-numbered")
    texts = storage.Scratch(cut.df.select("chunk", "ids", "held", "n"), "lm-texts")
    for x in (cut, words):
        x.drop()
    storage.tidied(spark)
    buckets = storage.Scratch(merged(asked(ready.df, grid), grid, parts), "lm-buckets", by="kind")
    ready.drop()
    storage.tidied(spark)
    sampler = Sampler(buckets.df, grid, parts, v, strength)
    samples = sampler.sampled(burn, kept)
    storage.tidied(spark)
    sums = storage.Scratch(gathered(summed(buckets.df, sampler, samples, parts), buckets.df, parts), "lm-sums")
    for x in (buckets, sampler.fixed, *(y for s in samples for y in s[:2])):
        x.drop()
    storage.tidied(spark)
    each = F.arrays_zip("ids", "held", F.col("n").alias("n_tokens"), "known", "base", "score")
    rows = texts.df.join(sums.df, "chunk").select(F.inline(each).alias("id", "held_out", "n_tokens", "n_known", "base", "score"))
    return rows.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * float(np.log10(n + v + 1.0))).alias("base_score"), "score",
    )
