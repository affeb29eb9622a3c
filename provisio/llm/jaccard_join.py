"""N-gram Jaccard join with a token-group matrix.

1. Each document's set of word shingles is reduced to keys: ``bands`` hashes of ``rows`` minima
   each.  There are so many that two sets at the threshold miss each other in all of them with a
   probability below 1e-12; a 64-bit hash stands for a shingle.  Documents with equal sets are
   one class.
2. Classes that share keys are partitioned into groups of similar ones: by the smallest class that
   they share a key with, by size, and by hash into groups of at most about ``GROUP``.
3. A group's token union is stored as the columns of a matrix over its members.  How many tokens
   of a query the union holds bounds the query's overlap with every member; only groups whose
   bound and sizes allow a link are opened, and only there are sets compared.
4. The first queries of a group are the smallest classes of its members' keys; what links is
   joined into components.  Most near copies of a text are done here, by one query.
5. Only classes that share a key across components are left.  Their shingles are ordered rarest
   first (by the doublings of their frequency), and two sets that link must share one of the first n - ceil(n * threshold) + 1 of them.
   Groups that share such a shingle meet in pairs, the members of one as queries of the other.

So every link comes from an opened group, no list of all pairs of a group is ever written, and
no task holds more than two groups and their queries.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provisio.llm import storage
from provisio.llm.bitmap import bitmap
from provisio.llm.components import components
from provisio.llm.words import Texts, inside, mix, slices, trim, windows

#: About as many classes make a group; tokens of queries that a matrix has columns for (one longer query is taken whole).
GROUP, COLUMNS = 64, 1 << 16
#: Bits of a shingle's hash in its rank; the others hold the doublings of its frequency.
RANK_BITS = 57


def shingles(texts: Texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and where each text's begin; shorter texts have their whole sequence as one."""
    low = texts.lower()
    start, end, first = low.split()
    h = low.hashes(start, end)
    at, n = inside(first, size)
    of = np.repeat(np.arange(len(n)), n)
    g = windows(h, size)[at] if len(at) else np.zeros(0, np.uint64)
    words = np.diff(first)
    for i in np.flatnonzero((words > 0) & (words < size)):
        g = np.append(g, windows(h[first[i] : first[i + 1]], int(words[i])) + np.uint64(words[i]))
        of = np.append(of, i)
    order = np.lexsort((g, of))
    g, of = g[order], of[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (of[1:] != of[:-1])
    return g[new], np.searchsorted(of[new], np.arange(len(words) + 1))


def bands_for(percent: int, rows: int) -> int:
    """Keys of ``rows`` minima, so that sets at the threshold share none with a probability below 1e-12."""
    return math.ceil(-12 * math.log(10) / math.log1p(-((percent / 100) ** rows))) if percent < 100 else 1


def _digest(g: np.ndarray, at: np.ndarray) -> list[pa.Array]:
    """Two 64-bit digests of each set of shingles; zeros for an empty one."""
    some = np.flatnonzero(np.diff(at))
    digest = np.zeros((2, len(at) - 1), np.uint64)
    if len(some):
        digest[0, some] = np.add.reduceat(mix(g), at[some])
        digest[1, some] = np.add.reduceat(mix(g ^ np.uint64(0xD6E8FEB86659FD93)), at[some])
    return [pa.array(d.view(np.int64)) for d in digest]


def _keys(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """(id, content, n, d1, d2, keys): the text's hash, the set's size, its digest and its keys."""
    rng = np.random.default_rng(11)
    factor = rng.integers(1, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "text"):
                g, at = shingles(texts, size)
                n = np.diff(at)
                some = np.flatnonzero(n)
                keys = np.zeros((len(n), bands), np.uint64)
                if len(some):
                    for b in range(bands):
                        key = np.full(len(some), b + 1, np.uint64)
                        for f in factor[b * rows : (b + 1) * rows]:
                            key = mix(key + np.minimum.reduceat(g * f, at[some]))
                        keys[some, b] = key
                held = np.where(n > 0, bands, 0)
                lists = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(held))).astype(np.int32), pa.array(keys[some].ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n.astype(np.int64)), *_digest(g, at), lists], names=["id", "content", "n", "d1", "d2", "keys"])

    return docs.mapInArrow(measure, "id long, content long, n long, d1 long, d2 long, keys array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(class, tokens) of the texts that stand for the wanted classes (class, row)."""
    has = bitmap(wanted, "row")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(has(batch.column(0).to_numpy())))
            for _, texts in slices(batch, "text"):
                g, at = shingles(texts, size)
                yield pa.RecordBatch.from_arrays([pa.array(np.diff(at).astype(np.int64)), *_digest(g, at), pa.ListArray.from_arrays(at.astype(np.int32), pa.array(g.view(np.int64)))], names=["n", "d1", "d2", "tokens"])

    found = docs.select(F.xxhash64("id", "content").alias("row"), "text").mapInArrow(measure, "n long, d1 long, d2 long, tokens array<long>")
    # tokens are shuffled once, by class: copies meet where the join has brought them, and buckets by class are written from there
    return found.select(F.xxhash64("d1", "d2", "n").alias("class"), "tokens").join(wanted.select("class").hint("merge"), "class").dropDuplicates(["class"])


def open_groups(queries: list[np.ndarray], members: list[np.ndarray], query_comp: np.ndarray, member_comp: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links (i, j) between some queries and the members of a group, enough to connect all that are linked; nothing within a component."""
    found: list[tuple[int, int]] = []
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    size, n = np.array([len(x) for x in queries]), np.array([len(x) for x in members])
    # the group's token union, and how many tokens of each query it holds
    every = np.concatenate(members)
    union = np.unique(every)
    held = np.array([np.isin(q, union, assume_unique=True).sum() if percent * len(q) <= 100 * n.max() and 100 * len(q) >= percent * n.min() else -1 for q in queries])
    may = np.flatnonzero(100 * held >= percent * size)
    of = np.repeat(np.arange(len(members)), n)
    low = 0
    while low < len(may):
        # the matrix's columns are the union's tokens that some queries hold, so many queries that it stays small
        high = low + 1
        while high < len(may) and size[may[low : high + 1]].sum() <= COLUMNS:
            high += 1
        columns = np.intersect1d(np.unique(np.concatenate([queries[i] for i in may[low:high]])), union, assume_unique=True)
        place = np.searchsorted(columns, every)
        place[place == len(columns)] = 0
        hit = columns[place] == every
        matrix = np.zeros((len(members), len(columns)), bool)
        matrix[of[hit], place[hit]] = True
        for i in may[low:high]:
            at = np.searchsorted(columns, queries[i])
            at[at == len(columns)] = 0
            shared = matrix[:, at[columns[at] == queries[i]]].sum(1)
            for j in np.flatnonzero(100 * shared >= percent * (size[i] + n - shared)):
                a, b = root(int(query_comp[i])), root(int(member_comp[j]))
                if a != b:
                    up[a] = b
                    found.append((int(i), int(j)))
        low = high
    return found


def _opened(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) from (task, side, class, comp, tokens): a group's members are of side 1, its queries of side 0."""
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def links(held: pa.RecordBatch) -> pa.RecordBatch:
        side, name, comp = (held.column(i).to_numpy() for i in (1, 2, 3))
        flat, at = held.column(4).flatten().to_numpy(), held.column(4).offsets.to_numpy()
        tokens = [flat[a:b] for a, b in zip(at[:-1] - at[0], at[1:] - at[0], strict=True)]
        query, member = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        found = open_groups([tokens[i] for i in query], [tokens[i] for i in member], comp[query], comp[member], percent) if len(query) and len(member) else []
        return pa.RecordBatch.from_pydict({"a": pa.array([name[query[i]] for i, _ in found], pa.int64()), "b": pa.array([name[member[j]] for _, j in found], pa.int64())})

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.RecordBatch | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            held = batch if rest is None else pa.concat_batches([rest, batch])
            task = held.column(0).to_numpy()
            cut = np.concatenate(([0], np.flatnonzero(task[1:] != task[:-1]) + 1))
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                yield links(held.slice(a, b - a))
            rest = held.slice(cut[-1])
            trim()
        if rest is not None:
            yield links(rest)
        trim()

    return rows.select("task", "side", "class", "comp", "tokens").repartition(parts, "task").sortWithinPartitions("task", "side", "class").mapInArrow(compare, "a long, b long")


def _classes(docs: DataFrame, size: int, percent: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """Every row (id, content, n, d1, d2), and every class (d1, d2, n, root, component): ``component`` is the smallest id of all with its ``root``."""
    spark = docs.sparkSession
    keyed = storage.Scratch(_keys(docs, size, bands_for(percent, rows), rows), "shingle-keys")
    read = storage.written(keyed.df.drop("keys"), "shingle-rows")
    classes = keyed.df.where("n > 0 and id is not null").groupBy("d1", "d2", "n").agg(F.min(F.struct("id", "content", "keys")).alias("x"))
    with_keys = storage.Scratch(classes.select("d1", "d2", "n", F.xxhash64("d1", "d2", "n").alias("class"), "x.*"), "keys-of-classes")
    keyed.drop()
    classes = storage.written(with_keys.df.drop("keys"), "shingle-classes")
    storage.tidied(spark)  # of keys and tokens, only what is still read stays on disk
    held = with_keys.df.select("class", "n", F.explode("keys").alias("key"))
    # tables are written before they are joined on a frequent value, so that its rows can be split
    hubs = storage.written(held.groupBy("key").agg(F.min("class").alias("hub"), F.count("*").alias("m")).where("m > 1").select("key", "hub"), "key-hubs")
    near = storage.written(held.join(hubs, "key"), "shared-keys")
    with_keys.drop()
    storage.tidied(spark)
    wanted = near.select("class").distinct().join(classes.select("class", F.xxhash64("id", "content").alias("row")), "class")
    wanted = storage.written(wanted, "wanted-classes")
    # of all that is shuffled, sets are the largest by far: they are kept by class, and what is joined to them goes to where they lie
    bucketed = storage.Bucketed(_sets(docs.where(F.col("id").isNotNull()), wanted, size), "shingle-sets", "class")
    sets = bucketed.df
    storage.tidied(spark)

    # groups: of one hub, and sizes that differ by less than half of what the threshold allows
    ratio = (100 / percent) ** 0.5 if percent < 100 else 1.0001
    group = near.groupBy("class", "n").agg(F.min("hub").alias("label")).withColumn("band", F.floor(F.log("n") / F.log(F.lit(ratio))).cast("int"))
    group = storage.written(group, "labels")
    count = storage.written(group.groupBy("label", "band").agg(F.ceil(F.count("*") / GROUP).alias("parts")), "label-sizes")
    member = group.join(count, ["label", "band"]).select("class", "n", F.xxhash64("label", "band", F.pmod(F.xxhash64("class"), F.col("parts"))).alias("grp"))
    member = storage.written(member, "groups")

    asking = near.where("class != hub").select("class", "hub").distinct().join(member.select("class", "grp"), "class").select("grp", "hub").distinct()
    asking = storage.written(asking, "queries-of-groups")
    queries = asking.select(F.col("grp").alias("task"), F.col("hub").alias("class"), F.lit(0).alias("side"))
    inside_ = member.join(asking.select("grp"), "grp", "left_semi").select(F.col("grp").alias("task"), "class", F.lit(1).alias("side"))
    rows_ = queries.unionByName(inside_).join(sets.select("class", "tokens"), "class").withColumn("comp", F.col("class"))
    links = storage.written(_opened(rows_, percent), "first-links")
    storage.tidied(spark)
    comp = storage.written(components(links), "first-components")
    named = lambda df: df.join(comp.select(F.col("node").alias("class"), "component"), "class", "left").withColumn("comp", F.coalesce("component", "class")).drop("component")

    # classes that share a key with another component
    mixed = storage.written(named(near.select("key", "class")).groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low != high").select("key"), "mixed-keys")
    left = storage.written(named(near.join(mixed, "key", "left_semi").select("class").distinct().join(member, "class")), "left-classes")
    spread = sets.join(left.select("class"), "class").select("class", F.explode("tokens").alias("token"))
    often = storage.written(spread.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "shared-shingles")
    storage.tidied(spark)
    # a number that orders by the doublings of a shingle's frequency, then by its hash; where two shingles have one number, more is compared
    rank = F.shiftleft(F.floor(F.log2("df")).cast("long"), RANK_BITS) + F.shiftrightunsigned("token", 64 - RANK_BITS)
    shared = spread.join(often, "token").select("class", rank.alias("t")).groupBy("class").agg(F.array_sort(F.collect_list("t")).alias("t")).join(left, "class")
    # rarest first: the unshared ones, then by frequency
    first = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - (F.col("n") - F.size("t"))
    prefix = shared.select("grp", "n", "comp", F.explode(F.slice("t", F.lit(1), F.greatest(F.lit(0), first).cast("int"))).alias("token"))
    posting = prefix.groupBy("token", "grp").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("n").alias("least"), F.max("n").alias("most"))
    posting = storage.written(posting, "rare-shingles")
    storage.tidied(spark)
    other = posting.select("token", *(F.col(c).alias(f"{c}2") for c in ("grp", "low", "high", "least", "most")))
    may = (F.col("grp") <= F.col("grp2")) & (F.greatest("high", "high2") > F.least("low", "low2"))
    may &= (F.col("most") * 100 >= F.col("least2") * percent) & (F.col("most2") * 100 >= F.col("least") * percent)
    pairs = posting.join(other, "token").where(may).select("grp", "grp2").distinct().withColumn("task", F.xxhash64("grp", "grp2"))
    pairs = storage.written(pairs, "group-pairs")
    sides = pairs.select("task", "grp", F.lit(0).alias("side")).unionByName(pairs.select("task", F.col("grp2").alias("grp"), F.lit(1).alias("side")))
    rows_ = sides.join(left.select("grp", "class", "comp"), "grp").join(sets.select("class", "tokens"), "class")
    more = storage.written(_opened(rows_, percent), "further-links")
    bucketed.forget()
    storage.tidied(spark)

    comp = storage.written(components(links.unionByName(more)).select(F.col("node").alias("class"), F.col("component").alias("root")), "components")
    label = storage.written(classes.select("d1", "d2", "n", "class", "id", "content").join(comp, "class", "left").withColumn("root", F.coalesce("root", "class")), "class-roots")
    least = storage.written(label.groupBy("root").agg(F.min("id").alias("component")), "component-names")
    return read, storage.written(label.join(least, "root").select("d1", "d2", "n", "root", "component"), "shingle-components")


def _read(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("content"))


def join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, rows: int = 3) -> DataFrame:
    """One row per input row: id, n_shingles, component_id.

    Two texts link when 100 * shared shingles >= ``percent`` * shingles of either; a component
    holds all texts that links reach, and is named by its smallest id.  A null text and one
    without words have no shingles and link with nothing; so does a row without an id, whose
    component is null.  Equal rows are returned as often as they come; rows of one id with
    different texts are told apart.  An empty table gives an empty one; other columns, whatever
    their names, are not read.
    """
    read, label = _classes(_read(docs, id_col, text_col), size, percent, rows)
    return read.join(label.select("d1", "d2", "n", "component"), ["d1", "d2", "n"], "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id")
    )


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, rows: int = 3) -> DataFrame:
    """``docs`` with one document of each component: that with its smallest id, the text with the smallest hash.

    Rows that repeat an id and its text are one document and stay together.  Texts without words
    and rows without an id stay.  The columns are those of ``docs``, whatever their names.
    """
    read, label = _classes(_read(docs, id_col, text_col), size, percent, rows)
    rows_ = read.where("n > 0 and id is not null").select("id", "content", "d1", "d2", "n").distinct().join(label, ["d1", "d2", "n"])
    rows_ = storage.written(rows_.select("id", "content", "root", "component"), "members")
    first = storage.written(rows_.where("id = component").groupBy("root").agg(F.min("content").alias("first")), "first-members")
    others = rows_.join(first, "root").where("id != component or content != first").select(F.col("id").alias("gone"), F.col("content").alias("its"))
    text = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    own = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("mine"), text.alias("text_hash"))
    others = others.select(F.col("gone").alias("mine"), F.col("its").alias("text_hash"))
    return own.join(others, ["mine", "text_hash"], "left_anti").select("row.*")
