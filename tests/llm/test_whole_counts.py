"""Exact duplicates, vector codes and the audit of sources against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from provisio.llm import exact_dedup, quotient_filter, source_divergence, spread, vector_codes

SPACE = re.compile("[\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, fp long, sha int, t string, row int, id string, n int, term string, p int, `a.b` int"


def rows_of(*texts: tuple) -> list[tuple]:
    """(id, text, lang, source) with columns whose names the operators use themselves."""
    return [(*t, 1, 2, "t", 3, "i", 4, "x", 5, 6) for t in texts]


def texts() -> list[tuple]:
    rng = random.Random(13)
    word = lambda: rng.choice(["a", "b", "Käse", "日本", "it's", "x1y", "DOG", "dog", "é"])
    sentence = lambda n: " ".join(word() for _ in range(n))
    some = [sentence(rng.randint(1, 12)) for _ in range(60)]
    some += [some[0]] * 150 + [some[1].replace(" ", "\t\n "), f" {some[1]}", f"\n{some[1]}", None, None, "", " ", "\t", "a b", "a b", "a" * 300_000, sentence(60_000), "\x00", "x\x85y"]
    return [(i if i % 17 else None, t, ("en", "fr", None, "")[i % 4 if i % 3 else 0], ("s", "t", None, "u", "w")[i * i % 5]) for i, t in enumerate(some)] + [(5, "twice", "en", "s")] * 3 + [(3, "twice", "de", "alone")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows_of(*texts()), SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ---- exact duplicates


def test_filters_lose_nothing():
    rng = np.random.Generator(np.random.PCG64(3))
    for n, top, bits in ((0, 9, 3), (1, 1, 1), (500, 40, 4), (5000, 1 << 63, 8), (3000, 1000, 1)):
        own = rng.integers(0, top, n, dtype=np.uint64) * np.uint64((1 << 63) // top + 1)
        own = np.concatenate((own, np.repeat(own[:2], 700)))
        found = quotient_filter.cut(own, bits)
        assert all(int(quotient_filter.items(b)[0][0]) >> (64 - bits) == s for s, b in found)
        got = [x for _, b in found for x in zip(*(a.tolist() for a in quotient_filter.items(b)), strict=True)]
        assert got == sorted(Counter(own.tolist()).items())


def test_filters_hold_long_counters_and_merge():
    own = np.array([0, 1, (1 << 56) + 5], np.uint64)
    counts = np.array([1, (1 << 50) + 3, 1 << 60], np.int64)  # several digits in slots of 16 bits
    blob = quotient_filter.pack(np.arange(1 << 16, dtype=np.uint64) << np.uint64(8), np.arange(1 << 16, dtype=np.int64) * 12345678901 + 1, 40)
    assert (quotient_filter.items(blob)[1] == np.arange(1 << 16) * 12345678901 + 1).all()
    a, b = quotient_filter.pack(own, counts, 0), quotient_filter.pack(own[1:], counts[1:], 0)
    fingerprints, sums = quotient_filter.merged([a, b, a])
    assert fingerprints.tolist() == own.tolist() and sums.tolist() == [2, 3 * ((1 << 50) + 3), 3 << 60]


def plain_groups(rows: list[tuple]) -> list[tuple]:
    by = defaultdict(list)
    for r in rows:
        by[SPACE.sub(" ", r[1] or "")].append(r[0])
    out = []
    for t, ids in by.items():
        ids = sorted(ids, key=lambda i: (i is None, i or 0))
        out += [(i, ids[0], len(ids), nth == 0, hashlib.sha256(t.encode()).hexdigest()) for nth, i in enumerate(ids)]
    return sorted(out, key=str)


def test_exact_groups(docs, empty):
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.groups(docs).collect()), key=str)
    assert got == plain_groups(texts())
    assert exact_dedup.groups(empty).collect() == []


def test_texts_that_share_a_fingerprint_are_told_apart(docs, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.groups(docs).collect()), key=str)
    assert got == plain_groups(texts())


def test_deduplicated_keeps_all_columns(docs, empty):
    got = exact_dedup.deduplicated(docs)
    assert got.columns == docs.columns and exact_dedup.deduplicated(empty).count() == 0
    want = {SPACE.sub(" ", r[1] or "") for r in texts()}
    rows = got.collect()
    assert {SPACE.sub(" ", r.text or "") for r in rows} == want and len(rows) == len(want)


def test_hot_keys_are_joined_by_broadcast(spark):
    from pyspark.sql import functions as F

    rows = spark.range(30_000).select("id", F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).cast("long").alias("k"))
    facts = rows.groupBy("k").agg(F.count("*").alias("n"), F.sum("id").alias("s")).where("k % 2 != 0")
    got = spread.joined(rows, facts, ["k"], "n", 30_000, F.col("id"))
    assert got.columns == ["id", "k", "s"]
    want = sum(i for i in range(0, 30_000, 3))
    assert {(r.id, r.s) for r in got.collect()} == {(i, want if i % 3 == 0 else i if i % 2 else None) for i in range(30_000)}


# ---- vector codes


def plain_codes(rows: list[tuple], parts: int, entries: int, rounds: int) -> list[tuple]:
    kept = [(i, [int(np.floor(1024 * x)) for x in v], label) for i, v, label in rows if v is not None and v and all(x is not None and np.isfinite(x) for x in v) and len(v) % parts == 0]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = len(order[0][1])
    kept, order = [r for r in kept if len(r[1]) == size], [r for r in order if len(r[1]) == size]
    width = size // parts
    cut = lambda v, part: v[part * width : (part + 1) * width]
    books = [[cut(r[1], part) for r in order[:entries]] for part in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def nearest(book, x):
        return min((far(x, c), k) for k, c in enumerate(book))[::-1]

    for _ in range(rounds):
        for part, book in enumerate(books):
            members = defaultdict(list)
            for r in kept:
                members[nearest(book, cut(r[1], part))[0]].append(cut(r[1], part))
            books[part] = [[sum(c) // len(members[k]) for c in zip(*members[k], strict=True)] if members[k] else c for k, c in enumerate(book)]
    digest = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    coded = [(r[0], [nearest(book, cut(r[1], part)) for part, book in enumerate(books)], r[2]) for r in kept]
    sums = Counter()
    for _, found, label in coded:
        sums[label] += sum(d for _, d in found)
    return sorted(((i, "".join(f"{k:02x}" for k, _ in found), sum(d for _, d in found), sums[label], digest) for i, found, label in coded), key=str)


def vectors(n: int, size: int, coarse: int) -> list[tuple]:
    """Few different components give many equal distances."""
    rng = np.random.Generator(np.random.PCG64(size))
    rows = [(i, (rng.integers(-coarse, coarse + 1, size) / 8).tolist(), [None, 1, 2][i % 3]) for i in range(n)]
    rows += [(None, rows[0][1], 1), (2, rows[3][1], None), (2, rows[2][1], 2), (900, None, 1), (901, [], 1), (902, [0.5] * (size - 1) + [None], 1), (903, [float("nan")] * size, 1), (904, [float("inf")] * size, 2), (905, [0.1] * (size + 1), 1), (906, [0.25] * (2 * size), 7)]
    return rows


@pytest.mark.parametrize(("n", "size", "coarse", "entries"), [(300, 8, 1, 40), (200, 12, 9, 256), (5, 4, 2, 256), (150, 4, 1, 16)])
def test_vector_codes(spark, n, size, coarse, entries):
    rows = vectors(n, size, coarse)
    df = spark.createDataFrame([(i, v, label, 1, 2, "n") for i, v, label in rows], "vec_id long, embedding array<double>, label int, id int, v int, name string").repartition(3)
    got = [tuple(r) for r in vector_codes.compressed(df, entries=entries).collect()]
    assert sorted(got, key=str) == plain_codes(rows, 4, entries, 4)


def test_vector_codes_of_nothing(spark):
    schema = "vec_id long, embedding array<float>, label string"
    for rows in ([], [(1, None, "a")]):
        got = vector_codes.compressed(spark.createDataFrame(rows, schema))
        assert got.collect() == [] and got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_kd_tree_finds_the_lowest_of_equal_entries():
    rng = np.random.Generator(np.random.PCG64(5))
    for width, top in ((1, 3), (4, 2), (16, 1), (3, 1 << 25), (16, 1 << 27)):  # the last ones in integers
        entries, points = rng.integers(-top, top + 1, (256, width)), rng.integers(-top, top + 1, (400, width))
        entries[128:140] = entries[:12]
        tree = vector_codes.Tree(entries, top)
        who, far = tree.nearest(points)
        d = ((points[:, None, :] - entries[None]) ** 2).sum(2)
        assert (who == d.argmin(1)).all() and (far == d.min(1)).all()
    with pytest.raises(ValueError, match="too large"):
        vector_codes.Tree(entries, 1 << 31)


# ---- divergence of sources


def plain_audit(rows: list[tuple], least: int, shown: int) -> list[tuple]:
    term = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    lower = {i: i + 32 for i in range(65, 91)}
    found = [(r[2] or "", r[3] or "", Counter(term.findall((r[1] or "").translate(lower)))) for r in rows]
    out = []
    for lang in {r[0] for r in found}:
        df = Counter(t for own, _, c in found if own == lang for t in c)
        kept = sorted(t for t in df if df[t] >= least)
        counts = defaultdict(Counter)
        for own, source, c in found:
            if own == lang:
                counts[source].update({t: c[t] for t in kept if t in c})
                counts[source] += Counter()
        every = Counter()
        for c in counts.values():
            every.update(c)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in counts.items()}, share(every)
        far = lambda a, b: (a - b) ** 2 // (a + b)
        for s in p:
            pairs = [(sum(far(p[s][t], p[o][t]) for t in kept), o) for o in p if o != s]
            terms = [(far(p[s][t], q[t]), t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, items, top in (("pair", pairs, None), ("term", terms, shown)):
                out += [(lang, s, part, o, v, n + 1) for n, (v, o) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode()))[:top])]
    return sorted(out)


@pytest.mark.parametrize(("least", "tile", "heavy", "held", "block"), [(10, 128, 4, 300_000, 500_000), (1, 2, 1, 3, 2), (2, 3, 2, 50, 4), (10**6, 2, 4, 9, 9)])
def test_audit(docs, empty, monkeypatch, least, tile, heavy, held, block):
    for name, value in (("TILE", tile), ("HEAVY", heavy), ("HELD", held), ("BLOCK", block), ("PIECE", 1000 if tile < 9 else 1 << 22)):
        monkeypatch.setattr(source_divergence, name, value)
    got = [tuple(r) for r in source_divergence.audit(docs, least=least, shown=4).collect()]
    assert sorted(got) == plain_audit(texts(), least, 4)
    assert source_divergence.audit(empty).collect() == []


def test_audit_of_many_sources(spark):
    rng = random.Random(2)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    rows = [(i, " ".join(words[min(299, int(rng.expovariate(0.02)))] for _ in range(20)), "en", f"s{rng.randint(0, 40)}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = sorted(tuple(r) for r in source_divergence.audit(df, least=3).collect())
    assert got == plain_audit(rows, 3, 10) and len(got) > 41 * 40


def test_shares_do_not_overflow(spark):
    from pyspark.sql import functions as F

    n, total, terms = 2 * 10**14, 2 * 10**14 + 12345, 10**9
    got = spark.range(1).select(source_divergence._share(F.lit(n), F.lit(total), F.lit(terms)).alias("p")).collect()[0].p
    assert got == 1 + 10**9 * (n + 2) // (total + 2 * terms)


# ---- faults mended in the other operators


def test_shortened_keeps_columns_of_any_name(spark):
    from provisio.llm import substring_dedup

    text = " ".join(f"w{i}" for i in range(30))
    schema = "words long, doc string, __a int, __doc int, __kept int, `a.b` int, text int, kept string"
    rows = [(1, text, 1, 2, 3, 4, 5, "k"), (2, f"x {text} y", 6, 7, 8, 9, 10, None), (None, None, 1, 1, 1, 1, 1, ""), (2, "", 0, 0, 0, 0, 0, "e"), (2, f"x {text} y", 6, 7, 8, 9, 11, None)]
    docs = spark.createDataFrame(rows, schema)
    got = substring_dedup.shortened(docs, id_col="words", text_col="doc")
    assert got.columns == docs.columns
    want = [(r[0], "x y" if r[1] and r[1][0] == "x" else r[1], *r[2:]) for r in rows]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    ids = substring_dedup.removed_words(docs, id_col="words", text_col="doc").collect()
    assert sorted((str(r.words), r.n_removed) for r in ids) == [("1", 0), ("2", 0), ("2", 30), ("2", 30), ("None", 0)]


def test_a_cosine_of_one_links_equal_directions(spark):
    from provisio.llm import embedding_dedup

    rows = [(1, [1.0, 0.0, 2.0]), (2, [1.0, 0.0, 2.0]), (3, [0.0, 1.0, 0.0]), (4, [2.0, 0.0, 4.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), cosine=1.0).collect()}
    assert got[1][1] == got[2][1] == 1 and got[3] == (0, 3)


def test_trust_grows_until_it_stays(spark):
    from provisio.llm import pii

    edges = [("A", x, x[0] == "s") for x in ("s1", "s2", "s3", "x", "y")] + [("C", x, x[0] == "t") for x in ("t1", "t2", "t3", "x", "y", "u1", "u2", "u3")]
    good, n = pii.confident_patterns(spark.createDataFrame(edges, "pattern string, instance string, seed boolean"), None, 0.6, 3.0)
    assert n == 2 and {r.pattern for r in good.collect()} == {"A", "C"}
