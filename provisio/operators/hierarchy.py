"""Trees stored as adjacency lists: ancestors, context lines, roots.

Walks are built by pointer doubling: every node that has children knows a stretch of what is above
it, and in each round the stretch of the node at its end is appended.  A tree of any depth takes
one join for each doubling of the longest walk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from provisio import shared

# Types that hold other units and are not searched themselves.
CONTAINERS = ("part", "book", "title", "division", "chapter", "section")


def paths(nodes: DataFrame, *, id_col: str = "id", parent_col: str = "parent_id", carried: tuple[str, ...] = ()) -> DataFrame:
    """(id, path) of the nodes that have children: what is above them, the parent first, as structs of the id and the ``carried`` columns.

    A walk starts at the parent without having met anything, and ends where the parent is missing
    or was met before: a node that is its own parent has itself above it once, and in a cycle
    every node has the whole cycle above it, itself last.  Leaves take no part in the rounds, and
    walks that are whole aren't joined again.
    """
    return _stretches(nodes, id_col, parent_col, carried).select("id", "path")


def _met_once(path: Column) -> Column:
    """A walk up to where it meets a node again; from there on it meets only what it has met."""
    return F.slice(path, 1, F.size(F.array_distinct(F.transform(path, lambda x: x["id"]))))


def _stretches(nodes: DataFrame, id_col: str, parent_col: str, carried: tuple[str, ...]) -> DataFrame:
    """(id, node, path) as of ``paths``, with the node's own struct."""
    own = nodes.select(F.col(id_col).alias("id"), F.col(parent_col).alias("up"), F.struct(F.col(id_col).alias("id"), *carried).alias("node"))
    inner = own.join(own.select(F.col("up").alias("id")).distinct(), "id", "left_semi")
    above = inner.select(F.col("id").alias("next"), F.array("node").alias("path"))
    none = F.array().cast(above.schema["path"].dataType)
    held = inner.join(above, F.col("up") == F.col("next"), "left").select("id", "node", F.coalesce("path", none).alias("path"), "next")
    while True:
        open_walks = Observation()
        held = shared.cut(held.observe(open_walks, F.count("next").alias("n")), "paths")
        if not open_walks.get["n"]:
            return held.drop("next")
        ends = held.select(F.col("id").alias("next"), F.col("path").alias("more"), F.col("next").alias("then"))
        longer = held.where("next is not null").join(ends, "next").withColumn("path", F.concat("path", "more"))
        once = _met_once(F.col("path"))
        longer = longer.select("id", "node", once.alias("path"), F.when(F.size(once) == F.size("path"), F.col("then")).alias("next"))
        held = held.where("next is null").unionByName(longer)


def walks(nodes: DataFrame, leaves: DataFrame, *, id_col: str = "id", parent_col: str = "parent_id", carried: tuple[str, ...] = ()) -> DataFrame:
    """(leaf, path) of the ``leaves`` (their ids, and their parents if these are there): as ``paths``, for any node; those without a known parent have no row."""
    below = leaves.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("leaf"), *(F.col(c).alias("up") for c in leaves.columns if c == parent_col))
    if parent_col not in leaves.columns:
        below = below.join(nodes.select(F.col(id_col).alias("leaf"), F.col(parent_col).alias("up")), "leaf")
    found = _stretches(nodes, id_col, parent_col, carried)
    found = found.select(F.col("id").alias("up"), _met_once(F.concat(F.array("node"), "path")).alias("path"))
    return below.join(found, "up").select("leaf", "path")


def ancestors(nodes: DataFrame, leaves: DataFrame, *, id_col: str = "id", parent_col: str = "parent_id") -> DataFrame:
    """(leaf, id, depth) of each leaf's ancestors, depth 1 for its parent; cycles as in ``paths``."""
    found = walks(nodes, leaves, id_col=id_col, parent_col=parent_col)
    return found.select("leaf", F.posexplode("path").alias("p", "node")).select("leaf", F.col("node.id").alias("id"), (F.col("p") + 1).alias("depth"))


def is_searchable(kind: Column, heading: Column, text: Column) -> Column:
    """Not unknown, not a container, and with text of its own."""
    body = F.trim(F.coalesce(text, F.lit("")))
    return ~kind.startswith("unknown") & ~kind.isin(*CONTAINERS) & (body != "") & ~F.coalesce(body == F.trim(heading), F.lit(False))


def context_line(kind: Column, label: Column, heading: Column, text: Column) -> Column:
    """An ancestor's line: with its text if that is searched, else its heading or label."""
    return F.when(is_searchable(kind, heading, text), F.concat(label, F.lit(" — "), F.trim(text))).otherwise(F.coalesce(heading, label))


def contexts(nodes: DataFrame, leaves: DataFrame) -> DataFrame:
    """(leaf, hierarchy): context lines, root first, of nodes (id, parent_id, provision_type, citation_label, heading, text)."""
    line = context_line(*(F.col(c) for c in ("provision_type", "citation_label", "heading", "text")))
    found = walks(nodes.select("id", "parent_id", line.alias("line")), leaves, carried=("line",))
    return found.select("leaf", F.reverse(F.transform("path", lambda x: x["line"])).alias("hierarchy"))


def document_content(title: Column, hierarchy: Column, label: Column, text: Column) -> Column:
    """What is indexed: title, context, label and text, without blanks, a line each."""
    parts = F.concat(F.array(title), F.coalesce(hierarchy, F.array().cast("array<string>")), F.array(label, text))
    return F.array_join(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != ""), "\n")


def with_roots(nodes: DataFrame, *, id_col: str = "id", parent_col: str = "parent_id") -> DataFrame:
    """``nodes`` with is_root: no parent, or one that is missing."""
    present = nodes.select(F.col(id_col).alias("__present"))
    return nodes.join(present, nodes[parent_col] == F.col("__present"), "left").withColumn("is_root", F.col("__present").isNull()).drop("__present")


def citation_matches(nodes: DataFrame, citation: dict[str, str | None]) -> DataFrame:
    """Ids of the units that a citation names: the deepest level on the unit itself, every other one on it or above it.

    ``nodes``: id, parent_id, provision_type, article, paragraph, point, letter.  No level is relaxed.
    """
    from provisio.functions.citation import LEVELS, TYPES

    named = [k for k in LEVELS if citation.get(k)]
    if not named:
        return nodes.select("id").limit(0)
    leaf = nodes.where(F.col("provision_type").isin(*TYPES[named[0]]) & (F.col(named[0]) == citation[named[0]]))
    if len(named) == 1:
        return leaf.select("id").distinct()
    own = [(F.col(k) == citation[k]).alias(f"has_{k}") for k in named[1:]]
    chain = ancestors(nodes, leaf.select("id")).select("leaf", "id").unionByName(leaf.select(F.col("id").alias("leaf"), "id"))
    held = chain.join(nodes.select("id", *own), "id").groupBy("leaf").agg(*(F.bool_or(f"has_{k}").alias(f"has_{k}") for k in named[1:]))
    return held.where(" and ".join(f"has_{k}" for k in named[1:])).select(F.col("leaf").alias("id"))
