"""The catalogue of acts: filtered lists, options, details, tables of contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provisio import shared

LISTED = 200


def listed(acts: DataFrame, term: str | None = None, *, columns: list[str], order: list[str], equal: dict[str, object] | None = None, limit: int = LISTED) -> DataFrame:
    """Acts whose columns equal what is asked and one of whose texts holds the term; % and _ in it are wildcards."""
    for column, value in (equal or {}).items():
        if value is not None:
            acts = acts.where(F.col(column) == value)
    if term and term.strip():
        hit = F.lit(False)
        for c in columns:
            hit |= F.coalesce(F.col(c).ilike(f"%{term.strip()}%"), F.lit(False))
        acts = acts.where(hit)
    return acts.orderBy(*order).limit(limit)


def with_display(rows: DataFrame, versions: DataFrame, counts: DataFrame, key: str, wanted: Column | None = None) -> DataFrame:
    """Listed acts with their shown version and its number of provisions; ``wanted`` filters after the limit, as it looks at the version."""
    out = rows.join(versions, key, "left").join(counts, key, "left")
    return out if wanted is None else out.where(wanted)


def provision_counts(provisions: DataFrame, by: str = "version_id") -> DataFrame:
    return provisions.groupBy(by).agg(F.count("*").alias("n_provisions"))


def options(acts: DataFrame, columns: dict[str, bool]) -> DataFrame:
    """(column, value, position) of all values that occur, in order from 1: ascending where true, else descending; numbers as numbers."""
    distinct = acts.select(*columns).distinct()
    out = None
    for column, ascending in columns.items():
        values = distinct.select(F.lit(column).alias("column"), F.col(column).alias("own")).where("own is not null").distinct()
        order = Window.partitionBy("column").orderBy(F.asc("own") if ascending else F.desc("own"))  # one row a value
        values = values.select("column", F.col("own").cast("string").alias("value"), F.row_number().over(order).alias("position"))
        out = values if out is None else out.unionByName(values)
    return out


def detail(acts: DataFrame, versions: DataFrame, resources: DataFrame, key: str, version: str) -> DataFrame:
    """One row for each act with numbers of versions and of resources that have a version and that have none."""
    v = versions.groupBy(key).agg(F.count("*").alias("n_versions"))
    r = resources.groupBy(key).agg(F.count_if(F.col(version).isNotNull()).alias("n_resolved"), F.count_if(F.col(version).isNull()).alias("n_unresolved"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    joined = acts.join(v, key, "left").join(r, key, "left")
    return joined.select(*acts.columns, zero("n_versions"), zero("n_resolved"), zero("n_unresolved"))


def contents(provisions: DataFrame, version: object) -> DataFrame:
    """A version's table of contents, without its texts; one that was never parsed has no rows and the caller tells it from an empty one by the version's hash."""
    return provisions.where(F.col("version_id") == version).select("id", "parent_id", "provision_type", "citation_label", "heading", "ordinal").orderBy("ordinal")


def catalogue(acts: DataFrame, versions: DataFrame, provisions: DataFrame, term: str | None = None, *, columns: list[str], order: list[str], equal: dict[str, object] | None = None, wanted: Column | None = None, limit: int = LISTED) -> DataFrame:
    """Listed acts, each with the version that is shown and its number of provisions.

    ``acts``: act and more; ``versions``: as of ``display_version``, with one revision for each
    announcement; ``wanted`` looks at the version, so it filters after the limit.
    """
    from provisio.operators.currentlaw import display_version

    rows = listed(acts, term, columns=columns, order=order, equal=equal, limit=limit)
    shown = display_version(versions.join(rows.select("act"), "act", "left_semi")).select("act", F.col("default_id").alias("version_id"))
    counts = provision_counts(provisions.join(shown.select("version_id").distinct(), "version_id", "left_semi"))
    out = rows.join(shown, "act", "left").join(counts, "version_id", "left").withColumn("n_provisions", F.coalesce("n_provisions", F.lit(0)))
    return out if wanted is None else out.where(wanted)


def assembled_detail(acts: DataFrame, versions: DataFrame, resources: DataFrame, provisions: DataFrame) -> DataFrame:
    """One row for each act with its versions (newest state first, the announcement's title, number of provisions) and its resources, those with a version apart from the others.

    ``acts``: id, title; ``versions``: id, legal_act_id, source_announcement_legal_act_id, state_date;
    ``resources``: legal_act_id, version_id, source_url; ``provisions``: version_id.
    """
    counts = provision_counts(provisions)
    told = acts.select(F.col("id").alias("source_announcement_legal_act_id"), F.col("title").alias("announced_by"))
    v = versions.join(told, "source_announcement_legal_act_id", "left").join(counts.withColumnRenamed("version_id", "id"), "id", "left")
    key = F.struct((-F.unix_date("state_date")).alias("k"), "id", "state_date", "announced_by", F.coalesce("n_provisions", F.lit(0)).alias("n_provisions"))
    v = v.groupBy(F.col("legal_act_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(key)), lambda x: x.dropFields("k")).alias("versions"))
    urls = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("source_url"))))
    r = resources.groupBy(F.col("legal_act_id").alias("id")).agg(urls(F.col("version_id").isNotNull()).alias("resolved"), urls(F.col("version_id").isNull()).alias("unresolved"))
    return acts.join(v, "id", "left").join(r, "id", "left")


def provision(provisions: DataFrame, asked: DataFrame) -> DataFrame:
    """(request, the provision's columns, hierarchy) of single provisions; one of another version than asked for is as good as missing.

    ``asked``: request, version_id, id.
    """
    from provisio.operators import hierarchy

    rows = asked.select("request", "version_id", "id").join(provisions, ["version_id", "id"])
    context = hierarchy.contexts(provisions, rows.select("id").distinct())
    return rows.join(context, rows["id"] == context["leaf"], "left").drop("leaf")


def numbered(nodes: DataFrame) -> DataFrame:
    """(version_id, root, id, parent_id, ordinal, depth, preorder, end): where a node and all below it lie in its root's reading order, from 0.

    ``nodes``: version_id, id, parent_id, ordinal.  A node whose parent is missing is a root;
    siblings go by ordinal, then id.  Trees may have any depth; a cycle, or what hangs on one, is an error.
    A root's tree is numbered in one task.
    """
    from provisio.operators import hierarchy

    found = hierarchy.walks(nodes, nodes, carried=("ordinal", "parent_id"))
    rows = nodes.select("version_id", "id", "parent_id", "ordinal").join(found.withColumnRenamed("leaf", "id"), "id", "left")
    own = F.array(F.struct("id", "ordinal", "parent_id"))
    rows = rows.withColumn("path", F.reverse(F.concat(own, F.coalesce("path", F.array().cast(found.schema["path"].dataType)))))
    # the walk of a node in or below a cycle ends at a node whose parent is there
    known = nodes.select(F.col("id").alias("known"))
    top = F.element_at("path", 1)
    rows = rows.join(known, top["parent_id"] == F.col("known"), "left")
    root = F.when(F.col("known").isNull(), top["id"]).otherwise(F.raise_error(F.concat(F.lit("a cycle of parents above "), F.col("id").cast("string"))).cast(nodes.schema["id"].dataType))
    rows = rows.select("version_id", root.alias("root"), "id", "parent_id", "ordinal", (F.size("path") - 1).alias("depth"), F.transform("path", lambda x: F.struct(x["ordinal"].alias("o"), x["id"].alias("i"))).alias("path"))
    rows = shared.cut(rows, "tree")
    below = rows.select("version_id", F.explode("path.i").alias("id")).groupBy("version_id", "id").agg(F.count("*").alias("n"))
    nth = F.row_number().over(Window.partitionBy("version_id", "root").orderBy("path")) - 1
    return rows.withColumn("preorder", nth).drop("path").join(below, ["version_id", "id"]).withColumn("end", F.col("preorder") + F.col("n").cast("int") - 1).drop("n")


def nested(nodes: DataFrame) -> DataFrame:
    """(version_id, id, n_nodes, depth, tree) of each root: its whole tree as JSON objects of id, ordinal and children.

    As ``numbered``: one sort of a tree's nodes; brackets are closed where the depth falls.
    """
    rows = numbered(nodes)
    before = F.lag("depth").over(Window.partitionBy("version_id", "root").orderBy("preorder"))
    close = F.when(before >= F.col("depth"), F.concat(F.repeat(F.lit("]}"), before - F.col("depth") + 1), F.lit(","))).otherwise("")
    text = F.concat(close, F.regexp_replace(F.to_json(F.struct("id", "ordinal")), r"\}$", ',"children":['))
    rows = rows.withColumn("text", text).groupBy("version_id", F.col("root").alias("id")).agg(
        F.count("*").alias("n_nodes"), F.max("depth").alias("depth"), F.max_by("depth", "preorder").alias("last"), F.array_sort(F.collect_list(F.struct("preorder", "text"))).alias("parts")
    )
    return rows.select("version_id", "id", "n_nodes", "depth", F.concat(F.array_join(F.transform("parts", lambda x: x["text"]), ""), F.repeat(F.lit("]}"), F.col("last") + 1)).alias("tree"))
