"""Ordered gathering and flattening of children, ranks, chains and trees."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: So many levels of a tree become one table.
STRETCH = 32


def gather(df: DataFrame, keys: list[str], order: str, columns: list[str], out: str) -> DataFrame:
    """Children of each key as an array in their order. A parent's children are few by nature of the artefacts."""
    child = F.struct(F.col(order), *(F.col(c) for c in columns if c != order))
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(child)).alias(out))


def gather_where(df: DataFrame, keys: list[str], test: Column, columns: list[str], out: str) -> DataFrame:
    """Values of the rows of each key that pass, as an array in the order of the columns (of one column: of the values
    themselves). Other rows go before those of a key meet; a key none of whose rows passes has an empty array."""
    child = F.struct(*columns) if len(columns) > 1 else F.col(columns[0])
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(test, child))).alias(out))


def before_stop(df: DataFrame, keys: list[str], order: list[Column], stop: Column, out: str = "before") -> DataFrame:
    """Whether a row comes, in order, before the first of its key that passes stop; all do if none passes."""
    from .scan import running

    return running(df, keys, order, sums={"_stops": F.coalesce(stop, F.lit(False)).cast("int")}).withColumn(out, F.col("_stops") == 0).drop("_stops")


def flatten(df: DataFrame, array: str, position: str = "pos", item: str = "item") -> DataFrame:
    """One row per element with its position; rows without elements stay, with nulls."""
    return df.select(*(c for c in df.columns if c != array), F.posexplode_outer(array).alias(position, item))


def last_match(items: Column, test) -> Column:
    """The last element that passes; null without any."""
    return F.try_element_at(F.filter(items, test), F.lit(-1))


def take_until(items: Column, stop) -> Column:
    """Elements before the first stop value; all if there is none."""
    at = F.coalesce(F.array_position(items, stop), F.lit(0))
    return F.when(at == 0, items).otherwise(F.slice(items, F.lit(1), F.greatest(at - 1, F.lit(0)).cast("int")))


def mru_rank(df: DataFrame, keys: list[str], order: list[Column], out: str = "rank") -> DataFrame:
    """0 for the most recent of each key."""
    from .scan import running

    return running(df, keys, order, sums={"_at": F.lit(1)}).withColumn(out, (F.col("_at") - 1).cast("int")).drop("_at")


def seen_before(df: DataFrame, keys: list[str], order: str, test: Column, out: str) -> DataFrame:
    """Whether an earlier row of the same key passes the test."""
    from .scan import running

    passes = F.coalesce(test, F.lit(False)).cast("int")
    d = running(df.withColumn("_own", passes), keys, [F.col(order)], sums={"_seen": F.col("_own")})
    return d.withColumn(out, F.col("_seen") > F.col("_own")).drop("_own", "_seen")


def tagged_union(parts: dict[str, DataFrame], tag: str = "source") -> DataFrame:
    """All rows of all parts, with a column that names the part; missing columns are null."""
    out = None
    for name, df in parts.items():
        one = df.withColumn(tag, F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def _union_of_levels(levels: list[DataFrame], level: DataFrame, depth: int) -> list[DataFrame]:
    """levels and one more; each full stretch of the last ones is written as one table, so that plans stay small."""
    from .store import cut

    levels.append(level)
    return [*levels[:-STRETCH], cut(reduce(DataFrame.unionByName, levels[-STRETCH:]))] if depth % STRETCH == STRETCH - 1 else levels


def _from_roots(n: DataFrame, keys: list[str], separator: str, inherit: tuple[str, ...]) -> DataFrame:
    """Paths by a walk down from the roots, level by level: for trees in which an id is on several rows, whose walks may meet
    an id again and then end."""
    from .store import cut

    known = n.select(*keys, F.col("_id").alias("_parent")).distinct()
    own = n.filter(F.col("_id").eqNullSafe(F.col("_parent")))
    inner = n.filter(~F.col("_id").eqNullSafe(F.col("_parent")))
    orphans = inner.join(known, [*keys, "_parent"], "left_anti")
    level = own.unionByName(orphans).select(
        *keys, "_id", F.col("_name").alias("path"), F.lit(0).alias("depth"), F.col("_id").alias("root"),
        *inherit, *(F.lit(False).alias(f"{c}_above") for c in inherit), F.array("_id").alias("_seen"), F.lit(False).alias("_again"))
    levels, depth = [], 0
    while True:
        level = cut(level)
        if not level.take(1):
            break
        levels = _union_of_levels(levels, level.drop("_seen", "_again", *inherit), depth)
        depth += 1
        up = level.filter("NOT _again").select(*keys, F.col("_id").alias("_parent"), F.col("path").alias("_above"), "root", "_seen", *((F.col(c) | F.col(f"{c}_above")).alias(f"{c}_above") for c in inherit))
        again = F.coalesce(F.array_contains("_seen", F.col("_id")), F.lit(False))
        level = inner.join(up, [*keys, "_parent"]).select(
            *keys, "_id", F.concat_ws(separator, "_above", "_name").alias("path"), F.lit(depth).alias("depth"), "root",
            *inherit, *(f"{c}_above" for c in inherit), F.array_append("_seen", F.col("_id")).alias("_seen"), again.alias("_again"))
    out = reduce(DataFrame.unionByName, levels) if levels else level.drop("_seen", "_again", *inherit)
    reached = out.select(*keys, F.col("_id").alias("_parent")).distinct()
    rest = inner.join(known, [*keys, "_parent"], "left_semi").join(reached, [*keys, "_parent"], "left_anti")
    return out.unionByName(_unreached(rest, keys, inherit))


def _unreached(n: DataFrame, keys: list[str], inherit: tuple[str, ...]) -> DataFrame:
    return n.select(
        *keys, "_id", F.col("_name").alias("path"), F.lit(None).cast("int").alias("depth"), F.when(F.lit(False), F.col("_id")).alias("root"),
        *(F.lit(None).cast("boolean").alias(f"{c}_above") for c in inherit))


def _by_doubling(n: DataFrame, keys: list[str], separator: str, inherit: tuple[str, ...]) -> DataFrame:
    """Paths where ids are unique. Every node points up to an ancestor and knows the path from below it. A round joins
    each with the node it points to and takes over that one's pointer, so that the way covered doubles: a tree of depth d
    takes log2(d) + 1 rounds. In any round but the last some node reaches its root unless all that are left hang on cycles,
    since one twice as deep has an ancestor half as deep."""
    from .skew import join_to_one
    from .store import cut

    size, on = n.count(), [*keys, "_up"]
    ids = n.select(*keys, F.col("_id").alias("_parent"), F.lit(True).alias("_there"))
    start = join_to_one(n, ids, [*keys, "_parent"], size, "left")
    top = F.col("_there").isNull() | F.col("_id").eqNullSafe(F.col("_parent"))
    ways = cut(start.select(
        *keys, "_id", "_name", F.when(~top, F.col("_parent")).alias("_up"), F.col("_name").alias("path"), F.lit(0).alias("depth"), F.when(top, F.col("_id")).alias("root"),
        top.alias("_done"), *inherit, *(F.lit(False).alias(f"{c}_above") for c in inherit)))
    done, left = [ways.filter("_done")], ways.filter("NOT _done").count()
    while left:
        open_ = ways.filter("NOT _done").drop("root")
        ahead = ways.select(
            *keys, F.col("_id").alias("_up"), F.col("_up").alias("_next"), F.col("path").alias("_before"), F.col("depth").alias("_more"), "root", F.col("_done").alias("_ends"),
            *((F.col(c) | F.col(f"{c}_above")).alias(f"_{c}_far") for c in inherit))
        joined = join_to_one(open_, ahead, on, left)
        joined = joined.select(
            *keys, "_id", "_name", F.col("_next").alias("_up"), F.concat_ws(separator, "_before", "path").alias("path"), (F.col("depth") + F.col("_more") + 1).alias("depth"), "root",
            F.col("_ends").alias("_done"), *inherit, *((F.col(f"{c}_above") | F.col(f"_{c}_far")).alias(f"{c}_above") for c in inherit))
        joined = cut(joined)
        done.append(joined.filter("_done"))
        still = joined.filter("NOT _done").count()
        if still == left:
            break
        # Nodes at their root stay where others may still point to them.
        ways, left = reduce(DataFrame.unionByName, done).unionByName(joined.filter("NOT _done")), still
    out = reduce(DataFrame.unionByName, done).select(*keys, "_id", "path", "depth", "root", *(f"{c}_above" for c in inherit))
    return out.unionByName(_unreached(joined.filter("NOT _done"), keys, inherit)) if left else out


def tree_paths(nodes: DataFrame, keys: list[str], id: str, parent: str, name: str, separator: str = "\\", inherit: tuple[str, ...] = ()) -> DataFrame:
    """``path``, ``depth`` and ``root`` of every node. Roots are nodes whose parent isn't there, or is themselves. Trees whose
    ids are unique are folded in as many rounds as their depth has binary digits; those of keys with an id on several
    rows, as reused ids make it, are walked level by level. A walk that comes to an id again goes no further below it.
    Nodes that no root reaches, those of cycles and what hangs on them, are rows with their own name as path, without depth and root.

    inherit: boolean columns (null counts as false); ``<column>_above`` says whether any node above has it, null where there is no root.
    What rounds leave is written out, so plans don't grow and a lost executor costs one round."""
    n = nodes.select(*keys, F.col(id).alias("_id"), F.col(parent).alias("_parent"), F.col(name).cast("string").alias("_name"), *(F.coalesce(c, F.lit(False)).alias(c) for c in inherit))
    twice = n.groupBy(*keys, "_id").agg(F.count("*").alias("_rows")).filter("_rows > 1").select(*keys).distinct()
    if not twice.take(1):
        out = _by_doubling(n, keys, separator, inherit)
    elif not keys:
        out = _from_roots(n, keys, separator, inherit)
    else:
        apart = _from_roots(n.join(twice, keys, "left_semi"), keys, separator, inherit)
        out = apart.unionByName(_by_doubling(n.join(twice, keys, "left_anti"), keys, separator, inherit))
    return out.withColumnRenamed("_id", id)


def folder_paths(items: DataFrame, folders: DataFrame, keys: list[str], folder: str, name: str, id: str = "id", parent: str = "parent", label: str = "label", out: str = "path", separator: str = "\\") -> DataFrame:
    """items with their full path: that of their folder, from its root down, and their own name. folders: keys, id, parent
    and label, walked by tree_paths. An item whose folder isn't there has a null path, as has one without a name."""
    paths = tree_paths(folders, keys, id, parent, label, separator)
    dim = paths.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col(id).alias("_folder"), F.col("path").alias("_path"))
    on = items[folder] == dim["_folder"]
    for k in keys:
        on &= items[k] == dim[f"_{k}"]
    joined = items.join(dim, on, "left").withColumn(out, F.concat("_path", F.lit(separator), F.col(name)))
    return joined.drop("_folder", "_path", *(f"_{k}" for k in keys))


def variant_tree(df: DataFrame, text: str, keys: list[str], children: str, fields: dict[str, str], id: str = "ID", position: str | None = None, inherit: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """Nodes of a recursive JSON text: ``node_path`` (ids from the root), ``depth``, ``parent`` and the fields, given as
    name to type. Level by level: no limit on the rows of a whole fleet, as recursive SQL has one. Texts that aren't JSON
    give one node of nulls. position: a column for a node's place among its siblings, null for roots. inherit: names and tests
    of a node's variant; each is a column that says whether any node above passes."""
    from .store import cut

    def own(v: Column) -> Column:
        return F.try_variant_get(v, f"$.{id}", "string")

    inherit, places = inherit or {}, [position] if position else []
    level = df.select(*keys, F.try_parse_json(text).alias("_v")).select(
        *keys, "_v", own(F.col("_v")).alias("node_path"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent"),
        *(F.lit(None).cast("int").alias(p) for p in places), *(F.lit(False).alias(c) for c in inherit))
    levels, depth = [], 0
    while True:
        level = cut(level)
        if levels and not level.take(1):
            break
        levels = _union_of_levels(levels, level, depth)
        depth += 1
        kids = F.posexplode(F.try_variant_get("_v", f"$.{children}", "array<variant>")).alias("_pos", "_w")
        down = level.select(*keys, "node_path", *((F.col(c) | F.coalesce(test(F.col("_v")), F.lit(False))).alias(c) for c, test in inherit.items()), kids)
        level = down.select(
            *keys, F.col("_w").alias("_v"), F.concat_ws("/", "node_path", own(F.col("_w"))).alias("node_path"), F.lit(depth).alias("depth"), F.col("node_path").alias("parent"),
            *(F.col("_pos").alias(p) for p in places), *inherit)
    out = reduce(DataFrame.unionByName, levels)
    return out.select(*keys, "node_path", "depth", "parent", *places, *inherit, *(F.try_variant_get("_v", f"$.{f}", t).alias(f) for f, t in fields.items()))


def token_positions(text: Column, token: str) -> Column:
    """Start (0-based, characters) of every non-overlapping occurrence of a literal token."""
    parts = F.split(text, r"\Q" + token + r"\E", -1)
    size = len(token)
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found"))

    def add(acc, p):
        at = acc["at"] + F.length(p)
        return F.struct((at + size).alias("at"), F.concat(acc["found"], F.array(at)).alias("found"))

    # What follows the last occurrence isn't a start.
    return F.aggregate(F.slice(parts, F.lit(1), F.size(parts) - 1), state, add, lambda acc: acc["found"])
