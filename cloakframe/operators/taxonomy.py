"""Taxonomy operators.

A taxonomy is an edge table ``(child, parent)`` whose root ``*`` is its own
parent. It is walked once, into one row per node holding the array of its
ancestors; every later question is an array look-up after an equi join on the
node, so no operator fans a row out over the levels of the tree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import discard, materialize
from .centers import nearest_center

ROOT = "*"


def taxonomy_from_columns(df: DataFrame, columns: Sequence[str], top: str = "ALL") -> DataFrame:
    """Edges from columns that hold a leaf, its parent, ... of every row."""
    chain = [F.col(c).cast("string") for c in columns] + [F.lit(top), F.lit(ROOT), F.lit(ROOT)]
    # One pass over the rows: distinct chains first, then one edge per step.
    steps = F.array(
        *[F.struct(a.alias("child"), b.alias("parent")) for a, b in zip(chain, chain[1:])]
    )
    listed = df.select(*columns).distinct().select(F.inline(steps)).distinct()
    return materialize(listed, "edges")


def ancestor_paths(edges: DataFrame, height: int | None = None) -> DataFrame:
    """``(node, path)``: the node, its parent, ... up to the root.

    ``height`` is the number of steps from a leaf to the node below the root.
    Without it paths are doubled until every one has ended: each is continued by the
    path of its last node, so a tree of any height takes the logarithm of it in
    rounds, each written; a node that is its own ancestor is an error. A path whose
    next parent is missing ends in null. The result is written, so that later
    joins know its true size.
    """
    if height is None:
        return _doubled_paths(edges)
    parents = edges.select(F.col("child").alias("__child"), F.col("parent").alias("__parent"))
    paths = edges.select(F.col("child").alias("node"), F.array("child").alias("path"))
    ended = F.col("__tail").isNull() | (F.col("__tail") == ROOT)
    for _ in range(height + 1):
        paths = paths.withColumn("__tail", F.element_at("path", -1))
        paths = paths.join(parents, (F.col("__tail") == F.col("__child")) & ~ended, "left").select(
            "node",
            F.when(ended, F.col("path"))
            .otherwise(F.concat("path", F.array("__parent")))
            .alias("path"),
        )
    return materialize(paths, "taxonomy")


def _doubled_paths(edges: DataFrame) -> DataFrame:
    tail = F.element_at("path", -1)
    ended = tail.isNull() | (tail == ROOT)
    first = F.when(F.col("child") == ROOT, F.array("child")).otherwise(F.array("child", "parent"))
    paths = materialize(edges.select(F.col("child").alias("node"), first.alias("path")), "taxonomy")
    nodes = paths.count()
    while met := paths.where(~ended).agg(F.max(F.struct(F.size("path").alias("n"), tail.alias("tail"))).alias("at")).first()["at"]:
        if met["n"] > nodes + 1:  # longer than any path without a repeated node
            raise ValueError(f"the taxonomy has a cycle at {met['tail']!r}")
        further = paths.select(F.col("node").alias("__node"), F.col("path").alias("__path"))
        rest = F.coalesce(F.slice("__path", 2, F.size("__path")), F.array(F.lit(None).cast("string")))
        longer = F.when(ended, F.col("path")).otherwise(F.concat("path", rest))
        joined = paths.join(further, (tail == F.col("__node")) & ~ended, "left").select("node", longer.alias("path"))
        before, paths = paths, materialize(joined, "taxonomy")
        discard(before)
    return paths


def taxonomy_closure(paths: DataFrame) -> DataFrame:
    """All ``(node, ancestor, height)``; height 0 is the node itself."""
    return paths.select("node", F.posexplode("path").alias("height", "ancestor")).select(
        "node", "ancestor", F.col("height").cast("bigint").alias("height")
    )


def validate_taxonomy(
    edges: DataFrame, height: int, values: DataFrame | None = None
) -> DataFrame:
    """Check a taxonomy and return its ancestor paths.

    One root, one parent per child, every leaf ``height`` steps below the node
    under the root, and (with ``values``, a one-column frame) every sensitive
    value a leaf. The structure is checked by one aggregate over the paths: a
    node nearer to the root than the leaves must be the parent of another.
    """
    paths = ancestor_paths(edges, height)
    steps = F.size("path")
    parent = F.when(F.col("node") != ROOT, F.get("path", F.lit(1)))
    row = paths.agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct("node").alias("nodes"),
        F.count_if(F.col("node") == ROOT).alias("roots"),
        F.count_if(F.element_at("path", -1).isNull()).alias("orphans"),
        F.count_if((F.element_at("path", -1) != ROOT) | (steps > height + 2)).alias("deep"),
        F.count_if(steps < height + 2).alias("inner"),
        F.countDistinct(parent).alias("parents"),
    ).first()
    if row["rows"] != row["nodes"]:
        raise ValueError("a node of the taxonomy has two parents")
    if row["roots"] != 1:
        raise ValueError("the taxonomy needs exactly one root edge (*, *)")
    if row["orphans"]:
        raise ValueError("a parent of the taxonomy is missing")
    if row["deep"] or row["inner"] != row["parents"]:
        raise ValueError(f"not every leaf is {height} steps below the top node")
    if values is not None:
        name = values.columns[0]
        leaves = paths.where(steps == height + 2).select(F.col("node").alias(name))
        lost = values.distinct().join(leaves, name, "left_anti").limit(1).collect()
        if lost:
            raise ValueError(f"value {lost[0][0]!r} is not a leaf of the taxonomy")
    return paths


def _climb(path: Column, steps: Column) -> Column:
    """The ``steps``-th ancestor; the root stays the root."""
    return F.element_at(path, F.least(steps + F.lit(1), F.size(path)).cast("int"))


def ancestor_at(
    df: DataFrame, column: str, paths: DataFrame, level: int, name: str = "ancestor"
) -> DataFrame:
    """Add the ``level``-th ancestor of ``column``; levels below 1 give the parent."""
    look = paths.select(
        F.col("node").alias(column), _climb(F.col("path"), F.lit(max(level, 1))).alias(name)
    )
    return df.join(look, column)


def descendants_at(paths: DataFrame, parent: str, level: int) -> DataFrame:
    """Nodes exactly ``level`` steps below ``parent``."""
    return paths.where(
        (F.size("path") > level) & (F.get("path", F.lit(level)) == parent)
        & (F.col("node") != ROOT)
    ).select("node")


def generalize_to_level(
    df: DataFrame, column: str, paths: DataFrame, level: int, height: int, name: str
) -> DataFrame:
    """Roll ``column`` up to ``level``: 0 is the top, ``height`` the value itself."""
    steps = max(height - level, 0)
    look = paths.select(
        F.col("node").alias(column), _climb(F.col("path"), F.lit(steps)).alias(name)
    )
    return df.join(look, column)


def _steps_to_common(left: Column, right: Column) -> Column:
    """Steps until two paths meet: the deeper side climbs alone until both are equally
    far from the root, then both climb in lock-step."""
    both = F.least(F.size(left), F.size(right))
    ahead = F.greatest(F.size(left), F.size(right)) - both
    aligned = [F.slice(p, F.size(p) - both + 1, both) for p in (left, right)]
    same = F.zip_with(*aligned, lambda a, b: F.coalesce(a == b, F.lit(False)))
    return (ahead + F.array_position(same, True) - F.lit(1)).cast("double")


def _with_path(df: DataFrame, column: str, paths: DataFrame, name: str) -> DataFrame:
    look = paths.select(F.col("node").alias(column), F.col("path").alias(name))
    return df.join(look, column)


def taxonomy_distance(
    pairs: DataFrame,
    columns: Sequence[tuple[str, str, int]],
    paths: DataFrame,
    name: str = "distance",
) -> DataFrame:
    """Add the taxonomy distance of every row.

    ``columns`` lists ``(left, right, height)``: two columns to compare and the
    height of their tree. Each adds (steps to the common ancestor) / height. Where
    values lie at different depths, the steps are those of the deeper one.
    """
    total = F.lit(0.0)
    names = list(dict.fromkeys(c for left, right, _ in columns for c in (left, right)))
    # The distance depends on the values alone: once per distinct combination.
    combos = pairs.select(*names).distinct()
    out = combos
    for i, (left, right, height) in enumerate(columns):
        out = _with_path(out, left, paths, f"__l{i}")
        out = _with_path(out, right, paths, f"__r{i}")
        total = total + _steps_to_common(F.col(f"__l{i}"), F.col(f"__r{i}")) / F.lit(float(height))
    return pairs.join(out.select(*names, total.alias(name)), names).select(*pairs.columns, name)


def with_ancestors(
    df: DataFrame, columns: Sequence[tuple[str, int]], paths: DataFrame
) -> tuple[DataFrame, dict[str, float]]:
    """Add one column per tree level of every value, and give their weights.

    At uniform depth, (steps to the common ancestor) / height is the share of
    the levels on which two values have different ancestors.
    """
    weights: dict[str, float] = {}
    out = df
    for i, (c, height) in enumerate(columns):
        out = _with_path(out, c, paths, "__path")
        for level in range(height):
            out = out.withColumn(f"__l{i}_{level}", F.get("__path", F.lit(level)))
            weights[f"__l{i}_{level}"] = 1.0 / height
        out = out.drop("__path")
    return out, weights


def taxonomy_distance_nearest(
    df: DataFrame,
    columns: Sequence[tuple[str, int]],
    centers: DataFrame,
    paths: DataFrame,
    name: str = "distance",
) -> DataFrame:
    """Smallest taxonomy distance of a row to a set of centres.

    The distance depends only on the categorical values, so it is computed
    once per distinct combination and joined back. A row is null in ``name``
    if there is no centre.
    """
    names = [c for c, _ in columns]
    combos, weights = with_ancestors(df.select(*names).distinct(), columns, paths)
    wanted, _ = with_ancestors(centers.select(*names).distinct(), columns, paths)
    wanted = wanted.withColumn("center", F.xxhash64(*names))
    measured = nearest_center(combos, [], wanted, distance=name, mismatch=weights)
    return df.join(measured.select(*names, name), names)
