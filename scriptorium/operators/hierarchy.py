"""Parent-child rows to full hierarchies: states, depths, roots, paths and nested-set ranges.

Everything is done by pointer doubling: after round k a node knows the ancestor 2**k steps up and has gathered what
lies within 2**k steps below it. A forest of depth D takes log2(D) + 1 rounds, each two equi-joins on ids, so neither
the depth nor a parent with a third of all children makes a round per level or a task per family.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.operators.prefix import grouped_prefix_sums
from scriptorium.runtime import cut

#: Blanks at the ends of an id, Unicode ones and the byte order mark included.
_ENDS = "^[\\s\\p{Z}\\uFEFF]+|[\\s\\p{Z}\\uFEFF]+$"


def node_key(c: Column) -> Column:
    """An id as compared: without outer white space, in lower case; null where nothing is left."""
    key = F.lower(F.regexp_replace(c, _ENDS, ""))
    return F.when(F.length(key) > 0, key)


def current_nodes(df: DataFrame, id: str = "id", parent: str = "parent", version: str = "updated_at") -> DataFrame:
    """(concept_id, parent) of the latest version of each id.

    Rows delivered twice count once; a null version is older than any other; at equal versions the greater parent
    wins (null is the least), so the result is defined whatever the row order. Rows without an id are no nodes.
    Only the three named columns are read, whatever else the table holds.
    """
    rows = df.select(node_key(F.col(id)).alias("concept_id"), node_key(F.col(parent)).alias("parent"), F.col(version).alias("v"))
    return (
        rows.filter("concept_id is not null")
        .groupBy("concept_id")
        .agg(F.max(F.struct("v", "parent")).alias("last"))
        .select("concept_id", F.col("last.parent").alias("parent"))
    )


def _lifted(state: DataFrame, sums: list[str], carried: dict[str, str], gathered: list[str]) -> DataFrame:
    """One doubling round: ``sums`` add along the way up, ``carried`` (column -> SQL of own and upper value) follow,
    ``gathered`` add up what points here."""
    upper = state.select(F.col("concept_id").alias("__j"), F.col("jump").alias("__jump"), *[F.col(c).alias(f"__u_{c}") for c in [*sums, *carried]])
    # Nodes whose way up has ended look nothing up; a key of their own spreads them, instead of one null key. Those
    # below one ancestor share its key, a skewed side that the adaptive join splits.
    key = F.coalesce("jump", F.concat(F.lit("\u0000"), F.col("concept_id")))
    nxt = state.withColumn("__key", key).join(upper, F.col("__key") == F.col("__j"), "left")
    new = {"jump": F.col("__jump")}
    for c in sums:
        new[c] = F.col(c) + F.coalesce(F.col(f"__u_{c}"), F.lit(0))
    for c, rule in carried.items():
        new[c] = F.when(F.col("__j").isNull(), F.col(c)).otherwise(F.expr(rule.format(own=c, upper=f"__u_{c}")))
    rest = [c for c in state.columns if c not in new and c not in gathered]
    nxt = nxt.select(*rest, *gathered, *[v.alias(k) for k, v in new.items()])
    if gathered:
        below = (
            state.filter("jump is not null")
            .groupBy(F.col("jump").alias("__t"))
            .agg(*[F.sum(c).alias(f"__g_{c}") for c in gathered])
        )
        nxt = nxt.join(below, nxt["concept_id"] == F.col("__t"), "left").select(
            *rest, *new, *[(F.col(c) + F.coalesce(F.col(f"__g_{c}"), F.lit(0))).alias(c) for c in gathered]
        )
    return nxt.select(*state.columns)


def classified_nodes(nodes: DataFrame) -> DataFrame:
    """(concept_id, parent, state, root, depth, size) of each node.

    state: ``rooted`` (its way up ends at a node without parent), ``orphan`` (at an id that has no row), ``cycle``
    (it lies on a cycle) or ``below_cycle``. root, depth and size (itself and all descendants) are null on and below
    cycles; an orphan's root is the topmost node that has a row. A node that is its own parent is a cycle of one.
    Sizes are gathered upward; what the upward pass never finishes lies on or below a cycle. An empty table gives none.
    """
    ids = nodes.select(F.col("concept_id").alias("__p"))
    state = nodes.join(ids, nodes["parent"] == F.col("__p"), "left").select(
        "concept_id",
        "parent",
        F.col("__p").alias("jump"),
        F.when(F.col("__p").isNull(), F.col("concept_id")).otherwise(F.col("__p")).alias("root"),
        F.when(F.col("__p").isNull(), 0).otherwise(1).cast("long").alias("depth"),
        F.lit(1).cast("long").alias("size"),
        F.when(F.col("__p").isNull(), F.col("parent").isNotNull()).alias("dangling"),
    )
    state, seen = cut(state), None
    while True:
        now = state.agg(F.count("jump"), F.count_distinct("jump")).first()
        if now[0] == 0 or now == seen:
            break
        state, seen = cut(_lifted(state, ["depth"], {"root": "{upper}", "dangling": "{upper}"}, ["size"])), now
    on_cycle = state.filter("jump is not null").select(F.col("jump").alias("__c")).distinct()
    endless = F.col("jump").isNotNull()
    return state.join(on_cycle, state["concept_id"] == F.col("__c"), "left").select(
        "concept_id",
        "parent",
        F.when(F.col("__c").isNotNull(), "cycle").when(endless, "below_cycle").when(F.col("dangling"), "orphan").otherwise("rooted").alias("state"),
        *[F.when(~endless, F.col(c)).alias(c) for c in ("root", "depth", "size")],
    )


def lost_nodes(df: DataFrame) -> DataFrame:
    """(concept_id, state) of the current nodes that never reach a root."""
    return classified_nodes(current_nodes(df)).filter("state <> 'rooted'").select("concept_id", "state")


def nested_sets(df: DataFrame) -> DataFrame:
    """(concept_id, root, depth, path, descendants, lft, rgt) of the nodes that reach a root or a missing parent.

    Each node's subtree size is known from the upward pass; siblings, in order of id, take ranges by prefix sums over
    their sizes, and a node's ``lft`` is the sum of such offsets along its way up. The descendants of a node are the
    nodes whose ``lft`` lies in (lft, rgt]; its ancestors are those whose range holds its lft. Paths are written
    ``root/.../id``. Nodes on or below cycles have no range and do not appear.
    """
    nodes = classified_nodes(current_nodes(df)).filter("size is not null")
    top = F.col("depth") == 0
    families = nodes.select("concept_id", "root", "depth", "size", F.when(~top, F.col("parent")).alias("jump"))
    ranged = grouped_prefix_sums(families, ["jump"], ["concept_id"], "size", "before")
    state = cut(
        ranged.select(
            "concept_id", "root", "depth", "size", "jump",
            (F.col("before") + F.when(F.col("jump").isNull(), 0).otherwise(1)).alias("lft"),
            F.array("concept_id").alias("path"),
        )
    )
    while state.filter("jump is not null").limit(1).count():
        state = cut(_lifted(state, ["lft"], {"path": "concat({upper}, {own})"}, []))
    return state.select(
        "concept_id", "root", "depth", F.concat_ws("/", "path").alias("path"), (F.col("size") - 1).alias("descendants"),
        "lft", (F.col("lft") + F.col("size") - 1).alias("rgt"),
    )


def descendants_of(ranges: DataFrame, wanted: DataFrame, width: int = 1024) -> DataFrame:
    """(ancestor_id, concept_id) for each id of ``wanted`` (column concept_id): a range join over nested-set ranges.

    Ranges are cut into cells of ``width`` preorder numbers; a node stands in one cell, an ancestor in each cell it
    covers, so the join is an equi-join on the cell with an exact check behind it. Unknown ids give no row.
    """
    held = ranges.join(wanted.select(F.col("concept_id").alias("__w")).distinct(), F.col("concept_id") == F.col("__w"), "left_semi")
    above = held.filter("descendants > 0").select(
        F.col("concept_id").alias("ancestor_id"), F.col("lft").alias("a"), F.col("rgt").alias("b"),
        F.explode(F.sequence(F.floor((F.col("lft") + 1) / width), F.floor(F.col("rgt") / width))).alias("cell"),
    )
    below = ranges.select("concept_id", F.col("lft").alias("at"), F.floor(F.col("lft") / width).alias("cell"))
    return above.join(below, "cell").filter("at > a and at <= b").select("ancestor_id", "concept_id")
