"""From buckets of candidates to classes of linked nodes, without listing all pairs.

A bucket holds nodes that may be similar.  First every node is compared with the most
central of its bucket only, the one whose buckets hold the most nodes, and verified links
are joined into components.  The original of many copies is in more and larger buckets
than each copy is, so its copies meet it even where they are too far from each other.

A bucket whose nodes all lie in one component needs nothing more.  Of the others, those of
a few nodes are compared pair by pair across components.  In larger ones a node is told by
its differences from the leader: the features that only one of the two has.  Two nodes
without a common difference are no more similar to each other than each is to the leader,
so a link between components, of which one end is not linked to the leader, needs common
differences, and the more the further its ends are from the leader.  A prefix filter over
the differences, rare ones first, finds all such pairs.  What near copies share is no
difference, so a large group of them costs little although none may be close to the next.

This holds where common features have equal weights.  A node with other weights than its
leader's is loose; pairs with a loose node go through a prefix filter over whole features.
Where two nodes have the parts ``x`` and ``y`` of their weights in common, neither Jaccard
nor probability Jaccard similarity exceeds ``1 / (1 / x + 1 / y - 1)``.  With features in
one order, what a node has before the first common one is not common; so similar nodes
meet at a feature before which both have little.  No link within a bucket is lost.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from loanbook.llm.storage import stored

Verify = Callable[[DataFrame], DataFrame]
Features = Callable[[DataFrame], DataFrame]
FEW_NODES = 16
"""Buckets of at most this many nodes are compared pair by pair."""
_CREWS = 256
"""Parts that the nodes of one leader are dealt to, so that no task has them all."""


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, component) of all nodes of the edges (a, b); the component is its smallest node.

    Each round maps a node to the smallest of itself and its neighbours and the edges
    with it, until no edge is left; following the maps gives the component.  An edge stays
    between a node's image and the image of that, so nothing falls apart.
    """
    level, maps = stored(edges.where("a <> b").select("a", "b").distinct(), f"{name}-edges"), []
    while not level.isEmpty():
        both = level.unionByName(level.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(
            both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("next")),
            f"{name}-map",
        )
        maps.append(least)
        left = least.select(F.col("node").alias("a"), F.col("next").alias("na"))
        right = least.select(F.col("node").alias("b"), F.col("next").alias("nb"))
        moved = level.join(left, "a").join(right, "b").where("na <> nb")
        level = stored(moved.select(F.col("na").alias("a"), F.col("nb").alias("b")).distinct(), f"{name}-edges")
    if not maps:
        return level.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = maps[0].withColumnRenamed("next", "component")
    for further in maps[1:]:
        step = further.select(F.col("node").alias("component"), "next")
        found = found.join(step, "component", "left").select(
            "node", F.coalesce("next", "component").alias("component")
        )
    return stored(found, f"{name}-components")


def differences(placed: DataFrame, weights: DataFrame, name: str, similarity: float = 0.0) -> DataFrame:
    """What sets nodes apart from their leaders, of (leader, node, component) and (node, feature, weight) rows.

    One row per leader, node and feature with its weight that only one of the two holds:
    ``own`` and ``theirs`` are the weights, ``mass`` that of the whole node, ``near`` tells
    whether the node is in its leader's component and ``unlike`` whether it is loose.
    A feature that no other node has makes no row; ``lonely`` is the weight of all these.
    Left out are nodes for which it is too much to be similar to any other, and leaders whose
    other nodes are of one component.

    Nodes are compared as sets of codes, one row per leader and node: a code is a feature of
    weight 1, or the hash of a feature and a greater weight.
    """
    heavy = F.col("weight") > 1
    coded = weights.withColumn("code", F.when(heavy, F.xxhash64("feature", "weight")).otherwise(F.col("feature")))
    rare = (
        coded.groupBy("feature")
        .agg(F.min("node").alias("node"), F.min("weight").alias("weight"), F.min("code").alias("code"), F.count("*").alias("nodes"))
        .where("nodes = 1")
    )
    lonely = rare.groupBy("node").agg(F.sum("weight").alias("lonely"), F.collect_list("code").alias("rare"))
    bags = stored(
        coded.groupBy("node")
        .agg(
            F.sum("weight").alias("mass"),
            F.collect_list("code").alias("codes"),
            F.collect_list(F.when(heavy, F.col("feature"))).alias("often"),
            F.map_from_entries(
                F.collect_list(F.when(heavy, F.struct("code", F.col("weight").cast("long").alias("weight"))))
            ).alias("heavy"),
        )
        .join(lonely, "node", "left")
        .withColumn("lonely", F.coalesce("lonely", F.lit(0)))
        .withColumn("rare", F.coalesce("rare", F.array().cast("array<long>"))),
        f"{name}-bags",
    )
    homes = placed.where("node = leader").select("leader", F.col("component").alias("home")).distinct()
    crew = F.pmod(F.xxhash64("node"), F.lit(_CREWS)).alias("crew")
    able = bags.where(F.col("lonely") <= (1 - similarity) * F.col("mass") + 1e-6).select("node")
    crewed = stored(
        placed.where("node <> leader").select("leader", "node", "component", crew).distinct().join(able, "node"),
        f"{name}-crewed",
    )
    mixed = crewed.groupBy("leader").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y")
    crews = crewed.select("leader", "crew").distinct().join(homes.join(mixed.select("leader"), "leader"), "leader")
    of_leaders = bags.select(
        F.col("node").alias("leader"),
        F.col("codes").alias("their_codes"),
        F.col("often").alias("their_often"),
        F.col("heavy").alias("their_heavy"),
    )
    sides = (
        crewed.join(bags, "node")
        .join(crews.join(of_leaders, "leader"), ["leader", "crew"])
        .withColumn("own", F.array_except(F.array_except("codes", "their_codes"), F.col("rare")))
        .withColumn("theirs", F.array_except("their_codes", "codes"))
    )
    none = F.lit(0).cast("long")

    def weight(of: str, code: Column) -> Column:
        return F.coalesce(F.col(of)[code], F.lit(1).cast("long"))

    return sides.select(
        "leader",
        "node",
        "component",
        (F.col("component") == F.col("home")).alias("near"),
        "mass",
        "lonely",
        (F.arrays_overlap("own", F.map_keys("heavy")) | F.arrays_overlap("own", "their_often")).alias("unlike"),
        F.inline(
            F.concat(
                F.transform("own", lambda c: F.struct(c.alias("feature"), weight("heavy", c).alias("own"), none.alias("theirs"))),
                F.transform("theirs", lambda c: F.struct(c.alias("feature"), none.alias("own"), weight("their_heavy", c).alias("theirs"))),
            )
        ),
    )


def meetings(apart: DataFrame, similarity: float, name: str, loose: DataFrame | None = None) -> DataFrame:
    """(a, b) pairs of different components that meet at a difference and may be similar; a pair may repeat.

    Pairs with a node of ``loose`` are left out.  Its differences only count for those of others.

    With ``x`` and ``y`` the weights of the differences of two nodes, ``c`` of the common
    ones and ``m`` and ``n`` of all the nodes have, the similarity is at least ``s`` where
    ``x + y - 2 c <= (1 - s) / (1 + s) * (m + n)``.  At the first common difference ``c``
    is at most what either node has left.
    """
    weight = F.col("own") + F.col("theirs")
    held = stored(
        apart.groupBy("leader", "feature").agg(
            F.count("*").alias("nodes"),
            (F.min("component") != F.max("component")).alias("crossing"),
            F.min("node").alias("node"),
            F.min("mass").alias("mass"),
            F.min("lonely").alias("lonely"),
            F.sum(weight).alias("weight"),
        ),
        f"{name}-held",
    )
    # Differences that one node alone has come first in its order, lonely features among
    # them; their weight is enough.
    # A node for which they are too much by themselves meets no other one.
    bound = F.col("mass") * (1 / similarity - 1) + 1e-6
    alone = stored(
        held.where("nodes = 1")
        .groupBy("leader", "node")
        .agg((F.sum("weight") + F.min("lonely")).alias("alone"), F.min("mass").alias("mass"))
        .select("leader", "node", "alone", (F.col("alone") > bound).alias("apart")),
        f"{name}-alone",
    )
    of_node = Window.partitionBy("leader", "node")
    before = of_node.orderBy("crossing", "nodes", "feature").rowsBetween(Window.unboundedPreceding, -1)
    prefix = (
        apart.join(held.where("nodes > 1").select("leader", "feature", "nodes", "crossing"), ["leader", "feature"])
        .join(alone.where("apart").select("leader", "node"), ["leader", "node"], "left_anti")
        .join(alone.where("not apart").drop("apart"), ["leader", "node"], "left")
        .withColumn("alone", F.coalesce("alone", "lonely"))
        .withColumn("passed", F.col("alone") + F.coalesce(F.sum(weight).over(before), F.lit(0)))
        .withColumn("differ", F.col("alone") + F.sum(weight).over(of_node))
        .where(F.col("crossing") & (F.col("passed") <= bound))
        .select("leader", "feature", "node", "component", "near", "mass", "differ", "passed")
    )
    prefix = stored(prefix, f"{name}-differences")
    if loose is not None:
        columns = prefix.columns
        prefix = prefix.join(loose, "node", "left_anti").select(*columns)
    # One end at least is not in the leader's component.
    far = prefix.where("not near").drop("near")
    other = prefix.toDF("of", "kind", "b", "apart", "other_near", "other_mass", "other_differ", "other_passed")
    left = F.least(F.col("differ") - F.col("passed"), F.col("other_differ") - F.col("other_passed"))
    most = (1 - similarity) / (1 + similarity)
    meet = (
        (F.col("leader") == F.col("of"))
        & (F.col("feature") == F.col("kind"))
        & (F.col("component") != F.col("apart"))
        & (F.col("other_near") | (F.col("node") < F.col("b")))
        & (F.col("differ") + F.col("other_differ") - 2 * left <= most * (F.col("mass") + F.col("other_mass")) + 1e-6)
    )
    return far.join(other, meet).select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b"))


def loose_meetings(loose: DataFrame, placed: DataFrame, weights: DataFrame, similarity: float, name: str) -> DataFrame:
    """(a, b) pairs of a loose node and one of another component that may be similar; a pair may repeat."""
    often = weights.groupBy("feature").agg(F.count("*").alias("nodes"))
    of_node = Window.partitionBy("node")
    before = of_node.orderBy("nodes", "feature").rowsBetween(Window.unboundedPreceding, -1)
    most = 1 + 1 / similarity + 1e-9
    prefix = (
        weights.join(often, "feature")
        .withColumn("passed", F.coalesce(F.sum("weight").over(before), F.lit(0)) / F.sum("weight").over(of_node))
        .where((F.col("passed") <= 1 - similarity + 1e-9) & (F.col("nodes") > 1))
        .join(placed.select("node", "component").distinct(), "node")
        .select("feature", "node", "component", (1 / (1 - F.col("passed"))).alias("rest"))
    )
    prefix = stored(prefix, f"{name}-prefix")
    one = prefix.join(loose, "node", "left_semi").select("feature", "node", "component", "rest")
    other = prefix.toDF("kind", "b", "apart", "other_rest")
    meet = (
        (F.col("feature") == F.col("kind"))
        & (F.col("component") != F.col("apart"))
        & (F.col("rest") + F.col("other_rest") <= most)
    )
    return one.join(other, meet).select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b"))


def across_components(placed: DataFrame, features: Features, similarity: float, name: str) -> DataFrame:
    """(a, b) pairs of different components with a common leader that may be similar enough.

    ``placed`` holds (leader, node, component), the leaders themselves included.
    """
    weights = stored(features(placed.select("node").distinct()), f"{name}-features")
    apart = stored(differences(placed, weights, name, similarity), f"{name}-apart")
    loose = stored(apart.where("unlike").select("node").distinct(), f"{name}-loose")
    pairs = meetings(apart, similarity, name, loose)
    if not loose.isEmpty():
        pairs = pairs.unionByName(loose_meetings(loose, placed, weights, similarity, name))
    return pairs.distinct()


def link_buckets(members: DataFrame, verify: Verify, features: Features, similarity: float, name: str) -> DataFrame:
    """(node, component) of all nodes that are linked to another.

    ``members`` holds (bucket, node); a row may repeat.  ``verify`` keeps of (a, b) rows
    those that are links: nodes whose Jaccard or probability Jaccard similarity is at least
    ``similarity``.
    ``features`` gives (node, feature, weight) of nodes: what they are made of, and how
    often, a whole number.
    """
    ends = members.groupBy("bucket").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x <> y")
    crowded = stored(members.join(ends.select("bucket"), "bucket", "left_semi").distinct(), f"{name}-crowded")
    sizes = crowded.groupBy("bucket").agg(F.count("*").alias("size"))
    scores = crowded.join(sizes, "bucket").groupBy("node").agg(F.sum("size").alias("score"))
    leaders = crowded.join(scores, "node").groupBy("bucket").agg(F.max(F.struct("score", "node"))["node"].alias("leader"))
    shared = stored(crowded.join(leaders, "bucket"), f"{name}-shared")
    ends_of = (F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b"))
    stars = shared.where("node <> leader").select(*ends_of).distinct()
    links = stored(verify(stars), f"{name}-links")
    known = components(links, name)

    placed = shared.join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = placed.groupBy("bucket").agg(
        F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("size")
    )
    split = stored(placed.join(sizes.where("x <> y").select("bucket", "size"), "bucket"), f"{name}-split")
    # In a small bucket the pairs themselves are few; the others go by their differences.
    few = split.where(F.col("size") <= FEW_NODES).select("bucket", "node", "component")
    other = few.toDF("bucket", "b", "apart")
    pairs = (
        few.join(other, "bucket")
        .where((F.col("node") < F.col("b")) & (F.col("component") != F.col("apart")))
        .select(F.col("node").alias("a"), "b")
    )
    many = split.where(F.col("size") > FEW_NODES).select("leader", "node", "component").distinct()
    pairs = pairs.unionByName(across_components(many, features, similarity, name)).distinct()
    more = stored(verify(pairs), f"{name}-more")
    if more.isEmpty():
        return known
    return components(links.unionByName(more), f"{name}-all")
