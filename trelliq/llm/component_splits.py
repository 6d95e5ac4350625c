"""Problem 2: train, validation and test splits that keep tied records together.

Method: connected components by frontier breadth-first search. A shared value ties its records to the smallest of them,
so a value held by a third of all rows adds one edge a row and no pairs. Adjacency lists are rows of a table bucketed and
sorted by node, which every step of a level reads without a shuffle. Each node looks at its neighbour of highest hash;
of two nodes that look at each other the higher is a seed. All seeds expand at the same time, hop by hop, and only the
nodes labelled last (the frontier) are joined with the adjacency; where two labels collide an edge goes to the graph of
seeds. That graph is merged in one task when it is small, and by the same search again while it is not. Every seed has a
neighbour that is none, so a level leaves at most half of its nodes. Splits follow the order of the components' hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trelliq.session import discard, written

#: A seed graph of at most so many edges is merged in one task.
SMALL_EDGES = 200_000
#: Hops of one level. The way to a seed climbs by hash, so few nodes lie further from one; those follow the neighbour
#: they look at, whose name is then their label.
HOPS = 4


def ties(rows: DataFrame, id_col: str, key_col: str) -> DataFrame:
    """(src, dst): each id tied to the smallest id with the same key; null ids and keys tie nothing."""
    own = rows.select(F.col(id_col).alias("id"), F.col(key_col).alias("key")).filter("id IS NOT NULL AND key IS NOT NULL").distinct()
    hubs = own.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("n")).filter("n > 1")
    return own.join(hubs, "key").filter("id <> hub").select(F.col("id").alias("src"), F.col("hub").alias("dst")).distinct()


def merge_small(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over the edges of a small graph: (node, label), label the smallest node of its component."""
    parent: dict = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for pdf in batches:
        for a, b in zip(pdf["src"], pdf["dst"]):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    yield pd.DataFrame({"node": list(parent), "label": [root(x) for x in parent]}, dtype=object)


def search(edges: DataFrame, level: int, hops: int = HOPS) -> DataFrame:
    """(node, label) after one search from all seeds at once."""
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    both = written(both.withColumnRenamed("src", "node"), "adjacent", "node")

    def rank(node: str):
        return F.struct(F.xxhash64(F.lit(level), F.col(node)).alias("h"), F.col(node).alias("node"))

    # One aggregation over the buckets: each node, and the neighbour it looks at.
    looks = written(both.groupBy("node").agg(F.max(rank("dst")).alias("to")).select("node", F.col("to.node").alias("to")), "looks", "node")
    back = looks.select(F.col("node").alias("to"), F.col("to").alias("back"))
    seeds = looks.join(back, "to").filter((F.col("back") == F.col("node")) & (rank("node") > rank("to"))).select("node", F.col("node").alias("label"))
    labelled = frontier = written(seeds, "frontier")
    parts = [frontier]
    for _ in range(hops):
        reached = both.join(frontier, "node").groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("label"))
        frontier = written(reached.join(labelled, "node", "left_anti"), "frontier")
        if not frontier.head(1):
            discard(frontier)
            break
        parts.append(frontier)
        labelled = labelled.unionByName(frontier)
    nodes = written(looks.join(labelled, "node", "left").select("node", F.coalesce("label", "to").alias("label")), "labels")
    for part in (both, looks, *parts):
        discard(part)
    return nodes


def components(edges: DataFrame, small_edges: int = SMALL_EDGES, level: int = 1, sizes: list[int] | None = None) -> DataFrame:
    """(node, label) of every node of ``edges`` (src, dst): two nodes have one label just when they are connected.

    ``sizes`` is given the number of nodes of each level.
    """
    nodes = search(edges, level)
    if sizes is not None:
        sizes.append(nodes.count())
    a = edges.join(nodes.select(F.col("node").alias("src"), F.col("label").alias("a")), "src").join(nodes.select(F.col("node").alias("dst"), F.col("label").alias("b")), "dst")
    chained = nodes.filter("label <> node").join(nodes.select(F.col("node").alias("label"), F.col("label").alias("next")), "label").filter("next <> label").select(F.col("label").alias("a"), F.col("next").alias("b"))
    tied = a.filter("a <> b").select("a", "b").unionByName(chained)
    seeds = written(tied.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct(), "seeds")
    n = seeds.count()
    if not n:
        return nodes
    merged = seeds.coalesce(1).mapInPandas(merge_small, "node string, label string") if n <= small_edges else components(seeds, small_edges, level + 1, sizes)
    merged = merged.select(F.col("node").alias("label"), F.col("label").alias("merged"))
    return nodes.join(merged, "label", "left").select("node", F.coalesce("merged", "label").alias("label"))


def related_groups(rows: DataFrame, id_col: str, key_col: str, small_edges: int = SMALL_EDGES) -> DataFrame:
    """(group_id, id, n) of every non-null id: group_id is the smallest id of its group, n the size of the group.

    Ids are related when they share a non-null key, directly or through others. Repeated rows count once; extra columns
    are ignored, whatever their names; an empty table gives an empty frame.
    """
    edges = written(ties(rows, id_col, key_col).select(F.col("src").cast("string"), F.col("dst").cast("string")), "ties")
    labelled = written(components(edges, small_edges), "components")
    names = labelled.groupBy("label").agg(F.min("node").alias("group_id"), F.count("*").alias("n"))
    grouped = labelled.join(names, "label").select("group_id", F.col("node").alias("id"), "n")
    alone = rows.select(F.col(id_col).cast("string").alias("id")).filter("id IS NOT NULL").distinct().join(labelled.select(F.col("node").alias("id")), "id", "left_anti")
    return grouped.unionByName(alone.select(F.col("id").alias("group_id"), "id", F.lit(1).cast("bigint").alias("n")))


def split_groups(groups: DataFrame, shares: dict[str, float], seed: int = 42, giant_share: float = 0.01) -> DataFrame:
    """(group_id, id, split): whole groups to splits in about the given shares.

    Groups lie on a line as long as the number of ids, in the order of the md5 of seed and group_id; a group goes to the
    split in whose share its middle falls. Groups above ``giant_share`` of all ids (so at most 1 / giant_share of them)
    stand at the start of the line instead, largest first: in the first split, while it has room. The same groups and
    seed give the same splits, in whatever order rows come. Extra columns are ignored; no groups give an empty frame.
    """
    own = groups.select("group_id", "id")
    sizes = own.groupBy("group_id").agg(F.count("*").alias("n"))
    whole = F.broadcast(sizes.agg(F.sum("n").alias("all")))
    giant = F.col("n") > F.lit(giant_share) * F.col("all")
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), "group_id"))
    # Giants first, then parts of the line by leading digits: no task orders all groups.
    line = sizes.crossJoin(whole).withColumn("h", F.when(giant, "").otherwise(h)).withColumn("part", F.substring("h", 1, 3))
    line = written(line.withColumn("giant", F.when(giant, -F.col("n")).otherwise(0)), "line")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = line.groupBy("part").agg(F.sum("n").alias("of_part")).withColumn("start", F.coalesce(F.sum("of_part").over(before), F.lit(0))).drop("of_part")
    inside = Window.partitionBy("part").orderBy("giant", "h", "group_id").rowsBetween(Window.unboundedPreceding, 0)
    middle = F.col("start") + F.col("inside") - F.col("n") / 2
    *first, last = shares
    edge, split = 0.0, None
    for s in first:
        edge += shares[s]
        split = F.when(middle <= F.lit(edge) * F.col("all"), s) if split is None else split.when(middle <= F.lit(edge) * F.col("all"), s)
    placed = line.withColumn("inside", F.sum("n").over(inside)).join(F.broadcast(starts), "part").select("group_id", (split.otherwise(last) if split is not None else F.lit(last)).alias("split"))
    return own.join(placed, "group_id")
