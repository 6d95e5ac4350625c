"""Connected components of an edge table, and the packing of components into splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trelliq.session import discard, written


def component_labels(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node of each component of (src, dst), by alternating star operations.

    Each round ties the larger neighbours of a node, then its smaller ones, to the smallest node around it; rounds grow
    with the logarithm of the longest path. Every round is written, so a lost executor costs no more than one.
    """
    e = written(edges.filter("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "edges")
    seen = checksum(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        around = both.groupBy("u").agg(F.min("v").alias("least")).withColumn("m", F.least("u", "least")).select("u", "m")
        large = both.join(around, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(below, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        new = written(small.filter("u <> v").distinct(), "edges")
        # The same edges again: each node hangs on its component's smallest.
        now = checksum(new)
        discard(e)
        e = new
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def checksum(edges: DataFrame) -> tuple:
    """Number of edges and the exact sum of their hashes, from one scan."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def query_components(rows: DataFrame) -> DataFrame:
    """(query_id, component): queries tied by common positives; component is the smallest query_id."""
    own = rows.select("query_id", "pos_id").filter("query_id IS NOT NULL").distinct()
    hubs = own.filter("pos_id IS NOT NULL").groupBy("pos_id").agg(F.min("query_id").alias("hub"))
    labels = component_labels(own.join(hubs, "pos_id").select(F.col("query_id").alias("src"), F.col("hub").alias("dst")))
    return own.select("query_id").distinct().join(labels.withColumnRenamed("node", "query_id"), "query_id", "left").select("query_id", F.coalesce("component", "query_id").alias("component"))


def component_stats(labels: DataFrame) -> DataFrame:
    """(n_components, mean_size, median_size, max_size, n_singletons, largest_share)."""
    sizes = labels.groupBy("component").agg(F.count("*").alias("n"))
    return sizes.agg(
        F.count("*").alias("n_components"), F.round(F.avg("n"), 9).alias("mean_size"), F.median(F.col("n").cast("double")).alias("median_size"), F.max("n").alias("max_size"),
        F.count_if(F.col("n") == 1).alias("n_singletons"), F.round(F.try_divide(F.max("n"), F.sum("n")), 9).alias("largest_share"),
    )


class ComponentError(ValueError):
    """One component covers so much that no split without leaks exists."""


def component_gate(labels: DataFrame, smallest_share: float = 0.1, fatal: float = 0.5) -> DataFrame:
    """(largest_share, unreachable, fatal): whether the largest component exceeds the smallest split, and the bound of no return."""
    share = component_stats(labels).select("largest_share")
    return share.select("largest_share", (F.col("largest_share") > smallest_share).alias("unreachable"), (F.col("largest_share") > fatal).alias("fatal"))


def checked_components(labels: DataFrame, fatal: float = 0.5) -> DataFrame:
    """``labels``, or a ComponentError if the largest component covers more than ``fatal`` of all rows."""
    found = component_gate(labels, fatal=fatal).first()
    if found["fatal"]:
        raise ComponentError(f"the largest component covers {found['largest_share']:.1%} of the queries")
    return labels


def turns(sizes: list[tuple[int, int]], shares: dict[str, float], total: int) -> list[tuple[int, int, int, list[str]]]:
    """(size, from, to, pattern) of a greedy packing of ``sizes`` (size, number of components), from large to small.

    Each component goes to the split furthest below its target, the earlier one on a tie. Where splits take turns, the
    same turns repeat until a split that waits comes near, so a size needs a few patterns, however many components it has.
    """
    order, count = list(shares), dict.fromkeys(shares, 0)
    target = {s: share * total for s, share in shares.items()}

    def best() -> str:
        return max(order, key=lambda s: target[s] - count[s])

    out = []
    for size, number in sizes:
        at = 0
        while at < number:
            pattern, before = [], dict(count)
            while at + len(pattern) < number and (s := best()) not in pattern:
                pattern.append(s)
                count[s] += size
            # The turns hold as long as all of them stay ahead of the splits that wait.
            waiting = max((target[s] - count[s] for s in order if s not in pattern), default=float("-inf"))
            ahead = min(target[s] - before[s] for s in pattern)
            more = number if waiting == float("-inf") else int(max(0, (ahead - waiting) // size - 1))
            cycle = best() == pattern[0] and [s for s in sorted(pattern, key=lambda s: (count[s] - target[s], order.index(s)))] == pattern
            again = min(more, (number - at) // len(pattern) - 1) if cycle else 0
            again = max(0, again)
            for s in pattern:
                count[s] += again * size
            out.append((size, at, at + len(pattern) * (again + 1), pattern))
            at += len(pattern) * (again + 1)
    return out


def greedy_packing(labels: DataFrame, shares: dict[str, float]) -> DataFrame:
    """(component, split): components from large to small, those of one size in the order of their name, each to the split
    furthest below its target at that moment.

    Which split has its turn depends on sizes only, so the driver sees one row for each distinct size and never a
    component; the patterns of turns (see ``turns``) are then laid over the components' places.
    """
    spark = labels.sparkSession
    sizes = written(labels.groupBy("component").agg(F.count("*").alias("n")), "component_sizes")
    by_size = [(r["n"], r["c"]) for r in sizes.groupBy("n").agg(F.count("*").alias("c")).orderBy(F.desc("n")).toLocalIterator()]
    patterns = turns(by_size, shares, sum(n * c for n, c in by_size))
    runs = F.broadcast(spark.createDataFrame(patterns, "n bigint, a bigint, b bigint, pattern array<string>"))
    placed = numbered(sizes).join(runs, "n").filter("place >= a AND place < b")
    return placed.select("component", F.get("pattern", F.pmod(F.col("place") - F.col("a"), F.size("pattern")).cast("int")).alias("split"))


def numbered(sizes: DataFrame) -> DataFrame:
    """(component, n, place) with the place from 0 of a component within its size, by name.

    A sort by range gives each task a stretch of the order; counts of the stretches do the rest, so no task holds a size.
    """
    line = sizes.orderBy(F.desc("n"), "component").withColumn("i", F.monotonically_increasing_id())
    line = written(line.select("component", "n", F.shiftright("i", 33).alias("part"), F.col("i").bitwiseAND((1 << 33) - 1).alias("i")), "line")
    parts = line.groupBy("part", "n").agg(F.count("*").alias("c"), F.min("i").alias("first"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("n").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.withColumn("start", before - F.col("first")).select("part", "n", "start")
    return line.join(starts, ["part", "n"]).select("component", "n", (F.col("start") + F.col("i")).alias("place"))
