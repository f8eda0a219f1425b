"""Cycles in a table of edges.

The edges may belong to many separate graphs, told apart by group columns. Graphs
with few edges are solved where they are, in one exchange. Larger ones, and a group
that holds much of the table, are made smaller in rounds: what nothing enters or leaves goes, and of the nodes
with few ways through them a third or more are taken out at once, no two of them neighbours, while each way through one
becomes an edge. That keeps what reaches what, halves paths and cycles of any length every other round, and never adds more than a few edges for
a node. What is small enough then is solved at once; what has only nodes with many ways through them is solved by passing labels,
in as many rounds as its longest way has steps. Then the rounds are gone through backwards: a node taken out
is on a cycle if it led from a group of nodes that reach each other back to the same group. Each round writes its
state to the shared folder, which keeps plans short and survives lost executors.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesmith.session import stage

SMALL_GRAPH = 1000
#: Nodes with so many ways through them, or no more ways than edges, are taken out.
FEW_WAYS = 16
#: More than one in so many of the nodes that can go is to go, else a second look is taken.
WON = 3


def cyclic_edges(
    edges: DataFrame, by: Sequence[str], source: str, target: str, small_graph: int = SMALL_GRAPH
) -> DataFrame:
    """Edges between nodes that reach each other, with the smallest such node as ``root``.

    Columns: ``by``, ``root``, ``s``, ``t``. A node is on a cycle exactly if it is in ``s``.
    """
    by = list(by)
    small, large = _by_size(edges, by, source, target, small_graph)
    solved = _solve_small(small, by).select(*by, "root", F.explode("edges").alias("_e")).select(*by, "root", "_e.*")
    return solved if large is None else solved.unionByName(_solve_large(large, by))


def cyclic_nodes(
    edges: DataFrame, by: Sequence[str], source: str, target: str, small_graph: int = SMALL_GRAPH
) -> DataFrame:
    """The nodes that reach themselves."""
    found = cyclic_edges(edges, by, source, target, small_graph)
    return found.select(*by, F.col("s").alias("node")).distinct()


def cycle_paths(
    edges: DataFrame, by: Sequence[str], source: str, target: str, small_graph: int = SMALL_GRAPH
) -> DataFrame:
    """One row per group of nodes on common cycles: its smallest node and a shortest cycle through it.

    The path starts and ends with that node; among shortest ones the first in order is taken.
    """
    by = list(by)
    small, large = _by_size(edges, by, source, target, small_graph)
    solved = _solve_small(small, by).select(*by, "root", "path")
    return solved if large is None else solved.unionByName(_walk(_solve_large(large, by), by))


def _by_size(
    edges: DataFrame, by: list[str], source: str, target: str, small_graph: int
) -> tuple[DataFrame, DataFrame | None]:
    """Distinct edges of small graphs, and those of the others if there are any."""
    plain = edges.select(*by, F.col(source).alias("s"), F.col(target).alias("t"))
    plain = stage(plain.dropna(subset=["s", "t"]).distinct(), "edges")
    if not by:
        return (plain, None) if plain.count() <= small_graph else (plain.limit(0), plain)
    big = stage(plain.groupBy(*by).count().where(F.col("count") > small_graph).select(*by), "big")
    if big.isEmpty():
        return plain, None
    return plain.join(big, by, "left_anti"), plain.join(big, by, "left_semi")


def _solve_small(edges: DataFrame, by: list[str]) -> DataFrame:
    """Components of graphs with a bounded number of edges: ``by, root, path, edges``."""
    kind = edges.schema["s"].dataType.simpleString()

    def batches(graphs: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in graphs:
            yield series.map(lambda graph: list(_components([(e["s"], e["t"]) for e in graph])))

    result = f"array<struct<root:{kind},path:array<{kind}>,edges:array<struct<s:{kind},t:{kind}>>>>"
    graphs = edges.groupBy(*by).agg(F.collect_list(F.struct("s", "t")).alias("_g"))
    # Marked as not repeatable, so that no filter derived from the result runs it again.
    solve = F.pandas_udf(batches, result).asNondeterministic()
    found = graphs.select(*by, solve("_g").alias("_found"))
    return found.select(*by, F.explode("_found").alias("_c")).select(*by, "_c.*")


def _components(edges: list[tuple]) -> Iterator[dict]:
    """Groups of nodes that reach each other: smallest node, shortest cycle through it, edges."""
    ahead, behind = defaultdict(set), defaultdict(set)
    for s, t in edges:
        ahead[s].add(t)
        behind[t].add(s)
    done = set()
    for root in sorted(ahead.keys() & behind.keys()):
        if root not in done:
            members = _paths(root, ahead).keys() & _paths(root, behind).keys()
            done |= members
            inner = [{"s": s, "t": t} for s, t in edges if s in members and t in members]
            if inner:
                yield {"root": root, "path": _paths(root, ahead)[root], "edges": inner}


def _paths(root, steps: dict) -> dict:
    """For each node reached in one step or more, the first of the shortest paths to it."""
    found, front = {}, {root: [root]}
    while front:
        reached: dict = {}
        for node, path in sorted(front.items(), key=lambda item: item[1]):
            for step in steps.get(node, ()):
                if step not in found:
                    reached.setdefault(step, [*path, step])
        found |= reached
        front = reached
    return found


def _solve_large(edges: DataFrame, by: list[str], finish: int = SMALL_GRAPH) -> DataFrame:
    """Components of graphs of any size."""
    labels = components(edges, by, finish)
    roots = labels.groupBy(*by, "label").agg(F.min("node").alias("root"))
    known = stage(labels.join(roots, [*by, "label"]).select(*by, "node", "root"), "roots")
    starts = known.withColumnRenamed("node", "s")
    ends = known.withColumnsRenamed({"node": "t", "root": "root_t"})
    inner = edges.join(starts, [*by, "s"]).join(ends, [*by, "t"]).where("root = root_t")
    return inner.select(*by, "root", "s", "t")


#: The rounds of the last call, to look at.
rounds: list[int] = []


def components(edges: DataFrame, by: list[str], finish: int = SMALL_GRAPH) -> DataFrame:
    """(by, node, label) of all nodes that reach themselves; nodes with the same label reach each other."""
    loops = [stage(edges.where("s = t").select(*by, F.col("s").alias("node")), "loops")]
    current, taken = stage(edges.where("s <> t"), "edges"), []
    rounds.clear()
    while True:
        count = current.count()
        rounds.append(count)
        if count <= finish:
            break
        smaller = _smaller(current, by, len(rounds))
        if smaller is None:
            break
        current, ways, found = smaller
        taken.append(ways)
        loops.append(found)
    if count <= finish:
        solved = _solve_small(current, by).select(*by, "root", F.explode("edges").alias("_e"))
        labels = solved.select(*by, F.col("_e.s").alias("node"), F.col("root").alias("label")).distinct()
    else:
        labels = _kernel(current, by).select(*by, F.col("s").alias("node"), F.col("root").alias("label")).distinct()
    labels = stage(labels, "components")
    closed = stage(_all(loops).distinct(), "closed")
    out = _all([ways.select(*by, "node") for ways in taken]) if taken else closed.limit(0)
    alone = closed.join(out, [*by, "node"], "left_anti").join(labels, [*by, "node"], "left_anti")
    labels = stage(labels.unionByName(alone.withColumn("label", F.col("node"))), "components")
    for ways in reversed(taken):
        labels = stage(labels.unionByName(_labelled(ways, labels, closed, by)), "components")
    return labels


def _smaller(edges: DataFrame, by: list[str], turn: int) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """The edges after a round, the edges of the nodes taken out, and the nodes that got an edge to themselves; none if no node can go.

    One grouping tells of each node its ways and its luckiest neighbour, whatever that has; a node with few ways goes if it is luckier.
    Where nodes with many ways win too often, a second look lets only those with few compete.
    """
    outward = edges.select(*by, F.col("s").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i"), _luck(edges, by, "t", turn).alias("rival"))
    inward = edges.select(*by, F.col("t").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i"), _luck(edges, by, "s", turn).alias("rival"))
    degrees = outward.unionByName(inward).groupBy(*by, "node").agg(F.sum("i").alias("i"), F.sum("o").alias("o"), F.min("rival").alias("rival"))
    through = F.col("i") * F.col("o")
    few = (through <= FEW_WAYS) | (through <= F.col("i") + F.col("o"))
    mine = _luck(degrees, by, "node", turn)
    nodes = stage(degrees.where(few).select(*by, "node", (through == 0).alias("dead"), ((through == 0) | (mine < F.col("rival"))).alias("goes")), "nodes")
    able, going = nodes.agg(F.count("*"), F.count_if("goes")).first()
    if not able:
        return None
    if going * WON <= able:
        nodes = _among_few(edges, nodes, by, turn)
    gone = nodes.where("goes").select(*by, "node", "dead")
    marked = edges.join(gone.withColumnsRenamed({"node": "s", "dead": "s_dead"}), [*by, "s"], "left").join(
        gone.withColumnsRenamed({"node": "t", "dead": "t_dead"}), [*by, "t"], "left"
    )
    alive = marked.where("NOT coalesce(s_dead, false) AND NOT coalesce(t_dead, false)")
    marked = stage(alive.select(*by, "s", "t", F.col("s_dead").isNotNull().alias("s_goes"), F.col("t_dead").isNotNull().alias("t_goes")), "marked")
    into = marked.where("t_goes").select(*by, F.col("t").alias("node"), F.col("s").alias("other"), F.lit(True).alias("enters"))
    out = marked.where("s_goes").select(*by, F.col("s").alias("node"), F.col("t").alias("other"), F.lit(False).alias("enters"))
    ways = into.withColumnRenamed("other", "s").join(out.withColumnRenamed("other", "t"), [*by, "node"]).select(*by, "s", "t")
    rest = marked.where("NOT s_goes AND NOT t_goes").select(*by, "s", "t")
    after = stage(rest.unionByName(ways).distinct(), "edges")
    return after.where("s <> t"), into.unionByName(out), after.where("s = t").select(*by, F.col("s").alias("node"))


def _luck(edges: DataFrame, by: list[str], node: str, turn: int) -> Column:
    """A number for a node in a round, the least is the luckiest.

    Numbered nodes go by another bit of their number in each round, so that every other one of a path in the order of numbers goes, and then by a
    digest as all others do: of a path in any order a third goes. Which value of the bit is luckier changes with the round.
    """
    digest = F.shiftrightunsigned(F.xxhash64(*by, node, F.lit(turn)), 2)
    if not isinstance(edges.schema["s" if node != "node" else node].dataType, T.IntegralType):
        return digest
    bit = F.shiftright(F.col(node).cast("bigint"), (turn - 1) % 63).bitwiseAND(1).bitwiseXOR(F.lit(turn % 2).cast("bigint"))
    return digest + F.shiftleft(bit, 62)


def _among_few(edges: DataFrame, nodes: DataFrame, by: list[str], turn: int) -> DataFrame:
    """The nodes with who goes decided among those with few ways only: the luckiest of each neighbourhood of them."""
    few = nodes.where("NOT dead").select(*by, "node")
    both = edges.join(few.withColumnRenamed("node", "s"), [*by, "s"], "left_semi").join(few.withColumnRenamed("node", "t"), [*by, "t"], "left_semi")
    rivals = both.select(*by, F.col("s").alias("node"), _luck(both, by, "t", turn).alias("rival")).unionByName(both.select(*by, F.col("t").alias("node"), _luck(both, by, "s", turn).alias("rival")))
    best = rivals.groupBy(*by, "node").agg(F.min("rival").alias("rival"))
    beaten = best.where(_luck(best, by, "node", turn) >= F.col("rival")).select(*by, "node", F.lit(True).alias("beaten"))
    decided = nodes.join(beaten, [*by, "node"], "left").select(*by, "node", "dead", F.col("beaten").isNull().alias("goes"))
    return stage(decided, "nodes")


def _labelled(ways: DataFrame, labels: DataFrame, closed: DataFrame, by: list[str]) -> DataFrame:
    """Labels of the nodes of a round, given those of all that stayed longer."""
    sides = ways.join(labels.withColumnRenamed("node", "other"), [*by, "other"]).groupBy(*by, "node", "label").agg(F.count_if("enters").alias("i"), F.count_if(~F.col("enters")).alias("o"))
    found = sides.where("i > 0 AND o > 0").select(*by, "node", F.col("label").alias("found"), F.lit(None).cast(labels.schema["label"].dataType).alias("own"))
    own = closed.join(ways.select(*by, "node"), [*by, "node"], "left_semi").select(*by, "node", F.lit(None).cast(labels.schema["label"].dataType).alias("found"), F.col("node").alias("own"))
    # a node has one label at most that it leads from and back to
    both = found.unionByName(own).groupBy(*by, "node").agg(F.coalesce(F.max("found"), F.max("own")).alias("label"))
    return both.select(*by, "node", "label")


def _kernel(edges: DataFrame, by: list[str]) -> DataFrame:
    """Components by passing labels along the edges, in both directions at once."""
    remaining, found = _trim(edges, by), []
    while not remaining.isEmpty():
        # The smallest node that reaches a node and that it reaches: then both reach each other.
        settled = _labels(remaining, by).where("reached_by = reaches").select(*by, "node", F.col("reaches").alias("root"))
        starts = settled.withColumnRenamed("node", "s")
        ends = settled.withColumnsRenamed({"node": "t", "root": "root_t"})
        marked = remaining.join(starts, [*by, "s"], "left").join(ends, [*by, "t"], "left")
        marked = stage(marked, "marked")
        found.append(marked.where("root = root_t").select(*by, "root", "s", "t"))
        remaining = _trim(marked.where("root IS NULL AND root_t IS NULL").select(*by, "s", "t"), by)
    if not found:
        return remaining.select(*by, F.col("s").alias("root"), "s", "t")
    return _all(found)


def _all(frames: Iterable[DataFrame]) -> DataFrame:
    first, *others = frames
    for other in others:
        first = first.unionByName(other)
    return first


def _trim(edges: DataFrame, by: list[str]) -> DataFrame:
    """Drop edges that enter a dead end or leave a node nothing enters, until none is left."""
    edges = stage(edges, "edges")
    count = edges.count()
    while count:
        entered = edges.select(*by, F.col("t").alias("s")).distinct()
        left = edges.select(*by, F.col("s").alias("t")).distinct()
        kept = edges.join(entered, [*by, "s"], "left_semi").join(left, [*by, "t"], "left_semi")
        kept = stage(kept.select(*by, "s", "t"), "trimmed")
        after = kept.count()
        if after == count:
            break
        edges, count = kept, after
    return edges


def _labels(edges: DataFrame, by: list[str]) -> DataFrame:
    """For each node the smallest node that leads to it and the smallest it leads to, itself included."""
    ends = edges.select(*by, F.col("s").alias("node")).union(edges.select(*by, F.col("t").alias("node")))
    state = ends.distinct().select(
        *by, "node", F.col("node").alias("reached_by"), F.col("node").alias("reaches"), F.lit(True).alias("moved")
    )
    state = stage(state, "labels")
    while state.where("moved").limit(1).count():
        news = state.where("moved").drop("moved")
        forward = edges.join(news.withColumnRenamed("node", "s"), [*by, "s"]).select(
            *by, F.col("t").alias("node"), F.col("reached_by").alias("offer"), F.lit(True).alias("forward")
        )
        backward = edges.join(news.withColumnRenamed("node", "t"), [*by, "t"]).select(
            *by, F.col("s").alias("node"), F.col("reaches").alias("offer"), F.lit(False).alias("forward")
        )
        offers = forward.union(backward).groupBy(*by, "node").agg(
            F.min(F.when(F.col("forward"), F.col("offer"))).alias("new_by"),
            F.min(F.when(~F.col("forward"), F.col("offer"))).alias("new_reaches"),
        )
        smaller = (F.col("new_by") < F.col("reached_by")) | (F.col("new_reaches") < F.col("reaches"))
        updated = state.join(offers, [*by, "node"], "left").select(
            *by,
            "node",
            F.least("reached_by", "new_by").alias("reached_by"),
            F.least("reaches", "new_reaches").alias("reaches"),
            F.coalesce(smaller, F.lit(False)).alias("moved"),
        )
        state = stage(updated, "labels")
    return state.drop("moved")


def _walk(inner: DataFrame, by: list[str]) -> DataFrame:
    """The shortest cycle through each root, one step of all paths per round."""
    inner = stage(inner, "inner")
    keys = [*by, "root"]
    steps = inner.select(*keys, F.col("s").alias("node"), "t")
    front = inner.select(*keys).distinct().withColumns({"node": F.col("root"), "path": F.array("root")})
    front = stage(front, "front")
    seen, closed = front.select(*keys, "node"), [front.limit(0).select(*keys, "path")]
    while not front.isEmpty():
        reached = (
            front.join(steps, [*keys, "node"])
            .groupBy(*keys, F.col("t").alias("node"))
            .agg(F.min(F.concat("path", F.array("t"))).alias("path"))
        )
        reached = stage(reached, "reached")
        back = reached.where("node = root").select(*keys, "path")
        closed.append(back)
        front = reached.join(back, keys, "left_anti").join(seen, [*keys, "node"], "left_anti")
        front = stage(front.select(*keys, "node", "path"), "front")
        seen = seen.unionByName(front.select(*keys, "node"))
    return _all(closed)
