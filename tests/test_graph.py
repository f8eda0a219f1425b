import random

import pytest

from tablesmith.operators import graph


@pytest.fixture(scope="module")
def edges(spark):
    rng = random.Random(5)
    rows = [(g, f"n{rng.randint(0, 4)}", f"n{rng.randint(0, 4)}") for g in range(5) for _ in range(5)]
    rows += [(99, "p", "x"), (99, "x", "y"), (99, "y", "z"), (99, "z", "x"), (99, None, "x")]
    return spark.createDataFrame(rows, "g int, a string, b string").cache()


def brute_force(rows):
    """Nodes that reach themselves, per group."""
    steps = {}
    for g, a, b in rows:
        if a is not None:
            steps.setdefault((g, a), set()).add((g, b))
    found = set()
    for start in steps:
        seen, front = set(), steps[start]
        while front:
            seen |= front
            front = set().union(*(steps.get(n, set()) for n in front)) - seen
        if start in seen:
            found.add(start)
    return found


@pytest.mark.parametrize("limit", [graph.SMALL_GRAPH, 0], ids=["at once", "rounds"])
def test_cyclic_nodes(edges, limit):
    found = {tuple(r) for r in graph.cyclic_nodes(edges, ["g"], "a", "b", limit).collect()}
    assert found == brute_force([tuple(r) for r in edges.collect()])


def test_paths_agree(edges):
    at_once = sorted(map(tuple, graph.cycle_paths(edges, ["g"], "a", "b").collect()))
    assert at_once == sorted(map(tuple, graph.cycle_paths(edges, ["g"], "a", "b", 0).collect()))
    assert (99, "x", ["x", "y", "z", "x"]) in at_once


def test_large_groups_take_rounds_others_do_not(edges):
    mixed = sorted(map(tuple, graph.cyclic_edges(edges, ["g"], "a", "b", 4).collect()))
    assert mixed == sorted(map(tuple, graph.cyclic_edges(edges, ["g"], "a", "b").collect()))


def test_single_graph(edges):
    one = edges.where("g = 99").drop("g")
    for limit in (graph.SMALL_GRAPH, 0):
        assert [tuple(r) for r in graph.cycle_paths(one, [], "a", "b", limit).collect()] == [("x", ["x", "y", "z", "x"])]


def strong(edges):
    """The nodes of each group that reach each other, of two or more or with an edge to themselves, by Kosaraju's two searches."""
    ahead, behind = {}, {}
    for s, t in edges:
        ahead.setdefault(s, []).append(t)
        behind.setdefault(t, []).append(s)
    order, seen = [], set()
    for start in ahead:
        stack = [(start, iter(ahead.get(start, ())))] if start not in seen else []
        seen.add(start)
        while stack:
            node, following = stack[-1]
            step = next((n for n in following if n not in seen), None)
            if step is None:
                order.append(stack.pop()[0])
            else:
                seen.add(step)
                stack.append((step, iter(ahead.get(step, ()))))
    groups, done = {}, set()
    for start in reversed(order):
        if start not in done:
            members, front = set(), [start]
            done.add(start)
            while front:
                node = front.pop()
                members.add(node)
                fresh = [n for n in behind.get(node, ()) if n not in done]
                done.update(fresh)
                front += fresh
            if len(members) > 1 or start in ahead.get(start, ()):
                groups |= dict.fromkeys(members, min(members))
    return groups


def graphs():
    rng = random.Random(11)
    path = list(range(1000))
    rng.shuffle(path)
    ladder = [((i, a), (i + 1, b)) for i in range(150) for a in (0, 1) for b in (0, 1)]
    ladder = [(s[0] * 2 + s[1], t[0] * 2 + t[1]) for s, t in ladder]
    return {
        "path": list(zip(path, path[1:])), "ring": list(zip(path, path[1:] + path[:1])), "ladder": ladder, "closed ladder": [*ladder, (300, 1)],
        "random": [(rng.randrange(700), rng.randrange(700)) for _ in range(900)], "dense": [(rng.randrange(150), rng.randrange(150)) for _ in range(1500)],
        "rings on a path": [(i, i + 1) for i in range(300)] + [(i + 7, i) for i in range(0, 300, 20)], "star": [(0, i) for i in range(1, 500)] + [(i, 0) for i in range(1, 500, 7)],
        "loops": [(i, i) for i in range(50)] + [(i, i + 1) for i in range(50)], "two kernels": [(rng.randrange(80), rng.randrange(80)) for _ in range(700)] + [(1000 + rng.randrange(80), 1000 + rng.randrange(80)) for _ in range(700)] + [(5, 1005)],
    }


def test_components_in_few_rounds(spark):
    rows = [(name, s, t) for name, edges in graphs().items() for s, t in edges]
    table = spark.createDataFrame(rows, "g string, s long, t long").distinct()
    labels = graph.components(table, ["g"], 0).collect()
    assert len(graph.rounds) < 30
    for name, edges in graphs().items():
        mine = {r.node: r.label for r in labels if r.g == name}
        theirs = strong(edges)
        assert mine.keys() == theirs.keys(), name
        least = {}
        for node, label in mine.items():
            least[label] = min(node, least.get(label, node))
        assert {n: least[label] for n, label in mine.items()} == theirs, name


def test_a_path_in_order_halves_in_each_round(spark):
    """Every other node of a path in the order of its numbers goes in a round, where about a third went before."""
    size = 4000
    way = spark.range(size).selectExpr("id AS s", "id + 1 AS t")
    back = spark.range(50, size + 1, 50).selectExpr("id AS s", "id - 7 AS t")
    labels = graph.components(way.union(back), [], 100).collect()
    assert len(graph.rounds) <= 7
    groups = {}
    for node, label in labels:
        groups.setdefault(label, set()).add(node)
    assert sorted(map(sorted, groups.values())) == [list(range(p - 7, p + 1)) for p in range(50, size + 1, 50)]
