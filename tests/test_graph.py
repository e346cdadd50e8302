"""Edge-table operators against plain set logic."""

import random

import pytest
from pyspark.sql import functions as F

from cohortlab.models.spec import spec_frame, spec_grid
from cohortlab.operators import graph
from cohortlab.plans import dag
from conftest import rows


def brute_controls(parents, latent, x, y):
    children = {}
    for node, names in parents.items():
        for p in names:
            children.setdefault(p, []).append(node)

    def walk(start, step):
        seen, todo = set(start), list(start)
        while todo:
            for n in step.get(todo.pop(), []):
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        return seen

    up = walk([x], parents) | walk([y], parents)
    causal = (walk([x], children) & walk([y], parents)) - {x}
    return up - {x, y} - set(latent) - walk(causal, children)


def test_model_has_the_expected_size(spark):
    edges = dag.model_edges(spark)
    assert edges.count() == 70
    nodes = dag.model_nodes(spark, edges)
    assert nodes.count() == 25
    assert nodes.filter("latent").count() == 10
    assert nodes.filter("var_type = 'error'").isEmpty()


def test_controls_equal_set_logic(spark):
    parents = dag.PARENTS
    got = dag.control_sets(spark)
    assert set(got) == set(dag.FOCAL)
    for x in dag.FOCAL:
        assert set(got[x][0]) == brute_controls(parents, dag.LATENT, x, dag.OUTCOME)


def test_cycles_end(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    start = spark.createDataFrame([("a",)], "node string")
    assert rows(graph.reachable(edges, start)) == [("a",), ("b",), ("c",), ("d",)]
    assert rows(graph.reachable(edges, start, up=True)) == [("a",), ("b",), ("c",)]


def test_graphs_do_not_mix(spark):
    edges = spark.createDataFrame([(1, "a", "b"), (2, "b", "c")], "g int, src string, dst string")
    start = spark.createDataFrame([(1, "a"), (2, "a")], "g int, node string")
    assert rows(graph.reachable(edges, start, ["g"])) == [(1, "a"), (1, "b"), (2, "a")]


def test_long_chain_takes_few_rounds(spark, monkeypatch):
    written = []
    real = graph.staged
    monkeypatch.setattr(graph, "staged", lambda df, name: written.append(name) or real(df, name))
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)], "src long, dst long")
    start = spark.createDataFrame([(0, "p"), (250, "q")], "node long, search string")
    got = rows(graph.reachable(edges, start))
    assert got == sorted([(i, "p") for i in range(n + 1)] + [(i, "q") for i in range(250, n + 1)], key=repr)
    assert written.count("found") <= 10


def test_hubs_are_not_squared(spark, monkeypatch):
    written = []
    real = graph.staged
    monkeypatch.setattr(graph, "staged", lambda df, name: written.append(df) or real(df, name))
    n = 200
    edges = [(f"a{i}", "hub") for i in range(n)] + [("hub", f"b{i}") for i in range(n)] + [("b7", "end"), ("end", "b8")]
    found = rows(graph.reachable(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([("a3",)], "node string")))
    assert found == sorted([("a3",), ("hub",), ("end",)] + [(f"b{i}",) for i in range(n)], key=repr)
    assert max(df.count() for df in written) <= 2 * len(edges)


def test_random_graphs_against_plain_search(spark):
    rng = random.Random(5)
    edges = [(g, rng.randint(0, 30), rng.randint(0, 30)) for g in range(4) for _ in range(18 + 12 * g)]
    starts = [(g, rng.randint(0, 30)) for g in range(5) for _ in range(3)]
    for up in (False, True):
        step = {}
        for g, a, b in edges:
            step.setdefault((g, b if up else a), []).append((g, a if up else b))
        expected = set()
        for start in starts:
            todo, seen = [start], {start}
            while todo:
                for node in step.get(todo.pop(), []):
                    if node not in seen:
                        seen.add(node)
                        todo.append(node)
            expected |= {(g, node, start[1]) for g, node in seen}
        first = spark.createDataFrame([(g, n, n) for g, n in starts], "g int, node int, origin int")
        got = graph.reachable(spark.createDataFrame(edges, "g int, src int, dst int"), first, ["g"], up=up)
        assert rows(got) == sorted(expected, key=repr)


def closed(edges, x, y, controls):
    """Whether controls close every path from x to y that is not causal, path by path."""
    parents, children = {}, {}
    for a, b in edges:
        parents.setdefault(b, set()).add(a)
        children.setdefault(a, set()).add(b)

    def above(nodes):
        seen, todo = set(nodes), list(nodes)
        while todo:
            for p in parents.get(todo.pop(), ()):
                if p not in seen:
                    seen.add(p)
                    todo.append(p)
        return seen

    known = above(controls)

    def is_open(path):
        if all((a, b) in edges for a, b in zip(path, path[1:])):
            return False  # causal
        for a, m, b in zip(path, path[1:], path[2:]):
            collides = (a, m) in edges and (b, m) in edges
            if collides and m not in known or not collides and m in controls:
                return False
        return True

    def walk(path):
        if path[-1] == y:
            return is_open(path)
        near = parents.get(path[-1], set()) | children.get(path[-1], set())
        return any(walk([*path, n]) for n in near - set(path))

    return not walk([x])


def test_adjustable_equals_a_look_at_every_path(spark):
    rng = random.Random(7)
    edges, latent, exposures, outcomes = [], [], [], []
    for g in range(12):
        names = list("abcdefg")
        edges += [(g, a, b) for i, a in enumerate(names) for b in names[i + 1 :] if rng.random() < 0.35]
        latent += [(g, n) for n in names[:-1] if rng.random() < 0.3]
        outcomes.append((g, "g"))
        exposures += [(g, n) for n in names[:-1] if (g, n) not in latent]
    e = spark.createDataFrame(edges, "g int, src string, dst string")
    nodes = graph.node_table(e, spark.createDataFrame(latent, "g int, name string"), ["g"])
    controls, valid = graph.adjustable(e, nodes, spark.createDataFrame(exposures, "g int, node string"), spark.createDataFrame(outcomes, "g int, node string"), ["g"])
    sets = {}
    for g, x, c in rows(controls):
        sets.setdefault((g, x), set()).add(c)
    got = {(r.g, r.exposure): r.valid for r in valid.collect()}
    expected = {(g, x): closed({(a, b) for h, a, b in edges if h == g}, x, "g", sets.get((g, x), set())) for g, x in exposures}
    assert got == expected and len(set(got.values())) == 2
    with pytest.raises(ValueError, match="no control set"):
        dag.checked_controls(controls, valid, ["g"])
    kept = dag.checked_controls(controls, valid.where("valid"), ["g"])
    assert {(r.g, r.exposure) for r in kept.collect()} == {k for k, v in expected.items() if v}


def test_unknown_variables_have_no_set(spark):
    with pytest.raises(ValueError, match="not in the causal model"):
        dag.control_sets(spark, ["nothing"])


def test_spec_frame_equals_the_grid_of_each_graph(spark):
    sets = {1: {"a": ["b", "s"], "s": [], "z": ["y"]}, 2: {"z": ["s", "a"], "b": ["z"]}, None: {"q": []}}
    table = [(g, x, c) for g, some in sets.items() for x, names in some.items() for c in (names or [None])]
    short, kinds = {"s": ["s1", "s0"], "unused": ["u"]}, {"o2": ["lm", "Poisson"], "o1": ["hurdle"]}
    how = dict(outcome_controls={"o1": ["o2"]}, covar_groups={"s0": "some", "z": "other"})
    df = spark.createDataFrame(table, "g int, exposure string, control string")
    got = {}
    for r in spec_frame(df, ["g"], ["year"], short, kinds, **how).collect():
        got.setdefault(r.g, []).append((r.model_idx, r.outcome, r.focal_var, r.formula, r.model_type, r.covar_group, tuple(map(tuple, r.terms))))
    for g, some in sets.items():
        grid = spec_grid({x: [sorted(some[x])] for x in sorted(some)}, ["year"], short, kinds, **how)
        expected = [(s.model_idx, s.outcome, s.focal_var, s.form, s.model_type, s.covar_group, s.terms) for s in grid]
        assert sorted(got[g], key=lambda r: int(r[0])) == expected
    # the settings alone are sent along: no row of the table is collected
    hub = spark.range(3000).select(F.lit(1).alias("g"), F.concat(F.lit("v"), "id").alias("exposure"), F.lit("c").alias("control"))
    wide = spec_frame(hub, ["g"], [], {}, {"o": ["lm"]})
    assert wide.count() == 6000 and wide.agg(F.max(F.col("model_idx").cast("int"))).first()[0] == 6000
