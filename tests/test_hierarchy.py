from __future__ import annotations

import random

import pytest
from conftest import rows

from corbel.operators.hierarchy import looped_ancestors, paths_to_root, resolve_links
from corbel.operators.references import token_links


def walked(parent: dict[int, int]) -> dict[int, tuple]:
    out = {}
    for node in parent:
        seen, at, n = {node}, parent[node], 1
        while at in parent and at not in seen:
            seen.add(at)
            at, n = parent[at], n + 1
        out[node] = (None, None, True) if at in parent else (at, n, False)
    return out


def resolved(spark, parent: dict[int, int], **sizes) -> dict[int, tuple]:
    df = spark.createDataFrame([(c, p, str(c % 3)) for c, p in parent.items()], "id long, parent long, grp string")
    return {i: (None, None, True) if looped else (root, steps, False) for i, root, steps, looped in rows(resolve_links(df, **sizes))}


@pytest.mark.parametrize("seed", [1])
def test_against_walking_with_many_blocks_and_splicing(spark, seed):
    rng = random.Random(seed)
    parent = {i: rng.randrange(max(1, i - 4), i + 1) if rng.random() < 0.97 else rng.randrange(120) for i in range(1, 120) if rng.random() < 0.95}
    parent |= {200: 201, 201: 202, 202: 200, 203: 200, 204: 203, 300: 300}
    assert resolved(spark, parent, block_links=15, close_links=10) == walked(parent)


def test_long_chain(spark):
    parent = {i: i - 1 for i in range(1, 90)}
    assert resolved(spark, parent, block_links=30, close_links=15) == walked(parent)


@pytest.mark.parametrize("shape", ["one tree", "chain", "loop"])
def test_one_tree_and_one_chain_of_all_nodes(spark, shape):
    n = 10_000
    order = random.Random(4).sample(range(n), n)
    up = {"one tree": lambda i: max(0, i // 3 - 1) if i > 3 else 0, "chain": lambda i: i - 1, "loop": lambda i: (i - 1) % n}[shape]
    parent = {order[i]: order[up(i)] for i in range(0 if shape == "loop" else 1, n)}
    depth = [0] * n
    for i in range(1, n):
        depth[i] = depth[up(i)] + 1
    want = {order[i]: (None, None, True) if shape == "loop" else (order[0], depth[i], False) for i in range(n) if order[i] in parent}
    assert resolved(spark, parent, block_links=2_000, close_links=3_000, fan_in=2) == want


def test_no_links_and_nulls(spark):
    df = spark.createDataFrame([(1, None, "a"), (None, 2, "a")], "id long, parent long, grp string")
    assert rows(resolve_links(df)) == []
    assert rows(resolve_links(df.limit(0))) == []


def test_paths(spark):
    nodes = spark.createDataFrame([(i, p, f"n{i}") for i, p in [(0, None), (1, 0), (2, 1), (3, 2), (4, 3), (5, 4), (6, 0), (7, 8), (8, 7), (9, 7), (10, 99)]], "id long, parent long, name string")
    links = nodes.where("parent is not null and parent != 99").selectExpr("id", "parent", "'g' as grp")
    paths = {i: p for i, p in rows(paths_to_root(nodes, resolve_links(links)))}
    assert paths == {0: ("n0",), 1: ("n0", "n1"), 2: ("n0", "n1", "n2"), 3: ("n0", "n1", "n2", "n3"), 4: ("n0", "n1", "n2", "n3", "n4"), 5: ("n0", "n1", "n2", "n3", "n4", "n5"), 6: ("n0", "n6"), 10: ("n10",)}


def test_what_hangs_on_loops_is_derived_too(spark):
    parent = {1: 2, 2: 3, 3: 1, 4: 1, 5: 4, 6: 6, 7: 6, 20: 21} | {i: i - 1 for i in range(8, 19)}
    want = []
    for node in [1, 2, 3, 4, 5, *range(6, 19)]:
        at, past = parent[node], [node]
        while at not in past:
            want.append((node, at, len(past)))
            past.append(at)
            at = parent[at]
    links = spark.createDataFrame([(c, p, "g") for c, p in parent.items()], "id long, parent long, grp string")
    assert sorted(rows(looped_ancestors(links, resolve_links(links)))) == sorted(want)
    tree = links.where("id = 20")
    assert rows(looped_ancestors(tree, resolve_links(tree))) == []


def test_kinds_of_references(spark):
    nodes = spark.createDataFrame(
        [(1, "s", "a", "--a", None), (2, "s", "b", None, [None, " {a} ", "c"]), (3, "s", "c", "--c", ["var( --a )"]), (4, "s", "d", None, ["nothing", "a"]), (5, "t", "e", None, ["a"]), (6, None, "f", None, ["g"]), (7, None, "g", None, [])],
        "id long, system_id string, name string, css_var string, refs array<string>",
    )
    assert sorted(rows(token_links(nodes).select("id", "parent"))) == [(2, 1), (3, 1), (6, 7)]
