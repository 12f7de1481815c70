"""Parent links to full hierarchies: root, depth, path, descendants and cycles.

Each node has at most one parent, so the links form trees and loops. A weighted
disjoint-set forest holds for every node a node above it and its offset, the
number of links up to it. The same level is repeated until no link is open:

1. links are range-partitioned into blocks by (group, id), and each block unites
   and compresses its own sets, so a node points at the top of its tree there;
2. only nodes that others point at from afar stay open; their offsets are the
   links of a much smaller forest, of which a part that no two links share is
   spliced out by one join, so that it shrinks however the links run;
3. the next level merges neighbouring blocks, `fan_in` into one, as long as a block
   stays within `close_links`. The level of a single block leaves nothing open.

Roots, offsets and loops are handed back down level by level with one join each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage

_FOREST = "id long, root long, steps long, looped boolean, grp string"
_FOREST_ARROW = pa.schema([("id", pa.int64()), ("root", pa.int64()), ("steps", pa.int64()), ("looped", pa.bool_()), ("grp", pa.string())])
# Answers of at most so many nodes, 25 bytes each, are broadcast.
BROADCAST_NODES = 500_000


def compress(ids: np.ndarray, parents: np.ndarray, steps: np.ndarray):
    """Root, offset and loop flag of every link's child within one set of links.

    A link puts its child's set under its parent's, with the link's steps as the
    child's offset; then all paths are halved together until each ends at a root.
    What then does not end lies on a loop or leads into one.
    """
    nodes = np.unique(np.concatenate([ids, parents]))
    child = np.searchsorted(nodes, ids)
    up = np.arange(len(nodes))
    weight = np.zeros(len(nodes), np.int64)
    up[child] = np.searchsorted(nodes, parents)
    weight[child] = steps
    top = np.ones(len(nodes), bool)
    top[child] = False
    for _ in range(max(1, math.ceil(math.log2(len(nodes) + 1))) + 1):
        if top[up].all():
            break
        weight = np.where(top[up], weight, weight + weight[up])
        up = up[up]
    return nodes[up[child]], weight[child], ~top[up[child]]


def _block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The forest of one block of links, whose arrays are bounded by its size."""
    batches = [b for b in batches if b.num_rows]
    if batches:
        table = pa.Table.from_batches(batches)
        ids, parents, steps = (table.column(c).to_numpy() for c in ("id", "parent", "steps"))
        forest = pa.Table.from_arrays([*map(pa.array, (ids, *compress(ids, parents, steps))), table.column("grp")], schema=_FOREST_ARROW)
        yield from forest.to_batches(max_chunksize=50_000)


def _answered(level: DataFrame, solved: DataFrame, n_open: int) -> DataFrame:
    """Links of a level, carried on by the answers of the n_open nodes they may point at."""
    above = solved.select(F.col("id").alias("_at"), F.col("root").alias("_root"), F.col("steps").alias("_steps"), F.col("looped").alias("_looped"))
    joined = level.join(F.broadcast(above) if n_open <= BROADCAST_NODES else above, level["root"] == above["_at"], "left")
    return joined.select(
        "id",
        F.coalesce("_root", "root").alias("root"),
        (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"),
        (F.col("looped") | F.coalesce("_looped", F.lit(False))).alias("looped"),
    )


def _spliced(now: DataFrame, coin: int) -> tuple[DataFrame, DataFrame]:
    """Links that are settled or taken out of a set of links, and the set without them.

    A link to itself is a closed loop: it is settled, and links to it become such
    links. Of the others those from a node of one side of a coin to one of the
    other are taken out, no two of which follow each other.
    """
    closed = now.where("id = parent")
    rest = now.where("id != parent").join(closed.select(F.col("id").alias("_c")), F.col("parent") == F.col("_c"), "left")
    rest = stage(rest.select("id", F.when(F.col("_c").isNotNull(), F.col("id")).otherwise(F.col("parent")).alias("parent"), "steps", "grp"), "rest")
    side = lambda c: F.pmod(F.xxhash64(c, F.lit(coin)), F.lit(2))
    taken = rest.where((side("id") == 0) & (side("parent") == 1) & (F.col("id") != F.col("parent")))
    out = [df.select("id", F.col("parent").alias("root"), "steps", F.lit(loop).alias("looped")) for df, loop in ((closed, True), (taken, False))]
    over = taken.select(F.col("id").alias("_id"), F.col("parent").alias("_parent"), F.col("steps").alias("_steps"))
    kept = rest.join(over.select(F.col("_id").alias("id")), "id", "left_anti")
    joined = kept.join(over, kept["parent"] == over["_id"], "left")
    left = joined.select("id", F.coalesce("_parent", "parent").alias("parent"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"), "grp")
    return out[0].unionByName(out[1]), stage(left, "links")


def resolve_links(links: DataFrame, block_links: int = 200_000, close_links: int = 1_000_000, fan_in: int = 8) -> DataFrame:
    """For every child of `links(id, parent, grp)`: id, root, steps to it, looped.

    `grp` only steers which links share a block. A child must occur once. For a
    node on a loop, or leading into one, looped is true and root and steps mean
    nothing. Links with a null id or parent are ignored; a link to itself is a
    loop; without links the result is empty. There are at least fan_in blocks of
    about block_links links at first; merged ones hold up to about close_links.
    """
    links = links.where("id is not null and parent is not null")
    now = stage(links.select("id", "parent", F.lit(1).cast("long").alias("steps"), F.col("grp").cast("string").alias("grp")), "links")
    n = now.count()
    blocks = max(fan_in, math.ceil(n / block_links))
    levels: list[tuple[DataFrame, DataFrame, int]] = []
    while True:
        forest = stage(now.repartitionByRange(blocks, "grp", "id").mapInArrow(_block, _FOREST), "forest")
        roots = forest.where("not looped").select(F.col("root").alias("id")).distinct()
        parent = F.when(F.col("looped"), F.col("id")).otherwise(F.col("root")).alias("parent")
        now = stage(forest.join(roots, "id", "left_semi").select("id", parent, "steps", "grp"), "open")
        n = now.count()
        if not n:
            break
        spliced, now = _spliced(now, len(levels))
        levels.append((forest.drop("grp"), spliced, n))
        blocks = max(math.ceil(blocks / fan_in), math.ceil(n / close_links))
    solved = forest.drop("grp")
    for forest, spliced, n in reversed(levels):
        solved = stage(solved.unionByName(_answered(spliced, solved, n)), "solved")
        solved = stage(_answered(forest, solved, n), "solved")
    return solved


def paths_to_root(nodes: DataFrame, resolved: DataFrame) -> DataFrame:
    """id, and `path`: the names from the root down to the node itself.

    nodes(id, parent, name); resolved as resolve_links gives it. Nodes on or
    above a loop have no path and give no row. The index from node to the path
    above it doubles its reach in every round, so depth d takes log2(d) joins.
    """
    ended = resolved.where("not looped").select("id", "steps")
    deepest = ended.agg(F.max("steps")).first()[0] or 0
    alive = stage(nodes.join(resolved.where("looped").select("id"), "id", "left_anti").join(ended, "id", "left"), "alive")
    names = alive.select(F.col("id").alias("_up"), F.col("name").alias("_name"))
    linked = alive.where("steps is not null and parent is not null")
    first = linked.join(names, linked["parent"] == names["_up"]).select("id", "name", F.col("_up").alias("at"), F.array("_name").alias("above"))
    # Nodes whose path is whole are set aside; only the others look further up.
    done = alive.where("steps is null or parent is null").select("id", "name", F.lit(None).cast("long").alias("at"), F.array().cast("array<string>").alias("above"))
    going = stage(first, "paths")
    for _ in range(math.ceil(math.log2(deepest)) if deepest > 1 else 0):
        index = done.unionByName(going).where("size(above) > 0").select(F.col("id").alias("_up"), F.col("at").alias("_at"), F.col("above").alias("_above"))
        joined = going.join(index, going["at"] == index["_up"], "left")
        above = F.when(F.col("_up").isNull(), F.col("above")).otherwise(F.concat("_above", "above")).alias("above")
        now = stage(joined.select("id", "name", F.col("_at").alias("at"), above), "paths")
        done, going = done.unionByName(now.where("at is null")), now.where("at is not null")
    return done.unionByName(going).select("id", F.concat("above", F.array("name")).alias("path"))


def looped_ancestors(links: DataFrame, resolved: DataFrame) -> DataFrame:
    """id, above, distance: every other node that a node on or above a loop leads to.

    links(id, parent), resolved as resolve_links gives it. A walk up ends where it
    would come back to a node it has passed. Reach doubles in every round, until a
    round finds nothing that was not known.
    """
    inside = resolved.where("looped").select("id")
    now = stage(links.join(inside, "id").select("id", F.col("parent").alias("above"), F.lit(1).cast("long").alias("distance")), "looped")
    jump = now.select("id", F.col("above").alias("at"))
    reach, known, n = 1, 0, now.count()
    while n > known:
        known = n
        index = now.select(F.col("id").alias("_at"), "above", F.col("distance").alias("_more"))
        further = jump.join(index, jump["at"] == index["_at"]).select("id", "above", (F.lit(reach) + F.col("_more")).alias("distance"))
        now = stage(now.unionByName(further).groupBy("id", "above").agg(F.min("distance").alias("distance")), "looped")
        over = jump.select(F.col("id").alias("_id"), F.col("at").alias("_to"))
        jump = stage(jump.join(over, jump["at"] == over["_id"]).select("id", F.col("_to").alias("at")), "jumps")
        reach, n = 2 * reach, now.count()
    return now.where("id != above")
