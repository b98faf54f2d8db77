"""Outlines of labelled cells (see ``tiled``) as polygons, for instances of any length.

Each side of a cell that faces another label or none is a directed edge between cell corners, the inside on
its right. Which edge follows is decided by the two cells ahead, so cells that touch at a corner only belong
to different rings (and holes that do share one). A tile chains its own edges, given the cells around it; a ring that lies
in one tile is done there. Chains that leave their tiles are linked by pointer jumping: rounds of joins that double the way each chain
sees, as many as the logarithm of the most chains in an outline. Nothing collects a ring that crosses tiles.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.operators.tiled import TILE, _coordinates, _met, _step, _tile_of, offsets, place
from stratalens.storage import forget, written

#: Sides of a cell clockwise from the top: (step to the cell across it, step to the cell ahead, corner where the edge starts).
SIDES = (((-1, 0), (0, 1), (0, 0)), ((0, 1), (1, 0), (0, 1)), ((1, 0), (0, -1), (1, 1)), ((0, -1), (-1, 0), (1, 0)))


def chained(places: np.ndarray, values: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, ...]:
    """The edges of a tile's inner cells, in chains: (edge, its cell, chain, whether the outline turns where it starts) chain by chain, and of each chain (edges, place of the least one, the edge behind the last, whether it is closed).

    Cells come sorted by place, those around the tile too. A closed chain starts with its least edge; whether an open one turns at its start isn't known here.
    """
    at = _coordinates(places, 2)
    number = lambda yx, side: yx[:, 0] << 32 | yx[:, 1] << 2 | side

    def has(o: tuple[int, int]) -> np.ndarray:
        to = np.minimum(np.searchsorted(places, places + _step(o, 2)), len(places) - 1)
        return (places[to] == places + _step(o, 2)) & (values[to] == values)

    near = {o: has(o) for o in offsets(2, 2)}
    edge, behind, cell = [], [], []
    for s, (out, ahead, _) in enumerate(SIDES):
        beyond = (out[0] + ahead[0], out[1] + ahead[1])
        follow = np.where(~near[ahead], number(at, (s + 1) % 4), np.where(~near[beyond], number(at + ahead, s), number(at + beyond, (s + 3) % 4)))
        here = np.flatnonzero(inner & ~near[out])
        edge.append(number(at[here], s))
        behind.append(follow[here])
        cell.append(here)
    edge, behind, cell = (np.concatenate(x) for x in (edge, behind, cell))
    by = np.argsort(edge)
    edge, behind, cell = edge[by], behind[by], cell[by]
    here = np.arange(len(edge))
    if not len(edge):
        return edge, cell, here, here == 1, here, here, edge, here == 1
    to = np.minimum(np.searchsorted(edge, behind), len(edge) - 1)
    inside = edge[to] == behind
    back = here.copy()  # a chain's first edge points to itself
    back[to[inside]] = here[inside]
    first = np.ones(len(edge), bool)
    first[to[inside]] = False
    rounds = int(len(edge)).bit_length()
    least, far = here.copy(), back.copy()
    for _ in range(rounds):
        least, far = np.minimum(least, least[far]), far[far]
    start = ~first[far] & (least == here)  # of those that go round in the tile
    back[start] = here[start]
    far, place = back.copy(), (back != here).astype(np.int64)
    for _ in range(rounds):
        place, far = place + place[far], far[far]
    by = np.lexsort((place, far))
    new = np.append(True, far[by][1:] != far[by][:-1])
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(edge)) - 1
    side = edge[by] & 3
    before = np.append(side[:1], side[:-1])
    before[begin] = side[last]
    chain = np.cumsum(new) - 1
    return edge[by], cell[by], chain, side != before, last - begin + 1, place[np.minimum.reduceat(by, begin)], behind[by][last], start[by][begin]


def _tile_chains(cells: DataFrame, by: Sequence[str], label: str, at: tuple[str, str], tile: int) -> DataFrame:
    """(by, label, head, n, least, shift, next, closed, edges): the chains that the edges of each tile make, with (edge, turns) in order."""
    rows = cells.where(F.col(label) != 0).dropna(subset=list(at)).select(*by, *[F.col(c).cast("long").alias(c) for c in at], label)
    own = F.struct(*_tile_of(at, tile))
    around = F.array_distinct(F.array(own, *[F.struct(*[F.floor((F.col(c) + d) / tile).cast("int").alias(f"__t{k}") for k, (c, d) in enumerate(zip(at, o, strict=True))]) for o in offsets(2, 2)]))
    rim = reduce(Column.__or__, [(F.col(c) % tile == 0) | (F.col(c) % tile == tile - 1) for c in at])
    rows = rows.withColumn("__o", F.explode(F.when(rim, around).otherwise(F.array(own)))).select(*by, "__o.__t0", "__o.__t1", F.struct(place(at).alias("p"), F.col(label).alias("v")).alias("c"))
    packed = rows.groupBy(*by, "__t0", "__t1").agg(F.sort_array(F.collect_list("c")).alias("cells"))  # a tile's cells and those around it
    kinds = dict(packed.dtypes) | {label: dict(cells.dtypes)[label]}
    names = [*by, label, "head", "n", "least", "shift", "next", "closed", "edges"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i in range(batch.num_rows):
                flat = batch.column("cells")[i].values
                p = np.asarray(flat.field("p"))
                once = np.flatnonzero(np.append(True, p[1:] != p[:-1]))  # of cells that repeat, the least label
                p, v = p[once], flat.field("v").take(pa.array(once))
                t = np.array([batch.column(c)[i].as_py() for c in ("__t0", "__t1")])
                edge, cell, chain, turns, n, shift, behind, closed = chained(p, np.asarray(pc.dictionary_encode(v).indices), (_coordinates(p, 2) // tile == t).all(axis=1))
                if not len(edge):
                    continue
                begin = np.cumsum(n) - n
                steps = pa.ListArray.from_arrays(pa.array(np.append(begin, len(edge)).astype(np.int32)), pa.StructArray.from_arrays([pa.array(edge), pa.array(turns)], ["edge", "turns"]))
                key = [pa.array([batch.column(c)[i].as_py()] * len(n), batch.schema.field(c).type) for c in by]
                cols = [v.take(pa.array(cell[begin])), *map(pa.array, (edge[begin], n, edge[begin + shift], shift, behind, closed)), steps]
                yield pa.RecordBatch.from_arrays([*key, *cols], names)

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (*by, label)) + ", head long, n long, least long, shift long, next long, closed boolean, edges array<struct<edge:bigint,turns:boolean>>"
    return packed.mapInArrow(run, schema)


def rings(cells: DataFrame, by: Sequence[str], label: str = "label", at: tuple[str, str] = ("y", "x"), tile: int = TILE) -> DataFrame:
    """(by, label, y, x, side, ring, place, turns): each edge with its ring (its edge of least number), its place there from 0 and whether the outline turns where it starts. Coordinates are below 2^30."""
    y, x = at
    by = list(by)
    chains = written(_tile_chains(cells, by, label, at, tile), "chains")
    whole = chains.where("closed").select(*by, label, F.col("head").alias("ring"), F.lit(0).cast("long").alias("first"), "n", F.lit(None).cast("int").alias("side_before"), "edges")
    parts = chains.where("not closed")
    if not parts.isEmpty():
        found = _linked_chains(parts.select(*by, "head", "n", "least", "shift", "next", (F.element_at("edges", -1)["edge"] % 4).cast("int").alias("side")), by)
        whole = whole.unionByName(parts.drop("n").join(_met(found), [*by, "head"]).select(*whole.columns))
    out = whole.select(*by, label, "ring", "first", "n", "side_before", F.posexplode("edges").alias("i", "e"))
    e = F.col("e.edge")
    side = e.bitwiseAND(3).cast("int")
    turns = F.when((F.col("i") == 0) & F.col("side_before").isNotNull(), side != F.col("side_before")).otherwise(F.col("e.turns"))
    return out.select(*by, label, F.shiftright(e, 32).alias(y), F.shiftright(e, 2).bitwiseAND((1 << 30) - 1).alias(x), side.alias("side"), "ring", F.pmod(F.col("first") + F.col("i"), "n").alias("place"), turns.alias("turns"))


def _linked_chains(parts: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, head, ring, first, n, side_before): of each open chain its ring, the place there of its first edge, the ring's edges and the side before it."""
    e = written(parts, "open")
    # The least edge of each ring: every round doubles the stretch whose least one is known.
    now = written(e.select(*by, "head", F.col("next").alias("to"), F.col("least").alias("ring")), "chain")
    while True:
        ahead = now.select(*by, F.col("head").alias("to"), F.col("to").alias("far"), F.col("ring").alias("other"))
        new = written(now.join(_met(ahead), [*by, "to"]).select(*by, "head", F.col("far").alias("to"), F.least("ring", "other").alias("ring"), (F.col("other") < F.col("ring")).alias("moved")), "chain")
        moved = not new.where("moved").isEmpty()
        forget(now)
        now = new.drop("moved")
        now._written = new._written
        if not moved:
            break
    # Edges back to the first edge of the chain with the ring's least one, by jumps of doubling width that stop there.
    back = e.select(*by, F.col("next").alias("head"), F.col("head").alias("to"), F.col("n").alias("more"), F.col("side").alias("side_before"))
    each = written(e.drop("side").join(_met(now.select(*by, "head", "ring")), [*by, "head"]).drop("next").join(_met(back), [*by, "head"]).select(*by, "head", "ring", "n", "to", "more", "shift", "side_before", (F.col("least") == F.col("ring")).alias("origin")), "walk")
    forget(now, e)
    walk = each.select(*by, "head", F.when(F.col("origin"), F.col("head")).otherwise(F.col("to")).alias("to"), F.when(F.col("origin"), 0).otherwise(F.col("more")).cast("long").alias("first"), F.col("origin").alias("there"))
    while True:
        ahead = walk.select(*by, F.col("head").alias("to"), F.col("to").alias("far"), F.col("first").alias("more"), F.col("there").alias("at_origin"))
        new = written(walk.join(_met(ahead), [*by, "to"]).select(*by, "head", F.col("far").alias("to"), (F.col("first") + F.col("more")).alias("first"), (F.col("there") | F.col("at_origin")).alias("there")), "walk")
        forget(walk)
        walk = new
        if walk.where("not there").isEmpty():
            break
    total = each.groupBy(*by, "ring").agg(F.sum("n").alias("n"), F.max(F.when(F.col("origin"), F.col("shift"))).alias("shift"))
    out = each.select(*by, "head", "ring", "side_before").join(_met(walk.select(*by, "head", "first")), [*by, "head"]).join(_met(total), [*by, "ring"])
    return out.select(*by, "head", "ring", F.pmod(F.col("first") - F.col("shift"), "n").alias("first"), "n", "side_before")


def _corner(at: tuple[str, str], side: Column) -> list[Column]:
    pick = lambda k: reduce(lambda acc, s: F.when(side == s, SIDES[s][2][k]).otherwise(acc), range(3), F.lit(SIDES[3][2][k]))
    return [F.col(c) + pick(k) for k, c in enumerate(at)]


def polygons(chained: DataFrame, by: Sequence[str], label: str = "label", at: tuple[str, str] = ("y", "x")) -> DataFrame:
    """(by, label, ring, place, y, x): the corners of each ring in order, clockwise around an instance and counter-clockwise around a hole in it."""
    return chained.where("turns").select(*by, label, "ring", "place", *[c.alias(a) for c, a in zip(_corner(at, F.col("side")), at, strict=True)])


def measures(chained: DataFrame, by: Sequence[str], label: str = "label", at: tuple[str, str] = ("y", "x")) -> DataFrame:
    """(by, label, ring, area, length, corners, and the least and greatest corner of each axis): area below 0 is a hole's."""
    y, x = _corner(at, F.col("side"))
    to_y = F.when(F.col("side") == 1, y + 1).when(F.col("side") == 3, y - 1).otherwise(y)
    to_x = F.when(F.col("side") == 0, x + 1).when(F.col("side") == 2, x - 1).otherwise(x)
    rows = chained.select(*by, label, "ring", "turns", y.alias("cy"), x.alias("cx"), (x * to_y - to_x * y).alias("twice"))
    sums = [(F.sum("twice") / 2).alias("area"), F.count("*").alias("length"), F.sum(F.col("turns").cast("long")).alias("corners")]
    return rows.groupBy(*by, label, "ring").agg(*sums, *[f(c).alias(f"{n}_{a}") for c, a in (("cy", at[0]), ("cx", at[1])) for n, f in (("least", F.min), ("most", F.max))])
