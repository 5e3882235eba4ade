"""Sharding by a hierarchical weighted hash tree of regions, racks and shards; DataFrame functions only.

A row descends from the root by one weighted draw a level: every child of the node that it has reached gets a clock
-ln(u) / weight, u a hash of the row's id and the child's name, and the child whose clock is least is taken. A child is
taken with a probability in proportion to its weight, and a change of weight moves rows only into or out of the subtrees
whose weights change.

A tree grows by openings. Whatever joins a node at a later opening draws with a clock of its own, and who follows that
clock stays within that opening further down. So a row that leaves its place for a region that has grown goes to the new
shard there, never to one of the region's older shards: one more shard takes rows only into itself, wherever it is put.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import running_total, stored

#: Shards of a rack, racks of a region, shards that are opened at once; any later one is an opening of its own.
RACK, REGION, BASE = 4, 2, 16
#: Rows of a shard that one task puts in order.
SLICE = 512


@dataclass(frozen=True)
class Shard:
    """A leaf of the tree; shards of one opening were put up together."""

    region: int
    rack: int
    number: int
    weight: float = 1.0
    opening: int = 0


def layout(shards: int, base: int = BASE) -> list[Shard]:
    """`shards` equal shards: the first `base` opened at once, each later one by itself in the first rack that has room."""
    return [Shard(n // (RACK * REGION), n // RACK % REGION, n, 1.0, max(0, n - base + 1)) for n in range(shards)]


class Tree:
    """The draws of a tree as arrays: of every node its children's names, numbers and weights, level by level."""

    def __init__(self, shards: list[Shard]):
        if not shards or any(s.weight <= 0 for s in shards) or len({s.number for s in shards}) < len(shards):
            raise ValueError("shards must have numbers of their own and weights above 0")
        # A node is a path and an opening; the root alone holds all openings.
        totals: dict[tuple, dict[tuple, float]] = defaultdict(lambda: defaultdict(float))
        for s in shards:
            path = ((), (s.region,), (s.region, s.rack), (s.region, s.rack, s.number))
            for depth in range(3):
                parent = (path[depth], s.opening if depth else None)
                totals[parent][path[depth + 1], s.opening] += s.weight
        self.levels: list[list[list[tuple[str, int, float]]]] = []
        nodes = [((), None)]
        for depth in range(3):
            children = [sorted(totals[n].items()) for n in nodes]
            after = [c for found in children for c, _ in found]
            number = {c: c[0][2] if depth == 2 else k for k, c in enumerate(after)}
            self.levels.append([[(f"{'.'.join(map(str, path))}@{opening}", number[path, opening], weight) for (path, opening), weight in found] for found in children])
            nodes = after

    def place(self, key: Column) -> Column:
        """The number of the shard of a key (a string)."""
        node: Column = F.lit(0)
        for level in self.levels:
            children = F.array(*[F.array(*[F.struct(F.lit(n).alias("name"), F.lit(k).alias("to"), F.lit(w).alias("weight")) for n, k, w in found]) for found in level])
            mine = children[0] if len(level) == 1 else F.element_at(children, node + 1)
            clocks = F.transform(mine, lambda c: F.struct((-F.log(uniform(key, c["name"])) / c["weight"]).alias("clock"), c["to"].alias("to")))
            node = F.array_min(clocks)["to"]
        return node.cast("int")


def uniform(key: Column, name: Column) -> Column:
    """A number between 0 and 1 from 48 bits of the MD5 of a key and a name."""
    return (F.conv(F.substring(F.md5(F.concat(name, F.lit(":"), key)), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def place_shards(docs: DataFrame, shards: list[Shard], grown: list[Shard] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, law, shard, slot, grown_shard for every row of docs.

    The law is `key`: the id and the tree decide. size: bytes of the text in UTF-8 plus 1. grown_shard is the shard in the
    tree `grown`, null without one. Slots number the rows of a shard from 0, in the order of a hash of id and text, so that rows of one
    id, or of none, are numbered by many tasks. Null texts
    count as empty; rows without an id all go where an empty id goes. Repeated rows and ids go to one shard, and each has a
    slot of its own; equal texts of different ids are placed apart. Whole texts are only measured where they are. Other
    columns are ignored, whatever their names; an empty table gives an empty result.
    """
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    placed = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        Tree(shards).place(key).alias("shard"),
        (Tree(grown).place(key) if grown else F.lit(None).cast("int")).alias("grown_shard"),
        F.conv(F.substring(F.md5(F.concat(key, F.lit(":"), F.crc32(text).cast("string"))), 1, 15), 16, 10).cast("long").alias("order"),
    )
    placed = stored(placed, "placed")
    slots = running_total(placed, ["shard"], [F.col("id"), F.col("size"), F.col("text_crc32")], F.col("order") * 4, F.lit(1), placed.count(), "slot", SLICE)
    return slots.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
