"""Shard assignment by a hierarchical weighted hash tree (operator 1).

A row descends region, rack and shard levels. At each level every child draws an exponential number
from the hash of the row's key and the child's name, divided by the child's weight (the sum of the
weights below it); the smallest draw wins. A child's chance is its share of the weight, and a change
of one child's weight changes only that child's draws: rows move into a subtree that gained weight or
out of one that lost it, never between the others.

Defined cases: a null key is a key of its own (the empty text); repeated keys share a shard; shards of
weight null, zero or less take nothing; a null text has no bytes and CRC 0; an empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.functions.expr import let
from postmill.llm.common import text_crc32, uniform, uniform_sql
from postmill.session import stage


class Shard(NamedTuple):
    region: int
    rack: int
    shard: int
    weight: float | None = 1.0


#: Shards of the first tree and its fan-out; later shards come in regions of their own.
FIRST_SHARDS, RACKS, SHARDS_PER_RACK = 16, 2, 2


def tree_for(shards: int, weight: float = 1.0) -> list[Shard]:
    """The tree of so many equal shards: the first 16 in four regions of two racks, each later one in a
    region of its own. A region that is added takes rows only into itself, so ``tree_for(n + 1)`` moves
    rows of ``tree_for(n)`` into shard ``n`` alone, for every n from 16 on."""
    per_region = RACKS * SHARDS_PER_RACK
    own = FIRST_SHARDS // per_region
    return [
        Shard(s // per_region, s // SHARDS_PER_RACK, s, weight)
        if s < FIRST_SHARDS
        else Shard(own + s - FIRST_SHARDS, FIRST_SHARDS // SHARDS_PER_RACK + s - FIRST_SHARDS, s, weight)
        for s in range(shards)
    ]


def _level(tree: Sequence[Shard], parent: str | None, child: str) -> dict[int, dict[int, float]]:
    """Children of each parent with the weight below them."""
    out: dict[int, dict[int, float]] = defaultdict(lambda: defaultdict(float))
    for s in tree:
        if s.weight is not None and s.weight > 0:
            out[getattr(s, parent) if parent else 0][getattr(s, child)] += float(s.weight)
    return out


def _descend(key: Column, level: str, at: Column, children: dict[int, dict[int, float]]) -> Column:
    """The child of ``at`` with the smallest draw; equal draws go to the smaller child."""

    def best(below: dict[int, float]) -> Column:
        options = F.array(*[F.struct(F.lit(c).alias("id"), F.lit(w).alias("w")) for c, w in sorted(below.items())])
        draws = F.transform(
            options, lambda o: F.struct((-F.log(uniform(F.lit(level), o["id"], key)) / o["w"]).alias("draw"), o["id"].alias("id"))
        )
        return F.array_min(draws)["id"]

    parents = sorted(children)
    if len(parents) == 1:
        return best(children[parents[0]])
    # The options are looked up first, so that only the children of one parent draw.
    table = F.create_map(*[
        x for p in parents for x in (
            F.lit(p),
            F.array(*[F.struct(F.lit(c).alias("id"), F.lit(w).alias("w")) for c, w in sorted(children[p].items())]),
        )
    ])
    draws = F.transform(
        F.element_at(table, at),
        lambda o: F.struct((-F.log(uniform(F.lit(level), o["id"], key)) / o["w"]).alias("draw"), o["id"].alias("id")),
    )
    return F.array_min(draws)["id"]


def place(key: Column, tree: Sequence[Shard]) -> Column:
    """Shard of a key in the tree, as one column expression (no join, no shuffle). The tree is a
    parameter as small as the storage it names. Null if no shard has weight."""
    regions = _level(tree, None, "region")
    if not regions:
        return F.lit(None).cast("int")
    return let(
        _descend(key, "region", F.lit(0), regions),
        lambda region: let(
            _descend(key, "rack", region, _level(tree, "region", "rack")),
            lambda rack: _descend(key, "shard", rack, _level(tree, "rack", "shard")),
        ),
    )


def with_slots(rows: DataFrame, shard: str = "shard", order: str = "doc_id", slot: str = "slot") -> DataFrame:
    """Adds the place of each row within its shard, gapless from 0, in the order of ``order``.

    No window holds a shard. The rows are dealt by ranges of (shard, order, row) and sorted, each range
    counts its rows per shard, and a row's slot is its place in its range plus the rows of the shard in
    earlier ranges, from a table of at most ranges + shards rows. The row's own number is the last range
    key, so rows that repeat one key are spread as well. Both tables are written: a lost executor can't
    change what was numbered.
    """
    numbered = stage(rows.withColumn("_row", F.monotonically_increasing_id()), "shard-rows")
    ranged = (
        numbered.repartitionByRange(shard, order, "_row")
        .sortWithinPartitions(shard, order, "_row")
        .withColumn("_at", F.monotonically_increasing_id())
    )
    ranged = stage(ranged.withColumn("_range", F.shiftright("_at", 33)), "shard-ranges")
    blocks = ranged.groupBy(shard, "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(shard).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    return (
        ranged.join(blocks.withColumnRenamed(shard, "_shard"), (F.col(shard).eqNullSafe(F.col("_shard"))) & (ranged["_range"] == blocks["_range"]))
        .withColumn(slot, F.col("_at") - F.col("_first") + F.col("_before"))
        .select(*rows.columns, slot)
    )


def assign_shards(docs: DataFrame, tree: Sequence[Shard], grown: Sequence[Shard], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, size in bytes plus 1, CRC, shard and slot of every row, and its shard in a grown tree. Other
    columns are left out. See the head of the module for nulls, ties and empty tables."""
    rows = docs.select(
        F.col(key),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        text_crc32(F.col(text)).alias("text_crc32"),
        place(F.col(key), tree).alias("shard"),
        place(F.col(key), grown).alias("grown_shard"),
    )
    return with_slots(rows, "shard", key)


def _place_sql(tree: Sequence[Shard], out: str) -> str:
    """Common table expressions in the oracle dialect that end in ``out`` (doc_id, shard)."""
    rows = ", ".join(f"({s.region}, {s.rack}, {s.shard}, {float(s.weight)})" for s in tree)
    parts, chosen = [f"{out}_tree AS (SELECT * FROM (VALUES {rows}) t(region, rack, shard, w))"], "documents"
    for level, parent in (("region", None), ("rack", "region"), ("shard", "rack")):
        above = f", {parent}" if parent else ""
        draw = uniform_sql(f"concat_ws(':', '{level}', c.{level}, coalesce(d.doc_id::VARCHAR, ''))")
        on = f"ON d.{parent} = c.{parent}" if parent else "ON TRUE"
        name = out if level == "shard" else f"{out}_{level}"
        parts.append(
            f"{name} AS (SELECT doc_id, {level} FROM (SELECT d.doc_id, c.{level}, row_number() OVER (PARTITION BY d.doc_id ORDER BY"
            f" -ln({draw}) / c.w, c.{level}) AS k FROM {chosen} d JOIN"
            f" (SELECT {level}{above}, sum(w) AS w FROM {out}_tree GROUP BY {level}{above}) c {on}) WHERE k = 1)"
        )
        chosen = name
    return ",\n".join(parts)


def shards_sql(tree: Sequence[Shard], grown: Sequence[Shard]) -> str:
    """The sharding query in the oracle dialect, the CRC-32 by its bytewise rule."""
    return f"""
WITH RECURSIVE steps AS (
  SELECT n::BIGINT AS n, n::BIGINT AS v, 0 AS k FROM range(256) r(n)
  UNION ALL SELECT n, CASE WHEN v & 1 = 1 THEN xor(3988292384, v >> 1) ELSE v >> 1 END, k + 1 FROM steps WHERE k < 8),
rule AS (SELECT list(v ORDER BY n) AS l FROM steps WHERE k = 8),
octets AS (
  SELECT doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS b
  FROM documents),
sums AS (
  SELECT doc_id, len(b) + 1 AS size,
    xor(4294967295, list_reduce(b, lambda c, x: xor(c >> 8, l[(xor(c, x) & 255) + 1]), 4294967295::BIGINT)) AS text_crc32
  FROM octets, rule),
{_place_sql(tree, 'placed')},
{_place_sql(grown, 'regrown')}
SELECT s.doc_id, s.size::BIGINT AS size, s.text_crc32::BIGINT AS text_crc32, 'key' AS law, p.shard::INTEGER AS shard,
  row_number() OVER (PARTITION BY p.shard ORDER BY s.doc_id) - 1 AS slot, g.shard::INTEGER AS grown_shard
FROM sums s JOIN placed p USING (doc_id) JOIN regrown g USING (doc_id)
"""
