"""Resharding by minimum-cost flow.

The state is a layout of rows over old shards.  Every old shard is ordered by a hash of the text,
then of the id, so equal texts lie together; block sums of that order (old shard, hash bucket) are
the only sizes gathered.  On the graph of old and new shards, whose size is the number of shards
and not of rows, the minimum-cost flow from the old sizes to the new capacities says how many
bytes go from each old shard to each new one; a byte that stays costs nothing.  A flow is a
stretch of the old shard's order.  A group of equal texts goes whole to the shard that its middle
falls into, as long as it holds at most ``tolerance`` of a new shard; a larger group is cut into units
by a hash of the id, and each unit goes by its own middle.  Only shards that give or get rows are rewritten.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, drop

BUCKETS = 4096
#: Units of a group of equal texts: what one task numbers at a time.
UNITS = 4096
#: Rows of a written file, and copies of one row that a task writes out at a time.
PER_FILE, PER_TASK = 50_000, 1_000_000


def row_size(text: Column) -> Column:
    """UTF-8 bytes of a text (null: none) plus 8."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8


def min_cost_flow(supply: list[int], demand: list[int], cost) -> list[dict[int, int]]:
    """Bytes from each old to each new shard at the least total ``cost(i, j)`` a byte.

    Successive shortest paths with potentials over the bipartite shard graph; supply and demand
    have equal sums.  Ties go to lower shard numbers, so reruns agree.
    """
    n, m = len(supply), len(demand)
    flow: list[dict[int, int]] = [{} for _ in range(n)]
    left, room = list(supply), list(demand)
    up, down = [0.0] * n, [0.0] * m
    while any(left):
        best: dict[tuple[int, int], float] = {}
        came: dict[tuple[int, int], tuple[int, int]] = {}
        heap = [(0.0, (0, i)) for i in range(n) if left[i]]
        for d, at in heap:
            best[at] = d
        done: set[tuple[int, int]] = set()
        end = None
        while heap:
            d, at = heapq.heappop(heap)
            if at in done:
                continue
            done.add(at)
            side, k = at
            if side and room[k]:
                end = at
                break
            if side:
                steps = [((0, i), -cost(i, k) + down[k] - up[i]) for i in range(n) if flow[i].get(k)]
            else:
                steps = [((1, j), cost(k, j) + up[k] - down[j]) for j in range(m)]
            for to, extra in steps:
                if to not in done and d + extra < best.get(to, float("inf")):
                    best[to] = d + extra
                    came[to] = at
                    heapq.heappush(heap, (d + extra, to))
        reach = best[end]
        for (side, k), d in best.items():
            if side:
                down[k] += min(d, reach)
            else:
                up[k] += min(d, reach)
        for k in range(n):
            if (0, k) not in best:
                up[k] += reach
        for k in range(m):
            if (1, k) not in best:
                down[k] += reach
        path = [end]
        while path[-1] in came:
            path.append(came[path[-1]])
        path.reverse()
        most = min(left[path[0][1]], room[end[1]])
        for a, b in zip(path, path[1:]):
            if a[0]:
                most = min(most, flow[b[1]][a[1]])
        for a, b in zip(path, path[1:]):
            if a[0]:
                flow[b[1]][a[1]] -= most
            else:
                flow[a[1]][b[1]] = flow[a[1]].get(b[1], 0) + most
        left[path[0][1]] -= most
        room[end[1]] -= most
    return [{j: f for j, f in sorted(row.items()) if f} for row in flow]


def hash_layout(key: Column, shards: int) -> Column:
    """An old layout for tables that carry none: a hash of ``key`` modulo the number of shards."""
    return F.pmod(F.xxhash64(F.coalesce(key.cast("string"), F.lit(""))), F.lit(shards)).cast("int")


def _keyed(docs: DataFrame, old_shard: Column, id_col: str, text_col: str) -> list[Column]:
    text = F.col(text_col)
    return [
        F.coalesce(old_shard, F.lit(0)).cast("int").alias("old_shard"),
        F.xxhash64(F.lit(7), text).alias("t"),
        F.col(id_col).alias("doc_id"),
        row_size(text).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
    ]


ROW = ["old_shard", "t", "doc_id", "size", "text_crc32"]
BLOCK = ["old_shard", "bucket"]


def _placed(docs: DataFrame, old_shard: Column, new_shards: int, id_col: str, text_col: str, cost, tolerance: float) -> DataFrame:
    """(old_shard, t, doc_id, size, text_crc32, n, shard, slot): the first slot of the ``n`` rows that are alike."""
    # rows alike in id and text are one line with a count, so no repeated row makes a hot task
    alike = docs.select(*_keyed(docs, old_shard, id_col, text_col)).groupBy(*ROW).agg(F.count("*").alias("n"))
    bucket = F.pmod(F.shiftright("t", 40), F.lit(BUCKETS)).cast("int").alias("bucket")
    unit = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(UNITS)).cast("int").alias("unit")
    rows = cut(alike.select(*ROW, "n", bucket, unit), "reshard-rows")
    units = rows.groupBy(*BLOCK, "t", "unit").agg(F.sum(F.col("n") * F.col("size")).alias("mass"), F.sum("n").alias("c"))
    all_units = units = cut(units, "reshard-units")
    blocks = cut(units.groupBy(*BLOCK).agg(F.sum("mass").alias("mass")), "reshard-blocks")
    olds = blocks.groupBy("old_shard").agg(F.sum("mass").alias("mass")).orderBy("old_shard").collect()  # a row a shard
    supply = {r["old_shard"]: r["mass"] for r in olds}
    total = sum(supply.values())
    demand = [total * (j + 1) // new_shards - total * j // new_shards for j in range(new_shards)]
    known = sorted(supply)
    flows = min_cost_flow([supply[i] for i in known], demand, lambda i, j: cost(known[i], j))
    ends = []
    for i, row in zip(known, flows):
        at = 0
        for j in sorted(row, key=lambda j: (j != i, j)):
            ends.append((i, at, at + row[j], j))
            at += row[j]
    plan = _plan(ends)
    ahead = Window.partitionBy("old_shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.withColumn("start", F.coalesce(F.sum("mass").over(ahead), F.lit(0))).select(*BLOCK, "start")
    inside = Window.partitionBy(*BLOCK).orderBy("t", "unit").rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy(*BLOCK, "t")
    before = F.coalesce(F.sum("mass").over(inside), F.lit(0))
    units = units.withColumn("before", before).withColumn("held", F.sum("mass").over(group)).withColumn("first", F.min("before").over(group))
    whole = F.col("held") <= F.lit(tolerance * total / new_shards)
    middle = F.when(whole, F.col("first") + F.col("held") / 2).otherwise(F.col("before") + F.col("mass") / 2)
    units = units.join(starts, BLOCK).withColumn("middle", F.col("start") + middle).withColumn("shard", plan)
    summed, units = all_units, cut(units.select(*BLOCK, "t", "unit", "c", "shard"), "reshard-placed")
    placed = units
    drop(summed)
    counts = units.groupBy("shard", *BLOCK).agg(F.sum("c").alias("c"))
    above = Window.partitionBy("shard").orderBy(*BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("offset", F.coalesce(F.sum("c").over(above), F.lit(0))).drop("c")
    within = Window.partitionBy("shard", *BLOCK).orderBy("t", "unit").rowsBetween(Window.unboundedPreceding, -1)
    units = units.withColumn("at", F.coalesce(F.sum("c").over(within), F.lit(0))).join(offsets, ["shard", *BLOCK])
    units = units.select(*BLOCK, "t", "unit", "shard", (F.col("at") + F.col("offset")).alias("at"))
    line = Window.partitionBy(*BLOCK, "t", "unit").orderBy("doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(units, [*BLOCK, "t", "unit"]).withColumn("slot", F.col("at") + F.coalesce(F.sum("n").over(line), F.lit(0)))
    out = cut(out.select(*ROW, "n", "shard", "slot"), "reshard-lines")
    for done in (rows, placed, blocks):
        drop(done)
    return out


def reshard(
    docs: DataFrame,
    old_shard: Column,
    new_shards: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    cost=lambda i, j: 0 if i == j else 1,
    tolerance: float = 0.005,
) -> DataFrame:
    """(doc_id, size, text_crc32, old_shard, shard, slot), one row for each row of ``docs``.

    New capacities are equal; shard sizes differ by about a row or ``tolerance`` of a shard, and equal texts
    of one old shard stay together unless they hold more than that.  Slots are gapless from 0 in
    each shard.  Null texts count 8 bytes and have CRC 0; rows that repeat an id keep rows
    of their own, null ids likewise.  The old shard numbers are few and known; a null old shard is read as 0.
    """
    lines = _placed(docs, old_shard, new_shards, id_col, text_col, cost, tolerance)
    cols = ["doc_id", "size", "text_crc32", "old_shard", "shard"]
    few = lines.where(F.col("n") <= PER_TASK).select(*cols, F.explode(F.sequence("slot", F.col("slot") + F.col("n") - 1)).alias("slot"))
    parts = F.explode(F.sequence("slot", F.col("slot") + F.col("n") - 1, F.lit(PER_TASK)))
    many = lines.where(F.col("n") > PER_TASK).select(*cols, (F.col("slot") + F.col("n")).alias("end"), parts.alias("from")).repartition("shard", "from")
    each = F.explode(F.sequence("from", F.least(F.col("from") + PER_TASK, F.col("end")) - 1))
    return few.union(many.select(*cols, each.alias("slot")))


def _plan(ends: list[tuple[int, int, int, int]]) -> Column:
    """The new shard of a row from its old shard and its middle's place in the old shard's order."""
    out = None
    for i in sorted({e[0] for e in ends}):
        mine = [e for e in ends if e[0] == i]
        to = None
        for _, _, stop, j in mine[:-1]:
            to = F.when(F.col("middle") < stop, j) if to is None else to.when(F.col("middle") < stop, j)
        to = F.lit(mine[-1][3]) if to is None else to.otherwise(mine[-1][3])
        out = F.when(F.col("old_shard") == i, to) if out is None else out.when(F.col("old_shard") == i, to)
    return (F.lit(0) if out is None else out).cast("int")


def _numbered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with ``copy``, a number from 0 among the rows of a key: each partition of the join that made them numbers
    its own, which AQE splits where a key is large, and their counts are added up."""
    rows = cut(rows.withColumn("part", F.spark_partition_id()), "reshard-copies")
    names = [f"k{n}" for n in range(len(keys))]
    counts = rows.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col("part").alias("p")).agg(F.count("*").alias("c"))
    ahead = Window.partitionBy(*names).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    counts = counts.withColumn("ahead", F.coalesce(F.sum("c").over(ahead), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy(*keys, "part").orderBy(F.lit(0))) - 1
    same = F.col("part") == F.col("p")
    for k, n in zip(keys, names):
        same &= F.col(k).eqNullSafe(F.col(n))
    return rows.withColumn("inside", inside).join(counts, same).withColumn("copy", F.col("ahead") + F.col("inside"))


def rewrite_affected(
    docs: DataFrame,
    old_shard: Column,
    new_shards: int,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    cost=lambda i, j: 0 if i == j else 1,
    tolerance: float = 0.005,
    has_files: bool = True,
) -> list[int]:
    """Place ``docs`` as ``reshard`` does and write the new files of the shards that give or get rows.

    The files of other shards stay as they are; with ``has_files=False``, for an old layout that is only a rule, there
    are none yet and every shard is written.

    Files go to ``path/shard=N`` in slot order with all columns of ``docs`` and a column ``slot``; a shard
    is several files, none of much over ``PER_FILE`` rows.  Returns the numbers of the written shards.  Null and repeated ids keep all their rows.  Columns of
    ``docs`` that are called shard or slot are replaced.
    """
    lines = _placed(docs, old_shard, new_shards, id_col, text_col, cost, tolerance)
    moved = lines.where("old_shard <> shard").select(F.explode(F.array("old_shard", "shard")).alias("k")).distinct()
    touched = sorted(r["k"] for r in moved.collect() if r["k"] < new_shards) if has_files else list(range(new_shards))  # shard numbers
    names = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    new = lines.where(F.col("shard").isin(touched))
    keys = [F.struct(*_keyed(docs, old_shard, id_col, text_col)).alias("key")]
    rows = docs.select(*keys, F.struct(*[docs[c] for c in names]).alias("row"))
    same = [F.col(f"key.{c}").eqNullSafe(F.col(c)) for c in ROW]
    both = rows.join(new, same[1] & same[0] & same[2] & same[3] & same[4])
    single = both.where("n = 1").select("row", "shard", "slot")
    again = _numbered(both.where("n > 1"), [f"key.{c}" for c in ROW]).select("row", "shard", (F.col("slot") + F.col("copy")).alias("slot"))
    piece = F.floor(F.col("slot") / PER_FILE)
    out = single.union(again).repartition("shard", piece).sortWithinPartitions("shard", "slot")
    out.select("row.*", "slot", "shard").write.mode("overwrite").option("compression", "zstd").partitionBy("shard").parquet(path)
    return touched
