"""Items dealt to tasks by what they cost, not by their number.

One file of thousands of lines takes as long to parse as hundreds of small ones, so equal counts make unequal tasks. Dear items, those that cost
more than a ``FINE``-th of a task's share (at most ``FINE`` for each task, whatever the input), are placed one by one, dearest first,
each on the task that has least so far. All others fall into virtual slots by their key's hash; the slots are given to tasks in
proportion to the room that is left, so cheap items level what the dear ones leave.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts of a task's share from which an item is placed by itself; virtual slots for each task.
FINE, SLOTS = 64, 16


def levelled(dear: list[tuple], total: float, partitions: int) -> tuple[dict, list[int]]:
    """(partition of each dear item's key, partition of each slot) for (key, cost) rows out of a ``total`` cost."""
    loads = [(0.0, p) for p in range(partitions)]
    placed = {}
    for key, cost in sorted(dear, key=lambda r: (-r[1], str(r[0]))):
        load, p = heapq.heappop(loads)
        placed[key] = p
        heapq.heappush(loads, (load + cost, p))
    # each slot goes where least is, and brings an equal part of the cheap items' cost
    slots = partitions * SLOTS
    part, owner = max(total - sum(c for _, c in dear), 0.0) / slots, []
    for _ in range(slots):
        load, p = heapq.heappop(loads)
        owner.append(p)
        heapq.heappush(loads, (load + max(part, 1e-9), p))
    return placed, owner


def deal_by_cost(items: DataFrame, partitions: int, cost: Column, key: str = "pair_id") -> DataFrame:
    """``items`` in ``partitions`` partitions of near equal cost. ``cost`` is a number for each row (null: nothing), computed in a pass of its
    own before the deal; rows of one key stay together."""
    costs = items.select(F.col(key).alias("k"), F.coalesce(cost, F.lit(0)).cast("double").alias("c")).groupBy("k").agg(F.sum("c").alias("c"))
    total = items.agg(F.sum(F.coalesce(cost, F.lit(0)).cast("double"))).first()[0] or 0.0
    least = total / (partitions * FINE)
    dear = [(r["k"], r["c"]) for r in costs.where((F.col("c") > least) & F.col("k").isNotNull()).collect()]  # partitions * FINE at most
    placed, owner = levelled(dear, total, partitions)
    slot = F.pmod(F.xxhash64(key), F.lit(len(owner))).cast("int")
    cheap = F.get(F.split(F.lit(" ".join(map(str, owner))), " ").cast("array<int>"), slot)
    kind = items.schema[key].dataType.simpleString()
    table = items.sparkSession.createDataFrame(list(placed.items()), f"_dear {kind}, _placed int")
    marked = items.join(F.broadcast(table), F.col(key) == F.col("_dear"), "left")
    return marked.repartitionById(partitions, F.coalesce("_placed", cheap)).drop("_dear", "_placed")
