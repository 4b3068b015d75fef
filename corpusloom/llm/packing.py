"""Problem 8: items into containers of fixed capacity with little room left over.

Items are spread over groups of bounded size. Each group is packed by best-fit decreasing and
gets a lower bound from dual feasible functions; a group that meets its bound is certified and
final. Groups with a gap keep their tightly filled containers, give the items of the others into
a pool, and the pool is dealt into new, mixed groups and packed again, for a fixed number of
rounds. An item over the capacity is divided into full pieces and a rest; nothing else is.

Defined results: an item of size 0 or of null size is placed as size 0; repeated rows are items
of their own; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

CAPACITY = 2048
GROUP_ITEMS = 20_000
ROUNDS = 3
TIGHT = 0.995


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Containers that no packing can do without: the best of the dual feasible functions
    u(k), which scales and rounds, and f(e), which lifts large items and drops items under e."""
    sizes = sizes[sizes > 0].astype(np.int64)
    if not len(sizes):
        return 0
    best = -(-int(sizes.sum()) // capacity)
    kinds, counts = np.unique(sizes, return_counts=True)
    for e in np.unique(np.concatenate([kinds[kinds * 2 <= capacity], [0, 1]])):
        value = np.where(kinds > capacity - e, capacity, np.where(kinds < e, 0, kinds))
        best = max(best, -(-int((value * counts).sum()) // capacity))
    for k in range(1, 21):
        scaled = (k + 1) * kinds
        value = np.where(scaled % capacity == 0, k * kinds, capacity * (scaled // capacity))  # in parts of k * capacity
        best = max(best, -(-int((value * counts).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """The container of each item, and how many there are. The fullest container that still takes an
    item is found in a bit set of the free room there is, so an item costs no search over containers."""
    order = np.argsort(-sizes, kind="stable")
    place = np.empty(len(sizes), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    there, made = 0, 0
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        fits = there >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            box = free[room].pop()
            if not free[room]:
                there &= ~(1 << room)
        else:
            room, box, made = capacity, made, made + 1
        place[i] = box
        free[room - size].append(box)
        there |= 1 << (room - size)
    return place, made


def _pack_group(capacity: int, last: bool):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        size = pdf["size"].to_numpy(np.int64)
        place, made = best_fit_decreasing(size, capacity)
        bound = max(lower_bound(size, capacity), int(len(size) > 0))
        filled = np.bincount(place, size, made)
        settled = np.full(made, last or made <= bound) | (filled >= TIGHT * capacity)
        return pd.DataFrame({"item": pdf["item"], "piece": pdf["piece"], "size": size, "grp": key[0], "box": place, "settled": settled[place], "bound": bound, "made": made})

    return run


def pieces(items: DataFrame, capacity: int) -> DataFrame:
    """(item, piece, size): one row for each item that fits, full pieces and a rest for one that doesn't."""
    n = F.greatest(F.lit(1), F.ceil(F.col("size") / capacity)).cast("int")
    cutting = items.withColumn("size", F.coalesce("size", F.lit(0)).cast("long")).withColumn("piece", F.explode(F.sequence(F.lit(1), n)))
    return cutting.withColumn("size", F.least(F.lit(capacity).cast("long"), F.col("size") - (F.col("piece") - 1) * capacity))


def pack(items: DataFrame, capacity: int = CAPACITY, group_items: int = GROUP_ITEMS, rounds: int = ROUNDS) -> DataFrame:
    """(item, piece, size, round, grp, box, bound, made) for ``items(item, size)``.

    A container is the triple (round, grp, box); ``bound`` and ``made`` are the certified lower bound and the
    number of containers of the group that packed it. Full pieces take a container each at once.
    """
    work = cut(pieces(items.select("item", "size"), capacity).withColumn("row", F.monotonically_increasing_id()))
    kind = work.schema["item"].dataType.simpleString()
    schema = f"item {kind}, piece int, size long, grp long, box long, settled boolean, bound long, made long"
    full = work.where(F.col("size") == capacity).select(
        "item", "piece", "size", F.lit(0).alias("round"), F.lit(-1).cast("long").alias("grp"), F.col("row").alias("box"), F.lit(None).cast("long").alias("bound"), F.lit(None).cast("long").alias("made")
    )
    done = [full]
    rest = work.where(F.col("size") < capacity)
    for turn in range(1, rounds + 1):
        count = rest.count()
        if not count:
            break
        groups = max(1, -(-count // group_items))
        dealt = rest.withColumn("g", F.pmod(F.xxhash64("row", F.lit(turn)), F.lit(groups)))
        last = turn == rounds
        packed = cut(dealt.groupBy("g").applyInPandas(_pack_group(capacity, last), schema))
        done.append(packed.where("settled").select("item", "piece", "size", F.lit(turn).alias("round"), "grp", "box", "bound", "made"))
        if last:
            break
        rest = packed.where(~F.col("settled")).select("item", "piece", "size", F.monotonically_increasing_id().alias("row"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def containers(packed: DataFrame) -> DataFrame:
    """(round, grp, box, n_items, used): one row for each container."""
    return packed.groupBy("round", "grp", "box").agg(F.count(F.lit(1)).alias("n_items"), F.sum("size").alias("used"))


__all__ = ["pack", "pieces", "containers", "lower_bound", "best_fit_decreasing", "Window"]
