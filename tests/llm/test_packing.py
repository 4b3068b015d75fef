import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import packing as P


def least_bins(sizes, capacity):
    """Exact, for a few items, by search."""
    best = len(sizes)

    def put(i, room):
        nonlocal best
        if len(room) >= best:
            return
        if i == len(sizes):
            best = len(room)
            return
        for k in range(len(room)):
            if room[k] >= sizes[i]:
                room[k] -= sizes[i]
                put(i + 1, room)
                room[k] += sizes[i]
        room.append(capacity - sizes[i])
        put(i + 1, room)
        room.pop()

    put(0, [])
    return best


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=8))
def test_bound_never_exceeds_the_optimum_and_packing_is_valid(sizes):
    sizes = sorted(sizes, reverse=True)
    place, made = P.best_fit_decreasing(np.array(sizes, np.int64), 20)
    assert P.lower_bound(np.array(sizes), 20) <= least_bins(sizes, 20) <= made
    assert (np.bincount(place, sizes, made) <= 20).all() if sizes else made == 0


def check(items, packed, capacity):
    per, used, boxes = {}, {}, {}
    for r in packed:
        per[r.item] = per.get(r.item, 0) + r.size
        box = (r.round, r.grp, r.box)
        used[box] = used.get(box, 0) + r.size
        boxes.setdefault(r.item, []).append(r.size)
    assert max(used.values(), default=0) <= capacity
    total = {}
    for i, s in items:
        total[i] = total.get(i, 0) + (s or 0)
    assert per == total
    return used


def test_items_over_the_capacity_nulls_ties_and_repeated_rows(spark):
    items = [(1, 250), (2, None), (3, 0), (4, 100), (5, 99), (5, 99), (6, 1), (7, 50), (8, 50), (None, 3)]
    df = spark.createDataFrame([(*r, 9) for r in items], "item long, size long, grp long")
    packed = P.pack(df, capacity=100).collect()
    used = check(items, packed, 100)
    assert sorted(r.size for r in packed if r.item == 1) == [50, 100, 100]
    assert len(used) <= -(-sum(s or 0 for _, s in items) // 100) + 1
    assert P.pack(df.limit(0), capacity=100).count() == 0


def test_many_groups_exchange_and_leave_little_room(spark):
    rng = np.random.default_rng(1)
    items = [(i, int(s)) for i, s in enumerate(rng.integers(1, 900, 3000))]
    packed = P.pack(spark.createDataFrame(items, "item long, size long"), capacity=1000, group_items=400).collect()
    used = check(items, packed, 1000)
    assert len(used) <= 1.02 * -(-sum(s for _, s in items) // 1000)
    assert all(r.bound <= r.made for r in packed if r.bound is not None)
