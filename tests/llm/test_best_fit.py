"""Best fit under conflicts against a search of all bins."""

import random

import pytest

from perimeter.llm.packing import best_fit


def brute_force(sizes, slots, clusters, capacity):
    """Every piece tries all bins: the tightest without its slot and cluster, the older one of equal bins."""
    bins, where, offsets = [], [], []
    for size, slot, cluster in zip(sizes, slots, clusters):
        fits = [(b["left"], i) for i, b in enumerate(bins) if b["left"] >= size and (slot < 0 or slot not in b["slots"]) and (cluster < 0 or cluster not in b["clusters"])]
        if not fits:
            bins.append({"left": capacity, "slots": set(), "clusters": set()})
            fits = [(capacity, len(bins) - 1)]
        _, i = min(fits)
        where.append(i)
        offsets.append(capacity - bins[i]["left"])
        bins[i]["left"] -= size
        bins[i]["slots"].add(slot)
        bins[i]["clusters"].add(cluster)
    return where, offsets


@pytest.mark.parametrize("seed", range(40))
def test_equals_brute_force(seed):
    rng = random.Random(seed)
    capacity, n = rng.choice([7, 50, 2048]), rng.randint(0, 400)
    sizes = sorted((rng.randint(1, capacity) if rng.random() < 0.3 else rng.randint(1, max(1, capacity // 5)) for _ in range(n)), reverse=True)
    # From no conflicts to a few slots and clusters that hold most pieces; equal sizes and equal residuals are frequent.
    slots = [rng.randint(-1, rng.choice([0, 3, 90])) for _ in range(n)]
    clusters = [-1 if rng.random() < 0.5 else rng.randint(0, 12) for _ in range(n)]
    assert best_fit(sizes, slots, clusters, capacity) == brute_force(sizes, slots, clusters, capacity)
