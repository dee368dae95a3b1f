import random

import pytest

from lexgraft.operators import quota


def plain(edges, base, limit):
    """One pass in order."""
    count, out, lost = dict(base), [], set()
    for owner, place, seq, symbol, target, needed in sorted(edges, key=lambda e: (e[1], e[0], e[2], e[3], e[4])):
        if owner in lost:
            continue
        if count.get(target, 0) >= limit:
            if needed:
                lost.add(owner)
            continue
        count[target] = count.get(target, 0) + 1
        out.append((owner, place, seq, symbol, target, needed))
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_room_is_given_as_one_pass_would(spark, seed):
    pick = random.Random(seed)
    edges = set()
    for owner in range(60):
        place = owner % 2
        if place == 0:
            edges.add((owner, 0, 0, "@", pick.randrange(6), True))
        for _ in range(pick.randrange(4)):
            edges.add((owner, place, 1, pick.choice("!&"), pick.randrange(8), False))
    base = {0: 3, 1: 9, 2: 1}
    df = spark.createDataFrame(sorted(edges), "owner long, place int, seq int, symbol string, target long, needed boolean")
    taken = spark.createDataFrame(list(base.items()), "target long, base long")
    got = sorted(tuple(r) for r in quota.allocate(df, taken, 9).collect())
    assert got == plain(edges, base, 9)
    assert len(got) < len(edges)
    assert quota.allocate(df.limit(0), taken, 9).count() == 0


def test_a_round_writes_where_targets_are_full_and_no_edge_again(spark, monkeypatch):
    pick, rows, real = random.Random(7), [], quota.kept
    edges = {(owner, 0, 0, "@", owner % 5, True) for owner in range(300)} | {(owner, 0, 1, pick.choice("!&"), pick.randrange(5), False) for owner in range(300)}
    df = spark.createDataFrame(sorted(edges), "owner long, place int, seq int, symbol string, target long, needed boolean")
    taken = spark.createDataFrame([(4, 30)], "target long, base long")
    monkeypatch.setattr(quota, "kept", lambda df: rows.append(df.count()) or real(df))
    assert sorted(tuple(r) for r in quota.allocate(df, taken, 20).collect()) == plain(edges, {4: 30}, 20)
    assert sum(n > 5 for n in rows) == 1 and len(rows) < 12  # the edges are written once, then five targets a round
