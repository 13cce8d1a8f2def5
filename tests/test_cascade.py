import random
from collections import Counter

import pytest

from kvartal.operators.cascade import cascade


def by_hand(buildings, cells, zones, room):
    block = {z: b for z, b, *_ in zones}
    got, stages = Counter(), {b[0]: [] for b in buildings}

    def capped(pool, key_of, area):
        total, want = Counter(), {}
        for b in buildings:
            want[b[0]] = max(0, room * b[area] - got[b[0]]) if b[area] > 0 else 0
            if key_of(b) is not None:
                total[key_of(b)] += want[b[0]]
        left = Counter(pool)
        give = {}
        for b in buildings:
            k = key_of(b)
            give[b[0]] = min(pool[k], total[k]) * want[b[0]] // total[k] if k in pool and total[k] else 0
        for b in buildings:
            stages[b[0]].append(give[b[0]])
            got[b[0]] += give[b[0]]
            if give[b[0]]:
                left[key_of(b)] -= give[b[0]]
        return left

    def beyond(pool):
        left = Counter(pool)
        for k in {block.get(b[2]) for b in buildings}:
            own = sorted(b for b in buildings if block.get(b[2]) == k)
            total, upto = sum(b[3] + b[4] for b in own), 0
            for b in own:
                w = b[3] + b[4]
                give = pool[k] * (upto + w) // total - pool[k] * upto // total if k is not None and total and pool.get(k) else 0
                upto += w
                stages[b[0]].append(give)
                got[b[0]] += give
                left[k] -= give
        return left

    pool, zone_of = Counter(), {}
    for c, z, n in cells:
        pool[c] += n
        zone_of[c] = z
    pool = capped(capped(pool, lambda b: b[1], 3), lambda b: b[1], 4)
    wide, outside = Counter(), 0
    for c, n in pool.items():
        if zone_of[c] is None:
            outside += n
        else:
            wide[zone_of[c]] += n
    wide = capped(capped(wide, lambda b: b[2], 3), lambda b: b[2], 4)
    blocks = Counter()
    for z, n in wide.items():
        blocks[block[z]] += n
    at = lambda b: block.get(b[2])
    blocks = beyond(capped(capped(blocks, at, 3), at, 4))
    centre = {k: tuple(sum(z[4] * z[i] for z in zones if z[1] == k) // sum(z[4] for z in zones if z[1] == k) for i in (2, 3)) for k in set(block.values())}
    able = [k for k in centre if sum(b[3] + b[4] for b in buildings if at(b) == k)]
    moved, nowhere = Counter(), 0
    for k, n in blocks.items():
        if n > 0 and able:
            moved[min(able, key=lambda t: ((centre[k][0] - centre[t][0]) ** 2 + (centre[k][1] - centre[t][1]) ** 2, t))] += n
        elif n > 0:
            nowhere += n
    beyond(moved)
    return {(b, *s, sum(s)) for b, s in stages.items()}, {(r, n) for r, n in (("outside", outside), ("nowhere", nowhere)) if n}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_stages_match_a_walk(spark, seed):
    r = random.Random(seed)
    zones = [(z, z // 4, r.randrange(9000), r.randrange(9000), r.randint(1, 9)) for z in range(24)]
    buildings = [(i, r.choice([None, *range(30)]), r.choice([None, *range(12)]), *r.choice([(0, 0), (5, 0), (40, 0), (0, 7), (3, 3)])) for i in range(80)]
    if seed == 3:
        buildings = [(i, c, z, 0, 0) for i, c, z, _, _ in buildings]
    cells = [(c, None if c % 9 == 8 else r.randrange(24), r.choice([0, 30, 500])) for c in range(45)]
    rows, lost = cascade(
        spark.createDataFrame(buildings, "id long, cell long, zone long, known long, unknown long"), spark.createDataFrame(cells, "cell long, zone long, amount long"), spark.createDataFrame(zones, "zone long, block long, x long, y long, area long"), 2
    )
    want, want_lost = by_hand(buildings, cells, zones, 2)
    assert {tuple(x) for x in rows.collect()} == want and {tuple(x) for x in lost.collect()} == want_lost
    assert sum(x[-1] for x in want) + sum(n for _, n in want_lost) == sum(n for *_, n in cells)
    if seed < 3:
        assert all(any(x[k] for x in want) for k in range(1, 9))
