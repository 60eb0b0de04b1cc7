"""A cache under a cap, replayed by reuse distances, against one that goes through the log step by step."""

import random
from collections import OrderedDict
from datetime import datetime, timedelta, timezone

import pytest

from wardline.operators import cache


def _log(n, seed, hot=3):
    rng, t0 = random.Random(seed), datetime(2024, 1, 1, tzinfo=timezone.utc)
    times = sorted(rng.randrange(n) for _ in range(n))  # some are equal
    return [(f"t{rng.randrange(2)}", "hot" if rng.randrange(hot) == 0 else f"k{min(rng.randrange(40), rng.randrange(40))}", t0 + timedelta(seconds=t), i) for i, t in enumerate(times)]


def _steps(rows, cap):
    held, kinds, evicted = {}, {}, 0
    for partition, key, _, event in sorted(rows, key=lambda r: (r[2], r[3])):
        own = held.setdefault(partition, OrderedDict())
        kinds[event] = "exact" if key in own else "miss"
        own[key] = None
        own.move_to_end(key)
        if len(own) > cap:
            own.popitem(last=False)
            evicted += 1
    return kinds, evicted, sum(map(len, held.values()))


@pytest.mark.parametrize("cap,block", [(1, 7), (5, 50), (12, 1 << 16)])
def test_replay_equals_a_cache_step_by_step(spark, cap, block):
    rows = _log(400, cap)
    replay = cache.capped_replay(spark.createDataFrame(rows, "partition string, key string, ts timestamp, event_id long"), cap, block)
    kinds, evicted, entries = _steps(rows, cap)
    assert {r.event_id: r.kind for r in replay.collect()} == kinds
    told = cache.replay_statistics(replay, cap).collect()
    assert (sum(r.evictions for r in told), sum(r.entries for r in told)) == (evicted, entries)
    assert all(r.lookups == r.exact_hits + r.misses and r.stores == r.misses for r in told)


def test_without_a_cap_only_first_uses_miss(spark):
    rows = _log(120, 9)
    got = cache.capped_replay(spark.createDataFrame(rows, "partition string, key string, ts timestamp, event_id long"), 0, 16).collect()
    assert sum(r.kind == "miss" for r in got) == len({r[:2] for r in rows})


def test_an_empty_log(spark):
    assert cache.reuse_distances(spark.createDataFrame([], "partition string, key string, ts timestamp, event_id long")).count() == 0
