import heapq
import random

import pytest

from stemline.llm.mixing import Mix, sainte_lague


def one_by_one(seats, shares, caps):
    got = [0] * len(shares)
    heap = [(-w, i) for i, w in enumerate(shares) if w > 0 and caps[i]]
    heapq.heapify(heap)
    while seats and heap:
        _, i = heapq.heappop(heap)
        got[i] += 1
        seats -= 1
        if got[i] < caps[i]:
            heapq.heappush(heap, (-shares[i] / (2 * got[i] + 1), i))
    return got


@pytest.mark.parametrize("seed", range(20))
def test_highest_quotients(seed):
    rnd = random.Random(seed)
    shares = [rnd.choice([0.0, 0.1, 0.25, rnd.random()]) for _ in range(7)]
    caps = [rnd.choice([0, 3, 50, 1000]) for _ in shares]
    seats = rnd.randrange(400)
    a, b = sainte_lague(seats, shares, caps), one_by_one(seats, shares, caps)
    assert sum(a) == sum(b) and all(x <= c for x, c in zip(a, caps))
    # equal quotients may go to either source
    assert sorted(w / (2 * g + 1) for w, g in zip(shares, a)) == pytest.approx(sorted(w / (2 * g + 1) for w, g in zip(shares, b)))


def docs(spark, n=600):
    rnd = random.Random(2)
    rows = [(i, " ".join(["word"] * rnd.randrange(0, 120)), rnd.choice(["a", "a", "a", "b", "c", "z", None]), "x") for i in range(n)] + [(n, None, "a", "x"), (n + 1, "", "b", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, block string")


TARGETS = [("a", 0.3, 1), ("b", 0.5, 4), ("c", 0.2, 1), ("none", 0.1, 3), ("c", 0.2, 1), (None, 0.5, 1)]


def test_shares_caps_and_shards(spark):
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    mix = Mix(docs(spark), targets, block=64, shards=4)
    rows, report = mix.rows().collect(), {r.source: r for r in mix.report().collect()}
    total = mix.total
    assert set(report) == {"a", "b", "c", "none"} and report["none"].drawn_tokens == 0
    keys = [(r.doc_id, r.copy) for r in rows]
    assert len(keys) == len(set(keys))
    cap = {"a": 1, "b": 4, "c": 1}
    assert all(r.copy < cap[r.source] for r in rows)
    assert abs(sum(r.n_tokens for r in rows) - total) < 3 * 240
    assert report["c"].capped and report["c"].drawn_tokens == report["c"].available_tokens
    # what c cannot give goes to a and b by their shares
    rest = total - report["c"].drawn_tokens
    assert abs(report["a"].drawn_tokens - rest * 0.3 / 0.8) < 300
    by_shard = [sum(r.n_tokens for r in rows if r.shard == s) for s in range(4)]
    assert max(by_shard) - min(by_shard) < 700


def test_seeds_and_empty_tables(spark):
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    d = docs(spark, 100)
    first, again, other = (sorted(map(tuple, Mix(d, targets, seed=s, block=64).rows().collect())) for s in (1, 1, 2))
    assert first == again != other
    assert Mix(d.limit(0), targets).rows().count() == 0
    assert Mix(d, targets.limit(0)).rows().count() == 0
    assert Mix(d.limit(0), targets).report().count() == 4
