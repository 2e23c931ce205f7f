"""Goldens of small functions, and validity of covers."""

import itertools
import math
import random

import pytest

from bitloom.operators import boolean as B


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def minterms(spark, **functions):
    return spark.createDataFrame([(f, m) for f, ms in functions.items() for m in ms], "fn string, minterm int")


@pytest.fixture(scope="module")
def small(spark):
    return minterms(spark, xor2=[1, 2], f3=[0, 1, 3, 4, 5], adv3=[1, 2, 4, 5], maj3=[3, 5, 6, 7])


def test_primes(spark, small):
    got = rows(B.primes(small, 3), "fn", "mask", "value")
    assert [x[1:] for x in got if x[0] == "maj3"] == [(3, 3), (5, 5), (6, 6)]
    assert {x[1:] for x in got if x[0] == "f3"} >= {(2, 0), (5, 1)}
    assert {x[1:] for x in got if x[0] == "adv3"} == {(3, 1), (6, 4), (7, 2)}


def test_implicants_agree_with_cube(small):
    assert rows(B.implicants(small, 3), "fn", "mask", "value") == rows(B.cube_implicants(small, 3), "fn", "mask", "value")


def test_dont_cares_shorten(spark):
    allowed = minterms(spark, f4=[1, 3, 7, 11, 15, 0, 2, 5], all2=[0, 1, 2, 3])
    got = rows(B.primes(allowed.where("fn = 'f4'"), 4), "mask", "value")
    assert got == [(3, 3), (9, 1), (12, 0)]
    assert rows(B.primes(allowed.where("fn = 'all2'"), 2), "mask", "value") == [(0, 0)]


def test_covers_of_small_functions(spark, small):
    none = small.where("false")
    got = rows(B.minimise(small, none, 3), "fn", "mask", "value")
    assert [x[1:] for x in got if x[0] == "f3"] == [(2, 0), (5, 1)]
    assert len([x for x in got if x[0] == "maj3"]) == 3
    covered = {(r["fn"], r["minterm"]) for r in B.chart(B.minimise(small, none, 3), small).collect()}
    assert covered == {(r["fn"], r["minterm"]) for r in small.collect()}
    on, dc = minterms(spark, f4=[1, 3, 7, 11, 15]), minterms(spark, f4=[0, 2, 5])
    exact = rows(B.minimum_cover(B.primes(on.union(dc), 4), on), "mask", "value")
    assert len(exact) == 2 and sum(m.bit_count() for m, _ in exact) == 4
    assert rows(B.minimum_cover(B.primes(small, 3), small).groupBy("fn").count(), "fn", "count") == [("adv3", 3), ("f3", 2), ("maj3", 3), ("xor2", 2)]
    with pytest.raises(ValueError, match="no cube covers"):
        B.minimum_cover(B.primes(small.where("minterm > 1"), 3), small)


def test_minimum_by_trying_all(spark):
    """Random functions of four inputs: the level search against all subsets of primes."""
    rng = random.Random(8)
    fns = {f"r{i}": sorted(rng.sample(range(16), rng.randrange(1, 12))) for i in range(12)}
    on = minterms(spark, **fns)
    p = B.primes(on, 4)
    pool: dict = {}
    for r in p.collect():
        pool.setdefault(r["fn"], []).append((r["mask"], r["value"]))
    want = {}
    for fn, ms in fns.items():
        best = None
        for n in range(1, 9):
            for some in itertools.combinations(pool[fn], n):
                if all(any(m & mask == value for mask, value in some) for m in ms):
                    cost = n, sum(mask.bit_count() for mask, _ in some)
                    best = min(best or cost, cost)
            if best:
                break
        want[fn] = best
    got: dict = {}
    for r in B.minimum_cover(p, on).collect():
        terms, lits = got.get(r["fn"], (0, 0))
        got[r["fn"]] = (terms + 1, lits + r["mask"].bit_count())
    assert got == want


def test_greedy_choice_and_sweep_by_plain_loops(spark):
    rng = random.Random(4)
    fns = {f"g{i}": sorted(rng.sample(range(32), rng.randrange(3, 25))) for i in range(6)}
    on = minterms(spark, **fns)
    pool: dict = {}
    for r in B.primes(on, 5).collect():
        pool.setdefault(r["fn"], []).append((r["mask"], r["value"]))
    weigh = {"literals": lambda n: n, "area": lambda n: n + 0.8, "delay": lambda n: 1 + math.ceil(math.log2(n)), "lut4": lambda n: math.ceil(n / 4), "lut6": lambda n: math.ceil(n / 6)}
    want = set()
    for objective, weight in weigh.items():
        for fn, ms in fns.items():
            left, taken = set(ms), []
            hit = lambda c: {m for m in left if m & c[0] == c[1]}
            while left:
                best = max(pool[fn], key=lambda c: (len(hit(c)) / weight(max(1, c[0].bit_count())), len(hit(c)), -c[0], -c[1]))
                left -= hit(best)
                taken.append(best)
            kept = list(taken)
            for c in taken:
                rest = [d for d in kept if d != c]
                if all(any(m & d[0] == d[1] for d in rest) for m in ms):
                    kept = rest
            want |= {(fn, objective, m, v) for m, v in kept}
    got = B.minimise(on, on.where("false"), 5, tuple(weigh)).collect()
    assert {(r["fn"], r["objective"], r["mask"], r["value"]) for r in got} == want


def test_ordered_pruning(spark):
    c = cubes(spark, prune=[(2, 2), (3, 3)], chain=[(1, 0), (1, 1), (2, 0), (2, 2)])
    none = minterms(spark, x=[0])
    assert rows(B.prune_redundant(c, none, 2), "fn", "mask", "value") == [("chain", 2, 0), ("chain", 2, 2), ("prune", 2, 2)]
    assert rows(B.prune_redundant(c, minterms(spark, prune=[2, 3]), 2).where("fn = 'prune'"), "mask", "value") == []


def cubes(spark, **covers):
    return spark.createDataFrame([(f, m, v) for f, cs in covers.items() for m, v in cs], "fn string, mask int, value int")


def test_absorption_and_redundancy(spark):
    c = cubes(spark, absorb=[(2, 2), (3, 2)], prune=[(2, 2), (3, 3)])
    assert rows(B.absorb(c.where("fn = 'absorb'")), "mask", "value") == [(2, 2)]
    assert rows(B.redundant(c.where("fn = 'prune'"), minterms(spark, none=[0]), 2), "mask", "value") == [(3, 3)]


def test_costs(spark):
    c = cubes(spark, adv3=[(3, 1), (6, 4), (7, 2)], maj3=[(3, 3), (5, 5), (6, 6)], lut3=[(15, 1), (15, 2), (15, 4)])
    got = {r["fn"]: r for r in B.cover_costs(c).collect()}
    assert got["adv3"]["literals"] == 7 and abs(got["adv3"]["area"] - 6.6) < 1e-9
    assert (got["maj3"]["luts6"], got["maj3"]["levels"]) == (4, 4) and abs(got["maj3"]["cost6"] - 4.2) < 1e-9
    assert (got["lut3"]["luts4"], got["lut3"]["levels"]) == (4, 5) and abs(got["lut3"]["cost4"] - 4.25) < 1e-9
