import random
import time

import numpy as np
import pyarrow as pa
import pytest

from bitloom.llm import jaccard_join as J
from bitloom.llm.jaccard_join import Bands, index_rows, link_classes

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    words = (text or "").translate(LOWER).split()
    if len(words) < k:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def brute(rows, k, num, den):
    sets = [(i, shingles(t, k)) for i, t in rows if i is not None]
    label = {i: i for i, _ in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a][1] & sets[b][1])
            if both and den * both >= num * (len(sets[a][1]) + len(sets[b][1]) - both):
                x, y = find(sets[a][0]), find(sets[b][0])
                label[max(x, y)] = min(x, y)
    return {i: find(i) for i in label}


@pytest.mark.parametrize("k,num,den", [(4, 85, 100), (2, 60, 100)])
def test_classes(odd_docs, k, num, den):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    out = link_classes(odd_docs, k, num, den).collect()
    want = brute(rows, k, num, den)
    assert len(out) == len(rows)
    assert {r["id"]: r["component_id"] for r in out if r["id"] is not None} == want
    assert sorted(r["n_shingles"] for r in out) == sorted(len(shingles(t, k)) for _, t in rows)
    assert all(r["component_id"] is None for r in out if r["id"] is None)


def test_blocks_lose_nothing(odd_docs, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 3)
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    out = link_classes(odd_docs, 3, 70, 100).collect()
    assert {r["id"]: r["component_id"] for r in out if r["id"] is not None} == brute(rows, 3, 70, 100)


def test_empty_table(no_docs):
    assert link_classes(no_docs).collect() == []


def test_index_misses_no_pair():
    """Sets at the limit of similarity share an index row, at many sizes."""
    rng, bands = random.Random(2), Bands(85, 100)
    for size in [1, 2, 5, 6, 7, 8, 12, 13, 20, 33, 60, 150, 700] * 12:
        a = {rng.getrandbits(63) for _ in range(size)}
        b = set(a)
        while True:  # change b as far as allowed
            c = set(b)
            if rng.random() < 0.5 and len(c) > 1:
                c.discard(rng.choice(sorted(c)))
            else:
                c.add(rng.getrandbits(63))
            if 100 * len(a & c) < 85 * len(a | c):
                break
            b = c
        if a == b:
            continue
        x, y = (np.array(sorted(s), dtype=np.uint64) for s in (a, b))
        assert np.intersect1d(index_rows(x, bands), index_rows(y, bands)).size, size


def test_bands_of_a_million_words_are_planned_at_once():
    began = time.perf_counter()
    for band in range(int(Bands(80, 100).of(5_000_000)) + 1):
        most, spare, m = Bands(80, 100).plan(band)
        assert m == most + 1 + spare and spare >= 0
    assert time.perf_counter() - began < 0.5


def test_streamed_groups_hold_all_pairs_of_a_key(monkeypatch):
    """Rows of a task merged by key, then streamed in small batches: members of a key meet in a group."""
    monkeypatch.setattr(J, "HELD", 8)
    rng = random.Random(7)
    held = [(rng.choice([1, 1, 1, 2, 3, *range(4, 400)]), i) for i in range(1500)]
    keys, ids = (np.array(x) for x in zip(*sorted(held)))
    rows = []
    for key in np.unique(keys).tolist():  # ids of a key come in rows of different lengths
        mine = ids[keys == key].tolist()
        while mine:
            n = rng.randrange(1, 9)
            rows.append((key, mine[0], np.array(mine[1:n], dtype=np.int64).tobytes() if n > 1 and len(mine) > 1 else None))
            mine = mine[n:]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[a : a + 7]), (pa.int64(), pa.int64(), pa.binary()))], names=["key", "id", "more"]) for a in range(0, len(rows), 7)]
    groups: dict = {}
    for out in J._groups(batches):
        for g, i in zip(*(c.to_pylist() for c in out.columns)):
            groups.setdefault(g, set()).add(i)
    for key in np.unique(keys).tolist():
        mine = set(ids[keys == key].tolist())
        assert len(mine) == 1 or any(mine <= g for g in groups.values())


def test_large_group_of_near_copies(spark):
    """Near copies beyond a block: drifting families that pivots join only in part, and a hub that no other links."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(500)}" for _ in range(100)]
    rows = []
    for i in range(1300):
        words = list(base)
        start = rng.randrange(0, 88)
        for j in range(rng.randrange(0, 9)):
            words[start + j] = f"x{i % 60}_{j}"
        rows.append((i, " ".join(words)))
    rows += [(2000 + i, " ".join(base[:60] + [f"y{i}_{j}" for j in range(40)])) for i in range(300)]
    got = link_classes(spark.createDataFrame(rows, "doc_id long, text string"), 3, 80, 100).collect()
    assert {r["id"]: r["component_id"] for r in got} == brute(rows, 3, 80, 100)


def test_rare_tokens_of_linked_sets_meet():
    """Sets at the limit of similarity share one of their rarest tokens, whichever are called common."""
    rng = random.Random(5)
    for size in [1, 2, 4, 5, 9, 10, 11, 40, 99, 100, 300] * 20:
        both = [rng.getrandbits(64) for _ in range(size)]
        more = rng.randrange(0, size * 20 // 80 + 1)  # 80 of 100 hold for up to a quarter more
        split = rng.randrange(0, more + 1)
        a, b = ([*both, *(rng.getrandbits(64) for _ in range(n))] for n in (split, more - split))
        assert 100 * size >= 80 * (size + more)
        common = np.array(sorted(rng.sample(sorted({*a, *b}), rng.randrange(0, len({*a, *b}) + 1))), dtype=np.uint64)
        place = np.array(rng.sample(range(len(common)), len(common)), dtype=np.int64)
        x, y = (J.rare_tokens(np.array(sorted(s), dtype=np.uint64), 80, 100, common, place) for s in (a, b))
        assert np.intersect1d(x, y).size
        assert len(x) == len(a) + 1 - -(-80 * len(a) // 100)


def test_unlike_sets_with_a_passage_in_common(spark, monkeypatch):
    """Rows of comparisons grow with the sets, not with the square of a group that next to no links join."""
    monkeypatch.setattr(J, "BLOCK", 16)
    rng = random.Random(12)
    base, made, links = [f"w{i}" for i in range(60)], [], J._links

    def counted(rows, of):
        made[-1] += rows.count()
        return links(rows, of)

    monkeypatch.setattr(J, "_links", counted)
    for n in (150, 600):
        rows = []
        for i in range(n):
            own = rows[-1][1].split()[60:] if i % 10 == 9 else [f"x{n}_{i}_{j}" for j in range(40)]
            if i % 10 == 9:  # near the text before it
                own[rng.randrange(40)] = "other"
            rows.append((i, " ".join(base + own)))
        made.append(0)
        got = link_classes(spark.createDataFrame(rows, "doc_id long, text string"), 3, 80, 100).collect()
        assert {r["id"]: r["component_id"] for r in got} == brute(rows, 3, 80, 100)
    assert made[1] < 6 * made[0], made


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 1, 2, 3), (2, "a b c d e f", 1, 2, 3)], "doc_id long, text string, g int, id int, _pair int")
    assert {(r["id"], r["component_id"]) for r in link_classes(df).collect()} == {(1, 1), (2, 1)}
