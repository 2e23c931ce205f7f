import random
import re
import time

import numpy as np
import pyarrow as pa

from bitloom.llm import decontaminate as D
from bitloom.llm.decontaminate import find_items

WORDS = [f"w{i}" for i in range(4000)]


def test_passages_are_found_and_others_are_not(spark, odd_docs):
    rng = random.Random(3)
    make = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    items = [(i, make(n)) for i, n in enumerate([3, 5, 12, 16, 17, 24, 40, 59, 130, 400])] + [(50, None), (51, ""), (None, make(20))]
    docs, want = [], set()
    for i in range(300):
        text = make(rng.randrange(0, 200))
        if i % 3 == 0:
            j, item = items[rng.randrange(10)]
            item = item.upper() if i % 2 else item.replace(" ", ", ", 1)
            text = text + "\n" + item + " " + make(rng.randrange(0, 60))
            want.add((i, j))
        docs.append((i, text, "x"))
    edited = items[6][1].split()
    edited[20] = "changed"
    docs.append((999, make(50) + " " + " ".join(edited), "x"))
    want.add((999, 6))
    df = spark.createDataFrame(docs + [(1000, None, "x"), (1001, "", "x")], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for most in (20_000, 4):  # in one pass and in several
        got = {(r["doc_id"], x["item_id"]) for r in find_items(df, bench, max_items=most).collect() for x in r["_items"]}
        assert got == want
    assert all(not r["_items"] for r in find_items(odd_docs, bench).collect())
    assert all(not r["_items"] for r in find_items(df, bench.where("item_id < 0")).collect())
    assert find_items(df.where("doc_id < 0"), bench).collect() == []


def test_blocks_guarantee_the_radius():
    """Any fingerprint within the radius agrees in one block up to one bit."""
    rng = np.random.default_rng(0)
    index = D.Index(np.array([1]), pa.array([" ".join(f"t{i}" for i in range(30))]))
    (_, _, files), = index.sizes.values()
    for _ in range(500):
        flips = rng.choice(64, rng.integers(0, D.RADIUS + 1), replace=False)
        x = files.prints[:1].copy()
        for f in flips:
            x ^= np.uint64(1) << np.uint64(f)
        window, pick, apart = files.within(x)
        assert (0, 0, len(flips)) in set(zip(window.tolist(), pick.tolist(), apart.tolist()))


def test_files_find_what_a_scan_finds():
    rng = np.random.default_rng(1)
    prints = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    found = prints[rng.integers(0, 3000, 4000)].copy()
    for _ in range(9):
        found ^= np.where(rng.random(4000) < 0.7, np.uint64(1) << rng.integers(0, 64, 4000).astype(np.uint64), np.uint64(0))
    found[:2000] = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
    apart = np.bitwise_count(found[:, None] ^ prints[None])
    x, y = np.nonzero(apart <= D.RADIUS)
    assert len(x) > 500 and set(zip(*map(np.ndarray.tolist, D.Files(prints).within(found)[:2]))) == set(zip(x.tolist(), y.tolist()))


def test_work_hardly_grows_with_the_benchmark():
    """Candidates compared for a window: a few, where a scan would compare all prints."""
    rng = random.Random(4)
    make = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    texts = pa.array([make(300) for _ in range(100)])
    took = []
    for n in (200, 4000):
        index = D.Index(np.arange(n), pa.array([make(rng.randrange(20, 60)) for _ in range(n)]))
        index.search(texts)
        began = time.perf_counter()
        assert not any(index.search(texts))
        took.append(time.perf_counter() - began)
    assert took[1] < 5 * took[0] + 0.1


def test_clashing_columns(spark):
    bench = spark.createDataFrame([(i, f"a b c d e f g{i}") for i in range(3)], "item_id long, text string")
    df = spark.createDataFrame([(1, "x a b c d e f g1 y", ["clash"], 9)], "doc_id long, text string, _items array<string>, item_id int")
    for most in (10, 1):
        (row,) = find_items(df, bench, max_items=most, max_bytes=1 << 20 if most > 1 else 20).collect()
        assert 1 in [x["item_id"] for x in row["_items"]] and row["item_id"] == 9


def brute(text: str, item: str) -> float:
    """Largest weighted share of the item's shingles in any stretch of the text as long as the item and its slack."""
    tokens = lambda x: re.findall("[a-z0-9]+", x.lower())
    text, item = tokens(text), tokens(item)
    k, n = min(5, len(item)), len(item)
    width = n + 2 * (n // 10 + 1) if n >= 5 else n
    weight = {}
    for i in range(n - k + 1):
        weight.setdefault(tuple(item[i : i + k]), sum(map(len, item[i : i + k])))
    best = 0
    for a in range(max(1, len(text) - width + 1)):
        part = text[a : a + width]
        best = max(best, sum(weight.get(x, 0) for x in {tuple(part[i : i + k]) for i in range(len(part) - k + 1)}))
    return best / sum(weight.values())


def test_truncated_and_edited_copies_as_by_brute_force(spark):
    rng = random.Random(8)
    make = lambda n: [rng.choice(WORDS) for _ in range(n)]
    sizes = [1, 2, 4, 5, 6, 9, 15, 16, 20, 33, 60, 100, 100, 260]
    items = [make(n) for n in sizes]
    items.append(items[11][:70] + make(8))  # shares most shingles with another
    items.append(["same", "words"] * 20)
    docs = [" ".join(items[11][:85]), " ".join(items[6][1:])]
    for item in items:
        n = len(item)
        for share in (0.7, 0.8, 0.85, 0.9, 0.95):
            cut = max(1, round(n * share))
            for copy in (item[:cut], item[n - cut :], item[(n - cut) // 2 :][:cut]):
                docs += [" ".join(copy), " ".join(make(40) + copy + make(40))]
        for edits in (1, 2, 3, 4, 8):
            copy = list(item)
            for _ in range(edits):
                at = rng.choice([0, n - 1, rng.randrange(n)])
                copy[min(at, len(copy) - 1)] = "edited"
            more = list(item)
            for _ in range(edits):
                more.insert(rng.randrange(n), "added")
            docs += [" ".join(make(rng.randrange(30)) + x + make(rng.randrange(30))) for x in (copy, more)]
        half = n // 2
        docs += [" ".join(item[half:] + item[:half]), " ".join(item[:half] + make(n // 3) + item[half:]), " ".join(item[:half] + make(20) + item + make(5))]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    want = {(d, i): s for d, text in enumerate(docs) for i, x in enumerate(items) if round(s := brute(text, " ".join(x)), 12) >= 0.8}
    assert (0, 11) in want and (1, 6) in want
    got = {(r["doc_id"], x["item_id"]): x["similarity"] for r in find_items(df, bench).collect() for x in r["_items"]}
    assert got.keys() == want.keys()
    assert all(abs(got[x] - want[x]) < 1e-9 for x in want)
