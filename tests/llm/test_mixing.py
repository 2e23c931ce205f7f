from pyspark.sql import functions as F

from bitloom.llm.mixing import mix_sources, source_targets, word_count


def test_targets_fill_by_weight(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 1000), ("c", 10), (None, 400)], "source string, size long")
    got = {r["source"]: (r["source_size"], r["target"]) for r in source_targets(sizes).collect()}
    # weights 3, 1, 2, 3; the whole is 2265: a, c and the null source reach twice their size
    assert got["a"] == (100, 200.0) and got["c"] == (10, 20.0) and got[None] == (400, 800.0)
    assert abs(sum(t for _, t in got.values()) - 2265) < 1e-6


def test_mixture(odd_docs):
    out = mix_sources(odd_docs).collect()
    assert len(out) == odd_docs.count()
    by = {}
    for r in out:
        assert r["_taken"] in (0, r["_size"], 2 * r["_size"])
        assert r["_size"] == len((r["text"] or "").split())
        s = by.setdefault(r["source"], [0, r["_target"], r["_source_size"], 0])
        s[0] += r["_taken"]
        s[3] += r["_size"]
    for taken, target, size, real in by.values():
        assert size == real and taken <= target + 1e-6
    for r in out:  # no document that could be taken once more fits what is left
        taken, target, size, _ = by[r["source"]]
        again = r["_size"] * (int(target // size) + 1)
        assert not r["_size"] or r["_taken"] == again or r["_size"] > target - taken
    again = {(r["doc_id"], r["_taken"]) for r in mix_sources(odd_docs).collect()}
    assert again == {(r["doc_id"], r["_taken"]) for r in out}


def test_empty_table(no_docs):
    assert mix_sources(no_docs).collect() == []


def test_word_count(spark):
    df = spark.createDataFrame([("a b\tc\x0bd  e\n",), ("",), (None,), (" x y",)], "t string")
    assert [r[0] for r in df.select(word_count(df.t)).collect()] == [5, 0, 0, 2]


def test_budgets_are_used_up_to_the_last_document_that_fits(spark):
    """First fit in the order of hashes, by a plain loop; many sizes need more than eight nested budgets."""
    import hashlib
    import random

    rng = random.Random(9)
    rows = [(i, "w " * rng.choice([0, 1, 2, 3, 5, 8, 13, 40, 77, 200, 901]) , rng.choice("ab")) for i in range(500)]
    rows += [(3, "w " * 50, "a"), (3, "w", "a"), (None, "w w", "b"), (None, "w", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("_taken", F.lit("old")).withColumn("h", F.lit(1)).withColumn("rest", F.lit(1))
    got = mix_sources(docs).collect()
    left, plan = {}, {r["source"]: (r["_target"], r["_source_size"]) for r in got}
    units: dict = {}
    for i, text, source in rows:
        key = source, int(hashlib.md5(str(i if i is not None else "null").encode()).hexdigest()[:15], 16)
        units[key] = units.get(key, 0) + len(text.split())
    taken = set()
    for source, (target, size) in plan.items():
        left[source] = target - size * (target // size)
        for key in sorted(k for k in units if k[0] == source):
            if units[key] <= left[source]:
                left[source] -= units[key]
                taken.add(key)
    for r in got:
        key = r["source"], int(hashlib.md5(str(r["doc_id"] if r["doc_id"] is not None else "null").encode()).hexdigest()[:15], 16)
        assert r["_taken"] == r["_size"] * (plan[r["source"]][0] // plan[r["source"]][1] + (key in taken)), r


def first_fit(rows):
    """Words taken of each ``(id, text, source)``, and each source's size and target, by plain loops."""
    import hashlib

    place = lambda i: int(hashlib.md5(str(i if i is not None else "null").encode()).hexdigest()[:15], 16)
    size = [len((t or "").split()) for _, t, _ in rows]
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    whole = {s: sum(n for n, r in zip(size, rows) if r[2] == s) for s in sources}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}
    target, open_ = {}, set(sources)
    left = 1.5 * sum(whole.values())
    while open_:  # sources above their cap are settled, the excess goes to the others
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * whole[s]}
        for s in full or open_:
            target[s] = 2.0 * whole[s] if full else level * weight[s]
            left -= target[s] if full else 0
        open_ -= full or open_
    taken = {}
    for s in sources:
        copies = target[s] // whole[s] if whole[s] else 0
        rest, units = target[s] - copies * whole[s], {}
        for n, (i, _, source) in zip(size, rows):
            if source == s and n:
                units[place(i)] = units.get(place(i), 0) + n
        for h in sorted(units):
            more = units[h] <= rest
            rest -= units[h] * more
            taken[s, h] = int(copies) + more
    return [n * taken.get((s, place(i)), 0) for n, (i, _, s) in zip(size, rows)], {s: (whole[s], target[s]) for s in sources}
