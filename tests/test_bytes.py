"""Transforms against direct loops, gaps and packs against round trips."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from bitloom.operators import byte_stats as S
from bitloom.operators import gaps as G
from bitloom.operators import transforms as T
from bitloom.plans import encodings as E
from bitloom.streaming import blocks as C

TEXTS = ["", "a", "abcabcabcabc\nxyzxyzxyz\n", "é" * 11, "the quick brown fox " * 9 + "!", "ab" * 700_000]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(99, None)], "id long, text string")
    return T.byte_texts(df, F.col("id"), F.col("text")).withColumn("extra", F.lit("x"))


def shifted(b, p):
    return [b[i - p] if i >= p else 0 for i in range(len(b))]


def direct(b, name, *x):
    """The step by plain loops."""
    if name == "delta":
        return bytes((u - v) % 256 for u, v in zip(b, shifted(b, *(x or (1,)))))
    if name == "xor":
        return bytes(u ^ v for u, v in zip(b, shifted(b, *(x or (1,)))))
    if name == "gather":
        return b"".join(b[i :: x[0]] for i in range(x[0]))
    if name == "head-tail":
        return bytes(u for i, u in enumerate(b) if i % x[0] < x[1]) + bytes(u for i, u in enumerate(b) if i % x[0] >= x[1])
    if name == "bit-planes":
        bits = [b[i] >> k & 1 for k in range(8) for i in range(len(b))]
        return bytes(sum(v << j for j, v in enumerate(bits[i : i + 8])) for i in range(0, len(bits), 8))
    head = sum(i % x[0] < x[1] for i in range(len(b)))
    return b[:head] + direct(b[head:], name.removeprefix("tail-"), *x[2:])


PLANS = [
    (), (("delta",),), (("xor",),), (("delta", 3),), (("xor", 7),), (("gather", 4),), (("head-tail", 5, 2),), (("bit-planes",),), (("bit-planes",), ("xor",)),
    (("head-tail", 8, 1), ("tail-xor", 8, 1, 3)), (("head-tail", 8, 1), ("tail-gather", 8, 1, 3), ("delta",)), (("head-tail", 8, 3), ("tail-delta", 8, 3, 2)),
]


@pytest.mark.parametrize("plan", PLANS, ids=str)
def test_transforms(docs, plan):
    out = T.restored(T.transformed(docs, plan), plan)
    for r in out.collect():
        want = (TEXTS[r["k"]] if r["k"] != 99 else "").encode()
        assert bytes(r["bytes"]) == bytes(r["back"]) == want and r["extra"] == "x"
        for step in plan:
            want = direct(want, *step)
        assert bytes(r["made"]) == want
    assert "Exchange" not in out._jdf.queryExecution().toString()


def test_plans_are_the_smallest(spark):
    rows = [(0, bytes(i * 3 % 256 for i in range(4000))), (1, bytes(i * i % 7 + i % 5 * 30 for i in range(3000))), (2, b"abc"), (3, b""), (4, b"xyzw" * 900)]
    made = {r["k"]: r["plans"] for r in T.plan_sizes(spark.createDataFrame(rows, "k long, bytes binary")).collect()}
    best = {r["k"]: r for r in T.best_plan(T.plan_sizes(spark.createDataFrame(rows, "k long, bytes binary"))).collect()}
    assert set(made) == {0, 1, 2, 4}
    for k, data in rows:
        if not data:
            continue
        n = len(data)
        score = lambda p: -sum(data[i] == data[i - p] for i in range(p, n, max(1, (n - p) // min(20_000, n - 2)))) / len(range(p, n, max(1, (n - p) // min(20_000, n - 2))))
        plans = dict(T.PLANS) | ({f"{s}-{p}": ((s, p),) for p in sorted(range(2, 17), key=lambda p: (score(p), p))[:3] for s in ("delta", "xor")} if n >= 2048 else {})
        assert {x["plan"] for x in made[k]} == set(plans)
        for x in made[k]:
            out = data
            for step in plans[x["plan"]]:
                out = direct(out, *step)
            symbols = len(set(out))
            assert x["size"] == -(-n * max(1, (symbols - 1).bit_length()) // 8) + symbols
        assert best[k]["size"] == min(x["size"] for x in made[k]) and best[k]["beats"] == (best[k]["size"] + 28 < best[k]["plain"])
    assert best[0]["beats"] and not best[2]["beats"]


def test_widths_by_a_plain_loop(spark):
    rng = random.Random(3)
    up = lambda w, n: b"".join(v.to_bytes(w, "little") for v in sorted(rng.sample(range(256 ** min(w, 6)), n)))
    rows = [(i, up(w, n)) for i, (w, n) in enumerate([(3, 40), (4, 9), (2, 5), (8, 3), (1, 7), (5, 11), (7, 12)])] + [(50, b""), (51, b"aa"), (52, b"cba" * 8), (53, b"\xff" * 48)]
    got: dict = {}
    for r in G.fixed_widths(spark.createDataFrame(rows, "k long, bytes binary")).collect():
        got.setdefault(r["k"], {})[r["width"]] = (r["n"], r["falls"], r["chosen"])
    for k, data in rows:
        want, first = {}, True
        for w in G.WIDTHS:
            if len(data) % w == 0 and len(data) >= 3 * w:
                v = [int.from_bytes(data[i : i + w], "little") for i in range(0, len(data), w)]
                falls = sum(b <= a for a, b in zip(v, v[1:]))
                want[w] = (len(v), falls, falls == 0 and first)
                first = first and falls > 0
        assert got.get(k, {}) == want


def test_codes_are_optimal_and_prefix_free(spark):
    df = spark.createDataFrame([(1, "abracadabra"), (2, "zzzz")], "id long, text string")
    lengths = S.code_lengths(S.histogram(df, F.col("id"), F.col("text")))
    bits = {r["k"]: r["coded_bits"] for r in S.huffman_sizes(lengths).collect()}
    assert bits == {1: 23, 2: 4}
    words = [format(r["code"], f"0{r['length']}b") for r in S.canonical_codes(lengths).where("k = 1").collect()]
    assert not any(a != b and b.startswith(a) for a in words for b in words)


def test_choice_of_methods(spark):
    rows = [(1, "raw-copy", 100), (1, "raw-zstd", 100), (2, "raw-copy", 1000), (2, "indexed-circuit", 995), (3, "raw-copy", 1000), (3, "indexed-circuit", 980), (4, "raw-copy", 50), (4, "raw-xz", 49), (4, "raw-deflate", 49)]
    got = {r["k"]: (r["method"], r["total"]) for r in S.choose(spark.createDataFrame(rows, "k int, method string, total long")).collect()}
    assert got == {1: ("raw-copy", 100), 2: ("raw-copy", 1000), 3: ("indexed-circuit", 980), 4: ("raw-deflate", 49)}


def test_gaps(spark):
    v = [0, 8, 24, 40, 1064]
    series = spark.createDataFrame([("a", i, x) for i, x in enumerate(v)] + [("flat", i, 5) for i in range(4)], "k string, t int, v long")
    got = G.gap_sizes(series).collect()
    assert [(r["k"], r["n"], r["shift"], r["bytes"], r["varint"], r["zero_bytes"], r["zero_varint"]) for r in got] == [("a", 5, 4, None, 5, 4, 4)]
    back = {(r["k"], r["i"]): r["v"] for r in G.restored(G.gap_rows(series)).collect()}
    assert [back["a", i] for i in range(5)] == v


def test_resume_begins_at_a_block(spark):
    df = spark.createDataFrame([(1, "é" * 700), (2, "short")], "id long, text string")
    chunks = C.text_chunks(df, F.col("id"), F.col("text"), 100)
    got = {r["k"]: (bytes(r["bytes"]), r["chunks"]) for r in C.resume(chunks, 8, 4).collect()}
    assert got == {1: (("é" * 700).encode()[800:], 6)}
    assert {r["k"]: bytes(r["bytes"]) for r in C.resume(chunks, 0, 4).collect()} == {1: ("é" * 700).encode(), 2: b"short"}
    for start, interval in ((2, 4), (-4, 4), (0, 0)):
        with pytest.raises(ValueError, match="does not begin"):
            C.resume(chunks, start, interval)


def test_coded_choice_is_the_smallest(spark, tmp_path):
    texts = [*TEXTS, None, "ab", "e" * 400 + "the quick brown fox", "".join(map(chr, range(32, 127))) * 3, "a" * 900 + "b" * 90 + "c" * 9 + "d"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def cost(data):
        freq = Counter(data)
        heap, bits = sorted(freq.values()), len(data) if len(freq) == 1 else 0
        while len(heap) > 1:
            a, b, *rest = heap
            bits, heap = bits + a + b, sorted([a + b, *rest])
        width = max(1, (len(freq) - 1).bit_length())
        sizes = {"raw-copy": len(data) + 36, "indexed-raw": -(-len(data) * width // 8) + len(freq) + 36, "indexed-huffman": -(-bits // 8) + 2 * len(freq) + 36}
        name = min(sizes, key=sizes.get)  # the first on ties
        return name, sizes[name]

    want = {i: cost(t.encode()) for i, t in enumerate(texts) if t}
    assert {name for name, _ in want.values()} == {"raw-copy", "indexed-raw", "indexed-huffman"}
    assert {r["doc_id"]: (r["method"], r["total"]) for r in E.coded_method(spark, str(tmp_path)).collect()} == want
    used = {r["method"]: (r["texts"], r["bytes"]) for r in E.coded_methods(spark, str(tmp_path)).collect()}
    assert used == {m: (sum(x == m for x, _ in want.values()), sum(n for x, n in want.values() if x == m)) for m in {x for x, _ in want.values()}}


def test_codecs_by_file_size(spark, tmp_path):
    spark.createDataFrame([(i, f"a text that repeats {i % 5} " * 40) for i in range(500)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r["place"], r["codec"], r["bytes"]) for r in E.table_codecs(spark, str(tmp_path)).collect())
    assert {c for _, c, _ in got} == set(E.CODECS) and [b for *_, b in got] == sorted(b for *_, b in got)
    sizes = {c: b for _, c, b in got}
    assert sizes["none"] == max(sizes.values()) and sizes["zstd"] < sizes["none"]


def test_packed_ids_by_a_plain_loop(spark):
    rows = [(i, t.encode()) for i, t in enumerate([*TEXTS[:5], "aaaa", "".join(map(chr, range(33, 127)))])] + [(90, bytes(range(256)) * 2)]
    for r in S.index_payload(spark.createDataFrame(rows, "k long, bytes binary")).collect():
        data = dict(rows)[r["k"]]
        symbols = sorted(set(data))
        width = max(1, (len(symbols) - 1).bit_length()) if symbols else 1
        number = sum(symbols.index(b) << i * width for i, b in enumerate(data))
        assert r["bits"] == width and bytes(r["payload"]) == number.to_bytes(-(-len(data) * width // 8), "little")
