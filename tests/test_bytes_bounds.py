"""What the byte kernels hold, and plans that stay within a row: kernels are run on the driver."""

import heapq
import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bitloom.operators import byte_stats as S
from bitloom.operators import gaps as G
from bitloom.operators import transforms as T
from bitloom.streaming import blocks as C

HT = ("head-tail", 8, 1)
TRANSFORMS = {
    "t1_delta": (("delta",),), "t3_bit_planes": (("bit-planes",),), "t4_bit_planes_delta": (("bit-planes",), ("delta",)), "t4_bit_planes_xor": (("bit-planes",), ("xor",)),
    "t5_head_tail": (("head-tail", 8, 3),), "t6_gather": (("gather", 4),), "t7_periodic_delta": (("delta", 4),), "t8_gather_delta": (("gather", 4), ("delta",)),
    "t9_tail_gather": (HT, ("tail-gather", 8, 1, 3)), "t10_tail_xor": (HT, ("tail-xor", 8, 1, 3)),
}
KERNELS = {
    **{n: (lambda df, p=p: T.transformed(df, p)) for n, p in TRANSFORMS.items()}, **{f"{n}-back": (lambda df, p=p: T.restored(df, p, "bytes")) for n, p in TRANSFORMS.items()},
    "t14_period_scores": T.period_scores, "t16_best_plan": T.plan_sizes, "p3_index_sizes": S.byte_counts, "p3_index_payload": S.index_payload, "d1_fixed_width": G.fixed_widths,
}


class Kernel:
    """Stands for the frame that a kernel makes."""

    def __init__(self, run):
        self.run = run

    def select(self, *_):
        return self


@pytest.mark.parametrize("name", KERNELS)
def test_a_kernel_holds_a_few_times_its_longest_text(spark, monkeypatch, name):
    rng = random.Random(1)
    texts = [rng.randbytes(1000) for _ in range(4000)] + [rng.randbytes(4_000_000)]
    df = spark.createDataFrame([], "k long, bytes binary")
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: Kernel(run))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.binary())], names=["k", "bytes"])
    kernel = KERNELS[name](df).run
    tracemalloc.start()
    for _ in kernel(iter([batch])):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60_000_000


def heap_lengths(freq):
    heap, out, made = [(f, i, (i,)) for i, f in enumerate(freq)], [0] * len(freq), len(freq)
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for i in a[2] + b[2]:
            out[i] += 1
        heapq.heappush(heap, (a[0] + b[0], made, a[2] + b[2]))
        made += 1
    return out if len(freq) > 1 else [1]


def test_code_lengths_stay_in_the_row(spark):
    """The lengths of a heap, ties included, without a pandas frame a text."""
    rng = random.Random(2)
    tables = {k: [rng.choice([1, 1, 2, 3, 5, 8, 1000]) * rng.randint(1, 3) for _ in range(rng.choice([1, 2, 3, 40, 256]))] for k in range(300)}
    tables |= {400: [1] * 256, 401: [2**i for i in range(40)]}
    hist = spark.createDataFrame([(k, b, f) for k, freq in tables.items() for b, f in enumerate(freq)], "k long, b int, freq long")
    out = S.code_lengths(hist)
    assert "InPandas" not in out._jdf.queryExecution().toString()
    got: dict = {}
    for r in out.collect():
        got.setdefault(r["k"], {})[r["b"]] = (r["freq"], r["length"])
    assert got == {k: dict(enumerate(zip(freq, heap_lengths(freq)))) for k, freq in tables.items()}


def test_groups_of_chunks_by_a_plain_loop(spark):
    """One exchange, the best of all groupings; a key in two rows counts their chunks together."""
    rng = random.Random(3)
    texts = {i: "".join(chr(rng.randrange(48, rng.choice([50, 64, 120]))) * rng.choice([1, 30]) for _ in range(rng.randrange(1, 120))) for i in range(60)}
    df = spark.createDataFrame([*texts.items(), (7, "zz" * 20), (100, ""), (None, "abc")], "id long, text string")
    for interval in (1, 3, 4):
        out = C.best_groups(C.text_chunks(df, F.col("id"), F.col("text"), 64), interval)
        assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hash") <= 1
        parts: dict = {}
        for k, text in [*texts.items(), (7, "zz" * 20)]:
            for at in range(0, len(text), 64):
                parts.setdefault((k, at // 64 // interval), {}).setdefault(at // 64 % interval, []).append(text[at : at + 64])
        want = {}
        for key, block in parts.items():
            pieces = ["".join(block[i]) for i in range(len(block))]

            def cost(lo, hi, pieces=pieces):
                joined = "".join(pieces[lo:hi])
                s = len(set(joined))
                return -(-len(joined) * max(1, (s - 1).bit_length()) // 8) + s + 36 + (10 if hi - lo == 1 else 18)

            def best(lo, hi):
                return min([cost(lo, hi), *[best(lo, m) + best(m, hi) + 2 for m in range(lo + 1, hi)]])

            want[key] = (len(pieces), best(0, len(pieces)), sum(cost(i, i + 1) for i in range(len(pieces))))
        assert {(r["k"], r["block"]): (r["chunks"], r["best"], r["plain"]) for r in out.collect()} == want
