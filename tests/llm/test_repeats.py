import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bitloom.llm import repeats as R
from bitloom.llm.repeats import RunLengthIndex, remove_repeats


def brute(texts, length):
    seen = {}
    for b in texts:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] = seen.get(b[i : i + length], 0) + 1
    out = []
    for b in texts:
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = [i for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1])]
        out.append((bytes(x for x, g in zip(b, gone) if not g), len(spans)))
    return out


@pytest.mark.parametrize("group", [20_000, 1])
def test_against_brute_force(odd_docs, monkeypatch, group):
    monkeypatch.setattr(R, "GROUP", group)
    rows = odd_docs.collect()
    want = brute([(r["text"] or "").encode() for r in rows], 200)
    got = remove_repeats(odd_docs).collect()
    key = lambda r: (str(r["doc_id"]), r["text"] or "")
    pairs = sorted(zip(rows, want), key=lambda x: key(x[0]))
    assert [(bytes(r["_kept"]), len(r["_spans"])) for r in sorted(got, key=key)] == [w for _, w in pairs]


def test_long_texts_are_cut_without_loss(spark, monkeypatch):
    monkeypatch.setattr(R, "CHUNK", 700)
    rng = random.Random(1)
    a = "".join(rng.choice("abcd") for _ in range(5000))
    docs = spark.createDataFrame([(1, a), (2, "zz" + a[1300:3900] + "q" + a[:250]), (3, a[100:290])], "doc_id long, text string")
    got = {r["doc_id"]: bytes(r["_kept"]) for r in remove_repeats(docs).collect()}
    assert [got[i] for i in (1, 2, 3)] == [x for x, _ in brute([r["text"].encode() for r in docs.orderBy("doc_id").collect()], 200)]


def test_empty_table(no_docs):
    assert remove_repeats(no_docs).collect() == []


def test_matching_statistics():
    rng = np.random.default_rng(1)
    base = rng.integers(97, 100, 400, dtype=np.uint8)
    parts = []
    for _ in range(40):
        x = base.copy()
        for _ in range(rng.integers(0, 3)):
            x[rng.integers(0, 400)] = rng.integers(97, 100)
        a = rng.integers(0, 60)
        parts.append(x[a : a + rng.integers(200, 336)])
    offsets = np.cumsum([0] + [len(p) for p in parts])
    index = RunLengthIndex(np.concatenate(parts), offsets)
    stats = index.matching_statistics()
    assert len(index.chars) < index.n / 4 and index.lengths.sum() == index.n
    seen = {}
    for p in parts:
        for i in range(len(p) - 199):
            seen[bytes(p[i : i + 200])] = seen.get(bytes(p[i : i + 200]), 0) + 1
    for k, p in enumerate(parts):
        for i in range(len(p) - 199):
            assert (stats[index.begin[k] + i] >= 200) == (seen[bytes(p[i : i + 200])] > 1)


@pytest.mark.parametrize("merged", [1, 1 << 19])
def test_a_very_common_passage(spark, monkeypatch, merged):
    """A passage in most texts, several times in some: few rows of its anchor leave a task."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage = " ".join(word() for _ in range(60))
    texts = [" ".join(word() for _ in range(rng.randrange(40))) + (" " + passage) * rng.choice([0, 1, 1, 3]) + " ".join(word() for _ in range(9)) for _ in range(200)]
    monkeypatch.setattr(R, "MERGED", merged)
    out = []
    batch = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array(range(200)), pa.array(texts)], names=["id", "tag", "text"])
    for b in R._anchor_rows(200)(iter([batch])):
        out += b.to_pylist()
    open_ = [(r["h"], r["ctx"]) for r in out if not r["settled"]]
    if merged > 1:
        assert len(set(open_)) == len(open_) and any(r["settled"] for r in out)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("_kept", F.lit(1)).withColumn("_marks", F.lit(2)).withColumn("id", F.lit("x"))
    got = remove_repeats(docs).orderBy("doc_id").collect()
    assert [bytes(r["_kept"]) for r in got] == [x for x, _ in brute([t.encode() for t in texts], 200)] and {(r["_marks"], r["id"]) for r in got} == {(2, "x")}
