import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bitloom.llm import kernels as K
from bitloom.llm import quality, toxicity
from bitloom.llm.labelled import held_out, training_rows

WORDS = [f"{a}{b}" for a in "ka lo mi ru te so".split() for b in "na po ri ved sul dor".split()]


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(5)
    docs, labels = [], []
    for i in range(400):
        words = [rng.choice(WORDS) for _ in range(rng.randrange(5, 80))]
        toxic, good = int(rng.random() < 0.3), int(rng.random() < 0.7)
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["vile", "idiotic", "scummy"]))
        if not good:
            words = [w + "###" for w in words]
        docs.append((i, " ".join(words), rng.choice(["en", "de", None])))
        if i < 380:
            labels.append((i, good, toxic))
    docs += [(900, None, "en"), (901, "", None), (902, "x" * 200_000, "en"), (903, " \n ", "en"), (None, "null id", "en"), (5, docs[5][1], "en")]
    labels += [(5, 1, 0), (6, None, None), (None, 1, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("label,cut", [("quality", 0.3), ("toxic", 0.5)])
def test_held_out_accuracy(labelled, label, cut):
    docs, labels = labelled
    out = quality.score_quality(docs, labels) if label == "quality" else toxicity.score_toxicity(docs, labels)
    rows = out.withColumn("held", held_out(F.col("doc_id"))).join(labels.where(f"doc_id <> 5 AND {label} IS NOT NULL"), "doc_id", "left").collect()
    assert out.count() == docs.count() and all(0 <= r["_score"] <= 1 for r in rows)
    tried = [(r["_score"] >= cut) == bool(r[label]) for r in rows if r["held"] and r[label] is not None]
    assert len(tried) > 50 and np.mean(tried) > 0.9
    assert all(r["held"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)


@pytest.mark.parametrize("score", [quality.score_quality, toxicity.score_toxicity])
def test_no_labels_no_rows(labelled, score):
    docs, labels = labelled
    assert {r["_score"] for r in score(docs, labels.where("doc_id < 0")).collect()} == {0.5}
    one = score(docs, labels.where("quality = 1 AND toxic = 1")).collect()
    assert len({r["_score"] for r in one}) == 1 and one[0]["_score"] > 0.5
    assert score(docs.where("doc_id < 0"), labels).collect() == []


def test_identity_of_the_factorisation_machine():
    """The linear-time margin equals the sum over all pairs."""
    fm = quality.FactorisationMachine()
    rng = np.random.default_rng(0)
    fm.w = rng.standard_normal(len(fm.w)).astype(np.float32)
    fm.v = rng.standard_normal(fm.v.shape).astype(np.float32)
    f = quality.featurise(pa.array(["a b c a", "", None, "One two; three!"]))
    for i, z in enumerate(fm.margins(f)):
        at = int(f.count[:i].sum())
        idx = np.concatenate([f.index[at : at + f.count[i]], np.arange(quality.BUCKETS, quality.BUCKETS + quality.N_STATS)])
        x = np.concatenate([f.value[at : at + f.count[i]], np.clip(f.stats[i], -4, 4)]).astype(float)
        want = fm.w0 + x @ fm.w[idx]
        v = fm.v[idx].astype(float)
        for a in range(len(x)):
            for b in range(a):
                want += x[a] * x[b] * (v[a] @ v[b])
        assert abs(z - want) < 1e-2 * max(1, abs(want))


def test_words_match_a_plain_split():
    texts = ["", "A b\tC", None, "  é É  x\x0by ", "z" * 3000]
    data, offsets = K.utf8(pa.array(texts))
    w = K.Words(data, offsets)
    want = [(t or "").encode().lower().split() for t in texts]
    assert w.counts.tolist() == [len(x) for x in want]
    flat = [x for xs in want for x in xs]
    assert [bytes(w.data[a:b]) for a, b in zip(w.start, w.end)] == flat
    assert len(set(w.hash.tolist())) == len(set(flat))


def test_passes_do_not_depend_on_the_input_size():
    for n in (640, 12_000):
        fm = quality.FactorisationMachine()
        calls, forward = [], fm._forward
        fm._forward = lambda f: (calls.append(len(f.count)), forward(f))[1]
        fm.fit(quality.featurise(pa.array([f"w{i % 7}" for i in range(n)])), np.arange(n) % 2, batch=640)
        assert sum(calls) == 30 * n


def test_metadata_and_clashing_columns(labelled):
    docs, labels = labelled
    base = docs.drop("_score")
    plain = {r["doc_id"]: r["_score"] for r in quality.score_quality(base, labels).collect()}
    odd = base.withColumn("_score", F.lit("old")).withColumn("_flagged", F.lit(1)).withColumn("meta", F.lit(2)).withColumn("y", F.lit(3)).withColumn("aside", F.lit(4))
    for score in (quality.score_quality, toxicity.score_toxicity):
        out = score(odd, labels)
        assert out.columns.count("_score") == 1 and all(0 <= r["_score"] <= 1 and (r["meta"], r["y"], r["aside"]) == (2, 3, 4) for r in out.collect())
    for kind in (F.char_length("text"), F.when(F.col("doc_id") % 2 == 0, F.char_length("text")), F.lit("no number"), F.lit(-5)):
        got = {r["doc_id"]: r["_score"] for r in quality.score_quality(base.withColumn("n_chars", kind), labels).collect()}
        assert got.keys() == plain.keys() and all(0 <= x <= 1 for x in got.values())


def test_training_sample_is_bounded(labelled):
    docs, labels = labelled
    rows = training_rows(docs, labels, "toxic", 100, 1 << 20).collect()
    assert 50 < len(rows) < 150 and all(r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in rows)
    few = training_rows(docs, labels, "toxic", 10_000, 10_000).collect()
    assert 0 < sum(len(r["text"]) for r in few) < 20_000
    assert {r["doc_id"] for r in rows if r["aside"]} == {r["doc_id"] for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1}


def test_scores_by_brute_force(labelled):
    """Every row's score is the model's own for its whole text alone."""
    docs, labels = labelled
    net, cuts = toxicity.train(docs, labels)
    model = quality.train(docs, labels)
    one = net.scorer()
    for r in toxicity.score_toxicity(docs, labels).collect()[::7]:
        assert abs(r["_score"] - one(pa.array([r["text"]], pa.string()), None)[0]) < 1e-5
        assert r["_flagged"] == (r["_score"] >= cuts.get(r["lang"], 0.5))
    for r in quality.score_quality(docs, labels).collect()[::7]:
        assert abs(r["_score"] - model.score(pa.array([r["text"]], pa.string()))[0]) < 1e-5


def test_a_score_depends_on_its_text_alone():
    """The same text among others, in any order, and by itself."""
    rng = random.Random(1)
    texts = [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(40))) for _ in range(200)] + [None, "", "\n", "x" * 3000]
    y = np.array([float(rng.random() < 0.3) for _ in texts])
    ids, counts = toxicity.word_ids(pa.array(texts))
    score = toxicity.ConvNet().fit(ids, counts, y).calibrate(ids, counts, y).scorer()
    model = quality.FactorisationMachine().fit(quality.featurise(pa.array(texts)), y)
    for f in (lambda t: score(t, None), model.score):
        together = f(pa.array(texts, pa.string()))
        assert np.abs(together - f(pa.array(texts[::-1], pa.string()))[::-1]).max() < 1e-5
        assert max(abs(x - f(pa.array([t], pa.string()))[0]) for x, t in zip(together, texts)) < 1e-5
