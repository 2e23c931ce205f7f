"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

    y(x) = w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)

The identity makes the pairwise term linear in the words of a text.  Features are
computed by numpy passes over the bytes of many documents at once; the model is a
small table that travels with the task.  Metadata are the numeric columns named in
``labelled.METADATA`` (the stated number of characters), on a logarithmic scale, with
a mark where a row has none; ids, languages and sources are never read.  Training
uses at most ``max_train`` labelled documents (a documented bound); scoring covers
every whole text.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.llm import kernels as K
from bitloom.llm.labelled import METADATA, held_out, score_texts, training_rows

BUCKETS = 1 << 16
RANK = 8
#: Classes of bytes whose shares are features: 0 other punctuation, 1 space, 2 line
#: feed, 3 digit, 4 upper case, 5 lower case, 6 beyond ASCII, 7.. single symbols.
_SYMBOLS = b"!|#$%&*=<>{}/_"
_CLASS = np.zeros(256, dtype=np.int64)
_CLASS[[32, 9, 11, 12, 13]] = 1
_CLASS[10] = 2
_CLASS[48:58] = 3
_CLASS[65:91] = 4
_CLASS[97:123] = 5
_CLASS[128:] = 6
for _i, _b in enumerate(_SYMBOLS):
    _CLASS[_b] = 7 + _i
N_CLASS = 7 + len(_SYMBOLS)
N_STATS = N_CLASS + 9 + 2 * len(METADATA)


class Features:
    """Sparse words (``index``, ``value``, ``count`` per text) and dense ``stats`` of texts."""

    def __init__(self, index, value, count, stats):
        self.index, self.value, self.count, self.stats = index, value, count, stats


def featurise(texts, meta=None) -> Features:
    """Features of texts and of their metadata (a list column of doubles; null: none)."""
    data, offsets = K.utf8(texts)
    meta = _metadata(meta, len(offsets) - 1)
    parts = [_span(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], meta[a:b]) for a, b in K.spans(offsets)]
    if not parts:
        return Features(np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(0, np.int64), np.zeros((0, N_STATS), np.float32))
    return Features(*[np.concatenate(x) for x in zip(*parts)])


def _metadata(meta, n: int) -> np.ndarray:
    """Logarithms of the metadata, 0 where there is none or no number of 0 or more, and marks of these."""
    if meta is None:
        values = np.full((n, len(METADATA)), np.nan)
    else:
        values = meta.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, len(METADATA))
    there = np.isfinite(values) & (values >= 0)
    return np.concatenate([np.log1p(np.where(there, values, 0)), ~there], axis=1)


def _span(data, offsets, meta):
    n = len(offsets) - 1
    size = np.diff(offsets)
    of_byte = np.repeat(np.arange(n), size)
    shares = np.bincount(of_byte * N_CLASS + _CLASS[data], minlength=n * N_CLASS).reshape(n, N_CLASS)
    newlines = shares[:, 2].astype(np.float64)
    shares = shares / np.maximum(size, 1)[:, None]

    words = K.Words(data, offsets)
    docs, count = words.docs(), words.counts
    length = words.end - words.start
    values, of = K.distinct_by_doc(words.hash, docs)
    distinct = np.bincount(of, minlength=n)
    # number of times each distinct word occurs
    many = np.maximum(count, 1)
    mean = np.bincount(docs, weights=length, minlength=n) / many
    spread = np.sqrt(np.maximum(0, np.bincount(docs, weights=length.astype(float) ** 2, minlength=n) / many - mean**2))
    last = words.data[words.end - 1] if len(length) else np.zeros(0, np.uint8)
    ended = np.bincount(docs, weights=K.PUNCT[last], minlength=n) / many
    short = np.bincount(docs, weights=length <= 2, minlength=n) / many
    long_ = np.bincount(docs, weights=length > 20, minlength=n) / many
    stats = np.column_stack([shares, np.log1p(size), np.log1p(count), mean / 10, spread / 10, distinct / many, np.log1p(newlines), ended, short, long_, meta])
    index = (values & K.U64(BUCKETS - 1)).astype(np.int64)
    value = (1 / np.sqrt(np.maximum(distinct, 1)))[of]
    return index, value.astype(np.float32), distinct, stats.astype(np.float32)


def _sums(rows: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of rows; an empty run sums to zero."""
    total = np.zeros((len(count) + 1, rows.shape[1]), dtype=np.float64)
    ends = np.cumsum(count)
    full = np.flatnonzero(count)
    out = np.zeros((len(count), rows.shape[1]), dtype=np.float64)
    del total
    if len(full):
        out[full] = np.add.reduceat(rows, (ends - count)[full], axis=0)
    return out


class FactorisationMachine:
    """``w0``, linear weights and rank-8 factors of words and statistics."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        n = BUCKETS + N_STATS
        self.w0, self.w = 0.0, np.zeros(n, dtype=np.float32)
        self.v = (rng.standard_normal((n, RANK)) * 0.02).astype(np.float32)
        self.center, self.scale = np.zeros(N_STATS, np.float32), np.ones(N_STATS, np.float32)

    def _dense(self, f: Features) -> np.ndarray:
        return np.clip((f.stats - self.center) / self.scale, -4, 4).astype(np.float32)

    def margins(self, f: Features) -> np.ndarray:
        return self._forward(f)[0]

    def _forward(self, f: Features):
        dense = self._dense(f)
        table = np.column_stack([self.w, self.v])[f.index] * f.value[:, None]
        word = _sums(table, f.count)
        square = _sums((table[:, 1:] ** 2), f.count)
        linear = self.w0 + word[:, 0] + dense @ self.w[BUCKETS:]
        total = word[:, 1:] + dense @ self.v[BUCKETS:]
        square = square + (dense**2) @ (self.v[BUCKETS:] ** 2)
        return linear + 0.5 * (total**2 - square).sum(axis=1), total, dense

    def fit(self, f: Features, y: np.ndarray, epochs: int = 30, batch: int = 64, rate: float = 0.02, decay: float = 2e-4, seed: int = 5):
        """Adagrad on the logistic loss, in mini-batches in a seeded order."""
        n = len(y)
        if not n or y.min() == y.max():
            p = (y.sum() + 0.5) / (n + 1) if n else 0.5
            self.w0, self.v[:] = float(np.log(p / (1 - p))), 0
            return self
        self.center, self.scale = f.stats.mean(axis=0), f.stats.std(axis=0) + 1e-3
        p = y.mean()
        self.w0 = float(np.log(p / (1 - p)))
        gw, gv, g0 = np.full(len(self.w), 1e-2, np.float32), np.full(self.v.shape, 1e-2, np.float32), 1e-2
        rng, ends = np.random.default_rng(seed), np.cumsum(f.count)
        for _ in range(epochs):
            order = rng.permutation(n)
            for at in range(0, n, batch):
                rows = order[at : at + batch]
                pick = K.arange_runs((ends - f.count)[rows], f.count[rows])
                part = Features(f.index[pick], f.value[pick], f.count[rows], f.stats[rows])
                z, total, dense = self._forward(part)
                err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) / len(rows)
                of = np.repeat(np.arange(len(rows)), part.count)
                used, inverse = np.unique(part.index, return_inverse=True)
                scale = (err[of] * part.value).astype(np.float32)
                dw = np.bincount(inverse, weights=scale, minlength=len(used))
                own = np.bincount(inverse, weights=scale * part.value, minlength=len(used))
                dv = np.column_stack([np.bincount(inverse, weights=scale * total[of, k], minlength=len(used)) for k in range(RANK)])
                dv -= own[:, None] * self.v[used]
                at_ = np.concatenate([used, np.arange(BUCKETS, BUCKETS + N_STATS)])
                dw = np.concatenate([dw, err @ dense])
                dv = np.concatenate([dv, dense.T @ (err[:, None] * total) - (err @ dense**2)[:, None] * self.v[BUCKETS:]])
                dw += decay * self.w[at_]
                dv += decay * self.v[at_]
                gw[at_] += dw**2
                gv[at_] += dv**2
                g0 += err.sum() ** 2
                self.w[at_] -= rate * dw / np.sqrt(gw[at_])
                self.v[at_] -= 0.5 * rate * dv / np.sqrt(gv[at_])
                self.w0 -= rate * err.sum() / np.sqrt(g0)
        return self

    def score(self, texts, meta=None) -> np.ndarray:
        """Scores of texts, document by document in bounded spans."""
        data, offsets = K.utf8(texts)
        out, meta = np.zeros(len(offsets) - 1), _metadata(meta, len(offsets) - 1)
        for a, b in K.spans(offsets):
            f = Features(*_span(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], meta[a:b]))
            out[a:b] = 1 / (1 + np.exp(-np.clip(self.margins(f), -30, 30)))
        return out


_FIELDS = "doc_id long, y int, index array<int>, value float, stats array<float>"


def train(docs: DataFrame, labels: DataFrame, max_train: int = 12_000, max_bytes: int = 1 << 26) -> FactorisationMachine:
    """Features are made on the executors; the driver gets those of at most about ``max_train``
    texts and ``max_bytes`` bytes."""

    def run(batches):
        for batch in batches:
            f = featurise(batch.column(1), batch.column(3))
            per = np.zeros(len(f.count), np.float32)
            per[f.count > 0] = 1 / np.sqrt(f.count[f.count > 0])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), K.ragged(f.index.astype(np.int32), f.count), pa.array(per), K.ragged(f.stats.ravel(), np.full(len(f.stats), N_STATS))],
                names=["doc_id", "y", "index", "value", "stats"],
            )

    rows = training_rows(docs, labels, "quality", max_train, max_bytes).select("doc_id", "text", F.col("y").cast("int"), "meta")
    got = rows.mapInArrow(run, _FIELDS).orderBy("doc_id").toArrow().combine_chunks()
    if not got.num_rows:
        return FactorisationMachine().fit(featurise(pa.array([], pa.string())), np.zeros(0))
    lists = got.column("index").combine_chunks()
    count = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    index = lists.flatten().to_numpy().astype(np.int64)
    stats = got.column("stats").combine_chunks().flatten().to_numpy().reshape(-1, N_STATS)
    f = Features(index, np.repeat(got.column("value").to_numpy(), count).astype(np.float32), count, stats)
    return FactorisationMachine().fit(f, got.column("y").to_numpy().astype(float))


def score_quality(docs: DataFrame, labels: DataFrame, max_train: int = 12_000, max_bytes: int = 1 << 26) -> DataFrame:
    """``docs`` (with ``doc_id`` and ``text``) and a column ``_score`` from 0 to 1.

    Learns only from labelled rows that are not held out; no label, language,
    source or id enters a score.  Null and empty texts get the score of a text
    without words.  Without labels of both kinds every score is the labels' mean
    (0.5 without labels).  Repeated rows score alike; an empty table stays empty.  An
    input column ``_score`` is replaced.  Null, negative or unreadable metadata count
    as none, as does a table without these columns.
    """
    docs = docs.drop("_score")
    model = train(docs, labels, max_train, max_bytes)
    return score_texts(docs, model.score)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = score_quality(docs.select("doc_id", "text", "n_chars"), labels)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.3).cast("int").alias("predicted"))
