"""Toxicity: a convolutional text classifier trained in numpy.

Words are hashed into an embedding table, as are their first bytes, so that a
word seen rarely shares the row of its stem; filters of width 1, 2 and 3 run over
the whole text, each filter's largest response is kept (max pooling), and a
logistic layer turns the pooled responses into a score.  One coordinate of each
embedding starts from the word's signed association with the label among the
training texts, the rest from noise; everything is then trained by gradient steps.

A fifth of the labelled rows is put aside: the net doesn't train on them.  On these
the score's middle and the thresholds by language are calibrated; the thresholds are
extra columns, and the language never enters the score.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.llm import kernels as K
from bitloom.llm.labelled import held_out, score_texts, training_rows

WORD_BUCKETS, STEM_BUCKETS, STEM = 1 << 17, 1 << 16, 7
BUCKETS = WORD_BUCKETS + STEM_BUCKETS
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 6
#: Every width's taps side by side: (width, tap, filter) -> column of the tap table.
TAPS = sum(WIDTHS) * FILTERS
POOLED = len(WIDTHS) * FILTERS


def span_ids(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two rows of the table for each word, and words per text (row 0 is padding)."""
    w = K.Words(data, offsets, space=K.PUNCT)
    stem = K.span_hash(K.prefix_hash(w.data), w.start, np.minimum(w.end, w.start + STEM))
    word_row = (w.hash & K.U64(WORD_BUCKETS - 1)).astype(np.int32) + 1
    stem_row = (stem & K.U64(STEM_BUCKETS - 1)).astype(np.int32) + 1 + WORD_BUCKETS
    return np.column_stack([word_row, stem_row]), w.counts


def word_ids(texts) -> tuple[np.ndarray, np.ndarray]:
    """Rows of each word, and words per text.

    Words are runs of letters and digits of any script, ``A-Z`` lower-cased."""
    data, offsets = K.utf8(texts)
    parts = [span_ids(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in K.spans(offsets)]
    if not parts:
        return np.zeros((0, 2), np.int32), np.zeros(0, np.int64)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def padded(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts in one sequence with padding between them, so that no window that begins in a
    text reaches another; also each text's first place.  A text without words is one padding word."""
    room = np.maximum(counts, 1) + max(WIDTHS) - 1
    first = np.cumsum(room) - room
    out = np.zeros((int(room.sum()) + max(WIDTHS), 2), dtype=np.int32)
    out[K.arange_runs(first, counts)] = ids
    return out, first


class ConvNet:
    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.embed = (rng.standard_normal((BUCKETS + 1, DIM)) * 0.05).astype(np.float32)
        self.embed[0] = 0
        self.taps = (rng.standard_normal((DIM, TAPS)) * 0.3).astype(np.float32)
        self.bias = np.zeros(POOLED, np.float32)
        self.out = (rng.standard_normal(POOLED) * 0.3).astype(np.float32)
        self.out_bias = np.float32(0)
        self.shift, self.slope = 0.0, 1.0
        col = 0
        for width in WIDTHS:  # the first filter of each width reads the association
            self.taps[0, col : col + width * FILTERS : FILTERS] = 1.0
            self.out[WIDTHS.index(width) * FILTERS] = 2.0
            col += width * FILTERS

    def table(self) -> np.ndarray:
        """Response of each word at each tap; scoring only gathers and adds."""
        return self.embed @ self.taps

    def responses(self, seq: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Filter responses at each place of a padded sequence."""
        n = len(seq) - max(WIDTHS)
        got = table[seq[:, 0]] + table[seq[:, 1]]
        out = np.empty((n, POOLED), np.float32)
        col = 0
        for i, width in enumerate(WIDTHS):
            acc = got[:n, col : col + FILTERS].copy()
            for j in range(1, width):
                acc += got[j : n + j, col + j * FILTERS : col + (j + 1) * FILTERS]
            out[:, i * FILTERS : (i + 1) * FILTERS] = acc
            col += width * FILTERS
        return out

    def logits(self, ids: np.ndarray, counts: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
        if not len(counts):
            return np.zeros(0)
        seq, first = padded(ids, counts)
        ends = np.column_stack([first, first + np.maximum(counts, 1)]).ravel()  # windows that begin in the padding don't count
        pooled = np.maximum.reduceat(self.responses(seq, self.table() if table is None else table), ends, axis=0)[::2]
        return np.tanh(pooled + self.bias).astype(float) @ self.out.astype(float) + float(self.out_bias)

    def fit(self, ids: np.ndarray, counts: np.ndarray, y: np.ndarray, passes: int = 6, batch: int = 32, rate: float = 0.01, seed: int = 9):
        n = len(y)
        if not n or y.min() == y.max():
            p = (y.sum() + 0.5) / (n + 1) if n else 0.5
            self.out[:], self.out_bias = 0, np.float32(np.log(p / (1 - p)))
            return self
        self.embed[1:, 0] = association(ids, counts, y)
        ends, rng = np.cumsum(counts), np.random.default_rng(seed)
        names = ("taps", "bias", "out", "out_bias")
        memory = {k: np.full_like(getattr(self, k), 1e-2) for k in names}
        seen = np.full((BUCKETS + 1, DIM), 1e-2, np.float32)
        weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
        weight = np.minimum(weight, 4)
        for _ in range(passes):
            order = rng.permutation(n)
            for at in range(0, n, batch):
                rows = order[at : at + batch]
                seq, first = padded(ids[K.arange_runs((ends - counts)[rows], counts[rows])], counts[rows])
                used, inverse = np.unique(seq, return_inverse=True)
                got = self.responses(inverse.reshape(seq.shape), self.embed[used] @ self.taps)
                long_ = np.maximum(counts[rows], 1)
                place = np.stack([first[i] + got[first[i] : first[i] + long_[i]].argmax(axis=0) for i in range(len(rows))])
                pooled = np.take_along_axis(got, place, axis=0)
                hidden = np.tanh(pooled + self.bias)
                z = hidden @ self.out + self.out_bias
                err = ((1 / (1 + np.exp(-z)) - y[rows]) * weight[rows] / len(rows)).astype(np.float32)
                back = err[:, None] * self.out[None, :] * (1 - hidden**2)
                grads = {"out": hidden.T @ err + 1e-4 * self.out, "out_bias": err.sum(), "bias": back.sum(axis=0), "taps": 1e-4 * self.taps}
                col, words, steps = 0, [], []
                for i, width in enumerate(WIDTHS):
                    g = back[:, i * FILTERS : (i + 1) * FILTERS]
                    for j in range(width):
                        word = seq[place[:, i * FILTERS : (i + 1) * FILTERS] + j]
                        part = self.taps[:, col + j * FILTERS : col + (j + 1) * FILTERS]
                        grads["taps"][:, col + j * FILTERS : col + (j + 1) * FILTERS] += np.einsum("rf,rfd->df", g, self.embed[word].sum(axis=2))
                        step = (g[:, :, None] * part.T[None]).reshape(-1, DIM)
                        words += [word[:, :, 0].ravel(), word[:, :, 1].ravel()]
                        steps += [step, step]
                    col += width * FILTERS
                words, steps = np.concatenate(words), np.concatenate(steps)
                used, inverse = np.unique(words, return_inverse=True)
                de = np.zeros((len(used), DIM), np.float32)
                np.add.at(de, inverse, steps)
                de[used == 0] = 0
                seen[used] += de**2
                self.embed[used] -= rate * de / np.sqrt(seen[used])
                for k in names:
                    memory[k] = memory[k] + grads[k] ** 2
                    setattr(self, k, (getattr(self, k) - rate * grads[k] / np.sqrt(memory[k])).astype(np.float32))
        return self

    def calibrate(self, ids, counts, y):
        """Place 0.5 where these rows are best told apart."""
        z = self.all_logits(ids, counts)
        cut = best_cut(z, y)
        self.shift = float(cut)
        return self

    def all_logits(self, ids, counts, step: int = 512):
        table, ends = self.table(), np.cumsum(counts)
        return np.concatenate([self.logits(ids[(ends - counts)[a] : ends[min(a + step, len(counts)) - 1]], counts[a : a + step], table) for a in range(0, len(counts), step)])

    def scorer(self):
        net, cache = self, []

        def score(texts, _) -> np.ndarray:
            if not cache:  # once a worker: the table is larger than the net that travels
                cache.append(net.table())
            data, offsets = K.utf8(texts)
            out = np.zeros(len(offsets) - 1)
            for a, b in K.spans(offsets, 1 << 19, 4096):
                z = net.logits(*span_ids(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), cache[0])
                out[a:b] = 1 / (1 + np.exp(-np.clip(z - net.shift, -30, 30)))
            return out

        return score


def association(ids: np.ndarray, counts: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Signed root of the likelihood ratio of each word's presence against the label, scaled to about 1."""
    with_, pos, rate, at = np.zeros(BUCKETS), np.zeros(BUCKETS), y.mean(), 0
    for n, label in zip(counts.tolist(), y.tolist()):  # a text at a time, so that memory stays small
        rows = np.unique(ids[at : at + n]) - 1
        with_[rows] += 1
        pos[rows] += label
        at += n
    neg = with_ - pos
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * (np.where(pos > 0, pos * np.log(pos / (with_ * rate)), 0) + np.where(neg > 0, neg * np.log(neg / (with_ * (1 - rate))), 0))
    g = np.sign(pos - with_ * rate) * np.sqrt(np.maximum(g, 0))
    top = np.sort(g)[-20:].mean()
    return np.clip(g / max(top, 4.0), -1, 1).astype(np.float32)


def best_cut(z: np.ndarray, y: np.ndarray) -> float:
    """The threshold with the fewest errors; the middle of the best gap."""
    order = np.argsort(z, kind="stable")
    zs, ys = z[order], y[order]
    errors = np.concatenate([[0], np.cumsum(ys)]) + np.concatenate([np.cumsum((1 - ys)[::-1])[::-1], [0]])
    best = np.flatnonzero(errors == errors.min())
    i = int(best[len(best) // 2])
    low = zs[i - 1] if i else zs[0] - 1
    high = zs[i] if i < len(zs) else zs[-1] + 1
    return float((low + high) / 2)


def train(docs: DataFrame, labels: DataFrame, max_train: int = 8_000, max_bytes: int = 1 << 26, min_lang: int = 50) -> tuple[ConvNet, dict[str, float]]:
    """The net and a threshold on the score for each language with ``min_lang`` labels put aside.

    Words are hashed on the executors; the driver gets those of at most about ``max_train``
    texts and ``max_bytes`` bytes."""

    def run(batches):
        for batch in batches:
            ids, counts = word_ids(batch.column(1))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in (0, 2, 3, 4)), K.ragged(ids.ravel(), 2 * counts)], names=["doc_id", "lang", "y", "aside", "ids"])

    rows = training_rows(docs, labels, "toxic", max_train, max_bytes).select("doc_id", "text", "lang", F.col("y").cast("int"), "aside")
    got = rows.mapInArrow(run, "doc_id long, lang string, y int, aside boolean, ids array<int>").orderBy("doc_id").toArrow().combine_chunks()
    if not got.num_rows:
        return ConvNet().fit(np.zeros((0, 2), np.int32), np.zeros(0, np.int64), np.zeros(0)), {}
    lists = got.column("ids").combine_chunks()
    counts = np.diff(lists.offsets.to_numpy()).astype(np.int64) // 2
    ids, y = lists.flatten().to_numpy().reshape(-1, 2), got.column("y").to_numpy().astype(float)
    aside = got.column("aside").to_numpy(zero_copy_only=False)
    if aside.sum() < 20 or not 0 < y[aside].mean() < 1:  # too few to calibrate on
        aside = np.zeros(len(y), dtype=bool)
    ends = np.cumsum(counts)

    def part(mask):
        return ids[K.arange_runs((ends - counts)[mask], counts[mask])], counts[mask], y[mask]

    net = ConvNet().fit(*part(~aside))
    if y.min() == y.max():
        return net, {}
    test = part(aside if aside.any() else ~aside)
    net.calibrate(*test)
    score = 1 / (1 + np.exp(-np.clip(net.all_logits(*test[:2]) - net.shift, -30, 30)))
    lang, y = np.array(got.column("lang").to_pylist(), dtype=object)[aside if aside.any() else ~aside], test[2]
    cuts = {x: best_cut(score[lang == x], y[lang == x]) for x in sorted({x for x in lang if x is not None}) if (lang == x).sum() >= min_lang and 0 < y[lang == x].mean() < 1}
    return net, cuts


def score_toxicity(docs: DataFrame, labels: DataFrame, max_train: int = 8_000, max_bytes: int = 1 << 26) -> DataFrame:
    """``docs`` (with ``doc_id``, ``text`` and ``lang``) and ``_score, _lang_threshold, _flagged``.

    Learns only from labelled rows that are not held out; the score reads the text
    alone.  ``_lang_threshold`` is the cut calibrated for the row's language (0.5
    for a null or rare language) and ``_flagged`` compares the score with it.  Null
    and empty texts count as texts without words.  Without labels of both kinds all
    scores are the labels' mean (0.5 without labels).  Empty tables stay empty.  Input
    columns with these names are replaced.
    """
    docs = docs.drop("_score", "_lang_threshold", "_flagged")
    net, cuts = train(docs, labels, max_train, max_bytes)
    out = score_texts(docs, net.scorer())
    cut = F.lit(0.5)
    for lang, at in cuts.items():  # none without a column lang
        cut = F.when(F.col("lang") == lang, F.lit(at)).otherwise(cut)
    return out.withColumn("_lang_threshold", cut).withColumn("_flagged", F.col("_score") >= F.col("_lang_threshold"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = score_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"),
        F.col("_lang_threshold").alias("lang_threshold"), F.col("_flagged").alias("flagged"),
    )
