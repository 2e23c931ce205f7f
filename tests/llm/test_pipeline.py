"""Every stage of the pipeline, and the whole, against plain loops."""

import random

import pyarrow as pa
import pytest
from conftest import prose
from test_decontaminate import brute as held_share
from test_jaccard_join import brute as near
from test_line_dedup import BLANK, LOWER
from test_mixing import first_fit

import corpus_pipeline as P
from bitloom.llm import quality

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, _score string, _gone int, _items string, _kept int, size string, g int"
EXTRA = ("theirs", 1, "items", 2, "big", 3)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    vocabulary = [f"{a}{b}{c}" for a in "kmtr" for b in "aeiou" for c in ("nd", "st", "rk", "lo", "vi")]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    line = "this very line stands in many of the documents of the corpus"
    items = [(i, text(n)) for i, n in enumerate((12, 30, 60))] + [(7, None), (8, "")]
    base, texts = text(90), []
    for i in range(120):
        body = text(rng.randrange(5, 120))
        if i % 4 == 0:
            body = "### " + body.replace(" ", " ### ")
        if i % 9 == 0:
            body += "\n" + line + "\n" + text(8)
        if i % 13 == 0:
            body = text(9) + " " + items[i % 3][1] + " " + text(9)
        if 40 <= i < 60:
            words = base.split()
            words[rng.randrange(90)] = "changed"
            body = " ".join(words)
        texts.append((i, body, rng.choice(["en", "de", None]), rng.choice(["a", "b", None])))
    texts += [(200, None, "en", "a"), (201, "", None, None), (202, " \n ", "en", "b"), (203, base, "en", "a"), (203, base, "en", "a"), (204, text(30), "en", "a"), (204, text(30), "en", "a")]
    texts += [(None, base, "en", "b"), (None, None, None, None), (205, text(20_000), "de", "b")]
    rows = [(i, t, lang, source, len(t) if t is not None else None, *EXTRA) for i, t, lang, source in texts]
    labels = [(i, int(i % 4 != 0), 0) for i in range(0, 120)]
    path = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(rows, SHAPE).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def plain_lines(rows):
    key = lambda x: x.strip(BLANK).translate(LOWER)
    held: dict = {}
    for r in rows:
        for x in (r[1] or "").split("\n"):
            if len(key(x)) >= 40:
                held.setdefault(key(x), set()).add(r[0])
    keep = {k: max((i for i in ids if i is not None), default=None) for k, ids in held.items() if len(ids) >= 5}
    out = []
    for r in rows:
        t = r[1] and "\n".join(x for x in r[1].split("\n") if not (key(x) in keep and keep[key(x)] != r[0]))
        out.append((r[0], t, r[2], r[3], len(t) if t is not None else r[4], *r[5:]))
    return out


def plain_near(rows):
    label, out, seen = near([(r[0], r[1]) for r in rows], 5, 80, 100), [], set()
    for r in sorted(rows, key=lambda r: (r[1] is None, r[1] or "")):
        if r[0] is None or (label[r[0]] == r[0] and r[0] not in seen):
            out.append(r)
            seen.add(r[0])
    return out


def plain_leaks(rows, items):
    items = [t for _, t in items if t]
    return [r for r in rows if not any(round(held_share(r[1] or "", t), 12) >= 0.8 for t in items)]


def plain_mix(rows):
    taken, plan = first_fit([(r[0], r[1], r[3]) for r in rows])
    out = []
    for r, n in zip(rows, taken):
        if n:
            size, target = plan[r[3]]
            out.append((*r[:9], r[10], len((r[1] or "").split()), size, round(target, 6), n))
    return out


def listed(df, names):
    return sorted((tuple(round(r[c], 6) if isinstance(r[c], float) else r[c] for c in names) for r in df.collect()), key=str)


def test_stages_and_run(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    rows = [tuple(r) for r in docs.collect()]
    model = quality.train(docs.drop("_score"), spark.read.parquet(f"{folder}/labels.parquet"))
    sure = {}
    for r in rows:
        meta = pa.array([[None if r[4] is None else float(r[4])]], pa.list_(pa.float64()))
        sure[r[:5]] = model.score(pa.array([r[1]], pa.string()), meta)[0]
    assert all(abs(s - 0.3) > 1e-4 for s in sure.values())
    plain = [lambda rows: [r for r in rows if sure[r[:5]] >= 0.3], plain_lines, plain_near, lambda rows: plain_leaks(rows, items), plain_mix]
    here = docs
    for (name, stage), loop in zip(P.STAGES, plain):
        here = stage(spark, here, folder)
        before, rows = len(rows), loop(rows)
        last = name == "mixing"
        names = [c for c in docs.columns if c != "size"] + ["size", "source_size", "target", "taken"] if last else docs.columns
        assert here.columns == names
        assert listed(here, names) == sorted(rows, key=str), name
        assert name == "line_dedup" or len(rows) < before
        here = spark.createDataFrame(here.collect(), here.schema)
    assert listed(P.run(spark, folder), names) == sorted(rows, key=str)


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert P.run(spark, str(tmp_path)).collect() == []
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for stage in (P.keep_quality, P.drop_leaks):  # no labels, no benchmark: all stay
        assert stage(spark, docs, str(tmp_path)).count() == docs.count()
