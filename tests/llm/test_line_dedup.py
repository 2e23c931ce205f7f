import hashlib

from pyspark.sql import functions as F

from bitloom.llm.line_dedup import dedup_lines

BLANK = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_chars, min_docs):
    key = lambda line: line.strip(BLANK).translate(LOWER)
    held = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                held.setdefault(key(line), set()).add(i)
    keep = {k: max((x for x in ids if x is not None), default=None) for k, ids in held.items() if len(ids) >= min_docs}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (key(x) in keep and keep[key(x)] != i)]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_against_brute_force(spark, odd_docs):
    line = "This Line Stands in Many of the documents, éÉ and all"
    more = [(200 + i, f"a{i}\n  {line if i % 2 else line.replace('This', 'THIS')}\t\nb\n{line}\n", "a", "x", 1, 2) for i in range(7)]
    more += [(300, line.replace("éÉ", "éé"), "a", "x", 1, 2), (206, line, "b", "x", 1, 2)]
    docs = odd_docs.union(spark.createDataFrame(more, odd_docs.schema))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for chars, many in ((40, 5), (1, 2)):
        out = dedup_lines(docs, chars, many)
        assert out.columns[:6] == docs.columns
        got = [(r["doc_id"], r["_n_lines"], r["_n_dropped"], r["x"]) for r in out.withColumn("x", F.sha2(F.coalesce("text", F.lit("")), 256)).collect()]
        assert sorted(got, key=str) == brute(rows, chars, many)


def test_empty_table(no_docs):
    assert dedup_lines(no_docs).collect() == []


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a\nb", "mine", 2, 3)], "doc_id long, text string, _n_lines string, _id int, _gone int")
    (row,) = dedup_lines(df).collect()
    assert (row["_n_lines"], row["_n_dropped"], row["_id"], row["_gone"], row["text"]) == (2, 0, 2, 3, "a\nb")
