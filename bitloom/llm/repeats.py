"""Removal of long repeated byte strings with a run-length index.

A string of 200 bytes belongs to the place of its smallest 64-byte hash (its
anchor), and equal strings have equal anchors at the same offset.  The strings of
one anchor form one context, at most 336 bytes of text, so each start of a string
lies in exactly one context and equal strings meet under one anchor hash.

1. One pass makes a row per context: anchor hash, context hash, place.  Contexts that
   are equal as a whole are copies: all their bytes go.  A task settles the copies
   that it sees itself; one of each goes on, so a passage that a third of all texts
   hold arrives at its anchor as a few rows a task.
2. These meet by anchor hash in sorted order, which settles the copies between tasks.
3. Where an anchor has several different contexts, one of each is fetched and a
   run-length index decides which of their strings match: the contexts' text is
   suffix-sorted, its Burrows-Wheeler transform is kept as runs with the text places
   of their ends, longest common prefixes are computed at the run ends only, and
   streaming through the text in order gives the matching statistics of all other
   places (each at least the one before less one, and equal to it inside a run).
4. The intervals of each text are merged and cut out.

Equality of contexts is decided by 128 bits of hashes, equality of strings inside
different contexts by their bytes.  An anchor with over ``GROUP`` different contexts
would make one task of them; there each string is a row of its own and equal ones are
counted by 128 bits of hashes, which spreads them over the cluster.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from bitloom.llm import kernels as K
from bitloom.llm.store import materialize

GRAM = 64
#: Bytes of a document handled at once; longer ones are cut, with overlap.
CHUNK = 1 << 19
#: Contexts of one anchor that one index takes; beyond, strings meet one by one, by 128 bits of hashes.
GROUP = 20_000
#: Bytes of context text in one index.
TEXT = 1 << 20
#: Contexts that a task compares with each other before they are shuffled.
MERGED = 1 << 18


def contexts(data: np.ndarray, offsets: np.ndarray, length: int):
    """(document, anchor hash, context hash, first start, last start) of every context."""
    n, grams = len(data), length - GRAM + 1
    if n < length:
        return None
    prefix = K.prefix_hash(data)
    at = np.arange(n - GRAM + 1)
    gram = K.span_hash(prefix, at, at + GRAM)
    # the smallest hash, leftmost on ties: 40 bits of hash above 24 bits of place
    low = (gram & K.U64(0xFFFFFFFFFF000000)) | at.astype(np.uint64)
    step = 1
    while step * 2 <= grams:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if grams > step:
        low = np.minimum(low[: len(low) - (grams - step)], low[grams - step :])
    anchor = (low & K.U64(0xFFFFFF)).astype(np.int64)
    doc = np.searchsorted(offsets, np.arange(len(anchor)), side="right") - 1
    valid = np.arange(len(anchor)) + length <= offsets[1:][np.minimum(doc, len(offsets) - 2)]
    starts = np.flatnonzero(valid)
    if not len(starts):
        return None
    anchor, doc = anchor[starts], doc[starts]
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    lo, hi = starts[first], starts[last]
    return doc[first], gram[anchor[first]], K.span_hash(prefix, lo, hi + length), lo - offsets[doc[first]], hi - offsets[doc[first]]


def _pieces(offsets: np.ndarray, length: int):
    """(first document, last document, begin, end) in bytes: runs of short documents, or pieces of a long one."""
    for a, b in K.spans(offsets, CHUNK):
        begin, end = int(offsets[a]), int(offsets[b])
        if end - begin <= 2 * CHUNK:
            yield a, b, begin, end
            continue
        for x in range(begin, end - length + 1, CHUNK):
            yield a, b, x, min(end, x + CHUNK + length - 1)


def _anchor_rows(length: int):
    """Rows ``settled, h, ctx, id, tag, lo, hi``: places that have a copy in the same task are
    settled, and one row of each context that is not settled stands for it at its anchor."""

    def merged(held):
        table = pa.concat_tables(held).combine_chunks()
        h, ctx = table.column(0).to_numpy(), table.column(1).to_numpy()
        order = np.lexsort((ctx, h))
        h, ctx = h[order], ctx[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (ctx[1:] != ctx[:-1])
        lone = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1] == 1
        for settled, rows in ((True, order[~lone]), (False, order[new])):
            part = table.take(pa.array(rows)).combine_chunks()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), settled)), *[c.combine_chunks() for c in part.columns]], names=["settled", *part.column_names])

    def run(batches):
        held, rows = [], 0
        for batch in K.pieces(batches, 2):
            data, offsets = K.utf8(batch.column(2))
            ids, tags = batch.column(0), batch.column(1)
            for a, b, begin, end in _pieces(offsets, length):
                local = np.clip(offsets[a : b + 1], begin, end) - begin
                got = contexts(data[begin:end], local, length)
                if got is None:
                    continue
                doc, gram, ctx, lo, hi = got
                shift = begin - int(offsets[a]) if b == a + 1 else 0
                take = pa.array(doc + a)
                columns = [pa.array(gram.view(np.int64)), pa.array(ctx.view(np.int64)), ids.take(take), tags.take(take), pa.array(lo + shift), pa.array(hi + shift)]
                held.append(pa.table(columns, names=["h", "ctx", "id", "tag", "lo", "hi"]))
                rows += len(doc)
                if rows >= MERGED:
                    yield from merged(held)
                    held, rows = [], 0
        if held:
            yield from merged(held)

    return run


PLACE = "h long, ctx long, id long, tag long, lo long, hi long"


def _meet(batches):
    """Rows sorted by (settled, h, ctx): ``kind`` 0 for contexts with equal copies, 1 for one of
    each of several different contexts under one anchor.  Holds one row between batches."""
    held, first_ctx = None, None

    def decide(table, more):
        nonlocal first_ctx
        h, ctx = table.column(0).to_numpy(), table.column(1).to_numpy()
        n = len(h)
        same_h = h[1:] == h[:-1]
        same = same_h & (ctx[1:] == ctx[:-1])
        copy = np.zeros(n, dtype=bool)
        copy[1:] |= same
        copy[:-1] |= same
        start = np.concatenate([[True], ~same_h])
        run = np.cumsum(start) - 1
        heads = ctx[start]
        if first_ctx is not None and first_ctx[0] == h[0]:
            heads = heads.copy()
            heads[0] = first_ctx[1]
        if copied is not None and copied[0] == h[0] and copied[1] == ctx[0]:
            copy[0] = True
        other = ctx != heads[run]
        other[:-1] |= same_h & ~same
        last = np.ones(n, dtype=bool)
        last[:-1] = ~same
        end = n - 1 if more else n
        first_ctx = (h[n - 1], heads[run[n - 1]])
        return copy[:end], (last & other)[:end], (h[n - 2], ctx[n - 2]) if more and n > 1 else copied, end

    copied = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        settled = table.column(0).to_numpy()
        table = table.drop_columns("settled")
        yield from _kinds(table, settled, np.zeros(len(settled), bool))
        table = table.filter(pa.array(~settled))
        if not len(table):
            continue
        table = table if held is None else pa.concat_tables([held, table])
        copy, amb, copied, end = decide(table, True)
        held = table.slice(end)
        yield from _kinds(table, copy, amb)
    if held is not None:
        copy, amb, copied, end = decide(held, False)
        yield from _kinds(held, copy, amb)


def _kinds(table, copy, amb):
    for kind, mask in ((0, copy), (1, amb)):
        if mask.any():
            part = table.take(pa.array(np.flatnonzero(mask))).combine_chunks()
            columns = [part.column(i).combine_chunks() for i in range(6)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), kind, np.int32)), *columns], names=["kind", "h", "ctx", "id", "tag", "lo", "hi"])


class RunLengthIndex:
    """Run-compressed Burrows-Wheeler transform of context texts with samples at run ends.

    Kept are, for each run, its letter (``chars``) and length (``lengths``), the text places of
    its first and last suffix, and the common prefix of its first suffix with the one above."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        """``data`` joins the contexts; each gets an end mark of its own after it."""
        n, docs = len(data) + len(offsets) - 1, len(offsets) - 1
        text = np.full(n + 8, 255, dtype=np.uint8)
        self.begin, self.n = offsets[:-1] + np.arange(docs), n
        text[K.arange_runs(self.begin, np.diff(offsets))] = data
        doc = np.repeat(np.arange(docs, dtype=np.int32), np.diff(offsets) + 1)
        left = ((self.begin + np.diff(offsets))[doc] - np.arange(n)).astype(np.int32)  # bytes before the end mark
        order, ranks = _suffixes(text, left, doc)
        text = text[:n]
        before = text[order - 1]
        run = np.ones(n, dtype=bool)  # a new run starts; end marks never continue one
        run[1:] = (before[1:] != before[:-1]) | (before[1:] == 255)
        heads = np.flatnonzero(run)
        self.chars, self.lengths = before[heads], np.diff(np.append(heads, n))
        self.first, self.last = order[heads], order[np.append(heads[1:], n) - 1]
        self.lcp = np.concatenate([[0], _common_prefix(text, left, ranks, self.last[:-1], self.first[1:])])

    def matching_statistics(self) -> np.ndarray:
        """Length of the longest match of each place with any other place of the text."""
        out, places = np.zeros(self.n, dtype=np.int64), np.arange(self.n)
        # neighbours above: the first of the order has none; neighbours below: the last has none
        for mine, lcp in ((self.first, self.lcp), (self.last, np.append(self.lcp[1:], 0))):
            known = np.full(self.n, -1, dtype=np.int64)
            known[mine] = lcp
            at = np.maximum.accumulate(np.where(known >= 0, places, -1))
            out = np.maximum(out, np.where(at >= 0, known[at] - (places - at), 0))
        return out


def _suffixes(text: np.ndarray, left: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes in order, and their ranks by the first 8, 16, 32, ... bytes."""
    n = len(left)
    packed = np.zeros(n, dtype=np.uint64)
    for j in range(8):
        packed = (packed << np.uint64(8)) | np.where(left >= j, text[j : n + j], np.uint8(0))
    order = np.argsort(packed).astype(np.int32)
    new = np.ones(n + 1, dtype=bool)
    new[1:n] = packed[order[1:]] != packed[order[:-1]]
    del packed
    # the rank of a suffix is the place of its group's first one, so settled suffixes keep theirs
    rank = np.empty(n, dtype=np.int32)
    rank[order] = np.maximum.accumulate(np.where(new[:n], np.arange(n, dtype=np.int32), 0))
    ranks, width = [rank.copy()], 8
    while len(slots := np.flatnonzero(~(new[:-1] & new[1:]))):
        at = order[slots]
        ended = left[at] < width  # the end mark decides: each is a letter of its own
        ahead = np.where(ended, n + doc[at], rank[np.minimum(at + width, n - 1)])
        key = (rank[at].astype(np.uint64) << np.uint64(32)) | ahead.astype(np.uint64)
        sub = np.argsort(key)
        key, at = key[sub], at[sub]
        order[slots] = at
        fresh = np.ones(len(at), dtype=bool)
        fresh[1:] = key[1:] != key[:-1]
        new[slots] |= fresh
        rank[at] = slots[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]
        ranks.append(rank.copy())
        width *= 2
    return order, ranks


def _common_prefix(text, left, ranks, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Longest common prefixes of pairs of suffixes, by halving the sorted depths."""
    most, n = np.minimum(left[a], left[b]).astype(np.int64), len(left)
    a, b, total = a.astype(np.int64), b.astype(np.int64), np.zeros(len(a), dtype=np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        width, rank = 8 << level, ranks[level]
        same = (total < most) & (rank[np.minimum(a, n - 1)] == rank[np.minimum(b, n - 1)])
        for x in (total, a, b):
            x[same] += width
    for _ in range(7):  # the last bytes one by one
        same = (total < most) & (text[np.minimum(a, n - 1)] == text[np.minimum(b, n - 1)])
        for x in (total, a, b):
            x[same] += 1
    return np.minimum(total, most)


def _matches(length: int):
    """Contexts sorted by anchor: intervals ``(id, tag, from, to)`` of strings that match."""

    def decide(table):
        data, offsets = K.utf8(table.column(4).combine_chunks())
        index = RunLengthIndex(data, offsets)
        stats = index.matching_statistics()
        room = np.diff(offsets) - length + 1  # starts in each context
        starts = K.arange_runs(index.begin, room)
        long_ = stats[starts] >= length
        ctx = np.repeat(np.arange(len(room)), room)
        local = starts - index.begin[ctx]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], long_, [False]]).astype(np.int8)))
        # a run of matching starts never leaves its context
        first, last = edge[::2], edge[1::2] - 1
        parts = []
        for a, b in zip(first.tolist(), last.tolist()):
            if ctx[a] == ctx[b]:
                parts.append((ctx[a], local[a], local[b]))
            else:
                cut = np.flatnonzero(np.diff(ctx[a : b + 1])) + a
                for x, y in zip([a, *(cut + 1).tolist()], [*cut.tolist(), b]):
                    parts.append((ctx[x], local[x], local[y]))
        if not parts:
            return None
        c, x, y = (np.array(z) for z in zip(*parts))
        take = pa.array(c)
        lo = table.column(3).to_numpy()[c]
        return pa.RecordBatch.from_arrays([table.column(1).combine_chunks().take(take), table.column(2).combine_chunks().take(take), pa.array(lo + x), pa.array(lo + y + length)], names=["id", "tag", "a", "b"])

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            h = table.column(0).to_numpy()
            if table.nbytes < 2 * TEXT or not len(h):
                held = table
                continue
            # whole anchors, about TEXT bytes at a time; the last one may go on
            starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            size = np.concatenate([[0], np.cumsum(pc.binary_length(table.column(4)).to_numpy())])[starts]
            cuts = [0, *starts[1:][size[1:] // TEXT != size[:-1] // TEXT].tolist()]
            for x, y in zip(cuts[:-1], cuts[1:]):
                if (out := decide(table.slice(x, y - x).combine_chunks())) is not None:
                    yield out
            held = table.slice(cuts[-1])
        if held is not None and held.num_rows and (out := decide(held.combine_chunks())) is not None:
            yield out

    return run


#: A wanted context as bytes: anchor hash, place, length.
WANTED = np.dtype([("h", "<i8"), ("lo", "<i4"), ("size", "<u2")])


def _packed(batches):
    """Lists of wanted contexts as bytes, a third of their size as rows."""
    for batch in batches:
        lists = batch.column(2)
        rows, counts = lists.flatten(), np.diff(lists.offsets.to_numpy())
        made = np.zeros(len(rows), dtype=WANTED)
        h, lo, to = (rows.field(i).to_numpy() for i in range(3))
        made["h"], made["lo"], made["size"] = h, lo, to - lo
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), K.blobs(made.view(np.uint8), counts * WANTED.itemsize)], names=["id", "tag", "wanted"])


def _fetch(batches):
    """The bytes of each wanted context of a text."""
    for batch in K.pieces(batches, 2):
        data, offsets = K.utf8(batch.column(2))
        wanted, ends = K.utf8(batch.column(3))
        rows = np.frombuffer(wanted.tobytes(), dtype=WANTED)
        of = np.repeat(np.arange(batch.num_rows), np.diff(ends) // WANTED.itemsize)
        h, lo, size = rows["h"].copy(), rows["lo"].astype(np.int64), rows["size"].astype(np.int64)
        body = data[K.arange_runs(offsets[of] + lo, size)]
        take = pa.array(of)
        yield pa.RecordBatch.from_arrays([pa.array(h), batch.column(0).take(take), batch.column(1).take(take), pa.array(lo), K.blobs(body, size)], names=["h", "id", "tag", "lo", "bytes"])


def _cut(schema, text_at: int):
    def run(batches):
        for batch in K.pieces(batches, text_at):
            data, offsets = K.utf8(batch.column(text_at))
            marks = batch.column(batch.num_columns - 1)
            counts = np.diff(marks.offsets.to_numpy()) if len(marks) else np.zeros(0, np.int64)
            code = marks.flatten().to_numpy()
            start = offsets[np.repeat(np.arange(batch.num_rows), counts)] + code // 1024
            change = np.zeros(len(data) + 1, dtype=np.int32)
            np.add.at(change, start, 1)
            np.add.at(change, start + code % 1024, -1)
            gone = np.cumsum(change[:-1]) > 0
            kept = np.concatenate([[0], np.cumsum(~gone)])[offsets]
            # maximal removed runs: a run begins at a removed byte that follows a kept one or a text's begin
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            heads = offsets[:-1][offsets[:-1] < len(data)]
            begins[heads] |= gone[heads]
            ends = gone.copy()
            ends[:-1] &= ~gone[1:]
            tails = offsets[1:][offsets[1:] > 0] - 1
            ends[tails] |= gone[tails]
            a, b = np.flatnonzero(begins), np.flatnonzero(ends) + 1
            doc = np.searchsorted(offsets, a, side="right") - 1
            spans = pa.StructArray.from_arrays([pa.array(a - offsets[doc]), pa.array(b - offsets[doc])], names=["start", "end"])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32)), spans)
            body = K.blobs(data[~gone], np.diff(kept))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], body, lists], names=schema.names)

    return run


def remove_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``_kept`` (the bytes that stay) and ``_spans`` (the removed runs of bytes).

    A byte goes if a ``length``-byte string that covers it also starts at another
    place, in this text or in another.  Texts are UTF-8 bytes; removal may split a
    character, so ``_kept`` is binary.  ``length`` is from 64 to 500.  A null text is empty.  Repeated rows are
    texts like any others, so each is the other's copy.  A null id is an id of its
    own.  Texts shorter than ``length`` stay whole; an empty table stays empty.  Input
    columns ``_kept`` and ``_spans`` are replaced.
    """
    docs = docs.drop("_kept", "_spans")
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 62))).alias("id"), F.xxhash64(text).alias("tag"), text.alias("text"))
    long_ = keyed.where(F.octet_length("text") >= length)
    met = long_.mapInArrow(_anchor_rows(length), "settled boolean, " + PLACE)
    met = met.repartition(F.when(F.col("settled"), F.xxhash64("id", "lo")).otherwise(F.col("h"))).sortWithinPartitions("settled", "h", "ctx")
    met = materialize(met.mapInArrow(_meet, "kind int, " + PLACE), "contexts")

    wanted = met.where("kind = 1")
    crowds = materialize(wanted.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > GROUP), "crowds")
    wanted = wanted.join(crowds, "h", "left").select("h", "id", "tag", "lo", (F.col("hi") + length).alias("to"), F.col("n").isNotNull().alias("crowd"))
    per_text = wanted.groupBy("id", "tag").agg(F.collect_list(F.struct("h", "lo", "to")).alias("wanted"))
    per_text = materialize(per_text.mapInArrow(_packed, "id long, tag long, wanted binary"), "wanted")
    if wanted.count() <= 2_000_000:  # 14 bytes each, 28 MB at most
        per_text = F.broadcast(per_text)
    texts = long_.join(per_text, ["id", "tag"]).select("id", "tag", "text", "wanted")
    fetched = texts.mapInArrow(_fetch, "h long, id long, tag long, lo long, bytes binary")
    fetched = materialize(fetched.dropDuplicates(["id", "tag", "lo"]), "fetched")
    usual = fetched.join(crowds.select("h"), "h", "left_anti").repartition("h").sortWithinPartitions("h")
    marks = usual.mapInArrow(_matches(length), "id long, tag long, a long, b long")
    # anchors with very many different contexts: every string is a row of its own
    starts = fetched.join(F.broadcast(crowds.select("h")) if crowds.count() <= 100_000 else crowds.select("h"), "h", "left_semi")
    starts = starts.select("id", "tag", "lo", "bytes", F.explode(F.sequence(F.lit(0), F.octet_length("bytes") - length)).alias("at"))
    starts = starts.select("id", "tag", (F.col("lo") + F.col("at")).alias("a"), F.substring("bytes", F.col("at") + 1, F.lit(length)).alias("s"))
    starts = starts.select("id", "tag", "a", F.xxhash64("s").alias("s1"), F.xxhash64(F.lit(7), "s").alias("s2"))
    twice = starts.groupBy("s1", "s2").agg(F.count("*").alias("n")).where("n > 1").select("s1", "s2")
    marks = marks.union(starts.join(twice, ["s1", "s2"], "left_semi").select("id", "tag", "a", (F.col("a") + length).alias("b")))
    marks = marks.union(met.where("kind = 0").select("id", "tag", F.col("lo").alias("a"), (F.col("hi") + length).alias("b")))
    marks = materialize(marks.groupBy("id", "tag").agg(F.collect_set(F.col("a") * 1024 + (F.col("b") - F.col("a"))).alias("_marks")), "marks")

    rows = docs.select(F.struct("*").alias("_row"))
    given = F.coalesce(F.col("_row")[text_col], F.lit(""))
    rows = rows.withColumn("id", F.coalesce(F.col("_row")[id_col].cast("long"), F.lit(-(1 << 62)))).withColumn("tag", F.xxhash64(given))
    plain = [F.col("_row")[c].alias(f"c{i}") for i, c in enumerate(docs.columns)]
    joined = rows.join(marks, ["id", "tag"], "left").select(*plain, F.coalesce("_marks", F.array().cast("array<bigint>")).alias("m"))
    spans = ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))
    schema = StructType([*docs.schema.fields, StructField("_kept", BinaryType()), StructField("_spans", spans)])
    return joined.mapInArrow(_cut(schema, docs.columns.index(text_col)), schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = remove_repeats(docs)
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    return out.select(
        "doc_id", size.alias("n_bytes"), (size - F.octet_length("_kept")).alias("n_removed"), F.size("_spans").cast("long").alias("n_spans"), F.sha2("_kept", 256).alias("kept_sha256")
    )
