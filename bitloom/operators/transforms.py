"""Reversible byte transforms of whole texts, inside the row.

A plan is a tuple of steps, each a name and its numbers; every step maps the bytes of
a text to as many bytes and has an inverse.  Spark hands Arrow batches of texts to a
kernel that takes them in runs of about ``SPAN`` bytes and gives each run on as a batch
of its own; a step is a few numpy passes over one text that hold a small multiple of its
bytes, so no byte is exploded, sorted or shuffled.
Null texts count as empty; empty ones stay empty.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

#: Bytes and texts of a run; a longer text is a run of its own.
SPAN, MOST = 1 << 18, 2048
#: Bytes of a long text whose wider working arrays are held at once.
PIECE = 1 << 16


class Texts:
    """Joined bytes of a run of texts, and where each begins."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self.sizes = np.diff(offsets)

    def __iter__(self) -> Iterator[np.ndarray]:
        at = self.offsets.tolist()
        return (self.data[a:b] for a, b in zip(at[:-1], at[1:]))

    def changed(self, change: Callable) -> "Texts":
        """Each text after ``change``, which keeps its size."""
        return Texts(np.concatenate([change(x) for x in self]), self.offsets)


def runs_of(column) -> Iterator[Texts]:
    """The texts of a binary column in runs of about SPAN bytes."""
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = min(max(at + 1, int(np.searchsorted(offsets, offsets[at] + SPAN, side="right")) - 1), at + MOST)
        yield Texts(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def blobs(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary column of joined bytes."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def counts_of(t: Texts) -> np.ndarray:
    """How often each byte occurs in each text: 256 numbers a row."""
    if len(t.sizes) > 1:
        return np.bincount(np.repeat(np.arange(len(t.sizes)) * 256, t.sizes) + t.data, minlength=len(t.sizes) * 256).reshape(-1, 256)
    out = np.zeros((1, 256), dtype=np.int64)
    for at in range(0, len(t.data), PIECE):
        out[0] += np.bincount(t.data[at : at + PIECE], minlength=256)
    return out


def _before(x: np.ndarray, period: int) -> np.ndarray:
    """The byte ``period`` places before each, 0 where there is none."""
    out = np.zeros_like(x)
    out[period:] = x[:-period]
    return out


def _running(x: np.ndarray, period: int, total: Callable) -> np.ndarray:
    """Running totals along the places of one residue."""
    lanes = np.zeros(-(-len(x) // period) * period, dtype=np.uint8)
    lanes[: len(x)] = x
    return total(lanes.reshape(-1, period)).ravel()[: len(x)]


def delta(x: np.ndarray, period: int = 1) -> np.ndarray:
    """Each byte less the one ``period`` before, modulo 256."""
    return x - _before(x, period)


def undo_delta(x: np.ndarray, period: int = 1) -> np.ndarray:
    return _running(x, period, lambda v: np.cumsum(v, axis=0, dtype=np.uint8))


def xor(x: np.ndarray, period: int = 1) -> np.ndarray:
    return x ^ _before(x, period)


def undo_xor(x: np.ndarray, period: int = 1) -> np.ndarray:
    return _running(x, period, lambda v: np.bitwise_xor.accumulate(v, axis=0))


def gather(x: np.ndarray, period: int) -> np.ndarray:
    """Places of residue 0 first, then those of residue 1, and so on."""
    return np.concatenate([x[i::period] for i in range(max(1, min(period, len(x))))])


def undo_gather(x: np.ndarray, period: int) -> np.ndarray:
    out, at = np.empty_like(x), 0
    for i in range(min(period, len(x))):
        n = -(-(len(x) - i) // period)
        out[i::period] = x[at : at + n]
        at += n
    return out


def heads(n: Column, period: int, head: int) -> Column:
    """Bytes that stand in the first ``head`` places of their period."""
    return F.floor(n / period) * head + F.least(F.lit(head), n % period)


def _heads(n: int, period: int, head: int) -> int:
    return n // period * head + min(head, n % period)


def _in_head(n: int, period: int, head: int) -> np.ndarray:
    return np.tile(np.arange(period) < head, -(-n // period))[:n]


def head_tail(x: np.ndarray, period: int, head: int) -> np.ndarray:
    """The first ``head`` bytes of every period, then the others."""
    first = _in_head(len(x), period, head)
    return np.concatenate([x[first], x[~first]])


def undo_head_tail(x: np.ndarray, period: int, head: int) -> np.ndarray:
    first, n = _in_head(len(x), period, head), _heads(len(x), period, head)
    out = np.empty_like(x)
    out[first], out[~first] = x[:n], x[n:]
    return out


def _on_tail(change: Callable) -> Callable:
    """A change of the part behind the heads, as a text of its own."""

    def run(x: np.ndarray, period: int, head: int, *numbers: int) -> np.ndarray:
        n = _heads(len(x), period, head)
        return np.concatenate([x[:n], change(x[n:], *numbers)])

    return run


def bit_planes(x: np.ndarray) -> np.ndarray:
    """Bit 0 of all bytes, then bit 1 of all bytes, and so on, eight to a byte, low bit first."""
    out, at, left = np.empty_like(x), 0, x[:0]
    for i in range(8):
        bits = np.concatenate([left, x >> i & 1])
        whole = len(bits) // 8
        out[at : at + whole] = np.packbits(bits[: whole * 8], bitorder="little")
        at, left = at + whole, bits[whole * 8 :]
    return out


def undo_bit_planes(x: np.ndarray) -> np.ndarray:
    n, out = len(x), np.zeros_like(x)
    for i in range(8):
        at = i * n // 8
        bits = np.unpackbits(x[at : -(-(i + 1) * n // 8)], bitorder="little")
        out |= bits[i * n - at * 8 :][:n] << i
    return out


#: Steps by name: forth and back.
STEPS = {
    "delta": (delta, undo_delta), "xor": (xor, undo_xor), "gather": (gather, undo_gather), "head-tail": (head_tail, undo_head_tail), "bit-planes": (bit_planes, undo_bit_planes),
    "tail-delta": (_on_tail(delta), _on_tail(undo_delta)), "tail-xor": (_on_tail(xor), _on_tail(undo_xor)), "tail-gather": (_on_tail(gather), _on_tail(undo_gather)),
}


def applied(x: np.ndarray, plan) -> np.ndarray:
    for name, *numbers in plan:
        x = STEPS[name][0](x, *numbers)
    return x


def undone(x: np.ndarray, plan) -> np.ndarray:
    for name, *numbers in reversed(plan):
        x = STEPS[name][1](x, *numbers)
    return x


def byte_texts(df: DataFrame, key: Column, text: Column) -> DataFrame:
    """``k, bytes``: the UTF-8 bytes of each text."""
    return df.select(key.alias("k"), F.encode(F.coalesce(text, F.lit("")), "UTF-8").alias("bytes"))


def _added(df: DataFrame, source: str, changes: dict[str, Callable]) -> DataFrame:
    """``df`` with columns by name, each made from the one before it, the first from ``source``."""
    place, schema = df.columns.index(source), StructType([*df.schema.fields, *[StructField(name, BinaryType()) for name in changes]])

    def run(batches):
        for batch in batches:
            at = 0
            for t in runs_of(batch.column(place)):
                n, made = len(t.sizes), []
                for change in changes.values():
                    t = t.changed(change)
                    made.append(blobs(t.data, t.sizes))
                yield pa.RecordBatch.from_arrays([*batch.slice(at, n).columns, *made], names=schema.names)
                at += n

    return df.mapInArrow(run, schema)


def transformed(df: DataFrame, plan, source: str = "bytes", name: str = "made") -> DataFrame:
    """``df`` with the bytes of ``source`` after the plan."""
    return _added(df, source, {name: lambda x: applied(x, plan)})


def restored(df: DataFrame, plan, source: str = "made", name: str = "back") -> DataFrame:
    """``df`` with the bytes of ``source`` before the plan."""
    return _added(df, source, {name: lambda x: undone(x, plan)})


def round_trip(df: DataFrame, plan, source: str = "bytes", made: str = "made", back: str = "back") -> DataFrame:
    """``df`` with the bytes of ``source`` after the plan, and these before it, in one pass."""
    return _added(df, source, {made: lambda x: applied(x, plan), back: lambda x: undone(x, plan)})


#: Plans that every text tries, in the order that settles ties.
PLANS = {"identity": (), "delta": (("delta",),), "xor": (("xor",),), "delta-4": (("delta", 4),), "xor-4": (("xor", 4),), "bit-planes": (("bit-planes",),)}
PERIODS = range(2, 17)
#: Bytes that naming a plan costs.
NAMED = 28


def _same(texts: list[np.ndarray], samples: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text and period: probed places whose byte equals the one a period before, and places probed."""
    same, total = (np.zeros((len(texts), len(PERIODS)), dtype=np.int64) for _ in range(2))
    for i, x in enumerate(texts):
        n = len(x)
        for j, p in enumerate(PERIODS):
            step = max(1, (n - p) // max(1, min(samples, n - 2)))
            now = x[p::step]
            total[i, j] = len(now)
            same[i, j] = np.count_nonzero(now == x[: max(0, n - p) : step])
    return same, total


def _top(same: np.ndarray, total: np.ndarray, top: int) -> np.ndarray:
    """Places of the best periods in PERIODS; ties go to the smaller."""
    return np.argsort(-(same / np.maximum(total, 1)), axis=1, kind="stable")[:, :top]


def period_scores(df: DataFrame, top: int = 3, least: int = 2048, samples: int = 20_000) -> DataFrame:
    """``k, period, same, total, place``: the periods at which bytes most often equal the byte one period before.

    Texts under ``least`` bytes have none; long ones are probed at every step-th place.
    Ties go to the smaller period."""
    kind = df.schema["k"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            column, at = batch.column(1), 0
            for t in runs_of(column):
                same, total = _same(list(t), samples)
                best = _top(same, total, top)
                rows = np.repeat(np.arange(len(best)), top)
                best = best.ravel()
                place = np.tile(np.arange(1, top + 1), len(t.sizes))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows + at)), pa.array(np.array(PERIODS)[best].astype(np.int32)), pa.array(same[rows, best]), pa.array(total[rows, best]), pa.array(place.astype(np.int32))],
                    names=["k", "period", "same", "total", "place"],
                )
                at += len(t.sizes)

    return df.select("k", "bytes").where(F.octet_length("bytes") >= least).mapInArrow(run, f"k {kind}, period int, same long, total long, place int")


def _id_sizes(t: Texts) -> np.ndarray:
    """Bytes of each text as fixed-width ids of its distinct bytes, with their table."""
    symbols = (counts_of(t) > 0).sum(axis=1)
    bits = np.maximum(1, np.ceil(np.log2(np.maximum(symbols, 1)))).astype(np.int64)
    return (t.sizes * bits + 7) // 8 + symbols


def _some(t: Texts, rows: np.ndarray) -> Texts:
    if len(rows) == len(t.sizes):
        return t
    return Texts(np.concatenate([t.data[a:b] for a, b in zip(t.offsets[rows].tolist(), t.offsets[rows + 1].tolist())]), np.concatenate([[0], np.cumsum(t.sizes[rows])]))


def plan_sizes(df: DataFrame, top: int = 3, least: int = 2048, samples: int = 20_000) -> DataFrame:
    """``k, plans``: for each text (empty ones have none) an array of ``size, rank, plan``: its bytes as
    fixed-width ids after each plan of PLANS, and after residuals at its best periods."""
    kind, names = df.schema["k"].dataType.simpleString(), list(PLANS)

    def run(batches):
        for batch in batches:
            column, at = batch.column(1), 0
            for t in runs_of(column):
                rows = [(np.arange(len(t.sizes)), _id_sizes(t.changed(lambda x: applied(x, PLANS[p]))), i, p) for i, p in enumerate(names)]
                long_ = np.flatnonzero(t.sizes >= least)
                if len(long_):
                    best = _top(*_same(list(_some(t, long_)), samples), top)
                    for j, p in enumerate(PERIODS):
                        who, place = np.nonzero(best == j)
                        if len(who):
                            part = _some(t, long_[who])
                            for i, name in enumerate(("delta", "xor")):
                                rows.append((long_[who], _id_sizes(part.changed(lambda x: applied(x, ((name, p),)))), len(names) + 2 * place + i, f"{name}-{p}"))
                owner = np.concatenate([r for r, *_ in rows])
                order = np.argsort(owner, kind="stable")
                size = np.concatenate([s for _, s, *_ in rows])[order]
                rank = np.concatenate([np.broadcast_to(x, len(r)) for r, _, x, _ in rows])[order].astype(np.int32)
                plan = np.array([p for r, _, _, p in rows for _ in range(len(r))], dtype=object)[order]
                items = pa.StructArray.from_arrays([pa.array(size), pa.array(rank), pa.array(plan, pa.string())], names=["size", "rank", "plan"])
                offsets = np.searchsorted(owner[order], np.arange(len(t.sizes) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(t.sizes)), pa.ListArray.from_arrays(pa.array(offsets), items)], names=["k", "plans"])
                at += len(t.sizes)

    return df.select("k", "bytes").where(F.octet_length("bytes") > 0).mapInArrow(run, f"k {kind}, plans array<struct<size:bigint,rank:int,plan:string>>")


def best_plan(sizes: DataFrame) -> DataFrame:
    """The plan of least size for each text; ties go to the earlier plan.  A plan must beat the
    text as it is by more than the bytes that naming it costs (``beats``)."""
    best = F.array_min("plans")
    plain = F.element_at(F.filter("plans", lambda x: x["plan"] == "identity"), 1)["size"]
    out = sizes.select("k", best["plan"].alias("plan"), best["size"].alias("size"), plain.alias("plain"))
    return out.withColumn("beats", F.col("size") + NAMED < F.col("plain"))
