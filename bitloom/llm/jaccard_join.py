"""N-gram Jaccard self-join by universe partition and the pigeonhole principle.

Sets with Jaccard similarity t or more differ in at most H tokens.  Tokens are
hashed into m = H + 1 + x segments, where H belongs to the larger set's size band;
two such sets agree on at least x + 1 whole segments.  A segment without tokens is
no evidence, and all sets without tokens there would meet, so it is not indexed:
the x spare segments of a band pay for up to x empty ones.  A set with more than x
empty segments also indexes the one-deletion neighbourhoods of its segments (two
sets that share empty segments have few differences left for the others, so some
segment differs by one token at most), and one with so many that even this may
fail indexes its empty segments as well.  The spare x of a band is chosen by the
expected number of index rows.

Proof of the second step.  Let e segments be empty in both sets, f in one of them.
The other m - e - f segments share at most H - f differences.  If all differed by
two or more, 2(m - e - f) <= H - f, so H + 2 + 2x <= 2e + f, the number of empty
segments of the two sets together.  Sets with at least x + 2 empty segments index
these too, and in such a pair the smaller number is above x + 1.

Jobs: one pass over the texts makes size, a 128-bit digest of the set and a parity
sketch; equal sets are folded by digest; a second pass makes the index rows of one
text of each set.  A task merges its rows of one key before the shuffle, and the
reducer streams sorted rows, holding ``HELD`` ids of a key at most.  Groups with
the same members are folded, long ones by their smallest member.  Pairs in a group
that the sketch can't refute (the parity sketch never counts more differences than
there are) form coarse classes; inside these, whole sets are compared exactly.

Large groups.  No task compares more than two blocks of about ``BLOCK`` sets.  The
blocks of a larger group first meet some of its members, the pivots: n sets cost n
rows and a few pivots a block.  What the pivots link needs no more comparisons among
itself; only sets in different components still meet, block by block, so a group of
near copies costs rows in proportion to its size, times the blocks of sets that no
pivot links.  Where that is still more than ``FEW`` blocks a set (unlike sets that have a
long passage in common, next to none of which are linked), the group's sets meet again
by their rarest tokens: of a set of n, linked ones share ceil(num * n / den) tokens or
more, so two linked sets share one of the first n + 1 - ceil(num * n / den) in any order
that holds for all sets.  Tokens that many of these sets hold come last in it, so a
passage in common is no longer a place to meet.  Groups of a token that are large
nevertheless are compared block by block.
"""

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.llm import kernels as K
from bitloom.llm.components import connected_components
from bitloom.llm.store import drop, materialize

#: Sets of one side of a comparison.
BLOCK = 256
#: Ids of one key that a task holds; longer groups are named by their smallest id.
HELD = 256
#: Pivots of a large group in each round.
PIVOTS = 24
#: Blocks that a set of a large group meets on average, beyond which the group's sets meet by rare tokens.
FEW = 4
#: Tokens put last in the order of rarity, the commonest that there are, and how often one is seen at least.
LISTED, OFTEN = 1 << 17, 8
#: Index rows that a task merges by key before they are shuffled.
MERGED = 1 << 18
BAND = 1.4


class Bands:
    """Size bands and the partition of each: ``(low, high, H, x, m)``."""

    def __init__(self, num: int, den: int, means: dict[int, float] | None = None):
        #: sets link when den * |intersection| >= num * |union|; ``means`` has mean sizes by band
        self.num, self.den, self.means = num, den, means or {}
        self.edges = [1]
        while self.edges[-1] < 1 << 40:
            self.edges.append(max(self.edges[-1] + 1, int(self.edges[-1] * BAND)))
        self.edges = np.array(self.edges)
        self.plans: dict[int, tuple[int, int, int]] = {}

    def distance(self, a, b):
        """Most differences of two linked sets of these sizes."""
        return (a + b) * (self.den - self.num) // (self.den + self.num)

    def of(self, size):
        return np.searchsorted(self.edges, size, side="right") - 1

    def plan(self, band: int) -> tuple[int, int, int]:
        """H, spare segments and segments of a band: the spare with the fewest expected index rows
        of a set of the band's mean size, as counted, or of a middling set where none was."""
        if band not in self.plans:
            low, high = int(self.edges[band]), int(self.edges[band + 1]) - 1
            most = self.distance(high, high)
            mid = self.means.get(band, (low * high) ** 0.5)

            def cost(x: int) -> float:
                m = most + 1 + x
                return m + above(x, m * math.exp(-mid / m)) * mid

            # beyond a few dozens the best spare lies some spreads above the expected empty segments
            around = (most + 1) * math.exp(-mid / (most + 1))
            steps = {x for x in range(64)} | {int(around * (1 + i / 16) + 6 * around**0.5 * i / 16) for i in range(17)}
            x = min((x for x in steps if x < 2 + most // 8 + 8), key=lambda x: (cost(x), x))
            self.plans[band] = (most, x, most + 1 + x)
        return self.plans[band]


def above(x: int, mean: float) -> float:
    """Chance that a Poisson variable exceeds x: the sum for small ones, else the normal limit."""
    if mean > 50:
        return 0.5 * math.erfc((x + 0.5 - mean) / (2 * mean) ** 0.5)
    term = total = math.exp(-mean)
    for i in range(1, x + 1):
        term *= mean / i
        total += term
    return max(0.0, 1 - total)


def index_rows(tokens: np.ndarray, bands: Bands) -> np.ndarray:
    """Hashes under which one set (sorted distinct 64-bit tokens) meets its partners."""
    n = len(tokens)
    own = int(bands.of(n))
    # the larger set's band decides the partition: own band, and those above that may hold a partner
    out = []
    largest = n * bands.den // bands.num
    for band in range(own, int(bands.of(largest)) + 1):
        most, spare, m = bands.plan(band)
        if most == 0:
            continue  # linked sets of this band are equal
        out.append(_segments(tokens, band, most, spare, m))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def _segments(tokens, band, most, spare, m):
    scrambled = K.mix(tokens ^ K.U64(0x2545F4914F6CDD1D))
    seg = (scrambled >> K.U64(32)) * K.U64(m) >> K.U64(32)
    seg = seg.astype(np.int64)
    salt = K.mix(np.arange(m, dtype=np.uint64) + K.U64(band * 0x1000003D))
    sums = np.zeros(m, dtype=np.uint64)
    np.add.at(sums, seg, scrambled * K.U64(0x9E3779B97F4A7C15) | K.U64(1))
    filled = np.bincount(seg, minlength=m)
    keys = K.mix(sums ^ salt)
    out = [keys[filled > 0]]
    empty = int((filled == 0).sum())
    if empty > spare:
        # one-deletion neighbourhoods: the segment's sum without one of its tokens
        less = sums[seg] - (scrambled * K.U64(0x9E3779B97F4A7C15) | K.U64(1))
        out.append(K.mix(less ^ salt[seg])[filled[seg] > 1])
        if empty >= spare + 2:
            out.append(keys[filled == 0])
    return np.concatenate(out)


def rare_tokens(tokens: np.ndarray, num: int, den: int, common: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The tokens of one set (sorted) of which a linked set has at least one among its own: the first
    by an order with ``common`` tokens (sorted) last, these by ``place``."""
    most = len(tokens) + 1 + -num * len(tokens) // den
    if not len(common):
        return tokens[:most]
    at = np.searchsorted(common, tokens)
    at[at == len(common)] = 0
    listed = common[at] == tokens
    rare = tokens[~listed]
    if len(rare) < most:
        rare = np.concatenate([rare, tokens[listed][np.argsort(place[at[listed]])]])
    return rare[:most]


def sketch(tokens: np.ndarray) -> np.ndarray:
    """Parity of the tokens in each of 2**k >= n places, at least 64, as bytes."""
    bits = 64
    while bits < len(tokens):
        bits *= 2
    odd = np.bincount((tokens >> K.U64(7)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def fold(sketches: np.ndarray, to: int) -> np.ndarray:
    """The sketches (rows of bytes) at ``to`` bytes: places equal modulo the new size are added."""
    while sketches.shape[1] > to:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def doc_sets(texts, k: int):
    """Distinct k-word shingle hashes of each text: values and counts."""
    data, offsets = K.utf8(texts)
    values, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for a, b in K.spans(offsets):
        words = K.Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        v, docs = K.distinct_by_doc(*K.shingles(words.hash, words.first, k))
        values.append(v)
        counts.append(np.bincount(docs, minlength=b - a))
    return np.concatenate(values), np.concatenate(counts)


def _summaries(k: int):
    def run(batches):
        for batch in K.pieces(batches, 1):
            values, counts = doc_sets(batch.column(1), k)
            ends = np.cumsum(counts)
            h1, h2 = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
            sketches = []
            for i, (a, b) in enumerate(zip((ends - counts).tolist(), ends.tolist())):
                t = values[a:b]
                if a == b:
                    sketches.append(np.zeros(0, np.uint8))
                    continue
                h1[i] = np.bitwise_xor.reduce(K.mix(t)).view(np.int64)
                h2[i] = np.add.reduce(K.mix(t + K.U64(0x632BE59BD9B4E019))).view(np.int64)
                sketches.append(sketch(t))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts), pa.array(h1), pa.array(h2), K.blobs(np.concatenate(sketches), np.array([len(x) for x in sketches]))],
                names=["id", "n", "h1", "h2", "sketch"],
            )

    return run


def _index(k: int, keys_of):
    """Rows ``key, id, more`` of the index: an id, and other ids of the same key as bytes.
    ``keys_of`` gives the keys of one set."""

    def merged(keys, ids):
        keys, ids = np.concatenate(keys), np.concatenate(ids)
        order = np.argsort(keys)
        keys, ids = keys[order], ids[order]
        new = np.ones(len(keys), dtype=bool)
        new[1:] = keys[1:] != keys[:-1]
        run = np.cumsum(new) - 1
        if not new.all():
            several = np.flatnonzero(np.bincount(run)[run] > 1)
            ids[several] = ids[several][np.lexsort((ids[several], keys[several]))]
        # rows of at most BLOCK ids
        place = np.arange(len(keys)) - np.flatnonzero(new)[run]
        head = place % BLOCK == 0
        at = np.flatnonzero(head)
        counts = np.diff(np.append(at, len(keys)))
        lone = counts == 1
        offsets = np.zeros(len(at) + 1, dtype=np.int32)
        np.cumsum((counts - 1) * 8, out=offsets[1:])
        valid = pa.py_buffer(np.packbits(~lone, bitorder="little"))
        more = pa.Array.from_buffers(pa.binary(), len(at), [valid, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(ids[~head]))])
        return pa.RecordBatch.from_arrays([pa.array(keys[at].view(np.int64)), pa.array(ids[at]), more], names=["key", "id", "more"])

    def run(batches):
        keys, ids, held = [], [], 0
        for batch in K.pieces(batches, 1, 1 << 20):
            values, counts = doc_sets(batch.column(1), k)
            ends = np.cumsum(counts)
            rows = [keys_of(values[a:b]) for a, b in zip((ends - counts).tolist(), ends.tolist()) if a < b]
            owner = batch.column(0).to_numpy()[counts > 0]
            if rows:
                keys.append(np.concatenate(rows))
                ids.append(np.repeat(owner, [len(x) for x in rows]))
                held += len(keys[-1])
            if held >= MERGED:
                yield merged(keys, ids)
                keys, ids, held = [], [], 0
        if held:
            yield merged(keys, ids)

    return run


def _repeated(k: int):
    """Rows ``token, times``: tokens that occur in several of the sets that a task holds at once, and in how many.

    A token of d among N sets, w of them taken at once, is left out only where no two of the d are ever
    taken together, so it is seen some d * d * w / 2N times at least; tokens of one set alone make no row."""

    def counted(values):
        tokens, times = np.unique(np.concatenate(values), return_counts=True)
        some = times > 1
        return pa.RecordBatch.from_arrays([pa.array(tokens[some].view(np.int64)), pa.array(times[some])], names=["token", "times"])

    def run(batches):
        held, n = [], 0
        for batch in K.pieces(batches, 1, 1 << 20):
            values, _ = doc_sets(batch.column(1), k)
            held.append(values)
            n += len(values)
            if n >= MERGED:
                yield counted(held)
                held, n = [], 0
        if n:
            yield counted(held)

    return run


def _groups(batches):
    """Members of each key, streamed from rows sorted by (key, id): ``g, id`` of groups of two
    or more.  A group of up to HELD ids is named by its members; a longer one by its smallest
    id, so that the keys of one family make one group, and its ids go out as they come."""
    open_key, tail, long_name = None, np.zeros(0, np.int64), None

    def named(ids, starts, counts):
        with np.errstate(over="ignore"):
            total = np.add.reduceat(K.mix(ids.view(np.uint64) + K.U64(0x9E3779B97F4A7C15)), starts)
            short = K.mix(total + counts.astype(np.uint64))
        return np.where(counts > HELD, K.mix(ids[starts].view(np.uint64) ^ K.U64(0xD1B54A32D192ED03)), short)

    def rows(g, ids):
        return pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(ids)], names=["g", "id"])

    for batch in batches:
        if not batch.num_rows:
            continue
        more, ends = K.utf8(batch.column(2))
        size = 1 + np.diff(ends) // 8
        first = np.cumsum(size) - size
        ids = np.empty(int(size.sum()), dtype=np.int64)
        head = np.zeros(len(ids), dtype=bool)
        head[first] = True
        ids[first] = batch.column(0 + 1).to_numpy()
        ids[~head] = np.frombuffer(more.tobytes(), dtype=np.int64)
        keys = np.repeat(batch.column(0).to_numpy(), size)
        if long_name is not None:  # the open key's further members
            n = int(np.searchsorted(keys, open_key, side="right"))
            if n:
                yield rows(np.full(n, long_name), ids[:n])
            keys, ids = keys[n:], ids[n:]
            if not len(keys):
                continue
            long_name, tail = None, tail[:0]
        elif len(tail):
            keys, ids = np.concatenate([np.full(len(tail), open_key), keys]), np.concatenate([tail, ids])
        edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        counts = np.diff(np.append(edges, len(keys)))
        open_key, tail = keys[-1], ids[edges[-1] :]
        if len(tail) > HELD:
            long_name = named(tail, np.zeros(1, np.int64), np.array([len(tail)]))[0]
            yield rows(np.full(len(tail), long_name), tail)
        big = np.flatnonzero(counts[:-1] > 1)
        if len(big):
            members = ids[K.arange_runs(edges[big], counts[big])]
            name = named(members, np.cumsum(counts[big]) - counts[big], counts[big])
            yield rows(np.repeat(name, counts[big]), members)
    if long_name is None and len(tail) > 1:
        yield rows(np.repeat(named(tail, np.zeros(1, np.int64), np.array([len(tail)])), len(tail)), tail)


class Forest:
    """Union-find over the places of one task."""

    def __init__(self, n: int):
        self.up, self.made = np.arange(n), 0

    def roots(self) -> np.ndarray:
        while True:
            higher = self.up[self.up]
            if (higher == self.up).all():
                return self.up
            self.up = higher

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = int(self.up[i])
        return i

    def join(self, p: int, q: int) -> None:
        a, b = self.find(p), self.find(q)
        if a != b:
            self.up[b] = a
            self.made += 1

    def links(self, ids) -> list[tuple[int, int]]:
        """Each tree as a star: its first place, and one of the others."""
        if not self.made:
            return []
        root, places = self.roots(), np.arange(len(self.up))
        first = places.copy()
        np.minimum.at(first, root, places)
        first = first[root]
        out = np.flatnonzero(first != places)
        return list(zip(ids[first[out]].tolist(), ids[out].tolist()))


def _coarse(bands: Bands):
    """Pairs of a block pair that the sketch can't refute, as a spanning forest."""

    def links(ids, n, blobs, side):
        whole = [int.from_bytes(x.as_py(), "little") for x in blobs] if len(ids) <= 48 else None
        bits = [len(x) * 8 for x in blobs.to_pylist()] if whole is not None else None
        forest = Forest(len(ids))
        if whole is not None:
            for p, q in _pairs(side):
                low, high = min(n[p], n[q]), max(n[p], n[q])
                if low * bands.den < high * bands.num or forest.find(p) == forest.find(q):
                    continue
                to = min(bits[p], bits[q])
                if (_folded(whole[p], bits[p], to) ^ _folded(whole[q], bits[q], to)).bit_count() <= bands.distance(n[p], n[q]):
                    forest.join(p, q)
            return forest.links(ids)
        width = pc.binary_length(blobs).to_numpy()
        place, table = np.zeros(len(ids), np.int64), {}
        for w in np.unique(width).tolist():
            rows = np.flatnonzero(width == w)
            table[w] = (rows, np.frombuffer(b"".join(blobs.take(pa.array(rows)).to_pylist()), dtype=np.uint8).reshape(len(rows), w))
            place[rows] = np.arange(len(rows))
        left, right = _left_right(side)
        for p in left.tolist():
            for w, (rows, rest) in table.items():
                cand = rows[right[rows]]
                if side[p] != 0:
                    cand = cand[cand > p]
                cand = cand[np.minimum(n[cand], n[p]) * bands.den >= np.maximum(n[cand], n[p]) * bands.num]
                cand = cand[forest.roots()[cand] != forest.find(p)]
                if not len(cand):
                    continue
                to = min(w, int(width[p]))
                mine = fold(table[int(width[p])][1][place[p]][None], to)
                apart = np.bitwise_count((fold(rest[place[cand]], to) ^ mine).view(np.uint64)).sum(axis=1)
                for q in cand[apart <= bands.distance(n[cand], n[p])].tolist():
                    forest.join(p, q)
        return forest.links(ids)

    return links


def _exact(bands: Bands):
    """Links of a block pair verified on whole sets, as a spanning forest."""

    def links(ids, n, blobs, side):
        sets = [np.frombuffer(x, dtype=np.uint64) for x in blobs.to_pylist()]
        forest = Forest(len(ids))
        left, right = _left_right(side)
        everyone = np.flatnonzero(right)
        for p in left.tolist():
            cand = everyone[everyone > p] if side[p] != 0 else everyone
            cand = cand[np.minimum(n[cand], n[p]) * bands.den >= np.maximum(n[cand], n[p]) * bands.num]
            step = 4
            while len(cand):
                cand = cand[forest.roots()[cand] != forest.find(p)]
                now, cand = cand[:step], cand[step:]
                step = min(256, step * 2)
                if not len(now):
                    continue
                flat, counts = np.concatenate([sets[q] for q in now]), n[now]
                at = np.searchsorted(sets[p], flat)
                at[at == len(sets[p])] = 0
                both = np.add.reduceat(sets[p][at] == flat, np.cumsum(counts) - counts, dtype=np.int64)
                for q in now[bands.den * both >= bands.num * (counts + n[p] - both)].tolist():
                    forest.join(p, q)
        return forest.links(ids)

    return links


def _left_right(side):
    """Places of the left side, and a mask of the right.  Sides: -1 pivots (left; right for earlier
    ones), 0 left, 1 right, 2 both (a block with itself).  Rows are sorted by side."""
    if len(side) and side[0] == 2:
        return np.arange(len(side)), np.ones(len(side), bool)
    if len(side) and side[0] == -1:
        return np.flatnonzero(side == -1), np.ones(len(side), bool)
    return np.flatnonzero(side == 0), side == 1


def _pairs(side):
    left, right = _left_right(side)
    right = np.flatnonzero(right).tolist()
    for p in left.tolist():
        for q in right:
            if side[p] == 0 or q > p:
                yield p, q


def _folded(bits: int, size: int, to: int) -> int:
    while size > to:
        size //= 2
        bits = (bits >> size) ^ (bits & ((1 << size) - 1))
    return bits


def _group_links(groups: DataFrame, payload, links, narrow=None) -> DataFrame:
    """Links ``a, b`` inside groups (``g, id``, distinct, materialised): enough to span all that there are.

    ``payload`` adds what ``links`` compares to rows ``id, _pair, _side``.  Groups of up to
    BLOCK members are one comparison.  Larger ones go through a round of pivots, and more while
    over eight blocks are outside of large components and each round leaves half as many;
    then blocks of different components meet.  Groups where a member would meet over FEW
    blocks are first made into smaller ones by ``narrow`` (ids -> ``g, id``), if given."""
    sizes = materialize(groups.groupBy("g").agg(F.count("*").alias("_size")).where(F.col("_size") > 1), "sizes")
    large = _few(sizes.where(F.col("_size") > BLOCK))
    rows = groups.join(sizes.where(F.col("_size") <= BLOCK), "g", "left_semi").select("id", F.col("g").alias("_pair"), F.lit(2).alias("_side"))
    if not large.take(1):
        found = materialize(_links(payload(rows), links).distinct(), "links")
        drop(sizes)
        return found
    big = materialize(groups.join(large, "g"), "large")
    rows = rows.union(_with_pivots(big, F.col("_size"), 0))
    found = materialize(_links(payload(rows), links).distinct(), "links")
    outside, turn = big.count(), 0
    while True:
        # members by the pivot that they are linked to, in two steps at most; small components count as outside
        star = materialize(found.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("c")), "star")
        above = star.select(F.col("id").alias("c"), F.col("c").alias("d"))
        label = star.join(above, "c", "left").select("id", F.least("c", "d").alias("c"))
        hub = found.select(F.col("a").alias("id")).distinct().join(star, "id", "left").select("id", F.least("c", "id").alias("c"))
        label = label.union(hub).groupBy("id").agg(F.min("c").alias("c"))
        parts = materialize(big.select("g", "id", "_size").join(label, "id", "left").withColumn("c", F.coalesce("c", "id")), "parts")
        sized = materialize(parts.groupBy("g", "c").agg(F.count("*").alias("_part")), "sized")
        loose = sized.where(F.col("_part") < BLOCK).groupBy("g").agg(F.sum("_part").alias("_loose"))
        sized = sized.select("g", "c", F.when(F.col("_part") >= BLOCK, F.col("_part")).alias("_part")).join(loose, "g", "left")
        parts = parts.join(sized.withColumn("_loose", F.coalesce("_loose", F.lit(0))), ["g", "c"])
        many = loose.where(F.col("_loose") > 8 * BLOCK).agg(F.coalesce(F.sum("_loose"), F.lit(0))).first()[0]
        if not many or many > 0.5 * outside:
            break
        outside, turn = many, turn + 1
        again = parts.where(F.col("_loose") > 8 * BLOCK)
        chosen = F.col("_part").isNull() & (F.pmod(F.xxhash64("id", F.lit(turn)), F.col("_loose")) < PIVOTS)
        found = materialize(found.union(_links(payload(_with_pivots(again, None, turn, chosen)), links)).distinct(), "links")
    if narrow is not None:
        # members of a group meet (n * n - sum of its components' squares) / BLOCK rows of blocks
        n, inside = F.count("*"), F.sum(F.coalesce("_part", F.lit(0)))
        wide = _few(parts.groupBy("g").agg((n * n - inside > FEW * BLOCK * n).alias("_wide")).where("_wide").select("g"))
        if wide.take(1):
            members = _few(parts.join(wide, "g", "left_semi").select("id", "c").distinct())
            parts = parts.join(wide, "g", "left_anti")
            finer = materialize(narrow(members.select("id")).join(members, "id"), "finer")
            mixed = _few(finer.groupBy("g").agg((F.min("c") != F.max("c")).alias("_mixed")).where("_mixed").select("g"))
            finer = finer.join(mixed, "g", "left_semi").select("g", "id")
            found = materialize(found.union(_group_links(materialize(finer, "finer"), payload, links)).distinct(), "links")
    rest = materialize(_across(parts), "across")
    if not rest.take(1):
        return found
    return materialize(found.union(_links(payload(rest), links)).distinct(), "links")


def _with_pivots(big: DataFrame, base, turn: int, chosen=None) -> DataFrame:
    """``g, id, _size`` -> ``id, _pair, _side``: members in blocks, each with all pivots of the group."""
    chunks = F.ceil(F.col("_size") / BLOCK).cast("int")
    chosen = F.pmod(F.xxhash64("id", F.lit(turn)), base) < PIVOTS if chosen is None else chosen
    pair = lambda at: F.xxhash64("g", at, F.lit(turn)).alias("_pair")
    members = big.select("id", pair(F.pmod(F.xxhash64("id"), chunks).cast("int")), F.lit(1).alias("_side"))
    pivots = big.where(chosen).select("g", "id", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("_at"))
    return members.union(pivots.select("id", pair(F.col("_at")), F.lit(-1).alias("_side")))


def _across(parts: DataFrame) -> DataFrame:
    """``id, _pair, _side`` of the block pairs whose sets no component holds together."""
    small = F.col("_part").isNull()
    n = F.ceil(F.when(small, F.col("_loose")).otherwise(F.col("_part")) / BLOCK).cast("int")
    parts = parts.withColumn("_c", F.when(small, F.lit(None)).otherwise(F.col("c")))
    parts = parts.withColumn("_block", F.xxhash64("g", "_c", F.pmod(F.xxhash64("id"), n)))
    unit = _few(parts.select("g", "_c", "_block").distinct())
    a, b = unit.alias("a"), unit.select("g", F.col("_c").alias("_d"), F.col("_block").alias("_other")).alias("b")
    apart = F.col("_c").isNull() | F.col("_d").isNull() | (F.col("_c") != F.col("_d"))
    pairs = a.join(b, "g").where((F.col("_block") < F.col("_other")) & apart | (F.col("_block") == F.col("_other")) & F.col("_c").isNull())
    pairs = pairs.select("_block", "_other", F.xxhash64("g", "_block", "_other").alias("_pair"))
    ends = pairs.select(F.col("_block"), "_pair", F.when(F.col("_block") == F.col("_other"), 2).otherwise(0).alias("_side"))
    ends = ends.union(pairs.where(F.col("_block") != F.col("_other")).select(F.col("_other").alias("_block"), "_pair", F.lit(1).alias("_side")))
    return parts.join(ends, "_block").select("id", "_pair", "_side")


def _links(rows: DataFrame, links) -> DataFrame:
    """Links found in each block pair of ``rows`` (``_pair, _side, id, n`` and a blob), each
    streamed to one task in sorted order."""

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            keys = table.column(0).to_numpy()
            last = int(np.searchsorted(keys, keys[-1], side="left")) if len(keys) else 0
            held = table.slice(last)
            if last:
                yield _linked(table.slice(0, last), links)
        if held is not None and held.num_rows:
            yield _linked(held, links)

    return rows.repartition("_pair").sortWithinPartitions("_pair", "_side", "id").mapInArrow(run, "a long, b long")


def _linked(table: pa.Table, links) -> pa.RecordBatch:
    table = table.combine_chunks()
    keys, side, ids, n = (table.column(i).to_numpy() for i in range(4))
    blobs = table.column(4).combine_chunks()
    edges = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1)).tolist() + [len(keys)]
    a, b = [], []
    for x, y in zip(edges[:-1], edges[1:]):
        if y - x > 1:
            for p, q in links(ids[x:y], n[x:y], blobs.slice(x, y - x), side[x:y]):
                a.append(p)
                b.append(q)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _few(table: DataFrame, most: int = 1_000_000) -> DataFrame:
    """A materialised table of a few numbers a row, broadcast where its rows are counted to be few."""
    table = materialize(table, "few")
    return F.broadcast(table) if table.count() <= most else table


def link_classes(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id, n_shingles, component_id``.

    Two documents link when ``den * |intersection| >= num * |union|`` of their
    k-word shingle sets; ``component_id`` is the smallest id reachable by links.
    Fewer than k words: the whole sequence is the one shingle.  Null or empty text,
    or no words: an empty set, linked with nothing.  Rows with the same id count as
    one document with several texts, all in one component.  A null id keeps
    ``n_shingles`` and has a null component.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    made = materialize(texts.mapInArrow(_summaries(k), "id long, n long, h1 long, h2 long, sketch binary"), "sets")
    full = made.where((F.col("n") > 0) & F.col("id").isNotNull())
    reps = materialize(full.groupBy("h1", "h2", "n").agg(F.min("id").alias("rep")), "reps")
    same_id = materialize(full.groupBy("id").agg(F.count("*").alias("c")).where("c > 1").select("id"), "same")
    several = bool(same_id.take(1))
    if several:  # repeated rows are read once
        texts = texts.withColumn("_tag", F.xxhash64("text")).dropDuplicates(["id", "_tag"]).select("id", "text")

    # sizes as counted, by band: some hundred rows at most
    edges = F.array(*[F.lit(int(e)) for e in Bands(num, den).edges.tolist()])
    band = F.size(F.filter(edges, lambda e: e <= F.col("n"))) - 1
    sizes = reps.groupBy(band.alias("band")).agg(F.avg("n").alias("mean"))
    bands = Bands(num, den, {r["band"]: r["mean"] for r in sizes.collect()})

    # the lowest id of equal sets stands for all; it alone goes into the index
    chosen = _few(reps.select(F.col("rep").alias("id")).distinct())
    rows = texts.join(chosen, "id", "left_semi").mapInArrow(_index(k, lambda t: index_rows(t, bands)), "key long, id long, more binary")
    meet = lambda rows: rows.repartition("key").sortWithinPartitions("key", "id").mapInArrow(_groups, "g long, id long").distinct()
    groups = materialize(meet(rows), "groups")

    def narrow(ids):
        some = texts.join(ids, "id", "left_semi")
        seen = some.mapInArrow(_repeated(k), "token long, times long").groupBy("token").agg(F.sum("times").alias("times")).where(F.col("times") >= OFTEN)
        seen = seen.orderBy(F.desc("times"), "token").limit(LISTED).toArrow()
        common = seen.column("token").to_numpy().view(np.uint64)
        order = np.argsort(common)
        common, place = common[order], -order
        return meet(some.mapInArrow(_index(k, lambda t: rare_tokens(t, num, den, common, place)), "key long, id long, more binary"))

    info = full.join(chosen, "id", "left_semi").select("id", "n", "h1", "sketch").dropDuplicates(["id", "h1"]).drop("h1")
    coarse = _group_links(groups, lambda rows: rows.join(info, "id").select("_pair", "_side", "id", "n", "sketch"), _coarse(bands), narrow)
    drop(groups)
    coarse = connected_components(coarse)
    coarse = materialize(coarse.select(F.col("label").alias("g"), F.col("node").alias("id")), "classes")

    def tokens(batches):
        for batch in K.pieces(batches, 1):
            values, counts = doc_sets(batch.column(1), k)
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(3), batch.column(0), pa.array(counts), K.blobs(values.view(np.uint8), counts * 8)], names=["_pair", "_side", "id", "n", "tokens"])

    def whole(rows):
        some = texts.join(_few(rows), "id").select("id", "text", "_pair", "_side")
        return some.mapInArrow(tokens, "_pair long, _side int, id long, n long, tokens binary").where("n > 0")

    links = _group_links(coarse, whole, _exact(bands), narrow)
    if several:
        links = links.union(full.join(reps, ["h1", "h2", "n"]).join(same_id, "id", "left_semi").select(F.col("id").alias("a"), F.col("rep").alias("b")))
        links = materialize(links.distinct(), "links")
    label = connected_components(links)
    label = label.select(F.col("node").alias("rep"), "label")
    out = made.join(reps, ["h1", "h2", "n"], "left").join(label, "rep", "left")
    component = F.when(F.col("id").isNull(), F.lit(None)).otherwise(F.coalesce("label", "rep", "id"))
    return out.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = link_classes(docs, k=4, num=85, den=100)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")
