"""Exact n-gram Jaccard join with connected components.

A document's set is its distinct word shingles, as 64-bit hashes.  Equal sets are one
class, told by 128 bits of hash; 64 of them name it, after a check that no two classes
share a name.  The incidence matrix of classes by n-grams is multiplied with its transpose in
blocks of n-grams: in each block, classes that share an n-gram of their prefixes give a
partial overlap count; counts are summed over blocks, and a pair whose count stays below
what its sizes demand is discarded.  All classes order their n-grams alike, the frequent
ones last, then by hash; a pair over the threshold shares at least l of the first
n - ceil(t n) + l n-grams of each (l: a twentieth of the lesser size), so nothing is lost.

An n-gram in many classes doesn't list their pairs: classes there that
could be similar, by an upper bound of their overlap from counts per hash bin, are
chained to each other.  Very long lists are dealt in parts of bounded length; each part
is chained by itself, and then only envelopes of its chains (the greatest counts per bin)
are held against those of other parts, in blocks of pairs.

The pairs that this bound allows and the chains make candidate groups, and within each of
these the product is done in full: breadth-first from class to class, exact overlaps are
accumulated against all classes of the group not yet reached, so that a large group of
near copies costs about one pass for each few of its members instead of all pairs.  Groups
with more text than a task should hold are dealt in parts, each with some members of
the group that all parts get, which mostly connects them; classes that are still apart
after that are held against the others in blocks of pairs.

Defined results: null text is the empty text; texts without words have the empty set and
link with nothing; a text of fewer words than a shingle has its whole sequence as its
one shingle.  Rows that repeat an id are judged each by its own text.  Rows without an
id are linked like others, and have no component id if none of their component has an id.
Sets are compared by 64-bit hashes of their shingles.  Other columns are ignored.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from playlog.llm._bytes import mix, release, shingle_sets, steady
from playlog.llm._spark import cut, keyed_texts_of, table
from playlog.llm.graph import components

#: Words in a shingle and the least similarity in hundredths.
WIDTH, THRESHOLD = 5, 80
#: Classes an n-gram may stand in before its block chains them instead of listing pairs.
LISTED = 32
#: n-grams in more classes than a thousandth of all, and more than FREQUENT, go last.  At
#: most FREQUENT_KEPT are told to the tasks; which ones are only affects speed.
FREQUENT, FREQUENT_KEPT = 64, 1_000_000
#: Least number of hash bins of a set; larger sets have one for about eight n-grams.
BINS = 128
#: Bytes of text hashed at a time; documents per block of the prefix product.
SLICE = 8_000_000
BLOCK_DOCS = 8_192
#: Classes of one list or envelopes that a task chains, and text bytes of a candidate group
#: that a task verifies; more are dealt in parts.
PART, GROUP = 2_048, 32_000_000
#: Members of a large group that all its parts get.
PIVOTS = 8


def _slices(texts: pa.Array | pa.ChunkedArray, size: int = SLICE) -> Iterator[tuple[int, list[bytes]]]:
    steady()
    part: list[bytes] = []
    at = held = 0
    for i, x in enumerate(texts.cast(pa.binary()).to_pylist()):
        part.append(x)
        held += len(x)
        if held >= size:
            yield at, part
            part, at, held = [], i + 1, 0
    if part:
        yield at, part


def signature(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a whole set."""
    with np.errstate(over="ignore"):
        out = []
        for salt in (0x51ED270B, 0x2545F4914F6CDD1D):
            h = mix(s ^ np.uint64(salt))
            total = mix(np.array([np.bitwise_xor.reduce(h) + np.uint64(len(s))], dtype=np.uint64))[0]
            out.append(int((np.uint64(h.sum(dtype=np.uint64)) ^ total).view(np.int64)))
    return out[0], out[1]


def name_of(told: tuple[int, int], clashes: frozenset[int]) -> int:
    """A class's name: its first hash, or the second where the first names several."""
    return told[1] if told[0] in clashes else told[0]


def bins(s: np.ndarray) -> np.ndarray:
    """Counts of a set's hashes by their leading bits, a power of two of them."""
    width = max(BINS, 1 << (max(1, len(s) // 8) - 1).bit_length())
    shift = np.uint64(65 - width.bit_length())
    return np.minimum(np.bincount((s >> shift).astype(np.int64), minlength=width), 65_535).astype("<u2")


def _upper(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The most that a set with bins `x` can share with sets of the bins in `rows`."""
    x, rows = x.astype(np.int32), rows.astype(np.int32)
    x = np.where(x >= 65_535, 1 << 24, x)  # a full bin bounds nothing
    rows = np.where(rows >= 65_535, 1 << 24, rows)
    width = min(len(x), rows.shape[1])
    return np.minimum(x.reshape(width, -1).sum(1), rows.reshape(len(rows), width, -1).sum(2)).sum(1)


def _need(n: np.ndarray | int, t: int) -> np.ndarray | int:
    return (t * n + 99) // 100


def _share(n: np.ndarray | int) -> np.ndarray | int:
    return np.maximum(1, n // 20)


def profiles(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per document the size, signature and bin counts of its set; one row of each slice
    also carries `often`, its n-grams found in four classes of the slice or more."""
    own = ["doc_id", "rid", "key", "size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in _slices(batch.column("text")):
                sets = shingle_sets(texts, width)
                sigs = [signature(s) for s in sets]
                classes = {g: s for g, s in zip(sigs, sets, strict=True)}
                often: list[bytes | None] = [None] * len(sets)
                grams, n = np.unique(np.concatenate([*classes.values()]), return_counts=True)
                keep = n >= 4
                often[0] = grams[keep].tobytes() + n[keep].astype("<u8").tobytes()
                here = [batch.column(c)[at : at + len(sets)] for c in own[:3]]
                more = [pa.array([len(x) for x in texts], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), *(pa.array([g[k] for g in sigs], pa.int64()) for k in (0, 1))]
                yield pa.RecordBatch.from_arrays([*here, *more, pa.array([bins(s).tobytes() for s in sets], pa.binary()), pa.array(often, pa.binary())], names=[*own, "n", "sig", "sig2", "bins", "often"])
        release()

    return docs.mapInArrow(run, "doc_id long, rid long, key long, size long, n long, sig long, sig2 long, bins binary, often binary")


def _frequent(found: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The frequent n-grams, sorted, and their counts.  Their number is bounded by the number of n-grams of
    all classes over `limit`, that is a thousand mean set sizes, and by FREQUENT_KEPT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.frombuffer(x, dtype="<u8") for x in batch.column("often").to_pylist() if x]
            g = [p[: len(p) // 2] for p in parts]
            n = [p[len(p) // 2 :] for p in parts]
            flat = np.concatenate(g) if g else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), pa.array(np.concatenate(n).view(np.int64) if n else np.zeros(0, np.int64))], names=["gram", "n"])

    counted = found.select("often").where(F.col("often").isNotNull()).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    rows = counted.where(F.col("n") > limit).orderBy(F.desc("n"), "gram").limit(FREQUENT_KEPT).toArrow()
    gram, n = rows.column("gram").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    order = np.argsort(gram)
    return gram[order], n[order]


def _found(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key would be, and whether it is there."""
    if not len(sorted_keys):
        return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


def _pairs_of(gram: np.ndarray, cls: np.ndarray, n: np.ndarray, split: np.ndarray, t: int, listed: int, part: int) -> tuple[np.ndarray, ...]:
    """From sorted (n-gram, class) rows: pairs with counts; the rows of long lists and the
    parts that these are dealt in.  `split`: parts that an n-gram's list is already in."""
    new = np.concatenate([[True], gram[1:] != gram[:-1]]) if len(gram) else np.zeros(0, bool)
    size = np.diff(np.append(np.flatnonzero(new), len(gram)))
    length = np.repeat(size, size)
    place = np.arange(len(gram)) - np.repeat(np.flatnonzero(new), size)
    a, b = [], []
    short = (length > 1) & (length <= listed) & (split == 1)
    for d in range(1, listed):
        i = np.flatnonzero(short & (place + d < length))
        if not len(i):
            break
        fits = 100 * np.minimum(n[i], n[i + d]) >= t * np.maximum(n[i], n[i + d])
        a.append(cls[i[fits]])
        b.append(cls[i[fits] + d])
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    first = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, bool)
    count = np.diff(np.append(np.flatnonzero(first), len(a)))
    long = np.flatnonzero((length > listed) | (split > 1))
    return a[first], b[first], count, long, np.maximum(split[long], -(-length[long] // part))


def prefix_product(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], blocks: int, clashes: frozenset[int] = frozenset(), width: int = WIDTH, t: int = THRESHOLD) -> DataFrame:
    """Partial overlap counts by block: `a`, `b`, `c`, with sizes; and the rows of long
    lists as (n-gram, class) with null `c` and the number of parts as `least`."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def parts_of(grams: np.ndarray) -> np.ndarray:
        """Parts that an n-gram's classes are dealt in before they meet."""
        last, n = shared.value
        at, known = _found(last, grams)
        return np.where(known, -(-n[at] // PART), 1) if len(n) else np.ones(len(grams), dtype=np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = shared.value[0]
        for batch in batches:
            for _, texts in _slices(batch.column("text")):
                classes = {signature(s): s for s in shingle_sets(texts, width) if len(s)}
                if not classes:
                    continue
                sigs = np.array([name_of(g, clashes) for g in classes], dtype=np.int64)
                sizes = np.array([len(s) for s in classes.values()], dtype=np.int64)
                grams, owner = [], []
                for k, (s, n) in enumerate(zip(classes.values(), sizes.tolist(), strict=True)):
                    take = min(n, n - _need(n, t) + int(_share(n)))
                    _, late = _found(last, s)
                    s = np.concatenate([s[~late], s[late]]) if late.any() else s
                    grams.append(s[:take])
                    owner.append(np.full(take, k, dtype=np.uint32))
                flat, owned = np.concatenate(grams), np.concatenate(owner)
                parts = parts_of(flat).astype(np.uint64)
                with np.errstate(over="ignore"):
                    part = mix(sigs[owned].view(np.uint64)) % parts * np.uint64(0x9E3779B97F4A7C15)
                    block = (mix(flat + part) % np.uint64(blocks)).astype(np.int64)
                order = np.argsort(block, kind="stable")
                flat, owned, block = flat[order], owned[order], block[order]
                edge = np.flatnonzero(np.diff(block, prepend=-1, append=-1))
                out: list[tuple[int, bytes, bytes, bytes, bytes]] = []
                for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                    here, local = np.unique(owned[lo:hi], return_inverse=True)
                    out.append((int(block[lo]), flat[lo:hi].tobytes(), local.astype("<u4").tobytes(), sigs[here].tobytes(), sizes[here].tobytes()))
                names = ["block", "grams", "owner", "sigs", "sizes"]
                kinds = [pa.int64(), *[pa.binary()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
        release()

    def multiply(part: pa.Table) -> pa.Table:
        steady()
        grams, cls, n = [], [], []
        for g, o, s, z in zip(*(part.column(c).to_pylist() for c in ("grams", "owner", "sigs", "sizes")), strict=True):
            o = np.frombuffer(o, dtype="<u4")
            grams.append(np.frombuffer(g, dtype=np.uint64))
            cls.append(np.frombuffer(s, dtype=np.int64)[o])
            n.append(np.frombuffer(z, dtype=np.int64)[o])
        gram, c, size = np.concatenate(grams), np.concatenate(cls), np.concatenate(n)
        order = np.argsort(gram, kind="stable")
        gram, c, size = gram[order], c[order], size[order]
        split = parts_of(gram)
        more = split > 1  # of the others only n-grams of two rows or more matter
        more[1:] |= gram[1:] == gram[:-1]
        more[:-1] |= gram[1:] == gram[:-1]
        gram, c, size, split = gram[more], c[more], size[more], split[more]
        order = np.lexsort((c, gram))
        gram, c, size, split = gram[order], c[order], size[order], split[order]
        if len(gram):
            once = np.concatenate([[True], (gram[1:] != gram[:-1]) | (c[1:] != c[:-1])])
            gram, c, size, split = gram[once], c[once], size[once], split[once]
        a, b, count, long, parts = _pairs_of(gram, c, size, split, t, LISTED, PART)
        # sizes travel with the pair: a pair's demand depends on the lesser one
        known = dict(zip(c.tolist(), size.tolist(), strict=True))
        least = [min(known[x], known[y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
        return pa.table(
            {
                "a": pa.array(np.concatenate([a, gram[long].view(np.int64)]), pa.int64()),
                "b": pa.array(np.concatenate([b, c[long]]), pa.int64()),
                "c": pa.array([*count.tolist(), *[None] * len(long)], pa.int64()),
                "least": pa.array([*least, *parts.tolist()], pa.int64()),
            }
        )

    dealt = docs.mapInArrow(deal, "block long, grams binary, owner binary, sigs binary, sizes binary")
    return dealt.groupBy("block").applyInArrow(multiply, "a long, b long, c long, least long")


class Chained:
    """Sets by the counts of their bins, chained where they could be similar.  `low` and
    `high` are the least and the greatest size that a row stands for."""

    def __init__(self, raw: list[bytes], low: np.ndarray, high: np.ndarray, t: int):
        self.low, self.high, self.t = low, high, t
        self.raw = [np.frombuffer(x, dtype="<u2") for x in raw]
        self.wide = np.array([len(x) for x in self.raw], dtype=np.int64)
        self.stacked = {w: np.stack([self.raw[i] for i in np.flatnonzero(self.wide == w)]) for w in np.unique(self.wide).tolist()}
        self.place = np.zeros(len(raw), dtype=np.int64)
        for w in self.stacked:
            self.place[self.wide == w] = np.arange(int((self.wide == w).sum()))

    def near(self, i: int, left: np.ndarray) -> np.ndarray:
        """Those of `left` that could be similar to row i."""
        t = self.t
        near = left[(100 * self.high[left] >= t * self.low[i]) & (t * self.low[left] <= 100 * self.high[i])]
        bound = np.zeros(len(near), dtype=np.int64)
        for w, rows in self.stacked.items():
            some = self.wide[near] == w
            if some.any():
                bound[some] = _upper(self.raw[i], rows[self.place[near[some]]])
        return near[100 * bound >= t * (self.low[near] + self.low[i] - bound)]

    def label(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Chain number of each row, and the links that were followed."""
        label = np.full(len(self.raw), -1, dtype=np.int64)
        left, number = np.arange(len(self.raw)), 0
        u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(left):
            queue, left = deque([int(left[0])]), left[1:]
            label[queue[0]] = number
            while queue and len(left):
                i = queue.popleft()
                near = self.near(i, left)
                label[near] = number
                u.append(np.full(len(near), i))
                v.append(near)
                queue.extend(near.tolist())
                left = left[label[left] < 0]
            number += 1
        return label, np.concatenate(u), np.concatenate(v)

    def envelope(self, rows: np.ndarray) -> bytes:
        """The greatest counts per bin of these rows, at the least width among them."""
        width = int(self.wide[rows].min())
        most = np.zeros(width, dtype=np.int64)
        for i in rows.tolist():
            x = self.raw[i].astype(np.int64)
            x = np.where(x >= 65_535, 1 << 24, x)
            np.maximum(most, x.reshape(width, -1).sum(1), out=most)
        return np.minimum(most, 65_535).astype("<u2").tobytes()


_EDGES = "u long, v long"


def _edges(sigs: np.ndarray, u: np.ndarray, v: np.ndarray) -> pa.Table:
    return pa.table({"u": pa.array(sigs[u], pa.int64()), "v": pa.array(sigs[v], pa.int64())})


def _dealt(rows: DataFrame, parts: Column, by: str) -> DataFrame:
    """Rows in blocks of pairs: every two rows of different parts meet in the block (lo, hi) of
    their parts, and rows of one part in all blocks of that part."""
    own = F.pmod(F.xxhash64(by, F.lit(5)), parts)
    spread = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    return spread.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))


def _chains(long: DataFrame, classes: DataFrame, t: int) -> DataFrame:
    """Edges that chain the classes of a long list which could be similar."""
    edges = "u long, v long, gram long, low long, high long, bins binary"

    def chain(part: pa.Table) -> pa.Table:
        """Links in a part of a list, and an envelope (null v) of each chain if there are more parts."""
        part = part.sort_by([("n", "ascending"), ("sig", "ascending")])
        sigs, n = part.column("sig").to_numpy(), part.column("n").to_numpy()
        rows = Chained(part.column("bins").to_pylist(), n, n, t)
        label, u, v = rows.label()
        out = _edges(sigs, u, v).to_pydict() | {"gram": [None] * len(u), "low": [None] * len(u), "high": [None] * len(u), "bins": [None] * len(u)}
        if part.column("parts")[0].as_py() > 1:
            order = np.argsort(label, kind="stable")
            for members in np.split(order, np.flatnonzero(np.diff(label[order])) + 1):
                for name, x in zip(out, (int(sigs[members[0]]), None, part.column("gram")[0].as_py(), int(n[members].min()), int(n[members].max()), rows.envelope(members)), strict=True):
                    out[name].append(x)
        kinds = (*[pa.int64()] * 5, pa.binary())
        return pa.table({k: pa.array(x, kind) for (k, x), kind in zip(out.items(), kinds, strict=True)})

    def across(part: pa.Table) -> pa.Table:
        part = part.sort_by([("low", "ascending"), ("u", "ascending")])
        rows = Chained(part.column("bins").to_pylist(), part.column("low").to_numpy(), part.column("high").to_numpy(), t)
        return _edges(part.column("u").to_numpy(), *rows.label()[1:])

    told = long.select(F.col("a").alias("gram"), F.col("b").alias("sig"), F.col("least").alias("parts")).join(classes.select("sig", "n", "bins"), "sig")
    # an n-gram's parts are told by each block of its list; they may differ by rounding
    part = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("sig", F.lit(3)), F.col("parts"))).otherwise(F.lit(0).cast("long"))
    first = cut(told.withColumn("part", part).groupBy("gram", "part").applyInArrow(chain, edges))
    envelopes = first.where("v is null")
    sizes = envelopes.groupBy("gram").agg(F.ceil(F.count("*") / PART).cast("long").alias("parts"))
    dealt = _dealt(envelopes.join(sizes, "gram"), F.col("parts"), "u")
    return first.where("v is not null").select("u", "v").unionByName(dealt.groupBy("gram", "lo", "hi").applyInArrow(across, _EDGES))


def _possible(pairs: DataFrame, classes: DataFrame, t: int) -> DataFrame:
    """The pairs whose overlap could be enough, by their counts per hash bin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = ([np.frombuffer(b, dtype="<u2") for b in batch.column(c).to_pylist()] for c in ("bins_u", "bins_v"))
            n = batch.column("n_u").to_numpy() + batch.column("n_v").to_numpy()
            bound = np.array([_upper(a, b[None, :])[0] for a, b in zip(x, y, strict=True)], dtype=np.int64)
            yield batch.select(["u", "v"]).filter(pa.array(100 * bound >= t * (n - bound)))

    told = pairs
    for c in ("u", "v"):
        told = told.join(classes.select(F.col("sig").alias(c), F.col("n").alias(f"n_{c}"), F.col("bins").alias(f"bins_{c}")), c)
    return told.mapInArrow(run, "u long, v long")


class Sets:
    """Sets as rows of an incidence matrix."""

    def __init__(self, sets: list[np.ndarray], t: int):
        self.t = t
        self.size = np.array([len(s) for s in sets], dtype=np.int64)
        _, self.gram = np.unique(np.concatenate(sets), return_inverse=True)
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        self.mark = np.zeros(int(self.gram.max()) + 1 if len(self.gram) else 1, dtype=np.int32)

    def near(self, i: int, left: np.ndarray) -> np.ndarray:
        """Those of `left` that are similar to set i."""
        size, t, gram, start, mark = self.size, self.t, self.gram, self.start, self.mark
        near = left[(100 * size[left] >= t * size[i]) & (t * size[left] <= 100 * size[i])]
        if not len(near):
            return near
        mine = gram[start[i] : start[i + 1]]
        mark[mine] = 1
        rows = np.concatenate([gram[start[j] : start[j + 1]] for j in near.tolist()])
        overlap = np.add.reduceat(mark[rows], np.concatenate([[0], np.cumsum(size[near])[:-1]]))
        mark[mine] = 0
        return near[100 * overlap >= t * (size[near] + size[i] - overlap)]


def linked(sets: list[np.ndarray], t: int = THRESHOLD) -> np.ndarray:
    """Component number of each set: an incidence matrix times its transpose, row after
    row, against the sets not yet reached."""
    if len(sets) == 1:
        return np.zeros(1, dtype=int)
    label = np.full(len(sets), -1)
    rows = Sets(sets, t)
    left, number = np.argsort(rows.size, kind="stable"), 0
    while len(left):
        queue, left = deque([left[0]]), left[1:]
        label[queue[0]] = number
        while queue and len(left):
            near = rows.near(queue.popleft(), left)
            label[near] = number
            queue.extend(near.tolist())
            left = left[label[left] < 0]
        number += 1
    return label


def _members(part: pa.Table, width: int, clashes: frozenset[int], sign: Callable[[np.ndarray], tuple[int, int]]) -> tuple[pa.Table, list[np.ndarray]]:
    """The rows of a part, one for each class and group, with their sets.  A class's row has its very
    text; rows that repeat it count once."""
    part = part.sort_by([("root", "ascending"), ("sig", "ascending")])
    sets: list[np.ndarray] = []
    for _, texts in _slices(part.column("text")):
        sets += shingle_sets(texts, width)
    good, seen = [], set()
    for i, (s, g) in enumerate(zip(sets, part.column("sig").to_pylist(), strict=True)):
        if g not in seen and len(s) and name_of(sign(s), clashes) == g:
            seen.add(g)
            good.append(i)
    return part.take(pa.array(good, pa.int64())), [sets[i] for i in good]


def _by_root(part: pa.Table) -> list[np.ndarray]:
    roots = part.column("root").to_numpy()
    return np.split(np.arange(len(roots)), np.flatnonzero(np.diff(roots)) + 1) if len(roots) else []


def _settled(texts: DataFrame, groups: DataFrame, shards: int, clashes: frozenset[int], width: int, t: int) -> DataFrame:
    """`sig` and `root` of the classes of groups that a task can hold, from exact overlaps."""

    def settle(part: pa.Table) -> pa.Table:
        part, sets = _members(part, width, clashes, signature)
        sigs = part.column("sig").to_numpy()
        root = sigs.copy()
        for members in _by_root(part):
            label = linked([sets[i] for i in members.tolist()], t)
            least = np.full(int(label.max()) + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, label, sigs[members])
            root[members] = least[label]
        release()
        return pa.table({"sig": pa.array(sigs, pa.int64()), "root": pa.array(root, pa.int64())})

    joined = texts.join(groups.select("rid", "key", "sig", "root"), ["rid", "key"]).withColumn("shard", F.pmod(F.xxhash64("root"), F.lit(shards)))
    return joined.select("shard", "root", "sig", "text").groupBy("shard").applyInArrow(settle, "sig long, root long")


def _large(texts: DataFrame, groups: DataFrame, clashes: frozenset[int], width: int, t: int) -> DataFrame:
    """`sig` and `root` of the classes of groups with more text than a task should hold.
    `groups` has `parts`, the number that each group is dealt in."""

    def inside(part: pa.Table) -> pa.Table:
        """Links between the classes of a part, among which are the group's pivots."""
        part, sets = _members(part, width, clashes, signature)
        u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for members in _by_root(part):
            label = linked([sets[i] for i in members.tolist()], t)
            first = np.full(int(label.max()) + 1, len(sets))
            np.minimum.at(first, label, members)
            u.append(first[label])
            v.append(members)
        release()
        return _edges(part.column("sig").to_numpy(), np.concatenate(u), np.concatenate(v))

    def across(part: pa.Table) -> pa.Table:
        """Links of the classes that aren't in their group's main component with those of others."""
        part, sets = _members(part, width, clashes, signature)
        component, rest, piece = (part.column(c).to_numpy(zero_copy_only=False) for c in ("component", "rest", "piece"))
        rows = Sets(sets, t) if sets else None
        u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        here = part.column("meets").to_numpy() if len(sets) else np.zeros(0, np.int64)
        every = np.arange(len(sets))
        for i in np.flatnonzero(rest & (piece == here)).tolist():
            near = rows.near(i, every[component != component[i]])
            u.append(np.full(len(near), i))
            v.append(near)
        release()
        return _edges(part.column("sig").to_numpy(), np.concatenate(u), np.concatenate(v))

    own = groups.withColumn("part", F.pmod(F.xxhash64("sig", F.lit(7)), F.col("parts")))
    rank = F.struct(F.xxhash64("sig", F.lit(9)).alias("by"), "rid", "key", "sig", "parts")
    pivots = groups.groupBy("root").agg(*[F.min(F.when(F.pmod(F.xxhash64("sig", F.lit(8)), F.lit(PIVOTS)) == k, rank)).alias(f"p{k}") for k in range(PIVOTS)])
    spread = pivots.select("root", F.explode(F.array(*[f"p{k}" for k in range(PIVOTS)])).alias("p")).where("p is not null").select("root", "p.rid", "p.key", "p.sig", F.explode(F.sequence(F.lit(0).cast("long"), F.col("p.parts") - 1)).alias("part"))
    dealt = own.select("root", "rid", "key", "sig", "part").unionByName(spread).distinct()
    with_text = texts.join(dealt, ["rid", "key"]).select("root", "part", "sig", "text")
    edges = cut(with_text.groupBy("root", "part").applyInArrow(inside, _EDGES))
    told = components(edges)
    now = cut(groups.join(told.select(F.col("node").alias("sig"), F.col("root").alias("component")), "sig", "left").withColumn("component", F.coalesce("component", "sig")))
    weights = now.groupBy("root", "component").agg(F.sum("size").alias("held"))
    main = weights.groupBy("root").agg(F.max(F.struct("held", "component")).alias("main"), F.sum("held").alias("all")).where(F.col("all") > F.col("main.held"))
    apart = now.join(main.select("root", F.col("main.component").alias("main"), F.ceil((F.col("all") - F.col("main.held")) / (GROUP // 4)).cast("long").alias("pieces")), "root")
    apart = apart.withColumn("rest", F.col("component") != F.col("main")).withColumn("part", F.pmod(F.xxhash64("sig", F.lit(7)), F.col("parts"))).withColumn("piece", F.pmod(F.xxhash64("sig", F.lit(6)), F.col("pieces")))
    # every class meets all pieces of the rest in its own part, and a class of the rest all parts in its piece
    rows = apart.withColumn("meets", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1))).select("root", "rid", "key", "sig", "component", "rest", "piece", "part", "meets")
    more = apart.where("rest").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select("root", "rid", "key", "sig", "component", "rest", "piece", "part", F.col("piece").alias("meets"))
    met = texts.join(rows.unionByName(more).distinct(), ["rid", "key"]).groupBy("root", "part", "meets").applyInArrow(across, _EDGES)
    final = components(edges.unionByName(met))
    return groups.select("sig").join(final, F.col("sig") == F.col("node"), "left").select("sig", F.coalesce("root", "sig").alias("root"))


def join_documents(docs: DataFrame, width: int = WIDTH, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document `doc_id`, `rid` and `key` (hashes of the row), `n_shingles`, `component_id` and `stays`,
    whether the row is its component's first (the least id, rows without one last; rows alike
    in id and text are all first)."""
    texts = keyed_texts_of(docs, id_col, text_col)
    found = cut(profiles(texts, width))
    who = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid", "key", "size")

    def classes_of(rows: DataFrame) -> DataFrame:
        return rows.where("n > 0").groupBy("sig").agg(F.min("sig2").alias("one"), F.max("sig2").alias("two"), F.count("*").alias("copies"), F.min(who).alias("who"), F.first("n").alias("n"), F.first("bins").alias("bins"))

    classes = cut(classes_of(found))
    # Names that two classes share: about n^2 / 2^65 of n classes, so none or a few.
    clashes = frozenset(r["sig"] for r in classes.where("one <> two").select("sig").collect())
    if clashes:
        found = found.withColumn("sig", F.when(F.col("sig").isin(*clashes), F.col("sig2")).otherwise(F.col("sig")))
        classes = cut(classes_of(found))
    count = found.count()
    limit = max(FREQUENT, count // 1000)
    product = cut(prefix_product(texts, _frequent(found, limit), max(12, count // BLOCK_DOCS), clashes, width, threshold))
    pairs = product.where("c is not null").groupBy("a", "b").agg(F.sum("c").alias("c"), F.min("least").alias("least")).where(F.col("c") >= F.greatest(F.lit(1), F.floor(F.col("least") / 20)))
    edges = _possible(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")), classes, threshold).unionByName(_chains(product.where("c is null"), classes, threshold))
    roots = components(edges)
    groups = cut(roots.join(classes.select("sig", "who.rid", "who.key", "who.size"), F.col("node") == F.col("sig")).select("sig", "rid", "key", "size", "root"))
    heavy = groups.groupBy("root").agg(F.sum("size").alias("held")).where(F.col("held") > GROUP).select("root", F.ceil(F.col("held") / (GROUP // 4)).cast("long").alias("parts"))
    heavy = cut(heavy)
    settled = _settled(texts, groups.join(heavy, "root", "left_anti"), max(12, count // 4096), clashes, width, threshold)
    if not heavy.isEmpty():
        settled = settled.unionByName(_large(texts, groups.join(heavy, "root"), clashes, width, threshold))
    told = classes.select("sig", "who", "copies").join(settled, "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    firsts = told.groupBy("root").agg(F.min("who").alias("first"))
    told = cut(told.join(firsts, "root").select("sig", "copies", "first"))
    # Classes of many copies, at most a thousand, are told to all tasks; the others meet their documents by a shuffle.
    often = F.col("copies") > max(32, count // 1000)
    rows = found.where("n > 0").select("doc_id", "rid", "key", "n", "sig")
    many = told.where(often).select("sig", F.col("first").alias("known"))
    marked = rows.join(F.broadcast(many), "sig", "left")
    one = marked.where("known is not null").select("doc_id", "rid", "key", "n", F.col("known").alias("first"))
    two = marked.where("known is null").drop("known").join(told.where(~often).select("sig", "first"), "sig", "left").select("doc_id", "rid", "key", "n", "first")
    both = one.unionByName(two)
    stays = (F.col("rid") == both["first.rid"]) & (F.col("key") == both["first.key"])
    linked_rows = both.select("doc_id", "rid", "key", F.col("n").alias("n_shingles"), F.col("first.doc_id").alias("component_id"), stays.alias("stays"))
    alone = found.where("n = 0").select("doc_id", "rid", "key", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("stays"))
    return linked_rows.unionByName(alone)


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_documents(table(spark, sf_dir, "documents"), width=4, threshold=85).select("doc_id", "n_shingles", "component_id")


QUERIES = {"op5_jaccard": op5_jaccard}
ORACLES = {
    "op5_jaccard": r"""
WITH RECURSIVE said AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: list_slice(w, i, i + 3))
                                      WHEN len(w) > 0 THEN [w] ELSE [] END) AS g
  FROM said),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT u, v FROM shared JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v
  WHERE 100 * k >= 85 * (x.n + y.n - k)),
reached AS (
  SELECT u AS doc_id, v AS other FROM links
  UNION SELECT r.doc_id, l.v FROM reached r JOIN links l ON r.other = l.u)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, least(d.doc_id, coalesce(r.least, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id
LEFT JOIN (SELECT doc_id, min(other) AS least FROM reached GROUP BY doc_id) r ON r.doc_id = d.doc_id"""
}
