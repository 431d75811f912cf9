"""Removal of byte strings that repeat across documents, by suffix arrays.

A byte goes if some 50-byte string that covers it also starts in a document of a smaller
id.  Strings are compared in full, over all documents:

1. Documents are dealt into batches.  Every 50-byte window has an anchor, the 16 bytes in
   it with the least hash; equal windows have equal anchors at equal places, so a window
   can only repeat where its anchor does.  Anchors' hashes meet in buckets, which answer
   with one bit each: whether it occurs twice or more.
2. Around anchors that do, the stretches that their windows cover go to shards by anchor;
   a batch sends equal stretches once, with the least id that has them there.
3. A shard joins its distinct stretches into one text, sorts its suffixes by their first
   64 bytes, and has the Burrows-Wheeler transform.  Intervals of suffixes that share a
   prefix are expanded breadth-first by backward extension; boundaries between neighbours
   are thereby found in the order of their common prefix, and expansion stops at 50.  What
   is left unbounded shares 50 bytes or more; its least id decides.
4. Shards answer with one bit for each window of a stretch, batches apply the answers.

A bucket sees an anchor once for each batch, whatever the number of copies, and a shard sees a
stretch once for each batch.  Anchors that stand in more than FAN batches have shards of their own,
which see a stretch once for each FAN batches: its equals there are merged on the way to the
shard and told apart on the way back.  All other stretches travel once.

What buckets and shards tell is written to the shared checkpoint folder, a bit for each anchor and
window, so that at no time more than the texts and one step's rows are on disk.  The documents are read once
for each step, and must be the same each time.

Defined results: null text is the empty text.  Rows without an id come after all ids.
Rows that share an id don't remove each other's bytes.  Texts shorter than 50 bytes stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playlog.llm._bytes import mix, ranges, release, steady
from playlog.llm._spark import cut, keyed_texts_of, table

LEAST = 50
ANCHOR = 16
#: Text bytes of a batch, of all anchors that meet in a bucket, and of a shard's share; in
#: how many texts, one after the other, a shard is transformed.
BATCH, BUCKET, SHARD, PARTS = 2_000_000, 24_000_000, 16_000_000, 16
#: Batches that an anchor may stand in before its equal stretches are merged, so many batches at a time.
FAN = 2_048
_LAST = np.iinfo(np.int64).max
_END = 0xFF  # never in UTF-8
_CHUNK = 1 << 17


def _loads(buf: np.ndarray, big: bool = False) -> np.ndarray:
    """The eight bytes from each place on as one number (len - 7 of them), as a view."""
    n = max(0, len(buf) - 7)
    return np.ndarray((n,), dtype=">u8" if big else "<u8", buffer=buf if n else np.zeros(8, np.uint8), strides=(1,))


def _eight(buf: np.ndarray, big: bool = False) -> np.ndarray:
    return _loads(buf, big).astype(np.uint64)


def window_anchors(buf: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """For each window of `buf` the place of its anchor, and each place's 64-bit hash."""
    width = least - ANCHOR + 1
    n = len(buf)
    places = np.zeros(max(0, n - least + 1), dtype=np.int64)
    hashes = np.zeros(max(0, n - ANCHOR + 1), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(places), _CHUNK):
            part = buf[at : at + _CHUNK + least - 1]
            eight = _eight(part)
            h = eight[:-8] * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
            h += eight[8:] * np.uint64(0xC2B2AE3D27D4EB4F)
            h = mix(h)
            hashes[at : at + len(h)] = h
            key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
            span, done = key, 1
            while done * 2 <= width:
                span = np.minimum(span[:-done], span[done:])
                done *= 2
            if done < width:
                span = np.minimum(span[: len(span) - (width - done)], span[width - done :])
            places[at : at + len(span)] = (span & np.uint64(0xFFFFFFFF)).astype(np.int64) + at
    return places, hashes


class Batch:
    """The documents of a batch in order, as one buffer, and their runs of windows that
    share an anchor."""

    def __init__(self, docs: pa.Table, least: int):
        steady()
        ids = docs.column("doc_id").fill_null(_LAST).to_numpy().astype(np.int64)
        texts = docs.column("text").cast(pa.binary()).to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
        self.order = order
        self.ids = ids[order]
        self.texts = [texts[i] for i in order]
        self.ends = np.cumsum([len(x) for x in self.texts], dtype=np.int64)
        self.starts = self.ends - np.array([len(x) for x in self.texts], dtype=np.int64)
        self.buf = np.frombuffer(b"".join(self.texts), dtype=np.uint8)
        places, hashes = window_anchors(self.buf, least)
        size = self.ends - self.starts - (least - 1)  # windows inside each document
        inside = ranges(self.starts[size > 0], size[size > 0])
        place = places[inside]
        new = np.ones(len(inside), dtype=bool)
        new[1:] = (place[1:] != place[:-1]) | (inside[1:] != inside[:-1] + 1)
        first = np.flatnonzero(new)
        self.first = inside[first]  # the run's first window
        self.windows = np.diff(np.append(first, len(inside)))
        self.owner = np.searchsorted(self.ends, self.first, side="right")
        self.hash = hashes[place[first]]

    def by_bucket(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The batch's distinct anchors in order of their buckets, where each bucket begins,
        each run's place among them, and whether the batch itself has the anchor twice."""
        anchor, which, n = np.unique(self.hash, return_inverse=True, return_counts=True)
        part = (mix(anchor ^ np.uint64(_SALT_BUCKET)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        return anchor[order], np.searchsorted(part[order], np.arange(buckets + 1)), place[which], n[order] > 1

    def keep(self, runs: np.ndarray) -> None:
        self.first, self.windows, self.owner, self.hash = (x[runs] for x in (self.first, self.windows, self.owner, self.hash))


def same_stretches(buf: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each stretch (of eight bytes or more) the number of its text, and one stretch of
    each text.  Texts are told apart by 128 bits of hash over all their bytes."""
    loads = _loads(buf)
    a, b = size.astype(np.uint64), ~size.astype(np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, int(size.max()) if len(size) else 0, 8):
            x = loads[first + np.minimum(at, size - 8)]  # past the end the last eight bytes again
            a = (a ^ x) * np.uint64(0x9E3779B97F4A7C15)
            a ^= a >> np.uint64(32)
            b = (b + x) * np.uint64(0xD6E8FEB86659FD93)
            b ^= b >> np.uint64(29)
    order = np.argsort(a)  # should the first half alone be equal, a text may get several numbers
    a, b = a[order], b[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    text = np.empty(len(order), dtype=np.int64)
    text[order] = np.cumsum(new) - 1
    return text, order[new]


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of `text` by their first `depth` bytes or more (a power of two times 8);
    the text is taken to go on with zeros."""
    n = len(text)
    key = _eight(np.concatenate([text, np.zeros(7, np.uint8)]), big=True)
    order = np.argsort(key)
    sorted_key = key[order]
    new = np.ones(n, dtype=bool)
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    rank = np.empty(n + depth, dtype=np.int64)
    rank[n:] = -1
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, n))
    rank[order] = np.repeat(start, size)
    slots = ranges(start[size > 1], size[size > 1])
    known = 8
    while known < depth and len(slots):
        who = order[slots]
        key = (rank[who] << 32) | (rank[who + known] + 1)
        by = np.argsort(key)
        who, key = who[by], key[by]
        order[slots] = who
        new = np.ones(len(slots), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(slots)))
        rank[who] = np.repeat(slots[start], size)
        more = np.repeat(size > 1, size)
        slots = slots[more]
        known *= 2
    return order


def bounded(text: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """Whether each suffix in `order` (at its place there) shares fewer than `least` bytes
    with the one before it, by interval expansion on the Burrows-Wheeler transform.  The
    text ends with a byte that stands in nothing that is compared; for prefixes that hold
    it the answer may be off."""
    n = len(text)
    bwt = text[order - 1]
    into = np.argsort(bwt, kind="stable").astype(np.int32)  # from the first column to the last
    back = np.empty(n, dtype=np.int32)
    back[into] = np.arange(n)
    head = bwt[into]
    same = head[1:] == head[:-1]
    after = np.full(n, n, dtype=np.int32)  # the next place with the same byte
    after[into[:-1][same]] = into[1:][same]
    before = np.full(n, -1, dtype=np.int32)
    before[into[1:][same]] = into[:-1][same]

    bound = np.zeros(n + 1, dtype=bool)
    bound[[0, n]] = True
    begin = min(8, least)
    key = _eight(np.concatenate([text, np.zeros(7, np.uint8)]), big=True)[order] >> np.uint64(64 - 8 * begin)
    bound[1:n] = key[1:] != key[:-1]
    edge = np.flatnonzero(bound)
    lo, hi = edge[:-1], edge[1:]
    for _ in range(begin, least):
        if not len(lo):
            break
        size = hi - lo
        at = ranges(lo, size)
        first = back[at[before[at] < np.repeat(lo, size)]]
        last = back[at[after[at] >= np.repeat(hi, size)]] + np.int32(1)
        first.sort()
        last.sort()
        fresh = ~bound[last]
        lo, hi = first[fresh], last[fresh]
        bound[hi] = True
    return bound[:n]


def repeated_windows(buf: np.ndarray, first: np.ndarray, windows: np.ndarray, ids: np.ndarray, least: int) -> np.ndarray:
    """For distinct stretches of `buf`, each with its least id: the least id of each of
    their windows, stretch after stretch."""
    size = windows + least - 1
    total = int(size.sum()) + len(size)
    text = np.full(total, _END, dtype=np.uint8)
    where = np.cumsum(size + 1) - (size + 1)
    text[ranges(where, size)] = buf[ranges(first, size)]
    order = suffix_order(text, 64 if least <= 64 else 1 << (least - 1).bit_length())
    bound = bounded(text, order, least)
    own = np.full(total, _LAST, dtype=np.int64)
    starts = ranges(where, windows)
    own[starts] = np.repeat(ids, windows)
    edge = np.flatnonzero(bound)
    lowest = np.minimum.reduceat(own[order], edge)
    of = np.empty(total, dtype=np.int64)
    of[order] = np.repeat(lowest, np.diff(np.append(edge, total)))
    return of[starts]


_SALT_BUCKET, _SALT_SHARD, _SALT_PART = 0x1234567, 0x7654321, 0x1357913


#: What is told of a shard or merged for it.
_MET = {"kind": pa.int32(), "fan": pa.int64(), "batch": pa.int64(), "part": pa.int32(), "bytes": pa.binary(), "windows": pa.binary(), "ids": pa.binary(), "subs": pa.binary()}


def _table(kinds: dict[str, pa.DataType], columns: dict) -> pa.Table:
    """A table of these columns, null where none is given."""
    n = len(columns["kind"])
    return pa.table({k: columns[k] if isinstance(columns.get(k), pa.ChunkedArray) else pa.array(columns.get(k, [None] * n), kind) for k, kind in kinds.items()})


class Plan:
    """How many batches, buckets and shards there are; the functions of the four steps."""

    def __init__(self, size: int, least: int, characters: bool = False):
        self.least = least
        self.characters = characters
        self.batches = max(1, -(-size // BATCH))
        self.buckets = max(12, -(-size // BUCKET))
        self.shards = max(12, -(-size // SHARD))
        self.fan = FAN
        #: From `shards` on they are those of anchors in more than FAN batches.
        self.parts = self.shards * (2 if self.batches > self.fan else 1)

    def anchors(self, docs: pa.Table) -> pa.Table:
        batch = Batch(docs, self.least)
        anchor, edge, _, _ = batch.by_bucket(self.buckets)
        raw = anchor.view(np.uint8).reshape(-1, 8)[:, :5]
        out = [(b, raw[lo:hi].tobytes()) for b, (lo, hi) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)) if hi > lo]
        release()
        return pa.table({"batch": pa.array([docs.column("batch")[0].as_py()] * len(out), pa.int64()), "bucket": pa.array([x[0] for x in out], pa.int32()), "data": pa.array([x[1] for x in out], pa.binary())})

    def twice(self, part: pa.Table) -> pa.Table:
        """For each anchor of each batch one bit, whether it occurs twice or more, and after these
        bits another for each, whether in more than FAN batches, if any anchor of the entry is."""
        steady()
        blobs = part.column("data").to_pylist()
        raw = np.frombuffer(b"".join(blobs), dtype=np.uint8).reshape(-1, 5)
        gram = np.zeros((len(raw), 8), dtype=np.uint8)
        gram[:, :5] = raw
        gram = gram.view("<u8").ravel()
        order = np.argsort(gram)
        gram = gram[order]
        new = np.ones(len(gram), dtype=bool)
        new[1:] = gram[1:] != gram[:-1]
        n = np.diff(np.append(np.flatnonzero(new), len(gram)))
        flag, many = np.zeros(len(gram), dtype=bool), np.zeros(len(gram), dtype=bool)
        flag[order] = np.repeat(n > 1, n)
        many[order] = np.repeat((n > self.fan) & (self.batches > self.fan), n)
        ends = np.cumsum([len(x) // 5 for x in blobs])[:-1]
        bits = [np.packbits(x).tobytes() + (np.packbits(y).tobytes() if y.any() else b"") for x, y in zip(np.split(flag, ends), np.split(many, ends), strict=True)]
        return pa.table({"batch": part.column("batch"), "part": part.column("bucket"), "shard": pa.array([False] * len(bits)), "data": pa.array(bits, pa.binary())})

    def _candidates(self, docs: pa.Table, bits: dict[int, bytes]) -> tuple[Batch, np.ndarray, np.ndarray, np.ndarray]:
        """The batch with its repeated runs only, in order of shards; the number of each
        run's text; one run (of the least id) for each text, in that order; shard edges."""
        batch = Batch(docs, self.least)
        _, edge, place, flag = batch.by_bucket(self.buckets)
        many = np.zeros(len(flag), dtype=bool)
        for b, (lo, hi) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)):
            if hi > lo and b in bits:
                told, half = np.frombuffer(bits[b], np.uint8), -(-(hi - lo) // 8)
                flag[lo:hi] |= np.unpackbits(told[:half], count=hi - lo).astype(bool)
                if len(told) > half:
                    many[lo:hi] = np.unpackbits(told[half:], count=hi - lo).astype(bool)
        runs = np.flatnonzero(flag[place])
        many = many[place[runs]]
        batch.keep(runs)
        text, one = same_stretches(batch.buf, batch.first, batch.windows + self.least - 1)
        # runs go by document, so the first of a text has its least id
        one = np.full(len(one), len(text), dtype=np.int64)
        np.minimum.at(one, text, np.arange(len(text)))
        shard = (mix(batch.hash[one] ^ np.uint64(_SALT_SHARD)) % np.uint64(self.shards)).astype(np.int64) + self.shards * many[one]
        by = np.lexsort((one, shard))
        place = np.empty(len(one), dtype=np.int64)
        place[by] = np.arange(len(one))
        return batch, place[text], one[by], np.searchsorted(shard[by], np.arange(self.parts + 1))

    @staticmethod
    def _told(answers: pa.Table, shard: bool) -> dict[int, bytes]:
        return {p: x for p, s, x in zip(*(answers.column(c).to_pylist() for c in ("part", "shard", "data")), strict=True) if s == shard}

    def stretches(self, docs: pa.Table, answers: pa.Table) -> pa.Table:
        out: dict[str, list] = {k: [] for k in ("fan", "batch", "part", "bytes", "windows", "ids", "subs")}
        if docs.num_rows:
            batch, _, one, edge = self._candidates(docs, self._told(answers, False))
            for s, (lo, hi) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)):
                if hi > lo:
                    runs = one[lo:hi]
                    windows = batch.windows[runs]
                    number = docs.column("batch")[0].as_py()
                    out["fan"].append(number // self.fan if s >= self.shards else -1)
                    out["batch"].append(number)
                    out["part"].append(s)
                    out["bytes"].append(batch.buf[ranges(batch.first[runs], windows + self.least - 1)].tobytes())
                    out["windows"].append(windows.astype(np.uint8).tobytes())
                    out["ids"].append(batch.ids[batch.owner[runs]].tobytes())
                    out["subs"].append((mix(batch.hash[runs] ^ np.uint64(_SALT_PART)) % np.uint64(PARTS)).astype(np.uint8).tobytes())
        release()
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        return pa.table({k: pa.array(x, kind) for (k, x), kind in zip(out.items(), kinds, strict=True)})

    def _merged(self, part: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of entries: windows of each; all their bytes, windows and ids; the number of each
        stretch's text; one stretch, the least id and the sub-shard of each text."""
        steady()
        windows = [np.frombuffer(x, np.uint8).astype(np.int64) for x in part.column("windows").to_pylist()]
        ids = np.concatenate([np.frombuffer(x, np.int64) for x in part.column("ids").to_pylist()])
        buf = np.frombuffer(b"".join(part.column("bytes").to_pylist()), dtype=np.uint8)
        each = np.concatenate(windows)
        size = each + self.least - 1
        text, one = same_stretches(buf, np.cumsum(size) - size, size)
        least = np.full(len(one), _LAST, dtype=np.int64)
        np.minimum.at(least, text, ids)
        subs = np.frombuffer(b"".join(part.column("subs").to_pylist()), dtype=np.uint8)[one]
        return windows, buf, each, ids, text, one, least, subs

    @staticmethod
    def _masks(part: pa.Table, windows: list[np.ndarray], gone: np.ndarray) -> pa.Table:
        ends = np.cumsum([int(w.sum()) for w in windows])
        bits = [np.packbits(x).tobytes() for x in np.split(gone, ends[:-1])]
        return pa.table({"batch": part.column("batch"), "part": part.column("part"), "shard": pa.array([True] * len(bits)), "data": pa.array(bits, pa.binary())})

    def expand(self, part: pa.Table) -> pa.Table:
        """A shard: one bit for each window of each stretch, whether a smaller id has it."""
        windows, buf, each, ids, text, one, least, subs = self._merged(part)
        size = each + self.least - 1
        first = np.cumsum(size) - size
        at = np.cumsum(each[one]) - each[one]
        lowest = np.empty(int(each[one].sum()), dtype=np.int64)
        for k in range(PARTS):
            mine = np.flatnonzero(subs == k)
            if len(mine):
                lowest[ranges(at[mine], each[one[mine]])] = repeated_windows(buf, first[one[mine]], each[one[mine]], least[mine], self.least)
        gone = lowest[ranges(at[text], each)] < np.repeat(ids, each)
        release()
        return self._masks(part, windows, gone)

    def met(self, part: pa.Table) -> pa.Table:
        """What `expand` tells of a shard (kind 0); of entries that are to be merged, see `merge`."""
        if part.column("fan")[0].as_py() >= 0:
            return self.merge(part)
        told = self.expand(part)
        return _table(_MET, {"kind": [0] * told.num_rows, "fan": [-1] * told.num_rows, "batch": told.column("batch"), "part": told.column("part"), "bytes": told.column("data")})

    def merge(self, part: pa.Table) -> pa.Table:
        """The entries of some batches for a shard as one: each stretch once, with its least id
        (kind 1); and for each of the entries its ids and the numbers of its stretches there (kind 2)."""
        part = part.sort_by("batch")
        windows, buf, each, ids, text, one, least, subs = self._merged(part)
        size = each + self.least - 1
        raw = buf[ranges((np.cumsum(size) - size)[one], size[one])].tobytes()
        ends = np.cumsum([len(x) for x in windows])[:-1]
        release()
        n = part.num_rows
        more: dict[str, list] = {
            "kind": [1, *[2] * n],
            "fan": [part.column("fan")[0].as_py()] * (n + 1),
            "batch": [None, *part.column("batch").to_pylist()],
            "part": [part.column("part")[0].as_py()] * (n + 1),
            "bytes": [raw, *[None] * n],
            "windows": [each[one].astype(np.uint8).tobytes(), *[None] * n],
            "ids": [least.tobytes(), *(x.tobytes() for x in np.split(ids, ends))],
            "subs": [subs.tobytes(), *(x.astype("<u4").tobytes() for x in np.split(text, ends))],
        }
        return _table(_MET, more)

    def spread(self, part: pa.Table, answer: pa.Table) -> pa.Table:
        """What `expand` told of merged entries, for the entries they were made of: a window
        that stays for the least id goes for all others."""
        rows = part.to_pylist()
        out: dict[str, list] = {"batch": [], "part": [], "shard": [], "data": []}
        for merged in (r for r in rows if r["kind"] == 1):
            each, least = np.frombuffer(merged["windows"], np.uint8).astype(np.int64), np.frombuffer(merged["ids"], np.int64)
            told = np.unpackbits(np.frombuffer(answer.column("data")[0].as_py(), np.uint8), count=int(each.sum())).astype(bool)
            at = np.cumsum(each) - each
            for r in (r for r in rows if r["kind"] == 2):
                ids, text = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["subs"], "<u4")
                gone = told[ranges(at[text], each[text])] | np.repeat(ids > least[text], each[text])
                for k, x in zip(out, (r["batch"], r["part"], True, np.packbits(gone).tobytes()), strict=True):
                    out[k].append(x)
        return pa.table({k: pa.array(x, kind) for (k, x), kind in zip(out.items(), (pa.int64(), pa.int32(), pa.bool_(), pa.binary()), strict=True)})

    def remove(self, docs: pa.Table, answers: pa.Table) -> pa.Table:
        kinds = {"doc_id": pa.int64(), "rid": pa.int64(), "key": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "starts": pa.list_(pa.int64()), "ends": pa.list_(pa.int64()), "kept": pa.binary()}
        out: dict[str, list] = {k: [] for k in kinds}
        if docs.num_rows:
            batch, text, one, edge = self._candidates(docs, self._told(answers, False))
            told = self._told(answers, True)
            windows = batch.windows[one]
            at = np.append(np.cumsum(windows) - windows, windows.sum())
            gone = np.zeros(int(at[-1]), dtype=bool)
            for s, (lo, hi) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)):
                if hi > lo:
                    a, b = at[lo], at[hi]
                    gone[a:b] = np.unpackbits(np.frombuffer(told[s], np.uint8), count=int(b - a)).astype(bool)
            # a run of a larger id than the least in this batch goes whole
            later = batch.ids[batch.owner] > batch.ids[batch.owner[one[text]]]
            each = batch.windows
            flag = gone[ranges(at[text], each)] | np.repeat(later, each)
            hit = ranges(batch.first, each)[flag]
            begun = np.zeros(len(batch.buf) + self.least, dtype=np.int32)
            begun[hit + self.least] = 1
            begun = np.cumsum(begun, dtype=np.int32)  # windows to go that ended before each place
            off = np.zeros(len(batch.buf), dtype=bool)
            off[: len(begun) - self.least] = begun[self.least :] > begun[: -self.least]
            nulls, rids, keys = (docs.column(c).to_pylist() for c in ("doc_id", "rid", "key"))
            for k, i in enumerate(batch.order):
                lo, hi = int(batch.starts[k]), int(batch.ends[k])
                mask = off[lo:hi]
                change = np.diff(mask.view(np.int8), prepend=np.int8(0), append=np.int8(0))
                starts, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
                for name, x in (("doc_id", nulls), ("rid", rids), ("key", keys)):
                    out[name].append(x[i])
                out["n_bytes"].append(hi - lo)
                out["n_removed"].append(int((ends - starts).sum()))
                out["n_spans"].append(len(starts))
                out["starts"].append(starts)
                out["ends"].append(ends)
                kept = batch.buf[lo:hi][~mask].tobytes() if len(starts) else batch.texts[k]
                out["kept"].append(kept.decode("utf-8", "ignore").encode() if self.characters else kept)
        release()
        return pa.table({k: pa.array(x, kinds[k]) for k, x in out.items()})


def remove_repeats(docs: DataFrame, least: int = LEAST, characters: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its size, what is removed (`starts`, `ends` in bytes) and `kept`, the
    bytes that stay; with `characters` without what is left of a cut character.  `rid` and
    `key`, hashes of the row, tell rows apart that share an id."""
    texts = keyed_texts_of(docs, id_col, text_col)
    size = texts.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    plan = Plan(size, least, characters)
    dealt = texts.withColumn("batch", F.pmod("rid", F.lit(plan.batches)))
    by_batch = dealt.groupBy("batch")
    answer = "batch long, part int, shard boolean, data binary"
    bits = cut(by_batch.applyInArrow(lambda t: plan.anchors(t), "batch long, bucket int, data binary").groupBy("bucket").applyInArrow(lambda t: plan.twice(t), answer))
    entry = "batch long, part int, bytes binary, windows binary, ids binary, subs binary"
    stretches = by_batch.cogroup(bits.groupBy("batch")).applyInArrow(lambda a, b: plan.stretches(a, b), f"fan long, {entry}")
    met = cut(stretches.groupBy("fan", "part").applyInArrow(lambda t: plan.met(t), f"kind int, fan long, {entry}"))
    masks = met.where("kind = 0").select("batch", "part", F.lit(True).alias("shard"), F.col("bytes").alias("data"))
    if plan.batches > plan.fan:
        merged = met.where("kind = 1").select(F.col("fan").alias("batch"), "part", "bytes", "windows", "ids", "subs")
        told = merged.groupBy("part").applyInArrow(lambda t: plan.expand(t), answer).withColumnRenamed("batch", "fan")
        masks = masks.unionByName(met.where("kind > 0").groupBy("fan", "part").cogroup(told.groupBy("fan", "part")).applyInArrow(lambda a, b: plan.spread(a, b), answer))
    out = "doc_id long, rid long, key long, n_bytes long, n_removed long, n_spans long, starts array<long>, ends array<long>, kept binary"
    return by_batch.cogroup(bits.unionByName(masks).groupBy("batch")).applyInArrow(lambda a, b: plan.remove(a, b), out)


def op3_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = remove_repeats(table(spark, sf_dir, "documents"))
    return told.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op3_suffix": op3_suffix}
ORACLES: dict[str, str] = {}
