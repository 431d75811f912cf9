"""Scoring texts by context-tree weighting over bytes.

Each byte is eight binary decisions, and each of the 255 decision nodes has a context
tree over the bytes before it, to DEPTH.  A node of a tree holds counts of zeros and
ones; its Krichevsky-Trofimov estimate and the product of its children are mixed half and
half, from the leaves up.  A bit's probability mixes the estimates of all depths along
its context with the weights that follow, and a text's code length is the sum over its
bytes and one end mark.

Counts are gathered from the training documents as counts of byte grams (context and
byte), summed in slices before they're shuffled, and kept by bucket of the two nearest
context bytes, so that everything below depth 2 is in one bucket.  The two depths above
are summed from all buckets: at most 256 x 255 nodes, whatever the corpus.  To score,
batches of documents ask the buckets for their distinct grams and words, and sum what
they are told.  A bucket that is asked for much, since its pair of bytes is frequent, answers
in several tasks, each with the bucket's model and some of the batches.

Defined results: A-Z are lower-cased first.  Null text is the empty text, of which only
the end mark is scored.  A row without an id is trained on.  Rows that repeat count as
often as they occur.  Without training documents all bits have probability 1/2.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playlog.llm._bytes import mix, release, steady, word_hashes
from playlog.llm._spark import cut, table, texts_of

DEPTH = 5
#: Text bytes of a batch and of a bucket's share; bytes counted at a time when training.
BATCH, BUCKET, SLICE = 4_000_000, 32_000_000, 8_000_000
#: Buckets of grams at most, there being 65,536 pairs of bytes, and bytes of keys that one
#: task answers.
GRAM_BUCKETS, ASKED = 4_096, 64_000_000
_END = 0xFF  # never in UTF-8
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_HALF = math.log(0.5)
_MASK = np.uint64(0xFF)


def grams(texts: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """The gram of every byte and end mark, nearest context byte first and the byte itself
    last, and where each text's begin (and the last end)."""
    steady()
    edge = bytes([_END])
    buf = np.frombuffer(b"".join([edge * depth + x.translate(_LOWER) + edge for x in texts]), dtype=np.uint8).astype(np.uint64)
    size = np.array([len(x) + 1 for x in texts], dtype=np.int64)
    ends = np.concatenate([[0], np.cumsum(size)])
    n = len(buf) - depth
    out = buf[depth:].copy()
    for k in range(1, depth + 1):
        out |= buf[depth - k : depth - k + n] << np.uint64(8 * (depth - k + 1))
    inside = np.ones(n, dtype=bool)  # all but the leading marks of the texts after the first
    for k in range(depth):
        inside[ends[1:-1] + depth * np.arange(len(texts) - 1) + k] = False
    return out[inside], ends


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """For x > 0, to about 1e-12: shifted up, then Stirling's series."""
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        low = y < 8
        shift[low] -= np.log(y[low])
        y[low] += 1
    z = 1 / (y * y)
    return shift + (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z / 1188)))) / y


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural logarithm of the Krichevsky-Trofimov block probability."""
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1.0) - math.log(math.pi)


class Level:
    """Nodes of one depth: keys (context, decision node), counts and both probabilities."""

    def __init__(self, keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None):
        self.keys, self.zeros, self.ones = keys, zeros, ones
        self.estimate = log_kt(zeros, ones)
        self.weighted = self.estimate if below is None else np.logaddexp(self.estimate, below) + _HALF
        # share of a node's own estimate in the mixture
        self.own = np.ones(len(keys)) if below is None else np.exp(self.estimate - self.weighted + _HALF)

    def at(self, keys: np.ndarray, bit: np.ndarray, deeper: np.ndarray | None) -> np.ndarray:
        """Probability of `bit` at the nodes, given that of the next depth."""
        if not len(self.keys):
            return np.full(len(keys), 0.5)
        i = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        known = self.keys[i] == keys
        total = self.zeros[i] + self.ones[i] + 1.0
        kt = (np.where(bit == 1, self.ones[i], self.zeros[i]) + 0.5) / total
        p = kt if deeper is None else self.own[i] * kt + (1 - self.own[i]) * deeper
        return np.where(known, p, 0.5)


def _decisions(contexts: np.ndarray, byte: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and bits of the t-th decision of each byte in its context."""
    node = (np.uint64(1) << np.uint64(t)) | (byte >> np.uint64(8 - t))
    return contexts << np.uint64(8) | node, (byte >> np.uint64(7 - t)) & np.uint64(1)


def _counted(contexts: np.ndarray, byte: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, bits = zip(*[_decisions(contexts, byte, t) for t in range(8)], strict=True)
    keys, where = np.unique(np.concatenate(keys), return_inverse=True)
    one = np.concatenate(bits) == 1
    weight = np.tile(n.astype(float), 8)
    return keys, np.bincount(where[~one], weight[~one], len(keys)), np.bincount(where[one], weight[one], len(keys))


def parent_sums(level: Level, keys: np.ndarray) -> np.ndarray:
    """Sum of the weighted log probabilities of the children of each key."""
    up = (level.keys >> np.uint64(16) << np.uint64(8)) | (level.keys & _MASK)
    return np.bincount(np.searchsorted(keys, up), level.weighted, len(keys))


def build(gram: np.ndarray, n: np.ndarray, depth: int, top: int) -> dict[int, Level]:
    """Levels from `depth` up to `top` for distinct grams with counts."""
    byte = gram & _MASK
    levels: dict[int, Level] = {}
    for k in range(depth, top - 1, -1):
        keys, zeros, ones = _counted(gram >> np.uint64(8 * (depth - k + 1)), byte, n)
        levels[k] = Level(keys, zeros, ones, parent_sums(levels[k + 1], keys) if k < depth else None)
    return levels


def log10_probability(gram: np.ndarray, levels: dict[int, Level], depth: int) -> np.ndarray:
    """Of each gram's byte in its context, by all levels (0 to `depth`)."""
    byte = gram & _MASK
    out = np.zeros(len(gram))
    for t in range(8):
        p = None
        for k in range(depth, -1, -1):
            key, bit = _decisions(gram >> np.uint64(8 * (depth - k + 1)), byte, t)
            p = levels[k].at(key, bit, p)
        out += np.log10(p)
    return out


def _buckets_of(kind: str, keys: np.ndarray, buckets: int, depth: int) -> np.ndarray:
    own = keys >> np.uint64(8 * (depth - 1)) if kind == "gram" else keys
    return (mix(own + np.uint64(77)) % np.uint64(buckets)).astype(np.int64)


def _split(kind: str, keys: np.ndarray, buckets: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order of buckets, and where each bucket's begin."""
    bucket = _buckets_of(kind, keys, buckets, depth)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def _planes(numbers: np.ndarray) -> bytes:
    """64-bit numbers byte plane by byte plane: sorted or small ones compress well so."""
    return np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _joined(blobs: list[bytes]) -> np.ndarray:
    return np.concatenate([_numbers(b) for b in blobs]) if blobs else np.zeros(0, np.uint64)


def _words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return word_hashes(texts, lower=True)


def counts(docs: DataFrame, buckets: dict[str, int], depth: int) -> DataFrame:
    """Counts of grams and words of the training documents: kind, bucket, keys, n."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part: list[bytes] = []
            held = 0
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for i, x in enumerate(texts):
                part.append(x)
                held += len(x)
                if held >= SLICE or i == len(texts) - 1:
                    rows = []
                    for kind, found in (("gram", grams(part, depth)[0]), ("word", _words_of(part)[0])):
                        keys, n = np.unique(found, return_counts=True)
                        order, edge = _split(kind, keys, buckets[kind], depth)
                        keys, n = keys[order], n[order]
                        rows += [(kind, b, _planes(keys[lo:hi]), _planes(n[lo:hi])) for b, (lo, hi) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)) if hi > lo]
                    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.binary(), pa.binary()), strict=True)] if rows else [pa.array([], k) for k in (pa.string(), pa.int32(), pa.binary(), pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["kind", "bucket", "keys", "n"])
                    part, held = [], 0

    def merge(part: pa.Table) -> pa.Table:
        keys = _joined(part.column("keys").to_pylist())
        n = _joined(part.column("n").to_pylist()).view(np.int64)
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        total = np.add.reduceat(n, new)
        return pa.table({"kind": part.column("kind").slice(0, 1), "bucket": part.column("bucket").slice(0, 1), "keys": pa.array([_planes(keys[new])], pa.binary()), "n": pa.array([_planes(total)], pa.binary()), "distinct": pa.array([len(new)], pa.int64()), "total": pa.array([int(total.sum())], pa.int64())})

    gathered = docs.where(~F.col("held_out")).select("text").mapInArrow(count, "kind string, bucket int, keys binary, n binary")
    return gathered.groupBy("kind", "bucket").applyInArrow(merge, "kind string, bucket int, keys binary, n binary, distinct long, total long")


def top_levels(model: DataFrame, depth: int) -> dict[int, Level]:
    """Levels 1 and 0, summed from all buckets: at most 256 x 255 nodes are collected."""

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, n in zip(batch.column("keys").to_pylist(), batch.column("n").to_pylist(), strict=True):
                gram, total = _numbers(keys), _numbers(n).view(np.int64)
                under = build(gram, total, depth, 2)[2]
                up = (under.keys >> np.uint64(16) << np.uint64(8)) | (under.keys & _MASK)
                keys, where = np.unique(up, return_inverse=True)
                sums = [np.bincount(where, x, len(keys)) for x in (under.zeros, under.ones, under.weighted)]
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), *map(pa.array, sums)], names=["key", "zeros", "ones", "below"])

    rows = model.where("kind = 'gram'").select("keys", "n").mapInArrow(tops, "key long, zeros double, ones double, below double")
    got = rows.groupBy("key").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("below").alias("below")).orderBy("key").toArrow()
    keys, zeros, ones, below = (got.column(c).to_numpy() for c in ("key", "zeros", "ones", "below"))
    one = Level(keys.astype(np.uint64), zeros, ones, below)
    nodes, where = np.unique(one.keys & _MASK, return_inverse=True)
    root = Level(nodes, *[np.bincount(where, x, len(nodes)) for x in (zeros, ones, one.weighted)])
    return {1: one, 0: root}


def answering(model: DataFrame, buckets: int, batches: int) -> np.ndarray:
    """In how many tasks each bucket of grams answers, from what batches will ask of it: at most
    twice its distinct grams, or its share of their text."""
    told = model.where("kind = 'gram'").select("bucket", "distinct", "total").collect()  # GRAM_BUCKETS rows at most
    everything = max(1, sum(r["total"] for r in told))
    out = np.ones(buckets, dtype=np.int64)
    for r in told:
        asked = batches * min(2 * r["distinct"], BATCH * r["total"] // everything + 1) * 8
        out[r["bucket"]] = max(1, -(-asked // ASKED))
    return out


class Scorer:
    """`tasks`: for each bucket of grams in how many tasks it answers."""

    def __init__(self, buckets: dict[str, int], depth: int, tasks: np.ndarray):
        self.buckets, self.depth, self.tasks = buckets, depth, tasks

    def _batch(self, docs: pa.Table) -> tuple[list[int], list[bytes]]:
        ids, texts = docs.column("doc_id").to_pylist(), docs.column("text").cast(pa.binary()).to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i]))
        return order, [texts[i] for i in order]

    def ask(self, docs: pa.Table) -> pa.Table:
        """The distinct grams and words of a batch, by bucket."""
        _, texts = self._batch(docs)
        batch = docs.column("batch")[0].as_py()
        out: dict[str, list] = {"batch": [], "kind": [], "bucket": [], "task": [], "keys": []}
        for kind, found in (("gram", grams(texts, self.depth)[0]), ("word", _words_of(texts)[0])):
            keys = _distinct(found)
            order, edge = _split(kind, keys, self.buckets[kind], self.depth)
            keys = keys[order]
            for b, (lo, hi) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)):
                if hi > lo:
                    task = batch % int(self.tasks[b]) if kind == "gram" else 0
                    for name, x in zip(out, (batch, kind, b, task, _planes(keys[lo:hi])), strict=True):
                        out[name].append(x)
        kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.binary())
        return pa.table({name: pa.array(x, k) for (name, x), k in zip(out.items(), kinds, strict=True)})

    def answer(self, asked: pa.Table, model: pa.Table, top: dict[int, Level]) -> pa.Table:
        """For grams the log10 probability of their byte, for words their count."""
        blobs = asked.column("keys").to_pylist()
        data: list[bytes] = []
        if blobs:
            keys = _joined(blobs)
            distinct = _distinct(keys)
            if model.num_rows:
                known, n = _numbers(model.column("keys")[0].as_py()), _numbers(model.column("n")[0].as_py()).view(np.int64)
            else:
                known, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            if asked.column("kind")[0].as_py() == "gram":
                value = log10_probability(distinct, build(known, n, self.depth, 2) | top, self.depth)
            elif len(known):
                i = np.minimum(np.searchsorted(known, distinct), len(known) - 1)
                value = np.where(known[i] == distinct, n[i], 0).astype(np.float64)
            else:
                value = np.zeros(len(distinct))
            told = value[np.searchsorted(distinct, keys)]
            data = [x.astype("<f8").tobytes() for x in np.split(told, np.cumsum([len(b) // 8 for b in blobs])[:-1])]
        return pa.table({"batch": asked.column("batch"), "kind": asked.column("kind"), "bucket": asked.column("bucket"), "data": pa.array(data, pa.binary())})

    def score(self, docs: pa.Table, answers: pa.Table, tokens: int, words: int, ends: int) -> pa.Table:
        names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "n_bytes"]
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()]
        if not docs.num_rows:
            return pa.table({name: pa.array([], k) for name, k in zip(names, kinds, strict=True)})
        order, texts = self._batch(docs)
        told: dict[str, dict[int, bytes]] = {"gram": {}, "word": {}}
        for kind, b, x in zip(*(answers.column(c).to_pylist() for c in ("kind", "bucket", "data")), strict=True):
            told[kind][b] = x
        found, at = grams(texts, self.depth)
        score = np.add.reduceat(self._spread("gram", found, told["gram"]), at[:-1])
        found, at = _words_of(texts)
        count = self._spread("word", found, told["word"])
        size = np.diff(at)
        scale = math.log10(tokens + words + 1)
        sums = [np.concatenate([[0.0], np.cumsum(x)]) for x in (np.log10(count + 1) - scale, count > 0)]
        base, known = (s[at[1:]] - s[at[:-1]] for s in sums)
        release()
        take = pa.array(order)
        columns = [docs.column("doc_id").take(take), docs.column("held_out").take(take), size + 1, known.astype(np.int64) + (ends > 0), base + math.log10(ends + 1) - scale, score, np.array([len(x) for x in texts])]
        return pa.table({name: c if isinstance(c, pa.ChunkedArray) else pa.array(c, k) for name, c, k in zip(names, columns, kinds, strict=True)})

    def _spread(self, kind: str, found: np.ndarray, told: dict[int, bytes]) -> np.ndarray:
        """The answer to each key, in the keys' order."""
        by = np.argsort(found)
        ordered = found[by]
        new = np.ones(len(found), dtype=bool)
        new[1:] = ordered[1:] != ordered[:-1]
        first = np.flatnonzero(new)
        buckets = self.buckets[kind]
        order, edge = _split(kind, ordered[first], buckets, self.depth)
        value = np.empty(len(first))
        value[order] = np.frombuffer(b"".join([told[b] for b in range(buckets) if edge[b + 1] > edge[b]]), dtype="<f8")
        out = np.empty(len(found))
        out[by] = np.repeat(value, np.diff(np.append(first, len(found))))
        return out


def _distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def score_documents(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Per document both scores (log10), token counts and `bits_per_byte`, the model's code
    length; trained on the documents whose id's CRC-32 isn't 2 modulo 7."""
    texts = texts_of(docs).withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(0)) % 7 == 2)
    size = texts.agg(F.sum(F.octet_length("text")).alias("size"), F.count_if(~F.col("held_out")).alias("ends")).collect()[0]
    ends, size = size["ends"], size["size"] or 0
    words_in, batches = max(12, -(-size // BUCKET)), max(1, -(-size // BATCH))
    buckets = {"gram": min(words_in, GRAM_BUCKETS), "word": words_in}
    model = cut(counts(texts, buckets, depth))
    told = model.where("kind = 'word'").agg(F.sum("total"), F.sum("distinct")).collect()[0]
    tokens, words = (told[0] or 0) + ends, (told[1] or 0) + (ends > 0)
    top = docs.sparkSession.sparkContext.broadcast(top_levels(model, depth))
    tasks = answering(model, buckets["gram"], batches)
    scorer = Scorer(buckets, depth, tasks)
    by_batch = texts.withColumn("batch", F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(batches))).groupBy("batch")
    asked = by_batch.applyInArrow(lambda t: scorer.ask(t), "batch long, kind string, bucket int, task long, keys binary")
    many = docs.sparkSession.createDataFrame([("gram", b, int(n)) for b, n in enumerate(tasks.tolist()) if n > 1], "kind string, bucket int, tasks long")
    dealt = model.select("kind", "bucket", "keys", "n").join(F.broadcast(many), ["kind", "bucket"], "left")
    dealt = dealt.withColumn("task", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("tasks", F.lit(1).cast("long")) - 1))).drop("tasks")
    by = ("kind", "bucket", "task")
    answers = asked.groupBy(*by).cogroup(dealt.groupBy(*by)).applyInArrow(lambda a, b: scorer.answer(a, b, top.value), "batch long, kind string, bucket int, data binary")
    out = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long"
    scored = by_batch.cogroup(answers.groupBy("batch")).applyInArrow(lambda a, b: scorer.score(a, b, tokens, words, ends), out)
    bits = (-F.col("score") * math.log2(10) / (F.col("n_bytes") + 1)).alias("bits_per_byte")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score", bits)


def op4_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op4_ctw": op4_ctw}
ORACLES: dict[str, str] = {}
