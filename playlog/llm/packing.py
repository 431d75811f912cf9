"""Packing documents into fixed windows by minimum bin slack.

A document's ids (its text's ids by the `tokenizers` library, then one end id) are cut
every `window` ids; full pieces are sequences of their own.  The remaining lengths of a
shard form a multiset.  For each window the largest one left is taken, and a bitset
subset-sum dynamic programme over the other lengths (each with its count split in
powers of two) finds the sum closest to the room left; walking the programme back gives
how many of each length fill the window.

Shards are random parts of the documents of about `shard_docs` each, so that no task
holds more than a shard's lengths; the last window of a shard may stay partly empty.

Defined results: null text is the empty text, whose only id is the end id.  Repeated
rows are packed as often as they occur.  Other columns are ignored.  An empty table
gives no rows.
"""

from __future__ import annotations

import bisect
import functools
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playlog.llm._bytes import release
from playlog.llm._spark import table, texts_of
from playlog.llm.bpe import WORDS, RunIds, checked, default_tokenizer, slices

WINDOW = 4096
END_ID = 2
SHARD_DOCS = 4096

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class CachedTokenizer:
    """ids of texts by the `tokenizers` library, each distinct word being encoded once
    while it is remembered.  Words go to the library in lines and are told apart
    by the ids that end a word or, where a word can have several, by a mark between."""

    def __init__(self, path: str, most_words: int = WORDS):
        from tokenizers import Tokenizer

        checked(path)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        size = self.tokenizer.get_vocab_size()
        self.ends_word = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.is_mark = np.zeros(size, dtype=bool)
        self.is_mark[self._ids(["|"])[0]] = True
        self.known = RunIds(self._words, 2 * most_words // 3, most_words)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _lines(self, words: list[str], gap: str, last: np.ndarray, skip: int, out: dict[str, bytes]) -> None:
        """ids of words joined by `gap`; `last` tells the ids that end a word or, with
        `skip` 1, stand between words."""
        lines = [words[k : k + 64] for k in range(0, len(words), 64)]
        for line, got in zip(lines, self._ids([gap.join(line) for line in lines]), strict=True):
            ids = np.array(got, dtype="<u4")
            ends = (np.flatnonzero(last[ids]) + 1 - skip).tolist()
            raw, at = ids.tobytes(), 0
            for w, end in zip(line, [*ends, len(ids)] if skip else ends, strict=True):
                out[w] = raw[4 * at : 4 * end]
                at = end + skip

    def _words(self, words: list[str]) -> list[bytes]:
        out: dict[str, bytes] = {}
        # Letters of Latin-1 are one piece of the rules, whose last id alone ends a word.
        letters = [w for w in words if w.isalpha() and max(w) < "\xff"]
        other = [w for w in words if not (w.isalpha() and max(w) < "\xff")]
        self._lines(letters, " ", self.ends_word, 0, out)
        self._lines([w for w in other if "|" not in w], " | ", self.is_mark, 1, out)
        marked = [w for w in other if "|" in w]
        for w, ids in zip(marked, self._ids(marked), strict=True):
            out[w] = np.array(ids, dtype="<u4").tobytes()
        return [out[w] for w in words]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        for part in slices(texts):
            ids, at = self.known.encode(part)
            raw, at = ids.tobytes(), at.tolist()
            for a, b in zip(at[:-1], at[1:], strict=True):
                yield raw[4 * a : 4 * b]


@functools.lru_cache(1)
def cached(path: str, most_words: int = WORDS) -> CachedTokenizer:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return CachedTokenizer(path, most_words)


def piece_sums(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, most_words: int = WORDS) -> DataFrame:
    """Per document `n`, its ids with the end id, and `crcs`, the CRC-32 of each piece."""
    tail = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = cached(tokenizer, most_words)
        for batch in batches:
            n, crcs = [], []
            for ids in encoder.encode(batch.column("text").to_pylist()):
                ids += tail
                n.append(len(ids) // 4)
                crcs.append(np.array([zlib.crc32(ids[k : k + 4 * window]) for k in range(0, len(ids), 4 * window)], dtype="<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(crcs, pa.binary())], names=["doc_id", "n", "crcs"])
        release(0)

    return texts_of(docs).mapInArrow(run, "doc_id long, n long, crcs binary")


def fill(counts: dict[int, int], room: int, order: list[int] | None = None) -> dict[int, int]:
    """The sub-multiset of `counts` (length -> how many) with the largest sum up to
    `room`, found by bitset subset sums, lengths in falling order.  `order`: the lengths,
    rising, if they're at hand."""
    limit = (1 << (room + 1)) - 1
    reach, steps = 1, []
    order = sorted(counts) if order is None else order
    for at in range(bisect.bisect_right(order, room) - 1, -1, -1):
        length = order[at]
        left, k = min(counts[length], room // length), 1
        while left:
            k = min(k, left)
            steps.append((length, k, reach))
            reach |= reach << k * length & limit
            left -= k
            k *= 2
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    taken: dict[int, int] = defaultdict(int)
    for length, k, before in reversed(steps):
        if not before >> at & 1:
            at -= k * length
            taken[length] += k
    return taken


def min_bin_slack(lengths: list[int], window: int = WINDOW) -> list[list[int]]:
    """Indices of `lengths` (each from 1 to `window`) for every window, each at most full."""
    held: dict[int, list[int]] = defaultdict(list)
    for i in range(len(lengths) - 1, -1, -1):
        held[lengths[i]].append(i)
    counts = {x: len(v) for x, v in held.items()}
    order = sorted(counts)
    out = []
    while order:
        largest = order[-1]
        counts[largest] -= 1
        got = fill(counts, window - largest, order)
        got[largest] += 1
        counts[largest] += 1
        inside = []
        for length, k in sorted(got.items(), reverse=True):
            counts[length] -= k
            inside += [held[length].pop() for _ in range(k)]
            if not counts[length]:
                del counts[length]
                order.remove(length)
        out.append(inside)
    return out


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, shard_docs: int = SHARD_DOCS, most_words: int = WORDS) -> DataFrame:
    """Pieces of all documents with their place: `sequence_id` and `offset`.  `most_words`
    bounds what a worker remembers, for where memory is shared with other stages."""
    shards = max(1, -(-docs.count() // shard_docs))

    def place(part: pa.Table) -> pa.Table:
        part = part.sort_by([("doc_id", "ascending"), ("n", "ascending")])
        shard = part.column("shard")[0].as_py()
        ids, ns = part.column("doc_id").to_pylist(), part.column("n").to_pylist()
        crcs = [np.frombuffer(x, dtype="<u4") for x in part.column("crcs").to_pylist()]
        rows: list[tuple] = []
        rest: list[int] = []
        for i, n in enumerate(ns):
            for k in range(n // window):
                rows.append((ids[i], k * window, window, int(crcs[i][k]), n, len(rows), 0))
            if n % window:
                rest.append(i)
        number = len(rows)
        for inside in min_bin_slack([ns[i] % window for i in rest], window):
            offset = 0
            for j in inside:
                i = rest[j]
                size = ns[i] % window
                rows.append((ids[i], ns[i] - size, size, int(crcs[i][-1]), ns[i], number, offset))
                offset += size
            number += 1
        out = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)]
        out[5] = pa.array(np.array(out[5]) + (shard << 36), pa.int64())
        return pa.Table.from_arrays(out, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    summed = piece_sums(docs, tokenizer, window, end_id, most_words)
    dealt = summed.withColumn("shard", F.pmod(F.xxhash64("doc_id", "n", "crcs"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(place, PIECES)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_tokenizer())


QUERIES = {"op8_packing": op8_packing}
ORACLES: dict[str, str] = {}
