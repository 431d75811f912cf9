"""Nearest neighbours by additive quantisation.

Directions are coded as a sum of one full-dimensional word from each of several
codebooks.  The codebooks are trained one after another, by k-means on the residuals of
a bounded sample; every vector is then encoded by beam search, and its length and its
code's length are stored.  A query's inner products with all words make a lookup table,
so a code is scored by a few additions times the stored norms; the best of each block
are reranked by their exact inner product in double precision.

Equal vectors, told by 128 bits of hash, are one entry of the index, with the k+1 smallest of
their ids; more can't be among any query's k nearest, so long runs of copies neither crowd
out others nor break ties wrongly.

Search is a stated query set against all rows, in blocks: entries fall in blocks of up to
`block_rows`, queries in parts of up to `query_rows`, and each pair of block and part is one
task, to which go codes and lengths of the entries (codes are 32 bytes) and the vectors of the queries.
It tells each query's best by score.  Over all blocks the `shortlist` best of each query are
kept, and only their vectors are fetched, once for each smaller part of the queries that
wants them, and reranked.  So what is moved is, besides the index itself, codes times parts,
queries times blocks, and at most shortlist / 20 vectors an entry where every twentieth row is a query.

Defined results: a vector that is null, zero, holds a null or a value that isn't
finite, or differs in length from the commonest length (smaller if tied), or whose id
is null, takes no part.  Rows that repeat an id count as rows of their own as
candidates; as a query such an id counts once, with its smallest vector.  With fewer
than k candidates all are returned.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType
from pyspark.sql.window import Window

from playlog.llm._spark import cut, table

#: Training sample's bound, codebooks, words in each, k-means rounds, width of the beam.
SAMPLE, BOOKS, WORDS, ROUNDS, BEAM = 16_384, 32, 256, 4, 2
#: Candidates of a query that are reranked; entries of a block, and of a block at least where
#: there are cores enough; queries of a part, and of a part when reranking.
SHORTLIST, BLOCK_ROWS, LEAST_ROWS, QUERY_ROWS, RERANK_ROWS = 128, 131_072, 4_096, 8_192, 512


class AdditiveQuantiser:
    """`books`: (codebooks, words, dimensions), single precision."""

    def __init__(self, books: np.ndarray):
        self.books = books
        self.squares = (books**2).sum(2)

    @staticmethod
    def train(x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = ROUNDS, seed: int = 7) -> AdditiveQuantiser:
        """Residual k-means over unit vectors `x`."""
        rng = np.random.default_rng(seed)
        rest = x.astype(np.float32).copy()
        out = []
        for _ in range(books):
            centres = rest[rng.choice(len(rest), size=words, replace=len(rest) < words)].copy()
            for _ in range(rounds):
                near = np.argmin((centres**2).sum(1) - 2 * rest @ centres.T, axis=1)
                sums = np.zeros_like(centres)
                np.add.at(sums, near, rest)
                n = np.bincount(near, minlength=words)
                used = n > 0
                centres[used] = sums[used] / n[used, None]
                if (~used).any():
                    centres[~used] = rest[rng.choice(len(rest), size=int((~used).sum()))]
            near = np.argmin((centres**2).sum(1) - 2 * rest @ centres.T, axis=1)
            rest -= centres[near]
            out.append(centres)
        return AdditiveQuantiser(np.stack(out))

    def encode(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Codes (rows, codebooks) and the length of each code's sum, for unit vectors."""
        codes = np.zeros((len(x), self.books.shape[0]), dtype=np.uint8)
        norms = np.zeros(len(x), dtype=np.float32)
        for at in range(0, len(x), 1024):
            part = x[at : at + 1024].astype(np.float32)
            n, rows = len(part), np.arange(len(part))[:, None]
            rest, path = part[:, None, :], np.zeros((n, 1, 0), dtype=np.uint8)
            loss = (part**2).sum(1)[:, None]
            for book, square in zip(self.books, self.squares, strict=True):
                now = (rest.reshape(-1, rest.shape[2]) @ (-2 * book.T) + square).reshape(n, rest.shape[1], -1)
                # each path's best words, then the best of all paths
                near, gain = [], []
                for _ in range(min(beam, len(book))):
                    word = np.argmin(now, axis=2)[:, :, None]
                    near.append(word)
                    gain.append(np.take_along_axis(now, word, axis=2))
                    np.put_along_axis(now, word, np.inf, axis=2)
                word, total = np.concatenate(near, axis=2), np.concatenate(gain, axis=2) + loss[:, :, None]
                each = word.shape[2]
                word, total = word.reshape(n, -1), total.reshape(n, -1)
                best = np.argsort(total, axis=1, kind="stable")[:, :beam]
                parent, word, loss = best // each, word[rows, best], total[rows, best]
                rest = rest[rows, parent] - book[word]
                path = np.concatenate([path[rows, parent], word[:, :, None].astype(np.uint8)], axis=2)
            win = np.argmin(loss, axis=1)
            codes[at : at + n] = path[np.arange(n), win]
            norms[at : at + n] = np.linalg.norm(part - rest[np.arange(n), win], axis=1)
        return codes, norms

    def scores(self, queries: np.ndarray, codes: np.ndarray, scale: np.ndarray) -> np.ndarray:
        """Approximate inner products (queries, rows) by lookup tables."""
        lut = np.einsum("qd,mwd->mqw", queries.astype(np.float32), self.books, optimize=True)
        total = np.take(lut[0], codes[:, 0], axis=1)
        for m in range(1, len(lut)):
            total += np.take(lut[m], codes[:, m], axis=1)
        return total * scale


def usable(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """`vec_id` and `vector` (array of float, if it is that, or double) of the rows that take part."""
    told = rows.schema[vec_col].dataType
    single = isinstance(told, ArrayType) and isinstance(told.elementType, FloatType)
    vec = F.col(f"`{vec_col}`") if single else F.col(f"`{vec_col}`").cast("array<double>")
    x = rows.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), vec.alias("vector")).where(
        F.col("vec_id").isNotNull()
        & F.col("vector").isNotNull()
        & F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")).cast("double")))
        & F.exists("vector", lambda v: v != 0)
    )
    commonest = x.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    return x.where(F.size("vector") == (commonest[0]["size"] if commonest else 0))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 1))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def fit(vectors: DataFrame, sample: int = SAMPLE) -> AdditiveQuantiser | None:
    """Codebooks from at most `sample` vectors, chosen by a hash of the id."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("vector").toArrow()
    if not rows.num_rows:
        return None
    x = _matrix(rows.column("vector"))
    return AdditiveQuantiser.train(x / np.linalg.norm(x, axis=1, keepdims=True))


def index(vectors: DataFrame, quantiser: AdditiveQuantiser) -> DataFrame:
    """Every row with two hashes of its vector, its code and `scale`, its length over its code's length."""
    shared = vectors.sparkSession.sparkContext.broadcast(quantiser.books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = AdditiveQuantiser(shared.value)
        for batch in batches:
            x = _matrix(batch.column("vector"))
            length = np.linalg.norm(x, axis=1)
            codes, norms = own.encode(x / length[:, None]) if len(x) else (np.zeros((0, 1), np.uint8), np.zeros(0))
            scale = length / np.maximum(norms, 1e-12)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("vec_id", *HASHES)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(scale.astype(np.float32), pa.float32())],
                names=["vec_id", *HASHES, "code", "scale"],
            )

    return hashed(vectors).mapInArrow(run, "vec_id long, h1 long, h2 long, code binary, scale float")


#: Two hashes, of different seeds, that tell vectors apart.
HASHES = ("h1", "h2")


def hashed(vectors: DataFrame) -> DataFrame:
    return vectors.select("vec_id", F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(1), F.col("vector")).alias("h2"), "vector")


def entries(coded: DataFrame, k: int) -> DataFrame:
    """One row for each distinct vector: hashes, code, scale and `ids`, its k+1 smallest ids
    with the number of rows of each."""
    counted = coded.groupBy(*HASHES, "vec_id").agg(F.count("*").alias("n"), F.first("code").alias("code"), F.first("scale").alias("scale"))
    rank = F.row_number().over(Window.partitionBy(*HASHES).orderBy("vec_id"))
    few = counted.withColumn("rank", rank).where(F.col("rank") <= k + 1)
    return few.groupBy(*HASHES).agg(F.first("code").alias("code"), F.first("scale").alias("scale"), F.array_sort(F.collect_list(F.struct("vec_id", "n"))).alias("ids"))


def _keys(table_: pa.Table | pa.StructArray) -> np.ndarray:
    """The two hashes of each row as one comparable value."""
    h1, h2 = (np.asarray(table_.column(c) if isinstance(table_, pa.Table) else table_.field(c), dtype=np.int64) for c in HASHES)
    out = np.empty(len(h1), dtype=[("h1", "<i8"), ("h2", "<i8")])
    out["h1"], out["h2"] = h1, h2
    return out


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, shortlist: int = SHORTLIST, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS, rerank_rows: int = RERANK_ROWS) -> DataFrame:
    """The k nearest of each query by inner product, the query's own id left out.
    Both inputs as from `usable`."""
    result = "query_id long, rank int, vec_id long, score double"
    spark = vectors.sparkSession
    quantiser = fit(vectors)
    if quantiser is None:
        return spark.createDataFrame([], result)
    once = cut(queries.groupBy("vec_id").agg(F.min("vector").alias("vector")))
    held = cut(entries(index(vectors, quantiser), k))
    rows, asking = held.count(), once.count()
    blocks = max(-(-rows // block_rows), min(spark.sparkContext.defaultParallelism, -(-rows // LEAST_ROWS)), 1)
    parts = max(1, -(-asking // query_rows))
    # of a block a query's share of the shortlist, with six deviations, and k+1
    share = shortlist / blocks
    best = min(shortlist, int(share + 6 * share**0.5) + k + 1)
    coded = held.select(*HASHES, "code", "scale").withColumn("block", F.pmod("h1", F.lit(blocks))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    query = once.select(F.col("vec_id").alias("query_id"), "vector")
    asked = query.withColumn("part", F.pmod(F.xxhash64("query_id", F.lit(1)), F.lit(parts)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    shared = spark.sparkContext.broadcast(quantiser.books)

    def scan(rows: pa.Table, queries: pa.Table) -> pa.Table:
        """The best entries of a block for each query of a part, by their codes."""
        out: list[list] = [[], [], [], []]
        if rows.num_rows and queries.num_rows:
            own = AdditiveQuantiser(shared.value)
            codes = np.frombuffer(b"".join(rows.column("code").to_pylist()), dtype=np.uint8).reshape(rows.num_rows, -1)
            scale, keys = rows.column("scale").to_numpy().astype(np.float32), _keys(rows)
            ids, x = queries.column("query_id").to_numpy(), _matrix(queries.column("vector"))
            take = min(best, len(codes))
            step = max(1, (1 << 24) // len(codes))
            for at in range(0, len(ids), step):
                scores = own.scores(x[at : at + step], codes, scale)
                top = np.argpartition(-scores, take - 1, axis=1)[:, :take]
                near = keys[top.ravel()]
                for column, part in zip(out, (np.repeat(ids[at : at + step], take), near["h1"], near["h2"], np.take_along_axis(scores, top, 1).ravel()), strict=True):
                    column.append(part)
        kinds = (np.int64, np.int64, np.int64, np.float32)
        return pa.table({name: np.concatenate(c).astype(t) if c else np.zeros(0, t) for name, c, t in zip(("query_id", *HASHES, "near"), out, kinds, strict=True)})

    scanned = coded.groupBy("block", "part").cogroup(asked.groupBy("block", "part")).applyInArrow(scan, "query_id long, h1 long, h2 long, near float")
    order = Window.partitionBy("query_id").orderBy(F.desc("near"), *HASHES)
    chosen = scanned.withColumn("place", F.row_number().over(order)).where(F.col("place") <= shortlist)
    last_parts = max(1, -(-asking // rerank_rows))
    part = F.pmod(F.xxhash64("query_id", F.lit(2)), F.lit(last_parts))
    lists = cut(chosen.groupBy("query_id").agg(F.collect_list(F.struct(*HASHES)).alias("near")).withColumn("part", part))
    wanted = lists.select(F.col("part").alias("wanted_by"), F.explode("near").alias("x")).select("wanted_by", "x.*").distinct()
    exact = hashed(vectors).select(*HASHES, "vector").dropDuplicates([*HASHES])
    fetched = wanted.join(exact, [*HASHES]).join(held.select(*HASHES, "ids"), [*HASHES])

    def rerank(lists: pa.Table, rows: pa.Table) -> pa.Table:
        """The k nearest of each query by exact inner products."""
        out: list[list] = [[], [], [], []]
        if rows.num_rows and lists.num_rows:
            keys = _keys(rows)
            order = np.argsort(keys)
            keys, x = keys[order], _matrix(rows.column("vector"))[order]
            ids = rows.column("ids").combine_chunks()
            start, who, n = ids.offsets.to_numpy(), ids.values.field("vec_id").to_numpy(), ids.values.field("n").to_numpy()
            query_ids, q = lists.column("query_id").to_numpy(), _matrix(lists.column("vector"))
            near = lists.column("near").combine_chunks()
            edge, wanted = near.offsets.to_numpy(), np.searchsorted(keys, _keys(near.values))
            for i, own in enumerate(query_ids.tolist()):
                row = wanted[edge[i] - edge[0] : edge[i + 1] - edge[0]]
                score = (x[row] * q[i]).sum(1)
                top = np.argsort(-score, kind="stable")
                if len(top) > k + 1:  # all that tie with the last are kept
                    top = top[score[top] >= score[top[k]]]
                found, told = [], []
                for j in top.tolist():
                    at = order[row[j]]
                    mine = np.repeat(who[start[at] : start[at + 1]], np.minimum(n[start[at] : start[at + 1]], k))
                    mine = mine[mine != own][:k]
                    found.append(mine)
                    told.append(np.full(len(mine), score[j]))
                flat, scores = np.concatenate(found), np.concatenate(told)
                keep = np.lexsort((flat, -scores))[:k]
                for column, part in zip(out, (np.full(len(keep), own), np.arange(1, len(keep) + 1), flat[keep], scores[keep]), strict=True):
                    column.append(part)
        kinds = (np.int64, np.int32, np.int64, np.float64)
        return pa.table({name: np.concatenate(c).astype(t) if c else np.zeros(0, t) for name, c, t in zip(("query_id", "rank", "vec_id", "score"), out, kinds, strict=True)})

    return lists.join(query, "query_id").groupBy("part").cogroup(fetched.groupBy("wanted_by")).applyInArrow(rerank, result)


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = usable(table(spark, sf_dir, "embeddings"))
    return search(vectors, vectors.where(F.col("vec_id") % 20 == 0))


QUERIES = {"op9_ann": op9_ann}
ORACLES: dict[str, str] = {}
