"""Operators that look across documents, against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from playlog.llm import ann, ctw, graph, jaccard, suffix

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CLASH = "doc_id long, text string, n long, sig long, batch string, component_id int, bins string"


def words(rnd, n, of=400):
    return ["w" + str(rnd.randint(0, of)) for _ in range(n)]


def corpus(seed, copies=40):
    """Texts of their own, near copies of some, a passage that many share, and odd ones."""
    rnd = random.Random(seed)
    base = [words(rnd, rnd.randint(5, 120), 10**6) for _ in range(12)]
    passage = words(rnd, 30, 10**6)
    texts = [None, "", " \n", "a b", "A  b", "a b c d", "a b c d", "é🎉 ÀB x" * 20]
    for b in base:
        texts.append(" ".join(b))
        for _ in range(rnd.randint(0, copies // 4)):
            c = list(b)
            for _ in range(rnd.randint(0, 3)):
                c[rnd.randrange(len(c))] = "e" + str(rnd.randint(0, 10**6))
            texts.append(" ".join(c).upper() if rnd.random() < 0.3 else " ".join(c))
    for _ in range(copies):
        texts.append(" ".join(words(rnd, rnd.randint(0, 60), 10**6) + passage))
    rnd.shuffle(texts)
    return texts


def frame(spark, texts):
    rows = [(k, t, 1, 2, "b", 3, "x") for k, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[3], (None, "no id at all here", 1, 2, "b", 3, "x")], CLASH)


def linked_by_hand(rows, width, threshold):
    sets = {}
    for d, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOWER))
        sets[d] = frozenset(zip(*(w[k:] for k in range(width)))) if len(w) >= width else frozenset([tuple(w)] if w else [])
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= threshold * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


@pytest.mark.parametrize(("listed", "width", "threshold"), [(32, 4, 85), (2, 5, 80)])
def test_jaccard_components(spark, monkeypatch, listed, width, threshold):
    """Also with lists so short that most go through chains."""
    monkeypatch.setattr(jaccard, "LISTED", listed)
    df = frame(spark, corpus(1))
    want = linked_by_hand([(r["doc_id"], r["text"]) for r in df.collect() if r["doc_id"] is not None], width, threshold)
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.join_documents(df, width, threshold).collect()]
    assert len(got) == df.count()
    for d, n, c in got:
        assert (n, c) == (want[d] if d is not None else (6 - width, None))
    assert jaccard.join_documents(df.limit(0)).count() == 0


def near_copies(seed, sizes=(60, 25)):
    """Groups of near copies with texts that link two of them, and ones that merely share a passage."""
    rnd = random.Random(seed)
    texts, bases = [], [words(rnd, 60, 10**6) for _ in sizes]
    for base, n in zip(bases, sizes):
        for k in range(n):
            c = list(base)
            c[rnd.randrange(60)] = f"e{k}"
            texts.append(" ".join(c))
    texts += [" ".join(bases[0][:48] + words(rnd, 12, 10**6)) for _ in range(30)]
    chain = list(bases[1])
    for k in range(12):  # each like the one before it only
        chain = chain[:]
        chain[5 * k] = f"f{k}"
        texts.append(" ".join(chain))
    return texts


@pytest.mark.parametrize(("part", "group", "clash"), [(4, 2_000, False), (7, 10**6, True), (10**6, 500, True)])
def test_jaccard_of_hot_lists_and_groups(spark, monkeypatch, part, group, clash):
    """Long lists and large groups in parts, and first hashes that name several classes."""
    monkeypatch.setattr(jaccard, "PART", part)
    monkeypatch.setattr(jaccard, "GROUP", group)
    monkeypatch.setattr(jaccard, "LISTED", 2)
    monkeypatch.setattr(jaccard, "FREQUENT", 8)
    if clash:
        real = jaccard.signature

        def sign(s):
            one, two = real(s)
            return one % 97, two

        monkeypatch.setattr(jaccard, "signature", sign)
    rows = list(enumerate([*near_copies(2), *corpus(3, 12), *corpus(3, 12)[:5]]))
    random.Random(5).shuffle(rows)
    df = spark.createDataFrame([*rows, rows[0], rows[1]], "doc_id long, text string")
    for width, threshold in ((4, 85), (5, 60)):
        want = linked_by_hand(rows, width, threshold)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join_documents(df, width, threshold).collect()}
        assert got == want


def test_jaccard_of_repeated_and_missing_ids(spark):
    rnd = random.Random(8)
    a, b, c = (" ".join(words(rnd, 40, 10**6)) for _ in range(3))
    rows = [(5, a), (5, b), (5, a), (7, b + " more"), (None, a), (None, c), (None, c + " too"), (9, ""), (9, None), (None, None)]
    got = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["stays"]) for r in jaccard.join_documents(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect())
    assert got == collections.Counter({(5, 37, 5, True): 3, (7, 38, 5, False): 1, (None, 37, 5, False): 1, (None, 37, None, True): 1, (None, 38, None, False): 1, (9, 0, 9, True): 2, (None, 0, None, True): 1}) or got == collections.Counter({(5, 37, 5, True): 3, (7, 38, 5, False): 1, (None, 37, 5, False): 1, (None, 38, None, True): 1, (None, 37, None, False): 1, (9, 0, 9, True): 2, (None, 0, None, True): 1})


def test_word_hashes_tell_words_apart():
    from playlog.llm import _bytes

    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rnd = random.Random(4)
    texts = [f"{word} {other}", "", " x\ty ", *(" ".join("".join(rnd.choice("abAé") for _ in range(rnd.randint(1, 40))) for _ in range(rnd.randint(0, 30))) for _ in range(300))]
    found, at = _bytes.word_hashes([t.encode() for t in texts])
    flat = [w for t in texts for w in re.findall("[^\x20\x09-\x0d]+", t.translate(LOWER))]
    assert len(found) == len(flat) and at.tolist()[:4] == [0, 2, 2, 4]
    assert len(set(zip(flat, found.tolist()))) == len(set(flat)) == len(set(found.tolist()))


def test_bins_bound_the_overlap():
    rng = np.random.default_rng(1)
    for _ in range(100):
        pool = rng.integers(0, 1 << 63, 6000, dtype=np.uint64)
        a, b = (np.unique(rng.choice(pool, rng.integers(1, 5000))) for _ in range(2))
        assert jaccard._upper(jaccard.bins(a), jaccard.bins(b)[None, :])[0] >= len(np.intersect1d(a, b))


def test_components(spark):
    rnd = random.Random(3)
    edges = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1040)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        if u != v:
            a, b = find(u), find(v)
            root[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in list(root)}


def removed_by_hand(rows, least):
    first = {}
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        for p in range(len(t) - least + 1):
            first.setdefault(t[p : p + least], math.inf if d is None else d)
    out = collections.Counter()
    for d, t in rows:
        mask = bytearray(len(t))
        for p in range(len(t) - least + 1):
            if first[t[p : p + least]] < (math.inf if d is None else d):
                mask[p : p + least] = b"\1" * least
        kept = bytes(c for c, m in zip(t, mask) if not m)
        out[(d, len(t), sum(mask), len(re.findall(b"\1+", bytes(mask))), hashlib.sha256(kept).hexdigest())] += 1
    return out


@pytest.mark.parametrize(("batch", "fan"), [(2_000_000, 2_048), (3_000, 2_048), (1_000, 3)])
def test_suffix_removal(spark, monkeypatch, batch, fan):
    monkeypatch.setattr(suffix, "BATCH", batch)
    monkeypatch.setattr(suffix, "FAN", fan)
    rnd = random.Random(2)
    run = "".join(rnd.choice("ab ") for _ in range(400))
    texts = [*corpus(4), "x" * 49, "x" * 50, "x" * 200, *(run[rnd.randint(0, 200) : rnd.randint(200, 400)] + "é" * rnd.randint(0, 60) for _ in range(60))]
    df = frame(spark, texts)
    got = collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in suffix.remove_repeats(df).collect())
    assert got == removed_by_hand([(r["doc_id"], (r["text"] or "").encode()) for r in df.collect()], 50)
    assert suffix.remove_repeats(df.limit(0)).count() == 0


def test_suffix_removal_of_one_run_in_all_batches(spark, monkeypatch):
    """A run that every text repeats, and a bucket that gets each anchor once a batch."""
    monkeypatch.setattr(suffix, "BATCH", 2_000)
    monkeypatch.setattr(suffix, "FAN", 4)
    rnd = random.Random(6)
    run = "".join(rnd.choice("abcdefgh ") for _ in range(60))
    texts = [(run + "".join(rnd.choice("abc") for _ in range(rnd.randint(0, 5)))) * rnd.randint(1, 9) for _ in range(60)] + ["ab" * 400] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in suffix.remove_repeats(df).collect())
    assert got == removed_by_hand([(d, t.encode()) for d, t in enumerate(texts)], 50)
    import pyarrow as pa

    plan = suffix.Plan(4_000, 50)
    docs = pa.table({"doc_id": pa.array([1, 2], pa.int64()), "text": pa.array([run * 50, run * 20]), "batch": pa.array([0, 0], pa.int64())})
    sent = sum(len(x) for x in plan.anchors(docs).column("data").to_pylist()) // 5
    assert sent <= 60


def shuffle_files(spark):
    """Sizes of the shuffle files that the session has on disk."""
    import os

    found = {}
    for top in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs():
        for folder, _, names in os.walk(top.getPath()):
            for name in names:
                try:
                    found |= {name: os.path.getsize(f"{folder}/{name}")} if name.startswith("shuffle_") else {}
                except OSError:
                    pass  # gone meanwhile
    return found


def test_cut_leaves_no_shuffle_files(spark):
    import time

    from playlog.llm._spark import cut

    before, setting = set(shuffle_files(spark)), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    rows = spark.range(20_000).selectExpr("id % 7919 AS k", "sha2(string(id), 256) AS t")
    was = spark.conf.get(setting)
    done = cut(rows.groupBy("k").agg({"t": "max"}))
    assert done.count() == 7919 and spark.conf.get(setting) == was
    for _ in range(50):
        left = {k: n for k, n in shuffle_files(spark).items() if k not in before}
        if sum(left.values()) < 50_000:
            break
        time.sleep(0.2)
    assert sum(left.values()) < 50_000


def test_suffix_removal_holds_one_step_on_disk(spark, monkeypatch):
    """Stretches of text that stands twice are several times the text; they are gone when the
    texts are cut, and those that no more than FAN batches have aren't sent twice."""
    monkeypatch.setattr(suffix, "BATCH", 100_000)
    monkeypatch.setattr(suffix, "FAN", 4)
    rnd = random.Random(8)
    texts = ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz0123456789 ABCDEFGHIJKLMNOPQRSTUVWXYZ", k=5_000)) for _ in range(100)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts + texts)], "doc_id long, text string")
    before = set(shuffle_files(spark))
    assert sum(r["n_removed"] for r in suffix.remove_repeats(df).select("n_removed").collect()) == 500_000
    assert sum(n for k, n in shuffle_files(spark).items() if k not in before) < 2_000_000


def test_only_anchors_of_many_batches_are_merged(monkeypatch):
    import pyarrow as pa
    import pyarrow.compute

    monkeypatch.setattr(suffix, "FAN", 3)
    monkeypatch.setattr(suffix, "BATCH", 1_000)
    rnd = random.Random(7)
    often, pair = ("".join(rnd.choice("abcdefgh ") for _ in range(120)) for _ in range(2))
    plan = suffix.Plan(5_000, 50)
    docs = [pa.table({"doc_id": pa.array([2 * b, 2 * b + 1], pa.int64()), "text": pa.array([often, pair if b < 2 else "x"]), "batch": pa.array([b, b], pa.int64())}) for b in range(5)]
    asked = pa.concat_tables([plan.anchors(d) for d in docs])
    told = pa.concat_tables([plan.twice(asked.filter(pa.compute.equal(asked.column("bucket"), k))) for k in set(asked.column("bucket").to_pylist())])
    sent = [r for b, d in enumerate(docs) for r in plan.stretches(d, told.filter(pa.compute.equal(told.column("batch"), b))).to_pylist()]
    assert {r["batch"] for r in sent} == set(range(5))
    for r in sent:
        windows = list(r["windows"])
        parts, at = [], 0
        for w in windows:
            parts.append(r["bytes"][at : at + w + 49].decode())
            at += w + 49
        assert parts and all(x in (often if r["fan"] >= 0 else pair) for x in parts)
        assert r["fan"] in (-1, r["batch"] // 3) and (r["fan"] >= 0) == (r["part"] >= plan.shards)


def test_interval_expansion_finds_all_common_prefixes():
    rng = np.random.default_rng(3)
    for size, letters in ((300, 2), (2000, 3), (2000, 60)):
        text = rng.integers(1, letters + 1, size).astype(np.uint8)
        text[-1] = 0xFF
        order = suffix.suffix_order(text, 64)
        bound = suffix.bounded(text, order, 12)
        raw = text.tobytes() + b"\0" * 64
        for i in range(1, size):
            a, b = raw[order[i] : order[i] + 12], raw[order[i - 1] : order[i - 1] + 12]
            if b"\xff" not in a + b:
                assert bound[i] == (a != b)


@pytest.mark.parametrize(("batch", "asked"), [(4_000_000, 64_000_000), (300, 500)])
def test_context_tree_weighting(spark, monkeypatch, batch, asked):
    """Also with many batches and buckets that answer in many tasks."""
    monkeypatch.setattr(ctw, "BATCH", batch)
    monkeypatch.setattr(ctw, "ASKED", asked)
    texts = [t if t is None else t[:120] for t in corpus(5)[:14]] + ["Aé b\x00"]
    rows = [(k, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, rows[2]], "doc_id long, text string")
    got = {r["doc_id"]: r for r in ctw.score_documents(df).collect()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows}
    low = [(d, (t or "").translate(LOWER)) for d, t in [*rows, rows[2]]]
    depth, n, tokens = ctw.DEPTH, collections.Counter(), collections.Counter()
    for d, t in low:
        if not held[d]:
            tokens.update([*re.findall("[^\x20\x09-\x0d]+", t), None])
            q = b"\xff" * depth + t.encode() + b"\xff"
            for i in range(depth, len(q)):
                c = q[i - depth : i][::-1]
                for b in range(8):
                    for k in range(depth + 1):
                        n[c[:k], (1 << b) | (q[i] >> (8 - b)), (q[i] >> (7 - b)) & 1] += 1
    children = collections.defaultdict(set)
    for c, node, _ in n:
        if c:
            children[c[:-1], node].add(c)
    memo = {}

    def log_kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(c, node):
        if (c, node) not in memo:
            e = log_kt(n[c, node, 0], n[c, node, 1])
            if len(c) < depth:
                x = sum(weighted(k, node) for k in children[c, node])
                m = max(e, x)
                e = m + math.log(0.5 * math.exp(e - m) + 0.5 * math.exp(x - m))
            memo[c, node] = e
        return memo[c, node]

    def bit_p(c, node, bit, k=0):
        a = n[c[:k], node, 0], n[c[:k], node, 1]
        if not sum(a):
            return 0.5
        kt = (a[bit] + 0.5) / (sum(a) + 1)
        if k == depth:
            return kt
        own = math.exp(log_kt(*a) - weighted(c[:k], node) + math.log(0.5))
        return own * kt + (1 - own) * bit_p(c, node, bit, k + 1)

    size, kinds = sum(tokens.values()), len(tokens)
    for d, t in low:
        q = b"\xff" * depth + t.encode() + b"\xff"
        score = sum(math.log10(bit_p(q[i - depth : i][::-1], (1 << b) | (q[i] >> (8 - b)), (q[i] >> (7 - b)) & 1)) for i in range(depth, len(q)) for b in range(8))
        w = [*re.findall("[^\x20\x09-\x0d]+", t), None]
        r = got[d]
        assert r["score"] == pytest.approx(score, rel=1e-9)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[d], len(w), sum(tokens[x] > 0 for x in w), size)
        assert r["base_score"] == pytest.approx(sum(math.log10((tokens[x] + 1) / (size + kinds + 1)) for x in w), rel=1e-9)
    assert ctw.score_documents(df.limit(0)).count() == 0


def test_context_tree_weighting_rows_without_id_and_odd_columns(spark):
    rows = [(None, "a b a b", 1, "x", 2, "k"), (None, "a b a b", 1, "x", 2, "k"), (3, None, 1, "x", 2, "k"), (4, "", 1, "x", 2, "k"), (5, "A  b", 1, "x", 2, "k"), (5, "c", 1, "x", 2, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, batch int, kind string, task int, held_out string")
    got = [(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"]) for r in ctw.score_documents(df).collect()]
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in (3, 4, 5)}
    known = {"a", "b", *(["c"] if not held[5] else [])}
    want = [(None, False, 5, 5), (None, False, 5, 5), (3, held[3], 1, 1), (4, held[4], 1, 1), (5, held[5], 3, 3), (5, held[5], 2, 1 + ("c" in known))]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_neighbours(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(900, 16)).astype(np.float32)
    x[100:160] = x[100]
    rows = [(k, [float(v) for v in r], 1.0, "c") for k, r in enumerate(x)]
    odd = [(2000, None, 1.0, "c"), (2020, [0.0] * 16, 1.0, "c"), (2040, [float("nan")] * 16, 1.0, "c"), (2060, [None] + [1.0] * 15, 1.0, "c"), (2080, [1.0] * 3, 1.0, "c"), (None, [1.0] * 16, 1.0, "c")]
    df = spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<float>, scale double, code string")
    vectors = ann.usable(df)
    assert vectors.count() == 900
    got = collections.defaultdict(list)
    for r in ann.search(vectors, vectors.where("vec_id % 20 = 0"), block_rows=300, query_rows=20).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 900, 20))
    hits = 0
    y = x.astype(np.float64)
    for q, found in got.items():
        score = (y * y[q]).sum(1)
        want = [int(k) for k in np.lexsort((np.arange(900), -score)) if k != q][:20]
        hits += len(set(want) & {k for k, _ in found})
        assert [k for k, _ in found] == sorted((k for k, _ in found), key=lambda k: (-score[k], k))
        assert all(s == pytest.approx(score[k], abs=1e-12) for k, s in found)
    assert hits >= 0.9 * 20 * 45
    assert [k for k, _ in got[100]][:19] == [*range(101, 120)]
    assert ann.search(vectors.limit(0), vectors.limit(0)).count() == 0
    few = vectors.where("vec_id < 5")
    assert ann.search(few, few.where("vec_id = 0")).count() == 4


def test_neighbours_of_repeated_ids_and_common_vectors(spark):
    """Many blocks and parts, one vector in a third of the rows, ids that occur several times."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 8)).astype(np.float32)
    x[rng.choice(600, 200, replace=False)] = x[0]
    ids = [k if k % 7 else k // 14 * 14 for k in range(600)]
    df = spark.createDataFrame([(i, [float(v) for v in r], 1, 2) for i, r in zip(ids, x)], "vec_id long, embedding array<float>, h1 int, part int")
    vectors = ann.usable(df)
    queries = vectors.where("vec_id % 20 = 0")
    got = collections.defaultdict(list)
    for r in ann.search(vectors, queries, block_rows=100, query_rows=7, rerank_rows=5).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    y, hits, total = x.astype(np.float64), 0, 0
    assert set(got) == {i for i in ids if i % 20 == 0}
    for q, found in got.items():
        own = min(tuple(v) for i, v in zip(ids, y) if i == q)
        score = (y * np.array(own)).sum(1)
        order = [(ids[k], score[k]) for k in np.lexsort((ids, -score)) if ids[k] != q][:20]
        hits += len(set(found) & {(i, s) for i, s in order})
        total += len(set(order))
        assert len(found) == 20 and [s for _, s in found] == sorted((s for _, s in found), reverse=True)
    assert hits >= 0.9 * total
