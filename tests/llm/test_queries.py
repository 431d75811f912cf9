"""The registered queries themselves, on a small folder, against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from test_corpus_ops import LOWER, corpus, linked_by_hand, near_copies, removed_by_hand
from test_text_ops import base_spans, odd_texts, statistics_of

from playlog.llm import bpe, queries


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    place = tmp_path_factory.mktemp("tables")
    more = [f'call token = "{hashlib.sha1(str(k).encode()).hexdigest()}" now' for k in range(12)] + ['x token = "s3cret" y', "İ! TARİHİ. İ́x", "me@a.org 1.2.3.4 +1 (555) 555-1234"]
    rnd = random.Random(1)
    long = [" ".join("w" + str(rnd.randint(0, 10**6)) for _ in range(n)) for n in (60, 3000)] + ["a b c " * 40, "\n".join(["one line here"] * 30)]
    texts = [*corpus(7), *near_copies(4, (9, 6))[:30], *odd_texts(6, 60), *more, *long]
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(place / "documents.parquet"))
    spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int").write.parquet(str(place / "labels.parquet"))
    x = np.random.default_rng(2).normal(size=(400, 16)).astype(np.float32)
    spark.createDataFrame([(k, [float(v) for v in r], 0) for k, r in enumerate(x)], "vec_id long, embedding array<float>, label int").write.parquet(str(place / "embeddings.parquet"))
    return str(place), [(k, t or "") for k, t in enumerate(texts)], x


def rows_of(spark, folder, name):
    return {r["doc_id"]: r for r in queries.QUERIES[name](spark, folder[0]).collect()}


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def test_op1(spark, folder):
    got = rows_of(spark, folder, "op1_pii")
    for d, t in folder[1]:
        spans, r = base_spans(t), got[d]
        told = [f"{kind}:{a}:{b}" for a, _, b, kind in spans]
        assert r["base_sha256"] == sha(",".join(told))
        assert tuple(r[f"n_{k}"] for k in ("email", "ip", "card", "phone")) == tuple(sum(s[3] == k for s in spans) for k in ("email", "ip", "card", "phone"))
        listed = [x for x in r["spans"].split(",") if x]
        assert [x for x in listed if x in set(told)] == told and len(listed) == len(told) + r["n_found"]
    (d,) = [d for d, t in folder[1] if "s3cret" in t]
    assert got[d]["spans"] == "secret:11:17"


def test_op2(spark, folder):
    got = rows_of(spark, folder, "op2_quality")
    for d, t in folder[1]:
        want, r = statistics_of(t), got[d]
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r["kept"] and r["base_failed"])


def test_op3(spark, folder):
    got = collections.Counter((d, r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for d, r in rows_of(spark, folder, "op3_suffix").items())
    assert got == removed_by_hand([(d, t.encode()) for d, t in folder[1]], 50)


def test_op4(spark, folder):
    got = rows_of(spark, folder, "op4_ctw")
    words = {d: [*re.findall("[^\x20\x09-\x0d]+", t.translate(LOWER)), None] for d, t in folder[1]}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in words}
    count = collections.Counter(w for d, x in words.items() if not held[d] for w in x)
    n, v = sum(count.values()), len(count)
    for d, x in words.items():
        r = got[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[d], len(x), sum(count[w] > 0 for w in x), n)
        assert r["base_score"] == pytest.approx(sum(np.log10((count[w] + 1) / (n + v + 1)) for w in x), rel=1e-9)
        assert r["score"] < 0


def test_op5(spark, folder):
    got = {d: (r["n_shingles"], r["component_id"]) for d, r in rows_of(spark, folder, "op5_jaccard").items()}
    assert got == linked_by_hand(folder[1], 4, 85)


def test_op8_and_op10(spark, folder):
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(bpe.default_tokenizer())
    ids = {d: library.encode(t, add_special_tokens=False).ids for d, t in folder[1]}
    for d, r in rows_of(spark, folder, "op10_bpe").items():
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids[d]), sha(" ".join(map(str, ids[d]))))
        assert r["decoded_sha256"] == sha(library.decode(ids[d], skip_special_tokens=False))
    pieces, places = collections.Counter(), collections.defaultdict(list)
    for r in queries.QUERIES["op8_packing"](spark, folder[0]).collect():
        whole = [*ids[r["doc_id"]], 2]
        part = np.array(whole[r["start"] : r["start"] + r["length"]], dtype="<u4")
        assert (r["doc_tokens"], r["length"], r["ids_crc32"]) == (len(whole), len(part), zlib.crc32(part.tobytes()))
        pieces[r["doc_id"]] += r["length"]
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert pieces == {d: len(x) + 1 for d, x in ids.items()}
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096


def test_op9(spark, folder):
    got = collections.defaultdict(list)
    for r in queries.QUERIES["op9_ann"](spark, folder[0]).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    x, hits = folder[2].astype(np.float64), 0
    assert sorted(got) == list(range(0, 400, 20))
    for q, found in got.items():
        found.sort()
        score = (x * x[q]).sum(1)
        want = [int(k) for k in np.lexsort((np.arange(400), -score)) if k != q][:20]
        assert [r for r, _, _ in found] == list(range(1, 21)) and all(s == pytest.approx(score[k], abs=1e-12) for _, k, s in found)
        assert [k for _, k, _ in found] == sorted((k for _, k, _ in found), key=lambda k: (-score[k], k))
        hits += len(set(want) & {k for _, k, _ in found})
    assert hits >= 0.9 * 400
