"""Operators that work text by text, against brute force."""

import collections
import random
import re

import numpy as np
import pytest

from playlog.llm import bpe, chat, licenses, packing, pii, quality

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")

CLASH = "doc_id long, text string, n long, key string, ids string, shard string, base int, words string"


def odd_texts(seed=1, n=150):
    rnd = random.Random(seed)
    bits = ["a", "Ab", "é", "ß", "Σ", "🎉", "日本", " ", "\n", "\t", "\x0b", "\x1c", "'s", ".", "<|", "<|endoftext|>", "1", "25", "@", "b.c", "+", "-", "4465758382889437", "(", "0", "#", "|"]
    texts = [None, "", " \n ", "x" * 30_000, "Same text here", "Same text here", "é x́", "﻿a​b", "a  b\n\n a  b\na  b\n"]
    return texts + ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 40))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, 7, "k", "i", "s", 3, "w") for k, t in enumerate(odd_texts())]
    return spark.createDataFrame([*rows, rows[5], (None, "no id 1.2.3.4", 1, None, None, None, None, None)], CLASH)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], CLASH)


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(bpe.default_tokenizer())


def test_bpe_is_the_library(docs, empty, library):
    path = bpe.default_tokenizer()
    encoded = bpe.encode(docs, path)
    got = {(r["doc_id"], tuple(r["ids"])) for r in encoded.collect()}
    want = {(r["doc_id"], tuple(library.encode(r["text"] or "", add_special_tokens=False).ids)) for r in docs.collect()}
    assert got == want
    decoded = collections.Counter((r["doc_id"], r["decoded"]) for r in bpe.decode(encoded, path).collect())
    assert decoded == collections.Counter((r["doc_id"], library.decode(library.encode(r["text"] or "", add_special_tokens=False).ids, skip_special_tokens=False)) for r in docs.collect())
    assert bpe.round_trip(docs, path).count() == docs.count()
    assert bpe.round_trip(empty, path).count() == 0


def test_bpe_of_odd_letters_and_marks(library):
    """30,000 texts of Latin letters, marks, joining marks and special tokens."""
    rnd = random.Random(11)
    letters = [chr(c) for c in range(0x41, 0x250) if chr(c).isalpha()]
    marks = [*".,|#&%$*!;:?'\"<>()-_", "\u0307", "\u0301", "\u0338", "'s", "'LL"]
    extra = ["<|endoftext|>", "<|startoftext|>", "<|", "|>", "<|end", " ", "\n", "\x1c", "\x85", "\u2003", "1", "½", "İ", "İ!", "TARİHİ.", "ſ", "ΑΣ", "日本", "🎉", "\u200b", "ß", "ǅ"]
    texts = ["".join(rnd.choice(rnd.choice([letters, marks, marks, extra])) for _ in range(rnd.randint(1, 14))) for _ in range(30_000)]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    codec = bpe.SegmentTreeBpe(bpe.default_tokenizer())
    got = [x.tolist() for x in codec.encode(texts)]
    assert [(t, a, b) for t, a, b in zip(texts, got, want) if a != b] == []
    packed = [np.frombuffer(x, dtype="<u4").tolist() for x in packing.CachedTokenizer(bpe.default_tokenizer()).encode(texts)]
    assert [(t, a, b) for t, a, b in zip(texts, packed, want) if a != b] == []
    assert all(codec.decode(np.array(x, dtype=np.int64)) == library.decode(x, skip_special_tokens=False) for x in want)


def test_bpe_refuses_other_rules():
    import public_tokenizers

    other = public_tokenizers.path("byte_bpe_50k.json")
    for kind in (bpe.SegmentTreeBpe, packing.CachedTokenizer):
        with pytest.raises(ValueError, match="normalizer"):
            kind(other)


def test_segment_tree_merges_leftmost_lowest_first():
    codec = bpe.codec(bpe.default_tokenizer())
    rnd = random.Random(2)
    for _ in range(200):
        ids = [rnd.choice(codec.first[97:103]) for _ in range(rnd.randint(1, 30))]
        want = list(ids)
        while True:
            ranked = [(codec.pairs[a << codec.wide | b] >> codec.wide, i) for i, (a, b) in enumerate(zip(want, want[1:])) if a << codec.wide | b in codec.pairs]
            if not ranked:
                break
            _, i = min(ranked)
            want[i : i + 2] = [codec.pairs[want[i] << codec.wide | want[i + 1]] & ((1 << codec.wide) - 1)]
        assert codec.merge(ids) == want


def check_pieces(pieces, docs, library, window):
    import zlib

    ids = collections.defaultdict(list)
    for r in docs.collect():
        ids[r["doc_id"]].append(library.encode(r["text"] or "", add_special_tokens=False).ids + [2])
    found = collections.defaultdict(list)
    sequences = collections.defaultdict(list)
    for r in pieces:
        found[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(found) == set(ids)
    for d, rows in found.items():
        assert sum(r["length"] for r in rows) == sum(map(len, ids[d]))
        for r in rows:
            crcs = {zlib.crc32(np.array(x[r["start"] : r["start"] + r["length"]], dtype="<u4").tobytes()) for x in ids[d] if len(x) == r["doc_tokens"]}
            assert r["ids_crc32"] in crcs
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window


def test_packing(docs, empty, library):
    pieces = packing.pack(docs, bpe.default_tokenizer(), window=512).collect()
    check_pieces(pieces, docs, library, 512)
    assert packing.pack(empty, bpe.default_tokenizer()).count() == 0


def test_minimum_bin_slack_is_optimal():
    rnd = random.Random(5)
    for _ in range(60):
        counts = collections.Counter(rnd.randint(1, 20) for _ in range(rnd.randint(0, 8)))
        room = rnd.randint(0, 60)
        sums = {0}
        for x, n in counts.items():
            sums = {s + k * x for s in sums for k in range(n + 1) if s + k * x <= room}
        got = packing.fill(dict(counts), room)
        assert sum(x * k for x, k in got.items()) == max(sums) and all(k <= counts[x] for x, k in got.items())
    lengths = [rnd.randint(1, 4096) for _ in range(1500)]
    windows = packing.min_bin_slack(lengths)
    assert sorted(i for w in windows for i in w) == list(range(1500))
    assert sum(4096 - sum(lengths[i] for i in w) for w in windows) < 0.02 * sum(lengths)


def test_chat_round_trip_and_mask(spark):
    texts = ["hi <|end|> there", "<\\|turn|>", " \n lead", "🎉é <|text|>", "", None, "</s>[INST] ok [/INST]", "<" + "\\" * 3 + "|"]
    rnd = random.Random(3)
    rows = [(c, t, rnd.choice(["user", "assistant", "system", None]), rnd.choice(texts), "x") for c in range(30) for t in range(rnd.randint(1, 6))] + [(None, None, None, None, "x"), (3, 0, "assistant", "tie", "x"), (3, 0, "assistant", "tie", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    out = chat.format_conversations(df, chat.chat_vocabulary())
    got = {r["conv_id"]: r for r in out.collect()}
    for c in {r[0] for r in rows}:
        turns = sorted(((r[1] if r[1] is not None else -1, r[2] or "", r[3] or "") for r in rows if r[0] == c))
        r = got[c]
        assert chat.parse(r["formatted"]) == [(role, text) for _, role, text in turns]
        assert chat.masked_text(r["formatted"], r["starts"], r["ends"], r["loss"]) == "".join(text for _, role, text in turns if role == "assistant")
    assert chat.read_back(out).count() == len(got)
    assert chat.format_conversations(df.limit(0), chat.chat_vocabulary()).count() == 0


def test_chat_offsets_are_the_library_s(spark):
    """ids and offsets of the whole formatted text, as the other library finds them."""
    import json

    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = json.load(f) | {"post_processor": None}
    library = tokenizers.Tokenizer.from_str(json.dumps(spec))
    library.pre_tokenizer = tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False)
    library.add_special_tokens([tokenizers.AddedToken(x, normalized=False, special=True) for x in (chat.TURN, chat.TEXT, chat.END)])
    encoder = chat.chat_encoder(chat.chat_vocabulary())
    for text in odd_texts(4, 400):
        whole, spans = chat.render([("user", text or ""), ("assistant", f"{text} 🎉é日")], "assistant")
        want = library.encode(whole, add_special_tokens=False)
        ids, starts, ends = encoder.encode(whole)
        assert ids.tolist() == want.ids and [*zip(starts.tolist(), ends.tolist())] == want.offsets
        learnt = chat.masked_text(whole, starts, ends, chat.overlap_mask(starts, ends, spans))
        assert learnt == f"{text} 🎉é日"


def test_chat_in_one_pass(spark):
    rows = [(c, t, ["user", "assistant"][t % 2], f"{'word é ' * c}<|end|>{t}", 1) for c in range(40) for t in range(5)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, said int")
    both = chat.read_back(chat.format_conversations(df, chat.chat_vocabulary())).collect()
    assert sorted(map(tuple, both)) == sorted(map(tuple, chat.format_and_read_back(df, chat.chat_vocabulary()).collect()))


def base_spans(text):
    def luhn(d):
        return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0

    plain = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))
    out = []
    for rank, (kind, pattern) in enumerate(plain):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": kind != "ip" or max(map(int, m.group().split("."))) <= 255, "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def test_pii_base_spans(docs, empty):
    got = collections.Counter((r["doc_id"], tuple((s["start"], s["rank"], s["end"], s["kind"]) for s in r["base"])) for r in pii.extract(docs).collect())
    want = collections.Counter((r["doc_id"], tuple(base_spans(r["text"]))) for r in docs.collect())
    assert got == want
    assert pii.extract(empty).count() == 0


def test_pii_patterns_find_the_unseen(spark):
    rows = [(k, f"please call me at +1 (555) 555-{1000 + k} today") for k in range(12)]
    rows += [(100, "please call me at 555-9876, ok"), (101, "call me maybe 1234567"), (102, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: [(s["start"], s["end"], s["kind"]) for s in r["found"]] for r in pii.extract(df).collect()}
    assert got[100] == [(18, 26, "phone")] and got[101] == [] and got[102] == []
    texts = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert texts[100] == "please call me at [PHONE], ok" and texts[0] == "please call me at [PHONE] today" and texts[102] == ""


def test_pii_identifiers_of_several_words(spark):
    rows = [(k, f"please call me at +1 (555) 555-{1000 + k} today") for k in range(40)]
    unseen = ["(487) 555-7209", "487 555 7209", "(487) 555 - 7209", "DE89 3704 0044 0532 0130 00", "12 34"]
    rows += [(100 + k, f"2 men: please call me at {x}, 5 or more") for k, x in enumerate(unseen)]
    rows += [(200, "call me at 555-9876 bob@x.org 77"), (201, "3 call me 4 at 5"), (202, "please call me at 7 7, 8 8"), (203, "call me at (12)")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    texts = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert [texts[100 + k] for k in range(len(unseen))] == ["2 men: please call me at [PHONE], 5 or more"] * len(unseen)
    assert texts[200] == "call me at [PHONE] [EMAIL] 77" and texts[201] == "3 call me 4 at 5"
    assert texts[202] == "please call me at [PHONE], 8 8" and texts[203] == "call me at ([PHONE])"
    found = {r["doc_id"]: r for r in pii.occurrences(df).collect()}
    assert [(s["value"], s["pattern"]) for s in found[202]["other"]] == [("7 7", "me at"), ("8 8", "0 0")]


def test_pii_context_of_long_words_and_settling(spark):
    long = "x" * 80
    rows = [(k, f"see {long} at +1 (555) 555-{1000 + k}") for k in range(12)]
    rows += [(100, f"see {long} at 555-9876"), (101, "call" + " " * 200 + "me at" + " " * 90 + "1.2.3.4")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}[100] == f"see {long} at [PHONE]"
    assert [s["pattern"] for r in pii.occurrences(df).where("doc_id = 101").collect() for s in r["ip"]] == ["me at"]
    # Each pattern of a chain is only accepted once the one before it is: five rounds.
    name = "abcdef"
    chain = [(f"w {name[0]}", f"+4940555{k:04d}", "phone") for k in range(40)]
    for i in range(5):
        chain += [(f"w {name[j]}", f"n{i}x{k}", "other") for k in range(12) for j in (i, i + 1)]
        chain += [(f"w {name[i]}", f"+4941{i}55{k:04d}", "phone") for k in range(60)] if i == 0 else []
    spans = "array<struct<start:int,end:int,value:string,pattern:string>>"
    found = [(k, *[[(0, 1, v, p)] if kind == n else [] for n in (*pii.KINDS, "other")]) for k, (p, v, kind) in enumerate(chain)]
    graph = spark.createDataFrame(found, "doc_id long, " + ", ".join(f"{n} {spans}" for n in (*pii.KINDS, "other")))

    def accepted(rounds):
        return {r["pattern"]: r["score"] for r in pii.accepted_patterns(graph, rounds, 4, 0.2).collect()}

    assert set(accepted(None)) > set(accepted(3)) and accepted(None) == pytest.approx(accepted(40), abs=1e-4)


def scores_by_hand(found, support, least):
    """Accepted patterns by plain rounds over the graph of all occurrences."""
    links, seeds = collections.defaultdict(set), collections.defaultdict(dict)
    for row in found:
        for kind in (*pii.KINDS, "other"):
            for s in row[kind]:
                told = "secret" if s["secret"] else kind
                for pattern in {s["pattern"], *s["forms"]} - {""}:
                    links[pattern].add(s["value"])
                    if told != "other":
                        seeds[s["value"]][told] = 1.0
    known = {v: dict(k) for v, k in seeds.items()}
    while True:
        accepted = {}
        for pattern, values in links.items():
            for kind in pii.ALL_KINDS:
                backing = [known[v][kind] for v in values if kind in known.get(v, {})]
                if len(backing) >= support and sum(backing) / (len(values) + 1) >= least:
                    accepted[pattern, kind] = sum(backing) / (len(values) + 1)
        now = {v: dict(k) for v, k in seeds.items()}
        for (pattern, kind), score in accepted.items():
            for v in links[pattern]:
                now.setdefault(v, {})[kind] = max(now.get(v, {}).get(kind, 0.0), score)
        if all(abs(now[v][k] - known.get(v, {}).get(k, -1)) < 1e-9 for v in now for k in now[v]):
            return accepted
        known = now


def test_pii_scores_and_spans_by_hand(spark):
    rnd = random.Random(12)
    words = "a bc def gh ij klm no pq rs tu".split()

    def say(x):
        return " ".join([*rnd.choices(words, k=4), x, *rnd.choices(words, k=4)])

    def key(n):
        return "".join(rnd.choice("0123456789abcdef") for _ in range(n - 2)) + "7f"

    texts = [say(f'token = "{key(40)}"') for _ in range(30)] + [say(f"call {n} now") for n in ("12", "7", "3x")]
    texts += [say(f"+1 ({rnd.randint(100, 999)}) 555-{rnd.randint(1000, 9999)}") for _ in range(30)]
    texts += [say(f"user: {name}@mail.org, ok") for name in words] + [say(f"user: {name}42, ok") for name in words[:3]]
    short = [say('token = "s3cret"'), say('Token = "pw 12345"'), say("+1 (555) 555-1234 10.20.30.40"), say("version 2.0."), say('size = "7"')]
    rows = [(k, t, 1, "k", "i") for k, t in enumerate([*texts, *short, None, ""])]
    df = spark.createDataFrame([*rows, rows[0], (None, short[0], 1, "k", "i")], "doc_id long, text string, _id0 long, _key0 string, key string")
    found = pii.occurrences(df).collect()
    want = scores_by_hand(found, pii.SUPPORT, pii.SCORE)
    got = {(r["pattern"], r["kind"]): r["score"] for r in pii.accepted_patterns(pii.occurrences(df)).collect()}
    best = {}
    for (pattern, kind), score in want.items():
        best.setdefault(pattern, []).append((score, kind))
    assert {p for p, _ in got} == set(best)
    assert all(score == pytest.approx(max(best[p])[0], abs=1e-5) for (p, _), score in got.items())
    assert {"< token = \"", "= +0 (000) 000-0000"} <= {p for p, _ in got}
    spans = {}
    for row in found:
        hits = {(s["start"], s["end"]) for s in row["other"] if {s["pattern"], *s["forms"]} & set(best)}
        spans.setdefault((row["doc_id"], row["key"]), hits)
    extracted = pii.extract(df).collect()
    assert len(extracted) == df.count()
    assert all({(s["start"], s["end"]) for s in r["found"]} == spans[r["doc_id"], r["key"]] for r in extracted)
    out = pii.redact(df)
    assert out.columns == df.columns
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    at = len(rows) - 2 - len(short)
    assert 'token = "[SECRET]"' in texts[at] and 'token = "[SECRET]"' in texts[None] and "[PHONE] [IP]" in texts[at + 2]
    assert texts[at + 3] == short[3] and texts[at + 4] == short[4]


def test_pii_shapes(spark):
    df = spark.createDataFrame([("+1 (555)\t555-1234",), ("s3cret",), ("Ab12-3",), ("x",), ("2026-01-01T00:00:00Z",), ("é1é",)], "v string")
    assert [r[0] for r in df.select(pii.shape(df["v"])).collect()] == ["+0 (000) 000-0000", "x", "x-0", "a", "0000-00-x:00:x", "x"]


def statistics_of(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    seen = collections.Counter(zip(words, words[1:], words[2:]))
    covered = {j for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_statistics(spark, docs, empty):
    more = [(900 + k, t, 0, "", "", "", 0, "") for k, t in enumerate(["a b a b a b a b", "q q q q", "a b c d a b c e a b", "x\x0by\x0cz\r x y z"])]
    df = docs.unionByName(spark.createDataFrame(more, CLASH))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = collections.Counter((r["doc_id"], tuple(r[c] for c in names)) for r in quality.text_stats(df).collect())
    assert got == collections.Counter((r["doc_id"], statistics_of(r["text"])) for r in df.collect())
    assert quality.judge(empty, spark.createDataFrame([], "doc_id long, quality int")).count() == 0


def test_quality_clash_of_hashes(spark, monkeypatch):
    """With position bits that leave too little room, windows themselves are sorted."""
    monkeypatch.setattr(quality, "_POSITION_MASK", 7)
    text = "a b c d e a b c x y a b c"
    (r,) = quality.text_stats(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert r["n_repeat_words"] == statistics_of(text)[4]


def test_quality_list_is_learned(spark):
    rnd = random.Random(7)
    rows, labels = [], []
    for k in range(240):
        bad = k % 4 == 0
        words = ["w" + str(rnd.randint(0, 10**6)) + ("***" if bad else "") for _ in range(80)]
        rows.append((k, " ".join(words)))
        if k < 160:
            labels.append((k, 0 if bad else 1))
    df, told = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (1, None)], "doc_id long, quality int")
    got = {r["doc_id"]: r["kept"] for r in quality.judge(df, told).collect()}
    assert all(got[k] == (k % 4 != 0) for k in range(240))
    none = quality.judge(df, told.limit(0))
    assert none.where("kept").count() == 240


def test_quality_list_finds_small_and_many_kinds(spark):
    """Six kinds of bad documents, each under a fiftieth of the labelled ones, beside good ones
    of similar measures."""
    rnd = random.Random(9)

    def words(n, size=6):
        return ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(size - 2, size + 2))) for _ in range(n)]

    def bad(kind):
        w = words(80)
        if kind == 0:
            return " ".join(x + "***" for x in w)
        if kind == 1:
            return " ".join(x.upper() for x in w)
        if kind == 2:
            return " ".join(str(rnd.randint(10**5, 10**6)) for _ in w)
        if kind == 3:
            return " ".join(x + "!!!" for x in w)
        if kind == 4:
            return " ".join(words(80, 40))
        return "\n".join([" ".join(w[:20])] * 3 + w)

    rows = [(k, " ".join(words(rnd.randint(70, 200)))) for k in range(1800)]
    rows += [(2000 + k, bad(k % 6)) for k in range(216)]
    labels = [(d, 0 if d >= 2000 else 1) for d, _ in rows]
    df, told = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r["doc_id"]: r["kept"] for r in quality.judge(df, told).collect()}
    assert sum(got[d] for d in got if d < 2000) >= 1790 and sum(got[d] for d in got if d >= 2000) <= 6


def test_quality_rows_without_id_or_of_one_id(spark):
    good = " ".join(f"w{k}" for k in range(60))
    df = spark.createDataFrame([(5, ""), (5, good), (None, good), (None, None), (5, good)], "doc_id long, text string")
    got = collections.Counter((r["doc_id"], r["n_words"], r["kept"]) for r in quality.judge(df, spark.createDataFrame([], "doc_id long, quality int")).collect())
    assert got == collections.Counter({(5, 0, False): 1, (5, 60, True): 2, (None, 60, True): 1, (None, 0, False): 1})


def test_licenses(spark):
    mit = licenses.KNOWN["MIT"]
    rows = [(1, mit.upper().replace("COPYRIGHT (C) THE AUTHORS", "COPYRIGHT 2020 X")), (2, "text\nReleased under the MIT Licence.\nAll rights reserved.\n  released UNDER the mit license"), (3, None), (3, None), (None, "All rights reserved."), (4, "Released under the MIT License, or not")]
    got = collections.Counter((r["doc_id"], r["license"], r["licenses"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == collections.Counter({(1, "MIT", ""): 1, (2, None, "MIT notice,Reserved notice,MIT notice"): 1, (3, None, ""): 2, (None, "Reserved notice", "Reserved notice"): 1, (4, None, ""): 1})
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_licenses_full_texts_and_notices(spark):
    import pathlib

    folder = pathlib.Path(licenses.__file__).with_name("license_texts")
    texts = {p.stem: p.read_text(encoding="utf-8") for p in folder.glob("*.txt")}
    assert {"Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0", "Unlicense", "CC0-1.0"} <= set(texts)
    want = {name: name.split("@")[0] for name in texts}
    texts["no appendix"], want["no appendix"] = texts["Apache-2.0"].split("END OF TERMS")[0], "Apache-2.0"
    texts["holder"], want["holder"] = texts["BSD-3-Clause@2"].replace("the University", "Some Firm, Inc.").replace("REGENTS", "AUTHORS"), "BSD-3-Clause"
    told = {
        "This program is distributed under the terms of the GNU General Public License version 2.": "GPL-2.0",
        "Licensed under GPLv2 or later": "GPL-2.0-or-later",
        "# Licensed under the LGPL, version 2.1 or any later version": "LGPL-2.1-or-later",
        "This article is available under a Creative Commons Attribution-ShareAlike 4.0 International License.": "CC-BY-SA-4.0",
        "Released under CC BY-SA 3.0": "CC-BY-SA-3.0",
        "// SPDX-License-Identifier: BSD-3-Clause": "BSD-3-Clause",
        "This project is licensed under the Apache 2.0 licence": "Apache-2.0",
    }
    texts |= {x: f"some text\n{x}\nmore" for x in told}
    names = sorted(texts)
    df = spark.createDataFrame([(k, texts[n]) for k, n in enumerate(names)], "doc_id long, text string")
    got = {names[r["doc_id"]]: r for r in licenses.scan(df).collect()}
    assert {n: got[n]["license"] for n in want} == want
    assert {n: got[n]["licenses"] for n in told} == {n: f"{x} notice" for n, x in told.items()}


def test_licenses_wrapped_anyhow(spark):
    import pathlib
    import textwrap

    rows = []
    for path in sorted(pathlib.Path(licenses.__file__).with_name("license_texts").glob("*.txt")):
        parts = re.split(r"\n[ \t]*\n", path.read_text(encoding="utf-8"))
        for width in (40, 61, 72, 78, 100, 10**6):
            wrapped = [p if re.search(r"(?i)copyright \(c\)|©|copyright \[yyyy", p) else textwrap.fill(" ".join(p.split()), width, break_long_words=False) for p in parts]
            rows.append((path.stem.split("@")[0], "\n\n".join(wrapped)))
    isc = "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n\n" + licenses.KNOWN["ISC"].split("\n\n")[1]
    mit = licenses.KNOWN["MIT"].removeprefix("MIT License\n\n")
    rows += [("ISC", isc), ("ISC", "ISC License\n\nCopyright (c) 2020, A. Holder\nAll rights reserved.\n\n" + isc), ("MIT", mit), ("MIT", "The MIT License (MIT)\n\n" + mit.replace("(c) the authors", "Some Firm")), (None, "mere copyright"), (None, mit + " But not for you.")]
    df = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: r["license"] for r in licenses.scan(df).collect()}
    assert [(k, n, got[k]) for k, (n, _) in enumerate(rows) if got[k] != n] == []


def test_licenses_inside_a_file(spark):
    import pathlib
    import textwrap

    folder = pathlib.Path(licenses.__file__).with_name("license_texts")
    mit, bsd, gpl = ((folder / f"{n}.txt").read_text(encoding="utf-8") for n in ("MIT", "BSD-3-Clause@2", "GPL-3.0"))
    head = "\n".join("# " + x for p in mit.split("\n\n") for x in [*textwrap.wrap(p, 60), ""])
    line = " ".join(licenses.KNOWN["MIT"].split("\n\n", 2)[2].split())
    rows = [
        ("MIT", f"#!/bin/sh\n{head}\n\nexit 0"),
        ("Reserved notice,MIT,BSD-3-Clause,MIT", f"Third parties\n\n{mit}\n\nand\n\n{bsd}\n\nand\n\n{mit}"),
        ("GPL-3.0", f"see below\n{gpl}\nend"),
        ("Reserved notice,MIT notice,BSD-3-Clause", f"one\n{bsd}\nReleased under the MIT License."),
        ("MIT,MIT", f"a\n{line}\nb\n{mit}\nc"),
        ("", mit),
        ("", "see " + mit.replace("free of charge", "for a charge")),
    ]
    df = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: (r["licenses"], r["license"]) for r in licenses.scan(df).collect()}
    assert got == {k: (n, "MIT" if k == 5 else None) for k, (n, _) in enumerate(rows)}


def test_chat_and_license_sql(spark):
    import os

    import duckdb
    from helpers_llm import same

    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no driver tables")
    for module, name in ((chat, "op7_chat"), (licenses, "op6_licenses")):
        same(module.QUERIES[name](spark, data).toPandas(), duckdb, module.ORACLES[name], data)
