"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

A piece of text starts as one symbol per byte (the last one with the end-of-word
mark).  The leaves of a segment tree hold the rank of each adjacent pair, with the
position in the low bits, so the root is the leftmost pair of the lowest rank.  A
merge changes at most three leaves, each in logarithmic time, and merging ends when
the root says that no pair can be merged.

The vocabulary file's own normaliser and pre-tokeniser (rules, not merges) are taken
from the `tokenizers` library so that Unicode classes agree with it; ids come from
the tree alone.

Defined results: null text is the empty text, which has no ids, ids digest of the
empty string and decodes to the empty text.  Repeated rows give repeated results.
Columns other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from playlog.llm._bytes import ranges, release
from playlog.llm._spark import table, texts_of

#: Runs and words remembered per worker; one that was dropped is encoded again.
RUNS, WORDS = 800_000, 1_200_000
_LONG = 64
#: Characters encoded at a time.
SLICE = 4_000_000
#: Marks that end a word of the rules when they follow a letter up to the run's end.
_MARKS = ".,|#&%$*!;:?"


class RunIds:
    """ids of texts from ids of their words: `encode_words` is called once for each
    word that isn't remembered.  White space is dropped by the rules and nothing
    matches across it, so runs without it are encoded one by one.  A run that ends in marks after a
    letter is the word and the marks, since the rules part letters from marks; not so after a
    letter whose lower case ends in a mark itself (`\u0130`)."""

    def __init__(self, encode_words: Callable[[list[str]], list[bytes]], most_runs: int = RUNS, most_words: int = WORDS):
        self.encode_words = encode_words
        self.most = most_runs, most_words
        self.runs: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts in one array, and where each text's begin (and the last end)."""
        split = pc.ascii_split_whitespace(pa.array([fold(x) for x in texts], pa.large_string()))
        coded = split.flatten().dictionary_encode()
        of = self._runs(coded.dictionary.to_pylist())
        size = np.fromiter(map(len, of), dtype=np.int64, count=len(of)) >> 2
        first = np.cumsum(size) - size
        flat = np.frombuffer(b"".join(of), dtype="<i4")
        code = coded.indices.to_numpy()
        each = size[code]
        ends = np.concatenate([[0], np.cumsum(each)])
        some = each > 0
        ids = flat[ranges(first[code[some]], each[some])]
        offsets = split.offsets.to_numpy()
        return ids, ends[offsets - offsets[0]]

    def _runs(self, runs: list[str]) -> list[bytes]:
        """ids of distinct runs without white space."""
        known, words = self.runs, self.words
        if len(known) > self.most[0]:
            known.clear()
        if len(words) > self.most[1]:
            words.clear()
        out = [known.get(x) for x in runs]
        parts, missing = [], set()
        for i, ids in enumerate(out):
            if ids is None:
                run = runs[i]
                word = run.rstrip(_MARKS)
                marks = ""
                if word and len(word) < len(run) and "a" <= word[-1] < "\u0250" and word[-1].isalpha() and len(word[-1].lower()) == 1:
                    marks = run[len(word) :]
                    if marks not in words:
                        missing.add(marks)
                else:
                    word = run
                parts.append((i, word, marks))
                if word not in words:
                    missing.add(word)
        order = list(missing)
        fresh = dict(zip(order, self.encode_words(order), strict=True))
        words.update({w: x for w, x in fresh.items() if len(w) <= _LONG})
        for i, word, marks in parts:
            ids = fresh[word] if word in fresh else words[word]
            if marks:
                ids += fresh[marks] if marks in fresh else words[marks]
            out[i] = ids
            if len(runs[i]) <= _LONG:
                known[runs[i]] = ids
        return out


def slices(texts: list[str], size: int = SLICE) -> Iterator[list[str]]:
    """The texts in parts of about `size` characters."""
    at = held = 0
    for i, x in enumerate(texts):
        held += len(x)
        if held >= size:
            yield texts[at : i + 1]
            at, held = i + 1, 0
    if at < len(texts):
        yield texts[at:]


def fold(text: str) -> str:
    """Latin-1 text in lower case, as the rules make it; other text, and text that may
    hold a special token, as it is."""
    if "<|" in text:
        return text
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


#: What a file has to say for the shortcuts here to be its rules: lower case, white space
#: dropped, letters parted from marks, an end-of-word mark and no decoder.
_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "decoder": None,
}
_MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "byte_fallback": False, "ignore_merges": False}


def checked(path: str) -> dict:
    """The vocabulary file, which must follow the rules that are built in here."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    wrong = [k for k, v in _RULES.items() if spec.get(k) != v]
    wrong += [f"model.{k}" for k, v in _MODEL.items() if spec["model"].get(k) != v]
    if not spec["model"].get("end_of_word_suffix"):
        wrong.append("model.end_of_word_suffix")
    wrong += [f"token {x['content']}" for x in spec["added_tokens"] if not x["content"].startswith("<|") or x["normalized"] or x["lstrip"] or x["rstrip"] or x["single_word"]]
    if wrong:
        raise ValueError(f"{path} isn't a lower-case BPE file with word ends: {', '.join(wrong)} differ")
    return spec


class SegmentTreeBpe:
    """Encoder and decoder for a `tokenizers` file of kind BPE with word ends; files of
    other rules are refused."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = checked(path)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_re = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.tokens = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        self.wide = len(self.tokens).bit_length()
        #: (left, right) in one int -> (rank, merged id) in one int.
        self.pairs: dict[int, int] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.pairs.setdefault(vocab[a] << self.wide | vocab[b], rank << self.wide | vocab[a + b])
        loaded = Tokenizer.from_file(path)
        self.normalise = loaded.normalizer.normalize_str if loaded.normalizer else str
        self.pre = loaded.pre_tokenizer.pre_tokenize_str
        self.byte_char = self._byte_chars()
        self.first = [vocab[c] for c in self.byte_char]
        self.last = [vocab[c + self.suffix] for c in self.byte_char]
        self.char_byte = {c: b for b, c in enumerate(self.byte_char)}
        self.vocab = vocab
        self.known = RunIds(lambda words: [self._chunk(w) for w in words])

    @staticmethod
    def _byte_chars() -> list[str]:
        """The printable stand-in of every byte: itself where Latin-1 prints it, the
        others in order from U+0100."""
        plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        rest = iter(range(0x100, 0x200))
        return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]

    def merge(self, ids: list[int]) -> list[int]:
        """The ids after all merges, leftmost lowest rank first."""
        n = len(ids) - 1
        if n < 1:
            return ids
        ids = list(ids)
        pairs, wide = self.pairs, self.wide
        mask = (1 << wide) - 1
        size = 1 << (n - 1).bit_length() if n > 1 else 1
        place = size.bit_length() + 1
        low = (1 << place) - 1
        none = 1 << 62
        tree = [none] * (2 * size)
        for i in range(n):
            found = pairs.get(ids[i] << wide | ids[i + 1])
            if found is not None:
                tree[size + i] = found >> wide << place | i
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        after = list(range(1, n + 2))
        before = list(range(-1, n))

        def put(i: int, value: int) -> None:
            i += size
            tree[i] = value
            i >>= 1
            while i:
                a, b = tree[2 * i], tree[2 * i + 1]
                value = a if a < b else b
                if tree[i] == value:
                    break
                tree[i] = value
                i >>= 1

        while tree[1] != none:
            i = tree[1] & low
            gone = after[i]
            ids[i] = pairs[ids[i] << wide | ids[gone]] & mask
            ids[gone] = -1
            right = after[gone]
            after[i] = right
            if gone < n:
                put(gone, none)
            if right <= n:
                before[right] = i
                found = pairs.get(ids[i] << wide | ids[right])
                put(i, none if found is None else found >> wide << place | i)
            else:
                put(i, none)
            left = before[i]
            if left >= 0:
                found = pairs.get(ids[left] << wide | ids[i])
                put(left, none if found is None else found >> wide << place | left)
        return [x for x in ids if x >= 0]

    def _bytes(self, symbols: bytes) -> list[int]:
        first = self.first
        return self.merge([*[first[b] for b in symbols[:-1]], self.last[symbols[-1]]])

    def _plain(self, text: str) -> list[int]:
        """Ids of text without special tokens."""
        if text.isalpha() and max(text) < "\xff":
            return self._bytes(text.lower().encode())
        out: list[int] = []
        for piece, _ in self.pre(self.normalise(text)):
            out += self._bytes(bytes([self.char_byte[c] for c in piece]))
        return out

    def _chunk(self, chunk: str) -> bytes:
        """Little-endian ids of a run without white space."""
        out: list[int] = []
        if self.special_re and "<" in chunk:
            for part in self.special_re.split(chunk):
                if part in self.special:
                    out.append(self.special[part])
                elif part:
                    out += self._plain(part)
        else:
            out = self._plain(chunk)
        return np.array(out, dtype="<i4").tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for part in slices(texts):
            ids, at = self.known.encode(part)
            out += [ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The tokens joined by spaces: the file names no decoder."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids.tolist()])


@functools.lru_cache(2)
def codec(path: str) -> SegmentTreeBpe:
    return SegmentTreeBpe(path)


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id` and `ids` (array<int>) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(tokenizer)
        for batch in batches:
            got = bpe.encode(batch.column("text").to_pylist())
            ends = np.cumsum([0, *map(len, got)], dtype=np.int64)
            flat = np.concatenate(got) if got else np.zeros(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], names=["doc_id", "ids"])

    return texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """`doc_id` and `decoded` from `doc_id` and `ids`; null ids are no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(tokenizer)
        for batch in batches:
            texts = [bpe.decode(np.array(x or [], dtype=np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded string")


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id`, `n_tokens` and the digests of ids and decoded text, encoding and then
    decoding each text in one pass so that ids of all documents needn't be moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(tokenizer)
        for batch in batches:
            n, ids_hex, text_hex = [], [], []
            for ids in bpe.encode(batch.column("text").to_pylist()):
                n.append(len(ids))
                ids_hex.append(hashlib.sha256(" ".join(map(str, ids.tolist())).encode()).hexdigest())
                text_hex.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )
        release(0)

    return texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), default_tokenizer())


QUERIES = {"op10_bpe": op10_bpe}
ORACLES: dict[str, str] = {}
