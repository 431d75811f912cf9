"""Chat formatting with a loss mask aligned by offsets.

A conversation becomes one string: for each turn `<|turn|>`, the role, `<|text|>`, the
text, `<|end|>`.  It is encoded once; the three control strings are ids of
their own, so no other token crosses them.  Byte-level tokens are stretches of the text's
bytes, so their offsets are running sums of their lengths, told in code points; tokens that
share a character all have the whole of it.  The spans of the trained role's texts are
sorted and disjoint, as are the tokens'; a binary search finds each token's span and
the mask is whether they meet.

Control strings inside roles and texts are escaped reversibly: in `<`, any number of
backslashes, `|` one backslash is added before the bar, so `<|` never stays.

Defined results: null role or text is the empty one; rows go by turn (null first), ties
by role and text; repeated rows are repeated turns; an empty table gives no
conversations.  A conversation is the unit of work and is held whole.  Columns other than
the four are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playlog.llm._spark import table

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
_ESCAPE = re.compile(r"<(\\*)\|")
_UNESCAPE = re.compile(r"<(\\*)\\\|")
_PARTS = re.compile(re.escape(TURN) + "(.*?)" + re.escape(TEXT) + "(.*?)" + re.escape(END), re.DOTALL)


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def render(turns: list[tuple[str, str]], trained: str) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans (code points) of the trained texts."""
    out, at, spans = [], 0, []
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
        if role == trained and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), spans


def overlap_mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens meet one of the sorted, disjoint spans."""
    if not spans:
        return np.zeros(len(starts), dtype=bool)
    lo, hi = np.array(spans, dtype=np.int64).T
    at = np.searchsorted(hi, starts, side="right")  # the first span that ends after the token's start
    return (at < len(lo)) & (lo[np.minimum(at, len(lo) - 1)] < ends) & (ends > starts)


#: Characters of conversations that are encoded before they're passed on.
SLICE = 2_000_000


class ChatEncoder:
    """Byte-level BPE by the `tiktoken` library from a file of ranks, with the control
    strings as the next ids but one (the file's own end mark is never used)."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f) if token}
        first = max(ranks.values()) + 2
        control = {x: first + k for k, x in enumerate((TURN, TEXT, END))}
        self.encoding = tiktoken.Encoding("chat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=control)
        self.control = frozenset(control)
        self.size = np.zeros(first + len(control), dtype=np.int64)
        for token, rank in ranks.items():
            self.size[rank] = len(token)
        for x, i in control.items():
            self.size[i] = len(x)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, and where each token starts and ends (code points)."""
        ids = self.encoding.encode_to_numpy(text, allowed_special=self.control, disallowed_special=())
        ends = np.cumsum(self.size[ids])
        starts = ends - self.size[ids]
        raw = text.encode()
        if len(raw) != len(text) and len(ids):
            begun = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)  # characters begun up to each byte
            starts, ends = begun[starts] - 1, begun[ends - 1]
        return ids, starts, ends


@functools.lru_cache(2)
def chat_encoder(path: str) -> ChatEncoder:
    return ChatEncoder(path)


FORMATTED = "conv_id long, formatted string, ids array<int>, starts array<int>, ends array<int>, loss array<boolean>"


def _conversations(rows: DataFrame) -> DataFrame:
    turns = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn").alias("turn"),
            F.coalesce(F.col("role"), F.lit("")).alias("role"),
            F.coalesce(F.col("text"), F.lit("")).alias("text"),
        ).alias("said"),
    )
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("said")).alias("said"))
    return whole.select("conv_id", F.col("said.role").alias("roles"), F.col("said.text").alias("texts"))


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)])
    flat = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, kind))


def _format(batches: Iterator[pa.RecordBatch], tokenizer: str, trained: str) -> Iterator[pa.RecordBatch]:
    """Rows of FORMATTED from rows of `_conversations`, a few at a time."""
    encoder = chat_encoder(tokenizer)
    for batch in batches:
        out: list[list] = [[] for _ in range(6)]
        held = 0
        for i in range(batch.num_rows):
            key, roles, said = (batch.column(c)[i].as_py() for c in ("conv_id", "roles", "texts"))
            text, spans = render([*zip(roles, said, strict=True)], trained)
            ids, starts, ends = encoder.encode(text)
            for column, x in zip(out, (key, text, ids, starts, ends, overlap_mask(starts, ends, spans)), strict=True):
                column.append(x)
            held += len(text)
            if held >= SLICE or i == batch.num_rows - 1:
                kinds = (*[pa.int32()] * 3, pa.bool_())
                arrays = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), *(_lists(x, k) for x, k in zip(out[2:], kinds, strict=True))]
                yield pa.RecordBatch.from_arrays(arrays, names=["conv_id", "formatted", "ids", "starts", "ends", "loss"])
                out, held = [[] for _ in range(6)], 0


def format_conversations(rows: DataFrame, tokenizer: str, trained: str = "assistant") -> DataFrame:
    """Per conversation the formatted text, its ids, their offsets and the loss mask."""
    return _conversations(rows).mapInArrow(lambda batches: _format(batches, tokenizer, trained), FORMATTED)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns that a formatted conversation was made from."""
    return [(unescape(r), unescape(t)) for r, t in _PARTS.findall(formatted)]


def masked_text(formatted: str, starts: np.ndarray, ends: np.ndarray, loss: np.ndarray) -> str:
    """All text under the mask, unescaped run by run; characters that several tokens share count once."""
    starts, ends = np.asarray(starts, dtype=np.int64), np.asarray(ends, dtype=np.int64)
    edge = np.diff(np.asarray(loss, dtype=np.int8), prepend=np.int8(0), append=np.int8(0))
    out, done = [], 0
    for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
        end = int(ends[b - 1])
        out.append(unescape(formatted[max(int(starts[a]), done) : end]))
        done = end
    return "".join(out)


_DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _DIGESTS from rows of FORMATTED."""
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    for batch in batches:
        flat = [batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("starts", "ends", "loss")]
        at = batch.column("starts").offsets.to_numpy()
        at = (at - at[0]).tolist() if len(at) else [0]
        columns: list[list] = [[] for _ in kinds]
        for i, (key, formatted) in enumerate(zip(batch.column("conv_id").to_pylist(), batch.column("formatted").to_pylist(), strict=True)):
            turns = parse(formatted)
            learnt = masked_text(formatted, *(x[at[i] : at[i + 1]] for x in flat))
            said = hashlib.sha256("".join(f"{role}\n{text}\n" for role, text in turns).encode()).hexdigest()
            row = (key, len(turns), said, len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), len(formatted))
            for column, x in zip(columns, row, strict=True):
                column.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of turns and of the text under the mask, read from the formatted output alone."""
    return formatted.mapInArrow(_read, _DIGESTS)


def format_and_read_back(rows: DataFrame, tokenizer: str, trained: str = "assistant") -> DataFrame:
    """Both in one pass, so that the formatted output needn't be moved."""
    return _conversations(rows).mapInArrow(lambda batches: _read(_format(batches, tokenizer, trained)), _DIGESTS)


def chat_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return format_and_read_back(rows.unionByName(extra), chat_vocabulary())


QUERIES = {"op7_chat": op7_chat}
ORACLES = {
    "op7_chat": r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
whole AS (
  SELECT conv_id, count(*) AS n_turns,
         sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS learnt,
         sum(length('<|turn|><|text|><|end|>')
             + length(regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g'))
             + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g'))) AS formatted_chars
  FROM said GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(learnt) AS loss_chars, sha256(learnt) AS loss_sha256,
       CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM whole"""
}
