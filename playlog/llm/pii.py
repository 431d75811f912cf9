"""Personal data by bootstrapped contextual extraction, in DataFrame expressions only.

Base identifiers (mail addresses, IP addresses, card and phone numbers) are found by
patterns and are the seeds, and so are long keys of letters and digits that an equals sign
or a colon gives to a name (kind `secret`).  Seeds induce lexical patterns of four forms:

- the two words before, marks and case dropped and digits as 0 (`call me`);
- the last three words or marks before, if one is a mark (`token = "`);
- the word or mark on both sides around the value's shape (`:|0000-0000|,`), in which
  digits are 0, letters a, and mixed stretches x;
- the shape alone, if it has ten digits or more (`+0 (000) 000-0000`).

Patterns and instances (values, be
they seeds or other words that hold a digit or an at-sign) form a graph, which Spark
scores in rounds until the scores settle: a pattern's score is the mean score of its distinct instances, shrunk
by one, and an instance's score is 1 for a seed and otherwise the best score of the
accepted patterns it stands in.  Accepted patterns have enough distinct supporting
instances and a high enough score; the other words that stand in them are the
identifiers that the base patterns didn't see, each of the kind of its best pattern.
Neighbours among such words on one line are
one instance, with the marks and brackets between, and its context stands before the first
and after the last;
a comma or another end of a clause parts them.  Words without a digit or an at-sign are
never looked at.  Base spans always stay; found spans
that would overlap one are left out.  A key that is a seed is only reported where an accepted
pattern holds.

Defined results: null text is the empty text, which has no spans.  Repeated rows have
equal results; rows with one id and different texts are kept apart.  An empty table
gives no rows.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from playlog.llm._spark import cut, table, texts_of

#: Distinct supporting instances and score of an accepted pattern.
SUPPORT, SCORE = 4, 0.6
#: Scoring ends when no pattern is new and the mean score grows by less.
SETTLED = 1e-6

KINDS = ("email", "ip", "card", "phone")
#: With the kind that has no base pattern.
ALL_KINDS = (*KINDS, "secret")
_LOCAL = "[A-Za-z0-9._%+-]"
_LABEL = "[A-Za-z0-9-]"
#: Each finds what the plain pattern finds, but tries every run of characters once:
#: possessive, and starting at a run's start or where the last match ended.
_FIND = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    # only the runs of 12 to 19 digits
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    # words with a digit or an at-sign
    "other": r"(?<![^ \t-\r])[^ \t-\r0-9@]*+[0-9@][^ \t-\r]*+",
}
#: What may stand between the words of one identifier.
_APART = "[ \\t]+(?:[()/.\u2013-]{1,2}[ \\t]+)?"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
_BLOCK = 32


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]+", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _lengths(gaps: Column, hits: Column) -> Column:
    return F.transform(gaps, lambda g, i: F.length(g) + F.when(i > 0, F.length(F.get(hits, i - 1))).otherwise(0))


def _tagged(kind: str, fields: list[str]) -> Column:
    """kind, value and patterns; spans made by hand may have `pattern` alone."""

    def tag(s: Column) -> Column:
        patterns = F.array(s["pattern"])
        told = F.when(s["secret"], "secret").otherwise(kind) if "secret" in fields else F.lit(kind)
        return F.struct(told.alias("kind"), (F.concat(patterns, s["forms"]) if "forms" in fields else patterns).alias("patterns"), s["value"].alias("value"))

    return F.transform(kind, tag)


def _ranked(kind: str) -> Column:
    return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def _running(lengths: Column, starts: Column, i: Column) -> Column:
    """Sum of the first i of `lengths`, `starts` being the sums up to each block."""
    block = F.floor(i / _BLOCK).cast("int")
    rest = F.slice(lengths, block * _BLOCK + 1, i - block * _BLOCK)
    return F.get(starts, block) + F.aggregate(rest, F.lit(0), lambda a, x: a + x)


def _block_starts(lengths: Column) -> Column:
    blocks = F.sequence(F.lit(0), F.floor(F.size(lengths) / _BLOCK).cast("int"))
    sums = F.transform(blocks, lambda b: F.aggregate(F.slice(lengths, b * _BLOCK + 1, F.lit(_BLOCK)), F.lit(0), lambda a, x: a + x))
    return F.aggregate(sums, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.get(a, F.size(a) - 1) + x)))


def _joined(gap: Column, before: Column) -> Column:
    """Whether a gap between two words makes them one identifier: on one line, with at most
    a mark in it, and after a word that doesn't end a clause."""
    return gap.rlike(rf"^{_APART}$") & ~before.rlike("[.,;:!?]$")


def _pattern(tail: Column) -> Column:
    """The last two words of a stretch of text; empty if there's none."""
    words = F.filter(F.split(F.regexp_replace(F.regexp_replace(F.lower(tail), r"[^\p{L}0-9]+", " "), "[0-9]", "0"), " "), lambda w: w != "")
    return F.array_join(F.slice(words, F.when(F.size(words) > 2, F.size(words) - 1).otherwise(1), F.lit(2)), " ")


#: Cheap to look for from the left.
_TWO_WORDS = r"[\p{L}0-9][^\p{L}0-9]++[\p{L}0-9]"


#: The last two words of a text, read from its end.
_LAST = r"^[^\p{L}0-9]*+[\p{L}0-9]++(?:[^\p{L}0-9]++[\p{L}0-9]++)?"


def _tail(text: Column) -> Column:
    return F.reverse(F.regexp_extract(F.reverse(text), _LAST, 0))


#: Words and marks, and the first of them.
_TOKEN = r"[\p{L}0-9_]+|[^\s\p{L}0-9_]"
_FIRST = rf"^\s*+({_TOKEN})"
#: A key, and the name it is given to.
_KEY = r"^(?=(?:[^0-9]*+[0-9]){4})(?=(?:[^A-Za-z]*+[A-Za-z]){4})[A-Za-z0-9+/_-]{20,}={0,2}$"
_GIVEN = r"[\p{L}0-9_][\"']?\s*(?:=|:|=>|:=)\s*[\"'`]?$"

_SPAN = "struct<start:int,end:int,value:string,pattern:string,forms:array<string>,secret:boolean>"


def _plain(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[0-9]", "0")


def shape(value: Column) -> Column:
    """Digits as 0, letters as a, stretches of both as x; marks stay, white space is one space."""
    coarse = F.regexp_replace(F.regexp_replace(value, r"\p{L}+", "a"), "[0-9]", "0")
    return F.regexp_replace(F.regexp_replace(coarse, "(?:a0+)+a?|(?:0+a)+(?:0+)?", "x"), r"\s+", " ")


def _forms(before: Column, value: Column, after: Column) -> Column:
    """The patterns with marks and shapes that a value stands in."""
    told = F.regexp_extract_all(_plain(before), F.lit(_TOKEN), 0)
    last = F.slice(told, F.greatest(F.size(told) - 2, F.lit(1)), F.lit(3))
    left, right = F.coalesce(F.get(told, F.size(told) - 1), F.lit("")), _plain(F.regexp_extract(after, _FIRST, 1))
    form = shape(value)
    marked = (F.size(last) == 3) & F.exists(last, lambda w: ~w.rlike(r"[\p{L}0-9_]"))
    many = F.length(F.regexp_replace(form, "[^0]+", "")) >= 10
    none = F.lit(None).cast("string")
    around = (left != "") & (right != "")
    return F.array_compact(
        F.array(
            F.when(marked, F.concat(F.lit("< "), F.array_join(last, " "))).otherwise(none),
            F.when(around, F.concat_ws("|", left, form, right)).otherwise(none),
            F.when(many, F.concat(F.lit("= "), form)).otherwise(none),
        )
    )


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the valid spans of each kind (`email` ... `phone`) and `other`, the
    longest runs of neighbouring words that hold a digit or an at-sign and meet no base span."""
    df = texts_of(docs, id_col, text_col).withColumn("key", F.xxhash64("text"))
    names = [*KINDS, "other"]
    none = F.array().cast("array<string>")
    gate = {"email": F.col("text").contains("@"), "phone": F.col("text").contains("+")}
    has_digit = F.col("text").rlike("[0-9@]")
    df = df.select(
        "doc_id",
        "key",
        *[
            x
            for k in names
            for x in (
                F.when(gate.get(k, has_digit), F.split("text", _FIND[k], -1)).otherwise(none).alias(f"{k}_gaps"),
                F.when(gate.get(k, has_digit), F.regexp_extract_all("text", F.lit(_FIND[k]), 0)).otherwise(none).alias(f"{k}_hits"),
            )
        ],
    )
    # Code points up to the end of each gap: gap 0, then hit and gap in turn.
    df = df.select("*", *[_lengths(F.col(f"{k}_gaps"), F.col(f"{k}_hits")).alias(f"{k}_lengths") for k in names])
    df = df.select("*", *[_block_starts(F.col(f"{k}_lengths")).alias(f"{k}_starts") for k in names])

    def spans(kind: str) -> Column:
        lengths, starts, gaps = F.col(f"{kind}_lengths"), F.col(f"{kind}_starts"), F.col(f"{kind}_gaps")

        hits = F.col(f"{kind}_hits")

        def span(hit: Column, i: Column) -> Column:
            end = _running(lengths, starts, i + 1)
            gap = F.get(gaps, i)
            # A gap of less than two words is short of context; the hits before it are context too.
            more = F.concat(*[F.coalesce(F.get(x, i - k), F.lit("")) for k in (2, 1) for x in (gaps, hits)], gap)
            tail = _tail(F.when(gap.rlike(_TWO_WORDS), gap).otherwise(more))
            after = F.concat(*[F.coalesce(F.get(x, i + 1), F.lit("")) for x in (gaps, hits)])
            return F.struct(end.alias("start"), (end + F.length(hit)).alias("end"), hit.alias("value"), tail.alias("pattern"), F.regexp_extract(after, _FIRST, 0).alias("after"))

        return F.transform(hits, span) if kind == "other" else F.filter(F.transform(hits, span), lambda s: _valid(kind, s["value"]))

    df = df.select("doc_id", "key", "other_gaps", *[spans(k).alias(k) for k in names])
    base = F.concat(*[F.col(k) for k in KINDS])

    # Words that meet no base span, in runs: where each begins and ends among the words.
    def free(s: Column) -> Column:
        return ~F.exists("base", lambda b: (b["start"] < s["end"]) & (b["end"] > s["start"]))

    gaps, other, loose = F.col("other_gaps"), F.col("other"), F.col("free")
    df = df.withColumn("base", base)
    df = df.select("*", F.transform("other", free).alias("free"))
    joined = F.transform(other, lambda s, i: (i > 0) & F.get(loose, i) & F.coalesce(F.get(loose, i - 1), F.lit(False)) & F.coalesce(_joined(F.get(gaps, i), F.get(other, i - 1)["value"]), F.lit(False)))
    df = df.select("*", joined.alias("joined"))
    places = F.transform(other, lambda s, i: i)
    firsts = F.filter(places, lambda i: F.get(loose, i) & ~F.get("joined", i))
    lasts = F.filter(places, lambda i: F.get(loose, i) & ~F.coalesce(F.get("joined", i + 1), F.lit(False)))
    df = df.select("*", F.zip_with(firsts, lasts, lambda a, b: F.struct(a.alias("a"), b.alias("b"))).alias("runs"))

    def whole(r: Column) -> Column:
        """The words of a run and what is between them."""
        first, more = F.get(other, r["a"]), r["b"] - r["a"]
        rest = F.zip_with(F.slice(gaps, r["a"] + 2, more), F.slice(other, r["a"] + 2, more), lambda g, s: F.concat(g, s["value"]))
        value = F.concat(first["value"], F.array_join(rest, ""))
        last = F.get(other, r["b"])
        return F.struct(first["start"].alias("start"), last["end"].alias("end"), value.alias("value"), first["pattern"].alias("pattern"), last["after"].alias("after"))

    df = df.select("*", F.transform("runs", whole).alias("whole"))

    def trimmed(s: Column) -> Column:
        # A bracket that is closed inside belongs to the identifier.
        marks = r"^[^\p{L}\p{N}]*(?=\([\p{L}\p{N}][^()]*\).*[\p{L}\p{N}])|^[^\p{L}\p{N}]*(?=\+[0-9(])|^[^\p{L}\p{N}]*(?=[\p{L}\p{N}])"
        after_marks = F.regexp_replace(s["value"], marks, "")
        value = F.regexp_replace(after_marks, r"[^\p{L}\p{N}]+$", "")
        lead = F.length(s["value"]) - F.length(after_marks)
        start = s["start"] + lead
        before = F.concat(s["pattern"], F.substring(s["value"], F.lit(1), lead))
        after = F.concat(F.substring(after_marks, F.length(value) + 1, F.length(after_marks)), s["after"])
        return F.struct(start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"), s["pattern"].alias("pattern"), before.alias("before"), after.alias("after"))

    def named(s: Column) -> Column:
        """A base span with its patterns."""
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), _pattern(s["pattern"]).alias("pattern"), _forms(s["pattern"], s["value"], s["after"]).alias("forms"), F.lit(False).alias("secret"))

    def named_other(s: Column) -> Column:
        secret = s["value"].rlike(_KEY) & s["before"].rlike(_GIVEN)
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), _pattern(s["pattern"]).alias("pattern"), _forms(s["before"], s["value"], s["after"]).alias("forms"), secret.alias("secret"))

    df = df.withColumn("other", F.filter(F.transform("whole", trimmed), lambda s: F.length(s["value"]) > 0))
    return df.select("doc_id", "key", *[F.transform(k, named_other if k == "other" else named).cast(f"array<{_SPAN}>").alias(k) for k in names])


def accepted_patterns(found: DataFrame, rounds: int | None = None, support: int = SUPPORT, least: float = SCORE) -> DataFrame:
    """`pattern`, its best `kind` and `score`, after iterative scoring of the graph, to the
    end or for a number of rounds."""
    tagged = F.concat(*[_tagged(k, found.schema[k].dataType.elementType.fieldNames()) for k in (*KINDS, "other")])
    spread = found.select(F.explode(tagged).alias("x")).select("x.kind", "x.value", F.explode("x.patterns").alias("pattern"))
    edges = spread.select("kind", "pattern", "value").where(F.col("pattern") != "").distinct()
    edges = cut(edges)
    # a pattern of fewer instances than must support it is never accepted
    every = edges.select("pattern", "value").distinct()
    sizes = every.groupBy("pattern").agg(F.count("*").alias("size")).where(F.col("size") >= support)
    links = cut(every.join(sizes, "pattern"))
    seeds = cut(edges.where(F.col("kind") != "other").select("kind", "value").distinct().withColumn("score", F.lit(1.0)))
    known, scored, last, done = seeds, None, (0, 0.0), 0
    # Scores only grow from round to round, so this ends.
    while True:
        held = links.join(known, "value")
        own = F.lit(False)
        if scored is not None:
            # Instances whose best pattern this is have its score, whatever that will be: they
            # are left out of the mean, which so settles at once instead of over many rounds.
            held = held.join(scored.select("kind", "pattern", F.col("score").alias("before")), ["kind", "pattern"], "left")
            own = F.coalesce(F.col("score") <= F.col("before"), F.lit(False))
        summed = held.groupBy("kind", "pattern").agg(F.first("size").alias("size"), F.sum(F.when(own, 0.0).otherwise(F.col("score"))).alias("mass"), F.count_if(own).alias("own"), F.count("*").alias("backed"))
        score = F.col("mass") / (F.col("size") + 1 - F.col("own"))
        scored = cut(summed.where(F.col("backed") >= support).withColumn("score", score).where(F.col("score") >= least).select("kind", "pattern", "score"))
        done += 1
        now = scored.agg(F.count("*"), F.coalesce(F.sum("score"), F.lit(0.0))).collect()[0]
        if done == rounds or now[0] == last[0] and now[1] - last[1] <= SETTLED * now[0]:
            break
        last = (now[0], now[1])
        reached = links.join(scored, "pattern").select("kind", "value", "score")
        known = reached.unionByName(seeds).groupBy("kind", "value").agg(F.max("score").alias("score"))
    rank = F.struct(F.col("score"), *[F.col("kind") == k for k in ALL_KINDS])
    return scored.groupBy("pattern").agg(F.max_by("kind", rank).alias("kind"), F.max("score").alias("score"))


def extract(docs: DataFrame, rounds: int | None = None, support: int = SUPPORT, least: float = SCORE) -> DataFrame:
    """Per document `key`, a hash of its text, and `base` and `found`: arrays of (start, end,
    kind), by start and kind."""
    spotted = cut(occurrences(docs))
    patterns = accepted_patterns(spotted, rounds, support, least)
    other = spotted.select("doc_id", "key", F.explode("other").alias("s"))
    standing = other.select("doc_id", "key", "s.start", "s.end", F.explode(F.concat(F.array("s.pattern"), F.col("s.forms"))).alias("pattern"))
    best = F.max_by("kind", F.struct(F.col("score"), *[F.col("kind") == k for k in ALL_KINDS])).alias("kind")
    spans = standing.join(patterns, "pattern").groupBy("doc_id", "key", "start", "end").agg(best)
    new = spans.groupBy("doc_id", "key").agg(F.array_sort(F.collect_set(F.struct("start", "end", "kind"))).alias("new"))
    plain = spotted.select("doc_id", "key", F.array_sort(F.concat(*map(_ranked, KINDS))).alias("base"))
    joined = plain.join(new, plain["doc_id"].eqNullSafe(new["doc_id"]) & (plain["key"] == new["key"]), "left").select(plain["doc_id"], plain["key"], "base", "new")
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(ALL_KINDS) for x in (k, i)])
    found = F.transform(F.coalesce("new", F.array().cast("array<struct<start:int,end:int,kind:string>>")), lambda s: F.struct(s["start"].alias("start"), F.element_at(rank, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return joined.select("doc_id", "key", "base", found.alias("found"))


def redact(docs: DataFrame, **options: float) -> DataFrame:
    """All columns of `docs`, with `[KIND]` for each identifier in `text`."""
    spans = extract(docs, **options).dropDuplicates(["doc_id", "key"])
    taken = {c.lower() for c in docs.columns}
    ident, key, all_spans = (next(x for k in range(len(taken) + 1) if (x := f"_{name}{k}") not in taken) for name in ("id", "key", "spans"))
    keyed = spans.select(F.col("doc_id").alias(ident), F.col("key").alias(key), F.array_sort(F.concat("base", "found")).alias(all_spans))
    text = F.coalesce("text", F.lit(""))
    both = F.col("doc_id").cast("long").eqNullSafe(F.col(ident)) & (F.xxhash64(text) == F.col(key))
    return docs.join(keyed, both, "left").withColumn("text", masked(text, F.col(all_spans))).select(*[f"`{c}`" for c in docs.columns])


def masked(text: Column, spans: Column) -> Column:
    """`text` with the union of sorted `spans` replaced, each run of overlapping spans by
    the kind that starts it."""
    empty = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")

    def add(runs: Column, s: Column) -> Column:
        last = F.get(runs, F.size(runs) - 1)
        meets = (F.size(runs) > 0) & (s["start"] < last["end"])
        wider = F.struct(last["start"].alias("start"), last["rank"].alias("rank"), F.greatest(last["end"], s["end"]).alias("end"), last["kind"].alias("kind"))
        return F.when(meets, F.concat(F.slice(runs, F.lit(1), F.size(runs) - 1), F.array(wider))).otherwise(F.concat(runs, F.array(s)))

    runs = F.aggregate(F.coalesce(spans, empty), empty, add)
    whole = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def cover(state: Column, s: Column) -> Column:
        out = F.concat(state["out"], F.substring(text, state["at"] + 1, s["start"] - state["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(s["end"].alias("at"), out.alias("out"))

    return F.aggregate(runs, whole, cover, lambda state: F.concat(state["out"], F.substring(text, state["at"] + 1, F.length(text))))


def _told(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = extract(table(spark, sf_dir, "documents"))
    return spans.select("doc_id", *map(_count, KINDS), F.sha2(_told(F.col("base")), 256).alias("base_sha256"), _told(F.array_sort(F.concat("base", "found"))).alias("spans"), F.size("found").cast("long").alias("n_found"))


QUERIES = {"op1_pii": op1_pii}
ORACLES: dict[str, str] = {}
