"""Quality rules: a decision list learned by sequential covering.

Statistics of every whole text are Spark expressions.  On labelled documents rules are
grown one after another, until none is precise: each is a conjunction of thresholds on the statistics, grown
condition by condition by information gain over quantile grids, pruned back on a held
part of the labels, and kept only if precise there.  What a rule covers is left out when
the next is grown, and the grids, finer in their tails, are taken anew over the rows left
in the rule that grows.  The list is emitted as one ordered conditional expression.  Growing
and pruning see the data through grouped counts of (statistic, grid cell), which Spark
sums over all labelled rows; nothing is sampled, and the driver gets the counts only.

Defined results: null text has no words; a text without words fails the base rules.
Labels that are null are not used, and of several labels of an id the lowest counts.
Without labels, or with labels of one kind only, the list is empty and the base rules
decide.  Repeated rows are judged alike, rows that share an id or have none each by its own text
(`rid` and `key` tell them apart); other columns don't matter, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from playlog.llm._spark import cut, keyed_texts_of, table

#: Conditions in a rule; the quantiles that a grid has, and their relative precision.
CONDITIONS = 3
_TAIL = (0.0005, 0.001, 0.002, 0.005, 0.01, 0.015, 0.02, 0.03)
QUANTILES = (*_TAIL, *(k / 24 for k in range(1, 24)), *(1 - x for x in reversed(_TAIL)))
GRID_ACCURACY = 20_000
#: Least share of bad documents among those a rule covers in the held part of the
#: labels, and the least number of those it covers there.
PRECISION, SUPPORT = 0.95, 5

_GAPS = "\t\n\x0b\x0c\r"
_POSITION_BITS = 24
_POSITION_MASK = (1 << _POSITION_BITS) - 1
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks")


def _packed(words: Column) -> Column:
    """Every 3-word window as one long, 40 bits of hash above 24 bits of position (from
    1), sorted: equal windows are neighbours."""
    return F.sort_array(
        F.transform(
            F.sequence(F.lit(1), F.size(words) - 2),
            lambda i: F.shiftleft(F.xxhash64(F.get(words, i - 1), F.get(words, i), F.get(words, i + 1)), _POSITION_BITS).bitwiseOR(i.cast("long")),
        )
    )


def _same(a: Column, b: Column) -> Column:
    return F.shiftright(a, _POSITION_BITS) == F.shiftright(b, _POSITION_BITS)


def _covered(positions: Column) -> Column:
    """How many words lie in 3-word windows that start at these positions."""
    return F.size(F.array_distinct(F.flatten(F.transform(positions, lambda p: F.array(p, p + 1, p + 2)))))


def text_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id`, `rid`, `key` and the statistics of each whole text (all long)."""
    text = F.col("text")
    words = F.filter(F.split(F.translate(text, _GAPS, " " * len(_GAPS)), " "), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t-\r]"))

    def without(chars: str) -> Column:
        return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")

    first = keyed_texts_of(docs, id_col, text_col).select(
        "doc_id",
        "rid",
        "key",
        words.alias("words"),
        lines.alias("lines"),
        F.length(F.translate(text, " " + _GAPS, "")).cast("long").alias("word_chars"),
        without("#*$%&|<>").alias("n_symbols"),
        F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long").alias("n_upper"),
        F.length(F.regexp_replace(text, "[^0-9]+", "")).cast("long").alias("n_digits"),
        without(".,;:!?").alias("n_marks"),
    )
    n = F.size("words")
    second = first.select(
        "*",
        n.cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when((n >= 3) & (n <= _POSITION_MASK), _packed(F.col("words"))).otherwise(F.array().cast("array<bigint>")).alias("packed"),
    ).drop("lines")
    p = F.col("packed")
    third = second.withColumn(
        "packed",
        F.filter(p, lambda x, i: F.coalesce((i > 0) & _same(x, F.get(p, i - 1)), F.lit(False)) | F.coalesce(_same(x, F.get(p, i + 1)), F.lit(False))),
    )
    words, m = F.col("words"), F.size("packed")

    def position(i: Column) -> Column:
        return F.get(p, i).bitwiseAND(F.lit(_POSITION_MASK)).cast("int")

    def differ(i: Column) -> Column:
        a, b = position(i - 1), position(i)
        return _same(F.get(p, i - 1), F.get(p, i)) & (
            (F.get(words, a - 1) != F.get(words, b - 1)) | (F.get(words, a) != F.get(words, b)) | (F.get(words, a + 1) != F.get(words, b + 1))
        )

    clash = F.when(m >= 2, F.exists(F.sequence(F.lit(1), m - 1), differ)).otherwise(False)
    quick = _covered(F.transform(p, lambda x: x.bitwiseAND(F.lit(_POSITION_MASK))))
    windows = F.array_sort(
        F.transform(
            F.sequence(F.lit(1), F.size(words) - 2),
            lambda i: F.struct(F.concat_ws(" ", F.get(words, i - 1), F.get(words, i), F.get(words, i + 1)).alias("w"), i.cast("long").alias("i")),
        )
    )


    def twice(s: Column) -> Column:
        def told(x: Column, i: Column) -> Column:
            return F.coalesce((i > 0) & (x["w"] == F.get(s, i - 1)["w"]), F.lit(False)) | F.coalesce(x["w"] == F.get(s, i + 1)["w"], F.lit(False))

        return _covered(F.transform(F.filter(s, told), lambda x: x["i"]))

    # A clash of hashes, or a text too long for the position bits: the windows themselves are sorted.
    slow = F.transform(F.array(windows), twice)
    return third.select(
        "doc_id",
        "rid",
        "key",
        *[c for c in STATS if c != "n_repeat_words"],
        F.when((F.size(words) > _POSITION_MASK) | clash, F.get(slow, F.lit(0))).otherwise(quick).cast("long").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def measures() -> dict[str, Column]:
    """The quantities that rules put thresholds on."""

    def per(part: str, whole: str) -> Column:
        return F.col(part) / F.greatest(F.col(whole), F.lit(1))

    return {
        "words": F.col("n_words").cast("double"),
        "word_length": per("word_chars", "n_words"),
        "symbols_per_word": per("n_symbols", "n_words"),
        "marks_per_word": per("n_marks", "n_words"),
        "upper_share": per("n_upper", "word_chars"),
        "digit_share": per("n_digits", "word_chars"),
        "dup_line_share": per("n_dup_lines", "n_lines"),
        "repeat_share": per("n_repeat_words", "n_words"),
        "words_per_line": per("n_words", "n_lines"),
    }


@dataclass(frozen=True)
class Condition:
    measure: str
    above: bool
    threshold: float

    def expression(self) -> Column:
        x = measures()[self.measure]
        return x > self.threshold if self.above else x <= self.threshold


@dataclass
class DecisionList:
    """Rules in order; the first that holds rejects."""

    rules: list[list[Condition]] = field(default_factory=list)

    def expression(self) -> Column:
        """Number of the first rule that holds, from 1; null if none does."""
        out = F.lit(None).cast("int")
        for k in range(len(self.rules), 0, -1):
            out = F.when(_all(self.rules[k - 1]), F.lit(k)).otherwise(out)
        return out

    def __str__(self) -> str:
        return "\n".join(" and ".join(f"{c.measure} {'>' if c.above else '<='} {c.threshold:.6g}" for c in rule) for rule in self.rules)


def _all(rule: list[Condition]) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.expression()
    return out


def _gain(p: float, n: float, p0: float, n0: float) -> float:
    """Information gain of keeping p of p0 bad and n of n0 good documents."""
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else -1.0


def _grids(rows: DataFrame) -> dict[str, list[float]]:
    """Thresholds of each measure over these rows."""
    found = rows.agg(*[F.percentile_approx(x, list(QUANTILES), GRID_ACCURACY).alias(name) for name, x in measures().items()]).collect()[0]
    return {name: sorted(set(found[name])) for name in measures() if found[name]}


def _grown(rows: DataFrame, rule: list[Condition]) -> Condition | None:
    """The condition to add, from counts of each grid cell among the rows of the rule."""
    inside = rows.where(_all(rule))
    grids = _grids(inside)
    names, named = list(grids), measures()
    if not names:
        return None

    def cell(name: str) -> Column:
        """How many thresholds are below the value."""
        return F.size(F.filter(F.array(*map(F.lit, grids[name])), lambda t: t < named[name]))

    cells = inside.select("bad", F.posexplode(F.array(*map(cell, names))).alias("k", "cell"))
    counts = cells.groupBy("k", "cell").agg(F.sum("bad").alias("bad"), F.count("*").alias("n")).collect()
    by: dict[int, dict[int, tuple[int, int]]] = {}
    for r in counts:
        by.setdefault(r["k"], {})[r["cell"]] = (r["bad"], r["n"] - r["bad"])
    best: tuple[float, Condition] | None = None
    for k, got in sorted(by.items()):
        p0, n0 = (sum(x[j] for x in got.values()) for j in (0, 1))
        if not p0 or not n0:
            return None
        p = n = 0
        for place, threshold in enumerate(grids[names[k]]):
            a, b = got.get(place, (0, 0))
            p, n = p + a, n + b
            for above, x, y in ((False, p, n), (True, p0 - p, n0 - n)):
                gain = _gain(x, y, p0, n0)
                if gain > 0 and (best is None or gain > best[0] + 1e-9):
                    best = (gain, Condition(names[k], above, threshold))
    return _centred(inside, best[1]) if best else None


def _centred(rows: DataFrame, c: Condition) -> Condition:
    """The same parting of the rows with the threshold halfway between its two sides, so
    that a document a little off the good ones seen isn't rejected."""
    x = measures()[c.measure]
    low, high = rows.agg(F.max(F.when(x <= c.threshold, x)), F.min(F.when(x > c.threshold, x))).collect()[0]
    return c if low is None or high is None else Condition(c.measure, c.above, (low + high) / 2)


def learn(stats: DataFrame, labels: DataFrame, label_col: str = "quality") -> DecisionList:
    """A list that rejects documents like those labelled 0, from all labelled rows of
    `stats` that the base rules keep."""
    marked = labels.where(F.col(label_col).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min(label_col) == 0).cast("int").alias("bad"))
    known = stats.where(~base_failed()).join(marked, "doc_id")
    rows = cut(known.select(*STATS, "bad", (F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(3)) == 0).alias("held")))
    out = DecisionList()
    # Each rule takes SUPPORT or more bad rows of the held part away, so this ends.
    while True:
        left = rows.where(out.expression().isNull())
        rule: list[Condition] = []
        while len(rule) < CONDITIONS and (more := _grown(left.where(~F.col("held")), rule)):
            rule.append(more)
        if not rule:
            break
        starts = [rule[: k + 1] for k in range(len(rule))]
        one = F.lit(1)
        seen = left.where("held").agg(*[x for k, r in enumerate(starts) for x in (F.sum(F.when(_all(r), F.col("bad"))).alias(f"p{k}"), F.sum(F.when(_all(r), one)).alias(f"n{k}"))]).collect()[0]
        worth = [((seen[f"p{k}"] or 0) / (seen[f"n{k}"] or 1), seen[f"p{k}"] or 0, -k) for k in range(len(starts))]
        precise = [x for x in worth if x[0] >= PRECISION and x[1] >= SUPPORT]
        if not precise:
            break
        out.rules.append(starts[-max(precise, key=lambda x: (x[1], x[2]))[2]])
    return out


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics, `base_failed`, `rule` (the rule that rejects, null if none) and `kept`
    of every document."""
    stats = cut(text_stats(docs))
    rules = learn(stats, labels)
    return stats.select("doc_id", "rid", "key", *STATS, base_failed().alias("base_failed"), rules.expression().alias("rule")).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


QUERIES = {"op2_quality": op2_quality}
ORACLES: dict[str, str] = {}
