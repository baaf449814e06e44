"""Quality rules: a short-circuit cascade ordered by rejection per cost.

Every rule is a boolean expression over the text and its words; the words are
split once for each text and shared by all rules. ``measure`` runs the rules
over a sample: what each one rejects, together with the others, and what it
costs beside the split; ``order_rules`` takes the rule with the highest
rejection per cost, then the best one for the texts that this one lets
through, and so on; ``verdict`` nests the ordered rules in one CASE
expression, which Spark evaluates lazily: a rule runs only for the documents
that all rules before it let through. The verdict is the same for any order.

DataFrame functions only; no Python runs on the executors.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.llm.common import WS_CHARS, Stage, let, words

#: Largest number of rows (in expectation) on which costs and selectivities are estimated.
SAMPLE_ROWS = 2000
#: Timed runs of each rule, and how many times each takes the sample, so that a run is long beside what starting it takes.
REPEATS = 2
COPIES = 8


def n_words(text: Column, w: Column) -> Column:
    return F.size(w).cast("long")


def word_chars(text: Column, w: Column) -> Column:
    return F.length(F.array_join(w, "")).cast("long")


def n_symbols(text: Column, w: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[#*$%&|<>]")), F.lit(0)).cast("long")


def n_upper(text: Column, w: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"\p{Lu}")), F.lit(0)).cast("long")


def _lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(WS_CHARS)) != "")


def _lines_repeat(lines: Column, repeated: Column) -> Column:
    return 100 * repeated > 50 * F.size(lines)


def lines_repeat(text: Column, w: Column) -> Column:
    """Over half of the lines with a word are equal to an earlier line."""
    return let(_lines(text), lambda x: _lines_repeat(x, F.size(x) - F.size(F.array_distinct(x))))


def n_dup_lines(text: Column, w: Column) -> Column:
    """Lines with a word that are equal to an earlier line."""
    return let(_lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def n_repeat_words(text: Column, w: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text.

    The windows' 64-bit hashes carry their position in the low bits, so one
    sort of longs brings equal windows together. Equality is then verified on
    the words themselves: when the hash classes and the string classes do not
    correspond one to one, the starts are compared as strings.
    """
    def window(w: Column, i: Column) -> Column:
        return F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))

    def with_words(w: Column) -> Column:
        bits = F.length(F.bin(F.size(w).cast("long")))
        return let(bits, lambda b: let(F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: (
            _shift_left(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), b) + i))),
            lambda s: with_sorted(w, b, s)))

    def with_sorted(w: Column, b: Column, s: Column) -> Column:
        def same(x: Column, k: Column) -> Column:
            h = _shift_right(x, b)
            return (F.coalesce(h == _shift_right(F.get(s, k + 1), b), F.lit(False))
                    | F.coalesce(h == _shift_right(F.get(s, k - 1), b), F.lit(False)))
        return let(F.filter(s, same), lambda c: with_candidates(w, b, c))

    def with_candidates(w: Column, b: Column, c: Column) -> Column:
        starts = F.transform(c, lambda x: (x - _shift_left(_shift_right(x, b), b)).cast("int"))
        return F.when(F.size(c) == 0, F.lit(0)).otherwise(let(starts, lambda p: let(
            F.transform(p, lambda i: window(w, i)), lambda texts: covered(F.when(
                F.size(F.array_distinct(texts)) == F.size(F.array_distinct(F.transform(c, lambda x: _shift_right(x, b)))), p)
                .otherwise(F.filter(p, lambda i: F.size(F.filter(texts, lambda t: t == window(w, i))) > 1))))))

    def covered(starts: Column) -> Column:
        return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2)))))

    return F.when(F.size(w) < 4, F.lit(0)).otherwise(with_words(w)).cast("long")


def _shift_left(x: Column, n: Column) -> Column:
    return F.call_function("shiftleft", x, n)


def _shift_right(x: Column, n: Column) -> Column:
    return F.call_function("shiftright", x, n)


#: Measurements by name, from the text and its words.
FEATURES: dict[str, Callable[[Column, Column], Column]] = {
    "n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines,
    "n_repeat_words": n_repeat_words, "lines_repeat": lines_repeat, "n_upper": n_upper,
}


@dataclass(frozen=True)
class Rule:
    """``fails`` gets a function from feature name to column."""

    name: str
    fails: Callable[[Callable[[str], Column]], Column]


#: Production rules. The first two are the base rules.
RULES = (
    Rule("few_words", lambda f: f("n_words") < 50),
    Rule("repeated_words", lambda f: 100 * f("n_repeat_words") > 50 * f("n_words")),
    Rule("symbols", lambda f: 10 * f("n_symbols") > f("n_words")),
    Rule("upper_case", lambda f: 100 * f("n_upper") > 40 * f("word_chars")),
    Rule("word_length", lambda f: (f("word_chars") < 2 * f("n_words")) | (f("word_chars") > 20 * f("n_words"))),
    Rule("repeated_lines", lambda f: f("lines_repeat")),
)
BASE_RULES = RULES[:2]


def inline(text: Column, w: Column | None = None) -> Callable[[str], Column]:
    """Features written out in place, so that a rule that isn't reached costs nothing."""
    w = words(text) if w is None else w
    return lambda name: FEATURES[name](text, w)


def shared(text: Column, body: Callable[[Callable[[str], Column]], Column]) -> Column:
    """``body`` of the features of ``text``, with its words split once."""
    return let(words(text), lambda w: body(inline(text, w)))


@dataclass(frozen=True)
class Measured:
    """Of a sample: seconds of each rule beside the split of the words, and how many texts each set of rules rejects."""

    rules: tuple[Rule, ...]
    seconds: tuple[float, ...]
    rejected_by: dict[tuple[bool, ...], int]

    def rejected(self, i: int, after: Sequence[int] = ()) -> float:
        """Share of the texts that the rules ``after`` let through, rejected by rule i."""
        left = {hits: n for hits, n in self.rejected_by.items() if not any(hits[k] for k in after)}
        return sum(n for hits, n in left.items() if hits[i]) / max(1, sum(left.values()))


def measure(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES, rows: int = SAMPLE_ROWS, repeats: int = REPEATS) -> Measured:
    """Runs the rules over a random sample of about ``rows`` documents (all, if
    there are fewer). A rule's seconds are the least of several runs over the
    sample taken ``COPIES`` times, after one that doesn't count, and at least a
    hundredth of the split's. The sample only decides the order of the rules."""
    stage = Stage(docs.sparkSession)
    total = docs.select(F.count(F.lit(1))).first()[0]
    one = docs.select(F.col(f"`{text}`").alias("text"))
    sample = stage.write((one if total <= rows else one.sample(rows / total, seed=7)).repartition(2))
    t = F.col("text")
    many = sample.select("text", F.explode(F.sequence(F.lit(1), F.lit(COPIES))).alias("copy"))

    def seconds(body: Callable[[Callable[[str], Column]], Column]) -> float:
        timed = []
        for _ in range(repeats + 1):
            began = time.perf_counter()
            many.agg(F.count_if(shared(t, body) & (F.col("copy") > 0))).first()
            timed.append(time.perf_counter() - began)
        return min(timed[1:])

    hits = [shared(t, lambda f, r=r: F.coalesce(r.fails(f), F.lit(False))).alias(f"r{i}") for i, r in enumerate(rules)]
    groups = sample.select(*hits).groupBy(*[f"r{i}" for i in range(len(rules))]).count().collect()  # at most 2 ** rules rows
    split = seconds(lambda f: f("n_words") < 0)
    cost = tuple(max(seconds(r.fails) - split, split / 100) for r in rules)
    stage.close()
    return Measured(tuple(rules), cost, {tuple(g)[:-1]: g[-1] for g in groups})


def order_rules(found: Measured) -> list[Rule]:
    """Best rejection per cost first, each next one judged on what the rules
    before it let through. Costs count by powers of four, as smaller differences
    are within what runs differ by. Equal rules go in the order given, as do
    those that reject nothing more: all of them run for the texts that are left."""
    cost = [4.0 ** round(math.log(s, 4)) for s in found.seconds]
    order: list[int] = []
    while len(order) < len(found.rules):
        rest = [i for i in range(len(found.rules)) if i not in order]
        order.append(max(rest, key=lambda i: (found.rejected(i, order) / cost[i], -i)))
    return [found.rules[i] for i in order]


def verdict(rules: Sequence[Rule], feature: Callable[[str], Column]) -> Column:
    """Name of the first rule that rejects, or null: one lazily evaluated CASE."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(rule.fails(feature), F.lit(rule.name)).otherwise(out)
    return out


def cascade(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` without the documents that a rule rejects, all columns kept.

    Null and blank texts have no words and fall to ``few_words``. An empty
    table gives an empty table; repeated rows are judged alike.
    """
    ordered = order_rules(measure(docs, text, rules, sample_rows))
    return docs.filter(shared(F.col(f"`{text}`"), lambda f: verdict(ordered, f)).isNull())


def quality_report(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                   rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row for each document with the base measurements and the verdict of
    the cascade. Measurements that the row shows anyway are reused by the
    rules; the others stay inside the lazily evaluated cascade."""
    shown = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    ordered = order_rules(measure(docs, text, rules, sample_rows))
    t, w = F.col("_text"), F.col("_words")
    # columns of their own, so that each is made once for a row
    base = (docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").alias("_text")).withColumn("_words", words(t))
            .select("doc_id", "_text", "_words", *[FEATURES[n](t, w).alias(n) for n in shown]))

    def feature(name: str) -> Column:
        if name == "lines_repeat":
            return (F.col("n_dup_lines") > 0) & _lines_repeat(_lines(t), F.col("n_dup_lines"))
        return F.col(name) if name in shown else FEATURES[name](t, w)

    base_failed = BASE_RULES[0].fails(feature) | BASE_RULES[1].fails(feature)
    rest = [r for r in ordered if r not in BASE_RULES]
    return (base.withColumn("base_failed", base_failed)
            .select("doc_id", *shown, "base_failed",
                    F.when(F.col("base_failed"), F.lit(False)).otherwise(verdict(rest, feature).isNull()).alias("kept")))
