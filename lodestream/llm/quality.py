"""Quality rules as a short-circuit cascade, in built-in functions only.

A rule rejects a document by a condition on one feature of its whole text. On
a sample, the cost (seconds a row) and the selectivity (share rejected) of
each rule are estimated, and rules run in descending rejection per cost; later
rules are not evaluated for a rejected document. The verdict is the same in
any order: a document is kept if no rule rejects it.

Defined cases: null, empty and word-free texts have zero words and fail the
length rule; columns of the input are kept, names that clash are replaced.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, let

#: Rows of the sample that costs and selectivities are estimated on; they set the order only.
SAMPLE_ROWS = 400
#: Passes over the sample in one measurement.
REPEATS = 4
WINDOW = 8
GAP = r"[ \t-\r]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP, -1), "")


def lines(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: x.rlike(r"[^ \t-\r]"))


def n_of(text: Column, chars: str) -> Column:
    """Occurrences of the characters of a regex class."""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), f"[^{chars}]+", "")).cast("long")


def _repeated_places(keys: Column, at) -> Column:
    """Places of the keys that occur more than once, in order; at(i) is the place of key i."""
    tagged = F.sort_array(F.transform(keys, lambda x, i: F.struct(x.alias("x"), at(i).alias("i"))))

    def pick(a: Column) -> Column:
        same = lambda i, j: F.coalesce(F.get(a, i)["x"] == F.get(a, j)["x"], F.lit(False))
        return F.sort_array(F.transform(F.filter(F.transform(a, lambda x, i: F.struct(x["i"].alias("i"), (same(i, i - 1) | same(i, i + 1)).alias("r"))), lambda x: x["r"]), lambda x: x["i"]))

    return let(tagged, pick)


def n_repeat_words(text: Column, k: int = WINDOW) -> Column:
    """Words in k-word windows that occur twice or more in the text, the first occurrence included.

    Window hashes are a filter: only texts in which one repeats go on, and
    there only windows whose hash repeats are compared, as strings.
    """

    def hashes(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)]))

    def covered(p: Column) -> Column:
        reach = F.transform(p, lambda x, i: F.least(F.lit(k), F.coalesce(F.get(p, i + 1) - x, F.lit(k))))
        return F.aggregate(reach, F.lit(0).cast("long"), lambda a, x: a + x)

    def exact(w: Column, win: Column) -> Column:
        def among(p: Column) -> Column:
            keys = F.transform(p, lambda i: F.array_join(F.slice(w, i + 1, k), " "))
            return let(_repeated_places(keys, lambda i: F.get(p, i)), covered)

        return let(_repeated_places(win, lambda i: i), among)

    def check(w: Column) -> Column:
        def on(win: Column) -> Column:
            return F.when(F.size(F.array_distinct(win)) == F.size(win), F.lit(0).cast("long")).otherwise(exact(w, win))

        return F.when(F.size(w) <= k, F.lit(0).cast("long")).otherwise(let(let(F.transform(w, lambda x: F.xxhash64(x)), hashes), on))

    return let(words(text), check)


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def word_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), GAP, "")).cast("long")


def n_dup_lines(text: Column) -> Column:
    return let(lines(text), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


#: What each rule may look at, by name.
FEATURES = {
    "n_words": n_words,
    "word_chars": word_chars,
    "n_symbols": lambda t: n_of(t, "#*$%&|<>"),
    "n_dup_lines": n_dup_lines,
    "n_lines": lambda t: F.size(lines(t)).cast("long"),
    "n_repeat_words": n_repeat_words,
    "n_shouts": lambda t: n_of(t, "!"),
    "n_distinct_words": lambda t: F.size(F.array_distinct(words(t))).cast("long"),
    "n_letters": lambda t: F.length(F.regexp_replace(F.coalesce(t, F.lit("")), r"\P{L}+", "")).cast("long"),
}


@dataclass(frozen=True)
class Rule:
    name: str
    uses: tuple[str, ...]
    rejects: object  # features by name -> boolean column


RULES = (
    Rule("short", ("n_words",), lambda f: f["n_words"] < 20),
    Rule("symbols", ("n_words", "n_symbols"), lambda f: 10 * f["n_symbols"] > 2 * f["n_words"]),
    Rule("shouting", ("n_words", "n_shouts"), lambda f: 10 * f["n_shouts"] > 3 * f["n_words"]),
    Rule("word_length", ("n_words", "word_chars"), lambda f: (f["word_chars"] > 15 * f["n_words"]) | (f["word_chars"] < 2 * f["n_words"])),
    Rule("letters", ("word_chars", "n_letters"), lambda f: 10 * f["n_letters"] < 3 * f["word_chars"]),
    Rule("same_words", ("n_words", "n_distinct_words"), lambda f: (f["n_words"] >= 50) & (20 * f["n_distinct_words"] < f["n_words"])),
    Rule("dup_lines", ("n_lines", "n_dup_lines"), lambda f: (f["n_lines"] >= 4) & (2 * f["n_dup_lines"] > f["n_lines"])),
    Rule("repeats", ("n_words", "n_repeat_words"), lambda f: 100 * f["n_repeat_words"] > 30 * f["n_words"]),
)


def order(docs: DataFrame, text_col: str = "text", rules=RULES, rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules by rejected share per second a row, estimated on a random sample of about ``rows`` rows (all, of a smaller table).

    A rule's cost is what a pass over the sample takes with it less what a pass takes without any rule.
    """
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    total = texts.count()
    if not total:
        return list(rules)
    held = cut(texts if total <= rows else texts.sample(rows / total, seed=1)).coalesce(1)
    if held.isEmpty():
        return list(rules)
    many = held.select("text", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))).alias("again"))

    def seconds(rejects: Column) -> tuple[float, float]:
        began = time.perf_counter()
        hit = many.agg(F.avg(F.coalesce(rejects, F.lit(False)).cast("double"))).first()[0]
        return time.perf_counter() - began, hit

    seconds(F.length("text") < 0)  # warms up
    idle = min(seconds(F.length("text") < 0)[0] for _ in range(2))
    figures = {}
    for rule in rules:
        took, hit = min(seconds(rule.rejects(_all(F.col("text"), rule.uses))) for _ in range(2))
        figures[rule.name] = (hit + 1e-3) / max(took - idle, 1e-3)
    return sorted(rules, key=lambda r: -figures[r.name])


def _all(text: Column, names) -> dict[str, Column]:
    return {n: FEATURES[n](text) for n in names}


def cascade(features: dict[str, Column], rules) -> Column:
    """Name of the first rule in this order that rejects, else null; what follows is not evaluated."""
    out = F.lit(None).cast("string")
    for rule in reversed(list(rules)):
        out = F.when(rule.rejects(features), F.lit(rule.name)).otherwise(out)
    return out


def judge(docs: DataFrame, text_col: str = "text", rules=None, to: str = "rejected_by") -> DataFrame:
    """docs with a column ``to``: the first rejecting rule of the cascade, or null for what is kept."""
    rules = order(docs, text_col) if rules is None else rules
    return docs.withColumn(to, cascade(_all(F.col(text_col), FEATURES), rules))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: base figures, base verdict, and the cascade's verdict (which no order of the rules changes)."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rules = order(docs)
    out = docs.withColumns(_all(F.col("text"), base))
    known = _all(F.col("text"), FEATURES) | {n: F.col(n) for n in base}
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return out.select("doc_id", *base, failed.alias("base_failed"), (~failed & cascade(known, rules).isNull()).alias("kept"))
