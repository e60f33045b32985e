"""Secrets: base patterns, plus tokens that look random to a pair of character Markov models.

Two first-order Markov models over character classes are trained from labelled
samples, one of random strings and one of ordinary identifiers and words. A
token's score is the log-likelihood ratio per character. A run of token
characters is read as values between equals signs; a value above the threshold
is taken whole, in others the segments are whose running sum above the
threshold is greatest, widened to the next / _ or -, so that a secret glued to
ordinary text is not averaged away. A run above the threshold without any of
these is taken whole. What overlaps no base span is added as kind ``markov``.
The models become one literal table, so scoring is built-in functions only.

Defined cases: null and empty texts have no spans; positions are code points,
end exclusive; columns of the input are kept, names that clash are replaced.
"""

from __future__ import annotations

import math
import random
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import let
from .spans import clear_of, matches, render

KINDS = ["assign", "access", "hex", "markov"]
ASSIGN = r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
# Runs are maximal, so asking for the length inside the pattern changes no match.
BASE = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]{14,}", "hex": r"(?:(?<![0-9a-f])|\G)[0-9a-f]{16,}"}
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}"
#: What stands between equals signs, with padding.
VALUE = r"[A-Za-z0-9+/_-]{16,}+=*"
LEAST_LENGTH = 16
#: A segment ends where its sum has fallen by this from its peak (nats): about four characters of ordinary text.
FALL = 8.0
#: Added spans need the mean log-likelihood ratio (nats a character) that gives this precision on the held-out third.
PRECISION = 0.99
#: So many ordinary strings of the length of a secret stand in text for each random one, as taken for the precision.
ORDINARY = 50
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Ordinary parts for the sample of identifiers: fixed words of code and prose.
WORDS = "the and for that with from this have not are was which when their there about other into than time could people some only new also after first year two way even want because any these give day most user name value count index file path read write open close list item node tree graph table column row data type class method function return string number object array buffer stream socket client server request response handler manager factory builder parser token session config option default update delete insert select create remove find search sort merge split join filter map reduce test check error message event queue stack heap cache memory thread lock state status result license version information international development government environment management technology organization particular understanding necessary responsible performance opportunity".split()
#: Fixed long words of other languages, for the same sample.
FOREIGN = "Geschwindigkeitsbegrenzung Rechtsschutzversicherung Donaudampfschifffahrt Bundesverfassungsgericht Kraftfahrzeughaftpflicht Zusammengehoerigkeit Arbeitsunfaehigkeit Weiterentwicklung anticonstitutionnellement developpement intergouvernemental professionnellement responsabilidad internacionalizacion desafortunadamente otorrinolaringologo electroencefalografista verantwoordelijkheid aansprakelijkheid vakantiebestemming samenwerkingsverband raggiungimento precipitevolissimevolmente kansainvalistyminen lentokonesuihkuturbiini uppmarksamhet nordvastersjokustartilleri niezaleznosc przedsiebiorstwo".split()


def labelled_samples(n: int = 4000, seed: int = 11) -> tuple[list[str], list[str]]:
    """(random strings, ordinary identifiers), n of each and three runs of every character; n bounds the sample."""
    rnd = random.Random(seed)
    kinds = ["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", ALPHABET[:62], ALPHABET[:64], ALPHABET[26:62]]
    noise = ["".join(rnd.choice(k) for _ in range(rnd.randint(16, 48))) for k in (rnd.choice(kinds) for _ in range(n))]
    plain = []
    for _ in range(n):
        w = [rnd.choice(WORDS) for _ in range(rnd.randint(2, 5))]
        style = rnd.randrange(10)
        if style == 1:
            w = [w[0], *(x.title() for x in w[1:])]
        elif style == 2:
            w = [x.upper() for x in w]
        elif style == 3:
            w[-1] = str(rnd.randint(0, 2030))
        elif style == 6:  # rules, padding, runs
            w = [rnd.choice(["", w[0]]), rnd.choice(ALPHABET + "-_=/+" * 12) * rnd.randint(16, 60), rnd.choice(["", w[1]])]
        elif style == 7:  # paths, with versions and numbers
            w = [rnd.choice(["", "usr", "home", "var"]), *w, rnd.choice(["lib64", "python3", "v2", str(rnd.randint(0, 999)), "main-page"]), w[0]]
        elif style == 8:  # long words of other languages
            w = [x if rnd.random() < 0.5 else x.lower() for x in (rnd.choice(FOREIGN) for _ in range(rnd.randint(1, 2)))]
        elif style == 9:  # dates, times and counters
            w = [f"{rnd.randint(1990, 2030)}{s}{rnd.randint(1, 12):02}{s}{rnd.randint(1, 28):02}" for s in [rnd.choice("-/_")]] + [f"{rnd.randint(0, 23):02}-{rnd.randint(0, 59):02}-{rnd.randint(0, 59):02}", w[0]]
        plain.append(["", "", "_", "-", "_", "/", "", "/", rnd.choice(["", "-"]), "-"][style].join(w))
    return noise, plain + [c * rnd.randint(LEAST_LENGTH, 60) for c in ALPHABET for _ in range(3)]


@lru_cache(maxsize=4)
def ratios(n: int = 4000, seed: int = 11) -> list[float]:
    """Log-likelihood ratio of every pair of alphabet characters (previous, next), row by row, with add-one smoothing."""
    m, at = len(ALPHABET), {c: i for i, c in enumerate(ALPHABET)}
    tables = []
    for sample in labelled_samples(n, seed):
        t = [[1.0] * m for _ in range(m)]
        for s in sample:
            for a, b in zip(s, s[1:], strict=False):
                t[at[a]][at[b]] += 1
        tables.append([[math.log(x / sum(row)) for x in row] for row in t])
    return [tables[0][i][j] - tables[1][i][j] for i in range(m) for j in range(m)]


@lru_cache(maxsize=1)
def least_ratio() -> tuple[float, float, float]:
    """Threshold of the mean ratio, with precision and recall on a held-out sample of random and ordinary strings."""
    at, table, m = {c: i for i, c in enumerate(ALPHABET)}, ratios(), len(ALPHABET)
    sides = [[x for x in side if len(x) >= LEAST_LENGTH] for side in labelled_samples(2000, seed=12)]
    mean = lambda s: sum(table[at[a] * m + at[b]] for a, b in zip(s, s[1:], strict=False)) / (len(s) - 1)
    z = np.array([mean(s) for side in sides for s in side])
    y = np.array([1] * len(sides[0]) + [0] * len(sides[1]))
    order = np.argsort(-z)
    weight = np.where(y == 1, 1, ORDINARY)
    enough = np.flatnonzero(np.cumsum(y[order]) >= PRECISION * np.cumsum(weight[order]))
    cut = float(z[order][enough[-1]])
    picked = z >= cut
    return cut, float(y[picked].sum() / weight[picked].sum()), float(picked[y == 1].mean())


def _pairs(token: Column, table: list[float]) -> Column:
    """Log-likelihood ratio of each pair of neighbours in an ASCII token over ALPHABET."""
    m, values = len(ALPHABET), F.from_json(F.lit("[" + ",".join(f"{x:.5f}" for x in table) + "]"), "array<double>")
    codes = F.transform(F.sequence(F.lit(1), F.length(token)), lambda i: F.instr(F.lit(ALPHABET), F.substring(token, i, F.lit(1))) - 1)
    return let(codes, lambda codes: F.transform(F.sequence(F.lit(0), F.size(codes) - 2), lambda i: F.get(values, F.get(codes, i) * m + F.get(codes, i + 1))))


def _mean(pairs: Column) -> Column:
    return F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x) / F.size(pairs)


def log_ratio(token: Column, table: list[float]) -> Column:
    """Mean log-likelihood ratio a character, random against ordinary, of an ASCII token over ALPHABET."""
    return let(_pairs(token, table), _mean)


def _segments(v: Column, pairs: Column, least: float) -> Column:
    """array<struct<a,z>> of the random-looking segments of a value, widened to / _ or -, without overlap."""
    none = F.array().cast("array<struct<a:int,z:int>>")
    zero = F.struct(F.lit(0).alias("k"), F.lit(0).alias("a"), F.lit(0).alias("z"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("peak"), none.alias("out"))

    def told(acc: Column) -> Column:
        return F.when(acc["peak"] > 0, F.array_append(acc["out"], F.struct(acc["a"].alias("a"), acc["z"].alias("z")))).otherwise(acc["out"])

    def step(acc: Column, x: Column) -> Column:
        over = (acc["sum"] <= 0) | (acc["peak"] - acc["sum"] > FALL)
        total = F.when(over, 0.0).otherwise(acc["sum"]) + x - least
        peak = F.when(over, 0.0).otherwise(acc["peak"])
        return F.struct(
            (acc["k"] + 1).alias("k"),
            F.when(over, acc["k"]).otherwise(acc["a"]).alias("a"),
            F.when(total > peak, acc["k"] + 2).otherwise(acc["z"]).alias("z"),
            total.alias("sum"),
            F.greatest(total, peak).alias("peak"),
            F.when(over, told(acc)).otherwise(acc["out"]).alias("out"),
        )

    def widened(x: Column) -> Column:
        """To the next / _ or - outside; but a segment that begins or ends within a character of one begins or ends there."""
        head = F.length(F.regexp_extract(F.substring(v, x["a"] + 1, F.lit(2)), r"\A[^/_-]?[/_-]", 0))
        tail = F.length(F.regexp_extract(F.substring(v, x["z"] - 1, F.lit(2)), r"[/_-][^/_-]?\z", 0))
        a = F.when(head > 0, x["a"] + head).otherwise(x["a"] - F.length(F.regexp_extract(F.substring(v, F.lit(1), x["a"]), r"[^/_-]*\z", 0)))
        z = F.when(tail > 0, x["z"] - tail).otherwise(x["z"] + F.length(F.regexp_extract(F.substring(v, x["z"] + 1, F.length(v)), r"\A[^/_-]*", 0)))
        return F.struct(a.alias("a"), z.alias("z"), (x["z"] - x["a"]).alias("n"))

    def random_like(x: Column) -> Column:
        return (x["z"] - x["a"] >= LEAST_LENGTH) & ((x["n"] >= LEAST_LENGTH) | (_mean(F.slice(pairs, x["a"] + 1, x["z"] - x["a"] - 1)) >= least))

    def join(acc: Column, x: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        fresh = F.struct(x["a"].alias("a"), x["z"].alias("z"))
        glued = F.struct(F.least(last["a"], x["a"]).alias("a"), F.greatest(last["z"], x["z"]).alias("z"))
        return F.when((F.size(acc) > 0) & (last["z"] > x["a"]), F.array_append(F.slice(acc, F.lit(1), F.size(acc) - 1), glued)).otherwise(F.array_append(acc, fresh))

    return F.aggregate(F.filter(F.transform(F.aggregate(pairs, zero, step, told), widened), random_like), none, join)


def random_spans(text: Column, base: Column, table: list[float], least: float) -> Column:
    """array<struct<s,e,v>> of what looks random and overlaps no base span."""

    def within(x: Column) -> Column:
        whole = F.array(F.struct(F.lit(0).alias("a"), F.length(x["v"]).alias("z")))
        places = let(_pairs(x["v"], table), lambda pairs: F.when(_mean(pairs) >= least, whole).otherwise(_segments(x["v"], pairs, least)))
        return F.transform(places, lambda p: F.struct((x["s"] + p["a"]).alias("s"), (x["s"] + p["z"]).alias("e"), F.substring(x["v"], p["a"] + 1, p["z"] - p["a"]).alias("v")))

    def runs(parts: Column) -> Column:
        free = let(F.filter(matches(text, TOKEN), lambda x: log_ratio(x["v"], table) >= least), lambda m: clear_of(m, F.concat(parts, plain)))
        return F.concat(parts, free)

    plain = F.transform(base, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["v"].alias("v")))
    return let(let(F.flatten(F.transform(matches(text, VALUE), within)), lambda m: clear_of(m, base)), runs)


def _tag(spans: Column, i: int) -> Column:
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(i).alias("k"), x["e"].alias("e"), F.lit(KINDS[i]).alias("kind"), x["v"].alias("v")))


def find_secrets(docs: DataFrame, text_col: str = "text", least: float | None = None) -> DataFrame:
    """docs with ``base`` and ``added``: arrays of struct<s,k,e,kind,v> by start, then kind."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = {k: matches(text, BASE[k]) for k in KINDS[:3]}
    found["assign"] = F.filter(found["assign"], lambda x: F.length(F.regexp_extract(x["v"], ASSIGN, 2)) >= 12)
    base = F.concat(*[_tag(found[k], i) for i, k in enumerate(KINDS[:3])])
    table, least = ratios(), least_ratio()[0] if least is None else least
    out = docs.withColumn("base", F.sort_array(base))
    return out.withColumn("added", F.sort_array(_tag(random_spans(text, F.col("base"), table, least), 3)))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: counts of base spans by kind, their digest, and all spans as text."""
    found = find_secrets(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    count = lambda i: F.size(F.filter("base", lambda x: x["k"] == i)).cast("long")
    every = F.sort_array(F.concat("base", "added"))
    return found.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])], F.sha2(render(F.col("base")), 256).alias("base_sha256"), render(every).alias("spans"), F.size("added").cast("long").alias("n_added"))
