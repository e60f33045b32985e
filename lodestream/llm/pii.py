"""Personal data: base patterns, plus candidates that boosted trees select.

Four base kinds (email, ip, card, phone) are found by pattern and check. High
recall generators, several for some kinds, then propose a span at every start
where one matches, of the same kinds and of ``id`` (identity and account
numbers); proposals overlap. Each candidate gets format features and features
of the text around it; gradient-boosted trees, fitted on the labelled sample
below (at most ``SAMPLE_MOST`` rows), score it; a threshold per kind, calibrated
on the held-out third for ``PRECISION``, selects. Of the selected candidates
that overlap no base span, those that overlap are taken by score, the best
first. Everything that touches documents is a built-in function.

Defined cases: null and empty texts have no spans; positions are code points,
end exclusive; columns of the input are kept, names that clash are replaced.
"""

from __future__ import annotations

import json
import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boost
from .shared import let
from .spans import EMPTY, apart, clear_of, every_match, matches, overlapping_runs, render

KINDS = ["email", "ip", "card", "phone", "id"]
SAMPLE_MOST = 2000
PRECISION = 0.97

# A match can't start inside a run it would have started before, so the
# lookbehinds and possessive quantifiers change no match; they keep the search
# linear on long runs.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}

#: Patterns of each kind; candidates are their matches at every start. The last ones of card are the runs and windows of 16 to 19 digits in longer ones.
GENERATORS = {
    "email": [r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?(?:\(at\)|\[at\]|\{at\}|\x20at\x20|@)\x20?[A-Za-z0-9-]{1,63}\x20?(?:\(dot\)|\[dot\]|\{dot\}|\x20dot\x20)\x20?[A-Za-z]{2,12}(?![A-Za-z])"],
    "ip": [r"(?<![0-9A-Za-z:])(?:[0-9a-fA-F]{1,4}:){3,7}[0-9a-fA-F]{1,4}(?![0-9A-Za-z:])"],
    "card": [r"(?<![0-9.])[0-9]{4}(?:[./_\x20-]{1,3}[0-9]{4}){3}(?![0-9])", *(rf"[0-9](?:[\x20-]?[0-9]){{{n - 1}}}" for n in range(16, 20))],
    "phone": [r"(?<![0-9+(-])\(?0?[0-9]{2,4}\)?[\x20./-]{1,2}[0-9]{3,4}[\x20./-]{1,2}[0-9]{3,4}(?![0-9-])"],
    "id": [r"(?<![A-Za-z0-9-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?)(?![A-Za-z0-9-])"],
}
CUES = {
    "email": r"e-?mail|contact|write|reach|mailto|address",
    "ip": r"\bip\b|host|server|address|login|client",
    "card": r"card|visa|credit|debit|payment|charge",
    "phone": r"phone|tel\b|tel\.|call|mobile|fax|dial|whatsapp|cell|contact",
    "id": r"ssn|social|iban|account|passport|bank|identity|insured",
}
AGAINST = r"order|invoice|version|isbn|issue|page|ticket|part|sku|model|serial|build|ratio|score|chapter|figure|mac|look|meet"


def _digits(v: Column) -> Column:
    return F.translate(v, "+ ()./_-", "")


def _luhn(digits: Column) -> Column:
    """True where a string of digits has a valid check digit."""

    def total(d: Column) -> Column:
        places = F.transform(F.sequence(F.lit(1), F.length(d)), lambda i: F.ascii(F.substring(d, i, F.lit(1))) - 48)
        return F.aggregate(F.transform(places, lambda x, i: F.when(i % 2 == 1, F.when(x > 4, 2 * x - 9).otherwise(2 * x)).otherwise(x)), F.lit(0), lambda a, x: a + x)

    return F.coalesce(F.when(F.length(digits) > 0, let(F.reverse(digits), total) % 10 == 0), F.lit(False))


_CHECKS = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(r"\A0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])){3}\z"),
    "card": lambda v: F.when(F.length(_digits(v)).between(16, 19), _luhn(_digits(v))).otherwise(False),
    "phone": lambda v: F.length(_digits(v)).between(8, 15),
}


def base_spans(text: Column, kind: str) -> Column:
    found = F.filter(matches(text, BASE[kind]), lambda x: _CHECKS[kind](x["v"]))
    return found if NEEDS[kind] is None else F.when(F.contains(text, F.lit(NEEDS[kind])), found).otherwise(F.array().cast(EMPTY))


def features(v: Column, before: Column, after: Column, kind: str) -> list[Column]:
    """Format and context features of a candidate of one kind."""
    d = F.regexp_replace(v, r"[^0-9]", "")
    low = F.lower(before)
    num = lambda c: c.cast("double")
    return [
        num(F.length(v)),
        num(F.length(d)),
        num(F.length(F.regexp_replace(v, r"[A-Za-z0-9]", ""))),
        num(_luhn(d)),
        num(low.rlike(CUES[kind])),
        num(low.rlike(AGAINST)),
        num(v.rlike(r"[(\[{]")),
        num(v.rlike(r"\A[0-9]{3}[\x20.-]")),
        num(v.rlike(r"\A[0-9]{4}[./-][0-9]{2}")),
        num(v.rlike(r"(?i)\x20dot\x20[a-z]{2,4}\z|[)\]}]\x20?[a-z]{2,4}\z")),
        num(F.size(F.array_distinct(F.split(d, ""))) <= 3),
        num(before.rlike(r"[0-9]\z")),
        num(after.rlike(r"\A[0-9]")),
        num(v.rlike(r"\A(?:[0-9]{16,19}|[0-9]{4}(?:[^0-9]{1,3}[0-9]{4}){3}(?:[^0-9]{1,3}[0-9]{1,3})?)\z")),
    ]


def labelled_sample(seed: int = 7) -> list[dict]:
    """Deterministic labelled candidates (kind, before, v, after, y): at most SAMPLE_MOST rows."""
    rnd, more, rows = random.Random(seed), random.Random(seed + 1), []
    digit = lambda n, rnd=rnd: "".join(rnd.choice("0123456789") for _ in range(n))
    name = lambda: rnd.choice(["ann.lee", "joe", "k.weber", "maria_s", "info", "sales", "dr.kim"]) + rnd.choice(["", digit(2)])
    dom = lambda: rnd.choice(["example", "mail", "corp-net", "uni", "post"])
    tld = lambda: rnd.choice(["com", "org", "net", "de", "co"])

    def luhn(n: int, rnd: random.Random = rnd) -> str:
        body = digit(n - 1, rnd)
        s = sum(int(c) if i % 2 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(body)))
        return body + str(-s % 10)

    def in_run(good: bool) -> tuple[str, str, str]:
        """(digits before, card, digits after) as they stand in a run of digits; a bad one lacks the check digit or starts or ends within a group."""
        n, sep = more.choice([16, 16, 16, 17, 18, 19]), more.choice(["", " ", "-"])
        gap, within = sep or " ", 0 if good else more.choice([0, 1, 2, 3])
        d = luhn(n, more) if good or within else digit(n, more)
        shift = more.randint(1, 3) if within else 0
        groups = [d] if not sep else [x for x in (d[:shift], *(d[i : i + 4] for i in range(shift, n, 4))) if x]
        left = digit(more.randint(1, 12), more) if within & 1 else more.choice(["", digit(more.choice([1, 2, 4, 16]), more) + gap])
        right = digit(more.randint(1, 12), more) if within & 2 else more.choice(["", gap + digit(more.choice([1, 2, 4, 16]), more)])
        return left, sep.join(groups), right

    cue = {"email": ["email me: ", "contact ", "write to ", "reach us, "], "ip": ["server at ", "client ip ", "host "], "card": ["card ", "paid by visa ", "credit card no "], "phone": ["call ", "tel. ", "phone: ", "my mobile is ", "fax "], "id": ["ssn ", "iban ", "bank account ", "passport "]}
    off = ["see order ", "invoice ", "version ", "isbn ", "issue ", "page ", "part ", "ticket ", "model ", "ratio "]
    plain = ["the ", "and then ", "it was ", "of this ", "number "]
    while len(rows) < SAMPLE_MOST:
        kind, good = rnd.choice(KINDS), rnd.random() < 0.5
        at, dot = rnd.choice([(" at ", " dot "), ("(at)", "(dot)"), ("[at]", "[dot]"), ("@", "[dot]")])
        sep = rnd.choice([" ", "-", "."])
        if kind == "email":
            v = name() + at + dom() + dot + tld() if good else rnd.choice(["look at the dot matrix", "meet at noon dot then", "arrive at home dot please"])
        elif kind == "ip":
            v = ":".join(rnd.choice(["2001", "fe80", "db8", "a1b2", digit(4)]) for _ in range(rnd.choice([6, 8]))) if good else ":".join(digit(2) for _ in range(rnd.choice([4, 6])))
        elif kind == "card":
            d = luhn(16) if good else digit(16)
            v = rnd.choice([" - ", ".", "/", "  "]).join(d[i : i + 4] for i in range(0, 16, 4))
        elif kind == "phone":
            v = rnd.choice([f"({digit(3)}) ", digit(3) + sep, "0" + digit(3) + sep]) + digit(3) + sep + digit(4) if good else rnd.choice([f"{digit(4)}-{digit(4)}-{digit(4)}", f"20{digit(2)}.{digit(3)}.{digit(3)}", f"{digit(3)}.{digit(3)}.{digit(3)}"])
        else:
            v = rnd.choice([f"{digit(3)}-{digit(2)}-{digit(4)}", "DE" + digit(20), "GB" + digit(2) + " WEST " + " ".join(digit(4) for _ in range(3))])
            v = v if good else rnd.choice([v, "AB" + digit(14)])
        before = rnd.choice(cue[kind] + plain[: 2 if kind in ("id", "phone") else 5]) if good else rnd.choice(off + (plain if kind != "id" else []))
        left, after = "", ""
        if kind == "card" and more.random() < 0.6:
            left, v, after = in_run(good)
        rows.append({"kind": kind, "before": before + left, "v": v, "after": after, "y": int(good)})
    return rows


_MODEL: dict[str, tuple[list, float, dict]] = {}


def model(spark: SparkSession) -> dict[str, tuple[list, float, dict]]:
    """Per kind: trees, threshold and held-out figures; fitted once a process."""
    if not _MODEL:
        _MODEL.update(_fitted(spark))
    return _MODEL


def _fitted(spark: SparkSession) -> dict[str, tuple[list, float, dict]]:
    rows = labelled_sample()
    df = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), "array<struct<kind:string,before:string,v:string,after:string,y:int>>")).alias("r")).select("r.*")
    out = {}
    for kind in KINDS:
        got = df.where(F.col("kind") == kind).select("y", F.array(*features(F.col("v"), F.col("before"), F.col("after"), kind)).alias("x")).collect()
        x, y = np.array([r["x"] for r in got]), np.array([r["y"] for r in got])
        held = np.arange(len(y)) % 3 == 2
        trees = boost.fit(x[~held], y[~held])
        z = boost.score(trees, x[held])
        cut = boost.threshold(z, y[held], PRECISION)
        picked = z >= cut
        out[kind] = trees, cut, {"held_out": int(held.sum()), "precision": float(y[held][picked].mean()) if picked.any() else None, "recall": float(picked[y[held] == 1].mean())}
    return out


def candidates(text: Column, kind: str, trees: list, cut: float, base: Column) -> Column:
    """Generated spans of one kind apart from the base spans that the trees select: struct<z,k,s,e,kind,v>, z the score."""
    i = KINDS.index(kind)

    def scored(x: Column) -> Column:
        before = F.substring(text, F.greatest(x["s"] - 29, F.lit(1)), F.least(x["s"], F.lit(30)))
        after = F.substring(text, x["e"] + 1, F.lit(1))
        # the context is cut out once: a place in a text is found by counting from its start
        z = let(F.struct(before.alias("b"), after.alias("a")), lambda c: boost.expression(trees, features(x["v"], c["b"], c["a"], kind)))
        return F.struct(z.alias("z"), F.lit(i).alias("k"), x["s"].alias("s"), x["e"].alias("e"), F.lit(kind).alias("kind"), x["v"].alias("v"))

    proposed = F.concat(*[every_match(text, g) for g in GENERATORS[kind]])
    return F.filter(F.transform(let(proposed, lambda p: clear_of(p, base)), scored), lambda x: x["z"] >= F.lit(cut))


def _best(found: Column) -> Column:
    """Spans that don't overlap, chosen by score; at equal scores the longer, then the earlier, then the kind.

    Each run of overlapping spans is settled by itself.
    """
    plain = lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"), x["v"].alias("v"))

    def settled(run: Column) -> Column:
        ranked = F.sort_array(F.transform(run, lambda x: F.struct((-x["z"]).alias("z"), (x["s"] - x["e"]).alias("n"), x["s"].alias("s"), x["k"].alias("k"), x.alias("x"))))
        zero = F.array().cast("array<struct<k:int,s:int,e:int,kind:string,v:string>>")
        return F.when(F.size(run) == 1, F.transform(run, plain)).otherwise(F.aggregate(ranked, zero, lambda acc, r: F.when(apart(r["x"], acc), F.array_append(acc, plain(r["x"]))).otherwise(acc)))

    by_start = F.sort_array(F.transform(found, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"), x["z"].alias("z"), x["kind"].alias("kind"), x["v"].alias("v"))))
    return F.sort_array(F.flatten(F.transform(let(by_start, overlapping_runs), settled)))


def _tag(spans: Column, i: int) -> Column:
    return F.transform(spans, lambda x: F.struct(F.lit(i).alias("k"), x["s"].alias("s"), x["e"].alias("e"), F.lit(KINDS[i]).alias("kind"), x["v"].alias("v")))


def find_pii(docs: DataFrame, text_col: str = "text", base_col: str = "base", added_col: str = "added") -> DataFrame:
    """docs with ``base_col`` and ``added_col``: arrays of struct<k,s,e,kind,v> by kind, then start."""
    fitted = model(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = F.concat(*[_tag(base_spans(text, k), i) for i, k in enumerate(KINDS[:4])])
    out = docs.withColumn(base_col, base)
    maybe = F.concat(*[candidates(text, k, *fitted[k][:2], F.col(base_col)) for k in KINDS])
    return out.withColumn(added_col, F.when(text.rlike(r"[0-9]|\x20dot\x20|[(\[{]dot"), _best(maybe)).otherwise(F.filter(F.col(base_col), lambda x: F.lit(False))))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every found span replaced by [KIND]; overlapping base spans count from the earliest start."""
    found = find_pii(docs, text_col, "_pii_base", "_pii_added")
    spans = F.sort_array(F.transform(F.concat("_pii_base", "_pii_added"), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    text = F.coalesce(F.col(text_col), F.lit(""))

    def step(acc, x):
        fresh = F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(x["s"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(spans, zero, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    return found.withColumn(text_col, F.when(F.col(text_col).isNotNull(), done)).select(*docs.columns)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: counts of base spans by kind, their digest, and all spans as text."""
    found = find_pii(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    count = lambda i: F.size(F.filter("base", lambda x: x["k"] == i)).cast("long")
    every = F.sort_array(F.concat("base", "added"))
    return found.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])], F.sha2(render(F.col("base")), 256).alias("base_sha256"), render(every).alias("spans"), F.size("added").cast("long").alias("n_added"))
