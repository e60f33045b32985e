"""The pipeline's stages against brute-force versions, over the smallest documents and odd rows."""

import hashlib
import re
from collections import Counter

import public_tokenizers
import pytest

import corpus_pipeline
from lodestream.llm import decontaminate, quality

from .conftest import DATA, DOCS, ODD
from .test_operators import WORD, brute_jaccard, brute_lines

EXTRA = ["gone", "n_removed", "rejected_by", "base", "added", "ids"]
LINE = "a line of some length that stands in several documents of this table"
WORDS = [f"v{i}" for i in range(80)]
REPEATED = [
    (-21, LINE + "\n" + " ".join(WORDS)),
    (-20, LINE),
    (-20, " ".join(WORDS[::-1]) + "\nmore of it"),  # an id with another text
    (-19, "twin " + " ".join(WORDS[:40])),
    (-19, "twin " + " ".join(WORDS[:40])),  # equal in id and text
    (None, LINE),
    (None, LINE),
]


@pytest.fixture(scope="module")
def table(spark):
    """Documents with repeated ids, twins, null ids, and extra columns named as the stages' own."""
    held = spark.read.parquet(f"{DATA}/benchmark.parquet").orderBy("item_id").first().text
    leak = [(-30, "before it " + held + " behind it"), (None, held), (-31, held), (-31, "clean words " + " ".join(WORDS[5:40]))]
    odd = spark.createDataFrame([(i, t, None, None, None if t is None else len(t)) for i, t in [*ODD, *REPEATED, *leak]], DOCS)
    d = spark.read.parquet(f"{DATA}/documents.parquet").unionByName(odd)
    for k, c in enumerate(EXTRA):
        d = d.selectExpr("*", f"concat('{k}', doc_id) as {c}")
    return d.cache()


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def check(spark, stage, table, want):
    out = stage(spark, table, DATA)
    assert out.columns == table.columns
    got = out.collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(want)
    for r in got:
        assert r.gone is None if r.doc_id is None else r.gone == f"0{r.doc_id}" and r.ids == f"5{r.doc_id}"
    none = stage(spark, table.where("false"), DATA)
    assert none.count() == 0 and none.columns == table.columns
    return got


def test_quality_rules(spark, table):
    def repeated(w):
        runs = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        return len({k + j for k in range(len(w) - 7) if runs[tuple(w[k : k + 8])] > 1 for j in range(8)})

    def kept(t):
        w = WORD.findall(t or "")
        n, chars = len(w), sum(map(len, w))
        full = [x for x in (t or "").split("\n") if WORD.search(x)]
        letters = sum(c.isalpha() for c in t or "")
        symbols, shouts = sum(c in "#*$%&|<>" for c in t or ""), (t or "").count("!")
        return not (
            n < 20 or 10 * symbols > 2 * n or 10 * shouts > 3 * n or chars > 15 * n or chars < 2 * n or 10 * letters < 3 * chars
            or (n >= 50 and 20 * len(set(w)) < n) or (len(full) >= 4 and 2 * (len(full) - len(set(full))) > len(full)) or 100 * repeated(w) > 30 * n
        )

    check(spark, corpus_pipeline.quality_rules, table, [(i, t) for i, t in rows_of(table) if kept(t)])
    assert {r.name for r in quality.RULES} == {"short", "symbols", "shouting", "word_length", "letters", "same_words", "dup_lines", "repeats"}


def test_line_dedup(spark, table):
    rows = rows_of(table)
    got = check(spark, corpus_pipeline.line_dedup, table, [(i, t) for (i, _), t in zip(rows, brute_lines(rows), strict=True) if t is not False])
    assert all(r.n_chars == len(r.text) for r in got if r.text is not None and (r.doc_id or 0) < 0)


def test_near_duplicates(spark, table):
    rows = rows_of(table)
    names = {r: k for k, r in enumerate(sorted({r for r in rows if r[0] is not None}, key=str))}
    comp = brute_jaccard([(k, t) for (_, t), k in names.items()])
    member = {}
    for r, k in names.items():
        member.setdefault(comp[k][1] if comp[k][0] else ("alone", k), []).append(r)
    lowest = {c: min(i for i, _ in rs) for c, rs in member.items()}
    out = corpus_pipeline.near_duplicates(spark, table, DATA)
    assert out.columns == table.columns
    got = rows_of(out)
    assert Counter(r for r in got if r[0] is None) == Counter(r for r in rows if r[0] is None)
    named = [r for r in got if r[0] is not None]
    assert len(named) == len(member) and set(named) <= set(names)
    for c, rs in member.items():
        (stays,) = [r for r in rs if r in set(named)]
        assert stays[0] == lowest[c]
    assert corpus_pipeline.near_duplicates(spark, table.where("false"), DATA).count() == 0


def test_benchmark_decontamination(spark, table):
    items = spark.read.parquet(f"{DATA}/benchmark.parquet").collect()
    parts = [decontaminate.parts(r.text, None) for r in items]

    def holds(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        grams = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        for q, a in parts:
            asked = {tuple(q[k : k + 5]) for k in range(len(q) - 4)}
            if len(asked & grams) >= 0.8 * len(asked) and len(set(a) & set(w)) >= 0.8 * len(set(a)):
                return True
        return False

    rows = rows_of(table)
    want = [(i, t) for i, t in rows if not holds(t)]
    assert len(want) < len(rows) and (-31, "clean words " + " ".join(WORDS[5:40])) in want
    check(spark, corpus_pipeline.benchmark_decontamination, table, want)


def test_encode(spark, table):
    import tiktoken

    ranks = corpus_pipeline.byte_bpe.Vocabulary.read(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).ranks
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for i, t in rows_of(table):
        ids = coder.encode_ordinary(t or "")
        want[i, len(ids), tuple(ids), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    got = Counter((r.doc_id, r.n_tokens, tuple(r.ids), r.decoded_sha256) for r in corpus_pipeline.encode(spark, table, DATA).collect())
    assert got == want
    assert corpus_pipeline.encode(spark, table.where("false"), DATA).count() == 0


def test_run(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = docs
    for _, stage in corpus_pipeline.STAGES:
        want = stage(spark, want, DATA).checkpoint()
    got = corpus_pipeline.run(spark, DATA)
    assert {r.doc_id: r.decoded_sha256 for r in got.collect()} == {r.doc_id: r.decoded_sha256 for r in want.collect()}

