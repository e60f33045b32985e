"""Benchmark decontamination: every training passage queries a BM25 index of the test items.

Test items are the indexed documents, passages (overlapping runs of words, so
that every place of an item lies whole in one) are the queries. Scores are
divided by an item's score for itself, so one threshold serves all items.
Retrieval is exact above the threshold:

1. terms that together stay under the threshold for every item can't make a
   hit; passages with none of the other terms are dropped, for a whole slice of
   text at a time;
2. so are passages whose distinct terms' maxima in every block of items add up
   to less;
3. what is left runs block-max WAND over the postings.

Retrieved pairs are verified on the words: share of the question's distinct
5-word shingles in the passage, and share of the answer's words. Where a table
has no answer column, the last quarter of an item's words is its answer.

Items are indexed in blocks of bounded number, one after the other, so what
the driver and a task hold doesn't follow the benchmark; each block is one scan
of the documents, whose hits are kept in the shared folder. Document
frequencies and the mean length are those of all items.

Defined cases: null and empty texts hold nothing; null or empty items are
found nowhere; an item of fewer than five question words is one shingle.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .shared import cut

K1, B = 1.2, 0.75
#: Share of an item's own score that a passage needs to be verified; less for an item of which a passage that
#: scores less can pass verification.
RETRIEVE = 0.7
QUESTION, ANSWER = 0.8, 0.8
SHINGLE = 5
ITEMS_A_SCAN = 20_000
BLOCK = 8
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def shingles(w: list[str]) -> set[tuple[str, ...]]:
    return {tuple(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)} or ({tuple(w)} if w else set())


def parts(text: str | None, answer: str | None) -> tuple[list[str], list[str]]:
    """Words of an item's question and of its answer."""
    w = words(text)
    cut = len(w) - len(w) // 4
    return (w, words(answer)) if answer is not None else (w[:cut], w[cut:])


def least_share(question: list[str], answer: set[str], weight: dict[str, float]) -> float:
    """A share of an item's own score that every passage which passes verification reaches.

    Beside a shingle that is held, each missing word in front of it starts a
    missing shingle and each behind it ends one, so no more words are missing
    than places of shingles; the heaviest may be.
    """
    held = shingles(question)
    places = max(1, len(question) - SHINGLE + 1)
    out = places - math.ceil(QUESTION * len(held) - 1e-9) if len(question) >= SHINGLE else 0
    gone = sum(sorted((weight[x] for x in set(question)), reverse=True)[:out])
    gone += sum(sorted((weight[x] for x in answer), reverse=True)[: len(answer) - math.ceil(ANSWER * len(answer) - 1e-9)])
    return max(sum(weight.values()) - gone, min(weight.values())) / sum(weight.values())


class Index:
    """Inverted index of items with block maxima; scores are shares of an item's own score.

    ``stats`` are the number of items, their mean length and the document
    frequencies where these are not all items. Postings are scaled by an
    item, so that one threshold stands for the item's own; found scores aren't.
    """

    def __init__(self, items: list[tuple[int, str, str | None]], threshold: float = RETRIEVE, stats: tuple[int, float, dict[str, int]] | None = None):
        self.threshold = threshold
        self.ids, self.question, self.answer, every, asked = [], [], [], [], []
        for i, text, answer in items:
            if not words(text):
                continue
            q, a = parts(text, answer)
            self.ids.append(i)
            self.question.append(shingles(q))
            self.answer.append(set(a))
            asked.append(q)
            every.append(q + a)
        n, mean = len(every), sum(map(len, every)) / max(1, len(every))
        self.longest = max(map(len, every), default=0)
        tf = [defaultdict(int) for _ in every]
        df: dict[str, int] = defaultdict(int)
        for i, w in enumerate(every):
            for x in w:
                tf[i][x] += 1
            for x in tf[i]:
                df[x] += 1
        total = n
        if stats is not None:
            total, mean, df = stats
        self.scale = []
        posts: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for i, counts in enumerate(tf):
            norm = K1 * (1 - B + B * len(every[i]) / mean)
            weight = {x: math.log(1 + (total - df[x] + 0.5) / (df[x] + 0.5)) * c * (K1 + 1) / (c + norm) for x, c in counts.items()}
            own = sum(weight.values())
            self.scale.append(threshold / min(threshold, least_share(asked[i], self.answer[i], weight)))
            for x, v in weight.items():
                posts[x].append((i, v / own * self.scale[i]))
        self.terms = sorted(posts)
        self.posts = [posts[x] for x in self.terms]
        self.best = np.array([max(v for _, v in p) for p in self.posts], dtype=np.float64)
        self.blocks = []
        for p in self.posts:
            m: dict[int, float] = {}
            for i, v in p:
                m[i // BLOCK] = max(m.get(i // BLOCK, 0.0), v)
            self.blocks.append(m)
        self.n_blocks = -(-n // BLOCK)
        self.at = np.cumsum([0, *map(len, self.blocks)])
        self.block = np.array([x for m in self.blocks for x in m], dtype=np.int64)
        self.most = np.array([x for m in self.blocks for x in m.values()], dtype=np.float64)
        # Terms are spared, common and short ones first, while what is spared of any one item
        # stays under the threshold: a passage of spared terms alone reaches no item.
        self.essential = np.ones(len(self.terms), dtype=bool)
        spared = [0.0] * n
        for t in sorted(range(len(self.terms)), key=lambda t: (-len(self.posts[t]), len(self.terms[t]))):
            if all(spared[i] + v < threshold - 1e-9 for i, v in self.posts[t]):
                self.essential[t] = False
                for i, v in self.posts[t]:
                    spared[i] += v
        raw = "".join(self.terms).encode()
        off = np.cumsum([0, *(len(x.encode()) for x in self.terms)])
        h = K.span_hashes(np.frombuffer(raw, np.uint8), off[:-1], off[1:])
        self.order = np.argsort(h)
        self.hashes = h[self.order]
        self.maybe = np.zeros(1 << 16, dtype=bool)
        self.maybe[(h >> np.uint64(48)).astype(np.int64)] = True

    def term_ids(self, h: np.ndarray) -> np.ndarray:
        """Term of each word hash, -1 for words in no item."""
        out = np.full(len(h), -1, np.int64)
        if len(self.hashes):
            i = np.flatnonzero(self.maybe[(h >> np.uint64(48)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.hashes, h[i]), len(self.hashes) - 1)
            hit = self.hashes[at] == h[i]
            out[i[hit]] = self.order[at[hit]]
        return out

    def search(self, query: list[int]) -> list[tuple[int, float]]:
        """(item, score) of all items at the threshold, by block-max WAND over the distinct query terms."""
        need, out = self.threshold - 1e-9, []
        at = {t: 0 for t in query}
        live = sorted(at, key=lambda t: self.posts[t][0][0])
        while live:
            live.sort(key=lambda t: self.posts[t][at[t]][0])
            total, pivot = 0.0, None
            for k, t in enumerate(live):
                total += self.best[t]
                if total >= need:
                    pivot = k
                    break
            if pivot is None:
                break
            item = self.posts[live[pivot]][at[live[pivot]]][0]
            while pivot + 1 < len(live) and self.posts[live[pivot + 1]][at[live[pivot + 1]]][0] == item:
                pivot += 1
            block = item // BLOCK
            if sum(self.blocks[t].get(block, 0.0) for t in live[: pivot + 1]) < need:
                # no item of this block up to the next list's head can reach the threshold
                after = self.posts[live[pivot + 1]][at[live[pivot + 1]]][0] if pivot + 1 < len(live) else 1 << 60
                target = max(item + 1, min((block + 1) * BLOCK, after))
                moved = live[: pivot + 1]
            elif self.posts[live[0]][at[live[0]]][0] == item:
                score = sum(self.posts[t][at[t]][1] for t in live[: pivot + 1])
                if score >= need:
                    out.append((item, score / self.scale[item]))
                target, moved = item + 1, live[: pivot + 1]
            else:
                target, moved = item, live[:pivot]
            for t in moved:
                p = self.posts[t]
                while at[t] < len(p) and p[at[t]][0] < target:
                    at[t] += 1
            live = [t for t in live if at[t] < len(self.posts[t])]
        return out


def passages(first: np.ndarray, length: int, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, first and last word (exclusive) of every passage."""
    n = np.diff(first)
    count = np.where(n > 0, np.maximum(1, -(-(n - length) // stride) + 1), 0)
    doc = np.repeat(np.arange(len(n)), count)
    k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    start = first[doc] + k * stride
    return doc, start, np.minimum(start + length, first[doc + 1])


def _hits(index: Index):
    length = max(128, 2 * index.longest)
    stride = length - index.longest

    def one(raw, off):
        raw = K._LOWER[raw]
        s, e, first = K.word_spans(raw, off)
        term = index.term_ids(K.span_hashes(raw, s, e))
        doc, a, z = passages(first, length, stride)
        key = np.zeros(len(term) + 1, np.int64)
        np.cumsum((term >= 0) & index.essential[term] if len(index.terms) else term >= 0, out=key[1:])
        left = np.flatnonzero(key[z] > key[a])
        if not len(left):
            return
        n = z[left] - a[left]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a[left], n)
        pair = np.repeat(np.arange(len(left)), n) * len(index.terms) + term[place]
        pair = np.unique(pair[term[place] >= 0])
        of, t = pair // len(index.terms), pair % len(index.terms)
        m = index.at[t + 1] - index.at[t]
        entry = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(index.at[t], m)
        block = np.repeat(of, m) * index.n_blocks + index.block[entry]
        bound = np.bincount(block, weights=index.most[entry], minlength=len(left) * index.n_blocks).reshape(len(left), -1).max(1)
        cuts = np.searchsorted(of, np.arange(len(left) + 1))
        for i in np.flatnonzero(bound >= index.threshold - 1e-9):
            p = left[i]
            found = index.search(t[cuts[i] : cuts[i + 1]].tolist())
            if found:
                w = [raw[s[x] : e[x]].tobytes().decode() for x in range(a[p], z[p])]
                own, held = shingles(w), set(w)
                grams = {m: {tuple(w[x : x + m]) for x in range(len(w) - m + 1)} for m in {len(next(iter(index.question[j]))) for j, _ in found if index.question[j]} - {SHINGLE}}
                for j, score in found:
                    q = index.question[j]
                    m = len(next(iter(q)))
                    has = len(q & (own if m == SHINGLE else grams[m])) / len(q)
                    ans = len(index.answer[j] & held) / len(index.answer[j]) if index.answer[j] else 1.0
                    if has >= QUESTION and ans >= ANSWER:
                        yield int(doc[p]), index.ids[j], score, has, ans

    def run(batches):
        for b in K.small(batches):
            ids = b.column(0).to_pylist()
            raw, off = K.flat(b.column(1))
            rows = []
            for i, j in K.slices(off):
                rows += [(ids[i + d], *x) for d, *x in one(raw[off[i] : off[j]], off[i : j + 1] - off[i])]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

    return run


def _item_words(batches):
    """(scan, word) of each distinct word of an item, and one row with its number of words."""
    for b in batches:
        rows = []
        for scan, text, answer in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if words(text):
                w = [x for p in parts(text, answer) for x in p]
                rows += [(scan, x, 0) for x in set(w)] + [(scan, None, len(w))]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int32(), pa.string(), pa.int64()], strict=True)], names=["scan", "word", "length"])


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", answer_col: str | None = None) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) of every test item found in a document, at its best passage."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    items = items.select(F.col(item_col).cast("long").alias("i"), F.col(item_text).alias("t"), (F.col(answer_col) if answer_col else F.lit(None).cast("string")).alias("a"))
    scans = max(1, -(-items.count() // ITEMS_A_SCAN))
    items = items.withColumn("scan", F.pmod(F.xxhash64("i", "t"), F.lit(scans)).cast("int"))
    out = stats = None
    if scans > 1:
        terms = cut(items.select("scan", "t", "a").mapInArrow(_item_words, "scan int, word string, length long"))
        n, mean = terms.where("word is null").agg(F.count(F.lit(1)), F.avg("length")).first()
        df = cut(terms.where("word is not null").groupBy("word").agg(F.count(F.lit(1)).alias("df"), F.collect_set("scan").alias("scans")))
    for k in range(scans):
        block = items.where(F.col("scan") == k).select("i", "t", "a").orderBy("i", "t").collect()
        if scans > 1:
            stats = n, mean or 1.0, {r.word: r.df for r in df.where(F.array_contains("scans", F.lit(k))).select("word", "df").collect()}
        found = docs.mapInArrow(_hits(Index([tuple(r) for r in block], stats=stats)), "doc_id long, item_id long, score double, question_overlap double, answer_overlap double")
        found = cut(found) if scans > 1 else found  # so that the driver holds one block's index at a time
        out = found if out is None else out.union(found)
    best = F.max(F.struct("score", "question_overlap", "answer_overlap")).alias("b")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.*")
