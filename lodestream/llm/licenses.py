"""License notices: exact phrases, and short notices with a few edits.

Every notice is cut into errors + 1 pieces. By the pigeonhole principle a
place with at most ``errors`` edits holds one piece unchanged, so an
Aho-Corasick scan for the pieces yields all candidate places. Around each, the
regex library's bounded-error matching verifies the notice and reports its
span. Places of the exact phrases come from the same words.

Defined cases: null and empty texts have no words, empty labels and score 0;
positions of words count from 0, of spans are code points of the lower-cased
text (A-Z only, so of the text itself).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

#: Phrases and labels that are counted exactly.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


@dataclass(frozen=True)
class Notice:
    label: str
    text: str  # lower case, words separated by single spaces
    errors: int = 3


#: Short notices searched with a few edits, from the public texts of the licences, their recommended
#: notices and the SPDX identifiers.
NOTICES = (
    Notice("apache-2.0", "licensed under the apache license, version 2.0"),
    Notice("mit", "released under the mit license", 2),
    Notice("mit", "permission is hereby granted, free of charge, to any person obtaining a copy", 5),
    Notice("gpl", "licensed under the gnu general public license, version 3"),
    Notice("cc-by-nc", "licensed under cc by-nc 4.0", 1),
    Notice("bsd", "redistribution and use in source and binary forms, with or without modification, are permitted", 5),
    Notice("mpl-2.0", "subject to the terms of the mozilla public license, v. 2.0", 4),
    Notice("reserved", "all rights reserved", 1),
    Notice("no-warranty", "the software is provided \"as is\", without warranty of any kind", 4),
    Notice("gpl", "under the terms of the gnu general public license as published by the free software foundation", 5),
    Notice("lgpl", "under the terms of the gnu lesser general public license", 3),
    Notice("agpl", "under the terms of the gnu affero general public license", 3),
    Notice("isc", "permission to use, copy, modify, and/or distribute this software for any purpose", 4),
    Notice("unlicense", "this is free and unencumbered software released into the public domain", 4),
    Notice("bsl-1.0", "distributed under the boost software license, version 1.0", 3),
    Notice("epl-2.0", "under the terms of the eclipse public license", 3),
    Notice("zlib", "this software is provided 'as-is', without any express or implied warranty", 4),
    Notice("cc-by", "licensed under a creative commons attribution 4.0 international license", 3),
    Notice("cc-by-sa", "creative commons attribution-sharealike 4.0 international", 2),
    Notice("cc0", "creative commons cc0 1.0 universal", 2),
    Notice("apache-2.0", "spdx-license-identifier: apache-2.0", 1),
    Notice("mit", "spdx-license-identifier: mit", 1),
    Notice("gpl", "spdx-license-identifier: gpl-2.0", 1),
    Notice("bsd", "spdx-license-identifier: bsd-3-clause", 1),
    Notice("mpl-2.0", "spdx-license-identifier: mpl-2.0", 1),
)

_NOT_WORD = np.zeros(256, dtype=bool)
_NOT_WORD[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def pieces(n: Notice) -> list[tuple[str, int]]:
    """(seed, offset) of errors + 1 parts of nearly equal length that cover the notice."""
    k, m = n.errors + 1, len(n.text)
    cuts = [m * i // k for i in range(k + 1)]
    return [(n.text[a:b], a) for a, b in zip(cuts, cuts[1:], strict=False)]


class Scanner:
    """Compiled once a worker."""

    def __init__(self, notices=NOTICES, phrases=None):
        import ahocorasick
        import regex

        self.notices, self.phrases = notices, dict(PHRASES if phrases is None else phrases)
        self.auto = ahocorasick.Automaton()
        seeds: dict[str, list] = {}
        for i, n in enumerate(notices):
            for seed, at in pieces(n):
                seeds.setdefault(seed, []).append((i, at))
        for seed, where in seeds.items():
            self.auto.add_word(seed, (len(seed), where))
        self.auto.make_automaton()
        self.fuzzy = [regex.compile(f"(?b)(?:{regex.escape(n.text, special_only=True)}){{e<={n.errors}}}") for n in notices]
        self.exact = [(w.split(), label) for w, label in self.phrases.items()]
        self.rare = [max(w.split(), key=len) for w in self.phrases]
        self.word = re.compile(_WORD)

    def phrase_places(self, low: str) -> list[tuple[int, int, str]]:
        """(first word, words, label) of each place of an exact phrase."""
        if not any(r in low for r in self.rare):
            return []
        words = self.word.findall(low)
        at: dict[str, list[int]] = {}
        heads = {w[0] for w, _ in self.exact}
        for i, x in enumerate(words):
            if x in heads:
                at.setdefault(x, []).append(i)
        return sorted((i, len(w), label) for w, label in self.exact for i in at.get(w[0], ()) if words[i : i + len(w)] == w)

    def spans(self, low: str) -> list[tuple[int, int, str, int]]:
        """(start, end, label, edits) of each fuzzy notice; for one notice, without overlap."""
        regions: dict[int, list[list[int]]] = {}
        for end, (length, where) in self.auto.iter(low):
            for i, at in where:
                n = self.notices[i]
                start = end - length + 1 - at
                lo, hi = max(0, start - n.errors), min(len(low), start + len(n.text) + 2 * n.errors)
                r = regions.setdefault(i, [])
                if r and lo <= r[-1][1]:
                    r[-1][0], r[-1][1] = min(r[-1][0], lo), max(r[-1][1], hi)
                else:
                    r.append([lo, hi])
        out = []
        for i, found in regions.items():
            for lo, hi in found:
                out += self.best_first(low, lo, hi, i)
        return sorted(out)

    def best_first(self, low: str, lo: int, hi: int, i: int) -> list[tuple[int, int, str, int]]:
        """Places of one notice in a region: the best, then those in what is left before and behind it."""
        n, out, parts = self.notices[i], [], [(lo, hi)]
        while parts:
            lo, hi = parts.pop()
            if hi - lo >= len(n.text) - n.errors and (m := self.fuzzy[i].search(low, lo, hi)):
                out.append((m.start(), m.end(), n.label, sum(m.fuzzy_counts)))
                parts += [(lo, m.start()), (m.end(), hi)]
        return out


def _lower(t: str) -> str:
    return t.lower() if t.isascii() else re.sub("[A-Z]+", lambda m: m[0].lower(), t)


SCHEMA = "n_words long, places array<struct<word:long,words:long,label:string>>, notices array<struct<start:long,end:long,label:string,edits:long>>"
_PLACES = pa.list_(pa.struct([("word", pa.int64()), ("words", pa.int64()), ("label", pa.string())]))
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("edits", pa.int64())]))


def _scan(notices, phrases):
    def run(batches):
        scanner = Scanner(notices, phrases)
        for b in K.small(batches):
            raw, off = K.flat(b.column(b.num_columns - 1))
            counts = np.zeros(len(off) - 1, np.int64)
            for i, j in K.slices(off):
                _, _, first = K.word_spans(K._LOWER[raw[off[i] : off[j]]], off[i : j + 1] - off[i], _NOT_WORD)
                counts[i:j] = np.diff(first)
            places, spans = [], []
            for t in b.column(b.num_columns - 1).to_pylist():
                low = _lower(t) if t else ""
                places.append([{"word": i, "words": n, "label": x} for i, n, x in scanner.phrase_places(low)])
                spans.append([{"start": s, "end": e, "label": x, "edits": n} for s, e, x, n in scanner.spans(low)])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(counts), pa.array(places, _PLACES), pa.array(spans, _SPANS)], names=[*b.schema.names[:-1], "n_words", "places", "notices"])

    return run


def find_notices(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices=NOTICES, phrases=None) -> DataFrame:
    """(doc_id, n_words, places of exact phrases, spans of fuzzy notices) for each row."""
    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return kept.mapInArrow(_scan(tuple(notices), phrases), f"doc_id long, {SCHEMA}")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: places, labels, and a score that grows with exactness of the best notice."""
    f = find_notices(docs, id_col, text_col)
    base = F.array_sort(F.array_distinct(F.col("places.label")))
    every = F.array_sort(F.array_distinct(F.concat(F.col("places.label"), F.col("notices.label"))))
    best = F.array_max(F.transform("notices", lambda x: 1 - x["edits"].cast("double") / (x["end"] - x["start"] + 1)))
    return f.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.word").alias("first_word"),
        F.array_max("places.word").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(best, F.lit(0.0))).alias("score"),
        "notices",
    )
