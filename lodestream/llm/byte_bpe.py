"""Byte-level BPE by higher-order functions over arrays of byte pieces.

Each task splits its texts by the tokenizer's pattern, in chunks of bounded
text. Words that the task meets for the first time become arrays of the ids of
their bytes, and one fold for each of them merges the adjacent pair of lowest
rank until none is left, in built-in higher-order functions. The ids then go
back to every place of the word by its number in the task, so nothing is
shuffled, collected or kept, and a task folds each distinct word once (it
forgets its words when there are ``WORDS_A_TASK`` of them). Ranks come from a
literal map from pairs of ids, laid out as a perfect hash table because lookup
in a map is a scan; it is a table of one row, whose size is the vocabulary's.
The id of a merged pair is its rank. Words over ``LONG`` bytes merge all places
of the lowest rank in one step, unless that could differ from merging them one
by one.

Decoding concatenates the pieces' bytes, in the worker that puts the ids in
their places (``encode`` with ``decode_to``) or by itself (``decoded``).

Defined cases: null and empty texts have no ids; special tokens in a text are
ordinary text; columns of the input are kept, a column ``ids`` is replaced.
"""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .shared import cut, let

#: Text (characters) of a chunk; a longer document is a chunk of its own.
CHUNK_CHARS = 1 << 20
#: Distinct words that a task remembers.
WORDS_A_TASK = 1_000_000
#: Documents of a chunk, and ids, that one batch of results holds.
DOCS_A_BATCH, IDS_A_BATCH = 1000, 1 << 17
LONG = 64
#: Slots of the rank table, and of the displacements that spread its keys without a clash; primes.
SLOTS, BUCKETS = 524287, 65521
#: Ids and ranks are below 1 << BITS; NONE stands for "no such pair", above every rank.
BITS = 17
NONE = 1 << BITS
_SPACE = r"\t-\r\x20\x85\xA0  -     　"


def plain_pattern(pattern: str) -> str:
    """The pattern with white space spelled out, as that differs between regex engines."""
    out = pattern.replace(r"[^\s", f"[^{_SPACE}")
    return out.replace(r"\s", f"[{_SPACE}]").replace(r"\S", f"[^{_SPACE}]")


@dataclass(frozen=True)
class Vocabulary:
    """Ranks by bytes, and what the expressions need of them as JSON text."""

    ranks: dict
    pattern: str

    @staticmethod
    def read(path: str, pattern: str) -> Vocabulary:
        """From a file of base64 pieces with their ranks, read by the driver."""
        with open(path, "rb") as f:
            return Vocabulary({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}, pattern)

    def __hash__(self) -> int:
        return id(self)

    @property
    def size(self) -> int:
        return max(self.ranks.values()) + 1

    @property
    def radix(self) -> int:
        """A pair (a, b) has the key a * radix + b; the id ``size`` stands for the end of a word, in no pair."""
        return self.size + 1

    @lru_cache(maxsize=4)  # noqa: B019
    def pairs(self) -> dict[int, int]:
        """Rank by key of every pair of pieces that make a piece."""
        found, radix = {}, self.radix
        for piece, rank in self.ranks.items():
            for i in range(1, len(piece)):
                a, b = self.ranks.get(piece[:i]), self.ranks.get(piece[i:])
                if a is not None and b is not None:
                    found[a * radix + b] = rank
        return found

    @lru_cache(maxsize=4)  # noqa: B019
    def table(self) -> dict[str, np.ndarray]:
        """Entries (key << BITS) + rank by slot, and shifts: the slot of a key is (key ^ shift[key % BUCKETS]) % SLOTS."""
        pairs = self.pairs()
        if len(pairs) > SLOTS * 0.8 or self.size >= 1 << BITS:
            raise ValueError(f"a vocabulary of {self.size} pieces and {len(pairs)} pairs is too large for the rank table")
        buckets: dict[int, list[int]] = {}
        for key in pairs:
            buckets.setdefault(key % BUCKETS, []).append(key)
        entries, shift = np.full(SLOTS, -1, np.int64), np.zeros(BUCKETS, np.int64)
        taken: set[int] = set()
        for b, own in sorted(buckets.items(), key=lambda x: (-len(x[1]), x[0])):
            for s in range(1, 1 << 30):
                slots = {(key ^ s * 2654435761) % SLOTS for key in own}
                if len(slots) == len(own) and not slots & taken:
                    break
            taken |= slots
            shift[b] = s * 2654435761
            for key in own:
                entries[(key ^ s * 2654435761) % SLOTS] = (key << BITS) + pairs[key]
        return {"entries": entries, "shift": shift}

    def merge(self, word: bytes) -> list[int]:
        """The plain algorithm, for the driver's own use on the vocabulary's pieces."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            r, i = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if r == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    @lru_cache(maxsize=4)  # noqa: B019
    def unreachable(self) -> dict[bytes, int]:
        """Pieces that merging does not rebuild, though a whole word equal to one is its id."""
        return {p: r for p, r in self.ranks.items() if self.merge(p) != [r]}

    def by_id(self) -> list[bytes]:
        """The piece of every id."""
        pieces = [b""] * self.size
        for piece, rank in self.ranks.items():
            pieces[rank] = piece
        return pieces

    def frame(self, spark: SparkSession) -> DataFrame:
        """The rank table as one row (entries, shift), from literals, with lineage cut."""
        name = "spark.sql.maxPlanStringLength"
        before = spark.conf.get(name, None)
        spark.conf.set(name, "10000")  # the literals are long, and plans are logged
        try:
            return cut(spark.range(1).coalesce(1).select(*[F.from_json(F.lit(json.dumps(v.tolist())), "array<bigint>").alias(k) for k, v in self.table().items()]))
        finally:
            spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _ids(word: Column, radix: int, t: dict[str, Column]) -> Column:
    """Ids of a word by ranked merges.

    The state of the fold has a place for each piece, (rank << BITS) + id with
    the rank of the piece and the next one, between two ends (id radix - 1);
    the smallest value is the next pair to merge. A step puts the merged piece
    in its place and looks up its two new neighbours. ``word`` is the first
    state.
    """
    mask = F.lit((1 << BITS) - 1).cast("long")

    def place(key: Column) -> Column:
        """What stands at the first piece of a pair; an entry of another key is too far off to be a rank."""
        slot = (key.bitwiseXOR(F.get(t["shift"], (key % BUCKETS).cast("int"))) % SLOTS).cast("int")
        rank = F.least(F.pmod(F.get(t["entries"], slot) - F.shiftleft(key, BITS), F.lit(1 << 60)), F.lit(NONE).cast("long"))
        return F.shiftleft(rank, BITS) + F.call_function("div", key, F.lit(radix))

    def one(x: Column, m: Column) -> Column:
        new = F.shiftright(m, BITS)

        def at(j: Column) -> Column:
            """Merge the pair of the places j and j + 1, from 1; there is a place on either side."""
            keys = F.array(F.get(x, j - 2).bitwiseAND(mask) * radix + new, new * radix + F.get(x, j + 1).bitwiseAND(mask))
            return F.concat(F.slice(x, F.lit(1), j - 2), F.transform(keys, place), F.slice(x, j + 2, F.size(x)))

        return let(F.array_position(x, m).cast("int"), at)

    def every(x: Column, m: Column) -> Column:
        """Merge all places of rank m, of a run of overlapping ones every other."""
        new = F.shiftright(m, BITS)
        here = lambda i: F.coalesce(F.get(x, i) == m, F.lit(False))
        spots = F.filter(F.transform(x, lambda v, i: F.when(v == m, i)), lambda v: v.isNotNull())

        def runs(s: Column) -> Column:
            ends = F.struct(F.filter(s, lambda i: ~here(i - 1)).alias("f"), F.filter(s, lambda i: ~here(i + 1)).alias("l"))
            return let(ends, lambda q: F.flatten(F.transform(q["f"], lambda v, k: F.sequence(v, F.get(q["l"], k), F.lit(2)))))

        def merged(s: Column) -> Column:
            """Ids with the pairs at s (from 0, apart) merged."""
            p = F.transform(x, lambda v: v.bitwiseAND(mask))
            before = lambda p: F.flatten(F.transform(s, lambda i, k: F.concat(F.slice(p, F.when(k > 0, F.get(s, k - 1) + 3).otherwise(1), i - F.when(k > 0, F.get(s, k - 1) + 2).otherwise(0)), F.array(new))))
            return let(p, lambda p: F.concat(before(p), F.slice(p, F.get(s, F.size(s) - 1) + 3, F.size(p))))

        def placed(p: Column) -> Column:
            return F.transform(p, lambda a, i: place(a * radix + F.coalesce(F.get(p, i + 1), F.lit(radix - 1))))

        def decide(s: Column) -> Column:
            passing = F.exists(s, lambda i: F.shiftright(place(new * radix + F.get(x, i + 2).bitwiseAND(mask)), BITS) < new)
            return let(let(merged(s), placed), lambda d: F.when(passing | (F.shiftright(F.array_min(d), BITS) < new), one(x, m)).otherwise(d))

        return let(let(spots, runs), decide)

    def fold(step) -> Column:
        def merge(x: Column, _) -> Column:
            return let(F.array_min(x), lambda m: F.when(m >= (NONE << BITS), x).otherwise(step(x, m)))

        return F.aggregate(F.sequence(F.lit(1), F.size(word) - 2), word, merge)

    done = F.when(F.size(word) <= LONG + 2, fold(one)).otherwise(fold(every))
    return let(done, lambda x: F.transform(F.slice(x, F.lit(2), F.size(x) - 2), lambda v: v.bitwiseAND(mask).cast("int")))


class _Numbered(dict):
    """Words by their number, in order of first use."""

    def __missing__(self, word):
        n = self[word] = len(self)
        return n


def _first_states(byte_ids: np.ndarray, ranks: np.ndarray, end: int, pinned: dict[bytes, int]):
    """Function of words to their first states: ids of bytes with the ranks of neighbours, between two ends."""

    def states(words: list[str]) -> pa.Array:
        raw = [w.encode() for w in words]
        size = np.array([1 if w in pinned else len(w) for w in raw], np.int64) + 2
        stop = np.cumsum(size)
        p = np.full(stop[-1] if len(stop) else 0, -1, np.int64)
        p[stop - 1] = p[stop - size] = end
        inner = p < 0
        letters = np.frombuffer(b"".join(b"\0" if w in pinned else w for w in raw), np.uint8)
        p[inner] = byte_ids[letters]
        rank = np.full(len(p), NONE, np.int64)
        both = np.flatnonzero(inner[:-1] & inner[1:])
        letter = np.zeros(len(p), np.int64)
        letter[inner] = letters
        rank[both] = ranks[letter[both], letter[both + 1]]
        for i in [i for i, w in enumerate(raw) if w in pinned]:
            p[stop[i] - 2] = pinned[raw[i]]
        return pa.ListArray.from_arrays(pa.array(np.r_[0, stop], pa.int32()), pa.array((rank << BITS) + p))

    return states


def _chunks(pattern: str, states, most: int, words_a_task: int):
    """Rows (text, columns) to one row a chunk: first states of words new in the task, numbers of all words, words a row, columns."""

    def row(fresh: bool, new: list[str], codes: list, kept: list) -> pa.RecordBatch:
        inner = states(new)
        counts = np.array([len(c) for c in codes], np.int32)
        out = [pa.array([fresh]), pa.ListArray.from_arrays(pa.array([0, len(new)], pa.int32()), inner), pa.array([np.concatenate([*codes, np.zeros(0, np.int32)]).tobytes()], pa.binary()), pa.array([counts.tobytes()], pa.binary())]
        for c in zip(*kept, strict=True):
            c = pa.concat_arrays(c)
            out.append(pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c))
        return pa.RecordBatch.from_arrays(out, names=["fresh", "words", "codes", "counts", *(f"c{i}" for i in range(len(out) - 4))])

    def run(batches):
        import regex

        find = regex.compile(pattern).findall
        numbers, sent, fresh, codes, kept, held = _Numbered(), 0, True, [], [], 0
        for b in K.small(batches):
            begin = 0
            for i, text in enumerate(b.column(0).to_pylist()):
                if held and held + len(text or "") > most:
                    yield row(fresh, list(islice(numbers, sent, None)), codes, [*kept, [c.slice(begin, i - begin) for c in b.columns[1:]]])
                    sent, fresh, codes, kept, held, begin = len(numbers), False, [], [], 0, i
                    if sent > words_a_task:
                        numbers, sent, fresh = _Numbered(), 0, True
                codes.append(np.array(list(map(numbers.__getitem__, find(text))) if text else [], np.int32))
                held += len(text or "")
            kept.append([c.slice(begin) for c in b.columns[1:]])
        if codes:
            yield row(fresh, list(islice(numbers, sent, None)), codes, kept)

    return run


def _spread(pieces: list[bytes] | None, most: int):
    """Chunks' rows, with the ids of new words, to their documents' rows with ids and, given the pieces, the
    bytes they stand for. A task's chunks come in order; a batch of results has about ``most`` ids."""

    def run(batches):
        join = _joiner(pieces) if pieces else None
        flat, size = np.zeros(0, np.int32), np.zeros(0, np.int32)
        for b in batches:
            for k in range(b.num_rows):
                fresh, words, codes, counts, *kept = (c.slice(k, 1) for c in b.columns)
                words = words.flatten()
                new = (words.flatten().to_numpy(zero_copy_only=False), words.value_lengths().to_numpy(zero_copy_only=False))
                flat, size = new if fresh[0].as_py() else (np.r_[flat, new[0]], np.r_[size, new[1]])
                start = np.cumsum(size, dtype=np.int64) - size
                code = np.frombuffer(codes[0].as_buffer(), np.int32)
                stop = np.r_[0, np.cumsum(np.frombuffer(counts[0].as_buffer(), np.int32), dtype=np.int64)]
                total = np.r_[0, np.cumsum(size[code], dtype=np.int64)][stop]
                kept = [c.flatten() for c in kept]
                i = 0
                while i < len(stop) - 1:
                    j = max(i + 1, min(i + DOCS_A_BATCH, int(np.searchsorted(total, total[i] + most, "right")) - 1))
                    own = code[stop[i] : stop[j]]
                    m = size[own]
                    before = np.r_[0, np.cumsum(m, dtype=np.int64)]
                    at = np.arange(before[-1]) + np.repeat(start[own] - before[:-1], m)
                    lists = pa.ListArray.from_arrays(pa.array(before[stop[i : j + 1] - stop[i]], pa.int32()), pa.array(flat[at], pa.int32()))
                    out = [*(c.slice(i, j - i) for c in kept), lists, *([join(lists)] if join else [])]
                    yield pa.RecordBatch.from_arrays(out, names=[*(f"c{x}" for x in range(len(kept))), "ids", "bytes"][: len(out)])
                    i = j

    return run


def encode(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", chunk_chars: int = CHUNK_CHARS, words_a_task: int = WORDS_A_TASK, keep_text: bool = True, decode_to: str | None = None) -> DataFrame:
    """docs with ``ids``: the token ids of each text; without the text itself, if it need not be carried on.

    With ``decode_to``, also what decoded() makes of them, as the last column, in the same pass.
    """
    text = F.col(text_col).cast("string").alias("_text")
    docs = docs.drop("ids", *([decode_to] if decode_to else []))
    kept = [c for c in docs.columns if keep_text or c != text_col]
    fields = [docs.schema[c] for c in kept]
    byte_ids = np.array([vocabulary.ranks[bytes([i])] for i in range(256)], np.int64)
    ranks = np.array([[vocabulary.ranks.get(bytes([a, b]), NONE) for b in range(256)] for a in range(256)], np.int64)
    states = _first_states(byte_ids, ranks, vocabulary.size, vocabulary.unreachable())
    lists = "".join(f", c{i} array<{f.dataType.simpleString()}>" for i, f in enumerate(fields))
    chunk = _chunks(plain_pattern(vocabulary.pattern), states, chunk_chars, words_a_task)
    words = docs.select(text, *[docs[c].alias(f"c{i}") for i, c in enumerate(kept)]).mapInArrow(chunk, f"fresh boolean, words array<array<bigint>>, codes binary, counts binary{lists}")
    words = words.join(F.broadcast(vocabulary.frame(docs.sparkSession)))
    table = {c: F.col(c) for c in ("entries", "shift")}
    done = words.select("fresh", F.transform("words", lambda w: _ids(w, vocabulary.radix, table)).alias("words"), "codes", "counts", *[f"c{i}" for i in range(len(kept))])
    made = [T.StructField("ids", T.ArrayType(T.IntegerType())), *([T.StructField("bytes", T.BinaryType())] if decode_to else [])]
    out = done.mapInArrow(_spread(vocabulary.by_id() if decode_to else None, IDS_A_BATCH), T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(fields)] + made))
    return out.toDF(*kept, "ids", *([decode_to] if decode_to else []))


def _joiner(pieces: list[bytes]):
    """Function of a list array of ids to the ids' pieces laid one behind the other, null for null."""
    blob = np.frombuffer(b"".join(pieces), np.uint8)
    length = np.array([len(x) for x in pieces], np.int32)
    begin = np.cumsum(length, dtype=np.int64) - length

    def join(lists: pa.ListArray) -> pa.Array:
        n = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        ids = lists.flatten().to_numpy(zero_copy_only=False)
        size = length[ids]
        stop = np.r_[0, np.cumsum(size, dtype=np.int64)]
        at = np.arange(stop[-1]) + np.repeat(begin[ids] - stop[:-1], size)
        offsets = stop[np.r_[0, np.cumsum(n)]]
        out = pa.Array.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(offsets), pa.py_buffer(blob[at])]).cast(pa.binary())
        return pc.if_else(lists.is_valid(), out, pa.scalar(None, pa.binary()))

    return join


def _joined(pieces: list[bytes], most: int):
    """Rows (ids, columns) to the columns and the ids' bytes, about ``most`` ids at a time."""

    def run(batches):
        join = _joiner(pieces)
        for b in batches:
            n = np.nan_to_num(b.column(0).value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            total, i = np.r_[0, np.cumsum(n)], 0
            while i < b.num_rows:
                j = max(i + 1, int(np.searchsorted(total, total[i] + most, "right")) - 1)
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in b.columns[1:]), join(b.column(0).slice(i, j - i))], names=[*b.schema.names[1:], "bytes"])
                i = j

    return run


def decoded(docs: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """docs with the bytes that the ids of a column stand for (null for null), as column ``to``."""
    docs = docs.drop(to)
    fields = [T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema)]
    rows = docs.select(F.col(ids_col).alias("_ids"), *[docs[c].alias(f.name) for c, f in zip(docs.columns, fields, strict=True)])
    return rows.mapInArrow(_joined(vocabulary.by_id(), IDS_A_BATCH), T.StructType([*fields, T.StructField("bytes", T.BinaryType())])).toDF(*docs.columns, to)


def report(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: number of ids, and digests of the ids and of the decoded bytes."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = encode(docs, vocabulary, keep_text=False, decode_to="decoded")
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.btrim(F.to_json("ids"), F.lit("[]")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
