"""Packing documents into token windows by non-negative least squares.

Inside one task, documents are tokenized and gathered into a block of bounded size. Of
each document the full windows are cut off; the rests make a histogram of lengths. All
shallow combinations of length classes that fill a window are enumerated, non-negative
least squares solves how often each is used, the counts are rounded, and the documents are
dealt to the combinations, the last place of each going to the longest rest that fits.
What stays over is packed greedily (best fit, cut where nothing fits).

Blocks never exchange rows: the plan is one scan without a shuffle, and a lost executor
repeats its own tasks only.
"""

from __future__ import annotations

import os
import re
from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import give_back_memory

#: Tokens gathered before a block is packed; 4 bytes each.
BLOCK_TOKENS = 3_000_000
#: Chunks tokenized as one text.
GROUP = 250
#: Letters a-z and digits as ``a``, full stops and commas as ``.``, white space as a space, all else as ``p``.
CHARACTER_KINDS = bytes(
    97 if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789" else 46 if c in b".," else 32 if c in b" \t\n\v\f\r" else 112
    for c in range(256)
)
#: A full stop or comma that ends a word.
LONE_MARK = re.compile(rb"(?<=[a-z0-9])([.,])(?=[\x20\x09-\x0D])")
#: A gap of fewer tokens is padded rather than filled with a cut piece.
MIN_CUT = 32
#: The last window of a block is split at powers of two down to this one.
MIN_POWER = 256


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by accelerated projected gradients with restarts."""
    x = np.zeros(a.shape[1])
    if not a.size or not b.any():
        return x
    gram, rhs = a.T @ a, a.T @ b
    step = 1.0 / max(np.linalg.norm(a @ a.T, 2), 1e-12)
    y, t = x, 1.0
    for _ in range(rounds):
        new = np.maximum(0.0, y - step * (gram @ y - rhs))
        if (y - new) @ (new - x) > 0:
            y, t = x, 1.0
            continue
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t2 * (new - x)
        if np.abs(new - x).max() <= 1e-6 * max(1.0, new.max()):
            return new
        x, t = new, t2
    return x


@lru_cache(maxsize=8)
def combinations(classes: int, depth: int) -> tuple[tuple[int, ...], ...]:
    """Non-increasing tuples of at most ``depth`` classes 1..classes that add up to ``classes``."""
    out = []

    def grow(left: int, most: int, got: tuple[int, ...]) -> None:
        if left == 0:
            out.append(got)
        elif len(got) < depth:
            for c in range(min(left, most), 0, -1):
                if c * (depth - len(got)) < left:
                    break
                grow(left - c, c, (*got, c))

    grow(classes, classes, ())
    return tuple(out)


@lru_cache(maxsize=8)
def _matrix(classes: int, depth: int) -> np.ndarray:
    combos = combinations(classes, depth)
    a = np.zeros((classes, len(combos)))
    for j, combo in enumerate(combos):
        for c in combo:
            a[c - 1, j] += 1
    return a


def plan_block(lengths: list[int], window: int, depth: int = 3, classes: int = 64) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces ``(document index, start, length)`` that hold every token once."""
    out: list[list[tuple[int, int, int]]] = []
    rests: list[tuple[int, int]] = []  # (length, index), sorted
    begin = {}
    for i, n in enumerate(lengths):
        full = n // window
        out += [[(i, k * window, window)] for k in range(full)]
        if n % window:
            begin[i] = full * window
            rests.append((n % window, i))
    rests.sort()
    if not rests:
        return out
    unit = max(1, -(-window // classes))
    size = lambda n: -(-n // unit)
    hist = np.bincount([size(n) for n, _ in rests], minlength=classes + 1)[1 : classes + 1].astype(float)
    combos = combinations(classes, depth)
    repeats = np.floor(nnls(_matrix(classes, depth), hist) + 0.5).astype(int)

    def take_class(c: int) -> tuple[int, int] | None:
        k = bisect_right(rests, (min(c * unit, window), len(lengths)))
        return rests.pop(k - 1) if k and size(rests[k - 1][0]) == c else None

    def take_fitting(room: int) -> tuple[int, int] | None:
        k = bisect_right(rests, (room, len(lengths)))
        return rests.pop(k - 1) if k else None

    for j in sorted(np.flatnonzero(repeats), key=lambda j: combos[j]):
        for _ in range(repeats[j]):
            got, room = [], window
            for c in combos[j][:-1]:
                if (r := take_class(c)) is None:
                    break
                got.append(r)
                room -= r[0]
            else:
                if (r := take_fitting(room)) is not None and size(r[0]) >= combos[j][-1] - 1:
                    out.append([(i, begin[i], n) for n, i in [*got, r]])
                    continue
                if r is not None:
                    got.append(r)
            for r in got:
                insort(rests, r)
            break
    # residuals: longest first, best fit, and a cut where nothing fits
    tail: list[tuple[int, int, int]] = []
    while rests:
        n, i = rests.pop()
        seq, room = [(i, begin[i], n)], window - n
        while room:
            r = take_fitting(room)
            if r is None:
                if not rests or room < MIN_CUT:
                    break
                n, i = rests.pop()
                seq.append((i, begin[i], room))
                begin[i] += room
                insort(rests, (n - room, i))
                room = 0
            else:
                seq.append((r[1], begin[r[1]], r[0]))
                room -= r[0]
        if room >= MIN_CUT and not rests:
            tail = seq
        else:
            out.append(seq)
    return out + _powers(tail)


def _powers(seq: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """The last, part-filled window, as windows of powers of two and one rest."""
    left, out = sum(n for *_, n in seq), []
    seq = list(seq)
    while left:
        want = 1 << (left.bit_length() - 1)
        want = left if want < MIN_POWER else want
        left -= want
        out.append([])
        while want:
            i, at, n = seq.pop(0)
            if n > want:
                seq.insert(0, (i, at + want, n - want))
            out[-1].append((i, at, min(n, want)))
            want -= min(n, want)
    return out


class ChunkTokenizer:
    """Little-endian uint32 ids of texts, remembered by white-space separated chunk.

    For tokenizers that lower-case, drop white space and never join across it (as the
    pre-tokenizer of ``word_bpe_49k.json``), the ids of a text are its chunks' ids one after
    another. Chunks repeat more often for two rewrites that leave the ids as they are: A-Z
    is lower-cased, and a full stop or comma between a letter a-z or digit and white space
    becomes a chunk of its own (it is one to the pre-tokenizer). Texts with combining marks,
    which could compose with a letter of one case only, or with ``<|``, which may begin a
    special token, are not rewritten. Chunks are tokenized many at a time, apart by ``MARK``, whose one id occurs
    in no other chunk.
    """

    MARK = "\x01"

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.known: dict[bytes, bytes] = {}
        self.most = 1_000_000
        (self.mark,) = self.tokenizer.encode(self.MARK, add_special_tokens=False).ids

    def one(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    @staticmethod
    def chunks(text: str) -> list[bytes]:
        raw = text.encode("utf-8", "replace")
        if b"\xcc" in raw or b"\xcd" in raw or b"<|" in raw:
            return raw.split()
        raw = raw.lower() + b"\n"
        kinds = raw.translate(CHARACTER_KINDS)
        if b"p. " in kinds or b".. " in kinds:
            return LONE_MARK.sub(rb" \1", raw).split()
        for mark in (b". ", b", ", b".\n", b",\n"):
            raw = raw.replace(mark, b" " + mark)
        return raw.split()

    def learn(self, fresh: list[bytes]) -> None:
        known, mark = self.known, self.MARK.encode()
        for w in [w for w in fresh if mark in w]:
            known[w] = self.one(w.decode())
        fresh = [w for w in fresh if w not in known]
        for k in range(0, len(fresh), 20_000):
            part = [fresh[i : i + GROUP] for i in range(k, min(k + 20_000, len(fresh)), GROUP)]
            texts = [b" \x01 ".join(words).decode() for words in part]
            got = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            for words, e in zip(part, got, strict=True):
                ids = np.array(e.ids, "<u4")
                data = ids.tobytes()
                ends = (4 * np.flatnonzero(ids == self.mark)).tolist()
                cuts = map(slice, [0, *(x + 4 for x in ends)], [*ends, len(data)])
                known.update(zip(words, map(data.__getitem__, cuts), strict=True))

    def __call__(self, texts: list[str]) -> list[bytes]:
        split = [self.chunks(t) for t in texts]
        here = set().union(*split)
        if len(self.known) > self.most:
            self.known = {w: self.known[w] for w in here & self.known.keys()}
        self.learn(list(here - self.known.keys()))
        known = self.known
        return [b"".join(map(known.__getitem__, words)) for words in split]


_TOKENIZERS: dict[str, ChunkTokenizer] = {}


def worker_tokenizer(spec: str) -> ChunkTokenizer:
    """One tokenizer a Python worker, kept across tasks."""
    if spec not in _TOKENIZERS:
        # the executor's other tasks use the other cores; threads would keep memory of their own
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _TOKENIZERS.clear()
        _TOKENIZERS[spec] = ChunkTokenizer(spec)
    return _TOKENIZERS[spec]


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    window: int = 4096,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    depth: int = 3,
    cache_chunks: int = 1_000_000,
    batch_chars: int = 8_000_000,
    keep: bool = True,
) -> DataFrame:
    """One row per piece: ``(doc_id, start, length, ids, doc_tokens, sequence_id, offset, sequence_tokens)``.

    ``ids`` holds the piece's token ids as little-endian uint32; ``end_id`` ends every
    document. Each id of a document lies in exactly one piece, pieces of a sequence follow
    each other without a gap, and no sequence exceeds ``window``. A sequence shorter than
    the window is to be padded unless its length is a power of two.

    Null text: empty, one piece with ``end_id`` alone. Rows that repeat a document id are
    packed separately. Texts longer than a window are cut. Other columns are ignored. No
    rows: no rows. ``sequence_id`` is unique; it depends on how the input is split.

    A worker remembers the ids of ``cache_chunks`` chunks (about 200 bytes each) and splits
    ``batch_chars`` characters at once (about 10 bytes each); fewer cost time, not results.
    With ``keep`` false it forgets the tokenizer and the chunks when a task ends.
    The tokenizer file is read on the driver and sent to the workers as it is (a few MB,
    whatever the input).
    """
    import pyarrow as pa

    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = T.StructType(
        [
            T.StructField("doc_id", d.schema["doc_id"].dataType),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids", T.BinaryType()),
            T.StructField("doc_tokens", T.LongType()),
            T.StructField("sequence_id", T.LongType()),
            T.StructField("offset", T.LongType()),
            T.StructField("sequence_tokens", T.LongType()),
        ]
    )
    ending = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        worker_tokenizer(spec.value).most = cache_chunks
        ids_type = None
        number = count(TaskContext.get().partitionId() << 36)
        ids: list = []
        data: list[bytes] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows: list[list] = [[] for _ in schema]
            lengths = [len(x) // 4 for x in data]
            size = 0
            for seq in plan_block(lengths, window, depth):
                n, at, total = next(number), 0, sum(x[2] for x in seq)
                for i, start, length in seq:
                    values = (
                        ids[i], start, length, data[i][4 * start : 4 * (start + length)], lengths[i], n, at, total,
                    )
                    for r, v in zip(rows, values, strict=True):
                        r.append(v)
                    at += length
                size += total
                if size >= 500_000:
                    yield batch(rows)
                    rows, size = [[] for _ in schema], 0
            if rows[0]:
                yield batch(rows)

        def batch(rows: list[list]) -> pa.RecordBatch:
            kinds = [ids_type, *[pa.int64()] * 2, pa.binary(), *[pa.int64()] * 4]
            return pa.RecordBatch.from_arrays(
                [pa.array(r, k) for r, k in zip(rows, kinds, strict=True)], names=schema.names
            )

        waiting: list[str] = []

        def tokenize() -> None:
            nonlocal held
            data.extend(x + ending for x in worker_tokenizer(spec.value)(waiting))
            held += sum(len(x) // 4 for x in data[-len(waiting) :])
            waiting.clear()

        for b in batches:
            ids_type = b.schema.field(0).type
            chars = 0
            for i, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids.append(i)
                waiting.append(text.as_py() or "")
                chars += len(waiting[-1])
                if chars >= batch_chars:
                    tokenize()
                    chars = 0
                    if held >= BLOCK_TOKENS:
                        yield from flush()
                        ids.clear()
                        data.clear()
                        held = 0
            if waiting:
                tokenize()
        if data:
            yield from flush()
        if not keep:
            ids.clear()
            data.clear()
            _TOKENIZERS.clear()
            give_back_memory()

    return d.mapInArrow(run, schema)


def digest(pieces: DataFrame) -> DataFrame:
    """The digest columns of the packing query."""
    return pieces.select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
        "sequence_tokens",
    )
