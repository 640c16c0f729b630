"""Packing token streams into fixed sequences, sources mixed by deficit round-robin.

Each source is a queue of its documents' tokens. Windows of ``window`` sequences
are served in turn; in each, every queue that still has tokens earns its share of
the window by weight and pays in whole tokens, and what it could not pay out (a
fraction of a token) is its deficit for the next window. Weights are given by
source (1 where not); without any, a queue weighs as many tokens as it has, so
all windows have the proportions of the whole. When a queue is empty, the rest
share the windows by their weights.

With T_s tokens of weight w_s in queue s, the queues have paid min(T_s, floor(w_s L))
tokens by the end of a window, where the level L solves sum(min(T_s, w_s L)) =
tokens up to there. L is piecewise linear with a break where a queue ends, so any
task can compute the place of any token from its position in its queue: the
deficits cross windows and partitions with no task waiting for another.

Two passes over stored data: one tokenises, keeps ids (two bytes each where the
vocabulary allows) and counts tokens by task and queue; prefix sums over these
counts give each task its queues' starts; the second cuts the pieces. Sequences
are consecutive, so all but the last are full.

Defined cases: a null or empty text is the end id alone; a null source is a
queue of its own; sources that the weights name have queues of their own, the
others too as long as there are ``queues`` of them at most, else they share that
many by hash, which bounds what the driver and every task hold; repeated rows are
packed as often as they come; further columns are not read, whatever their names;
an empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import materialize
from ._vec import pieces

QUEUES = 4096
_CACHE = 300_000
# The pattern that cuts text before byte-level merging, and the printable character that stands for each byte in vocabulary files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_OF = {chr(b): b for b in _SHOWN} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}
_RAGGED = re.compile(r" \s").search
_CHUNKS = re.compile(r"\s*\S+|\s+$").findall


class _Known(dict):
    """Ids of chunks, found once."""

    def __init__(self, find: Callable[[str], bytes]):
        self.find = find

    def __missing__(self, chunk: str) -> bytes:
        self[chunk] = got = self.find(chunk)
        return got


class Encoder:
    """Token ids of texts, as bytes, with a bounded memory of chunks met before.

    Ids are those that ``tokenizers`` gives for the vocabulary file. Byte-level
    BPE never merges across the start of white space before a word, so a text is
    the concatenation of its chunks, each a word with the white space before it,
    and a chunk's ids don't depend on its neighbours. Chunks not met before are
    merged by ``tiktoken`` over the ranks read from the same file, at a fraction
    of the cost; the first texts are encoded by both and must agree.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # such strings in a text are ordinary text
        size = self.tokenizer.get_vocab_size()
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        ranks = {bytes(map(_BYTE_OF.__getitem__, token)): i for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if all(c in _BYTE_OF for c in token)}
        merge = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        code = "H" if self.kind.itemsize == 2 else "I"
        self.spaced = _Known(lambda chunk: array(code, merge(" " + chunk)).tobytes())
        self.plain = _Known(lambda chunk: array(code, merge(chunk)).tobytes())
        self.unchecked = 20

    def encode(self, texts: list[str]) -> list[bytes]:
        for known in (self.spaced, self.plain):
            if len(known) > _CACHE:
                known.clear()
        spaced, plain, out = self.spaced.__getitem__, self.plain.__getitem__, []
        for text in texts:
            if _RAGGED(text):
                out.append(b"".join(map(plain, _CHUNKS(text))))
            else:
                first, *rest = text.split(" ")
                out.append(plain(first) + b"".join(map(spaced, rest)))
        for text, ids in zip(texts[: self.unchecked], out, strict=False):
            if np.frombuffer(ids, self.kind).tolist() != self.tokenizer.encode(text, add_special_tokens=False).ids:
                raise ValueError("the vocabulary file is not a byte-level BPE with this pattern")
            self.unchecked -= 1
        return out


def _name(source: str | None) -> str:
    return "n" if source is None else "s" + source


def tokenised(docs: DataFrame, tokenizer: str, *, id_col: str, text_col: str, source_col: str, end_id: int, own: list[str], queues: int) -> DataFrame:
    """Stored (id, queue, part, begin, n, ids): ``begin`` counts the queue's tokens before it in its task."""
    queue = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n"))
    many = docs.select(queue.alias("q")).filter(~F.col("q").isin(own)).distinct().limit(queues + 1).count() > queues
    queue = F.when(queue.isin(own), queue).otherwise(F.pmod(F.xxhash64(queue), F.lit(queues)).cast("string")) if many else queue

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encoder, begun = TaskContext.get().partitionId(), Encoder(tokenizer), {}
        end = np.array([end_id], encoder.kind).tobytes()
        for rows, _, _ in pieces(batches, "text"):
            queues = rows.column(1).to_pylist()
            ids = [x + end for x in encoder.encode([t or "" for t in rows.column(2).to_pylist()])]
            n = [len(x) // encoder.kind.itemsize for x in ids]
            begins = []
            for q, k in zip(queues, n, strict=True):
                begins.append(begun.get(q, 0))
                begun[q] = begins[-1] + k
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), pa.array([part] * len(n), pa.int32()), pa.array(begins, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())],
                ["id", "queue", "part", "begin", "n", "ids"],
            )

    chosen = docs.select(F.col(id_col).alias("id"), queue.alias("queue"), F.col(text_col).alias("text"))
    kind = chosen.schema["id"].dataType.simpleString()
    return materialize(chosen.mapInArrow(run, f"id {kind}, queue string, part int, begin long, n long, ids binary"), "tokens")


class Rounds:
    """Places of queue tokens in the packed stream, from the queues' totals and weights."""

    def __init__(self, totals: list[int], window: int, weights: list[float] | None = None):
        self.totals, self.window_tokens, self.total = np.array(totals, np.int64), window, int(sum(totals))
        self.windows = max(1, -(-self.total // window))
        self.weights = np.array(totals if weights is None else weights, np.float64)
        ends = self.totals / self.weights
        order = np.argsort(ends, kind="stable")
        # breaks: the levels at which queues end, the tokens paid by then, and the weight served from there on
        self.levels = np.concatenate([[0.0], ends[order]])
        self.served = np.concatenate([np.cumsum(self.weights[order][::-1])[::-1], [0.0]])
        self.tokens = np.concatenate([[0.0], np.cumsum(np.diff(self.levels) * self.served[:-1])])
        self.cache: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def paid(self, w: int) -> np.ndarray:
        """Tokens that each queue has paid before window w."""
        if w >= self.windows:
            return self.totals
        y = float(w * self.window_tokens)
        i = min(int(np.searchsorted(self.tokens, y, "right")) - 1, len(self.levels) - 2)
        level = min(self.levels[i] + max(0.0, y - self.tokens[i]) / self.served[i], self.levels[i + 1])
        return np.minimum(self.totals, np.floor(self.weights * level).astype(np.int64))

    def window(self, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Paid before, paid after, and where each queue's part begins in the stream."""
        if w not in self.cache:
            if len(self.cache) > 256:
                self.cache.clear()
            a, b = self.paid(w), self.paid(w + 1)
            self.cache[w] = a, b, int(a.sum()) + np.cumsum(b - a) - (b - a)
        return self.cache[w]

    def places(self, queue: int, x: int, n: int) -> Iterator[tuple[int, int]]:
        """(place, length) runs of the n tokens from position x of a queue."""
        y = float(np.interp(x / self.weights[queue], self.levels, self.tokens))
        w = min(self.windows - 1, int(y // self.window_tokens))
        while n:
            a, b, at = self.window(w)
            if x < a[queue]:
                w -= 1
            elif x >= b[queue]:
                w += 1
            else:
                k = min(n, int(b[queue]) - x)
                yield int(at[queue]) + x - int(a[queue]), k
                x, n = x + k, n - k


def pack(
    docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    sequence: int = 1024, window: int = 64, end_id: int = 0, with_ids: bool = False, weights: Mapping[str | None, float] | None = None, queues: int = QUEUES,
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    ``weights`` are the target proportions of sources in a window, above 0; None keeps those of all tokens.
    """
    own = {_name(source): float(w) for source, w in (weights or {}).items()}
    if any(w <= 0 for w in own.values()):
        raise ValueError("weights are above 0")
    tokens = tokenised(docs, tokenizer, id_col=id_col, text_col=text_col, source_col=source_col, end_id=end_id, own=list(own), queues=queues)
    by_part = tokens.groupBy("part", "queue").agg(F.sum("n").alias("n"))
    earlier = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = materialize(by_part.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0).cast("long"))), "queue-begins")
    totals = {r["queue"]: r["n"] for r in begins.groupBy("queue").agg(F.sum("n").alias("n")).orderBy("queue").collect()}  # ``queues`` and the weights' own at most exist
    number, sums = {q: i for i, q in enumerate(totals)}, list(totals.values())
    shares = None if weights is None else [own.get(q, 1.0) for q in totals]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rounds = Rounds(sums, window * sequence, shares)
        for batch in batches:
            for begin in range(0, batch.num_rows, 1000):
                yield from _cut(batch.slice(begin, 1000), rounds, number, sequence, with_ids)

    placed = tokens.join(begins.drop("n"), ["part", "queue"]).select("id", "queue", (F.col("base") + F.col("begin")).alias("x"), "n", "ids")
    kind = placed.schema["id"].dataType.simpleString()
    ids = ", ids array<int>" if with_ids else ""
    out = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long{ids}"
    return placed.mapInArrow(cut, out).withColumnRenamed("id", id_col)


def _cut(batch: pa.RecordBatch, rounds: Rounds, number: dict[str, int], sequence: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    rows, numbers, arrays = [], [], []
    queues, xs, ns, data = (batch.column(i).to_pylist() for i in range(1, 5))
    for i, (q, x, n, raw) in enumerate(zip(queues, xs, ns, data, strict=True)):
        ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4")
        start = 0
        for place, k in rounds.places(number[q], x, n):
            while k:
                m = min(k, sequence - place % sequence)
                part = ids[start : start + m]
                rows.append(i)
                numbers.append((start, m, zlib.crc32(part.tobytes()), n, place // sequence, place % sequence))
                if with_ids:
                    arrays.append(part)
                start, place, k = start + m, place + m, k - m
    table = np.array(numbers, np.int64).reshape(-1, 6)
    columns = [batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(np.ascontiguousarray(table[:, j])) for j in range(6))]
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    if with_ids:
        lengths = np.concatenate([[0], np.cumsum(table[:, 1])]).astype(np.int32)
        flat = np.concatenate([np.zeros(0, "<u4"), *arrays]).astype(np.int32)
        columns.append(pa.ListArray.from_arrays(pa.array(lengths), pa.array(flat)))
        names.append("ids")
    yield pa.RecordBatch.from_arrays(columns, names)
