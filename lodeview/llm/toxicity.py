"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word enters as a learned vector of its own and the mean of learned vectors of
its letter triples, so that unseen spellings have meaning. Two gated recurrent
passes, one each way, read a window of words; attention weights pool their
states into one vector and a logistic unit scores it. A document is as toxic as
its most toxic window; windows overlap and cover the whole text.

The network is written and trained in numpy. It learns from a bounded sample of
labelled rows: the MAX_ROWS with the smallest hash of the id, outside the
held-out fold, with at most MAX_WINDOWS windows of a clean one and MAX_TOXIC of a
toxic one, spread evenly over the whole text. A label speaks for a document, so
after some rounds over all windows each toxic document is represented by the
window that scores highest. Labels are noisy: where some toxic documents have a
word that leans to the toxic side by BORNE_OUT or more (in log odds, counted over
the sample), those that have none are left out of the fit. The first entry of a
word's vector is this counted leaning and isn't learned. Scores use the text
alone, and all windows of it. Training is seeded: reruns give the same model.

Defined cases: a null or empty text gets the score of a window without words; a
row without a label or an id teaches nothing; without any labelled row all scores
are 0; rows are scored one by one, so ties and repeated rows don't matter; a null
id isn't held out; further columns are not read, whatever their names; an empty
table gives an empty result.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._vec import U, byte_hashes, mix, pieces, words

WINDOW, STRIDE = 48, 32
MAX_ROWS, MAX_WINDOWS, MAX_TOXIC = 4000, 24, 512
VOCABULARY, TRIPLE_SLOTS = 65_536, 4096
WORD_DIM, TRIPLE_DIM, HIDDEN = 8, 12, 8
FOLDS = 5
#: The least leaning of a word that bears out a document's toxic label.
BORNE_OUT = 1.5

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True

Weights = dict[str, np.ndarray]


def word_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word of each row, distinct word of each word, its hash, its triples' slots, where each one's triples begin)."""
    w = words(data, offsets)
    low = _LOWER[data]
    start, end = w.start.copy(), w.end.copy()
    mark = _PUNCTUATION[low] if len(low) else np.zeros(0, bool)
    for _ in range(8):  # trim marks around the word, if anything but marks remains
        move = (end - start > 1) & mark[start] if len(start) else np.zeros(0, bool)
        start = start + move
        move = (end - start > 1) & mark[end - 1] if len(start) else np.zeros(0, bool)
        end = end - move
    hashes = byte_hashes(low, start, end)
    _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    s, e = start[first], end[first]
    length = e - s
    begins = np.cumsum(length) - length
    owner = np.repeat(np.arange(len(s)), length)
    at = np.arange(len(owner)) - begins[owner] + s[owner]
    if len(at):
        before = np.where(at == s[owner], 1, low[at - 1]).astype(U)
        after = np.where(at == e[owner] - 1, 2, low[np.minimum(at + 1, len(low) - 1)]).astype(U)
        triples = (mix((before << U(16)) | (low[at].astype(U) << U(8)) | after) % U(TRIPLE_SLOTS)).astype(np.int64)
    else:
        triples = np.zeros(0, np.int64)
    return w.first, which.reshape(-1), hashes[first], triples, begins


def slots(vocabulary: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Rows of the word table, 0 for words outside the vocabulary."""
    if not len(vocabulary):
        return np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    return np.where(vocabulary[at] == hashes, at + 1, 0)


def window_starts(n: int) -> list[int]:
    """First words of the windows that cover n words; the last one ends with the text."""
    return [0] if n <= WINDOW else [*range(0, n - WINDOW, STRIDE), n - WINDOW]


def _windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, words) of all windows of all rows."""
    n = np.diff(first)
    count = np.where(n <= WINDOW, 1, -(-(n - WINDOW) // STRIDE) + 1)
    row = np.repeat(np.arange(len(n)), count)
    nth = np.arange(len(row)) - (np.cumsum(count) - count)[row]
    start = np.minimum(nth * STRIDE, np.maximum(n[row] - WINDOW, 0))
    return row, first[:-1][row] + start, np.minimum(n[row], WINDOW)


def fresh_weights(vocabulary: np.ndarray, seed: int = 7) -> Weights:
    rng = np.random.default_rng(seed)
    d, h = WORD_DIM + TRIPLE_DIM, HIDDEN
    make = lambda *shape, by: (rng.standard_normal(shape) * by).astype(np.float32)
    weights = {"word": np.zeros((len(vocabulary) + 1, WORD_DIM), np.float32), "triple": make(TRIPLE_SLOTS, TRIPLE_DIM, by=0.3)}
    for way in "fb":
        weights |= {"x" + way: make(d, 3 * h, by=0.3), "h" + way: make(h, 3 * h, by=0.3), "o" + way: np.zeros(3 * h, np.float32)}
    return weights | {"attend": make(2 * h, by=0.1), "out": make(2 * h, by=0.3), "bias": np.full(1, -2.0, np.float32)}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _inputs(p: Weights, slot: np.ndarray, triples: np.ndarray, begins: np.ndarray) -> np.ndarray:
    if not len(slot):
        return np.zeros((0, WORD_DIM + TRIPLE_DIM), np.float32)
    sums = np.add.reduceat(p["triple"][triples], begins)
    length = np.diff(np.append(begins, len(triples))).astype(np.float32)
    return np.concatenate([p["word"][slot], sums / length[:, None]], 1)


def _pass(gates: np.ndarray, hidden: np.ndarray, ids: np.ndarray, mask: np.ndarray, back: bool, keep: list | None = None) -> np.ndarray:
    """States (steps, windows, HIDDEN) of one direction; ``gates`` are the words' projected inputs."""
    n, steps = ids.shape
    h = np.zeros((n, HIDDEN), np.float32)
    states = np.empty((steps, n, HIDDEN), np.float32)
    for t in range(steps - 1, -1, -1) if back else range(steps):
        x, from_h = gates[ids[:, t]], h @ hidden
        zr = _sigmoid(x[:, : 2 * HIDDEN] + from_h[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        new = np.tanh(x[:, 2 * HIDDEN :] + r * from_h[:, 2 * HIDDEN :])
        m = mask[:, t : t + 1]
        after = np.where(m, new + z * (h - new), h)
        if keep is not None:
            keep.append((t, h, z, r, new, from_h[:, 2 * HIDDEN :]))
        states[t] = h = after
    return states


def _pool(p: Weights, states: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    energy = np.where(mask.T, states @ p["attend"], np.float32(-1e9))
    weight = np.exp(energy - energy.max(0)) * mask.T
    weight = weight / np.maximum(weight.sum(0), 1e-9)
    pooled = np.einsum("tn,tnh->nh", weight, states)
    return weight, pooled, pooled @ p["out"] + p["bias"][0]


def logits(p: Weights, x: np.ndarray, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Scores before the logistic of windows, from distinct words' inputs."""
    if not len(x):
        return np.full(len(ids), p["bias"][0], np.float32)
    states = np.concatenate([_pass(x @ p["x" + w] + p["o" + w], p["h" + w], ids, mask, w == "b") for w in "fb"], 2)
    return _pool(p, states, mask)[2]


def _gradients(p: Weights, slot: np.ndarray, triples: np.ndarray, begins: np.ndarray, ids: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Weights:
    """Gradients of the weighted log loss over some windows, by back-propagation through time."""
    h = HIDDEN
    x = _inputs(p, slot, triples, begins)
    kept: dict[str, list] = {"f": [], "b": []}
    both = [_pass(x @ p["x" + w] + p["o" + w], p["h" + w], ids, mask, w == "b", kept[w]) for w in "fb"]
    states = np.concatenate(both, 2)
    alpha, pooled, score = _pool(p, states, mask)
    d_score = ((_sigmoid(score) - y) * weight / weight.sum()).astype(np.float32)
    g = {"out": pooled.T @ d_score, "bias": d_score.sum(keepdims=True)}
    d_pooled = d_score[:, None] * p["out"]
    d_alpha = np.einsum("nh,tnh->tn", d_pooled, states)
    d_energy = alpha * (d_alpha - (alpha * d_alpha).sum(0))
    g["attend"] = np.einsum("tn,tnh->h", d_energy, states)
    d_states = alpha[:, :, None] * d_pooled + d_energy[:, :, None] * p["attend"]
    d_x = np.zeros_like(x)
    for i, way in enumerate("fb"):
        hidden, d_hidden = p["h" + way], np.zeros_like(p["h" + way])
        d_steps = np.empty((ids.shape[1], len(ids), 3 * h), np.float32)
        carry = np.zeros((len(ids), h), np.float32)
        for t, before, z, r, new, from_n in reversed(kept[way]):
            d = (carry + d_states[t][:, i * h : (i + 1) * h]) * mask[:, t : t + 1]
            through = carry * ~mask[:, t : t + 1]
            d_new = d * (1 - z) * (1 - new * new)
            d_z = d * (before - new) * z * (1 - z)
            d_r = d_new * from_n * r * (1 - r)
            d_in = np.concatenate([d_z, d_r, d_new], 1)
            d_from = np.concatenate([d_z, d_r, d_new * r], 1)
            d_hidden += before.T @ d_from
            carry = through + d * z + d_from @ hidden.T
            d_steps[t] = d_in
        flat = ids.T.reshape(-1)
        d_gate = np.stack([np.bincount(flat, d_steps[:, :, j].reshape(-1), len(x)) for j in range(3 * h)], 1).astype(np.float32)
        g["h" + way] = d_hidden
        g["x" + way] = x.T @ d_gate
        g["o" + way] = d_gate.sum(0)
        d_x += d_gate @ p["x" + way].T
    g["word"] = np.stack([np.bincount(slot, d_x[:, j], len(p["word"])) for j in range(WORD_DIM)], 1).astype(np.float32)
    g["word"][0] = 0
    length = np.diff(np.append(begins, len(triples)))
    spread = np.repeat(d_x[:, WORD_DIM:] / length[:, None], length, axis=0)
    g["triple"] = np.stack([np.bincount(triples, spread[:, j], TRIPLE_SLOTS) for j in range(TRIPLE_DIM)], 1).astype(np.float32)
    return g


def _table(texts: list[str]) -> tuple:
    """Windows of texts of one window each: features, word ids and masks."""
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in raw])])
    first, which, slot, triples, begins = word_features(np.frombuffer(b"".join(raw), np.uint8), offsets)
    n = np.minimum(np.diff(first), WINDOW)
    mask = np.arange(WINDOW) < n[:, None]
    at = np.minimum(first[:-1, None] + np.arange(WINDOW), max(0, len(which) - 1))
    return slot, triples, begins, which[at] if len(which) else np.zeros_like(at), mask


def vocabulary_of(hashes: np.ndarray, ids: np.ndarray, mask: np.ndarray, y: np.ndarray, smooth: float = 4.0, trust: float = 8.0, least: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes of words met in ``least`` contexts or more, the VOCABULARY most frequent at most; how each leans).

    A context is the word with its two neighbours; copies of a text add none, so a family of copies doesn't count
    as many witnesses. It is toxic if no clean document has it. A leaning is the log odds of a word's contexts
    against the base rate, smoothed, and shrunk where the contexts are few.
    """
    if not len(hashes):
        return np.zeros(0, U), np.zeros(0, np.float32)
    inner = np.pad(np.where(mask, hashes[ids], U(0)), ((0, 0), (1, 1)))
    key = mix(inner[:, :-2] * U(3) + mix(inner[:, 1:-1] + mix(inner[:, 2:])))[mask]
    word, label = ids[mask], np.broadcast_to(y[:, None], mask.shape)[mask]
    order = np.lexsort((label, key))
    begin = order[np.append(True, key[order][1:] != key[order][:-1])]
    word, label = word[begin], label[begin] == 1
    one, zero = (np.bincount(word[of], minlength=len(hashes)) for of in (label, ~label))
    often = np.flatnonzero(one + zero >= least)
    often = often[np.lexsort((hashes[often], -(one + zero)[often]))][:VOCABULARY]
    often = often[np.argsort(hashes[often])]
    base = np.clip(label.mean(), 0.01, 0.99)
    odds = np.log((one + smooth * base) / (zero + smooth * (1 - base))) - np.log(base / (1 - base))
    return hashes[often], (odds * np.minimum(1.0, (one + zero) / trust)).astype(np.float32)[often]


def train(
    texts: list[str], document: np.ndarray, y: np.ndarray, *, epochs: int = 8, least_steps: int = 320, batch: int = 256, rate: float = 0.02, decay: float = 1e-3, negatives: int = 6, seed: int = 7
) -> Weights | None:
    """Fit to windows; ``document`` numbers each window's document, ``y`` is that document's label.

    Each round takes the strongest window of a toxic document (by its words' leanings at first, then by the
    network) and a few windows at random of each other document.
    """
    if not len(texts):
        return None
    rng = np.random.default_rng(seed)
    hashes, triples, begins, ids, mask = _table(texts)
    bounds = np.append(begins, len(triples))
    vocabulary, lean = vocabulary_of(hashes, ids, mask, y)
    slot = slots(vocabulary, hashes)
    p = fresh_weights(vocabulary, seed)
    p["word"][1:, 0] = lean
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    toxic, clean = np.flatnonzero(y == 1), np.flatnonzero(y != 1)
    lean_of = np.where(mask[toxic], p["word"][slot[ids[toxic]], 0], -9).max(1) if len(toxic) and len(slot) else np.zeros(len(toxic))
    borne_out = np.unique(document[toxic][lean_of >= BORNE_OUT])
    if len(borne_out):  # a toxic label that no word of the document bears out is taken for noise
        bears = np.isin(document[toxic], borne_out)
        toxic, lean_of = toxic[bears], lean_of[bears]
    step = 0
    per_round = -(-(len(np.unique(document[toxic])) + min(len(clean), negatives * len(np.unique(document[clean])))) // batch)
    epochs = max(epochs, -(-least_steps // max(1, per_round)))
    warm = epochs // 4
    for epoch in range(epochs):
        if epoch < warm:
            strength = lean_of
        else:
            x = _inputs(p, slot, triples, begins)
            strength = np.concatenate([np.zeros(0)] + [logits(p, x, ids[toxic[i : i + 4096]], mask[toxic[i : i + 4096]]) for i in range(0, len(toxic), 4096)])
        best = _first(document[toxic], -strength, 1)
        chosen = np.concatenate([toxic[best], clean[_first(document[clean], rng.random(len(clean)), negatives)]])
        rng.shuffle(chosen)
        for i in range(0, len(chosen), batch):
            take = chosen[i : i + batch]
            used, local = np.unique(ids[take], return_inverse=True)
            lengths = bounds[used + 1] - bounds[used] if len(slot) else np.zeros(0, np.int64)
            if not lengths.sum():
                continue
            starts = np.cumsum(lengths) - lengths
            flat = np.arange(lengths.sum()) - np.repeat(starts, lengths) + np.repeat(bounds[used], lengths)
            g = _gradients(p, slot[used], triples[flat], starts, local.reshape(len(take), -1), mask[take], y[take].astype(np.float32), np.ones(len(take), np.float32))
            g["word"][:, 0] = 0  # leanings are counted, not learned
            step += 1
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            by = min(1.0, 1.0 / max(norm, 1e-9))
            for k, v in g.items():
                m, s = moments[k]
                v = v * by
                m += 0.1 * (v - m)
                s += 0.001 * (v * v - s)
                change = m / (1 - 0.9**step) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
                if k == "word":
                    change[:, 1:] += decay / rate * p[k][:, 1:]
                p[k] = p[k] - rate * change
        rate *= 0.1 ** (1 / epochs)
    return {k: v.astype(np.float32) for k, v in p.items()} | {"vocabulary": vocabulary}


def _first(group: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Places of the n smallest values of each group."""
    order = np.lexsort((value, group))
    ordered = group[order]
    begin = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(order) else np.zeros(0, np.int64)
    rank = np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order))))
    return order[rank < n]


def held_out(id_: F.Column) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(id_.cast("string")), F.lit(FOLDS)) == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """At most MAX_ROWS labelled rows as windows, MAX_WINDOWS of a clean and MAX_TOXIC of a toxic one at most: (id, y, start, text)."""
    rows = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("id IS NOT NULL AND y IS NOT NULL").filter(~held_out(F.col("id")))
    rows = rows.orderBy(F.xxhash64("id"), "id", "y").limit(MAX_ROWS)  # the documented bound of the fit
    joined = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("text")).join(F.broadcast(rows), F.col("i") == F.col("id")).select("id", "y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 100):
                out = []
                for i, y, text in zip(*(c.to_pylist() for c in batch.slice(begin, 100).columns), strict=True):
                    raw = (text or "").encode().split()
                    starts = window_starts(len(raw))
                    most = MAX_TOXIC if y == 1 else MAX_WINDOWS
                    if len(starts) > most:
                        starts = [starts[k * (len(starts) - 1) // (most - 1)] for k in range(most)]
                    out += [(i, y, s, b" ".join(raw[s : s + WINDOW]).decode()) for s in starts]
                columns = list(zip(*out, strict=True)) or [[]] * 4
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["id", "y", "start", "text"])

    return joined.withColumn("id", F.col("id").cast("long")).mapInArrow(run, "id long, y int, start long, text string")


def fit(windows: DataFrame) -> Weights | None:
    """Train in one task on the bounded sample; its weights come to the driver as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r["id"], r["start"], r["text"], r["y"]) for batch in batches for r in batch.to_pylist())
        if rows:
            ids, _, texts, y = zip(*rows, strict=True)
            _, document = np.unique(np.array(ids), return_inverse=True)
            out = io.BytesIO()
            np.savez(out, **train(list(texts), document, np.array(y)))
            yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], ["model"])

    found = windows.repartition(1).mapInArrow(run, "model binary").collect()
    if not found:
        return None
    with np.load(io.BytesIO(found[0]["model"])) as held:
        return {k: held[k] for k in held.files}


def score_texts(p: Weights | None, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The highest window score of each row."""
    rows = len(offsets) - 1
    if p is None:
        return np.zeros(rows)
    first, which, hashes, triples, begins = word_features(data, offsets)
    x = _inputs(p, slots(p["vocabulary"], hashes), triples, begins)
    row, start, n = _windows(first)
    best = np.full(rows, -np.inf)
    for i in range(0, len(row), 4096):
        r, s, k = row[i : i + 4096], start[i : i + 4096], n[i : i + 4096]
        width = max(1, int(k.max()))
        mask = np.arange(width) < k[:, None]
        at = np.minimum(s[:, None] + np.arange(width), max(0, len(which) - 1))
        ids = which[at] if len(which) else np.zeros_like(at)
        np.maximum.at(best, r, logits(p, x, ids, mask))
    return _sigmoid(best.astype(np.float64))


def score(docs: DataFrame, model: Weights | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row; the model goes to the executors once, as a broadcast of fixed size."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(score_texts(shared.value, data, offsets))], ["id", "score"])

    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = chosen.schema["id"].dataType.simpleString()
    return chosen.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def report(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(id, held_out, score, predicted) for every row of ``docs``."""
    model = fit(sample(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col))
    scored = score(docs, model, id_col=id_col, text_col=text_col)
    return scored.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
