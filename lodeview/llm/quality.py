"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document, in one pass over the text's bytes;
the ledger stores the measurements and one bit per failed rule. Policies are
versioned masks over these bits, applied to the ledger without reading a text
again, and the effect of leaving a rule out is a bitwise aggregation.

Defined cases: a null or empty text has no words, and zero for every
measurement; it fails ``few_words``. Rows are judged one by one, so ties and
repeated rows don't matter; other columns pass through ``keep`` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import unused
from ._vec import Runs, U, byte_hashes, mix, pieces, salt, same_row, words

#: The characters counted as symbols.
SYMBOLS = "#*$%&|<>"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper_words")


@dataclass(frozen=True)
class Rule:
    """A named test on the measurements, in SQL, true where the document fails."""

    name: str
    fails: str


#: Bit i is RULES[i]; rules are only ever appended, so that stored ledgers stay valid.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeats_itself", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbol_heavy", "4 * n_symbols > n_words"),
    Rule("repeated_lines", "n_lines >= 4 AND 100 * n_dup_lines > 60 * n_lines"),
    Rule("odd_word_length", "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 14 * n_words)"),
    Rule("shouting", "100 * n_upper_words > 50 * n_words"),
)


@dataclass(frozen=True)
class Policy:
    """A version, and the rules whose failure rejects a document."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << i for i, r in enumerate(RULES) if r.name in self.rules)


POLICIES = {
    "base": Policy("base", ("few_words", "repeats_itself")),
    "v1": Policy("v1", ("few_words", "repeats_itself", "symbol_heavy", "repeated_lines", "odd_word_length", "shouting")),
}


def _per_row(counts: np.ndarray, rows: int) -> np.ndarray:
    return np.bincount(counts, minlength=rows).astype(np.int64)


def _repeats(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry: whether its key occurs again or before; whether it occurred before."""
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    same = ordered[1:] == ordered[:-1]
    again, before = np.zeros(len(key), bool), np.zeros(len(key), bool)
    before[order[1:]] = same
    again[order[1:]] = same
    again[order[:-1]] |= same
    return again, before


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """All measurements of the rows of a piece of text."""
    rows = len(offsets) - 1
    w = words(data, offsets)
    solid = np.zeros(len(data) + 1, np.int64)
    # code points: bytes that don't continue one; separators are single bytes
    lead = (data & 0xC0) != 0x80
    np.cumsum(lead, out=solid[1:])
    chars = solid[w.end] - solid[w.start]
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS.encode())] = True
    upto = np.zeros(len(data) + 1, np.int64)
    np.cumsum(symbol[data], out=upto[1:])
    n_symbols = upto[offsets[1:]] - upto[offsets[:-1]]

    h = w.hashes()
    n_repeat = np.zeros(rows, np.int64)
    if len(h) >= 3:
        inside = same_row(w, 3)
        at = np.flatnonzero(inside)
        again, _ = _repeats(mix(Runs(h).windows(3)[at] + w.row[at].astype(U) * salt(21)))
        marked = np.zeros(len(h), bool)
        for i in range(3):
            marked[at[again] + i] = True
        n_repeat = _per_row(w.row[marked], rows)

    # lines: from a row's begin or after \n to the next \n or the row's end
    breaks = np.flatnonzero(data == 10)
    full = offsets[:-1] < offsets[1:]
    starts = np.union1d(offsets[:-1][full], breaks + 1)
    starts = starts[starts < len(data)]
    ends = np.append(starts[1:], len(data))
    line_row = np.searchsorted(offsets, starts, "right") - 1
    ends = np.where((ends > starts) & (data[ends - 1] == 10), ends - 1, ends) if len(starts) else ends
    worded = np.searchsorted(w.start, ends) > np.searchsorted(w.start, starts)
    starts, ends, line_row = starts[worded], ends[worded], line_row[worded]
    key = mix(byte_hashes(data, starts, ends) + line_row.astype(U) * salt(22)) if len(starts) else np.zeros(0, U)
    _, before = _repeats(key)

    # words whose bytes hold an ASCII capital and no ASCII small letter
    small, large = np.zeros(len(data) + 1, np.int64), np.zeros(len(data) + 1, np.int64)
    np.cumsum((data >= 97) & (data <= 122), out=small[1:])
    np.cumsum((data >= 65) & (data <= 90), out=large[1:])
    upper = (large[w.end] > large[w.start] + 1) & (small[w.end] == small[w.start])
    chars_upto = np.concatenate([[0], np.cumsum(chars)])
    return {
        "n_words": w.count, "word_chars": chars_upto[w.first[1:]] - chars_upto[w.first[:-1]], "n_symbols": n_symbols,
        "n_dup_lines": _per_row(line_row[before], rows), "n_repeat_words": n_repeat, "n_lines": _per_row(line_row, rows), "n_upper_words": _per_row(w.row[upper], rows),
    }


def _measured(docs: DataFrame, text_col: str, name: str) -> DataFrame:
    """``docs`` with one more column of this name, the struct of measurements."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = pa.RecordBatch.from_arrays(batch.columns, [f"c{i}" for i in range(batch.num_columns)])
            for rows, data, offsets in pieces([named], f"c{at}"):
                found = measure(data, offsets)
                struct = pa.StructArray.from_arrays([pa.array(found[m]) for m in MEASURES], list(MEASURES))
                yield pa.RecordBatch.from_arrays([*rows.columns, struct], [*names, name])

    names = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.StructType([T.StructField(m, T.LongType()) for m in MEASURES]))])
    return docs.mapInArrow(run, schema)


def failures(measures: str = "") -> F.Column:
    """The bitmask of failed rules, from measurement columns below the prefix ``measures``."""
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(RULES):
        test = rule.fails
        for m in MEASURES if measures else ():
            test = test.replace(m, f"{measures}.{m}")
        bits = bits.bitwiseOR(F.when(F.expr(test), F.lit(1 << i)).otherwise(0).cast("long"))
    return bits


def ledger(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, the measurements, and ``failed``, the bits of failed rules."""
    found = _measured(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", "measures")
    return found.select(F.col("id").alias(id_col), *[F.col(f"measures.{m}").alias(m) for m in MEASURES]).withColumn("failed", failures())


def verdict(policy: str) -> F.Column:
    return F.col("failed").bitwiseAND(F.lit(POLICIES[policy].mask)) == 0


def keep(docs: DataFrame, *, text_col: str = "text", policy: str = "v1") -> DataFrame:
    """The rows of ``docs`` that the policy keeps."""
    (name,) = unused(docs, "measures")
    failed = failures(name).bitwiseAND(F.lit(POLICIES[policy].mask))
    return _measured(docs, text_col, name).filter(failed == 0).drop(name)


def ablations(entries: DataFrame, policy: str = "v1") -> DataFrame:
    """What each rule of a policy does: documents it fails, and those that only it rejects.

    One pass of bitwise aggregation over a ledger: no rule and no text is evaluated again.
    """
    mask = POLICIES[policy].mask
    inside = F.col("failed").bitwiseAND(F.lit(mask))
    sums = [F.sum((inside.bitwiseAND(F.lit(1 << i)) != 0).cast("long")).alias(f"f{i}") for i in range(len(RULES))]
    sums += [F.sum((inside == F.lit(1 << i)).cast("long")).alias(f"o{i}") for i in range(len(RULES))]
    total = entries.agg(F.count(F.lit(1)).alias("n"), F.sum((inside == 0).cast("long")).alias("kept"), F.bit_or(inside).alias("seen"), *sums)
    rows = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.col(f"f{i}").alias("fails"), F.col(f"o{i}").alias("only")) for i, r in enumerate(RULES) if mask >> i & 1])
    return total.select("n", "kept", F.explode(rows).alias("r")).select(
        F.lit(policy).alias("policy"), "r.rule", F.coalesce("r.fails", F.lit(0)).alias("fails"), F.coalesce("r.only", F.lit(0)).alias("only_this"), F.coalesce(F.col("kept") + F.col("r.only"), F.lit(0)).alias("kept_without")
    )
