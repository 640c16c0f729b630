"""Column expressions with the exact string rules of the search index."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _fold_table() -> tuple[str, str]:
    """Small letters that are an ASCII letter with marks, and these letters; then the marks themselves, which fold to nothing."""
    pairs = []
    for code in range(0x80, 0x2000):
        base, *marks = unicodedata.normalize("NFD", chr(code))
        if base in LOWER and marks and all(map(unicodedata.combining, marks)):
            pairs.append((chr(code), base))
    marks = "".join(map(chr, range(0x300, 0x370)))
    return "".join(c for c, _ in pairs) + marks, "".join(base for _, base in pairs)


#: For translate: letters and marks, and what the first of them become; those without a partner are dropped.
ACCENTED, PLAIN = _fold_table()


def ascii_lower(c: Column) -> Column:
    """Lower case of A-Z only, as LIKE compares."""
    return F.translate(c, UPPER, LOWER)


def trim_space(c: Column) -> Column:
    """Without any Unicode white space at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def separators_to_space(c: Column) -> Column:
    """Runs of - _ / \\ . as one space."""
    return F.regexp_replace(c, r"[-_/\\.]+", " ")


def fold(c: Column) -> Column:
    """Case and accents folded, as index tokens are."""
    return F.translate(F.lower(c), ACCENTED, PLAIN)


def tokens(c: Column) -> Column:
    """Index tokens in order: runs of letters and digits, folded."""
    return F.regexp_extract_all(fold(c), F.lit(r"[\p{L}\p{N}]+"), 0)


def soft_stem(c: Column) -> Column:
    """Without a plural s, for words of four letters or more."""
    plural = (F.length(c) >= 4) & c.endswith("s") & ~c.endswith("ss") & ~c.endswith("us") & ~c.endswith("is")
    return F.when(plural, F.substring(c, F.lit(1), F.length(c) - 1)).otherwise(c)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """With its dot, lower case; empty for names like .npmrc."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1))


def iso_millis(ms: Column) -> Column:
    """ISO text in UTC with milliseconds, from epoch milliseconds."""
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def normalize_text(c: Column) -> Column:
    """Unix line ends, no NUL, trimmed."""
    return trim_space(F.replace(F.regexp_replace(c, r"\r\n?", "\n"), F.lit("\x00"), F.lit("")))


def limit_content(c: Column, most: int) -> Column:
    """At most ``most`` characters, cut at the last line end if that is past the half."""
    head = F.substring(c, 1, most)
    last = most - F.instr(F.reverse(head), "\n")  # characters before the last line end
    cut = F.when((F.instr(head, "\n") > 0) & (last > most // 2), F.substring(head, F.lit(1), last)).otherwise(head)
    return F.when(F.length(c) > most, trim_space(cut)).otherwise(c)


#: What each piece of word-processor markup stands for, in the order in which pieces are replaced.
MARKUP = (
    (r"</?w:p(?:\s[^>]*)?>", "\n"), (r"<w:tab\b[^>]*>", "\t"), (r"<w:br\b[^>]*>", "\n"), (r"<[^>]+>", ""),
    ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), (r"[ \t]+", " "), (r"\n{3,}", "\n\n"),
)


def markup_to_text(c: Column) -> Column:
    """Readable text of word-processor markup: paragraphs and breaks as lines, tags dropped, entities decoded, blanks collapsed."""
    return trim_space(reduce(lambda text, piece: F.regexp_replace(text, *piece), MARKUP, c))


def dedupe_consecutive(arr: Column) -> Column:
    """Without entries equal to the one before."""
    return F.filter(arr, lambda x, i: (i == 0) | (x != F.get(arr, i - 1)))


def stable_id(path: Column) -> Column:
    return F.sha1(path)


def fingerprint(path: Column, size: Column, mtime_ms: Column) -> Column:
    return F.concat_ws(":", path, size.cast("string"), F.floor(mtime_ms).cast("string"))
