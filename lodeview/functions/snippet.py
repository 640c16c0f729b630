"""The stretch of a text that shows a match best."""

from __future__ import annotations

import re

from lodeview.functions.text import ACCENTED, PLAIN

_TOKEN = re.compile(r"(?:[^\W_]|[\u0300-\u036f])+")


_FOLD = str.maketrans(ACCENTED[: len(PLAIN)], PLAIN, ACCENTED[len(PLAIN) :])


def _folded(text: str) -> str:
    return text.lower().translate(_FOLD)


def _matches(words: list[str], terms: list[list[str]]) -> list[tuple[int, int, int]]:
    """(place, term, length) of all matches, by place."""
    out = []
    for i in range(len(words)):
        for k, t in enumerate(terms):
            if i + len(t) <= len(words) and words[i : i + len(t) - 1] == t[:-1] and words[i + len(t) - 1].startswith(t[-1]):
                out.append((i, k, len(t)))
    return out


def _begins(text: str, at: int) -> bool:
    """Whether a sentence begins at a word: blanks stand before it, and a full stop or a colon before them."""
    i = at
    while i and text[i - 1] in " \t\r\n":
        i -= 1
    return 0 < i < at and text[i - 1] in ".:"


def snippet(text: str | None, terms: list[list[str]], size: int = 12) -> str:
    """At most ``size`` words around matches, which stand in brackets; dots where the text goes on.

    A window counts 1000 for each term in it and 1 for each further match. Windows begin at matches (then the
    matches are centred) or at the sentence around one, which is worth 100, or 120 at the text's begin.
    """
    text = text or ""
    spans = [m.span() for m in _TOKEN.finditer(text)]
    words = [_folded(text[a:b]) for a, b in spans]
    n, hits = len(words), _matches(words, terms)
    if not spans:
        return text
    sentences = [0] + [i for i in range(1, n) if _begins(text, spans[i][0])]

    def score(start: int) -> tuple[int, int]:
        seen: set[int] = set()
        total, first, last = 0, -1, 0
        for at, term, length in hits:
            if start <= at < start + size:
                total += 1 if term in seen else 1000
                seen.add(term)
                first = at if first < 0 else first
                last = at + length
        shifted = first - (size - (last - first)) // 2
        return total, max(0, min(shifted, n - size))

    best, begin = 0, 0
    for at, _, _ in hits:
        total, shifted = score(at)
        if total > best:
            best, begin = total, shifted
        held = max(s for s in sentences if s <= at)
        if held < at and n > size:
            total = score(held)[0] + (120 if held == 0 else 100)
            if total > best:
                best, begin = total, held
    end = min(n, begin + size)
    out, at = [], spans[begin][0] if begin else 0
    if begin:
        out.append(" … ")
    covered = begin - 1
    for i, _, length in hits:
        if begin <= i < end and i > covered:
            stop = min(i + length, end) - 1
            out += [text[at : spans[i][0]], "[", text[spans[i][0] : spans[stop][1]], "]"]
            at, covered = spans[stop][1], stop
    out.append(text[at:] if end == n else text[at : spans[end - 1][1]] + " … ")
    return "".join(out)
