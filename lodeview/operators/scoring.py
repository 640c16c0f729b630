"""Scores as integer expressions over names, paths and metadata."""

from __future__ import annotations

import re
from functools import partial, reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodeview.functions.text import separators_to_space
from lodeview.plans.query import Question, meaningful, separated, stem

# Path segments of generated or foreign content.
NOISY = [
    "/node_modules/", "/.git/", "/__pycache__/", "/.cache/", "/.venv/", "/venv/", "/vendor/", "/dist/", "/build/", "/.next/", "/.pio/libdeps/", "/site-packages/",
    "/.mypy_cache/", "/tmp/", "/var/tmp/",
]
# How a text's origin is called in a reason.
ORIGINS = {
    "image_metadata": "image metadata", "screenshot_metadata": "screenshot metadata", "image_ocr": "image OCR text", "screenshot_ocr": "screenshot OCR text",
    "application/pdf": "PDF text", "application/docx": "DOCX text", "text/package-manifest": "package manifest text", "repo_summary": "repo summary text",
}


def _sum(parts: list[Column]) -> Column:
    return reduce(add, parts, F.lit(0))


def _points(test: Column, n: int) -> Column:
    return F.when(test, n).otherwise(0)


def string_score(q: Question, haystack: Column, base: int = 100) -> Column:
    """base + 40 with the whole question inside, else 5 for each word inside."""
    hay, needle = separators_to_space(F.lower(haystack)), separated(q.text)
    words = meaningful(needle.split())
    hits = _sum([_points(F.contains(hay, F.lit(w)) | F.contains(hay, F.lit(stem(w))), 5) for w in words])
    return F.when(F.contains(hay, F.lit(needle)), base + 40).otherwise(base + hits)


def name_bonus(q: Question, name: Column) -> Column:
    """40 for a word of the question as a word of the name, 15 inside one; the best counts."""
    hay, best = F.lower(name), [F.lit(0), F.lit(0)]
    for w in sorted({x for word in q.words if len(word) >= 2 for x in (word, stem(word)) if len(x) >= 2}):
        bounded = hay.rlike("(?:^|[^a-z0-9])" + re.escape(w) + "(?:$|[^a-z0-9])")
        best.append(F.when(bounded, 40).when(F.contains(hay, F.lit(w)), 15).otherwise(0))
    return F.greatest(*best)


def category(metadata: Column) -> Column:
    return F.get_json_object(metadata, "$.fileCategory")


def is_screenshot(metadata: Column) -> Column:
    return F.coalesce(F.get_json_object(metadata, "$.isScreenshot") == "true", F.lit(False))


def source_hint_score(q: Question, metadata: Column, extension: Column, path: Column) -> Column:
    parts = []
    if "image" in q.hints:
        parts.append(_points(category(metadata) == "image", 20))
    if "screenshot" in q.hints:
        parts.append(_points(is_screenshot(metadata), 30))
    if "pdf" in q.hints:
        parts.append(_points(F.lower(extension) == "pdf", 20))
    if "download" in q.hints:
        parts.append(_points(F.contains(F.lower(path), F.lit("/downloads/")), 20))
    return _sum(parts)


def blob_hint_score(q: Question, extractor: Column) -> Column:
    """The first hint that fits counts."""
    tests = []
    if "screenshot" in q.hints:
        tests.append((extractor.startswith("screenshot_"), 28))
    if "image" in q.hints:
        tests += [(extractor.startswith("image_"), 24), (extractor.startswith("screenshot_"), 18)]
    if "pdf" in q.hints:
        tests.append((extractor == "application/pdf", 24))
    out = F.lit(0)
    for test, n in reversed(tests):
        out = F.when(test, n).otherwise(out)
    return out


def path_quality(path: Column, repo: bool = False) -> Column:
    p = F.lower(path)
    has = lambda s: F.contains(p, F.lit(s))
    depth = F.size(F.filter(F.split(p, "/"), lambda x: x != ""))
    noise = _sum([_points(has(s), -60 if repo else -45) for s in NOISY])
    good = _points(has("/downloads/"), 5) + _points(has("/pictures/"), 5) + _points(has("/projects/") | has("/work/") | has("/src/"), 12)
    return noise + good - F.least(F.greatest(depth - 6, F.lit(0)) * 2, F.lit(20))


def name_similarity(q: Question, name: Column) -> Column:
    """The best of 1 - edit distance / longer over word pairs, and over the whole name for questions of one word."""
    low = F.lower(name)
    spaced = separators_to_space(low)

    def like(left: str, right: Column) -> Column:
        """Similarity of a word of the question and a name, of a word of it."""
        a, b = separated(left), separators_to_space(right)
        longest = F.greatest(F.lit(len(a)), F.length(b))
        return F.when(longest > 0, 1 - F.levenshtein(F.lit(a), b) / longest).otherwise(0.0)

    names = F.array_distinct(F.filter(F.split(spaced, r"\s+"), lambda n: F.length(n) >= 3))
    best = [F.lit(0.0), F.lit(0.0)]
    if len(q.words) <= 1:
        best += [like(q.text, low), like(q.text, F.lower(F.regexp_replace(name, r"\.[^.]+$", ""))), like(q.text, spaced)]
    for w in q.words:
        if len(w) >= 3:
            best.append(F.coalesce(F.array_max(F.transform(names, partial(like, w))), F.lit(0.0)))
    return F.greatest(*best)


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("int")


def file_reason(metadata: Column) -> Column:
    return (
        F.when(is_screenshot(metadata), "Matched screenshot file name or path").when(category(metadata) == "image", "Matched image file name or path").otherwise("Matched file name or path text")
    )


def origin(extractor: Column) -> Column:
    out = F.lit("indexed text")
    for k, v in ORIGINS.items():
        out = F.when(extractor == k, v).otherwise(out)
    return out
