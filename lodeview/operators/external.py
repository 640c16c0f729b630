"""Programs that extraction uses where executors have them: PDF text, image tags, text in images.

Each runs on a path, one file at a time, in Arrow batches; what a program can't do
is a null or a reason, never an exception. Executors must see the paths.
"""

from __future__ import annotations

import json
import re
import shutil
import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

SECONDS = 120
# The programs' arguments, the tags that are read, and the most characters of a text in an image.
PDF_PROGRAMS = {"pdftotext": ["-layout", "{}", "-"], "mutool": ["draw", "-F", "txt", "{}"]}
TAGS = "DateTimeOriginal CreateDate ImageWidth ImageHeight Make Model City State Country GPSLatitude GPSLongitude GPSPosition".split()
OCR_CHARS = 40_000


def output(program: str, args: list[str]) -> str | None:
    """What a program prints; None if it isn't there, fails, or takes too long."""
    if shutil.which(program) is None:
        return None
    try:
        done = subprocess.run([program, *args], stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, stdin=subprocess.DEVNULL, timeout=SECONDS)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout.decode("utf-8", "replace") if done.returncode == 0 else None


def pdf_text(path: str) -> tuple[str, str] | None:
    """(text, program) of the first program that finds any."""
    for program, args in PDF_PROGRAMS.items():
        text = output(program, [path if a == "{}" else a for a in args])
        if text and text.strip():
            return text, program
    return None


def tags(path: str) -> dict[str, str]:
    """An image's tags as text; those that are blank or, where a number is due, no number are left out."""
    raw = output("exiftool", ["-json", *(f"-{t}" for t in TAGS), path])
    try:
        held = json.loads(raw or "[]")
    except ValueError:
        return {}
    found = held[0] if isinstance(held, list) and held and isinstance(held[0], dict) else {}
    out = {}
    for t in TAGS:
        v = found.get(t)
        if t in ("ImageWidth", "ImageHeight"):
            v = str(v) if re.fullmatch(r"\d+(\.\d+)?", str(v)) else None
        if isinstance(v, str) and v.strip():
            out[t] = v.strip()
    return out


def read_image(path: str, want_text: bool) -> tuple[str | None, ...]:
    """(captured, created, camera, dimensions, location, gps, text) of an image."""
    t = tags(path)
    join = lambda by, *names: by.join(t[n] for n in names if n in t) or None
    size = f"{t.get('ImageWidth', '?')}x{t.get('ImageHeight', '?')}" if {"ImageWidth", "ImageHeight"} & t.keys() else None
    text = output("tesseract", [path, "stdout", "--psm", "11"]) if want_text else None
    text = re.sub(r"\s+", " ", text.replace("\0", "")).strip()[:OCR_CHARS] if text else None
    return t.get("DateTimeOriginal"), t.get("CreateDate"), join(" ", "Make", "Model"), size, join(", ", "City", "State", "Country"), t.get("GPSPosition"), text or None


IMAGE = "path string, captured string, created string, camera string, dimensions string, location string, gps string, ocr string"


def read_images(images: DataFrame) -> DataFrame:
    """(path, wants_ocr) to one row per image: IMAGE."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, *read_image(p, bool(w))) for p, w in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            columns = list(zip(*rows, strict=True)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], [f.split()[0] for f in IMAGE.split(", ")])

    return images.select("path", "wants_ocr").mapInArrow(run, IMAGE)
