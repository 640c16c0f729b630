"""Text extraction: kinds by name in SQL, bytes in Arrow batches.

Names decide the kind in plain expressions, so unsupported files never leave the
JVM. Bytes are parsed in ``mapInArrow`` batches; a failure is a row with a
reason, never an exception.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeview.functions.text import basename, extension
from lodeview.operators import external

# File kinds by extension and by name.
MARKDOWN = [".md", ".mdx", ".markdown"]
PLAIN = (
    ".txt .text .log .csv .tsv .json .yaml .yml .toml .ini .cfg .conf .env .xml .html .css .js .jsx .ts .tsx .mjs .cjs .py .rs .go .java .c .cc .cpp .h .hpp .sh .zsh .bash .sql .ps1"
).split()
MANIFESTS = (
    "package.json package-lock.json pnpm-lock.yaml yarn.lock composer.json composer.lock cargo.toml cargo.lock go.mod go.sum pyproject.toml pipfile pipfile.lock requirements.txt "
    "gemfile gemfile.lock pom.xml build.gradle build.gradle.kts settings.gradle settings.gradle.kts deno.json deno.jsonc"
).split()
PLAIN_NAMES = "license copying notice changelog makefile .gitignore .npmrc .nvmrc .editorconfig".split()
JSON_MANIFESTS = "package.json package-lock.json composer.json composer.lock deno.json deno.jsonc pipfile.lock".split()
EXTRACTORS = {
    "markdown": "text/markdown", "readme": "text/readme", "package_manifest": "text/package-manifest", "pdf": "application/pdf", "docx": "application/docx", "plain_text": "text/plain",
}
MIMES = {".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".gif": "image/gif", ".webp": "image/webp", ".bmp": "image/bmp", ".tif": "image/tiff", ".tiff": "image/tiff", ".heic": "image/heic", ".svg": "image/svg+xml"}
MAX_BYTES, MAX_CHARS, OCR_BYTES = 512 * 1024, 200_000, 6 * 1024 * 1024
STRING_FIELDS = ["name", "description", "version", "packageManager", "type"]
DEPENDENCIES = ["dependencies", "devDependencies", "peerDependencies", "optionalDependencies"]
PDF_WORDS = {"obj", "endobj", "stream", "endstream", "xref", "trailer", "startxref", "null"}


def kind(path: Column) -> Column:
    ext, base = extension(path), F.lower(basename(path))
    return (
        F.when(ext == ".pdf", "pdf").when(ext == ".docx", "docx").when(base.isin(MANIFESTS), "package_manifest").when((base == "readme") | base.startswith("readme."), "readme")
        .when(ext.isin(MARKDOWN), "markdown").when(ext.isin(PLAIN) | base.isin(PLAIN_NAMES), "plain_text").otherwise("unsupported")
    )


def extractor_type(kind_: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in EXTRACTORS.items():
        out = F.when(kind_ == k, v).otherwise(out)
    return out


def is_image(path: Column) -> Column:
    return extension(path).isin(list(MIMES))


def is_screenshot(path: Column) -> Column:
    p, base = F.lower(path), F.lower(basename(path))
    inside = lambda c, s: F.contains(c, F.lit(s))
    return inside(p, "/screenshots/") | inside(p, "/screenshot/") | inside(base, "screenshot") | inside(base, "screen shot") | base.startswith("shot-")


def wants_ocr(path: Column, size: Column, mode: str) -> Column:
    """Which images a mode reads: off none, screenshots those of any size, all those up to OCR_BYTES."""
    return {"off": F.lit(False), "screenshots": is_image(path) & is_screenshot(path), "all": is_image(path) & (size <= OCR_BYTES)}[mode]


def image_summary(name: Column, category: Column, captured: Column, created: Column, camera: Column, size: Column, location: Column, gps: Column) -> Column:
    line = lambda name, c: F.concat(F.lit(name + ": "), c)
    where = F.coalesce(line("location", location), line("gps", gps))
    return F.concat_ws("\n", line("image", name), line("category", category), F.coalesce(line("captured", captured), line("created", created)), line("camera", camera), line("dimensions", size), where)


def repo_summary(name: Column, remote: Column, readme: Column, package: Column) -> Column:
    line = lambda head, c: F.concat(F.lit(head), c)
    return F.concat_ws("\n\n", line("repo: ", name), line("remote: ", remote), line("readme:\n", readme), line("package:\n", package))


def manifest_keys(raw: Column) -> Column:
    """Names in a manifest's scripts and dependency lists, in the file's order."""
    lists = [F.json_object_keys(F.get_json_object(raw, f"$.{f}")) for f in ("scripts", *DEPENDENCIES)]
    return F.flatten(F.array(*[F.coalesce(k, F.array().cast("array<string>")) for k in lists]))


@dataclass
class Extracted:
    """What came of a file."""

    content: str | None = None
    reason: str | None = None
    encoding: str | None = None
    truncated: bool = False
    title: str | None = None
    pages: int | None = None
    strategy: str | None = None
    warnings: list[str] = field(default_factory=list)

    @property
    def success(self) -> bool:
        return self.content is not None


def decode(raw: bytes) -> tuple[str, str]:
    """Text and encoding: by mark, by where zero bytes are, or else UTF-8."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16le"), (b"\xfe\xff", "utf-16be")):
        if raw.startswith(mark):
            return raw[len(mark) :].decode(name, "replace"), name
    head = raw[:200]
    if len(head) >= 4:
        half = len(head) // 2
        if head[1::2].count(0) > 0.6 * half:
            return raw.decode("utf-16le", "replace"), "utf-16le"
        if head[0::2].count(0) > 0.6 * half:
            return raw.decode("utf-16be", "replace"), "utf-16be"
    return raw.decode("utf-8", "replace"), "utf-8"


def looks_binary(raw: bytes) -> bool:
    head = raw[:4096]
    odd = sum(b < 7 or 15 <= b <= 31 for b in head)
    return bool(head) and (head.count(0) > 0.1 * len(head) or odd >= 0.3 * len(head))


def normalized(text: str) -> str:
    return re.sub(r"\r\n?", "\n", text).replace("\0", "").strip()


def limited(text: str, most: int = MAX_CHARS) -> tuple[str, bool]:
    if len(text) <= most:
        return text, False
    head = text[:most]
    last = head.rfind("\n")
    return (head[:last] if last > most // 2 else head).strip(), True


def manifest_text(name: str, raw: str) -> str:
    lines = [f"manifest: {name}"]
    held = None
    if name in JSON_MANIFESTS:
        try:
            held = json.loads(raw)
        except ValueError:
            held = None
    if isinstance(held, dict):
        keys = lambda v: list(v) if isinstance(v, dict) else []
        texts = lambda v: [x for x in v if isinstance(x, str)] if isinstance(v, list) else []
        lines += [f"{f}: {held[f]}" for f in STRING_FIELDS if isinstance(held.get(f), str) and held[f].strip()]
        if isinstance(held.get("private"), bool):
            lines.append(f"private: {str(held['private']).lower()}")
        spaces = held.get("workspaces")
        spaces = spaces.get("packages") if isinstance(spaces, dict) else spaces
        for head, values in (("keywords", texts(held.get("keywords"))), ("scripts", keys(held.get("scripts"))), ("workspaces", texts(spaces)), *((d, keys(held.get(d))) for d in DEPENDENCIES)):
            if values:
                lines.append(f"{head}: {', '.join(values)}")
    return ("\n".join(lines) + "\n\n" + raw).strip()


# An ampersand may itself be written as an entity; what it then begins is an entity as well.
_PIECE = re.compile(r"(</?w:p(?:\s[^>]*)?>|<w:br\b[^>]*>)|(<w:tab\b[^>]*>)|(<[^>]+>)|&(?:amp;|#0*38;|#[xX]0*26;)?(?:#(\d+)|#x([0-9a-fA-F]+)|(lt|gt|quot|apos|amp));")
_NAMED = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "amp": "&"}


def _piece(m: re.Match) -> str:
    if m.lastindex <= 3:
        return ("\n", "\t", "")[m.lastindex - 1]
    return _NAMED[m[6]] if m[6] else chr((int(m[4]) if m[4] else int(m[5], 16)) & 0xFFFF)


def markup_text(xml: str) -> str:
    """Readable text of word-processor markup in one pass over its tags and entities."""
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", _PIECE.sub(_piece, xml))).strip()


def docx(raw: bytes) -> Extracted:
    try:
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            xml = z.read("word/document.xml").decode("utf-8", "replace")
    except (zipfile.BadZipFile, KeyError, OSError, zlib.error) as e:
        return Extracted(reason=f"the archive can't be read: {e}")
    text = markup_text(xml)
    if not text:
        return Extracted(reason="no readable text in the document")
    content, cut = limited(text)
    return Extracted(content, truncated=cut)


def _pdf_string(raw: bytes) -> str:
    if raw.startswith(b"\xfe\xff"):
        return raw[2:].decode("utf-16be", "replace")
    if raw.startswith(b"\xff\xfe"):
        return raw[2:].decode("utf-16le", "replace")
    return raw.decode("latin-1")


_ESCAPES = {ord("n"): 10, ord("r"): 13, ord("t"): 9, ord("b"): 8, ord("f"): 12}


def pdf_tokens(data: bytes) -> list[str]:
    """Literal (nested) and hexadecimal strings in order."""
    out, i, n = [], 0, len(data)
    while i < n:
        c = data[i]
        if c == 0x28:  # (
            depth, i, got = 1, i + 1, bytearray()
            while i < n and depth:
                c = data[i]
                if c == 0x5C and i + 1 < n:
                    octal = re.match(rb"[0-7]{1,3}", data[i + 1 : i + 4])
                    if octal:
                        got.append(int(octal[0], 8) & 255)
                        i += len(octal[0])
                    elif data[i + 1] not in (10, 13):
                        got.append(_ESCAPES.get(data[i + 1], data[i + 1]))
                        i += 1
                    else:
                        i += 1
                else:
                    depth += (c == 0x28) - (c == 0x29)
                    if depth:
                        got.append(c)
                i += 1
            out.append(_pdf_string(bytes(got)))
        elif c == 0x3C and data[i : i + 2] != b"<<":
            end = data.find(b">", i)
            if end < 0:
                break
            digits = re.sub(rb"\s+", b"", data[i + 1 : end])
            if digits and re.fullmatch(rb"[0-9A-Fa-f]+", digits):
                out.append(_pdf_string(bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())))
            i = end + 1
        else:
            i += 2 if data[i : i + 2] == b"<<" else 1
    return out


def _readable(tokens: list[str]) -> list[str]:
    flat = [re.sub(r"\s+", " ", t).strip() for t in tokens]
    flat = [t for t in flat if re.search(r"[A-Za-z0-9]", t) and t.lower() not in PDF_WORDS]
    return [t for i, t in enumerate(flat) if i == 0 or t != flat[i - 1]]


def pdf_about(raw: bytes) -> tuple[str | None, int | None]:
    """Title and page count."""
    title = re.search(rb"/Title\s*\(((?:\\.|[^\\)])*)\)", raw)
    count = re.search(rb"/Count\s+(\d+)", raw)
    return _pdf_string(title[1]) if title else None, int(count[1]) if count else None


def pdf(raw: bytes) -> Extracted:
    """Strings of text blocks in (inflated) streams, or else of the whole file."""
    found: list[str] = []
    for m in re.finditer(rb"stream\r?\n(.*?)\r?\n?endstream", raw, re.S):
        data = m[1]
        if b"FlateDecode" in raw[max(0, m.start() - 200) : m.start()]:
            try:
                data = zlib.decompressobj().decompress(data)
            except zlib.error:
                continue
        for block in re.findall(rb"BT(.*?)ET", data, re.S):
            found += pdf_tokens(block)
    lines = _readable(found) or _readable(pdf_tokens(raw))
    about = dict(zip(("title", "pages"), pdf_about(raw), strict=True))
    if not lines:
        return Extracted(reason="no readable text in the document", strategy="none", **about)
    content, cut = limited("\n".join(lines))
    return Extracted(content, truncated=cut, strategy="raw_strings", **about)


def read_whole(path: str, most: int | None = None) -> bytes | None:
    """A file's bytes, or its first ones; None if it can't be read."""
    try:
        with open(path, "rb") as f:
            return f.read() if most is None else f.read(most)
    except OSError:
        return None


def extract_file(path: str, kind_: str) -> Extracted:
    """The text of a file, a PDF's by an external program if one finds any."""
    raw = read_whole(path, None if kind_ in ("pdf", "docx") else MAX_BYTES + 1)
    printed = external.pdf_text(path) if kind_ == "pdf" and raw is not None else None
    content, cut = limited(normalized(printed[0])) if printed else ("", False)
    if not content:
        return extract(path, kind_, raw)
    title, pages = pdf_about(raw)
    return Extracted(content, truncated=cut, strategy=printed[1], title=title, pages=pages)


def extract(path: str, kind_: str, raw: bytes | None) -> Extracted:
    """The text of a file's first MAX_BYTES (PDF and DOCX: of all)."""
    if raw is None:
        return Extracted(reason="the file can't be read")
    try:
        if kind_ == "pdf":
            return pdf(raw)
        if kind_ == "docx":
            return docx(raw)
        head = raw[:MAX_BYTES]
        if not head.startswith((b"\xff\xfe", b"\xfe\xff")) and decode(head)[1] == "utf-8" and looks_binary(head):
            return Extracted(reason="the file looks binary")
        text, encoding = decode(head)
        text = normalized(text)
        if kind_ == "package_manifest":
            text = manifest_text(path.rsplit("/", 1)[-1].lower(), text)
        content, cut = limited(text)
        if not content:
            return Extracted(reason="the file has no text", encoding=encoding)
        return Extracted(content, encoding=encoding, truncated=cut or len(raw) > MAX_BYTES)
    except Exception as e:  # a file's content must not end a scan
        return Extracted(reason=f"extraction failed: {e}")


SCHEMA = "path string, extractor_type string, success boolean, content string, reason string, encoding string, truncated boolean, title string, page_count int, pdf_strategy string"


def extract_files(files: DataFrame) -> DataFrame:
    """(path) or (path, content bytes) to one row per supported file: SCHEMA. Without bytes, files are read where they are parsed."""
    given = "content" in files.columns
    supported = files.withColumn("kind", kind(F.col("path"))).filter("kind <> 'unsupported'").select("path", "kind", *["content"] * given)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.int32(), pa.string()]
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        for batch in batches:
            for begin in range(0, batch.num_rows, 64):
                rows = []
                for path, k, *raw in zip(*(c.to_pylist() for c in batch.slice(begin, 64).columns), strict=True):
                    x = extract(path, k, raw[0]) if given else extract_file(path, k)
                    rows.append((path, EXTRACTORS[k], x.success, x.content, x.reason, x.encoding, x.truncated, x.title, x.pages, x.strategy))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return supported.mapInArrow(run, SCHEMA)
