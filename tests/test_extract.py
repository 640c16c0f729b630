import io
import json
import zipfile
import zlib

from lodeview.operators import extract


def _docx(xml):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", xml)
    return out.getvalue()


def test_docx():
    xml = "<w:p><w:r>One</w:r></w:p><w:p>A<w:tab/>B &amp; C &#233;</w:p>"
    assert extract.extract("a.docx", "docx", _docx(xml)).content == "One\n\nA B & C é"
    assert not extract.extract("a.docx", "docx", b"no archive").success


def test_pdf_streams_and_strings():
    body = zlib.compress(rb"BT (Hello \(nested\) w\157rld) Tj <48692E> Tj ET")
    raw = b"%PDF /Title (My book) /Count 3 <</Filter /FlateDecode>>\nstream\n" + body + b"\nendstream"
    x = extract.extract("a.pdf", "pdf", raw)
    assert x.content == "Hello (nested) world\nHi." and x.title == "My book" and x.pages == 3 and x.strategy == "raw_strings"


def test_decoding_and_binary():
    assert extract.decode("hé".encode("utf-16"))[0] == "hé"
    assert extract.decode("plain text".encode("utf-16le"))[1] == "utf-16le"
    assert not extract.extract("a.txt", "plain_text", bytes(range(7)) * 200).success
    assert extract.extract("a.txt", "plain_text", b"first line\r\nsecond\0 line\r").content == "first line\nsecond line"


def test_manifest_and_limit():
    raw = json.dumps({"name": "x", "private": True, "keywords": ["k"], "scripts": {"build": "b"}, "dependencies": {"z": "1", "a": "2"}})
    head = extract.extract("/p/package.json", "package_manifest", raw.encode()).content.split("\n\n")[0]
    assert head == "manifest: package.json\nname: x\nprivate: true\nkeywords: k\nscripts: build\ndependencies: z, a"
    assert extract.limited("ab\ncd\nefg", 7) == ("ab\ncd", True)


def test_files_end_to_end(spark):
    rows = [("/x/README", b"hello"), ("/x/a.docx", b"bad"), ("/x/b.exe", b"z"), ("/x/c.md", None)]
    got = {r["path"]: r for r in extract.extract_files(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert set(got) == {"/x/README", "/x/a.docx", "/x/c.md"}
    assert got["/x/README"]["content"] == "hello" and got["/x/README"]["extractor_type"] == "text/readme"
    assert got["/x/a.docx"]["reason"] and got["/x/c.md"]["reason"]
