"""DOCX and PDF files, read into pages and written from report items, with the standard library only.

Files are bytes in a column; each is worked on by itself on an executor, so a file
has to fit its memory. What can't be read gives no pages and an error, not a crash.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_whitespace
from .readers import synthetic_pages

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx_paragraphs(content: bytes) -> list[str]:
    """Paragraphs of a DOCX file; a table row is one, its cells apart by a blank."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{_W}body")
    out: list[str] = []

    def text(node: ElementTree.Element) -> str:
        parts = []
        for x in node.iter():
            if x.tag == f"{_W}t":
                parts.append(x.text or "")
            elif x.tag in (f"{_W}tab", f"{_W}br"):
                parts.append(" ")
        return "".join(parts)

    for child in body if body is not None else ():
        if child.tag == f"{_W}p":
            out.append(text(child))
        elif child.tag == f"{_W}tbl":
            for row in child.iter(f"{_W}tr"):
                out.append(" ".join(text(cell) for cell in row.findall(f"{_W}tc")))
    return [t for t in (re.sub(r"[ \t\u00a0]+", " ", p).strip() for p in out) if t]


def _unescaped(raw: bytes) -> str:
    """A PDF string in brackets."""
    table = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}

    def one(m: re.Match[bytes]) -> bytes:
        x = m[1]
        return bytes([int(x, 8) & 255]) if x.isdigit() else table.get(x, b"" if x in (b"\n", b"\r") else x)

    plain = re.sub(rb"\\([0-7]{1,3}|.|\n|\r)", one, raw, flags=re.S)
    return plain[2:].decode("utf-16-be", "replace") if plain.startswith(b"\xfe\xff") else plain.decode("latin-1")


_STRING = rb"\((?:\\.|[^\\()])*\)"
_SHOWN = re.compile(rb"(\[(?:" + _STRING + rb"|[^\]])*\]\s*TJ)|(" + _STRING + rb"\s*(?:Tj|'|\"))|(T\*|\bTd\b|\bTD\b|\bTm\b|\bET\b)", re.S)


def _page_text(stream: bytes) -> str:
    """What a content stream shows in simple fonts, a line for every move to a new one."""
    out: list[str] = []
    for m in _SHOWN.finditer(stream):
        if m[3]:
            if out and out[-1] != "\n":
                out.append("\n")
            continue
        if (m[2] or b"")[-1:] in (b"'", b'"'):
            out.append("\n")
        out += [_unescaped(s[1:-1]) for s in re.findall(_STRING, m[1] or m[2], re.S)]
    return "".join(out)


def _streams(content: bytes) -> dict[int, bytes]:
    """Bodies of the streams by object number, inflated where they are deflated."""
    found = {}
    for m in re.finditer(rb"(\d+)\s+\d+\s+obj((?:(?!endobj).)*?)stream\r?\n(.*?)\r?\nendstream", content, re.S):
        body = m[3]
        if b"/FlateDecode" in m[2]:
            try:
                body = zlib.decompressobj().decompress(body)
            except zlib.error:
                continue
        found[int(m[1])] = body
    return found


def pdf_pages(content: bytes) -> list[str]:
    """Text of each page of a PDF whose pages and fonts are plain (no object streams, no fonts of glyph numbers)."""
    streams = _streams(content)
    pages = []
    for m in re.finditer(rb"\d+\s+\d+\s+obj\s*<<(.*?)>>\s*endobj", content, re.S):
        if not re.search(rb"/Type\s*/Page\b(?!s)", m[1]):
            continue
        refs = re.search(rb"/Contents\s*(?:\[([^\]]*)\]|(\d+\s+\d+\s+R))", m[1])
        numbers = [int(n) for n in re.findall(rb"(\d+)\s+\d+\s+R", (refs[1] or refs[2]) if refs else b"")]
        pages.append("\n".join(_page_text(streams.get(n, b"")) for n in numbers))
    return pages


def _read(files: DataFrame, parse, column: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows.append((path, parse(bytes(content)), None))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError, TypeError) as broken:
                    rows.append((path, None, f"{type(broken).__name__}: {broken}"[:200]))
            yield pd.DataFrame(rows, columns=["doc_id", column, "error"])

    return files.select("path", "content").mapInPandas(run, f"doc_id string, {column} array<string>, error string")


def docx_pages(files: DataFrame) -> DataFrame:
    """doc_id, page_no, text of DOCX files (path, content), cut into pages of about equally many paragraphs."""
    read = _read(files, docx_paragraphs, "paragraphs").filter("paragraphs is not null")
    return synthetic_pages(read, "doc_id", "paragraphs")


def pdf_text(files: DataFrame) -> DataFrame:
    """doc_id, page_no, text of PDF files (path, content)."""
    read = _read(files, pdf_pages, "pages").filter("pages is not null")
    rows = read.select("doc_id", F.posexplode("pages").alias("pos", "raw"))
    return rows.select("doc_id", (F.col("pos") + 1).alias("page_no"), normalize_whitespace("raw").alias("text"))


def unreadable(files: DataFrame, kind: str) -> DataFrame:
    """doc_id, error of the files that can't be read as kind (docx or pdf)."""
    parse = {"docx": docx_paragraphs, "pdf": pdf_pages}[kind]
    return _read(files, parse, "parts").filter("error is not null").select("doc_id", "error")


# Writing


def docx_bytes(lines: list[str]) -> bytes:
    """A DOCX file with a paragraph a line."""
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(_legal(x))}</w:t></w:r></w:p>' for x in lines)
    parts = {
        "[Content_Types].xml": '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>',
        "_rels/.rels": '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>',
        "word/document.xml": f'<?xml version="1.0" encoding="UTF-8"?><w:document {_NS}><w:body>{body}</w:body></w:document>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, text in parts.items():
            archive.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), text)  # the same bytes on every run
    return out.getvalue()


def _legal(text: str) -> str:
    return re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f]", "", text)


def pdf_bytes(lines: list[str], per_page: int = 48, width: int = 95) -> bytes:
    """A PDF file of the lines in a built-in font; what Latin-1 lacks is shown as a question mark."""
    wrapped = [part for x in lines for part in ([x[i : i + width] for i in range(0, len(x), width)] or [""])]
    sheets = [wrapped[i : i + per_page] for i in range(0, len(wrapped), per_page)] or [[]]
    objects = ["<< /Type /Catalog /Pages 2 0 R >>", "", "<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"]
    kids = []
    for sheet in sheets:
        shown = "".join(f"({re.sub(r'([()\\\\])', r'\\\1', _legal(x))}) Tj T*\n" for x in sheet)
        stream = f"BT /F1 10 Tf 14 TL 50 800 Td\n{shown}ET".encode("latin-1", "replace").decode("latin-1")
        kids.append(len(objects) + 1)
        objects.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Resources << /Font << /F1 3 0 R >> >> /Contents {len(objects) + 2} 0 R >>")
        objects.append(f"<< /Length {len(stream)} >>\nstream\n{stream}\nendstream")
    objects[1] = f"<< /Type /Pages /Kids [{' '.join(f'{k} 0 R' for k in kids)}] /Count {len(kids)} >>"
    out, at = b"%PDF-1.4\n", []
    for i, body in enumerate(objects, 1):
        at.append(len(out))
        out += f"{i} 0 obj\n{body}\nendobj\n".encode("latin-1")
    table = "".join(f"{x:010d} 00000 n \n" for x in at)
    return out + f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n{table}trailer\n<< /Size {len(objects) + 1} /Root 1 0 R >>\nstartxref\n{len(out)}\n%%EOF\n".encode()


def exported(docs: DataFrame, lines_col: str, kind: str, id_col: str = "doc_id", name_col: str | None = None) -> DataFrame:
    """id, name, content: a file of each document's lines, as txt, docx or pdf, under a safe name."""
    make = {"txt": lambda lines: "\n".join(lines).encode(), "docx": docx_bytes, "pdf": pdf_bytes}[kind]

    @F.pandas_udf("binary")
    def files(lines: pd.Series) -> pd.Series:
        return lines.map(lambda x: make([str(y) for y in x]) if x is not None else None)

    safe = F.regexp_replace(F.col(name_col or id_col).cast("string"), "[^A-Za-z0-9_-]", "_")
    return docs.select(id_col, F.concat(safe, F.lit(f".{kind}")).alias("name"), files(F.col(lines_col)).alias("content"))
