"""Documents from files as pages: (doc_id, page_no, kind, text, confidence, engine, warnings)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_whitespace

#: A page with less text is taken for a scan; a document has at most so many pages.
LEAST_TEXT = 120
MOST_PAGES = 400
SYNTHETIC_PAGE = 1800
UPLOADS = [".docx", ".pdf", ".txt", ".md", ".html"]

_BLOCK_TAG = r"(?i)</?(?:p|h[1-6]|tr|table|br|li|ol|ul)(?![A-Za-z0-9_])[^>]*>"
_ENTITIES = [("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')]


def format_of(path: Column, mime: Column | None = None) -> Column:
    """pdf, image, word, text or unknown; the first that fits."""
    name = F.lower(path)
    mime = F.coalesce(F.lower(mime), F.lit("")) if mime is not None else F.lit("")
    return (
        F.when(name.endswith(".pdf") | (mime == "application/pdf"), "pdf")
        .when(mime.startswith("image/") | name.rlike(r"\.(png|jpe?g|tiff?|bmp|webp)$"), "image")
        .when(name.rlike(r"\.(docx?|rtf)$") | F.contains(mime, F.lit("word")), "word")
        .when(mime.startswith("text/") | name.endswith(".txt"), "text")
        .otherwise("unknown")
    )


def accepted_upload(path: Column, size: Column, most_bytes: int = 25 << 20) -> Column:
    """201, 413 for a file that is too large, or 400 for another extension."""
    extension = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return F.when(~extension.isin(UPLOADS), 400).when(size > most_bytes, 413).otherwise(201)


def html_paragraphs(html: Column) -> Column:
    """Paragraphs of a page as an array of plain texts.

    Cut at block tags, which go; the end of a table cell is a blank, other tags
    are nothing; five entities are decoded in a fixed order.
    """
    def plain(part: Column) -> Column:
        out = F.regexp_replace(F.regexp_replace(part, r"(?i)</(?:td|th)\s*>", " "), "<[^>]+>", "")
        for entity, sign in _ENTITIES:
            out = F.replace(out, F.lit(entity), F.lit(sign))
        return normalize_whitespace(out)

    return F.filter(F.transform(F.split(html, _BLOCK_TAG, -1), plain), lambda x: x != "")


def text_pages(spark: SparkSession, path: str) -> DataFrame:
    """Plain text files, one page each."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), "value")
    return pages(files, "doc_id", "value")


def pages(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Texts as documents of one page."""
    return df.select(
        F.col(id_col).alias("doc_id"), F.lit(1).alias("page_no"), F.lit("text").alias("kind"),
        normalize_whitespace(text_col).alias("text"), F.lit(None).cast("double").alias("confidence"),
        F.lit("text").alias("engine"), F.array().cast("array<string>").alias("warnings"),
    )


def synthetic_pages(df: DataFrame, id_col: str, paragraphs_col: str) -> DataFrame:
    """Paragraph arrays as pages of about 1800 characters: n pages of equally many paragraphs."""
    joined = F.length(F.array_join(paragraphs_col, "\n"))
    n = F.greatest(F.lit(1), F.ceil(joined / SYNTHETIC_PAGE)).cast("int")
    per = F.greatest(F.lit(1), F.ceil(F.size(paragraphs_col) / n)).cast("int")
    cut = df.select(F.col(id_col).alias("doc_id"), F.col(paragraphs_col).alias("p"), per.alias("per"))
    last = F.floor((F.greatest(F.size("p"), F.lit(1)) - 1) / F.col("per")).cast("int")
    return cut.select("doc_id", "p", "per", F.explode(F.sequence(F.lit(0), last)).alias("i")).select(
        "doc_id", (F.col("i") + 1).alias("page_no"),
        F.array_join(F.slice("p", F.col("i") * F.col("per") + 1, F.col("per")), "\n").alias("text"),
    )


def scanned_split(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds kind (text or scanned by length) and a warning where a scan has some text."""
    n = F.coalesce(F.length(text_col), F.lit(0))
    return df.withColumn("kind", F.when(n >= LEAST_TEXT, "text").otherwise("scanned")).withColumn(
        "warning", F.when((n > 0) & (n < LEAST_TEXT), F.concat(F.lit("page has only "), n.cast("string"), F.lit(" characters of text")))
    )


def too_many_pages(df: DataFrame, id_col: str = "doc_id", most: int = MOST_PAGES) -> DataFrame:
    return df.groupBy(id_col).agg(F.count("*").alias("n_pages")).filter(F.col("n_pages") > most)


def ocr_words(tsv: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, confidence of OCR output in TSV: words with a confidence of 0 and more, and its mean (-1 without)."""
    lines = F.slice(F.split(text_col, "\r?\n"), 2, 1 << 30)
    rows = F.filter(F.transform(lines, lambda x: F.split(x, "\t", -1)), lambda r: F.size(r) >= 12)
    good = F.filter(rows, lambda r: (F.trim(r[11]) != "") & (F.coalesce(r[10].try_cast("double"), F.lit(-1.0)) >= 0))
    total = F.aggregate(good, F.lit(0.0), lambda a, r: a + r[10].try_cast("double"))
    return tsv.select(
        F.col(id_col).alias("doc_id"),
        F.array_join(F.transform(good, lambda r: F.trim(r[11])), " ").alias("text"),
        F.when(F.size(good) > 0, total / F.size(good)).otherwise(F.lit(-1.0)).alias("confidence"),
    )


def extracted(files: DataFrame, extract: Callable[[bytes, str], list[tuple[str, float | None]]] | None = None) -> DataFrame:
    """Pages of binary files (path, content) by a provider: bytes and path to (text, confidence) of each page.

    Without a provider the first file that needs one fails, naming what is missing.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                if extract is None:
                    raise RuntimeError(f"{path}: no provider for this format is set")
                for i, (text, confidence) in enumerate(extract(content, path)):
                    rows.append((path, i + 1, text, confidence))
            yield pd.DataFrame(rows, columns=["doc_id", "page_no", "text", "confidence"])

    return files.select("path", "content").mapInPandas(run, "doc_id string, page_no int, text string, confidence double")
