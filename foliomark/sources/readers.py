"""Readers: documents of several file formats, web pages, histories of runs."""

from __future__ import annotations

import io
import re
import zipfile
from html.parser import HTMLParser
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_text, document_key, paragraphs, pieces, tokens
from ..plans.session import arrow_map

EXTENSIONS = ("pdf", "docx", "txt", "md", "html", "png", "jpg", "jpeg")
_WORD_XML = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def decode(content: bytes) -> str:
    """UTF-8, then UTF-16 where a byte order mark asks for it, else Latin-1."""
    if content[:2] in (b"\xff\xfe", b"\xfe\xff"):
        try:
            return content.decode("utf-16")
        except UnicodeDecodeError:
            pass
    try:
        return content.decode("utf-8-sig")
    except UnicodeDecodeError:
        return content.decode("latin-1")


def docx_text(content: bytes) -> str:
    """Non-blank paragraphs of a word-processor file, parted by blank lines."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        root = ElementTree.fromstring(archive.read("word/document.xml"))
    found = ("".join(t.text or "" for t in p.iter(f"{_WORD_XML}t")) for p in root.iter(f"{_WORD_XML}p"))
    return "\n\n".join(p for p in found if p.strip())


def pdf_pages(content: bytes) -> list[str]:
    """Texts of the pages, with whichever PDF library is installed; an error where none is."""
    try:
        import fitz

        with fitz.open(stream=content, filetype="pdf") as doc:
            return [page.get_text() for page in doc]
    except ImportError:
        pass
    try:
        from pypdf import PdfReader

        return [page.extract_text() or "" for page in PdfReader(io.BytesIO(content)).pages]
    except ImportError as error:
        raise RuntimeError("no PDF library is installed") from error


def image_text(content: bytes, languages: str = "eng") -> str:
    """Text of an image by an installed recognizer; an error where none is."""
    try:
        import pytesseract
        from PIL import Image
    except ImportError as error:
        raise RuntimeError("no text recognizer is installed") from error
    return pytesseract.image_to_string(Image.open(io.BytesIO(content)), lang=languages)


class _Visible(HTMLParser):
    hidden = frozenset("script style nav footer header".split())

    def __init__(self) -> None:
        super().__init__()
        self.depth, self.parts = 0, []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.depth += tag in self.hidden

    def handle_endtag(self, tag: str) -> None:
        self.depth = max(0, self.depth - (tag in self.hidden))

    def handle_data(self, data: str) -> None:
        if not self.depth:
            self.parts.append(data)


def page_text(html: str) -> str:
    """Visible text of a page on collapsed blanks."""
    reader = _Visible()
    reader.feed(html)
    return re.sub(r"\s+", " ", " ".join(reader.parts)).strip()


def parse(path: str, content: bytes) -> tuple[str | None, int, str]:
    """(text, pages, error) of a file by its extension; an error leaves the text null."""
    extension = path.rsplit(".", 1)[-1].lower()
    try:
        if extension == "pdf":
            found = pdf_pages(content)
            return "\n\n".join(found), len(found), ""
        if extension == "docx":
            return docx_text(content), 1, ""
        if extension in ("txt", "md"):
            return decode(content), 1, ""
        if extension in ("html", "htm"):
            return page_text(decode(content)), 1, ""
        if extension in ("png", "jpg", "jpeg"):
            return image_text(content), 1, ""
        return None, 0, f"unsupported file type .{extension}"
    except Exception as error:  # a broken file is a row, not the end of the job
        return None, 0, f"{type(error).__name__}: {error}"[:300]


def read_documents(spark: SparkSession, path: str, role: str = "submitted", recursive: bool = False) -> DataFrame:
    """(path, title, text, page_count, word_count, document_id, doc_role, error) of every supported file of a folder or glob."""
    binary = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path).select("path", "content")
    supported = binary.filter(F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).isin(*EXTENSIONS))

    def run(paths, contents):
        rows = [parse(p, c) for p, c in zip(paths, contents)]
        return paths, [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]

    parsed = arrow_map(supported, run, "path string, text string, page_count int, error string")
    return with_facts(parsed.withColumn("text", clean_text(F.col("text"))).withColumn("title", F.regexp_extract("path", r"([^/]+?)(?:\.[^./]+)?$", 1)).withColumn("doc_role", F.lit(role)))


def with_facts(df: DataFrame) -> DataFrame:
    """Adds document_id (none for null and empty texts) and word_count to a table with a text."""
    return df.withColumn("document_id", F.when(F.length("text") > 0, document_key(F.col("text")))).withColumn("word_count", F.size(F.coalesce(tokens(F.col("text")), F.array().cast("array<string>"))))


def paragraph_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, paragraph_index, text, word_count) of the non-blank blocks between blank lines; the index counts blank ones too."""
    rows = df.select(id_col, F.posexplode(F.split(text_col, "\n\n")).alias("paragraph_index", "text"))
    return rows.withColumn("word_count", F.size(pieces(F.col("text")))).filter("word_count > 0")


def read_pages(spark: SparkSession, path: str, least_chars: int = 200) -> DataFrame:
    """(page_id, url, text) of stored pages (page_id, url, html) whose visible text is longer than ``least_chars``."""
    from ..functions.text import html_text

    pages = spark.read.parquet(path).select("page_id", "url", html_text(F.col("html")).alias("text"))
    return pages.filter(F.length("text") > least_chars)


def read_history(spark: SparkSession, folder: str, k: int = 50) -> DataFrame:
    """The k newest run files (run_id, name, saved_at, result); unreadable files are skipped."""
    schema = "run_id string, name string, saved_at string, result string, _corrupt string"
    runs = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("multiLine", "true").json(folder)
    return runs.filter("run_id is not null").drop("_corrupt").orderBy(F.desc("saved_at"), "run_id").limit(k)
