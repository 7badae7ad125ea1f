"""Text, links and metadata of DOCX files; checks of the archive; a hook for other readers."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.functions import lexicons as lex
from siftwork.sources.uploads import MIB

MAX_UNPACKED = 80 * MIB
MAX_RATIO = 100
MAX_PAGES = 80
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_CORE = {
    "title": "{http://purl.org/dc/elements/1.1/}title",
    "author": "{http://purl.org/dc/elements/1.1/}creator",
    "created": "{http://purl.org/dc/terms/}created",
    "modified": "{http://purl.org/dc/terms/}modified",
}
SCHEMA = "path string, error string, text string, n_images int, title string, author string, created string, modified string"


def archive_error(archive: zipfile.ZipFile) -> str | None:
    """Why an archive must not be opened further, or None."""
    members = archive.infolist()
    unpacked, packed = sum(m.file_size for m in members), sum(m.compress_size for m in members)
    if unpacked > MAX_UNPACKED:
        return "too_large_unpacked"
    if unpacked > MAX_RATIO * max(1, packed):
        return "compression_ratio"
    if any(m.filename.lower().endswith(lex.EXECUTABLE_SUFFIXES) for m in members):
        return "executable_member"
    return None


def _words(node: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_W}t"))


def read_docx(content: bytes) -> dict:
    """Paragraphs that are not blank, then table rows with their cells joined by bars; metadata; images."""
    out: dict = dict.fromkeys(("error", "text", "title", "author", "created", "modified")) | {"n_images": 0}
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            if error := archive_error(archive):
                return out | {"error": error}
            out["n_images"] = sum(n.startswith("word/media/") for n in archive.namelist())
            body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{_W}body")
            lines = [_words(p) for p in body.findall(f"{_W}p")]
            for row in body.iter(f"{_W}tr"):
                cells = [_words(c).strip() for c in row.findall(f"{_W}tc")]
                lines.append(" | ".join(c for c in cells if c))
            out["text"] = "\n".join(x for x in lines if x.strip())
            if "docProps/core.xml" in archive.namelist():
                core = ElementTree.fromstring(archive.read("docProps/core.xml"))
                out |= {k: core.findtext(tag) for k, tag in _CORE.items()}
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, AttributeError):
        out["error"] = "unreadable"
    return out


def extract(files: DataFrame, reader: Callable[[bytes], dict] = read_docx) -> DataFrame:
    """Read files (path, content) in the tasks that hold them; a file that can't be read gets its error."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for batch in batches:
            rows = [{"path": p, **reader(bytes(c))} for p, c in zip(batch["path"], batch["content"], strict=True)]
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(read, SCHEMA)


def pages_status(n_pages, encrypted):
    """ok, or why a paged document is refused."""
    return F.when(encrypted, "encrypted").when(n_pages > MAX_PAGES, "too_many_pages").otherwise("ok")
