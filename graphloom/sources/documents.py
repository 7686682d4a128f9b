"""Documents, pages and knowledge bases as tables."""

from __future__ import annotations

import io
import re
import zipfile
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text


def pdf_text(data: bytes) -> str:
    """The text that a PDF's content streams show: plain or deflated streams, literal strings of Tj and TJ."""
    if not data:
        raise ValueError("empty file")
    if not data.startswith(b"%PDF"):
        raise ValueError("not a PDF")
    out = []
    for m in re.finditer(rb"stream\r?\n(.*?)\r?\nendstream", data, re.S):
        body = m[1]
        try:
            body = zlib.decompress(body)
        except zlib.error:
            pass
        for block in re.findall(rb"BT(.*?)ET", body, re.S):
            line = b"".join(re.sub(rb"\\([()\\])", rb"\1", s) for s in re.findall(rb"\(((?:\\.|[^\\()])*)\)", block))
            out.append(line.decode("latin-1"))
    if not "".join(out).strip():
        raise ValueError("no text")
    return "\n".join(out)


def docx_text(data: bytes) -> str:
    """Paragraphs of a .docx, one a line."""
    import xml.etree.ElementTree as ET

    root, w = ET.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")), "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    return "\n".join("".join(t.text or "" for t in p.iter(f"{w}t")) for p in root.iter(f"{w}p"))


PARSERS = {"pdf": pdf_text, "docx": docx_text, "txt": lambda b: b.decode("utf-8", "replace"), "md": lambda b: b.decode("utf-8", "replace")}


#: Bytes of files that a task parses before it sends their texts on.
SLICE = 1 << 22


def load_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, error) of .pdf, .docx, .txt and .md files of a folder."""
    return parse_documents(spark.read.format("binaryFile").load(path).select("path", "content"))


def parse_documents(files: DataFrame) -> DataFrame:
    """(path, text, error) of files (path, content), by suffix; another suffix or a file that can't be parsed has an error instead of a text."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in batches:
            # a batch is parsed and sent back in slices of about SLICE bytes, so that it isn't held again as objects, texts and a result
            size = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // SLICE
            cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), b.num_rows]
            for i, j in zip(cuts, cuts[1:], strict=False):
                out = []
                for p, data in zip(b.column(0)[i:j].to_pylist(), b.column(1)[i:j].to_pylist(), strict=True):
                    kind = p.rsplit(".", 1)[-1].lower()
                    try:
                        if kind not in PARSERS:
                            raise ValueError(f"unsupported file type: .{kind}")
                        out.append((p, PARSERS[kind](bytes(data)), None))
                    except Exception as e:
                        out.append((p, None, str(e)))
                columns = zip(*out, strict=True) if out else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["path", "text", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, text string, error string")


def page_rows(pages: DataFrame, most: int | None = None) -> DataFrame:
    """page_id, url, content, fidelity of pages (page_id, url, html). most cuts the content, for callers that feed a model (8,000 characters)."""
    return pages.select("page_id", "url", text.html_text("html", most).alias("content"), text.fidelity("url").alias("fidelity"))


def read_node_link(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of node-link JSON files; node_link.read_kb has all that they hold."""
    from .node_link import read_kb

    kb = read_kb(spark, path)
    return kb["nodes"], kb["edges"]
