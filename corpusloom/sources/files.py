"""Files of documents as DataFrames: text files natively, DOCX by a parser of its XML in Arrow batches."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator, Mapping
from pathlib import Path
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T

SUFFIXES = ("docx", "doc", "txt", "md", "pdf")
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
DOCX = "path string, kind string, idx long, para_before long, text string, levels array<int>, row int, ord int, colspan int, vmerge string, error string"


def walk(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, content, suffix`` of the supported files below a path; names that begin with ~ are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.regexp_extract(name, r"\.([A-Za-z]+)$", 1))
    return files.withColumn("suffix", suffix).where(~F.startswith(name, F.lit("~"))).where(F.col("suffix").isin(*SUFFIXES))


def read_texts(files: DataFrame) -> DataFrame:
    """``path, text, error``: text of text files; other formats have an error instead, so that one bad file stops nothing."""
    known = F.col("suffix").isin("txt", "md")
    return files.select("path", F.when(known, T.plain_text(F.col("content"))).alias("text"), F.when(~known, F.concat(F.lit("no text reader for ."), "suffix")).alias("error"))


def read_elements(files: DataFrame, readers: Mapping[str, Callable[[bytes], list[str]]]) -> DataFrame:
    """``path, text, error`` of files whose suffix has a reader, a function from bytes to the texts of elements: these, stripped, without empty ones, as lines."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for path, suffix, content in zip(batch["path"], batch["suffix"], batch["content"], strict=True):
                try:
                    found.append((path, "\n".join(x for x in (str(e).strip() for e in readers[suffix](bytes(content))) if x), None))
                except Exception as why:  # noqa: BLE001, a reader of any kind may fail in any way
                    found.append((path, None, f"{type(why).__name__}: {why}"))
            yield pd.DataFrame(found, columns=["path", "text", "error"])

    return files.where(F.col("suffix").isin(*readers)).select("path", "suffix", "content").mapInPandas(run, "path string, text string, error string")


def paragraphs(texts: DataFrame) -> DataFrame:
    """``path, para_idx, text``: the lines of texts without blank ones, trailing blanks dropped."""
    kept = F.filter(F.transform(F.split("text", "\n"), lambda x: F.regexp_replace(x, r"(?U)\s+$", "")), lambda x: x != "")
    return texts.select("path", F.posexplode_outer(kept).alias("para_idx", "text")).where("para_idx is not null")


def _numbering(book: zipfile.ZipFile) -> dict[str, str]:
    """The abstract list of each list."""
    if "word/numbering.xml" not in book.namelist():
        return {}
    root = ElementTree.fromstring(book.read("word/numbering.xml"))
    return {n.get(_W + "numId"): n.find(_W + "abstractNumId").get(_W + "val") for n in root.iter(_W + "num") if n.find(_W + "abstractNumId") is not None}


def _text(node: ElementTree.Element) -> str:
    return "".join("\t" if x.tag == _W + "tab" else x.text or "" for x in node.iter() if x.tag in (_W + "t", _W + "tab"))


def docx_rows(path: str, content: bytes) -> list[dict]:
    """Paragraphs outside tables with their list levels, and the cells of all tables, nested ones too; one error row if the file can't be read, for whatever reason.

    A run of tables without a paragraph between them counts as one; the runs' places go to the tables in order, and tables
    beyond the number of runs have none.
    """
    try:
        return list(_docx_rows(path, content))
    except Exception as why:  # noqa: BLE001, archives and XML fail in many ways
        return [{"path": path, "kind": "error", "error": f"{type(why).__name__}: {why}"}]


def _docx_rows(path: str, content: bytes) -> Iterator[dict]:
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        lists, body = _numbering(book), ElementTree.fromstring(book.read("word/document.xml")).find(_W + "body")
    counters: dict[str, list[int]] = {}
    at, inside = -1, False
    tables: list[ElementTree.Element] = []
    runs: list[int] = []
    for node in body if body is not None else ():
        if node.tag == _W + "tbl":
            tables += node.iter(_W + "tbl")
            if not inside and _text(node).strip():
                runs.append(at)
                inside = True
        elif node.tag == _W + "p" and _text(node).strip():
            at, inside = at + 1, False
            levels: list[int] = []
            spot = node.find(f"{_W}pPr/{_W}numPr")
            if spot is not None and spot.find(_W + "numId") is not None:
                own = spot.find(_W + "numId").get(_W + "val")
                depth = spot.find(_W + "ilvl")
                level = int(depth.get(_W + "val")) if depth is not None else 0
                count = counters.setdefault(lists.get(own, own), [])
                count += [0] * (level + 1 - len(count))
                count[level] += 1
                del count[level + 1 :]
                levels = [max(1, c) for c in count]
            yield {"path": path, "kind": "paragraph", "idx": at, "text": _text(node), "levels": levels}
    for t, table in enumerate(tables):
        for r, row in enumerate(table.findall(_W + "tr")):
            for o, cell in enumerate(row.findall(_W + "tc")):
                span, merge = cell.find(f"{_W}tcPr/{_W}gridSpan"), cell.find(f"{_W}tcPr/{_W}vMerge")
                yield {
                    "path": path, "kind": "cell", "idx": t, "para_before": runs[t] if t < len(runs) else None, "text": "".join(x.text or "" for x in cell.iter(_W + "t")), "row": r, "ord": o,
                    "colspan": int(span.get(_W + "val")) if span is not None else 1, "vmerge": None if merge is None else merge.get(_W + "val") or "continue",
                }


def read_docx(files: DataFrame) -> DataFrame:
    """Rows of ``docx_rows`` for the DOCX files."""
    names = [f.split()[0] for f in DOCX.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                rows = [{n: r.get(n) for n in names} for r in docx_rows(path, bytes(content))]
                out = pd.DataFrame(rows, columns=names)
                for n in ("idx", "para_before", "row", "ord", "colspan"):
                    out[n] = out[n].astype("Int64")
                yield out

    return files.where("suffix = 'docx'").select("path", "content").mapInPandas(run, DOCX)


def read_results(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Results that were saved as JSON, one a line or one a file."""
    reader = spark.read.option("multiLine", "true") if path.endswith(".json") else spark.read
    return (reader.schema(schema) if schema else reader).json(path)


def read_toc(spark: SparkSession, path: str) -> DataFrame:
    """``path, toc``: saved tables of contents, a file each."""
    return spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("toc"))


def find_results(name: str, folder: str) -> tuple[str | None, str | None]:
    """The saved result and the table of contents of a document by its name, None where there is none."""
    found = [Path(folder, f"{name}{end}") for end in ("_hierarchical.json", "_toc.txt")]
    return tuple(str(p) if p.exists() else None for p in found)
