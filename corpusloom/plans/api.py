"""What a user calls: texts and files to chunks, documents and results."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import chunks as C
from corpusloom.operators import hierarchy as H
from corpusloom.operators import numbering, relations, tables
from corpusloom.plans.options import ChunkOptions
from corpusloom.sources import files as S

Readers = Mapping[str, Callable[[bytes], list[str]]]
#: What a chunk tells of itself when it becomes a document.
_CHUNK = ("chunk_id", "chunk_number", "section_number", "word_count", "char_count", "contains_lists", "table_id", "is_complete_section", "start_pos", "end_pos", "chunk_type")


def split_text(docs: DataFrame, options: ChunkOptions = ChunkOptions(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, section_idx, chunk_number, content``: the chunks of every text."""
    return C.chunks(H.sections(docs, id_col, text_col), options).select("doc_id", "section_idx", "chunk_number", "content")


def create_documents(docs: DataFrame, options: ChunkOptions = ChunkOptions(), id_col: str = "doc_id", text_col: str = "text", meta_col: str = "metadata") -> DataFrame:
    """``doc_id, page_content, metadata``: the chunks of every text, each with its document's metadata, a map of strings.

    The metadata goes along with the text, so rows of one id, or without an id, keep theirs.
    """
    found = C.chunks(H.sections(docs, id_col, text_col, kept=F.col(meta_col)), options)
    return found.select("doc_id", F.col("content").alias("page_content"), F.col("kept").alias("metadata"))


def _told(names: tuple[str, ...]) -> Column:
    """A map of the columns that aren't null."""
    entries = F.filter(F.array(*(F.struct(F.lit(n).alias("key"), F.col(n).cast("string").alias("value")) for n in names)), lambda e: e["value"].isNotNull())
    return F.map_from_entries(entries)


def split_documents(docs: DataFrame, options: ChunkOptions = ChunkOptions(), id_col: str = "doc_id", text_col: str = "page_content", meta_col: str = "metadata", files: DataFrame | None = None, readers: Readers | None = None) -> DataFrame:
    """``doc_id, page_content, metadata``: documents cut into chunks.

    A document whose metadata names as ``source`` one of ``files`` (as ``walk`` gives them) is replaced by that file's chunks and
    table chunks, whose own metadata wins over the document's. Of a file that can't be read, and without a file, the
    document's text is cut, and its metadata stays as it is.
    """
    if files is None:
        return create_documents(docs, options, id_col, text_col, meta_col)
    path = lambda c: F.regexp_replace(c, r"^file:/*", "/")
    result = process_files(docs.sparkSession, "", options, readers, files)
    sound = result["summary"].select(path(F.col("doc_id")).alias("at")).distinct()
    here = docs.withColumn("_at", path(F.try_element_at(meta_col, F.lit("source"))))
    plain = create_documents(here.join(sound, F.col("_at") == F.col("at"), "left_anti"), options, id_col, text_col, meta_col)
    body = result["chunks"].select(path(F.col("doc_id")).alias("at"), F.col("content").alias("page_content"), _told(_CHUNK).alias("own"))
    cells = result["table_chunks"].select(path(F.col("doc_id")).alias("at"), F.col("content").alias("page_content"), _told((*_CHUNK, "table_name")).alias("own"))
    joined = here.select(F.col(id_col).alias("doc_id"), "_at", F.coalesce(meta_col, F.create_map().cast("map<string,string>")).alias("meta")).join(body.unionByName(cells), F.col("_at") == F.col("at"))
    kept = F.map_filter("meta", lambda k, _: ~F.map_contains_key("own", k))
    return plain.unionByName(joined.select("doc_id", "page_content", F.map_concat(kept, "own").alias("metadata")))


def process_text(docs: DataFrame, options: ChunkOptions = ChunkOptions(), id_col: str = "doc_id", text_col: str = "text") -> dict[str, DataFrame]:
    """The tables of a full result: sections, chunks, toc_chunks and a summary of each document."""
    sections = H.sections(docs, id_col, text_col)
    found = C.chunks(sections, options)
    toc = C.toc_lines(docs, id_col, text_col)
    counts = found.groupBy("doc_id").agg(F.count("*").alias("total_chunks"))
    summary = sections.groupBy("doc_id").agg(F.count("*").alias("total_sections"))
    ids = docs.select(F.col(id_col).alias("doc_id")).distinct()
    for more in (summary, counts, toc.select("doc_id", F.lit(True).alias("has_toc")).distinct()):
        ids = relations._matched(ids, more, ["doc_id"])
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    summary = ids.select("doc_id", zero("total_sections"), zero("total_chunks"), F.lit(options.target_level).alias("target_level"), F.lit(options.max_chunk_size).alias("max_chunk_size"), F.coalesce("has_toc", F.lit(False)).alias("has_toc"))
    shown = relations._matched(sections, C.section_chunk_ids(found), ["doc_id", "section_idx"]).withColumn("chunks", F.coalesce("chunks", F.array().cast("array<string>")))
    return {"sections": shown if options.include_section_content else shown.drop("content"), "chunks": found, "toc_chunks": C.toc_chunks(toc, options.max_chunk_size), "summary": summary}


def chunks_by_level(docs: DataFrame, level: int, options: ChunkOptions = ChunkOptions(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The chunks with another target level."""
    return C.chunks(H.sections(docs, id_col, text_col), replace(options, target_level=level))


def process_files(spark: SparkSession, path: str, options: ChunkOptions = ChunkOptions(), readers: Readers | None = None, files: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables of a full result for the files below a path: ``process_text`` for each, its tables as sections of their own and as
    ``table_chunks``, and ``errors`` for files that can't be read. ``doc_id`` is the path, ``texts`` the extracted text.

    Text files are read natively, DOCX by its XML, other formats by ``readers``. The parsed DOCX rows are kept, as several tables
    are made of them.
    """
    files = S.walk(spark, path) if files is None else files
    readers = readers or {}
    rows = S.read_docx(files).persist()
    plain = S.read_texts(files.where(~F.col("suffix").isin("docx", *readers)))
    if readers:
        plain = plain.unionByName(S.read_elements(files, readers))
    given = rows.where("kind = 'paragraph'").select(F.col("path").alias("doc_id"), F.col("idx").alias("para_idx"), "text", "levels")
    whole = numbering.restore_paragraphs(given).select("doc_id", F.col("para_idx").alias("given_idx"), F.expr("row_number() OVER (PARTITION BY doc_id ORDER BY para_idx) - 1").alias("para_idx"), F.col("restored_text").alias("text"))
    ordered = F.array_sort(F.collect_list(F.struct("para_idx", "text")))
    office = whole.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda p: p["text"]), "\n").alias("text"))
    docs = plain.where("error is null").select(F.col("path").alias("doc_id"), "text").unionByName(office)
    errors = plain.where("error is not null").select("path", "error").unionByName(rows.where("kind = 'error'").select("path", "error"))
    result = process_text(docs, options)

    cells = rows.where("kind = 'cell' AND para_before IS NOT NULL").select(F.col("path").alias("doc_id"), (F.col("idx") + 1).cast("int").alias("table_idx"), "row", "ord", "colspan", "vmerge", "text", "para_before")
    spots = cells.groupBy("doc_id", "table_idx").agg(F.first("para_before").alias("given_idx"))
    # paragraphs that vanish with their numbers don't count
    before = relations._matched(spots, whole.select("doc_id", F.col("given_idx").alias("other"), "para_idx"), ["doc_id"]).groupBy("doc_id", "table_idx").agg((F.count_if(F.col("other") <= F.col("given_idx")) - 1).alias("paragraph_index_before"))
    names = relations.table_names(whole, before, options.max_name_paragraphs)
    sections = H.sections(docs)
    own = relations.table_subsections(sections, before, names)
    filled = relations._matched(relations._matched(before, names, ["doc_id", "table_idx"]), own.select("doc_id", "table_idx", "number"), ["doc_id", "table_idx"])
    label = lambda word: F.concat(F.lit(word), F.col("table_idx").cast("string"))
    filled = filled.select("doc_id", "table_idx", F.coalesce(F.nullif("name", F.lit("")), label("Таблица ")).alias("name"), F.coalesce("number", label("Table_")).alias("number"))
    grids = tables.origin_cells(cells.drop("para_before"))
    pieces = tables.chunks(grids, filled.select("doc_id", "table_idx", "name"), options.max_chunk_size)
    table_chunks = relations._matched(pieces, filled, ["doc_id", "table_idx"]).select(
        "doc_id", "table_idx", "chunk_number", F.sha2(F.concat_ws("|", "doc_id", F.lit("table"), F.col("table_idx").cast("string"), F.col("chunk_number").cast("string")), 256).alias("chunk_id"), "content", F.col("number").alias("section_number"),
        T.word_count(F.col("content")).alias("word_count"), F.length("content").alias("char_count"), F.lit(False).alias("contains_lists"), label("Table_").alias("table_id"), F.lit(False).alias("is_complete_section"), F.lit(0).alias("start_pos"), F.length("content").alias("end_pos"), F.lit("table").alias("chunk_type"), F.col("name").alias("table_name"),
    )
    counts = before.groupBy("doc_id").agg(F.count("*").alias("tables_count"))
    summary = relations._matched(result["summary"], counts, ["doc_id"]).withColumn("tables_count", F.coalesce("tables_count", F.lit(0)))
    shown = relations.with_table_subsections(result["sections"], own)
    shown = shown if options.include_section_content else shown.drop("content")
    full = tables.documents(grids, filled.select("doc_id", "table_idx", "name"))
    return result | {"sections": shown, "table_chunks": table_chunks, "summary": summary, "errors": errors, "cells": grids, "tables": full, "texts": docs, "toc": C.toc_lines(docs)}


def folder_summary(result: dict[str, DataFrame]) -> DataFrame:
    """``total_files, successful, failed`` of the files of a result."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    each = result["summary"].select(one.alias("successful"), none.alias("failed")).unionByName(result["errors"].select(none.alias("successful"), one.alias("failed")))
    total = lambda c: F.coalesce(F.sum(c), none)
    return each.agg(F.count("*").alias("total_files"), total("successful").alias("successful"), total("failed").alias("failed"))


def nested_results(result: dict[str, DataFrame]) -> DataFrame:
    """A row a document: ``file_path, sections, chunks, toc_chunks, table_chunks, metadata``, each table's rows in order."""
    rows = result["summary"].select(F.col("doc_id").cast("string").alias("file_path"), F.struct(*(c for c in result["summary"].columns if c != "doc_id")).alias("metadata"))
    for name, order in (("sections", ["section_idx"]), ("chunks", ["section_idx", "chunk_number"]), ("toc_chunks", ["chunk_number"]), ("table_chunks", ["table_idx", "chunk_number"])):
        if name in result:
            table = result[name]
            each = F.struct(*order, *(c for c in table.columns if c not in ("doc_id", *order)))
            got = table.groupBy(F.col("doc_id").cast("string").alias("file_path")).agg(F.array_sort(F.collect_list(each), lambda a, b: _before(a, b, order)).alias(name))
            rows = rows.join(got, "file_path", "left").withColumn(name, F.coalesce(name, F.expr(f"slice(from_json('[]', '{got.schema[name].dataType.simpleString()}'), 1, 0)")))
    return rows


def _before(a: Column, b: Column, order: list[str]) -> Column:
    """An order of structs by a few fields, as the others may not be comparable."""
    found = F.lit(0)
    for c in reversed(order):
        found = F.when(a[c] < b[c], F.lit(-1)).when(a[c] > b[c], F.lit(1)).otherwise(found)
    return found


def save_json(result: dict[str, DataFrame], path: str) -> None:
    """Results as JSON, a document a line, letters of any script as they are."""
    nested_results(result).write.mode("overwrite").json(path)


def save(result: dict[str, DataFrame], path: str, options: ChunkOptions = ChunkOptions()) -> None:
    """Each table of a result as a Parquet folder; by option also the extracted texts, tables of contents and tables' JSON as text files, in a folder for each document."""
    for name, table in result.items():
        if name not in ("texts", "toc", "tables", "cells"):
            table.write.mode("overwrite").parquet(f"{path}/{name}")
    stem = F.regexp_replace(F.element_at(F.split(F.col("doc_id").cast("string"), "/"), -1), r"\.[^.]*$", "")

    def texts(table: DataFrame, value: Column, end: Column) -> None:
        table.select(F.concat(stem, end).alias("name"), value.alias("value")).repartition("name").write.mode("overwrite").partitionBy("name").text(f"{path}/text")

    found = []
    if options.save_text and "texts" in result:
        found.append(result["texts"].select("doc_id", F.col("text").alias("value"), F.lit("_extracted.txt").alias("end")))
    if options.save_toc and "toc" in result:
        found.append(result["toc"].select("doc_id", F.array_join("lines", "\n").alias("value"), F.lit("_toc.txt").alias("end")))
    if options.save_table_json and "tables" in result:
        bare = F.regexp_replace("content", r"^```json\n|\n```$", "")
        found.append(result["tables"].where("content is not null").select("doc_id", bare.alias("value"), F.concat(F.lit("_table_"), F.col("table_idx").cast("string"), F.lit(".json")).alias("end")))
    if found:
        every = found[0]
        for more in found[1:]:
            every = every.unionByName(more)
        texts(every, F.col("value"), F.col("end"))


def section_documents(sections: DataFrame, table_chunks: DataFrame | None = None) -> DataFrame:
    """``doc_id, page_content, metadata``: each section with content as a document, and each table chunk."""
    listed = lambda c: F.to_json(F.coalesce(c, F.array().cast("array<string>")))
    told = sections.where(F.regexp_like("content", F.lit(r"(?U)\S"))).select(
        "doc_id", F.col("content").alias("page_content"), F.col("number").alias("section_number"), F.col("title").alias("section_title"), F.col("level").alias("section_level"), "parent_number",
        listed("children").alias("children"), listed("tables").alias("tables"), F.lit("section").alias("source_type"), F.length("content").alias("char_count"), T.word_count(F.col("content")).alias("word_count"),
    )
    names = tuple(c for c in told.columns if c not in ("doc_id", "page_content"))
    found = told.select("doc_id", "page_content", _told(names).alias("metadata"))
    if table_chunks is None:
        return found
    cells = table_chunks.where("content <> ''").withColumn("source_type", F.lit("table"))
    return found.unionByName(cells.select("doc_id", F.col("content").alias("page_content"), _told((*_CHUNK, "table_name", "source_type")).alias("metadata")))


def toc_documents(toc: DataFrame) -> DataFrame:
    """``doc_id, page_content, metadata``: each table of contents (doc_id, toc) that isn't blank as one document."""
    told = toc.where(F.regexp_like("toc", F.lit(r"(?U)\S"))).select(
        "doc_id", F.col("toc").alias("page_content"), F.lit("toc").alias("source_type"), F.lit("0").alias("section_number"), F.lit("Table of Contents").alias("section_title"), F.lit("0").alias("section_level"), F.length("toc").alias("char_count"), T.word_count(F.col("toc")).alias("word_count")
    )
    return told.select("doc_id", "page_content", _told(("source_type", "section_number", "section_title", "section_level", "char_count", "word_count")).alias("metadata"))


def convert(spark: SparkSession, path: str, toc_path: str | None = None, include_tables: bool = True, include_toc: bool = False) -> DataFrame:
    """``doc_id, page_content, metadata``: saved results as documents, their chunks left aside."""
    saved = S.read_results(spark, path)
    id_col = F.col("file_path").alias("doc_id") if "file_path" in saved.columns else F.lit(path).alias("doc_id")

    def table(name: str) -> DataFrame | None:
        if name not in saved.columns or not saved.schema[name].dataType.simpleString().startswith("array<struct"):
            return None
        return saved.select(id_col, F.explode(name).alias("x")).select("doc_id", "x.*")

    def filled(rows: DataFrame, **kinds: str) -> DataFrame:
        return rows.select("doc_id", *((F.col(c) if c in rows.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()))

    sections = filled(table("sections"), number="string", title="string", level="int", parent_number="string", children="array<string>", tables="array<string>", content="string")
    chunks = table("table_chunks") if include_tables else None
    if chunks is not None:
        if "metadata" in chunks.columns:
            chunks = chunks.select("doc_id", "content", "metadata.*")
        chunks = filled(chunks, content="string", **dict.fromkeys((*_CHUNK, "table_name"), "string"))
    found = section_documents(sections, chunks)
    if include_toc and toc_path:
        found = found.unionByName(toc_documents(S.read_toc(spark, toc_path).select(F.col("path").alias("doc_id"), "toc")))
    return found
