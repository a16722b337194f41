"""Size-bounded chunks of sections, and of tables of contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import greedy
from corpusloom.operators.hierarchy import settled
from corpusloom.plans.options import ChunkOptions


def target_sections(sections: DataFrame, level: int) -> DataFrame:
    """Sections of the level, tables, and leaves with content; the text of others is in no chunk."""
    leaf = (F.size("children") == 0) & (T.strip(F.col("content")) != "")
    return sections.where((F.col("level") == level) | T.is_table_number(F.col("number")) | leaf)


def chunk_key(*parts: str) -> Column:
    """A lasting id, as a random one would change whenever a task is repeated."""
    return F.sha2(F.concat_ws("|", *(F.col(p).cast("string") for p in parts)), 256)


def chunks(sections: DataFrame, options: ChunkOptions = ChunkOptions()) -> DataFrame:
    """The chunks of the target sections, with their metadata; sections are packed within their row.

    Sizes are soft: overlap and the next element may exceed the maximum together. Counts and ``contains_lists``
    describe the section; positions are counted as if a newline followed every element.
    """
    most, overlap = options.max_chunk_size, options.chunk_overlap
    body = settled(target_sections(sections, options.target_level), body=T.normalize_whitespace(F.col("content"))).drop("content")
    fenced = F.startswith("body", F.lit("Таблица")) & F.contains("body", F.lit("```json"))
    lines = F.filter(F.transform(F.split("body", "\n"), T.strip), lambda x: x != "")
    body = settled(body, els=F.when(fenced, F.array("body")).otherwise(lines))
    body = settled(body, sizes=F.transform("els", F.length))
    fits = F.length("body") <= most
    body = body.withColumn("ranges", greedy.ranges(f"CASE WHEN length(body) > {most} THEN sizes END", most, overlap))
    whole = F.array(F.struct(F.col("body").alias("content"), F.lit(0).alias("start_pos"), F.length("body").alias("end_pos"), F.lit(0).alias("first"), F.lit(0).alias("last")))
    body = settled(
        body.withColumn("is_complete_section", fits),
        parts=F.when(fits, whole).otherwise(greedy.pieces("els", "ranges")), word_count=T.word_count(F.col("body")), char_count=F.length("body"), contains_lists=T.contains_lists(F.col("body")), stripped=T.strip(F.col("body")),
    ).drop("els", "sizes", "ranges")
    titled = F.col("is_complete_section") & (F.col("stripped").isin(F.col("title")) | (F.col("stripped") == F.concat("number", F.lit(". "), "title")))
    if options.verb is not None:
        titled = titled & ~options.verb(F.col("body"))
    table = T.is_table_number(F.col("number"))
    # a section's text stays behind: it would be copied for each of its chunks
    body = settled(body, kind=F.when(table, "table").when(titled, "section_title").otherwise("section_content")).drop("body", "stripped")
    each = body.select("*", F.posexplode_outer("parts").alias("n", "p")).where("n is not null").withColumn("chunk_number", F.col("n") + 1)
    return each.select(
        "doc_id", "section_idx", "chunk_number", chunk_key("doc_id", "section_idx", "chunk_number").alias("chunk_id"), F.col("p.content").alias("content"), F.col("number").alias("section_number"),
        "word_count", "char_count", "contains_lists", F.when(table, F.col("number")).alias("table_id"),
        "is_complete_section", F.col("p.start_pos").alias("start_pos"), F.col("p.end_pos").alias("end_pos"), F.col("kind").alias("chunk_type"), F.expr("CASE WHEN para_first IS NOT NULL THEN sequence(para_first, para_last) END").alias("paragraph_indices"), *(["kept"] if "kept" in sections.columns else []),
    )


def section_chunk_ids(found: DataFrame) -> DataFrame:
    """``doc_id, section_idx, chunks``: the ids of a section's chunks in order."""
    ordered = F.array_sort(F.collect_list(F.struct("chunk_number", "chunk_id")))
    return found.groupBy("doc_id", "section_idx").agg(F.transform(ordered, lambda x: x["chunk_id"]).alias("chunks"))


def toc_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lines``: the headings and table references of a document."""
    lines = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), lambda x: T.is_section_header(x) | T.is_table_reference(x))
    return docs.select(F.col(id_col).alias("doc_id"), F.transform(lines, T.strip).alias("lines")).where("size(lines) > 0")


def toc_chunks(toc: DataFrame, most: int = 1000) -> DataFrame:
    """``doc_id, chunk_number, content``: whole lines, packed without overlap."""
    rows = settled(toc, sizes=F.transform("lines", F.length)).withColumn("ranges", greedy.ranges("sizes", most, 0, join_in_test=True, cut=False))
    each = rows.select("doc_id", F.posexplode_outer(greedy.pieces("lines", "ranges")).alias("n", "p")).where("n is not null")
    return each.select("doc_id", (F.col("n") + 1).alias("chunk_number"), F.col("p.content").alias("content"), F.lit("toc").alias("chunk_type"), F.lit("0").alias("section_number"))


def virtual_chunks(sections: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """Small sibling leaves, merged: ``doc_id, parent_idx, chunk_number, content, section_numbers, parent_section, num_merged_sections, char_count``.

    Siblings over the size are left to ``oversized_sections``. Roots without children, and the text of sections
    that have children, are in no merged chunk. What joins the parts isn't counted.
    """
    leaves = sections.where((F.size("children") == 0) & F.col("parent_idx").isNotNull() & (F.length("content") <= size))
    grouped = leaves.groupBy("doc_id", "parent_idx", "parent_number").agg(F.array_sort(F.collect_list(F.struct("section_idx", "number", "content"))).alias("kids"))
    grouped = settled(grouped, texts="transform(kids, k -> k.content)", sizes="transform(kids, k -> length(k.content))")
    grouped = grouped.withColumn("ranges", greedy.ranges("sizes", size, overlap, join_in_size=False, cut=False))
    # a group's arrays stay behind: they would be copied for each of its chunks
    numbers = "transform(slice(kids, r.first + 1, r.last - r.first + 1), k -> k.number)"
    each = grouped.select("doc_id", "parent_idx", "parent_number", F.posexplode_outer(greedy.pieces("texts", "ranges", "\\n\\n", numbers=numbers)).alias("n", "p")).where("n is not null")
    return each.select("doc_id", "parent_idx", (F.col("n") + 1).alias("chunk_number"), F.col("p.content").alias("content"), F.col("p.numbers").alias("section_numbers"), F.col("parent_number").alias("parent_section"), (F.col("p.last") - F.col("p.first") + 1).alias("num_merged_sections"), F.length("p.content").alias("char_count"))


def oversized_sections(sections: DataFrame, size: int = 1000) -> DataFrame:
    return sections.where((F.size("children") == 0) & F.col("parent_idx").isNotNull() & (F.length("content") > size))


def merged_chunks(sections: DataFrame, options: ChunkOptions = ChunkOptions()) -> DataFrame:
    """Chunks of merged sibling leaves, and of the leaves too large for that, as one table.

    ``merged`` tells them apart; a merged chunk has ``section_numbers``, ``parent_section`` and ``num_merged_sections``, is complete
    and counts itself; a piece of a large leaf has what ``chunks`` gives it.
    """
    size = options.max_chunk_size
    small = virtual_chunks(sections, size, options.chunk_overlap)
    small = small.select(
        "doc_id", F.col("parent_idx").alias("section_idx"), "chunk_number", F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), F.lit("merged"), F.col("parent_idx").cast("string"), F.col("chunk_number").cast("string")), 256).alias("chunk_id"), "content",
        F.element_at("section_numbers", 1).alias("section_number"), T.word_count(F.col("content")).alias("word_count"), "char_count", T.contains_lists(F.col("content")).alias("contains_lists"), F.lit(True).alias("is_complete_section"),
        F.lit(0).alias("start_pos"), F.length("content").alias("end_pos"), F.lit("section_content").alias("chunk_type"), F.lit(True).alias("merged"), "section_numbers", "parent_section", "num_merged_sections",
    )
    large = chunks(oversized_sections(sections, size), options).withColumn("merged", F.lit(False))
    return small.unionByName(large, allowMissingColumns=True)


def leaf_groups(sections: DataFrame) -> DataFrame:
    """``doc_id, parent_key, numbers, place``: leaves by their parent's number, without one by their number's prefix, else "root"; groups are placed by their first number as text."""
    prefix = F.regexp_extract("number", r"^(.*)\.[^.]*$", 1)
    key = F.coalesce("parent_number", F.when(prefix != "", prefix), F.lit("root"))
    leaves = sections.where(F.size("children") == 0).select("doc_id", key.alias("parent_key"), F.struct("section_idx", "number").alias("s"))
    found = leaves.groupBy("doc_id", "parent_key").agg(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["number"]).alias("numbers"), F.min("s.section_idx").alias("first"))
    return found.withColumn("place", F.expr("row_number() OVER (PARTITION BY doc_id ORDER BY numbers[0], first)")).drop("first")


def chunk_stats(found: DataFrame) -> DataFrame:
    """By chunk type: how many, their characters in total, least, most and on average, and how many hold only part of a section."""
    size = F.length("content")
    return found.groupBy("chunk_type").agg(F.count("*").alias("chunks"), F.sum(size).alias("chars"), F.min(size).alias("shortest"), F.max(size).alias("longest"), F.floor(F.sum(size) / F.count("*")).alias("average"), F.count_if(~F.col("is_complete_section")).alias("incomplete"))
