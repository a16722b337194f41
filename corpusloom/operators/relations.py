"""Relations between sections, paragraphs and tables. A document's id tells it apart; null ids count as one document."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import passes
from corpusloom.operators.hierarchy import settled

#: Members of a family that share a copy of its numbers.
FAMILY_PART = 256


def _matched(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """A join on columns of one name, in which nulls are equal; the right side's other columns have names of their own.

    Neither side goes through the driver: what is gathered from documents or found in them looks smaller to the planner than it is.
    """
    other = right.select(*(F.col(c).alias(f"_{c}" if c in on else c) for c in right.columns)).hint("merge")
    joined = left.join(other, reduce(lambda a, b: a & b, (left[c].eqNullSafe(other[f"_{c}"]) for c in on)), how)
    return joined.drop(*(f"_{c}" for c in on))


def section_context(sections: DataFrame) -> DataFrame:
    """``doc_id, section_idx, number, parent_number, parent_title, children, siblings``: a section among its relatives; a root has no siblings."""
    # a family is gathered once and travels a few times, not with each member: only what is written grows with its square
    told = F.struct("section_idx", "number", "parent_number", "children")
    families = sections.where("parent_idx IS NOT NULL").groupBy("doc_id", "parent_idx").agg(F.array_sort(F.collect_list(told)).alias("family"))
    parents = sections.where(F.size("children") > 0).select("doc_id", F.col("section_idx").alias("parent_idx"), F.col("title").alias("parent_title"))
    rows = _matched(families, parents, ["doc_id", "parent_idx"])
    parts = rows.select("doc_id", "parent_title", F.expr("transform(family, o -> o.number)").alias("numbers"), F.posexplode(F.expr(f"transform(sequence(0, (size(family) - 1) div {FAMILY_PART}), p -> slice(family, p * {FAMILY_PART} + 1, {FAMILY_PART}))")).alias("part", "members"))
    # a number of partitions that stays: by bytes, all of them would be one task's
    many = int(sections.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = parts.repartition(many, "doc_id", "parent_title", "part", F.expr("members[0].number")).select("doc_id", "parent_title", "numbers", F.inline("members"))
    siblings = F.expr("array_remove(numbers, number)")
    members = each.select("doc_id", "section_idx", "number", "parent_number", "parent_title", "children", siblings.alias("siblings"))
    none = F.lit(None).cast("string")
    roots = sections.where("parent_idx IS NULL").select("doc_id", "section_idx", "number", "parent_number", none.alias("parent_title"), "children", F.array().cast("array<string>").alias("siblings"))
    return roots.unionByName(members)


def context_of(sections: DataFrame, wanted: DataFrame) -> DataFrame:
    """``doc_id, number`` of ``wanted`` with the context of the first section of that number, or an ``error`` where there is none."""
    first = F.struct("section_idx", "parent_number", "parent_title", "children", "siblings")
    found = section_context(sections).groupBy("doc_id", "number").agg(F.min_by(first, "section_idx").alias("s"))
    joined = _matched(wanted.select("doc_id", "number"), found, ["doc_id", "number"])
    return joined.select("doc_id", "number", "s.*", F.when(F.col("s").isNull(), F.concat(F.lit("no section "), "number")).alias("error"))


def section_paths(sections: DataFrame) -> DataFrame:
    """``doc_id, section_idx, path``: titles from the root down to the section."""
    rows = sections.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("section_idx", "title", "parent_idx"))).alias("all"))
    # parents come before their children, and section_idx counts from 0 without a hole
    rows = rows.select("doc_id", passes.paths(F.col("all.title"), F.col("all.parent_idx")).alias("paths"))
    return rows.select("doc_id", F.posexplode_outer("paths").alias("section_idx", "path")).where("section_idx is not null")


def paragraph_sections(sections: DataFrame, lines: DataFrame) -> DataFrame:
    """``doc_id, line_idx, section_idx``: of the sections whose range has the paragraph, the last one."""
    # ranges overlap wherever lines are repeated, so they aren't written out
    held = sections.where("para_first is not null").groupBy("doc_id").agg(F.collect_list(F.struct(F.col("section_idx").alias("key"), F.col("para_first").alias("first"), F.col("para_last").alias("last"))).alias("ranges"))
    last = held.select("doc_id", F.posexplode(passes.holders(F.col("ranges"))).alias("line_idx", "section_idx"))
    return _matched(lines.select("doc_id", "line_idx"), last, ["doc_id", "line_idx"])


def table_names(paragraphs: DataFrame, tables: DataFrame, reach: int = 5) -> DataFrame:
    """``doc_id, table_idx, name, caption`` for tables (doc_id, table_idx, paragraph_index_before) of paragraphs (doc_id, para_idx, text).

    The nearest caption at most 2 * reach paragraphs before the one ahead of the table; the name is what stands between it
    and the table, else its own, else empty; without a caption, name and caption are the paragraph before the table. A
    table that has no such paragraph, or a blank one, is left out.
    """
    text = paragraphs.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("para_idx", "text"))), lambda p: p["text"]).alias("ps"))
    rows = _matched(tables.where("paragraph_index_before >= 0").select("doc_id", "table_idx", "paragraph_index_before"), text, ["doc_id"], "inner")
    rows = rows.where("paragraph_index_before < size(ps)").withColumn("near", F.expr(f"slice(ps, greatest(paragraph_index_before - {2 * reach}, 0) + 1, least(paragraph_index_before, {2 * reach}) + 1)")).drop("ps")
    rows = settled(rows, at=r"array_max(filter(transform(near, (p, k) -> CASE WHEN p rlike '(?iuU)^Таблица\\s' THEN k END), k -> k IS NOT NULL))")
    stripped = F.transform(F.expr("slice(near, at + 2, size(near))"), T.strip)
    rows = rows.withColumn("between", F.array_join(F.filter(stripped, lambda p: p != ""), " ")).withColumn("before", T.strip(F.expr("element_at(near, -1)")))
    caption = F.expr("CASE WHEN at IS NULL THEN before ELSE near[at] END")
    name = F.when(F.col("at").isNull(), F.col("before")).when(F.col("between") != "", F.col("between")).otherwise(F.coalesce(T.table_name(F.expr("get(near, at)")), F.lit("")))
    return rows.select("doc_id", "table_idx", name.alias("name"), caption.alias("caption")).where("caption <> ''")


def table_subsections(sections: DataFrame, tables: DataFrame, names: DataFrame) -> DataFrame:
    """``doc_id, table_idx, number, title, level, parent_idx, parent_number``: a section for each named table under the last one that holds the paragraph before it."""
    where = tables.select("doc_id", "table_idx", F.col("paragraph_index_before").cast("int").alias("line_idx"))
    placed = _matched(where, paragraph_sections(sections, where.select("doc_id", "line_idx").distinct()), ["doc_id", "line_idx"], "inner").where("section_idx is not null")
    parents = sections.select("doc_id", "section_idx", F.col("number").alias("parent_number"), F.col("level").alias("above"))
    rows = _matched(_matched(placed, parents, ["doc_id", "section_idx"], "inner"), names, ["doc_id", "table_idx"], "inner")
    return rows.select("doc_id", "table_idx", F.concat("parent_number", F.lit(".T"), F.col("table_idx").cast("string")).alias("number"), F.col("caption").alias("title"), (F.col("above") + 1).alias("level"), F.col("section_idx").alias("parent_idx"), "parent_number")


def with_table_subsections(sections: DataFrame, found: DataFrame) -> DataFrame:
    """``sections`` and, after a document's own, its table subsections; they are also children and tables of their parents."""
    more = found.groupBy("doc_id", F.col("parent_idx").alias("section_idx")).agg(F.transform(F.array_sort(F.collect_list(F.struct("table_idx", "number"))), lambda x: x["number"]).alias("more"))
    joined = _matched(sections, more, ["doc_id", "section_idx"]).withColumn("more", F.coalesce("more", F.array().cast("array<string>")))
    old = joined.withColumn("children", F.concat("children", "more")).withColumn("tables", F.concat("tables", "more")).select(*sections.columns)
    many = sections.groupBy("doc_id").agg((F.max("section_idx") + 1).alias("many"))
    nth = F.expr("row_number() OVER (PARTITION BY doc_id ORDER BY table_idx) - 1")
    none = F.array().cast("array<string>")
    new = _matched(found, many, ["doc_id"], "inner").select("doc_id", (F.col("many") + nth).cast("int").alias("section_idx"), "number", "title", "level", "parent_idx", "parent_number", none.alias("children"), none.alias("tables"), F.col("title").alias("content"))
    return old.unionByName(new, allowMissingColumns=True)


def tree_of(rows: DataFrame) -> DataFrame:
    """Sections of a saved result (doc_id, section_idx, number, parent_number, further columns) with ``parent_idx`` and ``children``, linked by number.

    Of several sections of one number the last is the parent. A section whose parent isn't there is a root.
    """
    by = rows.groupBy("doc_id", F.col("number").alias("parent_number")).agg(F.max("section_idx").alias("parent_idx"))
    linked = _matched(rows.drop("parent_idx", "children"), by, ["doc_id", "parent_number"])
    kids = linked.where("parent_idx is not null").groupBy("doc_id", F.col("parent_idx").alias("section_idx")).agg(F.transform(F.array_sort(F.collect_list(F.struct("section_idx", "number"))), lambda x: x["number"]).alias("children"))
    return _matched(linked, kids, ["doc_id", "section_idx"]).withColumn("children", F.coalesce("children", F.array().cast("array<string>")))


def section_positions(sections: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, section_idx, level, start, end``: where each title stands in the text, from 0, looked for after the one before; if it isn't there, that one's place. The end is the content's length on, or 1000 without content."""
    each = sections.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("section_idx", "level", "title", F.length("content").alias("size")))).alias("all"))
    rows = _matched(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), each, ["doc_id"], "inner")
    rows = rows.select("doc_id", "all", passes.places(F.col("all.title"), F.col("text")).alias("starts"))
    one = rows.select("doc_id", F.posexplode_outer(F.arrays_zip("all", "starts")).alias("k", "z")).where("k is not null")
    size = F.when(F.coalesce(F.col("z.all.size"), F.lit(0)) > 0, F.col("z.all.size")).otherwise(F.lit(1000))
    return one.select("doc_id", F.col("z.all.section_idx").alias("section_idx"), F.col("z.all.level").alias("level"), F.col("z.starts").alias("start"), (F.col("z.starts") + size).alias("end"))


def section_at(spans: DataFrame, positions: DataFrame) -> DataFrame:
    """``doc_id, position, section_idx``: of the spans (section_idx, level, start, end) that hold a position, ends included, the deepest, of equal ones the first."""
    by = spans.groupBy("doc_id").agg(F.collect_list(F.struct("level", (-F.col("section_idx")).alias("before"), "start", "end")).alias("spans"))
    best = F.expr("-array_max(filter(spans, s -> position BETWEEN s.start AND s.end)).before")
    return _matched(positions.select("doc_id", "position"), by, ["doc_id"]).select("doc_id", "position", best.alias("section_idx"))


def sections_by_path(sections: DataFrame, path: list[str]) -> DataFrame:
    """``doc_id, section_idx, number``: each document's first section whose titles from the root down end with ``path``; none for an empty path."""
    if not path:
        return sections.select("doc_id", "section_idx", "number").limit(0)
    wanted = F.array(*map(F.lit, path))
    fits = F.slice(F.reverse("path"), 1, len(path)) == F.reverse(wanted)
    found = _matched(section_paths(sections).where(fits).select("doc_id", "section_idx"), sections.select("doc_id", "section_idx", "number"), ["doc_id", "section_idx"], "inner")
    return found.groupBy("doc_id").agg(F.min_by(F.struct("section_idx", "number"), "section_idx").alias("s")).select("doc_id", "s.*")


def titles_by_number(sections: DataFrame) -> DataFrame:
    """``doc_id, number, title``: the first title of each number."""
    return sections.groupBy("doc_id", "number").agg(F.min_by("title", "section_idx").alias("title"))


def path_titles(sections: DataFrame, paths: DataFrame) -> DataFrame:
    """Paths of numbers (doc_id, path) with ``titles``; a number without a section stays itself, an empty path is ``Root``."""
    by = titles_by_number(sections).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("number", "title"))).alias("names"))
    titles = F.transform("path", lambda n: F.coalesce(F.try_element_at("names", n), n))
    return _matched(paths.select("doc_id", "path"), by, ["doc_id"]).select("doc_id", "path", F.when(F.size("path") > 0, titles).otherwise(F.array(F.lit("Root"))).alias("titles"))


def sections_with_text(sections: DataFrame, texts: DataFrame) -> DataFrame:
    """``doc_id, text, section_idx``: the first section whose content has the text, runs of white space counted as one blank."""
    def plain(c: Column) -> Column:
        return T.strip(F.regexp_replace(c, r"(?U)\s+", " "))

    content = sections.select("doc_id", "section_idx", plain(F.col("content")).alias("plain"))
    hits = _matched(texts.select("doc_id", "text"), content, ["doc_id"]).withColumn("hit", F.contains("plain", plain(F.col("text"))))
    return hits.groupBy("doc_id", "text").agg(F.min(F.when(F.col("hit"), F.col("section_idx"))).alias("section_idx"))
