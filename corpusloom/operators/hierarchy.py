"""The section tree of each document, found within its row: no shuffle, one pass in Python over numbered lines only."""

# Computed arrays are exploded with posexplode_outer and a test for null: without outer, the optimiser infers a
# filter on the array's size and pushes it below, where it repeats the whole computation many times over.

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import passes

#: Lines after a caption among which the fence of its table is looked for: up to one non-blank line more than this.
CAPTION_LINES = 3


def with_lines(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``lines``: the stripped lines of a text with ``at``, their number in it; blank ones left out."""
    raw = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    lines = F.transform(raw, lambda line, at: F.struct(at.cast("int").alias("at"), T.strip(line).alias("line"), line.alias("raw")))
    return docs.withColumn("lines", F.filter(lines, lambda x: x["line"] != ""))


def classified(verb: Callable[[Column], Column] = T.contains_verb) -> Column:
    """The lines with ``kind`` and ``number`` as far as they follow from the line alone; "simple" needs the pass over all of them."""

    def one(x: Column) -> Column:
        line = x["line"]

        def pick(pattern: str) -> Column:
            return F.regexp_extract(line, pattern, 1)

        dotted, simple = pick(r"(?U)^(\d+(?:\.\d+)+)\."), pick(r"(?U)^(\d+)\.")
        bracket, number = pick(rf"(?U)^{T.LABEL}\s*(\d+)\)"), pick(rf"(?U)^{T.LABEL}\s*(\d+(?:\.\d+)*)")
        letter, bullet = pick(rf"^{T.LABEL}(?U)\s*([a-zа-я])"), pick(r"^([•*-])")
        chain = [
            (dotted != "", "multi_level", dotted),
            (simple != "", "simple", simple),
            ((bracket != "") & T.is_likely_number(bracket), "simple_numbered", bracket),
            ((number != "") & T.is_likely_number(number), "multi_level", number),
            (letter != "", "lettered", letter),
            (bullet != "", "bulleted", bullet),
        ]
        kind, value = F.lit("paragraph"), F.lit(None).cast("string")
        for test, name, found in reversed(chain):
            kind, value = F.when(test, F.lit(name)).otherwise(kind), F.when(test, found).otherwise(value)
        # most lines begin with a capital: one look at the first character spares them the patterns
        begin = F.left(line, F.lit(1))
        marked, digit = F.regexp_like(begin, F.lit(r"(?U)[\da-zа-яРПЧ•*-]")), F.regexp_like(begin, F.lit(r"(?U)\d"))
        kind, value = F.when(marked, kind).otherwise(F.lit("paragraph")), F.when(marked, value)
        # a dotted or simple number clears the list state only when it has dots
        deep, plain = digit & (dotted != ""), digit & ((dotted != "") | (simple != ""))
        caption = F.when(F.lower(begin) == "т", F.nullif(F.regexp_extract(line, r"(?iuU)^Таблица\s+(\d+)\b", 1), F.lit("")))
        return F.struct(x["at"].alias("at"), line.alias("line"), x["raw"].alias("raw"), kind.alias("kind"), value.alias("number"), deep.alias("dotted"), plain.alias("numbered"), ((~plain) & verb(line)).alias("verb"), caption.alias("caption"))

    return F.transform("lines", one)


def settled(df: DataFrame, **columns: Column | str) -> DataFrame:
    """``df`` with more columns, which are worked out once a row.

    The optimiser puts an expression in place of a column even inside a lambda, where it is then repeated for each
    element; it doesn't across a generator.
    """
    more = [(F.expr(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()]
    return df.select(F.inline_outer(F.array(F.struct(*(F.col(c) for c in df.columns if c not in columns), *more))))


def _rows(docs: DataFrame, id_col: str, text_col: str, kept: Column | None = None) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.lit(None).cast("string") if kept is None else kept).alias("kept"), F.col(text_col).alias("text"))
    return with_lines(rows).drop("text")


def _told(lines: Column) -> Column:
    """What the parser is told of classified lines; numbers of sections without leading zeros."""

    def one(x: Column) -> Column:
        simple = x["kind"] == "simple"
        number = F.when(simple, F.regexp_replace(x["number"], "^0+(?=.)", "")).otherwise(x["number"])
        value = F.when(simple, x["number"].try_cast("decimal(38,0)").cast("string"))
        title = F.when(x["kind"].isin("simple", "multi_level"), F.regexp_replace(F.regexp_replace(x["line"], r"(?U)^\s*\d+(?:\.\d+)*\.?\s*", ""), r"(?U)^\s+|\s+$", ""))
        raw = lambda c: c.cast("binary")
        return F.struct(raw(x["line"]).alias("line"), raw(x["raw"]).alias("raw"), raw(x["kind"]).alias("kind"), raw(number).alias("number"), raw(value).alias("n"), raw(title).alias("title"), x["dotted"].alias("dotted"), x["numbered"].alias("numbered"), x["verb"].alias("verb"), raw(x["caption"]).alias("caption"))

    return F.transform(lines, one)


def _owned(docs: DataFrame, id_col: str, text_col: str, verb: Callable[[Column], Column]) -> DataFrame:
    """``doc_id, ls`` (its classified lines) and ``own`` (owner and early of each)."""
    rows = settled(_rows(docs, id_col, text_col), ls=classified(verb)).select("doc_id", "ls")
    return settled(rows, told=_told(F.col("ls"))).select("doc_id", "ls", passes.owners(F.col("told"), CAPTION_LINES).alias("own"))


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", verb: Callable[[Column], Column] = T.contains_verb) -> DataFrame:
    """``doc_id, line_idx, line, kind, number, owner``: owner is the section's index, or -1 in a list before any section.

    A table's own lines belong to it, also what stands between its caption and fence, which is not in its content; the lines
    after it to the section that is open.
    """
    rows = _owned(docs, id_col, text_col, verb)
    each = rows.select("doc_id", F.posexplode_outer(F.arrays_zip("ls", "own")).alias("line_idx", "z")).where("line_idx is not null")
    kind = F.when(F.col("z.own.early"), F.lit("preamble")).otherwise(F.col("z.ls.kind"))
    return each.select("doc_id", "line_idx", F.col("z.ls.line").alias("line"), kind.alias("kind"), F.col("z.ls.number").alias("number"), F.col("z.own.owner").alias("owner"))


def sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", verb: Callable[[Column], Column] = T.contains_verb, kept: Column | None = None) -> DataFrame:
    """``doc_id, section_idx, number, title, level, parent_idx, parent_number, children, tables, content, para_first, para_last``, and ``kept`` if given.

    All of it is worked out inside the document's row, in time and memory in proportion to its lines. Lines keep their
    order; ``para_first`` and ``para_last`` are the first and last line of the document that equals any line of the section.
    ``kept`` is a column that the document's sections carry along. A null or blank text has no section. Repeated rows give
    repeated sections.
    """
    rows = settled(_rows(docs, id_col, text_col, kept), told=_told(classified(verb))).drop("lines")
    rows = rows.select("doc_id", "kept", passes.sections(F.col("told"), CAPTION_LINES).alias("all"))
    each = rows.select("doc_id", "kept", F.posexplode_outer("all").alias("section_idx", "s")).where("section_idx is not null")
    text = lambda c: F.col(f"s.{c}").cast("string").alias(c)
    listed = lambda c: F.col(f"s.{c}").cast("array<string>").alias(c)
    title = F.when(F.col("s.level") == 0, T.short_title(F.col("s.title").cast("string"))).otherwise(F.col("s.title").cast("string"))
    return each.select(
        "doc_id", "section_idx", text("number"), title.alias("title"), "s.level", "s.parent_idx", text("parent_number"), listed("children"), listed("tables"), text("content"), "s.para_first", "s.para_last",
        *([] if kept is None else ["kept"]),
    )


def flat_lists(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, list_idx, list_type, items``: list lines before any section, in runs of one type."""
    rows = settled(_owned(docs, id_col, text_col, T.contains_verb), free="transform(filter(ls, (x, i) -> own[i].owner = -1), x -> named_struct('kind', x.kind, 'line', x.line))").select("doc_id", "free")
    rows = settled(rows, runs="filter(transform(free, (x, i) -> CASE WHEN i = 0 OR free[i - 1].kind <> x.kind THEN i END), i -> i IS NOT NULL)")
    items = "transform(slice(free, a + 1, coalesce(get(runs, k + 1), size(free)) - a), x -> x.line)"
    lists = f"transform(runs, (a, k) -> named_struct('list_type', CASE WHEN free[a].kind = 'simple' THEN 'flat_list' ELSE free[a].kind END, 'items', {items}))"
    return rows.select("doc_id", F.posexplode_outer(F.expr(lists)).alias("list_idx", "l")).where("list_idx is not null").select("doc_id", "list_idx", "l.*")


def sections_by_level(found: DataFrame, level: int) -> DataFrame:
    return found.where(F.col("level") == level)
