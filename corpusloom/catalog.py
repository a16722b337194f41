"""Registry of the document-structure queries and their DuckDB equivalents.

The driver's tables hold few numbered lines and no tables, so some queries first write documents, list
positions and cells from the relational tables; every row of those tables is used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import chunks as C
from corpusloom.operators import hierarchy as H
from corpusloom.operators import numbering, relations, tables
from corpusloom.plans import api
from corpusloom.plans.options import ChunkOptions


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each region: nations as sections 1.k., their suppliers as sections 1.k.j., each with a line of its key."""
    region, nation, supplier = (_read(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    own = F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name", "s_acctbal")))
    kids = supplier.groupBy("s_nationkey").agg(own.alias("s"))
    # gathered rows look smaller than they are: unless told, the planner would send them all through the driver
    rows = nation.join(kids.hint("merge"), F.col("n_nationkey") == F.col("s_nationkey"), "left")
    per = rows.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name", F.coalesce("s", F.expr("slice(s, 1, 0)")).alias("s")))).alias("n"))
    section = """concat(array(concat('1.', k + 1, '. ', x.n_name), concat('Nation ', x.n_nationkey)),
        flatten(transform(coalesce(x.s, array()), (y, j) -> array(concat('1.', k + 1, '.', j + 1, '. ', y.s_name), concat('Supplier ', y.s_suppkey)))))"""
    body = F.expr(f"array_join(flatten(transform(n, (x, k) -> {section})), '\\n')")
    docs = region.join(per.hint("merge"), F.col("r_regionkey") == F.col("n_regionkey"))
    return docs.select(F.col("r_regionkey").cast("long").alias("doc_id"), F.concat(F.lit("1. "), "r_name", F.lit("\n"), body).alias("text"))


def _outline_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.sections(outlines(spark, sf_dir))


def flat_section_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.split_text(_read(spark, sf_dir, "documents")).select("doc_id", "chunk_number", "content")


def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.chunk_stats(C.chunks(H.sections(_read(spark, sf_dir, "documents"))))


def split_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = H.with_lines(_read(spark, sf_dir, "documents")).select("doc_id", F.posexplode_outer("lines").alias("para_idx", "x")).where("para_idx is not null")
    return rows.select("doc_id", "para_idx", F.col("x.line").alias("text"))


def text_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = T.normalize_whitespace(F.col("text"))
    return _read(spark, sf_dir, "documents").select("doc_id", T.word_count(body).alias("words"), T.char_count(body).alias("chars"), T.contains_lists(F.col("text")).alias("has_list"), T.short_title(F.col("text")).alias("short"), T.is_section_header(F.col("text")).alias("is_header"), T.is_table_reference(F.col("text")).alias("is_table_ref"))


def classify_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = H.with_lines(_read(spark, sf_dir, "documents")).select("doc_id", F.posexplode_outer(H.classified()).alias("line_idx", "x")).where("line_idx is not null")
    return rows.select("doc_id", "line_idx", "x.kind", "x.number")


def outline_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outline_sections(spark, sf_dir).select("doc_id", "section_idx", "number", "title", "level", "parent_number", F.size("children").alias("children"), "content", "para_first", "para_last")


def outline_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.target_sections(_outline_sections(spark, sf_dir), 2).select("doc_id", "section_idx", "number")


def outline_level_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.sections_by_level(_outline_sections(spark, sf_dir), 2).select("doc_id", "number", "title")


def section_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relations.section_context(_outline_sections(spark, sf_dir))
    return rows.select("doc_id", "section_idx", "number", "parent_number", "parent_title", F.array_join("children", ",").alias("children"), F.array_join("siblings", ",").alias("siblings"))


def section_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relations.section_paths(_outline_sections(spark, sf_dir))
    return rows.select("doc_id", "section_idx", F.array_join("path", " > ").alias("path"))


def paragraph_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = outlines(spark, sf_dir)
    return relations.paragraph_sections(H.sections(docs), H.lines_of(docs).select("doc_id", "line_idx"))


def toc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.toc_lines(outlines(spark, sf_dir))
    return rows.select("doc_id", F.array_join("lines", "\n").alias("toc"))


def toc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.toc_chunks(C.toc_lines(outlines(spark, sf_dir)), 400)


def outline_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.chunks(_outline_sections(spark, sf_dir)).select("doc_id", "section_number", "chunk_number", "content", "word_count", "char_count", "is_complete_section", "start_pos", "end_pos", "chunk_type")


def virtual_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.virtual_chunks(_outline_sections(spark, sf_dir), 300, 60)
    return rows.select("doc_id", "parent_section", "chunk_number", "content", F.array_join("section_numbers", ",").alias("section_numbers"), "num_merged_sections", "char_count")


#: What lines begin with in ``numbered``, by turns that differ from document to document.
PREFIXES = ["1. ", "2. ", "1.1. ", "1.2. ", "3. ", "5) ", "- ", "1.1. ", "2024 ", "Plain ", "word "]


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' lines behind numbers, brackets, dashes, years and words: repeated numbers, lists within and ahead of sections."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: F.concat(F.element_at(F.array(*map(F.lit, PREFIXES)), (F.pmod(F.col("doc_id") * 7 + i * (F.pmod("doc_id", F.lit(3)) * 2 + 3), F.lit(11)) + 1).cast("int")), F.substring(x, 1, 20)))
    return _read(spark, sf_dir, "documents").select("doc_id", F.array_join(lines, "\n").alias("text"))


def numbered_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.sections(numbered(spark, sf_dir)).select("doc_id", "section_idx", "number", "level", "parent_number", F.array_join("children", ",").alias("children"), "content", F.coalesce("para_first", F.lit(-1)).alias("para_first"), F.coalesce("para_last", F.lit(-1)).alias("para_last"))


def numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.lines_of(numbered(spark, sf_dir)).select("doc_id", "line_idx", "owner")


def merged_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.merged_chunks(_outline_sections(spark, sf_dir), ChunkOptions(max_chunk_size=300, chunk_overlap=60))
    return rows.select("doc_id", "merged", "parent_section", "chunk_number", "content", "word_count", "is_complete_section", "chunk_type")


def outline_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.process_text(outlines(spark, sf_dir))["summary"]


def outline_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = api.section_documents(_outline_sections(spark, sf_dir))
    told = lambda n: F.try_element_at("metadata", F.lit(n)).alias(n)
    return found.select("doc_id", "page_content", *map(told, ("section_number", "section_title", "section_level", "parent_number", "source_type", "char_count", "word_count", "children")))


def section_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = outlines(spark, sf_dir)
    return relations.section_positions(H.sections(docs), docs)


def restored_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as list paragraphs: level by line number, tabs by quantity."""
    tabs = F.repeat(F.lit("\t"), (F.col("l_quantity") % 3).cast("int"))
    rows = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("int").alias("para_idx"), F.concat(tabs, F.lit("Part "), F.col("l_partkey").cast("string")).alias("text"), F.expr("CASE WHEN l_linenumber % 2 = 0 THEN array(1, cast(l_linenumber AS int)) ELSE array(cast(l_linenumber AS int)) END").alias("levels"))
    return numbering.restore_paragraphs(rows).select("doc_id", "para_idx", "restored_text")


def nation_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plain table for each region: a header, then a nation a row."""
    rows = _read(spark, sf_dir, "nation").withColumn("row", F.expr("row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey)"))
    body = rows.select(F.col("n_regionkey").cast("long").alias("doc_id"), "row", F.posexplode_outer(F.array(F.col("n_nationkey").cast("string"), "n_name", F.concat(F.lit("a|b "), "n_name"))).alias("col", "text")).where("col is not null")
    head = _read(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("doc_id"), F.lit(0).alias("row"), F.posexplode_outer(F.array(F.lit("Key"), F.lit("Name"), F.lit("Note"))).alias("col", "text")).where("col is not null")
    return head.unionByName(body).select("doc_id", F.lit(1).alias("table_idx"), "row", "col", F.lit(1).alias("rowspan"), F.lit(1).alias("colspan"), "text")


def table_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _read(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("doc_id"), F.lit(1).alias("table_idx"), F.col("r_name").alias("name"))
    return tables.markdown(nation_cells(spark, sf_dir), names).select("doc_id", "content")


def merged_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table: a region's cell spans its nations' rows."""
    joined = _read(spark, sf_dir, "nation").join(_read(spark, sf_dir, "region"), F.expr("n_regionkey = r_regionkey"))
    rows = joined.withColumn("row", F.expr("row_number() OVER (ORDER BY r_regionkey, n_nationkey) - 1")).withColumn("first", F.expr("row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) = 1"))
    left = rows.select("row", F.lit(0).alias("ord"), F.lit(1).alias("colspan"), F.when(F.col("first"), "restart").otherwise("continue").alias("vmerge"), F.when(F.col("first"), F.col("r_name")).alias("text"))
    right = rows.select("row", F.lit(1).alias("ord"), F.lit(2).alias("colspan"), F.lit(None).cast("string").alias("vmerge"), F.col("n_name").alias("text"))
    return left.unionByName(right).select(F.lit(1).alias("doc_id"), F.lit(1).alias("table_idx"), "row", "ord", "colspan", "vmerge", "text")


def table_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.grid(tables.origin_cells(merged_cells(spark, sf_dir))).select("row", "col", "text")


def table_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tables.facts(nation_cells(spark, sf_dir)).select("doc_id", F.explode_outer("items").alias("i"))
    each = found.select("doc_id", "i.item_name", "i.row", F.explode("i.facts").alias("f"))
    return each.select("doc_id", "item_name", "row", F.array_join("f.attributes", ",").alias("attributes"), "f.value", "f.col")


def wide_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table for each region: a heading over two columns, their own below it, a row across, then a nation a row with its customers and suppliers."""
    nation = _read(spark, sf_dir, "nation")
    many = lambda t, key, name: _read(spark, sf_dir, t).groupBy(F.col(key).alias("n_nationkey")).agg(F.count("*").alias(name))
    rows = nation.join(many("customer", "c_nationkey", "customers"), "n_nationkey", "left").join(many("supplier", "s_nationkey", "suppliers"), "n_nationkey", "left")
    rows = rows.withColumn("row", F.expr("row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) + 2"))
    text = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    body = rows.select(F.col("n_regionkey").cast("long").alias("doc_id"), "row", F.posexplode_outer(F.array("n_name", text("customers"), text("suppliers"))).alias("ord", "text")).where("ord is not null").withColumn("colspan", F.lit(1))
    region = _read(spark, sf_dir, "region")
    top = F.expr("array(struct(0 AS row, 0 AS ord, 1 AS colspan, 'Nation' AS text), struct(0 AS row, 1 AS ord, 2 AS colspan, 'Parties' AS text), struct(1 AS row, 0 AS ord, 1 AS colspan, '' AS text), struct(1 AS row, 1 AS ord, 1 AS colspan, 'Customers' AS text), struct(1 AS row, 2 AS ord, 1 AS colspan, 'Suppliers' AS text), struct(2 AS row, 0 AS ord, 3 AS colspan, r_name AS text))")
    head = region.select(F.col("r_regionkey").cast("long").alias("doc_id"), F.inline(top))
    cells = head.unionByName(body).select("doc_id", F.lit(1).alias("table_idx"), "row", "ord", "colspan", F.lit(None).cast("string").alias("vmerge"), "text")
    return tables.origin_cells(cells)


def _region_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("doc_id"), F.lit(1).alias("table_idx"), F.col("r_name").alias("name"))


def wide_table_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tables.facts(wide_cells(spark, sf_dir)).select("doc_id", F.explode_outer("items").alias("i"))
    each = found.select("doc_id", "i.item_name", "i.row", F.explode("i.facts").alias("f"))
    return each.select("doc_id", "item_name", "row", F.array_join("f.attributes", ",").alias("attributes"), "f.value", "f.col")


def table_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of plain tables as Markdown and of tables with merged cells as facts."""
    wide = wide_cells(spark, sf_dir).withColumn("table_idx", F.lit(2))
    names = _region_names(spark, sf_dir)
    both = nation_cells(spark, sf_dir).unionByName(wide)
    return tables.chunks(both, names.unionByName(names.withColumn("table_idx", F.lit(2))), 500).select("doc_id", "table_idx", "chunk_number", "content")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        chunk_stats, classify_lines, flat_section_chunks, merged_leaves, numbered_lines, numbered_sections, outline_chunks, outline_documents, outline_level_two, outline_sections, outline_summary, outline_targets, paragraph_sections, restored_numbers,
        section_context, section_paths, section_positions, split_lines, table_chunks, table_facts, table_grid, table_markdown, text_measures, toc_chunks, toc_lines, virtual_chunks, wide_table_facts,
    )
}

_LINES = r"""lines AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS a FROM documents)"""
_KIND = r"""CASE WHEN regexp_matches(x, '^\d+(\.\d+)+\.') THEN 'multi_level' WHEN regexp_matches(x, '^\d+\.') THEN 'simple' WHEN regexp_matches(x, '^\d+\)') THEN 'simple_numbered'
    WHEN regexp_matches(x, '^\d+') AND NOT regexp_matches(regexp_extract(x, '^\d+(\.\d+)*'), '^((19|20)\d\d|\d{1,2}\.\d{1,2}\.(\d{2}|\d{4}))$') THEN 'multi_level'
    WHEN regexp_matches(x, '^[a-zа-я]') THEN 'lettered' WHEN regexp_matches(x, '^[•*-]') THEN 'bulleted' ELSE 'paragraph' END"""


def _packed(elements: str, most: int, overlap: int) -> str:
    """CTEs from ``elements`` (keys doc_id, list a) to ``packed`` (doc_id, out): greedy packing, one element a step."""
    tail = f"cur[coalesce(list_filter(range(1, len(cur) + 1), lambda k: length(array_to_string(cur[k:], chr(10))) <= {overlap})[1], len(cur) + 1):]"
    return f"""r AS (SELECT doc_id, a, 0 AS i, []::VARCHAR[] AS cur, []::VARCHAR[] AS out FROM {elements}
        UNION ALL SELECT doc_id, a, i + 1,
            CASE WHEN length(a[i + 1]) > {most} THEN [] WHEN len(cur) > 0 AND length(array_to_string(cur, chr(10))) + length(a[i + 1]) > {most} THEN list_append({tail}, a[i + 1]) ELSE list_append(cur, a[i + 1]) END,
            CASE WHEN length(a[i + 1]) > {most} THEN list_concat(CASE WHEN len(cur) > 0 THEN list_append(out, array_to_string(cur, chr(10))) ELSE out END, list_transform(range(0, (length(a[i + 1]) - 1) // {most} + 1), lambda k: substr(a[i + 1], k * {most} + 1, {most})))
                 WHEN len(cur) > 0 AND length(array_to_string(cur, chr(10))) + length(a[i + 1]) > {most} THEN list_append(out, array_to_string(cur, chr(10))) ELSE out END
        FROM r WHERE i < len(a)),
    packed AS (SELECT doc_id, CASE WHEN len(cur) > 0 THEN list_append(out, array_to_string(cur, chr(10))) ELSE out END AS out FROM r WHERE i = len(a))"""


_CHUNKS = rf"""WITH RECURSIVE {_LINES},
    body AS (SELECT doc_id, list_transform(a[list_position(list_transform(a, lambda x: NOT regexp_matches(x, '^[a-zа-я•*-]')), true):], lambda x: regexp_replace(x, '[ \t]+', ' ', 'g')) AS a FROM lines
             WHERE list_contains(list_transform(a, lambda x: NOT regexp_matches(x, '^[a-zа-я•*-]')), true)),
    {_packed("body", 1000, 200)},
    fitted AS (SELECT doc_id, CASE WHEN length(array_to_string(a, chr(10))) <= 1000 THEN [array_to_string(a, chr(10))] ELSE out END AS out, length(array_to_string(a, chr(10))) <= 1000 AS whole, len(a) AS n_lines FROM body JOIN packed USING (doc_id))"""

_OUTLINE = """s AS (SELECT n_regionkey AS doc_id, n_nationkey, n_name, dense_rank() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k, s_suppkey, s_name,
                 row_number() OVER (PARTITION BY n_nationkey ORDER BY s_suppkey) AS j FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey),
    sec AS (SELECT r_regionkey AS doc_id, 0 AS k, 0 AS j, '1' AS number, r_name AS title, NULL AS line FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)
            UNION ALL SELECT DISTINCT doc_id, k, 0, '1.' || k, n_name, 'Nation ' || n_nationkey FROM s
            UNION ALL SELECT doc_id, k, j, '1.' || k || '.' || j, s_name, 'Supplier ' || s_suppkey FROM s WHERE s_suppkey IS NOT NULL),
    o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k, j) - 1 AS section_idx, CASE WHEN k = 0 THEN 1 WHEN j = 0 THEN 2 ELSE 3 END AS level,
                 CASE WHEN k = 0 THEN NULL WHEN j = 0 THEN '1' ELSE '1.' || k END AS parent_number, number || '. ' || title || coalesce(chr(10) || line, '') AS content,
                 CASE WHEN k = 0 THEN 0 ELSE 2 * (row_number() OVER (PARTITION BY doc_id ORDER BY k, j) - 1) - 1 END AS para_first FROM sec)"""

_PACK_TOC = f"""WITH RECURSIVE {_OUTLINE}, e AS (SELECT doc_id, list(number || '. ' || title ORDER BY section_idx) AS a FROM o GROUP BY doc_id),
    r AS (SELECT doc_id, a, 0 AS i, []::VARCHAR[] AS cur, 0::BIGINT AS size, []::VARCHAR[] AS done FROM e
        UNION ALL SELECT doc_id, a, i + 1, CASE WHEN len(cur) > 0 AND size + length(a[i + 1]) + 1 > 400 THEN [a[i + 1]] ELSE list_append(cur, a[i + 1]) END,
            CASE WHEN len(cur) > 0 AND size + length(a[i + 1]) + 1 > 400 THEN length(a[i + 1]) + 1 ELSE size + length(a[i + 1]) + 1 END,
            CASE WHEN len(cur) > 0 AND size + length(a[i + 1]) + 1 > 400 THEN list_append(done, array_to_string(cur, chr(10))) ELSE done END FROM r WHERE i < len(a)),
    f AS (SELECT doc_id, list_append(done, array_to_string(cur, chr(10))) AS out FROM r WHERE i = len(a) AND len(cur) > 0)"""

_TAIL = "coalesce(list_filter(range(1, len(cur) + 1), lambda k: list_sum(list_transform(cur[k:], lambda x: length(x.content))) <= 60)[1], len(cur) + 1)"
_FULL = "len(cur) > 0 AND list_sum(list_transform(cur, lambda x: length(x.content))) + length(a[i + 1].content) > 300"
_PACK_LEAVES = f"""WITH RECURSIVE {_OUTLINE}, e AS (SELECT doc_id, parent_number, list({{'number': number, 'content': content}} ORDER BY section_idx) AS a FROM o
        WHERE parent_number IS NOT NULL AND NOT EXISTS (SELECT 1 FROM o p WHERE p.doc_id = o.doc_id AND p.parent_number = o.number) GROUP BY doc_id, parent_number),
    r AS (SELECT doc_id, parent_number, a, 0 AS i, a[1:0] AS cur, [a[1:0]][1:0] AS done FROM e
        UNION ALL SELECT doc_id, parent_number, a, i + 1, CASE WHEN {_FULL} THEN list_append(cur[{_TAIL}:], a[i + 1]) ELSE list_append(cur, a[i + 1]) END, CASE WHEN {_FULL} THEN list_append(done, cur) ELSE done END FROM r WHERE i < len(a)),
    f AS (SELECT doc_id, parent_number, list_append(done, cur) AS out FROM r WHERE i = len(a)),
    v AS (SELECT doc_id, parent_number, unnest(range(1, len(out) + 1))::INT AS chunk_number, unnest(out) AS g FROM f)"""

# the rules for numbers, line by line; a stack of open sections, and the sections so far
_KINDS = "['s1', 's2', 'd1.1', 'd1.2', 's3', 'o', 'o', 'd1.1', 'p', 'p', 'o']"
_IS_LIST = "x.kind[1] = 's' AND NOT (first1 AND x.n = 1) AND (listing OR coalesce(x.n > last_flat, false) OR NOT upper OR x.n = 1)"
_IS_HEAD = f"x.kind[1] IN ('s', 'd') AND NOT ({_IS_LIST})"
_SAME = "len(stack) > 0 AND stack[-1].number = x.number"
_NEW = f"CASE WHEN {_SAME} THEN x.number || '.' || (1 + len(list_filter(heads, lambda h: h.same = x.number))) ELSE x.number END"
_DEEP = f"CASE WHEN {_SAME} THEN stack[-1].level + 1 ELSE length(x.number) - length(replace(x.number, '.', '')) + 1 END"
_LEFT = f"CASE WHEN {_SAME} THEN stack ELSE list_filter(stack, lambda t: t.level < length(x.number) - length(replace(x.number, '.', '')) + 1) END"
_NUMBERED = f"""WITH RECURSIVE t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
    l0 AS (SELECT doc_id, unnest(range(0, len(a))) AS i, unnest(a) AS raw FROM t),
    l1 AS (SELECT doc_id, i, ((doc_id * 7 + i * ((doc_id % 3) * 2 + 3)) % 11)::INT AS p, raw FROM l0),
    l AS (SELECT doc_id, i::INT AS i, p, trim({PREFIXES}[p + 1] || raw[1:20]) AS line, {_KINDS}[p + 1] AS kind FROM l1),
    k AS (SELECT *, CASE WHEN kind[1] IN ('s', 'd') THEN kind[2:] END AS number, CASE WHEN kind[1] = 's' THEN kind[2:]::INT END AS n, coalesce(min(i) FILTER (kind[1] IN ('s', 'd')) OVER (PARTITION BY doc_id), 0) AS cut FROM l),
    g AS (SELECT doc_id, list({{'i': i, 'kind': kind, 'number': number, 'n': n}} ORDER BY i) AS a FROM k GROUP BY doc_id),
    r AS (SELECT doc_id, a, 0 AS nr, true AS first1, false AS listing, NULL::INT AS last_flat, false AS upper, []::STRUCT(number VARCHAR, level BIGINT, spot BIGINT)[] AS stack, []::STRUCT(i INT, number VARCHAR, title_of INT, level BIGINT, parent BIGINT, same VARCHAR)[] AS heads FROM g
        UNION ALL SELECT doc_id, a, nr + 1, first1 AND NOT (x.kind = 's1'), CASE WHEN {_IS_LIST} THEN true WHEN {_IS_HEAD} THEN false ELSE listing END, CASE WHEN {_IS_LIST} THEN x.n ELSE last_flat END, upper OR (first1 AND x.kind = 's1'),
            CASE WHEN {_IS_HEAD} THEN list_append({_LEFT}, {{'number': {_NEW}, 'level': {_DEEP}, 'spot': len(heads)}}) ELSE stack END,
            CASE WHEN {_IS_HEAD} THEN list_append(heads, {{'i': x.i, 'number': {_NEW}, 'title_of': x.i, 'level': {_DEEP}, 'parent': ({_LEFT})[-1].spot, 'same': CASE WHEN {_SAME} THEN x.number END}}) ELSE heads END
        FROM (SELECT *, a[nr + 1] AS x FROM r WHERE nr < len(a))),
    h AS (SELECT doc_id, heads, coalesce(heads[1].i, len(a)) AS start FROM r WHERE nr = len(a)),
    z AS (SELECT h.doc_id, min(k.i) AS zero FROM h JOIN k ON k.doc_id = h.doc_id AND k.i < start AND (k.i < cut OR kind = 'p') GROUP BY h.doc_id),
    q AS (SELECT h.doc_id, unnest(heads, recursive := true), unnest(range(0, len(heads))) AS nth FROM h),
    w AS (SELECT k.doc_id, k.i, k.line, CASE WHEN k.i < start THEN CASE WHEN k.i >= zero THEN 0 ELSE -1 END ELSE (SELECT max(nth) FROM q WHERE q.doc_id = k.doc_id AND q.i <= k.i) + (zero IS NOT NULL)::INT END AS owner FROM k JOIN h ON h.doc_id = k.doc_id LEFT JOIN z ON z.doc_id = k.doc_id),
    s AS (SELECT q.doc_id, nth + (zero IS NOT NULL)::INT AS section_idx, q.number, q.level, parent + (zero IS NOT NULL)::INT AS parent_idx, q.number || '. ' || trim(regexp_replace(line, '^\\s*\\d+(\\.\\d+)*\\.?\\s*', '')) AS head, q.i FROM q JOIN k ON k.doc_id = q.doc_id AND k.i = q.i LEFT JOIN z ON z.doc_id = q.doc_id
          UNION ALL SELECT doc_id, 0, '0', 0, NULL, NULL, zero FROM z),
    c AS (SELECT s.doc_id, s.section_idx, s.head, list(w.line ORDER BY w.i) FILTER (w.i > s.i OR s.number = '0') AS body FROM s LEFT JOIN w ON w.doc_id = s.doc_id AND w.owner = s.section_idx GROUP BY ALL),
    b AS (SELECT doc_id, section_idx, CASE WHEN head IS NULL THEN body ELSE list_concat([head], coalesce(body, [])) END AS lines FROM c),
    u AS (SELECT doc_id, section_idx, unnest(lines) AS line FROM b),
    m AS (SELECT u.doc_id, section_idx, min(i) AS first, max(i) AS last FROM u JOIN k ON k.doc_id = u.doc_id AND k.line = trim(u.line) GROUP BY ALL)"""

ORACLE_SQL: dict[str, str] = {
    "flat_section_chunks": f"{_CHUNKS} SELECT doc_id, unnest(range(1, len(out) + 1))::INT AS chunk_number, unnest(out) AS content FROM fitted",
    "chunk_stats": f"""{_CHUNKS}, c AS (SELECT whole, n_lines, unnest(out) AS content FROM fitted)
        SELECT CASE WHEN whole AND n_lines = 1 AND length(content) <= 50 THEN 'section_title' ELSE 'section_content' END AS chunk_type, count(*) AS chunks, sum(length(content))::BIGINT AS chars,
               min(length(content))::INT AS shortest, max(length(content))::INT AS longest, (sum(length(content)) // count(*))::BIGINT AS average, count(*) FILTER (NOT whole) AS incomplete FROM c GROUP BY 1""",
    "split_lines": f"WITH {_LINES} SELECT doc_id, unnest(range(0, len(a)))::INT AS para_idx, unnest(a) AS text FROM lines",
    "classify_lines": rf"""WITH {_LINES}, l AS (SELECT doc_id, unnest(range(0, len(a)))::INT AS line_idx, unnest(a) AS x FROM lines), c AS (SELECT *, {_KIND} AS kind FROM l)
        SELECT doc_id, line_idx, kind, CASE kind WHEN 'paragraph' THEN NULL WHEN 'lettered' THEN x[1] WHEN 'bulleted' THEN x[1] WHEN 'multi_level' THEN regexp_extract(x, '^\d+(\.\d+)*') ELSE regexp_extract(x, '^\d+') END AS number FROM c""",
    "text_measures": r"""SELECT doc_id, len(list_filter(regexp_split_to_array(regexp_replace(text, '[ \t]+', ' ', 'g'), '\s+'), lambda w: w <> ''))::INT AS words, length(regexp_replace(text, '[ \t]+', ' ', 'g'))::INT AS chars,
        len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(trim(x), '^(\d+\)|[•*-]|[a-zа-я]\.)'))) > 0 AS has_list, CASE WHEN length(text) > 50 THEN text[:50] || '...' ELSE text END AS short,
        regexp_matches(text, '^\s*(\d+(\.\d+)*\.|\d+\)|[IVX]+\.|[ivx]+\.)\s+') AS is_header, regexp_matches(text, '(?i)(Таблица|Table)\s+\d+') AS is_table_ref FROM documents""",
    "outline_sections": f"""WITH {_OUTLINE} SELECT doc_id, section_idx::INT AS section_idx, number, title, level, parent_number,
        (SELECT count(*) FROM o p WHERE p.doc_id = o.doc_id AND p.parent_number = o.number)::INT AS children, content, para_first::INT AS para_first, (para_first + (line IS NOT NULL)::INT)::INT AS para_last FROM o""",
    "outline_level_two": f"WITH {_OUTLINE} SELECT doc_id, number, title FROM o WHERE level = 2",
    "outline_targets": f"WITH {_OUTLINE} SELECT doc_id, section_idx::INT AS section_idx, number FROM o WHERE level = 2 OR NOT EXISTS (SELECT 1 FROM o p WHERE p.doc_id = o.doc_id AND p.parent_number = o.number)",
    "section_context": f"""WITH {_OUTLINE} SELECT o.doc_id, o.section_idx::INT AS section_idx, o.number, o.parent_number, p.title AS parent_title,
        coalesce((SELECT string_agg(c.number, ',' ORDER BY c.section_idx) FROM o c WHERE c.doc_id = o.doc_id AND c.parent_number = o.number), '') AS children,
        coalesce((SELECT string_agg(c.number, ',' ORDER BY c.section_idx) FROM o c WHERE c.doc_id = o.doc_id AND c.parent_number = o.parent_number AND c.number <> o.number), '') AS siblings
        FROM o LEFT JOIN o p ON p.doc_id = o.doc_id AND p.number = o.parent_number""",
    "section_paths": f"""WITH {_OUTLINE} SELECT o.doc_id, o.section_idx::INT AS section_idx, concat_ws(' > ', q.title, p.title, o.title) AS path
        FROM o LEFT JOIN o p ON p.doc_id = o.doc_id AND p.number = o.parent_number LEFT JOIN o q ON q.doc_id = p.doc_id AND q.number = p.parent_number""",
    "paragraph_sections": f"""WITH {_OUTLINE} SELECT doc_id, unnest(CASE WHEN line IS NULL THEN [para_first] ELSE [para_first, para_first + 1] END)::INT AS line_idx, section_idx::INT AS section_idx FROM o""",
    "toc_lines": f"WITH {_OUTLINE} SELECT doc_id, string_agg(number || '. ' || title, chr(10) ORDER BY section_idx) AS toc FROM o GROUP BY doc_id",
    "outline_chunks": f"""WITH {_OUTLINE} SELECT doc_id, number AS section_number, 1 AS chunk_number, content, len(list_filter(regexp_split_to_array(content, '\\s+'), lambda w: w <> ''))::INT AS word_count, length(content)::INT AS char_count,
        true AS is_complete_section, 0 AS start_pos, length(content)::INT AS end_pos, CASE WHEN line IS NULL THEN 'section_title' ELSE 'section_content' END AS chunk_type
        FROM o WHERE level = 3 OR NOT EXISTS (SELECT 1 FROM o p WHERE p.doc_id = o.doc_id AND p.parent_number = o.number)""",
    "restored_numbers": r"""SELECT l_orderkey AS doc_id, l_linenumber::INT AS para_idx, repeat('1.', greatest(0, t - n + 1)::INT) || CASE WHEN n = 2 THEN '1.' ELSE '' END || l_linenumber || '. ' || repeat(chr(9), t::INT) || 'Part ' || l_partkey AS restored_text
        FROM (SELECT *, (l_quantity % 3)::INT AS t, CASE WHEN l_linenumber % 2 = 0 THEN 2 ELSE 1 END AS n FROM lineitem)""",
    "table_grid": """WITH r AS (SELECT (row_number() OVER (ORDER BY r_regionkey, n_nationkey) - 1)::INT AS row, r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey)
        SELECT row, 0 AS col, r_name AS text FROM r UNION ALL SELECT row, unnest([1, 2]), n_name FROM r""",
    "table_markdown": r"""SELECT r_regionkey AS doc_id, '# ' || r_name || chr(10) || chr(10) || '| Key | Name | Note |' || chr(10) || '| --- | --- | --- |' || coalesce(chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' | a\|b ' || n_name || ' |', chr(10) ORDER BY n_nationkey), '') AS content
        FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name""",
    "table_facts": """WITH r AS (SELECT *, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) + 1)::INT AS row FROM nation)
        SELECT n_regionkey AS doc_id, n_nationkey::VARCHAR AS item_name, row, 'Name' AS attributes, n_name AS value, 2 AS col FROM r
        UNION ALL SELECT n_regionkey, n_nationkey::VARCHAR, row, 'Note', 'a|b ' || n_name, 3 FROM r""",
    "toc_chunks": f"{_PACK_TOC} SELECT doc_id, unnest(range(1, len(out) + 1))::INT AS chunk_number, unnest(out) AS content, 'toc' AS chunk_type, '0' AS section_number FROM f",
    "virtual_chunks": f"""{_PACK_LEAVES} SELECT doc_id, parent_number AS parent_section, chunk_number, array_to_string(list_transform(g, lambda x: x.content), chr(10) || chr(10)) AS content, array_to_string(list_transform(g, lambda x: x.number), ',') AS section_numbers,
        len(g)::INT AS num_merged_sections, length(array_to_string(list_transform(g, lambda x: x.content), '..'))::INT AS char_count FROM v""",
    "merged_leaves": f"""{_PACK_LEAVES}, n AS (SELECT *, array_to_string(list_transform(g, lambda x: x.content), chr(10) || chr(10)) AS content FROM v)
        SELECT doc_id, true AS merged, parent_number AS parent_section, chunk_number, content, len(list_filter(regexp_split_to_array(content, '\\s+'), lambda w: w <> ''))::INT AS word_count, true AS is_complete_section, 'section_content' AS chunk_type FROM n""",
    "outline_summary": f"""WITH {_OUTLINE} SELECT doc_id, count(*) AS total_sections, count(*) FILTER (level = 3 OR NOT EXISTS (SELECT 1 FROM o p WHERE p.doc_id = o.doc_id AND p.parent_number = o.number)) AS total_chunks, 3 AS target_level, 1000 AS max_chunk_size, true AS has_toc FROM o GROUP BY doc_id""",
    "outline_documents": f"""WITH {_OUTLINE} SELECT doc_id, content AS page_content, number AS section_number, title AS section_title, level::VARCHAR AS section_level, parent_number, 'section' AS source_type, length(content)::VARCHAR AS char_count,
        len(list_filter(regexp_split_to_array(content, '\\s+'), lambda w: w <> ''))::VARCHAR AS word_count, coalesce((SELECT '["' || string_agg(c.number, '","' ORDER BY c.section_idx) || '"]' FROM o c WHERE c.doc_id = o.doc_id AND c.parent_number = o.number), '[]') AS children FROM o""",
    "section_positions": f"""WITH {_OUTLINE} SELECT doc_id, section_idx::INT AS section_idx, level, (sum(length(content) + 1) OVER before - length(content) - 1 + length(number) + 2)::INT AS start,
        (sum(length(content) + 1) OVER before + length(number) + 1)::INT AS end FROM o WINDOW before AS (PARTITION BY doc_id ORDER BY section_idx ROWS UNBOUNDED PRECEDING)""",
    "numbered_sections": f"""{_NUMBERED} SELECT s.doc_id, s.section_idx::INT AS section_idx, s.number, s.level::INT AS level, p.number AS parent_number,
        coalesce((SELECT string_agg(d.number, ',' ORDER BY d.section_idx) FROM s d WHERE d.doc_id = s.doc_id AND d.parent_idx = s.section_idx), '') AS children, array_to_string(lines, chr(10)) AS content, coalesce(first, -1)::INT AS para_first, coalesce(last, -1)::INT AS para_last
        FROM s JOIN b ON b.doc_id = s.doc_id AND b.section_idx = s.section_idx LEFT JOIN s p ON p.doc_id = s.doc_id AND p.section_idx = s.parent_idx LEFT JOIN m ON m.doc_id = s.doc_id AND m.section_idx = s.section_idx""",
    "numbered_lines": f"{_NUMBERED} SELECT doc_id, i AS line_idx, owner::INT AS owner FROM w",
    "wide_table_facts": """WITH c AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1), s AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1),
        r AS (SELECT n_regionkey AS doc_id, n_name AS item_name, r_name, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) + 3)::INT AS row, coalesce(c.n, 0)::VARCHAR AS cs, coalesce(s.n, 0)::VARCHAR AS ss
              FROM nation JOIN region ON r_regionkey = n_regionkey LEFT JOIN c ON c.k = n_nationkey LEFT JOIN s ON s.k = n_nationkey)
        SELECT doc_id, item_name, row, r_name || ',Parties,Customers' AS attributes, cs AS value, 2 AS col FROM r UNION ALL SELECT doc_id, item_name, row, r_name || ',Parties,Suppliers', ss, 3 FROM r""",
    "table_chunks": r"""WITH RECURSIVE c AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1), s AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1),
        e AS (SELECT n_regionkey AS d, 1 AS t, n_nationkey AS k, '| ' || n_nationkey || ' | ' || n_name || ' | a\|b ' || n_name || ' |' AS x, NULL AS name FROM nation
              UNION ALL SELECT n_regionkey, 2, n_nationkey, '{"item_name": "' || n_name || '", "row": ' || (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) + 3) || ', "facts": [{"attributes": ["' || r_name || '", "Parties", "Customers"], "value": "' || coalesce(c.n, 0)
                  || '", "col": 2}, {"attributes": ["' || r_name || '", "Parties", "Suppliers"], "value": "' || coalesce(s.n, 0) || '", "col": 3}]}', NULL FROM nation JOIN region ON r_regionkey = n_regionkey LEFT JOIN c ON c.k = n_nationkey LEFT JOIN s ON s.k = n_nationkey),
        g AS (SELECT r_regionkey AS d, t, r_name, list(x ORDER BY k) AS a, CASE t WHEN 1 THEN 500 - length('# ' || r_name || '|| Key | Name | Note ||| --- | --- | --- |') ELSE 500 - length('{"table_name": "' || r_name || '", "items": []}') END AS room, CASE t WHEN 1 THEN 1 ELSE 2 END AS gap FROM e JOIN region ON r_regionkey = d GROUP BY ALL),
        r AS (SELECT d, t, r_name, a, room, gap, 0 AS i, []::VARCHAR[] AS cur, 0::BIGINT AS size, []::VARCHAR[][] AS done FROM g
              UNION ALL SELECT d, t, r_name, a, room, gap, i + 1, CASE WHEN len(cur) > 0 AND size + length(a[i + 1]) + gap > room THEN [a[i + 1]] ELSE list_append(cur, a[i + 1]) END,
                  CASE WHEN len(cur) > 0 AND size + length(a[i + 1]) + gap > room THEN 0 ELSE size END + length(a[i + 1]) + gap, CASE WHEN len(cur) > 0 AND size + length(a[i + 1]) + gap > room THEN list_append(done, cur) ELSE done END FROM r WHERE i < len(a)),
        f AS (SELECT d, t, r_name, unnest(range(1, len(done) + 2))::INT AS chunk_number, unnest(list_append(done, cur)) AS rows FROM r WHERE i = len(a))
        SELECT d AS doc_id, t AS table_idx, chunk_number, CASE t WHEN 1 THEN '# ' || r_name || chr(10) || chr(10) || '| Key | Name | Note |' || chr(10) || '| --- | --- | --- |' || chr(10) || array_to_string(rows, chr(10))
            ELSE '```json' || chr(10) || '{"table_name": "' || r_name || '", "items": [' || array_to_string(rows, ', ') || ']}' || chr(10) || '```' END AS content FROM f""",
}
