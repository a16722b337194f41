"""Tables: cells to grids, header analysis, Markdown and facts, and their chunks. Each table is worked on within its row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators.hierarchy import settled

_KEY = ["doc_id", "table_idx"]
_CELL = "array<struct<row:int,col:int,rowspan:int,colspan:int,text:string>>"


def origin_cells(raw: DataFrame) -> DataFrame:
    """Cells (doc_id, table_idx, row, ord, colspan, vmerge, text) with their place: ``row, col, rowspan, colspan, text``; continued cells go."""
    at = "sum(colspan) OVER (PARTITION BY doc_id, table_idx, row ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    placed = raw.withColumn("col", F.coalesce(F.expr(at), F.lit(0)).cast("int"))
    run = "count_if(vmerge IS NULL OR vmerge <> 'continue') OVER (PARTITION BY doc_id, table_idx, col ORDER BY row)"
    placed = placed.withColumn("run", F.expr(run))
    spans = placed.where("run > 0").withColumn("rowspan", F.expr("count(*) OVER (PARTITION BY doc_id, table_idx, col, run)").cast("int"))
    return spans.where("vmerge IS NULL OR vmerge <> 'continue'").withColumn("rowspan", F.expr("CASE WHEN vmerge = 'restart' THEN rowspan ELSE 1 END")).select(*_KEY, "row", "col", "rowspan", "colspan", "text")


def gathered(cells: DataFrame) -> DataFrame:
    """A row per table: its cells in order, rows, columns and whether any cell is merged."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col("row").cast("int"), F.col("col").cast("int"), F.col("rowspan").cast("int"), F.col("colspan").cast("int"), F.coalesce("text", F.lit("")).alias("text"))))
    found = cells.groupBy(*_KEY).agg(ordered.cast(_CELL).alias("cells"), F.max(F.col("row") + F.col("rowspan")).cast("int").alias("rows"), F.max(F.col("col") + F.col("colspan")).cast("int").alias("cols"))
    return found.withColumn("merged", F.exists("cells", lambda c: (c["rowspan"] > 1) | (c["colspan"] > 1)))


def grid(cells: DataFrame) -> DataFrame:
    """``row, col, text`` of every place of the grid; a merged cell's text is at each place it covers."""
    spread = cells.select(*_KEY, "text", F.col("row").alias("r0"), F.col("col").alias("c0"), F.explode(F.expr("sequence(row, row + rowspan - 1)")).alias("row"), "col", "colspan")
    return spread.select(*_KEY, "row", F.explode(F.expr("sequence(col, col + colspan - 1)")).alias("col"), "text")


def _bare(text: str) -> str:
    return f"trim(BOTH '{T.WHITE}' FROM {text})"


def structured(cells: DataFrame) -> DataFrame:
    """Tables with ``grid`` (row by row, each place its cell, or null), ``lines`` (each row's distinct cells), ``header_rows``, ``header_cols`` and ``attrs``, the global attribute that holds at each row."""
    t = gathered(cells)
    cover = "flatten(transform(cells, (c, k) -> flatten(transform(sequence(c.row, c.row + c.rowspan - 1), r -> transform(sequence(c.col, c.col + c.colspan - 1), q -> named_struct('p', r * cols + q, 'k', k))))))"
    t = settled(t, cover=f"array_sort(concat({cover}, transform(sequence(0, rows * cols - 1), p -> named_struct('p', p, 'k', 2147483647))))")
    t = settled(t, grid="transform(filter(cover, (e, j) -> j = 0 OR e.p <> cover[j - 1].p), e -> get(cells, e.k))").drop("cover")
    t = settled(t, lines="transform(sequence(0, rows - 1), r -> array_distinct(filter(slice(grid, r * cols + 1, cols), c -> c IS NOT NULL)))")
    t = settled(
        t,
        full="transform(lines, l -> exists(l, c -> c.col = 0 AND c.colspan >= cols AND c.text <> ''))",
        part="transform(lines, l -> exists(l, c -> c.colspan > 1 AND c.colspan < cols))",
        said="transform(lines, l -> filter(l, c -> c.text <> ''))",
        header_cols="array_distinct(array_sort(concat(array(0), transform(filter(cells, c -> c.rowspan > 1), c -> c.col))))",
    )
    # the row after one with partly merged cells heads the table as well; a lone text on the left, or one across, holds for the rows below
    t = settled(
        t,
        header_rows="filter(sequence(0, rows - 1), r -> (r = 0 AND cols > 2) OR (r > 0 AND get(part, r - 1) AND NOT get(full, r - 1)))",
        own="transform(said, (l, r) -> CASE WHEN (size(l) = 1 AND l[0].col = 0) OR (full[r] AND size(l) > 0) THEN l[0].text END)",
    ).drop("full", "part", "said")
    t = settled(t, marks="filter(sequence(0, rows - 1), r -> own[r] IS NOT NULL)", heads="filter(sequence(0, rows - 1), r -> array_contains(header_rows, r) OR exists(lines[r], c -> c.colspan > 1))")
    return settled(t, attrs="transform(sequence(0, rows - 1), r -> get(own, array_max(filter(marks, m -> m <= r))))").drop("own", "marks")


def facts(cells: DataFrame) -> DataFrame:
    """``doc_id, table_idx, merged, items``: of each row that isn't a header, its item and the facts of its unmerged data cells.

    A fact's attributes are the global one, what stands above its cell in header rows and merged cells, from the top, and
    what stands left of it in header columns and merged cells, from the nearest, without repeats, blanks and the item's name.
    Rows and columns count from 1.
    """
    t = structured(cells)
    bare = _bare("x")
    name = f"coalesce(get(filter(transform(reverse(header_cols), h -> element_at(transform(array(get(grid, r * cols + h).text), x -> {bare}), 1)), x -> x <> ''), 0), get(filter(transform(filter(lines[r], c -> c.row = r AND NOT array_contains(header_cols, c.col)), c -> element_at(transform(array(c.text), x -> {bare}), 1)), x -> x <> ''), 0))"
    above = "array_distinct(filter(transform(filter(heads, q -> q < r), q -> named_struct('q', array_contains(header_rows, q), 'c', get(grid, q * cols + d.col))), e -> e.c.text <> '' AND (e.q OR e.c.colspan > 1)).c)"
    left = "array_distinct(filter(transform(filter(reverse(sequence(0, cols - 1)), q -> q < d.col), q -> named_struct('q', array_contains(header_cols, q), 'c', get(grid, r * cols + q))), e -> e.c.text <> '' AND (e.q OR e.c.rowspan > 1)).c)"
    attributes = f"array_distinct(filter(concat(array(attrs[r]), {above}.text, {left}.text), x -> x IS NOT NULL AND x <> '' AND x <> item))"
    found = f"transform(filter(lines[r], d -> d.row = r AND d.rowspan = 1 AND d.colspan = 1 AND NOT array_contains(header_cols, d.col)), d -> named_struct('attributes', {attributes}, 'value', {_bare('d.text')}, 'col', d.col + 1))"
    t = settled(t, names=f"transform(sequence(0, rows - 1), r -> CASE WHEN NOT array_contains(header_rows, r) THEN {name} END)")
    items = f"transform(filter(sequence(0, rows - 1), r -> names[r] IS NOT NULL), r -> element_at(transform(array(names[r]), item -> named_struct('item_name', item, 'row', r + 1, 'facts', {found})), 1))"
    return settled(t, items=F.filter(F.expr(items), lambda i: F.size(i["facts"]) > 0)).select(*_KEY, "merged", "items")


def markdown(cells: DataFrame, names: DataFrame, most: int | None = None) -> DataFrame:
    """``doc_id, table_idx, chunk_number, content``: a table as Markdown under its name; with ``most``, chunks of whole rows that repeat the header, one row at least.

    A column without a heading is called "Колонка" and its number. Runs of blanks become one in the whole, in chunks only in the name.
    """
    cell = f"regexp_replace(replace({_bare('x.text')}, '|', '\\\\|'), '[\\n\\r]', ' ')"
    place = f"element_at(transform(array(get(grid, r * cols + k)), x -> coalesce({cell}, '')), 1)"
    row = f"concat('| ', array_join(transform(sequence(0, cols - 1), k -> {place}), ' | '), ' |')"
    head = f"element_at(transform(array(coalesce(get(header_rows, 0), -1)), r -> concat('| ', array_join(transform(sequence(0, cols - 1), k -> coalesce(nullif(CASE WHEN r >= 0 THEN {place} ELSE '' END, ''), concat('Колонка ', k + 1))), ' | '), ' |')), 1)"
    t = settled(structured(cells), head=head, body=f"transform(filter(sequence(0, rows - 1), r -> NOT array_contains(header_rows, r)), r -> {row})", rule="concat('|', repeat(' --- |', cols))")
    t = t.select(*_KEY, "head", "body", "rule").join(names, _KEY, "left").withColumn("name", T.normalize_whitespace(F.coalesce("name", F.lit(""))))
    t = t.withColumn("top", F.concat(F.lit("# "), "name", F.lit("\n\n"), "head", F.lit("\n"), "rule"))
    if most is None:
        return t.select(*_KEY, F.lit(1).alias("chunk_number"), T.normalize_whitespace(F.concat_ws("\n", F.col("top"), F.when(F.size("body") > 0, F.array_join("body", "\n")))).alias("content"))
    t = settled(t, cuts=_cuts("transform(body, x -> length(x) + 1)", f"{most} - length(top)"))
    part = "slice(body, a + 1, coalesce(get(cuts, k + 1), size(body)) - a)"
    text = f"CASE WHEN size(body) = 0 THEN top ELSE concat(top, '\\n', array_join({part}, '\\n')) END"
    return t.select(*_KEY, F.posexplode_outer(F.expr(f"transform(cuts, (a, k) -> {text})")).alias("k", "content")).where("k is not null").select(*_KEY, (F.col("k") + 1).alias("chunk_number"), "content")


def _cuts(sizes: str, room: str) -> Column:
    """Where parts begin when elements of these sizes are put together while they fit, one at least in each."""
    fold = "CASE WHEN s.n > 0 AND s.size + x > {r} THEN named_struct('n', 1, 'size', x, 'cuts', concat(s.cuts, array(s.i)), 'i', s.i + 1) ELSE named_struct('n', s.n + 1, 'size', s.size + x, 'cuts', s.cuts, 'i', s.i + 1) END".format(r=room)
    return F.expr(f"aggregate({sizes}, named_struct('n', 0, 'size', 0, 'cuts', cast(array() AS array<int>), 'i', 0), (s, x) -> {fold}, s -> concat(array(0), s.cuts))")


def fact_chunks(found: DataFrame, names: DataFrame, most: int = 1000) -> DataFrame:
    """``doc_id, table_idx, chunk_number, content``: facts as fenced JSON.

    Items are put together while they fit, the fence not counted. One that doesn't fit alone stands by itself and is split
    between its facts, one at least in each part, the fence counted. A table without an item gives one chunk.
    """
    space = T.normalize_whitespace
    t = found.join(names, _KEY, "left").withColumn("name", space(F.coalesce("name", F.lit(""))))
    clean = F.transform("items", lambda i: F.struct(i["item_name"].alias("item_name"), i["row"].alias("row"), F.transform(i["facts"], lambda f: F.struct(F.transform(f["attributes"], space).alias("attributes"), space(f["value"]).alias("value"), f["col"].alias("col"))).alias("facts")))
    t = settled(t, items=clean)
    t = settled(t, texts=F.transform("items", T.item_json), shown=T.json_string(F.col("name")))
    # the name counts as it is written, not as it is quoted
    t = settled(t, room=F.lit(most - len('{"table_name": "", "items": []}')) - F.length("name"), sizes="transform(texts, x -> length(x) + 2)")
    group = "CASE WHEN x > room THEN named_struct('size', 0, 'open', false, 'groups', concat(s.groups, array(named_struct('a', s.i, 'n', -1))), 'i', s.i + 1) WHEN s.open AND s.size + x <= room THEN named_struct('size', s.size + x, 'open', true, 'groups', concat(slice(s.groups, 1, size(s.groups) - 1), array(named_struct('a', element_at(s.groups, -1).a, 'n', element_at(s.groups, -1).n + 1))), 'i', s.i + 1) ELSE named_struct('size', x, 'open', true, 'groups', concat(s.groups, array(named_struct('a', s.i, 'n', 1))), 'i', s.i + 1) END"
    t = settled(t, groups=f"aggregate(sizes, named_struct('size', 0, 'open', false, 'groups', cast(array() AS array<struct<a:int,n:int>>), 'i', 0), (s, x) -> {group}, s -> CASE WHEN size(s.groups) > 0 THEN s.groups ELSE array(named_struct('a', 0, 'n', 0)) END)")
    t = settled(t.select(*_KEY, "shown", "items", "texts", F.posexplode("groups").alias("g", "group")), item=F.expr("get(items, group.a)"), body=F.expr("array_join(slice(texts, group.a + 1, greatest(group.n, 0)), ', ')")).drop("items", "texts")
    big = F.col("group.n") < 0
    part = lambda facts: F.struct(space(F.col("item.item_name")).alias("item_name"), F.col("item.row").alias("row"), facts.alias("facts"))
    empty = F.length(T.item_json(part(F.expr("slice(item.facts, 1, 0)")))) + F.length("shown") + len('```json\n{"table_name": , "items": []}\n```')
    t = settled(t, room=F.lit(most + 2) - empty, sizes=F.transform("item.facts", lambda f: F.length(T.fact_json(f)) + 2))
    t = settled(t, cuts=F.when(big, _cuts("sizes", "room")).otherwise(F.array(F.lit(0))))
    t = settled(t.select(*_KEY, "g", "shown", "item", "group", "body", "cuts", F.posexplode("cuts").alias("j", "a")), piece=F.expr("slice(item.facts, a + 1, coalesce(get(cuts, j + 1), size(item.facts)) - a)"))
    inner = F.when(big, T.item_json(part(F.col("piece")))).otherwise(F.col("body"))
    text = space(F.concat(F.lit('```json\n{"table_name": '), "shown", F.lit(', "items": ['), inner, F.lit("]}\n```")))
    return t.select(*_KEY, F.expr("row_number() OVER (PARTITION BY doc_id, table_idx ORDER BY g, j)").cast("int").alias("chunk_number"), text.alias("content"))


def fact_documents(found: DataFrame, names: DataFrame) -> DataFrame:
    """``doc_id, table_idx, content, error``: all facts of a table as fenced, indented JSON; a table without a name has an error instead."""
    deep = lambda k: "\n" + "  " * k

    def listed(parts: Column, k: int) -> Column:
        return F.when(F.size(parts) == 0, F.lit("[]")).otherwise(F.concat(F.lit("[" + deep(k + 1)), F.array_join(parts, "," + deep(k + 1)), F.lit(deep(k) + "]")))

    def fact(f: Column) -> Column:
        return F.concat(F.lit("{" + deep(5) + '"attributes": '), listed(F.transform(f["attributes"], T.json_string), 5), F.lit("," + deep(5) + '"value": '), T.json_string(f["value"]), F.lit("," + deep(5) + '"col": '), f["col"].cast("string"), F.lit(deep(4) + "}"))

    def item(i: Column) -> Column:
        return F.concat(F.lit("{" + deep(3) + '"item_name": '), T.json_string(i["item_name"]), F.lit("," + deep(3) + '"row": '), i["row"].cast("string"), F.lit("," + deep(3) + '"facts": '), listed(F.transform(i["facts"], fact), 3), F.lit(deep(2) + "}"))

    t = found.join(names, _KEY, "left")
    text = F.concat(F.lit("```json\n{" + deep(1) + '"table_name": '), T.json_string(F.col("name")), F.lit("," + deep(1) + '"items": '), listed(F.transform("items", item), 1), F.lit("\n}\n```"))
    known = F.coalesce(F.col("name"), F.lit("")) != ""
    return t.select(*_KEY, F.when(known, text).alias("content"), F.when(~known, F.lit("a table needs a name")).alias("error"))


def documents(cells: DataFrame, names: DataFrame) -> DataFrame:
    """``doc_id, table_idx, content, error``: tables with merged cells as facts, plain ones as Markdown."""
    found = facts(cells)
    plain = markdown(cells, names).join(found.where("NOT merged").select(*_KEY), _KEY).join(names, _KEY, "left")
    known = F.coalesce(F.col("name"), F.lit("")) != ""
    plain = plain.select(*_KEY, F.when(known, F.col("content")).alias("content"), F.when(~known, F.lit("a table needs a name")).alias("error"))
    return fact_documents(found.where("merged"), names).unionByName(plain)


def chunks(cells: DataFrame, names: DataFrame, most: int = 1000) -> DataFrame:
    """``doc_id, table_idx, chunk_number, content``: tables with merged cells as chunks of facts, plain ones of Markdown."""
    found = facts(cells)
    plain = markdown(cells, names, most).join(found.where("NOT merged").select(*_KEY), _KEY)
    return fact_chunks(found.where("merged"), names, most).unionByName(plain)
