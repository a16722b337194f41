import json
import re
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusloom import catalog
from corpusloom.functions import text as T
from corpusloom.operators import chunks as C
from corpusloom.operators import greedy, numbering, relations, tables
from corpusloom.operators import hierarchy as H
from corpusloom.plans import api
from corpusloom.plans.options import ChunkOptions
from corpusloom.sources import files
from corpusloom.streaming.ingest import chunk_stream

NESTED = "1. Введение\nТекст введения.\n1.1. Подраздел\nТекст подраздела."
TABLE = "1. A\n1.1. B\n1.1. C\nТаблица 1\nИмя\n```json\n{}\n```\nafter"


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_preamble_ends_at_the_last_number_before_a_verb(spark):
    found = [(r.number, r.content) for r in H.sections(docs(spark, NESTED)).orderBy("section_idx").collect()]
    assert found == [("0", "1. Введение\nТекст введения."), ("1.1", "1.1. Подраздел\nТекст подраздела.")]


def test_repeated_number_and_fenced_table(spark):
    found = H.sections(docs(spark, TABLE)).orderBy("section_idx").collect()
    assert [(r.number, r.level, r.parent_number) for r in found] == [("1", 1, None), ("1.1", 2, "1"), ("1.1.1", 3, "1.1"), ("1.1.1.T1", 4, "1.1.1")]
    assert found[3].content == "Таблица 1\nИмя\n```json\n{}\n```" and found[2].tables == ["1.1.1.T1"] and found[2].content.endswith("after")


def test_flat_list_rules(spark):
    d = docs(spark, "2. X\n1. Y\n2. Z\n1. q\n3. w", None, "", " \n ")
    assert [(r.number, r.content) for r in H.sections(d).orderBy("section_idx").collect()] == [("1", "1. Y"), ("2", "2. Z\n1. q\n3. w")]
    assert [(r.list_type, r["items"]) for r in H.flat_lists(d).collect()] == [("flat_list", ["2. X"])]


@pytest.mark.parametrize("line, kind, number", [("1.1. Title", "multi_level", "1.1"), ("1.2.3 Title", "multi_level", "1.2"), ("2024 год", "paragraph", None), ("5 яблок", "multi_level", "5"), ("5) x", "simple_numbered", "5"), ("• x", "bulleted", "•"), ("word", "lettered", "w"), ("Word", "paragraph", None)])
def test_line_kinds(spark, line, kind, number):
    row = H.with_lines(docs(spark, line)).select(H.classified().alias("c")).first().c[0]
    assert (row.kind, row.number) == (kind, number)


@pytest.mark.parametrize("most, overlap, parts, found", [(10, 4, ["aaaa", "bbbb", "cc", "ddddddd"], [("aaaa\nbbbb", 1, 10), ("bbbb\ncc", 6, 13), ("cc\nddddddd", 11, 21)]), (5, 3, ["ab", "cdefghijklm"], [("ab", 1, 3), ("cdefg", 0, 5), ("hijkl", 5, 10), ("m", 10, 11)])])
def test_packing(spark, most, overlap, parts, found):
    rows = spark.createDataFrame([(parts,)], "els array<string>").withColumn("sizes", F.transform("els", F.length)).withColumn("r", greedy.ranges("sizes", most, overlap))
    assert [(p.content, p.start_pos, p.end_pos) for p in rows.select(greedy.pieces("els", "r").alias("p")).first().p] == found


def test_toc_and_sibling_merge(spark):
    toc = spark.createDataFrame([(1, ["1. A", "1.1. B"])], "doc_id long, lines array<string>")
    assert C.toc_chunks(toc, 10).count() == 2
    sections = spark.createDataFrame([(1, i, str(i), 0, "p", [], t) for i, t in enumerate(["aaaa", "bbbb", "cccc"])], "doc_id long, section_idx int, number string, parent_idx int, parent_number string, children array<string>, content string")
    assert [r.content for r in C.virtual_chunks(sections, 10, 4).orderBy("chunk_number").collect()] == ["aaaa\n\nbbbb", "bbbb\n\ncccc"]


@pytest.mark.parametrize("levels, text, found", [([1, 2], "\tX", "1.2. \tX"), ([3], "\t\tX", "1.1.3. \t\tX"), ([3], "\t\t1)\tX", "1.1.3. X"), ([3], "1)\t", None), (None, "01.2. X", "1.2. X")])
def test_numbering(spark, levels, text, found):
    row = spark.createDataFrame([(text, levels)], "text string, levels array<int>")
    assert row.select(numbering.restored(F.col("text"), F.col("levels"))).first()[0] == found


def test_verbs_and_decoding(spark):
    row = spark.createDataFrame([("Система определяет", "The system runs", "привет".encode("cp1251"), "﻿привет\r\nx".encode())], "a string, b string, c binary, d binary")
    assert row.select(T.contains_verb(F.col("a")), T.contains_verb(F.col("b")), T.decoded(F.col("c")), T.plain_text(F.col("d"))).first()[:] == (True, False, "привет", "привет\nx")


def test_merged_cells_and_facts(spark):
    raw = [(1, 1, 0, 0, 1, None, "Item"), (1, 1, 0, 1, 2, None, "Year"), (1, 1, 1, 0, 1, "restart", "Dig"), (1, 1, 1, 1, 1, None, "2024"), (1, 1, 1, 2, 1, None, "2025"), (1, 1, 2, 0, 1, "continue", None), (1, 1, 2, 1, 1, None, "5"), (1, 1, 2, 2, 1, None, "7")]
    cells = tables.origin_cells(spark.createDataFrame(raw, "doc_id int, table_idx int, row int, ord int, colspan int, vmerge string, text string"))
    assert {(r.row, r.col, r.rowspan, r.colspan) for r in cells.collect()} >= {(1, 0, 2, 1), (0, 1, 1, 2)}
    item = tables.facts(cells).first()["items"][0]
    assert item.item_name == "Dig" and [(f.attributes, f.value, f.col) for f in item.facts] == [(["Year", "2024"], "5", 2), (["Year", "2025"], "7", 3)]
    names = spark.createDataFrame([(1, 1, "T")], "doc_id int, table_idx int, name string")
    parts = [r.content for r in tables.fact_chunks(tables.facts(cells), names, 60).orderBy("chunk_number").collect()]
    assert len(parts) == 2 and all(p.startswith("```json\n") for p in parts)


W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def _docx(path, *parts):
    """A DOCX of paragraphs (text, level or None) and tables (rows of cell texts, or of (text, colspan))."""
    def cell(c):
        text, span = c if isinstance(c, tuple) else (c, 1)
        return f'<w:tc><w:tcPr><w:gridSpan w:val="{span}"/></w:tcPr><w:p><w:r><w:t>{text}</w:t></w:r></w:p></w:tc>'

    body = ""
    for p in parts:
        if isinstance(p, list):
            body += "<w:tbl>" + "".join("<w:tr>" + "".join(map(cell, row)) + "</w:tr>" for row in p) + "</w:tbl>"
        else:
            mark = "" if p[1] is None else f'<w:pPr><w:numPr><w:ilvl w:val="{p[1]}"/><w:numId w:val="1"/></w:numPr></w:pPr>'
            body += f"<w:p>{mark}<w:r><w:t>{p[0]}</w:t></w:r></w:p>"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>')


PLAIN, MERGED = [["Key", "Name", "Note"], ["1", "a|b", ""]], [[("Group", 3)], ["Item", ("Year", 2)], ["", "2024", "2025"], ["Dig", "5", "7"]]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("files")
    (at / "a.txt").write_text(NESTED)
    (at / "~b.txt").write_text("x")
    (at / "c.pdf").write_bytes(b"%PDF")
    (at / "bad.docx").write_bytes(b"no zip")
    _docx(at / "d.docx", ("Head", 0), ("Inner", 1), ("Таблица 1", None), ("Prices", None), PLAIN, ("More", 1), ("Таблица 2. Work", None), MERGED, ("", None), PLAIN)
    return at


def test_files(spark, folder):
    found = api.process_files(spark, str(folder))
    assert {r.path.rsplit("/", 1)[1] for r in found["errors"].collect()} == {"bad.docx", "c.pdf"}
    assert files.walk(spark, str(folder)).count() == 4
    assert {r.content for r in found["chunks"].collect()} >= {"1.1. Подраздел\nТекст подраздела."}
    rows = [r for r in found["sections"].orderBy("section_idx").collect() if r.doc_id.endswith("d.docx")]
    assert [(r.number, r.title, r.parent_number) for r in rows] == [("1", "Head", None), ("1.1", "Inner", "1"), ("1.2", "More", "1"), ("1.1.T1", "Таблица 1", "1.1"), ("1.2.T2", "Таблица 2. Work", "1.2")]
    assert rows[1].tables == ["1.1.T1"] and rows[2].children == ["1.2.T2"] and rows[1].para_first == 1
    tables_found = {r.table_id: r for r in found["table_chunks"].collect()}
    assert tables_found["Table_1"].content == "# Prices\n\n| Key | Name | Note |\n| --- | --- | --- |\n| 1 | a\\|b |  |" and tables_found["Table_1"].section_number == "1.1.T1"
    assert tables_found["Table_2"].content.startswith('```json\n{"table_name": "Work", "items": [{"item_name": "Dig"') and len(tables_found) == 2
    assert {(r.total_sections, r.total_chunks, r.has_toc, r.tables_count) for r in found["summary"].collect()} == {(2, 2, True, 0), (3, 2, True, 2)}
    assert api.folder_summary(found).first()[:] == (4, 2, 2)


def test_other_readers(spark, folder):
    found = api.process_files(spark, str(folder), readers={"pdf": lambda b: ["1. From " + b.decode()[1:], " "]})
    assert {r.path.rsplit("/", 1)[1] for r in found["errors"].collect()} == {"bad.docx"}
    assert "1. From PDF" in {r.content for r in found["chunks"].collect()}


def test_saving_and_converting(spark, folder, tmp_path):
    options = ChunkOptions(save_text=True, save_toc=True, save_table_json=True)
    found = api.process_files(spark, str(folder), options)
    api.save(found, str(tmp_path / "out"), options)
    names = {p.name for p in (tmp_path / "out/text").iterdir() if p.is_dir()}
    assert names == {f"name={x}" for x in ("a_extracted.txt", "d_extracted.txt", "a_toc.txt", "d_toc.txt", "d_table_1.json", "d_table_2.json")}
    assert spark.read.parquet(str(tmp_path / "out/table_chunks")).count() == 2
    api.save_json(found, str(tmp_path / "json"))
    docs_found = api.convert(spark, str(tmp_path / "json")).collect()
    kinds = [r.metadata["source_type"] for r in docs_found]
    assert kinds.count("section") == 7 and kinds.count("table") == 2
    (tmp_path / "x_hierarchical.json").write_text(json.dumps({"sections": [{"number": "1", "title": "T", "level": 1, "content": "a b", "children": [], "tables": [], "chunks": []}], "table_chunks": [{"content": "t", "metadata": {"table_name": "N", "chunk_number": 1}}]}))
    (tmp_path / "toc").mkdir()
    (tmp_path / "toc/x_toc.txt").write_text("1. T")
    assert files.find_results("x", str(tmp_path)) == (str(tmp_path / "x_hierarchical.json"), None)
    rows = api.convert(spark, str(tmp_path / "x_hierarchical.json"), str(tmp_path / "toc"), include_toc=True).collect()
    assert [(r.page_content, r.metadata["source_type"], r.metadata.get("word_count")) for r in rows] == [("a b", "section", "2"), ("t", "table", None), ("1. T", "toc", "2")]
    assert rows[1].metadata["table_name"] == "N"


def test_stream(spark, tmp_path):
    (tmp_path / "stream").mkdir()
    (tmp_path / "stream/a.txt").write_text(NESTED)
    chunk_stream(spark, str(tmp_path / "stream"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_split_documents(spark, folder):
    d = spark.createDataFrame([(1, NESTED, {"source": "x", "chunk_type": "old"}), (1, "other is a list", {"k": "v"}), (None, "third", None)], "doc_id long, page_content string, metadata map<string,string>")
    rows = sorted((r.page_content, r.metadata) for r in api.split_documents(d).collect() if r.metadata is not None)
    assert rows == [("1. Введение\nТекст введения.", {"source": "x", "chunk_type": "old"}), ("1.1. Подраздел\nТекст подраздела.", {"source": "x", "chunk_type": "old"})]
    assert api.split_documents(d.where("doc_id is null or page_content like '1%'")).count() == 2 + api.split_text(spark.createDataFrame([(1, "third")], "doc_id long, text string")).count()
    d = spark.createDataFrame([(1, "Body", {"source": str(folder / "d.docx"), "k": "v"}), (2, "Fallback", {"source": str(folder / "bad.docx")})], "doc_id long, page_content string, metadata map<string,string>")
    rows = api.split_documents(d, files=files.walk(spark, str(folder))).collect()
    assert [(r.page_content, r.metadata) for r in rows if r.doc_id == 2] == [("Fallback", {"source": str(folder / "bad.docx")})]
    own = [r.metadata for r in rows if r.doc_id == 1]
    assert len(own) == 4 and {m["chunk_type"] for m in own} == {"section_content", "table"} and all(m["k"] == "v" for m in own)


def test_options(tmp_path):
    with pytest.raises(ValueError):
        ChunkOptions(max_chunk_size=10, chunk_overlap=11)
    assert ChunkOptions.load("/nowhere", target_level=2).target_level == 2
    (tmp_path / "o.json").write_text('{"hierarchical_chunking": {"target_level": 9}, "other": {"save_toc_text": true}, "output": {"save_toc_text": true}, "table_processing": {"max_table_name_paragraphs": 2}}')
    found = ChunkOptions.load(str(tmp_path / "o.json"))
    assert (found.target_level, found.save_toc, found.save_text, found.max_name_paragraphs) == (3, True, False, 2)


def test_table_names_and_relations(spark):
    p = spark.createDataFrame([(1, i, t) for i, t in enumerate(["Таблица 1. Far", *"bcdefghij", "last", "x", "Таблица 2: Own", " ", "tail"])], "doc_id long, para_idx long, text string")
    t = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (1, 3, 12), (1, 4, 13), (1, 5, 14), (1, 6, 99), (1, 7, -1)], "doc_id long, table_idx int, paragraph_index_before int")
    found = {r.table_idx: (r.name, r.caption) for r in relations.table_names(p, t).collect()}
    assert found == {1: ("b c d e f g h i j last", "Таблица 1. Far"), 2: ("x", "x"), 3: ("Own", "Таблица 2: Own"), 4: ("Own", "Таблица 2: Own"), 5: ("tail", "Таблица 2: Own")}
    s = H.sections(docs(spark, "1. A\n1.1. B\nbody\n1.2. C\n2. D", "1. Z"))
    ctx = relations.context_of(s, spark.createDataFrame([(0, "1.1"), (0, "9")], "doc_id long, number string")).collect()
    assert {(r.number, r.parent_title, tuple(r.siblings or ()), r.error) for r in ctx} == {("1.1", "A", ("1.2",), None), ("9", None, (), "no section 9")}
    assert [r.number for r in relations.sections_by_path(s, ["A", "C"]).collect()] == ["1.2"] and not relations.sections_by_path(s, ["B", "C"]).collect()
    again = {(r.doc_id, r.number): (r.parent_idx, r.children) for r in relations.tree_of(s).collect()}
    assert again == {(r.doc_id, r.number): (r.parent_idx, r.children) for r in s.collect()}
    text = docs(spark, "1. A\n1.1. B\nbody\n1.2. C\n2. D", "1. Z")
    spans = relations.section_positions(s, text)
    assert [(r.start, r.end) for r in spans.where("doc_id = 0").orderBy("section_idx").collect()] == [(3, 7), (10, 21), (22, 28), (27, 31)]
    at = relations.section_at(spans, spark.createDataFrame([(0, 4), (0, 21), (0, 200)], "doc_id long, position int"))
    assert {(r.position, r.section_idx) for r in at.collect()} == {(4, 0), (21, 1), (200, None)}
    hit = relations.sections_with_text(s, spark.createDataFrame([(0, "B  body"), (0, "none")], "doc_id long, text string"))
    assert {(r.text, r.section_idx) for r in hit.collect()} == {("B  body", 1), ("none", None)}
    paths = relations.path_titles(s, spark.createDataFrame([(0, ["1", "1.1", "7"]), (0, [])], "doc_id long, path array<string>"))
    assert sorted(r.titles for r in paths.collect()) == [["A", "B", "7"], ["Root"]]
    assert [(r.parent_key, r.numbers) for r in C.leaf_groups(s).where("doc_id = 0").orderBy("place").collect()] == [("1", ["1.1", "1.2"]), ("root", ["2"])]


def test_merged_and_large_leaves(spark):
    long = "\n".join(["word " * 20] * 8)
    s = H.sections(docs(spark, f"1. A\n1.1. B\nb\n1.2. C\n{long}\n1.3. D"))
    found = C.merged_chunks(s, ChunkOptions(max_chunk_size=300, chunk_overlap=0)).collect()
    assert [r.section_numbers for r in found if r.merged] == [["1.1", "1.3"]] and {r.section_number for r in found if not r.merged} == {"1.2"}
    assert all(r.is_complete_section == r.merged for r in found)


def test_facts_of_wide_and_left_headers(spark):
    def row(r, cells):
        return [(1, 1, r, o, span, None, text) for o, (text, span) in enumerate(cells)]

    raw = row(0, [("Item", 1), ("Q1", 1), ("Q2", 1)]) + row(1, [("Ground", 3)]) + row(2, [(" Dig ", 1), ("", 1), ("2", 1)]) + row(3, [("Height", 3)]) + row(4, [("Fly", 1), ("3", 1), ("4", 1)])
    cells = tables.origin_cells(spark.createDataFrame(raw, "doc_id int, table_idx int, row int, ord int, colspan int, vmerge string, text string"))
    found = tables.facts(cells).first()["items"]
    assert [(i.item_name, i.row) for i in found] == [("Dig", 3), ("Fly", 5)]
    assert [(f.attributes, f.value) for f in found[0].facts] == [(["Ground", "Q1", " Dig "], ""), (["Ground", "Q2", " Dig "], "2")]
    assert found[1].facts[0].attributes == ["Height", "Q1", "Ground"]
    names = spark.createDataFrame([(1, 1, 'T "x"\t\x01')], "doc_id int, table_idx int, name string")
    text = tables.documents(cells, names).first().content
    want = {"table_name": 'T "x"\t\x01', "items": [{"item_name": i.item_name, "row": i.row, "facts": [f.asDict() for f in i.facts]} for i in found]}
    assert text == "```json\n" + json.dumps(want, ensure_ascii=False, indent=2) + "\n```"
    assert tables.documents(cells, names.withColumn("name", F.lit(""))).first().error
    for most in (60, 120, 200, 10_000):
        parts = [r.content for r in tables.fact_chunks(tables.facts(cells), names, most).orderBy("chunk_number").collect()]
        assert parts == _fact_chunks('T "x" \x01', [json.loads(json.dumps(i)) for i in want["items"]], most)


def _fact_chunks(name, items, most):
    """Brute force: sizes by writing the JSON out."""
    space = lambda x: re.sub(r"[ \t]+", " ", x)
    wrap = lambda xs: space("```json\n" + json.dumps({"table_name": name, "items": xs}, ensure_ascii=False) + "\n```")
    out, open_items, size = [], [], 0
    room = most - len(f'{{"table_name": "{name}", "items": []}}')
    for i in items:
        i = i | {"facts": [{"attributes": [space(a) for a in f["attributes"]], "value": space(f["value"]), "col": f["col"]} for f in i["facts"]]}
        n = len(json.dumps(i, ensure_ascii=False)) + 2
        if open_items and (n > room or size + n > room):
            out.append(wrap(open_items))
            open_items, size = [], 0
        if n > room:
            left = i["facts"]
            while left:
                k = max([1, *(k for k in range(1, len(left) + 1) if len(wrap([i | {"item_name": space(i["item_name"]), "facts": left[:k]}])) <= most)])
                out.append(wrap([i | {"item_name": space(i["item_name"]), "facts": left[:k]}]))
                left = left[k:]
        else:
            open_items.append(i)
            size += n
    return out + ([wrap(open_items)] if open_items else [])


def test_sections_grow_with_their_lines(spark):
    def took(n):
        text = "1. Top\n" + "\n".join(f"1.{k + 1}. Head {k}\nbody of {k}" for k in range(n))
        began = time.time()
        assert H.sections(docs(spark, text)).agg(F.count("content"), F.max("para_last")).first()[:] == (n + 1, 2 * n)
        return time.time() - began

    took(50)
    assert took(2000) < 12 * took(500) + 3


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_oracle(spark, name):
    duckdb = pytest.importorskip("duckdb")
    at, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "region", "nation", "customer", "supplier", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{at}/{t}.parquet')")
    mine, other = catalog.QUERIES[name](spark, at).toPandas(), con.execute(catalog.ORACLE_SQL[name]).df()
    columns = sorted(mine.columns)
    assert columns == sorted(other.columns)
    rows = lambda x: sorted(map(repr, x[columns].astype(object).where(x[columns].notna(), None).values.tolist()))
    assert rows(mine) == rows(other)


def _growth(frame, few, many):
    """Seconds for ``few`` and for ``many``, once the code is compiled."""
    def took(n):
        began = time.time()
        frame(n).write.format("noop").mode("overwrite").save()
        return time.time() - began

    took(50)
    return took(few), took(many)


def _flat(spark, n, text="Head {}"):
    """Rows of ``sections``: one document, a root and ``n`` leaves below it."""
    leaf = F.concat(F.lit(text.split("{")[0]), F.col("id").cast("string"))
    rows = spark.range(n + 1).select(
        F.lit(1).cast("long").alias("doc_id"), F.col("id").cast("int").alias("section_idx"), F.when(F.col("id") == 0, "1").otherwise(F.concat(F.lit("1."), F.col("id").cast("string"))).alias("number"), leaf.alias("title"), F.when(F.col("id") == 0, 1).otherwise(2).alias("level"),
        F.when(F.col("id") > 0, 0).alias("parent_idx"), F.when(F.col("id") > 0, "1").alias("parent_number"), F.when(F.col("id") == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("children"), leaf.alias("content"), F.lit(0).alias("para_first"), F.lit(n).alias("para_last"),
    )
    return rows


def test_sections_of_a_very_long_document(spark):
    few, many = _growth(lambda n: H.sections(docs(spark, "1. Top\n" + "\n".join(f"1.{k + 1}. Head {k}\nbody of {k}" for k in range(n)))), 2000, 16000)
    assert many < 12 * few + 3


def test_headings_that_are_no_lines(spark):
    d = docs(spark, "1.1. A\n1.1. B\n1.1. C\n1.1. D\n1.1.1. B\n1.1. A\n1.1.")
    found = [(r.number, r.para_first, r.para_last) for r in H.sections(d).orderBy("section_idx").collect()]
    assert found == [("1.1", 0, 5), ("1.1.1", 4, 4), ("1.1", 2, 2), ("1.1.2", None, None), ("1.1.1", 4, 4), ("1.1", 0, 5), ("1.1.3", None, None)]


def test_lines_that_are_not_utf8(spark):
    d = docs(spark, "x").select("doc_id", F.expr("cast(concat(cast('1. A\n' AS binary), X'FF41', cast('\n2. B' AS binary)) AS string)").alias("text"))
    assert [r.c for r in H.sections(d).orderBy("section_idx").select(F.hex("content").alias("c")).collect()] == [("1. A\n\ufffdA").encode().hex().upper(), b"2. B".hex().upper()]


def test_context_of_many_siblings(spark):
    found = relations.section_context(_flat(spark, 600)).collect()
    numbers = [f"1.{k}" for k in range(1, 601)]
    assert {(r.section_idx, r.parent_title) for r in found} == {(0, None), *((k, "Head 0") for k in range(1, 601))}
    assert all(r.siblings == [n for n in numbers if n != r.number] for r in found if r.section_idx) and len(found) == 601
    plan = catalog.section_context(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan  # which would give each member a copy of its family
    assert "BroadcastExchange" not in plan  # which would send what is gathered through the driver


def test_merging_many_leaves(spark):
    few, many = _growth(lambda n: C.virtual_chunks(_flat(spark, n), 60, 20), 2000, 40_000)
    assert many < 8 * few + 1


def test_paths_of_many_sections(spark):
    few, many = _growth(lambda n: relations.section_paths(_flat(spark, n)), 2000, 16000)
    assert many < 12 * few + 1
    s = H.sections(docs(spark, "1. A\n1.1. B\n1.1. C\n2. D"))
    assert [r.path for r in relations.section_paths(s).orderBy("section_idx").collect()] == [["A"], ["A", "B"], ["A", "B", "C"], ["D"]]


def test_positions_of_many_sections(spark):
    text = lambda n: docs(spark, "\n".join(f"Head {k} " + "z" * 60 for k in range(n + 1))).select((F.col("doc_id") + 1).alias("doc_id"), "text")
    few, many = _growth(lambda n: relations.section_positions(_flat(spark, n), text(n)), 2000, 16000)
    assert many < 12 * few + 1
    d = docs(spark, "1. Aé\n1.1.\n1.2. Aé\n2. C")
    assert [r.start for r in relations.section_positions(H.sections(d), d).orderBy("section_idx").collect()] == [3, 3, 3, 22]


def test_paragraphs_in_many_ranges(spark):
    lines = spark.range(80_001).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").cast("int").alias("line_idx"))
    began = time.time()
    assert relations.paragraph_sections(_flat(spark, 80_000), lines).groupBy("section_idx").count().collect() == [(80_000, 80_001)]
    assert time.time() - began < 20
    ranges = [(7 * k % 40, 3 * k % 50, 3 * k % 50 + k % 9) for k in range(40)]
    s = spark.createDataFrame([(1, *r) for r in ranges], "doc_id long, section_idx int, para_first int, para_last int")
    found = {r.line_idx: r.section_idx for r in relations.paragraph_sections(s, lines.where("line_idx < 70")).collect()}
    assert found == {i: max((k for k, a, b in ranges if a <= i <= b), default=None) for i in range(70)}
