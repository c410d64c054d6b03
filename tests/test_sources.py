import json

from pyspark.sql import functions as F

from tessera.operators import tables, toc
from tessera.sources import readers


def parsed_json():
    cell = lambda r, c, text, head=False: {"start_row_offset_idx": r, "end_row_offset_idx": r + 1, "start_col_offset_idx": c, "end_col_offset_idx": c + 1, "text": text, "column_header": head}
    texts = [{"text": " First text ", "prov": [{"page_no": 3, "bbox": {"l": 1.0, "t": 2.0, "r": 3.0, "b": 4.0}}]}, {"text": "Other", "prov": []}, {"text": "First text", "prov": [{"page_no": 4}]}]
    table = {"self_ref": "#/tables/0", "label": "Numbers", "prov": [{"page_no": 5}], "data": {"table_cells": [cell(0, 0, "Year", True), cell(0, 1, "Sales", True), cell(1, 0, "2024"), cell(1, 1, "$6.11")]}}
    return json.dumps({"texts": texts, "tables": [table]})


def test_files_by_format_and_companions(spark, tmp_path):
    (tmp_path / "a.md").write_text("# A\nx")
    (tmp_path / "a.json").write_text("{}")
    (tmp_path / "b.html").write_text("<p>x")
    (tmp_path / "c.txt").write_text("no")
    found = readers.files(spark, str(tmp_path))
    assert sorted((r.file_name, r.format) for r in found.collect()) == [("a.json", "json"), ("a.md", "markdown"), ("b.html", "html")]
    (row,) = readers.with_companions(found).collect()
    assert row.stem == "a" and row.companion == "{}"


def test_parsed_documents(spark):
    docs = readers.parsed(spark.createDataFrame([(1, parsed_json()), (2, "broken {")], "doc_id int, content string"))
    texts = {r.text: r for r in readers.json_texts(docs).collect()}
    assert texts["First text"].page == 4 and texts["First text"].ord == 0 and texts["Other"].page is None
    cells = readers.json_cells(docs)
    matrix = tables.cell_matrix(cells)
    (chunk,) = tables.table_chunks(matrix, cells.select("doc_id", "table_id", "label").distinct()).collect()
    assert chunk.text == "Table: Numbers\nYear | Sales\n---\n2024 | $6.11"
    (sample,) = tables.cell_samples(tables.rows_of(matrix)).collect()
    assert sample.cell_samples == ["Year: 2024", "Sales: $6.11"]
    chunks = spark.createDataFrame([(1, 0, "First text"), (1, 1, "H3: Other"), (1, 2, "a First text b"), (1, 3, "nowhere")], "doc_id int, chunk_id int, text string")
    pages = {r.chunk_id: r.page for r in readers.page_of(chunks, readers.json_texts(docs)).collect()}
    assert pages == {0: 4, 1: None, 2: 4, 3: None}


def test_collection(spark, tmp_path):
    c = readers.Collection(spark, str(tmp_path / "points"), 2)
    point = lambda m, k: (m, k, f"text {k}", [float(k), 1.0])
    rows = spark.createDataFrame([point("x", 1), point("x", 0), point("y", 0)], "method string, chunk_id int, text string, embedding array<float>")
    c.create(rows)
    c.append(rows.filter("method = 'y'"))
    assert {r.method: r.points for r in c.info().collect()} == {"x": 2, "y": 2}
    assert [r.chunk_id for r in c.by_method("x").collect()] == [0, 1] and c.point("x", 1).first().text == "text 1"
    assert {r.method: r.texts for r in readers.export_by_method(c.read()).collect()}["x"] == ["text 0", "text 1"]
    c.delete_method("x")
    assert [r.method for r in c.info().collect()] == ["y"]
    c.drop()


def test_logs(spark, tmp_path):
    path, schema = str(tmp_path / "log"), "q string, n int"
    assert readers.read_log(spark, path, schema).count() == 0
    for n in range(2):
        readers.append_log(spark.createDataFrame([("a", n)], schema), path)
    assert readers.read_log(spark, path, schema).agg(F.sum("n")).first()[0] == 1


def test_contents_and_sections(spark):
    text = "Item 1. Business | 5\nItem 2 Risk | 9\nnothing\nItem 3 End | 20"
    found = toc.parse_toc(spark.createDataFrame([(1, 0, text), (1, 1, "Other 3")], "doc_id int, ord int, text string"))
    assert [(r.title, r.page, r.prev_title, r.next_title) for r in found.orderBy("ord").collect()] == [("Business", 5, None, "Risk"), ("Risk", 9, "Business", "End"), ("End", 20, "Risk", None)]
    chunks = spark.createDataFrame([(1, 0, 4, ""), (1, 1, 12, ""), (1, 2, None, "x > Risk")], "doc_id int, chunk_id int, page int, headings_path string")
    assert {r.chunk_id: r.toc_title for r in toc.section_as_of(chunks, found).collect()} == {0: None, 1: "Risk", 2: "Risk"}
    assert [(r.parent, r.children) for r in toc.hierarchy(found).collect()] == [("Risk", []), ("End", [])]


def test_tables_of_two_documents_stay_apart(spark):
    """Two parsed documents whose tables have the same id: the cells and numbers of each are its own."""
    docs = readers.parsed(spark.createDataFrame([(1, parsed_json()), (2, parsed_json().replace("2024", "1999"))], "doc_id int, content string"))
    cells = readers.json_cells(docs)
    matrix = tables.cell_matrix(cells)
    assert {(r.doc_id, r.text) for r in matrix.filter("row = 1 AND col = 0").collect()} == {(1, "2024"), (2, "1999")}
    chunks = tables.table_chunks(matrix, cells.select("doc_id", "table_id", "label").distinct()).collect()
    assert sorted((r.doc_id, r.table_no) for r in chunks) == [(1, 1), (2, 1)]


def test_dispatch(spark):
    from tessera.sources import dispatch

    rows = [
        ("a", "markdown", "# Head\n\nsome words in a first paragraph of text"), ("b", "html", "<h1>T</h1><p>words of a page</p><table><tr><th>N<th>M<tr><td>5<td>six seven</table>"),
        ("c", "json", parsed_json()), ("d", "pdf", "x"), ("e", None, "x"), ("f", "markdown", None), ("g", "json", "broken {"),
    ]
    chunks, errors = dispatch.chunk_files(spark.createDataFrame(rows, "doc_id string, format string, content string"))
    found = {(r.doc_id, r.chunk_type) for r in chunks.collect()}
    assert {("a", "paragraph"), ("b", "table"), ("c", "table")} <= found
    told = {r.doc_id: r.error for r in errors.collect()}
    assert told == {"d": "Unsupported format: pdf", "e": "Unsupported format: unknown", "f": "No content", "g": "Not a parsed document"}
    empty = dispatch.chunk_files(spark.createDataFrame([], "doc_id string, format string, content string"))
    assert empty[0].count() == 0 and empty[1].count() == 0


def test_reports():
    from tessera.operators import answers, metrics

    text = metrics.report({"files": 2}, [{"format": "html", "files": 1}])
    assert text.split("\n")[2] == "| files | 2 |" and text.endswith("| html | 1 |")
    assert answers.flow_diagram("why", [("hop 1", 5)]) == "graph TD\n  s0[Query: why]\n  s1[hop 1: 5 chunks]\n  s0 --> s1"
