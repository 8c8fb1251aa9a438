import datetime as dt
import zipfile
from xml.sax.saxutils import escape

import pytest
from pyspark.sql import functions as F

from kinmatch.operators import upsert
from kinmatch.plans.presets import PROJECT_FIELDS, PROJECT_JSON, PROJECT_SCHEMA, PROJECT_UPSERT
from kinmatch.sources import batches, tables

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def workbook(path, rows):
    """A small workbook: shared texts for the first row, inline texts and numbers below."""
    shared = [str(v) for v in rows[0]]
    lines = []
    for n, row in enumerate(rows, 1):
        cells = []
        for i, value in enumerate(row):
            ref = f"{chr(65 + i)}{n}"
            if value is None:
                continue
            if n == 1:
                cells.append(f'<c r="{ref}" t="s"><v>{i}</v></c>')
            elif isinstance(value, dt.date):
                days = (value - dt.date(1899, 12, 30)).days
                cells.append(f'<c r="{ref}" s="1"><v>{days}</v></c>')
            elif isinstance(value, int):
                cells.append(f'<c r="{ref}"><v>{value}</v></c>')
            else:
                cells.append(f'<c r="{ref}" t="inlineStr"><is><t>{escape(value)}</t></is></c>')
        if cells:
            lines.append(f'<row r="{n}">{"".join(cells)}</row>')
    with zipfile.ZipFile(path, "w") as book:
        book.writestr(
            "xl/workbook.xml",
            f'<workbook {MAIN} {REL}><sheets><sheet name="s" sheetId="1" r:id="rId1"/></sheets></workbook>',
        )
        book.writestr(
            "xl/_rels/workbook.xml.rels",
            '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
        )
        book.writestr(
            "xl/sharedStrings.xml",
            f"<sst {MAIN}>" + "".join(f"<si><t>{escape(t)}</t></si>" for t in shared) + "</sst>",
        )
        book.writestr(
            "xl/styles.xml",
            f'<styleSheet {MAIN}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
        )
        book.writestr(
            "xl/worksheets/sheet1.xml", f"<worksheet {MAIN}><sheetData>{''.join(lines)}</sheetData></worksheet>"
        )


def test_workbooks(spark, tmp_path):
    workbook(
        tmp_path / "a.xlsx",
        [
            [" Project_Code", "PROJECT_NAME ", "project_from_date", "grade_code"],
            ["P1", "One & two", dt.date(2026, 1, 1), "N/A"],
            [None, None, None, None],
            ["P2", " ", None, 7],
        ],
    )
    workbook(tmp_path / "b.xlsx", [["project_code"], ["P3"]])
    (tmp_path / "c.xlsx").write_bytes(b"not a workbook")
    cells = batches.read_batch(spark, str(tmp_path), ".XLSX")
    problems = {r.file.rsplit("/")[-1]: r.problem for r in batches.workbook_problems(cells).collect()}
    assert set(problems) == {"b.xlsx", "c.xlsx"} and "project_name" in problems["b.xlsx"]

    assert {r.file[-6:] for r in batches.workbook_columns(cells, []).collect()} == {"a.xlsx"}

    good = cells.filter(F.col("file").endswith("a.xlsx"))
    rows = batches.workbook_columns(good, ["project_code", *PROJECT_FIELDS]).orderBy("row_no").collect()
    assert [(r.row_no, r.project_code, r.project_name) for r in rows] == [
        (2, "P1", "One & two"), (3, None, None), (4, "P2", " "),
    ]
    assert rows[0].project_from_date == "2026-01-01 00:00:00" and rows[0].grade_code is None
    assert rows[2].grade_code == "7" and "summary" not in rows[0].present

    spec = upsert.UpsertSpec(**{**PROJECT_UPSERT.__dict__, "present_col": "present"})
    base = spark.createDataFrame([], PROJECT_SCHEMA)
    batch = batches.workbook_columns(good, ["project_code", *PROJECT_FIELDS])
    changes = upsert.upsert_changes(base, batch, spec)
    assert {r.row_no: r.action for r in changes.collect()} == {2: "inserted", 3: "error", 4: "inserted"}
    merged = upsert.merged_records(base, changes, spec, run_time=F.current_timestamp())
    dates = {r.project_code: r.project_from_date for r in merged.collect()}
    assert dates == {"P1": dt.date(2026, 1, 1), "P2": None}


def test_delimited_rows_are_numbered_per_file(spark, tmp_path):
    for name, n in (("x", 3000), ("y", 5)):
        lines = [" PROJECT_CODE ,Project_Name", *[f"{name}{i},n{i}" for i in range(n)]]
        (tmp_path / f"{name}.csv").write_text("\n".join(lines) + "\n")
    df = batches.read_batch(spark, str(tmp_path), ".csv")
    for r in df.collect():
        assert r.row_no == int(r.project_code[1:]) + 2
    assert df.count() == 3005


def test_files_are_read_by_their_own_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("project_code,project_name\nP1,One\n")
    (tmp_path / "b.csv").write_text("\ufeffPROJECT_NAME ,Grade_Code, project_code\nTwo,A,P2\n,,\n")
    (tmp_path / "c.csv").write_text('project_name,project_code\n"Three, ""3""\nlines",P3\nFour,P4\n')
    (tmp_path / "d.csv").write_text("project_name,grade_code\nFive,B\n")
    (tmp_path / "e.csv").write_text("project_code,project_name,Project_Code\nP6,Six,P6\n")
    (tmp_path / "f.csv").write_text("")
    (tmp_path / "g.csv").write_text("project_code,,project_name\nP7,x,Seven\nP8\n")
    (tmp_path / "h [1] é%20{x}.csv").write_text("project_code,project_name\nP9,Nine\n")
    rows, problems = batches.read_delimited(spark, str(tmp_path))
    got = {(r.file[-5:], r.row_no): (r.project_code, r.project_name, r.grade_code, sorted(r.present)) for r in rows.collect()}
    two, three = ["project_code", "project_name"], ["grade_code", "project_code", "project_name"]
    assert got == {
        ("a.csv", 2): ("P1", "One", None, two), ("b.csv", 2): ("P2", "Two", "A", three),
        ("b.csv", 3): (None, None, None, three), ("c.csv", 2): ("P3", 'Three, "3"\nlines', None, two),
        ("c.csv", 3): ("P4", "Four", None, two), ("g.csv", 2): ("P7", "Seven", None, two), ("g.csv", 3): ("P8", None, None, two),
        ("D.csv", 2): ("P9", "Nine", None, two),
    }
    why = {r.file[-5:]: r.problem for r in problems.collect()}
    assert set(why) == {"d.csv", "e.csv", "f.csv"}
    assert "project_code" in why["d.csv"] and "twice" in why["e.csv"] and why["f.csv"] == "no header"
    plans = rows._jdf.queryExecution().executedPlan().toString()
    assert "multiLine" not in plans or plans.count("FileScan csv") >= 3


def test_files_apply_one_after_the_other(spark, tmp_path):
    """The same key in two files of other headers: later files see what earlier ones wrote."""
    (tmp_path / "1.csv").write_text("project_code,project_name,grade_code\nP1,One,A\n")
    (tmp_path / "2.csv").write_text("project_name,project_code\nOne b,P1\nTwo,P2\n")
    batch = batches.read_batch(spark, str(tmp_path), ".csv")
    spec = upsert.UpsertSpec(**{**PROJECT_UPSERT.__dict__, "present_col": "present", "file_col": "file"})
    base = spark.createDataFrame([], PROJECT_SCHEMA)
    changes = upsert.upsert_changes(base, batch, spec)
    got = sorted((r.file[-5:], r.row_no, r.action) for r in changes.collect())
    assert got == [("1.csv", 2, "inserted"), ("2.csv", 2, "updated"), ("2.csv", 3, "inserted")]
    merged = upsert.merged_records(base, changes, spec, run_time=F.current_timestamp())
    assert {r.project_code: (r.project_name, r.grade_code) for r in merged.collect()} == {"P1": ("One b", "A"), "P2": ("Two", None)}


def test_a_folder_without_a_usable_file_is_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name\nx\n")
    with pytest.raises(batches.BatchError, match="required columns"):
        batches.read_batch(spark, str(tmp_path), ".csv")
    with pytest.raises(batches.BatchError, match="not found"):
        batches.read_batch(spark, str(tmp_path / "nothing"), ".csv")



def test_row_numbers_across_tasks(spark):
    rows = spark.range(0, 100, 1, 7).withColumn("file", F.when(F.col("id") < 33, "a").otherwise("b"))
    for r in batches.with_row_numbers(rows, "file").collect():
        assert r.row_no == (r.id if r.file == "a" else r.id - 33) + 2


def test_whole_batch_failures(spark, tmp_path):
    (tmp_path / "x.csv").write_text("project_code,other\n1,2\n")
    with pytest.raises(batches.BatchError, match="project_name"):
        batches.read_batch(spark, str(tmp_path / "x.csv"), ".csv")
    with pytest.raises(batches.BatchError, match="unsupported"):
        batches.read_batch(spark, str(tmp_path / "x.csv"), ".txt")
    with pytest.raises(batches.BatchError, match="not found"):
        batches.read_batch(spark, str(tmp_path / "none.csv"), ".csv")


def test_tables(spark, tmp_path):
    row = ("P1", "n", "A", None, None, dt.date(2026, 1, 1), None, None, None, "요약", None, None, None, None)
    table = tables.create_table(spark, [row], PROJECT_SCHEMA, str(tmp_path / "seed"))
    assert table.schema["project_from_date"].dataType.simpleString() == "date"
    first = tables.publish(table, str(tmp_path / "versions"))
    second = tables.publish(spark.read.parquet(first), str(tmp_path / "versions"))
    assert first != second and spark.read.parquet(second).count() == 1
    shown = tables.as_json(tables.renamed(table, PROJECT_JSON), ["projectCode", "projectFromDate", "summary", "sapPhase"])
    text = shown.first().json
    assert text == '{"projectCode":"P1","projectFromDate":"2026-01-01","summary":"요약","sapPhase":null}'
    tables.write_json_lines(shown, str(tmp_path / "json"))
    assert spark.read.text(str(tmp_path / "json")).first()[0] == text


def test_settled_uses_the_shared_folder(spark):
    df = spark.range(5)
    kept = tables.settled(df)
    assert sorted(r.id for r in kept.collect()) == list(range(5))
    if spark.conf.get("spark.checkpoint.dir", None):
        assert kept.inputFiles()
    else:
        assert kept is df
