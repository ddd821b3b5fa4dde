import io
import zipfile

import pytest

from conftest import rows
from edaspark.common import require_columns
from edaspark.sources import roles, scan


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv_types_and_missing_values(spark, tmp_path):
    path = write(
        tmp_path / "t.CSV",
        "id,id,,score,flag,part,code,when\n"
        "1,007,x,1.5,True,true,a1,2020-01-02\n"
        "2,NA,y,n/a,false,,b2,2020-01-03\n"
        '3,9,"z, ""q""",-2e3,TRUE,False,NULL,2020-01-04\n',
    )
    df = scan.load(spark, path)
    assert df.dtypes == [
        ("id", "bigint"), ("id.1", "bigint"), ("Unnamed: 2", "string"), ("score", "double"), ("flag", "boolean"),
        ("part", "string"), ("code", "string"), ("when", "string"),
    ]
    assert sorted(rows(df), key=lambda r: r[0]) == [
        (1, 7, "x", 1.5, True, "true", "a1", "2020-01-02"),
        (2, None, "y", None, False, None, "b2", "2020-01-03"),
        (3, 9, 'z, "q"', -2000.0, True, "False", None, "2020-01-04"),
    ]


def test_csv_quoted_line_breaks(spark, tmp_path):
    path = write(tmp_path / "t.csv", 'a,b\n1,"x\ny"\n2,z\n')
    assert sorted(rows(scan.load(spark, path))) == [(1, "x\ny"), (2, "z")]
    path = write(tmp_path / "u.csv", '"a\nb",c\n1,2\n"3\n4",5\n')
    found = scan.load(spark, path)
    assert found.columns == ["a\nb", "c"] and sorted(rows(found)) == [("1", 2), ("3\n4", 5)]


def test_csv_open_quote_raises(spark, tmp_path):
    for text in ('a,b\n1,"x\ny\n2,z\n', 'a,b\n"1,x\n2,y\n', 'a\n"x\n"y\n"z'):
        with pytest.raises(ValueError, match="Unbalanced quotes"):
            scan.load(spark, write(tmp_path / "t.csv", text))


def test_csv_lines_with_extra_cells_raise(spark, tmp_path):
    for line in ("3,4,99", "3,4,", '3,"4,5",6'):
        path = write(tmp_path / "t.csv", f"x,y\n1,2\n{line}\n")
        with pytest.raises(ValueError, match=f"Expected 2 cells: {line}"):
            scan.load(spark, path)
    path = write(tmp_path / "t.csv", 'x,y\n1,2\n3\n5,"a,b ""c"" "\n')
    assert sorted(rows(scan.load(spark, path)), key=str) == [(1, "2"), (3, None), (5, 'a,b "c" ')]


def test_csv_files_are_matched_by_name(spark, tmp_path):
    folder = tmp_path / "many.csv"
    folder.mkdir()
    write(folder / "1.csv", "x,y\n1,a\n")
    write(folder / "2.csv", "y,x\nb,2\n")
    write(folder / "3.csv", "x,y\n3,c\n")
    df = scan.load(spark, str(folder))
    assert df.columns == ["x", "y"] and sorted(rows(df)) == [(1, "a"), (2, "b"), (3, "c")]
    write(folder / "4.csv", "x,z\n4,d\n")
    with pytest.raises(ValueError, match="Files differ in their columns"):
        scan.load(spark, str(folder))


def test_number_shapes(spark):
    texts = ["1", " 2 ", "+3", "-4", "5.", ".5", "1e3", "Infinity", "inf"]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    assert scan.inferred_types(df) == {"x": "double"}
    assert [r[0] for r in rows(scan.infer_types(df))][:4] == [1.0, 2.0, 3.0, -4.0]
    for odd in ("1d", "2f", "yes", "t", "0x1", "1_000"):
        assert scan.inferred_types(spark.createDataFrame([("1",), (odd,)], "x string")) == {"x": "string"}
    assert scan.inferred_types(spark.createDataFrame([(None,)], "x string")) == {"x": "double"}


def test_header_names():
    assert scan.header_names(["a", "a", None, "a.1", "a"]) == ["a", "a.2", "Unnamed: 2", "a.1", "a.3"]


def test_dispatch_errors(spark, tmp_path):
    with pytest.raises(ValueError, match="Unsupported file format"):
        scan.load(spark, str(tmp_path / "t.txt"))
    with pytest.raises(FileNotFoundError, match="File not found"):
        scan.load(spark, str(tmp_path / "absent.csv"))
    with pytest.raises(FileNotFoundError, match="File not found"):
        scan.load(spark, str(tmp_path / "absent.parquet"))


def test_nan_becomes_null(spark):
    df = scan.normalise_na(spark.createDataFrame([(float("nan"), "<NA>"), (1.0, " NA")], "x double, s string"))
    assert rows(df) == [(None, None), (1.0, " NA")]


SHEET = """<?xml version="1.0"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>
<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>n</t></is></c><c r="C1" t="s"><v>1</v></c><c r="D1" t="s"><v>2</v></c></row>
{rows}</sheetData></worksheet>"""
NAMESPACE = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def workbook(rows_xml):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as book:
        book.writestr(
            "xl/workbook.xml",
            f'<workbook {NAMESPACE} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships">'
            '<sheets><sheet name="first" sheetId="1" r:id="rId7"/></sheets></workbook>',
        )
        book.writestr(
            "xl/_rels/workbook.xml.rels",
            '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
            '<Relationship Id="rId7" Target="worksheets/sheet1.xml"/></Relationships>',
        )
        book.writestr(
            "xl/sharedStrings.xml",
            f"<sst {NAMESPACE}><si><t>name</t></si><si><t>when</t></si><si><t>ok</t></si><si><r><t>Ad</t></r><r><t>a</t></r></si></sst>",
        )
        book.writestr(
            "xl/styles.xml",
            f'<styleSheet {NAMESPACE}><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
        )
        book.writestr("xl/worksheets/sheet1.xml", SHEET.format(rows=rows_xml))
    return out.getvalue()


def test_folder_of_workbooks(spark, tmp_path):
    folder = tmp_path / "books.xlsx"
    folder.mkdir()
    (folder / "one.xlsx").write_bytes(
        workbook('<row r="2"><c r="A2" t="s"><v>3</v></c><c r="B2"><v>3</v></c><c r="C2" s="1"><v>43832</v></c><c r="D2" t="b"><v>1</v></c></row>')
    )
    (folder / "two.xlsx").write_bytes(
        workbook('<row r="2"><c r="A2" t="s"><v>0</v></c><c r="B2"><v>2.5</v></c><c r="C2" s="1"><v>43832.5</v></c><c r="D2" t="b"><v>0</v></c></row>')
    )
    df = scan.load(spark, str(folder))
    assert df.dtypes == [("name", "string"), ("n", "double"), ("when", "string"), ("ok", "boolean")]
    assert sorted(rows(df)) == [("Ada", 3.0, "2020-01-02 00:00:00", True), ("name", 2.5, "2020-01-02 12:00:00", False)]


def test_roles(spark):
    df = spark.createDataFrame([(1, 1.0, True, "x")], "i int, d double, b boolean, s string")
    assert roles.roles(df) == {"i": "num", "d": "num", "b": "cat", "s": "cat"}
    assert roles.roles(df, {"i": "cat", "zz": "num"})["i"] == "cat"
    assert "zz" not in roles.roles(df, {"zz": "num"})
    assert roles.columns_with_role(df, "num") == ["i", "d"]
    assert [r[2] for r in rows(roles.listing(df))] == ["num", "num", "num", "cat"]
    offered = rows(roles.chart_candidates(df.select("i", "d")))
    assert ("stacked_bar", "col1", "i") in offered and ("scatter_2d", "x", "d") in offered


def test_absent_column_is_named(spark):
    with pytest.raises(ValueError, match="Column 'y' not found in dataset."):
        require_columns(spark.createDataFrame([(1,)], "x int"), ["x", "y"])


def test_preview(spark):
    df = spark.range(20).selectExpr("19 - id as id")
    assert [r[0] for r in rows(scan.preview(df, order=["id"]))] == [0, 1, 2, 3, 4]
