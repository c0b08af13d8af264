import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from fieldtally.errors import DatasetNotFound, ReportError
from fieldtally.functions.dates import month_bucket, parse_dates
from fieldtally.operators.period import Period, parse_period, scope, source_info
from fieldtally.operators.rowids import ROW_ID
from fieldtally.sources.documents import scan_documents
from fieldtally.sources.logs import log_damage, log_scan, log_summary
from fieldtally.sources.pages import require_rows, rows_to_table, scan_json_pages
from fieldtally.sources.sinks import safe_name, sink_clean, sink_pull, sink_report
from fieldtally.sources.tables import Catalog, read_table, scan_csv, scan_parquet

SUMMER = Period("when", date(2026, 6, 1), date(2026, 8, 31))


def test_csv_types_and_missing_tokens(spark, tmp_path):
    (tmp_path / "t.csv").write_text(
        'id,n,x,flag,text,day,empty\n'
        '1,5,1.5,True,"a, ""b""",2026-06-01,\n'
        '2,NA,null,False,  ,N/A,nan\n'
        '3,7,-2e3,TRUE,"two\nlines",-,#N/A\n',
        encoding="utf-8",
    )
    df = scan_csv(spark, str(tmp_path / "t.csv"), multiline=True)
    assert dict(df.dtypes) == {
        "id": "bigint", "n": "bigint", "x": "double", "flag": "boolean", "text": "string", "day": "string",
        "empty": "double",
    }
    rows = df.orderBy("id").collect()
    assert [r.n for r in rows] == [5, None, 7] and [r.x for r in rows] == [1.5, None, -2000.0]
    assert [r.text for r in rows] == ['a, "b"', "  ", "two\nlines"]
    assert [r.day for r in rows] == ["2026-06-01", None, "-"] and rows[0].empty is None
    typed = scan_csv(spark, str(tmp_path / "t.csv"), "id string, n double", multiline=True)
    assert dict(typed.dtypes)["id"] == "string" and dict(typed.dtypes)["n"] == "double"
    with pytest.raises(ReportError, match="t.csv: a cell holds a line break"):
        scan_csv(spark, str(tmp_path / "t.csv"))


@pytest.mark.parametrize(("line", "cells"), [
    ('5" pipe,2', ('5" pipe', "2")), ('a "quoted" word,x', ('a "quoted" word', "x")), ('"5"" pipe, long",2', ('5" pipe, long', "2")),
    (',"x"', (None, "x")), ('6\'2",5\'1"', ('6\'2"', '5\'1"')),
])
def test_quotes_inside_cells(spark, tmp_path, line, cells):
    (tmp_path / "q.csv").write_text(f"a,b\n{line}\nz,z\n", encoding="utf-8")
    rows = scan_csv(spark, str(tmp_path / "q.csv"), "a string, b string").collect()
    assert sorted(map(tuple, rows), key=repr) == sorted([cells, ("z", "z")], key=repr)


@pytest.mark.parametrize("text", ['a,b\n"x\ny",1\n', 'a,b\n1,"x\ny"\n', 'a,b\n5" p,"x, y\nz"\n', 'a,b\n"q","x ""\nz"\n', 'a,b\n,"\n"\n'])
def test_cells_over_lines_are_refused(spark, tmp_path, text):
    (tmp_path / "b.csv").write_text(text, encoding="utf-8")
    with pytest.raises(ReportError, match="b.csv: a cell holds a line break"):
        scan_csv(spark, str(tmp_path / "b.csv"), "a string, b string")


def test_long_whole_numbers_are_not_rounded(spark, tmp_path):
    (tmp_path / "n.csv").write_text("a,b,c\n1234567890123456781,99999999999999999999,9223372036854775807\n"
                                    "1234567890123456782,1,-9223372036854775808\n", encoding="utf-8")
    df = scan_csv(spark, str(tmp_path / "n.csv"))
    assert dict(df.dtypes) == {"a": "bigint", "b": "string", "c": "bigint"}
    assert df.select("a").distinct().count() == 2 and {r.b for r in df.collect()} == {"99999999999999999999", "1"}


def test_rows_wider_than_the_header_are_refused(spark, tmp_path):
    (tmp_path / "wide.csv").write_text("a,b\n1,2\n3,4,+380671234567,6\n", encoding="utf-8")
    for schema in (None, "a int, b int"):
        with pytest.raises(ReportError, match="wide.csv: a row has more cells") as refusal:
            scan_csv(spark, str(tmp_path / "wide.csv"), schema)
        assert "+380" not in str(refusal.value)
    (tmp_path / "short.csv").write_text("a,b\n1,2\n3\n", encoding="utf-8")
    assert sorted(map(tuple, scan_csv(spark, str(tmp_path / "short.csv")).collect())) == [(1, 2), (3, None)]


def test_nan_is_missing(spark, tmp_path):
    spark.createDataFrame([(1.0,), (float("nan"),)], "x double").write.parquet(str(tmp_path / "p"))
    assert scan_parquet(spark, str(tmp_path / "p")).agg(F.count("x")).first()[0] == 1


def test_read_errors_quote_no_cells(spark, tmp_path):
    (tmp_path / "bad.parquet").write_text("+380 67 123 45 67")
    with pytest.raises(ReportError, match="Could not read bad.parquet") as info:
        read_table(spark, str(tmp_path / "bad.parquet"))
    assert "+380" not in str(info.value)
    with pytest.raises(ReportError, match="expected a .csv or .parquet"):
        read_table(spark, str(tmp_path / "x.sav"))


def write_pages(path, pages):
    path.mkdir()
    for n, page in enumerate(pages):
        (path / f"page-{n}.json").write_text(json.dumps(page, indent=1), encoding="utf-8")
    return str(path)


def test_wrapped_pages(spark, tmp_path):
    """Wells by page: keys that differ, one with two types, an odd name, a nested cell and a whole number beyond 64 bits."""
    path = write_pages(tmp_path / "k", [
        {"results": [{"well": "w1", "depth/m": 12, "it's": True}, {"well": "w2", "at": [3.5, -7.25], "note": None}], "more": 1},
        {"count": 2, "results": [{"well": "w3", "depth/m": 0.5, "tag": "x"}, {"well": "w4", "tag": 7, "serial": 10**20}]},
        {"detail": "nothing here"},
    ])
    got = scan_json_pages(spark, path)
    assert dict(got.dtypes) == {"well": "string", "depth/m": "double", "it's": "boolean", "at": "string", "note": "string",
                                "tag": "string", "serial": "decimal(21,0)"}
    rows = {r["well"]: r.asDict() for r in got.collect()}
    assert sorted(rows) == ["w1", "w2", "w3", "w4"] and rows["w1"]["depth/m"] == 12.0 and rows["w1"]["it's"] is True
    assert rows["w2"]["at"] == "[3.5,-7.25]" and [rows[w]["tag"] for w in sorted(rows)] == [None, None, "x", "7"]
    assert int(rows["w4"]["serial"]) == 10**20
    typed = scan_json_pages(spark, path, schema="well string, tag int, at array<double>")
    assert {r.well: (r.tag, r.at) for r in typed.collect()} == {
        "w1": (None, None), "w2": (None, "[3.5,-7.25]"), "w3": (None, None), "w4": (7, None)}


def scans(frame) -> int:
    return frame._jdf.queryExecution().executedPlan().toString().count("FileScan")


def test_pages_are_read_once(spark, tmp_path):
    path = write_pages(tmp_path / "once", [{"results": [{"a": n}]} for n in range(5)])
    frame = scan_json_pages(spark, path)
    for page in (tmp_path / "once").iterdir():
        page.unlink()
    assert sorted(r.a for r in frame.collect()) == list(range(5)) and scans(frame) == 1


@pytest.mark.parametrize("page", ['{"results": [{"a": 1}, 5]}', '{"results": {"a": 1}}', '{"results": [null]}', "[1"])
def test_pages_with_rows_that_are_no_objects(spark, tmp_path, page):
    write_pages(tmp_path / "odd", [{"results": [{"a": 1}]}])
    (tmp_path / "odd" / "z.json").write_text(page, encoding="utf-8")
    with pytest.raises(ReportError, match="z.json"):
        scan_json_pages(spark, str(tmp_path / "odd"))


def test_bare_pages(spark, tmp_path):
    path = write_pages(tmp_path / "o", [[{"_id": 1, "a": "x"}, {"_id": 2}], [{"_id": 3, "c": True}], []])
    assert sorted(r["_id"] for r in scan_json_pages(spark, path, wrapped=False).collect()) == [1, 2, 3]


def test_no_submissions_write_nothing(spark, tmp_path):
    path = write_pages(tmp_path / "e", [{"count": 0, "next": None, "results": []}])
    with pytest.raises(ReportError, match="0 submissions"):
        scan_json_pages(spark, path)
    with pytest.raises(ReportError, match="0 submissions"):
        sink_pull(spark.createDataFrame([], "a int"), str(tmp_path / "out"), "Form")
    assert not (tmp_path / "out").exists()
    with pytest.raises(ReportError, match="0 submissions"):
        require_rows(spark.range(0), "f")
    with pytest.raises(ReportError, match="0 submissions"):
        scan_json_pages(spark, path, schema="a int")


PAGE = '{"results": [{"id": 1, "t": "+380671234567"}, {"id": 2, "t": "x"}]}'


@pytest.mark.parametrize("wrapped", [True, False])
@pytest.mark.parametrize("schema", [None, "id bigint, t string"])
def test_damaged_pages_are_named(spark, tmp_path, wrapped, schema):
    whole = PAGE if wrapped else PAGE[12:-1]
    (tmp_path / "a.json").write_text(whole, encoding="utf-8")
    assert scan_json_pages(spark, str(tmp_path), wrapped, schema).count() == 2
    (tmp_path / "b.json").write_text(whole[:45], encoding="utf-8")
    with pytest.raises(ReportError, match="b.json") as refusal:
        scan_json_pages(spark, str(tmp_path), wrapped, schema)
    assert "a.json" not in str(refusal.value) and "+380" not in str(refusal.value)


def test_damaged_objects_are_counted(spark):
    rows = spark.createDataFrame([('{"a": 1}',), ('{"a": 2',), ("+380671234567",)], "j string")
    for schema in (None, "a int"):
        with pytest.raises(ReportError, match="2 of the rows of 'j'") as refusal:
            rows_to_table(rows, "j", schema)
        assert "+380" not in str(refusal.value)


ODD_LOG = """{"kind": "result", "cost_usd": "n/a"}
{"kind": "result", "cost_usd": 0.25, "tool": {"name": "map"}}
{"kind": "result", "cost_usd": 3}

   	
{"kind": "tool_use", "tool": "map", "n": 1}
{"kind": "tool
[{"kind": "tool_use"}]
17
  {"kind": "pii_block", "ts": 5, "n": 99999999999999999999999}  """


@pytest.mark.parametrize("schema", [None, "ts string, kind string, cost_usd double", "kind string, n int, cost_usd double"])
def test_odd_lines_and_fields(spark, tmp_path, schema):
    """A field of another type is missing, a line without an object is damage, whatever is read."""
    (tmp_path / "s.jsonl").write_text(ODD_LOG, encoding="utf-8")
    (tmp_path / "t.jsonl").write_text('{"kind": "user"}\n', encoding="utf-8")
    log = log_scan(spark, str(tmp_path), schema)
    assert log.count() == len(log.collect()) == len(log.select("kind").collect()) == log.filter("kind IS NOT NULL").count() == 6
    assert tuple(log_summary(log).first()) == (6, 1, 0, 1, 3.25)
    assert sorted(map(tuple, log_damage(spark, str(tmp_path)).collect())) == [("s.jsonl", 8, 3), ("t.jsonl", 1, 0)]
    if schema and "n int" in schema:
        assert sorted(r.n or 0 for r in log.collect()) == [0, 0, 0, 0, 0, 1]
    if schema and "ts" in schema:
        assert {r.ts for r in log.collect()} == {None, "5"}


def test_rows_to_table(spark):
    rows = spark.createDataFrame([('{"a": 1, "b": "x"}',), ('{"a": 2, "c": [1]}',), (None,)], "j string")
    got = rows_to_table(rows, "j")
    assert dict(got.dtypes) == {"a": "bigint", "b": "string", "c": "string"}
    assert sorted(r.a for r in got.collect()) == [1, 2]
    assert rows_to_table(rows, "j", "a int, z string").columns == ["a", "z"]


def test_pull_replaces_and_gives_ids(spark, tmp_path):
    names = {" Wells — north/2026 ": "wells_north_2026", "a-b.c": "a-b_c", "ЇЖА №1": "їжа_1", "__x__": "x"}
    assert {name: safe_name(name) for name in names} == names
    root = str(tmp_path)
    assert sink_pull(spark.range(5).selectExpr("id % 2 AS v"), root, "My Form") == 5
    assert sink_pull(spark.createDataFrame([(1,), (2,)], "v int"), root, "My Form") == 2
    back = spark.read.parquet(f"{root}/my_form")
    assert back.count() == 2 and ROW_ID in back.columns
    sink_pull(spark.createDataFrame([("a",), ("b",)], "`_uuid` string"), root, "With Id")
    assert spark.read.parquet(f"{root}/with_id").columns == ["_uuid"]


def test_clean_copy_is_beside_the_raw_one(spark, tmp_path):
    root = str(tmp_path)
    spark.range(3).write.parquet(f"{root}/hh")
    path = sink_clean(spark.read.parquet(f"{root}/hh").filter("id > 0"), root, "hh")
    assert path.endswith("/hh_clean") and spark.read.parquet(path).count() == 2
    assert spark.read.parquet(f"{root}/hh").count() == 3
    with pytest.raises(ReportError, match="already"):
        sink_clean(spark.range(1), root, "hh_clean")
    with pytest.raises(ReportError, match="itself"):
        sink_clean(spark.read.parquet(path), root, "hh")


def test_report_rerun_replaces_the_day(spark, tmp_path):
    root = str(tmp_path)
    for day, n in ((14, 3), (15, 2), (14, 1)):
        sink_report({"t": spark.range(n)}, root, "indicators", date(2026, 9, day))
    got = spark.read.parquet(f"{root}/indicators/t").groupBy("report_date").count().collect()
    assert {str(r.report_date): r["count"] for r in got} == {"2026-09-14": 1, "2026-09-15": 2}
    sink_report({"t": spark.range(2)}, root, "csv", date(2026, 9, 14), "csv")
    assert spark.read.csv(f"{root}/csv/t", header=True).count() == 2


def test_resolve(spark):
    one = spark.range(1)
    both = Catalog({"hh": one, "hh_clean": one, "other": one})
    assert both.resolve("hh") == ("hh_clean", True) and both.resolve("other") == ("other", False)
    assert both.resolve("hh_clean") == ("hh_clean", True)
    with pytest.raises(DatasetNotFound, match="Available: hh, hh_clean, other"):
        both.resolve("ghost")
    with pytest.raises(ReportError):
        both.stripped("ghost")
    one.createOrReplaceTempView("a_view")
    assert Catalog.of_views(spark, "a_view").resolve("a_view")[0] == "a_view"


def test_period_arguments():
    assert parse_period("d", None, None) is None and parse_period(None, "", "") is None
    period = parse_period("d", "2026-06-01", "2026-08-31")
    assert period.label() == "2026-06-01 .. 2026-08-31 (by d)"
    for args, words in (
        (("d", "2026-06-01", None), "one end only"), (("d", "", "2026-06-01"), "one end only"),
        ((None, "2026-06-01", "2026-08-31"), "date_field"), (("d", "June 1", "2026-08-31"), "'June 1'"),
        (("d", "2026-09-01", "2026-08-31"), "backwards"),
    ):
        with pytest.raises(ReportError, match=words):
            parse_period(*args)


DAYS = {  # what stands in the column, and whether the day is in June to August: None is no date
    "1 June 2026": True, "2026-06-01T00:00:00Z": True, "2026-05-31T23:59:59Z": False, "31.08.2026": True, "2026-08-31 23:59:59": True,
    "2026-09-01T00:30:00+01:00": True, "2026-08-31T23:30:00-01:00": False, "soon": None, "2026-13-45": None, "  ": None,
}


def test_scope_and_account(spark):
    df = spark.createDataFrame([(n, text) for n, text in enumerate([*DAYS, None])], "visit int, when string")
    inside = [n for n, known in enumerate(DAYS.values()) if known]
    assert sorted(r.visit for r in scope(df, SUMMER).collect()) == inside
    info = source_info(df, SUMMER, "visits").first()
    counted = (info.rows_total, info.rows_in_scope, info.rows_excluded_by_period, info.rows_bad_date)
    assert counted == (len(df.collect()), len(inside), len(DAYS) + 1 - len(inside), 4) and info.warning is None
    assert source_info(df.filter("visit = 2"), SUMMER, "visits").first().warning == "no rows in scope"
    everything = source_info(df, None, "visits").first()
    assert (everything.rows_in_scope, everything.rows_bad_date) == (len(DAYS) + 1, 0)


def test_period_reaches_the_parquet_reader(spark, tmp_path):
    spark.sql("SELECT TIMESTAMP_NTZ'2026-07-01 10:00:00' AS when").write.parquet(str(tmp_path / "p"))
    scoped = scope(spark.read.parquet(str(tmp_path / "p")), SUMMER)
    assert "GreaterThanOrEqual(when" in scoped._jdf.queryExecution().executedPlan().toString()


def test_period_column_refusals(spark):
    catalog = Catalog({"hh": spark.createDataFrame([("a", "x")], "resp_name string, when string")})
    with pytest.raises(ReportError, match="'resp_name', which holds personal data; it has when"):
        catalog.load("hh", Period("resp_name", SUMMER.start, SUMMER.end))
    with pytest.raises(ReportError, match="'day', which does not exist"):
        catalog.load("hh", Period("day", SUMMER.start, SUMMER.end))


@pytest.mark.parametrize(
    ("text", "moment"),
    [
        ("2026-06", "2026-06-01 00:00"), ("2026", "2026-01-01 00:00"), ("20260615", "2026-06-15 00:00"),
        ("06/15/2026", "2026-06-15 00:00"), ("15/06/2026", "2026-06-15 00:00"), ("15.06.2026", "2026-06-15 00:00"),
        ("05.06.2026", "2026-05-06 00:00"), ("15 Jun 2026", "2026-06-15 00:00"),
        ("June 15, 2026", "2026-06-15 00:00"), ("2026/06/15 07:08", "2026-06-15 07:08"),
        ("2026-06-15T10:00:00+03:00", "2026-06-15 07:00"), ("2026-06-15T23:30:00Z", "2026-06-15 23:30"),
        ("2026-06-15 18:30:05.123", "2026-06-15 18:30"), (" 2026-06-15\t", "2026-06-15 00:00"),
        ("6/5/2026 9:05", "2026-06-05 09:05"), ("May 2026", "2026-05-01 00:00"), ("Sept 2026", "2026-09-01 00:00"),
        ("1 May 26", "2026-05-01 00:00"), ("May 1, 26", "2026-05-01 00:00"), ("06/15/26", "2026-06-15 00:00"),
        ("15.06.26", "2026-06-15 00:00"), ("06-2026", "2026-06-01 00:00"), ("6/2026", "2026-06-01 00:00"),
        ("06/15/75", "2075-06-15 00:00"), ("06/15/76", "1976-06-15 00:00"), ("13/2026", None), ("06/15/26 7:45", "2026-06-15 07:45"),
        ("12:30", None), ("not a date", None), ("2026-02-30", None), ("02/30/2026", None), ("31/31/2026", None),
        ("", None), ("15 Foo 2026", None), ("12026-01-01", None),
    ],
)
def test_mixed_dates(spark, text, moment):
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(F.date_format(parse_dates(F.col("t"), "text"), "yyyy-MM-dd HH:mm")).first()[0]
    assert got == moment


def test_numbers_are_no_dates_and_months(spark):
    row = spark.createDataFrame([(20260615, "bad")], "n bigint, t string").select(
        parse_dates(F.col("n"), "whole"), month_bucket(parse_dates(F.col("t"), "text"))
    ).first()
    assert tuple(row) == (None, "(missing)")


def test_documents(spark, tmp_path):
    """Texts by file name, cut at 30,000 characters; other kinds of files are left out."""
    whole = {"wells.md": "Wells\n=====\n\nw1 dug, 12 m", "ended.txt": "a\r\nb\n\n", "breaks.txt": "\n" * 40_000, "exact.txt": "ґ" * 30_000,
             "long.txt": "їжак" * 7_500 + "!", "lines.txt": "".join(f"рядок {n}\n" for n in range(9_000)), "empty.txt": "", "one.md": "\n"}
    for name, text in whole.items():
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "map.bin").write_bytes(b"\x00\x01")
    del whole["empty.txt"]
    got = {r.name: r.text for r in scan_documents(spark, str(tmp_path)).collect()}
    assert got == {name: text if len(text) <= 30_000 else text[:30_000] + "\n[... document truncated ...]" for name, text in whole.items()}


@pytest.mark.parametrize("block", [64, 1 << 20])
def test_documents_of_many_blocks(spark, tmp_path, block):
    text = "".join(f"{n} {'x' * (n % 17)}\n" for n in range(400))
    (tmp_path / "t.txt").write_text(text, encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    try:
        for cap in (10, 1000, 10_000):
            got = scan_documents(spark, str(tmp_path), cap).first().text
            assert got == (text if len(text) <= cap else text[:cap] + "\n[... document truncated ...]")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_csv_documents(spark, tmp_path):
    """Tabs between cells, quotes taken off, breaks inside cells kept, 200 rows with the header and a marker."""
    import csv

    rows = {"few.csv": [["well", "note"], ["w1", 'a "deep", one'], ["", "two\nlines\n\nend"], ["w3", ""], [], ["x", '"', ","]],
            "many.csv": [["n", "text"], *([str(n), f"reading, {n}"] for n in range(250))], "just.csv": [[str(n)] for n in range(200)],
            "wide.csv": [["y" * 900, '"' * 300] for _ in range(60)]}
    for name, table in rows.items():
        with (tmp_path / name).open("w", newline="", encoding="utf-8") as out:
            csv.writer(out, lineterminator="\r\n" if name == "few.csv" else "\n").writerows(table)
    expected = {}
    for name, table in rows.items():
        text = "".join("\t".join(r) + "\n" for r in table[:200]) + ("[... more rows omitted ...]\n" if len(table) > 200 else "")
        expected[name] = text if len(text) <= 30_000 else text[:30_000] + "\n[... document truncated ...]"
    assert {r.name: r.text for r in scan_documents(spark, str(tmp_path)).collect()} == expected


def test_log_summary(spark, tmp_path):
    """Costs of results only; kinds beside the counted ones are events, too; one row per session with ``by``."""
    lines = [("tool_use", None, "p"), ("tool_use", 4, "q"), ("code_executed", None, "p"), ("note", 1.5, "q"),
             ("result", 0.004, "p"), ("result", 1, "p"), ("result", None, "q"), ("pii_block", 2, "q"), ("turn", None, "q")]
    text = "\n".join(json.dumps({"kind": k, "session": s} | ({"cost_usd": c} if c is not None else {})) for k, c, s in lines)
    (tmp_path / "s.jsonl").write_text(text, encoding="utf-8")
    log = log_scan(spark, str(tmp_path))
    assert tuple(log_summary(log).first()) == (9, 2, 1, 1, 1.004)
    assert sorted(map(tuple, log_summary(log, ["session"]).collect())) == [("p", 4, 1, 1, 0, 1.004), ("q", 5, 1, 0, 1, 0.0)]
    (tmp_path / "s.jsonl").write_text('{"session": "p"}', encoding="utf-8")
    assert tuple(log_summary(log_scan(spark, str(tmp_path))).first()) == (1, 0, 0, 0, 0.0)
