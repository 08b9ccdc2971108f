from __future__ import annotations

import random

import pyarrow as pa

from tessella.operators import reject_rows as R

FILES = "file_id long, file_name string, headers array<string>, header_line string, delimiter_char string, column_types array<string>, extra int"
ROWS = "row_id long, file_id long, line_no int, row_text string, reason string"


def judged(spark, rows, headers, types, delimiter=",", header_line=None):
    f = spark.createDataFrame([(1, "f", headers, header_line if header_line is not None else ",".join(headers or []), delimiter, types, 0)], FILES)
    r = spark.createDataFrame([(i, 1, i, t, "clash") for i, t in enumerate(rows)], ROWS)
    return {x["row_id"]: x for x in R.parse_records(r, f).collect()}, R.parse_records(r, f), f


def test_splitting_equals_cell_by_cell_rule():
    rng = random.Random(3)
    texts, marks = [], []
    for _ in range(4000):
        d = rng.choice(",;|\t")
        texts.append("".join(rng.choice(["a", '"', '"', d, d, " ", "é", "\n", '""', '"' + d, d + '"']) for _ in range(rng.randint(0, 14))) + rng.choice(["", "\r"]))
        marks.append(d)
    ok, cells = R.split_batch(pa.array(texts), pa.array(marks))
    for t, d, good, got in zip(texts, marks, ok, cells.to_pylist()):
        want, fine = R.scan_record(t[:-1] if t.endswith("\r") else t, d)
        assert good == fine and (not fine or got == want), (t, d)


def test_reasons_and_order(spark):
    rows = ["1,a,2.5", '1,"a,2.5', '1,"a"x,2', "1,a", "x,a,1", "1,a,1d", ' 7 , "q" ,', "1,say \"hi\",3\r", '1,"a\nb ""c""",3', None, "", "1,a,2,3", "1,a,1e5"]
    got, _, _ = judged(spark, rows, ["n", "t", "x"], ["long", "string", "double"])
    assert [got[i]["reason"] for i in range(len(rows))] == [None, "quoting", "quoting", "column_count", "invalid_value", "invalid_value", None, None, None, "column_count", "column_count", "column_count", None]
    assert got[8]["cells"] == ["1", 'a\nb "c"', "3"] and got[7]["cells"] == ["1", 'say "hi"', "3"]


def test_dates_and_blank_cells(spark):
    days = ["2024-02-29", "2023-02-29", "1900-02-29", "2000-02-29", "2024-13-01", "2024-00-10", "2024-1-1", " 2024-01-31 ", "", "   ", "0000-01-01"]
    got, _, _ = judged(spark, days, ["d"], ["date"])
    assert [got[i]["reason"] is None for i in range(len(days))] == [True, False, False, True, False, False, False, True, True, True, False]


def test_delimiter_from_header_missing_files_and_types(spark):
    got, parsed, f = judged(spark, ["1|2;3", "1|2"], ["a;x", ""], None, None, "a;x|")
    assert got[0]["cells"] == ["1", "2;3"] and got[0]["reason"] is None
    typed = R.typed_cells(parsed, f).where("row_id = 1").orderBy("ordinal").collect()
    assert [t["header"] for t in typed] == ["a;x", "column_2"] and [t["string_value"] for t in typed] == ["1", "2"]
    lost = spark.createDataFrame([(5, 99, 1, "a,b", None)], ROWS)
    assert R.parse_records(lost, f).collect()[0]["reason"] == "column_count"


def test_typed_values_long_text_and_empty_table(spark):
    big = "x" * 300_000
    got, parsed, f = judged(spark, [f'99999999999999999999,"{big}",2020-01-02,.5'], ["n", "t", "d", "x"], ["long", "string", "date", "double"])
    cells = {t["header"]: t for t in R.typed_cells(parsed, f).collect()}
    assert got[0]["reason"] is None and cells["n"]["long_value"] is None and len(cells["t"]["string_value"]) == 300_000
    assert str(cells["d"]["date_value"]) == "2020-01-02" and cells["x"]["double_value"] == 0.5
    assert R.parse_records(spark.createDataFrame([], ROWS), f).count() == 0
