"""CSV records with quoted line breaks: any split size gives the one-file parse."""

import csv
import io

import pytest

from farebox import schemas as sch
from farebox.operators import medallion as M
from farebox.sources import csv as CSV


def written(rows, end):
    out = io.StringIO()
    w = csv.writer(out, lineterminator=end)
    w.writerow([f"h{i}\n{i}" for i in range(17)])
    w.writerows(rows)
    return out.getvalue()


def ride_rows(n):
    notes = ["plain", "", "two\nlines", 'a "quoted" word\r\nand more', "\n\n\n", "cr\ronly", ",;\n,", '"', 'x\n"\n"y', "long\n" * 40]
    return [[f"2024-01-{i % 28 + 1:02d}", "10:00:00", f"K{i:05d}"] + [notes[(i + j) % len(notes)] if j in (4, 6) else "v" for j in range(14)]
            for i in range(n)]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("split", [64, 333, 1 << 20])
def test_line_breaks_at_any_split_size(spark, tmp_path, end, split):
    rows = ride_rows(120)
    for i, name in enumerate(("b one.csv", "a.csv", "c[1].CSV")):
        (tmp_path / name).write_bytes((written(rows[40 * i:40 * i + 40], end) + end * i).encode())
    (tmp_path / "empty.csv").write_bytes(b"")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        raw = CSV.csv_scan(spark, str(tmp_path), with_file=True)
        got = [tuple(r) for r in raw.select(*sch.CSV_COLUMNS).collect()]
        order = [r["booking_id"] for r in M.to_bronze(raw, "b").orderBy("_id").collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sorted(got) == sorted(map(tuple, rows))
    by_file = rows[40:80] + rows[:40] + rows[80:]                     # file path order
    assert order == [r[2] for r in by_file]


def test_lone_carriage_returns_end_lines(spark, tmp_path):
    text = "h\r" + ",".join(["a"] * 17) + "\r\r" + ",".join(["b"] * 16 + ['"x\ry"']) + "\r"
    (tmp_path / "mac.csv").write_bytes(text.encode())
    got = sorted(tuple(r) for r in CSV.csv_scan(spark, str(tmp_path), line_breaks=True).collect())
    assert got == [("a",) * 17, ("b",) * 16 + ("x\ry",)]


def test_bad_records_fail_the_scan(spark, tmp_path):
    (tmp_path / "open.csv").write_text("h\n" + ",".join(["a"] * 16) + ',"no end\n' + ",".join(["b"] * 17) + "\n")
    with pytest.raises(ValueError, match="open.csv"):
        CSV.csv_scan(spark, str(tmp_path / "open.csv")).collect()
    (tmp_path / "short.csv").write_text('h\na,"b\nc"\n' + ",".join(["b"] * 17) + "\n")
    with pytest.raises(Exception, match="too few fields"):
        CSV.csv_scan(spark, str(tmp_path / "short.csv")).collect()


def test_whole_lines_keep_the_plain_reader(spark, tmp_path):
    (tmp_path / "x.csv").write_text("h\n" + "\n".join(",".join(['"a ""b"""'] + ["v"] * 16) for _ in range(5)) + "\n")
    plan = CSV.csv_scan(spark, str(tmp_path))
    assert [r[0] for r in plan.collect()] == ['a "b"'] * 5
    assert "Window" not in plan._jdf.queryExecution().toString()


def test_literal_path(spark, tmp_path):
    odd = tmp_path / "a b[1]{x}.csv"
    odd.write_text("h\n" + ",".join(["a"] * 17) + "\n")
    path = CSV.csv_scan(spark, str(tmp_path), with_file=True).first()["_file"]
    assert CSV.csv_scan(spark, CSV.literal_path(path)).count() == 1
