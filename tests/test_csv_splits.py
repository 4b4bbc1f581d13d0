"""CSV files of many splits: the same rows and row ids as in one split."""

import csv
import io
import random

import pytest

from voxpop.sources import csv as CSV


def _table(seed: int, n: int) -> list[list[str]]:
    rnd = random.Random(seed)
    pieces = ["a", '"', ",", "\n", "\r\n", "南京", "地铁很好", '""', ',"', '",', " ", "车" * 30, "\n\n", "x" * 200]
    return [[str(i)] + ["".join(rnd.choice(pieces) for _ in range(rnd.randrange(0, 9))) for _ in range(2)] for i in range(n)]


def _bytes(rows: list[list[str]], encoding: str, end: str) -> bytes:
    out = io.StringIO(newline="")
    w = csv.writer(out, lineterminator=end)
    w.writerow(["id", "微博正文", "other"])
    w.writerows(rows)
    return out.getvalue().encode(encoding)


def _read(spark, path, split_bytes=None):
    df = CSV.read_csv_tolerant(spark, str(path), required="微博正文", split_bytes=split_bytes)
    return [(r.row_id, r.id, r["微博正文"], r.other) for r in df.orderBy("row_id").collect()]


@pytest.mark.parametrize("encoding,end", [("gb18030", "\n"), ("utf-8-sig", "\r\n")])
def test_rows_do_not_depend_on_splits(spark, tmp_path, encoding, end):
    rows = _table(7, 60)
    path = tmp_path / "t.csv"
    path.write_bytes(_bytes(rows, encoding, end))
    want = [(i, str(i), a or None, b or None) for i, (_, a, b) in enumerate(rows)]
    assert _read(spark, path) == want
    assert _read(spark, path, 150) == want


def test_a_cell_longer_than_its_splits(spark, tmp_path):
    text = "\n".join(["begin", 'a "quoted" line,', *["line of it"] * 200, "end"])
    path = tmp_path / "t.csv"
    path.write_bytes(_bytes([["0", "x", "y"], ["1", text, "z"], ["2", "u", "v"]], "utf-8", "\n"))
    assert _read(spark, path, 300) == [(0, "0", "x", "y"), (1, "1", text, "z"), (2, "2", "u", "v")]


def test_header_with_a_line_break_and_quotes_inside_cells(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_bytes('id,微博正文,"two\nlines"\n0,5" pipe,b"\n\n\r\n1,"c\nd",e\n'.encode("utf-8"))
    for split in (None, 32):
        df = CSV.read_csv_tolerant(spark, str(path), required="微博正文", split_bytes=split)
        got = [(r.row_id, r.id, r["微博正文"], r["two\nlines"]) for r in df.orderBy("row_id").collect()]
        assert got == [(0, "0", '5" pipe', 'b"'), (1, "1", "c\nd", "e")]
    with pytest.raises(ValueError):
        _read(spark, path, 8)


def test_files_of_several_encodings_keep_their_rank(spark, tmp_path):
    a, b = _table(1, 40), _table(2, 40)
    (tmp_path / "a.csv").write_bytes(_bytes(a, "utf-8", "\n"))
    (tmp_path / "b.csv").write_bytes(_bytes(b, "gb18030", "\n"))
    got = _read(spark, tmp_path, 900)
    assert got == [(f * CSV.FILE_ID_SHIFT + i, str(i), x or None, y or None) for f, t in enumerate((a, b)) for i, (_, x, y) in enumerate(t)]


def test_settings_are_put_back(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(_bytes(_table(3, 5), "utf-8", "\n"))
    keys = ("spark.sql.files.minPartitionNum", "spark.sql.files.maxPartitionBytes")
    before = [spark.conf.get(k, None) for k in keys]
    _read(spark, tmp_path / "a.csv", 100)
    assert [spark.conf.get(k, None) for k in keys] == before


def test_state_of_a_line_equals_the_csv_module():
    rnd = random.Random(5)
    for _ in range(3000):
        cells = ["".join(rnd.choice('a",\n') for _ in range(rnd.randrange(5))) for _ in range(3)]
        out = io.StringIO(newline="")
        csv.writer(out, lineterminator="\n").writerow(cells)
        inside = False
        lines = out.getvalue().encode()[:-1].split(b"\n")
        for i, line in enumerate(lines):
            inside = CSV.ends_inside(line, inside)
            assert inside == (i < len(lines) - 1)
