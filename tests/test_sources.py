import codecs
import tempfile


from voxpop.sources import csv as CSV
from voxpop.sources import sectioned as SEC

CONTENT = '微博正文,其他\n"a,\n""b"" \\",1\nNA,2\nnull,3\n南京地铁很好,4\n'


def _write(path, data: bytes):
    with open(path, "wb") as f:
        f.write(data)


def test_encodings_read_the_same_table(spark):
    d = tempfile.mkdtemp(prefix="vx-csv-", dir="/tmp")
    _write(f"{d}/gb.csv", CONTENT.encode("gb18030"))
    _write(f"{d}/u8.csv", CONTENT.encode("utf-8"))
    _write(f"{d}/bom.csv", codecs.BOM_UTF8 + CONTENT.encode("utf-8"))
    tables = []
    for name in ("gb", "u8", "bom"):
        df = CSV.read_csv_tolerant(spark, f"{d}/{name}.csv", required="微博正文")
        tables.append([(r["微博正文"], r["其他"]) for r in df.orderBy("row_id").collect()])
    assert tables[0] == tables[1] == tables[2]
    assert tables[0] == [('a,\n"b" \\', "1"), (None, "2"), (None, "3"), ("南京地铁很好", "4")]


def test_row_ids_stable_and_ordered(spark):
    d = tempfile.mkdtemp(prefix="vx-csv-", dir="/tmp")
    _write(f"{d}/a.csv", CONTENT.encode("utf-8"))
    df = CSV.read_csv_tolerant(spark, d, required="微博正文")
    ids = [r.row_id for r in df.orderBy("row_id").collect()]
    assert ids == [0, 1, 2, 3]
    again = [r.row_id for r in CSV.read_csv_tolerant(spark, d, required="微博正文").orderBy("row_id").collect()]
    assert ids == again


def test_missing_required_column_raises(spark):
    d = tempfile.mkdtemp(prefix="vx-csv-", dir="/tmp")
    _write(f"{d}/a.csv", "x,y\n1,2\n".encode("utf-8"))
    try:
        CSV.read_csv_tolerant(spark, d, required="微博正文")
        raise AssertionError("expected ValueError")
    except ValueError:
        pass
    assert CSV.read_optional(spark, f"{d}/a.csv", required="微博正文") is None
    assert CSV.read_optional(spark, None, required="微博正文") is None


def test_mojibake_repair(spark):
    d = tempfile.mkdtemp(prefix="vx-csv-", dir="/tmp")
    _write(f"{d}/gb.csv", "微博正文,n\n南京地铁,1\n车厢拥挤,2\n".encode("gb18030"))
    garbled = CSV.read_csv_tolerant(spark, f"{d}/gb.csv", required=None, candidates=["latin1"])
    assert "微博正文" not in garbled.columns
    fixed = CSV.repair_mojibake(garbled)
    assert "微博正文" in fixed.columns
    assert [r["微博正文"] for r in fixed.orderBy("row_id").collect()] == ["南京地铁", "车厢拥挤"]


def test_sectioned_text_edge_cases(spark):
    d = tempfile.mkdtemp(prefix="vx-sec-", dir="/tmp")
    text = "\n".join([
        "1. before any header",
        "",
        "◆ 簇 1 (共 2 条):",
        "-----------------",
        "1. 播报温暖，守护陪伴",
        "2. 3. bb",
        "random line",
        "◆ 簇 2 (共 1 条):",
        "1. 车厢拥挤",
        "◆ 簇 1 (共 9 条):",
        "1. appended",
    ])
    _write(f"{d}/listing.txt", text.encode("utf-8"))
    got = [(r.cluster_id, r.pos, r.text) for r in SEC.read_sectioned(spark, d).orderBy("cluster_id", "pos").collect()]
    assert got == [(1, 1, "播报温暖，守护陪伴"), (1, 2, "3. bb"), (1, 3, "appended"), (2, 1, "车厢拥挤")]


def test_listing_layout(spark):
    import glob

    from voxpop.sinks import files as K

    df = spark.createDataFrame([(2, 10, "车厢拥挤"), (1, 3, "播报温暖，守护陪伴"), (1, 5, "情感共鸣")],
                               "cluster_id long, row_id long, text string")
    path = K.write_listing(K.listing_lines(df))
    local = path[len("file:"):] if path.startswith("file:") else path
    text = "".join(open(f, encoding="utf-8").read() for f in sorted(glob.glob(f"{local}/part-*")))
    lines = []
    for cid, items in ((1, ["播报温暖，守护陪伴", "情感共鸣"]), (2, ["车厢拥挤"])):
        header = f"\n◆ 簇 {cid} (共 {len(items)} 条):"
        lines += [header, "-" * len(header)] + [f"{i}. {t}" for i, t in enumerate(items, 1)]
    assert text == "\n".join(lines) + "\n"
    back = SEC.read_sectioned(spark, path).orderBy("cluster_id", "pos").collect()
    assert [(r.cluster_id, r.pos, r.text) for r in back] == [(1, 1, "播报温暖，守护陪伴"), (1, 2, "情感共鸣"), (2, 1, "车厢拥挤")]
