"""Encoding-tolerant CSV scans (S1-S4, S6, P15); one file may be many splits.

1. The first scan reads all raw lines (the text source hands over bytes, files
   are split) and leaves one small row per split: the candidate encodings that
   fail on it, and, for a split that begins outside and for one that begins
   inside a quoted cell, how it ends and how many records begin in it. A line
   break, quote or comma is never part of a longer character in the candidates,
   so lines decode alone and quotes can be followed in bytes. A wrong charset
   never fails inside Spark's CSV reader (it yields U+FFFD or plausible nonsense),
   so this decides: the first candidate that decodes the whole file without
   U+FFFD and whose header holds the required column.
2. A file that none decodes is an error or, with ``recover=True``, read with
   replacement characters; without the required column it is then taken as
   GB18030 bytes read as latin1 and repaired, as in the reference.
3. The splits of a file, in order, compose to the true state and record number
   at each split's begin. The second scan cuts whole records with them; only
   records that run across splits (at most one at each border) are shuffled.
4. Spark's ``from_csv`` parses the records with pandas-compatible quoting (``"``
   doubled, line breaks inside quotes), all strings (no inference), and pandas'
   default NA strings as nulls. Columns are matched by name across files, never
   by position. A quote inside a cell that does not begin with one is text.
5. ``row_id`` is the file's rank in path order times 2^40 plus the record's
   position in the file (header and empty lines not counted), so it is stable
   across re-reads and does not depend on the splits.

A header may hold quoted line breaks but ends in its file's first split; a file
whose header does not counts as unreadable.
"""

from __future__ import annotations

import codecs
import csv
import io
import re
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxpop.session import materialize, scratch_path

# Candidate orders of the reference's two readers, and pandas'
# default NA strings (cells read as null).
SIMPLE_ENCODINGS = ["gb18030", "gbk", "utf-8-sig", "utf-8"]
ROBUST_ENCODINGS = ["utf-8-sig", "gb18030", "gbk", "utf-8", "latin1"]
PANDAS_NA_VALUES = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
                    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

FILE_ID_SHIFT = 1 << 40


def _header_cells(line: str) -> list[str]:
    try:
        return next(csv.reader(io.StringIO(line)))
    except (StopIteration, csv.Error):
        return []


RECOVER_ENCODINGS = ["gb18030", "gbk", "utf-8"]


QUOTED = re.compile(rb'[^"]*+(?:""[^"]*+)*+')
SPLIT_SCHEMA = ("file long, start long, path string, header binary, bad array<string>, "
                "end0 boolean, end1 boolean, records0 long, records1 long")
RECORD_SCHEMA = "grp int, row_id long, start long, whole boolean, record string"


def ends_inside(line: bytes, inside: bool) -> bool:
    """Whether a line that begins outside (inside) a quoted cell ends inside one."""
    if b'"' not in line:
        return inside
    pos = 0
    if not inside and line[:1] == b'"':
        pos, inside = 1, True
    while True:
        if inside:
            pos = QUOTED.match(line, pos).end() + 1  # past the closing quote
            if pos > len(line):
                return True
        pos = line.find(b',"', pos) + 2
        if pos < 2:
            return False
        inside = True


def _lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Every physical line as ``(file, start, path, line)``; the path only in a file's first split."""
    path, start = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    return spark.read.option("lineSep", "\n").text(paths).select(
        F.xxhash64(path).alias("file"), start.alias("start"), F.when(start == 0, path).alias("path"), F.col("value").cast("binary").alias("line"))


def _runs(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[bool, pd.DataFrame]]:
    """The rows of one split at a time, in order, and whether they begin it."""
    last = None
    for f in frames:
        file, start = f["file"].to_numpy(), f["start"].to_numpy()
        cuts = np.flatnonzero((file[1:] != file[:-1]) | (start[1:] != start[:-1])) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(f)]):
            if hi > lo:
                key = (file[lo], start[lo])
                yield key != last, f.iloc[lo:hi]
                last = key


def _without_bom(line: bytes) -> bytes:
    return line.removeprefix(codecs.BOM_UTF8)


def _blank(line: bytes) -> bool:
    return line in (b"", b"\r")


def probe_splits(spark: SparkSession, paths: str | list[str], candidates: list[str] | None = None) -> DataFrame:
    """One row per split: header bytes (first split), failing candidates, and for a begin
    outside (0) and inside (1) a quoted cell the state at its end and the records that begin in it."""
    cands = candidates or ROBUST_ENCODINGS

    def decodes(raw: bytes, enc: str) -> bool:
        try:
            return "\ufffd" not in codecs.decode(raw, enc, errors="strict")
        except (UnicodeDecodeError, LookupError):
            return False

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        split, header, state, count = None, [], [], []

        def summary() -> pd.DataFrame:
            return pd.DataFrame([(*split[:3], b"\n".join(header) if split[1] == 0 and not open_header else None, sorted(split[3]), *state, *count)],
                                columns=["file", "start", "path", "header", "bad", "end0", "end1", "records0", "records1"])

        for begins, f in _runs(frames):
            lines = f["line"].tolist()
            if begins:
                if split is not None:
                    yield summary()
                split, header, state, count = (int(f["file"].iloc[0]), int(f["start"].iloc[0]), f["path"].iloc[0], set()), [], [False, True], [0, 0]
                open_header = split[1] == 0
            block = b"\n".join(lines)
            split[3].update(enc for enc in cands if enc not in split[3] and not decodes(block, enc))
            for line in lines:
                if open_header:
                    header.append(line)
                    line = _without_bom(line) if len(header) == 1 else line
                for h in (0, 1):
                    if not state[h] and not _blank(line):
                        count[h] += 1
                if b'"' in line:
                    state = [ends_inside(line, state[0]), ends_inside(line, state[1])]
                open_header = open_header and state[0]
        if split is not None:
            yield summary()

    return _lines(spark, paths).mapInPandas(run, SPLIT_SCHEMA)


def probe_encodings(splits: DataFrame, candidates: list[str] | None = None) -> DataFrame:
    """``(file, path, header, ok)`` per file: the bytes of its header, and the candidates that decode all of it."""
    every = F.array(*[F.lit(e) for e in candidates or ROBUST_ENCODINGS])
    return splits.groupBy("file").agg(
        F.max("path").alias("path"), F.max("header").alias("header"), F.array_distinct(F.flatten(F.collect_set("bad"))).alias("bad")
    ).select("file", "path", "header", F.array_except(every, F.col("bad")).alias("ok"))


def split_states(splits: DataFrame) -> DataFrame:
    """``(file, start, inside, base)``: whether a split begins inside a quoted cell, and how many
    records, the header aside, begin before it.

    A split either ends the same way whatever its begin, or keeps the state, or swaps it; so the
    state follows from the last split of the first kind and the number of swaps since. The window
    holds one row per split of a file.
    """
    w = Window.partitionBy("file").orderBy("start")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    swaps = F.when(F.col("end0") & ~F.col("end1"), 1).otherwise(0)
    s = splits.withColumn("swaps", F.sum(swaps).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    s = s.withColumn("known", F.last(F.when(F.col("end0") == F.col("end1"), F.struct(F.col("end0").cast("int").alias("end"), "swaps")), ignorenulls=True).over(before))
    s = s.withColumn("turns", F.coalesce(F.lag("swaps").over(w), F.lit(0)) + F.coalesce(F.col("known.end") - F.col("known.swaps"), F.lit(0)))
    s = s.withColumn("inside", F.pmod(F.col("turns"), F.lit(2)) == 1)
    own = F.when(F.col("inside"), F.col("records1")).otherwise(F.col("records0")) - F.when(F.col("start") == 0, 1).otherwise(0)
    return s.withColumn("own", own).select("file", "start", "inside", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("base"))


def _records(lines: DataFrame, decoders: dict[int, tuple[str, str]]) -> DataFrame:
    """The records that begin in each split, decoded; parts of those that cross a border have ``whole`` false."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, part, meta, inside, number = [], [], None, False, 0

        def emit(whole: bool) -> None:
            raw = b"\n".join(part)
            grp, rank, start = meta
            if number >= 0 and grp >= 0:  # the header is number -1
                enc, errors = decoders[grp]
                out.append((grp, rank * FILE_ID_SHIFT + number, start, whole, codecs.decode(raw, enc, errors=errors)))
            part.clear()

        def flush() -> pd.DataFrame:
            done = pd.DataFrame(out, columns=["grp", "row_id", "start", "whole", "record"])
            out.clear()
            return done

        for begins, f in _runs(frames):
            lines = f["line"].tolist()
            if begins:
                if part:
                    emit(False)
                first = f.iloc[0]
                if first["inside"] < 0:
                    raise RuntimeError("the files or their splits changed between the two scans")
                meta, inside = (int(first["grp"]), int(first["rank"]), int(first["start"])), bool(first["inside"])
                number = int(first["base"]) - 1 if meta[2] else -2
                complete = not inside  # the record that is open at the begin lacks its head
                if meta[2] == 0:
                    lines[0] = _without_bom(lines[0])
            for line in lines:
                if not inside:
                    if _blank(line):
                        continue
                    number, complete = number + 1, True
                inside = ends_inside(line, inside)
                part.append(line if inside else line.removesuffix(b"\r"))
                if not inside:
                    emit(complete)
            if out:
                yield flush()
        if part:
            emit(False)
        if out:
            yield flush()

    return lines.mapInPandas(run, RECORD_SCHEMA)


@contextmanager
def _same_splits(spark: SparkSession, split_bytes: int | None):
    """Both scans cut files alike, also while executors come and go; the session's settings are put back."""
    wanted = {"spark.sql.files.minPartitionNum": spark.conf.get("spark.sql.files.minPartitionNum", None) or str(spark.sparkContext.defaultParallelism)}
    if split_bytes:
        wanted["spark.sql.files.maxPartitionBytes"] = str(split_bytes)
    kept = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in kept.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _header(raw: bytes | None, enc: str, errors: str = "strict") -> list[str]:
    text = codecs.decode(bytes(raw or b""), enc, errors=errors).lstrip("\ufeff").rstrip("\r")
    return [cell.strip() for cell in _header_cells(text)]


STANDARD_CHARSETS = {"UTF-8", "ISO-8859-1", "US-ASCII", "UTF-16", "UTF-16BE", "UTF-16LE", "UTF-32"}


def allow_charset(spark: SparkSession, charset: str) -> None:
    """Spark 4 accepts only a short charset list in CSV and ``encode``/``decode``;
    GB18030 and GBK need ``spark.sql.legacy.javaCharsets`` (a runtime SQL conf)."""
    if charset.upper() not in STANDARD_CHARSETS:
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")


def _names(header: list[str]) -> list[str]:
    """Column names as Spark's reader gives them: ``_c<i>`` for empty ones, the position behind repeated ones."""
    low = [h.lower() for h in header]
    return [f"_c{i}" if not h else f"{h}{i}" if low.count(h.lower()) > 1 else h for i, h in enumerate(header)]


def _parsed(records: DataFrame, names: list[str], na_values: list[str]) -> DataFrame:
    """The cells of ``(row_id, _file, record)`` rows of one header; columns of the file with these two names give way."""
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    cells = records.select("row_id", "_file", F.from_csv("record", schema, {"quote": '"', "escape": '"', "mode": "PERMISSIVE"}).alias("r"))
    cell = [(F.col(f"r.c{i}"), n) for i, n in enumerate(names) if n.lower() not in ("row_id", "_file")]
    return cells.select(*[F.when(~c.isin(*na_values), c).alias(n) for c, n in cell], "_file", "row_id")


def read_csv_tolerant(spark: SparkSession, paths: str | list[str], required: str | None = None,
                      candidates: list[str] | None = None, na_values: list[str] | None = None,
                      recover: bool = False, split_bytes: int | None = None) -> DataFrame:
    """S1/S2/S4 + P15: every file in the first encoding that decodes all of it strictly and
    has the required column. A file that fits none is an error before any job on
    the data, or with ``recover`` the reference's recovery (see module doc).
    ``split_bytes`` bounds the bytes of a task in place of the session's setting."""
    na = PANDAS_NA_VALUES if na_values is None else na_values
    with _same_splits(spark, split_bytes):
        splits = materialize(probe_splits(spark, paths, candidates), "csv-splits")
        files = sorted(probe_encodings(splits, candidates).collect(), key=lambda r: r.path)  # one row per file, as the file listing itself
        groups, known, bad = _grouped(files, required, recover)
        if bad:
            raise ValueError(f"no candidate encoding reads {bad[:5]} with column {required!r}")
        if not groups:
            raise ValueError(f"no files under {paths}")
        known = spark.createDataFrame(known, "file long, grp int, rank long, _file string")
        # One row of five numbers per split: some 20 MB at 100 TB in splits of 128 MB.
        states = split_states(splits).join(known.drop("_file"), "file")
        lines = _lines(spark, paths).join(F.broadcast(states), ["file", "start"], "left").select(
            "file", "start", "line", F.coalesce(F.col("inside").cast("int"), F.lit(-1)).alias("inside"),
            *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("base", "grp", "rank")])
        path = scratch_path(spark, "csv-records")
        decoders = {g: ("utf-8" if enc == "utf-8-sig" else enc, "replace" if mode == "replace" else "strict")
                    for g, (enc, mode, _) in enumerate(groups)}
        writer = _records(lines, decoders).write
        (writer.partitionBy("grp") if len(groups) > 1 else writer).parquet(path)
    staged = spark.read.schema(RECORD_SCHEMA).parquet(path)
    crossing = staged.where(~F.col("whole")).groupBy("grp", "row_id").agg(F.array_sort(F.collect_list(F.struct("start", "record"))).alias("p"))
    crossing = crossing.select("grp", "row_id", F.array_join("p.record", "\n").alias("record"))
    records = staged.where("whole").select("grp", "row_id", "record").unionByName(crossing)
    records = records.withColumn("rank", F.shiftright("row_id", 40)).join(known.select("rank", "_file"), "rank")
    out = None
    for g, (_, mode, header) in enumerate(groups):
        part = _parsed(records.where(F.col("grp") == g), _names(list(header)), na)
        if mode == "repair":
            part = repair_mojibake(part, required)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if required is not None and required not in out.columns:
        raise ValueError(f"required column {required!r} missing; columns: {out.columns}")
    return out.select(*[f"`{c.replace('`', '``')}`" for c in out.columns if c not in ("_file", "row_id")], "_file", "row_id")


def _grouped(files: list, required: str | None, recover: bool) -> tuple[list[tuple], list[tuple], list[str]]:
    """The groups ``(encoding, mode, header)``, each file's group and rank in path order, and the files that fit none."""
    chosen: list[tuple] = []
    bad: list[str] = []
    for r in files:
        fits, mode, errors = [], "strict", "strict"
        if r.header is not None and bytes(r.header).strip():
            fits = [enc for enc in r.ok if required is None or required in _header(r.header, enc)]
            if not fits and recover:
                fits, mode, errors = [e for e in RECOVER_ENCODINGS if required in _header(r.header, e, "replace")], "replace", "replace"
                if not fits:
                    fits, mode = ["latin1"], "repair"
        if fits:
            chosen.append((fits[0], mode, tuple(_header(r.header, fits[0], errors))))
        else:
            bad.append(r.path)
    if bad:
        return [], [], bad
    groups = sorted(set(chosen))
    number = {g: i for i, g in enumerate(groups)}
    return groups, [(r.file, number[c], rank, r.path) for rank, (r, c) in enumerate(zip(files, chosen))], []


def read_csv_simple(spark: SparkSession, paths: str | list[str], required: str | None = None, **kw) -> DataFrame:
    """The short candidate list of the reference's simple reader."""
    return read_csv_tolerant(spark, paths, required, candidates=SIMPLE_ENCODINGS, **kw)


def read_optional(spark: SparkSession, path: str | None, required: str, **kw) -> DataFrame | None:
    """A table used only if it exists, decodes and has the column, else None; a failing cluster is an error."""
    if not path:
        return None
    try:
        return read_csv_tolerant(spark, path, required, **kw)
    except ValueError:  # no encoding reads it with that column
        return None
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", None):
            return None
        raise


def _latin1_to_gb18030(c):
    """latin1 bytes decoded as GB18030, bytes that are no character left out (Python's ``errors='ignore'``)."""
    return F.regexp_replace(F.decode(F.encode(c, "ISO-8859-1"), "GB18030"), "\ufffd", "")


def repair_mojibake(df: DataFrame, required: str | None = None) -> DataFrame:
    """S3: a GB18030 file read as latin1. Header names are re-decoded; then each
    string column is repaired only if every non-null cell is latin1-encodable
    (one failing cell skips the column, as in the reference)."""
    def fix_name(c: str) -> str:
        try:
            return c.encode("latin1").decode("gb18030", errors="ignore")
        except UnicodeEncodeError:
            return c

    renamed = df.toDF(*[fix_name(c) for c in df.columns])
    if required is not None and required in renamed.columns:
        return renamed
    strings = [f.name for f in renamed.schema.fields if isinstance(f.dataType, T.StringType) and not f.name.startswith("_")]
    if not strings:
        return renamed
    allow_charset(df.sparkSession, "GB18030")
    latin = "^[\\x00-\\xFF]*$"
    checks = renamed.agg(*[F.bool_and(F.col(f"`{c}`").isNull() | F.col(f"`{c}`").rlike(latin)).alias(f"c{i}")
                           for i, c in enumerate(strings)]).first()  # one row of flags
    ok = {c for i, c in enumerate(strings) if checks[f"c{i}"] in (True, None)}
    return renamed.select(*[(_latin1_to_gb18030(F.col(f"`{c}`")) if c in ok else F.col(f"`{c}`")).alias(c)
                            for c in renamed.columns])
