"""Parse raw delimited records into typed cells, separating records that fail with a reason.

Method: structural indexing. A batch of records is one byte buffer. Numpy masks mark quotes and
delimiters; the running parity of quotes per record tells which delimiters are structural. Records
whose quotes do not all open or close a quoted cell (free quotes inside plain cells, unclosed
cells, text behind a closing quote) are found by checking every cell's edges, and only those are
walked cell by cell. Counts and types are then checked over the flattened cells.

Defined results
- null text: one empty record, so ``column_count`` unless exactly one header is expected.
- a carriage return at the end of a record is ignored.
- blank cells are valid for every type and come out as null.
- null or empty ``column_types``: every column counts as string. A type list shorter than the
  headers leaves the rest as string.
- null ``headers``: no cell count is right, so ``column_count``; a record without a file row has
  reason ``column_count`` as well. Quoting is then judged with a comma.
- repeated records are judged alike, each under its own key.
- integers beyond 64 bits are valid integers; their typed value is null.
- extra columns of the inputs are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.runtime import small

DELIMITERS = [",", "\t", ";", "|"]
DOUBLE = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
LONG = r"^[+-]?[0-9]+$"
DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
PARSED = "row_id long, file_id long, line_no int, reason string, cells array<string>"


def delimiter_of(header_line: Column, headers: Column) -> Column:
    """The candidate that splits the header line into the very names, then into as many, then the most frequent one."""
    plain = lambda names: F.transform(names, lambda n: F.trim(F.coalesce(n, F.lit(""))))
    def seen(d: str) -> Column:
        n = F.length(header_line) - F.length(F.replace(header_line, F.lit(d), F.lit("")))
        same = plain(F.split(header_line, f"\\Q{d}\\E", -1)) == plain(headers)
        return F.struct(F.coalesce(same, F.lit(False)).alias("same"), (n + 1 == F.size(headers)).alias("fits"), n.alias("n"), F.lit(-DELIMITERS.index(d)).alias("first"), F.lit(d).alias("d"))
    return F.when(header_line.isNull(), F.lit(",")).otherwise(F.array_max(F.array(*map(seen, DELIMITERS)))["d"])


def scan_record(text: str, delimiter: str) -> tuple[list[str] | None, bool]:
    """Cells of one record and whether its quoting holds; the exact rule, cell by cell."""
    cells, at, n, step = [], 0, len(text), len(delimiter)
    while True:
        if at < n and text[at] == '"':
            parts, begin = [], at + 1
            while True:
                end = text.find('"', begin)
                if end < 0:
                    return None, False
                if text[end + 1:end + 2] == '"':
                    parts.append(text[begin:end + 1])
                    begin = end + 2
                    continue
                parts.append(text[begin:end])
                break
            cells.append("".join(parts))
            at = end + 1
            if at >= n:
                return cells, True
            if text[at:at + step] != delimiter:
                return None, False
            at += step
        else:
            end = text.find(delimiter, at)
            if end < 0:
                cells.append(text[at:])
                return cells, True
            cells.append(text[at:end])
            at = end + step


def _run_ids(lengths: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(lengths)), lengths)


def split_batch(texts: pa.Array, delimiters: pa.Array) -> tuple[np.ndarray, pa.ListArray]:
    """For each record whether its quoting holds, and its cells (empty where not)."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    texts = pc.replace_substring_regex(texts, "\r$", "")
    delimiters = pc.fill_null(delimiters, ",")
    n = len(texts)
    if not n:
        return np.zeros(0, bool), pa.array([], pa.list_(pa.string()))
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + n + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    lengths = np.diff(offsets)
    single = pc.equal(pc.binary_length(delimiters), 1).to_numpy(zero_copy_only=False)
    codes = np.array([d.encode()[:1] or b"," for d in delimiters.to_pylist()], "S1").view(np.uint8)
    row = _run_ids(lengths)
    quote = data == 34
    parity = np.cumsum(quote, dtype=np.int64)
    before = np.concatenate([[0], parity])
    odd = ((parity - before[offsets[:-1]][row]) & 1).astype(bool)  # inside a quoted stretch, after this byte
    cut = (data == codes[row]) & ~odd
    # cell edges
    at = np.flatnonzero(cut)
    first = np.zeros(n, np.int64)
    per = np.bincount(row[at], minlength=n) + 1
    first[1:] = np.cumsum(per)[:-1]
    cells = int(per.sum())
    owner = _run_ids(per)
    begin, end = np.empty(cells, np.int64), np.empty(cells, np.int64)
    begin[first] = offsets[:-1]
    end[first + per - 1] = offsets[1:]
    inner = np.ones(cells, bool)
    inner[first] = False
    begin[inner] = at + 1
    inner[:] = True
    inner[first + per - 1] = False
    end[inner] = at
    # a cell that holds quotes must be enclosed by them, with nothing but doubled quotes inside
    total = before[end] - before[begin]
    holds = total > 0
    safe = np.minimum(begin, max(len(data) - 1, 0))
    last = np.maximum(end - 1, 0)
    enclosed = holds & (end - begin >= 2) & (data[safe] == 34) & (data[last] == 34) if len(data) else holds
    suspect = np.zeros(n, bool)
    suspect[owner[holds & ~enclosed]] = True
    suspect |= ~single | (((before[offsets[1:]] - before[offsets[:-1]]) & 1) == 1)
    # in an enclosed cell inner quotes come in adjacent pairs: position parity of every second one
    q = np.flatnonzero(quote)
    cell_of_q = np.searchsorted(begin, q, "right") - 1 if len(q) else q
    interior = enclosed[cell_of_q] & (q > begin[cell_of_q]) & (q < end[cell_of_q] - 1) if len(q) else np.zeros(0, bool)
    qi, ci = q[interior], cell_of_q[interior]
    drop_second = np.zeros(0, np.int64)
    if len(qi):
        nth = np.arange(len(qi)) - np.searchsorted(ci, ci)
        second = (nth & 1) == 1
        pair_ok = np.ones(len(qi), bool)
        pair_ok[1:][second[1:]] = (qi[1:] - qi[:-1] == 1)[second[1:]]
        counts = np.bincount(ci, minlength=cells)
        pair_ok &= (counts[ci] & 1) == 0
        suspect[owner[ci[~pair_ok]]] = True
        drop_second = qi[second]
    # contents: all bytes but structural delimiters, enclosing quotes and second quotes of pairs
    keep = ~cut
    keep[begin[enclosed]] = False
    keep[end[enclosed] - 1] = False
    keep[drop_second] = False
    kept = np.concatenate([[0], np.cumsum(keep)])
    ok = ~suspect
    flat_offsets = np.append(kept[begin], kept[-1])
    content = pa.LargeStringArray.from_buffers(cells, pa.py_buffer(flat_offsets.astype(np.int64)), pa.py_buffer(data[keep].tobytes())).cast(pa.string())
    lists = pa.ListArray.from_arrays(pa.array(np.append(first, cells), pa.int32()), content)
    if not suspect.any():
        return ok, lists
    where = np.flatnonzero(suspect)
    slow, good = [], []
    for t, d in zip(texts.take(pa.array(where)).to_pylist(), delimiters.take(pa.array(where)).to_pylist()):
        c, fine = scan_record(t, d or ",")
        slow.append(c or [])
        good.append(fine)
    ok[where] = good
    both = pa.concat_arrays([lists, pa.array(slow, pa.list_(pa.string()))])
    pick = np.arange(n)
    pick[where] = n + np.arange(len(where))
    return ok, both.take(pa.array(pick))


def valid_dates(s: pa.Array) -> np.ndarray:
    """Whether each text is an existing day written YYYY-MM-DD."""
    good = pc.fill_null(pc.match_substring_regex(s, DATE), False).to_numpy(zero_copy_only=False).copy()
    if good.any():
        day = s.filter(pa.array(good))
        y, m, d = (pc.utf8_slice_codeunits(day, a, b).cast(pa.int32()).to_numpy() for a, b in ((0, 4), (5, 7), (8, 10)))
        leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
        longest = np.array([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])[np.minimum(m, 12)] + ((m == 2) & leap)
        good[good] = (y >= 1) & (m >= 1) & (m <= 12) & (d >= 1) & (d <= longest)
    return good


def invalid_cells(values: pa.Array, types: np.ndarray) -> np.ndarray:
    """Flags flattened cells that are not blank and break their column's type."""
    bad = np.zeros(len(values), bool)
    trimmed = pc.utf8_trim_whitespace(values)
    for kind, check in (("double", DOUBLE), ("long", LONG), ("date", None)):
        at = np.flatnonzero(types == kind)
        if len(at):
            own = trimmed.take(pa.array(at))
            good = valid_dates(own) if check is None else pc.match_substring_regex(own, check).to_numpy(zero_copy_only=False)
            bad[at] = ~(good | pc.equal(own, "").to_numpy(zero_copy_only=False))
    return bad


def judge_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    col = {f.name: batch.column(i) for i, f in enumerate(batch.schema)}
    ok, cells = split_batch(col["row_text"], col["delimiter"])
    n = len(ok)
    expected = pc.fill_null(col["n_headers"], -1).to_numpy(zero_copy_only=False)
    counts = pc.list_value_length(cells).to_numpy(zero_copy_only=False) if n else np.zeros(0, np.int64)
    reason = np.full(n, None, object)
    right = ok & (counts == expected)
    reason[~right] = "column_count"
    reason[~ok] = "quoting"
    at = np.flatnonzero(right)
    if len(at):
        sub = cells.take(pa.array(at))
        values = sub.flatten()
        types = np.concatenate([np.resize(np.array(((t or []) + ["string"] * c)[:c], object), c) if c else np.zeros(0, object) for t, c in zip(col["column_types"].take(pa.array(at)).to_pylist(), counts[at])])
        bad = invalid_cells(values, types)
        reason[at[np.unique(_run_ids(counts[at])[bad])]] = "invalid_value"
    return pa.RecordBatch.from_arrays(
        [col["row_id"], col["file_id"], col["line_no"], pa.array(reason, pa.string()), cells],
        names=["row_id", "file_id", "line_no", "reason", "cells"],
    )


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield judge_batch(b)


def parse_records(rows: DataFrame, files: DataFrame) -> DataFrame:
    """One row per record: its cells and, where it fails, the first reason that holds.

    ``rows``: row_id, file_id, line_no, row_text. ``files``: file_id, headers, header_line,
    delimiter_char, column_types. The files side is broadcast only while its estimate is small;
    otherwise AQE splits a file that holds much of the rows."""
    meta = files.select(
        F.col("file_id").alias("_file"),
        F.when(F.col("headers").isNotNull(), F.size("headers")).alias("n_headers"),
        F.coalesce(F.nullif(F.col("delimiter_char"), F.lit("")), delimiter_of(F.col("header_line"), F.col("headers"))).alias("delimiter"),
        "column_types",
    )
    joined = rows.select("row_id", "file_id", "line_no", "row_text").join(small(meta), F.col("file_id") == F.col("_file"), "left").drop("_file")
    return joined.mapInArrow(_judge, PARSED)


def rejects(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reason").isNotNull()).select("row_id", "reason")


def typed_cells(parsed: DataFrame, files: DataFrame) -> DataFrame:
    """Valid records as one row per cell with its header and a value in the column of its type.

    Blank headers are named ``column_<ordinal>``; a repeated name keeps its place by ``ordinal``."""
    meta = files.select(F.col("file_id").alias("_file"), "headers", "column_types")
    cell = F.trim(F.col("cell"))
    kind = F.coalesce(F.get("column_types", F.col("ordinal")), F.lit("string"))
    name = F.trim(F.get("headers", F.col("ordinal")))
    return (
        parsed.where(F.col("reason").isNull())
        .select("row_id", "file_id", "line_no", F.posexplode("cells").alias("ordinal", "cell"))
        .join(small(meta), F.col("file_id") == F.col("_file"), "left")
        .select(
            "row_id", "file_id", "line_no", "ordinal",
            F.when(F.coalesce(name, F.lit("")) == "", F.concat(F.lit("column_"), (F.col("ordinal") + 1).cast("string"))).otherwise(name).alias("header"),
            kind.alias("column_type"),
            F.when(kind == "string", F.nullif(F.col("cell"), F.lit(""))).alias("string_value"),
            F.when(kind == "double", F.expr("try_cast(trim(cell) as double)")).alias("double_value"),
            F.when(kind == "long", F.expr("try_cast(trim(cell) as bigint)")).alias("long_value"),
            F.when((kind == "date") & (cell != ""), F.expr("try_cast(trim(cell) as date)")).alias("date_value"),
        )
    )
