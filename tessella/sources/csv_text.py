"""Delimited text in and out: outcome checks, delimiter detection, and a tokenizer for whole texts.

The tokenizer is also a table function, so a text column can be unfolded in SQL. Texts that hold
one record per line and no line breaks in cells go through Spark's own reader instead."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Candidates in order of preference, and the wording of failures.
DELIMITERS = [",", "\t", ";", "|"]
MESSAGES = {"empty": "No data pasted.", "no-rows": "No rows found.", "json": "This looks like JSON, not CSV.", "no-data-rows": "Found a header row but no data rows."}


@dataclass
class Table:
    headers: list[str]
    rows: list[list[str | None]]
    delimiter: str
    ok: bool = True


@dataclass
class Failure:
    reason: str
    message: str
    ok: bool = field(default=False)


def looks_like_json(text: str) -> bool:
    t = text.strip()
    if len(t) < 2 or (t[0], t[-1]) not in {("{", "}"), ("[", "]")}:
        return False
    try:
        json.loads(t)
    except ValueError:
        return False
    return True


def sniff_delimiter(text: str) -> str:
    """The candidate seen most often in the first line; earlier candidates win ties."""
    line = text.strip().split("\n", 1)[0]
    return max(DELIMITERS, key=lambda d: (line.count(d), -DELIMITERS.index(d))) if any(d in line for d in DELIMITERS) else ","


def tokenize(text: str, delimiter: str) -> Iterator[list[str]]:
    """Records of a text. A quote opens a cell only at its start, doubled quotes stand for one, and text behind
    a closing quote is kept; an open quote runs to the end. Carriage returns outside quotes vanish, and so do
    empty lines; a line of blanks is a record."""
    special = re.compile(f'["\n\r]|{re.escape(delimiter)}')
    record: list[str] = []
    cell: list[str] = []
    at, n, quoted, touched = 0, len(text), False, False
    while at < n:
        if quoted:
            end = text.find('"', at)
            if end < 0:
                cell.append(text[at:])
                break
            cell.append(text[at:end])
            if text[end + 1:end + 2] == '"':
                cell.append('"')
                at = end + 2
            else:
                quoted, at = False, end + 1
            continue
        hit = special.search(text, at)
        if not hit:
            cell.append(text[at:])
            break
        plain, mark = text[at:hit.start()], hit.group()
        at = hit.end()
        if plain:
            cell.append(plain)
        if mark == '"':
            if any(cell):
                cell.append('"')
            else:
                quoted, touched = True, True
        elif mark == "\n":
            record.append("".join(cell))
            if len(record) > 1 or record[0] or touched:
                yield record
            record, cell, touched = [], [], False
        elif mark != "\r":
            record.append("".join(cell))
            cell = []
    record.append("".join(cell))
    if len(record) > 1 or record[0] or touched:
        yield record


def rectify(cells: list[str], width: int) -> list[str | None]:
    """Exactly ``width`` cells, trimmed, empty ones missing."""
    trimmed = [c.strip().strip("﻿").strip() or None for c in cells[:width]]
    return trimmed + [None] * (width - len(trimmed))


def headers_of(cells: list[str]) -> list[str]:
    return [c.strip().strip("﻿") or f"column_{i}" for i, c in enumerate(cells, 1)]


def parse(text: str) -> Table | Failure:
    """The whole outcome for one text; never raises on bad data."""
    if not text.strip():
        return Failure("empty", MESSAGES["empty"])
    if looks_like_json(text):
        return Failure("json", MESSAGES["json"])
    d = sniff_delimiter(text)
    records = list(tokenize(text, d))
    if not records:
        return Failure("empty", MESSAGES["no-rows"])
    if len(records) == 1:
        return Failure("no-data-rows", MESSAGES["no-data-rows"])
    headers = headers_of(records[0])
    return Table(headers, [rectify(r, len(headers)) for r in records[1:]], d)


@F.udtf(returnType="row_idx long, cells array<string>")
class TokenizeText:
    """``tokenize_text(text, delimiter)``: one row per record, numbered from 0 (the header)."""

    def eval(self, text: str, delimiter: str):  # noqa: ANN201
        if text is not None:
            yield from enumerate(tokenize(text, delimiter or sniff_delimiter(text)))


def register(spark: SparkSession) -> None:
    spark.udtf.register("tokenize_text", TokenizeText)


def scan_texts(texts: DataFrame, text: str = "text", key: str = "text_id") -> DataFrame:
    """(key, row_idx, cells) of many texts, one text per task row."""
    def run(batches):  # noqa: ANN001, ANN202
        import pandas as pd

        for pdf in batches:
            for k, t in zip(pdf[key], pdf[text]):
                got = parse(t or "")
                if got.ok:
                    yield pd.DataFrame({key: k, "row_idx": range(len(got.rows)), "cells": got.rows})
    return texts.select(key, text).mapInPandas(run, f"{key} {dict(texts.dtypes)[key]}, row_idx long, cells array<string>")


def scan_lines(spark: SparkSession, path: str, delimiter: str = ",", **options) -> DataFrame:
    """Spark's own reader with the same reading of quotes, blanks and empties; all columns are texts."""
    return spark.read.csv(path, sep=delimiter, header=True, quote='"', escape='"', multiLine=True, mode="PERMISSIVE", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, nullValue="", inferSchema=False, **options)


def cell_text(c: Column) -> Column:
    """A cell as written: quoted if it holds a quote, comma or line break."""
    t = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(t.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t)


def csv_lines(df: DataFrame) -> DataFrame:
    """One text line per row."""
    return df.select(F.concat_ws(",", *[cell_text(F.col(c)) for c in df.columns]).alias("line"))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).csv(path, header=True, quote='"', escape='"', emptyValue="")
