"""FITS files as Spark tables: header cards and binary-table rows, decoded per file inside the tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from ..session import bound_batches

_BLOCK = 2880
_CARD = 80
# Element type of each TFORM code, big-endian.
_ELEMENT = {"L": "S1", "B": "u1", "I": ">i2", "J": ">i4", "K": ">i8", "E": ">f4", "D": ">f8", "A": "S"}
# Bytes per element of the formats that are passed over.
_PASSED_OVER = {"C": 8, "M": 16, "P": 8, "Q": 16}
# Rows, of points or of cards, handed over by a task at once.
_ROWS_PER_BATCH = 20_000

HEADER_SCHEMA = "file string, hdu int, hdu_name string, key string, value string, comment string"
STATUS_SCHEMA = "status string, filename string, tic bigint, sector int, rows bigint, error string"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Binary files as (filename, content)."""
    return spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_name").alias("filename"), "content")


def _cards(content: bytes, start: int) -> tuple[list[tuple[str, str, str]], int]:
    """Cards (key, value, comment) of the header at ``start`` and the offset of its data."""
    cards = []
    at = start
    while True:
        block = content[at : at + _BLOCK].decode("ascii", "replace")
        for k in range(0, _BLOCK, _CARD):
            card = block[k : k + _CARD]
            if len(card) < _CARD:
                raise ValueError("truncated header")
            key = card[:8].strip()
            if key == "END":
                return cards, at + _BLOCK
            cards.append((key, *_card_value(card)))
        at += _BLOCK


def _card_value(card: str) -> tuple[str, str]:
    if card[8:10] != "= ":
        return card[8:].strip(), ""
    body = card[10:].strip()
    if body.startswith("'"):
        end = 1
        while True:
            end = body.find("'", end)
            if end < 0:
                raise ValueError("unterminated text value")
            if body[end + 1 : end + 2] != "'":
                break
            end += 2
        value, rest = body[1:end].replace("''", "'").rstrip(), body[end + 1 :]
        return value, rest.partition("/")[2].strip()
    value, _, comment = body.partition("/")
    return value.strip(), comment.strip()


def _hdus(content: bytes) -> Iterator[tuple[list[tuple[str, str, str]], dict[str, str], int]]:
    """(cards, values by key, data offset) of every HDU."""
    at = 0
    while at < len(content):
        cards, data = _cards(content, at)
        keys = {k: v for k, v, _ in cards}
        size = 0
        if int(keys.get("NAXIS", 0)):
            size = abs(int(keys["BITPIX"])) // 8
            for axis in range(1, int(keys["NAXIS"]) + 1):
                size *= int(keys[f"NAXIS{axis}"])
            size = (size + abs(int(keys["BITPIX"])) // 8 * int(keys.get("PCOUNT", 0))) * int(keys.get("GCOUNT", 1))
        if data + size > len(content):
            raise ValueError("truncated data")
        yield cards, keys, data
        at = data + -(-size // _BLOCK) * _BLOCK


def _first_table(content: bytes) -> tuple[np.ndarray, dict[str, str]]:
    """Records and header of the first binary table; the records view the file bytes."""
    for _, keys, data in _hdus(content):
        if keys.get("XTENSION") != "BINTABLE":
            continue
        fields = []
        for i in range(1, int(keys["TFIELDS"]) + 1):
            form = keys[f"TFORM{i}"].strip()
            digits = form[: len(form) - len(form.lstrip("0123456789"))]
            count, code = int(digits or 1), form[len(digits) : len(digits) + 1]
            if code not in _ELEMENT:
                width = -(-count // 8) if code == "X" else count * _PASSED_OVER[code]
                fields.append((f"f{i}", f"V{width}"))
            elif code == "A":
                fields.append((f"f{i}", f"S{count}"))
            else:
                fields.append((f"f{i}", _ELEMENT[code], (count,)) if count != 1 else (f"f{i}", _ELEMENT[code]))
        row_type = np.dtype(fields)
        if row_type.itemsize != int(keys["NAXIS1"]):
            raise ValueError("row length does not match the column formats")
        if int(keys["NAXIS2"]) == 0:
            return np.empty(0, row_type), keys
        return np.frombuffer(content, row_type, count=int(keys["NAXIS2"]), offset=data), keys
    raise ValueError("no binary table")


def _objects(values: list) -> np.ndarray:
    out = np.empty(len(values), dtype=object)
    out[:] = values
    return out


def _column(raw: np.ndarray, keys: dict[str, str], i: int, kind: T.DataType) -> np.ndarray:
    """One column as values that fit the Spark type: scaled, with nulls where the file says so."""
    form = keys[f"TFORM{i}"].strip().lstrip("0123456789")[:1]
    if form not in _ELEMENT:
        raise ValueError(f"column {i} has the format {form}, which is not read")
    wanted = T.ArrayType if raw.ndim > 1 else {"A": T.StringType, "L": T.BooleanType}.get(form, T.NumericType)
    if not isinstance(kind, wanted):
        raise ValueError(f"column {i} is no {kind.simpleString()}")
    if raw.ndim > 1:
        return _objects(list(raw.astype(raw.dtype.newbyteorder("="))))
    if form == "A":
        return np.char.rstrip(np.char.decode(raw, "ascii", "replace"), " \x00").astype(object)
    if form == "L":
        return _objects([{b"T": True, b"F": False}.get(v) for v in raw])
    absent = np.zeros(len(raw), dtype=bool)
    if f"TNULL{i}" in keys and raw.dtype.kind in "iu":
        absent = raw == int(keys[f"TNULL{i}"])
    values = raw.astype(raw.dtype.newbyteorder("="))
    scale, zero = (float(keys.get(f"{k}{i}", d).upper().replace("D", "E")) for k, d in (("TSCAL", "1"), ("TZERO", "0")))
    if scale != 1 or zero:
        whole = values.dtype.kind in "iu" and scale.is_integer() and zero.is_integer()
        values = values.astype("int64") * int(scale) + int(zero) if whole else values * scale + zero
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        values = values.astype("float64")
        absent |= np.isnan(values)
    elif isinstance(kind, T.IntegralType) and values.dtype.kind in "iu":
        bits = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}[type(kind)]
        kept = values[~absent]
        if len(kept) and (int(kept.min()) < -(2 ** (bits - 1)) or int(kept.max()) >= 2 ** (bits - 1)):
            raise ValueError(f"column {i} does not fit {kind.simpleString()}")
    else:
        raise ValueError(f"column {i} is no {kind.simpleString()}")
    if not absent.any():
        return values
    values = values.astype(object)
    values[absent] = None
    return values


def _decoded(content: bytes, schema: T.StructType) -> list[np.ndarray]:
    """Columns of the first binary table in schema order; a column the file lacks is null."""
    records, keys = _first_table(content)
    index = {keys[f"TTYPE{i}"].strip().lower(): i for i in range(1, int(keys["TFIELDS"]) + 1) if f"TTYPE{i}" in keys}
    absent = np.full(len(records), None, dtype=object)
    columns = []
    for field in schema.fields:
        i = index.get(field.name.lower())
        columns.append(_column(records[f"f{i}"], keys, i, field.dataType) if i else absent)
    return columns or [absent]


def _frames(curves: list[list[np.ndarray]], names: list[str]) -> Iterator[pd.DataFrame]:
    """Curves laid end to end, in frames of bounded length."""
    whole = pd.DataFrame({n: np.concatenate([c[k] for c in curves]) for k, n in enumerate(names)})
    for at in range(0, len(whole), _ROWS_PER_BATCH):
        yield whole.iloc[at : at + _ROWS_PER_BATCH]


def read_light_curves(files: DataFrame, schema: str | T.StructType) -> DataFrame:
    """Rows of every readable file under ``schema``, with TIC and SECTOR of the file name appended.

    ``files`` has (filename, content). Files that cannot be read or named give no rows
    here; :func:`light_curve_status` reports them.
    """
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    bound_batches(files.sparkSession)
    named = _with_ids(files).filter(F.col("TIC").isNotNull() & F.col("SECTOR").isNotNull())
    out = T.StructType(
        [*fields.fields, T.StructField("TIC", T.LongType()), T.StructField("SECTOR", T.IntegerType())]
    )

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, rows = [], 0
        for batch in batches:
            for content, tic, sector in zip(batch["content"], batch["TIC"], batch["SECTOR"]):
                try:
                    curve = _decoded(bytes(content), fields)
                except (ValueError, KeyError):
                    continue
                size = len(curve[0])
                held.append([*curve, np.full(size, tic), np.full(size, sector)])
                rows += size
                if rows >= _ROWS_PER_BATCH:
                    yield from _frames(held, out.names)
                    held, rows = [], 0
        if held:
            yield from _frames(held, out.names)

    return named.select("content", "TIC", "SECTOR").mapInPandas(decode, out)


def light_curve_status(files: DataFrame, schema: str | T.StructType | None = None) -> DataFrame:
    """One row per file: success with its row count, or failed with the reason.

    With ``schema`` the columns are decoded too, so a file counts as a success exactly
    when :func:`read_light_curves` gives its rows.
    """
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, content, tic, sector in batch.itertuples(index=False):
                rows, error = None, None
                if pd.isna(tic):
                    error = "no target id in the file name"
                elif pd.isna(sector):
                    error = "no sector in the file name"
                else:
                    try:
                        rows = len(_decoded(bytes(content), fields or T.StructType())[0])
                    except (ValueError, KeyError) as problem:
                        error = f"unreadable: {problem}"
                out.append(("failed" if error else "success", name, tic, sector, rows, error))
            columns = ["status", "filename", "tic", "sector", "rows", "error"]
            frame = pd.DataFrame(out, columns=columns)
            yield frame.astype({"tic": "Int64", "sector": "Int64", "rows": "Int64"})

    bound_batches(files.sparkSession)
    return _with_ids(files).select("filename", "content", "TIC", "SECTOR").mapInPandas(check, STATUS_SCHEMA)


def decode_files(files: DataFrame, schema: str | T.StructType) -> DataFrame:
    """One row per file with its status, as in :func:`light_curve_status`, and its ``points`` as an array.

    For jobs that need both and read every file once. The array is as long as the file.
    """
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    out = T.StructType([*T.StructType.fromDDL(STATUS_SCHEMA).fields, T.StructField("points", T.ArrayType(fields))])

    def frame(held: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(held, columns=out.names).astype({"tic": "Int64", "sector": "Int64", "rows": "Int64"})

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            for name, content, tic, sector in batch.itertuples(index=False):
                error, points = None, None
                if pd.isna(tic) or pd.isna(sector):
                    error = f"no {'target id' if pd.isna(tic) else 'sector'} in the file name"
                else:
                    try:
                        columns = [c.tolist() for c in _decoded(bytes(content), fields)]
                        points = [dict(zip(fields.names, values)) for values in zip(*columns)]
                    except (ValueError, KeyError) as problem:
                        error = f"unreadable: {problem}"
                rows = None if points is None else len(points)
                held.append(("failed" if error else "success", name, tic, sector, rows, error, points))
                size += 1 + (rows or 0)
                if size >= _ROWS_PER_BATCH:
                    yield frame(held)
                    held, size = [], 0
        if held:
            yield frame(held)

    bound_batches(files.sparkSession)
    return _with_ids(files).select("filename", "content", "TIC", "SECTOR").mapInPandas(decode, out)


def read_headers(files: DataFrame) -> DataFrame:
    """Header cards of every HDU as rows; a damaged file gives the cards before the damage."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    for number, (cards, keys, _) in enumerate(_hdus(content.as_py())):
                        title = keys.get("EXTNAME", "PRIMARY" if number == 0 else "")
                        rows += [(name, number, title, *card) for card in cards]
                except (ValueError, KeyError):
                    pass
                while len(rows) >= _ROWS_PER_BATCH:
                    yield _card_batch(rows[:_ROWS_PER_BATCH])
                    rows = rows[_ROWS_PER_BATCH:]
        if rows:
            yield _card_batch(rows)

    bound_batches(files.sparkSession)
    return files.select("filename", "content").mapInArrow(scan, HEADER_SCHEMA)


def _card_batch(rows: list[tuple]) -> pa.RecordBatch:
    """Header rows as one batch under HEADER_SCHEMA."""
    file, hdu, *texts = zip(*rows)
    columns = [pa.array(file, pa.string()), pa.array(hdu, pa.int32()), *(pa.array(t, pa.string()) for t in texts)]
    return pa.RecordBatch.from_arrays(columns, ["file", "hdu", "hdu_name", "key", "value", "comment"])


def _with_ids(files: DataFrame) -> DataFrame:
    return files.withColumns(
        {"TIC": S.tic_from_name(F.col("filename")), "SECTOR": S.sector_from_name(F.col("filename"))}
    )
