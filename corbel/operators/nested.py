"""Deeply nested records to related flat tables, in one tagged pass.

A depth-first visitor walks each record once along a tree of `Level`s and emits
one row per object found: the tag of its table, its key, the key of its parent,
its places on the way down and its own scalar fields. The rows are written
partitioned by tag, so each flat table is read back alone, with its schema
applied to the payload.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stage_path

INVALID = "_invalid"

EMITTED = T.StructType(
    [
        T.StructField("record_id", T.LongType()),
        T.StructField("key", T.StringType()),
        T.StructField("parent_key", T.StringType()),
        T.StructField("places", T.ArrayType(T.IntegerType())),
        T.StructField("name", T.StringType()),
        T.StructField("payload", T.StringType()),
        T.StructField("tag", T.StringType()),
    ]
)

_ARROW = pa.schema(
    [
        ("record_id", pa.int64()),
        ("key", pa.string()),
        ("parent_key", pa.string()),
        ("places", pa.list_(pa.int32())),
        ("name", pa.string()),
        ("payload", pa.string()),
        ("tag", pa.string()),
    ]
)


@dataclass(frozen=True)
class Level:
    """An array of objects below its parent: where it is, and its flat table's tag."""

    field: str
    tag: str
    below: tuple[Level, ...] = ()


def _no_constant(text: str):
    raise ValueError(f"{text} is not JSON")


def _whole(text: str):
    """A whole number; one too long for Python stays as it is written."""
    return int(text) if len(text) < 4000 else text


def _real(text: str):
    """A number; one too large for a double stays as it is written."""
    number = float(text)
    return number if math.isfinite(number) else text


def _parsed(text: str):
    return json.loads(text, parse_constant=_no_constant, parse_int=_whole, parse_float=_real)


# As deep as records are read; what lies deeper is kept as its text.
DEEPEST = 200
_MARK = re.compile(r'"(?:[^"\\]|\\.)*+"|[\[\]{}]', re.S)


def _shallow(text: str) -> str:
    """The record with every value that is nested deeper than DEEPEST as its text.

    Each layer of DEEPEST levels is checked by itself, from the innermost one, so
    that no depth is too much and what is no JSON is a ValueError as ever.
    """
    layers: list[tuple[int, list[str]]] = [(0, [])]  # where each begins, and its text so far
    level = at = 0
    for m in _MARK.finditer(text):
        if m[0] in "[{":
            if level and level % DEEPEST == 0:
                layers[-1][1].append(text[at : m.start()])
                at = m.start()
                layers.append((at, []))
            level += 1
        elif m[0] in "]}":
            level -= 1
            if level < 0:
                raise ValueError("a bracket too many")
            if level and level % DEEPEST == 0:
                start, parts = layers.pop()
                json.loads("".join(parts) + text[at : m.end()], parse_constant=_no_constant, parse_int=_whole)
                at = m.end()
                layers[-1][1].append(json.dumps(text[start:at]) if len(layers) == 1 else "null")
    if len(layers) > 1:
        raise ValueError("a bracket is open")
    return "".join(layers[0][1]) + text[at:]


def _clean(text: str) -> str:
    """Lone surrogates from escapes can't be stored; each becomes U+FFFD."""
    try:
        text.encode()
        return text
    except UnicodeEncodeError:
        return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _items(value) -> list:
    """An array's elements; a bare object is an array of one; all else is empty."""
    return value if isinstance(value, list) else [value] if isinstance(value, dict) else []


def _visit(node: dict, key: str, places: tuple, levels: tuple[Level, ...], emit) -> None:
    for level in levels:
        for pos, item in enumerate(_items(node.get(level.field))):
            if not isinstance(item, dict):
                continue
            own = f"{key}/{level.tag}.{pos}"
            at = (*places, pos)
            name = item.get("name")
            inner = {b.field for b in level.below}
            scalar = {k: v for k, v in item.items() if k not in inner and v is not None}
            emit(own, key, at, _clean(name) if isinstance(name, str) else None, scalar, level.tag)
            _visit(item, own, at, level.below, emit)


def _visitor(levels: tuple[Level, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in _ARROW]
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for rid, text in zip(ids, texts):
                text = text.as_py()
                root = "null" if rid is None else str(rid)

                def emit(key, parent, places, name, scalar, tag, rid=rid):
                    payload = json.dumps(scalar, ensure_ascii=True) if scalar is not None else None
                    for to, value in zip(rows, (rid, key, parent, places, name, payload, tag)):
                        to.append(value)

                if text is None:
                    continue
                before = len(rows[0])
                try:
                    try:
                        record = text if isinstance(text, dict) else _parsed(text)
                    except RecursionError:
                        record = _parsed(_shallow(text))
                    if isinstance(record, dict):
                        _visit(record, root, (), levels, emit)
                except ValueError:
                    for to in rows:
                        del to[before:]
                    emit(root, None, (), None, None, INVALID)
                if len(rows[0]) >= 20_000:
                    yield _batch(rows)
                    for to in rows:
                        to.clear()
            yield _batch(rows)

    return run


def _batch(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(r, f.type) for r, f in zip(rows, _ARROW)], schema=_ARROW)


class FlatTables:
    """The flat tables of one pass, stored by tag in the shared folder."""

    def __init__(self, spark, path: str):
        self._spark, self.path = spark, path

    def rows(self, *tags: str) -> DataFrame:
        """The rows of some tags; only their folders are read."""
        return self._spark.read.schema(EMITTED).parquet(self.path).where(F.col("tag").isin(*tags))

    def table(self, tag: str, schema: str) -> DataFrame:
        """One flat table, with the schema applied to its payload.

        A field that is absent or of another type is null.
        """
        fields = T._parse_datatype_string(schema).fields
        df = self.rows(tag)
        typed = [_as(F.get_json_object("payload", f"$['{f.name}']"), f).alias(f.name) for f in fields]
        return df.select("record_id", "key", "parent_key", "places", *typed)


def _as(text: Column, field: T.StructField) -> Column:
    return text if isinstance(field.dataType, T.StringType) else text.try_cast(field.dataType)


def flatten_records(df: DataFrame, record_id: str, record: Column, levels: tuple[Level, ...]) -> FlatTables:
    """Flatten `record` of each row of df, a JSON text or a struct, along `levels`.

    Nulls: a null record gives no row; a null record id is kept as null. Invalid
    JSON gives one row of the tag `_invalid` and no other; records of any depth are
    read, numbers beyond a double or 4,000 digits keep their text; an object where an
    array is expected counts as an array of one; elements that are no objects
    give no row but keep their place; an empty input gives empty tables. Other
    columns of df are ignored, whatever their names.
    """
    spark = df.sparkSession
    path = stage_path(spark, "flat")
    pairs = df.select(F.col(record_id).cast("long").alias("record_id"), record.alias("record"))
    pairs.mapInArrow(_visitor(levels), EMITTED).write.partitionBy("tag").parquet(path)
    return FlatTables(spark, path)
