"""Deeply nested records to flat, linked tables (problem 1).

One pass over each record: a depth-first visitor walks the parsed JSON and emits,
for every object that is an array element, a row tagged with its table, with its
own key, its parent's key and its payload.  The tag is the path without indexes
(``messages.entities``), so the emission can be written partitioned by tag and
each tag read back under its own schema.

The visitor keeps its own stack, so depth is bounded by memory and not by the
interpreter's recursion limit.  The operator is a narrow map: no shuffle, no
grouping, any record order.

Defined cases: a NULL, empty or invalid text gives no row; a text that is a JSON
string is parsed again as JSON (a quoted payload), any other scalar gives no row;
an array of scalars gives no row itself; arrays of arrays have chained indexes
(``a[0][1]``); for repeated member names the last one holds; repeated input rows
give repeated output rows; other input columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EMISSION = "field string, row_id bigint, tag string, path string, parent_path string, depth int, payload string"
_ARROW = pa.schema([("field", pa.string()), ("row_id", pa.int64()), ("tag", pa.string()), ("path", pa.string()), ("parent_path", pa.string()), ("depth", pa.int32()), ("payload", pa.string())])
ROOT = "$"


def _reject(token: str):
    raise ValueError(token)


_DECODER = json.JSONDecoder(parse_constant=_reject)


def parse_payload(text: str | None):
    """The JSON value of a text, quoted texts opened; None if there is none."""
    value = text
    while isinstance(value, str):
        body = value.strip(" \t\r\n")
        if not body or body[0] not in '{["':
            return None
        try:
            value, end = _DECODER.raw_decode(body)
        except ValueError:
            return None
        except RecursionError:
            return _deep_parse(body)
        if end != len(body):
            return None
    return value


_SCALAR = re.compile(r'"(?:[^"\\\x00-\x1f]|\\.)*"|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null')
_BLANK = re.compile(r"[ \t\r\n]*")


def _deep_parse(body: str):
    """A parser with its own stack, for texts nested beyond the recursion limit."""
    pos, stack, done, result = 0, [], False, None
    try:
        while True:
            pos = _BLANK.match(body, pos).end()
            if done and not stack:
                return result if pos == len(body) else None
            if done:
                box, key = stack[-1]
                box.append(result) if isinstance(box, list) else box.__setitem__(key, result)
                closing = "]" if isinstance(box, list) else "}"
                if body[pos] == closing:
                    result, pos = box, pos + 1
                    stack.pop()
                    continue
                if body[pos] != ",":
                    return None
                pos = _BLANK.match(body, pos + 1).end()
                done = False
                if isinstance(box, dict):
                    key, pos = _member(body, pos)
                    stack[-1] = (box, key)
                continue
            c = body[pos]
            if c in "[{":
                box = [] if c == "[" else {}
                pos = _BLANK.match(body, pos + 1).end()
                if body[pos] == ("]" if c == "[" else "}"):
                    result, pos, done = box, pos + 1, True
                elif c == "[":
                    stack.append((box, None))
                else:
                    key, pos = _member(body, pos)
                    stack.append((box, key))
            else:
                m = _SCALAR.match(body, pos)
                result, pos, done = json.loads(m.group()), m.end(), True
    except (AttributeError, IndexError, ValueError):
        return None


def _member(body: str, pos: int) -> tuple[str, int]:
    m = _SCALAR.match(body, pos)
    key = json.loads(m.group())
    pos = _BLANK.match(body, m.end()).end()
    if not isinstance(key, str) or body[pos] != ":":
        raise ValueError("member")
    return key, _BLANK.match(body, pos + 1).end()


def visit(value) -> Iterator[tuple[str, str, str, int, dict]]:
    """(tag, path, parent path, depth, object) of every object in an array, in document order."""
    stack = [(value, "", "", ROOT, 0, False)]
    while stack:
        node, path, tag, parent, depth, element = stack.pop()
        if isinstance(node, dict):
            if element:
                yield tag, path, parent, depth, node
                parent, depth = path, depth + 1
            for key in reversed(node):
                child = node[key]
                if isinstance(child, (dict, list)):
                    stack.append((child, f"{path}.{key}" if path else key, f"{tag}.{key}" if tag else key, parent, depth, False))
        elif isinstance(node, list):
            for i in range(len(node) - 1, -1, -1):
                child = node[i]
                if isinstance(child, (dict, list)):
                    stack.append((child, f"{path}[{i}]", tag or "[]", parent, depth, True))


def _emit(with_payload: bool, flush: int = 20_000):
    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in _ARROW]
            for field, row_id, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for tag, path, parent, depth, node in visit(parse_payload(text)):
                    for column, x in zip(out, (field, row_id, tag, path, parent, depth, own_json(node) if with_payload else None)):
                        column.append(x)
                if len(out[0]) >= flush:
                    yield _to_batch(out)
                    out = [[] for _ in _ARROW]
            if out[0]:
                yield _to_batch(out)

    return run


def _to_batch(columns: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)


class _Sign(str):
    """JSON text to be written as it is."""


def own_json(node: dict) -> str:
    """An object as JSON without what has rows of its own: objects in arrays, at whatever depth.

    So each value of a record is in one payload only, that of its nearest element.  An array
    of objects alone is left out; in one that holds other things too, objects are null.
    Nesting is bounded by memory, as for the visitor.
    """
    if not any(isinstance(v, (dict, list)) for v in node.values()):
        return json.dumps(node, ensure_ascii=False)
    out, stack = [], [node]
    while stack:
        x = stack.pop()
        if isinstance(x, _Sign):
            out.append(x)
        elif isinstance(x, dict):
            parts = [(k, v) for k, v in x.items() if not (isinstance(v, list) and v and _only_objects(v))]
            stack.append(_Sign("}"))
            for i in range(len(parts) - 1, -1, -1):
                k, v = parts[i]
                stack += [v, _Sign((", " if i else "") + json.dumps(k, ensure_ascii=False) + ": ")]
            stack.append(_Sign("{"))
        elif isinstance(x, list):
            stack.append(_Sign("]"))
            for i in range(len(x) - 1, -1, -1):
                stack.append(None if isinstance(x[i], dict) else x[i])
                if i:
                    stack.append(_Sign(", "))
            stack.append(_Sign("["))
        else:
            out.append(json.dumps(x, ensure_ascii=False))
    return "".join(out)


def _only_objects(values: list) -> bool:
    """Whether an array, or the arrays in it, hold objects and nothing else."""
    stack, found = list(values), False
    while stack:
        x = stack.pop()
        if isinstance(x, list):
            stack += x
        elif isinstance(x, dict):
            found = True
        else:
            return False
    return found


def tagged_emission(records: DataFrame, field: Column, row_id: Column, text: Column, payload: bool = True) -> DataFrame:
    """The single pass: one tagged row per nested object of ``text``.

    Texts that cannot hold an array of objects (no ``[`` or no ``{``, and not
    quoted) are left out before they reach Python.
    """
    slim = records.select(field.cast("string").alias("field"), row_id.cast("bigint").alias("row_id"), text.alias("text"))
    t = F.col("text")
    slim = slim.where((t.contains("[") & t.contains("{")) | t.rlike(r'^\s*"'))
    return slim.mapInArrow(_emit(payload), EMISSION)


def write_tables(emission: DataFrame, path: str) -> None:
    """Writes the emission partitioned by tag, one folder a table.

    Rows of a tag are spread over the tasks that emitted them, so a tag that holds
    most rows is no hot spot.
    """
    emission.write.mode("overwrite").partitionBy("tag").parquet(path)


def columns_of(emission: DataFrame) -> dict[str, list[str]]:
    """The scalar fields that occur in each tag's payloads: as many names come back as there are fields, whatever the rows."""
    pairs = emission.select("tag", F.explode(F.from_json("payload", "map<string,string>")).alias("field_name", "value")).where(~F.col("value").rlike(r"^[\[{]"))
    out: dict[str, list[str]] = {}
    for r in pairs.select("tag", "field_name").distinct().collect():
        out.setdefault(r["tag"], []).append(r["field_name"])
    return {tag: sorted(names) for tag, names in sorted(out.items())}


def flat_table(emission: DataFrame, tag: str, schema: T.StructType | str) -> DataFrame:
    """One child table under its schema: keys, then the payload's fields."""
    rows = emission.where(F.col("tag") == tag)
    return rows.select("field", "row_id", "path", "parent_path", F.from_json("payload", schema).alias("fields")).select("field", "row_id", "path", "parent_path", "fields.*")
