"""Nested records to related flat tables.

Each JSON record is read as a stream of tokens, one step per token, whatever its depth.
A leaf is a path-value-ordinal triple; what is kept of its path is its innermost repeated
ancestor (array element, map entry or named entity), which is the row it belongs to, and
the name below that, which is its column. Both are at hand when the leaf is read, so that
a record is pivoted while it is read, where it lies: flattening needs no shuffle, and each
group of rows under one repeated ancestor is a table of its own (`entity_table`).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_FIELDS = pa.map_(pa.string(), pa.string())
_OUT = [("entity", pa.string()), ("depth", pa.int32()), ("node", pa.int32()), ("parent", pa.int32()), ("parent_entity", pa.string()), ("key", pa.string()), ("parent_key", pa.string()), ("fields", _FIELDS), ("root", _FIELDS)]
_DDL = "entity string, depth int, node int, parent int, parent_entity string, key string, parent_key string, fields map<string,string>, root map<string,string>"
#: The entity of a row that stands for a record that can't be read.
UNREADABLE = "@unreadable"

#: A token: a string without escapes, a mark, a number, a word, or the start of another string.
_TOKEN = re.compile(r"""[ \t\n\r]*(?:"([^"\\\x00-\x1f]*)"|([{}\[\]:,])|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)|(true|false|null)|("))""").match
_END = re.compile(r"[ \t\n\r]*\Z").match
_SURROGATE = re.compile("[\ud800-\udfff]")


class _Node:
    """A row in the making."""

    __slots__ = ("entity", "depth", "number", "parent", "fields")

    def __init__(self, entity: str, depth: int, number: int, parent: _Node | None) -> None:
        self.entity, self.depth, self.number, self.parent = entity, depth, number, parent
        self.fields: dict[str, str | None] = {}


class _Reader:
    """Reads a record's nodes. A frame of the stack is an open object or array: (is it an
    array, the node that its scalars belong to, its name in that node, the names that
    make up this one). The stack is explicit: depth costs no recursion."""

    def __init__(self, entities: frozenset[str], embedded: frozenset[str], entry: re.Pattern | None) -> None:
        self.entities, self.embedded, self.entry = entities, embedded, entry

    def read(self, text: str) -> list[_Node]:
        """The record's nodes in document order; ValueError if it isn't JSON."""
        nodes = [_Node("", 0, 0, None)]
        self._value(text, nodes, nodes[0], "", frozenset())
        return nodes

    def _open(self, nodes: list[_Node], entity: str, parent: _Node) -> _Node:
        n = _Node(entity, parent.depth + 1, len(nodes), parent)
        nodes.append(n)
        return n

    def _value(self, text: str, nodes: list[_Node], node: _Node, name: str, names: frozenset[str]) -> None:
        """Adds what `text`, one JSON value, holds to `node` under `name`."""
        at, stack = 0, []
        key = None  # of the member that is read; None before a key, and within arrays
        inside, names_now = name, names  # the open object's or array's name in its node
        array = False
        expect = "value"
        entities, embedded, entry, opened = self.entities, self.embedded, self.entry, self._open
        while True:
            m = _TOKEN(text, at)
            if m is None:
                raise ValueError(f"no token at {at}")
            kind, at = m.lastindex, m.end()
            token = m.group(kind)
            if kind == 5:
                token, at = scanstring(text, at, True)
                if _SURROGATE.search(token):
                    token = _SURROGATE.sub("�", token)
                kind = 1
            if expect[0] == "k":  # a key, or the end of an empty object
                if kind == 1:
                    key, expect = token, ":"
                    continue
                if token != "}" or expect != "key or }":
                    raise ValueError(f"no key at {at}")
            elif expect == ":":
                if token != ":" or kind != 2:
                    raise ValueError(f"no colon at {at}")
                expect = "value"
                continue
            elif expect == ",":
                if kind == 2 and token == ",":
                    expect = "value" if array else "key"
                    continue
                if kind != 2 or token != ("]" if array else "}"):
                    raise ValueError(f"no comma at {at}")
            elif kind == 2 and token not in ("{", "["):  # a value is due
                if token != "]" or expect != "value or ]":
                    raise ValueError(f"no value at {at}")
            if kind == 2 and token in ("}", "]"):
                array, node, inside, names_now = stack.pop()
                if not stack:
                    break
                expect = ","
                continue
            # a value begins: where it belongs
            if array:
                owner, label, below = opened(nodes, inside or "[]", node), "", frozenset()
            elif key is None:
                owner, label, below = node, inside, names_now
            elif key in embedded and (token == "{" and kind == 2 or kind == 1 and self._embed(token, nodes, node, inside, names_now, key)):
                if kind == 1:
                    expect = ","
                    continue
                owner, label, below = node, inside, names_now
            elif entry is not None and entry.match(key):
                owner, label, below = opened(nodes, inside or "[]", node), "", frozenset()
                owner.fields["@key"] = key
            elif key in entities and not (kind == 2 and token == "["):
                if token == "null" and kind == 4:
                    expect = ","
                    continue
                owner, label, below = opened(nodes, key, node), "", frozenset()
            elif kind == 2 and token == "{" and key in names_now:  # a record within its like
                owner, label, below = opened(nodes, key, node), "", frozenset()
            else:
                owner, label, below = node, f"{inside}.{key}" if inside else key, names_now
            if kind == 2:
                stack.append((array, node, inside, names_now))
                if token == "{":
                    below = below if key is None or array or not label else below | {key}
                    array, node, inside, names_now, key, expect = False, owner, label, below, None, "key or }"
                else:
                    label = key if key is not None and not array and label else label.rpartition(".")[2]  # its elements are called by its own name
                    array, node, inside, names_now, key, expect = True, owner, label, below, None, "value or ]"
                continue
            if kind == 1 or kind == 3:
                owner.fields[label or "@value"] = token
            elif token != "null":
                owner.fields[label or "@value"] = token
            elif label:
                owner.fields[label] = None
            if not stack:
                break
            expect = ","
        if _END(text, at) is None:
            raise ValueError(f"more text at {at}")

    def _embed(self, text: str, nodes: list[_Node], node: _Node, inside: str, names: frozenset[str], key: str) -> bool:
        """Takes a text that is JSON for its content; False if it isn't JSON. Texts in
        texts double their escapes, so they can't nest deeply."""
        have, fields = len(nodes), dict(node.fields)
        try:
            if text.lstrip(" \t\n\r")[:1] == "{":
                self._value(text, nodes, node, inside, names)
            else:
                self._value(text, nodes, node, f"{inside}.{key}" if inside else key, names)
        except ValueError:
            del nodes[have:]
            node.fields = fields
            return False
        return True


def _identity(n: _Node, key: str) -> str | None:
    f = n.fields
    return f.get(key, f.get("@value", f.get("@key")))


def flatten_records(
    df: DataFrame,
    record: str,
    keep: list[str],
    key: str,
    entities: list[str] = (),
    embedded: list[str] = (),
    entry: str | None = None,
    inherit: list[str] = (),
    unreadable: bool = False,
) -> DataFrame:
    """One row per node of each JSON text in `record`: the record's root and every
    array element, map entry or named entity below it, at any depth. An object within
    one of the same name, that is no entity, is a node too.

    Columns: `keep`; entity (name of the array or entity, '' for the root, '[]' without
    one); depth (repeated ancestors); node and parent (numbers within the record);
    parent_entity; key and parent_key (the field `key` of the node and of its parent; a
    bare value is its own key); fields (the node's scalars as text as written, nested
    objects as dotted names, a map entry's name as @key); root (the root's fields named
    in `inherit`). A text under a name of `embedded` that is JSON stands for its content.

    Null records give no rows, an empty object gives its root; repeated records are kept.
    Texts that aren't JSON (RFC 8259) give no rows, or with `unreadable` one row each with
    entity '@unreadable' and the field `reason`. Of several members of one name the last
    scalar counts. Names in `keep` that clash with a column above are an error."""
    clash = {n for n, _ in _OUT} & set(keep)
    if clash:
        raise ValueError(f"columns {sorted(clash)} clash with the result's")
    options = (frozenset(entities), frozenset(embedded), re.compile(entry) if entry else None)
    inherited = frozenset(inherit)
    source = df.where(F.col(f"`{record}`").isNotNull()).select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{record}`").alias("__record"))
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(*options)
        for batch in batches:
            at: list[int] = []
            rows: list[tuple] = []
            for i, text in enumerate(batch.column(n).to_pylist()):
                try:
                    nodes = reader.read(text)
                except ValueError as e:
                    if unreadable:
                        at.append(i)
                        rows.append((UNREADABLE, 0, 0, None, None, None, None, [("reason", str(e))], []))
                    continue
                root = [(k, v) for k, v in nodes[0].fields.items() if k in inherited]
                at.extend([i] * len(nodes))
                for x in nodes:
                    up = x.parent
                    above = (None, None, None) if up is None else (up.number, up.entity, _identity(up, key))
                    rows.append((x.entity, x.depth, x.number, above[0], above[1], _identity(x, key), above[2], list(x.fields.items()), root))
            kept = batch.select(range(n)).take(pa.array(at, pa.int32()))
            cols = list(zip(*rows)) if rows else [[]] * len(_OUT)
            arrays = [*kept.columns, *[pa.array(c, t) for c, (_, t) in zip(cols, _OUT)]]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *[x for x, _ in _OUT]])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:n])
    return source.mapInArrow(run, f"{kept}, {_DDL}" if kept else _DDL)


def entity_columns(nodes: DataFrame) -> DataFrame:
    """(entity, field, type, n_rows): the columns of each entity's table, with the
    narrowest of bigint, double, boolean and string that takes all of its values; a field
    of nulls only is a string. One line per entity and field."""
    f = nodes.select("entity", F.explode("fields").alias("field", "value"))
    fits = lambda t: F.bool_and(F.col("value").isNull() | F.col("value").try_cast(t).isNotNull())
    boolean = F.bool_and(F.col("value").isNull() | F.col("value").isin("true", "false"))
    kind = F.when(F.max("value").isNull(), "string").when(boolean, "boolean").when(fits("bigint") & ~F.bool_or(F.coalesce(F.col("value").rlike("[.eE]"), F.lit(False))), "bigint").when(fits("double"), "double").otherwise("string")
    return f.groupBy("entity", "field").agg(kind.alias("type"), F.count("*").alias("n_rows"))


def entity_table(nodes: DataFrame, entity: str, columns: dict[str, str], keep: list[str] = ()) -> DataFrame:
    """The table of one entity: `keep`, node, parent, parent_entity, parent_key, and its
    fields as typed columns (names with dots replaced by '_'; a value that doesn't fit the
    type is null). Columns are those of entity_columns or chosen ones."""
    taken = [*keep, "node", "parent", "parent_entity", "parent_key"]
    names = [c.replace(".", "_").replace("@", "") for c in columns]
    clash = {x for x in names if names.count(x) > 1 or x in taken}
    if clash:
        raise ValueError(f"columns {sorted(clash)} clash")
    fields = [F.col("fields")[c].try_cast(t).alias(n) for n, (c, t) in zip(names, columns.items())]
    return nodes.where(F.col("entity") == entity).select(*[F.col(f"`{c}`") for c in keep], "node", "parent", "parent_entity", "parent_key", *fields)
