"""Deeply nested records into related flat tables, by shared inlining (problem 5).

First pass: each partition reduces its JSON texts to the edges of the schema graph
(which element holds which, in what form and how often), and a small aggregate joins
them.  The driver analyses the graph, whose size follows the number of labels and not
the data: elements that occur once under one parent are inlined; repeated, shared and
recursive elements get tables.  Second pass: each text is walked once and yields its
records with keys of their parents.  Neither pass shuffles the texts.  One pass gives the
records of all tables; Shredded.store() writes them all at once.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Callable, Collection, Iterator, Mapping
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edges that a schema graph may have; more means that keys are data of an unknown form.
MAX_EDGES = 20_000
#: Nesting beyond which a text counts as unreadable.
MAX_DEPTH = 200
REJECTED = "_rejected"
_FENCE = re.compile(r"^```[A-Za-z]*\s*|\s*```$")


def read_json(text: str | None) -> Any:
    """The JSON value of a text that may have a byte-order mark, code fences or stray text
    around its object; None if there is none.  Of repeated keys the last counts."""
    if text is None:
        return None
    s = text.strip().lstrip("﻿").strip()
    tries = (lambda: s, lambda: _FENCE.sub("", s), lambda: s[s.index("{") : s.rindex("}") + 1])
    for t in tries:
        try:
            return json.loads(t())
        except (ValueError, RecursionError):
            continue
    return None


def _root(value: Any) -> dict | None:
    """The record of a text: an object, freed of wrappers that hold one object and nothing else."""
    for _ in range(MAX_DEPTH):
        if isinstance(value, dict) and len(value) == 1 and isinstance(inner := next(iter(value.values())), dict) and any(not isinstance(x, dict) for x in inner.values()):
            value = inner
        else:
            break
    return value if isinstance(value, dict) else None


def _opened(value: Any) -> Any:
    """A string that holds a JSON list or object, as that."""
    if isinstance(value, str) and value[:1] in "[{" and value[-1:] in "]}":
        try:
            inner = json.loads(value)
        except (ValueError, RecursionError):
            return value
        return inner if isinstance(inner, list | dict) else value
    return value


def _kind(value: Any) -> str:
    """Name of a scalar's type; a whole number that no bigint holds is a text."""
    return "str" if isinstance(value, int) and not -(2**63) <= value < 2**63 else type(value).__name__


def _looks_keyed(obj: dict) -> bool | None:
    """Whether an object's keys are data: several entries, all objects of a shape.  None: can't tell."""
    entries = [x for x in obj.values() if x is not None]
    if not entries:
        return None
    if not all(isinstance(x, dict) for x in entries):
        return False
    if len(entries) < 2:
        return None
    return bool(set.intersection(*map(set, entries)))


class _Edges:
    """Counts of (parent, child, form) of the texts seen: occurrences and largest number at once."""

    def __init__(self) -> None:
        self.n: dict[tuple[str, str, str], list[int]] = defaultdict(lambda: [0, 0])

    def add(self, parent: str, child: str, form: str, many: int = 1) -> None:
        e = self.n[parent, child, form]
        e[0] += 1
        e[1] = max(e[1], many)

    def record(self, label: str, obj: dict, via: str, depth: int = 0) -> None:
        if depth > MAX_DEPTH:
            raise RecursionError
        self.add(label, "", f"entry:{via}")
        for key, raw in obj.items():
            self.child(label, key, _opened(raw), via, depth)

    def child(self, label: str, key: str, value: Any, via: str, depth: int) -> None:
        if value is None:
            self.add(label, key, f"null:{via}")
        elif isinstance(value, dict):
            keyed = _looks_keyed(value)
            if keyed:
                self.add(label, key, "keyed", len(value))
                for x in value.values():
                    if x is not None:
                        self.record(key, x, "keyed", depth + 1)
            else:
                self.add(label, key, "single" if keyed is None else "object")
                self.record(key, value, "single" if keyed is None else "object", depth + 1)
        elif isinstance(value, list):
            self.add(label, key, "list", len(value))
            for x in map(_opened, value):
                if isinstance(x, dict):
                    self.record(key, x, "list", depth + 1)
                elif x is not None:
                    self.add(key, "value", f"{_kind(x)}:list")
        else:
            self.add(label, key, f"{_kind(value)}:{via}")


@dataclass
class Layout:
    """Which labels are tables, which of them are keyed by data, and each table's columns."""

    tables: set[str] = field(default_factory=set)
    keyed: set[str] = field(default_factory=set)
    key_attribute: dict[str, str] = field(default_factory=dict)
    #: by table and path of an attribute below the table's records (parts divided by "/") its type
    columns: dict[str, dict[str, str]] = field(default_factory=dict)


ROOT = "$"
_TYPES = {frozenset(["int"]): "bigint", frozenset(["float"]): "double", frozenset(["int", "float"]): "double", frozenset(["bool"]): "boolean"}


#: Share of the entries in list form in which the attribute that holds their key must be a text.
KEY_SHARE = 0.9


def analyse(edges: list[tuple[str, str, str, int, int]]) -> Layout:
    """Shared inlining on the schema graph.

    edges: parent, child, form, occurrences, most at once.
    """
    forms: dict[str, dict[str, int]] = defaultdict(lambda: defaultdict(int))  # container forms by label
    for _, child, form, n, _ in edges:
        if form in ("keyed", "single", "object", "list"):
            forms[child][form] += n
    keyed = {c for c, f in forms.items() if f["keyed"] > f["object"]}
    lists = {c for c, f in forms.items() if f["list"]}
    live = [e for e in edges if not (e[0] in keyed and e[2] in ("single", "object", "keyed"))]
    parents: dict[str, set[str]] = defaultdict(set)
    children: dict[str, set[str]] = defaultdict(set)
    for parent, child, form, _, _ in live:
        if form in ("keyed", "single", "object", "list"):
            parents[child].add(parent)
            children[parent].add(child)
    reach: dict[str, set[str]] = {}
    for label in {ROOT, *children}:
        seen, todo = set(), list(children[label])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo.extend(children[x])
        reach[label] = seen
    there = reach[ROOT]
    tables = {c for c in there if c in keyed or c in lists or len(parents[c] & ({ROOT} | there)) > 1 or c in reach.get(c, ())}
    key_attribute = {}
    for label in tables & keyed:
        counts = {form.split(":")[1]: n for p, c, form, n, _ in edges if p == label and form.startswith("entry:")}
        in_list = {c: n for p, c, form, n, _ in edges if p == label and form == "str:list"}
        in_keyed = {c for p, c, form, _, _ in edges if p == label and c and form.endswith(":keyed")}
        # the most frequent; entries that lack it keep their position
        names = sorted((-n, c) for c, n in in_list.items() if n >= KEY_SHARE * counts.get("list", 0) and c not in in_keyed)
        if names:
            key_attribute[label] = names[0][1]
    layout = Layout(tables, keyed & tables, key_attribute)

    def columns(label: str, prefix: str, into: dict[str, set[str]], seen: frozenset[str]) -> None:
        for parent, child, form, _, _ in live:
            if parent != label or not child:
                continue
            if ":" in form:
                kind = form.split(":")[0]
                if kind != "null" and child not in tables:
                    into[prefix + _escaped(child)].add(kind)
            elif child not in tables and child not in seen:
                columns(child, f"{prefix}{_escaped(child)}/", into, seen | {child})

    for label in {ROOT, *tables}:
        into: dict[str, set[str]] = defaultdict(set)
        columns(label, "", into, frozenset([label]))
        layout.columns[label] = {c: _TYPES.get(frozenset(k), "string") for c, k in sorted(into.items())}
    return layout


def _text(value: Any) -> str | None:
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value, ensure_ascii=False)


def _escaped(name: str) -> str:
    """A name as one part of a path, so that a key "a/b" is not b inside of a."""
    return name.replace("~", "~0").replace("/", "~1") if "~" in name or "/" in name else name


class _Walker:
    """Records of texts as columns: table, parent's key, key and, unless only keys are wanted, parent's table and row, row, attributes."""

    def __init__(self, layout: Layout, wanted: frozenset[str] | None = None) -> None:
        self.layout, self.wanted = layout, wanted
        self.table: list[str] = []
        self.up_key: list[str] = []
        self.key: list[str] = []
        self.up_table: list[str | None] = []
        self.up_row: list[str | None] = []
        self.row: list[str] = []
        #: where each record's attributes begin, and all of them one after another
        self.starts: list[int] = []
        self.names: list[str] = []
        self.values: list[str | None] = []

    def undo(self, n: int) -> None:
        """Forget what came after the first ``n`` records."""
        if n < len(self.starts):
            del self.names[self.starts[n] :], self.values[self.starts[n] :]
        for c in (self.table, self.up_key, self.key, self.up_table, self.up_row, self.row, self.starts):
            del c[n:]

    def record(self, label: str, up: tuple[str | None, str | None, str], row: str, key: str, value: Any) -> None:
        if self.wanted is None or label in self.wanted:
            self.table.append(label)
            self.up_key.append(up[2])
            self.key.append(key)
        later: list[tuple[str, Any, tuple[str, ...]]] = []
        if self.wanted is None:
            self.up_table.append(up[0])
            self.up_row.append(up[1])
            self.row.append(row)
            self.starts.append(len(self.names))
            if not isinstance(value, dict | list):
                self.names.append("value")
                self.values.append(_text(value))
        if isinstance(value, dict):
            self.visit(value, (), later)
        elif isinstance(value, list):  # a list straight in a list: records below this one
            later.append((label, value, ()))
        # a record's own attributes stand together, so its children come after them
        for name, x, path in later:
            self.children(name, label, row, key, x, path)

    def visit(self, obj: dict, path: tuple[str, ...], later: list[tuple[str, Any, tuple[str, ...]]]) -> None:
        tables, full = self.layout.tables, self.wanted is None
        for name, raw in obj.items():
            value = _opened(raw)
            if name in tables:
                later.append((name, value, path))
            elif isinstance(value, dict):
                self.visit(value, (*path, name), later)
            elif full:
                self.names.append("/".join(map(_escaped, (*path, name))) if path else _escaped(name))
                self.values.append(_text(value))

    def children(self, name: str, label: str, row: str, key: str, value: Any, path: tuple[str, ...]) -> None:
        """Null entries are no records but keep their position; a lone value has position 0.

        path: the inlined elements between the row and the entries, part of the new rows' keys.
        """
        own = self.layout.key_attribute.get(name)
        if value is None or value == "":
            return
        if isinstance(value, list):
            entries = [(str(i), _opened(x)) for i, x in enumerate(value)]
        elif isinstance(value, dict) and name in self.layout.keyed and not (own in value and isinstance(value[own], str)):
            entries, own = [(k, _opened(x)) for k, x in value.items()], None
        else:
            entries = [("0", value)]
        for at, x in entries:
            if x is None:
                continue
            k = x[own] if own and isinstance(x, dict) and isinstance(x.get(own), str) else at
            below = "/".join((row, *path, f"{name}[{at}]")) if self.wanted is None else ""
            self.record(name, (label, row, "" if label == ROOT else key), below, k, x)


@dataclass
class Shredded:
    layout: Layout
    #: doc_key, doc_row, child, parent, parent_row, row, parent_key, child_key, attributes
    records: DataFrame
    #: doc_key, child, parent_key, child_key of the given tables, by a walk that makes nothing else
    keys: Callable[[Collection[str]], DataFrame]

    def table(self, label: str) -> DataFrame:
        """One flat table: doc_key, doc_row, row, parent, parent_row, parent_key, child_key and its columns.

        A column is named by its path with underscores; if that name is taken (case does not
        count), the label goes before it, so no value is lost.  doc_row tells source rows of
        one doc_key apart; it follows the order of files and rows.  (doc_row, parent,
        parent_row) refers to doc_row and row of that parent's table; the root's table is "$".
        """
        own = ["doc_key", "doc_row", "row", "parent", "parent_row", "parent_key", "child_key"]
        taken, columns = set(own), []
        for path, kind in self.layout.columns.get(label, {}).items():
            out = path.replace("/", "_").replace("~1", "/").replace("~0", "~")
            while out.lower() in taken:
                out = f"{label}_{out}"
            taken.add(out.lower())
            columns.append(F.try_element_at("attributes", F.lit(path)).try_cast(kind).alias(out))
        return self.records.where(F.col("child") == label).select(*own, *columns)

    def store(self, path: str) -> Shredded:
        """All records written by one pass, in a folder a table, and the same tables over what was written."""
        self.records.write.mode("overwrite").partitionBy("child").parquet(path)
        spark = self.records.sparkSession
        stored = spark.read.schema(self.records.schema).parquet(path)
        return Shredded(self.layout, stored, lambda labels: stored.where(F.col("child").isin(*labels)).select("doc_key", "child", "parent_key", "child_key"))


def schema_edges(df: DataFrame, json_col: str) -> list[tuple[str, str, str, int, int]]:
    """Edges of the schema graph of all texts; at most MAX_EDGES, else an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = _Edges()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                obj, own = _root(read_json(text)), _Edges()
                if obj is None:
                    continue
                try:
                    own.record(ROOT, obj, "object")
                except RecursionError:
                    continue
                for k, (n, m) in own.n.items():
                    e = total.n[k]
                    e[0], e[1] = e[0] + n, max(e[1], m)
        rows = [(*k, *v) for k, v in total.n.items()]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
        kinds = [pa.string()] * 3 + [pa.int64()] * 2
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["parent", "child", "form", "n", "most"])

    raw = df.select(F.col(f"`{json_col}`")).mapInArrow(run, "parent string, child string, form string, n bigint, most bigint")
    rows = raw.groupBy("parent", "child", "form").agg(F.sum("n").alias("n"), F.max("most").alias("most")).limit(MAX_EDGES + 1).collect()
    if len(rows) > MAX_EDGES:
        raise ValueError(f"the schema graph has more than {MAX_EDGES} edges")
    return [tuple(r) for r in rows]


def shred(df: DataFrame, id_col: str, json_col: str) -> Shredded:
    """Related flat tables of the JSON texts of ``df``.

    Null, empty and blank texts have no records.  A text without a readable object, or
    nested too deeply, is one record of the table "_rejected" with the text in its
    attributes, so none is lost.  Rows with the same id (also null) keep their own
    records.  Other columns are not read.  An empty table gives an empty layout.
    """
    layout = analyse(schema_edges(df, json_col))
    source = df.select(F.col(f"`{id_col}`").alias("doc_key"), F.col(f"`{json_col}`").alias("json"))
    kind = df.schema[id_col].dataType.simpleString()

    def walker(wanted: frozenset[str] | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                # a slice at a time: a text's records take several times its room
                for start in range(0, batch.num_rows, 500):
                    part = batch.slice(start, 500)
                    w, ids = _Walker(layout, wanted), []
                    for i, text in enumerate(part.column(1).to_pylist()):
                        if text is None or not text.strip():
                            continue
                        obj, n = _root(read_json(text)), len(w.table)
                        try:
                            if obj is None:
                                raise RecursionError
                            w.record(ROOT, (None, None, ""), ROOT, "", obj)
                        except RecursionError:
                            w.undo(n)
                            w.record(REJECTED, (None, None, ""), ROOT, "", text)
                            if wanted is None:
                                w.names[-1] = "text"
                        ids.extend([i] * (len(w.table) - n))
                    if not ids:
                        continue
                    at, string = pa.array(ids, pa.int64()), pa.string()
                    columns = {"doc_key": part.column(0).take(at)}
                    if wanted is None:
                        columns |= {"doc_row": part.column(2).take(at)}
                    columns |= {"child": pa.array(w.table, string)}
                    if wanted is None:
                        columns |= {"parent": pa.array(w.up_table, string), "parent_row": pa.array(w.up_row, string), "row": pa.array(w.row, string)}
                    columns |= {"parent_key": pa.array(w.up_key, string), "child_key": pa.array(w.key, string)}
                    if wanted is None:
                        offsets = pa.array([*w.starts, len(w.names)], pa.int32())
                        columns |= {"attributes": pa.MapArray.from_arrays(offsets, pa.array(w.names, string), pa.array(w.values, string))}
                    yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

        return run

    full = f"doc_key {kind}, doc_row bigint, child string, parent string, parent_row string, row string, parent_key string, child_key string, attributes map<string,string>"
    records = source.withColumn("doc_row", F.monotonically_increasing_id()).mapInArrow(walker(None), full)
    return Shredded(layout, records, lambda labels: source.mapInArrow(walker(frozenset(labels)), f"doc_key {kind}, child string, parent_key string, child_key string"))


def child_keys(shredded: Shredded, names: Mapping[str, str]) -> DataFrame:
    """Every record of the tables in ``names`` (label -> name to give): doc_key, child, parent_key, child_key."""
    name = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return shredded.keys(list(names)).select("doc_key", F.element_at(name, F.col("child")).alias("child"), "parent_key", "child_key")
