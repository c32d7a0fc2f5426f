"""Deeply nested semi-structured records to related flat tables (problem 1).

A depth-first traversal gives every named node of a record its pre-order and post-order number; node
tables per kind come out, and parents are found by interval containment. The shape of each level
(lists, keyed objects, single objects, wrapped or doubly encoded JSON, bare names) is declared, not coded.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from json.decoder import scanstring

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kind:
    """One level of a nested record.

    names: alternatives of the naming fields; two fields name a pair (an edge). own: further fields that an
    object of this kind may have, which tell an object without a name from a collection keyed by name.
    number: the name is a whole number. holds: nested field -> kind.
    """

    kind: str
    names: tuple[tuple[str, ...], ...]
    own: frozenset[str] = frozenset()
    number: bool = False
    holds: dict[str, Kind] = field(default_factory=dict)

    @property
    def pair(self) -> bool:
        return len(self.names[0]) == 2

    def fields(self) -> set[str]:
        return {f for alt in self.names for f in alt} | self.own | set(self.holds)


EVIDENCE = Kind("evidence", (("page",),), frozenset({"table_id", "quote"}), number=True)
SECTION = Kind("section", (("section",),), frozenset({"weight"}), holds={"evidence": EVIDENCE})
STAGE = Kind(
    "stage",
    (("stage",),),
    frozenset({"probability", "threshold", "selected", "in_ground_truth", "val_f1", "val_support"}),
    holds={"sections": SECTION},
)
EDGE = Kind("edge", (("src", "dst"), ("from_type", "to_type")), frozenset({"support", "score"}))
TRACE_SHAPE = {"stages": STAGE, "edges": EDGE}
PAIR_MARK = "|"
_WHOLE = re.compile(r"[+-]?\d+(\.0+)?")


def _name(value: object, kind: Kind) -> str | None:
    """A usable name or None: text without outer white space, or a whole number in decimal."""
    if isinstance(value, bool) or value is None:
        return None
    if kind.number:
        text = str(value).strip()
        return str(int(float(text)) if "." in text else int(text)) if _WHOLE.fullmatch(text) else None
    if isinstance(value, (str, int, float)):
        return str(value).strip() or None
    return None


def _named(obj: object, kind: Kind) -> tuple[str, ...] | None:
    """The name, or pair of names, that an object, a pair list or a bare value bears."""
    if isinstance(obj, dict):
        for alt in kind.names:
            parts = tuple(_name(obj.get(f), kind) for f in alt)
            if all(parts):
                return parts
        return None
    if kind.pair:
        ends = obj[:2] if isinstance(obj, list) else obj.split(PAIR_MARK, 1) if isinstance(obj, str) else []
        parts = tuple(_name(x, kind) for x in ends)
        return parts if len(parts) == 2 and all(parts) else None
    return _alone(obj, kind)


def _alone(obj: object, kind: Kind) -> tuple[str, ...] | None:
    name = None if isinstance(obj, list) else _name(obj, kind)
    return None if name is None else (name,)


def _members(value: object, kind: Kind) -> Iterator[tuple[tuple[str, ...] | None, object]]:
    """(name, content) of all members of a field of whatever shape."""
    while isinstance(value, dict) and set(value) == {"items"} and isinstance(value["items"], (list, dict)):
        value = value["items"]
    if isinstance(value, list):
        for member in value:
            yield _named(member, kind), member
    elif isinstance(value, dict):
        if set(value) & kind.fields():
            yield _named(value, kind), value
        else:
            for key, content in value.items():
                yield _named(key, kind) if kind.pair else _alone(key, kind), content
    elif value is not None:
        yield _named(value, kind), value


_LITERAL = re.compile(r"true|false|null|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?")
_BLANK = re.compile(r"[ \t\n\r]*")


def loads_deep(text: str) -> object:
    """json.loads without recursion, for records nested too deeply for it; ValueError for broken text."""
    skip = lambda at: _BLANK.match(text, at).end()
    at, stack, key = skip(0), [], None
    while True:
        mark, value, closed = text[at : at + 1], None, True
        if mark in ("{", "["):
            value, at = ({} if mark == "{" else []), skip(at + 1)
            closed = text[at : at + 1] == ("}" if mark == "{" else "]")
            at += closed
        elif mark == '"':
            value, at = scanstring(text, at + 1)
        else:
            found = _LITERAL.match(text, at)
            if not found:
                raise ValueError(f"no value at {at}")
            value, at = json.loads(found[0]), found.end()
        if not closed:
            stack.append((value, key))
        while closed:  # put the value into its container, and close that if it ends here
            if not stack:
                if skip(at) != len(text):
                    raise ValueError(f"more after the value at {at}")
                return value
            holder, above = stack[-1]
            holder.append(value) if isinstance(holder, list) else holder.__setitem__(key, value)
            at = skip(at)
            mark, at = text[at : at + 1], skip(at + 1)
            if mark == ",":
                break
            if mark != ("]" if isinstance(holder, list) else "}"):
                raise ValueError(f"no end at {at}")
            stack.pop()
            value, key = holder, above
        if isinstance(stack[-1][0], dict):
            if text[at : at + 1] != '"':
                raise ValueError(f"no key at {at}")
            key, at = scanstring(text, at + 1)
            at = skip(at)
            if text[at : at + 1] != ":":
                raise ValueError(f"no colon at {at}")
            at = skip(at + 1)


def _parsed(text: object) -> object:
    """Content of a JSON field, decoded again as long as it is a text (every turn makes it shorter); ValueError if broken.

    Null and blank texts are no JSON but nothing: None.
    """
    if isinstance(text, str) and not text.strip():
        return None
    while isinstance(text, str):
        try:
            text = json.loads(text)
        except RecursionError:
            text = loads_deep(text)
    return text


def _content(text: object) -> object:
    """Content of a JSON field, None for null, empty or broken text."""
    try:
        return _parsed(text)
    except ValueError:
        return None


def interval_nodes(text: object, kind: Kind, start: int = 0) -> list[tuple[str, tuple[str, ...], int, int, dict | None]]:
    """(kind, names, pre, post, content) of all named nodes, depth first; a member without a name ends its branch."""
    out: list[tuple[str, tuple[str, ...], int, int, dict | None]] = []
    clock = start
    stack: list[tuple] = [("open", _content(text), kind, None)]
    while stack:
        step, a, b, c = stack.pop()
        if step == "close":
            name, content, slot = a, b, c
            kind_name, pre = out[slot][0], out[slot][2]
            out[slot] = (kind_name, name, pre, clock, content)
            clock += 1
        elif step == "node":
            name, content = a, b
            slot = len(out)
            out.append((c.kind, name, clock, -1, None))
            clock += 1
            inner = content if isinstance(content, dict) else None
            stack.append(("close", name, inner, slot))
            if inner:
                for f, below in reversed(c.holds.items()):
                    stack.append(("open", inner.get(f), below, None))
        else:
            found = [(n, m) for n, m in _members(a, b) if n is not None]
            stack.extend(("node", n, m, b) for n, m in reversed(found))
    return out


NODE_SCHEMA = "rec bigint, kind string, name string, name2 string, pre int, post int, attrs map<string,string>"


def node_table(df: DataFrame, id_col: str, shape: dict[str, Kind], with_attrs: bool = True) -> DataFrame:
    """Interval-labelled nodes of the JSON fields of ``df``: (id, rec, kind, name, name2, pre, post, attrs).

    rec tells records with the same id apart; name2 is the second name of a pair. Streams Arrow batches; a record is never held
    longer than its batch, and one that comes again in it is left out, so that a record delivered very often makes no hot group.
    """
    fields = list(shape)
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, seen = [], set()
            for values in zip(pdf["__id"], pdf["rec"], *(pdf[f] for f in fields), strict=True):
                if values in seen:
                    continue
                seen.add(values)
                clock = 0
                for text, f in zip(values[2:], fields, strict=True):
                    nodes = interval_nodes(text, shape[f], clock)
                    clock += 2 * len(nodes)
                    for kind, names, pre, post, content in nodes:
                        attrs = None
                        if with_attrs:
                            plain = (content or {}).items()
                            attrs = {k: json.dumps(v) if isinstance(v, bool) else str(v) for k, v in plain if isinstance(v, (str, int, float))}
                        rows.append((values[0], values[1], kind, names[0], names[1] if len(names) > 1 else None, pre, post, attrs))
            yield pd.DataFrame(rows, columns=["__id", "rec", "kind", "name", "name2", "pre", "post", "attrs"])

    source = df.select(F.col(id_col).alias("__id"), F.xxhash64(*fields).alias("rec"), *fields)
    return source.mapInPandas(run, f"__id {id_type}, {NODE_SCHEMA}").withColumnRenamed("__id", id_col)


def link_by_containment(nodes: DataFrame, id_col: str, above: tuple[str, ...] = ("stage", "section")) -> DataFrame:
    """Adds to each node the name and label of its containing node of each kind in ``above``.

    In pre-order the last opened node of a kind is the only one that can contain the present node; it
    does so if it closes later. One sort per record instead of a range join.
    """
    order = Window.partitionBy(id_col, "rec").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    for kind in above:
        opened = F.last(F.when(F.col("kind") == kind, F.struct("name", "pre", "post")), ignorenulls=True).over(order)
        nodes = nodes.withColumn(f"__{kind}", opened)
    for kind in above:
        held = F.col(f"__{kind}.post") > F.col("post")
        nodes = nodes.withColumn(f"{kind}_name", F.when(held, F.col(f"__{kind}.name")))
        nodes = nodes.withColumn(f"{kind}_pre", F.when(held, F.col(f"__{kind}.pre")))
    return nodes.drop(*[f"__{kind}" for kind in above])


def trace_nodes(traces: DataFrame, with_attrs: bool = True) -> DataFrame:
    """All nodes of decision traces linked to their stage and section."""
    return link_by_containment(node_table(traces, "trace_id", TRACE_SHAPE, with_attrs), "trace_id")


def child_records(traces: DataFrame) -> DataFrame:
    """trace_id, child_kind, parent_key, item_key of each child record, distinct."""
    nodes = trace_nodes(traces, with_attrs=False)
    parent = (
        F.when(F.col("kind") == "section", F.col("stage_name"))
        .when(F.col("kind") == "evidence", F.concat_ws("/", "stage_name", "section_name"))
        .otherwise("")
    )
    return nodes.select(
        "trace_id", F.col("kind").alias("child_kind"), parent.alias("parent_key"), F.concat_ws(">", "name", "name2").alias("item_key")
    ).distinct()


def rejected_fields(df: DataFrame, id_col: str, shape: dict[str, Kind]) -> DataFrame:
    """(id, field, n_chars) of the fields whose text is no JSON at some level of encoding, distinct; null and blank texts are none."""
    fields = list(shape)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, *texts in zip(pdf["__id"], *(pdf[f] for f in fields), strict=True):
                for f, text in zip(fields, texts, strict=True):
                    try:
                        _parsed(text)
                    except ValueError:
                        rows.append((key, f, len(text)))
            yield pd.DataFrame(rows, columns=["__id", "field", "n_chars"])

    id_type = df.schema[id_col].dataType.simpleString()
    found = df.select(F.col(id_col).alias("__id"), *fields).mapInPandas(run, f"__id {id_type}, field string, n_chars bigint")
    return found.withColumnRenamed("__id", id_col).distinct()
