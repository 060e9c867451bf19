"""Deeply nested records to related flat tables by interval labels.

Each document is walked depth first and every object gets a pre-order and a post-order number; an object contains
another of its document exactly if its numbers enclose the other's. The labels are emitted as one node table, from
which a table per node type is a filter, and parent and child tables are linked by containment: a sweep in pre-order
keeps a stack of the intervals that are open, and a child belongs to the innermost parent among them. So parents may hold
parents of their own type (comments, folders); nothing is paired. Where only the links are wanted, labels and sweep run in
one pass over the documents, which are parsed once.

A node's type is the field name it is held under, in lower case; the members of a list are nodes of the list's type
with their place in it, an object in place of a list is a list of one, and a string that holds a JSON object is that
object. Null entries take a place but give no node; objects on the way down (envelopes) are nodes of their own type
and change nothing for what they contain. Scalars become fields of their object, by lower-case name, as they are
spelt; null and absent fields are absent. Payloads that are null or no well-formed JSON (bare NaN and Infinity
included, and texts nested beyond the parser's depth) give no node. Repeated field names: the last one holds. A document
that occurs twice is walked twice; tables of nodes that are linked later need unique ids.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODES = "doc_id bigint, node_type string, pre int, post int, depth int, pos int, fields map<string,string>"
TYPES = pa.schema(
    [("doc_id", pa.int64()), ("node_type", pa.string()), ("pre", pa.int32()), ("post", pa.int32()), ("depth", pa.int32()), ("pos", pa.int32()), ("fields", pa.map_(pa.string(), pa.string()))]
)


class _Number(str):
    """A number as it is spelt."""


def _refuse(word: str):
    raise ValueError(word)


def parse(text: str):
    return json.loads(text, parse_int=_Number, parse_float=_Number, parse_constant=_refuse)


def _object(value):
    """The object a value is: itself, or the one its string holds; else None."""
    if isinstance(value, dict):
        return value
    if isinstance(value, str) and not isinstance(value, _Number) and value.lstrip()[:1] == "{":
        try:
            inner = parse(value)
        except (ValueError, RecursionError):
            return None
        return inner if isinstance(inner, dict) else None
    return None


def label(root) -> list[list]:
    """[type, pre, post, depth, pos, fields] of every object in pre-order, by depth-first traversal without recursion."""
    nodes: list[list] = []
    post = 0
    stack: list = [("", 0, 0, root, None)]
    while stack:
        kind, depth, pos, value, opened = stack.pop()
        if opened is not None:
            opened[2] = post
            post += 1
            continue
        if isinstance(value, list):
            stack.extend((kind, depth, i, v, None) for i, v in reversed(list(enumerate(value))) if v is not None)
            continue
        obj = _object(value)
        if obj is None:
            continue
        fields, below = {}, []
        for k, v in obj.items():
            name = k.lower()
            if isinstance(v, bool):
                fields[name] = "true" if v else "false"
            elif isinstance(v, list):
                below.append((name, depth + 1, 0, v, None))
            elif v is not None:
                inner = _object(v)
                if inner is not None:
                    below.append((name, depth + 1, 0, inner, None))
                else:
                    fields[name] = str(v)
        node = [kind, len(nodes), -1, depth, pos, fields]
        nodes.append(node)
        stack.append((kind, depth, pos, None, node))
        stack.extend(reversed(below))
    return nodes


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[list]]]:
    """Every document's id and nodes."""
    for b in batches:
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if text is None:
                continue
            try:
                root = parse(text)
            except (ValueError, RecursionError):
                continue
            yield doc, label(root)


def label_nodes(df: DataFrame, ident: str, payload: str, keep: list[str] | None = None) -> DataFrame:
    """The node table of all documents: doc_id, node_type, pre, post, depth, pos, fields.

    ``keep``: the types to emit (lower case); labels count all nodes whichever are kept. The root has type ''.
    """
    wanted = None if keep is None else set(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for doc, nodes in _walked(batches):
            rows.extend((doc, *n) for n in nodes if wanted is None or n[0] in wanted)
            if len(rows) > 50_000:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    return df.select(F.col(ident).cast("long"), F.col(payload)).mapInArrow(run, NODES)


def _whole(s: str | None) -> str | None:
    """Escapes of half a surrogate pair are no text; they are shown as the replacement character."""
    return s if s is None else s.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
    fields = [list(f.items()) for f in cols[6]]
    try:
        return _columns([*cols[:6], fields], TYPES)
    except UnicodeEncodeError:
        return _columns([cols[0], list(map(_whole, cols[1])), *cols[2:6], [[(_whole(k), _whole(v)) for k, v in f] for f in fields]], TYPES)


def _columns(cols: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)


def contained(nodes: list[list], parent: str, child: str) -> Iterator[tuple[list, list]]:
    """(parent, child) for every child, with the innermost parent whose interval encloses it; nodes in pre-order."""
    open_: list[list] = []
    for n in nodes:
        while open_ and open_[-1][2] < n[2]:
            open_.pop()
        if n[0] == child and open_:
            yield open_[-1], n
        if n[0] == parent:
            open_.append(n)


LINKS = "doc_id bigint, parent_pre int, pre int, post int, pos int, fields map<string,string>"
LINK_TYPES = pa.schema([("doc_id", pa.int64()), ("parent_pre", pa.int32()), ("pre", pa.int32()), ("post", pa.int32()), ("pos", pa.int32()), ("fields", pa.map_(pa.string(), pa.string()))])


def link(nodes: DataFrame, parent: str, child: str) -> DataFrame:
    """Each ``child`` node with the innermost ``parent`` node whose interval encloses it.

    doc_id, parent_pre, pre, post, pos, fields. Children outside any parent are left out. A document's nodes meet in one
    task, as they did when it was walked.
    """
    kinds = {parent, child}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        for b in batches:
            rows = []
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if r[0] != last:
                    rows += _linked(last, held, parent, child)
                    last, held = r[0], []
                held.append(list(r[1:]))
            yield _columns(list(zip(*rows, strict=True)) if rows else [[]] * 6, LINK_TYPES)
        rows = _linked(last, held, parent, child)
        yield _columns(list(zip(*rows, strict=True)) if rows else [[]] * 6, LINK_TYPES)

    x = nodes.where(F.col("node_type").isin(list(kinds))).select("doc_id", "node_type", "pre", "post", "depth", "pos", "fields")
    return x.repartition("doc_id").sortWithinPartitions("doc_id", "pre").mapInArrow(run, LINKS)


def _linked(doc, nodes: list[list], parent: str, child: str) -> list[tuple]:
    return [(doc, p[1], c[1], c[2], c[4], c[5]) for p, c in contained(nodes, parent, child)]


PAIRS = "doc_id bigint, parent_pos int, parent_key string, child_pos int, child_key string"
PAIR_TYPES = pa.schema([("doc_id", pa.int64()), ("parent_pos", pa.int32()), ("parent_key", pa.string()), ("child_pos", pa.int32()), ("child_key", pa.string())])


def parent_child(df: DataFrame, ident: str, payload: str, parent: str, child: str, parent_key: str, child_key: str, key_node: str | None = None) -> DataFrame:
    """doc_id, parent_pos, parent_key, child_pos, child_key: a row per child, and one with child_pos -1 for childless parents.

    ``key_node``: the type of the node inside the parent that carries its key (the first one holds); default the parent itself.
    Keys that are absent or null are ''. A document's labels and links are found in one pass, without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for doc, nodes in _walked(batches):
            keys: dict[int, str] = {}
            if key_node is not None:
                for p, k in contained(nodes, parent, key_node):
                    keys.setdefault(p[1], k[5].get(parent_key, ""))
            below: dict[int, list[list]] = {}
            for p, c in contained(nodes, parent, child):
                below.setdefault(p[1], []).append(c)
            for p in nodes:
                if p[0] == parent:
                    key = p[5].get(parent_key, "") if key_node is None else keys.get(p[1], "")
                    rows += [(doc, p[4], key, c[4], c[5].get(child_key, "")) for c in below.get(p[1], ())] or [(doc, p[4], key, -1, "")]
            if len(rows) > 50_000:
                yield _keys(rows)
                rows = []
        if rows:
            yield _keys(rows)

    return df.select(F.col(ident).cast("long"), F.col(payload)).mapInArrow(run, PAIRS)


def _keys(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    try:
        return _columns(cols, PAIR_TYPES)
    except UnicodeEncodeError:
        return _columns([cols[0], cols[1], list(map(_whole, cols[2])), cols[3], list(map(_whole, cols[4]))], PAIR_TYPES)
