"""Deeply nested records into related flat tables, by interval labels.

``label_nodes`` walks each JSON record depth-first and gives every node a pre-order and a
post-order number. Two facts carry all parent-child links afterwards:

* b lies inside a  <=>  a.pre < b.pre and b.post < a.post      (interval containment)
* a has post - pre + depth descendants, and in pre-order they follow a without a gap.

So the node tables of single types (``child_table``) are cut out of the label array by slicing:
the fields of a child are the nodes contained in its interval. No self-join and no shuffle is
needed, and the work is linear in the record: children of one type do not contain each other, so
their intervals together are no longer than the record.

Defined cases: a null, unparsable or scalar record has no nodes; a null, blank or missing list has
no children; an element that is null or has only blank texts keeps its place in the count of
positions but yields no row; a child without a list has position 0; a list, module or section given
as JSON text is read as what it stands for; repeated records each stand for themselves.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODE = (
    "struct<pre:int,post:int,depth:int,parent:int,type:string,name:string,pos:bigint,value:string>"
)

#: Records whose nodes a Python worker holds at a time.
RECORDS_AT_ONCE = 256

#: Child types: the modules and keys (letters and digits only, lower case) that hold them, and the
#: fields that make a child count. ``text`` is the field that a bare string stands for.
CHILD_TYPES = {
    "location": {
        "modules": ("contactslocationsmodule",),
        "keys": ("locations", "location"),
        "fields": {"facility": ("facility",), "city": ("city",), "state": ("state",), "country": ("country",)},
        "text": "facility",
    },
    "collaborator": {
        "modules": ("sponsorcollaboratorsmodule",),
        "keys": ("collaborators", "collaborator", "collaboratornames", "collaboratorname"),
        "fields": {"name": ("name",), "class": ("class",)},
        "counts": ("name",),
        "text": "name",
    },
    "secondary_outcome": {
        "modules": ("outcomesmodule",),
        "keys": ("secondaryoutcomes", "secondaryoutcome"),
        "fields": {"measure": ("measure",), "description": ("description",), "time_frame": ("timeframe",)},
        "text": "measure",
    },
}

_BLANK = r"^[\s\x{00a0}]*$"


def norm_key(key: str) -> str:
    """camelCase, snake_case and other spellings of a key compare alike."""
    return "".join(ch for ch in key.lower() if ch.isalnum())


_KEY_TYPE = {k: t for t, spec in CHILD_TYPES.items() for k in spec["keys"]}
_MODULES = {m for spec in CHILD_TYPES.values() for m in spec["modules"]}


def _unwrap(value):
    """JSON given as text inside JSON stands for what it says."""
    if isinstance(value, str) and value.lstrip()[:1] in ("[", "{"):
        try:
            return json.loads(value)
        except (ValueError, RecursionError):
            return value
    return value


def _child_type(path: tuple[str, ...]) -> str | None:
    """Type of the children at this path of normalised keys below the section root, if any."""
    t = _KEY_TYPE.get(path[-1]) if path else None
    if t and (len(path) == 1 or path[-2] in CHILD_TYPES[t]["modules"] and len(path) == 2):
        return t
    return None


def label_record(text: str | None) -> list[tuple]:
    """The nodes of one record in pre-order; [] where there is no valid JSON object."""
    if text is None:
        return []
    try:
        root = json.loads(text)
    except (ValueError, RecursionError):
        return []
    root = _unwrap(root)
    if not isinstance(root, dict):
        return []
    own = next((_unwrap(v) for k, v in root.items() if norm_key(k) == "protocolsection"), root)
    if not isinstance(own, dict):
        return []
    nodes: list[list] = []
    post = 0
    # (value, name, type, position, path, depth, parent) to enter, or an int to leave
    stack: list = [(own, "protocolsection", "section", 0, (), 0, None)]
    while stack:
        item = stack.pop()
        if isinstance(item, int):
            nodes[item][1] = post
            post += 1
            continue
        value, name, kind, pos, path, depth, parent = item
        pre = len(nodes)
        node = [pre, -1, depth, parent, kind, name, pos, None]
        nodes.append(node)
        stack.append(pre)
        below: list = []
        if isinstance(value, dict):
            for k, v in value.items():
                key = norm_key(k)
                if depth == 0 and key in ("resultssection", "derivedsection"):
                    continue
                sub = (*path, key)
                if key in _MODULES or _child_type(sub):
                    v = _unwrap(v)
                t = _child_type(sub) if kind in ("section", "object") else None
                if t and not isinstance(v, list):
                    below.append((v, key, t, 0, sub, depth + 1, pre))
                else:
                    below.append((v, key, f"{t}_list" if t else "object", 0, sub, depth + 1, pre))
        elif isinstance(value, list):
            t = kind[:-5] if kind.endswith("_list") else "object"
            for i, v in enumerate(value):
                below.append((_unwrap(v) if t != "object" else v, name, t, i, (*path, "[]"), depth + 1, pre))
        elif value is not None:
            node[7] = value if isinstance(value, str) else json.dumps(value)
        stack.extend(reversed(below))
    return [tuple(n) for n in nodes]


def label_nodes(records: DataFrame, key: str, json_col: str) -> DataFrame:
    """(key, nodes): each record's nodes with interval labels, in pre-order; other columns are left out."""
    key_type = records.schema[key].dataType.simpleString()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.string())
        names = ("pre", "post", "depth", "parent", "type", "name", "pos", "value")
        for batch in batches:
            for at in range(0, batch.num_rows, RECORDS_AT_ONCE):  # bounds what a worker holds in nodes
                part = batch.slice(at, RECORDS_AT_ONCE)
                each = [label_record(t) for t in part.column(1).to_pylist()]
                ends = list(accumulate(map(len, each), initial=0))
                flat = list(zip(*chain.from_iterable(each), strict=True)) or [()] * len(kinds)
                cols = [pa.array(c, k) for c, k in zip(flat, kinds, strict=True)]
                nodes = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(cols, names))
                yield pa.RecordBatch.from_arrays([part.column(0), nodes], ["k", "nodes"])

    src = records.select(F.col(key).alias("k"), F.col(json_col).alias("t"))
    return src.mapInArrow(walk, f"k {key_type}, nodes array<{NODE}>").withColumnRenamed("k", key)


def node_table(labelled: DataFrame, key: str) -> DataFrame:
    """All nodes as rows: (key, pre, post, depth, parent, type, name, pos, value)."""
    return labelled.select(key, F.inline("nodes"))


def descendants(n: Column) -> Column:
    """How many nodes lie inside n, from its labels alone."""
    return n["post"] - n["pre"] + n["depth"]


def _field_of(n: Column, names, test=Column.isNotNull):
    """Predicate: a direct field of n with one of the names, whose text passes the test."""
    return lambda x: (x["parent"] == n["pre"]) & x["name"].isin(*names) & test(x["value"])


def _children(labelled: DataFrame, key: str, *types: str) -> DataFrame:
    """(key, n, inside): the nodes of some types, each with the nodes contained in its interval.

    Those are contiguous in pre-order, so they are cut out while the record is still one row; what
    is laid out as rows are the intervals, never the whole record beside each child.
    """
    cut = F.transform(
        F.filter("nodes", lambda n: n["type"].isin(*types)),
        lambda n: F.struct(n.alias("n"), F.slice("nodes", n["pre"] + 2, descendants(n)).alias("inside")),
    )
    return labelled.select(key, F.inline(cut))


def child_table(labelled: DataFrame, key: str, child: str) -> DataFrame:
    """One row per child of the type: (key, pos, pre, post, parent, its fields); links by interval containment."""
    spec = CHILD_TYPES[child]
    one = _children(labelled, key, child)
    cols = []
    for field, keys in spec["fields"].items():
        hit = F.filter("inside", _field_of(F.col("n"), keys))
        text = F.try_element_at(hit, F.lit(1))["value"]
        if field == spec["text"]:
            text = F.coalesce(F.col("n.value"), text)
        cols.append(text.alias(field))
    counts = spec.get("counts", tuple(spec["fields"]))
    keep = F.lit(False)
    for f in counts:
        keep = keep | (F.col(f).isNotNull() & ~F.col(f).rlike(_BLANK))
    return (
        one.select(key, F.col("n.pos").alias("pos"), F.col("n.pre").alias("pre"), F.col("n.post").alias("post"), F.col("n.parent").alias("parent"), *cols)
        .filter(keep)
    )


def found_children(labelled: DataFrame, key: str) -> DataFrame:
    """(key, child, pos) of every child of every type, in one pass over the labels."""
    n = F.col("n")
    one = _children(labelled, key, *CHILD_TYPES)

    def filled(value: Column) -> Column:
        return value.isNotNull() & ~value.rlike(_BLANK)

    own = F.lit(False)
    for child, spec in CHILD_TYPES.items():
        names = [k for f in spec.get("counts", tuple(spec["fields"])) for k in spec["fields"][f]]
        own = own | (
            (n["type"] == child)
            & F.exists("inside", _field_of(n, names, filled))
        )
    return one.filter(filled(n["value"]) | own).select(
        key, n["type"].alias("child"), n["pos"].alias("pos")
    )
