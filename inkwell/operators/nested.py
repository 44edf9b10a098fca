"""Deeply nested records -> related flat tables, by Dewey labels.

Every array element, map entry and optional sub-object of a record becomes a node. Its Dewey label is the list of
identifiers met on the way down from the record (array position, map key, or ``0`` for a single sub-object), so the
parent's label is the label without its last part and no surrogate key or join is needed. Nodes that have the same
schema path (``body_text.cite_spans``) form one table.

Nulls: null containers, elements and map values make no node, but null elements count in the positions. Empty arrays
make no node. Blank text is kept in ``leaves``; ``filled`` says whether any text leaf of the node's own object (with
its nested structs, without its arrays and maps) is neither null nor blank.

``labelled_tables`` makes all tables in one pass over the records, grouping the nodes by schema path; ``record_tables`` reads
for each table only the columns it needs, which is cheaper where one table is wanted. Both give the same rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.session import written

BLANK = r"(?U)^\s*$"
NODE = T.ArrayType(
    T.StructType(
        [
            T.StructField("path", T.StringType()),
            T.StructField("label", T.ArrayType(T.StringType())),
            T.StructField("filled", T.BooleanType()),
            T.StructField("own", T.BooleanType()),
            T.StructField("leaves", T.StringType()),
        ]
    )
)
#: Leaves travel as JSON between the one pass and the tables; times keep their microseconds.
LEAVES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


@dataclass(frozen=True)
class Wanted:
    """A schema path that becomes a table. ``own_text``: name of the text leaf whose blankness is reported as ``own``; ``leaves``: whether its leaves go with it."""

    path: str
    own_text: str = ""
    leaves: bool = False


def not_blank(c: Column) -> Column:
    return c.isNotNull() & ~c.rlike(BLANK)


def _text_filled(c: Column, kind: T.DataType) -> Column:
    """True if any string leaf of the struct (arrays and maps are not entered) is not blank."""
    if isinstance(kind, T.StringType):
        return F.coalesce(not_blank(c), F.lit(False))
    if isinstance(kind, T.StructType):
        parts = [_text_filled(c.getField(f.name), f.dataType) for f in kind.fields if isinstance(f.dataType, (T.StringType, T.StructType))]
        out = F.lit(False)
        for p in parts:
            out = out | p
        return out
    return F.lit(False)


def _own(path: str, c: Column, kind: T.DataType, wanted: dict[str, Wanted], keep: Column) -> Column:
    if path in wanted and wanted[path].own_text and isinstance(kind, T.StructType):
        return keep & F.coalesce(not_blank(c.getField(wanted[path].own_text)), F.lit(False))
    return keep


def _node(wanted: Wanted, label: Column, c: Column, kind: T.DataType, own: Column) -> Column:
    leaves = F.lit(None).cast("string")
    if wanted.leaves:
        columns = _leaf_columns(c, kind, "") if isinstance(kind, T.StructType) else [c.alias("value")]
        leaves = F.to_json(F.struct(*columns), LEAVES) if columns else F.lit("{}")
    return F.struct(F.lit(wanted.path).alias("path"), label.alias("label"), _text_filled(c, kind).alias("filled"), own.alias("own"), leaves.alias("leaves"))


def _below(path: str, label: Column, c: Column, kind: T.DataType, wanted: dict[str, Wanted], objects: set[str], keep: Column) -> list[Column]:
    """Expressions, each an array of nodes, for everything wanted under ``c``."""
    out: list[Column] = []
    if not any(w == path or w.startswith(f"{path}.") or not path for w in wanted):
        return out
    for f in kind.fields if isinstance(kind, T.StructType) else []:
        here = f"{path}.{f.name}" if path else f.name
        value = c.getField(f.name) if path else F.col(f"`{f.name}`")
        if not any(w == here or w.startswith(f"{here}.") for w in wanted):
            continue
        if isinstance(f.dataType, T.StructType):
            sub = F.concat(label, F.array(F.lit("0"))) if here in objects else label
            if here in wanted:
                out.append(F.when(value.isNotNull(), F.array(_node(wanted[here], sub, value, f.dataType, keep))))
            out += _below(here, sub, value, f.dataType, wanted, objects, keep)
        elif isinstance(f.dataType, T.ArrayType):
            inner = f.dataType.elementType
            out.append(_each(here, label, value, inner, wanted, objects, keep))
        elif isinstance(f.dataType, T.MapType):
            inner = f.dataType.valueType
            out.append(_each_entry(here, label, value, inner, wanted, objects, keep))
    return out


def _each(path: str, label: Column, c: Column, kind: T.DataType, wanted: dict[str, Wanted], objects: set[str], keep: Column) -> Column:
    return F.flatten(F.transform(c, lambda x, i: _all_of(path, F.concat(label, F.array(i.cast("string"))), x, kind, wanted, objects, keep)))


def _each_entry(path: str, label: Column, c: Column, kind: T.DataType, wanted: dict[str, Wanted], objects: set[str], keep: Column) -> Column:
    def nodes(e: Column) -> Column:
        return _all_of(path, F.concat(label, F.array(e.getField("key").cast("string"))), e.getField("value"), kind, wanted, objects, keep)

    return F.flatten(F.transform(F.map_entries(c), nodes))


def _all_of(path: str, label: Column, c: Column, kind: T.DataType, wanted: dict[str, Wanted], objects: set[str], keep: Column) -> Column:
    empty = F.array().cast(NODE)
    own = _own(path, c, kind, wanted, keep)
    parts = [F.array(_node(wanted[path], label, c, kind, own)).cast(NODE)] if path in wanted else []
    parts += [F.coalesce(p.cast(NODE), empty) for p in _below(path, label, c, kind, wanted, objects, own)]
    return F.when(c.isNotNull(), F.concat(*parts) if len(parts) > 1 else parts[0]).otherwise(empty)


def dewey_nodes(df: DataFrame, key: str, wanted: list[Wanted]) -> DataFrame:
    """(key, path, label, filled, own): one row for each node of the wanted schema paths, in one pass and without a shuffle.

    A wanted struct field (not an array element) is a single optional sub-object and gets the label part ``0``.
    Empty input gives an empty table; a null ``key`` is kept.
    """
    return _nodes(df, key, wanted).select(key, "_node.path", "_node.label", "_node.filled", "_node.own")


def _nodes(df: DataFrame, key: str, wanted: list[Wanted], root: Column | None = None) -> DataFrame:
    """(key, _node): every node of the wanted paths; ``root``: a node for the record itself."""
    by = {w.path: w for w in wanted}
    objects = {w.path for w in wanted}
    shape = T.StructType([f for f in df.schema.fields if any(w.path.split(".")[0] == f.name for w in wanted)])
    parts = _below("", F.array().cast("array<string>"), None, shape, by, objects, F.lit(True))
    empty = F.array().cast(NODE)
    nodes = F.concat(*([F.array(root).cast(NODE)] if root is not None else []), *[F.coalesce(p.cast(NODE), empty) for p in parts])
    return df.select(F.col(key), F.explode(nodes).alias("_node"))


def _leaf_text(value: object) -> bool:
    return isinstance(value, str) and bool(value.strip())


def _object_filled(value: object) -> bool:
    if isinstance(value, dict):
        return any(_object_filled(v) for v in value.values() if not isinstance(v, list))
    return _leaf_text(value)


def _walk(value: object, path: str, label: list[str], wanted: dict[str, Wanted], maps: set[str], arrays: set[str], keep: bool, out: list[tuple]) -> None:
    """Nodes of one parsed JSON value under the same labels as dewey_nodes gives typed columns."""
    if not isinstance(value, dict):
        return
    for name, child in value.items():
        here = f"{path}.{name}" if path else name
        if child is None or not any(w == here or w.startswith(f"{here}.") for w in wanted):
            continue
        if here in maps:
            children = list(child.items()) if isinstance(child, dict) else []
        elif here in arrays:
            children = list(enumerate(child)) if isinstance(child, list) else [(0, child)] if isinstance(child, dict) else []
        elif here in wanted:
            children = [("0", child)] if isinstance(child, dict) else []
        else:
            _walk(child, here, label, wanted, maps, arrays, keep, out)
            continue
        for ordinal, x in children:
            if x is None:
                continue
            sub = [*label, str(ordinal)]
            own = keep
            if here in wanted:
                text = wanted[here].own_text
                own = keep and (_leaf_text(x.get(text)) if text and isinstance(x, dict) else not text)
                out.append((here, sub, _object_filled(x), own))
            _walk(x, here, sub, wanted, maps, arrays, own, out)


def json_dewey_nodes(df: DataFrame, key: str, body: str, wanted: list[Wanted], arrays: set[str], maps: set[str]) -> DataFrame:
    """As dewey_nodes, for records that lie in ``body`` as JSON text of loosely the same shape.

    A single object in place of an array counts as an array of one; a value of another unexpected type makes no node.
    Null, empty and unparsable bodies, and bodies that are no object, make no rows.
    """
    by = {w.path: w for w in wanted}
    kind = df.schema[key].dataType
    schema = T.StructType(
        [
            T.StructField(key, kind),
            T.StructField("path", T.StringType()),
            T.StructField("label", T.ArrayType(T.StringType())),
            T.StructField("filled", T.BooleanType()),
            T.StructField("own", T.BooleanType()),
        ]
    )

    def parse(batches: Iterator) -> Iterator:
        import pyarrow as pa

        types = [pa.string(), pa.list_(pa.string()), pa.bool_(), pa.bool_()]
        for batch in batches:
            rows: list[tuple] = []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                try:
                    record = json.loads(text)
                except (ValueError, RecursionError):
                    continue
                nodes: list[tuple] = []
                _walk(record, "", [], by, maps, arrays, True, nodes)
                rows += [(k, *n) for n in nodes]
            columns = list(zip(*rows)) if rows else [()] * 5
            arrays_out = [pa.array(columns[0], type=batch.schema.field(0).type)] + [pa.array(c, type=t) for c, t in zip(columns[1:], types)]
            yield pa.RecordBatch.from_arrays(arrays_out, names=[key, "path", "label", "filled", "own"])

    return df.select(key, body).mapInArrow(parse, schema)


def _shaped(value: object, kind: T.DataType) -> object:
    """A parsed JSON value as a value of the type; what doesn't fit becomes null.

    As in _walk, an object in place of an array of objects is an array of one, and an element or map value that is
    neither null nor an object keeps its place as an object without leaves.
    """
    if isinstance(kind, T.StructType):
        return {f.name: _shaped(value.get(f.name), f.dataType) for f in kind.fields} if isinstance(value, dict) else None
    if isinstance(kind, (T.ArrayType, T.MapType)):
        inner = kind.elementType if isinstance(kind, T.ArrayType) else kind.valueType
        full = lambda x: _shaped({} if isinstance(inner, T.StructType) and x is not None and not isinstance(x, dict) else x, inner)
        if isinstance(kind, T.MapType):
            return [(_sound(k), full(x)) for k, x in value.items()] if isinstance(value, dict) else None
        if isinstance(value, list):
            return [full(x) for x in value]
        one = isinstance(value, dict) if isinstance(inner, T.StructType) else isinstance(value, str)
        return [full(value)] if one else None
    if isinstance(kind, T.StringType):
        return _sound(value) if isinstance(value, str) else None if value is None else json.dumps(value, ensure_ascii=False)
    if isinstance(kind, (T.IntegerType, T.LongType)) and not isinstance(value, bool) and isinstance(value, (int, float, str)):
        try:
            number = int(value)
        except (ValueError, OverflowError):
            return None
        bits = 31 if isinstance(kind, T.IntegerType) else 63
        return number if (isinstance(value, str) or number == value) and -(1 << bits) <= number < 1 << bits else None
    return None


def _sound(text: str) -> str:
    """``text`` with lone surrogates, which JSON escapes may give, replaced."""
    try:
        text.encode()
        return text
    except UnicodeEncodeError:
        return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def json_records(df: DataFrame, body: str, shape: T.StructType) -> DataFrame:
    """``df`` with its ``body`` (JSON text) parsed to the columns of ``shape``, the nodes and labels as in json_dewey_nodes.

    Leaves of these types are taken: text (other values as their JSON text) and whole numbers; other types become null.
    Columns that ``df`` has itself win over those of ``shape``. Null, empty and unparsable bodies, and bodies that are no
    object, make no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    kept = [f for f in df.schema.fields if f.name != body]
    read = T.StructType([T.StructField(f.name, f.dataType) for f in shape.fields if f.name not in {k.name for k in kept}])
    schema = T.StructType([*kept, *read])
    types = [f.type for f in to_arrow_schema(read)]

    def parse(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            at, rows = [], []
            for k, text in enumerate(batch.column(len(kept)).to_pylist()):
                try:
                    record = json.loads(text) if text else None
                except (ValueError, RecursionError):
                    continue
                if isinstance(record, dict):
                    at.append(k)
                    rows.append([_shaped(record.get(f.name), f.dataType) for f in read.fields])
            own = [batch.column(k).take(pa.array(at, pa.int64())) for k in range(len(kept))]
            new = [pa.array([r[k] for r in rows], type=t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*own, *new], names=schema.names)

    return df.select(*[f.name for f in kept], body).mapInArrow(parse, schema)


def paper_tables(typed: DataFrame, raw: DataFrame, key: str = "rec_id", one_pass: bool = False) -> dict[str, DataFrame]:
    """The flat tables of record_tables (``one_pass``: of labelled_tables) over typed paper records and those that arrived as JSON text."""
    parsed = json_records(raw, "body", typed.schema)
    both = typed.unionByName(parsed.select(*[c for c in parsed.columns if c in typed.columns]), allowMissingColumns=True)
    return (labelled_tables if one_pass else record_tables)(both, key, [p for p in PAPER_TABLES if p.split(".")[0] in both.columns])


def labelled_tables(df: DataFrame, key: str, wanted: list[str]) -> dict[str, DataFrame]:
    """The tables of record_tables, ``records`` too, from one pass: every node with its leaves, grouped by schema path.

    The nodes are written once into the shared folder, one sub-folder a path, so a table reads its own nodes only.
    """
    flat = _leaves_of_root(df, key)
    said = F.to_json(F.struct(*flat), LEAVES) if flat else F.lit("{}")
    root = F.struct(F.lit(None).cast("string").alias("path"), F.array().cast("array<string>").alias("label"), F.lit(False).alias("filled"), F.lit(True).alias("own"), said.alias("leaves"))
    nodes = _nodes(df, key, [Wanted(p, leaves=True) for p in wanted], root).select(F.col(key).alias("_key"), "_node.path", "_node.label", "_node.leaves")
    stored = written(nodes, "nodes", by="path")
    tables = {}
    shapes = {"": df.select(*flat).schema if flat else T.StructType(), **{p: record_shape(df, p) for p in wanted}}
    for path, shape in shapes.items():
        own = stored.where(F.col("path").isNull() if path == "" else F.col("path") == path)
        leaves = F.from_json("leaves", shape, LEAVES).alias("_l")
        links = [F.array_join("label", ".").alias("label"), F.array_join(parent_label(F.col("label")), ".").alias("parent_label"), F.element_at("label", -1).alias("ordinal")] if path else []
        table = own.select(F.col("_key").alias(key), *links, *([leaves] if len(shape) else []))
        tables[path or "records"] = table.select(*[c for c in table.columns if c != "_l"], *([F.col(f"_l.`{n}`").alias(n) for n in shape.names] if len(shape) else []))
    return tables


def record_shape(df: DataFrame, path: str) -> T.StructType:
    """The leaf columns of a path's table."""
    return T.StructType(record_tables(df, df.columns[0], [path])[path].schema.fields[4:])


def parent_label(label: Column) -> Column:
    """A parent's Dewey label: the label without its last part."""
    return F.slice(label, 1, F.greatest(F.size(label) - 1, F.lit(0)))


def record_tables(df: DataFrame, key: str, wanted: list[str]) -> dict[str, DataFrame]:
    """Flat tables with their leaf columns, one for each wanted schema path and one, ``records``, for the roots.

    Each child table has the record key, ``label`` and ``parent_label`` (Dewey, joined with '.'), its ordinal and all
    scalar leaves; nested structs are flattened to ``a_b``, arrays of scalars stay arrays. Columns of the input that
    clash with the link columns get the suffix ``_``.
    """
    tables = {"records": df.select(F.col(key), *_leaves_of_root(df, key))}
    for path in wanted:
        cur = df.select(F.col(key), *[F.col(f"`{path.split('.')[0]}`").alias("_v")], F.array().cast("array<string>").alias("_label"))
        kind: T.DataType = df.schema[path.split(".")[0]].dataType
        steps = path.split(".")[1:]
        cur, kind, is_node = _open(cur, kind, key)
        for name in steps:
            kind_next = kind[name].dataType
            cur = cur.select(key, F.col("_v").getField(name).alias("_v"), "_label")
            cur, kind, is_node = _open(cur, kind_next, key)
        if not is_node:
            cur = cur.select(key, "_v", F.concat("_label", F.array(F.lit("0"))).alias("_label"))
        leaves = _leaf_columns(F.col("_v"), kind, "") if isinstance(kind, T.StructType) else [F.col("_v").alias("value")]
        tables[path] = cur.where(F.col("_v").isNotNull()).select(
            key,
            F.array_join("_label", ".").alias("label"),
            F.array_join(parent_label(F.col("_label")), ".").alias("parent_label"),
            F.element_at("_label", -1).alias("ordinal"),
            *leaves,
        )
    return tables


def _open(cur: DataFrame, kind: T.DataType, key: str) -> tuple[DataFrame, T.DataType, bool]:
    if isinstance(kind, T.ArrayType):
        opened = cur.select(key, "_label", F.posexplode("_v").alias("_p", "_v"))
        return opened.select(key, "_v", F.concat("_label", F.array(F.col("_p").cast("string"))).alias("_label")), kind.elementType, True
    if isinstance(kind, T.MapType):
        opened = cur.select(key, "_label", F.explode("_v").alias("_p", "_v"))
        return opened.select(key, "_v", F.concat("_label", F.array(F.col("_p").cast("string"))).alias("_label")), kind.valueType, True
    return cur, kind, False


def _leaf_columns(c: Column, kind: T.StructType, prefix: str) -> list[Column]:
    out: list[Column] = []
    for f in kind.fields:
        name = f"{prefix}{f.name}"
        if isinstance(f.dataType, T.StructType):
            out += _leaf_columns(c.getField(f.name), f.dataType, f"{name}_")
        elif isinstance(f.dataType, T.MapType) or (isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, (T.StructType, T.ArrayType, T.MapType))):
            continue
        else:
            out.append(c.getField(f.name).alias(name + "_" if name in {"label", "parent_label", "ordinal"} else name))
    return out


def _leaves_of_root(df: DataFrame, key: str) -> list[Column]:
    out: list[Column] = []
    for f in df.schema.fields:
        if f.name == key:
            continue
        if isinstance(f.dataType, T.StructType):
            out += _leaf_columns(F.col(f"`{f.name}`"), f.dataType, f"{f.name}_")
        elif not isinstance(f.dataType, (T.ArrayType, T.MapType)):
            out.append(F.col(f"`{f.name}`"))
    return out


#: The children of a parsed paper record: schema path -> (child name, text leaf that decides, needs any text).
PAPER_CHILDREN = {
    "metadata.authors": "author",
    "metadata.authors.affiliation": "affiliation",
    "body_text": "paragraph",
    "body_text.cite_spans": "cite_span",
    "bib_entries": "bib_entry",
    "bib_entries.authors": "bib_author",
}


#: The paths that become flat tables.
PAPER_TABLES = [*PAPER_CHILDREN, "abstract"]


def paper_nodes(typed: DataFrame, raw: DataFrame, key: str = "rec_id") -> DataFrame:
    """(key, path, label, filled, own) of typed paper records and of those that arrived as JSON text."""
    wanted = [Wanted(p, "text" if p == "body_text" else "") for p in PAPER_CHILDREN]
    arrays = {"metadata.authors", "body_text", "body_text.cite_spans", "bib_entries.authors"}
    return dewey_nodes(typed, key, wanted).unionByName(json_dewey_nodes(raw, key, "body", wanted, arrays, {"bib_entries"}))


def paper_links(nodes: DataFrame, key: str = "rec_id") -> DataFrame:
    """(key, child, parent_key, child_key): each kept child with its parent, read off the labels.

    Affiliations without any text and paragraphs with blank text make no row, nor do citations of such paragraphs.
    """
    names = F.create_map(*[F.lit(x) for kv in PAPER_CHILDREN.items() for x in kv])
    return nodes.where(
        F.when(F.col("path") == "metadata.authors.affiliation", F.col("filled")).when(F.col("path").isin("body_text", "body_text.cite_spans"), F.col("own")).otherwise(F.lit(True))
    ).select(
        key,
        names[F.col("path")].alias("child"),
        F.array_join(parent_label(F.col("label")), ".").alias("parent_key"),
        F.element_at("label", -1).alias("child_key"),
    )
