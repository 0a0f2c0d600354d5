"""Staging rows: Parquet files with their statistics and partition values, or, for a few small rows, text in the log."""

from __future__ import annotations

import re
import secrets
import uuid

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cipher import decrypted, encrypted
from ..functions.geometry import geometry_stats
from ..functions.transforms import marked, transform, unmarked
from ..state import LakeError, Table
from ..store import Store
from .scan import JSON_OPTIONS, file_name, reshaped

#: A row with more text than this, twice its bytes as the log's size, or a batch with more than the second, goes to files.
ROW_BYTES, BATCH_BYTES = 90 << 10, 3_500_000
ORDERED = (T.NumericType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)


def physical(table: Table, df: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """df's columns, and their structs' fields, by name as the table's types, called c<id>. Missing columns get their defaults; null in a column that
    must not be null fails the job that reads it."""
    have = {c.lower(): c for c in df.columns}
    unknown = set(have) - {c.name.lower() for c in table.columns} - set(extra)
    if unknown:
        raise LakeError(f"{table.name} has no column {sorted(unknown)[0]}")
    out = []
    for c in table.columns:
        if c.name.lower() in have:
            own = have[c.name.lower()]
            value = reshaped(F.col(f"`{own}`"), df.schema[own].dataType, T._parse_datatype_string(c.type))
        else:
            value = (F.lit(None) if c.default is None else F.expr(c.default)).cast(c.type)
        if not c.nullable:
            value = F.when(value.isNull(), F.raise_error(F.lit(f"null in column {c.name}")).cast(c.type)).otherwise(value)
        out.append(value.alias(f"c{c.id}"))
    return df.select(*out, *extra)


def types_of(table: Table) -> dict[str, str]:
    return {str(c.id): c.type for c in table.columns}


def inlined(df: DataFrame, limit: int, extra: str | None = None) -> list | None:
    """The rows of a physical DataFrame as JSON texts, with `extra` if given, if there are at most `limit` of small ones."""
    if limit <= 0:
        return None
    text = F.to_json(F.struct(*(c for c in df.columns if c != extra)), JSON_OPTIONS)
    rows = df.select(text.alias("d"), *([extra] if extra else [])).limit(limit + 1).collect()
    sizes = [2 * len((r["d"] or "").encode()) for r in rows]
    if len(rows) > limit or any(s > ROW_BYTES for s in sizes) or sum(sizes) > BATCH_BYTES:
        return None
    return [(r[extra], r["d"]) if extra else r["d"] for r in rows]


def leaves(name: SparkColumn, kind: T.DataType, path: str) -> list[tuple[str, SparkColumn, SparkColumn, SparkColumn | None]]:
    """(path, least, greatest, null test) of a column's leaves that have an order: its fields, and its lists' elements."""
    if isinstance(kind, T.StructType):
        return [x for f in kind.fields for x in leaves(name[f.name], f.dataType, f"{path}.{f.name}")]
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, ORDERED):
        return [(f"{path}.element", F.array_min(name), F.array_max(name), F.exists(name, lambda x: x.isNull()) | name.isNull())]
    if isinstance(kind, ORDERED):
        return [(path, name, name, name.isNull())]
    return [(path, F.lit(None).cast("string"), F.lit(None).cast("string"), name.isNull())]


def file_stats(spark: SparkSession, folder: str, schema: T.StructType, columns: dict[str, str], parts: dict[str, SparkColumn] | None = None, shapes: tuple[str, ...] = (), key: str | None = None) -> dict[str, tuple]:
    """{file name: (rows, {path: {nulls, min, max, nan}}, partition values)} by one aggregation over what was written.
    columns: id by name; parts: partition values by their keys, one for a file; shapes: names of columns of WKT, whose box
    and types are kept as `geo`; key: of encrypted files."""
    hidden = T.StructType([T.StructField(f.name, T.BinaryType() if key and f.name in columns else f.dataType) for f in schema.fields])
    df = spark.read.schema(hidden).option("recursiveFileLookup", "true").parquet(folder)
    if key:
        df = df.select("*", "_metadata").withColumns({f.name: decrypted(F.col(f.name), key, f.dataType.simpleString(), JSON_OPTIONS) for f in schema.fields if f.name in columns})
    found = [(p, *rest, isinstance(f.dataType, T.FloatType | T.DoubleType)) for f in schema.fields if f.name in columns for p, *rest in leaves(F.col(f"`{f.name}`"), f.dataType, columns[f.name])]
    exprs = [F.count("*").alias("n"), *(F.max(marked(v)).alias(f"p{i}") for i, v in enumerate((parts or {}).values()))]
    for i, (_, low, high, null, real) in enumerate(found):
        value = F.when(F.isnan(low), None).otherwise(low) if real else low
        above = F.when(F.isnan(high), None).otherwise(high) if real else high
        exprs += [F.min(value).cast("string").alias(f"l{i}"), F.max(above).cast("string").alias(f"h{i}"), F.count_if(null).alias(f"z{i}")]
        exprs.append(F.coalesce(F.bool_or(F.isnan(low)), F.lit(False)).alias(f"a{i}") if real else F.lit(False).alias(f"a{i}"))
    exprs += [F.to_json(F.struct(*geometry_stats(F.col(n)))).alias(f"g{columns[n]}") for n in shapes]
    # least and greatest texts are aggregated by sorting all rows, except beside an aggregate that keeps objects
    exprs.append(F.collect_set(F.lit(None).cast("string")).alias("unsorted"))
    out = {}
    for r in df.groupBy(file_name().alias("f")).agg(*exprs).collect():
        stats = {p: {"nulls": r[f"z{i}"], "min": r[f"l{i}"], "max": r[f"h{i}"], **({"nan": True} if r[f"a{i}"] else {})} for i, (p, *_) in enumerate(found)}
        for n in shapes:
            stats[columns[n]]["geo"] = r[f"g{columns[n]}"]
        out[r["f"]] = (r["n"], stats, {k: unmarked(r[f"p{i}"]) for i, k in enumerate(parts or {})})
    return out


def stage(spark: SparkSession, store: Store, table: Table, df: DataFrame, lineage: bool = False, origin: str = "write", sources: tuple[str, ...] = (), encrypt: bool = False) -> list[dict]:
    """Writes physical rows in the table's partitions and sort order; the descriptions of the files, empty ones left out.

    With encrypt the values are encrypted by a new key, which only the log knows. A partitioned write first brings a partition's rows together, in tasks that Spark sizes and splits by itself.
    """
    names = {str(c.id): c for c in table.columns}
    parts = {}
    for column, name, argument in table.partition:
        if str(column) in names:
            parts[f"{column}:{name}" + (f":{argument}" if argument else "")] = transform(F.col(f"c{column}"), name, argument)
    schema, part = df.schema, ["part"] if parts else []
    if parts:
        df = df.withColumn("part", F.md5(F.concat_ws("/", *(F.md5(marked(v)) for v in parts.values())))).hint("rebalance", "part")
    order = [_order(table, *s) for s in table.sort]
    if order:
        df = df if parts else df.hint("rebalance")
        df = df.sortWithinPartitions(*part, *order, *(["_row_id"] if lineage else []))
    folder = f"data/{table.id}/{uuid.uuid4().hex}"
    key = secrets.token_hex(16) if encrypt else None
    if key:
        df = df.withColumns({f"c{c.id}": encrypted(F.col(f"c{c.id}"), key, JSON_OPTIONS) for c in table.columns})
    writer = df.write
    (writer.partitionBy(*part) if parts else writer).parquet(f"{store.root}/{folder}")
    files = store.files(folder)
    if not files:
        return []
    stats = file_stats(spark, f"{store.root}/{folder}", schema, {f"c{c.id}": str(c.id) for c in table.columns}, parts, tuple(f"c{c.id}" for c in table.columns if c.geometry), key)
    out = []
    for path, size, _ in files:
        name = "/".join(path.split("/")[-2:])
        if name not in stats:
            store.delete(path)
            continue
        rows, found, held = stats[name]
        out.append({
            "name": name, "path": path, "table": table.id, "rows": rows, "bytes": size, "types": types_of(table), "lineage": lineage, "origin": origin,
            "partition": held if parts else None, "partition_version": table.partition_version if parts else None, "stats": found, "sources": list(sources), "key": key,
        })
    return out


def _order(table: Table, text: str, descending: bool, nulls_first: bool) -> SparkColumn:
    """A sort key over column names as one over physical names."""
    for c in sorted(table.columns, key=lambda c: -len(c.name)):
        text = re.sub(rf"(?<![\w`]){re.escape(c.name)}(?![\w`])", f"`c{c.id}`", text, flags=re.IGNORECASE)
    e = F.expr(text)
    if descending:
        return e.desc_nulls_first() if nulls_first else e.desc_nulls_last()
    return e.asc_nulls_first() if nulls_first else e.asc_nulls_last()
