"""A table at a version as one DataFrame: its files, pruned, without deleted rows, and its inlined rows."""

from __future__ import annotations

import json
from collections import defaultdict

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cipher import decrypted
from ..plans.prune import matches, parse, with_buckets
from ..state import Column, Deletes, File, InlineRow, LakeError, State, Table

#: A list of files up to this long is broadcast; each entry has a few dozen bytes.
BROADCAST_FILES = 100_000
JSON_OPTIONS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "true"}
LINEAGE = ("_row_id", "_snapshot_id", "_file", "_pos")


def file_name() -> SparkColumn:
    """A file's name in the lake: its last two path steps, since the files of one write to several partitions share the last."""
    return F.substring_index(F.col("_metadata.file_path"), "/", -2)


def literal_rows(spark: SparkSession, rows: list[dict], ddl: str) -> DataFrame:
    """Rows from the driver as a plan without Python: one JSON literal that the JVM parses."""
    text = json.dumps(rows)
    return spark.range(1, numPartitions=1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{ddl}>>")))


def initial(column: Column) -> SparkColumn:
    return (F.lit(None) if column.initial is None else F.expr(column.initial)).cast(column.type)


def reshaped(value: SparkColumn, old: T.DataType, new: T.DataType) -> SparkColumn:
    """A value of an older type as the newer one: structs by their fields' names, missing fields null; all else by cast."""
    if old == new:
        return value
    if isinstance(old, T.StructType) and isinstance(new, T.StructType):
        have = {f.name: f.dataType for f in old.fields}
        fields = [(reshaped(value[f.name], have[f.name], f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in new.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(old, T.ArrayType) and isinstance(new, T.ArrayType):
        return F.transform(value, lambda x: reshaped(x, old.elementType, new.elementType))
    if isinstance(old, T.MapType) and isinstance(new, T.MapType):
        return F.transform_values(value, lambda k, x: reshaped(x, old.valueType, new.valueType)).cast(new)
    return value.cast(new)


def projected(columns: tuple[Column, ...], types: dict[str, str], constants: dict[str, str | None] | None = None) -> list[SparkColumn]:
    """The table's columns from what a file or inlined row has; old types are cast, missing columns get what they began with."""
    out = []
    for c in columns:
        if constants and str(c.id) in constants:
            value = F.lit(constants[str(c.id)]).cast(c.type)
        elif str(c.id) in types:
            old, new = T._parse_datatype_string(types[str(c.id)]), T._parse_datatype_string(c.type)
            value = F.col(f"c{c.id}") if types[str(c.id)] == c.type else reshaped(F.col(f"c{c.id}"), old, new)
        else:
            value = initial(c)
        out.append(value.alias(c.name))
    return out


def delete_rows(spark: SparkSession, root: str, deletes: list[Deletes], files: set[str], ddl: str = "_begin") -> DataFrame | None:
    """(d_file, d_pos, _begin) of the deleted rows of some files."""
    parts = []
    few = [{"d_file": n, "d_pos": p, "_begin": d.begin} for d in deletes for n, p in d.rows if n in files]
    if few:
        parts.append(literal_rows(spark, few, "d_file string, d_pos bigint, _begin bigint"))
    for d in deletes:
        if d.path and files & set(d.counts):
            parts.append(spark.read.schema("d_file string, d_pos bigint").parquet(f"{root}/{d.path}").select("d_file", "d_pos", F.lit(d.begin).cast("bigint").alias("_begin")))
    if not parts:
        return None
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_files(spark: SparkSession, root: str, table: Table, files: list[File], deletes: list[Deletes], lineage: bool, limit: int | None = None) -> DataFrame | None:
    """The live rows of some files. Files of one physical schema are read together; only those with deleted rows carry
    places and join the deletes. limit keeps rows of versions up to it, for merged files."""
    hit = {n for d in deletes for n in d.counts}
    groups: dict[tuple, list[File]] = defaultdict(list)
    for f in files:
        key = (tuple(sorted(f.types.items())), f.lineage, json.dumps(f.names, sort_keys=True), json.dumps(f.constants, sort_keys=True), f.name in hit, f.key)
        groups[key].append(f)
    parts = []
    for group in groups.values():
        one = group[0]
        types = dict(one.types)
        names = one.names or {}
        stored = [f"`{names.get(i, f'c{i}')}` {'binary' if one.key else t}" for i, t in sorted(types.items(), key=lambda x: int(x[0]))]
        if one.lineage:
            stored += ["_row_id bigint", "_snapshot_id bigint"]
        paths = [f.path if "://" in f.path or f.path.startswith("/") else f"{root}/{f.path}" for f in group]
        placed = lineage or one.name in hit
        if stored:
            df = spark.read.schema(", ".join(stored)).parquet(*paths)
        else:
            df = spark.read.parquet(*paths)
        extra = [file_name().alias("_file"), F.col("_metadata.row_index").alias("_pos")] if placed else []
        clear = (lambda v, t, k=one.key: decrypted(v, k, t, JSON_OPTIONS)) if one.key else (lambda v, t: v)
        df = df.select(*(clear(F.col(f"`{names.get(i, f'c{i}')}`"), t).alias(f"c{i}") for i, t in types.items()), *(["_row_id", "_snapshot_id"] if one.lineage else []), *extra)
        if one.name in hit:
            gone = delete_rows(spark, root, deletes, {f.name for f in group})
            few = sum(d.counts.get(f.name, 0) for d in deletes for f in group) <= BROADCAST_FILES
            df = df.join(F.broadcast(gone) if few else gone, (F.col("_file") == F.col("d_file")) & (F.col("_pos") == F.col("d_pos")), "left_anti")
        if one.lineage:
            begins = {f.begin for f in group}
            if len(begins) == 1:
                df = df.withColumn("_snapshot_id", F.coalesce("_snapshot_id", F.lit(one.begin).cast("bigint")))
            elif lineage or limit is not None:
                df = _with_map(spark, df, group).withColumn("_snapshot_id", F.coalesce("_snapshot_id", "m_begin"))
            if limit is not None:
                df = df.where(F.col("_snapshot_id") <= limit)
        if lineage and not one.lineage:
            df = _with_map(spark, df, group).withColumn("_row_id", F.col("m_start") + F.col("_pos")).withColumn("_snapshot_id", F.col("m_begin"))
        parts.append(df.select(*projected(table.columns, types, one.constants), *([F.col(c) for c in LINEAGE] if lineage else [])))
    if not parts:
        return None
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _with_map(spark: SparkSession, df: DataFrame, group: list[File]) -> DataFrame:
    if len(group) == 1:
        return df.withColumns({"m_start": F.lit(group[0].row_start).cast("bigint"), "m_begin": F.lit(group[0].begin).cast("bigint")})
    rows = literal_rows(spark, [{"m_file": f.name, "m_start": f.row_start, "m_begin": f.begin} for f in group], "m_file string, m_start bigint, m_begin bigint")
    return df.join(F.broadcast(rows) if len(group) <= BROADCAST_FILES else rows, F.col("_file") == F.col("m_file"))


def read_inline(spark: SparkSession, table: Table, rows: list[InlineRow], lineage: bool) -> DataFrame | None:
    groups: dict[tuple, list[InlineRow]] = defaultdict(list)
    for r in rows:
        groups[tuple(sorted(r.types.items()))].append(r)
    out = None
    for types, group in groups.items():
        ddl = ", ".join(f"c{i} {t}" for i, t in types)
        found = literal_rows(spark, [{"r": r.row, "b": r.begin, "d": r.data} for r in group], "r bigint, b bigint, d string")
        found = found.select(F.col("r").alias("_row_id"), F.col("b").alias("_snapshot_id"), F.lit(None).cast("string").alias("_file"), F.lit(None).cast("bigint").alias("_pos"), F.from_json("d", ddl, JSON_OPTIONS).alias("d"))
        found = found.select(*LINEAGE, "d.*").select(*projected(table.columns, dict(types)), *(LINEAGE if lineage else []))
        out = found if out is None else out.unionByName(found)
    return out


def visible_files(state: State, head: State, table: Table) -> list[tuple[File, int | None]]:
    """(file, limit) of a table's files at a state. A merged file stands in for sources whose Parquet files are cleaned;
    limit then keeps its rows of versions up to the state's."""
    out, stand_in = [], {}
    for f in state.table_files(table.id):
        if f.name not in head.cleaned:
            out.append((f, None))
            continue
        name = f.name
        while name in head.cleaned:
            later = [g for g in [*head.files.values(), *(e.what for e in head.ended_files.values())] if name in g.sources]
            if not later:
                raise LakeError(f"version {state.version} needs {f.name}, which was cleaned up")
            name = later[0].name
            stand_in[name] = later[0]
    out += [(g, state.version) for n, g in stand_in.items() if n not in head.cleaned]
    return out


def scan(spark: SparkSession, root: str, state: State, head: State, table: Table, where: str | None = None, lineage: bool = False, tree: tuple | None = None) -> DataFrame:
    """The table's rows at a state. where prunes files and filters rows; tree, a predicate as parsed, only prunes; lineage adds `_row_id`, `_snapshot_id` and, for
    rows of files, `_file` and `_pos`."""
    if where:
        tree = with_buckets(spark, parse(spark, where), table)
    found = visible_files(state, head, table)
    if tree is not None:
        found = [(f, n) for f, n in found if matches(tree, f, table)]
    deletes = state.table_deletes(table.id)
    parts = [read_files(spark, root, table, [f for f, n in found if n is None], deletes, lineage), read_inline(spark, table, state.table_inline(table.id), lineage)]
    if late := [f for f, n in found if n is not None]:
        parts.append(read_files(spark, root, table, late, deletes, lineage, state.version))
    parts = [p for p in parts if p is not None]
    if not parts:
        ddl = ", ".join([*(f"`{c.name}` {c.type}" for c in table.columns), *(["_row_id bigint, _snapshot_id bigint, _file string, _pos bigint"] if lineage else [])])
        out = literal_rows(spark, [], ddl) if ddl else spark.range(0).select()
    else:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
    return out.where(where) if where else out
