"""The change feed: which rows came and went in the versions of an inclusive window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scan import LINEAGE, delete_rows, literal_rows, read_files, read_inline
from ..state import Ended, LakeError, State, Table

COMPACT = ("merge", "rewrite", "flush")


def _empty(spark, table: Table) -> DataFrame:
    columns = ", ".join(f"`{c.name}` {c.type}" for c in table.columns)
    return literal_rows(spark, [], f"{columns}, _row_id bigint, _snapshot_id bigint, _file string, _pos bigint")


def _union(spark, table: Table, parts: list[DataFrame | None]) -> DataFrame:
    out = _empty(spark, table)
    found = [p for p in parts if p is not None]
    for i, p in enumerate(found):
        out = p if i == 0 else out.unionByName(p)
    return out


def _files(state: State, table: Table) -> list[tuple]:
    """(file, end) of all files that the table ever had."""
    return [(f, None) for f in state.table_files(table.id)] + [(e.what, e) for e in state.ended_files.values() if e.what.table == table.id]


def insertions(spark, root: str, state: State, table: Table, start: int, end: int) -> DataFrame:
    """The rows that versions start to end inserted, as they were, with LINEAGE; an update's new values count too.

    Rows are read where they were first written; flushes and compactions add none. A file whose Parquet was cleaned up is
    read from the file that replaced it, by its rows' versions.
    """
    first, moved = [], []
    for f, _ in _files(state, table):
        if f.origin in COMPACT:
            continue
        if not start <= f.begin <= end:
            continue
        if f.name not in state.cleaned:
            first.append(f)
            continue
        name = f.name
        while name in state.cleaned:
            later = [g for g, _ in _files(state, table) if name in g.sources]
            if not later:
                raise LakeError(f"the files of version {f.begin} were cleaned up")
            name = later[0].name
        moved.append(name)
    stand_in = [g for g, _ in _files(state, table) if g.name in moved]
    late = read_files(spark, root, table, stand_in, [], True)
    if late is not None:
        late = late.where(F.col("_snapshot_id").between(start, end))
    own = [r for r in state.table_inline(table.id)] + [e.what for e in state.ended_inline if e.what.table == table.id]
    rows = [r for r in own if start <= r.begin <= end]
    return _union(spark, table, [read_files(spark, root, table, first, [], True), late, read_inline(spark, table, rows, True)])


def deletions(spark, root: str, state: State, table: Table, start: int, end: int) -> DataFrame:
    """The rows that versions start to end deleted, as they were, with LINEAGE; `_snapshot_id` is the deleting version.

    Rows of delete lists begun in the window, rows of files that ended in it and weren't deleted before, and inlined rows.
    """
    parts = []
    lists = [d for d in state.table_deletes(table.id) if start <= d.begin <= end]
    hit = {n for d in lists for n in d.counts}
    partial = [f for f, _ in _files(state, table) if f.name in hit]
    if gone := [f.name for f in partial if f.name in state.cleaned]:
        raise LakeError(f"file {gone[0]} was cleaned up")
    if partial:
        places = delete_rows(spark, root, lists, {f.name for f in partial})
        rows = read_files(spark, root, table, partial, [], True)
        met = rows.join(places, (F.col("_file") == F.col("d_file")) & (F.col("_pos") == F.col("d_pos")))
        parts.append(met.withColumn("_snapshot_id", F.col("_begin")).drop("d_file", "d_pos", "_begin"))
    whole = [(f, e) for f, e in _files(state, table) if e and e.why == "delete" and start <= e.version <= end]
    for version in sorted({e.version for _, e in whole}):
        files = [f for f, e in whole if e.version == version]
        before = [d for d in state.table_deletes(table.id) if d.begin < version]
        rows = read_files(spark, root, table, files, before, True)
        parts.append(rows.withColumn("_snapshot_id", F.lit(version).cast("bigint")))
    ended: list[Ended] = [e for e in state.ended_inline if e.what.table == table.id and e.why == "delete" and start <= e.version <= end]
    if ended:
        inline = read_inline(spark, table, [e.what for e in ended], True)
        when = literal_rows(spark, [{"r": e.what.row, "b": e.what.begin, "e": e.version} for e in ended], "r bigint, b bigint, e bigint")
        met = inline.join(F.broadcast(when) if len(ended) <= 10_000 else when, (F.col("_row_id") == F.col("r")) & (F.col("_snapshot_id") == F.col("b")))
        parts.append(met.withColumn("_snapshot_id", F.col("e")).drop("r", "b", "e"))
    return _union(spark, table, parts)


def changes(spark, root: str, state: State, table: Table, start: int, end: int) -> DataFrame:
    """(snapshot_id, rowid, change_type, columns): insertions and deletions together. A row that one version both deleted
    and inserted was updated; its two rows are its pre- and postimage."""
    came = insertions(spark, root, state, table, start, end).withColumn("_kind", F.lit("insert"))
    went = deletions(spark, root, state, table, start, end).withColumn("_kind", F.lit("delete"))
    both = came.unionByName(went)
    same = Window.partitionBy("_snapshot_id", "_row_id")
    pair = (F.min("_kind").over(same) == "delete") & (F.max("_kind").over(same) == "insert")
    kind = F.when(pair, F.when(F.col("_kind") == "insert", "update_postimage").otherwise("update_preimage")).otherwise(F.col("_kind"))
    return both.select(F.col("_snapshot_id").alias("snapshot_id"), F.col("_row_id").alias("rowid"), kind.alias("change_type"), *(f"`{c.name}`" for c in table.columns))


def plain(rows: DataFrame) -> DataFrame:
    """Feed rows with the names that users see."""
    kept = [c for c in rows.columns if c not in LINEAGE]
    return rows.select(F.col("_snapshot_id").alias("snapshot_id"), F.col("_row_id").alias("rowid"), *(f"`{c}`" for c in kept))


def file_changes(state: State, table: Table, visible: bool = False) -> list[dict]:
    """(version, change, file, rows) in order; visible leaves out versions that both add and remove, such as rewrites."""
    out = [{"version": f.begin, "change": "added", "file": f.name, "rows": f.rows} for f, _ in _files(state, table)]
    out += [{"version": e.version, "change": "removed", "file": f.name, "rows": f.rows} for f, e in _files(state, table) if e]
    if visible:
        kinds: dict[int, set[str]] = {}
        for r in out:
            kinds.setdefault(r["version"], set()).add(r["change"])
        out = [r for r in out if len(kinds[r["version"]]) == 1]
    return sorted(out, key=lambda r: (r["version"], r["change"], r["file"]))
