"""Row mutations of one transaction: INSERT, DELETE, UPDATE and MERGE."""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scan import LINEAGE, scan
from ..sources.write import inlined, physical, stage, types_of
from ..state import LakeError, Table

#: A delete of up to this many rows of files is kept in the log.
FEW_DELETES = 1000
Value = str | Column


def _expr(value: Value) -> Column:
    return F.expr(value) if isinstance(value, str) else value


def insert(tx, name: str, df: DataFrame) -> None:
    """Appends df's rows by column name. A batch within the inlining limit goes to the log, any other to files."""
    table = tx.state.table(name)
    rows = physical(table, df)
    small = inlined(rows, tx.limit(table))
    if small is not None:
        if small:
            tx.do({"op": "inline", "table": table.id, "types": types_of(table), "rows": small}, tag=("inlined_insert", table))
        return
    tx.do([{"op": "file", "file": f} for f in stage(tx.spark, tx.store, table, rows, encrypt=tx.encrypted(table))], tag=("inserted_into_table", table))


def rows_of(tx, table: Table, where: str | None = None) -> DataFrame:
    return scan(tx.spark, tx.store.root, tx.state, tx.head(), table, where, lineage=True)


def remove(tx, table: Table, hit: DataFrame) -> int:
    """Deletes the rows of hit (_row_id, _file, _pos); the number of them. A file that loses its last row ends."""
    hit = hit.select("_row_id", "_file", "_pos")
    few = hit.limit(FEW_DELETES + 1).collect()
    if not few:
        return 0
    action = {"op": "deletes", "id": uuid.uuid4().hex, "table": table.id}
    if len(few) <= FEW_DELETES:
        placed = [(r["_file"], r["_pos"]) for r in few if r["_file"] is not None]
        loose = [r["_row_id"] for r in few if r["_file"] is None]
        counts: dict[str, int] = {}
        for f, _ in placed:
            counts[f] = counts.get(f, 0) + 1
        action["rows"] = placed
    else:
        path = f"data/{table.id}/deletes-{action['id']}"
        hit.where("_file is not null").select(F.col("_file").alias("d_file"), F.col("_pos").alias("d_pos")).write.parquet(f"{tx.store.root}/{path}")
        found = tx.spark.read.schema("d_file string, d_pos bigint").parquet(f"{tx.store.root}/{path}")
        counts = {r["d_file"]: r["n"] for r in found.groupBy("d_file").agg(F.count("*").alias("n")).collect()}
        loose = [r["_row_id"] for r in hit.where("_file is null").select("_row_id").collect()]
        action["path"], action["bytes"] = path, sum(n for _, n, _ in tx.store.files(path))
    before: dict[str, int] = {}
    for d in tx.state.table_deletes(table.id):
        for f, n in d.counts.items():
            before[f] = before.get(f, 0) + n
    whole = {f for f, n in counts.items() if n + before.get(f, 0) == tx.state.files[f].rows}
    action["counts"] = {f: n for f, n in counts.items() if f not in whole}
    if "rows" in action:
        action["rows"] = [x for x in action["rows"] if x[0] not in whole]
    if action["counts"]:
        tx.do(action, tag=("deleted_from_table", table))
    tx.do([{"op": "end_file", "table": table.id, "name": f, "why": "delete"} for f in sorted(whole)], tag=("deleted_from_table", table))
    if loose:
        tx.do({"op": "end_inline", "table": table.id, "rows": loose, "why": "delete"}, tag=("inlined_delete", table))
    return sum(counts.values()) + len(loose)


def delete(tx, name: str, where: str | None = None) -> int:
    """Deletes the rows for which `where` is true; all without it."""
    table = tx.state.table(name)
    return remove(tx, table, rows_of(tx, table, where))


def put_again(tx, table: Table, rows: DataFrame) -> list[dict]:
    """Actions that write new values of rows under their old ids."""
    values = physical(table, rows, ("_row_id",))
    small = inlined(values, tx.limit(table), "_row_id")
    if small is not None:
        return [{"op": "inline_again", "table": table.id, "types": types_of(table), "rows": small}] if small else []
    values = values.withColumn("_snapshot_id", F.lit(None).cast("bigint"))
    return [{"op": "file", "file": f} for f in stage(tx.spark, tx.store, table, values, lineage=True, encrypt=tx.encrypted(table))]


def update(tx, name: str, values: Mapping[str, Value], where: str | None = None) -> int:
    """Sets columns of the rows for which `where` is true; rows keep their ids, and expressions see the old values."""
    table = tx.state.table(name)
    for c in values:
        table.column(c)
    hit = rows_of(tx, table, where)
    new = {c.lower(): _expr(v) for c, v in values.items()}
    rows = hit.select(*(new.get(c.name.lower(), F.col(f"`{c.name}`")).alias(c.name) for c in table.columns), "_row_id")
    actions = put_again(tx, table, rows)
    n = remove(tx, table, hit)
    tx.do(actions, tag=("inserted_into_table", table))
    return n


@dataclass(frozen=True)
class When:
    """A clause of MERGE. matched: of pairs or of source rows without a target row; where: an extra condition; delete or
    values: what to do. Expressions name target columns `t.x` and source columns `s.x`; None sets all columns by name."""

    matched: bool
    values: Mapping[str, Value] | None = None
    delete: bool = False
    where: str | None = None


def merge(tx, name: str, source: DataFrame, on: str, clauses: list[When]) -> dict[str, int]:
    """MERGE INTO name t USING source s ON on: the first clause that fits each row acts. A target row that several source
    rows would change is an error. The join runs once: what it says is written beside the table until the commit."""
    table = tx.state.table(name)
    target = rows_of(tx, table).alias("t")
    source = source.alias("s")
    names = [c.name for c in table.columns]
    there = {c.lower() for c in source.columns}

    def setting(clause: When, c: str) -> Column:
        if clause.values is None:
            return F.col(f"s.`{c}`") if c.lower() in there else (F.col(f"t.`{c}`") if clause.matched else F.lit(None))
        given = {k.lower(): _expr(v) for k, v in clause.values.items()}
        return given.get(c.lower(), F.col(f"t.`{c}`") if clause.matched else default(c))

    def default(c: str) -> Column:
        column = table.column(c)
        return F.lit(None).cast(column.type) if column.default is None else F.expr(column.default)

    def act(matched: bool) -> Column:
        out = F.lit(None).cast("int")
        for i, c in reversed([(i, c) for i, c in enumerate(clauses) if c.matched == matched]):
            out = F.when(F.expr(c.where), F.lit(i)).otherwise(out) if c.where else F.lit(i)
        return out

    def value(c: str) -> Column:
        out = F.lit(None)
        for i, clause in enumerate(clauses):
            if not clause.delete:
                out = F.when(F.col("_act") == i, setting(clause, c)).otherwise(out)
        return out.cast(table.column(c).type).alias(c)

    kind = "left" if any(not c.matched for c in clauses) else "inner"
    met = source.join(target, F.expr(on), kind).withColumn("_act", F.when(F.col("t._row_id").isNotNull(), act(True)).otherwise(act(False))).where("_act is not null")
    place = f"data/{table.id}/merge-{uuid.uuid4().hex}"
    met.select("_act", *(F.col(f"t.{c}").alias(c) for c in LINEAGE), *map(value, names)).write.parquet(f"{tx.store.root}/{place}")
    tx.after.append(place)
    met = tx.spark.read.parquet(f"{tx.store.root}/{place}")
    of = lambda *which: met.where(F.col("_act").isin([i for i, c in enumerate(clauses) if (c.matched, c.delete) in which]))
    if met.where("_row_id is not null").groupBy("_row_id").count().where("count > 1").head(1):
        raise LakeError("several source rows match one target row")
    actions = put_again(tx, table, of((True, False)).select(*names, "_row_id")) if any(c.matched and not c.delete for c in clauses) else []
    rows = physical(table, of((False, False)).select(*names))
    small, fresh = inlined(rows, tx.limit(table)), []
    if small is None:
        fresh = [{"op": "file", "file": f} for f in stage(tx.spark, tx.store, table, rows, encrypt=tx.encrypted(table))]
    elif small:
        fresh = [{"op": "inline", "table": table.id, "types": types_of(table), "rows": small}]
    gone = remove(tx, table, of((True, False), (True, True)))
    size = lambda found: sum(len(a["rows"]) if "rows" in a else a["file"]["rows"] for a in found)
    tx.do(actions, tag=("inserted_into_table", table))
    tx.do(fresh, tag=("inserted_into_table", table))
    return {"updated": size(actions), "deleted": gone - size(actions), "inserted": size(fresh)}
