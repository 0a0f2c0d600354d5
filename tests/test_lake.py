import threading

import pytest
from pyspark.sql import functions as F

from tidemark import ConflictError, Lake, LakeError, When
from tidemark.operators import maintain
from tidemark.sources import scan


@pytest.fixture
def lake(spark, tmp_path):
    out = Lake(spark, str(tmp_path / "lake"))
    out.set_option("data_inlining_row_limit", 0)
    return out


def rows(spark, data, ddl="id int, qty int"):
    return spark.createDataFrame(data, ddl)


def held(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(params=[0, 10])
def items(lake, spark, request):
    """insert 3, update two, delete one, insert one: in files, and inlined."""
    lake.set_option("data_inlining_row_limit", request.param)
    lake.create_table("items", "id int, qty int")
    lake.start = lake.version()
    lake.insert("items", rows(spark, [(1, 10), (2, 20), (3, 30)]))
    lake.update("items", {"qty": "qty + 100"}, "id <= 2")
    lake.updated = lake.version()
    lake.delete("items", "id = 3")
    lake.insert("items", rows(spark, [(4, 40)]))
    return lake


def test_mutations_and_feed(items):
    assert held(items.table("items")) == [(1, 110), (2, 120), (4, 40)]
    assert items.table("items", version=items.updated).agg(F.count("*"), F.sum("qty")).first()[:] == (3, 260)
    feed = items.changes("items", 0).groupBy("change_type").agg(F.count("*"), F.sum("qty"))
    assert held(feed) == [("delete", 1, 30), ("insert", 4, 100), ("update_postimage", 2, 230), ("update_preimage", 2, 30)]
    assert items.count("items") == 3


def test_row_ids_survive(items):
    before = dict(items.table("items", lineage=True).select("id", "_row_id").collect())
    items.flush_inlined("items")
    items.merge_adjacent("items")
    items.delete("items", "id = 2")
    items.rewrite_deleted("items", threshold=0.0)
    after = dict(items.table("items", lineage=True).select("id", "_row_id").collect())
    assert after == {k: v for k, v in before.items() if k != 2}


def test_every_version_after_maintenance(items):
    versions = [v for v in range(items.start, items.version() + 1)]
    was = {v: held(items.table("items", version=v)) for v in versions}
    feed = held(items.changes("items", 0).drop("rowid"))
    items.flush_inlined("items")
    items.merge_adjacent("items")
    assert {v: held(items.table("items", version=v)) for v in versions} == was
    items.cleanup_old_files()
    assert {v: held(items.table("items", version=v)) for v in versions} == was
    assert held(items.changes("items", 0).drop("rowid")) == feed


def test_statistics_sort_no_rows(lake, spark, monkeypatch):
    """Least and greatest texts would be found by sorting all rows of a written file in the memory of one task."""
    lake.create_table("t", "id bigint, name string")
    plans, kind = [], type(spark.range(1))
    collect = kind.collect
    monkeypatch.setattr(kind, "collect", lambda self: [plans.append(self._jdf.queryExecution().executedPlan().toString()), collect(self)][1])
    lake.insert("t", spark.range(100).selectExpr("id", "concat('n', id) AS name"))
    lake.insert("t", spark.range(100, 200).selectExpr("id", "concat('n', id) AS name"))
    lake.merge_adjacent("t")
    found = [p for p in plans if "min(c" in p]
    assert len(found) == 3 and not any("Sort" in p for p in found)
    assert held(lake.file_stats("t").where("column = 'name'").agg(F.min("min"), F.max("max"), F.sum("rows"))) == [("n0", "n99", 200)]


@pytest.mark.parametrize("most", [0, 100_000])
def test_files_are_rewritten_at_once(lake, spark, monkeypatch, most):
    """However many files lost rows, one write takes them all; with a list of deleted rows to broadcast and one to join."""
    for module in (scan, maintain):
        monkeypatch.setattr(module, "BROADCAST_FILES", most, raising=False)
    lake.create_table("t", "id bigint, name string")
    for i in range(4):
        lake.insert("t", spark.range(1000 * i, 1000 * i + 1000).selectExpr("id", "concat('n', id) AS name"))
    lake.delete("t", "id % 2 = 0 AND id < 3000")
    version, was = lake.version(), held(lake.table("t", lineage=True).drop("_file", "_pos"))
    writes, stage = [], maintain.stage
    monkeypatch.setattr(maintain, "stage", lambda *a, **b: writes.append(1) or stage(*a, **b))
    files = len(lake.files("t"))
    lost = len([f for f in lake.files("t") if int(f.stats[str(lake.state().table("t").column("id").id)]["max"]) < 3000])
    assert lake.rewrite_deleted("t") == lost < files and len(writes) == 1
    assert lake.global_stats("t")["deleted"] == 0 and len(lake.files("t")) == files - lost + 1
    assert held(lake.table("t", lineage=True).drop("_file", "_pos")) == was
    assert held(lake.table("t", version=version, lineage=True).drop("_file", "_pos")) == was
    assert lake.rewrite_deleted("t") == 0


def test_compaction_then_cleanup(lake, spark):
    """Four files, of which the first two lose rows, so only the last two merge; cleanup lists these and then none."""
    lake.create_table("f", "id bigint, amount bigint")
    at = 0
    for n in (5, 10, 20, 9965):
        lake.insert("f", spark.range(at + 1, at + n + 1, numPartitions=1).selectExpr("id", "id AS amount"))
        at += n
    version = lake.version()
    lake.delete("f", "id = 3")
    lake.delete("f", "id IN (9, 10)")
    assert lake.merge_adjacent("f") == 2
    assert lake.table("f").agg(F.count("*"), F.sum("amount")).first()[:] == (9997, 50004978)
    assert len(lake.cleanup_old_files(dry_run=True)) == 2
    assert len(lake.cleanup_old_files()) == 2
    assert lake.cleanup_old_files() == []
    assert lake.table("f").agg(F.count("*"), F.sum("amount")).first()[:] == (9997, 50004978)
    assert lake.table("f", version=version).agg(F.count("*"), F.sum("amount")).first()[:] == (10000, 50005000)


@pytest.mark.parametrize(("length", "n", "files"), [(45_000, 1, 0), (65_536, 1, 1), (40_000, 100, 1)])
def test_inlining_limits(lake, spark, length, n, files):
    lake.set_option("data_inlining_row_limit", 1000)
    lake.create_table("t", "id int, note string")
    lake.insert("t", spark.range(n, numPartitions=1).select(F.col("id").cast("int"), F.repeat(F.lit("x"), length).alias("note")))
    assert len(lake.files("t")) == files
    assert lake.table("t").agg(F.count("*"), F.max(F.length("note"))).first()[:] == (n, length)


def test_inlined_values_keep_their_types(lake, spark):
    lake.set_option("data_inlining_row_limit", 10)
    df = spark.sql("SELECT 1 AS i, cast('1.250' AS decimal(18,3)) AS d, timestamp_ntz'2024-01-02 03:04:05.678901' AS t, date'2024-02-29' AS day, cast('NaN' AS double) AS x, X'00FF' AS b, array(1, null) AS a, named_struct('k', 'v') AS s, cast(null AS string) AS n, '' AS e")
    lake.create_table_as("t", df)
    assert len(lake.files("t")) == 0
    assert str(lake.table("t").first()) == str(df.first())
    lake.flush_inlined("t")
    assert str(lake.table("t").first()) == str(df.first())


def test_schema_evolution(lake, spark):
    lake.create_table("orders", "id int, qty int, note string", defaults={"qty": "5"})
    lake.insert("orders", rows(spark, [(1, 2), (2, 8)]))
    first = lake.version()
    with lake.transaction() as tx:
        tx.rename_table("orders", "orders_archive")
        tx.rename_column("orders_archive", "qty", "quantity")
        tx.alter_type("orders_archive", "quantity", "bigint")
        tx.set_default("orders_archive", "quantity", "7")
        tx.drop_column("orders_archive", "note")
    lake.insert("orders_archive", rows(spark, [(3,)], "id int"))
    assert lake.table("orders_archive").agg(F.count("*"), F.sum("quantity")).first()[:] == (3, 17)
    assert lake.table("orders", version=first).agg(F.count("*"), F.sum("qty")).first()[:] == (2, 10)
    assert [(c.name, c.type, c.default) for c in lake.state().table("orders_archive").columns] == [("id", "int", None), ("quantity", "bigint", "7")]


def test_nested_fields(lake, spark):
    """Older rows keep each field's value by its name; an absent struct stays absent."""
    lake.create_table("t", "id int, s struct<a:int,b:int>")
    lake.insert("t", spark.sql("SELECT 1 AS id, named_struct('a', 1, 'b', 2) AS s UNION ALL SELECT 2, null"))
    lake.set_option("data_inlining_row_limit", 5)
    lake.insert("t", spark.sql("SELECT 3 AS id, named_struct('a', 5, 'b', 6) AS s"))
    version = lake.version()
    lake.add_column("t", "s.c", "string")
    lake.drop_column("t", "s.a")
    lake.insert("t", spark.sql("SELECT 4 AS id, named_struct('b', 7, 'c', 'x') AS s"))
    assert lake.state().table("t").column("s").type == "struct<b:int,c:string>"
    assert held(lake.table("t").select("id", "s.b", "s.c", F.col("s").isNull())) == [(1, 2, None, False), (2, None, None, True), (3, 6, None, False), (4, 7, "x", False)]
    assert held(lake.table("t", version=version).select("id", "s.a", "s.b").where("id <> 2")) == [(1, 1, 2), (3, 5, 6)]


def test_partition_nulls_and_empty_text(lake, spark):
    lake.create_table("t", "id int, region string", partition_by=["region"])
    lake.insert("t", rows(spark, [(1, "eu"), (2, None), (3, ""), (4, "us/x=1")], "id int, region string"))
    assert len(lake.files("t", where="region = ''")) == 1
    assert held(lake.table("t", where="region = ''").select("id")) == [(3,)]
    assert held(lake.table("t", where="region IS NULL").select("id")) == [(2,)]
    assert held(lake.table("t", where="region = 'us/x=1'").select("id")) == [(4,)]


def test_unpartitioned_files_are_read_too(lake, spark):
    lake.create_table("t", "id int, region string, amount int")
    lake.insert("t", rows(spark, [(1, "eu", 10), (2, "us", 20)], "id int, region string, amount int"))
    lake.set_partitioning("t", ["region"])
    lake.insert("t", rows(spark, [(3, "eu", 30), (4, "eu", 60), (5, "us", 1)], "id int, region string, amount int"))
    assert lake.table("t", where="region = 'eu'").agg(F.count("*"), F.sum("amount")).first()[:] == (3, 100)


def test_pruning_reads_fewer_files(lake, spark):
    lake.create_table("t", "id bigint, x double, d date")
    for i in range(4):
        lake.insert("t", spark.range(i * 10, i * 10 + 10, numPartitions=1).selectExpr("id", "cast(id AS double) / 2 AS x", "date_add(date'2024-01-01', cast(id AS int)) AS d"))
    reads = lambda where: len(lake.files("t", where=where))
    assert reads("id = 15") == 1
    assert reads("id IN (1, 35)") == 2
    assert reads("12 > id OR id >= 38") == 3
    assert reads("id > 5 AND id < 15") == 2
    assert reads("x <= 4.5") == 1
    assert reads("d = date'2024-01-12'") == 1
    assert reads("d >= '2024-01-31'") == 1
    assert reads("id <> 3") == 4
    assert reads("id IS NULL") == 0
    assert reads("id % 2 = 0") == 4
    assert reads("id = 99") == 0
    assert lake.table("t", where="id = 99").count() == 0


def test_nan_is_never_pruned(lake, spark):
    lake.create_table("t", "x double")
    lake.insert("t", spark.sql("SELECT cast('NaN' AS double) AS x UNION ALL SELECT 1.0"))
    assert lake.table("t", where="x > 100").count() == 1


def test_appends_follow_each_other(lake, spark):
    lake.create_table("t", "id bigint")
    frames = [spark.range(i, i + 1) for i in range(6)]
    threads = [threading.Thread(target=lake.insert, args=("t", f)) for f in frames]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert held(lake.table("t")) == [(i,) for i in range(6)]
    ids = [r[0] for r in lake.table("t", lineage=True).select("_row_id").collect()]
    assert len(set(ids)) == 6


def test_conflicts(lake, spark):
    lake.create_table("t", "id bigint")
    lake.insert("t", spark.range(10))
    other = Lake(spark, lake.store.root)
    tx = lake.transaction()
    tx.delete("t", "id = 1")
    other.delete("t", "id = 2")
    with pytest.raises(ConflictError):
        tx.commit()
    tx = lake.transaction()
    tx.insert("t", spark.range(5))
    other.add_column("t", "x", "int")
    with pytest.raises(ConflictError):
        tx.commit()
    tx = lake.transaction()
    tx.insert("t", spark.range(5))
    other.drop_table("t")
    with pytest.raises(ConflictError):
        tx.commit()


def test_appends_elsewhere_dont_conflict(lake, spark):
    lake.create_table("a", "id bigint")
    lake.create_table("b", "id bigint")
    lake.insert("a", spark.range(3))
    tx = lake.transaction()
    tx.delete("a", "id = 1")
    lake.insert("b", spark.range(2))
    tx.commit()
    assert (lake.count("a"), lake.count("b")) == (2, 2)


def test_one_transaction_commits_once(lake, spark):
    lake.create_table("t", "id bigint")
    first = lake.insert("t", spark.range(3), txn="load-1")
    assert lake.insert("t", spark.range(3), txn="load-1") == first
    assert lake.count("t") == 3


def test_failed_transaction_leaves_nothing(lake, spark):
    lake.create_table("t", "id bigint")
    version = lake.version()
    with pytest.raises(ZeroDivisionError), lake.transaction() as tx:
        tx.insert("t", spark.range(3))
        1 / 0  # noqa: B018
    assert (lake.version(), lake.count("t")) == (version, 0)
    assert len(lake.delete_orphaned_files(dry_run=True, older_than=0)) > 0


def test_merge(lake, spark):
    lake.create_table("t", "id int, qty int")
    lake.insert("t", rows(spark, [(1, 10), (2, 20), (3, 30)]))
    done = lake.merge("t", rows(spark, [(1, 5), (2, 0), (9, 9)]), "t.id = s.id", [When(True, delete=True, where="s.qty = 0"), When(True, {"qty": "t.qty + s.qty"}), When(False)])
    assert done == {"updated": 1, "deleted": 1, "inserted": 1}
    assert held(lake.table("t")) == [(1, 15), (3, 30), (9, 9)]
    with pytest.raises(LakeError):
        lake.merge("t", rows(spark, [(1, 1), (1, 2)]), "t.id = s.id", [When(True, {"qty": "s.qty"})])


def test_expiry(lake, spark):
    lake.create_table("t", "id bigint")
    for i in range(3):
        lake.insert("t", spark.range(i, i + 1))
    with pytest.raises(LakeError):
        lake.expire_snapshots(versions=[lake.version()])
    lake.expire_snapshots(versions=[2, 3])
    with pytest.raises(LakeError):
        lake.table("t", version=3)
    assert lake.table("t").count() == 3


def test_views_macros_and_time_travel_in_sql(lake, spark):
    lake.create_table("t", "id int, qty int")
    lake.insert("t", rows(spark, [(1, 10)]))
    version = lake.version()
    lake.insert("t", rows(spark, [(2, 20)]))
    lake.create_view("v", "SELECT id, qty * 2 AS twice FROM t")
    lake.create_macro("plus", [{"params": [("x", "INT", None)], "returns": "INT", "body": "x + 1"}, {"params": [("x", "INT", None), ("y", "INT", None)], "returns": "INT", "body": "x + y"}])
    assert held(lake.sql("SELECT plus(id), twice FROM v")) == [(2, 20), (3, 40)]
    assert lake.sql("SELECT plus(2, 3)").first()[0] == 5
    assert lake.sql(f"SELECT count(*) FROM t AT (VERSION => {version})").first()[0] == 1
    assert held(lake.sql("SELECT a.id FROM t a JOIN t b ON a.id = b.id + 1")) == [(2,)]


def test_streams(lake, spark, tmp_path):
    from tidemark.streaming.feed import append_stream, follow

    lake.create_table("t", "id bigint")
    spark.range(50).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream = spark.readStream.schema("id bigint").parquet(str(tmp_path / "in"))
        append_stream(stream, lake, "t", str(tmp_path / "checkpoint"), "s").awaitTermination()
    assert lake.count("t") == 50
    seen = []
    after = follow(lake, "t", 0, lambda df, v: seen.append((v, df.count())), most=2)
    assert after == lake.version() + 1
    assert sum(n for _, n in seen) == 50


def test_scans_are_plain_parquet_plans(lake, spark):
    """No Python in the plan, columns and filters pushed to the scan, and places only where rows were deleted."""
    lake.create_table("t", "id bigint, a string, b string")
    lake.insert("t", spark.range(100).selectExpr("id", "'x' AS a", "'y' AS b"))
    plan = lambda: lake.table("t", where="id > 90").select("id")._jdf.queryExecution().executedPlan().toString()
    text = plan()
    assert "Python" not in text and "Join" not in text
    assert "c2" not in text and "PushedFilters: [IsNotNull(c1), GreaterThan(c1,90)]" in text
    lake.delete("t", "id = 95")
    assert "BroadcastHashJoin" in plan()


def test_buckets_are_pruned(lake, spark):
    lake.create_table("t", "id bigint, who string", partition_by=[("bucket", "who", 8)])
    lake.insert("t", spark.range(400).selectExpr("id", "concat('u', id % 40) AS who"))
    assert len(lake.files("t")) >= 8
    files = {f.partition["2:bucket:8"] for f in lake.files("t", where="who = 'u7'")}
    assert len(files) == 1
    assert lake.table("t", where="who = 'u7'").count() == 10
    assert lake.table("t", where="who IN ('u7', 'u9') AND id < 100").count() == 6


def test_a_long_log_opens_from_bundles(lake, spark, monkeypatch):
    for i in range(205):
        lake.set_option("x", i)
    other = Lake(spark, lake.store.root)
    reads = []
    monkeypatch.setattr(other.store, "read", lambda n, f=other.store.read: reads.append(n) or f(n))
    other.log = type(other.log)(other.store)
    assert other.option("x") == 204
    assert len(reads) < 20
    assert other.state(50).option("x") == 48


def test_other_file_systems(spark, tmp_path, monkeypatch):
    """The same through Spark's file systems, as on a cluster."""
    from tidemark.store import Store

    plain = Store.__init__
    monkeypatch.setattr(Store, "__init__", lambda self, s, root: (plain(self, s, root), setattr(self, "local", None))[0])
    lake = Lake(spark, f"file://{tmp_path}/far")
    lake.set_option("data_inlining_row_limit", 0)
    lake.create_table("t", "id bigint, part string", partition_by=["part"])
    for i in range(3):
        lake.insert("t", spark.range(10 * i, 10 * i + 10).selectExpr("id", "concat('p ', id % 2) AS part"))
    assert not lake.store.put_new(lake.log.name(1), b"{}")
    lake.delete("t", "id = 5")
    lake.merge_adjacent("t")
    lake.cleanup_old_files()
    assert lake.table("t").count() == 29
    assert lake.table("t", version=4).count() == 20
    assert lake.delete_orphaned_files(dry_run=True, older_than=0) == []
    spark.range(3).coalesce(1).write.parquet(f"file://{tmp_path}/far/data/stray")
    assert len(lake.delete_orphaned_files()) == 0
    assert len(lake.delete_orphaned_files(older_than=0)) == 1
    assert Lake(spark, lake.store.root).count("t") == 29
    assert Lake.exists(spark, lake.store.root) and not Lake.exists(spark, f"file://{tmp_path}/nothing")


def test_copies_on_other_file_systems(spark, tmp_path, monkeypatch):
    """A lake that is not on a local path is copied too, whole, and a query does so and reads the copy."""
    import shutil

    from tidemark import queries
    from tidemark.store import Store

    plain, copied = Store.__init__, []
    monkeypatch.setattr(Store, "__init__", lambda self, s, root: (plain(self, s, root), setattr(self, "local", None))[0])
    monkeypatch.setattr(Store, "copy_to", lambda self, folder, f=Store.copy_to: (f(self, folder), copied.append(folder))[0])
    lake = Lake(spark, f"file://{tmp_path}/far")
    lake.set_option("data_inlining_row_limit", 0)
    lake.create_table("t", "id bigint")
    lake.insert("t", spark.range(7))
    lake.copy_to(f"file://{tmp_path}/copy")
    with pytest.raises(FileExistsError):
        lake.copy_to(f"file://{tmp_path}/copy")
    shutil.rmtree(tmp_path / "far")
    assert Lake(spark, f"file://{tmp_path}/copy").table("t").count() == 7
    del copied[:]
    rows = queries.copy_lake(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 5 and all(r["there"] for r in rows)
    assert len(copied) == 1 and Lake.exists(spark, copied[0])


def test_removed_files_are_counted(spark, monkeypatch):
    from tidemark import queries

    monkeypatch.setattr(Lake, "removed_files_after", lambda self, *a, f=Lake.removed_files_after: (d := f(self, *a)).unionAll(d))
    assert {r["why"]: r["n"] for r in queries.removed_files_after(spark, "/root/testdata/sf0.001").collect()} == {"merge": 4, "delete": 2}


def test_macros_of_several_arities_in_one_statement(lake, spark):
    plus = [{"params": [("x", "INT", None)], "returns": "INT", "body": "x + 1"}, {"params": [("x", "INT", None), ("y", "INT", None)], "returns": "INT", "body": "x + y"}]
    lake.create_macro("plus", plus)
    lake.create_macro("twice", [{"params": [("x", "INT", None)], "returns": "INT", "body": "plus(x, x)"}])
    assert lake.sql("SELECT plus(1), plus(2, 3), twice(4), 'plus(1)'").first()[:] == (2, 5, 8, "plus(1)")
    with pytest.raises(LakeError):
        lake.sql("SELECT plus(1, 2, 3)")


def test_statements_leave_nothing_in_the_session(lake, spark):
    lake.create_table("t", "id int")
    lake.create_view("v", "SELECT id FROM t")
    lake.insert("t", rows(spark, [(1,)], "id int"))
    lake.create_macro("one", [{"params": [("x", "INT", None)], "returns": "INT", "body": "x"}])
    views = {v.name for v in spark.catalog.listTables()}
    df = lake.sql("SELECT one(a.id) AS id FROM v a JOIN t ON t.id = a.id")
    assert {v.name for v in spark.catalog.listTables()} == views
    assert not spark.catalog.functionExists("one")
    assert held(df) == [(1,)]


def test_encrypted_files(lake, spark):
    lake.set_option("encrypted", "true")
    lake.create_table("t", "id int, x double, note string, a array<int>", partition_by=["note"])
    df = spark.sql("SELECT 1 AS id, cast('NaN' AS double) AS x, 'p' AS note, array(1, null) AS a UNION ALL SELECT 2, 0.1, null, null UNION ALL SELECT 3, null, 'p', array()")
    lake.insert("t", df)
    assert {f.key is None for f in lake.files("t")} == {False}
    assert sorted(map(str, lake.table("t").collect())) == sorted(map(str, df.collect()))
    assert lake.table("t", where="note = 'p' AND id = 3").count() == 1
    lake.update("t", {"note": "'q'"}, "id = 2")
    lake.merge_adjacent("t")
    assert held(lake.table("t").select("id", "note")) == [(1, "p"), (2, "q"), (3, "p")]
    lake.rewrite_deleted("t", threshold=0.0)
    assert lake.min_max("t", "id") == (1, 3)


def test_states_are_made_again(lake, spark):
    for i in range(250):
        lake.set_option("x", i)
    assert len(lake.log.recent) + len(lake.log.kept) < 50
    assert [lake.state(v).option("x") for v in (7, 130, 249, 251)] == [5, 128, 247, 249]
    assert [s.version for s in lake.log.history()] == list(range(lake.version() + 1))


def test_merge_reads_its_source_once(lake, spark):
    """A source that gives other rows each time it is read is joined once."""
    lake.create_table("t", "id int, qty int")
    lake.insert("t", rows(spark, [(i, 0) for i in range(50)]))
    source = spark.range(100).select(F.col("id").cast("int"), F.floor(F.rand() * 1000).cast("int").alias("qty"))
    assert lake.merge("t", source, "t.id = s.id", [When(True, delete=True, where="s.qty % 2 = 0"), When(True, {"qty": "s.qty"}), When(False, where="s.qty % 2 = 1")]) == {
        "updated": lake.table("t").where("id < 50").count(), "deleted": 50 - lake.table("t").where("id < 50").count(), "inserted": lake.table("t").where("id >= 50").count(),
    }
    assert lake.table("t").where("qty % 2 = 0").count() == 0
