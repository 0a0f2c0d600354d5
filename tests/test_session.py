import pytest

from tidemark import Lake, LakeError, Session


@pytest.fixture
def session(spark, tmp_path):
    return Session(Lake(spark, str(tmp_path / "lake")))


def held(df):
    return sorted(map(tuple, df.collect()))


def test_a_script(session):
    session.run("""
        CREATE TABLE items (id INT, qty INT); -- two columns
        INSERT INTO items VALUES (1, 10), (2, 20), (3, 30);
        UPDATE items SET qty = qty + 100 WHERE id <= 2;
        DELETE FROM items WHERE id = 3;
        INSERT INTO items (qty, id) VALUES (40, 4);
    """)
    assert held(session.execute("SELECT * FROM items")) == [(1, 110), (2, 120), (4, 40)]
    assert held(session.execute("SELECT count(*), sum(qty) FROM items AT (VERSION => 3)")) == [(3, 260)]
    assert held(session.execute("SELECT change_type, count(*) FROM table_changes('items', 0, 5) GROUP BY change_type")) == [("delete", 1), ("insert", 4), ("update_postimage", 2), ("update_preimage", 2)]
    assert session.execute("SELECT id FROM current_snapshot()").first()[0] == 5
    assert session.execute("SELECT count(*) FROM snapshots()").first()[0] == 6


def test_tables_and_columns(session):
    session.run("""
        CREATE SCHEMA s;
        CREATE TABLE s.orders (id INT NOT NULL, qty INT DEFAULT 5, note STRING) PARTITIONED BY (bucket(4, id)) SORTED BY (qty DESC);
        INSERT INTO s.orders (id) VALUES (1), (2);
        ALTER TABLE s.orders RENAME TO archive;
        ALTER TABLE s.archive RENAME COLUMN qty TO quantity;
        ALTER TABLE s.archive ALTER COLUMN quantity TYPE BIGINT;
        ALTER TABLE s.archive ALTER quantity SET DEFAULT 7;
        ALTER TABLE s.archive DROP COLUMN note;
        ALTER TABLE s.archive ADD COLUMN tag STRING DEFAULT 'none, yet';
        COMMENT ON TABLE s.archive IS 'old orders';
        COMMENT ON COLUMN s.archive.quantity IS 'it''s a number';
        INSERT INTO s.archive (id) VALUES (3);
        CREATE TABLE IF NOT EXISTS s.archive (x INT);
        CREATE OR REPLACE TABLE copied AS SELECT id FROM s.archive WHERE quantity > 5;
        ALTER TABLE s.archive RESET SORTED BY;
        ALTER TABLE s.archive SET PARTITIONED BY (id);
    """)
    assert held(session.execute("SELECT id, quantity, tag FROM s.archive")) == [(1, 5, "none, yet"), (2, 5, "none, yet"), (3, 7, "none, yet")]
    assert held(session.execute("SELECT * FROM copied")) == [(3,)]
    table = session.lake.state().table("s.archive")
    assert (table.comment, table.column("quantity").comment, table.sort, len(table.partition)) == ("old orders", "it's a number", (), 1)
    session.run("DROP TABLE copied; DROP TABLE IF EXISTS copied; DROP SCHEMA s CASCADE")
    assert not session.lake.state().tables


def test_merge(session):
    session.run("CREATE TABLE t (id INT, qty INT); CREATE TABLE u (id INT, qty INT); INSERT INTO t VALUES (1, 10), (2, 20), (3, 30); INSERT INTO u VALUES (1, 5), (2, 0), (9, 9)")
    session.execute("MERGE INTO t AS a USING u AS b ON a.id = b.id WHEN MATCHED AND b.qty = 0 THEN DELETE WHEN MATCHED THEN UPDATE SET qty = a.qty + b.qty WHEN NOT MATCHED THEN INSERT (id, qty) VALUES (b.id, -b.qty)")
    assert held(session.execute("SELECT * FROM t")) == [(1, 15), (3, 30), (9, -9)]
    session.execute("MERGE INTO t USING (SELECT id, qty FROM u WHERE id = 1) v ON t.id = v.id WHEN MATCHED THEN UPDATE SET *")
    assert held(session.execute("SELECT * FROM t WHERE id = 1")) == [(1, 5)]


def test_transactions(session):
    session.run("CREATE TABLE t (id INT); BEGIN; INSERT INTO t VALUES (1); INSERT INTO t SELECT id + 1 FROM t")
    version = session.lake.version()
    assert session.execute("SELECT count(*) FROM t").first()[0] == 2
    assert session.lake.count("t") == 0
    session.execute("COMMIT")
    assert (session.lake.count("t"), session.lake.version()) == (2, version + 1)
    session.run("BEGIN; DELETE FROM t; ROLLBACK")
    assert session.lake.count("t") == 2


def test_views_macros_and_calls(session):
    session.run("""
        CREATE TABLE t (id INT); INSERT INTO t VALUES (1), (2);
        CREATE VIEW v AS SELECT id * 10 AS ten FROM t; ALTER VIEW v RENAME TO w; COMMENT ON VIEW w IS 'tens';
        CREATE MACRO plus(x INT, n INT := 1) RETURNS INT AS x + n;
    """)
    assert held(session.execute("SELECT plus(ten) FROM w")) == [(11,), (21,)]
    assert session.execute("CALL flush_inlined_data('t')").first()[0] == "2"
    session.run("INSERT INTO t VALUES (3); CALL set_option('data_inlining_row_limit', 0); INSERT INTO t VALUES (4); CALL flush_inlined_data('t')")
    assert session.execute("CALL merge_adjacent_files('t')").first()[0] == "3"
    assert session.execute("CALL cleanup_old_files(dry_run => true)").count() == 3
    assert held(session.execute("SELECT id FROM t")) == [(1,), (2,), (3,), (4,)]
    session.run("DROP VIEW w; DROP MACRO plus")
    with pytest.raises(LakeError):
        session.execute("GRANT ALL ON t")
