"""Merge statements, run on DuckDB in memory, and the database and warehouse sinks around them."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tablesync.dataset import Dataset, Stream
from tablesync.errors import DestinationConnectionFailed, DestinationError, DestinationStreamInvalidSchema
from tablesync.sinks import statements as sql
from tablesync.sinks.jdbc import JdbcSink, PostgresSink, portable
from tablesync.sinks.warehouse import BigQuerySink, RedshiftSink, SnowflakeSink, SnowflakeStageSink
from tablesync.spec import Mode, StreamSpec, SyncContext

WINDOW = Mode.window("2025-01-01", "2025-01-02")
CTX = SyncContext.at("2025-01-10T00:00:00Z")
SPEC = StreamSpec("users", "main", "id", "at")


@pytest.fixture
def db():
    con = duckdb.connect()
    con.execute('create table main.users (id bigint primary key, name varchar, "at" bigint)')
    con.execute("insert into main.users values (1, 'a', 1), (2, 'b', 1), (3, 'c', 1)")
    con.execute("create table main.stage as select * from main.users where false")
    con.execute("insert into main.stage values (2, 'B', 2), (4, 'D', 2)")
    return con


MERGED = [(1, "a", 1), (2, "B", 2), (3, "c", 1), (4, "D", 2)]


def merge(columns=("id", "name", "at"), keys=("id",)):
    return sql.Merge("main.users", "main.stage", columns, keys, '"')


@pytest.mark.parametrize("strategy", sql.STRATEGIES)
def test_j1_j2_j3_statements_merge_by_key(db, strategy):
    if strategy == "delete_insert":
        # a primary key would reject the re-insert of a key deleted in the same transaction
        db.execute("create table plain as select * from main.users; drop table main.users; alter table plain rename to users")
    for _ in range(2):
        for command in merge().statements(strategy):
            db.execute(command)
        assert db.execute('select id, name, "at" from main.users order by id').fetchall() == MERGED


def test_j2_stage_copies_are_kept(db):
    db.execute("create table plain as select * from main.users; drop table main.users; alter table plain rename to users")
    db.execute("insert into main.stage values (2, 'B2', 2)")
    for command in merge().delete_insert():
        db.execute(command)
    assert db.execute("select count(*) from main.users where id = 2").fetchall() == [(2,)]


def test_statement_texts():
    m = sql.Merge("s.t", "s.x", ["id", "a b"], ["id"])
    assert m.delete_insert() == [
        "DELETE FROM s.t USING s.x WHERE s.t.id = s.x.id",
        "INSERT INTO s.t (id, a_b) SELECT id, a_b FROM s.x",
    ]
    assert m.on_conflict()[0].endswith("ON CONFLICT (id) DO UPDATE SET a_b = EXCLUDED.a_b")
    assert "ON t.id = s.id WHEN MATCHED THEN UPDATE SET a_b = s.a_b WHEN NOT MATCHED" in m.merge()[0]
    only_key = sql.Merge("t", "x", ["id"], ["id"])
    assert only_key.on_conflict()[0].endswith("DO NOTHING") and "UPDATE" not in only_key.merge()[0]
    with pytest.raises(ValueError):
        sql.Merge("t", "x", ["id"], [])
    with pytest.raises(ValueError):
        m.statements("replace")


def test_k3_copy_names_exactly_one_batch():
    text = sql.redshift_copy("stage", "s3://b/ns/s__t/2025-01-10/1", "role", "eu-west-1")
    assert text == "COPY stage FROM 's3://b/ns/s__t/2025-01-10/1/' IAM_ROLE 'role' FORMAT AS PARQUET REGION 'eu-west-1'"


class OnDuck:
    """Replaces the database accesses of a JDBC sink by DuckDB."""

    def __init__(self, con):
        self.con, self.commands, self.existing = con, [], {}

    def run(self, commands):
        for c in commands:
            self.commands.append(c)
            self.con.execute(c)

    def attach(self, sink, spark):
        def load(table):
            try:
                return spark.createDataFrame(self.con.execute(f"select * from {table}").to_arrow_table())
            except duckdb.CatalogException:
                return None

        def insert(df, table, mode):
            frame = df.toArrow()
            self.con.register("incoming", frame)
            create = "create or replace table" if mode == "overwrite" else "create table"
            self.con.execute(f"{create} {table} as select * from incoming")
            self.con.unregister("incoming")

        sink.load, sink.insert = load, insert
        sink.ask = lambda query: spark.createDataFrame(self.con.execute(query).to_arrow_table())
        return sink


BASIC = {"url": "jdbc:postgresql://h/db", "auth_type": "basic", "user": "u", "password": "p"}


def dataset(spark, data, mode, spec=SPEC):
    df = spark.createDataFrame(data, "id bigint, name string, at bigint").withColumn("sync__batch_id", F.lit(CTX.batch_id))
    return Dataset("ns", (Stream(spec, df, len(data)),), CTX, mode)


def test_k2_postgres_upsert_end_to_end(spark):
    duck = OnDuck(duckdb.connect())
    first = dataset(spark, [(1, "a", 1), (2, "b", 1), (2, "b2", 2)], Mode.full())
    sink = duck.attach(PostgresSink(spark, {"connect": BASIC, "mode": Mode.full()}, duck.run), spark)
    sink.write(first)
    assert sink.check(first) == {"main.users": 2}
    assert duck.con.execute("select id, name from main.users order by id").fetchall() == [(1, "a"), (2, "b2")]
    second = dataset(spark, [(2, "B", 3), (3, "c", 1)], WINDOW)
    sink = duck.attach(PostgresSink(spark, {"connect": BASIC, "mode": WINDOW}, duck.run), spark)
    sink.write(second)
    assert duck.con.execute("select id, name from main.users order by id").fetchall() == [(1, "a"), (2, "B"), (3, "c")]
    assert not [t for (t,) in duck.con.execute("select table_name from duckdb_tables()").fetchall() if "stage" in t]
    assert any('ADD PRIMARY KEY ("id")' in c for c in duck.commands)


def test_k2_a_failed_load_leaves_no_stage_behind(spark):
    duck = OnDuck(duckdb.connect())
    duck.con.execute("create table main.users as select 7::bigint as id")
    sink = duck.attach(PostgresSink(spark, {"connect": BASIC, "mode": Mode.full()}, duck.run), spark)
    load = sink.insert

    def broken(df, table, mode):
        load(df, table, mode)
        raise OSError("lost connection")

    sink.insert = broken
    with pytest.raises(OSError):
        sink.write(dataset(spark, [(1, "a", 1)], Mode.full()))
    assert duck.con.execute("select table_name from duckdb_tables()").fetchall() == [("users",)]
    assert duck.con.execute("select id from main.users").fetchall() == [(7,)]


def test_k15_existing_table_must_fit(spark):
    duck = OnDuck(duckdb.connect())
    duck.con.execute("create table main.users as select 1::bigint as id, 'x' as other")
    sink = duck.attach(PostgresSink(spark, {"connect": BASIC, "mode": WINDOW}, duck.run), spark)
    with pytest.raises(DestinationStreamInvalidSchema):
        sink.write(dataset(spark, [(1, "a", 1)], WINDOW))


def test_an_unreadable_table_is_not_truncated(spark):
    duck = OnDuck(duckdb.connect())
    duck.con.execute("create table main.users as select 7::bigint as id")
    sink = duck.attach(PostgresSink(spark, {"connect": BASIC, "mode": WINDOW}, duck.run), spark)
    sink.load = lambda table: None
    with pytest.raises(duckdb.CatalogException):
        sink.write(dataset(spark, [(1, "a", 1)], WINDOW))
    assert duck.con.execute("select id from main.users").fetchall() == [(7,)]


def test_k19_trial_drops_its_own_table(spark):
    duck = OnDuck(duckdb.connect())
    duck.con.execute("create table main.users as select 7::bigint as id")
    sink = PostgresSink(spark, {"connect": BASIC, "mode": Mode.full(), "drop_after_complete": True}, duck.run)
    duck.attach(sink, spark).write(dataset(spark, [(1, "a", 1)], Mode.full()))
    assert duck.con.execute("select id from main.users").fetchall() == [(7,)]
    assert duck.con.execute("select count(*) from duckdb_tables()").fetchall() == [(1,)]


def test_k1_generic_sink_only_refreshes(spark):
    duck = OnDuck(duckdb.connect())
    sink = duck.attach(JdbcSink(spark, {"connect": BASIC, "mode": WINDOW}, duck.run), spark)
    with pytest.raises(DestinationError):
        sink.write(dataset(spark, [(1, "a", 1)], WINDOW))
    full = duck.attach(JdbcSink(spark, {"connect": BASIC}, duck.run), spark)
    ds = dataset(spark, [(1, "a", 1), (1, "b", 1)], Mode.full())
    for _ in range(2):
        full.write(ds)
        assert full.check(ds) == {"main.users": 2}
    assert [c.split()[0] for c in duck.commands] == ["DROP", "ALTER"] * 2, "loaded beside the table, then swapped in"


def test_w12_columns_are_renamed_before_they_are_created(spark):
    duck = OnDuck(duckdb.connect())
    df = spark.createDataFrame([(1, 2.0, CTX.batch_id)], "id bigint, `unit price` double, sync__batch_id string")
    for mode in (Mode.full(), WINDOW):
        ds = Dataset("ns", (Stream(SPEC, df, 1),), CTX, mode)
        sink = duck.attach(PostgresSink(spark, {"connect": BASIC, "mode": mode, "dedupe": "none"}, duck.run), spark)
        sink.write(ds)
        assert sink.check(ds) == {"main.users": 1}
    assert duck.con.execute("select unit_price from main.users").fetchall() == [(2.0,)]


def test_w10_w11_connector_checks(spark):
    class Fits(BigQuerySink):
        def read_table(self, stream):
            return spark.createDataFrame([], self.there)

    connect = {"auth_type": "service_account", "project_id": "prj", "service_account": '{"a": 1}'}
    ds = dataset(spark, [(1, "a", 1), (1, "b", 2), (2, "c", 1)], WINDOW)
    sink = Fits(spark, {"connect": connect, "mode": WINDOW}, runner=print)
    assert sink.expected_rows(ds.streams[0], 3) == 2
    sink.there = "id bigint, name string, at bigint, sync__batch_id string"
    sink.check_schema(ds.streams[0], ds)
    sink.there = "id bigint, name string"
    with pytest.raises(DestinationStreamInvalidSchema):
        sink.check_schema(ds.streams[0], ds)


def test_k4_k5_a_full_refresh_never_leaves_no_table(spark):
    """The target is replaced by one statement, so a failure before it keeps the old rows and one after it the new ones."""
    con = duckdb.connect()
    con.execute("create schema main2; create table main2.users as select 9 as id, 'old' as name")
    con.execute("create table main2.users__stage as select 1 as id, 'new' as name")
    connect = {"auth_type": "service_account", "project_id": "prj", "service_account": '{"a": 1}'}
    sink = BigQuerySink(spark, {"connect": connect, "mode": Mode.full()}, runner=print)
    stream = dataset(spark, [(1, "a", 1)], Mode.full()).in_schema("main2").streams[0]
    statements = sink.merge_statements(stream)
    assert [c for c in statements if c.startswith("DROP")] == ["DROP TABLE IF EXISTS main2.users__stage"]
    for statement in statements:
        con.execute(statement)
        assert con.execute("select name from main2.users").fetchall() in ([("old",)], [("new",)])
    assert con.execute("select * from main2.users").fetchall() == [(1, "new")]


def test_k4_only_a_missing_table_is_no_table(spark):
    class Failing(BigQuerySink):
        def read_table(self, stream):
            raise RuntimeError(self.says)

    connect = {"auth_type": "service_account", "project_id": "prj", "service_account": '{"a": 1}'}
    ds = dataset(spark, [(1, "a", 1)], WINDOW)
    sink = Failing(spark, {"connect": connect, "mode": WINDOW}, runner=print)
    sink.says = "404 Not found: Table prj:main.users"
    sink.check_schema(ds.streams[0], ds)
    sink.says = "403 access denied"
    with pytest.raises(RuntimeError, match="403"):
        sink.check_schema(ds.streams[0], ds)


def test_w13_redshift_refresh_swaps(spark):
    commands = []
    connect = {**BASIC, "s3_bucket": "s3://box", "iam_role": "role", "url": "jdbc:redshift://h/db"}
    sink = RedshiftSink(spark, {"connect": connect, "mode": Mode.full()}, commands.extend)
    sink.load, sink.insert = lambda table: None, lambda df, table, mode: commands.append(f"CREATE {table}")
    sink.write(dataset(spark, [(1, "a", 1)], Mode.full()))
    assert [c.split()[0] for c in commands] == ["DROP", "CREATE", "COPY", "DROP", "ALTER", "ALTER"]
    assert commands[3] == "DROP TABLE IF EXISTS main.users" and commands[4].endswith("RENAME TO users")


def test_k20_unreachable_database(spark):
    def refuse(commands):
        raise OSError("no route")

    sink = JdbcSink(spark, {"connect": {**BASIC, "url": "jdbc:none://h/db"}}, refuse)
    with pytest.raises(DestinationConnectionFailed):
        sink.load("t")
    with pytest.raises(ValueError):
        PostgresSink(spark, {"connect": {**BASIC, "auth_type": "iam"}})


def test_portable_types(spark):
    df = portable(spark.sql("select array(1, 2) a, cast(1.5 as decimal(4,1)) d, 1 i"))
    assert df.dtypes == [("a", "string"), ("d", "double"), ("i", "bigint")]


def test_k3_redshift_statements(spark):
    commands = []
    connect = {**BASIC, "s3_bucket": "s3://box", "s3_prefix": "p", "iam_role": "role", "url": "jdbc:redshift://h/db"}
    sink = RedshiftSink(spark, {"connect": connect, "mode": WINDOW}, commands.extend)
    sink.load = lambda table: spark.createDataFrame([], "id bigint, name string, at bigint, sync__batch_id string")
    sink.write(dataset(spark, [(1, "a", 1)], WINDOW))
    assert [c.split()[0] for c in commands] == ["CREATE", "COPY", "DELETE", "INSERT", "DROP"]
    assert "s3://box/p/ns/main__users/2025-01-10/1736467200000/" in commands[1]


def test_k5_snowflake_options_and_post_actions(spark):
    connect = {"auth_type": "access_token", "user": "u", "access_token": "t", "account": "acc", "database": "db",
               "warehouse": "wh", "target_schema": "out"}
    sink = SnowflakeSink(spark, {"connect": connect, "mode": Mode.full()})
    stream = dataset(spark, [(1, "a", 1)], Mode.full()).in_schema("out").streams[0]
    options = sink.write_options(stream)
    assert options["sfURL"] == "acc.snowflakecomputing.com" and options["sfSchema"] == "out"
    assert options["dbtable"] == "out.users__stage"
    actions = [a.split()[0] for a in options["postactions"].split("; ")]
    assert actions == ["CREATE", "DROP"] and options["postactions"].startswith("CREATE OR REPLACE TABLE out.users AS")
    incremental = SnowflakeSink(spark, {"connect": connect, "mode": WINDOW})
    assert incremental.merge_statements(stream)[0].startswith("CREATE TABLE IF NOT EXISTS")
    with pytest.raises(ValueError):
        SnowflakeSink(spark, {"connect": {**connect, "auth_type": "basic"}})


def test_q12_snowflake_stage_copies_one_folder(spark):
    sink = SnowflakeStageSink(spark, {"connect": {"root": "s3a://b/x", "stage_name": "st"}})
    ds = dataset(spark, [], WINDOW)
    text = sink.copy_statement(ds.streams[0], ds, "t")
    assert "FROM @st/ns/main__users/2025-01-10/1736467200000/ " in text
    with pytest.raises(DestinationError):
        SnowflakeStageSink(spark, {"connect": {"root": "x", "format": "hive"}})


def test_k4_bigquery_options(spark):
    connect = {"auth_type": "service_account", "project_id": "prj", "service_account": '{"a": 1}', "gcs_bucket_name": "gs://box"}
    sink = BigQuerySink(spark, {"connect": connect, "mode": WINDOW}, runner=print)
    stream = dataset(spark, [], WINDOW).streams[0]
    options = sink.write_options(stream)
    assert options["table"] == "prj.main.users__stage" and options["temporaryGcsBucket"] == "box"
    assert [c.split()[0] for c in sink.merge_statements(stream)] == ["CREATE", "MERGE", "DROP"]
    with pytest.raises(ValueError):
        BigQuerySink(spark, {"connect": {**connect, "service_account": "{"}})
    with pytest.raises(DestinationError):
        BigQuerySink(spark, {"connect": connect}).write_stream(stream, None)


class FakeJvm:
    """Stands in for the JVM side of a JDBC connection and notes what is called."""

    def __init__(self, fail_on=None):
        self.calls, self.fail_on = [], fail_on

    def __getattr__(self, name):
        if name in ("java", "sql", "lang", "util", "Class", "DriverManager"):
            return self
        return lambda *args: self._call(name, *args)

    def _call(self, name, *args):
        self.calls.append((name, *[a for a in args if not isinstance(a, FakeJvm)]))
        if name == "execute" and self.fail_on in args:
            raise OSError("rejected")
        return self


def runner_on(jvm):
    from types import SimpleNamespace

    from tablesync.sinks.jdbc import driver_runner

    spark = SimpleNamespace(sparkContext=SimpleNamespace(_jvm=jvm))
    return driver_runner(spark, {"url": "jdbc:x", "user": "u", "password": "p", "driver": "d.D"})


def test_k2_statements_run_in_one_transaction():
    jvm = FakeJvm()
    runner_on(jvm)(["a", "b"])
    names = [c[0] for c in jvm.calls]
    assert ("forName", "d.D") in jvm.calls and ("setProperty", "user", "u") in jvm.calls
    assert ("setAutoCommit", False) in jvm.calls and names.count("execute") == 2
    assert names[-2:] == ["commit", "close"] and "rollback" not in names


def test_k2_a_rejected_statement_rolls_back():
    jvm = FakeJvm(fail_on="b")
    with pytest.raises(OSError):
        runner_on(jvm)(["a", "b", "c"])
    names = [c[0] for c in jvm.calls]
    assert names[-2:] == ["rollback", "close"] and "commit" not in names and names.count("execute") == 2


def test_k19_trial_names_never_become_the_real_name():
    from tablesync.functions.identifiers import derived_identifier, safe_identifier

    for name in ("t" * 64, "s." + "t" * 64, "t" * 70, "s.short"):
        trial = derived_identifier(name, "__trial")
        assert trial == safe_identifier(trial) != safe_identifier(name) and trial.endswith("__trial")
        stages = {derived_identifier(trial, f"__stage_b{b}") for b in (1, 2)}
        assert len(stages) == 2 and all(s == safe_identifier(s) for s in stages)
    assert derived_identifier("s.short", "__trial") == "s.short__trial"
