import os
import random
from decimal import Decimal
from unittest import mock

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tallyframe import catalog, sinks, sources
from tallyframe.session import scan_split_bytes, scratch_path, shuffle_partitions_for


@pytest.fixture
def schema(spark, tmp_path):
    name = f"s_{tmp_path.name}".replace("-", "_").lower()
    catalog.create_schema(spark, name, str(tmp_path / "schema"))
    yield name
    catalog.drop_schema(spark, name, cascade=True)


def data_files(path):
    return [f for f in os.listdir(path) if f.startswith("part-")]


def test_declared_scan_keeps_blanks_and_letters(movies):
    titles = [r.title for r in movies.orderBy("movieId").collect()]
    assert titles[2:4] == ['"Quoted" Film (2005)', "Café (2001) "]
    assert movies.where("genres IS NULL").count() == 1


def test_inferred_scan_names_columns_by_position(spark, files):
    df = sources.read_delimited(spark, files["ratings"], sep="@", names=["userId", "movieId", "rating", "timestamp"])
    assert df.dtypes == [("userId", "int"), ("movieId", "int"), ("rating", "double"), ("timestamp", "int")]


def test_other_encodings(spark, tmp_path):
    (tmp_path / "l1.dat").write_bytes("1@Café\n".encode("iso-8859-1"))
    df = sources.read_delimited(spark, str(tmp_path / "l1.dat"), "n int, t string", sep="@", encoding="ISO-8859-1")
    assert df.first().t == "Café"


def test_bad_value_costs_only_its_own_field(spark, tmp_path):
    (tmp_path / "x.csv").write_text("1,a\nx,b\n")
    df = sources.read_delimited(spark, str(tmp_path / "x.csv"), "n int, t string")
    assert [(r.n, r.t) for r in df.collect()] == [(1, "a"), (None, "b")]


def test_csv_round_trip_with_header(spark, movies, tmp_path):
    path = str(tmp_path / "out")
    sinks.write_csv(movies, path)
    back = sources.read_delimited(spark, path, movies.schema, header=True)
    assert set(back.collect()) == set(movies.collect())


@pytest.mark.parametrize("options", [{}, {"sep": "@"}, {"escape": '"'}])
def test_random_text_survives_a_csv_round_trip(spark, tmp_path, options):
    rnd = random.Random(str(options))
    texts = ["".join(rnd.choices('ab",\\@ #|é', k=rnd.randint(1, 8))) for _ in range(500)]
    df = spark.createDataFrame([(t, n) for n, t in enumerate(texts)], "t string, n int")
    sep = options.get("sep", ",")
    escape = {k: v for k, v in options.items() if k == "escape"}
    sinks.write_csv(df, str(tmp_path / "r"), sep=sep, options=escape)
    back = sources.read_delimited(spark, str(tmp_path / "r"), df.schema, sep=sep, header=True, **escape)
    assert {r.n: r.t for r in back.collect()} == dict(enumerate(texts))


def test_line_breaks_and_quote_marks_survive_with_doubled_quotes(spark, tmp_path):
    texts = ['say "hi"', "two\nlines", "cr\r\nlf", "comma, and \\ slash\\", '"', " blanks ", "\n", 'a"\n"b,c']
    df = spark.createDataFrame(list(enumerate(texts)), "n int, t string").coalesce(1)
    sinks.write_csv(df, str(tmp_path / "t"), options={"escape": '"'})
    back = sources.read_delimited(spark, str(tmp_path / "t"), df.schema, header=True, escape='"', multiline=True)
    assert dict(back.collect()) == dict(enumerate(texts))


def test_empty_text_becomes_null_in_csv(spark, tmp_path):
    sinks.write_csv(spark.createDataFrame([("", 1), (None, 2)], "t string, n int"), str(tmp_path / "e"))
    back = sources.read_delimited(spark, str(tmp_path / "e"), "t string, n int", header=True)
    assert {r.t for r in back.collect()} == {None}


def test_single_csv_is_one_file_and_replaces(spark, tmp_path):
    path = str(tmp_path / "one")
    for n in (100, 7):
        sinks.write_single_csv(spark.range(0, n, 1, 8).groupBy("id").count(), path)
    assert len(data_files(path)) == 1
    assert sources.read_delimited(spark, path, "id bigint, n bigint").count() == 7


def test_an_empty_report_can_be_written_and_read(spark, tmp_path):
    sinks.write_single_csv(spark.range(0), str(tmp_path / "none"))
    assert sources.read_delimited(spark, str(tmp_path / "none"), "id bigint").count() == 0


def test_single_csv_may_be_sorted(spark, tmp_path):
    path = tmp_path / "sorted"
    sinks.write_single_csv(spark.range(0, 50, 1, 8), str(path), F.desc("id"), header=True)
    (name,) = data_files(path)
    assert (path / name).read_text().split() == ["id", *[str(i) for i in range(49, -1, -1)]]


def test_parquet_scan_reads_named_columns_only(spark, tmp_path):
    from conftest import plan_of

    spark.range(5).select("id", F.lit("x").alias("t")).write.parquet(str(tmp_path / "p"))
    df = sources.read_parquet(spark, [str(tmp_path / "p")])
    assert "ReadSchema: struct<id:bigint>" in plan_of(df.where("id > 3").select("id"))
    assert "GreaterThan(id,3)" in plan_of(df.where("id > 3").select("id"))
    assert sources.read_parquet(spark, str(tmp_path / "p"), "id bigint").columns == ["id"]


def test_overwriting_the_path_being_read_is_refused(spark, tmp_path):
    path = str(tmp_path / "same")
    spark.range(3).write.parquet(path)
    df = sources.read_parquet(spark, path)
    with pytest.raises(ValueError, match="is an input"):
        sinks.write_directory(df.where("id > 1"), path)
    with pytest.raises(ValueError, match="is an input"):
        sinks.write_csv(df.groupBy("id").count(), path)
    assert df.count() == 3


def test_a_refresh_may_read_the_table_or_its_files(spark, schema):
    sinks.refresh_table(spark.range(5), f"{schema}.t")
    files = spark.table(f"{schema}.t").inputFiles()
    sinks.refresh_table(spark.read.parquet(*files).where("id > 1"), f"{schema}.t")
    assert spark.table(f"{schema}.t").count() == 3
    sinks.refresh_table(spark.table(f"{schema}.t").where("id > 2"), f"{schema}.t")
    assert sorted(r.id for r in spark.table(f"{schema}.t").collect()) == [3, 4]
    assert [r.table for r in catalog.list_tables(spark, schema).collect()] == ["t"]


def test_a_failed_refresh_keeps_the_old_rows(spark, schema):
    sinks.refresh_table(spark.range(5), f"{schema}.t")
    with pytest.raises(Exception, match="half-way"):
        sinks.refresh_table(spark.range(9).selectExpr("if(id = 7, raise_error('half-way'), id) AS id"), f"{schema}.t")
    assert spark.table(f"{schema}.t").count() == 5
    assert [r.table for r in catalog.list_tables(spark, schema).collect()] == ["t"]


def test_rows_to_frame(spark):
    df = sources.frame_from_rows(spark, ((i, str(i)) for i in range(3)), "a int, b string")
    assert [tuple(r) for r in df.collect()] == [(0, "0"), (1, "1"), (2, "2")]


def test_listing_reports_names_and_sizes(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "one.dat").write_bytes(b"12345")
    (tmp_path / "a" / "b" / "two.dat").write_bytes(b"1234567")
    (tmp_path / "a" / "b" / "skip.txt").write_bytes(b"1")
    found = sources.list_files(spark, str(tmp_path / "a"), "*.dat")
    assert {(r.path.rsplit("/", 1)[1], r.bytes) for r in found.collect()} == {("one.dat", 5), ("two.dat", 7)}
    assert sources.list_files(spark, str(tmp_path / "a")).count() == 3
    (tmp_path / "a" / "_d").mkdir()
    for name in ("_x.dat", ".y", "_d/q.dat"):
        (tmp_path / "a" / name).write_bytes(b"1")
    found = {r.path.rsplit("/a/", 1)[1] for r in sources.list_files(spark, str(tmp_path / "a")).collect()}
    assert found == {"one.dat", "b/two.dat", "b/skip.txt", "_x.dat", ".y", "_d/q.dat"}


def test_public_bucket_options(spark, files):
    provider = "org.apache.hadoop.fs.s3a.AnonymousAWSCredentialsProvider"
    assert sources.public_bucket_options() == {"fs.s3a.aws.credentials.provider": provider}
    assert sources.public_bucket_options("b") == {"fs.s3a.bucket.b.aws.credentials.provider": provider}
    scan = sources.read_delimited(spark, files["movies"], sep="@", options=sources.public_bucket_options())
    assert scan.count() == 6


def test_plain_table_keeps_quote_marks_and_quoted_table_removes_them(spark, schema, tmp_path):
    folder = tmp_path / "q"
    folder.mkdir()
    (folder / "x.dat").write_text('1@"a@b" \\"c\n2@"say \\"hi\\""@z\n')
    plain = sources.create_delimited_table(spark, f"{schema}.plain", str(folder), ["i", "t", "u"], sep="@", quote="")
    assert [tuple(r) for r in plain.collect()] == [("1", '"a', 'b" \\"c'), ("2", '"say \\"hi\\""', "z")]
    quoted = sources.create_delimited_table(spark, f"{schema}.quoted", str(folder), ["i", "t", "u"], sep="@")
    assert tuple(quoted.collect()[1]) == ("2", 'say "hi"', "z")
    assert {t for _, t in plain.dtypes} == {"string"}


def test_creating_a_table_again_keeps_the_first(spark, schema, files, tmp_path):
    sources.create_delimited_table(spark, f"{schema}.t", files["movies"], ["a", "b", "c"], sep="@")
    again = sources.create_delimited_table(spark, f"{schema}.t", str(tmp_path), ["x"], sep="@")
    assert again.columns == ["a", "b", "c"] and again.count() == 6


def test_refresh_replaces_rows_and_columns(spark, schema):
    sinks.refresh_table(spark.range(5), f"{schema}.t")
    sinks.refresh_table(spark.range(2).withColumnRenamed("id", "other"), f"{schema}.t")
    assert spark.table(f"{schema}.t").columns == ["other"] and spark.table(f"{schema}.t").count() == 2


def test_a_table_may_be_rewritten_from_itself(spark, schema, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "v1"))
    table = sources.create_table_at(spark, f"{schema}.r", str(tmp_path / "v1"))
    sinks.rewrite_external_table(table.where("id > 1"), f"{schema}.r", str(tmp_path / "v2"))
    assert sorted(r.id for r in spark.table(f"{schema}.r").collect()) == [2, 3, 4]
    assert spark.read.parquet(str(tmp_path / "v1")).count() == 5


def test_dropping_an_external_table_keeps_its_files(spark, schema, tmp_path):
    path = str(tmp_path / "ext")
    sinks.write_external_table(spark.range(4), f"{schema}.e", path)
    assert spark.table(f"{schema}.e").count() == 4
    catalog.drop_table(spark, f"{schema}.e")
    assert data_files(path) and sources.read_delimited(spark, path, "id bigint").count() == 4


def test_table_over_a_written_directory(spark, schema, movies, tmp_path):
    for fmt in ("parquet", "orc"):
        sinks.write_directory(movies, str(tmp_path / fmt), fmt)
        table = sources.create_table_at(spark, f"{schema}.{fmt}_t", str(tmp_path / fmt), fmt)
        assert set(table.collect()) == set(movies.collect())


def test_catalog_listing_and_drops(spark, schema):
    catalog.create_schema(spark, schema)
    assert schema in {r.schema for r in catalog.list_schemas(spark).collect()}
    assert schema in {r.schema for r in catalog.list_schemas(spark, "spark_catalog").collect()}
    sinks.refresh_table(spark.range(1), f"{schema}.a")
    catalog.register_view(spark.range(1), "a_session_view")
    assert [r.table for r in catalog.list_tables(spark, schema).collect()] == ["a"]
    described = {r.col_name: r.data_type for r in catalog.describe_table(spark, f"{schema}.a").collect()}
    assert described["id"] == "bigint" and described["Provider"] == "parquet"
    with pytest.raises(AnalysisException, match="SCHEMA_NOT_EMPTY"):
        catalog.drop_schema(spark, schema)
    catalog.drop_table(spark, f"{schema}.a")
    catalog.drop_table(spark, f"{schema}.a")
    with pytest.raises(AnalysisException, match="TABLE_OR_VIEW_NOT_FOUND"):
        catalog.drop_table(spark, f"{schema}.a", if_exists=False)
    spark.catalog.dropTempView("a_session_view")


def test_current_catalog_and_schema(spark, schema):
    assert catalog.current_catalog(spark) == "spark_catalog"
    before = spark.catalog.currentDatabase()
    sinks.refresh_table(spark.range(3), f"{schema}.t")
    catalog.use_schema(spark, schema)
    try:
        assert spark.sql("SELECT * FROM t").count() == 3
        assert [r.table for r in catalog.list_tables(spark).collect()] == ["t"]
    finally:
        catalog.use_schema(spark, before)
    assert spark.table(f"spark_catalog.{schema}.t").count() == 3


def test_registering_a_catalog_twice_changes_nothing(spark):
    jdbc = "org.apache.spark.sql.execution.datasources.v2.jdbc.JDBCTableCatalog"
    options = {"url": "jdbc:hive2://nowhere.invalid/x", "driver": "org.apache.hive.jdbc.HiveDriver"}
    assert catalog.register_catalog(spark, "other_catalog", jdbc, options)
    assert not catalog.register_catalog(spark, "other_catalog", "no.such.Class")
    catalog.switch_catalog(spark, "other_catalog")
    try:
        assert catalog.current_catalog(spark) == "other_catalog"
    finally:
        catalog.switch_catalog(spark, "spark_catalog")
    assert {"other_catalog", "spark_catalog"} <= {r["catalog"] for r in catalog.list_catalogs(spark).collect()}


def test_names_and_literals_are_escaped():
    assert catalog.quoted("a.b`c") == "`a`.`b``c`"
    assert catalog.sql_text("it's \\ here") == "'it\\'s \\\\ here'"


def recorded_reader(bounds):
    """A stand-in session whose reader records its options; nothing connects."""
    loads = []

    class Reader:
        def __init__(self):
            self.settings = {}

        def format(self, name):
            self.settings["format"] = name
            return self

        def option(self, key, value):
            self.settings[key] = value
            return self

        def options(self, **more):
            self.settings.update(more)
            return self

        def load(self):
            loads.append(self.settings)
            return mock.Mock(first=lambda: bounds)

    session = mock.Mock()
    type(session).read = property(lambda _: Reader())
    return session, loads


def test_remote_table_is_read_in_ranges(spark):
    session, loads = recorded_reader((1, 900))
    sources.read_jdbc_table(session, "jdbc:x:y", "movies", partition_column="id", partitions=9)
    assert loads[0]["query"] == "SELECT min(id) AS lo, max(id) AS hi FROM movies"
    assert loads[1] == {
        "format": "jdbc", "url": "jdbc:x:y", "fetchsize": "10000", "dbtable": "movies",
        "partitionColumn": "id", "lowerBound": "1", "upperBound": "900", "numPartitions": "9",
    }
    session, loads = recorded_reader((Decimal("0.5"), 7.9))
    sources.read_jdbc_table(session, "jdbc:x:y", "movies", partition_column="id")
    assert (loads[1]["lowerBound"], loads[1]["upperBound"]) == ("0", "7")
    session, loads = recorded_reader((None, None))
    sources.read_jdbc_table(session, "jdbc:x:y", "movies", partition_column="id")
    assert "partitionColumn" not in loads[1]
    with pytest.raises(ValueError):
        sources.read_jdbc_table(session, "jdbc:x:y", "movies")


def test_remote_table_may_be_read_by_conditions():
    session = mock.Mock()
    sources.read_jdbc_table(session, "jdbc:x:y", "t", predicates=["k = 7", "k <> 7"], properties={"user": "u"})
    session.read.jdbc.assert_called_once_with(
        "jdbc:x:y", "t", predicates=["k = 7", "k <> 7"], properties={"fetchsize": "10000", "user": "u"}
    )


def test_remote_query_is_sent_as_it_is_or_divided(spark):
    session, loads = recorded_reader(None)
    sources.read_jdbc_query(session, "jdbc:x:y", "SELECT 1")
    assert loads[0]["query"] == "SELECT 1"
    session, loads = recorded_reader(None)
    sources.read_jdbc_query(session, "jdbc:x:y", "SELECT a FROM t", partition_column="a", bounds=(0, 5), partitions=2)
    assert loads[0]["dbtable"] == "(SELECT a FROM t) remote_query" and loads[0]["numPartitions"] == "2"


def test_scratch_is_in_the_shared_folder(spark, conf):
    root = spark.conf.get("spark.checkpoint.dir")
    assert scratch_path(spark, "x").startswith(f"{root}/") and scratch_path(spark, "x") != scratch_path(spark, "x")


def test_scratch_falls_back_to_the_warehouse():
    settings = {"spark.master": "yarn", "spark.sql.warehouse.dir": "hdfs:///warehouse"}
    session = mock.Mock()
    session.conf.get = lambda key, default=None: settings.get(key, default)
    assert scratch_path(session, "x").startswith("hdfs:///warehouse/tallyframe/x-")


def test_scan_tasks_grow_with_the_table():
    mib = 1024 * 1024
    assert scan_split_bytes() == scan_split_bytes(10**12) == 128 * mib
    assert scan_split_bytes(200_000 * 500 * mib) == 500 * mib and scan_split_bytes(10**18) == 1024 * mib


def test_shuffle_partitions_grow_with_the_data():
    assert shuffle_partitions_for(8) == 8 and shuffle_partitions_for() == 200
    assert shuffle_partitions_for(8, 128 * 1024 * 1024 * 1000 + 1) == 1001


def test_listing_leaves_the_files_to_the_tasks(spark, tmp_path, monkeypatch):
    """Folders of each level are listed in tasks; the driver sees one count for each level."""
    for i in range(12):
        folder = tmp_path / "deep" / f"a{i % 4}" / f"_b {i}%"
        folder.mkdir(parents=True)
        for name in ("x*1.dat", "y?.dat", "[z].txt", f"{i}.crc", "é.dat"):
            (folder / name).write_bytes(b"1" * i)
    (tmp_path / "deep" / "empty").mkdir()
    calls = []
    monkeypatch.setattr(sources.files, "_listed_by_driver", lambda *a: calls.append(a))
    found = sources.list_files(spark, str(tmp_path / "deep"))
    assert not calls and found.count() == 60
    assert found.agg(F.sum("bytes")).first()[0] == 5 * sum(range(12))
    assert {r.path.split(":")[0] for r in found.collect()} == {"file"}
    names = lambda p: {r.path.rsplit("/", 1)[1] for r in sources.list_files(spark, str(tmp_path / "deep"), p).collect()}
    assert names("*.dat") == {"x*1.dat", "y?.dat", "é.dat"}
    assert names("[!x]?.dat") == {"y?.dat"} and names("x[*]*") == {"x*1.dat"} and names("?.dat") == {"é.dat"}
    single = sources.list_files(spark, str(tmp_path / "deep" / "a3" / "_b 3%" / "é.dat")).collect()
    assert [r.bytes for r in single] == [3]
    assert sources.list_files(spark, str(tmp_path / "deep" / "empty")).count() == 0
    with pytest.raises(FileNotFoundError):
        sources.list_files(spark, str(tmp_path / "nothing"))


def test_listing_by_the_driver_is_in_chunks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sources.files, "CHUNK", 3)
    for i in range(8):
        (tmp_path / f"_{i}.dat").write_bytes(b"12")
    found = sources.list_files(spark, str(tmp_path), options={"io.file.buffer.size": "8192"})
    assert found.count() == 8 and found.agg(F.sum("bytes")).first()[0] == 16
    assert sources.list_files(spark, str(tmp_path), "*3*", options={"io.file.buffer.size": "8192"}).count() == 1


def test_listing_with_a_file_system_of_ones_own(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_bytes(b"123")
    root = str(tmp_path)

    def below():
        from pyarrow import fs

        return fs.SubTreeFileSystem(root, fs.LocalFileSystem())

    assert [(r.path, r.bytes) for r in sources.list_files(spark, "in", filesystem=below).collect()] == [("in/a", 3)]


HALF_WAY = "if(id = 7, raise_error('half-way'), id) AS id"


@pytest.mark.parametrize("write", ["write_csv", "write_single_csv", "write_directory"])
def test_a_failing_overwrite_keeps_the_old_files(spark, tmp_path, write):
    path = str(tmp_path / "out")
    write = getattr(sinks, write)
    write(spark.range(3), path)
    before = sorted(p.name for p in (tmp_path / "out").iterdir())
    with pytest.raises(Exception, match="half-way"):
        write(spark.range(9).selectExpr(HALF_WAY), path)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == before
    assert [p.name for p in tmp_path.iterdir()] == ["out"]
    write(spark.range(4), path)
    assert [p.name for p in tmp_path.iterdir()] == ["out"] and sorted(p.name for p in (tmp_path / "out").iterdir()) != before


def test_a_failing_switch_of_folders_keeps_the_old_files(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "out")
    sinks.write_directory(spark.range(3), path)
    real = sinks.files._rename

    def breaks(files, source, target):
        if source.getName().endswith("_new"):
            raise OSError("no switch")
        real(files, source, target)

    monkeypatch.setattr(sinks.files, "_rename", breaks)
    with pytest.raises(OSError, match="no switch"):
        sinks.write_directory(spark.range(9), path)
    assert spark.read.parquet(path).count() == 3 and [p.name for p in tmp_path.iterdir()] == ["out"]


def test_a_failing_external_write_keeps_the_table(spark, schema, tmp_path):
    name, path = f"{schema}.ext", str(tmp_path / "ext")
    sinks.write_external_table(spark.range(3), name, path, "parquet")
    with pytest.raises(Exception, match="half-way"):
        sinks.write_external_table(spark.range(9).selectExpr(HALF_WAY), name, path, "parquet")
    assert spark.table(name).count() == 3
    sinks.write_external_table(spark.range(5).withColumnRenamed("id", "other"), name, path, "parquet")
    assert spark.table(name).columns == ["other"] and spark.table(name).count() == 5


def test_a_failing_rename_keeps_the_table(spark, schema, monkeypatch):
    sinks.refresh_table(spark.range(5), f"{schema}.t")
    real = sinks.tables._rename

    def breaks(spark, source, target):
        if "_new_" in source:
            raise RuntimeError("no switch")
        real(spark, source, target)

    monkeypatch.setattr(sinks.tables, "_rename", breaks)
    with pytest.raises(RuntimeError, match="no switch"):
        sinks.refresh_table(spark.range(9), f"{schema}.t")
    assert spark.table(f"{schema}.t").count() == 5
    assert [r.table for r in catalog.list_tables(spark, schema).collect()] == ["t"]


def test_a_table_left_between_two_names_is_found_again(spark, schema):
    sinks.refresh_table(spark.range(5), f"{schema}.t")
    spark.sql(f"ALTER TABLE {schema}.t RENAME TO {schema}.t_old_{'0a' * 16}")
    assert sinks.recover_table(spark, f"{schema}.t") and not sinks.recover_table(spark, f"{schema}.t")
    assert spark.table(f"{schema}.t").count() == 5
    assert not sinks.recover_table(spark, f"{schema}.never")
