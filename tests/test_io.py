import gzip
import zipfile

import pytest
from pyspark.sql import functions as F

from vitalgrid.sources import archives, readers, shared, writers
from vitalgrid.sources.readers import ColumnSpec, read_table
from vitalgrid.sources.writers import write_events

COLUMNS = [ColumnSpec("subject_id", "int"), ColumnSpec("charttime", "datetime", "%Y-%m-%d %H:%M:%S"), ColumnSpec("valuenum", "float"), ColumnSpec("value")]


def test_csv_plain_gzip_and_glob(spark, tmp_path):
    text = "subject_id,charttime,extra,valuenum,value\n1,2024-01-01 08:00:00,x,80,eighty\n2,2024-01-01 09:00:00,y,,\n"
    (tmp_path / "a.csv").write_text(text)
    with gzip.open(tmp_path / "b.csv.gz", "wt") as f:
        f.write(text)
    for path in (f"{tmp_path}/a.csv", f"{tmp_path}/b.csv.gz", f"{tmp_path}/a*.csv"):
        got = readers.read_table(spark, path, COLUMNS, partitions=2)
        assert got.columns == [c.name for c in COLUMNS]
        assert sorted((r.subject_id, r.valuenum, r.value) for r in got.collect() if r.valuenum) == [(1, 80.0, "eighty")]
        assert got.where("valuenum is null and value is null").count() == 1
    assert readers.read_table(spark, f"{tmp_path}/none*.csv", COLUMNS) is None
    (tmp_path / "bad.csv").write_text("subject_id,charttime,valuenum,value\nx,2024-01-01 08:00:00,1,\n")
    with pytest.raises(Exception):
        readers.read_table(spark, f"{tmp_path}/bad.csv", COLUMNS).collect()
    assert readers.format_of("a.csv.zip") == "csv.zip"


def test_parquet_casts_leniently(spark, tmp_path):
    spark.createDataFrame([(1, "x", 2.5)], "subject_id int, value string, valuenum double").write.parquet(f"{tmp_path}/p")
    got = readers.read_table(spark, f"{tmp_path}/p", [ColumnSpec("subject_id", "int"), ColumnSpec("value", "int"), ColumnSpec("valuenum", "float")])
    assert got.dtypes == [("subject_id", "bigint"), ("value", "bigint"), ("valuenum", "float")]
    assert got.first()["value"] is None


def test_writers(spark, tmp_path):
    e = spark.createDataFrame([(1, None, "a", 1.0, None, "X"), (2, None, "b", 1.0, None, "Y")], "subject_id long, time timestamp_ntz, code string, numeric_value float, text_value string, event string")
    writers.write_events([e, e.withColumn("more", F.lit("m"))], f"{tmp_path}/e", "d", "1", "t")
    back = spark.read.parquet(f"{tmp_path}/e")
    assert back.count() == 4 and back.where("event = 'X'").count() == 2
    writers.write_concept([e.drop("event").withColumn("dataset", F.lit("d"))], f"{tmp_path}/c", "hr", "1")
    writers.write_concept([e.drop("event").withColumn("dataset", F.lit("d"))], f"{tmp_path}/c", "hr", "2")
    assert spark.read.parquet(f"{tmp_path}/c").groupBy("version").count().count() == 2
    writers.write_vocabulary(e, f"{tmp_path}/v")
    assert spark.read.parquet(f"{tmp_path}/v").columns == ["code", "description", "parent_codes"]
    writers.write_shards(e, f"{tmp_path}/s", 1)
    assert spark.read.parquet(f"{tmp_path}/s").select("shard").distinct().count() == 2


def test_staging(spark, tmp_path):
    with pytest.raises(ValueError):
        writers.staging_columns([("p", [ColumnSpec("a", "int")]), ("p", [ColumnSpec("a", "float")])])
    (tmp_path / "x.csv").write_text("a,b,c\n1,2,3\n")
    placed = writers.stage(spark, [(f"{tmp_path}/x.csv", [ColumnSpec("a", "int")]), (f"{tmp_path}/x.csv", [ColumnSpec("c", "int")])], f"{tmp_path}/out")
    assert spark.read.parquet(placed[f"{tmp_path}/x.csv"]).columns == ["a", "c"]


def test_part_files_with_another_header_are_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,2\n")
    (tmp_path / "b.csv").write_text("b,a\n20,10\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_table(spark, f"{tmp_path}/*.csv", [ColumnSpec("a", "int"), ColumnSpec("b", "int")]).collect()


def test_zipped_csv(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "t.csv.zip", "w") as z:
        z.writestr("one.csv", 'a,b,c\n1,"x\ny",\n2,,z\n')
        z.writestr("two.csv", "c,a,b\nw,3,v\n")
    df = read_table(spark, f"{tmp_path}/*.csv.zip", [ColumnSpec("a", "int"), ColumnSpec("b")])
    assert sorted((r.a, r.b) for r in df.collect()) == [(1, "x\ny"), (2, None), (3, "v")]


def test_writing_again_replaces(spark, tmp_path):
    e = spark.range(3).selectExpr("id as subject_id", "current_timestamp() as time", "'c' as code", "'X' as event")
    for _ in range(2):
        write_events([e], str(tmp_path / "e"), "d", "1", "t")
    write_events([e.withColumn("event", F.lit("Y"))], str(tmp_path / "e"), "d", "1", "t")
    assert spark.read.parquet(str(tmp_path / "e")).groupBy("event").count().orderBy("event").collect() == [("X", 3), ("Y", 3)]


def test_zip_members_are_tasks(spark, tmp_path):
    df = spark.range(1000).selectExpr("id as a", "case when id % 7 = 0 then null else concat('\"x, ', id, '\n') end as b").repartition(3)
    assert archives.write_zipped(df, f"{tmp_path}/z", member_rows=100) == 3
    names = sorted(n for p in (tmp_path / "z").glob("*.zip") for n in zipfile.ZipFile(p).namelist())
    back = read_table(spark, f"{tmp_path}/z/part-*.csv.zip", [ColumnSpec("b"), ColumnSpec("a", "int")])
    assert back.rdd.getNumPartitions() == len(names) >= 10
    assert sorted(map(tuple, back.select("a", "b").collect())) == sorted(map(tuple, df.collect()))
    assert read_table(spark, f"{tmp_path}/z", [ColumnSpec("a", "int")], fmt="csv.zip").count() == 1000
    assert read_table(spark, f"{tmp_path}/none.csv.zip", [ColumnSpec("a")]) is None
    assert archives.write_zipped(df.limit(0), f"{tmp_path}/empty") == 0
    with pytest.raises(Exception, match="no column c"):
        read_table(spark, f"{tmp_path}/z/*.csv.zip", [ColumnSpec("c")]).collect()


def test_a_ragged_row_in_an_archive_is_an_error(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "t.csv.zip", "w") as z:
        z.writestr("one.csv", "a,b\n1,2\n3\n")
        z.writestr("empty.txt", "not read")
    with pytest.raises(Exception, match="1 fields"):
        read_table(spark, f"{tmp_path}/t.csv.zip", [ColumnSpec("a")]).collect()


def test_member_is_read_as_a_stream(tmp_path):
    with zipfile.ZipFile(tmp_path / "big.csv.zip", "w", zipfile.ZIP_DEFLATED) as z, z.open("big.csv", "w") as f:
        f.write(b"a,b\n")
        for _ in range(300):
            f.write(b"1,2\n" * 1000)
    reader = archives.ZippedCsvReader(str(tmp_path / "big.csv.zip"), ["b"])
    (part,) = reader.partitions()
    sizes = [b.num_rows for b in reader.read(part)]
    assert sum(sizes) == 300_000 and max(sizes) == archives.BATCH_ROWS


def test_few_files_however_many_tasks(spark, tmp_path):
    e = spark.range(20_000).repartition(200).selectExpr("id as subject_id", "current_timestamp() as time", "'c' as code", "concat('E', id % 50) as event")
    write_events([e], f"{tmp_path}/e", "d", "1", "t")
    files = list((tmp_path / "e").rglob("*.parquet"))
    assert 50 <= len(files) <= 60 and spark.read.parquet(f"{tmp_path}/e").count() == 20_000
    write_events([e.where("event = 'E1'")], f"{tmp_path}/few", "d", "1", "t", file_rows=150)
    assert len(list((tmp_path / "few").rglob("*.parquet"))) == 3


def test_what_is_no_longer_made_goes(spark, tmp_path):
    e = spark.range(4).selectExpr("id as subject_id", "current_timestamp() as time", "'c' as code", "if(id < 2, 'X', 'Y/=') as event", "if(id < 2, 'a', 'b') as dataset")
    read = lambda: sorted((r.table, r.event, r.subject_id) for r in spark.read.parquet(f"{tmp_path}/e").collect())
    for table in ("t/1", "u"):
        write_events([e.drop("dataset")], f"{tmp_path}/e", "d", "1.0", table, mode="whole")
    write_events([e.where("event = 'X'").drop("dataset")], f"{tmp_path}/e", "d", "1.0", "t/1", mode="whole")
    assert read() == [("t/1", "X", 0), ("t/1", "X", 1), ("u", "X", 0), ("u", "X", 1), ("u", "Y/=", 2), ("u", "Y/=", 3)]
    for some in (e, e.where("dataset = 'b'")):
        writers.write_concept([some.drop("event")], f"{tmp_path}/c", "hr", "1", mode="whole")
    assert [r.subject_id for r in spark.read.parquet(f"{tmp_path}/c").orderBy("subject_id").collect()] == [2, 3]


def test_concepts_in_one_write(spark, tmp_path):
    rows = spark.range(300).selectExpr("299 - id as subject_id", "current_timestamp() as time", "concat('c', id % 3) as concept", "'d' as dataset")
    writers.write_concepts(rows, f"{tmp_path}/c", "1")
    for file in (tmp_path / "c").rglob("*.parquet"):
        ids = [r.subject_id for r in spark.read.parquet(str(file)).collect()]
        assert ids == sorted(ids)
    assert spark.read.parquet(f"{tmp_path}/c").groupBy("concept", "version", "dataset").count().count() == 3


def test_ranks_without_gaps(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"), F.lit(1).alias("c")).repartition(7)
    got = shared.ranked(df, [F.col("k")], "rank", "ranks")
    assert got.where("k <> rank").count() == 0 and got.columns == ["k", "c", "rank"] and shared.ranked(df.limit(0), [F.col("k")], "rank", "ranks").count() == 0
