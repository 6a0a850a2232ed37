import pytest
from pyspark.sql import functions as F

from kindred.operators import neighbours
from kindred.sources import logs
from kindred.sources import observations as obs
from kindred.sources import vectors as vec
from kindred.streaming import scoring


def test_rows_are_numbered_in_file_order(spark, tmp_path):
    lines = ["spatial,temporal,interest,reference,observation"]
    lines += [f"p{i},200{i % 10},t,1k,{'-' if i == 4 else i / 2}" for i in range(500)]
    path = tmp_path / "a.csv"
    path.write_text("\n".join(lines))
    (tmp_path / "b.csv").write_text(lines[0] + "\nlast,1,t,r,0.5\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = obs.read_unnumbered(spark, str(tmp_path / "*.csv")).orderBy("idx_global").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.idx_global for r in got] == list(range(501))
    assert [r.spatial for r in got] == [f"p{i}" for i in range(500)] + ["last"]
    assert got[4].observation is None and got[4].temporal == "2004"


def test_numbered_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(3, "a b", "2004", "x,y", "0.139", 1.5)], obs.OBSERVATIONS)
    obs.write_csv(df, str(tmp_path / "o"))
    assert obs.read_observations(spark, str(tmp_path / "o")).collect() == df.collect()


def test_first_rows_and_fetch(spark):
    df = spark.range(20).select(F.col("id").alias("idx_global"), (F.col("id") * 2).alias("v"))
    assert [r.idx_global for r in obs.first_rows(df, 3).collect()] == [0, 1, 2]
    ids = spark.createDataFrame([(5,), (99,)], "idx_global long")
    assert {(r.idx_global, r.v, r.found) for r in obs.fetch_rows(ids, df).collect()} == {(5, 10, True), (99, None, False)}
    assert obs.sample_rows(df, 0.5, exact=False).count() <= 20


def test_wide_csv_round_trip_and_missing_label(spark, vectors, tmp_path):
    df = vectors([[0.5, 0.25], [1, 2]], [3, -1])
    wide = vec.to_wide(df, 2, ["idx_global"])
    assert wide.columns == ["idx_global", "0", "1", "label"]
    obs.write_csv(wide, str(tmp_path / "w"))
    back = vec.read_wide_csv(spark, str(tmp_path / "w"), 2, ["idx_global"])
    assert sorted(map(str, back.select(*df.columns).collect())) == sorted(map(str, df.collect()))
    with pytest.raises(ValueError, match="label"):
        vec.from_wide(wide.drop("label"))
    obs.write_csv(wide.drop("label"), str(tmp_path / "u"))
    with pytest.raises(ValueError, match="label"):
        vec.read_wide_csv(spark, str(tmp_path / "u"), 2, ["idx_global"])


def test_vectors_in_folders(spark, vectors, tmp_path):
    df = vectors([[1, 0], [0, 1], [1, 1]], [1, 1, -1])
    vec.write_vectors(df.drop("label"), str(tmp_path / "v"), "st1")
    got = vec.read_vectors(spark, str(tmp_path / "v"))
    assert got.where("model = 'st1'").count() == 3
    assert vec.align_labels(got, df).count() == 3
    vec.write_labelled(df, str(tmp_path / "l"), 2)
    assert vec.group_rows(spark.read.parquet(str(tmp_path / "l")), 1).count() == 2


def test_stream_equals_batch_and_replays_do_not_double(spark, vectors, tmp_path):
    corpus = vectors([[1, 0], [0, 1], [1, 1]], [0, 1, 2])
    src = str(tmp_path / "in")
    asked = vectors([[1, 0.1], [0.1, 1]], ids=[1, 2]).select(F.col("idx_global").alias("query_id"), "embedding")

    def score(batch):
        return neighbours.global_topk(batch, corpus, 1).select("query_id", "label", "similarity")

    seen = []
    for part in (1, 2):
        asked.where(f"query_id = {part}").write.mode("append").parquet(src)
        stream = scoring.query_stream(spark, src, asked.schema, max_files=1)
        scoring.score_stream(stream, score, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
        seen.append(spark.read.parquet(str(tmp_path / "out")).count())
    assert seen == [1, 2]
    # The same input from the start into the same folder: the batches are replaced.
    stream = scoring.query_stream(spark, src, asked.schema, max_files=1)
    scoring.score_stream(stream, score, str(tmp_path / "out"), str(tmp_path / "ck2")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    assert sorted(map(str, out.collect())) == sorted(map(str, score(asked).collect()))


def test_log_ids_run_on_over_batches(spark, tmp_path):
    src = str(tmp_path / "in")
    for start in (0, 10, 20):
        spark.range(start, start + 10).withColumnRenamed("id", "query_id").coalesce(1).write.mode("append").parquet(src)
    schema = spark.read.parquet(src).schema
    for ck in ("a", "b"):
        stream = scoring.query_stream(spark, src, schema, max_files=1)
        scoring.log_stream(stream, str(tmp_path / "log"), str(tmp_path / ck)).awaitTermination()
    ids = [r.id for r in spark.read.parquet(str(tmp_path / "log")).collect()]
    assert sorted(ids) == list(range(1, 31))


def test_a_batch_of_the_log_reads_only_the_one_before(spark, tmp_path):
    src, log = str(tmp_path / "in"), tmp_path / "log"
    read = []
    known = logs.read_log

    def noted(session, path, schema):
        read.append(str(path).removeprefix(str(log)))
        return known(session, path, schema)

    def run(ck):
        stream = scoring.query_stream(spark, src, "query_id long", max_files=1)
        scoring.log_stream(stream, str(log), str(tmp_path / ck)).awaitTermination()

    patch = pytest.MonkeyPatch()
    patch.setattr(logs, "read_log", noted)
    try:
        for start in (0, 10, 20, 30):
            spark.range(start, start + 10).withColumnRenamed("id", "query_id").coalesce(1).write.mode("append").parquet(src)
            run("a")
        assert read[-4:] == ["/_last/batch=1", "/batch=2", "/_last/batch=2", "/batch=3"]
        assert read.count("") == 1
        # Rows without any id still hand the highest id on.
        spark.createDataFrame([], "query_id long").write.mode("append").parquet(src)
        spark.range(40, 45).withColumnRenamed("id", "query_id").coalesce(1).write.mode("append").parquet(src)
        run("a")
        first = {r.query_id: r.id for r in spark.read.parquet(str(log)).collect()}
        assert sorted(first.values()) == list(range(1, 46)) and max(first.values()) == first[44]
        # A batch run again, from the records of the batches before it, takes the same ids.
        run("b")
        again = [r.id for r in spark.read.parquet(str(log)).collect()]
        assert sorted(again) == list(range(1, 46))
    finally:
        patch.undo()
