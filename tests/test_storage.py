"""Readers, writers and incremental ingestion."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import rows
from trajmill import schemas as S
from trajmill.registry import tables
from trajmill.session import new_folder, work_folder
from trajmill.sources import manifest, scans, sinks
from trajmill.streaming import ingest


def test_unknown_problem_tables(spark, tmp_path):
    with pytest.raises(ValueError):
        scans.scan_problems(spark, str(tmp_path), "other", "test")
    with pytest.raises(ValueError):
        scans.scan_problems(spark, str(tmp_path), "evalplus/mbppplus", "train")


@pytest.mark.parametrize("dataset", sorted(S.PROBLEMS))
def test_problem_tables_round_trip(spark, sf, tmp_path, dataset):
    folder = str(tmp_path / "problems")
    table = tables.problems(spark, sf, dataset)
    assert [f.name for f in table.schema.fields] == S.PROBLEMS[dataset].names
    table.write.partitionBy("split").parquet(folder)
    got = scans.scan_problems(spark, folder, dataset, "test").select(*table.columns)
    assert rows(got) == rows(table.where("split = 'test'"))


NASTY = ['it\'s "both"', "a\\b", "line\nbreak\r\n\ttab", "comma, [x]", "é🙂", ""]


def nested(spark):
    data = [
        (i, i % 2, [("user", t), ("assistant", t[::-1])], [("assistant", t)], i % 2 == 0, i - 0.5)
        for i, t in enumerate(NASTY)
    ]
    schema = T.StructType(
        [f for f in S.SCORED.fields if f.name not in ("prompt_completion", "feedbacks")]
    )
    return spark.createDataFrame(data, schema)


@pytest.mark.parametrize("labels", ["double", "int", "boolean"])
def test_literal_csv(spark, tmp_path, labels):
    df = nested(spark)
    folder = str(tmp_path / "csv")
    cells = df.withColumns({c: sinks.literal_cell(F.col(c)) for c in ("prompt", "completion")})
    cells.withColumn("label", F.col("label").cast(labels)).write.option("header", True).option(
        "escape", '"'
    ).csv(folder)
    for multi_line in (True, False):
        got = scans.scan_scored_csv(spark, folder, df.schema, multi_line=multi_line)
        assert rows(got) == rows(df)


def test_foreign_csv_written_by_pandas(spark, tmp_path):
    df = nested(spark)
    frame = df.toPandas()
    for c in ("prompt", "completion"):
        frame[c] = [str([m.asDict() for m in cell]) for cell in frame[c]]
    frame["label"] = frame["label"].astype(float)
    frame["prompt_completion"] = [t + "\nsecond line" for t in NASTY]
    frame.to_csv(tmp_path / "data.csv")
    schema = T.StructType([*df.schema.fields, T.StructField("prompt_completion", T.StringType())])
    got = scans.scan_scored_csv(spark, str(tmp_path / "data.csv"), schema)
    assert rows(got.drop("prompt_completion")) == rows(df)
    assert sorted(r[0] for r in got.select("prompt_completion").collect()) == sorted(
        t + "\nsecond line" for t in NASTY
    )


def test_scored_csv_round_trip_and_index(spark, tmp_path):
    df = nested(spark)
    folder = str(tmp_path / "csv")
    sinks.write_scored_csv(df, folder)
    got = scans.scan_scored_csv(spark, folder, df.schema, cells="json", multi_line=False)
    assert rows(got) == rows(df)
    index = spark.read.option("header", True).csv(folder).select(F.col("row").cast("int"))
    assert sorted(r[0] for r in index.collect()) == list(range(len(NASTY)))


def test_append_keeps_earlier_files(spark, tmp_path):
    folder = tmp_path / "log"
    sinks.append_rollouts(spark.range(3), str(folder), "a")
    before = set(folder.rglob("*.parquet"))
    sinks.append_rollouts(spark.range(5), str(folder), "a")
    sinks.append_rollouts(spark.range(2), str(folder), "b")
    assert before <= set(folder.rglob("*.parquet"))
    got = spark.read.parquet(str(folder)).groupBy("run").count()
    assert rows(got) == [("a", 8), ("b", 2)]


def test_write_once(spark, tmp_path):
    folder = str(tmp_path / "t")
    assert sinks.write_once(spark.range(3), folder).count() == 3
    before = sorted((tmp_path / "t").glob("*.parquet"))
    assert sinks.write_once(spark.range(3).repartition(2), folder).count() == 3
    assert sorted((tmp_path / "t").glob("*.parquet")) == before
    # Other rows, twice the same row, or other columns are another table.
    double = spark.createDataFrame([(0,), (1,), (1,), (1,)], "id bigint")
    for other in (spark.range(9), spark.range(1, 4), double, spark.range(3).selectExpr("id", "id AS x")):
        with pytest.raises(ValueError):
            sinks.write_once(other, folder)
    assert sinks.write_once(spark.range(9), folder, rewrite=True).count() == 9
    # A stopped writer leaves files without a success marker.
    (tmp_path / "t/_SUCCESS").unlink()
    assert sinks.write_once(spark.range(2), folder).count() == 2


def test_write_once_by_tag(spark, tmp_path):
    """A tag names the input: then no row is read to compare."""
    folder = str(tmp_path / "t")
    sinks.write_once(spark.range(3), folder, tag="v1")
    broken = spark.range(3).selectExpr("raise_error('read') AS id").select(F.col("id").cast("bigint"))
    assert sinks.write_once(broken, folder, tag="v1").count() == 3
    with pytest.raises(ValueError):
        sinks.write_once(spark.range(3), folder, tag="v2")
    assert sinks.write_once(spark.range(5), folder, tag="v2", rewrite=True).count() == 5


def test_metric_lines(spark, tmp_path):
    data = [("r", m, x, v) for m, x, v in (("turn", 2, 0.5), ("turn", 1, 0.25), ("pass_at_k", 10, 1.0), ("best_of_n", 4, 0.75))]
    df = spark.createDataFrame(data, "run string, metric string, x int, value double")
    sinks.write_metric_lines(df, str(tmp_path / "lines"))
    files = list((tmp_path / "lines/run=r/metric=turn").glob("*.txt"))
    assert [f.read_text() for f in files] == ["Turn 1: 0.25\nTurn 2: 0.5\n"]
    lines = sorted(r["line"] for r in sinks.read_metric_lines(spark, str(tmp_path / "lines")).collect())
    assert lines == ["Best of N=4: 0.75", "Pass @ 10: 1.0", "Turn 1: 0.25", "Turn 2: 0.5"]


def test_latest_checkpoint(spark):
    names = ["checkpoint-9", "checkpoint-10", "checkpoint-x", "merged_checkpoint-99", "checkpoint-11-tmp"]
    df = spark.createDataFrame([("m", n) for n in names], "model string, name string")
    assert rows(manifest.latest_checkpoint(df, ["model"])) == [("m", 10, "checkpoint-10")]


class Session:
    """Just enough of a session to ask for its work folder."""

    def __init__(self, master, folder=None):
        self.sparkContext = type("Context", (), {"master": master, "applicationId": master})()
        self.conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: folder or default)})()


def test_work_folder(tmp_path):
    with pytest.raises(ValueError):
        work_folder(Session("spark://somewhere:7077"))
    shared = Session("spark://somewhere:7077", f"{tmp_path}/")
    assert new_folder(shared, "x").startswith(f"{tmp_path}/x-")
    local = Session("local[2]")
    assert work_folder(local) == work_folder(local)
    assert new_folder(local, "x") != new_folder(local, "x")


# --- streaming -----------------------------------------------------------------

ARRIVING = T.StructType(
    [
        T.StructField("data_id", T.LongType()),
        T.StructField("rollout_no", T.LongType()),
        T.StructField("label", T.BooleanType()),
    ]
)


def send(spark, folder, name, start, stop):
    """A file of rollouts."""
    df = spark.range(start, stop).select(
        (F.col("id") % 3).alias("data_id"),
        F.col("id").alias("rollout_no"),
        (F.col("id") % 2 == 0).alias("label"),
    )
    df.coalesce(1).write.mode("append").parquet(str(folder / name))


def stream(spark, folder, files_per_batch=None):
    return ingest.rollout_stream(
        spark, str(folder / "*"), ARRIVING, files_per_batch=files_per_batch
    )


def test_ingest_resumes_and_drops_resent_rows(spark, tmp_path):
    inbox, table, state = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "state")
    keys = ["data_id", "rollout_no"]
    send(spark, inbox, "a", 0, 10)
    send(spark, inbox, "b", 5, 20)
    ingest.ingest_rollouts(stream(spark, inbox, 1), table, state, keys)
    assert ingest.ingested(spark, table, ARRIVING).count() == 20
    ingest.ingest_rollouts(stream(spark, inbox, 1), table, state, keys)
    send(spark, inbox, "c", 0, 30)
    ingest.ingest_rollouts(stream(spark, inbox, 1), table, state, keys)
    got = ingest.ingested(spark, table, ARRIVING).select("rollout_no")
    assert [r[0] for r in rows(got)] == sorted(range(30), key=lambda i: str((i,)))
    # A lost checkpoint replays everything under a new run name.
    ingest.ingest_rollouts(stream(spark, inbox), table, str(tmp_path / "new"), keys, "again")
    assert ingest.ingested(spark, table, ARRIVING).count() == 30


def test_a_repeated_batch_leaves_the_same_rows(spark, tmp_path):
    inbox, table = tmp_path / "in", str(tmp_path / "table")
    keys = ["data_id", "rollout_no"]
    send(spark, inbox, "a", 0, 10)
    for attempt in range(2):
        # A fresh checkpoint with the same run name repeats batch 0.
        ingest.ingest_rollouts(stream(spark, inbox), table, str(tmp_path / f"s{attempt}"), keys)
        assert ingest.ingested(spark, table, ARRIVING).count() == 10


def test_running_pass_rate_equals_batch(spark, tmp_path):
    inbox, table, state = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "state")
    sink = ingest.batch_folder_sink(table)
    send(spark, inbox, "a", 0, 10)
    ingest.running_pass_rate(stream(spark, inbox, 1), sink, state, ["data_id", "rollout_no"])
    send(spark, inbox, "b", 10, 40)
    ingest.running_pass_rate(stream(spark, inbox, 1), sink, state, ["data_id", "rollout_no"])
    got = ingest.latest_counts(spark, table)
    batch = spark.read.schema(ARRIVING).parquet(str(inbox / "*"))
    want = batch.groupBy("data_id").agg(F.count(F.lit(1)), F.count_if("label"))
    assert rows(got) == rows(want)


def test_running_pass_rate_counts_a_resent_row_once(spark, tmp_path):
    inbox, table, state = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "state")
    sink = ingest.batch_folder_sink(table)
    keys = ["data_id", "rollout_no"]
    # Within a batch, in the next batch, and after a restart.
    for name, start, stop in (("a", 0, 20), ("b", 10, 30), ("c", 0, 20), ("d", 0, 35)):
        send(spark, inbox, name, start, stop)
        if name in "bd":
            ingest.running_pass_rate(stream(spark, inbox, 2 if name == "d" else 1), sink, state, keys)
    batch = spark.read.schema(ARRIVING).parquet(str(inbox / "*")).distinct()
    want = batch.groupBy("data_id").agg(F.count(F.lit(1)), F.count_if("label"))
    assert rows(ingest.latest_counts(spark, table)) == rows(want)


def test_ingest_reads_the_buckets_of_a_batch_only(spark, tmp_path):
    inbox, table, state = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "state")
    keys = ["data_id", "rollout_no"]
    send(spark, inbox, "a", 0, 40)
    ingest.ingest_rollouts(stream(spark, inbox), table, state, keys, buckets=8)
    assert len(list((tmp_path / "table").glob("run=main/batch=0/bucket=*"))) > 4
    one = spark.read.schema(ARRIVING).parquet(str(inbox / "a")).where("rollout_no = 3")
    bucket = one.select(F.pmod(F.xxhash64(*keys), F.lit(8)).alias("b")).first()["b"]
    # Foreign buckets hold what cannot be read.
    for part in (tmp_path / "table" / "run=main" / "batch=0").glob("bucket=*/*.parquet"):
        if f"bucket={bucket}/" not in str(part):
            part.write_bytes(b"broken")
            part.with_name(f".{part.name}.crc").unlink()
    one.coalesce(1).write.parquet(str(inbox / "b"))
    ingest.ingest_rollouts(stream(spark, inbox), table, state, keys, buckets=8)
    again = spark.read.parquet(str(tmp_path / "table" / "run=main" / "batch=0" / f"bucket={bucket}"))
    assert again.where("rollout_no = 3").count() == 1
    assert not list((tmp_path / "table").glob("run=main/batch=1/bucket=*/*.parquet"))


def test_ingest_index_stays_small_and_is_rebuilt(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "FAN", 2)
    inbox, table, state = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "state")
    keys, index = ["data_id", "rollout_no"], ingest.KeyIndex(spark, table)
    for n in range(5):
        send(spark, inbox, f"f{n}", 4 * n, 4 * n + 8)
    # A batch a file: each repeats half of another's rows.
    ingest.ingest_rollouts(stream(spark, inbox, 1), table, state, keys, buckets=2)
    assert sorted(level for level, _ in index.live()) == [0, 2]
    assert len(list((tmp_path / "table" / "_keys").glob("*-*"))) == 2
    assert ingest.ingested(spark, table, ARRIVING).count() == 24
    # A spoilt record costs a pass over the table and no row.
    index.commit([])
    marker = tmp_path / "table" / "_keys" / "_written.json"
    marker.with_name("._written.json.crc").unlink()
    marker.write_text("[[0,")
    send(spark, inbox, "late", 10, 30)
    ingest.ingest_rollouts(stream(spark, inbox, 1), table, state, keys, buckets=2)
    got = ingest.ingested(spark, table, ARRIVING).select("rollout_no")
    assert [r[0] for r in rows(got)] == sorted(range(30), key=lambda i: str((i,)))


def test_ingest_keeps_a_stated_row_of_repeats(spark, tmp_path):
    kept = []
    for n in (1, 5):
        inbox, table = tmp_path / f"in{n}", str(tmp_path / f"table{n}")
        send(spark, inbox, "a", 0, 10)
        rows_ = spark.read.schema(ARRIVING).parquet(str(inbox / "a"))
        other = rows_.withColumns({f.name: F.lit(True) for f in ARRIVING if f.dataType == T.BooleanType()})
        other.repartition(n).write.parquet(str(inbox / "b"))
        ingest.ingest_rollouts(stream(spark, inbox), table, str(tmp_path / f"s{n}"), ["data_id", "rollout_no"])
        kept.append(rows(ingest.ingested(spark, table, ARRIVING).select(*ARRIVING.names)))
    assert kept[0] == kept[1] and len(kept[0]) == 10
