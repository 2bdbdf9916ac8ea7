import gzip
import json

import pytest
from pyspark.sql import functions as F

from sparkloom.sources import lookup, records
from sparkloom.streaming import ingestion

SCHEMA = "n int, lang string"


@pytest.fixture()
def files(tmp_path):
    """Five files of 40 rows, of which every second one is German; in compressed and in plain files."""
    for f in range(5):
        text = "".join(json.dumps({"n": 100 * f + i, "lang": "de" if i % 2 else "en"}) + "\n" for i in range(40))
        (gzip.open if f % 2 else open)(tmp_path / f"part-{f}.jsonl{'.gz' if f % 2 else ''}", "wt").write(text)
    return tmp_path


@pytest.mark.parametrize("most", [0, 1, 20, 45, 99, 100, 1000])
def test_cap_over_files(spark, files, most):
    want = [100 * f + i for f in range(5) for i in range(40) if i % 2][:most]
    got = records.read_files(spark, str(files / "part-*"), SCHEMA, F.col("lang") == "de", ["n"], most)
    assert sorted(r["n"] for r in got.collect()) == want and got.columns == ["n"]


def test_cap_does_not_depend_on_tasks(spark, files):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("200", "1000", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = records.read_files(spark, str(files / "part-*"), SCHEMA, most=95)
            assert sorted(r["n"] for r in got.collect()) == [*range(40), *range(100, 140), *range(200, 215)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_repeated_broken_and_absent_files(spark, files):
    twice = records.read_files(spark, [str(files / "part-0*"), str(files / "part-[01]*"), str(files / "part-0*")], SCHEMA)
    assert sorted(r["n"] for r in twice.collect()) == [*range(40), *range(100, 140)]
    raw = (files / "part-1.jsonl.gz").read_bytes()
    (files / "part-1.jsonl.gz").write_bytes(raw[: len(raw) // 2])
    (files / "part-2.jsonl").write_text('{"n": 1, "lang": "de"}\nno object\n{"n": 2, "lang": "de"}\n')
    with pytest.raises(Exception, match="(?i)malformed|corrupt|unexpected end|failed"):
        records.read_files(spark, str(files / "part-*"), SCHEMA).collect()
    got = {r["n"] for r in records.read_files(spark, str(files / "part-*"), SCHEMA, strict=False).collect()}
    assert {1, 2, *range(40), *range(300, 340), *range(400, 440)} <= got and len(got) < 162
    with pytest.raises(ValueError, match="do not exist: x"):
        records.read_files(spark, str(files / "part-*"), SCHEMA, columns=["x"])
    with pytest.raises(Exception, match="(?i)no files|not exist|PATH_NOT_FOUND"):
        records.read_files(spark, str(files / "none-*"), SCHEMA).collect()


def test_canonical_on_every_level(spark):
    df = spark.sql("SELECT named_struct('b', 0.1D + 0.2D, 'a', map('z', 1.0D, 'y', -0.0D)) AS s, array(named_struct('q', 1, 'p', 2)) AS l")
    assert records.canonical(df).first()["value"] == '{"l":[{"p":2,"q":1}],"s":{"a":{"y":0.0,"z":1.0},"b":0.3}}'
    with pytest.raises(Exception, match="s.x is not finite"):
        records.canonical(spark.sql("SELECT named_struct('x', double('NaN')) AS s")).collect()


def rows_read(df) -> int:
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(int(leaves.apply(i).metrics().apply("numOutputRows").value()) for i in range(leaves.size()) if leaves.apply(i).metrics().contains("numFiles"))


def test_lookup_reads_few_row_groups(spark, tmp_path):
    path = str(tmp_path / "table")
    lookup.write_lookup(spark.range(60_000).selectExpr("concat('doc-', id) AS id", "id AS n", "repeat('x', 50) AS text"), path, "id", group_rows=500)
    ids = ["doc-7", "doc-59999", "absent", "doc-7", "doc-123", None]
    got = lookup.look_up(spark, path, "id", ids)
    assert [(r["pos"], r["id"], r["n"]) for r in got.orderBy("pos").collect()] == [(0, "doc-7", 7), (1, "doc-59999", 59999), (4, "doc-123", 123)] and "_digest" not in got.columns
    assert lookup.absent(spark, path, "id", ids) == ["absent", None]
    # the scan itself, without the join, gives rows of three row groups or so
    digests = [r[0] for r in spark.createDataFrame([(i,) for i in ids if i], "i string").select(F.xxhash64("i")).distinct().collect()]
    condition = F.lit(False)
    for d in digests:
        condition = condition | (F.col("_digest") == d)
    scan = spark.read.parquet(path).filter(condition).select("id")
    assert len(scan.collect()) == 3 and 3 <= rows_read(scan) <= 3 * 500
    everything = lookup.look_up(spark, path, "id", [f"doc-{i}" for i in range(1000)])
    assert everything.count() == 1000  # more than are pushed down
    assert lookup.look_up(spark, path, "id", []).count() == 0
    with pytest.raises(ValueError, match="_digest"):
        lookup.write_lookup(spark.range(1).withColumn("_digest", F.lit(1)), path, "id")


def test_stream_with_state_restarts(spark, tmp_path):
    """Copies within a batch, in a later batch and after a restart are left out, and the result is that of one batch."""
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    text = lambda i: f"document number {i} with enough characters to stay"
    fields = {"text": "body", "url": "link"}
    batches = [[(1, text(1), None), (1, text(1), None), (2, text(2), None)], [(1, text(1), None), (3, text(3), "u3")], [(3, "another text of the same address, long enough", "u3"), (4, text(4), None), (5, "short", None)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "n int, body string, link string").coalesce(1).write.mode("append").json(source)
        stream = spark.readStream.schema("n int, body string, link string").json(source)
        ingestion.ingest_with_state(stream, fields, "web", target, state).awaitTermination()
        if i == 0:  # started again without anything new
            ingestion.ingest_with_state(spark.readStream.schema("n int, body string, link string").json(source), fields, "web", target, state).awaitTermination()
    from sparkloom.operators.ingest import normalize_rows

    got = spark.read.parquet(target)
    whole = normalize_rows(spark.createDataFrame([r for b in batches for r in b], "n int, body string, link string"), fields, "web", order_by="n")
    assert got.count() == 4 and {r["id"] for r in got.collect()} == {r["id"] for r in whole.collect()}
    assert {r["text"] for r in got.filter("url = 'u3'").collect()} == {text(3)}


def test_stream_forgets_after_a_delay(spark, tmp_path):
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    rows = [("2024-01-01 00:00:00", "a text that is long enough to be kept here"), ("2024-01-01 00:05:00", "a text that is long enough to be kept here")]
    spark.createDataFrame(rows, "at string, body string").coalesce(1).write.json(source)
    stream = spark.readStream.schema("at timestamp, body string").json(source)
    ingestion.ingest_with_state(stream, {"text": "body"}, "web", target, state, late=("at", "10 minutes")).awaitTermination()
    got = spark.read.parquet(target)
    assert got.count() == 1 and "at" in got.columns
