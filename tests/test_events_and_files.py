from datetime import datetime, timedelta

from pyspark.sql import functions as F

from doppel.operators import events, generate, relational, shaping
from doppel.sources import readers, writers
from doppel.streaming import admission, privacy, rates

START = datetime(2024, 1, 1)


def requests(spark, seconds, key="a"):
    return spark.createDataFrame([(i, key, START + timedelta(seconds=s)) for i, s in enumerate(seconds)],
                                 "event_id bigint, key string, ts timestamp_ntz")


def limiter(seconds, span, limit):
    kept, out = [], []
    for s in seconds:
        kept = [k for k in kept if k >= s - span]
        out.append(len(kept) < limit)
        if out[-1]:
            kept.append(s)
    return out


def test_sixth_of_five_is_rejected_and_window_ends_are_inclusive(spark):
    seconds = [0, 1, 2, 3, 4, 5, 59, 60, 61, 62, 200, 200, 261]
    out = events.rate_limit_admission(requests(spark, seconds), "key", "ts", "event_id", 60, 5).orderBy("event_id").toPandas()
    assert list(out["admitted"]) == limiter(seconds, 60, 5)
    assert not out["admitted"].iloc[5]


def test_admission_of_a_busy_key_beside_quiet_ones(spark):
    busy = [i * 7 % 3000 for i in range(600)]
    busy.sort()
    df = requests(spark, busy, "busy").unionByName(requests(spark, [5, 4000, 9000], "quiet"))
    out = events.rate_limit_admission(df, "key", "ts", "event_id", 60, 4).filter("key = 'busy'").orderBy("event_id").toPandas()
    assert list(out["admitted"]) == limiter(busy, 60, 4)


def test_rate_counts_the_trailing_window(spark):
    seconds = sorted([i * 13 % 2000 for i in range(400)])
    out = events.request_rate(requests(spark, seconds), "key", "ts", 60, 10).orderBy("event_id").toPandas()
    want = [sum(1 for t in seconds if s - 60 <= t <= s) for s in seconds]
    assert list(out["used"]) == want
    assert list(out["remaining"]) == [max(0, 10 - w) for w in want]


def test_audit_figures_of_an_empty_log(spark):
    log = spark.createDataFrame([], "event_id int, ts timestamp, row_count int, execution_time_ms double, privacy_noise boolean")
    assert tuple(events.audit_stats(log, "ts", "event_id").first()) == (0, 0, 0.0, 0.0)


def test_streamed_admission_over_several_batches(spark, tmp_path):
    seconds = sorted([i * 11 % 500 for i in range(120)])
    df = requests(spark, seconds).orderBy("event_id")
    for k in range(3):
        df.filter((F.col("event_id") >= k * 40) & (F.col("event_id") < (k + 1) * 40)).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    out = privacy.run_available(admission.stream_admission(stream, "key", "ts", "event_id", 60, 3), str(tmp_path / "out"))
    got = out.withColumn("event_id", F.col("event_id").cast("int")).orderBy("event_id").toPandas()
    assert list(got["admitted"]) == limiter(seconds, 60, 3)


def test_late_events_are_dropped(spark, tmp_path):
    for k, seconds in enumerate([[0, 1, 1000], [1001], [2, 1002], [2000]]):
        requests(spark, seconds).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema("event_id bigint, key string, ts timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    out = privacy.run_available(rates.stream_request_rate(stream, "key", "ts", "60 seconds", "60 seconds", "10 seconds"), str(tmp_path / "out"))
    used = {r["window_start"].second + 60 * r["window_start"].minute: r["used"] for r in out.collect()}
    assert used[0] == 2 and used[960] == 3  # the event at second 2 came after the watermark had passed it


def test_csv_json_and_sql_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "O'Neil, \"Al\"", 2.5, None), (2, None, 3.456, "x;y")], "id int, name string, v double, note string")
    writers.write_table(df, f"{tmp_path}/csv", "csv")
    assert sorted(map(tuple, readers.read_delimited(spark, f"{tmp_path}/csv", ",", "UTF-8", df.schema).collect()), key=str)[1][0] == 2
    writers.write_table(df, f"{tmp_path}/json", "json")
    assert readers.read_json_records(spark, f"{tmp_path}/json", lines=True).count() == 2
    got = [r[0] for r in writers.insert_statements(df, "t").orderBy("statement").collect()]
    assert got == ["INSERT INTO t (id, name, v, note) VALUES (1, 'O''Neil, \"Al\"', 2.5, NULL);",
                   "INSERT INTO t (id, name, v, note) VALUES (2, NULL, 3.46, 'x;y');"]


def test_separators_and_wrapped_json(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x;y\n1;2\n")
    (tmp_path / "b.tsv").write_text("x\ty\n1\t2\n")
    for name in ("a.txt", "b.tsv"):
        assert [tuple(r) for r in readers.read_delimited(spark, str(tmp_path / name)).collect()] == [(1, 2)]
    (tmp_path / "latin.csv").write_bytes("n\ncaf\xe9\n".encode("latin-1"))
    assert readers.read_csv(spark, str(tmp_path / "latin.csv")).first()["n"] == "caf\xe9"
    (tmp_path / "w.json").write_text('{"meta": 1,\n "rows": [{"a": {"b": 1}}, {"a": {"b": 2}}]}')
    assert [r["a.b"] for r in readers.read_json_records(spark, str(tmp_path / "w.json")).collect()] == [1, 2]
    (tmp_path / "l.json").write_text('[{"a": 1},\n {"a": 2}]')
    assert readers.read_json_records(spark, str(tmp_path / "l.json")).count() == 2


def test_relational_export(spark, tmp_path):
    made = relational.generate_template(generate.rows(spark, 20))
    writers.write_relational(made, str(tmp_path / "out"), template=relational.TEMPLATE)
    schema = "\n".join(r["value"] for r in spark.read.text(f"{tmp_path}/out/sql/schema").collect())
    assert "FOREIGN KEY (order_id) REFERENCES orders(order_id)" in schema and "customer_id INTEGER PRIMARY KEY" in schema
    assert spark.read.text(f"{tmp_path}/out/sql/orders").count() == made["orders"].count()


def test_search_and_pages(spark):
    df = spark.range(45).select("id", F.concat(F.lit("Item "), F.col("id")).alias("name"))
    assert shaping.search_rows(df, " ITEM 4 ").count() == 6
    assert shaping.search_rows(df, "  ").count() == 45
    assert [r["id"] for r in shaping.page_rows(df, ["id"], 99, 20).collect()] == list(range(40, 45))
    assert shaping.cap_sample(df, ["id"], max_rows=10, max_columns=1).count() == 10
    few = [tuple(r) for r in shaping.cap_sample(df.repartition(9), ["id"], max_rows=10).collect()]
    assert few == [tuple(r) for r in shaping.cap_sample(df.coalesce(1), ["id"], max_rows=10).collect()]


def test_sample_by_threshold(spark):
    """The k least draws, also where draws are equal and where every bin is cut again."""
    df = spark.range(3000).selectExpr("id", "cast(pmod(xxhash64(id), 1000003) as double) / 1000003 as u").repartition(5)
    want = [r["id"] for r in df.orderBy("u", "id").limit(700).collect()]
    for small, bins in ((10_000, 4096), (3, 4), (0, 2)):
        got = [r["id"] for r in shaping.least_draws(df, "u", 700, ["id"], small, bins).collect()]
        assert sorted(got) == sorted(want)
    same = spark.range(50).selectExpr("id", "if(id < 40, 0.25D, 0.5D) as u")
    assert shaping.least_draws(same, "u", 30, ["id"], 3, 4).count() == 30
    assert shaping.least_draws(same, "u", 45, ["id"], 3, 4).filter("u < 0.3").count() == 40
    assert shaping.least_draws(same, "u", 99, ["id"], 3, 4).count() == 50 and shaping.least_draws(same, "u", 0, ["id"]).count() == 0


def test_pages_by_rank(spark):
    """Deep pages of any key, with nulls, ties and hot values, equal the sorted rows."""
    rows = [(None if i % 50 == 0 else "hot" if i % 3 == 0 else f"k{i % 97}", float("nan") if i % 41 == 0 else float(i % 7), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "a string, b double, id long").repartition(6)
    want = [r["id"] for r in df.orderBy("a", "b", "id").collect()]
    for page, size in ((1, 7), (40, 13), (150, 13), (9999, 13), (3, 600)):
        got = [r["id"] for r in shaping.page_rows(df, ["a", "b", "id"], page, size, small=20).collect()]
        at = (min(page, -(-2000 // size)) - 1) * size
        assert got == want[at:at + size]
    hits = [r["id"] for r in df.filter("a = 'hot'").orderBy("id").collect()]
    assert [r["id"] for r in shaping.page_rows(df, ["id"], 20, 10, "HOT", small=20).collect()] == hits[190:200]
    assert shaping.page_rows(df, ["id"], 5, 10, "nothing", small=20).count() == 0


def test_admission_in_sets_equals_one_by_one(spark):
    """Bursts, ties, quiet stretches and keys at the limit: the same verdicts as one event after another."""
    import random
    rng = random.Random(9)
    for limit, span in ((3, 60), (1, 5), (7, 40)):
        made, want = None, {}
        for key in ("a", "b", None):
            seconds, t = [], 0
            for _ in range(300):
                t += rng.choice([0, 0, 1, 1, 2, 5, 30 if rng.random() < 0.9 else 400])
                seconds.append(t)
            want[key] = limiter(seconds, span, limit)
            df = requests(spark, seconds, key or "x").withColumn("key", F.lit(key).cast("string"))
            made = df if made is None else made.unionByName(df)
        out = events.rate_limit_admission(made.repartition(5), "key", "ts", "event_id", span, limit).toPandas()
        for key, verdicts in want.items():
            mine = out[out["key"].isna()] if key is None else out[out["key"] == key]
            assert list(mine.sort_values("event_id")["admitted"]) == verdicts


def test_admission_sets():
    import numpy as np
    at = np.array([0, 0, 0, 1, 5, 6, 6, 7, 20], np.int64)
    ok, held = events.admit_sorted(at, [], 5, 2)
    assert ok.tolist() == limiter(at.tolist(), 5, 2) and held == [20]
    assert not events.admit_sorted(at, [], 5, 0)[0].any()


def test_busy_key_under_the_limit_is_spread(spark):
    """A key that is never silent and never over the limit needs no order: nothing goes through one task."""
    df = spark.range(20000).selectExpr("id as event_id", "'k' as key", "timestamp_micros(id * 30000000) as ts")
    out = events.rate_limit_admission(df, "key", "ts", "event_id", 60, 4)
    assert out.filter("admitted").count() == 20000
    sizes = out.groupBy(F.spark_partition_id()).count().toPandas()["count"]
    assert sizes.max() < 20000


def test_streamed_admission_in_event_time(spark, tmp_path):
    """Events that arrive in another order are judged as the batch form does, and silent keys leave no state."""
    import random
    rng = random.Random(4)
    seconds = sorted(rng.randrange(900) for _ in range(150))
    df = requests(spark, seconds).withColumn("key", F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("k"), (F.col("event_id") % 3).cast("string"))))
    rows = df.collect()
    mixed = sorted(rows, key=lambda r: (r["ts"].timestamp() + rng.random() * 90))
    for k in range(5):
        spark.createDataFrame(mixed[k * 30:(k + 1) * 30], df.schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    end = requests(spark, [100_000], "end").withColumn("event_id", F.lit(10_000))
    end.select(*[F.col(f.name).cast(f.dataType) for f in df.schema]).coalesce(1).write.parquet(f"{tmp_path}/in/9")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    query = (admission.stream_admission(stream, "key", "ts", "event_id", 60, 3, delay="120 seconds").writeStream.format("parquet")
             .option("checkpointLocation", f"{tmp_path}/state").option("path", f"{tmp_path}/out").trigger(availableNow=True).start())
    query.awaitTermination()
    got = {int(r["event_id"]): r["admitted"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {r["event_id"]: r["admitted"] for r in events.rate_limit_admission(df, "key", "ts", "event_id", 60, 3).collect()}
    assert got == want
    held = spark.read.format("statestore").option("stateVarName", "held").load(f"{tmp_path}/state")
    assert held.count() == 0
