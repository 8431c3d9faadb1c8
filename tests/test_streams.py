"""A stream in several disordered files must give what the batch gives."""

from __future__ import annotations

from pyspark.sql import functions as F

from busvitals.operators import windows as wi
from busvitals.operators.baseline import fit_baseline
from busvitals.operators.kernel import fit_parzen, rbf_score
from busvitals.streaming.count_windows import CountWindowTables, start_count_windows, window_batch
from busvitals.streaming.health import HealthTables, follow, health_batch, start_health, stream_health
from busvitals.streaming.keyed_health import KeyedHealthTables, continued, start_keyed_health
from busvitals.streaming.keyed_windows import KeyedWindowTables, all_windows, start_keyed_windows, start_windows

from test_frames import FRAME, frame

DELAY = 40_000


def disordered(n=700):
    """Frames of three series; each is delivered up to 30 positions too early or too late."""
    rows = [
        frame(i, i * 1000, can_id=(i * i) % 13, payload=tuple((i * k) % 251 for k in range(i % 9)), capture=c, vehicle=v)
        for v, c in (("a", "Normal"), ("b", "Normal"), ("a", "DoS")) for i in range(n)
    ]
    return sorted(rows, key=lambda r: r[4] + (r[5] * 7919 % 30) * 1000)


def rounded(df):
    return df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def test_disordered_stream_equals_batch(spark, tmp_path):
    rows = disordered()
    for i in range(0, len(rows), 500):
        spark.createDataFrame(rows[i : i + 500], FRAME).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    # one frame far in the future of every series releases what the delay still holds back
    flush = [frame(10_000, 10_000_000, vehicle=v, capture=c) for v, c in (("a", "Normal"), ("b", "Normal"), ("a", "DoS"))]
    spark.createDataFrame(flush, FRAME).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(FRAME).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    start_count_windows(stream, str(tmp_path / "out"), delay_us=DELAY).awaitTermination()
    tables = CountWindowTables.at(spark, str(tmp_path / "out"))
    assert tables.late.all().count() == 0
    batch = wi.window_features(spark.createDataFrame(rows, FRAME))
    streamed = tables.windows.all().select(*batch.columns)
    assert streamed.count() == batch.count() == 42
    assert rounded(streamed).exceptAll(rounded(batch)).count() == 0


def test_late_frames_and_replayed_epochs(spark, tmp_path):
    tables = CountWindowTables.at(spark, str(tmp_path))
    first = spark.createDataFrame([frame(i, i * 1000) for i in range(10, 130)], FRAME)
    second = spark.createDataFrame([frame(i, i * 1000) for i in list(range(3)) + list(range(130, 170))], FRAME)
    window_batch(first, 0, tables)
    window_batch(second, 1, tables)
    once = [sorted(map(str, t.all().collect())) for t in (tables.windows, tables.late, tables.pending, tables.seen)]
    window_batch(second, 1, tables)
    assert once == [sorted(map(str, t.all().collect())) for t in (tables.windows, tables.late, tables.pending, tables.seen)]
    assert sorted(r["seq"] for r in tables.late.all().collect()) == [0, 1, 2]
    assert sorted(r["w"] for r in tables.windows.all().collect()) == [0, 1, 2]
    assert tables.pending.before(2).count() == 10


def test_followed_windows_equal_batch_and_are_decided_once(spark, tmp_path):
    from test_models import windows

    data = windows(spark, 150, 60, shift=1.5).drop("capture").withColumn("capture", F.col("attack_type"))
    model = fit_parzen(data)
    baseline = fit_baseline(rbf_score(data, model)).persist()
    for lo, hi in ((0, 30), (30, 90), (90, 150)):
        part = data.where((F.col("w") >= lo) & (F.col("w") < hi))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(data.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    start_health(stream, str(tmp_path / "out"), model, baseline).awaitTermination()
    tables = HealthTables.at(spark, str(tmp_path / "out"))
    batch = follow(stream_health(data, model, baseline))
    columns = ["vehicle_id", "capture", "w", "cyber_health", "trend", "trend_diff", "ema", "resume"]
    got, want = rounded(tables.followed.all().select(*columns)), rounded(batch.select(*columns))
    assert got.count() == 210 and got.exceptAll(want).count() == 0
    decided = tables.decisions.all()
    expected = want.count() - batch.where("risk_category IN ('Secure', 'Stable')").count()
    assert decided.count() == expected > 0
    # windows delivered a second time change nothing
    health_batch(stream_health(data, model, baseline), 3, tables, baseline)
    assert tables.followed.all().count() == 210 and tables.decisions.all().count() == expected


def test_epoch_of_many_files_in_any_order_loses_nothing(spark, tmp_path):
    from test_models import windows

    data = windows(spark, 150, 60, shift=1.5).drop("capture").withColumn("capture", F.col("attack_type"))
    model = fit_parzen(data)
    baseline = fit_baseline(rbf_score(data, model)).persist()
    data.repartition(100).write.parquet(str(tmp_path / "in"))
    # 40 of the 100 files at a time, so windows come before their predecessors and wait
    stream = spark.readStream.schema(data.schema).option("maxFilesPerTrigger", 40).parquet(str(tmp_path / "in"))
    start_health(stream, str(tmp_path / "out"), model, baseline).awaitTermination()
    tables = HealthTables.at(spark, str(tmp_path / "out"))
    batch = follow(stream_health(data, model, baseline))
    columns = ["vehicle_id", "capture", "w", "cyber_health", "trend", "trend_diff", "ema", "resume"]
    got, want = rounded(tables.followed.all().select(*columns)), rounded(batch.select(*columns))
    assert got.count() == 210 and got.exceptAll(want).count() == 0
    assert tables.early.before(3).count() == 0


# keyed state


def stream_of(spark, path, slices, schema=FRAME):
    for rows in slices:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def same(a, b):
    a, b = rounded(a), rounded(b.select(*a.columns))
    return a.count() == b.count() and a.exceptAll(b).count() == 0


def in_slices(rows, n):
    return [rows[i : i + n] for i in range(0, len(rows), n)]


def test_keyed_disordered_stream_equals_batch(spark, tmp_path):
    rows = disordered()
    flush = [frame(10_000, 10_000_000, vehicle=v, capture=c) for v, c in (("a", "Normal"), ("b", "Normal"), ("a", "DoS"))]
    stream = stream_of(spark, str(tmp_path / "in"), [*in_slices(rows, 500), flush])
    start_keyed_windows(stream, str(tmp_path / "out"), delay_ms=DELAY // 1000).awaitTermination()
    tables = KeyedWindowTables.at(spark, str(tmp_path / "out"))
    assert tables.late.all().count() == 0
    batch = wi.window_features(spark.createDataFrame(rows, FRAME))
    assert batch.count() == 42 and same(tables.windows.all().select(*batch.columns), batch)


def test_watermark_releases_and_sets_aside_and_restarts(spark, tmp_path):
    """Late is what arrives below (newest time of earlier batches - delay); a restart in between changes nothing."""
    rows = disordered()
    slices = in_slices(rows, 300)
    delay = 15
    clock, late = 0, set()
    for part in slices:
        late |= {(r[0], r[1], r[5]) for r in part if r[4] // 1000 < clock}
        clock = max(clock, max(r[4] for r in part) // 1000 - delay)
    assert late
    taken = [r for r in rows if (r[0], r[1], r[5]) not in late and r[4] // 1000 <= clock]
    batch = wi.window_features(spark.createDataFrame(taken, FRAME))

    def outcome(root):
        tables = KeyedWindowTables.at(spark, root)
        got = {(r["vehicle_id"], r["capture"], r["seq"]) for r in tables.late.all().collect()}
        assert got == late
        assert same(tables.windows.all().select(*batch.columns), batch)

    start_keyed_windows(stream_of(spark, str(tmp_path / "in"), slices), str(tmp_path / "a"), delay_ms=delay).awaitTermination()
    outcome(str(tmp_path / "a"))
    for k in (2, len(slices)):  # the first slices, then the rest from the checkpoint
        stream = stream_of(spark, str(tmp_path / "in2"), slices[:2] if k == 2 else slices[2:])
        start_keyed_windows(stream, str(tmp_path / "b"), delay_ms=delay).awaitTermination()
    assert KeyedWindowTables.at(spark, str(tmp_path / "b")).windows.all().count() == batch.count()
    got = {(r["vehicle_id"], r["capture"], r["seq"]) for r in KeyedWindowTables.at(spark, str(tmp_path / "b")).late.all().collect()}
    # the first run ended with a batch without data, which moves no clock beyond what its data had moved
    assert got == late
    assert same(KeyedWindowTables.at(spark, str(tmp_path / "b")).windows.all().select(*batch.columns), batch)


def state_rows(query):
    return [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]], [
        p["stateOperators"][0]["numRowsUpdated"] for p in query.recentProgress if p["stateOperators"]]


def test_silent_series_cost_nothing_and_expire(spark, tmp_path):
    quiet = [frame(i, i * 1000, vehicle=f"q{v}") for v in range(40) for i in range(60)]
    busy = [[frame(i, i * 1000, vehicle="live") for i in range(a, a + 100)] for a in range(100, 500, 100)]
    late_on = [frame(i, 9_000_000 + i * 1000, vehicle="live") for i in range(600, 700)]
    back = [frame(i, 9_700_000 + (i - 1000) * 1000, vehicle="q3") for i in range(1000, 1060)]
    stream = stream_of(spark, str(tmp_path / "in"), [quiet, *busy, late_on, back])
    query = start_keyed_windows(stream, str(tmp_path / "out"), expire_after=5_000)
    query.awaitTermination()
    total, updated = state_rows(query)
    assert max(total) == 41 and total[-1] <= 2
    assert updated[0] == 40 and max(updated[2:5]) <= 2
    tables = KeyedWindowTables.at(spark, str(tmp_path / "out"))
    gone = {r["vehicle_id"]: (r["n_windows"], r["n_pending"], r["last_us"]) for r in tables.expired.all().collect()}
    assert len(gone) == 40 and set(gone.values()) == {(1, 10, 59_000)}
    # the series that came back starts anew, told apart by its start
    again = [(r["w"], r["started_us"]) for r in tables.windows.all().where("vehicle_id = 'q3'").collect()]
    assert sorted(again) == [(0, 0), (0, 9_700_000)]


def test_unknown_event_types_stay_out_of_the_stream(spark, tmp_path):
    from busvitals.plans import stream_questions
    from busvitals.plans.workspace import Workspace

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    odd = events.withColumn("event_type", F.when(F.col("event_id") % 10 == 3, "telemetry").when(F.col("event_id") % 10 == 4, None).otherwise(F.col("event_type")))
    odd.write.parquet(str(tmp_path / "data" / "events.parquet"))
    ws = Workspace(spark, str(tmp_path / "data"))
    frames, unknown = stream_questions.deliver(ws)
    start_keyed_windows(frames, str(tmp_path / "out")).awaitTermination()
    batch = wi.window_features(ws.frames())
    assert batch.count() and same(KeyedWindowTables.at(spark, str(tmp_path / "out")).windows.all().select(*batch.columns), batch)
    aside = unknown.writeStream.format("memory").queryName("unknown_events").trigger(availableNow=True).start()
    aside.awaitTermination()
    assert spark.table("unknown_events").count() == odd.where("event_type IS NULL OR event_type = 'telemetry'").count() > 0


def test_busy_series_by_tables_others_by_state(spark, tmp_path):
    rows = disordered()
    flush = [frame(10_000, 10_000_000, vehicle=v, capture=c) for v, c in (("a", "Normal"), ("b", "Normal"), ("a", "DoS"))]
    stream = stream_of(spark, str(tmp_path / "in"), [*in_slices(rows, 700), flush])
    for query in start_windows(stream, str(tmp_path / "out"), (F.col("vehicle_id") == "a") & (F.col("capture") == "Normal"), delay_ms=DELAY // 1000):
        query.awaitTermination()
    batch = wi.window_features(spark.createDataFrame(rows, FRAME))
    assert same(all_windows(spark, str(tmp_path / "out")).select(*batch.columns), batch)
    assert KeyedWindowTables.at(spark, str(tmp_path / "out" / "keyed")).windows.all().select("vehicle_id", "capture").distinct().count() == 2


def timed(data):
    """Windows with the session columns that the window stream gives them."""
    return data.withColumns({"started_us": F.lit(0).cast("bigint"), "ended_us": (F.col("w") + 1) * 50_000})


def test_keyed_health_equals_batch_in_any_order(spark, tmp_path):
    from test_models import windows

    data = windows(spark, 150, 60, shift=1.5).drop("capture").withColumn("capture", F.col("attack_type"))
    model = fit_parzen(data)
    baseline = fit_baseline(rbf_score(data, model)).persist()
    timed(data).repartition(100).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(timed(data).schema).option("maxFilesPerTrigger", 40).parquet(str(tmp_path / "in"))
    query = start_keyed_health(stream, str(tmp_path / "out"), model, baseline)
    query.awaitTermination()
    tables = KeyedHealthTables.at(spark, str(tmp_path / "out"))
    batch = follow(stream_health(data, model, baseline))
    columns = ["vehicle_id", "capture", "w", "cyber_health", "trend", "trend_diff", "ema", "resume", "n_frames", "attack_label"]
    assert tables.followed.all().count() == 210
    assert same(tables.followed.all().select(*columns), batch.select(*columns))
    assert tables.stranded.all().count() == 0
    expected = batch.where("risk_category NOT IN ('Secure', 'Stable')").count()
    assert tables.decisions.all().count() == expected > 0
    # windows delivered a second time change nothing
    timed(data).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    start_keyed_health(stream, str(tmp_path / "out"), model, baseline).awaitTermination()
    assert tables.followed.all().count() == 210 and tables.decisions.all().count() == expected
    total, _ = state_rows(query)
    assert max(total) == data.select("vehicle_id", "capture").distinct().count()


def test_health_state_expires_and_strands_what_waits(spark, tmp_path):
    from test_models import windows

    data = timed(windows(spark, 150, 60, shift=1.5).drop("capture").withColumn("capture", F.col("attack_type")))
    model = fit_parzen(data.drop("started_us", "ended_us"))
    baseline = fit_baseline(rbf_score(data, model)).persist()
    far = F.lit(10**12).cast("bigint")
    one = data.where("capture = 'Normal'")
    lost = one.where("w < 5 OR w IN (7, 8)").coalesce(1)
    lost.write.parquet(str(tmp_path / "in"))
    one.where("w = 0").withColumns({"started_us": far, "ended_us": far}).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(data.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = start_keyed_health(stream, str(tmp_path / "out"), model, baseline, expire_after=1000)
    query.awaitTermination()
    tables = KeyedHealthTables.at(spark, str(tmp_path / "out"))
    assert sorted(r["w"] for r in tables.stranded.all().collect()) == [7, 8]
    assert sorted(r["w"] for r in tables.followed.all().collect()) == [0, 0, 1, 2, 3, 4]
    assert state_rows(query)[0][-1] == 1


def test_continued_in_pieces_equals_whole():
    import numpy as np

    health = np.random.default_rng(3).uniform(30, 90, 70)
    whole = continued(np.zeros(0), 0.0, 0, health)
    for size in (1, 3, 11, 25):
        ring, level, got = np.zeros(0), 0.0, []
        for a in range(0, len(health), size):
            part = health[a : a + size]
            got.append(continued(ring, level, a, part))
            ring, level = np.concatenate([ring, part])[-20:], got[-1][1][-1]
        for mine, theirs in zip(map(np.concatenate, zip(*got)), whole):
            assert np.allclose(mine, theirs, atol=1e-9)


def test_old_state_is_removed_and_outputs_stay(spark, tmp_path):
    tables = CountWindowTables.at(spark, str(tmp_path))
    for epoch in range(4):
        window_batch(spark.createDataFrame([frame(i, i * 1000) for i in range(epoch * 60, epoch * 60 + 60)], FRAME), epoch, tables)
    assert sorted(p.name for p in (tmp_path / "seen").iterdir()) == sorted(p.name for p in (tmp_path / "pending").iterdir()) == ["epoch=2", "epoch=3"]
    assert sorted(r["w"] for r in tables.windows.all().collect()) == [0, 1, 2, 3]


def test_a_slice_of_many_events_comes_in_several_batches_in_order(spark, tmp_path, monkeypatch):
    from types import SimpleNamespace

    from busvitals.plans import stream_questions

    micros = "1704067200000000 + CAST(pow(id, 1.5) AS BIGINT) * 1000 + id % 1000"
    events = spark.range(3_000).selectExpr(
        "id AS event_id", f"timestamp_micros({micros}) AS ts", "id % 50 AS user_id", "'click' AS event_type", "1.0D AS value", "'' AS props")
    events.write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(stream_questions, "BATCH_EVENTS", 400)
    monkeypatch.setattr(stream_questions, "fresh_path", lambda _, label: str(tmp_path / label))
    stream_questions.deliver(SimpleNamespace(spark=spark, folder=str(tmp_path)))
    rows = spark.read.parquet(str(tmp_path / "delivered")).selectExpr("event_id", "unix_millis(ts) AS ms", "_metadata.file_name AS f", "_metadata.file_modification_time AS m").collect()
    assert sorted(r.event_id for r in rows) == list(range(3_000))
    batches = {}
    for r in rows:
        batches.setdefault(r.f.split("-", 2)[2].rsplit("-", 1)[0], []).append(r)
    assert max(map(len, batches.values())) < 500
    ordered = sorted(batches.values(), key=lambda b: min(r.m for r in b))
    assert all(max(r.ms for r in a) < min(r.ms for r in b) for a, b in zip(ordered, ordered[1:]))


def test_windows_of_a_long_series_are_given_out_in_small_tables():
    from busvitals.streaming import keyed_windows

    import pandas as pd

    class State:
        exists = hasTimedOut = False

        def getCurrentWatermarkMs(self):
            return 10**9

        def update(self, value):
            pass

        def setTimeoutTimestamp(self, at):
            pass

    n = 3 * keyed_windows.ROWS_AT_ONCE + 70
    rows = pd.DataFrame({c: 0 for c in keyed_windows._CARRIED}, index=range(n)).assign(
        t_us=10**12, seq=range(n), attack_type="Normal", payload_entropy=0.0)
    out = list(keyed_windows.advance(("v", "c"), iter([rows[k : k + 7_000] for k in range(0, n, 7_000)]), State(), 50, 10**6))
    assert sum(map(len, out)) == n // 50 * 50 and max(map(len, out)) <= keyed_windows.ROWS_AT_ONCE
