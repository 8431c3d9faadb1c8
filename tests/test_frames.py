from __future__ import annotations

from pyspark.sql import functions as F

from busvitals.operators import frames as fr, identifiers, windows as wi
from busvitals.sources import can_logs

FRAME = "vehicle_id string, capture string, attack_type string, attack_label int, t_us bigint, seq bigint, can_id int, dlc int, payload array<int>, flag int"


def make(spark, rows):
    return spark.createDataFrame(rows, FRAME)


def frame(seq, t, can_id=1, payload=(), capture="Normal", flag=0, vehicle="v"):
    return (vehicle, capture, capture, int(capture != "Normal"), t, seq, can_id, len(payload), list(payload), flag)


def test_csv_lines_good_and_corrupt(spark, tmp_path):
    lines = [
        "1478198376.389427,0316,8,05,21,68,09,21,21,00,6f,R",
        "1478198376.389636,018f,2,fe,5b,T",
        "1478198376.389864,0260,0,R",
        "1478198376.4,0260,3,aa,bb,R",
        "oops,0260,1,aa,R",
        "1478198376.5,zz,1,aa,R",
        "1478198376.5,0260,1,aa,X",
        "1478198376.5,0260,9,1,2,3,4,5,6,7,8,9,R",
        "",
    ]
    (tmp_path / "log.csv").write_text("\n".join(lines) + "\n")
    good, corrupt = can_logs.read_can_log(spark, str(tmp_path / "log.csv"))
    got = {r["can_id"]: r for r in good.collect()}
    assert sorted(got) == [0x18F, 0x260, 0x316]
    assert got[0x18F]["payload"] == [0xFE, 0x5B] and got[0x18F]["flag"] == 1
    assert got[0x260]["payload"] == [] and got[0x316]["t_us"] == 1478198376389427
    assert corrupt.count() == 6


def test_txt_lines_good_and_corrupt(spark, tmp_path):
    lines = [
        "Timestamp: 1478198376.389427  ID: 0316  DLC: 8  05 21 68 09 21 21 00 6f  Flag: R",
        "Timestamp: 1.5 ID: 0x18f DLC: 2 fe 5b Flag: T",
        "Timestamp: 1.5 ID: 18f DLC: 3 fe 5b Flag: T",
        "no frame here",
    ]
    (tmp_path / "log.txt").write_text("\n".join(lines))
    good, corrupt = can_logs.read_can_log(spark, str(tmp_path / "log.txt"), style="txt")
    assert {(r["can_id"], tuple(r["payload"]), r["flag"]) for r in good.collect()} == {
        (0x316, (5, 33, 104, 9, 33, 33, 0, 111), 0), (0x18F, (254, 91), 1)}
    assert corrupt.count() == 2


def test_dedup_keeps_the_first_and_drops_malformed(spark):
    df = make(spark, [frame(5, 10, payload=(1, 2)), frame(3, 10, payload=(1, 2)), frame(4, 10, payload=(1, 3)), frame(9, 11)])
    bad = df.where("seq = 9").withColumn("t_us", F.lit(None).cast("bigint")).unionByName(df.where("seq = 9").withColumn("dlc", F.lit(4)))
    assert sorted(r["seq"] for r in fr.dedup_frames(df.unionByName(bad)).collect()) == [3, 4, 9]


def test_payload_columns(spark):
    df = make(spark, [frame(0, 0), frame(1, 1, payload=(0, 0, 255)), frame(2, 2, payload=tuple(range(8)), can_id=5000)])
    rows = fr.payload_entropy(fr.payload_stats(fr.can_id_features(df))).orderBy("seq").collect()
    assert (rows[0]["payload_mean"], rows[0]["payload_std"], rows[0]["payload_entropy"], rows[0]["payload_max"]) == (0.0, 0.0, 0.0, 0)
    assert rows[1]["payload_mean"] == 85.0 and abs(rows[1]["payload_std"] - 120.20815) < 1e-4
    assert abs(rows[1]["payload_entropy"] - 0.9182958) < 1e-6 and rows[1]["payload_non_zero_count"] == 1
    assert abs(rows[2]["payload_entropy"] - 3.0) < 1e-12 and rows[2]["is_extended_id"] == 1


def test_windows_of_several_vehicles_and_tails(spark):
    rows = [frame(i, i * 1000, can_id=i % 7, payload=(i % 256,), vehicle=v, capture=c)
            for v, c, n in (("a", "Normal", 130), ("b", "Normal", 124), ("a", "DoS", 49)) for i in range(n)]
    df = make(spark, rows)
    counts = {}
    for tail in ("drop", "keep", "round"):
        got = wi.window_features(df, tail=tail).collect()
        counts[tail] = sorted((r["vehicle_id"], r["capture"], r["w"], r["n_frames"]) for r in got)
    assert counts["drop"] == [("a", "Normal", 0, 50), ("a", "Normal", 1, 50), ("b", "Normal", 0, 50), ("b", "Normal", 1, 50)]
    assert len(counts["keep"]) == 7
    assert [c for c in counts["round"] if c not in counts["drop"]] == [("a", "DoS", 0, 49), ("a", "Normal", 2, 30)]


def test_window_without_time_span(spark):
    df = make(spark, [frame(i, 5_000_000, can_id=3) for i in range(50)])
    r = wi.window_features(df).first()
    assert r["messages_per_second"] is None and r["frequency_spike_score"] is None
    assert r["message_burst_score"] == 1.0 and r["can_id_entropy"] == 0.0 and r["window_payload_mean"] is None


def test_features_do_not_depend_on_partitions_or_blocks(spark):
    rows = [frame(i, (i * 7919) % 10_007 * 100, can_id=(i * i) % 11, payload=tuple((i * k) % 256 for k in range(i % 9)), capture="Fuzzy" if i % 3 else "Normal")
            for i in range(3000)]
    df = make(spark, rows)
    a = wi.window_features(df.repartition(1)).collect()
    b = wi.window_features(df.repartition(13), block_rows=40, max_blocks=1000).collect()

    def key(r):
        return (r["capture"], r["w"])

    for x, y in zip(sorted(a, key=key), sorted(b, key=key), strict=True):
        for c, v in x.asDict().items():
            assert v == y[c] or abs(v - y[c]) < 1e-9 * max(1.0, abs(v)), c


def test_majority_label(spark):
    rows = [frame(i, i, capture="DoS", flag=int(i % 50 < (26 if i < 50 else 25))) for i in range(100)]
    got = {r["w"]: (r["attack_label"], r["attack_type"]) for r in wi.window_features(make(spark, rows), label="majority").collect()}
    assert got == {0: (1, "DoS"), 1: (0, "Normal")}


def test_both_labels_equal_those_of_the_features(spark):
    rows = [frame(i, i * 1000, capture="DoS", flag=int(i % 50 < (10 if i < 50 else 40))) for i in range(130)]
    framed = wi.count_window(fr.payload_entropy(fr.payload_stats(make(spark, rows))))
    got = {r["w"]: tuple(r[c] for c in ("capture_label", "capture_type", "majority_label", "majority_type")) for r in wi.both_labels(framed).collect()}
    for k, mode in enumerate(("capture", "majority")):
        want = {r["w"]: (r["attack_label"], r["attack_type"]) for r in wi.features_of_windows(framed, label=mode).collect()}
        assert {w: v[2 * k : 2 * k + 2] for w, v in got.items()} == want
    assert set(got) == {0, 1} and got[0][2:] == (0, "Normal") and got[1][2:] == (1, "DoS")


def test_identifier_frequencies_by_hand(spark):
    normal = [frame(i, i * 1000, can_id=1 if i % 2 else 2) for i in range(100)]
    attack = [frame(i, i * 1000, can_id=9 if i < 20 else 1, capture="DoS") for i in range(50)] + [frame(i, i * 1000, can_id=None, capture="DoS") for i in range(50, 100)]
    frames = make(spark, normal + attack)
    shares = identifiers.normal_id_shares(frames)
    assert {r["can_id"]: r["share"] for r in shares.collect()} == {1: 0.5, 2: 0.5}
    got = {(r["capture"], r["w"]): r for r in identifiers.id_frequency_deviation(wi.count_window(frames), shares).collect()}
    assert abs(got[("Normal", 0)]["id_deviation"]) < 1e-12 and got[("Normal", 1)]["unseen_ids"] == 0
    dos = got[("DoS", 0)]  # shares 0.4 of 9 and 0.6 of 1 against 0.5 of 1 and 0.5 of 2
    assert abs(dos["id_deviation"] - 0.5) < 1e-12 and (dos["unseen_ids"], dos["unseen_frames"], dos["loudest_id"]) == (1, 20, 9)
    assert abs(got[("DoS", 1)]["id_deviation"] - 1.0) < 1e-12 and got[("DoS", 1)]["unseen_frames"] == 50
    per_vehicle = identifiers.normal_id_shares(frames, ["vehicle_id"])
    again = identifiers.id_frequency_deviation(wi.count_window(frames), per_vehicle, by=["vehicle_id"])
    assert {(r["capture"], r["w"]): r["id_deviation"] for r in again.collect()} == {k: r["id_deviation"] for k, r in got.items()}


def test_stored_sketches_count_identifiers_of_any_grouping(spark):
    frames = spark.range(60_000).selectExpr("concat('v', id % 3) AS vehicle_id", "concat('c', id % 7) AS capture", "cast(id * 7 % (3000 + 1000 * (id % 7)) AS int) AS can_id")
    sketches = identifiers.id_sketches(frames).persist()
    assert sketches.count() == 21
    for by in ([], ["capture"], ["vehicle_id"]):
        told = {tuple(r[b] for b in by): (r["frames"], r["unique_ids"]) for r in identifiers.unique_ids(sketches, by).collect()}
        for r in frames.groupBy(*by).agg(F.count("*").alias("frames"), F.countDistinct("can_id").alias("n")).collect():
            n, guess = told[tuple(r[b] for b in by)]
            assert n == r["frames"] and abs(guess - r["n"]) <= identifiers.estimate_error() * r["n"]
