import json
import math
import socket
import threading

import pytest
from pyspark.sql import functions as F

from aerotrace.functions import geometry
from aerotrace.functions.text import crc64_digest
from aerotrace.operators import learning
from aerotrace.operators.engagement import pair_features
from aerotrace.schema import PAIR_FEATURES
from aerotrace.session import visible
from aerotrace.streaming import packets
from aerotrace.streaming.replay import ROCKS


def run(spark, tmp_path, rows, schema, query):
    visible(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = query(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(str(tmp_path / "out")).collect()


def packet(t, x, enemy=True):
    return json.dumps({"timestamp": t, "has_enemy": enemy, "self_aircraft": {"x": x, "TAS": 200.0 + t, "alt_asl": 1000.0, "Gy": 4.0}, "enemy_aircraft": {"x": x + 3000.0, "y": 4000.0, "z": 0.0} if enemy else None})


def test_rates_survive_bad_packets_and_mode_switches(spark, tmp_path):
    rows = [("a", packet(0.0, 0.0)), ("a", "{broken"), ("a", packet(1.0, 5.0)), ("a", packet(2.0, 5.0, False)), ("a", packet(3.0, 5.0)), ("b", packet(1.0, 0.0))]
    got = run(spark, tmp_path, rows, "session string, value string", lambda s: packets.rates(packets.parsed(s)))
    a = {r.time: r for r in got if r.session == "a"}
    assert sorted(a) == [0.0, 1.0, 2.0, 3.0]
    assert a[0.0].self_speed_rate == 0 and a[1.0].self_speed_rate == pytest.approx(1.0) and a[1.0].distance == 5000 and a[1.0].distance_rate == 0
    assert a[2.0].distance == 0 and a[3.0].distance_rate == 0


def test_throttle(spark, tmp_path):
    got = run(spark, tmp_path, [("a", i / 100) for i in range(100)], "session string, time double", lambda s: packets.throttled(s, 10.0))
    assert len(got) == 10


def test_carried_state(spark, tmp_path):
    text = ["#0", "1,T=1", "2,T=1", "#1", "1,T=2", "-2", "#2"]
    got = run(spark, tmp_path, [("a", i, x) for i, x in enumerate(text)], "session string, line_no long, raw string", packets.carried)
    assert sorted((r.frame, r.object_id, r.value) for r in got) == [("1", "1", "T=1"), ("1", "2", "T=1"), ("2", "1", "T=2")]


def test_flatten_latest_and_framing(spark):
    x = spark.createDataFrame([("a", 1.0), ("a", 5.0), ("b", 2.0)], "session string, time double")
    assert sorted((r.session, r.time) for r in packets.latest(x).collect()) == [("a", 5.0), ("b", 2.0)]
    assert [r.session for r in packets.latest(x, now=6.0).collect()] == ["a"]
    nested = x.select(F.struct("time", F.struct("session").alias("in")).alias("out"))
    assert packets.flattened(nested).columns == ["out_time", "out_in_session"]
    assert packets.framed(b"ab", b"c\r\nde\nf") == (["abc", "de"], b"f")


def test_udp_reader_counts_what_it_received():
    reader = packets.UdpReader({"host": "127.0.0.1", "port": "0"})
    assert reader.latestOffset() == {"n": 0}
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        for i in range(3):
            s.sendto(str(i).encode(), reader.socket.getsockname())
    assert reader.latestOffset() == {"n": 3}
    part = reader.partitions({"n": 1}, {"n": 3})[0]
    assert list(reader.read(part)) == [("1",), ("2",)]
    reader.commit({"n": 2})
    assert list(reader.read(reader.partitions({"n": 2}, {"n": 3})[0])) == [("2",)]


def test_known_properties_are_merged():
    assert packets.merged("T=1|2|3|4|5|6,Name=x", "T=7||9") == "T=7|2|9|4|5|6,Name=x"
    assert packets.merged("", "T=1|2|3,Name=a=b") == "T=1|2|3,Name=a=b"
    assert packets.merged("Name=x", "Name=") == "Name="


FRAMES = [
    "A,T=44|41|5000|0|0|90,Type=Air+FixedWing,Name=F/A-18C,Pilot=Ace,Coalition=Blue,TAS=200", "B,T=44.01|41|5000,Type=Air+FixedWing,Coalition=Red,TAS=300", "C,T=44.02|41|5000,Type=Air+FixedWing,Coalition=Red,TAS=300", "D,T=44|41|5000,Type=Air+FixedWing,Coalition=Blue",
    "#1", "A,TAS=220", "B,T=44.03||", "#2", "-B", "-C", "#3", "#wrong", "-A", "#4",
]


def test_features_on_frames(spark, tmp_path):
    got = {r.time: r for r in run(spark, tmp_path, [("a", i, x) for i, x in enumerate(FRAMES)], "session string, line_no long, raw string", packets.realtime_rates)}
    assert sorted(got) == [1.0, 2.0, 3.0]  # neither a bad time nor a frame without the player's aircraft
    degree = 6378137.0 * 0.017453292519943295 * 0.7547095802227721  # of longitude at 41 degrees north
    assert got[1.0].has_enemy and got[1.0].distance == pytest.approx(degree * 0.01)
    assert got[2.0].distance == pytest.approx(degree * 0.02) and got[2.0].distance_rate == pytest.approx(degree * 0.01)  # C is nearer now
    assert got[2.0].self_speed_rate == pytest.approx(20 * 0.514444)
    assert not got[3.0].has_enemy and got[3.0].distance == 0 and got[3.0].distance_rate == 0


PLANE = "Type=Air+FixedWing,Name=x"
MOVES = [
    "#0", "A,T=44|41|5000|10|5|90,Type=Air+FixedWing,Name=F/A-18C,Pilot=Ace,Coalition=Blue,TAS=200,Mach=0.5", f"P,T=44.001|41|5,{PLANE},Coalition=Red,TAS=0", f"Q,T=44.002|41|5000,{PLANE},Coalition=Red,TAS=10", f"R,T=44.02|41|4000|||45,{PLANE},Coalition=Red",
    "#0.5", "R,T=44.0202||||", "A,T=44.001|||", "#1", "R,T=44.0206||3990||||", "A,T=44.0015|||,TAS=210", "#2.5", "R,T=44.021|||||90", "#3", "#3.5", "-R", "#4", f"S,T=44.03|41|4000,{PLANE},TAS=400", "#5",
]


def side(lon, alt, heading, speed, mach=None):
    x, z = 6378137.0 * math.radians(lon) * math.cos(math.radians(41)), 6378137.0 * math.radians(41)
    return {"x": x, "y": alt, "z": z, "altitude": alt, "speed": speed, "mach": mach or speed / 340.0, "heading": math.radians(heading), "pitch": 0.0, "bank": 0.0, "aoa": 0.0, "g_load": 0.0}


def test_every_feature_of_realtime_frames_and_their_scores(spark, tmp_path):
    """Against the batch features of the same sides; a parked and a slow opponent are nearer but don't count."""
    rows = [("a", i, x) for i, x in enumerate(MOVES)]
    got = {r.time: r for r in run(spark, tmp_path, rows, "session string, line_no long, raw string", packets.realtime_rates)}
    assert sorted(got) == [0.5, 1.0, 2.5, 3.0, 3.5, 4.0, 5.0]
    assert [r.enemy_object_id for _, r in sorted(got.items())] == [None, "R", "R", "R", "R", None, "S"]  # R is known to fly when it has moved
    knots, metre = 0.514444, 6378137.0 * math.radians(1) * math.cos(math.radians(41))
    speed = [0.0002 * metre / 0.5, math.hypot(0.0004 * metre, 10) / 0.5, 0.0004 * metre / 1.5]
    told = [(1.0, 44.001, 200, 44.0202, 4000, 45, speed[0]), (2.5, 44.0015, 210, 44.0206, 3990, 45, speed[1]), (3.0, 44.0015, 210, 44.021, 3990, 90, speed[2]), (3.5, 44.0015, 210, 44.021, 3990, 90, speed[2])]
    sides = []
    for t, lon, tas, lon2, alt2, heading2, speed2 in told:
        own, other = side(lon, 5000.0, 90, tas * knots, 0.5), side(lon2, float(alt2), heading2, speed2)
        sides.append({"source": "a", "time": t, "self_object_id": "A", "enemy_object_id": "R"} | {f"self_{k}": v for k, v in own.items()} | {f"enemy_{k}": v for k, v in other.items()})
    features = pair_features(spark.createDataFrame(sides))
    batch = {r.time: r for r in features.collect()}
    for t, want in batch.items():
        for f in PAIR_FEATURES:
            if t > 1.0 or f not in ("self_speed_rate", "self_ps_estimate"):  # the stream's frame before, without an opponent, has these too
                assert got[t][f] == pytest.approx(want[f], abs=1e-5), (t, f)
    alone = got[4.0]
    assert not alone.has_enemy and alone.speed_ratio == 1 and all(alone[f] == 0 for f in ("distance", "enemy_speed", "distance_rate", "ata_rate", "enemy_turn_rate", "relative_turn_rate", "delta_specific_energy"))
    model = learning.train_regressor(features.withColumn("score", F.col("distance") / 1e4), PAIR_FEATURES)
    seen = run(spark, tmp_path / "scores", rows, "session string, line_no long, raw string", lambda s: packets.scored(packets.realtime_rates(s), model))
    want = {r.time: r.advantage for r in learning.score(features, model, PAIR_FEATURES).collect()}
    assert {r.time: r.advantage for r in seen if r.time > 1 and r.enemy_object_id == "R"} == {t: pytest.approx(v, abs=1e-6) for t, v in want.items() if t > 1}
    assert all(r.category for r in seen) and len(seen) == 7


def test_a_new_recording_clears_what_was_known(spark, tmp_path):
    lines = ["FileType=x", "1,T=1|2|3,TAS=5", "#7", "FileType=x", "2,T=1|1|1", "#1", "2,T=1.001|1|1", "#2"]
    got = run(spark, tmp_path, [("a", i, x) for i, x in enumerate(lines)], "session string, line_no long, raw string", packets.told_frames)
    told = {r.frame: {o.object_id: o.speed for o in r.objects} for r in got}
    assert told["7"] == {"1": 0.0} and told["1"] == {"2": 0.0} and set(told["2"]) == {"2"} and told["2"]["2"] == pytest.approx(6378137.0 * math.radians(0.001) * math.cos(math.radians(1)))


def test_a_packet_has_every_feature(spark, tmp_path):
    rows = [("a", packet(t, 10 * t)) for t in (0.0, 1.0, 2.0)]
    got = {r.time: r for r in run(spark, tmp_path, rows, "session string, value string", lambda s: packets.rates(packets.parsed(s)))}
    assert got[2.0].enemy_speed == 200 and got[2.0].speed_ratio == pytest.approx(202 / 200) and got[2.0].self_g_load == 4 and got[2.0].altitude_diff == -3000
    assert got[2.0].self_turn_rate == got[2.0].relative_turn_rate == pytest.approx(math.degrees(9.80665 * 15**0.5 / 202))


def test_scores_on_a_stream(spark, tmp_path):
    df = spark.range(50).select((F.col("id") / 50).alias("a"), (F.col("id") % 5).cast("double").alias("b")).withColumn("score", F.col("a") * 1.5 - 0.5)
    model = learning.train_regressor(df, ["a", "b"])
    got = run(spark, tmp_path, [(0.9, 1.0), (None, 2.0)], "a double, b double", lambda s: learning.score(s, model, ["a", "b"]))
    batch = learning.score(spark.createDataFrame([(0.9, 1.0), (None, 2.0)], "a double, b double"), model, ["a", "b"]).collect()
    assert sorted((r.b, r.advantage, r.category) for r in got) == sorted((r.b, r.advantage, r.category) for r in batch)


def test_tcp_reader_shakes_hands_and_numbers_lines():
    server = socket.create_server(("127.0.0.1", 0))
    said = []

    def serve():
        s, _ = server.accept()
        with s:
            for _ in range(2):
                part = b""
                while not part.endswith(b"\0"):
                    part += s.recv(100)
                said.append(part)
                if len(said) == 1:
                    s.sendall(b"XtraLib.Stream.0\nhost\n\0FileType=x\r\n#0")
            s.sendall(b".5\n1,T=1|2|3\nhalf")

    thread = threading.Thread(target=serve)
    thread.start()
    reader = packets.TcpReader({"port": str(server.getsockname()[1]), "client": "me", "password": "secret"})
    end = reader.latestOffset()
    thread.join()
    server.close()
    assert end == {"n": 3} and list(reader.read(reader.partitions({"n": 0}, end)[0])) == [(0, "FileType=x"), (1, "#0.5"), (2, "1,T=1|2|3")]
    assert said == [("\n".join([*packets.GREETING, "me", "\0"])).encode(), f"{crc64_digest('secret')}\n\0".encode()]
    reader.commit(end)
    assert reader.latestOffset() == end


def test_sinks(spark, tmp_path):
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        s.bind(("127.0.0.1", 0))
        s.settimeout(5)
        packets.send_udp(spark.createDataFrame([(1, "a"), (2, "b")], "n int, t string"), port=s.getsockname()[1])
        assert sorted(s.recv(1000) for _ in range(2)) == [b'{"n":1,"t":"a"}', b'{"n":2,"t":"b"}']
    rows = [("a", packet(0.0, 0.0)), ("a", packet(1.0, 0.0, False))]
    spark.createDataFrame(rows, "session string, value string").write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # what was appended once isn't again
        stream = spark.readStream.schema("session string, value string").parquet(str(tmp_path / "in"))
        packets.appended(packets.parsed(stream), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    kept = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(kept) == 1 and kept[0].timestamp == 0.0 and kept[0].enemy_aircraft_y == 4000.0


def test_attitude_and_colour(spark):
    m = {k: F.lit(v) for k, v in {"xx": 0.0, "xy": 0.5, "xz": 0.75**0.5, "yy": 0.75**0.5, "zy": 0.0}.items()}
    heading, pitch, bank = spark.range(1).select(*(F.degrees(c) for c in geometry.euler(m))).first()
    assert (heading, pitch, bank) == (pytest.approx(90.0), pytest.approx(30.0), pytest.approx(0.0))
    told = spark.createDataFrame([(-2.0,), (-0.5,), (0.0,), (0.5,), (1.0,)], "s double").select(geometry.blend(F.col("s")).alias("c")).collect()
    assert [tuple(r.c) for r in told] == [(1, 0, 0), (1, 0.5, 0), (1, 1, 0), (0.5, 1, 0), (0, 1, 0)]


def test_rates_of_a_session_work_on_arrays_across_batches(monkeypatch):
    import numpy as np
    import pandas as pd

    class Kept:
        value = None

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

    class Handle:
        def getValueState(self, *_):  # noqa: N802
            return Kept()

    def slow(*_, **__):
        raise AssertionError("a frame of pandas for a few rows costs ten times the arithmetic")

    names = ["session", "time", "has_enemy", "self_object_id", "enemy_object_id", "enemy_heading", *(f for f in packets.PAIR_FEATURES if f not in ("self_speed_rate", "self_ps_estimate", "distance_rate", "ata_rate", "enemy_turn_rate", "relative_turn_rate"))]
    row = lambda i, t: {n: float(i * i + len(n)) for n in names} | {"session": "s", "time": t, "has_enemy": i % 3 != 0, "self_object_id": "a", "enemy_object_id": "b", "enemy_heading": i * 0.1}
    frame = lambda *rows: pd.DataFrame([row(*r) for r in rows], columns=names)
    batches = [[frame((2, 2.0)), frame((1, 1.0), (3, 2.0))], [], [frame((5, 5.0), (4, 4.0))]]
    monkeypatch.setattr(pd.DataFrame, "shift", slow)
    monkeypatch.setattr(pd.DataFrame, "sort_values", slow)
    processor = packets.Rates()
    processor.init(Handle())
    got = [r for b in batches for out in processor.handleInputRows(("s",), iter(b), None) for r in out.to_dict("records")]
    assert [r["time"] for r in got] == [1.0, 2.0, 2.0, 4.0, 5.0] and list(got[0])[:5] == names[:5]
    steps = {1: None, 2: 1.0, 3: 1 / 30, 4: 2.0, 5: 1.0}
    for i, r in enumerate(got, 1):
        before, both = i - 1, i % 3 != 0 and (i - 1) % 3 != 0 and i > 1
        want = (i * i - before * before) / steps[i] if steps[i] else 0.0
        assert np.isclose(r["self_speed_rate"], want) and np.isclose(r["distance_rate"], want if both else 0.0)
        assert np.isclose(r["enemy_turn_rate"], np.degrees(0.1 / steps[i]) if both else 0.0)
