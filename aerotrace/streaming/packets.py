"""Telemetry packets as streams: flattening, carried state, throttling, latest values and sinks."""

from __future__ import annotations

import contextlib
import dataclasses
import json
import socket
import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from aerotrace.functions import geometry as g
from aerotrace.functions.text import number, properties, property_value
from aerotrace.operators import learning
from aerotrace.operators.engagement import SIDE, is_aircraft, opposing, static_features
from aerotrace.schema import EARTH_RADIUS, KNOTS, PACKET, PAIR_FEATURES, SOUND_SPEED


def parsed(stream: DataFrame, column: str = "value") -> DataFrame:
    """Packets of a JSON text column; texts that aren't packets are dropped."""
    x = stream.withColumn("packet", F.from_json(column, PACKET, {"mode": "PERMISSIVE"}))
    return x.filter(F.col("packet.timestamp").isNotNull()).select("packet.*", *(c for c in stream.columns if c != column))


def flattened(df: DataFrame, separator: str = "_") -> DataFrame:
    """Nested columns as flat ones, names joined by the separator."""

    def walk(schema: T.StructType, path: str, name: str):
        for f in schema.fields:
            p, n = f"{path}`{f.name}`", f"{name}{f.name}"
            if isinstance(f.dataType, T.StructType):
                yield from walk(f.dataType, f"{p}.", f"{n}{separator}")
            else:
                yield F.col(p).alias(n)

    return df.select(*walk(df.schema, "", ""))


#: Columns of a frame: the player's side and its opponent's, named as in engagement.SIDE.
SIDES = [f"{who}_{c}" for who in ("self", "enemy") for c in SIDE]


def sides(packets: DataFrame, session: str = "session") -> DataFrame:
    """session, time, has_enemy and SIDES of packets, defaults in place; a side alone where there is no enemy.

    A packet knows no speed of the enemy, so its Mach and speed are 0.
    """
    d = lambda c, v=0.0: F.coalesce(F.col(c), F.lit(v))
    s, e, zero = "self_aircraft", "enemy_aircraft", F.lit(0.0)
    both = d("has_enemy", False) & ~d("self_only", False)
    own = {"object_id": F.lit("self"), "name": d(f"{s}.name", ""), "coalition": F.lit(""), "altitude": d(f"{s}.alt_asl"), "speed": d(f"{s}.TAS"), "aoa": d(f"{s}.AoA"), "g_load": d(f"{s}.Gy")}
    own |= {c: d(f"{s}.{c}") for c in ("x", "y", "z", "mach", "heading", "pitch", "bank")}
    other = {"object_id": F.coalesce(f"{e}.id", f"{e}.name", F.lit("enemy")), "name": d(f"{e}.name", ""), "coalition": F.lit(""), "altitude": F.coalesce(f"{e}.alt", f"{e}.y", zero), "speed": zero, "mach": zero, "aoa": zero, "g_load": zero}
    other |= {c: d(f"{e}.{c}") for c in ("x", "y", "z", "heading", "pitch", "bank")}
    return packets.select(session, F.col("timestamp").alias("time"), both.alias("has_enemy"), *(own[c].alias(f"self_{c}") for c in SIDE), *(other[c].alias(f"enemy_{c}") for c in SIDE))


#: What a side alone has; speed_ratio is 1 there and all else 0.
ALONE = {"self_specific_energy", "self_speed", "self_turn_rate", "self_g_load"}
RATES = "session string, time double, has_enemy boolean, self_object_id string, enemy_object_id string, " + ", ".join(f"{f} double" for f in PAIR_FEATURES)
RATE_NAMES = [f.split()[0] for f in RATES.split(", ")]


def with_statics(x: DataFrame) -> DataFrame:
    """The features of sides that need no other frame, and what the rates need."""
    known = {n.removesuffix("_"): c for n, c in static_features().items()}
    pair = F.col("has_enemy")
    each = [(known[f] if f in ALONE else F.when(pair, known[f]).otherwise(1.0 if f == "speed_ratio" else 0.0)).alias(f) for f in PAIR_FEATURES if f in known]
    return x.select("session", "time", "has_enemy", "self_object_id", F.when(pair, F.col("enemy_object_id")).alias("enemy_object_id"), "enemy_heading", *each)


def ordered(rows: Iterator[pd.DataFrame], column: str) -> pd.DataFrame:
    """A session's rows of a batch in order; they may come in several parts."""
    parts = list(rows)
    return pd.concat(parts, ignore_index=True).sort_values(column, kind="stable", ignore_index=True) if parts else pd.DataFrame(columns=[column, "raw"])


def arrays(rows: Iterator[pd.DataFrame], column: str) -> dict[str, np.ndarray]:
    """The columns of ordered rows as arrays; none where there are no rows."""
    parts = [p for p in rows if len(p)]
    if not parts:
        return {}
    x = {c: parts[0][c].to_numpy() if len(parts) == 1 else np.concatenate([p[c].to_numpy() for p in parts]) for c in parts[0].columns}
    if np.all(x[column][1:] >= x[column][:-1]):
        return x
    order = np.argsort(x[column], kind="stable")
    return {c: v[order] for c, v in x.items()}


class Rates(StatefulProcessor):
    """The frame before, per session: rates against it, 0 at the first; those of a pair are 0 too where the side came or went.

    The frame before counts whichever opponent it had.  A new session starts anew.
    """

    KEPT = ["time", "has_enemy", "distance", "antenna_train_angle", "enemy_heading", "self_specific_energy", "self_speed"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.before = handle.getValueState("before", ", ".join(f"{c} {'boolean' if c == 'has_enemy' else 'double'}" for c in self.KEPT))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        x = arrays(rows, "time")  # a session has few rows a batch, so the columns are worked on as plain arrays
        if not x:
            return
        paired = x["has_enemy"].astype(bool)
        before = self.before.get()
        kept = dict(zip(self.KEPT, before or (np.nan,) * len(self.KEPT), strict=True))
        step = lambda c: np.diff(x[c].astype(float), prepend=np.nan if kept[c] is None else kept[c])
        dt = step("time")
        known = ~np.isnan(dt)
        dt[known & ~(dt > 0)] = 1.0 / 30
        both = paired & np.concatenate([[before is not None and kept["has_enemy"] is True], paired[:-1]])
        rate = lambda c, told: np.where(told, step(c) / dt, 0.0)
        pair_rate = lambda c: np.where(both, rate(c, known), 0.0)
        turn = step("enemy_heading") / dt
        turn = np.where(both, np.degrees(np.abs(turn - 2 * np.pi * np.ceil((turn - np.pi) / (2 * np.pi)))), 0.0)
        x |= {
            "session": np.full(len(dt), key[0], dtype=object), "self_speed_rate": rate("self_speed", known), "self_ps_estimate": rate("self_specific_energy", known), "distance_rate": pair_rate("distance"), "ata_rate": pair_rate("antenna_train_angle"),
            "enemy_turn_rate": turn, "relative_turn_rate": np.where(paired, x["self_turn_rate"] - turn, 0.0),
        }
        self.before.update(tuple(bool(x[c][-1]) if c == "has_enemy" else float(x[c][-1]) for c in self.KEPT))
        yield pd.DataFrame({c: x[c] for c in RATE_NAMES}, copy=False)

    def close(self) -> None:
        pass


class Throttle(StatefulProcessor):
    """At most ``hz`` rows a second of each session; the others are dropped."""

    def __init__(self, hz: float = 30.0):
        self.gap = 1.0 / hz

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "time double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        times = ordered(rows, "time")["time"].to_numpy()
        last = self.last.get()[0] if self.last.exists() else -np.inf
        kept = []
        while (i := np.searchsorted(times, last + self.gap - 1e-9)) < len(times):
            last = float(times[i])
            kept.append(last)
        if kept:
            self.last.update((last,))
            yield pd.DataFrame({"session": key[0], "time": kept})

    def close(self) -> None:
        pass


def merged(before: str, line: str) -> str:
    """A property list brought up to date: each property by its last value, empty parts of T as they were."""
    known = {}
    for part in f"{before},{line}".split(","):
        key, _, value = part.strip().partition("=")
        if key == "T" and key in known:
            new, old = value.split("|"), known[key].split("|")
            value = "|".join([v or (old[i] if i < len(old) else "") for i, v in enumerate(new)] + old[len(new) :])
        if key:
            known[key] = value
    return ",".join(f"{k}={v}" for k, v in known.items())


@dataclasses.dataclass
class Known:
    """An object of a connection: its properties, when it was first told of, its last transform and the speed between the last two."""

    value: str
    ord: int
    at: float = -1.0
    x: float = 0.0
    y: float = 0.0
    z: float = 0.0
    speed: float = 0.0

    def updated(self, line: str, now: float) -> Known:
        new = dataclasses.replace(self, value=merged(self.value, line))
        t = next((p[2:] for p in new.value.split(",") if p.startswith("T=")), None)
        if t is None or not any(p.strip().startswith("T=") for p in line.split(",")):
            return new
        lon, lat, alt = ([_number(v) for v in t.split("|")] + [0.0] * 3)[:3]
        new.x, new.y, new.z = EARTH_RADIUS * np.radians(lon) * np.cos(np.radians(lat)), alt, EARTH_RADIUS * np.radians(lat)
        if 0 <= self.at < now:
            new.speed = float(np.sqrt((new.x - self.x) ** 2 + (new.y - self.y) ** 2 + (new.z - self.z) ** 2) / (now - self.at))
        new.at = now
        return new


def _number(text: str) -> float:
    try:
        return float(text)
    except ValueError:
        return 0.0


class Carried(StatefulProcessor):
    """What is known of every object of a connection: LOCF per property, speed from transforms, removals.

    A frame line tells what was known when it came, stamped with its time; a line that opens a
    recording (FileType=) clears all that was known, also the time.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("known", "object_id string", "value string, ord long, at double, x double, y double, z double, speed double")
        self.now = handle.getValueState("now", "now double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        out = []
        known = {k[0]: Known(*v) for k, v in self.known.iterator()}
        before, now = dict(known), self.now.get()[0] if self.now.exists() else 0.0
        x = ordered(rows, "line_no")
        for line_no, raw in zip(x["line_no"].tolist(), x["raw"].tolist(), strict=True):
            if raw.startswith("FileType="):
                known, now = {}, 0.0
            elif raw.startswith("-"):
                known.pop(raw[1:], None)
            elif raw.startswith("#"):
                objects = sorted((v.ord, k, v) for k, v in known.items())
                out.append((key[0], raw[1:], [{"object_id": k, "value": v.value, "speed": v.speed} for _, k, v in objects]))
                with contextlib.suppress(ValueError):
                    now = float(raw[1:])
            elif "," in raw and not raw.startswith("0,"):
                object_id, _, value = raw.partition(",")
                known[object_id] = known.get(object_id, Known("", line_no)).updated(value, now)
        for object_id in before.keys() - known.keys():
            self.known.removeKey((object_id,))
        for object_id, v in known.items():
            if before.get(object_id) != v:
                self.known.updateValue((object_id,), dataclasses.astuple(v))
        self.now.update((now,))
        if out:
            yield pd.DataFrame(out, columns=["session", "frame", "objects"])

    def close(self) -> None:
        pass


def stateful(df: DataFrame, processor: StatefulProcessor, schema: str, mode: str = "append") -> DataFrame:
    return df.groupBy("session").transformWithStateInPandas(processor, schema, mode, "none")


def rates(packets: DataFrame) -> DataFrame:
    """session, time, has_enemy, the sides' ids and the 20 features of packets."""
    return stateful(with_statics(sides(packets)), Rates(), RATES)


def throttled(df: DataFrame, hz: float = 30.0) -> DataFrame:
    return stateful(df.select("session", "time"), Throttle(hz), "session string, time double")


def told_frames(lines: DataFrame) -> DataFrame:
    """session, frame, objects (object_id, properties and speed between transforms, the first seen first) of every frame line."""
    return stateful(lines.select("session", "line_no", "raw"), Carried(), "session string, frame string, objects array<struct<object_id: string, value: string, speed: double>>")


def carried(lines: DataFrame) -> DataFrame:
    """session, frame, object_id, value: a row per frame and known object."""
    return told_frames(lines).select("session", "frame", F.explode("objects").alias("o")).select("session", "frame", "o.object_id", "o.value")


def engaged(frames: DataFrame, player: str = "", min_speed: float = 20.0, min_altitude: float = 100.0) -> DataFrame:
    """sides of told frames: the player's aircraft and its nearest opponent that flies.

    The player's aircraft is the first seen whose pilot holds the player's name,
    or an F/A-18 with any pilot; a frame without one, or without a valid time, has no row.  Of
    opponents at one distance the first seen counts; those below ``min_altitude`` or slower than
    ``min_speed`` are left out.  Speed is a told TAS, else that between the last two transforms; an
    unknown Mach comes from it; loads aren't told and are 0.
    """

    def state(o):
        p = properties(o["value"])
        v = lambda k: F.coalesce(property_value(p, k), F.lit(""))
        t = F.split(v("T"), "\\|")
        at = lambda i: F.coalesce(number(F.get(t, F.lit(i))), F.lit(0.0))
        x, y, z = g.to_local(at(0), at(1), at(2))
        speed = F.coalesce(number(v("TAS")) * KNOTS, o["speed"])
        mach = F.coalesce(number(v("Mach")), F.lit(0.0))
        found = {"object_id": o["object_id"], "name": v("Name"), "coalition": v("Coalition"), "x": x, "y": y, "z": z, "altitude": at(2), "speed": speed, "mach": F.when(mach > 0, mach).otherwise(speed / SOUND_SPEED)}
        found |= {"heading": F.radians(at(5)), "pitch": F.radians(at(4)), "bank": F.radians(at(3)), "aoa": F.radians(F.coalesce(number(v("AOA")), F.lit(0.0))), "g_load": F.lit(0.0)}
        return F.struct(*(found[c].alias(c) for c in SIDE), v("Pilot").alias("pilot"), v("Type").alias("type"))

    own = lambda o: is_aircraft(o["type"]) & ((F.lit(player) != "") & o["pilot"].contains(player) | o["name"].contains("F/A-18") & (o["pilot"] != ""))
    x = frames.select("session", number(F.trim("frame")).alias("time"), F.transform("objects", state).alias("all")).filter(F.col("time").isNotNull())
    x = x.withColumn("s", F.get(F.filter("all", own), F.lit(0))).filter(F.col("s").isNotNull())
    far = lambda o: g.distance(*(o[c] - F.col(f"s.{c}") for c in "xyz"))
    flies = lambda o: (o["altitude"] >= min_altitude) & (o["speed"] >= min_speed)
    others = F.filter("all", lambda o: is_aircraft(o["type"]) & (o["object_id"] != F.col("s.object_id")) & flies(o) & opposing(o["coalition"], F.col("s.coalition")))
    x = x.withColumn("others", others).withColumn("e", F.array_min(F.transform("others", lambda o, i: F.struct(far(o).alias("d"), i.alias("i"), o.alias("o"))))["o"])
    enemy = lambda c: F.col(f"e.{c}") if c in ("object_id", "name", "coalition") else F.coalesce(F.col(f"e.{c}"), F.lit(0.0))
    return x.select("session", "time", F.col("e").isNotNull().alias("has_enemy"), *(F.col(f"s.{c}").alias(f"self_{c}") for c in SIDE), *(enemy(c).alias(f"enemy_{c}") for c in SIDE))


def realtime_rates(lines: DataFrame, player: str = "") -> DataFrame:
    """From the lines of realtime connections (session, line_no, raw) to the 20 features of every frame."""
    return stateful(with_statics(engaged(told_frames(lines), player)), Rates(), RATES)


def scored(frames: DataFrame, model: PipelineModel, columns: list[str] = PAIR_FEATURES) -> DataFrame:
    """Frames with features as a trained model scores them: advantage and its category; batch or stream."""
    return learning.score(frames, model, columns)


def latest(df: DataFrame, now: float | None = None, ttl: float = 2.0) -> DataFrame:
    """The last row of each session; with ``now``, only those that aren't older than the time to live."""
    x = df.groupBy("session").agg(F.max_by(F.struct(*(c for c in df.columns if c != "session")), "time").alias("r")).select("session", "r.*")
    return x if now is None else x.filter(F.col("time") >= now - ttl)


# What a realtime telemetry server and its client say first.
GREETING = ("XtraLib.Stream.0", "Tacview.RealTimeTelemetry.0")


class SocketReader(DataSourceStreamReader):
    """Rows that came in since the last batch; offsets count what has been received.

    A socket cannot be read again, so a batch lost with the driver is lost; rows
    travel in the partition, so a lost executor costs none.
    """

    def __init__(self, options: dict):
        self.options = dict(options)
        self.wait = float(options.get("wait", "0.2"))
        self.rows: list = []
        self.base = 0
        self.socket = None

    def opened(self) -> socket.socket:
        raise NotImplementedError

    def received(self) -> list:
        raise NotImplementedError

    def initialOffset(self) -> dict:  # noqa: N802
        return {"n": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        if self.socket is None:
            self.socket = self.opened()
            self.socket.settimeout(self.wait)
        until = time.monotonic() + 10 * self.wait  # a sender that never pauses must not hold the batch up
        try:
            while time.monotonic() < until and (new := self.received()) is not None:
                self.rows += new
        except TimeoutError:
            pass
        return {"n": self.base + len(self.rows)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [InputPartition(json.dumps(self.rows[start["n"] - self.base : end["n"] - self.base]))]

    def commit(self, end: dict) -> None:
        del self.rows[: end["n"] - self.base]
        self.base = end["n"]

    def read(self, partition: InputPartition):
        for row in json.loads(partition.value):
            yield tuple(row)


class UdpReader(SocketReader):
    """Datagrams of one port."""

    def opened(self) -> socket.socket:
        s = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
        s.bind((self.options.get("host", "0.0.0.0"), int(self.options.get("port", "9089"))))
        return s

    def received(self) -> list:
        return [(self.socket.recvfrom(65_536)[0].decode("utf-8", "replace"),)]


class UdpSource(DataSource):
    """format("udp_json"): options host, port and wait (seconds a batch listens without news)."""

    @classmethod
    def name(cls) -> str:
        return "udp_json"

    def schema(self) -> str:
        return "value string"

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:  # noqa: N802
        return UdpReader(self.options)


def framed(buffer: bytes, data: bytes) -> tuple[list[str], bytes]:
    """Whole lines of a byte stream, and what stays for the next call."""
    *lines, rest = (buffer + data).split(b"\n")
    return [x.decode("utf-8", "replace").rstrip("\r") for x in lines], rest


def shake_hands(s: socket.socket, client: str, password: str) -> bytes:
    """Greetings ended by NUL and the password's digest; what the server has sent beyond its greeting."""
    from aerotrace.functions.text import crc64_digest

    s.sendall("\n".join([*GREETING, client, "\0"]).encode())
    rest = b""
    while b"\0" not in rest and (data := s.recv(8192)):
        rest += data
    s.sendall(f"{crc64_digest(password) if password else '0'}\n\0".encode())
    return rest.partition(b"\0")[2]


class TcpReader(SocketReader):
    """Log lines of a realtime server, numbered; a connection that was closed has no more."""

    def opened(self) -> socket.socket:
        s = socket.create_connection((self.options.get("host", "127.0.0.1"), int(self.options.get("port", "42674"))), timeout=10)
        self.rest, self.n = shake_hands(s, self.options.get("client", "client"), self.options.get("password", "")), 0
        return s

    def received(self) -> list | None:
        lines, self.rest = framed(self.rest, b"")
        if not lines:
            data = self.socket.recv(8192)
            if not data:
                return None
            lines, self.rest = framed(self.rest, data)
        self.n += len(lines)
        return [(self.n - len(lines) + i, line) for i, line in enumerate(lines)]


class TcpSource(DataSource):
    """format("telemetry_tcp"): options host, port, client, password and wait."""

    @classmethod
    def name(cls) -> str:
        return "telemetry_tcp"

    def schema(self) -> str:
        return "line_no long, raw string"

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:  # noqa: N802
        return TcpReader(self.options)


def send_udp(df: DataFrame, epoch: int = 0, host: str = "127.0.0.1", port: int = 9090) -> None:
    """foreachBatch sink: each row as a JSON datagram, sent where it lies."""

    def send(rows):
        with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
            for r in rows:
                s.sendto(r.value.encode(), (host, port))

    df.select(F.to_json(F.struct(*df.columns)).alias("value")).foreachPartition(send)


def appended(packets: DataFrame, path: str, checkpoint: str, fmt: str = "parquet"):
    """Starts the sink of packets with an enemy, flat, appended."""
    x = flattened(packets.filter("has_enemy"))
    return x.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def session_summary(frames: DataFrame) -> DataFrame:
    """session, frames, duration, mean_fps, mean_ms, max_ms from session, time and, where it is measured, latency_ms."""
    spent = F.col("latency_ms") if "latency_ms" in frames.columns else F.lit(None).cast("double")
    x = frames.groupBy("session").agg(F.count("*").alias("frames"), (F.max("time") - F.min("time")).alias("duration"), F.avg(spent).alias("mean_ms"), F.max(spent).alias("max_ms"))
    return x.select("session", "frames", "duration", F.when(F.col("duration") > 0, F.col("frames") / F.col("duration")).alias("mean_fps"), F.coalesce("mean_ms", F.lit(0.0)).alias("mean_ms"), F.coalesce("max_ms", F.lit(0.0)).alias("max_ms"))
