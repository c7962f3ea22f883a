"""One file a log: a batch sink that streams each log's lines into a text file or an archive of its own."""

from __future__ import annotations

import json
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from aerotrace.functions.text import stem

MARK = "﻿"


def unique_stems(sources: DataFrame) -> DataFrame:
    """source, source_stem of distinct sources: the file name without its log suffix, and a digest of the path behind it where other sources have that name too."""
    x = sources.select("source").distinct().withColumn("__stem", stem(F.col("source")))
    many = F.count("*").over(W.partitionBy("__stem")) > 1
    return x.select("source", F.when(many, F.concat("__stem", F.lit("-"), F.substring(F.sha2("source", 256), 1, 12))).otherwise(F.col("__stem")).alias("source_stem"))


def output_name(source: Column, source_stem: Column, kind: str = "same") -> Column:
    """The annotated file of a log: .maneuver.acmi, or .maneuver.zip.acmi for an archive; kind is same (as the source), text or zip."""
    if kind not in ("same", "text", "zip"):
        raise ValueError(f"unknown kind of log file {kind}")
    text, archive = F.concat(source_stem, F.lit(".maneuver.acmi")), F.concat(source_stem, F.lit(".maneuver.zip.acmi"))
    return F.when(F.lower(source).rlike(r"\.zip(\.acmi)?$"), archive).otherwise(text) if kind == "same" else text if kind == "text" else archive


@dataclass
class Written(WriterCommitMessage):
    """JSON of pairs: where a finished file lies, and its name."""

    files: str


class LogWriter(DataSourceArrowWriter):
    """Each task writes files of its own below a scratch folder; only the commit moves those of successful tasks to their names.

    A task that fails or is run twice leaves nothing under a log's name.
    """

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.scratch = path.rstrip("/"), overwrite, f"_writing-{uuid.uuid4().hex}"

    def opened(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = self.opened()
        folder, now, out, done = f"{root}/{self.scratch}/{uuid.uuid4().hex}", None, None, []
        files.create_dir(folder, recursive=True)
        try:
            for batch in iterator:
                for name, raw in zip(batch.column("file").to_pylist(), batch.column("raw").to_pylist(), strict=True):
                    if name != now:
                        if out is not None:
                            out.close()
                        now, out = name, _LogFile(files, f"{folder}/{len(done)}", name)
                        done.append((f"{folder}/{len(done)}", name))
                    out.line(raw or "")
        finally:
            if out is not None:
                out.close()
        return Written(json.dumps(done))

    def commit(self, messages: list[Written | None]) -> None:
        files, root = self.opened()
        if self.overwrite:
            for x in files.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if x.base_name.endswith((".maneuver.acmi", ".maneuver.zip.acmi")):
                    files.delete_file(x.path)
        for message in messages:
            for place, name in json.loads(message.files) if message is not None else []:
                files.move(place, f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        """Drops what lies in the scratch folder."""
        files, root = self.opened()
        if files.get_file_info(f"{root}/{self.scratch}").type != fs.FileType.NotFound:
            files.delete_dir(f"{root}/{self.scratch}")


class _LogFile:
    """A text with a byte-order mark, or an archive with it as its one member; lines go out as they come."""

    def __init__(self, files: fs.FileSystem, place: str, name: str):
        self.sink, self.archive, self.first = files.open_output_stream(place), None, True
        self.out = self.sink
        if name.endswith(".zip.acmi"):
            self.archive = zipfile.ZipFile(self.sink, "w", zipfile.ZIP_DEFLATED)
            self.out = self.archive.open(name.removesuffix(".zip.acmi") + ".txt.acmi", "w", force_zip64=True)

    def line(self, raw: str) -> None:
        self.out.write((MARK + raw if self.first else "\n" + raw).encode())
        self.first = False

    def close(self) -> None:
        if self.archive is not None:
            self.out.close()
            self.archive.close()
        self.sink.close()


class LogFiles(DataSource):
    """format("telemetry_logs"): a batch sink of the columns file and raw, the lines of a file one after another in one partition."""

    @classmethod
    def name(cls) -> str:
        return "telemetry_logs"

    def writer(self, schema: StructType, overwrite: bool) -> LogWriter:
        return LogWriter(self.options["path"], overwrite)


def write_files(rows: DataFrame, path: str, kind: str = "same") -> None:
    """A file for each source of rows (source, line_no, rank, raw) in a folder that the driver and all executors share.

    Sources whose files have one name get different files.  A log's lines are sorted by Spark, which
    spills, and streamed into its file, so none has to fit in memory.  An older file of the same name is replaced.
    """
    rows.sparkSession.dataSource.register(LogFiles)
    named = rows.join(unique_stems(rows), "source").withColumn("file", output_name(F.col("source"), F.col("source_stem"), kind))
    x = named.repartition("file").sortWithinPartitions("file", "line_no", "rank").select("file", "raw")
    x.write.format("telemetry_logs").mode("append").save(path)
