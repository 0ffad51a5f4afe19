"""A data source for run files, one JSON document a question: ``spark.read.format("runs")`` and ``df.write.format("runs")``.

Reading: a partition is a group of files of about ``groupbytes`` (4 MB), in order of their names. A file that holds no JSON object, or none with a result, is a row marked ``bad``;
with ``strict`` it fails the job. Only files named ``*.json`` are read, and none below folders.

Writing: a row becomes the file ``run_<qid>.json``, its qid made safe for a name. Tasks write into a folder of the job's own; when all have succeeded
the files move to their names, so a failed job, task or attempt leaves nothing. Appending replaces the questions that come again; overwriting removes the others. A question that comes
twice in one job fails it.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

STEP = "struct<type:string,tool_name:string,arguments:string,output:string>"
SCHEMA = f"file string, bad boolean, qid string, query_id string, status string, tool_call_counts map<string,double>, retrieved_docids array<string>, result array<{STEP}>"
PREFIX = "run_"


def file_name(qid: str) -> str:
    return f"{PREFIX}{re.sub(r'[^A-Za-z0-9_.-]', '_', qid)}.json"


def _place(options: dict[str, str]) -> tuple[fs.FileSystem, str]:
    if "path" not in options:
        raise ValueError("name the folder of the run files")
    return fs.FileSystem.from_uri(options["path"])


@dataclass
class Files(InputPartition):
    names: list[str]


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class RunReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def partitions(self) -> list[Files]:
        system, path = _place(self.options)
        found = sorted((f.path, f.size or 0) for f in system.get_file_info(fs.FileSelector(path)) if f.is_file and f.path.endswith(".json"))
        most, out, room = int(self.options.get("groupbytes", 4 << 20)), [], 0
        for name, size in found:
            if not out or room + size > most:
                out.append(Files([]))
                room = 0
            out[-1].names.append(name)
            room += size
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _ = _place(self.options)
        for name in partition.names:
            with system.open_input_stream(name) as f:
                raw = f.read()
            yield _row(name.rsplit("/", 1)[-1], raw, self.options.get("strict", "false").lower() == "true")


def _row(file: str, raw: bytes, strict: bool) -> tuple:
    try:
        run = json.loads(raw)
        steps = [tuple(None if s.get(k) is None else s[k] if isinstance(s[k], str) else json.dumps(s[k], ensure_ascii=False) for k in ("type", "tool_name", "arguments", "output")) for s in run["result"]]
        counts = {str(k): float(v) for k, v in (run.get("tool_call_counts") or {}).items() if isinstance(v, int | float)}
        docids = [str(d) for d in run.get("retrieved_docids") or []]
        text = lambda k: None if run.get(k) is None else str(run[k])
        return file, False, text("qid"), text("query_id"), text("status"), counts, docids, steps
    except (ValueError, KeyError, TypeError, AttributeError) as e:
        if strict:
            raise ValueError(f"{file} is no run: {e}") from e
        return file, True, None, None, None, None, None, None


class RunWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], columns: list[str], overwrite: bool) -> None:
        if missing := {"qid", "result"} - set(columns):
            raise ValueError(f"runs lack {sorted(missing)}")
        self.options, self.overwrite, self.job = options, overwrite, uuid.uuid4().hex
        system, _, own = self._folder()
        system.create_dir(own)  # by the driver alone: a task that goes on after the job has failed can't make it again

    def _folder(self) -> tuple[fs.FileSystem, str, str]:
        system, path = _place(self.options)
        return system, path, f"{path}/_temporary-{self.job}"

    def write(self, iterator: Iterator[Row]) -> Written:
        system, _, own = self._folder()
        attempt = uuid.uuid4().hex  # of one task several may run
        system.create_dir(f"{own}/{attempt}", recursive=False)
        names = []
        for row in iterator:
            run = row.asDict(recursive=True)
            if run["qid"] is None:
                raise ValueError("a run without a qid")
            names.append(f"{attempt}/{file_name(run['qid'])}")
            with system.open_output_stream(f"{own}/{names[-1]}") as f:
                f.write(json.dumps({k: v for k, v in run.items() if k not in ("file", "bad")}, ensure_ascii=False).encode())
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        system, path, own = self._folder()
        names = [name for m in messages if m for name in m.names]
        final = [name.split("/", 1)[1] for name in names]
        try:
            if twice := sorted({n for n in final if final.count(n) > 1} if len(set(final)) < len(final) else ()):
                raise ValueError(f"several runs are named {', '.join(twice[:5])}")
            for name, last in zip(names, final, strict=True):
                system.move(f"{own}/{name}", f"{path}/{last}")
            if self.overwrite:
                kept = set(final)
                for f in system.get_file_info(fs.FileSelector(path)):
                    if f.is_file and f.base_name.startswith(PREFIX) and f.base_name not in kept:
                        system.delete_file(f.path)
        finally:
            self._clear(system, own)

    def abort(self, messages: list[Written | None]) -> None:
        system, _, own = self._folder()
        self._clear(system, own)

    @staticmethod
    def _clear(system: fs.FileSystem, own: str) -> None:
        if system.get_file_info(own).type != fs.FileType.NotFound:
            system.delete_dir(own)


class RunFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "runs"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> RunReader:
        return RunReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> RunWriter:
        return RunWriter(dict(self.options), schema.fieldNames(), overwrite)


def register_runs(spark: SparkSession) -> None:
    """Makes the format ``runs`` known to a session."""
    spark.dataSource.register(RunFiles)
