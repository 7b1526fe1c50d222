"""A streaming source of growing log files, one line a row.

An offset says how many bytes of each file have been read, always up to the end of a line. A file is known by its first
line, not by its name: one that was renamed when logs were rotated goes on where it was, and a new file under the
old name begins at its start. Offsets are kept by Spark's checkpoint and batches are planned from them alone, so a query that starts
again reads every line once. A line of JSON that does not parse, or is no object, is a row with ``bad`` set.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "file string, at bigint, line string, bad boolean"
BLOCK = 1 << 16
#: Bytes of a file that a task reads, by default.
SPLIT = 16 << 20


@dataclass
class Part(InputPartition):
    """The lines of a file that begin in ``begin`` to ``end``; ``first`` is where a line is known to begin."""

    path: str
    first: int
    begin: int
    end: int


def _first_line(file) -> bytes | None:
    """The first line of a file, or None while it has no end."""
    head = b""
    while b"\n" not in head:
        more = file.read(BLOCK)
        if not more:
            return None
        head += more
    return head[: head.index(b"\n")]


def _whole_lines(file, size: int) -> int:
    """Where the last whole line of a file of ``size`` bytes ends."""
    at = size
    while at > 0:
        begin = max(0, at - BLOCK)
        file.seek(begin)
        found = file.read(at - begin).rfind(b"\n")
        if found >= 0:
            return begin + found + 1
        at = begin
    return 0


def _lines(file, at: int) -> Iterator[tuple[int, bytes]]:
    """The lines of a file from a byte on, with the byte at which each begins."""
    file.seek(at)
    held = b""
    while more := file.read(BLOCK):
        parts = (held + more).split(b"\n")
        held = parts.pop()
        for line in parts:
            yield at, line
            at += len(line) + 1
    if held:
        yield at, held


class LogReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder, self.suffix, self.split = options["path"], options.get("suffix", ""), int(options.get("split", SPLIT))

    def _files(self) -> dict[str, tuple[str, int]]:
        """By the digest of its first line, the path and readable bytes of each file; equal first lines are told apart by the order of names."""
        store, folder = fs.FileSystem.from_uri(self.folder)
        found: dict[str, tuple[str, int]] = {}
        for info in sorted(store.get_file_info(fs.FileSelector(folder, allow_not_found=True)), key=lambda x: x.path):
            if info.type != fs.FileType.File or info.base_name[:1] in "._" or self.suffix not in info.base_name:
                continue
            with store.open_input_file(info.path) as file:
                first = _first_line(file)
                if first is None:
                    continue
                digest, n = hashlib.sha256(first).hexdigest()[:32], 0
                while f"{digest}-{n}" in found:
                    n += 1
                found[f"{digest}-{n}"] = info.path, _whole_lines(file, file.size())
        return found

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self, *args) -> dict:
        return {key: size for key, (_, size) in self._files().items()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        there = self._files()
        out: list[InputPartition] = []
        for key, upto in sorted(end.items()):
            first = start.get(key, 0)
            if first < upto:
                if key not in there:
                    raise FileNotFoundError(f"a log file below {self.folder} went before its lines up to byte {upto} were read")
                out += [Part(there[key][0], first, at, min(at + self.split, upto)) for at in range(first, upto, self.split)]
        return out

    def read(self, part: Part) -> Iterator[tuple]:
        store, _ = fs.FileSystem.from_uri(self.folder)
        with store.open_input_file(part.path) as file:
            # The line that runs over the split belongs to the part it begins in.
            inside = part.begin > part.first
            lines = _lines(file, part.begin - inside)
            if inside:
                next(lines)
            for at, line in lines:
                if at >= part.end:
                    break
                text = line.rstrip(b"\r").decode("utf-8", "replace")
                if text.strip():
                    yield part.path, at, text, _is_bad(text)

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


def _is_bad(text: str) -> bool:
    try:
        return not isinstance(json.loads(text), dict)
    except ValueError:
        return True


class LogStream(DataSource):
    """``spark.readStream.format("log_lines").load(folder)`` after ``spark.dataSource.register(LogStream)``: file, at, line, bad.

    The folder is one that driver and executors reach under the same name. ``suffix`` picks files whose name holds it, ``split``
    is the most bytes of a file a task gets. Blank lines are left out. A file that goes before it was read is an error.
    """

    @classmethod
    def name(cls) -> str:
        return "log_lines"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> LogReader:
        return LogReader(self.options)
