"""A stream source that follows files as they grow.

Each poll reads what was appended to a file, up to its last line end, in parts of ``maxBytes`` that tasks read side by side: a
part holds the lines that begin in it.  If there are many parts, neighbours go to one task, which still holds no more than
``maxBytes`` at a time.  So what has gathered takes one batch, and no batch for each part.  A file that is shorter than what was read of it, or whose first bytes are others than they were, was
truncated, rotated or rewritten and is read from its start.  Blank lines are dropped and bad bytes ignored.  Paths must
be mounted where the driver and the executors run, such as a shared log folder.

An offset holds for each file how far it was read, and how many of its first bytes have which checksum.

    spark.dataSource.register(TailSource)
    spark.readStream.format("tail").option("path", "/logs").option("from", "start").load()
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..sources.files import BLOCKED, EXTENSIONS


def followed(path: str) -> list[str]:
    """The files at or below a path that may be followed, in order."""
    at = Path(path).resolve()
    found = sorted(p for p in at.rglob("*") if p.is_file()) if at.is_dir() else [at] if at.is_file() else []
    allowed = lambda p: p.suffix.lower() in EXTENSIONS and p.suffix.lower() != ".gz" and not any(str(p) == b or str(p).startswith(b + "/") for b in BLOCKED)
    return [str(p) for p in found if allowed(p)]


def line_end(path: str, begin: int, end: int, window: int) -> int:
    """Where the last whole line before ``end`` ends; ``begin`` if there is none.  A line longer than the window is cut."""
    with open(path, "rb") as f:
        at = max(begin, end - window)
        f.seek(at)
        cut = f.read(end - at).rfind(b"\n")
    return at + cut + 1 if cut >= 0 else end if end - begin >= window else begin


#: First bytes of a file by which it is known again.
HEAD = 256


def head_of(path: str, size: int) -> list[int]:
    """How many first bytes there are, ``HEAD`` at most, and their checksum."""
    with open(path, "rb") as f:
        own = f.read(min(size, HEAD))
    return [len(own), zlib.crc32(own)]


def resumed(path: str, size: int, last: list[int] | None) -> int:
    """Where to read on in a file of ``size`` bytes, of which ``last`` says what was read."""
    if not last or size < last[0]:
        return 0
    return last[0] if head_of(path, last[1]) == last[1:] else 0


#: Parts that a poll may have before neighbours go to one task, and the most that do.
TASKS = 1024
NEIGHBOURS = 64


class Span(InputPartition):
    """Lines of a file that begin in a range of its bytes; ``first`` says that a line begins where the range does, and ``stop``
    is where the poll ends."""

    def __init__(self, path: str, begin: int, end: int, first: bool, stop: int):
        self.path, self.begin, self.end, self.first, self.stop = path, begin, end, first, stop


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.most = options["path"], int(options.get("maxbytes", 64 * 1024))
        self.from_end = options.get("from", "end") == "end"
        self.at: dict[str, list[int]] | None = None

    def initialOffset(self) -> dict:
        sizes = {p: os.path.getsize(p) if self.from_end else 0 for p in followed(self.path)}
        self.at = {p: [n, *head_of(p, n)] for p, n in sizes.items()}
        return dict(self.at)

    def latestOffset(self) -> dict:
        out = {}
        for p in followed(self.path):
            while p not in out:
                size = os.path.getsize(p)
                # after a restart what was read is not known yet
                begin = 0 if self.at is None else resumed(p, size, self.at.get(p))
                end = line_end(p, begin, size, self.most)
                own = [end, *head_of(p, end)]
                if os.path.getsize(p) >= end:  # else it was truncated meanwhile, and the head may be another file's
                    out[p] = own
        return out

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.at = dict(end)
        stretches = [(p, resumed(p, to, start.get(p)), to) for p, (to, *_) in sorted(end.items())]
        parts = sum(-(-(to - begin) // self.most) for _, begin, to in stretches)
        step = self.most * min(NEIGHBOURS, max(1, -(-parts // TASKS)))
        return [Span(p, a, min(a + step, to), a == begin, to) for p, begin, to in stretches for a in range(begin, to, step)]

    def read(self, partition: Span) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            at, cut = partition.begin, False
            if not partition.first:  # the line that covers the byte before belongs to the part before, with all its pieces
                f.seek(at - 1)
                while (skipped := f.readline(self.most)) and not skipped.endswith(b"\n"):
                    pass
                at = f.tell()
            else:
                f.seek(at)
            k = 0
            while (at < partition.end or cut) and at < partition.stop and (raw := f.readline(min(self.most, partition.stop - at))):
                at, cut = at + len(raw), not raw.endswith(b"\n")
                for line in re.split(r"\r\n|\r|\n", raw.decode("utf-8", "ignore").rstrip("\n")):
                    if line.strip():
                        yield partition.path, partition.begin, k, line
                        k += 1


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return "file string, seg long, pos long, line string"

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)
