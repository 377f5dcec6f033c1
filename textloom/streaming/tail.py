"""Tailing of growing files, and line search with context over a stream."""

from __future__ import annotations

import logging
import os
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from textloom.operators import search as S
from textloom.plans.spec import SearchSpec

SCHEMA = "path string, line_number long, byte_offset long, line string"


#: Bytes that are looked at together when line feeds are counted or looked for.
PIECE = 1 << 20


@dataclass
class Appended(InputPartition):
    """Whole lines of a file, from one byte to another; the first has the number behind ``number``."""

    path: str
    start: int
    end: int
    number: int


class _TailReader(DataSourceStreamReader):
    """Offsets: for each path the bytes that were read.  Only whole lines are read; a part of one waits.

    A path that was there at the start begins at its end (or at 0 with from_start); one that appears later begins at 0;
    one that shrank begins at 0 again; one that is gone is forgotten, with a warning.

    Each file's new bytes are a partition, read where the task runs.  The driver looks for the last line feed of each
    file and counts those that were appended, to number lines; it keeps no text.
    """

    def __init__(self, options: dict):
        self.paths = [p for p in options["paths"].split("\n") if p]
        self.from_start = options.get("from_start", "false").lower() == "true"
        self.counted: dict[str, tuple[int, int]] = {}

    def _files(self) -> list[str]:
        out = []
        for p in self.paths:
            if os.path.isdir(p):
                out += [f"{p.rstrip('/')}/{n}" for n in sorted(os.listdir(p)) if not n.startswith(".") and os.path.isfile(os.path.join(p, n))]
            elif os.path.isfile(p):
                out.append(p)
        return out

    @staticmethod
    def _whole(path: str) -> int:
        """Bytes up to and with the last line feed, looked for from the end."""
        try:
            with open(path, "rb") as f:
                at = f.seek(0, os.SEEK_END)
                while at:
                    low = max(0, at - PIECE)
                    f.seek(low)
                    if (k := f.read(at - low).rfind(b"\n")) >= 0:
                        return low + k + 1
                    at = low
        except OSError:
            pass
        return 0

    def _number(self, path: str, at: int) -> int:
        """Lines before a byte, counted on from where they were counted last."""
        start, lines = self.counted.get(path, (0, 0))
        if start > at:
            start = lines = 0
        try:
            with open(path, "rb") as f:
                f.seek(start)
                while start < at and (piece := f.read(min(PIECE, at - start))):
                    lines, start = lines + piece.count(b"\n"), start + len(piece)
        except OSError:
            pass
        self.counted[path] = (start, lines)
        return lines

    def initialOffset(self) -> dict:
        return {p: 0 if self.from_start else self._whole(p) for p in self._files()}

    def latestOffset(self) -> dict:
        return {p: self._whole(p) for p in self._files()}

    def partitions(self, start: dict, end: dict) -> list[Appended]:
        out = []
        for p in start.keys() - end.keys():
            logging.getLogger(__name__).warning("watched file is gone: %s", p)
            self.counted.pop(p, None)
        for p, stop in end.items():
            at = start.get(p, 0)
            if at > stop:  # cut off, and begun again
                at = 0
                self.counted.pop(p, None)
            if stop > at:
                out.append(Appended(p, at, stop, self._number(p, at)))
        return out

    def read(self, part: Appended) -> Iterator[tuple]:
        try:
            with open(part.path, "rb") as f:
                f.seek(part.start)
                at, number = part.start, part.number
                while at < part.end and (line := f.readline()):
                    number += 1
                    yield part.path, number, at, line.removesuffix(b"\n").decode("utf-8", "replace")
                    at += len(line)
        except FileNotFoundError:
            return


class TailSource(DataSource):
    """spark.readStream.format("textloom_tail").option("paths", "a.log\\nlogs").load()"""

    @classmethod
    def name(cls) -> str:
        return "textloom_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _TailReader(self.options)


def tail(spark: SparkSession, paths: Sequence[str], from_start: bool = False) -> DataFrame:
    """A stream of the lines that are appended to some files, or to files of some directories."""
    spark.dataSource.register(TailSource)
    return spark.readStream.format("textloom_tail").option("paths", "\n".join(paths)).option("from_start", str(from_start)).load()


def search_stream(lines: DataFrame, spec: SearchSpec) -> DataFrame:
    """Selected lines of a stream of lines, with their fragments: stateless, so any trigger and append mode will do."""
    return lines.where(S.line_matches(spec, lines["line"])).withColumn("fragments", S.line_fragments(spec, lines["line"]))


def context_stream(lines: DataFrame, spec: SearchSpec, before: int, after: int) -> DataFrame:
    """path, line_number, line, is_context: selected lines of a stream with the lines around them.

    State by path: the last ``before`` lines that weren't shown, how many lines are still to be shown, and the last
    number shown.  A path's state is bounded by ``before`` lines.
    """
    marked = lines.withColumn("hit", S.line_matches(spec, lines["line"]))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        numbers, texts, left = (list(state.get[0]), list(state.get[1]), state.get[2]) if state.exists else ([], [], 0)
        out = []
        rows = pd.concat(list(batches)).sort_values("line_number")
        for number, line, hit in zip(rows["line_number"].tolist(), rows["line"].tolist(), rows["hit"].tolist()):
            if hit:
                out += [(key[0], n, t, True) for n, t in zip(numbers, texts)]
                out.append((key[0], number, line, False))
                numbers, texts, left = [], [], after
            elif left:
                out.append((key[0], number, line, True))
                left -= 1
            elif before:
                numbers, texts = [*numbers, number][-before:], [*texts, line][-before:]
        state.update((numbers, texts, left))
        yield pd.DataFrame(out, columns=["path", "line_number", "line", "is_context"])

    return (
        marked.select("path", "line_number", "line", "hit")
        .groupBy("path")
        .applyInPandasWithState(step, "path string, line_number long, line string, is_context boolean", "numbers array<long>, texts array<string>, left int", "append", GroupStateTimeout.NoTimeout)
    )
