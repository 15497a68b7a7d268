"""Markdown tables as a Spark data source: a reader with a partition for each file, a writer whose commit makes one table.

    spark.dataSource.register(MarkdownTables)
    spark.read.format("markdown").load("reports")                       # path, line, header and cells of every row
    report.write.format("markdown").mode("overwrite").save("out.md")    # rows in the order of the frame

Paths are those of a file system that driver and executors share.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

_RULE = re.compile(r"\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*")
_CELL = re.compile(r"(?<!\\)\|")


def cells(line: str) -> list[str]:
    """The cells of a table's line, without its outer bars; an escaped bar is part of a cell."""
    text = line.strip()
    text = text[1:] if text.startswith("|") else text
    text = text[:-1] if text.endswith("|") and not text.endswith("\\|") else text
    return [c.strip().replace("\\|", "|") for c in _CELL.split(text)]


def rows(lines: list[str]) -> Iterator[tuple[int, list[str], list[str]]]:
    """(line, header, cells) of all rows of all tables: a header, a rule of dashes, and lines until one that has no bar."""
    at = 0
    while at + 1 < len(lines):
        head = cells(lines[at])
        if "|" in lines[at] and _RULE.fullmatch(lines[at + 1].strip()) and len(cells(lines[at + 1])) == len(head):
            at += 2
            while at < len(lines) and "|" in lines[at]:
                own = cells(lines[at])
                yield at + 1, head, own[: len(head)] + [""] * (len(head) - len(own))
                at += 1
        else:
            at += 1


@dataclass
class FilePart(InputPartition):
    path: str


class MarkdownReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[FilePart]:
        root = Path(self.path)
        if not root.exists():
            raise FileNotFoundError(self.path)
        return [FilePart(str(p)) for p in (sorted(root.rglob("*.md")) if root.is_dir() else [root])]

    def read(self, partition: FilePart) -> Iterator[tuple]:
        with open(partition.path, encoding="utf-8") as f:
            for line, head, own in rows(f.read().splitlines()):
                yield partition.path, line, head, own


@dataclass
class Written(WriterCommitMessage):
    part: int
    path: str


class MarkdownWriter(DataSourceWriter):
    """Each task writes its lines beside the target; the commit puts them under one header, in the order of the partitions."""

    def __init__(self, path: str, schema: StructType, overwrite: bool):
        self.path, self.names, self.overwrite = path, schema.names, overwrite
        self.draft = f"{path}.{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Written:
        from pyspark import TaskContext

        own = TaskContext.get()
        part = own.partitionId()
        to = f"{self.draft}-{part}-{own.taskAttemptId()}"
        with open(to, "w", encoding="utf-8") as f:
            for row in iterator:
                told = ["" if v is None else str(v).replace("|", "\\|").replace("\n", " ") for v in row]
                f.write(f"| {' | '.join(told)} |\n")
        return Written(part, to)

    def commit(self, messages: list[Written | None]) -> None:
        done = sorted((m for m in messages if m is not None), key=lambda m: m.part)
        with open(self.draft, "w", encoding="utf-8") as f:
            f.write(f"| {' | '.join(self.names)} |\n|{' --- |' * len(self.names)}\n")
            for m in done:
                with open(m.path, encoding="utf-8") as part:
                    f.writelines(part)
        if not self.overwrite and os.path.exists(self.path):
            os.remove(self.draft)
            raise FileExistsError(self.path)
        os.replace(self.draft, self.path)
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        for left in Path(self.draft).parent.glob(f"{Path(self.draft).name}*"):
            left.unlink(missing_ok=True)


class MarkdownTables(DataSource):
    @classmethod
    def name(cls) -> str:
        return "markdown"

    def schema(self) -> str:
        return "path string, line int, header array<string>, cells array<string>"

    def reader(self, schema: StructType) -> MarkdownReader:
        return MarkdownReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> MarkdownWriter:
        return MarkdownWriter(self.options["path"], schema, overwrite)
