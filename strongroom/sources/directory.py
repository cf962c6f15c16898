"""A folder tree as a table: every regular file below a root, hidden and empty ones included, links not followed.

``spark.dataSource.register(DirectorySource)`` and ``spark.read.format("directory").load(root)`` give ``name, size,
content``.  Names are relative with forward slashes; a root that is a file gives its own name.  Partitions hold paths, so
executors read files in parallel; the root must be a path that all executors see.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Paths(InputPartition):
    def __init__(self, items: list[tuple[str, str]]):
        super().__init__(None)
        self.items = items


def walk(root: str) -> Iterator[tuple[str, str]]:
    """(path, name) of the regular files, by name."""
    if os.path.isfile(root) and not os.path.islink(root):
        yield root, os.path.basename(root)
        return
    for folder, folders, names in os.walk(root, followlinks=False):
        folders.sort()
        for name in sorted(names):
            path = os.path.join(folder, name)
            if os.path.isfile(path) and not os.path.islink(path):
                yield path, os.path.relpath(path, root).replace(os.sep, "/")


class DirectoryReader(DataSourceReader):
    def __init__(self, root: str, per_partition: int):
        self.root, self.per_partition = root, per_partition

    def partitions(self) -> list[InputPartition]:
        items = list(walk(self.root))
        return [Paths(items[k : k + self.per_partition]) for k in range(0, len(items), self.per_partition)] or [Paths([])]

    def read(self, partition: Paths) -> Iterator[tuple]:
        for path, name in partition.items:
            with open(path, "rb") as file:
                content = file.read()
            yield name, len(content), content


class DirectorySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "directory"

    def schema(self) -> str:
        return "name string, size bigint, content binary"

    def reader(self, schema) -> DirectoryReader:
        return DirectoryReader(self.options["path"], int(self.options.get("filesPerPartition", 256)))
