"""A data source of print files: spark.read.format("prints").option("view", "runs").load(path).

Views: heads, chunks, entries, runs, verified (leaf hashes against the stored ones, chunk by chunk).  A filter on the
layer is pushed to the reader.  A file is read by ranges: header, directory and small chunks, then the layer chunks that
the view needs, one after the other.  One partition for each file; paths are listed and read through Arrow's file systems.
"""

from __future__ import annotations

import fnmatch

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition

from ..session import ship
from . import format as X
from .codec import Fault
from .prints import run_batches

VIEWS = {
    "heads": "file_id string, encoder string, created long, width long, height long, layer_height_um long, total_layers long",
    "chunks": "file_id string, dir_index int, chunk_type string, offset long, size_uncompressed long, size_compressed long, flags long",
    "entries": "file_id string, layer int, sector_id long, data_size long, data_offset long, first_layr long, first_lrov long",
    "verified": "file_id string, layer int, leaf binary, matches boolean",
    "runs": "file_id string, layer int, sector_id long, run_idx int, start long, end long, value int",
}


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri.removeprefix("file:"))


class File(InputPartition):
    def __init__(self, uri: str):
        self.uri = uri


class PrintReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.view, self.layer = options["path"], options.get("view", "runs"), None

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("layer",) and self.view in ("entries", "runs", "verified"):
                self.layer = f.value
            else:
                yield f

    def partitions(self):
        from pyarrow import fs as pf

        top, _, pattern = self.path.rpartition("/")
        fs, root = _filesystem(self.path if not any(c in pattern for c in "*?[") else top)
        info = fs.get_file_info(root)
        if info.type == pf.FileType.File:
            return [File(self.path)]
        found = fs.get_file_info(pf.FileSelector(root))
        scheme = self.path.split("://")[0] + "://" if "://" in self.path else ""
        match = pattern if any(c in pattern for c in "*?[") else "*"
        return [File(scheme + f.path) for f in sorted(found, key=lambda f: f.path) if f.type == pf.FileType.File and fnmatch.fnmatch(f.base_name, match)]

    def read(self, partition: File):
        fs, path = _filesystem(partition.uri)
        with fs.open_input_file(path) as f:
            name, p = partition.uri, X.read_ranges(lambda offset, length: f.read_at(length, offset), f.size())
            if self.view == "runs":
                yield from run_batches(name, p, layer=self.layer)
            else:
                yield from getattr(self, f"_{self.view}")(name, p)

    def _heads(self, name: str, p: X.Parsed):
        if p.head:
            h = p.head
            yield (name, h.name, h.created, h.width, h.height, h.layer_height, h.total_layers)

    def _chunks(self, name: str, p: X.Parsed):
        for c in p.chunks:
            if c.offset:
                yield (name, c.index, c.kind, c.offset, c.size, c.compressed, c.flags)

    def _entries(self, name: str, p: X.Parsed):
        for e in p.entries:
            if self.layer in (None, e.layer):
                yield (name, e.layer, e.sector, e.data_size, e.data_offset, e.first_layr, e.first_lrov)

    def _verified(self, name: str, p: X.Parsed):
        """Layer by layer, so that no more than a layer's chunks are in memory; a layer that can't be read does not match."""
        stored = [c for c in p.of("LHAS") if not c.flags & X.SEALED]
        leaves = X.parse_hashes(stored[0].payload)[2] if stored else []
        for k in range(p.layers):
            if self.layer in (None, k):
                try:
                    found = X.leaf(p.layer_data(k))
                except Fault:
                    found = None
                yield (name, k, found, found == leaves[k] if k < len(leaves) else None)


class PrintSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "prints"

    def schema(self) -> str:
        return VIEWS[self.options.get("view", "runs")]

    def reader(self, schema) -> PrintReader:
        return PrintReader(dict(self.options))


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PrintSource)
