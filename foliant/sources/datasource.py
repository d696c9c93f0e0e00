"""The batch source `layereddoc`: spark.read.format("layereddoc").option("table", "pages").load(path).

Options: table (documents, components, pages, chunks, text, zones, outline_nodes, links),
chunkIds (comma separated, for chunks), recursive. Files below the path are listed through the
file systems that pyarrow knows; where only Spark reaches the path, read with
foliant.operators.tables.read_files and use the table functions, which is the main way.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from foliant import schemas as S

TABLES = {"documents": S.DOCUMENTS, "components": S.COMPONENTS, "pages": S.PAGES, "chunks": S.CHUNKS, "text": S.TEXT, "zones": S.ZONES, "outline_nodes": S.OUTLINE, "links": S.LINKS}


class LayeredDocSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "layereddoc"

    def schema(self) -> str:
        table = self.options.get("table", "pages")
        if table not in TABLES:
            raise ValueError(f"table must be one of {', '.join(TABLES)}")
        return TABLES[table]

    def reader(self, schema: StructType) -> DataSourceReader:
        return LayeredDocReader(self.options, schema)


class LayeredDocReader(DataSourceReader):
    #: Bytes of files that one task takes, at least one file.
    TASK = 32 << 20

    def __init__(self, options, schema: StructType):
        self.options, self.schema = options, schema

    def partitions(self) -> list[InputPartition]:
        system, path = fs.FileSystem.from_uri(self.options["path"]) if "://" in self.options["path"] else (fs.LocalFileSystem(), self.options["path"])
        if system.get_file_info(path).type == fs.FileType.File:
            found = [system.get_file_info(path)]
        else:
            found = [f for f in system.get_file_info(fs.FileSelector(path, recursive=self.options.get("recursive", "false") == "true")) if f.extension == "djvu"]
        tasks, size = [[]], 0
        for f in sorted(found, key=lambda f: f.path):
            if tasks[-1] and size + f.size > self.TASK:
                tasks.append([])
                size = 0
            tasks[-1].append(f.path)
            size += f.size
        return [InputPartition(t) for t in tasks]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from foliant.operators.tables import MAKERS

        table = self.options.get("table", "pages")
        system = fs.FileSystem.from_uri(self.options["path"])[0] if "://" in self.options["path"] else fs.LocalFileSystem()
        wanted = self.options.get("chunkIds")
        for path in partition.value:
            with system.open_input_stream(path) as f:
                more = (set(wanted.split(",")),) if wanted and table == "chunks" else ()
                yield from MAKERS[table](path, f.read(), *more)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LayeredDocSource)
