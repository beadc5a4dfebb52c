"""The table folder as a format of its own: ``spark.read.format("quarrydf").load(path)`` after :func:`register`.

A folder of Parquet files or a versioned table (its current version, or the one that the option ``version`` names) is read in Arrow batches, one
partition a row group. For pushdown into the scan use :func:`quarrydf.sources.store.read`, which plans Spark's own Parquet reader.
"""

from __future__ import annotations

from pyspark.sql import SparkSession


def register(spark: SparkSession) -> None:
    """Make the format known to the session."""
    spark.dataSource.register(_source())


def _source():
    # inside a function, so that the classes travel to the workers by value
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    def dataset(options):
        import json

        import pyarrow.dataset as ds
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(options["path"]) if ":" in options["path"] else (fs.LocalFileSystem(), options["path"])
        log = system.get_file_info(fs.FileSelector(f"{root}/_log", allow_not_found=True))
        entries = []
        for file in log:
            if file.base_name.endswith(".json"):
                with system.open_input_stream(file.path) as stream:
                    try:
                        entries.append(json.loads(stream.read()))
                    except ValueError:
                        continue
        wanted = int(options["version"]) if "version" in options else None
        chosen = [e for e in entries if wanted is None or e["version"] == wanted]
        if wanted is not None and not chosen:
            raise ValueError(f"{root} has no version {wanted}")
        if chosen:
            root = f"{root}/data/{max(chosen, key=lambda e: e['version'])['path'].rstrip('/').rpartition('/')[2]}"
        return ds.dataset(root, format="parquet", filesystem=system, exclude_invalid_files=True)

    class Group(InputPartition):
        def __init__(self, file, group):
            self.file, self.group = file, group

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.options = options

        def partitions(self):
            return [Group(f.path, g.id) for f in dataset(self.options).get_fragments() for g in f.row_groups]

        def read(self, partition):
            whole = dataset(self.options)
            fragment = whole.format.make_fragment(partition.file, whole.filesystem, row_groups=[partition.group])
            yield from fragment.to_batches(schema=whole.schema)

    class Source(DataSource):
        @classmethod
        def name(cls):
            return "quarrydf"

        def schema(self):
            from pyspark.sql.pandas.types import from_arrow_schema

            return from_arrow_schema(dataset(self.options).schema)

        def reader(self, schema):
            return Reader(dict(self.options))

    return Source
