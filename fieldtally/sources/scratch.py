"""Folders that all executors see, and files written into them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where the session runs on this machine alone."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
        found = f"file://{tempfile.mkdtemp(prefix='shared-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_root(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def text_files(lines: DataFrame, name: str, by: str = "flight_id") -> str:
    """Lines (by, ord, value) written as one text file for each ``by``, in order; the folder's path."""
    path = fresh(lines.sparkSession, name)
    lines.repartition(by).sortWithinPartitions(by, "ord").select(by, "value").write.partitionBy(by).text(path)
    return path


def spread(spark: SparkSession) -> int:
    """Tasks over which small rows are dealt that stand for much work, such as names of files."""
    return 4 * spark.sparkContext.defaultParallelism


def binary_files(files: DataFrame, name: str) -> str:
    """Files (path below the folder, content) written by the tasks that hold them; the folder's path."""
    from pyarrow import fs

    folder = fresh(files.sparkSession, name)

    def put(batches):
        store, base = fs.FileSystem.from_uri(folder)
        made = set()
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                if (above := f"{base}/{path}".rsplit("/", 1)[0]) not in made:
                    store.create_dir(above, recursive=True)
                    made.add(above)
                with store.open_output_stream(f"{base}/{path}") as out:
                    out.write(content)
            yield b[["path"]]

    files.mapInPandas(put, "path string").agg(F.count("path")).collect()
    return folder


def listed_files(spark: SparkSession, path: str, names: tuple[str, ...]) -> DataFrame:
    """(path) of the files with a name like one of ``names`` in and below what a path with wildcards stands for.

    Tasks list the folders, level by level, so that the driver never holds the names. What begins with _ or . is left out.
    """
    import pandas as pd
    from fnmatch import fnmatchcase

    from pyarrow import fs

    def shown(found):
        return (i for i in found if not i.base_name.startswith(("_", ".")))

    def inside(like):
        def run(batches):
            for b in batches:
                rows = []
                for folder in b["path"]:
                    store, base = fs.FileSystem.from_uri(folder)
                    if store.get_file_info(base).type != fs.FileType.Directory:
                        continue
                    found = shown(store.get_file_info(fs.FileSelector(base)))
                    rows += [f"{folder.rstrip('/')}/{i.base_name}" for i in found if fnmatchcase(i.base_name, like)]
                yield pd.DataFrame({"path": rows}, dtype=object)

        return run

    def below(batches):
        for b in batches:
            for top in b["path"]:
                open_ = [top]
                while open_:
                    at = open_.pop()
                    store, base = fs.FileSystem.from_uri(at)
                    own = store.get_file_info(base)
                    if own.type == fs.FileType.File:
                        found = [(at, own)]
                    else:
                        found = [(f"{at.rstrip('/')}/{i.base_name}", i) for i in shown(store.get_file_info(fs.FileSelector(base)))]
                    open_ += [p for p, i in found if i.type == fs.FileType.Directory]
                    yield pd.DataFrame({"path": [p for p, i in found if i.type == fs.FileType.File and any(fnmatchcase(i.base_name, n) for n in names)]}, dtype=object)

    parts = path.split("/")
    plain = next((i for i, p in enumerate(parts) if set(p) & set("*?[")), len(parts))
    rows = spark.createDataFrame([("/".join(parts[:plain]),)], "path string")
    for like in parts[plain:]:
        rows = rows.mapInPandas(inside(like), "path string")
    return rows.repartition(spread(spark)).mapInPandas(below, "path string")
