"""Files of their own, listed and read by tasks: what the driver holds doesn't grow with their number."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.scratch import cut

#: Schemes of pyarrow's file systems.
SCHEMES = ("file", "hdfs", "s3", "gs", "abfs", "abfss")
#: Rows and bytes of a batch of listed or read files.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20

_LISTED = "path string, store string, at string, folder boolean, modified timestamp, bytes bigint"
#: What java.net.URI quotes in a path.
_QUOTED = r"[\x00-\x20\"#%<>?\[\]\\^`{|}\x7f-\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def hadoop(spark: SparkSession, path: str):
    """(path, its file system) as Hadoop's objects."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def located(fs, p) -> tuple[str, str]:
    """(store, place in it) of a Hadoop path, where a mounted one really is; open_store takes the store."""
    uri = fs.resolvePath(p).toUri()
    return f"{(uri.getScheme() or 'file').replace('s3a', 's3')}://{uri.getAuthority() or ''}/", uri.getPath()


def open_store(store: str) -> tuple[pafs.FileSystem, str]:
    """The file system and what stands before a place in it."""
    fs, base = pafs.FileSystem.from_uri(store)
    return fs, base.rstrip("/")


def path_uri(path: str) -> str:
    """A path as Spark's _metadata.file_path writes it."""
    return re.sub(_QUOTED, lambda m: quote(m[0], safe=""), path)


def _hidden(name: str) -> bool:
    """Names that Spark's readers pass over."""
    return (name[0] == "." or name[0] == "_" and "=" not in name or name.endswith("._COPYING_")) and not name.startswith(("_common_metadata", "_metadata"))


def list_files(spark: SparkSession, root: str, glob: str) -> DataFrame | None:
    """(path, store, at, modified, bytes) of the files below root that Spark's readers would take; None if only Hadoop knows the store.

    Folders are listed level by level, each by one task, and entries stay in the checkpoint folder.
    """
    p, fs = hadoop(spark, root)
    tops = [fs.makeQualified(s.getPath()) for s in fs.globStatus(p) or ()]
    if not tops:
        raise FileNotFoundError(f"{root} does not exist")
    rows = [(t.toString(), *located(fs, t)) for t in tops]
    if any(store.partition(":")[0] not in SCHEMES for _, store, _ in rows):
        return None
    pattern = spark.sparkContext._jvm.org.apache.hadoop.fs.GlobPattern(glob).compiled().pattern()

    def look(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, stores = re.compile(pattern, re.S), {}
        types = pa.schema([("path", pa.string()), ("store", pa.string()), ("at", pa.string()), ("folder", pa.bool_()), ("modified", pa.timestamp("us", "UTC")), ("bytes", pa.int64())])
        for b in it:
            for path, store, at in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if store not in stores:
                    stores[store] = open_store(store)
                s, base = stores[store]
                here = s.get_file_info(base + at)
                one = here.type == pafs.FileType.File
                entries, out = [here] if one else s.get_file_info(pafs.FileSelector(base + at)), []
                for e in entries:
                    folder, name = e.type == pafs.FileType.Directory, e.base_name
                    if _hidden(name) or not folder and (e.type != pafs.FileType.File or not e.size or not names.fullmatch(name)):
                        continue
                    below = "" if one else f"/{name}"
                    # Hadoop's times are milliseconds
                    ms = None if e.mtime_ns is None else e.mtime_ns // 1_000_000 * 1000
                    out.append((path.rstrip("/") + below, store, at.rstrip("/") + below, folder, ms, e.size))
                for i in range(0, len(out), BATCH_ROWS):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i : i + BATCH_ROWS], strict=True), types.types, strict=True)], schema=types)

    level, files, n = spark.createDataFrame(rows, "path string, store string, at string"), None, len(rows)
    while n:
        seen = cut(_spread(level, n).mapInArrow(look, _LISTED))
        found = seen.where("not folder").drop("folder")
        files = found if files is None else files.union(found)
        level = seen.where("folder").select("path", "store", "at")
        n = level.count()
    return files


def _spread(rows: DataFrame, n: int) -> DataFrame:
    """Small rows that stand for much work, dealt to n tasks or as many as a shuffle has."""
    return rows.repartition(max(1, min(n, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))))


def read_files(files: DataFrame, name: Callable[[str], str] = str) -> DataFrame:
    """(path, content) of list_files, contents whole and, by their suffix, unpacked; name gives the path its form."""

    def take(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stores, paths, data, n = {}, [], [], 0
        batch = lambda: pa.RecordBatch.from_pydict({"path": pa.array(paths, pa.string()), "content": pa.array(data, pa.binary())})
        for b in it:
            for path, store, at in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if store not in stores:
                    stores[store] = open_store(store)
                s, base = stores[store]
                with s.open_input_stream(base + at) as f:
                    data.append(f.read())
                paths.append(name(path))
                n += len(data[-1])
                if n >= BATCH_BYTES or len(data) >= BATCH_ROWS:
                    yield batch()
                    paths, data, n = [], [], 0
        if data:
            yield batch()

    size = files.agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    tasks = max(size.n // BATCH_ROWS, size.bytes // BATCH_BYTES) + 1
    return _spread(files.select("path", "store", "at"), tasks).mapInArrow(take, "path string, content binary")
