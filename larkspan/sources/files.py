"""File trees as DataFrames: scan, decode, name parts.

Tasks list the folders, level by level, and open the files by Arrow's file systems; the list of files
is a table in the shared folder and never comes to the driver.

A store that Arrow does not reach is left to Spark's own listing and reader, whose list the driver holds. It
hides names that begin with a dot or an underscore (``__init__.py``), so these are found by patterns of the
session's file system. Folders of that kind become further roots of Spark's listing; files of that kind are
copied to plain names in the shared folder and read from there.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.classic.column import Column as JvmColumn

from ..functions.text import col, unix_lines
from ..session import scratch_path, staged

#: A longer file does not fit in one value.
LONGEST = (1 << 31) - 1 - 15
COPY_THREADS = 16
#: What a task reads, and what it hands on at a time.
TASK_BYTES, TASK_FILES = 64 << 20, 10_000
BATCH_BYTES, BATCH_FILES = 8 << 20, 1_000

# What a scan leaves out. Folders with a leading dot are left out too.
IGNORED_FOLDERS = (
    "__pycache__", ".git", ".hg", ".svn", "node_modules", "venv", ".venv", "env", ".env", "index",
    "dist", "build", ".idea", ".vscode", ".pytest_cache", ".mypy_cache",
)
IGNORED_FILES = (".DS_Store", "Thumbs.db", "metadata.pkl")
IGNORED_EXTENSIONS = (
    ".pyc", ".pyo", ".exe", ".dll", ".so", ".bin", ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".ico",
    ".pdf", ".zip", ".tar", ".gz", ".7z", ".rar", ".mp3", ".mp4", ".mov", ".index", ".pkl",
)


def file_name(path: Column | str) -> Column:
    return F.element_at(F.split(col(path), "/"), -1)


def extension(name: Column | str) -> Column:
    """Lower-cased last extension; leading dots belong to the name."""
    return F.lower(F.regexp_extract(col(name), r"^\.*[^.].*(\.[^.]*)$", 1))


def decode_text(content: Column | str) -> Column:
    """UTF-8, else Latin-1; every line end becomes a line feed."""
    text = col(content).cast("string")
    decoded = F.when(F.is_valid_utf8(text), text).otherwise(F.decode(col(content), "ISO-8859-1"))
    return unix_lines(decoded)


def _wanted(name: Column, names: Iterable[str], extensions: Iterable[str]) -> Column:
    return ~name.isin(list(names)) & ~extension(name).isin(list(extensions))


def _open_folders(inner: Column, folders: Iterable[str]) -> Column:
    """No folder of a path below the root is ignored or begins with a dot."""
    listed = "|".join(re.escape(f) for f in folders)
    return ~F.concat(F.lit("/"), inner).rlike(rf"/(\.[^/]*{'|' + listed if listed else ''})/")


def _opened(root: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system of a root, and the root's path in it."""
    return (pafs.LocalFileSystem(), root.removeprefix("file:")) if root.startswith("file:") else pafs.FileSystem.from_uri(root)


def _entries(root: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is directly in each folder below the root; a link to nothing is left out."""
    system, base = _opened(root)
    for batch in batches:
        for inner in batch.column(0).to_pylist():
            found = system.get_file_info(pafs.FileSelector(f"{base}/{inner}"))
            for at in range(0, len(found), 10_000):
                part = [i for i in found[at : at + 10_000] if i.type != pafs.FileType.NotFound]
                yield pa.RecordBatch.from_pydict({
                    "inner": pa.array([f"{inner}/{i.base_name}" if inner else i.base_name for i in part], pa.string()),
                    "length": pa.array([i.size or 0 for i in part], pa.int64()),
                    "folder": pa.array([i.type == pafs.FileType.Directory for i in part], pa.bool_()),
                })


def _contents(root: str, longest: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Path, length and content of each file; nothing of a longer one."""
    system, base = _opened(root)
    kinds = {"inner": pa.string(), "length": pa.int64(), "content": pa.binary()}

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), kinds.values())], names=list(kinds))

    rows, size = [], 0
    for batch in batches:
        for inner, length in zip(*[c.to_pylist() for c in batch.columns]):
            fits = length <= longest
            if rows and (fits and size + length > BATCH_BYTES or len(rows) == BATCH_FILES):
                yield made(rows)
                rows, size = [], 0
            content = b"" if fits else None
            if fits and length:
                with system.open_input_stream(f"{base}/{inner}") as source:
                    content = source.read()
            rows.append((inner, length, content))
            size += len(content or b"")
    if rows:
        yield made(rows)


class _Listed:
    """A root whose folders tasks list and whose files tasks open."""

    def __init__(self, spark: SparkSession, shown: str, root: str, folders: Iterable[str], names: Iterable[str], extensions: Iterable[str]) -> None:
        self.spark, self.shown, self.root = spark, shown, root
        cores = spark.sparkContext.defaultParallelism
        folders, names, extensions = list(folders), list(names), list(extensions)
        self.files, level = None, spark.createDataFrame([("",)], "inner STRING")
        while not level.isEmpty():
            entries = level.repartition(cores, "inner").mapInArrow(lambda b: _entries(root, b), "inner STRING, length BIGINT, folder BOOLEAN")
            found = staged(entries, "listed")
            name = file_name("inner")
            level = found.filter(F.col("folder") & ~name.startswith(".") & ~name.isin(folders)).select("inner")
            more = found.filter(~F.col("folder") & _wanted(name, names, extensions)).drop("folder")
            self.files = more if self.files is None else self.files.unionByName(more)

    def _path(self) -> Column:
        return F.concat(F.lit(self.shown + "/"), "inner").alias("path")

    def listed(self) -> DataFrame:
        """``path`` and ``length`` of every wanted file."""
        return self.files.select(self._path(), "length")

    def scanned(self, longest: int) -> DataFrame:
        """``path``, ``length`` and ``content`` of every wanted file; a longer one is not opened and its content is null."""
        total = self.files.agg(F.count(F.lit(1)).alias("n"), F.sum(F.least("length", F.lit(longest))).alias("bytes")).first()
        parts = max(self.spark.sparkContext.defaultParallelism, total["n"] // TASK_FILES, (total["bytes"] or 0) // TASK_BYTES)
        root = self.root
        rows = self.files.repartition(parts).mapInArrow(lambda b: _contents(root, longest, b), "inner STRING, length BIGINT, content BINARY")
        return rows.select(self._path(), "length", "content")


def _literal(path: str) -> str:
    """A path whose characters are no pattern."""
    return "".join("\\" + c if c in "*?[]{}\\^" else c for c in path)


class _Tree:
    """A root that only Spark reaches, the hidden folders below it that are roots of their own, and the hidden files that are wanted."""

    def __init__(self, spark: SparkSession, root: str, folders: Iterable[str], names: Iterable[str], extensions: Iterable[str]) -> None:
        self.spark, self.folders, self.names, self.extensions = spark, list(folders), list(names), list(extensions)
        self.jvm = spark.sparkContext._jvm
        self.conf = spark._jsparkSession.sessionState().newHadoopConf()
        given = self.jvm.org.apache.hadoop.fs.Path(root)
        self.system = given.getFileSystem(self.conf)
        self.root = self.system.makeQualified(given)
        if not self.system.exists(self.root):
            raise FileNotFoundError(root)
        self.prefix, self.encoded = self.root.toString().rstrip("/"), self.root.toUri().toString().rstrip("/")
        self.roots, self.files = [self.prefix], []
        depth = _literal(self.prefix)
        while True:
            found = self._hidden(f"{depth}/{{.*,_*}}")
            for path, length, is_folder in found:
                inner = path[len(self.prefix) + 1 :].split("/")
                if any(p.startswith(".") or p in self.folders for p in (inner if is_folder else inner[:-1])):
                    continue
                if is_folder:
                    self.roots.append(path)
                else:
                    self.files.append((path, length))
            depth += "/*"
            if not len(self.system.globStatus(self.jvm.org.apache.hadoop.fs.Path(depth)) or []):
                break

    def _hidden(self, pattern: str) -> list[tuple[str, int, bool]]:
        found = self.system.globStatus(self.jvm.org.apache.hadoop.fs.Path(pattern)) or []
        return [(s.getPath().toString(), s.getLen(), s.isDirectory()) for s in found]

    def _read(self) -> DataFrame:
        return self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load([_literal(r) for r in self.roots])

    def visible(self) -> DataFrame:
        """``path`` (whole), ``length`` and on demand ``content`` of the wanted files with plain names that are not empty.

        The conditions on the file's own path and name are met before a file is opened.
        """
        inner = F.substring(F.col("_metadata.file_path"), len(self.encoded) + 2, 1 << 30)
        rows = self._read().filter(_wanted(F.col("_metadata.file_name"), self.names, self.extensions) & _open_folders(inner, self.folders))
        return rows.filter(self._wanted_path()).select("path", "length", "content")

    def empty(self) -> DataFrame:
        """``path`` and ``length`` of the wanted empty files with plain names, which Spark lists but does not read."""
        rows = self._read()
        # the list stays in the JVM, as one literal
        listed = JvmColumn(self.jvm.org.apache.spark.sql.functions.lit(rows._jdf.inputFiles()))
        # a path without a host is written with one slash or three
        one_slash = lambda c: F.regexp_replace(c, "^([A-Za-z][A-Za-z0-9+.-]*):///", "$1:/").alias("value")
        every = self.spark.range(1).select(F.explode(listed).alias("value")).select(one_slash("value"))
        none = every.join(rows.select(one_slash(F.col("_metadata.file_path"))), "value", "left_anti")
        path = F.url_decode(F.replace("value", F.lit("+"), F.lit("%2B")))
        return none.select(path.alias("path"), F.lit(0).cast("long").alias("length")).filter(self._wanted_path())

    def _wanted_path(self) -> Column:
        inner = F.substring("path", len(self.prefix) + 2, 1 << 30)
        return _wanted(file_name("path"), self.names, self.extensions) & _open_folders(inner, self.folders)

    def hidden(self) -> DataFrame:
        """``path`` and ``length`` of the wanted files with hidden names."""
        return self.spark.createDataFrame(self.files, "path STRING, length BIGINT").filter(self._wanted_path())

    def copies(self, longest: int) -> DataFrame:
        """``path``, ``length`` and ``content`` of the wanted hidden files of up to ``longest`` bytes, read from copies with plain names."""
        wanted = [r["path"] for r in self.hidden().filter(F.col("length") <= longest).select("path").collect()]
        empty = "path STRING, length BIGINT, content BINARY"
        if not wanted:
            return self.spark.createDataFrame([], empty)
        folder = scratch_path(self.spark, "hidden")
        path = self.jvm.org.apache.hadoop.fs.Path
        target = path(folder).getFileSystem(self.conf)

        def copy(at: int) -> None:
            self.jvm.org.apache.hadoop.fs.FileUtil.copy(self.system, path(wanted[at]), target, path(f"{folder}/{at}"), False, self.conf)

        with ThreadPoolExecutor(COPY_THREADS) as pool:
            list(pool.map(copy, range(len(wanted))))
        names = self.spark.createDataFrame(list(enumerate(wanted)), "at INT, name STRING")
        rows = self.spark.read.format("binaryFile").load(folder).withColumn("at", file_name("path").cast("int"))
        # an empty copy is not read
        return names.join(rows, "at", "left").select(
            F.col("name").alias("path"), F.coalesce("length", F.lit(0)).alias("length"), F.coalesce("content", F.lit(b"")).alias("content"))

    def listed(self) -> DataFrame:
        """``path`` and ``length`` of every wanted file."""
        return self.visible().select("path", "length").unionByName(self.empty()).unionByName(self.hidden())

    def scanned(self, longest: int) -> DataFrame:
        """``path``, ``length`` and ``content`` of every wanted file; a longer one is not opened and its content is null."""
        visible = self.visible()
        fits = visible.filter(F.col("length") <= longest).unionByName(self.copies(longest))
        fits = fits.unionByName(self.empty().withColumn("content", F.lit(b"")))
        over = visible.select("path", "length").unionByName(self.hidden()).filter(F.col("length") > longest)
        return fits.unionByName(over.withColumn("content", F.lit(None).cast("binary")))


def _reached(spark: SparkSession, root: str) -> bool:
    """Whether a task finds the folder by Arrow's file systems."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            try:
                system, path = _opened(root)
                found = system.get_file_info(path).type == pafs.FileType.Directory
            except (OSError, ValueError, NotImplementedError, pa.ArrowException):
                found = False
            yield pa.RecordBatch.from_pydict({"found": pa.array([found] * batch.num_rows)})

    return spark.range(1, numPartitions=1).mapInArrow(look, "found BOOLEAN").first()["found"]


def _tree(spark: SparkSession, root: str, folders: Iterable[str], names: Iterable[str], extensions: Iterable[str]) -> _Listed | _Tree:
    """The files below a root, by tasks if they reach it; a missing root is an error."""
    given = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    system = given.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not system.exists(given):
        raise FileNotFoundError(root)
    # a mount names the store behind it
    place = system.resolvePath(given).toUri()
    found = f"file:{place.getPath()}" if place.getScheme() == "file" else place.toASCIIString()
    shown = system.makeQualified(given).toString().rstrip("/")
    wanted = folders, names, extensions
    return _Listed(spark, shown, found.rstrip("/"), *wanted) if _reached(spark, found) else _Tree(spark, root, *wanted)


def _plain(path: str) -> Column:
    """Local paths without their scheme."""
    return F.regexp_replace(path, "^file:/+", "/")


def list_files(
    spark: SparkSession, root: str,
    ignored_folders: Iterable[str] = IGNORED_FOLDERS, ignored_files: Iterable[str] = IGNORED_FILES,
    ignored_extensions: Iterable[str] = IGNORED_EXTENSIONS,
) -> DataFrame:
    """``filepath, length`` of every wanted file below ``root``; no file is opened.

    Ignored folders, and those that begin with a dot, are left out with all below them. A missing root is an error.
    """
    found = _tree(spark, root, ignored_folders, ignored_files, ignored_extensions).listed()
    return found.select(_plain("path").alias("filepath"), "length")


def scan_files(
    spark: SparkSession, root: str,
    ignored_folders: Iterable[str] = IGNORED_FOLDERS, ignored_files: Iterable[str] = IGNORED_FILES,
    ignored_extensions: Iterable[str] = IGNORED_EXTENSIONS, longest: int = LONGEST,
) -> DataFrame:
    """``filepath, length, content, error`` of every wanted file below ``root``.

    A file longer than ``longest`` bytes is not opened, its content is null and ``error`` says why. Any other
    failure to read fails the task, so Spark tries it again and in the end says which file it was.
    """
    rows = _tree(spark, root, ignored_folders, ignored_files, ignored_extensions).scanned(longest)
    error = F.when(F.col("length") > longest, F.concat(F.lit("longer than "), F.lit(str(longest)), F.lit(" bytes")))
    return rows.select(_plain("path").alias("filepath"), "length", "content").withColumn("error", error)


def read_documents(files: DataFrame) -> DataFrame:
    """``filename, filepath, extension, content`` with the content as text, and ``error`` if the files have it."""
    name = file_name("filepath")
    kept = ["error"] if "error" in files.columns else []
    return files.select(
        name.alias("filename"), "filepath", extension(name).alias("extension"),
        decode_text("content").alias("content"), *kept,
    )
