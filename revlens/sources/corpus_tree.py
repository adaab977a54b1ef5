"""A1 / A2: source trees as a corpus table, on any file system Arrow opens.

A root is a local path or a URI (``file:``, ``s3:``, ``gs:``, ``hdfs:`` ...);
``file_systems`` can name another way from a URI to a file system.

Listing is a Spark job in rounds.  A round deals the directories left to its
tasks; a task walks down from each until it has seen ``LIST_BUDGET`` entries
and hands the directories it did not open to the next round.  So a small tree
is one round, a large one spreads over all tasks, and the driver never sees a
list of files.  Ignored and hidden directories are not entered, and only
reviewable names are kept.

Reading deals the files by path, so the files of one flat folder are read by
many tasks, in batches of about ``BATCH_BYTES``.  What cannot be listed or
read is a row with an ``error`` and no text.  Binary sniffing (NUL in the first
8 KiB) and the utf-8 -> cp1252 -> latin-1 decode chain are JVM expressions
(``decode_text``); Python only does file I/O.  Spark's own file sources are not
used: they drop every path part that starts with ``_`` or ``.``
(``__init__.py``, ``.eslintrc.json``).

One folder's own entries are listed by one task (names only), and one file is
one row, so a file beyond ``FILE_BYTES`` is an error row.
"""

from __future__ import annotations

import os
import posixpath
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.functions import constants as K
from revlens.functions import text as X
from revlens.plans.session import materialized, shuffle_partitions

#: (URI) -> (file system, path on it)
FileSystems = Callable[[str], tuple[pafs.FileSystem, str]]
#: (file or folder name) -> whether it is listed or entered
Names = Callable[[str], bool]

LIST_BUDGET = 20_000
BATCH_BYTES = 32 << 20
FILE_BYTES = 1 << 30
PARTITION_BYTES = 128 << 20

# cp1252 differs from latin-1 on 0x80-0x9F; five of those bytes are
# undefined in cp1252.  Built from the codec itself (a rule, not a table).
_C1 = [bytes([b]) for b in range(0x80, 0xA0)]


def _cp1252(b: bytes) -> str | None:
    try:
        return b.decode("cp1252")
    except UnicodeDecodeError:
        return None


_PAIRS = [(b.decode("latin-1"), _cp1252(b)) for b in _C1]
LATIN1_FROM = "".join(a for a, c in _PAIRS if c is not None)
CP1252_TO = "".join(c for a, c in _PAIRS if c is not None)
CP1252_UNDEFINED = "".join(a for a, c in _PAIRS if c is None)


def is_binary(content: Column) -> Column:
    """A NUL byte in the first 8,192 bytes."""
    return F.contains(F.substring(content, 1, 8192), F.lit(bytearray(b"\x00")))


def decode_text(content: Column) -> Column:
    """Utf-8 if valid (a BOM is kept, as Python's utf-8 does), else
    cp1252 unless the bytes hold one of its five undefined values, else
    latin-1 (never fails)."""
    utf8 = F.try_validate_utf8(content.cast("string"))
    l1 = F.decode(content, "ISO-8859-1")
    undefined = l1.rlike("[" + "".join(f"\\x{{{ord(c):02x}}}" for c in CP1252_UNDEFINED) + "]")
    return F.coalesce(utf8, F.when(undefined, l1).otherwise(F.translate(l1, LATIN1_FROM, CP1252_TO)))


def _keep_name(name: str) -> bool:
    if name in K.IGNORE_FILES:
        return False
    i = name.rfind(".")
    sfx = name[i:].lower() if 0 < i < len(name) - 1 else ""
    return sfx in K.TEXT_EXTENSIONS or name in K.SPECIAL_FILE_NAMES


def _keep_dir(name: str) -> bool:
    return name not in K.IGNORE_DIRS and not name.startswith(".")


def open_file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a local path or a URI; ``file:/x`` as Hadoop
    writes it is the local ``/x``."""
    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    if "://" in uri:
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), os.path.abspath(uri)


def _is_link(fs: pafs.FileSystem, path: str) -> bool:
    """A link to a directory is not entered (it may lead back up)."""
    return fs.type_name == "local" and os.path.islink(path)


def _unseen(fs: pafs.FileSystem, at: str, infos: list[pafs.FileInfo], keep_name: Names) -> list[str]:
    """Names to keep of a local folder that its listing leaves out."""
    if fs.type_name != "local":
        return []
    return sorted(n for n in set(os.listdir(at)) - {posixpath.basename(i.path) for i in infos} if keep_name(n))


_ENTRY = "project string, root string, path string, relative string, size bigint, kind string, error string"
_ENTRY_NAMES = [c.split()[0] for c in _ENTRY.split(", ")]
_ENTRY_ARROW = pa.schema([(n, pa.int64() if n == "size" else pa.string()) for n in _ENTRY_NAMES])


def _lister(file_systems: FileSystems, budget: int, keep_name: Names, keep_dir: Names):
    """Walks down from the directories of a task; kind is file, dir (left to
    the next round) or error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[str, tuple[pafs.FileSystem, str]] = {}
        for b in batches:
            for r in b.to_pylist():
                project, root = r["project"], r["root"]
                if root not in opened:
                    opened[root] = file_systems(root)
                fs, top = opened[root]
                out, left, seen = [], [r["path"] or top], 0

                def entry(path: str, kind: str, size: int | None = None, error: str | None = None) -> None:
                    out.append((project, root, path, posixpath.relpath(path, top), size, kind, error))

                while left and seen < budget:
                    at = left.pop()
                    try:
                        infos = fs.get_file_info(pafs.FileSelector(at, recursive=False))
                    except OSError as e:
                        entry(at, "error", error=f"not listed: {e}")
                        continue
                    seen += max(1, len(infos))
                    for name in _unseen(fs, at, infos, keep_name):
                        entry(posixpath.join(at, name), "error", error="not listed: a link to nothing")
                    for i in infos:
                        name = posixpath.basename(i.path)
                        if i.type == pafs.FileType.Directory:
                            if keep_dir(name) and not _is_link(fs, i.path):
                                left.append(i.path)
                        elif keep_name(name):
                            known = i.type == pafs.FileType.File
                            entry(i.path, "file" if known else "error", i.size, None if known else "not a readable file")
                for path in left:
                    entry(path, "dir")
                for lo in range(0, len(out), 10_000):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t.type) for c, t in zip(zip(*out[lo:lo + 10_000]), _ENTRY_ARROW)], schema=_ENTRY_ARROW)

    return run


def list_trees(roots: DataFrame, file_systems: FileSystems = open_file_system, budget: int = LIST_BUDGET,
               keep_name: Names = _keep_name, keep_dir: Names = _keep_dir) -> DataFrame:
    """Files and errors below the roots (project, root): columns project,
    root, path, relative, size, error."""
    n = shuffle_partitions(roots.sparkSession)
    frontier = roots.select("project", "root", F.lit(None).cast("string").alias("path"))
    found: DataFrame | None = None
    while True:
        level = materialized(frontier.repartition(n, "root", "path").mapInArrow(_lister(file_systems, budget, keep_name, keep_dir), _ENTRY), "tree-level")
        here = level.where("kind <> 'dir'").drop("kind")
        found = here if found is None else found.unionByName(here)
        frontier = level.where("kind = 'dir'").select("project", "root", "path")
        if frontier.isEmpty():
            return found


def _reader(file_systems: FileSystems, batch_bytes: int):
    schema = pa.schema([*[f for f in _ENTRY_ARROW if f.name != "kind"], ("content", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[str, tuple[pafs.FileSystem, str]] = {}
        out, held = [], 0
        for b in batches:
            for r in b.to_pylist():
                if r["error"] is None and (r["size"] or 0) > FILE_BYTES:
                    r["error"] = f"larger than {FILE_BYTES} bytes"
                if r["error"] is None:
                    try:
                        if r["root"] not in opened:
                            if len(opened) >= 256:
                                opened.clear()
                            opened[r["root"]] = file_systems(r["root"])
                        fs, top = opened[r["root"]]
                        with fs.open_input_stream(posixpath.join(top, r["relative"]), compression=None) as f:
                            r["content"] = f.read()
                        r["size"] = len(r["content"])
                    except OSError as e:
                        r["error"] = f"not read: {e}"
                out.append(r)
                held += len(r.get("content") or b"")
                if held >= batch_bytes or len(out) >= 4096:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out, held = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def read_contents(listed: DataFrame, file_systems: FileSystems = open_file_system, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """Listed files with their bytes (content), dealt to tasks by path."""
    total = int(listed.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0])
    n = max(shuffle_partitions(listed.sparkSession), -(-total // partition_bytes))
    return (listed.repartition(n, "path")
            .mapInArrow(_reader(file_systems, BATCH_BYTES), _ENTRY.replace("kind string, ", "") + ", content binary"))


def read_files(listed: DataFrame, file_systems: FileSystems = open_file_system, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """Listed files read and decoded -> project, path, relative, name, ext,
    size, lines, tokens, text, error.  Binary files are dropped; an error row
    has no text, lines and tokens."""
    raw = read_contents(listed, file_systems, partition_bytes)
    txt = raw.where(F.col("error").isNotNull() | ~is_binary(F.col("content"))).select(
        "project", "path", "relative", "size", decode_text(F.col("content")).alias("text"), "error")
    name = X.file_name(F.col("relative"))
    return txt.select("project", "path", "relative", name.alias("name"), X.suffix(name).alias("ext"), "size",
                      X.file_loc("text").alias("lines"),
                      F.when(F.col("text").isNotNull(), X.token_estimate("text")).alias("tokens"), "text", "error")


def scan_trees(roots: DataFrame, file_systems: FileSystems = open_file_system, budget: int = LIST_BUDGET,
               partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """A1 over a table of roots (project, root)."""
    return read_files(list_trees(roots, file_systems, budget), file_systems, partition_bytes)


def scan_corpus(spark: SparkSession, roots: list[str] | str, file_systems: FileSystems = open_file_system,
                budget: int = LIST_BUDGET, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """A1: recursive scan of one or more roots -> files table, one row a
    reviewable file; a project is named as its root folder."""
    roots = [roots] if isinstance(roots, str) else list(roots)
    named = [(posixpath.basename(r.rstrip("/")), r) for r in roots]
    return scan_trees(spark.createDataFrame(named, "project string, root string"), file_systems, budget, partition_bytes)


def read_paths(paths: DataFrame, file_systems: FileSystems = open_file_system) -> DataFrame:
    """A2 over a table of files (path): project = the parent folder.  A name
    that is not reviewable is an error row, so is a file that is missing."""
    path = F.regexp_replace("path", "/+$", "")
    root, name = F.regexp_extract(path, "^(.*)/[^/]*$", 1), F.regexp_extract(path, "([^/]*)$", 1)
    fit = (F.lower(X.suffix(name)).isin(*K.TEXT_EXTENSIONS) | name.isin(*K.SPECIAL_FILE_NAMES)) & ~name.isin(*K.IGNORE_FILES)
    return read_files(paths.select(
        F.regexp_extract(root, "([^/]*)$", 1).alias("project"), F.when(root == "", F.lit("/")).otherwise(root).alias("root"),
        path.alias("path"), name.alias("relative"), F.lit(None).cast("bigint").alias("size"),
        F.when(~fit, F.concat(F.lit("not a reviewable name: "), name)).alias("error")), file_systems)


def scan_file(spark: SparkSession, path: str, file_systems: FileSystems = open_file_system) -> DataFrame:
    """A2: one file.  Raises ``ValueError`` for a name that is not reviewable,
    for a missing or unreadable file and for one that is not text."""
    df = read_paths(spark.createDataFrame([(path,)], "path string"), file_systems)
    row = df.select("error").first()
    if row is None:
        raise ValueError(f"{path} holds binary data")
    if row["error"]:
        raise ValueError(f"{path}: {row['error']}")
    return df


def readable(files: DataFrame) -> DataFrame:
    """The rows of a scan that have a text."""
    return files.where(F.col("error").isNull())


def write_tree(files: DataFrame, root: str, file_systems: FileSystems = open_file_system) -> None:
    """Write a (project, relative, text) table out as a source tree
    ``root/<project>/<relative>`` (UTF-8), each partition by its task.  Used to
    turn table corpora into trees for the scan; ``root`` must be a folder
    every executor reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_systems(root)
        made: set[str] = set()
        for b in batches:
            for r in b.to_pylist():
                path = posixpath.join(base, r["project"], r["relative"])
                folder = posixpath.dirname(path)
                if folder not in made:
                    fs.create_dir(folder, recursive=True)
                    made.add(folder)
                with fs.open_output_stream(path, compression=None) as f:
                    f.write((r["text"] or "").encode())
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})

    files.select("project", "relative", "text").mapInArrow(run, "n bigint").agg(F.sum("n")).first()
