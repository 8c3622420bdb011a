"""Documents in a tree of folders, realm/domain/entity, as a data source of Spark's own kind.

``spark.read.format("document_tree").option("path", root)`` has its tasks list the folders that the filters allow and read
their files; only realms and domains are listed, and entities counted, before.  ``save()`` or ``df.write.format("document_tree").option("path", root).mode("append").save()`` adds a version of each document.
Roots may be in any store that pyarrow opens: file:, hdfs:, s3: and others.

A version is a file of its own, named by its write; a write counts once its commit file is there, which is the last thing
that it makes.  So a write that fails, or a task that is tried again, leaves what was read before as it was.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote, unquote
from zlib import crc32

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from quorumlake.sources.tables import spread

SCHEMA = "realm_id string, domain_id string, entity_id string, name string, content string"
LEVELS = ("realm_id", "domain_id", "entity_id")
#: Folders of entities that a task reads, about, and tasks that share a domain at most, as each of them lists all its folders.
FOLDERS, SHARES = 1024, 16
#: Characters that a task holds before it passes them on, one document more at most.
HELD = 1 << 23
_COMMITS, _FILES = "_commits", "files"


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, with filters pushed into it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DocumentTree)


def save(docs: DataFrame, root: str) -> None:
    """Writes a version of each document, an entity's by one task, so that it makes the folder once."""
    spread(docs, *LEVELS).write.format("document_tree").option("path", root).mode("append").save()


def _opened(root: str) -> tuple[fs.FileSystem, str]:
    store, path = fs.FileSystem.from_uri(root) if re.match(r"[a-z0-9+.-]+:/", root) else (fs.LocalFileSystem(), root)
    return store, path.rstrip("/")


def _names(store: fs.FileSystem, path: str, folders: bool) -> Iterator[str]:
    """Names of a folder's folders or files, in no order; none of a missing one.  A local folder is read piece by piece."""
    if isinstance(store, fs.LocalFileSystem):
        if os.path.isdir(path):
            with os.scandir(path) as found:
                yield from (x.name for x in found if (x.is_dir() if folders else x.is_file()))
        return
    kind = fs.FileType.Directory if folders else fs.FileType.File
    yield from (x.base_name for x in store.get_file_info(fs.FileSelector(path, allow_not_found=True)) if x.type == kind)


def _children(store: fs.FileSystem, path: str, folders: bool) -> list[str]:
    return sorted(_names(store, path, folders))


@dataclass
class Files(InputPartition):
    """What one task reads: of each domain's folder the entities of one share, in versions of the given commits.

    Shares go by the names' hashes, so that no other write can move a folder from one to another.
    """

    root: str = ""
    committed: dict[str, int] = field(default_factory=dict)
    allowed: dict[str, set[str]] = field(default_factory=dict)
    domains: list[tuple[str, tuple[str, str], int, int]] = field(default_factory=list)

    @property
    def paths(self) -> Iterator[tuple[str, tuple[str, str, str, str]]]:
        """Paths of the files, each with its document's keys and name."""
        store, _ = _opened(self.root)
        names = self.allowed.get("name")
        for path, keys, share, shares in self.domains:
            asked = self.allowed.get(LEVELS[-1])
            entities = (quote(x, safe=" ") for x in asked) if asked is not None else _names(store, path, True)
            for entity in sorted(x for x in entities if shares == 1 or crc32(x.encode()) % shares == share):  # of a long listing only the share is held
                newest: dict[str, tuple[int, str]] = {}
                for x in _children(store, f"{path}/{entity}", False):
                    name, _, write = x.rpartition("@")
                    if write in self.committed and (names is None or unquote(name) in names):
                        newest[name] = max(newest.get(name, (-1, "")), (self.committed[write], x))
                yield from ((f"{path}/{entity}/{x}", (*keys, unquote(entity), unquote(name))) for name, (_, x) in sorted(newest.items()))


@dataclass
class Written(WriterCommitMessage):
    """How many files a task wrote, and the file that lists them."""

    n: int = 0
    listed: str = ""


class DocumentTree(DataSource):
    """The store's documents, each in its last committed version."""

    @classmethod
    def name(cls) -> str:
        return "document_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> TreeWriter:
        if overwrite:
            raise ValueError("versions are only added: use mode append")
        return TreeWriter(self.options["path"])


class TreeReader(DataSourceReader):
    """Lists no folder that a filter on realm_id, domain_id, entity_id or name rules out."""

    def __init__(self, root: str):
        self.root = root
        self.allowed: dict[str, set[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            column = f.attribute[0] if values is not None and len(f.attribute) == 1 else None
            if column in (*LEVELS, "name") and all(isinstance(v, str) for v in values):
                self.allowed[column] = self.allowed.get(column, values) & values
            else:
                yield f

    def partitions(self) -> list[Files]:
        store, root = _opened(self.root)
        committed = {c: i for i, c in enumerate(_children(store, f"{root}/{_COMMITS}", False))}
        found = [(root, ())]
        for level in LEVELS[:-1]:
            allowed = self.allowed.get(level)
            found = [(f"{path}/{x}", (*keys, unquote(x))) for path, keys in found for x in _children(store, path, True) if x != _COMMITS and (allowed is None or unquote(x) in allowed)]
        out, some, size = [], [], 0
        for path, keys in found:
            asked = self.allowed.get(LEVELS[-1])
            n = len(asked) if asked is not None else sum(1 for _ in _names(store, path, True))
            shares = min(SHARES, -(-n // FOLDERS)) or 1
            for share in range(shares):
                if some and size + n / shares > FOLDERS:
                    out.append(some)
                    some, size = [], 0
                some, size = [*some, (path, keys, share, shares)], size + n / shares
        return [Files(self.root, committed, self.allowed, x) for x in (*out, some)]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = _opened(self.root)
        schema = pa.schema([(c, pa.string()) for c in (*LEVELS, "name", "content")])
        rows, held = [], 0
        for path, keys in partition.paths:
            with store.open_input_stream(path) as f:
                body = f.read().decode()
            rows.append(dict(zip(schema.names, (*keys, body), strict=True)))
            held += len(body)
            if held > HELD:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


class TreeWriter(DataSourceWriter):
    """Each task writes its documents beside the earlier versions; the commit file makes them count, all at once."""

    def __init__(self, root: str):
        self.root = root
        store, path = _opened(root)
        # commits are read in the order of their names, so a write that begins later counts for more
        last = _children(store, f"{path}/{_COMMITS}", False)
        self.write_id = f"{int(last[-1].split('-')[0]) + 1 if last else 0:012d}-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Written:
        store, root = _opened(self.root)
        done: dict[str, None] = {}
        made: set[str] = set()
        for row in iterator:
            keys = [row[c] for c in LEVELS]
            if any(not k or k in (".", "..") for k in (*keys, row["name"])):
                raise ValueError(f"a document needs realm, domain, entity and name: {keys}, {row['name']}")
            folder = "/".join([root, *(quote(k, safe=" ") for k in keys)])
            if folder not in made:
                store.create_dir(folder, recursive=True)
                made.add(folder)
            path = f"{folder}/{quote(row['name'], safe=' ')}@{self.write_id}"
            with store.open_output_stream(path) as f:
                f.write((row["content"] or "").encode())
            done[path] = None
        if not done:
            return Written()
        folder = f"{root}/{_COMMITS}/{_FILES}/{self.write_id}"
        store.create_dir(folder, recursive=True)
        listed = f"{folder}/{uuid.uuid4().hex}"
        with store.open_output_stream(listed) as f:
            f.write("\n".join(done).encode())
        return Written(len(done), listed)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _opened(self.root)
        store.create_dir(f"{root}/{_COMMITS}", recursive=True)
        with store.open_output_stream(f"{root}/{_COMMITS}/{self.write_id}") as f:
            f.write(str(sum(m.n for m in messages if m)).encode())

    def abort(self, messages: list[Written | None]) -> None:
        store, _ = _opened(self.root)
        for m in messages:
            if not m or not m.listed:
                continue
            with store.open_input_stream(m.listed) as f:
                paths = f.read().decode().split("\n")
            for path in (*paths, m.listed):
                if store.get_file_info(path).type == fs.FileType.File:
                    store.delete_file(path)
