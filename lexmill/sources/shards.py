"""Shards and packs: canonical JSON in deterministic gzip files with descriptors, versions, manifests, checked reading.

Records are rows (key, json). Shards are cut by a fold over the records in order of UTF-16 units, range by range with a carry
(operators/ranges.py), and written by the tasks that hold them.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..functions.text import fold, utf16_key
from ..operators.ranges import Cut, cut_pieces

#: Bytes of JSON from which a shard ends at the next change of prefix, and that it never passes.
TARGET, HARD = 192 * 1024, 256 * 1024
DESCRIPTOR = "id string, path string, kind string, first string, last string, entries long, bytes long, rawBytes long, sha256 string"


def canonical(value: object) -> bytes:
    """Keys in order, no blanks, UTF-8, no NaN."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False).encode()


def packed(data: bytes) -> bytes:
    """gzip without time and name: equal bytes give equal files."""
    out = io.BytesIO()
    with gzip.GzipFile(filename="", mode="wb", fileobj=out, compresslevel=9, mtime=0) as f:
        f.write(data)
    return out.getvalue()


def folding(by_prefix: bool) -> Cut:
    """Where shards end: with prefixes, before a record that would pass HARD or, from TARGET bytes on, at a change of prefix (the first two
    characters of the folded key); without, before a record that would pass TARGET."""
    return Cut(TARGET, HARD) if by_prefix else Cut(None, TARGET)


def sharded(records: DataFrame, by_prefix: bool = True) -> DataFrame:
    """records (key, json) with `piece`, the number of its shard: as one fold over all records in order of UTF-16 units cuts them."""
    prefix = F.substring(fold(F.lower("key")), 1, 2) if by_prefix else None
    r = records.select("key", "json")
    return cut_pieces(r, folding(by_prefix), F.octet_length("json"), prefix, utf16_key(F.col("key")), F.col("json"), bare=int(by_prefix))


def write_shards(records: DataFrame, root: str, kind: str, by_prefix: bool = True) -> DataFrame:
    """Descriptors of the files written under root/kind: each a JSON array of a shard's records."""
    records.sparkSession.dataSource.register(ShardSink)
    rows, job = sharded(records, by_prefix).select("key", "json", "piece"), uuid.uuid4().hex
    rows.write.format(ShardSink.name()).mode("append").options(root=root, kind=kind, job=job).save()
    return records.sparkSession.read.schema(DESCRIPTOR).json(f"{root}/{kind}/{COMMITTED}/{job}")


#: The folder of the descriptors of committed writes.
COMMITTED = "descriptors"


class ShardSink(DataSource):
    """Batch sink `lexical_shards` for rows (key, json, piece) that come sorted by piece: options root, kind and job, a name of this write.

    A task streams over its rows, holds one shard, and writes it under a name of its own that is then moved in place; a file
    that is there already must have the same bytes. Its descriptors go to a file that only the commit makes visible, for
    the attempts that Spark has chosen: what a lost or doubled attempt has left is in no descriptor.
    """

    @classmethod
    def name(cls) -> str:
        return "lexical_shards"

    def schema(self) -> str:
        return "key string, json string, piece long"

    def writer(self, schema, overwrite: bool) -> "ShardWriter":
        return ShardWriter(self.options["root"], self.options["kind"], self.options["job"])


class ShardWriter(DataSourceArrowWriter):
    def __init__(self, root: str, kind: str, job: str):
        self.root, self.kind, self.job = root.rstrip("/"), kind, job

    def _folder(self, name: str) -> tuple[pa.fs.FileSystem, str]:
        return pa.fs.FileSystem.from_uri(f"{self.root}/{self.kind}" + (f"/{name}" if name else ""))

    def write(self, batches: Iterator[pa.RecordBatch]) -> "Written":
        store, folder = self._folder("")
        store.create_dir(folder, recursive=True)
        found, piece, items = [], None, []
        for b in batches:
            for key, text, n in zip(b.column("key").to_pylist(), b.column("json").to_pylist(), b.column("piece").to_pylist(), strict=True):
                if items and n != piece:
                    found.append(self._put(store, folder, piece, items))
                    items = []
                piece = n
                items.append((key, text))
        if items:
            found.append(self._put(store, folder, piece, items))
        name = f"{uuid.uuid4().hex}.json" if found else ""
        if found:
            self._write(store, f"{folder}/_{self.job}", name, b"".join(canonical(x) + b"\n" for x in found))
        return Written(name)

    def _write(self, store: pa.fs.FileSystem, folder: str, name: str, data: bytes) -> None:
        store.create_dir(folder, recursive=True)
        with store.open_output_stream(f"{folder}/{name}", compression=None) as f:
            f.write(data)

    def _put(self, store: pa.fs.FileSystem, folder: str, piece: int, items: list[tuple[str, str]]) -> dict:
        raw = b"[" + b",".join(text.encode() for _, text in items) + b"]"
        data, i = packed(raw), f"{self.kind}-{piece:04d}"
        place = f"{folder}/{i}.json.gz"
        if store.get_file_info(place).type == pa.fs.FileType.File:
            with store.open_input_stream(place, compression=None) as f:
                if f.read() != data:
                    raise ValueError(f"refusing to change an immutable output: {place}")
        else:
            own = f".{i}.{uuid.uuid4().hex}"
            self._write(store, folder, own, data)
            store.move(f"{folder}/{own}", place)
        return {"id": i, "path": f"{self.root}/{self.kind}/{i}.json.gz", "kind": self.kind, "first": items[0][0], "last": items[-1][0], "entries": len(items), "bytes": len(data), "rawBytes": len(raw), "sha256": hashlib.sha256(data).hexdigest()}

    def commit(self, messages) -> None:
        store, folder = self._folder("")
        done = f"{folder}/{COMMITTED}/{self.job}"
        store.create_dir(done, recursive=True)
        for m in messages:
            if m and m.name:
                store.move(f"{folder}/_{self.job}/{m.name}", f"{done}/{m.name}")
        self._forget(store, folder)

    def abort(self, messages) -> None:
        self._forget(*self._folder(""))

    def _forget(self, store: pa.fs.FileSystem, folder: str) -> None:
        if store.get_file_info(f"{folder}/_{self.job}").type == pa.fs.FileType.Directory:
            store.delete_dir(f"{folder}/_{self.job}")


@dataclass
class Written(WriterCommitMessage):
    """The name of a task's file of descriptors, empty if it had no rows."""

    name: str


#: Records that a single file holds at most.
PACK_ROWS = 100_000


def write_pack(records: DataFrame, root: str, kind: str, name: str) -> dict:
    """The descriptor of one file with all records, at most PACK_ROWS (the core); larger tables go to write_shards()."""
    rows = records.select("key", "json").limit(PACK_ROWS + 1).collect()
    if len(rows) > PACK_ROWS:
        raise ValueError(f"more than {PACK_ROWS} records for one file: {name}")
    rows.sort(key=lambda r: r.key.encode("utf-16-be", "surrogatepass"))
    raw = b"[" + b",".join(r.json.encode() for r in rows) + b"]"
    data = packed(raw)
    path = f"{root}/{kind}/{name}.json.gz"
    _HadoopFiles(root).put(path, data)
    return {"id": name, "path": path, "kind": kind, "first": rows[0].key if rows else "", "last": rows[-1].key if rows else "", "entries": len(rows), "bytes": len(data), "rawBytes": len(raw), "sha256": hashlib.sha256(data).hexdigest()}


class _HadoopFiles:
    """Files of any store that Spark reads; an existing file is never changed."""

    def __init__(self, root: str):
        spark = SparkSession.active()
        self.jvm, self.conf, self.root = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf(), root

    def _fs(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.conf)

    def put(self, path: str, data: bytes) -> None:
        p, fs = self._fs(path)
        if fs.exists(p):
            if self.get(path) != data:
                raise ValueError(f"refusing to change an immutable output: {path}")
            return
        temporary, _ = self._fs(path + ".tmp")
        out = fs.create(temporary, True)
        out.write(data)
        out.close()
        fs.rename(temporary, p)

    def get(self, path: str) -> bytes:
        p, fs = self._fs(path)
        stream = fs.open(p)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def rename(self, old: str, new: str) -> bool:
        (a, fs), (b, _) = self._fs(old), self._fs(new)
        return fs.rename(a, b)

    def exists(self, path: str) -> bool:
        p, fs = self._fs(path)
        return fs.exists(p)

    def delete(self, path: str) -> None:
        p, fs = self._fs(path)
        fs.delete(p, True)


def read_packs(spark: SparkSession, root: str, descriptors: DataFrame) -> DataFrame:
    """path, ordinal, json of every record; a path outside `root`, a missing file, another checksum or number of records is an error."""
    d = descriptors.select("path", "sha256", F.col("entries").cast("long").alias("entries"))
    paths = [r.path for r in d.select("path").toLocalIterator()]
    inside = root.rstrip("/") + "/"
    for p in paths:
        if not p.startswith(inside) or "/../" in p:
            raise ValueError(f"unsafe path: {p}")
    if not paths:
        return spark.createDataFrame([], "path string, ordinal int, json string")
    files = spark.read.format("binaryFile").load(paths).select(F.regexp_replace("path", "^file:/*", "/").alias("_p"), "content")
    met = d.withColumn("_p", F.regexp_replace("path", "^file:/*", "/")).join(files, "_p", "left")

    @F.pandas_udf("array<string>")
    def rows(content: pd.Series) -> pd.Series:
        return content.map(lambda c: None if c is None else [canonical(x).decode() for x in json.loads(gzip.decompress(c))])

    got = met.withColumn("rows", rows("content"))
    fault = F.when(F.col("content").isNull(), F.raise_error(F.concat(F.lit("missing: "), F.col("path")))).when(F.sha2("content", 256) != F.col("sha256"), F.raise_error(F.concat(F.lit("checksum mismatch: "), F.col("path")))).when(F.size("rows") != F.col("entries"), F.raise_error(F.concat(F.lit("row count mismatch: "), F.col("path"))))
    return got.withColumn("_f", fault.cast("boolean")).where("_f is null").select("path", F.posexplode("rows").alias("ordinal", "json"))


def version_id(material: dict) -> str:
    """The first 16 hex digits of the hash of what a version is made of."""
    return hashlib.sha256(canonical(material)).hexdigest()[:16]


#: What of a source is made public.
PUBLIC = ("id", "name", "url", "revision", "sha256", "archive", "license", "attribution", "modifications", "correspondingSource", "role")


def public_sources(sources: list[dict]) -> list[dict]:
    return [{k: s[k] for k in PUBLIC if k in s} for s in sources]


def manifest(version: str, sources: list[dict], descriptors: DataFrame, counts: dict[str, int]) -> dict:
    """The manifest of a version: public sources, counts, and descriptors by kind in order of their first key (their number is bounded
    by bytes / TARGET, a fraction of a percent of the records)."""
    kinds: dict[str, list[dict]] = {}
    for r in sorted(descriptors.collect(), key=lambda r: (r.kind, r.first.encode("utf-16-be", "surrogatepass"))):
        kinds.setdefault(r.kind, []).append(r.asDict())
    return {"schemaVersion": 1, "dataVersion": version, "sources": public_sources(sources), **counts, **kinds}


def bound_manifest(found: dict, base_version: str) -> dict:
    """A search manifest, if it is of the known schema and for this base version."""
    if found.get("schemaVersion") != 1 or found.get("baseDataVersion") != base_version:
        raise ValueError("the search manifest does not match the base version")
    return found


def with_manifest(read, action):
    """action(manifest), once more with the manifest read anew if a shard that it names is gone. action must run its job."""
    try:
        return action(read())
    except (PySparkException, FileNotFoundError) as e:
        if not gone(e):
            raise
        return action(read())


def gone(e: Exception) -> bool:
    """Whether a read failed since a file or folder is not there."""
    marks = ("PATH_NOT_FOUND", "FILE_NOT_EXIST", "missing: ", "FileNotFoundException")
    return isinstance(e, FileNotFoundError) or any(m in str(e) for m in marks)


def publish(staging: str, target: str) -> None:
    """staging becomes target; an older target stays until the new one is in place and comes back if that fails."""
    files = _HadoopFiles(target)
    old = target + ".old"
    had = files.exists(target)
    if had and not files.rename(target, old):
        raise OSError(f"cannot move {target}")
    if not files.rename(staging, target):
        if had:
            files.rename(old, target)
        raise OSError(f"cannot publish {staging}")
    if had:
        files.delete(old)


def first_existing(*columns: Column) -> Column:
    """The first table that answers: memory before store before source, as columns of one join."""
    return F.coalesce(*columns)


def groups(rows: DataFrame, root: str, order: list[str], size: int = 5000) -> str:
    """rows in order, as files of at most `size` JSON lines; an existing output is an error."""
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("errorifexists").option("maxRecordsPerFile", size).option("compression", "gzip").json(root)
    return root
