"""Media columns in archives, read by byte range (operator 4)."""

from __future__ import annotations

import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from brindle.llm.common import new_path

FORMAT = "media_archives"
SCHEMA = "doc_id long, archive string, offset long, media binary, error string"
SIDE = 64
#: The signature that starts each PNG file (fixed value).
PNG = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def padded(text: bytes) -> bytes:
    """text and bytes 0, up to a positive multiple of 64."""
    return text + bytes(-len(text) % SIDE or (0 if text else SIDE))


def to_png(text: bytes) -> bytes:
    """A grey 8-bit image, 64 samples wide, of the padded text; its comment holds the length of text."""
    rows = np.frombuffer(padded(text), np.uint8).reshape(-1, SIDE)
    lines = np.zeros((len(rows), SIDE + 1), np.uint8)
    lines[:, 1:] = rows
    packed = zlib.compress(lines.tobytes(), 1)
    head = _chunk(b"IHDR", struct.pack(">IIBBBBB", SIDE, len(rows), 8, 0, 0, 0, 0))
    body = b"".join(_chunk(b"IDAT", packed[i : i + 2**30]) for i in range(0, len(packed), 2**30))
    return PNG + head + _chunk(b"tEXt", b"n_bytes\0%d" % len(text)) + body + _chunk(b"IEND", b"")


def from_png(media: bytes) -> tuple[bytes, int]:
    """The samples and the unpadded length that `to_png` stored; ValueError if a checksum doesn't hold."""
    if media[:8] != PNG:
        raise ValueError("not a PNG")
    at, packed, n = 8, [], 0
    while at < len(media):
        size = struct.unpack_from(">I", media, at)[0]
        kind, data = media[at + 4 : at + 8], media[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", media, at + 8 + size)[0] != zlib.crc32(kind + data):
            raise ValueError("bad chunk")
        if kind == b"IDAT":
            packed.append(data)
        elif kind == b"tEXt" and data.startswith(b"n_bytes\0"):
            n = int(data[8:])
        at += size + 12
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(-1, SIDE + 1)
    return lines[:, 1:].tobytes(), n


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")


def _own_id(name: str) -> int | None:
    """The number that a member's file name is, without its extension; else null."""
    own = name.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    return int(own) if re.fullmatch(r"-?[0-9]{1,19}", own) and -(2**63) <= int(own) < 2**63 else None


@dataclass
class Written(WriterCommitMessage):
    archives: list


@dataclass
class ByteRange(InputPartition):
    archive: str
    size: int
    start: int
    end: int

    def __init__(self, archive: str, size: int, start: int, end: int):
        self.archive, self.size, self.start, self.end = archive, size, start, end


class ArchiveWriter(DataSourceArrowWriter):
    """Each task attempt writes ZIP archives under names of its own; what the committed attempts wrote is listed in a manifest, and only that is read."""

    def __init__(self, options):
        self.path, self.most = options["path"], int(options.get("archivebytes", 64 << 20))

    def write(self, iterator):
        store, root = _opened(self.path)
        store.create_dir(root)
        done, archive, sink, name = [], None, None, ""

        def close():
            archive.close()
            done.append([name, sink.tell()])
            sink.close()

        for b in iterator:
            for doc_id, media in zip(b.column(0), b.column(1), strict=True):
                if archive is not None and sink.tell() > self.most:
                    close()
                    archive = None
                if archive is None:
                    name = f"{uuid.uuid4().hex}.zip"
                    sink, k = store.open_output_stream(f"{root}/{name}"), 0
                    archive = zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED)
                kind = "none" if media.as_py() is None else "png"
                archive.writestr(zipfile.ZipInfo(f"{k}/{'' if doc_id.as_py() is None else doc_id.as_py()}.{kind}"), media.as_py() or b"")
                k += 1
        if archive is not None:
            close()
        return Written(done)

    def commit(self, messages):
        store, root = _opened(self.path)
        store.create_dir(root)
        with store.open_output_stream(f"{root}/_manifest-{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps([x for m in messages if m for x in m.archives]).encode())

    def abort(self, messages):
        store, root = _opened(self.path)
        for m in messages:
            for name, _ in m.archives if m else ():
                store.delete_file(f"{root}/{name}")


class ArchiveReader(DataSourceReader):
    """A partition is a byte range of an archive: it reads the members that start there, each on its own, by offset, again if that fails. An archive that can't be opened gives one row with its error for each range.

    Archives are those of the manifests, so what failed attempts left doesn't count. A folder without a
    manifest was written by others: all its ZIP archives are read, those in folders below it too. An empty folder gives no rows.
    """

    def __init__(self, options):
        self.path, self.split = options["path"], int(options.get("splitbytes", 16 << 20))
        self.tries, self.batch = int(options.get("tries", 3)), int(options.get("batchbytes", 8 << 20))

    def partitions(self):
        store, root = _opened(self.path)
        manifests = [i.path for i in store.get_file_info(fs.FileSelector(root)) if i.base_name.startswith("_manifest-")]
        found = []
        for path in manifests:
            with store.open_input_stream(path) as f:
                found += [[f"{root}/{name}", size] for name, size in json.loads(f.read())]
        if not manifests:
            every = store.get_file_info(fs.FileSelector(root, recursive=True))
            found = [[i.path, i.size] for i in every if i.type == fs.FileType.File and i.extension.lower() == "zip"]
        ranges = [ByteRange(path, size, at, at + self.split) for path, size in sorted(found) for at in range(0, max(size, 1), self.split)]
        return ranges or [ByteRange("", 0, 0, 0)]

    def read(self, partition):
        if not partition.archive:
            return
        store, _ = _opened(self.path)
        archive, error = self.tried(lambda: zipfile.ZipFile(store.open_input_file(partition.archive)))
        if archive is None:
            yield self.rows([(None, partition.archive, partition.start, None, error)])
            return
        rows, held = [], 0
        for member in archive.infolist():
            if not partition.start <= member.header_offset < partition.end:
                continue
            if member.is_dir():
                continue
            media, error = self.tried(lambda m=member: archive.read(m), lambda m=member: self.anew(store, partition.archive, m))
            if member.filename.endswith(".none"):
                media = None
            rows.append((_own_id(member.filename), partition.archive, member.header_offset, media, error))
            held += len(media or b"")
            if held >= self.batch:
                yield self.rows(rows)
                rows, held = [], 0
        archive.close()
        if rows:
            yield self.rows(rows)

    @staticmethod
    def anew(store, name, member):
        with store.open_input_file(name) as f, zipfile.ZipFile(f) as again:
            return again.read(member)

    def tried(self, first, then=None):
        """(result, None) of the first try that works, or (None, error)."""
        error = ""
        for k in range(self.tries):
            try:
                return (first if k == 0 or then is None else then)(), None
            except (OSError, ValueError, RuntimeError, NotImplementedError, zipfile.BadZipFile, zlib.error) as e:
                error = f"{type(e).__name__}: {e}"
        return None, error

    @staticmethod
    def rows(rows):
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "archive", "offset", "media", "error"])


class MediaArchives(DataSource):
    """format("media_archives"): ZIP archives of media files in a folder that all tasks reach, by any URI that pyarrow opens."""

    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return ArchiveReader(self.options)

    def writer(self, schema, overwrite):
        return ArchiveWriter(self.options)


def write_archives(media: DataFrame, path: str) -> None:
    """Store media (doc_id, media) under path; a null medium comes back as null, without an error."""
    media.sparkSession.dataSource.register(MediaArchives)
    media.select("doc_id", "media").write.format(FORMAT).mode("append").save(path)


def read_archives(spark: SparkSession, path: str, **options) -> DataFrame:
    """(doc_id, archive, offset, media, error) of every member; an unreadable one has a null media and an error."""
    spark.dataSource.register(MediaArchives)
    return spark.read.format(FORMAT).options(**options).load(path)


def as_media(docs: DataFrame) -> DataFrame:
    """(doc_id, media): each whole text (null: empty) as a PNG."""

    def run(batches):
        for b in batches:
            media = [to_png(t.as_py() or b"") for t in b.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(media, pa.binary())], ["doc_id", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Digests and features of media (doc_id, media, and error if there is one): feature is the share of samples in sixteen bands, in thousandths.

    A null medium, or one that is no such PNG, gives nulls and an error. Equal
    media give equal rows; an empty table gives none.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())

    def made(doc_id, media, error):
        if media is None:
            return doc_id, *[None] * 7, error or "no medium"
        try:
            payload, n = from_png(media)
        except (ValueError, IndexError, struct.error, zlib.error) as e:
            return doc_id, *[None] * 7, f"{type(e).__name__}: {e}"
        bands = np.bincount(np.frombuffer(payload, np.uint8) >> 4, minlength=16) * 1000 // max(len(payload), 1)
        return doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-SIDE:]), len(media), hashlib.sha256(media).hexdigest(), "-".join(map(str, bands)), None

    def run(batches):
        for b in batches:
            rows = [made(i, m.as_py(), e) for i, m, e in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    error = F.col("error") if "error" in media.columns else F.lit(None).cast("string").alias("error")
    return media.select("doc_id", "media", error).mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string")


def stored_texts(docs: DataFrame) -> DataFrame:
    """Each text of docs stored as a medium in archives in the shared folder, read back, with digests and features. Null and empty texts are 64 bytes 0; long texts are stored whole; repeated rows are media of their own; further columns are left out. An empty table gives no rows."""
    spark = docs.sparkSession
    path = new_path(spark, "media")
    write_archives(as_media(docs), path)
    return media_features(read_archives(spark, path))
