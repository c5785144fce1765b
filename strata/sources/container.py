"""The container: a ZIP file of stored members, a gzipped JSON index and one Parquet file or image for each array.

The directory and the index are small and are read on the driver. A member is a Parquet file or image byte for byte, so an array
is read by staging that range into the folder all executors share and scanning it there.
"""

from __future__ import annotations

import gzip
import io
import json
import re
import shutil
import struct
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq

from .kinds import KINDS, Array, variant_of

INDEX = "index.json.gz"
#: What this library reads and writes.
VERSION = (2, 0)
_COMMENT = re.compile(r"(.+) (\d+)\.(\d+)(?:-(\S+))?")
ROW_GROUP = 1 << 20
#: Bytes copied at once.
BLOCK = 1 << 20


class ContainerError(ValueError):
    """The file isn't a container, or one that can't be read."""


class LimitExceeded(ContainerError):
    pass


class MemberMissing(ContainerError):
    def __init__(self, name: str):
        super().__init__(f"Error: missing archive member '{name}'")


@dataclass
class Limits:
    """None: no limit. JSON of exactly json_bytes is too long."""

    json_bytes: int | None = 1 << 20
    image_bytes: int | None = 16 << 30
    image_dim: int | None = None
    validation: int | None = 100


@dataclass(frozen=True)
class Member:
    name: str
    offset: int
    size: int


def parse_comment(comment: bytes) -> tuple[str, tuple[int, int], str | None]:
    """Format name, version and pre-release of a ZIP comment "<name> M.m[-pre]"."""
    try:
        m = _COMMENT.fullmatch(comment.decode())
    except UnicodeDecodeError:
        m = None
    if not m:
        raise ContainerError(f"Error: the zip comment does not identify this as a project file: '{comment.decode(errors='replace')}'")
    return m[1], (int(m[2]), int(m[3])), m[4]


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if re.match(r"[a-z0-9]+://", path) else (pafs.LocalFileSystem(), path)


class Reader:
    """Reads a container at a local path or a URI that Arrow's file systems know."""

    def __init__(self, path: str, limits: Limits | None = None, accept_pre_release: Iterable[str] = ("beta.1",)):
        self.path, self.limits = path, limits or Limits()
        self._fs, self._at = _filesystem(path)
        try:
            with self._open() as f, zipfile.ZipFile(f) as z:
                infos, comment = z.infolist(), z.comment
                self.members = {i.filename: self._member(f, i) for i in infos}
        except (zipfile.BadZipFile, pa.ArrowInvalid) as e:
            raise ContainerError(f"Zip error: {e}") from e
        self.format_name, self.version, self.pre_release = parse_comment(comment)
        if self.pre_release is not None and self.pre_release not in set(accept_pre_release):
            raise ContainerError(f"Version error: the file uses pre-release v{self.version[0]}.{self.version[1]}-{self.pre_release} and can't be loaded")
        if self.version > VERSION:
            raise ContainerError(f"Version error: the file uses v{self.version[0]}.{self.version[1]} but this library can only read 0.9 and 2.0")
        if INDEX not in self.members:
            raise MemberMissing(INDEX)

    def _open(self):
        return self._fs.open_input_file(self._at)

    @staticmethod
    def _member(f, info: zipfile.ZipInfo) -> Member:
        if info.compress_type != zipfile.ZIP_STORED:
            raise ContainerError(f"Zip error: member '{info.filename}' is compressed")
        f.seek(info.header_offset)
        head = f.read(30)
        name, extra = struct.unpack("<HH", head[26:30])
        return Member(info.filename, info.header_offset + 30 + name + extra, info.file_size)

    def member(self, name: str) -> Member:
        if name not in self.members:
            raise MemberMissing(name)
        return self.members[name]

    def blocks(self, name: str, step: int = 8 << 20) -> Iterator[bytes]:
        """The bytes of a member, piece by piece."""
        m = self.member(name)
        with self._open() as f:
            f.seek(m.offset)
            left = m.size
            while left:
                block = f.read(min(step, left))
                if not block:
                    raise ContainerError(f"member '{name}' is cut short")
                left -= len(block)
                yield block

    def bytes(self, name: str) -> bytes:
        return b"".join(self.blocks(name))

    def index(self) -> dict:
        """The JSON index, inflated up to the limit of bytes."""
        inflate, out = zlib.decompressobj(31), b""
        most = self.limits.json_bytes
        for block in self.blocks(INDEX):
            out += inflate.decompress(block) if most is None else inflate.decompress(block, max(1, most - len(out)))
            if most is not None and len(out) >= most:
                raise LimitExceeded("Error: safety limit exceeded")
        out += inflate.flush()
        if most is not None and len(out) >= most:
            raise LimitExceeded("Error: safety limit exceeded")
        return json.loads(out)

    def compressed_size(self, array: Array) -> int:
        return self.member(array.filename).size

    def parquet(self, array: Array) -> pq.ParquetFile:
        """The member's footer and, on demand, its pages."""
        m = self.member(array.filename)
        return pq.ParquetFile(pa.PythonFile(_Range(self._open(), m.offset, m.size), mode="r"))

    def variant(self, array: Array) -> str:
        """Which schema the array has, and that it is as long as the index says; the footer alone is read."""
        file = self.parquet(array)
        if file.metadata.num_rows != array.item_count:
            raise ContainerError(f"Data error: array length {array.item_count} does not match the declared length {file.metadata.num_rows}")
        return variant_of(array.kind, file)

    def stage(self, array: Array, folder: str) -> str:
        """Copies a member to a folder that all executors see; gives its path."""
        fs, at = _filesystem(folder)
        fs.create_dir(at)
        name = array.filename.replace("/", "_")
        with fs.open_output_stream(f"{at}/{name}") as out:
            for block in self.blocks(array.filename):
                out.write(block)
        return f"{folder}/{name}"


class _Range:
    """A window of a file, with the methods that Arrow needs of one."""

    def __init__(self, f, offset: int, size: int):
        self._f, self._offset, self._size, self._at, self.closed = f, offset, size, 0, False

    def read(self, n: int = -1) -> bytes:
        n = self._size - self._at if n is None or n < 0 else max(0, min(n, self._size - self._at))
        self._f.seek(self._offset + self._at)
        out = self._f.read(n)
        self._at += len(out)
        return out

    def seek(self, at: int, whence: int = 0) -> int:
        self._at = max(0, at + (0, self._at, self._size)[whence])
        return self._at

    def tell(self) -> int:
        return self._at

    def seekable(self) -> bool:
        return True

    def readable(self) -> bool:
        return True

    def size(self) -> int:
        return self._size

    def close(self) -> None:
        self.closed = True
        self._f.close()


_MAGIC = {"png": b"\x89PNG\r\n\x1a\n", "jpg": b"\xff\xd8\xff"}


def image_type(data: bytes) -> str:
    for name, magic in _MAGIC.items():
        if data.startswith(magic):
            return name
    raise ContainerError("Error: image is not in PNG or JPEG encoding")


@dataclass
class Writer:
    """Writes a container to a local path or, as a stream, to a URI that Arrow's file systems know. Members are numbered from 1; the index comes last."""

    path: str
    compression: int = 6
    format_name: str = "strata"
    pre_release: str | None = None
    _count: int = field(default=0, init=False)

    def __post_init__(self):
        self.compression = max(0, min(9, self.compression))
        self._fs, self._at = _filesystem(self.path)
        self._sink = open(self.path, "w+b") if isinstance(self._fs, pafs.LocalFileSystem) and self._at == self.path else self._fs.open_output_stream(self._at)
        self._zip = zipfile.ZipFile(self._sink, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.names: set[str] = set()

    def _next(self, ending: str) -> str:
        self._count += 1
        name = f"{self._count}.{ending}"
        self.names.add(name)
        return name

    def _copy(self, name: str, source: BinaryIO, head: bytes = b"") -> None:
        with self._zip.open(name, "w", force_zip64=True) as sink:
            sink.write(head)
            shutil.copyfileobj(source, sink, BLOCK)

    def image(self, data: bytes | BinaryIO) -> Array:
        """A PNG or JPEG image as it is; an open file is copied block by block."""
        source = io.BytesIO(data) if isinstance(data, bytes) else data
        head = source.read(8)
        name = self._next(image_type(head))
        self._copy(name, source, head)
        return Array("Image", name, 0)

    def parquet_bytes(self, kind: str, data: bytes | BinaryIO) -> Array:
        """A Parquet file as it is, if it has one of the kind's schemas; an open file, which must allow seeking, is copied block by block."""
        source = io.BytesIO(data) if isinstance(data, bytes) else data
        size = source.seek(0, io.SEEK_END)
        ends = []
        for at in (0, max(0, size - 4)):
            source.seek(at)
            ends.append(source.read(4))
        if size < 8 or ends != [b"PAR1", b"PAR1"]:
            raise ContainerError("Error: array is not in Parquet encoding")
        source.seek(0)
        file = pq.ParquetFile(source)
        variant_of(kind, file)
        rows = file.metadata.num_rows
        source.seek(0)
        name = self._next("parquet")
        self._copy(name, source)
        return Array(kind, name, rows)

    def batches(self, kind: str, variant: str, rows: Iterable[pa.RecordBatch | pa.Table]) -> Array:
        """Batches in order as one Parquet member, cast to the variant's schema where that loses nothing."""
        schema, name, n = KINDS[kind][variant], self._next("parquet"), 0
        options = {"version": "2.6", "data_page_version": "2.0", "use_dictionary": False, "write_statistics": True}
        codec = {"compression": "gzip", "compression_level": self.compression} if self.compression else {"compression": "none"}
        with self._zip.open(name, "w", force_zip64=True) as sink, pq.ParquetWriter(pa.PythonFile(sink, mode="w"), schema, **options, **codec) as out:
            held: list[pa.Table] = []
            size = 0
            for rows_ in rows:
                part = pa.Table.from_batches([rows_]) if isinstance(rows_, pa.RecordBatch) else rows_
                part = part.select(schema.names).cast(schema)
                held.append(part)
                size += part.num_rows
                while size >= ROW_GROUP:
                    whole = pa.concat_tables(held)
                    out.write_table(whole.slice(0, ROW_GROUP), row_group_size=ROW_GROUP)
                    held, size = [whole.slice(ROW_GROUP)], size - ROW_GROUP
                n += part.num_rows
            if size or not n:
                out.write_table(pa.concat_tables(held) if held else schema.empty_table())
        return Array(kind, name, n)

    def close(self, index: dict) -> None:
        """Writes the index and the version, and closes the file."""
        data = json.dumps(index, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()
        self._zip.writestr(INDEX, gzip.compress(data, self.compression))
        version = f"{VERSION[0]}.{VERSION[1]}" + (f"-{self.pre_release}" if self.pre_release else "")
        self._zip.comment = f"{self.format_name} {version}".encode()
        self._zip.close()
        self._sink.close()

    def cancel(self) -> None:
        """Gives up and deletes the file."""
        self._zip.close()
        self._sink.close()
        self._fs.delete_file(self._at)
