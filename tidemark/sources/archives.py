"""Archives of CSV shards, recognised by content."""

from __future__ import annotations

import csv
import io
import zipfile
import zlib
from collections.abc import Iterator, Mapping
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.tasks import by_value
from tidemark.operators.clean import RAW_KEYS, last_occurrence

# The text encoding of the official shards and their header mapping.
SHARD_ENCODING = "gbk"
SHARD_HEADERS = {"监测时间": "time_d", "实时水位": "up_water_level", "主键": "z_id"}

_ROWS = "_file string, _member_no int, _member string, _pos bigint, z_id string, time_d string, up_water_level string"
_MEMBERS = "_file string, _member_no int, _member string, method int, crc bigint, content binary"
_BATCH = 20_000
_CHUNK = 1 << 16

#: ZIP's codes of a stored and a deflated member, and the length of a local header before its names.
STORED, DEFLATED, HEADER = 0, 8, 30


def _members(path: str, content: bytes) -> Iterator[tuple]:
    """The CSV members of an archive, still compressed; a file that is no archive is its own member."""
    if not zipfile.is_zipfile(io.BytesIO(content)):
        yield path, 0, path.rsplit("/", 1)[-1], STORED, None, content
        return
    shards = [i for i in zipfile.ZipFile(io.BytesIO(content)).infolist() if not i.is_dir() and i.filename.lower().endswith(".csv")]
    if not shards:
        raise ValueError(f"{path} contains no CSV shard")
    for number, info in enumerate(shards):
        if info.flag_bits & 1 or info.compress_type not in (STORED, DEFLATED):
            raise ValueError(f"{path}!{info.filename} is encrypted or packed in an unknown way")
        names = sum(int.from_bytes(content[info.header_offset + at : info.header_offset + at + 2], "little") for at in (26, 28))
        begin = info.header_offset + HEADER + names
        yield path, number, info.filename, info.compress_type, info.CRC, content[begin : begin + info.compress_size]


class _Inflated(io.RawIOBase):
    """A member's bytes, unpacked while they are read and checked at the end."""

    def __init__(self, name: str, method: int, crc: int | None, content: bytes):
        self.name_, self.content, self.crc, self.seen, self.at, self.held = name, content, crc, 0, 0, b""
        self.unpack = zlib.decompressobj(-zlib.MAX_WBITS) if method == DEFLATED else None

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while not self.held and self.at < len(self.content):
            part = self.content[self.at : self.at + _CHUNK]
            self.at += len(part)
            self.held = self.unpack.decompress(part) if self.unpack else part
        taken = self.held[: len(buffer)]
        buffer[: len(taken)] = taken
        self.held = self.held[len(taken) :]
        self.seen = zlib.crc32(taken, self.seen)
        if not taken and self.crc is not None and self.seen != self.crc:
            raise ValueError(f"{self.name_} is damaged")
        return len(taken)


def _shard_rows(file: str, number: int, name: str, stream: io.RawIOBase, encoding: str, mapping: Mapping[str, str]) -> Iterator[tuple]:
    """Mapped rows of a member; a shard that lacks a required key is an error."""
    text = io.TextIOWrapper(io.BufferedReader(stream, _CHUNK), encoding=encoding, errors="strict", newline="")
    reader = csv.DictReader(text)
    targets = {h: mapping.get(str(h).strip().strip('"').strip()) for h in reader.fieldnames or []}
    absent = [k for k in RAW_KEYS if k not in targets.values()]
    if absent:
        raise ValueError(f"{file}!{name} is missing required column(s): {', '.join(absent)}")
    source = {target: header for header, target in targets.items() if target}
    for position, row in enumerate(reader):
        yield (file, number, name, position, *[row.get(source[k]) for k in RAW_KEYS])


def unpack_shards(
    archives: DataFrame, *, encoding: str = SHARD_ENCODING, mapping: Mapping[str, str] = SHARD_HEADERS
) -> DataFrame:
    """Rows of all shards of a table of archives (``path``, ``content``), in text, with their position.

    An archive is cut at its directory into members, which travel compressed to tasks of their own, so
    unpacking and decoding one large archive is many tasks. A member is read as a stream and handed on in batches.
    Undecodable bytes and members with a wrong check sum fail instead of being replaced.
    """
    headers = dict(mapping)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [part.split()[0] for part in _MEMBERS.split(", ")]
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"]):
                for member in _members(file, content):
                    yield pd.DataFrame([member], columns=names)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [part.split()[0] for part in _ROWS.split(", ")]
        for batch in batches:
            for file, number, name, method, crc, content in batch.itertuples(index=False):
                stream = _Inflated(f"{file}!{name}", method, None if pd.isna(crc) else int(crc), content)
                rows = _shard_rows(file, number, name, stream, encoding, headers)
                while pending := list(islice(rows, _BATCH)):
                    yield pd.DataFrame(pending, columns=names)

    members = archives.select("path", "content").mapInPandas(split, _MEMBERS)
    # A stated count: by their compressed bytes adaptive execution would put many members into one task.
    tasks = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return members.repartition(tasks, "_file", "_member_no").mapInPandas(decode, _ROWS)


def read_shards(
    spark: SparkSession,
    path: str,
    *,
    encoding: str = SHARD_ENCODING,
    mapping: Mapping[str, str] = SHARD_HEADERS,
) -> DataFrame:
    """Rows of all shards of all archives below ``path``; see ``unpack_shards``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return unpack_shards(files, encoding=encoding, mapping=mapping)


def pack_shards(
    rows: DataFrame, archive: str, member: str, *, encoding: str = SHARD_ENCODING, mapping: Mapping[str, str] = SHARD_HEADERS
) -> DataFrame:
    """A table of archives (``path``, ``content``) from rows in text: the columns ``archive`` and ``member`` name where each goes.

    Rows stand in the order of ``_pos``. An archive is made in one task, so ``archive`` must name groups of bounded size.
    """
    titles = {key: header for header, key in mapping.items()}

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as made:
            for name, part in group.sort_values([member, "_pos"]).groupby(member, sort=True):
                text = part[list(RAW_KEYS)].rename(columns=titles).to_csv(index=False, lineterminator="\n")
                made.writestr(str(name), text.encode(encoding))
        return pd.DataFrame({"path": [str(group[archive].iloc[0])], "content": [out.getvalue()]})

    return rows.select(archive, member, "_pos", *RAW_KEYS).groupBy(archive).applyInPandas(pack, "path string, content binary")


def read_extracted_shards(
    spark: SparkSession, path: str, *, encoding: str = SHARD_ENCODING
) -> DataFrame:
    """Extracted shards by the CSV reader itself.

    Encodings outside the built-in list need ``spark.sql.legacy.javaCharsets=true`` at session
    start.
    """
    return spark.read.option("header", True).option("encoding", encoding).csv(path)


def shard_position():
    """Order of shard rows: archive, member, line."""
    return F.struct("_file", "_member_no", "_pos")


def merged_shards(rows: DataFrame) -> DataFrame:
    """Shard rows with overlaps resolved per archive: the last occurrence of an id wins."""
    return last_occurrence(rows, shard_position(), ["_file"])


by_value(__name__)
