"""OSM PBF files as a Spark data source: a partition for each run of blobs, decoded in the tasks into Arrow batches.

    spark.dataSource.register(PbfSource)
    spark.read.format("osm_pbf").load(path)

The data source opens files that every executor can open.  ``read`` takes any other path through Spark's own readers:
files (a folder of extracts, say) go to tasks whole.  Rows are (type, id, tags, lon, lat, node_ids, members);
``frames`` decodes them once, stores them and splits them into the raw tables.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from geolith.functions import geo
from geolith.work import stored

SCHEMA = "type string, id bigint, tags map<string,string>, lon double, lat double, node_ids array<bigint>, members array<struct<type:string,id:bigint,role:string>>"


MEMBER = pa.struct([("type", pa.string()), ("id", pa.int64()), ("role", pa.string())])
ARROW = pa.schema([("type", pa.string()), ("id", pa.int64()), ("tags", pa.map_(pa.string(), pa.string())), ("lon", pa.float64()), ("lat", pa.float64()), ("node_ids", pa.list_(pa.int64())), ("members", pa.list_(MEMBER))])


def varint(raw: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        b = raw[at]
        at += 1
        out |= (b & 127) << shift
        if b < 128:
            return out, at
        shift += 7


def signed(n: int) -> int:
    return n >> 1 ^ -(n & 1)


def message(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field, number or bytes) of a protocol buffer message."""
    at = 0
    while at < len(raw):
        key, at = varint(raw, at)
        kind = key & 7
        if kind == 0:
            value, at = varint(raw, at)
        elif kind == 2:
            n, at = varint(raw, at)
            value, at = raw[at : at + n], at + n
        elif kind == 1:
            value, at = raw[at : at + 8], at + 8
        elif kind == 5:
            value, at = raw[at : at + 4], at + 4
        else:
            raise ValueError(f"wire type {kind}")
        yield key >> 3, value


def packed(raw: bytes) -> list[int]:
    out, at = [], 0
    while at < len(raw):
        n, at = varint(raw, at)
        out.append(n)
    return out


def running(raw: bytes) -> list[int]:
    out, total = [], 0
    for n in packed(raw):
        total += signed(n)
        out.append(total)
    return out


def as_signed64(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def blob_data(raw: bytes) -> bytes:
    plain = packed_data = b""
    for k, v in message(raw):
        if k == 1:
            plain = v
        elif k == 3:
            packed_data = v
        elif k in (4, 5, 6, 7):
            raise ValueError("only plain and zlib blobs can be read")
    return plain or zlib.decompress(packed_data)


def block_rows(raw: bytes) -> Iterator[tuple]:
    """The elements of a primitive block."""
    strings: list[str] = []
    groups, grain, lat0, lon0 = [], 100, 0, 0
    for k, v in message(raw):
        if k == 1:
            strings = [s.decode("utf-8", "replace") for _, s in message(v)]
        elif k == 2:
            groups.append(v)
        elif k == 17:
            grain = v
        elif k == 19:
            lat0 = as_signed64(v)
        elif k == 20:
            lon0 = as_signed64(v)

    def place(lat: int, lon: int) -> tuple[float, float]:
        return (lon0 + grain * lon) / 1e9, (lat0 + grain * lat) / 1e9

    for group in groups:
        for k, v in message(group):
            if k == 2:  # dense nodes
                own = {f: x for f, x in message(v)}
                kv, at = packed(own.get(10, b"")), 0
                for i, lat, lon in zip(running(own.get(1, b"")), running(own.get(8, b"")), running(own.get(9, b""))):
                    tags = {}
                    while at < len(kv) and kv[at]:
                        tags[strings[kv[at]]] = strings[kv[at + 1]]
                        at += 2
                    at += 1
                    yield ("N", i, tags, *place(lat, lon), None, None)
                continue
            own = {f: x for f, x in message(v)} if k in (1, 3, 4) else {}
            tags = {strings[a]: strings[b] for a, b in zip(packed(own.get(2, b"")), packed(own.get(3, b"")))}
            if k == 1:
                yield ("N", signed(own[1]), tags, *place(signed(own[8]), signed(own[9])), None, None)
            elif k == 3:
                yield ("W", own[1], tags, None, None, running(own.get(8, b"")), None)
            elif k == 4:
                roles, ids, kinds = packed(own.get(8, b"")), running(own.get(9, b"")), packed(own.get(10, b""))
                yield ("R", own[1], tags, None, None, None, [("NWR"[t], i, strings[r]) for r, i, t in zip(roles, ids, kinds)])


def block_batch(raw: bytes) -> pa.RecordBatch:
    """The elements of a primitive block, by columns."""
    columns = list(zip(*block_rows(raw))) or [()] * len(ARROW)
    tags = pa.array([list(t.items()) for t in columns[2]], ARROW.field("tags").type)
    members = pa.array([None if m is None else [dict(zip(("type", "id", "role"), x)) for x in m] for m in columns[6]], ARROW.field("members").type)
    arrays = [tags if f.name == "tags" else members if f.name == "members" else pa.array(c, f.type) for f, c in zip(ARROW, columns)]
    return pa.RecordBatch.from_arrays(arrays, schema=ARROW)


def header_of(raw: bytes) -> dict:
    """source, program, features and replication of a header block."""
    out: dict = {"required": [], "optional": []}
    for k, v in message(raw):
        if k == 4:
            out["required"].append(v.decode())
        elif k == 5:
            out["optional"].append(v.decode())
        elif k in (16, 17, 34):
            out[{16: "program", 17: "source", 34: "replication_url"}[k]] = v.decode()
        elif k in (32, 33):
            out[{32: "replication_timestamp", 33: "replication_sequence"}[k]] = v
    return out


def blobs(f: BinaryIO) -> Iterator[tuple[str, int, int]]:
    """(kind, place, size) of each blob; only the small headers between them are read."""
    while len(head := f.read(4)) == 4:
        kind, size = "", 0
        for k, v in message(f.read(struct.unpack(">I", head)[0])):
            if k == 1:
                kind = v.decode()
            elif k == 3:
                size = v
        yield kind, f.tell(), size
        f.seek(size, 1)


class Blobs(InputPartition):
    def __init__(self, at: list[tuple[int, int]]):
        self.at = at


class PbfReader(DataSourceReader):
    def __init__(self, path: str, per_partition: int):
        self.path, self.per_partition = path, per_partition

    def partitions(self) -> list[Blobs]:
        with open(self.path, "rb") as f:
            own = [(at, n) for kind, at, n in blobs(f) if kind == "OSMData"]
        return [Blobs(own[k : k + self.per_partition]) for k in range(0, len(own), self.per_partition)] or [Blobs([])]

    def read(self, partition: Blobs) -> Iterator[pa.RecordBatch]:
        if partition.at:
            with open(self.path, "rb") as f:
                for at, n in partition.at:
                    f.seek(at)
                    yield block_batch(blob_data(f.read(n)))


class PbfSource(DataSource):
    """Options: path (a file that every executor can open), blobs_per_partition."""

    @classmethod
    def name(cls) -> str:
        return "osm_pbf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PbfReader:
        return PbfReader(self.options["path"].removeprefix("file://"), int(self.options.get("blobs_per_partition", "16")))


def is_local(path: str) -> bool:
    return path.startswith("file:") or "://" not in path


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a file that all executors can open, or of the files at any path that Spark reads."""
    if is_local(path):
        spark.dataSource.register(PbfSource)
        return spark.read.format("osm_pbf").load(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                f = io.BytesIO(content.as_py())
                for kind, at, n in blobs(f):
                    if kind == "OSMData":
                        yield block_batch(blob_data(f.getbuffer()[at : at + n].tobytes()))

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, SCHEMA)


def frames(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The raw tables of a file, as ``osm_xml.read`` gives them."""
    raw = stored(read(spark, path), "pbf")
    w, r = raw.where("type = 'W'"), raw.where("type = 'R'")
    return {
        "nodes": raw.where("type = 'N'").select("id", "lon", "lat", geo.x_of("lon").alias("x"), geo.y_of("lat").alias("y"), "tags"),
        "ways": w.select("id", "tags"),
        "way_nodes": w.select(F.col("id").alias("way_id"), F.posexplode("node_ids").alias("p", "node_id")).select("way_id", (F.col("p") + 1).alias("pos"), "node_id"),
        "relations": r.select("id", "tags"),
        "members": r.select(F.col("id").alias("rel_id"), F.posexplode("members").alias("p", "m")).select("rel_id", (F.col("p") + 1).alias("pos"), "m.type", "m.id", "m.role"),
    }


def header(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file: what it says of itself."""
    schema = "source string, program string, required array<string>, optional array<string>, replication_timestamp long, replication_sequence long, replication_url string"

    def found(f: BinaryIO) -> tuple:
        for kind, at, n in blobs(f):
            if kind == "OSMHeader":
                f.seek(at)
                h = header_of(blob_data(f.read(n)))
                return h.get("source"), h.get("program"), h["required"], h["optional"], h.get("replication_timestamp"), h.get("replication_sequence"), h.get("replication_url")
        raise ValueError("no header in this file")

    if is_local(path):
        with open(path.removeprefix("file://"), "rb") as f:
            return spark.createDataFrame([found(f)], schema)
    rows = spark.read.format("binaryFile").load(path).select("content").toLocalIterator()
    return spark.createDataFrame([found(io.BytesIO(r["content"])) for r in rows], schema)
