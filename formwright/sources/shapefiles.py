"""Polygon shapefiles as a Spark data source: layers are folders of tiles (.shp with .shx and .dbf), read by ranges of records and written one tile for each task.

The index file gives every record's place, so a tile of any size is cut into partitions and each reads its own bytes only. Workers open the files themselves: folders
must be on a file system that driver and executors have mounted.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

_POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
_PARTS = pa.list_(pa.list_(pa.list_(_POINT)))
SCHEMA = "tile string, record int, attributes map<string, string>, parts array<array<array<struct<x: double, y: double>>>>"
#: Records of one partition, and width of a text field in the .dbf.
RECORDS, WIDTH = 50_000, 80

Ring = list[tuple[float, float]]


def _ring_area(points: Ring) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:] + points[:1], strict=True)) / 2


def _holds(ring: Ring, x: float, y: float) -> bool:
    odd = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            odd = not odd
    return odd


def _grouped(rings: list[Ring]) -> list[list[Ring]]:
    """Parts of shell and holes: clockwise rings are shells, others holes of the smallest shell that holds them, wherever they stand; a hole in no shell is a shell."""
    shells = [[r] for r in rings if _ring_area(r) <= 0]
    shells.sort(key=lambda part: -_ring_area(part[0]))
    lone = []
    for r in rings:
        if _ring_area(r) > 0:
            home = next((part for part in shells if any(_holds(part[0], x, y) for x, y in r[:3])), None)
            home.append(r) if home else lone.append([r])
    return shells + lone


def polygons(data: bytes, at: int = 100) -> Iterator[list[list[Ring]] | None]:
    """Footprints of a .shp file's records from byte `at` on; null shapes are None."""
    while at + 8 <= len(data):
        words = struct.unpack(">ii", data[at : at + 8])[1]
        body = data[at + 8 : at + 8 + 2 * words]
        at += 8 + 2 * words
        if struct.unpack("<i", body[:4])[0] not in (5, 15, 25):
            yield None
            continue
        n_parts, n_points = struct.unpack("<ii", body[36:44])
        starts = [*struct.unpack(f"<{n_parts}i", body[44 : 44 + 4 * n_parts]), n_points]
        flat = struct.unpack(f"<{2 * n_points}d", body[44 + 4 * n_parts : 44 + 4 * n_parts + 16 * n_points])
        points = list(zip(flat[::2], flat[1::2], strict=True))
        rings = [points[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]
        yield _grouped([r[:-1] if len(r) > 1 and r[0] == r[-1] else r for r in rings if r])


class _Table:
    """The records of a .dbf file as text, some of the columns or all."""

    def __init__(self, path: str, columns: list[str] | None, encoding: str = "utf-8"):
        self.file, self.encoding = open(path, "rb"), encoding  # noqa: SIM115
        head = self.file.read(32)
        self.n, self.head, self.width = struct.unpack("<IHH", head[4:12])
        # Names in the file end after ten bytes; a column asked for by its full name comes back by it.
        wanted = None if columns is None else {c.encode(encoding)[:10].decode(encoding, "ignore"): c for c in columns}
        self.fields, at = [], 1
        for _ in range((self.head - 33) // 32):
            f = self.file.read(32)
            if f[:1] == b"\r" or len(f) < 32:
                break
            name = f[:11].split(b"\0")[0].decode(encoding, "replace")
            if wanted is None or name in wanted:
                self.fields.append((name if wanted is None else wanted[name], at, f[16]))
            at += f[16]

    def rows(self, first: int, count: int) -> Iterator[dict[str, str]]:
        """Records from first on; past the end of the table, where shapes outnumber records, they are empty."""
        self.file.seek(self.head + first * self.width)
        data = self.file.read(count * self.width)
        for k in range(count):
            row = data[k * self.width : (k + 1) * self.width]
            yield {n: row[a : a + w].decode(self.encoding, "replace").strip() for n, a, w in self.fields} if len(row) == self.width and first + k < self.n else {}


class _Range(InputPartition):
    def __init__(self, tile: str, first: int, count: int):
        super().__init__((tile, first, count))
        self.tile, self.first, self.count = tile, first, count


def _local(path: str) -> str:
    if re.match(r"[a-z][a-z0-9+.-]+:", path) and not path.startswith("file:"):
        raise ValueError(f"{path} is not a mounted folder; read such tiles with read_remote_tiles")
    return re.sub(r"^file:(//)?", "", path)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.records = _local(options["path"]), int(options.get("records", RECORDS))
        self.columns = None if options.get("columns") is None else options["columns"].split(",")

    def partitions(self) -> list[_Range]:
        out = []
        for folder, _, names in os.walk(self.folder):
            for name in sorted(names):
                if name.endswith(".shp") and not name.startswith("."):
                    tile = os.path.join(folder, name)[:-4]
                    if not os.path.exists(f"{tile}.shx"):
                        out.append(_Range(tile, 0, -1))  # no index: one task finds the records one by one
                        continue
                    n = (os.path.getsize(f"{tile}.shx") - 100) // 8
                    out += [_Range(tile, k, min(self.records, n - k)) for k in range(0, n, self.records)]
        return out or [_Range("", 0, 0)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        if not part.count:
            return
        with open(f"{part.tile}.shp", "rb") as shapes:
            places = self._places(part, shapes)
            table = _Table(f"{part.tile}.dbf", self.columns) if os.path.exists(f"{part.tile}.dbf") else None
            for a in range(0, len(places) // 2, 5_000):
                n = min(5_000, len(places) // 2 - a)
                shapes.seek(2 * places[2 * a])
                data = shapes.read(2 * (places[2 * (a + n - 1)] + places[2 * (a + n - 1) + 1]) + 8 - 2 * places[2 * a])
                found = [None if s is None else [[[{"x": x, "y": y} for x, y in r] for r in rings] for rings in s] for s in polygons(data, 0)]
                rows = list(table.rows(part.first + a, n)) if table else [{}] * n
                at = range(part.first + a, part.first + a + n)
                yield pa.RecordBatch.from_arrays([pa.array([part.tile] * n), pa.array(at, pa.int32()), pa.array([list(r.items()) for r in rows], pa.map_(pa.string(), pa.string())), pa.array(found, _PARTS)], names=["tile", "record", "attributes", "parts"])


    @staticmethod
    def _places(part: _Range, shapes) -> tuple[int, ...]:
        """Offset and length of each record of the range, in words of two bytes."""
        if part.count > 0:
            with open(f"{part.tile}.shx", "rb") as index:
                index.seek(100 + 8 * part.first)
                return struct.unpack(f">{2 * part.count}i", index.read(8 * part.count))
        found, at = [], 100
        while shapes.seek(at) and len(head := shapes.read(8)) == 8:
            words = struct.unpack(">ii", head)[1]
            found += [at // 2, words]
            at += 8 + 2 * words
        return tuple(found)


class _Written(WriterCommitMessage):
    pass


class _Writer(DataSourceWriter):
    """A tile for each task: records go to the files as they come; headers are put right at the end."""

    def __init__(self, options: dict, names: list[str]):
        self.folder, self.width = _local(options["path"]), int(options.get("width", WIDTH))
        self.names = [n for n in names if n != "parts"]
        if len({n[:10] for n in self.names}) < len(self.names):
            raise ValueError("names of shapefile columns must differ in their first ten letters")

    def write(self, rows: Iterator) -> _Written:
        context = TaskContext.get()
        os.makedirs(self.folder, exist_ok=True)
        # A name of its own for each attempt, moved to the task's name when whole: a lost task leaves no half tile.
        name = f"part-{context.partitionId():05d}"
        temporary = os.path.join(self.folder, f".{name}-{context.taskAttemptId()}")
        box, n, length = [float("inf")] * 2 + [float("-inf")] * 2, 0, 100
        with open(f"{temporary}.shp", "wb") as shp, open(f"{temporary}.shx", "wb") as shx, open(f"{temporary}.dbf", "wb") as dbf:
            shp.write(b"\0" * 100)
            shx.write(b"\0" * 100)
            dbf.write(self._table_head(0))
            for row in rows:
                body = self._shape(row["parts"], box)
                shp.write(struct.pack(">ii", n + 1, len(body) // 2) + body)
                shx.write(struct.pack(">ii", length // 2, len(body) // 2))
                dbf.write(b" " + b"".join(self._field(row[c], c) for c in self.names))
                n, length = n + 1, length + 8 + len(body)
            for file, size in ((shp, length), (shx, 100 + 8 * n)):
                file.seek(0)
                file.write(struct.pack(">7i", 9994, 0, 0, 0, 0, 0, size // 2) + struct.pack("<2i8d", 1000, 5, *(box if n else [0.0] * 4), 0, 0, 0, 0))
            dbf.write(b"\x1a")
            dbf.seek(0)
            dbf.write(self._table_head(n))
        for kind in ("dbf", "shp", "shx") if n else ():
            os.replace(f"{temporary}.{kind}", os.path.join(self.folder, f"{name}.{kind}"))
        for kind in () if n else ("dbf", "shp", "shx"):
            os.remove(f"{temporary}.{kind}")
        return _Written()

    def _table_head(self, n: int) -> bytes:
        fields = b"".join(c.encode()[:10].ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([self.width, 0]) + b"\0" * 14 for c in self.names)
        return struct.pack("<B3BIHH20x", 3, 100, 1, 1, n, 33 + len(fields), 1 + self.width * len(self.names)) + fields + b"\r"

    def _field(self, value, name: str) -> bytes:
        raw = b"" if value is None else str(value).encode()
        if len(raw) > self.width:
            raise ValueError(f"{name} holds {len(raw)} bytes; raise the option width above {self.width}")
        return raw.ljust(self.width)

    @staticmethod
    def _shape(parts, box: list[float]) -> bytes:
        rings = []
        for rings_of in parts or []:
            for k, r in enumerate(rings_of):
                points = [(p["x"], p["y"]) for p in r]
                turned = (_ring_area(points) <= 0) == (k == 0)
                points = points if turned else points[::-1]
                rings.append([*points, points[0]])
        if not rings:
            return struct.pack("<i", 0)
        xs, ys = zip(*(p for r in rings for p in r), strict=True)
        own = [min(xs), min(ys), max(xs), max(ys)]
        box[:] = [min(box[0], own[0]), min(box[1], own[1]), max(box[2], own[2]), max(box[3], own[3])]
        starts = [sum(map(len, rings[:k])) for k in range(len(rings))]
        return struct.pack("<i4d2i", 5, *own, len(rings), len(xs)) + struct.pack(f"<{len(starts)}i", *starts) + struct.pack(f"<{2 * len(xs)}d", *(v for p in zip(xs, ys, strict=True) for v in p))


class Shapefiles(DataSource):
    """spark.read.format("shapefile") and df.write.format("shapefile"). Options to read: columns (comma-separated fields of the .dbf to decode), records (of a partition); to write: width."""

    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options, schema.names)


def read_shapefiles(spark: SparkSession, folder: str, columns: list[str] | None = None, records: int = RECORDS) -> DataFrame:
    """tile, record, attributes, parts of all shapefiles with an index under a folder, by ranges of records; columns: the .dbf fields to decode. A tile without .dbf has no attributes."""
    spark.dataSource.register(Shapefiles)
    reader = spark.read.format("shapefile").option("records", records)
    return (reader if columns is None else reader.option("columns", ",".join(columns))).load(folder)


def write_shapefiles(df: DataFrame, folder: str, width: int = WIDTH) -> None:
    """df (parts, and columns that are written as text) as tiles, one for each task that has rows."""
    df.sparkSession.dataSource.register(Shapefiles)
    df.write.format("shapefile").option("width", width).mode("append").save(folder)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for tile, shp in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            shapes = [None if s is None else [[[{"x": x, "y": y} for x, y in r] for r in rings] for rings in s] for s in polygons(shp)]
            for a in range(0, len(shapes), 5_000):
                n = len(shapes[a : a + 5_000])
                yield pa.RecordBatch.from_arrays([pa.array([tile] * n), pa.array(range(a, a + n), pa.int32()), pa.array([[]] * n, pa.map_(pa.string(), pa.string())), pa.array(shapes[a : a + 5_000], _PARTS)], names=["tile", "record", "attributes", "parts"])


def read_remote_tiles(spark: SparkSession, folder: str) -> DataFrame:
    """The same columns, without attributes, for a store that only Spark's own readers reach: a tile is one value of 2 GB at most in one task."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.shp").load(folder)
    return files.select(F.regexp_replace("path", r"\.shp$", "").alias("tile"), F.col("content").alias("shp")).mapInArrow(_parse, SCHEMA)
