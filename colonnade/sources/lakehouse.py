"""Delta Lake and Iceberg tables, read by replaying their metadata.

Only metadata comes to the driver: which files hold the snapshot. The files are
then one Parquet scan, in which Catalyst prunes columns and row groups.
"""

from __future__ import annotations

import datetime
import decimal
import io
import json
import re
import struct
import urllib.parse
import zlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colonnade.sources.files import Filter, condition


def _list(spark: SparkSession, path: str) -> list[str]:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().toString() for s in fs.listStatus(p)) if fs.exists(p) else []


def _bytes(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


# Delta

_STATS = {"<": lambda lo, hi, v: lo < v, "<=": lambda lo, hi, v: lo <= v, ">": lambda lo, hi, v: hi > v, ">=": lambda lo, hi, v: hi >= v, "=": lambda lo, hi, v: lo <= v <= hi, "==": lambda lo, hi, v: lo <= v <= hi}


def _may_hold(stats: dict, filters: Sequence[Filter]) -> bool:
    low, high = stats.get("minValues", {}), stats.get("maxValues", {})
    for name, op, value in filters:
        lo, hi = low.get(name), high.get(name)
        if op in _STATS and isinstance(lo, (int, float, str)) and isinstance(hi, type(lo)) and isinstance(value, (int, float) if not isinstance(lo, str) else str) and not _STATS[op](lo, hi, value):
            return False
    return True


def _partition_may_hold(values: dict, filters: Sequence[Filter]) -> bool:
    """Whether a partition (its values as the log's texts) may hold rows that pass the filters on its columns."""
    for name, op, value in filters:
        held = values.get(name)
        if op not in _STATS or isinstance(value, bool) or not isinstance(value, (int, float, str)):
            continue
        if held in (None, ""):
            return False  # null passes no comparison
        try:
            held = held if isinstance(value, str) else float(held)
        except ValueError:
            continue
        if not _STATS[op](held, held, value):
            return False
    return True


def _bare(path: Column) -> Column:
    """A file's path without scheme and leading slashes, decoded."""
    return F.regexp_replace(F.url_decode(F.regexp_replace(path, r"\+", "%2B")), "^(?:[^:/]+:)?/+", "")


class DeltaSnapshot:
    """The state of a Delta table's log at a version (the last one by default)."""

    def __init__(self, spark: SparkSession, path: str, version: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        names = _list(spark, f"{self.path}/_delta_log")
        name = lambda p: p.rpartition("/")[2]
        commits = {int(name(p)[:20]): p for p in names if name(p).endswith(".json") and name(p)[:20].isdigit()}
        checkpoints: dict[int, list[str]] = {}
        for p in names:
            if ".checkpoint" in name(p) and name(p).endswith(".parquet") and name(p)[:20].isdigit():
                checkpoints.setdefault(int(name(p)[:20]), []).append(p)
        last = max([*commits, *checkpoints], default=None)
        if last is None:
            raise FileNotFoundError(f"{path} holds no Delta log")
        self.version = last if version is None else version
        if self.version > last or self.version < 0:
            raise ValueError(f"there is no version {version}")
        complete = [v for v, ps in checkpoints.items() if v <= self.version and all(".checkpoint.parquet" in p or len(ps) == int(name(p).split(".")[3]) for p in ps)]
        start = max(complete, default=-1)
        self.adds: dict[str, dict] = {}
        self.metadata: dict = {}
        self.protocol: dict = {}
        if start >= 0:
            for row in spark.read.parquet(*checkpoints[start]).toJSON().collect():
                self._apply(json.loads(row))
        for v in range(start + 1, self.version + 1):
            if v not in commits:
                raise ValueError(f"version {v} can't be rebuilt: its commit is missing")
            for line in _bytes(spark, commits[v]).decode().splitlines():
                if line.strip():
                    self._apply(json.loads(line))
        features = {*self.protocol.get("readerFeatures", [])} - {"columnMapping", "timestampNtz", "appendOnly", "v2Checkpoint", "vacuumProtocolCheck"}
        if features:
            raise ValueError(f"unsupported reader features: {', '.join(sorted(features))}")

    def _apply(self, action: dict) -> None:
        if add := action.get("add"):
            if add.get("deletionVector"):
                raise ValueError("deletion vectors aren't supported")
            self.adds[add["path"]] = add
        elif remove := action.get("remove"):
            self.adds.pop(remove["path"], None)
        elif meta := action.get("metaData"):
            self.metadata = meta
        elif protocol := action.get("protocol"):
            self.protocol = protocol

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.metadata["schemaString"]))

    def read(self, columns: Sequence[str] | None = None, filters: Sequence[Filter] = ()) -> DataFrame:
        spark, schema = self.spark, self.schema
        physical = {f.name: (f.metadata or {}).get("delta.columnMapping.physicalName", f.name) for f in schema.fields}
        parts = list(self.metadata.get("partitionColumns", []))
        named = {p: physical.get(p, p) for p in parts}
        # comparisons of a text with texts or a number with numbers choose partitions; the filter itself does the rest
        kind = {f.name: str if isinstance(f.dataType, T.StringType) else (int, float) if isinstance(f.dataType, T.NumericType) else () for f in schema.fields if f.name in parts}
        choosing = [(named[c], op, v) for c, op, v in filters if c in kind and isinstance(v, kind[c])]
        adds = []
        for add in self.adds.values():
            stats = json.loads(add["stats"]) if add.get("stats") else {}
            inside_file = _may_hold(stats, [(physical.get(c, c), op, v) for c, op, v in filters if c not in parts])
            if inside_file and _partition_may_hold(add.get("partitionValues", {}), choosing):
                adds.append(add)
        inside = T.StructType([T.StructField(physical[f.name], f.dataType, True) for f in schema.fields if f.name not in parts])
        if not adds:
            df = spark.createDataFrame([], schema)
        else:
            full = lambda p: p if "://" in p or p.startswith("/") else f"{self.path}/{urllib.parse.unquote(p)}"
            df = spark.read.schema(inside).parquet(*[full(a["path"]) for a in adds])
            if parts:
                whole = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
                base = whole(self.path)
                base = re.sub("^(?:[^:/]+:)?/+", "", base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(base).toString())
                key = lambda p: re.sub("^(?:[^:/]+:)?/+", "", p if "://" in p or p.startswith("/") else f"{base}/{p}")
                rows = [(key(urllib.parse.unquote(a["path"])), *[a.get("partitionValues", {}).get(named[p]) or None for p in parts]) for a in adds]
                values = spark.createDataFrame(rows, ", ".join(["__file string", *[f"`__p{n}` string" for n in range(len(parts))]]))
                values = F.broadcast(values) if len(rows) <= 1_000_000 else values  # one row for each file
                df = df.withColumn("__at", _bare(F.col("_metadata.file_path"))).join(values, F.col("__at") == F.col("__file"), "left")
                lost = F.raise_error(F.concat(F.lit("no partition is known of "), F.col("__at")))
                df = df.withColumn("__p0", F.when(F.col("__file").isNull(), lost).otherwise(F.col("__p0")))
            kinds = {f.name: f.dataType for f in schema.fields}
            df = df.select(*[F.col(f"`__p{parts.index(f.name)}`").cast(kinds[f.name]).alias(f.name) if f.name in parts else F.col(f"`{physical[f.name]}`").alias(f.name) for f in schema.fields])
        df = df.where(condition(filters)) if filters else df
        return df.select(*columns) if columns else df


def read_delta(spark: SparkSession, path: str, version: int | None = None, columns: Sequence[str] | None = None, filters: Sequence[Filter] = ()) -> DataFrame:
    return DeltaSnapshot(spark, path, version).read(columns, filters)


# Avro, as far as Iceberg's manifests need it


def read_avro(raw: bytes) -> list[dict]:
    """The records of an Avro object container file."""
    f = io.BytesIO(raw)
    if f.read(4) != b"Obj\x01":
        raise ValueError("not an Avro file")
    meta = _avro(f, {"type": "map", "values": "bytes"}, {})
    schema, codec, mark = json.loads(meta["avro.schema"]), meta.get("avro.codec", b"null").decode(), f.read(16)
    names: dict = {}
    _names(schema, names)
    out = []
    while f.tell() < len(raw):
        n, size = _long(f), _long(f)
        block = f.read(size)
        if codec == "deflate":
            block = zlib.decompress(block, -15)
        elif codec != "null":
            raise ValueError(f"unsupported Avro codec {codec}")
        b = io.BytesIO(block)
        out += [_avro(b, schema, names) for _ in range(n)]
        if f.read(16) != mark:
            raise ValueError("an Avro block doesn't end in the file's mark")
    return out


def _names(schema: object, names: dict) -> None:
    if isinstance(schema, list):
        for s in schema:
            _names(s, names)
    elif isinstance(schema, dict):
        if "name" in schema and schema.get("type") in ("record", "enum", "fixed"):
            names[schema["name"]] = schema
        for k in ("items", "values", "type"):
            if isinstance(schema.get(k), (dict, list)):
                _names(schema[k], names)
        for field in schema.get("fields", []):
            _names(field["type"], names)


def _long(f: io.BytesIO) -> int:
    shift = value = 0
    while True:
        b = f.read(1)[0]
        value |= (b & 127) << shift
        if b < 128:
            return (value >> 1) ^ -(value & 1)
        shift += 7


def _avro(f: io.BytesIO, schema: object, names: dict) -> object:
    if isinstance(schema, list):
        return _avro(f, schema[_long(f)], names)
    kind = schema["type"] if isinstance(schema, dict) else schema
    if isinstance(kind, (dict, list)):
        return _avro(f, kind, names)
    if kind in names and not (isinstance(schema, dict) and "fields" in schema):
        return _avro(f, names[kind], {k: v for k, v in names.items() if k != kind} | {kind: names[kind]}) if names[kind] is not schema else None
    if kind == "record":
        return {x["name"]: _avro(f, x["type"], names) for x in schema["fields"]}
    if kind == "null":
        return None
    if kind == "boolean":
        return f.read(1) == b"\x01"
    if kind in ("int", "long"):
        return _long(f)
    if kind in ("float", "double"):
        return struct.unpack("<f" if kind == "float" else "<d", f.read(4 if kind == "float" else 8))[0]
    if kind in ("bytes", "string"):
        raw = f.read(_long(f))
        return raw if kind == "bytes" else raw.decode()
    if kind == "fixed":
        return f.read(schema["size"])
    if kind == "enum":
        return schema["symbols"][_long(f)]
    out: list = []
    while n := _long(f):
        if n < 0:
            n, _ = -n, _long(f)
        for _ in range(n):
            out.append((_avro(f, "string", names), _avro(f, schema["values"], names)) if kind == "map" else _avro(f, schema["items"], names))
    return dict(out) if kind == "map" else out


# Iceberg


def _ice_type(t: object) -> T.DataType:
    if isinstance(t, dict):
        if t["type"] == "struct":
            return T.StructType([_ice_field(f) for f in t["fields"]])
        if t["type"] == "list":
            return T.ArrayType(_ice_type(t["element"]))
        return T.MapType(_ice_type(t["key"]), _ice_type(t["value"]))
    plain = {"boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "date": T.DateType(), "string": T.StringType(), "binary": T.BinaryType(), "uuid": T.BinaryType(), "timestamp": T.TimestampNTZType(), "timestamptz": T.TimestampType(), "time": T.LongType()}
    if t in plain:
        return plain[t]
    if t.startswith("decimal"):
        return T.DecimalType(*map(int, t[8:-1].split(",")))
    return T.BinaryType()


def _ice_field(f: dict) -> T.StructField:
    return T.StructField(f["name"], _ice_type(f["type"]), True, {"parquet.field.id": f["id"]})


def _ice_value(raw: bytes, kind: str) -> object:
    """A bound in Iceberg's single-value form."""
    if kind in ("int", "date"):
        return struct.unpack("<i", raw)[0]
    if kind in ("long", "timestamp", "timestamptz", "time"):
        return struct.unpack("<q", raw)[0] if len(raw) == 8 else struct.unpack("<i", raw)[0]
    if kind in ("float", "double"):
        return struct.unpack("<f" if len(raw) == 4 else "<d", raw)[0]
    if kind == "string":
        return raw.decode("utf-8", "replace")
    return decimal.Decimal(int.from_bytes(raw, "big", signed=True)) if kind.startswith("decimal") else None


def read_iceberg(spark: SparkSession, path: str, snapshot_id: int | None = None, columns: Sequence[str] | None = None, filters: Sequence[Filter] = ()) -> DataFrame:
    """A snapshot of an Iceberg table, its columns found by field id. Tables with delete files are refused."""
    base = path.rstrip("/")
    metas = [p for p in _list(spark, f"{base}/metadata") if p.endswith(".metadata.json")]
    if not metas:
        raise FileNotFoundError(f"{path} holds no Iceberg metadata")
    number = lambda p: int("".join(c for c in p.rpartition("/")[2].split(".")[0].split("-")[0] if c.isdigit()) or 0)
    meta = json.loads(_bytes(spark, max(metas, key=lambda p: (number(p), p))))
    schemas = {s.get("schema-id", 0): s for s in meta.get("schemas", [meta["schema"]] if "schema" in meta else [])}
    wanted = meta.get("current-snapshot-id") if snapshot_id is None else snapshot_id
    snapshot = next((s for s in meta.get("snapshots", []) if s["snapshot-id"] == wanted), None)
    if snapshot_id is not None and snapshot is None:
        raise ValueError(f"there is no snapshot {snapshot_id}")
    current = meta.get("current-schema-id", 0)
    schema = schemas[snapshot.get("schema-id", current) if snapshot and snapshot_id is not None else current]
    types = T.StructType([_ice_field(f) for f in schema["fields"]])
    location = meta["location"].rstrip("/")
    place = lambda p: base + p[len(location) :] if p.startswith(location) else p
    files: list[str] = []
    if snapshot:
        manifests = [m["manifest_path"] for m in read_avro(_bytes(spark, place(snapshot["manifest-list"])))] if "manifest-list" in snapshot else snapshot["manifests"]
        for m in manifests:
            for entry in read_avro(_bytes(spark, place(m))):
                data = entry["data_file"]
                if entry.get("status") == 2:
                    continue
                if data.get("content", 0):
                    raise ValueError("delete files aren't supported")
                if _ice_may_hold(data, schema["fields"], filters):
                    files.append(place(data["file_path"]))
    if not files:
        df = spark.createDataFrame([], types)
    else:
        # field ids are resolved by the Parquet reader; the setting is read when the scan is planned
        spark.conf.set("spark.sql.parquet.fieldId.read.enabled", "true")
        spark.conf.set("spark.sql.parquet.fieldId.read.ignoreMissing", "true")
        df = spark.read.schema(types).parquet(*files)
    df = df.where(condition(filters)) if filters else df
    return df.select(*columns) if columns else df


def _bounds(items: object) -> dict:
    return {x["key"]: x["value"] for x in items} if isinstance(items, list) else dict(items or {})


def _ice_may_hold(data: dict, fields: list[dict], filters: Sequence[Filter]) -> bool:
    lows, highs = _bounds(data.get("lower_bounds")), _bounds(data.get("upper_bounds"))
    by_name = {f["name"]: f for f in fields}
    for name, op, value in filters:
        f = by_name.get(name)
        if f is None or op not in _STATS or f["id"] not in lows or f["id"] not in highs or not isinstance(f["type"], str):
            continue
        kind = f["type"]
        lo, hi = _ice_value(lows[f["id"]], kind), _ice_value(highs[f["id"]], kind)
        if isinstance(value, datetime.date) and kind == "date":
            value = (value - datetime.date(1970, 1, 1)).days
        if isinstance(value, (int, float)) and isinstance(lo, (int, float)) and not _STATS[op](lo, hi, value):
            return False
        if kind == "string" and isinstance(value, str) and op in ("=", "==") and not (lo <= value and hi[: len(value)] >= value[: len(hi)]):
            return False
    return True


__all__ = ["DeltaSnapshot", "read_avro", "read_delta", "read_iceberg"]
