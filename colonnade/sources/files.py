"""Readers and writers of Parquet, CSV, newline-delimited JSON and Arrow IPC."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from colonnade.session import materialized

Filter = tuple[str, str, object]


def condition(filters: Sequence[Filter]) -> Column:
    """(column, operator, literal) filters, all of which hold; NaN fails every comparison but !=."""
    out = F.lit(True)
    for name, op, value in filters:
        c = F.col(f"`{name}`")
        real = ~F.isnan(c.cast("double")) if isinstance(value, float) else F.lit(True)
        tests = {"=": lambda: c == value, "==": lambda: c == value, "!=": lambda: c != value, "<": lambda: (c < value) & real, "<=": lambda: (c <= value) & real, ">": lambda: (c > value) & real, ">=": lambda: (c >= value) & real, "in": lambda: c.isin(*value), "is_null": lambda: c.isNull(), "is_not_null": lambda: c.isNotNull()}
        if op not in tests:
            raise ValueError(f"unknown operator {op!r}")
        out = out & tests[op]()
    return out


def read_parquet(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str] | None = None, filters: Sequence[Filter] = ()) -> DataFrame:
    """Columns may be dotted paths into structs. Filters reach the scan's statistics and are exact in the result."""
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    if filters:
        df = df.where(condition(filters))
    return df.select(*[F.col(c) if "." not in c else F.col(c).alias(c.replace(".", "_")) for c in columns]) if columns else df


def write_parquet(df: DataFrame, path: str, compression: str = "snappy", row_group_bytes: int | None = None, partition_by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    w = df.write.mode(mode).option("compression", compression)
    if row_group_bytes:
        w = w.option("parquet.block.size", str(row_group_bytes))
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def parquet_metadata(spark: SparkSession, path: str) -> DataFrame:
    """file, row_group, column, rows, codec, nulls, bytes of each column chunk, read where the files are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        for batch in batches:
            for file, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                meta, out = pq.ParquetFile(pa.BufferReader(raw)).metadata, []
                for g in range(meta.num_row_groups):
                    group = meta.row_group(g)
                    for c in range(group.num_columns):
                        chunk = group.column(c)
                        nulls = chunk.statistics.null_count if chunk.is_stats_set and chunk.statistics.has_null_count else None
                        out.append({"file": file.rpartition("/")[2], "row_group": g, "column": chunk.path_in_schema, "rows": group.num_rows, "codec": chunk.compression, "nulls": nulls, "bytes": chunk.total_compressed_size})
                yield pa.RecordBatch.from_pylist(out, pa.schema([("file", pa.string()), ("row_group", pa.int32()), ("column", pa.string()), ("rows", pa.int64()), ("codec", pa.string()), ("nulls", pa.int64()), ("bytes", pa.int64())]))

    return _files(spark, path).select("path", "content").mapInArrow(run, "file string, row_group int, column string, rows long, codec string, nulls long, bytes long")


# CSV

#: The order in which a column's type is sought: the first that all values have.
CSV_TYPES = (
    ("bigint", r"^\s*[+-]?\d{1,19}\s*$"),
    ("boolean", r"^(?:true|false|True|False|TRUE|FALSE|0|1)$"),
    ("date", r"^\d{4}-\d{2}-\d{2}$"),
    ("time", r"^\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?$"),
    ("timestamp_ntz", r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?$"),
    ("timestamp", r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?(?:Z|[+-]\d{2}:?\d{2})$"),
    ("double", r"^\s*[+-]?(?:\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|nan|NaN|inf|Infinity|-inf|-Infinity)\s*$"),
)
NULLS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "N/A", "NA", "NULL", "NaN", "n/a", "nan", "null")


def _as(c: Column, kind: str, true_values: Sequence[str]) -> Column:
    if kind == "boolean":
        return F.when(c.isNotNull(), F.lower(c).isin("true", "1", *[t.lower() for t in true_values]))
    if kind == "time":  # microseconds of the day
        part = F.split(c, "[:.]")
        micros = F.rpad(F.coalesce(F.get(part, F.lit(3)), F.lit("")), 6, "0").cast("long")
        return (part[0].cast("long") * 3600 + part[1].cast("long") * 60 + F.coalesce(F.get(part, F.lit(2)).cast("long"), F.lit(0))) * 1000000 + micros
    return F.trim(c).try_cast(kind) if kind in ("bigint", "double") else c.try_cast(kind)


def read_csv(
    spark: SparkSession, path: str, header: bool = True, column_names: Sequence[str] | None = None, delimiter: str = ",", quote: str = '"', double_quote: bool = True, skip_rows: int = 0,
    include_columns: Sequence[str] | None = None, include_missing: bool = False, column_types: dict[str, str] | None = None, null_values: Sequence[str] = NULLS, strings_can_be_null: bool = False,
    true_values: Sequence[str] = (), decimal_point: str = ".", infer: bool = True,
) -> DataFrame:
    """All columns are read as text; one aggregation over the whole file then finds the type that all values of a column have.

    Files stay splittable unless a quoted value may hold a line end, which a line
    with an odd number of quotes shows; then each file is read by one task.
    """
    quotes = F.length("value") - F.length(F.regexp_replace("value", re.escape(quote), ""))
    lines_quoted = bool(quote) and (not double_quote or not spark.read.text(path).where(quotes % 2 == 1).isEmpty())
    r = spark.read.option("header", header and column_names is None).option("sep", delimiter).option("quote", quote).option("escape", quote if double_quote else "\\").option("multiLine", lines_quoted).option("nullValue", "\u0000").option("emptyValue", "")
    if skip_rows:
        lines = spark.read.text(path).withColumn("__at", F.col("_metadata.file_block_start")).rdd.zipWithIndex().filter(lambda x: x[1] >= skip_rows).map(lambda x: x[0][0])
        df = r.csv(lines)
    else:
        df = r.csv(path)
    if column_names is not None:
        df = df.toDF(*column_names)
    elif not header:
        df = df.toDF(*[f"f{n}" for n in range(len(df.columns))])
    if include_columns is not None:
        missing = [c for c in include_columns if c not in df.columns]
        if missing and not include_missing:
            raise KeyError(f"no such columns: {', '.join(missing)}")
        df = df.select(*[F.col(f"`{c}`") if c not in missing else F.lit(None).cast("string").alias(c) for c in include_columns])
    types = dict(column_types or {})
    todo = [c for c in df.columns if c not in types]
    clean = lambda name: F.when(~F.coalesce(F.col(f"`{name}`"), F.lit("")).isin(*null_values), F.regexp_replace(F.col(f"`{name}`"), re.escape(decimal_point), ".") if decimal_point != "." else F.col(f"`{name}`"))
    if infer and todo:
        tests = [F.bool_and(F.when(clean(c).isNotNull(), clean(c).rlike(rx) & (F.trim(clean(c)).try_cast("bigint").isNotNull() if kind == "bigint" else F.lit(True)))).alias(f"{n}|{kind}") for n, c in enumerate(todo) for kind, rx in CSV_TYPES]
        found = df.agg(*tests).first().asDict()
        for n, c in enumerate(todo):
            if all(found[f"{n}|{k}"] is None for k, _ in CSV_TYPES):
                types[c] = "void"
            else:
                types[c] = next((k for k, _ in CSV_TYPES if found[f"{n}|{k}"]), "string")

    def typed(c: str) -> Column:
        kind = types.get(c, "string")
        if kind == "string":
            return (clean(c) if strings_can_be_null else F.coalesce(F.col(f"`{c}`"), F.lit(""))).alias(c)
        return F.lit(None).alias(c) if kind == "void" else _as(clean(c), kind, true_values).alias(c)

    return df.select(*[typed(c) for c in df.columns])


def write_csv(df: DataFrame, path: str, delimiter: str = ",", header: bool = True, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("sep", delimiter).option("header", header).option("escape", '"').csv(path)


# JSON


def read_json(spark: SparkSession, path: str, schema: str | None = None, unexpected: str = "infer") -> DataFrame:
    """Newline-delimited JSON. Fields come in order of first appearance; a type conflict is an error.

    unexpected: what becomes of fields beside an explicit schema: ignore, error or infer.
    """
    if unexpected not in ("ignore", "error", "infer"):
        raise ValueError("unexpected is ignore, error or infer")
    lines = spark.read.text(path).where("length(trim(value)) > 0")
    if schema is not None and unexpected == "ignore":
        return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("v")).select("v.*")
    found = lines.agg(F.expr("schema_of_variant_agg(parse_json(value))").alias("s")).first()["s"] or "OBJECT<>"
    if "VARIANT" in found:
        raise ValueError(f"a field has values of different types: {found}")
    inferred = found.replace("OBJECT<", "struct<").replace("VOID", "STRING")
    names = [f.name for f in spark.createDataFrame([], f"v {inferred}").schema["v"].dataType.fields] if inferred != "struct<>" else []
    keys = lines.select(F.posexplode(F.expr("json_object_keys(value)")).alias("at", "key"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row"))
    order = [r["key"] for r in keys.groupBy("key").agg(F.min(F.struct("row", "at")).alias("first")).orderBy("first").collect()]  # one row for each field
    explicit = spark.createDataFrame([], schema).schema if schema else None
    if explicit is not None:
        beside = [k for k in order if k not in explicit.names]
        if beside and unexpected == "error":
            raise ValueError(f"unexpected fields: {', '.join(beside)}")
        order = [*explicit.names, *beside]
    as_read = spark.createDataFrame([], f"v {inferred}").schema["v"].dataType if names else None
    fields = {**{f.name: f.dataType for f in (as_read.fields if as_read else [])}, **{f.name: f.dataType for f in (explicit.fields if explicit else [])}}
    full = ", ".join(f"`{k}` {fields[k].simpleString()}" for k in order)
    out = lines.select(F.from_json("value", full, {"mode": "FAILFAST"}).alias("v")).select("v.*")
    stamp = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?$"
    texts = [k for k in order if fields[k].simpleString() == "string" and (explicit is None or k not in explicit.names)]
    if texts:
        times = out.agg(*[F.bool_and(F.col(f"`{k}`").rlike(stamp)).alias(k) for k in texts]).first().asDict()
        out = out.withColumns({k: F.col(f"`{k}`").cast("timestamp_ntz") for k in texts if times[k]})
    return out


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


# Arrow IPC


def _open_ipc(raw: bytes):
    return pa.ipc.open_file(pa.BufferReader(raw)) if raw[:6] == b"ARROW1" else pa.ipc.open_stream(pa.BufferReader(raw))


def _batches(reader) -> Iterator[pa.RecordBatch]:
    if hasattr(reader, "num_record_batches"):
        yield from (reader.get_batch(k) for k in range(reader.num_record_batches))
    else:
        yield from reader


def read_ipc(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A file or folder of Arrow IPC files or streams; each file is read by one task."""
    files = _files(spark, path).select("content")

    def schema_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("content").to_pylist():
                yield pa.RecordBatch.from_pydict({"schema": [_open_ipc(raw).schema.serialize().to_pybytes()]})

    first = files.mapInArrow(schema_of, "schema binary").first()
    if first is None:
        raise FileNotFoundError(f"no IPC files in {path}")
    schema = pa.ipc.read_schema(pa.BufferReader(bytes(first["schema"])))
    if columns:
        schema = pa.schema([schema.field(c) for c in columns])
    plain = pa.schema([pa.field(f.name, _plain(f.type)) for f in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("content").to_pylist():
                for b in _batches(_open_ipc(raw)):
                    yield from pa.Table.from_batches([b]).select(plain.names).cast(plain).to_batches()

    return files.mapInArrow(run, from_arrow_schema(plain))


def _plain(t: pa.DataType) -> pa.DataType:
    """The type as Spark holds it: no dictionaries, views or units but microseconds; unsigned integers one size up."""
    if pa.types.is_dictionary(t):
        return _plain(t.value_type)
    if pa.types.is_timestamp(t):
        return pa.timestamp("us", t.tz)
    if pa.types.is_duration(t):
        return pa.duration("us")
    up = {pa.uint8(): pa.int16(), pa.uint16(): pa.int32(), pa.uint32(): pa.int64(), pa.uint64(): pa.decimal128(20, 0), pa.float16(): pa.float32(), pa.string_view(): pa.string(), pa.binary_view(): pa.binary(), pa.date64(): pa.date32(), pa.large_string(): pa.string(), pa.large_binary(): pa.binary()}
    if pa.types.is_list(t) or pa.types.is_large_list(t) or pa.types.is_fixed_size_list(t):
        return pa.list_(_plain(t.value_type))
    if pa.types.is_struct(t):
        return pa.struct([pa.field(f.name, _plain(f.type)) for f in t])
    return pa.binary() if pa.types.is_fixed_size_binary(t) else up.get(t, t)


def write_ipc(df: DataFrame, uri: str, compression: str | None = "zstd", mode: str = "overwrite") -> DataFrame:
    """Writes one IPC file for each partition to a store that all machines reach; returns file and rows.

    ``overwrite`` removes the parts that the folder holds, ``append`` keeps them
    and ``error`` refuses them. A table without rows gives a file of its schema.

    A file is written under a name of its attempt and then renamed, so that a task that is run again leaves no half file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        store, base = fs.FileSystem.from_uri(uri)
        context = TaskContext.get()
        store.create_dir(base, recursive=True)
        part = f"{base}/part-{name}{context.partitionId():05d}.arrow"
        temporary, writer, rows = f"{base}/.attempt-{context.taskAttemptId()}", None, 0
        for batch in batches:
            if writer is None:
                sink = store.open_output_stream(temporary)
                writer = pa.ipc.new_file(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=compression))
            writer.write_batch(batch)
            rows += batch.num_rows
        if writer is not None:
            writer.close()
            sink.close()
            store.move(temporary, part)
            yield pa.RecordBatch.from_pydict({"file": [part], "rows": pa.array([rows], pa.int64())})

    from pyarrow import fs

    if mode not in ("overwrite", "append", "error"):
        raise ValueError(f"mode is overwrite, append or error, not {mode!r}")
    store, base = fs.FileSystem.from_uri(uri)
    old = [f.path for f in store.get_file_info(fs.FileSelector(base, allow_not_found=True)) if f.base_name.startswith("part-") and f.base_name.endswith(".arrow")]
    if old and mode == "error":
        raise FileExistsError(f"{uri} holds {len(old)} parts")
    name = f"{uuid.uuid4().hex[:8]}-" if mode == "append" else ""
    if mode == "overwrite" and old:
        df = materialized(df)  # it may read what is removed now
        for path in old:
            store.delete_file(path)
    done = df.mapInArrow(run, "file string, rows long").collect()  # one row for each file
    if not done and not (old and mode == "append"):
        store.create_dir(base, recursive=True)
        with store.open_output_stream(f"{base}/part-{name}00000.arrow") as sink:
            pa.ipc.new_file(sink, to_arrow_schema(df.schema)).close()
        done = [(f"{base}/part-{name}00000.arrow", 0)]
    return df.sparkSession.createDataFrame(done, "file string, rows long")
