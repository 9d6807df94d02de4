import json
import struct

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from colonnade.sources import files
from colonnade.sources.lakehouse import read_avro, read_delta, read_iceberg
from colonnade.streaming.stream import Stream, scan_ipc


def test_csv_types(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('i,f,b,d,t,s,e,n\n1,1.5,true,2024-01-02,2024-01-02 03:04:05,"x,""y""",,7\n-2,2,false,2024-02-03,2024-01-02T03:04:05,z,,\n')
    got = files.read_csv(spark, str(p))
    assert dict(got.dtypes) == {"i": "bigint", "f": "double", "b": "boolean", "d": "date", "t": "timestamp_ntz", "s": "string", "e": "void", "n": "bigint"}
    assert got.collect()[0]["s"] == 'x,"y"'
    assert files.read_csv(spark, str(p), include_columns=["s", "zz"], include_missing=True).columns == ["s", "zz"]
    with pytest.raises(KeyError):
        files.read_csv(spark, str(p), include_columns=["zz"])
    assert files.read_csv(spark, str(p), header=False).columns[0] == "f0"
    assert files.read_csv(spark, str(p), column_types={"i": "string"}).schema["i"].dataType.simpleString() == "string"


def test_json_order_and_conflicts(spark, tmp_path):
    p = tmp_path / "a.json"
    p.write_text('{"z": 1, "a": "x"}\n{"a": "y", "m": {"k": [1, 2]}, "t": "2024-01-02T03:04:05"}\n')
    got = files.read_json(spark, str(p))
    assert got.columns == ["z", "a", "m", "t"] and dict(got.dtypes)["t"] == "timestamp_ntz"
    assert files.read_json(spark, str(p), "a string", "ignore").columns == ["a"]
    with pytest.raises(ValueError):
        files.read_json(spark, str(p), "a string", "error")
    (tmp_path / "b.json").write_text('{"a": 1}\n{"a": "x"}\n')
    with pytest.raises(ValueError):
        files.read_json(spark, str(tmp_path / "b.json"))


def test_ipc(spark, tmp_path):
    t = pa.table({"d": pa.array(["a", "b", None]).dictionary_encode(), "u": pa.array([1, 2, None], pa.uint32()), "l": [[1], [], None], "ts": pa.array([1, 2, 3], pa.timestamp("ms"))})
    for n, make in enumerate((pa.ipc.new_file, pa.ipc.new_stream)):
        with make(str(tmp_path / f"{n}.arrow"), t.schema) as w:
            w.write_table(t)
    got = scan_ipc(spark, str(tmp_path)).df
    assert got.count() == 6 and dict(got.dtypes)["u"] == "bigint"
    out = tmp_path / "out"
    done = Stream(got.repartition(2)).sink_ipc(f"file://{out}")
    assert sum(r["rows"] for r in done.collect()) == 6
    assert files.read_ipc(spark, str(out)).where("d = 'a'").count() == 2


def test_parquet_metadata_and_filters(spark, tmp_path):
    pq.write_table(pa.table({"a": [1, None, 3], "s": [{"x": 1}, {"x": 2}, None]}), tmp_path / "p.parquet", row_group_size=2)
    meta = files.parquet_metadata(spark, str(tmp_path / "p.parquet")).where("column = 'a'").orderBy("row_group").collect()
    assert [(r["rows"], r["nulls"]) for r in meta] == [(2, 1), (1, 0)]
    assert files.read_parquet(spark, str(tmp_path / "p.parquet"), ["a", "s.x"], [("a", ">", 2)]).collect()[0]["s_x"] is None


@pytest.fixture
def delta(tmp_path):
    log = tmp_path / "t" / "_delta_log"
    log.mkdir(parents=True)
    field = lambda n, t: {"name": n, "type": t, "nullable": True, "metadata": {}}
    schema = json.dumps({"type": "struct", "fields": [field("id", "long"), field("v", "double"), field("p", "string")]})
    add = lambda path, part, lo, hi: {"add": {"path": path, "partitionValues": {"p": part}, "size": 1, "modificationTime": 0, "dataChange": True, "stats": json.dumps({"numRecords": 2, "minValues": {"id": lo}, "maxValues": {"id": hi}})}}
    for n, part in enumerate(["x", "y"]):
        (tmp_path / "t" / f"p={part}").mkdir()
        pq.write_table(pa.table({"id": [n * 10, n * 10 + 1], "v": [0.5, None]}), tmp_path / "t" / f"p={part}" / f"f{n}.parquet")
    pq.write_table(pa.table({"id": [99]}), tmp_path / "t" / "g.parquet")
    write = lambda v, *actions: (log / f"{v:020d}.json").write_text("\n".join(map(json.dumps, actions)))
    write(0, {"protocol": {"minReaderVersion": 1, "minWriterVersion": 2}}, {"metaData": {"id": "t", "format": {"provider": "parquet"}, "schemaString": schema, "partitionColumns": ["p"]}}, add("p=x/f0.parquet", "x", 0, 1))
    write(1, add("p=y/f1.parquet", "y", 10, 11))
    write(2, {"remove": {"path": "p=x/f0.parquet", "dataChange": True}}, add("g.parquet", None, 99, 99))
    return str(tmp_path / "t"), write


def test_delta(spark, delta):
    path, write = delta
    rows = lambda df: sorted((r["id"], r["v"], r["p"]) for r in df.collect())
    assert [r[0] for r in rows(read_delta(spark, path, 0))] == [0, 1]
    assert sorted(r["id"] for r in read_delta(spark, path, 1).collect()) == [0, 1, 10, 11]
    last = {r["id"]: r["p"] for r in read_delta(spark, path).collect()}
    assert last == {10: "y", 11: "y", 99: None}
    assert read_delta(spark, path, filters=[("id", ">", 50)]).inputFiles()[0].endswith("g.parquet")
    assert read_delta(spark, path, columns=["p"], filters=[("p", "=", "y")]).count() == 2
    with pytest.raises(ValueError):
        read_delta(spark, path, 7)
    write(3, {"add": {"path": "g.parquet", "partitionValues": {}, "size": 1, "modificationTime": 0, "dataChange": True, "deletionVector": {"storageType": "u"}}})
    with pytest.raises(ValueError):
        read_delta(spark, path)


def _zigzag(n):
    n = (n << 1) ^ (n >> 63)
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def _text(s):
    raw = s.encode() if isinstance(s, str) else s
    return _zigzag(len(raw)) + raw


def _avro_file(schema, rows):
    meta = {"avro.schema": json.dumps(schema), "avro.codec": "null"}
    head = b"Obj\x01" + _zigzag(len(meta)) + b"".join(_text(k) + _text(v) for k, v in meta.items()) + b"\x00" + b"m" * 16
    body = b"".join(rows)
    return head + _zigzag(len(rows)) + _zigzag(len(body)) + body + b"m" * 16


@pytest.fixture
def iceberg(tmp_path):
    t = tmp_path / "ice"
    (t / "metadata").mkdir(parents=True)
    (t / "data").mkdir()
    schema = pa.schema([pa.field("old_name", pa.int64(), metadata={"PARQUET:field_id": "1"}), pa.field("s", pa.string(), metadata={"PARQUET:field_id": "2"})])
    for n in range(2):
        pq.write_table(pa.table([[n * 10, n * 10 + 1], ["a", None]], schema=schema), t / "data" / f"{n}.parquet")
    bound = {"type": "array", "items": {"type": "record", "name": "kv", "fields": [{"name": "key", "type": "int"}, {"name": "value", "type": "bytes"}]}}
    data = {"type": "record", "name": "r2", "fields": [{"name": "content", "type": "int"}, {"name": "file_path", "type": "string"}, {"name": "lower_bounds", "type": ["null", bound]}, {"name": "upper_bounds", "type": ["null", {"type": "array", "items": "kv"}]}]}
    entry = {"type": "record", "name": "entry", "fields": [{"name": "status", "type": "int"}, {"name": "data_file", "type": data}]}
    pair = lambda v: _zigzag(1) + _zigzag(1) + _zigzag(1) + _text(struct.pack("<q", v)) + _zigzag(0)
    row = lambda n, content=0: _zigzag(1) + _zigzag(content) + _text(f"file:/w/data/{n}.parquet") + pair(n * 10) + pair(n * 10 + 1)

    def write(content=0):
        (t / "metadata" / "m.avro").write_bytes(_avro_file(entry, [row(0), row(1, content)]))
        (t / "metadata" / "list.avro").write_bytes(_avro_file({"type": "record", "name": "m", "fields": [{"name": "manifest_path", "type": "string"}]}, [_text("file:/w/metadata/m.avro")]))
        fields = [{"id": 1, "name": "id", "required": False, "type": "long"}, {"id": 2, "name": "s", "required": False, "type": "string"}, {"id": 3, "name": "new", "required": False, "type": "double"}]
        meta = {"format-version": 2, "location": "file:/w", "current-schema-id": 0, "schemas": [{"schema-id": 0, "type": "struct", "fields": fields}], "current-snapshot-id": 5, "snapshots": [{"snapshot-id": 5, "manifest-list": "file:/w/metadata/list.avro"}]}
        (t / "metadata" / "v1.metadata.json").write_text(json.dumps(meta))

    write()
    return str(t), write


def test_iceberg(spark, iceberg):
    path, write = iceberg
    got = read_iceberg(spark, path)
    assert got.columns == ["id", "s", "new"] and sorted(r["id"] for r in got.collect()) == [0, 1, 10, 11]
    assert len(read_iceberg(spark, path, filters=[("id", ">", 5)]).inputFiles()) == 1
    with pytest.raises(ValueError):
        read_iceberg(spark, path, 6)
    write(content=1)
    with pytest.raises(ValueError):
        read_iceberg(spark, path)


def test_avro_types():
    schema = {"type": "record", "name": "r", "fields": [{"name": "a", "type": ["null", "double"]}, {"name": "m", "type": {"type": "map", "values": "long"}}, {"name": "f", "type": {"type": "fixed", "name": "fx", "size": 2}}, {"name": "g", "type": "fx"}, {"name": "e", "type": {"type": "enum", "name": "en", "symbols": ["x", "y"]}}]}
    row = _zigzag(1) + struct.pack("<d", 1.5) + _zigzag(1) + _text("k") + _zigzag(-3) + _zigzag(0) + b"hi" + b"ho" + _zigzag(1)
    assert read_avro(_avro_file(schema, [row])) == [{"a": 1.5, "m": {"k": -3}, "f": b"hi", "g": b"ho", "e": "y"}]


def test_delta_partitions_with_equal_file_names(spark, tmp_path):
    import json
    import urllib.parse

    import pyarrow as pa
    import pyarrow.parquet as pq

    from colonnade.sources.lakehouse import read_delta

    at = tmp_path / "tab le"
    (at / "_delta_log").mkdir(parents=True)
    fields = [{"name": "id", "type": "long", "nullable": True, "metadata": {}}, {"name": "p", "type": "string", "nullable": True, "metadata": {}}, {"name": "k", "type": "integer", "nullable": True, "metadata": {}}]
    log = [{"protocol": {"minReaderVersion": 1, "minWriterVersion": 2}}, {"metaData": {"id": "t", "format": {"provider": "parquet"}, "schemaString": json.dumps({"type": "struct", "fields": fields}), "partitionColumns": ["p", "k"]}}]
    for n, (p, k) in enumerate([("a", "1"), ("b c", "2"), ("d%", "10"), (None, None)]):
        folder = f"p={urllib.parse.quote(p) if p else '__HIVE_DEFAULT_PARTITION__'}/k={k}"
        (at / folder).mkdir(parents=True)
        pq.write_table(pa.table({"id": [2 * n, 2 * n + 1]}), at / folder / "part-00000.parquet")
        log.append({"add": {"path": urllib.parse.quote(f"{folder}/part-00000.parquet"), "partitionValues": {"p": p, "k": k}, "size": 1, "modificationTime": 0, "dataChange": True}})
    (at / "_delta_log" / f"{0:020d}.json").write_text("\n".join(map(json.dumps, log)))
    got = sorted((r["id"], r["p"], r["k"]) for r in read_delta(spark, str(at)).collect())
    assert got == [(0, "a", 1), (1, "a", 1), (2, "b c", 2), (3, "b c", 2), (4, "d%", 10), (5, "d%", 10), (6, None, None), (7, None, None)]
    for filters, ids in ([("p", "=", "a")], [0, 1]), ([("k", ">", 5)], [4, 5]), ([("k", "<", 5), ("p", ">=", "b")], [2, 3]):
        df = read_delta(spark, str(at), filters=filters)
        assert sorted(r["id"] for r in df.collect()) == ids and len(df.inputFiles()) == 1


def test_csv_quoted_line_ends(spark, tmp_path):
    from colonnade.sources.files import read_csv

    (tmp_path / "a.csv").write_text('n,t\n1,"x\ny"\n2,z\n3,"he said ""so"""\n')
    df = read_csv(spark, str(tmp_path / "a.csv"))
    assert dict(df.dtypes)["n"] == "bigint" and sorted(map(tuple, df.collect())) == [(1, "x\ny"), (2, "z"), (3, 'he said "so"')]


def test_ipc_modes_and_empty_tables(spark, tmp_path):
    from colonnade.sources.files import read_ipc, write_ipc

    uri = f"file://{tmp_path}/ipc"
    write_ipc(spark.range(10).repartition(4), uri)
    write_ipc(spark.range(3).coalesce(1), uri)
    assert read_ipc(spark, uri).count() == 3
    write_ipc(spark.range(2), uri, mode="append")
    assert read_ipc(spark, uri).count() == 5
    with pytest.raises(FileExistsError):
        write_ipc(spark.range(1), uri, mode="error")
    write_ipc(spark.range(5).where("id < 0"), uri)
    assert read_ipc(spark, uri).count() == 0 and read_ipc(spark, uri).columns == ["id"]
