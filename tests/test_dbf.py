"""Attribute tables of shapefiles: types, nulls, deleted records, byte ranges, and the splits that come from them."""

import datetime
import struct

import pytest

from setcast import cli
from setcast.sources import dbf, tables

FIELDS = (("id", "N", 6, 0), ("big", "N", 15, 0), ("value", "N", 12, 4), ("ratio", "F", 13, 6), ("name", "C", 10, 0), ("day", "D", 8, 0), ("flag", "L", 1, 0), ("raw", "O", 8, 0), ("count", "I", 4, 0))


def write(path, fields, rows, deleted=(), records=None):
    """rows of bytes for each field, as they are stored."""
    length = 1 + sum(f[2] for f in fields)
    head = struct.pack("<BBBBIHH20x", 3, 124, 1, 1, len(rows) if records is None else records, 32 + 32 * len(fields) + 1, length)
    for name, kind, size, decimals in fields:
        head += struct.pack("<11sc4xBB14x", name.encode(), kind.encode(), size, decimals)
    with open(path, "wb") as f:
        f.write(head + b"\r")
        for k, row in enumerate(rows):
            f.write(b"*" if k in deleted else b" ")
            for (_, kind, size, _), value in zip(fields, row, strict=True):
                f.write(value if kind in "OI" else value.ljust(size) if kind == "C" else value.rjust(size))


def record(k):
    return [str(k).encode(), str(k * 10**9).encode(), f"{k / 7:.4f}".encode(), f"{k:.6e}".encode(), f"né{k}".encode(), b"20240229", b"T" if k % 2 else b"n", struct.pack("<d", k / 3), struct.pack("<i", -k)]


def test_types_ranges_and_deleted_records(spark, tmp_path):
    path = f"{tmp_path}/a.dbf"
    write(path, FIELDS, [record(k) for k in range(500)], deleted={0, 7, 499})
    whole = dbf.read(spark, path)
    assert dict(whole.dtypes) == {"id": "int", "big": "bigint", "value": "double", "ratio": "double", "name": "string", "day": "date", "flag": "boolean", "raw": "double", "count": "int"}
    rows = sorted(whole.collect())
    assert len(rows) == 497 and rows[0] == (1, 10**9, 0.1429, 1.0, "né1", datetime.date(2024, 2, 29), True, 1 / 3, -1)
    parts = dbf.read(spark, path, range_bytes=1000)
    assert parts.rdd.getNumPartitions() > 20 and sorted(parts.collect()) == rows
    some = dbf.read(spark, f"file://{path}", ["count", "id"])
    assert some.columns == ["count", "id"] and sorted(r["id"] for r in some.collect()) == [r["id"] for r in rows]
    with pytest.raises(ValueError, match="no field other"):
        dbf.read(spark, path, ["other"])


def test_nulls_and_short_files(spark, tmp_path):
    path = f"{tmp_path}/b.dbf"
    blank = [b"", b"***************", b" . ", b"-", b"", b"00000000", b"?", struct.pack("<d", 1.5), struct.pack("<i", 2)]
    write(path, FIELDS, [blank, record(3)], records=9)
    got = sorted(dbf.read(spark, path).collect(), key=lambda r: r["count"])
    assert got[0][0] == 3 and tuple(got[1]) == (None, None, None, None, None, None, None, 1.5, 2)
    write(path, FIELDS, [])
    assert dbf.read(spark, path).collect() == []
    latin = f"{tmp_path}/c.dbf"
    write(latin, (("name", "C", 6, 0),), [["blåbær".encode("latin-1")]])
    assert dbf.read(spark, latin, encoding="latin-1").first()[0] == "blåbær"
    open(f"{tmp_path}/c.cpg", "w").write("ISO-8859-1")
    assert dbf.read(spark, latin).first()[0] == "blåbær"
    open(f"{tmp_path}/d.dbf", "wb").write(b"no table")
    with pytest.raises(Exception, match="no dBASE file"):
        dbf.read(spark, f"{tmp_path}/d.dbf").collect()


def test_splits_from_attribute_tables(spark, tmp_path):
    fields = (("embd_1", "F", 13, 6), ("lidar_1", "F", 13, 6), ("fallbck", "N", 4, 0), ("split", "C", 5, 0))
    for name, n in (("train", 60), ("val", 40), ("test", 30)):
        write(f"{tmp_path}/{name}_values.dbf", fields, [[f"{k % 3 + k / 900:.6f}".encode(), f"{k % 5:.6f}".encode() if k != 4 else b"", str(10 + k % 3).encode(), name.encode()] for k in range(n)])
    clean = tables.load_split(spark, str(tmp_path), "train")
    assert clean.dtypes == [("embd_1", "float"), ("lidar_1", "float"), ("code", "int")] and clean.count() == 59
    rows = tables.samples(spark, str(tmp_path))
    assert {r["split"]: r["count"] for r in rows.groupBy("split").count().collect()} == {"train": 59, "cal": 39, "test": 29}
    assert rows.select("sample_id").distinct().count() == 127 and len(rows.first()["features"]) == 2
    cli.main(["compare", "--data", str(tmp_path), "--out", f"{tmp_path}/out", "--alpha", "0.1"])
