import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from kvartal.sources import package as P
from kvartal.sources import sheets


def table(rows=5):
    return P.encode("stops", 1, "mini", "0.1", {"id": ("u64", np.arange(rows, dtype=np.uint64) + np.uint64(2**63)), "zone": ("u32", np.array([1, 2**32 - 1, 3, 4, 5][:rows])), "capacity": ("u32", np.array([7, 2**32 - 1, 2**32 - 2, 0, 9][:rows])), "x": ("f64", np.linspace(0, 1, rows))}, rows)


def test_round_trip(spark, tmp_path):
    (tmp_path / "a.mtab").write_bytes(table())
    got = P.read_table(spark, str(tmp_path), {"id": "u64", "zone": "u32", "capacity": "u32?", "x": "f64"}).orderBy("row").collect()
    assert [int(r.id) for r in got] == [2**63 + i for i in range(5)]
    assert [r.zone for r in got] == [1, None, 3, 4, 5]
    assert [(r.capacity, r.capacity_state) for r in got] == [(7, "value"), (None, "none"), (None, "unknown"), (0, "value"), (9, "value")]
    head, cols = P.decode(table())
    assert head["rows"] == 5 and P.encode("stops", 1, "mini", "0.1", cols, 5) == table()
    with pytest.raises(Exception, match="declared"):
        P.read_table(spark, str(tmp_path), {"id": "u64"}).collect()


@pytest.mark.parametrize("at, value", [(0, 0), (8, 9), (52, 0), (115, 1), (160, 99), (176, 1), (184, 255)])
def test_damage_is_refused(at, value):
    raw = bytearray(table())
    raw[at] = value
    with pytest.raises(P.PackageError):
        P.decode(bytes(raw))


def test_values_out_of_range_are_refused():
    for kind, v in (("u8", [256]), ("i16", [-40000]), ("f64", [float("nan")]), ("u32", [-1])):
        with pytest.raises(P.PackageError):
            P.encode("t", 1, "p", "1", {"c": (kind, np.array(v))}, 1)


def test_strict_json():
    assert P.strict_json(b'{"a": [1, 2.5]}') == {"a": [1, 2.5]}
    for bad in (b'{"a": 1, "a": 2}', b"[NaN]", b"[1e999]", b"[Infinity]", b"{"):
        with pytest.raises(ValueError):
            P.strict_json(bad)


def test_layers_and_hashes(spark, tmp_path):
    df = spark.createDataFrame([(i, f"n{i}") for i in range(20)], "id long, name string")
    P.write_layer(df, str(tmp_path / "csv"), ["id"])
    assert P.read_layer(spark, str(tmp_path / "csv"), "id long, name string").exceptAll(df).count() == 0
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "x.geojsonl").write_text('{"type":"Feature","properties":{"id":1,"name":"a"}}\n{"type":"Other","properties":{"id":2}}\n')
    assert [tuple(r) for r in P.read_properties(spark, str(tmp_path / "f"), "id: bigint, name: string").collect()] == [(1, "a")]
    cat = spark.createDataFrame([("x.geojsonl", 83, "0" * 64), ("y", 1, "")], "path string, size long, sha256 string")
    assert {r.path: r.fault for r in P.verify(spark, str(tmp_path / "f"), cat).collect()}["y"] == "missing"


def test_sheets(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>City</t></si><si><t>Be</t><t>lt</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c></row><row r="2"><c r="A2" t="inlineStr"><is><t>0-4</t></is></c><c r="AB2"><v>12</v></c></row><row r="3"><c r="A3" t="s"><v>1</v></c></row><row r="4"><c r="B4"><v>-</v></c></row></sheetData></worksheet>')
    (tmp_path / "b.xlsx").write_bytes(buf.getvalue())
    got = sheets.blocks(sheets.read_sheets(spark, str(tmp_path)), ["city", "belt"]).select("row", "col", "text", "block").orderBy("row", "col").collect()
    assert [tuple(r) for r in got] == [(0, 0, "City", "City"), (1, 0, "0-4", "City"), (1, 27, "12", "City"), (2, 0, "Belt", "Belt"), (3, 1, "-", "Belt")]
    nums = spark.createDataFrame([("1 234",), ("-",), ("",), ("2.5",), ("x",), (None,)], "t string").select(sheets.number(F.col("t")).alias("n"))
    assert [r.n for r in nums.collect()] == [1234, 0, 0, None, None, 0]
