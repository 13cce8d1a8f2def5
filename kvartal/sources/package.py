"""City packages: typed column tables in binary files, a catalogue of hashes, strict JSON, text layers.

Binary tables are decoded and encoded in Arrow batches, a file a row, so that a package of
any number of files is read in parallel; the format is fixed and little-endian.
"""

from __future__ import annotations

import json
import math
import struct
import uuid
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kvartal.operators.rules import Rules

# Fixed values of the table format, version 1.
MAGIC = b"MESMTAB\0"
HEADER, COLUMN, ALIGN, MOST_COLUMNS = 128, 64, 64, 256
TYPES = ("u8", "u16", "u32", "u64", "i8", "i16", "i32", "i64", "f32", "f64")

_DTYPE = {t: np.dtype("<" + t[0] + str(int(t[1:]) // 8)) for t in TYPES}
_SPARK = {"u8": "smallint", "u16": "int", "u32": "bigint", "u64": "decimal(20,0)", "i8": "tinyint", "i16": "smallint", "i32": "int", "i64": "bigint", "f32": "float", "f64": "double"}


class PackageError(ValueError):
    """A file breaks the format or a rule of its table."""


def sentinel(kind: str) -> tuple[int, int] | None:
    """(none, unknown) of an unsigned type: its two largest values."""
    return ((1 << int(kind[1:])) - 1, (1 << int(kind[1:])) - 2) if kind[0] == "u" else None


def encode(name: str, version: int, package: str, release: str, columns: dict[str, tuple[str, np.ndarray]], rows: int) -> bytes:
    """One table as bytes. Values out of a type's range, NaN and infinities are errors."""
    if not 1 <= len(columns) <= MOST_COLUMNS or rows >= 1 << 31:
        raise PackageError(f"{name}: {len(columns)} columns, {rows} rows")
    size = -(-(HEADER + COLUMN * len(columns)) // ALIGN) * ALIGN
    head = bytearray(MAGIC + struct.pack("<II32sIIQ32s16s16x", 1, size, name.encode(), version, len(columns), rows, package.encode(), release.encode()))
    body, at = bytearray(), size
    for c, (kind, values) in columns.items():
        values = np.asarray(values)
        cast = values.astype(_DTYPE[kind])
        if kind[0] == "f":
            if not np.isfinite(values).all():
                raise PackageError(f"{name}.{c}: not finite")
        elif len(values) and not all(int(a) == int(b) for a, b in ((values.min(), cast.min()), (values.max(), cast.max()))):
            raise PackageError(f"{name}.{c}: out of range of {kind}")
        raw = cast.tobytes()
        head += struct.pack("<32sB7xQQQ", c.encode(), TYPES.index(kind) + 1, len(cast), at, len(raw))
        body += raw + b"\0" * (-len(raw) % ALIGN)
        at = size + len(body)
    return bytes(head) + b"\0" * (size - len(head)) + bytes(body)


def decode(data: bytes) -> tuple[dict, dict[str, tuple[str, np.ndarray]]]:
    """Header and columns of a table, after all structural checks."""
    if len(data) < HEADER or data[:8] != MAGIC:
        raise PackageError("no table")
    form, size, name, version, n, rows, package, release = struct.unpack_from("<II32sIIQ32s16s", data, 8)
    if form != 1 or not 1 <= n <= MOST_COLUMNS or rows >= 1 << 31 or size % ALIGN or size != -(-(HEADER + COLUMN * n) // ALIGN) * ALIGN or len(data) < size or any(data[112:128]):
        raise PackageError("header")
    text = lambda b: b.rstrip(b"\0").decode("ascii")
    head = {"name": text(name), "schema_version": version, "rows": rows, "package": text(package), "release": text(release)}
    columns, end = {}, size
    for i in range(n):
        cname, kind, count, at, length = struct.unpack_from("<32sB7xQQQ", data, HEADER + COLUMN * i)
        if not 1 <= kind <= len(TYPES) or at % ALIGN or at < end or length > len(data) or at > len(data) - length or length != count * _DTYPE[TYPES[kind - 1]].itemsize:
            raise PackageError(f"column {i}")
        values = np.frombuffer(data, _DTYPE[TYPES[kind - 1]], count, at)
        if values.dtype.kind == "f" and not np.isfinite(values).all():
            raise PackageError(f"{text(cname)}: not finite")
        columns[text(cname)] = (TYPES[kind - 1], values)
        end = at + length
    return head, columns


def read_table(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """Rows of the binary tables at ``path`` with the declared columns; others, missing or retyped ones are errors.

    The none value of unsigned columns is null. A column in which values can be unknown
    has a second one, ``<name>_state``: value, none or unknown; declare it as ``u32?``.
    Only columns with a value a row can be read so; lists of a pool are read by ``read_pool``.
    """
    fields = ["row bigint"]
    for c, k in columns.items():
        fields.append(f"`{c}` {_SPARK[k.rstrip('?')]}")
        if k.endswith("?"):
            fields.append(f"`{c}_state` string")
    schema = T.StructType.fromDDL(", ".join(fields))
    arrow = {f.name: f.dataType for f in schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        for b in batches:
            for data in b.column("content"):
                head, got = decode(data.as_py())
                if {c: k for c, (k, _) in got.items()} != {c: k.rstrip("?") for c, k in columns.items()}:
                    raise PackageError(f"{head['name']}: other columns than declared")
                for lo in range(0, max(head["rows"], 1), 1 << 16):
                    n = min(1 << 16, head["rows"] - lo)
                    out = {"row": pa.array(np.arange(lo, lo + n, dtype=np.int64))}
                    for c, declared in columns.items():
                        kind, v = got[c]
                        v = v[lo : lo + n]
                        marks = sentinel(kind)
                        mask = np.isin(v, marks) if marks and declared.endswith("?") else v == marks[0] if marks else None
                        values = v if kind != "u64" else np.array([int(x) for x in v], dtype=object)
                        want = to_arrow_type(arrow[c])
                        out[c] = pa.array([None if m else Decimal(int(x)) for x, m in zip(values, mask)], want) if kind == "u64" else pa.array(values, mask=mask).cast(want)
                        if declared.endswith("?"):
                            out[f"{c}_state"] = pa.array(np.where(v == marks[0], "none", np.where(v == marks[1], "unknown", "value")), pa.string())
                    yield pa.RecordBatch.from_pydict(out)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def read_pool(spark: SparkSession, path: str, offsets: str, pool: str) -> DataFrame:
    """(row, pos, value) of the lists that a column of offsets (one more than rows) cuts a pool column into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column("content"):
                head, got = decode(data.as_py())
                at, values = got[offsets][1].astype(np.int64), got[pool][1]
                if len(at) != head["rows"] + 1 or at[0] != 0 or at[-1] != len(values) or (np.diff(at) < 0).any():
                    raise PackageError(f"{head['name']}: {offsets} do not cut {pool}")
                for lo in range(0, len(values), 1 << 16):
                    k = np.arange(lo, min(lo + (1 << 16), len(values)))
                    row = np.searchsorted(at, k, side="right") - 1
                    yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(k - at[row]), pa.array(values[k].astype(np.int64))], names=["row", "pos", "value"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "row long, pos long, value long")


def verify(spark: SparkSession, folder: str, catalogue: DataFrame) -> DataFrame:
    """(path, fault) of files of a catalogue (path below the folder, size, sha256) that are missing or differ."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    base = "/" + folder.rstrip("/").rpartition("/")[2] + "/"
    found = files.select(F.substring_index("path", base, -1).alias("path"), F.col("length").alias("got_size"), F.sha2("content", 256).alias("got_sha"))
    both = catalogue.join(found, "path", "left")
    fault = F.when(F.col("got_size").isNull(), "missing").when(F.col("size") != F.col("got_size"), "size").when(F.col("sha256") != F.col("got_sha"), "hash")
    return both.select("path", fault.alias("fault")).where(F.col("fault").isNotNull())


#: Bytes that a manifest or index may have: they are read by the driver.
MOST_JSON = 16 << 20


def document(spark: SparkSession, path: str) -> object:
    """A small strict JSON document of a package; its size is looked at before its content."""
    files = spark.read.format("binaryFile").load(path)
    size = files.select("length").first()
    if size is None or size[0] > MOST_JSON:
        raise PackageError(f"{path}: {'missing' if size is None else 'too large'}")
    return strict_json(bytes(files.select("content").first()[0]), MOST_JSON)


def write_document(spark: SparkSession, path: str, value: object) -> None:
    """A JSON document with sorted keys, put in the place of an older one in one step."""
    text = (json.dumps(value, sort_keys=True, ensure_ascii=False, indent=1, allow_nan=False) + "\n").encode()
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    to, tmp = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), conf)
    flags = jvm.java.util.EnumSet.of(jvm.org.apache.hadoop.fs.CreateFlag.CREATE)
    out = files.create(tmp, flags, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.CreateOpts, 0))
    out.write(bytearray(text))
    out.close()
    replace = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    replace[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files.rename(tmp, to, replace)


def load_package(spark: SparkSession, folder: str, rules: Callable[[Rules, dict[str, DataFrame]], Rules] | None = None) -> dict[str, DataFrame]:
    """All tables of a package, or an error that names every fault: nothing is loaded in part.

    ``manifest.json`` names the index; the index lists tables with path, size, sha256, rows
    and columns (name to type). Files are verified, then decoded against their declared
    columns, then ``rules`` over all tables must hold.
    """
    manifest = document(spark, f"{folder}/manifest.json")
    index = document(spark, f"{folder}/{manifest['index']}")
    listed = index["tables"]
    names = [t["name"] for t in listed]
    faults = [f"{n}: listed twice" for n in sorted({n for n in names if names.count(n) > 1})]
    faults += [f"{t['path']}: outside the package" for t in listed if t["path"].startswith("/") or ".." in t["path"].split("/")]
    if index.get("package") != manifest.get("package_id"):
        faults.append("index of another package")
    if not faults:
        catalogue = spark.createDataFrame([(t["path"], t["size"], t["sha256"]) for t in listed], "path string, size long, sha256 string")
        faults = [f"{r.path}: {r.fault}" for r in verify(spark, folder, catalogue).orderBy("path").collect()]
    if faults:
        raise PackageError("; ".join(faults))
    tables = {t["name"]: read_table(spark, f"{folder}/{t['path']}", t["columns"]) for t in listed}
    check = Rules()
    for t in listed:
        check.count(f"{t['name']}: {t['rows']} rows", tables[t["name"]], t["rows"])
    report = (rules(check, tables) if rules else check).report()
    broken = [f"{r.check_name}: {r.violations}" for r in report.where("violations > 0").orderBy("check_name").collect()]
    if broken:
        raise PackageError("; ".join(broken))
    return tables


def strict_json(data: bytes, most: int = 64 << 20) -> object:
    """A JSON document in UTF-8; repeated keys, NaN and infinities are errors."""
    if len(data) > most:
        raise PackageError(f"document over {most} bytes")

    def pairs(items: list) -> dict:
        out = dict(items)
        if len(out) != len(items):
            raise PackageError("repeated key")
        return out

    def number(x: str) -> float:
        v = float(x)
        if not math.isfinite(v):
            raise PackageError("number out of range")
        return v

    def constant(x: str) -> None:
        raise PackageError(f"{x} is no number")

    return json.loads(data.decode("utf-8"), object_pairs_hook=pairs, parse_float=number, parse_constant=constant)


def read_layer(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A text layer in CSV with a header (also .gz), of exactly the declared columns."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).csv(path)


def read_properties(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The properties of features, one a line."""
    rows = spark.read.schema(f"type string, properties struct<{schema}>").option("mode", "FAILFAST").json(path)
    return rows.where("type = 'Feature'").select("properties.*")


def write_layer(df: DataFrame, path: str, order: list[str]) -> None:
    """A text layer in a stable order: parts sorted by range, so that no task writes all."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.option("header", True).option("emptyValue", "").option("compression", "gzip").csv(path)
