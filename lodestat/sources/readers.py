"""File readers by format, header clean-up, nested-record flattening and file checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestat.functions.expr import as_col

DELIMITERS = [",", ";", "\t", "|"]
SNIFF_BYTES = 100_000


def _head(spark: SparkSession, path: str, size: int = SNIFF_BYTES) -> bytes:
    """First bytes of the first file under the path, read through Hadoop so any file system works."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    if fs.getFileStatus(target).isDirectory():
        names = sorted(s.getPath().toString() for s in fs.listStatus(target)
                       if s.isFile() and not s.getPath().getName().startswith(("_", ".")))
        target = jvm.org.apache.hadoop.fs.Path(names[0])
    stream = fs.open(target)
    try:
        return bytes(stream.readNBytes(size))
    finally:
        stream.close()


def sniff_encoding(head: bytes) -> str:
    if head.startswith((b"\xff\xfe", b"\xfe\xff")):
        return "UTF-16"
    try:
        head.decode("utf-8")
        return "UTF-8"
    except UnicodeDecodeError as e:
        # a character cut at the end of the sample is not evidence against UTF-8
        return "UTF-8" if e.start >= len(head) - 3 else "ISO-8859-1"


def sniff_delimiter(head: bytes, encoding: str = "UTF-8") -> str:
    text = head[:10_000].decode(encoding, errors="replace")
    counts = {d: text.count(d) for d in DELIMITERS}
    best = max(DELIMITERS, key=lambda d: counts[d])
    return best if counts[best] else ","


def clean_header(df: DataFrame) -> DataFrame:
    return df.toDF(*header_names(df.columns))


BAD_LINE = "_bad_line"


def quotes_span_lines(spark: SparkSession, path: str) -> bool:
    """Whether a quoted field may go on in the next line: some line has an odd number of quotes. All lines are looked at."""
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    return not spark.read.text(path).where(quotes % 2 == 1).isEmpty()


def read_csv(spark: SparkSession, path: str, delimiter: str | None = None, encoding: str | None = None,
             infer: bool = True, keep_bad_lines: bool = False) -> DataFrame:
    """CSV with sniffed encoding and delimiter; lines that do not fit the header are set aside, not fatal."""
    head = _head(spark, path)
    encoding = encoding or sniff_encoding(head)
    delimiter = delimiter or sniff_delimiter(head, encoding)
    options = dict(header=True, sep=delimiter, encoding=encoding, multiLine=quotes_span_lines(spark, path), quote='"', escape='"')
    plain = spark.read.csv(path, inferSchema=infer, enforceSchema=True, **options)
    # Spark itself numbers blank headers and suffixes repeated ones; undo that before our own naming
    first = head.decode(encoding, errors="replace").splitlines()[0] if head else ""
    raw = [h.strip().strip('"') for h in first.split(delimiter)]
    schema = plain.schema
    if len(raw) == len(schema.fields):
        schema = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(schema.fields)])
    else:
        raw = plain.columns
    kept = T.StructType([*schema.fields, T.StructField(BAD_LINE, T.StringType())])
    df = spark.read.schema(kept).option("columnPruning", False).csv(
        path, mode="PERMISSIVE", columnNameOfCorruptRecord=BAD_LINE, **options)
    good = df.where(F.col(BAD_LINE).isNull()).drop(BAD_LINE).toDF(*header_names(raw))
    if keep_bad_lines:
        # Spark refuses plans that read nothing but this column, so the filter also touches a data column
        return df.where(F.col(BAD_LINE).isNotNull() & (F.xxhash64(df.columns[0]) >= -(2 ** 63)))
    return good


def header_names(raw: list[str]) -> list[str]:
    """Strip names, number blank ones and suffix repeated ones."""
    seen: dict[str, int] = {}
    out = []
    for i, r in enumerate(raw):
        name = (r or "").strip() or f"Colonne_{i + 1}"
        seen[name] = seen.get(name, -1) + 1
        out.append(name if seen[name] == 0 else f"{name}_{seen[name]}")
    return out


def flatten(df: DataFrame, depth: int = 3) -> DataFrame:
    """Nested records as dotted columns, up to `depth` levels; deeper ones become JSON text."""
    for level in range(depth + 1):
        nested = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StructType)]
        if not nested:
            break
        cols = []
        for f in df.schema.fields:
            if f.name not in nested:
                cols.append(as_col(f.name))
            elif level == depth:
                cols.append(F.to_json(as_col(f.name)).alias(f.name))
            else:
                cols += [F.col(f"`{f.name}`.`{g.name}`").alias(f"{f.name}.{g.name}") for g in f.dataType.fields]
        df = df.select(*cols)
    return df


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """An array of records, one record, or an object whose first list holds the records.

    A JSON document cannot be split, so one file is one task; large data belongs in JSON Lines.
    """
    df = spark.read.json(path, multiLine=True)
    head = _head(spark, path, 4096).decode("utf-8", errors="replace").lstrip("﻿ \n\r\t")
    if head.startswith("{"):
        lists = [f.name for f in df.schema.fields
                 if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)]
        if lists:
            first = min(lists, key=lambda n: head.find(f'"{n}"') if f'"{n}"' in head else len(head))
            df = df.select(F.inline(as_col(first)))
    return clean_header(flatten(df))


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    return clean_header(flatten(spark.read.json(path)))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


READERS: dict[str, Callable[..., DataFrame]] = {
    "csv": read_csv, "json": read_json, "jsonl": read_json_lines, "parquet": read_parquet,
}


def read_table(spark: SparkSession, path: str, **options) -> DataFrame:
    """Read by file extension."""
    ext = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if ext not in READERS:
        raise ValueError(f"unsupported format .{ext}; known: {', '.join(sorted(READERS))}")
    return READERS[ext](spark, path, **options)


def drop_excluded(df: DataFrame, excluded: list[str]) -> DataFrame:
    return df.drop(*[c for c in excluded if c in df.columns])


def preview(df: DataFrame, order: list[str], n: int = 50) -> DataFrame:
    """First rows in a stated order; n is held between 1 and 250."""
    return df.orderBy(*[as_col(c) for c in order]).limit(min(250, max(1, n)))


def check_magic(spark: SparkSession, path: str) -> DataFrame:
    """Does each file's first bytes fit its extension? (path, extension, valid)

    Only file heads are read, by tasks, one per listed file.
    """
    files = spark.read.format("binaryFile").load(path)
    ext = F.lower(F.element_at(F.split("path", "\\."), -1))
    start = F.substring("content", 1, 512)
    text = F.trim(F.decode(start, "UTF-8"))
    ok = (F.when(ext == "parquet", F.decode(F.substring("content", 1, 4), "ISO-8859-1") == "PAR1")
          .when(ext.isin("json", "jsonl"), text.startswith("{") | text.startswith("["))
          .when(ext == "csv", F.length(start) > 0).otherwise(False))
    return files.select("path", ext.alias("extension"), ok.alias("valid"))


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def json_rows(df: DataFrame) -> DataFrame:
    """Each row as one JSON object; NaN and infinities become null."""
    def clean(f: T.StructField):
        c = as_col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c).alias(f.name)
        return c

    fields = [clean(f) for f in df.schema.fields]
    return df.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("json"))


def export_json(df: DataFrame, path: str) -> None:
    json_rows(df).write.mode("overwrite").text(path)
