"""Readers: delimited files, folders of files, splits, annotations, image folders, masters.

Formats that need a package which may be absent (Excel, EXIF) say so when they are used, not on import.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import measurement_columns, with_derived
from ..operators.cleaning import known_trails, running_id, with_case, with_normal_names

ANNOTATION = "image_path string, landmarks array<struct<x: double, y: double, visible: boolean>>, metadata map<string, string>, measurements map<string, double>, pixels_per_cm double, scale_points array<array<struct<x: double, y: double>>>, transforms array<array<double>>"


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: str | None = None, sep: str = ",") -> DataFrame:
    """A delimited file with a header; with a schema the file is read once, else twice."""
    r = spark.read.option("header", True).option("sep", sep)
    return (r.schema(schema) if schema else r.option("inferSchema", True)).csv(path)


def sheet_rows(content: bytes, sheet: int | str = 0) -> list[list]:
    """Cells of a sheet of an .xlsx file, row by row: texts, numbers and truth values; missing cells are None.

    Dates are the numbers that the file holds.  An unknown sheet is an error.
    """
    import re
    import zipfile
    from io import BytesIO
    from xml.etree import ElementTree

    tag = lambda e: e.tag.rpartition("}")[2]
    text = lambda e: "".join(t.text or "" for t in e.iter() if tag(t) == "t")
    with zipfile.ZipFile(BytesIO(content)) as z:
        read = lambda n: ElementTree.fromstring(z.read(n)) if n in z.namelist() else None
        strings = read("xl/sharedStrings.xml")
        shared = [] if strings is None else [text(e) for e in strings]
        names = [(e.get("name"), next(v for k, v in e.attrib.items() if k.endswith("}id"))) for e in read("xl/workbook.xml").iter() if tag(e) == "sheet"]
        targets = {e.get("Id"): e.get("Target") for e in read("xl/_rels/workbook.xml.rels")}
        known = dict(names) | {k: r for k, (_, r) in enumerate(names)}
        if sheet not in known:
            raise ValueError(f"no sheet {sheet!r}; there are {', '.join(n for n, _ in names)}")
        target = targets[known[sheet]].lstrip("/")
        root = read(target if target.startswith("xl/") else f"xl/{target}")
    out = []
    for row in (e for e in root.iter() if tag(e) == "row"):
        cells: dict[int, object] = {}
        for c in row:
            letters, at = re.match(r"[A-Z]*", c.get("r", ""))[0], 0
            for x in letters:
                at = at * 26 + ord(x) - 64
            at = at - 1 if letters else len(cells)
            v = next((e.text for e in c if tag(e) == "v"), None)
            kind = c.get("t", "n")
            if kind == "inlineStr":
                cells[at] = text(c)
            elif v is not None:
                cells[at] = shared[int(v)] if kind == "s" else v == "1" if kind == "b" else v if kind in ("str", "e") else float(v)
        out.append([cells.get(k) for k in range(max(cells, default=-1) + 1)])
    return out


def read_excel(spark: SparkSession, path: str, sheet: int | str = 0) -> DataFrame:
    """A sheet of an .xlsx file, its first row naming the columns: numbers, truth values or texts by column.

    A column of mixed kinds is text; whole numbers read as such.  A sheet has at most 1,048,576 rows by
    its format, so one file is parsed by itself.
    """
    content = spark.read.format("binaryFile").load(path).select("content").first()
    rows = sheet_rows(bytes(content[0]), sheet) if content else []
    head = [str(c) if c is not None else f"column_{k}" for k, c in enumerate(rows[0])] if rows else []
    body = [[(r[k] if k < len(r) else None) for k in range(len(head))] for r in rows[1:]]
    plain = lambda v: str(int(v)) if isinstance(v, float) and v.is_integer() else str(v)
    kinds = []
    for k in range(len(head)):
        held = {type(r[k]) for r in body if r[k] is not None}
        whole = held == {float} and all(r[k] is None or r[k].is_integer() for r in body)
        kinds.append("bigint" if whole else "double" if held == {float} else "boolean" if held == {bool} else "string")
    make = {"bigint": int, "double": float, "boolean": bool, "string": plain}
    data = [tuple(None if v is None else make[t](v) for v, t in zip(r, kinds)) for r in body]
    return spark.createDataFrame(data, ", ".join(f"`{c}` {t}" for c, t in zip(head, kinds)) or "column_0 string")


def read_folder(spark: SparkSession, pattern: str, schema: str, sep: str = ",", add_id: bool = False) -> DataFrame:
    """All delimited files that match, with ``dataset``, the file's stem with spaces as underscores.

    With ``add_id`` each file's rows are named ``<stem>_<n>`` from 1, in the order of all their columns.
    """
    df = spark.read.option("header", True).option("sep", sep).schema(schema).csv(pattern)
    stem = F.regexp_replace(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1), "( |%20)", "_")
    df = df.withColumn("dataset", stem)
    if not add_id:
        return df
    from pyspark.sql import Window

    cols = [c for c in df.columns if c != "dataset"]
    n = F.row_number().over(Window.partitionBy("dataset").orderBy(*cols))
    return df.withColumn("id", F.concat_ws("_", "dataset", n)).select("id", *df.columns)


def read_raw_tables(spark: SparkSession, pattern: str, schema: str, sep: str = ",") -> DataFrame:
    """A folder's files with normal column names and contiguous ids over all of them, from 0, the id first."""
    df = with_normal_names(read_folder(spark, pattern, schema, sep))
    out = running_id(df, ["dataset", *[c for c in df.columns if c != "dataset"]])
    return out.select("id", *[c for c in out.columns if c != "id"])


def discover_splits(paths: Sequence[str]) -> dict[str, dict[str, str]]:
    """{dataset: {origin: path}} of file paths ``<dataset>/<origin>.parquet`` or ``<dataset>_<origin>.parquet``."""
    out: dict[str, dict[str, str]] = {}
    for p in sorted(paths):
        parts = p.rstrip("/").split("/")
        stem = parts[-1].rsplit(".", 1)[0]
        if not parts[-1].endswith(".parquet"):
            continue
        if stem in ("train", "test", "inference", "validation") and len(parts) > 1:
            dataset, origin = parts[-2], stem
        elif "_" in stem:
            dataset, origin = stem.rsplit("_", 1)
        else:
            continue
        out.setdefault(dataset, {})[origin] = p
    return out


def require(df: DataFrame, *columns: str) -> DataFrame:
    """``df``, or an error that names the columns it lacks."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def load_split(spark: SparkSession, path: str) -> DataFrame:
    """A split's table; an error unless it is Parquet and has ``sex``."""
    if not path.endswith(".parquet"):
        raise ValueError(f"{path} is no Parquet file")
    return require(spark.read.parquet(path), "sex")


def load_trail_splits(parts: Sequence[DataFrame]) -> DataFrame:
    """Splits put together by name, ``fold`` and ``trail`` in small letters, rows without a known trail dropped."""
    parts = [with_case(with_case(p, "fold"), "trail") for p in parts]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return known_trails(out)


def read_annotations(spark: SparkSession, path: str, spec: dict[str, tuple[str, Sequence[int]]] | None = None) -> DataFrame:
    """Annotation files, one JSON object each, to one row each: landmarks with the derived ones, and measurements by a spec."""
    df = spark.read.schema(ANNOTATION).option("multiLine", True).json(path)
    df = df.withColumn("landmarks", with_derived(F.col("landmarks")))
    return df.select("*", *measurement_columns(F.col("landmarks"), spec)) if spec else df


def image_paths(df: DataFrame, path: str = "path") -> DataFrame:
    """``df`` with species, sex, individual_id and trail from the folders of a path; null unless it has five parts."""
    parts = F.filter(F.split(F.col(path), "[/\\\\]"), lambda x: x != "")
    at = lambda k: F.when(F.size(parts) >= 5, F.element_at(parts, k))
    return df.withColumns({"species": at(-5), "sex": at(-4), "individual_id": at(-3), "trail": at(-2)})


def exif_texts(content: bytes) -> dict[int, str]:
    """The text tags of the first directory of a JPEG's EXIF block; empty if it has none or is broken."""
    import struct

    start = content.find(b"Exif\0\0")
    block = content[start + 6 :] if start >= 0 else b""
    order = {b"II": "<", b"MM": ">"}.get(block[:2])
    out: dict[int, str] = {}
    try:
        if order:
            at = struct.unpack_from(f"{order}I", block, 4)[0]
            for k in range(struct.unpack_from(f"{order}H", block, at)[0]):
                number, kind, count, value = struct.unpack_from(f"{order}HHII", block, at + 2 + 12 * k)
                if kind == 2:
                    lo = value if count > 4 else at + 2 + 12 * k + 8
                    out[number] = block[lo : lo + count].split(b"\0")[0].decode("latin-1").strip()
    except struct.error:
        pass
    return out


#: EXIF tags of the camera's model and of the time.
EXIF_MODEL, EXIF_TIME = 272, 306


def read_images(spark: SparkSession, pattern: str) -> DataFrame:
    """Image files by path parts, with size, time of the file, and time taken and camera model from EXIF, null without it."""
    df = image_paths(spark.read.format("binaryFile").load(pattern))

    def exif(parts):
        for pdf in parts:
            tags = [exif_texts(bytes(c)) for c in pdf["content"]]
            yield pdf.drop(columns=["content"]).assign(taken=[t.get(EXIF_TIME) for t in tags], model=[t.get(EXIF_MODEL) for t in tags])

    cols = [c for c in df.columns if c != "content"]
    types = dict(df.dtypes)
    out = df.mapInPandas(exif, ", ".join(f"`{c}` {types[c]}" for c in cols) + ", taken string, model string")
    return out.withColumn("taken_at", F.try_to_timestamp("taken", F.lit("yyyy:MM:dd HH:mm:ss")))


def merge_masters(masters: dict[str, DataFrame], origin: str) -> DataFrame:
    """The rows of one origin of all species' masters with ``species``; an error if there is no master."""
    if not masters:
        raise ValueError("no master to merge")
    parts = [df.filter(F.col("origin") == origin).withColumn("species", F.lit(name)) for name, df in sorted(masters.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def flatten_results(df: DataFrame, column: str, value: str = "double") -> DataFrame:
    """One row for each entry of a JSON object {method: {name: number}}; text that is none gives no rows."""
    rest = [c for c in df.columns if c != column]
    parsed = F.from_json(column, f"map<string, map<string, {value}>>")
    return df.select(*rest, F.explode(parsed).alias("method", "cells"))
