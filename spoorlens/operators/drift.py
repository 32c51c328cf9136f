"""Schemas that drift between the files of a feed: one table from all of them, and a list of each change.

1.  ``parsed_cells``    every line of every file as cells (file, row, name, text), names in label form
2.  ``typed``           a cell's class (integer, decimal, boolean, date, text, missing) and canonical value
3.  ``profiles``        a column of a file: presence, counts of each class, quantiles, a min-hash sketch
4.  ``evidence``        for a name that went and one that came: how often records both files hold agree
5.  ``schema_changes``  the best bipartite matching of gone and new names gives the renames; the rest is
                        added, removed or retyped
6.  ``unified``         each field under the name it had first in its feed

Only the matching (a row for each gone and new name of one file) and the naming (a row for each change
of one feed) run in grouped Python; all work on cells is in DataFrame expressions with partial
aggregation, so a file that holds a third of all rows is spread over the tasks.
"""

from __future__ import annotations

import csv
import difflib
import json
import re
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import label_form, trimmed
from ..sources.stages import Stages

#: Texts that mark a missing value, in small letters.
MISSING = ("", "-", "--", "?", "na", "n/a", "nan", "null", "none", "-999", "-999.0")
#: Share of a field's non-missing values that have its type, at least.
MAJORITY = 0.8
#: Least score of a rename that shared records speak for, records that it takes, and least score of any other rename.
ACCEPT, SHARED, ACCEPT_ALIKE = 0.6, 3, 0.4
SKETCH = 24
KEY = "print_no"


# ------------------------------------------------------------------ parsing
def _line(text: str, delimiter: str) -> list[str]:
    """The values of a delimited line; one without quotes needs no parser."""
    if '"' in text or "\r" in text or "\n" in text:
        return next(csv.reader([text], delimiter=delimiter), [])
    return text.split(delimiter) if text else []


def _row(kind: str, delimiter: str | None, header: str | None, line: str, heads: dict) -> list[tuple[str, str | None]]:
    """(name, text) of the cells of a line; none if it can't be parsed."""
    try:
        if kind == "jsonl":
            o = json.loads(line)
            return [(k, None if v is None else json.dumps(v) if isinstance(v, (bool, dict, list)) else str(v)) for k, v in o.items()] if isinstance(o, dict) else []
        d = delimiter or ","
        names = heads.get((header, d))
        if names is None:
            names = heads[header, d] = _line(header or "", d)
        values = _line(line, d)
        return list(zip(names, values + [None] * (len(names) - len(values))))
    except (ValueError, TypeError, csv.Error, StopIteration):
        return []


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines (feed_id, file_id, row_no, file_format, delimiter, header, raw_line) to cells (feed_id, file_id, row_no, name, text)."""
    csv.field_size_limit(sys.maxsize)  # cells may be of any length
    plain = re.compile(r"[^a-z0-9_]+")
    heads: dict = {}
    labels: dict[str, str] = {}
    for b in batches:
        counts, names, texts = [], [], []
        for row_no, kind, delimiter, header, line in zip(*(b.column(k).to_pylist() for k in range(2, 7))):
            row = _row(kind, delimiter, header, line, heads)
            counts.append(len(row))
            for name, text in row:
                label = labels.get(name)
                if label is None:
                    # names of ASCII letters are put in label form here, once; others by the expression that follows
                    label = labels[name] = plain.sub("_", name.strip(" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f").lower()) if name.isascii() else name
                names.append(label)
                # a header's cells repeat the names
                texts.append(None if row_no == 0 and text == name else text)
        at = pa.array(np.repeat(np.arange(b.num_rows), counts))
        yield pa.RecordBatch.from_arrays([*[b.column(k).take(at) for k in range(3)], pa.array(names, pa.string()), pa.array(texts, pa.string())], ["feed_id", "file_id", "row_no", "name", "text"])


def parsed_cells(files: DataFrame, lines: DataFrame) -> DataFrame:
    """(feed_id, file_id, row_no, name, text): the cells of all lines; a header's cells come with a null text in row 0.

    Lines delivered twice count once; a line of no known file, and one that can't be parsed, give no
    cells; cells beyond the header are left out.  Names that are equal in label form are one name.
    """
    meta = files.select("file_id", "feed_id", F.lower(trimmed("file_format")).alias("file_format"), "delimiter").dropDuplicates(["file_id"])
    rows = lines.select("file_id", "row_no", "raw_line").filter("raw_line is not null").dropDuplicates(["file_id", "row_no", "raw_line"])
    head = rows.filter("row_no = 0").groupBy("file_id").agg(F.min("raw_line").alias("header"))
    full = rows.join(meta, "file_id").join(head, "file_id", "left").filter("file_format = 'jsonl' or header is not null")
    full = full.select("feed_id", "file_id", "row_no", "file_format", "delimiter", "header", "raw_line").filter("file_format = 'jsonl' or row_no = 0 or raw_line <> header")
    cells = full.mapInArrow(_parse, "feed_id long, file_id long, row_no int, name string, text string")
    return cells.withColumn("name", label_form("name")).filter("name <> ''")


# ------------------------------------------------------------------ types and profiles
_INT, _DEC = r"^[+-]?\d+$", r"^[+-]?(\d+[.,]\d*|[.,]\d+)([eE][+-]?\d+)?$"
_ISO, _DMY = r"^(\d{4})[-./](\d{1,2})[-./](\d{1,2})([ T].*)?$", r"^(\d{1,2})[-./](\d{1,2})[-./](\d{4})$"


def typed(cells: DataFrame) -> DataFrame:
    """``cells`` with ``kind`` (null for a missing value) and ``value``, the same for all writings of one value."""
    t = trimmed("text")
    low = F.lower(t)
    kind = (
        F.when(t.isNull() | low.isin(*MISSING), None)
        .when(t.rlike(_INT), "integer")
        .when(t.rlike(_DEC), "decimal")
        .when(low.isin("true", "false"), "boolean")
        .when(t.rlike(_ISO) | t.rlike(_DMY), "date")
        .otherwise("text")
    )
    number = F.replace(t, F.lit(","), F.lit(".")).try_cast("double")
    ymd = lambda p, y, m, d: F.concat_ws("-", F.regexp_extract(t, p, y), F.lpad(F.regexp_extract(t, p, m), 2, "0"), F.lpad(F.regexp_extract(t, p, d), 2, "0"))
    out = cells.withColumn("kind", kind).withColumn("number", F.when(F.col("kind").isin("integer", "decimal"), number))
    value = (
        F.when(F.col("number").isNotNull(), (F.col("number") + 0.0).cast("string"))
        .when((F.col("kind") == "date") & t.rlike(_ISO), ymd(_ISO, 1, 2, 3))
        .when(F.col("kind") == "date", ymd(_DMY, 3, 2, 1))
        .when(F.col("kind").isNotNull(), label_form("text", None))
    )
    return out.withColumn("value", value)


def _type(n: Column, integer: Column, decimal: Column, boolean: Column, date: Column) -> Column:
    """The type of a column from its counts; integers among decimals are decimals."""
    most = n * MAJORITY
    return F.when(n == 0, None).when(integer >= most, "integer").when((integer + decimal >= most) & (decimal > 0), "decimal").when(boolean >= most, "boolean").when(date >= most, "date").otherwise("text")


def profiles(cells: DataFrame) -> DataFrame:
    """(feed_id, file_id, name, n, type) for each column of each file, columns without values included."""
    counts = {k: F.count_if(F.col("kind") == k) for k in ("integer", "decimal", "boolean", "date")}
    by = cells.groupBy("feed_id", "file_id", "name").agg(F.count("kind").alias("n"), *[c.alias(k) for k, c in counts.items()])
    return by.select("feed_id", "file_id", "name", "n", _type(*[F.col(c) for c in ("n", "integer", "decimal", "boolean", "date")]).alias("type"))


def sketches(cells: DataFrame, columns: DataFrame) -> DataFrame:
    """(file_id, name, q, sketch) of the ``columns`` (file_id, name): quantiles of numbers, min-hash sketch of values.

    A value is hashed once; the hash says in which of ``SKETCH`` places it counts, and a place keeps its least.
    """
    h = F.col("h")
    sketch = F.array(*[F.min(F.when(F.pmod(h, F.lit(SKETCH)) == k, h)) for k in range(SKETCH)])
    own = cells.filter("value is not null").join(columns.select("file_id", "name").distinct(), ["file_id", "name"], "left_semi").withColumn("h", F.xxhash64("value"))
    return own.groupBy("file_id", "name").agg(F.percentile_approx("number", [0.1, 0.25, 0.5, 0.75, 0.9], 1000).alias("q"), sketch.alias("sketch"))


def versions(files: DataFrame) -> DataFrame:
    """(feed_id, file_id, place, earlier): each file's place in its feed by exported_at, and the file before it."""
    one = files.select("feed_id", "file_id", "exported_at").dropDuplicates(["file_id"])
    order = Window.partitionBy("feed_id").orderBy("exported_at", "file_id")
    return one.select("feed_id", "file_id", F.row_number().over(order).alias("place"), F.lag("file_id").over(order).alias("earlier"))


def comparisons(profile: DataFrame, version: DataFrame) -> DataFrame:
    """(feed_id, file_id, earlier, name, old_type, new_type, gone, came): a row for each name of a file or its predecessor."""
    steps = version.filter("earlier is not null").select("feed_id", "file_id", "earlier")
    new = steps.join(profile.drop("feed_id"), "file_id").select("feed_id", "file_id", "earlier", "name", F.struct("type", "n").alias("new"))
    old = steps.join(profile.drop("feed_id").withColumnRenamed("file_id", "earlier"), "earlier").select("feed_id", "file_id", "earlier", "name", F.struct("type", "n").alias("old"))
    return new.join(old, ["feed_id", "file_id", "earlier", "name"], "full")


def evidence(cells: DataFrame, gone: DataFrame, came: DataFrame, key: str = KEY) -> DataFrame:
    """(file_id, old_name, new_name, shared, equal): records of both files that hold both names, and how many agree.

    Records are matched by the feed's own record number, the column ``key``.
    """
    keys = cells.filter((F.col("name") == key) & F.col("value").isNotNull()).groupBy("file_id", "row_no").agg(F.min("value").alias("record"))
    held = cells.filter("value is not null").select("file_id", "row_no", "name", "value")
    a = held.withColumnRenamed("file_id", "earlier").join(gone.select("file_id", "earlier", "name"), ["earlier", "name"]).join(keys.withColumnRenamed("file_id", "earlier"), ["earlier", "row_no"])
    a = a.groupBy("file_id", "record", "name").agg(F.min("value").alias("value")).withColumnsRenamed({"name": "old_name", "value": "old_value"})
    b = held.join(came.select("file_id", "name"), ["file_id", "name"]).join(keys, ["file_id", "row_no"])
    b = b.groupBy("file_id", "record", "name").agg(F.min("value").alias("value")).withColumnsRenamed({"name": "new_name", "value": "new_value"})
    return a.join(b, ["file_id", "record"]).groupBy("file_id", "old_name", "new_name").agg(F.count(F.lit(1)).alias("shared"), F.count_if(F.col("old_value") == F.col("new_value")).alias("equal"))


# ------------------------------------------------------------------ matching
def best_assignment(score: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of the matching with the largest sum, by shortest augmenting paths with potentials."""
    flip = score.shape[0] > score.shape[1]
    cost = -(score.T if flip else score)
    n, m = cost.shape
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], j = i, 0
        least, used, way = np.full(m + 1, np.inf), np.zeros(m + 1, bool), np.zeros(m + 1, int)
        while True:
            used[j] = True
            free = ~used
            free[0] = False
            slack = np.full(m + 1, np.inf)
            slack[1:] = cost[owner[j] - 1] - u[owner[j]] - v[1:]
            better = free & (slack < least)
            least[better], way[better] = slack[better], j
            k = int(np.flatnonzero(free)[np.argmin(least[free])])
            step = least[k]
            u[owner[used]] += step
            v[used] -= step
            least[free] -= step
            j = k
            if owner[j] == 0:
                break
        while j:
            owner[j] = owner[way[j]]
            j = way[j]
    pairs = [(owner[j] - 1, j - 1) for j in range(1, m + 1) if owner[j]]
    return [(b, a) for a, b in pairs] if flip else pairs


def _alike(old: dict, new: dict) -> float:
    """How alike two columns' values are, 0 to 1: overlap of quantile ranges, or estimated overlap of value sets."""
    if old["q"] is not None and new["q"] is not None and len(old["q"]) and len(new["q"]):
        a, b = np.asarray(old["q"], float), np.asarray(new["q"], float)
        width = max(a[-1] - a[0], b[-1] - b[0], 1e-9 * max(abs(a).max(), 1))
        return float(max(0.0, 1 - np.abs(a - b).mean() / width))
    used = [(x, y) for x, y in zip(old["sketch"], new["sketch"]) if not (pd.isna(x) and pd.isna(y))] if old["sketch"] is not None and new["sketch"] is not None else []
    return float(np.mean([x == y for x, y in used])) if used else 0.0


def rename_score(old_name: str, new_name: str, old: dict, new: dict, shared: int, equal: int) -> float:
    """Belief that two columns are one: shared records decide, values and names help where there are few."""
    if old["type"] is None or old["type"] != new["type"]:
        return 0.0
    name = difflib.SequenceMatcher(None, old_name, new_name).ratio()
    same = equal / shared if shared else 0.0
    if shared >= SHARED:
        return 0.95 * same + 0.05 * name
    alike = _alike(old, new)
    return 0.25 * shared * same + (1 - 0.25 * shared) * (0.8 * alike + 0.2 * name)


def _match(pdf: pd.DataFrame) -> pd.DataFrame:
    old, new = sorted(pdf["old_name"].unique()), sorted(pdf["new_name"].unique())
    score = np.zeros((len(old), len(new)))
    for r in pdf.itertuples():
        o = {"type": r.old_type, "q": r.old_q, "sketch": r.old_sketch}
        n = {"type": r.new_type, "q": r.new_q, "sketch": r.new_sketch}
        belief = rename_score(r.old_name, r.new_name, o, n, r.shared, r.equal)
        # a pair that can't be a rename is worth nothing, so it can't draw a name away from its like
        score[old.index(r.old_name), new.index(r.new_name)] = belief if belief >= (ACCEPT if r.shared >= SHARED else ACCEPT_ALIKE) else 0
    out = [(pdf["file_id"].iloc[0], old[i], new[j], float(score[i, j])) for i, j in best_assignment(score) if score[i, j] > 0]
    return pd.DataFrame(out, columns=["file_id", "old_name", "new_name", "score"])


def schema_changes(files: DataFrame, lines: DataFrame, key: str = KEY, stages: Stages | None = None, cells: DataFrame | None = None) -> DataFrame:
    """(feed_id, file_id, earlier, change_kind, old_name, new_name, old_type, new_type): each change of a field.

    A file is compared with the file of its feed with the next earlier exported_at (equal times: the
    smaller file_id first).  A field is in a file if its header or any of its lines has it.  A field
    without values has no type, so it is neither retyped nor renamed.  A name that is absent is the
    empty string.  Empty tables give no rows.
    """
    stages = stages or Stages(files.sparkSession, "drift")
    cells = cells if cells is not None else stages.write(typed(parsed_cells(files, lines)), "cells")
    both = stages.write(comparisons(profiles(cells), versions(files)), "comparisons")
    head = ["feed_id", "file_id", "earlier"]
    gone = both.filter("new is null").select(*head, "name", F.col("old.type").alias("old_type"))
    came = both.filter("old is null").select(*head, "name", F.col("new.type").alias("new_type"))
    pairs = gone.withColumnRenamed("name", "old_name").join(came.withColumnRenamed("name", "new_name"), head).filter("old_type = new_type")
    pairs = stages.write(pairs, "pairs")
    # only columns that may have been renamed are looked at closely
    ends = pairs.select(F.explode(F.array(F.struct(F.col("earlier").alias("file_id"), F.col("old_name").alias("name")), F.struct(F.col("file_id"), F.col("new_name").alias("name")))).alias("e")).select("e.*")
    look = stages.write(sketches(cells, ends), "sketches")
    seen = evidence(cells, pairs.select("file_id", "earlier", F.col("old_name").alias("name")).distinct(), pairs.select("file_id", F.col("new_name").alias("name")).distinct(), key)
    scored = pairs.join(seen, ["file_id", "old_name", "new_name"], "left").fillna(0, ["shared", "equal"])
    scored = scored.join(look.select(F.col("file_id").alias("earlier"), F.col("name").alias("old_name"), F.col("q").alias("old_q"), F.col("sketch").alias("old_sketch")), ["earlier", "old_name"], "left")
    scored = scored.join(look.select("file_id", F.col("name").alias("new_name"), F.col("q").alias("new_q"), F.col("sketch").alias("new_sketch")), ["file_id", "new_name"], "left")
    # a given number of partitions isn't merged at run time, small as they are: each file costs time, not bytes
    spread = scored.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file_id")
    renamed = stages.write(spread.groupBy("file_id").applyInPandas(_match, "file_id long, old_name string, new_name string, score double"), "renamed")
    none = F.lit("")
    kinds = [
        gone.join(renamed.select("file_id", F.col("old_name").alias("name")), ["file_id", "name"], "left_anti").select(*head, F.lit("removed").alias("change_kind"), F.col("name").alias("old_name"), none.alias("new_name"), "old_type", F.lit(None).cast("string").alias("new_type")),
        came.join(renamed.select("file_id", F.col("new_name").alias("name")), ["file_id", "name"], "left_anti").select(*head, F.lit("added").alias("change_kind"), none.alias("old_name"), F.col("name").alias("new_name"), F.lit(None).cast("string").alias("old_type"), "new_type"),
        gone.withColumnRenamed("name", "old_name").join(renamed, ["file_id", "old_name"]).select(*head, F.lit("renamed").alias("change_kind"), "old_name", "new_name", "old_type", F.col("old_type").alias("new_type")),
        both.filter("old.type <> new.type").select(*head, F.lit("retyped").alias("change_kind"), F.col("name").alias("old_name"), F.col("name").alias("new_name"), F.col("old.type").alias("old_type"), F.col("new.type").alias("new_type")),
    ]
    out = kinds[0]
    for k in kinds[1:]:
        out = out.unionByName(k)
    return out


# ------------------------------------------------------------------ one table
def _first_names(pdf: pd.DataFrame) -> pd.DataFrame:
    """Walk a feed's files in order; a field keeps the name it had first, or a numbered one if that is taken."""
    pdf = pdf.sort_values(["place", "name"])
    out, before, taken = [], {}, set()
    for _, part in pdf.groupby("place", sort=True):
        now = {}
        for r in part.itertuples():
            origin = r.old_name if isinstance(r.old_name, str) else r.name
            field = before.get(origin)
            if field is None:
                field, k = r.name, 2
                while field in taken:
                    field, k = f"{r.name}_{k}", k + 1
                taken.add(field)
            now[r.name] = field
            out.append((r.file_id, r.name, field))
        before = {**before, **now} if not len(now) else now
    return pd.DataFrame(out, columns=["file_id", "name", "field"])


def unified(files: DataFrame, lines: DataFrame, key: str = KEY) -> DataFrame:
    """(feed_id, record, file_id, fields): one row for each record of each feed, its fields in a map.

    Fields bear the name they had first in their feed and canonical values.  Where several rows hold a
    record, each field has the value of the latest of them in which it isn't missing, and ``file_id`` is
    the latest file with the record.  Records without a number are rows of their own, named by file and
    row.
    """
    stages = Stages(files.sparkSession, "unified")
    cells = stages.write(typed(parsed_cells(files, lines)), "cells")
    changes = schema_changes(files, lines, key, stages, cells)
    version = versions(files)
    columns = cells.select("feed_id", "file_id", "name").distinct().join(version.select("file_id", "place"), "file_id")
    columns = columns.join(changes.filter("change_kind = 'renamed'").select("file_id", F.col("new_name").alias("name"), "old_name"), ["file_id", "name"], "left")
    names = stages.write(columns.groupBy("feed_id").applyInPandas(_first_names, "file_id long, name string, field string"), "names")
    held = F.collect_list(F.struct("field", "value")).alias("held")
    number = F.min(F.when(F.col("field") == key, F.col("value")))
    rows = cells.filter("text is not null").join(names, ["file_id", "name"]).groupBy("feed_id", "file_id", "row_no").agg(held, number.alias("number"))
    rows = rows.withColumn("record", F.coalesce("number", F.concat_ws(":", F.lit("row"), "file_id", "row_no"))).join(version.select("file_id", "place"), "file_id")
    # field by field: the latest value that isn't missing
    each = rows.select("feed_id", "record", F.struct("place", "row_no", "file_id").alias("at"), F.inline("held"))
    known = F.max_by("value", F.when(F.col("value").isNotNull(), F.struct("at", "value")))
    merged = each.groupBy("feed_id", "record", "field").agg(known.alias("value"), F.max("at").alias("at"))
    out = merged.groupBy("feed_id", "record").agg(F.max("at").alias("at"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "value")))).alias("fields"))
    return out.select("feed_id", "record", "at.file_id", "fields")


def field_types(table: DataFrame) -> DataFrame:
    """(field, type) of a table that ``unified`` made: that of at least four fifths of the values, else text."""
    v = F.col("value")
    each = table.select(F.explode("fields").alias("field", "value")).filter("value is not null")
    number = v.rlike(r"^-?\d") & v.try_cast("double").isNotNull()
    whole = number & v.rlike(r"^-?\d+\.0$")
    counts = {"integer": whole, "decimal": number & ~whole, "boolean": v.isin("true", "false"), "date": v.rlike(r"^\d{4}-\d{2}-\d{2}$")}
    n = each.groupBy("field").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(k) for k, c in counts.items()])
    return n.select("field", _type(*[F.col(c) for c in ("n", *counts)]).alias("type"))


#: The column type of each field type.
_COLUMN = {"integer": "bigint", "decimal": "double", "boolean": "boolean", "date": "date", "text": "string"}


def typed_table(table: DataFrame) -> DataFrame:
    """The unified table with a column for each field, in order of name, of the field's type.

    A value that isn't of its field's type is null; so is a field that a record doesn't have.  Fields named
    as the table's own columns get the prefix ``field_``.
    """
    types = {r["field"]: r["type"] for r in field_types(table).collect()}  # a row a field: the columns of the result

    def column(name: str) -> Column:
        v, kind = F.col("fields")[F.lit(name)], types[name]
        v = v.try_cast("double").try_cast("bigint") if kind == "integer" else v.try_cast(_COLUMN[kind])
        return v.alias(f"field_{name}" if name in ("feed_id", "record", "file_id") else name)

    return table.select("feed_id", "record", "file_id", *[column(n) for n in sorted(types)])
