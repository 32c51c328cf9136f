"""Problem 3 on small feeds."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from spoorlens.operators import drift as D

FILES = "file_id long, feed_id long, file_name string, file_format string, delimiter string, n_lines int, exported_at timestamp_ntz, received_at timestamp_ntz, name string, text string"
LINES = "file_id long, row_no int, raw_line string, name string, header string"


def feed(spark, files, lines):
    import datetime as dt

    at = lambda k: dt.datetime(2021, 1, 1) + dt.timedelta(days=k)
    f = spark.createDataFrame([(i, g, "f", fmt, sep, None, at(k), at(0), "x", "y") for i, g, fmt, sep, k in files], FILES)
    return f, spark.createDataFrame([(i, n, t, "x", "y") for i, rows in lines.items() for n, t in rows], LINES)


def numbered(rows, start=0):
    return list(enumerate(rows, start))


def changes(spark, files, lines):
    f, r = feed(spark, files, lines)
    return {(x["file_id"], x["change_kind"], x["old_name"], x["new_name"]) for x in D.schema_changes(f, r).collect()}


def test_rename_retype_added_removed(spark):
    a = numbered(["Print No;Dist1;Flag;Note;Day"] + [f'{k};"{k},5";true;n{k};2021-01-0{k}' for k in range(1, 9)])
    b = [(k, t) for k, t in enumerate([f'{{"print_no": {k}, "length one": {k}.5, "flag": {k % 2}, "Extra": {k * 7}, "day": "0{k}.01.2021"}}' for k in range(3, 10)], 1)]
    c = numbered(['"PRINT-NO",LENGTH-ONE,flag,extra'] + [f"{k},{k}.5,{k % 2},x{k}" for k in range(6, 12)])
    files = [(11, 1, "jsonl", None, 2), (10, 1, "delimited", ";", 1), (12, 1, "delimited", ",", 3), (20, 2, "delimited", ";", 1)]
    got = changes(spark, files, {10: a + a[:2], 11: b + b[:1], 12: c, 20: a, 99: a})
    assert got == {(11, "renamed", "dist1", "length_one"), (11, "retyped", "flag", "flag"), (11, "removed", "note", ""), (11, "added", "", "extra"), (12, "removed", "day", ""), (12, "retyped", "extra", "extra")}


def test_unlike_fields_are_no_rename(spark):
    a = numbered(["print_no|w"] + [f"{k}|{k}.25" for k in range(1, 12)])
    b = numbered(["print_no|h"] + [f"{k}|{k * 3}.75" for k in range(5, 15)])
    got = changes(spark, [(1, 1, "delimited", "|", 1), (2, 1, "delimited", "|", 2)], {1: a, 2: b})
    assert got == {(2, "removed", "w", ""), (2, "added", "", "h")}


def test_empty_fields_broken_lines_and_nothing(spark):
    a = numbered(["print_no,a,b"] + [f"{k},,{k}" for k in range(1, 6)])
    b = [(1, '{"print_no": 4, "b": null}'), (2, "not json"), (3, "[1, 2]"), (4, '{"print_no": 5, "b": 5}'), (5, None), (6, "")]
    got = changes(spark, [(1, 1, "delimited", ",", 1), (2, 1, "jsonl", None, 2), (3, 1, "jsonl", None, 3)], {1: a, 2: b})
    assert (2, "removed", "a", "") in got and not any(k == "retyped" for _, k, _, _ in got)
    f, r = feed(spark, [], {})
    assert D.schema_changes(f, r).collect() == [] and D.unified(f, r).collect() == []


def test_types_of_values(spark):
    df = spark.createDataFrame([(t,) for t in ("1", "1,5", "-2.5", "true", "2021-02-03", "3.2.2021", "ca. 3", "n/a", " ", None, "1e5")], "text string")
    got = [tuple(r) for r in D.typed(df).select("kind", "value").collect()]
    assert got == [("integer", "1.0"), ("decimal", "1.5"), ("decimal", "-2.5"), ("boolean", "true"), ("date", "2021-02-03"), ("date", "2021-02-03"), ("text", "ca_3"), (None, None), (None, None), (None, None), ("text", "1e5")]


def test_unified_keeps_first_names_and_latest_rows(spark):
    a = numbered(["print_no;dist1"] + [f"{k};{k},5" for k in range(1, 9)])
    b = numbered(["print_no;len"] + [f"{k};{k},5" for k in range(5, 12)])
    f, r = feed(spark, [(1, 1, "delimited", ";", 1), (2, 1, "delimited", ";", 2)], {1: a, 2: b})
    rows = {x["record"]: x for x in D.unified(f, r).collect()}
    assert len(rows) == 11 and rows["5.0"]["file_id"] == 2 and rows["1.0"]["file_id"] == 1
    assert all(set(x["fields"]) == {"print_no", "dist1"} for x in rows.values())


def test_unified_keeps_values_that_only_an_earlier_row_has(spark):
    a = numbered(["print_no;dist1;note;flag"] + [f"{k};{k},5;n{k};true" for k in range(1, 9)])
    # the later file lacks ``note``; print 5 has no ``dist1`` there, that of print 6 is missing, that of 7 differs
    b = [(1, '{"print_no": 5, "flag": false}'), (2, '{"print_no": 6, "dist1": "n/a", "flag": true}'), (3, '{"print_no": 7, "dist1": 9.25, "flag": true}'), (4, '{"print_no": 9, "dist1": null, "flag": "-"}')]
    f, r = feed(spark, [(1, 1, "delimited", ";", 1), (2, 1, "jsonl", None, 2)], {1: a, 2: b})
    rows = {x["record"]: (x["file_id"], x["fields"]) for x in D.unified(f, r).collect()}
    assert rows["5.0"] == (2, {"print_no": "5.0", "dist1": "5.5", "note": "n5", "flag": "false"})
    assert rows["6.0"] == (2, {"print_no": "6.0", "dist1": "6.5", "note": "n6", "flag": "true"})
    assert rows["7.0"] == (2, {"print_no": "7.0", "dist1": "9.25", "note": "n7", "flag": "true"})
    assert rows["9.0"] == (2, {"print_no": "9.0", "flag": None})


def test_typed_table(spark):
    a = numbered(["print_no;dist1;note;flag;day;file_id"] + [f"{k};{k},5;n{k};true;0{k}.02.2021;{k}" for k in range(1, 9)] + ["9;odd;;maybe;;"])
    f, r = feed(spark, [(1, 1, "delimited", ";", 1)], {1: a})
    t = D.typed_table(D.unified(f, r))
    assert dict(t.dtypes) == {"feed_id": "bigint", "record": "string", "file_id": "bigint", "day": "date", "dist1": "double", "field_file_id": "bigint", "flag": "boolean", "note": "string", "print_no": "bigint"}
    rows = {x["print_no"]: x for x in t.collect()}
    assert rows[3]["dist1"] == 3.5 and str(rows[3]["day"]) == "2021-02-03" and rows[3]["flag"] is True and rows[3]["file_id"] == 1
    assert rows[9]["dist1"] is None and rows[9]["flag"] is None
    assert len(D.typed_table(D.unified(*feed(spark, [], {}))).columns) == 3


def test_renames_without_a_record_number(spark):
    """Values and names alone tell a rename where no record is known to be in both files."""
    rnd = random.Random(6)
    row = lambda k: f"{k};{rnd.uniform(40, 60):.2f};{rnd.uniform(400, 900):.1f};{rnd.choice(['mud', 'snow', 'sand'])};{rnd.choice(['true', 'false'])}"
    a = numbered(["no;dist1;area;ground;wet"] + [row(k) for k in range(60)])
    b = numbered(["no;length;surface;substrate;wet"] + [row(k) for k in range(200, 260)])
    f, r = feed(spark, [(1, 1, "delimited", ";", 1), (2, 1, "delimited", ";", 2)], {1: a, 2: b})
    got = {(x["change_kind"], x["old_name"], x["new_name"]) for x in D.schema_changes(f, r, key="none").collect()}
    assert got == {("renamed", "dist1", "length"), ("renamed", "area", "surface"), ("renamed", "ground", "substrate")}


def test_very_long_cells_and_quotes(spark):
    long = "x" * 300_000
    a = numbered(["print_no,a,b", f'1,"{long}",2', f"2,{long},3", '3,"p, q",4'])
    f, r = feed(spark, [(1, 1, "delimited", ",", 1)], {1: a})
    rows = {x["record"]: x["fields"] for x in D.unified(f, r).collect()}
    assert rows["1.0"]["a"] == rows["2.0"]["a"] == long and rows["3.0"] == {"print_no": "3.0", "a": "p_q", "b": "4.0"}


def test_assignment_is_the_best():
    rnd = random.Random(1)
    for _ in range(60):
        n, m = rnd.randrange(1, 5), rnd.randrange(1, 5)
        s = np.array([[rnd.random() for _ in range(m)] for _ in range(n)])
        got = sum(s[i, j] for i, j in D.best_assignment(s))
        short, long = (range(n), range(m)) if n <= m else (range(m), range(n))
        best = max(sum(s[i, j] if n <= m else s[j, i] for i, j in zip(short, p)) for p in itertools.permutations(long, len(short)))
        assert abs(got - best) < 1e-9


def test_a_hot_file_is_spread(spark):
    a = numbered(["print_no;dist1"] + [f"{k};{k},5" for k in range(3000)])
    b = numbered(["print_no;len"] + [f"{k};{k},5" for k in range(2990, 3010)])
    f, r = feed(spark, [(1, 1, "delimited", ";", 1), (2, 1, "delimited", ";", 2)], {1: a, 2: b})
    assert [tuple(x) for x in D.schema_changes(f, r).select("change_kind", "old_name", "new_name").collect()] == [("renamed", "dist1", "len")]
    assert D.unified(f, r).agg(F.count(F.lit(1))).first()[0] == 3010
