"""Problem 2: the same or nearly the same record in different splits.

A record's fingerprint is a string of bits: each measurement is placed on a log scale in cells as wide
as two tolerances, and the low bits of its Gray-coded cell number are kept, so that measurements within the
tolerance differ in at most one bit.  Two records of one impression are thus within a Hamming radius of one
bit a measurement.  Codes of cells twice as wide agree in each block of measurements once the other side
also tries the neighbouring cell that lies within the tolerance.  Blocks are joined across splits only;
candidates within the radius are verified on the values and names themselves.

No case is lost.  Three disjoint blocks of four serve all pairs that hold one of them whole, which are all
pairs that lack at most two measurements between them.  The others have a sparse record, one that lacks
two or more; there are few of them, and for each pair of sets of held measurements the block is made of
the first four that both hold (``sparse_candidates``).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.labels import base_trail, known, label_form
from ..functions.numbers import measurement
from ..sources.stages import Stages

#: The measurements of a footprint row.
MEASURES = ("v1", "v2", "v3", "v4", "area1", "area2", "dist1", "dist2", "dist3", "dist4", "ang1", "t1")
TOLERANCE = 0.01
BLOCK = 4
#: Missing measurements from which a record is sparse.
SPARSE = 2
#: Bits of a measurement's code, doubles above zero falling into under 2 ** 16 wide cells, and bits of a narrow cell's in the fingerprint.
BITS, PRINT = 16, 5
#: Cell widths on the natural log scale: four tolerances for blocks, two for the fingerprint, and a thousandth, so that
#: a probe meets two cells at most.
_REACH = 0.010050335853501453  # -ln(1 - TOLERANCE)
_CELL, _FINE = 4.004 * _REACH, 2.002 * _REACH
_VALUES = [f"m{k}" for k in range(len(MEASURES))]
_PARTS = [range(i, min(i + BLOCK, len(MEASURES))) for i in range(0, len(MEASURES), BLOCK)]
_WHOLE = [sum(1 << i for i in part) for part in _PARTS]


def _shifted(by: float, cell: float = _CELL):
    def code(log: Column) -> Column:
        """Gray code of the cell that holds a log value."""
        q = F.floor((log + by) / cell) + (1 << BITS)
        return q.bitwiseXOR(F.shiftright(q, 1)).bitwiseAND(F.lit((1 << BITS) - 1))

    return code


def footprint_records(footprints: DataFrame) -> DataFrame:
    """(id, role, split, source, ind, trail, m0, m1, ...): rows of a split that hold a measurement; role is train or eval."""
    split = label_form("__split__")
    role = F.when(split == "train", "train").when(split.isin("test", "inference"), "eval")
    m = [measurement(c).alias(v) for c, v in zip(MEASURES, _VALUES)]
    rows = footprints.select("id", role.alias("role"), split.alias("split"), label_form("dataorigin").alias("source"), known(label_form("individual_id")).alias("ind"), base_trail("trail").alias("trail"), *m)
    return rows.filter("role is not null and id is not null").filter(F.coalesce(*_VALUES).isNotNull())


def _named(rows: DataFrame) -> DataFrame:
    """``rows`` with ``h`` and ``g``, a 128-bit hash of what a representative stands for."""
    parts = ["role", "ind", "trail", *_VALUES]
    # a null moves the hash by its place, as each value is hashed with its number
    at = [F.struct(F.lit(k), F.col(c)) for k, c in enumerate(parts)]
    return rows.withColumns({"h": F.xxhash64(*at), "g": F.xxhash64(F.lit(7), *reversed(at))})


def representatives(records: DataFrame) -> DataFrame:
    """One row for each distinct (role, names, measurements): exact copies are compared once.

    ``h`` and ``g`` name it; ``m`` has the measurements; ``print`` is the fingerprint; ``held`` the bit set
    of held measurements; ``miss`` how many are missing.
    """
    one = _named(records.select("role", "ind", "trail", *_VALUES).distinct())
    # a row costs time, not bytes, so small tables are spread, too
    one = one.repartition(int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    one = one.select("role", "h", "g", "ind", "trail", F.array(*_VALUES).alias("m"))
    one = one.withColumn("fine", F.transform(F.transform("m", lambda v: F.log(v)), _shifted(0.0, _FINE)))
    low = [F.coalesce(F.col("fine")[i], F.lit(0)).bitwiseAND(F.lit((1 << PRINT) - 1)) for i in range(len(MEASURES))]
    held = [F.when(F.col("m")[i].isNotNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i in range(len(MEASURES))]
    join_bits = lambda x, y: x.bitwiseOR(y)
    prints = reduce(join_bits, [F.shiftleft(x, PRINT * i) for i, x in enumerate(low)])
    return one.withColumns({"print": prints, "held": reduce(join_bits, held)}).drop("fine").withColumn("miss", len(MEASURES) - F.bit_count("held"))


def coded(reps: DataFrame) -> DataFrame:
    """``reps`` with ``code``, the codes of the measurements, and ``lo`` and ``hi``, those of the ends of the tolerance.

    They are cheaper to work out where they are used than to keep.
    """
    shift = {"code": 0.0, "lo": -_REACH * 1.0000001, "hi": _REACH * 1.0000001}
    logs = F.transform("m", lambda v: F.log(v))
    return reps.withColumns({c: F.transform(logs, _shifted(s)) for c, s in shift.items()})


_KEEP = ("h", "g", "held", "print")


def _whole_blocks(rows: DataFrame, probe: bool) -> DataFrame:
    """(block, word) rows of the disjoint blocks: of a record's own cells, or of all cells within the tolerance if ``probe``."""
    # the expression is long, so it is parsed from text
    out = []
    for k, part in enumerate(_PARTS):
        words = [""]
        for i in part:
            ends = [f"lo[{i}]", f"hi[{i}]"] if probe else [f"code[{i}]"]
            words = [f"(shiftleft({w}, {BITS}) | {e})" if w else e for w in words for e in ends]
        out += [f"named_struct('block', {k}, 'word', {w})" for w in words]
    keys = F.expr(f"array_distinct(filter(array({', '.join(out)}), s -> s.word is not null))")
    return coded(rows).select(*_KEEP, F.explode(keys).alias("key")).select(*_KEEP, "key.block", "key.word")


def _within(a: str, b: str) -> Column:
    """Whether the prints of two records differ in at most one bit for each measurement both hold."""
    one = (1 << PRINT) - 1
    # bits of a part's measurements that are held, for each set of them
    masks = f"array({', '.join(f'{sum(one << (PRINT * j) for j in range(BLOCK) if x >> j & 1)}L' for x in range(1 << BLOCK))})"
    both = f"({a}.held & {b}.held)"
    bits = " | ".join(f"shiftleft({masks}[shiftright({both}, {BLOCK * k}) & {(1 << BLOCK) - 1}], {PRINT * BLOCK * k})" for k in range(len(_PARTS)))
    return F.expr(f"{both} <> 0 and bit_count(({a}.print ^ {b}.print) & ({bits})) <= bit_count({both})")


def _pairs(hit: DataFrame) -> DataFrame:
    return hit.select(F.col("t.h").alias("ah"), F.col("t.g").alias("ag"), F.col("e.h").alias("bh"), F.col("e.g").alias("bg"))


def first_block(common: int) -> tuple[int, int]:
    """(block, reach): the first four measurements of a set, and the mask by which any set is told to have the same first four."""
    bits = [i for i in range(len(MEASURES)) if common >> i & 1][:BLOCK]
    return sum(1 << i for i in bits), (1 << (bits[-1] + 1)) - 1 if len(bits) == BLOCK else (1 << len(MEASURES)) - 1


def _covered(common: int) -> bool:
    return any(common & w == w for w in _WHOLE)


def sparse_candidates(sparse: DataFrame, others: DataFrame, sparse_sets: Sequence[int], other_sets: Sequence[int], sparse_is_train: bool, stages: Stages) -> DataFrame | None:
    """Pairs of a sparse and another record that hold no disjoint block whole; None if no sets of held measurements meet so.

    A record has a key for each block of its own set and one of the other side's; a pair meets in the block
    of what both hold and in no other.  The sparse side's keys, which also try the neighbouring cells, are
    written, so that their size tells whether they are sent to the other side's tasks.
    """
    blocks: dict[bool, set] = {True: set(), False: set()}
    for x in sparse_sets:
        for y in other_sets:
            if x & y and not _covered(x & y):
                block, reach = first_block(x & y)
                blocks[True].add((x, block, reach))
                blocks[False].add((y, block, reach))
    if not blocks[True]:
        return None
    spark = sparse.sparkSession

    def keys(rows: DataFrame, probe: bool) -> DataFrame:
        sets = spark.createDataFrame(sorted((h, b, r, [i for i in range(len(MEASURES)) if b >> i & 1]) for h, b, r in blocks[probe]), "held int, block int, reach int, at array<int>")
        rows = coded(rows).select(*_KEEP, "code", "lo", "hi").join(sets, "held")
        word = "aggregate(at, 0L, (w, i) -> shiftleft(w, {bits}) | {end})"
        if not probe:
            return rows.select(*_KEEP, "block", F.expr(word.format(bits=BITS, end="code[i]")).alias("word"))
        side = word.format(bits=BITS, end="if((shiftright(s, array_position(at, i) - 1) & 1) = 1, hi[i], lo[i])")
        return rows.select(*_KEEP, "block", "reach", F.explode(F.expr(f"array_distinct(transform(sequence(0, shiftleft(1, size(at)) - 1), s -> {side}))")).alias("word"))

    x, y = ("t", "e") if sparse_is_train else ("e", "t")
    probes = stages.write(keys(sparse, True), "probes").alias(x)
    own = keys(others, False).alias(y)
    met = (F.col(f"{x}.block") == F.col(f"{y}.block")) & (F.col(f"{x}.word") == F.col(f"{y}.word")) & F.expr(f"({x}.held & {y}.held & {x}.reach) = {x}.block")
    for w in _WHOLE:
        met &= F.expr(f"({x}.held & {y}.held & {w}) <> {w}")
    return _pairs(own.join(probes, met & _within(x, y)))


def candidates(reps: DataFrame, stages: Stages) -> DataFrame:
    """(ah, ag, bh, bg): representatives of train and eval that share a block and lie within the Hamming radius."""
    train, eval_ = reps.filter("role = 'train'"), reps.filter("role = 'eval'")
    t, e = _whole_blocks(train, False).alias("t"), _whole_blocks(eval_, True).alias("e")
    hit = t.join(e, (F.col("t.block") == F.col("e.block")) & (F.col("t.word") == F.col("e.word")) & _within("t", "e"))
    found = [_pairs(hit).distinct()]
    # the sets of held measurements that occur: at most 4096 a side
    sets = reps.groupBy("role", "held").agg(F.count(F.lit(1)).alias("n")).collect()
    of = lambda role, sparse: [r["held"] for r in sets if r["role"] == role and (len(MEASURES) - r["held"].bit_count() >= SPARSE) is sparse]
    sparse = {role: stages.write(rows.filter(f"miss >= {SPARSE}"), f"sparse-{role}") for role, rows in (("train", train), ("eval", eval_)) if of(role, True)}
    if "eval" in sparse:
        found.append(sparse_candidates(sparse["eval"], train, of("eval", True), of("train", False) + of("train", True), False, stages))
    if "train" in sparse:
        found.append(sparse_candidates(sparse["train"], eval_.filter(f"miss < {SPARSE}"), of("train", True), of("eval", False), True, stages))
    return reduce(DataFrame.unionByName, [f for f in found if f is not None])


def _near_names(a: str, b: str) -> bool:
    """One typing slip at most: a letter added, left out, replaced, or two neighbours swapped."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    x, y = a[k:], b[k:]
    return x[1:] == y[1:] or x[1:] == y or x == y[1:] or (x[:2] == y[:2][::-1] and len(x) > 1 and x[2:] == y[2:])


def _squeezed(name: str) -> str:
    """Without underscores, and numbers without leading zeros."""
    out, zero = [], True
    for k, c in enumerate(name):
        if c == "_":
            continue
        if c == "0" and zero and k + 1 < len(name) and name[k + 1].isdigit():
            continue
        out.append(c)
        zero = not c.isdigit()
    return "".join(out)


@F.pandas_udf(T.BooleanType())
def same_but_slips(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whether two names can be one, typed with a slip or with another number of zeros."""
    return pd.Series([x == y or _near_names(x, y) or _near_names(_squeezed(x), _squeezed(y)) for x, y in zip(a, b)], dtype=bool)


def _agree(tolerance: float) -> Column:
    """Every measurement that both hold agrees within the tolerance, and both hold one."""
    pairs = F.arrays_zip(F.col("ma").alias("x"), F.col("mb").alias("y"))
    both = F.filter(pairs, lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    return (F.size(both) > 0) & F.forall(both, lambda p: F.abs(p["x"] - p["y"]) <= tolerance * F.greatest(p["x"], p["y"]) * (1 + 1e-12))


def _compatible(x: str, y: str) -> Column:
    """Names don't contradict: one is unknown, or they are equal but for slips.  Only unequal names reach Python."""
    a, b = F.col(x), F.col(y)
    return a.isNull() | b.isNull() | (a == b)


def record_classes(footprints: DataFrame, stages: Stages | None = None) -> tuple[DataFrame, DataFrame]:
    """Links (ah, ag, bh, bg) between representatives, and membership (h, g, id, role, split, source) of all rows.

    This is the short form of the result: exact copies are one representative, and their pairs aren't spelt out.
    """
    stages = stages or Stages(footprints.sparkSession, "fingerprint")
    records = stages.write(_named(footprint_records(footprints)), "records")
    reps = stages.write(representatives(records), "representatives")
    cand = stages.write(candidates(reps, stages), "candidates")
    side = lambda n: reps.select(F.col("h").alias(f"{n}h"), F.col("g").alias(f"{n}g"), F.col("m").alias(f"m{n}"), F.col("ind").alias(f"i{n}"), F.col("trail").alias(f"t{n}"))
    alike = cand.join(side("a"), ["ah", "ag"]).join(side("b"), ["bh", "bg"]).filter(_agree(TOLERANCE))
    pair = ["ah", "ag", "bh", "bg"]
    alike = stages.write(alike.select(*pair, "ia", "ib", "ta", "tb"), "alike")
    clear = _compatible("ia", "ib") & _compatible("ta", "tb")
    sure = alike.filter(clear).select(*pair)
    fill = lambda c: F.coalesce(c, F.lit(""))
    doubt = alike.filter(~clear).withColumns({"si": same_but_slips(fill("ia"), fill("ib")), "st": same_but_slips(fill("ta"), fill("tb"))})
    doubt = doubt.filter("(si or ia is null or ib is null) and (st or ta is null or tb is null)").select(*pair)
    return stages.write(sure.unionByName(doubt), "links"), records.select("h", "g", "id", "role", "split", "source")


def cross_split_pairs(footprints: DataFrame) -> DataFrame:
    """(train_id, eval_id, split, source): rows of train and of test or inference that record one impression.

    Rows of no split, without an id or without any measurement are in no pair.  Measurements that are
    null, NaN, infinite or not positive are missing.  Any number of rows may record one impression:
    all their pairs come out, while exact copies are compared once.  ``source`` is the data origin of
    the evaluation row in label form.  An empty table gives no rows.
    """
    links, members = record_classes(footprints)
    train = members.filter("role = 'train'").select(F.col("h").alias("ah"), F.col("g").alias("ag"), F.col("id").alias("train_id"))
    eval_ = members.filter("role = 'eval'").select(F.col("h").alias("bh"), F.col("g").alias("bg"), F.col("id").alias("eval_id"), "split", "source")
    return links.join(train, ["ah", "ag"]).join(eval_, ["bh", "bg"]).select("train_id", "eval_id", "split", "source")


def overlap_counts(pairs: DataFrame) -> DataFrame:
    """(split, source, n_pairs, n_eval, n_train): overlaps by split and data origin of the evaluation rows."""
    return pairs.groupBy("split", "source").agg(F.count(F.lit(1)).alias("n_pairs"), F.countDistinct("eval_id").alias("n_eval"), F.countDistinct("train_id").alias("n_train"))
