"""Label expressions: clean spelling of names, base trails, label ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that count as outer white space.
WHITE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0                　"
UNKNOWN = "unknown"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trimmed(c: str | Column) -> Column:
    """Without outer white space of any kind."""
    return F.btrim(_col(c), F.lit(WHITE))


def label_form(c: str | Column, fill: str | None = UNKNOWN) -> Column:
    r"""Label form: missing becomes ``fill``, trimmed, lower case, each run of ``\W`` one ``_``.

    ``(?U)`` makes Java's ``\W`` follow Unicode, so letters with accents stay letters.
    An empty text stays empty.  Most texts are in that form already, which is seen at a glance.
    """
    c = _col(c)
    out = F.when(c.rlike(r"\A[a-z0-9_]+\z"), c).otherwise(F.regexp_replace(F.lower(trimmed(c)), r"(?U)\W+", "_"))
    return out if fill is None else F.coalesce(out, F.lit(fill))


def known(label: Column) -> Column:
    """Null where a label in label form names nothing (``unknown`` or empty)."""
    return F.when((label != UNKNOWN) & (label != ""), label)


def base_trail(c: str | Column) -> Column:
    """Base trail of a trail id: its label form up to the first ``_sub``; null if it names no trail."""
    return known(F.substring_index(label_form(c, None), "_sub", 1))


def flag_true(c: str | Column) -> Column:
    """True where a flag reads ``true`` once trimmed and lower-cased; false otherwise, null included."""
    return F.coalesce(F.lower(trimmed(_col(c).cast("string"))) == "true", F.lit(False))
