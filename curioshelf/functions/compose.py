"""Boolean composition of filter predicates.

A predicate is a boolean ``Column`` or ``None``; ``None`` means "no constraint" and is dropped.
Predicates are left three-valued (SQL ``NULL`` on a missing field): a filter treats ``NULL`` as
false, and a bare comparison can be pushed into the parquet scan.  Only :func:`none_of` needs the
two-valued reading, so the ``coalesce`` is put there and nowhere else.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _given(preds) -> list[Column]:
    return [p for p in preds if p is not None]


def all_of(*preds: Column | None) -> Column:
    """Conjunction; with nothing to constrain it is a true term."""
    given = _given(preds)
    return reduce(and_, given) if given else F.lit(True)


def any_of(*preds: Column | None) -> Column | None:
    """Disjunction; with nothing left it is no constraint at all."""
    given = _given(preds)
    return reduce(or_, given) if given else None


def none_of(*preds: Column | None) -> Column | None:
    """Negation of the disjunction, true where the fields are missing."""
    anyway = any_of(*preds)
    return None if anyway is None else ~two_valued(anyway)


def two_valued(pred: Column) -> Column:
    """The predicate as a plain true/false value, for use in a projection."""
    return F.coalesce(pred, F.lit(False))


def where(df: DataFrame, pred: Column | None) -> DataFrame:
    return df if pred is None else df.filter(pred)
