"""Fixed points in a chain of projections."""

from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

T = TypeVar("T")
_BUILT: dict[tuple[str, Callable], object] = {}


def built(df: DataFrame, build: Callable[[], T]) -> T:
    """What ``build`` returns, made once per application.

    For long expressions over columns that are only named. A stream makes the same
    ones for every micro-batch, and making them can take longer than running them.
    """
    key = df.sparkSession.sparkContext.applicationId, build
    if key not in _BUILT:
        _BUILT[key] = build()
    return _BUILT[key]


def settle(df: DataFrame) -> DataFrame:
    """Compute the columns of ``df`` at this point, once per row.

    Catalyst moves a filter below a projection by writing the projected
    expressions into the condition. Over a chain of text functions, each used
    several times by the next, that repeats the work many times over. A
    generator of one row per row stops it, without a shuffle or a write. It
    also stops column pruning, so only expensive columns belong before it.
    """
    return df.select(F.inline(F.array(F.struct(*df.columns))))
