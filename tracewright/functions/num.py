"""Numbers as Python's float() reads them, and tolerant matching."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewright.functions.text import strip

FLOAT = r"^[+-]?((\d+(_\d+)*(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?|(?i:nan|inf|infinity))$"


def to_float(text: Column) -> Column:
    """Null where float() would fail: no type suffix, underscores between digits only."""
    return F.when(text.rlike(FLOAT), F.replace(text, F.lit("_")).try_cast("double"))


def is_close(a: Column, b: Column, rel: float = 1e-2, tol: float = 1e-5) -> Column:
    """As math.isclose: NaN is near nothing, equal infinities are near each other."""
    endless = F.abs(a).isin(float("inf")) | F.abs(b).isin(float("inf"))
    near = F.abs(a - b) <= F.greatest(F.lit(rel) * F.greatest(F.abs(a), F.abs(b)), F.lit(tol))
    return F.when(F.isnan(a) | F.isnan(b), F.lit(False)).when(a == b, F.lit(True)).when(endless, F.lit(False)).otherwise(near)


def verify(gold: Column, predicted: Column) -> Column:
    """Bits compare as text, numbers within 1 %, all else without case; the gold answer picks the way."""
    g, p = strip(gold), strip(predicted)
    same = F.lower(g) == F.lower(p)
    x, y = to_float(g), to_float(p)
    return F.when(g.rlike("^[01]+$"), same).when(x.isNotNull() & y.isNotNull(), is_close(x, y)).otherwise(same)


def answers_match(predicted: Column, gold: Column) -> Column:
    """The stricter older match: text, then without case, then within 1 % of the gold value (near zero for zero)."""
    p, g = strip(predicted), strip(gold)
    x, y = to_float(p), to_float(g)
    whole = lambda t: F.when(t.rlike(r"^[+-]?\d+$"), t.try_cast("bigint").cast("string")).otherwise(t)
    near = F.when(y == 0, F.abs(x) < 1e-6).otherwise(F.try_divide(F.abs(x - y), F.abs(y)) <= 0.01)
    return F.coalesce((whole(p) == whole(g)) | (F.lower(p) == F.lower(g)) | F.coalesce(near & ~F.isnan(x) & ~F.isnan(y), F.lit(False)), F.lit(False))
