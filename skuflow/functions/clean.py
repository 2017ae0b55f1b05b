"""Column-level cleaning rules: coercion, flags, clips, rounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def number_or(c: Column | str, default: float) -> Column:
    """Parse to double; anything unparsable becomes ``default``."""
    return F.coalesce(_col(c).try_cast("double"), F.lit(float(default)))


def whole_number_or(c: Column | str, default: int) -> Column:
    """Parse to a whole number, cutting decimals; anything unparsable becomes ``default``."""
    return F.coalesce(_col(c).try_cast("double").try_cast("bigint"), F.lit(default).cast("bigint"))


def flag(c: Column | str) -> Column:
    """True/"True" -> 1.0; false, null or anything else -> 0.0."""
    return F.coalesce(_col(c).cast("string").try_cast("boolean").cast("double"), F.lit(0.0))


def day_first(c: Column | str) -> Column:
    """dd-MM-yyyy, with ISO as the second try."""
    c = _col(c)
    return F.coalesce(F.try_to_timestamp(c, F.lit("dd-MM-yyyy")), F.try_to_timestamp(c, F.lit("yyyy-MM-dd"))).cast(
        "date"
    )


def non_negative(c: Column | str) -> Column:
    return F.greatest(_col(c), F.lit(0.0))


def finite_or_zero(df: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    """Null, NaN and infinities become 0 in every numeric column, in one projection."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if f.name in skip or not isinstance(f.dataType, T.NumericType):
            out.append(c)
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            finite = F.when(F.abs(c) < float("inf"), c)  # NaN sorts above infinity in Spark
            out.append(F.coalesce(finite, F.lit(0.0)).alias(f.name))
        else:
            out.append(F.coalesce(c, F.lit(0).cast(f.dataType)).alias(f.name))
    return df.select(*out)


def rounded(c: Column | str, digits: int = 4) -> Column:
    """Round for reports: exact halves, which float noise puts on either side, go up; no negative zero."""
    return F.round(_col(c) + F.lit(1e-9), digits) + F.lit(0.0)


def even_rounded(c: Column | str, digits: int = 2) -> Column:
    """Round half to even, as Python does."""
    return F.bround(_col(c), digits) + F.lit(0.0)


def pick_quantity(c: Column | str) -> Column:
    """Whole pieces to pick: half-even, at least one."""
    return F.greatest(F.lit(1).cast("bigint"), F.bround(_col(c), 0).cast("bigint"))


def log_target(c: Column | str) -> Column:
    return F.log1p(_col(c))


def unlog_target(c: Column | str) -> Column:
    return F.greatest(F.expm1(_col(c)), F.lit(0.0))
