"""Scalar Column expressions (P1, P4-P8, P14, P15) shared by all operators.

Everything here returns a ``Column`` built from built-in functions, so it stays
inside whole-stage codegen and is evaluated on the executors.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values (must equal the reference's behaviour):
# - the e-mail pattern of the dictionary text rule
EMAIL_PATTERN = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
# - text accepted as a number (a strict subset of what Java parses: "1d" and "1f"
#   are not numbers), surrounding blanks allowed, infinity words allowed
NUMERIC_TEXT_PATTERN = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$"

POS_INF = float("inf")


def is_float_type(dt: T.DataType) -> bool:
    return isinstance(dt, (T.FloatType, T.DoubleType))


def is_numeric_type(dt: T.DataType) -> bool:
    return isinstance(dt, T.NumericType)


def is_integral_type(dt: T.DataType) -> bool:
    return isinstance(dt, T.IntegralType)


def col_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_missing(c: Column | str, dt: T.DataType) -> Column:
    """NULL, or NaN for floating columns (pandas ``isna``)."""
    c = F.col(c) if isinstance(c, str) else c
    return (c.isNull() | F.isnan(c)) if is_float_type(dt) else c.isNull()


def nan_to_null(c: Column | str, dt: T.DataType) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c), c) if is_float_type(dt) else c


def normalize_missing(df: DataFrame, tokens: Iterable[str] = ()) -> DataFrame:
    """NaN -> NULL on floating columns; listed text tokens -> NULL on string columns."""
    tokens = list(tokens)
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if is_float_type(f.dataType):
            c = nan_to_null(c, f.dataType)
        elif tokens and isinstance(f.dataType, T.StringType):
            c = F.when(~c.isin(tokens), c)
        out.append(c.alias(f.name))
    return df.select(*out)


def to_numeric(c: Column | str, dt: T.DataType) -> Column:
    """Safe numeric cast to double; invalid text -> NULL (NaN kept out)."""
    c = F.col(c) if isinstance(c, str) else c
    if is_numeric_type(dt):
        return nan_to_null(c.cast("double"), T.DoubleType())
    s = c.cast("string")
    return F.when(s.rlike(NUMERIC_TEXT_PATTERN), F.trim(s).try_cast("double"))


# Strptime directive -> Spark datetime pattern. %m and %d become the
# one-or-two-digit forms because strptime accepts a single digit there.
STRPTIME_TO_SPARK = {
    "%Y": "yyyy", "%y": "yy", "%m": "M", "%d": "d", "%H": "H", "%I": "h", "%M": "m",
    "%S": "s", "%f": "SSSSSS", "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE",
    "%p": "a", "%j": "D", "%z": "Z", "%%": "%",
}


def strptime_to_spark(fmt: str) -> str:
    """Translate a strptime pattern to a Spark datetime pattern; literal letters quoted."""
    out, i = [], 0
    while i < len(fmt):
        tok = fmt[i:i + 2]
        if tok in STRPTIME_TO_SPARK:
            out.append(STRPTIME_TO_SPARK[tok])
            i += 2
            continue
        ch = fmt[i]
        if ch.isalpha() or ch == "'":
            out.append("''" if ch == "'" else f"'{ch}'")
        else:
            out.append(ch)
        i += 1
    return "".join(out)


def to_date_fmt(c: Column | str, dt: T.DataType, strptime_fmt: str = "%Y-%m-%d") -> Column:
    """P5: parse with a strptime pattern; unparseable -> NULL. Dates/timestamps pass through."""
    c = F.col(c) if isinstance(c, str) else c
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return c
    if isinstance(dt, T.DateType):
        return c.cast("timestamp")
    return F.try_to_timestamp(c.cast("string"), F.lit(strptime_to_spark(strptime_fmt)))


def in_set(c: Column | str, values: Iterable[str]) -> Column:
    """Membership on the string form of the value."""
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("string").isin(list(values))


def matches(c: Column | str, pattern: str) -> Column:
    """Regex match anchored at the start of the text (as ``re.match``)."""
    c = F.col(c) if isinstance(c, str) else c
    pat = pattern if pattern.startswith("^") else "^(?:" + pattern + ")"
    return c.cast("string").rlike(pat)


def is_inf(c: Column | str) -> Column:
    """+/- infinity."""
    c = F.col(c) if isinstance(c, str) else c
    return F.abs(c.cast("double")) == F.lit(POS_INF)


def replace_inf(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """+/- infinity -> NULL on the given (default: all floating) columns."""
    names = set(cols) if cols is not None else {f.name for f in df.schema.fields if is_float_type(f.dataType)}
    return df.select(*[
        (F.when(~is_inf(F.col(f"`{f.name}`")), F.col(f"`{f.name}`")) if f.name in names else F.col(f"`{f.name}`")).alias(f.name)
        for f in df.schema.fields])


def is_finite(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & ~F.isnan(c) & ~is_inf(c)


def format_metrics(df: DataFrame, decimals: int = 3) -> DataFrame:
    """Round floating columns, keeping NaN/inf untouched."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if is_float_type(f.dataType):
            c = F.when(is_finite(c), F.round(c, decimals)).otherwise(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def cats_to_string(df: DataFrame) -> DataFrame:
    """Non-numeric columns cast to string; NULL stays NULL."""
    return df.select(*[
        (F.col(f"`{f.name}`") if is_numeric_type(f.dataType) else F.col(f"`{f.name}`").cast("string")).alias(f.name)
        for f in df.schema.fields])


def value_text(c: Column | str, dt: T.DataType) -> Column:
    """Display form of a value in anomaly/log tables: floating and decimal values with
    two decimals (engine independent), everything else its string form."""
    c = F.col(c) if isinstance(c, str) else c
    if is_float_type(dt):
        return F.when(is_finite(c), c.cast("decimal(20,2)").cast("string")).otherwise(c.cast("string"))
    if isinstance(dt, T.DecimalType):
        return c.cast("decimal(20,2)").cast("string")
    if isinstance(dt, T.TimestampType):
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return c.cast("string")


def numeric_columns(df: DataFrame) -> list[str]:
    """P3 (names): numeric columns, booleans excluded."""
    return [f.name for f in df.schema.fields if is_numeric_type(f.dataType)]


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, (T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType))]


def select_numeric(df: DataFrame) -> DataFrame:
    """P3."""
    return df.select(*[F.col(f"`{c}`") for c in numeric_columns(df)])


def select_categorical(df: DataFrame) -> DataFrame:
    """P3."""
    return df.select(*[F.col(f"`{c}`") for c in categorical_columns(df)])


def q(name: str) -> Column:
    """Column reference that tolerates any character in the name."""
    return F.col("`" + name.replace("`", "``") + "`")
