"""Column expressions for reading cells, comparing numbers and naming roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from undertow.functions import vocabulary as words

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
SPACE = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
EDGE_SPACE = f"^{SPACE}|{SPACE}$"
DRESSED = r"[$€₹,\\()%]|" + SPACE
MAYBE_NUMBER = rf"^(?:{SPACE}|[,$€₹()%])*[+-]?[,$€₹]*(?:[\d.]|[iI][,$€₹]*[nN]|[nN][,$€₹]*[aA])"
HEADER_NUMBER = r"(?i)^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity|nan)$"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def column(name: str) -> Column:
    return F.col(quoted(name))


def number(name: str) -> Column:
    """A number column as doubles; NaN is missing."""
    return nan_to_null(column(name).cast("double"))


def sql_double(value: float) -> str:
    """A double literal that reads back as exactly the same value."""
    return f"CAST('{value!r}' AS DOUBLE)"


def sql_text(value: str) -> str:
    """A string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def long_numbers(df: DataFrame, names: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row and column: (slot, value). Plans built on it do not grow with the width."""
    slots = [f"{i}" for i in range(len(names))]
    kept = [column(k).alias(k) for k in keep]
    wide = df.select(*kept, *[number(n).alias(s) for n, s in zip(names, slots)])
    long = wide.unpivot(list(keep), slots, "slot", "value")
    return long.withColumn("slot", F.col("slot").cast("int"))


def listed(frame: DataFrame, fields: list[str], rows: list[list[str]]) -> DataFrame:
    """Turn a one-row frame into many rows, each given as one SQL expression per field."""
    structs = [
        "named_struct(" + ", ".join(f"'{f}', {cell}" for f, cell in zip(fields, row)) + ")"
        for row in rows
    ]
    return frame.select(F.expr(f"inline(array({', '.join(structs)}))"))


def numeric_columns(df: DataFrame, leave_out: tuple[str, ...] = ()) -> list[str]:
    """Number columns in schema order. Booleans are categories, not numbers."""
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in leave_out
    ]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def flat_columns(df: DataFrame, leave_out: tuple[str, ...] = ()) -> list[str]:
    """Columns whose values can be compared: arrays, maps, structs and variants are not."""
    nested = (T.ArrayType, T.MapType, T.StructType, T.VariantType)
    return [
        f.name
        for f in df.schema.fields
        if not isinstance(f.dataType, nested) and f.name not in leave_out
    ]


def strip(c: Column) -> Column:
    """Without white space at either end. Most cells have none, and a test is cheaper than a cut."""
    return F.when(c.rlike(EDGE_SPACE), F.btrim(c, F.lit(words.WHITESPACE))).otherwise(c)


def missing_to_null(trimmed: Column) -> Column:
    """Turn the words for "missing" into NULL. Expects a stripped cell."""
    return F.when(~trimmed.isin(*words.NULL_TOKENS), trimmed)


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def number_from_text(c: Column) -> Column:
    """Read `$1,200`, `72,000`, `85%` or `(12)` as a double; NULL when it is no number.

    The pattern keeps out what only a cast takes for a number, such as `1d` or `NaN`; words for
    "missing" fail it too.
    """
    bare = F.rtrim(F.translate(c, words.MONEY_SIGNS + words.WHITESPACE, ""), F.lit("%"))
    digits = F.regexp_extract(F.when(c.rlike(DRESSED), bare).otherwise(c), NUMBER, 0)
    value = digits.try_cast("double")
    bracketed = F.contains(c, F.lit("(")) & strip(c).rlike(r"(?s)^\(.*\)$")
    return F.when(bracketed, -value).otherwise(value)


def is_filled(c: Column) -> Column:
    """Whether a text cell holds more than white space; NULL if it is missing."""
    return c.rlike(f"(?!{SPACE})(?s:.)")


def reads_as_number(c: Column) -> Column:
    """Whether a text cell looks like a number to the header search (never NULL).

    How the cell begins rules out most words; only the others are undressed.
    """
    bare = F.btrim(F.translate(strip(c), ",$€₹", ""), F.lit("()% "))
    word = ~F.lower(bare).isin(*words.HEADER_NON_NUMBERS)
    return F.coalesce(c.rlike(MAYBE_NUMBER) & bare.rlike(HEADER_NUMBER) & word, F.lit(False))


def is_date_like(c: Column) -> Column:
    return c.rlike(words.DATE_LIKE)


def role_of(name: Column) -> Column:
    """The role a column name suggests; the first matching rule wins."""
    lowered = F.lower(name)
    role = None
    for label, hints in words.ROLE_WORDS:
        hit = F.lit(False)
        for hint in hints:
            hit = hit | lowered.contains(hint)
        role = F.when(hit, label) if role is None else role.when(hit, label)
    return role.otherwise(words.DEFAULT_ROLE)


def percent_change(a: Column, b: Column) -> Column:
    """(a - b) / |b| in percent to one decimal; 0 where b is 0 or missing."""
    return F.coalesce(F.round((a - b) / F.nullif(F.abs(b), F.lit(0.0)) * 100, 1), F.lit(0.0))


def mean_or_zero(c: Column) -> Column:
    return F.coalesce(F.avg(c.try_cast("double")), F.lit(0.0))


def confidence(count: Column, effect: Column) -> Column:
    """55..94: grows with the group's size and with the size of the effect."""
    grown = F.lit(70.0) + F.least(F.lit(12), count) + F.least(F.lit(10.0), F.abs(effect) / 3)
    return F.floor(F.least(F.lit(94.0), F.greatest(F.lit(55.0), grown))).cast("int")
