"""Date parsing expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from tabwright.functions.columns import col, is_date, is_string

# Strptime directives and the Spark pattern letters they stand for.
DIRECTIVES = {
    "Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss",
    "y": "yy", "b": "MMM", "B": "MMMM", "f": "SSSSSS", "I": "hh", "p": "a", "j": "DDD",
}
# Patterns tried when no format is given; the first one wins a tie.
DATE_PATTERNS = ["yyyy-MM-dd", "yyyy/MM/dd", "dd-MM-yyyy", "dd/MM/yyyy", "MM/dd/yyyy"]
TIMESTAMP_PATTERNS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "dd-MM-yyyy HH:mm:ss", "dd/MM/yyyy HH:mm:ss"]


def spark_pattern(fmt: str) -> str:
    """A strptime format as a Spark datetime pattern."""
    out, i = [], 0
    while i < len(fmt):
        ch = fmt[i]
        if ch == "%" and i + 1 < len(fmt):
            directive = fmt[i + 1]
            if directive == "%":
                out.append("%")
            elif directive == "F":
                out.append("yyyy-MM-dd")
            elif directive == "T":
                out.append("HH:mm:ss")
            elif directive in DIRECTIVES:
                out.append(DIRECTIVES[directive])
            else:
                raise ValueError(f"Unsupported date format directive: %{directive}")
            i += 2
            continue
        out.append(f"'{ch}'" if ch.isalpha() else "''" if ch == "'" else ch)
        i += 1
    return "".join(out)


def parse_date(c: Column, pattern: str) -> Column:
    return F.try_to_date(c, pattern)


def parse_datetime(c: Column, pattern: str) -> Column:
    return F.try_to_timestamp(c, F.lit(pattern)).cast("timestamp_ntz")


def date_source(name: str, t: T.DataType) -> Column:
    """The text a date is parsed from: strings as they are, other types by ten characters."""
    if is_string(t) or is_date(t):
        return col(name)
    return F.substring(col(name).cast("string"), 1, 10)


def components(name: str, wanted: list[str]) -> dict[str, Column]:
    """New column name -> component expression, Monday being weekday 1."""
    made = {
        "year": (f"{name}_year", F.year(col(name))),
        "month": (f"{name}_month", F.month(col(name))),
        "day": (f"{name}_day", F.dayofmonth(col(name))),
        "day_of_week": (f"{name}_weekday", F.weekday(col(name)) + F.lit(1)),
    }
    return {made[k][0]: made[k][1] for k in made if k in wanted}
