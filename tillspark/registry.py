"""Named queries over the mapped retail tables, with their fixed parameters.

``QUERIES[name](retail)`` returns a DataFrame in library types (decimals,
timestamps); ``present`` turns it into the compared form (doubles, text
datetimes) shared with the DuckDB oracle in ``tillspark.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sources.mapping import Retail

# Fixed parameters of every registered query.
PERIOD = ("1997-01-01", "1997-12-31")
AS_OF = "1997-12-31"
TOP_N = 10
RECENT_SALES = 100
RECENT_PURCHASES = 200
Q_PRODUCTS = "ring"
Q_SALES = "INV-12"
Q_SUPPLIERS = "Supplier#00000001"
Q_EXPENSES = "err"

QUERIES: dict[str, Callable[[Retail], DataFrame]] = {}


def query(name: str, kept: tuple[str, ...] | dict[str, str] = ()):
    """Register a query; the views ``kept`` are those it reads several times, in the order in which they are built.

    A dict names the columns that the query reads of each view; the others are not built.
    """

    def deco(fn):
        QUERIES[name] = (lambda r: fn(r.kept(kept))) if kept else fn
        return fn

    return deco


def canonical(c: Column, t: T.DataType) -> Column:
    """One text of a nested value, written alike by both engines: JSON with every field, decimals at their scale."""
    if isinstance(t, T.StructType):
        fields = [F.concat(F.lit(f'"{f.name}":'), canonical(c[f.name], f.dataType)) for f in t.fields]
        text = F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))
        return F.coalesce(F.when(c.isNotNull(), text), F.lit("null"))
    if isinstance(t, T.ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: canonical(x, t.elementType)), ","), F.lit("]"))
    elif isinstance(t, (T.TimestampNTZType, T.TimestampType)):
        text = F.concat(F.lit('"'), F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.lit('"'))
    elif isinstance(t, T.StringType):
        text = F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit("null"))


def present(df: DataFrame) -> DataFrame:
    """Decimals → double, datetimes → ``yyyy-MM-dd HH:mm:ss`` text, dates → ISO text, nested values → ``canonical`` text."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, (T.TimestampNTZType, T.TimestampType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, (T.StructType, T.ArrayType)):
            c = canonical(c, f.dataType)
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        cols.append(c.alias(f.name))
    return df.select(*cols)


# Registration of every operator lives in the operator-facing module below.
from . import catalog as _catalog  # noqa: E402,F401
