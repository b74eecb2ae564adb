"""Registration of queries and their oracle SQL."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentrylake.plans.fragments import compose
from sentrylake.plans.workspace import workspace

QUERIES, ORACLES = {}, {}


def tidy(df):
    """Plain columns for comparison: bigint, rounded double, text."""
    out = []
    for f in df.schema.fields:
        c, t = F.col(f"`{f.name}`"), f.dataType
        if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
            c = c.cast("bigint")
        elif isinstance(t, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), 6) + 0.0
        elif isinstance(t, T.ArrayType):
            c = F.array_join(c, ";")
        out.append(c.alias(f.name))
    return df.select(*out)


def register(name, run, sql=None, needs=(), wide=False):
    """`run(workspace)` gives the result; `sql` is its oracle over `needs`.

    `wide` runs both on the events in real time instead of thirty days packed into six hours.
    """
    QUERIES[name] = lambda spark, folder: tidy(run(workspace(spark, folder, wide)))
    if sql is not None:
        ORACLES[name] = compose(sql, *needs, wide=wide)
