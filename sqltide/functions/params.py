"""Bound parameters of prepared statements."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def zip_params(oids: Column, formats: Column, values: Column) -> Column:
    """Declared types and bound values side by side, as long as the longer of the two.

    No format code means text for all, one code holds for all, more codes hold by
    position and a missing one means text. A null value is an SQL NULL.
    """
    n = F.greatest(F.coalesce(F.size(oids), F.lit(0)), F.coalesce(F.size(values), F.lit(0)))
    codes = F.coalesce(F.size(formats), F.lit(0))

    def one(i: Column) -> Column:
        code = F.when(codes == 1, F.get(formats, F.lit(0))).otherwise(F.get(formats, i))
        return F.struct(
            F.coalesce(F.get(oids, i), F.lit(0)).cast("long").alias("oid"),
            F.get(values, i).alias("value"),
            F.coalesce(code, F.lit(0)).cast("short").alias("format"))

    empty = F.array().cast("array<struct<oid:bigint,value:binary,format:smallint>>")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), one)).otherwise(empty)


def split_params(params: Column) -> Column:
    """Inverse of ``zip_params``: a struct of three arrays."""
    return F.struct(
        F.transform(params, lambda p: p["oid"]).alias("oids"),
        F.transform(params, lambda p: p["format"]).alias("formats"),
        F.transform(params, lambda p: p["value"]).alias("values"))
