"""Tenants, custom fields, permissions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GLOBAL = "__global__"


def scoped(rows: DataFrame, tenant: str | None) -> DataFrame:
    return rows.where(F.coalesce("tenant_id", F.lit(GLOBAL)) == (tenant or GLOBAL))


def validate(docs: DataFrame, fields: DataFrame, key: str = "slug", values: str = "extra") -> DataFrame:
    """(key, errors): missing required fields and values that don't have the
    field's type.  ``values`` is a map of JSON values; fields (field_name,
    field_type in string, int, float, bool, list; required).  A tenant's fields
    are one array that goes to the documents, whose rows stay where they are."""

    def error(f: Column) -> Column:
        v, kind = F.try_element_at(values, f["field_name"]), f["field_type"]
        ok = (
            F.when(kind == "string", v.rlike(r'^".*"$'))
            .when(kind == "int", v.rlike(r"^(-?[0-9]+|true|false)$"))
            .when(kind == "float", v.rlike(r"^(-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?|true|false)$"))
            .when(kind == "bool", v.rlike("^(true|false)$"))
            .when(kind == "list", v.rlike(r"^\[.*\]$"))
        )
        missing = F.concat(F.lit("missing required field: "), f["field_name"])
        wrong = F.concat(f["field_name"], F.lit(" is no "), kind)
        return F.when(v.isNull() & f["required"], missing).when(v.isNotNull() & ~F.coalesce(ok, F.lit(False)), wrong)

    listed = fields.agg(F.collect_list(F.struct("field_name", "field_type", "required")).alias("_fields"))
    rows = docs.select(key, values).crossJoin(F.broadcast(listed))  # one row
    errors = F.filter(F.transform("_fields", error), lambda e: e.isNotNull())
    return rows.select(key, F.array_join(F.array_sort(errors), "; ").alias("errors"))


def permitted(method: Column, read_only: Column) -> Column:
    return ~read_only | F.upper(method).isin("GET", "HEAD", "OPTIONS")
