"""A synthetic pg_catalog: namespaces, relations, types and attributes as views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NAMESPACE_BASE, CLASS_BASE = 11000, 22000
#: Base types: name, id, length, by value, category, id of the array type; fixed values.
TYPES = [
    ("bool", 16, 1, True, "B", 1000),
    ("int2", 21, 2, True, "N", 1005),
    ("int8", 20, 8, True, "N", 1016),
    ("int4", 23, 4, True, "N", 1007),
    ("float4", 700, 4, True, "N", 1021),
    ("float8", 701, 8, True, "N", 1022),
    ("numeric", 1700, -1, False, "N", 1231),
    ("text", 25, -1, False, "S", 1009),
    ("uuid", 2950, 16, True, "U", 2951),
    ("timestamp", 1114, 8, True, "D", 1115),
    ("timestamptz", 1184, 8, True, "D", 1185),
    ("date", 1082, 4, True, "D", 1182),
    ("time", 1083, 8, True, "D", 1183),
    ("jsonb", 3802, -1, False, "U", 3807),
]
#: Attributes of pg_type: name, type id, not null; fixed values.
ATTRIBUTES = [
    ("oid", 23, True),
    ("typname", 25, True),
    ("typlen", 21, True),
    ("typbyval", 16, True),
    ("typtype", 25, False),
    ("typcategory", 25, False),
    ("typdelim", 25, False),
    ("typelem", 23, False),
    ("typarray", 23, False),
    ("typbasetype", 23, False),
    ("typcollation", 23, False),
]


def rows() -> dict[str, tuple[str, list[tuple]]]:
    """Schema and rows of each view. Ids follow the order of (namespace, name) from a base."""
    spaces = {n: NAMESPACE_BASE + i for i, n in enumerate(sorted(("pg_catalog", "public")))}
    lengths = {oid: length for _, oid, length, *_ in TYPES}
    types = [(oid, name, spaces["pg_catalog"], length, by_value, "b", category, ",", 0, array) for name, oid, length, by_value, category, array in TYPES]
    types += [(array, f"_{name}", spaces["pg_catalog"], -1, False, "b", "A", ",", oid, 0) for name, oid, *_, array in TYPES]
    return {
        "pg_namespace": ("oid bigint, nspname string", [(oid, n) for n, oid in spaces.items()]),
        "pg_class": ("oid bigint, relname string, relnamespace bigint, relkind string", [(CLASS_BASE, "pg_type", spaces["pg_catalog"], "r")]),
        "pg_type": ("oid bigint, typname string, typnamespace bigint, typlen int, typbyval boolean, typtype string, typcategory string, typdelim string, typelem bigint, typarray bigint", sorted(types, key=lambda t: t[1])),
        "pg_attribute": ("attrelid bigint, attname string, atttypid bigint, attnum int, attnotnull boolean, attlen int", [(CLASS_BASE, n, t, i + 1, x, lengths[t]) for i, (n, t, x) in enumerate(ATTRIBUTES)]),
    }


def frames(spark: SparkSession) -> dict[str, DataFrame]:
    return {name: spark.createDataFrame(data, schema) for name, (schema, data) in rows().items()}


def register(spark: SparkSession) -> None:
    """The four as temporary views."""
    for name, df in frames(spark).items():
        df.createOrReplaceTempView(name)
