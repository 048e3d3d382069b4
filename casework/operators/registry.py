"""Registry key records from decoded key and value tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from casework.functions import paths, registry as reg
from casework.functions.binary import to_hex
from casework.operators.ordered import Carry, scan

VALUE_BYTES = 64  # what a value takes besides its data
U32_NONE, I32_NONE = 0xFFFFFFFF, -1


def value_records(values: DataFrame, by: Sequence[str] = ("key_id",)) -> DataFrame:
    """Normalised values: lengths, hex, resident flag, unwrapped decoded JSON."""
    data = F.coalesce(F.col("data"), F.lit(b""))
    size = reg.value_size(F.col("data_size_raw"))
    empty = (F.length(data) == 0) & (size == 0)
    return values.select(
        *by, "value_no", "value_name", "data_type",
        F.length(data).cast("bigint").alias("value_data_length"),
        to_hex(data).alias("value_data_hex"),
        reg.unwrap_value(F.col("decoded"), empty).alias("value_decoded"),
        empty.alias("value_is_empty"),
        F.col("data_size_raw").cast("bigint").alias("data_size_raw"),
        size.alias("data_size"),
        reg.is_resident(F.col("data_size_raw")).alias("resident_data"),
    )


def key_paths(role: Column, key_path: Column) -> dict[str, Column]:
    sid = reg.root_sid(key_path)
    return {
        "registry_path": reg.registry_path(role, key_path),
        "parent_key_path": reg.parent_key(key_path),
        "hive_mapping": reg.hive_mapping(role, sid),
        "sid": sid,
    }


def key_rows(keys: DataFrame) -> DataFrame:
    """Key columns without the values: role, user, paths, sentinels."""
    role = reg.hive_role(F.col("hive_name"))
    df = keys.withColumns({"data_type": F.lit("windows:registry:key"), "hive_role": role})
    df = df.withColumns(key_paths(F.col("hive_role"), F.col("key_path")))
    return df.withColumns(
        {
            "user": paths.user_or_null(F.col("source_path")),
            "hive_user_context": paths.hive_context(F.col("source_path")),
            "sub_keys_list_offset_relative": reg.null_sentinel(F.col("sub_keys_list_offset_relative_raw"), U32_NONE),
            "key_values_list_offset_relative": reg.null_sentinel(F.col("key_values_list_offset_relative_raw"), I32_NONE),
        }
    )


# A key is one of its hive, and a hive one of its case, as far as both tables say so.
KEY = ("case_id", "source_path", "key_id")
PART_BYTES = 64 << 20


def nested_values(values: DataFrame, by: Sequence[str], part_bytes: int = PART_BYTES, width: int | None = None) -> DataFrame:
    """``by``, part_no, n_parts, value_count and ``values`` in order of value_no: the values of a key in numbered parts.

    A part ends with the value that fills ``part_bytes`` of data, so no cell grows with the key; the running size comes from an
    ordered scan, which spreads a key that holds a third of all values over many tasks.
    """
    by = list(by)
    rows = value_records(values, by)
    filled = scan(rows, by, "value_no", carries={"__before": Carry("sum", F.col("value_data_length") + VALUE_BYTES)}, width=width)
    fields = ("value_no", "value_name", "data_type", "value_data_length", "value_data_hex", "value_decoded", "value_is_empty", "data_size_raw", "data_size", "resident_data")
    parts = filled.groupBy(*by, F.floor(F.col("__before") / part_bytes).alias("__part")).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("values"))
    # numbers without gaps, over as many rows as a key has parts
    along = Window.partitionBy(*by)
    return parts.select(
        *by, (F.row_number().over(along.orderBy("__part")) - 1).cast("bigint").alias("part_no"), F.count("*").over(along).alias("n_parts"),
        F.sum(F.size("values")).over(along).cast("bigint").alias("value_count"), "values",
    )


def key_records(keys: DataFrame, values: DataFrame, part_bytes: int = PART_BYTES, width: int | None = None) -> DataFrame:
    """Key rows with their values nested; a key whose values exceed ``part_bytes`` has a row per part, all with its full count.

    Tables are joined by case, hive and key: equal key numbers of two hives are different keys.
    """
    by = [c for c in KEY if c in keys.columns and c in values.columns]
    joined = key_rows(keys).join(nested_values(values, by, part_bytes, width), by, "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(n)).cast("bigint") for c, n in {"part_no": 0, "n_parts": 1, "value_count": 0}.items()})


def hive_counts(hives: DataFrame, keys: list[str]) -> DataFrame:
    """Hives read and keys found; a failed hive counts for neither."""
    ok = F.col("status") == "ok"
    return hives.groupBy(*keys).agg(
        F.count_if(ok).cast("bigint").alias("hives"),
        F.coalesce(F.sum(F.when(ok, F.col("keys"))), F.lit(0)).cast("bigint").alias("keys"),
    )
