"""Writers: result lines, run manifests, search-export batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from casework.operators.ordered import DEFAULT_WIDTH, numbered

BULK_BATCH = 500


def write_results(df: DataFrame, root: str, by: Sequence[str] = ("family", "artifact"), fmt: str = "json") -> None:
    """Result records partitioned by family and artifact; whatever was there before is replaced."""
    df.write.partitionBy(*by).mode("overwrite").format(fmt).save(root)


def manifest_json(entries: DataFrame, run: str = "case_id", pretty: bool = True) -> DataFrame:
    """One JSON manifest per run. Entries of a run are at most one per catalogued artifact or family."""
    fields = [c for c in entries.columns if c != run]
    key = lambda x: F.concat_ws("\0", *[x[c] for c in ("parser", "artifact", "error") if c in fields])
    order = lambda a, b: F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0)  # noqa: E731 - maps have no order
    total = F.sum("exported_records") if "exported_records" in fields else F.lit(None).cast("bigint")
    grouped = entries.groupBy(run).agg(
        F.array_sort(F.collect_list(F.struct(*sorted(fields, key=lambda c: c != "parser"))), order).alias("entries"),
        F.array_sort(F.collect_set("collection")).alias("collections"),
        total.alias("exported_records"),
    )
    body = F.to_json(F.struct(run, "collections", "entries", "exported_records"), {"pretty": str(pretty).lower()})
    return grouped.select(run, body.alias("value"))


def write_manifest(entries: DataFrame, root: str, run: str = "case_id") -> None:
    manifest_json(entries, run).write.partitionBy(run).mode("overwrite").text(root)


def with_provenance(df: DataFrame, parser: Column, artifact: Column, package: Column, result_file: Column) -> DataFrame:
    """Records with the four facts that trace them: parser, artifact, package, output file name."""
    return df.withColumns(
        {
            "export_parser": parser,
            "export_artifact": artifact,
            "export_input_zip": package,
            "export_output_file": F.substring_index(result_file, "/", -1),
        }
    )


def batch_ids(df: DataFrame, keys: Sequence[str], order: str, batch_size: int = BULK_BATCH, width: int | None = DEFAULT_WIDTH) -> DataFrame:
    """Add ``batch_no``: every ``batch_size`` consecutive records of an output, never fewer than one."""
    size = max(batch_size, 1)
    ranked = numbered(df, keys, order, "__rn", width)
    return ranked.withColumn("batch_no", F.floor((F.col("__rn") - 1) / size).cast("bigint")).drop("__rn")


def bulk_batches(
    df: DataFrame, keys: Sequence[str], order: str, document: Column, batch_size: int = BULK_BATCH,
    width: int | None = DEFAULT_WIDTH,
) -> DataFrame:
    """Bulk payloads: an action line and a document line per record; a group is one batch, so bounded."""
    rows = batch_ids(df.withColumn("__doc", document), keys, order, batch_size, width)
    parts = F.transform(
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("__doc").alias("d")))),
        lambda x: F.concat(F.lit('{"index":{}}\n'), x["d"], F.lit("\n")),
    )
    return rows.groupBy(*keys, "batch_no").agg(
        F.count("*").cast("bigint").alias("records"), F.array_join(parts, "").alias("payload")
    )


def write_bulk(batches: DataFrame, root: str) -> None:
    """Batches as .ndjson text, blank lines excepted as the bulk format demands a final newline."""
    batches.select(F.rtrim(F.col("payload"), F.lit("\n")).alias("value")).write.mode("overwrite").option(
        "lineSep", "\n"
    ).text(root)


RESPONSE_SCHEMA = "errors boolean, items array<map<string,struct<status:int,error:string>>>"


def reconcile_bulk(responses: DataFrame, keys: Sequence[str], body: str = "body") -> DataFrame:
    """Verdict per response: successes, and the first item outside 2xx that fails the batch.

    A response flagged with errors fails even when every item succeeded; an unreadable one fails too.
    """
    parsed = responses.withColumn("__r", F.from_json(F.col(body), RESPONSE_SCHEMA))
    results = F.flatten(F.transform("__r.items", F.map_values))
    numbered_items = F.transform(results, lambda r, i: F.struct(i.alias("i"), r["status"].alias("status"), r["error"].alias("error")))
    df = parsed.withColumn("__items", F.coalesce(numbered_items, F.array().cast("array<struct<i:int,status:int,error:string>>")))
    ok = F.filter("__items", lambda x: x["status"].between(200, 299))
    first_bad = F.get(F.filter("__items", lambda x: ~F.coalesce(x["status"].between(200, 299), F.lit(False))), F.lit(0))
    failed = first_bad.isNotNull() | F.coalesce(F.col("__r.errors"), F.lit(True))
    reason = (
        F.when(first_bad.isNotNull(), F.concat(F.lit("item failed with status "), first_bad["status"].cast("string"),
               F.coalesce(F.concat(F.lit(": "), first_bad["error"]), F.lit(""))))
        .when(F.coalesce(F.col("__r.errors"), F.lit(True)), "response reported errors")
    )
    return df.select(
        *keys,
        F.size(ok).cast("bigint").alias("succeeded"),
        F.when(failed, F.lit(0)).otherwise(F.size(ok)).cast("bigint").alias("indexed"),
        reason.alias("error"),
    )
