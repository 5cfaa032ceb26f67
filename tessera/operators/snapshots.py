"""Result envelopes and snapshots: parsing with a code for each fault, payloads replaced by references and restored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stable_text(json: Column) -> Column:
    """JSON with its keys sorted at every depth and no blanks; null for what is no JSON."""
    return F.to_json(F.try_parse_json(json))


def content_hash(json: Column) -> Column:
    return F.sha2(stable_text(json), 256)


#: The result types of an envelope and what their payload must hold.
TYPES = {"scalar": {"value": "string", "unit": "string"}, "table": {"rows": "array<variant>"}, "chart": {"categories": "array<variant>", "series": "array<variant>"}}


def parse_envelopes(df: DataFrame, keys: list[str], body: str) -> DataFrame:
    """keys, code, attempt, sequence, result_type, inputs, payload, hash of result envelopes (JSON text).

    The code is `ok` or the first fault: no JSON object, version, attempt, sequence, inputs, type, payload, a payload that is not
    of its type, results (one is needed), or a hash that is not the payload's. Only `ok` rows carry values.
    """
    v = F.try_parse_json(F.col(body))
    get = lambda path, kind: F.try_variant_get(F.col("_v"), path, kind)
    e = df.select(*keys, v.alias("_v")).select(
        *keys, "_v", F.schema_of_variant("_v").alias("_shape"), get("$.schemaVersion", "int").alias("version"), get("$.attempt", "int").alias("attempt"), get("$.sequence", "bigint").alias("sequence"), get("$.inputVersionIds", "array<string>").alias("inputs"),
        get("$.resultType", "string").alias("result_type"), get("$.payload", "variant").alias("_payload"), get("$.results", "array<variant>").alias("_results"), get("$.results[0].hash", "string").alias("hash"),
    )
    payload = F.to_json("_payload")
    lacks = F.lit(False)
    for name, fields in TYPES.items():
        for field, kind in fields.items():
            lacks = lacks | ((F.col("result_type") == name) & F.try_variant_get(F.col("_payload"), f"$.{field}", kind).isNull())
    code = (
        F.when(F.col("_v").isNull() | ~F.coalesce(F.col("_shape").startswith("OBJECT"), F.lit(False)), "ENVELOPE_NOT_AN_OBJECT").when(F.coalesce(F.col("version"), F.lit(0)) != 1, "SCHEMA_VERSION_UNSUPPORTED").when(F.coalesce(F.col("attempt"), F.lit(0)) < 1, "ATTEMPT_INVALID")
        .when(F.coalesce(F.col("sequence"), F.lit(-1)) < 0, "SEQUENCE_INVALID").when(F.col("inputs").isNull() | F.exists("inputs", lambda x: x.isNull()), "INPUT_VERSIONS_INVALID").when(~F.coalesce(F.col("result_type").isin(*TYPES), F.lit(False)), "RESULT_TYPE_UNKNOWN")
        .when(F.col("_payload").isNull() | F.coalesce(payload == "null", F.lit(True)), "PAYLOAD_MISSING").when(lacks, "PAYLOAD_NOT_OF_TYPE").when(F.coalesce(F.size("_results"), F.lit(0)) != 1, "RESULTS_INVALID").when(F.coalesce(F.col("hash"), F.lit("")) != F.sha2(payload, 256), "RESULT_HASH_MISMATCH").otherwise("ok")
    )
    e = e.withColumn("code", code)
    ok = lambda c: F.when(F.col("code") == "ok", c)
    return e.select(*keys, "code", ok(F.col("attempt")).alias("attempt"), ok(F.col("sequence")).alias("sequence"), ok(F.col("result_type")).alias("result_type"), ok(F.array_join("inputs", ",")).alias("inputs"), ok(payload).alias("payload"), ok(F.col("hash")).alias("hash"))


def compact(df: DataFrame, keys: list[str], payload: str, least_bytes: int = 64) -> tuple[DataFrame, DataFrame]:
    """(keys, reference, inline) and the store (reference, payload), which holds each different payload once.

    Payloads shorter than a reference is worth stay inline; a null payload has neither.
    """
    text = stable_text(F.col(payload))
    text = F.coalesce(text, F.col(payload))
    d = df.select(*keys, text.alias("_t")).withColumn("reference", F.when(F.octet_length("_t") >= least_bytes, F.sha2("_t", 256)))
    store = d.where("reference is not null").groupBy("reference").agg(F.first("_t").alias("payload"))
    return d.select(*keys, "reference", F.when(F.col("reference").isNull(), F.col("_t")).alias("inline")), store


def hydrate(compacted: DataFrame, store: DataFrame, keys: list[str]) -> DataFrame:
    """keys, payload, status: restored, inline, empty, lost (a reference that the store lacks) or corrupt (a payload that is not the reference's)."""
    s = store.select("reference", F.col("payload").alias("_p"))
    j = compacted.join(s, "reference", "left")
    right = F.sha2("_p", 256) == F.col("reference")
    status = F.when(F.col("reference").isNull(), F.when(F.col("inline").isNull(), "empty").otherwise("inline")).when(F.col("_p").isNull(), "lost").when(right, "restored").otherwise("corrupt")
    return j.select(*keys, F.when(F.col("reference").isNull(), F.col("inline")).when(right, F.col("_p")).alias("payload"), status.alias("status"))
