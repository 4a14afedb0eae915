"""JSON messages of live clients as a stream, unreadable ones set apart with their text and reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .online import run_stream

FIELDS = {
    "session_id": "string", "seq": "long", "type": "string", "t": "double", "x": "double", "y": "double", "dx": "double",
    "dy": "double", "pressed": "boolean", "key": "string", "sensitivity": "double", "dpi": "double", "polling_rate": "double"}


def reason(message: Column, body: Column) -> Column:
    """Why a parsed message cannot be used; null for a good one.

    ``json``: no JSON; ``object``: JSON, but no object; ``session``: no session id; ``order``: no sequence
    number; ``field:f``: the first field, in the order of FIELDS, whose value has another type.
    """
    whole = F.coalesce(F.schema_of_variant(message).startswith("OBJECT"), F.lit(False))
    wrong = [
        F.when(F.try_variant_get(message, f"$.{f}", "variant").isNotNull()
               & ~F.is_variant_null(F.try_variant_get(message, f"$.{f}", "variant"))
               & F.try_variant_get(message, f"$.{f}", kind).isNull(), F.lit(f"field:{f}"))
        for f, kind in FIELDS.items()]
    return (F.when(body.isNull() | message.isNull(), "json").when(~whole, "object")
            .when(F.try_variant_get(message, "$.session_id", "string").isNull(), "session")
            .otherwise(F.coalesce(*wrong, F.when(F.try_variant_get(message, "$.seq", "long").isNull(), "order"))))


def sorted_messages(raw: DataFrame, value: str = "value") -> DataFrame:
    """Every message with its fields, ``body`` and ``reason``; fields of a bad message are null."""
    parsed = raw.withColumn("body", F.col(value).cast("string")).withColumn("message", F.try_parse_json("body"))
    parsed = parsed.withColumn("reason", reason(F.col("message"), F.col("body")))
    fields = [F.when(F.col("reason").isNull(), F.try_variant_get("message", f"$.{f}", kind)).alias(f) for f, kind in FIELDS.items()]
    return parsed.select(*[c for c in raw.columns if c != value and c not in FIELDS], *fields, "body", "reason")


def write_batch(rows: DataFrame, out: str, batch_id: int) -> None:
    """A micro-batch of sorted messages by one job into its own folder, which a replay overwrites."""
    bad = F.col("reason").isNotNull()
    rows = rows.withColumns({"outcome": F.when(bad, "bad").otherwise("good"), "body": F.when(bad, F.col("body"))})
    rows.write.mode("overwrite").partitionBy("outcome").parquet(f"{out}/batch_id={batch_id}")


def split_messages(raw: DataFrame, out: str, checkpoint: str, value: str = "value") -> None:
    """Good messages under ``out/batch_id=n/outcome=good``, bad ones with text and reason under ``outcome=bad``.

    Every message is parsed once; after a failure none is lost or doubled in either output.
    """
    run_stream(sorted_messages(raw, value), lambda batch, batch_id: write_batch(batch, out, batch_id), checkpoint)
