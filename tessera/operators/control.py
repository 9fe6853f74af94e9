"""Control plane as tables: API keys, webhooks, custom fields, tenants."""

from __future__ import annotations

import hashlib
import hmac
import secrets

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Events that a webhook may ask for, and seconds before each attempt (fixed values).
EVENTS = ("document.created", "document.updated", "document.deleted", "reindex.started", "reindex.completed")
ATTEMPTS = (0, 1, 5)

WEBHOOKS = "tenant_id string, id string, url string, events array<string>, secret string"
FIELDS = "tenant_id string, field_name string, field_type string, required boolean"
KEYS = "tenant_id string, key_id string, key_hash string, read_only boolean, revoked boolean"


def create_key(spark: SparkSession, tenant_id: str, read_only: bool = False) -> tuple[str, DataFrame]:
    """A new secret, shown once, and its row."""
    secret, key_id = secrets.token_urlsafe(32), secrets.token_hex(8)
    row = (tenant_id, key_id, hashlib.sha256(secret.encode()).hexdigest(), read_only, False)
    return secret, spark.createDataFrame([row], KEYS)


def revoke_key(keys: DataFrame, key_id: str) -> DataFrame:
    return keys.withColumn("revoked", F.col("revoked") | (F.col("key_id") == key_id))


def verify(requests: DataFrame, keys: DataFrame) -> DataFrame:
    """Requests (request_id, secret, method) with tenant_id and allowed: an
    equi-join on the hash, whatever the number of keys."""
    from .tenancy import permitted

    known = keys.where("NOT revoked").select("tenant_id", "key_hash", "read_only")
    both = requests.withColumn("key_hash", F.sha2("secret", 256)).join(known, "key_hash", "left")
    return both.select(
        "request_id",
        "tenant_id",
        (F.col("read_only").isNotNull() & F.coalesce(permitted(F.col("method"), F.col("read_only")), F.lit(False))).alias("allowed"),
    )


@F.pandas_udf(StringType())
def signature(payload: pd.Series, secret: pd.Series) -> pd.Series:
    return pd.Series([hmac.new((s or "").encode(), (p or "").encode(), hashlib.sha256).hexdigest() for p, s in zip(payload, secret, strict=True)])


def invalid_events(asked: Column) -> Column:
    return F.array_except(asked, F.array(*[F.lit(e) for e in EVENTS]))


def deliveries(events: DataFrame, webhooks: DataFrame, sign: bool = True) -> DataFrame:
    """Events (tenant_id, event, payload) fanned out to the webhooks (tenant_id,
    id, url, events, secret) that ask for them."""
    hooks = webhooks.select("tenant_id", "id", "url", "secret", F.explode("events").alias("event"))
    out = events.join(hooks, ["tenant_id", "event"])
    return out.withColumn("signature", signature("payload", "secret")).drop("secret") if sign else out.drop("secret")


def due(attempts: DataFrame) -> DataFrame:
    """Failed attempts (id, attempt, failed_at) that are tried again, and when."""
    waits = F.array(*[F.lit(s) for s in ATTEMPTS])
    return attempts.where(F.col("attempt") < len(ATTEMPTS)).withColumn(
        "next_at",
        F.timestamp_seconds(F.unix_timestamp("failed_at") + F.get(waits, F.col("attempt"))),
    )


def put_field(fields: DataFrame, new: DataFrame) -> DataFrame:
    """Custom fields by (tenant_id, field_name), the new ones winning."""
    keys = ["tenant_id", "field_name"]
    return fields.join(new.select(*keys), keys, "left_anti").unionByName(new)


def drop_field(fields: DataFrame, tenant_id: str, field_name: str) -> DataFrame:
    return fields.where(~((F.col("tenant_id") == tenant_id) & (F.col("field_name") == field_name)))
