"""Control-plane checks over small tables, and status folds over event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(rows: DataFrame, by: list[str], *order: str) -> DataFrame:
    """The newest row of each group, as a partial maximum: groups are never sorted or gathered."""
    rest = [c for c in rows.columns if c not in by]
    return rows.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row")).select(*by, "row.*")


def status_summary(items: DataFrame, by: str) -> DataFrame:
    """COMPLETED, PARTIAL or FAILED by the items' statuses; RUNNING while any is open."""
    done, failed = F.count_if(F.col("status") == "COMPLETED"), F.count_if(F.col("status") == "FAILED")
    counted = items.groupBy(by).agg(F.count("*").alias("items"), done.alias("completed"), failed.alias("failed"))
    open_ = F.col("items") > F.col("completed") + F.col("failed")
    state = F.when(open_, "RUNNING").when(F.col("failed") == 0, "COMPLETED").when(F.col("completed") == 0, "FAILED").otherwise("PARTIAL")
    return counted.withColumn("status", state)


#: Which status a run may have next.
TRANSITIONS = {"QUEUED": ("RUNNING", "CANCELLED", "INTERRUPTED"), "RUNNING": ("COMPLETED", "PARTIAL", "FAILED", "CANCELLED", "INTERRUPTED")}


def allowed(before: Column, after: Column) -> Column:
    """Terminal statuses never change."""
    out = before.isNull() & (after == "QUEUED")
    for a, own in TRANSITIONS.items():
        out = out | ((before == a) & after.isin(*own))
    return out


def schema_status(schemas: DataFrame, links: DataFrame) -> DataFrame:
    """ACTIVE iff a knowledge base uses the schema actively. links: schema_id, active."""
    used = links.groupBy("schema_id").agg(F.bool_or("active").alias("used"))
    return schemas.join(used, "schema_id", "left").withColumn("status", F.when(F.col("used"), "ACTIVE").otherwise("INACTIVE")).drop("used")


def several_active(links: DataFrame) -> DataFrame:
    """Knowledge bases with more than one active schema: none in a sound store."""
    return links.groupBy("kb").agg(F.count_if("active").alias("active_schemas")).where("active_schemas > 1")


def activate(links: DataFrame, kb: str, schema_id: str) -> DataFrame:
    """links with one active schema for kb."""
    return links.withColumn("active", F.when(F.col("kb") == kb, F.col("schema_id") == schema_id).otherwise(F.col("active")))


def effective_settings(defaults: DataFrame, aliases: DataFrame, overrides: DataFrame) -> DataFrame:
    """name, value: an override of the name, else of its alias, else the default. defaults: name, default; aliases: alias, name; overrides: name, value."""
    own = overrides.select("name", F.col("value").alias("own"))
    other = overrides.withColumnRenamed("name", "alias").join(aliases, "alias").groupBy("name").agg(F.min("value").alias("other"))
    return defaults.join(own, "name", "left").join(other, "name", "left").select("name", F.coalesce("own", "other", "default").alias("value"))


def deletable(kbs: DataFrame, documents: DataFrame) -> DataFrame:
    """Knowledge bases without documents."""
    return kbs.join(documents.select("kb").distinct(), "kb", "left_anti")


def readiness(**violations: DataFrame) -> DataFrame:
    """code, subject of all violations; ready if empty. Each value has a column subject."""
    out = None
    for code, rows in violations.items():
        own = rows.select(F.lit(code).alias("code"), F.col("subject").cast("string").alias("subject"))
        out = own if out is None else out.unionByName(own)
    return out


#: Types of causes that carry a code of their own, types that mean timeouts or broken connections, and words of
#: messages for all others, in order, with category, code and whether to try again.
OWN_CODES = (("DiscoveryDeadlineExceededException", "TIMEOUT", True), ("ModelOutputException", "VALIDATION_ERROR", True), ("SourceStateException", "VALIDATION_ERROR", False))
TIMEOUTS = ("TimeoutException", "SocketTimeoutException", "HttpTimeoutException", "InterruptedByTimeoutException", "HttpRetryException")
CONNECTIONS = ("OpenAIIoException", "ConnectException", "InterruptedIOException")
MESSAGES = (
    (("configured", "configuration", "api key", "base url"), "PROVIDER_ERROR", "CONFIGURATION_ERROR", False),
    (("timeout",), "TIMEOUT", "TRANSPORT_TIMEOUT", True),
    (("rate limit", "overload", "reject"), "OVERLOADED", "RATE_LIMIT", True),
    (("json", "convert", "parse"), "CONVERSION_ERROR", "MALFORMED_MODEL_RESPONSE", True),
    (("stale",), "VALIDATION_ERROR", "SOURCE_STALE", False),
    (("unavailable",), "VALIDATION_ERROR", "SOURCE_UNAVAILABLE", False),
    (("candidate", "validation", "invalid"), "VALIDATION_ERROR", "INVALID_MODEL_CANDIDATE", True),
)


def failure_class(types: Column, messages: Column, status: Column, own_code: Column, most: int = 12) -> Column:
    """category, code and retryable of a failure: types and messages of its causes from the outside in (the first `most` count), the
    provider's HTTP status and the failure's own code, or null. Types go before the status, the status before what messages say."""
    chain = F.slice(types, 1, most)
    text = F.lower(F.array_join(F.slice(messages, 1, most), " "))
    has = lambda names: F.coalesce(F.arrays_overlap(chain, F.array(*map(F.lit, names))), F.lit(False))
    row = lambda category, code, again: F.struct(F.lit(category).alias("category"), (code if isinstance(code, Column) else F.lit(code)).alias("code"), F.lit(again).alias("retryable"))
    malformed = own_code == "MALFORMED_MODEL_RESPONSE"
    steps = [(has(("ModelOutputException",)) & ~has(("DiscoveryDeadlineExceededException",)) & malformed, "CONVERSION_ERROR", own_code, True)]
    steps += [(has((name,)), category, own_code, again) for name, category, again in OWN_CODES]
    steps += [
        (has(TIMEOUTS) | (status == 408), "TIMEOUT", "TRANSPORT_TIMEOUT", True), (status == 429, "OVERLOADED", "RATE_LIMIT", True), (status >= 500, "PROVIDER_ERROR", "PROVIDER_5XX", True),
        (status == 409, "OVERLOADED", "PROVIDER_RETRYABLE_STATUS", True), (status.isin(401, 403), "PROVIDER_ERROR", "PROVIDER_AUTH", False),
        (status >= 400, "PROVIDER_ERROR", "PROVIDER_INVALID_REQUEST", False), (has(CONNECTIONS), "PROVIDER_ERROR", "TRANSPORT_IO", True),
    ]
    steps += [(text.rlike("|".join(words)), *rest) for words, *rest in MESSAGES]
    out = F.when(has(("RejectedExecutionException",)), row("PROVIDER_ERROR", "PROVIDER_ERROR", True)).otherwise(row("PROVIDER_ERROR", "PROVIDER_ERROR", False))
    for condition, category, code, again in reversed(steps):
        out = F.when(condition, row(category, code, again)).otherwise(out)
    return out


def forbidden_keywords(query: Column, keywords: list[str], whole_words: bool = False) -> Column:
    """All keywords that a query text holds, in any case and in the given order: as substrings (so SET blocks Asset), or as whole words."""
    text = F.upper(query)
    hits = [F.when(text.rlike(rf"\b{k}\b") if whole_words else text.contains(k), k) for k in keywords]
    return F.filter(F.array(*hits), lambda k: k.isNotNull())


def interrupted(runs: DataFrame) -> DataFrame:
    """runs after a restart: what was queued or running is INTERRUPTED, and so are its stages; terminal states stay. runs: status."""
    return runs.withColumn("status", F.when(F.col("status").isin("QUEUED", "RUNNING"), "INTERRUPTED").otherwise(F.col("status")))


def schema_change_violations(changes: DataFrame, schemas: DataFrame, links: DataFrame) -> DataFrame:
    """change_id, problem of requests to create, update or delete schemas. changes: change_id, action, schema_id, name, version;
    schemas: schema_id, name, version; links: schema_id, active. A created name and version must be new, an update keeps both, and
    an active schema neither changes nor goes."""
    taken = schemas.select("name", "version", F.lit(True).alias("taken")).distinct()
    own = schemas.select("schema_id", F.col("name").alias("own_name"), F.col("version").alias("own_version"))
    used = links.where("active").select("schema_id", F.lit(True).alias("used")).distinct()
    joined = changes.join(taken, ["name", "version"], "left").join(own, "schema_id", "left").join(used, "schema_id", "left")
    same = F.col("own_name").eqNullSafe(F.col("name")) & F.col("own_version").eqNullSafe(F.col("version"))
    problem = (
        F.when((F.col("action") == "CREATE") & F.col("taken").isNotNull(), "ALREADY_EXISTS").when((F.col("action") != "CREATE") & F.col("own_name").isNull(), "NOT_FOUND")
        .when((F.col("action") != "CREATE") & F.col("used").isNotNull(), "ACTIVE").when((F.col("action") == "UPDATE") & ~same, "IDENTITY_CHANGED")
    )
    return joined.select("change_id", problem.alias("problem")).where("problem is not null")


def expires_at(start: Column, retention: str) -> Column:
    """start plus a retention such as "30 days"; null stays null."""
    return start + F.expr(f"interval {retention}")


def remaining_ms(deadline: Column, now: Column) -> Column:
    """Milliseconds to the deadline, not less than 0."""
    return F.greatest(F.lit(0), F.unix_millis(deadline) - F.unix_millis(now))
