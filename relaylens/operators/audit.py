"""HTTP requests to audit events, with secrets masked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keys whose JSON values are hidden, values that look like tokens, and the mask.
SECRET_VALUES = r'"(api_key|token|password|secret)":\s*"[^"]*"'
TOKEN_VALUES = r'"([^"]*)":\s*"(sk-|Bearer |[A-Za-z0-9+/]{20,})"'
MASKED = '"$1":"***MASKED***"'
READ_ONLY = ("GET", "HEAD", "OPTIONS")


def masked_details(text: Column, *, longest: int = 500) -> Column:
    """JSON text without secrets; longer than ``longest`` characters it is cut and ends in ``...``."""
    hidden = F.regexp_replace(F.regexp_replace(text, SECRET_VALUES, MASKED), TOKEN_VALUES, MASKED)
    return F.when(F.length(hidden) > longest, F.concat(F.substring(hidden, 1, longest - 3), F.lit("..."))).otherwise(hidden)


def masked_prefix(secret: Column) -> Column:
    """The first four characters of a secret; nothing of one of four or fewer."""
    return F.when(F.length(secret) <= 4, "****").otherwise(F.concat(F.substring(secret, 1, 4), F.lit("****")))


def masked_connections(connections: DataFrame) -> DataFrame:
    return connections.withColumn("api_key_prefix", masked_prefix(F.col("api_key"))).drop("api_key")


def masked_requests(requests: DataFrame) -> DataFrame:
    """Request bodies as they may be stored."""
    return requests.select("event_id", "ts", masked_details(F.col("body")).alias("details"))


def _field(name: str) -> Column:
    """A text field of the body; other kinds of value count as absent."""
    found = F.try_variant_get(F.try_parse_json("body"), f"$.{name}", "string")
    is_text = F.schema_of_variant(F.try_variant_get(F.try_parse_json("body"), f"$.{name}", "variant")) == "STRING"
    return F.coalesce(F.when(is_text, found), F.lit(""))


def request_details(path: Column, method: Column, body: Column) -> Column:
    """What a request did, in words, by route; other routes keep their masked body."""
    parsed = F.try_parse_json(body)
    empty = F.coalesce(body, F.lit("")) == ""
    # a body that holds no JSON object says nothing about what was created
    unread = empty | F.coalesce(~F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(True))
    job = F.regexp_extract(path, r"/jobs/([^/]+)", 1)
    provider, model = _field("AI.Provider"), _field("AI.Model")
    port = F.coalesce(F.get_json_object("body", "$.Server.Port"), F.lit(""))
    settings = F.array_compact(
        F.array(
            F.when(provider != "", F.concat(F.lit("AI Provider: "), provider)),
            F.when(model != "", F.concat(F.lit("AI Model: "), model)),
            F.when(F.coalesce(port.try_cast("int"), F.lit(0)) > 0, F.concat(F.lit("Server Port: "), port)),
        )
    )
    configured = F.when(
        F.size(settings) > 0, F.concat(F.lit("Updated configuration: "), F.array_join(settings, ", "))
    ).otherwise("Updated system configuration")
    return (
        F.when(
            path.contains("/jobs") & (method == "POST"),
            F.when(unread, "Created new replication job").otherwise(
                F.format_string(
                    "Created job '%s' from %s to %s", _field("name"), _field("source_cluster_name"), _field("target_cluster_name")
                )
            ),
        )
        .when(path.contains("/jobs") & path.contains("/start"), F.concat(F.lit("Started replication job: "), job))
        .when(path.contains("/jobs") & path.contains("/stop"), F.concat(F.lit("Stopped replication job: "), job))
        .when(
            path.contains("/clusters") & (method == "POST"),
            F.when(unread, "Created new cluster").otherwise(
                F.format_string("Created cluster '%s' (provider: %s)", _field("name"), _field("provider"))
            ),
        )
        .when(path.contains("/config") & (method == "PUT"), configured)
        .when(
            path.contains("/users") & (method == "POST"),
            F.when(unread, "Created new user").otherwise(
                F.format_string("Created user '%s' with role '%s'", _field("username"), _field("role"))
            ),
        )
        .otherwise(F.when(empty, "No additional details").otherwise(masked_details(body)))
    )


def audit_events(requests: DataFrame) -> DataFrame:
    """Successful changes as audit events, and refused requests as the classes the reports count.

    ``event_class`` is auth_login, auth_failed, permission_denied, config_change or other.
    """
    method, path, status = F.upper("method"), F.col("path"), F.col("status")
    changed = ~method.isin(*READ_ONLY) & (status >= 200) & (status < 300)
    refused = status.isin(401, 403)
    event_class = (
        F.when(status == 401, "auth_failed")
        .when(status == 403, "permission_denied")
        .when(path.contains("/auth/login"), "auth_login")
        .when(path.contains("/config"), "config_change")
        .otherwise("other")
    )
    return requests.filter(changed | refused).select(
        "event_id", "ts", F.concat(method, F.lit(" "), path).alias("event_type"), event_class.alias("event_class"),
        F.coalesce("username", F.lit("Anonymous")).alias("initiator"),
        request_details(path, method, F.col("body")).alias("details"),
    )
