"""Table schemas and the fixed values the log contract depends on."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the contract of the log service we mirror).
# ---------------------------------------------------------------------------
LEVELS = ("debug", "info", "warn", "error")
BUCKET_SECONDS = {"1m": 60, "5m": 300, "1h": 3600, "1d": 86400}
GROUP_COLUMNS = ("service", "level")
MAX_FUTURE_SKEW_SECONDS = 5 * 60
LIST_LIMIT_DEFAULT = 100
LIST_LIMIT_MIN = 1
LIST_LIMIT_MAX = 1000
MAX_KEY_LENGTH = 512
DEFAULT_SCOPES = ("ingest", "query")
RETENTION_HOURS_DEFAULT = 744
RETENTION_HOURS_MIN = 1
RETENTION_HOURS_MAX = 8760
ISO_MS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
# RFC 3339 date-time shape accepted by the entry validator (calendar validity
# is checked separately by the timestamp parser).
RFC3339_PATTERN = (
    r"^(?!0000)\d{4}-[0-1]\d-[0-3]\d[Tt\s][0-2]\d:[0-5]\d:[0-6]\d(\.\d+)?([Zz]|[+-]([01]\d|2[0-3])(:?[0-5]\d)?)$"
)

# Timestamps before year 1 are refused, whatever their offset.
EARLIEST = "0001-01-01T00:00:00Z"

# Reason texts, in the order the validator checks them.
REASON_NOT_OBJECT = "entry must be a object"
REASON_MISSING = "missing required field: '{field}'"
REASON_NOT_STRING = "{field} must be a string"
REASON_BAD_TIMESTAMP = "invalid timestamp: '{value}'"
REASON_BAD_LEVEL = "invalid level: '{value}'"
REASON_EMPTY = "{field} must be a non-empty string"
REASON_ATTRS_NOT_OBJECT = "attributes must be a flat object of string, number or boolean values"
REASON_BAD_ATTR = (
    "attribute '{key}' must be a string, number or boolean; nested objects and arrays are not allowed"
)
REASON_FUTURE = "timestamp must not be more than five minutes in the future"
REQUIRED_FIELDS = ("timestamp", "level", "service", "message")

# Access verdicts.
VERDICT_OK = "ok"
VERDICT_MALFORMED = "401 missing or malformed credentials"
VERDICT_UNKNOWN = "401 invalid api key"

# ---------------------------------------------------------------------------
# Stored tables.
# ---------------------------------------------------------------------------
LOGS_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("ts", T.TimestampType(), False),
        T.StructField("level", T.StringType(), False),
        T.StructField("service", T.StringType(), False),
        T.StructField("message", T.StringType(), False),
        T.StructField("attributes", T.StringType(), False),
        T.StructField("tenant_id", T.StringType(), True),
    ]
)
