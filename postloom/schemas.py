"""Row types and enumerations. Schemas are always given, never inferred."""

from __future__ import annotations

from pyspark.sql import types as T

_s = T.StringType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


# One posting on the wire: every field is text, the stack is a JSON array text.
WIRE_FIELDS = ("company", "role", "source", "url", "stack", "product", "location", "posted_at")
POSTING_WIRE = _struct(
    *[(name, _s) for name in WIRE_FIELDS],
    ("event_id", _s),
    ("seen_at", T.TimestampType()),
)

# One posting inside a job.
JOB = _struct(
    ("id", _s), ("company", _s), ("role", _s), ("source", _s), ("url", _s),
    ("stack", T.ArrayType(_s)), ("product", _s), ("location", _s),
    ("posted_at", T.TimestampType()), ("status", _s), ("created_at", T.TimestampType()),
)
JOB_COLUMNS = tuple(JOB.fieldNames())

CONTACT = _struct(
    ("id", _s), ("job_id", _s), ("company", _s), ("domain", _s), ("name", _s),
    ("email", _s), ("role", _s), ("source", _s), ("verified", _s),
    ("created_at", T.TimestampType()),
)

EMAIL = _struct(
    ("id", _s), ("job_id", _s), ("contact_id", _s), ("template", _s), ("subject", _s),
    ("body", _s), ("generated_at", T.TimestampType()), ("sent_at", T.TimestampType()),
    ("status", _s),
)

# Columns of the CSV export, in order.
EXPORT_COLUMNS = (
    "id", "company", "role", "source", "url", "stack", "product",
    "location", "posted_at", "status", "created_at",
)

# Allowed states.
JOB_STATUSES = ("new", "applied", "ignored")
EMAIL_TEMPLATES = ("cold_outreach", "recruiter_outreach", "referral_outreach", "followup")
SORT_ORDERS = ("latest", "oldest")

# Board columns and the status that lands in each.
BOARD_COLUMNS = ("discovered", "contacted", "applied", "interviewing", "offer", "rejected")
BOARD_OF_STATUS = {
    "new": "discovered",
    "discovered": "discovered",
    "contacted": "contacted",
    "applied": "applied",
    "interviewing": "interviewing",
    "offer": "offer",
    "rejected": "rejected",
    "ignored": "rejected",
}

DEDUP_TTL_SECONDS = 7 * 24 * 3600
