"""Table shapes of the three signals. Times are nanoseconds in a long; ``seq`` is the arrival order."""

from __future__ import annotations

LOGS = "timestamp_nanos bigint, seq bigint, stream map<string,string>, severity string, severity_text string, body string, attributes map<string,string>, trace_id string, span_id string"
SPANS = (
    "trace_id string, span_id string, parent_span_id string, name string, kind string, start_nanos bigint, end_nanos bigint, status string, status_message string, seq bigint, "
    "stream map<string,string>, attributes map<string,string>, events array<struct<time_nanos:bigint,name:string,attributes:map<string,string>>>"
)
METRICS = "timestamp_nanos bigint, seq bigint, labels map<string,string>, value double, kind string"
STREAM_LABELS = ("service_name", "service_namespace", "service_version", "deployment_environment", "deployment_environment_name")
NO_END = (1 << 63) - 1
