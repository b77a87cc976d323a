"""Schemas of the tables and wire records."""

LOG_TABLE = """
    LogId BIGINT, Timestamp TIMESTAMP, ts_nanos BIGINT, ServiceName STRING, SeverityText STRING, SeverityNumber INT,
    Body STRING, TraceId STRING, SpanId STRING,
    ResourceAttributes MAP<STRING, STRING>, LogAttributes MAP<STRING, STRING>,
    ContainerName STRING, ContainerImage STRING, ContainerId STRING, HostName STRING,
    Environment STRING, ComposeProject STRING, log_date DATE
"""

_ATTRIBUTES = ("ARRAY<STRUCT<key: STRING, value: STRUCT<stringValue: STRING, intValue: STRING, doubleValue: STRING, boolValue: STRING,"
               " arrayValue: STRING, kvlistValue: STRING, bytesValue: STRING>>>")

OTLP = f"""
    resourceLogs ARRAY<STRUCT<
        schemaUrl: STRING,
        resource: STRUCT<attributes: {_ATTRIBUTES}>,
        scopeLogs: ARRAY<STRUCT<
            schemaUrl: STRING,
            scope: STRUCT<name: STRING, version: STRING, attributes: {_ATTRIBUTES}>,
            logRecords: ARRAY<STRUCT<
                timeUnixNano: STRING, observedTimeUnixNano: STRING, severityNumber: INT, severityText: STRING,
                body: STRUCT<stringValue: STRING, intValue: STRING, doubleValue: STRING, boolValue: STRING, arrayValue: STRING, kvlistValue: STRING>, traceId: STRING, spanId: STRING, flags: BIGINT,
                attributes: {_ATTRIBUTES}>>>>>>
"""

CONTAINER_LINE = "log STRING, stream STRING, time STRING, level STRING, attrs MAP<STRING, STRING>"

CONTAINER_EVENT = """
    timestamp TIMESTAMP, container_id STRING, container_name STRING, image STRING, stream STRING,
    message STRING, host STRING, label MAP<STRING, STRING>
"""

ALERTS = """
    alerts ARRAY<STRUCT<status: STRING, labels: MAP<STRING, STRING>, annotations: MAP<STRING, STRING>>>
"""

CONTAINER_LIST = "Id STRING, Names ARRAY<STRING>, Image STRING, State STRING, Status STRING"
CONTAINER_INSPECT = """
    Id STRING, RestartCount INT,
    State STRUCT<OOMKilled: BOOLEAN, ExitCode: INT, StartedAt: STRING, FinishedAt: STRING>
"""

NOTIFICATIONS = """
    id STRING, type STRING, severity STRING, title STRING, message STRING,
    container_id STRING, container_name STRING, created_at TIMESTAMP, read_at TIMESTAMP
"""

USERS = "id BIGINT, username STRING, email STRING, role STRING"
OWNERSHIP = "container_id STRING, user_id BIGINT, custom_name STRING"
