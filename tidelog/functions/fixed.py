"""They must equal the ones the results are matched against."""

GATEWAY_SERVICE = "nginx"

# Ordered critical classes: type, case-insensitive regex, title. The first match wins.
CRITICAL_CLASSES = [
    ("ddos", r"(ddos|denial.of.service|rate.limit.exceeded|too.many.connections)", "DDoS / Rate Limit"),
    ("deadlock", r"(deadlock|dead.lock)", "Database Deadlock"),
    ("race_condition", r"(race.condition|concurrent.modification)", "Race Condition"),
    ("nginx_error", r"(upstream.timed.out|upstream.connect.error|502.bad.gateway)", "Nginx Upstream Error"),
    ("db_error", r"(database.connection.refused|cannot.connect.to.database|too.many.clients)",
     "Database Connection Error"),
    ("oom", r"(out.of.memory|oom.killer|killed.process|cannot.allocate.memory)", "Out of Memory"),
    ("crash", r"(segmentation.fault|segfault|panic:|fatal.error|unhandled.exception)", "Application Crash"),
    ("disk_full", r"(no.space.left|disk.full|filesystem.*full)", "Disk Full"),
]
CRITICAL_COOLDOWN_SECONDS = 60
CRITICAL_MESSAGE_CHARS = 200

FLOOD_WORDS = r"(ddos|denial.of.service|flood|rate.limit|too.many.requests|429|syn)"
SPAM_STRIP = r"[0-9:\.\+\-]+"
SPAM_GROUP_CHARS = 60
SPAM_RATE_PER_SECOND = 8.0
SPAM_COUNT = 240
SPAM_FLOOD_HITS = 6
FLOOD_REQUESTS_PER_MINUTE = 120
FLOOD_COOLDOWN_SECONDS = 120
SILENCE_SECONDS = 300
SECOND_LOOK_SECONDS = 300

# Junk prefixes removed once each, in this order, then two invisible characters.
JUNK_PREFIXES = ["?\u009f\u009a? ", "???? ", "?????? ", "??? ", "??? "]
INVISIBLE = ["﻿", "​"]

# Severity by keywords, first match wins, INFO otherwise.
SEVERITY_WORDS = [
    ("ERROR", r"(?i)(error|fatal|panic|exception)"),
    ("WARN", r"(?i)(warn|warning)"),
    ("DEBUG", r"(?i)(debug|trace)"),
]
# `level` attribute values and the severity text and number they stand for.
LEVEL_NAMES = [
    ("TRACE", 1, ["trace"]),
    ("DEBUG", 5, ["debug"]),
    ("INFO", 9, ["info"]),
    ("WARN", 13, ["warn", "warning"]),
    ("ERROR", 17, ["error"]),
    ("FATAL", 21, ["fatal"]),
]

PROBE_PATHS = ["/health", "/healthz", "/ping", "/ready", "/favicon.ico"]

# Attribute keys.
CONTAINER_NAME = "container.name"
CONTAINER_ID = "container.id"
CONTAINER_IMAGE = "container.image.name"
HOST_NAME = "host.name"
ENVIRONMENT = "deployment.environment"
SERVICE_NAME = "service.name"
PROJECT_LABEL = "com.docker.compose.project"
SERVICE_LABEL = "com.docker.compose.service"
PROJECT_ATTR = "container.label.com.docker.compose.project"
SERVICE_ATTR = "container.label.com.docker.compose.service"

# Identity aliases: the first non-empty one counts.
IDENTITY_ALIASES = {
    "host_id": ["host_id", "edge_host_id", "host.name"],
    "compose_project": ["compose_project", "com.docker.compose.project", "label.com.docker.compose.project"],
    "compose_service": ["compose_service", "com.docker.compose.service", "label.com.docker.compose.service"],
    "container_name": ["container_name", "container.name", "ContainerName"],
    "container_id": ["container_id", "container.id", "ContainerId"],
}

# Pattern mining: what is stripped, what becomes '?'.
TIMESTAMP_RE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}[0-9.,+Z: ]*"
IPV4_RE = r"[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}"
MASK_RE = r"[0-9a-f]{8,}|[0-9]+"

# Gateway thresholds: error percentage and p95 seconds.
ERROR_RATE_DANGER, ERROR_RATE_WARN = 5.0, 1.0
P95_DANGER, P95_WARN = 1.0, 0.3

RETENTION_DAYS = 90
DISPLAY_TIMEZONE = "Asia/Bangkok"
