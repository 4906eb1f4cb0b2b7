"""Patterns, key lists and constants that results depend on."""

SIGNAL_LEVELS = ("ERROR", "ERR", "FATAL", "CRIT", "CRITICAL", "PANIC", "WARN", "WARNING")
SIGNAL = r"\b(error|fatal|critical|warn(?:ing)?|exception|traceback|panic|sigsegv|oom|refused|timeout|timed out|failed|failure|rejected|exceeded|aborted|unavailable|5\d\d)\b"
CHANGE = r"(?i)\b(deploy|deployment|migration|migrat|feature flag|flag .{0,20}enabled|config(?:uration)?|rollout|rotation|version|commit|upgraded?|restarted?|applied|joined|drained|backup|cron|job .{0,20}started|maintenance)\b"
NUMBER_PAIR = r"\b([a-zA-Z_][a-zA-Z_0-9]{2,30})=(\d+(?:\.\d+)?)(ms|MB|GB|%|s|k)?\b"
DIM_PAIR = r"\b([a-zA-Z][\w.\-]{1,30})=([\w.:\-/]{1,60})"
DIM_SKIP = ("latency", "duration", "size", "bytes", "count", "len", "time", "ms", "status", "code", "retry", "attempt", "offset", "lag", "rid", "txid")
SERIES_SKIP = ("rid", "id", "txid", "commit", "status", "retry")
NUMERIC_DIMS = ("shard", "partition", "build", "instance")
LEVEL = r"\b(TRACE|DEBUG|INFO|NOTICE|WARN(?:ING)?|ERROR|ERR|FATAL|CRIT(?:ICAL)?|PANIC)\b"
CONTINUATION = r"^(\s+|\tat\s|at\s+[\w.$]+\(|Caused by:|\.\.\.\s\d+\smore|File \"|\s*\w+Error:|\s*\w+Exception:|#\d+\s+0x)"
CRI = r"^(\S+)\s+(stdout|stderr)\s+([FP])\s?(.*)$"
LOGFMT_PAIR = r"(\w[\w.\-]*)=(?:\"([^\"]*)\"|(\S+))"
LEVEL_KEYS = ("level", "severity", "lvl", "log.level", "loglevel", "@level")
MESSAGE_KEYS = ("msg", "message", "log", "event", "@message", "text")
TIME_KEYS = ("ts", "time", "timestamp", "@timestamp", "date")
#: kind, pattern, how Spark reads it after the fraction is cut
TIMES = (
    ("iso", r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d{1,9})?", "yyyy-MM-dd HH:mm:ss"),
    ("bgl", r"\d{4}-\d{2}-\d{2}-\d{2}\.\d{2}\.\d{2}(?:\.\d+)?", "yyyy-MM-dd-HH.mm.ss"),
    ("compact", r"\d{8}-\d{2}:\d{2}:\d{2}(?::\d{1,3})?", "yyyyMMdd-HH:mm:ss"),
    ("slash2", r"\d{2}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}", "yy/MM/dd HH:mm:ss"),
    ("clf", r"\d{2}/[A-Za-z]{3}/\d{4}:\d{2}:\d{2}:\d{2}", "dd/MMM/yyyy:HH:mm:ss"),
    ("ctime", r"[A-Z][a-z]{2} [A-Z][a-z]{2} {1,2}\d{1,2} \d{2}:\d{2}:\d{2} \d{4}", "MMM d HH:mm:ss yyyy"),
    ("syslog", r"[A-Z][a-z]{2} {1,2}\d{1,2} \d{2}:\d{2}:\d{2}", "yyyy MMM d HH:mm:ss"),
    ("hdfs", r"\b\d{6} \d{6}\b", "yyMMdd HHmmss"),
    ("md", r"\b\d{2}-\d{2} \d{2}:\d{2}:\d{2}(?:\.\d{1,3})?", "yyyy MM-dd HH:mm:ss"),
    ("dotmd", r"\b\d{2}\.\d{2} \d{2}:\d{2}:\d{2}", "yyyy MM.dd HH:mm:ss"),
    ("epoch", r"\b1[0-9]{9}\b", ""),
)
UUID = r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b"
MASKS = (
    UUID,
    r"\b(?:\d{1,3}\.){3}\d{1,3}(?::\d+)?\b",
    r"(?i)\b0x[0-9a-f]+\b",
    r"\b\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?Z?\b",
    r"\b\d{1,2}:\d{2}:\d{2}(?:[.,]\d+)?\b",
)
SEPARATORS = r"[\s|,;=]+"
DIGIT_TOKEN = r"(?<![^ ])[^ \d]*+\d[^ ]*+"
WORD = r"[A-Za-z][A-Za-z0-9_.\-]{2,}"
KEEP_WORDS = (
    "error", "warn", "warning", "info", "debug", "fatal", "critical", "trace", "exception", "timeout", "failed", "failure", "refused", "connection", "pool",
    "true", "false", "null", "none", "and", "the", "for", "with", "from", "not",
)
REDACTIONS = (
    (r"(?i)\b[a-z]+://[^\s\"']+", "<url>"), (r"[\w.+-]+@[\w-]+\.[\w.-]+", "<email>"), (UUID, "<uuid>"), (r"\b\d{1,3}(?:\.\d{1,3}){3}\b", "<ip>"),
    (r"(?i)\b(?:[0-9a-f]{1,4}:){2,}[0-9a-f]{1,4}\b", "<ip6>"), (r"(?i)\b[0-9a-f]{16,}\b", "<hex>"), (r"\b[A-Za-z0-9+/]{24,}={0,2}\b", "<b64>"),
)
PATH = r"(?:/[\w.\-@+]+){2,}/?"
QUOTED = r"\"[^\"]{3,}\"|'[^']{3,}'"
PLACEHOLDER = r"<(?:url|email|uuid|ip6?|hex|b64|seg|text)>"
#: A leading time that redaction keeps: it carries order, not secrets.
TIME_HEAD = r"^\[?[\d\-/:T. +]{8,32}\]?"
#: Classes as wide as Python's, of all scripts.
WIDE = "(?U)"
DENSITY_BUCKETS, CONTEXT, TREND_POINTS, NEW_AFTER = 44, 15, 12, 0.03
#: What the benchmark of root causes calls an error; other words than SIGNAL's.
BENCH_ERROR = r"(?i)\b(error|fatal|critical|warn|exception|traceback|panic|refused|timeout|timed out|failed|failure|rejected|exceeded|aborted|unavailable|5\d\d)\b"
LONGEST_LINE = 65_536
