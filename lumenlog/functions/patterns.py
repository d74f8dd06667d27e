"""The patterns and word tables that decide what is extracted.

They must match for equal results and are shared, as text, by Spark and by the SQL that tests compare with.
Classes are ASCII: ``\\w``, ``\\d`` and ``\\b`` take no other letters.
"""

# --- time stamps and block structure -------------------------------------------------------------
TS_CLASSIC = r"\[(\d{1,2}/\d{1,2}/\d{2,4}\s+\d{2}:\d{2}:\d{2}:\d{3})\s+\w+\]"
TS_ISO = r"(\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(?:[,:.]\d{3,6})?)"
STACK_LINE = r"^\s+at\s+[\w.$]+\(.*\)$"
CAUSED_BY = r"^\s*Caused by:\s+(.+)$"
STACK_LINE_IN_TEXT = r"^[ \t\r\f\v]+at[ \t\r\f\v]+[\w.$]+\([^\n]*\)$"
CAUSED_BY_IN_TEXT = r"^[ \t\r\f\v]*Caused by:[ \t\r\f\v]+[^\n]+$"

# --- level, thread, code, exception --------------------------------------------------------------
LEVEL_WORD = r"(?i)\b(SEVERE|ERROR|WARN|WARNING|INFO|DEBUG|FINE|FINER|FINEST)\b"
LEVEL_LETTER = r"\]\s+[0-9a-f]+\s+\S+\s+([IAWEOFRD])\s"
LEVEL_NAMES = {
    "I": "INFO", "A": "AUDIT", "W": "WARNING", "E": "ERROR",
    "O": "STDOUT", "F": "FATAL", "R": "REPORT", "D": "DEBUG",
}
THREAD = r"\]\s+([0-9a-f]{8})\s+"
CODE = r"\b([A-Z]{4,5}\d{4}[A-Z])\b"
EXCEPTION_BARE = r"[a-zA-Z_$]+(?:\.[a-zA-Z_$]+)+(?:Exception|Error)"
EXCEPTION = r"\b(" + EXCEPTION_BARE + r")\b"
ROOT_CAUSE = r"^[^\S\n]*Caused by:[^\S\n]+[^\n]*?\b(" + EXCEPTION_BARE + r")\b"
ERROR_LEVELS = ("ERROR", "SEVERE", "FATAL")

# --- signal tags, in sorted order ----------------------------------------------------------------
TAGS = {
    "DB/Pool": r"(?i)connection pool|J2CA|pool.*exhaust|Timeout waiting for idle object",
    "HTTP": r"(?i)\b(4\d\d|5\d\d)\b.*\b(HTTP|SRVE)\b|\b(HTTP|SRVE)\b.*\b(4\d\d|5\d\d)\b",
    "HungThreads": r"(?i)hung thread|ThreadMonitor|WSVR0605|stuck thread|CWWKE0701E",
    "OOM/GC": r"(?i)OutOfMemoryError|Java heap space|GC overhead limit exceeded",
    "SSL/TLS": r"(?i)SSLHandshakeException|handshake_failure|PKIX path building failed|unable to find valid certification path",
}
#: In lower case, what a text has to hold for a tag's pattern to match: patterns run on these texts only.
TAG_NEEDS = {
    "DB/Pool": ("pool", "j2ca", "timeout waiting"),
    "HTTP": ("http", "srve"),
    "HungThreads": ("hung thread", "threadmonitor", "wsvr0605", "stuck thread", "cwwke0701e"),
    "OOM/GC": ("outofmemoryerror", "java heap space", "gc overhead"),
    "SSL/TLS": ("handshake", "pkix", "unable to find"),
}
HUNG_NAME = (
    r"""(?i)(?:thread\s+["']([^"']+)["'])|(?:thread\s+(WebContainer\s*:\s*\d+))"""
    r"""|(?:the\s+(Default Executor-thread-\d+))|(?:thread\s+(Default Executor-thread-\d+))"""
)

# --- redaction, in order: pattern, replacement with $n for a group ---------------------------------
REDACTIONS = (
    (r"(?i)\b(authorization:\s*bearer)\s+[A-Za-z0-9._\-/+=]+", "$1 [REDACTED]"),
    (r"(?i)\b(api[_-]?key|token|secret|password|passwd|credential)\b\s*[:=]\s*(\S+)", "$1=[REDACTED]"),
    (r"""(?i)("(?:api[_-]?key|token|secret|password|passwd|credential)")\s*:\s*"[^"]*\"""", '$1: "[REDACTED]"'),
    (r"(?i)(password|pwd)\s*=\s*[^;,\s]+", "$1=[REDACTED]"),
    (r"\beyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "[REDACTED_JWT]"),
)

_SECRETS = ("key", "token", "secret", "password", "passwd", "credential")
#: The same for each redaction, in their order.
REDACTION_NEEDS = (("authorization:",), _SECRETS, _SECRETS, ("password", "pwd"), ("eyj",))

# --- likely causes: id, title, pattern -------------------------------------------------------------
CAUSES = (
    (
        "ssl-trust",
        "SSL / TLS Trust Failure",
        r"(?i)CertPathBuilderException|SSLHandshakeException|PKIX path building failed|CWPKI0022E|CWPKI0033E",
    ),
    (
        "db-pool",
        "JDBC / Connection-Pool Exhaustion",
        r"(?i)J2CA0045E|J2CA0079E|pool.*exhaust|Timeout waiting for idle object|ConnectionWaitTimeout|connection pool",
    ),
    (
        "hung-threads",
        "Hung / Stuck Threads",
        r"(?i)WSVR0605W|WSVR0606W|ThreadMonitor|hung.thread|stuck.thread|CWWKE0701E|CWWKE0700W",
    ),
    (
        "oom-gc",
        "OutOfMemoryError / GC Pressure",
        r"(?i)OutOfMemoryError|Java heap space|GC overhead limit exceeded|allocation failure|Metaspace",
    ),
)
#: What each cause means and what helps: (cause, fixes) by the cause's id.
CAUSE_TEXTS = {
    "ssl-trust": (
        "The chain of certificates that the peer sent does not end at an authority which this server trusts.",
        ("Add the peer's signer certificate to the trust store.", "List the chain and look for certificates that are expired or not valid yet.", "After a renewal, restart whatever may still hold the old chain."),
    ),
    "db-pool": (
        "Every connection of a data source is taken, so new requests wait until they time out.",
        ("Look for long queries and open transactions that keep connections.", "Look for code that keeps a connection when an error occurs.", "If the load is as expected, allow more connections or a longer wait."),
    ),
    "hung-threads": (
        "Threads have worked on one request for longer than the monitor allows.",
        ("Take several thread dumps and compare what the threads wait for.", "Look at slow remote calls, database locks and loops without an end.", "For long batch work, raise the monitor's threshold."),
    ),
    "oom-gc": (
        "The heap, or the space for classes, has no room left for new objects.",
        ("Take a heap dump when the error occurs and see what holds the memory.", "Look for collections that only grow, open streams, and class loaders left by deployments.", "Give the JVM more memory once a leak is ruled out."),
    ),
}

# --- suggested searches ----------------------------------------------------------------------------
SEARCH_SCOPE = "index=APP sourcetype=WAS"
TAG_SEARCHES = {
    "SSL/TLS": ("SSL/TLS handshake failures", '(SSLHandshakeException OR "PKIX path building failed" OR CWPKI*)'),
    "OOM/GC": ("OutOfMemory and GC pressure events", '(OutOfMemoryError OR "GC overhead limit exceeded" OR "Java heap space")'),
    "DB/Pool": ("Connection pool exhaustion", '(J2CA* OR "pool exhausted" OR "ConnectionWaitTimeout")'),
    "HungThreads": ("Hung/stuck thread detections", "(WSVR0605W OR WSVR0606W OR ThreadMonitor OR CWWKE0701E)"),
}

# --- rule documents by what was matched ------------------------------------------------------------
RULES_BY_TAG = {
    "OOM/GC": ("stacktrace-analysis.md",),
    "HungThreads": ("thread-correlation.md", "stacktrace-analysis.md"),
    "DB/Pool": ("message-codes.md", "splunk-query.md"),
    "SSL/TLS": ("security-analysis.md", "splunk-query.md"),
    "HTTP": ("servlet-errors.md", "message-codes.md"),
}
RULES_BY_CODE_PREFIX = {
    "SRVE": ("message-codes.md", "servlet-errors.md", "splunk-query.md"),
    "CWWK": ("liberty-analysis.md", "message-codes.md"),
    "CWPKI": ("security-analysis.md", "splunk-query.md"),
    "WSVR": ("websphere-startup.md", "thread-correlation.md"),
    "DSRA": ("message-codes.md", "splunk-query.md"),
    "DCSV": ("log-noise-filter.md",),
    "HMGR": ("log-noise-filter.md",),
    "WTRN": ("message-codes.md",),
    "J2CA": ("message-codes.md",),
    "CWWKZ": ("deployment-analysis.md",),
    "CWWKF": ("liberty-analysis.md",),
    "SESN": ("message-codes.md", "servlet-errors.md"),
}
RULES_BY_EXCEPTION = {
    "ssl": ("security-analysis.md", "splunk-query.md"),
    "certificate": ("security-analysis.md", "splunk-query.md"),
    "certpath": ("security-analysis.md", "splunk-query.md"),
    "pkix": ("security-analysis.md", "splunk-query.md"),
    "ltpa": ("security-analysis.md",),
    "outofmemory": ("stacktrace-analysis.md",),
    "stackoverflow": ("stacktrace-analysis.md",),
    "nullpointer": ("stacktrace-analysis.md",),
    "classnotfound": ("stacktrace-analysis.md", "deployment-analysis.md"),
    "noclassdeffound": ("stacktrace-analysis.md", "deployment-analysis.md"),
    "sqlexception": ("message-codes.md",),
    "connectexception": ("message-codes.md",),
    "servlet": ("servlet-errors.md",),
}
RULES_BY_WORD = {
    "liberty": ("liberty-analysis.md",),
    "startup": ("websphere-startup.md",),
    "deploy": ("deployment-analysis.md",),
    "noise": ("log-noise-filter.md",),
    "splunk": ("splunk-query.md",),
    "thread": ("thread-correlation.md", "stacktrace-analysis.md"),
    "hung": ("thread-correlation.md", "stacktrace-analysis.md"),
    "security": ("security-analysis.md",),
    "auth": ("security-analysis.md",),
    "login": ("security-analysis.md",),
    "servlet": ("servlet-errors.md",),
    "stacktrace": ("stacktrace-analysis.md",),
    "pkix": ("security-analysis.md", "splunk-query.md"),
    "certificate": ("security-analysis.md",),
}
DEFAULT_RULE = "message-codes.md"
MOST_RULES = 3

# --- documents -------------------------------------------------------------------------------------
DELIMITER_TAGS = r"</?(?:user_query|log_excerpt|context|system|system_instruction|instructions|report|domain_knowledge)[^>]*>"
TARGET_SECTIONS = (
    "Executive Summary",
    "Code Review Findings",
    "AI Integration Review",
    "Test Coverage Analysis",
    "Prioritized Improvement Plan",
)
HEADING = r"^##\s+\d*\.?\s*(.*)"
FINDING_NAMED = r"(?i)####\s+([A-Z]\d+):\s*(.*)"
FINDING_ROW = r"(?m)^\|\s*(\d+)\s*\|\s*(.*?)\s*\|"
FINDING_BLOCK = r"(?is)(?:findings requiring attention|key findings).*?:(.*?)(?:\n\n|\n\*\*|\z)"
FINDING_BULLET = r"(?m)^[-*]\s+(.*)"
FINDING_GAP = r"(?m)^\|\s*`?([^|]+?)`?\s*\|\s*(\w+)\s*\|"
FINDING_ID = r"\b([A-Z]\d+)\b"
FINDING_NUMBER = r"#(\d+)"
#: Words that start a file path in findings; a parameter of the normal form, as each code base has its own.
PATH_ROOTS = ("app", "tests/")
STOP_WORDS = ("the", "a", "an", "in", "to", "for", "of", "is", "not", "and", "or", "with")
SEARCH_WORDS = ("index=", "sourcetype=", "| timechart", "| stats", "| table", "| where", "| eval")
GRADE_TABLE = (
    r"(?i)\|\s*\*{0,2}(Architecture|Security|AI Integration|Tests?(?:\s*&\s*Reliability)?|Skills?\s*System|Reliability"
    r"|Prompt\s*Safety|Caching)\*{0,2}\s*\|[^|]*?\*{0,2}([ABCDF][+-]?)\*{0,2}\s*\|"
)
GRADE_AREAS = r"Architecture|Security|AI Integration|Tests?|Skills?\s*System|Reliability"
GRADE_INLINE = r"(?i)\b(" + GRADE_AREAS + r")\b[^|\n]{0,30}?\b([ABCDF][+-]?)\b"
#: Fails early where none of the areas can start.
GRADE_INLINE_HEAD = r"(?i)(?=[arst](?:rchi|ecur|i int|est|kill|elia))"
GRADE_OVERALL = r"(?i)Grade:\s*\*{0,2}([ABCDF][+-]?)\*{0,2}"
GRADE_CLASSES = {"A": "good", "B": "warn", "C": "bad", "D": "bad", "F": "bad"}
