"""Names and words that soften or cancel single rules."""

# ---------------------------------------------------------------------------
# Fixed values.
# ---------------------------------------------------------------------------

# Rules that match any variable, not only request data.
GENERIC_RULES = [
    "XSS-004", "CMD-008", "SQL-005", "FI-002",
    "DESER-002", "DESER-003", "SSRF-004", "REDIR-002",
]

# Noisy rules that are dropped, not just marked, when a sanitizer applies.
DROP_WHEN_SANITIZED = ["XSS-004", "CMD-008", "SQL-005"]

# Always replaced by the form token detector.
REPLACED_RULES = ["CSRF-001"]

PREPARE_CALL = "->prepare("
PREPARE_CATEGORY = "SQL Injection"

ECHO_RULE = "XSS-004"
ECHO_ENCODERS = [
    "htmlspecialchars(", "htmlentities(", "strip_tags(", "esc_html(",
    "esc_attr(", "urlencode(", "json_encode(",
]

CREDENTIAL_RULES = ["AUTH-001", "AUTH-002"]
CREDENTIAL_SAFE_SUFFIXES = [
    "_pattern", "_regex", "_field", "_column", "_hash",
    "_label", "_validator", "_placeholder", "_name",
    "_length", "_min", "_max", "_rules", "_format",
    "_policy", "_strength", "_error", "_message",
    "_confirm", "_old", "_new", "_reset", "_form",
]

SAFE_NAME_PARTS = [
    "count", "total", "length", "size", "offset", "limit",
    "page", "config", "setting", "path", "dir", "directory",
    "version", "status", "type", "mode", "level", "flag",
    "index", "position", "width", "height", "color", "class",
    "title", "label", "prefix", "suffix",
]

SUPPRESS_MARKS = ["// nosec", "# nosec", "/* nosec", "//nosec", "#nosec"]
SUPPRESS_TAGS = ["@suppress", "phpcs:ignore"]
SUPPRESS_TAG_LABEL = "phpcs:ignore"

HIGH_CONFIDENCE_WORDS = ["$_get", "$_post", "$_request", "$_cookie"]

VARIABLE = r"\$[a-zA-Z_][a-zA-Z0-9_]*"

SKIPPED_DIRS = [".git", ".svn", "node_modules", ".idea", ".vscode"]
SCANNED_EXTENSIONS = [
    ".php", ".phtml", ".php3", ".php4", ".php5", ".php7",
    ".inc", ".phps", ".module", ".install", ".theme",
]
# End of fixed values.
