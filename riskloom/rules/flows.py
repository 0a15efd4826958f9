"""Data-flow vocabulary: where untrusted data enters and where it does harm."""

from riskloom.model import CRITICAL, HIGH

# ---------------------------------------------------------------------------
# Fixed values.
# ---------------------------------------------------------------------------

# Source patterns, tried in this order on the right side of an assignment.
SOURCES = [
    r"\$_(GET|POST|REQUEST|COOKIE|SERVER)\s*\[",
    r"\$_FILES\s*\[",
    r'''\bfile_get_contents\s*\(\s*['"]php://input['"]\s*\)''',
    r"\bphp://input\b",
]

ASSIGNMENT = r"(\$[a-zA-Z_][a-zA-Z0-9_]*)\s*=\s*(.+)"

DB_FETCH = (
    r"(?i)(\$[a-zA-Z_][a-zA-Z0-9_]*)\s*=\s*("
    r"mysqli_fetch_array|mysqli_fetch_assoc|mysqli_fetch_row|mysqli_fetch_object|"
    r"mysql_fetch_array|mysql_fetch_assoc|mysql_fetch_row|"
    r"pg_fetch_array|pg_fetch_assoc|pg_fetch_row|->fetch)\s*\("
)
# Also accepts a statement object before the arrow; off unless asked for.
DB_FETCH_EXTENDED = (
    r"(?i)(\$[a-zA-Z_][a-zA-Z0-9_]*)\s*=\s*("
    r"mysqli_fetch_array|mysqli_fetch_assoc|mysqli_fetch_row|mysqli_fetch_object|"
    r"mysql_fetch_array|mysql_fetch_assoc|mysql_fetch_row|"
    r"pg_fetch_array|pg_fetch_assoc|pg_fetch_row|[^=;]*->fetch\w*)\s*\("
)
DB_FETCH_KEY = "database_fetch"

ROW_COLUMN = (
    r"(?i)(\$[a-zA-Z_][a-zA-Z0-9_]*)\s*=\s*(\$[a-zA-Z_][a-zA-Z0-9_]*)"
    r'''\s*\[\s*['"]([a-zA-Z_][a-zA-Z0-9_]*)['"]'''
)

# (function, category, severity, CWE), in reporting order.
SINKS = [
    ("mysql_query", "SQL Injection", CRITICAL, "CWE-89"),
    ("mysqli_query", "SQL Injection", CRITICAL, "CWE-89"),
    ("->query", "SQL Injection", HIGH, "CWE-89"),
    ("pg_query", "SQL Injection", CRITICAL, "CWE-89"),
    ("exec", "Command Injection", CRITICAL, "CWE-78"),
    ("system", "Command Injection", CRITICAL, "CWE-78"),
    ("passthru", "Command Injection", CRITICAL, "CWE-78"),
    ("shell_exec", "Command Injection", CRITICAL, "CWE-78"),
    ("popen", "Command Injection", CRITICAL, "CWE-78"),
    ("proc_open", "Command Injection", CRITICAL, "CWE-78"),
    ("eval", "Command Injection", CRITICAL, "CWE-94"),
    ("echo", "Cross-Site Scripting", HIGH, "CWE-79"),
    ("print", "Cross-Site Scripting", HIGH, "CWE-79"),
    ("include", "File Inclusion", CRITICAL, "CWE-98"),
    ("include_once", "File Inclusion", CRITICAL, "CWE-98"),
    ("require", "File Inclusion", CRITICAL, "CWE-98"),
    ("require_once", "File Inclusion", CRITICAL, "CWE-98"),
    ("file_get_contents", "Path Traversal", HIGH, "CWE-22"),
    ("file_put_contents", "Path Traversal", HIGH, "CWE-22"),
    ("fopen", "Path Traversal", HIGH, "CWE-22"),
    ("readfile", "Path Traversal", HIGH, "CWE-22"),
    ("unlink", "Path Traversal", HIGH, "CWE-22"),
    ("unserialize", "Insecure Deserialization", CRITICAL, "CWE-502"),
    ("curl_init", "SSRF", HIGH, "CWE-918"),
    ("curl_setopt", "SSRF", HIGH, "CWE-918"),
    ("header", "Open Redirect", HIGH, "CWE-601"),
]

HEADER_CALL = r"(?i)\bheader\s*\("
INCLUDE_CALL = r"(?i)\b(include|require)(_once)?\s*[\(]"
OUTPUT_STRING = r'''(?i)(echo|print)\s+['"].*'''

# Function names that clean a value, by category.
FLOW_SANITIZERS = {
    "SQL Injection": [
        "intval", "floatval", "prepare", "bind_param", "bindParam", "bindValue",
        "mysqli_real_escape_string",
    ],
    "Cross-Site Scripting": [
        "htmlspecialchars", "htmlentities", "strip_tags", "urlencode",
        "filter_var", "filter_input",
    ],
    "Command Injection": ["escapeshellarg", "escapeshellcmd"],
    "Path Traversal": ["basename", "realpath"],
    "File Inclusion": ["basename", "in_array"],
    "Open Redirect": ["filter_var", "parse_url"],
    "Insecure Deserialization": ["json_decode"],
    "SSRF": ["filter_var", "parse_url"],
}
# End of fixed values.
