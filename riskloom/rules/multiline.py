"""Patterns of the detectors that look at several lines or a whole file."""

from riskloom.model import LOW, MEDIUM

# ---------------------------------------------------------------------------
# Fixed values.
# ---------------------------------------------------------------------------

# Check-then-use.
FILE_CHECK = r"(?i)\bfile_exists\s*\(\s*(\$[a-zA-Z_][a-zA-Z0-9_]*)"
FILE_OPERATION = (
    r"(?i)\b(fopen|file_get_contents|file_put_contents|unlink|readfile|copy|"
    r"rename|mkdir|rmdir)\s*\("
)
CHECK_REACH = 3

# Forms and their anti-forgery tokens.
POST_FORM = r'''(?i)<form[^>]*method\s*=\s*['"]post['"]'''
TOKEN_WORD = (
    r"(?i)(csrf|_token|nonce|xsrf|authenticity_token|anti.?forgery|"
    r"__RequestVerificationToken|csrfmiddlewaretoken)"
)
FORM_END = r"(?i)</form>"
STATE_CHANGE = (
    r"(?i)(INSERT|UPDATE|DELETE|mysqli_query|->query|->exec|->execute|->save|"
    r"->update|->delete|->create|->destroy|->store)"
)

# Logout.
SESSION_UNSET = r"(?i)unset\s*\(\s*\$_SESSION\s*\["
SESSION_DESTROY = r"(?i)session_destroy\s*\("

# Response headers: (rule id, header, severity, CWE, pattern), in report order.
PAGE_OUTPUT = r"(?i)(echo\s|print\s|<html|<head|<body|<\!DOCTYPE|\?>.*<)"
HEADERS = [
    ("HEADER-003", "X-Frame-Options", MEDIUM, "CWE-1021",
     r'''(?i)header\s*\(\s*['"]X-Frame-Options'''),
    ("HEADER-004", "X-Content-Type-Options", MEDIUM, "CWE-16",
     r'''(?i)header\s*\(\s*['"]X-Content-Type-Options'''),
    ("HEADER-005", "Content-Security-Policy", LOW, "CWE-16",
     r'''(?i)header\s*\(\s*['"]Content-Security-Policy'''),
    ("HEADER-006", "Strict-Transport-Security", LOW, "CWE-319",
     r'''(?i)header\s*\(\s*['"]Strict-Transport-Security'''),
]

CHECK_MATCH = "file_exists({var}) -> file op line {line}"
FORM_WRITE_MATCH = "POST form -> no csrf_token -> DB write"
FORM_MATCH = "POST form without CSRF token"
LOGOUT_MATCH = "unset($_SESSION[...]) without session_destroy()"
HEADER_MATCH = "Missing {header} header"
FILE_LEVEL_TEXT = "(file-level check)"
# End of fixed values.
