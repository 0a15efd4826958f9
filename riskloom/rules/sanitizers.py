"""Encoders, casts and validators that make a value safe for a category."""

# ---------------------------------------------------------------------------
# Fixed values: (category, RE2 pattern, shown name); order decides ties.
# ---------------------------------------------------------------------------
SANITIZERS = [
    # SQL
    ("SQL Injection", r"(?i)\bintval\s*\(", "intval()"),
    ("SQL Injection", r"(?i)\bfloatval\s*\(", "floatval()"),
    ("SQL Injection", r"(?i)->prepare\s*\(", "prepare()"),
    ("SQL Injection", r"(?i)\bbind_param\s*\(", "bind_param()"),
    ("SQL Injection", r"(?i)\bbindParam\s*\(", "bindParam()"),
    ("SQL Injection", r"(?i)\bbindValue\s*\(", "bindValue()"),
    ("SQL Injection", r"(?i)mysqli_real_escape_string\s*\(", "mysqli_real_escape_string()"),
    ("SQL Injection", r"(?i)\(int\)\s*\$", "(int) cast"),
    ("SQL Injection", r"(?i)\(float\)\s*\$", "(float) cast"),
    ("SQL Injection", r"(?i)\bsettype\s*\(", "settype()"),
    ("SQL Injection", r"(?i)\bctype_digit\s*\(", "ctype_digit()"),
    ("SQL Injection", r"(?i)\bis_numeric\s*\(", "is_numeric()"),
    ("SQL Injection", r"(?i)\babs\s*\(", "abs()"),
    ("SQL Injection", r"(?i)\(bool\)\s*\$", "(bool) cast"),
    # HTML output
    ("Cross-Site Scripting", r"(?i)\bhtmlspecialchars\s*\(", "htmlspecialchars()"),
    ("Cross-Site Scripting", r"(?i)\bhtmlentities\s*\(", "htmlentities()"),
    ("Cross-Site Scripting", r"(?i)\bstrip_tags\s*\(", "strip_tags()"),
    ("Cross-Site Scripting", r"(?i)\burlencode\s*\(", "urlencode()"),
    ("Cross-Site Scripting", r"(?i)\brawurlencode\s*\(", "rawurlencode()"),
    ("Cross-Site Scripting", r"(?i)\bjson_encode\s*\(", "json_encode()"),
    ("Cross-Site Scripting", r"(?i)filter_var\s*\(.*FILTER_SANITIZE", "filter_var(FILTER_SANITIZE)"),
    ("Cross-Site Scripting", r"(?i)filter_input\s*\(", "filter_input()"),
    ("Cross-Site Scripting", r"(?i)\|\s*escape\b", "Twig |escape"),
    ("Cross-Site Scripting", r"(?i)\|\s*e\b", "Twig |e"),
    ("Cross-Site Scripting", r"\{\{.*\}\}", "Blade {{ }}"),
    ("Cross-Site Scripting", r"(?i)\besc_html\s*\(", "esc_html()"),
    ("Cross-Site Scripting", r"(?i)\besc_attr\s*\(", "esc_attr()"),
    ("Cross-Site Scripting", r"(?i)\besc_url\s*\(", "esc_url()"),
    ("Cross-Site Scripting", r"(?i)\bwp_kses\s*\(", "wp_kses()"),
    ("Cross-Site Scripting", r"(?i)\bwp_kses_post\s*\(", "wp_kses_post()"),
    # Shell
    ("Command Injection", r"(?i)\bescapeshellarg\s*\(", "escapeshellarg()"),
    ("Command Injection", r"(?i)\bescapeshellcmd\s*\(", "escapeshellcmd()"),
    # Paths
    ("Path Traversal", r"(?i)\bbasename\s*\(", "basename()"),
    ("Path Traversal", r"(?i)\brealpath\s*\(", "realpath()"),
    ("Path Traversal", r"(?i)\bpathinfo\s*\(", "pathinfo()"),
    ("Path Traversal", r"(?i)\bin_array\s*\(", "in_array() whitelist"),
    # Includes
    ("File Inclusion", r"(?i)\bbasename\s*\(", "basename()"),
    ("File Inclusion", r"(?i)\bin_array\s*\(", "in_array() whitelist"),
    # Outgoing requests
    ("SSRF", r"(?i)filter_var\s*\(.*FILTER_VALIDATE_URL", "filter_var(FILTER_VALIDATE_URL)"),
    ("SSRF", r"(?i)\bparse_url\s*\(", "parse_url()"),
    ("SSRF", r"(?i)\bin_array\s*\(", "in_array() whitelist"),
    # Redirects
    ("Open Redirect", r"(?i)filter_var\s*\(.*FILTER_VALIDATE_URL", "filter_var(FILTER_VALIDATE_URL)"),
    ("Open Redirect", r"(?i)\bparse_url\s*\(", "parse_url()"),
    # Deserialization
    ("Insecure Deserialization", r"(?i)\bjson_decode\s*\(", "json_decode()"),
    ("Insecure Deserialization", r"(?i)allowed_classes.*false", "allowed_classes:false"),
]
# End of fixed values.

# Literals tested before the pattern runs (same order as SANITIZERS, lower case).
SANITIZER_HINTS = [
    "intval", "floatval", "->prepare", "bind_param", "bindparam", "bindvalue",
    "mysqli_real_escape_string", "(int)", "(float)", "settype", "ctype_digit",
    "is_numeric", "abs", "(bool)",
    "htmlspecialchars", "htmlentities", "strip_tags", "urlencode", "rawurlencode",
    "json_encode", "filter_var", "filter_input", "|", "|", "{{",
    "esc_html", "esc_attr", "esc_url", "wp_kses", "wp_kses_post",
    "escapeshellarg", "escapeshellcmd",
    "basename", "realpath", "pathinfo", "in_array",
    "basename", "in_array",
    "filter_var", "parse_url", "in_array",
    "filter_var", "parse_url",
    "json_decode", "allowed_classes",
]
assert len(SANITIZER_HINTS) == len(SANITIZERS)
