"""Framework rule packs and the package names that select them."""

from riskloom.model import CRITICAL, HIGH

# ---------------------------------------------------------------------------
# Fixed values: (rule id, category, severity, CWE, pattern) per framework.
# ---------------------------------------------------------------------------

PACK_RULES = {
    "laravel": [
        ("LARAVEL-001", "SQL Injection", CRITICAL, "CWE-89", r"(?i)DB::raw\s*\(.*\$_(GET|POST|REQUEST)"),
        ("LARAVEL-002", "SQL Injection", HIGH, "CWE-89", r"(?i)whereRaw\s*\(.*\$"),
        ("LARAVEL-003", "SQL Injection", HIGH, "CWE-89", r"(?i)(selectRaw|havingRaw|orderByRaw|groupByRaw)\s*\(.*\$"),
        ("LARAVEL-004", "Cross-Site Scripting", HIGH, "CWE-79", r"\{!!\s*\$"),
        ("LARAVEL-005", "Mass Assignment", HIGH, "CWE-915", r"(?i)\$request->all\s*\(\)"),
        ("LARAVEL-006", "Insecure Configuration", HIGH, "CWE-200", r"(?i)APP_DEBUG\s*=\s*true"),
        ("LARAVEL-007", "Authentication & Credentials", CRITICAL, "CWE-798", r"(?i)APP_KEY\s*=\s*base64:[A-Za-z0-9+/=]+"),
    ],
    "wordpress": [
        ("WP-001", "SQL Injection", CRITICAL, "CWE-89", r'''(?i)\$wpdb->query\s*\(\s*["']\s*(SELECT|INSERT|UPDATE|DELETE).*\$'''),
        ("WP-002", "Cross-Site Scripting", HIGH, "CWE-79", r"(?i)echo\s+\$_(GET|POST|REQUEST)"),
        ("WP-003", "CSRF", HIGH, "CWE-352", r"(?i)\$_POST\s*\[.*\]"),
        ("WP-004", "Open Redirect", HIGH, "CWE-601", r"(?i)wp_redirect\s*\(.*\$_(GET|POST|REQUEST)"),
        ("WP-005", "Authentication & Credentials", HIGH, "CWE-312", r'''(?i)update_option\s*\(\s*['"].*secret|password|key|token'''),
    ],
    "symfony": [
        ("SYMFONY-001", "Cross-Site Scripting", HIGH, "CWE-79", r"(?i)\|\s*raw\b"),
        ("SYMFONY-002", "Insecure Configuration", HIGH, "CWE-200", r"(?i)framework:\s*\n\s*profiler:\s*\n\s*enabled:\s*true"),
    ],
    "codeigniter": [
        ("CI-001", "SQL Injection", HIGH, "CWE-89", r"(?i)\$this->db->query\s*\(.*\$"),
        ("CI-002", "Cross-Site Scripting", HIGH, "CWE-79", r"(?i)\$this->input->(get|post)\s*\("),
    ],
}

# Patterns that span lines: matched on the whole file instead of line by line.
FILE_LEVEL_RULES = ("SYMFONY-002",)

# Package name parts in composer manifests.  When several are required the first
# entry wins.
FRAMEWORK_PACKAGES = [
    ("laravel", "laravel/framework"),
    ("symfony", "symfony/framework-bundle"),
    ("codeigniter", "codeigniter"),
    ("cakephp", "cakephp/cakephp"),
    ("yii2", "yiisoft/yii2"),
]

# End of fixed values.
