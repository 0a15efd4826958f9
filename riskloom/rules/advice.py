"""What to do about a finding, by category."""

ADVICE = {
    "SQL Injection": "Bind values in prepared statements instead of building SQL text",
    "Cross-Site Scripting": "Encode values for the place in the page where they are printed",
    "Command Injection": "Avoid the shell; otherwise quote each argument with escapeshellarg()",
    "File Inclusion": "Choose included files from a fixed list",
    "Path Traversal": "Resolve the path and check that it stays in the intended folder",
    "Insecure Deserialization": "Exchange data as JSON, or forbid classes when unserializing",
    "SSRF": "Allow only known hosts for outgoing requests",
    "Weak Cryptography": "Use password_hash(), random_bytes() and authenticated encryption",
    "Authentication & Credentials": "Keep credentials out of source and harden session settings",
    "Secret Scanning": "Revoke the secret and load it from the environment or a vault",
    "Information Disclosure": "Keep details in server logs and show visitors a neutral text",
    "File Upload": "Check type and size, and store uploads under generated names",
    "CSRF": "Add a per-session token to the form and check it before changing data",
    "Open Redirect": "Redirect only to local paths or listed hosts",
    "XXE": "Parse XML with external entities and network access off",
    "Insecure Configuration": "Set the safe value in the runtime configuration",
    "Type Juggling": "Compare with === or hash_equals()",
    "Header Injection": "Strip line breaks and validate values put into headers",
    "Log Injection": "Strip line breaks from values before logging them",
    "LDAP Injection": "Escape values with ldap_escape()",
    "XPath Injection": "Quote or look up values instead of joining them into the expression",
    "Race Condition": "Open or lock the file once instead of checking it first",
    "Insecure Transport": "Use HTTPS and keep certificate checks on",
    "Regex DoS": "Quote request data with preg_quote() and keep patterns fixed",
    "Email Injection": "Validate addresses and strip line breaks from mail fields",
    "Session Fixation": "Never take session ids from the request; renew them at login",
    "Unsafe Object Creation": "Map request values to a fixed list of classes or functions",
    "Plaintext Password": "Store and compare only password_hash() results",
    "Sensitive Data Storage": "Do not store this value, or store it encrypted or tokenized",
    "Insecure Session": "End the session with session_unset() and session_destroy()",
    "Business Logic": "Recompute the value on the server",
    "Input Validation": "Validate the value with filter_var()",
    "Insecure Cookie": "Set the secure, httponly and samesite options",
    "Mass Assignment": "Pick the accepted fields explicitly",
}


def for_category(category: str) -> str:
    return ADVICE.get(category, "Review the code and apply the usual defence")
