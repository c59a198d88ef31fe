"""The built-in rules as data: identity, reach, ordered patterns, messages.

A pattern's ``needs`` lists literals of which at least one is part of every match, ``needs_folded``
the same for the lower-cased line; they let the scan pass over most lines without a regex.
"""

from __future__ import annotations

from dataclasses import dataclass

from scanloom.functions.text import WS as _S
from scanloom.functions.text import WS_CHARS


@dataclass(frozen=True)
class Pattern:
    regex: str
    message: str
    needs: tuple[str, ...] = ()
    needs_folded: tuple[str, ...] = ()


@dataclass(frozen=True)
class Rule:
    ordinal: int
    rule_id: str
    name: str
    description: str
    category: str
    severity: str
    applicable_to: tuple[str, ...]
    patterns: tuple[Pattern, ...]


# ---------------------------------------------------------------------------------------------
# Rule texts, patterns and lookup lists that results must agree on.
# ---------------------------------------------------------------------------------------------

_WORD_START = r"(?<![A-Za-z0-9_])"
_WORD_END = r"(?![A-Za-z0-9_])"

CORS = Rule(
    1,
    "cors-permissive",
    "Permissive CORS Policy",
    "Detects overly permissive CORS configurations",
    "cors",
    "medium",
    (".ts", ".js"),
    (
        Pattern(
            rf"['\"]Access-Control-Allow-Origin['\"]{_S}*[:=]{_S}*['\"]\*['\"]",
            "Access-Control-Allow-Origin set to wildcard (*). Restrict to specific origins.",
            ("Access-Control-Allow-Origin",),
        ),
        Pattern(
            rf"origin{_S}*:{_S}*['\"]\*['\"]",
            "CORS origin set to '*'. Restrict to specific allowed origins.",
            ("origin",),
        ),
        Pattern(
            rf"origin{_S}*:{_S}*true{_WORD_END}",
            "CORS origin set to true (reflects any origin). Restrict to specific allowed origins.",
            ("origin",),
        ),
        Pattern(
            rf"{_WORD_START}cors{_S}*\({_S}*\)",
            "cors() called without options allows all origins. Pass a configuration object.",
            ("cors",),
        ),
        Pattern(
            rf"origin{_S}*:{_S}*\([^)]*\){_S}*=>{_S}*true",
            "Dynamic CORS origin callback always returns true, accepting any origin. "
            "Validate origins explicitly.",
            ("origin",),
        ),
        Pattern(
            rf"origin{_S}*:[^,\n]*callback{_S}*\({_S}*null{_S}*,{_S}*true{_S}*\)",
            "CORS origin function calls callback(null, true), accepting any origin. "
            "Validate origins explicitly.",
            ("origin",),
        ),
    ),
)

SENSITIVE_PORTS = (
    (5432, "PostgreSQL"),
    (3306, "MySQL"),
    (27017, "MongoDB"),
    (6379, "Redis"),
    (9200, "Elasticsearch"),
)
EXPOSE_LINE = rf"(?i)^{_S}*EXPOSE{_S}+([^\n\r\x{{2028}}\x{{2029}}]+)"
EXPOSE_POSTGRES_LINE = rf"(?i)^{_S}*EXPOSE{_S}+5432"

DOCKER = Rule(
    2,
    "docker-expose-postgres",
    "Docker Exposes Database/Service Port",
    "Detects Dockerfiles that expose sensitive database and service ports",
    "docker",
    "medium",
    ("Dockerfile",),
    tuple(
        Pattern(
            "",
            f"Dockerfile exposes {service} port {port} - use internal Docker networking instead",
        )
        for port, service in SENSITIVE_PORTS
    ),
)

ENV = Rule(
    3,
    "env-missing-example",
    "Missing .env.example Template",
    "Detects .env files without a corresponding .env.example template",
    "configuration",
    "medium",
    (".env",),
    (Pattern("", ".env file exists but .env.example template is missing"),),
)

ERROR_LEAK = Rule(
    4,
    "error-info-leak",
    "Error Information Leak",
    "Detects patterns that may leak stack traces or internal error details to clients",
    "information-disclosure",
    "low",
    (".ts", ".js"),
    (
        Pattern(
            rf"res\.(?:send|json){_S}*\({_S}*err\.stack",
            "Sending error stack trace to client leaks internal information.",
            ("res.",),
        ),
        Pattern(
            rf"res\.json{_S}*\({_S}*\{{[^}}]*stack{_S}*:",
            "Including stack trace in JSON response leaks internal information.",
            ("res.",),
        ),
        Pattern(
            rf"res\.status{_S}*\({_S}*500{_S}*\){_S}*\.{_S}*send{_S}*\({_S}*(?:err|error){_S}*\)",
            "Sending raw error object in 500 response may leak stack traces and internal paths.",
            ("res.",),
        ),
        Pattern(
            rf"res\.(?:send|json){_S}*\({_S}*(?:err|error)\.message{_S}*\)",
            "Sending error.message directly may leak internal error details to clients.",
            ("res.",),
        ),
    ),
)

DANGEROUS_PACKAGES = (
    ("event-stream", "Known supply chain attack (flatmap-stream injection)"),
    ("flatmap-stream", "Malicious package used in event-stream attack"),
    ("ua-parser-js", "Package was hijacked with cryptominer/password stealer"),
    ("colors", "Maintainer sabotaged package (infinite loop in v1.4.1+)"),
    ("faker", "Maintainer sabotaged package (replaced with ENDGAME module)"),
    ("node-ipc", "Maintainer added protestware (data destruction payload)"),
    ("left-pad", "Deprecated and unmaintained — use String.prototype.padStart()"),
    ("request", "Deprecated since 2020 — use node-fetch, undici, or built-in fetch"),
    ("nomnom", "Deprecated and unmaintained — use commander or yargs"),
    ("coa", "Package was hijacked to deliver malware (2021-2023)"),
    ("rc", "Package was hijacked to deliver malware (2021-2023)"),
    ("es5-ext", "Protestware added in 0.10.53+ (2024)"),
    ("lottie-player", "Supply chain attack — npm package compromised (2024)"),
    ("@lottiefiles/lottie-player", "Supply chain attack — wallet drainer injected (2024)"),
    ("everything", "Malicious package that installs all npm packages as dependencies"),
    ("cors-parser", "Typosquat of cors — contains data exfiltration payload"),
)

DEPENDENCY = Rule(
    5,
    "insecure-dependency",
    "Insecure Dependency",
    "Detects known vulnerable, hijacked, or sabotaged npm packages",
    "supply-chain",
    "critical",
    ("package.json",),
    tuple(
        Pattern("", f'Insecure dependency "{name}": {reason}')
        for name, reason in DANGEROUS_PACKAGES
    ),
)

CONSOLE_LOG_LIMIT = 5

CONSOLE = Rule(
    6,
    "console-log-excessive",
    "Excessive console.log Usage",
    "Detects files with too many console.log statements",
    "reliability",
    "low",
    (".ts", ".js"),
    (
        Pattern(
            "",
            f"Found {{match}} console.log statements (threshold: {CONSOLE_LOG_LIMIT}) - "
            "consider using a structured logger",
        ),
    ),
)

_SECRET_KINDS = (
    ("Stripe Live Key", r"sk_live_[a-zA-Z0-9]{24,}", ("sk_live_",), ()),
    ("AWS Access Key ID", r"AKIA[0-9A-Z]{16}", ("AKIA",), ()),
    (
        "GitHub Personal Token",
        r"gh[pousr]_[A-Za-z0-9]{36,}",
        ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
        (),
    ),
    ("Private Key", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----", ("PRIVATE KEY-----",), ()),
    ("Google API Key", r"AIza[0-9A-Za-z_-]{35}", ("AIza",), ()),
    (
        "MongoDB Connection String",
        rf"mongodb(?:\+srv)?://[^:{WS_CHARS}/]+:[^@{WS_CHARS}]+@",
        ("mongodb",),
        (),
    ),
    (
        "Generic Secret Assignment",
        r"(?i)(?:^|[^a-z0-9_])(?:password|passwd|pwd|secret|token|api[_-]?key)"
        rf"{_S}*[:=]{_S}*['\"][^'\"]{{8,}}['\"]",
        ("'", '"'),
        ("passw", "pwd", "secret", "token", "api"),
    ),
)

SECRETS = Rule(
    7,
    "hardcoded-secrets",
    "Hardcoded Secrets",
    "Detects hardcoded credentials, keys and tokens",
    "secrets",
    "critical",
    (".ts", ".js", ".jsx", ".tsx", ".env"),
    tuple(
        Pattern(regex, f"Potential hardcoded secret detected: {name}", needs, folded)
        for name, regex, needs, folded in _SECRET_KINDS
    ),
)

QUERY_METHODS = ("query", "execute", "raw", "prepare", "findRaw", "executeRaw", "all", "get")

SQL = Rule(
    8,
    "sql-injection",
    "SQL Injection Risk",
    "Detects SQL queries built with string concatenation or template literals",
    "injection",
    "critical",
    (".ts", ".js"),
    tuple(
        Pattern(
            rf"\.{method}{_S}*\(`[^\)]*\$\{{",
            f"SQL injection risk: .{method}() uses template literal with variable interpolation. "
            "Use parameterized queries instead.",
            ("${",),
        )
        for method in QUERY_METHODS
    )
    + tuple(
        Pattern(
            rf"\.{method}{_S}*\({_S}*['\"][^'\"]*['\"]{_S}*\+",
            f"SQL injection risk: .{method}() uses string concatenation. "
            "Use parameterized queries instead.",
            ("+",),
        )
        for method in QUERY_METHODS
    ),
)

WEAK_CRYPTO = Rule(
    9,
    "weak-crypto",
    "Weak Cryptography",
    "Detects use of weak cryptographic algorithms and insecure random number generation",
    "cryptography",
    "medium",
    (".ts", ".js"),
    (
        Pattern(
            rf"createHash{_S}*\({_S}*['\"](?:md5|sha1)['\"]{_S}*\)",
            "Weak hash algorithm (MD5/SHA1) detected. Use SHA-256 or stronger.",
            ("createHash",),
        ),
        Pattern(
            r"crypto\.pseudoRandomBytes",
            "crypto.pseudoRandomBytes is deprecated. Use crypto.randomBytes() instead.",
            ("crypto.pseudoRandomBytes",),
        ),
        Pattern(
            rf"Math\.random{_S}*\(\)",
            "Math.random() is not cryptographically secure. Use crypto.randomBytes() or "
            "crypto.randomUUID() for security-sensitive values.",
            ("Math.random",),
        ),
    ),
)
SECURITY_KEYWORDS = (
    "token",
    "secret",
    "password",
    "key",
    "salt",
    "hash",
    "nonce",
    "session",
    "csrf",
    "auth",
    "credential",
    "encrypt",
)
KEYWORD_REACH = 3

XSS = Rule(
    10,
    "xss-vulnerable",
    "XSS Vulnerability",
    "Detects patterns that may lead to cross-site scripting vulnerabilities",
    "xss",
    "critical",
    (".ts", ".js", ".jsx", ".tsx"),
    (
        Pattern(
            rf"\.innerHTML{_S}*=",
            "Direct innerHTML assignment is an XSS risk. Use textContent or a sanitization library.",
            ("HTML",),
        ),
        Pattern(
            rf"\.outerHTML{_S}*=",
            "Direct outerHTML assignment is an XSS risk. Use safe DOM APIs.",
            ("HTML",),
        ),
        Pattern(
            r"dangerouslySetInnerHTML",
            "dangerouslySetInnerHTML bypasses React XSS protection. Sanitize input first.",
            ("HTML",),
        ),
        Pattern(
            rf"document\.write{_S}*\(",
            "document.write() can introduce XSS vulnerabilities. Use safe DOM APIs.",
            ("document.write",),
        ),
        Pattern(
            rf"{_WORD_START}eval{_S}*\(",
            "eval() executes arbitrary code and is an XSS/injection risk. Avoid eval entirely.",
            ("eval",),
        ),
        Pattern(
            rf"v-html{_S}*=",
            "Vue.js v-html directive can introduce XSS vulnerabilities. Sanitize input first.",
            ("v-html",),
        ),
        Pattern(
            rf"\[innerHTML\]{_S}*=",
            "Angular [innerHTML] binding can introduce XSS vulnerabilities. "
            "Use a sanitization pipe.",
            ("HTML",),
        ),
        Pattern(
            rf"\.insertAdjacentHTML{_S}*\(",
            "insertAdjacentHTML() can introduce XSS vulnerabilities. Sanitize input first.",
            ("HTML",),
        ),
        Pattern(
            rf"\.srcdoc{_S}*=",
            "iframe srcdoc assignment can introduce XSS vulnerabilities. Sanitize input first.",
            ("srcdoc",),
        ),
    ),
)

BUILT_IN_RULES = (
    CORS,
    DOCKER,
    ENV,
    ERROR_LEAK,
    DEPENDENCY,
    CONSOLE,
    SECRETS,
    SQL,
    WEAK_CRYPTO,
    XSS,
)
