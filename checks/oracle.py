"""The registered queries once more, as SQL for a second engine.

The SQL shares pattern and message texts with the library, since both are fixed values, and nothing
of its logic: comments are stripped token by token, rules run one by one, order and counts come from
windows and grouping.
"""

from __future__ import annotations

from scanloom.operators import catalog, fixes, review
from scanloom.plans.corpus import PACKAGES, SNIPPETS

NL = "chr(10)"
AS_OF = "TIMESTAMP '2024-06-01 12:00:00'"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def re2(pattern: str) -> str:
    """The catalog's pattern without look-arounds, which the other engine lacks."""
    return q(
        pattern.replace(r"(?<![A-Za-z0-9_])", "(?:^|[^A-Za-z0-9_])").replace(
            r"(?![A-Za-z0-9_])", "(?:$|[^A-Za-z0-9_])"
        )
    )


WS = catalog._S
PIECES = (
    r"(?s)\"(?:[^\"\\\n]|\\[^\n])*\"?|'(?:[^'\\\n]|\\[^\n])*'?|`(?:[^`\\\n]|\\[^\n])*`?"
    r"|//[^\n]*|/\*.*?(?:\*/|\z)|[^\"'`/]+|."
)

# --- files ---------------------------------------------------------------------------------------

_snips = ", ".join(f"({i}, {q(s)})" for i, s in enumerate(SNIPPETS))
CODE = f"""
snips(sn, txt) AS (VALUES {_snips}),
ev AS (
  SELECT event_id, event_id // 40 AS f,
    CASE WHEN (event_id // 40) % 6 = 0 AND event_id % 4 = 0 THEN 11
         ELSE (event_id * 7 + user_id * 13 + event_id // 40) % 40 END AS sn
  FROM events),
code_text AS (
  SELECT f, string_agg(txt, {NL} ORDER BY event_id) AS content FROM ev JOIN snips USING (sn) GROUP BY f),
code AS (
  SELECT 'p' || (f % 10) AS project_id,
    CASE WHEN f % 17 = 16 THEN 'node_modules/d/' ELSE '' END ||
    CASE f % 8 WHEN 5 THEN 'web/f' || f || '.tsx' WHEN 6 THEN 'svc/f' || f || '/Dockerfile'
      WHEN 4 THEN 'lib/f' || f || '.js' WHEN 7 THEN 'notes/f' || f || '.md'
      ELSE 'src/f' || f || '.ts' END AS path,
    content
  FROM code_text)"""

_pool = "[" + ", ".join(q(p) for p in PACKAGES) + "]"
MANIFESTS = f"""
manifests AS (
  SELECT 'p' || (c_custkey % 10) AS project_id, 'm' || c_custkey || '/package.json' AS path,
    concat_ws({NL}, '{{', '  "name": "m' || c_custkey || '",', '  "dependencies": {{',
      '    "' || {_pool}[(c_custkey % 8 + 1)::INT] || '": "1.0.0",', '    "express": "4.0.0"', '  }},',
      '  "devDependencies": {{', '    "' || {_pool}[((c_custkey * 5 + 3) % 8 + 1)::INT] || '": "1.0.0"',
      '  }}', CASE WHEN c_custkey % 11 <> 0 THEN '}}' END) AS content
  FROM customer)"""

ENVS = f"""
env_dirs AS (
  SELECT s_suppkey, s_name, 'p' || (s_suppkey % 10) AS project_id,
    CASE WHEN s_suppkey < 10 THEN '' ELSE 's' || s_suppkey || '/' END AS dir FROM supplier),
env_files AS (
  SELECT project_id, dir || '.env' AS path,
    concat_ws({NL}, '# ' || s_name, 'API_KEY=abc', 'DB_HOST=localhost', '', 'no_equals_line') AS content
  FROM env_dirs),
env_examples AS (
  SELECT project_id, dir || '.env.example' AS path FROM env_dirs WHERE s_suppkey % 4 = 0)"""

SCOPE = (
    r"regexp_matches(path, '(^|/)([^/]*\.(ts|js|jsx|tsx)|\.env|Dockerfile|package\.json)$')"
    r" AND NOT regexp_matches('/' || path, '/(node_modules|dist|build|\.git|coverage|demo-examples"
    r"|src/core/rules|tests/fixtures)/')"
)
WORKSPACE = f"""{CODE}, {MANIFESTS}, {ENVS},
all_files AS (
  SELECT * FROM code UNION ALL SELECT * FROM manifests UNION ALL SELECT * FROM env_files),
files AS MATERIALIZED (SELECT * FROM all_files WHERE {SCOPE})"""

DOCUMENTS = """
files AS (
  SELECT source AS project_id, 'docs/' || doc_id || '.ts' AS path, text AS content FROM documents)"""
PAGES = """
files AS (
  SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS project_id, 'pages/' || page_id || '.js' AS path,
    html AS content FROM pages)"""


def stripped_lines(files: str, where: str = "true") -> str:
    return f"""
cut AS (
  SELECT project_id, path, string_split(content, {NL}) AS raws,
    string_split(array_to_string(list_transform(regexp_extract_all(content, {q(PIECES)}),
      lambda t: CASE WHEN starts_with(t, '//') THEN '' WHEN starts_with(t, '/*')
                THEN regexp_replace(t, '[^\\n]', '', 'g') ELSE t END), ''), {NL}) AS bares
  FROM {files} WHERE {where}),
lines AS MATERIALIZED (
  SELECT project_id, path, unnest(range(1, len(raws) + 1))::INT AS line, unnest(raws) AS raw,
    unnest(bares) AS stripped FROM cut)"""


def raw_lines(files: str) -> str:
    return f"""
cut AS (SELECT project_id, path, string_split(content, {NL}) AS raws FROM {files}),
lines AS MATERIALIZED (
  SELECT project_id, path, unnest(range(1, len(raws) + 1))::INT AS line, unnest(raws) AS raw FROM cut)"""


# --- rules ---------------------------------------------------------------------------------------


def reach(rule) -> str:
    tests = []
    for p in rule.applicable_to:
        if p.startswith("."):
            tests.append(f"lower(path) LIKE {q('%' + p)}")
        else:
            tests.append(f"regexp_extract(lower(path), '[^/]*$') = {q(p.lower())}")
    return "(" + " OR ".join(tests) + ")"


SCRIPTS = reach(catalog.XSS)
COMMENT = f"regexp_matches(raw, {q(f'^{WS}*(//|[*]|/[*])')})"


def chain(rule, column: str) -> str:
    """Number of the first pattern that matches a line, 0-based."""
    arms = " ".join(
        f"WHEN regexp_matches({column}, {re2(p.regex)}) THEN {k}"
        for k, p in enumerate(rule.patterns)
    )
    return f"CASE {arms} END"


def messages(rule) -> str:
    return "[" + ", ".join(q(p.message) for p in rule.patterns) + "]"


def as_hits(rule, body: str) -> str:
    """Rows (project_id, path, ord, sub, line, k[, detail]) with the facts of their rule."""
    return f"""
  SELECT project_id, path, {rule.ordinal} AS rule_ordinal, ord, sub, line::INT AS line,
    {q(rule.severity)} AS severity, {messages(rule)}[k + 1] AS template, detail,
    {q(rule.rule_id)} AS rule_id, {q(rule.category)} AS category
  FROM ({body}) WHERE k IS NOT NULL"""


def line_hits(rule, column: str, extra: str = "true") -> str:
    return as_hits(
        rule,
        f"SELECT project_id, path, line AS ord, 0 AS sub, line, {chain(rule, column)} AS k, "
        f"NULL AS detail FROM lines WHERE {reach(rule)} AND {extra}",
    )


def weak_hits() -> str:
    rule = catalog.WEAK_CRYPTO
    p = [re2(x.regex) for x in rule.patterns]
    words = " OR ".join(f"contains(lower(raw), {q(w)})" for w in catalog.SECURITY_KEYWORDS)
    body = f"""
    SELECT project_id, path, line AS ord, k AS sub, line, k, NULL AS detail FROM (
      SELECT *, unnest([CASE WHEN regexp_matches(stripped, {p[0]}) THEN 0 END,
        CASE WHEN regexp_matches(stripped, {p[1]}) THEN 1 END,
        CASE WHEN regexp_matches(stripped, {p[2]}) AND near THEN 2 END]) AS k
      FROM (SELECT *, max({words}) OVER (PARTITION BY project_id, path ORDER BY line
              ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near FROM lines WHERE {reach(rule)})
      WHERE stripped <> '' AND NOT regexp_matches(stripped, {q(f'^{WS}*[*]')}))"""
    return as_hits(rule, body)


def docker_hits() -> str:
    rule = catalog.DOCKER
    services = ", ".join(f"({port}, {k})" for k, (port, _) in enumerate(catalog.SENSITIVE_PORTS))
    body = f"""
    SELECT project_id, path, line AS ord, sub, line, k, NULL AS detail FROM (
      SELECT project_id, path, line, unnest(nums) AS num, unnest(range(len(nums))) AS sub FROM (
        SELECT *, regexp_extract_all(regexp_extract(raw, {q(f'(?i)^{WS}*expose{WS}+(.+)')}, 1), '[0-9]+') AS nums
        FROM lines WHERE {reach(rule)}))
    JOIN (VALUES {services}) AS svc(port, k) ON TRY_CAST(num AS BIGINT) = port"""
    return as_hits(rule, body)


def env_hits() -> str:
    rule = catalog.ENV
    body = f"""
    SELECT project_id, path, 0 AS ord, 0 AS sub, NULL AS line, 0 AS k, NULL AS detail FROM files e
    WHERE {reach(rule)} AND NOT EXISTS (
      SELECT 1 FROM env_examples x WHERE x.project_id = e.project_id AND x.path = e.path || '.example')"""
    return as_hits(rule, body)


def manifest_hits() -> str:
    rule = catalog.DEPENDENCY
    listed = ", ".join(f"({q(n)}, {k})" for k, (n, _) in enumerate(catalog.DANGEROUS_PACKAGES))
    body = f"""
    SELECT d.project_id, d.path, 0 AS ord, k AS sub, max(l.line) AS line, k, NULL AS detail
    FROM (
      SELECT DISTINCT project_id, path, unnest(list_concat(
        coalesce(json_keys(content, '$.dependencies'), []), coalesce(json_keys(content, '$.devDependencies'), []))) AS name
      FROM (SELECT * FROM files WHERE {reach(rule)} AND json_valid(content))) d
    JOIN (VALUES {listed}) AS bad(name, k) USING (name)
    LEFT JOIN lines l ON l.project_id = d.project_id AND l.path = d.path
      AND regexp_extract(l.raw, {q(f'"([^"]+)"{WS}*:')}, 1) = d.name
    GROUP BY ALL"""
    return as_hits(rule, body)


def console_hits() -> str:
    rule = catalog.CONSOLE
    body = f"""
    SELECT project_id, path, min(line) AS ord, 0 AS sub, min(line) AS line, 0 AS k, count(*)::VARCHAR AS detail
    FROM lines WHERE {reach(rule)} AND contains(stripped, 'console.log')
    GROUP BY project_id, path HAVING count(*) > 5"""
    return as_hits(rule, body)


HITS = {
    "cors-permissive": line_hits(catalog.CORS, "stripped"),
    "docker-expose-postgres": docker_hits(),
    "env-missing-example": env_hits(),
    "error-info-leak": line_hits(catalog.ERROR_LEAK, "stripped", f"NOT {COMMENT}"),
    "insecure-dependency": manifest_hits(),
    "console-log-excessive": console_hits(),
    "hardcoded-secrets": line_hits(catalog.SECRETS, "raw"),
    "sql-injection": line_hits(catalog.SQL, "stripped", f"NOT {COMMENT}"),
    "weak-crypto": weak_hits(),
    "xss-vulnerable": line_hits(catalog.XSS, "stripped", f"NOT {COMMENT}"),
}

MESSAGE = "replace(template, '{match}', coalesce(detail, ''))"
FINDING_COLUMNS = (
    "project_id, path, line, severity, message, rule_id, category, rule_ordinal, seq"
)


def findings(hits: str, cap: int | None = None) -> str:
    kept = f"WHERE place <= {cap}" if cap else ""
    return f"""
hits AS MATERIALIZED ({hits}),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY project_id, path ORDER BY rule_ordinal, ord, sub) AS place FROM hits),
findings AS MATERIALIZED (
  SELECT project_id, path, line, severity, {MESSAGE} AS message, rule_id, category, rule_ordinal,
    (row_number() OVER (PARTITION BY project_id, path, rule_ordinal ORDER BY ord, sub) - 1)::INT AS seq
  FROM placed {kept})"""


# Fixed value: the usual limit of findings per file.
CAP = 100
SCAN = f"""{WORKSPACE}, {stripped_lines('files')}, {findings(' UNION ALL '.join(HITS.values()))}"""
SCAN_CAPPED = f"""{WORKSPACE}, {stripped_lines('files')}, {findings(' UNION ALL '.join(HITS.values()), CAP)}"""
RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END"
REPORT_ORDER = f"{RANK}, path, rule_ordinal, seq"
INDEXED = f"""
indexed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY {REPORT_ORDER}) - 1 AS finding_index FROM findings)"""
SCORES = """
counts AS (
  SELECT project_id, count(severity) FILTER (severity = 'critical') AS critical,
    count(severity) FILTER (severity = 'medium') AS medium,
    count(severity) FILTER (severity NOT IN ('critical', 'medium')) AS low
  FROM (SELECT DISTINCT project_id FROM all_files) LEFT JOIN findings USING (project_id) GROUP BY project_id),
scores AS (
  SELECT *, critical + medium + low AS total, greatest(0, 100 - 15 * critical - 6 * medium - 2 * low) AS score,
    80 AS threshold, greatest(0, 100 - 15 * critical - 6 * medium - 2 * low) >= 80 AS passed FROM counts)"""


def rule_query(rule_id: str) -> str:
    return f"""WITH {WORKSPACE}, {stripped_lines('files')}, {findings(HITS[rule_id])}
SELECT {FINDING_COLUMNS} FROM findings"""


# --- rule tables ---------------------------------------------------------------------------------

# Candidate rules come from part, see checks.queries.candidate_rules.
CANDIDATES = """
candidates AS (
  SELECT p_partkey::INT AS load_order,
    CASE p_partkey % 97 WHEN 0 THEN 'xss-vulnerable' WHEN 1 THEN 'weak-crypto'
      ELSE 'r' || (p_partkey % 700) END AS rule_id,
    p_name AS name,
    CASE WHEN p_partkey % 53 = 0 THEN NULL ELSE p_type || ' rule' END AS description,
    lower(p_type) AS category,
    CASE p_size % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' WHEN 3 THEN 'low'
      ELSE CASE WHEN p_size % 2 = 0 THEN 'high' ELSE 'medium' END END AS severity,
    CASE WHEN p_partkey % 41 = 0 THEN ['.ts', NULL] WHEN p_partkey % 43 = 0 THEN NULL
      ELSE ['.ts', '.js'] END AS applicable_to,
    CASE p_partkey % 10 WHEN 0 THEN '(' || p_name WHEN 1 THEN '' WHEN 2 THEN repeat('a', 501)
      WHEN 3 THEN '[' || p_brand WHEN 4 THEN '*' || p_brand WHEN 5 THEN '\\b[0-9]{2}\\b'
      ELSE p_brand || '\\s+[A-Z]{2,3}$' END AS regex_one,
    CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE split_part(p_name, ' ', 1) END AS regex_two
  FROM part),
pattern_rows AS (
  SELECT load_order, 1 AS k, regex_one AS regex FROM candidates UNION ALL
  SELECT load_order, 2, regex_two FROM candidates),
usable AS (
  SELECT load_order, count(*) AS n FROM pattern_rows
  WHERE regex IS NOT NULL AND length(regex) BETWEEN 1 AND 500
    AND TRY(regexp_matches('x', regex)) IS NOT NULL GROUP BY load_order),
judged AS (
  SELECT c.*, coalesce(n, 0) AS usable,
    CASE WHEN description IS NULL THEN 'missing text'
      WHEN severity NOT IN ('critical', 'medium', 'low') THEN 'unknown severity'
      WHEN applicable_to IS NULL OR list_contains(list_transform(applicable_to, lambda a: a IS NULL), true) THEN 'bad path patterns'
      WHEN coalesce(n, 0) = 0 THEN 'no usable pattern' END AS reason
  FROM candidates c LEFT JOIN usable USING (load_order)),
admitted AS (SELECT * FROM judged WHERE reason IS NULL)"""

_built_in = ", ".join(
    f"({r.ordinal}, {q(r.rule_id)}, {q(r.name)}, {q(r.description)}, {q(r.category)}, {q(r.severity)}, "
    f"{q(','.join(r.applicable_to))})"
    for r in catalog.BUILT_IN_RULES
)
BUILT_IN = f"""
built_in(rule_ordinal, rule_id, name, description, category, severity, applicable_to) AS (VALUES {_built_in})"""
MERGED = f"""{CANDIDATES}, {BUILT_IN},
first_custom AS (
  SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY load_order) AS rn FROM admitted
  WHERE rule_id NOT IN (SELECT rule_id FROM built_in)),
merged AS (
  SELECT 'built-in' AS source, rule_ordinal AS load_order, rule_id, name, description, category, severity, applicable_to
  FROM built_in UNION ALL
  SELECT 'custom', load_order, rule_id, name, description, category, severity, array_to_string(applicable_to, ',')
  FROM first_custom WHERE rn = 1)"""

# Custom rules run over pages and documents, see checks.queries.custom_book.
CUSTOM = (
    ("page-tracking", "critical", ("track\\([0-9]+\\)", "gtag\\("), ("Tracker {match} called", "Tag {match}")),
    ("year-number", "low", ("\\b[0-9]{4}\\b",), ("Number {match} found, {match} kept",)),
    ("script-block", "medium", ("(?i)<SCRIPT", "(?i)onload="), ("Inline script", "Handler {match}")),
)


def custom_hits() -> str:
    parts = []
    for i, (rule_id, severity, patterns, texts) in enumerate(CUSTOM):
        number = "CASE " + " ".join(
            f"WHEN regexp_matches(raw, {q(p)}) THEN {k}" for k, p in enumerate(patterns)
        ) + " END"
        found = "CASE k " + " ".join(
            f"WHEN {k} THEN regexp_extract(raw, {q(p)})" for k, p in enumerate(patterns)
        ) + " END"
        template = "[" + ", ".join(q(t) for t in texts) + "][k + 1]"
        parts.append(f"""
  SELECT project_id, path, {11 + i} AS rule_ordinal, line AS ord, line, {q(severity)} AS severity,
    CASE WHEN contains(template, '{{match}}') THEN substr(template, 1, strpos(template, '{{match}}') - 1) || found ||
      substr(template, strpos(template, '{{match}}') + 7) ELSE template END AS message, {q(rule_id)} AS rule_id
  FROM (SELECT *, {template} AS template, {found} AS found FROM (SELECT *, {number} AS k FROM lines) WHERE k IS NOT NULL)""")
    return " UNION ALL ".join(parts)


# --- scan log ------------------------------------------------------------------------------------

LOG = """
scan_log AS MATERIALIZED (
  SELECT 'u' || user_id AS project_id, max(ts) AS ts, count(*) FILTER (event_type = 'error') AS critical,
    count(*) FILTER (event_type = 'purchase') AS medium, count(*) FILTER (event_type = 'click') AS low,
    count(*) AS files_scanned,
    greatest(0, 100 - 15 * count(*) FILTER (event_type = 'error') - 6 * count(*) FILTER (event_type = 'purchase')
      - 2 * count(*) FILTER (event_type = 'click')) AS score
  FROM events GROUP BY user_id, ts::DATE)"""

# --- fixes ---------------------------------------------------------------------------------------

_LOGGED = """
logged AS (
  SELECT project_id, path, regexp_extract(message, 'Found ([0-9]+) console', 1)::BIGINT AS n,
    row_number() OVER (PARTITION BY project_id ORDER BY path) - 1 AS i
  FROM findings WHERE rule_id = 'console-log-excessive'),
log_totals AS (SELECT project_id, count(*) AS files FROM logged GROUP BY project_id)"""
_DOCKER = f"""
docker_edits AS (
  SELECT project_id, path FROM files WHERE {reach(catalog.DOCKER)}
    AND regexp_matches(content, {q(f'(?im)^{WS}*EXPOSE{WS}+5432')}))"""
FIXES = f"""{_LOGGED}, {_DOCKER},
root_env AS (
  SELECT project_id, content FROM files f WHERE path = '.env' AND NOT EXISTS (
    SELECT 1 FROM env_examples x WHERE x.project_id = f.project_id AND x.path = '.env.example')),
suggested AS (
  SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY fix_ordinal, path, occurrence) AS n,
    count(*) OVER (PARTITION BY project_id) AS total
  FROM (
    SELECT project_id, 1 AS fix_ordinal, '.env.example' AS path, 0 AS occurrence, 'env-missing-example' AS rule_id,
      'Create .env.example template from existing .env file' AS description, true AS can_auto_apply FROM root_env
    UNION ALL
    SELECT project_id, 2, 'LOGGING_MIGRATION_NOTE.md', 0, 'logging-migration-note',
      'Create migration note for ' || files || ' file(s) with excessive console.log usage', true FROM log_totals
    UNION ALL
    SELECT project_id, 3, path, seq, rule_id,
      'Remove EXPOSE 5432 (PostgreSQL) from Dockerfile - use internal networking', false
    FROM findings JOIN docker_edits USING (project_id, path) WHERE rule_id = 'docker-expose-postgres'))"""

_env_header = "[" + ", ".join(q(h) for h in fixes.ENV_HEADER) + "]"
TEMPLATE = f"""
template_lines AS (
  SELECT project_id, unnest(range(len(ls)))::INT AS k, unnest(ls) AS text FROM (
    SELECT project_id, list_concat({_env_header}, list_transform(string_split(content, {NL}), lambda l:
      CASE WHEN trim(l) = '' OR starts_with(trim(l), '#') OR strpos(l, '=') <= 1 THEN l
        WHEN regexp_matches(trim(split_part(l, '=', 1)), '(?i)password|secret|key|token|private|api_key|auth')
        THEN trim(split_part(l, '=', 1)) || '=YOUR_' || regexp_replace(upper(trim(split_part(l, '=', 1))), '[^A-Z0-9]', '_', 'g') || '_HERE'
        ELSE trim(split_part(l, '=', 1)) || '=your_' || regexp_replace(lower(trim(split_part(l, '=', 1))), '[^a-z0-9]', '_', 'g') || '_here'
      END), ['']) AS ls FROM root_env))"""
_foot = "[" + ", ".join(q(line) for line in fixes.NOTE_FOOTER) + "]"
NOTE = f"""
note_lines AS (
  SELECT project_id, unnest(range(len(ls))) AS k, unnest(ls) AS text FROM (
    SELECT project_id, list_concat(['# Logging Migration Note', '', '> Generated by scanloom', '> Date: 2024-06-01', '',
      '## Summary', '', 'Excessive console.log usage detected across ' || count(*) || ' file(s).',
      'Consider migrating to a structured logger like pino or winston.', '', '## Affected Files', '',
      '| File | Console.log Count |', '|------|------------------|'],
      list('| ' || path || ' | ' || n || ' |' ORDER BY path), {_foot}) AS ls
    FROM logged GROUP BY project_id))"""
STAMP = "2024-06-01 12:00:00"
NEW_PATCHES = f"""
new_contents AS (
  SELECT project_id, 1 AS fix_ordinal, '.env.example' AS path, k::BIGINT AS k, text FROM template_lines UNION ALL
  SELECT project_id, 2, 'LOGGING_MIGRATION_NOTE.md', k, text FROM note_lines),
new_patches AS (
  SELECT project_id, fix_ordinal, path, k + 3 AS line_no, '+' || text AS text FROM new_contents UNION ALL
  SELECT project_id, fix_ordinal, path, unnest([0, 1, 2]), unnest(['--- /dev/null' || chr(9) || '{STAMP}',
    '+++ b/' || path || chr(9) || '{STAMP}', '@@ -1,0 +1,' || n || ' @@'])
  FROM (SELECT project_id, fix_ordinal, path, count(*) AS n FROM new_contents GROUP BY ALL))"""

_EXPOSED = q(f'(?i)^{WS}*EXPOSE{WS}+5432')
# Hunks of lines that go: removed places, those with at most six lines between them together, three lines around.
EDIT_PATCHES = f"""
edit_lines AS (
  SELECT project_id, path, len(ls) AS n, unnest(range(len(ls))) AS i, unnest(ls) AS raw
  FROM (SELECT project_id, path, string_split(content, {NL}) AS ls FROM files JOIN docker_edits USING (project_id, path)
    WHERE (project_id, path) IN (SELECT (project_id, path) FROM findings WHERE rule_id = 'docker-expose-postgres'))),
gone AS (SELECT project_id, path, n, i FROM edit_lines WHERE regexp_matches(raw, {_EXPOSED})),
marked AS (
  SELECT *, CASE WHEN i - 1 > lag(i) OVER (PARTITION BY project_id, path ORDER BY i) + 6 THEN 1 ELSE 0 END AS opens FROM gone),
grouped AS (SELECT *, sum(opens) OVER (PARTITION BY project_id, path ORDER BY i) AS h FROM marked),
spans AS (
  SELECT project_id, path, h, greatest(0, min(i) - 3) AS a, least(max(n) - 1, max(i) + 3) AS b FROM grouped GROUP BY project_id, path, h),
counted AS (
  SELECT s.*, b - a + 1 AS size, count(*) FILTER (g.i BETWEEN a AND b) AS lost, count(*) FILTER (g.i < a) AS before
  FROM spans s JOIN gone g USING (project_id, path) GROUP BY ALL),
hunks AS (
  SELECT *, 2 + sum(size + 1) OVER (PARTITION BY project_id, path ORDER BY h) - (size + 1) AS line_at FROM counted),
edit_patches AS (
  SELECT project_id, 3 AS fix_ordinal, path, unnest([0, 1])::BIGINT AS line_no,
    unnest(['--- a/' || path || chr(9) || '{STAMP}', '+++ b/' || path || chr(9) || '{STAMP}']) AS text
  FROM (SELECT DISTINCT project_id, path FROM spans)
  UNION ALL SELECT project_id, 3, path, line_at::BIGINT, '@@ -' || (a + 1) || ',' || size || ' +' ||
    (a - before + CASE WHEN size > lost THEN 1 ELSE 0 END) || ',' || (size - lost) || ' @@' FROM hunks
  UNION ALL SELECT project_id, 3, path, (line_at + 1 + i - a)::BIGINT,
    CASE WHEN regexp_matches(raw, {_EXPOSED}) THEN '-' ELSE ' ' END || raw
  FROM hunks JOIN edit_lines USING (project_id, path) WHERE i BETWEEN a AND b)"""

BUNDLE = f"""
patches AS (SELECT * FROM new_patches UNION ALL SELECT * FROM edit_patches),
numbers AS (
  SELECT project_id, count(n) AS total FROM (SELECT DISTINCT project_id FROM all_files) LEFT JOIN suggested USING (project_id)
  GROUP BY project_id),
bundle AS (
  SELECT project_id, 0 AS n, unnest(range(len(head))) AS line_no, unnest(head) AS text FROM (
    SELECT project_id, CASE WHEN total = 0 THEN [{q(fixes.NO_FIXES)}, ''] ELSE ['# scanloom Auto-Fix Patch',
      '# Generated: 2024-06-01T12:00:00.000Z', '# Total suggestions: ' || total, ''] END AS head FROM numbers)
  UNION ALL SELECT project_id, n, unnest(range(7)), unnest([{q(fixes.BAR)}, '# Fix ' || n || '/' || total || ': ' || rule_id,
    '# File: ' || path, '# Description: ' || description,
    '# Auto-apply: ' || CASE WHEN can_auto_apply THEN 'YES' ELSE 'NO - requires manual review' END, {q(fixes.BAR)}, '']) FROM suggested
  UNION ALL SELECT project_id, n, line_no + 7, text FROM suggested JOIN patches USING (project_id, fix_ordinal, path)
  UNION ALL SELECT project_id, n, unnest([{1 << 60}, {(1 << 60) + 1}]), '' FROM suggested)"""

# --- reviews -------------------------------------------------------------------------------------

_FENCE = "'```'"
ANSWERS = f"""
turns AS (
  SELECT conv_id, turn, text, (conv_id * 7 + turn * 3) % 101 AS score10, (conv_id + turn) % 8 AS form
  FROM conversations WHERE role = 'assistant'),
plain AS (
  SELECT *, '{{"severity":"' || CASE turn % 3 WHEN 0 THEN 'critical' WHEN 1 THEN 'medium' ELSE 'low' END ||
    '","cvss":' || CASE WHEN form = 5 THEN '11' ELSE (score10 // 10) || '.' || (score10 % 10) END ||
    CASE form WHEN 3 THEN '' WHEN 4 THEN ',"impact":null' ELSE ',"impact":"impact ' || conv_id || '"' END ||
    ',"exploitability":"step ' || turn || '","remediation":"fix ' || conv_id || '-' || turn ||
    '","falsePositiveRisk":"' || CASE WHEN form = 6 THEN 'none' ELSE 'low' END || '","extra":[1,{{"a":2}}]}}' AS json FROM turns),
answers AS (
  SELECT 'c' || conv_id AS project_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS finding_index,
    conv_id, turn, form, json,
    CASE form WHEN 1 THEN 'Here:' || {NL} || {_FENCE} || 'json' || {NL} || json || {NL} || {_FENCE} || ' done'
      WHEN 2 THEN {_FENCE} || {NL} || json || {NL} || {_FENCE} WHEN 7 THEN text ELSE json END AS response
  FROM plain),
analyses AS (
  SELECT project_id, finding_index, form IN (0, 1, 2, 3) AS valid,
    CASE WHEN form <= 3 THEN json->>'severity' ELSE 'unknown' END AS severity,
    CASE WHEN form <= 3 THEN (json->>'cvss')::DOUBLE ELSE 0 END AS cvss,
    CASE WHEN form <= 2 THEN json->>'impact' ELSE '' END AS impact,
    CASE WHEN form <= 3 THEN json->>'exploitability' ELSE '' END AS exploitability,
    CASE WHEN form <= 3 THEN json->>'remediation' ELSE '' END AS remediation,
    CASE WHEN form <= 3 THEN 'low' ELSE 'medium' END AS "falsePositiveRisk"
  FROM answers)"""
