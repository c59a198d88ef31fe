"""Registered queries of the mechanisms for any number of rules, files of any size, and any two texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import oracle as o
from checks.queries import _HEAD, _TEXT_FILES, _by_severity_sql, as_of, candidate_rules, register, stored_findings, workspace_scores
from scanloom import schemas
from scanloom.functions import text
from scanloom.operators import findings as ops
from scanloom.operators import history, reports, review, rulebook, ruletable, textdiff
from scanloom.operators.linestate import strip_by_line
from scanloom.operators.pluggable import PythonRule, python_rules
from scanloom.operators.rulebook import Rulebook
from scanloom.plans import corpus, scan, storage
from scanloom.sources import documentsink, rulefiles, store
from scanloom.streaming import tracked


def text_files(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.pages(spark, sf).unionByName(corpus.documents(spark, sf))


# --- patterns ------------------------------------------------------------------------------------

#: JavaScript pattern and flags, and a pattern of the other engine that finds the same, in a group.
JAVASCRIPT = (
    (r"[a-z&&[aeiou]]{4}", "v", "([aeiou]{4})"),
    (r"[[A-Z][0-9]]{3,}", "v", "([A-Z0-9]{3,})"),
    (r"[\w--[\d_]]{2}\d", "v", "([A-Za-z]{2}[0-9])"),
    (r"[^\P{Lu}A-Z]", "u", "([À-ÖØ-Þ])"),
    (r"(?<q>[\"'])[a-z]+\k<q>", "", "(\"[a-z]+\"|'[a-z]+')"),
    (r"[\q{ent|ing}x]{2}", "v", "((?:ent|ing|x){2})"),
    (r"(?:(t)h|s)\1e", "", "(thte|se)"),
    (r"(?i:THE) [A-Z]", "", "((?i:the) [A-Z])"),
    (r"É", "i", "([Éé])"),
    (r"\u{6E}g\.$", "u", "(ng[.])$"),
    (r"\d{2,}?(?=\D)", "", "([0-9]{2,}?)[^0-9]"),
    (r"</?(?:h1|b)>", "", "(</?(?:h1|b)>)"),
)


def _javascript_sql() -> str:
    parts = [
        f"SELECT project_id, path, line, {11 + k} AS rule_ordinal, regexp_extract(raw, {o.q(p)}, 1) AS found "
        f"FROM lines WHERE regexp_matches(raw, {o.q(p)})"
        for k, (_, _, p) in enumerate(JAVASCRIPT)
    ]
    return f"WITH {_TEXT_FILES}, {o.raw_lines('files')} " + " UNION ALL ".join(parts)


@register("javascript_patterns", _javascript_sql())
def javascript_patterns(spark, sf):
    rules = [
        rulebook.custom_rule(f"js-{k}", "n", "d", "c", "low", (".ts", ".js"), [(p, flags, "{match}")])
        for k, (p, flags, _) in enumerate(JAVASCRIPT)
    ]
    book = Rulebook().with_custom(rules)
    found = scan.detect.detect(text_files(spark, sf), None, book, [r.rule_id for r in rules])
    return found.select("project_id", "path", "line", "rule_ordinal", F.col("detail").alias("found"))


@register(
    "custom_rule_patterns",
    f"""WITH {o.CANDIDATES}
SELECT load_order, rule_id, 1 AS place, regex_one AS regex,
  CASE load_order % 10 WHEN 0 THEN 'a group without an end' WHEN 1 THEN 'empty regex' WHEN 2 THEN 'longer than 500 characters'
    WHEN 3 THEN 'a class without an end' ELSE 'nothing to repeat' END AS reason
FROM candidates WHERE load_order % 10 < 5
UNION ALL SELECT load_order, rule_id, 2, NULL, 'no regex' FROM candidates WHERE regex_two IS NULL""",
)
def custom_rule_patterns(spark, sf):
    dropped = rulebook.dropped_patterns(candidate_rules(spark, sf))
    return dropped.select("load_order", "rule_id", "place", "regex", "reason")


# --- many rules ----------------------------------------------------------------------------------


def part_rules(spark: SparkSession, sf: str) -> DataFrame:
    """A rule for each part: its number in a tracking call, or as the end of a telephone number."""
    key = F.col("p_partkey").cast("string")

    def pattern(regex, message):
        return F.struct(regex.alias("regex"), F.lit("").alias("flags"), F.lit(message).alias("message"))

    call = F.concat(F.lit(r"\btrack\("), key, F.lit(r"\)"))
    number = F.concat(F.lit(r"\b555-"), F.lpad(key, 4, "0"), F.lit(r"\b(?!-)"))
    return corpus.table(spark, sf, "part").select(
        F.col("p_partkey").cast("int").alias("load_order"),
        F.concat(F.lit("part-"), key).alias("rule_id"),
        F.col("p_name").alias("name"),
        F.lit("d").alias("description"),
        F.lit("parts").alias("category"),
        F.element_at(F.array(*[F.lit(s) for s in schemas.SEVERITIES]), (F.col("p_size") % 3 + 1).cast("int")).alias("severity"),
        F.when(F.col("p_partkey") % 5 == 0, F.array(F.lit(".TS"))).otherwise(F.array(F.lit(".js"), F.lit(".ts"))).alias("applicable_to"),
        F.array(pattern(call, "Calls {match}"), pattern(number, "Number {match}")).alias("patterns"),
    )


@register(
    "many_custom_rules",
    f"""WITH {_TEXT_FILES}, {o.raw_lines('files')}, found AS (
  SELECT project_id, path, line, 0 AS place, x AS match, regexp_extract(x, '[0-9]+') AS key
  FROM (SELECT *, unnest(regexp_extract_all(raw, '\\btrack\\([0-9]+\\)')) AS x FROM lines)
  UNION ALL SELECT project_id, path, line, 1, x, ltrim(x[5:7], '0') || x[8]
  FROM (SELECT *, unnest(regexp_extract_all(raw, '\\b555-[0-9]{{4}}\\b')) AS x FROM lines)
  WHERE NOT contains(raw, x || '-')),
best AS (
  SELECT *, row_number() OVER (PARTITION BY project_id, path, line, key ORDER BY place) AS n FROM found)
SELECT project_id, path, line, ['critical', 'medium', 'low'][(p_size % 3 + 1)::INT] AS severity,
  CASE place WHEN 0 THEN 'Calls ' ELSE 'Number ' END || match AS message, 'part-' || key AS rule_id
FROM best JOIN part ON CAST(p_partkey AS VARCHAR) = key
WHERE n = 1 AND (p_partkey % 5 <> 0 OR ends_with(path, '.ts'))""",
)
def many_custom_rules(spark, sf):
    admitted, _ = rulebook.admit_rules(part_rules(spark, sf))
    book = Rulebook().with_custom(rulebook.compile_rules(rulebook.first_by_id(admitted)))
    custom = F.startswith("rule_id", F.lit("part-"))
    found = scan.detect.detect(text_files(spark, sf), None, book, custom)
    return ops.to_findings(found, book).select("project_id", "path", "line", "severity", "message", "rule_id")


@register(
    "rule_reach_join",
    f"""WITH {o.WORKSPACE}, reach AS (
  SELECT 'supplier-' || s_suppkey AS rule_id, unnest(['s' || s_suppkey || '/.ENV', '/f' || s_suppkey || '.ts',
    CASE WHEN s_suppkey % 9 = 0 THEN '.TSX' END, CASE WHEN s_suppkey % 7 = 0 THEN 'dockerfile' END]) AS p FROM supplier)
SELECT DISTINCT project_id, path, rule_id FROM all_files JOIN reach ON
  CASE WHEN starts_with(p, '.') OR contains(p, '/') THEN ends_with(lower(path), lower(p))
       ELSE regexp_extract(lower(path), '[^/]*$') = lower(p) END""",
)
def rule_reach_join(spark, sf):
    key = F.col("s_suppkey").cast("string")
    reach = F.array(
        F.concat(F.lit("s"), key, F.lit("/.ENV")),
        F.concat(F.lit("/f"), key, F.lit(".ts")),
        F.when(F.col("s_suppkey") % 9 == 0, ".TSX"),
        F.when(F.col("s_suppkey") % 7 == 0, "dockerfile"),
    )
    rules = corpus.table(spark, sf, "supplier").select(
        F.concat(F.lit("supplier-"), key).alias("rule_id"), reach.alias("applicable_to")
    )
    # Files that are told apart, and rules of each once: pairs are distinct as they come.
    return ruletable.rules_by_path(corpus.workspace(spark, sf).select("project_id", "path").distinct(), rules)


# --- lines and texts -----------------------------------------------------------------------------


@register(
    "comment_strip_ranges",
    f"""WITH {o.CODE}, files AS (
  SELECT project_id, 'all' AS path, string_agg(content, {o.NL} ORDER BY regexp_extract(path, 'f([0-9]+)', 1)::INT) AS content
  FROM code GROUP BY project_id),
{o.stripped_lines('files')} SELECT project_id, raw, stripped FROM lines""",
)
def comment_strip_ranges(spark, sf):
    """The code of a project as one file of many ranges."""
    number = F.regexp_extract("path", "f([0-9]+)", 1).cast("bigint")
    lines = corpus.code(spark, sf).select(
        "project_id", number.alias("f"), F.posexplode(text.split_lines(F.col("content"))).alias("pos", "raw")
    )
    lines = lines.select("project_id", (F.col("f") * 1000 + F.col("pos")).alias("line"), "raw")
    return strip_by_line(lines, ["project_id"], range_lines=20_000).select("project_id", "raw", "stripped")


def edited(content, key):
    """A text without every seventh line and with a new line before every fifth."""
    lines = text.split_lines(content)
    kept = F.transform(lines, lambda x, i: F.when((i + key) % 7 != 3, x))
    added = F.transform(
        kept,
        lambda x, i: F.when(
            (i + key) % 5 == 0, F.array(F.concat(F.lit("+new "), i.cast("string")), x)
        ).otherwise(F.array(x)),
    )
    return F.array_join(F.array_compact(F.flatten(added)), "\n")


_EDITED = """
cut AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
edited AS (
  SELECT doc_id, lines, list_filter(range(0, len(lines)), lambda i: (i + doc_id) % 7 = 3) AS gone,
    list_filter(range(0, len(lines)), lambda i: (i + doc_id) % 5 = 0) AS fresh,
    list_filter(flatten(list_transform(range(0, len(lines)), lambda i: [
      CASE WHEN (i + doc_id) % 5 = 0 THEN '+new ' || i END, CASE WHEN (i + doc_id) % 7 <> 3 THEN lines[i + 1] END])),
      lambda x: x IS NOT NULL) AS result
  FROM cut)"""


@register(
    "text_diff",
    f"""WITH {_EDITED}
SELECT doc_id, len(gone)::BIGINT AS removed, len(fresh)::BIGINT AS added,
  CASE WHEN len(result) > 0 THEN md5(array_to_string(result, chr(10))) END AS applied,
  md5(array_to_string(lines, chr(10))) AS back FROM edited""",
)
def text_diff(spark, sf):
    """Shortest scripts between documents and edited ones, applied to either side."""
    docs = corpus.table(spark, sf, "documents").select("doc_id", "text", edited(F.col("text"), F.col("doc_id")).alias("new"))
    # A text without any line is null.
    empty = F.size(F.filter(F.transform(text.split_lines(F.col("text")), lambda x, i: (i + F.col("doc_id")) % 7 == 3), lambda x: ~x))
    none = (empty == 0) & (F.col("new") == "")
    docs = docs.withColumn("new", F.when(~none, F.col("new")))
    diffed = docs.withColumns(
        {"forth": textdiff.text_hunks("text", "new"), "turned": textdiff.text_hunks("new", "text")}
    )

    def count(sign):
        return F.size(F.filter("forth", lambda x: F.startswith(x, F.lit(sign)))).cast("bigint")

    return diffed.select(
        "doc_id",
        count("-").alias("removed"),
        count("+").alias("added"),
        F.md5(textdiff.patched("text", "forth")).alias("applied"),
        F.md5(textdiff.patched("new", "turned")).alias("back"),
    )


# --- rules in code -------------------------------------------------------------------------------


def _long_lines(path: str, content: str):
    for i, line in enumerate(content.split("\n")):
        if len(line) > 400:
            yield i + 1, None, f"Line of {len(line)} characters"


def _odd_documents(path: str, content: str):
    yield 1, "critical", "First line seen"
    if path.endswith("7.ts"):
        raise ValueError(f"cannot read {path}")


def _no_findings(path: str, content: str):
    if path.endswith("3.ts"):
        yield "not a finding"


CODE_RULES = (
    PythonRule("long-line", "low", "style", (".ts",), _long_lines),
    PythonRule("odd", "medium", "tests", (".TS",), _odd_documents),
    PythonRule("broken", "low", "tests", (".js", ".ts"), _no_findings),
    PythonRule("elsewhere", "low", "tests", (".py", "docs/5.ts", "s/55.TS"), lambda path, content: [(None, "", "Matched by its end")]),
    PythonRule("long-line", "low", "repeated", (".ts",), _odd_documents),
    PythonRule("", "low", "no id", (".ts",), _odd_documents),
)


@register(
    "python_rules",
    f"""WITH {o.DOCUMENTS}, {o.raw_lines('files')}
SELECT project_id, path[6:] AS path, line, 'low' AS severity, 'Line of ' || length(raw) || ' characters' AS message,
  'long-line' AS rule_id, 'style' AS category, 1000 AS rule_ordinal,
  (row_number() OVER (PARTITION BY project_id, path ORDER BY line) - 1)::INT AS seq, NULL AS error
FROM lines WHERE length(raw) > 400
UNION ALL SELECT project_id, path[6:], 1, 'critical', 'First line seen', 'odd', 'tests', 1001, 0, NULL
FROM files WHERE NOT ends_with(path, '7.ts')
UNION ALL SELECT project_id, path[6:], NULL, NULL, NULL, 'odd', 'tests', 1001, NULL, 'Rule odd failed: cannot read ' || path
FROM files WHERE ends_with(path, '7.ts')
UNION ALL SELECT project_id, path[6:], NULL, NULL, NULL, 'broken', 'tests', 1002, NULL, 'Rule broken failed: too many values to unpack (expected 3, got 13)'
FROM files WHERE ends_with(path, '3.ts')
UNION ALL SELECT project_id, path[6:], NULL, 'low', 'Matched by its end', 'elsewhere', 'tests', 1003, 0, NULL
FROM files WHERE path IN ('docs/5.ts', 'docs/55.ts')""",
)
def python_rules_query(spark, sf):
    """All rules in code in one pass: findings, defaults, paths below a root, and failures."""
    found = python_rules(corpus.documents(spark, sf), CODE_RULES, F.lit("docs"))
    # The text of this error has the number of values only in newer interpreters.
    error = F.regexp_replace("error", r"\(expected 3\)$", "(expected 3, got 13)")
    return found.withColumn("error", error)


# --- caps, scores and orders ---------------------------------------------------------------------


#: Files of many findings, and projects of few, composed of the same code.
def _recomposed(project: str, path: str, findings: str) -> str:
    return f"""{o.CODE}, all_files AS (
  SELECT {project} AS project_id, {path} AS path, string_agg(content, {o.NL} ORDER BY f) AS content
  FROM (SELECT *, regexp_extract(path, 'f([0-9]+)', 1)::INT AS f FROM code) GROUP BY ALL),
files AS MATERIALIZED (SELECT * FROM all_files), env_examples AS (SELECT NULL::VARCHAR AS project_id, NULL::VARCHAR AS path),
{o.stripped_lines('files')}, {findings}"""


_ALL_HITS = " UNION ALL ".join(o.HITS.values())
_DENSE = _recomposed("'p' || (f // 200)", "'src/g' || (f // 25) || '.ts'", o.findings(_ALL_HITS, o.CAP))
#: A project for every three lines of code.
_SPARSE = f"""{o.CODE}, pieces AS (
  SELECT regexp_extract(path, 'f([0-9]+)', 1) AS f, unnest(range(0, len(lines))) AS pos, unnest(lines) AS line
  FROM (SELECT path, string_split(content, {o.NL}) AS lines FROM code)),
all_files AS (
  SELECT 'q' || f || '-' || (pos // 3) AS project_id, 'src/few.ts' AS path, string_agg(line, {o.NL} ORDER BY pos) AS content
  FROM pieces GROUP BY ALL),
files AS MATERIALIZED (SELECT * FROM all_files), env_examples AS (SELECT NULL::VARCHAR AS project_id, NULL::VARCHAR AS path),
{o.stripped_lines('files')}, {o.findings(_ALL_HITS)}"""


def recomposed(spark: SparkSession, sf: str, projects: int, per_file: int, name: str, project: str) -> DataFrame:
    code = corpus.code(spark, sf).select(
        F.regexp_extract("path", "f([0-9]+)", 1).cast("int").alias("f"), "content"
    )
    parts = F.array_sort(F.collect_list(F.struct("f", "content")))
    return code.groupBy(
        F.concat(F.lit(project), F.floor(F.col("f") / projects).cast("string")).alias("project_id"),
        F.concat(F.lit(name), F.floor(F.col("f") / per_file).cast("string"), F.lit(".ts")).alias("path"),
    ).agg(F.array_join(F.transform(parts, lambda p: p["content"]), "\n").alias("content"))


@register(
    "dense_findings_capped",
    f"WITH {_DENSE} SELECT {o.FINDING_COLUMNS} FROM findings",
)
def dense_findings_capped(spark, sf):
    """Files of several hundred findings, of which the first hundred stay."""
    files = recomposed(spark, sf, 200, 25, "src/g", "p")
    return scan.scan(files, cap=schemas.MAX_FINDINGS_PER_FILE)


@register(
    "small_project_scores",
    f"""WITH {_SPARSE}, {o.SCORES}
SELECT project_id, critical, medium, low, total, score, threshold, passed FROM scores""",
)
def small_project_scores(spark, sf):
    """Projects of three lines each: scores from 0 to 100, on both sides of the gate."""
    lines = corpus.code(spark, sf).select(
        F.regexp_extract("path", "f([0-9]+)", 1).alias("f"), F.posexplode(text.split_lines(F.col("content"))).alias("pos", "line")
    )
    piece = F.floor(F.col("pos") / 3).cast("string")
    files = lines.groupBy(F.concat(F.lit("q"), "f", F.lit("-"), piece).alias("project_id")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda p: p["line"]), "\n").alias("content")
    )
    scored = scan.project_scores(files.select("project_id", F.lit("src/few.ts").alias("path"), "content"))
    return scored.select("project_id", "critical", "medium", "low", "total", "score", "threshold", "passed")


def _locale_name(path: str) -> str:
    """Names that are ordered otherwise by their bytes than by readers."""
    return f"CASE length({path}) % 3 WHEN 0 THEN upper({path}) WHEN 1 THEN 'É' || {path} ELSE {path} END"


@register(
    "report_sorts_locale",
    f"""WITH {o.SCAN}, visible AS (
  SELECT *, {_locale_name('path')} AS name FROM findings WHERE severity IN ('critical', 'medium'))
SELECT project_id, name, rule_id, seq,
  row_number() OVER (PARTITION BY project_id ORDER BY {o.RANK}, name, rule_ordinal, seq) - 1 AS by_severity,
  row_number() OVER (PARTITION BY project_id ORDER BY icu_sort_key(name, 'en'), name, {o.RANK}, name, rule_ordinal, seq) - 1 AS by_file,
  row_number() OVER (PARTITION BY project_id ORDER BY icu_sort_key(rule_id, 'en'), rule_id, {o.RANK}, name, rule_ordinal, seq) - 1 AS by_rule
FROM visible""",
)
def report_sorts_locale(spark, sf):
    named = stored_findings(spark, sf).withColumn("path", F.expr(_locale_name("path")))
    positions = ops.report_positions(named, ("critical", "medium"), "UNICODE")
    return positions.select(
        "project_id", F.col("path").alias("name"), "rule_id", "seq", "by_severity", "by_file", "by_rule"
    )


# --- history scan by scan ------------------------------------------------------------------------


@register(
    "history_by_scan",
    f"""WITH {o.LOG}, placed AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY ts DESC) AS place FROM scan_log)
SELECT project_id, place, ts, 'scan-' || (floor(epoch(ts))::BIGINT % 7) AS scan_id, score::INT AS score, files_scanned::INT AS files_scanned,
  count(*) OVER (PARTITION BY project_id) AS entries
FROM placed QUALIFY place <= 10""",
)
def history_by_scan(spark, sf):
    """The log in seven appends, out of order and some twice; the newest ten from the state alone."""
    path = storage.fresh_path(spark, "history")
    log = corpus.scan_log(spark, sf).withColumn("part", (F.unix_timestamp("ts") % 7).cast("int"))
    for version, part in enumerate((5, 0, 3, 3, 6, 1, 5, 2, 4)):
        some = log.where(F.col("part") == part)
        history.append_scan(some, f"{path}/all", f"scan-{part}")
        history.update_newest(some, f"{path}/newest", f"scan-{part}", version)
    counts = history.read_scans(spark, f"{path}/all").groupBy("project_id").agg(F.count("*").alias("entries"))
    newest = history.newest_rows(history.read_newest(spark, f"{path}/newest"))
    return newest.join(counts, "project_id").select(
        "project_id", "place", "ts", "scan_id", "score", "files_scanned", "entries"
    )


# --- streams, sinks and stores -------------------------------------------------------------------


@register(
    "stream_env_examples",
    f"""WITH {o.WORKSPACE} SELECT project_id, path FROM files e
WHERE regexp_matches(path, '(^|/)[.]env$') AND NOT EXISTS (
  SELECT 1 FROM env_examples x WHERE x.project_id = e.project_id AND x.path = e.path || '.example')""",
)
def stream_env_examples(spark, sf):
    """Names that arrive in three parts, examples after most of their files, and some names again."""
    target = storage.fresh_path(spark, "stream")
    names = corpus.env_listing(spark, sf)
    example, odd = F.endswith("path", F.lit(".example")), F.pmod(F.xxhash64("path"), F.lit(3)) == 0
    for part in (~example | odd, example, F.lit(True)):
        names.where(part).write.mode("append").parquet(f"{target}/in")
        changes = tracked.env_changes(spark.readStream.schema(names.schema).parquet(f"{target}/in"))
        query = tracked._by_batch(changes, "append", f"{target}/out/changes", f"{target}/progress", {})
        query.awaitTermination()
    return tracked.missing_examples(spark, f"{target}/out")


@register(
    "stream_project_scores",
    f"""WITH {o.DOCUMENTS}, all_files AS (SELECT * FROM files), env_examples AS (SELECT NULL::VARCHAR AS project_id, NULL::VARCHAR AS path),
{o.stripped_lines('files')}, {o.findings(_ALL_HITS)}, {o.SCORES}
SELECT project_id, critical, medium, low, total, score, threshold, passed FROM scores""",
)
def stream_project_scores(spark, sf):
    """Scores of projects whose files arrive as a stream, from counts kept as state."""
    files = corpus.arriving(spark, sf, "documents").select(
        F.col("source").alias("project_id"),
        F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".ts")).alias("path"),
        F.col("text").alias("content"),
    )
    target = storage.fresh_path(spark, "stream")
    for query in tracked.track_stream(files, target):
        query.awaitTermination()
    return tracked.stream_scores(spark, target).select(
        "project_id", "critical", "medium", "low", "total", "score", "threshold", "passed"
    )


@register(
    "document_commit",
    f"""WITH {o.SCAN}, {o.SCORES}, parts AS ({_by_severity_sql(_HEAD)})
SELECT project_id, md5(string_agg(text, '' ORDER BY section, item)) AS document FROM parts GROUP BY project_id""",
)
def document_commit(spark, sf):
    """Reports written by many tasks, visible at once, and read back."""
    found = stored_findings(spark, sf)
    parts = reports.json_report(workspace_scores(spark, sf, found), found, as_of())
    target = storage.fresh_path(spark, "documents")
    documentsink.write_documents_at_once(parts, target)
    # The documents are compared whole here; a file of a very long one is one row.
    read = documentsink.read_parts(spark, target)
    whole = F.array_sort(F.collect_list(F.struct("part", "text")))
    return read.groupBy("project_id").agg(F.md5(F.array_join(F.transform(whole, lambda p: p["text"]), "")).alias("document"))


@register(
    "store_read",
    """SELECT s_suppkey, 'ok' AS status, s_name || chr(10) || 'eval(x)' AS content FROM supplier""",
)
def store_read(spark, sf):
    """Files of a tree in the shared folder, listed level by level and read in tasks of equal bytes."""
    target = storage.fresh_path(spark, "tree")
    key = F.col("s_suppkey")
    none = F.lit("__HIVE_DEFAULT_PARTITION__")
    folder = F.concat(
        F.lit("a="), F.coalesce(F.concat(F.lit("a"), (key % 5).cast("string")), none),
        F.lit("/b="), F.coalesce(F.concat(F.lit("b"), key.cast("string")), none),
    )
    made = corpus.table(spark, sf, "supplier").select(
        folder.alias("folder"), F.concat("s_name", F.lit("\neval(x)")).alias("text")
    )
    store.write_store(made, target)
    listing = store.list_store(spark, [target])
    # Files of text stand for sources here.
    listing = listing.where(F.endswith("path", F.lit(".txt")))
    dealt = store.by_bytes(listing, 1 << 20)
    return store.read_dealt(dealt).select(
        F.regexp_extract("path", "b=b([0-9]+)/", 1).cast("bigint").alias("s_suppkey"),
        "status",
        F.rtrim("content", F.lit("\n")).alias("content"),
    )


# --- rule files and the fifth answer -------------------------------------------------------------


@register(
    "rule_files",
    """SELECT p_partkey::INT AS number, 'r' || p_partkey AS rule_id, CASE WHEN p_partkey % 11 <> 0 THEN p_name END AS name,
  CASE WHEN p_partkey % 13 <> 0 THEN 'low' END AS severity, CASE WHEN p_partkey % 17 <> 0 THEN '.ts,Dockerfile' END AS reach,
  p_brand || '\\d+' AS regex, CASE p_partkey % 3 WHEN 0 THEN 'gi' WHEN 1 THEN '' ELSE '?' END AS flags,
  (p_partkey // 40)::INT AS file, (p_partkey % 40)::INT AS place
FROM part WHERE (p_partkey // 40) % 10 <> 9""",
)
def rule_files(spark, sf):
    """Forty rules a file; values of wrong types become null, broken files have no rules."""
    key = F.col("p_partkey")
    def quoted(c):
        text = F.to_json(F.array(c))
        return F.substring(text, F.lit(2), F.length(text) - 2)

    flags = F.when(key % 3 == 0, ', "flags": "gi"').when(key % 3 == 1, "").otherwise(', "flags": [1]')
    text_of = F.concat(
        F.lit("  - id: r"), key.cast("string"),
        F.lit("\n    name: "), F.when(key % 11 != 0, quoted(F.col("p_name"))).otherwise("12"),
        F.lit("\n    description: d # a comment\n    category: 'c'\n    severity: "), F.when(key % 13 != 0, "low").otherwise("true"),
        F.lit("\n    applicableTo: "), F.when(key % 17 != 0, "[.ts, 'Dockerfile']").otherwise(".ts"),
        F.lit('\n    patterns:\n      - {"regex": '), quoted(F.concat("p_brand", F.lit("\\d+"))), F.lit(', "message": "m"'), flags, F.lit("}"),
    )
    position = F.floor(key / 40)
    parts = F.array_sort(F.collect_list(F.struct(key.alias("k"), text_of.alias("t"))))
    files = corpus.table(spark, sf, "part").groupBy(position.alias("position")).agg(
        F.concat(F.lit("rules:\n"), F.array_join(F.transform(parts, lambda p: p["t"]), "\n")).alias("content")
    )
    broken = F.when(F.col("position") % 10 == 9, F.concat(F.lit("rules: ["), "content")).otherwise(F.col("content"))
    rules = rulefiles.parse_rule_files(files.select("position", broken.alias("content")))
    pattern = F.element_at("patterns", 1)
    return rules.select(
        F.substring("rule_id", F.lit(2), F.lit(9)).cast("int").alias("number"),
        "rule_id",
        "name",
        "severity",
        F.array_join("applicable_to", ",").alias("reach"),
        pattern["regex"].alias("regex"),
        pattern["flags"].alias("flags"),
        F.shiftright("load_order", 24).cast("int").alias("file"),
        F.pmod("load_order", F.lit(1 << 24)).cast("int").alias("place"),
    )


@register(
    "review_summary_answers",
    """WITH turns AS (SELECT conv_id, turn, (conv_id + turn) % 7 AS form, 'risk ' || conv_id AS risk, 'fix ' || turn AS fix FROM conversations)
SELECT conv_id, turn, form IN (0, 1, 2, 6) AS valid, CASE WHEN form IN (0, 1, 2, 6) THEN risk || '|second' ELSE '' END AS risks,
  CASE WHEN form IN (0, 1) THEN fix ELSE '' END AS fixes,
  CASE WHEN form IN (0, 1, 2) THEN 'ready ' || turn ELSE 'Unable to determine ship readiness.' END AS readiness
FROM turns""",
)
def review_summary_answers(spark, sf):
    """The fifth answer shape: lists of texts, in plain, fenced, incomplete and broken answers."""
    conv, turn = F.col("conv_id"), F.col("turn")
    form = (conv + turn) % 7
    risks = F.concat(F.lit('["risk '), conv.cast("string"), F.lit('","second"]'))
    fixes = F.concat(F.lit('["fix '), turn.cast("string"), F.lit('"]'))
    ready = F.concat(F.lit('"ready '), turn.cast("string"), F.lit('"'))
    answer = F.concat(
        F.lit('{"prioritizedRisks":'), F.when(form == 3, F.lit('"one"')).otherwise(risks),
        F.when(form.isin(2, 6), F.lit("")).otherwise(F.concat(F.lit(',"quickFixes":'), F.when(form == 4, F.lit('["a",1]')).otherwise(fixes))),
        F.when(form == 6, F.lit("")).otherwise(F.concat(F.lit(',"shipReadiness":'), ready)), F.lit(',"more":{"x":[1]}}'),
    )
    answer = F.when(form == 1, F.concat(F.lit("Here:\n```json\n"), answer, F.lit("\n```\nDone"))).when(
        form == 5, F.concat(answer, F.lit(" and more"))
    ).otherwise(answer)
    given = corpus.table(spark, sf, "conversations").select("conv_id", "turn", answer.alias("response"))
    checked = review.parse_answer(given, review.REVIEW)
    return checked.select(
        "conv_id", "turn", "valid", F.array_join("prioritizedRisks", "|").alias("risks"),
        F.array_join("quickFixes", "|").alias("fixes"), F.col("shipReadiness").alias("readiness"),
    )
