"""Fix suggestions and their patches.

Patches are tables of lines: a project can have any number of affected files, so neither the
logging note nor the patch bundle is gathered into one value. ``fix_ordinal`` orders the kinds of
fixes: environment template, logging note, Dockerfile edit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.functions import paths, scalars, text
from scanloom.functions.editdiff import removal_hunks
from scanloom.operators import catalog
from scanloom.operators.numbering import number_rows
from scanloom.operators.reports import iso_instant
from scanloom.plans.scan import analyze
from scanloom.plans.storage import settle

# File names, rule names and texts of the fixes.
ENV_EXAMPLE = ".env.example"
NOTE_PATH = "LOGGING_MIGRATION_NOTE.md"
NOTE_RULE = "logging-migration-note"
LOGGING_RULES = ("console-log-excessive", "console-log")
NO_FIXES = "# No automated fixes available for current scan results"
BAR = "# " + "═" * 77
ENV_HEADER = (
    "# Environment Variables Template",
    "# Copy this file to .env and fill in your values",
    "",
)
NOTE_FOOTER = (
    "",
    "## Migration Example",
    "",
    "### Before",
    "console.log('User logged in:', userId);",
    "console.error('Failed to connect to database');",
    "",
    "### After (using pino)",
    "import logger from './logger';",
    "",
    "logger.info({ userId }, 'User logged in');",
    "logger.error('Failed to connect to database');",
    "",
    "## Benefits",
    "",
    "- Structured JSON logs for better parsing",
    "- Log levels (debug, info, warn, error)",
    "- Better performance with async logging",
    "- Centralized log configuration",
    "",
    "---",
    "*This file was auto-generated. You can delete it after migration is complete.*",
    "",
)
_NOTE_HEAD_LINES = 14
_HEADER_LINES = 3

PATCH_LINES = "project_id string, fix_ordinal int, path string, line_no bigint, text string"


def _new_file_header(path: str, lines: Column, as_of: Column) -> Column:
    stamp = scalars.diff_stamp(as_of)
    return F.array(
        F.concat(F.lit("--- /dev/null\t"), stamp),
        F.concat(F.lit(f"+++ b/{path}\t"), stamp),
        F.concat(F.lit("@@ -1,0 +1,"), lines.cast("string"), F.lit(" @@")),
    )


def fixable_files(files: DataFrame) -> DataFrame:
    """The few files the fixes look into: root environment files and Dockerfiles to edit.

    Store this table and give it to the functions below, so that all fixes together read the whole
    set of files once.
    """
    edited = paths.applies_to(F.col("path"), catalog.DOCKER.applicable_to) & F.rlike(
        "content", F.lit("(?i)expose")
    )
    return files.where((F.col("path") == ".env") | edited).select("project_id", "path", "content")


# --- environment template ------------------------------------------------------------------------


def _root_env(files: DataFrame, listing: DataFrame) -> DataFrame:
    examples = listing.where(F.col("path") == ENV_EXAMPLE).select("project_id")
    return (
        files.where(F.col("path") == ".env")
        .select("project_id", "content")
        .join(examples, "project_id", "left_anti")
    )


def _template_lines() -> Column:
    own = F.transform(text.split_lines(F.col("content")), scalars.env_template_line)
    return F.concat(F.array(*[F.lit(h) for h in ENV_HEADER]), own, F.array(F.lit("")))


def env_template(files: DataFrame, listing: DataFrame) -> DataFrame:
    """Lines of the template for each project whose root ``.env`` has no example beside it."""
    return _root_env(files, listing).select(
        "project_id", F.posexplode(_template_lines()).alias("k", "text")
    )


def _env_patch_lines(files: DataFrame, listing: DataFrame, as_of: Column) -> DataFrame:
    """The patch that adds the template; one file is one row, so its length is at hand."""
    lines = _root_env(files, listing).select("project_id", _template_lines().alias("lines"))
    added = F.transform("lines", lambda line: F.concat(F.lit("+"), line))
    whole = F.concat(_new_file_header(ENV_EXAMPLE, F.size("lines"), as_of), added)
    return lines.select(
        "project_id",
        F.lit(1).alias("fix_ordinal"),
        F.lit(ENV_EXAMPLE).alias("path"),
        F.posexplode(whole).alias("line_no", "text"),
    ).withColumn("line_no", F.col("line_no").cast("bigint"))


# --- logging note --------------------------------------------------------------------------------


def logging_files(findings: DataFrame) -> DataFrame:
    """Files with excessive logging and the count their message names, 1 where it names none."""
    named = F.regexp_extract("message", r"Found ([0-9]+) console\.log", 1)
    return findings.where(F.col("rule_id").isin(*LOGGING_RULES)).select(
        "project_id",
        "path",
        F.coalesce(named.try_cast("bigint"), F.lit(1)).alias("count"),
    )


def _noted(findings: DataFrame, listing: DataFrame) -> DataFrame:
    notes = listing.where(F.col("path") == NOTE_PATH).select("project_id")
    return (
        logging_files(findings)
        .where(F.col("count") > 0)
        .join(notes, "project_id", "left_anti")
    )


def logging_note(
    findings: DataFrame, listing: DataFrame, as_of: Column
) -> DataFrame:
    """Lines of the logging note of each project with affected files, files in path order."""
    files = _noted(findings, listing)
    totals = files.groupBy("project_id").agg(F.count(F.lit(1)).alias("files"))
    head = F.array(
        F.lit("# Logging Migration Note"),
        F.lit(""),
        F.lit("> Generated by scanloom"),
        F.concat(F.lit("> Date: "), F.date_format(as_of, "yyyy-MM-dd")),
        F.lit(""),
        F.lit("## Summary"),
        F.lit(""),
        F.concat(
            F.lit("Excessive console.log usage detected across "),
            F.col("files").cast("string"),
            F.lit(" file(s)."),
        ),
        F.lit("Consider migrating to a structured logger like pino or winston."),
        F.lit(""),
        F.lit("## Affected Files"),
        F.lit(""),
        F.lit("| File | Console.log Count |"),
        F.lit("|------|------------------|"),
    )
    foot = F.array(*[F.lit(line) for line in NOTE_FOOTER])
    top = totals.select("project_id", F.posexplode(head).alias("k", "text"))
    rows = number_rows(files, ["project_id"], ["path"], "i").select(
        "project_id",
        (F.col("i") + _NOTE_HEAD_LINES).alias("k"),
        F.concat(
            F.lit("| "), "path", F.lit(" | "), F.col("count").cast("string"), F.lit(" |")
        ).alias("text"),
    )
    bottom = totals.select("project_id", "files", F.posexplode(foot).alias("i", "text")).select(
        "project_id", (F.col("files") + _NOTE_HEAD_LINES + F.col("i")).alias("k"), "text"
    )
    return top.unionByName(rows).unionByName(bottom)


def _note_patch_lines(note: DataFrame, as_of: Column) -> DataFrame:
    """The patch that adds the note. It may be long, so its length is counted apart."""
    size = note.groupBy("project_id").agg(F.count(F.lit(1)).alias("n"))
    header = _new_file_header(NOTE_PATH, F.col("n"), as_of)
    head = size.select("project_id", F.posexplode(header).alias("line_no", "text"))
    body = note.select(
        "project_id",
        (F.col("k") + _HEADER_LINES).alias("line_no"),
        F.concat(F.lit("+"), "text").alias("text"),
    )
    return head.unionByName(body).select(
        "project_id",
        F.lit(2).alias("fix_ordinal"),
        F.lit(NOTE_PATH).alias("path"),
        F.col("line_no").cast("bigint").alias("line_no"),
        "text",
    )


# --- Dockerfile edit -----------------------------------------------------------------------------


def docker_edits(files: DataFrame) -> DataFrame:
    """Dockerfiles with lines that expose PostgreSQL, and their lines without them."""
    exposed = F.lit(catalog.EXPOSE_POSTGRES_LINE)
    return (
        files.where(paths.applies_to(F.col("path"), catalog.DOCKER.applicable_to))
        .where(F.rlike("content", F.lit("(?i)expose")))
        .select("project_id", "path", text.split_lines(F.col("content")).alias("old"))
        .withColumn("places", F.transform("old", lambda line, i: F.when(F.rlike(line, exposed), i)))
        .withColumn("removed", F.array_compact("places"))
        .drop("places")
        .where(F.size("removed") > 0)
    )


def kept_lines(old: Column, removed: Column) -> Column:
    """The lines that stay."""
    return F.filter(old, lambda _, i: ~F.array_contains(removed, i))


def _docker_patch_lines(edits: DataFrame, as_of: Column) -> DataFrame:
    stamp = scalars.diff_stamp(as_of)
    old_header = F.concat(F.lit("--- a/"), "path", F.lit("\t"), stamp)
    new_header = F.concat(F.lit("+++ b/"), "path", F.lit("\t"), stamp)
    return (
        edits.withColumn("hunks", removal_hunks(F.col("old"), F.col("removed")))
        .select(
            "project_id",
            F.lit(3).alias("fix_ordinal"),
            "path",
            F.posexplode(F.concat(F.array(old_header, new_header), F.col("hunks"))).alias(
                "line_no", "text"
            ),
        )
        .withColumn("line_no", F.col("line_no").cast("bigint"))
    )


# --- suggestions and patches ---------------------------------------------------------------------


def suggestions(
    files: DataFrame, listing: DataFrame, findings: DataFrame
) -> DataFrame:
    """All fix suggestions, numbered within their project from 1.

    The environment template depends on the files alone. A Dockerfile gets one suggestion per
    finding that names it. The suggestions are stored before they are numbered.
    """
    env = _root_env(files, listing).select(
        "project_id",
        F.lit(1).alias("fix_ordinal"),
        F.lit(ENV_EXAMPLE).alias("path"),
        F.lit(0).alias("occurrence"),
        F.lit(catalog.ENV.rule_id).alias("rule_id"),
        F.lit("Create .env.example template from existing .env file").alias("description"),
        F.lit(True).alias("can_auto_apply"),
    )
    note = (
        _noted(findings, listing)
        .groupBy("project_id")
        .agg(F.count(F.lit(1)).alias("files"))
        .select(
            "project_id",
            F.lit(2).alias("fix_ordinal"),
            F.lit(NOTE_PATH).alias("path"),
            F.lit(0).alias("occurrence"),
            F.lit(NOTE_RULE).alias("rule_id"),
            F.concat(
                F.lit("Create migration note for "),
                F.col("files").cast("string"),
                F.lit(" file(s) with excessive console.log usage"),
            ).alias("description"),
            F.lit(True).alias("can_auto_apply"),
        )
    )
    docker = (
        findings.where(F.col("rule_id") == catalog.DOCKER.rule_id)
        .join(docker_edits(files).select("project_id", "path"), ["project_id", "path"])
        .select(
            "project_id",
            F.lit(3).alias("fix_ordinal"),
            "path",
            F.col("seq").alias("occurrence"),
            F.lit(catalog.DOCKER.rule_id).alias("rule_id"),
            F.lit(
                "Remove EXPOSE 5432 (PostgreSQL) from Dockerfile - use internal networking"
            ).alias("description"),
            F.lit(False).alias("can_auto_apply"),
        )
    )
    every = settle(env.unionByName(note).unionByName(docker))
    numbered = number_rows(
        every, ["project_id"], ["fix_ordinal", "path", "occurrence"], "n"
    )
    return numbered.withColumn("n", F.col("n") + 1)


def patch_lines(
    files: DataFrame, listing: DataFrame, findings: DataFrame, as_of: Column
) -> DataFrame:
    """The lines of every patch, once per patched file."""
    note = logging_note(findings, listing, as_of)
    named = (
        findings.where(F.col("rule_id") == catalog.DOCKER.rule_id)
        .select("project_id", "path")
        .distinct()
    )
    edits = docker_edits(files).join(named, ["project_id", "path"], "left_semi")
    return (
        _env_patch_lines(files, listing, as_of)
        .unionByName(_note_patch_lines(note, as_of))
        .unionByName(_docker_patch_lines(edits, as_of))
    )


def patch_bundle(
    projects: DataFrame, suggested: DataFrame, lines: DataFrame, as_of: Column
) -> DataFrame:
    """The patch document of each project as ``(project_id, n, line_no, text)`` lines.

    ``n`` is 0 for the header, then the number of the suggestion. Projects without suggestions get
    the one line that says so.
    """
    totals = (
        projects.select("project_id", F.lit(0).cast("bigint").alias("one"))
        .unionByName(suggested.select("project_id", F.lit(1).cast("bigint").alias("one")))
        .groupBy("project_id")
        .agg(F.sum("one").alias("total"))
    )
    header = F.when(F.col("total") == 0, F.array(F.lit(NO_FIXES), F.lit(""))).otherwise(
        F.array(
            F.lit("# scanloom Auto-Fix Patch"),
            F.concat(F.lit("# Generated: "), iso_instant(as_of)),
            F.concat(F.lit("# Total suggestions: "), F.col("total").cast("string")),
            F.lit(""),
        )
    )
    head = totals.select(
        "project_id", F.lit(0).cast("bigint").alias("n"), F.posexplode(header).alias("line_no", "text")
    ).withColumn("line_no", F.col("line_no").cast("bigint"))
    banner = F.array(
        F.lit(BAR),
        F.concat(
            F.lit("# Fix "),
            F.col("n").cast("string"),
            F.lit("/"),
            F.col("total").cast("string"),
            F.lit(": "),
            "rule_id",
        ),
        F.concat(F.lit("# File: "), "path"),
        F.concat(F.lit("# Description: "), "description"),
        F.concat(
            F.lit("# Auto-apply: "),
            F.when(F.col("can_auto_apply"), "YES").otherwise("NO - requires manual review"),
        ),
        F.lit(BAR),
        F.lit(""),
    )
    size = 7
    banners = suggested.join(totals, "project_id").select(
        "project_id", "n", F.posexplode(banner).alias("line_no", "text")
    )
    bodies = suggested.select("project_id", "n", "fix_ordinal", "path").join(
        lines, ["project_id", "fix_ordinal", "path"]
    )
    last = F.lit(1 << 60)
    gaps = suggested.select(
        "project_id",
        "n",
        F.explode(F.array(last, last + 1)).alias("line_no"),
        F.lit("").alias("text"),
    )
    return (
        head.unionByName(banners.withColumn("line_no", F.col("line_no").cast("bigint")))
        .unionByName(
            bodies.select("project_id", "n", (F.col("line_no") + size).alias("line_no"), "text")
        )
        .unionByName(gaps)
    )


def patched_content(lines: DataFrame) -> DataFrame:
    """New content from patch lines: what follows the two file headers and is added or kept."""
    return (
        lines.where(F.col("line_no") >= 2)
        .where(F.startswith("text", F.lit("+")) | F.startswith("text", F.lit(" ")))
        .select(
            "project_id",
            "fix_ordinal",
            "path",
            "line_no",
            F.substring("text", F.lit(2), F.length("text")).alias("text"),
        )
    )


def patch_text_content(patch: Column) -> Column:
    """The same for one patch held as text."""
    lines = F.split(patch, "\n", -1)
    first = F.array_position(F.transform(lines, lambda x: F.startswith(x, F.lit("@@"))), True)
    body = F.when(first > 0, F.slice(lines, first.cast("int"), F.size(lines)))
    kept = F.filter(
        body,
        lambda x: (F.startswith(x, F.lit("+")) | F.startswith(x, F.lit(" ")))
        & ~F.startswith(x, F.lit("@@")),
    )
    stripped = F.transform(kept, lambda x: F.substring(x, F.lit(2), F.length(x)))
    return F.coalesce(F.array_join(stripped, "\n"), F.lit(""))


def fixed_files(suggested: DataFrame, lines: DataFrame, root: Column | None = None) -> DataFrame:
    """Content lines of the files that may be written without review and stay inside the root."""
    root = F.lit("/project") if root is None else root
    wanted = suggested.where("can_auto_apply").where(paths.is_within(root, F.col("path")))
    return patched_content(lines).join(
        wanted.select("project_id", "fix_ordinal", "path"),
        ["project_id", "fix_ordinal", "path"],
        "left_semi",
    )


def fix_report(
    scores: DataFrame, suggested: DataFrame, bundle: DataFrame, as_of: Column, provider: str = "none"
) -> DataFrame:
    """The JSON fix report of each project as parts ordered by section, item and part.

    The patch is one JSON string in the report, spread over many parts, so the parts are to be
    concatenated without anything between them.
    """
    big = F.lit(0).cast("bigint")
    head = F.to_json(
        F.struct(
            iso_instant(as_of).alias("timestamp"),
            F.col("project_id").alias("path"),
            F.lit(provider).alias("provider"),
            F.struct("critical", "medium", "low").alias("summary"),
        )
    )
    start = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"patch":"'))
    frame = F.array(
        F.struct(F.lit(0).alias("section"), start.alias("text")),
        F.struct(F.lit(2).alias("section"), F.lit('","suggestions":[').alias("text")),
        F.struct(F.lit(4).alias("section"), F.lit("]}").alias("text")),
    )
    fixed = scores.select("project_id", F.explode(frame).alias("p")).select(
        "project_id", "p.section", big.alias("item"), big.alias("part"), "p.text"
    )
    quoted = F.to_json(F.array("text"))
    inner = F.substring(quoted, F.lit(3), F.length(quoted) - 4)
    first = (F.col("n") == 0) & (F.col("line_no") == 0)
    patch = bundle.select(
        "project_id",
        F.lit(1).alias("section"),
        F.col("n").alias("item"),
        F.col("line_no").alias("part"),
        F.concat(F.when(first, "").otherwise("\\n"), inner).alias("text"),
    )
    entry = F.to_json(
        F.struct(
            F.col("rule_id").alias("ruleId"),
            F.col("path").alias("filePath"),
            "description",
            F.col("can_auto_apply").alias("canAutoApply"),
        )
    )
    listed = suggested.select(
        "project_id",
        F.lit(3).alias("section"),
        F.col("n").alias("item"),
        big.alias("part"),
        F.concat(F.when(F.col("n") > 1, ",").otherwise(""), entry).alias("text"),
    )
    return fixed.unionByName(patch).unionByName(listed)


def targeted_suggestions(
    files: DataFrame, listing: DataFrame, rule_id: str, path: str | None = None
) -> DataFrame:
    """Suggestions that follow from one rule, on one file or on all it applies to.

    The rule is run on the files; projects without findings get no suggestions, the others get the
    whole set that these findings and their files lead to.
    """
    aimed = files if path is None else files.where(F.col("path") == path)
    found = analyze(aimed, [rule_id], listing)
    concerned = found.select("project_id").distinct()
    made = suggestions(files, listing, found)
    return made.join(concerned, "project_id", "left_semi")
