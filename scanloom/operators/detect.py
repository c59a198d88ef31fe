"""Detection: one pass over the files, every rule at once.

A file row is cut into lines; each line that could match anything goes through the ordered patterns
of the line rules. Whole-file rules (manifests, Dockerfiles, logging) are evaluated on the file row
and leave with its first line. Content is read once however many rules there are, and nothing is
shuffled: what comes out is one narrow row per hit.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.functions import paths, text
from scanloom.operators import catalog
from scanloom.operators.catalog import Pattern, Rule
from scanloom.operators.rulebook import PLANNED_RULES, Rulebook
from scanloom.operators.ruletable import joined_hits, table_hits

HITS = (
    "project_id string, path string, rule_ordinal int, ord int, sub int, line int, code int, "
    "detail string"
)
_HIT = "struct<rule_ordinal:int,ord:int,sub:int,line:int,code:int,detail:string>"

_LINE_RULES = {
    r.rule_id
    for r in (
        catalog.CORS,
        catalog.ERROR_LEAK,
        catalog.SECRETS,
        catalog.SQL,
        catalog.WEAK_CRYPTO,
        catalog.XSS,
    )
}
_NOT_IN_COMMENT_LINES = {r.rule_id for r in (catalog.ERROR_LEAK, catalog.SQL, catalog.XSS)}
_ON_RAW_LINES = {catalog.SECRETS.rule_id}
_FILE_RULES = {r.rule_id for r in (catalog.DOCKER, catalog.DEPENDENCY, catalog.CONSOLE)}
_BUILT_IN = {r.rule_id for r in catalog.BUILT_IN_RULES}
# Custom patterns tested one by one before they are joined into an alternation.
SEPARATE_PATTERNS = 8
_RANDOM = "Math.random"
_CONSOLE = "console.log"


def _any(tests: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


def _hit(ordinal: int, ord: Column, sub: Column, line: Column, code: Column, detail: Column):
    return F.struct(
        F.lit(ordinal).alias("rule_ordinal"),
        ord.cast("int").alias("ord"),
        sub.cast("int").alias("sub"),
        line.cast("int").alias("line"),
        code.cast("int").alias("code"),
        detail.cast("string").alias("detail"),
    )


def _no_hits() -> Column:
    return F.array().cast(f"array<{_HIT}>")


# --- whole-file rules ----------------------------------------------------------------------------


def _console_hits(book: Rulebook) -> Column:
    """One hit at the first logging line of a file with more than the allowed number of them."""
    rule = catalog.CONSOLE

    def logging_line(line: Column, i: Column) -> Column:
        code = F.when(F.col("bare_lines").isNotNull(), line).otherwise(
            text.strip_line_comment(line)
        )
        logs = F.contains(line, F.lit(_CONSOLE)) & F.contains(code, F.lit(_CONSOLE))
        return F.when(logs, i + 1)

    numbers = F.array_compact(F.transform("code_lines", logging_line))
    hits = F.transform(
        F.filter(F.array(numbers), lambda n: F.size(n) > catalog.CONSOLE_LOG_LIMIT),
        lambda n: _hit(
            rule.ordinal,
            F.element_at(n, 1),
            F.lit(0),
            F.element_at(n, 1),
            F.lit(book.first_code(rule)),
            F.size(n),
        ),
    )
    possible = F.contains("content", F.lit(_CONSOLE)) | F.col("bare_lines").isNotNull()
    return F.when(possible, hits).otherwise(_no_hits())


def _docker_hits(book: Rulebook) -> Column:
    """A hit for each sensitive port number named on an EXPOSE line."""
    rule = catalog.DOCKER
    first = book.first_code(rule)
    services = F.create_map(
        *[
            F.lit(v)
            for k, (port, _) in enumerate(catalog.SENSITIVE_PORTS)
            for v in (port, first + k)
        ]
    )

    def ports(line: Column, i: Column) -> Column:
        named = F.regexp_extract(line, catalog.EXPOSE_LINE, 1)
        numbers = F.regexp_extract_all(named, F.lit("[0-9]+"), F.lit(0))
        return F.transform(
            numbers,
            lambda n, k: _hit(
                rule.ordinal,
                i + 1,
                k,
                i + 1,
                F.try_element_at(services, n.try_cast("int")),
                F.lit(None),
            ),
        )

    return F.filter(
        F.flatten(F.transform("lines", ports)), lambda h: h["code"].isNotNull()
    )


def _manifest_keys() -> Column:
    """Names under dependencies and devDependencies; none when the text is not one JSON object.

    The text is read inside brackets, so anything after the object is an error, as it is in strict
    JSON. Either entry counts only when it is itself an object.
    """
    content = F.col("content")
    parsed = F.from_json(
        F.concat(F.lit("["), content, F.lit("]")),
        "array<struct<dependencies:string,devDependencies:string>>",
        {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"},
    )
    is_object = F.rlike(content, F.lit(f"^{text.WS}*+\\{{")) & F.rlike(
        content, F.lit(f"\\}}{text.WS}*$")
    )
    none = F.array().cast("array<string>")

    def keys(objects: Column, field: str) -> Column:
        return F.coalesce(F.json_object_keys(F.element_at(objects, 1)[field]), none)

    # Bound to a lambda, the text is parsed once for all that is asked of it.
    one = F.filter(F.array(F.when(is_object, parsed)), lambda objects: F.size(objects) == 1)
    return F.flatten(
        F.transform(
            one,
            lambda objects: F.array_union(
                keys(objects, "dependencies"), keys(objects, "devDependencies")
            ),
        )
    )


def _manifest_hits(book: Rulebook) -> Column:
    """A hit per listed package, at the last line that starts its first key with that name."""
    rule = catalog.DEPENDENCY
    first = book.first_code(rule)
    listed = F.array(*[F.lit(name) for name, _ in catalog.DANGEROUS_PACKAGES])

    def last_line(name: Column) -> Column:
        key = F.concat(F.lit('"'), name, F.lit('"'))
        at = F.transform(
            "lines",
            lambda line, i: F.when(
                F.contains(line, key)
                & (F.regexp_extract(line, f'"([^"]+)"{text.WS}*:', 1) == name),
                i + 1,
            ),
        )
        return F.array_max(at)

    # The intersection keeps the order of the list and looks at the keys once.
    return F.transform(
        F.array_intersect(listed, F.col("manifest_keys")),
        lambda name: _hit(
            rule.ordinal,
            F.lit(0),
            F.array_position(listed, name) - 1,
            last_line(name),
            F.array_position(listed, name) + (first - 1),
            F.lit(None),
        ),
    )


# --- line rules ----------------------------------------------------------------------------------


def _first_match(target: str, rule: Rule, book: Rulebook) -> Column:
    """Code of the first pattern that matches; patterns are tried in order."""
    first = book.first_code(rule)
    # Neighbouring patterns with the same needs are behind one test of those needs.
    groups = []
    for (needs, folded), members in itertools.groupby(
        enumerate(rule.patterns), lambda kp: (kp[1].needs, kp[1].needs_folded)
    ):
        arms = [F.when(F.rlike(target, F.lit(p.regex)), F.lit(first + k)) for k, p in members]
        found = F.coalesce(*arms)
        if folded:
            found = F.when(text.any_contains(f"lower({target})", folded), found)
        groups.append(F.when(text.any_contains(target, needs), found) if needs else found)
    return F.coalesce(*groups)


def _custom_possible(patterns: Sequence[Pattern]) -> Column:
    """Necessary condition for custom patterns: the text they need, or else the pattern itself.

    Many patterns without such a text are tried as one alternation, those with numbered groups
    apart.
    """
    needs = sorted({n for p in patterns for n in p.needs})
    folded = sorted({n for p in patterns for n in p.needs_folded})
    tests = [text.any_contains("raw", needs)] if needs else []
    if folded:
        tests.append(text.any_contains("lower(raw)", folded))
    bare = [p.regex for p in patterns if not p.needs and not p.needs_folded]
    numbered = [p for p in bare if re.search(r"\\[1-9k]", p)]
    joined = [p for p in bare if p not in numbered]
    if len(joined) > SEPARATE_PATTERNS:
        joined = ["|".join(f"(?:{p})" for p in joined)]
    tests += [F.rlike("raw", F.lit(p)) for p in numbered + joined]
    return _any(tests)


def _possible(rule: Rule) -> Column:
    """Cheap necessary condition for a line to match a rule."""
    if rule.rule_id == catalog.WEAK_CRYPTO.rule_id:
        other = [p.needs[0] for p in rule.patterns[:2]]
        return F.coalesce("near", F.lit(False)) | text.any_contains("code", other)
    line = "raw" if rule.rule_id in _ON_RAW_LINES else "code"
    plain = sorted({n for p in rule.patterns if not p.needs_folded for n in p.needs})
    tests = [text.any_contains(line, plain)] if plain else []
    for p in rule.patterns:
        if p.needs_folded:
            folded = text.any_contains(f"lower({line})", p.needs_folded)
            tests.append(text.any_contains(line, p.needs) & folded)
    return _any(tests)


def _line_codes(rule: Rule, book: Rulebook) -> list[Column]:
    """What a line gets from one rule: one code or null; weak crypto tests three times."""
    if rule.rule_id not in _BUILT_IN or rule.rule_id in _ON_RAW_LINES:
        return [_first_match("raw", rule, book)]
    if rule.rule_id in _NOT_IN_COMMENT_LINES:
        return [F.when(~F.col("is_comment"), _first_match("stripped", rule, book))]
    if rule.rule_id == catalog.WEAK_CRYPTO.rule_id:
        active = ~F.rlike("stripped", F.lit(f"^{text.WS}*+\\*"))
        tests = [F.rlike("stripped", F.lit(p.regex)) for p in rule.patterns]
        tests[2] = F.coalesce("near", F.lit(False)) & tests[2]
        first = book.first_code(rule)
        return [F.when(t & active, F.lit(first + k)) for k, t in enumerate(tests)]
    return [_first_match("stripped", rule, book)]


def _matched(rule: Rule, code: Column, book: Rulebook) -> Column:
    """The text a custom pattern matched."""
    first = book.first_code(rule)
    arms = [
        F.when(code == first + k, F.regexp_extract("raw", p.regex, 0))
        for k, p in enumerate(rule.patterns)
    ]
    return F.coalesce(*arms)


def _near_keyword() -> Column:
    """For each line that may call the weak generator: is a security word within three lines?

    Only such lines look at their neighbours, so the cost is that of one byte search per line.
    """

    def test(line: Column, i: Column) -> Column:
        start = F.greatest(i - catalog.KEYWORD_REACH, F.lit(0))
        window = F.slice("lines", start + 1, i - start + catalog.KEYWORD_REACH + 1)
        return F.contains(line, F.lit(_RANDOM)) & F.exists(
            window, lambda w: text.any_contains(F.lower(w), catalog.SECURITY_KEYWORDS)
        )

    return F.transform("code_lines", test)


def _flag(rule: Rule) -> str:
    return f"applies_{rule.ordinal}"


def _worth_splitting(rules: Sequence[Rule]) -> Column:
    """Files that may hold a hit at all; the others are dropped before they are cut into lines.

    A text some pattern needs must occur in the content. Where comments are stripped first, a block
    comment may stand in the middle of that text, so any block comment keeps the file.
    """
    words: dict[tuple[str, ...], set[str]] = {}
    folded: dict[tuple[str, ...], list[Column]] = {}
    always: set[tuple[str, ...]] = set()
    for r in rules:
        reach = r.applicable_to
        words.setdefault(reach, set())
        if r.rule_id == catalog.CONSOLE.rule_id:
            words[reach] |= {_CONSOLE, "/*"}
        elif r.rule_id in _FILE_RULES:
            always.add(reach)
        elif r.rule_id in _LINE_RULES - _ON_RAW_LINES:
            words[reach].add("/*")
        for p in r.patterns if r.rule_id not in _FILE_RULES else ():
            if p.needs_folded:
                test = text.any_contains("lower(content)", p.needs_folded)
                if p.needs:
                    test = text.any_contains("content", p.needs) & test
                folded.setdefault(reach, []).append(test)
            elif p.needs:
                words[reach] |= set(p.needs)
            else:
                always.add(reach)
    tests = []
    for reach, own in words.items():
        covered = paths.applies_to(F.col("path"), reach)
        if reach not in always:
            found = [text.any_contains("content", sorted(own))] if own else []
            covered = covered & _any(found + folded.get(reach, []))
        tests.append(covered)
    return _any(tests)


def line_and_file_hits(files: DataFrame, rules: Sequence[Rule], book: Rulebook) -> DataFrame:
    """Hits of the given rules over ``files(project_id, path, content)``."""
    ids = {r.rule_id for r in rules}
    line_rules = [r for r in rules if r.rule_id in _LINE_RULES or r.rule_id not in _BUILT_IN]
    needs_code = bool(ids & ((_LINE_RULES - _ON_RAW_LINES) | {catalog.CONSOLE.rule_id}))
    path, content = F.col("path"), F.col("content")

    # Rules with the same reach share one flag, named after the first of them.
    flags: dict[tuple[str, ...], str] = {}
    for r in rules:
        flags.setdefault(r.applicable_to, _flag(r))

    def applies(rule: Rule) -> Column:
        return F.col(flags[rule.applicable_to])

    script = paths.applies_to(path, catalog.XSS.applicable_to)
    blocky = script & text.has_block_comment(content) if needs_code else F.lit(False)
    base = files.where(_worth_splitting(rules)).select(
        "project_id",
        "path",
        "content",
        *[paths.applies_to(path, reach).alias(name) for reach, name in flags.items()],
        text.split_lines(content).alias("lines"),
        F.when(blocky, text.split_lines(text.strip_comments(content))).alias("bare_lines"),
        *(
            [F.when(applies_manifest(path), _manifest_keys()).alias("manifest_keys")]
            if catalog.DEPENDENCY.rule_id in ids
            else []
        ),
    )
    base = base.withColumn("code_lines", F.coalesce("bare_lines", "lines"))

    file_hits = _no_hits()
    for rule, hits in (
        (catalog.CONSOLE, _console_hits),
        (catalog.DOCKER, _docker_hits),
        (catalog.DEPENDENCY, _manifest_hits),
    ):
        if rule.rule_id in ids:
            file_hits = F.when(applies(rule), hits(book)).otherwise(file_hits)

    near = F.lit(None)
    if catalog.WEAK_CRYPTO.rule_id in ids:
        near = F.when(
            applies(catalog.WEAK_CRYPTO)
            & (F.contains(content, F.lit(_RANDOM)) | F.col("bare_lines").isNotNull()),
            _near_keyword(),
        )
    strings, booleans = "array<string>", "array<boolean>"
    # Files that only whole-file rules apply to need one row, not one per line.
    by_line = _any([F.col(n) for n in dict.fromkeys(flags[r.applicable_to] for r in line_rules)])
    raw_lines = F.when(by_line, F.col("lines")).otherwise(F.slice("lines", 1, 1))
    units = base.select(
        "project_id",
        "path",
        *flags.values(),
        file_hits.alias("file_hits"),
        F.arrays_zip(
            raw_lines.alias("raw"),
            F.coalesce(F.when(by_line, F.col("bare_lines")), F.array().cast(strings)).alias("bare"),
            F.coalesce(near.cast(booleans), F.array().cast(booleans)).alias("near"),
        ).alias("units"),
    )
    # The outer form keeps the optimizer from adding a non-empty test on the array, which it would
    # evaluate a second time below the projection. A text always has at least one line.
    lines = units.select(
        "project_id", "path", *flags.values(), "file_hits", F.posexplode_outer("units")
    ).select(
        "project_id",
        "path",
        *flags.values(),
        F.when(F.col("pos") == 0, F.col("file_hits")).otherwise(_no_hits()).alias("file_hits"),
        (F.col("pos") + 1).alias("line"),
        F.col("col.raw").alias("raw"),
        F.col("col.bare").alias("bare"),
        F.col("col.near").alias("near"),
        F.coalesce("col.bare", "col.raw").alias("code"),
    )
    possible = [applies(r) & _possible(r) for r in line_rules if r.rule_id in _BUILT_IN]
    for reach, name in flags.items():
        own = [
            p
            for r in line_rules
            if r.rule_id not in _BUILT_IN and r.applicable_to == reach
            for p in r.patterns
        ]
        if own:
            possible.append(F.col(name) & _custom_possible(own))
    candidates = lines.where((F.size("file_hits") > 0) | _any(possible)).select(
        "project_id",
        "path",
        *flags.values(),
        "file_hits",
        "line",
        "raw",
        "near",
        F.coalesce("bare", text.strip_line_comment(F.col("raw"))).alias("stripped"),
        text.is_comment_line(F.col("raw")).alias("is_comment"),
    )
    # The array function on file_hits keeps this projection out of whole-stage code generation:
    # some fifty patterns in one generated method would be too long for the JVM to compile, while
    # a projection on its own is split into many. Only candidate lines get here.
    codes, shapes = [], []
    for r in line_rules:
        for k, code in enumerate(_line_codes(r, book)):
            name, detail = f"code_{r.ordinal}_{k}", "CAST(NULL AS STRING)"
            codes.append(F.when(applies(r), code).alias(name))
            if r.rule_id not in _BUILT_IN:
                detail = f"detail_{r.ordinal}"
                codes.append(F.when(applies(r), _matched(r, code, book)).alias(detail))
            shapes.append(
                f"CASE WHEN {name} IS NOT NULL THEN named_struct('rule_ordinal', {r.ordinal}, "
                f"'ord', line, 'sub', 0, 'line', line, 'code', {name}, 'detail', {detail}) END"
            )
    coded = candidates.select(
        "project_id", "path", "line", *codes, F.array_compact("file_hits").alias("own")
    )
    hits = F.expr(f"concat(array({', '.join(shapes)}), own)") if shapes else F.col("own")
    return (
        coded.select("project_id", "path", hits.alias("hits"))
        .select("project_id", "path", F.explode_outer("hits").alias("hit"))
        .where(F.col("hit").isNotNull())
        .select("project_id", "path", "hit.*")
    )


def applies_manifest(path: Column) -> Column:
    return paths.applies_to(path, catalog.DEPENDENCY.applicable_to)


def env_hits(files: DataFrame, listing: DataFrame, book: Rulebook) -> DataFrame:
    """Environment files with no ``.env.example`` beside them. Reads paths, never content.

    ``listing(project_id, path)`` names every file of the projects, also those a scan skips.
    """
    rule = catalog.ENV
    examples = listing.where(paths.basename(F.col("path")) == ".env.example").select(
        "project_id", paths.dirname(F.col("path")).alias("dir")
    )
    return (
        files.where(paths.applies_to(F.col("path"), rule.applicable_to))
        .select("project_id", "path", paths.dirname(F.col("path")).alias("dir"))
        .join(examples, ["project_id", "dir"], "left_anti")
        .select(
            "project_id",
            "path",
            F.lit(rule.ordinal).alias("rule_ordinal"),
            F.lit(0).alias("ord"),
            F.lit(0).alias("sub"),
            F.lit(None).cast("int").alias("line"),
            F.lit(book.first_code(rule)).alias("code"),
            F.lit(None).cast("string").alias("detail"),
        )
    )


def detect(
    files: DataFrame,
    listing: DataFrame | None = None,
    book: Rulebook | None = None,
    rule_ids: Sequence[str] | Column | None = None,
) -> DataFrame:
    """All hits of a rulebook, or of some of its rules, over the files.

    Where custom rules stay a table, hits have a column more: ``facts``, filled in for these rules.
    """
    book = book or Rulebook()
    rules = book.only(rule_ids)
    parts = []
    in_content = [r for r in rules if r.rule_id != catalog.ENV.rule_id]
    built_in = [r for r in in_content if r.rule_id in _BUILT_IN]
    custom = [r for r in in_content if r.rule_id not in _BUILT_IN]
    planned = built_in + (custom if len(custom) <= PLANNED_RULES else [])
    if planned:
        parts.append(line_and_file_hits(files, planned, book))
    if len(custom) > PLANNED_RULES:
        parts.append(table_hits(files, custom, book))
    if any(r.rule_id == catalog.ENV.rule_id for r in rules):
        parts.append(env_hits(files, listing if listing is not None else files, book))
    table = book.custom_only(rule_ids)
    if table is not None:
        parts.append(joined_hits(files, table, book.numbers))
    if not parts:
        return files.sparkSession.createDataFrame([], HITS)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=table is not None), parts)
