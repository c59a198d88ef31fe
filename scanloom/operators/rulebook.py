"""A rulebook is the ordered set of rules one scan applies; rule tables are checked and merged here."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from functools import cached_property
from itertools import accumulate

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from scanloom import schemas
from scanloom.functions.jsregex import java_regex, lower_texts, needs, translated
from scanloom.operators.catalog import BUILT_IN_RULES, Pattern, Rule
from scanloom.operators.numbering import number_rows
from scanloom.plans.storage import written

_FACTS = "struct<rule_id:string,severity:string,category:string,template:string>"
_RULE_ROW = (
    "struct<rule_ordinal:int,rule_id:string,name:string,description:string,category:string,"
    "severity:string,applicable_to:array<string>>"
)

_TABLE = (
    "load_order int, rule_id string, name string, description string, category string, severity string, "
    "applicable_to array<string>, patterns array<struct<regex:string,message:string,texts:array<string>,"
    "source:string,source_flags:string>>"
)

# Fixed value: longest pattern a custom rule may carry.
MAX_PATTERN_LENGTH = 500

# Up to so many custom rules become part of the plan; more are a table that lines are joined with.
PLANNED_RULES = 100

# Patterns that Spark is asked about at a time.
ASKED = 200


@dataclass(frozen=True)
class RuleTable:
    """Compiled rules that stay a table, in any number.

    Iterating reads them in load order, a part of the table at a time.
    """

    rows: DataFrame

    def __iter__(self) -> Iterator[Rule]:
        return map(_rule, self.rows.orderBy("load_order").toLocalIterator())

    def __len__(self) -> int:
        return self.rows.count()


@dataclass(frozen=True)
class Rulebook:
    """Rules in scan order. Every pattern has a code, its 1-based place over all rules.

    ``rules`` are part of the plan. ``custom`` are the rules after them that stay a table, as a
    ``RuleTable`` has them, and ``numbers`` their ``rule_id, rule_ordinal, first_code``.
    """

    rules: tuple[Rule, ...] = BUILT_IN_RULES
    custom: DataFrame | None = None
    numbers: DataFrame | None = None

    def only(self, rule_ids: Sequence[str] | Column | None) -> list[Rule]:
        """The named rules of the plan, or all of them when no name is given.

        Instead of names, a column tests the texts of the rules that ``table`` has.
        """
        if isinstance(rule_ids, Column):
            named = self._listed(SparkSession.active()).where(rule_ids).select("rule_id").collect()
            wanted = {r.rule_id for r in named}
            return [r for r in self.rules if r.rule_id in wanted]
        wanted = set(rule_ids or ())
        return [r for r in self.rules if not wanted or r.rule_id in wanted]

    def custom_only(self, rule_ids: Sequence[str] | Column | None) -> DataFrame | None:
        """The same of the rules that stay a table; None where there is no table."""
        if self.custom is None:
            return None
        if isinstance(rule_ids, Column):
            return self.custom.where(rule_ids)
        if not rule_ids:
            return self.custom
        names = F.from_json(F.lit(json.dumps(list(rule_ids))), "array<string>")
        named = self.custom.sparkSession.range(1).select(F.explode(names).alias("rule_id"))
        return self.custom.join(named, "rule_id", "left_semi")

    @cached_property
    def _first_codes(self) -> dict[str, int]:
        counts = [len(r.patterns) for r in self.rules]
        starts = accumulate(counts, initial=1)
        return {r.rule_id: code for r, code in zip(self.rules, starts, strict=False)}

    def first_code(self, rule: Rule) -> int:
        return self._first_codes[rule.rule_id]

    def with_custom(self, custom: Sequence[Rule] | RuleTable) -> Rulebook:
        """Custom rules after the built-in ones; clashing and repeated ids keep the first rule."""
        if isinstance(custom, RuleTable):
            return self._with_table(custom.rows)
        if self.custom is not None:
            return self._with_table(_rows(self.custom.sparkSession, custom))
        seen = {r.rule_id for r in self.rules}
        ordinal = max(r.ordinal for r in self.rules)
        extra = []
        for rule in custom:
            if rule.rule_id not in seen:
                seen.add(rule.rule_id)
                ordinal += 1
                extra.append(replace(rule, ordinal=ordinal))
        return Rulebook(self.rules + tuple(extra))

    def _with_table(self, rows: DataFrame) -> Rulebook:
        """The table is numbered where it lies: only counts come to the driver."""
        columns = ["load_order", "rule_id", "name", "description", "category", "severity"]
        columns += ["applicable_to", "patterns"]
        fresh = rows.select(*columns).where(~F.col("rule_id").isin([r.rule_id for r in self.rules]))
        ordinal, code = max(r.ordinal for r in self.rules), sum(len(r.patterns) for r in self.rules)
        if self.custom is not None:
            fresh = fresh.join(self.custom.select("rule_id"), "rule_id", "left_anti")
            patterns = self.custom.agg(F.count(F.lit(1)), F.sum(F.size("patterns"))).first()
            ordinal, code = ordinal + patterns[0], code + patterns[1]
        n, ids = fresh.agg(F.count(F.lit(1)), F.count_distinct("rule_id")).first()
        if ids < n:
            fresh = written(first_by_id(fresh), "rules")
        if self.custom is None and ids <= PLANNED_RULES:
            return self.with_custom(list(RuleTable(fresh)))
        order = ["load_order", "rule_id"]
        places = fresh.select(*order, F.explode(F.sequence(F.lit(1), F.size("patterns"))).alias("place"))
        ordinals = number_rows(fresh.select(*order), [], order, "n")
        codes = number_rows(places, [], [*order, "place"], "n").where(F.col("place") == 1)
        numbers = ordinals.select("rule_id", (F.col("n") + ordinal + 1).cast("int").alias("rule_ordinal")).join(
            codes.select("rule_id", (F.col("n") + code + 1).cast("int").alias("first_code")), "rule_id"
        )
        if self.custom is not None:
            fresh, numbers = self.custom.unionByName(fresh), self.numbers.unionByName(numbers)
        return Rulebook(self.rules, fresh, numbers)

    def describe(self, code: Column) -> Column:
        """The rule facts and message template behind a pattern code of the plan, as a struct."""
        facts = [
            {
                "rule_id": r.rule_id,
                "severity": r.severity,
                "category": r.category,
                "template": p.message,
            }
            for r in self.rules
            for p in r.patterns
        ]
        # A constant the optimizer folds; as JSON it is one value to pass, however many rules.
        constant = F.from_json(F.lit(json.dumps(facts)), f"array<{_FACTS}>")
        return F.element_at(constant, code)

    def described(self, hits: DataFrame) -> DataFrame:
        """Hits with ``facts``; those of rules that stay a table bring theirs."""
        facts = self.describe(F.col("code"))
        if self.custom is not None:
            facts = F.when(F.col("facts").isNull(), facts).otherwise(F.col("facts"))
        return hits.withColumn("facts", facts)

    def table(self, spark: SparkSession) -> DataFrame:
        """The rules as rows, for joins and listings."""
        listed = self._listed(spark)
        if self.custom is None:
            return listed
        return listed.unionByName(self.custom.join(self.numbers, "rule_id").select(*listed.columns))

    def _listed(self, spark: SparkSession) -> DataFrame:
        rows = [
            {
                "rule_ordinal": r.ordinal,
                "rule_id": r.rule_id,
                "name": r.name,
                "description": r.description,
                "category": r.category,
                "severity": r.severity,
                "applicable_to": r.applicable_to,
            }
            for r in self.rules
        ]
        constant = F.from_json(F.lit(json.dumps(rows)), f"array<{_RULE_ROW}>")
        return spark.range(1).select(F.inline(constant))


# --- rule tables ---------------------------------------------------------------------------------


def _judged(rules: DataFrame, max_length: int) -> DataFrame:
    """Rules with ``reason`` (null so far admitted) and ``judged``: each pattern, translated or with a reason."""
    shaped = rules.withColumn(
        "reason",
        F.when(
            F.col("rule_id").isNull()
            | F.col("name").isNull()
            | F.col("description").isNull()
            | F.col("category").isNull(),
            "missing text",
        )
        .when(
            F.col("severity").isNull() | ~F.col("severity").isin(*schemas.SEVERITIES),
            "unknown severity",
        )
        .when(
            F.col("applicable_to").isNull()
            | F.exists(F.coalesce("applicable_to", F.array()), F.isnull),
            "bad path patterns",
        )
        .when(F.coalesce(F.size("patterns"), F.lit(0)) <= 0, "no patterns"),
    )

    def shape(p: Column) -> Column:
        return (
            F.when(p.isNull() | p["regex"].isNull(), "no regex")
            .when(p["message"].isNull(), "no message")
            .when(F.length(p["regex"]) == 0, "empty regex")
            .when(F.length(p["regex"]) > max_length, f"longer than {max_length} characters")
        )

    patterns = F.coalesce("patterns", F.array().cast(rules.schema["patterns"].dataType))
    # What is refused by its shape is not read; an empty pattern stands for it.
    readable = F.transform(patterns, lambda p: F.when(shape(p).isNull(), p["regex"]).otherwise(""))
    flags = F.transform(patterns, lambda p: F.coalesce(p["flags"], F.lit("")))
    # Patterns are small and slow to read: a table of one file would keep one task busy.
    partitions = int(rules.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    read = shaped.repartition(partitions).withColumn("java", translated(readable, flags))
    judged = read.withColumn(
        "judged",
        F.zip_with(
            patterns,
            "java",
            lambda p, j: F.struct(
                F.when(shape(p).isNull(), j["regex"]).alias("regex"),
                F.lit("").alias("flags"),
                p["message"].alias("message"),
                p["regex"].alias("source"),
                F.coalesce(p["flags"], F.lit("")).alias("source_flags"),
                F.coalesce(shape(p), j["reason"]).alias("reason"),
                j["texts"].alias("texts"),
            ),
        ),
    )
    return judged.withColumn(
        "judged", F.transform("judged", lambda p, at: p.withField("place", (at + 1).cast("int")))
    )


def admit_rules(
    rules: DataFrame, max_length: int = MAX_PATTERN_LENGTH
) -> tuple[DataFrame, DataFrame]:
    """Split a table of custom rules (``schemas.RULES``) into admitted and rejected ones.

    A rule needs all its texts, a known severity, a list of path patterns without gaps and at least
    one usable pattern. A pattern is usable when it has 1 to ``max_length`` characters, a message, and
    is one in JavaScript that can be evaluated here; the others are dropped (``dropped_patterns`` has
    them), and a rule left without any is rejected. Patterns come out translated to the dialect Spark
    evaluates, beside their source and the texts of which a match holds one, in lower case.
    """
    compiled = _judged(rules, max_length).withColumn(
        "patterns",
        F.transform(
            F.filter("judged", lambda p: p["regex"].isNotNull()), lambda p: p.dropFields("reason")
        ),
    ).withColumn("reason", F.coalesce("reason", F.when(F.size("patterns") <= 0, "no usable pattern")))
    columns = ["load_order", "rule_id", "name", "description", "category", "severity"]
    columns += ["applicable_to", "patterns"]
    admitted = compiled.where(F.col("reason").isNull()).select(*columns)
    rejected = compiled.where(F.col("reason").isNotNull()).select("load_order", "rule_id", "reason")
    return admitted, rejected


def dropped_patterns(rules: DataFrame, max_length: int = MAX_PATTERN_LENGTH) -> DataFrame:
    """``load_order, rule_id, place, regex, flags, reason`` of every pattern that is not used, of admitted
    and rejected rules alike. ``place`` counts the patterns of a rule from 1.

    A pattern that was translated may still be refused by the engine, as it names a script that the
    engine does not know; ``refused_patterns`` asks it.
    """
    rows = _judged(rules, max_length).select("load_order", "rule_id", F.explode("judged").alias("p"))
    return rows.where(F.col("p.reason").isNotNull()).select(
        "load_order",
        "rule_id",
        "p.place",
        F.col("p.source").alias("regex"),
        F.col("p.source_flags").alias("flags"),
        F.col("p.reason").alias("reason"),
    )


def refused_patterns(admitted: DataFrame) -> DataFrame:
    """Patterns of admitted rules that the engine refuses to compile, in the shape of ``dropped_patterns``."""
    spark = admitted.sparkSession
    each = admitted.select("load_order", "rule_id", F.explode("patterns").alias("p"))
    regexes = [r[0] for r in each.select("p.regex").distinct().toLocalIterator()]
    bad = sorted(set(regexes) - compiling(spark, regexes))
    refused = spark.createDataFrame([(r,) for r in bad], "refused string")
    return each.join(refused, F.col("p.regex") == F.col("refused")).select(
        "load_order",
        "rule_id",
        "p.place",
        F.col("p.source").alias("regex"),
        F.col("p.source_flags").alias("flags"),
        F.lit("refused by the engine").alias("reason"),
    )


def first_by_id(rules: DataFrame, order: str = "load_order") -> DataFrame:
    """One rule per id, the first loaded.

    An aggregate rather than a window: copies of one id are combined before the shuffle, so an id
    that fills a large part of the table costs one row per task.
    """
    others = [c for c in rules.columns if c != "rule_id"]
    first = F.min_by(F.struct(*others), F.col(order)).alias("first")
    return rules.groupBy("rule_id").agg(first).select("rule_id", "first.*").select(*rules.columns)


def without_clashes(custom: DataFrame, built_in: DataFrame) -> DataFrame:
    """Custom rules whose id no built-in rule uses."""
    return custom.join(built_in.select("rule_id"), "rule_id", "left_anti")


def merge_rules(built_in: DataFrame, custom: DataFrame) -> DataFrame:
    """Built-in rules first, then custom rules in load order, without clashes or repeats."""
    columns = ["rule_id", "name", "description", "category", "severity", "applicable_to"]
    extra = first_by_id(without_clashes(custom, built_in))
    return built_in.select(
        F.lit("built-in").alias("source"), F.col("rule_ordinal").alias("load_order"), *columns
    ).unionByName(extra.select(F.lit("custom").alias("source"), "load_order", *columns))


def list_rules(rules: DataFrame, category: str | None = None) -> DataFrame:
    """The public facts of the rules, optionally of one category."""
    if category is not None:
        rules = rules.where(F.col("category") == category)
    return rules.select(
        F.col("rule_id").alias("id"),
        "name",
        "description",
        "severity",
        "category",
        F.col("applicable_to"),
    )


# --- from tables to expressions ------------------------------------------------------------------


def compiling(spark: SparkSession, regexes: Sequence[str]) -> set[str]:
    """The patterns Spark accepts, asked of Spark itself; halves are asked apart only on failure."""
    unique = sorted(set(regexes))
    good: set[str] = set()
    todo = [unique[k : k + ASKED] for k in range(0, len(unique), ASKED)]
    while todo:
        some = todo.pop()
        try:
            spark.range(1).select(F.array(*[F.rlike(F.lit("x"), F.lit(r)) for r in some])).collect()
            good.update(some)
        except PySparkException:
            half = len(some) // 2
            todo += [part for part in (some[:half], some[half:]) if half]
    return good


def _compiled(rules: DataFrame) -> DataFrame:
    """Admitted rules with the patterns the engine accepts, asked of it in the tasks."""
    if "texts" not in rules.schema["patterns"].dataType.elementType.fieldNames():
        sources, flags = (F.transform("patterns", lambda p, f=f: p[f]) for f in ("source", "source_flags"))
        rules = rules.withColumn("java", translated(sources, flags)).withColumn(
            "patterns", F.zip_with("patterns", "java", lambda p, j: p.withField("texts", j["texts"]))
        )

    def accepted(p: Column) -> Column:
        return F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), p["regex"]).isNotNull()

    def slim(p: Column) -> Column:
        return F.struct(*[p[f].alias(f) for f in ("regex", "message", "texts", "source", "source_flags")])

    columns = ["load_order", "rule_id", "name", "description", "category", "severity", "applicable_to"]
    patterns = F.transform(F.filter("patterns", accepted), slim).alias("patterns")
    return rules.select(*columns, patterns).where(F.size("patterns") > 0)


def _rule(row: Row) -> Rule:
    return Rule(
        0,
        row["rule_id"],
        row["name"],
        row["description"],
        row["category"],
        row["severity"],
        tuple(row["applicable_to"]),
        tuple(Pattern(p["regex"], p["message"], *needs(p["source"], p["source_flags"])) for p in row["patterns"]),
    )


def _rows(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """Rules written in code as a ``RuleTable`` has them, without the sources of their patterns."""
    rows = [
        (
            *(k, r.rule_id, r.name, r.description, r.category, r.severity, list(r.applicable_to)),
            [(p.regex, p.message, lower_texts(p.needs, p.needs_folded), None, None) for p in r.patterns],
        )
        for k, r in enumerate(rules)
    ]
    return spark.createDataFrame(rows, _TABLE)


def compile_rules(rules: DataFrame) -> list[Rule] | RuleTable:
    """Admitted rules as scan rules, in load order.

    Up to ``PLANNED_RULES`` are read to the driver and become part of the plan; more stay a table that is
    never read to one place, see ``ruletable``. Patterns the engine refuses are left out;
    ``refused_patterns`` lists them.
    """
    compiled = written(_compiled(rules), "rules")
    first = compiled.orderBy("load_order").limit(PLANNED_RULES + 1).collect()
    if len(first) > PLANNED_RULES:
        return RuleTable(compiled)
    return [_rule(row) for row in first]


def custom_rule(
    rule_id: str,
    name: str,
    description: str,
    category: str,
    severity: str,
    applicable_to: Sequence[str],
    patterns: Sequence[tuple[str, str, str]],
) -> Rule:
    """A scan rule written in code; patterns are (regex, flags, message) in JavaScript's dialect."""
    translated = [
        (java_regex(regex, flags), message, *needs(regex, flags))
        for regex, flags, message in patterns
    ]
    return Rule(
        0,
        rule_id,
        name,
        description,
        category,
        severity,
        tuple(applicable_to),
        tuple(Pattern(*p) for p in translated if p[0] is not None),
    )
