"""Line-based security rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom import rules
from codeloom.functions.arrays import unnest_structs
from codeloom.functions.text import any_of, contains_any, folded, found, lines, strip
from codeloom.operators import pyfacts
from codeloom.sources.corpus import analysed_files, by_language


def pattern_findings(files: DataFrame, *languages: str) -> DataFrame:
    """One finding per (line, rule) that matches.

    Most files and nearly all lines match nothing.  A file is therefore tested
    once as a whole, for the words of the rules and then with all rules joined
    into one expression (a match inside a line is a match inside the text), then
    its lines, and only the lines left are tested rule by rule.
    """

    wanted = languages or tuple(rules.SECURITY_RULES)
    any_rule = {n: any_of([r.pattern for r in rules.SECURITY_RULES[n]]) for n in wanted}
    text = F.col("text")

    def matching(language: str) -> Column:
        tests = [
            F.when(
                found(text, r.pattern),
                F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.issue).alias("issue")),
            )
            for r in rules.SECURITY_RULES[language]
        ]
        return F.array_compact(F.array(*tests))

    def suspect(column: str) -> Column:
        return by_language({n: F.col(column).rlike(any_rule[n]) for n in wanted})


    def holds_word(language: str) -> Column:
        words = {rules.SECURITY_NEEDLES[r.rule_id] for r in rules.SECURITY_RULES[language]}
        # Bound by a lambda: a filter is pushed down, and a column of its own
        # would be written out again for each word.
        low = F.array(folded(F.col("content")))
        return F.exists(low, lambda text: contains_any(text, tuple(sorted(words))))

    keys = ["repo_id", "path", "language"]
    suspects = (
        analysed_files(files, *wanted)
        .filter(by_language({n: holds_word(n) for n in wanted}))
        .filter(suspect("content"))
        .select(*keys, F.posexplode(lines(F.col("content"))).alias("at", "text"))
        .filter(suspect("text"))
    )
    at = [(F.col("at") + 1).cast("long").alias("line"), strip(text).alias("code")]
    hits = by_language({n: matching(n) for n in wanted})
    severity = F.lit(rules.SEVERITY).alias("severity")
    return unnest_structs(suspects, [*keys, *at], hits, "rule_id").select(
        *keys, "line", "rule_id", "issue", severity, "code"
    )


def findings(files: DataFrame, facts: DataFrame) -> DataFrame:
    """Findings of all five languages."""
    return pattern_findings(files).unionByName(pyfacts.dangerous_calls(facts))


def by_rule(found_rows: DataFrame) -> DataFrame:
    return found_rows.groupBy("language", "rule_id", "issue", "severity").agg(
        F.count("*").alias("findings"), F.countDistinct("repo_id").alias("repositories")
    )


def totals(found_rows: DataFrame) -> DataFrame:
    return found_rows.groupBy("repo_id", "language").agg(F.count("*").alias("total_issues"))
