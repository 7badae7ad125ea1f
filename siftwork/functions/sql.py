"""The library's functions for users of SQL. They are SQL functions, so Catalyst inlines them into the plan."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

from siftwork.operators.decision import CASCADE_KEYS, cascade_sql, small_methods


def _scores() -> str:
    return ", ".join(f"{k} double default 0.0D" for k in CASCADE_KEYS)


#: White space as Unicode has it, for a SQL string.
_SPACE = r"[\\t\\n\\x0B\\f\\r \\x{1C}-\\x{1F}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+"


def definitions() -> dict[str, str]:
    """Name -> what follows ``create or replace temporary function``."""
    key = re.compile(r"\b(" + "|".join(CASCADE_KEYS) + r")\b")
    parts = {p: key.sub(r"coalesce(\1, 0.0D)", cascade_sql(p)) for p in ("rule", "decision", "code")}
    score = "greatest(0.0D, coalesce(nanvl({0}, 0.0D), 0.0D))"
    return {
        "normalise_text": f"normalise_text(t string) returns string return lower(trim(regexp_replace(coalesce(t, ''), '{_SPACE}', ' ')))",
        "hash_distance": "hash_distance(a bigint, b bigint) returns int return bit_count(a ^ b)",
        "clean_score": f"clean_score(x double) returns double return {score.format('x')}",
        **{f"decide_{p}": f"decide_{p}({_scores()}) returns string return {sql}" for p, sql in parts.items()},
        "decide": (
            f"decide({_scores()}) returns struct<rule: string, decision: string, code: string> "
            f"return named_struct('rule', {parts['rule']}, 'decision', {parts['decision']}, 'code', {parts['code']})"
        ),
    }


def register_functions(spark: SparkSession) -> list[str]:
    """Define the functions in the session: ``select decide(adult_score => 0.9, ...)``, scores not named are 0.

    ``decide_rule``, ``decide_decision``, ``decide_code`` give one part of ``decide``; ``normalise_text``, ``hash_distance``, ``clean_score`` are the functions of the same
    meaning. Returns the names.
    """
    small_methods(spark)
    found = definitions()
    for definition in found.values():
        spark.sql(f"create or replace temporary function {definition}")
    return list(found)
