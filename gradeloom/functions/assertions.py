"""Assertions on outputs, their scores and the verdict on a case, as column expressions.

An outcome is a struct: score (0 to 1), passed, unevaluable. Assertions that can't be judged neither pass nor count as
judged; negation leaves them alone."""

from __future__ import annotations

import re

from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from gradeloom.functions import scalars
from gradeloom.functions import statistics as st


def outcome(passed: Column, score: Column | None = None) -> Column:
    passed = F.coalesce(passed, F.lit(False))
    own = passed.cast("double") if score is None else score.cast("double")
    return F.struct(own.alias("score"), passed.alias("passed"), F.lit(False).alias("unevaluable"))


def unevaluable() -> Column:
    return F.struct(F.lit(0.0).alias("score"), F.lit(False).alias("passed"), F.lit(True).alias("unevaluable"))


def contains(text: Column, value: str) -> Column:
    return outcome(F.contains(text, F.lit(value)))


def icontains_any(text: Column, *values: str) -> Column:
    found = F.lit(False)
    for v in values:
        found = found | F.contains(F.lower(text), F.lit(v.lower()))
    return outcome(found)


def equals(text: Column, value: str) -> Column:
    """A text equals a text. JSON values are compared by json_checks.equals_json."""
    return outcome(text == value)


def starts_with(text: Column, value: str) -> Column:
    return outcome(text.startswith(value))


def java_pattern(pattern: str) -> str | None:
    """The pattern as java.util.regex reads it, with Unicode classes; null if it can't be judged: look-around, back references,
    atomic groups, or no pattern at all."""
    # Escapes but references and whole character classes say nothing about look-around.
    bare = re.sub(r"\\[^1-9k]|\[\^?\]?(?:\\.|[^\]\\])*\]", "", pattern, flags=re.DOTALL)
    if re.search(r"\(\?(=|!|<=|<!|>)|\\[1-9]|\\k<", bare):
        return None
    own = "(?U)" + re.sub(r"(?<!\\)((?:\\\\)*)\(\?P<", r"\1(?<", pattern)
    session = SparkSession.getActiveSession()
    try:
        session._jvm.java.util.regex.Pattern.compile(own)
    except (Py4JJavaError, IllegalArgumentException):
        return None
    return own


def matches(text: Column, pattern: str) -> Column:
    """Search for a pattern. Patterns that can't be judged are unevaluable."""
    own = java_pattern(pattern)
    return unevaluable() if own is None else outcome(text.rlike(own))


def length_between(text: Column, least: int | None = None, most: int | None = None) -> Column:
    """Code points, bounds included."""
    n = F.char_length(text)
    return outcome((n >= least if least is not None else F.lit(True)) & (n <= most if most is not None else F.lit(True)))


def at_most(measured: Column, most: float) -> Column:
    """Budgets of cost and tokens: what wasn't reported passes."""
    return outcome(F.coalesce(measured <= most, F.lit(True)))


def similar(a: Column, b: Column, threshold: float = 0.8) -> Column:
    cosine = st.cosine(a, b)
    return outcome(cosine >= threshold, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (cosine + 1) / 2)))


def total_tokens(usage: dict[str, Column], billable: bool = False) -> Column:
    """Input and output tokens, with billable also cache reads and writes; null if neither input nor output is reported."""
    zero = F.lit(0)
    parts = ("input", "output", "cache_read", "cache_write") if billable else ("input", "output")
    there = usage["input"].isNotNull() | usage["output"].isNotNull()
    out = F.lit(0)
    for p in parts:
        out = out + F.coalesce(usage.get(p, zero), zero)
    return F.when(there, out)


def checked(verdict: Column, score: Column | None = None) -> Column:
    """The answer of a checker (pass, and a score or 1 and 0); unevaluable where it gave none."""
    own = F.coalesce(score.cast("double"), verdict.cast("double")) if score is not None else verdict.cast("double")
    return F.when(verdict.isNull(), unevaluable()).otherwise(outcome(verdict, own))


def rubric(passed: Column, score: Column, threshold: float | None = None) -> Column:
    """A recorded judge's verdict: by its score if there is a threshold, else by what it said; unevaluable without one."""
    there = passed if threshold is None else score
    verdict = passed if threshold is None else score >= threshold
    return F.when(there.isNull(), unevaluable()).otherwise(outcome(verdict, F.coalesce(score.cast("double"), passed.cast("double"))))


def called(calls: Column, name: str) -> Column:
    """Whether a tool of that name was called (calls: array of name and arguments)."""
    return outcome(F.exists(calls, lambda c: c["name"] == name))


def negated(result: Column, text: Column, has_tool_calls: Column | None = None, budget: bool = False, is_json: Column | None = None, reason: Column | None = None) -> Column:
    """The reverse of an outcome. An output without content doesn't pass it, unless tools were called or a budget was
    judged. reason: why the output is empty; where it is given and null, the output isn't taken for empty."""
    calls = F.lit(False) if has_tool_calls is None else has_tool_calls
    vacuous = F.lit(False) if budget else scalars.is_blank(text, is_json) & ~calls
    vacuous = vacuous if reason is None else vacuous & reason.isNotNull()
    passed = ~result["passed"] & ~vacuous
    score = F.when(vacuous & ~result["passed"], F.lit(0.0)).otherwise(1 - result["score"])
    turned = F.struct(score.alias("score"), passed.alias("passed"), F.lit(False).alias("unevaluable"))
    return F.when(result["unevaluable"], result).otherwise(turned)


def can_change(done: list[tuple[Column, float]], remaining_weight: float, threshold: float | None = None) -> Column:
    """Whether assertions of that weight, not judged yet, can still change a case's verdict."""
    if remaining_weight <= 0:
        return F.lit(False)
    if threshold is None:
        passed = F.lit(True)
        for o, _ in done:
            passed = passed & o["passed"]
        return passed
    summed, total = F.lit(0.0), remaining_weight + sum(w for _, w in done)
    for o, w in done:
        summed = summed + o["score"] * w
    return ((summed + remaining_weight) / total >= threshold) & (summed / total < threshold)


def error_message(results: Column) -> Column:
    """What a case reports of its assertions (array of kind, status, reason) that couldn't be judged: the first, and how many
    more; null without any."""
    broken = F.filter(results, lambda a: a["status"] == "error")
    first, more = F.get(broken, F.lit(0)), F.size(broken) - 1
    why = F.trim(F.coalesce(first["reason"], F.lit("")))
    text = F.concat(first["kind"], F.lit(" assertion errored"), F.when(why != "", F.concat(F.lit(": "), why)).otherwise(""))
    return F.when(F.size(broken) > 0, F.when(more > 0, F.concat(text, F.format_string(" (and %d more errored)", more))).otherwise(text))


def desugared(assertion: dict) -> dict:
    """not-<kind> spelled as a kind that is negated."""
    kind = assertion.get("type", "")
    return {**assertion, "type": kind[4:], "negate": not assertion.get("negate", False)} if kind.startswith("not-") else assertion


def weighted_mean(outcomes: list[tuple[Column, float]]) -> Column:
    """Mean score by weight; 1 where all weights are 0."""
    total = sum(w for _, w in outcomes)
    if total <= 0:
        return F.lit(1.0)
    summed = F.lit(0.0)
    for o, w in outcomes:
        summed = summed + o["score"] * w
    return summed / total


def verdict(outcomes: list[tuple[Column, float]], threshold: float | None = None) -> Column:
    """Whether a case passes: by its score if there is a threshold, else if all its assertions pass."""
    if threshold is not None:
        return weighted_mean(outcomes) >= threshold
    passed = F.lit(True)
    for o, _ in outcomes:
        passed = passed & o["passed"]
    return passed


def case_status(outcomes: list[tuple[Column, float]], *, threshold: float | None = None, expect_fail: Column | None = None, reason: Column | None = None, skip_on: tuple[str, ...] = ()) -> Column:
    """error if an assertion can't be judged; skip for the empty reasons to skip; else pass or fail, which an expected
    failure turns into xpass or xfail."""
    broken = F.lit(False)
    for o, _ in outcomes:
        broken = broken | o["unevaluable"]
    skipped = F.coalesce(reason.isin(*skip_on), F.lit(False)) if reason is not None and skip_on else F.lit(False)
    passed, expected = verdict(outcomes, threshold), F.lit(False) if expect_fail is None else F.coalesce(expect_fail, F.lit(False))
    graded = F.when(passed & expected, "xpass").when(passed, "pass").when(expected, "xfail").otherwise("fail")
    return F.when(broken, "error").when(skipped, "skip").otherwise(graded)
