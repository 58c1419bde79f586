"""Scalar functions on texts, reasons, money and globs, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Finish reasons and the empty reason that each stands for.
STOP_REASONS = {
    "max_tokens": "truncated",
    "length": "truncated",
    "content_length": "truncated",
    "refusal": "refusal",
    "content_filter": "content_filter",
    "safety": "content_filter",
    "tool_use": "tool_use_only",
    "tool_calls": "tool_use_only",
    "function_call": "tool_use_only",
}
#: Sort rank of a status, worst highest.
STATUS_RANK = {"skip": 0, "xfail": 1, "pass": 2, "error": 3, "xpass": 4, "fail": 5}


def slugify(s: Column) -> Column:
    """Runs of ASCII letters and digits in lower case, joined by single dashes."""
    return F.lower(F.btrim(F.regexp_replace(s, "[^A-Za-z0-9]+", "-"), F.lit("-")))


def truncated(s: Column, n: int) -> Column:
    """The first n code points."""
    return F.substring(s, 1, n)


def micro_usd(usd: Column) -> Column:
    return F.round(usd * 1_000_000).cast("long")


def is_blank(text: Column, is_json: Column | None = None) -> Column:
    """True for texts of white space alone and null texts; of JSON outputs also for null, [], {} and blank strings."""
    bare = F.coalesce(F.regexp_replace(text, r"(?U)\s+", ""), F.lit(""))
    empty = bare == ""
    if is_json is None:
        return empty
    blank_string = text.rlike(r'(?U)^\s*"(\s|\\[nrt])*"\s*$')
    return empty | F.coalesce(is_json & (bare.isin("null", "[]", "{}") | blank_string), F.lit(False))


def empty_reason(stop_reason: Column, text: Column, is_json: Column | None = None) -> Column:
    """What a finish reason says; for all others, `blank` if there is no text, else null."""
    name = F.lower(F.trim(stop_reason))
    known = F.create_map(*[F.lit(x) for pair in STOP_REASONS.items() for x in pair])
    return F.coalesce(F.when(name.isin(*STOP_REASONS), known[name]), F.when(is_blank(text, is_json), "blank"))


#: Empty reasons, the most specific first.
EMPTY_PRECEDENCE = ["refusal", "content_filter", "truncated", "tool_use_only", "thinking_only", "no_content_blocks", "empty_body", "output_expr_empty", "blank"]
#: Error classes that the suite has to answer for; all others are the harness's.
SUITE_FAULTS = ("grader_missing", "render_failed", "assert_failed", "checker_failed")
#: Ranked error classes, the most specific first.
ERROR_PRECEDENCE = ["grader_missing", "grader_unavailable", "grader_failed", "checker_failed", "assert_failed"]
#: Empty reasons that come again when a call is repeated.
REPRODUCIBLE = ("truncated", "tool_use_only", "output_expr_empty")


def _first_ranked(candidates: Column, ranks: list[str]) -> Column:
    """The candidate that ranks first; the first of all if none is ranked; null if there is none."""
    order = F.array(*[F.lit(r) for r in ranks])
    ranked = F.array_sort(F.transform(F.filter(candidates, lambda c: F.array_contains(order, c)), lambda c: F.struct(F.array_position(order, c).alias("at"), c.alias("c"))))
    return F.coalesce(F.get(ranked, F.lit(0))["c"], F.get(candidates, F.lit(0)))


def most_specific_reason(candidates: Column) -> Column:
    """Of several empty reasons, the one that tells most."""
    return _first_ranked(candidates, EMPTY_PRECEDENCE)


def most_specific_error(candidates: Column) -> Column:
    """Of several error classes, the one that tells most; faults of the harness come before those of the suite."""
    harness = F.filter(candidates, lambda c: ~c.isin(*SUITE_FAULTS))
    return _first_ranked(F.when(F.size(harness) > 0, harness).otherwise(candidates), ERROR_PRECEDENCE)


def all_classes(primary: Column, others: Column) -> Column:
    """A case's class (null and '': unknown), then the other classes of its assertions in order."""
    first = F.coalesce(F.nullif(primary, F.lit("")), F.lit("unknown"))
    more = F.array_sort(F.array_distinct(F.filter(others, lambda c: c.isNotNull() & (c != "") & (c != first))))
    return F.concat(F.array(first), F.coalesce(more, F.array().cast("array<string>")))


def clamped_reason(reason: Column, most: int = 64) -> Column:
    """Without control characters, and `most` code points at most."""
    return F.substring(F.regexp_replace(reason, r"\p{Cc}", ""), 1, most)


def refused(text: Column, patterns: tuple[str, ...]) -> Column:
    """Whether any pattern is found in an output."""
    out = F.lit(False)
    for p in patterns:
        out = out | F.coalesce(text.rlike(f"(?U){p}"), F.lit(False))
    return out


def stored_in_cache(reason: Column, policy: str = "never") -> Column:
    """Whether an answer goes to the cache: real ones always, empty ones by the policy never, reproducible or always."""
    if policy not in ("never", "reproducible", "always"):
        raise ValueError(f"unknown policy {policy}")
    kept = {"never": F.lit(False), "always": F.lit(True), "reproducible": reason.isin(*REPRODUCIBLE)}[policy]
    return reason.isNull() | kept


def status_rank(status: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in STATUS_RANK.items() for x in pair])[status]


def is_infrastructure(error_class: Column) -> Column:
    return F.coalesce(error_class.startswith("provider_") | error_class.startswith("cache_") | (error_class == "exec_failed"), F.lit(False))


def glob_pattern(glob: str) -> str:
    """Anchored pattern of a glob in which * also crosses slashes."""
    out = "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in glob)
    return f"(?s)^{out}$"


def matches_test(test_id: Column, tags: Column, *, any_tags: tuple[str, ...] = (), globs: tuple[str, ...] | None = None) -> Column:
    """Any of the tags, and any of the globs; a null id fits no glob. Empty tags, and globs of None, ask nothing."""
    by_tag = F.coalesce(F.arrays_overlap(tags, F.array(*[F.lit(t) for t in any_tags])), F.lit(False)) if any_tags else F.lit(True)
    if globs is None:
        return by_tag
    by_id = F.lit(False)
    for glob in globs:
        by_id = by_id | F.coalesce(test_id.rlike(glob_pattern(glob)), F.lit(False))
    return by_tag & by_id


#: Regional and vendor prefixes that a model's name can carry.
VENDOR_PREFIXES = ("us.anthropic.", "eu.anthropic.", "apac.anthropic.", "anthropic.")


def bare_model(model: Column, prefixes: tuple[str, ...] = VENDOR_PREFIXES) -> Column:
    """A model's name without blanks around it, one vendor prefix (the first that fits) and an @version."""
    name = F.trim(model)
    out = None
    for p in prefixes:
        cut = F.substring(name, F.lit(len(p) + 1), F.length(name))
        out = F.when(name.startswith(p), cut) if out is None else out.when(name.startswith(p), cut)
    return F.regexp_replace(name if out is None else out.otherwise(name), r"(?s)@.*$", "")


def family_rate(model: Column, exact: dict[str, int], families: dict[str, int], prefixes: tuple[str, ...] = VENDOR_PREFIXES) -> Column:
    """Rate of a model: by its name, then by its name without a date at the end, then by the longest prefix that fits."""
    name = bare_model(model, prefixes)
    dateless = F.regexp_replace(name, r"-([0-9]{8}|[0-9]{4}-[0-9]{2}-[0-9]{2})$", "")
    known = F.create_map(*[F.lit(x) for pair in exact.items() for x in pair]) if exact else None
    of = [F.when(n.isin(*exact), known[n]) for n in (name, dateless)] if exact else []
    return F.coalesce(*of, *[F.when(name.startswith(p), F.lit(families[p])) for p in sorted(families, key=len, reverse=True)], F.lit(None).cast("int"))


def component_cost(tokens: Column, micro_per_mtok: Column) -> Column:
    """Micro-dollars of a number of tokens, rounded up; null where there are tokens and no rate, 0 without tokens."""
    product = tokens.cast("decimal(19,0)") * micro_per_mtok.cast("decimal(18,0)")
    return F.when(F.coalesce(tokens, F.lit(0)) == 0, F.lit(0).cast("long")).otherwise(F.ceil(product / F.lit(1_000_000)).cast("long"))


#: What a rate sheet may hold, in micro-dollars per million tokens.
RATES = ("input", "output", "cache_read", "cache_write_5m", "cache_write_1h")


def call_cost(usage: dict[str, Column], rate: dict[str, Column]) -> Column:
    """Micro-dollars of a call: each component rounded up, then summed; null as soon as tokens of a component have no rate, or
    input or output has none. usage: input, output, cache_read, cache_write and, of the latter, cache_write_1h."""
    zero = F.lit(0).cast("long")
    part = lambda name: F.coalesce(usage.get(name, zero), zero)
    of = lambda name: rate.get(name, F.lit(None)).cast("long")
    long = F.least(part("cache_write_1h"), part("cache_write"))
    priced = of("input").isNotNull() & of("output").isNotNull()
    total = component_cost(part("input"), of("input")) + component_cost(part("output"), of("output")) + component_cost(part("cache_read"), of("cache_read"))
    total = total + component_cost(part("cache_write") - long, of("cache_write_5m")) + component_cost(long, of("cache_write_1h"))
    return F.when(priced, total)


def merged_rates(own: dict[str, Column], built_in: dict[str, Column]) -> dict[str, Column]:
    """A configured rate sheet over the built-in one, field by field."""
    none = F.lit(None).cast("long")
    return {r: F.coalesce(own.get(r, none), built_in.get(r, none)) for r in RATES}


def what_moved(base: dict[str, Column], head: dict[str, Column], output_changed: Column, verdict_changed: Column) -> Column:
    """Why a case changed. base and head hold the digests prompt, provider, asserts and grader; one that is null on a
    side tells nothing, and then no drift is claimed."""
    parts = ("prompt", "provider", "asserts", "grader")
    out = None
    for p in parts:
        out = F.when(base[p] != head[p], f"{p}_changed") if out is None else out.when(base[p] != head[p], f"{p}_changed")
    unknown = F.lit(False)
    for p in parts:
        unknown = unknown | base[p].isNull() | head[p].isNull()
    out = out.when(unknown, "unknown").when(output_changed & verdict_changed, "model_drift")
    return out.when(output_changed, "output_drift").when(verdict_changed, "unstable_grader").otherwise("stable")


#: The parts of a configuration whose change is told, likeliest cause first.
COMPONENTS = ("prompts", "providers", "tests", "asserts", "grader")


def known(digest: Column) -> Column:
    """A digest, null where it is unknown or known to be absent ('')."""
    return F.nullif(digest, F.lit(""))


def drifted(base: Column, head: Column) -> Column:
    """Whether a digest changed; null where either side is unknown."""
    return known(base) != known(head)


def changed_components(changed: dict[str, Column]) -> Column:
    """Names of the parts that did change, in the order of COMPONENTS; unknown ones aren't told."""
    return F.array_compact(F.array(*[F.when(changed[c], F.lit(c)) for c in COMPONENTS if c in changed]))


def any_unknown(changed: dict[str, Column]) -> Column:
    out = F.lit(False)
    for c in changed.values():
        out = out | c.isNull()
    return out


def cell_bucket(pass_fraction: Column, errored: Column) -> Column:
    """error, empty, low, half, high or full."""
    there = F.coalesce((pass_fraction > 0) & ~F.isnan(pass_fraction), F.lit(False))
    band = F.when(~there, "empty").when(pass_fraction < 0.5, "low").when(pass_fraction == 0.5, "half").when(pass_fraction < 1, "high").otherwise("full")
    return F.when(F.coalesce(errored, F.lit(0)) > 0, "error").otherwise(band)


def single_cell_status(errored: Column, failed: Column, skipped: Column) -> Column:
    return F.when(errored > 0, "error").when(failed > 0, "fail").when(skipped > 0, "skip").otherwise("pass")


def gate_failing(status: Column) -> Column:
    """Whether a case fails the gate: an unexpected pass does."""
    return F.coalesce(status.isin("fail", "error", "xpass"), F.lit(False))


def pass_share(passed: Column, total: Column) -> Column:
    """Passed cases of all; 0 without cases."""
    return F.when(total > 0, passed / total).otherwise(F.lit(0.0))


def graded_share(passed: Column, failed: Column, errored: Column) -> Column:
    """Passed cases of those that passed, failed or errored; null without any."""
    return passed / F.nullif(passed + failed + errored, F.lit(0))


def error_label(error_class: Column) -> Column:
    """provider_rate_limit: provider · rate limit."""
    parts = F.split(error_class, "_")
    rest = F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), " ")
    return F.when(F.size(parts) > 1, F.concat(F.get(parts, F.lit(0)), F.lit(" \u00b7 "), rest)).otherwise(error_class)


def error_tone(error_class: Column) -> Column:
    return F.when(is_infrastructure(error_class), "amber").otherwise("error")


def human_seconds(seconds: Column) -> Column:
    """12.3s below a minute, else 2m 05s."""
    whole = F.round(seconds).cast("long")
    return F.when(seconds < 60, F.format_string("%.1fs", seconds.cast("double"))).otherwise(F.format_string("%dm %02ds", F.floor(whole / 60), whole % 60))


def human_count(n: Column) -> Column:
    """500, 12.3k, 1.2M."""
    x = n.cast("double")
    return F.when(n >= 1_000_000, F.format_string("%.1fM", x / 1e6)).when(n >= 1_000, F.format_string("%.1fk", x / 1e3)).otherwise(n.cast("string"))


def human_tokens(n: Column) -> Column:
    x = n.cast("double")
    out = F.when(n < 1_000, n.cast("string")).when(n < 1_000_000, F.format_string("%.1fk", x / 1e3)).otherwise(F.format_string("%.2fM", x / 1e6))
    return F.coalesce(out, F.lit("-"))


def human_cost(usd: Column) -> Column:
    x = usd.cast("double")
    out = F.when(x == 0, "$0.00").when(x < 0.01, F.format_string("$%.4f", x)).otherwise(F.format_string("$%.2f", x))
    return F.when(usd.isNull(), "-").otherwise(out)


def human_latency(ms: Column) -> Column:
    out = F.when(ms < 1_000, F.concat(F.round(ms).cast("long").cast("string"), F.lit("ms"))).otherwise(F.format_string("%.2fs", ms.cast("double") / 1_000))
    return F.coalesce(F.when(ms.isNotNull(), out), F.lit("-"))


def human_bytes(n: Column) -> Column:
    units, x = ["B", "KB", "MB", "GB", "TB"], n.cast("double")
    out = F.format_string("%.0f B", x)
    for k, unit in enumerate(units[1:], 1):
        out = F.when(x >= 1024.0**k, F.format_string(f"%.1f {unit}", x / 1024.0**k)).otherwise(out)
    return F.when(n.isNull(), "-").otherwise(out)


def human_percent(share: Column, digits: int = 1) -> Column:
    return F.when(share.isNull(), "-").otherwise(F.format_string(f"%.{digits}f%%", share.cast("double") * 100))


def request_summary(request: Column, most: int = 256) -> Column:
    """Where a request (JSON text) went: method and address without its query, or the command line; null for others."""
    of = lambda path: F.get_json_object(request, path)
    address = F.regexp_replace(of("$.url"), r"(?s)[?#].*$", "")
    http = F.concat(F.coalesce(of("$.method"), F.lit("POST")), F.lit(" "), address)
    given = F.array_join(F.from_json(of("$.args"), "array<string>"), " ")
    command = F.concat(F.lit("exec "), of("$.command"), F.when(F.coalesce(given, F.lit("")) != "", F.concat(F.lit(" "), given)).otherwise(""))
    return F.substring(F.when(of("$.transport") == "http", http).when(of("$.transport") == "exec", command), 1, most)


def request_view(request: Column) -> Column:
    """transport (http, exec or other), target and model of a request (JSON text); null without one."""
    of = lambda path: F.get_json_object(request, path)
    http, run = F.nullif(of("$.url"), F.lit("")), F.nullif(of("$.command"), F.lit(""))
    kind = F.when((of("$.transport") == "http") & http.isNotNull(), "http").when((of("$.transport") == "exec") & run.isNotNull(), "exec").otherwise("other")
    line = F.concat_ws(" ", run, F.array_join(F.from_json(of("$.args"), "array<string>"), " "))
    target = F.when(kind == "http", F.concat_ws(" ", F.coalesce(of("$.method"), F.lit("POST")), http)).when(kind == "exec", F.rtrim(line)).otherwise("")
    model = F.when(kind == "http", of("$.body.model")).when(kind == "exec", of("$.stdin.model")).otherwise(of("$.model"))
    return F.when(request.isNotNull(), F.struct(kind.alias("transport"), target.alias("target"), model.alias("model")))


def message_text(content: Column) -> Column:
    """The text blocks of a message (array of type and text) joined; thinking is left out."""
    return F.array_join(F.transform(F.filter(content, lambda b: b["type"] == "text"), lambda b: b["text"]), "")


def flat_prompt(messages: Column) -> Column:
    """Texts and tool calls of all messages (array of text and calls: array of name and arguments), a line each."""
    calls = lambda m: F.transform(m["calls"], lambda c: F.concat_ws(" ", c["name"], c["arguments"]))
    lines = F.transform(messages, lambda m: F.when(F.coalesce(F.size(m["calls"]), F.lit(0)) <= 0, F.array(F.coalesce(m["text"], F.lit("")))).otherwise(F.concat(F.filter(F.array(m["text"]), lambda t: t.isNotNull() & (t != "")), calls(m))))
    return F.array_join(F.flatten(lines), "\n")


def spliced(messages: Column, history: Column, marker: Column) -> Column:
    """History put into messages (both arrays of role and text) where marker says (a place from 0), else behind the system
    turns they begin with."""
    first = F.filter(F.transform(messages, lambda m, i: F.when(m["role"] != "system", i)), lambda i: i.isNotNull())
    at = F.coalesce(marker, F.get(first, F.lit(0)), F.size(messages))
    return F.concat(F.slice(messages, F.lit(1), at), history, F.slice(messages, at + 1, F.greatest(F.size(messages) - at, F.lit(0))))


def case_key(provider: Column, prompt: Column, test: Column, repeat: Column) -> Column:
    """16 hex digits of the sha256 of the cell's parts, with zero bytes between them and the repeat as 4 bytes, lowest first; null without a provider or a test."""
    zero = F.unhex(F.lit("00"))
    swapped = F.lpad(F.lower(F.hex(repeat.cast("long"))), 8, "0")
    low_first = F.unhex(F.concat(*[F.substring(swapped, k, 2) for k in (7, 5, 3, 1)]))
    text = lambda c: F.encode(c, "UTF-8")
    return F.substring(F.sha2(F.concat(text(provider), zero, text(F.coalesce(prompt, F.lit(""))), zero, text(test), zero, low_first), 256), 1, 16)
