"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression over ``host + path`` and the literal tokens (runs
of a-z and 0-9) that every text it fits must hold.  Each rule is filed under the
token that the fewest URLs hold.  A URL's tokens fetch candidate rules by a join,
and only those run their expression.  A rule without tokens is fetched by all.

Of the fitting rules the highest priority wins, then the longest, then the last
by code point.  Without one the verdict is ``allow``.  Nulls and URLs without
``://`` have an empty host and path.  Equal URLs are judged once; repeated rows
get equal results.  An empty rule list allows everything.  Further columns are
carried along whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemtable.llm.frames import boxed, literal_table, unboxed
from stemtable.operators.spread import skew_join

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The host and path rules, with their verdicts.
PREFIXES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
# Words in a host or path that mark spam, gambling, adult pages and tracking.
BLOCKED_WORDS = ("pills", "viagra", "casino", "bets", "poker", "spam", "adult", "porn", "xxx", "ads", "track")


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str
    tokens: tuple[str, ...]
    verdict: str
    priority: int
    length: int


def _literal(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9_/-])", r"\\\1", text)


def prefix_rule(host: str, path: str, verdict: str) -> Rule:
    """Fits the host and its subdomains where the path starts with ``path``."""
    whole = f"{host.lower()}{path}"
    tokens = re.findall(r"[a-z0-9]+", whole.lower())
    if re.search(r"[A-Za-z0-9]$", path):
        tokens.pop()  # the path may go on within its last token
    return Rule(whole, rf"^(?:[^/]*\.)?{_literal(host.lower())}{_literal(path)}", tuple(tokens), verdict, 1, len(whole))


def word_rule(word: str, verdict: str = "block") -> Rule:
    """Fits where the word stands between other characters than letters and digits."""
    return Rule(word, rf"(?i)(?:^|[^a-z0-9]){word}(?:[^a-z0-9]|$)", (word,), verdict, 0, len(word))


def default_rules() -> list[Rule]:
    return [prefix_rule(*p) for p in PREFIXES] + [word_rule(w) for w in BLOCKED_WORDS]


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(F.coalesce(host, F.lit("")), UPPER, LOWER), F.coalesce(path, F.lit(""))


def rule_table(docs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    rows = [(r.name, r.pattern, list(r.tokens) or [""], r.verdict, r.priority, r.length) for r in rules]
    schema = "rule string, pattern string, tokens array<string>, verdict string, priority int, length int"
    return literal_table(docs.sparkSession, rows, schema)


def url_filter(pages: DataFrame, rules: Sequence[Rule] | None = None, url: str = "url") -> DataFrame:
    """The columns of ``pages``, then ``host, path, rule, verdict``; ``rule`` names a fitting prefix
    rule, else null.  The new columns replace columns of these names."""
    rules = default_rules() if rules is None else list(rules)
    table = rule_table(pages, rules)
    host, path = host_and_path(F.col("_url"))
    urls = pages.select(F.col(f"`{url}`").alias("_url")).filter("_url is not null").distinct()
    parts = urls.select("_url", F.concat(host, path).alias("subject"))
    tokens = F.array_union(F.array(F.lit("")), F.split(F.lower("subject"), "[^a-z0-9]+"))
    held = parts.select("_url", "subject", F.explode(F.array_distinct(tokens)).alias("token"))

    wanted = table.select("rule", F.explode("tokens").alias("token"))
    counts = skew_join(held.select("token"), wanted.select("token").distinct(), ["token"], "left_semi")
    counts = counts.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarest = (
        wanted.join(counts, "token", "left")
        .groupBy("rule")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "token")).alias("rarest"))
        .select("rule", F.col("rarest.token").alias("token"))
    )
    index = table.join(rarest, "rule").select("token", "rule", "pattern", "verdict", "priority", "length")
    fits = skew_join(held, index, ["token"], "inner").filter(F.regexp_like("subject", F.col("pattern")))
    # The greatest struct has the highest priority, then the greatest length, then the last name.
    best = fits.groupBy("_url").agg(
        F.max_by(F.struct("rule", "verdict", "priority"), F.struct("priority", "length", "rule")).alias("best"),
    )
    new = ("host", "path", "rule", "verdict")
    names = [c for c in pages.columns if c not in new]
    rows = pages.select(boxed(names).alias("row"), F.col(f"`{url}`").alias("_url"))
    joined = skew_join(rows, best, ["_url"], "left")
    return joined.select(
        *unboxed("row", names),
        host.alias("host"),
        path.alias("path"),
        F.when(F.col("best.priority") > 0, F.col("best.rule")).alias("rule"),
        F.coalesce("best.verdict", F.lit("allow")).alias("verdict"),
    )


def oracle_sql() -> str:
    """The same verdicts in DuckDB, rule by rule without an index."""
    choices = []
    for r in default_rules():
        pattern = r.pattern.replace("'", "''")
        row = f"{{'p': {r.priority}, 'l': {r.length}, 'rule': '{r.name}', 'v': '{r.verdict}'}}"
        choices.append(f"CASE WHEN regexp_matches(host || path, '{pattern}') THEN {row} END")
    return f"""
WITH rest AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM rest
), judged AS (
  SELECT page_id, host, path, list_max(list_filter([{', '.join(choices)}], lambda x: x IS NOT NULL)) AS best FROM parts
)
SELECT page_id, host, path, CASE WHEN best.p > 0 THEN best.rule END AS rule,
  coalesce(best.v, 'allow') AS verdict FROM judged"""
