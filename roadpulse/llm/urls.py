"""URL filter: host and path rules first, then a weighted vocabulary of terms in the URL.

An Aho-Corasick automaton finds all terms in one pass over the lower-cased URL. A term counts only between
boundaries: characters that are neither letters nor digits, or the ends of the URL. One strict
term rejects a URL, and so do several different soft terms.
"""

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadpulse.llm.shared import with_columns_of

STRICT = ["porn", "xxx", "casino", "escort", "hentai", "camgirls", "viagra"]
SOFT = ["bets", "betting", "win", "cheap", "pills", "free", "ads", "track", "adult", "poker", "loan", "dating"]
SOFT_HITS = 2
#: (verdict, host, path); a rule fits its host and the hosts below it.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    """Both empty for a null URL and one without ``://``."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def with_rule(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """``pages`` with host, path and ``rule``, the longest rule that fits (null if none), and ``rule_verdict``."""
    host, path = host_and_path()
    pages = pages.withColumn("host", host).withColumn("path", path)
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, start in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((F.col("host") == name) | F.col("host").endswith(f".{name}")) & F.col("path").startswith(start)
        found = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return (
        pages.withColumn("_found", found)
        .withColumn("rule", F.col("_found.rule"))
        .withColumn("rule_verdict", F.col("_found.verdict"))
        .drop("_found")
    )


def _automaton(strict: list[str], soft: list[str]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for terms, weight in ((soft, 0), (strict, 1)):
        for term in terms:
            found.add_word(term, (weight, term))
    found.make_automaton()
    return found


def _edge(text: str, i: int) -> bool:
    return i < 0 or i >= len(text) or not text[i].isalnum()


def term_hits(url: str | None, found: ahocorasick.Automaton) -> tuple[int, int]:
    """How many different strict and soft terms the URL has between boundaries."""
    text, hits = (url or "").lower(), set()
    for end, (weight, term) in found.iter(text):
        if _edge(text, end - len(term)) and _edge(text, end + 1):
            hits.add((weight, term))
    n_strict = sum(weight for weight, _ in hits)
    return n_strict, len(hits) - n_strict


def with_terms(pages: DataFrame, strict: list[str] = STRICT, soft: list[str] = SOFT) -> DataFrame:
    """``pages`` with ``n_strict`` and ``n_soft``, the different terms found in the whole URL; none in a null one."""

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        found = _automaton(strict, soft)
        hits = [term_hits(u, found) for u in batch.column("url").to_pylist()]
        return {k: pa.array([h[i] for h in hits], pa.int64()) for i, k in enumerate(("n_strict", "n_soft"))}

    return with_columns_of(pages, make, [("n_strict", T.LongType()), ("n_soft", T.LongType())])


def url_filter(
    pages: DataFrame,
    rules: list[tuple[str, str, str]] = RULES,
    strict: list[str] = STRICT,
    soft: list[str] = SOFT,
    soft_hits: int = SOFT_HITS,
) -> DataFrame:
    """``pages`` with host, path, rule, n_strict, n_soft and ``verdict``: the rule's, else that of the terms.

    Repeated rows are judged one by one. Columns of ``pages`` that have one of these names are replaced.
    """
    judged = with_rule(with_terms(pages, strict, soft), rules)
    bad = (F.col("n_strict") > 0) | (F.col("n_soft") >= soft_hits)
    own = F.when(bad, "block").otherwise("allow")
    return judged.withColumn("verdict", F.coalesce("rule_verdict", own)).drop("rule_verdict")
