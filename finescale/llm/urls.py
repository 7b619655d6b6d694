"""URL verdicts from a weighted vocabulary and from host and path rules.

A rule names a host and a path prefix; it fits the host and its subdomains, and of several the longest wins. Where no rule
fits, an Aho-Corasick automaton over the vocabulary scans host and path once. A term counts where it stands between
boundaries: neither neighbour is an ASCII letter or digit. One strict term blocks, as do ``soft_limit`` distinct soft terms.
Terms may overlap: each occurrence counts by itself.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; path: then up to ``?``, ``#`` or the
end. Null urls and urls without ``://`` have both empty and are allowed. Rows stay rows: repeated ones get the same verdict,
null ids stay null, other columns are ignored, an empty table gives no rows. A url's length does not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words of adult, betting, malware and piracy addresses. STRICT: one is enough. SOFT: common in harmless addresses, too.
STRICT = ("spam", "spammer", "porn", "porno", "xxx", "xvideos", "hentai", "camgirls", "escorts", "nudes", "milf", "bdsm", "gangbang", "warez",
          "keygen", "phishing", "viagra", "cialis")
SOFT = ("adult", "x", "win", "free", "farm", "bet", "bets", "bonus", "sex", "sexy", "nude", "erotic", "fetish", "casino", "poker", "betting", "slots", "jackpot", "gambling",
        "lottery", "torrent", "crack", "serial", "cheap", "pills", "pharmacy", "loan", "payday", "replica", "escort", "dating",
        "ads", "track", "adserver", "popunder", "clickbait", "download")
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


@dataclass(frozen=True)
class Vocabulary:
    """``strict`` and ``soft`` terms in lower case; ``soft_limit``: distinct soft terms that block."""

    strict: tuple[str, ...] = STRICT
    soft: tuple[str, ...] = SOFT
    soft_limit: int = 2

    def automaton(self) -> ahocorasick.Automaton:
        out = ahocorasick.Automaton()
        for term in self.soft:
            out.add_word(term, (len(term), term, False))
        for term in self.strict:
            out.add_word(term, (len(term), term, True))
        out.make_automaton()
        return out


def _open(text: str, at: int) -> bool:
    """No letter or digit stands at ``at``."""
    return not (0 <= at < len(text) and text[at].isascii() and text[at].isalnum())


def hits(automaton: ahocorasick.Automaton, text: str) -> tuple[int, set[str]]:
    """Occurrences of strict terms, and the distinct soft terms, between boundaries."""
    strict, soft = 0, set()
    for last, (size, term, is_strict) in automaton.iter(text):
        if _open(text, last - size) and _open(text, last + 1):
            if is_strict:
                strict += 1
            else:
                soft.add(term)
    return strict, soft


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*(/[^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """The longest fitting rule, and what it says; both null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):       # later, thus longer, ones override
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, vocabulary: Vocabulary = Vocabulary(), rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """Verdict of every page's url: ``page_id, host, path, rule, verdict, strict_hits, soft_terms``. The automaton runs on
    urls without a rule too; its counts are reported for all."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = vocabulary.automaton()
        for batch in batches:
            found = [hits(automaton, (h + p).lower()) for h, p in zip(batch.column("host").to_pylist(),
                                                                      batch.column("path").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([n for n, _ in found], pa.int32()),
                 pa.array([sorted(s) for _, s in found], pa.list_(pa.string()))],
                names=[*batch.schema.names, "strict_hits", "soft_terms"])

    parts = pages.select(F.col("page_id").cast("bigint").alias("page_id"), host_of(F.col("url")).alias("host"),
                         path_of(F.col("url")).alias("path"))
    counted = parts.mapInArrow(task, "page_id bigint, host string, path string, strict_hits int, soft_terms array<string>")
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    blocked = (F.col("strict_hits") >= 1) | (F.size("soft_terms") >= vocabulary.soft_limit)
    return counted.select("page_id", "host", "path", rule.alias("rule"),
                          F.coalesce(says, F.when(blocked, "block").otherwise("allow")).alias("verdict"),
                          "strict_hits", "soft_terms")


def oracle(vocabulary: Vocabulary = Vocabulary(), rules: tuple[tuple[str, str], ...] = RULES) -> str:
    """The same question in SQL: one regular expression per term instead of the automaton."""
    def found(term: str) -> str:
        escaped = term.replace("-", "[-]")
        return f"regexp_matches(t, '(^|[^a-z0-9]){escaped}([^a-z0-9]|$)')"

    strict = " OR ".join(map(found, vocabulary.strict))
    soft = " + ".join(f"CAST({found(t)} AS INT)" for t in vocabulary.soft)
    cases = ""
    for says, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, rest = text.partition("/")
        cases += f" WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{slash}{rest}') THEN '{says} {text}'"
    return f"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path FROM u),
r AS (SELECT *, lower(host || path) AS t, CASE{cases} END AS fit FROM p)
SELECT page_id, host, path, split_part(fit, ' ', 2) AS rule,
  coalesce(split_part(fit, ' ', 1), CASE WHEN ({strict}) OR ({soft}) >= {vocabulary.soft_limit} THEN 'block' ELSE 'allow' END) AS verdict
FROM r"""
