"""Quality rules whose cutoffs are certified to reject few good documents.

``measure`` counts words, symbols and repetition of whole texts. A rule compares one measure per word or character, in thousandths,
with a cutoff of a fixed grid. In each stratum, labelled documents that pass the base rules choose and certify the cutoffs:

* One fold (crc32 of the id modulo FOLDS is 0) proposes. Step t of STEPS takes for each rule, of the cutoffs that reject at most that
  share of the fold's good documents, the one that rejects most of the bad, of equals the loosest; a rule that rejects no bad one
  stays off. Later steps reject more, never less.
* The others are the holdout. Step after step, from the loosest, the exact binomial tail tests whether the false rejection rate of
  all rules together is above ``limit``; testing stops at the first step that is not refuted at ``risk`` / strata. A fixed order of tests
  needs no correction within a stratum, and Bonferroni's covers the strata: with probability 1 - ``risk`` or more, no
  stratum that uses a certified step rejects more than ``limit`` of its good documents. A stratum with too few labels for a proof rejects none.
* Of the certified steps, the one that gains most on the holdout is used: bad ones rejected less PRICE times good ones rejected, as
  shares; of equals the loosest. All steps tested were certified at once, so the choice is free.

Null and empty texts have no words and fail the base rules. Rows stay rows: repeated ids are judged each, null ids are judged but teach
nothing. Labels that repeat an id count once, as bad if any is; labels other than 0 and 1 (null too) are none. A null stratum is one of its own, and a
stratum without labels rejects none. Other columns are ignored. Empty documents give no rows; empty labels certify nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finescale.llm.oracle import crc32_sql, crc32_table
from finescale.llm.shared import fold, written
from finescale.llm.text import Words, mix, ngrams, plain, raw, slices, sums
from finescale.operators.one_row import attach_row

FEWEST, REPEATED, WINDOW = 20, 30, 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals", "n_marks", "n_stutters")
FOLDS = 4
SALTS = 32                      # shares of a stratum's rows, each of which meets a copy of its cutoffs
STEPS = (0.0, 0.002, 0.005, 0.01, 0.02)        # shares of good documents that one rule may reject in the proposing fold
LIMIT, RISK, PRICE = 0.05, 0.05, 20
# Rules: measure (sign, numerator, denominator) and its grid of cutoffs, in thousandths. A document is beyond a cutoff if its measure is greater.
_SHARE = tuple(range(25, 1000, 25))
RULES = (("symbols", 1, "n_symbols", "n_words", (*range(20, 1000, 20), *range(1000, 4001, 250))),
         ("marks", 1, "n_marks", "word_chars", _SHARE), ("capitals", 1, "n_capitals", "word_chars", _SHARE),
         ("long words", 1, "word_chars", "n_words", tuple(range(5000, 20001, 250))),
         ("short words", -1, "word_chars", "n_words", tuple(range(-5000, -1000, 250))),
         ("lines again", 1, "n_dup_lines", "n_words", tuple(range(5, 200, 5))), ("words again", 1, "n_repeat_words", "n_words", _SHARE[:12]),
         ("stutters", 1, "n_stutters", "n_words", _SHARE))

_SPACE, _SYMBOL, _CAPITAL, _MARK = (np.zeros(256, bool) for _ in range(4))
_SPACE[[32, *range(9, 14)]] = True
_SYMBOL[list(b"#*$%&|<>")] = True
_CAPITAL[65:91] = True
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


@dataclass(frozen=True)
class Rule:
    """``sign`` 1000 * ``over`` / ``under``, rounded down, must not exceed the cutoff that is chosen from ``grid`` (ascending)."""

    name: str
    sign: int
    over: str
    under: str
    grid: tuple[int, ...]

    def sql(self) -> str:
        """A document with a denominator of zero has no value, and null is beyond no cutoff."""
        return f"{'-' if self.sign < 0 else ''}(1000 * {self.over} DIV nullif({self.under}, 0))"


RULE_SET = tuple(Rule(*r) for r in RULES)


def measure(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of every row with COUNTS of its whole text and ``base_failed``.

    Words are maximal runs without white space (U+0020, U+0009 to U+000D). ``word_chars``: code points in words; ``n_symbols``: of
    ``#*$%&|<>``; ``n_dup_lines``: lines with a word that equal an earlier line; ``n_repeat_words``: words in windows of WINDOW words that the text
    holds twice or more; ``n_capitals``: A-Z; ``n_marks``: ASCII punctuation;
    ``n_stutters``: words that equal the word before."""
    rows = docs.select(*[F.col(c).alias(f"keep{k}") for k, c in enumerate(keep)], F.col("text").cast("string").alias("text"))
    kinds = ", ".join([f"keep{k} {rows.schema[k].dataType.simpleString()}" for k in range(len(keep))] + [f"{c} bigint" for c in COUNTS])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 21):
                counts = counts_of(plain(part.column("text")))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *[pa.array(c.astype(np.int64)) for c in counts]],
                                                 names=[*part.schema.names[:-1], *COUNTS])

    failed = F.expr(f"n_words < {FEWEST} OR 100 * n_repeat_words > {REPEATED} * n_words")
    return rows.mapInArrow(task, kinds).toDF(*keep, *COUNTS).withColumn("base_failed", failed)


def counts_of(texts: pa.Array) -> list[np.ndarray]:
    """COUNTS of each text."""
    data, offsets = raw(texts)
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (edge[:-1] | ~np.append(False, inside)[:-1]))
    ends = np.flatnonzero(inside & (edge[1:] | ~np.append(inside, False)[1:])) + 1
    w = Words(_hashes(data[inside], ends - starts), np.searchsorted(starts, offsets), starts, ends, data)
    of = [sums(flag, offsets) for flag in (inside & ((data & 0xC0) != 0x80), _SYMBOL[data], _CAPITAL[data], _MARK[data])]
    again = np.array([_lines_again(data[a:z].tobytes()) for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist())], np.int64)
    stutter = np.append(False, w.hashes[1:] == w.hashes[:-1])[:len(w.hashes)]
    stutter[w.first[:-1][w.first[:-1] < w.first[1:]]] = False
    return [np.diff(w.first), of[0], of[1], again, _words_again(w), of[2], of[3], sums(stutter, w.first)]


def _hashes(letters: np.ndarray, wide: np.ndarray) -> np.ndarray:
    """64-bit hashes of words whose bytes follow each other in ``letters``."""
    if not len(wide):
        return np.zeros(0, np.uint64)
    heads = np.cumsum(wide) - wide
    powers = np.cumprod(np.full(int(wide.max()), 0x9E3779B97F4A7C15, np.uint64))
    place = np.arange(len(letters)) - np.repeat(heads, wide)
    return mix(np.add.reduceat((letters.astype(np.uint64) + np.uint64(1)) * powers[place], heads) + wide.astype(np.uint64))


def _lines_again(text: bytes) -> int:
    seen: set[bytes] = set()
    again = 0
    for line in text.split(b"\n") if b"\n" in text else ():
        if line.strip(b" \t\n\v\f\r"):
            again += line in seen
            seen.add(line)
    return again


def _words_again(w: Words) -> np.ndarray:
    """Words of each text that stand in a window which the text holds at least twice."""
    grams, first = ngrams(w, WINDOW)
    per = np.diff(first)
    own = mix(grams ^ mix(np.repeat(np.arange(len(w), dtype=np.uint64) + np.uint64(1), per)))    # windows of other texts differ
    order = np.argsort(own)
    same = own[order][1:] == own[order][:-1]
    twice = np.zeros(len(own), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    at = (np.arange(len(own)) + np.repeat(w.first[:-1] - first[:-1], per))[twice]
    cover = np.bincount(at, minlength=len(w.hashes) + 1) - np.bincount(np.minimum(at + WINDOW, len(w.hashes)), minlength=len(w.hashes) + 1)
    return sums(np.cumsum(cover)[:len(w.hashes)] > 0, w.first)


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of n draws with probability p, summed from k down; 1 from the mean on, where no test succeeds. Below the mean, terms fall
    ever faster, so some sqrt(n) of them make the sum."""
    if k >= n * p:
        return 1.0
    term = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
    total = term
    while k > 0 and term > total * 1e-17:
        term *= k * (1 - p) / ((n - k + 1) * p)
        total, k = total + term, k - 1
    return total


def cutoffs(measured: DataFrame, labels: DataFrame, limit: float = LIMIT, risk: float = RISK, rules: tuple[Rule, ...] = RULE_SET) -> DataFrame:
    """Certified cutoffs of each stratum of ``measured`` (``doc_id, stratum``: not null, counts): ``stratum, cuts`` (one a rule, null if off),
    ``step``, ``n_good, n_lost`` of the holdout and the tail probability ``tail``. Strata without a certified step have no row."""
    marks = labels.filter("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    values = F.array(*[F.expr(r.sql()) for r in rules])
    taught = written(measured.filter("NOT base_failed AND doc_id IS NOT NULL").join(marks, "doc_id")
                     .select("stratum", F.expr("quality = 1").alias("good"), (fold() == 0).alias("proposes"), values.alias("values"), _salt()), "taught")
    grid = "array(" + ", ".join("array(" + ", ".join(map(str, r.grid)) + ")" for r in rules) + ")"
    # how many cutoffs of its rule's grid a value is beyond, counted per stratum and label, then summed from the top
    bins = (taught.filter("proposes").select("stratum", "good", F.posexplode("values").alias("rule", "value"))
            .select("stratum", "good", "rule", F.expr(f"size(filter({grid}[rule], c -> value > c))").alias("beyond"))
            .groupBy("stratum", "rule", "beyond").agg(F.expr("count_if(good)").alias("good"), F.expr("count_if(NOT good)").alias("bad")))
    totals = taught.filter("proposes").groupBy("stratum").agg(F.expr("count_if(good)").alias("n_good"))
    per_rule = (bins.groupBy("stratum", "rule").agg(F.collect_list(F.struct("beyond", "good", "bad")).alias("bins")).join(totals, "stratum")
                .select("stratum", "rule", "n_good", F.explode(F.expr(
                    f"transform({grid}[rule], (c, i) -> named_struct('cut', c,"
                    " 'lost', aggregate(bins, 0L, (s, b) -> s + IF(b.beyond > i, b.good, 0L)),"
                    " 'caught', aggregate(bins, 0L, (s, b) -> s + IF(b.beyond > i, b.bad, 0L))))")).alias("c"))
                .select("stratum", "rule", "n_good", "c.*").filter("caught > 0"))
    steps = F.explode(F.array(*[F.struct(F.lit(t).alias("step"), F.lit(int(s * 1000)).alias("share")) for t, s in enumerate(STEPS)])).alias("s")
    picked = (per_rule.select("*", steps).filter("lost * 1000 <= s.share * n_good").groupBy("stratum", "s.step", "rule")
              .agg(F.max(F.struct("caught", "cut")).alias("best")).groupBy("stratum", "step")
              .agg(F.map_from_entries(F.collect_list(F.struct("rule", F.col("best.cut").alias("cut")))).alias("cuts"))
              .select("stratum", "step", F.expr(f"transform(sequence(0, {len(rules) - 1}), r -> cuts[r])").alias("cuts")))
    proposed = written(picked, "proposed")
    held = taught.filter("NOT proposes").join(_salted(proposed), ["stratum", "salt"]).select("stratum", "step", "good", F.expr(beyond()).alias("rejected"))
    tested = held.groupBy("stratum", "step").agg(F.expr("count_if(good)").alias("n_good"), F.expr("count_if(good AND rejected)").alias("n_lost"),
                                                 F.expr("count_if(NOT good)").alias("n_bad"), F.expr("count_if(NOT good AND rejected)").alias("n_caught"))
    strata = taught.select("stratum").distinct().agg(F.count("*").alias("strata"))
    tail = F.pandas_udf(lambda k, n: pd.Series([binomial_tail(a, b, limit) for a, b in zip(k, n)], dtype=float), "double")
    tested = attach_row(tested.withColumn("tail", tail("n_lost", "n_good")), strata).withColumn("certain", F.expr(f"tail <= {risk} / strata"))
    runs = tested.groupBy("stratum").agg(F.sort_array(F.collect_list(F.struct(
        "step", "certain", "n_good", "n_lost", "tail", F.expr(f"n_caught * n_good - {PRICE} * n_lost * n_bad").alias("gain")))).alias("all"))
    runs = runs.withColumn("sure", F.expr("filter(all, (x, i) -> forall(slice(all, 1, i + 1), y -> y.certain))"))
    best = F.expr("array_max(transform(sure, x -> named_struct('gain', x.gain, 'later', -x.step, 'n_good', x.n_good, 'n_lost', x.n_lost, 'tail', x.tail)))")
    chosen = runs.filter("size(sure) > 0").select("stratum", best.alias("b")).select("stratum", F.expr("-b.later").alias("step"), "b.n_good", "b.n_lost", "b.tail")
    return chosen.join(proposed, ["stratum", "step"]).select("stratum", "step", "cuts", "n_good", "n_lost", "tail")


def _salt() -> Column:
    return F.expr(f"pmod(xxhash64(doc_id, n_words, word_chars), {SALTS})").cast("int").alias("salt")


def _salted(cuts: DataFrame) -> DataFrame:
    """A row of each stratum for every share of its documents: a stratum may hold most of them, its cutoffs are one row."""
    return cuts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def beyond(values: str = "values", cuts: str = "cuts") -> str:
    """SQL: any value is beyond its cutoff. Rules that are off, and values that do not exist, reject nothing."""
    return f"exists(zip_with({values}, {cuts}, (v, c) -> coalesce(v > c, false)), x -> x)"


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", limit: float = LIMIT, risk: float = RISK,
          rules: tuple[Rule, ...] = RULE_SET) -> DataFrame:
    """Every row's ``doc_id, stratum`` (``=`` and the value; empty text: null), COUNTS, ``base_failed``, ``kept`` and ``broken``, the names of the rules it breaks."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text",
                       F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit("")).alias("stratum"))
    measured = written(measure(rows, ["doc_id", "stratum"]), "measured")
    found = cutoffs(measured, labels, limit, risk, rules).select("stratum", "cuts")
    values = ", ".join(r.sql() for r in rules)
    names = ", ".join(f"'{r.name}'" for r in rules)
    broken = f"filter(zip_with(zip_with(array({values}), cuts, (v, c) -> coalesce(v > c, false)), array({names}), (b, n) -> IF(b, n, NULL)), x -> x IS NOT NULL)"
    judged = measured.withColumn("salt", _salt()).join(_salted(found), ["stratum", "salt"], "left").drop("salt").withColumn("broken", F.expr(f"coalesce({broken}, CAST(array() AS array<string>))"))
    return judged.withColumn("kept", F.expr("NOT base_failed AND size(broken) = 0")).drop("cuts")


def oracle() -> str:
    """The contract in DuckDB SQL: windows as text, cutoffs by joins with the grids, binomial sums term by term."""
    word = "[^\\x20\\x09-\\x0D]"
    grids = " UNION ALL ".join(f"SELECT {k} AS rule, unnest({list(r.grid)}::BIGINT[]) AS cut" for k, r in enumerate(RULE_SET))
    values = " UNION ALL ".join(f"SELECT r, stratum, doc_id, {k} AS rule, {r.sign} * (1000 * {r.over} // nullif({r.under}, 0)) AS value FROM base" for k, r in enumerate(RULE_SET))
    steps = ", ".join(f"({t}, {int(x * 1000)})" for t, x in enumerate(STEPS))
    return f"""WITH tab AS MATERIALIZED ({crc32_table()}),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce('=' || lang, '') AS stratum, coalesce(text, '') AS text,
  regexp_extract_all(coalesce(text, ''), '{word}+') AS w FROM documents),
wins AS (SELECT r, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS win FROM d, range(1, len(w) - {WINDOW - 2}) t(i)),
twice AS (SELECT r, i FROM wins QUALIFY count(*) OVER (PARTITION BY r, win) > 1),
again AS (SELECT r, count(DISTINCT i + j) AS n FROM twice, range({WINDOW}) t(j) GROUP BY r),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
dups AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '{word}') GROUP BY r),
base AS MATERIALIZED (SELECT r, doc_id, stratum, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dups.n, 0)::BIGINT AS n_dup_lines, coalesce(again.n, 0)::BIGINT AS n_repeat_words,
  length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_capitals, length(regexp_replace(text, '[^!-/:-@\\[-`{{-~]', '', 'g')) AS n_marks,
  len(list_filter(w, lambda x, i: i > 1 AND x = w[i - 1])) AS n_stutters FROM d LEFT JOIN again USING (r) LEFT JOIN dups USING (r)),
judged AS (SELECT *, n_words < {FEWEST} OR 100 * n_repeat_words > {REPEATED} * n_words AS base_failed FROM base),
marks AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IN (0, 1) GROUP BY doc_id),
taught AS MATERIALIZED (SELECT r, stratum, quality = 1 AS good, {crc32_sql('doc_id::VARCHAR', 'tab')} % {FOLDS} = 0 AS proposes FROM judged JOIN marks USING (doc_id), tab
  WHERE NOT base_failed),
grids AS ({grids}),
steps AS (SELECT * FROM (VALUES {steps}) t(step, share)),
vals AS MATERIALIZED ({values}),
per AS (SELECT t.stratum, g.rule, g.cut, count(*) FILTER (good AND value > cut) AS lost, count(*) FILTER (NOT good AND value > cut) AS caught, count(*) FILTER (good) AS n_good
  FROM taught t JOIN vals v USING (r) JOIN grids g ON g.rule = v.rule WHERE proposes GROUP BY ALL),
picked AS MATERIALIZED (SELECT stratum, step, rule, max(struct_pack(caught := caught, cut := cut)).cut AS cut FROM per, steps
  WHERE caught > 0 AND lost * 1000 <= share * n_good GROUP BY ALL),
tries AS (SELECT DISTINCT stratum, step FROM picked),
held AS (SELECT t.r, t.stratum, step, good, coalesce(bool_or(value > cut), false) AS rejected
  FROM taught t JOIN tries USING (stratum) LEFT JOIN picked p USING (stratum, step) LEFT JOIN vals v ON v.r = t.r AND v.rule = p.rule WHERE NOT proposes GROUP BY ALL),
tested AS (SELECT stratum, step, count(*) FILTER (good) AS n, count(*) FILTER (good AND rejected) AS k, count(*) FILTER (NOT good) AS bad,
  count(*) FILTER (NOT good AND rejected) AS caught FROM held GROUP BY ALL),
tails AS (SELECT *, CASE WHEN k >= n * {LIMIT} THEN 1 ELSE list_sum(list_transform(range(k + 1), lambda i: exp(coalesce(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1), 0)
  + i * ln({LIMIT}) + (n - i) * ln(1 - {LIMIT})))) END AS tail FROM tested),
certain AS (SELECT *, bool_and(tail <= {RISK} / (SELECT count(DISTINCT stratum) FROM taught)) OVER (PARTITION BY stratum ORDER BY step) AS sure FROM tails),
used AS (SELECT stratum, step FROM certain WHERE sure QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY caught * n - {PRICE} * k * bad DESC, step) = 1),
broken AS (SELECT DISTINCT v.r FROM vals v JOIN used USING (stratum) JOIN picked p USING (stratum, step, rule) WHERE value > cut)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND r NOT IN (SELECT r FROM broken) AS kept FROM judged"""
