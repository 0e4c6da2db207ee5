"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

Base counts (words, symbols, repeated lines and windows) are computed for every document. The
further rules are independent of each other, so their order changes the cost but never the
verdict: each is timed on a bounded sample, and the one that rejects most per second comes
first. A CASE expression stops at the first rule that rejects.

Defined cases: null text has no words and fails the base test; empty tables give empty results;
repeated rows are judged each by itself; ties in rejection per cost keep the order of `RULES`;
further columns are left alone, columns with the names of the results are replaced.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import let

#: words per window of the repetition test
WINDOW = 8
#: rows of the sample on which rules are timed
SAMPLE_ROWS = 2_000


@dataclass(frozen=True)
class Rule:
    """`rejects` is an SQL condition over `text` and the base counts, true for bad documents."""

    name: str
    rejects: str


RULES = (
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("word_length", "word_chars < 3 * n_words or word_chars > 10 * n_words"),
    Rule("repeated_lines", "2 * n_dup_lines > size(split(text, '\\n'))"),
    Rule(
        "shouting",
        r"2 * length(regexp_replace(text, '[^\\p{Lu}]+', ''))"
        r" > length(regexp_replace(text, '[^\\p{L}]+', ''))",
    ),
    Rule(
        "wordless",
        r"5 * size(regexp_extract_all(text, '([^\\x20\\x09-\\x0D]*\\p{L}[^\\x20\\x09-\\x0D]*)', 1))"
        " < 4 * n_words",
    ),
    Rule("ellipses", r"10 * size(regexp_extract_all(text, '(\\.\\.\\.|…)', 1)) > 3 * n_words"),
)


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def repeated_words(of: Column, window: int = WINDOW) -> Column:
    """Number of words inside windows that occur twice or more; n log n in the words.

    Windows are compared by 64-bit hashes within one document.
    """
    starts = F.sequence(F.lit(0), F.size(of) - window)
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(of, i + 1, F.lit(window))))

    def covered(p: Column) -> Column:
        steps = F.sequence(F.lit(1), F.size(p) - 1)
        more = F.aggregate(
            steps, F.lit(window),
            lambda a, k: a + F.least(F.lit(window), F.get(p, k) - F.get(p, k - 1)),
        )
        return F.when(F.size(p) > 1, more).otherwise(F.lit(0))

    def positions(s: Column) -> Column:
        def same(x, j):
            return F.get(s, j)["h"].eqNullSafe(x["h"])

        repeated = F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1))
        return F.sort_array(F.transform(repeated, lambda x: x["i"]))

    def count(h: Column) -> Column:
        pairs = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        some = let(let(F.sort_array(pairs), positions), covered)
        return F.when(F.size(F.array_distinct(h)) < F.size(h), some).otherwise(F.lit(0))

    return F.when(F.size(of) > window, let(hashes, count)).otherwise(F.lit(0))


def base_counts(docs: DataFrame) -> DataFrame:
    """The documents with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counts = let(
        words(text),
        lambda w: F.struct(F.size(w).alias("n_words"), repeated_words(w).alias("n_repeat_words")),
    )
    dup = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    fields = docs.select("*", text.alias("_text"), counts.alias("_counts"), dup.alias("_dup"))
    n, r = F.col("_counts.n_words"), F.col("_counts.n_repeat_words")
    chars = F.length("_text")
    return fields.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.length(F.translate("_text", " \t\n\x0b\x0c\r", "")).cast("long"),
            "n_symbols": (chars - F.length(F.translate("_text", "#*$%&|<>", ""))).cast("long"),
            "n_dup_lines": F.col("_dup").cast("long"),
            "n_repeat_words": r.cast("long"),
            "base_failed": (n < 20) | (F.lit(100) * r > F.lit(30) * n),
        }
    ).drop("_text", "_counts", "_dup")


def order_rules(docs: DataFrame, rules=RULES, rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules by rejected rows per second on a sample of the documents that passed the base test."""
    total = docs.count()
    if not total:
        return list(rules)
    sample = base_counts(docs.sample(min(1.0, rows / total), seed=7)).filter(~F.col("base_failed"))
    sample = sample.persist()
    try:
        sample.count()

        def run(condition: str) -> tuple[int, float]:
            start = time.perf_counter()
            rejected = sample.agg(F.count_if(F.expr(condition))).first()[0]
            return rejected, time.perf_counter() - start

        run("text is null")
        _, floor = run("text is null")
        rate = {}
        for rule in rules:
            rejected, seconds = run(rule.rejects)
            rate[rule] = rejected / max(seconds - floor, 1e-3)
    finally:
        sample.unpersist()
    return sorted(rules, key=lambda rule: -rate[rule])


def verdict(rules) -> Column:
    """kept: false at the first rule that rejects."""
    kept = F.when(F.col("base_failed"), False)
    for rule in rules:
        kept = kept.when(F.expr(rule.rejects), False)
    return kept.otherwise(True)


def judge(docs: DataFrame, rules=RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents with base counts and `kept`."""
    ordered = order_rules(docs, rules, sample_rows)
    return base_counts(docs).withColumn("kept", verdict(ordered))


#: SELECT of doc_id, the base counts and kept for a relation `docs` of (doc_id, text)
SQL = r"""
w as (select rid, doc_id, coalesce(text, '') as text,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws,
    list_filter(string_split(coalesce(text, ''), chr(10)),
        lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls
  from (select row_number() over () as rid, doc_id, text from docs)),
p as (select rid, unnest(generate_series(1, len(ws) - 7)) as i,
    unnest(list_transform(generate_series(1, len(ws) - 7),
      lambda k: array_to_string(ws[k:k + 7], ' '))) as t
  from w where len(ws) >= 8),
g as (select rid, i, count(*) over (partition by rid, t) as c from p),
r as (select rid, count(distinct i + k) as n from g, generate_series(0, 7) as s(k)
  where c > 1 group by rid),
b as (select w.doc_id, w.text, len(ws)::bigint as n_words,
    length(regexp_replace(w.text, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars,
    (length(w.text) - length(regexp_replace(w.text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines,
    coalesce(r.n, 0)::bigint as n_repeat_words
  from w left join r using (rid)),
f as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from b)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or 10 * n_symbols > n_words
    or word_chars < 3 * n_words or word_chars > 10 * n_words
    or 2 * n_dup_lines > len(string_split(text, chr(10)))
    or 2 * length(regexp_replace(text, '[^\p{Lu}]+', '', 'g'))
      > length(regexp_replace(text, '[^\p{L}]+', '', 'g'))
    or 5 * len(regexp_extract_all(text, '[^\x20\x09-\x0D]*\p{L}[^\x20\x09-\x0D]*')) < 4 * n_words
    or 10 * len(regexp_extract_all(text, '\.\.\.|…')) > 3 * n_words) as kept
from f
"""
