"""Quality rules as a short-circuit cascade, in SQL functions only.

Every rule is an expression over the text that is true where the rule rejects. On a sample each
rule is timed alone and the rejections of all rules are counted together; the rules then stand in a
CASE expression, each next one that which rejects most of what the earlier ones left per cost, so
most bad texts meet a cheap rule first and dear rules see only the rest. The verdict doesn't depend
on the order. ``keep`` filters so; ``judge``, which returns the measures of every text, computes each
measure once and lets the cascade read them.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, functions as F

from ringsight.llm.common import SPACES, WORD, free_name, let, stored, whole_text

SAMPLE_ROWS = 2_000
RUNS, LEAST_SECONDS = (3, 8), 0.3  # timed runs of a rule, at least and at most, and how long they should take together
LEAST_COST = 1e-3  # seconds; less can't be told from the noise of a job
SEED = 31
WINDOW = 5
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

FEW_WORDS = 10
REPEATED = 20  # percent of words in repeated windows
SYMBOL_SHARE = 10  # symbols, in percent of the words
DUP_LINES = 30  # percent of lines equal to an earlier one
SHOUTING = 50  # percent of word characters that are A-Z
WORD_LENGTH = (2, 15)  # mean characters of a word


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def word_chars(text: Column) -> Column:
    return F.length(_without(text, SPACES))


def n_symbols(text: Column) -> Column:
    return F.length(text) - F.length(_without(text, SYMBOLS))


def n_upper(text: Column) -> Column:
    return F.length(text) - F.length(_without(text, UPPER))


def lines_of(text: Column) -> Column:
    """Lines with a word."""
    return F.filter(F.split(text, "\n", -1), lambda x: F.length(_without(x, SPACES)) > 0)


def _windows(words: Column) -> Column:
    """Hash of the words from each place on; 64 bits each, compared within one text only."""
    hashed = lambda w: F.transform(
        F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(WINDOW)])
    )
    return let(words, lambda w: F.when(F.size(w) >= WINDOW, hashed(w)).otherwise(F.array().cast("array<bigint>")))


def _covered(windows: Column) -> Column:
    """Words inside a window found twice or more, first one included.

    Windows are sorted by hash and place; those with an equal neighbour are repeated. Each
    repeated window adds the words that the one before it doesn't hold.
    """
    ranked = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    hash_at = lambda r, i: F.get(r, i)["h"]

    def repeated(r: Column) -> Column:
        places = F.transform(r, lambda x, i: F.when((x["h"] == hash_at(r, i - 1)) | (x["h"] == hash_at(r, i + 1)), x["i"]))
        return F.array_compact(places)

    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("bigint").alias("sum"))
    return F.aggregate(
        F.sort_array(let(ranked, repeated)), start,
        lambda acc, i: F.struct(i.alias("last"), (acc["sum"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("sum")),
        lambda acc: acc["sum"],
    )


def n_repeat_words(windows: Column) -> Column:
    """Most texts repeat no window: counting distinct hashes tells those apart."""
    none = lambda v: F.size(F.array_distinct(v)) == F.size(v)
    return let(windows, lambda v: F.when(none(v), F.lit(0).cast("bigint")).otherwise(_covered(v)))


def rules(text: Column) -> dict[str, Column]:
    """Where each rule rejects."""
    words = F.size(words_of(text))
    repeats = lambda w: n_repeat_words(_windows(w)) * 100 > F.size(w) * REPEATED
    return {
        "few_words": words < FEW_WORDS,
        "repeats": let(words_of(text), repeats),
        "symbols": n_symbols(text) * 100 > SYMBOL_SHARE * words,
        "duplicate_lines": let(lines_of(text), lambda v: (F.size(v) - F.size(F.array_distinct(v))) * 100 > F.size(v) * DUP_LINES),
        "shouting": n_upper(text) * 100 > SHOUTING * word_chars(text),
        "word_length": ~word_chars(text).between(F.lit(WORD_LENGTH[0]) * words, F.lit(WORD_LENGTH[1]) * words),
    }


def rules_of_measures(words: Column, chars: Column, symbols: Column, upper: Column, lines: Column, dup: Column, repeat: Column) -> dict[str, Column]:
    """The same rules where the measures are known."""
    return {
        "few_words": words < FEW_WORDS, "repeats": repeat * 100 > words * REPEATED, "symbols": symbols * 100 > SYMBOL_SHARE * words,
        "duplicate_lines": dup * 100 > lines * DUP_LINES, "shouting": upper * 100 > SHOUTING * chars,
        "word_length": ~chars.between(F.lit(WORD_LENGTH[0]) * words, F.lit(WORD_LENGTH[1]) * words),
    }


def ordered(cost: dict[str, float], met: list[tuple[frozenset[str], int]]) -> list[str]:
    """Rules by rejections per cost among the rows that earlier rules left; ``met``: rejecting rules and number of rows."""
    order: list[str] = []
    while len(order) < len(cost):
        left = [(names, n) for names, n in met if names.isdisjoint(order)]
        gain = {k: sum(n for names, n in left if k in names) / cost[k] for k in cost if k not in order}
        order.append(min(gain, key=lambda k: (-gain[k], cost[k], k)))
    return order


def rank(docs: DataFrame, reject: dict[str, Column], text: str) -> list[str]:
    """Rule names in the order of the cascade, from a sample of about SAMPLE_ROWS rows of ``docs``."""
    total = docs.count()
    part = min(1.0, SAMPLE_ROWS / max(total, 1))
    drawn = stored(docs.where(F.pmod(F.xxhash64(F.lit(SEED), text), F.lit(1 << 20)) < int(part * (1 << 20)) + 1).select(text))

    def seconds(c: Column) -> float:
        """The least time of some runs; the first also compiles, and short ones are repeated more often."""
        took: list[float] = []
        while len(took) < RUNS[0] or (sum(took[1:]) < LEAST_SECONDS and len(took) < RUNS[1]):
            start = time.perf_counter()
            drawn.agg(F.sum(c.cast("int"))).first()
            took.append(time.perf_counter() - start)
        return min(took)

    empty = seconds(F.length(text) < 0)
    cost = {name: max(seconds(c) - empty, LEAST_COST) for name, c in reject.items()}
    flags = drawn.select(*[F.coalesce(c, F.lit(False)).alias(name) for name, c in reject.items()])
    met = flags.groupBy(*reject).agg(F.count(F.lit(1)).alias("_n")).collect()  # one row per set of rules
    return ordered(cost, [(frozenset(k for k in reject if r[k]), r["_n"]) for r in met])


def cascade(docs: DataFrame, reject: dict[str, Column], order: list[str], name: str) -> DataFrame:
    """``docs`` with the verdict ``name``: false from the first rule on that rejects."""
    chain = None
    for rule in order:
        hit = F.coalesce(reject[rule], F.lit(False))
        chain = F.when(hit, F.lit(False)) if chain is None else chain.when(hit, F.lit(False))
    return docs.withColumn(name, F.lit(True) if chain is None else chain.otherwise(F.lit(True)))


def keep(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, all columns kept. A rule is computed only where those before it passed.

    Null and empty texts are rejected; repeated rows share their fate.
    """
    text, verdict = free_name(docs, "_text"), free_name(docs, "_kept")
    given = docs.withColumn(text, whole_text())
    reject = rules(F.col(text))
    return cascade(given, reject, rank(given, reject, text), verdict).where(F.col(verdict)).select(*docs.columns)


def judge(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: the measures, ``base_failed`` and ``kept``, the cascade's verdict.

    A null or empty text has no words, fails the base rule and is not kept. Repeated rows give
    equal rows; a null doc_id is carried through. Other columns are ignored.
    """
    given = docs.select(docs["doc_id"].alias("doc_id"), whole_text().alias("text"))
    text = F.col("text")
    order = rank(given, rules(text), "text")
    big = lambda c: c.cast("bigint")
    parts = given.withColumns({"_words": words_of(text), "_lines": lines_of(text)})
    measured = parts.select(
        "doc_id", big(F.size("_words")).alias("n_words"), big(word_chars(text)).alias("word_chars"), big(n_symbols(text)).alias("n_symbols"),
        big(F.size("_lines")).alias("n_lines"), big(F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        n_repeat_words(_windows(F.col("_words"))).alias("n_repeat_words"), big(n_upper(text)).alias("n_upper"),
    )
    names = ("n_words", "word_chars", "n_symbols", "n_upper", "n_lines", "n_dup_lines", "n_repeat_words")
    reject = rules_of_measures(*[F.col(c) for c in names])
    failed = reject["few_words"] | reject["repeats"]
    return cascade(measured, reject, order, "kept").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "kept"
    )


RULES_SQL = f"""with t as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
w as (select r, doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as ws,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as ls from t),
g as (select r, i, array_to_string(ws[i:i+{WINDOW - 1}], ' ') as g from (select r, ws, unnest(range(1, len(ws) - {WINDOW - 2})) as i from w)),
d as (select r, i from g qualify count(*) over (partition by r, g) > 1),
c as (select r, sum(least({WINDOW}, i - prev)) as n from (select r, i, coalesce(lag(i) over (partition by r order by i), i - {WINDOW}) as prev from d) group by r),
m as (select doc_id, len(ws)::bigint as n_words, list_sum(list_transform(ws, lambda x: length(x)))::bigint as wc,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines,
  coalesce(n, 0)::bigint as n_repeat_words, len(ls) as n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g')) as up from w left join c using (r)),
f as (select doc_id, n_words, coalesce(wc, 0)::bigint as word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < {FEW_WORDS} or 100 * n_repeat_words > {REPEATED} * n_words) as base_failed, n_lines, up from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or n_symbols * 100 > {SYMBOL_SHARE} * n_words or n_dup_lines * 100 > {DUP_LINES} * n_lines
    or up * 100 > {SHOUTING} * word_chars or word_chars < {WORD_LENGTH[0]} * n_words or word_chars > {WORD_LENGTH[1]} * n_words) as kept
from f"""
