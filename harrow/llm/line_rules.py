"""Quality rules: per-text counts, and lines that too many documents of a host share.

Everything is a column expression or a join. A line is normalised (lower case, white space as
one space, trimmed) and hashed; the number of different texts that hold it is counted for each host. A line above the
limit goes from every document but the first that holds it, and a document left with too little is
rejected. The limit is a number of texts, the same for hosts of every size. Exact copies of a text count once, so copying a good document does not condemn its lines.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.llm.common import WORD, column_names, text_or_empty
from harrow.operators.lookup import lookup_join
from harrow.runtime import stabilise

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]+"
# Different texts of a host that may share a line
LIMIT = 5


@dataclass(frozen=True)
class Limits:
    """``min_words``, ``max_repeat_percent``: of the base rules. A line is shared too widely in more than ``line_texts``
    different texts of a host. A document is depleted with fewer than ``min_words`` words left or less than ``min_left_percent`` of its words."""

    min_words: int = 10
    max_repeat_percent: int = 20
    line_texts: int = LIMIT
    min_left_percent: int = 30


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def _shifted(values: Column, by: int) -> Column:
    # a length past the end stands for the rest
    return F.slice(values, by + 1, 1 << 30)


def _window_hashes(words: Column) -> Column:
    """Hash of each window of five words; empty with fewer."""

    def five(one: Column, four: Column) -> Column:
        whole = F.slice(four, F.lit(1), F.greatest(F.size(one) - 4, F.lit(0)))
        return F.zip_with(whole, _shifted(one, 4), lambda a, b: F.xxhash64(a, b))

    # two, then four, then five words: each step pairs an array with itself moved on
    return _let(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda one: _let(_two(one, 1), lambda two: _let(_two(two, 2), lambda four: five(one, four))),
    )


def _two(values: Column, apart: int) -> Column:
    return F.zip_with(values, _shifted(values, apart), lambda a, b: F.xxhash64(a, b))


def _covered(hashes: Column) -> Column:
    """Words inside windows that occur twice or more: each repeated start adds up to five, less what the one before covers."""
    none = F.struct(F.lit(None).cast("bigint").alias("h"), F.lit(None).cast("int").alias("i"))

    def near(pairs: Column) -> Column:
        return F.zip_with(
            F.zip_with(pairs, F.concat(F.array(none), pairs), lambda own, last: F.struct(own.alias("own"), last["h"].alias("last"))),
            _shifted(pairs, 1),
            lambda x, following: F.struct(x["own"].alias("own"), x["last"].alias("last"), following["h"].alias("next")),
        )

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    starts = F.sort_array(
        F.transform(
            F.filter(_let(pairs, near), lambda x: x["own"].isNotNull() & ((x["own"]["h"] == x["last"]) | (x["own"]["h"] == x["next"]))),
            lambda x: x["own"]["i"],
        )
    )
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-5).alias("end"))
    return F.aggregate(
        starts,
        zero,
        lambda acc, i: F.struct((acc["n"] + F.least(F.lit(5), i - acc["end"])).cast("bigint").alias("n"), i.alias("end")),
        lambda acc: acc["n"],
    )


def base_counts(docs: DataFrame, text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """``docs`` with ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``, ``base_failed``.

    A null text has none of anything and fails. The names must be free in ``docs``.
    """
    words, hashes, lines = column_names(docs, "words", "hashes", "lines")
    own = text_or_empty(text)
    symbols = F.length(own) - F.length(F.regexp_replace(own, SYMBOLS, ""))
    kept = F.filter(F.split(own, "\n"), lambda line: line.rlike(WORD))
    out = (
        docs.withColumn(words, _words(own))
        .withColumn(lines, kept)
        .withColumn(hashes, _window_hashes(F.col(words)))
        .withColumn("n_words", F.size(words).cast("long"))
        .withColumn("word_chars", F.length(F.regexp_replace(own, SPACE, "")).cast("long"))
        .withColumn("n_symbols", symbols.cast("long"))
        .withColumn("n_dup_lines", (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"))
        .withColumn(
            "n_repeat_words",
            F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), _covered(F.col(hashes))).otherwise(F.lit(0)).cast("long"),
        )
        .drop(words, hashes, lines)
    )
    failed = (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.max_repeat_percent * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), SPACE, " "))


def _lines(docs: DataFrame, host: str, text: str, *more: Column) -> DataFrame:
    """One row for each line with a word: host, line hash, words, and ``more``."""
    kept = F.filter(F.split(text_or_empty(text), "\n"), lambda line: line.rlike(WORD))
    return docs.select(F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), *more, F.explode(kept).alias("line")).select(
        "host", *[c.alias(n) if n else c for c, n in ((F.col("text_hash"), None), (F.col("doc_id"), None))],
        F.xxhash64(normalised(F.col("line"))).alias("line"), F.size(_words(F.col("line"))).cast("long").alias("words"),
    )


def _shared(lines: DataFrame, limits: Limits) -> DataFrame:
    return (
        lines.groupBy("host", "line", "text_hash").agg(F.min("doc_id").alias("first_doc"))
        .groupBy("host", "line").agg(F.count("*").alias("texts"), F.min("first_doc").alias("first_doc"))
        .filter(F.col("texts") > limits.line_texts)
    )


def shared_lines(docs: DataFrame, limits: Limits = Limits(), host: str = "source", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(``host``, ``line`` hash, ``texts``, ``first_doc``): lines in too many different texts of a host. A null host is the empty one."""
    return _shared(_lines(docs, host, text, F.xxhash64(text_or_empty(text)).alias("text_hash"), F.col(doc_id).cast("long").alias("doc_id")), limits)


def judge(docs: DataFrame, limits: Limits = Limits(), host: str = "source", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``host``, ``text_hash``, the base counts, ``base_failed``, ``removed_words``, ``kept``, ``shared_lines``
    (hashes of the lines that go, null if none).

    Repeated rows (same id, host and text) get the same verdict each. Null and empty texts fail the base rules.
    """
    key = F.xxhash64(text_or_empty(text)).alias("text_hash")
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"),
        key, F.col(text).alias("text"),
    )
    counted = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    base = base_counts(rows, "text", limits).groupBy("doc_id", "host", "text_hash").agg(
        F.count("*").alias("rows"), *[F.first(c).alias(c) for c in counted]
    )
    # hashes and word counts, written once: the texts are cut into lines one time
    lines = stabilise(_lines(rows, "host", "text", F.col("text_hash"), F.col("doc_id")))
    shared = stabilise(_shared(lines, limits).select("host", "line", "first_doc"))
    lost = (
        lookup_join(lines, shared, ["host", "line"], "inner")
        .filter(~F.col("doc_id").eqNullSafe(F.col("first_doc")))
        .groupBy(F.col("doc_id").alias("d"), F.col("host").alias("h"), F.col("text_hash").alias("t"))
        .agg(F.sum("words").alias("lost"), F.collect_set("line").alias("shared_lines"))
    )
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("host") == F.col("h")) & (F.col("text_hash") == F.col("t"))
    left = F.col("n_words") - F.col("removed_words")
    enough = (left >= limits.min_words) & (100 * left >= limits.min_left_percent * F.col("n_words"))
    return (
        base.join(lost, same, "left")
        .withColumn("removed_words", F.coalesce((F.col("lost") / F.col("rows")).cast("long"), F.lit(0).cast("long")))
        .withColumn("kept", ~F.col("base_failed") & enough)
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
        .select("doc_id", "host", "text_hash", *counted, "removed_words", "kept", "shared_lines")
    )


def keep_good(docs: DataFrame, limits: Limits = Limits(), host: str = "source", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rejected rows and without the lines that go."""
    found, at, key, gone = column_names(docs, "found", "at", "key", "gone")
    good = judge(docs, limits, host, doc_id, text).filter("kept").select(
        F.col("doc_id").alias(found), F.col("host").alias(at), F.col("text_hash").alias(key), F.col("shared_lines").alias(gone)
    ).dropDuplicates([found, at, key])
    same = (
        F.col(doc_id).cast("long").eqNullSafe(F.col(found))
        & (F.coalesce(F.col(host).cast("string"), F.lit("")) == F.col(at))
        & (F.xxhash64(text_or_empty(text)) == F.col(key))
    )
    left = F.filter(
        F.split(F.col(text), "\n"), lambda line: ~(line.rlike(WORD) & F.array_contains(F.col(gone), F.xxhash64(normalised(line))))
    )
    cleaned = F.when(F.col(gone).isNull(), F.col(text)).otherwise(F.array_join(left, "\n"))
    return docs.join(good, same).withColumn(text, cleaned).select(*docs.columns)


# The same rules as SQL text: lines are compared themselves instead of their hashes.
JUDGE_SQL = r"""
with d as (select doc_id, coalesce(source, '') as host, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d),
g as (select doc_id, unnest(range(len(words) - 4)) as i, words from w where len(words) >= 5),
r as (select doc_id, i, count(*) over (partition by doc_id, array_to_string(words[i+1:i+5], ' ')) as n from g),
c as (select doc_id, count(distinct p) as n_repeat_words from (select doc_id, unnest(range(i, i + 5)) as p from r where n > 1) group by 1),
b as (select w.doc_id, host, text, lines, len(words)::bigint as n_words,
  length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
  (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words
  from w left join c on w.doc_id = c.doc_id),
u as (select doc_id, host, text, unnest(lines) as raw from b),
l as (select doc_id, host, text, trim(regexp_replace(lower(raw), '[\x20\x09-\x0D]+', ' ', 'g')) as line,
  len(regexp_extract_all(raw, '[^\x20\x09-\x0D]+')) as words from u),
s as (select host, line, min(doc_id) as first_doc, count(distinct text) as texts from l group by 1, 2),
x as (select * from s where texts > {line_texts}),
t as (select doc_id, sum(words)::bigint as removed_words from l join x on l.host = x.host and l.line = x.line where doc_id <> first_doc group by 1),
f as (select b.*, coalesce(removed_words, 0)::bigint as removed_words,
  n_words < {min_words} or 100 * n_repeat_words > {max_repeat_percent} * n_words as base_failed from b left join t on b.doc_id = t.doc_id)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, removed_words,
  not base_failed and n_words - removed_words >= {min_words} and 100 * (n_words - removed_words) >= {min_left_percent} * n_words as kept
from f
"""


def judge_sql(limits: Limits = Limits()) -> str:
    out = JUDGE_SQL
    for name, value in vars(limits).items():
        out = out.replace("{%s}" % name, str(value))
    return out
