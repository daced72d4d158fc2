"""Quality rules: a ledger of rule failures as bits, with versioned policies over it.

`ledger` measures every document once and stores each rule's outcome as one bit of
`failure_bits` beside the measurements. A `Policy` is a named, versioned mask of rules;
`apply_policy` is a bitwise AND, so that a new policy needs no second look at the text.
`ablation` says, for each rule of a policy, how many documents it fails, how many only it fails,
and what would be kept without it; it works on one count per distinct bitmask, which both sides
of the shuffle combine, and never on documents.

DataFrame functions only; one pass over the text, no shuffle.

Defined results: null or empty text has no words and one empty line, and fails the rule of least
words. Columns of the input that clash with those made here are replaced. Rows are never merged,
so repeated rows give repeated rows. An empty table gives an empty ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .state import fresh

WHITE = "\t\n\x0b\x0c\r"
SYMBOL = "[#*$%&|<>]"
WINDOW = 5
ALPHA_WORD = r"[^\x20\x09-\x0D\p{L}]*+\p{L}[^\x20\x09-\x0D]*+"  # a word from its first place that leads to a letter
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_alpha_words", "text_chars", "dup_line_chars")

#: (name, SQL condition of failure over the measurements); the place in the list is the bit. Append only.
RULES = [
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("short_mean_word", "word_chars < 2 * n_words"),
    ("long_mean_word", "word_chars > 15 * n_words"),
    ("many_symbols", "10 * n_symbols > n_words"),
    ("duplicate_lines", "n_dup_lines * 10 > 3 * n_lines"),
    ("few_alphabetic_words", "10 * n_alpha_words < 6 * n_words"),
    ("duplicate_line_chars", "100 * dup_line_chars > 20 * text_chars"),
]


@dataclass(frozen=True)
class Policy:
    """The rules that reject a document, under a name and a version."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        bits = {name: 1 << i for i, (name, _) in enumerate(RULES)}
        return sum(bits[r] for r in self.rules)


BASE = Policy("base", 1, ("few_words", "repeated_windows"))
#: Version 2 judges repeated lines by their characters: by their number, one short line that occurs twice in a text of three lines rejected it.
FULL = Policy("full", 2, tuple(name for name, _ in RULES if name != "duplicate_lines"))


def _bind(value: Column, body) -> Column:
    """`body(value)` with `value` computed once: a lambda's variable is not inlined again."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.btrim(text, F.lit(" " + WHITE)), r"[\x20\x09-\x0D]+"), "")


def word_count(text: Column) -> Column:
    """Number of runs of other characters than space and \\t to \\r; null counts as none."""
    return F.coalesce(F.size(words_of(text)).cast("long"), F.lit(0).cast("long"))


def _repeat_words(words: Column) -> Column:
    """Words that lie in a window of WINDOW words which occurs twice or more.

    Windows are compared by 64-bit hashes. Only a text with some repeated window pays for the
    sort that finds the places: places of repeated windows in order, each covering WINDOW words
    but no further than the next.
    """

    def places(h: Column) -> Column:
        # sort_array compares by itself; array_sort would run an expression for every comparison
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.cast("int").alias("i"))))

        def again(s: Column) -> Column:
            double = lambda x, i: ((i > 0) & (x["h"] == F.get(s, i - 1)["h"])) | (x["h"] == F.get(s, i + 1)["h"])
            return F.sort_array(F.transform(F.filter(s, double), lambda x: x["i"]))

        return _bind(pairs, again)

    def covered(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)

    def of(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_bind(places(h), covered))

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(WINDOW)]))

    hashed = F.transform(words, lambda w: F.xxhash64(w))  # each word once, not in every window
    return _bind(hashed, lambda w: F.when(F.size(w) < WINDOW, F.lit(0)).otherwise(_bind(windows(w), of)))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with the columns of MEASURES."""
    body = F.coalesce(F.col(text), F.lit(""))
    docs = docs.drop(*[c for c in docs.columns if c in MEASURES])
    lines = F.filter(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(" " + WHITE)) != "")
    chars = lambda xs: F.aggregate(F.transform(xs, F.length), F.lit(0), lambda n, x: n + x)
    of_words = lambda w: F.struct(F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("chars"), _repeat_words(w).alias("repeats"))
    by_word = fresh("__words", docs.columns)
    out = docs.withColumn(by_word, _bind(words_of(body), of_words))  # words are split once for all that counts them
    made = {
        "n_words": F.col(f"{by_word}.n"),
        "word_chars": F.col(f"{by_word}.chars"),
        "n_symbols": F.regexp_count(body, F.lit(SYMBOL)),
        "n_lines": F.size(F.split(body, "\n")),
        "n_dup_lines": _bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))),
        "n_repeat_words": F.col(f"{by_word}.repeats"),
        "n_alpha_words": F.regexp_count(body, F.lit(ALPHA_WORD)),
        "text_chars": F.length(body),
        "dup_line_chars": _bind(lines, lambda x: chars(x) - chars(F.array_distinct(x))),
    }
    return out.select(*docs.columns, *[made[c].cast("long").alias(c) for c in MEASURES])


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with measurements and `failure_bits`: every rule evaluated once for every row."""
    seen = measure(docs.drop(*[c for c in docs.columns if c == "failure_bits"]), text)
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, rule) in enumerate(RULES)]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return seen.withColumn("failure_bits", total.cast("long"))


def rejected(policy: Policy, bits: str = "failure_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(policy.mask).cast("long")) != 0


def apply_policy(led: DataFrame, policy: Policy, keep: str = "kept") -> DataFrame:
    """`led` with the policy's verdict, its name and version."""
    return led.withColumns({keep: ~rejected(policy), "policy": F.lit(f"{policy.name}@{policy.version}")})


def ablation(led: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of `policy`: rule, n_failed, n_only (failed by no other rule), n_kept_without.

    Masks are first counted (at most 2 ** len(RULES) of them), then expanded by rule.
    """
    masks = led.groupBy(F.col("failure_bits").bitwiseAND(F.lit(policy.mask).cast("long")).alias("m")).agg(F.count(F.lit(1)).alias("n"))
    rules = [F.struct(F.lit(name).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, (name, _) in enumerate(RULES) if name in policy.rules]
    rows = masks.select("m", "n", F.explode(F.array(*rules)).alias("r"))
    n = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long")
    has = F.col("m").bitwiseAND(F.col("r.bit")) != 0
    return rows.groupBy(F.col("r.rule").alias("rule")).agg(
        n(has).alias("n_failed"),
        n(F.col("m") == F.col("r.bit")).alias("n_only"),
        n((F.col("m") == 0) | (F.col("m") == F.col("r.bit"))).alias("n_kept_without"),
    )


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = apply_policy(ledger(docs), FULL)
    return out.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        rejected(BASE).alias("base_failed"),
        "kept",
        "failure_bits",
        "n_lines",
        "n_alpha_words",
        "text_chars",
        "dup_line_chars",
        "policy",
    )


SQL = r"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, list_filter(string_split(translate(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     '), ' '), lambda x: x <> '') AS ws,
             string_split(text, chr(10)) AS ls FROM t),
win AS (SELECT rid, i, list_aggregate(list_slice(ws, i, i + 4), 'string_agg', ' ') AS g
        FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
hit AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT rid, count(DISTINCT i + j) AS n FROM hit, (SELECT unnest(range(0, 5)) AS j) GROUP BY rid),
m AS (SELECT w.rid, doc_id, len(ws)::BIGINT AS n_words, length(translate(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::BIGINT AS word_chars,
             (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
             len(ls)::BIGINT AS n_lines,
             (len(list_filter(ls, lambda x: translate(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13), '') <> '')) - len(list_distinct(list_filter(ls, lambda x: translate(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13), '') <> ''))))::BIGINT AS n_dup_lines,
             coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
             len(list_filter(ws, lambda x: regexp_matches(x, '\p{L}')))::BIGINT AS n_alpha_words,
             length(text)::BIGINT AS text_chars,
             (coalesce(list_sum(list_transform(w.body, lambda x: length(x))), 0) - coalesce(list_sum(list_transform(list_distinct(w.body), lambda x: length(x))), 0))::BIGINT AS dup_line_chars
      FROM (SELECT *, list_filter(ls, lambda x: translate(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13), '') <> '') AS body FROM w) w LEFT JOIN cov ON cov.rid = w.rid),
b AS (SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
      + CASE WHEN word_chars < 2 * n_words THEN 4 ELSE 0 END + CASE WHEN word_chars > 15 * n_words THEN 8 ELSE 0 END
      + CASE WHEN 10 * n_symbols > n_words THEN 16 ELSE 0 END + CASE WHEN n_dup_lines * 10 > 3 * n_lines THEN 32 ELSE 0 END
      + CASE WHEN 10 * n_alpha_words < 6 * n_words THEN 64 ELSE 0 END + CASE WHEN 100 * dup_line_chars > 20 * text_chars THEN 128 ELSE 0 END)::BIGINT AS failure_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failure_bits & 3) <> 0 AS base_failed,
       (failure_bits & 223) = 0 AS kept, failure_bits, n_lines, n_alpha_words, text_chars, dup_line_chars, 'full@2' AS policy FROM b
"""

QUERIES = {"op10_quality_rules": op10_quality_rules}
ORACLES = {"op10_quality_rules": SQL}
