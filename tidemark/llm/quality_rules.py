"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document; the ledger keeps the measurements and a bit for each rule that failed.
A policy is a versioned mask of bits: a document is kept if none of the policy's bits is set.  Changing a policy, or
asking what each rule of it costs, reads the ledger again and never the texts: ablations are bitwise aggregates over
the histogram of masks, which has at most 2 ** rules rows however many documents there are.

All of it is DataFrame expressions on the document's own row: no shuffle, no Python, no dependence between rows.

Words are the runs of ``[^\\x20\\x09-\\x0D]``.  Defined results: a null text has no words (and fails as too short); an
empty table gives no rows; repeated rows and null identifiers are kept; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store

WHITE = " \t\n\x0b\x0c\r"
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8

#: Bit number, name and failing condition over the measurements.
RULES: list[tuple[str, str]] = [
    ("too_few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbol_ratio", "5 * n_symbols > n_words"),
    ("duplicate_lines", "n_dup_lines > 2 AND 100 * n_dup_lines > 30 * n_lines"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 25 * n_words"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
#: Policies by version; a mask never changes once it has been used.
POLICIES = {
    "base": BIT["too_few_words"] | BIT["repeated_windows"],
    "v1": sum(BIT.values()),
}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def _repeat_words(ordered: str) -> Column:
    """Words inside windows whose hash occurs twice or more; ``ordered``: (hash, place) sorted, null if none repeats."""
    s = F.col(ordered)
    last = F.size(s) - 1
    twice = F.filter(s, lambda e, k: (F.get(s, k - 1)["h"] == e["h"]) | ((k < last) & (F.get(s, k + 1)["h"] == e["h"])))
    places = F.sort_array(F.transform(twice, lambda e: e["i"]))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
    step = lambda a, i: F.struct((a["n"] + i + WINDOW - F.greatest(a["upto"], i)).alias("n"), (i + WINDOW).alias("upto"))
    return F.when(s.isNull(), F.lit(0)).otherwise(F.aggregate(places, start, step, lambda a: a["n"]))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the measurements and the columns of ``carry`` as one struct, ``_row``.

    Each step is a projection of its own so that arrays are built once.
    """
    kept = [F.struct(*[store.column(c) for c in carry]).alias("_row")] if carry else []
    text = F.coalesce(store.column(text_col).cast("string"), F.lit(""))
    own = docs.select(store.column(id_col).alias("doc_id"), text.alias("text"), *kept)
    also = ["_row"] if carry else []
    bare = F.col("text")
    for c in WHITE:
        bare = F.replace(bare, F.lit(c), F.lit(""))
    trimmed = F.btrim("text", F.lit(WHITE))
    lines = F.filter(F.split("text", "\n", -1), lambda line: line.rlike(WORD))
    words = own.select(
        "doc_id", *also,
        F.char_length(bare).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES, -1)).alias("words"),
    )
    n = F.size("words")
    window = F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("words", i, WINDOW)))
    hashed = words.select(
        "doc_id", *also, "word_chars", "n_symbols", "lines", n.cast("long").alias("n_words"),
        F.when(n >= WINDOW, window).otherwise(F.array().cast("array<bigint>")).alias("hashes"),
    )
    pairs = F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    ordered = hashed.select(
        "doc_id", *also, "n_words", "word_chars", "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), F.sort_array(pairs)).alias("ordered"),
    )
    return ordered.select("doc_id", *also, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", _repeat_words("ordered").cast("long").alias("n_repeat_words"))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the measurements and fail_bits."""
    bits = F.lit(0)
    for name, condition in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(BIT[name])).otherwise(F.lit(0)))
    return measured(docs, id_col, text_col, carry).withColumn("fail_bits", bits)


def judged(ledger_rows: DataFrame, policy: str) -> DataFrame:
    """The ledger with base_failed and the policy's verdict, kept."""
    failed = lambda mask: F.col("fail_bits").bitwiseAND(F.lit(mask)) != 0
    base = failed(POLICIES["base"])
    return ledger_rows.withColumn("base_failed", base).withColumn("kept", ~base & ~failed(POLICIES[policy]))


def kept_documents(docs: DataFrame, policy: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, that the policy keeps.

    The optimiser would put the rules' whole expression in place of a filter's column, many times over; it leaves one
    that is not deterministic where it is.
    """
    verdicts = judged(ledger(docs, id_col, text_col, tuple(docs.columns)), policy)
    return verdicts.select("_row", (F.col("kept") & (F.monotonically_increasing_id() >= 0)).alias("_keep")).where("_keep").select("_row.*")


def ablations(ledger_rows: DataFrame, policy: str) -> DataFrame:
    """For each rule of the policy: documents that fail it, and those that only it rejects (kept without the rule)."""
    spark, mask = ledger_rows.sparkSession, POLICIES[policy]
    histogram = ledger_rows.groupBy("fail_bits").agg(F.count("*").alias("n"))
    rules = spark.createDataFrame([(name, BIT[name]) for name, _ in RULES if BIT[name] & mask], "rule string, bit int")
    hit = histogram.withColumn("bit", F.explode(F.array(*[F.lit(BIT[name]) for name, _ in RULES if BIT[name] & mask]))).where("fail_bits & bit != 0")
    sums = hit.groupBy("bit").agg(F.sum("n").alias("n_failed"), F.sum(F.when(F.col("fail_bits").bitwiseAND(F.lit(mask)) == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"))
    return F.broadcast(rules).join(sums, "bit", "left").select("rule", "bit", F.coalesce("n_failed", F.lit(0)).alias("n_failed"), F.coalesce("n_only", F.lit(0)).alias("n_only"))


def oracle(policy: str) -> str:
    """DuckDB SQL for the judged ledger over ``documents``."""
    bits = " + ".join(f"CASE WHEN {condition} THEN {BIT[name]} ELSE 0 END" for name, condition in RULES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '{WORD}+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM d),
win AS (SELECT rid, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS win FROM w, unnest(range(1, len(words) - {WINDOW - 2})) AS t(i)),
rep AS (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW}))) AS n FROM rep GROUP BY rid),
m AS (SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, len(regexp_extract_all(text, '{SYMBOLS}')) AS n_symbols,
             len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN cov USING (rid)),
l AS (SELECT *, CAST({bits} AS INTEGER) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, fail_bits,
       fail_bits & {POLICIES['base']} <> 0 AS base_failed, fail_bits & {POLICIES['base'] | POLICIES[policy]} = 0 AS kept FROM l"""
