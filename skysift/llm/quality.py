"""Rule bitmask ledger: every rule is evaluated once, policies and ablations work on the stored bits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5

#: Bit number of each rule. A rule is a condition under which a document fails.
RULES = ["few_words", "repeated_words", "symbol_ratio", "exclamation_ratio", "upper_ratio", "word_length", "duplicate_lines"]
#: Version -> the rules that a policy applies. Policies read the ledger; none of them reads texts.
POLICIES = {
    "base": ["few_words", "repeated_words"],
    "v1": ["few_words", "repeated_words", "symbol_ratio", "exclamation_ratio", "upper_ratio", "word_length", "duplicate_lines"],
}


def mask(rules: list[str]) -> int:
    return sum(1 << RULES.index(r) for r in rules)


def _repeat_words(windows: Column) -> Column:
    """Words in windows that occur twice or more: sort windows with their places, keep equal neighbours, add up the covered words."""
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))

    def covered(s: Column) -> Column:
        twin = F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
        places = F.sort_array(F.transform(twin, lambda x: x["p"]))
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
        return F.aggregate(places, start, lambda a, p: F.struct((a["n"] + F.least(p - a["last"], F.lit(WINDOW))).alias("n"), p.alias("last")), lambda a: a["n"])

    # transform over a one-element array binds the sorted array to a variable, so that it is built once
    return F.element_at(F.transform(F.array(placed), covered), 1)


def ledger(docs: DataFrame) -> DataFrame:
    """docs (text, ...) -> the same columns, the measurements, and fail_bits (long): bit i is set if RULES[i] fails.

    Words are runs of characters other than space and \\t \\n \\v \\f \\r; a null text counts as empty and fails few_words. Measurements: n_words,
    word_chars, n_symbols, n_dup_lines, n_repeat_words, n_exclaims, n_upper, n_chars_read (all long). Existing columns of these names are replaced,
    names that begin with __sky are reserved, other extra columns pass through. All rows stay, repeated ones too; an empty table gives an empty one.
    Native expressions only; one pass, no shuffle."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_exclaims", "n_upper", "n_chars_read", "fail_bits"]
    text = F.coalesce("text", F.lit(""))
    d = docs.drop(*names).withColumns({"__sky_w": F.array_remove(F.split(text, SPACE), ""), "__sky_l": F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    d = d.withColumn("__sky_h", F.transform(F.slice("__sky_w", 1, F.greatest(F.size("__sky_w") - (WINDOW - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *(F.get("__sky_w", i + k) for k in range(1, WINDOW)))))
    d = d.withColumns({
        "n_words": F.size("__sky_w").cast("long"),
        "word_chars": F.length(F.array_join("__sky_w", "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": (F.size("__sky_l") - F.size(F.array_distinct("__sky_l"))).cast("long"),
        "__sky_lines": F.size("__sky_l"),
        "n_repeat_words": F.when(F.size(F.array_distinct("__sky_h")) < F.size("__sky_h"), _repeat_words(F.col("__sky_h"))).otherwise(F.lit(0)).cast("long"),
        "n_exclaims": F.regexp_count(text, F.lit("!")).cast("long"),
        "n_upper": F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long"),
        "n_chars_read": F.length(text).cast("long"),
    })
    fails = {
        "few_words": F.col("n_words") < 10,
        "repeated_words": 100 * F.col("n_repeat_words") > 20 * F.col("n_words"),
        "symbol_ratio": 10 * F.col("n_symbols") > F.col("n_words"),
        "exclamation_ratio": 4 * F.col("n_exclaims") > F.col("n_words"),
        "upper_ratio": 5 * F.col("n_upper") > 2 * F.col("n_chars_read"),
        "word_length": (F.col("word_chars") > 16 * F.col("n_words")) | (F.col("word_chars") < 2 * F.col("n_words")),
        "duplicate_lines": 2 * F.col("n_dup_lines") > F.col("__sky_lines"),
    }
    bits = F.lit(0).cast("long")
    for i, r in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(fails[r], F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    # the row number keeps filters on fail_bits above this projection: pushed below, they would evaluate every rule again
    return d.withColumn("fail_bits", F.when(F.monotonically_increasing_id() >= 0, bits)).drop("__sky_w", "__sky_l", "__sky_h", "__sky_lines")


def passes(version: str) -> Column:
    """Whether a row of the ledger passes a policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES[version])).cast("long")) == 0


def ablation(rows: DataFrame, version: str) -> DataFrame:
    """ledger -> (rule, failed, failed_only_here, kept_without): what each rule of a policy does, from counts per bit pattern (at most 2**rules rows)."""
    patterns = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES[version])).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(1 << RULES.index(r)).cast("long").alias("bit")) for r in POLICIES[version])))
    p = patterns.select("bits", "n", rules.alias("r")).select("bits", "n", "r.rule", "r.bit")
    return p.groupBy("rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("failed_only_here"),
        F.sum(F.when(F.col("bits").bitwiseAND(F.bitwise_not("bit")) == 0, F.col("n")).otherwise(0)).alias("kept_without"),
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of every document with the base verdict and policy v1's."""
    rows = ledger(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~passes("base")).alias("base_failed"), passes("v1").alias("kept"), "fail_bits",
    )


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT rid, doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d
), g AS (
  SELECT rid, i, list_slice(ws, i, i + 4) AS win FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)
), rep AS (
  SELECT rid, i FROM g JOIN (SELECT rid, win FROM g GROUP BY ALL HAVING count(*) > 1) USING (rid, win)
), cov AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest(range(0, 5)) AS k) GROUP BY rid
), m AS (
  SELECT doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
         length(regexp_replace(t, '[^!]', '', 'g')) AS ex, length(regexp_replace(t, '\P{Lu}', '', 'g')) AS up, length(t) AS chars, len(ls) AS lines
  FROM w LEFT JOIN cov USING (rid)
), f AS (
  SELECT *, (n_words < 10)::BIGINT + 2 * (100 * n_repeat_words > 20 * n_words)::BIGINT + 4 * (10 * n_symbols > n_words)::BIGINT
    + 8 * (4 * ex > n_words)::BIGINT + 16 * (5 * up > 2 * chars)::BIGINT
    + 32 * (word_chars > 16 * n_words OR word_chars < 2 * n_words)::BIGINT + 64 * (2 * n_dup_lines > lines)::BIGINT AS fail_bits FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM f
"""
