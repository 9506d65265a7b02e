r"""Quality rules (operator 4): a threshold table compiled into Spark projections.

``RULES`` names a ratio, its SQL text and the closed range in which it may lie. The SQL
runs in Spark and in DuckDB, so one table serves the operator and its oracle.
``apply_rules`` adds the measured counts, one verdict per document and the names of the
rules that failed. Only built-in functions run; there is no shuffle.

Words are the runs of ``[^\x20\x09-\x0D]``; lines are split at ``\n`` and count when they
hold a word. Defined results: a null or empty text has no words, all counts 0, fails
``base_failed`` and is not kept. Ratios with a zero divisor are 0. Repeated rows each get
their own, equal verdict. Other columns pass through; output columns replace input columns
of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abode.llm.columns import ROW, carried, kept, restored

# Common function words of English, French, German and Spanish.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "for", "it", "as", "with", "was", "on", "be", "by", "at", "or", "an", "this",
    "le", "la", "les", "de", "des", "du", "et", "en", "un", "une", "que", "qui", "dans", "pour", "par", "sur", "au", "est",
    "der", "die", "das", "und", "den", "von", "zu", "mit", "dem", "im", "ein", "eine", "nicht", "auf", "ist", "als",
    "el", "los", "las", "y", "del", "se", "con", "su", "al", "lo", "para", "es",
)

# Fixed values of the base rule.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

# (rule, SQL of the ratio over the counts, least, most); None: no limit on that side.
RULES = (
    ("word_length", "word_chars / greatest(n_words, 1)", 2.0, 15.0),
    ("symbol_words", "n_symbols / greatest(n_words, 1)", None, 0.10),
    ("exclamations", "n_exclaims / greatest(n_words, 1)", None, 0.25),
    ("upper_case", "n_upper_words / greatest(n_words, 1)", None, 0.40),
    ("stop_words", "n_stop_words / greatest(n_words, 1)", 0.02, None),
    ("repeated_lines", "n_dup_lines / greatest(n_lines, 1)", None, 0.50),
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_exclaims", "n_upper_words", "n_stop_words", "n_lines",
          "n_dup_lines", "n_repeat_words")
SPACE = r"[\x20\x09-\x0D]+"


def base_failed_sql() -> str:
    return f"(n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)"


def rule_failed_sql(rule) -> str:
    _, ratio, least, most = rule
    tests = [f"CAST({ratio} AS DOUBLE) < CAST({least} AS DOUBLE)"] * (least is not None)
    tests += [f"CAST({ratio} AS DOUBLE) > CAST({most} AS DOUBLE)"] * (most is not None)
    return "(" + " OR ".join(tests) + ")"


def _windows(words: str) -> Column:
    """(three-word window, 1-based start) of every window, sorted by window."""
    def at(i):
        return F.struct(F.concat_ws(" ", F.get(words, i - 1), F.get(words, i), F.get(words, i + 1)).alias("w"), i.alias("p"))
    return F.when(F.size(words) >= 3, F.sort_array(F.transform(F.sequence(F.lit(1), F.size(words) - 2), at)))


def _covered(starts: str) -> Column:
    """Words covered by three-word windows that begin at the given sorted starts."""
    def step(acc, p):
        return F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"))
    zero = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
    return F.aggregate(F.coalesce(F.col(starts), F.array().cast("array<int>")), zero, step)["n"]


def measure(df: DataFrame, text: str = "text", also: tuple = ()) -> DataFrame:
    """Add the counts of ``COUNTS`` (long); columns of those names, or of ``also``, in any case, are replaced.

    The array columns are built in steps, each read more than once by the next, so the
    optimizer keeps them as columns and no lambda re-evaluates them per element.
    """
    t = F.coalesce(F.col("_qr_text"), F.lit(""))
    columns = kept(df, (*COUNTS, *also))
    df, keep = carried(df, columns, _qr_text=F.col(f"`{text}`")), [ROW]
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    a = df.select(*keep,
                  F.array_remove(F.split(t, SPACE), "").alias("_qr_words"),
                  lines.alias("_qr_lines"),
                  (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
                  (F.length(t) - F.length(F.replace(t, F.lit("!"), F.lit("")))).cast("long").alias("n_exclaims"))
    b = a.select(*keep, "n_symbols", "n_exclaims",
                 F.size("_qr_words").cast("long").alias("n_words"),
                 F.length(F.array_join("_qr_words", "")).cast("long").alias("word_chars"),
                 F.size(F.filter("_qr_words", lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
                 F.size(F.filter("_qr_words", lambda w: w.rlike("^[A-Z]{2}"))).cast("long").alias("n_upper_words"),
                 F.size("_qr_lines").cast("long").alias("n_lines"),
                 (F.size("_qr_lines") - F.size(F.array_distinct("_qr_lines"))).cast("long").alias("n_dup_lines"),
                 _windows("_qr_words").alias("_qr_windows"))
    counts = [c for c in COUNTS if c != "n_repeat_words"]
    twice = F.filter("_qr_windows", lambda x, i: (x["w"] == F.get(F.col("_qr_windows"), i - 1)["w"])
                     | F.coalesce(x["w"] == F.get(F.col("_qr_windows"), i + 1)["w"], F.lit(False)))
    c = b.select(*keep, *counts, F.sort_array(F.transform(twice, lambda x: x["p"])).alias("_qr_starts"))
    measured = F.struct(*counts, _covered("_qr_starts").cast("long").alias("n_repeat_words"))
    # a generated row: a filter on the counts stays above it instead of repeating their expressions
    return restored(c.select(*keep, F.inline(F.array(measured))), columns, *[F.col(n) for n in (*counts, "n_repeat_words")])


def apply_rules(df: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """Add counts, ``base_failed``, ``failed_rules`` (array of names) and ``kept``."""
    verdicts = ("base_failed", "failed_rules", "kept")
    m = measure(df, text, verdicts)
    names = F.array(*[F.when(F.expr(rule_failed_sql(r)), F.lit(r[0])) for r in rules])
    m = m.select(*[F.col(f"`{c}`") for c in m.columns], F.expr(base_failed_sql()).alias("base_failed"), F.array_compact(names).alias("failed_rules"))
    return m.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def oracle() -> str:
    """DuckDB SQL of the query: counts by unnesting words and lines, then the same rule table."""
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    failed = " OR ".join(rule_failed_sql(r) for r in RULES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
g AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS win
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
g2 AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM g) WHERE c > 1),
r AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM g2) GROUP BY rid),
c AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
  CAST(length(list_aggregate(ws, 'string_agg', '')) AS BIGINT) AS wc,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(length(t) - length(replace(t, '!', '')) AS BIGINT) AS n_exclaims,
  CAST(len(list_filter(ws, lambda x: lower(x) IN ({stop}))) AS BIGINT) AS n_stop_words,
  CAST(len(list_filter(ws, lambda x: regexp_matches(x, '^[A-Z]{{2}}'))) AS BIGINT) AS n_upper_words,
  CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN r USING (rid)),
m AS (SELECT doc_id, n_words, coalesce(wc, 0) AS word_chars, n_symbols, n_exclaims, n_upper_words, n_stop_words, n_lines,
  n_dup_lines, n_repeat_words FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {base_failed_sql()} AS base_failed,
  NOT {base_failed_sql()} AND NOT ({failed}) AS kept
FROM m"""
