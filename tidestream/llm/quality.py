"""Document rules and host verdicts, in DataFrame functions only.

Rules are counted for each document; each host's (source's) failures of each rule are aggregated, its rates shrunk towards all
hosts' by an empirical beta prior (moments of the hosts' rates), and hosts whose shrunk rate of some rule is above
HOST_LIMIT are rejected. The verdict goes back to the host's documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidestream.llm import common as C

#: Characters that count as symbols; words of a repeat window; a host's greatest shrunk rate.
SYMBOLS, WINDOW, HOST_LIMIT = "[#*$%&|<>]", 5, 0.6
#: Prior strength where the hosts' rates give none (one host, or no spread), and its bounds.
PRIOR, PRIOR_LEAST, PRIOR_MOST = 20.0, 1.0, 10_000.0
#: Rules: a document fails one if its condition holds.
RULES = {
    "short": "n_words < 10",
    "repeats": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > 3 * word_chars",
    "lines": "n_lines > 3 and 2 * n_dup_lines > n_lines",
}
BASE = ("short", "repeats")
KEPT = "not base_failed and not host_rejected"


def features(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long) and base_failed.

    A null text has no words and no lines."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(C.SPACES)) != "")
    step = docs.withColumns({"__t": C.blank_split(text), "__l": lines, "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"), "__n": F.length(text)})
    step = step.select(
        *docs.columns,
        "n_symbols",
        (F.col("__n") - F.size("__t") + 1).cast("long").alias("word_chars"),  # each blank parts two pieces
        F.size("__l").cast("long").alias("n_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.transform(F.array_remove("__t", ""), lambda x: F.xxhash64(x)).alias("__c"),
    )
    step = step.withColumn("n_words", F.size("__c").cast("long"))
    c = F.col("__c")
    codes = F.transform(F.slice(c, 1, F.greatest(F.lit(0), F.size(c) - (WINDOW - 1))), lambda x, i: F.xxhash64(x, *(F.get(c, i + k) for k in range(1, WINDOW))))
    step = step.withColumn("__h", codes).drop("__c")
    code = F.col("__h")
    ranked = F.sort_array(F.transform(code, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    step = step.withColumn("__s", F.when(F.size(F.array_distinct(code)) < F.size(code), ranked)).drop("__h")
    s = F.col("__s")
    twice = F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]))
    step = step.withColumn("__p", F.when(s.isNotNull(), F.sort_array(F.transform(twice, lambda x: x["i"])))).drop("__s")
    p = F.col("__p")
    covered = F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    step = step.withColumn("n_repeat_words", F.coalesce(F.when(p.isNotNull(), covered), F.lit(0)).cast("long")).drop("__p")
    return step.withColumn("base_failed", F.expr(" or ".join(f"({RULES[r]})" for r in BASE)))


def host_verdicts(rows: DataFrame, host: str = "source") -> DataFrame:
    """One row per host: its documents, shrunk failure rate of each rule, host_rejected. rows: features with a host column.

    A null host is one like others; no rows give none. With a single host, or rates that don't differ, the prior has strength PRIOR."""
    counts = rows.groupBy(host).agg(F.count("*").alias("host_docs"), *(F.count(F.when(F.expr(c), 1)).alias(f"failed_{r}") for r, c in RULES.items()))
    counts = C.checkpointed(counts)
    rate = {r: F.col(f"failed_{r}") / F.col("host_docs") for r in RULES}
    moments = counts.agg(*(F.avg(rate[r]).alias(f"m_{r}") for r in RULES), *(F.var_samp(rate[r]).alias(f"v_{r}") for r in RULES)).first()
    shrunk: dict[str, Column] = {}
    for r in RULES:
        m, v = moments[f"m_{r}"] or 0.0, moments[f"v_{r}"]
        strength = min(max(m * (1 - m) / v - 1, PRIOR_LEAST), PRIOR_MOST) if v and v > 0 else PRIOR
        shrunk[f"rate_{r}"] = (F.col(f"failed_{r}") + F.lit(m * strength)) / (F.col("host_docs") + F.lit(strength))
    out = counts.select(host, "host_docs", *(c.alias(n) for n, c in shrunk.items()))
    return out.withColumn("host_rejected", F.greatest(*shrunk) > HOST_LIMIT)


def judged(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and the host's rates.

    Null or blank text: no words, so base_failed. Documents without a host share one. Equal doc_ids are judged each."""
    rows = C.checkpointed(features(docs.select("doc_id", "text", F.col(host).alias("host"))).drop("text"))
    both = C.left_join_small(rows, C.checkpointed(host_verdicts(rows, "host")), "host", F.col("doc_id"))
    return both.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.expr(KEPT).alias("kept"), F.greatest(*(f"rate_{r}" for r in RULES)).alias("host_rate"))


def keep_good(docs: DataFrame, host: str = "source") -> DataFrame:
    """docs that are kept by `judged`; columns stay. Each row is judged by itself, whatever its doc_id: the columns travel
    with the counts, in the checkpoint too."""
    other = F.struct(*(c for c in docs.columns if c != "text")).alias("__row")
    rows = C.checkpointed(features(docs.select(other, "text", F.col(host).alias("host"))))
    both = C.left_join_small(rows, C.checkpointed(host_verdicts(rows, "host")), "host", F.monotonically_increasing_id())
    return both.filter(KEPT).select(*(F.col("text") if c == "text" else F.col("__row")[c].alias(c) for c in docs.columns))
