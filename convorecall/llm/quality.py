"""Quality rules with DataFrame functions only: rules on each text, and a verdict on each host.

For each rule, a host's rate of failed documents is shrunk towards an empirical beta prior, fitted to all hosts' rates by
moments. A host with a shrunk rate above the limit, by any rule, loses all its documents. Texts are measured once, into
a narrow table; hosts are counted from it with partial sums, and their verdicts are sent to all of its tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convorecall.llm.scratch import SMALL_ROWS, written

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MAX_HOST_RATE = 0.5
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Failures that are counted by host; the first two are those of the document itself, too.
RULES = {
    "short": f"n_words < {MIN_WORDS}",
    "repeated": f"100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words",
    "symbols": "10 * n_symbols > word_chars",
    "lines": "10 * n_dup_lines > 3 * n_lines",
}
SALTS = 16


def _repeat_words() -> Column:
    """Words inside windows of eight that occur twice or more; ``x.words`` holds the words."""
    window = ", ".join(f"x.words[i + {k}]" for k in range(WINDOW))
    return F.expr(f"""
        if(size(x.words) <= {WINDOW}, 0L, transform(array(transform(sequence(0, size(x.words) - {WINDOW}), i -> xxhash64({window}))), h ->
            if(size(array_distinct(h)) = size(h), 0L,
                transform(array(array_sort(transform(h, (v, i) -> struct(v as v, i as i)))), s ->
                    aggregate(array_sort(transform(filter(transform(s, (e, k) -> struct(e.i as i,
                            (k > 0 and s[greatest(k - 1, 0)].v = e.v) or (k < size(s) - 1 and s[least(k + 1, size(s) - 1)].v = e.v) as twice)),
                        e -> e.twice), e -> e.i)),
                        struct(0L as n, -{WINDOW} as last), (acc, i) -> struct(acc.n + least({WINDOW}, i - acc.last) as n, i as last), acc -> acc.n))[0]))[0])""")


def measures(docs: DataFrame, host: str = "source") -> DataFrame:
    """``doc_id, host`` and the counts of each text (null: empty), with ``base_failed``; one row per row of ``docs``."""
    text = F.coalesce("text", F.lit(""))
    df = docs.select("doc_id", F.coalesce(F.col(f"`{host}`").cast("string"), F.lit("")).alias("host"), text.alias("text"))
    parts = F.struct(F.array_remove(F.split("text", SPACE, -1), "").alias("words"), F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    df = df.withColumn("x", F.explode(F.array(parts)))  # computed once, then used by name
    df = df.select(
        "doc_id",
        "host",
        F.size("x.words").cast("long").alias("n_words"),
        F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("x.lines") - F.size(F.array_distinct("x.lines"))).cast("long").alias("n_dup_lines"),
        F.size("x.lines").cast("long").alias("n_lines"),
        _repeat_words().alias("n_repeat_words"),
    )
    return df.withColumn("base_failed", F.expr(f"({RULES['short']}) or ({RULES['repeated']})"))


def host_rates(rated: DataFrame) -> DataFrame:
    """``host``, a rate for each of RULES, and ``rate``, the largest of them.

    Rates are shrunk by a beta prior whose mean and variance are those of the hosts' rates. If all hosts have one rate, the
    prior has the weight of one document.
    """
    hosts = rated.groupBy("host").agg(F.count("*").alias("n"), *[F.sum(F.expr(f"cast({rule} as long)")).alias(k) for k, rule in RULES.items()])
    moments = [f(F.col(k) / F.col("n")).alias(f"{k}_{m}") for k in RULES for m, f in (("m", F.avg), ("v", F.var_pop))]
    prior = hosts.agg(*moments)
    out = hosts.crossJoin(F.broadcast(prior))  # the prior is one row

    def shrunk(k: str) -> Column:
        m, v = F.col(f"{k}_m"), F.col(f"{k}_v")
        weight = F.when((v > 1e-12) & (m * (1 - m) > v), m * (1 - m) / v - 1).otherwise(1.0)
        return (F.col(k) + m * weight) / (F.col("n") + weight)

    out = out.select("host", *[shrunk(k).alias(k) for k in RULES])
    return out.withColumn("rate", F.greatest(*RULES))


def judge(docs: DataFrame, host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Measures of each text with ``host_rate`` and ``kept``: not failed itself, and of a host within ``max_rate``.

    Null hosts are one host. Repeated rows count and stay; texts of any length are measured whole; an empty table gives
    no rows; other columns are not read.
    """
    rated = written(measures(docs, host), "measures")
    rates = written(host_rates(rated).select("host", F.col("rate").alias("host_rate")), "hosts")
    if rates.count() <= SMALL_ROWS:
        out = rated.join(F.broadcast(rates), "host")
    else:  # a host of very many documents is dealt to several tasks
        each = rates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = rated.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(each, ["host", "salt"]).drop("salt")
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("host_rate") <= max_rate))
