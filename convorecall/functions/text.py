"""Column functions on texts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from convorecall.schema import EMOJI, STOP_WORDS


def stripped(text: Column) -> Column:
    """Text without Unicode white space at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_text_message(msg_type: Column, content: Column) -> Column:
    """A text message that is not blank."""
    return (msg_type == 0) & (F.length(stripped(F.coalesce(content, F.lit("")))) > 0)


def nickname(name: Column) -> Column:
    """Name up to the first bracket."""
    return stripped(F.regexp_extract(name, "^[^(（]*", 0))


def shortened(text: Column, n: int = 200) -> Column:
    """First ``n`` characters, with dots if there are more."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def preview(text: Column, n: int) -> Column:
    """First ``n`` characters on one line."""
    return F.translate(F.substring(text, 1, n), "\n", " ")


def token_estimate(text: Column) -> Column:
    """Tokens of a text, at one and a half a character."""
    return F.floor(F.length(text) * 1.5)


def without_emoji(text: Column) -> Column:
    """Text without emoji."""
    return F.regexp_replace(text, EMOJI, "")


def is_query_word(word: Column) -> Column:
    """Two characters or more, and no stop word."""
    return (F.length(word) >= 2) & ~word.isin(STOP_WORDS)


def tokens(text: Column) -> Column:
    """Search terms: lower-cased runs of letters and digits; runs of Han become overlapping pairs, a single one stays."""
    runs = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\p{IsHan}+|[\p{L}\p{N}&&[^\p{IsHan}]]+"), F.lit(0))
    pairs = lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))
    return F.flatten(F.transform(runs, lambda r: F.when(r.rlike(r"^\p{IsHan}{2,}$"), pairs(r)).otherwise(F.array(r))))


def bigrams(text: Column) -> Column:
    """All pairs of neighbouring characters that are not blank."""
    pairs = F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.substring(text, i, F.lit(2)))
    return F.when(F.length(text) >= 2, F.filter(pairs, lambda p: F.length(stripped(p)) > 0)).otherwise(F.array().cast("array<string>"))


def session_id(kind: Column, start: Column, end: Column) -> Column:
    """Hash of a session's kind and bounds, given as epoch seconds."""
    secs = lambda c: F.concat(c.cast("bigint").cast("string"), F.lit(".0"))
    return F.md5(F.concat_ws("_", kind, secs(start), secs(end)))


def memory_id(name: Column, start: Column) -> Column:
    """First 16 digits of a hash of the conversation's name and the start, in epoch seconds."""
    return F.substring(F.md5(F.concat_ws("_", name, F.concat(start.cast("bigint").cast("string"), F.lit(".0")))), 1, 16)


def strategy(context: Column, kind: Column) -> Column:
    """Recall strategy: as asked, or by the words of the context if that is ``auto``."""
    low = F.lower(context)
    found = F.when(low.rlike("谁|who|人"), "people").when(low.rlike("什么时候|when|之前|之后"), "temporal").otherwise("semantic")
    return F.when(kind == "auto", found).otherwise(kind)


def recall_reason(bm25: Column, vector: Column, how: Column, score: Column) -> Column:
    """Why a memory was recalled, with its score to two digits."""
    strong = F.array_compact(F.array(F.when(bm25 > 0.5, F.lit("关键词匹配")), F.when(vector > 0.7, F.lit("语义相似"))))
    more = F.when(how == "people", F.array(F.lit("相关人物"))).when(how == "temporal", F.array(F.lit("时间相近"))).when((how == "semantic") & (F.size(strong) == 0), F.array(F.lit("主题相关"))).otherwise(F.array().cast("array<string>"))
    reasons = F.concat(strong, more)
    text = F.when(F.size(reasons) > 0, F.array_join(reasons, " + ")).otherwise("综合匹配")
    return F.concat(text, F.lit(" (相关度: "), F.bround(score, 2).cast("decimal(12,2)").cast("string"), F.lit(")"))


def judged(reply: Column) -> Column:
    """Score in a judge's reply: that of its first braces; 5 without any, 0 if there is no reply or no valid JSON."""
    found = F.regexp_extract(reply, r"(?s)\{[^}]+\}", 0)
    value = F.from_json(found, "relevance_score double, reasoning string")["relevance_score"]
    return F.when(reply.isNull(), 0.0).when(found == "", 5.0).otherwise(F.coalesce(value, F.lit(0.0)))


def console_text(text: Column) -> Column:
    """Text without emoji and without what the GBK encoding lacks; the latter is beyond SQL and runs in Arrow batches."""

    @F.pandas_udf("string")
    def encodable(column: pd.Series) -> pd.Series:
        return column.map(lambda t: None if t is None else t.encode("gbk", "ignore").decode("gbk"))

    return encodable(without_emoji(text))


def relevance_or_score(relevance: Column, score: Column) -> Column:
    """A judge's score, or ten times the hybrid score where there was no judge."""
    return F.coalesce(relevance, score * 10)
