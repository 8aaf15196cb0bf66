"""Secret scans with DataFrame functions only.

Fixed patterns give the base spans. The method adds spans of high entropy: over each candidate string (a long run of
token characters with letters and digits) a window slides, its character counts are kept by adding the character that
enters and removing the one that leaves, and the string is reported when the Shannon entropy of some window reaches
the threshold of its character class. Strings on the allow list, or inside base spans, are not reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # a leftmost run of [0-9a-f]+ is a whole run, so the length can be asked for at once
KINDS = ("assign", "access", "hex", "entropy")
#: Character classes of candidate strings: name, alphabet, least bits per character over a window: 999 in 1,000 random
#: strings of one window (16 hex digits; 62 letters and digits) have more.
CLASSES = (("hex", "^[0-9a-fA-F]+$", 2.73), ("base64", "^[A-Za-z0-9+/=_-]+$", 3.48))
WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/=_-]{20,}"
#: Shapes of strings that are no secrets: repeated words or numbers with separators, identifiers and paths of words, dates.
ALLOWED = (r"^[0-9_=+/-]+$", r"^[A-Za-z_=+/-]+$", r"^[A-Za-z]+[0-9]{1,4}$", r"^([A-Za-z]+[-_/])+([a-z]*([A-Z][a-z]+)*|[A-Z]*)[0-9]{0,4}$", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}.*$", r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")


def _matches(text: str, pattern: str, name: str) -> tuple[Column, Column]:
    """(texts between matches, matches): together they spell the text."""
    p = F.lit(pattern)
    return F.split(F.col(text), pattern, -1).alias(f"{name}_between"), F.regexp_extract_all(F.col(text), p, F.lit(0)).alias(f"{name}_found")


def _spans(name: str, rank: int, keep: str) -> Column:
    """Array of (start, rank, end, kind, string) of the matches that ``keep`` (over ``m``, ``i``) accepts."""
    return F.expr(f"""
        filter(aggregate({name}_found, struct(cast(array() as array<struct<s: int, r: int, e: int, kind: string, m: string>>) as out, 0 as at, 0 as i),
            (acc, m) -> struct(
                array_append(acc.out, struct(acc.at + length({name}_between[acc.i]) as s, {rank} as r,
                    acc.at + length({name}_between[acc.i]) + length(m) as e, '{name}' as kind, m as m)) as out,
                acc.at + length({name}_between[acc.i]) + length(m) as at, acc.i + 1 as i),
            acc -> transform(acc.out, (x, i) -> struct(x.s as s, x.r as r, x.e as e, x.kind as kind, x.m as m, i as i))), x -> {keep})""")


def _entropy(x: str) -> str:
    """Largest entropy of a window of the string ``x``: one fold over its characters with incremental counts."""
    w = f"least({WINDOW}, length({x}))"
    # counts: map from character to number; the sum of c*log2(c) changes by the two characters that move only
    term = lambda c: f"if({c} > 0, {c} * log2({c}), 0D)"
    return f"""aggregate(sequence(1, length({x})),
        named_struct('counts', array_repeat(0, 128), 's', 0D, 'best', 0D),
        (acc, i) -> transform(array(named_struct(
              'a', ascii(substring({x}, i, 1)),
              'z', if(i > {w}, ascii(substring({x}, i - {w}, 1)), -1))),
            q -> named_struct('counts', transform(acc.counts, (c, k) -> c + if(k = q.a, 1, 0) - if(k = q.z, 1, 0)),
                's', acc.s + if(q.a = q.z, 0D,
                    {term('(acc.counts[q.a] + 1)')} - {term('acc.counts[q.a]')}
                    + if(q.z < 0, 0D, {term('(acc.counts[greatest(q.z, 0)] - 1)')} - {term('acc.counts[greatest(q.z, 0)]')})),
                'best', if(i < {w}, acc.best, greatest(acc.best, log2({w}) - (acc.s + if(q.a = q.z, 0D,
                    {term('(acc.counts[q.a] + 1)')} - {term('acc.counts[q.a]')}
                    + if(q.z < 0, 0D, {term('(acc.counts[greatest(q.z, 0)] - 1)')} - {term('acc.counts[greatest(q.z, 0)]')}))) / {w}))))[0],
        acc -> acc.best)"""


def scan(docs: DataFrame) -> DataFrame:
    """Spans of secrets in each text.

    Takes ``doc_id`` and ``text`` (null counts as empty); other columns are not read. Returns one row per row of
    ``docs``: ``doc_id, n_assign, n_access, n_hex, base, spans``, the last two arrays of (s, r, e, kind, m): start and
    end in code points, end excluded, and the string; by start, then kind. Repeated rows give repeated rows, an empty
    table none.
    """
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    parts = [c for n, p in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("entropy", CANDIDATE)) for c in _matches("text", p, n)]
    value = F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2)).alias("assign_value")
    df = df.select("doc_id", *parts, value)
    df = df.select(
        "doc_id",
        _spans("assign", 0, "length(assign_value[x.i]) >= 6").alias("assign"),
        _spans("access", 1, "length(x.m) >= 20").alias("access"),
        _spans("hex", 2, "true").alias("hex"),
        _spans("entropy", 3, "x.m rlike '[0-9]' and x.m rlike '[A-Za-z]' and not (" + " or ".join(f"x.m rlike '{a}'" for a in ALLOWED) + ")").alias("candidate"),
    )
    df = df.select("doc_id", "assign", "access", "hex", "candidate", F.expr("concat(assign, access, hex)").alias("found"))
    least = "case " + " ".join(f"when x.m rlike '{p}' then {bits}D" for _, p, bits in CLASSES) + " end"
    outside = "not exists(found, b -> b.s < x.e and x.s < b.e)"
    high = F.expr(f"filter(candidate, x -> {outside} and {_entropy('x.m')} >= {least})")
    return df.select(
        "doc_id",
        F.size("assign").cast("long").alias("n_assign"),
        F.size("access").cast("long").alias("n_access"),
        F.size("hex").cast("long").alias("n_hex"),
        F.array_sort("found").alias("base"),
        F.array_sort(F.concat("found", high)).alias("spans"),
    )


def joined(spans: str) -> Column:
    """``kind:start:end`` of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def redacted(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with the spans of secrets replaced by ``mark`` in ``text``; spans that overlap are one.

    All rows and columns stay; a text without secrets is unchanged, null too, and ``n_chars``, if there, follows the text.
    """
    scanned = scan(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc_id"), "text"))
    parts = F.expr(f"""aggregate(spans, struct('' as out, 0 as at), (acc, x) -> struct(
        if(x.s >= acc.at, concat(acc.out, substring(doc_id.text, acc.at + 1, x.s - acc.at), '{mark}'), acc.out) as out,
        greatest(acc.at, x.e) as at), acc -> concat(acc.out, substring(doc_id.text, acc.at + 1)))""")
    text = F.when(F.size("spans") > 0, parts).otherwise(F.col("doc_id.text"))
    columns = {c: F.col("doc_id").getField(c) for c in docs.columns} | {"text": text}
    out = scanned.select(*[v.alias(c) for c, v in columns.items()])
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
