"""Personal data: fixed patterns, and a conditional random field for what is written in other ways.

The base spans are addresses, numbers of hosts, cards and phones in their usual forms. The field is trained on a small
labelled table and reads the tokens around digits, ``@``, ``dot`` and ``at`` in brackets of every text; what it finds outside base
spans is added: addresses with (at) and [dot], hosts with [.], cards in groups or with a wrong digit, phones
without a plus. Texts without any of these, which are most, are told by one pass of Arrow's matcher.
"""

from __future__ import annotations

import bisect
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convorecall.llm.crf import KINDS, Field, Tokens, spans
from convorecall.llm.scratch import drawn, texts_of
from convorecall.llm.textkit import map_texts, string_column

#: Tokens on either side of a cue that are decoded; everything further away is outside.
REACH = 12
#: Rows of the labelled table that training takes at most.
EXAMPLES = 2000
#: Documents whose ordinary words the labelled table is written around, at most, and the bytes of one of them.
CARRIERS, CARRIER_BYTES = 300, 1 << 16
#: Tokens that are decoded together.
TOKENS = 100_000
_MAYBE = r"[0-9@]|\b(?i:dot|punkt|point|punto)\b|[\[({]\s*(?i:at)\s*[\])}]"
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NAME = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SPAN = "array<struct<s: int, r: int, e: int>>"


def _luhn(digits: str) -> bool:
    doubled = [int(c) for c in digits[-2::-2]]
    return (sum(int(c) for c in digits[-1::-2]) + sum(2 * d - 9 * (d > 4) for d in doubled)) % 10 == 0


def _digits(x: str) -> str:
    return "".join(c for c in x if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, each found from its ``@``: names end there, as ``@`` is no sign of a name."""
    free = at = 0
    while (at := text.find("@", at)) >= 0:
        lo = at
        while lo > free and not _LOCAL.match(text, lo - 1):
            lo -= 1
        host = _HOST.match(text, at + 1) if lo < at else None
        if host:
            yield lo, host.end()
            free = at = host.end()
        else:
            at += 1
            free = max(free, at)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of the kind, end) of the fixed patterns, in that order; no pattern goes over a text more than a few times."""
    out = [(s, 0, e) for s, e in _emails(text)]
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if m.end() - m.start() < 40 and 12 <= len(d := _digits(m[0])) <= 19 and _luhn(d)]
    out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out)


# ---- the labelled table


def _item(rng: random.Random, word: str) -> tuple[str, str]:
    """(kind, text) of made-up personal data in one of many written forms; kind is empty for what only looks like it."""
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    kind = rng.choice(("email", "email", "ip", "card", "phone", "phone", "", "", ""))
    if kind == "email":
        name = word.lower() + rng.choice(("", number(2), "." + number(2), "." + word.lower()[:5], "_" + rng.choice("abcxyz")))
        host = rng.choice(("mail", "post", "web", "corp", word.lower()[:5])) + rng.choice(("", number(1)))
        parts = [host, *rng.choice(((), ("example",), ("uni",))), rng.choice(("com", "org", "net", "de", "fr", "es"))]
        at, dot = rng.choice((("@", "."), ("@", "."), (" at ", " dot "), (" (at) ", " (dot) "), (" [at] ", " [dot] "), ("(at)", "."), ("[at]", "[dot]"), (" @ ", " . "), (" AT ", " DOT "), ("@", "[.]")))
        return kind, (name if rng.random() < 0.5 else name.replace(".", dot)) + at + dot.join(parts)
    if kind == "ip":
        return kind, rng.choice((".", ".", "[.]", "(.)", " . ", "[dot]", " dot ")).join(str(rng.randint(0, 255)) for _ in range(4))
    if kind == "card":
        digits = number(rng.choice((16, 16, 16, 15, 13, 14, 19)))
        return kind, rng.choice(("", "", " ", "-", ".", "/")).join(digits[i : i + 4] for i in range(0, len(digits), 4))
    if kind == "phone":
        a, b, c = number(3), number(3), number(4)
        return kind, rng.choice((f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"1-{a}-{b}-{c}", f"00{number(2)} {a} {b}{c}", f"+{number(2)} {a} {b} {c}", f"0{number(2)}/{b}{c}", f"+{number(2)}{a}{b}{c}", f"({a}){b}-{c}"))
    year, month = rng.randint(1900, 2035), rng.randint(1, 28)
    return "", rng.choice((str(year), f"{year}-{month:02}-{month:02}", f"{month}.{month % 12}.{year}", f"{month}:{number(2)}", f"{number(2)}%", f"${number(3)}", f"{number(1)},{number(3)},{number(3)}", f"{number(1)}.{number(1)}", f"{number(1)}.{number(1)}.{number(1)}", number(rng.choice((1, 2, 3, 4, 5, 6))), f"#{number(4)}", f"{number(2)} {number(3)}", f"v{number(1)}.{number(2)}", f"{number(6)}.{number(2)}", f"{word.lower()}{number(2)}", f"@{word.lower()}", f"{number(2)}-{number(2)}", f"({number(1)})", f"{year}/{number(2)}", f"{number(8)}-{number(4)}-{number(4)}-{number(12)}", "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice((12, 32, 40)))), "at", "dot", f"{number(30)}"))


def examples(texts: list[str], n: int = EXAMPLES, seed: int = 7) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """``n`` labelled lines: made-up items, labelled by their form, between words of the texts that hold nothing like them."""
    rng = random.Random(seed)
    words = [[w for w in t.split() if not re.search(_MAYBE, w)] for t in texts]
    words = [w for w in words if w] or [["the", "word"]]
    out = []
    for _ in range(n):
        own = rng.choice(words)
        lo = rng.randrange(len(own))
        parts, marks, size = [], [], 0
        line = own[lo : lo + rng.randint(4, 24)]
        places = set(rng.sample(range(len(line) + 1), min(rng.choice((0, 1, 1, 2)), len(line) + 1)))
        for k in range(len(line) + 1):
            if k in places:
                kind, item = _item(rng, "".join(c for c in rng.choice(own) if c.isalpha()) or "name")
                before, after = rng.choice((("", ""), ("", ""), ("", ""), ("(", ")"), ('"', '"'), ("", "."), ("", ","), ("", rng.choice(("!!", "***", "%%%", "###", " |"))), ("tel: ", ""), ("mail: ", "")))
                if kind:
                    marks.append((size + len(before), KINDS.index(kind), size + len(before) + len(item)))
                parts.append(before + item + after)
                size += len(parts[-1]) + 1
            if k < len(line):
                parts.append(line[k])
                size += len(line[k]) + 1
        out.append((" ".join(parts), marks))
    return out


def labelled(docs: DataFrame) -> DataFrame:
    """A small labelled table, ``text`` and ``spans`` of (s, r, e), written around words of at most ``CARRIERS`` documents."""
    fit_ = docs.where(F.octet_length("text") <= CARRIER_BYTES)
    rows = texts_of(fit_, drawn(fit_.select("doc_id").distinct(), CARRIERS, 13)).select("text").limit(2 * CARRIERS).collect()
    return _table(docs.sparkSession, examples(sorted(r.text for r in rows)))


def _table(spark: SparkSession, rows: list) -> DataFrame:
    return spark.createDataFrame(rows, f"text string, spans {_SPAN}")


def _truth(tokens: Tokens, marks: list) -> np.ndarray:
    out = np.zeros(len(tokens.shape), np.int64)
    for s, kind, e in marks:
        own = np.flatnonzero((tokens.start >= s) & (tokens.end <= e))
        out[own] = 2 + 2 * kind
        out[own[:1]] = 1 + 2 * kind
    return out


def fit(table: DataFrame) -> Field:
    """Train on at most ``EXAMPLES`` rows of a labelled table; an empty one gives a field that finds nothing."""
    rows = table.where("text is not null").orderBy(F.xxhash64("text"), "text").limit(EXAMPLES).collect()
    parts, labels = [], []
    for row in rows:
        tokens = Tokens(row.text)
        if len(tokens.shape):
            parts.append(tokens.codes(0, len(tokens.shape)))
            labels.append(_truth(tokens, row.spans or []))
    return Field().train(parts, labels)


# ---- scanning


def _met(own: list[list[tuple[int, int, int]]], s: int, e: int) -> bool:
    """Whether a base span has a place of s to e; ``own`` has them by kind, and those of one kind do not overlap."""
    return any((k := bisect.bisect_left(kind, (e,))) and kind[k - 1][2] > s for kind in own)


def _scan(field: Field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = string_column(batch, "_text")
            found: list[tuple[list, list]] = [([], [])] * len(texts)
            parts, where, size = [], [], 0

            def decoded() -> None:
                for (k, start, end), labels in zip(where, field.decode(parts)):
                    own, more = [[x for x in found[k][0] if x[1] == r] for r in range(len(KINDS))], found[k][1]
                    more += [(s, KINDS.index(kind), e) for s, kind, e in spans(labels, start, end) if not _met(own, s, e)]
                parts.clear()
                where.clear()

            for k in np.flatnonzero(pc.fill_null(pc.match_substring_regex(texts, _MAYBE), False).to_numpy(zero_copy_only=False)).tolist():
                text = texts[k].as_py()
                found[k] = base_spans(text), []
                tokens = Tokens(text)
                for lo, hi in tokens.segments(REACH):
                    parts.append(tokens.codes(lo, hi))
                    where.append((k, tokens.start[lo:hi], tokens.end[lo:hi]))
                    size += hi - lo
                    if size > TOKENS:
                        decoded()
                        size = 0
            decoded()
            sides = [pa.array([[dict(zip("sre", x)) for x in sorted(row)] for row in side], _ARROW) for side in zip(*found)] if found else [pa.array([], _ARROW)] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *sides], names=["doc_id", "base", "added"])

    return run


_ARROW = pa.list_(pa.struct([("s", pa.int32()), ("r", pa.int32()), ("e", pa.int32())]))


def scan(docs: DataFrame, field: Field) -> DataFrame:
    """Spans of personal data in each text.

    Takes ``doc_id`` and ``text`` (null counts as empty); other columns are not read. Returns one row per row of ``docs``:
    ``doc_id, base, added, spans``, arrays of (s, r, e): start and end in code points, end excluded, and the rank of the kind
    in ``KINDS``; by start, then kind. ``added`` are the field's spans that meet no base span. Repeated rows give
    repeated rows, an empty table none.
    """
    found = map_texts(docs.select("doc_id", F.col("text").alias("_text")), _scan(field), f"doc_id long, base {_SPAN}, added {_SPAN}")
    return found.withColumn("spans", F.array_sort(F.concat("base", "added")))


def counted(spans_: str, kind: str):
    """Number of spans of a kind."""
    return F.size(F.filter(spans_, lambda x: x["r"] == KINDS.index(kind))).cast("long")


def joined(spans_: str):
    """``kind:start:end`` of spans, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans_, lambda x: F.concat_ws(":", names[x["r"]], x["s"].cast("string"), x["e"].cast("string"))), ",")
