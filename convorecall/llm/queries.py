"""The registered queries over whole tables, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convorecall.llm import conversations, decontaminate, language, lm_scoring, merkle, ngram_join, packing, pii, quality, secrets, suffix_dedup, toxicity, wavelet

WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of near-duplicate documents: five-word shingles, Jaccard 0.8 or more."""
    return ngram_join.jaccard_classes(_documents(spark, sf_dir))


OP1 = f"""
with recursive w as (select doc_id, {WORDS} ws from documents),
s as (select doc_id, case when len(ws) = 0 then []::varchar[] when len(ws) < 5 then [array_to_string(ws, ' ')]
  else list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) end sh from w),
e as (select doc_id, len(sh) n, unnest(sh) g from s),
l as (select a.doc_id a, b.doc_id b from e a join e b on a.g = b.g and a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r(doc_id, c) as (select doc_id, doc_id from s union select r.doc_id, l.b from r join l on r.c = l.a)
select s.doc_id, len(s.sh)::bigint n_shingles, min(r.c) component_id from s join r using (doc_id) group by s.doc_id, s.sh
"""

def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents: weighted five-word shingles, similarity 0.8 or more."""
    return decontaminate.find(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_ITEM_WORDS = WORDS.replace("doc_id", "item_id")
OP2 = f"""
with dw as (select doc_id, {WORDS} ws from documents), iw as (select distinct item_id, {_ITEM_WORDS} ws from benchmark),
i as (select item_id, ws, len(ws) n, least(len(ws), 5) z, row_number() over () v from iw where len(ws) > 0),
p as (select v, item_id, n, z, pos, array_to_string(ws[pos:pos + z - 1], ' ') g from (select *, unnest(range(1, n - z + 2)) pos from i)),
wt as (select g, ln(1 + (select count(*) from i)::double / count(distinct v)) w from p group by g),
s as (select doc_id, z, pos, array_to_string(ws[pos:pos + z - 1], ' ') g from (select doc_id, ws, z, unnest(range(1, len(ws) - z + 2)) pos from dw, (select distinct z from i))),
seeds as (select distinct s.doc_id, p.v, p.n, p.z, greatest(s.pos - p.pos, 0) st from s join p on s.g = p.g and s.z = p.z),
win as (select doc_id, v, st, unnest(list_distinct(list_transform(range(1, len(x) - z + 2), lambda k: array_to_string(x[k:k + z - 1], ' ')))) g
  from (select seeds.*, ws[st + 1:st + n] x from seeds join dw using (doc_id))),
own as (select distinct v, g from p), total as (select v, sum(w) iw from own join wt using (g) group by v),
met as (select win.doc_id, win.v, win.st, sum(coalesce(w, ln(1 + (select count(*) from i)))) ww, coalesce(sum(w) filter (own.g is not null), 0) inter
  from win left join wt using (g) left join own on own.v = win.v and own.g = win.g group by all),
sim as (select doc_id, item_id, st, n, inter / (ww + iw - inter) sim from met join total using (v) join (select v, item_id, n from i) using (v)),
best as (select *, row_number() over (partition by doc_id, item_id order by round(sim, 9) desc, st) k from sim where sim >= 0.8 - 1e-9)
select doc_id, item_id, st::int "start", n::int n_words, round(sim, 6) similarity from best where k = 1
"""


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every text."""
    found = secrets.scan(_documents(spark, sf_dir))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(secrets.joined("base"), 256).alias("base_sha256"), secrets.joined("spans").alias("spans"))


_QUOTED = {kind: pattern.replace("'", "''") for kind, pattern in zip(secrets.KINDS, (secrets.ASSIGN, secrets.ACCESS, secrets.HEX, secrets.CANDIDATE))}
_PATTERNS = ", ".join(f"('{kind}', {rank}, '{pattern}')" for rank, (kind, pattern) in enumerate(_QUOTED.items()))
OP3 = f"""
with d as (select row_number() over () id, doc_id, coalesce(text, '') t from documents), k(kind, r, p) as (values {_PATTERNS}),
m as (select id, kind, r, string_split_regex(t, p) b, regexp_extract_all(t, p) f, case when kind = 'assign' then regexp_extract_all(t, p, 2) end v from d, k),
u as (select id, kind, r, f[i] m, v[i] v, list_sum(list_transform(b[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: len(x))), 0) s
  from (select *, unnest(range(1, len(f) + 1)) i from m)),
base as (select *, s + len(m) e from u where kind = 'assign' and len(v) >= 6 or kind = 'access' and len(m) >= 20 or kind = 'hex'),
cand as (select *, s + len(m) e from u where kind = 'entropy' and regexp_matches(m, '[0-9]') and regexp_matches(m, '[A-Za-z]')
  and not ({" or ".join(f"regexp_matches(m, '{a}')" for a in secrets.ALLOWED)})),
high as (select * from cand c where not exists (select 1 from base b where b.id = c.id and b.s < c.e and c.s < b.e)
  and list_max(list_transform(range(1, len(m) - {secrets.WINDOW - 2}), lambda j: list_entropy(string_split(m[j:j + {secrets.WINDOW - 1}], ''))))
    >= case {" ".join(f"when regexp_matches(m, '{p}') then {bits}" for _, p, bits in secrets.CLASSES)} end),
spans as (select id, kind, r, s, concat(kind, ':', s::bigint, ':', e::bigint) x from (select * from base union all select * from high)),
sums as (select id, count(*) filter (kind = 'assign') n_assign, count(*) filter (kind = 'access') n_access, count(*) filter (kind = 'hex') n_hex,
  string_agg(x, ',' order by s, r) filter (r < 3) base, string_agg(x, ',' order by s, r) spans from spans group by id)
select doc_id, coalesce(n_assign, 0) n_assign, coalesce(n_access, 0) n_access, coalesce(n_hex, 0) n_hex, sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans
from d left join sums using (id)
"""


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes left of every text when repeated 100-byte strings are removed."""
    return suffix_dedup.dedup(_documents(spark, sf_dir)).drop("kept")


OP4 = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) h, strlen(coalesce(text, '')) n from documents),
s as (select doc_id, pos, hash(h[2 * pos + 1:2 * pos + 200]) k from (select *, unnest(range(0, n - 99)) pos from d where n >= 100)),
later as (select doc_id, pos from (select doc_id, pos, row_number() over (partition by k order by doc_id, pos) r from s) where r > 1),
starts as (select *, case when pos - lag(pos) over (partition by doc_id order by pos) <= 100 then 0 else 1 end fresh from later),
runs as (select doc_id, run, min(pos) a, max(pos) + 100 b from (select *, sum(fresh) over (partition by doc_id order by pos) run from starts) group by all),
cuts as (select doc_id, count(*) n_spans, sum(b - a) n_removed, list(a order by a) ends, list(b order by a) begins from runs group by doc_id),
kept as (select d.*, coalesce(n_spans, 0) n_spans, coalesce(n_removed, 0) n_removed, list_concat([0], coalesce(begins, []::bigint[])) begins, list_append(coalesce(ends, []::bigint[]), n) ends
  from d left join cuts using (doc_id))
select doc_id, n::bigint n_bytes, n_removed::bigint n_removed, n_spans,
  sha256(unhex(array_to_string(list_transform(range(1, len(ends) + 1), lambda i: h[2 * begins[i] + 1:2 * ends[i]]), ''))) kept_sha256 from kept
"""


def _remainder(n: int):
    """crc32 of the doc_id as text, modulo n."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text by compression distance; remainder 2 of 4 is held out."""
    docs = _documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels.where(_remainder(4) != 2))
    return toxicity.score(docs, model).select("doc_id", (_remainder(4) == 2).alias("held_out"), "score", "predicted")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text rules and host verdicts; a document's host is its source."""
    return quality.judge(_documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP6 = r"""
with d as (select row_number() over () id, doc_id, coalesce(source, '') host, coalesce(text, '') t from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') ws, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) ls from d),
g as (select id, unnest(range(1, len(ws) - 6)) i, unnest(list_transform(range(1, len(ws) - 6), lambda i: array_to_string(ws[i:i + 7], ' '))) x from w where len(ws) >= 8),
two as (select id, i, count(*) over (partition by id, x) c from g),
rep as (select id, count(distinct i + k) n from two, unnest(range(8)) u(k) where c > 1 group by id),
m as (select w.*, len(ws)::bigint n_words, len(array_to_string(ws, ''))::bigint word_chars,
  len(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint n_symbols, (len(ls) - len(list_distinct(ls)))::bigint n_dup_lines,
  coalesce(rep.n, 0)::bigint n_repeat_words from w left join rep using (id)),
b as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words base_failed from m),
r as (select host, k, count(*) n, sum(f::bigint)::double f from (select host, unnest(['short', 'repeated', 'symbols', 'lines']) k,
    unnest([n_words < 20, 100 * n_repeat_words > 30 * n_words, 10 * n_symbols > word_chars, 10 * n_dup_lines > 3 * len(ls)]) f from b) group by host, k),
p as (select k, avg(f / n) m, var_pop(f / n) v from r group by k),
q as (select k, m, case when v > 1e-12 and m * (1 - m) > v then m * (1 - m) / v - 1 else 1.0 end w from p),
h as (select host, max((f + m * w) / (n + w)) rate from r join q using (k) group by host)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and rate <= 0.5 kept from b join h using (host)
"""


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text; remainder 0 of 5 is held out."""
    docs = _documents(spark, sf_dir)
    model = language.fit(docs.where(_remainder(5) != 0))
    return language.predict(docs, model).select("doc_id", (_remainder(5) == 0).alias("held_out"), "lang_pred", "score", "rejected")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-likelihood of every text; remainder 0 of 10 is held out."""
    scored = lm_scoring.score(_documents(spark, sf_dir), _remainder(10) != 0)
    return scored.select("doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 token ids."""
    return packing.pack(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op10_wavelet_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids written as wavelet matrices and read back."""
    return wavelet.read_shards(wavelet.write_shards(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every text; the field learns from a small labelled table written around words of the documents."""
    docs = _documents(spark, sf_dir)
    found = pii.scan(docs, pii.fit(pii.labelled(docs)))
    counts = [pii.counted("base", kind).alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.joined("base"), 256).alias("base_sha256"), pii.joined("spans").alias("spans"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle proofs of every row, tried again after every third text has been lower-cased."""
    text = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return merkle.proofs(_documents(spark, sf_dir), {"text": text}, _remainder(3) == 0)


#: DuckDB has no crc32: a table of its steps, and a fold over the characters of an ASCII string.
CRC_TABLE = "steps as (select list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::bigint[], lambda v, x: xor(v >> 1, (v & 1) * 3988292384)) order by i) step from range(256) r(i))"


def crc32_sql(text: str) -> str:
    """crc32 of the ASCII string ``text``, in a query with the table ``steps``."""
    return f"xor(4294967295, list_reduce(list_concat([4294967295]::bigint[], list_transform(string_split({text}, ''), lambda c: ord(c)::bigint)), lambda v, b: xor(v >> 8, step[(xor(v, b) & 255) + 1])))"


_FIELDS = "sha256(" + " || ".join(f"coalesce(strlen({c}::varchar) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"
_LEVELS = """{t}(g, lvl, i, h, n) as ({base} union all
  select g, any_value(lvl) + 1, i // 8, sha256(string_agg(h, '' order by i)), (any_value(n) + 7) // 8 from {t} where n > 1 group by g, i // 8),
{t}s as (select g, lvl, i, coalesce(string_agg(h, '') over (w rows between unbounded preceding and 1 preceding), '') a,
  coalesce(string_agg(h, '') over (w rows between 1 following and unbounded following), '') b from {t} where n > 1 window w as (partition by g, lvl, i // 8 order by i))"""
_FOLD = """{f}(id, g, lvl, i, h, w) as ({base} union all select id, g, lvl + 1, i // 8, sha256(a || h || b), w || a || b from {f} join {t}s using (g, lvl, i)),
{f}end as (select id, max_by(h, lvl) h, max_by(w, lvl) w from {f} group by id)"""
OP12 = f"""
with recursive {CRC_TABLE},
d as (select row_number() over () id, doc_id, coalesce('=' || lang, '') g, {_FIELDS.format(text="text")} leaf,
  case when {crc32_sql("doc_id::varchar")} % 3 = 0 then {_FIELDS.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} end changed from documents, steps),
p as (select *, row_number() over (partition by g order by doc_id nulls first, leaf, id) - 1 i from d),
{_LEVELS.format(t="low", base="select g, 0, i, leaf, count(*) over (partition by g) from p")},
subs as (select g, h, row_number() over (order by g) - 1 i from low where n = 1),
{_LEVELS.format(t="top", base="select '', 0, i, h, count(*) over () from subs")},
{_FOLD.format(f="lf", t="low", base="select id, g, 0, i, coalesce(changed, leaf), '' from p")},
{_FOLD.format(f="tf", t="top", base="select p.id, '', 0, subs.i, lfend.h, '' from p join lfend using (id) join subs using (g)")}
select doc_id, leaf, subs.h subroot, top.h root, sha256(lfend.w || tfend.w) proof_sha256, tfend.h folded_root, tfend.h = top.h verified
from p join subs using (g) join lfend using (id) join tfend using (id), top where top.n = 1
"""


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repairs of damaged conversations."""
    return conversations.repaired(conversations.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


_NEXT = "case when {s} = 'u' then 'a' else 'u' end"
OP13 = rf"""
with recursive {CRC_TABLE},
d as (select conv_id, turn, coalesce(role, ' ') r, coalesce(text, ' ') t, {crc32_sql("concat(coalesce(conv_id::varchar, ' '), ':', coalesce(turn::varchar, ' '))")} % 20 k from conversations, steps),
x as (select conv_id, turn, case when k = 4 then 'user' else r end r, case k when 1 then '' when 2 then regexp_replace(t, '[.!?]', '', 'g') else t end t,
  unnest(case when k = 3 then [0, 1] else [0] end) copy from d where k > 0),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, r, t, copy) i, row_number() over (partition by conv_id, r, t order by turn nulls first, copy) nth from x),
f as (select *, case when not regexp_matches(t, '[^ 	-
]') then 'b' when nth > 1 then 'd' when not regexp_matches(t, '[.!?][ 	-
]*\z') then 't' else '' end fault,
  lag(r[1]) over (partition by conv_id order by i) prev from o),
sums as (select conv_id, count(*) n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps, count(*) filter (fault = 'b') blank, count(*) filter (fault = 'd') duplicate,
  count(*) filter (fault = 't') truncated, count(*) filter (prev is not null and prev || r[1] not in ('su', 'ua', 'au')) illegal from f group by conv_id),
walk(conv_id, i, s, best) as (
  select conv_id, 0::bigint, '', {{'c': 0::bigint, 'a': '', 'l': []::varchar[]}} from sums
  union all
  select conv_id, i, s2, min({{'c': c, 'a': a, 'l': l}}) from (
    select conv_id, i, case e when 'D' then s1 when 'K' then r[1] else want end s2,
      best.c + 2 * ins + case when e = 'D' then 3 when e = 'R' then 2 else 0 end + (e <> 'D' and fault = 't')::int c, best.a || repeat('I', ins) || e a,
      list_concat(best.l, case when ins = 1 then [case s1 when 'u' then 'user:' else 'assistant:' end] else [] end,
        case e when 'K' then [r || ':' || t] when 'R' then [case want when 'u' then 'user:' else 'assistant:' end || t] else [] end) l
    from (select *, {_NEXT.format(s="s1")} want from (
      select f.conv_id, f.i, f.r, f.t, f.fault, w.best, ins, case when ins = 1 then {_NEXT.format(s="w.s")} else w.s end s1
      from walk w join f on w.conv_id is not distinct from f.conv_id and f.i = w.i + 1, (values (0), (1)) v(ins))), (values ('D'), ('K'), ('R')) u(e)
    where e = 'D' or fault not in ('b', 'd') and (e = 'R' or r[1] = want or r[1] = 's' and s1 = ''))
  group by conv_id, i, s2),
ends as (select w.conv_id, min({{'c': best.c + 2 * len(more), 'a': best.a || repeat('I', len(more)), 'l': list_concat(best.l, more)}}) best
  from (select *, case s when 's' then ['user:', 'assistant:'] when 'u' then ['assistant:'] else []::varchar[] end more from walk) w
  join sums on sums.conv_id is not distinct from w.conv_id and sums.n = w.i group by w.conv_id)
select c.conv_id, coalesce(gaps, 0)::bigint gaps, coalesce(blank, 0) blank, coalesce(duplicate, 0) duplicate, coalesce(truncated, 0) truncated, coalesce(illegal, 0) illegal,
  coalesce(best.c, 0) "cost", coalesce(best.a, '') audit, sha256(coalesce(array_to_string(best.l, chr(10)), '')) repaired_sha256
from (select distinct conv_id from conversations) c left join sums on sums.conv_id is not distinct from c.conv_id left join ends on ends.conv_id is not distinct from c.conv_id
"""


QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op2_decontamination": op2_decontamination,
    "op3_secret_scan": op3_secret_scan,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_quality_rules": op6_quality_rules,
    "op7_lm_scoring": op7_lm_scoring,
    "op9_language_id": op9_language_id,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op10_wavelet_output": op10_wavelet_output,
    "op11_pii": op11_pii,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_conversation_repair": op13_conversation_repair,
}
SQL = {"op1_ngram_join": OP1, "op2_decontamination": OP2, "op3_secret_scan": OP3, "op4_suffix_dedup": OP4, "op6_quality_rules": OP6, "op12_merkle_manifest": OP12, "op13_conversation_repair": OP13}
