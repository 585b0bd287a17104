"""The queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecue.llm import ann, bpe, chat, decontam, langid, licenses, linedup, merkle, minhash, quality, runs, toxicity, warc
from tidecue.llm.common import held_out, shared_folder, table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def language_model(docs: DataFrame) -> langid.LanguageModel:
    """Learned from the documents that are not held out."""
    return langid.fit(docs.where(~held_out()))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, language_model(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    forest = quality.fit(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return quality.score(docs, forest).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = warc.mark_revisits(table(spark, sf_dir, "pages"))
    folder = shared_folder(spark, "warc")
    warc.write_warc(marked, folder)
    damaged = F.raise_error(F.concat(F.lit("a damaged archive: "), "path"))
    found = warc.read_warc(spark, folder, payloads=False)
    return found.select(
        warc.page_of(F.col("record_id")).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        F.when(F.col("kind") == "gap", damaged).otherwise(F.col("kind")).alias("record_type"),
        warc.page_of(F.col("refers_to")).alias("refers_to"),
    )


OP7_SQL = """
with p as (
  select page_id, coalesce(html, '') as html from pages
), d as (
  select page_id, cast(strlen(html) as bigint) as payload_bytes, sha1(html) as h from p
), b as (
  select page_id, payload_bytes,
    list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + cast((cast('0x' || substr(h, 1 + 5 * (i // 4), 5) as bigint) >> (15 - 5 * (i % 4))) & 31 as int), 1)),
      'string_agg', '') as payload_digest
  from d
), m as (
  select *, max(page_id) over (partition by payload_digest) as last_id from b
)
select page_id, payload_bytes, payload_digest,
  case when page_id = last_id then 'response' else 'revisit' end as record_type,
  case when page_id <> last_id then last_id end as refers_to
from m
"""


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


OP2_SQL = """
with recursive w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents
), s as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s from w
), u as (select doc_id, len(s) as n, unnest(s) as x from s),
p as (select a.doc_id as a, b.doc_id as b, a.n as na, b.n as nb, count(*) as c from u a join u b on a.x = b.x and a.doc_id < b.doc_id group by all),
e as (select a, b from p where 100 * c >= 75 * (na + nb - c)),
l as (select a, b from e union all select b, a from e),
r as (select doc_id as node, doc_id as seen from documents union select r.node, l.b from r join l on l.a = r.seen),
m as (select node, min(seen) as component_id from r group by node)
select doc_id, len(s) as n_shingles, component_id, doc_id = component_id as kept from s join m on node = doc_id
"""


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = chat.echo_pairs(table(spark, sf_dir, "conversations"))
    spans = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ",")
    found = chat.format_preferences(pairs, "conv_id")
    return found.select("conv_id", "n_prompt_turns", "prompt", "chosen", "rejected", spans("chosen_mask").alias("chosen_mask"), spans("rejected_mask").alias("rejected_mask"))


OP8_SQL = """
with t as (
  select conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} order by turn, coalesce(role, ''), coalesce(text, '')) as a
  from conversations where conv_id is not null group by conv_id
), l as (
  select *, list_max(list_transform(a, lambda x, i: case when x.role = 'assistant' then i else 0 end)) as k from t
), r as (
  select conv_id, a, list_transform(a, lambda x, i: case when i = k
    then {'role': x.role, 'text': case when i = 1 then '' else a[i - 1].text end} else x end) as b from l
), p as (
  select *, coalesce(list_min(list_filter(list_transform(a, lambda x, i: case when x = b[i] then null else i end), lambda y: y is not null)) - 1, len(a)) as n from r
), q as (
  select conv_id, n, a[1:n] as s, a[n + 1:] as c, b[n + 1:] as d from p
)
select conv_id, cast(n as int) as n_prompt_turns,
  coalesce(array_to_string(list_transform(s, lambda x: '<|im_start|>' || x.role || chr(10) || x.text || '<|im_end|>' || chr(10)), ''), '') as prompt,
  coalesce(array_to_string(list_transform(c, lambda x: '<|im_start|>' || x.role || chr(10) || x.text || '<|im_end|>' || chr(10)), ''), '') as chosen,
  coalesce(array_to_string(list_transform(d, lambda x: '<|im_start|>' || x.role || chr(10) || x.text || '<|im_end|>' || chr(10)), ''), '') as rejected,
  coalesce(array_to_string(list_filter(list_transform(c, lambda x, i: case when x.role = 'assistant' then
      (coalesce(list_sum(list_transform(c[1:i - 1], lambda y: 24 + length(y.role) + length(y.text))), 0) + 13 + length(x.role))::bigint || '-' ||
      (coalesce(list_sum(list_transform(c[1:i - 1], lambda y: 24 + length(y.role) + length(y.text))), 0) + 23 + length(x.role) + length(x.text))::bigint end), lambda z: z is not null), ','), '') as chosen_mask,
  coalesce(array_to_string(list_filter(list_transform(d, lambda x, i: case when x.role = 'assistant' then
      (coalesce(list_sum(list_transform(d[1:i - 1], lambda y: 24 + length(y.role) + length(y.text))), 0) + 13 + length(x.role))::bigint || '-' ||
      (coalesce(list_sum(list_transform(d[1:i - 1], lambda y: 24 + length(y.role) + length(y.text))), 0) + 23 + length(x.role) + length(x.text))::bigint end), lambda z: z is not null), ','), '') as rejected_mask
from q
"""


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    languages = language_model(docs)
    net = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held_out()), languages)
    return toxicity.score(docs, net, languages).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op10_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_QUOTED = lambda words: ", ".join(f"'{w}'" for w in words)
_TEMPLATE_SQL = f"""case
  when substr(x, 1, 1) < ':' and regexp_matches(lower(rtrim(x, '.,;:!?"'')')), '^[-+$]?[0-9][0-9.,]*(%|st|nd|rd|th)?$')
    or lower(rtrim(x, '.,;:!?"'')')) in ({_QUOTED(decontam.NUMBER_WORDS)}) then '<number>'
  when lower(rtrim(x, '.,;:!?"'')')) in ({_QUOTED(decontam.UNITS)}) then '<unit>'
  when i > 1 and substr(x, 1, 1) between 'A' and 'Z' and not regexp_matches(w[i - 1], '[.!?:]$') and regexp_matches(x, '^[A-Z][a-z]+[.,;:!?"'')]*$') then '<name>'
  else lower(rtrim(x, '.,;:!?"'')')) end"""
_SPLIT_SQL = "string_split_regex(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[\\x20\\x09-\\x0D]+')"

OP10_SQL = f"""
with b as (select distinct item_id, {_SPLIT_SQL} as w from benchmark),
bt as (select item_id, w, list_transform(w, lambda x, i: {_TEMPLATE_SQL}) as t from b),
bw as (select item_id, w, t, unnest(range(1, len(t) - 6)) as p from bt),
bk as (select item_id, p, array_to_string(t[p:p + 7], ' ') as k, w, t from bw
  where len(list_filter(t[p:p + 7], lambda x: x not in ('<number>', '<unit>', '<name>'))) >= 5),
n as (select item_id, count(distinct p) as item_windows from bk group by 1),
d as (select doc_id, {_SPLIT_SQL} as w from documents where doc_id is not null and text is not null),
dt as (select doc_id, w, list_transform(w, lambda x, i: {_TEMPLATE_SQL}) as t from d),
dw as (select doc_id, w, t, unnest(range(1, len(t) - 6)) as q from dt),
dk as (select doc_id, q, array_to_string(t[q:q + 7], ' ') as k, w from dw),
h as (select distinct doc_id, item_id, p, q, q - p as run, dk.w as dw, bk.w as bw, bk.t as t from dk join bk using (k)),
s as (select doc_id, item_id, run, p + o as bp, q + o as dp, lower(rtrim(bw[p + o], '.,;:!?"'')')) as v, lower(rtrim(dw[q + o], '.,;:!?"'')')) as u
  from h, (select unnest(range(0, 8)) as o) where t[p + o] in ('<number>', '<unit>', '<name>')),
c as (select doc_id, item_id, run, v, count(distinct u) as n, bool_or(u <> v) as other from s group by all),
r as (select doc_id, item_id, run, max(n) as n, bool_or(other) as other from c group by all),
g as (select h.doc_id, h.item_id, h.p, coalesce(bool_or(r.other), false) as other from h left join r using (doc_id, item_id, run) where r.n is null or r.n = 1 group by all)
select doc_id, item_id, count(*) as n_windows, item_windows, bool_or(other) as reparameterised
from g join n using (item_id) group by doc_id, item_id, item_windows having count(*) >= item_windows * 0.2
"""


def op3_linedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linedup.line_counts(table(spark, sf_dir, "documents"))
    return found.withColumn("removed", F.array_join(F.col("removed").cast("array<string>"), ","))


OP3_SQL = """
with x as (select doc_id, string_split(text, chr(10)) as x from documents where doc_id is not null and text is not null),
l as (select doc_id, cast(unnest(range(0, len(x))) as int) as no, trim(lower(unnest(x)), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as t from x),
w as (select doc_id, no, case when t = '' then [] else list_sort(list_distinct(string_split_regex(t, '[\\x20\\x09-\\x0D]+'))) end as s from l),
f as (select s, len(s) as n, min(row(doc_id, no)) as f from w where len(s) > 0 group by s),
i as (select row_number() over (order by f) as id, * from f),
u as (select id, n, unnest(s) as word from i),
c as (select word, count(*) as c from u group by word),
p as (select id, word from (select id, n, word, row_number() over (partition by id order by c, word) as k from u join c using (word)) where k <= n - (n * 90 + 99) // 100 + 1),
q as (select distinct a.id as a, b.id as b from p a join p b on a.word = b.word and a.id < b.id),
m as (select distinct q.b as id from q join i x on x.id = q.a join i y on y.id = q.b
  where len(list_intersect(x.s, y.s)) * 100 >= (x.n + y.n - len(list_intersect(x.s, y.s))) * 90),
k as (select f from i where id not in (select id from m)),
r as (select doc_id, no, len(s) > 0 and k.f is null as removed from (select distinct * from w) w left join k on k.f = row(w.doc_id, w.no))
select doc_id, count(*) as n_lines, count(*) filter (removed) as n_removed,
  coalesce(string_agg(cast(no as varchar), ',' order by no) filter (removed), '') as removed
from r group by doc_id
"""

_WHITE = "[\\x20\\x09-\\x0D]+"

def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    found = licenses.scan(table(spark, sf_dir, "documents")).withColumn("base", F.filter("spans", lambda s: s["kind"] == "base"))
    starts = F.transform("base", lambda s: s["start"].cast("long"))
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(c("base")).alias("base_labels"),
        labels(c("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0)).alias("score"),
    )


def _known_sql() -> str:
    rows = []
    for i, (kind, label, text) in enumerate(licenses.templates()):
        words = licenses.plain_words(text)
        rows.append(f"({i}, '{kind}', '{label}', string_split('{' '.join(words)}', ' '), {licenses.GRAM if kind == 'notice' else licenses.PHRASE})")
    return ", ".join(rows)


OP11_SQL = f"""
with k(template, kind, label, w, n) as (values {_known_sql()}),
kg as (select template, kind, n, unnest(range(1, len(w) - n + 2)) as t, w from k),
kt as (select template, n, t, array_to_string(w[t:t + n - 1], ' ') as x from kg),
d as (select row_number() over () as r, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.UPPER.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
dg as (select r, w, n, unnest(range(1, len(w) - n + 2)) as p from d, (values ({licenses.PHRASE}), ({licenses.GRAM})) as v(n)),
dt as (select r, n, p, array_to_string(w[p:p + n - 1], ' ') as x from dg),
v as (select r, template, p - t as diagonal, count(*) as votes from dt join kt using (n, x) group by all),
a as (select *, diagonal - lag(diagonal) over (partition by r, template order by diagonal)
  > case when kind = 'notice' then least(8, len(w) // 4) else 0 end as apart from v join k using (template)),
g as (select *, sum(case when apart is false then 0 else 1 end) over (partition by r, template order by diagonal) as part from a),
h as (select r, template, part, list(diagonal) as diagonals from g group by r, template, part, kind, w, n
  having sum(votes) >= case when kind = 'notice' then ((len(w) - n + 1) * {licenses.VOTES} + 99) // 100 else len(w) - n + 1 end),
q as (select r, template, part, unnest(diagonals) as diagonal from h),
e as (select q.r, q.template, part, t, min(diagonal + t) as p from q join k using (template) join d using (r), unnest(range(1, len(k.w) + 1)) as u(t)
  where diagonal + t >= 1 and d.w[diagonal + t] = k.w[t] group by all),
f as (select r, template, part, min(p) - 1 as start, max(p) as end_, count(*) as matched from e group by all),
s as (select r, part, start, end_, matched, kind, label, matched / len(w) as share from f join k using (template)
  where matched >= case when kind = 'notice' then len(w) * {licenses.LEAST} / 100 else len(w) end),
x as (select * from s as b where kind <> 'notice' or not exists (select 1 from s as a where a.r = b.r and a.kind = 'notice' and a.label <> b.label
  and a.start < b.end_ and b.start < a.end_ and (a.matched > b.matched or a.matched = b.matched and a.share > b.share))),
y as (select r, count(*) filter (kind = 'base') as n_base, min(start) filter (kind = 'base') as first_word, max(start) filter (kind = 'base') as last_word,
  string_agg(distinct label, ',' order by label) filter (kind = 'base') as base_labels, string_agg(distinct label, ',' order by label) as labels, max(share) as score from x group by r)
select doc_id, len(w) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels,
  coalesce(score, 0)::double as score from d left join y using (r)
"""


def with_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of documents; those whose crc32(doc_id as text) ends in 0 repeat a stretch of words to their end."""
    c = F.col
    h = F.crc32(c("doc_id").cast("string"))

    def repeated(words: Column) -> Column:
        n = F.size(words).cast("long")
        g = F.floor(h / 10)
        a = F.pmod(g, n)
        p = F.floor((n - a) / (3 + g % 8)) + 1
        return F.transform(words, lambda x, i: F.when(i >= a, F.get(words, (a + (i - a) % p).cast("int"))).otherwise(x))

    words = F.filter(F.split("text", _WHITE), lambda x: x != "")
    # inside a function of an array's element, the words are split once and not once for each word
    text = F.array_join(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(w))[0], " ")
    return docs.select("doc_id", F.when(h % 10 == 0, text).otherwise(c("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    found = runs.periodic_runs(with_repeats(table(spark, sf_dir, "documents")))
    # runs come by start, then period, so that the first of equal exponents stays
    higher = lambda r, b: b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"])
    best = F.aggregate("runs", F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), lambda b, r: F.when(higher(r, b), r).otherwise(b))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.withColumn("b", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        c("b.start").alias("start"),
        c("b.length").alias("length"),
        c("b.period").alias("period"),
        F.expr("b.length * 1000 div b.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: crc32 of the decimal doc_id, bit by bit; null for null.
_CRC_SQL = """cast(xor(list_reduce(list_concat([4294967295::ubigint], list_transform(string_split(doc_id::varchar, ''), lambda y: ascii(y)::ubigint)),
    lambda r, y: list_reduce(list_concat([xor(r, y)], range(0, 8)::ubigint[]), lambda x, k: case when x & 1 = 1::ubigint then xor(x >> 1, 3988292384::ubigint) else x >> 1 end)), 4294967295::ubigint) as bigint)"""

OP12_SQL = f"""
with d as (
  select row_number() over () as k, doc_id, {_CRC_SQL} as h, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents
), e as (
  select *, h // 10 as g, (h // 10) % len(w) as a from d
), f as (
  select *, 1 + (len(w) - a) // (3 + g % 8) as p from e
), w as (
  select k, doc_id, case when h % 10 = 0 and len(w) > 0 then list_transform(w, lambda x, i: case when i > a then w[a + (i - 1 - a) % p + 1] else x end) else w end as w from f
), g as (
  select k, unnest(range(16, len(w) + 1)) as i, unnest(list_transform(range(16, len(w) + 1), lambda i: array_to_string(w[i - 15:i], ' '))) as x from w where len(w) >= 24
), m as (
  select a.k, a.i, a.i - b.i as lag from g a join g b on a.k = b.k and a.x = b.x and b.i < a.i
), s as (
  select *, i - row_number() over (partition by k, lag order by i) as block from m
), t as (
  select k, lag, min(i) - 16 - lag as start, count(*) + 15 + lag as length from s group by k, lag, block
), r as (
  select k, start, length, min(lag) as period from t where length >= greatest(24, 3 * lag) group by k, start, length
), c as (
  select k, list(row(start, length, period) order by start, period) as r,
    arg_max(row(start, length, period), row(length::hugeint * 1000000000000 // period, -start, -period)) as b from r group by k
), u as (
  select k, list_sort(list_distinct(flatten(list(range(start + period, start + length))))) as gone from r group by k
)
select doc_id, coalesce(len(r), 0) as n_runs, b[1] as start, b[2] as length, b[3] as period, b[2] * 1000 // b[3] as exponent_milli,
  sha256(coalesce(array_to_string(list_transform(r, lambda x: x[1] || ',' || x[2] || ',' || x[3] || chr(10)), ''), '')) as runs_sha256,
  sha256(array_to_string(case when gone is null then w else list_filter(w, lambda x, i: not list_contains(gone, i - 1)) end, ' ')) as collapsed_sha256
from w left join c using (k) left join u using (k)
"""

def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    leaf = lambda n_chars: merkle.leaf_digest([c("doc_id"), c("source"), c("lang"), n_chars, c("text")])
    tampered = F.when(F.crc32(c("doc_id").cast("string")) % 7 == 0, leaf(c("n_chars") + 1))
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", leaf(c("n_chars")).alias("leaf"), tampered.alias("tampered"))
    folder = shared_folder(spark, "manifest")
    merkle.write_manifest(docs, folder)
    found = merkle.proofs(spark, folder)
    found = found.withColumn("folded_root", merkle.fold(F.coalesce("rest.tampered", "leaf"), c("proof")))
    return found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(c("proof")).alias("proof_sha256"), "folded_root", (c("folded_root") == c("root")).alias("verified"))


_LEAF_SQL = lambda n: "sha256(" + " || ".join(f"coalesce(strlen({x}) || ':' || {x}, '-')" for x in ("doc_id::varchar", "source", "lang", n, "text")) + ")"
_LEVEL_SQL = "list_transform(range(1, len(v) + 1, 2), lambda i: sha256(v[i] || coalesce(v[i + 1], '')))"
_SIBLING_SQL = "case when xor(pos >> level, 1) < len(v) then case when (pos >> level) & 1 = 1 then 'L' else 'R' end || v[xor(pos >> level, 1) + 1] else '-' end"

OP13_SQL = f"""
with recursive d as (
  select doc_id, lang, {_LEAF_SQL("n_chars::varchar")} as leaf,
    case when {_CRC_SQL} % 7 = 0 then {_LEAF_SQL("(n_chars + 1)::varchar")} end as tampered from documents
), p as (
  select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos, coalesce(lang, '') || '/' || (lang is null) as g from d
), t as (
  select g, 0::bigint as level, list(leaf order by pos) as v from p group by g
  union all select g, level + 1, {_LEVEL_SQL} from t where len(v) > 1
), s as (
  select g, v[1] as subroot, row_number() over (order by r, lang nulls first) - 1 as pos
  from (select distinct g, lang, lang is not null as r from p) join t using (g) where len(v) = 1
), u as (
  select 0::bigint as level, list(subroot order by pos) as v from s
  union all select level + 1, {_LEVEL_SQL} from u where len(v) > 1
), x as (
  select g, list({_SIBLING_SQL} order by level) as proof from s, u where len(v) > 1 group by g
), y as (
  select p.doc_id, p.leaf, p.g, p.pos, list({_SIBLING_SQL} order by level) as proof from p join t using (g) where len(v) > 1 group by all
), z as (
  select p.doc_id, p.leaf, subroot, v[1] as root, list_concat(coalesce(y.proof, []), coalesce(x.proof, [])) as proof, coalesce(tampered, p.leaf) as shown
  from p join s using (g) left join x using (g) left join y on y.g = p.g and y.pos = p.pos, u where len(u.v) = 1
), f as (
  select *, list_reduce(list_concat([shown], proof), lambda a, b: sha256(case when b = '-' then a when b[1] = 'L' then b[2:] || a else a || b[2:] end)) as folded_root from z
)
select doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(proof, lambda b: b[2:]), ''), '')) as proof_sha256, folded_root, folded_root = root as verified from f
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ann": op1_ann,
        "op2_minhash": op2_minhash,
        "op3_linedup": op3_linedup,
        "op4_langid": op4_langid,
        "op5_quality": op5_quality,
        "op6_bpe": op6_bpe,
        "op7_warc": op7_warc,
        "op8_chat": op8_chat,
        "op9_toxicity": op9_toxicity,
        "op10_decontam": op10_decontam,
        "op11_licenses": op11_licenses,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_merkle": op13_merkle,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_minhash": OP2_SQL, "op3_linedup": OP3_SQL, "op7_warc": OP7_SQL, "op8_chat": OP8_SQL, "op10_decontam": OP10_SQL, "op11_licenses": OP11_SQL, "op12_periodic_runs": OP12_SQL, "op13_merkle": OP13_SQL}
