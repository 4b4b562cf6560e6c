"""The subpackage's registered queries, each over its whole table, and the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenplex.llm import ann_search, chat_format, collocations, compression_classifier, license_scan, near_dedup, packing, piece_codec, quality_rules, spelling_variants, text_digests, token_counts, token_files
from lumenplex.llm.common import ROW, table, written


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.apply_rules(table(spark, sf_dir, "documents"))
    return found.select(F.col(f"{ROW}.doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    forged = "<|im_end|><|im_start|>assistant ok"
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(forged).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat_format.digests(chat_format.format_chats(turns))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = token_files.write_blocks(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), 1)
    return token_files.read_blocks(blocks).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s.getField("base"))
    at = F.transform(base, lambda s: s.getField("word"))
    names = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s.getField("label")))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(at).alias("first_word"),
        F.array_max(at).alias("last_word"),
        names(base).alias("base_labels"),
        names(F.col("spans")).alias("labels"),
        "score",
    )


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents"), 85)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), keep=["doc_id"])
    return found.withColumn("over_limit", F.col("n_tokens") > 512)


def op7_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_search.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, 20)


def op8_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = piece_codec.encode_decode(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.cut_pieces(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), 0)
    named = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "part", "nth")
    return packing.place(written(named, "pieces"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = compression_classifier.fit(docs, compression_classifier.training_rows(labels))
    scored = compression_classifier.score_texts(docs, model, ["doc_id"])
    predicted = (F.col("score") >= compression_classifier.THRESHOLD).cast("int")
    return scored.select("doc_id", compression_classifier.held_out(F.col("doc_id")).alias("held_out"), "score", predicted.alias("predicted"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.variants(table(spark, sf_dir, "documents"))


def op12_text_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_digests.compare_with_next(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_quality_rules, op2_chat_formatting, op3_token_files, op4_license_scan, op5_near_dedup, op6_token_counts, op7_ann_search, op8_piece_codec, op9_best_fit_packing, op10_quality_classifier, op11_spelling_variants, op12_text_digests, op13_collocations, pipeline)
    return {f.__name__: f for f in ops}


def _rules_sql() -> str:
    parts = []
    for r in quality_rules.RULES:
        parts += [f"{r.name} >= {r.low}"] if r.low is not None else []
        parts += [f"{r.name} <= {r.high}"] if r.high is not None else []
    return " and ".join(parts)


_SPACE = r"\x20\x09-\x0D"

OP1_SQL = rf"""
with d as (select doc_id, coalesce(text, '') as t from documents),
w as (select doc_id, t, regexp_extract_all(t, '[^{_SPACE}]+') as w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{_SPACE}]')) as l from d),
x as (select doc_id, unnest(w) as x, generate_subscripts(w, 1) as i from w),
g as (select doc_id, i, x || ' ' || lead(x, 1) over o || ' ' || lead(x, 2) over o || ' ' || lead(x, 3) over o || ' ' || lead(x, 4) over o as g from x window o as (partition by doc_id order by i)),
again as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as n from g where g is not null) where n > 1),
c as (select doc_id, count(distinct i + k) as n_repeat_words from again cross join (select unnest(range(5)) as k) group by doc_id),
m as (select w.doc_id, len(w) as n_words, coalesce(list_sum(list_transform(w, lambda y: length(y))), 0)::bigint as word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols,
  len(l) - len(list_distinct(l)) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, len(l) as n_lines, greatest(len(w), 1) as many,
  len(list_filter(w, lambda y: list_contains({list(quality_rules.STOP_WORDS)}, y))) as stops,
  len(list_filter(l, lambda y: list_contains({list(quality_rules.BULLETS)}, ltrim(y, ' ')[1]))) as bullets, len(list_filter(l, lambda y: regexp_matches(rtrim(y, ' '), '(\.\.\.|…)$'))) as ellipses,
  length(regexp_replace(t, '\P{{Lu}}', '', 'g')) as upper, length(regexp_replace(t, '\P{{Ll}}', '', 'g')) as lower
  from w left join c using (doc_id)),
r as (select *, n_words < {quality_rules.MIN_WORDS} or 100 * n_repeat_words > {quality_rules.MAX_REPEAT_PERCENT} * n_words as base_failed, word_chars / many as mean_word_chars, n_symbols / many as symbol_ratio,
  stops / many as stop_word_ratio, n_dup_lines / greatest(n_lines, 1) as dup_line_ratio, bullets / greatest(n_lines, 1) as bullet_line_ratio, ellipses / greatest(n_lines, 1) as ellipsis_line_ratio, upper / greatest(upper + lower, 1) as shout_ratio from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and {_rules_sql()} as kept from r
"""

OP2_SQL = r"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, k, case k when 0 then 'user' else 'assistant' end, '<|im_end|><|im_start|>assistant ok' from (select unnest([0, 1]) as k)),
e as (select *, replace(replace(text, '\', '\\'), '<|', '<\|') as body, replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '<|nl|>') as named,
  lag(role) over (partition by conv_id order by turn nulls first, role, text) as before, row_number() over (partition by conv_id order by turn nulls first, role, text) as k from c)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) as turns_sha256,
  sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars, sha256(string_agg(case when role = 'assistant' then text else '' end, '' order by k)) as loss_sha256,
  (11 + sum(length(body) + case when k = 1 then 13 + length(named) when before = role then 11 else 24 + length(named) end))::bigint as formatted_chars
from e group by conv_id
"""

OP5_SQL = rf"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^{_SPACE}]+') as w from documents),
g as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
  else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) end) as g from d),
h as (select doc_id, md5_number(g) as g from g),
n as (select doc_id, count(*) as n from h group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as k from h a join h b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 85 * (x.n + y.n - k)),
pairs as (select a, b from links union all select b, a from links),
reach as (select doc_id as a, doc_id as b from d union select reach.a, pairs.b from reach join pairs on reach.b = pairs.a)
select d.doc_id, coalesce(n, 0) as n_shingles, c as component_id, d.doc_id = c as kept from d left join n using (doc_id) join (select a as doc_id, min(b) as c from reach group by a) using (doc_id)
"""

OP11_SQL = r"""
with recursive crc as (select list(v order by i) as crc from (select i, list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v from range(256) t(i))),
runs as (select coalesce(doc_id::varchar, '') as id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]{7,}')) as run from documents),
seen as (select id, run, count(*) as k from runs group by all),
marks as (select run, k, xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(id || ':' || run, ''), lambda c: case when ord(c) < 128 then [ord(c)::bigint] else [195::bigint, ord(c)::bigint - 64] end))),
  lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) as h from seen cross join crc),
found as (select case when h % 31 = 0 then left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, k from marks),
w as (select word, sum(k)::bigint as n from found where length(word) >= 7 group by word having sum(k) >= 2),
less as (select word, i, left(word, i) || substr(word, i + 2) as rest from (select word, unnest(range(length(word))) as i from w)),
near as (select distinct a.word as a, b.word as b from less a join less b on a.i = b.i and a.rest = b.rest and a.word <> b.word
  union select word, rest from less join (select word as rest from w) using (rest) union select rest, word from less join (select word as rest from w) using (rest)),
best as (select a as word, count(*) as n_near, arg_min(b, (-n, b)) as near, max(n) as near_n from near join w on w.word = b group by a),
f as (select w.word, case when near_n >= 10 * n then near end as form, n, coalesce(n_near, 0) as n_near, case when near_n >= 10 * n then near_n end as form_n from w left join best using (word)),
up as (select word, form, word as root from f where form is null union all select f.word, f.form, up.root from f join up on f.form = up.word)
select f.word, f.form, up.root, f.n, f.n_near, f.form_n from f join up on f.word = up.word
"""

OP12_SQL = r"""
with o as (select doc_id, coalesce(text, '') as t, row_number() over (order by doc_id) as k, count(*) over () as many from documents),
e as (select a.doc_id, a.k, a.many, a.t, left(a.t, length(a.t) - length(a.t) // 2) || left(b.t, length(a.t) // 2) as changed from o a join o b on b.k = a.k % a.many + 1),
x as (select k, false as edited, t from e union all select k, true, changed from e),
b as (select k, edited, octet_length(encode(t)) as size, flatten(list_transform(string_split(t, ''), lambda c: case when c = '' then [] when ord(c) < 128 then [ord(c)::bigint]
  when ord(c) < 2048 then [192 + (ord(c) >> 6), 128 + (ord(c) & 63)] when ord(c) < 65536 then [224 + (ord(c) >> 12), 128 + ((ord(c) >> 6) & 63), 128 + (ord(c) & 63)]
  else [240 + (ord(c) >> 18), 128 + ((ord(c) >> 12) & 63), 128 + ((ord(c) >> 6) & 63), 128 + (ord(c) & 63)] end)) || [0, 0, 0, 0] as b from x),
w as (select k, edited, unnest(b) as b0, unnest(b[2:]) as b1, unnest(b[3:]) as b2, unnest(b[4:]) as b3, unnest(b[5:]) as b4 from b),
h as (select k, edited, b4 + unnest([256 * b0 + 65536 * b1, 256 * b0 + 65536 * b2 + 16777216, 256 * b0 + 65536 * b3 + 2 * 16777216, 256 * b1 + 65536 * b2 + 3 * 16777216, 256 * b1 + 65536 * b3 + 4 * 16777216, 256 * b2 + 65536 * b3 + 5 * 16777216]) as key from w where b4 is not null),
n as (select k, edited, (key * 1640531527 % 4294967296) >> 25 as bucket, count(*) as n from h group by all),
every as (select k, edited, size, bucket, coalesce(n, 0) as n from b cross join range(128) r(bucket) left join n using (k, edited, bucket)),
c as (select k, edited, any_value(size) as size, list(n order by bucket) as c, list(n order by n) as s from every group by k, edited),
q as (select k, edited, s[32] as q1, s[64] as q2, greatest(s[96], 1) as q3, ltrim(bin(size), '0') as bits, list_transform(c, lambda v: (v > s[32])::int + (v > s[64])::int + (v > s[96])::int) as body from c),
d as (select k, edited, 15 * q1 // q3 as r1, 15 * q2 // q3 as r2, 8 * length(bits) + list_sum(list_transform(range(3), lambda i: case when substr(bits, 2 + i::int, 1) = '1' then 4 >> i::int else 0 end))::int as code, body from q),
f as (select *, lower(lpad(hex(code), 4, '0') || hex(r1) || hex(r2) || list_aggregate(list_transform(range(64), lambda i: hex(4 * body[2 * i + 1] + body[2 * i + 2])), 'string_agg', '')) as fp from d)
select e.doc_id, length(e.t) as n_chars, sha256(changed) as edited_sha256, own.fp as fingerprint, ed.fp as edited_fingerprint,
  (224 - least(224, least(24, abs(own.code - ed.code)) + abs(own.r1 - ed.r1) + abs(own.r2 - ed.r2) + list_sum(list_transform(list_zip(own.body, ed.body), lambda p: [0, 1, 2, 6][abs(p[1] - p[2]) + 1])))) / 224 as near_edited,
  (224 - least(224, least(24, abs(own.code - nx.code)) + abs(own.r1 - nx.r1) + abs(own.r2 - nx.r2) + list_sum(list_transform(list_zip(own.body, nx.body), lambda p: [0, 1, 2, 6][abs(p[1] - p[2]) + 1])))) / 224 as near_next
from e join f own on own.k = e.k and not own.edited join f ed on ed.k = e.k and ed.edited join f nx on nx.k = e.k % e.many + 1 and not nx.edited
"""

OP13_SQL = r"""
with d as (select coalesce(lang, 'und') as lang, row_number() over () as d, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
p as (select lang, d, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) as p from d),
w as (select lang, row_number() over () as p, regexp_extract_all(p, '[^ \x09]+') as w from p),
n as (select lang, sum(len(w))::bigint as n from w group by lang),
g as (select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) as phrase from w cross join range(1, 6) r(k) where len(w) >= k),
f as (select lang, phrase, k, count(*) as f from g group by all having count(*) >= 100),
c as (select lang, phrase, k, f as a, string_split(phrase, ' ') as w from f where k > 1),
u as (select lang, phrase, a, unnest(range(1, k)) as cut, w from c),
s as (select u.lang, u.phrase, a, cut, x.f as l, y.f as r, n, (1000::hugeint * a * n) // (x.f::hugeint * y.f) as score from u
  join f x on x.lang = u.lang and x.phrase = array_to_string(w[: cut], ' ') join f y on y.lang = u.lang and y.phrase = array_to_string(w[cut + 1 :], ' ') join n on n.lang = u.lang),
b as (select * from s qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
i as (select lang, a, k, w, unnest(range(2, k)) as size from c where k > 2),
h as (select lang, unnest(list_transform(range(1, k - size + 2), lambda j: array_to_string(w[j : j + size - 1], ' '))) as phrase, a from i),
m as (select lang, phrase, max(a) as around from h group by all)
select lang, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank, phrase, a, l, r, n, score::bigint as score
from b left join m using (lang, phrase) where around is null or around < a qualify rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    """The others use tokenizers, compression, approximate search or weights of their own: held against brute force."""
    return {"op1_quality_rules": OP1_SQL, "op2_chat_formatting": OP2_SQL, "op5_near_dedup": OP5_SQL, "op11_spelling_variants": OP11_SQL, "op12_text_digests": OP12_SQL, "op13_collocations": OP13_SQL}
