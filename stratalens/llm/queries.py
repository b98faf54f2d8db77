"""The operators' queries, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.llm import chats, collocations, fingerprints, languages, lm_scores, mixing, mpeg, neardup, periodic_runs, recompression, sentencepieces, token_counts, toxicity
from stratalens.session import read_table


def vocabulary(name: str) -> str:
    """Place of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.digests(read_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints_with_edits(read_table(spark, sf_dir, "documents"))


def op5_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg.probe(mpeg.store(read_table(spark, sf_dir, "documents")))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.remove_repeats(read_table(spark, sf_dir, "documents"), digest=True)


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read_table(spark, sf_dir, "documents"), k=2, percent=80)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.identify(read_table(spark, sf_dir, "pages"), languages.fit(read_table(spark, sf_dir, "documents")))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.score(docs, *toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = lm_scores.lm_scores(read_table(spark, sf_dir, "documents"))
    return x.select("doc_id", "n_words", "log_score", "mean_log_score", "perplexity", *[F.col("by_order")[i].alias(f"n_by_{i}") for i in range(lm_scores.ORDER + 1)])


def op11_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chats.digests(chats.windows(turns.unionByName(more)))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(periodic_runs.periodic_runs(periodic_runs.with_periods(read_table(spark, sf_dir, "documents"))))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read_table(spark, sf_dir, "documents"))


def fingerprint_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What operator 4 makes of the texts that it fingerprints: the columns that SQL can check."""
    return op4_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def audio_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What operator 5 reads back from its streams: the columns that SQL can check."""
    return op5_mpeg_audio(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sentencepiece, op2_mixing, op3_token_counts, op4_fingerprints, op5_mpeg_audio, op6_substring_dedup, op7_near_dedup, op8_language_id, op9_toxicity, op10_lm_scores, op11_chat_windows, op12_periodic_runs, op13_collocations, fingerprint_edits, audio_payloads)}


WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SQL = {
    "fingerprint_edits": """
with d as (select doc_id, coalesce(text, '') as t, coalesce(lead(coalesce(text, '')) over w, first_value(coalesce(text, '')) over w) as nxt from documents window w as (order by doc_id))
select doc_id, length(t) as n_chars, sha256(substr(t, 1, length(t) - length(t) // 2) || substr(nxt, 1, length(t) // 2)) as edited_sha256 from d""",
    "audio_payloads": """
with d as (select doc_id, coalesce(text, '') as t, cast(strlen(coalesce(text, '')) as bigint) as n_bytes from documents), p as (select *, greatest(64, (n_bytes + 63) // 64 * 64) as payload_bytes from d)
select doc_id, n_bytes, payload_bytes, sha256(t || repeat(chr(0), cast(payload_bytes - n_bytes as bigint))) as payload_sha256 from p""",
    "op2_mixing": f"""
with d as (select doc_id, source, cast(len({WORDS}) as bigint) as size, md5(concat_ws(':', '17', coalesce(cast(doc_id as varchar), md5(coalesce(text, ''))), source)) as key from documents),
s as (select source, sum(size)::double as n from d group by source),
w as (select source, n, 2.0::double * n as cap, [5.0, 2.0, 1.0][1 + (row_number() over (order by source nulls last) - 1) % 3]::double as weight from s),
f as (select *, sum(cap) over (order by cap / weight, source nulls last) - cap as filled, sum(weight) over () - sum(weight) over (order by cap / weight, source nulls last) + weight as open, 1.5::double * sum(n) over () as total from w),
l as (select *, (total - filled) / open as level from f),
t as (select source, n, weight, cap, (select level from l where level * weight <= cap order by cap / weight, level limit 1) as level from l),
g as (select source, cast(n as bigint) as source_size, least(coalesce(level * weight, cap), cap) as target from t),
x as (select d.doc_id, d.size, d.source, g.source_size, g.target, cast(round(g.target) as bigint) as whole, cast(sum(d.size) over (partition by d.source order by d.key, d.doc_id, d.size rows unbounded preceding) as bigint) - d.size as before from d join g on d.source is not distinct from g.source)
select doc_id, size, source, source_size, target, case when source_size > 0 then (whole // source_size) * size + greatest(0, least(size, whole - (whole // source_size) * source_size - before)) else 0 end as taken from x""",
    "op6_substring_dedup": f"""
with d as (select doc_id, {WORDS} as ws from documents),
x as (select doc_id, i, array_to_string(ws[i : i + 19], ' ') as win from d, unnest(range(1, len(ws) - 18)) as u(i)),
late as (select doc_id, i from x qualify row_number() over (partition by win order by doc_id, i) > 1),
gone as (select distinct doc_id, j from late, unnest(range(i, i + 20)) as u(j)),
k as (select d.doc_id, j, d.ws[j] as word from d, unnest(range(1, len(ws) + 1)) as u(j)),
r as (select k.doc_id, count(g.j) as n_removed, string_agg(k.word, ' ' order by k.j) filter (where g.j is null) as kept from k left join gone g on k.doc_id = g.doc_id and k.j = g.j group by k.doc_id)
select d.doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(n_removed, 0) as bigint) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join r using (doc_id)""",
    "op7_near_dedup": f"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as materialized (select distinct doc_id, hash(sh) as sh from (select doc_id, ws[i : i + 1] as sh from d, unnest(range(1, greatest(len(ws), 2))) as u(i) where len(ws) > 0)),
n as materialized (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by 1, 2),
e as materialized (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 80 * (a.n + b.n - c)),
links as materialized (select x, y from e union all select y, x from e),
reach(node, root) as (select doc_id, doc_id from documents union select l.y, r.root from reach r join links l on l.x = r.node where r.root < l.y),
c as (select node as doc_id, min(root) as component_id from reach group by 1)
select c.doc_id, coalesce(n.n, 0) as n_shingles, c.component_id, c.doc_id = c.component_id as kept from c left join n using (doc_id)""",
    "op10_lm_scores": f"""
with d as (select doc_id, {WORDS} as ws from documents),
w as materialized (select doc_id, i, ws[i] as w3, case when i > 1 then ws[i - 1] end as w2, case when i > 2 then ws[i - 2] end as w1 from d, unnest(range(1, len(ws) + 1)) as u(i)),
o1 as materialized (select doc_id, w3, count(*) as n from w group by all), o2 as materialized (select doc_id, w2, w3, count(*) as n from w where w2 is not null group by all), o3 as materialized (select doc_id, w1, w2, w3, count(*) as n from w where w1 is not null group by all),
a1 as materialized (select w3, sum(n) as n from o1 group by 1), a2 as materialized (select w2, w3, sum(n) as n from o2 group by 1, 2), a3 as (select w1, w2, w3, sum(n) as n from o3 group by 1, 2, 3),
e1 as materialized (select o1.doc_id, w3, cast(a1.n - o1.n as bigint) as n from o1 join a1 using (w3)), e2 as materialized (select o2.doc_id, w2, w3, cast(a2.n - o2.n as bigint) as n from o2 join a2 using (w2, w3)), e3 as materialized (select o3.doc_id, w1, w2, w3, cast(a3.n - o3.n as bigint) as n from o3 join a3 using (w1, w2, w3)),
total as (select count(*) as n from w), size as (select doc_id, count(*) as m from w group by 1),
t as (select w.doc_id, case when c3.n > 0 then 3 when c2.n > 0 then 2 when c1.n > 0 then 1 else 0 end as o, case when c3.n > 0 then ln(c3.n / h2.n) else case when w.w1 is not null then ln(0.4) else 0 end + case when c2.n > 0 then ln(c2.n / h1.n) else case when w.w2 is not null then ln(0.4) else 0 end + case when c1.n > 0 then ln(c1.n) else ln(0.4) end - ln(greatest(total.n - size.m, 1)) end end as s
from w join size using (doc_id) join e1 c1 on w.doc_id = c1.doc_id and w.w3 = c1.w3 left join e2 c2 on w.doc_id = c2.doc_id and w.w2 = c2.w2 and w.w3 = c2.w3 left join e3 c3 on w.doc_id = c3.doc_id and w.w1 = c3.w1 and w.w2 = c3.w2 and w.w3 = c3.w3 left join e1 h1 on h1.doc_id = w.doc_id and h1.w3 = w.w2 left join e2 h2 on h2.doc_id = w.doc_id and h2.w2 = w.w1 and h2.w3 = w.w2, total),
g as (select doc_id, sum(s) as s, count(*) as n, count(*) filter (where o = 0) as n0, count(*) filter (where o = 1) as n1, count(*) filter (where o = 2) as n2, count(*) filter (where o = 3) as n3 from t group by 1)
select d.doc_id, coalesce(n, 0) as n_words, round(coalesce(s, 0), 6) as log_score, round(s / n, 9) as mean_log_score, round(exp(-s / n), 6) as perplexity, coalesce(n0, 0) as n_by_0, coalesce(n1, 0) as n_by_1, coalesce(n2, 0) as n_by_2, coalesce(n3, 0) as n_by_3 from d left join g using (doc_id)""",
    "op11_chat_windows": f"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations union all select -7, unnest([0, 1]), unnest(['user', 'assistant']), '\\### Assistant: </turn> ok'),
n as (select *, len({WORDS}) + 4 as n, row_number() over (partition by conv_id order by turn nulls first, role, md5(text)) as pos from c),
s as (select conv_id, n as s_n from n where pos = 1 and role = 'system'),
u as (select n.*, s_n, coalesce(s_n, 0) as sys, pos = 1 and s_n is not null as is_system, sum(n) over (partition by n.conv_id order by pos) as upto, length(text) + len(regexp_extract_all(text, '\\\\')) + len(regexp_extract_all(text, '</turn>')) + len(regexp_extract_all(text, '#')) - len(regexp_extract_all(text, '#+')) + length(role) + 14 as chars from n left join s on n.conv_id is not distinct from s.conv_id),
p as (select *, greatest({chats.BUDGET - chats.HISTORY} - sys, {chats.BUDGET // 4}) as room, case when is_system then 0 else n end as size, case when is_system then 0 else upto - n - sys end as p0 from u),
q as materialized (select *, p0 // room as cell, p0 + size > (p0 // room + 1) * room as alone, least({chats.HISTORY}, room) as back from p),
w as (select conv_id, cell, alone, min(p0) as start, min(pos) as first, max(size) as size, any_value(room) as room, any_value(back) as back, bool_or(is_system) as has_system, any_value(s_n) as s_n from q group by all),
again as (select w.conv_id, sum(q.chars) as chars from w join q on w.conv_id is not distinct from q.conv_id where not q.is_system and q.p0 >= w.start - w.back and q.pos < w.first and not (w.alone and w.size > w.room) group by 1),
head as (select w.conv_id, sum(q.chars) as chars from w join q on w.conv_id is not distinct from q.conv_id and q.is_system where not w.has_system group by 1),
t as (select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by pos)) as turns_sha256, coalesce(string_agg(text, '' order by pos) filter (where role = 'assistant'), '') as learnt, sum(chars) as chars from q group by 1)
select t.conv_id, n_turns, turns_sha256, length(learnt) as loss_chars, sha256(learnt) as loss_sha256, cast(t.chars + coalesce(again.chars, 0) + coalesce(head.chars, 0) as bigint) as formatted_chars from t left join again on t.conv_id is not distinct from again.conv_id left join head on t.conv_id is not distinct from head.conv_id""",
    "op13_collocations": """
with p as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as materialized (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from p),
g as (select lang, array_to_string(ws[i : i + k - 1], ' ') as phrase, k from w, unnest([1, 2, 3]) as s(k), unnest(range(1, len(ws) - k + 2)) as u(i)),
f as materialized (select lang, phrase, k, count(*) as a from g group by all having count(*) >= 10),
n as (select lang, sum(len(ws)) as n from w group by 1),
c as (select lang, phrase, a, k, string_split(phrase, ' ') as ws from f where k > 1),
x as (select lang, phrase, a, j, array_to_string(ws[1 : j], ' ') as first, array_to_string(ws[j + 1 :], ' ') as rest from c, unnest(range(1, k)) as u(j)),
y as (select x.lang, x.phrase, x.a, x.j, l.a as l, r.a as r, (1000000::hugeint * x.a * x.a) // (l.a::hugeint * r.a) as score from x join f l on l.lang = x.lang and l.phrase = x.first join f r on r.lang = x.lang and r.phrase = x.rest),
z as (select * from y qualify row_number() over (partition by lang, phrase order by score, j) = 1),
i as (select lang, a, unnest([array_to_string(ws[1 : 2], ' '), array_to_string(ws[2 : 3], ' ')]) as phrase from c where k = 3),
m as (select lang, phrase, max(a) as most from i group by all),
o as (select z.* from z left join m using (lang, phrase) where most is null or 100 * most < 50 * z.a)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, cast(n as bigint) as n, cast(score as bigint) as score from o join n using (lang) qualify rank <= 2000""",
    "op12_periodic_runs": f"""
with c as (select doc_id, {WORDS} as ws, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(cast(doc_id as varchar), ''), lambda x: [ascii(x)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda r, e: case when e >= 0 then xor(r, e) else xor(r >> 1, 3988292384 * (r & 1)) end)) as h from documents),
g as (select doc_id, ws, len(ws)::bigint as n, h, h // 10 as g from c),
a as (select *, case when n > 0 and h % 10 = 0 then g % n end as a from g),
p as (select *, 1 + (n - a) // (3 + g % 8) as p from a),
d as materialized (select doc_id, n, case when a is null then ws else list_transform(range(0, n), lambda i: ws[case when i < a then i else a + (i - a) % p end + 1]) end as ws from p),
x as materialized (select doc_id, i, hash(ws[i + 1 : i + 6]) as k from d, unnest(range(0, n - 5)) as u(i)),
m as (select doc_id, x.i, y.i - x.i as q from x join x y using (doc_id, k) where x.i < y.i),
e as (select doc_id, q, min(i) as s, count(*) + 5 + q as size from (select *, i - row_number() over (partition by doc_id, q order by i) as island from m) group by doc_id, q, island having count(*) + 5 + q >= greatest(12, 2 * q)),
r as materialized (select * from e where not exists (select 1 from e o where o.doc_id = e.doc_id and o.q < e.q and o.s <= e.s and o.s + o.size >= e.s + e.size)),
gone as (select distinct doc_id, j from r, unnest(range(s + q, s + size)) as u(j)),
w as (select doc_id, j, ws[j + 1] as word from d, unnest(range(0, n)) as u(j)),
k as (select w.doc_id, string_agg(w.word, ' ' order by w.j) as kept from w anti join gone on w.doc_id = gone.doc_id and w.j = gone.j group by w.doc_id),
b as (select doc_id, count(*) as n_runs, arg_min(row(s, size, q), row(-size, s, q)) as best, string_agg(s || ',' || size || ',' || q || chr(10), '' order by s, q) as lines from r group by doc_id)
select d.doc_id, coalesce(b.n_runs, 0) as n_runs, cast(best[1] as bigint) as start, cast(best[2] as bigint) as length, cast(best[3] as bigint) as period, cast(1000 * best[2] // best[3] as bigint) as exponent_milli, sha256(coalesce(lines, '')) as runs_sha256, sha256(coalesce(kept, '')) as collapsed_sha256 from d left join b using (doc_id) left join k using (doc_id)""",
}


def oracle_sql() -> dict[str, str]:
    """SQL of the operators that it can express; the others are held against brute force in tests/llm."""
    return dict(SQL)
