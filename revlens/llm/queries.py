"""The registered queries of the training-data operators and the DuckDB SQL
of those that SQL can express on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from revlens.sources.tables import read_table


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from revlens.llm.sentencepiece_sa import encode

    return encode(read_table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from revlens.llm.token_counts import count_tokens

    return count_tokens(read_table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from revlens.llm.language_id import identify

    return identify(read_table(spark, sf_dir, "documents"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from revlens.llm.lm_score import score

    return score(read_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from revlens.llm.toxicity import score, train

    docs = read_table(spark, sf_dir, "documents")
    return score(docs, train(docs, read_table(spark, sf_dir, "labels")))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from revlens.llm.secret_scan import scan

    return scan(read_table(spark, sf_dir, "documents"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from revlens.llm.embedding_dedup import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from revlens.llm.simhash import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from revlens.llm.decontaminate import digest, find_spans

    return digest(find_spans(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from revlens.llm.substring_dedup import dedup_substrings, digest

    return digest(dedup_substrings(read_table(spark, sf_dir, "documents")))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from revlens.llm.fill_in_middle import digest, transform

    return digest(transform(read_table(spark, sf_dir, "documents")))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from revlens.llm.conversation_repair import damage, digest, repair

    return digest(repair(damage(read_table(spark, sf_dir, "conversations")), live_col="live"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from revlens.llm.mixing import digest, mix

    return digest(mix(read_table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_sentencepiece, op2_token_counts, op3_language_id, op4_lm_score, op5_toxicity,
                                op6_secret_scan, op7_embedding_dedup, op8_simhash, op9_decontaminate, op10_substring_dedup,
                                op11_fill_in_middle, op12_conversation_repair, op13_mixing)
}

#: Words of a window as one string: words hold no blank, so it is unambiguous.
OP9_SQL = r"""
with dw as (select row_number() over () as r, doc_id,
                   regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                       'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+') as w from documents),
bw as (select cast(item_id as varchar) as item_id,
              regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                  'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+') as w from benchmark),
bs as (select item_id, w, least(10, len(w)) as size from bw where len(w) > 0),
bwin as (select distinct item_id, size, array_to_string(w[i:i + size - 1], ' ') as win
         from bs, unnest(range(1, len(w) - size + 2)) as t(i)),
sizes as (select distinct size from bwin),
dwin as (select r, i, size, array_to_string(w[i:i + size - 1], ' ') as win
         from dw cross join sizes, unnest(range(1, len(w) - size + 2)) as t(i)),
occ as (select d.r, d.i, d.size, b.item_id from dwin d join bwin b on b.size = d.size and b.win = d.win),
hit as (select r, count(distinct p) as n_hit from occ, unnest(range(i, i + size)) as t(p) group by r),
items as (select r, count(*) as n_items, string_agg(item_id, ',' order by item_id) as names
          from (select distinct r, item_id from occ) group by r)
select dw.doc_id, cast(len(dw.w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw left join hit using (r) left join items using (r)
"""

OP10_SQL = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select doc_id, i, array_to_string(w[i:i + 19], ' ') as win from w, unnest(range(1, len(w) - 18)) as t(i)),
again as (select doc_id, i from (select doc_id, i, row_number() over (partition by win order by doc_id, i) as k from win) where k > 1),
gone as (select distinct doc_id, p from again, unnest(range(i, i + 20)) as t(p)),
words as (select doc_id, p, w[p] as word from w, unnest(range(1, len(w) + 1)) as t(p)),
kept as (select doc_id, string_agg(word, ' ' order by p) as kept from words anti join gone using (doc_id, p) group by doc_id),
n as (select doc_id, count(*) as n_removed from gone group by doc_id)
select w.doc_id, cast(len(w.w) as bigint) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from w left join n using (doc_id) left join kept using (doc_id)
"""

#: Numbers are hex groups of the digest.
OP11_SQL = r"""
with t as (select doc_id, coalesce(text, '') as text,
                  regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as u,
                  sha256('42:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
d as (select *, cast('0x' || substr(h, 1, 8) as bigint) % (len(u) + 1) as c1, cast('0x' || substr(h, 9, 8) as bigint) % (len(u) + 1) as c2,
             case when text = '' or regexp_matches(text, '<[PSM]>') or cast('0x' || substr(h, 17, 8) as bigint) % 100 >= 50 then 'plain'
                  when cast('0x' || substr(h, 25, 8) as bigint) % 100 < 80 then 'spm' else 'psm' end as form from t),
p as (select *, array_to_string(u[1:least(c1, c2)], '') as pre, array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') as mid,
             array_to_string(u[greatest(c1, c2) + 1:], '') as suf from d)
select doc_id, cast(len(u) as bigint) as n, form, case when form <> 'plain' then length(pre) end as prefix_chars,
       case when form <> 'plain' then length(mid) end as middle_chars,
       sha256(case form when 'plain' then text when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid
                   else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256,
       sha256(pre || mid || suf) as restored_sha256
from p
"""



def _plus(of: str, cost: str, edit: str) -> str:
    """SQL: a state of the repair with an edit more.  A state is its cost in
    nine digits and its edits, so the least string is the cheapest and first."""
    return f"lpad(cast(cast(substr({of}, 1, 9) as int) + {cost} as varchar), 9, '0') || substr({of}, 10) || {edit}"


_TO_USER = "least(u, " + _plus("e", "2", "'I'") + ", " + _plus("s", "2", "'I'") + ", " + _plus("a", "2", "'I'") + ")"
_FROM = "least(e0, s0, a0)"

#: x: states after inserts; the row's edits follow; then the edits are replayed.
OP12_SQL = rf"""
with recursive c as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    xor(list_reduce(list_concat([cast(4294967295 as bigint)], list_transform(string_split(
            coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' '), ''), lambda x: cast(ascii(x) as bigint))),
        lambda h, b: list_reduce(list_concat([xor(h, b)], range(8)),
            lambda x, i: xor(x >> 1, case when x & 1 = 1 then cast(3988292384 as bigint) else 0 end))), cast(4294967295 as bigint)) % 20 as kind
    from conversations),
d as (select conv_id, turn, case kind when 4 then 'user' else role end as role,
             case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
      from c, unnest(range(case kind when 0 then 0 when 3 then 2 else 1 end)) as t(i)),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as k from d),
f as (select *, not regexp_matches(text, '[^ 	-]') as blank,
             row_number() over (partition by conv_id, role, text order by k) > 1 as again,
             not regexp_matches(text, '[.!?][ 	-]*$') as cut, substr(role, 1, 1) as i,
             lag(substr(role, 1, 1)) over (partition by conv_id order by k) as before from o),
g as (select *, blank or again as go, cast(cut and not blank and not again as int) as more from f),
facts as (select conv_id, cast(coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as bigint) as gaps,
                 count(*) filter (blank) as blank, count(*) filter (again and not blank) as duplicate,
                 cast(sum(more) as bigint) as truncated,
                 count(*) filter (before is not null and before || i not in ('su', 'ua', 'au')) as illegal, max(k) as n from g group by conv_id),
rec as (select conv_id, cast(0 as bigint) as k, '000000000' as e, cast(null as varchar) as s, cast(null as varchar) as u, cast(null as varchar) as a
        from facts
        union all
        select conv_id, k, {_plus("e0", "3", "'D'")},
               least({_plus("s0", "3", "'D'")}, case when not go and i = 's' then {_plus("e0", "more", "'K'")} end),
               least({_plus("u0", "3", "'D'")}, case when go then null when i = 'u' then {_plus(_FROM, "more", "'K'")}
                     else {_plus(_FROM, "2 + more", "'R'")} end),
               least({_plus("a0", "3", "'D'")}, case when go then null when i = 'a' then {_plus("u0", "more", "'K'")}
                     else {_plus("u0", "2 + more", "'R'")} end)
        from (select x.*, least(a, {_plus("u0", "2", "'I'")}) as a0 from (
              select g.*, e as e0, s as s0, a, {_TO_USER} as u0
              from rec join g on g.conv_id is not distinct from rec.conv_id and g.k = rec.k + 1) x)),
best as (select rec.conv_id, least(e, a, {_plus("u", "2", "'I'")}, {_plus("s", "4", "'II'")}) as v
         from rec join facts on rec.conv_id is not distinct from facts.conv_id and rec.k = n),
play as (select conv_id, substr(v, 10) as audit, 0 as p, cast(0 as bigint) as k, '' as state, cast(null as varchar) as done from best
         union all
         select play.conv_id, audit, p + 1, case when ed = 'I' then play.k else g.k end,
                case when ed = 'D' then state when ed = 'K' then i when state = 'u' then 'a' else 'u' end,
                case when ed = 'D' then done else coalesce(done || chr(10), '') || case when ed = 'K' then role when state = 'u' then 'assistant' else 'user' end
                     || ':' || case when ed = 'I' then '' else text end end
         from (select *, substr(audit, p + 1, 1) as ed from play where p < length(audit)) play
              left join g on g.conv_id is not distinct from play.conv_id and g.k = play.k + 1)
select q.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
       coalesce(illegal, 0) as illegal, coalesce(cast(substr(v, 1, 9) as bigint), 0) as cost, coalesce(substr(v, 10), '') as audit,
       sha256(coalesce(done, '')) as repaired_sha256
from (select distinct conv_id from conversations) q left join facts on q.conv_id is not distinct from facts.conv_id
     left join best on q.conv_id is not distinct from best.conv_id
     left join (select * from play where p = length(audit)) r on q.conv_id is not distinct from r.conv_id
"""

#: The level is searched over all sources; 16777216 parts are a copy.
OP13_SQL = r"""
with d as (select doc_id, source, text, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
w as (select *, [5, 2, 1][1 + (row_number() over (order by source is null, source) - 1) % 3] as weight from s),
f as (select a.*, (select sum(least(b.weight * (3 * a.source_size) / a.weight, 3 * b.source_size)) from w b)
                  <= (select sum(source_size) from w) as is_full from w a),
l as (select cast((select sum(source_size) from f) - coalesce(sum(3 * source_size) filter (is_full), 0) as double)
             / cast(sum(weight) filter (not is_full) as double) as level from f),
t as (select source, source_size, case when is_full then cast(3 * source_size as double) else level * cast(weight as double) end as target
      from f cross join l),
p as (select d.doc_id, d.source, d.size, source_size, target, case when source_size = 0 then 0
                  else least(3 * 16777216, cast(floor(target / source_size * 16777216 + 0.5) as bigint)) end as parts,
             row_number() over (partition by d.source order by d.size,
                 cast('0x' || substr(md5('42:' || coalesce(cast(doc_id as varchar), '')), 1, 15) as bigint), doc_id) as k,
             cast('0x' || substr(md5('42:' || coalesce(d.source, '')), 1, 6) as bigint) as shift
      from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target, source, cast((k * parts + shift) // 16777216 - ((k - 1) * parts + shift) // 16777216 as bigint) as copies,
       cast(((k * parts + shift) // 16777216 - ((k - 1) * parts + shift) // 16777216) * size as bigint) as taken
from p
"""

SQL: dict[str, str] = {"op9_decontaminate": OP9_SQL, "op10_substring_dedup": OP10_SQL, "op11_fill_in_middle": OP11_SQL,
                       "op12_conversation_repair": OP12_SQL, "op13_mixing": OP13_SQL}
