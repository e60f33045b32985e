"""SQL for the operators that SQL can express; for tables of any size, but quadratic in places."""

WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
LINES = r"list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))"


def _count(chars: str) -> str:
    return f"length(regexp_replace(coalesce(text, ''), '[^{chars}]+', '', 'g'))"


QUALITY = rf"""with d as (select doc_id, {WORDS} as w, {LINES} as l, {_count('#*$%&|<>')} as n_symbols, {_count('!')} as shouts, length(regexp_replace(coalesce(text, ''), '\PL+', '', 'g')) as letters from documents),
g as (select doc_id, i, array_to_string(w[i:i+7], ' ') as k from (select doc_id, w, unnest(range(1, len(w) - 6)) as i from d where len(w) > 7) x),
c as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, k) as n from g) x where n > 1),
r as (select doc_id, sum(least(8, coalesce(after - i, 8))) as n from (select doc_id, i, lead(i) over (partition by doc_id order by i) as after from c) x group by doc_id),
f as (select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols,
  cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines, cast(coalesce(r.n, 0) as bigint) as n_repeat_words, len(l) as n_lines, len(list_distinct(w)) as n_distinct, shouts, letters from d left join r on r.doc_id = d.doc_id)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 20 or 100 * n_repeat_words > 30 * n_words) as base_failed,
  not (n_words < 20 or 10 * n_symbols > 2 * n_words or 10 * shouts > 3 * n_words or word_chars > 15 * n_words or word_chars < 2 * n_words or 10 * letters < 3 * word_chars
    or (n_words >= 50 and 20 * n_distinct < n_words) or (n_lines >= 4 and 2 * n_dup_lines > n_lines) or 100 * n_repeat_words > 30 * n_words) as kept from f"""

SUBSTRINGS = rf"""with d as (select doc_id, {WORDS} as w from documents),
g as (select doc_id, i, array_to_string(w[i:i+49], ' ') as k from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from d where len(w) > 49) x),
late as (select doc_id, i from (select doc_id, i, min(doc_id) over (partition by k) as first from g) x where first < doc_id),
gone as (select distinct doc_id, p from (select doc_id, unnest(range(i, i + 50)) as p from late) x),
every as (select doc_id, unnest(range(1, len(w) + 1)) as p, unnest(w) as x from d),
kept as (select e.doc_id, string_agg(e.x, ' ' order by e.p) as t from every e left join gone on gone.doc_id = e.doc_id and gone.p = e.p where gone.p is null group by e.doc_id),
n as (select doc_id, count(*) as n from gone group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n.n, 0) as bigint) as n_removed, sha256(coalesce(kept.t, '')) as kept_sha256 from d left join n on n.doc_id = d.doc_id left join kept on kept.doc_id = d.doc_id"""

JACCARD = rf"""with recursive d as (select doc_id, {WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as w from documents),
s as (select distinct doc_id, case when len(w) < 5 then array_to_string(w, ' ') else array_to_string(w[i:i+4], ' ') end as k from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from d where len(w) > 0) x),
n as (select doc_id, count(*) as n from s group by doc_id),
o as (select a.doc_id as a, b.doc_id as b, count(*) as o from s a join s b on a.k = b.k and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
e as (select a, b from o join n x on x.doc_id = a join n y on y.doc_id = b where 100 * o >= 80 * (x.n + y.n - o)),
links as (select a, b from e union select b, a from e),
reach as (select doc_id, doc_id as other from n union select r.doc_id, links.b from reach r join links on links.a = r.other),
c as (select doc_id, min(other) as component_id from reach group by doc_id),
q as (select doc_id, min(doc_id) over (partition by k) as class_id from (select doc_id, md5(string_agg(k, chr(10) order by k)) as k from s group by doc_id) x)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, coalesce(c.component_id, d.doc_id) as component_id, coalesce(q.class_id, d.doc_id) as class_id from d left join n on n.doc_id = d.doc_id left join c on c.doc_id = d.doc_id left join q on q.doc_id = d.doc_id"""
