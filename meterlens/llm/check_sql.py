"""Check SQL of the training-data queries that SQL can express, for DuckDB."""

# Words of a text with A to Z in lower case; the pattern of a word is filled in.
WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '%s')"

SHARD_SQL = """
with recursive bytes as (
    select row_number() over () as r, doc_id, coalesce(doc_id, 0) as key,
           octet_length(encode(coalesce(text, ''))) + 16 as size,
           regexp_extract_all(hex(encode(coalesce(text, ''))), '..') as h
    from documents
), crc_table as (
    select list(c order by i) as t from (
        select i, list_reduce(range(8), lambda c, k: case when c & 1 = 1
            then xor(c // 2, 3988292384::bigint) else c // 2 end, i::bigint) as c
        from range(256) x(i))
), checked as (
    select b.r, b.doc_id, b.key, b.size, xor(4294967295::bigint, list_reduce(
        list_transform(h, lambda x: ('0x' || x)::bigint),
        lambda c, x: xor(c // 256, t[xor(c & 255, x) + 1]), 4294967295::bigint)) as text_crc32
    from bytes b, crc_table
), jumps as (
    select r, n, case when key < 0 then key::hugeint + 18446744073709551616 else key::hugeint end as s,
           -1::bigint as b, 0::bigint as j
    from checked, (select unnest([40, 41]) as n)
    union all
    select r, n, (s * 2862933555777941757 + 1) % 18446744073709551616, j,
           floor((j + 1) * (2147483648::double / (((s * 2862933555777941757 + 1)
               % 18446744073709551616) // 8589934592 + 1)::double))::bigint
    from jumps where j < n
), ended as (
    select r, max(b) filter (where n = 40) as shard, max(b) filter (where n = 41) as grown
    from jumps where j >= n group by r
)
select doc_id, size::bigint as size, text_crc32::bigint as text_crc32, 'key' as law, shard::integer as shard,
       row_number() over (partition by shard order by key, doc_id, size, text_crc32) - 1 as slot,
       grown::integer as grown_shard
from checked join ended using (r)"""

SEARCH_SQL = """
with q as (
    select vec_id, row_number() over () as r,
           list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
    from embeddings where len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
    select a.vec_id as query_id, a.r, b.vec_id,
           list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::bigint as score
    from q a join q b on a.r <> b.r and len(a.v) = len(b.v) where a.vec_id % 50 = 0
)
select query_id, cast(n as integer) as rank, vec_id, score from (
    select *, row_number() over (partition by r order by score desc, vec_id) as n from scored
) where n <= 5"""

LEAK_SQL = f"""
with d as (
    select row_number() over () as r, doc_id, coalesce({WORDS % r'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'}, []) as w
    from documents
), i as (
    select item_id, {WORDS % r'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'} as w from benchmark
), windows as (
    select distinct item_id, list_slice(w, p, p + 9) as phrase
    from (select *, unnest(range(1, greatest(len(w) - 8, 2))) as p from i where len(w) > 0)
), sizes as (select distinct len(phrase) as n from windows),
places as (
    select r, p, list_slice(w, p, p + n - 1) as phrase, n
    from (select *, unnest(range(1, len(w) - n + 2)) as p from d, sizes where len(w) >= n)
), found as (
    select r, p, n, item_id from places join windows using (phrase)
), hit as (
    select r, count(distinct k) as n_hit from (select r, unnest(range(p, p + n)) as k
        from (select distinct r, p, n from found)) group by r
), items as (
    select r, count(distinct item_id) as n_items,
           string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as names
    from found group by r
)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit,
       coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(names, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (r) left join items using (r)"""

DEDUP_SQL = f"""
with recursive d as (
    select doc_id, {WORDS % r'[^\x20\x09-\x0D]+'} as w from documents
), s as (
    select distinct doc_id, list_slice(w, p, p + 3) as shingle
    from (select *, unnest(range(1, greatest(len(w) - 2, 2))) as p from d where len(w) > 0)
), n as (select doc_id, count(*) as n from s group by 1),
common as (
    select a.doc_id as a, b.doc_id as b, count(*) as c
    from s a join s b on a.shingle = b.shingle and a.doc_id < b.doc_id group by 1, 2
), link as (
    select a, b from common join n x on a = x.doc_id join n y on b = y.doc_id
    where 100 * c >= 80 * (x.n + y.n - c)
), both_ways as (select a, b from link union all select b, a from link),
reach as (
    select doc_id as a, doc_id as b from d
    union select r.a, l.b from reach r join both_ways l on r.b = l.a
)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, min(b) as component_id, d.doc_id = min(b) as kept
from d join reach on d.doc_id = a left join n on n.doc_id = d.doc_id group by 1, 2"""

PLAIN_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

HOST_SQL = rf"""
with d as (
    select row_number() over () as r, doc_id, source, coalesce(text, '') as t, {PLAIN_WORDS} as w
    from documents
), windows as (
    select r, p, list_slice(w, p, p + 7) as phrase
    from (select r, w, unnest(range(1, len(w) - 6)) as p from d where len(w) >= 8)
), again as (
    select r, p from (select r, p, count(*) over (partition by r, phrase) as c from windows) where c > 1
), repeated as (
    select r, count(distinct k) as c from (select r, unnest(range(p, p + 8)) as k from again) group by r
), lines as (
    select r, count(*) as n, count(*) - count(distinct line) as dup
    from (select r, unnest(string_split(t, chr(10))) as line from d)
    where regexp_matches(line, '[^\x20\x09-\x0D]') group by r
), m as (
    select d.r, doc_id, source, len(w)::bigint as n_words,
           coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
           len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint as n_symbols,
           coalesce(n, 0)::bigint as n_lines, coalesce(dup, 0)::bigint as n_dup_lines,
           coalesce(c, 0)::bigint as n_repeat_words
    from d left join repeated using (r) left join lines using (r)
), f as (
    select *, n_words < 20 as short, 100 * n_repeat_words > 30 * n_words as repeats,
           100 * n_symbols > 10 * n_words as symbols, 100 * n_dup_lines > 30 * n_lines as lines
    from m
), flags as (
    select r, source, unnest([short, repeats, symbols, lines, short or repeats or symbols or lines]) as bad,
           unnest([1, 2, 3, 4, 5]) as rule
    from f where source is not null
), hosts as (
    select source, rule, count(*)::double as n, (count(*) filter (bad))::double as b
    from flags group by 1, 2
), sums as (
    select rule, count(*) as h, sum(n) as n, sum(b) / sum(n) as mean, sum(n * n) as nn, sum(b * b / n) as bb
    from hosts group by rule
), prior as (
    select rule, mean, case when mean <= 0 or mean >= 1 or n - nn / n - (h - 1) <= 1e-9 * n then 0
        else ((bb - mean * mean * n) / (mean * (1 - mean)) - (h - 1)) / (n - nn / n - (h - 1)) end as share
    from sums
), rates as (
    select source, case when share <= 1e-12 then mean
        else (b + (1 / least(share, 0.999) - 1) * mean) / (n + 1 / least(share, 0.999) - 1) end as rate
    from hosts join prior using (rule)
), verdicts as (select source, max(rate) > 0.5 as rejected from rates group by 1)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       short or repeats as base_failed, coalesce(rejected, false) as rejected,
       not (short or repeats or symbols or lines or coalesce(rejected, false)) as kept
from f left join verdicts using (source)"""

AUDIT_SQL = rf"""
with d as (
    select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, {PLAIN_WORDS} as w
    from documents
), bits as (
    select doc_id, part, (len(w) < 200)::integer + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::integer
        + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t))::integer
        + 8 * regexp_matches(t, '[#$%&*|]')::integer
        + 16 * coalesce(doc_id > min(doc_id) over (partition by t), false)::integer as bits
    from d
), known as (
    select doc_id, max((quality = 1)::integer) as good, max((toxic = 1)::integer) as toxic
    from labels where doc_id is not null group by 1
), counted as (
    select part, bits, count(*) as n, count(*) filter (good = 1) as good, count(*) filter (toxic = 1) as toxic
    from bits left join known using (doc_id) group by 1, 2
), f as (select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) f(l, m)),
orders as (
    select a.l || b.l || c.l || d.l || e.l as filter_order, [a.m, b.m, c.m, d.m, e.m] as masks
    from f a join f b on b.l <> a.l join f c on c.l not in (a.l, b.l)
        join f d on d.l not in (a.l, b.l, c.l) join f e on e.l not in (a.l, b.l, c.l, d.l)
), steps as (
    select filter_order, step, masks[step] as own,
           coalesce(list_sum(list_slice(masks, 1, step - 1)), 0)::integer as before
    from (select *, unnest(range(1, 6)) as step from orders)
), each as (
    select part, filter_order, step, own,
        sum(case when bits & (before | own) = 0 then n else 0 end)::bigint as kept,
        sum(case when bits & before = 0 and bits & own > 0 then n else 0 end)::bigint as removed,
        sum(case when bits & before > 0 and bits & own > 0 then n else 0 end)::bigint as redundant,
        sum(case when bits = own then n else 0 end)::bigint as unique_fails,
        sum(case when bits & before = 0 and bits & own > 0 then good else 0 end)::bigint as good_lost,
        sum(case when bits & before = 0 and bits & own > 0 then toxic else 0 end)::bigint as toxic_lost
    from counted, steps group by 1, 2, 3, 4
)
select part, filter_order, step::integer as step, kept, removed, redundant, unique_fails, good_lost,
       toxic_lost, (sum(removed) over (partition by part, own))::bigint as shapley
from each"""
