"""SQL for the numbered queries that SQL can express. The others are tested against brute force or libraries."""

from __future__ import annotations

from brindle.llm.license_scan import GAP, PHRASE_WORDS, SHIFT, TEMPLATES, width

#: Exact similarity of sets of five-word windows, then connected components.
NEAR_DUPLICATES = r"""
with recursive w as (select doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws from documents where text is not null),
s as (select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
  else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) end) as g from w),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
e as (select x, y from p join n nx on nx.doc_id = x join n ny on ny.doc_id = y where c >= 0.8 * (nx.n + ny.n - c) - 1e-9
  union select min(doc_id) over (partition by text), doc_id from w),
b as (select x, y from e union select y, x from e),
r(doc_id, label) as (select doc_id, doc_id from documents union select b.y, r.label from r join b on b.x = r.doc_id)
select doc_id, min(label) as class_id from r group by doc_id
"""

_URL = r"regexp_replace(coalesce(url, ''), '[\x00-\x20\x7f]', '%20', 'g')"
ARCHIVES = rf"""
with p as (select page_id, encode(coalesce(html, '')) as body, {_URL} as url from pages),
h as (select page_id, octet_length(body) as payload_bytes, sha1(body) as hex, split_part(url, '#', 1) as u from p),
d as (select *, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  cast(((('0x' || substr(hex, 1 + 10 * (i // 8), 10))::bigint >> (5 * (7 - i % 8))) & 31) + 1 as integer), 1)), '') as payload_digest from h),
m as (select *, min(page_id) over (partition by payload_digest) as first_id, case when contains(u, '://') then substr(u, strpos(u, '://') + 3) else u end as rest from d),
k as (select *, split_part(rest, '/', 1) as host, case when contains(rest, '/') then substr(rest, strpos(rest, '/') + 1) else '' end as path from m),
q as (select *, split_part(regexp_replace(lower(host), '^www\.', ''), ':', 1) as name from k)
select page_id, payload_bytes, payload_digest, case when page_id = first_id then 'response' else 'revisit' end as record_type,
 case when page_id <> first_id then first_id end as refers_to,
 case when host = '' and not contains(rest, '/') then '' else array_to_string(list_reverse(string_split(name, '.')), ',') || ')/' || path end as urlkey,
 strftime(make_timestamp((1704067200 + page_id) * 1000000), '%Y%m%d%H%M%S') as capture_ts from q
"""

#: Lines, passages as islands of one level, links by hash, reply trees by recursion.
_MARKS = r"^[ \t]*(?:>[ \t]*)+"
QUOTATIONS = rf"""
with recursive k as (select conv_id, turn, role, coalesce('c' || conv_id, 'n') as c, md5(coalesce(text, '')) as id, row_number() over () as m,
  string_split(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), chr(10)) as raw from conversations),
l as (select c, turn, id, m, unnest(raw) as line, generate_subscripts(raw, 1) as i from k),
v as (select *, length(regexp_replace(regexp_extract(line, '{_MARKS}'), '[^>]', '', 'g')) as level, regexp_replace(line, '{_MARKS}', '') as t from l),
g as (select *, sum(fresh) over (partition by m order by i) as run from (select *, coalesce((level <> lag(level) over (partition by m order by i))::int, 0) as fresh from v)),
x as (select *, lower(trim(regexp_replace(t, '\s+', ' ', 'g'))) as n,
  level = 0 and not (coalesce(lead(level) over (partition by m order by i), 0) > 0 and regexp_matches(t, '(?i)\b(?:wrote|writes|said|schrieb|a écrit|escribió)\b.*:[ \t]*$')) as own from g),
body as (select m, trim(coalesce(string_agg(t, chr(10) order by i) filter (where own), '')) as body from x group by m),
para as (select *, sum((n = '')::int) over (partition by m, run order by i) as paragraph from x where level > 0 or own),
w as (select c, turn, id, m, run, level, string_agg(n, ' ' order by i) as v from para where n <> '' group by all),
pg as (select distinct c, turn, id, m, run, level, v from (select c, turn, id, m, run, level, paragraph, string_agg(n, ' ' order by i) as v from para where n <> '' group by all) p
  where not exists (select 1 from para l where l.m = p.m and l.run = p.run and l.n = p.v) and not exists (select 1 from w where w.m = p.m and w.run = p.run and w.v = p.v)),
keys as (select *, true as whole, true as long from w union all select c, turn, id, m, run, level, n, false, length(n) >= 16 from para where n <> ''
  union all select *, false, length(v) >= 16 from pg),
said as (select c, v, min(turn) as first from keys where level = 0 and turn is not null group by c, v),
quoted as (select distinct c, turn, id, run, level from x where level > 0),
votes as (select q.c, q.turn, q.id, q.run, q.level, s.first, bool_or(whole) as whole, count(*) filter (where long) as longer, count(*) as hits from keys q join said s on s.c = q.c and s.v = q.v and s.first < q.turn where q.level > 0 group by all),
best as (select c, turn, id, run, level, first as original from (select *, row_number() over (partition by c, turn, id, run, level order by whole desc, longer desc, hits desc, first desc) as r from votes) where r = 1),
links as (select q.*, b.original from quoted q left join best b using (c, turn, id, run, level) where q.turn is not null),
per as (select c, turn, id, count(*) as n_quotes, count(original) as n_linked, max(level) as quote_depth, arg_min(original, level * 1000000 + run) filter (where original is not null) as parent_turn from links group by all),
par as (select c, turn, min(parent_turn) as parent from per where parent_turn is not null group by all),
ch(c, turn, root, depth) as (select c, turn, parent, 1 from par union all select ch.c, ch.turn, p.parent, ch.depth + 1 from ch join par p on p.c = ch.c and p.turn = ch.root),
ends as (select c, turn, arg_max(root, depth) as root, max(depth) as depth from ch group by all),
o as (select k.*, body, coalesce(n_quotes, 0) as n_quotes, coalesce(n_linked, 0) as n_linked, cast(coalesce(quote_depth, 0) as integer) as quote_depth, parent_turn,
  coalesce(root, k.turn) as root_turn, cast(coalesce(depth, 0) as integer) as reply_depth
  from k join body using (m) left join per on per.c = k.c and per.turn = k.turn and per.id = k.id left join ends on ends.c = k.c and ends.turn = k.turn)
select conv_id, turn, role, length(body) as body_chars, md5(body) as body_md5, n_quotes, n_linked, quote_depth, parent_turn, root_turn, reply_depth,
 dense_rank() over (partition by c order by root_turn nulls last, reply_depth, turn nulls last, id) - 1 as position from o
"""

#: The base numbers by windows over words, the line rules by regular expressions without lookaround.
_W = r"[^\x20\x09-\x0D]+"
QUALITY = rf"""
with d as (select row_number() over () as m, doc_id, coalesce(text, '') as text from documents),
b as (select *, regexp_extract_all(text, '{_W}') as ws from d),
l as (select m, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from d),
n as (select *, len(regexp_extract_all(line, '{_W}')) as nw from l),
f as (select *, row_number() over (partition by m, line order by i) as nth, length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) as chars,
  len(list_filter(string_split_regex(line, '[ \t]'), lambda x: x in ('|', '»', '›', '>', '·', '•'))) >= greatest(2, 0.25 * nw)
  or (nw >= 3 and len(regexp_extract_all(line, '[!?*#%&]{{2,}}')) > 0.3 * nw)
  or (nw <= 4 and not regexp_matches(line, '[.!?…"''”’»)\]:;。！？]\s*$'))
  or (nw >= 30 and not regexp_matches(line, '[.!?…,;:。！？，；：、]'))
  or (nw <= 8 and regexp_matches(line, '(?i)(^|[^\p{{L}}\p{{N}}_])(accept (?:all )?cookies|click here|subscribe to our|sign up|log in|read more|cookies akzeptieren|hier klicken|newsletter abonnieren|jetzt registrieren|einloggen|mehr lesen|accepter les cookies|cliquez ici|abonnez-vous|se connecter|lire la suite|aceptar (?:las )?cookies|haga clic aquí|suscríbase|iniciar sesión|leer más)($|[^\p{{L}}\p{{N}}_])'))
  or (nw <= 25 and regexp_matches(line, '(?i)(^|[^\p{{L}}\p{{N}}_])(all rights reserved|terms of (?:use|service)|privacy policy|cookie policy|enable javascript|lorem ipsum|powered by|alle rechte vorbehalten|nutzungsbedingungen|datenschutzerklärung|impressum|javascript aktivieren|tous droits réservés|conditions d[''’]utilisation|politique de confidentialité|mentions légales|activer javascript|todos los derechos reservados|términos (?:de uso|del servicio)|política de privacidad|aviso legal|activar javascript)($|[^\p{{L}}\p{{N}}_])')) as fails
  from n where nw > 0),
s as (select m, count(*) filter (where nth > 1) as n_dup_lines, coalesce(sum(chars) filter (where nth = 1 and not fails), 0) as chars_left from f group by m),
w as (select m, unnest(ws) as a, generate_subscripts(ws, 1) as i from b),
t as (select m, i, a || ' ' || lead(a) over (partition by m order by i) || ' ' || lead(a, 2) over (partition by m order by i) as g from w),
r as (select m, i from (select *, count(*) over (partition by m, g) as c from t where g is not null) where c > 1),
p as (select m, count(distinct i + k) as n_repeat_words from r, (values (0), (1), (2)) as o(k) group by m),
a as (select doc_id, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols,
  coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(chars_left, 0) as chars_left from b left join s using (m) left join p using (m))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
 not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and chars_left >= 0.5 * word_chars as kept from a
"""

#: Words by place, meetings of word runs with template positions, diagonals merged by windows, coverage counted from words.
_TEMPLATES = ", ".join(f"({i}, '{t.label}', {str(t.base).lower()}, {width(t)}, {1.0 if len(t.words) <= PHRASE_WORDS else t.share}::double, {len(t.words) <= PHRASE_WORDS}, {t.words!r})" for i, t in enumerate(TEMPLATES))
LICENSES = rf"""
with t(t, label, base, k, share, exact, ws) as (values {_TEMPLATES}),
tp as (select t, k, p - 1 as tat, ws[p:p + k - 1] as run from (select *, unnest(range(1, len(ws) - k + 2)) as p from t)),
d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
w as (select r, unnest(ws) as w, generate_subscripts(ws, 1) - 1 as pos from d),
x as (select *, lead(w, 1) over o as w1, lead(w, 2) over o as w2, lead(w, 3) over o as w3, lead(w, 4) over o as w4 from w window o as (partition by r order by pos)),
h as (select r, t, tat, k, pos, pos - tat as diag from x join tp on k = 2 and w = run[1] and w1 = run[2]
 union all select r, t, tat, k, pos, pos - tat from x join tp on k = 5 and w = run[1] and w1 = run[2] and w2 = run[3] and w3 = run[4] and w4 = run[5]),
v as (select r, t, diag, min(pos) as first, max(pos) as last from h group by all),
n as (select *, case when not exact and first - max(last) over (partition by r, t order by first, diag rows between unbounded preceding and 1 preceding) <= {GAP}
  and abs(diag - lag(diag) over (partition by r, t order by first, diag)) <= {SHIFT} then 0 else 1 end as fresh from v join t using (t)),
g as (select *, sum(fresh) over (partition by r, t order by first, diag rows unbounded preceding) as place from n),
m as (select distinct g.r, g.t, g.place, unnest(range(h.tat, h.tat + h.k)) as word from g join h on h.r = g.r and h.t = g.t and h.diag = g.diag),
c as (select r, t, place, count(*) as cover from m group by all),
s as (select r, t, label, base, min(first) as first, max(last) - min(first) + any_value(k) as n, any_value(cover) as cover, any_value(len(ws)) as whole, any_value(share) as share
  from g join c using (r, t, place) group by r, t, place, label, base),
f as (select r, count(*) filter (where base) as n_base, min(first) filter (where base) as first_word, max(first) filter (where base) as last_word,
  string_agg(distinct label, ',' order by label) filter (where base) as base_labels, string_agg(distinct label, ',' order by label) as labels, max(cover / whole::double) as score
  from s where cover >= share * whole and cover >= share * n group by r)
select doc_id, len(ws)::bigint as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0.0::double) as score
from d left join f using (r)
"""

#: All 120 orders one filter after the other; Shapley sums by adding up what is removed.
FILTER_AUDIT = r"""
with recursive d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
l as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id),
m as (select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic, {'A': len(ws) < 200, 'B': 100 * len(list_distinct(ws)) < 50 * len(ws), 'C': 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 2 * length(text),
  'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(d.doc_id > min(d.doc_id) over (partition by text), false)} as f from d left join l on l.doc_id = d.doc_id),
c as (select part, map_from_entries([('A', f['A']), ('B', f['B']), ('C', f['C']), ('D', f['D']), ('E', f['E'])]) as f, count(*) as n, sum(good) as good, sum(toxic) as toxic from m group by all),
o(o) as (select '' union all select o || x from o, unnest(['A', 'B', 'C', 'D', 'E']) as u(x) where not contains(o, x)),
s as (select o as filter_order, i::integer as step, substr(o, i, 1) as own, string_split(substr(o, 1, i - 1), '') as before from o, range(1, 6) as r(i) where length(o) = 5),
x as (select part, filter_order, step, own, n, good, toxic, f[own] as fails, len(list_filter(before, lambda b: b <> '' and f[b])) > 0 as gone,
  len(list_filter(['A', 'B', 'C', 'D', 'E'], lambda b: f[b])) = 1 as once from c, s),
p as (select part, filter_order, step, own, sum(case when not gone and not fails then n else 0 end)::bigint as kept, sum(case when not gone and fails then n else 0 end)::bigint as removed,
  sum(case when gone and fails then n else 0 end)::bigint as redundant, sum(case when fails and once then n else 0 end)::bigint as unique_fails,
  sum(case when not gone and fails then good else 0 end)::bigint as good_lost, sum(case when not gone and fails then toxic else 0 end)::bigint as toxic_lost from x group by part, filter_order, step, own)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, own))::bigint as shapley from p
"""
