"""DuckDB SQL with the rows of those queries that SQL can express, over the whole tables."""

from __future__ import annotations

from terrafringe.llm.quality import COMMON_WORDS, LIMITS, SIGNS, SYMBOLS
from terrafringe.llm.url_filter import RULES

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _class(chars: str) -> str:
    """A regular expression for one of `chars`, in quotes."""
    return _quoted("[" + "".join(f"\\x{ord(c):02X}" for c in chars) + "]")


#: `pairs` (a, b) to `reach` (a, b): every node and what links reach from it, itself included if it has a link.
_REACH = """
  both_ways as (select a, b from pairs union select b, a from pairs),
  reach(a, b) as (select a, b from both_ways union select r.a, w.b from reach r join both_ways w on w.a = r.b),
  least as (select a, min(b) as b from reach group by a)
"""

OP3 = f"""
with recursive
  own as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings),
  usable as (
    select vec_id, v from own
    where v is not null and len(v) > 0 and len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(v, lambda x: x <> 0)) > 0),
  pairs as (
    select p.vec_id as a, q.vec_id as b from usable p join usable q on p.vec_id < q.vec_id
    where case when len(p.v) = len(q.v) then list_cosine_similarity(p.v, q.v) >= 0.95 else false end),
  {_REACH},
  linked as (select a, count(*) as n from both_ways group by a)
select vec_id, coalesce(n, 0)::bigint as n_links, least(vec_id, coalesce(l.b, vec_id)) as component_id, vec_id = least(vec_id, coalesce(l.b, vec_id)) as kept
from own left join linked k on k.a = vec_id left join least l on l.a = vec_id
"""

OP4 = rf"""
with recursive
  own as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
  sets as (
    select doc_id, list_distinct(case when len(w) = 0 then []::varchar[] when len(w) < 5 then [array_to_string(w, ' ')]
      else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) end) as s from own),
  items as (select doc_id, unnest(s) as x from sets),
  shared as (select p.doc_id as a, q.doc_id as b, count(*) as n from items p join items q on p.x = q.x and p.doc_id < q.doc_id group by all),
  pairs as (select a, b from shared join sets s on s.doc_id = a join sets t on t.doc_id = b where 100 * n >= 80 * (len(s.s) + len(t.s) - n)),
  {_REACH}
select doc_id, len(s)::bigint as n_shingles, least(doc_id, coalesce(l.b, doc_id)) as component_id from sets left join least l on l.a = doc_id
"""

_LISTED = sorted({w for words in COMMON_WORDS.values() for w in words})

OP6 = rf"""
with
  own as (select row_number() over () as r, doc_id, lang, coalesce(text, '') as text, {_WORDS} as w from documents),
  counted as (
    select *, len(w) as n_words, len(array_to_string(w, '')) as word_chars, len(text) as chars,
      len(text) - len(regexp_replace(text, {_class(SYMBOLS)}, '', 'g')) as n_symbols,
      len(text) - len(regexp_replace(text, {_class(SIGNS)}, '', 'g')) as signs,
      len(text) - len(regexp_replace(text, '[0-9]', '', 'g')) as digits,
      len(text) - len(regexp_replace(text, '\p{{Lu}}', '', 'g')) as capitals,
      list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
    from own),
  windows as (select r, unnest(range(1, n_words - 3)) as i, unnest(list_transform(range(1, n_words - 3), lambda i: array_to_string(w[i : i + 4], ' '))) as x from counted where n_words >= 5),
  twice as (select r, i from windows qualify count(*) over (partition by r, x) > 1),
  repeated as (select r, count(distinct i + k) as n from twice, range(5) t(k) group by r),
  histograms as (
    select r, 'char' as kind, unnest([word_chars - capitals - digits - signs - n_symbols, capitals, digits, signs, n_symbols, chars - word_chars])::double as x, unnest(range(6)) as k from counted
    union all
    select r, 'word', c, k from (
      select r, unnest(list_append(cs, n_words - list_sum(cs)))::double as c, unnest(range({len(_LISTED) + 1})) as k
      from (select r, n_words, list_transform([{", ".join(map(_quoted, _LISTED))}], lambda y: len(list_filter(w, lambda z: lower(z) = y))) as cs from counted))),
  languages as (
    select lang, kind, k, sum(x) as x from histograms join counted using (r)
    where lang in ({", ".join(map(_quoted, COMMON_WORDS))}) and n_words >= {LIMITS["min_words_judged"]} group by all),
  refs as (select lang, kind, k, x / sum(x) over (partition by lang, kind) as q from languages),
  shares as (select r, kind, k, x / sum(x) over (partition by r, kind) as p from histograms qualify sum(x) over (partition by r, kind) > 0),
  apart as (
    select r, kind, lang, sqrt(greatest(0, sum(
      (case when p > 0 then p * log2(p / ((p + q) / 2)) else 0 end + case when q > 0 then q * log2(q / ((p + q) / 2)) else 0 end) / 2))) as d
    from shares join refs using (kind, k) group by all),
  nearest as (select r, min(d) filter (kind = 'char') as char_distance, min(d) filter (kind = 'word') as word_distance from apart group by r),
  judged as (
    select doc_id, n_words, word_chars, n_symbols, len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(n, 0) as n_repeat_words, char_distance, word_distance
    from counted left join repeated using (r) left join nearest using (r))
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words,
  n_words < {LIMITS["min_words"]} or 100 * n_repeat_words > {LIMITS["max_repeat_percent"]} * n_words as base_failed, char_distance, word_distance,
  not (n_words < {LIMITS["min_words"]} or 100 * n_repeat_words > {LIMITS["max_repeat_percent"]} * n_words
    or (word_chars >= {LIMITS["min_chars_judged"]} and coalesce(char_distance, 0) > {LIMITS["max_char_distance"]})
    or (n_words >= {LIMITS["min_words_judged"]} and coalesce(word_distance, 0) > {LIMITS["max_word_distance"]})) as kept
from judged
"""

_HOST, _PATH = "'://([^/?#]*)'", "'://[^/?#]*([^?#]*)'"
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP7 = rf"""
with recursive
  rules(kind, h, p) as (values {", ".join("(" + ", ".join(map(_quoted, r)) + ")" for r in RULES)}),
  own as (
    select row_number() over () as r, page_id, coalesce(html, '') as html,
      translate(regexp_extract(coalesce(url, ''), {_HOST}, 1), {_LOWER}) as host, regexp_extract(coalesce(url, ''), {_PATH}, 1) as path
    from pages),
  ruled as (
    select r, h || p as rule, kind from own join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p)
    qualify row_number() over (partition by r order by len(h || p) desc, h || p) = 1),
  judged as (select own.*, rule, kind from own left join ruled using (r)),
  hosts as (select host, avg((coalesce(kind, '') = 'allow')::int::double) as good, avg((coalesce(kind, '') = 'block')::int::double) as bad from judged group by host),
  hrefs as (select host as src, unnest(regexp_extract_all(html, '(?i)\bhref\s*=\s*["'']?\s*((?:https?:)?//[^\s"''<>]*)', 1)) as url from own),
  ends as (select src, translate(regexp_extract(case when starts_with(url, '//') then 'http:' || url else url end, {_HOST}, 1), {_LOWER}) as dst from hrefs),
  links as (select src, dst, count(*) as n from ends where src <> dst and src <> '' and dst <> '' group by all),
  everyone as (select host from hosts union select dst from links),
  seeds as (select 'trust' as kind, host, coalesce(good, 0) as seed from everyone left join hosts using (host) union all select 'distrust', host, coalesce(bad, 0) from everyone left join hosts using (host)),
  edges as (
    select 'trust' as kind, src as a, dst as b, n / sum(n) over (partition by src) as w from links
    union all select 'distrust', dst, src, n / sum(n) over (partition by dst) from links
    union all select kind, host, host, 0 from seeds),
  scores(kind, host, k, s) as (
    select kind, host, 0, 0.15::double * seed from seeds
    union all
    select e.kind, e.b, any_value(s.k) + 1, 0.15::double * any_value(d.seed) + 0.85::double * sum(e.w * s.s)
    from scores s join edges e on e.kind = s.kind and e.a = s.host join seeds d on d.kind = e.kind and d.host = e.b
    where s.k < 100 group by e.kind, e.b),
  settled as (select host, max(s) filter (kind = 'trust') as trust, max(s) filter (kind = 'distrust') as distrust from scores where k = 100 group by host)
select page_id, host, path, rule, coalesce(kind, case when distrust > trust and distrust >= 0.15 * 0.5 then 'block' else 'allow' end) as verdict, trust, distrust
from judged left join settled using (host)
"""

OP9 = """
with
  own as (select row_number() over (order by doc_id) as r, doc_id, hex(encode(coalesce(text, ''))) as x, strlen(coalesce(text, '')) as n from documents),
  pieces as (select r, n, c, substr(x, 2 * c + 1, 2 * 611) as part from (select r, x, n, unnest(range(0, n - 99, 512)) as c from own where n >= 100)),
  starts as (select r, c, part, unnest(range(0, least(512, n - 99 - c))) as i from pieces),
  again as (select r, i from (select r, c + i as i, row_number() over (partition by substr(part, 2 * i + 1, 200) order by r, c + i) as k from starts) where k > 1),
  begun as (select r, i, i > coalesce(lag(i) over (partition by r order by i) + 100, -1) as fresh from again),
  spans as (select r, min(i) as a, max(i) + 100 as b from (select r, i, sum(fresh::int) over (partition by r order by i) as g from begun) group by r, g),
  gaps as (
    select r, b as a, lead(a) over (partition by r order by a, b) as b from (select r, a, b from spans union all select r, 0, 0 from own)),
  rest as (select r, unhex(coalesce(string_agg(substr(x, 2 * a + 1, 2 * greatest(coalesce(b, n) - a, 0)), '' order by a), '')) as left_over from gaps join own using (r) group by r),
  removed as (select r, sum(b - a) as n_removed, count(*) as n_spans from spans group by r)
select doc_id, n::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(left_over) as kept_sha256
from own left join removed using (r) left join rest using (r)
"""

ORACLE_SQL: dict[str, str] = {"op3_vector_join": OP3, "op4_ngram_join": OP4, "op6_quality": OP6, "op7_url_filter": OP7, "op9_suffix_dedup": OP9}
