"""The queries' results written independently in DuckDB's SQL."""

from __future__ import annotations

from corpusmill.functions.text import C_KEYWORDS, CODE_PATH_MARKERS, GENERAL_KEYWORDS, NOT_W, SPACE_BODY, W, source_hash
from corpusmill.operators.dedup import PERMUTATIONS, PRIME, permutation
from corpusmill.operators.mixing import CATEGORY_HINTS, CATEGORY_PATTERNS
from corpusmill.operators.quality import C_DIRECTIVES
from corpusmill.sources.readers import HEADER_MARKERS, HEADER_MARKERS_SHORT, ITALIAN_MARKERS

SOURCES = ["italian_oscar", "italian_wiki", "italian_fineweb", "english_web", "english_wiki", "english_edu", "c_code", "cpp_code", "other_code"]


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def any_of(c: str, needles: list[str]) -> str:
    return "(" + " or ".join(f"contains({c}, {q(n)})" for n in needles) + ")"


def words(c: str) -> str:
    return f"list_filter(string_split_regex({c}, '{W}+'), lambda x: x <> '')"


def strip(c: str) -> str:
    return rf"regexp_replace({c}, '\A{W}+|{W}+\z', '', 'g')"


def clean(c: str) -> str:
    return strip(f"regexp_replace(regexp_replace(regexp_replace({c}, 'https?://{NOT_W}+', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '[ \\t]+', ' ', 'g')")


def clean_code(c: str) -> str:
    return strip(f"regexp_replace(regexp_replace({c}, 'https?://{NOT_W}+', '', 'g'), '\\n{{4,}}', chr(10) || chr(10) || chr(10), 'g')")


SOLID = "length(replace(replace(text, ' ', ''), chr(10), ''))"
IS_CODE = rf"coalesce(length(text) >= 20 and {SOLID} > 0 and (length(regexp_replace(text, '[^{{}}();=<>\[\]+\-*/&|!#]', '', 'g')) / greatest({SOLID}, 1)::double > 0.15 or {any_of('substring(text, 1, 500)', C_KEYWORDS + GENERAL_KEYWORDS)}), false)"
IS_CODE_PATH = f"coalesce({any_of('lower(source)', CODE_PATH_MARKERS)}, false)"
MARK = rf"'\A(?:[-*•▪▸►→]|\p{{Nd}}+[.)]){W}'"
TRIGRAMS = "list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])"
MOST = "coalesce(list_max(map_values(list_aggregate(g, 'histogram'))), 0)"
SENTENCES = f"list_filter(string_split_regex(t, '[.!?]+'), lambda s: regexp_matches(s, '{NOT_W}'))"
LINES = f"list_filter(list_transform(string_split(t, chr(10)), lambda s: {strip('s')}), lambda s: s <> '')"
LIVE = f"list_filter(list_transform(string_split(t, chr(10)), lambda s: {strip('s')}), lambda s: s not in ('', '{{', '}}', '*/'))"
COMMENT = r"regexp_matches(s, '^(?:/\*|\* |\*/|//|#)')"
DIRECTIVE = "regexp_matches(s, '^(?:" + "|".join(C_DIRECTIVES) + ")')"
COMMENT_C = rf"(regexp_matches(s, '^(?:/\*|\* |\*/|//)') or (starts_with(s, '#') and not {DIRECTIVE}))"

FEATURES = f"""
f0 as (select doc_id, source, {IS_CODE} or {IS_CODE_PATH} as is_code, coalesce(text, '') as text from documents),
f1 as (select doc_id, source, is_code, case when is_code then {clean_code("text")} else {clean("text")} end as t from f0),
f2 as (select *, {words("t")} as w from f1),
f3 as (select *, {TRIGRAMS} as g, {SENTENCES} as ss, string_split(t, chr(10)) as ll, {LINES} as fl, {LIVE} as live from f2),
f4 as (select *, len(w) as n, len(list_filter(ss, lambda s: len({words("s")}) < 6)) as short, len(list_filter(fl, lambda s: regexp_matches(s, {MARK}))) as items,
  len(list_filter(live, lambda s: {COMMENT})) as comments, length(regexp_replace(t, '{W}', '', 'g')) as solid, length(regexp_replace(t, '{W}|[^\\x{{0}}-\\x{{24f}}]', '', 'g')) as latin from f3),
reasoned as (select doc_id, source, is_code, t, case
  when t = '' then 'empty'
  when length(t) < (case when is_code then 50 else 200 end) then 'too_short'
  when not is_code and (n < 20 or len(list_distinct(w)) < least(50, greatest(10, n // 3))) then 'low_vocab'
  when coalesce(list_max(list_transform(w, lambda x: length(x))), 0) > (case when is_code then 80 else 50 end) then 'long_words'
  when n >= 10 and {MOST} / greatest(len(g), 1)::double > (case when is_code then 0.6 else 0.3 end)::double then 'repetitive'
  when not is_code and (solid = 0 or latin / greatest(solid, 1)::double < 0.65::double) then 'non_latin'
  when not is_code and len(ss) >= 3 and short / greatest(len(ss), 1)::double >= 0.8::double then 'short_sentences'
  when not is_code and len(ll) >= 5 and len(fl) > 0 and items / greatest(len(fl), 1)::double >= 0.7::double then 'list_heavy'
  when is_code and len(live) - comments = 0 then 'no_code_content'
  when is_code and comments / greatest(len(live), 1)::double > 0.8::double then 'mostly_comments'
  else 'ok' end as reason from f4),
kept as (select doc_id, source, is_code, nfc_normalize(t) as normalised, md5(nfc_normalize(t)) as digest from reasoned where reason = 'ok')
"""
MATCHING = words("lower(nfc_normalize(text))")
NGRAMS13 = "list_transform(range(1, greatest(len(w) - 11, 1)), lambda i: array_to_string(w[i:i+12], ' '))"
SHINGLES = f"""
s0 as (select doc_id, source, is_code, {words("lower(nfc_normalize(normalised))")} as w from kept),
s1 as (select doc_id, source, is_code, list_distinct(case when len(w) between 1 and 2 then w else {TRIGRAMS} end) as g from s0),
s2 as (select doc_id, source, is_code, list_distinct(list_transform(g, lambda s: ('0x' || substring(md5(s), 1, 8))::bigint % {PRIME})) as h from s1),
signed as (select doc_id, source, is_code, [{", ".join(f"coalesce(list_min(list_transform(h, lambda x: (x * {a} + {b}) % {PRIME})), {PRIME})" for a, b in map(permutation, range(PERMUTATIONS)))}] as signature from s2)
"""
#: Similarity of the sets of five-word runs, pair by pair, then the greedy rule in the order of ids.
NEAR = f"""
n0 as (select doc_id, source, {words("lower(nfc_normalize(normalised))")} as w from {{from}}),
n1 as (select doc_id, source, list_sort(list_distinct(case when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) end)) as s from n0),
n2 as (select source, s, min(doc_id) as class_id from n1 group by 1, 2),
near_members as (select doc_id, class_id from n1 join n2 on n1.s = n2.s and n1.source is not distinct from n2.source),
n3 as (select class_id as id, source, len(s) as n, unnest(s) as x from n2),
n4 as (select a.id as a, b.id as b from n3 a join n3 b on a.x = b.x and a.source is not distinct from b.source and a.id < b.id group by 1, 2 having count(*) >= 0.8 * (any_value(a.n) + any_value(b.n) - count(*)) - 1e-9),
n5 as materialized (select id, row_number() over (order by id) as r, coalesce(list(a) filter (a is not null), []) as earlier from (select distinct unnest([a, b]) as id from n4) left join n4 on id = b group by id),
n6 as (select 0::bigint as r, []::bigint[] as stay union all select n5.r, case when list_has_any(earlier, stay) then stay else list_append(stay, id) end from n6 join n5 on n5.r = n6.r + 1),
n7 as (select stay from n6 order by r desc limit 1),
near_gone as (select id from n5 where not list_contains((select stay from n7), id))
"""
#: The fingerprint rule as a scan: one row a step, the last kept lengths in a list.
SCAN = """
p0 as (select doc_id as id, normalised as x, length(normalised) as n, length(normalised) // 2 as mid, {scope} as scope from {from} where length(normalised) > 0),
p1 as (select *, case when mid - 100 < 0 then greatest(n + mid - 100, 0) else mid - 100 end as lo from p0),
p2 as (select id, n, 'p' || sha256(substring(x, 1, 200)) || coalesce(scope, '') as a, 's' || sha256(right(x, 200)) || coalesce(scope, '') as b, 'm' || sha256(substring(x, lo + 1, greatest(mid + 100 - lo, 0))) || coalesce(scope, '') as c from p1),
p3 as (select fp, row_number() over (order by fp) as f from (select unnest([a, b, c]) as fp from p2) group by 1 having count(*) > 1),
p4 as materialized (select id, n, x.f as a, y.f as b, z.f as c, row_number() over (order by id) as r from p2 left join p3 x on x.fp = a left join p3 y on y.fp = b left join p3 z on z.fp = c where coalesce(x.f, y.f, z.f) is not null),
scanned as (select 0::bigint as r, null::bigint as id, false as gone, (select list(null::bigint) from p3) as last union all
  select r, id, near, case when near then last else list_transform(last, lambda v, i: case when i in (a, b, c) then n else v end) end from (
    select p4.r, p4.id, a, b, c, n, last, list_bool_or(list_transform([last[a], last[b], last[c]], lambda k: coalesce(abs(n - k) / greatest(n, k, 1)::double < 0.15::double, false))) as near from scanned join p4 on p4.r = scanned.r + 1))
"""
CATEGORY = "case " + " ".join(f"when {any_of('lower({c})', p)} then {q(n)}" for n, p in CATEGORY_PATTERNS.items()) + " end"
HINTS = {n: " + ".join(f"contains(lower(path), {q(h)})::int" for h in hints) for n, hints in CATEGORY_HINTS.items()}
BUDGETS = f"""
stats as (select source, count(*) as docs, sum(coalesce(length(text), 0)) as chars, sum(coalesce(length(text), 0))::double / count(*) as avg_chars, {CATEGORY.replace("{c}", "source")} as category from documents where source is not null group by source),
cat as (select category, sum(chars) as available from stats where category is not null group by category),
bud as (select cat.category, available, least(floor(5000000 * ratio), available)::bigint as budget from cat join mix_ratios using (category) where ratio > 0 and available > 0),
sb as (select *, floor(budget * (chars::double / available::double))::bigint as source_budget from stats join bud using (category)),
budgeted as (select *, least(1.0::double, greatest(0.001::double, floor(source_budget / avg_chars * 1.2::double) / docs::double)) as rate from sb)
"""
HEX = "hex(encode(text))"
BYTES = f"list_transform(regexp_extract_all({HEX}, '..'), lambda x: ('0x' || x)::int + 4)"
PACKED = f"""
d as (select doc_id, text, row_number() over (order by doc_id) - 1 as position from documents where text is not null),
ids as (select doc_id, case when position % 100 = 0 then 'val' else 'train' end as split, [1] || {BYTES} || [2] as ids from d),
off as (select *, coalesce(sum(len(ids)) over (partition by split order by doc_id rows between unbounded preceding and 1 preceding), 0) as o from ids),
tok as (select split, o + i - 1 as pos, ids[i] as token from off, unnest(range(1, len(ids) + 1)) as u(i)),
packed as (select split, pos // 1025 as seq_id, list(token order by pos) as tokens from tok group by 1, 2 having count(*) = 1025)
"""
FINITE = lambda c: f"({c} is not null and not isnan({c}) and not isinf({c}))"
LOG = """
lg as (select *, val_loss is not null and loss is null as v, row_number() over (partition by run_id, step, val_loss is not null and loss is null order by coalesce(logged_at, timestamp '1970-01-01') desc, log_id desc) as r from step_log),
training as (select * from lg where r = 1 and not v), validation as (select * from lg where r = 1 and v)
"""
LOGITS = "l as (select vec_id as row_id, i - 1 as token_id, embedding[i]::double as logit from embeddings, unnest(range(1, len(embedding) + 1)) as u(i) where embedding[i] is not null and not isnan(embedding[i]))"
BODY = "coalesce(nullif(content, ''), nullif(code, ''), nullif(func_code_string, ''), nullif(text, ''), '')"
HEAD = f"lower(string_split({BODY}, chr(10))[1])"
LANG = "lower(coalesce(language, lang, ''))"


def code_rows(condition: str) -> str:
    return f"select row_id, {BODY} as body from code_rows where {LANG} {condition} and length({BODY}) > 50 and not {any_of(HEAD, HEADER_MARKERS)}"


def prob(t: float) -> str:
    return f"(select row_id, token_id, logit, exp((logit - max(logit) over (partition by row_id)) / {t}::double) as e from l)"


SQL = {
    "code_flag": f"select doc_id, {IS_CODE} as is_code, {IS_CODE_PATH} as is_code_source from documents",
    "clean_text": f"select doc_id, {clean('text')} as cleaned from documents where text is not null",
    "clean_code_text": f"select doc_id, {clean_code('text')} as cleaned from documents where text is not null",
    "normal_form": "select doc_id, md5(nfc_normalize(text)) as digest from documents where text is not null",
    "word_stats": f"with a as (select doc_id, {words('text')} as w from documents where text is not null) select doc_id, len(w) as n_words, len(list_distinct(w)) as n_distinct, coalesce(list_max(list_transform(w, lambda x: length(x))), 0) as longest from a",
    "trigram_repetition": f"with a as (select doc_id, {words('text')} as w from documents where text is not null), b as (select doc_id, {TRIGRAMS} as g from a) select doc_id, len(g) as trigrams, {MOST} as most_common from b",
    "latin_ratio": f"with a as (select doc_id, length(regexp_replace(text, '{W}', '', 'g')) as s, length(regexp_replace(text, '{W}|[^\\x{{0}}-\\x{{24f}}]', '', 'g')) as k from documents where text is not null) select doc_id, round(case when s > 0 then k / greatest(s, 1)::double else 0 end, 9) as latin_share from a",
    "sentence_stats": f"with a as (select doc_id, text as t from documents where text is not null), b as (select doc_id, {SENTENCES} as ss from a) select doc_id, len(ss) as sentences, len(list_filter(ss, lambda s: len({words('s')}) < 6)) as short from b",
    "list_ratio": f"with a as (select doc_id, text as t from documents where text is not null) select doc_id, len(string_split(t, chr(10))) as lines, len({LINES}) as \"full\", len(list_filter({LINES}, lambda s: regexp_matches(s, {MARK}))) as items from a",
    "comment_ratio": f"with a as (select doc_id, text as t from documents where text is not null), b as (select doc_id, {LIVE} as live from a) select doc_id, len(live) - len(list_filter(live, lambda s: {COMMENT})) as code, len(list_filter(live, lambda s: {COMMENT})) as comments from b",
    "comment_ratio_c": f"with a as (select doc_id, text as t from documents where text is not null), b as (select doc_id, {LIVE} as live from a) select doc_id, len(live) - len(list_filter(live, lambda s: {COMMENT_C})) as code, len(list_filter(live, lambda s: {COMMENT_C})) as comments from b",
    "quality_reason": f"with {FEATURES} select doc_id, source, is_code, reason from reasoned",
    "quality_histogram": f"with {FEATURES} select source, reason, count(*) as n from reasoned group by 1, 2",
    "top_reasons_per_source": f"with {FEATURES}, c as (select source, reason, count(*) as n from reasoned where reason <> 'ok' group by 1, 2), r as (select *, row_number() over (partition by source order by n desc, reason) as rank from c) select * from r where rank <= 3",
    "filter_totals": f"with {FEATURES} select is_code, count(*) as docs, count(*) filter (reason = 'ok') as kept, count(*) filter (reason <> 'ok') as rejected from reasoned group by 1",
    "rejection_report": "select source, lower(trim(reason)) as reason, sum(coalesce(n, 0))::bigint as n from rejections where reason is not null group by 1, 2",
    "kept_corpus": f"with {FEATURES}, r as (select *, row_number() over (partition by digest order by case when is_code then 0 else 1 end, doc_id) as k from kept) select doc_id, source, digest from r where k = 1",
    "exact_dedup": f"with {FEATURES} select doc_id, digest, row_number() over (partition by digest order by doc_id) = 1 as is_first from kept",
    "dup_groups": f"with {FEATURES} select digest, count(*) as copies, min(doc_id) as first_id from kept group by 1 having count(*) > 1",
    "incremental_dedup": "with k as (select doc_id, md5(nfc_normalize(text)) as digest from documents where text is not null) select min(doc_id) as doc_id, digest from k where doc_id % 2 = 1 and digest not in (select digest from k where doc_id % 2 = 0) group by digest",
    "ngram_blacklist": f"with a as (select {MATCHING} as w from benchmark where text is not null) select distinct unnest({NGRAMS13}) as ngram from a",
    "contaminated_docs": f"with a as (select {MATCHING} as w from benchmark where text is not null), b as (select distinct unnest({NGRAMS13}) as ngram from a), c as (select doc_id, {MATCHING} as w from documents where text is not null), d as (select doc_id, unnest({NGRAMS13}) as ngram from c) select doc_id, count(*) as hits from d where ngram in (select ngram from b) group by 1",
    "minhash_signature": f"with {FEATURES}, {SHINGLES} select doc_id, array_to_string(signature, ',') as signature from signed",
    "lsh_buckets": f"with {FEATURES}, {SHINGLES}, b as (select source, doc_id, i as band, md5(array_to_string(signature[i * 15 + 1 : i * 15 + 15], ',')) as bucket from signed, unnest(range(0, 4)) as u(i) where not is_code) select source, band, bucket, count(*) as members, min(doc_id) as first_id from b group by 1, 2, 3 having count(*) > 1",
    "lsh_buckets_code": f"with {FEATURES}, {SHINGLES}, b as (select source, doc_id, i as band, md5(array_to_string(signature[i * 11 + 1 : i * 11 + 11], ',')) as bucket from signed, unnest(range(0, 5)) as u(i) where is_code) select source, band, bucket, count(*) as members, min(doc_id) as first_id from b group by 1, 2, 3 having count(*) > 1",
    "fuzzy_dedup": f"with recursive {FEATURES}, {NEAR.replace('{from}', 'kept')} select doc_id, class_id, doc_id <> class_id or class_id in (select id from near_gone) as removed from near_members",
    "fingerprint_dedup": f"with recursive {FEATURES}, {SCAN.replace('{from}', 'kept').replace('{scope}', chr(39) * 2)} select doc_id, doc_id in (select id from scanned where gone) as removed from kept",
    "routed_dedup": f"with recursive {FEATURES}, sizes as (select source, count(*) > 100 as large from kept group by 1), small as (select k.* from kept k join sizes s on k.source is not distinct from s.source where not large), big as (select k.* from kept k join sizes s on k.source is not distinct from s.source where large), {NEAR.replace('{from}', 'small')}, {SCAN.replace('{from}', 'big').replace('{scope}', 'source')} select doc_id, 'similarity' as rule, doc_id <> class_id or class_id in (select id from near_gone) as removed from near_members union all select doc_id, 'fingerprint', doc_id in (select id from scanned where gone) from big",
    "fingerprint_keys": f"with {FEATURES}, a as (select doc_id, normalised as x, length(normalised) as n, length(normalised) // 2 as mid from kept), b as (select *, case when mid - 100 < 0 then greatest(n + mid - 100, 0) else mid - 100 end as lo from a) select doc_id, n, sha256(substring(x, 1, 200)) as fp_prefix, sha256(right(x, 200)) as fp_suffix, sha256(substring(x, lo + 1, greatest(mid + 100 - lo, 0))) as fp_middle from b",
    "web_rows_accepted": "select row_id, source from web_rows where coalesce(score, 1.0) >= 0.7 and length(text) > 100",
    "min_length": "select row_id from web_rows where length(text) > 100",
    "italian_markers": f"select doc_id, {any_of('lower(substring(text, 1, 500))', ITALIAN_MARKERS)} as likely_italian from documents where text is not null",
    "autogen_header": f"select row_id, {any_of(HEAD, HEADER_MARKERS)} as generated, {any_of(HEAD, HEADER_MARKERS_SHORT)} as generated_short from code_rows",
    "code_rows_c": f"select row_id, md5(body) as digest from ({code_rows("= 'c'")})",
    "code_rows_cpp": f"select row_id, md5(body) as digest from ({code_rows("in ('c++', 'cpp', 'cplusplus')")})",
    "other_code_quota": " union all ".join(f"(select row_id, {q(x)} as language from ({code_rows(f'= {q(x)}')}) order by row_id limit 30)" for x in ("python", "javascript", "rust")),
    "source_priority_limit": "with a as (select row_id, source, case source when 'italian_fineweb' then 0 when 'italian_wiki' then 1 else 2 end as priority from web_rows where source in ('italian_fineweb', 'italian_wiki', 'italian_oscar') and length(text) > 100) select row_id, source, priority from a order by priority, row_id limit 250",
    "source_registry": f"with a as (select source from web_rows where (source = 'italian_oscar' and coalesce(score, 1.0) >= 0.7 and length(text) > 100) or (source = 'italian_fineweb' and length(text) > 100) or (source in ('italian_wiki', 'english_web', 'english_wiki', 'english_edu') and length(text) > 0) union all select 'c_code' from ({code_rows("= 'c'")}) union all select 'cpp_code' from ({code_rows("in ('c++', 'cpp', 'cplusplus')")}) union all select 'other_code' from ({code_rows("in ('python', 'javascript', 'rust')")})) select source, count(*) as n from a group by 1",
    "download_summary": "with c as (select source, count(*) as docs from documents group by 1), a as (select t.source, t.target, coalesce(c.docs, 0) as docs from tier_targets t left join c using (source) where tier = 'smoke') select *, case when docs = 0 then 'EMPTY' when docs < target * 0.5 then 'LOW(' || round(docs * 100 / target::double)::bigint || '%)' else 'OK' end as status from a",
    "stored_stats": "with a as (select path, source, n, row_number() over (partition by path order by coalesce(n, -1) desc) as r from file_stats where path is not null) select source, count(*) as files, sum(n)::bigint as lines from a where r = 1 group by 1",
    "category_stats": f"with s as (select {CATEGORY.replace('{c}', 'source')} as category, count(*) as docs, sum(coalesce(length(text), 0))::bigint as chars from documents group by 1) select category, docs, chars, floor(chars / chars_per_token)::bigint as est_tokens from s join mix_ratios using (category)",
    "category_hint": "with p as (select distinct path from file_stats where path is not null), h as (select path, " + CATEGORY.replace("{c}", "path") + " as category, " + ", ".join(f"{e} as s{i}" for i, e in enumerate(HINTS.values())) + " from p), b as (select *, greatest(s0, s1, s2, s3, s4) as m from h) select path, category, case when m = 0 then null " + " ".join(f"when s{i} = m then {q(n)}" for i, n in enumerate(HINTS)) + " end as hint, case when m > 0 then m end as hint_score from b",
    "category_budget": f"with {BUDGETS} select source, category, budget, source_budget, round(rate, 9) as rate from budgeted",
    "hash_sample": f"with {BUDGETS}, d as (select doc_id, source, text, row_number() over (partition by source order by doc_id) as ordinal from documents where source is not null), h as (select d.*, rate, ('0x' || md5((case source {' '.join(f'when {q(s)} then {source_hash(s)}' for s in SOURCES)} else 0 end) || ':' || ordinal))::uhugeint % 100000 as h from d join budgeted using (source)) select doc_id, source, ordinal from h where h / 100000.0::double < rate and length(text) > 0",
    "sampled_totals": "select source, count(*) as kept_docs, sum(length(text))::bigint as kept_chars from documents join ({hash_sample}) using (doc_id, source) group by 1",
    "split_totals": "with d as (select row_number() over (order by doc_id) - 1 as position from documents where text is not null), c as (select count(*) filter (position % 100 <> 0) as train_docs, count(*) filter (position % 100 = 0) as val_docs from d) select *, round(val_docs * 100 / (train_docs + val_docs)::double, 6) as val_percent from c",
    "packing_report": "with d as (select text, row_number() over (order by doc_id) - 1 as position from documents where text is not null), e as (select case when position % 100 = 0 then 'val' else 'train' end as split, count(*) as docs, sum(length(text))::bigint as chars, sum(octet_length(encode(text)) + 2)::bigint as tokens from d group by 1) select *, round(chars / docs::double, 6) as chars_per_doc, tokens // 1025 as sequences from e",
    "binary_round_trip": f"with {PACKED} select seq_id, md5(array_to_string(tokens, ',')) as digest from packed where split = 'train'",
    "json_round_trip": f"select md5(text) as digest, count(*) as n from documents where text is not null and regexp_matches(text, '{NOT_W}') group by 1",
    "bpe_round_trip": "select doc_id, true as same from documents where text is not null",
    "reservoir_mean": "select count(*) as n, avg(length(text)) as avg_chars from (select text from documents where text is not null order by md5('42/' || text), text limit 2000)",
    "tokenizer_sample": f"with t as (select doc_id, source, text, least(1, 400 / greatest(count(*) over (), 1)::double) as base, {IS_CODE_PATH} as code from documents where text is not null), d as (select * from t where ('0x' || md5('7/' || text))::uhugeint % 1000000 / 1000000::double < case when code then least(1, base * 1.5) else base end) select doc_id, source from d order by md5('42/' || text), text limit 480",
    "shard_counts": f"select ('0x' || right(md5({strip('text')}), 1))::int % 16 as shard, count(*) as docs from documents where text is not null group by 1",
    "train_val_split": "with d as (select doc_id, row_number() over (order by doc_id) - 1 as position from documents where text is not null) select doc_id, position, case when position % 100 = 0 then 'val' else 'train' end as split from d",
    "shuffled_order": f"select doc_id, ('0x' || right(md5({strip('text')}), 1))::int % 16 as shard from documents where text is not null",
    "byte_tokens": f"with a as (select doc_id, {BYTES} as ids from documents where text is not null) select doc_id, len(ids) as n_tokens, md5(array_to_string(ids, ',')) as digest from a",
    "pack_sequences": f"with {PACKED} select split, seq_id, len(tokens) as n, md5(array_to_string(tokens, ',')) as digest from packed",
    "packing_totals": f"with {PACKED} select split, count(*) as sequences, sum(len(tokens))::bigint as tokens from packed group by 1",
    "xy_pairs": f"with {PACKED} select split, seq_id, md5(array_to_string(tokens[1:1024], ',')) as x, md5(array_to_string(tokens[2:1025], ',')) as y from packed",
    "doc_boundary_mask": f"with {PACKED} select split, seq_id, 1024 as n, len(list_filter(tokens[1:1024], lambda t: t in (1, 2))) as masked from packed",
    "mtp_mask": f"with {PACKED} select split, seq_id, 1023 as n, len(list_filter(range(1, 1024), lambda i: tokens[i] in (1, 2) or tokens[i + 1] in (1, 2))) as masked from packed",
    "mtp_targets": f"with {PACKED} select split, seq_id, 1022 as n, tokens[4] as first, tokens[1025] as last from packed",
    "piece_counts": f"with a as (select unnest(regexp_extract_all(text, ' ?\\p{{L}}+| ?\\p{{N}}+| ?[^{SPACE_BODY}\\p{{L}}\\p{{N}}]+')) as piece from documents where text is not null) select piece, count(*) as n from a group by 1",
    "ema_loss": f"with {LOG} select run_id, count(*) as n, round(round(list_reduce(list(loss order by step), lambda e, x: 0.05::double * x + 0.95::double * e), 9)::decimal(20, 9), 6)::double as ema from training where {FINITE('loss')} group by 1",
    "running_best": f"with {LOG}, a as (select run_id, step, val_loss, min(val_loss) over (partition by run_id order by step rows unbounded preceding) as best, min(val_loss) over (partition by run_id order by step rows between unbounded preceding and 1 preceding) as b from validation where {FINITE('val_loss')}) select run_id, step, round(best, 6) as best, b is null or val_loss < b as improved from a",
    "capped_history": f"with {LOG}, a as (select run_id, step, loss, row_number() over (partition by run_id order by step desc) as r, count(*) over (partition by run_id) as n from training where {FINITE('loss')}) select run_id, step, round(loss, 4) as value from a where r <= case when n <= 2000 then n else 1500 + (n - 2001) % 501 end",
    "chart_points": f"with {LOG}, a as (select run_id, step, val_loss, row_number() over (partition by run_id order by step desc) as r, count(*) over (partition by run_id) as n from validation where {FINITE('val_loss')}) select run_id, step as x, round(val_loss, 4) as y from a where r <= case when n <= 2000 then n else 1500 + (n - 2001) % 501 end",
    "keep_latest": f"with {LOG}, a as (select run_id, step, row_number() over (partition by run_id order by step desc) as k from validation) select run_id, step from a where k <= 3",
    "validation_summary": f"with {LOG}, a as (select run_id, val_loss, row_number() over (partition by run_id order by step) as k from validation where {FINITE('val_loss')}) select run_id, round(avg(val_loss), 6) as mean_val_loss, round(exp(least(avg(val_loss), 20)), 3) as perplexity from a where k <= 500 group by 1",
    "optimiser_steps": f"with {LOG} select run_id, step // 16 as optimiser_step, round(avg(loss), 6) as mean_loss, count(*) as micro_steps from training where {FINITE('loss')} group by 1, 2",
    "throughput": f"with {LOG} select run_id, step, (step + 1) * 65536 as tokens_seen, round(case when {FINITE('tok_per_sec')} and tok_per_sec > 0 then (80000 - step) * 65536 / tok_per_sec end, 1) as eta_seconds from training",
    "sanitised_log": f"select run_id, count(*) as n, count(*) filter ({FINITE('loss')}) as losses, count(*) filter ({FINITE('val_loss')}) as val_losses, count(*) filter ({FINITE('tok_per_sec')}) as rates from step_log group by 1",
    "lr_schedule": "select step, round(case when step < 3000 then 3e-4 * (step + 1) / 3000 when step < 57000 then 3e-4 else 1e-5 + 0.5 * (1 + cos(3.141592653589793 * (step - 57000) / 23000)) * (3e-4 - 1e-5) end * 1e9, 3) as lr_e9 from range(0, 80001, 500) as r(step)",
    "humanised_counts": "with a as (select source, sum(coalesce(length(text), 0))::bigint as c from documents group by 1) select source, case when c >= 1e9 then printf('%.2fB', c / 1e9) when c >= 1e6 then printf('%.1fM', c / 1e6) when c >= 1e3 then printf('%.1fK', c / 1e3) else c::varchar end as chars from a",
    "topk_filter": f"with {LOGITS}, r as (select *, rank() over (partition by row_id order by logit desc) as k from l) select row_id, token_id from r where k <= 10",
    "topp_filter": f"with {LOGITS}, a as (select row_id, token_id, e / sum(e) over (partition by row_id) as p from {prob(0.1)}), b as (select *, coalesce(sum(p) over (partition by row_id order by p desc, token_id rows between unbounded preceding and 1 preceding), 0) as before from a) select row_id, token_id, round(p, 9) as p from b where before <= 0.5",
    "repetition_penalty": f"with {LOGITS}, h as (select distinct vec_id as row_id, (vec_id * 7 + i * i) % 64 as token_id from embeddings, unnest(range(16, 80)) as u(i)) select l.row_id, l.token_id, round(case when h.token_id is null then logit when logit > 0 then logit / 1.2::double else logit * 1.2::double end, 9) as logit from l left join h on l.row_id = h.row_id and l.token_id = h.token_id",
    "log_normaliser": f"with {LOGITS}, m as (select row_id, max(logit) as m from l group by 1) select row_id, round(max(m) + ln(sum(exp(logit - m))), 9) as logsumexp from l join m using (row_id) group by 1",
    "draft_residual": f"with {LOGITS}, p as (select row_id, token_id, e / sum(e) over (partition by row_id) as p from {prob(0.1)}), q as (select row_id, token_id, e / sum(e) over (partition by row_id) as q from {prob(0.2)}), d as (select row_id, p, q, greatest(p - q, 0) as d, sum(greatest(p - q, 0)) over (partition by row_id) as t from p join q using (row_id, token_id)) select row_id, count(*) filter (0.5 < case when q > 0 then least(1.0, p / q) else 1.0 end) as accepted, round(max(case when t > 0 then d / t else p end), 9) as largest, round(sum(case when t > 0 then d / t else p end), 6) as total from d group by 1",
}
SQL["sampled_totals"] = SQL["sampled_totals"].replace("{hash_sample}", SQL["hash_sample"])
