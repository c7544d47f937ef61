"""The token counts written independently in DuckDB's SQL: merges applied piece by piece in a recursive query."""

from __future__ import annotations

from corpusmill.llm.budget import byte_alphabet
from corpusmill.llm.language import NAMES
from corpusmill.plans.oracle import CATEGORY

_SPACE = r"\x{9}-\x{d}\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: RE2 has no look-ahead: the last sign of a run of white space before a word is cut off by a separator first.
_CUT = f"regexp_replace(t, '([{_SPACE}])([{_SPACE}][^{_SPACE}])', '\\1' || chr(57344) || '\\2', 'g')"
_PIECE = rf"''s|''t|''re|''ve|''m|''ll|''d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+"
_SIGN = {b: c for c, b in byte_alphabet().items()}
_SIGNS = "[" + ", ".join("'" + _SIGN[b].replace("'", "''") + "'" for b in range(256)) + "]"
_OPEN, _CLOSE = "chr(57345)", "chr(57346)"
_LANGUAGE = "case " + " ".join("when k in (" + ", ".join(f"'{n}'" for n in [code, *names.split()]) + f") then '{code}'" for code, names in NAMES.items()) + " else lower(trim(lang)) end"

TOKENS = f"""
t0 as (select row_number() over () as row, doc_id, source, lang, domain, length(text)::bigint as n_chars, case when text = '' or starts_with(text, ' ') then text else ' ' || text end as t from documents),
t1 as (select row, unnest(string_split({_CUT}, chr(57344))) as part from t0 where t is not null),
t2 as (select row, unnest(regexp_extract_all(part, '{_PIECE}')) as piece from t1),
t3 as (select distinct piece from t2),
t4 as (select piece, list_transform(regexp_extract_all(hex(encode(piece)), '..'), lambda x: {_OPEN} || ({_SIGNS})[('0x' || x)::int + 1] || {_CLOSE}) as signs from t3),
t5 as (select piece, array_to_string(signs, '') as s, 0 as step from t4 union all
  select piece, replace(s, {_OPEN} || m.l || {_CLOSE} || {_OPEN} || m.r || {_CLOSE}, {_OPEN} || m.l || m.r || {_CLOSE}), step + 1 from (
    select piece, any_value(s) as s, any_value(step) as step, arg_min(struct_pack(l := left_piece, r := right_piece), merge_rank) as m
    from (select piece, s, step, unnest(list_zip(x[:-2], x[2:])) as p from (select *, string_split(s[2:-2], {_CLOSE} || {_OPEN}) as x from t5)) join bpe_merges on left_piece = p[1] and right_piece = p[2] group by piece)),
t6 as (select piece, arg_max(length(s) - length(replace(s, {_OPEN}, '')), step) as tokens from t5 group by piece),
t7 as (select row, sum(tokens)::bigint as tokens from t2 join t6 using (piece) group by row),
counted as (select doc_id, source, lang, domain, n_chars, case when n_chars is not null then coalesce(tokens, 0) end as n_tokens from t0 left join t7 using (row))
"""
_TOTALS = "count(*) as documents, coalesce(sum(n_chars), 0)::bigint as characters, coalesce(sum(n_tokens), 0)::bigint as tokens"

#: White space and signs without width, which end no sentence.
_EMPTY = r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{ad}\x{1680}\x{2000}-\x{200d}\x{2028}\x{2029}\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}"
_BLANK = _EMPTY.replace(r"\x{ad}", "").replace(r"\x{200d}", r"\x{200a}").replace(r"\x{2060}", "").replace(r"\x{feff}", "")

SQL = {
    "p3_rates": f"with recursive {TOKENS}, r as (select category, ratio, greatest(coalesce(max_repeats, 1), 0) as cap from mix_ratios where ratio > 0), a as (select category, count(*) as records, sum(n_tokens)::bigint as available, max(ratio) as ratio, max(cap) as cap from (select n_tokens, {CATEGORY.replace('{c}', 'source')} as category from counted where n_tokens > 0) join r using (category) group by category having max(cap) > 0), w as (select sum(ratio) as whole from a), f as (select min(floor(available * cap / (ratio / whole))) as aim from a, w) select category, records, available, round(least(aim * ratio / whole, available * cap) / available::double, 4) as rate from a, w, f",
    "p4_cover": f"select doc_id, 0 as first_pos, length(text) as last_pos, length(text) as covered from documents where regexp_matches(source, '^(italian|english)_') and regexp_matches(text, '[^{_BLANK}]')",
    "p6_documents": f"with recursive {TOKENS} select doc_id, n_tokens + 2 as tokens, (n_tokens + 2 + 1024) // 1025 as fragments, least(n_tokens + 2, 1025) as longest from counted where n_tokens is not null",
    "p8_ends": f"select doc_id, length(regexp_replace(text, '[{_EMPTY}]+$', '')) as last_end, true as numbered_through from documents where doc_id in (select doc_id from sentence_sample) and regexp_matches(text, '[^{_EMPTY}]')",
    "p1_document_tokens": f"with recursive {TOKENS} select doc_id, source, n_chars, n_tokens from counted",
    "p1_source_tokens": f"with recursive {TOKENS} select source, {_TOTALS} from counted group by source",
    "p1_token_budget": f"with recursive {TOKENS}, k as (select *, regexp_extract(lower(trim(lang)), '^(\\p{{L}}+)', 1) as k from counted), l as (select source, case when regexp_matches(source, '_code$') then regexp_replace(lower(trim(lang)), '^(c\\+\\+|cplusplus)$', 'cpp') else {_LANGUAGE} end as language, regexp_replace(lower(trim(domain)), '^www\\.', '') as domain, n_chars, n_tokens from k) select source, language, domain, {_TOTALS} from l group by source, language, domain",
}
