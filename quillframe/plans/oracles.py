"""DuckDB SQL for the queries: the same results by windows, groups and RE2, written on their own; word lists are the fixed ones."""

from ..operators import pos

S = r"[\t\n\x0B\f\r\x85\p{Z}]"
W = r"\p{L}\p{Mn}\p{Nd}\p{Pc}"

#: Markdown made of the documents, as in ``queries.markdown_docs``.
MD = """md as (select source || '/' || doc_id || '.md' as file,
  repeat('#', (doc_id % 60 % 6 + 1)::int) || ' Guide for ' || source || case when doc_id % 2 = 1 then ' ##' else '' end || chr(10) || chr(10) || m || ' item ' || doc_id || chr(10) || '  wrapped; it isn''t the pump''s door' || chr(10) || m || ' ' || chr(10)
  || '  It''s `a;b` (See the note.) that''s opened.' || chr(10) || '    - nested item has been opened by 10 the team' || chr(10) || chr(10)
  || '| id | note |' || chr(10) || '| --- | :-- |' || chr(10) || '| ' || doc_id || ' | `a|b` prior to testing |' || chr(10) || chr(10)
  || f || chr(10) || 'var utilize = 1; isn''t' || chr(10) || f || chr(10) || chr(10)
  || 'See the [user guide](https://example.com/' || doc_id || ') for the use of the tool. The Main Control Panel was opened, and "all of it" shall impact the test.' || chr(10)
  || case doc_id % 4 when 0 then 'We utilize a lot of heat in the event of testing.' when 1 then 'Open valves impact the impact of an opened test; you shan''t utilize them.'
     when 2 then 'To impact tests, Shall   we start prior  to the opening event? Opened doors test the seal.' else 'Utilize `utilize` here: test the test (The test was opened.) that has been opened. Impact 3 of them.' end
  || chr(10) || chr(10) || text as content
  from (select *, case doc_id % 5 when 0 then '-' when 1 then '*' when 2 then '+' when 3 then '1.' else '2)' end as m, case when doc_id % 2 = 0 then '```' else '~~~~' end as f from documents))"""


def trim(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{S}+', ''), '{S}+$', '')"


LINES = rf"""{MD},
l0 as (select file, i as line_no, ls[i] as raw from (select file, string_split(replace(content, chr(13) || chr(10), chr(10)), chr(10)) as ls, unnest(range(1, len(string_split(replace(content, chr(13) || chr(10), chr(10)), chr(10))) + 1)) as i from md)),
l1 as (select *, regexp_matches(raw, '^{S}*(```+|~~~+)') as fence, regexp_replace(raw, '\[([^\]]*)\]\([^)]*\)', '\1', 'g') as c from l0),
l2 as (select *, sum(fence::int) over (partition by file order by line_no) as n_fences from l1),
l3 as (select *, case when fence then 'F' when n_fences % 2 = 1 then 'I' when regexp_matches(c, '^{S}*$') then 'B'
  when regexp_matches(c, '^{S}{{0,3}}#{{1,6}}{S}+.*$') then 'H' when regexp_matches(c, '^{S}{{0,3}}(?:[-*+]|\d+[.)]){S}+.*$') then 'L'
  when regexp_matches(c, '^{S}{{0,3}}\|') then case when regexp_matches(c, '^{S}{{0,3}}\|?{S}*:?-{{2,}}:?{S}*(\|{S}*:?-{{2,}}:?{S}*)*\|?{S}*$') then 'B' else 'T' end
  when regexp_matches(c, '^{S}*(?:[-*+]|\d+[.)]){S}+.*$') then 'N' else 'X' end as k from l2)"""

SEGMENTS = rf"""{LINES},
l4 as (select *, case k when 'X' then {trim("c")} when 'L' then {trim(f"regexp_extract(c, '^{S}*(?:[-*+]|[0-9]+[.)]){S}+(.*)$', 1)")}
  when 'N' then {trim(f"regexp_extract(c, '^{S}*(?:[-*+]|[0-9]+[.)]){S}+(.*)$', 1)")} end as piece, lag(k) over (partition by file order by line_no) as before from l3),
l5 as (select *, sum(case when k in ('L', 'N') or k = 'X' and coalesce(before, 'B') not in ('L', 'N', 'X') then 1 else 0 end) over (partition by file order by line_no) as island from l4),
folded as (select file, min(line_no) as line, 0 as cell, case when arg_min(k, line_no) = 'X' then 'Paragraph' else 'ListItem' end as role,
  coalesce(string_agg(piece, ' ' order by line_no) filter (where piece <> ''), '') as text, count(*) as n_lines from l5 where k in ('X', 'L', 'N') group by file, island),
cell as (select file, line_no, unnest(list_filter(list_transform(regexp_extract_all(c, '(?:`[^`]*`|[^|])+'), lambda x: {trim("x")}), lambda x: x <> '')) as text,
  generate_subscripts(list_filter(list_transform(regexp_extract_all(c, '(?:`[^`]*`|[^|])+'), lambda x: {trim("x")}), lambda x: x <> ''), 1) as cell from l3 where k = 'T'),
every as (select file, line, cell, role, text, n_lines from folded where text <> ''
  union all select file, line_no, cell, 'TableRow', text, 1 from cell
  union all select file, line_no, 0, 'Heading', regexp_extract(c, '^{S}{{0,3}}#{{1,6}}{S}+(.*?){S}*#*{S}*$', 1), 1 from l3 where k = 'H'),
seg as (select file, (row_number() over (partition by file order by line, cell) - 1)::int as seg_ord, line::int as line, role, text, n_lines from every)"""



def plain(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '[ªµº\x{{C0}}-\x{{D6}}\x{{D8}}-\x{{F6}}\x{{F8}}-\x{{24F}}]', '_', 'g'), '[\x{{80}}-\x{{10FFFF}}]', ' ', 'g')"


def count_words(x: str) -> str:
    t = rf"""regexp_replace(regexp_replace(regexp_replace({plain(x)}, '`[^`]*`', 'C', 'g'), '"[^"]*"', 'Q', 'g'), '\([^()]*\)', 'P', 'g')"""
    t = rf"regexp_replace(regexp_replace({t}, '\b\d+(?:\.\d+)?{S}?[a-zA-Z%]{{1,4}}\b', 'N', 'g'), '(\S{S})[A-Z][a-zA-Z0-9]*(?:{S}+[A-Z][a-zA-Z0-9]*)+', '\1T', 'g')"
    return f"len(regexp_extract_all({t}, '[^\\t\\n\\x0B\\f\\r\\x85\\p{{Z}}]+'))"


SENTENCES = rf"""{SEGMENTS},
p0 as (select file, seg_ord, line, role, text, string_split(regexp_replace({trim("text")}, '([.!?:])({S}+)([A-Z0-9"''(])', '\1' || chr(1) || '\2' || chr(2) || '\3', 'g'), chr(1)) as ps from seg),
p1 as (select file, seg_ord, line, role, unnest(ps) as p, generate_subscripts(ps, 1) as i from p0 where text <> ''),
p2 as (select *, regexp_replace(p, '^[^\x02]*\x02', '') as s, sum(length(replace(p, chr(2), ''))) over (partition by file, seg_ord order by i) as stop from p1),
p3 as (select file, seg_ord, line, role, i, s, (stop - length(s))::int as start_offset from p2),
inner_raw as (select *, unnest(regexp_extract_all(s, '\([^()]*\)')) as raw, generate_subscripts(regexp_extract_all(s, '\([^()]*\)'), 1) as j from p3 where contains(s, '(')),
inner_s as (select *, {trim("raw[2:-2]")} as t from inner_raw),
sent as (select file, seg_ord, line, role, i, 0 as j, s as text, start_offset from p3
  union all select file, seg_ord, line, role, i, j, t, null from inner_s where length(t) >= 2 and regexp_matches(t, '^\p{{Lu}}') and regexp_matches(t, '[.!?]$')),
sc as (select *, {count_words("text")}::int as word_count from sent)"""

SHORT = "case when length({0}) <= 80 then {0} else {0}[1:77] || '...' end"

#: Text with its code spans gone, words in ASCII form.
BARE = f"regexp_replace({plain('text')}, '`[^`]*`', '`', 'g')"


def hits(pattern: str) -> str:
    """Matches outside code of a pattern, one a row."""
    return f"select file, seg_ord, line, role, unnest(regexp_extract_all({BARE}, '{pattern}')) as m from seg"


CONTRACTION = r"(?i)\b\w+''(?:t|s|re|ve|ll|d|m)\b"
IS_WORDS = "'it','that','this','there','here','what','who','how','when','where','why','he','she','one','everybody','somebody','nobody','everyone','someone','let','such'"
COMPLEX = r"(?i)\b(?:(?:has|have|had)\s+(?:been\s+)?\w+(?:ed|en)|(?:will|would|could|should|may|might|must)\s+have\s+\w+(?:ed|en))\b"
MASKED = "regexp_replace(" + plain("text") + ", '`[^`]*`', 'C', 'g')"
PASSIVE = rf"regexp_matches(regexp_replace({MASKED}, '(?i)(has|have|had)\s+been', 'zzzz', 'g'), '(?i)\b(?:is|are|was|were|be|being|been)\s+\w+(?:ed|en)\b')"

#: Findings of the structural rules by file, code and severity.
RULE_ROWS = rf"""{SENTENCES},
found as (
  select file, 'STE100-4.1' as rule_code, 'error' as severity from sc where word_count > 25
  union all select file, 'STE100-8.1', 'error' from seg where contains(regexp_replace(text, '`[^`]*`', '', 'g'), ';')
  union all select file, 'STE100-4.2', 'error' from ({hits(CONTRACTION)}) where lower(m) not like '%''s' or lower(split_part(m, '''', 1)) in ({IS_WORDS})
  union all select file, 'STE100-ADV-COMPLEXVERB', 'warn' from sc where regexp_matches({MASKED}, '{COMPLEX}')
  union all select file, 'STE100-ADV-PASSIVE', 'warn' from sc where {PASSIVE}
  union all select file, 'STE100-ADV-INGFORM', 'warn' from ({hits(r"(?i)\.?\b[a-z][a-z-]{2,}ing\b\.?")}) where m not like '.%' and m not like '%.'
  union all select file, 'STE100-ADV-PARA', 'warn' from (select file, seg_ord, count(*) as n from sc where role = 'Paragraph' group by file, seg_ord) where n > 6)"""

#: Tokens of segments without code, in order, with whether only white space stands before.
TOKENS = rf"""{SEGMENTS},
t0 as (select file, seg_ord, string_split(regexp_replace(regexp_replace(text, '`[^`]*`', '`', 'g'), '([{W}-]+)', chr(1) || '\1' || chr(2), 'g'), chr(1)) as ps from seg),
t1 as (select file, seg_ord, generate_subscripts(ps, 1) as i, unnest(ps) as p from t0),
tok as (select file, seg_ord, i, lower(split_part(p, chr(2), 1)) as w, regexp_matches(split_part(p, chr(2), 2), '^{S}+$') as open from t1 where i > 1)"""

TERMS = "('utilize'), ('impact'), ('prior to'), ('in the event of'), ('event'), ('a lot of'), ('shall'), ('test'), ('the'), ('opened')"
MATCHES = f"""{TOKENS},
term as (select t as term, string_split(t, ' ') as ws from (values {TERMS}) v(t)),
hit as (select a.file, a.seg_ord, a.i, term from tok a join term on a.w = ws[1]
  left join tok b on b.file = a.file and b.seg_ord = a.seg_ord and b.i = a.i + 1
  left join tok c on c.file = a.file and c.seg_ord = a.seg_ord and c.i = a.i + 2
  left join tok d on d.file = a.file and d.seg_ord = a.seg_ord and d.i = a.i + 3
  where (len(ws) < 2 or a.open and b.w = ws[2]) and (len(ws) < 3 or b.open and c.w = ws[3]) and (len(ws) < 4 or c.open and d.w = ws[4]))"""

#: What the settings of ``queries.CONFIG`` come to for a file.
SETTINGS = """conf as (select distinct source || '/' || doc_id || '.md' as file, source,
  case when source = 'src1' then 'procedure' when source like 'src1%' then 'descriptive' when source = 'src2' then 'procedure' else 'descriptive' end as mode,
  case when source like 'src1%' then 18 when source = 'src2' then 15 else 20 end as words, source = 'src1' as semicolons,
  case when source = 'src1' then 'error' when source like 'src1%' then 'off' else 'warn' end as passive from documents)"""


def pieces(text: str, pattern: str) -> str:
    """Text cut before each match of a pattern, which ends with chr(2), as a list; the first has no match."""
    return f"string_split(regexp_replace({text}, '({pattern})', chr(1) || '\\1' || chr(2), 'g'), chr(1))"


def placed(source: str, columns: str, text: str, pattern: str) -> str:
    """Matches of a pattern with their places: the columns, start, stop, and the text after in its piece."""
    cut = pieces(text, pattern)
    return f"""select {columns}, i, value, rest, (stop_all - length(value) - length(rest))::int as start, (stop_all - length(rest))::int as stop from (
      select {columns}, i, split_part(p, chr(2), 1) as value, split_part(p, chr(2), 2) as rest, sum(length(replace(p, chr(2), ''))) over (partition by file, seg_ord{", k" if "k," in columns else ""} order by i) as stop_all
      from (select {columns}, unnest({cut}) as p, generate_subscripts({cut}, 1) as i from {source})) where i > 1"""


#: Where the lines of a segment begin in its text, and code spans.
PLACES = rf"""{SENTENCES}, {SETTINGS},
off as (select file, line_no, min(line_no) over (partition by file, island) as line, sum(case when piece <> '' then length(piece) + 1 else 0 end) over (partition by file, island order by line_no) - case when piece <> '' then length(piece) + 1 else 0 end as begins
  from l5 where k in ('X', 'L', 'N')),
lineoff as (select file, line::int as line, line_no::int as line_no, begins from off union all select distinct file, line, line, 0 from seg where role in ('TableRow', 'Heading')),
code as ({placed("seg", "file, seg_ord", "text", "`[^`]*`")})"""

#: Sentences with their places, those in parentheses too.
SPOTS_ONLY = rf"""
ip as ({placed("(select file, seg_ord, line, role, i as k, start_offset, s from p3)", "k, file, seg_ord, line, role, start_offset", "s", "[(][^()]*[)]")}),
spot as (select file, seg_ord, line, role, s as text, start_offset as begins from p3
  union all select file, seg_ord, line, role, t, (start_offset + start + 1 + length(raw) - length(regexp_replace(raw, '^{S}+', '')))::int from (select *, value[2:-2] as raw, {trim("value[2:-2]")} as t from ip)
  where length(t) >= 2 and regexp_matches(t, '^\p{{Lu}}') and regexp_matches(t, '[.!?]$')),
sp as (select *, {count_words("text")}::int as word_count from spot)"""


def at_line(row: str, begins: str) -> str:
    return f"(select max(l.line_no) from lineoff l where l.file = {row}.file and l.line = {row}.line and l.begins <= {row}.{begins})"


def outside(row: str) -> str:
    return f"not exists (select 1 from code c where c.file = {row}.file and c.seg_ord = {row}.seg_ord and {row}.start >= c.start and {row}.stop <= c.stop)"


#: Findings on words outside code, with their places: the first semicolon, contractions, -ing forms.
SEMI = f"select file, seg_ord, line, min(start) as begins from ({placed('seg', 'file, seg_ord, line', 'text', '`[^`]*`|;')}) where value = ';' group by file, seg_ord, line"
CONTR = rf"""select file, seg_ord, line, start as begins, text[start + 1:stop] as m from ({placed("seg", "file, seg_ord, line, text", plain("text"), "`[^`]*`|" + CONTRACTION)}) where value not like '`%'
  and (lower(value) not like '%''s' or lower(split_part(value, '''', 1)) in ({IS_WORDS}))"""
ING = rf"""select file, seg_ord, line, start as begins, text[start + 1:stop] as m from ({placed("seg", "file, seg_ord, line, text", plain("text"), r"`[^`]*`|(?i)\b[a-z][a-z-]{2,}ing\b")}) where value not like '`%'
  and not (start > 0 and text[start] = '.') and coalesce(text[stop + 1], '') <> '.'"""
SEMI_TEXT = "'Semicolons are not permitted in ASD-STE100 prose.' as message, 'Split into two separate sentences.' as suggestion"
ING_TEXT = """'The ''-ing'' form ''' || m || ''' may need review — ASD-STE100 restricts ''-ing'' forms to technical nouns/adjectives, not verb forms.' as message,
  'Confirm this is a technical noun or adjective, not a present-participle verb; otherwise rewrite using a simple tense verb.' as suggestion"""


def listed(*words: tuple) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for group in words for w in group) + ")"


def normal(token: str) -> str:
    head = f"regexp_replace({token}, '^[^{W}]+', '')"
    return f"lower(case when lower({token}) like '%''s' then {head} else regexp_replace({head}, '[^{W}]+$', '') end)"


DETERMINERS = pos.ARTICLES + pos.POSSESSIVES + pos.QUANTIFIERS + pos.PREPOSITIONS
FINITE = pos.MODALS + pos.BE + pos.FINITE


def words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{S}+'), lambda x: x <> '')"



#: Matches of terms with places, the words around them, and the guess.
GUESSES = rf"""{PLACES},
t2 as ({placed("seg", "file, seg_ord, line, role, text", "text", f"[{W}-]+")}),
tk as (select file, seg_ord, line, role, text, i, lower(value) as w, start, stop, regexp_matches(rest, '^{S}+$') as open from t2),
term as (select t as term, string_split(t, ' ') as ws from (values {TERMS}) v(t)),
h0 as (select a.file, a.seg_ord, a.line, a.text, term, a.start, case len(ws) when 1 then a.stop when 2 then b.stop when 3 then c.stop else d.stop end as stop from tk a join term on a.w = ws[1]
  left join tk b on b.file = a.file and b.seg_ord = a.seg_ord and b.i = a.i + 1
  left join tk c on c.file = a.file and c.seg_ord = a.seg_ord and c.i = a.i + 2
  left join tk d on d.file = a.file and d.seg_ord = a.seg_ord and d.i = a.i + 3
  where (len(ws) < 2 or a.open and b.w = ws[2]) and (len(ws) < 3 or b.open and c.w = ws[3]) and (len(ws) < 4 or c.open and d.w = ws[4])),
h1 as (select *, text[start + 1:stop] as m, text[1:start] as lead, {words("text[1:start]")} as before, {words("text[stop + 1:]")} as after from h0 where {outside("h0")}),
fin as (select file, seg_ord, len(list_filter(list_transform({words("text")}, lambda x: {normal("x")}), lambda x: x in {listed(FINITE)})) > 0 as finite from seg),
h2 as (select h1.*, finite, mode, source, lower(m) as low, {normal("before[-1]")} as prev, {normal("after[1]")} as nxt,
  list_transform(list_reverse(before[-3:]), lambda x: {{'raw': x, 'w': {normal("x")}}}) as near from h1 join fin using (file, seg_ord) join conf using (file)),
h3 as (select *, list_transform(near, lambda x: case when x.w in {listed(DETERMINERS)} or x.w like '%''s' then 'd'
    when x.w <> '' and x.w not in {listed(pos.CLAUSE_BREAKS, pos.MODALS, pos.BE, ("to",))} and (x.w like '%ing' or x.w like '%ed' or x.w in {listed(pos.ADJECTIVES)} or regexp_matches(x.raw, '^\p{{Lu}}')) then 'm' else 'o' end) as kinds from h2),
h4 as (select *, case when kinds[1] = 'd' then near[1].w when kinds[1] = 'm' and kinds[2] = 'd' then near[2].w when kinds[1] = 'm' and kinds[2] = 'm' and kinds[3] = 'd' then near[3].w end as gov,
  mode = 'procedure' and (start = 0 or regexp_matches(lead, '[.!?:]{S}+$')) as imperative,
  coalesce(prev = 'to', false) or coalesce(prev in {listed(pos.MODALS)}, false) or coalesce(prev in {listed(pos.BE)} and low like '%ing', false) or low like '%ed' or low like '%ing'
    or coalesce(nxt in {listed(pos.ARTICLES)}, false) or coalesce(regexp_matches(regexp_replace(nxt, '^[+-]+|[+-]+$', '', 'g'), '^[\p{{Nd}}.]+$'), false) as verb,
  coalesce(regexp_matches(nxt, '^\p{{L}}+$') and nxt not in {listed(DETERMINERS, pos.CLAUSE_BREAKS, FINITE, pos.NO_COMPOUND)} and not regexp_matches(nxt, '(ing|ed|ly|s)$'), false) as compound from h3),
h5 as (select *, coalesce(prev in {listed(DETERMINERS)}, false) or coalesce(prev like '%''s', false) or coalesce(gov in {listed(DETERMINERS)}, false) or (m like '%s' and m not like '%ss') or coalesce(nxt = 'of', false)
  or coalesce(nxt in {listed(FINITE)}, false) or (compound and not verb) or (not verb and not finite) as noun from h4),
guess as (select *, case when (imperative or verb) and not noun then 'verb' when noun and not (imperative or verb) then 'noun' end as pos from h5),
sense as (select * from (values ('utilize', 1, 'verb', ['use']), ('impact', 1, 'noun', ['effect']), ('impact', 2, 'verb', ['affect']), ('prior to', 1, 'any', ['before']), ('in the event of', 1, 'any', ['if']),
  ('event', 1, 'noun', ['case']), ('a lot of', 1, 'any', ['much', 'many']), ('shall', 1, 'verb', ['must']), ('test', 1, 'verb', ['TEST']), ('the', 1, 'any', []), ('opened', 1, 'verb', ['open']), ('opened', 2, 'adjective', ['open'])) v(term, k, part, alternatives)),
entry as (select term, list({{'part': part, 'alternatives': alternatives}} order by k) as senses, bool_or(list_contains(list_transform(alternatives, lambda x: lower(x)), term)) as self_ref from sense group by term),
sel as (select g.*, senses, self_ref, case when pos is null then senses else list_filter(senses, lambda x: x.part = pos or x.part = 'any') end as remaining from guess g join entry using (term)),
said as (select *, not (pos is not null and len(remaining) = 0) and not (pos is null and len(senses) = 1 and self_ref) as reported from sel)"""

_USE = "array_to_string(list_transform({0}, lambda a: '''' || a || ''''), ' or ')"
_PART = "case when {0} = 'any' then 'general' else {0} end"

#: Findings of terms that are not allowed, with their messages.
TOLD = rf"""{GUESSES},
phrase as ({placed("seg", "file, seg_ord", "text", f"(?i)fuel{S}+mix|in{S}+the{S}+event{S}+of")}),
ok as (select * from said where reported and not (term = 'shall' and source like 'src1%')
  and not exists (select 1 from phrase p where p.file = said.file and p.seg_ord = said.seg_ord and (said.source like 'src1%' or lower(p.value) like 'fuel%') and said.start >= p.start and said.stop <= p.stop)),
told as (select file, seg_ord, start, length(term) as size, {at_line("ok", "start")} as line, case when len(remaining) = 1 then
    'Avoid ''' || m || '''; ' || case when len(remaining[1].alternatives) > 0 then 'use ' || {_USE.format("remaining[1].alternatives")} || ' instead' else 'it is not an approved ASD-STE100-style term' end
      || case when len(senses) > 1 then ' (used as a ' || {_PART.format("remaining[1].part")} || ')' else '' end || '.'
    else 'Ambiguous part of speech for ''' || m || ''' — possible corrections: ' || array_to_string(list_transform(remaining, lambda x: 'as a ' || {_PART.format("x.part")} || ', use ' || {_USE.format("x.alternatives")}), '; ') || '.' end as message,
  case when len(remaining) = 1 then case when len(remaining[1].alternatives) > 0 then array_to_string(remaining[1].alternatives, ', ') end
    else array_to_string(list_transform(remaining, lambda x: array_to_string(x.alternatives, ', ') || ' (' || {_PART.format("x.part")} || ')'), '; ') end as suggestion from ok)"""

#: All findings as rows of the report.
LINT = rf"""{TOLD}, {SPOTS_ONLY},
semis as ({SEMI}), contr as ({CONTR}), ingf as ({ING}),
lint as (
  select file, {at_line("s", "begins")} as line, 'STE100-4.1' as rule_code, 'error' as severity, 'Sentence has ' || word_count || ' words, exceeding the ' || most || '-word limit for ' || mode || ' mode: "' || {SHORT.format("text")} || '"' as message, 'Split into shorter sentences.' as suggestion, 1 as pass, seg_ord, 1 as rank, begins
    from (select *, case when mode = 'procedure' then words else 25 end as most from sp join conf using (file)) s where word_count > most
  union all select file, {at_line("s", "begins")}, 'STE100-8.1', 'error', {SEMI_TEXT.replace(" as message", "").replace(" as suggestion", "")}, 1, seg_ord, 2, begins from semis s join conf using (file) where not semicolons
  union all select file, {at_line("s", "begins")}, 'STE100-4.2', 'error', 'Contraction ''' || m || ''' is not permitted in ASD-STE100 prose.', 'Write the words in full.', 1, seg_ord, 3, begins from contr s
  union all select file, {at_line("s", "begins")}, 'STE100-ADV-COMPLEXVERB', 'warn', 'Possible complex verb construction (perfect/modal-perfect tense) — ASD-STE100 prefers simple present, past, or future tense verbs: "' || {SHORT.format("text")} || '"', 'Rewrite using a simple tense verb.', 1, seg_ord, 4, begins from sp s where regexp_matches({MASKED}, '{COMPLEX}')
  union all select file, {at_line("s", "begins")}, 'STE100-ADV-PASSIVE', passive, 'Possible passive voice (advisory heuristic, not an official STE100 rule): "' || {SHORT.format("text")} || '"', 'Consider rewriting in active voice.', 1, seg_ord, 5, begins from sp s join conf using (file) where passive <> 'off' and {PASSIVE}
  union all select file, {at_line("s", "begins")}, 'STE100-ADV-INGFORM', 'warn', {ING_TEXT.replace(" as message", "").replace(" as suggestion", "")}, 1, seg_ord, 6, begins from ingf s
  union all select file, line, 'STE100-ADV-PARA', 'warn', 'Paragraph has ' || n || ' sentences, exceeding the advisory limit of 6 (not an official STE100 rule).', 'Split into shorter paragraphs.', 1, seg_ord, 7, 0 from (select file, seg_ord, line, count(*) as n from sp where role = 'Paragraph' group by file, seg_ord, line) where n > 6
  union all select file, line, 'STE100-DICT', 'error', message, suggestion, 2, seg_ord, -size, start from told)"""


#: Words of three tables as the layers of a dictionary, the last of which counts.
LAYERED = """words as (select 1 as layer, lower(text) as text from benchmark union all select 2, lower(text) from conversations union all select 3, lower(text) from documents),
counted as (select layer, w, count(*) as n from (select layer, unnest(regexp_extract_all(text, '[a-z]{5,}')) as w from words) group by layer, w),
layered as (select case layer when 1 then w when 2 then upper(w[1]) || w[2:] else upper(w) end as term, case layer when 1 then 'any' when 2 then 'noun' else 'verb' end as pos, n
from counted where n >= case layer when 1 then 1 when 2 then 3 else 20 end and w not in ('there', 'which') qualify row_number() over (partition by w order by layer desc) = 1)"""

ORACLES = {
    "lines": f"with {LINES} select file, line_no::int as line_no, raw from l0",
    "fence_filter": f"with {LINES} select file, line_no::int as line_no, raw from l2 where not fence and n_fences % 2 = 0",
    "link_rewrite": f"with {LINES} select file, line_no::int as line_no, c as cleaned from l1 where c <> raw",
    "line_kinds": f"with {LINES} select k as kind, count(*) as n from l3 where k <> 'I' group by k",
    "headings": f"with {SEGMENTS} select file, line, text from seg where role = 'Heading'",
    "list_items": f"with {SEGMENTS} select file, seg_ord, line, text from seg where role = 'ListItem'",
    "table_cells": f"with {SEGMENTS} select file, seg_ord, line, text from seg where role = 'TableRow'",
    "paragraph_fold_lines": f"with {SEGMENTS} select file, seg_ord, line, text, n_lines from seg where role = 'Paragraph'",
    "paragraph_fold": f"with {SEGMENTS} select file, seg_ord, line, text, n_lines from seg where role = 'Paragraph'",
    "code_spans": rf"with {SEGMENTS} select file, seg_ord, unnest(regexp_extract_all(text, '`[^`]*`')) as code from seg",
    "resolve_line": f"""with {SEGMENTS} select file, seg_ord, line::int as line, (line + n_lines - 1)::int as last_line from seg where role = 'Paragraph'""",
    "sentence_split": f"with {SENTENCES} select file, seg_ord, i::int as ord, s as text, start_offset from p3",
    "parenthetical_sentences": f"with {SENTENCES} select file, seg_ord, i::int as ord, text from sent where j > 0",
    "word_count": f"with {SENTENCES} select file, seg_ord, text, word_count from sc",
    "rule_word_limit": f"""with {SENTENCES} select file, seg_ord, 'Sentence has ' || word_count || ' words, exceeding the 25-word limit for descriptive mode: "' || {SHORT.format("text")} || '"' as message from sc where word_count > 25""",
    "rule_semicolon": f"with {PLACES}, s as ({SEMI}) select file, seg_ord, {at_line('s', 'begins')} as line, begins as \"offset\", {SEMI_TEXT} from s",
    "rule_contraction": f"with {SEGMENTS}, h as ({hits(CONTRACTION)}) select file, seg_ord, m as match from h where lower(m) not like '%''s' or lower(split_part(m, '''', 1)) in ({IS_WORDS})",
    "rule_passive": f"with {SENTENCES} select file, seg_ord, {SHORT.format('text')} as sentence from sc where {PASSIVE}",
    "rule_complex_verb": f"with {SENTENCES} select file, seg_ord, {SHORT.format('text')} as sentence from sc where regexp_matches({MASKED}, '{COMPLEX}')",
    "rule_ing_form": f"with {PLACES}, s as ({ING}) select file, seg_ord, {at_line('s', 'begins')} as line, begins as \"offset\", {ING_TEXT} from s",
    "rule_paragraph_length": f"""with {SENTENCES} select file, seg_ord, line, 'Paragraph has ' || n || ' sentences, exceeding the advisory limit of 6 (not an official STE100 rule).' as message
        from (select file, seg_ord, line, count(*) as n from sc where role = 'Paragraph' group by file, seg_ord, line) where n > 6""",
    "dict_merge": f"with {LAYERED} select term, pos, n::varchar as alternatives from layered",
    "dict_match": f"with {MATCHES} select file, seg_ord, term, count(*) as n from hit group by file, seg_ord, term",
    "dict_match_large": rf"""with {TOKENS},
        entry as (select term, string_split(term, ' ') as ws from (select distinct unnest(regexp_extract_all(lower(text), '[a-z]{{5,}}')) as term from benchmark union select distinct unnest(regexp_extract_all(lower(text), '[a-z]{{5,}} [a-z]{{5,}}')) from benchmark))
        select term, count(*) as n from tok a join entry on a.w = ws[1] left join tok b on b.file = a.file and b.seg_ord = a.seg_ord and b.i = a.i + 1
        where len(ws) < 2 or ws[1] <> ws[2] and a.open and b.w = ws[2] group by term""",
    "dict_file_allow": f"with {MATCHES} select term, count(*) as n from hit where not (term = 'shall' and (file like 'src1/%' or file like 'src2/%')) and term <> 'the' group by term",
    "dict_phrase_allow": f"""with {GUESSES}, phrase as ({placed("seg", "file, seg_ord", "text", f"(?i)the{S}+event{S}+of|utilize{S}+a{S}+lot{S}+of{S}+heat")})
        select term, count(*) as n from h1 join conf using (file) where term in ('event', 'in the event of', 'a lot of') and not (source like 'src1%'
        and exists (select 1 from phrase p where p.file = h1.file and p.seg_ord = h1.seg_ord and h1.start >= p.start and h1.stop <= p.stop)) group by term""",
    "pos_guess": f"with {GUESSES} select file, seg_ord, start, term, coalesce(pos, '?') as pos from guess",
    "sense_select": f"with {GUESSES} select file, seg_ord, start, term, len(remaining)::int as n_left, reported from said",
    "dict_message": f"with {TOLD} select file, line, message, suggestion from told",
    "full_lint": f'with {LINT} select file, line, null::int as "column", rule_code, severity, message, suggestion from lint',
    "report_json": f"""with {LINT}
        select '{{"filesChecked":' || (select count(distinct file) from md) || ',"errorCount":' || (select count(*) from lint where severity = 'error') || ',"warningCount":' || (select count(*) from lint where severity = 'warn') || '}}' as report
        union all select '{{"file":' || to_json(file) || ',"line":' || line || ',"column":null,"ruleCode":' || to_json(rule_code) || ',"severity":' || to_json(severity) || ',"message":' || to_json(message) || ',"suggestion":' || coalesce(to_json(suggestion)::varchar, 'null') || '}}' from lint""",
    "finding_order": f"with {LINT} select file, (row_number() over (partition by file order by pass, seg_ord, rank, begins))::int as place, rule_code, message from lint",
    "dict_lookup": f"""with {LAYERED}, asked as (select distinct unnest(regexp_extract_all(text, '[A-Za-z]{{5,}}')) as asked from conversations)
        select asked, pos, n::varchar as alternatives from asked join layered on lower(asked) = lower(term)""",
    "profile_mode": """select source || '/' || doc_id || '.md' as file, case when source = 'src1' then 'procedure' when source like 'src1%' then 'descriptive' when source = 'src2' then 'procedure' else 'descriptive' end as mode from documents""",
    "profile_rules": """select source || '/' || doc_id || '.md' as file, case when source like 'src1%' then 18 when source = 'src2' then 15 else 20 end::int as max_words_procedure,
        25::int as max_words_descriptive, source in ('src1') as allow_semicolons, case when source = 'src1' then 'error' when source like 'src1%' then 'off' else 'warn' end as passive_voice from documents""",
    "profile_terms": """select source || '/' || doc_id || '.md' as file, case when source = 'src1' then 'api,shall,must' when source like 'src1%' then 'api,shall' else 'api' end as terms from documents""",
    "profile_phrases": """select source || '/' || doc_id || '.md' as file, case when source like 'src1%' then 'fuel mix,in the event of' else 'fuel mix' end as phrases from documents""",
    "summary_counts": f"with {RULE_ROWS} select rule_code, severity, count(*) as findings, count(distinct file) as files from found group by rule_code, severity",
    "summary_by_file": f"""with {RULE_ROWS} select d.file, count(*) filter (where severity = 'error') as errors, count(*) filter (where severity = 'warn') as warnings
        from (select distinct file from md) d left join found using (file) group by d.file""",
    "gate_exit": f"with {RULE_ROWS} select strict, bool_or(severity = 'error' or strict and severity = 'warn') as failed from found, (values (true), (false)) v(strict) group by strict",
    "report_text": f"""with {LINT} select file || ':' || line || ': [' || upper(severity) || '] ' || rule_code || ' — ' || message || case when suggestion is null then '' else ' (Suggestion: ' || suggestion || ')' end as report from lint""",
    "label_summary": f"""with {RULE_ROWS}, f as (select file, count(*) as n from found group by file)
        select l.quality, l.toxic, count(*) as documents, sum(coalesce(f.n, 0))::bigint as findings from labels l join documents d using (doc_id) left join f on f.file = d.source || '/' || d.doc_id || '.md' group by l.quality, l.toxic""",
}
