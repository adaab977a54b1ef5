"""DuckDB oracle SQL for the registered queries.

Independent SQL formulations of each operator over the same parquet views
(``region nation ... conversations``).  The derived views of FIXTURES.md are
inlined as CTEs.  Column names equal the Spark query's.
"""

from __future__ import annotations

from revlens.functions import constants as K
from revlens.operators.review import RULES

BUDGET = 3100
WIDTH = max(1000, 3 * BUDGET)
DELAY = 37.26
SPLIT_WIDTH = 4500
CONTEXT = 131072
LB = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(_q(v) for v in values) + "]"


def _in(values) -> str:
    return "(" + ", ".join(_q(v) for v in values) + ")"


def part_loc(x: str) -> str:
    return (f"greatest(1, len(regexp_extract_all({x}, {_q(LB)})) + "
            f"case when regexp_matches({x}, {_q('(' + LB + r')\z')}) or length({x}) = 0 then 0 else 1 end)::bigint")


def tokens(x: str) -> str:
    return f"greatest(1, round(length({x}) / 3.5::double)::bigint)"


def human(x: str) -> str:
    units = ["B", "KB", "MB", "GB", "TB"]
    parts = []
    for i, u in enumerate(units[:-1]):
        parts.append(f"when {x}::double / {float(1024 ** i)} < 1024 then "
                     f"printf('%.2f %s', round_even({x}::double / {float(1024 ** i)}, 2), '{u}')")
    return ("case " + " ".join(parts) +
            f" else printf('%.2f %s', round_even({x}::double / {float(1024 ** 4)}, 2), 'TB') end")


# ---------------------------------------------------------------- views
FILES_V = r"""files_v as (
select source as project, concat(case when doc_id % 23 = 0 then 'node_modules/' when doc_id % 29 = 0 then '.cache/' else 'src/' end, 'Doc_', cast(doc_id as string), case when doc_id % 31 = 0 then '.bin' when lang = 'en' then '.py' when lang = 'fr' then '.js' when lang = 'de' then '.HTML' else '.sql' end) as relative, text from documents
union all select concat('site', cast(page_id % 5 as string)) as project, concat('html/p', cast(page_id as string), '.html') as relative, html as text from pages)"""

RESPONSES_V = r"""responses_v as (
select source as project, doc_id as chunk_id, case doc_id % 6 when 0 then j when 1 then concat('```json', chr(10), j, chr(10), '```') when 2 then concat('Here is the review: ', j, ' Done.') when 3 then '' when 4 then 'no issues found' else j end as raw, n_chars as prompt_tokens, n_chars % 400 as completion_tokens
from (select source, doc_id, n_chars, concat('{"summary":"doc ', cast(doc_id as string), '","findings":[', f, case when doc_id % 4 = 0 then concat(',', f) else '' end, '],"positive_points":["lang ', lang, '"],"recommendations":["split long lines"]}') as j
from (select source, doc_id, n_chars, lang, concat('{"category":"Quality","severity":"', case doc_id % 7 when 0 then 'Critical' when 1 then 'High' when 2 then 'Medium' when 3 then 'Low' when 4 then 'Info' else 'high' end, '","file":"src/Doc_', cast(doc_id % 40 as string), '","line":', case when doc_id % 9 = 0 then '"12-15"' else cast(doc_id % 50 as string) end, ',"title":"long line","confidence":"Low"}') as f from documents) a) b)"""

ATTEMPTS_V = r"""attempts_v as (
select event_id, ts, concat('prov', cast(user_id % 4 as string)) as provider, user_id as chunk_id, 1 + event_id % 5 as attempt, case event_type when 'error' then 429 when 'purchase' then 503 when 'signup' then 400 when 'view' then 200 else null end as status, case event_type when 'signup' then 'maximum context exceeded' when 'click' then 'connection reset' else '' end as detail, case when event_id % 7 = 0 then value else null end as retry_after, cast(floor(value * 100) as bigint) as tokens from events)"""

CATALOG_V = r"""catalog_v as (
select p_partkey as payload_id, case p_partkey % 4 when 0 then 'gemini' when 1 then 'ollama' else 'generic' end as provider, case p_partkey % 4 when 0 then concat('{"models":[{"name":"models/', p_name, '","inputTokenLimit":', cast(p_size * 1000 as string), ',"supportedGenerationMethods":["', case when p_partkey % 8 = 0 then 'embedContent' else 'generateContent' end, '"]}]}') when 1 then concat('{"models":[{"name":"', p_name, '"}]}') when 2 then concat('{"data":[{"id":"', p_name, '","context_window":0,"context_length":', cast(p_size * 1000 as string), ',"active":', case when p_size % 5 = 0 then 'false' else 'true' end, '}]}') else concat('[{"id":"', p_name, '","top_provider":{"context_length":', cast(p_size * 100 as string), '}}]') end as payload from part)"""

SECRETS_V = r"""secrets_v as (
select doc_id, owner, concat('Bearer ', found) as value from (select doc_id, source as owner, unnest(regexp_extract_all(text, 'token = "([0-9a-f]{40})"', 1)) as found from documents))"""

SNAPSHOT_V = r"""snapshot_v as (
select source as project, doc_id, case when doc_id % 7 = 0 then concat(text, chr(10), 'edited') else text end as text from documents where doc_id % 10 <> 3)"""

FILES = FILES_V + f""",
files0 as (select *, regexp_extract(relative, '([^/]*)$', 1) as name,
                 string_split(relative, '/') as parts from files_v),
files as (select project, project || '/' || relative as path, relative, name,
    regexp_extract(name, '^.+(\\.[^.]+)$', 1) as ext,
    strlen(text)::bigint as size,
    (case when length(text) = 0 then 0 else length(text) - length(replace(text, chr(10), '')) + 1 end)::bigint as lines,
    {tokens('text')} as tokens, text,
    list_slice(parts, 1, len(parts) - 1) as dirs
  from files0),
pruned as (select * from files where not list_has_any(dirs, {_list(K.IGNORE_DIRS)})
    and len(list_filter(dirs, lambda x: starts_with(x, '.'))) = 0),
named as (select * from files where (lower(ext) in {_in(K.TEXT_EXTENSIONS)} or name in {_in(K.SPECIAL_FILE_NAMES)})
    and name not in {_in(K.IGNORE_FILES)}),
rv as (select * from pruned where (lower(ext) in {_in(K.TEXT_EXTENSIONS)} or name in {_in(K.SPECIAL_FILE_NAMES)})
    and name not in {_in(K.IGNORE_FILES)})"""

LANG_CASE = ("case lower(ext) " + " ".join(f"when {_q(k)} then {_q(v)}" for k, v in K.EXTENSION_LANGUAGE.items())
             + f" else {_q(K.OTHER_LANGUAGE)} end")

def pack_cte(src: str, p: str = "") -> str:
    """Next-fit walk as a recursive CTE over corpus CTE ``src`` (one row per
    file; state = last chunk id and open tokens).  CTE names get prefix p."""
    return f"""{p}f as (select project, relative, tokens, size, lines, length(text)::bigint as chars, text,
        row_number() over (partition by project order by lower(relative), relative) as rn from {src}),
{p}walk as (
  select project, 0::bigint as rn, 0::bigint as cid, 0::bigint as cur from (select distinct project from {p}f)
  union all
  select f.project, f.rn,
    case when f.tokens > {BUDGET} then w.cid + ceil(f.chars / {WIDTH}.0)::bigint
         when w.cur = 0 or w.cur + f.tokens > {BUDGET} then w.cid + 1 else w.cid end,
    case when f.tokens > {BUDGET} then 0
         when w.cur = 0 or w.cur + f.tokens > {BUDGET} then f.tokens else w.cur + f.tokens end
  from {p}walk w join {p}f f on f.project = w.project and f.rn = w.rn + 1),
{p}placed as (select f.*, w.cid from {p}f f join {p}walk w on f.project = w.project and f.rn = w.rn),
{p}small as (select project, cid as chunk_id, (row_number() over (partition by project, cid order by rn) - 1)::int as pos,
    relative, null::int as part_no, null::int as part_count, size, lines, tokens, chars, text, rn
  from {p}placed where tokens <= {BUDGET}),
{p}big as (select project, relative, text, cid, ceil(chars / {WIDTH}.0)::bigint as pc, rn from {p}placed
  where tokens > {BUDGET}),
{p}bigp as (select project, relative, text, cid, pc, rn, unnest(range(1, pc + 1)) as part_no from {p}big),
{p}parts as (select project, (cid - pc + part_no)::bigint as chunk_id, 0::int as pos,
    relative || ' [part ' || part_no || '/' || pc || ']' as relative, part_no::int as part_no, pc::int as part_count,
    strlen(pt)::bigint as size, {part_loc('pt')} as lines, {tokens('pt')} as tokens, length(pt)::bigint as chars,
    pt as text, rn
  from (select *, substr(text, ((part_no - 1) * {WIDTH} + 1)::bigint, {WIDTH}) as pt from {p}bigp)),
{p}members as (select * from {p}small union all select * from {p}parts),
{p}chunks as (select project, chunk_id, count(*)::bigint as n_files, sum(tokens)::bigint as tokens,
    sha256(string_agg(concat_ws(':', relative, lines::varchar, tokens::varchar, chars::varchar), '|' order by pos))
    as signature from {p}members group by project, chunk_id)"""


PACK = FILES + ",\n" + pack_cte("rv")

PARSED = RESPONSES_V + r""",
c as (select project, chunk_id, raw, prompt_tokens, completion_tokens,
    regexp_replace(regexp_replace(regexp_replace(coalesce(raw, ''), '^\s+|\s+$', '', 'g'),
      '(?i)^```(json)?\s*', '', 'g'), '\s*```$', '', 'g') as cleaned from responses_v),
s as (select *, instr(cleaned, '{') as st, instr(reverse(cleaned), '}') as rb,
        length(cleaned) - instr(reverse(cleaned), '}') + 1 as en from c),
s2 as (select *, case when st >= 1 and rb >= 1 and length(cleaned) - rb + 1 > st
                      then substr(cleaned, st, length(cleaned) - rb + 1 - st + 1) end as sl from s),
p as (select *, case when json_valid(cleaned) and left(ltrim(cleaned), 1) = '{' then cleaned
                     when sl is not null and json_valid(sl) and left(ltrim(sl), 1) = '{' then sl end as j0 from s2),
pe as (select *, case when length(cleaned) = 0 then 'AI provider returned an empty review response.'
        when j0 is null then 'The AI response was not valid JSON. Response preview: ''' || substr(cleaned, 1, 800) || ''''
        when coalesce(json_type(j0, '$.findings'), 'ARRAY') <> 'ARRAY'
          or coalesce(json_type(j0, '$.positive_points'), 'ARRAY') <> 'ARRAY'
          or coalesce(json_type(j0, '$.recommendations'), 'ARRAY') <> 'ARRAY'
        then 'The AI response has a findings / positive_points / recommendations value that is not a list.' end as error
      from p),
parsed as (select *, error is null as ok, case when error is null then j0 end as j from pe),
fx as (select project, chunk_id, j, unnest(range(0, json_array_length(j, '$.findings')::bigint)) as pos
       from parsed where ok and json_type(j, '$.findings') = 'ARRAY'),
fo as (select project, chunk_id, pos::int as pos, json_extract(j, '$.findings[' || pos || ']') as f from fx),
fl as (select * from fo where json_type(f) = 'OBJECT'),
findings as (select project, chunk_id, pos,
""" + ",\n".join(
    (f"  try_cast(json_extract_string(f, '$.{n}') as bigint) as {n}, json_extract_string(f, '$.{n}') as {n}_raw"
     if n in ("line", "line_end") else f"  json_extract_string(f, '$.{n}') as {n}")
    + f",\n  case when json_type(f, '$.{n}') is null then '' when json_type(f, '$.{n}') = 'NULL' then 'None' "
      f"else coalesce(json_extract_string(f, '$.{n}'), '') end as k_{n}"
    for n in ("category", "severity", "file", "line", "line_end", "title", "evidence", "why", "fix", "confidence")) + r""",
  json_type(f, '$.severity') is null as severity_missing
  from fl),
keyed as (select *, sha256(concat_ws('|', k_category, k_severity, k_file, k_line, k_title)) as dedup_key from findings),
uniq as (select * from (select *, row_number() over (partition by project, dedup_key order by chunk_id, pos) as rn
         from keyed) where rn = 1),
ranked as (select *, row_number() over (partition by project order by severity_rank, k_file, line_num, chunk_id, pos)
             as finding_rank
           from (select *, case severity when 'Critical' then 0 when 'High' then 1 when 'Medium' then 2
                   when 'Low' then 3 when 'Info' then 4 else 99 end as severity_rank,
                   coalesce(line, 0) as line_num from uniq))"""

FINDING_COLS = ("chunk_id, pos, category, severity, file, line, line_raw, line_end, title, evidence, why, fix, "
                "confidence, k_category, k_severity, k_file, k_line, k_title")

SEV_COUNTS = (", ".join(f"sum(case when sev = '{s}' then 1 else 0 end)::bigint as {s.lower()}" for s in K.SEVERITIES))

STATUS = """status as (select pr.project,
    case when coalesce(fu.has_critical, 0) = 1 then 'critical' when coalesce(fu.n, 0) > 0 then 'needs_attention'
         when coalesce(fx.n, 0) > 0 then 'review_incomplete' else 'positive' end as overall_status,
    coalesce(fu.n, 0)::bigint as n_findings, coalesce(fx.n, 0)::bigint as n_failed
  from (select distinct project from parsed) pr
  left join (select project, max(case when k_severity = 'Critical' then 1 else 0 end) as has_critical, count(*) as n
             from uniq group by project) fu on fu.project = pr.project
  left join (select project, count(*) as n from parsed where not ok group by project) fx on fx.project = pr.project)"""

RULE_ARRAY = "[" + ", ".join(f"case when regexp_matches(evidence, {_q(r[2])}) then {i} end"
                             for i, r in enumerate(RULES)) + "]"


def _rule_field(k: int) -> str:
    return "[" + ", ".join(_q(r[k]) for r in RULES) + "][rule + 1]"


SQL: dict[str, str] = {}

SQL["a3_corpus_from_table"] = f"with {FILES} select project, path, relative, name, ext, size, lines, tokens from files"
SQL["a1_scan_corpus"] = f"with {FILES} select project, relative, ext, size, lines, tokens, null::varchar as error from rv"
SQL["a2_scan_file"] = (
    f"with {FILES}, fit as (select project, relative, true as fit from named), "
    f"st as (select dirs[-1] as folder, project as above, name as relative, size, lines, tokens, case when fit is null then 'name' "
    f"when length(text) % 5 = 0 then 'missing' else 'read' end as state from files left join fit using (project, relative)) "
    f"select folder, above, relative, case when state = 'read' then size end as size, case when state = 'read' then lines end as lines, "
    f"case when state = 'read' then tokens end as tokens, state from st")
SQL["b1_prune_dirs"] = f"with {FILES} select project, relative from pruned"
SQL["b2_text_names"] = f"with {FILES} select project, relative, name, ext from named"
SQL["b3_binary_sniff"] = (
    "select doc_id, (strlen(coalesce(text, '')) + case doc_id % 5 when 0 then 1 when 1 then 8192 when 2 then 8193 else 0 end)::bigint "
    "as size, doc_id % 5 in (0, 1) as is_binary from documents")
SQL["b4_decode_text"] = (
    "with a as (select doc_id, coalesce(text, '') as t, regexp_replace(coalesce(text, ''), '[^\\x00-\\x7F]', '?', 'g') as ascii "
    "from documents), b as (select doc_id, case doc_id % 5 when 0 then t when 1 then chr(65279) || t when 2 then chr(233) || ascii "
    "when 3 then chr(8364) || chr(8220) || ascii else chr(129) || chr(128) || ascii end as x from a) "
    "select doc_id, length(x)::bigint as chars, sha256(x) as text_sha from b")
SQL["b5_file_loc"] = f"with {FILES} select project, relative, lines as loc from files"
SQL["b6_part_loc"] = f"select doc_id, {part_loc('text')} as part_loc from documents"
SQL["b7_token_estimate"] = f"with {FILES} select project, relative, tokens from files"
SQL["b8_size"] = f"with {FILES} select project, relative, size, {human('size')} as size_h from files"
SQL["b9_safe_name"] = (f"with {FILES} select project, relative, coalesce(nullif(regexp_replace(regexp_replace("
                       f"project || '-' || relative, '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), "
                       f"'project') as safe from files")
SQL["b10_file_order"] = (f"with {FILES} select project, relative, row_number() over (partition by project "
                         f"order by lower(relative), relative)::bigint as file_order from rv")
SQL["c1_project_totals"] = (f"with {FILES} select project, count(*)::bigint as files, sum(size)::bigint as size, "
                            f"sum(lines)::bigint as loc, sum(tokens)::bigint as tokens from rv group by project")
SQL["c2_file_table"] = (f"with {FILES} select project, relative, lines as loc, tokens, size, {human('size')} as size_h, "
                        f"coalesce(nullif(ext, ''), '[no extension]') as type from rv")
SQL["c3_language_breakdown"] = (
    f"with {FILES}, l as (select project, {LANG_CASE} as language, size, lines, tokens from rv) "
    f"select project, language, case grouping(project, language) when 0 then 'language' when 1 then 'project' "
    f"else 'total' end as level, count(*)::bigint as files, sum(size)::bigint as size, sum(lines)::bigint as loc, "
    f"sum(tokens)::bigint as tokens from l group by rollup (project, language)")
_KNOWN_MODELS = "(values " + ", ".join(f"({i}, {_q(k)}, {v}::bigint)" for i, (k, v) in enumerate(K.MODEL_CONTEXTS.items())) + ") as km(i, model, context)"
SQL["c4_context_fit"] = (
    f"with {FILES}, t as (select project, sum(tokens)::bigint as tokens from rv group by project) "
    f"select project, model, context, tokens, tokens <= context as fits, tokens <= greatest(1500, least(100000, trunc(context * 0.5)::bigint)) "
    f"as fits_budget, case when tokens <= context then row_number() over (partition by project, tokens <= context order by context, model) "
    f"else 0 end::int as rank from t cross join {_KNOWN_MODELS}")
_META = "concat_ws(':', relative, size::varchar, lines::varchar, tokens::varchar)"


def _tree(src: str, payloads: dict[str, str]) -> str:
    """Hash tree of four levels over blocks of 4,096 payloads in file order."""
    q = (f"select project, row_number() over (partition by project order by lower(relative), relative) - 1 as o0, "
         + ", ".join(f"{e} as {n}" for n, e in payloads.items()) + f" from {src}")
    for k in range(4):
        by = "project" if k == 3 else f"project, o{k} // 4096"
        head = "project" if k == 3 else f"project, o{k} // 4096 as o{k + 1}"
        q = (f"select {head}, " + ", ".join(f"sha256(string_agg({n}, '|' order by o{k})) as {n}" for n in payloads)
             + f" from ({q}) group by {by}")
    return q


SQL["c5_codebase_signature"] = (
    f"with {FILES} " + _tree("rv", {"signature": _META, "content_sha256": "sha256(text)"}))
SQL["c6_chunk_signature"] = (
    f"with recursive {PACK} select project, chunk_id, count(*)::bigint as n_files, sum(tokens)::bigint as tokens, "
    f"sha256(string_agg(concat_ws(':', relative, lines::varchar, tokens::varchar, chars::varchar), '|' order by pos))"
    f" as signature from members group by project, chunk_id")
SQL["d1_hard_split"] = (
    f"with x as (select doc_id, text, ceil(length(text) / {SPLIT_WIDTH}.0)::int as pc from documents "
    f"where length(text) > 0), y as (select doc_id, text, pc, unnest(range(1, pc + 1)) as part_no from x) "
    f"select doc_id, part_no::int as part_no, pc as part_count, "
    f"length(substr(text, ((part_no - 1) * {SPLIT_WIDTH} + 1)::bigint, {SPLIT_WIDTH}))::bigint as chars, "
    f"sha256(substr(text, ((part_no - 1) * {SPLIT_WIDTH} + 1)::bigint, {SPLIT_WIDTH})) as part_sha from y")
SQL["d3_pack_chunks"] = (f"with recursive {PACK} select project, chunk_id, pos, relative, part_no, part_count, size, lines, "
                         f"tokens from members")
SQL["d4_part_meta"] = f"with recursive {PACK} select project, relative, part_no, part_count, size, lines, tokens from parts"
SQL["d6_prompts"] = (
    f"with recursive {PACK}, n as (select project, max(chunk_id) as n_chunks from members group by project), "
    f"b as (select project, chunk_id, string_agg(chr(10) || '===== FILE: ' || relative || ' | LOC: ' || lines || "
    f"' =====' || chr(10) || text || chr(10) || '===== END FILE =====', chr(10) order by pos) as body "
    f"from members group by project, chunk_id), "
    f"pr as (select b.project, b.chunk_id, 'Project: ' || b.project || chr(10) || 'Review chunk: ' || b.chunk_id || "
    f"'/' || n.n_chunks || chr(10) || chr(10) || 'Paths are relative to the project root.' || chr(10) || "
    f"'Review the following source files:' || chr(10) || body as prompt from b join n using (project)) "
    f"select project, chunk_id, n_files, tokens, signature, length(prompt)::bigint as prompt_chars, sha256(prompt) as prompt_sha "
    f"from pr join chunks using (project, chunk_id)")
SQL["d8_rate_policy"] = (
    f"with {ATTEMPTS_V}, m as (select provider, sum(tokens) as tok from attempts_v "
    f"group by provider, date_trunc('minute', ts)), t as (select provider, max(tok)::bigint as tpm from m "
    f"group by provider), b as (select provider, tpm, greatest(1500, least(100000, ({CONTEXT} * 0.5)::bigint)) as cb, "
    f"greatest(1200, trunc(tpm * 0.5)::bigint - 900) as rb from t), "
    f"c as (select *, greatest(1200, least(cb, rb)) as budget from b) "
    f"select provider, tpm, 'live_headers' as policy_source, budget::bigint as budget, "
    f"round(least(65.0, greatest(0.0, 60.0 * (budget + 1500) / greatest(tpm, 1) * 1.08)), 6) as delay from c")
_PEAK = ("m as (select provider, sum(tokens) as tok from attempts_v group by provider, date_trunc('minute', ts)), "
         "peak as (select provider, max(tok)::bigint as tpm from m group by provider)")
SQL["d9_chunk_plan"] = (
    f"with recursive {FILES}, {ATTEMPTS_V}, {_PEAK}, "
    f"pol0 as (select model, tpm, greatest(1500, least(100000, trunc(context * 0.5)::bigint)) as cb, greatest(1200, trunc(tpm * 0.5)::bigint - 900) "
    f"as rb from {_KNOWN_MODELS} left join peak on i % 2 = 0 and provider = 'prov' || (i % 4)), "
    f"pol1 as (select model, tpm, case when tpm is null then cb else greatest(1200, least(cb, rb)) end::bigint as budget from pol0), "
    f"pol as (select *, case when tpm is null then 0.0 else least(65.0, greatest(0.0, 60.0 * (budget + 1500) / greatest(tpm, 1) * 1.08)) end::double "
    f"as delay from pol1), bs as (select distinct budget from pol), "
    f"f as (select project, tokens, length(text)::bigint as chars, row_number() over (partition by project order by lower(relative), relative) as rn "
    f"from rv), "
    f"walk as (select project, budget, 0::bigint as rn, 0::bigint as cid, 0::bigint as cur from (select distinct project from f) cross join bs "
    f"union all select w.project, w.budget, f.rn, case when f.tokens > budget then w.cid + ceil(f.chars / greatest(1000, 3 * budget)::double)::bigint "
    f"when cur = 0 or cur + f.tokens > budget then cid + 1 else cid end, case when f.tokens > budget then 0 "
    f"when cur = 0 or cur + f.tokens > budget then f.tokens else cur + f.tokens end from walk w join f on f.project = w.project and f.rn = w.rn + 1), "
    f"n as (select project, budget, max(cid)::bigint as chunks from walk group by project, budget), "
    f"t as (select project, count(*)::bigint as files, sum(tokens)::bigint as tokens from rv group by project) "
    f"select t.project, model, files, t.tokens, chunks, n.budget, round(t.tokens / (chunks * n.budget)::double, 6) as fill_rate, "
    f"round(greatest(chunks - 1, 0) * delay, 6) as min_wall_sec from t join n using (project) join pol on pol.budget = n.budget")
SQL["e1_rule_findings"] = (
    f"with {FILES}, l as (select project, relative as file, unnest(string_split(text, chr(10))) as evidence, "
    f"unnest(range(1, len(string_split(text, chr(10))) + 1)) as line from rv), "
    f"h as (select project, file, line::bigint as line, evidence, unnest(list_filter({RULE_ARRAY}, lambda x: x is not null))"
    f" as rule from l) select project, file, line, rule::int as rule, {_rule_field(0)} as category, "
    f"{_rule_field(1)} as severity, {_rule_field(3)} as title, sha256(evidence) as evidence_sha from h")
SQL["e2_strip_fences"] = f"with {PARSED} select project, chunk_id, cleaned from c"
SQL["e3_parse_json"] = (f"with {PARSED} select project, chunk_id, j is not null as parsed, "
                        f"json_extract_string(j, '$.summary') as summary from parsed")
# which of the odd replies Python reads: of the base reply's kinds 0, 1, 2 and 5 hold an object; text behind it spoils it if it brings a brace
SQL["e3_parse_strict"] = (
    f"with {RESPONSES_V}, k as (select project, chunk_id, chunk_id % 6 as b, chunk_id % 13 as m, raw from responses_v), "
    f"a as (select *, case when b in (0, 1, 2, 5) then m not in (1, 2, 5, 6, 8) when m = 1 or m = 5 then true else false end as parsed from k) "
    f"select project, chunk_id, parsed, case when parsed and b not in (3, 4) then 'doc ' || chunk_id end as summary, "
    f"case when parsed and b not in (3, 4) then case when m = 3 then 'nan' else 'Low' end end as confidence from a")
SQL["e4_reply_errors"] = f"with {PARSED} select project, chunk_id, error from parsed where not ok"
SQL["e5_findings"] = f"with {PARSED} select project, {FINDING_COLS} from findings"
SQL["e6_summaries"] = (
    f"with {PARSED}, sx as (select project, chunk_id, json_extract_string(j, '$.summary') as summary from parsed "
    f"where ok) select project, chunk_id, summary, row_number() over (partition by project order by chunk_id)::bigint "
    f"as summary_rank from sx where summary is not null and summary <> ''")
SQL["e7_usage_totals"] = (
    f"with {PARSED}, u as (select project, 'prompt_tokens' as key, prompt_tokens::double as value from parsed where ok "
    f"union all select project, 'completion_tokens', completion_tokens::double from parsed where ok) "
    f"select project, key, sum(trunc(value)::bigint)::bigint as total from u where value is not null "
    f"group by project, key")
SQL["e8_point_lists"] = (
    f"with {PARSED}, x as (select project, 'positive_points' as field, "
    f"unnest(json_extract(j, '$.positive_points[*]')) as e from parsed where ok "
    f"union all select project, 'recommendations', unnest(json_extract(j, '$.recommendations[*]')) from parsed "
    f"where ok), y as (select distinct project, field, case when json_type(e) = 'NULL' then 'None' "
    f"else coalesce(json_extract_string(e, '$'), '') end as item from x) "
    f"select project, field, item, row_number() over (partition by project, field order by item)::bigint "
    f"as item_rank from y")
SQL["e9_bad_replies"] = (f"with {PARSED} select project, count(*)::bigint as n_failed, min(chunk_id) as first_failed,"
                           f" max(chunk_id) as last_failed from parsed where not ok group by project")
SQL["e10_dedup"] = f"with {PARSED} select project, dedup_key, {FINDING_COLS} from uniq"
SQL["e11_rank"] = (f"with {PARSED} select project, finding_rank::bigint as finding_rank, severity_rank, k_file, "
                   f"line_num, chunk_id, pos from ranked")
SQL["e12_status"] = f"with {PARSED}, {STATUS} select * from status"
SQL["e13_severity_counts"] = (
    f"with {PARSED}, x as (select project, case when severity_missing then 'Info' else k_severity end as sev "
    f"from uniq) select project, count(*)::bigint as findings, {SEV_COUNTS} from x group by project")
_Z = "coalesce({0}, 0)::bigint as {0}"
_REVIEW = (
    f"{STATUS}, "
    f"cnt as (select project, {SEV_COUNTS} from (select project, case when severity_missing then 'Info' "
    f"else k_severity end as sev from uniq) group by project), "
    f"done as (select project, sum(ok::int)::bigint as chunks, count(*)::bigint as initial_chunks from parsed "
    f"group by project), "
    f"sm as (select project, count(*) as n_summaries from parsed where ok and "
    f"coalesce(json_extract_string(j, '$.summary'), '') <> '' group by project), "
    f"pp as (select project, count(distinct coalesce(json_extract_string(e, '$'), '')) as n_positive_points from "
    f"(select project, unnest(json_extract(j, '$.positive_points[*]')) as e from parsed where ok) group by project), "
    f"rc as (select project, count(distinct coalesce(json_extract_string(e, '$'), '')) as n_recommendations from "
    f"(select project, unnest(json_extract(j, '$.recommendations[*]')) as e from parsed where ok) group by project), "
    f"us as (select project, sum(trunc(prompt_tokens::double)::bigint)::bigint as usage_prompt, "
    f"sum(trunc(completion_tokens::double)::bigint)::bigint as usage_completion from parsed where ok "
    f"group by project), "
    f"tt as (select source as project, count(*)::bigint as files, sum(strlen(text))::bigint as size, sum(case when length(text) = 0 then 0 "
    f"else length(text) - length(replace(text, chr(10), '')) + 1 end)::bigint as loc, sum({tokens('text')})::bigint as tokens "
    f"from documents group by source), "
    f"review as (select s.project, s.project as path, 'groq' as provider, 'openai/gpt-oss-20b' as model, {CONTEXT}::bigint as context_assumed, "
    f"{_Z.format('chunks')}, {_Z.format('initial_chunks')}, overall_status, n_findings, n_failed, "
    + ", ".join(_Z.format(s.lower()) for s in K.SEVERITIES) +
    f", {_Z.format('n_summaries')}, {_Z.format('n_positive_points')}, {_Z.format('n_recommendations')}, "
    f"usage_prompt, usage_completion, files, size, loc, tokens, '2024-01-02T03:04:05' as generated_at "
    f"from status s left join done using (project) left join cnt using (project) left join sm using (project) "
    f"left join pp using (project) left join rc using (project) left join us using (project) left join tt using (project))")
SQL["e14_review_record"] = f"with {PARSED}, {_REVIEW} select * from review"
SQL["a6_write_review"] = (
    f"with {PARSED}, {STATUS} select s.project, overall_status, n_findings, finding_rank::bigint as finding_rank, dedup_key, chunk_id, pos "
    f"from status s left join ranked r using (project)")
SQL["e15_line_label"] = (
    f"with {PARSED} select project, chunk_id, pos, case when line_raw is null or line_raw = '' or "
    f"(line is not null and line = 0) then '' when line_end_raw is not null and line_end_raw <> '' and "
    f"line_end_raw <> '0' and line_end_raw <> line_raw then 'Line ' || line_raw || '-' || line_end_raw "
    f"else 'Line ' || line_raw end as line_label from uniq")


def _esc(x: str) -> str:
    return (f"replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), "
            f"'\"', '&quot;'), '''', '&#x27;')")


_LABEL = ("case when line_raw is null or line_raw = '' or (line is not null and line = 0) then '' "
          "when line_end_raw is not null and line_end_raw <> '' and line_end_raw <> '0' and line_end_raw <> line_raw "
          "then 'Line ' || line_raw || '-' || line_end_raw else 'Line ' || line_raw end")
_HTML = ("'<article class=\"finding\"><h3>' || " + _esc("coalesce(title, 'Untitled finding')") + " || ' (' || "
         + _esc("case when severity_missing then 'Info' else k_severity end") + " || ')</h3><p>' || " + _esc("coalesce(category, '')")
         + " || ' in <code>' || " + _esc("coalesce(file, '')") + " || '</code>' || "
         + f"case when lab <> '' then ', ' || {_esc('lab')} else '' end"
         + " || '; certainty: ' || " + _esc("coalesce(confidence, '')") + " || '</p><pre>' || " + _esc("coalesce(evidence, '')")
         + " || '</pre><p class=\"why\">' || " + _esc("coalesce(why, '')")
         + " || '</p><p class=\"fix\">' || " + _esc("coalesce(fix, '')") + " || '</p></article>'")
SQL["e16_finding_html"] = (
    f"with {PARSED}, x as (select *, {_LABEL} as lab from ranked), h as (select project, finding_rank, {_HTML} as html "
    f"from x) select project, finding_rank::bigint as finding_rank, sha256(html) as html_sha, "
    f"length(html)::bigint as html_chars from h")


def _points(field: str) -> str:
    return (f"select project, item, row_number() over (partition by project order by item)::bigint as seq from (select distinct project, "
            f"coalesce(json_extract_string(e, '$'), '') as item from (select project, unnest(json_extract(j, '$.{field}[*]')) as e "
            f"from parsed where ok))")


_HEAD = ("'<!doctype html>\n<html>\n<head>\n<meta charset=\"utf-8\">\n<title>Review of ' || " + _esc("project")
         + " || '</title>\n</head>\n<body>\n<h1>Review of ' || " + _esc("project")
         + " || '</h1>\n<dl>\n<dt>Folder</dt><dd>' || " + _esc("path")
         + " || '</dd>\n<dt>Reviewer</dt><dd>' || " + _esc("provider") + " || ' / ' || " + _esc("model")
         + " || '</dd>\n<dt>Outcome</dt><dd>' || overall_status || '</dd>\n<dt>Written</dt><dd>' || generated_at"
         + " || '</dd>\n</dl>\n<ul class=\"numbers\">' || "
         + " || ".join(f"'<li>{label}: ' || coalesce({c}, 0) || '</li>'" for label, c in
                       [("Files read", "files"), ("Lines", "loc"), ("Token estimate", "tokens")] + [(s, s.lower()) for s in K.SEVERITIES])
         + " || '</ul>\n<h2>What the replies say</h2>\n<ul>'")
_LI = "'<li>' || " + _esc("{0}") + " || '</li>'"
_PAGE = f"""page as (
    select project, 0 as section, 0::bigint as seq, {_HEAD} as html from review
    union all select project, 1, row_number() over (partition by project order by chunk_id), {_LI.format("s")} from
        (select project, chunk_id, json_extract_string(j, '$.summary') as s from parsed where ok) where s <> ''
    union all select project, 1, 0, '<li>No summary returned.</li>' from review where n_summaries = 0
    union all select project, 2, 0, '</ul>\n<h2>Ranked findings</h2>' from review
    union all select project, 3, finding_rank, {_HTML} from (select *, {_LABEL} as lab from ranked)
    union all select project, 3, 0, '<div class="positive"><h2>Nothing to report</h2><p>The review of this project raised no finding.</p></div>'
        from review where n_findings = 0
    union all select project, 4, 0, '<div class="warning"><h2>Parts not reviewed</h2><p>' || n_failed || ' chunk(s) have no usable reply, '
        || 'so the findings above do not cover them. Run the review again for these chunks.</p></div>' from review where n_failed > 0
    union all select project, 5, 0, '<h2>Strong sides</h2>\n<ul>' from review
    union all select project, 6, seq, {_LI.format("item")} from ({_points("positive_points")})
    union all select project, 6, 0, '<li>No specific positive points returned.</li>' from review where n_positive_points = 0
    union all select project, 7, 0, '</ul>\n<h2>Advice</h2>\n<ul>' from review
    union all select project, 8, seq, {_LI.format("item")} from ({_points("recommendations")})
    union all select project, 8, 0, '<li>No additional recommendations returned.</li>' from review where n_recommendations = 0
    union all select project, 9, 0, '</ul>\n<hr>\n<p><small>Findings come from automated replies and want a second look; '
        || 'token figures are estimates.</small></p>\n</body>\n</html>' from review)"""
SQL["e16_report_rows"] = f"with {PARSED}, {_REVIEW}, {_PAGE} select project, section, seq, sha256(html) as html_sha from page"
SQL["a7_write_reports"] = (
    f"with {PARSED}, {_REVIEW}, {_PAGE}, whole as (select project, string_agg(html, chr(10) order by section, seq) as html from page "
    f"group by project) select regexp_replace(project, '[^A-Za-z0-9._-]+', '_', 'g') || "
    f"'-groq-openai_gpt-oss-20b-20240102-030405.html' as report, sha256(html) as page_sha, length(html)::bigint as page_chars from whole")


# ---------------------------------------------------------------- D5 retry split
def retry_cte(p: str, q: str = "r") -> str:
    """Retry split of every chunk of ``{p}members`` (CTE names prefixed q)."""
    return f"""{q}ch as (select project, chunk_id, sum(tokens) as total, count(*) as n from {p}members group by all),
{q}mm as (select m.*, greatest(1000, ch.total // 2) as target from {p}members m join {q}ch ch using (project, chunk_id)
  where ch.total > {K.RETRY_SPLIT_MIN_TOTAL} and ch.n > 1),
{q}fold as (
  select project, chunk_id, -1 as pos, 0::bigint as cur, 1 as g from (select distinct project, chunk_id from {q}mm)
  union all
  select mm.project, mm.chunk_id, mm.pos,
    case when f.cur > 0 and f.cur + mm.tokens > mm.target then mm.tokens else f.cur + mm.tokens end,
    case when f.cur > 0 and f.cur + mm.tokens > mm.target then f.g + 1 else f.g end
  from {q}fold f join {q}mm mm on mm.project = f.project and mm.chunk_id = f.chunk_id and mm.pos = f.pos + 1),
{q}multi0 as (select mm.project, mm.chunk_id, fo.g as sub_id, mm.pos as pos_old, mm.relative, mm.size, mm.lines,
    mm.tokens from {q}mm mm join {q}fold fo on fo.project = mm.project and fo.chunk_id = mm.chunk_id and fo.pos = mm.pos),
{q}multi as (select project, chunk_id, sub_id::int as sub_id,
    (row_number() over (partition by project, chunk_id, sub_id order by pos_old) - 1)::int as pos, relative, size,
    lines, tokens from {q}multi0 where (project, chunk_id) in
    (select (project, chunk_id) from {q}multi0 group by project, chunk_id having max(sub_id) > 1)),
{q}one as (select m.project, m.chunk_id, m.relative, m.text, greatest(1000, m.tokens // 2) as t2
  from {p}members m join {q}ch ch using (project, chunk_id) where ch.total > {K.RETRY_SPLIT_MIN_TOTAL} and ch.n = 1),
{q}one2 as (select *, greatest(1000, 3 * t2) as w, ceil(length(text) / greatest(1000, 3 * t2)::double)::bigint as pc
  from {q}one where length(text) > 0),
{q}one3 as (select *, unnest(range(1, pc + 1)) as part_no from {q}one2 where pc > 1),
{q}pieces as (select project, chunk_id, part_no::int as sub_id, 0::int as pos,
    relative || ' [retry-part ' || part_no || '/' || pc || ']' as relative, strlen(pt)::bigint as size,
    {part_loc('pt')} as lines, {tokens('pt')} as tokens
  from (select *, substr(text, ((part_no - 1) * w + 1)::bigint, w) as pt from {q}one3)),
{q}split as (select * from {q}multi union all select * from {q}pieces)"""


SQL["d5_retry_split"] = (f"with recursive {PACK}, {retry_cte('')} select project, chunk_id, sub_id, pos, relative, "
                         f"size, lines, tokens from rsplit")

# ---------------------------------------------------------------- G catalog
_TRUTHY = "nullif(json_extract_string(item, '{0}'), '')"
MODELS = CATALOG_V + f""",
pj as (select payload_id, provider, payload from catalog_v where json_valid(payload)),
arrs as (select payload_id, provider, case
   when provider in ('gemini', 'ollama') then case when json_type(payload) = 'OBJECT' then json_extract(payload, '$.models') end
   when json_type(payload) = 'ARRAY' then payload::json
   when json_type(payload) = 'OBJECT' and json_type(payload, '$.data') is null then null
   when json_type(payload) = 'OBJECT' and json_type(payload, '$.data') = 'ARRAY' then json_extract(payload, '$.data')
   when json_type(payload) = 'OBJECT' then json_extract(payload, '$.models') end as arr from pj),
items as (select payload_id, provider, arr, unnest(range(0, json_array_length(arr)::bigint)) as pos
  from arrs where json_type(arr) = 'ARRAY'),
it as (select * from (select payload_id, provider, pos::int as pos, json_extract(arr, '$[' || pos || ']') as item
  from items) where json_type(item) = 'OBJECT'),
mt as (select *,
  regexp_replace(coalesce(json_extract_string(item, '$.name'), ''), '^models/', '') as gem_id,
  coalesce(json_array_length(item, '$.supportedGenerationMethods'), 0) = 0
    or list_contains(json_extract_string(item, '$.supportedGenerationMethods[*]'), 'generateContent') as gem_ok,
  coalesce({_TRUTHY.format('$.name')}, {_TRUTHY.format('$.model')}) as tag_id,
  coalesce({_TRUTHY.format('$.id')}, {_TRUTHY.format('$.name')}, {_TRUTHY.format('$.model')}) as gen_id,
  (json_type(item, '$.active') = 'BOOLEAN' and json_extract_string(item, '$.active') = 'false')
    or (json_type(item, '$.archived') = 'BOOLEAN' and json_extract_string(item, '$.archived') = 'true') as inactive,
  coalesce({", ".join(f"nullif(try_cast(json_extract_string(item, '{p}') as bigint), 0)" for p in K.CONTEXT_PATHS)})
    as gen_ctx,
  try_cast(json_extract_string(item, '$.inputTokenLimit') as bigint) as gem_ctx,
  {_TRUTHY.format('$.displayName')} as gem_dn, {_TRUTHY.format('$.display_name')} as gen_dn
  from it),
models as (select provider, payload_id, pos,
    case provider when 'gemini' then gem_id when 'ollama' then tag_id else gen_id end as id,
    case provider when 'gemini' then coalesce(gem_dn, gem_id) when 'ollama' then tag_id
      else coalesce(gen_dn, {_TRUTHY.format('$.name')}, gen_id) end as name,
    case provider when 'gemini' then gem_ctx when 'ollama' then null::bigint else gen_ctx end as context,
    true as active
  from mt where case provider when 'gemini' then gem_ok and gem_id <> '' when 'ollama' then tag_id is not null
    else gen_id is not null and not coalesce(inactive, false) end),
ranked as (select *, row_number() over (partition by provider order by penalty, -coalesce(context, 0), lower(id),
    payload_id, pos)::bigint as model_rank
  from (select *, case when {" or ".join(f"contains(lower(id), '{t}')" for t in K.NON_CHAT_TERMS)} then 1 else 0 end
    as penalty from models))"""

_KNOWN = "(values " + ", ".join(f"({_q(k)}, {v}, {i})" for i, (k, v) in enumerate(K.MODEL_CONTEXTS.items())) + \
    ") as kn(known_id, known_context, ord)"

SQL["g1_normalize_catalog"] = f"with {MODELS} select provider, payload_id, pos, id, name, context, active from models"
SQL["g2_provider_shapes"] = (f"with {MODELS} select provider, count(*)::bigint as models, count(context)::bigint as "
                             f"with_context, sum(starts_with(id, 'models/')::int)::bigint as prefixed from models "
                             f"group by provider")
SQL["g3_rank_models"] = f"with {MODELS} select provider, payload_id, pos, id, penalty, model_rank from ranked"
SQL["g4_search_models"] = (
    f"with {MODELS}, h as (select provider, id, model_rank, row_number() over (partition by provider order by "
    f"model_rank)::bigint as match_rank from ranked where contains(lower(id), 'red') or contains(lower(name), 'red'))"
    f" select * from h where match_rank <= {K.SEARCH_LIMIT}")
SQL["g5_model_page"] = (f"with {MODELS} select provider, id, model_rank from ranked where model_rank > {K.PAGE_SIZE} "
                        f"and model_rank <= {2 * K.PAGE_SIZE}")
SQL["g6_context_lookup"] = (
    f"with {MODELS}, kn as (select * from {_KNOWN}), "
    f"fo as (select lower(known_id) as f, arg_min(known_context, ord) as folded from kn group by lower(known_id)) "
    f"select m.provider, m.payload_id, m.pos, m.id as model, coalesce(nullif(m.context, 0), e.known_context, "
    f"fo.folded, {K.DEFAULT_CONTEXT})::bigint as context_assumed, case when nullif(m.context, 0) is not null then 'live' "
    f"when e.known_context is not null then 'exact' when fo.folded is not null then 'case_insensitive' "
    f"else 'default' end as context_source from models m left join kn e on e.known_id = trim(m.id) "
    f"left join fo on fo.f = lower(trim(m.id))")
SQL["d7_context_budget"] = (f"with {MODELS} select provider, id, context, greatest(1500, least(100000, "
                            f"trunc(coalesce(context, 8192) * 0.5)::bigint))::bigint as budget from models")
SQL["g7_in_active_list"] = (
    f"with {MODELS}, a as (select id, max(context) as live_context from models where provider = 'generic' "
    f"group by id) select p_partkey, p_name as model, a.id is not null as active, a.live_context "
    f"from part left join a on a.id = part.p_name")

# ---------------------------------------------------------------- H hygiene
_WS = r"[\p{Z}\s]"


def sanitize_sql(x: str) -> str:
    k = f"regexp_replace({x}, '[\\p{{Cf}}\\p{{Cc}}]', '', 'g')"
    k = f"regexp_replace({k}, '^{_WS}+|{_WS}+$', '', 'g')"
    k = f"regexp_replace({k}, '^\"+|\"+$', '', 'g')"
    k = f"regexp_replace({k}, '^''+|''+$', '', 'g')"
    k = f"regexp_replace({k}, '^{_WS}+|{_WS}+$', '', 'g')"
    k = f"(case when starts_with(lower({k}), 'bearer ') then substr({k}, 8) else {k} end)"
    return f"coalesce(regexp_replace({k}, '{_WS}+', '', 'g'), '')"


def mask_sql(k: str) -> str:
    return (f"case when length({k}) = 0 then 'NOT SET' when length({k}) <= {K.MASK_SHORT_MAX} then "
            f"'SET (' || length({k}) || ' chars)' else left({k}, 4) || '...' || right({k}, 4) || ' (' || length({k}) "
            f"|| ' chars)' end")


def fp_sql(k: str) -> str:
    return f"case when length({k}) = 0 then 'empty' else left(sha256({k}), {K.FINGERPRINT_HEX}) end"


SEC = SECRETS_V + f", sk as (select doc_id, owner, {sanitize_sql('value')} as key from secrets_v)"
SQL["h1_sanitize"] = f"with {SEC} select doc_id, owner, key from sk"
SQL["h2_mask"] = f"with {SEC} select doc_id, {mask_sql('key')} as masked from sk"
SQL["h3_fingerprint"] = f"with {SEC} select doc_id, {fp_sql('key')} as fingerprint, length(key)::bigint as length from sk"
SQL["h4_format_check"] = (
    f"with {SEC} select doc_id, length(key) >= {K.MIN_KEY_LENGTH} as valid, starts_with(key, 'gsk_') as prefix_ok, "
    f"case when length(key) = 0 then 'API key is empty.' when length(key) < {K.MIN_KEY_LENGTH} then "
    f"'API key is too short (' || length(key) || ' characters). The key was probably pasted incorrectly.' "
    f"when not starts_with(key, 'gsk_') then 'Prefix does not match the provider''s common key format (gsk_). "
    f"A live connection test will decide. | Length check passed: ' || length(key) || ' characters.' "
    f"else 'Length check passed: ' || length(key) || ' characters.' end as messages from sk")
SQL["h5_key_status"] = (
    f"with {SEC}, o as (select distinct source as owner from documents), j as (select o.owner, "
    f"coalesce(sk.key, '') as key from o left join sk on sk.owner = o.owner) select owner, {mask_sql('key')} as status,"
    f" {fp_sql('key')} as fingerprint, length(key)::bigint as length from j")
from revlens.operators.hygiene import ASSIGNMENT_PATTERN, PREFIX_PATTERN  # noqa: E402

SQL["h6_scan_secrets"] = (
    f"with h as (select doc_id, source as owner, list_concat("
    f"list_transform(regexp_extract_all(text, {_q(ASSIGNMENT_PATTERN)}, 1), lambda x: {{'kind': 'assignment', 'v': x}}), "
    f"list_transform(regexp_extract_all(text, {_q(PREFIX_PATTERN)}, 1), lambda x: {{'kind': 'prefix', 'v': x}})) as hits "
    f"from documents), e as (select doc_id, owner, unnest(hits) as h, unnest(range(0, len(hits))) as hit_no from h), "
    f"k as (select doc_id, owner, hit_no::int as hit_no, h.kind as kind, {sanitize_sql('h.v')} as key from e) "
    f"select doc_id, owner, hit_no, kind, {mask_sql('key')} as masked, {fp_sql('key')} as fingerprint, "
    f"length(key)::bigint as length from k")

# ---------------------------------------------------------------- F attempts
DOCS = SNAPSHOT_V + f""",
cur0 as (select source as project, 'doc/' || doc_id || '.txt' as relative, text from documents),
snap0 as (select project, 'doc/' || doc_id || '.txt' as relative, text from snapshot_v),
cur as (select project, relative, text, strlen(text)::bigint as size,
  (case when length(text) = 0 then 0 else length(text) - length(replace(text, chr(10), '')) + 1 end)::bigint as lines,
  {tokens('text')} as tokens from cur0),
snap as (select project, relative, text, strlen(text)::bigint as size,
  (case when length(text) = 0 then 0 else length(text) - length(replace(text, chr(10), '')) + 1 end)::bigint as lines,
  {tokens('text')} as tokens from snap0)"""


def _sig(src: str) -> str:
    return _tree(src, {"signature": _META})


SQL["f1_valid_checkpoints"] = (
    f"with {DOCS}, c as ({_sig('cur')}), s as ({_sig('snap')}) select s.project, 'groq' as provider, "
    f"'openai/gpt-oss-20b' as model, c.project is not null as valid from s left join c "
    f"on c.project = s.project and c.signature = s.signature")
PEND = (f"{DOCS},\n{pack_cte('cur', 'c_')},\n{pack_cte('snap', 's_')},\n"
        f"pend as (select * from c_chunks where (project, signature) not in (select (project, signature) from s_chunks))")
SQL["j1_changed_only"] = f"with recursive {PEND} select project, chunk_id, n_files, tokens, signature from c_chunks"
SQL["f2_pending_chunks"] = f"with recursive {PEND} select project, chunk_id, n_files, tokens, signature from pend"
SQL["f7_pacing_plan"] = (
    f"with recursive {PEND}, q as (select project, chunk_id, row_number() over (partition by project order by "
    f"chunk_id)::bigint as queue_pos from pend) select project, chunk_id, queue_pos, round((queue_pos - 1) * "
    f"{DELAY}::double, 6) as start_offset_sec, max(round((queue_pos - 1) * {DELAY}::double, 6)) over (partition by "
    f"project) as projected_finish_sec from q")
SQL["f8_requeue"] = (
    f"with recursive {PEND}, p_members as (select * from c_members where (project, chunk_id) in "
    f"(select (project, chunk_id) from pend)), {retry_cte('p_', 'r')}, "
    f"u as (select project, chunk_id, sub_id, 0 as priority from rsplit union all select project, chunk_id, 0, 1 "
    f"from pend where (project, chunk_id) not in (select (project, chunk_id) from rsplit)) "
    f"select project, chunk_id, sub_id::int as sub_id, priority, row_number() over (partition by project order by "
    f"priority, chunk_id, sub_id)::bigint as queue_pos from u")
_RETRY_WORDS = " or ".join(f"contains(lower(coalesce(detail, '')), {_q(w)})" for w in K.RETRYABLE_WORDS)
_CTX_WORDS = " or ".join(f"contains(lower(coalesce(detail, '')), {_q(w)})" for w in K.CONTEXT_ERROR_MARKERS)
_RETRYABLE = (f"case when status is not null then status in ({', '.join(map(str, K.RETRYABLE_STATUSES))}) "
              f"else ({_RETRY_WORDS}) end")
_CTXERR = f"coalesce(status in (400, 413) and ({_CTX_WORDS}), false)"
SQL["f3_latest_failures"] = (
    f"with {ATTEMPTS_V}, fa as (select * from attempts_v where status is null or not (status >= 200 and status < 300)),"
    f" su as (select provider, chunk_id, max({{'ts': ts, 'event_id': event_id}}) as ok from attempts_v "
    f"where status >= 200 and status < 300 group by provider, chunk_id), "
    f"la as (select * from (select *, row_number() over (partition by provider, chunk_id order by ts desc, "
    f"event_id desc) as rn from fa) where rn = 1) "
    f"select la.provider, la.chunk_id, attempt, event_id, status, detail from la left join su "
    f"on su.provider = la.provider and su.chunk_id = la.chunk_id "
    f"where su.ok is null or {{'ts': la.ts, 'event_id': la.event_id}} > su.ok")
SQL["f4_retryable"] = f"with {ATTEMPTS_V} select event_id, {_RETRYABLE} as retryable from attempts_v"
SQL["f5_context_error"] = (
    f"with {ATTEMPTS_V} select event_id, {_CTXERR} as context_error, coalesce(case status "
    + " ".join(f"when {s} then {_q(h)}" for s, h in K.STATUS_HINTS.items()) + " end, '') as hint from attempts_v")
SQL["f6_next_wait"] = (
    f"with {ATTEMPTS_V}, a as (select *, case when status >= 200 and status < 300 then 'done' when {_CTXERR} then "
    f"'split' when ({_RETRYABLE}) and attempt < {K.MAX_ATTEMPTS} then 'retry' else 'fail' end as action from attempts_v)"
    f" select event_id, action, case when action = 'retry' then round(case when status is not null and retry_after "
    f"is not null then greatest(0.5, least(120.0, retry_after)) else least(120.0, pow(2.0, attempt - 1)) end, 6) end "
    f"as wait_sec from a")


# ---------------------------------------------------------------- S streams
_FMT = "'%Y-%m-%d %H:%M:%S'"
_MAXTS = "(select max(ts) from events) - interval 10 minutes"
SQL["s1_rate_per_minute"] = (
    f"with {ATTEMPTS_V}, w as (select time_bucket(interval 1 minute, ts) as ws, provider, tokens from attempts_v) "
    f"select strftime(ws, {_FMT}) as window_start, strftime(ws + interval 1 minute, {_FMT}) as window_end, provider, "
    f"count(*)::bigint as requests, sum(tokens)::bigint as tokens from w group by ws, provider "
    f"having ws + interval 1 minute <= {_MAXTS}")
SQL["s2_sliding_rate"] = (
    f"with {ATTEMPTS_V}, x as (select provider, tokens, time_bucket(interval 1 minute, ts) as b, "
    f"unnest([0, 1, 2, 3, 4]) as k from attempts_v), w as (select provider, tokens, b - k * interval 1 minute as ws "
    f"from x) select strftime(ws, {_FMT}) as window_start, strftime(ws + interval 5 minute, {_FMT}) as window_end, "
    f"provider, count(*)::bigint as requests, sum(tokens)::bigint as tokens, sum(tokens) > 40000 as over_limit "
    f"from w group by ws, provider having ws + interval 5 minute <= {_MAXTS}")
SQL["s3_review_bursts"] = (
    f"with g as (select user_id, ts, value, case when lag(ts) over (partition by user_id order by ts) is null or "
    f"ts - lag(ts) over (partition by user_id order by ts) >= interval 10 minutes then 1 else 0 end as brk "
    f"from events), s as (select *, sum(brk) over (partition by user_id order by ts rows unbounded preceding) as sid "
    f"from g), ss as (select user_id, min(ts) as st, max(ts) + interval 10 minutes as en, count(*)::bigint as events, "
    f"round(sum(value), 6) as value from s group by user_id, sid) select strftime(st, {_FMT}) as session_start, "
    f"strftime(en, {_FMT}) as session_end, user_id, events, value from ss where en <= {_MAXTS}")
# ---------------------------------------------------------------- J history
_RULES_NOW = (f"select project, relative as file, unnest(string_split(text, chr(10))) as evidence, "
              f"unnest(range(1, len(string_split(text, chr(10))) + 1)) as line from {{src}}")


def _rule_hits(src: str, model: str) -> str:
    return (f"select project, file, line::bigint as line, {_q(model)} as model, rule, {_rule_field(0)} as category, "
            f"{_rule_field(1)} as severity, {_rule_field(3)} as title from (select project, file, line, "
            f"unnest(list_filter({RULE_ARRAY}, lambda x: x is not null)) as rule from ("
            + _RULES_NOW.format(src=src) + "))")


_FKEY = ("sha256(concat_ws('|', coalesce(category, ''), coalesce(severity, ''), coalesce(file, ''), "
         "coalesce(line::varchar, ''), coalesce(title, '')))")
SQL["s5_incremental_review"] = (
    f"with {PARSED}, src as (select source as project, doc_id, 'doc/' || doc_id || '.txt' as relative, coalesce(text, '') as text from documents), "
    f"sg as (select project, doc_id as chunk_id, relative, sha256(concat_ws(':', relative, case when length(text) = 0 then 0 else "
    f"length(text) - length(replace(text, chr(10), '')) + 1 end, {tokens('text')}, length(text))) as signature from src), "
    f"told as (select project, chunk_id, coalesce(json_array_length(j, '$.findings'), 0)::bigint as n from parsed where ok), "
    f"hits as ({_rule_hits('src', 'rules')}), "
    f"a as (select project, chunk_id, pos::bigint as pos, severity, file, line_raw, title, k_category, k_severity, k_file, k_line, k_title from findings "
    f"union all select h.project, sg.chunk_id, n + row_number() over (partition by h.project, h.file order by line, rule) - 1, severity, file, "
    f"line::varchar, title, category, severity, file, line::varchar, title from hits h join sg on sg.project = h.project and sg.relative = h.file "
    f"join told on told.project = sg.project and told.chunk_id = sg.chunk_id), "
    f"k as (select *, sha256(concat_ws('|', k_category, k_severity, k_file, k_line, k_title)) as dedup_key from a), "
    f"u as (select * from (select *, row_number() over (partition by project, dedup_key order by chunk_id, pos) as rn from k) where rn = 1) "
    f"select u.project, dedup_key, signature, u.chunk_id, pos::int as pos, severity, file, line_raw, title from u "
    f"join sg on sg.project = u.project and sg.chunk_id = u.chunk_id")
SQL["j1_changed_files"] = (
    f"with {DOCS} select coalesce(c.project, s.project) as project, coalesce(c.relative, s.relative) as relative, "
    f"case when s.relative is null then 'added' when c.relative is null then 'removed' when sha256(c.text) <> "
    f"sha256(s.text) then 'changed' else 'unchanged' end as change, c.tokens from cur c full outer join snap s "
    f"on c.project = s.project and c.relative = s.relative")
_RUNS = (
    f"{DOCS}, nh as ({_rule_hits('cur', 'now')}), th as ({_rule_hits('snap', 'then')}), "
    f"nr as (select project, file, category, title, severity, line as lo, line + line % 3 as hi from nh), "
    f"tr as (select project, file, category, title, severity, line + length(file) % 5 as lo, line + length(file) % 5 + line % 3 as hi from th)")
SQL["j2_finding_history"] = (
    f"with {_RUNS}, n as (select distinct * from nr), t as (select distinct * from tr), "
    f"a as (select n.*, case when exists (select 1 from t where t.project = n.project and t.file = n.file and t.category = n.category "
    f"and t.title = n.title and t.lo <= n.hi + 2 and n.lo <= t.hi + 2) then 'persisting' else 'new' end as state from n), "
    f"b as (select t.*, 'fixed' as state from t where not exists (select 1 from n where t.project = n.project and t.file = n.file "
    f"and t.category = n.category and t.title = n.title and t.lo <= n.hi + 2 and n.lo <= t.hi + 2)) select * from a union all select * from b")
_COUNTS = (f"{FILES}, h as ({_rule_hits('rv', 'rules')}), u as (select distinct project, severity, "
           f"sha256(concat_ws('|', category, severity, file, line::varchar, title)) as k from h), "
           f"cn as (select project, " + ", ".join(
               f"sum(case when severity = '{s}' then 1 else 0 end)::bigint as {s.lower()}" for s in K.SEVERITIES)
           + " from u group by project)")
from revlens.operators.history import GATE_MAX, RISK_WEIGHTS  # noqa: E402

SQL["j3_quality_gate"] = (
    f"with {_COUNTS} select project, critical, high, medium, low, info, "
    + " and ".join(f"{s.lower()} <= {v}" for s, v in GATE_MAX.items()) + " as gate_pass, "
    + "concat_ws(',', " + ", ".join(f"case when {s.lower()} > {v} then '{s}' end" for s, v in GATE_MAX.items())
    + ") as failing from cn")
_W = " + ".join(f"coalesce({s.lower()}, 0) * {v}" for s, v in RISK_WEIGHTS.items())
SQL["j4_risk_score"] = (
    f"with {_COUNTS}, t as (select project, sum(lines)::bigint as loc from rv group by project) "
    f"select t.project, loc, ({_W})::bigint as weighted, round(case when loc > 0 then ({_W}) * 1000.0 / loc end, 6)"
    f" as risk_per_kloc from t left join cn using (project)")
SQL["j5_model_agreement"] = (
    f"with {_RUNS}, al as (select project, file, category, lo, hi, 'now' as model from nr union all select project, file, category, lo, hi, 'then' from tr "
    f"union all select project, file, category, lo, lo, 'points' from nr where lo % 2 = 0), "
    f"w as (select *, max(hi) over (partition by project, file, category order by lo, hi rows between unbounded preceding and 1 preceding) as reach from al), "
    f"g as (select *, sum(case when reach is null or lo > reach then 1 else 0 end) over (partition by project, file, category order by lo, hi) "
    f"as grp from w) select project, file, category, min(lo) as lo, max(hi) as hi, count(distinct model)::bigint as models, "
    f"count(*)::bigint as reports from g group by project, file, category, grp")
REPLAY = (
    f"{ATTEMPTS_V}, lg as (select event_id, ts, 'src' || (chunk_id % 20) as project, 1 + event_id % 50 as chunk_id, "
    f"case when event_id % 11 = 0 then 401 when status = 200 and event_id % 3 <> 0 then 500 else status end as status, "
    f"case when event_id % 11 = 0 then 'invalid key' when status = 200 and event_id % 3 <> 0 then 'server error' else detail end as detail "
    f"from attempts_v), l1 as (select *, case when status >= 200 and status < 300 then 'done' when {_CTXERR} then 'split' "
    f"when not ({_RETRYABLE}) then 'fail' end as fin from lg), "
    f"l2 as (select *, coalesce(sum((fin is not null)::int) over w, 0) as isl, coalesce(sum((fin = 'done')::int) over w, 0) as dones from l1 "
    f"window w as (partition by project, chunk_id order by ts, event_id rows between unbounded preceding and 1 preceding)), "
    f"l3 as (select *, row_number() over (partition by project, chunk_id, isl order by ts, event_id) as pl from l2), "
    f"l4 as (select *, ((pl - 1) % 5 + 1)::int as attempt_no, coalesce(fin, case when (pl - 1) % 5 = 4 then 'fail' else 'retry' end) as action "
    f"from l3), rp as (select *, sum((attempt_no = 1)::int) over (partition by project, chunk_id order by ts, event_id)::bigint as call_no, "
    f"dones > 0 as spare from l4)")
SQL["f6_replay"] = f"with {REPLAY} select event_id, project, chunk_id, call_no, attempt_no, action, spare from rp"
SQL["e9_failed_chunks"] = (
    f"with recursive {PEND}, {REPLAY}, pc as (select project, chunk_id, count(*)::bigint as attempts, bool_or(action = 'done') as done, "
    f"arg_max({{'a': action, 's': status, 'd': detail}}, {{'ts': ts, 'e': event_id}}) filter (action in ('fail', 'split')) as fl from rp "
    f"group by project, chunk_id), fi as (select project, chunk_id, string_agg(relative, '|' order by pos) as files from c_members group by all) "
    f"select project, chunk_id, signature, files, tokens, attempts, concat_ws(': ', 'HTTP ' || fl.s, nullif(fl.d, '')) as error "
    f"from pc join c_chunks using (project, chunk_id) join fi using (project, chunk_id) where not done and fl.a = 'fail'")
SQL["j6_billed_tokens"] = (
    f"with recursive {PEND}, {REPLAY}, a as (select project, count(*)::bigint as chunks, sum(tokens)::bigint as code_tokens from c_chunks "
    f"group by project), x as (select rp.*, tokens + 1500 as cost, status is null or (status >= 200 and status < 300) as hit from rp "
    f"join c_chunks using (project, chunk_id)), u as (select project, count(*) as requests, count(*) filter (action = 'retry') as retries, "
    f"count(*) filter (action = 'split') as splits, count(*) filter (action = 'fail') as failures, "
    f"count(*) filter (action = 'done' and not spare) as done, sum(cost) filter (hit) as billed, "
    f"sum(cost) filter (hit and (action <> 'done' or spare)) as wasted from x group by project) "
    f"select a.project, chunks, code_tokens, (code_tokens + chunks * 1500)::bigint as planned, "
    + ", ".join(f"coalesce({c}, 0)::bigint as {c}" for c in ("requests", "retries", "splits", "failures", "done", "billed", "wasted"))
    + " from a left join u using (project)")

SQL["a4_read_replies"] = (f"with {RESPONSES_V} select project, chunk_id, 1 as attempt, raw, "
                          f"prompt_tokens::double as usage_prompt from responses_v")
SQL["a5_read_catalog"] = f"with {MODELS} select provider, id, name, context, active from models"

SQL["d2_split_by_tokens"] = (
    "with t as (select doc_id, regexp_extract_all(text, '[ \\t\\n\\r\\f\\v]*[^ \\t\\n\\r\\f\\v]+|[ \\t\\n\\r\\f\\v]+$') as toks from documents "
    "where length(text) > 0), p as (select doc_id, toks, ceil(len(toks) / 400.0)::int as pc from t), "
    "q as (select doc_id, toks, pc, unnest(range(1, pc + 1)) as part_no from p) "
    "select doc_id, part_no::int as part_no, pc as part_count, "
    "len(list_slice(toks, (part_no - 1) * 400 + 1, part_no * 400))::bigint as part_tokens, "
    "sha256(array_to_string(list_slice(toks, (part_no - 1) * 400 + 1, part_no * 400), '')) as part_sha from q")
SQL["e0_score_chunks"] = (
    f"with recursive {PACK}, n as (select project, max(chunk_id) as n_chunks from members group by project), "
    f"b as (select project, chunk_id, string_agg(chr(10) || '===== FILE: ' || relative || ' | LOC: ' || lines || "
    f"' =====' || chr(10) || text || chr(10) || '===== END FILE =====', chr(10) order by pos) as body "
    f"from members group by project, chunk_id), "
    f"pr as (select b.project, b.chunk_id, 'Project: ' || b.project || chr(10) || 'Review chunk: ' || b.chunk_id || "
    f"'/' || n.n_chunks || chr(10) || chr(10) || 'Paths are relative to the project root.' || chr(10) || "
    f"'Review the following source files:' || chr(10) || body as prompt from b join n using (project)) "
    f"select project, chunk_id, '{{\"summary\": \"chars ' || length(prompt) || '\"}}' as raw, "
    f"greatest(1, round(length(prompt) / 3.5::double))::double as usage_prompt, null::varchar as error from pr")

SQL["f8_keep_state"] = (
    f"with {PARSED}, {DOCS}, st as ({_sig('cur')}) select project, signature from st "
    f"where project in (select project from parsed where not ok)")

SQL["s4_dedup_stream"] = (
    f"with {ATTEMPTS_V} select event_id, provider, chunk_id, attempt, status from (select *, row_number() over "
    f"(partition by provider, chunk_id, attempt order by ts, event_id) as rn from attempts_v) where rn = 1")
