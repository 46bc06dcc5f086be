"""DuckDB SQL of the queries, written from their definitions as relations rather than arrays."""

from __future__ import annotations

from .. import maps
from ..functions.tags import NOTATIONS
from ..sources.fixtures import BRANCHES, MODELS, NATURAL, PROMPTS, RUNS
from ..operators.resampling import PRIME, poisson_steps
from .queries import CONTRASTS, FAMILIES

_TAG = {"NAME": "NAME", "GEOGRAPHIC_LOCATION": "LOCATION", "DATE": "DATE", "MEDICAL_RECORD_NUMBER": "MRN"}
_MAPPED = "case type " + " ".join(f"when '{k}' then '{v}'" for k, v in maps.TAG_OF_TYPE.items()) + " else type end"
_SPELLED = "case t " + " ".join(f"when '{k}' then '{v}'" for k, v in maps.TAG_OF_SPELLING.items()) + " else t end"


def _quoted(items) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in items)


def _tags(name: str, source: str, ids: str, text: str) -> str:
    """CTEs ending in ``name``: (ids, position, tag_text, tag_type, format) of every tag of ``text``."""
    parts = []
    for k, (kind, rx, typed) in enumerate(NOTATIONS):
        rx = rx.replace("(?iu)", "(?i)")
        types = f"regexp_extract_all(x, '{rx}', 1)" if typed else "null::varchar[]"
        parts.append(
            f"select {ids}, {k} as k, '{kind}' as format, unnest(range(len(m))) as i, m, t, g from ("
            f"select {ids}, regexp_extract_all(x, '{rx}') as m, {types} as t, string_split_regex(x, '{rx}') as g "
            f"from (select {ids}, {text} as x from {source} where {text} is not null and regexp_matches({text}, '{rx}')))"
        )
    return f"""
    {name}_each as ({" union all ".join(parts)}),
    {name}_at as (
        select {ids}, k, format, m[i + 1] as tag_text, upper(trim(t[i + 1])) as t,
               (list_sum(list_transform(g[1:i + 1], lambda s: length(s))) + coalesce(list_sum(list_transform(m[1:i], lambda s: length(s))), 0))::int as position
        from {name}_each),
    {name} as (
        select {ids}, position, tag_text, case when t is null then 'UNKNOWN' else {_SPELLED} end as tag_type, format
        from {name}_at qualify row_number() over (partition by {ids}, position order by k) = 1)"""


_SPELLINGS = {
    "exact": ("[NAME]", "[LOCATION]", "[DATE]", "[MRN]"),
    "wrong": ("[EMAIL]", "[DATE]", "[PHONE]", "[NAME]"),
    "gone": ("", "", "", ""),
    "generic": ("[REDACTED]",) * 4,
    "mixed": ("<PATIENT>", "[[CITY]]", "***", "{ID}"),
}


def _folded(form: str) -> str:
    a, b, c, d = _SPELLINGS[form]
    return f"replace(replace(replace(replace(query_text, v1, '{a}'), v2, '{b}'), v3, '{c}'), v4, '{d}')"


GOLD = """
    first_order as (select o_custkey, min(o_orderkey) as k, arg_min(o_orderdate, o_orderkey) as d from orders group by o_custkey),
    people as (
        select c_custkey as key, c_name as v1, n_name as v2, strftime(d, '%Y-%m-%d') as v3, k::varchar as v4
        from customer join first_order on c_custkey = o_custkey join nation on c_nationkey = n_nationkey),
    gold as (
        select key, 'P-' || key as query_id, 'Patient ' || v1 || ' from ' || v2 || ' was seen on ' || v3 || ' for diabetes follow up, MRN ' || v4 || '.' as query_text,
               4 as phi_count, false as is_negative, v1, v2, v3, v4 from people
        union all
        select p_partkey, 'N-' || p_partkey, 'What is the usual dose of ' || p_name || ' for an adult with asthma, and should it be taken with food?', 0, true, null, null, null, null from part),
    phi as (
        select query_id, 0 as idx, 'NAME' as type, v1 as value from gold where not is_negative
        union all select query_id, 1, 'GEOGRAPHIC_LOCATION', v2 from gold where not is_negative
        union all select query_id, 2, 'DATE', v3 from gold where not is_negative
        union all select query_id, 3, 'MEDICAL_RECORD_NUMBER', v4 from gold where not is_negative)"""

_CONFIGS = ", ".join(f"('{m}', '{p}', {r}, {i * 5 + j * 2 + r * 3})" for i, m in enumerate(MODELS) for j, p in enumerate(PROMPTS) for r in range(1, RUNS + 1))
RESPONSES = f"""{GOLD},
    configs(model, prompt, run, shift) as (values {_CONFIGS}),
    branched as (select *, (key * 7 + shift) % {BRANCHES} as b from gold, configs),
    responses as (
        select model, prompt, run, query_id, query_text, phi_count, is_negative, key, v1, v2, v3, v4, key * 2 + is_negative::int as seq,
               case when b in (8, 9, 10) then null
                    when is_negative then case b
                        when 3 then replace(query_text, 'asthma', '[NAME]')
                        when 4 then query_text || ' For example, such as [NAME] and other values that a text of this kind may hold.'
                        when 5 then query_text || ' Note that all of the identifiers in this text were replaced with [ID] or ***.'
                        when 6 then '[REDACTED] ' || query_text when 7 then '' else query_text end
                    else case b
                        when 1 then {_folded("wrong")} when 2 then {_folded("gone")} when 3 then query_text
                        when 4 then {_folded("exact")} || ' All identifiers were replaced, such as Jane Roe, 555-123-4567.'
                        when 5 then {_folded("generic")} when 6 then {_folded("mixed")} when 7 then '' else {_folded("exact")} end end as output,
               case b when 8 then 'timeout_120s' when 9 then 'json_parse_failure' when 10 then 'connection_error: refused' end as error,
               case when b in (9, 10) then -1 else (key * 37 + shift * 11) % 900 + 100 end as latency_ms
        from branched)"""

_ID = "model, prompt, run, query_id"
_CONTEXT = maps.DELETION_CONTEXT
_KEPT = lambda words: f"len(list_filter({words}, lambda w: contains(lower(output), lower(w)))) >= 2"
_WORDS = lambda text: rf"list_filter(string_split_regex({text}, '\s+'), lambda w: w <> '')"

SCORES = rf"""{RESPONSES},{_tags("tags", "responses", _ID, "output")},
    placed as (
        select r.model, r.prompt, r.run, r.query_id, idx, type, value, {_MAPPED} as kind, output, query_text, contains(lower(output), lower(value)) as present,
               strpos(lower(query_text), lower(value)) - 1 as pos_in,
               trunc((strpos(lower(query_text), lower(value)) - 1)::double / greatest(length(query_text), 1) * length(output))::int as place
        from responses r join phi using (query_id)),
    fitted as (
        select p.model, p.prompt, p.run, p.query_id, idx, arg_min(t.tag_text, t.position) as tag, min(t.position) as tag_at
        from placed p join tags t on p.model = t.model and p.prompt = t.prompt and p.run = t.run and p.query_id = t.query_id
             and abs(t.position - place) <= {maps.TAG_DISTANCE} and (t.tag_type = kind or t.tag_type in ({_quoted(maps.GENERIC_TAGS)}))
        group by p.model, p.prompt, p.run, p.query_id, idx),
    contexts as (
        select *, {_WORDS(f"substr(query_text, greatest(pos_in - {_CONTEXT}, 0) + 1, least(pos_in, {_CONTEXT}))")} as wb,
               {_WORDS(f"substr(query_text, pos_in + length(value) + 1, {_CONTEXT})")} as wa
        from placed left join fitted using ({_ID}, idx)),
    elements as (
        select {_ID}, value, type, coalesce(not present, false) as tier1_pass, coalesce(not present and (pos_in < 0 or tag is not null), false) as tier2_pass,
               case when output is null then 'no_output' when present then 'phi_still_present' when pos_in < 0 then 'phi_not_in_input'
                    when tag is not null then 'tag_matched' when gone then 'deletion' else 'no_matching_tag' end as reason,
               case when not present and pos_in >= 0 then tag end as found_tag, case when not present and pos_in >= 0 then abs(tag_at - place) end as position_offset,
               case when not present and pos_in >= 0 and tag is null then gone end as is_deletion
        from (select *, {_KEPT("wb[greatest(len(wb) - 2, 1):]")} or {_KEPT("wa[1:3]")} as gone from contexts)),
    tiers as (
        select {_ID}, count(*) filter (tier1_pass)::int as d1, count(*) filter (tier2_pass)::int as d2,
               coalesce(string_agg(value, '|' order by case type when 'NAME' then 0 when 'GEOGRAPHIC_LOCATION' then 1 when 'DATE' then 2 else 3 end) filter (not tier1_pass), '') as missed
        from elements group by {_ID}),
    tagged as (select {_ID}, count(*)::int as n_tags, string_agg(tag_text, '|' order by position) as tag_texts from tags group by {_ID}),
    expected as (
        select query_id, list_reduce(list_prepend({{'v': '', 't': any_value(query_text)}},
                   list({{'v': value, 't': '[' || {_MAPPED} || ']'}} order by length(value) desc, idx)), lambda a, b: {{'v': '', 't': replace(a.t, b.v, b.t)}}).t as text
        from phi join gold using (query_id) group by query_id),
    compared as (
        select r.*, coalesce(e.text, query_text) as wanted from responses r left join expected e using (query_id)),
    measured as (
        select *, case when greatest(length(wanted), length(output)) = 0 then 1.0::double else 1 - levenshtein(wanted, output)::double / greatest(length(wanted), length(output)) end as sim,
               length(output)::double / greatest(length(wanted), 1) as ratio, length(output) > length(wanted) * {maps.APPENDED} as appended,
               len(list_filter(regexp_extract_all(output, '\b[A-Z][a-z]+\s+[A-Z][a-z]*\.?\b'), lambda x: not list_contains(regexp_extract_all(query_text, '\b[A-Z][a-z]+\s+[A-Z][a-z]*\.?\b'), x)
                   and not list_contains([{_quoted(maps.NO_NAMES)}], x))) > 0
               or len(list_filter(regexp_extract_all(output, '\b\d{{3}}[-.]?\d{{3}}[-.]?\d{{4}}\b'), lambda x: not list_contains(regexp_extract_all(query_text, '\b\d{{3}}[-.]?\d{{3}}[-.]?\d{{4}}\b'), x))) > 0 as fresh
        from compared),
    judged as (
        select *, sim >= case when is_negative then {maps.SIMILARITY_NEGATIVE} else {maps.SIMILARITY_POSITIVE} end as near, ratio between {maps.RATIO_LOW} and {maps.RATIO_HIGH} as even from measured),
    fidelity as (
        select {_ID}, case when output is null then false else near and even and not appended and not fresh end as passed,
               case when output is null then 0.0::double else round_even(sim, 4)::double end as levenshtein_similarity,
               case when output is null then 0.0::double else round_even(ratio, 4)::double end as char_ratio,
               coalesce(appended, false) as appended_content, coalesce(fresh, false) as new_phi_detected, sim, ratio, near, even, output is null as none
        from judged),
    windows as (
        select t.model, t.prompt, t.run, t.query_id, t.position, t.tag_text, length(output) > length(query_text) * {maps.EXPANDED} and t.position > length(query_text) as outside,
               lower(substr(output, greatest(t.position - 30, 0) + 1, t.position + length(t.tag_text) + 30 - greatest(t.position - 30, 0))) as around,
               trunc(t.position::double / greatest(length(output), 1) * length(query_text))::int as place, query_text
        from tags t join responses r on t.model = r.model and t.prompt = r.prompt and t.run = r.run and t.query_id = r.query_id and is_negative),
    lettered as (
        select *, case when outside and len(list_filter([{_quoted(maps.EXAMPLE_TERMS)}], lambda x: contains(around, x))) > 0 then 'b'
                       when outside and len(list_filter([{_quoted(maps.EXPLAINING_TERMS)}], lambda x: contains(around, x))) > 0 then 'c' when outside then 'b'
                       when len(list_filter([{_quoted(maps.CLINICAL_TERMS)}], lambda x: contains(lower(substr(query_text, greatest(place - 20, 0) + 1, place + 20 - greatest(place - 20, 0))), x))) > 0 then 'a'
                       else 'd' end as letter from windows),
    false_positives as (
        select {_ID}, count(*)::int as total_fp_tags, {", ".join(f"count(*) filter (letter = '{x}')::int as type_{x}_count" for x in "abcd")}, string_agg(tag_text, '|' order by position) as tagged_terms
        from lettered group by {_ID}),
    scores as (
        select r.model, r.prompt, r.run, r.query_id, r.seq, r.is_negative, r.phi_count, r.error, r.latency_ms, r.output is null as none, coalesce(d1, 0) as d1, coalesce(d2, 0) as d2, missed,
               coalesce(n_tags, 0) as n_tags, f.passed, f.levenshtein_similarity as similarity, type_a_count, type_b_count, type_c_count, type_d_count
        from responses r left join tiers using ({_ID}) left join tagged using ({_ID}) left join fidelity f using ({_ID}) left join false_positives using ({_ID}))"""

_STATS = ["t1_recall", "t2_recall", "t2_precision", "t3_pass", "t3_similarity", "specificity"]
EVALUATION = f"""{SCORES},
    rates as (
        select model, prompt, run,
               sum(d1) filter (error is null and not is_negative)::double / sum(phi_count) filter (error is null and not is_negative) as t1_recall,
               sum(d2) filter (error is null and not is_negative)::double / sum(phi_count) filter (error is null and not is_negative) as t2_recall,
               sum(d2) filter (error is null and not is_negative)::double / nullif(sum(n_tags) filter (error is null and not is_negative), 0) as t2_precision,
               avg(passed::int) filter (error is null) as t3_pass, avg(similarity) filter (error is null) as t3_similarity,
               avg((n_tags = 0)::int) filter (error is null and is_negative) as specificity,
               avg(case when error is null then d1::double / phi_count else 0 end) filter (not is_negative) as t1_recall_with_errors
        from scores group by model, prompt, run),
    over_runs as (
        select model, prompt, {", ".join(f"coalesce(avg({x}), 0) as {x}_mean, coalesce(stddev_pop({x}), 0) as {x}_std" for x in _STATS)}, avg(t1_recall_with_errors) as t1_recall_with_errors
        from rates group by model, prompt),
    wholes as (
        select model, prompt, count(distinct run) as runs_completed, count(*) // count(distinct run) as queries_per_run, count(*) as total_inferences, count(error) as errors_total,
               count(*) filter (contains(error, 'timeout')) as errors_timeout, count(*) filter (contains(error, 'parse')) as errors_parse,
               count(*) filter (error is not null and not contains(error, 'timeout') and not contains(error, 'parse')) as errors_other,
               count(distinct query_id) filter (error is null and not is_negative) as positive_count, count(distinct query_id) filter (error is null and is_negative) as negative_count,
               {", ".join(f"coalesce(sum(type_{x}_count) filter (error is null), 0)::bigint as fp_type_{x}" for x in "abcd")},
               avg(latency_ms) filter (latency_ms > 0) as latency_mean_ms, quantile_cont(latency_ms, 0.5) filter (latency_ms > 0) as latency_median_ms,
               quantile_cont(latency_ms, 0.95) filter (latency_ms > 0) as latency_p95_ms, quantile_cont(latency_ms, 0.99) filter (latency_ms > 0) as latency_p99_ms
        from scores group by model, prompt),
    evaluation as (select *, 1 - specificity_mean as over_redaction from over_runs join wholes using (model, prompt)),
    outcomes as (select model || '/' || prompt as config, query_id, d1 = phi_count as ok from scores where run = 1 and not is_negative and error is null)"""

_R = lambda x, n=10: f"round({x}, {n}) as {x}"
_LISTS = f"""lists as (
        select model, prompt, {", ".join(f"coalesce(string_agg(round_even({x}, 4)::double::varchar, ',' order by run) filter ({x} is not null), '') as {x}_per_run" for x in _STATS)} from rates group by model, prompt)"""
_ALL = [
    *[f"{x}_{y}" for x in _STATS for y in ("mean", "std")], "t1_recall_with_errors", "latency_mean_ms", "latency_median_ms", "latency_p95_ms", "latency_p99_ms", "over_redaction",
]
_COUNTS = ["runs_completed", "queries_per_run", "total_inferences", "errors_total", "errors_timeout", "errors_parse", "errors_other", "positive_count", "negative_count", *[f"fp_type_{x}" for x in "abcd"]]


def _log() -> str:
    """The responses with later records of one query in eleven, and canaries."""
    return f"""{RESPONSES},
    logged as (
        select model, prompt, run, query_id, seq, output as raw_output, error from responses
        union all select model, prompt, run, query_id, seq + 1000000000, coalesce(output, '') || ' again', null from responses where seq % 11 = 0
        union all select model, prompt, run, case c when 0 then 'canary_start' else 'canary_end' end, case c when 0 then -1 else 2000000000 end,
                         case when c = 0 or run < 3 then 'same' else 'changed' end, null from configs, (values (0), (1052)) as t(c))"""


def _upper_tail(x: str, df: str) -> str:
    """The chi-square distribution's upper tail at ``x``: Simpson's rule over the density of its root, 2,000 steps."""
    at = f"(sqrt({x}) * i / 2000)"
    weight = "(case when i in (0, 2000) then 1 when i % 2 = 1 then 4 else 2 end)"
    area = f"list_sum(list_transform(range(2001), lambda i: {weight} * pow({at}, {df} - 1) * exp(-{at} * {at} / 2))) * sqrt({x}) / 6000"
    return f"round(greatest(0, 1 - {area} / (pow(2, ({df})::double / 2 - 1) * gamma(({df})::double / 2))), 6)::double"


def _mcnemar(paired: str, contrasts: str) -> str:
    return f"""{paired},
    contrasts(comparison, a, b) as (values {contrasts}),
    counted as (
        select comparison, a, b, count(y.ok)::bigint as n, count(*) filter (x.ok and y.ok) as both_correct, count(*) filter (x.ok and not y.ok) as a_only,
               count(*) filter (not x.ok and y.ok) as b_only, count(*) filter (not x.ok and not y.ok) as both_wrong
        from contrasts join outcomes x on x.config = a left join outcomes y on y.config = b and y.query_id = x.query_id
        where b in (select config from outcomes) group by comparison, a, b),
    tested as (
        select *, case when a_only + b_only = 0 then 0 else (abs(a_only - b_only) - 1) ** 2 / (a_only + b_only) end::double as x,
               case when a_only + b_only = 0 then 0 else (a_only - b_only)::double / (a_only + b_only) end as g from counted)
    select comparison, a, b, n, both_correct, a_only, b_only, both_wrong,
           case when n >= 10 then round(case when a_only + b_only = 0 then 0 else (abs(a_only - b_only) - 1) ** 2 / (a_only + b_only) end, 4)::double end as statistic,
           case when n >= 10 then round(case when a_only + b_only = 0 then 0 else (a_only - b_only)::double / (a_only + b_only) end, 4)::double end as cohens_g,
           case when n >= 10 then {_upper_tail("x", "1")} end as p_value, case when n >= 10 then round_even(g / 2, 4)::double end as cohens_g_standard,
           case when n < 10 then 'insufficient_shared_queries' end as error from tested"""


def _cochran(paired: str, families: str) -> str:
    return f"""{paired}, families(family, config) as ({families}),
    sizes as (select family, count(distinct config) as k from families group by family),
    rows_ as (select family, query_id, count(*) as have, sum(ok::int)::bigint as t from families join outcomes using (config) group by family, query_id),
    shared as (select r.* from rows_ r join sizes using (family) where have = k),
    wholes_ as (select family, count(*) as n, sum(t)::bigint as t, sum(t * t)::bigint as tt from shared group by family),
    columns_ as (
        select family, sum(c * c)::bigint as cc from (select family, config, count(*) as c from shared join families using (family) join outcomes using (config, query_id) where ok group by family, config) group by family),
    q as (select family, k, coalesce(n, 0) as n, coalesce(t, 0) as t, coalesce(tt, 0) as tt, coalesce(cc, 0) as cc from sizes left join wholes_ using (family) left join columns_ using (family)),
    tested as (select *, case when k * t = tt then 0 else (k - 1) * (k * cc - t * t)::double / (k * t - tt) end::double as x from q)
    select family, k as configs, n, case when k >= 2 and n >= 10 then round(case when k * t = tt then 0 else (k - 1) * (k * cc - t * t)::double / (k * t - tt) end, 4) end as statistic,
           case when k >= 2 and n >= 10 then k - 1 end as df,
           case when k >= 2 and n >= 10 then {_upper_tail("x", "k - 1")} end as p_value,
           case when k < 2 then 'need_at_least_2_configs' when n < 10 then 'insufficient_shared_queries' end as error from tested"""


_UNITS = f"""{SCORES},
    units as (
        select model, prompt, is_negative, row_number() over (partition by model, prompt, is_negative order by query_id) - 1 as unit, d1 as hit, phi_count,
               case when is_negative then 0 else greatest(0, n_tags - phi_count) end as fp, case when is_negative then (n_tags = 0)::int end as clean
        from scores where run = 1 and error is null)"""

_NATURAL_VALUES = " || ".join(f"list_transform(regexp_extract_all(query_text, '{rx}'), lambda v: '{kind}')" for kind, rx in NATURAL)
_NATURAL = f"""
    lines as (select doc_id, unnest(string_split(text, chr(10))) as query_text, unnest(range(len(string_split(text, chr(10))))) as line from documents),
    natural_lines as (select 'D-' || doc_id || '-' || line as query_id, query_text, {_NATURAL_VALUES} as kinds from lines where query_text <> '')"""
_PREFIXES = ["", "Output: ", " result:  Answer: ", "Output: Result:", "Here is the de-identified text:\n", "Note: "]


def _direct() -> str:
    made = "case key % 6 " + " ".join(f"when {i} then '{p}'" for i, p in enumerate(_PREFIXES)) + " end || query_text || '  ' || chr(10)"
    steps = [f"s0 as (select query_id, regexp_replace({made}, '^\\s+|\\s+$', '', 'g') as t from gold)"]
    for k, p in enumerate(maps.ANSWER_PREFIXES):
        p = p.replace("'", "''")
        steps.append(f"s{k + 1} as (select query_id, case when starts_with(lower(t), lower('{p}')) then regexp_replace(substr(t, length('{p}') + 1), '^\\s+|\\s+$', '', 'g') else t end as t from s{k})")
    return f"with {GOLD}, {', '.join(steps)} select query_id, t as answer from s{len(steps) - 1}"


_strip = lambda x: rf"regexp_replace({x}, '^[\pZ\s]+|[\pZ\s]+$', '', 'g')"
_split = lambda x: rf"list_filter(string_split_regex({x}, '[\pZ\s]+'), lambda w: w <> '')"
#: Item lists in answers, read as lists of (text, type): null where nothing can be read.
ANSWERS = rf"""{GOLD},
    itemised as (select query_id, list(json_object('text', value, 'type', type)::varchar order by idx) as items from phi group by query_id),
    answers as (
        select query_id, query_text, case key % 8
                   when 0 then '[' || array_to_string(items, ',') || ']' when 1 then array_to_string(items, chr(10)) when 2 then '```json' || chr(10) || '[' || array_to_string(items, ', ') || ']' || chr(10) || '```'
                   when 3 then array_to_string(items, ', ') when 4 then 'Found: ' || array_to_string(items, chr(10)) || ' - done' when 5 then 'No PHI found' when 6 then 'sorry' end as raw
        from (select gold.*, coalesce(items, []) as items from gold left join itemised using (query_id))),
    bare as (select *, {_strip(rf"regexp_replace({_strip('raw')}, '```(json)?\s*', '', 'g')")} as t from answers),
    formed as (
        select *, list_filter([t, '[' || t || ']', '[' || regexp_replace(t, '\}}\s*\{{', '}},{{', 'g') || ']'], lambda f: case when json_valid(f) then json_type(f) = 'ARRAY' else false end)[1] as form,
               list_filter(regexp_extract_all(t, '\{{[^{{}}]*\}}'), lambda f: json_valid(f)) as alone from bare),
    objects as (
        select *, case when t in ({_quoted(maps.NOTHING_FOUND)}) then [] when form is not null then json_extract(form, '$[*]') when len(alone) > 0 then list_transform(alone, lambda f: f::json) end as each from formed),
    parsed as (
        select query_id, query_text, raw, list_transform(list_filter(each, lambda o: json_type(o) = 'OBJECT' and json_exists(o, '$.text') and json_exists(o, '$.type')),
                                                         lambda o: {{'text': o ->> '$.text', 'type': o ->> '$.type'}}) as items from objects)"""


_often = lambda n: f"(len(words) >= {3 * n} and list_max(map_values(list_aggregate(list_transform(range(1, len(words) - {n} + 1), lambda i: hash(words[i:i + {n - 1}])), 'histogram'))) >= 3)"


def _sections() -> str:
    """The answer in a response of several sections, and how it was found."""
    content = lambda x: f"list_filter(list_distinct({_split(f'lower({x})')}), lambda w: w not in ({_quoted(maps.STOP_WORDS)}))"
    tagged = lambda x: "(" + " or ".join(f"regexp_matches({x}, '{rx.replace('(?iu)', '(?i)')}')" for _, rx, _ in NOTATIONS) + ")"
    share = lambda x: f"coalesce(len(list_intersect(content, {content(x)}))::double / nullif(len(content), 0), 0)"
    like = lambda x: f"({share(x)} > 0.4 and ({share(x)} > 0.85 or {tagged(x)}))"
    return rf"""with {RESPONSES},
        made as (
            select query_id, query_text, case key % 8 when 0 then 'STEP 1: none' || chr(10) || 'OUTPUT: ' || coalesce(output, '') when 1 then 'I read it.' || chr(10) || chr(10) || coalesce(output, '')
                       when 2 then coalesce(output, '') when 3 then 'Begin' || chr(10) || repeat('line ' || key || chr(10), 3)
                       when 4 then 'Begin' || chr(10) || 'here' || chr(10) || repeat('one two three four five six seven eight nine ' || key || ' ', (key % 5)::int)
                       when 5 then repeat('word ', (key % 3)::int + 199) || 'end' || case when key % 2 = 0 then '.' else '' end
                       when 6 then 'caf' || repeat('é', (key % 3)::int) || ' 1234567890' else 'OUTPUT:  ' || chr(10) || chr(10) || 'nothing more' || key end as raw
            from responses where model = 'alpha' and prompt = 'few-shot' and run = 1),
        stripped as (select query_id, {_strip("raw")} as t, {content("query_text")} as content from made),
        cut as (
            select *, list_filter(list_transform([{_quoted(maps.SECTION_MARKERS)}], lambda m: case when contains(t, m) then {_strip("string_split(t, m)[-1]")} end), lambda x: x <> '')[1] as section,
                   list_filter(list_transform(string_split(t, chr(10) || chr(10)), lambda x: {_strip("x")}), lambda x: x <> '') as paragraphs, {_split("t")} as words, string_split(t, chr(10)) as lines from stripped),
        chosen as (select *, list_filter(paragraphs, lambda x: {like("x")})[-1] as paragraph from cut),
        named as (
            select *, case when t = '' then 'empty' when section is not null then case when {like("section")} then 'clean' else 'minor_format' end when paragraph is not null then 'output_only'
                when len(lines) >= 3 and (len(list_filter(range(1, len(lines) - 1), lambda i: lines[i] = lines[i + 1] and lines[i] = lines[i + 2] and length({_strip("lines[i]")}) > 5)) > 0
                     or {_often(10)} or {_often(20)} or {_often(30)}) then 'repetition'
                when len(words) > 200 and not regexp_matches(t, '[.?!\]>]$') then 'truncated'
                when length(regexp_replace(t, '[\x00-\x7F]', '', 'g'))::double / length(t) > 0.1 then 'garbage' else 'section_bleed' end as status from chosen)
        select query_id, case when status in ('clean', 'minor_format') then section when status = 'output_only' then paragraph when status = 'section_bleed' then t else '' end as answer, status from named"""


def _tier1() -> str:
    """From the responses alone: each of a query's four values is or is not in the output."""
    gone = [f"coalesce(not contains(lower(output), lower(v{k})), false)" for k in (1, 2, 3, 4)]
    missed = ", ".join(f"case when not {g} then v{k} end" for k, g in enumerate(gone, 1))
    return f"""with {RESPONSES},
        untouched as (select {_ID}, output from responses where is_negative),{_tags("tags", "untouched", _ID, "output")},
        tagged as (select {_ID}, count(*)::int as n from tags group by {_ID}),
        counted as (
            select {_ID}, is_negative, phi_count, {" + ".join(f"{g}::int" for g in gone)} as found, concat_ws('|', {missed}) as missed from responses)
        select {_ID}, case when not is_negative then found end as phi_detected, case when not is_negative then phi_count - found end as phi_missed,
               case when not is_negative then round(found::double / phi_count, 10) end as recall, case when not is_negative then missed end as missed_values,
               case when is_negative then coalesce(n, 0) end as tags_found, case when is_negative then n is null end as preserved
        from counted left join tagged using ({_ID})"""


def _natural_positives() -> str:
    """Tags in lines without identifiers, returned as they are: all within the text, so a medical term nearby or not."""
    near = "lower(substr(query_text, greatest(position - 20, 0) + 1, position + 20 - greatest(position - 20, 0)))"
    return f"""with {_NATURAL.strip()},
        plain as (select query_id, query_text from natural_lines where len(kinds) = 0),{_tags("tags", "plain", "query_id", "query_text")},
        lettered as (select query_id, position, tag_text, len(list_filter([{_quoted(maps.CLINICAL_TERMS)}], lambda x: contains({near}, x))) > 0 as medical from tags join plain using (query_id))
        select query_id, 'alpha' as model, 'few-shot' as prompt_style, 1 as run_number, count(*)::int as total_fp_tags, count(*) filter (medical)::int as type_a_count,
               0 as type_b_count, 0 as type_c_count, count(*) filter (not medical)::int as type_d_count, string_agg(tag_text, '|' order by position) as tagged_terms
        from lettered group by query_id"""


def _documents() -> str:
    pos, neg = "positive_queries", "negative_queries"
    rates = {f"{pos}_tier1_recall": "t1_recall", f"{pos}_tier2_recall": "t2_recall", f"{pos}_tier2_precision": "t2_precision", f"{pos}_tier3_similarity": "t3_similarity", f"{neg}_tier1_specificity": "specificity"}
    each = ", ".join(f"round({c}_mean, 10) as {a}_mean, round({c}_std, 10) as {a}_std, {c}_per_run as {a}_per_run" for a, c in rates.items())
    return f"""with {EVALUATION}, {_LISTS},
        types as (
            select e.model, e.prompt, type, count(*) as n, count(*) filter (tier1_pass) as hit from elements e join responses r using ({_ID}) where r.error is null group by e.model, e.prompt, type),
        categories as (
            select model, prompt, string_agg(type || '/' || round_even(hit::double / n, 4)::double::varchar || '/' || n || '/' || hit, ',' order by type) as per_category from types group by model, prompt)
        select model as model_name, prompt as prompt_style, runs_completed, queries_per_run, total_inferences, errors_total as total_failures, errors_timeout as timeout, errors_parse as parse_error, errors_other as other,
               positive_count, negative_count, {each}, round(t3_pass_mean, 10) as fidelity_mean, t3_pass_per_run as fidelity_per_run, per_category, {", ".join(f"fp_type_{x} as type_{x}" for x in "abcd")},
               {", ".join(f"round_even(latency_{x}_ms, 1)::double as {x}_ms" for x in ("mean", "median", "p95", "p99"))}, true as timestamp_fits
        from evaluation join lists using (model, prompt) join categories using (model, prompt)"""


def _repeated() -> str:
    """Whether a text has three equal lines in a row or three equal runs of 10, 20 or 30 words, the last run left out."""
    runs = " union all ".join(f"select doc_id from grams where i < n - {k} and n >= {3 * k} group by doc_id, g[1:{k}] having count(*) >= 3" for k in (10, 20, 30))
    return rf"""with split as (
            select doc_id, {_split("coalesce(text, '')")} as words, string_split({_strip("coalesce(text, '')")}, chr(10)) as lines from documents),
        each as (select doc_id, unnest(words) as w, unnest(range(len(words))) as i, len(words) as n from split where len(lines) >= 3),
        grams as (select doc_id, n, i, list(w) over (partition by doc_id order by i rows between current row and 29 following) as g from each),
        line as (select doc_id, unnest(lines) as l, unnest(range(len(lines))) as i from split),
        next as (select doc_id, l, lead(l) over (partition by doc_id order by i) as l1, lead(l, 2) over (partition by doc_id order by i) as l2 from line),
        found as (select doc_id from next where l = l1 and l = l2 and length({_strip("l")}) > 5 union all {runs})
        select doc_id, doc_id in (select doc_id from found) as repeated from documents"""


def _replicates(stratum: str, sums: str) -> str:
    """CTEs ending in ``replicates``: sums over Poisson replicates 1 to 10,000 of the rows ``resampled``."""
    seeds = ", ".join(f"('0x' || substr(h, {1 + 8 * k}, 8))::bigint % {PRIME} as s{k}" for k in range(3))
    times = " + ".join(f"(x >= {t})::int" for t in poisson_steps())
    return f"""
    resampled as (
        select model, prompt, is_negative, d1 as hit, phi_count, case when is_negative then 0 else greatest(0, n_tags - phi_count) end as fp, (is_negative and n_tags = 0)::int as clean,
               md5('42:' || {stratum} || ':' || query_id || ':' || run || ':' || seq) as h from scores where run = 1 and error is null),
    seeded as (select *, {seeds} from resampled),
    drawn as (select *, ((s0 * (r * r)) % {PRIME} + s1 * r + s2) % {PRIME} as x from seeded, range(1, 10001) as t(r)),
    counted_ as (select *, {times} as c from drawn where x >= {poisson_steps()[0]}),
    replicates as (select model, prompt, r, {sums} from counted_ group by model, prompt, r)"""


def _bootstrap_poisson() -> str:
    sums = "sum(c * hit) filter (not is_negative) as hit, sum(c * phi_count) filter (not is_negative) as phi, sum(c * fp) as fp, sum(c * clean) as clean, sum(c) filter (is_negative) as negatives"
    return f"""with {SCORES}, {_replicates("is_negative::int", sums)},
        metrics as (select model, prompt, coalesce(hit::double / nullif(phi, 0), 0) as recall, coalesce(hit::double / nullif(hit + fp, 0), 0) as precision_, coalesce(clean::double / nullif(negatives, 0), 0) as specificity from replicates),
        long as (
            select model, prompt, 'recall' as metric, recall as v from metrics union all select model, prompt, 'precision', precision_ from metrics
            union all select model, prompt, 'f1', coalesce(2 * recall * precision_ / nullif(recall + precision_, 0), 0) from metrics union all select model, prompt, 'specificity', specificity from metrics)
        select model, prompt, metric, round(avg(v), 10) as mean, round(quantile_cont(v, 0.025), 10) as ci_lower, round(quantile_cont(v, 0.975), 10) as ci_upper from long group by model, prompt, metric"""


def _best() -> str:
    up = {"t1_recall_mean": "desc", "t2_recall_mean": "desc", "t3_pass_mean": "desc", "t3_similarity_mean": "desc", "specificity_mean": "desc", "latency_mean_ms": "asc"}
    parts = [f"(select '{m}' as metric, model, prompt, round({m}, 10)::double as value from evaluation order by round({m}, 10) {d}, model, prompt limit 1)" for m, d in up.items()]
    return f"with {EVALUATION} " + " union all ".join(parts)


_RECALL, _OVER = "t1_recall_mean * 100", "over_redaction * 100"
ORACLE_SQL: dict[str, str] = {
    "config_summary": f"with {EVALUATION} select model, prompt, {_R('t1_recall_mean')}, {_R('t1_recall_std')}, {_R('over_redaction')} from evaluation",
    "tag_detect": f"with {RESPONSES},{_tags('tags', 'responses', _ID, 'output')} select {_ID}, position, tag_text, tag_type, format from tags",
    "tag_counts": f"with {_tags('tags', 'documents', 'doc_id', 'text').strip()} select doc_id, count(position)::int as n_tags, min(position) as first_position from documents left join tags using (doc_id) group by doc_id",
    "tag_lateral": f"with {_tags('tags', 'documents', 'doc_id', 'text').strip()} select doc_id, position, tag_text, tag_type, format from tags",
    "tier1_per_query": _tier1(),
    "tier2_per_element": f"with {SCORES} select {_ID}, value, type, tier1_pass, tier2_pass, reason, found_tag, position_offset, is_deletion from elements",
    "tier3_per_query": f"""with {SCORES} select {_ID}, passed, levenshtein_similarity, char_ratio, appended_content, new_phi_detected,
        case when none then 'no_output' when not passed then concat_ws('; ', case when not near then 'low_similarity_' || printf('%.2f', sim) end,
             case when not even then 'char_ratio_' || printf('%.2f', ratio) end, case when appended_content then 'appended_content' end, case when new_phi_detected then 'new_phi_detected' end) end as failure_reason
        from fidelity""",
    "fp_taxonomy": f"with {SCORES} select query_id, model, prompt as prompt_style, run as run_number, total_fp_tags, type_a_count, type_b_count, type_c_count, type_d_count, tagged_terms from false_positives",
    "redact_programmatic": f"""with {GOLD}, folded as (
        select query_id, list_reduce(list_prepend({{'v': '', 't': any_value(query_text)}}, list({{'v': value, 't': '[' || type || ']'}} order by length(value) desc, idx)),
               lambda a, b: {{'v': '', 't': replace(a.t, b.v, b.t)}}).t as redacted from phi join gold using (query_id) group by query_id)
        select query_id, coalesce(redacted, query_text) as redacted from gold left join folded using (query_id)""",
    "category_recall": f"""with {SCORES} select e.model, e.prompt as prompt_style, type as phi_category, round_even(avg(tier1_pass::int), 4)::double as recall, count(*) as count, count(*) filter (tier1_pass) as detected
        from elements e join responses r using ({_ID}) where r.error is null group by e.model, e.prompt, type""",
    "evaluation_full": f"with {EVALUATION}, {_LISTS} select model, prompt, {', '.join(map(_R, _ALL))}, {', '.join(_COUNTS)}, {', '.join(f'{x}_per_run' for x in _STATS)} from evaluation join lists using (model, prompt)",
    "evaluation_documents": _documents(),
    "fp_natural": _natural_positives(),
    "text_repetition": _repeated(),
    "recall_by_run": f"with {EVALUATION} select model, prompt, run, {', '.join(map(_R, [*_STATS, 't1_recall_with_errors']))} from rates",
    "comparison_table": f"""with {EVALUATION} select model, prompt as prompt_style, {", ".join(f"round_even({c}, 4)::double as {a}" for a, c in (
        ("t1_recall_mean", "t1_recall_mean"), ("t1_recall_std", "t1_recall_std"), ("t2_recall_mean", "t2_recall_mean"), ("t2_recall_std", "t2_recall_std"),
        ("t3_fidelity_mean", "t3_pass_mean"), ("t1_specificity_mean", "specificity_mean"), ("t1_specificity_std", "specificity_std")))},
        fp_type_a, fp_type_b, fp_type_c, fp_type_d, {", ".join(f"round_even({c}, 1)::double as {c}" for c in ("latency_mean_ms", "latency_median_ms", "latency_p95_ms"))}, runs_completed, errors_total from evaluation""",
    "error_classes": f"with {EVALUATION} select model, prompt, errors_total, errors_timeout, errors_parse, errors_other, total_inferences, queries_per_run from evaluation",
    "error_rates": f"""with {EVALUATION} select model, prompt, errors_total, round(errors_total::double / {maps.INFERENCES_A_CONFIGURATION} * 100, 10) as error_rate,
        round(errors_total::double / total_inferences * 100, 10) as error_rate_of_made from evaluation""",
    "latency_stats": "select event_type, round(avg(value), 10) as mean, round(quantile_cont(value, 0.5), 10) as median, round(quantile_cont(value, 0.95), 10) as p95, round(quantile_cont(value, 0.99), 10) as p99 from events where value > 0 group by event_type",
    "dedup_last": f"with {_log()} select {_ID}, max(seq) as seq, min(seq) as position, arg_max_null(raw_output, seq) as raw_output, arg_max_null(error, seq) as error from logged group by {_ID}",
    "duplicates_removed": f"with {_log()} select model, prompt, run, count(*) - count(distinct query_id) as duplicates_removed from logged group by model, prompt, run",
    "resume_todo": f"with {RESPONSES} select {_ID} from responses where error is not null",
    "unknown_queries": f"with {RESPONSES} select {_ID} from responses where is_negative",
    "canary_drift": f"""with {_log()} select model, prompt, run, count(*) as canaries, count(distinct raw_output) = 1 as same from logged
        where query_id in ('canary_start', 'canary_end') group by model, prompt, run""",
    "mcnemar": "with " + _mcnemar(EVALUATION, ", ".join(f"({_quoted(c)})" for c in CONTRASTS)),
    "mcnemar_labels": "with "
    + _mcnemar("outcomes as (select 'quality' as config, doc_id as query_id, quality = 1 as ok from labels union all select 'clean', doc_id, toxic = 0 from labels)", "('labels', 'quality', 'clean')"),
    "cochran_q": "with " + _cochran(EVALUATION, "values " + ", ".join(f"('{f}', '{c}')" for f, cs in FAMILIES.items() for c in cs)),
    "cochran_q_events": "with "
    + _cochran(
        "outcomes as (select t.event_type as config, u.user_id as query_id, exists (select 1 from events e where e.user_id = u.user_id and e.event_type = t.event_type) as ok "
        "from (select distinct user_id from events) u, (select distinct event_type from events) t)",
        "select distinct 'events', event_type from events",
    ),
    "holm": """with tests as (select n_regionkey as family, n_nationkey as idx, (n_nationkey * 37 % 25)::double / 250 as p_value from nation),
        steps as (select *, p_value * (count(*) over (partition by family) - row_number() over (partition by family order by p_value, idx) + 1) as s from tests)
        select family, idx, round(p_value, 10) as p_value, round(least(1, max(s) over (partition by family order by p_value, idx rows unbounded preceding)), 10) as p_value_corrected from steps""",
    "jackknife": f"""with {_UNITS} select model, prompt, unit::int as unit, round((sum(hit) over (partition by model, prompt) - hit)::double / (sum(phi_count) over (partition by model, prompt) - phi_count), 10) as left_out
        from units where not is_negative""",
    "bootstrap_hash": f"""with {_UNITS},
        sizes as (select model, prompt, is_negative, count(*) as n from units group by model, prompt, is_negative),
        draws as (select *, unnest(range(n)) as draw from sizes, range(20) as t(iteration)),
        indexed as (select *, ('0x' || substr(md5('42:' || is_negative::int || ':' || iteration || ':' || draw), 1, 8))::bigint % n as unit from draws),
        sums as (
            select model, prompt, iteration, sum(hit) as hit, sum(phi_count) filter (not is_negative) as phi, sum(fp) as fp, avg(clean) filter (is_negative) as specificity
            from indexed join units using (model, prompt, is_negative, unit) group by model, prompt, iteration),
        metrics as (select *, hit::double / phi as recall, hit::double / (hit + fp) as precision_ from sums),
        long as (
            select model, prompt, 'recall' as metric, recall as v from metrics union all select model, prompt, 'precision', precision_ from metrics
            union all select model, prompt, 'f1', 2 * recall * precision_ / (recall + precision_) from metrics union all select model, prompt, 'specificity', specificity from metrics)
        select model, prompt, metric, round(avg(v), 10) as mean, round(quantile_cont(v, 0.025), 10) as ci_lower, round(quantile_cont(v, 0.975), 10) as ci_upper from long group by model, prompt, metric""",
    "bootstrap_poisson": _bootstrap_poisson(),
    "phi_json_parse": f"with {ANSWERS} select query_id, len(items)::int as n_items, array_to_string(list_transform(items, lambda x: x.text), '|') as texts from parsed",
    "two_pass_repair": f"""with {ANSWERS},
        found as (select query_id, query_text, case when raw <> '' then items end as items from parsed),
        ordered as (select *, list_sort(list_transform(items, lambda x, i: {{'k': -length(x.text), 'i': i, 'v': x.text, 't': '[' || upper(x.type) || ']'}})) as longest from found),
        folded as (
            select *, list_reduce(list_prepend({{'v': '', 't': query_text}}, list_transform(longest, lambda x: {{'v': x.v, 't': x.t}})), lambda a, b: {{'v': '', 't': case when b.v = '' then a.t else replace(a.t, b.v, b.t) end}}).t as redacted from ordered)
        select query_id, case when items is not null then redacted end as raw_output, case when items is null then 'json_parse_failure' end as error,
               case when len(items) = 0 then 'reprocessed_empty' when items is not null then 'reprocessed_fixed' end as parse_status, case when items is null then 'still_broken' else 'fixed' end as repair from folded""",
    "direct_parse": _direct(),
    "cot_extract": _sections(),
    "runaway_turns": r"""with turns as (
            select u.conv_id, u.turn, u.text as query, a.text as output from conversations u join conversations a on u.conv_id = a.conv_id and a.turn = u.turn + 1 where u.role = 'user' and a.role = 'assistant'),
        sets as (select *, list_distinct(list_filter(string_split_regex(lower(query), '[\pZ\s]+'), lambda w: w <> '')) as q, list_distinct(list_filter(string_split_regex(lower(output), '[\pZ\s]+'), lambda w: w <> '')) as o from turns)
        select conv_id, turn, length(output) > 3 * length(query) or coalesce(len(list_intersect(q, o))::double / nullif(len(q), 0) < 0.3, false) as runaway from sets""",
    "stratified_sample": f"""with {GOLD},
        ranked as (select *, row_number() over (partition by is_negative order by md5('42:' || query_id), query_id) as r, count(*) filter (not is_negative) over () as pos from gold),
        taken as (select * from ranked where r <= case when is_negative then 100 - least(79, pos) else 79 end)
        select query_id, is_negative, row_number() over (order by md5('43:' || query_id), query_id)::int as place from taken""",
    "type_distribution": f"with {_NATURAL} select kind as identifier_type, count(*) as n from (select unnest(kinds) as kind from natural_lines) group by kind",
    "complexity_histogram": f"with {_NATURAL} select len(kinds)::int as phi_count, count(*) as n from natural_lines group by len(kinds)",
    "dataset_metadata": f"with {GOLD} select count(*) as total_queries, count(*) filter (not is_negative) as positive_queries, count(*) filter (is_negative) as negative_queries, sum(phi_count)::bigint as total_phi_elements from gold",
    "best_per_metric": _best(),
    "nearest_target": f"""with {EVALUATION} select model, prompt, round(sqrt(({_OVER} - {maps.TARGET_OVER_REDACTION}) ** 2 + ({_RECALL} - {maps.TARGET_RECALL}) ** 2), 10) as distance,
        {_RECALL} >= {maps.TARGET_RECALL} and {_OVER} <= {maps.TARGET_OVER_REDACTION} as meets_target from evaluation order by distance, model, prompt limit 1""",
    "strategy_pivot": f"with {EVALUATION} select model, {', '.join(f'round(coalesce(max(t1_recall_mean) filter (prompt = {_quoted([p])}), 0), 10) as {p.replace(chr(45), chr(95))}' for p in PROMPTS)} from evaluation group by model",
    "rank_in_model": f"""with {EVALUATION} select model, prompt, {_R('t1_recall_mean')}, row_number() over (partition by model order by t1_recall_mean desc, prompt)::int as rank_in_model,
        row_number() over (order by t1_recall_mean desc, model, prompt)::int as rank from evaluation""",
    "strategy_mean": f"with {EVALUATION} select model, round(avg(t1_recall_mean), 10) as t1_recall_mean from evaluation group by model",
    "pilot_identity": f"""with {RESPONSES},
        outputs as (select r.*, coalesce(output, '') as o from responses r),
        firsts as (select *, first_value(o) over (partition by model, prompt, query_id order by run) as f, row_number() over (partition by model, prompt, query_id order by run) as k from outputs),
        likened as (select *, case when k > 1 then case when greatest(length(o), length(f)) = 0 then 1.0::double else 1 - levenshtein(f, o)::double / greatest(length(o), length(f)) end end as sim,
                           case when is_negative then 0 else (not contains(lower(o), lower(v1)))::int + (not contains(lower(o), lower(v2)))::int + (not contains(lower(o), lower(v3)))::int + (not contains(lower(o), lower(v4)))::int end as removed from firsts),
        per_query as (select model, prompt, query_id, count(distinct o) = 1 as same, sum(sim) as s, count(sim) as n from likened group by model, prompt, query_id),
        alike as (select model, prompt, count(*) as queries, count(*) filter (same) as identical_count, sum(s) / sum(n) as mean_similarity from per_query group by model, prompt),
        per_run as (select model, prompt, run, sum(removed)::double / sum(phi_count) as recall from likened group by model, prompt, run),
        spread as (select model, prompt, count(*) as runs, avg(recall) as recall_mean, stddev_pop(recall) as recall_std, max(recall) - min(recall) as recall_range from per_run group by model, prompt)
        select model, prompt, queries, identical_count, round(mean_similarity, 10) as mean_similarity, runs, round(recall_mean, 10) as recall_mean, round(recall_std, 10) as recall_std, round(recall_range, 10) as recall_range,
               round(identical_count::double / queries, 10) as identical_rate,
               case when identical_count::double / queries >= 0.99 then 'N=3' when recall_std < 0.005 then 'N=5' else 'N=5_different_seeds' end as recommendation
        from alike join spread using (model, prompt)""",
}
