"""DuckDB SQL of the queries that SQL can express, written from their definitions."""

from __future__ import annotations

from . import licenses, mixing, urlfilter

_SPACE_WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"
_ALNUM_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def source_mix() -> str:
    """First fit by recursion over the documents of each source in the order of their hash."""
    a, b, c = mixing.WEIGHTS
    return f"""
    with recursive sized as (
        select doc_id, source, coalesce(len({_SPACE_WORDS}), 0)::bigint as size,
               ('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::varchar, 'null')), 1, 13))::bigint as u
        from documents),
    sources as (
        select source, sum(size)::bigint as source_size,
               case (row_number() over (order by source nulls last) - 1) % 3 when 0 then {a} when 1 then {b} else {c} end as weight
        from sized group by source),
    ordered as (
        select *, {mixing.MAX_EPOCHS} * source_size as cap, sum(source_size) over () as total,
               row_number() over (order by {mixing.MAX_EPOCHS} * source_size / weight, source nulls last) as k
        from sources),
    levels as (
        select *, ((total - coalesce(sum(cap) over (order by k rows between unbounded preceding and 1 preceding), 0))::bigint)::double
                  / (sum(weight) over (order by k rows between current row and unbounded following))::bigint as level
        from ordered),
    chosen as (select level from levels where weight * level <= cap order by k limit 1),
    targets as (
        select source, source_size, least(cap::double, weight * (select level from chosen)) as target from ordered),
    plan as (
        select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as whole from targets),
    units as (
        select source, u, sum(size)::bigint as size, row_number() over (partition by source order by u) as k
        from sized group by source, u),
    walk as (
        select u.source, u.k, u.u, u.size, floor(p.target - p.whole * p.source_size)::bigint as had
        from units u join plan p on u.source is not distinct from p.source where u.k = 1
        union all
        select u.source, u.k, u.u, u.size, case when w.size <= w.had then w.had - w.size else w.had end
        from walk w join units u on u.source is not distinct from w.source and u.k = w.k + 1)
    select s.doc_id, s.size, p.source_size, p.target,
           s.size * (p.whole + case when w.size <= w.had and floor(p.target - p.whole * p.source_size) > 0 then 1 else 0 end) as taken
    from sized s join plan p on s.source is not distinct from p.source
    join walk w on w.source is not distinct from s.source and w.u = s.u
    """


def license_scan() -> str:
    values = ", ".join(
        f"({k}, '{label}', {str(base).lower()}, {at}, {total}, '{' '.join(gram)}')" for k, label, base, at, total, gram in licenses.grams()
    )
    k = licenses.K
    gram = " || ' ' || ".join(f"w[i + {j}]" for j in range(k))
    return f"""
    with words as (select doc_id, coalesce({_ALNUM_WORDS}, []) as w from documents),
    grams(template, label, base, tpos, total, gram) as (values {values}),
    runs as (select doc_id, i - 1 as p, {gram} as gram from (select doc_id, w, unnest(range(1, len(w) - {k - 2})) as i from words)),
    voted as (
        select doc_id, template, label, base, total, p - tpos as diagonal, count(distinct tpos) as votes
        from runs join grams using (gram) group by all),
    marked as (
        select *, case when diagonal - lag(diagonal) over (partition by doc_id, template order by diagonal) <= {licenses.SHIFT} then 0 else 1 end as fresh
        from voted where not base),
    numbered as (select *, sum(fresh) over (partition by doc_id, template order by diagonal) as span from marked),
    spans as (select doc_id, label, least(1.0::double, sum(votes)::bigint::double / total) as covered from numbered group by doc_id, template, label, total, span),
    places as (select doc_id, label, diagonal from voted where base and votes = total),
    based as (
        select doc_id, count(*)::bigint as n_base, min(diagonal)::bigint as first_word, max(diagonal)::bigint as last_word,
               string_agg(distinct label, ',' order by label) as base_labels
        from places group by doc_id),
    best as (select doc_id, max(covered) as covered from spans group by doc_id),
    named as (
        select doc_id, string_agg(distinct label, ',' order by label) as labels
        from (select doc_id, label from places union select doc_id, label from spans where covered >= {licenses.COVERAGE}) group by doc_id)
    select w.doc_id, len(w.w)::bigint as n_words, coalesce(n_base, 0) as n_base, first_word, last_word,
           coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels,
           case when n_base > 0 then 1.0::double else coalesce(covered, 0.0)::double end as score
    from words w left join based using (doc_id) left join best using (doc_id) left join named using (doc_id)
    """


def url_filter() -> str:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in urlfilter.RULES)
    d = urlfilter.DAMPING
    steps = "".join(
        f"""
    r{k + 1} as (
        select b.host, b.good * (1 - {d}::double) + {d}::double * coalesce(sum(r.trust * m.t), 0) as trust,
               b.bad * (1 - {d}::double) + {d}::double * coalesce(sum(r.distrust * m.d), 0) as distrust
        from base b left join moves m on m.b = b.host left join r{k} r on r.host = m.a group by b.host, b.good, b.bad),"""
        for k in range(urlfilter.ROUNDS)
    )
    lower = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    host = rf"translate(regexp_extract({{0}}, '(?s)^.*?://([^/?#]*)', 1), {lower})"
    return rf"""
    with rules(rule_host, rule_path, rule_verdict) as (values {rules}),
    parsed as (
        select page_id, html, {host.format("coalesce(url, '')")} as host,
               regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path from pages),
    fits as (
        select host, path, max_by({{'rule': rule_host || rule_path, 'verdict': rule_verdict}}, length(rule_host || rule_path)) as best
        from (select distinct host, path from parsed) p join rules r
          on (p.host = r.rule_host or ends_with(p.host, '.' || r.rule_host)) and starts_with(p.path, r.rule_path) group by host, path),
    ruled as (select page_id, html, host, path, best.rule as rule, best.verdict as verdict from parsed left join fits using (host, path)),
    hrefs as (
        select host as src, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*["'']?([^"''\s>]+)', 1)) as dest from ruled where host <> ''),
    edges as (
        select src, coalesce(nullif(case when starts_with(dest, '//') then {host.format("'x:' || dest")}
                                         when regexp_matches(dest, '^[A-Za-z][A-Za-z0-9+.-]*://') then {host.format("dest")} end, ''), src) as dst, count(*) as n
        from hrefs group by all),
    moves as (
        select a, b, sum(t) as t, sum(d) as d from (
            select src as a, dst as b, n::double / (sum(n) over (partition by src))::bigint as t, 0.0::double as d from edges
            union all select dst, src, 0.0::double, n::double / (sum(n) over (partition by dst))::bigint from edges) group by a, b),
    seeds as (
        select host, count(*) filter (verdict = 'allow')::double as good, count(*) filter (verdict = 'block')::double as bad
        from ruled where verdict is not null and host <> '' group by host),
    base as (
        select host, coalesce(good, 0.0::double) as good, coalesce(bad, 0.0::double) as bad
        from (select src as host from edges union select dst from edges union select host from seeds) left join seeds using (host)),
    r0 as (select host, good as trust, bad as distrust from base),{steps}
    blocked as (select host from r{urlfilter.ROUNDS} where distrust > {urlfilter.THRESHOLD}::double * (trust + distrust))
    select page_id, host, path, rule,
           coalesce(verdict, case when host in (select host from blocked) then 'block' else 'allow' end) as verdict from ruled
    """


def decontamination(window: int = 10) -> str:
    return f"""
    with docs as (select doc_id, coalesce({_ALNUM_WORDS}, []) as w from documents),
    items as (select item_id::varchar as item, coalesce({_ALNUM_WORDS}, []) as w from benchmark),
    windows as (
        select distinct item, list_slice(w, i, i + n - 1) as g, n
        from (select item, w, least(len(w), {window}) as n, unnest(range(1, greatest(len(w) - {window}, 0) + 2)) as i from items where len(w) > 0)),
    sizes as (select distinct n from windows),
    places as (
        select doc_id, i, n, list_slice(w, i, i + n - 1) as g
        from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from docs, sizes where len(w) >= n)),
    found as (select doc_id, i, n, item from places join windows using (n, g)),
    hit as (select doc_id, count(distinct x) as n_hit from (select doc_id, unnest(range(i, i + n)) as x from found) group by doc_id),
    named as (select doc_id, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as names from found group by doc_id)
    select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
           sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
    from docs left join hit using (doc_id) left join named using (doc_id)
    """


def substring_dedup(width: int = 35) -> str:
    return f"""
    with docs as (select doc_id, coalesce({_SPACE_WORDS}, []) as w from documents),
    windows as (
        select doc_id, i, array_to_string(list_slice(w, i, i + {width - 1}), ' ') as g
        from (select doc_id, w, unnest(range(1, len(w) - {width - 2})) as i from docs)),
    repeated as (select doc_id, i from (select doc_id, i, count(*) over (partition by g) as n from windows) where n > 1),
    hit as (select distinct doc_id, x from (select doc_id, unnest(range(i, i + {width})) as x from repeated)),
    words as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as x from docs),
    kept as (
        select doc_id, string_agg(word, ' ' order by x) as text, count(*) as n
        from words anti join hit using (doc_id, x) group by doc_id)
    select doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(text, '')) as kept_sha256
    from docs left join kept using (doc_id)
    """
