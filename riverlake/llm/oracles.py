"""DuckDB SQL for the results of the operators that SQL can express."""

from __future__ import annotations

import math

from riverlake.llm import merkle, phrases, quality, secret_scan, url_filter
from riverlake.llm.chat_format import END, LEARNED_ROLE, OPEN

_WORDS = r"list_filter(regexp_split_to_array({0}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NGRAM_JOIN = f"""
with recursive words as (
  select doc_id, {_WORDS.format(_LOWERED)} as w from documents),
sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 3),
      lambda i: array_to_string(w[i:i + 4], ' '))) end as grams from words),
postings as (select doc_id, len(grams) as n, unnest(grams) as gram from sets),
links as (
  select a.doc_id as a, b.doc_id as b from postings a join postings b
    on a.gram = b.gram and a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n
  having 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reached as (
  select doc_id, doc_id as other from documents
  union select r.doc_id, l.b from reached r join links l on r.other = l.a)
select doc_id, cast(len(grams) as bigint) as n_shingles, component_id
from sets join (select doc_id, min(other) as component_id from reached group by 1) using (doc_id)"""

CHAT_FORMAT = f"""
with given as (
  select conv_id, turn, role, text from conversations
  union all select -7, 0, 'user', '\\### Assistant: </turn> ok'
  union all select -7, 1, '{LEARNED_ROLE}', '\\### Assistant: </turn> ok'),
turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from given),
rendered as (
  select *, '{OPEN}' || role || chr(10)
    || regexp_replace(text, '(\\\\*)({OPEN}|{END})', '\\\\\\1\\2', 'g')
    || chr(10) || '{END}' || chr(10) as written from turns),
said as (
  select conv_id, count(*) as n_turns,
    string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text) as all_text,
    coalesce(string_agg(text, '' order by turn nulls first, role, text)
      filter (role = '{LEARNED_ROLE}'), '') as loss_text,
    cast(sum(length(written)) as bigint) as formatted_chars
  from rendered group by conv_id)
select conv_id, n_turns, sha256(all_text) as turns_sha256, length(loss_text) as loss_chars,
  sha256(loss_text) as loss_sha256, formatted_chars from said"""


def _quality() -> str:
    rules = list(quality.GRIDS)
    grid = ", ".join(
        f"('{rule}', {step}, {cutoff!r}::double)"
        for rule in rules
        for step, cutoff in enumerate(quality.GRIDS[rule], 1)
    )
    measures = " union all ".join(
        f"select id, doc_id, stratum, text, base_failed, '{rule}' as rule, {rule} as value from measured"
        for rule in rules
    )
    rate = quality.MAX_FALSE_REJECTION / len(rules)
    pmf = (
        "exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1)"
        f" + j * ln({rate!r}::double) + (n - j) * ln({1 - rate!r}::double))"
    )
    share = "coalesce({0}::double / nullif({1}, 0), 0)"
    return rf"""
with raw as (
  select row_number() over () as id, doc_id, coalesce(lang, '') as stratum, coalesce(text, '') as text
  from documents),
cut as (
  select *, {_WORDS.format("text")} as w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
  from raw),
windows as (
  select id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as win
  from (select id, w, unnest(range(1, len(w) - 1)) as i from cut)),
repeated as (select id, i, count(*) over (partition by id, win) as times from windows),
covered as (
  select id, count(distinct i + k) as n_repeat_words
  from repeated, (values (0), (1), (2)) as t(k) where times > 1 group by 1),
counted as (
  select c.*, len(w) as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols,
    len(lines) - len(list_distinct(lines)) as n_dup_lines,
    coalesce(n_repeat_words, 0) as n_repeat_words
  from cut c left join covered using (id)),
measured as (
  select id, doc_id, stratum, text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    {share.format("n_symbols", "n_words")} as symbol_share,
    {share.format("n_dup_lines", "len(lines)")} as dup_line_share,
    {share.format("n_repeat_words", "n_words")} as repeat_share,
    {share.format("length(regexp_replace(text, '[^A-Z]', '', 'g'))", "word_chars")} as capital_share,
    {share.format("length(regexp_replace(text, '[^!?]', '', 'g'))", "n_words")} as exclaim_share,
    {share.format("word_chars", "n_words")} as mean_word,
    1.0::double - {share.format("len(list_distinct(w))", "n_words")} as same_word_share,
    n_words < {quality.MIN_WORDS} or n_repeat_words * 100 > n_words * {quality.MAX_REPEAT_PERCENT} as base_failed
  from counted),
grid as (select * from (values {grid}) as t(rule, step, cutoff)),
marks as (
  select doc_id, min(quality) as quality from labels
  where doc_id is not null and quality is not null group by 1),
tall as ({measures}),
seen as (
  select stratum, text, rule, max(value) as value, min(quality) as quality
  from tall join marks using (doc_id) where not base_failed group by 1, 2, 3),
totals as (
  select stratum, count(*) filter (quality > 0) as n from seen where rule = '{rules[0]}' group by 1),
counts as (
  select stratum, rule, step, cutoff, count(*) filter (quality > 0) as good,
    count(*) filter (quality <= 0) as bad
  from seen join grid using (rule) where value >= cutoff group by 1, 2, 3, 4),
tested as (
  select *, case when n <= 0 or good >= n * {rate!r}::double then 1.0
    else list_sum(list_transform(range(0, good + 1), lambda j: {pmf})) end as tail
  from counts join totals using (stratum)),
chosen as (
  select stratum, rule, arg_max(cutoff, (bad - good * {quality.GOOD_WEIGHT}) * 1000 + step) as cutoff
  from tested
  where tail * (select count(*) from totals) * {len(rules)} <= {quality.ERROR!r}::double
    and bad > good * {quality.GOOD_WEIGHT}
  group by 1, 2),
failed as (
  select distinct id from tall join chosen using (stratum, rule) where value >= cutoff)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or failed.id is not null) as kept
from measured left join failed using (id)"""


def _urls(rules: list[tuple[str, str, str]]) -> str:
    rows = ", ".join(f"('{verdict}', '{host}', '{path}')" for verdict, host, path in rules)
    host = (
        r"translate(regexp_extract(coalesce({0}, ''), '(?s)^.*?://([^/?#]*)', 1),"
        " 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    )
    damping = url_filter.DAMPING

    def spread(name: str, verdict: str, a: str, b: str) -> str:
        """What each round adds to the ranks, for as many rounds as still add what counts."""
        rounds = round(math.log(1e-30) / math.log(damping))
        return f"""
{name}_start as (
  select host, count(*) filter (verdict = '{verdict}')
    / (select count(*) from ruled where verdict = '{verdict}')::double * {1 - damping!r}::double as rank
  from ruled group by 1 having count(*) filter (verdict = '{verdict}') > 0),
{name}_share as (
  select {a} as a, {b} as b, n / sum(n) over (partition by {a}) as share from links),
{name}_rounds as (
  select host, rank, 0 as n from {name}_start
  union all select s.b, sum(r.rank * s.share * {damping!r}::double), r.n + 1
  from {name}_rounds r join {name}_share s on r.host = s.a where r.n < {rounds} group by s.b, r.n),
{name} as (select host, sum(rank) as rank from {name}_rounds group by 1)"""

    return rf"""
with recursive rules(verdict, rule_host, rule_path) as (values {rows}),
placed as (
  select page_id, html, row_number() over () as row, {host.format("url")} as host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path from pages),
fits as (
  select row, arg_max(rule_host || rule_path, length(rule_host || rule_path)) as rule,
    arg_max(verdict, length(rule_host || rule_path)) as verdict
  from placed join rules on (host = rule_host or ends_with(host, '.' || rule_host))
    and starts_with(path, rule_path)
  group by 1),
ruled as (select host, verdict from fits join placed using (row)),
found as (
  select host as a, unnest(regexp_extract_all(html,
    '(?i)\b(?:href|src)\s*=\s*["'']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"''\s<>]+)', 1)) as link from placed),
links as (
  select a, b, count(*)::double as n from (
    select a, {host.format("case when starts_with(link, '//') then 'x:' || link else link end")} as b
    from found)
  where a <> b and a <> '' and b <> '' group by 1, 2),
{spread("trust", "allow", "a", "b")},
{spread("distrust", "block", "b", "a")}
select page_id, host, path, rule,
  coalesce(verdict, case when coalesce(d.rank, 0) > coalesce(t.rank, 0) * {url_filter.MARGIN!r}::double
    then 'block' else 'allow' end) as verdict
from placed left join fits using (row) left join trust t using (host)
  left join distrust d using (host)"""



def _phrases() -> str:
    most = phrases.MOST_WORDS
    sizes = ", ".join(f"({k})" for k in range(1, most + 1))
    return rf"""
with texts as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array({_LOWERED}, '[.,;:!?\x0A-\x0D]')) as piece
  from documents),
pieces as (
  select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') as w from texts),
grams as (
  select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) as p
  from pieces, (values {sizes}) as t(k) where len(w) >= k),
counts as (select lang, k, p, count(*) as f from grams group by 1, 2, 3),
sizes as (select lang, cast(sum(f) as bigint) as n from counts where k = 1 group by 1),
candidates as (select lang, k, p, f as a from counts where k > 1 and f >= {phrases.LEAST}),
cuts as (
  select c.lang, c.p, c.k, c.a, j, l.f as l, r.f as r,
    ({phrases.SCALE}::hugeint * c.a * c.a) // (l.f::hugeint * r.f) as score
  from candidates c join (values {sizes}) as t(j) on j < c.k
  join counts l on l.lang = c.lang and l.p = c.p[1:j]
  join counts r on r.lang = c.lang and r.p = c.p[j + 1:c.k]),
weakest as (
  select lang, p, k, a, unnest(min({{'score': score, 'j': j, 'l': l, 'r': r}})) from cuts group by 1, 2, 3, 4),
inner_parts as (
  select lang, a, unnest(flatten(list_transform(range(2, k), lambda m: list_transform(
    range(1, k - m + 2), lambda i: p[i:i + m - 1])))) as p from candidates),
held as (select lang, p, max(a) as most from inner_parts group by 1, 2),
ranked as (
  select w.lang, array_to_string(p, ' ') as phrase, a, l, r, score,
    row_number() over (partition by w.lang order by score desc, a desc, array_to_string(p, ' ')) as rank
  from weakest w left join held using (lang, p)
  where coalesce(100 * most < {phrases.INSIDE_PERCENT} * a, true))
select lang, rank, phrase, a, l, r, n, cast(score as bigint) as score
from ranked join sizes using (lang) where rank <= {phrases.FIRST}"""


def _secrets() -> str:
    quoted = lambda pattern: pattern.replace("'", "''")
    cuts, checks = [], []
    for i, rule in enumerate(secret_scan.RULES):
        text, pattern = ("low" if rule.any_case else "text"), quoted(rule.pattern)
        cuts.append(
            f"select id, {i} as rule, '{rule.name}' as kind, regexp_split_to_array({text}, '{pattern}') as gaps,"
            f" regexp_extract_all({text}, '{pattern}') as said from given"
        )
        checks.append(f"when {i} then length(regexp_extract(said, '{pattern}', {rule.group})) >= {rule.least}")
    base = len(secret_scan.BASE_RULES)
    counts = ", ".join(
        f"count(*) filter (rule = {i}) as n_{rule.name}" for i, rule in enumerate(secret_scan.BASE_RULES)
    )
    named = "kind || ':' || start || ':' || (start + length(said))"
    return rf"""
with given as (
  select row_number() over () as id, doc_id, coalesce(text, '') as text, {_LOWERED} as low from documents),
cut as ({" union all ".join(cuts)}),
places as (select *, unnest(range(1, len(said) + 1)) as i from cut where len(said) > 0),
found as (
  select id, rule, kind, said[i] as said, cast(
    coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0)
    + coalesce(list_sum(list_transform(said[1:i - 1], lambda x: length(x))), 0) as bigint) as start
  from places),
kept as (select * from found where case rule {" ".join(checks)} end),
summed as (
  select id, {counts},
    string_agg({named}, ',' order by start, rule) filter (rule < {base}) as base,
    string_agg({named}, ',' order by start, rule) as spans
  from kept group by 1)
select doc_id, {", ".join(f"coalesce(n_{r.name}, 0) as n_{r.name}" for r in secret_scan.BASE_RULES)},
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from given left join summed using (id)"""


def _merkle(columns: list[str], leaf_levels: int = 8, group_levels: int = 4) -> str:
    """Levels are written out; ``FANOUT`` to their number bounds leaves and groups."""
    fan = merkle.FANOUT
    table = (
        "list_transform(range(0, 256), lambda b: list_reduce(list_concat([b::bigint], [0::bigint, 0, 0, 0, 0, 0, 0, 0]),"
        " lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end))"
    )
    crc = (
        "xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split(doc_id::varchar, ''),"
        " lambda x: ascii(x)::bigint)), lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])),"
        " 4294967295)"
    )

    def sealed(changed: bool) -> str:
        parts = []
        for column in columns:
            text = f"{column}::varchar"
            if changed and column == "text":
                text = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
            parts.append(f"coalesce(strlen({text}) || ':' || {text}, '-')")
        return f"sha256({' || '.join(parts)})"

    def tree(name: str, levels: int) -> str:
        """From {name}_0 (grp, i, h, n) and {name}_path_0 (id, grp, i, node, proof)."""
        steps = []
        for k in range(levels):
            steps.append(f"""
{name}_{k + 1} as (
  select grp, i // {fan} as i, sha256(string_agg(h, '' order by i)) as h, (any_value(n) + {fan - 1}) // {fan} as n
  from {name}_{k} where n > 1 group by grp, i // {fan}
  union all select grp, i, h, n from {name}_{k} where n <= 1),
{name}_runs_{k} as (
  select grp, i // {fan} as run, list(h order by i) as hs, any_value(n) as n from {name}_{k} group by 1, 2),
{name}_path_{k + 1} as (
  select id, p.grp, i // {fan} as i,
    case when n > 1 then sha256(array_to_string(
      list_concat(hs[1:i % {fan}], [node], hs[i % {fan} + 2:]), '')) else node end as node,
    case when n > 1 then proof || array_to_string(list_concat(hs[1:i % {fan}], hs[i % {fan} + 2:]), '')
      else proof end as proof
  from {name}_path_{k} p join {name}_runs_{k} r on p.grp is not distinct from r.grp and p.i // {fan} = r.run)""")
        return ",".join(steps)

    return f"""
with crc_steps as (select {table} as steps),
given as (
  select row_number() over () as id, doc_id, source, {sealed(False)} as leaf,
    case when doc_id is not null and ({crc}) % 5 = 0 then {sealed(True)} end as changed from documents, crc_steps),
placed as (
  select *, row_number() over (partition by source order by doc_id nulls first, leaf, changed nulls first) - 1 as i
  from given),
leaf_0 as (select source as grp, i, leaf as h, count(*) over (partition by source) as n from placed),
leaf_path_0 as (select id, source as grp, i, coalesce(changed, leaf) as node, '' as proof from placed),
{tree("leaf", leaf_levels)},
subroots as (
  select grp as source, h as subroot, row_number() over (order by grp nulls first) - 1 as i from leaf_{leaf_levels}),
group_0 as (select 0 as grp, i, subroot as h, count(*) over () as n from subroots),
group_path_0 as (
  select p.id, 0 as grp, s.i, p.node, p.proof
  from leaf_path_{leaf_levels} p join subroots s on p.grp is not distinct from s.source),
{tree("group", group_levels)}
select doc_id, leaf, subroot, (select h from group_{group_levels}) as root, sha256(proof) as proof_sha256,
  node as folded_root, node = (select h from group_{group_levels}) as verified
from placed join subroots on placed.source is not distinct from subroots.source
join group_path_{group_levels} using (id)"""


def oracles(rules: list[tuple[str, str, str]], columns: list[str]) -> dict[str, str]:
    return {
        "op1_ngram_join": NGRAM_JOIN,
        "op3_chat_format": CHAT_FORMAT,
        "op6_quality_rules": _quality(),
        "op7_url_filter": _urls(rules),
        "op11_phrase_collocations": _phrases(),
        "op12_secret_scan": _secrets(),
        "op13_merkle_manifest": _merkle(columns),
    }
