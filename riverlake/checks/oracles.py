"""Plain SQL for the same results, over the driver's tables. Written for DuckDB."""

from __future__ import annotations

_DAILY = """
daily as (
  select 'USGS-' || lpad(cast(l_suppkey as varchar), 8, '0') as site_no,
    case l_returnflag when 'A' then '00060' when 'N' then '00065' else '00010' end as param_cd,
    cast(l_shipdate as date) as datetime, l_quantity as value,
    case l_linenumber when 1 then 'e' when 2 then 'ICE,ESTIMATED' end as qualifiers,
    38.0e0 + l_suppkey / 100.0e0 as latitude, -85.0e0 + l_suppkey / 50.0e0 as longitude,
    case l_linestatus when 'F' then 'Approved' else 'Provisional' end as approval_status,
    case when l_linenumber < 7 then l_shipdate + l_linenumber * interval '1' day end
      as last_modified,
    cast(year(l_shipdate) as varchar) as year
  from lineitem)"""

_CONTINUOUS = """
continuous as (
  select *, cast(year(datetime) as varchar) as year from (
    select 'USGS-' || lpad(cast(user_id % 40 as varchar), 8, '0') as site_no,
      case when event_type in ('click', 'view') then '00060' else '00065' end as param_cd,
      date_trunc('hour', ts) + (ts - date_trunc('second', ts)) as datetime, value,
      case when event_type = 'error' then 'ICE' end as qualifiers,
      38.0e0 + (user_id % 40) / 100.0e0 as latitude,
      -85.0e0 + (user_id % 40) / 50.0e0 as longitude,
      case when event_id % 3 = 0 then 'Approved' else 'Provisional' end as approval_status,
      ts as last_modified
    from events))"""

_LANDED = """
landed as (
  select 'USGS-' || lpad(cast(user_id % 40 as varchar), 8, '0') as site_no,
    '00060' as param_cd, ts + interval '5' hour as datetime, value,
    case event_type when 'error' then 'ICE' when 'click' then 'A,B' end as qualifiers,
    38.0e0 + (user_id % 40) / 100.0e0 as latitude,
    -85.0e0 + (user_id % 40) / 50.0e0 as longitude,
    'Provisional' as approval_status, ts as last_modified
  from events where event_type not in ('purchase', 'signup'))"""

_MODIFIED = "coalesce(strftime(last_modified, '%Y-%m-%dT%H:%M:%S.%fZ'), '') as last_modified"
_DAY = "strftime(datetime, '%Y-%m-%d')"
_SECOND = "strftime(datetime, '%Y-%m-%dT%H:%M:%SZ')"
_PLACE = "latitude, longitude, approval_status"


def _latest(source: str, key: str, where: str = "true") -> str:
    return f"""
latest as (
  select * exclude (copy) from (
    select *, row_number() over (partition by site_no, param_cd, {key}
      order by last_modified desc nulls last, value desc, approval_status,
        qualifiers nulls last, datetime, latitude, longitude) as copy
    from {source} where {where})
  where copy = 1)"""


def _wire(source: str, service: str, time: str) -> str:
    return f"""
select site_no, param_cd, '{service}' as service, year, {time} as datetime, value,
  qualifiers, {_PLACE}, {_MODIFIED}
from {source}"""


def _readings(source: str, time: str) -> str:
    return f"""
select site_no, param_cd, {time} as datetime, value, qualifiers, {_PLACE}, {_MODIFIED}
from {source}"""


_STORED = """
select site_no, param_cd, 'continuous' as service, cast(year(datetime) as varchar) as year,
  """
_BY_SECOND = "date_trunc('second', datetime)"
_DAILY_LATEST = "with" + _DAILY + "," + _latest("daily", "datetime")
_DAILY_60 = "with" + _DAILY + "," + _latest("daily", "datetime", "param_cd = '00060'")
_CONTINUOUS_LATEST = "with" + _CONTINUOUS + "," + _latest("continuous", _BY_SECOND)
_DAILY_FILTERED = (
    "with"
    + _DAILY
    + ","
    + _latest(
        "daily",
        "datetime",
        "param_cd = '00060' and datetime >= date '1996-01-01' and datetime <= date '2000-12-31'",
    )
    + _wire("latest", "daily", _DAY)
)

_SITES = (
    "with"
    + _DAILY
    + ","
    + _CONTINUOUS
    + """,
sites as (
  select site_no, min(latitude) as latitude, min(longitude) as longitude
  from (select site_no, latitude, longitude from daily
        union all select site_no, latitude, longitude from continuous)
  group by site_no)"""
)

_SERIES = """
with series as (
  select l_suppkey, l_returnflag as flag, l_linestatus as status,
    strftime(min(l_shipdate), '%Y-%m-%dT%H:%M:%S') as first_time,
    strftime(max(l_shipdate), '%Y-%m-%dT%H:%M:%S') as last_time
  from lineitem group by all),
listed as (
  select 'USGS-' || lpad(cast(s_suppkey as varchar), 8, '0') as site_no, s_name as name,
    case when r_name <> 'ASIA' then r_name end as state_name,
    case when s_nationkey < 20 then n_name end as county_name,
    lpad(cast(s_nationkey as varchar), 8, '0') as hydrologic_unit_code,
    case when s_acctbal > 0 then s_acctbal end as drainage_area,
    cast(null as double) as altitude,
    case flag when 'A' then '00060' when 'N' then '00065' else '00010' end as parameter_code,
    case when not (flag = 'R' and status = 'O') then 'Series ' || flag end as parameter_name,
    case when status = 'F' then '00003' end as statistic_id,
    case when flag <> 'N' then first_time end as begin, last_time as "end",
    case when status = 'F' then 'Primary' end as "primary",
    coalesce('USGS-' || lpad(cast(s_suppkey as varchar), 8, '0') || '/' || flag || status,
      'USGS-' || lpad(cast(s_suppkey as varchar), 8, '0')) as page
  from supplier join nation on s_nationkey = n_nationkey
    join region on n_regionkey = r_regionkey left join series on s_suppkey = l_suppkey),
headers as (
  select site_no, name, state_name, county_name, hydrologic_unit_code, drainage_area, altitude,
    min(page) as first_page
  from listed group by all),
kept as (
  select site_no, parameter_code, parameter_name, statistic_id, begin, "end", "primary", page,
    cast(row_number() over (partition by site_no order by page) - 1 as integer) as place
  from listed where parameter_code is not null and parameter_name is not null)"""

_EARTH = "6371008.8e0 * 6371008.8e0 / 2e0"


def _ring_areas(first: int, count: int) -> str:
    """Area of the ring of ``count`` positions from position ``first`` of each vector."""
    return f"""
  select a.vec_id, abs(sum((radians(c.lon) - radians(a.lon)) * sin(radians(b.lat)))) * {_EARTH}
    / 1e6 as km2
  from points a
    join points b on b.vec_id = a.vec_id and b.i = {first} + (a.i - {first} + 1) % {count}
    join points c on c.vec_id = a.vec_id and c.i = {first} + (a.i - {first} + 2) % {count}
  where a.i >= {first} and a.i < {first + count}
  group by a.vec_id"""


_POINTS = """
points as (
  select vec_id, i, cast(embedding[2 * i + 1] as double) * 10e0 - 85e0 as lon,
    cast(embedding[2 * i + 2] as double) * 10e0 + 41e0 as lat
  from embeddings, range(0, 32) as t(i))"""

_BASINS = f"""
with {_POINTS},
whole as ({_ring_areas(0, 16)}), rest as ({_ring_areas(16, 16)}),
hole_1 as ({_ring_areas(16, 8)}), hole_2 as ({_ring_areas(24, 8)}),
areas as (
  select 'USGS-' || lpad(cast(e.vec_id as varchar), 8, '0') as site_no,
    case when label = 0 then whole.km2 + rest.km2 else whole.km2 - hole_1.km2 - hole_2.km2 end
      as km2
  from embeddings e join whole using (vec_id) join rest using (vec_id)
    join hole_1 using (vec_id) join hole_2 using (vec_id)),
published as (
  select 'USGS-' || lpad(cast(s_suppkey as varchar), 8, '0') as site_no,
    case when s_acctbal > 0 then s_acctbal * 1000e0 end * 2.589988e0 as nwis_km2
  from supplier),
checked as (
  select site_no, km2, nwis_km2, km2 / nwis_km2 as ratio
  from areas left join published using (site_no))"""

_FILES = """
files as (
  select source as dataset,
    cast(case lang when 'de' then 1 when 'en' then 2 when 'es' then 3 else 4 end as bigint) as n,
    cast(doc_id as varchar) as path, sha256(text) as sha256, n_chars as row_count
  from documents)"""

_COMPARED = (
    "with"
    + _FILES
    + """,
disk as (
  select source as dataset, cast(doc_id as varchar) as path,
    sha256(case when toxic = 1 then text || '!' else text end) as sha256
  from documents left join labels using (doc_id) where coalesce(quality, 1) = 1),
compared as (
  select f.dataset, f.path, f.sha256, coalesce(d.sha256, '') as actual_sha256
  from files f left join disk d on f.dataset = d.dataset and f.path = d.path)"""
)

_LINES = "sha256(string_agg(path || ':' || {0} || chr(10), '' order by path))"

_WINDOWS = """
  select site_no, first_day + cast(k * 1095 as integer) as window_start,
    least(first_day + cast(k * 1095 + 1094 as integer), last_day) as window_end
  from {0}, range(0, 100) as t(k)
  where k <= datediff('day', first_day, last_day) // 1095"""


def _published(n: int, where: str, start: str, end: str) -> str:
    return f"""
  select cast({n} as bigint) as n, count(*) as row_count,
    cast(count(distinct site_no) as integer) as n_sites,
    '00060' as param_cd, '{start}' as start, '{end}' as "end",
    strftime(max(last_modified), '%Y-%m-%dT%H:%M:%S.%fZ') as max_last_modified,
    count(*) filter (approval_status = 'Approved') as n_approved, {n} = 3 as repeated,
    true as chain_ok, true as ok, true as content_hash_ok, true as row_count_ok
  from latest where {where}"""


ORACLES: dict[str, str] = {
    "daily_filtered": _DAILY_FILTERED,
    "lake_filtered": _DAILY_FILTERED,
    "continuous_filtered": "with"
    + _CONTINUOUS
    + ","
    + _latest(
        "continuous",
        _BY_SECOND,
        "param_cd = '00060' and datetime >= timestamp '2024-01-03' "
        "and datetime < timestamp '2024-01-26'",
    )
    + _wire("latest", "continuous", _SECOND),
    "daily_latest": _DAILY_LATEST + _wire("latest", "daily", _DAY),
    "continuous_latest": _CONTINUOUS_LATEST + _wire("latest", "continuous", _SECOND),
    "sites_semi": _DAILY_60
    + _wire("latest", "daily", _DAY)
    + """
where site_no in (select 'USGS-' || lpad(cast(s_suppkey as varchar), 8, '0')
  from supplier where s_acctbal > 0)""",
    "single_site": _DAILY_60
    + _wire("latest", "daily", _DAY)
    + "\nwhere site_no = 'USGS-00000007'",
    "wire_rows": _CONTINUOUS_LATEST + _wire("latest", "continuous", _SECOND),
    "wire_roundtrip": _CONTINUOUS_LATEST
    + f"""
select site_no, param_cd,
  strftime(date_trunc('second', datetime), '%Y-%m-%d %H:%M:%S.%f') as datetime, value,
  qualifiers, {_PLACE}, strftime(last_modified, '%Y-%m-%d %H:%M:%S.%f') as last_modified
from latest""",
    "site_list": _SITES + "\nselect * from sites order by site_no",
    "lake_site_list": _SITES + "\nselect * from sites",
    "distinct_sites": "with" + _DAILY + "\nselect distinct site_no from daily",
    "sites_geojson": _SITES
    + """
select site_no, '{"type":"Feature","geometry":{"type":"Point","coordinates":['
  || cast(longitude as varchar) || ',' || cast(latitude as varchar)
  || ']},"properties":{"site_no":"' || site_no || '"}}' as feature
from sites""",
    "readings_page": _DAILY_60
    + f"""
select site_no, param_cd, {_DAY} as datetime, value, approval_status
from latest order by site_no, latest.datetime limit 100 offset 300""",
    "readings_deep_page": _DAILY_60
    + f"""
select site_no, param_cd, {_DAY} as datetime, value, approval_status
from latest order by site_no, latest.datetime limit 100 offset 15000""",
    "readings_page_after": _DAILY_60
    + f"""
select site_no, param_cd, {_DAY} as datetime, value, approval_status
from latest
where (site_no, latest.datetime) > ('USGS-00000007', date '1998-06-15')
order by site_no, latest.datetime limit 100""",
    "page_count": _DAILY_60
    + "\nselect count(*) as n_rows, greatest(1, (count(*) + 99) // 100) as n_pages from latest",
    "chart_series": _DAILY_60
    + "\nselect site_no, strftime(datetime, '%Y-%m-%d 00:00:00') as x, value from latest",
    "parse_readings": "with" + _LANDED + _readings("landed", _SECOND),
    "landed_load": "with"
    + _LANDED
    + _STORED
    + _readings("landed", _SECOND).split("param_cd, ", 1)[1],
    "stream_ingest": "with"
    + _LANDED
    + ","
    + _latest("landed", _BY_SECOND)
    + _STORED
    + _readings("latest", _SECOND).split("param_cd, ", 1)[1],
    "kind_mismatch": """
select case
    when l_linestatus = 'O' and l_linenumber = 1 then 'dropped: no numeric value'
    when l_returnflag = 'A' then 'kept'
    when l_returnflag = 'N' then 'time does not suit the daily service'
    else 'cannot read time' end as outcome, count(*) as n
from lineitem group by 1""",
    "normalize_sites": """
select l_orderkey, l_linenumber, site_no, site_no || ',USGS-' || l_partkey || ',Y-1' as site_nos
from (select *, case when l_returnflag = 'N' then 'XX-' else 'USGS-' end || l_suppkey as site_no
  from lineitem)""",
    "missing_pages": """
with landed as (
  select p.url, f.url as next_url
  from pages p left join pages f on f.page_id = p.page_id + 1
  where not contains(p.url, '#'))
select url, next_url as missing_url from landed
where next_url is not null and next_url not in (select url from landed)""",
    "page_chains": """
with recursive landed as (
  select p.url, f.url as next_url
  from pages p left join pages f on f.page_id = p.page_id + 1
  where not contains(p.url, '#')
  union all select url || a, url || b
  from pages, (values ('#1', '#2'), ('#2', '#3'), ('#3', '#1')) as t(a, b) where page_id % 40 < 6
  union all select url || a, url || b
  from pages, (values ('#0', '#2'), ('#00', '#0')) as t(a, b) where page_id % 40 between 3 and 5),
linked as (select url, min(next_url) as next_url from landed group by 1),
walked as (
  select url, url as last_url, cast(0 as bigint) as steps, next_url as missing_url from linked
  where next_url is null or next_url not in (select url from linked)
  union all select l.url, w.last_url, w.steps + 1, w.missing_url
  from walked w join linked l on l.next_url = w.url),
reached as (
  select url from linked where url not in (select next_url from linked where next_url is not null)
  union select l.next_url from reached r join linked l using (url) where l.next_url is not null)
select url, last_url, steps, missing_url, last_url is null as loops,
  url not in (select url from reached) as unreached
from linked left join walked using (url)""",
    "request_windows": "with"
    + _DAILY
    + f""",
spans as (
  select site_no, min(datetime) as first_day, max(datetime) as last_day from daily group by 1),
windows as ({_WINDOWS.format("spans")})
select site_no, cast(first_day as varchar) as window_start, cast(last_day as varchar) as window_end,
  first_day || '/' || last_day as datetime_range, 'daily' as service from spans
union all
select site_no, cast(window_start as varchar), cast(window_end as varchar),
  window_start || 'T00:00:00Z/' || window_end || 'T23:59:59Z', 'continuous' from windows""",
    "lake_max_date": "with"
    + _DAILY
    + ","
    + _CONTINUOUS
    + """
select site_no, param_cd, cast(max(datetime) as varchar) as max_date, 'daily' as service
from daily group by 1, 2
union all
select site_no, param_cd, cast(cast(max(datetime) as date) as varchar), 'continuous'
from continuous group by 1, 2""",
    "incremental_plan": "with"
    + _CONTINUOUS
    + f""",
newest as (
  select site_no, param_cd, cast(max(datetime) as date) as day from continuous group by 1, 2),
spans as (
  select 'USGS-' || lpad(cast(c_custkey as varchar), 8, '0') as site_no, param,
    coalesce(day, date '2019-01-01') as first_day, date '2024-06-30' as last_day
  from customer cross join (values ('00060'), ('00065')) as p(param) left join newest
    on newest.site_no = 'USGS-' || lpad(cast(c_custkey as varchar), 8, '0') and param_cd = param),
windows as ({_WINDOWS.format("spans").replace("select site_no,", "select site_no, param as param_cd,")})
select site_no, param_cd, cast(window_start as varchar) as window_start,
  cast(window_end as varchar) as window_end,
  window_start || 'T00:00:00Z/' || window_end || 'T23:59:59Z' as datetime_range from windows""",
    "lake_layout": "with"
    + _DAILY
    + ","
    + _CONTINUOUS
    + """
select site_no, param_cd, year, count(*) as n, count(qualifiers) as n_qualified,
  'daily' as service from daily group by all
union all
select site_no, param_cd, year, count(*), count(qualifiers), 'continuous'
from continuous group by all""",
    "single_roundtrip": "with" + _DAILY + _readings("daily", _DAY),
    "site_metadata": _SERIES
    + """
select h.*, parameter_code, parameter_name, statistic_id, begin, "end", "primary", page
from headers h left join kept using (site_no)""",
    "metadata_pages_landed": _SERIES
    + """
select h.* exclude (first_page), parameter_code, parameter_name, statistic_id, begin, "end",
  "primary"
from headers h left join kept using (site_no)""",
    "metadata_roundtrip": _SERIES
    + """
select h.* exclude (first_page), place, parameter_code, parameter_name, statistic_id, begin,
  "end", "primary"
from headers h left join kept using (site_no)""",
    "site_report": _SERIES
    + """
select site_no, site_no || ' -- ' || name as heading,
  concat_ws(' | ', nullif(concat_ws(', ', county_name, state_name), ''),
    'drainage area: ' || regexp_replace(cast(drainage_area as varchar), '\\.0$', '') || ' sq mi',
    'HUC ' || hydrologic_unit_code) as details,
  coalesce(parameter_name || ' (' || parameter_code || ')  stat ' || coalesce(statistic_id, '-')
    || '  ' || coalesce(begin[:10], '?') || ' .. ' || coalesce("end"[:10], '?')
    || case when "primary" is not null then '  [Primary]' else '  [Provisional]' end,
    '(no matching parameter/statistic series)') as line, page
from headers left join kept using (site_no)""",
    "ring_area": f"""
with {_POINTS}, areas as ({_ring_areas(0, 32)})
select vec_id, round(km2, 3) as area_km2 from areas""",
    "basin_area": _BASINS + "\nselect site_no, round(km2, 3) as nldi_area_km2 from areas",
    "basin_check": _BASINS
    + """
select site_no, round(km2, 3) as nldi_area_km2, round(nwis_km2, 3) as nwis_drainage_area_km2,
  round(ratio, 6) as area_ratio, abs(ratio - 1) > 0.1 as mismatch
from checked""",
    "basin_csv": _BASINS
    + """
select site_no, printf('%.3f', km2) as nldi_area_km2,
  coalesce(printf('%.3f', nwis_km2), '') as nwis_drainage_area_km2,
  coalesce(printf('%.4f', ratio), '') as area_ratio
from checked""",
    "basins_missing": """
select 'USGS-' || lpad(cast(o_orderkey as varchar), 8, '0') as site_no from orders
where o_orderkey not in (select vec_id from embeddings)""",
    "basins_missing_report": """
select 'USGS-' || lpad(cast(o_orderkey as varchar), 8, '0') as site_no from orders
where o_orderkey not in (select vec_id from embeddings)""",
    "file_hashes": """
select cast(doc_id as varchar) as path, sha256(text || chr(10)) as sha256 from documents""",
    "content_hash": "with"
    + _FILES
    + f"""
select dataset, {_LINES.format("sha256")} as content_hash, count(*) as n_files
from files group by 1""",
    "manifest_build": "with"
    + _FILES
    + f""",
manifests as (
  select dataset, n, cast(sum(row_count) as bigint) as row_count, count(*) as n_files,
    {_LINES.format("sha256")} as content_hash
  from files group by 1, 2)
select *, lag(content_hash) over (partition by dataset order by n) as parent_hash
from manifests""",
    "provenance": _DAILY_60
    + """
select (select count(*) from latest) as row_count,
  (select string_agg(site_no, ',' order by site_no) from (select distinct site_no from latest))
    as sites,
  (select string_agg(approval_status || '=' || n, ',' order by approval_status)
    from (select approval_status, count(*) as n from latest group by 1))
    as approval_status_counts,
  (select strftime(max(last_modified), '%Y-%m-%dT%H:%M:%S.%fZ') from latest)
    as max_last_modified""",
    "version_history": """
with finished as (
  select 'c' || o_custkey as dataset, o_orderkey as n, o_orderpriority,
    sha256(o_orderkey || ':' || strftime(o_orderdate, '%Y-%m-%d')) as content_hash
  from orders where o_orderstatus <> 'P'),
chained as (
  select *, lag(content_hash) over (partition by dataset order by n) as before from finished),
declared as (
  select *, case when o_orderpriority = '1-URGENT' then content_hash else before end
    as parent_hash
  from chained)
select dataset, n, 'v' || n || '-' || content_hash[:8] as dir_name, content_hash, parent_hash,
  parent_hash is not distinct from before as chain_ok
from declared""",
    "verify_report": _COMPARED
    + f"""
select dataset, bool_and(sha256 = actual_sha256) as ok, count(*) as n_files,
  count(*) filter (sha256 <> actual_sha256) as n_mismatched,
  {_LINES.format("actual_sha256")} as actual_hash
from compared group by 1""",
    "verify_files": _COMPARED
    + "\nselect dataset, path, sha256, actual_sha256 from compared where sha256 <> actual_sha256",
    "verify_tampered": """
select false as ok, false as content_hash_ok, cast(doc_id as varchar) as path
from documents join labels using (doc_id) where quality <> 1 or toxic = 1""",
    "publish_roundtrip": _DAILY_60
    + _published(
        1,
        "datetime >= date '1996-01-01' and datetime <= date '2000-12-31'",
        "1996-01-01",
        "2000-12-31",
    )
    + "\nunion all"
    + _published(2, "true", "", "")
    + "\nunion all"
    + _published(3, "true", "", ""),
}
