"""DuckDB SQL for the queries over many requests; values as plain text, none from the library's operators."""

from __future__ import annotations

from .evidence_oracles import PAGE_CANDIDATES
from .oracles import _SRC, CLUSTERS, _kind, _linked, _norm, _normal

#: Preferences of the policies that keys modulo 5 name, among the sources that occur; "other" stands for sources that do not.
_POLICY = """pol AS (SELECT * FROM (VALUES (0,'title','dmm',0),(0,'title','javdb',1),(0,'overview','fc2',0),(0,'release_date','javdb',0),(0,'release_date','other',1),
  (1,'title','dmm',2),(1,'overview','dmm',1),(1,'runtime_minutes','other',0),(1,'release_date','other',0),
  (4,'runtime_minutes','xcity',0),(4,'runtime_minutes','dmm',1),(4,'overview','prestige',0)) AS v(pol, field, provider, rank))"""
_KIND = "CASE {k}%5 WHEN 3 THEN 1 ELSE {k}%5 END"
_SOURCE = "['dmm','javdb','fc2','xcity','prestige'][CAST(({k})%5 AS INTEGER)+1]"


def _fused(fields: list[str]) -> str:
    """From f (request, cluster, pol, provider, pid, arrival, conf, fields) to z, a row for each cluster and field."""
    cells = " UNION ALL ".join(f"SELECT request, cluster, pol, provider, pid, arrival, conf, '{c}' AS field, CAST({c} AS VARCHAR) AS value FROM f" for c in fields)
    return f"""{_POLICY}, v AS ({cells}),
o AS (SELECT v.*, pol.rank, EXISTS (SELECT 1 FROM pol q WHERE q.pol=v.pol AND q.field=v.field) AS listed, row_number() OVER (PARTITION BY request, cluster, v.field ORDER BY conf DESC, v.provider, pid, arrival, value NULLS FIRST) AS k, count(*) OVER (PARTITION BY request, cluster, v.field) AS n
  FROM v LEFT JOIN pol ON pol.pol=v.pol AND pol.field=v.field AND pol.provider=v.provider),
z AS (SELECT request, cluster, field, max(n) AS n_facts, min(provider) FILTER (k=1) AS provider, min(pid) FILTER (k=1) AS pid,
  CASE WHEN max(n)>1 THEN coalesce(arg_min(value,(rank,arrival,value)) FILTER (value IS NOT NULL AND rank IS NOT NULL), max(value) FILTER (k=1), CASE WHEN bool_or(listed) THEN arg_min(value,(arrival,value)) FILTER (value IS NOT NULL) END) ELSE max(value) FILTER (k=1) END AS value FROM o GROUP BY request, cluster, field)"""


def _column(field: str, kind: str) -> str:
    return f"CAST(max(value) FILTER (field='{field}') AS {kind}) AS {field}"


POLICY_FUSION = f"""WITH f AS (SELECT o_custkey AS request, o_orderpriority AS cluster, {_KIND.format(k="o_custkey")} AS pol, {_SOURCE.format(k="o_orderkey")} AS provider, lpad(o_orderkey::VARCHAR,12,'0') AS pid, o_orderkey AS arrival, o_orderkey%97 AS conf,
  CASE WHEN o_orderkey%3<>0 THEN 't'||o_orderkey END AS title, CASE WHEN o_orderkey%2=0 THEN o_orderstatus||o_orderkey END AS overview, CASE WHEN o_orderkey%7>2 THEN o_orderkey%200 END AS runtime_minutes, CASE WHEN o_orderkey%5<>1 THEN CAST(o_orderdate AS DATE) END AS release_date FROM orders JOIN customer ON c_custkey=o_custkey),
{_fused(["title", "overview", "runtime_minutes", "release_date"])}
SELECT request, cluster, max(n_facts) AS n_facts, min(provider) AS provider, min(pid) AS provider_id, {_column("title", "VARCHAR")}, {_column("overview", "VARCHAR")}, {_column("runtime_minutes", "INTEGER")}, {_column("release_date", "VARCHAR")} FROM z GROUP BY request, cluster"""

_STATUS = f"""{_SRC}, q AS (SELECT p_partkey AS request, p_name, p_type, p_size, CASE p_partkey%4 WHEN 0 THEN 'censored' WHEN 1 THEN 'fc2' END AS route,
  list_concat(['prestige'], CASE p_partkey%5 WHEN 1 THEN ['javdb','dmm'] WHEN 2 THEN ['fc2'] WHEN 3 THEN ['xcity'] ELSE [] END) AS disabled,
  CASE p_partkey%5 WHEN 1 THEN 2 WHEN 2 THEN NULL WHEN 4 THEN 5 ELSE CASE WHEN p_partkey%3=0 THEN 9 END END AS most FROM part),
g AS (SELECT request, ordinal, provider, most, CASE WHEN list_contains(disabled, provider) THEN 'suppressed' WHEN route IS NOT NULL AND NOT list_contains(string_split(routes,' '), route) THEN 'skipped_by_route' END AS skip FROM q, src),
h AS (SELECT *, sum(CASE WHEN skip IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY request ORDER BY ordinal) AS place FROM g),
st AS (SELECT request, CAST(ordinal AS INTEGER) AS ordinal, provider, coalesce(skip, CASE WHEN place>most THEN 'budget_exhausted' ELSE 'selected' END) AS status FROM h)"""
REQUEST_STATUSES = f"WITH {_STATUS} SELECT * FROM st"


def _scored(source: str) -> str:
    """Outcomes and score of rows with p_name, p_size, title, original_title, year, language, score_milli and votes."""
    return f"""(SELECT *, CAST(greatest(0, least(1000, 250+community+CASE t WHEN 'exact' THEN 360 WHEN 'normalized' THEN 320 WHEN 'mismatch' THEN -160 ELSE 0 END+CASE y WHEN 'exact' THEN 180 WHEN 'mismatch' THEN -120 ELSE 0 END+CASE l WHEN 'exact' THEN 40 ELSE 0 END)) AS INTEGER) AS c FROM (SELECT *,
  CASE WHEN title IS NULL AND original_title IS NULL THEN 'missing_candidate' WHEN title=p_name OR original_title=p_name THEN 'exact' WHEN {_norm("title")}={_norm("p_name")} OR {_norm("original_title")}={_norm("p_name")} THEN 'normalized' ELSE 'mismatch' END AS t,
  CASE WHEN p_size%4=0 THEN 'query_missing' WHEN year IS NULL THEN 'candidate_missing' WHEN year=1992+p_size%7 THEN 'exact' ELSE 'mismatch' END AS y, CASE WHEN language IS NULL THEN 'candidate_missing' WHEN language='EN' THEN 'exact' ELSE 'mismatch' END AS l,
  CASE WHEN votes>=25 THEN least(greatest(score_milli-650,0)//25,10) + CASE WHEN votes<100 THEN 0 WHEN votes<1000 THEN 2 WHEN votes<10000 THEN 4 ELSE 6 END ELSE 0 END AS community FROM {source}))"""


_TYPES = {"title": "VARCHAR", "original_title": "VARCHAR", "overview": "VARCHAR", "year": "INTEGER", "runtime_minutes": "INTEGER", "language": "VARCHAR", "score_milli": "INTEGER", "votes": "BIGINT"}
ANSWERS = f"""WITH {_STATUS},
d AS (SELECT l_partkey AS request, {_SOURCE.format(k="l_orderkey+l_linenumber")} AS provider, lpad(l_orderkey::VARCHAR,9,'0')||'-'||l_linenumber||'-'||l_suppkey||'-'||CAST(trunc(l_extendedprice*100) AS BIGINT) AS pid, l_orderkey*10+l_linenumber AS arrival, l_suppkey AS cluster, p_name, p_size,
  CASE l_linenumber%4 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) WHEN 2 THEN p_type END AS title, CASE WHEN l_linenumber=5 THEN p_name END AS original_title, CASE WHEN l_linenumber%2=0 THEN 'o'||l_orderkey END AS overview, CAST(year(l_shipdate) AS INTEGER) AS year,
  CASE WHEN l_linenumber<>3 THEN CAST(trunc(l_quantity) AS INTEGER) END AS runtime_minutes, CASE l_returnflag WHEN 'A' THEN 'EN' WHEN 'N' THEN 'ja_JP' END AS language, CAST(trunc(l_quantity*20) AS INTEGER) AS score_milli, CAST(trunc(l_extendedprice) AS BIGINT) AS votes
  FROM lineitem JOIN q ON q.request=l_partkey),
e AS (SELECT d.* FROM d SEMI JOIN (SELECT * FROM st WHERE status='selected') s ON s.request=d.request AND s.provider=d.provider),
f AS (SELECT *, c AS conf, {_KIND.format(k="request")} AS pol FROM {_scored("e")}),
{_fused(list(_TYPES))},
r AS (SELECT request, cluster, max(n_facts) AS n_facts, min(provider) AS provider, min(pid) AS provider_id, {", ".join(_column(*x) for x in _TYPES.items())} FROM z GROUP BY request, cluster),
w AS (SELECT r.*, p_name, p_size, (SELECT string_agg(DISTINCT f.provider, ',' ORDER BY f.provider) FROM f WHERE f.request=r.request AND f.cluster=r.cluster) AS sources FROM r JOIN q USING (request)),
x AS (SELECT *, CAST(row_number() OVER (PARTITION BY request ORDER BY c DESC, provider, provider_id) AS INTEGER) AS rank FROM {_scored("w")})
SELECT request, rank, provider, provider_id, {", ".join(_TYPES)}, n_facts, sources, c AS confidence_milli,
 'base:base:250'||CASE t WHEN 'exact' THEN ',title:exact:360' WHEN 'normalized' THEN ',title:normalized:320' WHEN 'mismatch' THEN ',title:mismatch:-160' ELSE '' END||CASE y WHEN 'exact' THEN ',year:exact:180' WHEN 'mismatch' THEN ',year:mismatch:-120' ELSE '' END||CASE l WHEN 'exact' THEN ',language:exact:40' WHEN 'mismatch' THEN ',language:mismatch:0' ELSE '' END||CASE WHEN community>0 THEN ',community_score:boost:'||community ELSE '' END AS reasons FROM x WHERE rank<=12"""

_SHIFTED = _linked("{k}").replace("{k}::VARCHAR", "({k}%40)::VARCHAR")
LINK_SEARCHES = f"""WITH o AS (SELECT o_custkey AS request, o_orderkey AS id, o_orderpriority AS title, CAST(floor(o_totalprice) AS INTEGER)%50 AS score FROM orders),
l AS (SELECT o.*, 0 AS place, trim({_SHIFTED.format(k="id")}) AS url, 'desk' AS provider, NULL AS password, 'order '||id AS note FROM o
  UNION ALL SELECT o.*, l_linenumber, trim({_SHIFTED.format(k="l_partkey")}), 'line'||l_suppkey%4, CASE WHEN l_quantity>25 THEN 'pw'||l_partkey END, 'note '||l_suppkey FROM lineitem JOIN o ON o.id=l_orderkey),
k AS (SELECT *, {_normal("url")} AS normalized_url, {_kind("url")} AS link_type FROM l),
w AS (SELECT k.*, greatest(1, least(100, request%7-1)) AS lim FROM k JOIN customer ON c_custkey=request WHERE (request%3=2 OR provider='desk' OR request%3=1 AND provider='line2') AND (request%4>1 OR request%4=0 AND link_type IN ('quark','magnet','web') OR request%4=1 AND link_type='other')),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request ORDER BY score DESC, title, id) AS rank FROM (SELECT DISTINCT request, lim, score, title, id FROM w)) WHERE rank<=lim),
s AS (SELECT w.* FROM w SEMI JOIN b ON b.request=w.request AND b.id=w.id),
f AS (SELECT *, row_number() OVER (PARTITION BY request, normalized_url ORDER BY score DESC, title, id, place, url, link_type, password NULLS FIRST, note) AS nth FROM s)
SELECT request, normalized_url, max(url) FILTER (nth=1) AS url, max(link_type) FILTER (nth=1) AS link_type, max(password) FILTER (nth=1) AS password, max(note) FILTER (nth=1) AS note, string_agg(DISTINCT provider, ',' ORDER BY provider) AS sources FROM f GROUP BY request, normalized_url"""

#: What is read back: submitted rows of both epochs, once.
WRITTEN_ROWS = "SELECT c_custkey, c_name AS submission, c_custkey%2 AS epoch FROM customer WHERE c_custkey%10<>0 AND c_acctbal>0 AND c_mktsegment<>'BUILDING'"
ALL_HISTORY = """SELECT string_agg(event_id, ',' ORDER BY event_id) AS event_ids, string_agg(user_id, ',' ORDER BY event_id) AS providers, string_agg(event_type, ',' ORDER BY event_id) AS statuses FROM (SELECT * FROM events ORDER BY event_id DESC LIMIT 20)"""


def _flow(provider: str, fallback: bool = True, searched: bool = True) -> str:
    """The candidates of a source of pages by another provider, without a fallback or without a search page."""
    sql = PAGE_CANDIDATES.replace("javdb", provider)
    if not fallback:
        sql = sql.replace("WHEN route='censored' AND p_size%5=0 THEN 'fallback' WHEN route='censored' THEN 'search'", "WHEN route='censored' AND p_size%5<>0 THEN 'search'")
    return sql if searched else sql.replace("WHEN route='censored' AND p_size%5=0 THEN 'fallback' WHEN route='censored' THEN 'search'", "")


RENDERED, NUMBERED = _flow("airav", fallback=False), f"SELECT * FROM ({_flow('jav321')}) UNION ALL SELECT * FROM ({_flow('fc2ppvdb', searched=False)})"

OFFICIAL_FIELDS = PAGE_CANDIDATES.replace("javdb", "caribbean").replace("WHEN route='censored' AND p_size%5=0 THEN 'fallback' WHEN route='censored' THEN 'search'", "WHEN route='censored' THEN 'detail'")

ORACLES = {
    "policy_fusion": POLICY_FUSION, "request_statuses": REQUEST_STATUSES, "answers": ANSWERS, "link_searches": LINK_SEARCHES, "written_rows": WRITTEN_ROWS, "cluster_batches": CLUSTERS, "stream_all_history": ALL_HISTORY,
    "rendered_candidates": RENDERED, "numbered_candidates": NUMBERED, "official_fields": OFFICIAL_FIELDS,
}
