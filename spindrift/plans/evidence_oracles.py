"""DuckDB SQL for the queries in ``evidence``, written without the library's code or constants."""

NULLS = "CAST(NULL AS VARCHAR)"
_TEXT = r"trim(regexp_replace(regexp_replace(regexp_replace({}, '<br>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[\s\x1c-\x1f\x85\xa0]+', ' ', 'g'))"
_ENT = "replace(replace(replace(replace({0},'&middot;','·'),'&copy;','©'),'&nbsp;',chr(160)),'&amp;','&')"
_HREF = r"""regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', {})"""
_ORIGIN = "regexp_extract(url, '^(.*?://[^/]*)', 1)"
_ABS = f"CASE WHEN h LIKE 'http%' THEN h WHEN h LIKE '//%' THEN 'https:'||h WHEN h LIKE '/%' THEN {_ORIGIN}||h ELSE regexp_replace(url,'/+$','')||'/'||h END"

HTML_LINKS = f"""WITH l AS (SELECT page_id, url, unnest({_HREF.format(1)}) AS h, unnest({_HREF.format(2)}) AS t FROM pages WHERE url IS NOT NULL)
SELECT DISTINCT page_id, {_ABS} AS url, trim({_ENT.format('t')}) AS text FROM l"""

LINES = """SELECT p_partkey, 'Maker='||p_brand||'|Size='||p_size AS lines, 'https://h.example/i.jpg|https://c.example/j.jpg' AS images, 'Maker： '||p_brand||' Size: '||p_size AS text FROM part"""

_SITE = """p AS (SELECT *, CAST(p_partkey AS VARCHAR) AS k, CAST(p_partkey+100000 AS VARCHAR) AS n FROM part),
q AS (SELECT *, 'ABC-'||n AS number, p_partkey%4 AS kind, CASE WHEN p_size%9=0 THEN 'fc2' ELSE 'censored' END AS route, p_size%7<>3 AS there FROM p)"""
_FACTS = """title, number AS sort_title, '2011-02-'||lpad(CAST(p_size%28+1 AS VARCHAR),2,'0') AS release_date, 2011 AS release_year, CAST(p_size AS INTEGER) AS runtime_minutes, CAST(NULL AS VARCHAR) AS tagline, 'G1|G2' AS genres, 'actor:One|maker:'||p_brand AS tags"""
PAGE_CANDIDATES = f"""WITH {_SITE}, a AS (SELECT *, CASE WHEN kind=0 THEN 'direct_url' WHEN kind=1 THEN 'direct_id' WHEN route='censored' AND p_size%5=0 THEN 'fallback' WHEN route='censored' THEN 'search' END AS how FROM q),
t AS (SELECT *, CASE WHEN how='fallback' THEN 'https://site.example/search?q='||number ELSE 'https://site.example/v/'||k END AS target, p_name AS title FROM a WHERE how='fallback' OR (how IS NOT NULL AND there))
SELECT p_partkey AS query_id, 'javdb' AS provider, 'javdb:'||CASE WHEN how='fallback' THEN 'search' ELSE k END AS provider_id, {NULLS} AS original_title, {NULLS} AS overview, {_FACTS}, '' AS alternate_titles, {NULLS} AS language,
 CAST(900 AS INTEGER) AS score_milli, CAST(NULL AS BIGINT) AS votes, 'av_number='||number||'|javdb_url='||target AS external_ids,
 'poster=https://site.example/p.jpg|backdrop=https://site.example/s.jpg|trailer=https://site.example/t.mp4' AS artwork, 'page_'||how AS outcome FROM t"""
OFFICIAL = f"""WITH {_SITE}, a AS (SELECT *, CASE WHEN kind=0 THEN 'direct_url' WHEN kind=1 THEN 'direct_id' WHEN route='censored' THEN 'detail' END AS how FROM q)
SELECT 'page_'||how AS outcome, count(*) AS n, min(p_partkey) AS first_id, CAST(sum(p_partkey) AS BIGINT) AS ids FROM a WHERE how IS NOT NULL AND there GROUP BY how"""
TITLED = f"""WITH {_SITE} SELECT p_partkey AS query_id, 'douban:https://site.example/v/'||k AS provider_id, p_name AS title, '2011-02-'||lpad(CAST(p_size%28+1 AS VARCHAR),2,'0') AS release_date, CAST(p_size AS INTEGER) AS runtime_minutes, CAST(900 AS INTEGER) AS score_milli
FROM q WHERE kind>=2 AND there AND p_size%5<>0"""

_ORDER = "['theporndb','prestige','caribbean','1pondo','10musume','dmm','xcity','mgstage','javdb','fc2','jav321','fc2ppvdb','airav','javbus','avsox','javlibrary','fixture','tmdb']"
PRESETS = f"""WITH c AS (SELECT c_custkey, c_custkey%3=0 AS explicit, CASE c_custkey%7 WHEN 0 THEN ['javdb','dmm','fc2','mgstage','prestige','theporndb'] WHEN 1 THEN ['dmm','fc2','mgstage','prestige','caribbean','1pondo','10musume']
 WHEN 3 THEN ['javdb','jav321','javbus','javlibrary','airav','avsox','dmm','xcity','fc2','fc2ppvdb','mgstage','prestige','theporndb'] WHEN 5 THEN ['fc2','fc2ppvdb','airav','avsox'] WHEN 6 THEN ['caribbean','1pondo','10musume'] ELSE [] END AS l FROM customer)
SELECT c_custkey AS setting, array_to_string(list_filter({_ORDER}, lambda x: x='fixture' OR (x='tmdb' AND explicit) OR (list_contains(l,x) AND NOT (explicit AND x='dmm'))),',') AS providers FROM c"""

_PREFERRED = {
    "title": "theporndb,mgstage,dmm,javbus,jav321,javlibrary", "outline": "theporndb,dmm,jav321", "overview": "theporndb,dmm,jav321", "actors": "theporndb,javbus,javlibrary,javdb", "thumb": "theporndb,javbus", "thumb_url": "theporndb,javbus",
    "poster": "theporndb,javbus", "extrafanart": "javbus", "extrafanart_urls": "javbus", "release": "javbus", "release_date": "javbus", "runtime": "javbus", "runtime_minutes": "javbus", "tags": "javbus", "directors": "javbus", "series": "javbus",
    "studio": "javbus", "publisher": "javbus", "trailer": "mgstage,dmm", "trailer_url": "mgstage,dmm", "wanted": "javlibrary,javdb", "wanted_count": "javlibrary,javdb", "score": "jav321,javlibrary,javdb", "community_score_milli": "jav321,javlibrary,javdb",
    "score_votes": "javlibrary,javdb", "community_vote_count": "javlibrary,javdb",
}
PREFERENCES = "SELECT * FROM (VALUES " + ",".join(f"('{f}','{p}')" for f, p in _PREFERRED.items()) + ") v(field, providers)"
POLICIES = """SELECT c_custkey, CASE c_custkey%4 WHEN 0 THEN 'sort_title=fc2|title=dmm' WHEN 2 THEN '' ELSE 'title=javdb' END AS policy, CASE WHEN c_custkey%2=0 THEN 'dmm,fc2' ELSE 'dmm' END AS disabled, CASE WHEN c_custkey%5=0 THEN 1 ELSE 3 END AS most,
 CASE c_custkey%3 WHEN 0 THEN 'default' WHEN 1 THEN 'quality_scores' END AS preset, CASE WHEN c_custkey%2=0 THEN 'x,y' ELSE 'z' END AS texts FROM customer"""
EMITTED = "SELECT substr(o_orderpriority,1,1) AS id_provider, count(*) AS n FROM orders WHERE substr(o_orderpriority,1,1) IN ('1','2') GROUP BY 1 UNION ALL SELECT 'all', count(*) FROM orders"

BREAKER = """WITH RECURSIVE e AS MATERIALIZED (SELECT user_id AS provider, event_id AS i, event_type IN ('error','view') AS failed, event_id%5 AS m, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
r AS (SELECT DISTINCT provider, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS i, '' AS outcome, CAST(0 AS BIGINT) AS f, CAST(NULL AS BIGINT) AS u FROM e UNION ALL
 SELECT provider, rn, i, CASE WHEN u1 IS NOT NULL THEN 'suppressed' WHEN failed THEN 'failed' ELSE 'ok' END,
  CASE WHEN u1 IS NOT NULL THEN f1 WHEN NOT failed THEN 0 WHEN m IN (0,1) THEN f1+1 WHEN m=2 THEN 1 ELSE 0 END,
  CASE WHEN u1 IS NOT NULL THEN u1 WHEN NOT failed THEN NULL WHEN m IN (0,1) AND f1+1>=2 THEN i+3 WHEN m=2 THEN i+3 END
 FROM (SELECT e.provider, e.rn, e.i, e.failed, e.m, CASE WHEN r.u IS NOT NULL AND e.i>r.u THEN 0 ELSE r.f END AS f1, CASE WHEN e.i<=r.u THEN r.u END AS u1 FROM r JOIN e ON e.provider=r.provider AND e.rn=r.rn+1))
SELECT provider, i AS item_index, outcome, CAST(CASE WHEN u IS NOT NULL AND i>=u THEN 0 ELSE f END AS INTEGER) AS consecutive_failures, CAST(coalesce(greatest(u-i,0),0) AS INTEGER) AS cooldown_remaining FROM r WHERE rn>0"""

_ITEMS = """k AS (SELECT user_id%10 AS run, event_id AS item_index, event_type, CASE WHEN event_type<>'purchase' THEN 'K'||(event_id*7%40)||':'||event_type END AS key FROM events),
items AS (SELECT *, CASE WHEN run%3=0 AND key IN ('K0:click','K1:click','K2:click','K3:click','K4:click') THEN -1 WHEN key IS NOT NULL AND min(item_index) OVER (PARTITION BY run, key)<item_index THEN min(item_index) OVER (PARTITION BY run, key) END AS reused_from FROM k)"""
REUSE = f"WITH {_ITEMS} SELECT run, item_index, CAST(reused_from AS BIGINT) AS reused_from FROM items"


def _fold() -> str:
    """Ten runs' breakers of three sources, item by item, two sources an item at most."""
    ps = range(3)
    e = ", ".join(f"item_index*{p + 3}%11 AS h{p}" for p in ps)
    first = ", ".join(f"CASE WHEN r.u{p} IS NOT NULL AND e.s>r.u{p} THEN 0 ELSE r.f{p} END AS f{p}, CASE WHEN e.s<=r.u{p} THEN r.u{p} END AS u{p}, r.w{p} AS w{p}" for p in ps)
    serves = lambda p: "event_type<>'view'" if p == 1 else "TRUE"
    free = lambda p: f"(u{p} IS NULL AND {serves(p)})"
    asked = f"{free(0)} AS a0, {free(1)} AS a1, {free(2)} AND CAST({free(0)} AS INTEGER)+CAST({free(1)} AS INTEGER)<2 AS a2"

    def after(p: int) -> str:
        h = f"h{p}"
        f = f"CASE WHEN NOT a{p} THEN f{p} WHEN {h}>=4 THEN 0 WHEN {h} IN (0,3) THEN f{p}+1 WHEN {h}=1 THEN 1 ELSE 0 END"
        u = f"CASE WHEN NOT a{p} THEN u{p} WHEN {h} IN (0,3) AND f{p}+1>=2 THEN s+3 WHEN {h}=1 THEN s+3 END"
        w = f"CASE WHEN NOT a{p} THEN w{p} WHEN {h}>=4 THEN NULL ELSE CASE {h} WHEN 0 THEN 'timeout' WHEN 1 THEN 'auth_or_forbidden' WHEN 2 THEN 'not_found' ELSE 'provider_error' END END"
        st = f"CASE WHEN u{p} IS NOT NULL THEN 'suppressed' WHEN NOT {serves(p)} THEN 'skipped_by_route' WHEN NOT a{p} THEN 'budget_exhausted' WHEN {h}<4 THEN 'failed' WHEN {h}<7 THEN 'empty' ELSE 'returned' END"
        return f"{f}, {u}, {w}, {st}"

    start = "CASE WHEN run%2=0 THEN 1 ELSE 0 END, CAST(NULL AS BIGINT), CASE WHEN run%2=0 THEN 'timeout' END, '', CASE WHEN run%2=0 THEN 2 ELSE 0 END, CASE WHEN run%2=0 THEN CAST(1 AS BIGINT) END, CASE WHEN run%2=0 THEN 'timeout' END, '', 0, CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), ''"
    names = ", ".join(f"f{p}, u{p}, w{p}, st{p}" for p in ps)
    rows = " UNION ALL ".join(f"SELECT run, item_index, s, 'p{p}' AS provider, st{p} AS status, CASE WHEN st{p}='returned' THEN item_index*{p + 3}%11 ELSE 0 END AS candidate_count, CAST(CASE WHEN u{p} IS NOT NULL AND s>=u{p} THEN 0 ELSE f{p} END AS INTEGER) AS failures, CAST(coalesce(greatest(u{p}-s,0),0) AS INTEGER) AS cooldown_remaining, w{p} AS w FROM r WHERE s>=0" for p in ps)
    return f"""WITH RECURSIVE {_ITEMS}, e AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY run ORDER BY item_index)-1 AS s, {e} FROM items WHERE reused_from IS NULL),
r(run, item_index, s, {names}) AS (SELECT DISTINCT run, CAST(NULL AS BIGINT), CAST(-1 AS BIGINT), {start} FROM e UNION ALL
 SELECT run, item_index, s, {', '.join(after(p) for p in ps)} FROM (SELECT *, {asked} FROM (SELECT e.run, e.item_index, e.s, e.event_type, e.h0, e.h1, e.h2, {first} FROM r JOIN e ON e.run=r.run AND e.s=r.s+1))),
reports AS ({rows})"""


REPORTS = _fold() + " SELECT run, item_index, provider, status, candidate_count, failures, cooldown_remaining FROM reports"
_CLASS = "CASE WHEN w IN ('timeout','provider_error') THEN 'retryable' WHEN w='auth_or_forbidden' THEN 'operator_action' WHEN w='not_found' THEN 'permanent' END"
_N = lambda name, test: f"count(*) FILTER ({test}) AS {name}"
SCRAPE = _fold() + " SELECT run, provider, " + ", ".join([
    _N("selected_items", "status IN ('returned','empty','failed')"), _N("returned_items", "status='returned'"), _N("empty_items", "status='empty'"), _N("failed_items", "status='failed'"), _N("retryable_failed_items", f"status='failed' AND {_CLASS}='retryable'"),
    _N("permanent_failed_items", f"status='failed' AND {_CLASS}='permanent'"), _N("operator_action_failed_items", f"status='failed' AND {_CLASS}='operator_action'"), _N("skipped_by_route_items", "status='skipped_by_route'"),
    _N("suppressed_items", "status='suppressed'"), _N("budget_exhausted_items", "status='budget_exhausted'"), "CAST(sum(candidate_count) AS BIGINT) AS returned_candidate_count", "arg_max(cooldown_remaining, item_index) AS cooldown_remaining_items",
]) + " FROM reports GROUP BY run, provider"
RESUME = _fold() + f", l AS (SELECT run, provider, arg_max(failures, item_index) AS consecutive_failures, arg_max(cooldown_remaining, item_index) AS cooldown_remaining, arg_max(struct_pack(w := w), item_index).w AS w FROM reports GROUP BY ALL) SELECT run, provider, consecutive_failures, cooldown_remaining, w AS reason, {_CLASS} AS retry_class FROM l WHERE consecutive_failures>0 OR cooldown_remaining>0 OR w IS NOT NULL"
FAILURES = _fold() + f""", i AS (SELECT run, item_index, sum(candidate_count) AS n, count(*) FILTER (status='failed') AS failed, count(*) FILTER (status IN ('returned','empty','failed')) AS selected, count(*) FILTER (status='suppressed') AS sup, count(*) FILTER (status='budget_exhausted') AS bud, count(*) FILTER (status='skipped_by_route') AS skip FROM reports GROUP BY ALL)
SELECT run, w||':'||{_CLASS} AS what, count(*) AS n FROM reports WHERE status='failed' GROUP BY run, w UNION ALL
SELECT run, CASE WHEN failed>0 THEN 'provider_failed' WHEN selected=0 AND sup>0 THEN 'provider_suppressed' WHEN selected=0 AND bud>0 THEN 'provider_budget_exhausted' WHEN selected=0 AND skip>0 THEN 'provider_skipped_by_route' ELSE 'no_candidates' END AS what, count(*) AS n FROM i WHERE n=0 GROUP BY run, what"""

DIRECT = "WITH t AS (SELECT l_orderkey, l_partkey, l_linenumber, p_name, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS rn FROM lineitem JOIN part ON p_partkey=l_partkey WHERE p_size<=10) SELECT l_orderkey AS query_id, l_linenumber AS attempt, l_partkey AS id, p_name FROM t WHERE rn=1"
EXTERNAL = """SELECT o_orderkey, CASE WHEN o_orderkey%3<>2 THEN 'tt'||o_custkey END AS external_id, CASE WHEN o_orderkey%3<>2 AND (c_nationkey%2=0 OR c_nationkey%3=0) THEN c_custkey END AS entity,
 CASE WHEN o_orderkey%3<>2 AND c_nationkey%2=0 THEN 'movie' WHEN o_orderkey%3<>2 AND c_nationkey%3=0 THEN 'tv' END AS kind FROM orders LEFT JOIN customer ON c_custkey=o_custkey"""
ENRICHMENTS = """SELECT p_partkey AS id, CASE WHEN p_partkey%5<>0 AND p_partkey%7<>0 AND p_partkey%6<>0 THEN upper(p_name) ELSE p_name END AS title, CASE WHEN p_partkey%5<>0 AND p_partkey%7<>0 AND p_partkey%6<>0 THEN 'enriched' ELSE 'degraded' END AS outcome,
 CASE WHEN p_partkey%5=0 THEN 'no_detail' WHEN p_partkey%6=0 THEN 'enrichment_failed' WHEN p_partkey%7=0 THEN 'id_mismatch' END AS degraded_by FROM part"""
TARGETS = """WITH t AS (SELECT 'd'||(s_suppkey%7) AS target_id, 0 AS late, s_suppkey AS o, s_name AS name, 'manual' AS origin FROM supplier UNION ALL SELECT 'd'||(n_nationkey%11), 1, n_nationkey, n_name, 'discovered' FROM nation WHERE n_nationkey%5<>0)
SELECT target_id, arg_min(name, (late, o)) AS name, arg_min(origin, (late, o)) AS origin, '5,7' AS ids FROM t GROUP BY target_id"""
SOURCE_ORDER = "SELECT n_nationkey, row_number() OVER (ORDER BY n_regionkey DESC, n_nationkey) AS place FROM nation"

_L = "l AS (SELECT l_orderkey AS cluster, l_linenumber AS a, 'p'||(l_partkey%3) AS provider, CAST(l_partkey AS VARCHAR) AS pid, CAST(l_partkey%1000 AS INTEGER) AS conf, {fields} FROM lineitem), b AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY conf DESC, provider, pid{tie}) AS br, count(*) OVER (PARTITION BY cluster) AS n FROM l)"
EVIDENCE = "WITH " + _L.format(fields="CASE WHEN l_quantity>20 THEN CAST(trunc(l_quantity) AS INTEGER) END AS runtime, CASE WHEN l_tax>0.04::DOUBLE THEN l_returnflag END AS flag", tie=", a, runtime NULLS FIRST") + """,
c AS (SELECT cluster, max(n) AS n, min(runtime) FILTER (br=1) AS base_runtime, arg_min(runtime, (CASE provider WHEN 'p2' THEN 0 ELSE 1 END, a, runtime)) FILTER (runtime IS NOT NULL AND provider IN ('p2','p1')) AS pref, arg_min(runtime, (a, runtime)) FILTER (runtime IS NOT NULL) AS first FROM b GROUP BY cluster),
f AS (SELECT cluster, flag FROM (SELECT cluster, flag, row_number() OVER (PARTITION BY cluster ORDER BY conf DESC, provider, pid, a, flag NULLS FIRST) AS k FROM b) WHERE k=1),
v AS (SELECT cluster, 'runtime' AS field, CAST(CASE WHEN n>1 THEN coalesce(pref, base_runtime, first) ELSE base_runtime END AS VARCHAR) AS value FROM c UNION ALL SELECT cluster, 'flag', flag FROM f),
o AS (SELECT v.cluster, v.field, arg_min(b.provider, (b.a, b.provider)) AS provider FROM v JOIN b ON b.cluster=v.cluster AND CASE v.field WHEN 'runtime' THEN CAST(b.runtime AS VARCHAR) ELSE b.flag END=v.value WHERE v.value IS NOT NULL GROUP BY v.cluster, v.field)
SELECT p_partkey AS id, 'title:p0:'||p_partkey||CASE WHEN p_size%3<>0 THEN '|overview:p0:'||p_partkey ELSE '' END||CASE WHEN p_size>25 THEN '|runtime_minutes:p0:'||p_partkey ELSE '' END||CASE WHEN p_size%2=0 THEN '|genres:p0:'||p_partkey ELSE '' END AS fields FROM part
UNION ALL SELECT -1, field||':'||provider||':'||count(*) FROM o GROUP BY field, provider"""
FUSED_SCORES = "WITH " + _L.format(fields="CASE WHEN l_linenumber%2=0 THEN l_returnflag END AS title, CAST(year(l_shipdate) AS INTEGER) AS year", tie=", a") + """,
bt AS (SELECT cluster, title FROM (SELECT cluster, title, row_number() OVER (PARTITION BY cluster ORDER BY conf DESC, provider, pid, a, title NULLS FIRST) AS k FROM b) WHERE k=1), by_ AS (SELECT cluster, year FROM (SELECT cluster, year, row_number() OVER (PARTITION BY cluster ORDER BY conf DESC, provider, pid, a, year) AS k FROM b) WHERE k=1),
c AS (SELECT b.cluster, max(n) AS n, min(provider) FILTER (br=1) AS provider, min(pid) FILTER (br=1) AS provider_id, arg_min(b.title, (a, b.title)) FILTER (b.title IS NOT NULL AND provider='p1') AS pt, arg_min(b.title, (a, b.title)) FILTER (b.title IS NOT NULL) AS ft,
 arg_min(b.year, (CASE provider WHEN 'p2' THEN 0 ELSE 1 END, a, b.year)) FILTER (provider IN ('p2','p0')) AS py FROM b GROUP BY b.cluster),
t AS (SELECT c.cluster, provider, provider_id, CASE WHEN n>1 THEN coalesce(pt, bt.title, ft) ELSE bt.title END AS title, CASE WHEN n>1 THEN coalesce(py, by_.year) ELSE by_.year END AS year FROM c JOIN bt USING (cluster) JOIN by_ USING (cluster))
SELECT *, CAST(greatest(0, least(1000, 250+CASE WHEN title IS NULL THEN 0 WHEN title='R' THEN 360 ELSE -160 END+CASE WHEN year=1995 THEN 180 ELSE -120 END)) AS INTEGER) AS confidence_milli FROM t"""
ARTWORK = """WITH a AS (SELECT l_orderkey AS cluster, CASE l_linenumber%3 WHEN 0 THEN 'poster' WHEN 1 THEN 'backdrop' ELSE 'logo' END AS kind, l_partkey%4 AS m, l_partkey||'/'||l_linenumber AS url FROM lineitem),
r AS (SELECT *, CASE WHEN kind='poster' AND m=1 OR kind='backdrop' AND m=2 THEN 0 WHEN kind<>'logo' AND m=0 THEN 1 END AS place FROM a), b AS (SELECT *, min(place) OVER (PARTITION BY cluster, kind) AS best FROM r)
SELECT cluster, kind, 'p'||m AS provider, url FROM b WHERE CASE WHEN best IS NOT NULL THEN coalesce(place=best, FALSE) ELSE m=3 END"""
NATIVE = """SELECT p_partkey, CASE WHEN p_size%2=0 THEN 'A#1|B#3' ELSE p_brand||'#1|'||p_type||'#4' END AS credits, 'Base|'||p_type||CASE WHEN lower(p_brand)<>lower(p_type) THEN '|'||p_brand ELSE '' END AS studios, 'a|b' AS backdrops FROM part"""
NUMBERS = """WITH p AS (SELECT *, CASE WHEN length(p_partkey::VARCHAR)>=4 THEN substr(p_partkey::VARCHAR,1,4) ELSE lpad(p_partkey::VARCHAR,4,'1') END AS n, CASE WHEN p_size%7=0 THEN NULL WHEN p_size%4=0 THEN 'movie.1080p' ELSE p_name END AS t FROM part),
q AS (SELECT *, CASE WHEN p_size%5=0 THEN 'ABC-'||n WHEN p_size%3=0 THEN 'XYZ-'||n WHEN p_size%2=0 THEN 'QRS-'||n WHEN t='movie.1080p' THEN NULL END AS number FROM p)
SELECT p_partkey, number, CASE WHEN number IS NOT NULL AND t='movie.1080p' THEN number WHEN t IS NOT NULL THEN t ELSE coalesce(number,'Unknown Title') END AS title, CASE WHEN p_size%6=0 THEN 'ID-'||n ELSE 'DEF-'||n END AS query_number FROM q"""
SMALL = """SELECT p_partkey, CASE p_size%4 WHEN 0 THEN p_name WHEN 1 THEN 'FC2-'||p_partkey WHEN 2 THEN p_brand ELSE p_name END AS stripped, CASE WHEN p_size%6=0 THEN 'Note A. Note B. own' WHEN p_size%2=0 THEN 'Note A. Note B.' WHEN p_size%3=0 THEN 'own' END AS note,
 CASE WHEN p_size%9<>0 THEN (p_size+1950)||'-01-01' END AS since, CASE WHEN p_size%9<>0 THEN (p_size+1951)||'-01-01' END AS before, CAST(least(1000, round(p_size*25.0)) AS INTEGER) AS ten, CAST(least(p_size*30,1000) AS INTEGER) AS hundred,
 CASE WHEN p_size%2=0 THEN CAST(p_size AS BIGINT) END AS whole, CASE WHEN p_size%3=0 THEN 'ab_c-9' END AS hash, p_brand AS maker, length(p_name||' '||p_type||' '||p_brand)>=24 AND NOT contains(p_name||' '||p_type||' '||p_brand,'Brand#1') AS outline,
 CASE WHEN p_size%2=0 THEN 'fast_safe' END AS label, CAST(p_size+1 AS BIGINT) AS total FROM part"""
PAGE_URLS = """SELECT page_id, CASE page_id%4 WHEN 0 THEN 'https://h.example/p/a/b' WHEN 1 THEN 'https://c.example/x' WHEN 2 THEN 'https://h.example/p/d.MP4?x=1' ELSE 'https://e.example/v.m3u8' END AS joined,
 CASE page_id%4 WHEN 0 THEN 'https://h.example/a/b' WHEN 1 THEN 'https://c.example/x' WHEN 2 THEN 'https://h.example/p/d.MP4?x=1' ELSE 'https://e.example/v.m3u8' END AS resolved, page_id%4 IN (2,3) AS video,
 CASE page_id%5 WHEN 0 THEN 'aliyun' WHEN 1 THEN 'mobile' WHEN 2 THEN 'magnet' WHEN 3 THEN 'other' END AS kind, CASE page_id%6 WHEN 0 THEN 'missing_url' WHEN 1 THEN 'invalid_render_url' WHEN 2 THEN 'invalid_render_url_scheme' WHEN 3 THEN 'invalid_render_url_credentials' WHEN 4 THEN 'invalid_render_url' END AS fault,
 page_id%3<>2 AS requested FROM pages WHERE url IS NOT NULL"""
LINKS = """WITH c AS (SELECT *, c_custkey AS k FROM customer), s AS (SELECT *, trim(regexp_replace(lower(c_name),'[^a-z0-9]+','-','g'),'-') AS slug FROM c WHERE k%3=0)
SELECT k AS query_id, 'm'||k AS id, 'T' AS title, 'pansou:ch' AS source, 700 AS score, 'https://pan.quark.cn/s/'||k AS url, 'https://pan.quark.cn/s/'||k AS normalized_url, 'quark' AS link_type, 'pw' AS password FROM c WHERE k%2=0
UNION ALL SELECT k, 'pansou:merged:web:0', c_name||' web resource', 'pansou', 650, 'https://W.example/'||k||'#f', 'https://w.example/'||k, 'web', NULL FROM c WHERE k%2=1
UNION ALL SELECT k, 'pansou:merged:magnet:0', c_name||' magnet resource', 's', 650, 'MAGNET:?xt='||k, 'magnet:?xt='||k, 'magnet', NULL FROM c WHERE k%2=1
UNION ALL SELECT k, 'fixture:'||slug||':pack', c_name||' release pack', 'fixture', 900, 'https://pan.quark.cn/s/'||slug, 'https://pan.quark.cn/s/'||slug, 'quark', 'pw' FROM s
UNION ALL SELECT k, 'fixture:'||slug||':pack', c_name||' release pack', 'fixture', 900, 'magnet:?xt=urn:btih:0123456789abcdef', 'magnet:?xt=urn:btih:0123456789abcdef', 'magnet', NULL FROM s
UNION ALL SELECT k, 'fixture:'||slug||':archive', c_name||' 1080p archive', 'fixture', 800, 'https://www.aliyundrive.com/s/'||slug, 'https://www.aliyundrive.com/s/'||slug, 'aliyun', NULL FROM s
UNION ALL SELECT k, 'fixture:'||slug||':archive', c_name||' 1080p archive', 'fixture', 800, 'https://PAN.QUARK.CN/s/'||slug||'#duplicate', 'https://pan.quark.cn/s/'||slug, 'quark', 'pw' FROM s"""
REQUESTS = """SELECT c_custkey, '{"kw":"'||c_name||'","refresh":'||CASE WHEN c_custkey%2=0 THEN 'true' ELSE 'false' END||',"res":"results"'||CASE c_custkey%3 WHEN 0 THEN ',"cloud_types":["quark"]' WHEN 2 THEN ',"cloud_types":["baidu"]' ELSE '' END||',"limit":20}' AS request FROM customer"""
CAST = """SELECT o_orderkey, CASE WHEN k%13=0 THEN 'unsupported_protocol' WHEN k%17=0 THEN 'receiver_app_id_missing' WHEN o_custkey%10=0 AND k%2<>0 THEN 'unknown_target' WHEN k%11<>0 AND k%7 IN (1,2) THEN 'unsafe_transport_url' WHEN k%3=0 AND k%11=0 THEN 'missing_transport_url'
 WHEN k%3=0 AND k%5=0 THEN 'missing_content_type' WHEN k%3=1 AND k%4=0 THEN 'missing_seek_position' WHEN k%3=2 AND k%9=0 THEN 'missing_volume' ELSE 'accepted' END AS outcome FROM (SELECT *, o_orderkey AS k FROM orders)"""
ENDPOINTS = "SELECT event_id, CASE WHEN event_id%11=0 THEN 'multiple' WHEN event_id%7=0 THEN 'invalid' WHEN event_id%5=0 THEN 'template' WHEN event_id%3=0 THEN 'ready' ELSE 'ack_only' END AS status, event_type='click' AND event_id%4<>0 AS accepted FROM events"
DRIFT = r"""WITH c AS (SELECT page_id%7 AS suite, strlen(html)>0 AND strlen(trim(regexp_replace(regexp_replace(regexp_replace(html,'<[^>]*>',' ','g'),'(?s)<.*$',' ','g'),'[\s\x1c-\x1f\x85\xa0]+',' ','g')))>=900 AND (page_id%2<>0 OR contains(html,'<h1>')) AS ok FROM pages WHERE url IS NOT NULL)
SELECT suite, count(*) AS n_cases, count(*) FILTER (NOT ok) AS n_failed, CASE WHEN count(*) FILTER (NOT ok)=0 THEN 'ok' ELSE 'failed' END AS status FROM c GROUP BY suite"""
_KEYS = "CASE WHEN event_id%2=0 AND props IS NOT NULL THEN list_sort(json_keys(props)) ELSE [] END"
PAYLOADS = f"""WITH e AS (SELECT *, CAST(event_id AS VARCHAR) AS i, strftime(ts,'%Y-%m-%d') AS d, {_KEYS} AS keys FROM events)
SELECT event_id, '{{"schema":"notification.library_scanned.v1","summary":"Event '||event_type||'","event":{{"event_id":"'||i||'","event_kind":"'||event_type||'","subject_kind":"user","subject_id":"'||user_id||'","occurred_at":"'||d||'","attempt":1}},"payload_keys":['||array_to_string(list_transform(keys, lambda k: '"'||k||'"'),',')||']}}' AS webhook,
 '{{"schema":"notification.embed.library_scanned.v1","content":"Event '||event_type||'","embeds":[{{"title":"Library scanned","fields":[{{"name":"Event","value":"'||event_type||'","inline":true}},{{"name":"Subject","value":"user '||user_id||'","inline":true}},{{"name":"Attempt","value":"1","inline":true}},{{"name":"Occurred at","value":"'||d||'","inline":false}},{{"name":"Payload keys","value":"'||CASE WHEN len(keys)=0 THEN 'none' ELSE array_to_string(keys,', ') END||'","inline":false}}]}}]}}' AS embed,
 '{{"origin":"metadata","request_id":"'||i||'","query":{{"title":"'||event_type||'"'||CASE WHEN event_id%3=0 THEN ',"year":1999' ELSE '' END||',"language":"en"}},"selected_candidate":{{"provider":"p0","provider_id":"'||i||'","confidence_milli":910,"kind":"poster"}}}}' AS provenance,
 '{{"query":{{"title":"'||event_type||'","language":"en"}},"provider_execution":{{"selected":["p0"]}},"candidates":[{{"provider":"p0","provider_id":"'||i||'","confidence_milli":910}}]}}' AS response FROM e"""
FAN_OUT = """WITH s AS (SELECT event_id, o, CASE o WHEN 0 THEN 'http' WHEN 1 THEN 'discord' ELSE 'telegram' END AS provider, (event_id*(o+2))%7 AS h FROM events, (VALUES (0),(1),(2)) v(o)), f AS (SELECT *, min(CASE WHEN h IN (0,1) THEN o END) OVER (PARTITION BY event_id) AS bad FROM s)
SELECT event_id, provider, CASE WHEN o>bad THEN 'not_sent' WHEN h=2 THEN 'disabled' WHEN bad IS NULL OR o<bad THEN 'sent' ELSE 'failed' END AS provider_status, CASE WHEN o=bad THEN h=0 END AS retryable FROM f"""
WRITTEN = "SELECT CASE WHEN c_custkey%10=0 THEN 'failed' WHEN NOT c_acctbal>0 THEN 'skipped' WHEN c_mktsegment='BUILDING' THEN 'failed' ELSE 'submitted' END AS write_status, CASE WHEN c_custkey%10=0 THEN 'invalid_target' WHEN NOT c_acctbal>0 THEN 'no_candidates' WHEN c_mktsegment='BUILDING' THEN 'permission_denied' END AS write_reason, count(*) AS n FROM customer GROUP BY ALL"
TRANSITIONS = """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS job_key, event_id AS i, event_type AS t, min(event_id) FILTER (event_type='click') OVER (PARTITION BY user_id) AS born FROM events),
s AS (SELECT *, CASE WHEN i<born OR born IS NULL THEN 'not_found' WHEN i=born THEN 'queued' WHEN t='view' THEN 'paused' WHEN t='signup' THEN 'running' WHEN t='purchase' THEN 'cancelled' END AS st FROM e),
g AS (SELECT *, count(st) OVER (PARTITION BY job_key ORDER BY i) AS grp, max(CASE WHEN t='purchase' AND i>=born THEN 100000 ELSE 0 END) OVER (PARTITION BY job_key ORDER BY i) AS pct FROM s)
SELECT job_key, i AS request_id, first_value(st) OVER (PARTITION BY job_key, grp ORDER BY i) AS state, CAST(pct AS INTEGER) AS percent_milli FROM g"""

_TITLE = r"""regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)"""
_FLAT = r"trim(regexp_replace({}, '[\s\x1c-\x1f\x85\xa0]+', ' ', 'g'))"
_FIRST = f"list_filter(list_transform(string_split_regex({_ENT.format(_TITLE)}, '[,/|、]'), lambda x: {_FLAT.format('x')}), lambda x: x<>'')[1]"
_YEARS = "list_filter(regexp_extract_all(regexp_replace(html,'<[^>]*>',' ','g'),'[0-9]+'), lambda x: length(x)=4 AND x BETWEEN '1888' AND '2100')"
FACTS = f"""SELECT page_id, {_FIRST} AS title, {NULLS} AS overview, {NULLS} AS release_date, CAST({_YEARS}[1] AS INTEGER) AS release_year, CAST(NULL AS INTEGER) AS runtime_minutes, CAST(NULL AS INTEGER) AS score_milli, CAST(NULL AS BIGINT) AS vote_count, '' AS genres, '' AS tags,
 '' AS poster_urls, {NULLS} AS canonical_url FROM pages WHERE url IS NOT NULL"""
GENERIC = f"""SELECT page_id AS query_id, CASE WHEN page_id%2=0 THEN 'browser-worker:recipe:' ELSE 'browser-worker:' END||url AS provider_id, {_FIRST} AS title, 'asked' AS original_title, CASE WHEN page_id%2=0 THEN 'recipe_extracted' ELSE 'text_extracted' END AS outcome,
 page_id%2<>0 AS has_overview, 'en' AS language FROM pages WHERE url IS NOT NULL"""
_WORD = "regexp_replace({}, '[^A-Za-z0-9]', '', 'g')"
SEARCH = f"""WITH l AS (SELECT page_id, url, unnest(range(len({_HREF.format(1)}))) AS position, unnest({_HREF.format(1)}) AS h, unnest({_HREF.format(2)}) AS t, trim({_ENT.format(_HREF.format(2) + '[2]')}) AS word FROM pages WHERE url IS NOT NULL),
d AS (SELECT page_id, url, {_ABS} AS href, trim({_ENT.format('t')}) AS t, word, row_number() OVER (PARTITION BY page_id, {_ABS}, t ORDER BY position) AS again, position FROM l),
n AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY position)-1 AS place FROM d WHERE again=1)
SELECT page_id, CAST(place AS INTEGER) AS position, href FROM n WHERE NOT contains(href,'/search') AND NOT contains(href,'result_published') AND (contains(upper({_WORD.format('t')}), upper({_WORD.format('word')})) OR contains(upper({_WORD.format('href')}), upper({_WORD.format('word')})))"""

PROVIDER_CLUSTERS = "SELECT c_custkey AS fact, min(c_custkey) OVER (PARTITION BY c_custkey//4) AS cluster FROM customer"
PAYLOAD_IDS = """SELECT c_custkey, CASE c_custkey%4 WHEN 0 THEN 'imdb:tt'||c_custkey||CASE WHEN c_custkey>0 AND c_custkey<>7 THEN '|tmdb:'||c_custkey ELSE '' END||'|tmdb:7' WHEN 1 THEN 'tvdb:'||c_custkey||'|imdb:x|tmdb:'||c_custkey WHEN 2 THEN 'imdb:tt'||c_custkey ELSE '' END AS ids FROM customer"""
STATES = """WITH s AS (SELECT unnest(['theporndb','prestige','caribbean','1pondo','10musume','dmm','xcity','mgstage','javdb','fc2','jav321','fc2ppvdb','airav','javbus','avsox','javlibrary','fixture','tmdb','bangumi','browser_worker','douban','anilist']) AS provider, unnest(range(22)) AS ordinal)
SELECT provider, CASE WHEN NOT (CASE WHEN c_custkey%2=0 THEN provider IN ('tmdb','dmm') ELSE provider='fixture' END) THEN 'disabled' WHEN provider='fixture' OR (provider='tmdb' AND c_custkey%3=0) THEN 'ready' ELSE 'unavailable' END AS state, count(*) AS n, CAST(min(ordinal) AS INTEGER) AS ordinal FROM s, customer GROUP BY 1, 2"""
KNOWN = "SELECT coalesce(c_acctbal>0, FALSE) AS known, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders LEFT JOIN customer ON c_custkey=o_custkey GROUP BY 1"
# The variants of an even size's title are the title, the name, and both without marks; of an odd size's the name alone.
VARIANT = """WITH t AS (SELECT *, p_name||CASE WHEN p_size%2=0 THEN ' ('||p_brand||')' ELSE '' END AS title FROM part), f AS (SELECT DISTINCT title FROM t WHERE p_size%10=4),
q AS (SELECT p_partkey AS query_id, p_name, p_size%2=0 AS two, title IN (SELECT title FROM f) AS part FROM t),
h AS (SELECT q.query_id, p.p_partkey AS id, p.p_size, CAST(row_number() OVER (PARTITION BY q.query_id ORDER BY p.p_size DESC, p.p_partkey) AS INTEGER) AS rank, part FROM q JOIN part p ON p.p_name=q.p_name)
SELECT query_id, id, rank, CASE WHEN p_size>20 AND p_size%5<>0 THEN 'enriched' ELSE 'degraded' END AS outcome, CASE WHEN p_size<=20 THEN 'no_detail' WHEN p_size%5=0 THEN 'enrichment_failed' END AS degraded_by, part AS partial FROM h WHERE rank<=3"""

ORACLES = {
    "provider_clusters": PROVIDER_CLUSTERS, "payload_ids": PAYLOAD_IDS, "source_states": STATES, "known_commands": KNOWN, "variant_search": VARIANT,
    "html_facts": FACTS, "generic_page_candidates": GENERIC, "stream_breaker": BREAKER, "html_links": HTML_LINKS, "page_lines": LINES, "search_results": SEARCH, "page_candidates": PAGE_CANDIDATES, "official_candidates": OFFICIAL, "titled_candidates": TITLED, "source_presets": PRESETS, "default_preferences": PREFERENCES,
    "request_policies": POLICIES, "emitted_ids": EMITTED, "breaker_replay": BREAKER, "batch_reuse": REUSE, "batch_reports": REPORTS, "batch_scrape": SCRAPE, "batch_resume": RESUME, "batch_failures": FAILURES, "direct_lookups": DIRECT, "external_lookups": EXTERNAL,
    "enrichments": ENRICHMENTS, "device_targets": TARGETS, "source_order": SOURCE_ORDER, "field_evidence": EVIDENCE, "fused_scores": FUSED_SCORES, "artwork_preferences": ARTWORK, "native_projection": NATIVE, "query_numbers": NUMBERS, "small_values": SMALL,
    "page_urls": PAGE_URLS, "link_sources": LINKS, "link_requests": REQUESTS, "cast_commands": CAST, "endpoints": ENDPOINTS, "drift": DRIFT, "payloads": PAYLOADS, "fan_out": FAN_OUT, "written_back": WRITTEN, "job_transitions": TRANSITIONS,
}
