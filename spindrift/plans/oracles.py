"""DuckDB SQL with the same results as the registered queries."""

# What the queries must give, stated here again so that a slip in the library does not pass on both sides.
EXTENSIONS = ("avi", "flv", "m2ts", "m4v", "mkv", "mov", "mp4", "mpeg", "mpg", "ts", "webm", "wmv")
NOISE = ("AAC", "AVC", "BD", "FHD", "HD", "HEVC", "HDR", "UHD", "WEB", "XVID")
QUALITY_WORDS = ("1080p", "2160p", "720p", "x264", "x265", "h264", "h265", ".mp4", ".mkv", ".avi")
SERIES = ("SIRO", "LUXU", "ARA", "GANA", "MAAN", "MIUM")
FORBIDDEN = ("bearer", "source_locator", "file://", "local://")
HOSTS = {
    "aliyun": ("aliyundrive.com", "alipan.com"),
    "baidu": ("pan.baidu.com", "yun.baidu.com"),
    "quark": ("pan.quark.cn", "drive.quark.cn"),
    "tianyi": ("cloud.189.cn",),
    "uc": ("drive.uc.cn", "uc.cn"),
    "mobile": ("caiyun.139.com", "yun.139.com"),
    "115": ("115.com", "115cdn.com"),
    "pikpak": ("mypikpak.com", "pikpakdrive.com"),
    "xunlei": ("pan.xunlei.com", "xunlei.com"),
    "123": ("123pan.com", "123684.com"),
}
LINK_TYPES = ("aliyun", "baidu", "quark", "tianyi", "uc", "mobile", "115", "pikpak", "xunlei", "123", "magnet", "ed2k", "web", "other")
ROUTES = ("censored", "uncensored", "fc2", "amateur", "western", "domestic", "unknown")
SOURCES = (
    ("theporndb", 700, 700, 750, 700, "censored uncensored western unknown"),
    ("prestige", 650, 450, 650, 650, "censored"),
    ("caribbean", 620, 400, 620, 620, "uncensored"),
    ("1pondo", 620, 400, 620, 620, "uncensored"),
    ("10musume", 620, 400, 620, 620, "uncensored"),
    ("dmm", 600, 500, 600, 500, "censored"),
    ("xcity", 560, 300, 560, 200, "censored amateur"),
    ("mgstage", 550, 450, 550, 600, "amateur censored"),
    ("javdb", 500, 550, 500, 400, "censored uncensored amateur western domestic unknown"),
    ("fc2", 450, 350, 450, 300, "fc2"),
    ("jav321", 450, 550, 350, 250, "censored uncensored amateur"),
    ("fc2ppvdb", 430, 450, 450, 350, "fc2"),
    ("airav", 420, 420, 420, 100, "censored uncensored fc2 amateur western"),
    ("javbus", 400, 400, 400, 200, "censored uncensored"),
    ("avsox", 380, 350, 380, 0, "censored uncensored fc2 amateur western"),
    ("javlibrary", 350, 600, 0, 0, "censored uncensored amateur"),
    ("fixture", 0, 0, 0, 0, ""),
    ("tmdb", 0, 0, 0, 0, ""),
    ("bangumi", 0, 0, 0, 0, ""),
    ("browser_worker", 0, 0, 0, 0, ""),
    ("douban", 0, 0, 0, 0, ""),
    ("anilist", 0, 0, 0, 0, ""),
)



_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lower(x: str) -> str:
    return f"translate({x},'{_UP}','{_LOW}')"


def _upper(x: str) -> str:
    return f"translate({x},'{_LOW}','{_UP}')"


def _trim(x: str) -> str:
    return rf"regexp_replace({x},'^\s+|\s+$','','g')"


def _collapse(x: str) -> str:
    return rf"trim(regexp_replace({x},'\s+',' ','g'))"


def _norm(x: str) -> str:
    return rf"lower(regexp_replace({x},'[^\p{{L}}\p{{N}}]','','g'))"


def _search(x: str) -> str:
    return rf"trim(regexp_replace(lower(regexp_replace({x},'[^\p{{L}}\p{{N}}]',' ','g')),' +',' ','g'))"


TITLES = f"""SELECT doc_id, md5({_norm('text')}) AS title_md5, md5({_search('text')}) AS search_md5, md5({_collapse('text')}) AS collapsed_md5,
 CAST(length(regexp_replace(text,'[^A-Za-z0-9]','','g')) AS BIGINT) AS compact_chars FROM documents"""

_TAIL = "CASE WHEN p_size%3=0 THEN ' ('||p_brand||') ['||p_type||'] ' WHEN p_size%3=1 THEN ' ('||p_brand||')' ELSE ' ( )' END"
TITLE_VARIANTS = f"""WITH t AS (SELECT p_partkey, trim(' '||p_name||{_TAIL}) AS raw, CASE WHEN p_size%3=2 THEN NULL ELSE p_name END AS stripped FROM part),
v AS (SELECT *, list_filter([raw, stripped, {_search('raw')}, {_search('stripped')}], lambda x: x IS NOT NULL AND x<>'') AS l FROM t),
d AS (SELECT *, list_filter(l, lambda x, i: list_position(list_transform(l, lambda y: {_lower('y')}), {_lower('x')}) = i) AS u FROM v)
SELECT p_partkey, coalesce(stripped,'-') AS stripped, array_to_string(u,'|') AS variants, CAST(len(u) AS BIGINT) AS n_variants FROM d"""

_S = "(' '||p_name||' _ '||p_type||'!#')"
SLUGS = rf"""SELECT p_partkey, regexp_replace(regexp_replace({_lower(_S)},'[^a-z0-9]+','-','g'),'^-+|-+$','','g') AS slug,
 regexp_replace(regexp_replace(regexp_replace({_lower(_S)},'[\s_-]','-','g'),'[^a-z0-9-]','','g'),'^-+|-+$','','g') AS slug_dropping,
 regexp_replace(regexp_replace({_lower(_S)},'[^a-z0-9]','-','g'),'^-+|-+$','','g') AS slug_each,
 replace(replace(p_name,' ','%20'),'é','%C3%A9')||'%20%2A~%2F%C3%A9' AS encoded, p_name AS no_year, p_name||'  x' AS excerpt FROM part"""

MARKUP = rf"""SELECT page_id, md5({_collapse("regexp_replace(regexp_replace(html,'<[^>]*>',' ','g'),'(?s)<.*$',' ','g')")}) AS text_md5,
 CAST(nullif(regexp_extract(html,'([0-9]+)',1),'') AS BIGINT) AS first_integer, coalesce(nullif(regexp_extract(html,'(?:^|\s)(\d{{4}}-\d{{2}}\S\d{{2}})',1),''),'-') AS first_date FROM pages"""

_K = "p_partkey"
_FILE = f"""CASE p_size%10 WHEN 0 THEN '/media/[HD] ssni'||lpad({_K}::VARCHAR,5,'0')||' 1080p x264.mkv' WHEN 1 THEN 'fc2-ppv-'||lpad({_K}::VARCHAR,7,'1')||'.mp4'
 WHEN 2 THEN 'C:\\v\\Studio.'||lpad(({_K}%100)::VARCHAR,2,'0')||'.'||lpad(({_K}%12+1)::VARCHAR,2,'0')||'.15.avi' WHEN 3 THEN '300MIUM-'||lpad({_K}::VARCHAR,3,'0')||' uhd'
 WHEN 4 THEN '01'||lpad(({_K}%10000)::VARCHAR,4,'0')||'_'||lpad(({_K}%1000)::VARCHAR,3,'0') WHEN 5 THEN 'n'||lpad(({_K}%10000)::VARCHAR,4,'0')||'.wmv'
 WHEN 6 THEN 'MDX'||lpad({_K}::VARCHAR,4,'0')||'-clip' WHEN 7 THEN 'MKY-hs-'||{_K}::VARCHAR WHEN 8 THEN 'HEVC 1080 web '||{_K}::VARCHAR||' plain title' ELSE p_name END"""


def _short(x: str) -> str:
    return f"CASE WHEN length({x})>3 AND ltrim({x},'0')<>'' THEN ltrim({x},'0') ELSE {x} END"


def _ex(pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract(t,'{pattern}',{group}),'')"


_HOME = " (?:(MD[A-Z]*)([0-9][0-9A-Z]*)|MKY ([A-Z]+) ([0-9]+)) "
_DATED = " ([A-Z]{3,}) ([0-9]{2}|[0-9]{4}) (0[1-9]|1[0-2]) (0[1-9]|[12][0-9]|3[01]) "
_AM = f" ((?:{'|'.join(SERIES)})|[0-9A-Z]*[0-9][0-9A-Z]*(?:{'|'.join(SERIES)})) ([0-9]{{3,}}) "
_PAIR = " ([0-9]{6}) ([0-9]{2,4}) "
_BAD = "|".join(NOISE)
CATALOG_NUMBERS = f"""WITH f AS (SELECT p_partkey, {_FILE} AS file FROM part),
b AS (SELECT *, trim(regexp_replace({_upper(f"regexp_replace(trim(regexp_extract(file,'([^/{chr(92)}{chr(92)}]*)$',1)),'(?i){chr(92)}.({'|'.join(EXTENSIONS)})$','')")},'[^A-Z0-9]+',' ','g')) AS tokens FROM f),
t AS (SELECT *, ' '||tokens||' ' AS t, list_filter(regexp_extract_all(' '||replace(tokens,' ','  ')||' ',' [A-Z]{{2,10}}(?:  )?[0-9]{{2,7}} '), lambda x: NOT regexp_matches(x,'^ (?:{_BAD})[0-9 ]'))[1] AS g FROM b),
n AS (SELECT *, {_ex(' FC2(?:PPV|PPV | PPV | )?([0-9]{5,})')} AS fc2, {_ex(_HOME)} AS md, {_ex(_HOME, 2)} AS mdn, {_ex(_HOME, 3)} AS ms, {_ex(_HOME, 4)} AS mn,
 {_ex(_DATED)} AS w1, {_ex(_DATED, 2)} AS w2, {_ex(_DATED, 3)} AS w3, {_ex(_DATED, 4)} AS w4, {_ex(_AM)} AS a1, {_ex(_AM, 2)} AS a2, {_ex(_PAIR)} AS d1, {_ex(_PAIR, 2)} AS d2,
 {_ex(' ([CHN][0-9]{4}) ')} AS five, regexp_extract(g,'([A-Z]+)',1) AS g1, regexp_extract(g,'([0-9]+)',1) AS g2 FROM t),
r AS (SELECT *, CASE WHEN fc2 IS NOT NULL THEN 'FC2-'||fc2 WHEN md IS NOT NULL THEN md||'-'||({_short('mdn')}) WHEN ms IS NOT NULL THEN 'MKY-'||ms||'-'||mn WHEN w1 IS NOT NULL THEN w1||'.'||w2||'.'||w3||'.'||w4
 WHEN a1 IS NOT NULL THEN a1||'-'||a2 WHEN d1 IS NOT NULL THEN d1||'_'||d2 WHEN five IS NOT NULL THEN five WHEN g IS NOT NULL THEN g1||'-'||({_short('g2')}) END AS num,
 CASE WHEN fc2 IS NOT NULL THEN 'fc2' WHEN md IS NOT NULL OR ms IS NOT NULL THEN 'domestic' WHEN w1 IS NOT NULL THEN 'western' WHEN a1 IS NOT NULL THEN 'amateur' WHEN d1 IS NOT NULL OR five IS NOT NULL THEN 'uncensored' WHEN g IS NOT NULL THEN 'censored' ELSE 'unknown' END AS route FROM n)
SELECT p_partkey, tokens, coalesce(num,'-') AS number, route, CASE WHEN regexp_replace(coalesce(num,'-'),'[-_. ]','','g')=coalesce(num,'-') THEN coalesce(num,'-') ELSE coalesce(num,'-')||'|'||regexp_replace(coalesce(num,'-'),'[-_. ]','','g') END AS terms,
 CASE WHEN num IS NOT NULL AND (contains(file,'/') OR contains(file,'{chr(92)}') OR {' OR '.join(f"contains(lower(file),'{w}')" for w in QUALITY_WORDS)}) THEN num ELSE {_collapse('file')} END AS title FROM r"""

_AUTH = ("https://PAN.quark.cn/s/", "http://user@www.AliPan.com:80/s/", "https://pan.baidu.com/s/", "magnet:?xt=URN:btih:", "ed2k://|FILE|", "https://Example.org/Path/", "https://notuc.cn/", "https://drive.uc.cn/s/", "no-scheme/", "https://cloud.189.cn/t/")


def _linked(key: str) -> str:
    cases = " ".join(f"WHEN {i} THEN '{a}'" for i, a in enumerate(_AUTH))
    return f"' '||CASE {key}%10 {cases} END||{key}::VARCHAR||CASE WHEN {key}%2=0 THEN '#Frag' ELSE '?Q=1' END"


def _normal(u: str) -> str:
    n = _trim(f"split_part({_trim(u)},'#',1)")
    form = "(?s)^(.*?)://([^/?]*)(.*)$"
    whole = f"{_lower(f"regexp_extract({n},'{form}',1)")}||'://'||{_lower(f"regexp_extract({n},'{form}',2)")}||regexp_extract({n},'{form}',3)"
    return f"CASE WHEN {n}='' THEN NULL WHEN regexp_matches({_lower(n)},'^(magnet:[?]|ed2k://)') THEN {_lower(n)} WHEN contains({n},'://') THEN {whole} ELSE {n} END"


def _host(u: str) -> str:
    return f"nullif(trim(regexp_extract(regexp_replace(regexp_extract({u},'(?s)^.*?://([^/?#]*)',1),'^.*@',''),'^([^:]*)',1)),'')"


def _kind(u: str) -> str:
    low = _lower(_trim(u))
    h = _host(low)
    cases = " ".join("WHEN " + " OR ".join(f"{h}='{s}' OR ends_with({h},'.{s}')" for s in hosts) + f" THEN '{name}'" for name, hosts in HOSTS.items())
    return f"CASE WHEN starts_with({low},'magnet:?') THEN 'magnet' WHEN starts_with({low},'ed2k://') THEN 'ed2k' WHEN {h} IS NULL THEN 'other' {cases} ELSE 'web' END"


_CLOUD = ",".join(f"'{x}'" for x in HOSTS)
_LOWURL = _lower(_trim("url"))
URLS = rf"""WITH u AS (SELECT page_id AS id, url, 'web' AS source FROM pages UNION ALL SELECT -s_suppkey, {_linked('s_suppkey')}, CASE WHEN s_suppkey%3=0 THEN 'Fixture:x' ELSE 'live' END FROM supplier),
k AS (SELECT *, {_kind('url')} AS link_type, list_filter(string_split(regexp_replace({_trim('url')},'[?#].*$',''),'/'), lambda x: x<>'' AND x NOT IN ('index.html','detail')) AS parts FROM u)
SELECT id, {_normal('url')} AS normalized_url, coalesce({_host(_LOWURL)},'-') AS host, link_type,
 CASE WHEN {_lower("split_part(source,':',1)")}='fixture' AND link_type IN ({_CLOUD}) THEN 'reachable' WHEN link_type IN ('magnet','ed2k','other') THEN 'unsupported' ELSE 'unknown' END AS health,
 regexp_matches({_LOWURL},'^(?:magnet:[?]|ed2k://|https?://)') AS exact,
 regexp_matches({_LOWURL},'^https?://[^/]') AND NOT regexp_matches({_LOWURL},'\s') AND NOT contains(regexp_extract({_LOWURL},'^https?://([^/]*)',1),'@') AND {' AND '.join(f"NOT contains({_LOWURL},'{w}')" for w in FORBIDDEN)} AS safe,
 coalesce(nullif(regexp_extract(url,'(?s)^.*?utm_source=([^/?#&]*)',1),''),'-') AS utm_source, coalesce(parts[-1],'-') AS last_segment FROM k"""

_LINKS = f"""l AS (SELECT l_orderkey AS id, l_linenumber AS place, trim({_linked('l_partkey')}) AS url, 'supp'||l_suppkey::VARCHAR AS source FROM lineitem),
k AS (SELECT *, {_normal('url')} AS normalized_url, {_kind('url')} AS link_type FROM l),
o AS (SELECT o_orderkey AS id, o_orderpriority AS title, CAST(floor(o_totalprice) AS INTEGER) AS score FROM orders),
j AS (SELECT k.*, o.title, o.score FROM k JOIN o USING (id))"""
LINK_SEARCH = f"""WITH {_LINKS},
w AS (SELECT * FROM j WHERE link_type IN ('quark','aliyun','magnet','ed2k','web')),
b AS (SELECT DISTINCT score, title, id FROM w ORDER BY score DESC, title, id LIMIT 100),
s AS (SELECT w.* FROM w JOIN b USING (id))
SELECT normalized_url, arg_min(url, (-score, title, s.id, place)) AS url, arg_min(link_type, (-score, title, s.id, place)) AS link_type, array_to_string(list_sort(list(DISTINCT source)),',') AS sources FROM s GROUP BY normalized_url"""
LINK_GROUPS = f"""WITH {_LINKS}, m AS (SELECT normalized_url, arg_min(link_type, (-score, title, id, place)) AS link_type FROM j GROUP BY normalized_url)
SELECT link_type, CAST(list_position([{','.join(f"'{x}'" for x in LINK_TYPES)}], link_type) AS INTEGER) AS type_order, count(*) AS n_links, min(normalized_url) AS first_url, max(normalized_url) AS last_url, CAST(sum(length(normalized_url)) AS BIGINT) AS chars FROM m GROUP BY link_type"""

GROUPED = f"""WITH {_LINKS}, m AS (SELECT normalized_url, arg_min(link_type, (-score, title, id, place)) AS link_type, array_to_string(list_sort(list(DISTINCT source)),',') AS sources FROM j GROUP BY normalized_url)
SELECT link_type, CAST(list_position([{','.join(f"'{x}'" for x in LINK_TYPES)}], link_type) AS INTEGER) AS type_order, normalized_url, sources FROM m"""

QUERY_PAYLOADS = """WITH p AS (SELECT p_partkey AS id, p_name, p_partkey AS k FROM part)
SELECT id, trim(regexp_replace(p_name||' x',' +',' ','g')) AS title, CAST(CASE WHEN k%4=3 THEN -1 ELSE k%120+1900 END AS INTEGER) AS year, CASE WHEN k%5=0 THEN 'fr' ELSE 'en-US' END AS language,
 CASE WHEN k%3=0 THEN 'imdb:tt'||k::VARCHAR||CASE WHEN k%7-2>0 THEN '|tmdb:'||(k%7-2)::VARCHAR ELSE '' END WHEN k%3=1 AND k>0 THEN 'tmdb:'||k::VARCHAR ELSE '' END AS external_ids,
 array_to_string(list_sort(list_filter([CASE WHEN k%4 IN (0,2,3) THEN 'year' END, CASE WHEN k%4=1 THEN 'release_year' END, CASE WHEN k%4=2 THEN 'air_date' END, CASE WHEN k%3<>2 THEN 'external_ids' END, CASE WHEN k%3<>0 THEN 'tmdb_id' END, 'title', 'name', CASE WHEN k%5=0 THEN 'language' END], lambda x: x IS NOT NULL)),',') AS keys FROM p"""

_PAIRS = f"""p AS (SELECT p_partkey AS query_id, p_name AS qt, CASE WHEN p_size%5=0 THEN NULL ELSE 1992+p_size%7 END AS qy, CASE WHEN p_size%3=0 THEN p_size::VARCHAR END AS qid, p_type FROM part),
c AS (SELECT l_partkey AS query_id, 's'||lpad(l_suppkey::VARCHAR,6,'0') AS provider, lpad(l_orderkey::VARCHAR,9,'0')||'-'||l_linenumber::VARCHAR AS provider_id, l_linenumber AS n, year(l_shipdate) AS y, CASE WHEN l_returnflag='A' THEN 'EN' WHEN l_returnflag='N' THEN 'ja_JP' END AS lang, l_suppkey::VARCHAR AS cid, CAST(trunc(l_quantity*20) AS INTEGER) AS sm, CAST(trunc(l_extendedprice) AS INTEGER) AS votes FROM lineitem),
m AS (SELECT c.*, qy, qt, qid, [CASE n%4 WHEN 0 THEN qt WHEN 1 THEN upper(qt) WHEN 2 THEN p_type END, CASE WHEN n=5 THEN qt||'!' END] AS titles FROM c JOIN p USING (query_id)),
e AS (SELECT *, CASE WHEN len(list_filter(titles, lambda x: x IS NOT NULL))=0 THEN 'missing_candidate' WHEN list_contains(titles, qt) THEN 'exact' WHEN list_contains(list_transform(list_filter(titles, lambda x: x IS NOT NULL), lambda x: {_norm('x')}), {_norm('qt')}) THEN 'normalized' ELSE 'mismatch' END AS title_outcome,
 CASE WHEN qy IS NULL THEN 'query_missing' WHEN qy=y THEN 'exact' ELSE 'mismatch' END AS year_outcome, CASE WHEN qid IS NULL THEN 'query_missing' WHEN qid=cid THEN 'exact' ELSE 'mismatch' END AS id_outcome,
 CASE WHEN lang IS NULL THEN 'candidate_missing' WHEN lang='EN' THEN 'exact' ELSE 'mismatch' END AS language_outcome,
 CASE WHEN votes>=25 THEN least(greatest(sm-650,0)//25,10) + CASE WHEN votes<100 THEN 0 WHEN votes<1000 THEN 2 WHEN votes<10000 THEN 4 ELSE 6 END ELSE 0 END AS community FROM m),
d AS (SELECT *, CASE title_outcome WHEN 'exact' THEN 360 WHEN 'normalized' THEN 320 WHEN 'mismatch' THEN -160 ELSE 0 END AS td, CASE year_outcome WHEN 'exact' THEN 180 WHEN 'mismatch' THEN -120 ELSE 0 END AS yd, CASE id_outcome WHEN 'exact' THEN 300 WHEN 'mismatch' THEN -100 ELSE 0 END AS xd, CASE language_outcome WHEN 'exact' THEN 40 ELSE 0 END AS ld FROM e),
s AS (SELECT *, CAST(greatest(0, least(1000, 250+community+td+yd+xd+ld)) AS INTEGER) AS confidence_milli FROM d)"""
RANKED = f"""WITH {_PAIRS}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY confidence_milli DESC, provider, provider_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, provider, provider_id, confidence_milli, title_outcome, year_outcome, id_outcome, language_outcome,
 'base:base:250'||CASE WHEN title_outcome<>'missing_candidate' THEN ',title:'||title_outcome||':'||td ELSE '' END||CASE WHEN year_outcome IN ('exact','mismatch') THEN ',year:'||year_outcome||':'||yd ELSE '' END||CASE WHEN id_outcome IN ('exact','mismatch') THEN ',external_id:'||id_outcome||':'||xd ELSE '' END||CASE WHEN language_outcome IN ('exact','mismatch') THEN ',language:'||language_outcome||':'||ld ELSE '' END||CASE WHEN community>0 THEN ',community_score:boost:'||community ELSE '' END AS reasons FROM r WHERE rank<=12"""
EVIDENCE = f"WITH {_PAIRS} SELECT title_outcome, year_outcome, id_outcome, language_outcome, count(*) AS n, min(confidence_milli) AS least, max(confidence_milli) AS most, CAST(sum(community) AS BIGINT) AS community FROM s GROUP BY ALL"

_FACTS = f"""f AS (SELECT doc_id AS fact, source AS provider, lang, n_chars, md5({_norm('text')}) AS whole, string_split(text,chr(10))[-1] AS last_line FROM documents),
g AS (SELECT *, CASE WHEN length(last_line)>=40 THEN md5({_norm('last_line')}) END AS last FROM f),
i AS (SELECT fact, whole AS id FROM g UNION SELECT fact, last FROM g WHERE last IS NOT NULL),
e AS (SELECT DISTINCT a.fact AS a, b.fact AS b FROM i a JOIN i b USING (id)),
w(fact, reach) AS (SELECT DISTINCT a, a FROM e UNION SELECT w.fact, e.b FROM w JOIN e ON w.reach=e.a),
c AS (SELECT fact, min(reach) AS cluster FROM w GROUP BY fact)"""
CLUSTERS = f"WITH RECURSIVE {_FACTS} SELECT fact, cluster FROM c"
CLUSTER_EVIDENCE = f"""WITH RECURSIVE {_FACTS}, x AS (SELECT cluster, provider, 'whole' AS id_provider, whole AS id FROM g JOIN c USING (fact) UNION ALL SELECT cluster, provider, 'last', last FROM g JOIN c USING (fact) WHERE last IS NOT NULL),
h AS (SELECT cluster, id_provider, id, count(DISTINCT provider) AS n FROM x GROUP BY ALL HAVING n>1),
r AS (SELECT cluster, array_to_string(list_sort(list(DISTINCT 'shared_external_id:'||id_provider||':'||n)),',') AS reasons FROM h GROUP BY cluster),
s AS (SELECT cluster, count(*) AS n_facts, list_sort(list(DISTINCT provider)) AS l FROM g JOIN c USING (fact) GROUP BY cluster)
SELECT cluster, n_facts, CASE WHEN len(l)>1 THEN array_to_string(l,',') ELSE '' END AS sources, coalesce(reasons,'') AS merge_reasons FROM s LEFT JOIN r USING (cluster)"""
FUSED = f"""WITH RECURSIVE {_FACTS}, x AS (SELECT cluster, provider, lpad(fact::VARCHAR,12,'0') AS provider_id, fact AS arrival, least(n_chars,1000) AS conf, CASE WHEN n_chars%3<>0 THEN n_chars END AS runtime, lang, CASE WHEN fact%2=0 THEN whole END AS overview FROM g JOIN c USING (fact)),
b AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY conf DESC, provider, provider_id) AS rn, count(*) OVER (PARTITION BY cluster) AS n FROM x),
a AS (SELECT cluster, arg_min(runtime,(CASE provider WHEN 'src3' THEN 0 ELSE 1 END, arrival)) FILTER (runtime IS NOT NULL AND provider IN ('src3','src1')) AS pr, arg_min(runtime,arrival) FILTER (runtime IS NOT NULL) AS fr, arg_min(overview,arrival) FILTER (overview IS NOT NULL AND provider='src2') AS po, arg_min(overview,arrival) FILTER (overview IS NOT NULL) AS fo FROM x GROUP BY cluster)
SELECT cluster, n AS n_facts, provider, provider_id, coalesce(CASE WHEN n>1 THEN coalesce(pr,runtime,fr) ELSE runtime END,-1) AS runtime, lang AS language, coalesce(CASE WHEN n>1 THEN coalesce(po,overview,fo) ELSE overview END,'-') AS overview FROM b JOIN a USING (cluster) WHERE rn=1"""

ARTWORK = """WITH a AS (SELECT l_partkey AS cluster, CASE WHEN l_linenumber%3=0 THEN 'backdrop' ELSE 'poster' END AS kind, CAST(trunc(l_quantity) AS INTEGER)*10%100 AS confidence_milli, CAST(CASE WHEN l_linenumber=2 THEN 0 ELSE trunc(l_quantity)*l_linenumber END AS BIGINT) AS area, 's'||l_suppkey AS provider, l_orderkey::VARCHAR AS provider_id, 'u'||l_linenumber AS source_url FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY cluster, kind ORDER BY confidence_milli DESC, area DESC, provider DESC, provider_id DESC, source_url DESC) AS rn FROM a)
SELECT cluster, kind, confidence_milli, area, provider, provider_id, source_url FROM r WHERE rn=1"""

_CATALOG = "VALUES " + ",".join(f"({i},'{s[0]}',{s[1]},{s[2]},{s[3]},{s[4]},'{s[5] or ' '.join(ROUTES)}')" for i, s in enumerate(SOURCES))
_SRC = f"src AS (SELECT * FROM ({_CATALOG}) v(ordinal, provider, official, community, artwork, trailer, routes))"
SOURCE_STATUS = f"""WITH {_SRC}, r AS (SELECT unnest([{','.join(f"'{x}'" for x in ROUTES)}]) AS route),
m AS (SELECT route, ordinal, provider, CASE WHEN provider IN ('dmm','fc2') THEN 'suppressed' WHEN NOT list_contains(string_split(routes,' '), route) THEN 'skipped_by_route' END AS skip FROM src, r),
n AS (SELECT *, sum(CASE WHEN skip IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY route ORDER BY ordinal) AS place FROM m)
SELECT route, CAST(ordinal AS INTEGER) AS ordinal, provider, coalesce(skip, CASE WHEN place>5 THEN 'budget_exhausted' ELSE 'selected' END) AS status FROM n"""
SOURCE_PREFERENCES = f"WITH {_SRC} " + " UNION ALL ".join(f"SELECT '{q}' AS field_group, string_agg(provider, ',' ORDER BY {q} DESC, ordinal) AS providers FROM src WHERE {q}>0" for q in ("official", "community", "artwork", "trailer"))

_EXEC = """x AS (SELECT user_id AS provider, event_id AS item_index, event_type IN ('error','view') AS failed, value, CASE WHEN event_type IN ('error','view') THEN CASE event_id%5 WHEN 0 THEN 'timeout' WHEN 1 THEN 'rate_limited' WHEN 2 THEN 'auth_or_forbidden' WHEN 3 THEN 'not_found' ELSE 'parse_error' END END AS reason FROM events)"""
STREAKS = f"""WITH {_EXEC}, i AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY provider ORDER BY item_index) AS island FROM x),
s AS (SELECT *, sum(failed::INTEGER) OVER (PARTITION BY provider, island ORDER BY item_index) AS r FROM i)
SELECT provider, CAST(max(r) AS BIGINT) AS longest, count(*) FILTER (r>=2) AS over_threshold FROM s GROUP BY provider"""
SUMMARY = f"""WITH {_EXEC} SELECT provider, count(*) AS n_items, count(*) FILTER (NOT failed AND NOT value<10) AS n_returned, count(*) FILTER (NOT failed AND value<10) AS n_empty, count(*) FILTER (failed) AS n_failed,
 CAST(sum(CASE WHEN failed OR value<10 THEN 0 ELSE CAST(floor(value/10) AS INTEGER) END) AS BIGINT) AS n_candidates, max(item_index) AS last_item, {', '.join(f"count(*) FILTER (reason='{r}') AS n_{r}" for r in ('timeout', 'rate_limited', 'auth_or_forbidden', 'not_found', 'parse_error'))}, count(*) FILTER (reason IN ('timeout','rate_limited')) AS n_retryable FROM x GROUP BY provider"""
LAST = "WITH r AS (SELECT user_id, event_id, event_type, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS INTEGER) AS back FROM events) SELECT * FROM r WHERE back<=20"
STREAM_HISTORY = "WITH r AS (SELECT user_id AS provider, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS back FROM events) SELECT provider, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS event_ids FROM r WHERE back<=20 GROUP BY provider"
STREAM_JOBS = "SELECT user_id::VARCHAR||':'||event_type AS job_key, event_id AS request_id, CASE WHEN event_id=min(event_id) OVER w THEN 'accepted' ELSE 'already_exists' END AS outcome, 'job-'||min(event_id) OVER w AS job_ref FROM events WINDOW w AS (PARTITION BY user_id, event_type)"
REUSE = "SELECT o_orderkey AS item_index, CASE WHEN min(o_orderkey) OVER w < o_orderkey THEN min(o_orderkey) OVER w ELSE -1 END AS reused_from FROM orders WINDOW w AS (PARTITION BY o_custkey, o_orderpriority)"
PAGE = "WITH n AS (SELECT CAST(row_number() OVER (ORDER BY n_nationkey)-1 AS INTEGER) AS item_index, n_name FROM nation) SELECT * FROM n WHERE item_index BETWEEN 8 AND 19"
PRESENCE = rf"""WITH p AS (SELECT url, nullif(regexp_extract(url,'(?s)^.*?utm_source=([^/?#&]*)',1),'') AS utm_source, list_filter(string_split(regexp_replace(url,'[?#].*$',''),'/'), lambda x: x<>'' AND x NOT IN ('index.html','detail'))[-1] AS last_segment, nullif(regexp_extract(html,'(?:^|\s)(\d{{4}}-\d{{2}}\S\d{{2}})',1),'') AS release_date FROM pages)
""" + " UNION ALL ".join(f"SELECT '{c}' AS field, count({c}) AS present, count(*)-count({c}) AS missing FROM p" for c in ("url", "utm_source", "last_segment", "release_date"))
TEMPLATES = """SELECT event_id, CASE event_id%6 WHEN 1 THEN 'unclosed' WHEN 2 THEN 'empty' WHEN 3 THEN 'unknown' WHEN 4 THEN 'unclosed' ELSE 'ok' END AS status,
 CASE event_id%6 WHEN 0 THEN event_type||' '||event_id||' by '||user_id||': '||CASE WHEN props IS NULL OR len(json_keys(props))=0 THEN 'none' ELSE array_to_string(list_sort(json_keys(props)),', ') END WHEN 5 THEN 'attempt 1 $1 '||chr(92)||' end' ELSE '-' END AS rendered FROM events"""
DATES = """WITH d AS (SELECT *, strftime(l_shipdate,'%Y-%m-%d') AS day FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber%2=0 THEN day ELSE '-' END AS iso_date, CAST(substr(day,1,4) AS INTEGER) AS first_year, CAST(substr(day,1,4) AS INTEGER) AS year, CASE WHEN trunc(l_quantity) BETWEEN 1 AND 12 THEN substr(day,1,4)||'-'||lpad(CAST(trunc(l_quantity) AS INTEGER)::VARCHAR,2,'0')||'-31' ELSE '-' END AS built,
 CAST(ceil(l_quantity*61/60) AS BIGINT) AS minutes, CAST(12345 AS BIGINT) AS first_integer FROM d"""
SCORES = """WITH d AS (SELECT *, l_quantity/8 AS r, CAST(trunc(l_extendedprice) AS INTEGER) AS votes FROM lineitem), m AS (SELECT *, CAST(greatest(0,least(1000,round(CASE WHEN r<=5 THEN r*200 ELSE r*100 END))) AS INTEGER) AS rating_milli FROM d)
SELECT l_orderkey, l_linenumber, rating_milli, CAST(CASE WHEN votes>=25 THEN least(greatest(rating_milli-650,0)//25,10)+CASE WHEN votes<100 THEN 0 WHEN votes<1000 THEN 2 WHEN votes<10000 THEN 4 ELSE 6 END ELSE 0 END AS INTEGER) AS community,
 CASE WHEN l_discount-0.02::DOUBLE<0 THEN -1 ELSE CAST(least(round((l_discount-0.02::DOUBLE)*100000),100000) AS INTEGER) END AS milli_percent, CAST(greatest(100*l_linenumber, CASE WHEN l_linenumber>3 THEN least(votes,30000) ELSE 0 END) AS INTEGER) AS delay_ms, (CAST(trunc(l_quantity) AS INTEGER)*10+99 IN (408,429) OR CAST(trunc(l_quantity) AS INTEGER)*10+99 BETWEEN 500 AND 599) AS retryable FROM m"""
ARRAYS = """SELECT p_partkey, p_brand||CASE WHEN lower(p_type)<>lower(p_brand) THEN '|'||p_type ELSE '' END||CASE WHEN lower(p_name) NOT IN (lower(p_type), lower(p_brand)) THEN '|'||p_name ELSE '' END AS merged, CASE WHEN p_name=p_type THEN p_name ELSE p_name||'|'||p_type END AS alternates, p_name||'|'||p_type AS split FROM part"""
HTML_TITLES = f"SELECT page_id, {_collapse("regexp_extract(html,'(?is)<title[^>]*>(.*?)</title>',1)")} AS title, CAST(strlen(html) AS BIGINT) AS html_bytes FROM pages"
COMMANDS = """SELECT o_orderkey, CASE WHEN k%13=0 THEN 'unsupported_protocol' WHEN o_custkey%10=0 THEN 'unknown_target' WHEN k%11<>0 AND k%7 IN (0,1,2) THEN 'unsafe_transport_url' WHEN k%3=0 AND k%11=0 THEN 'missing_transport_url' WHEN k%3=0 AND k%5=0 THEN 'missing_content_type' WHEN k%3=1 AND k%4=0 THEN 'missing_seek_position' WHEN k%3=2 AND k%9=0 THEN 'missing_volume' ELSE 'accepted' END AS outcome FROM (SELECT *, o_orderkey AS k FROM orders)"""
SUBTITLES = """WITH c AS (SELECT c_custkey, c_custkey AS k, regexp_replace(regexp_replace(lower(c_name),'[ _-]','-','g'),'[^a-z0-9-]','','g') AS slug FROM customer),
l AS (SELECT c_custkey, slug, greatest(1,least(k%60-2,50)) AS lim, CASE k%3 WHEN 0 THEN ['en-us','fr'] WHEN 1 THEN ['en'] ELSE ['ab','cs'] END AS langs FROM c)
SELECT c_custkey, langs[i] AS language, slug||'-'||langs[i] AS subtitle_id FROM l, (VALUES (1),(2)) v(i) WHERE i<=len(langs) AND i<=lim"""
INTENTS = "SELECT c_custkey, CASE c_custkey%6 WHEN 0 THEN 'exact_link' WHEN 1 THEN 'external_id' WHEN 2 THEN 'media_title' WHEN 3 THEN 'external_id' WHEN 4 THEN 'media_title' ELSE 'free_text' END AS intent FROM customer"
JOBS = """SELECT o_orderkey, CASE WHEN o_orderkey=min(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority) THEN 'accepted' ELSE 'already_exists' END AS outcome, o_custkey::VARCHAR||':'||o_orderpriority AS job_ref,
 CASE WHEN o_orderkey%8=0 THEN 'paused' WHEN o_orderkey%8 IN (1,2,4) THEN 'running' WHEN o_orderkey%8 IN (3,5) THEN 'queued' WHEN o_orderkey%8=6 THEN 'succeeded' ELSE 'unknown' END AS state FROM orders"""
ENRICH = """WITH h AS (SELECT l_orderkey AS query_id, l_partkey AS hit_id, l_linenumber AS ordinal, CAST(trunc(l_quantity) AS INTEGER) AS score FROM lineitem),
d AS (SELECT query_id, hit_id, arg_min(score, (ordinal, score)) AS score FROM (SELECT * FROM h UNION ALL SELECT query_id, hit_id, ordinal+100, score+1 FROM h) GROUP BY ALL),
t AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, hit_id) AS INTEGER) AS place FROM d)
SELECT query_id, hit_id, place, coalesce(p_name,'hit '||hit_id) AS title, CASE WHEN p_name IS NULL THEN 'degraded' ELSE 'enriched' END AS outcome FROM t LEFT JOIN (SELECT p_partkey, p_name FROM part WHERE p_size<=40) ON p_partkey=hit_id WHERE place<=3"""
WRITES = """SELECT c_custkey, CASE WHEN c_custkey%10=0 THEN 'failed' WHEN NOT c_acctbal>0 THEN 'skipped' WHEN c_mktsegment='BUILDING' THEN 'failed' ELSE 'submitted' END AS write_status, CASE WHEN c_custkey%10=0 THEN 'invalid_target' WHEN NOT c_acctbal>0 THEN 'no_candidates' WHEN c_mktsegment='BUILDING' THEN 'permission_denied' ELSE '-' END AS write_reason,
 CASE WHEN c_acctbal>0 THEN '{"event_id":'||c_custkey||',"event_kind":"scan","subject":"'||c_name||'"}' ELSE '-' END AS payload FROM customer"""

ORACLES = {
    "ranked_candidates": RANKED, "evidence_summary": EVIDENCE, "titles": TITLES, "title_variants": TITLE_VARIANTS, "slugs": SLUGS, "markup": MARKUP, "catalog_numbers": CATALOG_NUMBERS, "urls": URLS, "link_search": LINK_SEARCH, "link_groups": LINK_GROUPS, "grouped_links": GROUPED,
    "query_payloads": QUERY_PAYLOADS, "entity_clusters": CLUSTERS, "cluster_evidence": CLUSTER_EVIDENCE, "fused_records": FUSED, "artwork": ARTWORK, "source_status": SOURCE_STATUS, "source_preferences": SOURCE_PREFERENCES, "failure_streaks": STREAKS,
    "provider_summary": SUMMARY, "last_attempts": LAST, "reuse": REUSE, "batch_page": PAGE, "field_presence": PRESENCE, "templates": TEMPLATES, "dates": DATES, "scores": SCORES, "arrays": ARRAYS, "html_titles": HTML_TITLES, "commands": COMMANDS,
    "subtitle_search": SUBTITLES, "intents": INTENTS, "jobs": JOBS, "search_and_enrich": ENRICH, "write_backs": WRITES, "stream_history": STREAM_HISTORY, "stream_jobs": STREAM_JOBS,
}
