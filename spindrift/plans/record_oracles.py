"""DuckDB SQL for the queries over sources, written from what the sources must give, without the library's code."""

IMG = "'https://image.tmdb.org/t/p/original/'"
# In DuckDB list_distinct keeps no order; this does.
DISTINCT = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"
PART = "p AS (SELECT *, p_partkey AS k, p_size AS z, printf('%04d-%02d-%02d', p_size+1950, p_size%12+1, p_size%28+1) AS d, p_partkey%4 IN (2,3) AS enr FROM part)"
NONE = {
    "original_title": "CAST(NULL AS VARCHAR)", "overview": "CAST(NULL AS VARCHAR)", "release_date": "CAST(NULL AS VARCHAR)", "release_year": "CAST(NULL AS INTEGER)", "runtime_minutes": "CAST(NULL AS INTEGER)",
    "tagline": "CAST(NULL AS VARCHAR)", "genres": "CAST(NULL AS VARCHAR)", "tags": "''", "alternate_titles": "''", "language": "CAST(NULL AS VARCHAR)", "score_milli": "CAST(NULL AS INTEGER)", "votes": "CAST(NULL AS BIGINT)",
    "external_ids": "''", "artwork": "''",
}


def _select(provider: str, source: str, **fields: str) -> str:
    all_fields = {"query_id": "k", "provider": f"'{provider}'"} | NONE | fields
    return "SELECT " + ", ".join(f"{v} AS {k}" for k, v in all_fields.items()) + f" FROM {source}"


def _screen(kind: str, runtime: str, tags: str, ids: str) -> str:
    known = "list_filter(list_concat([original, CASE WHEN z%7<>0 THEN p_name END, CASE WHEN enr THEN original END, p_brand], CASE WHEN enr THEN [p_brand, 'Alt '||p_name, 'Alt '||p_name] ELSE [] END), lambda x: x IS NOT NULL AND x <> title)"
    ordered = DISTINCT.format("known")
    body = _select(
        "tmdb", "u", provider_id=f"'tmdb:{kind}:'||k", title="title", sort_title="title", original_title="CASE WHEN original<>title THEN original END", overview="CASE WHEN z%5<>0 THEN p_type END",
        release_date="CASE WHEN z%6<>0 THEN d END", release_year="CASE WHEN z%6<>0 THEN z+1950 END", runtime_minutes=runtime, tagline="CASE WHEN enr THEN p_brand END",
        genres="CASE WHEN enr AND z%3=1 THEN p_type ELSE 'Drama|'||CASE z WHEN 12 THEN 'Adventure|' WHEN 16 THEN 'Animation|' WHEN 18 THEN 'Drama|' WHEN 28 THEN 'Action|' WHEN 35 THEN 'Comedy|' ELSE '' END||'Comedy' END",
        tags=f"{tags}||'|tmdb_vote_average:'||printf('%.1f',(z%97)/10.0)||'|tmdb_vote_count:'||(k*3)", alternate_titles=f"array_to_string({ordered},'|')", language="CASE WHEN enr AND z%4=0 THEN 'ja' ELSE 'en-US' END",
        score_milli="CAST((z%97)*10 AS INTEGER)", votes="k*3", external_ids=ids, artwork=f"CASE WHEN enr THEN 'backdrop='||{IMG}||'b.jpg' WHEN z%3<>0 THEN 'poster='||{IMG}||'p'||k||'.jpg' ELSE '' END",
        outcome=f"'{kind}_'||CASE WHEN NOT enr THEN 'degraded' WHEN z%5=1 THEN 'partially_enriched' ELSE 'enriched' END",
    )
    return f"""WITH {PART}, o AS (SELECT *, CASE WHEN enr AND z%2=0 THEN 'Original' ELSE p_brand END AS original FROM p),
t AS (SELECT *, coalesce(CASE WHEN z%7<>0 THEN p_name END, original) AS title FROM o), u AS (SELECT *, {known} AS known FROM t) {body}"""


MOVIE = _screen("movie", "CASE WHEN enr THEN z+60 END", "'tmdb'||CASE WHEN enr THEN '' ELSE '|tmdb_degraded' END", "'tmdb='||k||CASE WHEN enr AND z%5<>1 THEN '|imdb=tt'||k ELSE '' END")
_TV = "'tmdb|tmdb_tv'||CASE WHEN enr THEN '|tmdb_origin_country:JP|tmdb_network:'||p_brand||CASE WHEN z%3>0 THEN '|tmdb_number_of_seasons:'||(z%3) ELSE '' END||'|tmdb_status:Ended' ELSE '|tmdb_degraded' END"
SHOW = _screen("tv", "CASE WHEN enr THEN z END", _TV, "'tmdb_tv='||k||CASE WHEN enr AND z%5<>1 THEN '|imdb=tt'||k||'|tvdb='||z ELSE '' END")

_KNOWN = "list_filter(list_concat([p_name, local, p_name, local], CASE WHEN has THEN ['Alias', p_brand, p_type] ELSE [] END), lambda x: x IS NOT NULL AND x <> title)"
SUBJECT = f"""WITH {PART}, s AS (SELECT *, k%3<>0 AS has, CASE WHEN z%5<>0 THEN p_type END AS local FROM p),
t AS (SELECT *, CASE WHEN z%4=2 AND local IS NOT NULL THEN local WHEN z%4=1 THEN p_name WHEN z%2=0 THEN coalesce(local, p_name) ELSE p_name END AS title,
 CASE WHEN z%7<>0 THEN z+2+CASE WHEN z%3=0 THEN 5 ELSE 0 END END AS total FROM s), u AS (SELECT *, {_KNOWN} AS known FROM t)
""" + _select(
    "bangumi", "u", provider_id="'bangumi:subject:'||k", title="title", sort_title="title", original_title="CASE WHEN p_name<>title THEN p_name END", overview="CASE WHEN has THEN p_brand END", release_date="d",
    release_year="z+1950", genres="'TV|high|same|also|low'",
    tags="'bangumi'||CASE WHEN has THEN '' ELSE '|bangumi_degraded' END||CASE WHEN has AND z%9=0 THEN '|bangumi_nsfw' ELSE '' END||'|bangumi_subject_type:2|bangumi_eps:'||z||CASE WHEN has THEN '|bangumi_platform:Web|bangumi_rank:'||z||'|bangumi_rating_total:'||(k*2)||'|bangumi_score:'||printf('%.1f',(z%97)/10.0) ELSE '' END||coalesce('|bangumi_collection_total:'||total,'')||CASE WHEN has THEN '|bangumi_production:Studio '||z||'|bangumi_production:Inner' ELSE '' END",
    alternate_titles=f"array_to_string({DISTINCT.format('known')},'|')", language="CASE WHEN local=title THEN 'zh-CN' END", score_milli="CASE WHEN has THEN CAST((z%97)*10 AS INTEGER) END", votes="CASE WHEN has THEN k*2 END",
    external_ids="'bangumi='||k", outcome="CASE WHEN has THEN 'subject_enriched' ELSE 'subject_degraded' END",
)

_LABELS = "list_filter(range(14), lambda i: i%4<>3 AND z+i*5>=50)[1:8]"
MEDIA = f"""WITH {PART}, m AS (SELECT *, CASE WHEN z%3=0 THEN p_brand END AS up, CASE WHEN z%5<>0 THEN p_name END AS en FROM p WHERE k%5<>0),
t AS (SELECT *, CASE WHEN z%4=1 THEN p_type ELSE coalesce(en, up, p_type) END AS title, [up, en, p_type, '原題'] AS names FROM m),
u AS (SELECT *, list_filter(names, lambda x: x IS NOT NULL AND x<>p_type) AS known FROM t) """ + _select(
    "anilist", "u", provider_id="'anilist:media:'||k", title="title", sort_title="title", original_title="CASE WHEN p_type<>title THEN p_type END", overview="'Bold and more'",
    release_date="CASE WHEN z%13>0 THEN printf('%04d-%02d-07', z+1950, z%13) END", release_year="z+1950", runtime_minutes="z", tagline="'TV'", genres="'Drama'",
    tags=f"'anilist|format:TV'||CASE WHEN len({_LABELS})>0 THEN '|'||array_to_string(list_transform({_LABELS}, lambda i: 'tag'||i),'|') ELSE '' END",
    alternate_titles=f"array_to_string({DISTINCT.format('known')},'|')", language="'en-US'", score_milli="CAST(CASE WHEN z%2=1 THEN z*20 ELSE 610 END AS INTEGER)",
    external_ids="'anilist='||k||CASE WHEN z%2=0 THEN '|mal='||(k+7) ELSE '' END||'|anilist_url=https://a.example/'||k", artwork="'backdrop=https://i.example/b.jpg'", outcome="'media_mapped'",
)

SCENE = f"""WITH {PART}, s AS (SELECT *, CASE WHEN z%3<>0 THEN 'scene-'||k ELSE 'u'||k END AS slug, CASE WHEN z%4=0 THEN 'ABC-'||lpad(CAST(z AS VARCHAR),3,'0') END AS number,
 CASE WHEN z%2=1 THEN 'https://i.example/p.jpg' ELSE 'https://i.example/i.jpg' END AS poster FROM p WHERE z%10<>3) """ + _select(
    "theporndb", "s", provider_id="'theporndb:scene:'||slug", title="p_name", sort_title="coalesce(number, p_name)", release_date="d", release_year="z+1950",
    runtime_minutes="CASE WHEN z%2=0 THEN CAST((k+59)//60 AS INTEGER) END", tagline="'Site'", genres="p_brand", tags="'performer:'||p_brand", alternate_titles="coalesce(number,'')",
    score_milli="CAST(round(z/10.0*CASE WHEN z/10.0<=5 THEN 200 ELSE 100 END) AS INTEGER)", external_ids="'theporndb='||slug||'|theporndb_source_url=https://s.example/scenes/u'||k||'/more?x=1|hash_oshash=ab-12_f'",
    artwork="'poster='||poster||CASE WHEN z%2=0 THEN '|backdrop=https://i.example/p.jpg' ELSE '' END||'|backdrop=https://i.example/f.jpg'||CASE WHEN z%5=0 THEN '|trailer=https://i.example/t.mp4' ELSE '' END", outcome="'scene_parsed'",
)

PRODUCT = f"""WITH {PART}, q AS (SELECT *, 'XYZ-'||lpad(CAST(z AS VARCHAR),3,'0') AS number FROM p WHERE z%8<>0) """ + _select(
    "prestige", "q", provider_id="'prestige:product:'||k", title="p_name", sort_title="number", overview="CASE WHEN z%2=0 THEN p_type END", release_date="d", release_year="z+1950",
    runtime_minutes="CASE z%3 WHEN 0 THEN NULL WHEN 1 THEN 90 ELSE 120 END", genres="'g'", tags="'maker:M|actor:'||p_brand", language="'ja'", external_ids="'av_number='||number",
    artwork="CASE WHEN z%2=0 THEN 'poster=https://media.example.test/p.jpg|backdrop=https://media.example.test/m1.jpg|backdrop=https://media.example.test/t.jpg' ELSE 'poster=https://media.example.test/t.jpg|backdrop=https://media.example.test/m1.jpg' END",
    outcome="'product_parsed'", uuid="CASE WHEN z%9<>0 THEN 'uuid-1' ELSE 'uuid-2' END",
)

FIXTURE = f"WITH {PART}, q AS (SELECT *, CASE WHEN z%3<>0 THEN z+1950 END AS y FROM p) " + _select(
    "fixture", "q", provider_id="'fixture:'||replace(lower(p_name),' ','-')", title="p_name||coalesce(' ('||y||')','')", original_title="p_name", sort_title="p_name", overview="'Fixture metadata suggestion.'",
    release_date="y||'-01-01'", release_year="y", genres="'Unknown'", tags="'fixture'", language="'en-US'", outcome="'fixture_static'",
)

TOTALS = f"""WITH u AS (SELECT 0 AS source_ordinal, * FROM ({MOVIE}) UNION ALL SELECT 1, * FROM ({SUBJECT}) UNION ALL SELECT 2, * FROM ({FIXTURE.replace("CASE WHEN z%3<>0 THEN z+1950 END AS y", "z+1950 AS y")}))
SELECT source_ordinal, provider, count(*) AS n, min(provider_id) AS first_id, max(title) AS last_title, CAST(sum(release_year) AS BIGINT) AS years FROM u GROUP BY ALL"""

ORACLES = {
    "movie_candidates": MOVIE, "show_candidates": SHOW, "subject_candidates": SUBJECT, "media_candidates": MEDIA, "scene_candidates": SCENE, "product_candidates": PRODUCT, "fixture_candidates": FIXTURE, "source_totals": TOTALS,
}
