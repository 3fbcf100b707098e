"""DuckDB SQL for the queries that SQL can express.

The others train a model (op2, op3, op10), tokenise (op5), write a media format
(op8), use keyed permutations (op9) or compare sets and strings beyond what a
SQL join can do over whole tables (op4, op6, op7); tests hold them against
brute force, round trips or held-out accuracy.
"""

_ODD = "</s>[INST] ok [/INST]"
_ESCAPED = r"regexp_replace({},'([\[<])(\\*)(/?(?:INST|OUT|SYS|ROLE|MSG)\]|/?s>)','\1\\\2\3','g')"

#: Marks around a user's text have 13 characters, an assistant's 9, a system's 11, others 24 and the role.
OP1 = f"""WITH c AS (
  SELECT conv_id, turn, coalesce(role,'') AS role, coalesce(text,'') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1,0,'user','{_ODD}'), (-1,1,'assistant','{_ODD}'))),
f AS (SELECT *, length({_ESCAPED.format("text")}) + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 9 WHEN 'system' THEN 11 ELSE 24 + length({_ESCAPED.format("role")}) END AS chars FROM c),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role||chr(10)||text||chr(10), '' ORDER BY turn, role, text) AS said,
  coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role='assistant'), '') AS loss, CAST(3+sum(chars) AS BIGINT) AS formatted_chars FROM f GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g"""

#: A layer of the search for each row, with whole strings: cost, edits and repaired text of the four states.
_BYTES = "list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR),' ')||':'||coalesce(CAST(turn AS VARCHAR),' '), ''), lambda x: [CAST(unicode(x) AS BIGINT),0,0,0,0,0,0,0])"
_CRC = f"xor(list_reduce(list_prepend(4294967295, flatten({_BYTES})), lambda c, x: xor(xor(c,x)>>1, 3988292384*(xor(c,x)&1))), 4294967295)"


def _edited(state: str, cost: str, code: str, said: str = "''") -> str:
    return f"{{'c':{state}.c+{cost},'a':{state}.a||'{code}','t':{state}.t||{said}}}"


def _kept(state: str, role: str) -> str:
    """A row that must read as ``role``: kept if its initial agrees, else re-roled; far where it has to go."""
    own, other = f"chr(10)||role||':'||text", f"chr(10)||'{role}:'||text"
    return f"CASE WHEN fault IN ('b','d') THEN {_edited(state, '1000000', '')} WHEN left(role,1)='{role[0]}' THEN {_edited(state, 'extra', 'K', own)} ELSE {_edited(state, '1+extra', 'R', other)} END"


_FIRST = "list_sort([{}])[1]"
_USER, _ASSISTANT = "chr(10)||'user:'", "chr(10)||'assistant:'"
_RUN_U = _FIRST.format(", ".join(["u", *(_edited(q, "5", "I", _USER) for q in "esa")]))
_RUN_A = _FIRST.format(f"a, {_edited('iu', '5', 'I', _ASSISTANT)}")
OP11 = f"""WITH RECURSIVE k AS (
  SELECT conv_id, turn, {_CRC} % 20 AS k, coalesce(role,' ') AS role, coalesce(text,' ') AS text FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN k=4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text,'.!?','') ELSE text END AS text
  FROM k, LATERAL (SELECT unnest(range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END))) AS n(n)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
f AS (SELECT *, regexp_replace(text,'[ \t\n\x0B\x0C\r]+$','') AS said, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth, lag(left(role,1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
r AS (SELECT *, CASE WHEN said='' THEN 'b' WHEN nth>1 THEN 'd' WHEN right(said,1) NOT IN ('.','!','?') THEN 't' ELSE '-' END AS fault FROM f),
g AS (SELECT conv_id, CAST(coalesce(max(turn)-min(turn)+1-count(DISTINCT turn),0) AS BIGINT) AS gaps, count(*) FILTER (fault='b') AS blank, count(*) FILTER (fault='d') AS duplicate, count(*) FILTER (fault='t') AS truncated,
  count(*) FILTER (before IS NOT NULL AND before||left(role,1) NOT IN ('su','ua','au')) AS illegal, count(*) AS n FROM r GROUP BY conv_id),
w AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, {{'c':CAST(0 AS BIGINT),'a':'','t':''}} AS e, {{'c':CAST(1000000 AS BIGINT),'a':'','t':''}} AS s, {{'c':CAST(1000000 AS BIGINT),'a':'','t':''}} AS u, {{'c':CAST(1000000 AS BIGINT),'a':'','t':''}} AS a FROM g
  UNION ALL
  SELECT conv_id, i, {_edited('e', '2', 'D')}, {_FIRST.format(f"{_edited('s', '2', 'D')}, CASE WHEN left(role,1)='s' AND fault NOT IN ('b','d') THEN {_edited('e', 'extra', 'K', "chr(10)||role||':'||text")} ELSE {_edited('s', '1000000', '')} END")},
    {_FIRST.format(", ".join([_edited('iu', '2', 'D'), *(_kept(q, 'user') for q in ('e', 's', 'ia'))]))}, {_FIRST.format(f"{_edited('ia', '2', 'D')}, {_kept('iu', 'assistant')}")}
  FROM (SELECT *, {_RUN_A} AS ia FROM (SELECT w.conv_id, r.i, r.role, r.text, r.fault, CASE WHEN fault='t' THEN 5 ELSE 0 END AS extra, e, s, u, a, {_RUN_U} AS iu FROM w JOIN r ON w.conv_id IS NOT DISTINCT FROM r.conv_id AND r.i=w.i+1))),
z AS (SELECT w.conv_id, {_FIRST.format(f"e, a, {_edited('u', '5', 'I', _ASSISTANT)}, {_edited('s', '10', 'II', f'{_USER}||{_ASSISTANT}')}")} AS x FROM w JOIN g ON w.conv_id IS NOT DISTINCT FROM g.conv_id AND w.i=g.n)
SELECT c.conv_id, coalesce(gaps,0) AS gaps, coalesce(blank,0) AS blank, coalesce(duplicate,0) AS duplicate, coalesce(truncated,0) AS truncated, coalesce(illegal,0) AS illegal, CAST(coalesce(z.x.c,0) AS BIGINT) AS cost, coalesce(z.x.a,'') AS audit,
  sha256(coalesce(substr(z.x.t,2),'')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN g ON c.conv_id IS NOT DISTINCT FROM g.conv_id LEFT JOIN z ON c.conv_id IS NOT DISTINCT FROM z.conv_id"""

#: All runs of one to three words within pieces, counted.
OP13 = """WITH p AS (SELECT coalesce(lang,'und') AS lang, unnest(string_split_regex(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece,'[\\x20\\x09]+'), lambda x: x<>'') AS w FROM p),
s AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
c AS (SELECT lang, k, phrase, count(*) AS a FROM (SELECT lang, k, unnest(list_transform(range(1, len(w)-k+2), lambda i: array_to_string(w[i:i+k-1],' '))) AS phrase FROM w, (VALUES (1),(2),(3)) AS v(k) WHERE len(w)>=k) GROUP BY ALL HAVING count(*)>=10),
q AS (SELECT *, string_split(phrase,' ') AS v FROM c WHERE k>1),
u AS (SELECT lang, phrase, k, a, cut, array_to_string(v[1:cut],' ') AS head, array_to_string(v[cut+1:],' ') AS rest FROM q, (VALUES (1),(2)) AS x(cut) WHERE cut<k),
f AS (SELECT u.*, h.a AS l, t.a AS r, CAST((CAST(1000000 AS HUGEINT)*u.a*u.a)//(CAST(h.a AS HUGEINT)*t.a) AS BIGINT) AS score FROM u JOIN c h ON h.lang=u.lang AND h.phrase=u.head JOIN c t ON t.lang=u.lang AND t.phrase=u.rest),
b AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut)=1),
m AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, array_to_string(v[1:2],' ') AS phrase, a FROM q WHERE k=3 UNION ALL SELECT lang, array_to_string(v[2:3],' '), a FROM q WHERE k=3) GROUP BY lang, phrase)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, n, score
FROM b JOIN s ON s.lang=b.lang LEFT JOIN m ON m.lang=b.lang AND m.phrase=b.phrase WHERE longer IS NULL OR 100*longer<50*a QUALIFY rank<=2000"""

ORACLES: dict[str, str] = {"op1_chat_formatting": OP1, "op11_conversation_repair": OP11, "op13_collocations": OP13}
