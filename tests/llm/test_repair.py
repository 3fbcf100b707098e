"""Conversation repair against all strings of edits, in one and in many partitions, and edge rows."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from spindrift.llm import queries, repair

SF = "/root/testdata/sf0.001"
ROWS = "conv_id long, turn long, role string, text string, key string, conv string, copies string"
BLANK = re.compile(r"[^\x20\x09-\x0D]")


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        shown = BLANK.findall(text)
        out.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, repaired) over all edits, whole strings kept for every sequence of roles' initials reached."""
    frontier = {(0, "", ())}
    for (role, text), fault in zip(rows, faults(rows), strict=True):
        frontier = inserted(frontier)
        after = set()
        for cost, audit, said in frontier:
            after.add((cost + 2, audit + "D", said))
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                after.add((cost + more, audit + "K", (*said, f"{role}:{text}")))
                after |= {(cost + 1 + more, audit + "R", (*said, f"{r}:{text}")) for r in ("user", "assistant")}
        frontier = pruned(after)
    whole = {x for x in inserted(frontier) if re.fullmatch("(s?(ua)+)?", initials(x[2]))}
    return min(whole)


def initials(said):
    return "".join(x[:1] for x in said)


def inserted(frontier):
    once = lambda f: {(c + 5, a + "I", (*s, f"{r}:")) for c, a, s in f for r in ("user", "assistant")}
    one = pruned(once(frontier))
    return frontier | one | pruned(once(one))


def pruned(found):
    """Only beginnings of legal sequences stay; what went before does not matter to what may follow beyond the last two roles."""
    best = {}
    for x in found:
        i = initials(x[2])
        if re.fullmatch("s?(ua)*u?", i):
            kind = (i[-1:], i == "s", not i)
            best.setdefault(kind, []).append(x)
    return {x for xs in best.values() for x in sorted(xs)[:4]}


def expected(rows):
    rows = [(t, role if role is not None else " ", text if text is not None else " ") for t, role, text in rows]
    rows.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
    turns, said = [t for t, _, _ in rows if t is not None], [x[1:] for x in rows]
    found, firsts = faults(said), [r[:1] for r, _ in said]
    cost, audit, out = cheapest(said)
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(firsts))
    return (gaps, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def damaged(conv, rows):
    for turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        shown = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(shown.encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            yield from [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


def results(frame):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in frame.collect()}


@pytest.fixture(scope="module")
def conversations():
    rng = random.Random(11)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "sys\nü", "ux"]
    texts = ["Yes.", "No?", "", " \n", "half a", "ok!", "Émile.", None, "x" * 300 + ".", "last. \x0b"]
    out = {None: [(1, "user", "a."), (2, "assistant", "b.")], -1: [(None, None, None)] * 3, -2: [(5, "system", "only.")]}
    for i in range(80):
        out[i] = [(rng.choice([k, k, k, None, k * 7]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.8 else f"t{k}.") for k in range(rng.randrange(1, 9))]
    out[900] = [(k, rng.choice(roles[:3]), f"line {rng.randrange(300)}{rng.choice('.?x')}") for k in range(150)]
    out[901] = [(3, "user", "same.")] * 60 + [(4, "assistant", "fine.")]
    out[902] = [(7, "user", f"{k:03d}.") for k in range(60)]
    return out


def frame(spark, found, parts=3):
    return spark.createDataFrame([(c, t, r, x, "k", "c", "1") for c, rows in found.items() for t, r, x in rows], ROWS).repartition(parts)


@pytest.mark.parametrize("parts", [1, 12])
def test_equals_brute_force(spark, conversations, parts):
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = results(repair.repair(repair.damage(frame(spark, conversations))))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == {c: expected(list(damaged(c, rows))) for c, rows in conversations.items()}


def test_undamaged_rows_and_conversations_without_rows(spark):
    rows = frame(spark, {1: [(0, "user", "a."), (1, "assistant", "b.")], 2: [(0, "user", "a."), (1, "user", "b.")], 3: [(0, "user", "cut")]}).drop("copies")
    got = results(repair.repair(rows))
    assert {c: x[5:7] for c, x in got.items()} == {1: (0, "KK"), 2: (3, "DD") if (3, "DD") < (1, "KR") else (1, "KR"), 3: (2, "D")}
    alone = spark.createDataFrame([(7, 0)], "conv_id long, copies long").selectExpr("conv_id", "copies", "0L turn", "'user' role", "'a.' text")
    assert results(repair.repair(alone)) == {7: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert repair.repair(frame(spark, {})).count() == 0


def test_ids_of_other_types(spark):
    rows = frame(spark, {1: [(0, "user", "a."), (1, "assistant", "b.")]}).selectExpr("concat('c', conv_id) conv_id", "cast(turn as int) turn", "role", "text")
    assert [(r.conv_id, r.audit) for r in repair.repair(rows).collect()] == [("c1", "KK")]


def test_layers_are_few():
    kinds = [(i, f) for i in "suax" for f in "-tbd"]
    seen, todo = set(), [repair.start(q) for q in range(4)]
    while todo:
        layer = todo.pop()
        if layer not in seen:
            seen.add(layer)
            todo += [repair.step(layer, *k)[1] for k in kinds]
    assert len(seen) < 2000


def test_a_repeated_row_is_one_pointer():
    total, layer, pointers = repair.forward([("u", "-", 1_000_000), ("a", "-", 1)], repair.start(repair.NOTHING))
    assert len(pointers) < 10 and total + repair.ending(layer)[0] == 2 * 999_999
    audit, state = repair.edits(pointers, repair.ending(layer)[1])
    assert audit == "K" + "D" * 999_999 + "K" and state == repair.NOTHING


def test_query_on_the_smallest_tables(spark):
    rows = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        rows.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    assert results(queries.op11_conversation_repair(spark, SF)) == {c: expected(list(damaged(c, x))) for c, x in rows.items()}
