"""Chat formatting of reply trees, in DataFrame operations only.

A tree's messages point to the messages they answer.  Iterative self-joins
enumerate the root-to-leaf paths.  First ancestor pointers double: round k gives
every message its ancestor 2^k places up, one row of fixed size a message.  Then,
from the leaves alone and from the longest jump to the shortest, each entry of a
path adds the one that many places above it, so a path of n messages is whole
after log2(n) joins and nothing is made that is not on a path.  Branches are
ranked by their mean score, and each chosen path is formatted as one conversation
with the places that the loss covers.

Defined results: null texts and roles are empty; a message whose parent is
missing starts a path; messages on a cycle, and answers to them, have no root and
belong to no path; of repeated messages of one id the smallest row counts;
messages without an id are left out; an empty table gives no conversation; the
table's other columns play no part.  Ties of the branch score go to the smaller
leaf id.  A conversation is one text in the result, so its turns meet in one task
at the end; until then the turns of a very long one are dealt like any others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import store

# The template's control strings by role, before and after a text.
MARKS = {"user": ("[INST]", "[/INST]"), "assistant": ("[OUT]", "</s>"), "system": ("[SYS]", "[/SYS]")}
BEGIN, ROLE, MESSAGE = "<s>", ("[ROLE]", "[/ROLE]"), ("[MSG]", "[/MSG]")
_BODY = r"(/?(?:INST|OUT|SYS|ROLE|MSG)\]|/?s>)"
_TURN = r"(?=\[(?:INST|OUT|SYS|ROLE)\])"


def escape(text: Column) -> Column:
    """One more backslash inside whatever looks like a control string."""
    return F.regexp_replace(text, rf"([\[<])(\\*){_BODY}", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([\[<])\\(\\*){_BODY}", "$1$2$3")


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def paths(nodes: DataFrame) -> DataFrame:
    """(tree, leaf, node, position) of every root-to-leaf path, position from 0; nodes: (tree, node, parent)."""
    nodes = nodes.select("tree", "node", "parent")
    known = nodes.select(F.col("tree").alias("t"), F.col("node").alias("n"))
    linked = nodes.join(known, _same("tree", "t") & (F.col("parent") == F.col("n")), "left")
    # up: the ancestor 2^k places above; depth: how far the root is, once it is known.
    jumps = [store(linked.select("tree", "node", F.col("n").alias("up"), F.when(F.col("n").isNull(), F.lit(0).cast("long")).alias("depth")), "jumps")]
    longest = nodes.groupBy("tree").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first().n or 0
    while True:
        last, step = jumps[-1], 1 << (len(jumps) - 1)
        # What has no root within as many steps as its tree has messages hangs on a cycle.
        if step > longest or not last.where("up is not null").limit(1).count():
            break
        above = last.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("further"), F.col("depth").alias("more"))
        open_ = last.where("up is not null")
        further = open_.join(above, _same("tree", "t") & (F.col("up") == F.col("n")), "left")
        grown = further.select("tree", "node", F.col("further").alias("up"), F.coalesce("depth", F.col("more") + step).alias("depth"))
        # Only rows with something above them are joined; the others are done.
        jumps.append(store(last.where("up is null").unionByName(grown), "jumps"))
    answered = nodes.where("parent is not null").select(F.col("tree").alias("t"), F.col("parent").alias("p")).distinct()
    leaves = jumps[-1].where("depth is not null").join(answered, _same("tree", "t") & (F.col("node") == F.col("p")), "left_anti")
    entries = store(leaves.select("tree", F.col("node").alias("leaf"), "node", F.col("depth").alias("position")), "paths")
    for k in range(len(jumps) - 2, -1, -1):
        step = 1 << k
        above = jumps[k].where("up is not null").select(F.col("tree").alias("t"), F.col("node").alias("n"), "up")
        added = entries.where(F.col("position") >= step).join(above, _same("tree", "t") & (F.col("node") == F.col("n")))
        entries = store(entries.unionByName(added.select("tree", "leaf", F.col("up").alias("node"), (F.col("position") - step).alias("position"))), "paths")
    return entries


def _piece() -> tuple[Column, Column, Column]:
    """A turn's formatted text, and where in it the escaped message starts and how long it is."""
    body = escape(F.col("text"))
    role = F.concat(F.lit(ROLE[0]), escape(F.col("role")), F.lit(ROLE[1] + MESSAGE[0]))
    before, after = role, F.lit(MESSAGE[1])
    for name, (head, tail) in MARKS.items():
        before = F.when(F.col("role") == name, F.lit(head)).otherwise(before)
        after = F.when(F.col("role") == name, F.lit(tail)).otherwise(after)
    return F.concat(before, body, after), F.length(before), F.length(body)


def conversations(nodes: DataFrame, branches: int | None = None) -> DataFrame:
    """Formatted conversations of the ``branches`` best paths of each tree (None: all).

    nodes: tree, node, parent, role, text, score.  Result: tree, leaf, rank,
    n_turns, branch_score, formatted, loss_spans (start from 1 and length in
    code points, by order).
    """
    columns = ["parent", "role", "text", "score"]
    nodes = nodes.where("node is not null").groupBy("tree", "node").agg(F.min(F.struct(*columns)).alias("row")).select("tree", "node", *(F.col(f"row.{c}").alias(c) for c in columns))
    nodes = store(nodes.withColumns({"role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit(""))}), "messages")
    turns = paths(nodes).select(F.col("tree").alias("t"), "leaf", "position", F.col("node").alias("n"))
    turns = turns.join(nodes, F.col("t").eqNullSafe(F.col("tree")) & (F.col("n") == F.col("node")))
    piece, start, size = _piece()
    turns = turns.select("tree", "leaf", "position", (F.col("role") == "assistant").alias("loss"), F.coalesce("score", F.lit(0.0)).alias("score"), piece.alias("piece"), start.alias("start"), size.alias("size"))
    before = Window.partitionBy("tree", "leaf").orderBy("position")
    turns = turns.withColumn("start", F.sum(F.length("piece").cast("long")).over(before) - F.length("piece") + F.col("start") + F.lit(len(BEGIN) + 1))
    whole = turns.groupBy("tree", "leaf").agg(
        F.count("*").alias("n_turns"),
        F.avg("score").alias("branch_score"),
        F.array_sort(F.collect_list(F.struct("position", "piece"))).alias("pieces"),
        F.array_sort(F.collect_list(F.when(F.col("loss"), F.struct("position", "start", "size")))).alias("spans"),
    )
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.col("branch_score").desc(), "leaf"))
    whole = whole.withColumn("rank", rank)
    if branches is not None:
        whole = whole.where(F.col("rank") <= branches)
    formatted = F.concat(F.lit(BEGIN), F.array_join(F.col("pieces.piece"), ""))
    spans = F.transform("spans", lambda s: F.struct(s["start"].cast("long").alias("start"), s["size"].cast("long").alias("size")))
    return whole.select("tree", "leaf", "rank", "n_turns", "branch_score", formatted.alias("formatted"), spans.alias("loss_spans"))


def chain(rows: DataFrame) -> DataFrame:
    """Messages of linear conversations (conv_id, turn, role, text) as a reply tree's nodes.

    Rows follow each other by turn; rows of one turn by role and text.  Every
    row is a turn, repeated ones too.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    node = F.row_number().over(order).cast("long")
    nodes = rows.select(F.col("conv_id").alias("tree"), "role", "text", node.alias("node"))
    return nodes.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def read_turns(formatted: Column) -> Column:
    """Roles and texts of a formatted conversation, in order."""
    parts = F.slice(F.split(formatted, _TURN), 2, 1 << 30)

    def turn(part: Column) -> Column:
        close = F.instr(part, ROLE[1])
        role = unescape(F.substring(part, F.lit(len(ROLE[0]) + 1), close - F.lit(len(ROLE[0]) + 1)))
        head = close + F.lit(len(ROLE[1]) + len(MESSAGE[0]) - 1)
        tail = F.lit(len(MESSAGE[1]))
        for name, (before, after) in MARKS.items():
            own = F.startswith(part, F.lit(before))
            role = F.when(own, F.lit(name)).otherwise(role)
            head = F.when(own, F.lit(len(before))).otherwise(head)
            tail = F.when(own, F.lit(len(after))).otherwise(tail)
        return F.struct(role.alias("role"), unescape(F.substring(part, head + 1, F.length(part) - head - tail)).alias("text"))

    return F.transform(parts, turn)


def masked(formatted: Column, spans: Column) -> Column:
    """The pieces of a formatted conversation that its spans cover, in order.

    Assistants' texts stand between their marks, which no text can hold, so one
    pass finds them all; a span of another length is cut out by its place.
    """
    head, tail = MARKS["assistant"]
    found = F.regexp_extract_all(formatted, F.lit(rf"(?s)\Q{head}\E(.*?)\Q{tail}\E"), F.lit(1))
    cut = lambda s: F.substring(formatted, s["start"].cast("int"), s["size"].cast("int"))
    return F.when(F.size(found) == F.size(spans), F.zip_with(found, spans, lambda x, s: F.when(F.length(x) == s["size"], x).otherwise(cut(s)))).otherwise(F.transform(spans, cut))


def digests(formatted: DataFrame) -> DataFrame:
    """What is read back from formatted conversations: the digest columns of the query."""
    turns = read_turns(F.col("formatted"))
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(masked(F.col("formatted"), F.col("loss_spans")), unescape), "")
    read = formatted.select(F.col("tree").alias("conv_id"), F.size(turns).cast("long").alias("n_turns"), said.alias("said"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return read.select("conv_id", "n_turns", F.sha2(F.col("said").cast("binary"), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")
