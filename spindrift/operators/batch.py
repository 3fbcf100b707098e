"""Batch runs: pages, reuse of repeated items, breaker state by source, summaries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scan


def page(items: DataFrame, cursor: int, size: int, most: int = 12) -> DataFrame:
    """Items with an index from the cursor on, 1 to ``most`` of them."""
    return items.where(F.col("item_index").between(cursor, cursor + max(1, min(size, most)) - 1))


def first_occurrence(items: DataFrame, *key: str) -> DataFrame:
    """Adds reused_from: the first index with the same key, NULL on that item itself."""
    first = items.groupBy(*key).agg(F.min("item_index").alias("first_index"))
    joined = items.join(first, list(key))
    return joined.withColumn("reused_from", F.when(F.col("first_index") < F.col("item_index"), F.col("first_index"))).drop("first_index")


def consecutive_failures(executions: DataFrame, source: str = "provider", order: str = "item_index", parts: int | None = None) -> DataFrame:
    """Adds the failures in a row up to each execution; a source's rows are dealt over many tasks."""
    return scan.streaks(executions, source, order, "failed", parts)


def last_attempts(events: DataFrame, source: str, order: str, keep: int = 20) -> DataFrame:
    """The last ``keep`` rows of each source; 0 keeps none."""
    w = Window.partitionBy(source).orderBy(F.col(order).desc())
    return events.withColumn("back", F.row_number().over(w)).where(F.col("back") <= keep)


#: The breaker's default policy.
THRESHOLD, COOLDOWN = 2, 3


class Breaker:
    """A source's state: failures in a row, the scraped item up to which it cools down, last reason and its class.

    Every scraped item of a run ticks a cooldown that was on when the item began,
    whatever became of it; so a cooldown set at item k holds for items k + 1 to
    k + cooldown, and then the failures count anew.
    """

    def __init__(self, failures: int = 0, until: int | None = None, reason: str | None = None, kind: str | None = None):
        self.failures, self.until, self.reason, self.kind = failures, until, reason, kind

    def suppressed(self, item: int) -> bool:
        if self.until is None:
            return False
        if item <= self.until:
            return True
        self.failures, self.until = 0, None
        return False

    def left(self, item: int) -> int:
        """Items still to cool down after this one."""
        return 0 if self.until is None else max(0, self.until - item)

    def count(self, item: int) -> int:
        """Failures in a row after this item."""
        return 0 if self.until is not None and item >= self.until else self.failures

    def succeed(self) -> None:
        self.failures, self.until, self.reason, self.kind = 0, None, None, None

    def fail(self, item: int, reason: str | None, kind: str | None, threshold: int, cooldown: int) -> None:
        self.reason, self.kind = reason or "provider_error", kind or "retryable"
        on = threshold > 0 and cooldown > 0
        if self.kind == "retryable":
            self.failures += 1
            if on and self.failures >= threshold:
                self.until = item + cooldown
        elif self.kind == "operator_action":
            self.failures = 1
            if on:
                self.until = item + cooldown
        elif self.kind == "permanent":
            self.failures, self.until = 0, None

    def step(self, item: int, failed: bool, reason: str | None, kind: str | None, threshold: int, cooldown: int) -> str:
        """One scraped item: suppressed, failed or ok."""
        if self.suppressed(item):
            return "suppressed"
        if not failed:
            self.succeed()
            return "ok"
        self.fail(item, reason, kind, threshold, cooldown)
        return "failed"


def replay(executions: DataFrame, threshold: int = THRESHOLD, cooldown: int = COOLDOWN, parts: int | None = None) -> DataFrame:
    """What the breaker would have done at each execution, by source and in item order.

    executions: provider, item_index (counts the run's scraped items; once a source),
    failed, reason, retry_class.  A breaker has few states: failures below the
    threshold, or a cooldown of so many items with the failures that began it.  So a
    source's rows are a parallel scan (``scan.replayed``), however many they are.
    Without a threshold or cooldown failures only add up: a block then either sets
    their count or adds to it.
    """
    rows = executions.select("provider", "item_index", "failed", "reason", "retry_class")
    said = "outcome string, consecutive_failures int, cooldown_remaining int"
    if threshold <= 0 or cooldown <= 0:
        added = lambda known, s: (0, s[1] + known[1, 0][1]) if known[1, 0][0] else known[1, 0]
        counted = lambda r, state, did: (did, state[1], 0)
        return scan.replayed(rows, "provider", "item_index", lambda item: [(0, 0), (1, 0)], _uncooled, counted, said, lambda state, item: state, parts, added)
    opened = [(f, None) for f in range(threshold)]

    def starts(item: int) -> list[tuple]:
        return opened + [(f, item + left) for left in range(cooldown) for f in {1, threshold}]

    def at(state: tuple, item: int) -> tuple:
        return (0, None) if state[1] is not None and state[1] < item else state

    def step(state: tuple, r) -> tuple:
        own = Breaker(*state)
        did = own.step(int(r.item_index), bool(r.failed), r.reason, r.retry_class, threshold, cooldown)
        return (own.failures, own.until), did

    def told(r, state: tuple, did: str) -> tuple:
        own = Breaker(*state)
        return did, own.count(int(r.item_index)), own.left(int(r.item_index))

    return scan.replayed(rows, "provider", "item_index", starts, step, told, said, at, parts)


def _uncooled(state: tuple, r) -> tuple:
    """A step of a breaker that never opens; state: whether the count is one above an unknown one, and the count."""
    own = Breaker(state[1])
    did = own.step(int(r.item_index), bool(r.failed), r.reason, r.retry_class, 0, 0)
    goes_on = did == "failed" and own.kind not in ("operator_action", "permanent")
    return (state[0] if goes_on else 0, own.failures), did


def reuse(items: DataFrame, cached: DataFrame | None = None, most: int = 128) -> DataFrame:
    """Adds reused_from to items: the cache entry or the first earlier item of the same key.

    items: run, item_index, key (NULL where an item must not be reused); cached:
    run, key, item_index of a resumed run, of which the first ``most`` by key count.
    """
    first = items.where("key is not null").groupBy("run", "key").agg(F.min("item_index").alias("first_index"))
    out = items.join(first, ["run", "key"], "left").withColumn("cached_index", F.lit(None).cast("long"))
    if cached is not None:
        place = F.row_number().over(Window.partitionBy("run").orderBy("key", "item_index"))
        kept = cached.withColumn("place", place).where(F.col("place") <= most).groupBy("run", "key").agg(F.min("item_index").cast("long").alias("cached"))
        out = out.join(kept, ["run", "key"], "left").withColumn("cached_index", F.col("cached")).drop("cached")
    own = F.when(F.col("first_index") < F.col("item_index"), F.col("first_index"))
    return out.withColumn("reused_from", F.coalesce("cached_index", own)).drop("first_index", "cached_index")


STATE = "provider string, consecutive_failures int, cooldown_remaining int, reason string, retry_class string"
REPORT = "run {run}, item_index long, provider string, status string, candidate_count long, reason string, retry_class string, failures int, cooldown_remaining int, state_reason string, state_class string"


def scrape(executions: DataFrame, states: DataFrame | None = None, budget: int | None = None, threshold: int = THRESHOLD, cooldown: int = COOLDOWN) -> DataFrame:
    """What a run does with every source at every scraped item, and each source's state after it.

    executions: run, item_index, ordinal (of the source), provider, serves (its
    route), status (returned, empty or failed, if it is asked), candidate_count,
    reason, retry_class.  states: run and STATE of a resumed run.  Sources that
    cool down are suppressed, others of another route skipped; at most ``budget``
    are asked, in catalog order.  A run is a sequence, so it streams through one
    task in order; the state is one entry for each source of the catalog.
    """
    run_type = executions.schema["run"].dataType.simpleString()
    names = ["run", "item_index", "ordinal", "provider", "serves", "status", "candidate_count", "reason", "retry_class"]
    rows = executions.select(*names, F.lit(None).cast("int").alias("failures"), F.lit(None).cast("int").alias("left"))
    if states is not None:
        resumed = states.select("run", F.lit(-1).alias("item_index"), F.lit(-1).alias("ordinal"), "provider", F.lit(True).alias("serves"), F.lit("state").alias("status"), F.lit(0).alias("candidate_count"), "reason", "retry_class", F.col("consecutive_failures").alias("failures"), F.col("cooldown_remaining").alias("left"))
        rows = rows.unionByName(resumed)
    dealt = rows.repartition("run").sortWithinPartitions("run", "item_index", "ordinal")

    def run(batches):
        own, item, scraped, asked, table = object(), None, -1, 0, {}
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if r.run != own:
                    own, item, scraped, table = r.run, None, -1, {}
                if r.status == "state":
                    left = int(r.left or 0)
                    table[r.provider] = Breaker(int(r.failures or 0), left - 1 if left else None, r.reason, r.retry_class)
                    continue
                if r.item_index != item:
                    item, scraped, asked = r.item_index, scraped + 1, 0
                state = table.setdefault(r.provider, Breaker())
                status, n = r.status, int(r.candidate_count or 0)
                if state.suppressed(scraped):
                    status = "suppressed"
                elif not r.serves:
                    status = "skipped_by_route"
                elif budget is not None and asked >= budget:
                    status = "budget_exhausted"
                else:
                    asked += 1
                    if status == "failed":
                        state.fail(scraped, r.reason, r.retry_class, threshold, cooldown)
                    else:
                        state.succeed()
                failed = status == "failed"
                out.append((r.run, int(r.item_index), r.provider, status, n if status == "returned" else 0, (r.reason or "provider_error") if failed else None, (r.retry_class or "retryable") if failed else None, state.count(scraped), state.left(scraped), state.reason, state.kind))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in REPORT.split(", ")])

    return dealt.mapInPandas(run, REPORT.format(run=run_type))


def provider_summary(reports: DataFrame) -> DataFrame:
    """The twelve counters of each source; reports: from ``scrape``."""
    count = lambda name, test: F.count_if(test).alias(name)
    status, kind = F.col("status"), F.col("retry_class")
    last = F.max(F.struct("run", "item_index", "cooldown_remaining")).alias("last")
    return reports.groupBy("run", "provider").agg(
        count("selected_items", status.isin("returned", "empty", "failed")), count("returned_items", status == "returned"), count("empty_items", status == "empty"), count("failed_items", status == "failed"),
        count("retryable_failed_items", kind == "retryable"), count("permanent_failed_items", kind == "permanent"), count("operator_action_failed_items", kind == "operator_action"),
        count("skipped_by_route_items", status == "skipped_by_route"), count("suppressed_items", status == "suppressed"), count("budget_exhausted_items", status == "budget_exhausted"),
        F.sum("candidate_count").alias("returned_candidate_count"), last,
    ).withColumn("cooldown_remaining_items", F.col("last.cooldown_remaining")).drop("last")


def resume_states(reports: DataFrame) -> DataFrame:
    """(run, STATE) after a run: sources with a failure on record, to begin the next page with."""
    last = F.max_by(F.struct("failures", "cooldown_remaining", "state_reason", "state_class"), "item_index").alias("s")
    kept = reports.groupBy("run", "provider").agg(last).where("s.failures > 0 or s.cooldown_remaining > 0 or s.state_reason is not null")
    return kept.select("run", "provider", F.col("s.failures").alias("consecutive_failures"), F.col("s.cooldown_remaining").alias("cooldown_remaining"), F.col("s.state_reason").alias("reason"), F.col("s.state_class").alias("retry_class"))


def retry_class_counts(reports: DataFrame) -> DataFrame:
    """Failures of each run by reason and retry class."""
    return reports.where("status = 'failed'").groupBy("run", "reason", "retry_class").agg(F.count("*").alias("n"))


def presence(df: DataFrame, *columns: str) -> DataFrame:
    """(field, present, missing) of each column, in one pass."""
    counted = df.agg(F.count("*").alias("n"), *(F.count(c).alias(c) for c in columns))
    pairs = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("present"), (F.col("n") - F.col(c)).alias("missing")) for c in columns))
    return counted.select(F.explode(pairs).alias("x")).select("x.*")


def job_state(status: Column, percent: Column) -> Column:
    """State of an external status code: 0 stopped, 1 and 2 checking, 3 and 5 queued, 4 loading, 6 seeding."""
    seeding = F.when(percent == 100_000, "succeeded").otherwise("running")
    return F.when(status == 0, "paused").when(status.isin(1, 2, 4), "running").when(status.isin(3, 5), "queued").when(status == 6, seeding).otherwise("unknown")


def idempotent(requests: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Adds outcome: accepted for the first request of a key, already_exists for the others, and the job's ref."""
    first = requests.groupBy(*key).agg(F.min(F.struct(*order)).alias("first"))
    joined = requests.join(first, key)
    return joined.withColumns({"outcome": F.when(F.struct(*order) == F.col("first"), "accepted").otherwise("already_exists"), "job_ref": F.concat_ws(":", *key)}).drop("first")
