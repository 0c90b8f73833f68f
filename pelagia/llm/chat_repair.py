"""Conversation structure repair: the cheapest edits that make the turns alternate.

A repaired conversation is empty, or an optional system turn and then user and
assistant turns in pairs. Each turn is kept, given another role, or deleted, and
empty turns may be inserted. The dynamic programme runs over the turns that stay:
the best cost of a state (the role of the last turn that stayed) less the
deletions before it, a prefix sum, has a running minimum for each state, so that
a gap of any length is priced by one subtraction; the pair of roles around the
gap tells what has to be inserted. Of equal costs the smaller audit (the edits'
initials in order) wins; the audits of all states are kept ranked.

Turns stream in order through a task. What all states' best histories share is
written and forgotten, so the task holds only the turns on which they differ: a
few, however long the conversation, unless one role goes on and on, where two
histories may part for the whole run. A conversation is one key in one task, as its
turns depend on each other and its digest runs through all of its text.

Which turns repeat an earlier one is told before, by a grouped minimum over (conversation,
role, digest of the text) that combines before its shuffle: each minimum goes into the
stream as a mark just before the turn that came first.

Cases: nulls count as one space. Turns with equal numbers follow each other by role
and md5 of the text; a null turn comes first. A null conv_id is a conversation of its
own. A conversation without turns has zeros, an empty audit and no repaired turns. An
empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelagia.llm.common import BATCH_ROWS, arrow_schema, bounded, freed

KEEP, REROLE, DELETE, INSERT, STRAY = 0, 2, 3, 2, 1  #: costs; STRAY is that of a truncated turn that stays
ROLES = {"s": "system", "u": "user", "a": "assistant"}
#: From the state before ("" at the start) and the state after: the turns to insert between them.
BETWEEN = {("", "s"): "", ("", "u"): "", ("", "a"): "u", ("s", "u"): "", ("s", "a"): "u", ("u", "a"): "", ("u", "u"): "a", ("a", "u"): "", ("a", "a"): "u"}
#: And those to insert after the last turn that stays.
CLOSING = {"": "", "s": "ua", "u": "a", "a": ""}
LEGAL = {"su", "ua", "au"}
SPACE, STOPS = " \t\n\x0b\x0c\r", ".!?"
#: What a state can do any other can do too for at most this much more (delete a system turn, insert a pair), so that dearer ones go.
SPARE = 7
#: Turns held back, at least, before the shared history is looked for.
HELD = 64

EDITS = "conv_id long, step long, edit string, role string, text string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
ORDERED = ("turn", "role", "digest", "mark")


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, after faults by crc32 of ``conv_id:turn`` mod 20; a dropped row has null role and text."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = (F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20).cast("int")
    role = F.when(fault == 0, None).when(fault == 4, "user").otherwise(blank("role"))
    text = F.when(fault == 0, None).when(fault == 1, "").when(fault == 2, F.translate(blank("text"), STOPS, "")).otherwise(blank("text"))
    times = F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


class Turn:
    """A turn that stays, in one history: what came before, the turns deleted since, how it stays and as what."""

    __slots__ = ("before", "depth", "gap", "inserted", "edit", "state", "line")

    def __init__(self, before: Turn | None, gap: int, inserted: str, edit: str, state: str, line: tuple[str, str] | None):
        self.before, self.gap, self.inserted, self.edit, self.state, self.line = before, gap, inserted, edit, state, line
        self.depth = before.depth + 1 if before else 0


class Repair:
    """The running dynamic programme of one conversation; ``turn`` and ``finish`` give edits that are settled.

    ``minima`` has for each state the cost less all deletions so far, the history, the
    turns seen when it ended, and the rank of its audit, followed by deletions up to
    now, among all states'. No audit begins with another one, as all have used the same
    turns and end in one, so ranks and what is added decide every later comparison.
    """

    def __init__(self):
        self.root = Turn(None, 0, "", "", "", None)
        self.minima: dict[str, tuple[int, Turn, int, int]] = {"": (0, self.root, 0, 0)}
        self.deletions, self.seen, self.held, self.most = 0, 0, 0, HELD

    def turn(self, role: str, text: str, forced: bool, truncated: bool) -> list[tuple[str, str | None, str | None]]:
        own, initial = STRAY * truncated, role[:1]
        # the ways to each state: price, what orders the audit (rank, deletion first, then insertions, K before R), how
        best = {state: (price, (rank, 0), None) for state, (price, _, _, rank) in self.minima.items()}
        for (before, state), inserted in () if forced else BETWEEN.items():
            if before not in self.minima:
                continue
            price, _, _, rank = self.minima[before]
            for edit, cost in (("K", KEEP), ("R", REROLE)):
                if initial == state if edit == "K" else state != "s":
                    way = price + INSERT * len(inserted) + cost + own - DELETE, (rank, 1, -len(inserted), edit), (before, inserted, edit)
                    if state not in best or way[:2] < best[state][:2]:
                        best[state] = way
        least = min(price for price, _, _ in best.values())
        ranks = {key: k for k, key in enumerate(sorted({key for price, key, _ in best.values() if price <= least + SPARE}))}
        fresh = {}
        for state, (price, key, how) in best.items():
            if price > least + SPARE:
                continue
            _, node, at, _ = self.minima[how[0] if how else state]
            if how:
                node, at = Turn(node, self.seen - at, how[1], how[2], state, (role, text)), self.seen + 1
            fresh[state] = price, node, at, ranks[key]
        self.minima = fresh
        self.deletions += DELETE
        self.seen += 1
        self.held += not forced
        return self._settled() if self.held >= self.most else []

    def _settled(self) -> list[tuple[str, str | None, str | None]]:
        """The edits that all states' histories share and that weren't given yet."""
        nodes = [node for _, node, _, _ in self.minima.values()]
        top = max(n.depth for n in nodes)
        while any(n is not nodes[0] for n in nodes):
            deepest = max(n.depth for n in nodes)
            nodes = [n.before if n.depth == deepest else n for n in nodes]
        self.held = top - nodes[0].depth
        self.most = HELD + 2 * self.held  # looking costs as much as what is held
        return self._edits(nodes[0])

    def _edits(self, upto: Turn) -> list[tuple[str, str | None, str | None]]:
        """Edits after the root up to a turn that stays, which becomes the root."""
        chain, node = [], upto
        while node is not self.root:
            chain.append(node)
            node = node.before
        out = []
        for n in reversed(chain):
            out += [("D", None, None)] * n.gap + [("I", ROLES[s], "") for s in n.inserted]
            if n.line is not None:
                out.append((n.edit, n.line[0] if n.edit == "K" else ROLES[n.state], n.line[1]))
        self.root, upto.before = upto, None
        return out

    def finish(self) -> tuple[list[tuple[str, str | None, str | None]], int]:
        """The remaining edits, and the cost of all."""
        price, _, state = min((price + INSERT * len(CLOSING[state]), (rank, -len(CLOSING[state])), state) for state, (price, _, _, rank) in self.minima.items())
        _, node, at, _ = self.minima[state]
        return self._edits(Turn(node, self.seen - at, CLOSING[state], "", state, None)), price + self.deletions


class Faults:
    """Counts a conversation's faults and says what is wrong with a turn, if anything."""

    def __init__(self):
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.before = None

    def judge(self, turn: int | None, role: str, text: str, repeats: bool) -> tuple[bool, bool]:
        """Whether the turn must go, and whether it is truncated."""
        if turn is not None and turn != self.last:
            self.first, self.last, self.turns = turn if self.first is None else self.first, turn, self.turns + 1
        self.illegal += self.before is not None and self.before + role[:1] not in LEGAL
        self.before = role[:1]
        end = text.rstrip(SPACE)
        forced, truncated = not end or repeats, bool(end) and not repeats and end[-1] not in STOPS
        self.blank, self.duplicate, self.truncated = self.blank + (not end), self.duplicate + (bool(end) and repeats), self.truncated + truncated
        return forced, truncated

    def report(self) -> tuple[int, ...]:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal


def repair(rows: DataFrame) -> DataFrame:
    """The edits of every conversation, in order: conv_id, step, edit (K, R, D or I), role, text; the last row has the counts.

    ``rows`` has conv_id, turn, role, text; a null role and text stand for no turn. A kept
    or inserted turn is a row with role and text, a deleted one has neither. The last row of
    a conversation has no edit, but gaps, blank, duplicate, truncated, illegal and cost.
    """
    spark = bounded(rows.sparkSession)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    turns = rows.select("conv_id", "turn", "role", "text", F.unhex(F.md5("text")).alias("digest"))
    there = turns.where("text IS NOT NULL OR role IS NOT NULL")
    first = there.groupBy("conv_id", "role", "digest").agg(F.min(F.struct(F.col("turn").isNotNull(), F.col("turn"))).alias("at"))
    marks = first.select("conv_id", F.col("at.turn").alias("turn"), "role", F.lit(None).cast("string").alias("text"), "digest", F.lit(0).alias("mark"))
    dealt = turns.withColumn("mark", F.lit(1)).unionByName(marks).repartition(n, "conv_id").sortWithinPartitions("conv_id", *ORDERED)
    schema = arrow_schema(EDITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, faults, conv, step, marked = None, None, None, 0, None
        out: list[list] = [[] for _ in schema]

        def put(edits: list[tuple], report: tuple | None = None) -> None:
            nonlocal step
            for edit in [*edits, *([(None, None, None)] if report else [])]:
                counts = report if report and edit[0] is None else (None,) * 6
                for col, v in zip(out, (conv, step, *edit, *counts)):
                    col.append(v)
                step += 1

        def close() -> None:
            edits, cost = plan.finish()
            put(edits, (*faults.report(), cost))

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)
            for col in out:
                col.clear()
            return batch

        for b in batches:
            for c, turn, role, text, digest, mark in zip(*(b.column(k).to_pylist() for k in range(6))):
                if plan is None or c != conv:
                    if plan is not None:
                        close()
                    plan, faults, conv, step, marked = Repair(), Faults(), c, 0, None
                if not mark:
                    marked = turn, role, digest
                elif role is not None or text is not None:
                    role, text = role or "", text or ""
                    repeats, marked = marked != (turn, role, digest), None
                    put(plan.turn(role, text, *faults.judge(turn, role, text, repeats)))
                if len(out[0]) >= BATCH_ROWS:
                    yield flush()
        if plan is not None:
            close()
            yield flush()

    return dealt.mapInArrow(freed(run), EDITS)


def digest(edits: DataFrame) -> DataFrame:
    """A row a conversation of edits as ``repair`` orders them: counts, cost, audit, digest of the repaired turns."""
    ddl = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, sha, any_before = [], hashlib.sha256(), False
        for b in batches:
            out: list[list] = [[] for _ in schema]
            for conv, _, edit, role, text, *counts in zip(*(b.column(k).to_pylist() for k in range(11))):
                if edit is None:
                    for col, v in zip(out, (conv, *counts, "".join(audit), sha.hexdigest())):
                        col.append(v)
                    audit, sha, any_before = [], hashlib.sha256(), False
                    continue
                audit.append(edit)
                if edit != "D":
                    sha.update(("\n" * any_before + f"{role}:{text}").encode("utf-8", "surrogatepass"))
                    any_before = True
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    return edits.mapInArrow(freed(run), ddl)
