"""Structure repair of conversations by a Viterbi search whose survivors coalesce.

The rows of a conversation are edited, at least cost, until the initials of their roles read
``(s?(ua)+)?``: an optional system turn, then user and assistant in turn, or nothing at all.

Edits and costs: Keep 0; Rerole to user or assistant 2; Delete 3, the only edit open to blank
and duplicate rows; Insert a user or assistant row without text, anywhere, 2. A truncated row
that is not deleted costs 1 more. Among the cheapest edits the ASCII-least string of initials
wins (D < I < K < R).

The search reads the rows of a conversation once, in order. Four states (nothing yet, after the
system turn, after a user, after an assistant) each have one survivor at most: the cheapest way
to have consumed the rows so far. Survivors are tips of one tree of back pointers; a node counts
what refers to it and is freed when nothing does. As soon as all survivors share an ancestor the
edits up to it are final: they are emitted and the tree is cut there. What waits is the
unresolved suffix only. Ties compare whole unresolved suffixes: every survivor has consumed the
same rows and ends with the edit of the last one, so none is a prefix of another, and the order
of two extended survivors is the order they had before, or that of their last edits. Keeping the
survivors' order thus compares the complete suffixes without reading them again. Survivors that
another one beats whatever follows are dropped, which is what lets the rest coalesce.

Rows are partitioned by conversation and sorted; a partition is one stream through
``mapInArrow``, so a conversation is never collected, however long. One conversation is one
task's work, as its digest is a running hash over all of its text. Rows of undecided edits wait
in memory; only rows that fit neither place (unknown roles, say) one after the other keep edits
undecided, until a row that fits one or the end.

Defined cases. Null roles and texts are one space. Rows go by turn, nulls first, then by role
and text, so equal rows are neighbours; a repeated row is a duplicate. A row's fault is the
first of blank (no character but white space), duplicate (role and text seen earlier in the
conversation) and truncated (the last character but white space is none of ``.!?``). A role's
initial is its first character; a role without one can be deleted or reroled, not kept. Rows with a null conversation
id are one conversation. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
BATCH_ROWS, BATCH_BYTES = 4_096, 8 << 20

# States: nothing yet, after the system turn, after a user turn, after an assistant turn.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
WANTED = ("u", "u", "a", "u")
FOLLOWING = (USER, USER, ASSISTANT, USER)
ROLE_NAME = {"u": "user", "a": "assistant"}
# More inserts in a row than this come back to a state that was reached for less.
MAX_INSERTS = (2, 2, 1, 1)
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)

EDITS = pa.schema([
    ("conv_id", pa.int64()), ("edit", pa.string()), ("cost", pa.int64()), ("turn", pa.int64()),
    ("fault", pa.int32()), ("old_role", pa.string()), ("role", pa.string()), ("text", pa.string()),
])
EDITS_DDL = "conv_id BIGINT, edit STRING, cost BIGINT, turn BIGINT, fault INT, old_role STRING, role STRING, text STRING"
DIGESTS = pa.schema([
    ("conv_id", pa.int64()), ("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()),
    ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()),
    ("repaired_sha256", pa.string()),
])
DIGEST_DDL = (
    "conv_id BIGINT, gaps BIGINT, blank BIGINT, duplicate BIGINT, truncated BIGINT, illegal BIGINT, cost BIGINT, "
    "audit STRING, repaired_sha256 STRING"
)


class Node:
    """Edits of one row (inserts before it, then its own) behind those of ``parent``."""

    __slots__ = ("parent", "edits", "row", "kids", "tip")

    def __init__(self, parent: Node | None, edits: str, row: object):
        self.parent, self.edits, self.row = parent, edits, row
        self.kids: list[Node] = []
        self.tip = False
        if parent is not None:
            parent.kids.append(self)


class Search:
    """The survivors of one conversation; ``step`` and ``finish`` return the (edits, row) that became final."""

    def __init__(self):
        self.root = Node(None, "", None)
        # Per state (cost, place in string order, node).
        self.alive: dict[int, tuple[int, int, Node]] = {NOTHING: (0, 0, self.root)}
        self.waiting = 0

    @staticmethod
    def _ways(cost: int, state: int, initial: str, fault: int) -> Iterator[tuple[int, str, int]]:
        """(cost, edits, state after) of consuming a row from ``state``, inserts first."""
        edits = ""
        for _ in range(MAX_INSERTS[state] + 1):
            yield cost + DELETE, edits + "D", state
            if fault not in (BLANK, DUPLICATE):
                cut = CUT if fault == TRUNCATED else 0
                if initial == WANTED[state]:
                    yield cost + KEEP + cut, edits + "K", FOLLOWING[state]
                else:
                    yield cost + REROLE + cut, edits + "R", FOLLOWING[state]
                    if initial == "s" and state == NOTHING:
                        yield cost + KEEP + cut, edits + "K", SYSTEM
            cost, edits, state = cost + INSERT, edits + "I", FOLLOWING[state]

    @staticmethod
    def _hopeless(state: int, cost: int, place: int, others: dict) -> bool:
        """Whether another survivor does at least as well, whatever rows follow.

        User and assistant states are reached from any other by inserts. An assistant state goes
        on like the system state; it goes on like the empty one but for a system turn, which it
        can delete.
        """
        for other, (its_cost, its_place, _) in others.items():
            if other == state:
                continue
            if state in (USER, ASSISTANT):
                steps, at = 0, other
                while at != state:
                    steps, at = steps + 1, FOLLOWING[at]
                extra = INSERT * steps
            else:
                extra = 0 if other == ASSISTANT else INSERT if other == USER else None
                if extra is None:
                    continue
                if state == NOTHING:
                    if its_cost + extra + DELETE < cost:
                        return True
                    continue
            if (its_cost + extra, its_place) < (cost, place):
                return True
        return False

    def step(self, initial: str, fault: int, row: object) -> list[tuple[str, object]]:
        best: dict[int, tuple[int, int, str, Node]] = {}
        for state, (cost, place, node) in self.alive.items():
            for total, edits, after in self._ways(cost, state, initial, fault):
                known = best.get(after)
                if known is None or (total, place, edits) < known[:3]:
                    best[after] = (total, place, edits, node)
        order = sorted((place, edits, state) for state, (_, place, edits, _) in best.items())
        ranked = {state: (best[state][0], at) for at, (_, _, state) in enumerate(order)}
        rivals = {state: (cost, at, None) for state, (cost, at) in ranked.items()}
        old = [node for _, _, node in self.alive.values()]
        self.alive = {}
        for state, (cost, at) in ranked.items():
            if not self._hopeless(state, cost, at, rivals):
                node = Node(best[state][3], best[state][2], row)
                node.tip = True
                self.waiting += 1
                self.alive[state] = (cost, at, node)
        for node in old:
            node.tip = False
            self._release(node)
        return self._settled()

    def _release(self, node: Node) -> None:
        while not node.kids and not node.tip and node.parent is not None:
            parent = node.parent
            parent.kids.remove(node)
            node.parent = None
            self.waiting -= 1
            node = parent

    def _settled(self) -> list[tuple[str, object]]:
        """Cuts the tree at the last node that all survivors share and returns the edits up to it."""
        final = []
        while len(self.root.kids) == 1 and not self.root.tip:
            child = self.root.kids[0]
            final.append((child.edits, child.row))
            child.parent = None
            self.waiting -= 1
            self.root = child
        return final

    def finish(self) -> list[tuple[str, object]]:
        """The rest of the least way to an accepted end, its closing inserts with no row."""
        ends = []
        for state, (cost, place, node) in self.alive.items():
            edits = ""
            for _ in range(MAX_INSERTS[state] + 1):
                if state in (NOTHING, ASSISTANT):
                    ends.append((cost, place, edits, node))
                cost, edits, state = cost + INSERT, edits + "I", FOLLOWING[state]
        _, _, edits, node = min(ends, key=lambda end: end[:3])
        path = []
        while node is not self.root:
            path.append((node.edits, node.row))
            node = node.parent
        return path[::-1] + ([(edits, None)] if edits else [])


class Emitter:
    """Turns final edits into output rows; knows the role that comes next."""

    def __init__(self, conversation: int | None):
        self.conversation, self.state = conversation, NOTHING

    def _placed(self, role: str) -> None:
        self.state = SYSTEM if self.state == NOTHING and role.startswith("s") else FOLLOWING[self.state]

    def rows(self, final: list[tuple[str, object]]) -> Iterator[tuple]:
        for edits, row in final:
            for edit in edits:
                wanted = ROLE_NAME[WANTED[self.state]]
                if edit == "I":
                    self._placed(wanted)
                    yield self.conversation, edit, INSERT, None, None, None, wanted, ""
                    continue
                turn, fault, old, text = row
                if edit == "D":
                    yield self.conversation, edit, DELETE, turn, fault, old, None, None
                    continue
                role = old if edit == "K" else wanted
                self._placed(role)
                cost = (KEEP if edit == "K" else REROLE) + (CUT if fault == TRUNCATED else 0)
                yield self.conversation, edit, cost, turn, fault, old, role, text


def _batches(rows: Iterator[tuple], schema: pa.Schema, sized: int | None) -> Iterator[pa.RecordBatch]:
    """Record batches of bounded rows and bytes; ``sized`` is the column whose text counts."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[sized] or "") if sized is not None else 0
        if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array(values, field.type) for values, field in zip(zip(*rows), schema, strict=True)]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def _edit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    search = emitter = None
    for batch in batches:
        columns = [batch.column(name).to_pylist() for name in ("conv_id", "turn", "role", "text", "state")]
        for conversation, turn, role, text, fault in zip(*columns):
            if emitter is None or conversation != emitter.conversation:
                if emitter is not None:
                    yield from emitter.rows(search.finish())
                search, emitter = Search(), Emitter(conversation)
                before = None
            if fault != BLANK and before == (turn, role, text):
                fault = DUPLICATE
            before = (turn, role, text)
            yield from emitter.rows(search.step(role[:1], fault, (turn, fault, role, text)))
    if emitter is not None:
        yield from emitter.rows(search.finish())


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _batches(_edit_rows(batches), EDITS, 7)


class Digest:
    """Running counts and hash of one conversation's edits."""

    def __init__(self, conversation: int | None):
        self.conversation = conversation
        self.counts = [0, 0, 0, 0]
        self.first = self.last = None
        self.turns = self.illegal = self.cost = 0
        self.before: str | None = None
        self.audit = io.StringIO()
        self.hash, self.lines = hashlib.sha256(), 0

    def add(self, edit: str, cost: int, turn: int | None, fault: int | None, old: str | None, role: str | None, text: str | None) -> None:
        self.audit.write(edit)
        self.cost += cost
        if edit != "I":
            self.counts[fault] += 1
            if turn is not None and turn != self.last:
                self.first = turn if self.first is None else self.first
                self.last, self.turns = turn, self.turns + 1
            if self.before is not None and self.before + old[:1] not in ("su", "ua", "au"):
                self.illegal += 1
            self.before = old[:1]
        if edit != "D":
            line = ("\n" if self.lines else "") + f"{role}:{text}"
            self.hash.update(line.encode("utf-8", "surrogatepass"))
            self.lines += 1

    def row(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        _, blank, duplicate, truncated = self.counts
        return self.conversation, gaps, blank, duplicate, truncated, self.illegal, self.cost, self.audit.getvalue(), self.hash.hexdigest()


def _digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    digest = None
    for batch in batches:
        columns = [batch.column(name).to_pylist() for name in EDITS.names]
        for conversation, *edit in zip(*columns):
            if digest is None or conversation != digest.conversation:
                if digest is not None:
                    yield digest.row()
                digest = Digest(conversation)
            digest.add(*edit)
    if digest is not None:
        yield digest.row()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _batches(_digest_rows(batches), DIGESTS, 7)


INK = r"[^\x20\x09-\x0D]"


def _cleaned(turns: DataFrame) -> DataFrame:
    space = F.lit(" ")
    ids = [F.col(name).cast("bigint").alias(name) for name in ("conv_id", "turn")]
    return turns.select(*ids, F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))


def ordered(turns: DataFrame) -> DataFrame:
    """Rows with their fault, each conversation whole and in order within one partition.

    The first turn of every (conversation, role, text) is an aggregate that combines map-side; a
    later turn is a duplicate. Equal rows of one turn are neighbours, which the stream sees.
    """
    rows = _cleaned(turns).withColumn("mark", F.sha2(F.concat_ws("\n", F.char_length("role"), "role", "text"), 256))
    turn = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    firsts = rows.groupBy(F.col("conv_id").alias("first_id"), F.col("mark").alias("first_mark")).agg(F.min(turn).alias("first"))
    text = F.col("text")
    fault = (
        F.when(~text.rlike(INK), F.lit(BLANK))
        .when(~F.col("first").eqNullSafe(turn), F.lit(DUPLICATE))
        .when(~text.rlike(r"[.!?][\x20\x09-\x0D]*\z"), F.lit(TRUNCATED))
        .otherwise(F.lit(SOUND))
    )
    joined = rows.join(firsts, F.col("conv_id").eqNullSafe(F.col("first_id")) & (F.col("mark") == F.col("first_mark")))
    return (
        joined.select("conv_id", "turn", "role", "text", fault.alias("state"))
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
    )


def repair(turns: DataFrame) -> DataFrame:
    """One row per edit of every conversation, each conversation in order within one partition.

    Columns: conv_id, edit (K, R, D or I), cost, turn, fault and old_role of the edited row (null
    for inserts), role and text afterwards (null for deleted rows).
    """
    return ordered(turns).mapInArrow(_edits, EDITS_DDL)


def digest(edits: DataFrame) -> DataFrame:
    """One row per conversation from the rows of ``repair`` as it returns them."""
    return edits.mapInArrow(_digests, DIGEST_DDL)


def damaged(turns: DataFrame) -> DataFrame:
    """``turns`` with faults put in by crc32 of ``conv_id:turn``, modulo 20 (nulls read as one space).

    0 drops the row, 1 empties its text, 2 takes its ``.!?`` away, 3 repeats it, 4 makes it a user's.
    """
    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    way = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    rows = _cleaned(turns).withColumn("way", way).where(F.col("way") != 0)
    text = F.when(F.col("way") == 1, "").when(F.col("way") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("way") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("way") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def audit(turns: DataFrame) -> DataFrame:
    """The digest of every conversation of ``turns`` after ``damaged``; those that lost all rows have zeros."""
    found = digest(repair(damaged(turns)))
    ids = turns.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    joined = ids.join(found, ids["conv_id"].eqNullSafe(found["conv_id"]), "left")
    counts = [F.coalesce(F.col(name), F.lit(0)).cast("bigint").alias(name) for name in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256().hexdigest()
    return joined.select(
        ids["conv_id"], *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256")
    )
