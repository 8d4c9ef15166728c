"""Operator 12, conversation structure repair by bidirectional Dijkstra over the edit lattice.

A node of the lattice is (rows consumed, state of the role grammar); an edge is one
edit with its cost and initial. ``cheapest`` searches forward from the first node
and backward from the last, each side with its own heap; once the two fronts add up
to more than the best crossing, all crossings of that cost are known, and the one
with the least concatenated audit is taken. Of two audits of one cost that lead to
one node none is the beginning of the other, so least parts make least wholes.

Rows are put in order by range, not by conversation: a hot one is spread over many
partitions. A conversation that lies inside its partition and has at most ``PIECE``
rows is repaired in that pass. Of the others, each piece of at most ``PIECE`` rows
gives the cheapest edits between any two states of the grammar; neighbouring pieces
combine in rounds of ``FAN_IN``, and a last pass streams the pieces in order along
the audit. What a task holds is the audit, one cell of the result, and a batch. The
SHA-256 of one conversation is sequential by its nature; one task streams its text.

Defined results: rows of a conversation are ordered by turn (null first), role and
text; equal rows are repeats. A null conversation id is a conversation of its own.
Nulls of id, turn, role and text count as one space in what is hashed, compared or
returned as text. An empty table gives an empty result. Other columns are not read.
"""

import hashlib
import heapq
import itertools
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mailsieve.llm.common import small_batches, stage

BLANKS = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
#: The grammar ``(s?(ua)+)?`` as states: nothing yet, after s, after u, after a.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
WANTED = ("u", "u", "a", "u")
ENDS = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
#: Rows of a piece; pieces that are combined at a time.
PIECE = 512
FAN_IN = 64
FINE, BLANK, DUPLICATE, TRUNCATED = ".BDT"


# The search


def _steps(rows, at: int, state: int):
    """Edits that lead on from a node: (initial, cost, next node)."""
    inserted = NEXT[state][WANTED[state]]
    yield "I", INSERT, (at, inserted)
    if at < len(rows):
        initial, fault = rows[at]
        yield "D", DELETE, (at + 1, state)
        if fault in (FINE, TRUNCATED):
            extra = CUT if fault == TRUNCATED else 0
            yield "R", REROLE + extra, (at + 1, inserted)
            if initial in NEXT[state]:
                yield "K", KEEP + extra, (at + 1, NEXT[state][initial])


def _steps_back(rows, at: int, state: int):
    """Edits that lead to a node: (initial, cost, node before)."""
    for before in range(4):
        if NEXT[before][WANTED[before]] == state:
            yield "I", INSERT, (at, before)
    if at:
        initial, fault = rows[at - 1]
        yield "D", DELETE, (at - 1, state)
        if fault in (FINE, TRUNCATED):
            extra = CUT if fault == TRUNCATED else 0
            for before in range(4):
                if NEXT[before][WANTED[before]] == state:
                    yield "R", REROLE + extra, (at - 1, before)
                if NEXT[before].get(initial) == state:
                    yield "K", KEEP + extra, (at - 1, before)


class _Front:
    """One side of the search: the least (cost, audit) known of every node it reached.

    Nodes of equal cost leave the heap in the order of the search, so that edits
    without cost reach a node before it is passed on.
    """

    def __init__(self, rows, sources, forward: bool):
        self.rows, self.forward = rows, forward
        self.labels = {node: (0, "") for node in sources}
        self.done = set()
        self.heap = [(0, self._rank(node), node) for node in sources]
        heapq.heapify(self.heap)

    def _rank(self, node) -> int:
        return node[0] if self.forward else -node[0]

    def top(self) -> float:
        while self.heap and self.heap[0][2] in self.done:
            heapq.heappop(self.heap)
        return self.heap[0][0] if self.heap else float("inf")

    def settle(self):
        """Pass on the nearest node; yields the nodes whose labels became better."""
        _, _, node = heapq.heappop(self.heap)
        self.done.add(node)
        cost, audit = self.labels[node]
        for initial, more, other in (_steps if self.forward else _steps_back)(self.rows, *node):
            label = (cost + more, audit + initial if self.forward else initial + audit)
            if other not in self.labels or label < self.labels[other]:
                self.labels[other] = label
                heapq.heappush(self.heap, (label[0], self._rank(other), other))
                yield other


def cheapest(rows, start: int = 0, ends: tuple[int, ...] = ENDS) -> tuple[int, str] | None:
    """Least cost and, of that cost, least audit to repair ``rows`` of (role initial, fault)."""
    fronts = _Front(rows, [(0, start)], True), _Front(rows, [(len(rows), e) for e in ends], False)
    best = float("inf")

    def crossing(node):
        return fronts[0].labels[node][0] + fronts[1].labels[node][0]

    for node in fronts[0].labels.keys() & fronts[1].labels.keys():
        best = min(best, crossing(node))
    while True:
        tops = fronts[0].top(), fronts[1].top()
        if tops[0] + tops[1] > best or tops[0] + tops[1] == float("inf"):
            break
        side = 0 if tops[0] <= tops[1] else 1
        for node in fronts[side].settle():
            if node in fronts[1 - side].labels:
                best = min(best, crossing(node))
    if best == float("inf"):
        return None
    met = fronts[0].labels.keys() & fronts[1].labels.keys()
    audits = [fronts[0].labels[n][1] + fronts[1].labels[n][1] for n in met if crossing(n) == best]
    return best, min(audits)


@lru_cache(maxsize=1 << 14)
def _known(initials: tuple[str, ...], faults: str) -> tuple[int, str]:
    """Many conversations have the same roles and faults."""
    return cheapest(tuple(zip(initials, faults)))


def transfers(rows) -> list[dict | None]:
    """The cheapest edits from every state to every state, row by row of a 4 by 4 matrix."""
    found = (cheapest(rows, s, (e,)) for s in range(4) for e in range(4))
    return [None if f is None else {"cost": f[0], "audit": f[1]} for f in found]


def combined(left, right) -> list[dict | None]:
    """The cheapest edits of two neighbouring pieces."""
    out = []
    for s in range(4):
        for e in range(4):
            both = [(left[4 * s + m], right[4 * m + e]) for m in range(4)]
            found = [(a["cost"] + b["cost"], a["audit"] + b["audit"]) for a, b in both if a is not None and b is not None]
            out.append(dict(zip(("cost", "audit"), min(found))) if found else None)
    return out


class Repaired:
    """Follows an audit over rows and hashes what it makes of them."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.first = audit, 0, 0, True
        self.hash = hashlib.sha256()

    def _put(self, role: str, text: str, initial: str):
        self.hash.update(("" if self.first else "\n").encode() + f"{role}:{text}".encode())
        self.first, self.state = False, NEXT[self.state][initial]

    def inserts(self):
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            initial = WANTED[self.state]
            self._put(ROLES[initial], "", initial)
            self.at += 1

    def row(self, role: str, text: str):
        self.inserts()
        edit, initial = self.audit[self.at], WANTED[self.state]
        self.at += 1
        if edit == "K":
            self._put(role, text, role[:1])
        elif edit == "R":
            self._put(ROLES[initial], text, initial)

    def digest(self) -> str:
        self.inserts()
        return self.hash.hexdigest()


# In tasks


def _illegal(initials) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


_COUNTS = ("blank", "duplicate", "truncated", "illegal")


def _counts(initials, faults: str) -> dict:
    kinds = {"blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(TRUNCATED)}
    return {**kinds, "illegal": _illegal(initials)}


def _record(conv, roles, texts, faults: str, whole: bool, seq: int) -> dict:
    initials = tuple(role[:1] for role in roles)
    record = {"conv_id": conv, "seq": seq, **_counts(initials, faults)}
    if not whole:
        rows = tuple(zip(initials, faults))
        return {**record, "roles": list(roles), "texts": list(texts), "matrix": transfers(rows)}
    cost, audit = _known(initials, faults)
    repaired = Repaired(audit)
    for role, text in zip(roles, texts):
        repaired.row(role, text)
    return {**record, "cost": cost, "audit": audit, "repaired_sha256": repaired.digest()}


def _arrow(kind: pa.DataType) -> pa.Schema:
    edits = pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string())]))
    counts = [(name, pa.int64()) for name in _COUNTS]
    return pa.schema([
        ("conv_id", kind), ("seq", pa.int64()), *counts, ("cost", pa.int64()), ("audit", pa.string()),
        ("repaired_sha256", pa.string()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("matrix", edits),
    ])


def _ddl(kind: str) -> str:
    counts = ", ".join(f"{name} bigint" for name in _COUNTS)
    return (
        f"conv_id {kind}, seq bigint, {counts}, cost bigint, audit string, repaired_sha256 string, "
        "roles array<string>, texts array<string>, matrix array<struct<cost bigint, audit string>>"
    )


def _batches(records, schema: pa.Schema, rows: int = 256):
    """Records as batches, each handed on as soon as it is full."""
    ready = []
    for record in records:
        ready.append(record)
        if len(ready) == rows:
            yield pa.RecordBatch.from_pylist(ready, schema)
            ready = []
    if ready:
        yield pa.RecordBatch.from_pylist(ready, schema)


def _repair(piece: int):
    """Repair the conversations that lie inside the partition; cut the others into pieces."""

    def records(batches):
        number, conv, held, split = TaskContext.get().partitionId() << 33, None, [], True
        begun, last = False, None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "fault")]
            for own, turn, role, text, fault in zip(*columns):
                if not begun or own != conv:
                    if held:
                        yield _record(conv, *_columns(held), whole=not split, seq=number)
                        number += 1
                    # The first conversation of a partition may have begun in the one before.
                    conv, held, split, begun, last = own, [], not begun, True, None
                elif len(held) == piece:
                    yield _record(conv, *_columns(held), whole=False, seq=number)
                    held, split, number = [], True, number + 1
                if fault != BLANK and (turn, role, text) == last:
                    fault = DUPLICATE
                last = (turn, role, text)
                held.append((role, text, fault))
        if held:  # and the last one may go on in the next
            yield _record(conv, *_columns(held), whole=False, seq=number)

    def run(batches):
        first = next(batches, None)
        if first is not None:
            rest = itertools.chain([first], batches)
            yield from _batches(records(rest), _arrow(first.schema.field("conv_id").type))

    return run


def _columns(held):
    return [h[0] for h in held], [h[1] for h in held], "".join(h[2] for h in held)


def _combine(batches):
    """Fold the matrices of each group of neighbours; rows come sorted by group and place."""

    def records():
        group, matrix, seq = None, None, 0
        for batch in batches:
            for own, place, other in zip(*(batch.column(c).to_pylist() for c in ("key", "seq", "matrix"))):
                if matrix is not None and own == group:
                    matrix = combined(matrix, other)
                    continue
                if matrix is not None:
                    yield {"key": group, "seq": seq, "matrix": matrix}
                group, matrix, seq = own, other, place
        if matrix is not None:
            yield {"key": group, "seq": seq, "matrix": matrix}

    edits = pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string())]))
    yield from _batches(records(), pa.schema([("key", pa.string()), ("seq", pa.int64()), ("matrix", edits)]), 16)


def _join_pieces(batches):
    """Follow the audit of each cut conversation along its pieces, which come in order after it."""
    first = next(batches, None)
    if first is None:
        return

    def records():
        total, repaired, last = None, None, None
        for batch in itertools.chain([first], batches):
            for row in batch.to_pylist():
                if row["seq"] < 0:
                    if total is not None:
                        yield {**total, "repaired_sha256": repaired.digest()}
                    total = {c: row[c] for c in ("conv_id", "cost", "audit")} | dict.fromkeys(_COUNTS, 0)
                    repaired, last = Repaired(row["audit"]), None
                    continue
                for count in _COUNTS:
                    total[count] += row[count]
                if last is not None:
                    total["illegal"] += _illegal([last, row["roles"][0][:1]])
                last = row["roles"][-1][:1]
                for role, text in zip(row["roles"], row["texts"]):
                    repaired.row(role, text)
        yield {**total, "repaired_sha256": repaired.digest()}

    yield from _batches(records(), _arrow(first.schema.field("conv_id").type), 16)


# The plan


def damage_kind() -> Column:
    """What happens to a row; it follows from id and turn."""
    id_, turn = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))
    return F.crc32(F.concat(id_, F.lit(":"), turn)) % 20


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, kind): kind 0 is dropped, 3 is still to be repeated."""
    kind, text = F.col("kind"), F.coalesce("text", F.lit(" "))
    return rows.withColumn("kind", damage_kind()).filter("kind <> 0").select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), "kind",
    )


def _fault(first_turn: Column) -> Column:
    """The first fault of a row, but for repeats of the row right before it."""
    ends = F.substring(F.rtrim("text", F.lit(BLANKS)), -1, 1)
    turn = F.coalesce(F.col("turn"), F.lit(-(2**63)))
    return (
        F.when(F.translate("text", BLANKS, "") == "", BLANK)
        .when(turn > first_turn, DUPLICATE)
        .when(~ends.isin(".", "!", "?"), TRUNCATED)
        .otherwise(FINE)
    )


def conversation_repair(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
    text_col: str = "text", piece: int = PIECE, fan_in: int = FAN_IN,
) -> DataFrame:
    """Per conversation: id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    spark = conversations.sparkSession
    given = conversations.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("bigint").alias("turn"),
        F.col(role_col).alias("role"), F.col(text_col).alias("text"),
    )
    kind = given.schema["conv_id"].dataType.simpleString()
    damaged = damage(given)
    # Texts that stand at more than one turn: where they stand first. By content hash, not text.
    turn = F.coalesce(F.col("turn"), F.lit(-(2**63)))
    said = [F.col("conv_id"), F.col("role"), F.sha2("text", 256).alias("said")]
    firsts = (
        damaged.select(*said, turn.alias("at"))
        .groupBy("conv_id", "role", "said")
        .agg(F.min("at").alias("first_turn"), F.max("at").alias("last_turn"))
        .filter("first_turn < last_turn")
        .select(F.col("conv_id").alias("c"), F.col("role").alias("r"), "said", "first_turn")
    )
    firsts = stage(firsts, "repeated-turns")
    own = damaged.withColumn("own", F.sha2("text", 256))
    same = own["conv_id"].eqNullSafe(firsts["c"]) & (own["role"] == firsts["r"]) & (own["own"] == firsts["said"])
    marked = own.join(firsts, same, "left").select(
        "conv_id", "turn", own["role"], "text", _fault(F.col("first_turn")).alias("fault"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")
    order = ["conv_id", "turn", "role", "text"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = marked.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    found = stage(small_batches(sorted_).mapInArrow(_repair(piece), _ddl(kind)), "repairs")

    counts = list(_COUNTS)
    result = ["conv_id", *counts, "cost", "audit", "repaired_sha256"]
    whole = found.filter("matrix is null").select(*result)
    cut = found.filter("matrix is not null")
    joined = _joined(cut, kind, fan_in).select(*result)
    seen = F.when(damage_kind() != 0, F.col("turn"))
    gaps = given.groupBy(F.col("conv_id").alias("conv")).agg(
        F.coalesce(F.max(seen) - F.min(seen) + 1 - F.count_distinct(seen), F.lit(0)).alias("gaps")
    )
    repaired = whole.union(joined)
    zero = F.lit(0).cast("bigint")
    return gaps.join(repaired, gaps["conv"].eqNullSafe(repaired["conv_id"]), "left").select(
        F.col("conv").alias(conv_col), "gaps", *(F.coalesce(c, zero).alias(c) for c in [*counts, "cost"]),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def _joined(cut: DataFrame, kind: str, fan_in: int) -> DataFrame:
    """The repairs of conversations that lie in several pieces."""
    # A null id has a key of its own.
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("null"))
    left = cut.select(key.alias("key"), "seq", "matrix")
    names = cut.select(key.alias("key"), "conv_id").distinct()
    while True:
        most = left.groupBy("key").count().agg(F.max("count")).first()[0] or 0
        if most <= 1:
            break
        place = F.row_number().over(Window.partitionBy("key").orderBy("seq")) - 1
        grouped = left.withColumn("group", F.floor(place / fan_in))
        grouped = grouped.repartition("key", "group").sortWithinPartitions("key", "group", "seq")
        named = grouped.select(F.concat_ws("#", "group", "key").alias("key"), "seq", "matrix")
        folded = named.mapInArrow(_combine, "key string, seq bigint, matrix array<struct<cost bigint, audit string>>")
        left = stage(folded.withColumn("key", F.expr("substring(key, locate('#', key) + 1)")), "transfers")
    ends = F.array(*(F.col("matrix")[e] for e in ENDS))
    best = F.array_min(F.filter(ends, lambda e: e.isNotNull()))
    heads = left.join(names, "key").select(
        "conv_id", "key", F.lit(-1).cast("bigint").alias("seq"), *(F.lit(0).cast("bigint").alias(c) for c in _COUNTS),
        best["cost"].alias("cost"), best["audit"].alias("audit"),
    )
    pieces = cut.select("conv_id", key.alias("key"), "seq", *_COUNTS, "roles", "texts")
    lined = heads.unionByName(pieces, allowMissingColumns=True).repartition("key").sortWithinPartitions("key", "seq")
    return lined.mapInArrow(_join_pieces, _ddl(kind))
