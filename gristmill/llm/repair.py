"""Repair of the structure of conversations by a DP over retained subsequences.

A conversation must read as an optional system turn, then user and assistant in turn,
ending with the assistant, or be empty. Turns are kept, given another role, or deleted,
and empty turns inserted. The DP chooses the retained turns. Between two of them lies a
gap, whose deletions cost a difference of prefix sums and whose insertions follow from
the pair of roles; so the best way to go on from a place is a minimum over the three
roles of the next retained turn, each kept as a running minimum from the end, and a turn
costs a constant. Of equally cheap repairs the one with the ASCII-least audit counts;
that means: the longest run of deletions first, then insertions, then the turn's letter.

A conversation may hold any share of all rows. What the DP needs of a row is small (no
texts, digests instead) and dealt to sorted ranges that are written; a range is one task.
A conversation that several ranges share is chained: each range tells what it would cost
to get from each role to each other one, then, knowing what follows it, which role each
one leads to, and then it is solved like a conversation of its own. Both tables have two
rows for each range at most. Texts are met again in the order of the turns by a task that
keeps none of them, as a digest of a whole conversation can only be made in one place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.textkit import ensure_checkpoint_dir, releasing, small_batches

#: What edits cost.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
_NEVER = 1 << 60
#: The role retained last (none, system, user, assistant), and how many insertions lead from it to the next one or the end.
STATES, ROLES = "-sua", "sua"
_BETWEEN = {"-": {"s": 0, "u": 0, "a": 1}, "s": {"s": _NEVER, "u": 0, "a": 1}, "u": {"s": _NEVER, "u": 1, "a": 0}, "a": {"s": _NEVER, "u": 0, "a": 1}}
_TO_END = {"-": 0, "s": 2, "u": 1, "a": 0}
END = tuple(INSERT * _TO_END[r] for r in STATES)
NAMES = {"u": "user", "a": "assistant"}
_BLANK = " \t\n\x0b\x0c\r"


class Gaps:
    """The DP of a run of turns, given for each role what it costs to go on after the run when that role was retained last.

    turns: the initial of each turn's role ("" for others than s, u, a), whether it must
    be deleted, whether it is truncated.
    """

    def __init__(self, turns: Sequence[tuple[str, bool, bool]], after: Sequence[int]):
        self.turns, self.after, n = turns, after, len(turns)
        self.best = [None] * n + [[(_NEVER, n)] * 3]
        #: Prefix sums of deletions, which all cost the same.
        self.total = DELETE * n
        best = self.best[n]
        for i in range(n - 1, -1, -1):
            initial, gone, cut = turns[i]
            if not gone:
                onward = self.costs(i + 1, best)
                extra = TRUNCATED * cut + DELETE * i
                new = list(best)
                for k, role in enumerate(ROLES):
                    own = 0 if initial == role else REROLE if role != "s" else _NEVER
                    cost = extra + own + onward[k + 1]
                    if cost < best[k][0]:  # of equals the later turn stays: more deletions come first
                        new[k] = (cost, i)
                best = new
            self.best[i] = best

    def costs(self, i: int, best: list[tuple[int, int]] | None = None) -> list[int]:
        """From turn i on, for each role retained last."""
        best = best or self.best[i]
        gone = DELETE * i
        out = []
        for at, state in enumerate(STATES):
            least = self.total + self.after[at]
            for k, role in enumerate(ROLES):
                least = min(least, INSERT * _BETWEEN[state][role] + best[k][0])
            out.append(least - gone)
        return out

    def walk(self, state: str) -> Iterator[tuple[int, str, str]]:
        """The retained turns in order, each with its letters and the role retained last; from `state` on."""
        i = 0
        while True:
            whole = self.total + self.after[STATES.index(state)]
            found = (whole, -len(self.turns), "", "")
            for k, role in enumerate(ROLES):
                cost, j = self.best[i][k]
                if cost < _NEVER and _BETWEEN[state][role] < _NEVER:
                    letters = "I" * _BETWEEN[state][role] + ("K" if self.turns[j][0] == role else "R")
                    found = min(found, (cost + INSERT * _BETWEEN[state][role], -j, letters, role))
            if not found[3]:
                return
            state = found[3]
            yield -found[1], found[2], state
            i = 1 - found[1]


def damage(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after faults by crc32 of `conv_id:turn`; nulls of all columns are one space there, and those of role and text stay one."""
    kind = F.crc32(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    harmed = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    times = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    rows = turns.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), harmed.alias("text"), times.alias("times"))
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.col("times"))).alias("copy")).drop("copy")


_KEY = ["conv_id", "turn", "role", "digest"]
_TURN = "conv_id long, turn long, role string, digest binary"


def _keyed(turns: DataFrame) -> DataFrame:
    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.unhex(F.sha2("text", 256)).alias("digest"), "text")


def _slim(turns: DataFrame) -> DataFrame:
    """What the DP needs of each turn, and whether an earlier one has its role and text."""
    last = F.right(F.rtrim("text", F.lit(_BLANK)), F.lit(1))
    fault = F.when(last == "", "blank").when(~last.isin(".", "!", "?"), "truncated")
    slim = _keyed(turns).select(*_KEY, fault.alias("fault")).checkpoint()
    same = ["conv_id", "role", "digest"]
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    repeated = slim.groupBy(*same).agg(F.count("*").alias("c"), F.min(place).alias("first")).where("c > 1").drop("c").withColumnsRenamed({c: f"r_{c}" for c in same}).checkpoint()
    # both sides are written, so that the join can split the rows of a turn that is repeated very often
    met = slim.join(repeated, [F.col(c).eqNullSafe(F.col(f"r_{c}")) for c in same], "left")
    return met.select(*_KEY, "fault", F.coalesce(place > F.col("first"), F.lit(False)).alias("later"))


class _Runs:
    """The conversations of a sorted range, one after the other: id, keys of the turns, faults, and what the DP reads; part is the range."""

    def __init__(self, batches: Iterable[pa.RecordBatch]):
        self.batches, self.part = batches, None

    def __iter__(self) -> Iterator[tuple[int | None, list[tuple], list[str], list[tuple[str, bool, bool]]]]:
        now, keys, faults, turns = (), [], [], []
        for batch in self.batches:
            for conv, turn, role, digest, fault, later, self.part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != (conv,):
                    if now:
                        yield now[0], keys, faults, turns
                    now, keys, faults, turns = (conv,), [], [], []
                key = (turn, role, digest)
                if fault != "blank" and (later or keys and keys[-1] == key):  # equal turns are never in two ranges
                    fault = "duplicate"
                keys.append(key)
                faults.append(fault)
                turns.append((role[:1] if role[:1] in ROLES else "", fault in ("blank", "duplicate"), fault == "truncated"))
        if now:
            yield now[0], keys, faults, turns


def _ends(ranges: DataFrame) -> list:
    """The first and the last conversation of each range (one row if it is the same), with what it costs to get through from each role to each other."""

    def run(batches):
        first = last = None
        for conv, _, _, turns in (runs := _Runs(batches)):
            last = (conv, turns)
            first = first or last
        for at, (conv, turns) in enumerate([first] if first is last else [first, last]) if first else ():
            through = [Gaps(turns, [0 if s == goal else _NEVER for s in STATES]).costs(0) for goal in STATES]
            cells = [min(x, _NEVER) for row in through for x in row]
            yield pa.RecordBatch.from_pydict({"part": pa.array([runs.part], pa.int32()), "at": pa.array([at], pa.int32()), "conv_id": pa.array([conv], pa.int64()), "costs": [cells]})

    cells = ranges.mapInArrow(releasing(run), "part int, at int, conv_id long, costs array<long>")
    return sorted(cells.collect(), key=lambda r: (r["part"], r["at"]))  # two rows for each range at most


def _chains(ends: list) -> dict[int | None, list]:
    """The ranges that share a conversation, in their order, for each such conversation."""
    runs: dict[tuple, list] = {}
    for row in ends:
        runs.setdefault((row["conv_id"],), []).append(row)
    return {conv: rows for (conv,), rows in runs.items() if len(rows) > 1}


def _after(chains: dict) -> dict[tuple[int, int | None], list[int]]:
    """For each range and shared conversation, what it costs to go on after it from each role."""
    out = {}
    for conv, rows in chains.items():
        cost = list(END)
        for row in reversed(rows):
            out[row["part"], conv] = cost
            through = [row["costs"][4 * g : 4 * g + 4] for g in range(4)]  # by the role it ends with, then that it begins with
            cost = [min(min(through[g][s] + cost[g], _NEVER) for g in range(4)) for s in range(4)]
    return out


def _starts(ranges: DataFrame, chains: dict, after: dict) -> dict[tuple[int, int | None], str]:
    """For each range and shared conversation, the role that was retained last before it."""
    if not after:
        return {}

    def run(batches):
        for conv, _, _, turns in (runs := _Runs(batches)):
            if (part := runs.part, conv) in after:
                gaps = Gaps(turns, after[part, conv])
                to = "".join(next(iter([*gaps.walk(s)][-1:]), (0, "", s))[2] for s in STATES)
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "conv_id": pa.array([conv], pa.int64()), "to": [to]})

    leads = {(r["part"], r["conv_id"]): r["to"] for r in ranges.mapInArrow(releasing(run), "part int, conv_id long, to string").collect()}  # two rows for each range at most
    out = {}
    for conv, rows in chains.items():
        state = STATES[0]
        for row in rows:
            out[row["part"], conv] = state
            state = leads[row["part"], conv][STATES.index(state)]
    return out


def edits(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest (sha256 of the text), fault, letters (of what was inserted before it and of itself) and state (the role it is retained as), for each turn.

    turns: conv_id (a whole number), turn, role, text, without null roles and texts. A
    turn's first fault is blank (no character but ASCII white space), duplicate (role
    and text seen earlier) or truncated (it does not end in `.!?`). Turns go by their
    number, null first, ties by role and digest. The letters of a conversation, one turn
    after the other, are its audit, but for insertions at its end. A null conv_id is a
    conversation of its own.
    """
    ensure_checkpoint_dir(turns.sparkSession)
    small_batches(turns.sparkSession)
    ranges = _slim(turns).repartitionByRange(*_KEY).sortWithinPartitions(*_KEY).withColumn("part", F.spark_partition_id()).checkpoint()
    chains = _chains(_ends(ranges))
    after = _after(chains)
    starts = _starts(ranges, chains, after)

    def run(batches):
        for conv, keys, faults, found in (runs := _Runs(batches)):
            part = runs.part
            gaps = Gaps(found, after.get((part, conv), END))
            letters, states = ["D"] * len(keys), [""] * len(keys)
            for i, own, state in gaps.walk(starts.get((part, conv), STATES[0])):
                letters[i], states[i] = own, state
            turn, role, digest = zip(*keys, strict=True)
            for at in range(0, len(keys), 10_000):
                to = slice(at, at + 10_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([conv] * len(keys[to]), pa.int64()), pa.array(turn[to], pa.int64()), pa.array(role[to]), pa.array(digest[to], pa.binary()), pa.array(faults[to], pa.string()), pa.array(letters[to]), pa.array(states[to])],
                    names=[*_KEY, "fault", "letters", "state"],
                )

    return ranges.mapInArrow(releasing(run), f"{_TURN}, fault string, letters string, state string")


_REPORT = pa.schema([(n, pa.string() if n in ("audit", "repaired_sha256") else pa.int64()) for n in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")])
_TURNS = pa.schema([("conv_id", pa.int64()), ("nth", pa.int64()), ("role", pa.string()), ("text", pa.string())])


class _Conversation:
    """Counts, audit and digest of one conversation, from its rows in order; its repaired turns go to `lines`."""

    def __init__(self, conv, lines: list | None):
        self.conv, self.low, self.high, self.distinct = conv, None, None, 0
        self.faults = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        self.illegal, self.cost, self.audit, self.said, self.n, self.lines = 0, 0, [], hashlib.sha256(), 0, lines
        self.before, self.state, self.waiting = None, STATES[0], None

    def line(self, role: str, text: str) -> None:
        if self.lines is None:
            self.said.update(f"{chr(10) if self.n else ''}{role}:{text}".encode())
        else:
            self.lines.append((self.conv, self.n, role, text))
        self.n += 1

    def edit(self, turn: int | None, role: str, fault: str | None, letters: str, state: str) -> None:
        if turn is not None and turn != self.high:
            self.low, self.high, self.distinct = turn if self.low is None else self.low, turn, self.distinct + 1
        if fault:
            self.faults[fault] += 1
        self.illegal += self.before is not None and self.before + role[:1] not in ("su", "ua", "au")
        self.before = role[:1]
        self.audit.append(letters)
        self.cost += DELETE * letters.count("D") + INSERT * letters.count("I") + REROLE * letters.count("R") + TRUNCATED * (fault == "truncated" and state != "")
        if state:
            self.insert(len(letters) - 1)
            self.state, self.waiting = state, role if letters[-1] == "K" else NAMES[state]

    def insert(self, n: int) -> None:
        for _ in range(n):
            self.state = "a" if self.state == "u" else "u"
            self.line(NAMES[self.state], "")

    def text(self, text: str) -> None:
        """A text of the turn that was last; of equal turns only one can be retained."""
        if self.waiting is not None:
            self.line(self.waiting, text)
            self.waiting = None

    def end(self) -> list:
        """The values of the report."""
        n = _TO_END[self.state]
        self.insert(n)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return [self.conv, gaps, *self.faults.values(), self.illegal, self.cost + INSERT * n, "".join(self.audit) + "I" * n, self.said.hexdigest()]


def _told(turns: DataFrame, conversations: DataFrame | None, lines: bool) -> DataFrame:
    """All conversations in order, each in one task, which keeps no texts: repaired turns or reports."""
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(n) for n in names]
    ids = (turns if conversations is None else conversations).select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    heads = ids.select("conv_id", *none("long", "turn"), *none("string", "role"), *none("binary", "digest"), F.lit(0).alias("kind"), *none("string", "fault", "letters", "state", "text"))
    told = edits(turns).select(*_KEY, F.lit(1).alias("kind"), "fault", "letters", "state", *none("string", "text"))
    said = _keyed(turns).select(*_KEY, F.lit(2).alias("kind"), *none("string", "fault", "letters", "state"), "text")
    rows = heads.unionByName(told).unionByName(said).repartition("conv_id").sortWithinPartitions(*_KEY, "kind")
    schema = _TURNS if lines else _REPORT

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []

        def batch():
            done = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
            out.clear()
            return done

        for part in batches:
            for conv, turn, role, _, kind, fault, letters, state, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if kind == 0:
                    if now:
                        ended = now.end()
                        out += [] if lines else [ended]
                    now = _Conversation(conv, out if lines else None)
                elif kind == 1:
                    now.edit(turn, role, fault, letters, state)
                else:
                    now.text(text)
            if out:
                yield batch()
        if now:
            ended = now.end()
            out += [] if lines else [ended]
        if out:
            yield batch()

    kinds = {pa.int64(): "long", pa.string(): "string"}
    return rows.mapInArrow(releasing(run), ", ".join(f"{f.name} {kinds[f.type]}" for f in schema))


def repair_turns(turns: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """conv_id, nth (from 0), role and text of the repaired conversations; see `edits` for what comes in."""
    return _told(turns, conversations, True)


def repair_report(turns: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """What was found in each conversation and what its repair is: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    See `edits` for what comes in and how nulls, ties and repeated turns count.
    gaps: turn numbers that are missing between the smallest and the largest; illegal:
    pairs of adjacent turns whose roles do not follow each other; repaired_sha256: of the
    repaired turns as `role:text`, joined by line feeds. conversations: conv_id of those
    that have a row even without turns: zeros, no audit and the digest of nothing.
    """
    return _told(turns, conversations, False)
