"""Repair of damaged conversations by iterative-deepening A*.

``faults`` numbers a conversation's rows and names the first fault of each;
``solve`` finds the cheapest edits that give the role initials
``(s?(ua)+)?``; ``script`` lists these edits, one a row, and ``repaired`` the
turns that they leave.

The search walks the rows with the state of the role pattern (nothing said yet,
after s, after u, after a).  At each step it tries Delete, Insert, Keep, Rerole,
the ASCII order of their initials, depth first under a bound on the cost;
bounds rise to the least estimate that went beyond the last one.  A state that
failed is kept in a table with the cost that is known to remain at least, for
this bound and the later ones.  The first path to an accepting end is so the
cheapest and, among those, the ASCII-least.  The estimate for the rest adds what
each row costs at least (blank and duplicate rows must go, truncated rows cost 3
or 4, roles without a place 3 or 4) and, for each two neighbours of one role,
what undoing that costs at least.

Conversations are cut into stretches of STRETCH rows.  Those of one stretch
(nearly all) are searched once.  Of longer ones each stretch is searched on its
own, for each state that it can begin and end in, and the stretches of a
conversation are joined from the last to the first: costs add up, and of equal
costs the ASCII-least string is kept, which is the least as a whole because no
string of a stretch begins another one of the same states and cost.  What meets
in one task is the edits of a conversation (about a byte a row); its texts only
pass through the digest's stream in their order.

Defined cases: a null column reads as one space (null turns sort first, and do
not count for gaps); an empty role has no initial; rows of one turn stand in the
order of role and text; a conversation that loses all rows has zeros and an
empty audit; equal rows in a table count twice; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quill.llm import common as C
from quill.llm.positions import numbered

STRETCH = 64
#: Searched stretches that a task remembers.
MEMORY = 20_000

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
_NEVER = 1 << 30
#: States of the pattern: nothing said, after s, after u, after a.
START, SYSTEM, USER, ASSISTANT = range(4)
#: State after user or assistant may follow, by state; and after a kept initial.
_NEXT = (USER, USER, ASSISTANT, USER)
_KEPT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})


class Search:
    """Cheapest edits of one stretch: ``roles`` has an initial a row (s, u, a,
    or x for others), ``faults`` '.', 'b' (blank), 'd' (duplicate) or 't' (truncated)."""

    def __init__(self, roles: str, faults: str) -> None:
        self.roles, self.n = roles, len(roles)
        self.must = [f in "bd" for f in faults]
        self.extra = [TRUNCATED if f == "t" else 0 for f in faults]
        # Each row's own least cost, from here to the end, if no s may be kept;
        # and the most that one kept s can save.
        self.least, self.saves = [0] * (self.n + 1), [0] * (self.n + 1)
        for i in range(self.n - 1, -1, -1):
            if self.must[i]:
                own, save = DELETE, 0
            elif roles[i] in "ua":
                own, save = self.extra[i] and min(TRUNCATED, DELETE), 0
            else:
                own = min(REROLE + self.extra[i], DELETE)
                save = own - self.extra[i] if roles[i] == "s" else 0
            self.least[i] = self.least[i + 1] + own
            self.saves[i] = max(self.saves[i + 1], save)

    def _estimates(self, after: str) -> list[list[int]]:
        """Lower bounds of what remains at (row, state), if ``after`` (u or a)
        follows.  A clash of two neighbours is undone by Rerole (3, two clashes
        at most), Insert (3), or Delete, which takes away one clash and adds 1
        to what a truncated row costs anyway: 1 where a row is truncated, else
        a half of 3, here in halves."""
        out, clashes, head, weight = [], 0, after, 3  # of the rows left: their clashes, the first one's role and weight
        for i in range(self.n, -1, -1):
            if i < self.n and not self.must[i]:
                mine, own = self.roles[i], 2 if self.extra[i] else 3
                if mine in "ua":
                    clashes += min(own, weight) * (mine == head)
                    head, weight = mine, own
                else:
                    head, weight = "x", 3
            fresh, said = (self.least[i] - (-(clashes + weight * (head == r)) // 2) for r in "au")
            out.append([max(0, fresh - self.saves[i]), fresh, said, fresh])
        return out[::-1]

    def run(self, state: int, ends: tuple[int, ...]) -> tuple[int, str] | None:
        """(cost, audit) from a state to one of the states ``ends``."""
        if (START in ends and len(ends) == 1 and state != START) or (ends == (SYSTEM,) and state > SYSTEM):
            return None
        roles, must, extra, n = self.roles, self.must, self.extra, self.n
        if ends in ((START,), (SYSTEM,)) and state == ends[0]:  # nothing more may be said
            return DELETE * n, "D" * n
        known = self._estimates("a" if ends == (USER,) else "u")  # raised where a state failed
        if ends == (SYSTEM,):  # one s is kept, all others go
            known = [[max(0, DELETE * (n - i - 1)), DELETE * (n - i), _NEVER, _NEVER] for i in range(n)] + [[_NEVER, 0, _NEVER, _NEVER]]

        def steps(i: int, q: int) -> list[tuple[str, int, int, int]]:
            out = []
            if i < n:
                out.append(("D", DELETE, i + 1, q))
            out.append(("I", INSERT, i, _NEXT[q]))
            if i < n and not must[i]:
                kept = _KEPT[q].get(roles[i])
                if kept is not None:
                    out.append(("K", KEEP + extra[i], i + 1, kept))
                out.append(("R", REROLE + extra[i], i + 1, _NEXT[q]))
            return out

        limit = n * (DELETE + INSERT + TRUNCATED) + 3 * INSERT
        bound = known[0][state]
        while bound <= limit:
            # a frame: row, state, cost so far, steps left, least cost seen to remain
            frames = [[0, state, 0, iter(steps(0, state)), _NEVER]]
            path: list[str] = []
            while frames:
                frame = frames[-1]
                i, q, spent = frame[0], frame[1], frame[2]
                for letter, cost, j, to in frame[3]:
                    rest = cost + known[j][to]
                    if spent + rest > bound:
                        frame[4] = min(frame[4], rest)
                        continue
                    path.append(letter)
                    if j == n and to in ends:
                        return spent + cost, "".join(path)
                    frames.append([j, to, spent + cost, iter(steps(j, to)), _NEVER])
                    break
                else:
                    known[i][q] = max(known[i][q], frame[4])
                    frames.pop()
                    if frames:
                        frames[-1][4] = min(frames[-1][4], known[i][q] + (spent - frames[-1][2]))
                        path.pop()
            bound = max(bound + 1, known[0][state])
        return None


def solve_stretch(roles: str, faults: str, first: bool, last: bool) -> list[tuple[int, int, int, str]]:
    """(state before, state after, cost, audit) of a stretch, for the states that it can begin and end in;
    the last one ends in any accepting state, given as START."""
    search, out = Search(roles, faults), []
    for q in (START,) if first else range(4):
        for ends in ((START, ASSISTANT),) if last else [(e,) for e in range(4)]:
            if found := search.run(q, ends):
                out.append((q, ends[0], *found))
    return out


def join_stretches(parts: list[list[tuple[int, int, int, str]]]) -> tuple[int, list[tuple[int, str]]]:
    """The cheapest, ASCII-least way through a conversation's stretches: its cost, and for each stretch (state before, audit)."""
    after: dict[int, tuple[int, str, list | None]] = {q: (cost, audit, None) for q, _, cost, audit in parts[-1]}
    # per state: cost to the end, audit of this stretch, and the choice of the next one
    for part in reversed(parts[:-1]):
        best: dict[int, tuple] = {}
        for q, e, cost, audit in part:
            if e in after:
                found = (cost + after[e][0], audit, (e, after[e]))
                if q not in best or found[0] < best[q][0] or found[0] == best[q][0] and _less(found, best[q]):
                    best[q] = found
        after = best
    node, q, out = after[START], START, []
    cost = node[0]
    while True:
        out.append((q, node[1]))
        if node[2] is None:
            return cost, out
        q, node = node[2]


def _less(a: tuple, b: tuple) -> bool:
    """Whether the joined audit of a comes before that of b, letter by letter without joining."""
    def letters(node: tuple) -> Iterator[str]:
        while True:
            yield from node[1]
            if node[2] is None:
                return
            node = node[2][1]

    for x, y in zip(letters(a), letters(b)):
        if x != y:
            return x < y
    return False


def _plain(table: DataFrame) -> DataFrame:
    have = {c.lower(): c for c in reversed(table.columns)}
    return table.select(*[table[f"`{have[c]}`"].cast(t).alias(c) for c, t in (("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string"))])


def damaged(table: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): the rows that the damage leaves; null role and text are one space."""
    def shown(c: str):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    rows = _plain(table).select("conv_id", "turn", kind.alias("kind"), shown("role").alias("role"), shown("text").alias("text"))
    rows = rows.where("kind <> 0").select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"), "kind")
    return rows.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("kind", "copy")


def faults(rows: DataFrame) -> DataFrame:
    """(conv, pos, n, turn, role, text, initial, fault) of a conversation's rows in order, written; conv is conv_id as text, a space if null."""
    keyed = C.cut(rows.select(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("conv"), "turn", "role", "text"))
    placed = C.cut(numbered(keyed, "conv", [F.col("turn").asc_nulls_first(), "role", "text"]).withColumn("said", F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)))
    first = placed.groupBy(F.col("conv").alias("c"), F.col("said").alias("s")).agg(F.min("pos").alias("first"))
    again = F.col("pos") > F.col("first")
    words = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    fault = F.when(words == "", "b").when(again, "d").when(~F.substring(words, -1, 1).isin(".", "!", "?"), "t").otherwise(".")
    initial = F.substring("role", 1, 1)
    out = placed.join(first, (F.col("conv") == F.col("c")) & (F.col("said") == F.col("s")))
    return C.cut(out.select("conv", "pos", "n", "turn", "role", "text", F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("initial"), fault.alias("fault")))


_WAY = "array<struct<before:int,after:int,cost:int,audit:string>>"


def solve(found: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """(conv, seg, before, audit, cost, roles, faults, n): the chosen edits of
    each stretch, with the cost of the whole conversation, written."""
    own = F.sort_array(F.collect_list(F.struct("pos", "initial", "fault")))
    segs = found.groupBy("conv", F.floor(F.col("pos") / stretch).alias("seg")).agg(own.alias("rows"), F.max("n").alias("n"))
    segs = segs.select("conv", "seg", "n", F.array_join("rows.initial", "").alias("roles"), F.array_join("rows.fault", "").alias("faults"))

    def ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[tuple, list[dict]] = {}
        kind = pa.list_(pa.struct([("before", pa.int32()), ("after", pa.int32()), ("cost", pa.int32()), ("audit", pa.string())]))
        for b in batches:
            out = []
            for seg, n, roles, bad in zip(*(b.column(k).to_pylist() for k in range(1, 5))):
                key = (roles, bad, seg == 0, (seg + 1) * stretch >= n)
                if key not in memory:
                    if len(memory) >= MEMORY:
                        memory.clear()
                    memory[key] = [dict(zip(("before", "after", "cost", "audit"), w)) for w in solve_stretch(*key)]
                out.append(memory[key])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, kind)], names=[*b.schema.names, "ways"])

    solved = C.cut(segs.mapInArrow(ways, f"conv string, seg long, n long, roles string, faults string, ways {_WAY}"))
    schema = pa.schema([("conv", pa.string()), ("seg", pa.int64()), ("before", pa.int32()), ("audit", pa.string()), ("cost", pa.int64()), ("roles", pa.string()), ("faults", pa.string())])

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for conv, parts in zip(b.column(0), b.column(1)):
                parts = parts.as_py()
                cost, way = join_stretches([[(w["before"], w["after"], w["cost"], w["audit"]) for w in p["ways"]] for p in parts])
                for k in range(0, len(parts), 1024):
                    some = parts[k : k + 1024]
                    yield C.batch(schema, [conv.as_py()] * len(some), [p["seg"] for p in some], [w[0] for w in way[k : k + 1024]], [w[1] for w in way[k : k + 1024]], [cost] * len(some),
                                  [p["roles"] for p in some], [p["faults"] for p in some])

    whole = solved.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("seg", "ways", "roles", "faults"))).alias("parts"))
    return C.cut(whole.mapInArrow(chosen, "conv string, seg long, before int, audit string, cost long, roles string, faults string"))


def script(chosen: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """(conv, seg, step, edit, pos, role): each edit in order; pos is the row it
    is made on (null: Insert), role the one that Rerole and Insert give."""
    schema = pa.schema([("conv", pa.string()), ("seg", pa.int64()), ("step", pa.int64()), ("edit", pa.string()), ("pos", pa.int64()), ("role", pa.string())])

    def edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for conv, seg, q, audit, roles in zip(*(b.column(k).to_pylist() for k in range(5))):
                i = 0
                for step, letter in enumerate(audit):
                    role = None
                    if letter in "IR":
                        q = _NEXT[q]
                        role = "user" if q == USER else "assistant"
                    elif letter == "K":
                        q = _KEPT[q][roles[i]]
                    out.append((conv, seg, step, letter, None if letter == "I" else seg * stretch + i, role))
                    i += letter != "I"
            if out:
                yield C.batch(schema, *zip(*out))

    return chosen.select("conv", "seg", "before", "audit", "roles").mapInArrow(edits, "conv string, seg long, step long, edit string, pos long, role string")


def repaired(found: DataFrame, chosen: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """(conv, seg, step, role, text) of the turns that the edits leave."""
    said = found.select(F.col("conv").alias("c"), F.col("pos").alias("p"), F.col("role").alias("own"), "text")
    left = script(chosen, stretch).where("edit <> 'D'").join(said, (F.col("conv") == F.col("c")) & (F.col("pos") == F.col("p")), "left")
    return left.select("conv", "seg", "step", F.coalesce("role", "own").alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def _digests(turns: DataFrame) -> DataFrame:
    """(conv, repaired_sha256): a running digest over the turns in their order, so no conversation is held whole."""
    schema = pa.schema([("conv", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, hashlib.sha256()
        for b in batches:
            done: list[tuple[str, str]] = []
            for conv, role, text in zip(b.column(0), b.column(1), b.column(2)):
                conv = conv.as_py()
                if conv != now:
                    if now is not None:
                        done.append((now, digest.hexdigest()))
                    now, digest = conv, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role.as_py()}:{text.as_py()}".encode())
            if done:
                yield C.batch(schema, *zip(*done))
        if now is not None:
            yield C.batch(schema, [now], [digest.hexdigest()])

    ordered = turns.repartition("conv").sortWithinPartitions("conv", "seg", "step").select("conv", "role", "text")
    return ordered.mapInArrow(run, "conv string, repaired_sha256 string")


def _counts(chosen: DataFrame) -> DataFrame:
    """(conv, blank, duplicate, truncated, illegal, cost, audit): the faults over all stretches."""
    def share(c: str):
        return F.sum(F.length(F.regexp_replace("faults", f"[^{c}]", ""))).cast("long")

    # pairs inside a stretch, and the one across to the stretch before
    at = Window.partitionBy("conv").orderBy("seg")
    joined = chosen.withColumn("line", F.concat(F.coalesce(F.substring(F.lag("roles").over(at), -1, 1), F.lit("")), "roles"))
    pairs = F.filter(F.sequence(F.lit(1), F.greatest(F.length("line") - 1, F.lit(1))), lambda i: (F.length("line") > 1) & ~F.substring(F.col("line"), i, F.lit(2)).isin("su", "ua", "au"))
    return joined.groupBy("conv").agg(
        share("b").alias("blank"), share("d").alias("duplicate"), share("t").alias("truncated"), F.sum(F.size(pairs)).cast("long").alias("illegal"), F.max("cost").alias("cost"),
        F.array_join(F.sort_array(F.collect_list(F.struct("seg", "audit"))).getField("audit"), "").alias("audit"))


def repair(table: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """One row per conversation of the undamaged table: its faults after the damage, the edits and the digest of what they leave."""
    found = faults(damaged(table))
    chosen = solve(found, stretch)
    gaps = found.groupBy("conv").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"))
    ids = _plain(table).select("conv_id").distinct().select("conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("conv"))
    out = ids.join(gaps, "conv", "left").join(_counts(chosen), "conv", "left").join(_digests(repaired(found, chosen, stretch)), "conv", "left")
    empty = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                      F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
