"""Repair of conversations whose turns are lost, empty, cut, repeated or of a wrong role.

A well-formed conversation has the role initials ``(s?(ua)+)?``. Edits turn what is there into
one: Keep (0), Rerole to user or assistant (2), Delete (3; blank rows and duplicates must go),
Insert an empty user or assistant text anywhere (2); a truncated row that stays adds 1. The
cheapest edits win, of equally cheap ones those whose initials come first in ASCII.

Each row is a symbol (role, fault), each symbol a min-plus matrix over the four states of the
pattern: the cost to go from one to another across the row, insertions before it included.
Equal symbols in a row are one run, and a run of n is crossed by the cached powers
M, M^2, M^4, ... that make up n. Costs to go are so known at the ends of runs, from the last to
the first; then the choices are unrolled from the first row on, within a run step by step.

A conversation may hold a third of all rows. Rows are dealt by ranges of (conversation, turn)
and cut into pieces of at most 2^``PIECE_BITS``; a piece of a conversation is one matrix. The
costs to go at the ends of pieces, the state each piece ends in for each state it begins with,
and the state it does begin with then follow from a few numbers for each piece. Only the hash of
a repaired conversation must be taken in one go: its pieces pass one after another through
a task, which holds one of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from hashlib import sha256
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotgrain.llm.ordering import in_order
from lotgrain.llm.rows import written

PIECE_BITS = 12
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
NEVER = 1 << 60

#: States: nothing yet, after system, after user, after assistant. The first and the last may end.
STATES = range(4)
START, SYSTEM, USER, ASSISTANT = STATES
#: What may come next in each state, by role initial.
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: What an inserted or reroled row becomes in each state, and the state behind it.
MADE = (("user", USER), ("user", USER), ("assistant", ASSISTANT), ("user", USER))

#: Faults of a row by rank; the first one counts.
FINE, CUT, BLANK, DUPLICATE = range(4)

Vector = tuple[int, ...]
Matrix = tuple[Vector, ...]
#: Role initial and fault; rows that must go are all the same.
Symbol = tuple[str, int]


def symbol(initial: str, fault: int) -> Symbol:
    return ("", BLANK) if fault in (BLANK, DUPLICATE) else (initial, fault)


def times(a: Matrix, b: Matrix) -> Matrix:
    """The min-plus product."""
    return tuple(tuple(min(row[k] + b[k][j] for k in STATES) for j in STATES) for row in a)


def across(m: Matrix, v: Vector) -> Vector:
    """Costs to go before the rows of ``m``, from those behind them."""
    return tuple(min(a + b for a, b in zip(row, v)) for row in m)


UNIT: Matrix = tuple(tuple(0 if i == j else NEVER for j in STATES) for i in STATES)


def _insertions() -> Matrix:
    rows = []
    for i in STATES:
        row, state, cost = [NEVER] * 4, i, 0
        while row[state] == NEVER:
            row[state] = cost
            state, cost = MADE[state][1], cost + INSERT
        rows.append(tuple(row))
    return tuple(rows)


INSERTIONS = _insertions()
#: Costs to go behind the last row: insertions up to a state that may end.
END: Vector = across(INSERTIONS, (0, NEVER, NEVER, 0))


def options(s: Symbol, state: int) -> list[tuple[str, int, int]]:
    """Letter, cost and next state of what can be done with a row, by letter."""
    initial, fault = s
    found = [("D", DELETE, state)]
    if fault in (FINE, CUT):
        extra = TRUNCATED if fault == CUT else 0
        if initial in NEXT[state]:
            found.append(("K", extra, NEXT[state][initial]))
        found.append(("R", REROLE + extra, MADE[state][1]))
    return found


@cache
def power(s: Symbol, k: int) -> Matrix:
    """The matrix of 2^k rows of a symbol."""
    if k:
        return times(power(s, k - 1), power(s, k - 1))
    step = [[NEVER] * 4 for _ in STATES]
    for i in STATES:
        for _, cost, j in options(s, i):
            step[i][j] = min(step[i][j], cost)
    return times(INSERTIONS, tuple(map(tuple, step)))


def runs(symbols: list[Symbol]) -> list[tuple[Symbol, int]]:
    return [(s, sum(1 for _ in same)) for s, same in groupby(symbols)]


def _bits(n: int) -> Iterator[int]:
    return (k for k in range(n.bit_length()) if n >> k & 1)


def crossed(s: Symbol, n: int, v: Vector) -> Vector:
    """Costs to go before a run of n, from those behind it."""
    for k in _bits(n):
        v = across(power(s, k), v)
    return v


def product(symbols: list[Symbol]) -> Matrix:
    """The matrix of all rows together."""
    m = UNIT
    for s, n in runs(symbols):
        for k in _bits(n):
            m = times(m, power(s, k))
    return m


def unroll(symbols: list[Symbol], end: Vector, state: int, last: bool) -> tuple[str, int, int]:
    """Edits, their cost and the state behind them, given the costs to go behind the last row.

    ``last``: nothing follows, so what is missing there is inserted.
    """
    parts = runs(symbols)
    behind = [end]
    for s, n in reversed(parts):
        behind.append(crossed(s, n, behind[-1]))
    behind.reverse()
    edits, spent = [], 0
    for i, (s, n) in enumerate(parts):
        ahead = [behind[i + 1]]
        for _ in range(n - 1):
            ahead.append(across(power(s, 0), ahead[-1]))
        ahead.append(behind[i])
        for j in range(n, 0, -1):
            here, after = ahead[j], ahead[j - 1]
            while True:
                into = MADE[state][1]
                way = [(x, cost, to) for x, cost, to in options(s, state) if cost + after[to] == here[state]]
                if INSERT + here[into] == here[state] and (not way or way[0][0] > "I"):
                    edits.append("I")
                    spent, state = spent + INSERT, into
                    continue
                letter, cost, state = way[0]
                edits.append(letter)
                spent += cost
                break
    while last and END[state]:
        edits.append("I")
        spent, state = spent + INSERT, MADE[state][1]
    return "".join(edits), spent, state


def repaired(edits: str, rows: list[tuple[str, str]], state: int) -> list[str]:
    """``role:text`` of what the edits make of (role, text) rows."""
    left, out = iter(rows), []
    for letter in edits:
        if letter == "I":
            out.append(MADE[state][0] + ":")
            state = MADE[state][1]
            continue
        role, text = next(left)
        if letter == "K":
            state = NEXT[state][role[:1]]
        elif letter == "R":
            role, state = MADE[state]
        if letter != "D":
            out.append(f"{role}:{text}")
    return out


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copy) after damage by the crc32 of ``conv_id:turn``.

    Nulls are one space, in that key as well as in role and text; conv_id and turn are returned
    as they are. Of 20 remainders 0 drops a row, 1 empties its text, 2 removes ``.!?`` from it,
    3 repeats it and 4 makes it the user's.
    """
    key = F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c else F.lit(":") for c in ("conv_id", "", "turn")])
    lot, text, role = F.crc32(key) % 20, F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    return conversations.withColumn("lot", lot).where("lot != 0").select(
        "conv_id",
        "turn",
        F.when(F.col("lot") == 4, "user").otherwise(role).alias("role"),
        F.when(F.col("lot") == 1, "").when(F.col("lot") == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.when(F.col("lot") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )


def _ordered(damaged: DataFrame) -> DataFrame:
    """Rows in order, with conv, initial, fault (but duplicates) and a hash of role and text, written."""
    bare = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    ends = F.substring(bare, -1, 1).isin(".", "!", "?")
    rows = damaged.select(
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("-")).alias("conv"),
        "turn",
        "role",
        "text",
        "copy",
        F.substring("role", 1, 1).alias("initial"),
        F.when(bare == "", BLANK).when(ends, FINE).otherwise(CUT).alias("fault"),
        F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("print"),
    )
    return in_order(rows, ["conv", "turn", "role", "print", "copy"], "conversation-rows")


def _duplicates(rows: DataFrame, bits: int) -> DataFrame:
    """(piece, at) of rows whose role and text stand in an earlier row of the conversation."""
    first = rows.groupBy("conv", "print").agg(F.min("at").alias("at")).select("at")
    return rows.select("at").join(first, "at", "left_anti").select(F.shiftright("at", bits).alias("piece"), "at")


def _groups(rows: pd.DataFrame, repeated: pd.DataFrame) -> Iterator[tuple[str, pd.DataFrame, list[Symbol], list[int]]]:
    """Conversation, rows, symbols and faults of each conversation in a piece."""
    rows = rows.sort_values("at")
    twice = rows["at"].isin(repeated["at"]) & (rows["fault"] != BLANK)
    rows["fault"] = rows["fault"].mask(twice, DUPLICATE)
    for conv, own in rows.groupby("conv", sort=False):
        faults = own["fault"].tolist()
        yield conv, own, [symbol(i, f) for i, f in zip(own["initial"], faults, strict=True)], faults


_PIECE = "conv string, piece long, blank long, duplicate long, truncated long, illegal long, first string, last string, matrix array<long>"


def _summed(rows: pd.DataFrame, repeated: pd.DataFrame) -> pd.DataFrame:
    out, edge = [], (rows["at"].min(), rows["at"].max())
    for conv, own, symbols, faults in _groups(rows, repeated):
        initials = own["initial"].tolist()
        illegal = sum(pair not in ("su", "ua", "au") for pair in map("".join, zip(initials, initials[1:])))
        # Only the first and the last conversation of a piece can go on in another one.
        cut = own["at"].iloc[0] == edge[0] or own["at"].iloc[-1] == edge[1]
        matrix = [x for row in product(symbols) for x in row] if cut else None
        out.append((conv, rows["piece"].iloc[0], faults.count(BLANK), faults.count(DUPLICATE), faults.count(CUT), illegal, initials[0], initials[-1], matrix))
    return pd.DataFrame(out, columns=["conv", "piece", "blank", "duplicate", "truncated", "illegal", "first", "last", "matrix"])


def _costs(pieces: pd.DataFrame) -> pd.DataFrame:
    """Costs to go at the end of each piece of a conversation."""
    pieces = pieces.sort_values("piece", ascending=False)
    end, ends = END, []
    for m in pieces["matrix"]:
        ends.append(list(end))
        end = across(tuple(tuple(m[4 * i : 4 * i + 4]) for i in STATES), end)
    last = [True] + [False] * (len(ends) - 1)
    return pd.DataFrame({"conv": pieces["conv"].to_numpy(), "piece": pieces["piece"].to_numpy(), "costs": ends, "last": last})


def _states(rows: pd.DataFrame, notes: pd.DataFrame) -> pd.DataFrame:
    """The state behind a piece for each state before it."""
    known = notes[notes["conv"].notna()].set_index("conv")
    out = []
    for conv, _, symbols, _ in _groups(rows, notes[notes["conv"].isna()]):
        if conv in known.index:
            n = known.loc[conv]
            out.append((conv, n["piece"], n["costs"], n["last"], [unroll(symbols, tuple(n["costs"]), s, False)[2] for s in STATES]))
    return pd.DataFrame(out, columns=["conv", "piece", "costs", "last", "ways"])


def _starts(pieces: pd.DataFrame) -> pd.DataFrame:
    """The state in which each piece of a conversation begins."""
    pieces = pieces.sort_values("piece")
    state, states = START, []
    for ways in pieces["ways"]:
        states.append(state)
        state = ways[state]
    return pieces[["conv", "piece", "costs", "last"]].assign(state=states)


_EDITED = "conv string, piece long, whole boolean, audit string, cost long, repaired string, sha256 string"


def _edited(rows: pd.DataFrame, notes: pd.DataFrame) -> pd.DataFrame:
    known = notes[notes["conv"].notna()].set_index("conv")
    out = []
    for conv, own, symbols, _ in _groups(rows, notes[notes["conv"].isna()]):
        whole = conv not in known.index
        n = None if whole else known.loc[conv]
        end, state, last = (END, START, True) if whole else (tuple(n["costs"]), int(n["state"]), bool(n["last"]))
        audit, cost, _ = unroll(symbols, end, state, last)
        lines = repaired(audit, list(zip(own["role"], own["text"], strict=True)), state)
        text = "\n".join(lines) if lines else None
        digest = sha256((text or "").encode("utf-8", "surrogatepass")).hexdigest() if whole else None
        out.append((conv, rows["piece"].iloc[0], whole, audit, cost, None if whole else text, digest))
    return pd.DataFrame(out, columns=["conv", "piece", "whole", "audit", "cost", "repaired", "sha256"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of conversations whose pieces come in order, over any number of batches."""
    schema, now, running, some = pa.schema([("conv", pa.string()), ("sha256", pa.string())]), None, sha256(), False
    for batch in batches:
        done: list[tuple[str, str]] = []
        for conv, text in zip(batch.column("conv").to_pylist(), batch.column("repaired"), strict=True):
            if conv != now:
                if now is not None:
                    done.append((now, running.hexdigest()))
                now, running, some = conv, sha256(), False
            if text.is_valid:
                running.update(b"\n" * some + text.as_py().encode("utf-8", "surrogatepass"))
                some = True
        yield pa.RecordBatch.from_pydict({"conv": [c for c, _ in done], "sha256": [h for _, h in done]}, schema=schema)
    if now is not None:
        yield pa.RecordBatch.from_pydict({"conv": [now], "sha256": [running.hexdigest()]}, schema=schema)


def repair(conversations: DataFrame, bits: int = PIECE_BITS) -> DataFrame:
    """Per conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows are damaged first (``damage``), then stand by turn, null first; rows of one turn by
    role and a hash of their text, so that equal ones are neighbours. Every original conv_id,
    null as well, has a row: zeros, an empty audit and the hash of nothing where no row is left.
    Other columns play no part. ``bits`` sets the size of pieces; the result doesn't depend on it.
    """
    known = conversations.select("conv_id", "turn", "role", "text")
    damaged = damage(known)
    rows = _ordered(damaged).withColumn("piece", F.shiftright("at", bits))
    light = rows.drop("role", "text", "copy", "turn", "print")
    repeated = written(_duplicates(rows, bits), "conversation-duplicates")

    pieces = written(light.groupBy("piece").cogroup(repeated.groupBy("piece")).applyInPandas(_summed, _PIECE), "conversation-pieces")
    several = pieces.groupBy("conv").count().where("count > 1").select("conv")
    cut = pieces.select("conv", "piece", "matrix").join(several, "conv", "left_semi")
    costs = written(cut.groupBy("conv").applyInPandas(_costs, "conv string, piece long, costs array<long>, last boolean"), "conversation-costs")
    notes = repeated.unionByName(costs, allowMissingColumns=True)
    here = light.join(costs.select("piece").distinct(), "piece", "left_semi")
    kind = "conv string, piece long, costs array<long>, last boolean, ways array<int>"
    ways = here.groupBy("piece").cogroup(notes.groupBy("piece")).applyInPandas(_states, kind)
    starts = ways.groupBy("conv").applyInPandas(_starts, "conv string, piece long, costs array<long>, last boolean, state int")
    notes = repeated.unionByName(written(starts, "conversation-starts"), allowMissingColumns=True)
    full = rows.select("conv", "at", "piece", "initial", "fault", "role", "text")
    edited = written(full.groupBy("piece").cogroup(notes.groupBy("piece")).applyInPandas(_edited, _EDITED), "conversation-edits")

    # A row of a piece stands for the border to the piece before it.
    before = F.lag("last").over(Window.partitionBy("conv").orderBy("piece"))
    border = (~F.concat(before, "first").isin("su", "ua", "au")).cast("long")
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")]
    counted = pieces.withColumn("border", F.coalesce(border, F.lit(0))).groupBy("conv").agg(*sums, F.sum(F.col("illegal") + F.col("border")).alias("illegal"))
    turns = rows.groupBy("conv", "turn").agg(F.lit(1).alias("one")).groupBy("conv")
    gaps = turns.agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
    audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "audit"))), lambda x: x["audit"]), "")
    edits = edited.groupBy("conv").agg(F.sum("cost").alias("cost"), audit.alias("audit"))
    parts = edited.where("NOT whole").select("conv", "piece", "repaired").repartition("conv").sortWithinPartitions("conv", "piece")
    hashes = edited.where("whole").select("conv", "sha256").unionAll(parts.select("conv", "repaired").mapInArrow(_hashed, "conv string, sha256 string"))

    ids = known.select("conv_id").distinct().withColumn("conv", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("-")))
    out = ids
    for found in (gaps, counted, edits, hashes):
        out = out.join(found, "conv", "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
