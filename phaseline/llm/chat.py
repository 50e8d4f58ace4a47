"""Conversations as training windows under a token budget.

* Turns are ordered by a range sort over all conversations, so a long one lies in many
  partitions.  Each partition adds up its turns' tokens; only a conversation that goes
  on from the partition before needs a sum from outside, one row a partition.
* These prefix sums cut a conversation into segments of ``budget * SEGMENT`` tokens,
  each a group of its own.  Inside, windows are spans of whole turns, as many as
  fit: the leading system turn is part of every window, the last turns before the
  span are repeated as history up to ``history`` tokens, and the rest are new.  A
  segment gets the turns that may be its first windows' history with it.
* The loss mask of a window covers the new assistant texts only, so each assistant text
  is learnt once, however often it is repeated.

The template marks turns with control strings.  Inside texts and role names a backslash goes
behind the first character of whatever would read as one, and of whatever already
holds such backslashes there, so taking one away restores every text.

Reading back parses windows, drops what is repeated and checks nothing against the
input.  A digest over a conversation is a chain; conversations of one window are
digested where they are parsed, the windows of the others stream in order through
one task a conversation, with one window in memory.

Defined cases: a null text or role is empty; a null conversation id is one
conversation; turns are ordered by number (null first), then role, then the text's
hash, then the text, so repeated rows are turns of their own; a turn over the budget is a
window of its own, whole and without history, over the budget; a leading system
turn over half of the budget is not repeated; other columns are ignored, whatever
their names; no rows give no windows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

BUDGET, HISTORY = 2048, 512
#: Budgets that a segment holds.
SEGMENT = 64

#: Control strings of the template; any other role is named by a ROLE mark.
OPEN, CLOSE = "<s>", "</s>"
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("[ANS]", "</s>")}
ROLE = ("[ROLE]", "[/ROLE]", "[/TURN]")
CONTROL = sorted({OPEN, CLOSE, *ROLE, *(m for pair in MARKS.values() for m in pair)})
_LIKE = re.compile("|".join(rf"{re.escape(c[0])}\\*{re.escape(c[1:])}" for c in CONTROL))
_ESCAPED = re.compile("|".join(rf"{re.escape(c[0])}\\+{re.escape(c[1:])}" for c in CONTROL))
_TURN = re.compile("|".join(re.escape(m[0]) for m in (*MARKS.values(), ROLE)))


def escaped(text: str) -> str:
    """A text without control strings; ``restored`` undoes it."""
    return _LIKE.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def restored(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][0] + m[0][2:], text)


def formatted(role: str, text: str) -> tuple[str, int, int]:
    """A turn in the template, and where its text stands in it."""
    begin, end = MARKS.get(role, (None, None))
    if begin is None:
        begin, end = f"{ROLE[0]}{escaped(role)}{ROLE[1]}", ROLE[2]
    body = escaped(text)
    return f"{begin}{body}{end}", len(begin), len(begin) + len(body)


def parse(window: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a window."""
    out, at = [], len(OPEN)
    names = {m[0]: role for role, m in MARKS.items()}
    while at < len(window):
        m = _TURN.match(window, at)
        if m is None:
            raise ValueError("a window does not follow the template")
        at = m.end()
        if m[0] == ROLE[0]:
            to = window.index(ROLE[1], at)
            role, at, end = restored(window[at:to]), to + len(ROLE[1]), ROLE[2]
        else:
            role = names[m[0]]
            end = MARKS[role][1]
        to = window.index(end, at)
        out.append((role, restored(window[at:to])))
        at = to + len(end)
    return out


# --------------------------------------------------------------------------
# turns in order, with prefix sums of their tokens


def _counter(ranks: dict[bytes, int], pattern: str):
    """Tokens of a text; never none, so that a segment's turns are bounded by its tokens."""
    import tiktoken

    encode = tiktoken.Encoding("turns", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    blank = re.compile(r"\s{5000}")

    def count(text: str) -> int:
        # the library's splitter gives up on very long runs of blanks; each of their pieces counts
        return max(1, sum(len(encode(x)) for x in re.split(r"(?<=\s{1000})(?=\s)", text)) if blank.search(text) else len(encode(text)))

    return count


def ordered_turns(df: DataFrame, ranks: dict[bytes, int], pattern: str, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, role, text, tokens, part, row, before): all turns in order; ``before`` sums the tokens of the conversation's turns before, ``(part, row)`` is the order."""
    shared = df.sparkSession.sparkContext.broadcast(ranks)  # bounded by the vocabulary
    src = df.select(F.col(conv).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    src = src.withColumn("h", F.xxhash64("text")).withColumn("tie", F.monotonically_increasing_id())  # ties of everything are alike, so any order of them will do
    schema = "conv long, role string, text string, tokens long, part long, row long, inner long"

    def number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, row, last, total = TaskContext.get().partitionId(), 0, ..., 0
        count = _counter(shared.value, pattern)
        for b in batches:
            convs, roles, texts = (b.column(i).to_pylist() for i in (0, 2, 3))
            tokens, inner = [], []
            for c, r, x in zip(convs, roles, texts):
                if c != last:
                    last, total = c, 0
                tokens.append(count(formatted(r, x)[0]))
                inner.append(total)
                total += tokens[-1]
            n = len(b)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(tokens, pa.int64()), pa.array([part] * n, pa.int64()), pa.array(range(row, row + n), pa.int64()), pa.array(inner, pa.int64())], ["conv", "role", "text", "tokens", "part", "row", "inner"])
            row += n

    ranged = src.repartitionByRange("conv", "turn", "role", "h", "tie").sortWithinPartitions("conv", "turn", "role", "h", "text", "tie").drop("h", "tie")
    rows = C.staged(ranged.mapInArrow(number, schema))
    sums = rows.groupBy("part", "conv").agg(F.sum("tokens").alias("t"), F.min("row").alias("first"))
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a conversation has a row a partition at most
    carry = sums.withColumn("base", F.sum("t").over(earlier)).where("first = 0 and base is not null").select("part", F.col("conv").alias("on"), "base")
    d = rows.join(F.broadcast(C.staged(carry)), "part", "left")  # a row a partition at most
    goes_on = F.col("base").isNotNull() & F.col("conv").eqNullSafe(F.col("on"))
    return d.withColumn("before", F.col("inner") + F.when(goes_on, F.col("base")).otherwise(0)).drop("inner", "on", "base")


# --------------------------------------------------------------------------
# windows


def spans(tokens: np.ndarray, own: np.ndarray, fixed: int, budget: int, history: int) -> list[tuple[int, int, int]]:
    """(first history turn, first new turn, turn after) of each window.

    ``own`` is the range of turns to be learnt; those before it may only be history.  By
    prefix sums: the longest history that fits, then as many new turns as fit.
    """
    total = np.concatenate([[0], np.cumsum(tokens)])
    at, stop, out = int(own[0]), int(own[1]), []
    while at < stop:
        back = int(np.searchsorted(total, total[at] - history, "left"))
        room = budget - fixed
        if total[at + 1] - total[back] > room:  # the turn goes before its history
            back = min(at, int(np.searchsorted(total, total[at + 1] - room, "left")))
        to = max(at + 1, min(stop, int(np.searchsorted(total, total[back] + room, "right")) - 1))
        out.append((back, at, to))
        at = to
    return out


_WINDOW = "conv_id long, segment long, window int, only boolean, text string, starts array<int>, ends array<int>, n_system int, n_history int, n_tokens long"


def windows(df: DataFrame, ranks: dict[bytes, int], pattern: str, budget: int = BUDGET, history: int = HISTORY, segment: int = SEGMENT, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Formatted windows, stored: their text, loss mask (code points, end exclusive), and how many turns they repeat.

    ``only`` says that a window is its conversation's only one for sure; ``(segment, window)`` is their order.
    """
    if not 0 <= history < budget:
        raise ValueError("history must be less than the budget")
    long, opening = budget * segment, _counter(ranks, pattern)(OPEN)
    turns = ordered_turns(df, ranks, pattern, conv, turn, role, text)
    own = turns.select("conv", F.expr(f"before div {long}").alias("segment"), "role", "text", "tokens", "part", "row", "before", F.lit(1).alias("kind"))
    # the turns that the next segment's first window may repeat
    near = own.where(f"before >= (segment + 1) * {long} - {history} and tokens <= {history}").withColumn("segment", F.col("segment") + 1).withColumn("kind", F.lit(0))
    # the leading system turn goes to each later segment
    lead = turns.where("before = 0 and role = 'system'").where(f"tokens * 2 <= {budget}").select(F.col("conv").alias("c"), "role", "text", "tokens", "part", "row", "before")
    later = own.where("segment > 0").select("conv", "segment").distinct()
    lead = later.join(lead, F.col("conv").eqNullSafe(F.col("c"))).select("conv", "segment", "role", "text", "tokens", "part", "row", "before", F.lit(-1).alias("kind"))

    def cut(t: pa.Table) -> pa.Table:
        t = t.sort_by([("kind", "ascending"), ("part", "ascending"), ("row", "ascending")])
        kind, tokens, before = (C.np_col(t, c) for c in ("kind", "tokens", "before"))
        roles, texts = t.column("role").to_pylist(), t.column("text").to_pylist()
        conv, seg = t.column("conv")[0].as_py(), t.column("segment")[0].as_py()
        first = int(np.searchsorted(kind, 1))
        if first == len(kind):  # history for a segment in which no turn starts
            return pa.table([pa.array([], f.type) for f in out_schema], schema=out_schema)
        system = 0 if kind[0] == -1 or (seg == 0 and before[first] == 0 and roles[first] == "system" and 2 * tokens[first] <= budget) else None
        fixed = opening + (int(tokens[0]) if system is not None else 0)
        low = int(np.searchsorted(kind, 0))  # turns from here on are history or new; the copied system turn is neither
        low += system is not None and kind[0] == 1  # nor is the system turn itself in later windows
        # history must lead up to the first new turn without a gap
        for i in range(first - 1, low - 1, -1):
            if before[i] + tokens[i] != before[i + 1]:
                low = i + 1
                break
        body = np.arange(low, len(kind))
        own = (max(first - low, 0), len(body))
        cuts = spans(tokens[body], own, fixed, budget, history) if len(body) else [(0, 0, 0)]
        ended = before[-1] + tokens[-1] < (seg + 1) * long  # else another segment may follow
        made = []
        for w, (back, at, to) in enumerate(cuts):
            pieces, starts, ends, size = [OPEN], [], [], len(OPEN)
            for place, i in enumerate([*([0] if system is not None else []), *body[back:to]]):
                x, a, b = formatted(roles[i], texts[i])
                new = place - (system is not None) >= at - back or (system is not None and place == 0 and kind[0] == 1 and w == 0)
                if new and roles[i] == "assistant":
                    starts.append(size + a), ends.append(size + b)
                pieces.append(x)
                size += len(x)
            again = int(system is not None and not (kind[0] == 1 and w == 0))
            made.append((conv, seg, w, bool(seg == 0 and len(cuts) == 1 and ended), "".join(pieces), starts, ends, again, at - back, fixed + int(tokens[body[back:to]].sum())))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*made), out_schema)], schema=out_schema)

    ints = pa.list_(pa.int32())
    out_schema = pa.schema([("conv_id", pa.int64()), ("segment", pa.int64()), ("window", pa.int32()), ("only", pa.bool_()), ("text", pa.string()), ("starts", ints), ("ends", ints), ("n_system", pa.int32()), ("n_history", pa.int32()), ("n_tokens", pa.int64())])
    rows = own.unionByName(near).unionByName(lead)
    return C.staged(rows.groupBy("conv", "segment").applyInArrow(cut, _WINDOW))


# --------------------------------------------------------------------------
# reading back

_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"


def digests(made: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows) of each conversation, from its windows alone."""
    names = [c.split(" ")[0] for c in _DIGEST.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    read_schema = "conv_id long, segment long, window int, turns long, said binary, learnt string, chars long"

    def read(text: str, starts: list, ends: list, n_system: int, n_history: int) -> tuple[int, bytes, str, int]:
        turns = parse(text)
        new = turns[n_system + n_history :]
        return len(new), "".join(f"{r}\n{x}\n" for r, x in new).encode(), "".join(restored(text[a:b]) for a, b in zip(starts, ends)), len(text)

    def ended(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    def single(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for conv, *w in zip(*(b.column(i).to_pylist() for i in range(6))):
                n, said, learnt, chars = read(*w)
                rows.append((conv, n, hashlib.sha256(said).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), chars, 1))
            yield ended(rows)

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [read(*w) for w in zip(*(b.column(i).to_pylist() for i in range(3, 8)))]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *(pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.string(), pa.int64())))], ["conv_id", "segment", "window", "turns", "said", "learnt", "chars"])

    def chain(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = ..., None

        def done() -> tuple:
            n, said, loss, learnt, chars, count = state
            return (last, n, said.hexdigest(), loss, learnt.hexdigest(), chars, count)

        for b in batches:
            rows = []
            for conv, n, said, learnt, chars in zip(*(b.column(i).to_pylist() for i in (0, 3, 4, 5, 6))):
                if conv != last or state is None:
                    if state is not None:
                        rows.append(done())
                    last, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                state[1].update(said), state[3].update(learnt.encode())
                for i, v in ((0, n), (2, len(learnt)), (4, chars), (5, 1)):
                    state[i] += v
            if rows:
                yield ended(rows)
        if state is not None:
            yield ended([done()])

    columns = ["text", "starts", "ends", "n_system", "n_history"]
    short = made.where("only").select("conv_id", *columns).mapInArrow(single, _DIGEST)
    parts = made.where("not only").select("conv_id", "segment", "window", *columns).mapInArrow(each, read_schema)
    return short.unionByName(parts.repartition("conv_id").sortWithinPartitions("conv_id", "segment", "window").mapInArrow(chain, _DIGEST))
