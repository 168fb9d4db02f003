"""Operator 11: repair of conversations by the cheapest edits that give role initials ``(s?(ua)+)?``.

A forward Viterbi pass over four grammar states carries the smallest (cost,
audit) of each: every turn is kept, given another role or deleted, then turns
may be inserted, which closes its layer.  Turns are sorted over the cluster by
(conversation, turn), so a conversation is not tied to one task: one that lies
within a partition is finished there; one that is cut by a partition's border,
or is long, goes on in pieces of bounded size.  A piece is passed from each of
the four states (sixteen costs and audits), the pieces of a conversation are
joined by a fold over these, and each is then written out from the state where
the fold enters it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written

#: Grammar states: nothing yet, after the system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, REPLY = range(4)
NEXT = (USER, USER, REPLY, USER)
INITIALS, ROLES = "?sua", (None, "system", "user", "assistant")
REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5
LEGAL = frozenset(("su", "ua", "au"))
#: White space at the ends of a text.
SPACE = " \t\n\x0b\f\r"

Best = list[tuple[int, str] | None]


class Turn(NamedTuple):
    """Equal turns of one number come together, as ``copies``; none of them: only the conversation's id is known."""

    turn: int | None
    role: str
    text: str
    copies: int
    blank: bool
    cut: bool
    seen: bool = False


def closed(layer: Best) -> Best:
    """The layer with what inserted turns reach; more than two in a row lead back to a state at a higher cost."""
    for target, sources in ((USER, (START, SYSTEM, REPLY)), (REPLY, (USER,))):
        for source in sources:
            if (best := layer[source]) is not None:
                found = (best[0] + INSERT, best[1] + "I")
                if layer[target] is None or found < layer[target]:
                    layer[target] = found
    return layer


def step(layer: Best, turn: Turn) -> Best:
    """The layer after a turn and its copies, which can only be deleted."""
    if not turn.copies:
        return layer
    more, gone = turn.copies - 1, turn.blank or turn.seen
    initial, extra = turn.role[:1], CUT * turn.cut
    out: Best = [None] * 4
    for state, best in enumerate(layer):
        if best is None:
            continue
        cost, audit = best
        ways = [(state, cost + DELETE, "D")]
        if not gone:
            kept = INITIALS[NEXT[state]] == initial
            ways.append((NEXT[state], cost + extra + (0 if kept else REROLE), "K" if kept else "R"))
            if state == START and initial == "s":
                ways.append((SYSTEM, cost + extra, "K"))
        for target, price, edit in ways:
            found = (price + DELETE * more, audit + edit + "D" * more)
            if out[target] is None or found < out[target]:
                out[target] = found
    return closed(out)


def passed(turns: Iterable[Turn], state: int | None = None) -> Best:
    """The last layer, from ``state``, or from the conversation's begin, where turns may be inserted first."""
    layer: Best = [None] * 4
    layer[state or START] = (0, "")
    if state is None:
        closed(layer)
    for turn in turns:
        layer = step(layer, turn)
    return layer


def cheapest(layer: Best) -> tuple[int, str]:
    return min(x for x in (layer[START], layer[REPLY]) if x is not None)


def rendered(turns: Iterable[Turn], state: int, audit: str) -> list[dict]:
    """The repaired turns that the edits of ``audit`` give, from ``state``."""
    rows = ((turn, i) for turn in turns for i in range(turn.copies))
    out = []
    for edit in audit:
        turn = next(rows)[0] if edit != "I" else None
        if edit == "D":
            continue
        state = SYSTEM if edit == "K" and turn.role[0] == "s" else NEXT[state]
        out.append({"role": turn.role if edit == "K" else ROLES[state], "text": turn.text if turn else ""})
    return out


def counted(turns: Iterable[Turn], turn_before: int | None = None, initial_before: str | None = None) -> dict[str, int]:
    """Faults of the turns, and gaps and illegal neighbours, also towards what comes before."""
    out = dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal"), 0)
    for turn in turns:
        if not turn.copies:
            continue
        if turn.turn is not None:
            if turn_before is not None:
                out["gaps"] += max(0, turn.turn - turn_before - 1)
            turn_before = turn.turn
        initial = turn.role[:1]
        out["illegal"] += (initial_before is not None and initial_before + initial not in LEGAL) + turn.copies - 1
        initial_before = initial
        again = turn.copies if turn.seen else turn.copies - 1
        if turn.blank:
            out["blank"] += turn.copies
        else:
            out["duplicate"] += again
            out["truncated"] += turn.cut and not turn.seen
    return out


_TURN = "turn bigint, role string, text string, copies bigint, blank boolean, cut boolean"
_COUNTS = "gaps bigint, blank_turns bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired array<struct<role:string,text:string>>"
_KEPT = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_COUNT_FIELDS = [("gaps", pa.int64()), ("blank_turns", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired", _KEPT)]
_TURN_FIELDS = [("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("copies", pa.int64()), ("blank", pa.bool_()), ("cut", pa.bool_())]


def _report(turns: list[Turn], state: int, cost: int, audit: str, turn_before: int | None = None, initial_before: str | None = None) -> dict:
    found = counted(turns, turn_before, initial_before)
    found["blank_turns"] = found.pop("blank")
    return found | {"cost": cost, "audit": audit, "repaired": rendered(turns, state, audit)}


def _batches(rows: Iterator[dict], schema: pa.Schema, most: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches of rows of about ``most`` bytes of text, by the rows' own ``size``."""
    held, size = [], 0
    for row in rows:
        size += row.pop("size", 64)
        held.append(row)
        if size >= most or len(held) >= 4096:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _first_pass(key: pa.DataType, turns: int, size: int):
    """Finishes what surely lies within the partition, and cuts the rest into pieces of at most ``turns`` rows or about ``size`` bytes."""
    schema = pa.schema([("conv", key), ("open", pa.bool_()), ("part", pa.int64()), ("chunk", pa.int64()), ("place", pa.int64()), *_TURN_FIELDS, *_COUNT_FIELDS])

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def rows() -> Iterator[dict]:
            held: list[Turn] = []
            conv, conversations, chunk, long, seen, weight = None, 0, 0, True, set(), 0

            def cut_off() -> Iterator[dict]:
                for place, turn in enumerate(held):
                    yield {"conv": conv, "open": True, "part": part, "chunk": chunk, "place": place, **turn._replace(seen=False)._asdict(), "size": len(turn.text or "") + 64}

            for batch in arrow:
                for row in batch.to_pylist():
                    if not conversations or row["conv"] != conv:
                        if held and not long:
                            yield {"conv": conv, "open": False, "size": weight, **_report(held, START, *cheapest(passed(held)))}
                        elif held:
                            yield from cut_off()
                            chunk += 1
                        # the first conversation of a partition may have begun in the one before
                        conversations, conv, long, held, seen, weight = conversations + 1, row["conv"], not conversations, [], set(), 0
                    value = (row["role"], row["text"])
                    held.append(Turn(row["turn"], row["role"], row["text"], row["copies"], row["blank"], row["cut"], value in seen))
                    seen.add(value)
                    weight += len(row["text"] or "") + 64
                    if len(held) >= turns or weight >= size:
                        long = True
                        yield from cut_off()
                        held, seen, weight, chunk = [], set(), 0, chunk + 1
            yield from cut_off()  # the last one may go on in the next partition

        return _batches(({k: v for k, v in row.items() if k != "seen"} for row in rows()), schema, size)

    return run


def _turns(row: dict) -> list[Turn]:
    return [Turn(t["turn"], t["role"], t["text"], t["copies"], t["blank"], t["cut"], t["seen"]) for t in row["turns"]]


def _summaries(key: pa.DataType):
    """Of each piece the sixteen (cost, audit), its last turn number and the initials at its ends."""
    schema = pa.schema([
        ("conv", key), ("part", pa.int64()), ("chunk", pa.int64()), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string())), ("last_turn", pa.int64()), ("last_initial", pa.string()),
    ])

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for batch in arrow:
                for row in batch.to_pylist():
                    turns = _turns(row)
                    ways = [way for state in range(4) for way in passed(turns, state)]
                    real = [t for t in turns if t.copies]
                    yield {
                        "conv": row["conv"], "part": row["part"], "chunk": row["chunk"], "costs": [w and w[0] for w in ways], "audits": [w and w[1] for w in ways],
                        "last_turn": max((t.turn for t in real if t.turn is not None), default=None), "last_initial": real[-1].role[:1] if real else None, "size": 16 * len(turns),
                    }

        return _batches(rows(), schema, 1 << 20)

    return run


def joined(pieces: Iterable[tuple[list[int | None], list[str | None]]]) -> tuple[int, list[tuple[int, int]]]:
    """Inserts before the first turn, and of each piece the states where the cheapest whole enters and leaves it.

    The audits so far are not carried but ranked: without the inserts at their
    end, which are counted apart, none is another's beginning, as all have an
    edit for every turn so far.  So ranks, then inserts and the piece's own
    audit, order the whole audits.
    """
    layer: list[tuple[int, int, int] | None] = [None if x is None else (x[0], 0, len(x[1])) for x in passed(())]
    lead = [x and x[2] for x in layer]
    back: list[list[int | None]] = []
    for costs, audits in pieces:
        found: list[tuple | None] = [None] * 4
        for state, held in enumerate(layer):
            for target in range(4):
                at = 4 * state + target
                if held is not None and costs[at] is not None:
                    way = (held[0] + costs[at], held[1], "I" * held[2] + audits[at], state)
                    if found[target] is None or way[:3] < found[target][:3]:
                        found[target] = way
        order = sorted({(w[1], w[2].rstrip("I")) for w in found if w})
        back.append([w and w[3] for w in found])
        layer = [w and (w[0], order.index((w[1], w[2].rstrip("I"))), len(w[2]) - len(w[2].rstrip("I"))) for w in found]
    _, _, _, state = min((*layer[s][:2], "I" * layer[s][2], s) for s in (START, REPLY) if layer[s] is not None)
    ways = []
    for sources in reversed(back):
        ways.append((sources[state], state))
        state = sources[state]
    return lead[state], ways[::-1]


def _choices():
    schema = pa.schema([("part", pa.int64()), ("chunk", pa.int64()), ("piece", pa.int64()), ("way", pa.int32()), ("lead", pa.int32()), ("turn_before", pa.int64()), ("initial_before", pa.string())])

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def conversations() -> Iterator[tuple[list, list]]:
            places: list[tuple] = []
            conv = None

            def summaries() -> Iterator[tuple[list, list]]:
                """The pieces of the conversation at hand; stops at the next one's first."""
                nonlocal row, conv
                while row is not None and row["conv"] == conv:
                    places.append((row["part"], row["chunk"], row["last_turn"], row["last_initial"]))
                    yield row["costs"], row["audits"]
                    row = next(source, None)

            source = (row for batch in arrow for row in batch.to_pylist())
            row = next(source, None)
            while row is not None:
                conv, places = row["conv"], []
                yield joined(summaries()), places

        def rows() -> Iterator[dict]:
            for (lead, ways), places in conversations():
                turn = initial = None
                for n, ((a, b), (part, chunk, last_turn, last_initial)) in enumerate(zip(ways, places, strict=True)):
                    yield {"part": part, "chunk": chunk, "piece": n, "way": 4 * a + b, "lead": 0 if n else lead, "turn_before": turn, "initial_before": initial}
                    turn = turn if last_turn is None else last_turn
                    initial = initial if last_initial is None else last_initial

        return _batches(rows(), schema, 1 << 20)

    return run


def _second_pass(key: pa.DataType):
    schema = pa.schema([("conv", key), ("piece", pa.int64()), *_COUNT_FIELDS])

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for batch in arrow:
                for row in batch.to_pylist():
                    turns, lead = _turns(row), row["lead"]
                    state = START if not row["piece"] else row["way"] // 4
                    found = _report(turns, state, row["costs"][row["way"]] + INSERT * lead, "I" * lead + row["audits"][row["way"]], row["turn_before"], row["initial_before"])
                    yield {"conv": row["conv"], "piece": row["piece"], "size": sum(len(t.text or "") + 64 for t in turns), **found}

        return _batches(rows(), schema, 1 << 20)

    return run


def damaged(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", by: int = 20) -> DataFrame:
    """The turns with faults set by crc32(``conv:turn``) modulo ``by``, as (conv, turn, role, text, copies); nulls count as one space.

    0 drops the turn (no copies), 1 empties its text, 2 takes ``.!?`` out of
    it, 3 repeats it, 4 gives it to the user.
    """
    nothing = F.lit(" ")
    name = F.concat(F.coalesce(F.col(conv).cast("string"), nothing), F.lit(":"), F.coalesce(F.col(turn).cast("string"), nothing))
    fault = F.crc32(name.cast("binary")) % by
    plain, own = F.coalesce(F.col(text).cast("string"), nothing), F.coalesce(F.col(role).cast("string"), nothing)
    return turns.select(
        F.col(conv).alias("conv"), F.col(turn).cast("bigint").alias("turn"), F.when(fault == 4, "user").otherwise(own).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.translate(plain, ".!?", "")).otherwise(plain).alias("text"), F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).cast("bigint").alias("copies"),
    )


def repair(turns: DataFrame, *, piece_turns: int = 1024, piece_bytes: int = 1 << 20) -> DataFrame:
    """Per conversation its counts, cost, audit and ``repaired`` turns; a long one in several rows.

    ``turns``: (conv, turn, role, text, copies) with ``turn`` integral; other
    columns are ignored.  Rows without copies only say that the conversation
    exists.  Turns follow their number, nulls first; of equal numbers the role,
    then the text decides; equal rows are copies of one another, all after the
    first duplicates.  Null roles and texts count as one space; null
    conversation ids are one conversation.  A conversation without turns has
    zero counts and an empty audit.  Of a conversation in ``pieces`` (numbered
    by ``piece``) counts and costs add up, audits and turns follow one another.
    """
    space = F.lit(" ")
    slim = turns.select(
        "conv", F.when(F.col("copies") > 0, F.col("turn")).alias("turn"), F.when(F.col("copies") > 0, F.coalesce("role", space)).alias("role"),
        F.when(F.col("copies") > 0, F.coalesce("text", space)).alias("text"), F.when(F.col("copies") > 0, F.col("copies")).otherwise(0).alias("copies"),
    )
    key = slim.schema["conv"].dataType.simpleString()
    arrow_key = _arrow_type(key)
    bare = F.trim(F.col("text"), F.lit(SPACE))
    rows = (
        slim.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
        .withColumns({"blank": F.coalesce(bare == "", F.lit(False)), "cut": F.coalesce((bare != "") & ~F.right(bare, F.lit(1)).isin(".", "!", "?"), F.lit(False))})
        .repartitionByRange("conv", "turn", "role", F.left("text", F.lit(32))).sortWithinPartitions("conv", "turn", "role", "text")
    )
    first = written(rows.mapInArrow(_first_pass(arrow_key, piece_turns, piece_bytes), f"conv {key}, open boolean, part bigint, chunk bigint, place bigint, {_TURN}, {_COUNTS}"), "turns")
    whole = first.where("not open").select("conv", F.lit(0).cast("bigint").alias("piece"), F.lit(False).alias("pieces"), *_count_names())

    cut = first.where("open").select("conv", "part", "chunk", "place", "turn", "role", "text", "copies", "blank", "cut", F.sha2("text", 256).alias("digest"))
    at = F.struct("part", "chunk", "place")
    again = cut.where("copies > 0 and not blank").groupBy("conv", "role", "digest").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1").alias("again")
    same = F.expr("cut.conv <=> again.conv and cut.role = again.role and cut.digest = again.digest")
    marked = cut.alias("cut").join(again, same, "left").select("cut.*", F.coalesce(F.col("first") < F.struct("cut.part", "cut.chunk", "cut.place"), F.lit(False)).alias("seen"))
    packed = written(marked.groupBy("conv", "part", "chunk").agg(F.array_sort(F.collect_list(F.struct("place", "turn", "role", "text", "copies", "blank", "cut", "seen"))).alias("turns")), "pieces")
    summary = written(packed.mapInArrow(_summaries(arrow_key), f"conv {key}, part bigint, chunk bigint, costs array<bigint>, audits array<string>, last_turn bigint, last_initial string"), "ways")
    chosen = summary.repartition("conv").sortWithinPartitions("conv", "part", "chunk").mapInArrow(
        _choices(), "part bigint, chunk bigint, piece bigint, way int, lead int, turn_before bigint, initial_before string"
    )
    on = ["part", "chunk"]
    full = packed.join(summary.select(*on, "costs", "audits"), on).join(chosen, on)
    cut_up = full.mapInArrow(_second_pass(arrow_key), f"conv {key}, piece bigint, {_COUNTS}").select("conv", "piece", F.lit(True).alias("pieces"), *_count_names())
    return whole.unionByName(cut_up)


def _count_names() -> list:
    return ["gaps", F.col("blank_turns").alias("blank"), "duplicate", "truncated", "illegal", "cost", "audit", "repaired"]


def _arrow_type(kind: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_type(_parse_datatype_string(kind))


def digests(found: DataFrame) -> DataFrame:
    """One row a conversation, with the SHA-256 of its repaired ``role:text`` lines instead of the turns.

    A hash is sequential, so the pieces of a long conversation pass one task,
    in order and one at a time.
    """
    key = found.schema["conv"].dataType.simpleString()
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    lines = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    whole = found.where("not pieces").select("conv", *names, "audit", F.sha2(lines, 256).alias("repaired_sha256"))
    schema = pa.schema([("conv", _arrow_type(key)), *[(n, pa.int64()) for n in names], ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def fold(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            total, hashed, audits, empty = None, None, [], True
            for batch in arrow:
                for row in batch.to_pylist():
                    if not row["piece"]:
                        if total is not None:
                            yield total | {"audit": "".join(audits), "repaired_sha256": hashed.hexdigest(), "size": 64 + sum(map(len, audits))}
                        total, hashed, audits, empty = {"conv": row["conv"], **dict.fromkeys(names, 0)}, hashlib.sha256(), [], True
                    for n in names:
                        total[n] += row[n]
                    audits.append(row["audit"])
                    if row["lines"] is not None:
                        hashed.update((row["lines"] if empty else "\n" + row["lines"]).encode())
                        empty = False
            if total is not None:
                yield total | {"audit": "".join(audits), "repaired_sha256": hashed.hexdigest()}

        return _batches(rows(), schema, 1 << 20)

    cut = found.where("pieces").select("conv", "piece", *names, "audit", F.when(F.size("repaired") > 0, lines).alias("lines"))
    folded = cut.repartition("conv").sortWithinPartitions("conv", "piece").mapInArrow(fold, f"conv {key}, " + ", ".join(f"{n} bigint" for n in names) + ", audit string, repaired_sha256 string")
    return whole.unionByName(folded)
