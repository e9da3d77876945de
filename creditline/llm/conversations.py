"""Conversation structure repair by rank-convergence parallel Viterbi.

A conversation's rows, in order, are edited at least cost into a sequence of role
initials ``(s?(ua)+)?``.  The automaton has four states (empty, after s, after u,
after a); the Viterbi recurrence runs backwards over vectors of four costs-to-go.

Rows are range partitioned by (conversation, turn, ...), so a conversation of any
length is cut into chunks that lie in successive tasks.  A conversation that lies in
one chunk is solved there.  The chunks of the others start from a speculative cost
vector at their end.  Fix-up passes give each chunk the start vector of the chunk
after it and run those again whose vector differs by more than a constant; a constant
moves all costs alike and changes no choice.  Conversations soon force the vectors to
rank one, so few passes run few chunks.  Rows that have to be deleted leave a closed
vector as it is but for a constant, so chunks without any other row are passed over
and can't hold up the passes.

With the stitched vectors each chunk is traced forwards from every state that it can
start in, taking the ASCII-least edit that keeps the least cost; the chunks' traces are
then strung together.  This last step, and the digest, follow one conversation in order,
as SHA-256 needs; they stream, and hold no more than a chunk.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditline.llm.common import stored

#: Rows (other than those to be deleted) of a chunk, and characters of their texts.
CHUNK_ROWS = 4096
CHUNK_CHARS = 4_000_000
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
#: Costs-to-go at the end of a conversation, by state: empty, after s, after u, after a.
END = (0, 4, 2, 0)
#: State after a kept row by (state, class of the role's initial s, u, a, other); -1: not allowed.
KEEP_TO = ((1, 2, -1, -1), (-1, 2, -1, -1), (-1, -1, 3, -1), (-1, 2, -1, -1))
#: State after an inserted or rerolled row: user, but assistant after user.
NEXT = (2, 2, 3, 2)
ROLE = {2: "user", 3: "assistant"}
_INF = 1 << 60
_CLASS = {"s": 0, "u": 1, "a": 2}
_SOLID = re.compile(r"[^\x20\x09-\x0D]")
_LAST = re.compile(r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\Z")

COUNTS = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def closed(r0: int, r1: int, r2: int, r3: int) -> tuple[int, int, int, int]:
    """Costs-to-go with insertions before the next row."""
    b2, b3 = min(r2, r3 + INSERT), min(r3, r2 + INSERT)
    return min(r0, b2 + INSERT), min(r1, b2 + INSERT), b2, b3


def back(code: int, b: tuple[int, ...]) -> tuple[int, int, int, int]:
    """Costs-to-go before a row from those after it.  code: class of the initial, +4 truncated, +8 to be deleted."""
    if code & 8:
        return closed(b[0] + DELETE, b[1] + DELETE, b[2] + DELETE, b[3] + DELETE)
    extra, out = (TRUNCATED if code & 4 else 0), []
    for q in range(4):
        k = KEEP_TO[q][code & 3]
        best = min(b[q] + DELETE, b[NEXT[q]] + REROLE + extra)
        out.append(min(best, b[k] + extra) if k >= 0 else best)
    return closed(*out)


def sweep(codes: bytes, end: tuple[int, ...]) -> list[tuple[int, ...]]:
    """Cost vectors before each row and after the last, from the vector after the last."""
    out = [tuple(end)]
    for c in reversed(codes):
        out.append(back(c, out[-1]))
    return out[::-1]


def start_vector(codes: bytes, end: tuple[int, ...]) -> tuple[int, ...]:
    b = tuple(end)
    for c in reversed(codes):
        b = back(c, b)
    return b


def trace(codes: bytes, costs: list[tuple[int, ...]], q: int) -> tuple[str, int, int]:
    """(edits' initials, state at the end, cost) of the ASCII-least cheapest edits of a chunk from state
    ``q``; insertions after its last row are left to what follows."""
    out, cost, i = [], 0, 0
    while i < len(codes):
        c, here, after = codes[i], costs[i], costs[i + 1]
        if here[q] == after[q] + DELETE:
            out.append("D")
            cost += DELETE
            i += 1
            continue
        if here[q] == here[NEXT[q]] + INSERT:
            out.append("I")
            cost += INSERT
            q = NEXT[q]
            continue
        extra, k = (TRUNCATED if c & 4 else 0), KEEP_TO[q][c & 3]
        if k >= 0 and here[q] == after[k] + extra:
            out.append("K")
            cost, q = cost + extra, k
        else:
            out.append("R")
            cost, q = cost + REROLE + extra, NEXT[q]
        i += 1
    return "".join(out), q, cost


def closing(q: int) -> str:
    """Insertions that end a conversation in this state."""
    return "I" * (END[q] // INSERT)


def lines(audit: str, q: int, roles: list[str], texts: list[str], forced: bytes) -> Iterator[str]:
    """The repaired rows that the edits of a chunk from state ``q`` give; roles and texts are those of
    the rows that need not be deleted."""
    row = at = 0
    for e in audit:
        if e == "I":
            q = NEXT[q]
            yield f"{ROLE[q]}:"
            continue
        if forced[row] & 8:
            row += 1
            continue
        if e == "K":
            q = KEEP_TO[q][forced[row] & 3]
            yield f"{roles[at]}:{texts[at]}"
        elif e == "R":
            q = NEXT[q]
            yield f"{ROLE[q]}:{texts[at]}"
        row, at = row + 1, at + 1


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (nulls of the last two: one space), copies of every row: by
    crc32(``conv_id:turn``) % 20, 0 drops it (0 copies), 1 empties the text, 2 removes its ``[.!?]``, 3 repeats
    it, 4 sets the role to user."""
    def shown(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    h = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    rows = conversations.select("conv_id", F.col("turn").cast("bigint").alias("turn"), shown("role").alias("role"), shown("text").alias("text"), h.alias("h"))
    return rows.select(
        "conv_id",
        F.when(F.col("h") != 0, F.col("turn")).alias("turn"),
        F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("h").isin(0, 1), "").when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("h") == 0, 0).when(F.col("h") == 3, 2).otherwise(1).alias("copies"),
    )


def _ordered(rows: DataFrame) -> DataFrame:
    """Distinct rows with their copies and whether an equal row of an earlier turn exists, range partitioned in order."""
    grouped = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").cast("bigint").alias("copies"))
    content = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))
    grouped = stored(grouped.withColumn("content", content), "turns")
    # nulls first: a null turn is before all others
    place = F.struct(F.col("turn").isNotNull().alias("some"), "turn")
    first = grouped.where("copies > 0").groupBy("conv_id", "content").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("m")).where("m > 1")
    first = first.select(F.col("conv_id").alias("_c"), F.col("content").alias("_k"), "first")
    both = grouped.join(first, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("content") == F.col("_k")), "left")
    later = F.coalesce(F.col("first") < place, F.lit(False))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"]
    return both.select("conv_id", "turn", "role", "text", "copies", later.alias("later")).repartitionByRange(*order).sortWithinPartitions(*order)


def _chunks(rows: DataFrame, id_type: str, chunk_rows: int) -> DataFrame:
    """Chunks of conversations: (part, chunk) in the order of a conversation; whole: it surely lies in this chunk alone."""
    schema = (f"conv_id {id_type}, part int, chunk int, whole boolean, codes binary, roles array<string>, texts array<string>, "
              "first_turn bigint, last_turn bigint, turns bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, kind = TaskContext.get().partitionId(), [], None
        cur: dict | None = None
        n = 0

        def fresh(conv) -> dict:
            return {"conv_id": conv, "codes": bytearray(), "roles": [], "texts": [], "chars": 0, "first_turn": None, "last_turn": None,
                    "turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}

        def close(d: dict, whole: bool) -> None:
            nonlocal n
            d |= {"part": part, "chunk": n, "whole": whole, "codes": bytes(d["codes"])}
            n += 1
            out.append(d)

        def ready() -> pa.RecordBatch:
            names = [f.split(" ")[0] for f in schema.split(", ")]
            types = [kind, pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.string()), *[pa.int64()] * 7]
            batch = pa.RecordBatch.from_arrays([pa.array([d[x] for d in out], t) for x, t in zip(names, types, strict=True)], names=names)
            out.clear()
            return batch

        begun = cut = False  # begun: a conversation that surely began here; cut: it has a chunk already
        for b in batches:
            kind = b.column(0).type
            for conv, turn, role, text, copies, later in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if cur is None or cur["conv_id"] != conv:
                    if cur is not None:
                        close(cur, begun and not cut)
                        begun = True
                    cut, cur = False, fresh(conv)
                elif len(cur["texts"]) >= chunk_rows or cur["chars"] > CHUNK_CHARS:
                    close(cur, False)
                    cut, cur = True, fresh(conv)
                if not copies:
                    continue
                cls, codes = _CLASS.get(role[:1], 3), cur["codes"]
                last = _LAST.search(text) if _SOLID.search(text) else None
                if last is None:
                    new = [cls + 8] * copies
                    cur["blank"] += copies
                elif later:
                    new = [cls + 8] * copies
                    cur["duplicate"] += copies
                else:
                    short = last[1] not in ".!?"
                    new = [cls + 4 * short] + [cls + 8] * (copies - 1)
                    cur["duplicate"] += copies - 1
                    cur["truncated"] += short
                    cur["roles"].append(role)
                    cur["texts"].append(text)
                    cur["chars"] += len(text)
                for c in new:
                    if codes:
                        cur["illegal"] += _illegal(codes[-1], c)
                    codes.append(c)
                if turn is not None:
                    if cur["first_turn"] is None:
                        cur["first_turn"] = turn
                    if cur["last_turn"] != turn:
                        cur["turns"] += 1
                    cur["last_turn"] = turn
            if sum(d["chars"] for d in out) > 8_000_000 or len(out) > 2000:
                yield ready()
        if cur is not None:
            close(cur, False)  # it may go on in the next partition
        if out:
            yield ready()

    return stored(rows.mapInArrow(run, schema), "chunks")


def _illegal(a: int, b: int) -> bool:
    return (a & 3, b & 3) not in ((0, 1), (1, 2), (2, 1))


_VECTOR = "array<bigint>"


def _stitched(open_chunks: DataFrame, id_type: str) -> DataFrame:
    """(conv_id, place, ahead): the cost vector after each chunk that has rows to decide on, after as many
    fix-up passes as it takes until no vector differs by more than a constant."""
    # chunks are at least CHUNK_ROWS rows or a whole share of a partition: few to a conversation
    w = Window.partitionBy("conv_id").orderBy("part", "chunk")
    live = open_chunks.where("size(texts) > 0").select("conv_id", "part", "chunk", "codes")
    live = stored(live.select("*", F.row_number().over(w).alias("place"), F.lead("part").over(w).isNull().alias("ends")), "live")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends, codes = b.column(2).to_pylist(), b.column(3).to_pylist()
            starts = [start_vector(c, e) for c, e in zip(codes, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(starts, pa.list_(pa.int64()))], names=["conv_id", "place", "ahead", "start"])

    schema = f"conv_id {id_type}, place int, ahead {_VECTOR}, start {_VECTOR}"
    end = F.array(*[F.lit(x).cast("bigint") for x in END])
    table = stored(live.select("conv_id", "place", end.alias("ahead"), "codes").mapInArrow(run, schema), "vectors")
    keys = live.select(F.col("conv_id").alias("_c"), F.col("place").alias("_p"), "codes")

    def level(v: str) -> Column:
        return F.transform(v, lambda x: x - F.element_at(v, 4))

    while True:
        following = table.select(F.col("conv_id").alias("_n"), (F.col("place") - 1).alias("_q"), F.col("start").alias("given"))
        both = table.join(following, F.col("conv_id").eqNullSafe(F.col("_n")) & (F.col("place") == F.col("_q")), "left")
        both = both.select("conv_id", "place", "ahead", "start", "given", (F.col("given").isNotNull() & (level("given") != level("ahead"))).alias("again"))
        both = stored(both, "passes")
        if both.where("again").isEmpty():
            return both.select("conv_id", "place", "ahead").join(
                live.select(F.col("conv_id").alias("_c"), F.col("place").alias("_p"), "part", "chunk"),
                F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("place") == F.col("_p"))).select("part", "chunk", "ahead")
        rerun = both.where("again").join(keys, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("place") == F.col("_p")))
        rerun = rerun.select("conv_id", "place", F.col("given").alias("ahead"), "codes").mapInArrow(run, schema)
        table = stored(both.where("not again").select("conv_id", "place", "ahead", "start").unionByName(rerun), "vectors")


def repair(rows: DataFrame, chunk_rows: int = CHUNK_ROWS, with_lines: bool = False) -> DataFrame:
    """Per conv_id of ``rows(conv_id, turn, role, text, copies)``: gaps, blank, duplicate, truncated, illegal,
    cost, audit, repaired_sha256 and, ``with_lines``, repaired (the repaired rows as ``role:text``).

    Rows are taken by turn, nulls first; rows of one turn by role and text, so that equal rows and copies are
    adjacent.  A row of 0 copies only names its conversation; a conversation without rows has zeros, an empty
    audit and the empty string's hash.  Null conv_ids are one conversation; null roles and texts are one space.
    Texts are never cut short.  A row's first fault counts: blank, duplicate (its role and text stand
    earlier), truncated.  An empty table gives an empty result; other columns are not read.
    """
    def text(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    id_type = rows.schema["conv_id"].dataType.simpleString()
    rows = rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), text("role").alias("role"), text("text").alias("text"), "copies")
    table = _chunks(_ordered(rows), id_type, chunk_rows)
    ahead = _stitched(table.where("not whole"), id_type)
    apart = table.where("not whole").join(ahead, ["part", "chunk"], "left")
    kept = [c for c in table.columns if c != "whole"]
    traced = (f"conv_id {id_type}, part int, chunk int, codes binary, roles array<string>, texts array<string>, first_turn bigint, last_turn bigint, "
              "turns bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, audits array<string>, states array<int>, costs array<bigint>")

    def traces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for codes, end in zip(b.column("codes").to_pylist(), b.column("ahead").to_pylist(), strict=True):
                if end is None:  # nothing but rows to be deleted
                    found.append([("D" * len(codes), q, DELETE * len(codes)) for q in range(4)])
                else:
                    costs = sweep(codes, tuple(end))
                    found.append([trace(codes, costs, q) for q in range(4)])
            extra = [pa.array([[x[i] for x in f] for f in found], pa.list_(t)) for i, t in enumerate((pa.string(), pa.int32(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], *extra], names=[*kept, "audits", "states", "costs"])

    order = [F.col("conv_id").asc_nulls_first(), "part", "chunk"]
    strung = apart.select(*kept, "ahead").mapInArrow(traces, traced).repartition("conv_id").sortWithinPartitions(*order)
    result = f"conv_id {id_type}, {COUNTS}" + (", repaired array<string>" if with_lines else "")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in the order of their conversations' chunks."""
        done: list[tuple] = []
        kind, cur = pa.int64(), None

        def end() -> None:
            d = cur
            rest = closing(d["q"])
            put(d, lines(rest, d["q"], [], [], b""))
            gaps = d["last"] - d["first"] + 1 - d["turns"] if d["first"] is not None else 0
            row = (d["conv_id"], gaps, d["blank"], d["duplicate"], d["truncated"], d["illegal"], d["cost"] + INSERT * len(rest),
                   "".join([*d["audit"], rest]), d["sha"].hexdigest())
            done.append((*row, d["lines"]) if with_lines else row)

        def put(d: dict, new: Iterator[str]) -> None:
            for x in new:
                d["sha"].update((("\n" if d["some"] else "") + x).encode("utf-8", "surrogatepass"))
                d["some"] = True
                if with_lines:
                    d["lines"].append(x)

        def ready() -> pa.RecordBatch:
            names = [f.split(" ")[0] for f in result.split(", ")]
            types = [kind, *[pa.int64()] * 6, pa.string(), pa.string(), *([pa.list_(pa.string())] if with_lines else [])]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=names)
            done.clear()
            return batch

        for b in batches:
            kind = b.column(0).type
            solved = "audits" in b.schema.names
            for i in range(b.num_rows):
                r = {c: b.column(c)[i].as_py() for c in b.schema.names}
                if cur is None or not solved or cur["conv_id"] != r["conv_id"]:
                    if cur is not None:
                        end()
                    cur = {"conv_id": r["conv_id"], "q": 0, "first": None, "last": None, "code": None, "audit": [], "sha": hashlib.sha256(), "some": False,
                           "lines": [], "turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0}
                codes = r["codes"]
                if solved:
                    audit, state, cost = r["audits"][cur["q"]], r["states"][cur["q"]], r["costs"][cur["q"]]
                else:
                    audit, state, cost = trace(codes, sweep(codes, END), 0)
                put(cur, lines(audit, cur["q"], r["roles"], r["texts"], codes))
                if codes:
                    cur["illegal"] += cur["code"] is not None and _illegal(cur["code"], codes[0])
                    cur["code"] = codes[-1]
                if r["first_turn"] is not None:
                    cur["turns"] += r["turns"] - (cur["last"] == r["first_turn"])
                    cur["first"] = r["first_turn"] if cur["first"] is None else cur["first"]
                    cur["last"] = r["last_turn"]
                for k in ("blank", "duplicate", "truncated", "illegal"):
                    cur[k] += r[k]
                cur["q"], cur["cost"] = state, cur["cost"] + cost
                cur["audit"].append(audit)
                if len(done) >= 1000:
                    yield ready()
        if cur is not None:
            end()
        if done:
            yield ready()

    alone = table.where("whole").select(*kept).mapInArrow(finish, result)
    return strung.mapInArrow(finish, result).unionByName(alone)
