"""Operator 3, chat formatting: a hidden Markov model recovers the roles of a transcript's lines.

A state is a role and whether the line begins a turn. A line shows the kind of its speaker marker,
its length and whether it asks. Transitions and emissions are counted over all training rows in
Spark; Viterbi finds the best states, and turns are rendered as `<|role|>` and their lines.

A conversation may hold a third of all rows, so it is decoded in blocks of BLOCK rows, which together
are the exact best path: each block's score between any two states is a matrix (up), blocks of blocks
are multiplied in the max-plus sense until a conversation has few, the best states at the borders come
back the same way (down), and each block is decoded between its two border states.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsieve.llm.common import slices, table, with_row_id
from flowsieve.session import scratch_path

# Roles, and the words that mark their lines in transcripts.
ROLES = ("system", "user", "assistant")
MARKERS = {"system": ("System", "Instructions"), "user": ("User", "Human", "Customer", "Q"), "assistant": ("Assistant", "Bot", "AI", "A")}
#: Rows of a block, and blocks of a block of blocks.
BLOCK = 64
STATES = 2 * len(ROLES)
START = STATES
SMOOTHING = 0.5
#: Of MISSING turns of a raw transcript one has no marker.
MISSING = 8

_KINDS = {name.lower(): k + 1 for k, role in enumerate(ROLES) for name in MARKERS[role]}
_MARKER = re.compile(r"\s*(" + "|".join(sorted(_KINDS, key=len, reverse=True)) + r")\s*:\s*", re.I)
_OTHER = re.compile(r"\s*\w{1,20}\s*:\s")
_SIZES = (0, 8, 32)
SYMBOLS = (len(ROLES) + 2) * (len(_SIZES) + 1) * 2


def symbol(line: str) -> int:
    """What a line shows, as one number."""
    marker = _MARKER.match(line)
    kind = _KINDS[marker[1].lower()] if marker else len(ROLES) + 1 if _OTHER.match(line) else 0
    words = len(line.split())
    length = sum(words > x for x in _SIZES)
    return (kind * (len(_SIZES) + 1) + length) * 2 + line.rstrip().endswith("?")


def unmarked(line: str) -> str:
    marker = _MARKER.match(line)
    return line[marker.end() :] if marker else line


class Model(NamedTuple):
    """Log scores; state 2 * r begins a turn of role r, 2 * r + 1 goes on with one, START is before all."""

    moves: np.ndarray  # (STATES + 1) x STATES
    shows: np.ndarray  # STATES x SYMBOLS


def raw_text(role: str | None, text: str | None, key: str) -> str:
    """A turn as transcripts have it: a marker of its role, one of several or none as a hash of the key says."""
    h = zlib.crc32(key.encode())
    names = MARKERS.get(role or "")
    return (text or "") if names is None or h % MISSING == 0 else f"{names[h // MISSING % len(names)]}: {text or ''}"


def transcripts(df: DataFrame, id_col: str = "conv_id", order_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, pos, role, raw) of the turns in a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            conv, pos, role, text = (batch.column(k).to_pylist() for k in range(4))
            raw = [raw_text(r, t, f"{c}:{p}") for c, p, r, t in zip(conv, pos, role, text, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(raw, pa.string())], ["conv", "pos", "role", "raw"])

    rows = df.select(F.col(id_col).cast("long").alias("conv"), F.col(order_col).cast("long").alias("pos"), F.col(role_col).cast("string").alias("role"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "conv long, pos long, role string, raw string")


def _line_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for batch in slices(batches):
        for role, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            r = ROLES.index(role)
            for k, line in enumerate(raw.split("\n")):
                counts[2 * r + (k > 0), symbol(line)] += 1
    yield pa.RecordBatch.from_pydict({"state": pa.array([k[0] for k in counts], pa.int32()), "symbol": pa.array([k[1] for k in counts], pa.int32()), "n": pa.array(counts.values(), pa.int64())})


def train(rows: DataFrame) -> Model:
    """The model counted from rows (conv, pos, role, raw) with a known role. Without any, every start
    and move that can be is equally likely."""
    rows = rows.where(F.col("role").isin(*ROLES) & F.col("raw").isNotNull())
    shows = np.full((STATES, SYMBOLS), SMOOTHING)
    for state, sym, n in rows.select("role", "raw").mapInArrow(_line_counts, "state int, symbol int, n long").groupBy("state", "symbol").agg(F.sum("n")).collect():
        shows[state, sym] += n
    moves = np.full((STATES + 1, STATES), 1e-9)
    moves[START, ::2] += SMOOTHING
    moves[:STATES, ::2] += SMOOTHING
    lines = F.size(F.split("raw", "\n", -1))
    for role, n, two, more in rows.groupBy("role").agg(F.count("*"), F.sum((lines > 1).cast("long")), F.sum(F.greatest(lines - 2, F.lit(0)))).collect():
        b = 2 * ROLES.index(role)
        moves[b, b + 1] += two + SMOOTHING
        moves[b + 1, b + 1] += more + SMOOTHING
    # Neighbouring turns are joined by place, so no conversation is brought together.
    turns = rows.where(F.col("conv").isNotNull() & F.col("pos").isNotNull()).select("conv", "pos", "role", (lines > 1).cast("int").alias("long")).distinct()
    after = turns.select("conv", (F.col("pos") - 1).alias("pos"), F.col("role").alias("next"))
    for role, long, follower, n in turns.join(after, ["conv", "pos"]).groupBy("role", "long", "next").count().collect():
        moves[2 * ROLES.index(role) + long, 2 * ROLES.index(follower)] += n
    for role, n in turns.groupBy("conv").agg(F.min_by("role", F.struct("pos", "role")).alias("role")).groupBy("role").count().collect():
        moves[START, 2 * ROLES.index(role)] += n
    normal = lambda m: np.log(m / m.sum(axis=1, keepdims=True))
    return Model(normal(moves), normal(shows))


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def block_matrix(model: Model, lines: list[str]) -> np.ndarray:
    """Best score from each state before the lines to each state of the last, over (STATES + 1) squared."""
    full = np.full((STATES + 1, STATES + 1), -np.inf)
    full[:, :STATES] = model.moves
    out = None
    for line in lines:
        step = full.copy()
        step[:, :STATES] += model.shows[:, symbol(line)]
        out = step if out is None else _times(out, step)
    return out


def best_path(steps: list[np.ndarray], entry: int, leave: int | None) -> list[int]:
    """Best states behind each step, from a state before the first to one behind the last (any if
    None); of equal scores the lowest state."""
    score, back = np.full(STATES + 1, -np.inf), []
    score[entry] = 0
    for step in steps:
        sums = score[:, None] + step
        back.append(sums.argmax(axis=0))
        score = sums.max(axis=0)
    state = int(score.argmax()) if leave is None else leave
    out = [state]
    for origin in reversed(back[1:]):
        state = int(origin[state])
        out.append(state)
    return out[::-1]


def viterbi(model: Model, lines: list[str], entry: int = START, leave: int | None = None) -> list[int]:
    return best_path([block_matrix(model, [line]) for line in lines], entry, leave)


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with equal first columns."""
    now, held = None, []
    for batch in slices(batches):
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:keys] != now and held:
                yield now, held
                held = []
            now = row[:keys]
            held.append(row)
    if held:
        yield now, held


def _grouped(df: DataFrame, keys: list[str], order: list[str], schema: str, made: Callable[[tuple, list[tuple]], list[tuple]]) -> DataFrame:
    """made() over the rows of each key in order, their columns in the order keys, order, others."""
    fields = T.StructType.fromDDL(schema)
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [_ARROW[f.dataType.simpleString()] for f in fields]
        out: list[tuple] = []
        for key, rows in _groups(batches, len(keys)):
            out += made(key, rows)
            if len(out) >= 2048:
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)], names)
                out = []
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)], names)

    rest = [c for c in df.columns if c not in (*keys, *order)]
    return df.select(*keys, *order, *rest).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, fields)


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64())}


def decode(rows: DataFrame, model: Model) -> DataFrame:
    """(conv, pos, segment, role, begins, rendered) of transcript rows (conv, pos, raw).

    A segment is a run of one row's lines in one turn; begins says whether the turn begins there, and
    then the rendered text has the role's header. Rows of a conversation follow pos, equal ones the
    text; a row without conv or pos is a transcript of its own; a null raw is an empty line; a very long
    row is decoded whole; equal rows stay apart; an empty table gives an empty one.
    """
    spark = rows.sparkSession
    own = F.col("conv").isNull() | F.col("pos").isNull()
    keyed = with_row_id(rows, "uid").select(
        F.when(own, F.concat(F.lit("row "), F.col("uid").cast("string"))).otherwise(F.col("conv").cast("string")).alias("key"),
        F.when(own, 0).otherwise(F.floor(F.col("pos") / BLOCK)).cast("long").alias("b"),
        "conv", "pos", F.coalesce("raw", F.lit("")).alias("raw"), "uid",
    )
    where = scratch_path(spark, "transcripts")
    keyed.write.parquet(where)
    keyed = spark.read.parquet(where)
    shared = spark.sparkContext.broadcast(model)
    order = ["pos", "raw", "uid"]

    def up(key, group):
        m = block_matrix(shared.value, [line for row in group for line in row[3].split("\n")])
        return [(*key, m.ravel().tolist())]

    def up_again(key, group):
        m = None
        for row in group:
            x = np.array(row[3]).reshape(STATES + 1, -1)
            m = x if m is None else _times(m, x)
        return [(*key, m.ravel().tolist())]

    blocks = "key string, b long, m array<double>"
    where = scratch_path(spark, "blocks")
    _grouped(keyed.select("key", "b", *order), ["key", "b"], order, blocks, up).write.parquet(where)
    levels = [spark.read.parquet(where)]
    while (levels[-1].groupBy("key").count().agg(F.max("count")).first()[0] or 0) > BLOCK:
        lower = levels[-1].select("key", F.floor(F.col("b") / BLOCK).cast("long").alias("up"), "b", "m")
        where = scratch_path(spark, "blocks")
        _grouped(lower, ["key", "up"], ["b"], blocks, up_again).write.parquet(where)
        levels.append(spark.read.parquet(where))

    borders_of = "key string, b long, entry int, leave int"

    def borders(steps, entry, leave, keys):
        states = best_path([np.array(m).reshape(STATES + 1, -1) for m in steps], entry, leave)
        return [(*key, e, x) for key, e, x in zip(keys, [entry, *states[:-1]], states, strict=True)]

    border = _grouped(levels[-1], ["key"], ["b"], borders_of, lambda key, group: borders([r[2] for r in group], START, None, [(key[0], r[1]) for r in group]))
    for level in levels[-2::-1]:
        upper = border.withColumnRenamed("b", "up")
        lower = level.withColumn("up", F.floor(F.col("b") / BLOCK).cast("long")).join(upper, ["key", "up"])
        border = _grouped(lower, ["key", "up"], ["b"], borders_of, lambda key, group: borders([r[3] for r in group], group[0][4], group[0][5], [(key[0], r[2]) for r in group]))

    def down(key, group):
        # Columns: key, b, pos, raw, uid, conv, entry, leave.
        lines = [row[3].split("\n") for row in group]
        states, out, at = viterbi(shared.value, [x for own_ in lines for x in own_], group[0][6], group[0][7]), [], 0
        for row, own_ in zip(group, lines, strict=True):
            marks = states[at : at + len(own_)]
            at += len(own_)
            cuts = [0, *(k for k in range(1, len(marks)) if marks[k] % 2 == 0), len(marks)]
            for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                role, begins = ROLES[marks[a] // 2], marks[a] % 2 == 0
                text = "\n".join([unmarked(own_[a]) if begins else own_[a], *own_[a + 1 : b]])
                out.append((row[5], row[2], n, role, begins, f"<|{role}|>\n{text}" if begins else text))
        return out

    joined = keyed.join(border, ["key", "b"]).select("key", "b", *order, "conv", "entry", "leave")
    return _grouped(joined, ["key", "b"], order, "conv long, pos long, segment int, role string, begins boolean, rendered string", down)


def op3_chat_format(spark, sf_dir) -> DataFrame:
    """All conversations as raw transcripts, decoded by a model of those whose id leaves no 2 divided by 4."""
    rows = transcripts(table(spark, sf_dir, "conversations"))
    seen = F.coalesce(F.pmod(F.crc32(F.col("conv").cast("string")), F.lit(4)) != 2, F.lit(False))
    model = train(rows.where(seen))
    return decode(rows.drop("role"), model).withColumnsRenamed({"conv": "conv_id", "pos": "turn"})
