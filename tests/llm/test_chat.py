"""Block-wise decoding against whole-conversation Viterbi, and against all paths."""

import collections
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsieve.llm import chat

from .conftest import SF_DIR


@pytest.fixture(scope="module")
def rows(spark):
    return chat.transcripts(spark.read.parquet(f"{SF_DIR}/conversations.parquet"))


@pytest.fixture(scope="module")
def model(rows):
    return chat.train(rows)


def score(model, lines, states):
    total, before = 0.0, chat.START
    for line, state in zip(lines, states, strict=True):
        total += model.moves[before, state] + model.shows[state, chat.symbol(line)]
        before = state
    return total


def test_viterbi_is_the_best_of_all_paths(model):
    lines = ["User: what is it?", "more of it", "", "Bot: this"]
    best = max(score(model, lines, p) for p in itertools.product(range(chat.STATES), repeat=len(lines)))
    assert np.isclose(score(model, lines, chat.viterbi(model, lines)), best)


@pytest.mark.parametrize("block", [2, 64])
def test_blocks_give_the_best_path(rows, model, block, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", block)
    said = collections.defaultdict(list)
    for r in rows.collect():
        said[r.conv].append((r.pos, r.raw))
    got = collections.defaultdict(list)
    for r in sorted(chat.decode(rows.drop("role"), model).collect()):
        n = r.rendered.count("\n") + (not r.begins)
        base = 2 * chat.ROLES.index(r.role)
        got[r.conv] += [base + (not r.begins)] + [base + 1] * (n - 1)
    for conv, turns in said.items():
        lines = [line for _, raw in sorted(turns) for line in raw.split("\n")]
        assert np.isclose(score(model, lines, got[conv]), score(model, lines, chat.viterbi(model, lines)))


def test_held_out_roles(spark):
    larger = SF_DIR.replace("0.001", "0.01")  # enough conversations for a share to mean something
    said = {(r.conv_id, r.turn): r.role for r in spark.read.parquet(f"{larger}/conversations.parquet").collect()}
    rows = [r for r in chat.op3_chat_format(spark, larger).collect() if chat.zlib.crc32(str(r.conv_id).encode()) % 4 == 2]
    assert len({(r.conv_id, r.turn) for r in rows}) == sum(chat.zlib.crc32(str(c).encode()) % 4 == 2 for c, _ in said)
    assert sum(r.role == said[r.conv_id, r.turn] for r in rows) >= 0.9 * len(rows)
    assert all(r.rendered.startswith(f"<|{r.role}|>\n") for r in rows if r.begins)


def test_odd_rows(spark, model):
    odd = [(None, 1, "User: a"), (1, None, "Bot: b"), (1, 1, None), (1, 1, "User: q?\nAssistant: yes\nand more"), (1, 1, "User: q?\nAssistant: yes\nand more"), (1, -5, ""), (2, 10**12, "x\n" * 5000)]
    df = spark.createDataFrame(odd, "conv long, pos long, raw string").select("*", F.lit("k").alias("key"), F.lit(0).alias("b"))
    out = chat.decode(df, model).collect()
    assert collections.Counter((r.conv, r.pos) for r in out if r.segment == 0) == collections.Counter((c, p) for c, p, _ in odd)
    turn = [r for r in out if r.conv == 1 and r.pos == 1 and r.rendered.endswith("yes\nand more")]
    assert [r.role for r in turn] == ["assistant", "assistant"] and all(r.begins for r in turn)
    assert chat.decode(df.limit(0), model).count() == 0


def test_training_without_rows(spark):
    empty = chat.train(spark.createDataFrame([], "conv long, pos long, role string, raw string"))
    assert np.isfinite(empty.moves).all() and chat.viterbi(empty, ["User: a"])[0] % 2 == 0
