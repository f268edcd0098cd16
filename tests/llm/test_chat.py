"""Transcript parsing: equal to one pass over each conversation, recovers roles, odd tables."""

import random

import numpy as np

from vitrine.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def model():
    look = np.array([[2, 0, 9, 0, 5, 0], [20, 30, 20, 20, 1, 1], [3, 1, 20, 2, 40, 1], [5, 0, 5, 0, 5, 0]], float)
    turn = np.array([[0, 90, 5, 0], [1, 2, 95, 2], [0, 95, 2, 3], [0, 1, 50, 9]], float)
    return chat.Model(np.array([30, 60, 1, 0], float), turn, look)


def conversations():
    rng = random.Random(8)
    rows = []
    for conv, n in [(i, rng.randint(1, 9)) for i in range(60)] + [(1000, 700), (None, 5)]:
        for turn in range(n):
            role = rng.choice(["user", "assistant", None, "", "GPT", "odd"] if rng.random() < 0.5 else [("user", "assistant")[turn % 2]])
            text = rng.choice(["short?", "w " * 50, "w " * 120 + "\nmore", "Human: hi\nAssistant: yes\nand more", "", None, "### Bot: x", "[user] y\n<|tool|> z"])
            rows.append((conv, turn, role, text))
    return rows


def plain(rows, m):
    """Viterbi over each whole conversation, by plain recursion over all lines."""
    out = []
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: r[1])
        seen = [(chat._declared(r[2]), chat.lines_of(r[3])) for r in own]
        score, way = None, []
        for move, look in m.steps(seen):
            if score is None:
                score = [float(m.start[s] + look[s]) for s in range(4)]
                way.append(None)
                continue
            best = [max(range(4), key=lambda p, s=s: score[p] + move[p, s]) for s in range(4)]
            score = [score[best[s]] + float(move[best[s], s]) + float(look[s]) for s in range(4)]
            way.append(best)
        state = max(range(4), key=lambda s: score[s])
        states = [state]
        for best in reversed(way[1:]):
            state = best[state]
            states.append(state)
        states = states[::-1]
        for r, (_, lines) in zip(own, seen):
            mine, states = states[: len(lines)], states[len(lines) :]
            part, start = 0, 0
            for i in range(1, len(lines) + 1):
                if i == len(lines) or mine[i] != mine[start]:
                    out.append((r[0], r[1], part, chat.ROLES[mine[start]], chat.render(mine[start], [c for _, c in lines[start:i]])))
                    part, start = part + 1, i
    return sorted(map(str, out))


def test_segments_equal_one_pass(spark):
    rows = conversations()
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    want = plain(rows, model())
    for size in (512, 7, 1):
        assert sorted(map(str, map(tuple, chat.parse(df, model=model(), segment=size).collect()))) == want


def test_recovers_hidden_roles(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").collect()
    rng = random.Random(1)
    truth = {(r.conv_id, r.turn): r.role for r in rows}
    hidden = {k for k in truth if rng.random() < 0.4}
    df = spark.createDataFrame([(r.conv_id, r.turn, None if (r.conv_id, r.turn) in hidden else r.role, r.text) for r in rows], SCHEMA)
    got = {(r.conv_id, r.turn): r.role for r in chat.parse(df).collect()}
    assert all(got[k] == truth[k] for k in set(truth) - hidden)
    assert np.mean([got[k] == truth[k] for k in hidden]) > 0.9


def test_markers():
    text = "User: hi\n**Assistant:** yes\n<|system|>x\n### Human: a\n[tool]: 3\nuserland: no\nA: b"
    assert [m for m, _ in chat.lines_of(text)] == [1, 2, 0, 1, 3, -1, 2]
    assert chat.lines_of(text)[1][1] == "yes" and chat.lines_of(None) == [(-1, "")]
    assert chat.render(1, ["a  ", "", "b", " "]) == "<|user|>\na\n\nb\n"


def test_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA + ", part int, seg int")
    assert chat.parse(empty).count() == 0
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, None), (2, 3, "bot", "b\n" * 50_000), (3, 0, "user", "c" * 300_000)]
    out = chat.parse(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(str((r.conv_id, r.turn)) for r in out) == sorted(["(1, 0)", "(1, 0)", "(1, None)", "(2, 3)", "(3, 0)"])
