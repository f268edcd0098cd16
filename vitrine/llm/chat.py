"""Transcript parsing: a hidden Markov model over speaker markers and line features, then canonical turns.

The hidden state of a line is its speaker's role. A line shows a marker (the role its row declares, or one
written at its start, such as ``Human:``) and features (length, question). Roles are recovered by Viterbi
over the whole conversation and each row is rendered as canonical turns.

A conversation of any length is handled in segments of bounded size. A segment at whose edge a conversation
is cut gives a small table of best scores from each state before it to each state at its end; these tables
are put in a row for each cut conversation, which fixes the states at the cuts, and the segments are then
decoded apart. The result is that of one pass over the whole conversation.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.llm.common import partitions, small_batches, stored

ROLES = ("system", "user", "assistant", "tool")
#: Fixed: names of the roles in markers.
NAMES = {
    "system": 0, "sys": 0, "instruction": 0, "instructions": 0, "user": 1, "human": 1, "prompter": 1, "question": 1, "q": 1, "customer": 1,
    "assistant": 2, "ai": 2, "bot": 2, "gpt": 2, "model": 2, "answer": 2, "a": 2, "agent": 2, "tool": 3, "function": 3, "observation": 3,
}
_WORDS = "|".join(sorted(NAMES, key=len, reverse=True))
#: A marker at the start of a line: ``User:``, ``### Human:``, ``[user]``, ``<|assistant|>``, ``**Bot**:``.
MARKER = re.compile(rf"[ \t]*(?:(?:#{{1,6}}[ \t]*)?({_WORDS})[ \t]*:|\[({_WORDS})\]:?|<\|({_WORDS})\|>|\*\*({_WORDS}):?\*\*:?)[ \t]*", re.IGNORECASE)
#: Rows of a segment, and rows the model is fitted on.
SEGMENT, TRAIN_ROWS = 512, 20_000
#: How often a marker names the right role, and how often a line without one goes on with the speaker.
RIGHT, STAY = 0.97, 0.995
_S = len(ROLES)
_FEATURES = 6


def lines_of(text: str | None) -> list[tuple[int, str]]:
    """Marker (-1: none) and content of each line; one empty line for an empty text."""
    out = []
    for line in (text or "").split("\n"):
        found = MARKER.match(line)
        if found:
            out.append((NAMES[next(g for g in found.groups() if g).lower()], line[found.end() :]))
        else:
            out.append((-1, line))
    return out


def feature(line: str) -> int:
    """Bucket of a line: length (three) by question (two)."""
    return (0 if len(line) < 40 else 1 if len(line) < 160 else 2) * 2 + line.rstrip().endswith("?")


class Model:
    """Log-probabilities: ``start`` and ``turn`` of roles, ``look`` of features; counts with one added to each."""

    def __init__(self, start: np.ndarray, turn: np.ndarray, look: np.ndarray) -> None:
        log = lambda n: np.log((n + 1) / (n + 1).sum(axis=-1, keepdims=True))
        self.start, self.turn, self.look = log(start), log(turn), log(look)
        self.stay = np.log(np.where(np.eye(_S) > 0, STAY, (1 - STAY) / (_S - 1)))
        self.mark = np.log(np.where(np.eye(_S) > 0, RIGHT, (1 - RIGHT) / (_S - 1)))

    def steps(self, rows: list[tuple[int, list[tuple[int, str]]]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Transition into each line and score of what it shows, by role. ``rows``: declared role and lines."""
        for declared, lines in rows:
            for i, (marker, line) in enumerate(lines):
                seen = self.look[:, feature(line)].copy()
                if marker >= 0:
                    seen += self.mark[:, marker]
                if i == 0 and declared >= 0:
                    seen += self.mark[:, declared]
                yield (self.turn if i == 0 or marker >= 0 else self.stay), seen

    def table(self, rows: list) -> tuple[np.ndarray, np.ndarray]:
        """Best score of the rows from each role before them to each role at their end, and from a start."""
        best, begin = None, None
        for move, seen in self.steps(rows):
            best = move + seen if best is None else (best[:, :, None] + move[None]).max(axis=1) + seen
            begin = self.start + seen if begin is None else (begin[:, None] + move).max(axis=0) + seen
        return best, begin

    def decode(self, rows: list, before: int = -1, at_end: int = -1) -> list[int]:
        """Role of each line; ``before`` is the role just before and ``at_end`` that of the last line, if known."""
        back, v = [], None
        for move, seen in self.steps(rows):
            if v is None:
                v = (self.start if before < 0 else move[before]) + seen
            else:
                way = v[:, None] + move
                back.append(way.argmax(axis=0))
                v = way.max(axis=0) + seen
        state = int(v.argmax()) if at_end < 0 else at_end
        out = [state]
        for b in reversed(back):
            state = int(b[state])
            out.append(state)
        return out[::-1]


def _declared(role: str | None) -> int:
    return NAMES.get((role or "").strip().lower(), -1)


def _pieces(table: pa.Table) -> list[tuple[object, list[dict]]]:
    """Rows of a segment in order, split where the conversation changes."""
    out: list[tuple[object, list[dict]]] = []
    for r in sorted(table.to_pylist(), key=lambda r: r["idx"]):
        if not out or out[-1][0] != r["conv"]:
            out.append((r["conv"], []))
        out[-1][1].append(r)
    return out


def _observed(rows: list[dict]) -> list[tuple[int, list[tuple[int, str]]]]:
    return [(_declared(r["role"]), lines_of(r["text"])) for r in rows]


def fit(segments: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """A model from about ``rows`` rows that declare a role: whole segments, the first by hash."""

    def count(table: pa.Table) -> pa.Table:
        n = {"start": np.zeros(_S), "turn": np.zeros((_S, _S)), "look": np.zeros((_S, _FEATURES))}
        for i, (_, piece) in enumerate(_pieces(table)):
            last = -1
            for j, (role, lines) in enumerate(_observed(piece)):
                if role >= 0:
                    if last >= 0:
                        n["turn"][last, role] += 1
                    elif i > 0 and j == 0:
                        n["start"][role] += 1
                    if all(m < 0 for m, _ in lines):
                        for _, line in lines:
                            n["look"][role, feature(line)] += 1
                last = role
        flat = [(k, i, float(x)) for k, v in n.items() for i, x in enumerate(v.ravel())]
        return pa.table({"what": [f[0] for f in flat], "at": pa.array([f[1] for f in flat], pa.int32()), "n": pa.array([f[2] for f in flat], pa.float64())})

    some = segments.select("pid", "seg").distinct().orderBy(F.xxhash64("pid", "seg"), "pid", "seg").limit(max(1, rows // SEGMENT))
    sample = segments.join(F.broadcast(some), ["pid", "seg"])  # so many rows at most
    counts = sample.groupBy("pid", "seg").applyInArrow(count, "what string, at int, n double").groupBy("what", "at").agg(F.sum("n").alias("n")).collect()
    out = {"start": np.zeros(_S), "turn": np.zeros(_S * _S), "look": np.zeros(_S * _FEATURES)}
    for r in counts:
        out[r.what][r.at] = r.n
    return Model(out["start"], out["turn"].reshape(_S, _S), out["look"].reshape(_S, _FEATURES))


def render(role: int, lines: list[str]) -> str:
    """A canonical turn."""
    return f"<|{ROLES[role]}|>\n" + "\n".join(line.rstrip() for line in lines).strip() + "\n"


def parse(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    model: Model | None = None, segment: int = SEGMENT, train_rows: int = TRAIN_ROWS,
) -> DataFrame:
    """``conv, turn, part, role, rendered``: the canonical turns of each row, numbered within it by ``part``.

    A row gives one turn, or several if its lines change speaker. Declared roles are evidence, not the
    truth; null or unknown ones say nothing. A null text is an empty line. Rows with a null conversation
    are one conversation; a null turn comes first; rows that repeat a turn each give theirs. Other
    columns are left out.
    """
    spark = rows.sparkSession
    small_batches(spark)
    slim = rows.select(
        rows[f"`{conv}`"].alias("conv"), rows[f"`{turn}`"].alias("turn"), rows[f"`{role}`"].cast("string").alias("role"),
        rows[f"`{text}`"].alias("text"), F.monotonically_increasing_id().alias("own"),
    )
    # order of the whole table: a long conversation is spread over many ranges
    ordered = slim.repartitionByRange(partitions(rows), "conv", "turn", "role", "own").sortWithinPartitions("conv", "turn", "role", "own")
    within = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    segments = stored(
        ordered.select("*", F.spark_partition_id().alias("pid"), within.alias("idx")).withColumn("seg", F.floor(F.col("idx") / segment)), "transcripts"
    )
    sent = spark.sparkContext.broadcast(fit(segments, train_rows) if model is None else model)
    conv_type, turn_type = segments.schema["conv"].dataType, segments.schema["turn"].dataType

    def edges(key: tuple, table: pa.Table) -> pa.Table:
        """Score tables of the first and the last conversation of a segment."""
        pieces = _pieces(table)
        kept = [pieces[0], pieces[-1]] if len(pieces) > 1 else pieces
        scores = [sent.value.table(_observed(p)) for _, p in kept]
        return pa.table({
            "conv": pa.array([c for c, _ in kept], table.schema.field("conv").type),
            "pid": pa.array([key[0].as_py()] * len(kept), pa.int32()), "seg": pa.array([key[1].as_py()] * len(kept), pa.int64()),
            "best": pa.array([b.ravel().tolist() for b, _ in scores], pa.list_(pa.float64())),
            "begin": pa.array([b.tolist() for _, b in scores], pa.list_(pa.float64())),
        })

    def settle(table: pa.Table) -> pa.Table:
        """Roles at the cuts of one conversation, from the tables of its pieces."""
        pieces = sorted(table.to_pylist(), key=lambda r: (r["pid"], r["seg"]))
        v, back = np.array(pieces[0]["begin"]), []
        for p in pieces[1:]:
            way = v[:, None] + np.array(p["best"]).reshape(_S, _S)
            back.append(way.argmax(axis=0))
            v = way.max(axis=0)
        ends = [int(v.argmax())]
        for b in reversed(back):
            ends.append(int(b[ends[-1]]))
        ends = ends[::-1]
        n = len(pieces)
        return pa.table({
            "conv": table["conv"].slice(0, 1).take(pa.array([0] * n)), "pid": pa.array([p["pid"] for p in pieces], pa.int32()),
            "seg": pa.array([p["seg"] for p in pieces], pa.int64()), "before": pa.array([-1] + ends[:-1], pa.int32()),
            "at_end": pa.array(ends, pa.int32()),
        })

    def decode(left: pa.Table, right: pa.Table) -> pa.Table:
        fixed = {r["conv"]: (r["before"], r["at_end"]) for r in right.to_pylist()}
        out: dict[str, list] = {"conv": [], "turn": [], "part": [], "role": [], "rendered": []}
        for name, piece in _pieces(left):
            seen = _observed(piece)
            states, at = sent.value.decode(seen, *fixed.get(name, (-1, -1))), 0
            for r, (_, lines) in zip(piece, seen):
                own, part, start = states[at : at + len(lines)], 0, 0
                at += len(lines)
                for i in range(1, len(lines) + 1):
                    if i == len(lines) or own[i] != own[start]:
                        for k, x in zip(out, (name, r["turn"], part, ROLES[own[start]], render(own[start], [c for _, c in lines[start:i]]))):
                            out[k].append(x)
                        part, start = part + 1, i
        types = {"conv": left.schema.field("conv").type, "turn": left.schema.field("turn").type, "part": pa.int32(), "role": pa.string(), "rendered": pa.string()}
        return pa.table({k: pa.array(v, types[k]) for k, v in out.items()})

    place = T.StructType([T.StructField("conv", conv_type), T.StructField("pid", T.IntegerType()), T.StructField("seg", T.LongType())])
    scores = T.StructType([*place.fields, T.StructField("best", T.ArrayType(T.DoubleType())), T.StructField("begin", T.ArrayType(T.DoubleType()))])
    cuts = T.StructType([*place.fields, T.StructField("before", T.IntegerType()), T.StructField("at_end", T.IntegerType())])
    turns = T.StructType([
        T.StructField("conv", conv_type), T.StructField("turn", turn_type), T.StructField("part", T.IntegerType()),
        T.StructField("role", T.StringType()), T.StructField("rendered", T.StringType()),
    ])
    tables = segments.groupBy("pid", "seg").applyInArrow(edges, scores)
    settled = tables.groupBy("conv").applyInArrow(settle, cuts)
    done = segments.groupBy("pid", "seg").cogroup(settled.groupBy("pid", "seg")).applyInArrow(decode, turns)
    return done.select(F.col("conv").alias(conv), F.col("turn").alias(turn), "part", "role", "rendered")
