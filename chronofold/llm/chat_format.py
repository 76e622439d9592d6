"""Chat formatting: roles of transcript lines by a hidden Markov model, then canonical turns.

States are (role, first or later line of a turn) for system, user and assistant. A line emits the kind
of speaker marker it starts with and a few features of the line (blank, question, list or code, length);
transitions alternate user and assistant, allow a system turn first, and keep a turn going. The best
path (Viterbi) gives roles and turn starts; markers of turn starts are removed and turns are rendered as

    <|role|>
    text

Scale: a conversation may hold a third of all rows, so the path is found by parts of `part_rows` rows:
each part is reduced to a matrix of best scores from state to state (max-plus, associative); the
matrices of a conversation, one of 36 numbers for `part_rows` rows, are chained to get the states at the
edges of parts; then parts are decoded in parallel. One row per turn and part is returned, not one
per conversation, so no row gathers a conversation.

Defined cases: null text is an empty line; rows with null conversation form one conversation; equal
positions are ordered by text; null positions come first; repeated rows are lines of their own.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronofold.llm.frames import keep

ROLES = ("system", "user", "assistant")
PART_ROWS = 256
#: Speaker markers by role; `name:`, `[name]`, `<name>`, `### name:` and `**name**:` forms are understood.
NAMES = {
    "system": ("system", "instructions", "context"),
    "user": ("user", "human", "customer", "question", "prompt", "q", "me"),
    "assistant": ("assistant", "bot", "ai", "agent", "answer", "response", "a", "model"),
}
_ROLE_OF = {n: i for i, r in enumerate(ROLES) for n in NAMES[r]}
_ANY = "|".join(sorted(_ROLE_OF, key=len, reverse=True))
MARKER = re.compile(rf"^\s*(?:#+\s*(?P<a>{_ANY})\s*:?|\*\*(?P<b>{_ANY})\s*:?\*\*\s*:?|\[(?P<c>{_ANY})\]\s*:?|<\|?(?P<d>{_ANY})\|?>\s*:?|(?P<e>{_ANY})\s*[:>])\s*", re.I)
NO_MARKER, FEATURES = 3, 5


def _log(p):
    return np.log(np.array(p, float))


#: States: 2 * role (first line of a turn), 2 * role + 1 (later line).
START = _log([0.3, 1e-9, 0.6, 1e-9, 0.1, 1e-9])
TURN = _log([[0.02, 0.90, 0.08], [0.01, 0.04, 0.95], [0.01, 0.95, 0.04]])
STAY = 0.6


def _transitions() -> np.ndarray:
    t = np.full((6, 6), -np.inf)
    for r in range(3):
        for b in (0, 1):
            t[2 * r + b, 2 * r + 1] = np.log(STAY)
            for s in range(3):
                t[2 * r + b, 2 * s] = np.log(1 - STAY) + TURN[r, s]
    return t


TRANSITION = _transitions()
#: P(marker kind | state): a turn's first line carries its role's marker or none, others hardly any.
MARK = np.array([[0.9, 0.01, 0.01, 0.08] if s == 0 else [0.01, 0.85, 0.02, 0.12] if s == 2 else [0.01, 0.02, 0.85, 0.12] if s == 4 else [0.004, 0.004, 0.004, 0.988] for s in range(6)])
#: P(line feature | state): blank, question, list or code, short, long.
LINE = np.array([[0.02, 0.05, 0.08, 0.35, 0.50], [0.15, 0.03, 0.22, 0.25, 0.35], [0.01, 0.35, 0.04, 0.35, 0.25], [0.18, 0.20, 0.12, 0.25, 0.25], [0.01, 0.06, 0.08, 0.25, 0.60], [0.18, 0.05, 0.27, 0.15, 0.35]])


def observe(line: str) -> tuple[int, int, bool, str]:
    """Marker kind, line feature, whether the marker is a heading, and the line without it."""
    m = MARKER.match(line)
    rest = line[m.end() :] if m else line
    s = rest.strip()
    feature = 0 if not s else 1 if s.endswith("?") else 2 if re.match(r"[-*•`]|\d+[.)]\s|\s{4}", rest) else 3 if len(s) < 60 else 4
    return (_ROLE_OF[m[m.lastgroup].lower()] if m else NO_MARKER), feature, bool(m and m.lastgroup == "a"), rest


def emissions(lines: list[str]) -> tuple[np.ndarray, list[tuple[bool, str]]]:
    """Log emissions by line and state, and of each line whether it is a heading and what follows it."""
    seen = [observe(x) for x in lines]
    kinds, features = np.array([x[0] for x in seen], int), np.array([x[1] for x in seen], int)
    return np.log(MARK[:, kinds] * LINE[:, features]).T.reshape(-1, 6), [x[2:] for x in seen]


def chain(e: np.ndarray) -> np.ndarray:
    """Best scores from the state before the first line to the state of the last (max-plus product)."""
    m = np.where(np.eye(6) > 0, 0.0, -np.inf)
    for row in e:
        m = (m[:, :, None] + TRANSITION[None]).max(axis=1) + row
    return m


def decode(e: np.ndarray, before: int | None, last: int | None) -> np.ndarray:
    """The best states of the lines, given the state before the first (None: start) and of the last."""
    score = (START if before is None else TRANSITION[before]) + e[0]
    back = np.zeros((len(e), 6), int)
    for i in range(1, len(e)):
        all_scores = score[:, None] + TRANSITION
        back[i] = all_scores.argmax(axis=0)
        score = all_scores.max(axis=0) + e[i]
    path = np.zeros(len(e), int)
    path[-1] = int(score.argmax()) if last is None else last
    for i in range(len(e) - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def _lines(table: pa.Table) -> list[str]:
    return [line for t in table.column("text").to_pylist() for line in (t or "").split("\n")]


def _edges(table: pa.Table) -> pa.Table:
    """States at the edges of a conversation's parts from their matrices."""
    table = table.sort_by("part")
    ms = [np.array(x).reshape(6, 6) for x in table.column("matrix").to_pylist()]
    score, backs = np.array(table.column("start")[0].as_py()), []
    for m in ms[1:]:
        every = score[:, None] + m
        backs.append(every.argmax(axis=0))
        score = every.max(axis=0)
    states = [int(score.argmax())]
    for b in reversed(backs):
        states.append(int(b[states[-1]]))
    states.reverse()
    return pa.table({"conv": table.column("conv"), "part": table.column("part"), "before": pa.array([None, *states[:-1]], pa.int32()), "last": pa.array(states, pa.int32())})


def _start(table: pa.Table) -> pa.Table:
    """The matrix of a part, and its best scores by last state when it opens the conversation."""
    e, _ = emissions(_lines(table.sort_by([("position", "ascending"), ("text", "ascending")])))
    score = START + e[0]
    for row in e[1:]:
        score = (score[:, None] + TRANSITION).max(axis=0) + row
    m = chain(e)
    return pa.table({"conv": table.column("conv")[:1], "part": table.column("part")[:1], "start": pa.array([score.tolist()]), "matrix": pa.array([np.where(np.isinf(m), -1e300, m).ravel().tolist()])})


def _turns(table: pa.Table) -> pa.Table:
    table = table.sort_by([("position", "ascending"), ("text", "ascending")])
    lines = _lines(table)
    e, rest = emissions(lines)
    path = decode(e, table.column("before")[0].as_py(), table.column("last")[0].as_py())
    cut = [0] + [i for i in range(1, len(path)) if path[i] % 2 == 0] + [len(path)]
    out = []
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        role, opens = ROLES[path[a] // 2], path[a] % 2 == 0
        alone = opens and b - a > 1 and rest[a][0] and not rest[a][1]  # a heading names the turn and is no line of it
        text = "\n".join(x if i or not opens else y for i, (x, (_, y)) in enumerate(zip(lines[a:b], rest[a:b], strict=True)) if i or not alone)
        out.append((role, opens, b - a, text, f"<|{role}|>\n{text}\n" if opens else f"{text}\n"))
    n = len(out)
    conv, part = table.column("conv")[0].as_py(), table.column("part")[0].as_py()
    cols = list(zip(*out, strict=True))
    return pa.table({"conv": pa.array([conv] * n, pa.int64()), "part": pa.array([part] * n, pa.int64()), "at": pa.array(range(n), pa.int64()), "role": pa.array(cols[0]), "opens": pa.array(cols[1]), "n_lines": pa.array(cols[2], pa.int64()), "text": pa.array(cols[3]), "rendered": pa.array(cols[4])})


def parse_transcripts(pieces: DataFrame, conv_col: str = "conv_id", position_col: str = "turn", text_col: str = "text", part_rows: int = PART_ROWS) -> DataFrame:
    """Turns of transcripts given as pieces (whole lines, in the order of position): conv_id, turn (from
    0), part, role, n_lines, text, rendered. A turn that runs over parts has a row for each."""
    df = pieces.select(F.col(conv_col).cast("long").alias("conv"), F.coalesce(F.col(position_col).cast("long"), F.lit(-(1 << 62))).alias("position"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    df = df.withColumn("part", F.floor(F.col("position") / part_rows).cast("long"))
    edges = df.groupBy("conv", "part").applyInArrow(_start, "conv long, part long, start array<double>, matrix array<double>")
    edges = edges.groupBy("conv").applyInArrow(_edges, "conv long, part long, before int, last int")
    edges = edges.withColumnsRenamed({"conv": "c", "part": "p"})
    held = df.join(edges, F.col("conv").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))).select("conv", "part", "position", "text", "before", "last")
    turns = held.groupBy("conv", "part").applyInArrow(_turns, "conv long, part long, at long, role string, opens boolean, n_lines long, text string, rendered string")
    turns = keep(turns, "turns")  # read twice below: parts are decoded once
    # Turn numbers: openings before a part (a window over one row per part) plus those inside it.
    per = turns.groupBy("conv", "part").agg(F.sum(F.col("opens").cast("long")).alias("openings"))
    before = F.coalesce(F.sum("openings").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.select(F.col("conv").alias("c"), F.col("part").alias("p"), before.alias("openings"))
    turns = turns.join(per, F.col("conv").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")))
    inside = F.sum(F.col("opens").cast("long")).over(Window.partitionBy("conv", "part").orderBy("at"))
    return turns.select(F.col("conv").alias(conv_col), (F.col("openings") + inside - 1).alias("turn"), "part", "role", "n_lines", "text", "rendered")


#: Markers that transcripts() writes, by style: (system, user, assistant).
STYLES = (("System: ", "User: ", "Assistant: "), ("### System\n", "### Human:\n", "### Assistant:\n"), ("[system] ", "[user] ", "[bot] "), ("**System:** ", "**User:** ", "**AI:** "), ("Instructions: ", "Q: ", "A: "))


def transcripts(conversations: DataFrame) -> DataFrame:
    """Conversations as raw transcripts: each turn's text after a speaker marker, in one of five styles
    chosen by conversation; the roles are gone. Unknown roles are written as users."""
    style = F.pmod(F.xxhash64("conv_id"), F.lit(len(STYLES)))
    marker = F.lit("")
    for i, marks in enumerate(STYLES):
        own = F.when(F.col("role") == "system", marks[0]).when(F.col("role") == "assistant", marks[2]).otherwise(marks[1])
        marker = F.when(style == i, own).otherwise(marker)
    return conversations.select("conv_id", "turn", F.concat(marker, F.coalesce("text", F.lit(""))).alias("text"))
