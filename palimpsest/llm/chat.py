"""Operator 9, chat formatting: a hidden Markov model over marker and line features recovers roles before turns are rendered."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.tables import hidden, q, read

ROLES = ("system", "user", "assistant", "tool")
#: States: role * 2 + (0: the line starts a turn, 1: it goes on with one).
STATES = 2 * len(ROLES)
#: How transcripts mark the speakers, in the order of ROLES. The last form puts the marker on a line of its own.
STYLES = (
    ("System: ", "User: ", "Assistant: ", "Tool: "), ("Instructions: ", "Human: ", "AI: ", "Function: "), ("Context: ", "Q: ", "A: ", "Result: "),
    ("[system] ", "[user] ", "[assistant] ", "[tool] "), ("<|system|> ", "<|user|> ", "<|assistant|> ", "<|tool|> "), ("### System\n", "### User\n", "### Assistant\n", "### Tool\n"),
)
_NAMES = {
    "system": 1, "instructions": 1, "instruction": 1, "context": 1, "developer": 1, "user": 2, "human": 2, "q": 2, "question": 2, "customer": 2, "prompter": 2, "me": 2, "you": 2,
    "assistant": 3, "ai": 3, "a": 3, "answer": 3, "bot": 3, "model": 3, "gpt": 3, "chatbot": 3, "agent": 3, "tool": 4, "function": 4, "result": 4, "ipython": 4,
}
#: Names that are common words too; a transcript that marks its speakers by others doesn't mark any by these.
_WORDS = frozenset("context q question a answer result".split())
_MARK = re.compile(r"^\s{0,8}(?:<\|(?:im_start\|>\s{0,4})?([A-Za-z]{1,20})(?:\|>)?|\[([A-Za-z]{1,20})\]:?|#{1,4}\s{0,4}([A-Za-z]{1,20}):?\s{0,8}$|\*{0,2}([A-Za-z]{1,20})\*{0,2}\s{0,4}:\*{0,2})[ \t]?")
_END = "<|im_end|>"
#: Marker 0 none, 1-4 a known name of that role as this transcript writes markers, 5 another name, 6 a known name written otherwise; place: first line, after a blank line, else; length of the line on a log scale; its last sign; whether the last line was short.
SIZES = (7, 3, 12, 4, 3)
OTHER, FOREIGN = 5, 6
#: Bound on the labelled conversations that the model is fitted on.
MAX_LABELLED = 3000


class Line(NamedTuple):
    """A line that has text, as places in its transcript: with its marker (which may stand on a line before), after it, and its end."""

    whole: int
    body: int
    end: int
    role: int  # of its marker, as in _NAMES; 0 if it has none


def lines_of(transcript: str) -> tuple[list[Line], np.ndarray]:
    """The lines that have text, and the features of each (columns as in SIZES). A transcript's own way of marking is that of its first line or, if that has no marker, of most of its markers."""
    found, at = [], 0
    for line in transcript.split("\n"):
        m = _MARK.match(line)
        name = next((g for g in m.groups() if g), "").lower() if m else ""
        style = (m.lastindex, name in _WORDS) if m and name in _NAMES else None
        found.append((at, line, m, _NAMES.get(name, 0), style))
        at += len(line) + 1
    styles = Counter(style for *_, style in found if style)
    first = next((style for _, line, *_, style in found if line.strip()), None)
    own = first or (max(styles, key=styles.__getitem__) if styles else None)  # of equals the first
    out, feats, blank, before = [], [], False, 0
    pending: tuple[int, int] | None = None
    for at, line, m, role, style in found:
        mine = style is not None and style == own
        body = line[m.end() :] if mine else line
        text = body[: -len(_END)] if body.endswith(_END) else body
        if mine and not text.strip():
            pending = (pending[0] if pending else at, role)  # a marker on a line of its own speaks for the next line
            continue
        if not text.strip():
            blank = blank or not mine
            continue
        whole, mark = at, role if mine else 0
        if pending:
            whole, mark = pending[0], mark or pending[1]
        if not mark and m:
            kind = FOREIGN if style else OTHER
        else:
            kind = mark
        end = text.rstrip()[-1]
        feats.append((kind, 0 if not out else 1 if blank else 2, min(11, len(text).bit_length()), 0 if end == "?" else 1 if end in ".!…。" else 2 if end in ":,;" else 3, 2 if before > 200 else 1 if before > 60 else 0))
        out.append(Line(whole, at + (m.end() if mine else 0), at + len(line), mark))
        pending, blank, before = None, False, len(text)
    return out, np.array(feats, np.int64).reshape(-1, len(SIZES))


class Markov:
    """Log chances of the first state, of moves, and of each feature's values in each state."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: list[np.ndarray]):
        self.start, self.move, self.emit = start, move, emit

    def viterbi(self, feats: list[np.ndarray]) -> list[np.ndarray]:
        return self.decode(feats)[0]

    def decode(self, feats: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
        """The likeliest states of each sequence, and their log chance; sequences run side by side, longest first, so each step is one array operation."""
        order = sorted(range(len(feats)), key=lambda i: -len(feats[i]))
        longest = len(feats[order[0]]) if order else 0
        alive = [sum(len(f) > t for f in feats) for t in range(longest)] if longest < 64 else np.searchsorted(np.sort([-len(f) for f in feats]), -np.arange(longest), "left").tolist()
        back: list[np.ndarray] = []
        score = np.zeros((len(order), STATES))
        for t in range(longest):
            n = alive[t]
            x = np.stack([feats[i][t] for i in order[:n]])
            e = sum(self.emit[c][:, x[:, c]].T for c in range(len(SIZES)))
            if t == 0:
                score[:n] = self.start + e
                continue
            ways = score[:n, :, None] + self.move
            best = ways.argmax(axis=1)
            back.append(best)
            score[:n] = np.take_along_axis(ways, best[:, None, :], 1)[:, 0] + e
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(feats)
        chance = np.zeros(len(feats))
        for k, i in enumerate(order):
            n = len(feats[i])
            chance[i] = score[k].max()
            if not n:
                continue
            path = np.zeros(n, np.int64)
            path[-1] = score[k].argmax()
            for t in range(n - 1, 0, -1):
                path[t - 1] = back[t - 1][k, path[t]]
            out[i] = path
        return out, chance


class Either:
    """Logs that mark every turn and logs that don't, a model for each; a transcript is read by the one under which it is likelier."""

    def __init__(self, models: list[Markov]):
        self.models = models

    def viterbi(self, feats: list[np.ndarray]) -> list[np.ndarray]:
        read = [m.decode(feats) for m in self.models]
        best = np.argmax([chance for _, chance in read], axis=0)
        return [read[k][0][i] for i, k in enumerate(best)]


def fit(feats: list[np.ndarray], states: list[np.ndarray], smooth: float = 0.5, paragraphs: float = 0.0, odd: float = 0.02) -> Markov:
    """Counts of labelled sequences with additive smoothing; a turn can only go on in its own role.

    Markers have two chances only: that a turn's own is missing, which is counted, and that a text begins a line as
    if it were marked, ``odd``. ``paragraphs`` is the least share of lines that go on with a turn after a blank line. Roles
    that no label has look like the others.
    """
    start, move = np.full(STATES, smooth), np.full((STATES, STATES), smooth)
    seen = [np.zeros((STATES, k)) for k in SIZES]
    for f, s in zip(feats, states):
        if len(s):
            start[s[0]] += 1
            np.add.at(move, (s[:-1], s[1:]), 1)
            for c in range(len(SIZES)):
                np.add.at(seen[c], (s, f[:, c]), 1)
    strange = [r for r in range(len(ROLES)) if not seen[0][2 * r : 2 * r + 2].any()]
    for r in strange:  # any turn may be followed by one of it, and it by any
        start[2 * r] = odd * start.sum()
        move[:, 2 * r] = odd * move.sum(axis=1)
        move[2 * r : 2 * r + 2, ::2] = 1
        move[2 * r : 2 * r + 2, 2 * r + 1] = len(ROLES)
    start[1::2] = 1e-9
    for a in range(STATES):
        for b in range(1, STATES, 2):
            if a // 2 != b // 2:
                move[a, b] = 1e-9
    emit = []
    for x in seen[1:]:
        x = x + smooth
        for first in (0, 1):
            rows = np.arange(first, STATES, 2)
            x[rows] = np.where((x[rows].sum(axis=1) <= smooth * x.shape[1])[:, None], x[rows].sum(axis=0), x[rows])
        emit.append(x / x.sum(axis=1, keepdims=True))
    after = emit[0][1::2]
    after[:] = np.where(after[:, 1:2] < paragraphs, after * (1 - paragraphs) / (1 - after[:, 1:2]), after)
    after[:, 1] = np.maximum(after[:, 1], paragraphs)
    opens = seen[0][::2]
    lost = (opens[:, 0].sum() + smooth) / (opens.sum() + 2 * smooth)
    mark = np.full((STATES, SIZES[0]), odd / 100)  # of its own style, fewer still
    mark[:, OTHER] = mark[:, FOREIGN] = odd
    mark[:, 0] = 1 - mark[:, 1:].sum(axis=1)
    mark[::2] *= lost
    mark[np.arange(0, STATES, 2), 1 + np.arange(len(ROLES))] += 1 - lost
    return Markov(np.log(start / start.sum()), np.log(move / move.sum(axis=1, keepdims=True)), [np.log(e) for e in (mark, *emit)])


def role_of(name: str | None) -> str | None:
    """The role that a name stands for; None for others than those known."""
    at = _NAMES.get((name or "").strip().lower(), 0)
    return ROLES[at - 1] if at else None


def label(transcript_lines: list[Line], turns: list[tuple[str | None, str]]) -> np.ndarray | None:
    """States of the lines of a transcript that was made of these turns (role, text); None where they don't fit."""
    out = []
    for name, text in turns:
        role = role_of(name)
        if role is None:
            return None
        n = len([x for x in (text or "").split("\n") if x.strip()])
        out += [2 * ROLES.index(role) + (k > 0) for k in range(n)]
    return np.array(out, np.int64) if len(out) == len(transcript_lines) else None


def render(turns: list[tuple[str, str]]) -> str:
    """One canonical form for every conversation. Signs in a text that look like a marker are parted, so nothing in it can open a turn."""
    return "".join(f"<|im_start|>{role}\n{text.replace('<|', '< |')}<|im_end|>\n" for role, text in turns)


def turns_of(transcript: str, lines: list[Line], states: np.ndarray) -> list[tuple[str, str]]:
    """(role, text) of each turn: the transcript's signs from its first line to its last, less the marker that opens it.

    A marker of another role than the turn's, and one on a line that goes on with a turn, is text. So are blank lines
    within a turn; those between turns are not.
    """
    opens = [i for i, s in enumerate(states.tolist()) if s % 2 == 0 or i == 0]
    out = []
    for i, j in zip(opens, [*opens[1:], len(lines)]):
        first, role = lines[i], int(states[i]) // 2
        mine = first.role == role + 1
        text = transcript[first.body if mine else first.whole : lines[j - 1].end]
        if mine and text.endswith(_END) and transcript.startswith("<|im_start|>", first.whole):
            text = text[: -len(_END)]
        out.append((ROLES[role], text))
    return out


def transcripts(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turns, transcript): the raw logs that a table of turns stands for.

    Each conversation has one of six marker styles, and one turn in four lacks its marker, as logs of many origins do.
    Names of roles may be any of those that markers have, in any case; a turn with another role has no marker.
    """
    names = F.create_map(*[F.lit(x) for name, at in _NAMES.items() for x in (name, ROLES[at - 1])])
    conv = q(conv_col)
    one = F.struct(q(turn_col).alias("turn"), q(role_col).cast("string").alias("role"), q(text_col).cast("string").alias("text"))
    grouped = turns.where(conv.isNotNull()).groupBy(conv.alias("conv")).agg(F.array_sort(F.collect_list(one)).alias("turns"))
    style = F.pmod(F.xxhash64("conv", F.lit(11)), F.lit(len(STYLES)))

    def marked(t: Column) -> Column:
        known = F.lit("")
        said = F.try_element_at(names, F.lower(F.trim(t["role"])))
        for i, marks in enumerate(STYLES):
            for role, mark in zip(ROLES, marks):
                known = F.when((style == i) & (said == role), F.lit(mark)).otherwise(known)
        lost = F.pmod(F.xxhash64("conv", t["turn"], F.lit(12)), F.lit(4)) == 0
        return F.concat(F.when(lost, F.lit("")).otherwise(known), F.coalesce(t["text"], F.lit("")))

    gap = F.when(style % 2 == 0, F.lit("\n")).otherwise(F.lit("\n\n"))
    joined = F.aggregate(F.transform("turns", marked), F.lit(None).cast("string"), lambda a, x: F.when(a.isNull(), x).otherwise(F.concat(a, gap, x)))
    return grouped.select("conv", "turns", joined.alias("transcript"))


def sample(turns: DataFrame, most: int, conv_col: str = "conv_id") -> DataFrame:
    """The turns of at most ``most`` conversations, those with the least hash of their id. Ids alone are ranked; whole conversations aren't sorted."""
    conv, name = q(conv_col), hidden(turns, "picked")
    picked = turns.where(conv.isNotNull()).select(conv.alias(name)).distinct().orderBy(F.xxhash64(name), name).limit(most)
    return turns.join(F.broadcast(picked), conv == F.col(name), "left_semi")


def train(rows: DataFrame) -> Either:
    """Models of the (conv, turns, transcript) given, a bounded sample: of the transcripts, and of the same turns with every marker."""
    parts: list[tuple[list[np.ndarray], list[np.ndarray]]] = [([], []), ([], [])]
    for k, r in enumerate(rows.orderBy("conv").toLocalIterator()):
        turns = [(t["role"], t["text"]) for t in r["turns"]]
        marks = dict(zip(ROLES, STYLES[k % len(STYLES)]))
        full = ("\n", "\n\n")[k % 2].join(marks.get(role_of(role), "") + (text or "") for role, text in turns)
        for (feats, states), transcript in zip(parts, (full, r["transcript"] or "")):
            lines, f = lines_of(transcript)
            s = label(lines, turns)
            if s is not None:
                feats.append(f)
                states.append(s)
    return Either([fit(*parts[0], paragraphs=0.1), fit(*parts[1])])


def parse(rows: DataFrame, model: Either, conv_col: str = "conv", transcript_col: str = "transcript") -> DataFrame:
    """(conv_id, roles, n_turns, rendered) of each transcript: roles by Viterbi, then one canonical rendering.

    A turn's text is all between its marker and the last line before the next turn's that has text: blank lines and what looks like
    a marker within it stay, blank lines between turns and markers with nothing after them go. Roles are those of ROLES; speakers by other names
    are text of whichever turn they stand in. Where a text's line begins with a marker of the transcript's own style, the likeliest
    path decides.

    Nulls: a null transcript and one without text have no turns and render as an empty string; a null id is carried.
    Ties between paths go to the first state. Repeated rows are parsed alike. An empty
    table gives an empty one. Other columns, whatever their names, are left aside.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            parsed = [lines_of(t) for t in texts]
            paths = m.viterbi([f for _, f in parsed])
            turns = [turns_of(t, x, s) for t, (x, _), s in zip(texts, parsed, paths)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([[r for r, _ in t] for t in turns], pa.list_(pa.string())), pa.array([len(t) for t in turns], pa.int32()), pa.array([render(t) for t in turns], pa.string())], ["conv_id", "roles", "n_turns", "rendered"])

    kind = rows.schema[conv_col].dataType.simpleString()
    return rows.select(q(conv_col), q(transcript_col).cast("string")).mapInArrow(run, f"conv_id {kind}, roles array<string>, n_turns int, rendered string")


def format_chats(turns: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Canonical renderings of all conversations of a table of turns (conv_id, turn, role, text) by way of their raw transcripts.

    Turns without conversation id belong to no conversation and are left out. Turns go by number (nulls first), then
    by role and text, so repeated turns stand side by side; the model is fitted on at most ``max_labelled`` conversations; a null role, and one
    that is no known name, has no marker and is recovered as the likeliest of ROLES; a null or empty text has no line.
    """
    return parse(transcripts(turns), train(transcripts(sample(turns, max_labelled))))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation with recovered roles in canonical form."""
    return format_chats(read(spark, sf_dir, "conversations"))
