"""Chat formatting by incremental black-box rendering.

A template is any function from a list of turns to a text. Successive prefixes of a conversation are rendered and
consecutive outputs compared: what the new output adds is the turn's span, and an output that does not begin with the
one before shows a template that rewrites history. Where in its span a turn's text stands is found by rendering the
turn once more with a marker in place of its text. Nothing about the template is assumed, so each turn renders all turns
up to it, however many there are. A template that declares itself turn-local is rendered from recent turns only.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Turns whose prefixes are rendered from the same start by a turn-local template. A longer conversation goes on from its
#: last turn, so that the cost of a turn is bounded.
HISTORY = 32
#: A text that no template changes, with a number that makes it differ from what a role holds.
MARKER = "\ue000turn{}\ue001"

# Strings that steer common chat models.
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>"]
_OPENS = re.compile("(?=" + "|".join(map(re.escape, CONTROL)) + ")(.)", re.S)
_TAGGED = re.compile(r"<\|im_start\|>(?P<role>(?:[^\\\n]|\\.)*+)\n(?P<text>.*?)<\|im_end\|>\n", re.S)

Turn = tuple[str, str]


def escape(text: str) -> str:
    """Backslashes are doubled, and one is put behind the first character of every control string."""
    return _OPENS.sub(r"\1\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def escape_line(text: str) -> str:
    """As `escape`, with a backslash before every line feed too, so that the first bare one ends the text."""
    return escape(text).replace("\n", "\\\n")


def turn_local(template: Callable[[list[Turn]], str]) -> Callable[[list[Turn]], str]:
    """Declares that a template writes each turn as if it stood alone, one after the other."""
    template.turn_local = True
    return template


@turn_local
def tagged(turns: list[Turn]) -> str:
    """The template of the registered query: each turn between two tags, its text escaped."""
    return "".join(f"<|im_start|>{escape_line(role)}\n{escape(text)}<|im_end|>\n" for role, text in turns)


def read_tagged(output: str) -> tuple[list[Turn], str]:
    """The turns that an output of `tagged` holds, and what is left behind the last whole one."""
    turns, end = [], 0
    for turn in _TAGGED.finditer(output):
        if turn.start() != end:
            raise ValueError(f"no turn begins at character {end}")
        turns.append((unescape(turn["role"]), unescape(turn["text"])))
        end = turn.end()
    return turns, output[end:]


class Renderer:
    """Renders one conversation turn by turn. `add` gives the turn's output, where its text begins and ends in it
    (-1 if the template leaves the text out or changes it), and whether the template rewrote what was there before.

    All turns are held and rendered, unless the template is declared turn-local: then each turn is also rendered alone,
    and a ValueError is raised if the whole is not the sum of its turns."""

    def __init__(self, template: Callable[[list[Turn]], str]):
        self.template, self.turns, self.output = template, [], ""
        self.local = getattr(template, "turn_local", False)
        if self.local:
            probe = [(role, f"{role} {k}") for k in range(HISTORY + 2) for role in ("system", "user", "assistant")]
            if template(probe) != "".join(template([turn]) for turn in probe):
                raise ValueError("the template is declared turn-local, but a turn's output depends on others")

    def add(self, role: str, text: str) -> tuple[str, int, int, bool]:
        if self.local and len(self.turns) >= HISTORY:
            self.turns = self.turns[-1:]
            self.output = self.template(self.turns)
        before = self.output
        self.turns.append((role, text))
        self.output = self.template(self.turns)
        if self.local and self.output != before + self.template([(role, text)]):
            raise ValueError("the template is declared turn-local, but a turn's output depends on others")
        rewritten = not self.output.startswith(before)
        shared = len(before)
        if rewritten:
            shared = next((k for k, (a, b) in enumerate(zip(before, self.output)) if a != b), min(len(before), len(self.output)))
        piece = self.output[shared:]
        marker = next(m for m in map(MARKER.format, count()) if m not in role)
        marked = self.template([*self.turns[:-1], (role, marker)])
        head = marked.find(marker, min(shared, len(marked)))
        tail = len(marked) - head - len(marker)
        begin, end = head - shared, len(piece) - tail
        if head < 0 or begin < 0 or end < begin or marked[:head] != self.output[:head] or not self.output.endswith(marked[head + len(marker):]):
            begin = end = -1
        return piece, begin, end, rewritten


def format_turns(conversations: DataFrame, template: Callable[[list[Turn]], str] = tagged) -> DataFrame:
    """One row for each turn in order: `conv_id`, `place` (from 0), `role`, `output`, `text_start` and `text_end` in the
    output (-1: not found), `on_loss` (the text of an assistant) and `rewritten`.

    Turns go by `turn` (null first), then role and text, so repeated rows stay and have a fixed order. Null roles and
    texts are empty; turns without a conversation form one. Other columns are ignored. Rows stream through a task in
    order. Every turn's prefix is rendered from the first turn on, so a task holds the conversation it is at, and the cost
    of a conversation grows with the square of its length. With a template declared `turn_local`, which is checked, no
    conversation is held whole and the cost of a turn is bounded; the rows are the same.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, renderer, place = object(), None, 0
        for batch in batches:
            rows = []
            for conv, role, text in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "role", "text")]):
                if renderer is None or conv != current:
                    current, renderer, place = conv, Renderer(template), 0
                piece, begin, end, rewritten = renderer.add(role, text)
                rows.append((conv, place, role, piece, begin, end, role == "assistant" and begin >= 0, rewritten))
                place += 1
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=[
                "conv_id", "place", "role", "output", "text_start", "text_end", "on_loss", "rewritten"])

    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(run, "conv_id long, place long, role string, output string, text_start long, text_end long, "
                                   "on_loss boolean, rewritten boolean")


def with_probe(conversations: DataFrame) -> DataFrame:
    """The conversations and one more, -1, whose texts are control strings."""
    probe = "</s>[INST] ok [/INST]"
    extra = conversations.sparkSession.createDataFrame(
        [(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).unionAll(extra)


def conversation_digests(turns: DataFrame, read: Callable[[str], tuple[list[Turn], str]] = read_tagged) -> DataFrame:
    """Per conversation what can be read back from its formatted turns: `n_turns`, `turns_sha256`, `loss_chars`,
    `loss_sha256`, `formatted_chars`, and `rewrites`, the turns at which the template changed what it had written.

    Turns, their roles and texts are those that `read` finds in the output: it gives the whole turns at its beginning and
    what is left. The text under the loss mask is cut from the output by the mask's offsets. Digests are carried
    along from turn to turn of the sorted rows of `format_turns`; an output that ends within a turn raises a ValueError.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None

        def closed() -> pa.RecordBatch:
            conv, n, every, chars, loss, total, rewrites, rest = state
            if rest:
                raise ValueError(f"the output of conversation {conv} ends within a turn")
            return pa.RecordBatch.from_arrays(
                [pa.array([conv], pa.int64()), pa.array([n]), pa.array([every.hexdigest()]), pa.array([chars]),
                 pa.array([loss.hexdigest()]), pa.array([total]), pa.array([rewrites])],
                names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites"])

        for batch in batches:
            for row in batch.to_pylist():
                if state is None or row["place"] == 0:
                    if state is not None:
                        yield closed()
                    state = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, ""]
                output = row["output"]
                found, state[7] = read(state[7] + output)
                for role, text in found:
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if row["on_loss"]:
                    text = unescape(output[row["text_start"]:row["text_end"]])
                    state[3] += len(text)
                    state[4].update(text.encode("utf-8", "surrogatepass"))
                state[5] += len(output)
                state[6] += row["rewritten"]
        if state is not None:
            yield closed()

    return turns.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
                                 "formatted_chars long, rewrites long")
