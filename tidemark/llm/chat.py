"""Chat formatting: a finite-state machine over roles emits text segments with loss flags.

A template names the marks around a turn, the roles whose text is learned and, for every
state, which role may follow. Texts cannot forge marks: a control string inside a text is
broken by a backslash after its first character, and backslashes are doubled, so that the
text can be read back. Conversations are streamed turn by turn through tasks; one of any
length needs the memory of one turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks and order of turns. `{role}` in `open` is replaced by the escaped role."""

    open: str = "### {role}:\n"
    close: str = "</turn>\n"
    learned: frozenset[str] = frozenset({"assistant"})
    shown: dict[str, str] = field(
        default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"}
    )
    # State: the roles that may come next. A state is the role before, "" at the start.
    follows: dict[str, frozenset[str]] = field(
        default_factory=lambda: {
            "": frozenset({"system", "user"}),
            "system": frozenset({"user"}),
            "user": frozenset({"assistant"}),
            "assistant": frozenset({"user"}),
        }
    )

    @property
    def controls(self) -> list[str]:
        """Strings that texts must not contain: what opens and what closes a turn."""
        return [self.open.split("{role}")[0], self.close.rstrip("\n")]


def escaper(template: Template):
    found = re.compile("|".join(map(re.escape, ["\\", *template.controls])))

    def escape(text: str) -> str:
        return found.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)

    return escape


# In role names, characters that could be read as a mark are a backslash and a letter.
_ROLE_MARKS = {"\\": "b", ":": "c", "\n": "n", "#": "h", "<": "l"}


def _role_label(role: str) -> str:
    return "=" + re.sub(r"[\\:\n#<]", lambda m: "\\" + _ROLE_MARKS[m[0]], role)


def _role_of(label: str) -> str:
    back = {v: k for k, v in _ROLE_MARKS.items()}
    return re.sub(r"\\(.)", lambda m: back[m[1]], label[1:])


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


@dataclass
class Segment:
    text: str
    loss: bool
    valid: bool


def format_turns(turns: Iterable[tuple[str, str]], template: Template) -> Iterator[Segment]:
    """Segments of one conversation: opening mark, text, closing mark of every turn.

    `valid` is False from the first turn on whose role may not follow the one before.
    """
    escape, state, valid = escaper(template), "", True
    before, after = template.open.split("{role}")
    for role, text in turns:
        valid = valid and role in template.follows.get(state, ())
        state = role
        # A role without a display name is written out, marked so that it is not mistaken.
        label = template.shown.get(role) or _role_label(role)
        yield Segment(f"{before}{label}{after}", False, valid)
        yield Segment(escape(text), role in template.learned, valid)
        yield Segment(template.close, False, valid)


def parse_turns(formatted: Iterable[str], template: Template) -> Iterator[tuple[str, str]]:
    """Turns read back from formatted text that comes one turn at a time."""
    before, after = template.open.split("{role}")
    roles = {v: k for k, v in template.shown.items()}
    for turn in formatted:
        if not (turn.startswith(before) and turn.endswith(template.close)):
            raise ValueError("not a formatted turn")
        label, _, rest = turn[len(before) :].partition(after)
        role = _role_of(label) if label.startswith("=") else roles[label]
        yield role, unescape(rest[: -len(template.close)])


SEGMENTS = "conv_id long, turn long, position long, segment int, text string, loss boolean, valid boolean"


def in_order(turns: DataFrame) -> DataFrame:
    """All turns of a conversation in one partition, in order: turn, then role, then text."""
    rows = turns.select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _conversations(batches: Iterator[pa.RecordBatch], columns: list[str]):
    """(conv_id, iterator of rows) of sorted batches. Rows are tuples of the other columns."""

    def rows():
        for batch in batches:
            yield from zip(batch["conv_id"].to_pylist(), *(batch[c].to_pylist() for c in columns))

    from itertools import groupby

    for conv_id, group in groupby(rows(), key=lambda r: r[0]):
        yield conv_id, (r[1:] for r in group)


def _batched(rows: Iterator[tuple], schema: pa.Schema, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of rows, closed by the size of their strings."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(x) for x in row if isinstance(x, str))
        if size > limit:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def segments(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """Formatted conversations as segments with loss flags; three rows per turn.

    Defined cases: a null text or role is empty, a null conv_id is a conversation of its own,
    rows of the same turn follow by role and text, equal rows each are a turn, a turn out of
    order is formatted all the same and flagged, other columns are ignored.
    """
    template = template or Template()
    schema = pa.schema(
        [("conv_id", pa.int64()), ("turn", pa.int64()), ("position", pa.int64()), ("segment", pa.int32()),
         ("text", pa.string()), ("loss", pa.bool_()), ("valid", pa.bool_())]
    )

    def run(batches):
        def rows():
            for conv_id, turns_ in _conversations(batches, ["turn", "role", "text"]):
                numbers = []

                def seen(turns_=turns_, numbers=numbers):
                    for turn, role, text in turns_:
                        numbers[:] = [turn]
                        yield role, text

                for at, s in enumerate(format_turns(seen(), template)):
                    yield conv_id, numbers[0], at // 3, at % 3, s.text, s.loss, s.valid

        return _batched(rows(), schema)

    return in_order(turns).mapInArrow(run, SEGMENTS)


DIGEST = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
    "formatted_chars long, valid boolean"
)


def digests(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """What formatted conversations say when read back, one row per conversation."""
    template = template or Template()
    schema = pa.schema(
        [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
         ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_())]
    )

    def one(conv_id, parts):
        turns, learned = hashlib.sha256(), hashlib.sha256()
        n = loss_chars = chars = 0
        valid, held = True, ""
        for segment, text, loss, ok in parts:
            chars += len(text)
            held += text
            valid = valid and ok
            if loss:
                plain = unescape(text)
                loss_chars += len(plain)
                learned.update(plain.encode())
            if segment == 2:
                for role, plain in parse_turns([held], template):
                    turns.update(f"{role}\n{plain}\n".encode())
                n, held = n + 1, ""
        return conv_id, n, turns.hexdigest(), loss_chars, learned.hexdigest(), chars, valid

    def run(batches):
        rows = (one(c, p) for c, p in _conversations(batches, ["segment", "text", "loss", "valid"]))
        return _batched(rows, schema)

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "position", "segment")
    return ordered.mapInArrow(run, DIGEST)
