"""Chat formatting: schema fingerprints choose how a record becomes turns.

A record is JSON text. The sorted paths of its nested fields (``a.b``, list items as ``a[]``) are hashed into a
fingerprint; ``LAYOUTS`` maps the fingerprints of known layouts to declarative mappings: where the turns
are, and which paths or constants give role and text. A record of an unknown layout is returned with its fingerprint
and no turns, so that a mapping can be added; it is never dropped.

The template is ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts every ``<|`` gets a backslash between
its two characters (``<\\|`` gets a second one, and so on), hence no control string can appear in them and
unescaping is exact. The loss mask is the text of assistant turns.

Turns are formatted one row each, so a conversation of any length never sits in one row or one Python
object; reading back streams through sorted rows with running digests.

Defined cases: null texts and roles are empty; turns are ordered by turn number (null first), then role and text,
so repeated turn numbers have one order; rows without a conversation id form one conversation.
Lists without items leave no turns. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

START, END = "<|im_start|>", "<|im_end|>"
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
_LOOSE = re.compile(r"<(\\*)\|")
_BOUND = re.compile(r"<\\(\\*)\|")
_PIECE = re.compile(re.escape(START) + "(.*?)\n(.*?)" + re.escape(END) + "\n", re.DOTALL)


# ------------------------------------------------------------------ layouts

@dataclass(frozen=True)
class Mapping:
    """``items``: path of a list of turns, with ``role`` and ``text`` inside each item; without it
    ``turns`` lists (role, paths) pairs, whose non-empty texts are joined by an empty line."""
    paths: tuple[str, ...]
    items: str = ""
    role: str = ""
    text: str = ""
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()[:16]


def field_paths(value, at: str = "") -> set[str]:
    """Paths of the leaves; an empty list or object is a leaf of its own."""
    if isinstance(value, dict) and value:
        return set().union(*[field_paths(v, f"{at}.{k}" if at else k) for k, v in value.items()])
    if isinstance(value, list) and value:
        return set().union(*[field_paths(v, f"{at}[]") for v in value])
    return {at}


MAPPINGS = (
    Mapping(("role", "text"), turns=((":role", ("text",)),)),
    Mapping(("messages[].role", "messages[].content"), "messages", "role", "content"),
    Mapping(("messages[].role", "messages[].text"), "messages", "role", "text"),
    Mapping(("conversations[].from", "conversations[].value"), "conversations", "from", "value"),
    Mapping(("turns[].role", "turns[].text"), "turns", "role", "text"),
    Mapping(("messages[].author.role", "messages[].content.text"), "messages", "author.role", "content.text"),
    Mapping(("prompt", "completion"), turns=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping(("prompt", "response"), turns=(("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping(("question", "answer"), turns=(("user", ("question",)), ("assistant", ("answer",)))),
    Mapping(("instruction", "output"), turns=(("user", ("instruction",)), ("assistant", ("output",)))),
    Mapping(("instruction", "input", "output"),
            turns=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping(("system", "instruction", "output"), turns=(("system", ("system",)), ("user", ("instruction",)),
                                                        ("assistant", ("output",)))),
    Mapping(("system", "prompt", "response"), turns=(("system", ("system",)), ("user", ("prompt",)),
                                                     ("assistant", ("response",)))),
)
LAYOUTS = {fingerprint(m.paths): m for m in MAPPINGS}


def _get(value, path: str):
    for k in path.split("."):
        value = value.get(k) if isinstance(value, dict) else None
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def _role(raw: str) -> str:
    return ROLES.get(raw, raw)


def record_turns(record: str | None, layouts: dict[str, Mapping]) -> tuple[str, list[tuple[str, str]] | None]:
    """(fingerprint, turns); turns are None for an unknown layout or text that is no JSON object."""
    try:
        value = json.loads(record) if record else None
    except ValueError:
        value = None
    if not isinstance(value, dict):
        return "", None
    mark = fingerprint(field_paths(value))
    m = layouts.get(mark)
    if m is None:
        return mark, None
    if m.items:
        return mark, [(_role(_get(x, m.role)), _get(x, m.text)) for x in value[m.items]]
    return mark, [(_role(_get(value, r[1:])) if r.startswith(":") else r,
                   "\n\n".join(t for t in (_get(value, p) for p in paths) if t)) for r, paths in m.turns]


# ------------------------------------------------------------------ template

def escape(text: str) -> str:
    return _LOOSE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _BOUND.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def unescape_role(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """(piece, first and last+1 character of the loss mask; both 0 without one)."""
    head = f"{START}{escape_role(role)}\n"
    body = escape(text)
    if role != "assistant":
        return f"{head}{body}{END}\n", 0, 0
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


_FORMATTED = ("conv_id {kind}, turn {turn}, item int, fingerprint string, piece string, loss_start int, "
              "loss_end int")


def _formatter(layouts: dict[str, Mapping]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = [], []
            for i, record in enumerate(b.column("record").to_pylist()):
                mark, turns = record_turns(record, layouts)
                made = [(j, mark, *format_turn(*t)) for j, t in enumerate(turns or ())]
                made = made or [(None, mark, None, None, None)]
                at += [i] * len(made)
                rows += made
            cols = list(zip(*rows)) or [()] * 5
            kinds = (pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32())
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("conv_id").take(take), b.column("turn").take(take),
                 *[pa.array(c, k) for c, k in zip(cols, kinds)]],
                ["conv_id", "turn", "item", "fingerprint", "piece", "loss_start", "loss_end"])
    return run


def format_records(df: DataFrame, record: str, conv_id: str, turn: str | None = None,
                   layouts: dict[str, Mapping] = LAYOUTS) -> DataFrame:
    """JSON records to formatted turns: conv_id, turn, item (place inside the record), fingerprint, piece
    and its loss mask. Unknown layouts give one row with a null piece. Map-only."""
    place = df[turn] if turn else F.lit(0)
    rows = df.select(df[conv_id].alias("conv_id"), place.alias("turn"), df[record].cast("string").alias("record"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(_formatter(layouts), _FORMATTED.format(kind=kinds["conv_id"], turn=kinds["turn"]))


def format_turn_rows(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                     text: str = "text") -> DataFrame:
    """A table with one row per turn, formatted as records of the layout (role, text)."""
    record = F.to_json(F.struct(F.coalesce(df[role], F.lit("")).alias("role"),
                                F.coalesce(df[text], F.lit("")).alias("text")))
    return format_records(df.select(df[conv_id].alias("conv_id"), df[turn].alias("turn"), record.alias("record")),
                          "record", "conv_id", "turn")


# ------------------------------------------------------------------ reading back

class _Reading:
    """Running digests of one conversation."""

    def __init__(self):
        self.turns, self.chars, self.loss_chars = 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, piece: str, start: int, end: int) -> None:
        found = _PIECE.fullmatch(piece)
        if found is None:
            raise ValueError("a formatted turn does not parse")
        role, text = unescape_role(found[1]), unescape(found[2])
        self.turns += 1
        self.chars += len(piece)
        self.all.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        if end:
            lost = unescape(piece[start:end])
            self.loss_chars += len(lost)
            self.loss.update(lost.encode("utf-8", "surrogatepass"))

    def row(self, key) -> tuple:
        return (key, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [None, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    key, now = None, None

    def out(rows, kind):
        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(c, k or kind) for c, k in zip(cols, kinds)], names)

    kind = None
    for b in batches:
        done, kind = [], b.column("conv_id").type
        for k, piece, s, e in zip(*[b.column(c).to_pylist() for c in ("conv_id", "piece", "loss_start", "loss_end")]):
            if now is None or k != key:
                if now is not None:
                    done.append(now.row(key))
                key, now = k, _Reading()
            now.add(piece, s, e)
        if done:
            yield out(done, kind)
    if now is not None:
        yield out([now.row(key)], kind)


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation: turns, digests, loss and length, read from the formatted turns in order."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    ordered = (formatted.where("piece is not null").repartition("conv_id")
                        .sortWithinPartitions("conv_id", "turn", "item", "piece"))
    return (ordered.select("conv_id", "piece", "loss_start", "loss_end")
                   .mapInArrow(_read, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, "
                                      f"loss_sha256 string, formatted_chars long"))
