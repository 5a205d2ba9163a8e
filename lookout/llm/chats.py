"""Chat formatting: layouts told apart by a hash of their field paths, one template, a loss mask, and the way back.

A record is one conversation as JSON. Its *schema fingerprint* is a hash of its sorted nested field paths (list
positions left out). The fingerprint selects a declarative mapping (where the turns are, which fields are role
and text, which roles are renamed), so a new layout needs a new mapping and no code. Canonical turns are then
rendered with one template:

    <|im_start|>ROLE\\nTEXT<|im_end|>\\n

Control strings inside roles and texts are escaped reversibly: ``<|`` becomes ``<\\|`` and each ``<\\..\\|`` gets one
more backslash. A role's line ends are written as ``%0A`` (and ``%`` as ``%25``). The loss mask is a list of
code-point spans that cover the texts of assistant turns.

Fields that a mapping does not know are left out of its fingerprint, so records with further fields are read as well.

Defined cases: a null role or text is empty, one of another type counts as its JSON text; turns are ordered by turn (null first), role
and text, so ties and repeated rows have one order; a null conversation id is a conversation of its own. A record that cannot be
read (no JSON, no object, no known layout, a turn that is no object, characters that are no text) gives no turns, has no
``layout`` and says why in ``problem``; it never ends the job. A conversation is one formatted value and so meets in one task.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lookout.llm.common import fields, in_arrow, input_columns

# The control strings of the template.
START, END = "<|im_start|>", "<|im_end|>"
MAX_SAMPLE = 64  #: batch rows worked on at a time


def paths(value: object, at: str = "") -> Iterator[str]:
    """The nested field paths of a JSON value; items of a list share one path."""
    if isinstance(value, dict):
        for key, item in value.items():
            yield from paths(item, f"{at}.{key}")
    elif isinstance(value, list):
        for item in value:
            yield from paths(item, f"{at}[]")
        if not value:
            yield f"{at}[]"
    else:
        yield at


def fingerprint(field_paths: Iterable[str]) -> str:
    """The hash of a layout."""
    return hashlib.sha256("\n".join(sorted(set(field_paths))).encode()).hexdigest()[:16]


class Mapping:
    """Where a layout keeps its turns.

    ``turns``: the field with a list of turns, with ``role`` and ``text`` fields in each; or ``single``: pairs of
    a role and the field that holds its only text, in order (absent or null optional fields give no turn).
    ``optional`` paths may be missing from the layout; each choice of them has a fingerprint of its own.
    """

    def __init__(self, name: str, required: list[str], optional: list[str] = (), turns: str = "", role: str = "", text: str = "", single: list[tuple[str, str]] = (), rename: dict[str, str] | None = None):
        self.name, self.required, self.optional = name, list(required), list(optional)
        self.turns, self.role, self.text, self.single, self.rename = turns, role, text, list(single), rename or {}

    def fingerprints(self) -> Iterator[str]:
        for pick in range(1 << len(self.optional)):
            yield fingerprint([*self.required, *(p for i, p in enumerate(self.optional) if pick >> i & 1)])

    def known(self, field_paths: Iterable[str]) -> set[str]:
        """The paths that the mapping knows; what lies below one of them belongs to it."""
        own = [*self.required, *self.optional]
        return {k for p in field_paths for k in own if p == k or p.startswith((f"{k}.", f"{k}[]"))}

    def read(self, record: dict) -> list[tuple[str, str]]:
        if self.single:
            found = [(role, record.get(field)) for role, field in self.single]
            return [(role, as_text(text)) for role, text in found if text is not None]
        turns = [(as_text(t.get(self.role)), as_text(t.get(self.text))) if isinstance(t, dict) else None for t in record[self.turns]]
        if None in turns:
            raise Unreadable("a turn is no object")
        return [(self.rename.get(role, role), text) for role, text in turns]


class Unreadable(ValueError):
    """Why a record has no turns."""


def as_text(value: object) -> str:
    if value is None or isinstance(value, str):
        return value or ""
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


SHARED = {"human": "user", "gpt": "assistant", "bot": "assistant"}
MAPPINGS = (
    Mapping("messages", [".messages[].role", ".messages[].content"], [".id"], turns="messages", role="role", text="content"),
    Mapping("turns", [".turns[].role", ".turns[].text"], [".conv_id", ".turns[].turn"], turns="turns", role="role", text="text"),
    Mapping("from_value", [".conversations[].from", ".conversations[].value"], [".id"], turns="conversations", role="from", text="value", rename=SHARED),
    Mapping("prompt", [".prompt", ".completion"], [".id"], single=[("user", "prompt"), ("assistant", "completion")]),
    Mapping("instruction", [".instruction", ".output"], [".id", ".input", ".system"], single=[("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output")]),
)


class Layouts:
    """Finds the mapping of a record by fingerprints: of the fields a mapping knows, once for each set of field paths."""

    def __init__(self, mappings: Iterable[Mapping]):
        self.mappings = [(m, set(m.fingerprints())) for m in mappings]
        self.seen: dict[str, Mapping | None] = {}

    def of(self, record: dict) -> Mapping | None:
        found = set(paths(record))
        whole = fingerprint(found)
        if whole not in self.seen:
            if len(self.seen) > 10_000:
                self.seen.clear()
            self.seen[whole] = next((m for m, prints in self.mappings if fingerprint(m.known(found)) in prints), None)
        return self.seen[whole]

    def turns(self, text: str | None) -> tuple[str, list[tuple[str, str]]]:
        """The layout and the turns of a record."""
        try:
            record = json.loads(text or "")
        except (ValueError, RecursionError):
            raise Unreadable("not JSON") from None
        if not isinstance(record, dict):
            raise Unreadable("no object")
        try:
            mapping = self.of(record)
            if mapping is None:
                raise Unreadable("no known layout")
            turns = mapping.read(record)
            "".join(part for turn in turns for part in turn).encode()
        except (UnicodeEncodeError, RecursionError):
            raise Unreadable("characters that are no text") from None
        return mapping.name, turns


def escaped(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescaped(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def role_line(role: str) -> str:
    return escaped(role.replace("%", "%25").replace("\n", "%0A"))


def role_read(line: str) -> str:
    return unescaped(line).replace("%0A", "\n").replace("%25", "%")


def rendered(turns: list[tuple[str, str]], trained: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the code-point spans under the loss."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{role_line(role)}\n", escaped(text)
        if role == trained:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    out, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise ValueError(f"no turn starts at {at}")
        line = formatted.index("\n", at)
        stop = formatted.index(END, line + 1)
        out.append((role_read(formatted[at + len(START) : line]), unescaped(formatted[line + 1 : stop])))
        at = stop + len(END) + 1
    return out


def masked_text(formatted: str, spans: Iterable[tuple[int, int]]) -> list[str]:
    return [unescaped(formatted[a:b]) for a, b in spans]


# How records are written, by layout: the list of turns, role and text in it, and fields besides that no mapping knows.
WRITTEN = {"turns": ("turns", "role", "text"), "messages": ("messages", "role", "content"), "from_value": ("conversations", "from", "value")}


def records_of(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", layouts: tuple[str, ...] = ("turns",)) -> DataFrame:
    """One JSON record per conversation from a table of turns, the layouts dealt out by a hash of the id.

    Roles that a layout would rename keep their conversation in the layout ``turns``.
    """
    rows = input_columns(rows, conv_id=conv_id, turn=turn, role=role, text=text)
    turns = F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))))
    grouped = rows.groupBy("conv_id").agg(turns.alias("turns"))
    renamed = F.exists("turns", lambda t: t["role"].isin(*SHARED))
    pick = F.when(renamed, F.lit("turns")).otherwise(F.element_at(F.array(*map(F.lit, layouts)), (F.pmod(F.xxhash64("conv_id"), F.lit(len(layouts))) + 1).cast("int")))
    record = F.lit(None).cast("string")
    for layout in {*layouts, "turns"}:
        name, role_as, text_as = WRITTEN[layout]
        found = F.transform("turns", lambda t: F.struct(t["role"].alias(role_as), t["text"].alias(text_as)))
        record = F.when(pick == layout, F.to_json(F.struct(found.alias(name)))).otherwise(record)
    return grouped.select("conv_id", record.alias("record"))


FORMATTED = "conv_id long, layout string, formatted string, loss array<struct<begin: long, end: long>>, problem string"


def format_chats(records: DataFrame, mappings: Iterable[Mapping] = MAPPINGS) -> DataFrame:
    """``records`` (conv_id, record) as conv_id, layout, formatted, loss spans and, for records that cannot be read, the problem."""
    mappings, out = tuple(mappings), fields(FORMATTED)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layouts = Layouts(mappings)
        for whole in batches:
            for start in range(0, whole.num_rows, MAX_SAMPLE):
                batch = whole.slice(start, MAX_SAMPLE)
                rows = []
                for conv, text in zip(batch.column("conv_id").to_pylist(), batch.column("record").to_pylist(), strict=True):
                    try:
                        (layout, turns), problem = layouts.turns(text), None
                    except Unreadable as e:
                        layout, turns, problem = None, [], str(e)
                    formatted, spans = rendered(turns)
                    rows.append({"conv_id": conv, "layout": layout, "formatted": formatted, "loss": [{"begin": a, "end": b} for a, b in spans], "problem": problem})
                yield pa.RecordBatch.from_pylist(rows, schema=out)

    return in_arrow(records.select("conv_id", "record"), work, FORMATTED)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted text says, read back from it."""
    out = fields(DIGESTS)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, MAX_SAMPLE):
                rows = []
                for row in whole.slice(start, MAX_SAMPLE).to_pylist():
                    turns = read_back(row["formatted"])
                    loss = "".join(masked_text(row["formatted"], ((s["begin"], s["end"]) for s in row["loss"])))
                    rows.append(
                        {
                            "conv_id": row["conv_id"],
                            "n_turns": len(turns),
                            "turns_sha256": hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(),
                            "loss_chars": len(loss),
                            "loss_sha256": hashlib.sha256(loss.encode()).hexdigest(),
                            "formatted_chars": len(row["formatted"]),
                        }
                    )
                yield pa.RecordBatch.from_pylist(rows, schema=out)

    return in_arrow(formatted.select("conv_id", "formatted", "loss"), work, DIGESTS)
