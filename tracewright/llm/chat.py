"""Chat formatting with schema fingerprints.

A record's nested field paths (`messages[].role`, `instruction`, ..) are sorted
and hashed; the hash selects a declarative mapping into canonical turns (role,
text). Turns are written as

    <|im_start|>role\\ntext<|im_end|>\\n

where each `<` + any number of `~` + `|` inside a text gets one more `~`, so no
text can hold a control string and the reading is exact. Turns of assistants
are under the loss mask. A conversation is the segments of its turns in order;
digests are folded over them, so that a long conversation isn't held at once.

Defined cases: a null text or role is empty; rows of a conversation are ordered
by turn (nulls first), ties by role and then by text, repeated rows count each
time; rows of a null conversation are one conversation; an empty table gives
only what is added; extra columns aren't read; fields of a record that no
layout is known by (EXTRAS) are passed over; a record of unknown layout, null or
no JSON goes to the rejects, counted by fingerprint; an empty list of messages
has no turns.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, LOSS_ROLE = "<|im_start|>", "<|im_end|>", "assistant"

#: Layouts: a record's paths, and where its turns are. `each` walks an array ("": the record itself); (role, path) gives one turn; a role "=path" is read from the record; a path ending in "?" may be missing, and its turn goes where it is.
LAYOUTS = {
    "turn row": {"paths": ["role", "text?"], "turns": [("=role", ["text"])]},
    "messages": {"paths": ["messages[].content?", "messages[].role"], "each": "messages", "turns": [("=role", ["content"])]},
    "no messages": {"paths": ["messages[]"], "each": "messages", "turns": []},
    "bare messages": {"paths": ["[].content?", "[].role"], "each": "", "turns": [("=role", ["content"])]},
    "system and messages": {"paths": ["messages[].content?", "messages[].role", "system"], "first": [("system", ["system"])], "each": "messages", "turns": [("=role", ["content"])]},
    "from and value": {"paths": ["conversations[].from", "conversations[].value?", "system?"], "first": [("system", ["system"])], "each": "conversations", "turns": [("=from", ["value"])], "roles": {"human": "user", "gpt": "assistant", "bot": "assistant"}},
    "no conversations": {"paths": ["conversations[]"], "each": "conversations", "turns": []},
    "prompt and response": {"paths": ["prompt", "response", "system?"], "turns": [("system", ["system"]), ("user", ["prompt"]), ("assistant", ["response"])]},
    "prompt and completion": {"paths": ["completion", "prompt", "system?"], "turns": [("system", ["system"]), ("user", ["prompt"]), ("assistant", ["completion"])]},
    "instruction and output": {"paths": ["input?", "instruction", "output", "system?"], "turns": [("system", ["system"]), ("user", ["instruction", "input"]), ("assistant", ["output"])]},
    "question and answer": {"paths": ["answer", "question", "system?"], "turns": [("system", ["system"]), ("user", ["question"]), ("assistant", ["answer"])]},
}
#: Fields that no layout is known by, at the top of a record and beside a turn's fields.
EXTRAS = frozenset("id uuid name source lang language category tags metadata meta weight score created timestamp model".split())


#: Lists whose elements are turns, as paths.
TURN_LISTS = frozenset(f"{layout['each']}[]" for layout in LAYOUTS.values() if "each" in layout)


def paths(record, at: str = "") -> set[str]:
    """Nested field paths of a parsed JSON value; `[]` stands for any element, or for none.

    EXTRAS are left out of the record itself, whatever they hold, and beside a
    turn's fields where they hold a plain value. Anywhere else they count: what is
    nested in a turn or in another field is content, and makes a layout of its own.
    """
    if isinstance(record, dict):
        extra = lambda k, v: k in EXTRAS and (at == "" or (at in TURN_LISTS and not isinstance(v, (dict, list))))
        return {p for k, v in record.items() if not extra(k, v) for p in paths(v, f"{at}.{k}" if at else k)}
    if isinstance(record, list):
        return {p for v in record for p in paths(v, f"{at}[]")} if record else {f"{at}[]"}
    return {at}


def schema_fingerprint(found: set[str] | list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:16]


def variants(layout: dict) -> list[frozenset[str]]:
    """The sets of paths of a layout, with and without what may be missing."""
    sets = [frozenset()]
    for p in layout["paths"]:
        sets = [s | {p.rstrip("?")} for s in sets] + (sets if p.endswith("?") else [])
    return sets


MAPPINGS = {schema_fingerprint(v): layout for layout in LAYOUTS.values() for v in variants(layout)}


class UnknownLayout(ValueError):
    def __init__(self, found: set[str]):
        self.fields, self.fingerprint = sorted(found), schema_fingerprint(found)
        super().__init__(f"no mapping for the fields {self.fields}")


def turns_of(record, layout: dict) -> list[tuple[str, str]]:
    roles, turns = layout.get("roles", {}), []
    items = (record[layout["each"]] if layout["each"] else record) if "each" in layout else [record]
    for item, wanted in [(record, layout.get("first", ())), *((i, layout["turns"]) for i in items)]:
        for role, fields in wanted:
            if role[0] != "=" and not any(f in item for f in fields):
                continue
            role = (item.get(role[1:]) or "") if role[0] == "=" else role
            texts = [x if isinstance(x, str) else json.dumps(x) for f in fields if (x := item.get(f)) not in (None, "")]
            turns.append((roles.get(role, str(role)), "\n".join(texts)))
    return turns


def canonical(record, mappings: dict[str, dict] | None = None, known: dict[frozenset, dict | None] | None = None) -> list[tuple[str, str]]:
    """(role, text) of each turn of a record; known remembers the mapping of sets of paths met before."""
    found = frozenset(paths(record))
    known = {} if known is None else known
    if found not in known:
        known[found] = (MAPPINGS if mappings is None else mappings).get(schema_fingerprint(found))
    if known[found] is None:
        raise UnknownLayout(found)
    return turns_of(record, known[found])


def escape(text: str) -> str:
    return re.sub(r"<(~*)\|", r"<~\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<~(~*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def format_turn(role: str, text: str) -> str:
    return f"{START}{escape_role(role)}\n{escape(text)}{END}\n"


SEGMENT = re.compile(rf"{re.escape(START)}([^\n]*)\n(.*?){re.escape(END)}\n", re.S)


def read_turns(formatted: str) -> list[tuple[str, str, tuple[int, int] | None]]:
    """(role, text, span under the loss mask) of each turn of a formatted text; the span is in code points of that text, as it stands there."""
    turns, at = [], 0
    while at < len(formatted):
        m = SEGMENT.match(formatted, at)
        if m is None:
            raise ValueError(f"not a turn at {at}")
        role = unescape_role(m[1])
        turns.append((role, unescape(m[2]), m.span(2) if role == LOSS_ROLE else None))
        at = m.end()
    return turns


def read_records(df: DataFrame, record: str, keep: list[str]) -> DataFrame:
    """The columns keep of every row, and `segment`: the formatted turns of the JSON record in column record, any layout of LAYOUTS, mixed as they come.

    Where no layout fits (or the record is null or no JSON), segment is null, and
    fingerprint and fields say what was met.
    """
    names = [f"c{i}" for i in range(len(keep))]
    source = df.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)), F.col(f"`{record}`").alias("r"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[frozenset, dict | None] = {}
        for batch in batches:
            *kept, records = batch.columns
            out = []
            for r in records.to_pylist():
                try:
                    out.append(("".join(format_turn(*turn) for turn in canonical(json.loads(r or ""), None, known)), None, None))
                except UnknownLayout as e:
                    out.append((None, e.fingerprint, ", ".join(e.fields)))
                except json.JSONDecodeError:
                    out.append((None, "", "no JSON"))
            columns = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c, pa.string()) for c in columns)], [*names, "segment", "fingerprint", "fields"])

    made = source.mapInArrow(run, source.select(*names).schema.add("segment", "string").add("fingerprint", "string").add("fields", "string"))
    return made.select(*(F.col(n).alias(c) for n, c in zip(names, keep, strict=True)), "segment", "fingerprint", "fields")


def format_records(df: DataFrame, record: str, keep: list[str]) -> DataFrame:
    """The columns keep and segment of the rows whose layout is known."""
    return read_records(df, record, keep).filter("segment IS NOT NULL").drop("fingerprint", "fields")


def rejects(df: DataFrame, record: str) -> DataFrame:
    """Layouts that no mapping knows: fingerprint, fields and how many records have them."""
    return read_records(df, record, []).filter("segment IS NULL").groupBy("fingerprint", "fields").agg(F.count("*").alias("n_records"))


def turn_record(role: Column, text: Column) -> Column:
    """A row by turn as a JSON record."""
    return F.to_json(F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text")))


def message_record(turns: list[tuple[str, str]]) -> str:
    return json.dumps({"messages": [{"role": r, "content": t} for r, t in turns]})


def format_conversations(turns: DataFrame, added: list[tuple[int, str]] = ()) -> DataFrame:
    """(conv_id, turn, segment) of rows by turn, and of added (conv_id, JSON record)."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), turn_record(F.col("role"), F.col("text")).alias("record"))
    if added:
        more = turns.sparkSession.createDataFrame([(i, 0, r) for i, r in added], "conv_id long, turn long, record string")
        rows = rows.unionByName(more)
    return format_records(rows, "record", ["conv_id", "turn"])


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, read back from the segments in order.

    Conversations are dealt by id and sorted, ties by role and text as read from
    the segment, which alone is dealt out; one streams through its task row by
    row, with two running digests as all that is held.
    """
    n = int(formatted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    line = F.instr("segment", "\n")
    text = F.regexp_replace(F.substring(F.col("segment"), line + 1, F.length("segment")), r"<~(~*)\|", "<$1|")
    dealt = formatted.select("conv_id", "turn", "segment").repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", F.substring(F.col("segment"), F.lit(1), line), text).select("conv_id", "segment")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flushed(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        now, rows = None, []
        for batch in batches:
            for conv, segment in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if now is None or conv != now[0]:
                    if now is not None:
                        rows.append((now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]))
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text, loss in read_turns(segment):
                    now[1] += 1
                    now[2].update(f"{role}\n{text}\n".encode())
                    if loss is not None:
                        under = unescape(segment[loss[0] : loss[1]])
                        now[3] += len(under)
                        now[4].update(under.encode())
                now[5] += len(segment)
            if len(rows) > 5000:
                yield flushed(rows)
                rows = []
        if now is not None:
            rows.append((now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]))
        if rows:
            yield flushed(rows)

    return dealt.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
