"""Chat formatting by schema fingerprints.

The nested field paths of a table or record, restricted to those any declared layout uses, are hashed; the hash selects a declarative mapping
that turns the layout (turn rows, message lists, prompt and response, instruction and output, ...) into
canonical turns: conv_id, turn, role, text.  Tables are mapped by their schema, in DataFrame functions; JSON
records each by their own fields.

Turns are then formatted one by one.  A turn reads ``<|turn|>role<|text|>text<|end|>``; inside role and text every ``<``,
``[`` and backslash is followed or preceded by a backslash, so no control string of this or the usual
templates survives in them, and undoing it gives the text back.  The loss mask covers the text of assistant turns.
"""

from __future__ import annotations

import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: layouts: id, and either a list of turns with the paths of role and text in it, or (role, path) pairs
LAYOUTS = {
    "turn rows": {"id": "conv_id", "turn": "turn", "role": "role", "text": "text"},
    "messages": {"id": "conv_id", "list": "messages", "role": "role", "text": "content"},
    "shared conversations": {"id": "id", "list": "conversations", "role": "from", "text": "value",
                             "roles": {"human": "user", "gpt": "assistant"}},
    "nested dialog": {"id": "id", "list": "dialog.turns", "role": "speaker.role", "text": "utterance"},
    "prompt and response": {"id": "id", "fields": [("user", "prompt"), ("assistant", "response")]},
    "system prompt and completion": {"id": "id", "fields": [("system", "system"), ("user", "prompt"), ("assistant", "completion")]},
    "instruction and output": {"id": "id", "fields": [("user", "instruction"), ("assistant", "output")]},
    "instruction, input and output": {"id": "id", "fields": [("user", ["instruction", "input"]), ("assistant", "output")]},
    "question and answer": {"id": "id", "fields": [("user", "question"), ("assistant", "answer")]},
}
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"


def _layout_paths(spec: dict) -> set[str]:
    """The paths a layout needs; the id is optional."""
    if "list" in spec:
        return {f"{spec['list']}[].{spec['role']}", f"{spec['list']}[].{spec['text']}"}
    if "fields" in spec:
        return {p for _, path in spec["fields"] for p in ([path] if isinstance(path, str) else path)}
    return {spec["turn"], spec["role"], spec["text"]}


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


KNOWN = set().union(*map(_layout_paths, LAYOUTS.values()))
BY_FINGERPRINT = {fingerprint(_layout_paths(spec)): name for name, spec in LAYOUTS.items()}


def schema_paths(kind: T.DataType, at: str = "") -> set[str]:
    """Paths of the leaves of a type; [] stands for an array's elements."""
    if isinstance(kind, T.StructType):
        return {p for f in kind.fields for p in schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)}
    return schema_paths(kind.elementType, at + "[]") if isinstance(kind, T.ArrayType) else {at}


def record_paths(value, at: str = "") -> set[str]:
    """Paths of the leaves of a decoded JSON value."""
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in record_paths(v, f"{at}.{k}" if at else k)}
    if isinstance(value, list):
        return {p for v in value for p in record_paths(v, at + "[]")}
    return {at}


def select_layout(paths: set[str]) -> str | None:
    """Name of the layout of these paths: by the hash of those that layouts use, else the layout that uses most of
    them and misses none; None if there is none."""
    name = BY_FINGERPRINT.get(fingerprint(paths & KNOWN))
    if name is None:
        fits = [(len(_layout_paths(s)), n) for n, s in LAYOUTS.items() if _layout_paths(s) <= paths]
        name = max(fits)[1] if fits else None
    return name


def canonical_turns(df: DataFrame) -> DataFrame:
    """Canonical turns of a table in any declared layout: conv_id, turn, role, text.

    Null roles and texts become empty; rows without an id keep a null one; turns of lists and fields are numbered from 0;
    empty or null lists give no turn, null fields no turn of theirs.  An unknown layout is a ValueError."""
    name = select_layout(schema_paths(df.schema))
    if name is None:
        raise ValueError("no declared layout has these fields: " + ", ".join(sorted(schema_paths(df.schema))))
    spec = LAYOUTS[name]
    own = F.col(spec["id"]).cast("long") if spec["id"] in df.columns else F.lit(None).cast("long")
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    if "turn" in spec:
        return df.select(own.alias("conv_id"), F.col(spec["turn"]).cast("long").alias("turn"),
                         text(F.col(spec["role"])).alias("role"), text(F.col(spec["text"])).alias("text"))
    if "list" in spec:
        turns = df.select(own.alias("conv_id"), F.posexplode(F.col(spec["list"])).alias("turn", "m"))
        role = text(F.col("m." + spec["role"]))
        for old, new in spec.get("roles", {}).items():
            role = F.when(role == old, new).otherwise(role)
        return turns.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"),
                            text(F.col("m." + spec["text"])).alias("text"))
    parts = []
    for role, path in spec["fields"]:
        own_text = F.col(path).cast("string") if isinstance(path, str) else F.concat_ws(
            "\n", *(F.when(F.length(F.col(p).cast("string")) > 0, F.col(p).cast("string")) for p in path))
        parts.append(F.when(own_text.isNotNull(), F.struct(F.lit(role).alias("role"), own_text.alias("text"))))
    turns = df.select(own.alias("conv_id"), F.posexplode(F.array_compact(F.array(*parts))).alias("turn", "m"))
    return turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "m.role", "m.text")


def _record_turns(record) -> list[tuple[str, str]] | None:
    name = select_layout(record_paths(record)) if isinstance(record, dict) else None
    if name is None:
        return None
    spec = LAYOUTS[name]

    def get(value, path):
        for key in path.split("."):
            value = value.get(key) if isinstance(value, dict) else None
        return value

    show = lambda v: "" if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
    if "list" in spec:
        return [(spec.get("roles", {}).get(role := show(get(m, spec["role"])), role), show(get(m, spec["text"])))
                for m in get(record, spec["list"]) or []]
    if "fields" in spec:
        out = []
        for role, path in spec["fields"]:
            values = [show(get(record, p)) for p in ([path] if isinstance(path, str) else path)]
            if isinstance(path, list) or get(record, path) is not None:
                out.append((role, "\n".join(v for v in values if v)))
        return out
    return [(show(record.get(spec["role"])), show(record.get(spec["text"])))]


def canonical_records(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """Canonical turns of JSON records, each mapped by its own fields, plus layout_known: a record that is null,
    no object or of unknown layout gives one row with layout_known false and null turn, role and text."""

    def run(batches):
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for own, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    turns = _record_turns(json.loads(raw)) if raw else None
                except (ValueError, RecursionError):
                    turns = None
                for i, (role, text) in enumerate(turns or []) if turns is not None else [(None, (None, None))]:
                    for col, v in zip(rows, (own, i, role, text, turns is not None), strict=True):
                        col.append(v)
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)],
                                             names=["conv_id", "turn", "role", "text", "layout_known"])

    return df.select(F.col(id_col).cast("long").alias("i"), F.col(json_col).alias("j")).mapInArrow(
        run, "conv_id long, turn long, role string, text string, layout_known boolean")


def escape(c: Column) -> Column:
    slash, more = F.lit("\\"), F.lit("\\\\")
    c = F.replace(c, slash, more)
    return F.replace(F.replace(c, F.lit("<"), F.lit("<\\")), F.lit("["), F.lit("[\\"))


_ESCAPED = re.compile(r"\\\\|<\\|\[\\")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\\" if m[0] == "\\\\" else m[0][0], text)


def format_turns(turns: DataFrame) -> DataFrame:
    """``turns`` plus formatted (the turn's part of the formatted conversation), loss_start and
    loss_length (the masked code points of that part; length 0 unless the role is assistant).  The parts of
    a conversation, in the order of turn, role and text, make up its formatted text."""
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT))
    body = escape(F.col("text"))
    return turns.withColumns({
        "formatted": F.concat(head, body, F.lit(END)), "loss_start": F.char_length(head).cast("long"),
        "loss_length": F.when(F.col("role") == "assistant", F.char_length(body)).otherwise(0).cast("long")})


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    out = []
    for part in formatted.split(END)[:-1]:
        role, text = part.removeprefix(TURN).split(TEXT)
        out.append((unescape(role), unescape(text)))
    return out


def read_back(formatted: DataFrame) -> DataFrame:
    """Digest of each formatted conversation, from its parts and masks alone: conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars.

    Parts are sorted by conversation and turn and read as a stream, so that a conversation of any length needs the memory of a turn."""
    ordered = formatted.select("conv_id", "turn", "role", "text", "formatted", "loss_start", "loss_length").repartition(
        "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select(
        "conv_id", "formatted", "loss_start", "loss_length")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        current, state, done = None, None, []

        def close():
            if state:
                done.append((current, state["n"], state["turns"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["size"]))

        def flush():
            cols = list(zip(*done, strict=True)) if done else [[]] * 6
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

        for batch in batches:
            for own, part, start, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or own != current:
                    close()
                    current = own
                    state = {"n": 0, "chars": 0, "size": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256()}
                for role, text in parse(part):
                    state["n"] += 1
                    state["turns"].update(f"{role}\n{text}\n".encode())
                masked = unescape(part[start:start + length])
                state["chars"] += len(masked)
                state["loss"].update(masked.encode())
                state["size"] += len(part)
            yield flush()
        close()
        yield flush()

    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
                                   "loss_sha256 string, formatted_chars long")
