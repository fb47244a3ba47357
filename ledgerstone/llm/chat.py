"""Chat formatting by schema fingerprints.

A record's fingerprint is a hash of its nested field paths. A registry maps fingerprints to declarative
mappings that say where turns, roles and texts are, so that prompt, instruction and message layouts all
become canonical turns (conversation, turn, role, text). Turns are then formatted with a template whose
control strings can't occur inside texts: they are escaped reversibly. Assistant texts are the loss mask.

Turns are formatted row by row; a conversation, whatever its length, is only ever streamed, never put together
in one row.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

# Control strings of common chat templates, and ours.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<|turn|>", "<|text|>", "<|end|>")
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
ESCAPE = "\x1a"


@dataclass(frozen=True)
class Mapping:
    """turns: path of a list of messages with role and text fields; or fields: (path, role) in order. Roles are renamed by roles."""

    turns: str | None = None
    role: str = "role"
    text: str = "content"
    fields: tuple[tuple[str, str], ...] = ()
    roles: dict[str, str] = field(default_factory=dict)


def paths(value, at="") -> set[str]:
    """Nested field paths of a record; list items share one path, and null fields count like present ones."""
    if isinstance(value, dict):
        return set().union(*(paths(v, f"{at}.{k}" if at else k) for k, v in value.items())) if value else {at}
    if isinstance(value, list):
        return set().union(*(paths(v, f"{at}[]") for v in value)) if value else {f"{at}[]"}
    return {at}


def fingerprint(found: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:16]


def layout(*found: str) -> str:
    return fingerprint(set(found))


REGISTRY: dict[str, Mapping] = {
    layout("messages[].role", "messages[].content"): Mapping("messages"),
    layout("messages[].role", "messages[].text"): Mapping("messages", text="text"),
    layout("conversations[].from", "conversations[].value"): Mapping("conversations", "from", "value", roles={"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}),
    layout("prompt", "completion"): Mapping(fields=(("prompt", "user"), ("completion", "assistant"))),
    layout("prompt", "response"): Mapping(fields=(("prompt", "user"), ("response", "assistant"))),
    layout("instruction", "output"): Mapping(fields=(("instruction", "user"), ("output", "assistant"))),
    layout("instruction", "input", "output"): Mapping(fields=(("instruction+input", "user"), ("output", "assistant"))),
    layout("system", "prompt", "response"): Mapping(fields=(("system", "system"), ("prompt", "user"), ("response", "assistant"))),
    layout("system"): Mapping(fields=(("system", "system"),)),
    layout("prompt"): Mapping(fields=(("prompt", "user"),)),
    layout("response"): Mapping(fields=(("response", "assistant"),)),
}


def reach(record, path: str):
    """The value at a path; a+b puts texts of two fields together, a blank line between, empty ones left out."""
    if "+" in path:
        return "\n\n".join(x for x in (reach(record, p) for p in path.split("+")) if x)
    for key in path.split("."):
        record = record.get(key) if isinstance(record, dict) else None
    return record


def canonical(record: dict, registry=REGISTRY) -> list[tuple[str, str]] | None:
    """(role, text) of a record's turns; None if its layout is unknown. Null texts and roles are empty."""
    mapping = registry.get(fingerprint(paths(record)))
    if mapping is None:
        return None
    if mapping.turns is None:
        return [(role, str(reach(record, p) or "")) for p, role in mapping.fields]
    turns = [(str(m.get(mapping.role) or ""), str(m.get(mapping.text) or "")) for m in reach(record, mapping.turns) or []]
    return [(mapping.roles.get(r, r), t) for r, t in turns]


def normalise(records: DataFrame, id_col="id", json_col="record", registry=None) -> DataFrame:
    """JSON records of any known layout -> conv_id, layout, turn, role, text. Records of unknown layout, null or broken ones keep one row with null turn."""
    registry = REGISTRY if registry is None else registry

    def run(batches):
        for batch in batches:
            out = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    record = json.loads(text) if text else None
                except ValueError:
                    record = None
                turns = canonical(record, registry) if isinstance(record, dict) else None
                mark = fingerprint(paths(record)) if isinstance(record, dict) else None
                out += [(key, mark, i, r, t) for i, (r, t) in enumerate(turns)] if turns else [(key, mark, None, None, None)]
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field(0).type), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string()), pa.array(columns[4], pa.string())], ["conv_id", "layout", "turn", "role", "text"])

    kind = records.schema[id_col].dataType.simpleString()
    return records.select(F.col(id_col), F.col(json_col)).mapInArrow(run, f"conv_id {kind}, layout string, turn long, role string, text string")


_HIDE = re.compile("|".join(re.escape(x) for x in (ESCAPE, *CONTROL)))
_SHOW = re.compile(ESCAPE + "([0-9A-Za-z])")
_NAMES = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def escape(text: str) -> str:
    """Control strings become the escape character and a letter, so that no control string is left."""
    return _HIDE.sub(lambda m: ESCAPE + _NAMES[(ESCAPE, *CONTROL).index(m[0])], text)


def unescape(text: str) -> str:
    return _SHOW.sub(lambda m: (ESCAPE, *CONTROL)[_NAMES.index(m[1])], text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """A turn as it stands in the output, and where its text begins and ends in it."""
    head = f"{TURN}{escape(role)}{TEXT}"
    body = escape(text)
    return f"{head}{body}{END}", len(head), len(head) + len(body)


_TURN = re.compile(f"{re.escape(TURN)}(.*?){re.escape(TEXT)}(.*?){re.escape(END)}", re.DOTALL)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Back from the output to (role, text)."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def format_chats(turns: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    """conv_id, turn, role, text, formatted, loss_start, loss_end (code points in formatted; null outside the loss mask), a row for each turn.

    Null roles and texts are empty; null turn numbers come first. Repeated rows are turns of their own. A null conv_id is one conversation.
    Every turn is formatted by itself: a conversation's output is its turns' in order of turn, role, text, one after another.
    """

    def run(batches):
        for batch in batches:
            done = [format_turn(r, t) for r, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            loss = [r == "assistant" for r in batch.column(2).to_pylist()]
            start, end = ([x[c] if k else None for x, k in zip(done, loss, strict=True)] for c in (1, 2))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array([x[0] for x in done], pa.string()), pa.array(start, pa.int64()), pa.array(end, pa.int64())], ["conv_id", "turn", "role", "text", "formatted", "loss_start", "loss_end"])

    own = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = turns.schema[conv_col].dataType.simpleString()
    return own.mapInArrow(run, f"conv_id {kind}, turn long, role string, text string, formatted string, loss_start long, loss_end long")


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from its output: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Turns are sorted and streamed, so that memory doesn't grow with a conversation. Digests of a sequence have to see it in order, in one task.
    """

    def run(batches):
        now, state = None, None

        def row():
            return (now[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

        def batch_of(rows, kind):
            columns = list(zip(*rows, strict=True))
            types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        kind = pa.int64()
        for batch in batches:
            kind, rows = batch.schema.field(0).type, []
            for conv, text, start, end in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if now != (conv,):
                    if now is not None:
                        rows.append(row())
                    now, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, body in read_turns(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
                state[4] += len(text)
                if start is not None:
                    under = unescape(text[start:end])
                    state[2] += len(under)
                    state[3].update(under.encode("utf-8", "surrogatepass"))
            if rows:
                yield batch_of(rows, kind)
        if now is not None:
            yield batch_of([row()], kind)

    kind = formatted.schema["conv_id"].dataType.simpleString()
    sorted_ = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return sorted_.select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def stored(turns: DataFrame) -> DataFrame:
    """conv_id, turn, record: each turn as a record in one of the registry's layouts, by a hash of where it stands: lists of messages of three kinds, or a field named for the role."""
    role, text = F.col("role"), F.col("text")
    kind = F.pmod(F.xxhash64("conv_id", "turn", "text"), F.lit(4))
    keep = {"ignoreNullFields": "false"}

    def messages(name, *fields):
        return F.to_json(F.struct(F.array(F.struct(*fields)).alias(name)), keep)

    aliased = role.isin("human", "gpt", "bot", "model")  # would be renamed on the way back
    sender = F.when(role == "user", "human").when(role == "assistant", "gpt").otherwise(role)
    field = F.coalesce(*(F.when(role == r, F.to_json(F.struct(text.alias(f)), keep)) for r, f in (("system", "system"), ("user", "prompt"), ("assistant", "response"))))
    plain = messages("messages", role.alias("role"), text.alias("content"))
    record = F.when(kind == 1, messages("messages", role.alias("role"), text.alias("text"))).when((kind == 2) & ~F.coalesce(aliased, F.lit(False)), messages("conversations", sender.alias("from"), text.alias("value"))).when((kind == 3) & field.isNotNull(), field)
    return turns.select("conv_id", "turn", F.coalesce(record, plain).alias("record"))


def op6_chat(spark, sf_dir):
    """All conversations, stored as records of several layouts; records that are broken or of no known layout stand among them and give no turn."""
    odd = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    bad = spark.createDataFrame([(-7, 0, '{"messages": [{"role": "user"'), (-7, 1, '{"question": "?"}'), (-7, 2, None)], "conv_id long, turn long, record string")
    records = stored(rows.unionByName(extra)).unionByName(bad).select(F.struct("conv_id", "turn").alias("at"), "record")
    turns = normalise(records, "at", "record").filter("turn is not null").select("conv_id.conv_id", F.col("conv_id.turn").alias("turn"), "role", "text")
    return digests(format_chats(turns))


_HIDDEN = "coalesce({0}, '')"
for _i, _c in enumerate((ESCAPE, *CONTROL)):
    _HIDDEN = f"replace({_HIDDEN}, {'chr(26)' if _c == ESCAPE else repr(_c)}, chr(26) || '{_NAMES[_i]}')"
ORACLE = f"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
             {len(TURN + TEXT + END)} + length({_HIDDEN.format('role')}) + length({_HIDDEN.format('text')}) AS n FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(n)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""
