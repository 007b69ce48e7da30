"""Chat formatting (operator 4), by DataFrame functions only.

Records of different layouts arrive as JSON.  The paths of a record's nested fields, hashed, are its fingerprint; the
fingerprint selects one of the declared mappings, which turns the record into canonical turns (role, text).  The turns are
then written by one template, with the spans of the assistant's texts as loss mask, and can be read back.

Template: ``<s>[INST]role[/INST]text</s>`` per turn.  Inside roles and texts each of ``<``, ``[`` and the backslash is
followed by an inserted backslash, so that no control string can arise there; taking those backslashes out restores the
text.

Null texts, roles and fields are empty.  Records whose fingerprint no mapping knows get null turns and are kept.  The
fingerprint is taken from the record without its texts, so that their length doesn't matter.  A record of a known layout that
can't be read, for a wrong escape or a raw control character inside a text, gets null turns too, and its ``error`` says so.  Turns that share a number are ordered by role, then text; repeated rows stay.  Null
keys stay null.  Extra columns are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The parser's limit on one text, raised from its default of 20 million characters.
READ = {"maxStringLen": "2147483647"}
#: A field's name with its colon is kept, any other JSON string is emptied.
_STRINGS = r'("[^"\\]*+(?:\\.[^"\\]*+)*+"\s*+:)|(")[^"\\]*+(?:\\.[^"\\]*+)*+(")'
BROKEN = "_unreadable"
OPEN, SPLIT, CLOSE = "<s>[INST]", "[/INST]", "</s>"


# ---- layouts ------------------------------------------------------------------------------------------------------


def field_paths(record: Column) -> Column:
    """The nested field names of a JSON record in one string, without the kinds of its values."""
    schema = F.schema_of_variant(F.try_parse_json(F.regexp_replace(record, _STRINGS, "$1$2$3")))
    return F.regexp_replace(schema, r": (?:BIGINT|DOUBLE|STRING|BOOLEAN|VOID|DECIMAL\(\d+,\s*\d+\)|VARIANT)", "")


def fingerprint(record: Column) -> Column:
    return F.xxhash64(field_paths(record))


def _turns(items: Column, role: str, text: str, roles: dict[str, str] | None = None) -> Column:
    """An array of structs as turns, other names for roles replaced."""

    def one(x: Column) -> Column:
        r = F.coalesce(x[role], F.lit(""))
        for theirs, ours in (roles or {}).items():
            r = F.when(x[role] == theirs, ours).otherwise(r)
        return F.struct(r.alias("role"), F.coalesce(x[text], F.lit("")).alias("text"))

    return F.transform(items, one)


def _read(js: Column, schema: str) -> Column:
    """The fields of a record, or null if it can't be read (a wrong escape, a raw control character in a string)."""
    row = F.from_json(js, f"{schema}, `{BROKEN}` string", READ | {"columnNameOfCorruptRecord": BROKEN})
    return F.when(row[BROKEN].isNull(), row)


def _array(js: Column, field: str, schema: str) -> Column:
    return _read(js, f"{field} array<struct<{schema}>>")[field]


def _list(schema: str, field: str, role: str, text: str, roles: dict[str, str] | None = None):
    return lambda js: _turns(_array(js, field, schema), role, text, roles)


def _pair(prompt: Column, answer: Column) -> Column:
    turn = lambda r, t: F.struct(F.lit(r).alias("role"), F.coalesce(t, F.lit("")).alias("text"))
    return F.array(turn("user", prompt), turn("assistant", answer))


def _fields(names: str, make):
    def mapped(js: Column) -> Column:
        row = _read(js, ", ".join(f"{n} string" for n in names.split()))
        return F.when(row.isNotNull(), make(*(row[n] for n in names.split())))

    return mapped


def _numbered(js: Column) -> Column:
    return _turns(F.sort_array(_array(js, "turns", "turn: bigint, role: string, text: string")), "role", "text")


def _with_input(instruction: Column, given: Column, output: Column) -> Column:
    return _pair(F.when(F.coalesce(given, F.lit("")) == "", instruction).otherwise(F.concat_ws("\n\n", instruction, given)), output)


#: Example records of the known layouts (their field paths are what counts) and the mapping of each.
LAYOUTS = [
    ('{"turns": [{"turn": 0, "role": "", "text": ""}]}', _numbered),
    ('{"messages": [{"role": "", "content": ""}]}', _list("role: string, content: string", "messages", "role", "content")),
    ('{"conversations": [{"from": "", "value": ""}]}', _list("`from`: string, value: string", "conversations", "from", "value", {"human": "user", "gpt": "assistant"})),
    ('{"prompt": "", "response": ""}', _fields("prompt response", _pair)),
    ('{"prompt": "", "completion": ""}', _fields("prompt completion", _pair)),
    ('{"question": "", "answer": ""}', _fields("question answer", _pair)),
    ('{"instruction": "", "output": ""}', _fields("instruction output", _pair)),
    ('{"instruction": "", "input": "", "output": ""}', _fields("instruction input output", _with_input)),
]


def known_layout(record: Column) -> Column:
    """Whether a mapping knows the record's layout; false for what is no JSON even without its texts."""
    return F.coalesce(fingerprint(record).isin(*[fingerprint(F.lit(example)) for example, _ in LAYOUTS]) & field_paths(record).isNotNull(), F.lit(False))


def canonical_turns(record: Column) -> Column:
    """``array<struct<role, text>>`` of a JSON record, by the mapping that its fingerprint selects; null if there is none or if the
    record can't be read."""
    mark, out = fingerprint(record), F.lit(None).cast("array<struct<role: string, text: string>>")
    for example, mapping in reversed(LAYOUTS):
        out = F.when(mark == fingerprint(F.lit(example)), mapping(record)).otherwise(out)
    return out


# ---- template -----------------------------------------------------------------------------------------------------


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])\\", "$1")


def written_turns(turns: Column) -> Column:
    """Each turn as the template writes it: its opening, its escaped text, and whether the loss covers the text."""
    return F.transform(
        turns,
        lambda t: F.struct(
            F.concat(F.lit(OPEN), escape(t["role"]), F.lit(SPLIT)).alias("head"), escape(t["text"]).alias("body"), (t["role"] == "assistant").alias("loss")
        ),
    )


def formatted(written: Column) -> Column:
    return F.array_join(F.transform(written, lambda w: F.concat(w["head"], w["body"], F.lit(CLOSE))), "")


def loss_spans(written: Column) -> Column:
    """Start (from 0) and length in code points of each span of the formatted text that the loss covers."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start: bigint, length: bigint>>").alias("spans"))

    def add(state: Column, w: Column) -> Column:
        body = F.length(w["body"]).cast("long")
        first = state["at"] + F.length(w["head"])
        span = F.when(w["loss"], F.array(F.struct(first.alias("start"), body.alias("length")))).otherwise(F.array().cast("array<struct<start: bigint, length: bigint>>"))
        return F.struct((first + body + len(CLOSE)).alias("at"), F.concat(state["spans"], span).alias("spans"))

    return F.aggregate(written, start, add, lambda s: s["spans"])


def format_chats(df: DataFrame, key: str, record: str) -> DataFrame:
    """``(key, formatted, loss_spans, error)`` of every JSON record; nulls where no mapping knows its layout or it can't be read, and
    ``error`` says which of both."""
    rows = df.select(F.col(key).alias("_key"), canonical_turns(F.col(record)).alias("_turns"), known_layout(F.col(record)).alias("_known"))
    error = F.when(F.col("_turns").isNull(), F.when(F.col("_known"), "unreadable").otherwise("unknown layout"))
    rows = rows.select("_key", error.alias("error"), written_turns(F.col("_turns")).alias("_written"))
    return rows.select(F.col("_key").alias(key), formatted(F.col("_written")).alias("formatted"), loss_spans(F.col("_written")).alias("loss_spans"), "error")


def read_turns(text: Column) -> Column:
    """The turns of a formatted text."""
    pieces = F.filter(F.split(text, CLOSE, -1), lambda p: p != "")

    def one(p: Column) -> Column:
        cut = F.instr(p, SPLIT)
        role = p.substr(F.lit(len(OPEN) + 1), cut - 1 - len(OPEN))
        return F.struct(unescape(role).alias("role"), unescape(p.substr(cut + len(SPLIT), F.length(p))).alias("text"))

    return F.transform(pieces, one)


def masked_text(text: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(text.substr((s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def turn_rows_to_records(df: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """Rows of one turn each, gathered to one JSON record per conversation."""
    one = F.struct(F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = df.groupBy(F.col(key).alias("_key")).agg(F.sort_array(F.collect_list(one)).alias("turns"))
    return rows.select(F.col("_key").alias(key), F.to_json(F.struct("turns"), {"ignoreNullFields": "false"}).alias("record"))
