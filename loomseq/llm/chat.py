"""Chat formatting by columnar byte assembly.

The template has four control strings. A turn of the assistant is
``<s>text</s>``, any other ``[INST]role, newline, text[/INST]``. A control
string inside a role or text gets one backslash after its first character
(``<\\s>``; one more where there are some), which takes it out of the control
strings, and is undone by taking one away. In a role, a newline is ``\\n`` and
a backslash two.

The turns of a batch are three columns of segments: header, content, footer.
Their byte lengths give cumulative offsets, and each column's buffer is copied
to its places in one preallocated buffer through scatter indices, in numpy.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The template's control strings and the role that is trained on.
OPEN, CLOSE, TURN, END = "<s>", "</s>", "[INST]", "[/INST]"
TRAINED = "assistant"

CONTROL = re.compile(r"(</?s>|\[/?INST\])")
ESCAPED = re.compile(r"([<\[])\\(\\*)(/?s>|/?INST\])")
#: Bytes copied by one scatter.
BLOCK = 1 << 22


def escape_column(x: pa.Array) -> pa.Array:
    x = pc.replace_substring_regex(x, r"<(\\*)(/?s>)", r"<\\\1\2")
    return pc.replace_substring_regex(x, r"\[(\\*)(/?INST\])", r"[\\\1\2")


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: m[1] + m[2] + m[3] if (m[1] == "<") == m[3].endswith("s>") else m[0], text)


def escape_role(x: pa.Array) -> pa.Array:
    x = pc.replace_substring(pc.replace_substring(x, "\\", "\\\\"), "\n", "\\n")
    return escape_column(x)


def unescape_role(role: str) -> str:
    return re.sub(r"\\(\\|n)", lambda m: "\n" if m[1] == "n" else "\\", unescape(role))


def scatter(columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """The columns' rows side by side in one buffer, and where each row ends."""
    lengths = np.stack([pc.binary_length(c).to_numpy(zero_copy_only=False) for c in columns], axis=1).astype(np.int64)
    ends = np.cumsum(lengths.ravel()).reshape(lengths.shape)
    out = np.empty(int(ends[-1, -1]) if len(ends) else 0, np.uint8)
    for i, c in enumerate(columns):
        c = pa.concat_arrays([c])  # no offset, so that the buffer starts with the first row
        source = np.frombuffer(c.buffers()[2] or b"", np.uint8)
        size = lengths[:, i]
        start = ends[:, i] - size
        first = np.cumsum(size) - size
        total = int(size.sum())
        base = int(np.frombuffer(c.buffers()[1], np.int32)[c.offset]) if len(c) else 0
        at = 0
        while at < len(size):
            to = max(at + 1, int(np.searchsorted(first, first[at] + BLOCK)))
            n = size[at:to]
            if int(n.sum()) > 2 * BLOCK:  # one long row: a plain copy
                for k in range(at, to):
                    out[start[k] : start[k] + size[k]] = source[base + first[k] : base + first[k] + size[k]]
            else:
                index = np.repeat(start[at:to] - first[at:to], n) + np.arange(first[at], first[at] + int(n.sum()))
                out[index] = source[base + first[at] : base + first[at] + int(n.sum())]
            at = to
        assert total == int(first[-1] + size[-1] if len(size) else 0)
    return out, ends[:, -1] if len(ends) else np.zeros(0, np.int64)


def assemble(turns: pa.Table, id_col: str = "conv_id") -> pa.Table:
    """(conv_id, n_turns, formatted, loss) of whole conversations whose rows come one after another."""
    ids = _whole(turns.column(id_col))
    role = _whole(turns.column("role")).cast(pa.string()).fill_null("")
    text = escape_column(_whole(turns.column("text")).cast(pa.string()).fill_null(""))
    trained = pc.equal(role, TRAINED)
    head = pc.if_else(trained, OPEN, pc.binary_join_element_wise(TURN, escape_role(role), "\n", ""))
    foot = pc.if_else(trained, CLOSE, END)
    out, ends = scatter([head, text, foot])
    keys = ids.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    first = np.flatnonzero(new)
    sizes = np.diff(np.append(first, len(keys)))
    stops = np.concatenate([[0], ends[first + sizes - 1]]) if len(first) else np.zeros(1, np.int64)
    formatted = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(stops.astype(np.int64)), pa.py_buffer(out))
    chars = [pc.utf8_length(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (head, text, foot)]
    stop = np.cumsum(sum(chars))
    before = np.concatenate([[0], stop])[first]
    group = np.cumsum(new) - 1
    at = np.flatnonzero(trained.to_numpy(zero_copy_only=False))
    end = (stop - chars[2])[at] - before[group[at]]
    spans = pa.StructArray.from_arrays([pa.array(end - chars[1][at]), pa.array(end)], ["start", "end"])
    loss = pa.ListArray.from_arrays(pa.array(np.searchsorted(group[at], np.arange(len(first) + 1)).astype(np.int32)), spans)
    return pa.table([ids.take(pa.array(first)), pa.array(sizes.astype(np.int64)), formatted, loss], [id_col, "n_turns", "formatted", "loss"])


def _whole(c) -> pa.Array:
    return c.combine_chunks() if not isinstance(c, pa.ChunkedArray) else pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type)


def _assembled(batches):
    held: list[pa.RecordBatch] = []
    last = object()
    for b in batches:
        if not b.num_rows:
            continue
        ids = b.column(0)
        end = ids[b.num_rows - 1].as_py()
        # rows of the last conversation wait for the next batch
        keys = ids.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        tail = int(b.num_rows - np.argmax(keys[::-1] != keys[-1])) if (keys != keys[-1]).any() else 0
        if tail == 0 and held and end == last:
            held.append(b)
            continue
        if held and ids[0].as_py() != last:
            yield from assemble(pa.Table.from_batches(held)).to_batches()
            held = []
        if tail:
            held.append(b.slice(0, tail))
            yield from assemble(pa.Table.from_batches(held)).to_batches()
            held = []
        held.append(b.slice(tail))
        last = end
    if held:
        yield from assemble(pa.Table.from_batches(held)).to_batches()


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, formatted, loss) from turns (conv_id, turn, role, text).

    Turns go by turn, then role and text, nulls first. Null roles and texts
    are empty; rows whose conv_id is null are one conversation; repeated rows
    stay, and turns that tie go by their texts. Other columns go, whatever
    their names; an empty table gives an empty one. loss has the spans of the assistant's texts in code points of
    formatted. A conversation is one string, however long, so it is made in
    one task, which holds no other one meanwhile.
    """
    kind = dict(turns.dtypes)["conv_id"]
    rows = turns.select("conv_id", F.col("turn").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return rows.mapInArrow(_assembled, f"conv_id {kind}, n_turns long, formatted string, loss array<struct<start:long,end:long>>")


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    parts = CONTROL.split(formatted)
    turns = []
    for mark, body in zip(parts[1::4], parts[2::4]):
        if mark == OPEN:
            turns.append((TRAINED, unescape(body)))
        else:
            role, _, text = body.partition("\n")
            turns.append((unescape_role(role), unescape(text)))
    return turns


def _digests(batches):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for b in batches:
        out = []
        for formatted, spans in zip(b.column("formatted").to_pylist(), b.column("loss").to_pylist()):
            turns = read_back(formatted)
            loss = "".join(unescape(formatted[s["start"] : s["end"]]) for s in spans)
            out.append((len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(formatted)))
        cols = list(zip(*out)) or [[]] * 5
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), *[pa.array(list(c), k) for c, k in zip(cols, kinds)]], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        )


def digests(formatted: DataFrame) -> DataFrame:
    """What is read back from formatted conversations: turns, and the text under the loss mask."""
    kind = dict(formatted.dtypes)["conv_id"]
    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.select("conv_id", "formatted", "loss").mapInArrow(_digests, schema)


def op6_chat_columnar(turns: DataFrame) -> DataFrame:
    mark = "</s>[INST] ok [/INST]"
    more = turns.sparkSession.createDataFrame([(-7, 0, "user", mark), (-7, 1, TRAINED, mark)], "conv_id long, turn long, role string, text string")
    rows = turns.select("conv_id", F.col("turn").cast("long"), "role", "text").union(more)
    return digests(format_conversations(rows))


OP6_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, regexp_replace(regexp_replace(text, '<(\\\\*)(/?s>)', '<\\\\\\1\\2', 'g'), '\\[(\\\\*)(/?INST\\])', '[\\\\\\1\\2', 'g') AS escaped FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(escaped) + CASE role WHEN 'assistant' THEN 7 ELSE 14 + length(role) END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
