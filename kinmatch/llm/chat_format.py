"""Chat formatting by columnar byte assembly, with a loss mask over what assistants say.

A turn is written ``### role: text</turn>`` and a line break. In texts and roles a backslash,
a hash sign and the end mark are escaped (a colon too in roles), so the marks occur nowhere
else and every turn can be read back. For a batch of turns the lengths of all headers, texts
and ends give offsets and scatter indices, and the bytes are copied into one buffer, which is
the Arrow string column that goes out.

Turns come sorted by conversation and turn number; a task streams them. A conversation that
goes beyond ``PART_BYTES`` comes in several parts, in order, so one of any length needs no more
memory than others. Defined cases: null texts and roles are empty; a null conversation is one
of its own; turns with equal numbers (or null, first) are ordered by role and text; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmatch.llm.text import flat

PART_BYTES = 8 << 20
END = "</turn>\n"
HEAD = re.compile(r"### ((?:[^\\:]|\\.)*): (.*)", re.DOTALL)
ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(texts: pa.Array) -> pa.Array:
    texts = pc.replace_substring(texts, "\\", "\\\\")
    return pc.replace_substring(pc.replace_substring(texts, "#", "\\#"), "</turn>", "<\\/turn>")


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def assemble(columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """All cells row by row in one buffer, and the end of each row."""
    parts = [flat(c) for c in columns]
    lengths = np.stack([np.diff(bounds) for _, bounds in parts], axis=1)
    ends = np.cumsum(lengths.ravel()).reshape(lengths.shape)
    out = np.empty(int(ends[-1, -1]) if len(ends) else 0, np.uint8)
    for k, (data, bounds) in enumerate(parts):
        shift = ends[:, k] - bounds[1:]
        out[np.repeat(shift, lengths[:, k]) + np.arange(len(data))] = data
    return out, ends[:, -1]


def formatted(conversations: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text", loss_role="assistant") -> DataFrame:
    """``(conv, part, n_turns, formatted, loss)``; loss holds (start, end) in characters.

    Partitions keep the parts of a conversation together and in order.
    """
    rows = conversations.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"),
        F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"),
    )
    kind = rows.schema["conv"].dataType.simpleString()

    def emit(t: pa.Table, part: int) -> pa.RecordBatch:
        """One or more conversations, or the given part of one."""
        roles, texts = t.column("role").combine_chunks(), t.column("text").combine_chunks()
        bodies = escape(texts)
        heads = pc.binary_join_element_wise("### ", pc.replace_substring(escape(roles), ":", "\\:"), ": ", "")
        ends = pa.array([END] * t.num_rows)
        buffer, stops = assemble([heads, bodies, ends])
        conv = t.column("conv").combine_chunks()
        last = np.flatnonzero(np.append(changes(conv), True))
        offsets = np.concatenate([[0], stops[last]]).astype(np.int32)
        head_chars, body_chars = (pc.utf8_length(x).to_numpy().astype(np.int64) for x in (heads, bodies))
        chars = head_chars + body_chars + len(END)
        before = np.cumsum(chars) - chars
        first = np.concatenate([[0], last[:-1] + 1])
        count = np.diff(np.append(first, t.num_rows))
        start = before - np.repeat(before[first], count) + head_chars
        speaks = pc.equal(roles, loss_role).to_numpy(zero_copy_only=False)
        spans = pa.StructArray.from_arrays([pa.array(start[speaks]), pa.array((start + body_chars)[speaks])], ["start", "end"])
        owner = np.concatenate([[0], np.cumsum(speaks)[last]]).astype(np.int32)
        return pa.record_batch(
            {
                "conv": conv.take(pa.array(first)),
                "part": pa.array(np.full(len(last), part, np.int32)),
                "n_turns": pa.array(count.astype(np.int64)),
                "formatted": pa.StringArray.from_buffers(len(last), pa.py_buffer(offsets), pa.py_buffer(buffer)),
                "loss": pa.ListArray.from_arrays(pa.array(owner), spans),
            }
        )

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        part, open_conv = 0, None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([rest, t]).combine_chunks() if rest is not None else t
            if not t.num_rows:
                continue
            if part and t.column("conv")[0].as_py() != open_conv:
                part = 0
            cuts = np.flatnonzero(changes(t.column("conv").combine_chunks())) + 1
            at = 0
            if part and len(cuts):
                yield emit(t.slice(0, int(cuts[0])), part)
                at, part = int(cuts[0]), 0
            cuts = cuts[cuts > at]
            if len(cuts):
                yield emit(t.slice(at, int(cuts[-1]) - at), 0)
                at, part = int(cuts[-1]), 0
            rest = t.slice(at)
            if rest.nbytes > PART_BYTES:
                yield emit(rest, part)
                part, open_conv = part + 1, rest.column("conv")[0].as_py()
                rest = rest.slice(rest.num_rows)
        if rest is not None and rest.num_rows:
            yield emit(rest, part)

    return (
        rows.repartition("conv")
        .sortWithinPartitions("conv", "turn", "role", "text")
        .mapInArrow(stream, f"conv {kind}, part int, n_turns long, formatted string, loss array<struct<start:long,end:long>>")
    )


def changes(conv: pa.Array) -> np.ndarray:
    """Whether each row's conversation differs from the next one's."""
    null = conv.is_null().to_numpy(zero_copy_only=False)
    other = pc.fill_null(pc.not_equal(conv[1:], conv[:-1]), False).to_numpy(zero_copy_only=False)
    return other | (null[1:] != null[:-1])


def turns_of(text: str) -> Iterator[tuple[str, str]]:
    """Role and text of each turn of a formatted conversation."""
    for piece in text.split(END)[:-1]:
        role, body = HEAD.fullmatch(piece).groups()
        yield unescape(role), unescape(body)


def read_back(parts: DataFrame, id_col="conv_id") -> DataFrame:
    """Digests of what the formatted text says; parts must come as ``formatted`` gives them."""
    kind = parts.schema["conv"].dataType.simpleString()
    names = [id_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None

        def rows(done: list) -> pa.RecordBatch:
            columns = list(zip(*done))
            return pa.record_batch([pa.array(columns[0], conv_type), *map(pa.array, columns[1:])], names)

        def close(s: list) -> tuple:
            return (s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5])

        conv_type = None
        for batch in batches:
            conv_type, done = batch.schema.field("conv").type, []
            for row in batch.to_pylist():
                if row["part"] == 0:
                    if state:
                        done.append(close(state))
                    state = [row["conv"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                text = row["formatted"]
                for role, body in turns_of(text):
                    state[1] += 1
                    state[2].update(f"{role}\n{body}\n".encode())
                for span in row["loss"]:
                    said = unescape(text[span["start"] : span["end"]])
                    state[3] += len(said)
                    state[4].update(said.encode())
                state[5] += len(text)
            if done:
                yield rows(done)
        if state:
            yield rows([close(state)])

    return parts.mapInArrow(digest, f"{id_col} {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
