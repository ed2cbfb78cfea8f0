"""Conversations as token ids with a loss mask, assembled from tokens.

A conversation is written ``<s>`` and, per turn, ``[INST]`` role ``[/INST]`` text ``</s>``. Role and text are encoded
each for itself and the marks are spliced in as ids of their own, so no mark can arise from a text. In the written form
a text's control strings would be read as marks; they are escaped by a backslash behind their first character, and
backslashes are doubled, so a text is given back exactly. The loss mask covers the texts of the trained role: every
segment adds one where it begins and takes one away where it ends, and the prefix sum over the tokens is the mask.

Turns are encoded before they are shuffled, and a conversation is assembled as a stream of turns in order into parts of
bounded size, so a conversation of any length passes through a task without being held there.

Defined results: a null role or text is an empty one; turns go by number, null first, and equal numbers by their ids;
null conversation ids are one conversation; repeated rows are turns each; an empty table gives an empty result; further
columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Control strings of the template, in the order of their ids behind the vocabulary, and one that is only escaped.
BEGIN, END, TURN, SAYS = "<s>", "</s>", "[INST]", "[/INST]"
MARKS = (BEGIN, END, TURN, SAYS)
CONTROL = (*MARKS, "<|endoftext|>")
TRAINED = "assistant"
#: Tokens after which a part of a conversation is closed, at the end of a turn.
PART_TOKENS = 1 << 16
_ESCAPED = re.compile("|".join(rf"(?={re.escape(c)}){re.escape(c[0])}" for c in CONTROL) + r"|\\")
_BACKSLASHES = re.compile(r"\\+")


def escape(text: str) -> str:
    """The text without control strings: ``\\`` doubled, and put behind each control string's first character."""
    return _ESCAPED.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    """The inverse: a doubled backslash is one, and a single one was put there by ``escape``."""
    return _BACKSLASHES.sub(lambda m: "\\" * (len(m[0]) // 2), text)


class Template:
    """Segments to ids and back, for a vocabulary of byte-level ranks (the tiktoken library's format)."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.first_mark = max(ranks.values()) + 1
        self.mark = {m: self.first_mark + i for i, m in enumerate(MARKS)}

    def turn(self, role: str, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids and loss mask of one turn."""
        encode = self.encoding.encode_ordinary
        segments = [([self.mark[TURN]], 0), (encode(escape(role)), 0), ([self.mark[SAYS]], 0),
                    (encode(escape(text)), int(role == TRAINED)), ([self.mark[END]], 0)]
        ends = np.cumsum([len(ids) for ids, _ in segments])
        step = np.zeros(int(ends[-1]) + 1, dtype=np.int8)
        for end, (ids, trained) in zip(ends.tolist(), segments):
            step[end - len(ids)] += trained
            step[end] -= trained
        return np.array([i for ids, _ in segments for i in ids], dtype=np.int32), np.cumsum(step[:-1]).astype(bool)

    def decode(self, ids: list[int]) -> str:
        return self.encoding.decode_bytes(ids).decode()

    def turns(self, ids: list[int], mask: list[bool]) -> Iterator[tuple[str, str, str]]:
        """(role, text, text under the mask) of whole turns, unescaped."""
        at = 0
        while at < len(ids):
            if ids[at] == self.mark[BEGIN]:
                at += 1
                continue
            says, end = ids.index(self.mark[SAYS], at), ids.index(self.mark[END], at)
            masked = [i for i, m in zip(ids[at:end + 1], mask[at:end + 1]) if m]
            yield (unescape(self.decode(ids[at + 1:says])), unescape(self.decode(ids[says + 1:end])),
                   unescape(self.decode(masked)))
            at = end + 1

    def written(self, ids: list[int]) -> str:
        """The written form: marks as their strings, texts escaped."""
        out, held = [], []
        for i in ids:
            if i >= self.first_mark:
                out += [self.decode(held), MARKS[i - self.first_mark]]
                held = []
            else:
                held.append(i)
        return "".join([*out, self.decode(held)])


_templates: dict[str, Template] = {}


def _template(path: str, pattern: str) -> Template:
    if path not in _templates:
        _templates[path] = Template(path, pattern)
    return _templates[path]


def _in_order(df: DataFrame, *order: str) -> DataFrame:
    """Rows of one conversation together and in order, ready to be read as a stream."""
    return df.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def format_conversations(turns: DataFrame, path: str, pattern: str, conv_id: str = "conv_id", turn: str = "turn",
                         role: str = "role", text: str = "text", part_tokens: int = PART_TOKENS) -> DataFrame:
    """(conv_id, part, ids, mask): conversations in parts of about ``part_tokens`` ids, cut between turns."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = _template(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                rows = batch.slice(at, 1000)
                made = [template.turn(r or "", t or "")
                        for r, t in zip(rows.column(2).to_pylist(), rows.column(3).to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), _lists([i for i, _ in made], pa.int32()),
                     _lists([m for _, m in made], pa.bool_())], names=["conv_id", "turn", "ids", "mask"])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = _template(path, pattern)
        now, part, ids, masks, held = None, 0, [], [], 0

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([now[0]], pa.int64()), pa.array([part], pa.int64()), _lists([np.concatenate(ids)], pa.int32()),
                 _lists([np.concatenate(masks)], pa.bool_())], names=["conv_id", "part", "ids", "mask"])

        for batch in batches:
            for key, i, m in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
                if now is None or key != now[0]:
                    if held:
                        yield close()
                    now, part, held = (key,), 0, 1
                    ids, masks = [np.array([template.mark[BEGIN]], dtype=np.int32)], [np.zeros(1, dtype=bool)]
                elif held >= part_tokens:
                    yield close()
                    part, ids, masks, held = part + 1, [], [], 0
                ids.append(i.values.to_numpy())
                masks.append(m.values.to_numpy(zero_copy_only=False))
                held += len(ids[-1])
        if held:
            yield close()

    rows = turns.select(F.col(conv_id).cast("bigint").alias("conv_id"), F.col(turn).cast("bigint").alias("turn"),
                        F.col(role).alias("role"), F.col(text).alias("text"))
    encoded = rows.mapInArrow(encode, "conv_id bigint, turn bigint, ids array<int>, mask array<boolean>")
    return _in_order(encoded, "turn", "ids").mapInArrow(
        assemble, "conv_id bigint, part bigint, ids array<int>, mask array<boolean>")


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([[], *values]).astype(
        bool if kind == pa.bool_() else np.int32), kind))


def read_back(formatted: DataFrame, path: str, pattern: str) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) from the parts of conversations.

    The digests are of role, line feed, text, line feed per turn, and of all text under the loss mask.
    """
    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = _template(path, pattern)
        now, turns, loss, chars, counts = None, None, None, 0, [0, 0]

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{
                "conv_id": now[0], "n_turns": counts[0], "turns_sha256": turns.hexdigest(), "loss_chars": counts[1],
                "loss_sha256": loss.hexdigest(), "formatted_chars": chars}], schema=result)

        for batch in batches:
            for key, i, m in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
                if now is None or key != now[0]:
                    if now is not None:
                        yield close()
                    now, turns, loss, chars, counts = (key,), hashlib.sha256(), hashlib.sha256(), 0, [0, 0]
                ids, mask = i.as_py(), m.as_py()
                chars += len(template.written(ids))
                for role, text, masked in template.turns(ids, mask):
                    turns.update(f"{role}\n{text}\n".encode())
                    loss.update(masked.encode())
                    counts[0] += 1
                    counts[1] += len(masked)
        if now is not None:
            yield close()

    result = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                        ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    return _in_order(formatted, "part").mapInArrow(
        body, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
              "formatted_chars bigint")
