"""Chat formatting by token-level assembly.

Each turn is encoded by itself with a byte-level vocabulary and wrapped in reserved ids that no text
can encode to; control strings that occur in content are escaped, so that the rendered text is as
unambiguous as the ids. Positions of the loss mask follow from prefix sums of segment lengths.
Turns are encoded where they lie; a conversation is assembled by streaming its sorted turns, in
pieces of bounded size, so a conversation of any length needs no more memory than a piece.

Template: BOS, then for every turn a role mark, its text and END, then EOS. Loss counts for the text
of assistant turns alone.

Defined results: null texts count as empty, null roles as ``user``; conversations are ordered by
conv_id, turns by turn with ties by role and the ids of their text; null ids are a conversation of their own;
repeated rows are repeated turns; an empty table gives no rows; a text of any length is one turn; other columns of
the input are ignored.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, pieces, table

#: Ids from RESERVED on are control tokens: the vocabulary ends below.
RESERVED = 50256
CONTROL = ["<s>", "</s>", "[END]", "[INST]", "[/INST]", "[SYS]", "[ROLE]"]
ROLE_MARK = {"user": "[INST]", "assistant": "[/INST]", "system": "[SYS]"}
ESCAPE = "\\"
#: Turns of a piece of a conversation in the output.
PIECE_TURNS = 256
_ESCAPE = re.compile("|".join(map(re.escape, [ESCAPE, *CONTROL])))
_ID = {c: RESERVED + k for k, c in enumerate(CONTROL)}


def escape(text: str) -> str:
    """``text`` with the escape character before itself and before every control string."""
    return _ESCAPE.sub(lambda m: ESCAPE + m[0], text)


def unescape(text: str) -> str:
    return re.sub(r"(?s)\\(.)", r"\1", text)


@functools.lru_cache(2)
def encoding(path: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def format_chats(turns: DataFrame, path: str | None = None) -> DataFrame:
    """Rows (conv_id, piece, ids array<int>, loss array<boolean>): pieces of a conversation in order,
    whose ids and masks concatenate to the conversation's.

    ``loss`` marks the ids of assistant texts."""
    path = path or vocabulary()
    rows = turns.select(F.col("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    conv = rows.schema["conv_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_text = encoding(path).encode_ordinary
        for batch in pieces(batches, "text"):
            ids = [np.array(encode_text(escape(t)), np.int32).tobytes() for t in batch.column("text").to_pylist()]
            names = ["conv_id", "turn", "role"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(ids, pa.binary())], [*names, "ids"])

    encoded = rows.mapInArrow(frugal(encode), f"conv_id {conv}, turn long, role string, ids binary")
    ordered = encoded.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "ids")

    def mark(role: str) -> list[int]:
        known = ROLE_MARK.get(role)
        return [_ID[known]] if known else [_ID["[ROLE]"], *encoding(path).encode_ordinary(escape(role)), _ID["[ROLE]"]]

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, bytes]] = []
        now, piece = None, 0

        def out(last: bool) -> pa.RecordBatch:
            """Held turns as one piece: segment lengths, their prefix sums, and the mask between two of them."""
            parts, counted = [np.array([_ID["<s>"]], np.int32)] if piece == 0 else [], [False] if piece == 0 else []
            for role, ids in held:
                parts += [np.array(mark(role), np.int32), np.frombuffer(ids, np.int32), np.array([_ID["[END]"]], np.int32)]
                counted += [False, role == "assistant", False]
            if last:
                parts.append(np.array([_ID["</s>"]], np.int32))
                counted.append(False)
            sizes = np.array([len(p) for p in parts], np.int64)
            ends = np.cumsum(sizes)
            step = np.zeros(int(ends[-1]) + 1, np.int8)  # +1 where a counted segment begins, -1 where it ends
            on = np.array(counted, bool)
            np.add.at(step, (ends - sizes)[on], 1)
            np.add.at(step, ends[on], -1)
            mask = np.cumsum(step[:-1]) > 0
            return pa.RecordBatch.from_arrays(
                [pa.array([now], kind), pa.array([piece], pa.int64()), pa.array([np.concatenate(parts)], pa.list_(pa.int32())), pa.array([mask], pa.list_(pa.bool_()))], ["conv_id", "piece", "ids", "loss"]
            )

        kind, started = pa.int64(), False
        for batch in batches:
            kind = batch.column("conv_id").type
            for conv_id, role, ids in zip(batch.column("conv_id").to_pylist(), batch.column("role").to_pylist(), batch.column("ids").to_pylist()):
                if started and conv_id != now:
                    yield out(True)
                    held, piece = [], 0
                elif len(held) == PIECE_TURNS:
                    yield out(False)
                    held, piece = [], piece + 1
                now, started = conv_id, True
                held.append((role, ids))
        if started:
            yield out(True)

    return ordered.mapInArrow(frugal(assemble), f"conv_id {conv}, piece long, ids array<int>, loss array<boolean>")


class _Read:
    """Reads one conversation back from its pieces: digests of turns and of the text under the mask."""

    def __init__(self):
        import hashlib

        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0

    def piece(self, ids: np.ndarray, mask: np.ndarray, decode) -> None:
        cuts = np.flatnonzero(ids >= RESERVED)
        names = [CONTROL[i - RESERVED] for i in ids[cuts].tolist()]
        self.chars += sum(map(len, names))
        role, role_at = "", None
        for k, (at, name) in enumerate(zip(cuts.tolist(), names)):
            if mask[at]:  # a control token is no one's text
                self.loss_chars += len(name)
                self.loss.update(name.encode())
            to = int(cuts[k + 1]) if k + 1 < len(cuts) else len(ids)
            raw = decode(ids[at + 1 : to].tolist()).decode()
            self.chars += len(raw)
            if name == "[ROLE]" and role_at is None:
                role, role_at = unescape(raw), k
                continue
            if name in ("<s>", "</s>", "[END]"):
                role_at = None
                continue
            if name != "[ROLE]":
                role = next(r for r, m in ROLE_MARK.items() if m == name)
            text = unescape(raw)
            self.n_turns += 1
            self.turns.update(f"{role}\n{text}\n".encode())
            # What the mask covers is read, whole or not.
            covered = mask[at + 1 : to]
            if covered.any():
                said = text if covered.all() else unescape(decode(ids[at + 1 : to][covered].tolist()).decode(errors="replace"))
                self.loss_chars += len(said)
                self.loss.update(said.encode())


def op6_chat_format(spark, sf_dir: str) -> DataFrame:
    """Digests of the formatted conversations, read back from their ids and masks. Turns that the table
    holds of a conversation -1 belong to the added one."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    turns = turns.union(spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], "conv_id long, turn long, role string, text string"))
    path = vocabulary()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        decode, now, state = encoding(path).decode_bytes, None, None
        for batch in batches:
            rows: list[tuple] = []
            ids, loss = batch.column("ids"), batch.column("loss")
            for k, (conv_id, piece) in enumerate(zip(batch.column("conv_id").to_pylist(), batch.column("piece").to_pylist())):
                if piece == 0 and state is not None:
                    rows.append(done(now, state))
                    state = None
                state = state or _Read()
                now = conv_id
                state.piece(ids[k].values.to_numpy(), loss[k].values.to_numpy(zero_copy_only=False), decode)
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema)
        if state is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(names, done(now, state)))], schema)

    def done(conv_id, s: _Read) -> tuple:
        return conv_id, s.n_turns, s.turns.hexdigest(), s.loss_chars, s.loss.hexdigest(), s.chars

    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    # The pieces of a conversation come out of one task in order, and are read as they come.
    return format_chats(turns, path).mapInArrow(frugal(read), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
