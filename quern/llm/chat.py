"""Chat formatting (operator 5): budgeted, turn-aligned windows with a loss mask.

A turn is rendered as ``<|turn|>role\\ntext<|end|>\\n``.  Strings that could be taken for
control strings of this or other templates get a backslash after their first character (one more
if there are some), which is undone on reading.
Prefix sums of turn tokens, kept as the turns stream by, choose the longest run of turns that fits the budget beside
the system turn and a little repeated history; only new assistant texts
are under the loss mask, so each is learned once.  A window is over its budget only if one turn alone is.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm._shared import settle, text_buffers

BEGIN, END = "<|turn|>", "<|end|>\n"
_CONTROL = r"(?=\||/?s>|/?INST\]|</?SYS>>)"
_ESCAPE = re.compile(r"([<\[])(\\*)" + _CONTROL)
_UNESCAPE = re.compile(r"([<\[])\\(\\*)" + _CONTROL)
SCHEMA = "conv_id long, window int, text string, new array<boolean>, loss array<struct<start:int,end:int>>, n_tokens long"


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[1] + "\\" + m[2], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[1] + m[2], text)


def _role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unrole(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def parse(window: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a window."""
    out = []
    for part in window.split(BEGIN)[1:]:
        role, _, text = part.removesuffix(END).partition("\n")
        out.append((_unrole(role), unescape(text)))
    return out


class _Turn:
    __slots__ = ("role", "text", "tokens")

    def __init__(self, role: str, text: str, tokens: int):
        self.role, self.text, self.tokens = role, text, tokens

    def render(self) -> tuple[str, int]:
        """The rendered turn, and where its text starts."""
        head = BEGIN + _role(self.role) + "\n"
        return head + escape(self.text) + END, len(head)


class _Conversation:
    """Cuts the turns of one conversation into windows as they come."""

    def __init__(self, key, budget: int, history_turns: int, history_tokens: int):
        self.key, self.budget, self.history_turns, self.history_tokens = key, budget, history_turns, history_tokens
        self.system: _Turn | None = None
        self.recent: list[_Turn] = []
        self.open: list[_Turn] = []
        self.used = self.number = 0

    def _repeated(self, room: int) -> list[_Turn]:
        """What is repeated in at most ``room`` tokens: the system turn before history, later history before earlier."""
        past, held = [], 0
        system = self.system if self.number and self.system is not None and self.system.tokens <= room else None
        for turn in reversed(self.recent):
            spent = held + (0 if turn is system else turn.tokens)
            if len(past) == self.history_turns or spent > self.history_tokens or spent + (system.tokens if system else 0) > room:
                break
            past.append(turn)
            held = spent
        past.reverse()
        if system is not None and system not in past:
            past.insert(0, system)
        return past

    def add(self, turn: _Turn):
        """A finished window if ``turn`` does not fit beside what is open."""
        done = None
        if self.open and self.used + turn.tokens > self.budget:
            done = self.close()
        if not self.open:
            self.past = self._repeated(self.budget - turn.tokens)
            self.used = sum(t.tokens for t in self.past)
        self.open.append(turn)
        self.used += turn.tokens
        if self.system is None and turn.role == "system":
            self.system = turn
        return done

    def close(self):
        if not self.open:
            return None
        text, new, loss, at = [], [], [], 0
        for k, turn in enumerate(self.past + self.open):
            piece, head = turn.render()
            fresh = k >= len(self.past)
            if fresh and turn.role == "assistant":
                loss.append({"start": at + head, "end": at + len(piece) - len(END)})
            text.append(piece)
            new.append(fresh)
            at += len(piece)
        row = (self.key, self.number, "".join(text), new, loss, self.used)
        self.recent = (self.recent + self.open)[-self.history_turns :] if self.history_turns else []
        self.open, self.used = [], 0
        self.number += 1
        return row


def _table(rows: list[tuple]) -> pa.RecordBatch:
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.list_(pa.bool_()), pa.list_(span), pa.int64()]
    names = ["conv_id", "window", "text", "new", "loss", "n_tokens"]
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)], names)


def chat_windows(turns: DataFrame, tokenizer_path: str | None = None, *, budget: int = 2048, history_turns: int = 2, history_tokens: int = 256) -> DataFrame:
    """Windows (conv_id, window, text, new, loss, n_tokens) of conversations (conv_id, turn, role, text).

    Turns go in order of turn, role, text (nulls first).  Every turn is new in one window; a window after the
    first repeats the first system turn and up to ``history_turns`` turns of ``history_tokens`` together, as far as
    they fit beside its first new turn. A turn over the budget gets a window of its own.  ``loss`` has
    the code points of ``text`` that are learned.

    Null roles and texts count as empty; a null conv_id is a conversation; repeated rows are turns of
    their own; other columns are not read; an empty table gives no window.  Rows are streamed in
    order, so a conversation of any length needs the memory of a window.
    """
    import public_tokenizers

    path = tokenizer_path or public_tokenizers.path("byte_bpe_50k.json")
    picked = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    picked = picked.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def cut(batches):
        from quern.llm.wavelet import ChunkEncoder

        encoder, now = ChunkEncoder.of(path), None
        for batch in batches:
            counts = np.zeros(len(batch), np.int64)
            data, offsets = text_buffers(batch.column("text"))
            for i in range(0, len(batch), 500):
                j = min(len(batch), i + 500)
                counts[i:j] = encoder.batch(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])[1]
            rows = []
            for key, role, text, n in zip(batch.column("conv_id").to_pylist(), batch.column("role").to_pylist(), batch.column("text").to_pylist(), counts.tolist()):
                if now is None or now.key != key:
                    if now is not None:
                        rows.append(now.close())
                    now = _Conversation(key, budget, history_turns, history_tokens)
                done = now.add(_Turn(role, text, n + 4))  # and the marks around it
                if done:
                    rows.append(done)
            if rows:
                yield _table(rows)
        if now is not None:
            yield _table([now.close()])

    return picked.mapInArrow(cut, SCHEMA)


def read_conversations(windows: DataFrame) -> DataFrame:
    """What the windows hold, for each conversation: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows."""
    ordered = windows.select("conv_id", "window", "text", "new", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "window")
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)], names)

    def read(batches):
        now = None  # [conv_id, turns, hash, loss chars, loss hash, chars, windows]

        def row():
            return (now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5], now[6])

        for batch in batches:
            rows = []
            for window in batch.to_pylist():
                if now is None or now[0] != window["conv_id"]:
                    if now is not None:
                        rows.append(row())
                    now = [window["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                text = window["text"]
                for (role, said), fresh in zip(parse(text), window["new"]):
                    if fresh:
                        now[1] += 1
                        now[2].update(f"{role}\n{said}\n".encode())
                for span in window["loss"]:
                    learned = unescape(text[span["start"] : span["end"]])
                    now[3] += len(learned)
                    now[4].update(learned.encode())
                now[5] += len(text)
                now[6] += 1
            if rows:
                yield table(rows)
        if now is not None:
            yield table([row()])

    return ordered.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")


def format_chats(turns: DataFrame, **options) -> DataFrame:
    """Write the windows of ``turns`` to the shared folder and read every conversation back."""
    return read_conversations(settle(chat_windows(turns, **options), "chat-windows"))
