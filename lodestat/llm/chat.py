"""Chat formatting at token level, with a loss mask.

Each turn becomes ids: a reserved id that opens a turn, the role's ids, a
reserved id before the text, the text's ids, a reserved id that ends the turn.
Roles and texts are encoded separately, so no id spans a border, and the
reserved ids lie beyond the tokenizer's, so no text can yield them.  Strings of
the template or of other known templates that occur in a text are escaped, reversibly.  Borders of
segments are prefix sums of their lengths; the loss mask covers the assistant's texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import Encoder

#: The template's markers, and control strings of other templates that are escaped too (fixed values).
OPEN, TEXT, CLOSE = "<|turn|>", "<|text|>", "<|end|>"
CONTROLS = (OPEN, TEXT, CLOSE, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<|eot_id|>", "<|start_header_id|>", "<|end_header_id|>", "<start_of_turn>", "<end_of_turn>", "<bos>", "<eos>", "<pad>", "<unk>")
_ESCAPED = re.compile("|".join(map(re.escape, sorted((*CONTROLS, "\\"), key=len, reverse=True))))
_UNESCAPED = re.compile(r"\\([\\-])")
ASSISTANT = "assistant"


def escape(text: str) -> str:
    r"""A backslash is doubled; ``\-`` goes after the first character of a control string."""
    return _ESCAPED.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\-{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _UNESCAPED.sub(lambda m: "\\" if m[1] == "\\" else "", text)


def _byte_of() -> dict[str, int]:
    """Byte that each character of a byte-level vocabulary stands for, read off the pre-tokenizer.

    Characters of bytes that no text holds are left out; they stand for themselves.
    """
    from tokenizers.pre_tokenizers import ByteLevel

    level, out = ByteLevel(add_prefix_space=False, use_regex=False), {}
    for c in map(chr, (*range(0x800), *range(0x800, 0xD800, 0x40), *range(0xE000, 0x110000, 0x1000))):
        for piece, _ in level.pre_tokenize_str(c):
            out.update(zip(piece, c.encode(), strict=True))
    return out


class Assembler:
    """Encodes and decodes turns; reserved ids follow the tokenizer's last."""

    def __init__(self, path: str):
        self.encoder = Encoder(path, plain=True)
        self.tokenizer = self.encoder.tokenizer
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.open, self.text, self.close = size, size + 1, size + 2
        self.kind = f"<u{self.encoder.width}"
        self.roles: dict[str, bytes] = {}
        self.pieces: list[bytes] | None = None
        self.spelled: dict[bytes, str] = {}

    def assemble(self, roles: list[str], texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(offsets, ids, loss) of all turns, one after the other.

        Segments are encoded separately; where they begin and end are prefix
        sums of their lengths, and so is the mask, of +1 where an assistant's text begins and -1 where it ends.
        """
        for role in set(roles) - self.roles.keys():
            self.roles[role] = self.encoder.encode([escape(role)])[0]
        role_ids, text_ids = [self.roles[r] for r in roles], self.encoder.encode([escape(t) for t in texts])
        n_role, n_text = (np.fromiter(map(len, x), np.int64, len(x)) // self.encoder.width for x in (role_ids, text_ids))
        offsets = np.concatenate([[0], np.cumsum(n_role + n_text + 3)])
        ids = np.empty(offsets[-1], np.int32)
        mark = offsets[:-1] + 1 + n_role
        ids[offsets[:-1]], ids[mark], ids[offsets[1:] - 1] = self.open, self.text, self.close
        for begin, n, parts in ((offsets[:-1] + 1, n_role, role_ids), (mark + 1, n_text, text_ids)):
            ids[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())] = np.frombuffer(b"".join(parts), self.kind)
        own = np.fromiter((r == ASSISTANT for r in roles), bool, len(roles))
        step = np.zeros(offsets[-1] + 1, np.int32)
        np.add.at(step, mark[own] + 1, 1)
        np.add.at(step, offsets[1:][own] - 1, -1)
        return offsets, ids, np.cumsum(step[:-1]) > 0

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids of the tokenizer's own."""
        if self.pieces is None:
            byte, tokens = _byte_of(), {v: k for k, v in self.tokenizer.get_vocab(with_added_tokens=True).items()}
            special = set(self.tokenizer.get_added_tokens_decoder())
            self.pieces = [tokens.get(k, "").encode() if k in special else bytes(byte.get(c, ord(c)) for c in tokens.get(k, "")) for k in range(self.open)]
        return b"".join(map(self.pieces.__getitem__, ids.tolist())).decode(errors="replace")

    def parse(self, offsets: np.ndarray, ids: np.ndarray, loss: np.ndarray) -> tuple[list[str], list[str], list[str | None], list[int]]:
        """(roles, texts, texts under the mask, characters) of turns, read from their ids and mask alone.

        A text under the mask is None if it is all of the turn's text.
        """
        begin, end = offsets[:-1], offsets[1:]
        mark = np.flatnonzero(ids == self.text)
        if len(mark) != len(begin) or not ((ids[begin] == self.open) & (ids[end - 1] == self.close) & (mark > begin) & (mark < end)).all():
            raise ValueError("not turns")
        sums = np.concatenate([[0], np.cumsum(loss)])
        masked, inside = sums[end] - sums[begin], sums[end - 1] - sums[mark + 1]
        whole = (masked == inside) & (inside == end - mark - 2)
        roles, texts, under, size = [], [], [], []
        for a, m, b, n, w in zip(begin.tolist(), mark.tolist(), end.tolist(), masked.tolist(), whole.tolist(), strict=True):
            key = ids[a + 1 : m].tobytes()
            if key not in self.spelled:
                self.spelled[key] = self.decode(ids[a + 1 : m])
            role, text = self.spelled[key], self.decode(ids[m + 1 : b - 1])
            size.append(len(OPEN) + len(role) + len(TEXT) + len(text) + len(CLOSE))
            roles.append(unescape(role))
            texts.append(unescape(text))
            # whatever the role says, the mask decides
            under.append("" if not n else None if w else unescape(self.decode(ids[a:b][loss[a:b]])))
        return roles, texts, under, size


_assemblers: dict[str, Assembler] = {}


def assembler(path: str) -> Assembler:
    """One for each worker process."""
    if path not in _assemblers:
        _assemblers[path] = Assembler(path)
    return _assemblers[path]


SCHEMA = "conv_id long, turn long, nth long, ids array<int>, loss array<boolean>"
#: Turns encoded or decoded together.
TURNS = 1024


def format_chats(conversations: DataFrame, tokenizer: str) -> DataFrame:
    """One row for each turn: conv_id, turn, nth (a hash that orders repeated turns), ids, loss.

    Turns stay rows, so a conversation of any length is never one cell; its ids
    are those of its rows by (turn, nth).  Null roles and texts are empty, a null
    turn comes first, a null conv_id is a conversation of its own, repeated rows are repeated turns.
    An empty text has no ids and nothing under its mask, a text of any length is encoded whole.
    Other columns, such as ids, nth or loss of the input, are ignored; empty in, empty out.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = assembler(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, TURNS):
                part = batch.slice(at, TURNS)
                offsets, ids, loss = own.assemble(part["role"].to_pylist(), part["text"].to_pylist())
                cut = pa.array(offsets.astype(np.int32))
                yield pa.RecordBatch.from_arrays([part["conv_id"], part["turn"], part["nth"], pa.ListArray.from_arrays(cut, pa.array(ids)), pa.ListArray.from_arrays(cut, pa.array(loss))], ["conv_id", "turn", "nth", "ids", "loss"])

    return rows.withColumn("nth", F.xxhash64("role", "text")).mapInArrow(run, SCHEMA)


def read_turns(formatted: DataFrame, tokenizer: str) -> DataFrame:
    """Formatted turns read back: conv_id, turn, nth, role, text, loss (the text under the mask, null if it is all of text), chars."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = assembler(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, TURNS):
                part = batch.slice(at, TURNS)
                ids, loss = part["ids"], part["loss"]
                offsets = ids.offsets.to_numpy().astype(np.int64)
                roles, texts, under, size = own.parse(offsets - offsets[0], ids.flatten().to_numpy(), loss.flatten().to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([part["conv_id"], part["turn"], part["nth"], pa.array(roles, pa.string()), pa.array(texts, pa.string()), pa.array(under, pa.string()), pa.array(size, pa.int64())], ["conv_id", "turn", "nth", "role", "text", "loss", "chars"])

    return formatted.select("conv_id", "turn", "nth", "ids", "loss").mapInArrow(run, "conv_id long, turn long, nth long, role string, text string, loss string, chars long")


def digests(formatted: DataFrame, tokenizer: str) -> DataFrame:
    """Read turns back from their ids: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Turns are decoded where they lie; a conversation's texts then stream through one task in order
    of its turns, with a running digest for state: its length costs no memory.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state, out = None, None, []

        def flush() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            made = [pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)]
            return pa.RecordBatch.from_arrays(made, ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        def done() -> None:
            n, turns, chars, loss, size = state
            out.append((held[0], n, turns.hexdigest(), chars, loss.hexdigest(), size))

        for batch in batches:
            for conv, role, text, under, size in zip(*[batch[c].to_pylist() for c in ("conv_id", "role", "text", "loss", "chars")], strict=True):
                if held is None or conv != held[0]:
                    if held is not None:
                        done()
                    held, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                under = text if under is None else under
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(under)
                state[3].update(under.encode())
                state[4] += size
            if len(out) >= TURNS:
                yield flush()
                out = []
        if held is not None:
            done()
        if out:
            yield flush()

    rows = read_turns(formatted, tokenizer).repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "nth")
    return rows.select("conv_id", "role", "text", "loss", "chars").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
