"""Vector bin packing of token pieces under limits on tokens, segments and loss-bearing tokens.

A document becomes the ids of its prompt (if a column holds one; a prompt bears no loss), those of its text and one end id.
Pieces that reach a limit on their own, tokens or loss-bearing ones, are cut from its front; the rest is one piece of an open
bin. Bins are filled within blocks of bounded size, inside the task that tokenised them, so nothing but the input is moved: of
all pieces that fit, the one whose vector (tokens, segments, loss) has the largest dot product with the room left comes next.
What a block's last, half-filled bin holds goes on to the next block; only a task's last bins may stay short.

Nulls and empty texts are one piece, the end id; a null prompt is empty. Very long texts are cut into as many pieces as they
need. Repeated rows are packed each; pieces alike are interchangeable, so ties between them don't matter. Sequence ids are
unique, not dense: they hold the task's number in their upper bits. An empty table gives no rows. Other columns of the input are
not read.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertow.llm.common import by_chunks, doc_texts, map_arrow, text_or_empty

SCHEMA = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens")])


@dataclass(frozen=True)
class Limits:
    max_tokens: int = 4096
    max_segments: int = 512
    max_loss_tokens: int = 4096
    block_pieces: int = 4096


class WordEncoder:
    """Ids by a `tokenizers` file with word ends, each distinct word encoded once and kept.

    The vocabulary's pre-tokens never hold white space and its normaliser (NFC, white space to a blank, lower case) works
    within words, so the ids of a text are those of its words between ASCII white space. Words of Latin letters, digits and
    signs are merged by tiktoken's kernel, which is several times faster: the file's merges become ranks, and the end of a
    word the byte FF, which UTF-8 lacks and which joins its neighbour first. Other words go to the `tokenizers` library, and so
    do words with the mark that begins the file's special strings, which the library gives ids of their own.
    """

    END = b"\xff"
    PLAIN = re.compile("[\x00-\x7f\xa1-\xac\xae-\u024f\u2010-\u2027\u2030-\u205e]*")
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str, max_cache: int = 600_000):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        model = json.loads(self.tokenizer.to_str())["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        # the byte-level alphabet: printable bytes stand for themselves, others for code points from 256 on
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in own]
        byte_of = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}

        def raw(token: str) -> bytes:
            at_end = token.endswith(suffix)
            return bytes(byte_of[c] for c in (token[: -len(suffix)] if at_end else token)) + self.END * at_end

        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        order = [bytes([b]) for b in range(256)] + [bytes([b]) + self.END for b in range(255)] + [raw(x + y) for x, y in merges]
        ranks: dict[bytes, int] = {}
        for t in order:
            ranks.setdefault(t, len(ranks))
        ids = {raw(t): i for t, i in vocab.items() if t not in ("<|startoftext|>", "<|endoftext|>")}
        self.bytes_of = [ids.get(t, 0).to_bytes(4, "little") for t in ranks]
        self.merge = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.pieces = regex.compile(self.SPLIT).findall
        self.cache: dict[bytes, bytes] = {}
        self.max_cache = max_cache

    def word(self, w: bytes) -> bytes:
        s = w.decode("utf-8", "replace")
        if "<|" in s:
            return np.array(self.tokenizer.encode(s, add_special_tokens=False).ids, "<u4").tobytes()
        table = self.bytes_of
        if s.isascii():
            s = s.lower()
            if s.isalpha():
                return b"".join([table[i] for i in self.merge(s.encode() + self.END)])
        elif not self.PLAIN.fullmatch(s):
            return np.array(self.tokenizer.encode(s, add_special_tokens=False).ids, "<u4").tobytes()
        else:
            s = unicodedata.normalize("NFC", s).lower()
            if s.isalpha():
                return b"".join([table[i] for i in self.merge(s.encode() + self.END)])
        head = w[:-1]
        if w[-1] in b".,;:!?" and head and head[-1:].isalnum() and head in self.cache:
            return self.cache[head] + b"".join([table[i] for i in self.merge(w[-1:] + self.END)])
        return b"".join([table[i] for p in self.pieces(s) for i in self.merge(p.encode() + self.END)])

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        split = [t.split() for t in texts]
        cache = self.cache
        if len(cache) > self.max_cache:
            cache.clear()
        for w in set().union(*split).difference(cache):
            cache[w] = self.word(w)
        get = cache.__getitem__
        return [b"".join(map(get, s)) for s in split]


class Packer:
    """Fills bins from pieces (tokens, loss tokens); one block at a time."""

    def __init__(self, limits: Limits, first_sequence: int = 0):
        self.limits, self.next_sequence = limits, first_sequence
        self.left: list[tuple[int, int, object]] = []

    def take(self) -> int:
        self.next_sequence += 1
        return self.next_sequence - 1

    def pack(self, pieces: list[tuple[int, int, object]], last: bool) -> Iterator[tuple[int, int, object]]:
        """Yields (sequence, offset, payload). Unless `last`, pieces of a half-filled bin wait for the next block."""
        pieces, self.left = self.left + pieces, []
        if not pieces:
            return
        m = self.limits
        cap = np.array([m.max_tokens, m.max_segments, m.max_loss_tokens], float)
        # by distinct (tokens, loss): pieces alike are interchangeable
        pairs = np.array([(t, x) for t, x, _ in pieces], np.int64)
        kinds, kind_of = np.unique(pairs, axis=0, return_inverse=True)
        stock: list[list[object]] = [[] for _ in kinds]
        for k, (_, _, payload) in zip(kind_of.ravel(), pieces, strict=True):
            stock[k].append(payload)
        left = np.array([len(s) for s in stock])
        vec = np.column_stack([kinds[:, 0], np.ones(len(kinds)), kinds[:, 1]]) / cap
        while left.any():
            room, chosen = np.ones(3), []
            while True:
                fits = (left > 0) & (vec <= room + 1e-12).all(axis=1)
                if not fits.any():
                    break
                score = np.where(fits, vec @ room, -1.0)
                k = int(score.argmax())
                chosen.append((k, stock[k].pop()))
                left[k] -= 1
                room = room - vec[k]
            if not chosen:
                raise ValueError("a piece exceeds the limits on its own")
            if not last and not left.any():
                self.left = [(int(kinds[k, 0]), int(kinds[k, 1]), p) for k, p in chosen]
                return
            sequence, at = self.take(), 0
            for k, p in chosen:
                yield sequence, at, p
                at += int(kinds[k, 0])


_encoders: dict[str, WordEncoder] = {}


def _pack(path: str, end_id: int, limits: Limits, prompted: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encoder = _encoders.get(path) or _encoders.setdefault(path, WordEncoder(path))
    packer = Packer(limits, TaskContext.get().partitionId() << 40)
    end = np.array([end_id], "<u4").tobytes()

    def rows(placed: Iterator) -> pa.RecordBatch:
        cols = [[] for _ in SCHEMA]
        for sequence, offset, (doc, start, length, crc, total, loss) in placed:
            for c, v in zip(cols, (doc, start, length, crc, total, sequence, offset, loss), strict=True):
                c.append(v)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=SCHEMA)

    waiting: list[tuple[int, int, object]] = []
    for batch, texts in by_chunks(batches):
        full = []
        before = encoder.encode([p.encode("utf-8", "surrogatepass") for p in batch.column(2).to_pylist()]) if prompted else [b""] * len(texts)
        for doc, head, ids in zip(batch.column(0).to_pylist(), before, encoder.encode(texts), strict=True):
            ids = head + ids + end
            total, from_here = len(ids) // 4, len(head) // 4
            start = 0
            while start < total:
                stop = min(total, start + limits.max_tokens, max(start, from_here) + limits.max_loss_tokens)
                part = ids[4 * start : 4 * stop]
                loss = max(stop - max(start, from_here), 0)
                piece = (doc, start, stop - start, zlib.crc32(part), total, loss)
                if stop - start == limits.max_tokens or loss == limits.max_loss_tokens and not prompted:
                    full.append((packer.take(), 0, piece))
                else:
                    waiting.append((stop - start, loss, piece))
                start = stop
        if full:
            yield rows(iter(full))
        while len(waiting) >= limits.block_pieces:
            block, waiting = waiting[: limits.block_pieces], waiting[limits.block_pieces :]
            yield rows(packer.pack(block, last=False))
    yield rows(packer.pack(waiting, last=True))


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 2, limits: Limits = Limits(), prompt: str | None = None) -> DataFrame:
    """One row per piece: its document, place there, CRC of its ids, its sequence and offset, and its loss-bearing tokens: all
    of them, or where `prompt` names a column of instructions, those that follow these."""
    texts = doc_texts(docs) if prompt is None else docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text"), text_or_empty(prompt).alias("prompt"))
    return map_arrow(texts, lambda batches: _pack(tokenizer_path, end_id, limits, prompt is not None, batches), SCHEMA)
