"""Byte-level BPE by prefix dynamic programming.

For a vocabulary made by merges, each prefix of a byte string has exactly one encoding, and its last
token is the one token t for which the rest's last token and t stay two tokens when encoded together.
So one table, the valid last token of each prefix, is the encoding of all prefixes at once: walking
back from the end gives the tokens, an append only extends the table, and an edit recomputes it from
where the text changed.

Corpus texts are first cut by the vocabulary's pattern, as its merges never cross a cut; each distinct
piece is encoded once for each task.

Defined results: a null text has null tokens and counts; an empty one has none; ids may be null or
repeat, each row is encoded by itself; an empty table gives an empty result; other columns play no
part. Special tokens in a text are ordinary text.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _spark, _text

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces, segments and pairs of tokens, each, that a task remembers; beyond it the memory starts anew.
REMEMBERED = 200_000
CHUNK = 4 << 20


class Vocabulary:
    """Tokens, their ranks, and which two tokens may stand side by side."""

    def __init__(self, ranks: dict[bytes, int]):
        self.rank = ranks
        self.token = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.split: dict[int, tuple[int, int] | None] = {}
        self.pairs: dict[int, bool] = {}
        self.begins: dict[bytes, int] = {}  # each beginning of a token: the token that it is, or -1
        for text in ranks:
            for k in range(1, len(text)):
                self.begins.setdefault(text[:k], -1)
        self.begins |= {text: t for text, t in ranks.items() if self.merge(text) == [t]}

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def merge(self, text: bytes) -> list[int]:
        """Encoding by merges, lowest rank first; only for single tokens, to learn their halves."""
        parts = [self.rank[text[i : i + 1]] for i in range(len(text))]
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.rank.get(self.token[parts[i]] + self.token[parts[i + 1]])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                return parts
            parts[at : at + 2] = [best]

    def halves(self, t: int) -> tuple[int, int] | None:
        """The two tokens whose merge gives t; None for a byte."""
        if t not in self.split:
            text = self.token[t]
            if len(text) == 1:
                self.split[t] = None
            else:
                # the last merge of t's own encoding: merge with t's rank left out
                parts = [self.rank[text[i : i + 1]] for i in range(len(text))]
                while len(parts) > 2:
                    best, at = None, -1
                    for i in range(len(parts) - 1):
                        r = self.rank.get(self.token[parts[i]] + self.token[parts[i + 1]])
                        if r is not None and r != t and (best is None or r < best):
                            best, at = r, i
                    if best is None:
                        break
                    parts[at : at + 2] = [best]
                self.split[t] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self.split[t]

    def together(self, a: int, b: int) -> bool:
        """Whether a followed by b encodes as just these two: no merge across their border comes before those inside."""
        limit = 1 << 62
        x, y = a, b
        while True:
            r = self.rank.get(self.token[x] + self.token[y])
            if r is not None and r < limit:
                return False
            if x > y:  # undo the later merge
                limit = x
                half = self.halves(x)
                if half is None:
                    limit = y + 1
                    half = self.halves(y)
                    if half is None:
                        return True
                    y = half[0]
                else:
                    x = half[1]
                    if x == limit:
                        return True
            else:
                limit = y + 1
                half = self.halves(y)
                if half is None:
                    limit = x
                    half = self.halves(x)
                    if half is None:
                        return True
                    x = half[1]
                else:
                    y = half[0]


class Prefixes:
    """A byte string with the valid last token of each of its prefixes."""

    def __init__(self, vocabulary: Vocabulary, text: bytes = b""):
        self.vocabulary, self.text, self.last = vocabulary, b"", []
        self.append(text)

    def append(self, text: bytes) -> None:
        """Extend; what is known of earlier prefixes stays. From each prefix the tokens that may follow its last one decide longer prefixes."""
        v, start = self.vocabulary, len(self.last)
        self.text += text
        whole, last = self.text, self.last
        last += [-1] * len(text)
        begins, pairs, n = v.begins.get, v.pairs, len(whole)
        for at in range(max(0, start - v.longest), n):
            before = last[at - 1] if at else -1
            for end in range(at + 1, n + 1):
                t = begins(whole[at:end])
                if t is None:
                    break
                if t >= 0 and end > start and last[end - 1] < 0:
                    if at == 0:
                        last[end - 1] = t
                    else:
                        key = before << 32 | t
                        fits = pairs.get(key)
                        if fits is None:
                            if len(pairs) >= REMEMBERED:
                                pairs.clear()
                            fits = pairs[key] = v.together(before, t)
                        if fits:
                            last[end - 1] = t

    def replace(self, start: int, stop: int, text: bytes) -> None:
        """Edit [start, stop): only prefixes that end after ``start`` are computed again, and those up to where the old table is met."""
        rest, old = self.text[stop:], self.last[stop:]
        self.text = self.text[:start]
        del self.last[start:]
        self.append(text)
        # Once a run of last tokens as long as the longest token equals the old one, all later ones do.
        run, width, at = 0, self.vocabulary.longest, 0
        while at < len(rest) and run < width:
            self.append(rest[at : at + 1])
            run = run + 1 if self.last[-1] == old[at] else 0
            at += 1
        self.text += rest[at:]
        self.last += old[at:]

    def tokens(self, end: int | None = None) -> list[int]:
        """Encoding of the first ``end`` bytes."""
        out, at = [], len(self.last) if end is None else end
        token, last = self.vocabulary.token, self.last
        while at:
            t = last[at - 1]
            out.append(t)
            at -= len(token[t])
        return out[::-1]


class Encoder:
    """Texts to tokens and back. What is remembered of a piece is its tokens as bytes of 32-bit numbers, which join into an array at once."""

    def __init__(self, vocabulary: Vocabulary, pattern: str = PATTERN):
        self.vocabulary = vocabulary
        self.pieces = regex.compile(pattern)
        self.table = [vocabulary.token.get(t, b"") for t in range(max(vocabulary.token) + 1)]
        self.piece_memory: dict[str, bytes] = {}
        self.segment_memory: dict[str, bytes] = {}  # with a space before it

    def forget(self) -> None:
        """Keep the vocabulary alone."""
        for memory in (self.piece_memory, self.segment_memory, self.vocabulary.pairs):
            memory.clear()

    def piece(self, text: str) -> bytes:
        known = self.piece_memory.get(text)
        if known is None:
            raw = text.encode("utf-8")
            whole = self.vocabulary.begins.get(raw, -1)
            known = np.array([whole] if whole >= 0 else Prefixes(self.vocabulary, raw).tokens(), np.int32).tobytes()
            if len(text) <= 64:
                if len(self.piece_memory) >= REMEMBERED:
                    self.piece_memory.clear()
                self.piece_memory[text] = known
        return known

    def _pieces(self, text: str) -> bytes:
        return b"".join(map(self.piece, self.pieces.findall(text)))

    def _segment(self, segment: str) -> bytes:
        known = self._pieces(" " + segment)
        if len(segment) <= 64:
            if len(self.segment_memory) >= REMEMBERED:
                self.segment_memory.clear()
            self.segment_memory[segment] = known
        return known

    def encoded(self, text: str) -> bytes:
        head, *rest = text.split(" ")
        found = list(map(self.segment_memory.get, rest))
        if None in found:
            missing = [s for s, k in zip(rest, found) if k is None]
            if any(not s or s[0].isspace() for s in missing):  # a space before white space: not every space begins a piece. Such segments are never remembered
                return self._pieces(text)
            found = [self._segment(s) if k is None else k for s, k in zip(rest, found)]
        return self._pieces(head) + b"".join(found)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encoded(text), np.int32).tolist()

    def decode(self, tokens) -> bytes:
        return b"".join(map(self.table.__getitem__, tokens))


_encoders: dict[str, Encoder] = {}


def encoder(path: str = VOCABULARY) -> Encoder:
    """One for each worker process; the file must be at ``path`` on every machine."""
    if path not in _encoders:
        _encoders[path] = Encoder(Vocabulary.load(path))
    return _encoders[path]


def encode_documents(docs: DataFrame, path: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, tokens, round_trip) of each document; round_trip: decoding gives the text's bytes."""

    def encoded(e, batches):
        for batch in _text.slices(batches, "_text", CHUNK):
            raws, sizes, same = [], [], []
            for text in batch.column("_text").to_pylist():
                if text is None:
                    raws.append(None), sizes.append(None), same.append(None)
                    continue
                tokens, raw = e.encoded(text), text.encode("utf-8")
                raws.append(tokens), sizes.append(len(raw))
                same.append(e.decode(np.frombuffer(tokens, np.int32).tolist()) == raw)
            count = [None if x is None else len(x) // 4 for x in raws]
            offsets = np.concatenate([[0], np.cumsum([c or 0 for c in count])])
            flat = np.frombuffer(b"".join(x for x in raws if x), np.int32)
            values = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()), mask=pa.array([x is None for x in raws]))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(sizes, pa.int64()), pa.array(count, pa.int64()), values, pa.array(same, pa.bool_())], [id_col, "n_bytes", "n_tokens", "tokens", "round_trip"])

    def run(batches):
        e = encoder(path)
        try:
            yield from encoded(e, batches)
        finally:
            e.forget()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(_spark.column(id_col).alias("_id"), _spark.column(text_col).alias("_text")).mapInArrow(_spark.frugal(run), f"{_spark.quoted(id_col)} {kind}, n_bytes bigint, n_tokens bigint, tokens array<int>, round_trip boolean")


def op5_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return encode_documents(_spark.read(spark, sf_dir, "documents"))
