"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

Texts are cut into the matches of a pattern; each match is encoded alone. The library does the merges; what it
returned for a match is kept in a bounded memo, since words repeat. Merges: any two parts whose concatenation has
a rank may merge, lowest rank first, so every split of a ranked token whose halves are ranked is listed as a merge.
A match that has a rank itself is one token.

Defined results: null text is encoded as the empty text (no ids); empty text gives no ids, whose digest is that of
the empty string; ids decode to the exact bytes; offsets are in code points, a token holding part of a character
covers that whole character; a token stream that ends inside a character decodes to the bytes it has, and
``decode_text`` replaces the incomplete part by U+FFFD. Repeated rows are encoded each; columns other than those
named are dropped, so clashing names do no harm.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lensmill.llm.common import rows_of, short, to_batch

#: Code points with Unicode's White_Space property, as the inside of a character class.
SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Letters and numbers among the code points below U+0250, as the insides of character classes.
LATIN_LETTERS = "A-Za-z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u024f"
LATIN_NUMBERS = "0-9\\xb2\\xb3\\xb9\\xbc-\\xbe"
#: Entries of the memo of encoded matches; when full it starts anew. Longer matches are not kept.
MEMO_ENTRIES, MEMO_LENGTH = 400_000, 64


def byte_table() -> dict[int, str]:
    """The printable stand-in of each byte: printable Latin-1 bytes stand for themselves, others follow from U+0100."""
    kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


def translated(pattern: str, spaces: str, letters: str, numbers: str) -> str:
    """The pattern with its classes for space, letters and numbers spelled out, in and outside of brackets."""
    out, inside, i = [], False, 0
    classes = {"\\s": spaces, "\\p{L}": letters, "\\p{N}": numbers}
    while i < len(pattern):
        hit = next((k for k in classes if pattern.startswith(k, i)), None)
        if hit:
            out.append(classes[hit] if inside else f"[{classes[hit]}]")
            i += len(hit)
        elif pattern.startswith("\\S", i) and not inside:
            out.append(f"[^{spaces}]")
            i += 2
        else:
            inside = pattern[i] == "[" or inside and pattern[i] != "]"
            out.append(pattern[i])
            i += 1
    return "".join(out)


class Splitter:
    """Cuts texts into the matches of the pattern: a fast expression for Latin texts, a full one for others."""

    def __init__(self, pattern: str):
        import regex

        self.latin = re.compile(translated(pattern, "\\t-\\r \\x85\\xa0", LATIN_LETTERS, LATIN_NUMBERS)).findall
        self.full = regex.compile(translated(pattern, SPACES, "\\p{L}", "\\p{N}")).findall
        self.foreign = re.compile("[^\\x00-\\u024f]").search

    def __call__(self, text: str) -> list[str]:
        return self.latin(text) if text.isascii() or not self.foreign(text) else self.full(text)


class ByteBPE:
    """Encoder and decoder for one rank file and pattern."""

    def __init__(self, rank_path: str, pattern: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, models, pre_tokenizers

        with open(rank_path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        table = byte_table()
        spelled = {token: "".join(table[b] for b in token) for token in ranks}
        merges = [
            (spelled[token[:i]], spelled[token[i:]])
            for token in sorted(ranks, key=ranks.get)
            for i in range(1, len(token))
            if token[:i] in ranks and token[i:] in ranks
        ]
        model = models.BPE(vocab={spelled[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True)
        self.tokenizer = Tokenizer(model)
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.split = Splitter(pattern)
        back = {c: b for b, c in table.items()}
        self.bytes_of = {r: bytes(back[c] for c in spelled[t]) for t, r in ranks.items()}
        self.memo: dict[str, str] = {}

    def encode_spelled(self, text: str) -> str:
        """The ids in decimal, joined by commas."""
        parts, memo = self.split(text), self.memo
        missing = [p for p in set(parts) if p not in memo]
        long_ones = {}
        if missing:
            if len(memo) + len(missing) > MEMO_ENTRIES:
                memo.clear()
                missing = list(set(parts))
            for p, e in zip(missing, self.tokenizer.encode_batch_fast(missing, add_special_tokens=False), strict=True):
                (memo if len(p) <= MEMO_LENGTH else long_ones)[p] = ",".join(map(str, e.ids))
        if long_ones:
            return ",".join([long_ones[p] if p in long_ones else memo[p] for p in parts])
        return ",".join(map(memo.__getitem__, parts))

    def encode(self, text: str) -> list[int]:
        spelled = self.encode_spelled(text)
        return list(map(int, spelled.split(","))) if spelled else []

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def offsets(self, text: str, ids) -> tuple[np.ndarray, np.ndarray]:
        """Start and end code point of each token."""
        raw = np.frombuffer(text.encode(), np.uint8)
        character = np.cumsum((raw & 0xC0) != 0x80) - 1
        ends = np.cumsum([len(self.bytes_of[i]) for i in ids], dtype=np.int64)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        return character[starts], character[ends - 1] + 1


@lru_cache(2)
def coder(rank_path: str, pattern: str) -> ByteBPE:
    return ByteBPE(rank_path, pattern)


def _over_texts(df: DataFrame, id_col: str, text_col: str, schema: pa.Schema, ddl: str, row) -> DataFrame:
    """row(text) gives the columns after doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in short(batches):
            out: list[list] = [[] for _ in schema]
            for doc_id, text in rows_of(batch, "doc_id", "text"):
                for column, value in zip(out, (doc_id, *row(text or "")), strict=True):
                    column.append(value)
            yield to_batch(schema, out)

    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, ddl)


def encode(df: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>, starts array<int>, ends array<int> of every row; no shuffle."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))])

    def row(text: str) -> tuple:
        own = coder(rank_path, pattern)
        ids = own.encode(text)
        return (ids, *own.offsets(text, ids)) if ids else ([], [], [])

    return _over_texts(df, id_col, text_col, schema, "doc_id bigint, ids array<int>, starts array<int>, ends array<int>", row)


def decode(df: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, raw binary, text string: the exact bytes, and those as text with U+FFFD for incomplete characters."""
    schema = pa.schema([("doc_id", pa.int64()), ("raw", pa.binary()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(rank_path, pattern)
        for batch in short(batches):
            found = [(i, own.decode(ids or [])) for i, ids in rows_of(batch, "doc_id", "ids")]
            yield to_batch(schema, [[i for i, _ in found], [b for _, b in found], [b.decode("utf-8", "replace") for _, b in found]])

    return df.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id bigint, raw binary, text string")


def digests(df: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes each whole text and decodes its ids in one pass."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def row(text: str) -> tuple:
        own = coder(rank_path, pattern)
        spelled = own.encode_spelled(text)
        ids = list(map(int, spelled.split(","))) if spelled else []
        return len(ids), hashlib.sha256(spelled.encode()).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest()

    return _over_texts(df, id_col, text_col, schema, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string", row)
