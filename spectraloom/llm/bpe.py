"""Byte-level BPE by forced boundaries.

A byte pair that occurs inside no token of the vocabulary can never be merged across: where it
stands, a token must end.  Texts are cut at such pairs (those of a visible character followed by
white space, where the pre-tokeniser, too, always ends a word and looks no further back), each
fragment is encoded on its own, and the ids are put together again.  Fragments repeat, so a
task remembers the ids of those it has met, up to a fixed number.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from spectraloom.llm.common import slices

FRAGMENTS_KEPT = 600_000
_SPACES = (9, 10, 11, 12, 13, 32)


def byte_alphabet() -> dict[str, int]:
    """Byte of each character of the byte-level alphabet: visible bytes stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def inner_pairs(spec: dict) -> set[tuple[int, int]]:
    """Byte pairs that occur inside some token."""
    alphabet, found = byte_alphabet(), set()
    for token in spec["model"]["vocab"]:
        if all(c in alphabet for c in token):
            data = bytes(alphabet[c] for c in token)
            found.update(zip(data, data[1:]))
    return found


def cutter(spec: dict) -> tuple[tuple[bytes, ...], re.Pattern, re.Pattern]:
    """(ends of characters after which white space is no certain cut, plain and careful cutter).

    White space other than the six ASCII ones is such a character: the pre-tokeniser joins it
    with what follows.  The careful cutter leaves those places uncut.
    """
    unsure = {bytes([a]) for a, b in inner_pairs(spec) if b in _SPACES and a not in _SPACES}
    unsure |= {chr(c).encode() for c in (*range(0x1C, 0x20), 0x180E)}
    unsure |= {chr(c).encode() for c in range(0x80, 0x3001) if chr(c).isspace()}
    after = b"(?:" + b"|".join(re.escape(u) for u in sorted(unsure)) + b")"
    space, seen = rb"[\x20\t-\r]", rb"[^\x20\t-\r]"
    plain = re.compile(space + b"*" + seen + b"+|" + space + b"+")
    careful = re.compile(
        b"(?:%b*%b*%b(?=%b))*(?:%b*%b+|%b+)" % (space, seen, after, space, space, seen, space)
    )
    return tuple(sorted(unsure)), plain, careful


@lru_cache(maxsize=2)  # a worker keeps it from task to task
def _encoder(spec_text: str) -> Encoder:
    return Encoder(spec_text)


class Encoder:
    def __init__(self, spec_text: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        spec = json.loads(spec_text)
        if any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take in white space are not supported")
        self.tokenizer = Tokenizer.from_str(spec_text)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.unsure, self.plain, self.careful = cutter(spec)
        self.known: dict[bytes, bytes] = {}
        self.recent: set[bytes] = set()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of UTF-8 texts."""
        cut = []
        for text in texts:
            careful = any(u in text for u in self.unsure)
            cut.append((self.careful if careful else self.plain).findall(text))
        now = set().union(*cut)
        new = [f for f in now if f not in self.known]
        if len(self.known) + len(new) > FRAGMENTS_KEPT:  # keep what is in use at the moment
            self.known = {f: self.known[f] for f in now if f in self.known}
        for at in range(0, len(new), 10_000):
            part = new[at : at + 10_000]
            fragments = [f.decode() for f in part]
            encoded = self.tokenizer.encode_batch_fast(fragments, add_special_tokens=False)
            for fragment, got in zip(part, encoded):
                self.known[fragment] = np.array(got.ids, "<u4").tobytes()
        self.recent = now
        return [b"".join(map(self.known.__getitem__, fragments)) for fragments in cut]

    def forget(self) -> None:
        """Keeps only the last batch's fragments."""
        self.known = {f: self.known[f] for f in self.recent}
        self.recent = set()


@lru_cache(maxsize=2)
def decoder_table(spec_text: str) -> list[bytes]:
    """Bytes of each id; added tokens give their own text."""
    spec, alphabet = json.loads(spec_text), byte_alphabet()
    vocab = spec["model"]["vocab"]
    added = {t["id"]: t["content"] for t in spec["added_tokens"]}
    table = [b""] * (max([*vocab.values(), *added]) + 1)
    for token, i in vocab.items():
        known = all(c in alphabet for c in token)
        table[i] = bytes(alphabet[c] for c in token) if known else token.encode()
    for i, content in added.items():
        table[i] = content.encode()
    return table


def _schema(df: DataFrame, *more: StructField) -> StructType:
    names = {f.name for f in more}
    return StructType([f for f in df.schema.fields if f.name not in names] + list(more))


def _with_column(
    df: DataFrame, field: StructField, kind: pa.DataType, compute, rows: int, done=lambda: None
) -> DataFrame:
    """``df`` with a computed column; ``done`` is called at the end of each task."""
    kept = [c for c in df.columns if c != field.name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, rows):
            made = pa.array(compute(batch), kind)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), made], names=[*kept, field.name]
            )
        done()

    return df.mapInArrow(run, _schema(df, field))


def encode(df: DataFrame, tokenizer_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds ``ids``: token ids packed as little-endian unsigned 32-bit integers.

    Null text counts as empty and gives no ids.  All other columns and all rows stay; a
    column already called ``ids`` is replaced.  The tokenizer file is read by the driver.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        spec_text = file.read()

    def compute(batch: pa.RecordBatch) -> list[bytes]:
        texts = batch.column(text).cast(pa.binary()).to_pylist()
        return _encoder(spec_text).encode([t or b"" for t in texts])

    def done() -> None:  # the worker goes on to other stages, which need the memory
        _encoder(spec_text).forget()

    return _with_column(df, StructField(ids, BinaryType()), pa.binary(), compute, 500, done)


def decode(df: DataFrame, tokenizer_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds ``text`` decoded from packed ids; bytes that are no UTF-8 become U+FFFD.

    Null ids count as none and give empty text; unknown ids give nothing.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        spec_text = file.read()

    def compute(batch: pa.RecordBatch) -> list[str]:
        table = decoder_table(spec_text)
        out = []
        for packed in batch.column(ids).to_pylist():
            numbers = np.frombuffer(packed or b"", "<u4")
            if len(numbers) and int(numbers.max()) >= len(table):
                numbers = numbers[numbers < len(table)]
            data = b"".join(map(table.__getitem__, numbers.tolist()))
            out.append(data.decode("utf-8", "replace"))
        return out

    return _with_column(df, StructField(text, StringType()), pa.string(), compute, 500)


def digests(df: DataFrame) -> DataFrame:
    """Digest columns of an encoded and decoded table."""
    return df.select(
        "doc_id",
        (F.length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
