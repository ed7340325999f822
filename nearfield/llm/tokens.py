"""Token counts and ids of whole texts, exactly as the public tokenizers library gives them.

Byte-level BPE never joins a character that is not white space with a space after it. So a text is cut there, equal pieces of a batch
are encoded once, and pieces met before come from a bounded memory. Texts with other white space before a space go to the
library whole, long ones cut between a letter and a space. Special strings inside texts are found by the library, as none holds a space.

A null text counts as empty. Very long texts are cut into pieces like any other. Batches hold BATCH_BYTES at most, save a single larger text.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.spark import bounded_batches, tidy

DEFAULT_FILE = "byte_bpe_50k.json"
BATCH_BYTES = 4 << 20
#: The memory of pre-tokens starts anew beyond so many pieces, ids or characters.
MOST_PIECES, MOST_IDS, MOST_CHARS = 400_000, 4_000_000, 8_000_000
#: Pre-tokens and other pieces that are learnt at a time, as the library's answers take many times their room.
LEARN_PRETOKENS, LEARN_OTHERS = 16_384, 2_048
SEGMENT = 1 << 16
#: White space, or what some tables take for it, before a space.
UNSAFE = r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{180E}\x{2000}-\x{200B}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}] "
#: A piece that is one word, maybe after a line end and before ASCII marks that start neither a contraction nor a special string: pre-tokens that are known without the library's splitter.
WORD = r"^(?P<line>\n?)(?P<word> ?[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[!-&(-/:;=?@\[-`{}~]*)$"
#: A line end between characters that are no white space may be cut before it; it is then written as a space and LINE.
LINE = "\x01"
SINGLE_LINE_END = r"([^\x{01}\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{180E}\x{2000}-\x{200B}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}])\n([!-~])"
SAFE_CUT = re.compile(r"(?<=[A-Za-z]) ")


def segments(text: str, size: int = SEGMENT) -> list[str]:
    """Pieces of about that many characters, cut between a letter and a space; longer where there is no such place."""
    out, at = [], 0
    while len(text) - at > size:
        cut = SAFE_CUT.search(text, at + size)
        if not cut:
            break
        out.append(text[at : cut.start()])
        at = cut.start()
    out.append(text[at:])
    return out


def byte_characters() -> list[str]:
    """Byte-level BPE's printable stand-in for each byte: printable bytes are themselves, the others follow from 256 on, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(rest)) for b in range(0x100)]


_ENCODERS: dict[str, Encoder] = {}


def encoder_for(file: str, most_pieces: int | None = None) -> Encoder:
    """One encoder for each Python worker, so that its memory of pieces (most_pieces, else MOST_PIECES) serves all tasks that the worker runs."""
    if file not in _ENCODERS:
        _ENCODERS[file] = Encoder(file)
    _ENCODERS[file].most_pieces = most_pieces
    return _ENCODERS[file]


class Encoder:
    """Token ids by way of distinct pre-tokens: what a piece consists of is found in bulk, and each pre-token goes to the library's BPE model once."""

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(public_tokenizers.path(file))
        self.stand_ins = dict(enumerate(byte_characters()))
        self.most_pieces: int | None = None
        self._forget()

    def _forget(self) -> None:
        self.rows: dict[str, int] = {"": -1}
        self.lengths, self.starts, self.flat, self.chars = np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, np.uint32), 0

    def _learn(self, keys: list[str], got: list[list[int]]) -> None:
        self.rows.update(zip(keys, range(len(self.lengths), len(self.lengths) + len(keys)), strict=True))
        self.chars += sum(map(len, keys))
        lengths = np.fromiter(map(len, got), np.int32, len(got))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths, dtype=np.int32) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(got), np.uint32, int(lengths.sum()))])

    def _pretokens(self, texts: list[str]) -> np.ndarray:
        """Rows of distinct pre-tokens, none of which holds a NUL; the empty one has no row."""
        new = [t for t in texts if t not in self.rows]
        tokenize = self.library.model.tokenize
        for at in range(0, len(new), LEARN_PRETOKENS):
            some = new[at : at + LEARN_PRETOKENS]
            shown = "\0".join(some).encode().decode("latin-1").translate(self.stand_ins | {0: "\0"}).split("\0")
            self._learn(some, [[t.id for t in tokenize(x)] for x in shown])
        return np.fromiter(map(self.rows.__getitem__, texts), np.int32, len(texts))

    def _others(self, pieces: list[str]) -> np.ndarray:
        """Rows of pieces that the library splits itself. Their keys start with NUL, apart from pre-tokens."""
        new = [p for p in dict.fromkeys(pieces) if "\0" + p not in self.rows]
        for at in range(0, len(new), LEARN_OTHERS):
            some = new[at : at + LEARN_OTHERS]
            self._learn(["\0" + p for p in some], [e.ids for e in self.library.encode_batch_fast(some, add_special_tokens=False)])
        return np.fromiter((self.rows["\0" + p] for p in pieces), np.int32, len(pieces))

    def _parts(self, pieces: pa.Array) -> np.ndarray:
        """For each distinct piece the rows of its line end, word and marks; -1: it has none."""
        out = np.full((len(pieces), 3), -1, np.int32)
        found = pc.extract_regex(pieces, WORD)
        known = found.is_valid().to_numpy(zero_copy_only=False)
        at = np.flatnonzero(known)
        if len(at):
            found = found.take(pa.array(at))
            for i, name in enumerate(("line", "word", "marks")):
                coded = found.field(name).dictionary_encode()
                rows = self._pretokens(coded.dictionary.to_pylist())
                out[at, i] = rows[coded.indices.to_numpy()]
        rest = np.flatnonzero(~known)
        out[rest, 1] = self._others(pieces.take(pa.array(rest)).to_pylist())
        return out

    def _pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Rows of all the texts' pre-tokens, and how many each text has."""
        if len(self.rows) > (self.most_pieces or MOST_PIECES) or len(self.flat) > MOST_IDS or self.chars > MOST_CHARS:
            self._forget()
        lists = pc.split_pattern(pc.replace_substring_regex(texts, SINGLE_LINE_END, rf"\1 {LINE}\2"), " ")
        sizes = pc.list_value_length(lists).to_numpy().astype(np.int64)
        first = np.cumsum(sizes) - sizes
        values = lists.flatten()
        coded = values.dictionary_encode()
        kinds = coded.dictionary
        spaced = pc.replace_substring_regex(pc.binary_join_element_wise("", kinds, " "), f"^ {LINE}", "\n")
        parts = self._parts(spaced)[coded.indices.to_numpy()]
        parts[first] = [-1, -1, -1]
        starts = values.take(pa.array(first)).dictionary_encode()
        parts[first, 1] = self._others(starts.dictionary.to_pylist())[starts.indices.to_numpy()]
        there = parts >= 0
        return parts[there], np.add.reduceat(there.sum(axis=1), first)

    def _whole(self, text: str) -> np.ndarray:
        return np.concatenate([np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(segments(text), add_special_tokens=False)])

    def _split(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        odd = pc.or_(pc.match_substring_regex(texts, UNSAFE), pc.match_substring(texts, LINE)).to_numpy(zero_copy_only=False)
        return np.flatnonzero(~odd), np.flatnonzero(odd)

    def counts(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        plain, odd = self._split(texts)
        if len(plain):
            rows, sizes = self._pieces(texts.take(pa.array(plain)) if len(odd) else texts)
            total = np.r_[np.int32(0), np.cumsum(self.lengths[rows], dtype=np.int32)]
            ends = np.cumsum(sizes)
            out[plain] = total[ends] - total[ends - sizes]
        for i in odd:
            out[i] = len(self._whole(texts[i].as_py()))
        return out

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and each text's count."""
        plain, odd = self._split(texts)
        counts, flat = np.zeros(len(texts), np.int64), np.empty(0, np.uint32)
        if len(plain):
            rows, sizes = self._pieces(texts.take(pa.array(plain)) if len(odd) else texts)
            lengths = self.lengths[rows]
            total = np.r_[np.int32(0), np.cumsum(lengths, dtype=np.int32)]  # a batch of texts has fewer than 2 ** 31 bytes
            flat = self.flat[np.repeat(self.starts[rows] - total[:-1], lengths) + np.arange(total[-1], dtype=np.int32)]
            ends = np.cumsum(sizes)
            counts[plain] = total[ends] - total[ends - sizes]
        if not len(odd):
            return flat, counts
        ends = np.cumsum(counts)
        parts = {i: self._whole(texts[i].as_py()) for i in odd.tolist()}
        pieces = [parts[i] if i in parts else flat[ends[i] - counts[i] : ends[i]] for i in range(len(texts))]
        for i, p in parts.items():
            counts[i] = len(p)
        return np.concatenate(pieces), counts


def by_bytes(sizes: np.ndarray, most: int = BATCH_BYTES) -> list[tuple[int, int]]:
    """Runs of rows of about that many bytes."""
    if not len(sizes):
        return []
    block = (np.cumsum(sizes) - sizes) // most
    cuts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    return list(zip(cuts.tolist(), [*cuts[1:].tolist(), len(sizes)], strict=True))


def balanced(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[pa.RecordBatch]:
    """The same rows in the same order in batches of about BATCH_BYTES of text, cut or joined; null texts become empty."""
    most, held, size = most or BATCH_BYTES, [], 0

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        at = batch.schema.get_field_index("text")
        batch = batch.set_column(at, "text", pc.fill_null(batch.column("text"), ""))
        sizes = pc.binary_length(batch.column("text")).to_numpy().astype(np.int64)
        for a, b in by_bytes(sizes, most):
            held.append(batch.slice(a, b - a))
            size += int(sizes[a:b].sum())
            if size >= most:
                yield joined()
                held, size = [], 0
    if held:
        yield joined()


def _count(file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(file)
        for batch in balanced(batches):
            texts = batch.column("text")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pc.binary_length(texts).cast(pa.int64()), pa.array(encoder.counts(texts))], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, file: str = DEFAULT_FILE, limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), a row for each row of docs; ids never leave the task. Empty and null texts have no tokens."""
    bounded_batches(docs.sparkSession)
    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(_count(file)), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
