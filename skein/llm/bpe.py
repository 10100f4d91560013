"""Operator 3. BPE encoding and decoding with content-defined chunks that are encoded once and reused."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from skein.llm.common import others

#: Bytes that the rolling hash sees, and the least, usual and greatest distance of two cuts.
WINDOW, MIN_CHUNK, MEAN_CHUNK, MAX_CHUNK = 32, 64, 512, 16384
#: A worker forgets its chunks or pieces when they take more than this; it loses time, not results.
POOL_BYTES, POOL_PIECES = 32 << 20, 400_000

# Unicode's White_Space, as the tokenizer's \s has it.
_WHITE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_PIECE = re.compile(f"[{_WHITE}]*[^{_WHITE}]+|[{_WHITE}]+")
#: Between a visible ASCII character and white space every text has a token boundary, whatever surrounds them.
_SYNC = re.compile(rb"(?<=[!-~])[ \n\t\r]")
#: A piece that certainly splits into a word with the space before it and what follows without letters, digits or apostrophes.
_SIMPLE = re.compile("( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\\[-`{-~]*)")
_GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)


def cuts(data: bytes) -> list[int]:
    """Where content-defined chunks of data end; the last is len(data). A cut depends on the WINDOW bytes before it."""
    if len(data) <= MIN_CHUNK:
        return [len(data)]
    h = _GEAR[np.frombuffer(data, np.uint8)]
    width = 1
    while width < WINDOW:  # h[i] becomes the sum of gear[data[i - j]] << j over twice as many j
        shifted = np.zeros_like(h)
        shifted[width:] = h[:-width] << np.uint32(width)
        h = h + shifted
        width *= 2
    marks = np.flatnonzero(h >> np.uint32(32 - (MEAN_CHUNK.bit_length() - 1)) == 0) + 1
    out, last = [], 0
    for m in marks.tolist():
        while m - last > MAX_CHUNK:
            last += MAX_CHUNK
            out.append(last)
        if m - last >= MIN_CHUNK:
            out.append(m)
            last = m
    while len(data) - last > MAX_CHUNK:
        last += MAX_CHUNK
        out.append(last)
    if last < len(data):
        out.append(len(data))
    return out


class _Pieces(dict):
    """piece -> (ids in decimal, decoded bytes, number of ids), through the library's own steps."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if self.tokenizer.normalizer is not None or any(any(c.isspace() for c in s) for s in self.special):
            raise ValueError("needs a byte-level vocabulary without normalizer and without special tokens that hold spaces")
        # The byte-level alphabet: printable bytes stand for themselves, the others for 256, 257, ...
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        self.decimal = [b"%d" % i for i in range(max(self.tokenizer.get_vocab(with_added_tokens=True).values()) + 1)]
        self.letter_of = [x for _, x in sorted((b, c) for c, b in letters.items())]
        self.old: dict[str, tuple[bytes, bytes, int]] = {}
        self.parts: dict[str, tuple[int, ...]] = {}
        self.old_parts: dict[str, tuple[int, ...]] = {}
        self.bytes_of = {i: bytes(map(letters.__getitem__, t)) if all(c in letters for c in t) else t.encode() for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}

    def ids(self, text: str) -> list[int]:
        simple = _SIMPLE.fullmatch(text)
        if simple and not any(s in text for s in self.special):
            word, rest = simple.groups()
            return [*self.part(word), *self.part(rest)] if rest else self.part(word)
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def part(self, word: str) -> tuple[int, ...]:
        """The ids of a string that the tokenizer does not split before its merges."""
        found = self.parts.get(word)
        if found is None:
            found = self.old_parts.get(word)
            if found is None:
                found = tuple([t.id for t in self.model.tokenize("".join([self.letter_of[b] for b in word.encode()]))])
            if len(self.parts) > POOL_PIECES:
                self.old_parts, self.parts = self.parts, {}
            self.parts[word] = found
        return found

    def __missing__(self, piece: str) -> tuple[bytes, bytes, int]:
        found = self.old.get(piece)
        if found is None:
            ids = self.ids(piece)
            found = b",".join(map(self.decimal.__getitem__, ids)), b"".join(map(self.bytes_of.__getitem__, ids)), len(ids)
        if len(self) > POOL_PIECES:  # pieces in use come back from the older half
            self.old = dict(self)
            self.clear()
        self[piece] = found
        return found


class ChunkCoder:
    """Encodes and decodes whole texts from a pool of encoded chunks.

    A chunk is encoded between its first and its last safe place (a visible ASCII
    character before white space), where every tokenization has a boundary. What lies
    between the last safe place of one chunk and the first of a later one is the join:
    it is encoded anew as one string that grows over following chunks until both its
    ends are safe places. There it agrees with the chunks' encodings by construction, so
    a join is encoded once and no ids are compared; the result is that of the whole text.
    """

    def __init__(self, path: str):
        self.pieces = _Pieces(path)
        self.pool: dict[bytes, tuple | None] = {}
        self.pool_bytes = self.hits = self.misses = 0

    def run(self, data: bytes) -> tuple[bytes, bytes, int]:
        """A string between two boundaries, from its pieces."""
        found = [*map(self.pieces.__getitem__, _PIECE.findall(data.decode()))]
        return b",".join([x[0] for x in found]), b"".join([x[1] for x in found]), sum([x[2] for x in found])

    def chunk(self, data: bytes) -> tuple | None:
        """(start and end of what is encoded, its encoding), or None for a chunk without two safe places."""
        try:
            found = self.pool[data]
            self.hits += 1
            return found
        except KeyError:
            pass
        self.misses += 1
        found, first = None, _SYNC.search(data, 1)
        if first:
            end = len(data) - 1
            while data[end] not in b" \n\t\r" or not 33 <= data[end - 1] <= 126:
                end -= 1
            if end > first.start():
                found = first.start(), end, self.run(data[first.start() : end])
        if self.pool_bytes > POOL_BYTES:
            self.pool.clear()
            self.pool_bytes = 0
        self.pool[data] = found
        self.pool_bytes += 200 + len(data) + (3 * len(data) if found else 0)
        return found

    def code(self, text: str | None) -> tuple[int, bytes, bytes]:
        """Number of ids, ids in decimal joined by commas, and the decoded text, in bytes."""
        data = (text or "").encode("utf-8", "surrogatepass")
        ids, decoded, n = [], [], 0
        start, open_at = 0, 0  # of the chunk; of the join that is not encoded yet
        for end in cuts(data):
            found = self.chunk(data[start:end])
            if found:
                first, last, coded = found
                for part in ((self.run(data[open_at : start + first]),) if start + first > open_at else ()) + (coded,):
                    ids.append(part[0])
                    decoded.append(part[1])
                    n += part[2]
                open_at = start + last
            start = end
        if open_at < len(data):
            part = self.run(data[open_at:])
            ids.append(part[0])
            decoded.append(part[1])
            n += part[2]
        return n, b",".join(ids), b"".join(decoded)


_CODERS: dict[str, ChunkCoder] = {}


def coder(path: str) -> ChunkCoder:
    """The worker's coder; its pools outlive a task and are rebuilt if the worker is lost."""
    if path not in _CODERS:
        _CODERS[path] = ChunkCoder(path)
    return _CODERS[path]


def encode_decode(df: DataFrame, text: str, path: str, keep: list[str], arrays: bool = False) -> DataFrame:
    """For every row the columns named in keep and n_tokens, ids_sha256, decoded_sha256; with arrays also ids and decoded.

    path names a byte-level vocabulary file that every executor can read. A null or
    empty text has no ids. Rows that repeat give repeated results, an empty table an
    empty one; columns not in keep, whatever their names, are not read, and those in
    keep named like a new one, in any case, are replaced. A text is taken whole, however long.
    """
    keep = others(keep, "n_tokens", "ids_sha256", "decoded_sha256", *["ids", "decoded"] * arrays)
    kept = df.select(*keep, text)
    fields = ["n_tokens long", "ids_sha256 string", "decoded_sha256 string"] + ["ids array<int>", "decoded string"] * arrays
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.select(*keep).schema)
    names = [f.split()[0] for f in fields]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out: dict[str, list] = {k: [] for k in names}
                for value in part.column(len(keep)).to_pylist():
                    n, ids, decoded = own.code(value)
                    out["n_tokens"].append(n)
                    out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                    whole = decoded.decode("utf-8", "replace")
                    out["decoded_sha256"].append(hashlib.sha256(whole.encode()).hexdigest())
                    if arrays:
                        out["ids"].append([*map(int, ids.split(b","))] if ids else [])
                        out["decoded"].append(whole)
                kinds = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32())}
                columns = [*part.columns[: len(keep)], *(pa.array(out[k], kinds.get(k, pa.string())) for k in names)]
                yield pa.RecordBatch.from_arrays(columns, [*part.schema.names[: len(keep)], *names])

    return kept.mapInArrow(work, ", ".join([head, *fields]))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_decode(docs, "text", public_tokenizers.path("byte_bpe_50k.json"), ["doc_id"])


QUERIES = {"op3_bpe": op3_bpe}
ORACLE_SQL: dict[str, str] = {}
