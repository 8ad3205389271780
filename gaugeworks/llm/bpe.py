"""Byte-level BPE: exact merges by backtracking over Aho-Corasick matches, and decoding.

A text is cut by the pattern; each piece is encoded on its own. A piece that is itself a token stands as it is. For
any other, bytes become Latin-1 characters so that pyahocorasick, which works on str, gives the longest match at a
place. From the left the longest token is taken and shortened, or the last token is taken back, until all adjacent
tokens are compatible: a pair is compatible if merging its bytes by rank gives just this pair. By the locality of
merges such a row of tokens is unique and is what merging by rank gives. Positions found dead are marked, so each is
left once and the work is linear in the piece. Compatibility and pieces are memoised in bounded tables.
"""

from __future__ import annotations

import base64
import re
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from gaugeworks.llm import common

MEMO = 400_000  # entries of each table; a full one is emptied
_BEFORE_WORD = re.compile(r" (?=\S)")


def merge_by_rank(ranks: dict[bytes, int], piece: bytes) -> list[int]:
    """The definition: join the adjacent pair of least rank, leftmost first, until none is a token."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], 1 << 62), i) for i in range(len(parts) - 1))
        if rank == 1 << 62:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[x] for x in parts]


class Encoder:
    def __init__(self, rank_file: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line)}
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self.pattern, self.quick = regex.compile(pattern), pattern == public_tokenizers.PATTERN
        self.trie, self.id_of = ahocorasick.Automaton(), {}
        self.longest_token = max(map(len, self.ranks))
        for token, i in self.ranks.items():
            if len(token) == 1 or merge_by_rank(self.ranks, token) == [i]:  # merges can reach it
                self.id_of[token.decode("latin-1")] = i
                self.trie.add_word(token.decode("latin-1"), i)
        self.pairs: dict[tuple[int, int], bool] = {}
        self.spines: tuple[dict, dict] = ({}, {})
        self.pieces: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def spine(self, token: int, side: int) -> tuple[tuple[bytes, int, int], ...]:
        """Parts at the right (side 1) or left (0) edge while the token's bytes merge: (bytes, first rank, rank at which it is absorbed)."""
        if (known := self.spines[side].get(token)) is None:
            whole, parts, edge = self.bytes_of[token], [], []
            parts = [whole[i : i + 1] for i in range(len(whole))]
            born = -1
            while len(parts) > 1:
                rank, i = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 62), i) for i in range(len(parts) - 1))
                if i == (len(parts) - 2 if side else 0):
                    edge.append((parts[-side], born, rank))
                    born = rank
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            known = self.spines[side][token] = (*edge, (whole, born, 1 << 61))
        return known

    def compatible(self, a: int, b: int) -> bool:
        """No part at the right edge of a merges with one at the left edge of b while both stand; of equal ranks the left one goes first."""
        if (known := self.pairs.get((a, b))) is None:
            if len(self.pairs) >= MEMO:
                self.pairs.clear()
            ranks, left = self.ranks, self.spine(b, 0)
            known = True
            for x, x_born, x_gone in self.spine(a, 1):
                for y, y_born, y_gone in left:
                    if x_born < y_gone and y_born < x_gone and (r := ranks.get(x + y)) is not None and r < x_gone and r <= y_gone:
                        known = False
            self.pairs[a, b] = known
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        chars, n = piece.decode("latin-1"), len(piece)
        longest, id_of, pairs = self.trie.longest_prefix, self.id_of, self.pairs
        out: list[int] = []
        sizes: list[int] = []
        dead = bytearray(n + 1)
        pos, size = 0, longest(chars)
        while pos < n:
            while size:
                i = id_of.get(chars[pos : pos + size])
                if i is not None and not dead[pos + size]:
                    if not out:
                        break
                    fits = pairs.get((out[-1], i))
                    if self.compatible(out[-1], i) if fits is None else fits:
                        break
                size -= 1
            if size:
                out.append(i)
                sizes.append(size)
                pos += size
                size = longest(chars[pos : pos + self.longest_token]) if pos < n else 0
            else:
                dead[pos] = 1
                out.pop()
                size = sizes.pop()
                pos -= size
                size -= 1
        return out

    def _packed(self, chunk: str) -> bytes:
        """Ids of a chunk, cut by the pattern, as little-endian unsigned 32-bit integers."""
        get, out = self.pieces.get, []
        for piece in (chunk,) if chunk[1:].isalpha() and chunk[0] == " " else self.pattern.findall(chunk):
            if (ids := get(piece)) is None:
                ids = array("I", self.encode_piece(piece.encode())).tobytes()
                _keep(self.pieces, piece, ids)
            out.append(ids)
        return out[0] if len(out) == 1 else b"".join(out)

    def encode(self, text: str) -> bytes:
        """With the dealt pattern, cut before each blank that a non-blank follows: no match goes over such a place. Others run over the whole text."""
        if not self.quick:
            return array("I", [i for piece in self.pattern.findall(text) for i in self.encode_piece(piece.encode())]).tobytes()
        first, *rest = _BEFORE_WORD.split(text)
        get, out = self.chunks.get, [self._packed(first)]
        for chunk in rest:
            if (ids := get(chunk)) is None:
                ids = self._packed(" " + chunk)
                _keep(self.chunks, chunk, ids)
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


assert sys.byteorder == "little" and array("I").itemsize == 4


def _keep(memo: dict[str, bytes], key: str, ids: bytes) -> None:
    if len(key) <= 64:
        if len(memo) >= MEMO:
            memo.clear()
        memo[key] = ids


@lru_cache(2)
def _encoder(rank_file: bytes, pattern: str) -> Encoder:
    return Encoder(rank_file, pattern)


@lru_cache(2)
def _from_path(path: str, pattern: str) -> Encoder:
    with open(SparkFiles.get(path[12:]) if path.startswith("spark-files:") else path, "rb") as f:
        return _encoder(f.read(), pattern)


def _forget() -> None:
    _encoder.cache_clear()
    _from_path.cache_clear()


def encode_documents(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ship: bool = True) -> DataFrame:
    """``id, ids binary (little-endian u32), decoded binary`` for each row; null and empty texts give no ids.

    ``rank_path`` lies on the driver; with ``ship`` Spark sends that one file, whose size does not grow with the
    data, to each executor once. Rows are independent: repeated rows give repeated results, other columns don't matter, an empty table gives no rows.
    """
    where = rank_path
    if ship:
        docs.sparkSession.sparkContext.addFile(rank_path)
        where = "spark-files:" + rank_path.rsplit("/", 1)[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.enter("bpe", _forget)
        enc = _from_path(where, pattern)
        for b in batches:
            for start in range(0, b.num_rows, 64):
                part = b.slice(start, 64)
                ids = [enc.encode(x or "") for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.large_binary()).cast(pa.binary()), pa.array([enc.decode(x) for x in ids], pa.binary())], names=[id_col, "ids", "decoded"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids binary, decoded binary")


def digests(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` from the ids and bytes of ``encode_documents``."""
    from pyspark.sql import functions as F

    out = encode_documents(docs, rank_path, pattern)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
