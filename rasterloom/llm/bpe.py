"""Byte-level BPE encoding and decoding by dynamic programming over prefixes.

Of the tokenizations of a byte string by the ranks, exactly one is what merging would give, and it has a property
that can be tested pair by pair: two neighbouring tokens may stand side by side only if merging their joined bytes
gives those two tokens back. Hence each prefix of a string has one valid last token: the only token that ends there and
may follow the last token of the prefix before it. Storing that token for every prefix makes appending exact (older
entries never change) and lets an edit be re-encoded from the place where it begins to where the old tokens return.

Texts are first split by the pattern; each piece is encoded on its own. Cases: a null text counts as empty and has no
tokens; bytes that no merge covers are single-byte tokens; strings that look like special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm import common

#: Encoded pieces that a Python worker remembers, in each of two generations.
PIECES = 250_000
_NO_TOKEN = -1


def load_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class PrefixEncoder:
    """A byte string under encoding: last[i] is the valid last token of its first i bytes; computed counts the prefixes
    that were worked out so far."""

    def __init__(self, bpe: Bpe, data: bytes = b""):
        self.bpe, self.data, self.last, self.computed = bpe, b"", [_NO_TOKEN], 0
        self.append(data)

    def append(self, more: bytes) -> None:
        """Add bytes at the end; only their own prefixes are computed."""
        self.data += more
        for end in range(len(self.last), len(self.data) + 1):
            self.last.append(self._last_of(end))

    def _last_of(self, end: int) -> int:
        data, last, ranks, fits = self.data, self.last, self.bpe.ranks, self.bpe.fits
        self.computed += 1
        for start in range(max(0, end - self.bpe.reach.get(data[max(0, end - 2) : end], 1)), end):
            token = ranks.get(data[start:end])
            if token is not None and (start == 0 or fits(last[start], token)):
                return token
        raise ValueError("the ranks lack a single byte")

    def replace(self, start: int, stop: int, with_bytes: bytes) -> None:
        """Replace data[start:stop]; prefixes up to start keep their tokens.

        A prefix's token depends on the bytes that a token can span and on the tokens of the prefixes that end among them.
        So once as many prefixes in a row as the longest token has bytes, all of them past the edit, have the tokens that
        they had before, all later ones keep theirs and are not computed.
        """
        before, shift = self.last, len(with_bytes) - (stop - start)
        edited, same = start + len(with_bytes), 0
        self.data = self.data[:start] + with_bytes + self.data[stop:]
        self.last = before[: start + 1]
        for end in range(start + 1, len(self.data) + 1):
            self.last.append(self._last_of(end))
            same = same + 1 if end >= edited and self.last[end] == before[end - shift] else 0
            if same >= self.bpe.longest:
                self.last += before[end - shift + 1 :]
                break

    def tokens(self) -> list[int]:
        found, end = [], len(self.data)
        while end:
            found.append(self.last[end])
            end -= len(self.bpe.bytes_of[self.last[end]])
        return found[::-1]


class TextEncoder:
    """A text under encoding: its pieces by the pattern, the ids of each, and how many pieces were encoded so far.

    Where a piece ends depends on at most look_ahead characters after it (two, for a pattern that takes `'ll` as one piece
    and `'` as another). So an edit leaves alone the pieces that end that far before it. From there on pieces are found
    again, until one begins where an old one began past the edit; from that place on, the old pieces stay.
    """

    def __init__(self, bpe: Bpe, text: str = "", look_ahead: int = 2):
        self.bpe, self.text, self.look_ahead, self.encoded = bpe, "", look_ahead, 0
        self.starts: list[int] = []
        self.ends: list[int] = []
        self.ids: list[list[int]] = []
        self.append(text)

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, stop: int, with_text: str) -> None:
        """Replace text[start:stop]."""
        first = bisect.bisect_right(self.ends, start - self.look_ahead)
        at, shift, rest = self.ends[first - 1] if first else 0, len(with_text) - (stop - start), len(self.starts)
        self.text = self.text[:start] + with_text + self.text[stop:]
        found: list[tuple[int, int, list[int]]] = []
        for match in self.bpe.pattern.finditer(self.text, at):
            was = match.start() - shift
            old = bisect.bisect_left(self.starts, was, first)
            if was >= stop and old < len(self.starts) and self.starts[old] == was:
                rest = old
                break
            found.append((match.start(), match.end(), self.bpe.encode_bytes(match.group().encode())))
            self.encoded += 1
        self.starts[first:] = [x for x, _, _ in found] + [x + shift for x in self.starts[rest:]]
        self.ends[first:] = [x for _, x, _ in found] + [x + shift for x in self.ends[rest:]]
        self.ids[first:] = [x for _, _, x in found] + self.ids[rest:]

    def tokens(self) -> list[int]:
        return [t for piece in self.ids for t in piece]


class Bpe:
    def __init__(self, rank_file: bytes, pattern: str):
        lines = (line.split() for line in rank_file.splitlines() if line)
        self.ranks = {base64.b64decode(a): int(b) for a, b in lines}
        self.bytes_of = {b: a for a, b in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self._fits: dict[int, bool] = {}
        self._young: dict[str, str] = {}
        self._old: dict[str, str] = {}
        # A token is of use only if merging its own bytes gives it back.
        self.halves: dict[int, tuple[int, int]] = {}
        for data, token in self.ranks.items():
            parts = self._merged(data, below=token) if len(data) > 1 else [token]
            if len(parts) == 2:
                self.halves[token] = parts[0], parts[1]
        self.ranks = {d: t for d, t in self.ranks.items() if len(d) == 1 or t in self.halves}
        # The longest token that ends in the same two bytes.
        self.reach: dict[bytes, int] = {}
        for data in self.ranks:
            self.reach[data[-2:]] = max(len(data), self.reach.get(data[-2:], 1))
        self.longest = max(self.reach.values(), default=1)

    def _merged(self, data: bytes, below: int) -> list[int]:
        """Merge bytes, lowest rank first and leftmost on ties, with ranks under `below` only."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
            if rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def fits(self, left: int, right: int) -> bool:
        """May right follow left: no merge crosses their border before both are complete."""
        key = left << 32 | right
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) > 500_000:
                self._fits.clear()
            known = self._fits[key] = self._crosses_not(left, right)
        return known

    def _crosses_not(self, left: int, right: int) -> bool:
        # Undo the later of the two tokens' last merges, step by step. A token across the border with a rank below
        # that of both would have been merged before they were made.
        limit = 1 << 60
        while True:
            across = self.ranks.get(self.bytes_of[left] + self.bytes_of[right])
            if across is not None and across < limit:
                return False
            can_left, can_right = left in self.halves, right in self.halves
            if can_left and (left > right or not can_right):
                limit, left = left, self.halves[left][1]
            elif can_right:
                limit, right = right + 1, self.halves[right][0]
            else:
                return True

    def encode_bytes(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        return [whole] if whole is not None else PrefixEncoder(self, data).tokens()

    def encode(self, text: str) -> list[int]:
        return [t for piece in self.pattern.findall(text) for t in self.encode_bytes(piece.encode())]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def _remembered(self, piece: str) -> str:
        """The ids of a piece in decimal; pieces in use pass from the old generation to the young one."""
        found = self._old.get(piece)
        if found is None:
            found = " ".join(map(str, self.encode_bytes(piece.encode())))
        if len(self._young) >= PIECES:
            self._old, self._young = self._young, {}
        self._young[piece] = found
        return found

    def encode_to_text(self, text: str) -> str:
        """The ids of a text in decimal, joined by one space; pieces seen before are taken from memory."""
        pieces = self.pattern.findall(text)
        found = list(map(self._young.get, pieces))
        at = -1
        try:
            while True:
                at = found.index(None, at + 1)
                found[at] = self._remembered(pieces[at])
        except ValueError:  # none is missing any more
            return " ".join(found)


_models: dict[str, Bpe] = {}


def shared_model(rank_file: bytes, pattern: str) -> Bpe:
    """One model per Python worker, kept between tasks."""
    key = hashlib.sha256(rank_file + pattern.encode()).hexdigest()
    if key not in _models:
        _models[key] = Bpe(rank_file, pattern)
    return _models[key]


def encode_table(docs: DataFrame, rank_file: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]) of each row; ids are the tokens themselves."""
    ranks = docs.sparkSession.sparkContext.broadcast(rank_file)  # a vocabulary file: its size does not depend on the data
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shared_model(ranks.value, pattern)
        token_bytes = {str(t).encode(): d for t, d in bpe.bytes_of.items()}.__getitem__
        for whole in batches:
            for at in range(0, len(whole), 256):  # lists of ids are large
                batch = whole.slice(at, 256)
                n, encoded, decoded, ids = [], [], [], []
                for text in batch.column(1).to_pylist():
                    line = bpe.encode_to_text(text or "").encode()
                    parts = line.split()
                    n.append(len(parts))
                    encoded.append(hashlib.sha256(line).hexdigest())
                    decoded.append(hashlib.sha256(b"".join(map(token_bytes, parts))).hexdigest())
                    if with_ids:
                        ids.append(np.fromstring(line, np.int32, sep=" "))
                columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.list_(pa.int32()))] * with_ids, names)

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return common.stage(common.in_arrow(chosen, run, schema), "encoded")
