"""Byte-level BPE encoding and decoding.

Each piece of the splitting pattern is merged with a segment tree over its byte
positions. A leaf holds the rank of the pair that starts there; a node holds
the leftmost minimum of its FAN children. A merge takes the root's minimum and
does three point updates on live neighbours, so a piece of n bytes costs
O(n log n), however repetitive it is. A piece of FAN bytes or fewer is a tree of
one node. Pieces met before come from a bounded memo, which holds what the
digests need of them; texts are decoded from the ids, piece by piece.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterable
from itertools import chain, pairwise

from pyspark.sql import DataFrame

from agrarium.llm.rows import Memo, flat_map, held

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
NO_PAIR = 1 << 60
FAN = 32


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of ``piece``: the leftmost pair of least rank merges first, until none is left."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    return _merge_node(piece, ranks) if len(piece) <= FAN else _merge_tree(piece, ranks)


def _merge_node(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """A tree of one node: live leaves stand side by side, so that the node's minimum is that of a short list."""
    rank_of = ranks.get
    starts = list(range(len(piece) + 1))
    leaves = [rank_of(piece[i : i + 2], NO_PAIR) for i in range(len(piece) - 1)]
    leaves.append(NO_PAIR)
    while (least := min(leaves)) < NO_PAIR:
        i = leaves.index(least)
        del starts[i + 1], leaves[i + 1]
        if i + 2 < len(starts):
            leaves[i] = rank_of(piece[starts[i] : starts[i + 2]], NO_PAIR)
        else:
            leaves[i] = NO_PAIR
        if i:
            leaves[i - 1] = rank_of(piece[starts[i - 1] : starts[i + 1]], NO_PAIR)
    return [ranks[piece[a:b]] for a, b in pairwise(starts)]


def _merge_tree(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    n = len(piece)
    rank_of = ranks.get
    parts: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    # A leaf is rank * n + position, so that the least leaf is the leftmost of least rank.
    none = NO_PAIR * n
    leaves = [none if (rank := rank_of(piece[i : i + 2])) is None else rank * n + i for i in range(n - 1)]
    levels = [leaves]
    while len(levels[-1]) > FAN:
        below = levels[-1]
        levels.append([min(below[i : i + FAN]) for i in range(0, len(below), FAN)])
    top = levels[-1]

    def update(i: int, value: int) -> None:
        leaves[i] = value
        for below, level in zip(levels, levels[1:], strict=False):
            start = i - i % FAN
            i //= FAN
            least = min(below[start : start + FAN])
            if level[i] == least:
                return
            level[i] = least

    while (least := min(top)) < none:
        i = least % n
        j = after[i]
        merged = parts[i] = parts[i] + parts[j]
        parts[j] = None
        k = after[i] = after[j]
        if j < n - 1:
            update(j, none)
        if k < n:
            before[k] = i
            rank = rank_of(merged + parts[k])
            update(i, none if rank is None else rank * n + i)
        else:
            update(i, none)
        h = before[i]
        if h >= 0:
            rank = rank_of(parts[h] + merged)
            update(h, none if rank is None else rank * n + h)
    return [ranks[p] for p in parts if p is not None]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Codec:
    """Encodes and decodes with a rank file and a splitting pattern, without special tokens."""

    def __init__(self, path: str, pattern: str, memo: int = 400_000, longest: int = 64) -> None:
        import regex

        ranks = load_ranks(path)
        self.tokens: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.find = regex.compile(pattern).findall
        self.merged = lambda piece: merge(piece.encode(), ranks)
        #: Of pieces the ids, and the ids as decimals joined by commas; of the latter the bytes they decode to.
        self.ids = Memo(self.merged, memo, longest)
        self.decimals = Memo(lambda piece: ",".join(map(str, self.merged(piece))), memo, longest)
        self.bytes = Memo(lambda joined: self.decode(map(int, joined.split(","))), memo, 6 * longest)

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.ids.__getitem__, self.find(text))))

    def encode_pieces(self, text: str) -> list[str]:
        """The ids of each piece, as decimals joined by commas."""
        return list(map(self.decimals.__getitem__, self.find(text)))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def decode_pieces(self, pieces: list[str]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, pieces))


def codec(path: str, pattern: str) -> Codec:
    """One codec for each Python worker, whose memo outlives a task."""
    return held(("codec", path, pattern), lambda: Codec(path, pattern))


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>) of whole texts; null text gives an empty array."""

    def make() -> Callable:
        own = codec(path, pattern)
        return lambda doc_id, text: [(doc_id, own.encode(text or ""))]

    return flat_map(docs.select("doc_id", "text"), make, "doc_id long, ids array<int>", batch=500)


def decoded(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); bytes that aren't UTF-8 become U+FFFD, null ids an empty text."""

    def make() -> Callable:
        own = codec(path, pattern)
        return lambda doc_id, ids: [(doc_id, own.decode(ids or []).decode("utf-8", "replace"))]

    return flat_map(tokens.select("doc_id", "ids"), make, "doc_id long, text string", batch=500)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encodes whole texts, decodes the ids again, and gives digests of both.

    Null text counts as empty; ids and repeated rows are kept; other columns
    are ignored. An empty table gives no rows. A long text costs as many steps
    as it has pieces, a piece of n bytes O(n log n); nothing is cut.
    """

    def make() -> Callable:
        own = codec(path, pattern)
        sha = hashlib.sha256

        def each(doc_id: int | None, text: str | None) -> list[tuple]:
            pieces = own.encode_pieces(text or "")
            ids = ",".join(pieces)
            n = ids.count(",") + 1 if ids else 0
            return [(doc_id, n, sha(ids.encode()).hexdigest(), sha(own.decode_pieces(pieces)).hexdigest())]

        return each

    return flat_map(docs.select("doc_id", "text"), make, SCHEMA, batch=5_000)
