"""Token counts of whole texts.

A text is split at the safest of boundaries, ASCII white space, which the
tokenizer drops before its merges; no token crosses it. Words not met before
are encoded in batches balanced by bytes, Arrow batch after Arrow batch, and
only their lengths are remembered; a text's count is the sum over its words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql import types as T

from agrarium.llm.rows import Memo, arrays_of, held

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


class Lengths:
    """Token counts of words, encoded in batches."""

    def __init__(self, count: Callable[[list[str]], list[int]], batch_bytes: int, piece_chars: int, memo: int) -> None:
        self.count, self.batch_bytes, self.longest = count, batch_bytes, piece_chars
        self.known = Memo(lambda word: count([word.decode()])[0], memo, piece_chars)

    def encode(self, words: set[bytes]) -> dict[bytes, int]:
        """Counts of words, in batches of about ``batch_bytes``; a word longer than that is a batch of its own."""
        found: dict[bytes, int] = {}
        batch, size = [], 0
        for word in sorted(words, key=len, reverse=True):
            batch.append(word)
            size += len(word)
            if size >= self.batch_bytes:
                found.update(zip(batch, self.count([w.decode() for w in batch]), strict=True))
                batch, size = [], 0
        if batch:
            found.update(zip(batch, self.count([w.decode() for w in batch]), strict=True))
        return found

    def of(self, texts: list[list[bytes]]) -> list[int]:
        """Token counts of texts given as words."""
        new = set().union(*texts).difference(self.known)
        found = self.encode(new)
        get, known = found.get, self.known
        totals = [sum(known[w] if (n := get(w)) is None else n for w in words) if new else sum(map(known.__getitem__, words)) for words in texts]
        for word, n in found.items():
            if len(word) <= self.longest:
                known.trim()
                known[word] = n
        return totals


def token_counts(docs: DataFrame, tokenizer: Callable[[], Callable[[list[str]], list[int]]], limit: int = 2048, batch_bytes: int = 1 << 18, piece_chars: int = 64, held_bytes: int = 1 << 22, memo: int = 400_000) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): bytes, tokens, and whether they exceed ``limit``.

    ``tokenizer()`` runs once per Python worker and returns a function from texts to
    token counts. Texts wait until ``held_bytes`` of them are there, across
    Arrow batches; words of up to ``piece_chars`` bytes are remembered. Null text counts as empty (0 bytes, 0 tokens); null ids and
    repeated rows are kept as they are; other columns are ignored; an empty
    table gives no rows. A very long text is counted whole, word by word; a
    stretch without white space is one word, however long.
    """
    arrow = to_arrow_schema(T._parse_datatype_string(SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = Lengths(tokenizer(), batch_bytes, piece_chars, memo)
        ids: list[int | None] = []
        sizes: list[int] = []
        texts: list[list[bytes]] = []
        size = 0

        def settled() -> pa.RecordBatch:
            totals = lengths.of(texts)
            return arrays_of([ids, sizes, totals, [n > limit for n in totals]], arrow)

        for b in batches:
            for doc_id, data in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                data = data or b""
                ids.append(doc_id)
                sizes.append(len(data))
                texts.append(data.split())
                size += len(data) + 1_000
                if size >= held_bytes:
                    yield settled()
                    ids, sizes, texts, size = [], [], [], 0
        if ids:
            yield settled()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def json_tokenizer(path: str) -> Callable[[], Callable[[list[str]], list[int]]]:
    """Counter for a ``tokenizers`` file, without special tokens, truncation or padding."""

    return lambda: held(("json", path), lambda: _json_counter(path))


def _json_counter(path: str) -> Callable[[list[str]], list[int]]:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.no_truncation()
    own.no_padding()
    return lambda texts: [len(e) for e in own.encode_batch_fast(texts, add_special_tokens=False)]
