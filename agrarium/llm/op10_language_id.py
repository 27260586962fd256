"""Language identification by cross-parsing entropy.

For each language a suffix automaton of running labelled text gives the longest
match at any place. A text is parsed, across its words, into longest matches,
phrase after phrase; a phrase costs the bits that name a place in the labelled
text, and the language with the least bits per byte wins.

Texts are parsed as UTF-8 bytes of lower-cased letters, one space where there
are other characters. Many stretches of texts advance byte by byte together,
in all automata at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from agrarium.llm.rows import arrays_of, held

UNKNOWN = "und"
SCHEMA = "doc_id long, lang_pred string, score double"
STRETCH = 512  # bytes after which a text is parsed anew from the next word on
AT_ONCE = 1 << 21  # bytes of text that are parsed together
SPACE = 32


class SuffixAutomaton:
    """All substrings of a sequence; ``phrases`` counts the longest matches that another takes."""

    def __init__(self, text: Sequence) -> None:
        moves: list[dict] = [{}]
        link, length, last = [-1], [0], 0
        for c in text:
            new = len(moves)
            moves.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in moves[p]:
                moves[p][c] = new
                p = link[p]
            if p >= 0:
                q = moves[p][c]
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    copy = len(moves)
                    moves.append(dict(moves[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and moves[p].get(c) == q:
                        moves[p][c] = copy
                        p = link[p]
                    link[q] = link[new] = copy
            last = new
        self.moves = moves

    def phrases(self, text: Sequence) -> int:
        """A symbol never seen is a phrase of its own."""
        moves = self.moves
        n = state = 0
        for c in text:
            after = moves[state].get(c) if state else None
            if after is None:
                n += 1
                after = moves[0].get(c, 0)
            state = after
        return n


def letters(text: str | None) -> bytes:
    """The text as it is parsed: a space, then words of lower-cased letters, each with a space after it; empty if there is no letter."""
    words = _not_letters().sub(" ", (text or "").lower()).strip(" ")
    return f" {words} ".encode() if words else b""


@lru_cache
def _not_letters():  # noqa: ANN202
    import regex

    return regex.compile(r"\P{L}+")


def stretches(data: bytes) -> list[bytes]:
    """``data`` cut at spaces into stretches of up to STRETCH bytes; a longer word is cut where it is."""
    out, lo = [], 0
    while len(data) - lo > STRETCH:
        hi = data.rfind(b" ", lo + 1, lo + STRETCH)
        hi = lo + STRETCH if hi < 0 else hi
        out.append(data[lo:hi])
        lo = hi
    out.append(data[lo:])
    return out


class Parser:
    """The automata of all languages as tables over the bytes they use."""

    def __init__(self, texts: tuple[tuple[str, bytes], ...]) -> None:
        self.names = [name for name, _ in texts]
        used = sorted(set().union(*(data for _, data in texts)))
        width = len(used) + 1
        # Bytes that no language uses share the last column.
        classes = np.full(256, width - 1, np.uint8)
        classes[used] = np.arange(len(used))
        self.classes = classes.tobytes()
        kind = np.int32 if 2 * width * max((len(data) + 1 for _, data in texts), default=0) < 1 << 31 else np.int64
        #: For each language a table, state by state, of where a byte leads.
        self.tables = [self._table(data.translate(self.classes), width, kind) for _, data in texts]
        #: Bits of a phrase: those that name a place in the labelled text.
        self.bits = np.log2([len(data) for _, data in texts])

    @staticmethod
    def _table(text: bytes, width: int, kind: type) -> np.ndarray:
        moves = SuffixAutomaton(text).moves
        # Where no move is, and at the root, a phrase begins: the root's move, or the root, marked by its complement.
        begin = np.full(width, ~0, kind)
        for c, x in moves[0].items():
            begin[c] = ~(x * width)
        table = np.empty((len(moves), width), kind)
        table[:] = begin
        for state, after in enumerate(moves):
            if state:
                for c, x in after.items():
                    table[state, c] = x * width
        return table.ravel()

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """Phrases of each text (results of ``letters``) in each language."""
        owners, lanes = [], []
        for i, data in enumerate(texts):
            if data:
                found = stretches(data)
                lanes += found
                owners += [i] * len(found)
        total = np.zeros((len(texts), len(self.names)), np.int64)
        if not lanes:
            return total
        sizes = np.fromiter(map(len, lanes), np.int64, len(lanes))
        order = np.argsort(-sizes, kind="stable")
        most = int(sizes[order[0]])
        columns = np.frombuffer(b"".join(lanes[i].ljust(most) for i in order.tolist()).translate(self.classes), np.uint8).reshape(len(lanes), most).T.copy()
        live = np.searchsorted(-sizes[order], -np.arange(most), "left")
        count = np.zeros((len(lanes), len(self.names)), np.int32)
        for k, table in enumerate(self.tables):
            state, begun = np.zeros(len(lanes), table.dtype), np.zeros(len(lanes), np.int32)
            shift = table.dtype.itemsize * 8 - 1
            for column, n in zip(columns, live.tolist(), strict=True):
                now = table[state[:n] + column[:n]]
                fresh = now >> shift
                begun[:n] -= fresh.astype(np.int32, copy=False)
                state[:n] = now ^ fresh
            count[:, k] = begun
        np.add.at(total, np.array(owners)[order], count)
        return total

    def languages(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score of each text."""
        data = [letters(t) for t in texts]
        if not self.names:
            return [(UNKNOWN, 0.0)] * len(texts)
        cost = np.zeros((0, len(self.names)))
        lo = size = 0
        for i, x in enumerate(data):
            size += len(x)
            if size >= AT_ONCE or i == len(data) - 1:
                cost = np.concatenate((cost, self.phrases(data[lo : i + 1]) * self.bits))
                lo, size = i + 1, 0
        best = cost.argmin(axis=1)
        if len(self.names) > 1:
            two = np.partition(cost, 1, axis=1)[:, :2]
            score = 1 - two[:, 0] / np.maximum(two[:, 1], 1e-300)
        else:
            score = np.ones(len(texts))
        return [(self.names[b], float(s)) if x else (UNKNOWN, 0.0) for x, b, s in zip(data, best.tolist(), score.tolist(), strict=True)]


def parser(texts: tuple[tuple[str, bytes], ...]) -> Parser:
    """One parser for each Python worker."""
    return held(("parser", texts), lambda: Parser(texts))


def samples(docs: DataFrame, most_docs: int, most_chars: int) -> tuple[tuple[str, bytes], ...]:
    """Labelled text by language, as it is parsed: whole texts in the order of their hashes.

    Taken are at most ``most_docs`` different texts a language, and none after
    those that fill ``most_chars`` characters; the first is always taken. Ids
    play no part but to hold rows out, and copies of a text count once.
    """
    mark = F.xxhash64(F.lit(7), "text")
    labelled = docs.where(learned_from() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.approx_count_distinct(mark).alias("n")).collect()}
    if not counts:
        return ()
    # A hash thins each language to about twice the bound, so that the ranking below is small.
    thin = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, max(1, n // (2 * most_docs)))))
    few = labelled.where(F.pmod(mark, thin[F.col("lang")]) == 0).groupBy("lang", mark.alias("mark")).agg(F.min("text").alias("text"))
    order = Window.partitionBy("lang").orderBy("mark")
    before = F.coalesce(F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = few.withColumns({"at": F.row_number().over(order), "before": before}).where((F.col("at") <= most_docs) & (F.col("before") < most_chars))
    texts: dict[str, list[bytes]] = {}
    for r in taken.select("lang", "at", "text").orderBy("lang", "at").collect():
        texts.setdefault(r["lang"], []).append(letters(r["text"]))
    return tuple((lang, data) for lang in sorted(texts) if (data := b"".join(texts[lang]).replace(b"  ", b" ")))


def learned_from() -> F.Column:
    """Rows that may teach: crc32 of the id, modulo 3, isn't 1."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 != 1, F.lit(True))


def predict(docs: DataFrame, texts: tuple[tuple[str, bytes], ...]) -> DataFrame:
    """(doc_id, lang_pred, score) for each row of ``docs`` (doc_id, text), by labelled texts of ``samples``.

    ``und`` with score 0 where text is null or has no letter, or nothing was
    learned. The score is by how much the winner's bits fall short of the next
    language's, as a share of the latter (1 for a single language). Ties go to
    the smaller name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(texts)
    arrow = to_arrow_schema(T._parse_datatype_string(SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = parser(shared.value)
        for b in batches:
            found = own.languages(b.column(1).to_pylist())
            yield arrays_of([b.column(0).to_pylist(), [x for x, _ in found], [s for _, s in found]], arrow)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def accepted(docs: DataFrame, most_docs: int = 40, most_chars: int = 120_000) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, lang) that are in a language, with all their columns and ``lang`` as predicted.

    Texts that are null or have no letter go, and no others; where nothing was
    learned, ``lang`` stays as it is.
    """
    texts = samples(docs.select("doc_id", "text", "lang"), most_docs, most_chars)
    has_letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    kept = docs.where(has_letter)
    if not texts:
        return kept
    shared = docs.sparkSession.sparkContext.broadcast(texts)
    text, lang = (next(i for i, c in enumerate(docs.columns) if c.lower() == name) for name in ("text", "lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = parser(shared.value)
        for b in batches:
            found = own.languages(b.column(text).to_pylist())
            named = [None if x == UNKNOWN else x for x, _ in found]
            yield b.set_column(lang, b.schema.field(lang), pa.array(named, b.schema.field(lang).type))

    return kept.mapInArrow(run, docs.schema)


def languages(docs: DataFrame, most_docs: int = 40, most_chars: int = 120_000) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang): held_out, lang_pred and score.

    Learns from a bounded sample of labelled rows outside the held-out third
    and reads nothing but text to predict. Null ids aren't held out; repeated
    rows are kept; other columns are ignored; an empty table gives no rows.
    Very long texts are parsed whole, in stretches of STRETCH bytes.
    """
    found = predict(docs, samples(docs.select("doc_id", "text", "lang"), most_docs, most_chars))
    return found.select("doc_id", (~learned_from()).alias("held_out"), "lang_pred", "score")
