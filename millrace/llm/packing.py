"""Best-fit packing of tokenised documents into sequences, in bulk-synchronous rounds.

Documents are cut into pieces no longer than a sequence. Pieces of the same length are interchangeable, and so are
sequences with the same gap, and there are at most ``capacity`` of either kind; a round therefore works on runs of
equal pieces and equal gaps, whose number does not grow with the data. Rounds go through the lengths, longest first:

* all pieces of the length are matched at once to their successor, the nearest gaps that hold them;
* where more pieces than gaps meet, rank decides: the first take these gaps, the others go on to the next nearest, and
  to new sequences when there is none;
* the gaps are updated before the next round, and so the sequences are no more than best fit decreasing needs.

The rows themselves stay distributed: they are ranked within their length from counts by partition, and each piece looks
up the match that covers its length and rank. Counting, ranking and placing are jobs over all pieces; what a round looks
at are at most ``capacity`` counts.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.bpe import _byte_characters, slices
from millrace.llm.common import checkpointed, remembered

if TYPE_CHECKING:
    from tokenizers import Tokenizer

CAPACITY = 2048
#: Characters of texts that are handled at once, and rows at most; words of a generation that a worker remembers; unseen words that are encoded at once.
SLICE, ROWS, REMEMBERED, JOINED = 1 << 19, 512, 350_000, 4000
# What the public word vocabulary's file says of its normalizer, its pattern and the end of a word (fixed values).
NORMALIZERS, PATTERN, END = ["NFC", "Replace", "Lowercase"], r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+", "</w>"
# The same pattern for lower-case words of characters that this normalizer leaves as they are: printable ones up to U+024F.
_LETTERS, _NUMBERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe"
_PLAIN = re.compile("[!-~\xa1-\xac\xae-\u024f]+")
_TOKEN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_LETTERS}{_NUMBERS}]+")
#: The printable stand-ins of bytes in the vocabulary.
_STAND_INS = {b: ord(c) for c, b in _byte_characters().items()}


class _Words:
    """The ids of words (little-endian unsigned 32-bit), encoded by the tokenizer library many at a time. Plain words are cut into pre-tokens
    here, so that the library has to merge them only; its normalizer and pattern take longer than that.

    Two generations are remembered: when ``newer`` is full it becomes ``older``, out of which words come back as they are met, so that frequent
    ones stay and no more than two generations are held.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.newer: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        # an added token parts texts: what stands between two of them is encoded by itself, and no word without "<|" has its id
        added = self.tokenizer.get_added_tokens_decoder().items()
        self.mark, self.token = next(((i, t.content.encode()) for i, t in added if "<|" in t.content and not (t.normalized or t.single_word)), (None, b""))
        with open(path, encoding="utf-8") as f:
            self.merges = self._merges(json.load(f))

    def _merges(self, spec: dict) -> Tokenizer | None:
        """The model alone on pre-tokens between spaces, if the file is of the kind whose words can be cut here."""
        from tokenizers import Tokenizer, pre_tokenizers

        normalizers, steps = ((spec[k] or {}).get(v, []) for k, v in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers")))
        kinds, pattern = [x["type"] for x in normalizers], [x["pattern"].get("Regex") for x in steps if x["type"] == "Split"]
        if (kinds, pattern, spec["model"].get("end_of_word_suffix")) != (NORMALIZERS, [PATTERN], END) or any("<|" not in t["content"] for t in spec["added_tokens"]):
            return None
        vocab = spec["model"]["vocab"]
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(END)]] = True  # each pre-token has one, its last
        merges = Tokenizer(self.tokenizer.model)
        merges.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        return merges

    def _merged(self, tokens: list[str]) -> Iterator[bytes]:
        """The ids of each pre-token."""
        for at in range(0, len(tokens), JOINED):
            part = [t if t.isascii() else t.encode().decode("latin-1").translate(_STAND_INS) for t in tokens[at : at + JOINED]]
            ids = np.array(self.merges.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            code, ends = ids.tobytes(), (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
            for start, end, _ in zip([0, *ends[:-1]], ends, part, strict=True):
                yield code[start:end]

    def learn(self, words: set[bytes]) -> None:
        """Afterwards ``newer`` has all of ``words``."""
        missing = [word for word in words if word not in self.newer]
        if len(self.newer) + len(missing) > REMEMBERED:
            self.older, self.newer = self.newer, {}
            missing = list(words)
        together, alone, plain = [], [], {}
        for word in missing:
            known = self.older.get(word)
            if known is not None:
                self.newer[word] = known
            elif self.merges and b"<|" not in word and _PLAIN.fullmatch(text := word.decode().lower()):
                plain[word] = _TOKEN.findall(text)
            else:
                (alone if self.mark is None or b"<|" in word else together).append(word)
        tokens = list(set().union(*plain.values()))
        of = dict(zip(tokens, self._merged(tokens), strict=True)).__getitem__
        self.newer.update((word, b"".join(map(of, cut))) for word, cut in plain.items())
        for at in range(0, len(together), JOINED):
            part = together[at : at + JOINED]
            ids = np.array(self._encoded([(b" %b " % self.token).join(part)])[0], "<u4")
            ends = [*np.flatnonzero(ids == self.mark).tolist(), len(ids)]
            code, starts = ids.tobytes(), [0, *(end + 1 for end in ends[:-1])]
            self.newer.update((word, code[4 * start : 4 * end]) for word, start, end in zip(part, starts, ends, strict=True))
        for at in range(0, len(alone), JOINED):
            part = alone[at : at + JOINED]
            self.newer.update((word, np.array(ids, "<u4").tobytes()) for word, ids in zip(part, self._encoded(part), strict=True))

    def _encoded(self, texts: list[bytes]) -> list[list[int]]:
        return [code.ids for code in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]


@remembered
def _words(path: str) -> _Words:
    return _Words(path)


def encode_by_words(texts: list[str], path: str) -> Iterator[bytes]:
    """The ids of each text. The tokenizer's normalizer and pattern drop white space and join nothing across it, so each
    word (by ASCII white space) is encoded once. It lower-cases texts, too; A-Z are lower-cased before, but for texts in
    which that could make an added token."""
    table = _words(path)
    for start, end in slices(texts, SLICE):
        parts = [(t.encode() if "<|" in t else t.encode().lower()).split() for t in texts[start:end]]
        table.learn(set().union(*parts))
        of = table.newer.__getitem__
        for words in parts:
            yield b"".join(map(of, words))


def tokenised_pieces(df: DataFrame, tokenizer_path: str, id_col: str, text_col: str, end_id: int, capacity: int) -> DataFrame:
    """Pieces of all documents with their partition and their rank among the partition's pieces of the same length."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):  # texts of a batch are not all held a second time
                some, out = batch.slice(at, ROWS), []
                texts = [t or "" for t in some["text"].to_pylist()]
                for doc, code in zip(some["id"].to_pylist(), encode_by_words(texts, tokenizer_path), strict=True):
                    code += end
                    n = len(code) // 4
                    for piece, start in enumerate(range(0, n, capacity)):
                        length = min(capacity, n - start)
                        out.append((doc, piece, start, length, zlib.crc32(code[4 * start : 4 * (start + length)]), part, seen[length]))
                        seen[length] += 1
                kinds = [batch.schema.field("id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                names = ["id", "piece", "start", "length", "crc", "part", "nth"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return rows.mapInArrow(cut, f"id {kind.simpleString()}, piece int, start long, length long, crc long, part int, nth long")


def match_rounds(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Matches (length, first rank, pieces in a sequence, first sequence, first offset) that place all pieces, and the number
    of sequences. A match holds from its first rank to that of the next match of the length.

    ``counts``: pieces by length. All state is runs of equal pieces and of equal gaps; the sequences are as many as those of
    best fit decreasing, piece by piece: of equal pieces, each fills the sequence that the one before it was put into as far as it goes,
    as no other gap can be nearer.
    """
    matches: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs (first sequence, count)
    held = np.zeros(capacity + 1, np.int8)  # gaps that some sequence has
    opened = 0

    def leave(gap: int, sequence: int, count: int) -> None:
        if gap and count:
            gaps.setdefault(gap, []).append((sequence, count))
            held[gap] = 1

    for n in sorted(counts, reverse=True):
        rank, left = 0, counts[n]
        while left:
            found = int(held[n:].argmax()) + n
            if held[found]:  # the successor: the nearest gap that holds the length
                gap, (sequence, count) = found, gaps[found].pop()
                if not gaps[found]:
                    held[found] = 0
            else:
                each = capacity // n
                gap, sequence, count = capacity, opened, -(-left // each)
                opened += count
            each = gap // n
            matches.append((n, rank, each, sequence, capacity - gap))
            full = min(count, left // each)
            rest = min(left - full * each, each - 1) if full < count else 0  # pieces of the last sequence, not filled
            leave(gap - each * n, sequence, full)
            if rest:
                leave(gap - rest * n, sequence + full, 1)
            leave(gap, sequence + full + bool(rest), count - full - bool(rest))
            rank, left = rank + full * each + rest, left - full * each - rest
    return np.array(sorted(matches), np.int64).reshape(-1, 5), opened


def pack(
    df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, capacity: int = CAPACITY
) -> DataFrame:
    """The place of each piece of each document in the packed sequences.

    Columns: the id, ``piece`` (from 0), ``start`` (the document's ids before it), ``length``, ``ids_crc32``,
    ``sequence_id`` and ``offset``. A document is its text's ids and ``end_id``; null and empty texts are ``end_id``
    alone. Only documents longer than ``capacity`` are cut. Repeated rows are packed as often as they are; null ids are
    kept; an empty table gives an empty one. Other columns of ``df`` may have any names.
    """
    rows = checkpointed(tokenised_pieces(df, tokenizer_path, id_col, text_col, end_id, capacity))  # numbers, no texts
    by_part = rows.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    matches, _ = match_rounds(counts, capacity)
    kind = rows.schema["id"].dataType.simpleString()

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = matches[:, 0] << 48 | matches[:, 1]
        for batch in batches:
            length = batch["length"].to_numpy()
            rank = batch["nth"].to_numpy() + batch["before"].to_numpy()
            at = np.searchsorted(first, length << 48 | rank, "right") - 1
            inside, each = rank - matches[at, 1], matches[at, 2]
            sequence, offset = matches[at, 3] + inside // each, matches[at, 4] + inside % each * length
            names = [id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            own = [batch[c] for c in ("id", "piece", "start", "length", "crc")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(sequence), pa.array(offset)], names=names)

    ranked = rows.join(offsets, ["part", "length"]).select("id", "piece", "start", "length", "crc", "nth", "before")
    return ranked.mapInArrow(placed, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
