"""Token counts of a unigram vocabulary without the tokens: a Viterbi pass that keeps score and number of pieces.

An Aho-Corasick automaton lists the vocabulary's matches at each end, longest first; for each end the best score so far
and the number of pieces on its path are kept, nothing else. Ties go to the earliest start, and a character without a
piece of its own becomes an unknown piece with a penalty, runs of which count once, as in the tokenizer libraries.

Where pieces have the word mark only in front, and the mark is a piece itself, the best path of a text is that of its words one after the
other, and a worker counts each word once; for other vocabularies it counts whole texts. Where the vocabulary has a piece
for each byte, an unknown character counts as its UTF-8 bytes. Whatever the length of a text, only as many positions as
the longest piece has characters are held.

The registered query takes the scores of a public model whose own kind is BPE: its counts are those of these pieces and
scores under the unigram rule, which the tokenizer library gives as well, and not those of the model's own encoder.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Stand-in for the space (fixed value), and what an unknown character costs below the least score (fixed value).
MARK, PENALTY = "▁", 10.0
#: Words that a worker remembers; longer ones are counted anew each time.
REMEMBERED, LONGEST = 300_000, 100


def unigram_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a SentencePiece model file, the unknown piece first, byte pieces included; control pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [
        (model.id_to_piece(i), model.get_score(i))
        for i in range(model.get_piece_size())
        if not (model.is_unknown(i) or model.is_control(i) or model.is_unused(i))
    ]
    return [("<unk>", min(s for _, s in plain)), *plain]


class Counter:
    """Counts pieces of words by ``vocabulary``, whose first entry is the unknown piece."""

    def __init__(self, vocabulary: list[tuple[str, float]]) -> None:
        self.automaton = ahocorasick.Automaton()
        for k, (piece, score) in enumerate(vocabulary):
            self.automaton.add_word(piece, (len(piece), score, k == 0))
        self.automaton.make_automaton()
        self.bytes = {f"<0x{b:02X}>" for b in range(256)} <= {piece for piece, _ in vocabulary}
        self.longest = max(len(piece) for piece, _ in vocabulary)
        self.unknown = min(s for _, s in vocabulary) - PENALTY
        # else a piece, or a run of unknown ones, could reach across the edge of a word
        crossing = any(MARK in piece.lstrip(MARK) for piece, _ in vocabulary) or all(piece != MARK for piece, _ in vocabulary)
        self.words = re.compile(r"(?s).+" if crossing else f"{MARK}*[^{MARK}]+|{MARK}+")
        self.memory: dict[str, int] = {}

    def count_word(self, word: str) -> int:
        """Pieces on the best path; of equal scores, the one whose last piece starts first."""
        n, ring = len(word), self.longest + 1
        best, count, unknown = [0.0] * ring, [0] * ring, [False] * ring
        reached = 0
        minus = float("-inf")

        def unseen(start: int, end: int) -> int:
            """Pieces that an unknown stretch adds to a path: its bytes, or one for a run of such stretches."""
            return len(word[start:end].encode()) if self.bytes else int(not unknown[start % ring])

        def settle(end: int, matches: list) -> None:
            top, pieces, last_unknown, single = minus, 0, False, False
            for length, score, is_unknown in matches:  # longest first
                start = end - length
                single = single or length == 1
                if best[start % ring] + score > top:
                    top = best[start % ring] + score
                    pieces = count[start % ring] + (unseen(start, end) if is_unknown else 1)
                    last_unknown = is_unknown
            if not single and best[(end - 1) % ring] + self.unknown > top:
                top = best[(end - 1) % ring] + self.unknown
                pieces = count[(end - 1) % ring] + unseen(end - 1, end)
                last_unknown = True
            at = end % ring
            best[at], count[at], unknown[at] = top, pieces, last_unknown

        matches: list = []
        for last, match in self.automaton.iter(word):
            end = last + 1
            while reached < end:  # ends without a match, and the one before this
                if reached:
                    settle(reached, matches)
                reached += 1
                matches = []
            matches.append(match)
        while reached <= n:
            if reached:
                settle(reached, matches)
            reached += 1
            matches = []
        return count[n % ring]

    def count(self, text: str) -> int:
        """Pieces of a text, before which a word mark is put; none for an empty one."""
        if not text:
            return 0
        memory, total = self.memory, 0
        for word in self.words.findall(MARK + text.replace(" ", MARK)):
            known = memory.get(word)
            if known is None:
                known = self.count_word(word)
                if len(word) <= LONGEST:
                    if len(memory) >= REMEMBERED:
                        memory.clear()
                    memory[word] = known
            total += known
        return total


@lru_cache(maxsize=2)
def _counter(path: str) -> Counter:
    return Counter(unigram_vocabulary(path))


def count_tokens(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and ``n_tokens`` of each row; null and empty texts have none.

    Repeated rows come back as often as they were; null ids are kept; an empty table gives an empty one. Other columns
    of ``df`` may have any names. A text is not normalised; its spaces become word marks.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(model_path)
        for batch in batches:
            counts = [counter.count(t.as_py() or "") for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(counts, pa.int64())], names=[id_col, "n_tokens"])

    return rows.mapInArrow(counted, f"`{id_col}` {kind}, n_tokens long")
