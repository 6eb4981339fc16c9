"""Token counts of a unigram vocabulary by a count-only Viterbi pass."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyrogrid.llm.common import table

UNKNOWN_PENALTY = 10.0
SPACE = "▁"


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece file, in id order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceCounter(dict):
    """Number of pieces of the best segmentation of each word of a text.

    Aho-Corasick enumerates the vocabulary's matches by their end, longest first.  The dynamic
    program keeps best score and piece count of the last few positions only.  Tie rule, as in the
    unigram tokenizer: the match that starts first stays unless a later one scores strictly more.
    A character without a piece of its own may also be unknown, which scores 10 below the lowest
    piece and counts as its UTF-8 bytes (byte fallback).

    The text is split before each space mark and at newlines (a Metaspace split), and words are
    counted apart.  This split is part of the tokenizer: pieces of several space marks in the
    vocabulary are never used, so runs of spaces count more pieces than without it.  Scores are
    whole numbers, so sums and ties do not depend on where a text is cut.  At most ``most``
    words are kept in memory.
    """

    SPAN = 1 << 20

    def __init__(self, pieces: list[tuple[str, float]], most: int = 600_000):
        super().__init__()
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.longest = max(len(p) for p, _ in pieces)
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.apart = not any("\n" in p for p, _ in pieces)
        self.most = most
        self.bare: dict[str, int] = {}
        self.of = self.__getitem__

    def best(self, word: str) -> int:
        """Piece count of the best segmentation of one string."""
        size = self.longest + 1
        score, count = [0.0] * size, [0] * size
        lowest = float("-inf")
        done = 0  # positions up to here are final
        unknown, single = self.unknown, self.single

        def close(until: int) -> None:
            """Finish positions that no further match ends at: the unknown character comes last."""
            nonlocal done
            while done < until:
                done += 1
                here, last = done % size, (done - 1) % size
                if opened != done:
                    score[here] = lowest
                char = word[done - 1]
                if char not in single and score[last] + unknown > score[here]:
                    score[here] = score[last] + unknown
                    count[here] = count[last] + len(char.encode("utf-8", "surrogatepass"))

        opened = 0
        for end, (length, value) in self.automaton.iter(word):
            end += 1
            if end != opened:
                close(end - 1)
                opened = end
                score[end % size] = lowest
            here, start = end % size, (end - length) % size
            if score[start] + value > score[here]:
                score[here] = score[start] + value
                count[here] = count[start] + 1
        close(len(word))
        return count[len(word) % size]

    def __missing__(self, word: str) -> int:
        got = self.best(SPACE + word)
        if len(self) < self.most:
            self[word] = got
        return got

    def line(self, words: list[str], open_line: bool) -> int:
        """Pieces of one line's words; only a text's first word gets a mark without a space."""
        if open_line:
            return sum(map(self.of, words))
        first = words[0]
        if first not in self.bare:
            if len(self.bare) >= self.most:
                return (self.best(first) if first else 0) + sum(map(self.of, words[1:]))
            self.bare[first] = self.best(first) if first else 0
        return self.bare[first] + sum(map(self.of, words[1:]))

    def parts(self, text: str) -> Iterator[str]:
        at = 0
        while at < len(text):
            end = text.find(" ", at + self.SPAN)
            end = len(text) if end < 0 else end
            yield text[at:end]
            at = end

    def count(self, text: str) -> int:
        total = 0
        for part in self.parts(text):
            lines = part.split("\n") if self.apart else [part]
            for i, one in enumerate(lines):
                words = one.split(" ")
                if i == 0:
                    total += self.line(words[1:] if one[:1] == " " else words, True)
                else:
                    total += 1 + self.line(words, False)
        return total


def token_counts(docs: DataFrame, path: str | None = None, most: int = 600_000) -> DataFrame:
    """``doc_id, n_tokens, n_chars_counted`` of every whole text, one row for each input row.

    The vocabulary file and its scores are used as they are.  A null or empty text has no tokens;
    very long texts are read in stretches cut at spaces; repeated rows and null ids are kept;
    an empty table gives no rows; further columns of ``docs`` are ignored.
    """
    path = path or default_vocabulary()

    def run(batches):
        import pyarrow as pa

        counter = PieceCounter(vocabulary(path), most)
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([counter.count(t) for t in texts], pa.int64()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ],
                ["doc_id", "n_tokens", "n_chars_counted"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_tokens long, n_chars_counted long"
    )


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
