"""Token counts under a unigram model of pieces, with one forward pass over a trie of pre-tokens.

A pre-token is a run of characters between white space with MARK before it. Its best segmentation is
the one with the highest sum of piece scores, the fewest pieces among equals. The distinct pre-tokens of
a partition are walked in sorted order, which is a depth-first walk of their trie: the forward score
and count of a shared prefix are computed once, on the way down, and the counts of ends are stored.

The model: the pieces come from a public vocabulary file, in the order of their ranks, and nothing is trained; the
file states no probabilities, so the unigram probability of the piece of rank r (from 0) is that of Zipf's law,
(1 / (r + 1)) / sum over all ranks. Its log is the piece's score, rounded to a millionth as an integer, so that sums
are exact; a caller with probabilities of its own passes `scores` instead. Characters without a piece cost a byte
token for each UTF-8 byte, ten below the least score. Counting needs no shuffle.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dartline.llm.common import row_slices, table

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Pieces that a vocabulary may have (it goes to every task).
PIECES = 1_000_000
#: Distinct pre-tokens, and pre-tokens in all (4 bytes each), that are gathered before the trie is walked.
GATHERED, HELD = 400_000, 16_000_000
UNIT = 1_000_000


def load_pieces(path: str = VOCABULARY) -> list[str]:
    """The ordinary pieces of a sentencepiece model file, by rank."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    return [p.id_to_piece(i) for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i))]


def piece_scores(pieces: list[str]) -> dict[str, int]:
    if len(pieces) > PIECES:
        raise ValueError(f"the vocabulary has more than {PIECES} pieces")
    total = sum(1 / (r + 1) for r in range(len(pieces)))
    return {p: round(-UNIT * math.log((r + 1) * total)) for r, p in reversed(list(enumerate(pieces)))}


class Counter:
    def __init__(self, scores: dict[str, int]):
        self.scores = scores
        lengths: dict[str, set[int]] = {}
        for p in scores:
            lengths.setdefault(p[-1], set()).add(len(p))
        #: by a piece's last character, how long such pieces are
        self.lengths = {c: tuple(sorted(v)) for c, v in lengths.items()}
        self.byte = min(scores.values(), default=0) - 10 * UNIT

    def counts(self, words: list[str]) -> dict[str, int]:
        """Tokens of each distinct pre-token."""
        scores, lengths, out = self.scores, self.lengths, {}
        best, count, last = [0], [0], ""
        for word in sorted(words):
            k, most = 0, min(len(last), len(word))
            while k < most and last[k] == word[k]:
                k += 1
            del best[k + 1 :], count[k + 1 :]  # what the prefix shares stays
            for end in range(k + 1, len(word) + 1):
                c = word[end - 1]
                n = len(c.encode("utf-8", "surrogatepass"))
                top, fewest = best[end - 1] + n * self.byte, count[end - 1] + n
                for length in lengths.get(c, ()):
                    if length > end:
                        break
                    s = scores.get(word[end - length : end])
                    if s is not None:
                        s += best[end - length]
                        if s > top or (s == top and count[end - length] + 1 < fewest):
                            top, fewest = s, count[end - length] + 1
                best.append(top)
                count.append(fewest)
            out[word] = count[-1]
            last = word
        return out


def pre_tokens(text: str | None) -> list[str]:
    return [MARK + w for w in text.split()] if text else []


def count_tokens(docs: DataFrame, pieces: list[str], scores: dict[str, int] | None = None) -> DataFrame:
    """doc_id, n_pretokens, n_chars and n_tokens of every row; extra columns are ignored.

    A null or empty text has 0 of each. A text of any length is counted whole; rows that repeat are counted one by
    one. Empty docs: no rows.
    """
    scores = docs.sparkSession.sparkContext.broadcast(scores or piece_scores(pieces))

    def run(batches):
        import pyarrow as pa

        counter = Counter(scores.value)
        held: list[tuple] = []  # doc_id, characters, numbers of its pre-tokens
        numbers: dict[str, int] = {}
        total = 0

        def flush():
            counts = counter.counts(list(numbers))
            per = np.fromiter((counts[w] for w in numbers), np.int64, len(numbers))
            ids, chars, own = zip(*held, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([len(x) for x in own], pa.int64()), pa.array(chars, pa.int64()), pa.array([int(per[x].sum()) for x in own], pa.int64())],
                names=["doc_id", "n_pretokens", "n_chars", "n_tokens"],
            )

        for rows in row_slices(batches):
            for doc_id, text in zip(rows["doc_id"], rows["text"], strict=True):
                words = pre_tokens(text)
                held.append((doc_id, len(text or ""), np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int32, len(words))))
                total += len(words) + 64  # a row costs something, too
            if len(numbers) >= GATHERED or total >= HELD:
                yield flush()
                held.clear()
                numbers.clear()
                total = 0
        if held:
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_pretokens long, n_chars long, n_tokens long")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), load_pieces())
