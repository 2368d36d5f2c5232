"""Count-only Viterbi over a unigram vocabulary.

Tokens of a text under a unigram tokenizer are counted without making them: an Aho-Corasick automaton
lists the vocabulary pieces inside each word, and dynamic programming carries, for every place, the
best score and the number of pieces that reach it. The word mark goes before each word (runs of blanks
are one), and no piece crosses it, so words are counted once each and summed.

Tie rule of the tokenizer, kept exactly: places are relaxed from left to right, pieces by length at a
place, and only a strictly better score replaces what is there; so of equal paths the one whose last
piece begins first stays. A character without a piece of its own is an unknown one, scored ten below
the lowest score; neighbouring unknown characters count as one piece, or one piece per byte
when the vocabulary falls back to bytes.

The vocabulary (pieces with scores) is read from a public file; its path is a parameter. Nothing is
trained.

Defined results: NULL and blank texts have no tokens; repeated rows get equal counts; a document
column that clashes with the result column is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField, StructType

from gatewise.llm import textbytes as tb
from gatewise.llm.wordcache import WordCache

MARK = "▁"
UNKNOWN_PENALTY = 10.0
VOCABULARY = "piece_bpe_32k.model"


def read_vocabulary(name: str = VOCABULARY) -> tuple[list[tuple[str, float]], list[bool]]:
    """Normal pieces with their scores, and whether each of the 256 bytes has a piece."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
    ids = range(model.get_piece_size())
    pieces = [(model.id_to_piece(i), model.get_score(i)) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    have = {model.id_to_piece(i) for i in ids if model.is_byte(i)}
    return pieces, [f"<0x{b:02X}>" in have for b in range(256)]


class UnigramCounter:
    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool):
        import ahocorasick

        self.byte_fallback = byte_fallback
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        if pieces:
            self.automaton.make_automaton()
        self.any = bool(pieces)

    def count(self, word: str) -> int:
        """Pieces of one marked word."""
        n = len(word)
        at: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        single = [False] * n
        if self.any:
            for end, (size, score) in self.automaton.iter(word):
                at[end - size + 1].append((end + 1, score))
                single[end] |= size == 1
        best = [0.0] + [None] * n
        pieces, tail = [0] * (n + 1), [False] * (n + 1)  # tail: the path ends in an unknown character
        for i in range(n):
            here = best[i]
            if here is None:
                continue
            for end, score in sorted(at[i]):
                if best[end] is None or here + score > best[end]:
                    best[end], pieces[end], tail[end] = here + score, pieces[i] + 1, False
            if not single[i] and (best[i + 1] is None or here + self.unknown > best[i + 1]):
                cost = len(word[i].encode()) if self.byte_fallback else 0 if tail[i] else 1
                best[i + 1], pieces[i + 1], tail[i + 1] = here + self.unknown, pieces[i] + cost, True
        return pieces[n]


_workers: dict[str, tuple[UnigramCounter, WordCache]] = {}


def _worker(name: str) -> tuple[UnigramCounter, WordCache]:
    if name not in _workers:
        pieces, has_bytes = read_vocabulary(name)
        _workers[name] = UnigramCounter(pieces, all(has_bytes)), WordCache(dtype=np.uint32)
    return _workers[name]


def word_counts(data: np.ndarray, offsets: np.ndarray, counter: UnigramCounter, cache: WordCache) -> np.ndarray:
    """Pieces of every row."""
    starts, ends, rows = tb.word_spans(data, offsets, tb.NOT_SPACE)
    hashes, first, back = np.unique(tb.word_hashes(data, starts, ends), return_index=True, return_inverse=True)
    word_at = lambda k: data[starts[first[k]]:ends[first[k]]].tobytes()
    encode = lambda words: [[counter.count(MARK + w.decode("utf-8", "replace"))] for w in words]
    begin, _, pool = cache.lookup(hashes, word_at, encode)
    return np.bincount(rows, pool[begin][back], len(offsets) - 1).astype(np.int64)


def count_tokens(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, name: str = "n_tokens") -> DataFrame:
    """All columns of ``docs`` and the number of tokens of each text."""
    kept = [f for f in docs.schema.fields if f.name != name]

    def task(frames):
        counter, cache = _worker(vocabulary)
        for batch, data, offsets in tb.batches(frames, text):
            counts = word_counts(data, offsets, counter, cache)
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in kept] + [pa.array(counts)], [*(f.name for f in kept), name])

    return docs.select(*{f.name: 0 for f in kept} | {text: 0}).mapInArrow(task, StructType([*kept, StructField(name, LongType())]))


def token_report(docs: DataFrame) -> DataFrame:
    return count_tokens(docs.select("doc_id", "text")).select("doc_id", "n_tokens")
