"""Token counts by a two-tier map-side lookup of pre-token lengths."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from .common import map_columns

#: A pre-token: the spaces before a word and the word; spaces at the end go with the last word.
UNIT = re.compile(r" +[^ ]+(?: +\Z)?")
SPACE_MARK = "▁"


def vocabulary_lengths(model_file: str) -> dict[str, int]:
    """Token counts of the pre-tokens that the vocabulary itself has as one piece.

    A vocabulary holds the words that were frequent in its training text, so this
    is the table of frequent pre-tokens; its size is bounded by the vocabulary's."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    words = [p[1:] for i in range(sp.get_piece_size()) if (p := sp.id_to_piece(i)).startswith(SPACE_MARK) and len(p) > 1 and SPACE_MARK not in p[1:]]
    return {" " + w: len(ids) for w, ids in zip(words, sp.encode(words), strict=True)}


class Lengths(dict):
    """The worker's cache: looks a miss up in the frequent table, else encodes it.

    Emptied when it has max_entries, so a worker's memory is bounded whatever the
    vocabulary of the corpus. Pre-tokens over max_chars are never kept."""

    def __init__(self, sp, frequent: dict[str, int], max_entries: int, max_chars: int = 48):
        super().__init__()
        self.sp, self.frequent, self.max_entries, self.max_chars = sp, frequent, max_entries, max_chars

    def __missing__(self, unit: str) -> int:
        n = self.frequent.get(unit)
        if n is None:
            n = len(self.sp.encode(unit[1:]))
        if len(unit) <= self.max_chars:
            if len(self) >= self.max_entries:
                self.clear()
            self[unit] = n
        return n

    def count(self, text: str) -> int:
        """Tokens of text. No piece has a space mark after another character, so
        merges never cross the start of a pre-token and lengths add up."""
        if SPACE_MARK in text or not text.strip(" "):
            return len(self.sp.encode(text))
        return sum(map(self.__getitem__, UNIT.findall(" " + text)))


def count_tokens(docs: DataFrame, model_file: str, limit: int = 4096, max_entries: int = 400_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs (doc_id, text).

    Map-side only: no shuffle of documents or pre-tokens, one output row per input
    row. Null text counts as empty (0 tokens, 0 bytes); null doc_id stays null;
    repeated rows and empty tables pass through; other columns are ignored."""
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(vocabulary_lengths(model_file))

    def factory():
        import sentencepiece

        lengths = Lengths(sentencepiece.SentencePieceProcessor(model_file=model_file), table.value, max_entries)

        def step(cols):
            texts = [t or "" for t in cols["text"]]
            n = [lengths.count(t) for t in texts]
            return {"doc_id": cols["doc_id"], "n_bytes": [len(t.encode()) for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

        return step

    return map_columns(docs.select("doc_id", "text"), factory, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
