"""Operator 4: token counts with a whole-token shortcut.

Offline, once per Python worker, every vocabulary string is encoded alone; those
that come out as one token are proven whole.  A word of a text that is in that
table counts one without any merging; only the rest is merged, each distinct
rest once per worker while the bounded memo holds it.

A byte-level vocabulary never joins a token across a single space or line feed
between two visible characters, so such texts are counted word by word.  Any
other run of white space is counted by the library, with the words at both its
sides and nothing else: a token may cross white space only from a word's end into
the run, or from its last space into the word after it.
"""

from __future__ import annotations

import re

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, map_texts, read, texts

VOCABULARY = "byte_bpe_50k.json"
#: Most merged words in each generation of a Python worker's memory; documents handled at once.
CACHE = 250_000
BLOCK_DOCS = 500
LIMIT = 1024


#: White space that is not a single space or line feed between two other characters.
ODD_SPACE = re.compile(r"\s\s+|[^\S \n]|\A\s|\s\Z")
#: Characters that Python takes for white space and the vocabulary's pattern does not.
NOT_SPACE = re.compile("[\x1c-\x1f]")


class TokenCounter:
    """Counts of one byte-level BPE vocabulary (a tokenizers .json file)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocab = self.library.get_vocab(with_added_tokens=True)
        strings = [s for s in self.library.decode_batch([[i] for i in vocab.values()], skip_special_tokens=False) if "�" not in s]
        #: Vocabulary strings that encode alone as one token.
        self.whole = {s for s, n in zip(strings, self.count_pieces(strings), strict=True) if n == 1}
        #: Counts of merged pieces, a leading space included.
        self.merged = Memo(CACHE)

    def count_pieces(self, pieces: list[str]) -> np.ndarray:
        """Token counts of pieces, each on its own, by merging."""
        if not pieces:
            return np.zeros(0, int)
        words = self.library.encode(pieces, is_pretokenized=True, add_special_tokens=False).word_ids
        return np.bincount(np.array(words, dtype=np.int64), minlength=len(pieces))

    @staticmethod
    def plan(text: str) -> tuple[int, list[list[str]]] | None:
        """Line feeds that count as one token each, and the pieces to be counted on their own; None where only the library can tell.

        After a space, a word takes the space along; at a line's start it has none.
        Of a longer run, all but the last character is a piece, unless nothing follows.
        """
        words = text.split()
        gaps = text.count(" ") + text.count("\n")
        cut = lambda part: [line.replace(" ", "\n ").split("\n") for line in part.split("\n")]
        if len(words) == gaps + 1 and sum(map(len, words)) + gaps == len(text):
            lines = cut(text)
            return len(lines) - 1, lines
        if NOT_SPACE.search(text) or "<|" in text:
            return None
        feeds, pieces, at, space = 0, [], 0, ""
        for run in ODD_SPACE.finditer(text):
            if run.start() > at:
                lines = cut(text[at : run.start()])
                lines[0][0] = space + lines[0][0]
                feeds, space = feeds + len(lines) - 1, ""
                pieces += lines
            white, at = run.group(), run.end()
            if at == len(text):
                pieces.append([white])
            else:
                space = " " if white[-1] == " " else ""
                pieces.append([x for x in (white[:-1], "" if space else white[-1]) if x])
        if at < len(text):
            lines = cut(text[at:])
            lines[0][0] = space + lines[0][0]
            feeds += len(lines) - 1
            pieces += lines
        return feeds, pieces

    def count(self, block: list[str]) -> list[int]:
        """Token counts of texts."""
        plans = [self.plan(text) for text in block]
        need = set().union(*[line for p in plans if p for line in p[1]])
        new = list(self.merged.missing(need - self.whole))
        self.merged.now.update(zip(new, self.count_pieces(new).tolist(), strict=True))
        whole, merged = self.whole, self.merged.now
        return [
            len(self.library.encode(text, add_special_tokens=False).ids) if plan is None else plan[0] + sum([1 if w in whole else merged[w] for line in plan[1] for w in line])
            for text, plan in zip(block, plans, strict=True)
        ]


_counters: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    if path not in _counters:
        _counters[path] = TokenCounter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit.

    Null counts as empty (0 bytes, 0 tokens).  Rows repeat as in the input, other
    columns are ignored, an empty table gives an empty result.
    """
    path = path or public_tokenizers.path(VOCABULARY)

    def make():
        counts = counter(path)
        return lambda block: [pa.array(counts.count(block), pa.int64())]

    rows = texts(docs, id_col, text_col).withColumn("n_bytes", F.octet_length("text").cast("long"))
    counted = map_texts(rows, make, "n_tokens long", BLOCK_DOCS)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents"))
