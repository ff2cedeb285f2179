"""Operator 12: language identification by cross-parsing.

A text is parsed with each language's sample in turn: from where it stands, the
longest piece that occurs in the sample is one phrase, and so on to the end.  The
fewer phrases, weighed by the bits that name a place in the sample and divided by
the text's length, the nearer the language (Ziv and Merhav, 1993).

A suffix automaton of the sample has the longest match of every position: it is
followed until it has no step for the next character.  As a table of steps in which
a missing one leads to where the character alone leads, and is marked as the start
of a phrase, the automaton reads many texts at once, one look-up for a character.

Samples are bounded: PIECES pieces of PIECE characters a language, drawn by a hash
from all pieces of all learning texts, and at most ALL_PIECES over all languages.
Texts to be told are read whole; they are parsed in pieces of PIECE characters, so
that short and long texts are weighed alike and a phrase never spans a cut.
"""

from __future__ import annotations

import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts, read

PIECE = 512
PIECES, ALL_PIECES = 128, 1024
#: Most languages that are learned: those with the most pieces.
LANGUAGES = 100
#: Letters of a sample that are told apart, the most frequent ones; the rest match nothing.
LETTERS = 120
UNKNOWN = "und"

#: Classes of characters: what matches nothing (also the end of a piece of a sample), a run of other characters than letters, and letters from FIRST on.
ODD, GAP, FIRST = 0, 1, 2
STARTS = 1 << 30

_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in lower case, runs of other characters than letters as one space, and each text's count of them.

    Leading and trailing runs are left out; a text without letters has no code points.
    """
    ready = [(t if t.isascii() else unicodedata.normalize("NFC", t)).lower().replace("\x00", " ") for t in texts]
    codes = np.frombuffer("\x00".join(["", *ready, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter()[codes]
    doc = np.cumsum(codes == 0)
    kept = letter.copy()
    # A run counts once, before the letter that follows it in the same text.
    kept[:-1] |= ~letter[:-1] & letter[1:] & (codes[:-1] != 0)
    at = np.flatnonzero(kept)
    new = np.where(letter[at], codes[at], 32).astype(np.uint32)
    of = doc[at] - 1
    first = np.ones(len(of), bool)
    first[1:] = of[1:] != of[:-1]
    lead = first & (new == 32)
    return new[~lead], np.bincount(of[~lead], minlength=len(texts))[: len(texts)]


class Automaton:
    """Suffix automaton of pieces of text as a table of steps for all states and classes of characters.

    steps[state * classes + class] is the next state times ``classes``, plus STARTS
    where the step starts a phrase.  ``begin`` is the state before any character.
    """

    def __init__(self, pieces: list[np.ndarray]):
        count = Counter(dict(zip(*(x.tolist() for x in np.unique(np.concatenate([*pieces, np.empty(0, np.uint32)]), return_counts=True)), strict=True)))
        letters = [c for c, _ in sorted(count.items(), key=lambda x: (-x[1], x[0])) if c != 32][:LETTERS]
        self.class_of = np.full(0x110000, ODD, np.uint8)
        self.class_of[letters] = np.arange(FIRST, FIRST + len(letters))
        self.class_of[32] = GAP
        self.classes = FIRST + len(letters)
        self.length = sum(map(len, pieces))
        text: list[int] = []
        for piece in pieces:
            text += self.class_of[piece].tolist()
            text.append(ODD)
        self.steps, self.begin = self._table(self._states(text))

    @staticmethod
    def _states(text: list[int]) -> list[dict[int, int]]:
        """Steps of each state of the suffix automaton, which has every factor of ``text`` from state 0 (Blumer et al., 1985)."""
        step: list[dict[int, int]] = [{}]
        link, longest, last = [-1], [0], 0
        for c in text:
            new = len(step)
            step.append({})
            link.append(0)
            longest.append(longest[last] + 1)
            at = last
            while at >= 0 and c not in step[at]:
                step[at][c] = new
                at = link[at]
            if at >= 0:
                to = step[at][c]
                if longest[to] == longest[at] + 1:
                    link[new] = to
                else:
                    copy = len(step)
                    step.append(dict(step[to]))
                    link.append(link[to])
                    longest.append(longest[at] + 1)
                    while at >= 0 and step[at].get(c) == to:
                        step[at][c] = copy
                        at = link[at]
                    link[to] = link[new] = copy
            last = new
        return step

    def _table(self, step: list[dict[int, int]]) -> tuple[np.ndarray, int]:
        n = len(step)
        alone = np.full(self.classes, n, np.int64)
        for c, to in step[0].items():
            alone[c] = to
        alone[ODD] = n
        table = np.empty((n + 1, self.classes), np.int64)
        table[:] = alone * self.classes + STARTS
        for state, steps in enumerate(step):
            for c, to in steps.items():
                if c != ODD:
                    table[state, c] = to * self.classes
        if table.shape[0] * self.classes >= STARTS:
            raise ValueError("sample too large")
        return table.astype(np.int32).ravel(), n * self.classes

    def phrases(self, lanes: np.ndarray, live: list[int]) -> np.ndarray:
        """Phrases of each column of ``lanes`` (characters by place and column, longer columns first); live: columns that reach each place."""
        state = np.full(lanes.shape[1], self.begin, np.int32)
        count = np.zeros(lanes.shape[1], np.int32)
        of, steps = self.class_of, self.steps
        for row, k in zip(lanes, live, strict=True):
            got = steps[state[:k] + of[row[:k]]]
            count[:k] += got >> 30
            state[:k] = got & (STARTS - 1)
        return count


def parsed(texts: list[str], automata: list[Automaton]) -> tuple[np.ndarray, np.ndarray]:
    """(phrases, characters): phrases of each text by each automaton (text, automaton), and the text's characters."""
    codes, counts = code_points(texts)
    pieces = -(-counts // PIECE)
    of = np.repeat(np.arange(len(texts)), pieces)
    begin = np.repeat(np.cumsum(counts) - counts, pieces) + PIECE * (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    size = np.minimum(PIECE, np.repeat(np.cumsum(counts), pieces) - begin)
    order = np.argsort(-size, kind="stable")
    of, begin, size = of[order], begin[order], size[order]
    found = np.zeros((len(texts), len(automata)), np.int64)
    if not len(of):
        return found, counts
    longest = int(size[0])
    live = np.searchsorted(-size, -np.arange(longest), side="left").tolist()
    padded = np.concatenate([codes, np.zeros(PIECE, np.uint32)])
    lanes = padded[begin[None, :] + np.arange(longest)[:, None]]
    for i, automaton in enumerate(automata):
        np.add.at(found[:, i], of, automaton.phrases(lanes, live))
    return found, counts


_built: dict[tuple, list[Automaton]] = {}


def automata_of(samples: tuple[tuple[str, tuple[str, ...]], ...]) -> list[Automaton]:
    """Automata of the samples (language, pieces), built once in each Python worker."""
    if samples not in _built:
        _built.clear()
        _built[samples] = [Automaton([code_points([p])[0] for p in pieces]) for _, pieces in samples]
    return _built[samples]


def sample(docs: DataFrame, lang: Column, id_col: str = "doc_id", text_col: str = "text") -> tuple[tuple[str, tuple[str, ...]], ...]:
    """(language, pieces) of the languages in ``docs``: of all pieces of PIECE characters, those with the smallest hashes.

    A language's pieces are counted first, so that a threshold of the hash leaves
    about twice as many as are wanted before they are ordered.
    """
    size = F.char_length(text_col)
    rows = docs.where(lang.isNotNull() & (size > 0)).select(lang.alias("lang"), F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.ceil(size / PIECE).alias("pieces"))
    totals = rows.groupBy("lang").agg(F.sum("pieces").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    if not totals:
        return ()
    wanted = max(1, min(PIECES, ALL_PIECES // len(totals)))
    limit = F.create_map(*[F.lit(x) for t in totals for x in (t["lang"], min(1.0, 2 * wanted / t["n"] + 16 / t["n"]))])
    each = rows.where(F.col("lang").isin([t["lang"] for t in totals])).withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
    each = each.withColumn("hash", F.xxhash64("lang", "id", "at", F.substring("text", 1, 64))).where((F.col("hash").cast("double") / 2.0**64 + 0.5) < limit[F.col("lang")])
    pieces = each.select("lang", "hash", F.expr(f"substring(text, CAST(at * {PIECE} + 1 AS INT), {PIECE})").alias("piece"))
    by: dict[str, list] = {t["lang"]: [] for t in totals}
    for row in pieces.collect():
        by[row["lang"]].append((row["hash"], row["piece"]))
    return tuple((k, tuple(p for _, p in sorted(v)[:wanted])) for k, v in sorted(by.items()) if any(c.isalpha() for _, p in v for c in p))


def languages(docs: DataFrame, samples: tuple[tuple[str, tuple[str, ...]], ...], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, lang_pred, score.

    score is the winner's share of 2**-bits over all languages, where bits are those
    of a character: 1 is certain.  A text that is null, empty or without letters is
    UNKNOWN with score 0, and so are all where there is no sample.  Of equal
    languages the first by name wins.  Repeated rows are told each; texts of any
    length are read whole; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(samples)

    def make():
        automata = automata_of(sent.value)
        names = np.array([name for name, _ in sent.value], dtype=object)
        bits = np.array([np.log2(a.length + 2) for a in automata])

        def tell(texts: list[str]) -> list:
            pred, score = np.full(len(texts), UNKNOWN, dtype=object), np.zeros(len(texts))
            if len(names):
                phrases, size = parsed([t or "" for t in texts], automata)
                some = np.flatnonzero(size)
                cost = phrases[some] * bits / size[some, None]
                best = np.argmin(cost, axis=1)
                pred[some] = names[best]
                score[some] = 1 / np.exp2(cost[np.arange(len(some)), best][:, None] - cost).sum(axis=1)
            return [pa.array(pred.tolist(), pa.string()), pa.array(score)]

        return tell

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_texts(rows, make, "lang_pred string, score double", block=2000)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is not learned from: the crc32 of its id is 2 modulo 4; null ids are learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def op12_language_id(spark, sf_dir: str) -> DataFrame:
    """``languages`` of the whole table ``documents``, learned from the rows that are not held out; odd rows as stated there."""
    docs = read(spark, sf_dir, "documents")
    found = languages(docs, sample(docs.where(~held_out()), F.col("lang")))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
