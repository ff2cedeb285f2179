"""Operator 1: BPE encoding and decoding by prefix-sharing trie traversal.

The merges of a BPE vocabulary have a prefix property: the encoding of a symbol
string is the encoding of some shorter prefix followed by one last token, and
that last token is the only one whose pair with the token before it survives
merging on its own.  So each node of a trie over the distinct words needs one
state - its last token - found from the states of its ancestors, and words with
a common prefix share all the states of that prefix.

Normalising and cutting into words follow the vocabulary file, through its own
normaliser and pre-tokeniser; merging is done here.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from .common import Memo, map_texts, read, texts

VOCABULARY = "word_bpe_49k.json"
#: Most chunks, and words, in each of the two generations that a Python worker keeps.
CACHE = 400_000
#: Most pairs of tokens whose fit is remembered.
FITS = 2_000_000
#: Words per trie, and documents handled at once.
TRIE_WORDS = 20_000
BLOCK_DOCS = 500

#: Characters that str.split() cuts at and the vocabulary's pattern does not.
NOT_SPACE = re.compile("[\x1c-\x1f]")
PLAIN_SPACE = re.compile("[ \t\n\r]+")


MARKS = frozenset(".,;:!?")


class _Bytes(dict):
    """For str.translate: a character's UTF-8 bytes as the printable characters of byte-level BPE."""

    def __init__(self) -> None:
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in shown]
        self.of = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def __missing__(self, code: int) -> str:
        self[code] = out = "".join(self.of[b] for b in chr(code).encode())
        return out


BYTES = _Bytes()


def chunks_of(text: str) -> list[str]:
    """Pieces between white space; a token never crosses one."""
    if NOT_SPACE.search(text):
        return [x for x in PLAIN_SPACE.split(text) if x]
    return text.split()


class TrieBpe:
    """Encodes words of one BPE vocabulary (a tokenizers .json file)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        pairs = (tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"])
        self.rank = {pair: i for i, pair in enumerate(pairs)}
        self.text = {i: s for s, i in self.vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.library = Tokenizer.from_file(path)
        self.symbols = {s: self._symbols_of(s) for s in self.vocab}
        #: Tokens that their own symbols merge into; others never end a prefix.
        self.whole = {s: i for s, i in self.vocab.items() if self.merge(self.symbols[s]) == [s]}
        self.width = {i: len(self.symbols[s]) for s, i in self.whole.items()}
        #: The whole tokens as a trie from their last symbol backwards; "" holds a token's id.
        self.backwards: dict = {}
        for token, i in self.whole.items():
            *before, end = self.symbols[token]
            node = self.backwards.setdefault("end" + end[: -len(self.suffix)] if self.suffix and len(end) > len(self.suffix) and end.endswith(self.suffix) else end, {})
            for c in reversed(before):
                node = node.setdefault(c, {})
            node[""] = i
        self.fits: dict[int, bool] = {}
        self.words = Memo(CACHE)
        self.chunks = Memo(CACHE)
        self.said = Memo(CACHE)

    def _symbols_of(self, token: str) -> list[str]:
        if self.suffix and token.endswith(self.suffix) and token != self.suffix:
            stem = token[: -len(self.suffix)]
            return [*stem[:-1], stem[-1] + self.suffix]
        return list(token)

    def merge(self, parts: list[str]) -> list[str]:
        """Plain BPE: again and again the pair of lowest rank, leftmost first."""
        parts = list(parts)
        while len(parts) > 1:
            rank, i = min((self.rank.get(pair, 1 << 60), i) for i, pair in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def follows(self, before: int, token: int) -> bool:
        """Whether merging the symbols of both leaves exactly these two tokens."""
        if len(self.fits) > FITS:
            self.fits.clear()
        pair = [self.text[before], self.text[token]]
        found = self.fits[before << 20 | token] = self.merge([x for t in pair for x in self.symbols[t]]) == pair
        return found

    def encode_words(self, words: list[str]) -> Iterator[tuple[str, tuple[int, ...]]]:
        """Each distinct word (byte-level characters) with its ids.

        The words go into a trie; depth first, every node gets the last token of
        its prefix: the one suffix that is a whole token and may follow the last
        token of the prefix before it.
        """
        root: dict = {}
        end = "end"
        for word in words:
            node = root
            for c in word[:-1]:
                below = node.get(c)
                if below is None:
                    below = node[c] = {}
                node = below
            node[end + word[-1]] = word
        fits, follows, width, backwards = self.fits, self.follows, self.width, self.backwards
        last = [0] * (1 + max(map(len, words), default=0))  # last[d]: last token of the current prefix of d symbols
        path: list[str] = []  # symbols of the current prefix; it grows and shrinks with the walk, so a long word is held once
        walk = [iter(root.items())]
        while walk:
            for symbol, below in walk[-1]:
                node, k = backwards.get(symbol), len(path)
                found = []
                while node is not None:
                    if "" in node:
                        found.append((k, node[""]))
                    if not k:
                        break
                    k -= 1
                    node = node.get(path[k])
                for k, token in reversed(found):
                    if not k:
                        break
                    fit = fits.get(last[k] << 20 | token)
                    if follows(last[k], token) if fit is None else fit:
                        break
                else:
                    raise ValueError(f"no token ends {''.join(path) + symbol!r}")
                if len(symbol) == 1:
                    path.append(symbol)
                    last[len(path)] = token
                    walk.append(iter(below.items()))
                    break
                out = [token]
                depth = len(path) + 1 - width[token]
                while depth:
                    out.append(last[depth])
                    depth -= width[last[depth]]
                yield below, tuple(out[::-1])
            else:
                walk.pop()
                if path:
                    path.pop()

    @staticmethod
    def plain(chunk: str) -> list[str] | None:
        """Words of a chunk of Latin letters, perhaps with one mark after them; else None."""
        low = chunk.lower()
        if low > "\u024f" or max(low) > "\u024f":
            return None
        if low.isalpha():
            return [low.translate(BYTES)]
        if low[-1] in MARKS and low[:-1].isalpha():
            return [low[:-1].translate(BYTES), low[-1]]
        return None

    def _pieces(self, chunk: str) -> list[str | int]:
        """Words of a chunk in byte-level symbols; ids of special tokens as numbers."""
        if words := self.plain(chunk):
            return words
        out: list[str | int] = []
        for part in self.cut.split(chunk):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out += [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))]
        return out

    def learn(self, chunks: set[str]) -> Iterator[tuple[str, tuple[int, ...]]]:
        """Each of the chunks with its ids; their words are encoded once, a trie at a time."""
        todo = list(chunks)
        for at in range(0, len(todo), TRIE_WORDS):
            cut = {c: self._pieces(c) for c in todo[at : at + TRIE_WORDS]}
            words = self.words.missing({w for ws in cut.values() for w in ws if isinstance(w, str)})
            self.words.now.update(self.encode_words(list(words)))
            known = self.words.now
            for c, ws in cut.items():
                yield c, known[ws[0]] if len(ws) == 1 and isinstance(ws[0], str) else tuple(i for w in ws for i in (known[w] if isinstance(w, str) else (w,)))

    def encode(self, block: list[str]) -> Iterator[list[int]]:
        cut = [chunks_of(t) for t in block]
        new = self.chunks.missing({c for parts in cut for c in parts})
        self.chunks.now.update(self.learn(new))
        for parts in cut:
            yield [i for c in parts for i in self.chunks.now[c]]

    def decode(self, ids: Iterable[int]) -> str:
        """The token strings joined by a space: the vocabulary file names no decoder."""
        return " ".join(self.text[i] for i in ids)


_coders: dict[str, TrieBpe] = {}


def coder(path: str) -> TrieBpe:
    """One coder per Python worker and vocabulary; its caches are bounded."""
    if path not in _coders:
        _coders[path] = TrieBpe(path)
    return _coders[path]


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row per document: doc_id, ids (array of int).

    Whole texts; null counts as empty and gives no ids.  Rows repeat as they do in
    the input, other columns are ignored, an empty table gives an empty result.
    """
    path = path or public_tokenizers.path(VOCABULARY)

    def make():
        bpe = coder(path)
        return lambda block: [pa.array(list(bpe.encode(block)), pa.list_(pa.int32()))]

    return map_texts(texts(docs, id_col, text_col), make, "ids array<int>", BLOCK_DOCS)


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """One row per row of (doc_id, ids): doc_id, text; null ids count as none.

    Null and large doc_ids stay what they are, rows repeat, other columns are ignored.
    """
    path = path or public_tokenizers.path(VOCABULARY)

    rows = encoded.select("doc_id", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_DOCS):
                part = batch.slice(at, BLOCK_DOCS)
                texts_ = [bpe.decode(x or ()) for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts_, pa.string())], names=["doc_id", "text"])

    return rows.mapInArrow(run, StructType([rows.schema["doc_id"], StructField("text", StringType())]))


def round_trip_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text.

    Encodes and decodes within one task, so that ids never leave it: only digests
    do.  Per distinct chunk, the ids and the decoded string are put into text once.
    """
    path = path or public_tokenizers.path(VOCABULARY)

    def make():
        bpe = coder(path)
        number, words = {i: str(i) for i in bpe.text}, bpe.text
        said = bpe.said

        def run(block: list[str]) -> list:
            cut = [chunks_of(t) for t in block]
            new = said.missing(set().union(*cut))
            said.now.update((c, (" ".join([number[i] for i in ids]), " ".join([words[i] for i in ids]))) for c, ids in bpe.learn(new))
            known, rows = said.now.__getitem__, []
            for parts in cut:
                pairs = [*map(known, parts)]
                ids, text = " ".join([p[0] for p in pairs]), " ".join([p[1] for p in pairs])
                rows.append((ids.count(" ") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
            return [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.string()))]

        return run

    return map_texts(texts(docs, id_col, text_col), make, "n_tokens long, ids_sha256 string, decoded_sha256 string", BLOCK_DOCS)


def op1_bpe(spark, sf_dir: str) -> DataFrame:
    return round_trip_digests(read(spark, sf_dir, "documents"))
