"""Operators 11 (prefix trie), 12 (language identification) and 13 (Merkle manifest)."""

import hashlib
import os
import zlib

import duckdb
import numpy as np
import pytest

from tracewell.llm import language_id, merkle, prefix_trie

CONVERSATION = "conv_id long, turn int, role string, text string, __at long, idx string"
DOCUMENT = "doc_id long, source string, lang string, n_chars long, text string, tree string, level int"


def crc(x) -> int:
    return zlib.crc32(str(x).encode())


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def rows_of(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)


def same_as_sql(df, sql: str, **tables) -> None:
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame)
    got = con.sql(sql)
    assert rows_of(df.select(got.columns)) == sorted(got.fetchall(), key=repr)


def trie(rows: list[tuple]) -> list[tuple]:
    """The nodes of the conversations (conv_id, turn, role, text, ...), by brute force."""
    own: dict[int, list] = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append(((turn is not None, turn or 0), role, sha(f"{len(role.encode())}:{role}{text}"), text))
    own = {c: [(r, x) for _, r, _, x in sorted(t)] for c, t in own.items()}
    whole = {c: (own.get(c - c % 100, [])[: crc(c) % 6]) + t[crc(c) % 6 :] for c, t in own.items()}
    members: dict[tuple, list[int]] = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for node, ids in members.items():
        below = [x for x in members if x[: len(node)] == node]
        child = {x for x in below if len(x) == len(node) + 1}
        leaves = [x for x in below if not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in below)]
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x)
        ends = ",".join(str(c) for c in sorted(ids) if len(whole[c]) == len(node))
        out.append((min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids), len(child), len(leaves), saved, sha(ends)))
    return sorted(out, key=repr)


def some_conversations() -> list[tuple]:
    rows = []
    for c in [0, 1, 2, 3, 7, 40, 99, 100, 101, 117, 205, 206, 999, 10**12]:
        for t in range(c % 4 + 2 * (c in (0, 100))):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"turn {t} of {'all' if t < 2 else c}", 1, "x"))
    rows += [(50 + k, t, "user", f"same {t}é", 1, None) for k in range(12) for t in range(9)]
    rows += [(7, None, None, None, 1, "x"), (7, None, "user", None, 1, "x"), (7, 0, "a", "tie", 1, "x"), (7, 0, "a", "tie", 1, "x"), (7, 0, "b", "", 1, "x"), (None, 0, "user", "lost", 1, "x")]
    rows += [(300, t, "user", "long", 1, "x") for t in range(40)] + [(301, t, "user", "a" * 40_000, 1, "x") for t in range(2)]
    return rows


def test_trie_against_brute_force_and_sql(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHAIN", 4)
    monkeypatch.setattr(prefix_trie, "IDS", 3)
    monkeypatch.setattr(prefix_trie, "GROUP_ROWS", 2)
    rows = some_conversations()
    df = spark.createDataFrame(rows, CONVERSATION)
    got = prefix_trie.prefix_trie(df.repartition(5))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert rows_of(got) == trie(rows)
    same_as_sql(got, prefix_trie.OP11_SQL, conversations=df.toArrow())


def test_trie_of_nothing_of_one_and_of_copies(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], CONVERSATION)).count() == 0
    assert prefix_trie.prefix_trie(spark.createDataFrame([(None, 0, "a", "b", 1, "x")], CONVERSATION)).count() == 0
    for rows in ([(5, 0, "a", "b", 1, "x")], [(c, 0, "a", "b", 1, "x") for c in range(1000)]):
        assert rows_of(prefix_trie.prefix_trie(spark.createDataFrame(rows, CONVERSATION))) == trie(rows)


def field(x) -> str:
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def up(run: list[str]) -> list[str]:
    return [sha("".join(run[i : i + 8])) for i in range(0, len(run), 8)]


def tree(leaves: list[str]) -> tuple[str, list[str]]:
    """The root, and for each leaf the siblings of its proof."""
    proofs, at, level = [""] * len(leaves), list(range(len(leaves))), leaves
    while len(level) > 1:
        for k, i in enumerate(at):
            first = i - i % 8
            proofs[k] += "".join(x for j, x in enumerate(level[first : first + 8], first) if j != i)
        level, at = up(level), [i // 8 for i in at]
    return level[0], proofs


def manifest(rows: list[tuple]) -> list[tuple]:
    leaf = lambda r, text: sha("".join(map(field, (r[0], r[1], r[2], r[3], text))))
    by: dict = {}
    for r in rows:
        forged = r[4].translate({k: k + 32 for k in range(65, 91)}) if r[4] is not None and r[0] is not None and crc(r[0]) % 3 == 0 else r[4]
        by.setdefault(r[2], []).append(((r[0] is not None, r[0] or 0), leaf(r, r[4]), r[0], leaf(r, forged)))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: tree([r[1] for r in sorted(by[x], key=lambda r: r[:2])]) for x in langs}
    root, tops = tree([trees[x][0] for x in langs])
    out = []
    for x, top in zip(langs, tops, strict=True):
        for r, proof in zip(sorted(by[x], key=lambda r: r[:2]), trees[x][1], strict=True):
            out.append((r[2], r[1], trees[x][0], root, sha(proof + top), r[3] == r[1]))
    return sorted(out, key=repr)


def check_manifest(spark, rows):
    df = spark.createDataFrame(rows, DOCUMENT)
    got = merkle.manifest(df.repartition(3))
    found = got.collect()
    assert sorted([(r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.verified) for r in found], key=repr) == manifest(rows)
    assert all(r.verified == (r.folded_root == r.root) for r in found)
    same_as_sql(got, merkle.OP13_SQL, documents=df.toArrow())


@pytest.mark.parametrize("n", [1, 65, 600])
def test_manifest_against_brute_force_and_sql(spark, n):
    check_manifest(spark, [(i, "web" if i % 3 else None, "en", i, f"Text {i} É", "t", i) for i in range(n)] + [(1000 + i, "s", f"l{i % 11}", None, "AB", "t", 0) for i in range(n // 4)])


def test_manifest_of_odd_rows(spark):
    rows = [(None, None, None, None, None, None, None), (None, "", "", 0, "", "", 0), (3, "s", None, 1, None, "x", 1), (3, "s", None, 1, "Two\nLines", "x", 1), (3, "s", None, 1, "Two\nLines", "x", 1)]
    rows += [(6, "s", "de", 1, "Ä" * 50_000, "x", 1), (6, "s", "dé", 1, "A" * 5, "x", 1), (-4, "s", "de", 1, "Z", "x", 1)]
    rows += [(None, "s", "en", 1, "Same", "x", 1)] * 100
    check_manifest(spark, rows)
    assert merkle.manifest(spark.createDataFrame([], DOCUMENT)).count() == 0


def test_manifest_tells_a_change_of_any_field(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, "s", "en", 1, "text", "x", 1) for i in range(20)], DOCUMENT)
    found = merkle.manifest(df, F.when(F.col("doc_id") == 7, "other").otherwise(F.col("text"))).collect()
    assert {r.doc_id for r in found if not r.verified} == {7}


def greedy(text: str, samples: list[str]) -> int:
    """Phrases of a text of one piece, by search."""
    at = count = 0
    while at < len(text):
        n = 1
        while at + n < len(text) and any(text[at : at + n + 1] in s for s in samples):
            n += 1
        at, count = at + n, count + 1
    return count


def test_phrases_against_search():
    rng = np.random.default_rng(1)
    word = lambda letters: "".join(rng.choice(list(letters), rng.integers(1, 7)))
    samples = [" ".join(word("abcde") for _ in range(60)) for _ in range(4)]
    texts = [" ".join(word("abcdefé") for _ in range(rng.integers(1, 60))) for _ in range(40)] + ["a", "xyz", ""]
    automaton = language_id.Automaton([language_id.code_points([s])[0] for s in samples])
    found, counts = language_id.parsed(texts, [automaton])
    assert counts.tolist() == [len(t) for t in texts]
    assert found[:, 0].tolist() == [sum(greedy(t[i : i + language_id.PIECE], samples) for i in range(0, len(t), language_id.PIECE)) for t in texts]


def test_characters_are_folded():
    codes, counts = language_id.code_points(["  Ab,\n(c)1! ", "É", "12 !", "", "\x00x\x00y\x00"])
    assert "".join(map(chr, codes)) == "ab céx y" and counts.tolist() == [4, 1, 0, 0, 3]


LANG = "doc_id long, text string, lang string, lang_pred string"


def test_languages_of_odd_rows(spark):
    known = [(i, f"the cat and the dog number {i}", "en", "x") for i in range(30)] + [(100 + i, f"der Hund und die Katze {i}", "de", "x") for i in range(30)]
    odd = [(1, None, "en", "x"), (2, "", None, "x"), (2, "123 ...", None, "x"), (None, "THE CAT!", None, "x"), (5, "die Katze " * 30_000, None, "x"), (5, "你好", "zh", "x")]
    samples = language_id.sample(spark.createDataFrame(known, LANG), language_id.F.col("lang"))
    assert [name for name, _ in samples] == ["de", "en"]
    got = language_id.languages(spark.createDataFrame(odd, LANG), samples).collect()
    assert [r.lang_pred for r in got][:5] == ["und", "und", "und", "en", "de"] and got[5].lang_pred == "de"
    assert [r.doc_id for r in got] == [1, 2, 2, None, 5, 5] and all(0 <= r.score <= 1 for r in got)
    assert language_id.languages(spark.createDataFrame([], LANG), samples).count() == 0
    nothing = language_id.sample(spark.createDataFrame([], LANG), language_id.F.col("lang"))
    assert nothing == () and {r.lang_pred for r in language_id.languages(spark.createDataFrame(known, LANG), nothing).collect()} == {"und"}


def test_sample_is_bounded_and_drawn_from_whole_texts(spark):
    text = "".join(chr(97 + (i * i) % 26) for i in range(language_id.PIECE * 1000))
    (name, pieces), = language_id.sample(spark.createDataFrame([(1, text, "en", "x")], LANG), language_id.F.col("lang"))
    at = [text.index(p) // language_id.PIECE for p in pieces]
    assert name == "en" and len(pieces) == language_id.PIECES and all(len(p) == language_id.PIECE for p in pieces) and len(at) == language_id.PIECES


def test_held_out_languages(spark, sf):
    sf = os.path.join(os.path.dirname(sf), "sf0.01")
    got = language_id.op12_language_id(spark, sf)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = got.collect()
    assert len(rows) == len(docs) and all(r.held_out == (crc(r.doc_id) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id] for r in held) >= 0.98 * len(held)
