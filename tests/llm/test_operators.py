"""Each operator against the library, brute force or an exact round trip, with nulls, empty and odd rows."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracewell.llm import bpe, common, embedding_dedup, exact_dedup, near_dup, packing, secrets, token_counts, toxicity, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, node long, blob string"
ODD = [
    None, "", " ", "  a  b\n\n c\t d ", "x", "word " * 3000, "a" * 5000, "<|endoftext|>x <|startoftext|>Y", "İSTANBUL ΣΑΣ é ́x don't WE'LL 123 4½ \x1cfoo\x1dbar a b",
    "日本語 テキスト 😀😀 !!??", "x\x85y", "'s 't abc's", "password: hunter22 token=abc secret : 'api' AKIA" + "A1" * 8, "0123456789abcdef" * 3 + " 😀 API_KEY=\"zzzzzzzz\"", "secret: token : abcdefgh",
    "same text here for all of us", "same text here for all of us", "SAME text here for all of us",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 3 else None, None, None, "x", 1, "b") for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows + [rows[3], (None, "no id", "en", "s", 5, "x", 1, "b")], SCHEMA)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_bpe_equals_the_library(spark, docs, none, sf):
    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    table = docs.select("doc_id", "text").unionByName(common.read(spark, sf, "documents").select(F.col("doc_id") + 1000, "text").toDF("doc_id", "text"))
    rows = table.collect()
    got = bpe.round_trip_digests(table).collect()
    assert len(got) == len(rows)
    want = Counter()
    for r in rows:
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter(map(tuple, got)) == want
    back = bpe.decode_documents(bpe.encode_documents(docs)).collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter((r.doc_id, lib.decode(lib.encode(r.text or "", add_special_tokens=False).ids, skip_special_tokens=False)) for r in docs.collect())
    assert bpe.round_trip_digests(none).count() == 0


def test_token_counts_equal_the_library(spark, docs, none, sf):
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    table = docs.select("doc_id", "text").unionByName(common.read(spark, sf, "documents").select("doc_id", "text"))
    want = Counter((r.doc_id, len((r.text or "").encode()), n := len(lib.encode(r.text or "", add_special_tokens=False).ids), n > 1024) for r in table.collect())
    assert Counter(map(tuple, token_counts.count_tokens(table).collect())) == want
    assert token_counts.count_tokens(none).count() == 0


def test_exact_dedup(docs, none):
    rows = docs.collect()
    groups = defaultdict(list)
    for r in rows:
        groups[r.text or ""].append(r.doc_id)
    got = exact_dedup.exact_duplicates(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(t for t, ids in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        known = [i for i in groups[text] if i is not None]
        assert (r.keep_id, r.group_size) == (max(known, default=None), len(groups[text]))
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter(hashlib.sha256(t.encode()).hexdigest() for t in groups)
    assert exact_dedup.exact_duplicates(none).count() == 0


def test_equal_rows_of_one_partition_make_one_local_group(spark):
    rows = [(i, "one text of all") for i in range(1000)] + [(None, "one text of all"), (5000, None), (5000, ""), (6, "other")]
    table = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert exact_dedup.local_groups(common.texts(table), 64).count() == 3
    assert sorted((r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(table).collect() if r.kept) == [(6, 1, True), (999, 1001, True), (5000, 2, True)]


def test_kept_rows_of_exact_dedup(docs, none):
    rows = docs.withColumn("winner", F.lit(1))
    got = exact_dedup.distinct_rows(rows).collect()
    last = {}
    for r in rows.collect():
        key = r.text or ""
        if key not in last or (r.doc_id or -1) > (last[key].doc_id or -1):
            last[key] = r
    assert {(r.doc_id, r.text or "") for r in got} == {(r.doc_id, k) for k, r in last.items()} and len(got) == len(last)
    assert exact_dedup.distinct_rows(rows).columns == rows.columns and exact_dedup.distinct_rows(none).count() == 0


def brute_jaccard(a, b):
    a, b = (Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := t.lower().split()) else Counter() for t in (a, b))
    both = set(a) & set(b)
    return sum(1 / sum(max(a[j] / a[i], b[j] / b[i]) for j in set(a) | set(b)) for i in both)


def test_probability_jaccard():
    rng = random.Random(1)
    for _ in range(60):
        a = [rng.choice("abc") for _ in range(rng.randint(0, 60))]
        b = [rng.choice("abc") for _ in range(rng.randint(0, 60))] if rng.random() < 0.5 else a[: rng.randint(0, 60)] + ["z"]
        assert near_dup.probability_jaccard(near_dup.shingles(" ".join(a)), near_dup.shingles(" ".join(b))) == pytest.approx(brute_jaccard(" ".join(a), " ".join(b)))


def test_registers_estimate_the_similarity():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(2000)]
    a = [rng.choice(words) for _ in range(400)]
    b = a[:300] + [rng.choice(words) for _ in range(100)]
    sets = [near_dup.shingles(" ".join(x)) for x in (a, b, a[:2])]
    held = near_dup.registers(sets, 2000)
    assert (held[0] == held[1]).mean() == pytest.approx(near_dup.probability_jaccard(sets[0], sets[1]), abs=0.05)
    assert (held != 0).all()


def test_near_dedup_against_brute_force(spark, docs, none):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(500)]
    texts = []
    for _ in range(30):
        base = [rng.choice(words) for _ in range(rng.choice([8, 40, 200]))]
        texts.append(base)
        for _ in range(rng.choice([0, 1, 3])):
            near = list(base)
            for _ in range(max(1, len(near) // 80)):
                near[rng.randrange(len(near))] = rng.choice(words)
            texts.append(near)
    shared = [rng.choice(words) for _ in range(40)]
    texts += [shared + [rng.choice(words) for _ in range(30)] for _ in range(40)]  # a passage of many
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, a), (j, b) in itertools.combinations(rows, 2):
        if brute_jaccard(a, b) >= 0.8:
            x, y = sorted((find(i), find(j)))
            root[y] = x
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == {i: find(i) for i, _ in rows}
    odd = near_dup.near_duplicates(docs).collect()
    classes = {r.doc_id: r.class_id for r in odd}
    assert classes[15] == classes[16] == classes[17] == 15 and classes[0] == 0 and classes[1] == 1 and classes[2] == 2
    assert len(odd) == docs.count() and sum(r.kept for r in odd) == len({r.class_id for r in odd})
    assert near_dup.near_duplicates(none).count() == 0


def test_tiles_find_all_close_pairs_of_different_components(spark):
    """Two buckets of one band each: every close pair in one tile, in the first band it shares, with both ends told."""
    rng = np.random.default_rng(5)
    sketch = rng.integers(0, 1 << 16, (1400, 160)).astype(np.uint16)
    sketch[1200:] = sketch[:200]
    sketch[1200:, :30] = 0
    sketch[700, :], sketch[701, :150] = sketch[0], sketch[1200, :150]
    part = [0 if i < 600 or 1390 <= i else i for i in range(1400)]
    rows = [(32 * 7 + band, i, p, p == 0, 1, bytearray(s.tobytes())) for band in (0, 6) for i, (p, s) in enumerate(zip(part, sketch, strict=True))]
    table = spark.createDataFrame(rows, "key long, node long, component long, main boolean, size int, sketch binary")
    bands = sketch.reshape(1400, 32, 5)
    share = set()
    for i in range(1400):
        for j in np.flatnonzero((sketch[i + 1 :] == sketch[i]).mean(1) >= near_dup.SKETCH_FLOOR) + i + 1:
            first = int((bands[i] == bands[j]).all(1).argmax())
            if part[i] != part[j] and first in (0, 6):
                share.add((32 * 7 + first, i, int(j)))
    got = []
    for _, call in near_dup._dealt(table).toPandas().groupby("call"):
        for tile, pairs, _ in near_dup._tiles(call):
            node = tile["node"].to_numpy()
            got += [(int(tile["key"].iloc[0]), *sorted((int(node[a]), int(node[b])))) for a, b in pairs]
    assert len(got) == len(set(got)) and set(got) == share and {k for k, _, _ in share} == {224, 230}
    ends = near_dup._with_partner(table.drop("size", "sketch"), table.select("node", "sketch").dropDuplicates(["node"])).collect()
    assert {(r.key, r.node) for r in ends} == {(k, i) for k, *p in share for i in p}


def test_near_dedup_of_null_and_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text), (None, text + " x"), (7, text), (7, text.upper()), (7, "other words"), (None, "alone"), (None, "alone"), ((1 << 53) + 1, "other  words"), (None, None), (None, "")]
    table = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, node int")
    got = Counter(map(tuple, near_dup.near_duplicates(table).collect()))
    want = [(None, 7, 4, False)] * 2 + [(7, 7, 4, True), (7, 7, 4, False), (7, 7, 2, True), ((1 << 53) + 1, 7, 2, False), (None, None, 2, True), (None, None, 2, False), (None, None, 1, True), (None, None, 1, True)]
    assert got == Counter(want)


def test_near_dedup_recall_on_the_tables(spark, sf):
    """All rows with an id divisible by 10 against all rows of sf0.01 by brute force: every link lies inside a class."""
    table = common.read(spark, sf.replace("0.001", "0.01"), "documents")
    sets = {r.doc_id: near_dup.shingles(r.text or "") for r in table.collect()}
    of = {r.doc_id: r.class_id for r in near_dup.near_duplicates(table).collect()}
    links = [(i, j) for i in sets if i % 10 == 0 for j in sets if i != j and near_dup.probability_jaccard(sets[i], sets[j]) >= near_dup.THRESHOLD]
    assert len(links) >= 10 and all(of[i] == of[j] for i, j in links)


def test_near_copies_of_one_text_that_differ_among_themselves(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for g in range(3):
        base = [rng.choice(words) for _ in range(250)]
        for k in range(120):
            near = list(base)
            for _ in range(rng.choice([1, 2, 4, 6, 7, 9]) if k else 0):
                near[rng.randrange(250)] = rng.choice(words)
            rows.append((1000 * g + k, " ".join(near)))
    rng.shuffle(rows)
    sets = {i: near_dup.shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(sorted(sets), 2):
        if near_dup.probability_jaccard(sets[i], sets[j]) >= 0.8:
            x, y = sorted((find(i), find(j)))
            root[y] = x
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == {i: find(i) for i in sets}
    assert len({find(i) for i in sets}) > 3


def brute_spans(text):
    out = []
    for k, pattern, group, least in (("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24)):
        out += [(m.start(), ["assign", "access", "hex"].index(k), k, m.end()) for m in re.finditer(pattern, text, re.ASCII) if len(m[group]) >= least]
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(out)]


def test_secrets_against_brute_force(spark, docs, none, sf):
    table = docs.select("doc_id", "text").unionByName(common.read(spark, sf, "documents").select("doc_id", "text"))
    found, fresh = secrets.scan_history(table)
    name = lambda s: f"{secrets.RULES[s.kind_no][0]}:{s.start}:{s.end}"
    want = Counter((r.doc_id, ",".join(brute_spans(r.text or ""))) for r in table.collect())
    assert Counter((r.doc_id, ",".join(map(name, r.findings))) for r in found.collect()) == want
    assert sum(1 for _, spans in want if spans) >= 3
    # A second run finds everything in the ledger and scans nothing.
    again, none_new = secrets.scan_history(table, fresh)
    assert none_new.count() == 0
    assert Counter((r.doc_id, ",".join(map(name, r.findings))) for r in again.collect()) == want
    assert secrets.scan_history(none)[0].count() == 0


def test_redaction(docs):
    got = {r.doc_id: r for r in secrets.redact(docs).collect()}
    for r in docs.collect():
        text, upto = "", 0
        for span in brute_spans(r.text or ""):
            _, a, b = span.split(":")
            if int(a) >= upto:
                text += (r.text or "")[upto : int(a)] + "[secret]"
            upto = max(upto, int(b))
        want = text + (r.text or "")[upto:] if upto else r.text
        assert got[r.doc_id].text == want
    assert secrets.redact(docs).columns == docs.columns
    clash = docs.withColumns({c: F.lit("x") for c in ("__found", "__key", "__blob", "__new", "findings", "row", "changed", "new")})
    assert sorted(str(r.text) for r in secrets.redact(clash).collect()) == sorted(str(r.text) for r in secrets.redact(docs).collect())
    assert {r["row"] for r in secrets.redact(clash).collect()} == {"x"} and secrets.redact(docs.limit(0)).count() == 0


def test_packing(docs, none):
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    table = docs.dropDuplicates(["doc_id"]).withColumn("part", F.lit("clash"))
    ids = {r.doc_id: [*lib.encode(r.text or "", add_special_tokens=False).ids, 1] for r in table.collect()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in packing.pack_documents(table).collect():
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(piece, "<u4").tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for doc, parts in pieces.items():
        parts.sort()
        assert [a for a, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1]] and sum(n for _, n in parts) == len(ids[doc])
    for parts in sequences.values():
        parts.sort()
        assert [a for a, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1]] and sum(n for _, n in parts) <= 2048
    assert packing.pack_documents(none).count() == 0


def test_packing_of_null_and_repeated_ids(spark):
    big = (1 << 53) + 1
    rows = [(None, "a b"), (None, "c"), (big, "a b"), (big, "a b"), (big, None), (1, "word " * 5000)]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(1)).collect()
    assert Counter((r.doc_id, r.doc_tokens) for r in got if r.start == 0) == Counter({(None, 3): 1, (None, 2): 1, (big, 3): 2, (big, 1): 1, (1, 5001): 1})
    assert sum(r.length for r in got) == 3 + 2 + 3 + 3 + 1 + 5001
    spans = defaultdict(list)
    for r in got:
        spans[r.sequence_id].append((r.offset, r.length))
    assert all([o for o, _ in sorted(x)] == [0, *np.cumsum([n for _, n in sorted(x)])[:-1]] and sum(n for _, n in x) <= 2048 for x in spans.values())


def test_packing_in_latin_1_and_beyond_equals_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    lib, own = Tokenizer.from_file(path), packing.IdBytes(path)
    rng = random.Random(1)
    odd = ["".join(rng.choice("abcXYZéÀß.,;:!?'\" \n\t()123-_ªºµ\xa0\x85\x1c\u0300İœ<|>$") for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    odd += ["it's. A's, ÀB. x... a.) e.g., foo!? ¿que? WE'LL. 1st. a\x85b. c\xa0d.", "İstanbul. ΣΑΣ. œuvre, <|endoftext|>. a.<|startoftext|>b.\n"]
    for text, raw in zip(odd, own.encode(odd), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids, text


def test_a_word_of_two_hundred_thousand_letters():
    rng = random.Random(4)
    word = "".join(rng.choice("abcdefghij") for _ in range(200_000))
    path = public_tokenizers.path("word_bpe_49k.json")
    coder, lib = bpe.TrieBpe(path), Tokenizer.from_file(path)
    ids = next(coder.encode([word]))
    assert "".join(coder.text[i].removesuffix("</w>") for i in ids) == word
    assert next(coder.encode([word[:5000]])) == lib.encode(word[:5000], add_special_tokens=False).ids


def test_token_counts_of_irregular_white_space():
    path = public_tokenizers.path("byte_bpe_50k.json")
    counts, lib = token_counts.TokenCounter(path), Tokenizer.from_file(path)
    rng = random.Random(2)
    odd = ["".join(rng.choice("ab,.\n\t  \n \r\x0b\xa0\u3000é1'\x85\x1c<|") for _ in range(rng.randint(0, 16))) for _ in range(3000)]
    odd += ["  hi <|endoftext|>  x", "hello\t\tworld  \n  again\n\nend \n", "\n\n\n", "\t", "a  b", " a", "a "]
    assert counts.count(odd) == [len(lib.encode(x, add_special_tokens=False).ids) for x in odd]
    assert sum(counts.plan(x) is not None for x in odd) > 1500


def test_best_fit_takes_the_tightest_window():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 101, 400)
    sequence, offset, n = packing.best_fit(lengths, 100)
    room, want = [], {}
    for i in sorted(range(400), key=lambda i: -lengths[i]):
        fit = [r for r in room if r >= lengths[i]]
        want[i] = min(fit, default=100)
        if fit:
            room.remove(min(fit))
        room.append(want[i] - lengths[i])
    assert {i: 100 - offset[i] for i in range(400)} == want and n == len(room)


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 16))
    x = np.concatenate([base, base[:20] + rng.normal(size=(20, 16)) * 0.25, base[:5]])
    rows = [(i, v.tolist(), int(i % 40 % 3)) for i, v in enumerate(x)]
    odd = [(100, None, 1), (101, [0.0] * 16, 1), (102, [float("nan")] + [1.0] * 15, 1), (103, rows[0][1], None), (104, [1.0, 2.0], 1), (105, [], 0), (106, [None] + [1.0] * 15, 1)]
    table = spark.createDataFrame([(a, b, c, "clash") for a, b, c in rows + odd], "vec_id long, embedding array<double>, label int, node string")
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(table).collect()}
    cos = x @ x.T / np.outer(*[np.linalg.norm(x, axis=1)] * 2)
    label = np.array([r[2] for r in rows])
    link = (cos >= 0.93) & (label[:, None] == label)
    np.fill_diagonal(link, False)
    reach = link | np.eye(len(x), dtype=bool)
    for _ in range(7):
        reach = (reach.astype(int) @ reach.astype(int)) > 0
    for i in range(len(x)):
        c = int(np.flatnonzero(reach[i]).min())
        assert tuple(got[i]) == (i, int(link[i].sum()), c, i == c)
    assert link.any()
    for i, _, _ in odd:
        assert tuple(got[i]) == (i, 0, i, True)
    assert embedding_dedup.near_vectors(table.limit(0)).count() == 0


def test_embeddings_of_null_ids_and_extreme_sizes(spark):
    rows = [(1, [1e200, 1e200]), (2, [1e-200, 1e-200]), (3, [1e-200, 0.0]), (4, [0.0, 5e-324]), (5, [0.0, 1e308]), (None, [1e200, 1e200]), (None, [1.0, 1.0]), (6, [1.0, 1.0]), (6, [2.0, 2.0])]
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, label int")
    got = sorted((tuple(r) for r in embedding_dedup.near_vectors(table).collect()), key=str)
    want = [(1, 3, 1, True), (2, 3, 1, False), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (None, 0, None, True), (None, 0, None, True), (6, 3, 1, False), (6, 3, 1, False)]
    assert got == sorted(want, key=str)


def test_joined_labels():
    rng = np.random.default_rng(3)
    for _ in range(20):
        a, b = rng.integers(0, 40, 25), rng.integers(0, 40, 25)
        label = embedding_dedup.joined(embedding_dedup.joined(np.arange(40), a[:10], b[:10]), a[10:], b[10:])
        want = list(range(40))
        for p, q in zip(a.tolist(), b.tolist(), strict=True):
            x, y = sorted((want[p], want[q]))
            want = [x if w == y else w for w in want]
        assert label.tolist() == want


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 130)]
    root = {i: {i} for e in edges for i in e}
    for a, b in edges:
        if root[a] is not root[b]:
            root[a] |= root[b]
            for i in root[b]:
                root[i] = root[a]
    got = {r.id: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: min(s) for i, s in root.items() if len(s) > 1}


def test_toxicity_generalises(spark, none):
    rng = random.Random(8)
    plain = ["".join(rng.choice(["an", "er", "ou", "th", "in", "re"]) for _ in range(3)) for _ in range(300)]
    rows = []
    for i in range(600):
        words = [rng.choice(plain) for _ in range(60)]
        if i % 4 == 0:
            words[5] = "idiot" + rng.choice(plain)  # endings that vary
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    table = spark.createDataFrame([(a, b, c) for a, b, c in rows] + [(1000, None, None), (1001, "", None)], "doc_id long, text string, held_out int")
    got = {r.doc_id: r for r in toxicity.score_documents(table, spark.createDataFrame([(a, c) for a, _, c in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert all(got[r[0]].held_out for r in held) and len(got) == len(table.collect())
    assert np.mean([got[a].predicted == c for a, _, c in held]) > 0.95
    assert 0 <= got[1000].score == got[1001].score < 0.7
    assert toxicity.score_documents(none, spark.createDataFrame([], "doc_id long, toxic int")).count() == 0


def test_url_filter(spark):
    entries = spark.createDataFrame([("b.com", "block", 10), ("b.com", "remove", 20), ("b.com", "block", 30), ("a.b.com", "allow", 12), (None, "block", 1), ("com", "block", None), ("b.com", "allow", 10)], "key string, action string, listed_at int")
    urls = [(1, "http://x.b.com/p", 9), (2, "http://x.b.com/p", 10), (3, "https://u@A.B.com:80/?q", 15), (4, "http://b.com", 25), (5, "http://b.com#x", 31), (6, None, 15), (7, "nonsense", 15), (8, "http://a.b.com", None), (3, "https://u@A.B.com:80/?q", 15)]
    got = url_filter.filter_captures(spark.createDataFrame([(*u, "k") for u in urls], "page_id long, url string, fetched_at int, key string"), entries).collect()
    assert sorted((r.page_id, r.verdict, r.matched_key) for r in got) == sorted(
        [(1, "unlisted", None), (2, "block", "b.com"), (3, "allow", "a.b.com"), (3, "allow", "a.b.com"), (4, "unlisted", None), (5, "block", "b.com"), (6, "unlisted", None), (7, "unlisted", None), (8, "unlisted", None)], key=str
    ) or sorted(map(str, [(r.page_id, r.verdict, r.matched_key) for r in got])) == sorted(map(str, [(1, "unlisted", None), (2, "block", "b.com"), (3, "allow", "a.b.com"), (3, "allow", "a.b.com"), (4, "unlisted", None), (5, "block", "b.com"), (6, "unlisted", None), (7, "unlisted", None), (8, "unlisted", None)]))


def test_url_filter_of_empty_tables(spark):
    entries = spark.createDataFrame([("b.com", "block", 1)], "key string, action string, listed_at int")
    captures = spark.createDataFrame([(1, "http://b.com", 2, "x"), (1, "http://b.com", 2, "x"), (None, "http://c.com", 2, "x")], "page_id long, url string, fetched_at int, verdict string")
    assert [r.verdict for r in url_filter.filter_captures(captures, entries.limit(0)).collect()] == ["unlisted"] * 3
    assert sorted((r.page_id or 0, r.verdict) for r in url_filter.filter_captures(captures, entries).collect()) == [(0, "unlisted"), (1, "block"), (1, "block")]
    assert url_filter.filter_captures(captures.limit(0), entries).count() == 0


def test_pipeline_stages_against_single_operators(spark, sf):
    import corpus_pipeline

    docs = common.read(spark, sf, "documents")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        before = {r.doc_id: r for r in docs.collect()}
        after = out.collect()
        if name == "packing":
            assert {r.doc_id for r in after} == set(before)
            break
        assert out.columns == docs.columns
        ids = {r.doc_id for r in after}
        assert len(ids) == len(after)
        if name == "exact_dedup":
            last = {}
            for i, r in before.items():
                last[r.text] = max(i, last.get(r.text, i))
            assert ids == set(last.values())
        if name == "near_dedup":
            for i, j in itertools.combinations(sorted(ids), 2):
                a, b = (set(before[k].text.lower().split()) for k in (i, j))
                if len(a & b) > 0.7 * len(a | b):
                    assert brute_jaccard(before[i].text, before[j].text) < 0.8
        if name == "secrets":
            assert ids == set(before) and not any(brute_spans(r.text) for r in after)
        docs = spark.createDataFrame(after, docs.schema)


def test_exact_dedup_of_rows_that_are_dealt_out(spark, sf):
    """Plans that run twice over other partitions, and results of which only some columns are asked for."""
    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source")
    n = table.count()
    for rows in (table.repartition(7), table.unionByName(table.repartition(5)), table.orderBy("source")):
        got = exact_dedup.exact_duplicates(rows)
        assert got.count() == rows.count() == got.select("text_sha256").count() and got.where("kept").count() == table.select("text").distinct().count()
    assert exact_dedup.distinct_rows(table.repartition(7)).count() == table.select("text").distinct().count() <= n


def test_names_that_clash_in_exact_dedup(spark):
    names = ["doc_id", "text", "__null", "row", "rank", "salt", "text_sha256", "blank", "cells", "none"]
    rows = spark.createDataFrame([(1, "a", *"bcdefghi"), (2, "a", *"BCDEFGHI"), (3, None, *"jklmnopq")], ", ".join(f"{c} {'int' if c == 'doc_id' else 'string'}" for c in names))
    got = exact_dedup.distinct_rows(rows)
    assert got.columns == names and sorted(map(tuple, got.collect())) == [(2, "a", *"BCDEFGHI"), (3, None, *"jklmnopq")]


def padding(pieces) -> float:
    used: dict = {}
    for r in pieces:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    return 1 - sum(used.values()) / (2048 * len(used))


def test_padding_does_not_grow_with_partitions(spark, sf):
    import os

    table = spark.read.parquet(os.path.join(os.path.dirname(sf), "sf0.01", "documents.parquet")).select("doc_id", "text")
    one = padding(packing.pack_documents(table.coalesce(1)).collect())
    pieces = packing.pack_documents(table.repartition(64)).collect()
    assert one < 0.01 and padding(pieces) < one + 0.01
    spans = defaultdict(list)
    for r in pieces:
        spans[r.sequence_id].append((r.offset, r.length))
    assert all([o for o, _ in sorted(x)] == [0, *np.cumsum([n for _, n in sorted(x)])[:-1]] and sum(n for _, n in x) <= 2048 for x in spans.values())
    assert sum(r.length for r in pieces) == sum({r.doc_id: r.doc_tokens for r in pieces}.values())


def test_gradients_of_toxicity_by_finite_differences():
    rng = np.random.default_rng(3)
    vector, weight, bias = rng.normal(size=(3, 11)), rng.normal(size=(2, 3)), rng.normal(size=2)
    doc, bucket, value = np.array([0, 0, 1, 1, 1, 2]), np.array([1, 4, 4, 7, 9, 0]), rng.random(6)
    args = doc, bucket, value, np.array([0, 1, 1]), np.array([1.0, 0.5, 2.0])
    _, grads = toxicity.gradients(vector, weight, bias, *args)
    for param, grad in zip((vector, weight, bias), grads, strict=True):
        for at in np.ndindex(param.shape):
            old, step = param[at], 1e-6
            param[at] = old + step
            up = toxicity.gradients(vector, weight, bias, *args)[0]
            param[at] = old - step
            down = toxicity.gradients(vector, weight, bias, *args)[0]
            param[at] = old
            assert abs((up - down) / (2 * step) - grad[at]) < 1e-6


def test_toxicity_against_a_plain_scorer(spark, sf):
    """Scores of whole texts by a loop over words and n-grams, with the numbers that the model comes down to."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(common.texts(docs), labels)

    def plain(text: str) -> float:
        words = text.lower().split()
        total = 0.0
        for w in words:
            b, _ = toxicity.grams([w])
            total += float(model.scores[b].astype(float).mean())
        return 1 / (1 + np.exp(-(total / (len(words) + toxicity.PAD) + model.bias)))

    texts_ = {r.doc_id: r.text or "" for r in docs.limit(40).collect()}
    got = {r.doc_id: r.score for r in toxicity.score_documents(docs, labels).collect() if r.doc_id in texts_}
    assert all(abs(got[i] - plain(t)) < 1e-6 for i, t in texts_.items())


def test_toxicity_learns_from_long_texts(spark):
    """Labelled texts of any length count: all of these are longer than 60,000 characters."""
    words = lambda bad, i: " ".join([f"w{(i * 7 + j) % 50}" + ("zzbad" if bad and j % 4 == 0 else "") for j in range(14_000)])
    rows = [(i, words(i % 2, i), i % 2) for i in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score_documents(docs, spark.createDataFrame([(i, c) for i, _, c in rows], "doc_id long, toxic int")).collect()}
    assert min(got[i] for i, _, c in rows if c) > max(got[i] for i, _, c in rows if not c)


def test_ledger_outlives_a_run(spark, tmp_path):
    """A half-filled ledger, a path with several versions, and another rule version."""
    path = str(tmp_path / "ledger")
    old = spark.createDataFrame([(1, "password=hunter22"), (2, "nothing")], "doc_id long, text string")
    new = old.unionByName(spark.createDataFrame([(1, "password=changed99"), (1, "nothing"), (3, "f" * 30), (None, None)], "doc_id long, text string"))
    _, first = secrets.scan_history(old, path)
    rows, second = secrets.scan_history(new, path)
    assert (first.count(), second.count()) == (2, 3) and secrets.read_ledger(spark, path).count() == 5
    want = {(r.doc_id, r.blob): [tuple(s) for s in r.findings] for r in secrets.scan_history(new)[0].collect()}
    assert {(r.doc_id, r.blob): [tuple(s) for s in r.findings] for r in rows.collect()} == want and rows.count() == 6
    assert secrets.scan_history(new, path)[1].count() == 0
    rules = (("hex", r"f+", 0, 1, r"f"),)
    other, third = secrets.scan_history(new, path, rules=rules, rule_version="base-2")
    assert third.count() == 5 and sorted(len(r.findings) for r in other.collect()) == [0, 0, 0, 0, 0, 1]
    assert secrets.read_ledger(spark, path).count() == 10 and secrets.scan_history(new, path)[1].count() == 0


def test_url_filter_of_a_key_with_thousands_of_entries(spark):
    entries = [("com", ("block", "allow", "remove")[t % 3], t) for t in range(0, 9000, 3)] + [("com", "block", t) for t in range(1, 9000, 3)] + [("b.com", "allow", 4000), ("b.com", "remove", 5000), ("com", None, None)]
    captures = [(i, f"http://{'b.com' if i % 4 == 0 else 'x.com'}/{i}", (i * 37) % 9500 - 100) for i in range(3000)]
    by: dict = {}
    for k, action, t in entries:
        if t is not None:
            by.setdefault(k, {})[t] = max(action, by.get(k, {}).get(t, ""))

    def plain(host: str, t: int) -> str:
        for key in (host, "com"):
            past = [x for x in by.get(key, {}) if x <= t]
            if past and by[key][max(past)] != "remove":
                return by[key][max(past)]
        return "unlisted"

    table = spark.createDataFrame(captures, "page_id long, url string, fetched_at int")
    got = {r.page_id: r.verdict for r in url_filter.filter_captures(table, spark.createDataFrame(entries, "key string, action string, listed_at int")).collect()}
    assert got == {i: plain(url.split("/")[2], t) for i, url, t in captures}
