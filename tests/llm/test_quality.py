"""Operator 7: junk of ordinary letters, and perplexities against brute force."""

import functools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tracewell.llm import quality

SCHEMA = "doc_id long, text string, lang string"
SYLLABLES = {"en": "ba na tor el in so".split(), "de": "sch ei ung kel wo tra".split(), "fr": "que eau oi ment pli ru".split()}


def corpus():
    """Clean texts of 30 words a language; junk of the same syllables put together otherwise."""
    rng = random.Random(7)
    words = {lang: sorted({"".join(rng.choices(s, k=rng.randint(1, 3))) for _ in range(60)})[:30] for lang, s in SYLLABLES.items()}
    clean = lambda lang, n=60: " ".join(rng.choices(words[lang], k=n))
    junk = lambda lang: " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(60))
    rows = [(i, clean("en"), "en") for i in range(200)] + [(i, clean("de"), "de") for i in range(200, 400)] + [(i, clean("fr", 40), "fr") for i in range(400, 412)]
    rest = [(1000 + i, junk("en"), "en") for i in range(20)] + [(1100 + i, junk("en"), None) for i in range(20)] + [(1200 + i, junk("de"), "xx") for i in range(20)]
    rest += [(1300 + i, clean("en"), None) for i in range(20)] + [(1400 + i, clean("fr", 40), "fr") for i in range(20)]
    return rows, rest


@pytest.fixture(scope="module")
def verdicts(spark):
    rows, rest = corpus()
    docs = spark.createDataFrame(rows + rest, SCHEMA)
    return {r.doc_id: r for r in quality.score_documents(docs, docs.where("doc_id < 1000")).collect()}


def kept(verdicts, first):
    return sum(verdicts[first + i].kept for i in range(20))


def test_junk_of_ordinary_letters_is_found(verdicts):
    assert kept(verdicts, 1000) == 0
    assert sum(verdicts[i].kept for i in range(200)) >= 190


def grams(text, order=quality.ORDER):
    padded = "\n" * (order - 1) + text
    return [padded[i : i + order] for i in range(len(text))]


class Brute:
    """Interpolated modified Kneser-Ney over characters: language over all languages over even shares."""

    def __init__(self, texts):
        self.levels = {}
        for name, own in texts.items():
            level = Counter(g for t in own for g in grams(t))
            self.levels[name] = {quality.ORDER: level}
            for k in range(quality.ORDER - 1, 0, -1):
                level = Counter(g[1:] for g in level)
                self.levels[name][k] = level
        self.cuts = {(name, k): self.discounts(level) for name, of in self.levels.items() for k, level in of.items()}

    @staticmethod
    def discounts(level):
        n = [sum(c == i for c in level.values()) for i in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
        d = [max(0.1, min(i - 0.1, i - (i + 1) * y * n[i + 1] / n[i])) if n[i] and n[1] else 0.5 for i in (1, 2, 3)]
        return {g: d[min(c, 3) - 1] for g, c in level.items()}

    def p(self, name, gram):
        k = len(gram)
        if k == 0:
            return 1 / (len(self.levels["*"][1]) + 1) if name == "*" else None
        level, cut = self.levels[name][k], self.cuts[name, k]
        same = [g for g in level if g[:-1] == gram[:-1]]
        lower = self.p("*", gram) if k == 1 and name != "*" else self.p(name, gram[1:])
        if not same:
            return lower
        return (level.get(gram, 0) - cut.get(gram, 0) + sum(cut[g] for g in same) * lower) / sum(level[g] for g in same)


def test_perplexities_against_brute_force(spark):
    """Two scripts, held-out rows, an unknown language, nulls, and columns whose names clash."""
    rng = random.Random(3)
    word = lambda letters: "".join(rng.choices(letters, k=rng.randint(1, 4)))
    rows = [(i, " ".join(word("abcd") for _ in range(12)), "en") for i in range(60)] + [(100 + i, " ".join(word("абвг") for _ in range(12)), "ru") for i in range(60)]
    rest = [(200, "abc dcba zz", "en"), (201, "абв гг яя", "ru"), (202, "ab бв", None), (203, "ab бв", "xx"), (204, None, "en"), (205, "", "ru"), (None, "abc", "en"), (0, "abcd again", "en")]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows + rest], "doc_id long, text string, lang string, row long, block string")
    hashes = {r.text: r.h for r in table.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    known = [(i, t, lang) for i, t, lang in rows + rest if i is not None and i < 200]
    held = {t: h % quality.HELD == 0 for t, h in hashes.items()}
    n = Counter(lang for _, _, lang in known)
    place = lambda h: (h % 10_000 // 10 + 1000 * (h % 10)) / 10_000
    least = {min((hashes[t], t) for _, t, x in known if x == lang)[1] for lang in n} | {t for _, t, lang in known if place(hashes[t]) < max(0.1, min(0.5, 10 / n[lang]))}
    train = [(t, lang) for _, t, lang in known if not held[t] and t not in least]
    model = Brute({"=en": [t for t, x in train if x == "en"], "=ru": [t for t, x in train if x == "ru"], "*": [t for t, _ in train]})
    fair = {"=en": [t for _, t, x in known if x == "en" and (held[t] or t in least)], "=ru": [t for _, t, x in known if x == "ru" and (held[t] or t in least)], "*": [t for _, t, _ in known if held[t]]}
    assert fair["=en"] and fair["=ru"]
    total = functools.cache(lambda name, t: sum(math.log(model.p(name, g)) for g in grams(t)))
    mean = {n: sum(total(n, t) for t in ts) / sum(map(len, ts)) for n, ts in fair.items()}
    got = quality.score_documents(table, spark.createDataFrame([(i,) for i in range(200)], "doc_id long")).collect()
    assert len(got) == len(rows + rest)
    by = {(r.doc_id, r.n_grams): r for r in got}
    limit = {}
    for i, t, lang in rows + rest:
        name, t = f"={lang}" if lang in ("en", "ru") else "*", t or ""
        want = math.exp(-(total(name, t) + quality.PRIOR * mean[name]) / (len(t) + quality.PRIOR))
        r = by[i, len(t)]
        assert math.isclose(r.perplexity, want, rel_tol=1e-9) and r.kept == (r.perplexity <= r.threshold)
        limit.setdefault(name, set()).add(r.threshold)
    assert all(len(x) == 1 for x in limit.values()) and len(set.union(*limit.values())) == 3
    # Over the known characters and one unknown, the shares of a context sum to one.
    for name, context in (("=en", "abc"), ("=ru", "\n\n\n"), ("*", "ab "), ("=en", "яяя")):
        assert math.isclose(sum(model.p(name, context + c) for c in {g for g in model.levels["*"][1]} | {"?"}), 1, rel_tol=1e-9)


def test_blocks_and_pieces_do_not_change_the_result(spark, monkeypatch):
    texts = ["ab" * 40, "", "c", "xyz" * 30]
    whole = Counter((int(p), names[g]) for place, gram, names in quality.pieces(texts) for p, g in zip(place, gram, strict=True))
    monkeypatch.setattr(quality, "PIECE_CHARS", 7)
    cut = Counter((int(p), names[g]) for place, gram, names in quality.pieces(texts) for p, g in zip(place, gram, strict=True))
    assert whole == cut == Counter((i, g) for i, t in enumerate(texts) for g in grams(t))


def test_no_trusted_text_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "some text", "en"), (2, None, None)], SCHEMA)
    assert all(r.kept for r in quality.score_documents(docs, docs.limit(0)).collect())
    assert quality.score_documents(docs.limit(0), docs.limit(0)).count() == 0


def test_rows_without_a_language_model_are_judged_by_all_trusted_text(verdicts):
    assert kept(verdicts, 1100) == 0 and kept(verdicts, 1200) == 0  # null language; one without trusted rows
    assert kept(verdicts, 1300) >= 18
    assert verdicts[1100].threshold == verdicts[1200].threshold == verdicts[1300].threshold > 0


def test_a_rare_language_has_its_own_threshold(verdicts):
    assert verdicts[1400].threshold != verdicts[1300].threshold
    assert kept(verdicts, 1400) >= 15
