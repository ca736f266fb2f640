import random

import numpy as np
import pytest

from ripplegraph.llm import leakage, quality


def distance(a, b):
    """Least edit distance of ``a`` and any part of ``b``, by the table."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_myers_against_the_table():
    rnd = random.Random(5)
    for _ in range(300):
        a = [rnd.randrange(4) for _ in range(rnd.randrange(1, 14))]
        b = [rnd.randrange(4) for _ in range(rnd.randrange(0, 25))]
        assert leakage.myers(a, b) == distance(a, b)


def test_words_fold():
    assert leakage.words("Über_den ﬁx\u200b, Ａbc—DÉJÀ rev\u00adisión ²x STRASSE straße") == ["uber", "den", "fix", "abc", "deja", "revision", "2x", "strasse", "strasse"]
    assert leakage.words("A_b-c 1.5") == ["a", "b", "c", "1", "5"] and leakage.words("") == []


def corpus():
    rnd = random.Random(7)
    vocabulary = [f"w{k}" for k in range(300)]
    items = [(k, " ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([5, 12, 30, 60])))) for k in range(40)]
    documents = []
    for k in range(300):
        body = [rnd.choice(vocabulary) for _ in range(rnd.randrange(0, 120))]
        if k % 2:
            passage = leakage.words(rnd.choice(items)[1])
            at, size = rnd.randrange(max(1, len(passage) - 10)), rnd.choice([8, 11, 12, 13, 25])
            part = passage[at : at + size]
            if k % 6 == 5 and len(part) > 8:
                part[rnd.randrange(len(part))] = "changed"
            cut = rnd.randrange(len(body) + 1)
            body[cut:cut] = [w.upper() if k % 4 == 1 else w for w in part]
        documents.append((k, (", " if k % 3 else " ").join(body)))
    return items, documents


@pytest.mark.parametrize("block", [leakage.BLOCK_BYTES, 2000])
def test_leaks_against_brute_force(spark, block):
    items, documents = corpus()
    grams: dict = {}
    for i, text in items:
        w = leakage.words(text)
        for k in range(len(w) - 11):
            grams.setdefault(tuple(w[k : k + 12]), set()).add(i)
    want = set()
    for d, text in documents:
        w = leakage.words(text)
        for k in range(len(w) - 11):
            want |= {(d, i) for i in grams.get(tuple(w[k : k + 12]), ())}
    docs = spark.createDataFrame([*((d, t, 1) for d, t in documents), (900, None, 1), (901, "", 1)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([*items, *items[:3], (None, "x"), (99, None)], "item_id long, text string")
    found = leakage.find_leaks(docs, bench, block_bytes=block)
    assert {(r["doc_id"], r["item_id"]) for r in found.where("run >= 12").collect()} == want
    windows = {i: [leakage.words(t)[k : k + 12] for k in range(len(leakage.words(t)) - 11)] for i, t in items}
    bodies = dict(documents)
    near = {(d, i) for d, t in documents for i, ws in windows.items() if ws and min(distance(w, leakage.words(t)) for w in ws) <= 1}
    got = {(r["doc_id"], r["item_id"]) for r in found.where("distance <= 1").collect()}
    assert got == near and bodies


def test_leaks_empty(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "x " * 40)], "doc_id long, text string")
    assert leakage.exact_leaks(docs, items).count() == 0 and leakage.exact_leaks(some, items).count() == 0
    assert leakage.exact_leaks(some, spark.createDataFrame([(1, "x " * 20)], "item_id long, text string")).count() == 1


PROSE = "The cache was rebuilt last week and lost some rows on the way. We still do not know who owns the loader, and nobody was warned before the change went out. "
LIST = "\n".join(f"- core/part_{k}.py\n- A{k} load rows" for k in range(12))
TABLE = "\n".join(f"| {k} | 0.{k} | read_{k} | pass |" for k in range(20))


def test_quality_tells_prose_from_the_rest(spark):
    rnd = random.Random(3)
    rows = []
    for k in range(240):
        kind = k % 6
        text = [PROSE * rnd.randrange(1, 6), LIST, TABLE, "0 " * 200, PROSE + "\n\n" + LIST * 3, PROSE * 9 + "\n\n" + LIST][kind]
        rows.append((k, text, "x"))
    rows += [(900, None, "x"), (901, " \n\t ", "x"), (902, ">\n> \n//", "x"), (903, "x", "x"), (904, PROSE * 4000, "x"), (0, PROSE, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, prose string").repartition(3)
    judged = quality.judge(spark, df).collect()
    assert all(abs(r["prose"] + r["lists"] + r["tables"] + r["junk"] - 1) < 1e-6 for r in judged)
    ids = {r["doc_id"] for r in judged}
    assert not ids & {900, 901, 902} and {903, 904} <= ids
    found = {r[0] for r in quality.not_prose(spark, df).collect()}
    assert {k for k in range(240) if k % 6 in (1, 2, 3, 4)} <= found
    assert not {k for k in range(240) if k % 6 in (0, 5)} & found and 904 not in found


def test_quality_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert quality.judge(spark, df).count() == 0 and quality.not_prose(spark, df).count() == 0


def test_texts_of_signs_only_are_no_prose(spark):
    signs = [(1, ">>>"), (2, "//\n> \n# "), (3, "\u200b\u200d"), (4, None), (5, " \n")]
    for others in ([], [(9, PROSE * 3)]):
        df = spark.createDataFrame(signs + others, "doc_id long, text string").coalesce(1)
        assert sorted(r[0] for r in quality.not_prose(spark, df).collect()) == [1, 2, 3]
        rows = {r["doc_id"]: r for r in quality.judge(spark, df, signs=True).collect()}
        assert set(rows) == {1, 2, 3} | {k for k, _ in others}
        assert all((rows[k]["words"], rows[k]["prose"], rows[k]["junk"]) == (0, 0.0, 1.0) for k in (1, 2, 3))


def test_statistics_of_a_document():
    words, length, symbols, ended, chars, sizes, flat, said = quality.read_text("The cat sat.\n> on the mat\n\n- item 4")
    assert words == 9 and ended == 1 / 3 and sum(chars) == 24 and len(flat) == len(chars) * len(quality.FORM)
    assert length == 24 / 9 and symbols > 0 and sizes == [6, 3]
    assert said[0] == said[4] == quality.word_number("the") and said[2] == quality.word_number("sat") | 1 and said[6] == said[8] == 0


def test_common_words_come_from_the_collection(spark):
    """Words of many documents that keep to clauses are common; pairs that nobody else writes are disorder."""
    rnd = random.Random(8)
    words = [f"{a}{b}{c}" for a in "bdfg" for b in "aeio" for c in "lmnr"]
    clause = lambda: " ".join(w for k in range(6) for w in (("zat", "vor", "nuk")[k % 3], rnd.choice(words))) + "."
    texts = [" ".join(clause() for _ in range(4)) for _ in range(200)] + ["\n".join(f"- {rnd.choice(words)}" for _ in range(40)) for _ in range(100)]
    read = quality.read_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    learned = quality.learn_words(read)
    numbers = {w: quality.word_number(w) for w in ("zat", "vor", "nuk")}
    assert set(numbers.values()) <= set(learned.common.tolist())
    assert not {quality.word_number(w) for w in words} & set(learned.common.tolist())
    rows = {r["doc_id"]: r for r in quality.complete(read, learned).collect()}
    assert rows[0]["common_words"] == 0.5 and rows[250]["common_words"] == 0


def invented(rnd):
    """A language nobody listed: function words, content words, and sentences of both."""
    syllables = [a + b for a in "kvtplzgn" for b in ("ra", "mo", "ui", "esh", "yl", "on")]
    small = rnd.sample(syllables, 24)
    large = ["".join(rnd.choice(syllables) for _ in range(rnd.choice([2, 3]))) for _ in range(300)]
    pairs = [(a, b) for a in small for b in rnd.sample(small, 3)]

    def sentence():
        out = []
        for _ in range(rnd.randrange(3, 6)):
            out += [*rnd.choice(pairs), rnd.choice(large)] if rnd.random() < 0.6 else [rnd.choice(small), rnd.choice(large)]
        return " ".join(out).capitalize() + "."

    return large, sentence


def test_quality_of_a_language_nobody_listed(spark):
    rnd = random.Random(11)
    large, sentence = invented(rnd)
    rows = []
    for k in range(400):
        prose = " ".join(sentence() for _ in range(rnd.randrange(3, 12)))
        if k % 5 == 1:
            text = "\n".join(f"- {rnd.choice(large)} {rnd.choice(large)}" for _ in range(rnd.randrange(8, 25)))
        elif k % 5 == 2:
            text = "\n".join(f"| {rnd.choice(large)} | {rnd.randrange(99)} | {rnd.choice(large)} |" for _ in range(rnd.randrange(8, 25)))
        else:
            text = prose
        rows.append((k, text))
    found = {r[0] for r in quality.not_prose(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {k for k in range(400) if k % 5 in (1, 2)}
    assert len(found & want) >= 0.98 * len(want) and len(found - want) <= 0.02 * 240


def test_em_does_not_lose_likelihood():
    rnd = np.random.default_rng(0)
    x = np.concatenate([rnd.normal(0, 1, (300, 3)), rnd.normal(4, 0.5, (200, 3))])
    start = quality.Mixture(np.full(2, 0.5), np.array([[1.0] * 3, [3.0] * 3]), np.ones((2, 3)))
    model, before = start, -np.inf
    for _ in range(12):
        sums = model.sums(x)
        assert sums[-1] >= before - 1e-6
        before, model = sums[-1], model.updated(sums, 0.0, start, 1e-6)
    assert np.allclose(sorted(model.mean[:, 0]), [0, 4], atol=0.2)
