import random

import numpy as np
from pyspark.sql import functions as F

from strataloom.llm.language import Fit, Layout, Tagger, fit_model, form, label_language, tag_documents, tag_words, train

WORDS = {
    "en": "the cache is full and we should not keep the old file because nobody reads this table with these names".split(),
    "de": "der Speicher ist voll und wir sollten die alte Datei nicht behalten weil niemand diese Tabelle mit den Namen liest".split(),
    "fr": "le cache est plein et nous ne devons pas garder ce vieux fichier parce que personne ne lit cette table avec les noms".split(),
    "ru": "кэш полон и мы не должны хранить старый файл потому что никто не читает эту таблицу с именами".split(),
}
CODE = ["  const a = load(b, {});", "func run(x int) error {", "pkg/a/b.go:12:3: dead_code", "```", "    return err", "}", "# dead_code"]


def sentence(rng, lang):
    return " ".join(rng.sample(WORDS[lang], 9)).capitalize() + "."


def corpus(n, seed):
    rng = random.Random(seed)
    rows, truth = [], {}
    for k in range(n):
        lang = rng.choice(list(WORDS))
        lines = []
        for i in range(1, 9):
            r = rng.random()
            if r < 0.3:
                lines.append(rng.choice(CODE))
            elif r < 0.4:
                lines.append("")
            else:
                own = lang if rng.random() < 0.85 else rng.choice(list(WORDS))
                lines.append(rng.choice(["", "> ", "// ", "1. "]) + sentence(rng, own))
                truth[k, i] = own
        label = lang if rng.random() < 0.9 else rng.choice(list(WORDS))
        rows.append((k, "\n".join(lines), label))
    return rows, truth


def test_held_out_lines(spark):
    rows, _ = corpus(400, 1)
    held, truth = corpus(200, 2)
    model = fit_model(spark.createDataFrame(rows, "k int, t string, label string"), "k", "t", "label", Fit(documents=100, lines=300))
    df = spark.createDataFrame([(*r, "x") for r in held], "k int, t string, label string, lines string")
    got = {(r["k"], r["line_no"]): r["lang"] for r in tag_documents(df.drop("lines"), "k", "t", model).select("k", F.explode("lines").alias("l")).select("k", "l.*").collect()}
    right = sum(got.get(x) == l for x, l in truth.items())
    assert right >= 0.98 * len(truth) and len(set(got) - set(truth)) <= 0.01 * len(truth)


def test_lines_that_switch(spark):
    """Words of lines in two languages, with code between: by word, on held-out lines."""
    rows, _ = corpus(400, 1)
    model = fit_model(spark.createDataFrame(rows, "k int, t string, label string"), "k", "t", "label", Fit(documents=200, lines=500, spliced=8))
    rng, held, truth = random.Random(4), [], {}
    for k in range(300):
        a, b = rng.sample(list(WORDS), 2)
        parts = [(a, rng.sample(WORDS[a], rng.randint(5, 9))), (b, rng.sample(WORDS[b], rng.randint(4, 8)))] + ([(a, rng.sample(WORDS[a], rng.randint(4, 7)))] if k % 2 else [])
        words = [(l, w) for l, ws in parts for w in ws]
        if k % 3 == 0:
            words.insert(len(parts[0][1]), (None, "pkg/a/b.go:12:3"))
        truth |= {(k, 2, i): l for i, (l, _) in enumerate(words, 1) if l}
        held.append((k, "\n" + " ".join(w for _, w in words) + ".\n}"))
    df = spark.createDataFrame(held, "k int, t string")
    got = {}
    for r in tag_words(df, "k", "t", model).collect():
        assert 0 < r["confidence"] <= 1 and r["first_word"] <= r["last_word"]
        got |= {(r["k"], r["line_no"], i): r["lang"] for i in range(r["first_word"], r["last_word"] + 1)}
    right = sum(got.get(x) == l for x, l in truth.items())
    assert right >= 0.95 * len(truth), right / len(truth)
    none = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (None, "```\n}")], "k int, line_no string")
    assert tag_words(none, "k", "line_no", model).count() == 0 == tag_words(df.limit(0), "k", "t", model).count()


def test_dirt(spark):
    rows, _ = corpus(150, 3)
    model = train([(t, l) for _, t, l in rows], Fit(lines=200))
    long = "\n".join(sentence(random.Random(i), "de") for i in range(3000))
    df = spark.createDataFrame([(1, None), (2, ""), (3, "  \n\n"), (4, "}\n```\n"), (5, long), (5, long), (None, "x"), (6, "word " * 20_000)], "k int, t string")
    got = tag_documents(df, "k", "t", model).collect()
    by = {r["k"]: r for r in got}
    assert len(got) == 8 and by[1]["lang"] is by[2]["lang"] is by[3]["lang"] is by[4]["lang"] is None
    assert by[5]["lang"] == "de" and len(by[5]["lines"]) == 3000 and len(by[5]["segments"]) == 1 and 0.9 < by[5]["confidence"] <= 1
    assert tag_documents(df.limit(0), "k", "t", model).count() == 0
    empty = train([], Fit())
    assert Tagger(empty).lines(["The cache is full and nobody reads."])[0][0] == 8


def test_labels(spark):
    names = {"EN": "en", " en_GB ": "en", "German": "de", "pt-BR": "pt", "русский": "ru", "und": None, "": None, None: None, "auto": None, "fra": "fr"}
    df = spark.createDataFrame([(k, v) for k, v in names.items()], "a string, b string")
    assert all(r["got"] == r["b"] for r in df.withColumn("got", label_language(F.col("a"))).collect())


def test_forward_backward_is_exact():
    rng = np.random.default_rng(1)
    sizes = np.array([3, 1, 4])
    x, move, start = rng.random((8, 3)), rng.random((3, 3)), rng.random(3)
    alpha, beta = Layout(sizes).sweep(x, move, start)
    got = alpha * beta
    got /= got.sum(axis=1, keepdims=True)
    at = 0
    for n in sizes:
        want = np.zeros((n, 3))
        for path in np.ndindex(*[3] * n):
            p = start[path[0]] * x[at, path[0]]
            for t in range(1, n):
                p *= move[path[t - 1], path[t]] * x[at + t, path[t]]
            for t in range(n):
                want[t, path[t]] += p
        assert np.allclose(got[at : at + n], want / want.sum(axis=1, keepdims=True))
        at += n


def test_forms():
    assert form("Cache,") == ("|s|cache", True) and not form("loadFile(x)")[1] and not form("a/b.go:1")[1] and form("l'ancien")[1]
