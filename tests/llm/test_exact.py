"""Learned operators against slow exact solvers; page extraction against brute force; the pipeline on awkward rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudloom.llm import decontaminate, extract, svm

WORDS = "one two three four five six seven eight nine ten " * 6


# -- page text ------------------------------------------------------------------
def test_best_run_is_the_largest_sum():
    r = random.Random(1)
    for _ in range(400):
        s = [r.choice([-8.0, -2.5, -1.0, -0.5, 0.0, 1.0, 2.0, 5.0]) for _ in range(r.randrange(25))]
        lo, hi = extract.best_run(s)
        best = max([sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1)], default=0.0)
        assert sum(s[lo:hi]) == max(best, 0.0) and (best > 0 or (lo, hi) == (0, 0))


def test_extracted_words_are_those_of_the_best_run():
    """Random tag sequences: the scan's text against the best of all runs, formed without the scan."""
    r = random.Random(2)
    weights = extract.default_weights()
    for _ in range(150):
        html = "".join(r.choice(["<div>", "</div>", "<p>", "</p>", "<nav>", "</nav>", "<b>", "</b>", " w ", " x y z ", "<li>", "<hr>"]) for _ in range(r.randrange(18)))
        list_ = extract.pieces(html)
        score = [weights.get(p.kind, weights["!?" if p.noise else "?"]) if p.tag else 0.0 if p.noise else float(len(p.text.split())) for p in list_]
        runs = [(sum(score[i:j]), -i, i, j) for i in range(len(score)) for j in range(i + 1, len(score) + 1)]
        top = max((x[0] for x in runs), default=0.0)
        got = extract.main_text(html, weights).split()
        texts = [[w for p in list_[i:j] if not p.noise for w in p.text.split()] for s, _, i, j in runs if abs(s - top) < 1e-9] if top > 0 else [[]]
        assert got in texts


@pytest.mark.parametrize("open_,close", [
    ('<article class="post comments-open">', "</article>"), ('<div class="layout has-sidebar">', "</div>"), ('<div class="overflow-hidden">', "</div>"),
    ('<div class="widget"><article>', "</article></div>"), ('<section id="page-comments">', "</section>"),
])
def test_names_never_cost_the_article(open_, close):
    inner = f"<h1>Title</h1><p>{WORDS}</p><p>{WORDS}</p>"
    page = f"<html><body><nav><a>menu</a></nav>{open_}{inner}{close}<footer>f</footer></body></html>"
    assert extract.main_text(page, extract.default_weights()).split() == ["Title", *WORDS.split(), *WORDS.split()]


@pytest.mark.parametrize("name", ["ad", "site-footer", "comment-list", "ad-slot-2", "sidebar left", "cookie_notice"])
def test_named_boxes_stay_out(name):
    page = f'<body><p>{WORDS}</p><div class="{name}"><p>buy this now</p></div><p>{WORDS}</p></body>'
    assert extract.main_text(page, extract.default_weights()).split() == [*WORDS.split(), *WORDS.split()]


def test_long_pages_teach_and_are_read_whole(spark):
    long = " ".join(f"word{i}" for i in range(60_000))
    html = f"<html><body><nav><a>menu</a></nav><article><p>{long}</p></article></body></html>"
    pages = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
    assert extract.self_labelled(pages).count() == 1
    assert extract.extract(pages).first().text == long


# -- linear machines ------------------------------------------------------------
def exact_dual(x, y, cost, balance=True):
    """Weights by projected gradient on the dual, with small steps until nothing moves."""
    x = np.hstack([x, np.ones((len(x), 1))])
    q = (y[:, None] * x) @ (y[:, None] * x).T
    top = np.full(len(y), cost)
    if balance:
        for side in (-1, 1):
            top[y == side] *= len(y) / (2 * (y == side).sum())
    a = np.zeros(len(y))
    step = 1 / np.linalg.eigvalsh(q)[-1]
    for _ in range(200_000):
        new = np.clip(a - step * (q @ a - 1), 0, top)
        if np.abs(new - a).max() < 1e-12:
            break
        a = new
    return (a * y) @ x, 0.5 * a @ q @ a - a.sum()


def objective(w, x, y, cost, balance=True):
    top = np.full(len(y), cost)
    if balance:
        for side in (-1, 1):
            top[y == side] *= len(y) / (2 * (y == side).sum())
    return 0.5 * w @ w + (top * np.maximum(0, 1 - y * (np.hstack([x, np.ones((len(x), 1))]) @ w))).sum()


@pytest.mark.parametrize("seed", range(6))
def test_coordinate_descent_reaches_the_optimum(seed):
    r = np.random.default_rng(seed)
    x = r.normal(size=(30, 5)) * (r.random((30, 5)) < 0.6)
    y = np.where(x[:, 0] + 0.5 * r.normal(size=30) > 0.2, 1.0, -1.0)
    first, index, value = [0], [], []
    for row in x:
        at = np.flatnonzero(row)
        index.append(at)
        value.append(row[at])
        first.append(first[-1] + len(at))
    w = svm.fit(np.array(first), np.concatenate(index), np.concatenate(value), y, 5, cost=1.0, rounds=4000)
    want, dual = exact_dual(x, y, 1.0)
    assert abs(objective(w, x, y, 1.0) + dual) < 1e-2 * max(1.0, abs(dual))  # no duality gap left
    assert np.abs(w - want).max() < 0.05


def test_ties_and_repeats_in_training():
    x = np.array([[1.0, 0.0], [1.0, 0.0], [0.0, 1.0], [0.0, 1.0], [1.0, 0.0]])
    y = np.array([1.0, 1.0, -1.0, -1.0, 1.0])
    fit = lambda: svm.fit(np.arange(6), np.array([0, 0, 1, 1, 0]), np.ones(5), y, 2, cost=1.0)
    assert np.array_equal(fit(), fit())
    assert (np.sign(np.hstack([x, np.ones((5, 1))]) @ fit()) == y).all()


# -- decontamination ------------------------------------------------------------
def test_wu_manber_finds_all_windows():
    r = random.Random(3)
    for length in (1, 2, 3, 10):
        size = 4
        windows = np.unique(np.array([[r.randrange(size) for _ in range(length)] for _ in range(12)], np.int32), axis=0)
        searcher = decontaminate.WuManber(windows, size)
        for _ in range(80):
            words = [r.randrange(-1, size) for _ in range(r.randrange(40))]
            for row in (windows[r.randrange(len(windows))].tolist(),):
                at = r.randrange(len(words) + 1)
                words[at:at] = row
            want = {(i, k) for i in range(len(words) - length + 1) for k, w in enumerate(windows.tolist()) if words[i : i + length] == w}
            assert set(searcher.scan(words)) == want


# -- the pipeline ---------------------------------------------------------------
def test_stages_keep_every_column(spark, tmp_path):
    import corpus_pipeline as p

    r = random.Random(4)
    words = [f"{a}{b}" for a in "bcdfg" for b in "aeiou"]
    texts = [" ".join(r.choices(words, k=r.randint(20, 60))) for _ in range(40)]
    texts += [texts[0], texts[1] + " end", " ".join(f"w{i % 701}" for i in range(20_000)), "", None, "12 !!"]
    clash = ["score", "lang_pred", "n_words", "n_hit", "n_items", "contaminated", "size", "source_size", "target", "copies", "taken", "copy", "component_id", "part", "mean", "g"]
    rows = [(i, t, r.choice(["en", "fr"]), r.choice(["s1", "s2", None])) for i, t in enumerate(texts)]
    rows += [(None, texts[2] + " null id", "en", "s1"), (3, texts[3], "en", "s1"), (3, texts[3], "en", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({c: F.lit(777) for c in clash})
    item = " ".join(texts[5].split()[3:15])
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now, seen = docs, {}
    for name, stage in p.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path)).cache()
        assert now.columns == docs.columns
        assert all(x[c] == 777 for x in now.select(*clash).distinct().collect() for c in clash)
        seen[name] = [(x.doc_id, x.text) for x in now.collect()]
    given = [(i, t) for i, t, _, _ in rows]
    assert sorted(map(repr, seen["language_id"])) == sorted(repr((i, t)) for i, t in given if t and any(c.isalpha() for c in t))
    kept = [i for i, _ in seen["jaccard_join"]]
    assert len([i for i in kept if i is not None]) == len({i for i in kept if i is not None}) and None in kept
    assert 40 not in kept and 0 in kept and 3 in kept
    gone = set(kept) - {i for i, _ in seen["decontamination"]}
    assert gone == {5}
    took = {}
    for i, t in seen["mixing"]:
        took[i] = took.get(i, 0) + 1
    assert max(took.values()) <= 2 and set(took) <= {i for i, _ in seen["decontamination"]}
    assert p.token_files(spark, now, str(tmp_path)).count() == len(seen["mixing"])
