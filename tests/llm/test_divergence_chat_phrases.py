"""Source divergence, chat formatting and phrases against brute force, with nulls, repeats, long texts and clashing names."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from cloudloom.llm import chat, divergence, phrases
from cloudloom.llm.terms import encode, pieces


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def corpus(spark, rows):
    """The shared rows, and several hundred short documents of few words in two languages and six sources."""
    r = random.Random(11)
    words = ["ba", "Be", "bi", "ño", "bu", "ca", "ce", "ci.", "co!", "cu"]
    made = [(100 + i, " ".join(r.choices(words, weights=range(10, 0, -1), k=r.randint(0, 30))), r.choice(["en", "de", None]), r.choice(["s1", "s2", "s3", "s4", None, ""])) for i in range(300)]
    made += [(900 + i, "ba be bi ño bu, ca ce", "en", f"s{i % 3}") for i in range(120)]
    some = spark.createDataFrame(made, "doc_id long, text string, lang string, source string")
    return rows.unionByName(some, allowMissingColumns=True)


def brute_audit(data, min_docs, top):
    tokens = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")) for text, lang, source in data]
    tokens = [(g, s, [lower(w) for w in t]) for g, s, t in tokens]
    out = set()
    for lang in {g for g, _, _ in tokens}:
        mine = [(s, t) for g, s, t in tokens if g == lang]
        df = Counter(w for _, t in mine for w in set(t))
        kept = {w for w, n in df.items() if n >= min_docs}
        count = defaultdict(Counter)
        for s, t in mine:
            count[s].update(w for w in t if w in kept)
        whole = sum(count.values(), Counter())
        share = lambda c: {w: 1 + 10**9 * (c[w] + 5) // (sum(c.values()) + 5 * len(kept)) for w in kept}
        p, q = {s: share(c) for s, c in count.items()}, share(whole)
        for s in count:
            pair = sorted(((-sum(abs(p[s][w] - p[o][w]) for w in kept), o.encode(), o) for o in count if o != s))
            term = sorted(((q[w] - p[s][w], w.encode(), w) for w in kept if count[s][w] and p[s][w] > q[w]))[:top]
            for part, found in (("pair", pair), ("term", term)):
                out |= {(lang, s, part, item, -v, i + 1) for i, (v, _, item) in enumerate(found)}
    return out


def test_divergence(spark, rows, none):
    docs = corpus(spark, rows)
    data = [(r.text, r.lang, r.source) for r in docs.select("text", "lang", "source").collect()]
    for min_docs, top in ((30, 50), (2, 3), (10**6, 50)):
        got = [tuple(r) for r in divergence.audit(docs, min_docs, top).collect()]
        assert len(got) == len(set(got)) and set(got) == brute_audit(data, min_docs, top)
    assert divergence.audit(none).count() == 0


def test_collapse_counts_copies(spark):
    docs = spark.createDataFrame([("a", "en", "x")] * 50 + [("a", "en", None)] * 3 + [(None, None, "x")], "text string, lang string, source string")
    found = {(r.lang, r.text): Counter({s.source: 0 for s in r.sources}) + sum((Counter({s.source: s.copies}) for s in r.sources), Counter()) for r in divergence.collapse(docs).collect()}
    assert found == {("en", "a"): Counter({"x": 50, "": 3}), ("", ""): Counter({"x": 1})}


def test_terms_of_long_texts():
    table = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))
    texts = [b"", ("Ab cé" * 3 + " x1y ").encode() * 300_000, b"zz"]
    codes, words, lens = encode(texts, table)
    assert [words[c].as_py() for c in codes.tolist()] == [w.decode() for t in texts for w in t.translate(table).split()]
    assert lens.sum() == len(codes) and lens[0] == 0 and lens[2] == 1
    assert b"".join(pieces(texts[1], 1000)) == texts[1]


# -- chat ---------------------------------------------------------------------
def test_escapes_round_trip():
    r = random.Random(2)
    parts = ["\\", "###", "#", "</turn>", "<", "/turn>", "\n", "h", "e", "n", " ok", "é"]
    for _ in range(500):
        text = "".join(r.choices(parts, k=r.randint(0, 12)))
        inside, name = chat.escape(text), chat.escape(text, True)
        assert chat.unescape(inside) == text and chat.unescape(name) == text
        assert "###" not in inside and "</turn>" not in inside and "\n" not in name


def test_conversations(spark, sf_dir):
    given = [
        (1, 0, "user", "a ### b"), (1, 1, "assistant", "x\\h </turn>\n"), (1, 1, "assistant", "x\\h </turn>\n"), (2, 5, "system", None), (2, None, "assistant", "late"),
        (2, 1, None, "first"), (None, 1, "user", "q"), (None, 2, "assistant", ""), (3, 1, "assist\nant:", "odd"), (4, 1, "assistant", "é" * 5000),
    ]
    rows = spark.createDataFrame([(*g, 1, "t") for g in given], "conv_id long, turn long, role string, text string, node int, tree string")
    want = {}
    planted = [(-7, 0, "user", chat.PLANTED), (-7, 1, "assistant", chat.PLANTED)]
    for i in {g[0] for g in given} | {-7}:
        mine = sorted(((t is None, t or 0, r or "", x or "") for c, t, r, x in given + planted if c == i))
        said = "".join(f"{r}\n{x}\n" for _, _, r, x in mine)
        loss = "".join(x for _, _, r, x in mine if r == "assistant")
        chars = sum(len(chat.escape(r, True)) + len(chat.escape(x)) + 14 for _, _, r, x in mine)
        want[i] = (len(mine), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), chars)
    for part in (chat.PART_CHARS, 10):
        found = {r[0]: tuple(r)[1:] for r in chat.digest_table(rows, part).collect()}
        assert found == want
    assert [r.conv_id for r in chat.digest_table(rows.where("false")).collect()] == [-7]


def brute_branches(messages, best):
    parent = {(t, n): p for t, n, p, _ in messages}
    score = {(t, n): s or 0.0 for t, n, _, s in messages}
    out = set()
    for tree in {m[0] for m in messages}:
        nodes = [n for t, n, _, _ in messages if t == tree]
        leaves = set(nodes) - {parent[tree, n] for n in nodes}
        paths = []
        for leaf in leaves:
            path, at = [], leaf
            while (tree, at) in parent and at not in path:
                path.append(at)
                at = parent[tree, at]
            if at in path:
                continue  # runs into a cycle
            paths.append((-sum(score[tree, n] for n in path) / len(path), leaf, path[::-1]))
        for i, (_, leaf, path) in enumerate(sorted(paths)[:best]):
            out |= {(tree, i + 1, leaf, n, k + 1) for k, n in enumerate(path)}
    return out


def test_reply_trees(spark):
    r = random.Random(4)
    messages = []
    for tree in ("a", "b", "c"):
        for n in range(60):
            messages.append((tree, n, None if n == 0 or r.random() < 0.03 else (r.randrange(max(0, n - 4), n) if tree != "c" else n - 1), r.randrange(8) / 4))
    messages += [("d", 1, 2, 1.0), ("d", 2, 1, 1.0), ("d", 3, 2, 1.0), ("d", 9, 9, 1.0), ("e", 5, 4, None), ("hub", 0, None, 0.0)] + [("hub", n, 0, float(n % 3)) for n in range(1, 80)]
    df = spark.createDataFrame(messages, "tree string, node long, parent long, score double")
    for best in (1, 3):
        got = [tuple(x) for x in chat.branches(df, best).collect()]
        assert len(got) == len(set(got)) and set(got) == brute_branches(messages, best)
    said = df.withColumns({"role": F.when(F.col("node") % 2 == 0, "user").otherwise("assistant"), "text": F.concat(F.lit("m"), F.col("node").cast("string"))})
    texts = {(x.tree, x.branch): x.text for x in chat.chat(said, 2).collect()}
    want = brute_branches(messages, 2)
    for key in {w[:2] for w in want}:
        path = [n for _, n in sorted((w[4], w[3]) for w in want if w[:2] == key)]
        assert chat.parse(texts[key]) == [("assistant" if n % 2 else "user", f"m{n}") for n in path]
    assert len(texts) == len({w[:2] for w in want})


# -- phrases ------------------------------------------------------------------
def brute_phrases(data, least, top):
    langs = defaultdict(list)
    for text, lang in data:
        langs["und" if lang is None else lang] += [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or ""))]
    out = set()
    for lang, parts in langs.items():
        f = Counter(tuple(w[i : i + k]) for w in parts for k in (1, 2, 3, 4) for i in range(len(w) - k + 1))
        n = sum(map(len, parts))
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        over = Counter()
        for p, a in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    over[p[i : i + k]] = max(over[p[i : i + k]], a)
        rows = []
        for p, a in found.items():
            if 100 * over[p] >= 80 * a:
                continue
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), " ".join(p), f[p[:k]], f[p[k:]]))
        out |= {(lang, i + 1, t, -a, l, r, n, -s) for i, (s, a, _, t, l, r) in enumerate(sorted(rows)[:top])}
    return out


def test_phrases(spark, rows, none):
    docs = corpus(spark, rows)
    data = [(r.text, r.lang) for r in docs.select("text", "lang").collect()]
    for least, top, block in ((30, 2000, 6_000_000), (5, 40, 300), (2, 10**6, 2_000)):
        got = [tuple(r) for r in phrases.collocations(docs, top, least, block).collect()]
        assert len(got) == len(set(got)) and set(got) == brute_phrases(data, least, top)
    assert phrases.collocations(none).count() == 0


def test_pairs_in_many_buckets():
    r = random.Random(8)
    for wide in (0, 1 << 33):
        ids = [r.randint(1, 5) + wide for _ in range(400)]
        places = sorted(r.sample(range(600), 400))
        import numpy as np

        at, held = phrases.packed(phrases.steps(np.array(places))), phrases.packed(np.array(ids))
        want = Counter((a, b) for (i, a), (j, b) in itertools.pairwise(zip(places, ids)) if j == i + 1)
        p = phrases.Pairs(at, held, 7)
        got = Counter()
        for _, left, right, n in p.asked():
            got.update(dict(zip(zip(phrases.unpacked(left).tolist(), phrases.unpacked(right).tolist()), phrases.unpacked(n).tolist())))
        assert got == want
        answers = [(k, phrases.packed(np.arange(len(phrases.unpacked(left))) + 1)) for k, left, _, _ in p.asked()]
        kept, number = p.kept(answers)
        assert len(kept) == sum(want.values()) and (number > 0).all()
