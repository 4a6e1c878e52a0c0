"""Every operator against brute force on small tables with nulls, empty and long texts, ties, repeats and clashing names."""

import hashlib
import io
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from cloudloom.llm import bytespans, decontaminate, extract, fingerprints, jaccard, language, mixing, quality, substrings, tokens
from cloudloom.llm.suffixes import repeated
from cloudloom.llm.wavelet import WaveletFile
from cloudloom.llm.wavelet import encode as pack

SPACE = b" \t\n\x0b\x0c\r"


def given(rows):
    return [(r.doc_id, (r.text or "").encode()) for r in rows.select("doc_id", "text").collect()]


def ordered(found):
    return sorted(map(repr, found))


def test_language(rows, none, spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tree = language.learn_from(docs)
    found = language.identify(docs, tree).where(language.held_out()).select("lang", "lang_pred", "score").collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.9 * len(found)
    assert all(0 <= r.score <= 1 for r in found)
    small = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in language.identify(rows, tree).collect()}
    assert small[4, None] == small[5, ""] == small[7, "12 34 !!"] == ("und", 0.0)
    assert small[8, small_text(rows, 8)][0] != "und"
    assert language.identify(none, tree).count() == 0
    assert {r.lang_pred for r in language.identify(rows, language.learn_from(none)).collect()} == {"und"}


def test_training_reads_whole_texts(spark):
    r = random.Random(5)
    lead = " ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(1_000)) + " "  # the same 7000 bytes for all
    docs = spark.createDataFrame([(i, lead + ("der Hund und die Katze " if i % 2 else "el perro con los gatos ") * 20, ("de", "es")[i % 2 == 0]) for i in range(40)], "doc_id long, text string, lang string")
    tree = language.train(docs)
    assert tree.names == ["de", "es"]
    assert all(r.lang == r.lang_pred for r in language.identify(docs, tree).collect())
    model = quality.train(docs, docs.selectExpr("doc_id", "CAST(lang = 'de' AS INT) AS label"))
    scores = {r.lang: r.score for r in quality.score(docs, model).collect()}
    assert scores["de"] > 0.5 > scores["es"]


def small_text(rows, i):
    return rows.where(f"doc_id = {i}").first().text


def test_fingerprints(rows, none):
    data = [(r.doc_id, r.text or "") for r in rows.collect()]
    h = {(r.doc_id, r.text or ""): r.hh for r in rows.selectExpr("doc_id", "coalesce(text, '') text", "xxhash64(coalesce(text, '')) hh").collect()}
    data.sort(key=lambda r: (r[0] is not None, r[0] or 0, h[r]), reverse=True)
    want = []
    for (i, t), (_, n) in zip(data, data[1:] + data[:1]):
        e = fingerprints.edit(t, n)
        a, b, c = fingerprints.signatures([t.encode(), e.encode(), n.encode()])
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), a.tobytes().hex(), b.tobytes().hex(), float((a == b).mean()), float((a == c).mean())))
    assert ordered(want) == ordered(tuple(r) for r in fingerprints.edited(rows).collect())
    assert fingerprints.edited(none).count() == 0
    groups = {r.doc_id: r.group for r in fingerprints.near_duplicates(rows).collect()}
    assert groups[1] == groups[2] == 1 and groups[3] == 1 and groups[8] == groups[9] == 8 and groups[4] != groups[1] and groups[None] is None


def test_signature_estimates_jaccard():
    random.seed(3)
    words = [f"w{i}" for i in range(400)]
    other = words[:300] + [f"v{i}" for i in range(100)]
    a, b = fingerprints.signatures([" ".join(words).encode(), " ".join(other).encode()])
    x = {tuple(words[i : i + 5]) for i in range(396)}
    y = {tuple(other[i : i + 5]) for i in range(396)}
    assert abs((a == b).mean() - len(x & y) / len(x | y)) < 0.15


def test_extract(spark):
    page = "<html><head><title>T x</title><script>var a='</p>';</script></head><body><nav><ul><li><a>m one</a></ul></nav><div class='ad'>buy now</div><article><h1>Head &amp; line</h1><p>first  <b>bo</b>ld<br>text<p>second &eacute; a&lt;b</p><aside>no</aside></article><section class=comments><p>me too</p></section><footer>&copy; x</footer></body>"
    pages = spark.createDataFrame([(1, "u", page, 5), (2, None, None, 5), (3, "v", "", 5), (3, "v", "", 5), (None, "w", "plain words <b", 5)], "page_id long, url string, html string, text int")
    got = [(r.page_id, r.text, r.n_chars) for r in extract.extract(pages).collect()]
    assert (1, "Head & line\nfirst bold text\nsecond é a<b", 40) in got
    assert got.count((3, "", 0)) == 2 and (2, "", 0) in got and (None, "plain words", 11) in got
    weights = extract.learn(extract.self_labelled(pages.where("html IS NOT NULL")))
    assert weights["p"] > weights["!li"] and all(w < 0 for w in weights.values())
    assert extract.extract(pages.where("false")).count() == 0


def test_bytes(rows, none):
    data = given(rows)
    seen = Counter(t[i : i + 200] for _, t in data for i in range(len(t) - 199))
    want = []
    for d, t in data:
        gone = bytearray(len(t))
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        runs = sum(1 for i, x in enumerate(gone) if x and (not i or not gone[i - 1]))
        want.append((d, len(t), sum(gone), runs, hashlib.sha256(bytes(b for b, x in zip(t, gone) if not x)).hexdigest()))
    for crowd, size in ((1000, 10**7), (2, 20_000)):
        assert ordered(want) == ordered(tuple(r) for r in bytespans.dedup_bytes(rows, crowd, size).collect())
    assert bytespans.dedup_bytes(none).count() == 0


def test_suffix_array():
    random.seed(1)
    for _ in range(60):
        spans = ["".join(random.choices("aab", k=random.randint(0, 50))).encode() for _ in range(6)]
        size = random.choice([1, 7, 8, 17])
        seen = Counter(s[i : i + size] for s in spans for i in range(len(s) - size + 1))
        for s, m in zip(spans, repeated(spans, size)):
            assert m.tolist() == [seen[s[i : i + size]] > 1 for i in range(max(0, len(s) - size + 1))]


def test_decontaminate(rows, none, spark):
    items = [(1, "two three four five six seven eight nine ten eleven twelve"), (2, "A B c"), (None, "w1x1 w2x2"), (4, None), (5, "??"), (6, "w5x5 w6x6 w7x7 w8x8 w9x9 w10x10 w11x11 w12x12 w13x13 w14x14")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = [(i, w) for i, t in items for w in decontaminate.windows(decontaminate.words_of((t or "").encode()), 10)]
    want = []
    for d, t in given(rows):
        w = decontaminate.words_of(t)
        hit, found = set(), set()
        for item, p in windows:
            for i in range(len(w) - len(p) + 1):
                if tuple(w[i : i + len(p)]) == p:
                    hit |= set(range(i, i + len(p)))
                    found.add(item)
        names = sorted(str(i) for i in found if i is not None)
        want.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    for block in (200_000, 1):
        assert ordered(want) == ordered(tuple(r) for r in decontaminate.decontaminate(rows, bench, block_windows=block).select(decontaminate.RESULT).collect())
    assert decontaminate.decontaminate(none, bench).count() == 0
    assert not decontaminate.decontaminate(rows, bench.where("false")).where("contaminated OR n_hit > 0").count()


def test_mix(rows, none):
    got = mixing.mix(rows).select("doc_id", "source", "text", "size", "source_size", "target", "copies", "taken").collect()
    assert len(got) == rows.count()
    sizes, targets = {}, {}
    for r in got:
        assert r.size == len((r.text or "").encode().split()) and r.taken == r.copies * r.size and r.copies <= 2
        sizes[r.source] = r.source_size
        targets[r.source] = r.target
    assert abs(sum(targets.values()) - 1.5 * sum(sizes.values())) < 1e-6
    for s in sizes:
        own = [r for r in got if r.source == s]
        assert sum(r.size for r in own) == sizes[s] and targets[s] <= 2 * sizes[s]
        assert abs(sum(r.taken for r in own) - targets[s]) <= max(Counter((r.doc_id, r.text) for r in own).values()) * max(r.size for r in own)
    assert ordered(got) == ordered(mixing.mix(rows).select(*got[0].__fields__).collect())
    assert mixing.mix(none).count() == 0


def test_tokens(rows, none):
    code = tokens.Encoder(tokens.vocabulary_path())
    plain = [(r.doc_id, r.text or "") for r in rows.collect()]
    want = Counter()
    for d, t in plain:
        ids = code.tokenizer.encode(t, add_special_tokens=False).ids + [2]
        want[d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    got = tokens.encode_documents(rows).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    assert tokens.encode_documents(none).count() == 0


def test_pieces_equal_whole_texts():
    code = tokens.Encoder(tokens.vocabulary_path())
    odd = ["a\nb's it's 12 ŒßÉ <|endoftext|>x Œuvre'S don't\x1cz \x85q w ́e", "<|startoftext|>", "Σίσυφος ΟΔΟΣ. İstanbul", "  ", "a.b,c!!"]
    ids, lens = code.encode(odd)
    assert [x.tolist() for x in np.split(ids, np.cumsum(lens)[:-1])] == [code.tokenizer.encode(t, add_special_tokens=False).ids + [2] for t in odd]


@pytest.mark.parametrize("n", [0, 1, 1000, 300_000])
def test_wavelet(n):
    ids = np.random.default_rng(n).zipf(1.4, n).astype(np.uint32) % 49_000
    w = WaveletFile(io.BytesIO(pack(ids, np.array([n]))))
    assert (w.ids() == ids).all()
    for i in range(0, n, max(1, n // 7)):
        token = int(ids[i])
        places = np.flatnonzero(ids == token)
        assert w.access(i) == token and w.count(token) == len(places) and w.occurrence(token, len(places) // 2) == places[len(places) // 2]
        assert w.count(token, 5, n // 2) == (ids[5 : n // 2] == token).sum()


def test_jaccard(rows, none):
    data = given(rows)
    own = []
    for _, t in data:
        w = bytes(b + 32 if 65 <= b <= 90 else b for b in t).split()
        own.append({tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set())
    ids = [d for d, _ in data]
    label = {d: d for d in ids if d is not None}
    moved = True
    while moved:
        moved = False
        for i, a in enumerate(own):
            for j, b in enumerate(own):
                if ids[i] is not None and ids[j] is not None and a and b and 100 * len(a & b) >= 85 * len(a | b) and label[ids[i]] > label[ids[j]]:
                    label[ids[i]] = label[ids[j]]
                    moved = True
    want = [(d, len(s), label.get(d)) for d, s in zip(ids, own)]
    for block, size in ((1000, 10**7), (2, 20_000)):
        assert ordered(want) == ordered(tuple(r) for r in jaccard.group(rows, block=block, group_bytes=size).collect())
    assert jaccard.group(none).count() == 0


def similar_texts(seed, n=60, words=60, most=7):
    """Texts of few templates with some words replaced: many pairs lie on both sides of the threshold."""
    r = random.Random(seed)
    texts = []
    for i in range(n):
        w = [f"t{i % 3}w{j}" for j in range(words)]
        for _ in range(r.randrange(most)):
            w[r.randrange(words)] = f"x{r.randrange(4)}"
        texts.append(" ".join(w))
    return texts


def smallest_linked(sets_, linked):
    """Smallest position of each set's component, by brute force."""
    label = list(range(len(sets_)))
    moved = True
    while moved:
        moved = False
        for i, a in enumerate(sets_):
            for j, b in enumerate(sets_):
                if label[j] < label[i] and linked(len(a & b), len(a | b)):
                    label[i], moved = label[j], True
    return label


def shingles_of(text, size):
    w = text.split()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))}


def test_jaccard_index_skips_foreign_shingles():
    block = np.arange(1, 131, dtype=np.uint64) * np.uint64(10)
    query = np.sort(np.concatenate([block[:90], block[:10] - np.uint64(1)]))
    index = jaccard.Index([block[:100]], np.array([100]))  # 90 of 110 shared
    assert index.search(query, 100, np.ones(1, bool)).tolist() == []
    assert index.search(block[:90], 90, np.ones(1, bool)).tolist() == [0]


def test_jaccard_over_blocks(spark):
    texts = similar_texts(1)
    want = smallest_linked([shingles_of(t, 4) for t in texts], lambda both, union: 100 * both >= 85 * union)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert 3 < len(set(want)) < 55
    assert want == [r.component_id for r in sorted(jaccard.group(docs, block=4).collect(), key=lambda r: r.doc_id)]


def test_asking_stays_with_shared_shingles(spark):
    """600 sets of one family in 300 components: only the sets of a shared rare shingle meet, each member set once."""
    data = [(i, 1, i // 2, [10 * (i // 4), 10 * (i // 4) + 1, -1 - i]) for i in range(600)]
    rows = spark.createDataFrame(data, "doc_id long, family long, component long, prefix array<long>")
    got = jaccard._asking(rows, 10).collect()
    assert len(got) == 600 + 300  # all pairs of blocks of the family would be 600 * 60 + 598 * 60
    assert {r.doc_id for r in got if not r.asks} == set(range(600))
    assert sum(r.asks for r in got) == 300 and len({r.t for r in got}) == 150


def test_near_duplicates_beyond_the_hub(spark):
    words = [f"w{j}" for j in range(150)]
    # thirty smaller ids, 0.74 like the pair's first, take the head of every band that the pair (0.82) shares
    texts = [" ".join([*words[: 4 * i], *(f"h{i}x{j}" for j in range(18)), *words[4 * i + 18 :]]) for i in range(30)]
    texts += [" ".join(words), " ".join([*words[:70], *(f"z{j}" for j in range(10)), *words[80:]]), *similar_texts(3, n=40, words=90, most=5)]
    want = smallest_linked([shingles_of(t, 5) for t in texts], lambda both, union: 10 * both >= 8 * union)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert want[:32] == [*range(31), 30] and len(set(want[32:])) < 40
    assert want == [r.group for r in sorted(fingerprints.near_duplicates(docs, block=8).collect(), key=lambda r: r.doc_id)]


def test_words(rows, none):
    data = [(d, t.split()) for d, t in given(rows)]
    first: dict = {}
    for d, w in data:
        for i in range(len(w) - 12):
            if d is not None:
                k = tuple(w[i : i + 13])
                first[k] = min(first.get(k, d), d)
    want = []
    for d, w in data:
        gone = set()
        for i in range(len(w) - 12):
            m = first.get(tuple(w[i : i + 13]))
            if m is not None and (d is None or m < d):
                gone |= set(range(i, i + 13))
        want.append((d, len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    for size in (10**7, 20_000):
        assert ordered(want) == ordered(tuple(r) for r in substrings.dedup_words(rows, size).collect())
    assert substrings.dedup_words(none).count() == 0


def test_quality(rows, none, spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.learn_from(docs, labels)
    found = quality.score(docs, model).where(quality.held_out()).join(labels, "doc_id").select("predicted", "quality").collect()
    assert sum(r.predicted == r.quality for r in found) >= 0.8 * len(found)
    got = quality.score(rows, model).collect()
    assert len(got) == rows.count() and all(0 <= r.score <= 1 for r in got)
    assert quality.score(none, model).count() == 0
    assert {r.score for r in quality.score(rows, quality.learn_from(docs, labels.where("false"))).collect()} == {0.5}
