"""Phrase collocation mining by SETM: frequent phrases from persisted, sorted occurrence relations.

R1 holds the place and word of every occurrence of a frequent word, R(k) the place and phrase of every occurrence of a
frequent phrase of k words, sorted by place and written as a table, one row a block of text. Places number the words
of a block, and each end of a piece takes a place of its own, so neighbouring places lie in one piece. A round

1. merge-joins R(k) with itself at neighbouring places: the phrases at i and i + 1 overlap in k - 1 words and name one
   phrase of k + 1 words,
2. group-counts those pairs: a block sends each of its distinct pairs once with a count, to the bucket of the pair's
   hash, which adds up and numbers the pairs that are frequent,
3. semi-joins the occurrences with the frequent pairs; what is left is R(k + 1).

Words are compared as strings and phrases by their exact pairs of numbers, never by hashes. Blocks are cut where
pieces end, so neither many documents nor long ones make a block large. A word or pair that a third of the corpus
repeats costs a bucket one entry a block.

Scores are integers: the product of 2 000 000 and a count is taken in 38 digits.

Defined results: null text counts as empty, null lang as ``und``; repeated rows count as often as they stand; a
language without candidates has no rows, and an empty table none; ties of a score go to the larger count, then to the
phrase that comes first in UTF-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloudloom.llm.common import keep, texts_of
from cloudloom.llm.terms import coded

MIN_COUNT = 30
LONGEST = 4
FACTOR = 2_000_000
COVERED = 80
TOP = 2000
BLOCK_BYTES = 6_000_000
#: Tokens of the corpus for each bucket of pairs.
BUCKET_TOKENS = 2_000_000
#: Bytes to what they count as: lower case, tab as space, the ends of pieces as line feeds.
_MARKS = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 9 else 10 if b in b".,;:!?\n\v\f\r" else b for b in range(256))
_BLOCK = pa.schema([("g", pa.int64()), ("lang", pa.string()), ("n", pa.int64()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("codes", pa.binary())])
_PLACED = "g long, at binary, id binary"


def packed(values: np.ndarray) -> bytes:
    """Integers of at least 0 in the width their maximum needs, compressed; the first byte is the width."""
    width = 4 if not len(values) or int(values.max()) < 1 << 32 else 8
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(values.astype(f"<u{width}").tobytes())


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), f"<u{data[0]}").astype(np.int64)


def steps(places: np.ndarray) -> np.ndarray:
    """Differences of ascending places, which pack better."""
    return np.diff(places, prepend=0)


def cut_text(buf: bytes, size: int) -> Iterator[bytes]:
    """Parts of about ``size`` bytes that end where a piece ends; a longer piece stays whole."""
    at = 0
    while at < len(buf):
        to = buf.find(b"\n", at + size)
        to = len(buf) if to < 0 else to + 1
        yield buf[at:to]
        at = to


def tokens(part: bytes, size: int = 1_000_000) -> tuple[np.ndarray, pa.Array]:
    """Codes from 1 of the words in order, 0 for the end of a piece, and the dictionary (without the end mark)."""
    chunks = []
    for some in cut_text(part, size):
        chunks.append(pa.array([w for w in some.replace(b"\n", b" \n ").split(b" ") if w], pa.binary()))
    codes, words = coded(chunks)
    end = words.index(pa.scalar("\n", pa.string())).as_py()
    if end < 0:
        return codes + 1, words
    codes = np.where(codes == end, 0, codes + (codes < end))
    return codes, pa.concat_arrays([words.slice(0, end), words.slice(end + 1)])


def blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(g, lang, n, words, counts, codes): the tokenised corpus. ``g`` names the block by task and order."""
    own = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = TaskContext.get().partitionId() << 32
        for batch in batches:
            langs = batch.column("lang").dictionary_encode()
            of = langs.indices.to_numpy()
            for i, lang in enumerate(langs.dictionary.to_pylist()):
                some = batch.take(pa.array(np.flatnonzero(of == i)))
                buf = b"\n".join(texts_of(some)).translate(_MARKS)
                for part in cut_text(buf, block_bytes):
                    codes, words = tokens(part)
                    counts = np.bincount(codes, minlength=len(words) + 1)[1:]
                    row = {"g": [g], "lang": [lang], "n": [int(counts.sum())], "words": [words.to_pylist()], "counts": [counts.tolist()], "codes": [packed(codes)]}
                    yield pa.RecordBatch.from_pydict(row, schema=_BLOCK)
                    g += 1

    return own.mapInArrow(run, "g long, lang string, n long, words array<string>, counts array<long>, codes binary")


def numbered(rows: DataFrame, label: str) -> DataFrame:
    """The rows as a table with a dense-ish unique ``id`` from 1: its place in its partition, partitions taking turns."""
    at = F.monotonically_increasing_id()
    kept = keep(rows.withColumns({"_part": F.shiftright(at, 33), "_row": F.expr("monotonically_increasing_id() & 8589934591")}), label)
    parts = (kept.agg(F.max("_part")).first()[0] or 0) + 1
    return kept.withColumn("id", F.col("_row") * parts + F.col("_part") + 1).drop("_part", "_row")


def frequent_words(corpus: DataFrame, min_count: int) -> tuple[DataFrame, DataFrame]:
    """(id, lang, word, f) of frequent words, and R1."""
    each = corpus.select("g", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("code", "w"))
    each = each.select("g", "lang", "code", F.col("w.words").alias("word"), F.col("w.counts").alias("c"))
    found = numbered(each.groupBy("lang", "word").agg(F.sum("c").alias("f")).where(F.col("f") >= min_count), "phrases-words")
    told = each.join(found.select("lang", "word", "id"), ["lang", "word"]).select(F.col("g").alias("h"), "code", "id")

    def place(key: tuple, block: pa.Table, told: pa.Table) -> pa.Table:
        codes = unpacked(block.column("codes")[0].as_py())
        ids = np.zeros(codes.max(initial=0) + 1, np.int64)
        ids[told.column("code").to_numpy() + 1] = told.column("id").to_numpy()
        found = ids[codes]
        at = np.flatnonzero(found)
        return pa.table({"g": [key[0].as_py()], "at": [packed(steps(at))], "id": [packed(found[at])]})

    placed = corpus.select("g", "codes").groupBy("g").cogroup(told.groupBy("h")).applyInArrow(place, _PLACED)
    return found, keep(placed, "phrases-r1")


def neighbours(at: bytes, ids: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge join at neighbouring places: places, and the phrases there and one further."""
    at, ids = np.cumsum(unpacked(at)), unpacked(ids)
    i = np.flatnonzero(at[1:] == at[:-1] + 1)
    return at[i], ids[i], ids[i + 1]


def by_pair(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the pairs, and where each run of equal pairs begins in it."""
    if max(left.max(initial=0), right.max(initial=0)) < 1 << 32:
        order = np.argsort(left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64), kind="stable")
    else:
        order = np.lexsort((right, left))
    p, q = left[order], right[order]
    return order, np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (q[1:] != q[:-1])])) if len(p) else np.empty(0, np.int64)


def bucket_of(left: np.ndarray, right: np.ndarray, count: int) -> np.ndarray:
    h = left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + right.astype(np.uint64)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return ((h >> np.uint64(32)) % np.uint64(count)).astype(np.int64)


class Pairs:
    """The distinct pairs of a block, bucket by bucket."""

    def __init__(self, at: bytes, ids: bytes, buckets: int):
        self.at, left, right = neighbours(at, ids)
        self.order, first = by_pair(left, right)
        self.runs = np.diff(np.append(first, len(left)))
        first = self.order[first]
        self.left, self.right = left[first], right[first]
        bucket = bucket_of(self.left, self.right, buckets)
        self.dealt = np.argsort(bucket, kind="stable")
        self.edge = np.searchsorted(bucket[self.dealt], np.arange(buckets + 1))

    def asked(self) -> Iterator[tuple[int, bytes, bytes, bytes]]:
        for k in np.flatnonzero(np.diff(self.edge)):
            some = self.dealt[self.edge[k] : self.edge[k + 1]]
            yield int(k), packed(self.left[some]), packed(self.right[some]), packed(self.runs[some])

    def kept(self, answers: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Places and numbers of the occurrences whose pair is frequent."""
        number = np.zeros(len(self.left), np.int64)
        for k, ids in answers:
            number[self.dealt[self.edge[k] : self.edge[k + 1]]] = unpacked(ids)
        each = np.empty(len(self.at), np.int64)
        each[self.order] = np.repeat(number, self.runs)
        live = np.flatnonzero(each)
        return self.at[live], each[live]


_ASKED = pa.schema([("bucket", pa.int64()), ("g", pa.int64()), ("p", pa.binary()), ("q", pa.binary()), ("c", pa.binary())])
_TOLD = pa.schema([("bucket", pa.int64()), ("g", pa.int64()), ("ids", pa.binary()), ("p", pa.binary()), ("q", pa.binary()), ("c", pa.binary())])


def longer(placed: DataFrame, buckets: int, min_count: int, label: str) -> tuple[DataFrame, DataFrame]:
    """(id, p, q, f) of the frequent phrases one word longer, p and q their first and last words but one; and R(k + 1)."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, at, ids in zip(*(batch.column(c).to_pylist() for c in ("g", "at", "id"))):
                rows = list(Pairs(at, ids, buckets).asked())
                yield pa.RecordBatch.from_pydict({"bucket": [r[0] for r in rows], "g": [g] * len(rows), **{c: [r[i] for r in rows] for i, c in ((1, "p"), (2, "q"), (3, "c"))}}, _ASKED)

    def add(key: tuple, rows: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        p, q, c = ([unpacked(x) for x in rows.column(n).to_pylist()] for n in ("p", "q", "c"))
        ends = np.cumsum([len(x) for x in p])
        left, right, count = np.concatenate(p), np.concatenate(q), np.concatenate(c)
        order, first = by_pair(left, right)
        total = np.add.reduceat(count[order], first)
        live = total >= min_count
        number = np.where(live, np.cumsum(live), 0)
        ids = np.where(number > 0, (number - 1) * buckets + bucket + 1, 0)
        each = np.empty(len(left), np.int64)
        each[order] = np.repeat(ids, np.diff(np.append(first, len(left))))
        out = {n: rows.column(n).to_pylist() for n in ("bucket", "g")}
        told = [packed(x) for x in np.split(each, ends[:-1])]
        at = order[first[live]]
        none = [None] * len(told)
        return pa.table({"bucket": [*out["bucket"], bucket], "g": [*out["g"], -1], "ids": [*told, packed(ids[live])], "p": [*none, packed(left[at])], "q": [*none, packed(right[at])], "c": [*none, packed(total[live])]}, _TOLD)

    def place(key: tuple, block: pa.Table, told: pa.Table) -> pa.Table:
        at, ids = np.empty(0, np.int64), np.empty(0, np.int64)
        if block.num_rows and told.num_rows:
            pairs = Pairs(block.column("at")[0].as_py(), block.column("id")[0].as_py(), buckets)
            at, ids = pairs.kept(list(zip(told.column("bucket").to_pylist(), told.column("ids").to_pylist())))
        pa.default_memory_pool().release_unused()
        return pa.table({"g": [key[0].as_py()], "at": [packed(steps(at))], "id": [packed(ids)]})

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("ids", "p", "q", "c"))):
                yield pa.RecordBatch.from_arrays([pa.array(unpacked(x)) for x in row], names=["id", "p", "q", "f"])

    asked = placed.mapInArrow(ask, "bucket long, g long, p binary, q binary, c binary")
    told = keep(asked.groupBy("bucket").applyInArrow(add, "bucket long, g long, ids binary, p binary, q binary, c binary"), f"{label}-told")
    found = told.where("g = -1").select("ids", "p", "q", "c").mapInArrow(spell, "id long, p long, q long, f long")
    answers = told.where("g >= 0").select("g", "bucket", "ids")
    rest = placed.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(place, _PLACED)
    return keep(found, f"{label}-found"), keep(rest, f"{label}-placed")


def mine(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n) and, for each length from 1, the frequent phrases: (id, lang, word, f), then (id, p, q, f)."""
    corpus = keep(blocks(docs, block_bytes), "phrases-corpus")
    sizes = corpus.groupBy("lang").agg(F.sum("n").alias("n"))
    total = corpus.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_TOKENS))
    words, placed = frequent_words(corpus, min_count)
    found = [words]
    for k in range(2, longest + 1):
        table, placed = longer(placed, buckets, min_count, f"phrases-r{k}")
        found.append(table)
    return sizes, found


def named(table: DataFrame, *names: tuple[str, str]) -> DataFrame:
    return table.select(*[F.col(a).alias(b) for a, b in names])


def scored(found: list[DataFrame]) -> DataFrame:
    """(w1..w4, a, l, r, score) of all candidates: the lowest cut, ties to the earliest; covered ones are gone."""
    c1, c2, c3, c4 = found
    one = c1.select("id", "f")
    f1 = lambda key, out: named(one, ("id", key), ("f", out))
    two = c2.join(f1("p", "fp"), "p").join(f1("q", "fq"), "q")
    two = keep(two.select("id", "p", "q", F.col("f").alias("a"), "fp", "fq"), "phrases-c2")
    # phrases by their words; the cut after k words gives the counts of both parts
    t2 = lambda key, tag: two.select(F.col("id").alias(key), *[F.col(c).alias(f"{c}_{tag}") for c in ("p", "q", "a", "fp", "fq")])
    three = c3.withColumnRenamed("f", "a").join(t2("p", "x"), "p").join(t2("q", "y"), "q")
    three = keep(three.select(
        "id", "p", "q", "a", F.col("p_x").alias("w1"), F.col("q_x").alias("w2"), F.col("q_y").alias("w3"),
        F.col("fp_x").alias("f_first"), F.col("a_x").alias("f_head"), F.col("a_y").alias("f_tail"), F.col("fq_y").alias("f_last"),
        F.col("p").alias("head"), F.col("q").alias("tail"),
    ), "phrases-c3")
    t3 = lambda key, tag: three.select(F.col("id").alias(key), *[F.col(c).alias(f"{c}_{tag}") for c in three.columns if c not in ("id", "p", "q")])
    four = c4.withColumnRenamed("f", "a").join(t3("p", "x"), "p").join(t3("q", "y"), "q")
    four = keep(four.select(
        "id", "p", "q", "a", F.col("w1_x").alias("w1"), F.col("w2_x").alias("w2"), F.col("w3_x").alias("w3"), F.col("w3_y").alias("w4"),
        F.col("f_first_x").alias("f_first"), F.col("a_y").alias("f_rest"), F.col("f_head_x").alias("f_head"), F.col("f_tail_y").alias("f_tail"),
        F.col("a_x").alias("f_most"), F.col("f_last_y").alias("f_last"), F.col("head_x").alias("two_1"), F.col("tail_x").alias("two_2"), F.col("tail_y").alias("two_3"),
    ), "phrases-c4")

    none = F.lit(None).cast("long")
    cuts2 = two.select("id", F.lit(2).alias("k"), F.col("p").alias("w1"), F.col("q").alias("w2"), none.alias("w3"), none.alias("w4"), "a", _lowest(("fp", "fq")))
    cuts3 = three.select("id", F.lit(3).alias("k"), "w1", "w2", "w3", none.alias("w4"), "a", _lowest(("f_first", "f_tail"), ("f_head", "f_last")))
    cuts4 = four.select("id", F.lit(4).alias("k"), "w1", "w2", "w3", "w4", "a", _lowest(("f_first", "f_rest"), ("f_head", "f_tail"), ("f_most", "f_last")))
    every = cuts2.unionByName(cuts3).unionByName(cuts4)

    inside = [(three, 2, ["p", "q"]), (four, 3, ["p", "q"]), (four, 2, ["two_1", "two_2", "two_3"])]
    parts = None
    for table, k, keys in inside:
        some = table.select(F.lit(k).alias("k"), F.explode(F.array(*keys)).alias("id"), F.col("a").alias("longer"))
        parts = some if parts is None else parts.unionByName(some)
    over = parts.groupBy("k", "id").agg(F.max("longer").alias("longer"))
    left = every.join(over, ["k", "id"], "left").where(f"longer IS NULL OR 100 * longer < {COVERED} * a")
    return left.select("w1", "w2", "w3", "w4", "a", "cut.l", "cut.r", "cut.score")


def _lowest(*cuts: tuple[str, str]):
    """The cut of lowest score, ties to the first, as struct (score, at, l, r)."""
    each = [
        F.struct(F.expr(f"cast({FACTOR} as decimal(10, 0)) * cast(a as decimal(20, 0)) div cast({l} + {r} as decimal(20, 0))").alias("score"), F.lit(i).alias("at"), F.col(l).alias("l"), F.col(r).alias("r"))
        for i, (l, r) in enumerate(cuts)
    ]
    return (F.least(*each) if len(each) > 1 else each[0]).alias("cut")


def collocations(docs: DataFrame, top: int = TOP, min_count: int = MIN_COUNT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of two to four words of each language."""
    sizes, found = mine(docs, min_count, LONGEST, block_bytes)
    words = found[0].select("id", "lang", "word")
    rows = scored(found)
    for i in range(1, LONGEST + 1):
        some = words.select(F.col("id").alias(f"w{i}"), F.col("word").alias(f"t{i}"), *([F.col("lang")] if i == 1 else []))
        rows = rows.join(some, f"w{i}", "inner" if i < 3 else "left")
    rows = rows.withColumn("phrase", F.concat_ws(" ", *[f"t{i}" for i in range(1, LONGEST + 1)]))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    rows = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).join(sizes, "lang")
    return rows.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang,
             string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents),
p AS (SELECT lang, regexp_extract_all(x, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(ps) AS x FROM d)),
s AS (SELECT lang, sum(len(w)) AS n FROM p GROUP BY lang),
g AS (SELECT lang, k, w[i : i + k - 1] AS ws FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, k, ws, count(*) AS f FROM g GROUP BY lang, k, ws HAVING count(*) >= 30),
c AS (SELECT lang, k, ws, f AS a FROM f WHERE k > 1),
u AS (SELECT c.lang, c.k, c.ws, a, j, x.f AS l, y.f AS r, CAST((2000000::HUGEINT * a) // (x.f + y.f)::HUGEINT AS BIGINT) AS score
      FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c
      JOIN f x ON x.lang = c.lang AND x.k = j AND x.ws = c.ws[1 : j] JOIN f y ON y.lang = c.lang AND y.k = c.k - j AND y.ws = c.ws[j + 1 : c.k]),
m AS (SELECT *, row_number() OVER (PARTITION BY lang, ws ORDER BY score, j) AS o FROM u),
h AS (SELECT lang, ws[i : i + b - 1] AS ws, max(a) AS longer FROM (SELECT *, unnest(range(1, k - b + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS b FROM c)) GROUP BY ALL),
z AS (SELECT m.lang, array_to_string(m.ws, ' ') AS phrase, a, l, r, score FROM m LEFT JOIN h ON h.lang = m.lang AND h.ws = m.ws WHERE o = 1 AND (longer IS NULL OR 100 * longer < 80 * a)),
t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM z)
SELECT t.lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, score FROM t JOIN s ON s.lang = t.lang WHERE rank <= 2000
"""
