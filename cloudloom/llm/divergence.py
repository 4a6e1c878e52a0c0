"""Source divergence audit: how far the term shares of each source lie from those of the other sources of its language.

Equal texts of a language are first collapsed to one row with the number of copies in each source. Each distinct text
is tokenised once; its counts are added as often as it occurs, to the document frequency and the count of every source
that holds it. Sources are then compared over sparse rows only: a term that neither source uses adds the same amount,
so such terms are multiplied out, terms of one source come from sums over its distinct shares, and only terms that
both use are met term by term.

With p0 the share of an unused term, the distance of sources a and b over V kept terms is

    V |p0a - p0b|  +  H_a(p0b)  +  H_b(p0a)  +  sum over terms of both ( |pa - pb| - |pa - p0b| - |pb - p0a| + |p0a - p0b| )

    H_a(x) = sum over terms of a ( |pa - x| - |p0a - x| ) = sum (p0a - pa) + 2 sum over pa > x (pa - x)   for x > p0a,
             sum (pa - p0a)   for x <= p0a.

What grows: the counts with the vocabulary of each source, the pairs with the square of the number of sources of a
language, as the result itself does; nothing grows with the number of copies of a text. All numbers are exact:
products pass through 38 digits, shares and distances fit 64 bits.

Defined results: null text, lang and source count as empty strings; a source without kept terms has the share of
unused terms for all; a language without kept terms has distances of nought and no term rows; a source alone in its
language has no pair rows; repeated rows count as often as they stand; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloudloom.llm.common import keep, slices, texts_of
from cloudloom.llm.terms import encode

MIN_DOCS = 30
SMOOTH = 5
SCALE = 1_000_000_000
TOP_TERMS = 50
BATCH_BYTES = 6_000_000
#: Letters of the alphabet in lower case and all of UTF-8 beyond ASCII; anything else parts terms.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))
_COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("df", pa.int64()), ("cnt", pa.int64())])


def collapse(docs: DataFrame) -> DataFrame:
    """(lang, text, sources): each distinct text of a language once, with (source, copies) of every source that has it.

    Copies are first counted inside each Arrow batch, then in the map-side half of the aggregation, so a text that a
    third of all rows repeat travels once a task; ``sources`` has at most one entry a source and batch.
    """
    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = ["lang", "source", "text"]
            count = Counter(zip(*(batch.column(n).to_pylist() for n in names)))
            columns = [pa.array(c, pa.string()) for c in zip(*count)] or [pa.array([], pa.string())] * 3
            yield pa.RecordBatch.from_arrays([*columns, pa.array(list(count.values()), pa.int64())], names=[*names, "copies"])

    held = read.mapInArrow(fold, "lang string, source string, text string, copies long")
    return held.groupBy("lang", "text").agg(F.collect_list(F.struct("source", "copies")).alias("sources"))


def _spread(texts: Sequence[bytes], sources: pa.ListArray) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """Terms, source names, and for each (term, source) their indexes, documents and occurrences."""
    codes, terms, lens = encode(texts, _LETTERS)
    if not len(codes):
        return None
    doc = np.repeat(np.arange(len(texts)), lens)
    cell, tf = np.unique(codes * len(texts) + doc, return_counts=True)
    term, doc = cell // len(texts), cell % len(texts)
    flat = sources.flatten()
    named = flat.field("source").dictionary_encode()
    name, copies = named.indices.to_numpy(), flat.field("copies").to_numpy()
    begin = np.concatenate([[0], np.cumsum(np.fromiter(map(len, sources), np.int64, len(sources)))])
    n = np.diff(begin)[doc]
    at = np.repeat(begin[doc] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    key = np.repeat(term, n) * len(named.dictionary) + name[at]
    found, back = np.unique(key, return_inverse=True)
    df, cnt = np.zeros(len(found), np.int64), np.zeros(len(found), np.int64)
    np.add.at(df, back, copies[at])
    np.add.at(cnt, back, copies[at] * np.repeat(tf, n))
    return terms, named.dictionary, found // len(named.dictionary), found % len(named.dictionary), df, cnt


def count_terms(texts: DataFrame, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(lang, source, term, df, cnt) of collapsed texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, batch_bytes):
            langs = batch.column("lang").dictionary_encode()
            of = langs.indices.to_numpy()
            for i, lang in enumerate(langs.dictionary.to_pylist()):
                part = batch.take(pa.array(np.flatnonzero(of == i)))
                got = _spread(texts_of(part), part.column("sources"))
                if got:
                    terms, names, t, s, df, cnt = got
                    cols = [pa.array([lang] * len(t), pa.string()), names.take(pa.array(s)), terms.take(pa.array(t)), pa.array(df), pa.array(cnt)]
                    for at in range(0, len(t), 200_000):
                        yield pa.RecordBatch.from_arrays([c.slice(at, 200_000) for c in cols], schema=_COUNTED)

    found = texts.mapInArrow(run, "lang string, source string, term string, df long, cnt long")
    return found.groupBy("lang", "source", "term").agg(F.sum("df").alias("df"), F.sum("cnt").alias("cnt"))


def shares(docs: DataFrame, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables: kept terms (lang, term, q), groups (lang, source, v, p0) and their terms (lang, source, term, p, p0).

    ``q`` is the language's own share of the term.
    """
    counts = keep(count_terms(collapse(docs)), "divergence-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("cnt").alias("all")).where(F.col("df") >= min_docs).drop("df")
    kept = keep(kept, "divergence-kept")
    size = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all").alias("n_lang"))
    used = keep(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "cnt"), "divergence-used")
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    groups = groups.join(used.groupBy("lang", "source").agg(F.sum("cnt").alias("n")), ["lang", "source"], "left").join(size, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("n", F.lit(0)).alias("n"))
    groups = keep(groups.withColumn("p0", share("0")), "divergence-groups")
    terms = kept.join(size, "lang").withColumns({"cnt": F.col("all"), "n": F.col("n_lang")}).select("lang", "term", share("cnt").alias("q"))
    rows = used.join(groups, ["lang", "source"]).select("lang", "source", "term", share("cnt").alias("p"), "p0")
    return terms, groups, keep(rows, "divergence-shares")


def share(cnt: str):
    """1 + floor(SCALE * (cnt + SMOOTH) / (n + SMOOTH * v)), the product in 38 digits; 0 without kept terms."""
    top = f"cast({SCALE} as decimal(10, 0)) * cast({cnt} + {SMOOTH} as decimal(20, 0))"
    return F.expr(f"if(v = 0, 0L, 1L + ({top}) div cast(n + {SMOOTH} * v as decimal(20, 0)))")


def pair_values(groups: DataFrame, rows: DataFrame) -> DataFrame:
    """(lang, source, item, value): the distance of every two sources of a language, once each way."""
    g = groups.select("lang", "source", "v", "p0")
    other = g.select("lang", F.col("source").alias("item"), F.col("p0").alias("x"))
    pairs = g.join(other, "lang").where("source <> item")
    own = [F.col("lang"), F.col("source")]
    # H_source(x): the distinct shares of a source, and the x it is asked at, in one descending order
    held = rows.groupBy(*own, F.col("p").alias("x")).agg(F.count("*").alias("m"), F.lit(None).cast("string").alias("item"))
    asked = pairs.select(*own, "x", F.lit(0).cast("long").alias("m"), "item")
    above = Window.partitionBy(*own).orderBy(F.desc("x")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    line = held.unionByName(asked).withColumns({"n_above": F.sum("m").over(above), "s_above": F.sum(F.col("m") * F.col("x")).over(above)})
    total = rows.groupBy(*own).agg(F.sum(F.col("p") - F.col("p0")).alias("extra"))
    base = line.where("item IS NOT NULL").join(g.select(*own, "p0", "v"), ["lang", "source"]).join(total, ["lang", "source"], "left")
    extra, bend = F.coalesce("extra", F.lit(0)), 2 * (F.col("s_above") - F.col("n_above") * F.col("x"))
    base = base.select(*own, "item", "v", F.abs(F.col("p0") - F.col("x")).alias("gap"), F.when(F.col("x") <= F.col("p0"), extra).otherwise(bend - extra).alias("h"))
    # each unordered pair: both halves of H; the terms that both use are met once
    low, high = F.least("source", "item").alias("a"), F.greatest("source", "item").alias("b")
    apart = base.groupBy("lang", low, high).agg(F.sum("h").alias("h"), F.max(F.col("v") * F.col("gap")).alias("flat"))
    left = rows.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("p0").alias("za"))
    right = rows.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"), F.col("p0").alias("zb"))
    mend = F.expr("abs(pa - pb) - abs(pa - zb) - abs(pb - za) + abs(za - zb)")
    both = left.join(right, ["lang", "term"]).where("a < b").groupBy("lang", "a", "b").agg(F.sum(mend).alias("both"))
    found = apart.join(both, ["lang", "a", "b"], "left").withColumn("value", F.col("flat") + F.col("h") + F.coalesce("both", F.lit(0)))
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return found.select("lang", ways.alias("w"), "value").select("lang", "w.source", "w.item", "value")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): parts ``pair`` (all other sources) and ``term`` (the ``top_terms`` first)."""
    terms, groups, rows = shares(docs, min_docs)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair = pair_values(groups, rows).withColumn("rank", F.row_number().over(order))
    more = rows.join(terms, ["lang", "term"]).where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    term = more.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_terms)
    cols = ["lang", "source", "part", "item", "value", "rank"]
    return pair.withColumn("part", F.lit("pair")).select(*cols).unionByName(term.withColumn("part", F.lit("term")).select(*cols))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
c AS (SELECT t.lang, source, t.term, count(*) AS c FROM t JOIN k ON t.lang = k.lang AND t.term = k.term GROUP BY ALL),
g AS (SELECT DISTINCT d.lang, d.source, coalesce(v, 0) AS v FROM d LEFT JOIN v ON d.lang = v.lang),
m AS (SELECT g.lang, g.source, v, coalesce(sum(c), 0) AS n FROM g LEFT JOIN c ON g.lang = c.lang AND g.source = c.source GROUP BY g.lang, g.source, v),
p AS (SELECT m.lang, m.source, k.term, coalesce(c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c, 0) + 5)) // (m.n + 5 * v)::HUGEINT AS p
      FROM m JOIN k ON m.lang = k.lang LEFT JOIN c ON c.lang = m.lang AND c.source = m.source AND c.term = k.term),
q AS (SELECT k.lang, term, 1 + (1000000000::HUGEINT * (k.n + 5)) // (v.n + 5 * v)::HUGEINT AS q FROM k JOIN v ON k.lang = v.lang),
x AS (SELECT a.lang, a.source, b.source AS item, CAST(sum(abs(a.p - b.p)) AS BIGINT) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
o AS (SELECT a.lang, a.source, b.source AS item FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
f AS (SELECT o.lang, o.source, 'pair' AS part, o.item, coalesce(value, 0) AS value FROM o LEFT JOIN x ON o.lang = x.lang AND o.source = x.source AND o.item = x.item
      UNION ALL
      SELECT p.lang, p.source, 'term', p.term, CAST(p - q AS BIGINT) FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE c > 0 AND p > q)
SELECT * FROM (SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM f)
WHERE part = 'pair' OR rank <= 50
"""
