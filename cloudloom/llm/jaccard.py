"""N-gram Jaccard join by T-occurrence search (DivideSkip), and the groups that its links form.

1. Documents of equal shingle sets are one class, named by its smallest id.
2. Each shingle's number of classes is counted; a class keeps the shingles that another class has too. Ordered by
   rarity, two linked sets must share one of their first n - ceil(n * share) + 1 shingles; classes whose first ones are
   all their own have no link and leave here.
3. Classes tied by such a rare shingle form families (connected components over ties to each shingle's smallest id).
4. Inside a family, in blocks of at most ``BLOCK`` sets, each set is a query: of the inverted lists of its shingles the
   L longest are set aside, the short ones are merged, ids met T - L times are candidates, and they are probed in the
   long lists by binary search. T is the overlap that any linked set must reach. What is already connected needs no
   further link, so a block first links sets to leaders, and then only sets outside the largest component ask.
5. Large families of several blocks: leaders of the blocks' components meet next. At last, for each rare shingle that
   several components have, every set outside the shingle's largest component asks the blocks of the shingle's other
   sets; linked sets share such a shingle, so no link between components is missed. The sets that a block and a turn of
   queries need are copied, and bins are sized by the copies. No pairs of a group are spelt out, and all steps are
   exact on 64-bit shingle hashes.

Defined results: null and wordless texts have an empty set and are linked with nothing; fewer words than a shingle's are
one shingle; a null id has no links and a null component; rows of equal id are one node; an empty table gives no row.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudloom.llm.common import batch_of, group_count, keep, slices, texts_of
from cloudloom.llm.exchange import Groups, answered, below, bounds, firsts, told_in_order
from cloudloom.llm.fingerprints import shingles
from cloudloom.llm.text import U, distinct, mix
from cloudloom.operators.graph import components

SHINGLE = 4
SHARE = 85  # hundredths of the union
BLOCK = 1_000
MU = 0.0085  # weight of the logarithm when the number of long lists is chosen
BIN_BYTES = 4_000_000
#: Text bytes a group of documents aims at.
GROUP_BYTES = 6_000_000
SALTS = 16


def least_overlap(n: int, share: float = SHARE) -> int:
    return int(-(-share * n // 100))


def linked(both: int, n: int, m: int, share: float = SHARE) -> bool:
    return both > 0 and 100 * both >= share * (n + m - both)


def sets(texts: list[bytes], size: int = SHINGLE) -> list[np.ndarray]:
    h, first = shingles(texts, size, lower=True)
    return [distinct(h[first[i] : first[i + 1]]) for i in range(len(texts))]


def signature(s: np.ndarray) -> bytes:
    """128 bits of a set."""
    return np.array([s.sum(dtype=U), mix(s ^ U(0x9E3779B97F4A7C15)).sum(dtype=U)], U).tobytes()


_CLASSES = pa.schema([("g", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("sig", pa.binary())])


def classify(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4_000_000):
            own = sets(texts_of(batch), size)
            yield batch_of({"g": batch.column("g"), "doc_id": batch.column("doc_id"), "n": [len(s) for s in own], "sig": [signature(s) if len(s) else None for s in own]}, _CLASSES)

    return run


def representatives(ids: list, texts: list[bytes], told: pa.Table, size: int) -> tuple[list[int], list[np.ndarray]]:
    """Ids and sets of the group's rows that stand for their class."""
    named = set(zip(told.column("a").to_pylist(), told.column("b").to_pylist()))
    out_ids, out_sets = [], []
    wanted = {int.from_bytes(b, "little", signed=True) for _, b in named}
    some = [i for i, d in enumerate(ids) if d is not None and d in wanted]
    for i, s in zip(some, sets([texts[i] for i in some], size)):
        key = (signature(s), int(ids[i]).to_bytes(8, "little", signed=True))
        if len(s) and key in named:
            named.discard(key)
            out_ids.append(ids[i])
            out_sets.append(s)
    return out_ids, out_sets


class Counted:
    """The distinct shingles of a group's representatives in order."""

    def __init__(self, own: list[np.ndarray]):
        h = np.concatenate([np.empty(0, U), *own])
        self.order = np.argsort(h)
        h = h[self.order]
        self.first = firsts(h)
        self.h = h[self.first]
        self.n = np.diff(np.append(self.first, len(h)))


def ask_counts(bits: int, size: int):
    def work(ids: list, texts: list[bytes], g: int, told: pa.Table) -> Iterator[tuple[int, bytes, bytes]]:
        c = Counted(representatives(ids, texts, told, size)[1])
        if not len(c.h):
            return
        v = (below(c.h, bits, 31) << U(1) | (c.n > 1).astype(U)).astype("<u4")
        n = np.minimum(c.n, 255).astype(np.uint8)
        edge = bounds(c.h, bits)
        for k in np.flatnonzero(np.diff(edge)):
            some = slice(edge[k], edge[k + 1])
            yield int(k), v[some].tobytes(), n[some][n[some] > 1].tobytes()

    return work


def answer_counts(bucket: int, groups: list[int], a: list[bytes], b: list[bytes]) -> list[tuple[bytes, bytes]]:
    """Which shingles several classes have, and in how many (255: or more)."""
    each = [np.frombuffer(x, "<u4") for x in a]
    v = np.concatenate(each)
    n = np.ones(len(v), np.int64)
    n[v & 1 > 0] = np.frombuffer(b"".join(b), np.uint8)
    order = np.argsort(v >> np.uint32(1), kind="stable")
    h = v[order] >> np.uint32(1)
    first = firsts(h)
    total = np.empty(len(v), np.int64)
    total[order] = np.repeat(np.add.reduceat(n[order], first), np.diff(np.append(first, len(h))))
    total = np.minimum(total, 255).astype(np.uint8)
    return [(np.packbits(t > 1).tobytes(), t[t > 1].tobytes()) for t in np.split(total, np.cumsum([len(x) for x in each])[:-1])]


_CANDIDATES = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("tokens", pa.binary()), ("prefix", pa.list_(pa.int64()))])
_CANDIDATES_DDL = "doc_id long, n int, tokens binary, prefix array<long>"


def candidates(bits: int, size: int):
    def work(ids: list, texts: list[bytes], g: int, told: pa.Table) -> pa.Table:
        answers = told.filter(pc.greater_equal(told.column("bucket"), 0))
        own_ids, own = representatives(ids, texts, told.filter(pc.less(told.column("bucket"), 0)), size)
        c = Counted(own)
        count = np.ones(len(c.h), np.int64)
        edge = bounds(c.h, bits)
        for k, flags, numbers in told_in_order(answers):
            live = np.unpackbits(np.frombuffer(flags, np.uint8), count=edge[k + 1] - edge[k]).view(bool)
            count[edge[k] : edge[k + 1]][live] = np.frombuffer(numbers, np.uint8)
        back = np.empty(len(c.order), np.int64)
        back[c.order] = np.repeat(count, c.n)
        rows: dict[str, list] = {"doc_id": [], "n": [], "tokens": [], "prefix": []}
        at = 0
        for i, s in zip(own_ids, own):
            n, df = len(s), back[at : at + len(s)]
            at += n
            alone = int((df == 1).sum())
            room = n - least_overlap(n) + 1 - alone
            if room <= 0:
                continue
            shared, df = s[df > 1], df[df > 1]
            if len(shared) < least_overlap(n):
                continue
            head = shared[np.lexsort((shared, df))[:room]]
            for name, value in zip(rows, (i, n, shared.tobytes(), head.view(np.int64))):
                rows[name].append(value)
        return pa.table(rows, _CANDIDATES)

    return work


class Leaders:
    """A growing inverted index of few sets, searched by DivideSkip on plain lists."""

    def __init__(self, share: float = SHARE):
        self.share = share
        self.lists: dict[int, list[int]] = {}
        self.size: list[int] = []

    def add(self, tokens: list[int], n: int) -> int:
        k = len(self.size)
        self.size.append(n)
        for t in tokens:
            self.lists.setdefault(t, []).append(k)
        return k

    def search(self, tokens: list[int], n: int) -> Iterator[int]:
        found = [self.lists[t] for t in tokens if t in self.lists]
        need = least_overlap(n, self.share)
        if len(found) < need:
            return
        found.sort(key=len)
        long = min(need - 1, int(need / (MU * math.log2(len(found[-1]) + 1) + 1)))
        short, probes = found[: len(found) - long], found[len(found) - long :]
        last, count = -1, 0
        for k in heapq.merge(*short, [len(self.size)]):
            if k == last:
                count += 1
                continue
            if count >= need - long and self._reaches(last, count, probes, n):
                yield last
            last, count = k, 1

    def _reaches(self, k: int, count: int, probes: list[list[int]], n: int) -> bool:
        if k < 0:
            return False
        for p in probes:
            i = bisect_left(p, k)
            count += i < len(p) and p[i] == k
        return linked(count, n, self.size[k], self.share)


class Index:
    """The inverted lists of a whole block, searched by DivideSkip on arrays."""

    def __init__(self, tokens: list[np.ndarray], sizes: np.ndarray, share: float = SHARE):
        self.tokens, self.sizes, self.share = tokens, sizes, share
        h = np.concatenate([np.empty(0, U), *tokens])
        doc = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
        order = np.argsort(h, kind="stable")
        h, self.posts = h[order], doc[order]
        self.first = firsts(h)
        self.h = h[self.first]
        self.length = np.diff(np.append(self.first, len(h)))
        # (list, doc) as one rising number: a probe of a list is one binary search
        self.keys = np.repeat(np.arange(len(self.h)), self.length) * len(tokens) + self.posts

    def search(self, tokens: np.ndarray, n: int, open_: np.ndarray) -> np.ndarray:
        """The block's sets linked with the query among those that ``open_`` marks."""
        at = np.searchsorted(self.h, tokens)
        inside = at < len(self.h)
        lists = at[inside][self.h[at[inside]] == tokens[inside]]
        need = least_overlap(n, self.share)
        if len(lists) < need:
            return np.empty(0, np.int64)
        lists = lists[np.argsort(self.length[lists], kind="stable")]
        long = min(need - 1, int(need / (MU * math.log2(self.length[lists[-1]] + 1) + 1)))
        short, probes = lists[: len(lists) - long], lists[len(lists) - long :]
        merged = np.sort(np.concatenate([self.posts[self.first[k] : self.first[k] + self.length[k]] for k in short]))
        start = firsts(merged)
        met, count = merged[start], np.diff(np.append(start, len(merged)))
        m = self.sizes[met]
        ok = open_[met] & (count >= need - long) & (100 * np.minimum(m, n) >= self.share * np.maximum(m, n))
        met, count = met[ok], count[ok]
        if not len(met):
            return met
        want = probes[:, None] * len(self.tokens) + met[None, :]
        spot = np.searchsorted(self.keys, want)
        spot[spot == len(self.keys)] = 0
        both = count + (self.keys[spot] == want).sum(0)
        return met[100 * both >= self.share * (n + self.sizes[met] - both)]


class Union:
    def __init__(self, labels: np.ndarray):
        self.root = {int(x): int(x) for x in np.unique(labels)}

    def find(self, x: int) -> int:
        while self.root[x] != x:
            self.root[x] = self.root[self.root[x]]
            x = self.root[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.root[max(a, b)] = min(a, b)
        return a != b


def link_block(ids: np.ndarray, sizes: np.ndarray, tokens: list[np.ndarray], share: float = SHARE) -> list[tuple[int, int]]:
    """Links that connect what is connected inside one block."""
    links: list[tuple[int, int]] = []
    union, leaders, who = Union(np.arange(len(ids))), Leaders(share), []
    for q in np.argsort(-sizes, kind="stable").tolist():
        own = tokens[q].tolist()
        hits = list(leaders.search(own, int(sizes[q])))
        for k in hits:
            if union.join(q, who[k]):
                links.append((q, who[k]))
        if not hits:
            leaders.add(own, int(sizes[q]))
            who.append(q)
    label = np.array([union.find(i) for i in range(len(ids))])
    names, counts = np.unique(label, return_counts=True)
    if len(names) > 1:
        top = names[np.argmax(counts)]
        links += _ask_rest(Index(tokens, sizes, share), np.flatnonzero(label != top), np.arange(len(ids)), union, tokens, sizes)
    return [(int(ids[a]), int(ids[b])) for a, b in links]


def _ask_rest(index: Index, queries: np.ndarray, names: np.ndarray, union: Union, tokens: list[np.ndarray], sizes: np.ndarray) -> list[tuple[int, int]]:
    links = []
    for q in queries.tolist():
        own = union.find(q)
        open_ = np.array([union.find(int(x)) != own for x in names])
        for k in index.search(tokens[q], int(sizes[q]), open_).tolist():
            if union.join(q, int(names[k])):
                links.append((q, int(names[k])))
    return links


_LINKS = pa.schema([("src", pa.int64()), ("dst", pa.int64())])


def _arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    return table.column("doc_id").to_numpy(), table.column("n").to_numpy().astype(np.int64), [np.frombuffer(t, U) for t in table.column("tokens").to_pylist()]


def _bins(table: pa.Table, names: list[str]) -> Iterator[pa.Table]:
    """A bin's parts, one for each value of the key columns."""
    table = table.sort_by([(n, "ascending") for n in [*names, "doc_id"]])
    key = np.zeros(table.num_rows, bool)
    key[:1] = True
    for n in names:
        c = table.column(n).to_numpy()
        key[1:] |= c[1:] != c[:-1]
    at = np.append(np.flatnonzero(key), table.num_rows)
    for a, b in zip(at, at[1:]):
        yield table.slice(a, b - a)


def link_bin(table: pa.Table, share: float = SHARE) -> pa.Table:
    links = [x for part in _bins(table, ["family", "block"]) for x in link_block(*_arrays(part), share)]
    return pa.table({"src": [x[0] for x in links], "dst": [x[1] for x in links]}, _LINKS)


def rest_bin(table: pa.Table, share: float = SHARE) -> pa.Table:
    """Queries (asks) against one block's sets, between components only."""
    out = []
    for part in _bins(table, ["t", "block", "turn"]):
        asks = part.column("asks").to_numpy(zero_copy_only=False)
        ids, sizes, tokens = _arrays(part)
        label = part.column("component").to_numpy().copy()
        base = np.flatnonzero(~asks)
        index = Index([tokens[i] for i in base], sizes[base], share)
        for q in np.flatnonzero(asks).tolist():
            for k in index.search(tokens[q], int(sizes[q]), label[base] != label[q]).tolist():
                if label[q] != label[base[k]]:
                    out.append((int(ids[q]), int(ids[base[k]])))
                    label[label == label[base[k]]] = label[q]
    return pa.table({"src": [x[0] for x in out], "dst": [x[1] for x in out]}, _LINKS)


def _in_blocks(sets_: DataFrame, block: int, bins: int, share: float) -> DataFrame:
    """Links found inside blocks of each family's sets (family, doc_id, n, tokens)."""
    counts = sets_.groupBy("family").agg(F.ceil(F.count("*") / block).alias("blocks"))
    dealt = sets_.join(counts, "family").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    dealt = dealt.withColumn("bin", F.pmod(F.xxhash64("family", "block"), F.lit(bins)))
    return dealt.select("bin", "family", "block", "doc_id", "n", "tokens").groupBy("bin").applyInArrow(lambda t: link_bin(t, share), "src long, dst long")


def _asking(labelled: DataFrame, block: int) -> DataFrame:
    """(t, block, turn, asks, doc_id): for each rare shingle t that several components have, its sets as base and those
    outside its largest component as queries. Shingles of the same sets are asked once."""
    at = labelled.select("doc_id", "component", F.explode("prefix").alias("t")).distinct()
    sums = [F.count("*").alias("c"), F.bit_xor(F.xxhash64("doc_id")).alias("x"), F.bit_xor(F.xxhash64("doc_id", F.lit(1))).alias("y")]
    per = at.groupBy("t", "component").agg(*sums)
    mixed = per.groupBy("t").agg(F.max(F.struct("c", "component")).alias("m"), F.sum("c").alias("all"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.count("*").alias("parts")).where("parts > 1")
    # equal members have equal components, so any of the shingles will do
    mixed = mixed.groupBy("all", "x", "y").agg(F.min(F.struct("t", "m")).alias("k"))
    mixed = mixed.select("k.t", F.col("k.m.component").alias("top"), F.ceil(F.col("all") / block).alias("blocks"), F.ceil((F.col("all") - F.col("k.m.c")) / block).alias("turns"))
    salted = mixed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = at.withColumn("salt", F.pmod(F.hash("doc_id"), F.lit(SALTS))).join(salted, ["t", "salt"])
    block_of, turn_of = F.pmod(F.xxhash64("doc_id"), F.col("blocks")), F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("turns"))
    base = rows.withColumn("block", block_of).withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1))).withColumn("asks", F.lit(False))
    asks = rows.where("component <> top").withColumn("turn", turn_of).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumn("asks", F.lit(True))
    names = ["t", "block", "turn", "asks", "doc_id"]
    return base.select(names).unionByName(asks.select(names))


def links(found: DataFrame, block: int = BLOCK, share: float = SHARE) -> DataFrame:
    """Links (src, dst) that connect every component of the candidate sets (doc_id, n, tokens, prefix)."""
    prefix = found.select("doc_id", F.explode("prefix").alias("t"))
    hubs = prefix.groupBy("t").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("far")).where("hub < far")
    ties = prefix.join(hubs, "t").where("doc_id <> hub").select(F.col("doc_id").alias("src"), F.col("hub").alias("dst")).distinct()
    nodes = found.select(F.col("doc_id").alias("node")).distinct()
    family = keep(components(nodes, keep(ties, "jaccard-ties")), "jaccard-families").select(F.col("node").alias("doc_id"), F.col("component").alias("family"))
    sizes = family.groupBy("family").agg(F.count("*").alias("members")).where("members > 1")
    family = family.join(sizes, "family")
    volume = found.agg(F.sum(F.octet_length("tokens")).alias("b")).first()["b"] or 0
    bins = group_count(volume, BIN_BYTES)
    of = found.select("doc_id", "n", "tokens").join(family.select("doc_id", "family"), "doc_id")
    first = keep(_in_blocks(of, block, bins, share), "jaccard-links")
    large = family.where(F.col("members") > block).select("doc_id", "family")
    if large.isEmpty():
        return first
    parts = keep(components(large.select(F.col("doc_id").alias("node")), first.join(large.select(F.col("doc_id").alias("src")), "src", "left_semi")), "jaccard-parts").withColumnRenamed("node", "doc_id")
    large = keep(found.select("doc_id", "n", "tokens", "prefix").join(large, "doc_id"), "jaccard-large")
    leaders = large.join(parts.where("doc_id = component").select("doc_id"), "doc_id", "left_semi")
    second = keep(first.unionByName(_in_blocks(leaders, block, bins, share)), "jaccard-links")
    parts = keep(components(parts.select(F.col("doc_id").alias("node")), second.join(parts.select(F.col("doc_id").alias("src")), "src", "left_semi")), "jaccard-parts").withColumnRenamed("node", "doc_id")
    labelled = keep(large.join(parts, "doc_id"), "jaccard-labelled")
    dealt = keep(_asking(labelled, block), "jaccard-asking")
    lengths = labelled.select("doc_id", F.octet_length("tokens").alias("b"))
    volume = dealt.groupBy("doc_id").agg(F.count("*").alias("c")).join(lengths, "doc_id").agg(F.sum(F.col("c") * F.col("b")).alias("b")).first()["b"] or 0
    both = dealt.join(labelled.select("doc_id", "n", "tokens", "component"), "doc_id")
    both = both.withColumn("bin", F.pmod(F.xxhash64("t", "block", "turn"), F.lit(group_count(volume, BIN_BYTES))))
    third = both.groupBy("bin").applyInArrow(lambda t: rest_bin(t, share), "src long, dst long")
    return keep(second.unionByName(third), "jaccard-links")


def group(docs: DataFrame, size: int = SHINGLE, block: int = BLOCK, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    groups = Groups(docs, group_bytes)
    rows = keep(groups.rows.mapInArrow(classify(size), "g long, doc_id long, n long, sig binary"), "jaccard-classes")
    # only repeated sets need a name from elsewhere; a salt spreads the copies of a hot set over the join's tasks
    filled = rows.where("doc_id IS NOT NULL AND sig IS NOT NULL")
    names = filled.groupBy("sig").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")).where("c > 1").drop("c")
    salted = names.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    named = rows.withColumn("salt", F.pmod(F.hash("doc_id"), F.lit(SALTS))).join(salted, ["sig", "salt"], "left").drop("salt")
    known = keep(named.withColumn("rep", F.when(F.col("sig").isNotNull() & F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id"))), "jaccard-named")
    stands = known.where("doc_id = rep").select("g", F.lit(-1).cast("long").alias("bucket"), F.col("sig").alias("a"), _le_bytes("doc_id").alias("b")).distinct()
    counts = answered(groups.ask(ask_counts(groups.bits, size), stands), answer_counts)
    found = keep(groups.each(candidates(groups.bits, size), _CANDIDATES_DDL, counts.unionByName(stands)), "jaccard-candidates")
    edges = links(found, block)
    # an id that occurs with several sets ties their classes
    several = known.where("rep IS NOT NULL").groupBy("doc_id").agg(F.min("rep").alias("m"), F.max("rep").alias("x")).where("m < x").select(F.col("doc_id").alias("d"), "m")
    edges = edges.unionByName(known.join(several, F.col("doc_id") == F.col("d")).where("rep <> m").select(F.col("rep").alias("src"), F.col("m").alias("dst")))
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    top = components(nodes, edges)
    out = known.join(top, known["rep"] == top["node"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id"))


def _le_bytes(name: str):
    """A long as 8 little-endian bytes."""
    digits = F.lpad(F.hex(F.col(name)), 16, "0")
    return F.unhex(F.concat(*[F.substring(digits, 15 - 2 * i, 2) for i in range(8)]))


SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, k FROM (SELECT r, array_to_string(w[i : i + 3], ' ') AS k FROM (SELECT r, w, unnest(range(1, greatest(2, len(w) - 2))) AS i FROM d WHERE len(w) > 0))),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
c AS (SELECT r, n, string_agg(k, '|' ORDER BY k) AS t FROM s JOIN n USING (r) GROUP BY r, n),
q AS (SELECT t, min(r) AS q, any_value(n) AS n FROM c GROUP BY t),
f AS (SELECT k, count(*) AS df FROM s JOIN q ON s.r = q.q GROUP BY k),
o AS (SELECT r, k, n, row_number() OVER (PARTITION BY r ORDER BY df, k) AS z FROM s JOIN q ON s.r = q.q JOIN f USING (k)),
p AS (SELECT r, k FROM o WHERE z <= n - (85 * n + 99) // 100 + 1),
cand AS (SELECT DISTINCT a.r AS x, b.r AS y FROM p a JOIN p b ON a.k = b.k AND a.r < b.r),
l AS (SELECT x, y FROM (SELECT x, y, count(*) AS met FROM cand JOIN s a ON a.r = x JOIN s b ON b.r = y AND a.k = b.k GROUP BY x, y) JOIN q u ON u.q = x JOIN q v ON v.q = y WHERE 100 * met >= 85 * (u.n + v.n - met)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l UNION SELECT r, q FROM c JOIN q USING (t) UNION SELECT q, r FROM c JOIN q USING (t)),
reach(a, b) AS (SELECT x, x FROM e UNION SELECT reach.a, e.y FROM reach JOIN e ON reach.b = e.x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(least(m, d.doc_id), d.doc_id) AS component_id
FROM d LEFT JOIN n USING (r) LEFT JOIN (SELECT a AS r, min(z.doc_id) AS m FROM reach JOIN d z ON z.r = b GROUP BY a) USING (r)
"""
