"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint of 8 bytes that differs from another in at most k bits shares at least 8 - k bytes with it at the same
positions. The index has a posting list for every combination of ``width`` positions and their bytes; two fingerprints with m bytes
in common meet in C(m, width) lists. How often each pair meets is tallied over all lists, pairs below the
guaranteed minimum C(8 - k, width) are dropped, and the rest are verified by their differing bits. (Lists of single bytes, ``width`` 1, each hold a
256th of all fingerprints, and so do not scale; the query takes 3.)

Equal fingerprints are one entry. A list beyond a fixed length does not write out its pairs: the shared bytes of its pairs are tallied where they
meet, pairs below the minimum are dropped, the rest verified, and a minimum spanning forest of the links is kept, which
connects what all of them would connect; lists beyond a further length are dealt out as pairs of blocks, whose forests together
hold one of the whole list. So no list is bound to one task and no group of copies is written out as all its pairs.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrydf.llm import common
from quarrydf.llm.components import components

#: Entries of a posting list that one task takes at once; longer lists are dealt out as pairs of blocks of half that.
LIST = 8192
#: Lists up to this long give their pairs to the tally over all lists; in longer ones pairs are tallied and verified in place.
SHORT = 12
#: Hashes whose bits are counted at once.
_HASHES = 1 << 16


def _mix(h: np.ndarray, stream: int) -> np.ndarray:
    """A further hash of each hash (the finaliser of splitmix64); stream 0 is the hash itself."""
    if not stream:
        return h
    with np.errstate(over="ignore"):
        z = h + np.uint64(stream * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def shingles(text: str, n: int) -> list[bytes]:
    """The space-joined runs of ``n`` words, repeats included; the whole sequence if there are fewer; none without words.
    A-Z are lower-cased, words are what ASCII white space separates."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if len(words) <= n:
        return [b" ".join(words)] if words else []
    return [b" ".join(x) for x in zip(*[words[i:] for i in range(n)])]


def fingerprint(text: str, n: int = 3, seed: int = 42) -> bytes:
    """64 bits, each set if it is set in over half of the shingles' hashes; all clear without words."""
    from xxhash import xxh64_intdigest

    parts = shingles(text, n)
    if not parts:
        return bytes(8)
    hashes = np.array([xxh64_intdigest(s, seed) for s in parts], np.uint64)
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _HASHES):
        bits = np.unpackbits(hashes[at : at + _HASHES].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        total += bits.sum(0, dtype=np.int64)
    return np.packbits(total * 2 > len(hashes)).tobytes()


def with_fingerprints(df: DataFrame, text: str = "text", n: int = 3, fp: str = "fp", node: str = "node") -> DataFrame:
    """``df`` with ``fp`` (binary, 8 bytes) and ``node`` (long): the fingerprint as a signed number.

    Null texts count as empty: the fingerprint is zero. Whole texts of any length; repeated rows get equal results, an empty table stays empty;
    columns of those names are replaced, all others stay.
    """
    common.ship(df.sparkSession)

    def run(texts: pa.Array) -> pa.Array:
        prints = [fingerprint(t.as_py() or "", n) for t in texts]
        nodes = np.frombuffer(b"".join(prints), ">i8").astype(np.int64)
        return pa.StructArray.from_arrays([pa.array(prints, pa.binary()), pa.array(nodes)], ["fp", "node"])

    held = common.fresh(df, "printed")
    keep = [F.col(f"`{c}`") for c in df.columns if c.lower() not in (fp.lower(), node.lower())]
    printed = df.withColumn(held, F.arrow_udf(run, "struct<fp: binary, node: long>")(F.col(f"`{text}`").cast("string")))
    return printed.select(*keep, F.col(f"{held}.fp").alias(fp), F.col(f"{held}.node").alias(node))


def _forest(prints: np.ndarray, limit: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """A minimum spanning forest of the links of at least ``least`` shared positional bytes and at most ``limit`` differing bits (Prim's
    method, one row at a time)."""
    n = len(prints)
    far = 1 << 20
    best, parent, inside = np.full(n, far, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
    at, a, b = 0, [], []
    for _ in range(n - 1):
        inside[at] = True
        apart = prints ^ prints[at]
        shared = (apart.view(np.uint8).reshape(n, 8) == 0).sum(1)
        bits = np.where(shared >= least, np.bitwise_count(apart).astype(np.int64), far)
        closer = (bits < best) & ~inside
        best[closer], parent[closer] = bits[closer], at
        best[at] = far + 1
        at = int(best.argmin())
        if best[at] <= limit:
            a.append(at)
            b.append(parent[at])
    return np.array(a, np.int64), np.array(b, np.int64)


def links(entries: DataFrame, limit: int, width: int = 3) -> DataFrame:
    """``u``, ``v`` (nodes): links of at most ``limit`` differing bits that connect what all such links connect.

    entries: distinct ``node``; read more than once, so it should be a written table. No link is missed: two fingerprints that differ in
    ``limit`` bits meet in C(8 - limit, width) lists; if any of these is long, that list's forest connects them, else the tally finds them.
    """
    least = 8 - limit
    if not 1 <= width <= least:
        raise ValueError("needs 1 <= width <= 8 - limit")
    meets, half = comb(least, width), LIST // 2
    sets = list(combinations(range(8), width))
    if len(sets) << 8 * width >= 1 << 63:
        raise ValueError("posting keys must fit a long")

    def post(batches):
        for batch in batches:
            nodes = batch.column(0).to_numpy(zero_copy_only=False)
            raw = nodes.astype(">i8").view(np.uint8).reshape(-1, 8)
            for k, chosen in enumerate(sets):
                key = np.full(len(nodes), k, np.int64)
                for p in chosen:
                    key = key << 8 | raw[:, p]
                yield pa.RecordBatch.from_arrays([pa.array(key), batch.column(0)], ["key", "node"])

    def met(group, nodes):
        """Pairs inside runs of equal ``group``, and by how many meetings each counts."""
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        sizes = np.diff(np.r_[starts, len(group)])
        short = np.repeat(sizes, sizes) <= SHORT
        for d in range(1, min(SHORT, int(sizes.max()))):
            i = np.flatnonzero(short[:-d] & (group[:-d] == group[d:]))
            yield nodes[i], nodes[i + d], 1
        for s, k in zip(starts[sizes > SHORT], sizes[sizes > SHORT]):
            some = nodes[s : s + k]
            a, b = _forest(some.view(np.uint64), limit, least)
            yield some[a], some[b], meets

    def meet(batches):
        for got, change in runs_of(batches):
            for a, b, count in met(np.cumsum(change), np.ascontiguousarray(got[3])):
                if len(a):
                    columns = [np.maximum(a, b), np.minimum(a, b), np.full(len(a), count, np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["u", "v", "n"])

    posts = entries.select("node").mapInArrow(post, "key long, node long")
    long = posts.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > LIST)
    long = common.materialize(long, "long-lists")
    dealt = posts.join(long, "key", "left").select("key", "node", F.explode(_blocks(half)).alias("b")).select("key", "b.i", "b.j", "node")
    pairs = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(meet, "u long, v long, n long")
    tallied = pairs.groupBy("u", "v").agg(F.sum("n").alias("n")).filter(F.col("n") >= meets)
    return tallied.filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= limit).select("u", "v")


def _blocks(half: int):
    """The pairs of blocks (``i``, ``j``) that a row of a list of ``n`` entries belongs to; one pair for a list of usual length (null ``n``)."""
    blocks = F.ceil(F.col("n") / half)
    mine = F.pmod(F.xxhash64("node"), blocks)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j")))
    several = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda other: F.struct(F.least(mine, other).alias("i"), F.greatest(mine, other).alias("j")))
    return F.when(F.coalesce(F.col("n"), F.lit(0)) <= LIST, whole).otherwise(several)


def runs_of(batches):
    """Sorted batches as columns that end with whole lists (equal first three columns), and where a list starts."""
    rest = None
    for batch in batches:
        got = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
        if rest is not None:
            got = [np.concatenate([a, b]) for a, b in zip(rest, got)]
        if not len(got[0]):
            continue
        change = np.r_[True, (got[0][1:] != got[0][:-1]) | (got[1][1:] != got[1][:-1]) | (got[2][1:] != got[2][:-1])]
        last = int(np.flatnonzero(change)[-1])
        if last:
            yield [x[:last] for x in got], change[:last]
        rest = [x[last:] for x in got]
    if rest is not None:
        yield rest, np.r_[True, np.zeros(len(rest[0]) - 1, bool)]


def near_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id", n: int = 3, limit: int = 3, width: int = 3) -> DataFrame:
    """``doc_id``, ``fp``, ``node``, ``component_id``: one row a row of ``df``; fingerprints of 64 bits link at ``limit`` or fewer differing bits.

    Exact: no link is missed. ``component_id`` is the smallest ``doc_id`` of the connected group (null if all its ids are null). Texts
    without words, null ones included, have fingerprint zero and link like any other. Repeated rows stay, each with its
    group's id. Whole texts of any length; an empty table gives an empty one; other columns of ``df`` are not read. The result is one
    written table in the shared folder.
    """
    if not 0 <= limit <= 7:
        raise ValueError("limit must be 0 to 7")
    with common.scratch(df.sparkSession) as own:
        printed = with_fingerprints(df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), n=n)
        prints = common.materialize(printed.select("doc_id", "fp", "node"), "prints")
        entries = common.materialize(prints.groupBy("node").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n")), "entries")
        roots = common.materialize(components(links(entries, limit, min(width, 8 - limit))), "roots")
        rooted = entries.join(roots, "node", "left").select("node", "n", F.coalesce("root", "node").alias("root"), "least_id")
        smallest = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count("*").alias("nodes"))
        named = common.attach(rooted, smallest, ["root"], entries.count(), "nodes").select("node", "n", "component_id")
        named = common.materialize(named, "named")
        out = common.attach(prints, named, ["node"], prints.count()).select("doc_id", "fp", "node", "component_id")
        out = common.materialize(out, "near-duplicates")
        own.keep(out)
    return out


def print_links(marks: DataFrame, limit: int, width: int = 3) -> DataFrame:
    """``u``, ``v``: pairs of nodes whose fingerprints differ in ``limit`` bits at most, by the index of :func:`links`.

    marks: distinct ``node``, ``fp``, a written table; a node may have several fingerprints. Nodes of one fingerprint are paired with the smallest of
    them, which stands for it, so the pairs connect what all pairs within that distance connect.
    """
    prints = common.materialize(marks.groupBy("fp").agg(F.min("node").alias("least"), F.count("*").alias("n")), "marked")
    same = common.attach(marks, prints, ["fp"], marks.count()).select(F.col("node").alias("u"), F.col("least").alias("v"))
    left, right = (prints.select(F.col("fp").alias(x), F.col("least").alias(f"of_{x}")) for x in "uv")
    apart = links(prints.select(F.col("fp").alias("node")), limit, width).join(left, "u").join(right, "v").select(F.col("of_u").alias("u"), F.col("of_v").alias("v"))
    return same.unionByName(apart).filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def shingle_set(text: str, n: int = 5) -> np.ndarray:
    """The distinct hashes of the text's shingles, sorted (uint64)."""
    from xxhash import xxh64_intdigest

    return np.unique(np.array([xxh64_intdigest(s, 42) for s in shingles(text, n)], np.uint64))


#: Bits of a set's sketch.
SKETCH = 512


def sketch(found: np.ndarray) -> bytes:
    """``SKETCH`` bits, each set if an odd number of elements (uint64) falls on it. Elements of both sets cancel out, so the sketches of two sets
    differ in no more bits than there are elements in only one of them."""
    return np.packbits(np.bincount((found % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) & 1).tobytes()


def least_overlap(a, b, similarity: float):
    """The fewest common elements of sets of ``a`` and ``b`` elements at this Jaccard similarity (not rounded up)."""
    return similarity / (1 + similarity) * (a + b) - 1e-9


def prefix(found: np.ndarray, common: np.ndarray, similarity: float) -> np.ndarray:
    """The first elements of a set, rare ones first, of which any two sets at this similarity share one.

    ``common`` holds elements to be put last, the most common one at its end; all others are ordered by value.
    """
    if len(common):
        order = np.argsort(common)
        at = np.minimum(np.searchsorted(common[order], found), len(common) - 1)
        place = np.where(common[order][at] == found, order[at] + 1, 0)
        found = found[np.lexsort((found, place))]
    return found[: len(found) - int(np.ceil(similarity * len(found) - 1e-9)) + 1] if len(found) else found


def _alike(group: np.ndarray, size: np.ndarray, root: np.ndarray, sketches: np.ndarray, similarity: float):
    """Pairs of row numbers inside runs of equal ``group`` that may be similar: of different roots, of sizes that leave room for the overlap needed,
    and, in runs longer than ``SHORT``, of sketches that do."""
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, len(group)])

    def may(i, j):
        return (root[i] != root[j]) & (np.minimum(size[i], size[j]) >= least_overlap(size[i], size[j], similarity))

    short = np.repeat(sizes, sizes) <= SHORT
    for d in range(1, min(SHORT, int(sizes.max()))):
        i = np.flatnonzero(short[:-d] & (group[:-d] == group[d:]))
        i = i[may(i, i + d)]
        yield i, i + d
    for s, k in zip(starts[sizes > SHORT], sizes[sizes > SHORT]):
        bits = np.frombuffer(b"".join(sketches[s : s + k]), np.uint64).reshape(k, -1)
        for i in range(s, s + k - 1):
            j = np.arange(i + 1, s + k)
            j = j[may(i, j)]
            differ = np.bitwise_count(bits[j - s] ^ bits[i - s]).sum(1, dtype=np.int64)
            j = j[differ <= size[i] + size[j] - 2 * least_overlap(size[i], size[j], similarity)]
            yield np.full(len(j), i), j


def candidates(posts: DataFrame, similarity: float) -> DataFrame:
    """``u``, ``v``: every pair of nodes of different ``root`` that can have this similarity, from ``key``, ``node``, ``size``, ``root``, ``n``
    and, where ``n`` exceeds ``SHORT``, ``sketch``.

    The elements that two prefixes share are counted. What one set shares beyond lies behind its prefix, for the set whose prefix ends
    first in the order of all elements, so the count and the larger of both rests must make up the overlap needed. Longer lists
    give only the pairs whose sketches allow that overlap, so a large group of texts that are not similar enough is not written out as all its pairs. Lists are
    dealt out as pairs of blocks where they exceed ``LIST``; a pair that meets in several of these counts more than once, which drops nothing.
    """

    def meet(batches):
        for got, change in runs_of(batches):
            if len(got[0]) < 2:
                continue
            node, size = got[3], got[4].astype(np.int64)
            for i, j in _alike(np.cumsum(change), size, got[5], got[6], similarity):
                if len(i):
                    low, high = np.where(node[i] < node[j], i, j), np.where(node[i] < node[j], j, i)
                    columns = [node[low], node[high], size[low].astype(np.int32), size[high].astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["u", "v", "of_u", "of_v"])

    spread = posts.select("key", "node", "size", "root", "sketch", F.explode(_blocks(LIST // 2)).alias("b")).select("key", "b.i", "b.j", "node", "size", "root", "sketch")
    met = spread.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(meet, "u long, v long, of_u int, of_v int")
    counted = met.groupBy("u", "v").agg(F.count("*").alias("n"), F.max("of_u").alias("of_u"), F.max("of_v").alias("of_v"))
    rest = lambda c: F.ceil(F.col(c) * similarity - 1e-9) - 1
    need = (F.col("of_u") + F.col("of_v")) * (similarity / (1 + similarity)) - 1e-6
    return counted.filter(F.col("n") + F.greatest(rest("of_u"), rest("of_v")) >= need).select("u", "v")


#: Bits of the filter that keeps texts nobody asks for out of a shuffle; 64 bits a row, so the broadcast table has a proven bound.
FILTER_BITS = 1 << 25


def wanted_only(plain: DataFrame, digests: DataFrame) -> DataFrame:
    """The rows of ``plain`` whose ``digest`` may be in the table ``digests``: all that are, and of the others the fewer the fewer are wanted."""
    bit = lambda: F.pmod(F.col("digest"), F.lit(FILTER_BITS))
    words = digests.select(F.expr(f"pmod(digest, {FILTER_BITS}) div 64").alias("word"), (bit() % 64).cast("int").alias("at"))
    words = words.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, at)")).alias("bits"))
    marked = plain.withColumn("word", F.expr(f"pmod(digest, {FILTER_BITS}) div 64")).join(F.broadcast(words), "word")
    return marked.filter(F.expr(f"shiftright(bits, int(pmod(digest, {FILTER_BITS}) % 64)) & 1L") == 1).select(*plain.columns)


def chains(entries: DataFrame) -> DataFrame:
    """``u``, ``v``: pairs of nodes that follow each other, in an order by hash, among those of an equal minimum in ``mins`` that agree in
    half of the minima. They are the likely links of large groups, in proportion to their size."""
    posts = entries.select("node", F.posexplode("mins").alias("lane", "least"))
    long = posts.groupBy("lane", "least").agg(F.count("*").alias("n")).filter(F.col("n") > LIST)
    part = F.pmod(F.xxhash64("node", "lane"), F.coalesce(F.ceil(F.col("n") / LIST), F.lit(1).cast("long")))
    dealt = posts.join(long, ["lane", "least"], "left").withColumn("part", part)
    after = F.lead("node").over(Window.partitionBy("lane", "least", "part").orderBy(F.xxhash64("node", "least"), "node"))
    pairs = dealt.select("node", after.alias("after")).filter("after IS NOT NULL")
    met = pairs.groupBy(F.least("node", "after").alias("u"), F.greatest("node", "after").alias("v")).agg(F.count("*").alias("n"))
    left, right = (entries.select(F.col("node").alias(x), F.col("mins").alias(f"of_{x}")) for x in "uv")
    same = F.size(F.filter(F.zip_with("of_u", "of_v", lambda a, b: a == b), lambda x: x))
    return met.join(left, "u").join(right, "v").filter(same >= 4).select("u", "v")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``u``, ``v`` whose sets (``node``, ``elements``) have at least this Jaccard similarity, exactly."""

    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a, b):
            x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
            same = len(np.intersect1d(x, y, assume_unique=True))
            out.append(same >= least_overlap(len(x), len(y), similarity))
        return pa.array(out, pa.bool_())

    met = pairs.join(sets.select(F.col("node").alias("u"), F.col("elements").alias("of_u")), "u").join(sets.select(F.col("node").alias("v"), F.col("elements").alias("of_v")), "v")
    return met.withColumn("ok", F.arrow_udf(run, "boolean")("of_u", "of_v")).filter("ok").select("u", "v")


def common_shingles(df: DataFrame, text: str, n: int, docs: int = 4000, most: int = 1 << 17) -> np.ndarray:
    """Hashes of shingles of several texts, the most common one last, learned on about ``docs`` rows. They decide the order in which
    shingles are compared, so how much is compared, but not what is found."""
    every = max(1, df.count() // docs)
    few = df.filter(F.pmod(F.xxhash64(F.col(f"`{text}`"), F.lit("few")), F.lit(every)) == 0)
    run = F.arrow_udf(lambda texts: pa.array([shingle_set(t.as_py() or "", n).view(np.int64) for t in texts], pa.list_(pa.int64())), "array<long>")
    counted = few.select(F.explode(run(F.col(f"`{text}`").cast("string"))).alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    rows = counted.filter("n > 2").orderBy(F.desc("n"), "h").limit(most).collect()
    return np.array([r["h"] for r in reversed(rows)], np.int64).view(np.uint64)


def one_of_each(df: DataFrame, text: str = "text", doc_id: str = "doc_id", n: int = 5, similarity: float = 0.8, limit: int = 3) -> DataFrame:
    """``df`` with one row of each group of near-duplicates: the one with the smallest id (null last), then the smallest text digest.

    Exact: texts link if the Jaccard similarity of their sets of ``n``-word shingles is at least ``similarity``; groups are what links
    connect. First come the pairs whose fingerprints differ in ``limit`` bits at most, as :func:`near_duplicates` finds them (postings of
    positional bytes, tally, guaranteed minimum, differing bits); the similarity is then checked on the whole sets. Fingerprints do not promise every
    pair of that similarity, so there is an exact way for the rest: sets of such a similarity share an element of their prefixes (in one order of all
    shingles, rare ones first), and all pairs that meet in a prefix, and are not connected yet, are checked as well. To spare large groups their pairs,
    likely links by equal minima are checked with those of the fingerprints. Texts without words, null ones included, are one
    group. Rows that repeat id and text count as copies: one stays. An empty table gives an empty one. The columns are those of ``df``, whatever their
    names. One table, of the rows that stay, is left in the shared folder.
    """
    common.ship(df.sparkSession)
    digest = F.xxhash64(common.text_of(text))
    plain = df.select(F.col(f"`{doc_id}`").alias("id"), digest.alias("digest"), F.col(f"`{text}`").cast("string").alias("text"))
    if not 0 <= limit <= 7:
        raise ValueError("limit must be 0 to 7")
    with common.scratch(df.sparkSession) as own:
        kept = _first_of_each(plain, n, similarity, limit)
        own.keep(kept)
    # plain keys, the same in join and window, so that the texts are dealt out once
    names = ["key", "no_key", "digest"]
    key = lambda c: [F.coalesce(c.cast("string"), F.lit("")), c.isNull()]
    mine = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[c.alias(x) for c, x in zip([*key(F.col(f"`{doc_id}`")), digest], names)])
    wanted = kept.select(*[c.alias(x) for c, x in zip([*key(F.col("id")), F.col("digest")], names)])
    rank = F.row_number().over(Window.partitionBy(*names).orderBy(F.lit(1)))
    whole = mine.join(wanted.hint("merge"), names, "left_semi").withColumn("copy", rank).filter("copy = 1")
    return whole.select(*[F.col(f"row.`{c}`").alias(c) for c in df.columns])


def _first_of_each(plain: DataFrame, n: int, similarity: float, limit: int) -> DataFrame:
    """``id`` and ``digest`` of the row that stays of each group; see :func:`one_of_each`. plain: ``id``, ``digest``, ``text``."""
    last = common_shingles(plain, "text", n)

    def describe(texts: pa.Array) -> pa.Array:
        from xxhash import xxh64_intdigest

        nodes, sizes, mins, first, prints, sketches = [], [], [], [], [], []
        for t in texts:
            found = shingle_set(t.as_py() or "", n)
            nodes.append(np.uint64(xxh64_intdigest(found.tobytes())).astype(np.int64))
            sizes.append(len(found))
            mins.append([_mix(found, k).min().astype(np.int64) for k in range(1, 9)] if len(found) else [])
            first.append(prefix(found, last, similarity).view(np.int64))
            prints.append(fingerprint(t.as_py() or ""))
            sketches.append(sketch(found))
        columns = [pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(mins, pa.list_(pa.int64())), pa.array(first, pa.list_(pa.int64()))]
        fps = pa.array(np.frombuffer(b"".join(prints), ">i8").astype(np.int64))
        return pa.StructArray.from_arrays([*columns, fps, pa.array(sketches, pa.binary())], ["node", "size", "mins", "first", "fp", "sketch"])

    def elements(texts: pa.Array) -> pa.Array:
        return pa.array([shingle_set(t.as_py() or "", n).tobytes() for t in texts], pa.binary())

    described = plain.withColumn("d", F.arrow_udf(describe, "struct<node: long, size: int, mins: array<long>, first: array<long>, fp: long, sketch: binary>")("text"))
    prints = common.materialize(described.select("id", "digest", "d.*"), "prints")
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "digest")
    one = F.first(F.struct("size", "mins", "sketch", F.col("first").alias("keys"))).alias("one")
    entries = common.materialize(prints.groupBy("node").agg(one, F.min(place).alias("first")).select("node", "one.*", "first"), "entries")
    marks = common.materialize(prints.select("node", "fp").distinct(), "marks")
    common.discard(prints)
    posts = entries.select("node", "size", F.posexplode("keys").alias("at", "key"))
    shared = common.materialize(posts.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "shared")
    lists = common.materialize(posts.join(shared, "key"), "lists")
    met = lists.select("node").distinct().join(entries.select("node", "mins"), "node")
    near = common.materialize(print_links(marks, limit, min(3, 8 - limit)).unionByName(chains(met)).distinct(), "likely-pairs")
    firsts = common.materialize(entries.select("node", "first", "sketch"), "firsts")
    common.discard(entries)
    common.discard(shared)

    def check(pairs: DataFrame) -> DataFrame:
        # one row stands for all copies of its set, so a text that a third of the rows hold is fetched once
        ends = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(firsts, "node").select("node", F.col("first.id").alias("end_id"), F.col("first.digest").alias("end_digest"))
        ends = common.materialize(ends, "ends")
        some = wanted_only(plain, ends.select(F.col("end_digest").alias("digest")))
        texts = some.join(ends, (F.col("digest") == F.col("end_digest")) & F.col("id").eqNullSafe(F.col("end_id"))).groupBy("node").agg(F.first("text").alias("text"))
        sets = common.materialize(texts.select("node", F.arrow_udf(elements, "binary")("text").alias("elements")), "sets")
        out = common.materialize(verified(pairs, sets, similarity), "verified")
        common.discard(sets)
        common.discard(ends)
        return out

    likely = check(near)
    tied = common.materialize(components(likely), "tied")
    known = firsts.select("node", "sketch").join(tied, "node", "left")
    rest = lists.join(known, "node").withColumn("root", F.coalesce("root", "node")).withColumn("sketch", F.when(F.col("n") > SHORT, F.col("sketch")))
    open_pairs = common.materialize(candidates(rest, similarity), "open-pairs")
    common.discard(lists)
    found = likely.unionByName(check(open_pairs))
    roots = common.materialize(components(found), "roots")
    rooted = firsts.join(roots, "node", "left").select(F.coalesce("root", "node").alias("root"), "first")
    return common.materialize(rooted.groupBy("root").agg(F.min("first").alias("first")).select("first.id", "first.digest"), "first-of-each")


def op4_simhash(spark, sf_dir):
    """Near-duplicate groups of all ``documents``."""
    docs = common.only(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    return near_duplicates(docs).select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
