"""Near copies: SimHash links by bit-sliced comparison, verified on the shingles, and then what lies beyond their radius.

Two documents are linked where the sets of their shingles of ``WIDTH`` words have a Jaccard similarity of at least SIMILAR / OF.
A document with fewer words is one shingle. Equal sets are one node, and a node has a SimHash fingerprint. Fingerprints at most ``RADIUS`` bits
apart are found in ``simhash``; the pairs that connect them are counted on the shingles, and what their links make one component is settled.

The radius misses most copies near the limit, whose fingerprints lie ten bits apart. So a node also has ``BANDS`` names, each made of
``ROWS`` minima of its hashes, and nodes that share a name and aren't settled yet are candidates too. A pair at the limit shares no
name with a probability of (1 - 0.8 ** 4) ** 48, about 1e-11, and closer pairs with less; nothing else is left out, and no candidate is a
link before its sets are counted.

Of a name whose m nodes are in several components, the pairs with one node, another for each band, are counted first, and then only pairs of a shared name that are still in different components are counted then: a group of near copies costs
m pairs and not m * m. Unlike nodes that share a name are all compared, by parities first: of the shingles in each of CELLS cells only the
parity is kept, and the cells where two sets' parities differ are at most the shingles that one of them lacks.

A set is known by 128 bits of digest: 64 name the node, and nodes whose other 64 bits differ are told apart. A text that is fetched again is used
only where it gives the same 128 bits.

Defined cases: null and empty texts have the empty set and are equal; A-Z count as a-z; repeated rows each get their row; a null
key takes part in links but never names a component that has another key; an empty table gives an empty table; other columns are
not returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesforge.llm.common import cut, whole_text
from seriesforge.llm.components import components
from seriesforge.llm.simhash import majority, near_links, shingle_hashes

WIDTH = 5
SIMILAR, OF = 4, 5
RADIUS = 2
ROWS, BANDS = 4, 48
CELLS = 512
MIXERS = np.random.default_rng(8).integers(0, 1 << 64, (2, ROWS * BANDS), np.uint64) | np.uint64(1)
WEIGHTS = np.random.default_rng(9).integers(0, 1 << 64, ROWS, np.uint64) | np.uint64(1)


def shingles(text: str) -> np.ndarray:
    """Sorted distinct hashes."""
    return np.unique(shingle_hashes(text, WIDTH))


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least hash of each of ROWS * BANDS permutations."""
    least = np.full(ROWS * BANDS, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 1024):
        mixed = hashes[at:at + 1024, None] * MIXERS[0] + MIXERS[1]
        least = np.minimum(least, mixed.min(axis=0))
    return least


def names(hashes: np.ndarray) -> np.ndarray:
    """A name for each band."""
    mixed = minima(hashes).reshape(BANDS, ROWS)
    return ((mixed ^ (mixed >> np.uint64(32))) * WEIGHTS).sum(axis=1, dtype=np.uint64)


def parities(hashes: np.ndarray) -> np.ndarray:
    """Whether the number of hashes in each cell is odd, as CELLS / 64 words."""
    odd = np.bincount((hashes >> np.uint64(7)).astype(np.int64) % CELLS, minlength=CELLS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def _lists(rows: list[np.ndarray], size: int) -> pa.Array:
    flat = np.concatenate([*rows, np.zeros(0, np.uint64)]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * size, pa.int32()), pa.array(flat))


def identity(hashes: np.ndarray, bits: int = 64) -> tuple[int, int]:
    """128 bits of a set, as two signed numbers; ``bits`` of the first are used."""
    both = np.frombuffer(xxhash.xxh3_128_digest(hashes.tobytes()), "<u8").copy()
    both[0] &= np.uint64((1 << bits) - 1)
    return tuple(both.view(np.int64).tolist())


def _nodes(df: DataFrame, key: str, text: str, bits: int) -> DataFrame:
    """(key, mark, node, check, n, fp, names, parities): ``mark`` finds the text again, ``node`` and ``check`` identify its set of ``n`` shingles."""

    @F.arrow_udf("node long, check long, n long, fp long, names array<long>, parities array<long>")
    def named(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            sets = [shingles(t.as_py()) for t in batch]
            both = np.array([identity(s, bits) for s in sets], np.int64).reshape(-1, 2)
            lists = [_lists([make(s) for s in sets], size) for make, size in ((names, BANDS), (parities, CELLS // 64))]
            yield pa.StructArray.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array([len(s) for s in sets], pa.int64()),
                                              pa.array(np.array([majority(s) for s in sets], np.uint64).view(np.int64)), *lists],
                                             ["node", "check", "n", "fp", "names", "parities"])

    return (df.select(F.col(key).alias("key"), F.xxhash64(whole_text(text)).alias("mark"), named.asNondeterministic()(whole_text(text)).alias("s"))
            .select("key", "mark", "s.*"))


def _distinct(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows by key and one row for each set; nodes that stand for several sets are renamed."""
    rest = [F.first(c).alias(c) for c in ("n", "fp", "names", "parities")]

    def sets(rows: DataFrame) -> DataFrame:
        return cut(rows.groupBy("node").agg(F.min("key").alias("least"), F.min("mark").alias("mark"), F.min("check").alias("check"),
                                            F.max("check").alias("other"), *rest))

    nodes = sets(own)
    several = nodes.filter(F.col("check") != F.col("other")).select("node", F.lit(True).alias("several"))
    if not several.isEmpty():
        own = cut(own.join(several, "node", "left").withColumn("node", F.when(F.col("several"), F.xxhash64("node", "check")).otherwise(F.col("node")))
                  .drop("several"))
        nodes = sets(own)
    return own, nodes.drop("other")


def _sets(df: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """(node, hashes) of the ``wanted`` (mark, node, check)."""

    @F.arrow_udf("hashes array<long>, digest long")
    def hashes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            sets = [shingles(t.as_py()) for t in batch]
            yield pa.StructArray.from_arrays([pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                                              pa.array([identity(s)[1] for s in sets], pa.int64())], ["hashes", "digest"])

    texts = df.select(F.xxhash64(whole_text(text)).alias("mark"), whole_text(text).alias("text"))
    once = texts.join(wanted, "mark").dropDuplicates(["node", "text"])
    found = once.select("node", "check", hashes.asNondeterministic()("text").alias("s")).filter(F.col("s.digest") == F.col("check"))
    return found.select("node", "s.hashes").dropDuplicates(["node"])


def _close() -> Column:
    """Whether the sets of rows with n_a, n_b, parities_a and parities_b can be similar enough."""
    small, large = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    differ = F.lit(0)
    for i in range(CELLS // 64):
        differ += F.bit_count(F.get("parities_a", F.lit(i)).bitwiseXOR(F.get("parities_b", F.lit(i))))
    return (OF * small >= SIMILAR * large) & ((OF + SIMILAR) * differ <= (OF - SIMILAR) * (small + large))


def verified(df: DataFrame, text: str, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those (a, b) of the pairs whose sets are similar enough."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = cut(_sets(df, text, nodes.join(wanted, "node", "left_semi").select("mark", "node", "check")))
    both = (pairs.join(sets.withColumnsRenamed({"node": "a", "hashes": "hashes_a"}), "a")
            .join(sets.withColumnsRenamed({"node": "b", "hashes": "hashes_b"}), "b"))
    shared = F.size(F.array_intersect("hashes_a", "hashes_b"))
    similar = (SIMILAR + OF) * shared >= SIMILAR * (F.size("hashes_a") + F.size("hashes_b"))
    return cut(both.filter(similar).select("a", "b"))


def _simhash_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b): pairs that connect all nodes whose fingerprints are within the radius."""
    first = nodes.groupBy("fp").agg(F.min("node").alias("first"))
    alike = nodes.join(first, "fp").filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    found = near_links(first.select("fp"), RADIUS).distinct()
    for side in "ab":
        found = found.join(first.select(F.col("fp").alias(side), F.col("first").alias(f"node_{side}")), side)
    return alike.unionByName(found.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")))


def near_copies(df: DataFrame, key: str = "doc_id", text: str = "text", bits: int = 64) -> DataFrame:
    """(key, component): the smallest key that links lead to."""
    own, nodes = _distinct(cut(_nodes(df, key, text, bits)))
    sides = [nodes.select(*[F.col(c).alias(x) for c, x in (("node", s), ("n", f"n_{s}"), ("parities", f"parities_{s}"))]) for s in "ab"]

    def close(pairs: DataFrame) -> DataFrame:
        return pairs.join(sides[0], "a").join(sides[1], "b").filter(_close()).select("a", "b")

    links = verified(df, text, nodes, cut(close(_simhash_pairs(nodes))))
    settled = nodes.join(components(links), "node", "left").select("node", "names", F.coalesce("root", "node").alias("root"))
    rows = settled.select("node", "root", F.posexplode("names").alias("band", "name"))
    shared = (rows.groupBy("band", "name").agg(F.min_by(F.struct("node", "root"), F.xxhash64("node", "band")).alias("at"), F.min("root").alias("low"),
                                               F.max("root").alias("high")).filter("low <> high")
              .select("band", "name", F.col("at.node").alias("centre"), F.col("at.root").alias("centre_root")))
    members = cut(rows.join(shared, ["band", "name"]))
    stars = close(members.filter("centre_root <> root").select(F.least("centre", "node").alias("a"), F.greatest("centre", "node").alias("b")).distinct())
    links = cut(links.unionByName(verified(df, text, nodes, cut(stars))))
    members = members.select("band", "name", "centre", "node")
    roots = cut(components(links))
    placed = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_names = (placed.groupBy("band", "name").agg(F.min("root").alias("low"), F.max("root").alias("high"))
                  .filter("low <> high").select("band", "name"))
    left = cut(placed.join(open_names, ["band", "name"], "left_semi"))
    one, two = [left.select("band", "name", "centre", F.col("node").alias(s), F.col("root").alias(f"root_{s}")).join(side, s)
                for s, side in zip("ab", sides)]
    rest = (one.join(two.drop("centre"), ["band", "name"])
            .filter((F.col("a") < F.col("b")) & (F.col("a") != F.col("centre")) & (F.col("b") != F.col("centre"))
                    & (F.col("root_a") != F.col("root_b")) & _close())
            .select("a", "b").distinct())
    more = verified(df, text, nodes, cut(rest))
    roots = components(links.unionByName(more)).select("node", "root")
    rooted = nodes.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    named = rooted.join(least, "root").select("node", "component")
    return own.join(named, "node").select(F.col("key").alias(key), "component")
