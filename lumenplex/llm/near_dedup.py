"""Near-duplicate groups of whole texts: one-permutation MinHash, densified, banded, with star-shaped candidates.

Words are runs of `[^\\x20\\x09-\\x0D]` of the text with A-Z lower-cased; a document's set holds the hashes of its
distinct runs of five words (all words as one, if fewer). Two documents are linked when their full sets have a
Jaccard similarity of at least `percent` / 100; groups are what links connect.

1. Sets that are equal become one class at once, so thousands of exact copies cost one row.
2. One-permutation hashing splits the hash space into bins and keeps each bin's least value; an empty bin takes
   the value of another, picked by its own sequence of hashed attempts (optimal densification).
3. Bands of four bins make buckets. In a bucket every class is paired with one centre only, the class that
   shares buckets with the most others: a bucket of n classes gives n - 1 pairs.
4. Pairs are confirmed on full sets; links are connected by repeated star contraction.
5. Exact handling of what stars can't see: classes of buckets whose members are still in different groups are
   joined by prefix filtering. Shingles are put in order of how frequent they are among those classes; two sets as
   similar as asked share one of the first (100 - percent) % of both, at places that leave room for the overlap. In
   a large family of copies each one's own edits come first, so only copies that share edits are compared.

Odd input: a text that is null or has no words has an empty set, is linked with nothing and is its own group;
rows with a null id are linked with nothing, have no group and are kept; repeated rows share their id's group; long
texts have all their shingles; other columns are ignored; an empty table has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from lumenplex.llm.common import ROW, carried, groups, numbered, written

SHINGLE = 5
BINS, BAND = 128, 4
BANDS = BINS // BAND
#: Counters of shingle frequencies: the order of shingles needs no more than a rough count.
SLOTS = 1 << 18
#: Members whose texts are compared with one copy of their centre's text.
CHUNK = 200
#: A centre's members meet its number of chunks in so many parts; only centres of several chunks are repeated.
SALTS = 64
TABLE_LIMIT = 300_000

_MIX = np.random.default_rng(20240229).integers(1, 2**63, size=16, dtype=np.uint64) | np.uint64(1)
_TRIES = np.random.default_rng(7).integers(0, BINS, size=(200, BINS))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Shingler:
    """Sorted distinct shingle hashes of a text."""

    def __init__(self) -> None:
        self.table: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        try:
            h = np.fromiter(map(self.table.__getitem__, words), np.uint64, len(words))
        except KeyError:
            import xxhash

            if len(self.table) > TABLE_LIMIT:
                self.table.clear()
            for w in set(words):
                if w not in self.table:
                    self.table[w] = xxhash.xxh3_64_intdigest(w)
            h = np.fromiter(map(self.table.__getitem__, words), np.uint64, len(words))
        width = min(SHINGLE, len(h))
        n = len(h) - width + 1
        out = np.full(n, np.uint64(width))
        for k in range(width):
            out = (out + h[k : k + n]) * _MIX[k]
            out ^= out >> np.uint64(29)
        return np.unique(_mixed(out))


_EDGES = (np.arange(BINS, dtype=np.uint64) << np.uint64(64 - 7))


def bucket_keys(hashes: np.ndarray) -> np.ndarray:
    """One 64-bit key per band for a sorted, non-empty set of shingle hashes."""
    first = np.searchsorted(hashes, _EDGES)
    last = len(hashes) - 1
    least = hashes[np.minimum(first, last)]
    empty = (first > last) | ((least >> np.uint64(64 - 7)) != np.arange(BINS, dtype=np.uint64))
    if empty.any():
        open_bins, full = np.flatnonzero(empty), ~empty
        for tries in _TRIES:
            donor = tries[open_bins]
            found = full[donor]
            least[open_bins[found]] = least[donor[found]]
            open_bins = open_bins[~found]
            if not len(open_bins):
                break
        else:
            least[open_bins] = hashes[0]
    bands = least.reshape(BANDS, BAND)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX[8]
    for k in range(BAND):
        key = _mixed((key + bands[:, k]) * _MIX[9 + k])
    return key.view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    shingles = Shingler()
    none = np.empty(0, np.int64)
    for b in batches:
        n, prints, keys = [], [], []
        for t in b.column(1):
            s = shingles(t.as_py())
            n.append(len(s))
            prints.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            keys.append(bucket_keys(s) if len(s) else none)
        ends = np.cumsum([0] + [len(k) for k in keys])
        listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys) if keys else none))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), listed], ["doc_id", "n_shingles", "print", "keys"])


def sign(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, print (of the whole set; null if empty) and the bands' keys."""
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(_signed, "doc_id long, n_shingles long, print binary, keys array<bigint>")


def _compared(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler()
        at, own = None, []
        for key, rows in groups(batches, ["centre", "chunk"]):
            found = []
            if key != at:
                at, own = key, []
            for kind, member, text in zip(rows.column("kind").to_pylist(), rows.column("member").to_pylist(), rows.column("text")):
                s = shingles(text.as_py())
                if kind == 0:
                    own.append(s)
                    continue
                for c in own[:1] if len(own) == 2 and np.array_equal(*own) else own:
                    both = len(np.intersect1d(c, s, assume_unique=True))
                    if both and 100 * both >= percent * (len(c) + len(s) - both):
                        found.append(member)
                        break
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(found), pa.int64()), pa.array(found, pa.int64())], ["a", "b"])

    return run


def confirm(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (centre, member) whose full sets are similar enough, as links a, b.

    A centre's members are dealt into chunks, each with one copy of the centre's text, so a centre with many
    members is spread over tasks and a task holds one member's set at a time. texts: doc_id, text.
    """
    spread = F.xxhash64("member")
    large = pairs.groupBy("centre").agg(F.ceil(F.count("*") / F.lit(CHUNK)).alias("chunks")).where("chunks > 1")
    large = large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = pairs.withColumn("salt", F.pmod(spread, F.lit(SALTS)).cast("int")).join(large, ["centre", "salt"], "left")
    members = dealt.select("centre", F.pmod(spread, F.coalesce("chunks", F.lit(1))).alias("chunk"), "member")
    heads = members.select("centre", "chunk").distinct()
    needs = members.select(F.col("member").alias("doc_id"), "centre", "chunk", F.lit(1).alias("kind"), "member").unionByName(
        heads.select(F.col("centre").alias("doc_id"), "centre", "chunk", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("member"))
    )
    # Texts are streamed past the needs, unsorted.
    both = texts.join(needs.hint("shuffle_hash"), "doc_id").select("centre", "chunk", "kind", "member", "text")
    dealt = both.repartition("centre", "chunk").sortWithinPartitions("centre", "chunk", "kind")
    return dealt.mapInArrow(_compared(percent), "a long, b long")


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(20)).astype(np.int64) % SLOTS


def _setted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingles = Shingler()
    for b in batches:
        sets = [shingles(t.as_py()) for t in b.column("text")]
        raw = pa.array([s.tobytes() for s in sets], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("group"), pa.array([len(s) for s in sets], pa.int64()), raw], ["rep", "group", "size", "hashes"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(SLOTS, np.int64)
    for b in batches:
        for h in b.column("hashes"):
            np.add.at(counts, _slot(np.frombuffer(h.as_py(), np.uint64)), 1)
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["slot", "n"])


def _prefixes(frequency: np.ndarray, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens, at = [], []
            for h in b.column("hashes"):
                own = np.frombuffer(h.as_py(), np.uint64)
                keep = len(own) - -(-percent * len(own) // 100) + 1
                tokens.append(own[np.lexsort((own, frequency[_slot(own)]))[:keep]].view(np.int64))
                at.append(np.arange(len(tokens[-1])))
            n = [len(t) for t in tokens]
            each = [np.repeat(b.column(c).to_numpy(), n) for c in ("rep", "group", "size")]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*each, np.concatenate(tokens), np.concatenate(at))] if n else [pa.array([], pa.int64())] * 5, ["rep", "group", "size", "token", "place"])

    return run


def across_groups(members: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs (centre, member) in different groups among members (rep, group) whose sets may be similar enough."""
    sets = texts.join(members.hint("shuffle_hash"), texts["doc_id"] == members["rep"]).select("rep", "group", "text")
    sets = written(sets.mapInArrow(_setted, "rep long, group long, size long, hashes binary"), "sets")
    counts = sets.select("hashes").mapInArrow(_counted, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # SLOTS rows at most
    frequency = np.zeros(SLOTS, np.int64)
    frequency[counts.column("slot").to_numpy()] = counts.column("n").to_numpy()
    rows = sets.mapInArrow(_prefixes(frequency, percent), "rep long, group long, size long, token long, place long")
    a, b = (rows.select(F.col("token").alias(f"{x}_token"), *[F.col(c).alias(f"{x}_{c}") for c in ("rep", "group", "size", "place")]) for x in "ab")
    both = F.col("a_size") + F.col("b_size")
    room = F.least(F.col("a_size") - F.col("a_place"), F.col("b_size") - F.col("b_place"))
    other = (F.col("a_rep") < F.col("b_rep")) & (F.col("a_group") != F.col("b_group"))
    pairs = a.join(b, (F.col("a_token") == F.col("b_token")) & other & (room * (100 + percent) >= percent * both))
    return pairs.select(F.col("a_rep").alias("centre"), F.col("b_rep").alias("member")).distinct()


def _beside_least(edges: DataFrame, itself: bool) -> DataFrame:
    """Edges u, v with m, the least v of each u (or u itself, if that counts and is less).

    A node with more than CHUNK edges meets them in SALTS parts; each of the others meets its own in one.
    """
    m = F.least("u", "near") if itself else F.col("near")
    least = edges.groupBy("u").agg(F.min("v").alias("near"), F.count("*").alias("n")).select("u", m.alias("m"), "n")
    hubs = least.where(F.col("n") > CHUNK).select("u", "m", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    dealt = edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    around = dealt.join(hubs, ["u", "salt"]).select("u", "v", "m")
    rest = dealt.join(hubs, ["u", "salt"], "left_anti").join(least.where(F.col("n") <= CHUNK).select("u", "m"), "u").select("u", "v", "m")
    return around.unionByName(rest)


def connect(links: DataFrame) -> DataFrame:
    """node, group (the least node reachable) for every node of links a, b, by alternating star contraction."""
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Every larger neighbour now hangs on the least node near it; then each node's smaller ones do.
        large = written(_beside_least(both, True).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), "edges")
        small = _beside_least(large, False).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        edges = written(small, "edges")
        # Done when there are stars only: each leaf has one centre, and no centre is a leaf.
        twice = edges.groupBy("u").count().where("count > 1").select("u")
        centres = edges.select(F.col("v").alias("node"), F.col("v").alias("group")).distinct()
        if twice.unionByName(centres.join(edges, F.col("node") == F.col("u"), "left_semi").select(F.col("node").alias("u"))).isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("group")).unionByName(centres)


def near_groups(docs: DataFrame, percent: int = 85, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept (doc_id = component_id) for every row.

    Ids that are no integers are numbered in their order first, and named again in the result.
    """
    kind = docs.schema[doc_id].dataType
    if not isinstance(kind, IntegralType):
        numbers = numbered(docs, doc_id)
        found = near_groups(docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text")).join(numbers, "id", "left").select("number", "text"), percent, "number")
        name = lambda c: numbers.select(F.col("number").alias(c), F.col("id").alias(f"{c}_named"))
        found = found.join(name("doc_id"), "doc_id", "left").join(name("component_id"), "component_id", "left")
        return found.select(F.col("doc_id_named").alias("doc_id"), "n_shingles", F.col("component_id_named").alias("component_id"), "kept")
    texts = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    signed = written(sign(docs, doc_id, text), "signed")
    # One class per distinct set, named by its least id.
    reps = written(signed.where("print is not null and doc_id is not null").groupBy("print").agg(F.min("doc_id").alias("rep")), "reps")
    classes = signed.join(reps, (signed["print"] == reps["print"]) & (signed["doc_id"] == reps["rep"])).select("rep", F.col("n_shingles").alias("size"), "keys")
    classes = written(classes, "classes")

    rows = classes.select("rep", "size", F.explode("keys").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    crowded = written(rows.join(shared, "key"), "buckets")
    degree = crowded.groupBy("rep").agg(F.sum("n").alias("degree"))
    centres = crowded.join(degree, "rep").groupBy("key").agg(F.max(F.struct("degree", (-F.col("rep")).alias("least"), F.col("size").alias("size"))).alias("c"))
    centres = centres.select("key", (-F.col("c.least")).alias("centre"), F.col("c.size").alias("centre_size"))
    fits = lambda a, b: 100 * F.least(a, b) >= percent * F.greatest(a, b)
    pairs = crowded.join(centres, "key").where((F.col("rep") != F.col("centre")) & fits(F.col("size"), F.col("centre_size")))
    pairs = written(pairs.select("centre", F.col("rep").alias("member")).distinct(), "pairs")
    links = written(confirm(pairs, texts, percent), "links")
    group = written(connect(links), "groups")

    # What stars don't see: members of one bucket that are in different groups by now.
    named = crowded.join(group, F.col("rep") == F.col("node"), "left").select("rep", "key", F.coalesce("group", "rep").alias("group"))
    mixed = named.groupBy("key").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo < hi").select("key")
    members = written(named.join(mixed, "key").select("rep", "group").distinct(), "members")
    done = pairs.select(F.least("centre", "member").alias("centre"), F.greatest("centre", "member").alias("member"))
    more = written(across_groups(members, texts, percent).join(done, ["centre", "member"], "left_anti"), "pairs")
    late = written(confirm(more, texts, percent), "links") if not more.isEmpty() else more.limit(0)
    if not late.isEmpty():
        group = written(connect(links.unionByName(late)), "groups")

    named = reps.join(group, F.col("rep") == F.col("node"), "left").select("print", F.coalesce("group", "rep").alias("class_group"))
    found = signed.select("doc_id", "n_shingles", "print").join(named, "print", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("class_group", "doc_id"))
    found = found.select("doc_id", "n_shingles", component.alias("component_id"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_first(docs: DataFrame, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The input rows without those that near_groups() doesn't keep.

    Where ids repeat, each row is a document of its own, and a group keeps its row of the least id, among those the one
    of the least hash of its text; equal rows are near each other like any, so they count once unless they have no
    words. Columns may be of any type, maps included. Rows without an id stay.
    """
    rows = carried(docs, F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    named, none = rows.where("id is not null"), rows.where("id is null")
    if named.groupBy("id").count().where("count > 1").isEmpty():
        gone = written(near_groups(named, percent, "id").where("not kept").select(F.col("doc_id").alias("gone")).distinct(), "gone")
        return rows.join(gone, F.col("id") == F.col("gone"), "left_anti").select(f"{ROW}.*")
    # Written with their numbers, so that these stay as they are.
    named = written(named.withColumn("row", F.monotonically_increasing_id()), "rows")
    found = near_groups(named.select("row", "text"), percent, "row").select("doc_id", "component_id")
    of = named.select("row", "id", F.xxhash64("text").alias("hash")).join(found, F.col("row") == F.col("doc_id"))
    first = of.groupBy("component_id").agg(F.min(F.struct("id", "hash", "row")).alias("first")).select(F.col("first.row").alias("kept"))
    kept = written(first, "kept")
    return named.join(kept, F.col("row") == F.col("kept"), "left_semi").select(f"{ROW}.*").unionByName(none.select(f"{ROW}.*"))
