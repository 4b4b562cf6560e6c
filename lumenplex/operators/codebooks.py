"""Codebooks: one-hot forms, queries, distances, comparison, merging. Unknown entries are NULL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenplex.operators.lineage import cut

#: A codebook of more entries than this isn't held in one row of a broadcast.
MAX_ENTRIES = 2_000_000


def onehot(channels: DataFrame, n_channels: int) -> DataFrame:
    """j, r, ch, c from j, r, ch: 1 at the channel, 0 elsewhere; channel -1 makes the whole round unknown."""
    every = channels.select("j", "r", F.col("ch").alias("__lit"), F.explode(F.sequence(F.lit(0), F.lit(n_channels - 1))).alias("ch"))
    return every.select("j", "r", "ch", F.when(F.col("__lit") != -1, (F.col("ch") == F.col("__lit")).cast("double")).alias("c"))


def query_onehot(codes: DataFrame, pattern: str) -> DataFrame:
    """Codes j that are lit as a pattern says: one character per round, a channel's digit or '?' for any."""
    asked = [(r, int(ch)) for r, ch in enumerate(pattern) if ch != "?"]
    if not asked:
        return codes.select("j").distinct()
    hit = F.lit(False)
    for r, ch in asked:
        hit = hit | ((F.col("r") == r) & (F.col("ch") == ch) & (F.col("c") > 0))
    return codes.where(hit).groupBy("j").agg(F.count("*").alias("n")).where(F.col("n") == len(asked)).select("j")


def packed(codes: DataFrame) -> DataFrame:
    """j and the code's entries as one array in order of n; the size of a codebook, not of the data."""
    return codes.groupBy("j").agg(F.sort_array(F.collect_list(F.struct("n", "c"))).alias("e")).select("j", F.transform("e", lambda x: x["c"]).alias("code"))


def _beside(large: DataFrame, small: DataFrame) -> DataFrame:
    """i, j, d: each code of `large` compared, where it lies, with all of `small`, which every task holds as one row of checked size."""
    if small.limit(MAX_ENTRIES + 1).count() > MAX_ENTRIES:
        raise ValueError(f"a codebook of more than {MAX_ENTRIES} entries doesn't go into one row")
    apart = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: F.coalesce(F.abs(u - v), F.lit(0.0))), F.lit(0.0), lambda s, d: s + d)
    book = F.broadcast(small.groupBy("j").agg(_by_frame().alias("code")).agg(F.collect_list(F.struct("j", "code")).alias("book")))
    each = large.groupBy(F.col("j").alias("i")).agg(_by_frame().alias("__a")).crossJoin(book)
    # Entries meet by frame: what either lacks is skipped.
    lined = lambda own, other: F.transform(F.map_keys(own), lambda n: F.try_element_at(other, n))
    rows = each.select("i", F.explode(F.transform("book", lambda b: F.struct(b["j"].alias("j"), apart(F.map_values("__a"), lined(F.col("__a"), b["code"])).alias("d")))).alias("x"))
    return rows.select("i", "x.j", "x.d")


def _by_frame():
    return F.map_from_entries(F.array_sort(F.collect_list(F.struct("n", "c"))))


def distances(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """i, j, d for every pair of codes of two codebooks: the summed absolute difference, unknown entries skipped.

    The book of fewer entries goes to the tasks as one row, after a check of its size; the other's codes are compared
    with it where they lie, so no pair of codes is shuffled.
    """
    sizes = [x.groupBy().agg(F.count("*").alias("n")).first()["n"] for x in (ours, theirs)]
    if sizes[0] < sizes[1]:
        return _beside(theirs, ours).select(F.col("j").alias("i"), F.col("i").alias("j"), "d")
    return _beside(ours, theirs)


def compare(ours: DataFrame, theirs: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """One row: fn, fp, false discovery rate and detection rate between two codebooks."""
    d = distances(ours, theirs)
    mine = d.groupBy("i").agg(F.min("d").alias("d")).agg(F.count("*").alias("n_ours"), F.count_if(F.col("d") > tolerance).alias("fn"))
    other = d.groupBy("j").agg(F.min("d").alias("d")).agg(F.count("*").alias("n_theirs"), F.count_if(F.col("d") > tolerance).alias("fp"))
    return mine.crossJoin(other).select("fn", "fp", (F.col("fp") / F.col("n_theirs")).alias("fdr"), (1 - F.col("fn") / F.col("n_ours")).alias("dr"))


def pairing(ours: DataFrame, theirs: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """The pairs i, j within the tolerance."""
    return distances(ours, theirs).where(F.col("d") <= tolerance).select("i", "j")


def multiplicity(pairs: DataFrame) -> DataFrame:
    """One row: whether each side of a pairing maps unambiguously; an empty pairing does."""
    most = lambda side: pairs.groupBy(side).agg(F.count("*").alias("n")).agg((F.coalesce(F.max("n"), F.lit(0)) <= 1).alias(f"{side}_unambiguous"))
    return most("i").crossJoin(most("j"))


def merge_entries(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Codes n, j of theirs, unknown entries filled from ours."""
    a = ours.select("n", "j", F.col("c").alias("__a"))
    return theirs.join(a, ["n", "j"], "left").select("n", "j", F.coalesce("c", "__a").alias("c"))


def _pattern(code):
    """Which entries of a code are known, as a string of 1 and 0."""
    return F.concat_ws("", F.transform(code, lambda x: F.when(x.isNull(), "0").otherwise("1")))


def _meetings(book: DataFrame) -> DataFrame:
    """j, code, own, other, shared: a row per pattern of known entries that the book holds, with the code's entries known in both."""
    every = book.select(_pattern("code").alias("p")).agg(F.collect_set("p").alias("__p"))  # one row: patterns, not codes
    rows = book.select("j", "code", _pattern("code").alias("own")).crossJoin(every)
    rows = rows.select("j", "code", "own", F.explode("__p").alias("other"))
    both = F.filter("code", lambda x, i: x.isNotNull() & (F.substring("other", i + 1, F.lit(1)) == "1"))
    return rows.withColumn("shared", F.transform(both, lambda x: x + F.lit(0.0)))


def _links(book: DataFrame, tolerance: float) -> DataFrame:
    """a, b: links whose connected classes are those of all pairs of distinct codes within the tolerance.

    Without a tolerance, codes of two patterns that agree on what both know are all at distance 0, so each points to
    its group's smallest. With one, pairs meet in cells of two signed sums of entries, which differ by no more than
    the distance, and are measured.
    """
    met = _meetings(book)
    pair = [F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q")]
    if tolerance <= 0:
        group = met.groupBy(*pair, "shared").agg(F.min("j").alias("a"), (F.min("own") != F.max("own")).alias("linked"))
        return met.select(*pair, "shared", F.col("j").alias("b")).join(group.where("linked"), ["p", "q", "shared"]).where("a <> b").select("a", "b").distinct()

    def cell(k: int):
        signed = F.transform("shared", lambda x, i: F.when(F.pmod(F.xxhash64(i, F.lit(k)), F.lit(2)) == 0, x).otherwise(-x))
        return F.floor(F.aggregate(signed, F.lit(0.0), lambda s, x: s + x) / (tolerance * (1 + 1e-6) + 1e-9))

    near = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    placed = met.select("j", "own", "other", "shared", cell(1).alias("x"), cell(2).alias("y"))
    a = placed.withColumn("__s", near).withColumn("x", F.col("x") + F.col("__s")).withColumn("__t", near).withColumn("y", F.col("y") + F.col("__t")).drop("__s", "__t").alias("a")
    meets = (F.col("a.own") == F.col("b.other")) & (F.col("a.other") == F.col("b.own")) & (F.col("a.x") == F.col("b.x")) & (F.col("a.y") == F.col("b.y"))
    apart = F.aggregate(F.zip_with("a.shared", "b.shared", lambda u, v: F.abs(u - v)), F.lit(0.0), lambda s, x: s + x)
    return a.join(placed.alias("b"), meets & (F.col("a.j") < F.col("b.j"))).where(apart <= tolerance).select(F.col("a.j").alias("a"), F.col("b.j").alias("b")).distinct()


def connected(links: DataFrame) -> DataFrame:
    """j, first: the smallest name reachable over links a, b, for every name in a link."""
    both = cut(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a")).distinct())
    label = cut(both.groupBy("u").agg(F.least("u", F.min("v")).alias("l")))
    while True:
        seen = both.join(label.select(F.col("u").alias("v"), "l"), "v").groupBy("u").agg(F.min("l").alias("__m"))
        lower = label.join(seen, "u").select("u", F.col("l").alias("old"), F.least("l", "__m").alias("l"))
        jump = label.select(F.col("u").alias("l"), F.col("l").alias("__far"))
        new = cut(lower.join(jump, "l").select("u", "old", F.least("l", "__far").alias("l")))
        label = new.select("u", "l")
        if new.where("old <> l").isEmpty():
            return label.select(F.col("u").alias("j"), F.col("l").alias("first"))


def _greedy(pdf):
    """Greedy in order of j over one class of linked codes, until nothing changes."""
    import numpy as np

    pdf = pdf.sort_values("j")
    tolerance = pdf["tolerance"].iloc[0]
    book = [np.array([np.nan if x is None else x for x in c], float) for c in pdf["code"]]
    names = pdf["j"].tolist()
    while True:
        kept = np.empty((len(book), len(book[0])))
        of: list = []
        for name, code in zip(names, book):
            d = np.nansum(np.abs(kept[: len(of)] - code), axis=1)
            if len(d) and d.min() <= tolerance:
                at = int(d.argmin())
                kept[at] = np.where(np.isnan(code), kept[at], code)
            else:
                kept[len(of)] = code
                of.append(name)
        done, book, names = len(of) == len(book), list(kept[: len(of)]), of
        if done:
            return type(pdf)({"j": names, "code": [[None if np.isnan(x) else float(x) for x in c] for c in book]})


def deduplicate(codes: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Greedy, in order of j: a code joins the first nearest kept one within the tolerance, filling its unknown
    entries; repeated until nothing changes.

    Codes that hang together by links within the tolerance are one class; classes are independent, so each is a group
    of its own, and codes without a link are kept as they are. Without a tolerance equal codes are taken together
    first and the result is that of one pass over the whole book. With one, a merged code that comes near another
    class joins it in a next round. Entries that are NaN count as unknown.
    """
    name, value = codes.schema["j"].dataType.simpleString(), F.col("c").cast("double")
    book = cut(packed(codes.select("n", "j", F.when(~F.isnan(value), value).alias("c"))))
    while True:
        plain = book.select("j", F.transform("code", lambda x: x + F.lit(0.0)).alias("code"))
        first = plain.groupBy("code").agg(F.min("j").alias("j")).select("j", "code")
        links = _links(cut(first), tolerance)
        if tolerance > 0:
            equal = plain.join(first.withColumnRenamed("j", "a"), "code").where("a <> j").select("a", F.col("j").alias("b"))
            links = links.union(equal)
        else:
            plain = first
        links = cut(links)
        if links.isEmpty():
            return plain.select(F.posexplode("code").alias("n", "c"), "j").select("n", "j", "c")
        of = connected(links)
        each = plain.join(of, "j").withColumn("tolerance", F.lit(float(tolerance)))
        merged = each.groupBy("first").applyInPandas(_greedy, f"j {name}, code array<double>")
        new = cut(plain.join(of, "j", "left_anti").unionByName(merged))
        if tolerance <= 0 or new.count() == book.count():
            return new.select(F.posexplode("code").alias("n", "c"), "j").select("n", "j", "c")
        book = new


def merge_codebooks(ours: DataFrame, theirs: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Both codebooks as one, deduplicated; theirs are renumbered after ours."""
    top = ours.agg(F.coalesce(F.max("j"), F.lit(-1)).alias("__top"))
    moved = theirs.crossJoin(top).select("n", (F.col("j") + F.col("__top") + 1).alias("j"), "c")
    return deduplicate(ours.select("n", "j", "c").unionByName(moved), tolerance)


def decoys(channels: DataFrame, n_rounds: int, n_channels: int, distance: int, n: int, tries: int | None = None, block: int = 1 << 20) -> DataFrame:
    """decoy, r, ch: the first n codes, in a fixed order of all codes, at a Hamming distance of `distance` or more from every code.

    channels: j, r, ch, of a checked size, held by each task as one row. Codes are tried block by block until n are
    found, each block twice as long as the one before; tries bounds how many are looked at.
    """
    if channels.limit(MAX_ENTRIES + 1).count() > MAX_ENTRIES:
        raise ValueError(f"a codebook of more than {MAX_ENTRIES} entries doesn't go into one row")
    total = n_channels**n_rounds
    own = cut(channels.groupBy("j").agg(F.sort_array(F.collect_list(F.struct("r", "ch"))).alias("c")).agg(F.collect_list(F.transform("c", lambda x: x["ch"])).alias("book")))
    number = F.pmod(F.col("k") * 7919 + 104729, F.lit(total))
    digits = F.array(*[F.floor(number / n_channels ** (n_rounds - 1 - r)).cast("int") % n_channels for r in range(n_rounds)])
    apart = lambda c: F.aggregate(F.zip_with(c, "code", lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x) >= distance
    found, last, first = None, min(tries or total, total), 0
    while found is None or (first < last and found.count() < n):
        stop = min(first + block, last)
        tried = channels.sparkSession.range(first, stop).withColumnRenamed("id", "k").select("k", digits.alias("code")).crossJoin(F.broadcast(own))  # one row
        good = cut(tried.where(F.forall("book", apart)).select("k", "code").orderBy("k").limit(n))
        found = good if found is None else found.unionByName(good)
        first, block = stop, 2 * block
    return found.orderBy("k").limit(n).select(F.col("k").alias("decoy"), F.posexplode("code").alias("r", "ch"))


def argmax(df: DataFrame, by: list[str], value: str, order: list[str]) -> DataFrame:
    """Per group the order columns of the largest value, the first in order among equals."""
    best = F.min(F.struct((-F.col(value)).alias("__v"), *order)).alias("__b")
    return df.groupBy(*by).agg(best).select(*by, *[F.col(f"__b.{c}").alias(c) for c in order], (-F.col("__b.__v")).alias(value))


def ranked_codes(df: DataFrame, value: str) -> DataFrame:
    """Rows with their rank by a value, within j."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("j").orderBy(value)))


def phased(codes: DataFrame, channels: int, left: list[float]) -> DataFrame:
    """Codes n, j, c whose rounds also show what earlier ones leave behind: the share `left` (by channel) of each round goes to the next.

    n = round * channels + channel. Every frame of a code's channel, from its first round to the codebook's last, has a row; unknown entries count as 0.
    """
    last = F.broadcast(codes.agg(F.max(F.floor(F.col("n") / channels)).cast("int").alias("last")))  # one row
    share = F.array(*map(F.lit, map(float, left)))
    held = codes.groupBy("j", (F.col("n") % channels).alias("ch")).agg(F.map_from_entries(F.collect_list(F.struct(F.floor(F.col("n") / channels).cast("int").alias("r"), F.coalesce("c", F.lit(0.0)).alias("c")))).alias("by"))
    entries = F.transform(F.sequence(F.lit(0), F.col("last")), lambda r: F.coalesce(F.try_element_at("by", r), F.lit(0.0)))
    carried = F.aggregate(entries, F.array().cast("array<double>"), lambda z, c: F.concat(z, F.array(c + F.get(share, F.col("ch")) * F.coalesce(F.get(z, F.size(z) - 1), F.lit(0.0)))))
    rows = held.crossJoin(last).select("j", "ch", F.posexplode(carried).alias("r", "c"))
    return rows.select((F.col("r") * channels + F.col("ch")).cast("int").alias("n"), "j", "c")
