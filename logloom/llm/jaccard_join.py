"""Exact Jaccard self-join of shingle sets: a size-aware heavy-light join.

Two sets link at p% or more if their overlap is at least p% of their union, so each shares at least
p% of the larger one's shingles. Nothing is sampled and no list is cut.

*Light* sets are small enough to enumerate fixed-size subsets: for each pair of sizes the overlap
that a link needs is one number, and both sets list all their subsets of that size. *Heavy* sets
scan inverted lists of single shingles: a set of n enters the lists of its first
``n - ceil(p n) + SHARED`` shingles in one order of all shingles, and two sets that link meet in
``SHARED`` lists or more (fewer only for sets that have fewer shingles to share). The order puts
shingles with long lists last, by counts over all documents. So a set's own shingles come first, a
passage that many documents share makes no list unless a set has little else, and the places at which
two sets meet bound what they can share: near copies that miss the threshold don't become candidates.
The light-heavy boundary is the largest size at which enumerating subsets writes no more rows than the
lists make a set scan, from the mean length of the lists that were counted.

Of what meets in a list not all pairs are made, as a group of near copies would give the square of
its size. In a round each set is compared with the leaders that share most lists with it; what links
gets one label, and lists whose sets have one label are done. When few pairs are left, or rounds no
longer find much, all pairs with different labels that meet often enough, at places that allow a link,
are compared. So links inside a component that is known already are not looked for, and every other
pair that can link is.

To compare, sets are read again from the texts and sent to the pair's centre, in parts of bounded
size (a centre may have any number of partners), where they stream past it. Equal sets are one set.

Cases: null text, empty text and text of spaces have the empty set, which links with nothing; a
text of fewer words than a shingle has one shingle; repeated rows and doc_ids are kept, and rows
with null doc_ids take part but never name a component unless it has no other id; an empty table
gives an empty table; further columns of the input are ignored, whatever their names.

Shingles are compared as 64-bit hashes; a set is identified by 63 bits made of all its shingles, so
two of N different sets are taken for one with a chance of about N^2 / 2^64.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared
from .components import components
from .words import mix, shingles, slices, words

_SALT = np.uint64(0xA0761D6478BD642F)
#: Lists that a linked pair of large sets shares at least.
SHARED = 2
#: A list longer than this goes to the end of the order.
LONG_LIST = 16
#: Long lists that are known to all tasks, 4 bytes each; where there are more, the longest are.
MOST_LONG = 4_000_000
#: Sets that are enumerated by subsets have at most this many shingles, whatever lists cost.
MOST_LIGHT = 16
#: Partners that meet a centre in one part.
PART = 512
#: Rows of a small table that is sent to all tasks; a larger one is joined.
BROADCAST_ROWS = 200_000


def least_overlap(n: int, percent: int) -> int:
    """The fewest shingles that a set of ``n`` shares with any set it links with."""
    return -(-percent * n // 100)


def meetings(n: int, percent: int) -> int:
    """Lists in which a set of ``n`` meets a linked set that is not smaller."""
    return min(SHARED, least_overlap(n, percent))


def prefix_size(n: int, percent: int) -> int:
    """Lists that a set of ``n`` enters."""
    return n - least_overlap(n, percent) + meetings(n, percent)


def leading_size(n: int, percent: int) -> int:
    """How many of these it enters as the smaller set of a pair, which shares more of it."""
    return n - -(-2 * percent * n // (100 + percent)) + meetings(n, percent)


def partner_sizes(n: int, percent: int) -> range:
    return range(least_overlap(n, percent), 100 * n // percent + 1)


def overlaps(n: int, light: int, percent: int) -> set[int]:
    """Sizes of the subsets by which a light set of ``n`` meets its partners, the larger of which is light too.

    Equal sets need no subset; they are one set.
    """
    found = set()
    for m in partner_sizes(n, percent):
        a, b = min(n, m), max(n, m)
        if b > light:
            continue
        need = -(-percent * (a + b) // (100 + percent))
        # With an odd or smaller difference the overlap is larger, and then they also share a subset of `need`.
        if need <= a and (a, b) != (need, need):
            found.add(need)
    return found


def subset_rows(n: int, percent: int) -> int:
    return sum(comb(n, k) for k in overlaps(n, 2 * n, percent))


def boundary(mean_list: float, percent: int) -> int:
    """The largest light size: subsets cost their rows, lists the entries that a set meets in them."""
    light = 1
    while light < MOST_LIGHT and subset_rows(light + 1, percent) <= prefix_size(light + 1, percent) * mean_list:
        light += 1
    return light


def subset_keys(own: np.ndarray, light: int, percent: int) -> np.ndarray:
    """Keys of all subsets by which a light set meets others."""
    from itertools import combinations

    n, found = len(own), [np.zeros(0, np.uint64)]
    whole = own.sum(dtype=np.uint64)
    for size in sorted(overlaps(n, light, percent)) if n <= light else ():
        if size == n:
            sums = np.array([whole])
        else:
            left_out = np.array(list(combinations(range(n), n - size)), np.int64)
            sums = whole - own[left_out].sum(axis=1, dtype=np.uint64)
        found.append(mix(sums ^ np.uint64(size * int(_SALT) % (1 << 64))))
    return np.concatenate(found)


def short_name(own: np.ndarray) -> np.ndarray:
    """32 bits of each shingle, by which lists are counted. They only order shingles, so those that share a name do no harm."""
    return (own >> np.uint64(32)).astype(np.uint32)


def list_keys(own: np.ndarray, light: int, percent: int, long_lists: np.ndarray) -> np.ndarray:
    """Keys of the inverted lists that a sorted set enters, in order; none if all its partners are light like itself."""
    n = len(own)
    if 100 * n // percent <= light:
        return own[:0]
    size = prefix_size(n, percent)
    if not len(long_lists):
        return own[:size]
    name = short_name(own)
    at = np.minimum(np.searchsorted(long_lists, name), len(long_lists) - 1)
    long = long_lists[at] == name
    return np.concatenate([own[~long], own[long]])[:size] if long[:size].any() else own[:size]


def _sets(batch: pa.RecordBatch, column: int, size: int):
    """(row index, sorted distinct mixed shingle hashes) of each text of a batch."""
    at = 0
    for part, octets, offsets in slices(batch, column):
        hashes, firsts = words(octets, offsets)
        for k, own in enumerate(shingles(hashes, firsts, size)):
            yield at + k, np.unique(own)
        at += part.num_rows


def identity(own: np.ndarray) -> int:
    """63 bits of a set."""
    a = mix(own.sum(dtype=np.uint64, keepdims=True) + np.uint64(len(own)))
    b = mix(own ^ _SALT).sum(dtype=np.uint64, keepdims=True)
    return int(mix(a ^ b)[0] >> np.uint64(1))


def text_key():
    """Tells apart rows that share a doc_id."""
    return F.xxhash64(shared.text_or_empty())


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", text_key().alias("text_key"), shared.text_or_empty().alias("text"))


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*values, np.zeros(0, np.uint64)]).view(np.int64)))


def list_lengths(docs: DataFrame, size: int, parts: int | None = None) -> DataFrame:
    """(name, n, met): lengths of the lists above LONG_LIST; a row without a name has a part's entries in shorter lists of several sets (n) and the sum of what each of them meets (met).

    A task counts a set that it meets again once. It sends its counts by ranges of names, as sorted steps of 32 bits:
    a row a range and not a row a shingle. A range is a bounded share of all names.
    """
    spark = docs.sparkSession
    parts = parts or max(256, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds = (np.arange(1, parts, dtype=np.uint64) << np.uint64(32)) // np.uint64(parts)

    def count(batches):
        shared.own_worker("jaccard")
        seen: set[int] = set()
        held: list[np.ndarray] = []
        total = 0

        def flush():
            names, n = np.unique(np.concatenate(held), return_counts=True)
            cuts = np.concatenate([[0], np.searchsorted(names, bounds.astype(np.uint32)), [len(names)]])
            rows = [(k, i, j) for k, (i, j) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if j > i]
            steps = [np.diff(names[i:j], prepend=np.uint32(0)).tobytes() for _, i, j in rows]
            n = n.astype(np.uint32)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, *_ in rows], pa.int32()), pa.array(steps, pa.binary()), pa.array([n[i:j].tobytes() for _, i, j in rows], pa.binary())], names=["part", "steps", "n"])

        for batch in batches:
            for _, own in _sets(batch, 0, size):
                if len(own) and (one := identity(own)) not in seen:
                    seen.add(one)
                    held.append(short_name(own))
                    total += len(own)
                    if total > 2_000_000:
                        yield from flush()
                        held, total = [], 0
        if held:
            yield from flush()

    def merge(batches):
        shared.own_worker("jaccard")
        own, names, counts = -1, [], []

        def flush():
            name, where = np.unique(np.concatenate(names), return_inverse=True)
            n = np.bincount(where, np.concatenate(counts)).astype(np.int64)
            long, some = n > LONG_LIST, (n > 1) & (n <= LONG_LIST)
            found = pa.array(name[long].view(np.int32)), pa.array(n[long])
            yield pa.RecordBatch.from_arrays([*found, pa.array(np.zeros(int(long.sum()), np.int64))], names=["name", "n", "met"])
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int32()), pa.array([int(n[some].sum())]), pa.array([int((n[some] ** 2).sum())])], names=["name", "n", "met"])

        for batch in batches:
            for part, steps, n in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if part != own and names:
                    yield from flush()
                    names, counts = [], []
                own = part
                names.append(np.cumsum(np.frombuffer(steps, np.uint32), dtype=np.uint32))
                counts.append(np.frombuffer(n, np.uint32))
        if names:
            yield from flush()

    made = docs.select(shared.text_or_empty().alias("text")).mapInArrow(count, "part int, steps binary, n binary")
    return made.repartition("part").sortWithinPartitions("part").mapInArrow(merge, "name int, n long, met long")


def long_lists(lengths: DataFrame) -> tuple[np.ndarray, float]:
    """Sorted names of the long lists, the longest ones if there are more than MOST_LONG, and the mean length of the list that an entry of the others is in."""
    lengths = shared.materialize(lengths, "list-lengths")
    at = F.floor(8 * F.log2("n"))
    classes = lengths.where("name IS NOT NULL").groupBy(at.alias("at")).agg(F.count("*").alias("names")).collect()
    least, held = 1 << 30, 0
    for r in sorted(classes, key=lambda r: -r["at"]):
        if held + r["names"] > MOST_LONG:
            break
        least, held = r["at"], held + r["names"]
    mean = lengths.where("name IS NULL").agg((F.sum("met") / F.sum("n")).alias("mean")).first()["mean"]
    found = lengths.where(at >= least).where("name IS NOT NULL").select("name").toArrow().column("name").to_numpy().astype(np.int32).view(np.uint32)
    return np.sort(found), float(mean or 1.0)


def signatures(docs: DataFrame, size: int, percent: int, light: int, long: np.ndarray) -> DataFrame:
    """A row per document: its set's size and identity and, at the first sight of the set in a task, its keys: ``lists`` of inverted lists, of which it leads ``leads``, then those of subsets."""
    held = docs.sparkSession.sparkContext.broadcast(long)
    names = ["doc_id", "text_key", "n_shingles", "set_id", "lists", "leads", "keys"]

    def sign(batches):
        shared.own_worker("jaccard")
        seen: set[int] = set()
        for batch in batches:
            n, ids, lists, leads, keys = [], [], [], [], []
            for _, own in _sets(batch, 2, size):
                one = identity(own) if len(own) else None
                first = one is not None and one not in seen
                seen.add(one)
                entered, subsets = (list_keys(own, light, percent, held.value), subset_keys(own, light, percent)) if first else (own[:0], own[:0])
                n.append(len(own))
                ids.append(one)
                lists.append(len(entered))
                leads.append(min(len(entered), leading_size(len(own), percent)))
                keys.append(np.concatenate([entered, subsets]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(ids, pa.int64()), pa.array(lists, pa.int32()), pa.array(leads, pa.int32()), _lists(keys)], names=names)

    return _rows(docs).mapInArrow(sign, "doc_id long, text_key long, n_shingles long, set_id long, lists int, leads int, keys array<long>")


def shared_lists(sets: DataFrame) -> DataFrame:
    """(key, set_id, n, place, leads, weight) of all keys that two sets have, one of them leading. A subset weighs as much as all lists that a pair must share.

    Which keys those are is known from sums that start before the shuffle, and the join with them can be split at a hot key.
    """
    rows = sets.where("size(keys) > 0").select("set_id", F.col("n_shingles").cast("int").alias("n"), "lists", F.col("leads").alias("_leads"), F.posexplode("keys").alias("at", "key"))
    listed = F.col("at") < F.col("lists")
    rows = rows.select(
        "key", "set_id", "n", F.when(listed, F.col("at")).otherwise(0).alias("place"),
        (~listed | (F.col("at") < F.col("_leads"))).alias("leads"), F.when(listed, 1).otherwise(SHARED).alias("weight"),
    )
    several = rows.groupBy("key").agg(F.min("set_id").alias("lo"), F.max("set_id").alias("hi"), F.max("leads").alias("led")).where("lo <> hi AND led").select("key")
    return rows.join(several, "key").distinct()


def _enough(percent: int, n, m):
    """The summed weight that a pair of these sizes has if it links."""
    return F.least(F.lit(SHARED), F.ceil(F.least(n, m) * percent / 100))


def _can_link(percent: int, n, m, place, other):
    """Whether two sets that meet at these places can link. One of their first SHARED common shingles is there, and what comes behind bounds the overlap."""
    need = F.ceil((n + m) * percent / (100 + percent))
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (F.least(n - place, m - other) >= need - _enough(percent, n, m) + 1)


def _rank(turn: int):
    """Who leads a list: of the sets that may, the one with the fewest shingles of its own before the shared one, for of near copies it is the nearest to what they are copies of."""
    return F.shiftleft(F.col("place").cast("long"), 32) + F.pmod(F.xxhash64("set_id", F.lit(turn)), F.lit(1 << 32))


def _open(now: DataFrame, turn: int) -> DataFrame:
    """Lists in which sets of several labels meet: key, pairs (at most), the most frequent label (major), and the rank of the leader."""
    per_label = now.groupBy("key", "label").agg(F.count("*").alias("n"), F.count_if("leads").alias("led"), F.min(F.when(F.col("leads"), _rank(turn))).alias("first"))
    own = F.col("n").cast("double") * F.col("led")
    per_key = per_label.groupBy("key").agg(F.sum("n").alias("n"), F.sum("led").alias("led"), F.sum(own).alias("own"), F.max_by("label", "n").alias("major"), F.min("first").alias("first"))
    return per_key.withColumn("pairs", F.col("n").cast("double") * F.col("led") - F.col("own")).where("pairs > 0").select("key", "pairs", "major", "first")


def _pairs(met: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b, weight) that share enough lists, from rows (a, b, n, m, weight) of lists."""
    return met.groupBy("a", "b", "n", "m").agg(F.sum("weight").alias("weight")).where(F.col("weight") >= _enough(percent, F.col("n"), F.col("m")))


def _led(now: DataFrame, opened: DataFrame, turn: int, percent: int) -> DataFrame:
    """Pairs of each set and a list's leader with another label."""
    first = now.join(opened.select("key", "first"), "key").where(F.col("leads") & (_rank(turn) == F.col("first")))
    leaders = first.select("key", F.col("set_id").alias("a"), F.col("n").alias("m"), F.col("label").alias("leading"), F.col("place").alias("other"))
    met = now.join(leaders, "key").where((F.col("label") != F.col("leading")) & _can_link(percent, F.col("n"), F.col("m"), F.col("place"), F.col("other")))
    return _pairs(met.select("a", F.col("set_id").alias("b"), "n", "m", "weight"), percent)


def _apart(now: DataFrame, opened: DataFrame, percent: int) -> DataFrame:
    """All pairs of sets that meet in lists at places that allow a link, and have different labels."""
    marked = now.join(opened.select("key", "major"), "key")
    rest = marked.where("label <> major").select("key", F.col("set_id").alias("b"), F.col("n").alias("m"), F.col("label").alias("theirs"), F.col("place").alias("other"), F.col("leads").alias("leading"))
    once = (F.col("label") == F.col("major")) | (F.col("set_id") < F.col("b"))
    smaller = F.when(F.col("n") <= F.col("m"), F.col("leads")).otherwise(F.col("leading")) | ((F.col("n") == F.col("m")) & F.col("leading"))
    met = marked.join(rest, "key").where((F.col("label") != F.col("theirs")) & once & smaller & _can_link(percent, F.col("n"), F.col("m"), F.col("place"), F.col("other")))
    swap = F.col("set_id") > F.col("b")
    met = met.select(
        F.least("set_id", "b").alias("a"), F.greatest("set_id", "b").alias("b"),
        F.when(swap, F.col("n")).otherwise(F.col("m")).alias("n"), F.when(swap, F.col("m")).otherwise(F.col("n")).alias("m"), "weight",
    )
    return _pairs(met, percent)


def linked_pairs(docs: DataFrame, known: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b of set ids; a is the centre) that link. ``known`` has a row (set_id, doc_id, text_key) of each set."""
    degree = pairs.groupBy("a").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    dealt = pairs.select("a", "b").join(degree, "a").select(F.col("a").alias("centre"), F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b")
    dealt = shared.materialize(dealt, "pairs")
    to = dealt.select("centre", "part", F.lit(1).alias("role"), F.col("b").alias("set_id"))
    to = to.union(dealt.select("centre", "part").distinct().select("centre", "part", F.lit(0).alias("role"), F.col("centre").alias("set_id")))
    wanted = shared.materialize(known.join(to.select("set_id").distinct(), "set_id").select("doc_id", "text_key").distinct(), "wanted")
    few = wanted.count() <= BROADCAST_ROWS
    wanted = wanted.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
    text = _rows(docs)
    text = text.join(F.broadcast(wanted) if few else wanted, text.doc_id.eqNullSafe(wanted._id) & (text.text_key == wanted._key), "left_semi")

    def expand(batches):
        shared.own_worker("jaccard")
        seen: set[int] = set()
        for batch in batches:
            ids, sets = [], []
            for _, own in _sets(batch, 2, size):
                if len(own) and (one := identity(own)) not in seen:
                    seen.add(one)
                    ids.append(one)
                    sets.append(own.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], names=["set_id", "hashes"])

    # Where pairs are many, sets are exchanged by their ids first.
    sent = text.mapInArrow(expand, "set_id long, hashes binary").join(F.broadcast(to) if dealt.count() <= BROADCAST_ROWS else to, "set_id")

    def compare(batches):
        held, centre = None, None
        for batch in batches:
            found = []
            for at, part, role, one, data in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                own = np.frombuffer(data, np.uint64)
                if not role:
                    held, centre = (at, part), own
                    continue
                if held != (at, part):
                    raise ValueError("a part has no centre")
                place = np.minimum(np.searchsorted(centre, own), len(centre) - 1)
                both = int((centre[place] == own).sum())
                if 100 * both >= percent * (len(own) + len(centre) - both):
                    found.append((at, one))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    ordered = sent.select("centre", "part", "role", "set_id", "hashes").repartition("centre", "part").sortWithinPartitions("centre", "part", "role")
    return ordered.mapInArrow(compare, "a long, b long")


def similar_sets(docs: DataFrame, size: int = 4, percent: int = 85, rounds: int = 4, light: int | None = None) -> DataFrame:
    """Each row's doc_id, text_key, n_shingles, set_id, component (a set_id) and component_id over texts in ``docs`` (doc_id, text).

    ``light`` sets the boundary by hand. Results depend on neither it nor ``rounds``.
    """
    with shared.scratch(docs.sparkSession) as kept:
        long, mean_list = long_lists(list_lengths(docs, size))
        light = boundary(mean_list, percent) if light is None else light
        sets = shared.materialize(signatures(docs, size, percent, light, long), "sets")
        lists = shared.materialize(shared_lists(sets), "lists")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")).alias("first")
        known = sets.where("set_id IS NOT NULL").groupBy("set_id").agg(first).select("set_id", "first.doc_id", "first.text_key")
        known = shared.materialize(known, "known")

        spark = docs.sparkSession
        labels = spark.createDataFrame([], "node long, label long")
        links = checked = spark.createDataFrame([], "a long, b long")
        entries = lists.count()
        for turn in range(rounds + 1):
            now = lists.join(labels, lists.set_id == labels.node, "left").select("key", "set_id", "n", "place", "leads", "weight", F.coalesce("label", "set_id").alias("label"))
            opened = shared.materialize(_open(now, turn), "open")
            left = opened.agg(F.coalesce(F.sum("pairs"), F.lit(0.0))).first()[0]
            if not left:
                break
            last = turn == rounds or (turn > 0 and (left <= entries or left > 0.9 * before))
            before = left
            asked = _apart(now, opened, percent) if last else _led(now, opened, turn, percent)
            asked = asked.select("a", "b", "weight").join(checked, ["a", "b"], "left_anti")
            if not last:
                best = Window.partitionBy("b").orderBy(F.desc("weight"), "a")
                asked = asked.withColumn("best", F.row_number().over(best)).where("best = 1")
            asked = shared.materialize(asked.select("a", "b"), "asked")
            links = shared.materialize(links.union(linked_pairs(docs, known, asked, size, percent)), "links")
            checked = checked.union(asked).union(asked.select(F.col("b").alias("a"), F.col("a").alias("b")))
            labels = shared.materialize(components(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))), "labels")
            if last:
                break
        kept(sets, known, labels)

    named = known.select("set_id", "doc_id").join(labels.select(F.col("node").alias("set_id"), "label"), "set_id", "left")
    named = named.select("set_id", "doc_id", F.coalesce("label", "set_id").alias("component"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of = named.select("set_id", "component").join(least, "component")
    # Many rows can have one set; the other side has a row for each set, so skew handling can split them.
    out = sets.select("doc_id", "text_key", "n_shingles", "set_id").join(of, "set_id", "left")
    return out.select("doc_id", "text_key", "n_shingles", "set_id", "component", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` less all but one row of each component: the one with the least doc_id stays (nulls last, then by text hash).

    Rows with the empty set all stay. Rows that repeat in doc_id and text all go or all stay. The rows
    that go are a narrow list; texts aren't shuffled for it unless it is long. Columns may have any names.
    """
    found = shared.materialize(similar_sets(docs, size, percent).where("component IS NOT NULL").select("doc_id", "text_key", "component"), "similar")
    place = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.col("text_key"))
    stays = found.groupBy("component").agg(F.min(place).alias("stays"), F.count("*").alias("n")).where("n > 1").select("component", "stays")
    gone = found.join(stays, "component").where(~((F.col("text_key") == F.col("stays.text_key")) & F.col("doc_id").eqNullSafe(F.col("stays.doc_id"))))
    gone = shared.materialize(gone.select("doc_id", "text_key").distinct(), "gone")
    few = gone.count() <= BROADCAST_ROWS
    gone = gone.select(F.struct("doc_id", "text_key").alias("_gone"))
    # One struct column on the left holds the row, so no column name can clash.
    rows = docs.select(F.struct("*").alias("_row"), F.struct("doc_id", text_key().alias("text_key")).alias("_at"))
    same = F.col("_at.doc_id").eqNullSafe(F.col("_gone.doc_id")) & (F.col("_at.text_key") == F.col("_gone.text_key"))
    return rows.join(F.broadcast(gone) if few else gone, same, "left_anti").select("_row.*")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's set size and the smallest doc_id of its component, over whole texts."""
    return similar_sets(shared.documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")
