"""Scoring by prediction by partial matching over byte contexts.

What is scored is the text's token sequence: each word's bytes (A-Z in lower case) and a blank, then
one end symbol. The trie holds, for contexts of 0 to ``order`` bytes, how often each symbol followed
in the training texts. A symbol is coded in the longest known context; if it was never seen there,
an escape (half a count for each distinct symbol of the context: method D) leads to the next
shorter context, where the symbols of the longer one are excluded, and at last to a uniform code.

Counts come from all training texts: a task counts what it reads, and tasks' counts are added by
key. The trie is a table and keeps every node: it is dealt out by the last ``NEAR`` bytes of the context, so
that a task has a context and all its suffixes down to those bytes, and lower orders as sums of the
highest; the orders below, which the alphabet bounds, are sent to all tasks. Each task gives the
probabilities of its keys. A text's frequent keys are looked up in a table of the ``cached`` most
used ones that all tasks get, its others by a join; that size decides only where a key is looked up.

The word model that it is held against needs the count of every word. The ``common`` most frequent
words are sent to all tasks (a bounded table); a text's other words are looked up by a join.

Cases: null and empty texts and texts of spaces are their end symbol alone; rows with null doc_id
count as held out (the remainder of an empty string is 0); repeated rows and doc_ids are scored and
counted each; without training rows every symbol is uniform and every base probability 0.1/(0.1);
an empty table gives an empty table; further columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .words import _SPACE, LOWER, mix, slices, words

ORDER = 6
END = 10
#: The key of the end token among word hashes.
END_WORD = int(mix(np.array([END], np.uint64))[0].view(np.int64))
#: Values that a task holds before it adds them up, and bytes of text that it takes apart at once.
_HELD = 500_000
_AT_ONCE = 1 << 18
#: Bytes of a context by which the trie is dealt out, and keys a task gets of it.
NEAR = 3
_DEALT = 250_000


def stream(octets: np.ndarray, offsets: np.ndarray, firsts: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts one after another, each followed by ``order`` ends (and as many before all), and the place where each text begins (and the end)."""
    space = _SPACE[octets]
    at = np.flatnonzero(~space)
    edge = np.zeros(len(octets) + 1, bool)
    edge[offsets] = True
    before = edge[:-1].copy()
    before[1:] |= space[:-1]
    word = (np.cumsum(before & ~space) - 1)[at]
    text = np.searchsorted(firsts, word, "right") - 1
    letters = np.searchsorted(at, offsets)
    begins = letters + firsts + order * np.arange(len(offsets)) + order
    out = np.full(int(begins[-1]), END, np.uint8)
    ends = np.zeros(len(out) + 1, bool)
    where = np.arange(len(at)) + word + order * text + order
    out[where] = LOWER[octets[at]]
    # A blank follows each word: the place after a word's last letter.
    last = np.flatnonzero(np.concatenate([word[1:] != word[:-1], [True]])) if len(word) else at
    out[where[last] + 1] = 32
    del ends
    return out, begins


def grams(symbols: np.ndarray, begins: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys (``order`` bytes of context and the symbol) of all symbols that count, and each text's first among them."""
    wide = symbols.astype(np.uint64)
    n = len(wide) - order
    keys = np.zeros(n, np.uint64)
    for k in range(order + 1):
        keys = (keys << np.uint64(8)) | wide[k : k + n]
    # Of a text's `order` ends the first counts.
    counts = np.ones(n + 1, bool)
    for k in range(1, order):
        counts[begins[1:] - order - k] = False
    return keys[counts[:n]], begins - order - (order - 1) * np.arange(len(begins))


class _Adder:
    """Counts of 64-bit keys, added up whenever many are held."""

    def __init__(self):
        self.held, self.size, self.keys, self.counts = [], 0, np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray) -> None:
        self.held.append(keys)
        self.size += len(keys)
        if self.size >= _HELD:
            self.fold()

    def fold(self) -> None:
        if self.held:
            keys, counts = np.unique(np.concatenate(self.held), return_counts=True)
            both = np.concatenate([self.keys, keys])
            self.keys, where = np.unique(both, return_inverse=True)
            self.counts = np.bincount(where, np.concatenate([self.counts, counts])).astype(np.int64)
            self.held, self.size = [], 0


def counts(docs: DataFrame, order: int = ORDER, held_out: Column | None = None) -> DataFrame:
    """(kind, key, n, used): kind 0 are words and the end token, kind 1 symbols in their context of ``order`` bytes. ``n`` counts training texts; ``used`` also those ``held_out``, whose words are left out."""

    def count(batches):
        shared.own_worker("ppm", _built.clear)
        found, texts = (_Adder(), _Adder(), _Adder()), 0

        def flush():
            for at, adder in enumerate(found):
                adder.fold()
                for i in range(0, len(adder.keys), 1 << 18):
                    part, n = adder.keys[i : i + (1 << 18)], adder.counts[i : i + (1 << 18)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), min(at, 1), np.int8)), pa.array(part.view(np.int64)), pa.array(n if at < 2 else np.zeros_like(n)), pa.array(n)], names=["kind", "key", "n", "used"])
                adder.__init__()

        for batch in batches:
            for out in (False, True):
                for part, octets, offsets in slices(batch.filter(pc.equal(batch.column(1), out)), 0, _AT_ONCE):
                    hashes, firsts = words(octets, offsets)
                    found[1 + out].add(grams(*stream(octets, offsets, firsts, order), order)[0])
                    if not out:
                        found[0].add(hashes)
                        texts += part.num_rows
                    if max(len(adder.keys) for adder in found) > _HELD:
                        yield from flush()
        yield from flush()
        if texts:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int8()), pa.array([END_WORD], pa.int64()), pa.array([texts], pa.int64()), pa.array([texts], pa.int64())], names=["kind", "key", "n", "used"])

    out = F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(True))
    made = docs.select(shared.text_or_empty().alias("text"), out.alias("out")).mapInArrow(count, "kind byte, key long, n long, used long")
    return made.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("used").alias("used"))


def _find(keys: np.ndarray, ask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``ask`` in sorted ``keys`` and whether they are there."""
    if not len(keys):
        return np.zeros(len(ask), np.int64), np.zeros(len(ask), bool)
    at = np.minimum(np.searchsorted(keys, ask), len(keys) - 1)
    return at, keys[at] == ask


class Trie:
    """Pretrained PPM. ``levels[i]`` are (sorted keys of i+1 bytes, counts)."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]]):
        self.order, self.grams, self.contexts = len(levels) - 1, [], []
        for keys, n in levels:
            self.grams.append((keys, n.astype(np.float64)))
            names, first = np.unique(keys >> np.uint64(8), return_index=True) if len(keys) else (keys, np.zeros(0, np.int64))
            sums = np.add.reduceat(n, first).astype(np.float64) if len(keys) else np.zeros(0)
            self.contexts.append((names, sums, np.diff(np.append(first, len(keys))).astype(np.float64)))
        # For each context, how much of its suffix's count belongs to its own symbols: what exclusion takes away.
        self.excluded = [None]
        for i in range(1, len(levels)):
            keys = self.grams[i][0]
            suffix = keys & np.uint64((1 << (8 * i)) - 1)
            at, there = _find(self.grams[i - 1][0], suffix)
            less = np.where(there, self.grams[i - 1][1][at] if len(self.grams[i - 1][1]) else 0.0, 0.0)
            first = np.concatenate([[0], np.cumsum(self.contexts[i][2])[:-1]]).astype(np.int64) if len(keys) else np.zeros(0, np.int64)
            self.excluded.append(np.add.reduceat(less, first) if len(keys) else np.zeros(0))

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """log10 of the probability of each key's last symbol after the bytes before it."""
        out, left = np.zeros(len(keys)), np.arange(len(keys))
        less, fewer = np.zeros(len(keys)), np.zeros(len(keys))  # what the longer context excludes
        for i in range(self.order, -1, -1):
            own = keys[left] & np.uint64((1 << (8 * (i + 1))) - 1)
            names, sums, distinct = self.contexts[i]
            c, known = _find(names, own >> np.uint64(8))
            if not known.any():
                continue
            g, seen = _find(self.grams[i][0], own)
            total, kinds = sums[c] - less[left], distinct[c] - fewer[left]
            whole = 2 * total
            with np.errstate(divide="ignore", invalid="ignore"):
                hit = np.log10((2 * self.grams[i][1][g] - 1) / whole)
                # Where exclusion leaves nothing, the escape is certain.
                miss = np.where(kinds > 0, np.log10(kinds / whole), 0.0)
            out[left] += np.where(known, np.where(seen, hit, miss), 0.0)
            if i:
                less[left] = np.where(known, self.excluded[i][c], less[left])
            fewer[left] = np.where(known, distinct[c], fewer[left])
            # An unknown context excludes nothing and costs nothing; what it came from can't be known either.
            left = left[~seen]
        out[left] -= np.log10(256.0 - np.minimum(fewer[left], 255.0))
        return out


def fit(counted: DataFrame, order: int = ORDER) -> list[tuple[np.ndarray, np.ndarray]]:
    """The levels of a ``Trie`` in memory, with every node, from a small table of ``counts``. ``probabilities`` is for tables of any size."""
    table = counted.where("kind = 1 AND n > 0").select("key", "n").toArrow()
    keys, n = table.column("key").to_numpy().astype(np.uint64), table.column("n").to_numpy()
    found = [_shorter(keys, n, order)]
    for i in range(order - 1, -1, -1):
        found.insert(0, _shorter(*found[0], i))
    return found


def _shorter(keys: np.ndarray, n: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the keys' last ``order`` bytes of context and symbol."""
    short, where = np.unique(keys & np.uint64((1 << (8 * (order + 1))) - 1), return_inverse=True)
    return short, np.bincount(where, n, len(short)).astype(np.int64)


def probabilities(counted: DataFrame, order: int = ORDER, dealt: int | None = None) -> DataFrame:
    """(key, used, p): log10 of the probability of each key of ``counts``, with every node of the trie."""
    keys = counted.where("kind = 1").select("key", "n", "used")
    near = min(NEAR, order)
    low = keys.where("n > 0").groupBy(F.col("key").bitwiseAND((1 << (8 * near)) - 1).alias("key")).agg(F.sum("n").alias("n")).toArrow()
    low_keys, low_n = low.column("key").to_numpy().astype(np.uint64), low.column("n").to_numpy()
    lower = keys.sparkSession.sparkContext.broadcast([_shorter(low_keys, low_n, i) for i in range(near)])

    def run(batches):
        shared.own_worker("ppm", _built.clear)
        held = [tuple(batch.column(k).to_numpy() for k in range(3)) for batch in batches]
        if not held:
            return
        own, n, used = (np.concatenate([h[k] for h in held]) for k in range(3))
        del held
        own, seen = own.astype(np.uint64), n > 0
        higher = [_shorter(own[seen], n[seen], order)]
        for i in range(order - 1, near - 1, -1):
            higher.insert(0, _shorter(*higher[0], i))
        model = Trie(lower.value + higher)
        for i in range(0, len(own), 1 << 18):
            part = slice(i, i + (1 << 18))
            yield pa.RecordBatch.from_arrays([pa.array(own[part].view(np.int64)), pa.array(used[part]), pa.array(model.log10(own[part]))], names=["key", "used", "p"])

    dealt = dealt or max(keys.sparkSession.sparkContext.defaultParallelism, -(-keys.count() // _DEALT))
    by = F.shiftright("key", 8).bitwiseAND((1 << (8 * near)) - 1)
    return keys.repartition(dealt, by).mapInArrow(run, "key long, used long, p double")


def _most_used(table: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and values of at most ``size`` of the keys that are used most."""
    least, held = 0, 0
    for r in table.groupBy(F.floor(8 * F.log2("used")).alias("at")).count().orderBy(F.desc("at")).collect():
        held += r["count"]
        if held > size:
            least = r["at"] + 1
            break
    top = table.where(F.floor(8 * F.log2("used")) >= least).select("key", "p").toArrow()
    keys, p = top.column("key").to_numpy().astype(np.uint64), top.column("p").to_numpy()
    by = np.argsort(keys)
    return keys[by], p[by]


#: The trie that a worker built last, with the number of its broadcast.
_built: dict[int, Trie] = {}


def _trie(number: int, levels: list) -> Trie:
    if number not in _built:
        _built.clear()
        _built[number] = Trie(levels)
    return _built[number]


def score(docs: DataFrame, levels: list | DataFrame, counted: DataFrame, held_out: Column, common: int = 1 << 17, cached: int = 1_500_000, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of ``docs`` (doc_id, text).

    ``levels`` are those of a trie in memory, or the table of ``probabilities`` of order ``order`` over all of ``docs``."""
    from pyspark import TaskContext

    table = levels if isinstance(levels, DataFrame) else None

    spark = docs.sparkSession
    vocabulary = counted.where("kind = 0").select("key", "n")
    totals = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    top = vocabulary.orderBy(F.desc("n"), "key").limit(common).toArrow()
    keys, n = top.column("key").to_numpy(), top.column("n").to_numpy()
    by = np.argsort(keys)
    whole_trie = table is None
    held = spark.sparkContext.broadcast((levels if whole_trie else _most_used(table, cached), keys[by], np.log10(n[by] + 0.1), int(totals.n)))
    order, number = len(levels) - 1 if whole_trie else order, held._jbroadcast.id()
    names = ["doc_id", "held_out", "row", "n_tokens", "known", "sum", "score", "rare", "rare_keys"]
    types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def run(batches):
        shared.own_worker("ppm", _built.clear)
        tables, common_keys, logs, _ = held.value
        model = _trie(number, tables) if whole_trie else None
        common_keys, row = common_keys.view(np.uint64), TaskContext.get().partitionId() << 33
        sort = np.argsort(common_keys)
        common_keys, logs = common_keys[sort], logs[sort]
        end_at, end_known = _find(common_keys, np.array([END_WORD], np.int64).view(np.uint64))
        for batch in batches:
            for part, octets, offsets in slices(batch, 2, _AT_ONCE):
                hashes, firsts = words(octets, offsets)
                keys, begins = grams(*stream(octets, offsets, firsts, order), order)
                distinct, where = np.unique(keys, return_inverse=True)
                if model:
                    p, cached_there = model.log10(distinct), np.ones(len(distinct), bool)
                else:
                    at, cached_there = _find(tables[0], distinct)
                    p = np.where(cached_there, tables[1][at] if len(tables[1]) else 0.0, 0.0)
                sums = np.concatenate([[0.0], np.cumsum(p[where])])
                asked = ~cached_there[where]
                asked_of = np.concatenate([[0], np.cumsum(asked)])[begins]
                key_lists = pa.ListArray.from_arrays(pa.array(asked_of.astype(np.int32)), pa.array(keys[asked].view(np.int64)))
                at, there = _find(common_keys, hashes)
                word_sums = np.concatenate([[0.0], np.cumsum(np.where(there, logs[at], 0.0) if len(logs) else np.zeros(len(hashes)))])
                known = np.concatenate([[0], np.cumsum(there)])
                a, b, rows = firsts[:-1], firsts[1:], part.num_rows
                end = float(logs[end_at[0]]) if end_known[0] else None
                rare_of = np.cumsum(np.concatenate([[0], ~there]))
                lists = pa.ListArray.from_arrays(pa.array(rare_of[firsts].astype(np.int32)), pa.array(hashes[~there].view(np.int64)))
                if end is None:  # the end token is not among the common: it is looked up as a rare word
                    lists = pa.array([[*x, END_WORD] for x in lists.to_pylist()], types[-1])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(row + np.arange(rows)), pa.array(b - a + 1), pa.array(known[b] - known[a] + (end is not None)),
                     pa.array(word_sums[b] - word_sums[a] + (end or 0.0)), pa.array(sums[begins[1:]] - sums[begins[:-1]]), lists, key_lists], names=names)
                row += rows

    schema = "doc_id long, held_out boolean, row long, n_tokens long, known long, sum double, score double, rare array<long>, rare_keys array<long>"
    made = shared.materialize(docs.select("doc_id", held_out.alias("held_out"), shared.text_or_empty().alias("text")).mapInArrow(run, schema), "scored")
    rare = made.select("row", F.explode("rare").alias("key")).join(vocabulary, "key", "left")
    rare = rare.groupBy("row").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.1)).alias("rare_sum"), F.count("n").alias("rare_known"))
    out = made.select("doc_id", "held_out", "row", "n_tokens", "known", "sum", "score").join(rare, "row", "left")
    if table is not None:
        asked = made.select("row", F.explode("rare_keys").alias("key")).join(table.select("key", "p"), "key")
        out = out.join(asked.groupBy("row").agg(F.sum("p").alias("asked_sum")), "row", "left").withColumn("score", F.col("score") + F.coalesce("asked_sum", F.lit(0.0)))
    whole = float(np.log10(totals.n + 0.1 * (totals.v + 1)))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(int(totals.n)).cast("long").alias("train_tokens"),
        (F.col("sum") + F.coalesce("rare_sum", F.lit(0.0)) - F.col("n_tokens") * F.lit(whole)).alias("base_score"),
        "score",
    )


def op7_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.documents(spark, sf_dir)
    out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(10)) == 0
    counted = shared.materialize(counts(docs, held_out=out), "counts")
    return score(docs, shared.materialize(probabilities(counted), "probabilities"), counted, out)
