"""N-gram Jaccard join by universe partition and pigeonhole, exact at its threshold.

A text's set holds the 64-bit hashes of its distinct word n-grams.  If two sets reach the threshold, they differ in
at most H elements, H set by the larger size.  Per size band the universe of hashes is cut into m segments; with
budgets of 1 (equal content) or 2 (content equal up to one deletion on either side) that add up to H + 1 + s, the
segments of every such pair that meet their budget have budgets of at least s + 1.  So each set is indexed under the
contents of its segments, and under one-deletion neighbours of the segments with budget 2.

Empty contents would meet by chance.  A set whose segments that can meet in an empty content (empty ones; with budget 2
also those of one element) have budgets of at most s in all meets each of its partners in another segment too, so it
leaves its empty contents out.  Only sets with more (sparse sets) index them, and two such sets meet there as before.
Segments, deletions and s are allotted for each band from its number of documents by the cost of keys and of chance
matches.  A set is indexed in its own band and, where a larger partner may lie there, in the next.

The spare budget filters by count: a set with a partner shares with it at least s + 1 less its own light budgets (half
as many with deletions) of a band's keys.  Sets that share fewer keys with all others together have no partner.

Equal sets (a class: two 64-bit fingerprints) enter once.  The index knows a class by its first fingerprint only; should two
classes share it, both are compared.  Keys meet in hash buckets as packed runs; classes of one slice of texts that share a key
are grouped there already and send the key once, as a node of their own, so a key has no more entries in its bucket
than there are slices.  Classes that share keys, directly or through others, are a family; in a small family all sets are
compared exactly, as differences from what most of them hold.  A large family is first cut into parts, each compared with
some pivots too; then its parts are compared two by two, but for parts of one component that this has found.

Defined cases: null, empty and blank texts have the empty set and are linked with nothing; a text with fewer words
than an n-gram is one n-gram; repeated rows and null ids are linked by their sets like any others (a component's id
is its smallest id that is not null); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pixelwell.llm import blocks as B
from pixelwell.llm.components import components, gathered

WIDTH, PART, WHOLE = 5, 80, 100
GROWTH = 1.4
SLICE_BYTES = 4 << 20
#: Candidate ids are broadcast up to this many, and joined by a shuffle beyond.
MAX_BROADCAST_IDS = 500_000
#: Cost of comparing a chance pair, in keys.
PAIR_COST = 20.0
#: Classes of a family that meet in one task (two chunks at most).
CHUNK = 1_000
#: Elements of sets that meet in one task, and raw text whose keys a bucket takes.
ITEMS, BUCKET_BYTES = 2_000_000, 32 << 20
#: Pivots of a large family, on average.
PIVOTS = 32


@dataclass(frozen=True)
class Band:
    low: int
    high: int
    segments: int
    deletions: int  # the first so many segments have budget 2
    spare: int = 0  # budgets beyond H + 1


def allot(low: int, high: int, docs: float, part: int, whole: int) -> tuple[int, int, int]:
    """Segments, how many of them have budget 2, and the spare budget, by least cost over some allotments."""
    need = 2 * high * (whole - part) // (whole + part) + 1
    best = (math.inf, need, 0, 0)
    sizes = (max(1.0, low * part / whole), low, math.sqrt(low * high), high)
    for spare in sorted({math.ceil(need * k / 40) for k in (0, 1, 2, 3, 4, 6, 8, 12, 16, 24) if k >= 4 or need < 8}):
        total = need + spare
        for d in sorted({0, total // 8, total // 4, 3 * total // 8, total // 2}):
            m, cost = total - d, 0.0
            for n in sizes:
                x = n / m
                empty, light = math.exp(-x), math.exp(-x) * (1 + x)
                mean, var = (m - d) * empty + 2 * d * light, (m - d) * empty + 4 * d * light
                sparse = 0.5 * math.erfc((spare + 0.5 - mean) / math.sqrt(2 * var)) if var else 0.0
                met = docs * sparse
                chance = ((m - d) * (met * empty) ** 2 + d * (met * light) ** 2) / 2
                cost += docs * (m * (1 - empty) + d * x) + PAIR_COST * chance
            best = min(best, (cost, m, d, spare))
    return best[1:]


def make_bands(largest: int, docs_of_size, part: int, whole: int) -> list[Band]:
    """Bands up to the largest possible set; docs_of_size(low, high) estimates their documents."""
    out, low = [], 1
    while low <= largest or not out:
        high = max(low, int(low * GROWTH))
        while 2 * (high + 1) * (whole - part) // (whole + part) < 1:
            high += 1
        out.append(Band(low, high, *allot(low, high, max(1.0, docs_of_size(low, high)), part, whole)))
        low = high + 1
    return out


class Shingler:
    """Sets of n-gram hashes of texts, one ascending array for all texts of a slice, without duplicates in a text."""

    def __init__(self, width: int) -> None:
        self.width, self.hasher = width, B.WordHasher()
        self.odd = (B.mix64(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)).astype(np.uint64)

    def sets(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Elements, and the number of elements of each text."""
        h, n = self.hasher(data, offsets)
        w = self.width
        ends = np.cumsum(n)
        grams = np.maximum(n - w + 1, 0)
        short = np.flatnonzero((n > 0) & (n < w))
        acc = np.zeros(max(0, len(h) - w + 1), np.uint64)
        for k in range(w if len(acc) else 0):
            acc += h[k : len(h) - w + 1 + k] * self.odd[k]
        # Positions from which a whole n-gram of the same text starts.
        left = np.repeat(ends, n) - np.arange(len(h))
        full = np.flatnonzero(left >= w)
        values = B.mix64(acc[full]) if len(full) else np.zeros(0, np.uint64)
        if len(short):
            own = np.array([B.mix64(np.array([(h[ends[i] - n[i] : ends[i]] * self.odd[: n[i]]).sum(dtype=np.uint64) + np.uint64(n[i])]))[0] for i in short], np.uint64)
            at = np.cumsum(grams)[short]
            values = np.insert(values, at, own)
            grams = grams.copy()
            grams[short] = 1
        cuts = np.concatenate(([0], np.cumsum(grams)))
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if e - s > 1:
                values[s:e].sort()
        if len(values):
            new = np.ones(len(values), bool)
            new[1:] = values[1:] != values[:-1]
            new[cuts[:-1][grams > 0]] = True
            owner = np.repeat(np.arange(len(grams)), grams)
            grams, values = np.bincount(owner[new], minlength=len(grams)), values[new]
        return values, grams

    @staticmethod
    def fingerprints(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two of each set.  The first is even; odd numbers are for groups of classes."""
        doc, n = np.repeat(np.arange(len(sizes)), sizes), len(sizes)
        one = B.mix64(_sums(B.mix64(values + np.uint64(77)), doc, n) + sizes.astype(np.uint64)) & ~np.uint64(1)
        return one, B.mix64(_sums(B.mix64(values ^ np.uint64(0xD6E8FEB86659FD93)), doc, n) + sizes.astype(np.uint64))


def shared_by(keys: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which keys several prints share: ident, print, band's last bit and number of keys of each, and the shared keys with their idents.

    Keys of even or of odd bands that the same prints share have one (odd) ident.
    """
    order = np.lexsort((prints, keys))
    keys, prints = keys[order], prints[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (prints[1:] != prints[:-1])
    keys, prints = keys[new], prints[new]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    group = np.cumsum(first) - 1
    many = np.bincount(group)[group] > 1 if len(keys) else first
    keys, group, prints = keys[many], group[many], prints[many]
    odd = keys & np.uint64(1)
    total = int(group.max()) + 1 if len(group) else 0
    ident = (_sums(B.mix64(prints + np.uint64(5) + odd), group, total) | np.uint64(1))[group]
    lead = np.ones(len(keys), bool)
    lead[1:] = group[1:] != group[:-1]
    met_keys, met_ident = keys[lead], ident[lead]
    order = np.lexsort((odd, prints, ident))
    ident, prints, odd = ident[order], prints[order], odd[order]
    first = np.ones(len(ident), bool)
    first[1:] = (ident[1:] != ident[:-1]) | (prints[1:] != prints[:-1]) | (odd[1:] != odd[:-1])
    at = np.flatnonzero(first)
    return ident[at], prints[at], odd[at], np.diff(at, append=len(ident)), met_keys, met_ident


def _sums(x: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Sums of uint64 by index, modulo 2^64 (exact: halves are added as floats below 2^53)."""
    low = np.bincount(at, weights=(x & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=n)
    high = np.bincount(at, weights=(x >> np.uint64(32)).astype(np.float64), minlength=n)
    return low.astype(np.uint64) + (high.astype(np.uint64) << np.uint64(32))


def index_keys(values: np.ndarray, sizes: np.ndarray, bands: list[Band], part: int, whole: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of all sets, the set each belongs to, and how many keys of an even and of an odd band a set shares with any partner there.

    The last bit of a key is its band's, so it tells a set's own band from the next.
    """
    lows = np.array([b.low for b in bands])
    m_of, d_of, s_of = (np.array([getattr(b, name) for b in bands]) for name in ("segments", "deletions", "spare"))
    own = np.searchsorted(lows, sizes, "right") - 1
    keys, owners, needs = [], [], np.ones((2, len(sizes)), np.int32)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    content = B.mix64(values + np.uint64(1234567))
    for step in (0, 1):
        band = own + step
        ok = (sizes > 0) & (band < len(bands))
        if step:
            ok &= whole * sizes >= part * lows[np.minimum(band, len(bands) - 1)]
        band = np.minimum(np.maximum(band, 0), len(bands) - 1)
        m = np.where(ok, m_of[band], 0)
        first = np.concatenate(([0], np.cumsum(m)))
        total = int(first[-1])
        if not total:
            continue
        use = ok[doc]
        d, v, c = doc[use], values[use], content[use]
        segment = ((B.mix64(v + band[d].astype(np.uint64)) >> np.uint64(32)) * m[d].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        where = first[d] + segment
        held, count = _sums(c, where, total), np.bincount(where, minlength=total)
        who = np.repeat(np.arange(len(sizes)), m)
        nth = np.arange(total) - first[who]
        place = B.mix64(band[who].astype(np.uint64) << np.uint64(32) | nth.astype(np.uint64))
        double = nth < d_of[band[who]]
        light = np.where(double, 2 * (count <= 1), count == 0)
        over = s_of[band] - np.bincount(who, weights=light, minlength=len(sizes)).astype(np.int64)
        sparse, odd = over < 0, (band & 1).astype(np.uint64)
        shares = np.where(sparse, 1, (over + 1 + (d_of[band] > 0)) // (1 + (d_of[band] > 0)))
        needs[band[ok] & 1, np.flatnonzero(ok)] = shares[ok]
        keep = (count > 0) | sparse[who]
        keys.append((B.mix64(held + place) & ~np.uint64(1) | odd[who])[keep])
        owners.append(who[keep])
        drop = double[where] & ((count[where] > 1) | sparse[d])
        if drop.any():
            keys.append(B.mix64(held[where[drop]] - c[drop] + place[where[drop]]) & ~np.uint64(1) | odd[d[drop]])
            owners.append(d[drop])
    return (np.concatenate(keys), np.concatenate(owners), needs) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64), needs)


def _slices(offsets: np.ndarray):
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def _bands_for(docs: DataFrame, part: int, whole: int) -> list[Band]:
    """Bands from the lengths of all texts: 64 numbers, one for each power of sqrt(2) of bytes."""
    size = F.octet_length(F.coalesce("text", F.lit("")))
    step = F.floor(2 * F.log2(F.greatest(size, F.lit(1)))).cast("int").alias("step")
    counts = {r["step"]: r["n"] for r in docs.select(step).groupBy("step").agg(F.count("*").alias("n")).collect()}
    top = max(counts, default=0) + 1

    def docs_of_size(low: int, high: int) -> float:
        # A text of n words has about 6 n bytes; this only steers costs.
        a, b = 2 * math.log2(6 * low), 2 * math.log2(6 * (high + 1))
        return sum(n * max(0.0, min(b, s + 1) - max(a, s)) for s, n in counts.items())

    return make_bands(int(2 ** (top / 2) / 2) + 1, docs_of_size, part, whole)


def shared_keys(docs: DataFrame, width: int, part: int, whole: int) -> DataFrame:
    """Checkpointed rows of two kinds: doc_id, fp, fp2, n (key null) for every document; key, fp, odd, keys for classes that share keys.

    Keys of even or of odd bands with the same classes are one: ``key`` identifies the set of classes, ``keys`` counts them.
    An odd fp stands for the classes of one slice that share the key of that number.
    ``even_need`` and ``odd_need`` (class rows) are the shared keys without which a set has no partner in the band.
    """
    bands = _bands_for(docs, part, whole)
    plan = B.layout(docs, BUCKET_BYTES)
    n_buckets = plan.buckets
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["bucket", "doc_id", "fp", "fp2", "n", "even_need", "odd_need", "key", "odd", "keys", "run", "prints"]
    fields = f"bucket int, doc_id {kind}, fp long, fp2 long, n long, even_need int, odd_need int, key long, odd int, keys long, run binary, prints binary"
    passed = names[1:10]

    def batch(ids_type, m: int, **cols) -> pa.RecordBatch:
        types = [pa.int32(), ids_type, pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([c.cast(t) if isinstance(c := cols.get(x), pa.Array) else pa.nulls(m, t) if c is None else pa.array(c, t) for x, t in zip(names, types, strict=True)], names)

    def index(batches):
        shingler, spread = Shingler(width), 0
        for rows in batches:
            data, offsets = B.text_buffers(rows.column("text"))
            ids = rows.column("doc_id")
            for a, b in _slices(offsets):
                values, sizes = shingler.sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                prints, second = shingler.fingerprints(values, sizes)
                # Each class of the slice is indexed once.
                _, first = np.unique(prints, return_index=True)
                lead = np.zeros(len(prints), bool)
                lead[first] = True
                keys, owner, needs = index_keys(values[np.repeat(lead, sizes)], np.where(lead, sizes, 0), bands, part, whole)
                needs = {name: pa.array(x, pa.int32(), mask=~lead) for name, x in zip(("even_need", "odd_need"), needs, strict=True)}
                # Documents only pass through the buckets, dealt evenly.
                yield batch(ids.type, b - a, bucket=(np.arange(a, b) + spread) % n_buckets, doc_id=ids.slice(a, b - a), fp=prints.view(np.int64), fp2=second.view(np.int64), n=sizes, **needs)
                spread += b - a
                holder = prints[owner]
                # Classes of this slice that share keys: one group, which is a member of itself and stands for them elsewhere.
                ident, member, odd, times, met, met_ident = shared_by(keys, holder)
                if len(ident):
                    own = np.unique(np.stack((ident, odd), 1), axis=0)
                    g, o = own[:, 0], own[:, 1]
                    m = len(ident) + len(g)
                    yield batch(ids.type, m, bucket=(np.arange(m) + spread) % n_buckets, fp=np.concatenate((member, g)).view(np.int64), key=np.concatenate((ident, g)).view(np.int64), odd=np.concatenate((odd, o)), keys=np.concatenate((times, np.ones(len(g), np.int64))))
                    spread += m
                order = np.argsort(keys, kind="stable")
                keys, holder = keys[order], holder[order]
                if len(met):
                    keys, at = np.unique(keys, return_index=True)
                    holder = holder[at]
                    holder[np.searchsorted(keys, met)] = met_ident
                del values, order
                runs = [(k, B.pack_sorted(keys[s:e]), B.pack_coded(holder[s:e])) for k, s, e in B.runs(B.bucket_of(keys, n_buckets))]
                if runs:
                    yield batch(ids.type, len(runs), bucket=[r[0] for r in runs], run=[r[1] for r in runs], prints=[r[2] for r in runs])
            B.give_back()

    def meet(table: pa.Table) -> pa.Table:
        packed = table.filter(pc.is_valid(table["run"]))
        plain = table.filter(pc.is_null(table["run"])).select(passed)
        if not len(packed):
            return plain
        keys = np.concatenate([B.unpack_sorted(x.as_py()) for x in packed["run"]])
        prints = np.concatenate([B.unpack_coded(x.as_py()) for x in packed["prints"]])
        order = np.argsort(keys, kind="stable")
        keys, prints = keys[order], prints[order]
        same = keys[1:] == keys[:-1]
        twice = np.concatenate((same, [False])) | np.concatenate(([False], same))
        del order, same
        keys, prints = keys[twice], prints[twice]
        B.give_back()
        ident, member, odd, times = shared_by(keys, prints)[:4]
        hits = {"fp": pa.array(member.view(np.int64)), "key": pa.array(ident.view(np.int64)), "odd": pa.array(odd, pa.int32()), "keys": pa.array(times, pa.int64())}
        return pa.concat_tables([plain, pa.table([hits[x.name] if x.name in hits else pa.nulls(len(ident), x.type) for x in plain.schema], plain.schema.names)])

    sent = B.dealt(docs.select("doc_id", "text"), plan).mapInArrow(index, fields)
    return B.checkpointed(sent.repartitionById(n_buckets, "bucket").groupBy("bucket").applyInArrow(meet, fields.removeprefix("bucket int, ").removesuffix(", run binary, prints binary")))


def _with_partners(shared: DataFrame) -> DataFrame:
    """key, fp, odd, keys of ``shared`` without the sets that share too few keys to have a partner, nor keys left alone by that.

    Classes that share a first fingerprint share a key of that number (an even one).
    """
    classes = shared.where("key is null and n > 0").groupBy("fp").agg(F.min("even_need").alias("even_need"), F.min("odd_need").alias("odd_need"), F.min("fp2").alias("low"), F.max("fp2").alias("high"))
    hits = B.checkpointed(shared.where("key is not null").groupBy("key", "fp", "odd").agg(F.sum("keys").alias("keys")))
    before, now = math.inf, hits.count()
    hits = gathered(hits, now)
    needs = B.checkpointed(classes.join(hits.select("fp").distinct().withColumn("met", F.lit(True)), "fp", "left").where("met or low <> high"))
    twins = needs.where("low <> high").select(F.col("fp").alias("key"), "fp")
    needs = gathered(needs.select("fp", "even_need", "odd_need"), now)
    # Stopping early keeps more candidates and loses none.  Groups of classes (odd numbers) have no needs.
    while now and now < 0.5 * before:
        enough = hits.groupBy("fp", "odd").agg(F.sum("keys").alias("met")).join(needs, "fp", "left").where("even_need is null or met >= if(odd = 1, odd_need, even_need)").select("fp", "odd")
        kept = hits.join(enough, ["fp", "odd"], "left_semi")
        hits = B.checkpointed(kept.join(kept.groupBy("key").agg(F.count("*").alias("sets")).where("sets > 1"), "key", "left_semi").select(*hits.columns))
        before, now = now, hits.count()
        hits = gathered(hits, now)
    return gathered(_rarest(hits, needs).unionAll(twins), now)


def _rarest(hits: DataFrame, needs: DataFrame) -> DataFrame:
    """key, fp of ``hits`` without the most frequent keys of each set, one less than it shares with any partner.

    Keys have one order for all: by number of sets, and after all others those of groups of classes, which have no order
    among them, so a set leaves out all of these or nothing.  The first key in this order that a set shares with a
    partner has all their other shared keys behind it, too many to be left out with it.
    """
    sizes = hits.groupBy("key").agg(F.count("*").alias("sets"), F.max(F.col("fp").bitwiseAND(1)).alias("grouped"))
    rows = hits.where("fp & 1 = 0").join(sizes, "key").join(needs, "fp").withColumn("need", F.when(F.col("odd") == 1, F.col("odd_need")).otherwise(F.col("even_need")))
    last = W.partitionBy("fp", "odd").orderBy(F.desc("grouped"), F.desc("sets"), F.desc("key"))
    # Sums of keys from the last in the order on; all keys of groups count together.
    upto = F.greatest(F.sum("keys").over(last.rowsBetween(W.unboundedPreceding, 0)), F.sum(F.col("keys") * F.col("grouped")).over(W.partitionBy("fp", "odd")))
    own = rows.withColumn("upto", upto).where("upto >= need").select("key", "fp")
    groups = hits.where("fp & 1 = 1").select("key", "fp")
    # Of groups, those that still have a class.
    kept = B.checkpointed(own.unionAll(groups.join(own.select(F.col("key").alias("fp")).distinct(), "fp", "left_semi").select("key", "fp")).distinct())
    return kept.join(kept.groupBy("key").agg(F.count("*").alias("sets")).where("sets > 1"), "key", "left_semi").select("key", "fp")


def _sets_of(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """fp, fp2, n, items (packed set) of the classes in ``wanted`` (fp, fp2, rep: one document of the class)."""
    wanted = B.checkpointed(wanted.select("fp", "fp2", F.col("rep").alias("doc_id")))
    few = wanted.count() <= MAX_BROADCAST_IDS
    side = wanted.select(F.col("doc_id").alias("rep"), F.col("fp").alias("want"), F.col("fp2").alias("want2"))
    rows = docs.select("doc_id", "text")
    rows = rows.join(F.broadcast(side) if few else side, rows["doc_id"].eqNullSafe(side["rep"])).select("text", "want", "want2")

    def run(batches):
        shingler = Shingler(width)
        for batch in batches:
            data, offsets = B.text_buffers(batch.column("text"))
            want, want2 = (batch.column(c).to_numpy().view(np.uint64) for c in ("want", "want2"))
            for a, b in _slices(offsets):
                values, sizes = shingler.sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                one, two = shingler.fingerprints(values, sizes)
                cuts = np.concatenate(([0], np.cumsum(sizes)))
                pick = np.flatnonzero((one == want[a:b]) & (two == want2[a:b])).tolist()
                yield pa.RecordBatch.from_arrays([pa.array(one[pick].view(np.int64)), pa.array(two[pick].view(np.int64)), pa.array(sizes[pick], pa.int64()), pa.array([B.pack_sorted(values[cuts[i] : cuts[i + 1]]) for i in pick], pa.binary())], ["fp", "fp2", "n", "items"])

    return B.checkpointed(rows.mapInArrow(run, "fp long, fp2 long, n long, items binary").dropDuplicates(["fp", "fp2"]))


def linked_within(values: np.ndarray, sizes: np.ndarray, full: np.ndarray, part: int, whole: int) -> np.ndarray:
    """For each set, the first set of its component; exact, without listing pairs.

    ``values`` and ``sizes``: the sets, or their differences from one set common to all; ``full``: the sets' own sizes.

    Sets are taken as differences from a common reference, the elements that most of them hold: with d the size of a
    difference, two sets differ in d_x + d_y - 2 |both differences| elements, and only elements on which two sets
    deviate from the reference together enter the matrix of shared deviations.
    """
    m = len(sizes)
    who = np.repeat(np.arange(m), sizes)
    distinct, at, times = np.unique(values, return_inverse=True, return_counts=True)
    core = 2 * times > m
    held = np.bincount(who, weights=core[at], minlength=m)
    apart = core.sum() - held + (sizes - held)
    useful = np.where(core, m - times >= 2, times >= 2)
    column = np.where(useful, np.cumsum(useful) - 1, -1)
    shared = np.zeros((m, m), np.float32)
    width, total = max(1, 4_000_000 // m), int(useful.sum())
    own, col = who[useful[at]], column[at[useful[at]]]
    is_core = core[useful]
    by = np.argsort(col, kind="stable")
    own, col = own[by], col[by]
    for s in range(0, total, width):
        e = min(total, s + width)
        lo, hi = np.searchsorted(col, (s, e))
        block = np.zeros((m, e - s), np.float32)
        block[own[lo:hi], col[lo:hi] - s] = 1
        block[:, is_core[s:e]] = 1 - block[:, is_core[s:e]]
        shared += block @ block.T
    both = (full[:, None] + full[None, :]).astype(np.float32)
    common = (both - (apart[:, None] + apart[None, :]).astype(np.float32)) / 2 + shared
    linked = whole * common >= part * (both - common)
    np.fill_diagonal(linked, True)
    label = np.arange(m)
    while True:
        low = np.where(linked, label[None, :], m).min(1)
        low = np.minimum(low, low[low])
        if (low == label).all():
            return label
        label = low


def _families(hits: DataFrame) -> DataFrame:
    """fp, family of every class and group in ``hits`` (key, fp)."""
    stars = hits.join(hits.groupBy("key").agg(F.min("fp").alias("b")), "key").select(F.col("fp").alias("a"), "b")
    family = components(stars).withColumnRenamed("node", "fp")
    return hits.select("fp").distinct().join(family, "fp", "left").select("fp", F.coalesce("label", "fp").alias("family"))


def _compare(rows: DataFrame, tasks: int, part: int, whole: int) -> DataFrame:
    """Links (a, b: structs of fp, fp2) that connect what is linked among the rows (task, family, fp, fp2, n, items) of each task and family."""

    def compare(table: pa.Table) -> pa.Table:
        ids, fam = table.select(["fp", "fp2"]), table["family"].to_numpy()
        order = np.lexsort((ids["fp2"].to_numpy(), ids["fp"].to_numpy(), fam))
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for _, s, e in B.runs(fam[order]):
            pick = order[s:e]
            if len(pick) > 1:
                items = [B.unpack_sorted(table["items"][int(i)].as_py()) for i in pick]
                label = linked_within(np.concatenate(items), np.array([len(x) for x in items]), table["n"].to_numpy()[pick], part, whole)
                moved = label != np.arange(len(pick))
                a.append(pick[moved])
                b.append(pick[label[moved]])
        B.give_back()
        ends = [ids.take(pa.array(np.concatenate(x))) for x in (a, b)]
        return pa.table([c.combine_chunks() for t in ends for c in t.columns], ["fp", "fp2", "to", "to2"])

    links = rows.select("task", "family", "fp", "fp2", "n", "items").repartition(tasks, "task").groupBy("task").applyInArrow(compare, "fp long, fp2 long, to long, to2 long")
    return B.checkpointed(links.select(F.struct("fp", "fp2").alias("a"), F.struct(F.col("to").alias("fp"), F.col("to2").alias("fp2")).alias("b")))


def _parts(size: Column, n: Column) -> Column:
    return F.greatest(F.ceil(size / CHUNK), F.ceil(n / ITEMS))


def link_classes(docs: DataFrame, shared: DataFrame, width: int, part: int, whole: int) -> DataFrame:
    """fp, fp2, label: the component of every class that is linked with another.

    Small families are compared whole, several to a task.  A family of more than ``CHUNK`` classes or ``ITEMS`` elements is
    compared by parts with some pivots, and then only across the components found so far (``_rest_of_large``).
    A task returns no more links than it has classes.
    """
    hits = _with_partners(shared)
    reps = shared.where("key is null and n > 0").groupBy("fp", "fp2").agg(F.min("doc_id").alias("rep"))
    sets = _sets_of(docs, reps.join(hits.select("fp").distinct(), "fp", "left_semi"), width)
    held = B.checkpointed(sets.select("fp", "fp2", "n").join(_families(hits), "fp"))
    held = gathered(held, held.count())
    sized = held.groupBy("family").agg(F.count("*").alias("size"), F.sum("n").alias("total"), F.min(F.struct("fp", "fp2")).alias("first"))
    sized = B.checkpointed(sized.withColumn("parts", _parts(F.col("size"), F.col("total"))))
    t = sized.agg(F.sum("size").alias("n"), F.sum("total").alias("items"), F.max("parts").alias("parts")).first()
    tasks = max(1, -(-int(t["n"] or 0) // CHUNK), -(-int(t["items"] or 0) // ITEMS))
    members = held.select("fp", "fp2", "family").join(sized, "family").join(sets, ["fp", "fp2"])
    small = members.where("parts = 1").withColumn("task", F.pmod(F.xxhash64("family"), F.lit(tasks)))
    links = _compare(small, tasks, part, whole)
    if int(t["parts"] or 0) > 1:
        links = links.unionAll(_large(members.where("parts > 1"), sets, tasks, part, whole))
    return B.checkpointed(components(links).select("node.fp", "node.fp2", "label"))


def _large(members: DataFrame, sets: DataFrame, tasks: int, part: int, whole: int) -> DataFrame:
    """Links within large families (members: family, size, parts, first, fp, fp2, n, items)."""

    def differ(batches):
        for batch in batches:
            out = [B.pack_sorted(np.setxor1d(B.unpack_sorted(x.as_py()), B.unpack_sorted(y.as_py()), assume_unique=True)) for x, y in zip(batch.column("items"), batch.column("base"), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("family", "size", "parts", "fp", "fp2", "n")), pa.array(out, pa.binary())], ["family", "size", "parts", "fp", "fp2", "n", "items"])

    # Members travel as their differences from the family's first class, which are small where the family is one of copies.
    base = sets.select(F.struct("fp", "fp2").alias("first"), F.col("items").alias("base"))
    rows = members.join(base, "first").select("family", "size", "parts", "fp", "fp2", "n", "items", "base")
    rows = B.checkpointed(rows.mapInArrow(differ, "family long, size long, parts long, fp long, fp2 long, n long, items binary"))
    own = F.pmod(F.xxhash64("fp", "fp2", F.lit(1)), F.col("parts"))
    is_pivot = F.pmod(F.xxhash64("fp", "fp2", F.lit(2)), F.greatest(F.ceil(F.col("size") / PIVOTS), F.col("parts"))) == 0
    pivots = rows.where(is_pivot).withColumn("own", own).withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).where("at <> own").drop("own")
    first = rows.withColumn("at", own).unionByName(pivots).withColumn("task", F.xxhash64("family", "at"))
    links = _compare(first, tasks, part, whole)
    rest = _rest_of_large(rows, components(links))
    if rest is None:
        return links
    return links.unionAll(_compare(rest, tasks, part, whole))


def _rest_of_large(rows: DataFrame, labels: DataFrame) -> DataFrame | None:
    """Tasks that compare large families part by part, but for two parts of one component; None if all are connected."""
    known = rows.select("family", "parts", "fp", "fp2", "n").join(labels.select("node.fp", "node.fp2", "label"), ["fp", "fp2"], "left")
    known = B.checkpointed(known.withColumn("label", F.coalesce("label", F.struct("fp", "fp2"))))
    few = known.count()
    known = gathered(known, few)
    each = known.groupBy("family", "label").agg(F.count("*").alias("mine"), F.sum("n").alias("total")).withColumn("own_parts", _parts(F.col("mine"), F.col("total"))).drop("mine", "total")
    # A component of more than one part has parts of its own; smaller ones share parts.
    big = F.col("own_parts") > 1
    placed = known.join(each, ["family", "label"]).withColumn("big", F.when(big, F.col("label"))).withColumn("own", F.when(big, F.xxhash64("label", F.pmod(F.xxhash64("fp", "fp2", F.lit(3)), F.col("own_parts")))).otherwise(F.pmod(F.xxhash64("label"), F.col("parts"))))
    placed = gathered(B.checkpointed(placed.select("family", "fp", "fp2", "label", "big", "own")), few)
    parts = placed.groupBy("family", "big", "own").agg((F.min("label") < F.max("label")).alias("mixed"))
    two = parts.select("family", F.col("own").alias("i"), F.col("big").alias("x"), "mixed").join(parts.select("family", F.col("own").alias("j"), F.col("big").alias("y")), "family")
    # Two parts of one component have nothing left to find.
    two = two.where("(i < j and (x is null or y is null or x <> y)) or (i = j and mixed)")
    two = B.checkpointed(two.select("family", F.xxhash64("family", "i", "j").alias("task"), F.explode(F.array_distinct(F.array("i", "j"))).alias("own")))
    if two.isEmpty():
        return None
    return placed.join(two, ["family", "own"]).select("task", "family", "fp", "fp2").join(rows.select("fp", "fp2", "n", "items"), ["fp", "fp2"])


def near_groups(docs: DataFrame, *, width: int = WIDTH, part: int = PART, whole: int = WHOLE) -> DataFrame:
    """doc_id, n_shingles, component_id of every row.  Linked: whole * |both| >= part * |either|."""
    shared = shared_keys(docs, width, part, whole)
    labels = link_classes(docs, shared, width, part, whole)
    own = shared.where("key is null").select("doc_id", "fp", "fp2", F.col("n").alias("n_shingles"))
    own = own.join(labels, ["fp", "fp2"], "left").select("doc_id", "n_shingles", F.coalesce("label", F.struct("fp", "fp2")).alias("label"))
    least = own.where("n_shingles > 0").groupBy("label").agg(F.min("doc_id").alias("least"))
    return own.join(least, (own["label"] == least["label"]) & (own["n_shingles"] > 0), "left").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))
