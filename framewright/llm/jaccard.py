"""N-gram Jaccard join by T-occurrence search.

A text is the set of its word n-grams.  Two texts whose Jaccard similarity is at least
``percent`` / 100 share at least T = ceil(percent * n / 100) of the n shingles of either.

1. One pass over the texts makes the sets and sends (shingle, text) postings, packed, to
   the bucket of the shingle.  A bucket tells every text which of its shingles occur
   elsewhere and in how many texts.  A text with fewer than T shared shingles has no
   partner and is out; equal sets are one class from here on.
2. Shingles in ascending document frequency: two linked texts share one of the first
   n - T + 1.  Texts that share such a rare shingle with a common neighbour form a
   *neighbourhood* (components of star edges, so linear in the postings).
3. Inside a neighbourhood, DivideSkip: the T - 1 longest inverted lists of a query are
   set aside, the short rest is merged with a heap, and a text met there is probed in the
   long ones by binary search; it stays if its overlap reaches what the two sizes need.
   Texts that are already connected are not probed again.
4. A neighbourhood of more than ``block_rows`` texts is cut in blocks.  Every block is
   searched for its own texts and for a few pivots of the neighbourhood; texts that did
   not join the pivots' component are then searched in all blocks.  Two texts of the one
   component need no further proof, so no connection is missed and no list of all pairs
   is ever made.

Shingles a chunk of texts holds ``HOT_IN_CHUNK`` times or more are *hot*: they come last in
the order and their postings are not sent; a marker tells the other chunks.  This changes
the order only, so results stay exact up to hash collisions (sets by 64 bits, shared
shingles by 40 bits and bucket).

Texts without words have an empty set and link with nothing; null texts count as empty.
With fewer than n words the whole sequence is one shingle.  Rows without id give no row;
rows that share an id count as one document with the shingles of the largest of them.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import batches_of, bound_text_batches, components, partitions, tidy
from framewright.session import cut_lineage

# Postings that are sorted together on the way to the buckets.
CHUNK_POSTINGS = 500_000
# Texts of one chunk that make a shingle hot.
HOT_IN_CHUNK = 16
HOT = 0xFFFF
# Texts that are indexed together, and pivots of a neighbourhood of several blocks.
BLOCK_ROWS = 512
PIVOTS = 4

_MIX = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(29)


class WordHashes(dict):
    """Word -> 64-bit hash, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, n: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams; words end at ASCII white space and A-Z
    counts as a-z."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(n, len(w))
    acc = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        acc = (acc ^ (acc >> _SHIFT)) * _MIX + w[i:len(w) - k + 1 + i]
    return np.unique((acc ^ (acc >> _SHIFT)) * _MIX)


def required(n, percent: int):
    """Shingles that any partner of a set of n shares with it."""
    return -(-percent * n // 100)


_SENT = "bucket int, doc_id long, n int, same long, codes binary, blob binary"
_TOLD = "home int, records binary"


def _batch(names, columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, names)


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    return _batch(["bucket", "doc_id", "n", "same", "codes", "blob"],
                  [pa.array(c, t) for c, t in zip(zip(*rows), types)])


# A posting on the wire: 40 bits of the shingle, then the place of its text in the chunk.
_POSTING = np.dtype([("low", "<u4"), ("high", "u1"), ("at", "<u2")])
# A shared shingle of a text: how many texts hold it, and 40 bits and bucket.
_SHARED = np.dtype([("df", "<u2"), ("code", "<u8")])


def _chunk_rows(ids: list[int], sets: list[np.ndarray], buckets: int):
    """Rows of one chunk: a row per text, and packed postings per bucket."""
    first: dict[bytes, int] = {}
    alike = [first.setdefault(s.tobytes(), i) for i, s in enumerate(sets)]
    same = [int(xxhash.xxh3_64_intdigest(s.tobytes())) - (1 << 63) for s in sets]
    rows = [(int(d % buckets), d, len(s), h, None, None) for d, s, h in zip(ids, sets, same)]
    members: dict[int, list[int]] = {}
    for i, lead in enumerate(alike):
        members.setdefault(lead, []).append(i)
    leads = [i for i in members if len(sets[i])]
    if not leads:
        return rows
    h = np.concatenate([sets[i] for i in leads])
    at = np.repeat(np.array(leads, np.uint16), [len(sets[i]) for i in leads])
    order = np.argsort(h, kind="stable")
    h, at = h[order], at[order]
    starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    sizes = np.diff(np.append(starts, len(h)))
    hot = np.repeat(sizes >= HOT_IN_CHUNK, sizes)
    bucket = (h % np.uint64(buckets)).astype(np.int64)
    rest = h // np.uint64(buckets) & np.uint64((1 << 40) - 1)
    marks = np.zeros(len(h), bool)
    marks[starts] = True
    keep = ~hot | marks
    packed = np.empty(int(keep.sum()), _POSTING)
    packed["low"] = rest[keep] & np.uint64(0xFFFFFFFF)
    packed["high"] = rest[keep] >> np.uint64(32)
    packed["at"] = np.where(hot[keep], HOT, at[keep])
    of = bucket[keep]
    order = np.argsort(of, kind="stable")
    packed, of = packed[order], of[order]
    cuts = np.searchsorted(of, np.arange(buckets + 1))
    # Texts of an equal set share one place; the ids a bucket needs ride with its postings.
    for b in range(buckets):
        if cuts[b + 1] > cuts[b]:
            posts = packed[cuts[b]:cuts[b + 1]].copy()
            used = np.unique(posts["at"])
            used = used[used != HOT]
            posts["at"] = np.where(posts["at"] == HOT, HOT, np.searchsorted(used, posts["at"]))
            table = np.array([ids[m] for i in used for m in members[int(i)]], np.int64)
            head = np.array([len(used), len(table), *(len(members[int(i)]) for i in used)], np.int32)
            rows.append((b, None, None, None, None, head.tobytes() + table.tobytes() + posts.tobytes()))
    # Hot shingles are known to be shared: their texts hear of them here.
    if hot.any():
        code = rest[hot] * np.uint64(buckets) + bucket[hot].astype(np.uint64)
        whose = at[hot]
        order = np.argsort(whose, kind="stable")
        code, whose = code[order], whose[order]
        for a, z in _runs(whose):
            shared = np.empty(z - a, _SHARED)
            shared["df"], shared["code"] = HOT, code[a:z]
            for i in members[int(whose[a])]:
                rows.append((int(ids[i] % buckets), ids[i], None, None, shared.tobytes(), None))
    return rows


def _runs(values: np.ndarray):
    """(start, end) of each run of equal neighbours."""
    edges = np.flatnonzero(values[1:] != values[:-1]) + 1
    return zip([0, *edges], [*edges, len(values)]) if len(values) else ()


def _postings(n: int, buckets: int):
    def kernel(batches):
        hashes = WordHashes()
        ids, sets, total = [], [], 0
        for batch in batches:
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(d)
                sets.append(shingles(text, n, hashes))
                total += len(sets[-1]) + 8
                if total >= CHUNK_POSTINGS or len(ids) >= HOT:
                    yield from _slices(_chunk_rows(ids, sets, buckets))
                    ids, sets, total = [], [], 0
        if ids:
            yield from _slices(_chunk_rows(ids, sets, buckets))
    return kernel


def _slices(rows: list[tuple], most: int = 2000):
    for at in range(0, len(rows), most):
        yield _sent(rows[at:at + most])


def _answer(blobs: list[bytes], bucket: int, buckets: int):
    """Per text: the shingles of this bucket that occur in two texts or more."""
    whose, codes, ids = [], [], []
    base = 0
    for blob in blobs:
        places, held = np.frombuffer(blob, np.int32, 2)
        counts = np.frombuffer(blob, np.int32, places, 8)
        table = np.frombuffer(blob, np.int64, held, 8 + 4 * int(places))
        posts = np.frombuffer(blob, _POSTING, -1, 8 + 4 * int(places) + 8 * int(held))
        at = posts["at"].astype(np.int64)
        whose.append(np.where(at == HOT, -1, at + base))
        codes.append(posts["low"].astype(np.uint64) | posts["high"].astype(np.uint64) << np.uint64(32))
        ids.append((table, counts))
        base += int(places)
    code, who = np.concatenate(codes), np.concatenate(whose)
    counts = np.concatenate([c for _, c in ids])
    table = np.concatenate([t for t, _ in ids])
    start_of = np.concatenate(([0], np.cumsum(counts)))
    order = np.argsort(code, kind="stable")
    code, who = code[order], who[order]
    starts = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
    weight = np.where(who < 0, HOT, counts[who])
    df = np.minimum(np.add.reduceat(weight, starts), HOT)
    df = np.repeat(df, np.diff(np.append(starts, len(code))))
    keep = (df >= 2) & (who >= 0)
    code, who, df = code[keep], who[keep], df[keep]
    order = np.argsort(who, kind="stable")
    code, who, df = code[order], who[order], df[order]
    for a, z in _runs(who):
        shared = np.empty(z - a, _SHARED)
        shared["df"], shared["code"] = df[a:z], code[a:z] * np.uint64(buckets) + np.uint64(bucket)
        data = shared.tobytes()
        for d in table[start_of[who[a]]:start_of[who[a] + 1]]:
            yield int(d), None, None, data


# What a bucket knows of one text: its size and set where it is told of the text itself, and
# the length of the codes that follow the records.
_RECORD = np.dtype([("doc", "<i8"), ("n", "<i4"), ("same", "<i8"), ("length", "<i4")])
# Bytes of answers that a bucket gathers before it hands them on.
GATHERED = 8 << 20


def _homes(docs: np.ndarray, homes: int) -> np.ndarray:
    """Place where the answers about a text come together."""
    return ((docs.astype(np.uint64) * _MIX) >> np.uint64(32)) % np.uint64(homes)


def _packed(rows: list[tuple], homes: int):
    """Rows of answers, one per home: records, then their codes."""
    docs = np.array([r[0] for r in rows], np.int64)
    home = _homes(docs, homes).astype(np.int64)
    order = np.argsort(home, kind="stable")
    for a, z in _runs(home[order]):
        mine = [rows[i] for i in order[a:z].tolist()]
        records = np.array([(d, -1 if n is None else n, same or 0, len(codes or b"")) for d, n, same, codes in mine], _RECORD)
        yield int(home[order[a]]), b"".join([np.int64(len(mine)).tobytes(), records.tobytes(), *(m[3] for m in mine if m[3])])


def _buckets_answer(buckets: int):
    def kernel(batches):
        at, blobs, rows, size = None, [], [], 0

        def emit():
            told = list(_packed(rows, buckets))
            for k in range(0, len(told), 200):
                part = told[k:k + 200]
                yield _batch(["home", "records"], [pa.array([h for h, _ in part], pa.int32()), pa.array([r for _, r in part], pa.binary())])
        for batch in batches:
            for bucket, doc, n, same, codes, blob in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != at:
                    if blobs:
                        rows += _answer(blobs, at, buckets)
                    if sum(len(r[3] or b"") + 24 for r in rows) > GATHERED:
                        yield from emit()
                        rows = []
                    at, blobs = bucket, []
                if blob is None:
                    rows.append((doc, n, same, codes))
                else:
                    blobs.append(blob)
        if blobs:
            rows += _answer(blobs, at, buckets)
        if rows:
            yield from emit()
    return kernel


def _shared_sets(percent: int):
    """Put the answers of the buckets together: one row per text."""
    names = ["doc_id", "n", "same", "rare", "codes"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary()]

    def finish(doc, sizes, parts):
        n, same = max(sizes, default=(0, 0))
        shared = np.unique(np.frombuffer(b"".join(parts), _SHARED)) if parts else np.empty(0, _SHARED)
        # A shingle may be told twice where ids repeat; (df, code) order is the same for all texts.
        need = required(n, percent)
        if n == 0 or len(shared) < need:
            return doc, n, same, None, None
        first = n - need + 1 - (n - len(shared))
        if first <= 0:
            return doc, n, same, None, None
        code = shared["code"].astype(np.int64)
        return doc, n, same, code[:first].tolist(), np.sort(code).tobytes()

    def finished(texts):
        rows = []
        for doc, (sizes, parts) in texts.items():
            rows.append(finish(doc, sizes, parts))
            if len(rows) >= 500:
                yield _batch(names, [pa.array(c, t) for c, t in zip(zip(*rows), types)])
                rows = []
        if rows:
            yield _batch(names, [pa.array(c, t) for c, t in zip(zip(*rows), types)])

    def kernel(batches):
        at, texts = None, {}
        for batch in batches:
            for home, told in zip(*(c.to_pylist() for c in batch.columns)):
                if home != at:
                    yield from finished(texts)
                    at, texts = home, {}
                count = int(np.frombuffer(told, np.int64, 1)[0])
                records = np.frombuffer(told, _RECORD, count, 8)
                start = 8 + count * _RECORD.itemsize
                for doc, n, same, length in records.tolist():
                    sizes, parts = texts.setdefault(doc, ([], []))
                    if n >= 0:
                        sizes.append((n, same))
                    if length:
                        parts.append(told[start:start + length])
                        start += length
        yield from finished(texts)
    return kernel


class Groups:
    """Union-find over places, the smallest place leads."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def union(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


def divide_skip(sizes: list[int], sets: list[np.ndarray], queries: list[int], data: list[int], percent: int):
    """Groups of texts linked by a search of ``queries`` in the inverted index of ``data``.

    ``sizes`` are whole set sizes, ``sets`` the sorted shared shingles.
    """
    groups = Groups(len(sizes))
    if not data or not queries:
        return groups
    flat = np.concatenate([sets[d] for d in data])
    place = np.repeat(np.arange(len(data)), [len(sets[d]) for d in data])
    order = np.argsort(flat, kind="stable")
    flat, place = flat[order], place[order]
    keys, starts = np.unique(flat, return_index=True)
    ends = np.append(starts[1:], len(flat))
    for q in queries:
        mine = sets[q]
        root = groups.find(q)
        if all(groups.find(d) == root for d in data):
            continue
        need = required(sizes[q], percent)
        slot = np.searchsorted(keys, mine)
        slot[slot == len(keys)] = 0
        met = slot[keys[slot] == mine]
        if len(met) < need:
            continue
        lengths = ends[met] - starts[met]
        by_length = met[np.argsort(lengths, kind="stable")]
        # The need - 1 longest lists cannot reach the overlap alone: a partner is in a short one.
        short, long_ones = by_length[:len(by_length) - need + 1], by_length[len(by_length) - need + 1:]
        probe = np.sort(keys[long_ones])
        merged = heapq.merge(*(place[starts[s]:ends[s]].tolist() for s in short))
        last, count = -1, 0
        found: list[tuple[int, int]] = []
        for p in merged:
            if p == last:
                count += 1
                continue
            if last >= 0:
                found.append((last, count))
            last, count = p, 1
        if last >= 0:
            found.append((last, count))
        for p, count in found:
            d = data[p]
            if groups.find(d) == groups.find(q):
                continue
            both = sizes[q] + sizes[d]
            if 100 * min(sizes[q], sizes[d]) < percent * max(sizes[q], sizes[d]):
                continue
            overlap = count
            if len(probe):
                theirs = sets[d]
                where = np.searchsorted(theirs, probe)
                where[where == len(theirs)] = 0
                overlap += int((theirs[where] == probe).sum())
            if 100 * overlap >= percent * (both - overlap):
                groups.union(q, d)
    return groups


def _search(percent: int):
    """Rows of one task, sorted by part: index what is data, search what is a query."""
    names = ["a", "b"]

    def links(rows):
        ids = [r[0] for r in rows]
        sets = [np.frombuffer(r[2], np.int64) for r in rows]
        data = [i for i, r in enumerate(rows) if r[4]]
        ask = [i for i, r in enumerate(rows) if r[3]]
        groups = divide_skip([r[1] for r in rows], sets, ask, data, percent)
        return [(ids[i], ids[groups.find(i)]) for i in range(len(rows)) if groups.find(i) != i]

    def kernel(batches):
        at, rows = None, []
        for batch in batches:
            out: list[tuple] = []
            for area, block, part, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (area, block, part) != at:
                    out += links(rows) if len(rows) > 1 else []
                    at, rows = (area, block, part), []
                rows.append(row)
            if out:
                yield _batch(names, [pa.array(c, pa.int64()) for c in zip(*out)])
        out = links(rows) if len(rows) > 1 else []
        if out:
            yield _batch(names, [pa.array(c, pa.int64()) for c in zip(*out)])
    return kernel


def _searched(rows: DataFrame, percent: int, parts: int) -> DataFrame:
    """Edges from a search of rows (area, block, part, doc_id, n, codes, asks, is_data)."""
    spark = rows.sparkSession
    dealt = rows.repartition(parts, "area", "block", "part").sortWithinPartitions("area", "block", "part")
    with batches_of(spark, 500):
        return cut_lineage(dealt.mapInArrow(tidy(_search(percent)), "a long, b long"))


def jaccard_classes(
    docs: DataFrame, n: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(key, n_shingles, component_id) per document of ``docs``.

    ``component_id`` is the smallest key reachable by links, itself included.  Documents
    link when 100 * shared >= percent * union over distinct word ``n``-grams.
    """
    spark = docs.sparkSession
    bound_text_batches(spark)
    parts = partitions(spark)
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where(
        "doc_id is not null")
    # Four buckets an input split bound what a bucket holds at any size of the table.
    buckets = max(parts, 4 * source.rdd.getNumPartitions())
    sent = source.mapInArrow(tidy(_postings(n, buckets)), _SENT)
    told = sent.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    state = told.mapInArrow(tidy(_buckets_answer(buckets)), _TOLD).repartition(buckets, "home").sortWithinPartitions("home")
    with batches_of(spark, 250):
        sets = cut_lineage(state.mapInArrow(
            tidy(_shared_sets(percent)), "doc_id long, n int, same long, rare array<long>, codes binary"))

    # Equal sets: the smallest id stands for its class.
    leads = sets.where("n > 0").groupBy("same", "n").agg(F.min("doc_id").alias("lead"), F.count(F.lit(1)).alias("held"))
    copies = sets.where("n > 0").join(leads.where("held > 1"), ["same", "n"]).select(
        F.col("doc_id").alias("a"), F.col("lead").alias("b")).where("a <> b")
    copies = cut_lineage(copies)
    live = sets.where("codes is not null").join(copies.select(F.col("a").alias("doc_id")), "doc_id", "left_anti")

    # Neighbourhoods: star edges through rare shared shingles.
    rare = live.select("doc_id", F.explode("rare").alias("code"))
    hubs = rare.groupBy("code").agg(F.min("doc_id").alias("hub"), F.count(F.lit(1)).alias("held")).where("held > 1")
    stars = rare.join(hubs, "code").select(F.col("doc_id").alias("a"), F.col("hub").alias("b")).where("a <> b").distinct()
    near = components(stars).select(F.col("node").alias("doc_id"), F.col("component").alias("area"))
    sizes = near.groupBy("area").agg(F.count(F.lit(1)).alias("rows"))
    placed = near.join(sizes, "area").withColumn("blocks", F.ceil(F.col("rows") / block_rows).cast("int"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    placed = cut_lineage(placed.join(live.select("doc_id", "n", "codes"), "doc_id"))

    # Each block for its own texts, and for the pivots where there are several blocks.
    many = placed.where("blocks > 1")
    pivots = many.groupBy("area").agg(F.slice(F.array_sort(F.collect_set(F.when(
        F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.col("rows")) < 8 * PIVOTS, F.col("doc_id")))), 1, PIVOTS).alias("pivot"))
    pivots = many.join(pivots.select(F.explode("pivot").alias("doc_id")), "doc_id", "left_semi")
    fields = ["area", "block", "part", "doc_id", "n", "codes", "asks", "is_data"]
    own = placed.withColumns({"part": F.lit(0), "asks": F.lit(True), "is_data": F.lit(True)}).select(*fields)
    guests = pivots.withColumn("home", F.col("block")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("block <> home")
    guests = guests.withColumns({"part": F.lit(0), "asks": F.lit(True), "is_data": F.lit(False)}).select(*fields)
    edges = _searched(own.unionByName(guests), percent, parts)

    # What the largest component of a neighbourhood of several blocks left out, against all its blocks.
    joined = components(edges).select(F.col("node").alias("doc_id"), F.col("component").alias("found"))
    known = many.select("area", "blocks", "block", "doc_id", "n", "codes").join(joined, "doc_id", "left").withColumn(
        "found", F.coalesce("found", "doc_id"))
    main = known.groupBy("area", "found").agg(F.count(F.lit(1)).alias("held")).groupBy("area").agg(
        F.max_by("found", F.struct("held", "found")).alias("main"))
    left_out = cut_lineage(known.join(main, "area").where("found <> main").withColumn("part", F.col("block")))
    asked = left_out.select("area", "part").distinct()
    asking = left_out.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    asking = asking.withColumns({"asks": F.lit(True), "is_data": F.col("block") == F.col("part")}).select(*fields)
    held = known.join(asked, "area").withColumns({"asks": F.lit(False), "is_data": F.lit(True)}).select(*fields)
    held = held.join(asking.where("is_data").select("area", "block", "part", "doc_id"),
                     ["area", "block", "part", "doc_id"], "left_anti").select(*fields)
    more = _searched(asking.unionByName(held), percent, parts)

    linked = components(copies.unionByName(edges).unionByName(more)).withColumnRenamed("node", "doc_id")
    out = sets.select("doc_id", F.col("n").cast("long").alias("n_shingles")).join(linked, "doc_id", "left")
    return out.select(F.col("doc_id").alias(key), "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``docs`` whose key leads its component; rows without a key stay."""
    classes = jaccard_classes(docs, n, percent, key, text)
    gone = classes.where(F.col(key) != F.col("component_id")).select(key)
    # Texts stream past a table of the ids that go; nothing sorts them.
    return docs.join(gone.hint("shuffle_hash"), key, "left_anti")
