"""N-gram Jaccard join with token-combination prefixes.

A document is the set of its distinct runs of ``k`` words; two documents link
when ``share[1] * |A & B| >= share[0] * |A | B|``. All tokens have one order,
rarest first, taken from a count of all documents' tokens in a table of fixed
size. If a set may miss ``m`` tokens of its partner, both must share a
signature of their prefixes:

- tokens fall in classes. Rare ones are class 1; frequent ones are class 2 or 3
  and are split into groups by their hash;
- a prefix is extended until the tokens of class 1, plus what each group of
  class c holds beyond c - 1 tokens, are more than m;
- signatures are the single tokens of class 1 and the c-token combinations
  inside each group of class c.

Were no signature shared, the partner would miss more than m tokens. The number
of groups follows the set size within a band of sizes (a factor of two), so that
signatures grow in proportion to the text; sets near the end of a band are
signed for the next one, too. Frequency decides only how selective signatures
are, never which pairs are found.

Signatures meet in one shuffle and are read as a sorted stream, so that a bucket
may be of any size; buckets of frequent tokens are also cut into parts. Inside a
bucket, sets are compared by small parity maps, whose differing bits are a lower
bound for the tokens that two sets do not share (bitmap filter); only pairs that
are needed to join what may link are handed on, at most one for each member. A
bucket beyond ``BUCKET`` members hands on all its members as they are. This gives
clusters outside of which no link is possible. The whole texts of a cluster are
then compared exactly, two blocks of about ``BLOCK`` tokens at a time, and again only the
links that join components are returned: components are exact, and no step
returns all pairs of a group. Equal sets count as one from the start.

Defined cases: words are runs of bytes other than space and 0x09-0x0D, A-Z in
lower case; a text with fewer than ``k`` words is one token; null and empty
texts have no token and link with nothing; repeated rows and ids stay, and a
component is named by its smallest id (ids are numbers; rows with a null id take
part and lend no name); an empty table gives an empty result; other columns are
ignored. Tokens and sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tablelab.llm import kernels
from tablelab.llm.components import components
from tablelab.session import materialise

SLOTS_LOG = 18
SALTS = 8
#: Levels of frequency (doublings of 32 documents beyond what a slot holds on average) from which combinations are used.
PAIRS_FROM, TRIPLES_FROM = 4, 9
#: Parts of a bucket of frequent tokens, members up to which a bucket is compared as it is, tokens of a block of sets, bits of a parity map in buckets (more for large sets) and in blocks.
PARTS, BUCKET, BLOCK, MAP_BITS, EXACT_BITS = 64, 2048, 2_000_000, 512, 4096


def _sets(batch: pa.RecordBatch, column: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    data, at = kernels.byte_rows(batch.column(column))
    hashes, _, rows = kernels.words(data, at)
    return kernels.distinct(*kernels.shingles(hashes, rows, k))


def _scan(docs: DataFrame, k: int, share: tuple[int, int]) -> DataFrame:
    """A row a document (id, text hash, set size, set key, in ``slots`` its parity map), and the task's token counts by slot."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = np.zeros(1 << SLOTS_LOG, np.int64)
        for batch in batches:
            for part in kernels.slices(batch, 2):
                values, rows = _sets(part, 2, k)
                slots += np.bincount(values >> np.uint64(64 - SLOTS_LOG), minlength=len(slots))
                n = np.diff(rows)
                none = pa.nulls(len(n), pa.int32())
                maps = [m.tobytes() for m in parity(values, rows)]
                wanted = MAP_BITS * 2 ** np.ceil(np.log2(np.maximum(3 * allowed(n, n, share) / MAP_BITS, 1))).astype(np.int64)
                for i in np.flatnonzero(wanted > MAP_BITS):  # large sets differ by more than a small map can show
                    maps[i] = parity(values[rows[i] : rows[i + 1]], np.array([0, n[i]]), int(wanted[i]))[0].tobytes()
                maps = pa.array(maps, pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(n), pa.array(kernels.set_keys(values, rows).view(np.int64), mask=n == 0), none, maps],
                    names=names,
                )
        one = [pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64())]
        yield pa.RecordBatch.from_arrays([*one, pa.array([int(slots.sum() % SALTS)], pa.int32()), pa.array([slots.tobytes()], pa.binary())], names=names)

    names = ["id", "h", "n", "set", "salt", "slots"]
    return docs.mapInArrow(scan, "id long, h long, n long, set long, salt int, slots binary")


def parity(values: np.ndarray, rows: np.ndarray, bits: int = MAP_BITS) -> np.ndarray:
    """For each set some bits, each the parity of the tokens that fall on it."""
    place = ((values >> np.uint64(20)) % np.uint64(bits)).astype(np.int64)
    owner = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    odd = np.bincount(owner * bits + place, minlength=(len(rows) - 1) * bits) % 2
    return np.packbits(odd.astype(bool).reshape(-1, bits), axis=1).view(np.uint64)


def _levels(scanned: DataFrame) -> np.ndarray:
    """How frequent the tokens of each slot are, from the counts of all tasks: 0 for rare, then doublings."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SLOTS_LOG, np.int64)
        for batch in batches:
            for value in batch.column(0):
                total += np.frombuffer(value.as_py(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["slots"])

    counts = scanned.filter("salt IS NOT NULL").select("salt", "slots").repartition(SALTS, "salt").select("slots")
    total = np.zeros(1 << SLOTS_LOG, np.int64)
    for row in counts.mapInArrow(add, "slots binary").toLocalIterator():
        total += np.frombuffer(row.slots, np.int64)
    mean = total.mean()
    beyond = np.maximum(total - mean - 4 * np.sqrt(mean), 0)
    return np.where(beyond < 32, 0, np.floor(np.log2(np.maximum(beyond, 1) / 32)) + 1).clip(0, 63).astype(np.uint8)


@lru_cache(maxsize=4096)
def _choices(n: int, c: int) -> np.ndarray:
    return np.array(list(combinations(range(n), c)), np.int64).reshape(-1, c)


def signatures(tokens: np.ndarray, missing: int, groups: int, band: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of one set: single tokens, and combinations. ``tokens`` are in the common order, their level in the top six bits."""
    level = tokens >> np.uint64(58)
    salt = kernels.numbers(100 + band, 4)
    if level[missing] < PAIRS_FROM:  # the order is by level: so are all before it
        return kernels.mix(tokens[: missing + 1] * salt[1]), tokens[:0]
    size = np.where(level < PAIRS_FROM, 1, np.where(level < TRIPLES_FROM, 2, 3))
    group = np.where(size == 1, 0, size * groups + ((tokens * salt[0]) >> np.uint64(32)).astype(np.int64) % groups)
    by_group = np.argsort(group, kind="stable")
    sorted_groups = group[by_group]
    begin = np.flatnonzero(np.concatenate([[True], sorted_groups[1:] != sorted_groups[:-1]]))
    rank = np.empty(len(tokens), np.int64)
    rank[by_group] = np.arange(len(tokens)) - np.repeat(begin, np.diff(begin, append=len(tokens)))
    end = int(np.searchsorted(np.cumsum(rank >= size - 1), missing + 1)) + 1
    by_group = by_group[by_group < end]
    sorted_groups = group[by_group]
    out = [tokens[:0]]
    begin = np.flatnonzero(np.concatenate([[True], sorted_groups[1:] != sorted_groups[:-1]]))
    for a, b in zip(begin, [*begin[1:], len(by_group)]):
        c = int(size[by_group[a]])
        if c > 1 and b - a >= c:
            chosen = tokens[by_group[a:b]][_choices(int(b - a), c)]
            out.append(kernels.mix((kernels.mix(chosen) * kernels.numbers(7, 3)[:c]).sum(axis=1, dtype=np.uint64) * salt[c]))
    return kernels.mix(tokens[:end][size[:end] == 1] * salt[1]), np.concatenate(out)


def _signed(docs: DataFrame, levels: np.ndarray, k: int, share: tuple[int, int]) -> DataFrame:
    """``sig``, ``set``, ``n`` of every signature of every set that can link with a different one, and whether it is a combination."""
    num, den = share
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = shared.value.astype(np.uint64)
        for batch in batches:
            for part in kernels.slices(batch, 0):
                values, rows = _sets(part, 0, k)
                keys = kernels.set_keys(values, rows)
                order = (level[values >> np.uint64(64 - SLOTS_LOG)] << np.uint64(58)) | (kernels.mix(values) >> np.uint64(6))
                out, seen = [], set()
                for a, b, key in zip(rows[:-1], rows[1:], keys):
                    n = int(b - a)
                    missing, largest = n - -(-n * num // den), n * den // num
                    if n == 0 or (missing == 0 and largest == n) or key in seen:
                        continue
                    seen.add(key)
                    tokens = np.sort(order[a:b])
                    for band in range(n.bit_length(), largest.bit_length() + 1):
                        smallest = (1 << (band - 1)) * num // den
                        single, combined = signatures(tokens, missing, max(1, smallest * (den - num) // (2 * den)), band)
                        out += [(found, key, n, mark) for found, mark in ((single, False), (combined, True)) if len(found)]
                if out:
                    size = [len(found) for found, *_ in out]
                    columns = [np.concatenate([x[0] for x in out]).view(np.int64)]
                    columns += [np.repeat(np.array([x[i] for x in out], t), size) for i, t in ((1, np.uint64), (2, np.int32), (3, bool))]
                    columns[1] = columns[1].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["sig", "set", "n", "combined"])

    return docs.select("text").mapInArrow(sign, "sig long, set long, n int, combined boolean")


def _stream(rows: DataFrame, key: str) -> DataFrame:
    """Of all buckets of one ``key``: ``sig``, member ``a`` (of size ``n``) and pivot ``b`` (of size ``m``), the smallest set key.

    Buckets of combinations also give a row for the pivot itself.
    """

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.zeros(4, np.int64)  # key, set, pivot, size of the pivot
        started = False
        for batch in batches:
            group, own, n, sig, combined = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            group, own, n = (np.concatenate([[v], x]).astype(np.int64) for v, x in ((last[0], group), (last[1], own), (0, n)))
            opens = np.concatenate([[True], group[1:] != group[:-1]])
            opens[1:2] |= not started
            begin = np.maximum.accumulate(np.where(opens, np.arange(len(group)), 0))
            pivot, size = own[begin], n[begin]
            pivot[begin == 0], size[begin == 0] = last[2], last[3]
            kept = ((own[1:] != own[:-1]) & (own[1:] != pivot[1:])) | (opens[1:] & combined)
            started, last = True, np.array([group[-1], own[-1], pivot[-1], size[-1]])
            out = [sig[kept], *(x[1:][kept] for x in (own, n, pivot, size))]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["sig", "a", "n", "b", "m"])

    rows = rows.select(F.col(key).alias("key"), "set", "n", "sig", "combined").repartition("key").sortWithinPartitions("key", "set")
    return rows.mapInArrow(stream, "sig long, a long, n long, b long, m long")


def allowed(n: np.ndarray, m: np.ndarray, share: tuple[int, int]) -> np.ndarray:
    """Tokens that may be in one of two linked sets of these sizes only; -1 where the sizes alone forbid a link."""
    num, den = share
    both = -((-(n + m) * num) // (num + den))
    return np.where(both > np.minimum(n, m), -1, n + m - 2 * both)


def _joined(n: np.ndarray, bits: np.ndarray, share: tuple[int, int], exact=None) -> list[tuple[int, int]]:
    """Pairs that join the rows which can link into the same groups as all such pairs would. ``exact(i, j)`` has the last word."""
    label, out = np.arange(len(n)), []
    for i in range(len(n) - 1):
        j = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        apart = np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1, dtype=np.int64)
        for x in j[apart <= allowed(n[j], n[i], share)]:
            if label[x] != label[i] and (exact is None or exact(i, x)):
                out.append((i, int(x)))
                label[label == label[x]] = label[i]
    return out


def _folded(maps: list[bytes], words: int) -> np.ndarray:
    """Parity maps as rows of 64-bit words; larger ones folded, which gives the map of that size."""
    if all(len(m) == 8 * words for m in maps):
        return np.frombuffer(b"".join(maps), np.uint64).reshape(-1, words)
    return np.stack([np.bitwise_xor.reduce(np.frombuffer(m, np.uint64).reshape(-1, words), axis=0) for m in maps])


def _near(members: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Pairs ``a``, ``b`` that join what can link in each bucket: parity maps bound the tokens that two sets do not share from below."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sig, key, n, maps in kernels.whole_groups(batches, 1):
            sig, key = sig.to_numpy(zero_copy_only=False), key.to_numpy(zero_copy_only=False)
            n, maps = n.to_numpy(zero_copy_only=False).astype(np.int64), maps.to_pylist()
            begin = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
            words = np.minimum.reduceat([len(m) // 8 for m in maps], begin)
            owner = np.repeat(words, np.diff(begin, append=len(sig)))
            out = []
            for width in np.unique(words):  # buckets by the smallest map in them, to which the others are folded
                of = np.flatnonzero(owner == width)
                out.append(joined(sig[of], key[of], n[of], _folded([maps[i] for i in of], int(width))))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["a", "b"])

    def joined(sig: np.ndarray, key: np.ndarray, n: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        size = np.diff(begin, append=len(sig))
        first = np.repeat(begin, size)
        fits = np.bitwise_count(bits ^ bits[first]).sum(axis=1, dtype=np.int64) <= allowed(n, n[first], share)
        star = fits & (np.arange(len(sig)) != first)
        out = [(key[star], key[first[star]])]
        for a, m in zip(begin, size):
            if m > 2 and not fits[a : a + m].all():
                pairs = np.array(_joined(n[a : a + m], bits[a : a + m], share), np.int64).reshape(-1, 2) + a
                out.append((key[pairs[:, 0]], key[pairs[:, 1]]))
        return tuple(np.concatenate(x) for x in zip(*out))

    rows = members.repartition("sig").sortWithinPartitions("sig")
    return rows.select("sig", "set", "n", "bits").mapInArrow(compare, "a long, b long")


def _linked(members: DataFrame, k: int, share: tuple[int, int]) -> DataFrame:
    """Verified links ``a``, ``b`` that join the sets of each cluster, two blocks of a cluster at a time."""
    num, den = share

    def members_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray]]:
        for batch in batches:
            for part in kernels.slices(batch, 2, 1 << 18):
                whole = pa.RecordBatch.from_arrays([part.column(0), part.column(1), kernels.expanded(part.column(2))], names=["pair", "set", "text"])
                for piece in kernels.slices(whole, 2, 4 << 20):
                    values, rows = _sets(piece, 2, k)
                    for i in range(piece.num_rows):
                        yield piece.column(0)[i].as_py(), piece.column(1)[i].as_py(), values[rows[i] : rows[i + 1]].copy()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in groupby(members_of(batches), key=lambda member: member[0]):
            _, keys, sets = zip(*group)
            rows = np.concatenate([[0], np.cumsum([len(x) for x in sets])])

            def exact(i: int, j: int, sets=sets) -> bool:
                x, y = sets[i], sets[j]
                both = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
                return den * both >= num * (len(x) + len(y) - both)

            pairs = _joined(np.diff(rows), parity(np.concatenate(sets), rows, EXACT_BITS), share, exact)
            yield pa.RecordBatch.from_arrays([pa.array([keys[pair[t]] for pair in pairs], pa.int64()) for t in (0, 1)], names=["a", "b"])

    sizes = members.groupBy("root").agg(F.ceil(F.sum("n") / BLOCK).alias("blocks"))
    rows = members.join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("set"), "blocks"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = F.xxhash64("root", F.least("block", "other"), F.greatest("block", "other"))
    rows = rows.select(pair.alias("pair"), "set", "text").repartition("pair").sortWithinPartitions("pair", "set")
    return rows.mapInArrow(verify, "a long, b long")


def _squeezed(docs: DataFrame) -> DataFrame:
    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), kernels.squeezed(batch.column(2))], names=["id", "h", "text"])

    return docs.mapInArrow(squeeze, "id long, h long, text binary")


def jaccard_components(
    docs: DataFrame, id: str = "doc_id", text: str = "text", k: int = 5, share: tuple[int, int] = (80, 100)
) -> DataFrame:
    """One row a document: ``id``, ``n_shingles``, ``component_id``, and the keys of its set, its component and its text.

    Equal sets share ``set_key``; ``component_key`` and ``set_key`` are null without words; ``text_key`` is ``xxhash64(text)``.
    """
    docs = docs.select(F.col(id).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("h"), F.col(text).cast("string").alias("text"))
    scanned = materialise(_scan(docs, k, share), "sets")
    owners = scanned.filter("salt IS NULL")
    signed = _signed(docs, _levels(scanned), k, share)
    part = F.when(F.col("combined"), F.xxhash64("sig", F.pmod("set", F.lit(PARTS)))).otherwise(F.col("sig"))
    parts = materialise(_stream(signed.withColumn("part", part), "part"), "parts")

    sizes = parts.groupBy("sig").agg(F.count("*").alias("rows"), F.min("b").alias("pivot"), F.max(F.greatest("a", "b")).alias("top"))
    sizes = sizes.filter("pivot < top")
    small = parts.join(sizes.filter(F.col("rows") <= BUCKET).select("sig"), "sig")
    small = small.select("sig", F.col("a").alias("set")).unionAll(small.select("sig", "b")).distinct()
    maps = owners.filter("set IS NOT NULL").groupBy("set").agg(F.first("n").alias("n"), F.first("slots").alias("bits"))
    near = _near(small.join(maps, "set"), share)
    large = parts.join(sizes.filter(F.col("rows") > BUCKET).select("sig", "pivot"), "sig")
    near = near.unionAll(large.select("a", "pivot")).unionAll(large.select("b", "pivot"))
    clusters = materialise(components(near), "clusters").withColumnRenamed("id", "set")

    one = owners.join(clusters, "set").groupBy("set", "root", "n").agg(F.min(F.struct("id", "h")).alias("o"))
    one = one.select("set", "root", "n", "o.id", "o.h")
    where = F.col("d.id").eqNullSafe(F.col("o.id")) & (F.col("d.h") == F.col("o.h"))
    texts = materialise(_squeezed(docs).alias("d").join(one.alias("o"), where).select("set", "root", "n", "text"), "texts")
    roots = components(_linked(texts, k, share))

    names = owners.join(roots.withColumnRenamed("id", "set"), "set", "left")
    names = names.select("id", "n", "set", F.coalesce("root", "set").alias("root"), "h")
    least = names.groupBy("root").agg(F.min("id").alias("component_id"))
    linked = names.join(least, "root").select("id", "n", "component_id", "set", "root", "h")
    alone = owners.filter("set IS NULL").select("id", "n", F.col("id").alias("component_id"), "set", F.col("set").alias("root"), "h")
    return linked.unionByName(alone).toDF(id, "n_shingles", "component_id", "set_key", "component_key", "text_key")


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text", k: int = 5, share: tuple[int, int] = (80, 100)) -> DataFrame:
    """The rows of ``docs``, all columns: of each component the one with the smallest id, and every row without words."""
    found = jaccard_components(docs, id, text, k, share).withColumnRenamed(id, "id").withColumnRenamed("text_key", "h")
    first = found.filter("component_key IS NOT NULL").groupBy("component_key")
    first = first.agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("k")).select("k.id", "k.h", F.lit(0).alias("kind"))
    wordless = found.filter("component_key IS NULL").select("id", "h", F.lit(1).alias("kind")).distinct()

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            missing = batch.column(4).is_null()
            packed = pc.if_else(missing, pa.scalar(None, pa.binary()), kernels.squeezed(batch.column(4)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], packed], names=names)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, kind, taken = None, None, False
        for batch in batches:
            ids, hashes, kinds = (batch.column(i).to_pylist() for i in range(3))
            kept = []
            for i, now in enumerate(zip(ids, hashes)):
                if now != key:
                    key, kind, taken = now, None, False
                if kinds[i] < 2:
                    kind = kinds[i]
                elif kind == 1 or (kind == 0 and not taken):
                    kept.append(i)
                    taken = True
            part = batch.take(pa.array(kept, pa.int64()))
            for piece in kernels.slices(part, 4, 1 << 20):
                missing = piece.column(4).is_null()
                texts = kernels.expanded(pc.fill_null(piece.column(4), b"")).cast(pa.large_string()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([piece.column(3), pc.if_else(missing, pa.scalar(None, pa.string()), texts)], names=["row", "text"])

    names = ["id", "h", "kind", "row", "text"]
    rest = F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c != text])
    rows = docs.select(
        F.col(id).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("h"), F.lit(2).alias("kind"), rest.alias("row"),
        F.col(text).cast("string").alias("text"),
    )
    row = rows.schema["row"].dataType.simpleString()
    rows = rows.mapInArrow(squeeze, f"id long, h long, kind int, row {row}, text binary")
    for few in (first, wordless):
        few = few.withColumn("row", F.lit(None).cast(rows.schema["row"].dataType)).withColumn("text", F.lit(None).cast("binary"))
        rows = rows.unionByName(few)
    rows = rows.repartition("id", "h").sortWithinPartitions("id", "h", "kind").mapInArrow(choose, f"row {row}, text string")
    return rows.select(*[F.col("text").alias(c) if c == text else F.col("row").getField(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
