"""SimHash near-duplicates with bit-sliced comparison.

``fingerprints`` hashes word shingles (XXH64, seed 42) and sets a bit where more than half of the hashes
have it. Fingerprints are compared inside blocks: the bit planes of a block stand vertically, one integer
a plane with a bit for each member, so one query is compared with the whole block plane by plane; counters
of differing bits are kept vertically too (carry-save adders, then ripple), and a block is abandoned as
soon as every member exceeds the radius. Inside a block links are thinned to a spanning forest, so a group
of n copies gives n - 1 links, never all pairs. Components come from a loop of joins.

``near_groups`` finds all 64-bit fingerprints within a radius of 2 exactly: of four 16-bit parts two agree,
so six keys of two parts hold every link. A block beyond ``LARGE`` is cut by two of four 8-bit parts of
the rest (again exact), after which it can hold 65,536 different fingerprints at most.

``similar_groups`` serves shingle similarity instead (five words, 0.8 by default), the share of different
shingles that two texts have in common; texts of equal shingle sets count as one: 512-bit fingerprints of the different shingles only filter, inside
blocks of equal minimum shingle hash under six hashes; blocks beyond ``LARGE`` are compared with some
representatives first, and then chunk by chunk as far as their members are in different components. Rows with a partner in the loose radius form groups, the shingle sets of these come to them,
and a link is kept where the exact similarity of its two sets is high enough.

Edge cases: null and empty texts have no shingle and fingerprint zero, linked like any other; fewer words
than a shingle make one shingle; repeated rows and ties share a component; a null doc_id never names a
component unless its whole group has none; an empty table gives no rows; other columns of the input are
ignored (``drop_similar`` keeps them).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain, repeat
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm.components import components
from panelwright.llm.pieces import chunks
from panelwright.llm.rows import drop_rows, parted, text_key
from panelwright.llm.storage import stored

SEED = 42
LARGE = 16_384
LANES = np.uint64(0x0101010101010101)
WIDE = 512


def _share(n: int, m: int, both: int) -> float:
    """Probability that a bit differs in the fingerprints of two sets of n and m shingles that have ``both`` in common."""
    up = lambda size, ones, rest: sum(comb(rest, x) for x in range(rest + 1) if 2 * (ones + x) > size) / 2**rest
    p = 0.0
    for ones in range(both + 1):
        a, b = up(n, ones, n - both), up(m, ones, m - both)
        p += comb(both, ones) / 2**both * (a * (1 - b) + b * (1 - a))
    return p


@lru_cache
def wide_radius(similarity: float) -> int:
    """Bits in which 512-bit fingerprints of sets of ``similarity`` may differ: the mean plus four deviations.

    The mean follows from the angle acos(2s/(1+s)); in small sets ties make it larger, so those are counted out.
    """
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    for n in range(1, 17):
        for m in range(n, min(17, int(n / similarity) + 1)):
            both = next(c for c in range(n + 1) if c / (n + m - c) >= similarity or c == n)
            if both / (n + m - both) >= similarity:
                share = max(share, _share(n, m, both))
    return int(WIDE * share + 4 * np.sqrt(WIDE * share * (1 - share)))


def shingle_hashes(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of all texts in order, and how many each text has. A-Z count as lower case; words part at ASCII white space."""
    from xxhash import xxh64_intdigest

    each, counts = [], []
    for text in texts:
        w = text.lower().split()
        if len(w) > size:
            grams = map(b" ".join, zip(*(w[i:] for i in range(size)), strict=False))
            counts.append(len(w) - size + 1)
        else:
            grams = [b" ".join(w)] if w else []
            counts.append(len(grams))
        each.append(map(xxh64_intdigest, grams, repeat(SEED)))
    counts = np.array(counts, np.int64)
    return np.fromiter(chain.from_iterable(each), np.uint64, counts.sum()), counts


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each text the 64-bit fingerprint of its hashes; zero without any."""
    out, some = np.zeros(len(counts), np.uint64), np.flatnonzero(counts)
    if not len(some):
        return out
    n = counts[some]
    parts = -(-n // 255)  # counts of a part fit a byte
    first = np.concatenate(([0], np.cumsum(n)[:-1]))
    lead = np.concatenate(([0], np.cumsum(parts)[:-1]))
    starts = np.repeat(first, parts) + 255 * (np.arange(parts.sum()) - np.repeat(lead, parts))
    for bit in range(8):
        lanes = np.add.reduceat(hashes >> np.uint64(bit) & LANES, starts)
        totals = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), lead, axis=0)
        for byte in range(8):
            out[some] |= (2 * totals[:, byte] > n).astype(np.uint64) << np.uint64(8 * byte + bit)
    return out


def _mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """Another 64-bit hash of each hash, by the finaliser of a splitmix generator."""
    z = hashes + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % 2**64)
    z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return z ^ z >> np.uint64(31)


def _chunks(batches: Iterator[pa.RecordBatch], name: str = "doc_id") -> Iterator[tuple[list, list[bytes]]]:
    """(ids, texts) of bounded size."""
    for part in (part for batch in batches for part in chunks(batch)):
        if part.num_rows:
            yield part.column(name).to_pylist(), [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): the 64-bit fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _chunks(batches):
            fp = majority(*shingle_hashes(texts, shingle))
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "fp": pa.array(fp.view(np.int64))})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


class BitSlices:
    """A block of fingerprints with its bit planes stood vertically."""

    def __init__(self, fps: list[bytes]):
        self.n, self.full = len(fps), (1 << len(fps)) - 1
        bits = np.unpackbits(np.frombuffer(b"".join(fps), np.uint8).reshape(self.n, -1), axis=1, bitorder="little")
        packed = np.packbits(bits.T, axis=1, bitorder="little")
        planes = [int.from_bytes(row.tobytes(), "little") for row in packed]
        self.planes = [(i, p) for i, p in enumerate(planes) if p not in (0, self.full)]  # the others differ nowhere

    def within(self, member: int, radius: int, among: int) -> int:
        """Mask of the members in ``among`` that differ from ``member`` in ``radius`` bits at most."""
        levels = [0] * (radius.bit_length() + 1)
        over, since = 0, 0
        planes = iter(self.planes)
        for _, a in planes:
            _, b = next(planes, (0, 0))
            a ^= self.full if a >> member & 1 else 0
            b ^= self.full if b >> member & 1 else 0
            half = levels[0] ^ a  # a carry-save adder takes two planes into the ones
            carry = levels[0] & a | half & b
            levels[0] = half ^ b
            at = 1
            while carry and at < len(levels):
                levels[at], carry = levels[at] ^ carry, levels[at] & carry
                at += 1
            over |= carry
            since += 1
            if since == 4:
                since = 0
                over |= self._beyond(levels, radius)
                if not among & ~over:
                    return 0
        return among & ~(over | self._beyond(levels, radius))

    def _beyond(self, levels: list[int], radius: int) -> int:
        more, same = 0, self.full
        for at in range(len(levels) - 1, -1, -1):
            if radius >> at & 1:
                same &= levels[at]
            else:
                more |= same & levels[at]
                same &= ~levels[at]
        return more


class Trees:
    """Disjoint sets of a block's members; ``mates`` is the bit mask of a member's set."""

    def __init__(self, n: int):
        self.root, self.masks = list(range(n)), [1 << i for i in range(n)]

    def find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    def mates(self, i: int) -> int:
        return self.masks[self.find(i)]

    def join(self, i: int, j: int) -> None:
        a, b = sorted((self.find(i), self.find(j)))
        if a != b:
            self.root[b] = a
            self.masks[a] |= self.masks[b]
            self.masks[b] = 0


def _near(fps: list[bytes], radius: int):
    """A function of (member, mask) to the mask of those members of it within ``radius``; small blocks are compared one by one."""
    if len(fps) >= 12:
        block = BitSlices(fps)
        return lambda i, among: block.within(i, radius, among)
    numbers = [int.from_bytes(f, "little") for f in fps]
    return lambda i, among: sum(1 << j for j, x in enumerate(numbers) if among >> j & 1 and (numbers[i] ^ x).bit_count() <= radius)


def forest(fps: list[bytes], radius: int, split: int = 0, alike: Callable[[int, int], bool] | None = None) -> list[tuple[int, int]]:
    """Links of a spanning forest of the pairs within ``radius`` that are ``alike``; with ``split`` only of pairs between the first ``split`` members and the rest.

    A member is compared with those before it that are in no tree of its own yet: one by one with the
    members of most links, then in bit planes with what is left. So n near copies cost n links, not n² looks.
    """
    trees, near_of, numbers = Trees(len(fps)), _near(fps, radius), [int.from_bytes(f, "little") for f in fps]
    degree, hubs = [0] * len(fps), []
    links: list[tuple[int, int]] = []

    def link(i: int, j: int) -> bool:
        if alike and not alike(i, j):
            return False
        links.append((i, j))
        trees.join(i, j)
        degree[j] += 1
        if j not in hubs:
            hubs.append(j)
        hubs.sort(key=degree.__getitem__, reverse=True)
        del hubs[8:]
        return True

    for i in range(max(1, split), len(fps)):
        rest = (1 << (split or i)) - 1
        for j in list(hubs):
            if rest >> j & 1 and (numbers[i] ^ numbers[j]).bit_count() <= radius:
                rest &= ~trees.mates(i) if link(i, j) else ~(1 << j)
        near = near_of(i, rest) if rest else 0
        while near:
            j = (near & -near).bit_length() - 1
            near &= ~trees.mates(i) if link(i, j) else ~(1 << j)
    return links


LINKS = "a long, b long, key long, id long, fp binary"


def _block_links(rows: DataFrame, radius: int, large: int, halves: bool = False) -> DataFrame:
    """Links (a, b) inside the blocks of equal ``key`` of rows (key, id, fp); rows of blocks over ``large`` come back with their key instead.

    With ``halves`` rows carry side 0 or 1, and only members of different sides are compared.
    """
    side = ["side"] if halves else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, fps, first, spilled = None, [], [], 0, False
        found: list[tuple] = []

        def close() -> None:
            if len(ids) > 1 and not spilled and (not halves or 0 < first < len(ids)):
                found.extend((ids[i], ids[j], None, None, None) for i, j in forest(fps, radius, first if halves else 0))

        for batch in batches:
            for k, i, f, *s in zip(*(batch.column(c).to_pylist() for c in ("key", "id", "fp", *side)), strict=True):
                if k != key:
                    close()
                    key, ids, fps, first, spilled = k, [], [], 0, False
                ids.append(i)
                fps.append(f)
                if halves and not s[0]:
                    first += 1
                if len(ids) > large:
                    spilled = True
                if spilled:
                    found.extend((None, None, key, a, b) for a, b in zip(ids, fps, strict=True))
                    ids, fps = [], []
                if len(found) > 5000:
                    yield _links(found)
                    found.clear()
        close()
        yield _links(found)

    dealt = rows.repartition("key").sortWithinPartitions("key", *side, "id")
    return dealt.select("key", "id", "fp", *side).mapInArrow(run, LINKS)


def _links(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 5
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_pydict({n: pa.array(c, k) for n, c, k in zip(("a", "b", "key", "id", "fp"), columns, kinds, strict=True)})


def _pairs(n: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(n) for j in range(i + 1, n)]


def _spread(df: DataFrame, keys: list[Column]) -> DataFrame:
    """A row for each key; a key is hashed with its place, so that different kinds of block never meet."""
    return df.select("id", "fp", F.explode(F.array(*[F.xxhash64(F.lit(i), k) for i, k in enumerate(keys)])).alias("key"))


def _parts(fp: str, low: int, width: int, n: int) -> list[Column]:
    return [F.shiftrightunsigned(fp, low + width * i).bitwiseAND(F.lit((1 << width) - 1)) for i in range(n)]


def near_links(distinct: DataFrame, radius: int = 2, large: int = LARGE) -> DataFrame:
    """Links (a, b) that join all of ``distinct`` (fp: long, each once) within ``radius`` (0 to 2) bits."""
    if not 0 <= radius <= 2:
        raise ValueError("two of four parts agree only for a radius of 2 or less")
    base = distinct.select(F.col("fp").alias("id"), F.to_binary(F.lpad(F.hex("fp"), 16, "0"), F.lit("hex")).alias("fp"))
    four = _parts("id", 0, 16, 4)
    keys = [four[i] * 65536 + four[j] for i, j in _pairs(4)]
    first = stored(_block_links(_spread(base, keys), radius, large), "blocks")
    links, rest = first.where("a IS NOT NULL").select("a", "b"), first.where("id IS NOT NULL").select("id", "fp").distinct()
    if rest.isEmpty():
        return links
    again = []
    for i, j in _pairs(4):
        k, m = (x for x in range(4) if x not in (i, j))
        eight = _parts("id", 16 * k, 8, 2) + _parts("id", 16 * m, 8, 2)
        again += [F.concat_ws(":", *[x.cast("string") for x in (four[i], four[j], eight[p], eight[q])]) for p, q in _pairs(4)]
    return links.union(_block_links(_spread(rest, again), radius, 1 << 16).where("a IS NOT NULL").select("a", "b"))


def near_groups(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links of ``radius`` bits or fewer)."""
    marked = stored(fingerprints(docs, shingle), "fingerprints")
    firsts = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(near_links(firsts.select("fp"), radius))
    grouped = firsts.join(roots, firsts.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    names = grouped.join(least, "root").select(F.col("fp").alias("of"), "component_id")
    return marked.join(names, marked.fp == names.of).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


MINIMA = 6
#: Members of a large block that all others of it are compared with first.
REPRESENTATIVES = 64


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """The different shingle hashes of each text in ascending order."""
    hashes, counts = shingle_hashes(texts, size)
    return [np.unique(x) for x in np.split(hashes, np.cumsum(counts)[:-1])]


def sketches(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """(doc_id, row_key, fp: 512 bits, minima: the least of six hashes, same: a digest of the set) over the different shingles of each text; row_key is its SHA-256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _chunks(batches):
            sets = shingle_sets(texts, shingle)
            hashes, counts = np.concatenate(sets), np.array([len(x) for x in sets], np.int64)
            fp = np.stack([majority(_mixed(hashes, k), counts) for k in range(WIDE // 64)], axis=1)
            least, some = np.zeros((len(ids), MINIMA), np.uint64), np.flatnonzero(counts)
            if len(some):
                first = np.concatenate(([0], np.cumsum(counts[some])[:-1]))
                for k in range(MINIMA):
                    least[some, k] = np.minimum.reduceat(_mixed(hashes, 100 + k), first)
            keys = [hashlib.sha256(t).hexdigest() for t in texts]
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "row_key": pa.array(keys, pa.string()), "fp": pa.array([r.tobytes() for r in fp], pa.binary()), "minima": pa.array(list(least.view(np.int64)), pa.list_(pa.int64())), "same": pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets], pa.binary())})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, row_key string, fp binary, minima array<long>, same binary")


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(id, shingles: the shingle set as bytes) of rows (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _chunks(batches, "id"):
            yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "shingles": pa.array([x.tobytes() for x in shingle_sets(texts, shingle)], pa.binary())})

    return texts.mapInArrow(run, "id long, shingles binary")


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the different shingles that both sets have; two empty sets are alike."""
    if not len(a) and not len(b):
        return 1.0
    both = np.sort(np.concatenate((a, b)), kind="stable")
    same = int(np.count_nonzero(both[1:] == both[:-1]))
    return same / (len(both) - same)


def alike_links(fps: list[bytes], sets: list[np.ndarray], radius: int, similarity: float) -> list[tuple[int, int]]:
    """Links of a spanning forest of the pairs within ``radius`` bits whose sets have ``similarity``."""

    def alike(i: int, j: int) -> bool:
        small, big = sorted((len(sets[i]), len(sets[j])))
        return small >= similarity * big * (1 - 1e-9) and jaccard(sets[i], sets[j]) >= similarity

    return forest(fps, radius, alike=alike)


GROUPS = "group long, key long, id long, fp binary"


def _loose_groups(rows: DataFrame, radius: int, large: int, halves: bool = False) -> DataFrame:
    """Rows (group, id, fp) of the members of blocks that are joined by pairs within ``radius``; rows of blocks over ``large`` come back with their key instead.

    Equal sets of members have one group, whatever blocks they come from. With ``halves`` rows carry side 0 or 1,
    and only members of different sides are compared.
    """
    side = ["side"] if halves else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, fps, first, spilled = None, [], [], 0, False
        found: list[tuple] = []

        def close() -> None:
            if len(ids) < 2 or spilled or (halves and not 0 < first < len(ids)):
                return
            tree: dict[int, list[int]] = {}
            for i, j in forest(fps, radius, first if halves else 0):
                few, many = sorted((tree.get(i, [i]), tree.get(j, [j])), key=len)
                many += few
                tree.update(dict.fromkeys([*few, i, j], many))
            for who in {id(x): x for x in tree.values()}.values():
                name = hashlib.blake2b(b",".join(b"%d" % x for x in sorted(ids[i] for i in who)), digest_size=8).digest()
                found.extend((int.from_bytes(name, "little", signed=True), None, ids[i], fps[i]) for i in who)

        for batch in batches:
            for k, i, f, *s in zip(*(batch.column(c).to_pylist() for c in ("key", "id", "fp", *side)), strict=True):
                if k != key:
                    close()
                    key, ids, fps, first, spilled = k, [], [], 0, False
                ids.append(i)
                fps.append(f)
                if halves and not s[0]:
                    first += 1
                if len(ids) > large:
                    spilled = True
                if spilled:
                    found.extend((None, key, a, b) for a, b in zip(ids, fps, strict=True))
                    ids, fps = [], []
                if len(found) > 5000:
                    yield _grouped(found)
                    found.clear()
        close()
        yield _grouped(found)

    dealt = rows.repartition("key").sortWithinPartitions("key", *side, "id")
    return dealt.select("key", "id", "fp", *side).mapInArrow(run, GROUPS)


def _grouped(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_pydict({n: pa.array(c, k) for n, c, k in zip(("group", "key", "id", "fp"), columns, kinds, strict=True)})


def _alike(rows: DataFrame, radius: int, similarity: float) -> DataFrame:
    """Links (a, b) of rows (group, id, fp, shingles) whose sets have ``similarity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, fps, sets = None, [], [], []

        def close() -> pa.RecordBatch:
            links = alike_links(fps, sets, radius, similarity)
            return pa.RecordBatch.from_pydict({"a": pa.array([ids[i] for i, _ in links], pa.int64()), "b": pa.array([ids[j] for _, j in links], pa.int64())})

        for batch in (part for whole in batches for part in chunks(whole, "shingles")):
            for g, i, f, x in zip(*(batch.column(c).to_pylist() for c in ("group", "id", "fp", "shingles")), strict=True):
                if g != group:
                    yield close()
                    group, ids, fps, sets = g, [], [], []
                ids.append(i)
                fps.append(f)
                sets.append(np.frombuffer(x, np.uint64))
        yield close()

    dealt = rows.repartition("group").sortWithinPartitions("group", "id")
    return dealt.select("group", "id", "fp", "shingles").mapInArrow(run, "a long, b long")


def _verified(docs: DataFrame, base: DataFrame, loose: DataFrame, shingle: int, radius: int, similarity: float) -> DataFrame:
    """Links (a, b) of the rows of ``loose`` (group, id, fp) by the shingle sets of their texts."""
    loose = stored(loose.distinct(), "loose")
    wanted = base.join(loose.select("id").distinct(), "id").select("id", F.col("doc_id").alias("of_doc"), F.col("row_key").alias("of_key"))
    wanted = stored(wanted, "wanted")
    rows, _ = parted(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), wanted.select(F.col("of_doc").alias("doc_id")))
    keyed = rows.withColumn("row_key", text_key(F.col("text")))
    texts = keyed.join(wanted, F.expr("doc_id <=> of_doc AND row_key = of_key")).select("id", "text").dropDuplicates(["id"])
    return _alike(loose.join(_sets(texts, shingle), "id"), radius, similarity)


def _cut(rows: DataFrame, n: str, size: int) -> DataFrame:
    """Adds ``chunks``, how many of ``size`` rows the ``n`` of a block make, and ``mine``, the row's."""
    return rows.withColumn("chunks", F.ceil(F.col(n) / size).cast("int")).withColumn("mine", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))


def _sides(first: DataFrame, second: DataFrame, label: str) -> DataFrame:
    """Blocks (key, id, fp, side) of every chunk of ``first`` with every chunk of ``second``; both have key, id, fp, mine and ``others``, the chunks of the other."""
    every = F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("other")
    a = first.select("id", "fp", "key", "mine", every).select("id", "fp", F.xxhash64(F.lit(label), "key", "mine", "other").alias("key"), F.lit(0).alias("side"))
    b = second.select("id", "fp", "key", "mine", every).select("id", "fp", F.xxhash64(F.lit(label), "key", "other", "mine").alias("key"), F.lit(1).alias("side"))
    return a.union(b)


def _represented(left: DataFrame, large: int) -> DataFrame:
    """Blocks of about REPRESENTATIVES members of each large block, drawn by a hash, with each chunk of its other members."""
    chosen = F.pmod(F.xxhash64("id", F.lit("drawn")), F.lit(1 << 30)) * F.col("n") < F.lit(REPRESENTATIVES << 30)
    drawn = _cut(left, "n", large // 2).withColumn("drawn", chosen)
    few = drawn.where("drawn").withColumn("others", F.col("chunks")).withColumn("mine", F.lit(0))
    return _sides(few, drawn.where("NOT drawn").withColumn("others", F.lit(1)), "drawn")


def _rest(left: DataFrame, links: DataFrame, large: int) -> list[tuple[DataFrame, bool]]:
    """Blocks for the pairs of large blocks that aren't in one component of ``links`` yet: of a block, what is not in its largest component against all."""
    roots = components(links)
    named = left.join(roots, F.col("id") == F.col("node"), "left").select("key", "id", "fp", F.coalesce("root", "id").alias("root"))
    sizes = named.groupBy("key", "root").agg(F.count(F.lit(1)).alias("size"))
    most = sizes.groupBy("key").agg(F.max_by("root", F.struct("size", "root")).alias("main"), F.max("size").alias("n_main"), (F.sum("size") - F.max("size")).alias("n_rest"))
    joined = stored(named.join(most.where("n_rest > 0"), "key"), "apart")
    if joined.isEmpty():
        return []
    size, chunks = large // 2, lambda n: F.ceil(F.col(n) / (large // 2)).cast("int")
    main = _cut(joined.where("root = main"), "n_main", size).withColumn("others", chunks("n_rest"))
    rest = _cut(joined.where("root <> main"), "n_rest", size)
    both = rest.select("id", "fp", "key", "mine", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    lo, hi = F.least("mine", "other"), F.greatest("mine", "other")
    across = both.where("mine <> other").select("id", "fp", F.xxhash64("key", lo, hi).alias("key"), (F.col("mine") == hi).cast("int").alias("side"))
    alone = both.where("mine = other").select("id", "fp", F.xxhash64("key", "mine").alias("key"))
    return [(_sides(main, rest.withColumn("others", chunks("n_main")), "apart"), True), (across, True), (alone, False)]


def _verified_links(docs: DataFrame, base: DataFrame, shingle: int, similarity: float, large: int) -> DataFrame:
    """Links (a, b) that join all of ``base`` (id, fp, minima, doc_id, row_key), a row a set of shingles, within ``similarity``.

    Blocks of up to ``large`` members are compared whole. Larger ones are first compared with representatives, which
    join a group of near copies of any size at a cost in proportion to it; then only pairs of different components are
    left, and all of these are compared in chunks.
    """
    radius = wide_radius(similarity)
    minima = [F.get("minima", F.lit(i)) for i in range(MINIMA)]
    first = stored(_loose_groups(_spread(base, minima), radius, large), "blocks")
    loose, left = first.where("group IS NOT NULL").select("group", "id", "fp"), first.where("key IS NOT NULL").select("key", "id", "fp")
    if left.isEmpty():
        return _verified(docs, base, loose, shingle, radius, similarity)
    left = stored(left.join(left.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key"), "large-blocks")
    loose = loose.union(_loose_groups(_represented(left, large), radius, 1 << 30, halves=True).select("group", "id", "fp"))
    links = stored(_verified(docs, base, loose, shingle, radius, similarity), "links")
    more = None
    for blocks, halves in _rest(left, links, large):
        part = _loose_groups(blocks, radius, 1 << 30, halves=halves).select("group", "id", "fp")
        more = part if more is None else more.union(part)
    return links if more is None else links.union(_verified(docs, base, more, shingle, radius, similarity))


def similar_rows(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, large: int = LARGE) -> DataFrame:
    """(doc_id, row_key, keep_id, keep_key) of the rows that have a partner of ``similarity`` or more, and the name of the row of their group that stays.

    That is the one of the smallest doc_id, then row_key (SHA-256 of the text); a row without doc_id stays only where all are without.
    """
    every = stored(sketches(docs, shingle), "sketches")
    base = every.groupBy("same").agg(F.min(F.struct("doc_id", "row_key")).alias("at"), F.first("fp").alias("fp"), F.first("minima").alias("minima"))
    base = stored(base.select("same", F.monotonically_increasing_id().alias("id"), "fp", "minima", "at.doc_id", "at.row_key"), "distinct")
    roots = components(_verified_links(docs, base, shingle, similarity, large))
    group = base.select("same", "id").join(roots, F.col("id") == F.col("node"), "left").select("same", F.coalesce("root", "id").alias("group"))
    named = stored(every.select("doc_id", "row_key", "same").join(group, "same").select("doc_id", "row_key", "group"), "named")
    keep = named.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("keep"))
    kept = keep.where("n > 1").select("group", F.col("keep.doc_id").alias("keep_id"), F.col("keep.row_key").alias("keep_key"))
    return named.join(kept, "group").select("doc_id", "row_key", "keep_id", "keep_key")


def similar_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, large: int = LARGE) -> DataFrame:
    """(doc_id, component_id) of the rows that have a partner of ``similarity`` or more; component_id is the smallest doc_id of the group."""
    return similar_rows(docs, shingle, similarity, large).select("doc_id", F.col("keep_id").alias("component_id"))


def drop_similar(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with all its columns; of each group of similar rows the one that similar_rows names stays, once if it repeats.

    Rows are named by doc_id and text, so null and repeated doc_ids lose no other text.
    """
    rows = stored(similar_rows(docs, shingle, similarity), "similar")
    stays = F.expr("doc_id <=> keep_id AND row_key = keep_key")
    return drop_rows(docs, rows.where(~stays), rows.where(stays).groupBy("doc_id", "row_key").count().where("count > 1"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
