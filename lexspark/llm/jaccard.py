"""N-gram Jaccard join by parity sketches.

A shingle toggles one bit of a sketch (XOR), so the Hamming distance of two sketches never exceeds
the symmetric difference of the two shingle sets. Sets of sizes a and b whose similarity is at least
T % differ in at most d = (a + b)(100 - T) / (100 + T) shingles. Shingles are dealt to d + 1 parts;
of two such sets at least one part is untouched by the difference, so joining on the parts' parity
(pigeonhole), for each band of sizes, loses no link. What the join brings together is looked at by the
Hamming distance of sketches of a few bits a shingle, and what remains is verified on the sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexspark.llm.common import connected_components, drop, held, release, shared_keys, skew_join, small, small_batches, written

#: Members of a block, and the bytes of their sets, that a verifying task holds at once (twice).
BLOCK_ROWS = 2048
BLOCK_BYTES = 16 << 20
#: A worker's memo of word hashes; when full it starts anew.
WORD_MEMO = 300_000
#: Sets that a task remembers, so as to give their keys once only.
SEEN = 400_000
_U = np.uint64


class WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_MEMO:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ _U(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(29))


def shingle_set(text: str | None, k: int, of_word: WordHash) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; of the whole sequence if it is shorter."""
    words = text.encode().lower().split() if text else []  # bytes: only A-Z and ASCII white space
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(of_word.__getitem__, words), np.uint64, n)
    if n < k:
        return np.array([xxhash.xxh3_64_intdigest(h.tobytes(), seed=n + 1)], np.uint64)
    m = n - k + 1
    out = np.zeros(m, np.uint64)
    for i in range(k):
        out = mixed(out + h[i : i + m], i + 1)
    return np.unique(out)


@lru_cache(maxsize=8)
def bands(percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Band k holds sizes lows[k] to lows[k + 1] - 1; its join also takes in the sizes of band k + 1.
    parts[k] and spare[k]: parts of its sketch, and how many of these may be empty in a set."""
    low, lows = 1, []
    while low < 1 << 40:
        lows.append(low)
        low = max(low + 1, -(-low * 100 // percent))
    a = np.array([x - 1 for x in lows[1:]], dtype=object)  # largest size of the band
    b = np.array([min(x * 100 // percent, y - 1) for x, y in zip(a, [*lows[2:], low], strict=True)], dtype=object)
    d = np.array([(x + y) * (100 - percent) // (100 + percent) for x, y in zip(a, b, strict=True)], np.int64)
    spare = 2 + d // 24
    return np.array(lows, np.int64), np.where(d > 0, d + 1 + spare, 0), spare


def part_keys(hashes: np.ndarray, percent: int) -> np.ndarray:
    """The join keys of a set: for the joins of its own band and of the band below, the hash of
    (band, part, parity of the part). Parity here is over 2**64 positions, kept as the XOR of them.

    Empty parts tell nothing apart. `spare` parts more than d + 1 make up for as many of them: a set
    with no more empty parts than that leaves them out, any other set emits all.
    """
    lows, parts, spare = bands(percent)
    own = int(np.searchsorted(lows, len(hashes), side="right")) - 1
    out = []
    for band in (own, own - 1):
        if band < 0 or not (p := int(parts[band])):
            continue
        at = (mixed(hashes, 101) % _U(p)).astype(np.int64)
        order = np.argsort(at, kind="stable")
        at = at[order]
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        word = np.bitwise_xor.reduceat(mixed(hashes, 202)[order], first)
        at = at[first]
        if p - len(at) > spare[band]:
            full = np.zeros(p, np.uint64)
            full[at] = word
            at, word = np.arange(p), full
        out.append(mixed(word + mixed(at.astype(np.uint64) << _U(16) | _U(band), 303), 404))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def sketch(hashes: np.ndarray, words: int) -> np.ndarray:
    """Parity sketch of `words` 64-bit words (a power of two), one bit toggled for each shingle. Its halves
    XORed are the sketch of half the length."""
    bit = (mixed(hashes, 505) & _U(words * 64 - 1)).astype(np.int64)
    return np.packbits((np.bincount(bit, minlength=words * 64) & 1).astype(np.uint8), bitorder="little").view(np.uint64)


def sketch_words(n: int) -> int:
    """Words of the sketch that travels with a set of `n` shingles: 2 to 4 bits a shingle, of very large
    sets less, so that their sketches tell less apart and more is left to the verification."""
    return 1 << min(9, max(0, (int(n) * 2 - 1).bit_length() - 6))


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Sketches (last axis) of `words` words, of sketches as long or longer."""
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def may_link(apart, n, m, percent: int):
    """Whether sketches `apart` bits apart, of sets of n and m shingles, leave a link possible."""
    return (apart * (100 + percent) <= (n + m) * (100 - percent)) & (np.minimum(n, m) * 100 >= percent * np.maximum(n, m))


def _sets(df: DataFrame, k: int, percent: int, keys: bool) -> DataFrame:
    """`df`, whose last column is the text, with n, band, sid (hash of the set, null if empty) and either
    keys (the part keys) and sketch, or set, in the text's place. A task gives each set's once, however
    many copies it meets while it remembers SEEN sets: for further ones keys are empty and sketch is null, or the row is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, seen, lows = held("words", None, WordHash), set(), bands(percent)[0]
        none = np.empty(0, np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                rows, n, sids, rest, bits = [], [], [], [], []
                for row, t in enumerate(part.column(part.num_columns - 1)):
                    s = shingle_set(t.as_py(), k, memo)
                    sid = xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None
                    new = len(s) > 0 and sid not in seen
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(sid)
                    if not keys and not new:
                        continue
                    rows.append(row)
                    n.append(len(s))
                    sids.append(sid)
                    if keys:
                        rest.append(part_keys(s, percent).view(np.int64) if new else none)
                        bits.append(sketch(s, sketch_words(len(s))).tobytes() if new else None)
                    else:
                        rest.append(s.tobytes())
                if not rows:
                    continue
                if keys:
                    offsets = np.zeros(len(rest) + 1, np.int32)
                    np.cumsum([len(x) for x in rest], out=offsets[1:])
                    last = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rest))), pa.array(bits, pa.binary())]
                else:
                    last = [pa.array(rest, pa.binary())]
                band = np.searchsorted(lows, n, side="right") - 1
                made = [*(c.take(pa.array(rows)) for c in part.columns[:-1]), pa.array(n, pa.int64()), pa.array(band), pa.array(sids, pa.int64()), *last]
                yield pa.RecordBatch.from_arrays(made, names=names)

    kept = df.schema.fields[:-1]
    more = T.StructType.fromDDL("n long, band long, sid long, " + ("keys array<long>, sketch binary" if keys else "set binary")).fields
    names = [f.name for f in (*kept, *more)]
    return df.mapInArrow(run, T.StructType([*kept, *more]))


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])


def spanning_ties(members: list[tuple], percent: int) -> list[tuple[int, int]]:
    """Pairs of `members` (side, sid, group, n, sketch) that may link by their sketches, enough to span
    what such pairs connect. Sides 0 and 1 are compared with each other only, side 2 with itself. Pairs
    already in one group need no look."""
    members.sort(key=lambda m: (m[3], m[1]))
    side, size = np.array([m[0] for m in members]), np.array([m[3] for m in members])
    of = {g: i for i, g in enumerate({m[2] for m in members})}
    root = np.array([of[m[2]] for m in members])
    words = min(len(m[4]) for m in members) // 8
    bits = np.stack([folded(np.frombuffer(m[4], np.uint64), words) for m in members])
    found = []
    for i in range(1, len(members)):
        low = int(np.searchsorted(size, -(-percent * size[i] // 100)))
        rest = low + np.flatnonzero((root[low:i] != root[i]) & ((side[low:i] == 2) | (side[low:i] != side[i])))
        if not len(rest):
            continue
        apart = np.bitwise_count(bits[rest] ^ bits[i]).sum(1, dtype=np.int64)
        for j in rest[may_link(apart, size[rest], size[i], percent)]:
            if root[j] != root[i]:
                found.append((members[j][1], members[i][1]))
                root[root == root[i]] = root[j]
    return found


def spanning_links(members: list[tuple[int, int, np.ndarray]], percent: int) -> list[tuple[int, int]]:
    """Links that span the linked groups of `members` (side, sid, set). Sides 0 and 1 are compared
    with each other only, side 2 with itself. Pairs already in one group need no look: a member meets
    the last one of each group first, so one of a large group is placed by few comparisons."""
    members.sort(key=lambda m: (len(m[2]), m[1]))
    size = np.array([len(m[2]) for m in members])
    side = np.array([m[0] for m in members])
    words = 1 << max(0, int(size.max()) // 8).bit_length()
    bits = np.stack([sketch(m[2], words) for m in members])
    root = np.arange(len(members))
    found = []

    def meet(i: int, rest: np.ndarray) -> None:
        rest = rest[(root[rest] != root[i]) & ((side[rest] == 2) | (side[rest] != side[i]))]
        if not len(rest):
            return
        apart = np.bitwise_count(bits[rest] ^ bits[i]).sum(1, dtype=np.int64)
        near = may_link(apart, size[rest], size[i], percent)
        for j in rest[near][np.argsort(apart[near], kind="stable")]:
            if root[j] != root[i] and _linked(members[j][2], members[i][2], percent):
                found.append((members[j][1], members[i][1]))
                root[root == root[i]] = root[j]

    for i in range(1, len(members)):
        low = int(np.searchsorted(size, -(-percent * size[i] // 100)))
        before = root[low:i][::-1]
        meet(i, i - 1 - np.sort(np.unique(before, return_index=True)[1]))
        meet(i, np.arange(low, i))
    return found


def _blocks(rows: DataFrame, unit: list[str], kept: list[str]) -> DataFrame:
    """`rows` (unit, nb, sid, kept) dealt to pairs of blocks (unit, i, j, side, sid, kept): large units are cut
    into nb blocks and every two blocks meet in a task of their own, so that memory stays bounded and
    no pair is left out."""
    rows = rows.withColumn("own", F.pmod(F.xxhash64("sid", F.lit(5)), F.col("nb")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    rows = rows.select(*unit, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), side.alias("side"), "sid", *kept)
    return rows.repartition(*unit, "i", "j").sortWithinPartitions(*unit, "i", "j")


def _by_unit(units: DataFrame, n_unit: int, member, links) -> DataFrame:
    """(a, b): `links` of the members of each run of rows with the same first `n_unit` columns; `member` makes
    one of the rest of a row. Rows of one sid in a unit count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        at, members, seen = None, [], set()
        for batch in batches:
            found = []
            for row in zip(*batch.columns, strict=True):
                unit = tuple(x.as_py() for x in row[:n_unit])
                if unit != at:
                    if len(members) > 1:
                        found += links(members)
                    at, members, seen = unit, [], set()
                side, sid = row[n_unit].as_py(), row[n_unit + 1].as_py()
                if sid not in seen:
                    seen.add(sid)
                    members.append(member(side, sid, row[n_unit + 2 :]))
            if found:
                yield _pairs(found)
        if len(members) > 1:
            yield _pairs(links(members))

    return units.mapInArrow(run, "a long, b long")


def _tied(met: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Components (node, component) of the sets that share a part key and may link by their sketches.

    First each set meets the least one of its keys. Then keys whose members are not all in one component
    by that, and of which there are more than two, have their members compared in blocks.
    """
    ties = written(met.select(F.col("low").alias("a"), F.col("sid").alias("b")).distinct(), "ties")
    of_a, of_b = (sketches.select(F.col("sid").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}")) for c in "ab")
    both = skew_join(ties, of_a, "a").join(of_b, "b").select("a", "b", "n_a", "n_b", "s_a", "s_b")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            n, m = (batch.column(i).to_numpy() for i in (2, 3))
            apart = np.empty(len(n), np.int64)
            for row, (x, y) in enumerate(zip(batch.column(4), batch.column(5), strict=True)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                words = min(len(x), len(y))
                apart[row] = np.bitwise_count(folded(x, words) ^ folded(y, words)).sum()
            kept = pa.array(may_link(apart, n, m, percent))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept)], names=["a", "b"])

    first = written(both.mapInArrow(near, "a long, b long"), "first")
    groups = written(connected_components(first), "tied")
    rest = met.join(met.groupBy("k").agg(F.count("*").alias("n")).where("n > 1"), "k", "left_semi")
    rest = written(rest.select("k", "sid").union(rest.select("k", "low").distinct()), "rest")
    rest = rest.join(groups.withColumnRenamed("node", "sid"), "sid", "left").select("k", "sid", F.coalesce("component", "sid").alias("group"))
    rest = written(rest, "grouped")
    alike = [F.bit_xor(F.xxhash64("sid", F.lit(i))).alias(f"x{i}") for i in (1, 2)]
    alike = rest.groupBy("k").agg(F.count("*").alias("n"), F.min("group").alias("low"), F.max("group").alias("high"), *alike)
    units = alike.where("low <> high").groupBy("n", "x1", "x2").agg(F.min("k").alias("k"))  # keys with the same members are looked at once
    units = written(units.select("k", F.greatest(F.ceil(F.col("n") / BLOCK_ROWS), F.lit(1)).alias("nb")), "units")
    if not units.limit(1).count():
        return groups
    rows = _blocks(skew_join(rest, units, "k").join(sketches, "sid"), ["k"], ["group", "n", "sketch"])
    more = _by_unit(rows, 3, lambda side, sid, x: (side, sid, x[0].as_py(), x[1].as_py(), x[2].as_py()), lambda m: spanning_ties(m, percent))
    links = groups.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more)
    return connected_components(links)


def _verified(sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that span the linked groups within each component of ties of `sets` (sid, set,
    component, band, nb): the members of a component that a band's join takes in are compared, since
    others differ too much in size."""
    units = _blocks(sets, ["component", "band"], ["set"])
    links = _by_unit(units, 4, lambda side, sid, x: (side, sid, np.frombuffer(x[0].as_py(), np.uint64)), lambda m: spanning_links(m, percent))
    with small_batches(sets.sparkSession):
        return written(links, "links")


def _grouped(df: DataFrame, key: str, text: str, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """head (doc, at, n, band, sid), a row for each of `df`, and groups (node, component) of linked sids;
    sids linked with no other are not in groups."""
    base = df.select(F.col(key).alias("doc"), F.xxhash64(text).alias("at"), F.col(text).alias("text"))
    with small_batches(df.sparkSession):
        made = written(_sets(base, k, percent, keys=True), "parts")
    head = written(made.select("doc", "at", "n", "band", "sid"), "head")
    met = shared_keys(made.where(F.size("keys") > 0).select(F.col("sid").alias("id"), F.explode("keys").alias("k"))).withColumnRenamed("id", "sid")
    sketches = written(made.where("sketch is not null").select("sid", "n", "sketch").dropDuplicates(["sid"]), "sketches")
    drop(made)
    coarse = _tied(met, sketches, percent).withColumnRenamed("node", "sid")
    sizes = head.where("sid is not null").groupBy("sid").agg(F.first("n").alias("n"), F.first("band").alias("band"), F.min("at").alias("at"))
    joins = F.explode(F.array("band", F.col("band") - 1)).alias("band")
    members = written(sizes.join(coarse, "sid").select("sid", "at", "n", "component", joins), "members")
    many, bytes_held = F.count("*"), F.sum("n") * 8
    blocks = members.groupBy("component", "band").agg(many.alias("many"), F.greatest(F.ceil(many / BLOCK_ROWS), F.ceil(bytes_held / BLOCK_BYTES), F.lit(1)).alias("nb"))
    members = members.join(blocks.where("many > 1"), ["component", "band"])
    members = written(members.select("sid", "at", "component", "band", "nb"), "blocks")
    wanted = small(members.select("at").distinct(), 64)
    sets = _sets(base.join(wanted, "at", "left_semi").select("text"), k, percent, keys=False)
    sets = sets.select("sid", "set").join(small(members.select("sid", "component", "band", "nb"), 112), "sid")
    groups = written(connected_components(_verified(sets, percent)), "groups")
    return head, groups


def near_duplicates(
    df: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80
) -> DataFrame:
    """(key, n_shingles, component_id) for every row of `df`.

    Words are runs outside ASCII white space, A-Z lower-cased; a row's set holds its distinct k-word
    shingles, the whole sequence if it has fewer words, nothing if it has none or the text is null.
    Rows are linked when 100 * intersection >= percent * union; an empty set is linked with nothing.
    component_id is the smallest key reachable by links (null keys count last; a row linked to
    nothing has its own key). Rows may repeat, in whole or in their keys: each is returned. Other
    columns are not read.

    Equal sets become one member first, so copies cost one row each. The pigeonhole join ties what shares
    a key only where the sketches leave a link possible: each member with the least one of its key, then,
    where a key's members are not one component by that, in blocks. Components of these ties are a
    superset of the true groups, and their sets are verified block against block.
    """
    head, groups = _grouped(df, key, text, k, percent)
    head = head.select("doc", "n", "sid")
    classes = head.where("sid is not null").groupBy("sid").agg(F.min("doc").alias("low"))
    classes = classes.join(groups.withColumnRenamed("node", "sid"), "sid", "left")
    classes = classes.withColumn("group", F.coalesce("component", "sid"))
    lows = classes.groupBy("group").agg(F.min("low").alias("low"))
    named = classes.select("sid", "group").join(lows, "group").select("sid", "low")
    return head.join(named, "sid", "left").select(
        F.col("doc").alias(key), F.col("n").alias("n_shingles"), F.coalesce("low", "doc").alias("component_id")
    )


def kept_rows(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """(doc, at, many): of each group of `near_duplicates`, the key and the hash (xxhash64) of the text of
    one row, that of the smallest key (null last), then of the smallest hash; `many` rows of `df` have
    both. A text without words is a group with its equals of the same key."""
    head, groups = _grouped(df, key, text, k, percent)
    rows = head.groupBy("doc", "at", "sid").agg(F.count("*").alias("many"))
    place = F.struct(F.col("doc").isNull().alias("none"), "doc", "at", "many").alias("place")
    classes = rows.where("sid is not null").groupBy("sid").agg(F.min(place).alias("place"))
    classes = classes.join(groups.withColumnRenamed("node", "sid"), "sid", "left")
    one = classes.groupBy(F.coalesce("component", "sid")).agg(F.min("place").alias("place"))
    return one.select("place.doc", "place.at", "place.many").union(rows.where("sid is null").select("doc", "at", "many"))
