"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of at most 22 bits. Two
fingerprints with two differing bits or fewer have a segment without errors, and
no more than two errors in the segment after it. A segment, padded to 23 bits and
extended by a parity bit, is decoded to every codeword index of the extended
Golay code that is nearest to it: one index at distance 0 or 2, six at distance 4
(its sextet). Words at distance two always share an index. A key is thus the
errorless segment with one index of the next: up to 18 keys a fingerprint.

Fingerprints that share a key are joined and verified. Keys of more than
``BUCKET`` fingerprints take an exact linear way instead of a join of all pairs:
every fingerprint is tied to its 64 one-bit variants, and fingerprints with a
common variant (itself included) differ by two bits at most, none else do.

``similar_texts`` links texts by the Jaccard similarity of their shingle sets, which
texts far more than two bits apart can have. Its fingerprints have 128 bits, cut into
five segments of 23; a key is an index of each of two segments. By the pigeonhole, of
eleven errors or fewer two segments have two each at most, so such texts share a key;
texts with more errors share one more often than not. Texts that meet a near fingerprint
under a key are few; among them alone the pairs are verified on the shingles of whole
texts. A pair of similarity s has one of the first n - ceil(s n) + 1 of either's n
shingles in common, rare ones first, so the verification joins these.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations, repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import BROADCAST_IDS, sent, written
from corvane.llm.components import connected_components

#: The seed of the shingle hash, the generator polynomial of the binary Golay code.
HASH_SEED = 42
GENERATOR = 0b101011100011
#: (shift, bits) of the segments.
SEGMENTS = ((42, 22), (21, 21), (0, 21))
#: Most fingerprints under one key that are joined pair by pair.
BUCKET = 32
#: Hashes, and texts, that are counted at once.
CHUNK, TEXTS = 1 << 16, 2048
#: Of ``similar_texts``: words of a shingle; least Jaccard similarity as numerator and denominator.
WIDTH, SHARE = 5, (4, 5)
#: Segments of 23 bits, how many of them make a key, and most of 128 bits in which near fingerprints differ. Texts at a
#: similarity of 0.8 differ in 19.2 bits on the average, with a deviation of 4.0; unlike texts in 64.
PIECES, TOGETHER, APART = 5, 2, 32
#: Classes of sizes: texts whose sizes differ by more than the similarity allows lie more than so many classes apart.
SIZE_BASE, SIZE_CLASSES = 1.1, 3
#: Times that all texts of a crowded shingle are compared with one of them, before those still apart are with one another.
STARS = 2
#: Longs of a sketch, by which pairs are told apart that share too little.
SKETCH = 16


@cache
def _byte_bits() -> np.ndarray:
    return np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def _majority(hashes: list[bytes], sizes: list[int]) -> np.ndarray:
    """Fingerprints of texts whose shingle hashes lie one after another."""
    octets = np.frombuffer(b"".join(hashes), dtype=np.uint8).reshape(-1, 8)
    count = np.array(sizes, dtype=np.int64)
    at = np.repeat(np.arange(len(sizes), dtype=np.int64) * 256, count)
    bits = np.zeros((len(sizes), 64), dtype=np.uint8)
    for k in range(8):
        seen = np.bincount(at + octets[:, k], minlength=256 * len(sizes)).reshape(len(sizes), 256)
        bits[:, 8 * k : 8 * k + 8] = 2 * (seen @ _byte_bits()) > count[:, None]
    return np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64)


def fingerprints_of(texts, width: int = 3) -> np.ndarray:
    """Signed 64-bit fingerprints of texts (null: no words)."""
    import xxhash

    digest = xxhash.xxh64_digest
    out = np.zeros(len(texts), dtype=np.uint64)
    hashes: list[bytes] = []
    sizes: list[int] = []
    rows: list[int] = []

    def flush() -> None:
        if rows:
            out[rows] = _majority(hashes, sizes)
            hashes.clear(), sizes.clear(), rows.clear()

    for i, text in enumerate(texts):
        words = text.encode("utf-8", "replace").lower().split() if isinstance(text, str) else []
        if not words:
            continue
        tails = [words[k:] for k in range(width)]
        grams = map(b" ".join, zip(*tails)) if len(words) >= width else [b" ".join(words)]
        before = len(hashes)
        hashes.extend(map(digest, grams, repeat(HASH_SEED)))
        sizes.append(len(hashes) - before)
        rows.append(i)
        if len(hashes) >= CHUNK or len(rows) >= TEXTS:
            flush()
    flush()
    return out.view(np.int64)


def fingerprint(texts: DataFrame, text: str = "text", out: str = "fp") -> DataFrame:
    """Add the fingerprint of whole texts as a long. Null, empty and blank texts have fingerprint zero."""

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(fingerprints_of(batch.to_numpy()))

    return texts.withColumn(out, of(F.col(text)))


def _remainder(word: int) -> int:
    for shift in range(11, -1, -1):
        if word >> (shift + 11) & 1:
            word ^= GENERATOR << shift
    return word


@cache
def _decoder() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of the bytes of a 23-bit word, and the error patterns of each remainder (-1: none more)."""
    of_byte = np.array([[_remainder(byte << shift) if byte << shift < 1 << 23 else 0 for byte in range(256)] for shift in (0, 8, 16)], dtype=np.int64)
    single = [_remainder(1 << i) for i in range(23)]
    errors: dict[int, list[int]] = {0: [0]}
    for weight in (1, 2, 3, 4):
        for places in combinations(range(23), weight):
            rest, pattern = 0, 0
            for p in places:
                rest ^= single[p]
                pattern |= 1 << p
            held = errors.setdefault(rest, [])
            # A coset led by three errors is one of the sextets: five patterns of four errors are as near.
            if not held or weight == 4 and held[0].bit_count() == 3:
                held.append(pattern)
    patterns = np.full((2048, 6), -1, dtype=np.int64)
    for rest, held in errors.items():
        patterns[rest, : len(held)] = held
    return of_byte, patterns


def golay_keys(segment: np.ndarray) -> np.ndarray:
    """Codeword indices nearest to 23-bit words: (n, 6), -1 where there are fewer."""
    of_byte, patterns = _decoder()
    rest = of_byte[0][segment & 255] ^ of_byte[1][segment >> 8 & 255] ^ of_byte[2][segment >> 16 & 255]
    error = patterns[rest]
    return np.where(error < 0, -1, (segment[:, None] ^ error) >> 11)


def search_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) pairs of fingerprints: the segment taken as errorless, with an index of the next."""
    wide = fps.view(np.uint64)
    cut = [((wide >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.int64) for shift, bits in SEGMENTS]
    rows, keys = [], []
    for k in range(3):
        index = golay_keys(cut[(k + 1) % 3])
        row, col = np.nonzero(index >= 0)
        rows.append(row)
        keys.append((k << 40) | (cut[k][row] << 12) | index[row, col])
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        fps = batch["fp"].to_numpy(dtype=np.int64)
        row, key = search_keys(fps)
        yield pd.DataFrame({"key": key, "fp": fps[row]})


def links(prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges (src, dst) that connect exactly the distinct values of ``fp`` with two differing bits or fewer."""
    keyed = written(prints.select("fp").where("fp is not null").distinct().mapInPandas(_keyed, "key long, fp long"), "golay")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    busy = written(keyed.join(sizes, "key"), "buckets")
    few = busy.where(F.col("n") <= bucket).select("key", "fp")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= 2
    pairs = few.join(few.select("key", F.col("fp").alias("other")), "key").where((F.col("fp") > F.col("other")) & near)
    many = busy.where(F.col("n") > bucket).select("fp").distinct()
    variants = F.concat(F.array("fp"), *[F.array(F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long"))) for i in range(64)])
    spread = many.select("fp", F.explode(variants).alias("variant"))
    least = spread.groupBy("variant").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low < high")
    stars = spread.join(least, "variant").where("fp > low")
    return pairs.select(F.col("fp").alias("src"), F.col("other").alias("dst")).union(stars.select(F.col("fp").alias("src"), F.col("low").alias("dst"))).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp, component_id) of each row: the least key reachable over links of two differing bits or fewer.

    Null, empty and blank texts have fingerprint zero and link like any other. Rows with
    equal texts share a component; repeated rows are each returned; a null key is returned
    but is never a component's id while the component has another key. No rows: no rows.
    Further columns are ignored.
    """
    prints = written(fingerprint(docs.select(F.col(key).alias("k"), F.col(text).alias("t")), "t").select("k", "fp"), "fingerprints")
    classes = prints.groupBy("fp").agg(F.min("k").alias("least"))
    roots = connected_components(links(prints))
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    rooted = written(rooted, "rooted")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    members = rooted.join(named, "root").select("fp", "component_id")
    return prints.join(members, "fp").select(F.col("k").alias(key), "fp", "component_id")


def shingles_of(text, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 128-bit hashes of a text's shingles, (n, 2); fewer words than ``width`` are one shingle, none have none."""
    import xxhash

    words = text.encode("utf-8", "replace").lower().split() if isinstance(text, str) else []
    if not words:
        return np.zeros((0, 2), dtype=np.uint64)
    grams = map(b" ".join, zip(*[words[k:] for k in range(width)])) if len(words) >= width else [b" ".join(words)]
    wide = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, grams)), dtype=">u8").reshape(-1, 2)
    return wide[np.unique(wide[:, 0], return_index=True)[1]].astype(np.uint64)


def print_of(shingles: np.ndarray) -> np.ndarray:
    """The 128-bit fingerprint of a shingle set as two longs."""
    bits = np.unpackbits(shingles.astype(">u8").view(np.uint8).reshape(len(shingles), 16), axis=1)
    ones = 2 * bits.sum(axis=0, dtype=np.int64) > len(shingles)
    return np.packbits(ones).view(">u8").astype(np.uint64)


def pieces(low: np.ndarray, high: np.ndarray) -> list[np.ndarray]:
    """Five segments of 23 bits of 128-bit fingerprints."""
    low, high = low.view(np.uint64), high.view(np.uint64)

    def cut(x: np.ndarray, shift: int, bits: int) -> np.ndarray:
        return (x >> np.uint64(shift) & np.uint64((1 << bits) - 1)).astype(np.int64)

    return [cut(low, 0, 23), cut(low, 23, 23), cut(high, 0, 23), cut(high, 23, 23), cut(low, 46, 18) | cut(high, 46, 5) << 18]


def wide_keys(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) pairs: the indices of any ``TOGETHER`` segments at once."""
    index = [golay_keys(x) for x in pieces(low, high)]
    rows, keys = [], []
    for no, chosen in enumerate(combinations(range(PIECES), TOGETHER)):
        key, real = np.full((len(low), 1), no, dtype=np.int64), np.ones((len(low), 1), dtype=bool)
        for k in chosen:
            key = (key[:, :, None] << 12 | index[k][:, None, :]).reshape(len(low), -1)
            real = (real[:, :, None] & (index[k] >= 0)[:, None, :]).reshape(len(low), -1)
        row, col = np.nonzero(real)
        rows.append(row)
        keys.append(key[row, col])
    return np.concatenate(rows), np.concatenate(keys)


def _spread_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for at in range(0, len(batch), TEXTS):
            part = batch.iloc[at : at + TEXTS]
            low, high, no = (part[c].to_numpy(dtype=np.int64) for c in ("low", "high", "no"))
            size = np.floor(np.log(part["n"].to_numpy(dtype=np.float64)) / np.log(SIZE_BASE)).astype(np.int64)
            row, key = wide_keys(low, high)
            yield pd.DataFrame({"key": key << 8 | size[row], "no": no[row], "low": low[row], "high": high[row]})


def _differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)).astype(np.int64)


def _meetings(bucket: int):
    """Over rows sorted by key: the texts that meet a near fingerprint, each once or a few times.

    Under a key of ``bucket`` rows or fewer all pairs are compared; of a larger one all texts are given out.
    """
    names = ("key", "no", "low", "high")

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = {c: np.zeros(0, dtype=np.int64) for c in names}
        before = 0  # rows of the held key so far; those held are the first of them
        for batch in batches:
            if not len(batch):
                continue
            old = len(held["key"])
            if old and held["key"][0] >> 8 != batch["key"].iloc[0] >> 8:
                held, old, before = {c: v[:0] for c, v in held.items()}, 0, 0
            key, no, low, high = (np.concatenate([held[c], batch[c].to_numpy(dtype=np.int64)]) for c in names)
            run, size = key >> 8, key & 255
            starts = np.concatenate([[0], np.nonzero(np.diff(run))[0] + 1])
            owner = np.repeat(np.arange(len(starts)), np.diff(np.concatenate([starts, [len(run)]])))
            place = np.arange(len(run)) - starts[owner]
            place[old:] += np.where(owner[old:] == 0, before - old, 0)
            new = np.arange(len(run)) >= old
            found = []
            for lag in range(1, bucket):
                i = np.nonzero(new & (place >= lag) & (place < bucket))[0]
                if not len(i):
                    break
                j = i - lag
                ok = (np.abs(size[i] - size[j]) <= SIZE_CLASSES) & (_differ(low[i], low[j]) + _differ(high[i], high[j]) <= APART)
                found += [no[i[ok]], no[j[ok]]]
            last = np.zeros(len(starts), dtype=np.int64)
            np.maximum.at(last, owner, place)
            found.append(no[(last >= bucket)[owner] & (new | (before <= bucket))])
            yield pd.DataFrame({"no": np.unique(np.concatenate(found))})
            before = int(last[-1]) + 1
            keep = np.arange(starts[-1], len(run))[:bucket]
            held = {"key": key[keep], "no": no[keep], "low": low[keep], "high": high[keep]}

    return meet


def sketch_of(hashes: np.ndarray) -> np.ndarray:
    """Parities of the numbers of hashes that fall to each bit: two sketches differ in as many bits, at most, as there are shingles that only one of two sets has."""
    bits = np.bincount(hashes & (64 * SKETCH - 1), minlength=64 * SKETCH) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _shingles(text: Column, width: int) -> Column:
    @F.pandas_udf("s array<long>, z array<long>")
    def of(texts: pd.Series) -> pd.DataFrame:
        sets = [np.sort(shingles_of(t, width)[:, 0]).view(np.int64) for t in texts]
        return pd.DataFrame({"s": pd.Series(sets, dtype=object), "z": pd.Series([sketch_of(x) for x in sets], dtype=object)})

    return of(text)


def _verified(pairs: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """The pairs (src, dst) of texts whose similarity is ``share`` or more."""
    both = pairs.join(sets.select(F.col("no").alias("src"), F.col("s").alias("a")), "src").join(sets.select(F.col("no").alias("dst"), F.col("s").alias("b")), "dst")
    shared = F.size(F.array_intersect("a", "b"))
    return written(both.where(shared * (share[0] + share[1]) >= (F.size("a") + F.size("b")) * share[0]).select("src", "dst"), "similar-links")


def similar_sets(sets: DataFrame, share: tuple[int, int] = SHARE, bucket: int = BUCKET) -> DataFrame:
    """(node, component) of texts linked by similarity. ``sets`` has no, n, low, high, s, the distinct hashes of shingles, and z, their sketch.

    Texts that begin with a common shingle, in the order from rare to frequent, are compared, if enough of either is
    left from that shingle on and their fingerprints and sketches allow it. Of a shingle that more than ``bucket`` begin with, all are compared with one of them,
    and again with others, ``STARS`` times; then those that are still in different components with one another.
    """
    keyed = sets.select("no", "n", F.explode("s").alias("h"))
    common = keyed.groupBy("h").agg(F.count("*").alias("c")).where("c > 1")
    placed = keyed.join(common, "h", "left").withColumn("c", F.coalesce("c", F.lit(1)))
    rank = F.row_number().over(Window.partitionBy("no").orderBy("c", "h"))
    begun = F.col("n") - F.ceil(F.col("n") * share[0] / share[1]) + 1
    mine = ("no", "n", "rank", "low", "high", "z")
    first = placed.withColumn("rank", rank).where((F.col("rank") <= begun) & (F.col("c") > 1)).select("h", "no", "rank")
    first = written(first, "first-shingles")
    sizes = first.groupBy("h").agg(F.count("*").alias("m")).where("m > 1")
    held = written(first.join(sizes, "h").join(sets.select("no", "n", "low", "high", "z"), "no"), "shingle-buckets")

    def others(x: DataFrame, *more: str) -> DataFrame:
        return x.select("h", *[F.col(c).alias(f"{c}2") for c in (*mine, *more)])

    wide = F.bit_count(F.col("low").bitwiseXOR(F.col("low2"))) + F.bit_count(F.col("high").bitwiseXOR(F.col("high2")))
    # Shared at most: this shingle and all after it, if it is the first that both have.
    most = F.least(F.col("n") - F.col("rank"), F.col("n2") - F.col("rank2")) + 1
    alone = sum((F.bit_count(F.get("z", F.lit(i)).bitwiseXOR(F.get("z2", F.lit(i)))) for i in range(SKETCH)), F.lit(0))
    near = (wide <= APART) & (alone * (share[1] + share[0]) <= (F.col("n") + F.col("n2")) * (share[1] - share[0])) & (most * (share[0] + share[1]) >= (F.col("n") + F.col("n2")) * share[0])
    ends = F.greatest("no", "no2").alias("src"), F.least("no", "no2").alias("dst")
    few, many = held.where(F.col("m") <= bucket).select("h", *mine), held.where(F.col("m") > bucket).select("h", *mine)
    pairs = few.join(others(few), "h").where((F.col("no") > F.col("no2")) & near).select(*ends).distinct()
    links = _verified(written(pairs, "similar-pairs"), sets, share)
    for turn in range(STARS + 1):
        roots = connected_components(links)
        parted = many.join(roots, F.col("no") == F.col("node"), "left").withColumn("c", F.coalesce("component", "no")).drop("node", "component")
        mixed = parted.groupBy("h").agg(F.min("c").alias("least"), F.max("c").alias("most")).where("least < most").select("h")
        parted = written(parted.join(mixed, "h"), "shingles-apart")
        if parted.isEmpty():
            return roots
        if turn < STARS:
            one = F.min(F.struct(F.floor(F.col("rank") * 10 / F.col("n")), F.xxhash64("no", F.lit(turn)), *mine, "c")).alias("one")
            # One that has the shingle early, and so much after it to share.
            other = parted.groupBy("h").agg(one).select("h", *[F.col(f"one.{c}").alias(f"{c}2") for c in (*mine, "c")])
        else:
            other = others(parted, "c")
        rest = parted.join(other, "h").where((F.col("c") > F.col("c2") if turn == STARS else F.col("c") != F.col("c2")) & near)
        links = links.union(_verified(written(rest.select(*ends).distinct(), "similar-pairs"), sets, share))
    return connected_components(links)


def similar_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", row: str = "row_id", width: int = WIDTH, share: tuple[int, int] = SHARE, bucket: int = BUCKET) -> DataFrame:
    """(row, key, component_id) of each row that has ``row``, a unique id, the same in every scan.

    component_id: the least key reachable over links of texts whose sets of ``width``-word
    shingles (ASCII case folded) have a Jaccard similarity of ``share`` or more. Links are found
    by Golay keys of fingerprints: every link is verified, but one of texts that differ in more
    bits than the keys allow for, and that meet no other near text, may be missed. Texts with equal sets are one class; null, empty
    and blank texts are one, too. Repeated rows share a component; a null key is returned but
    names no component that has another key. No rows: no rows.
    """
    import xxhash

    rows = docs.select(F.col(row).alias("row"), F.col(key).alias("k"), F.col(text).alias("t"))

    @F.pandas_udf("sig long, n long, low long, high long")
    def described(batch: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(batch), 4), dtype=np.uint64)
        for i, t in enumerate(batch):
            s = shingles_of(t, width)
            if len(s):
                out[i] = (xxhash.xxh64_intdigest(np.sort(s[:, 0]).tobytes(), HASH_SEED), len(s), *print_of(s))
        return pd.DataFrame(out.view(np.int64), columns=["sig", "n", "low", "high"])

    made = written(rows.select("row", "k", described("t").alias("s")).select("row", "k", "s.*"), "prints")
    same = ["sig", "n", "low", "high"]
    texts = made.groupBy(*same).agg(F.min("k").alias("least"), F.min("row").alias("row"))
    texts = written(texts.withColumn("no", F.monotonically_increasing_id()), "texts")
    keyed = texts.where("n > 0").select("no", "n", "low", "high").mapInPandas(_spread_keys, "key long, no long, low long, high long")
    dealt = keyed.repartition(F.shiftright("key", 8)).sortWithinPartitions("key", "no")
    met = written(dealt.mapInPandas(_meetings(bucket), "no long").distinct(), "met")
    few = written(texts.join(met, "no").select("no", "n", "low", "high", "row"), "met-texts")
    sets = rows.join(sent(few, BROADCAST_IDS), "row").select("no", "n", "low", "high", _shingles(F.col("t"), width).alias("x")).select("no", "n", "low", "high", "x.s", "x.z")
    roots = similar_sets(written(sets, "similar-sets"), share, bucket)
    rooted = written(texts.join(roots, F.col("no") == F.col("node"), "left").select(*same, "least", F.coalesce("component", "no").alias("root")), "rooted")
    members = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select(*same, "component_id")
    return made.join(members, same).select(F.col("row").alias(row), F.col("k").alias(key), "component_id")
