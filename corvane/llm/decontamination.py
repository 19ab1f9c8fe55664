"""Benchmark decontamination by greedy string tiling.

Seeds are runs of ``LEAST_MATCH`` tokens, named by a running Karp-Rabin hash of 64 bits.
Documents give out those of their seeds that a bit table of fixed size does not rule out;
they are joined with the seeds of the benchmark, both sides keyed, so a benchmark of any
length is taken whole. Seeds that follow one another make matches; the longest match whose
tokens are still free is marked again and again, so each token lies in one tile at most, and
passages moved about are still covered. An item leaked where its tiles cover ``COVERAGE`` of it.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import BROADCAST_IDS, sent, with_row_id, written

#: Tokens of the least match, and the share of an item that its tiles must cover.
LEAST_MATCH, COVERAGE = 5, 0.8
#: Bits of the table that seeds are looked up in, whatever the benchmark's size: 16 MB, on every executor.
BITS = 1 << 27
#: Tokens that are hashed at once, and distinct tokens whose hashes a worker remembers.
CHUNK, REMEMBERED = 1 << 18, 1 << 18
#: Fixed value: the base of the rolling hash (modulo 2**64).
BASE = np.uint64(0x9E3779B97F4A7C15)

_WORD = re.compile(r"\w+")


def tokens(text) -> list[str]:
    """Lower-cased runs of letters, digits and underscores; punctuation does not count."""
    return _WORD.findall(text.lower()) if isinstance(text, str) else []


def rolling(numbers: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` token numbers; runs of different widths differ."""
    n = len(numbers) - width + 1
    out = np.full(max(n, 0), width, dtype=np.uint64)
    for k in range(width if n > 0 else 0):
        out = out * BASE + numbers[k : n + k]
    return out


class _Numbers(dict):
    """Token numbers: 64-bit hashes, never zero."""

    def __missing__(self, token: str) -> int:
        import xxhash

        if len(self) >= REMEMBERED:
            self.clear()
        self[token] = found = xxhash.xxh64_intdigest(token.encode("utf-8", "replace")) or 1
        return found

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def tile(seeds: np.ndarray, width: int, size: int) -> list[tuple[int, int, int]]:
    """Tiles (start in the document, start in the item, length) from seeds (document place, item place) of an item of ``size`` tokens.

    Longest first; ties go to the earlier place in the item, then in the document.
    """
    diagonal = seeds[:, 0] - seeds[:, 1]
    seeds = seeds[np.lexsort((seeds[:, 0], diagonal))]
    diagonal = seeds[:, 0] - seeds[:, 1]
    breaks = np.nonzero((np.diff(diagonal) != 0) | (np.diff(seeds[:, 0]) != 1))[0] + 1
    heap = []
    for run in np.split(seeds, breaks):
        heap.append((-len(run) - width + 1, int(run[0, 1]), int(run[0, 0])))
    heapq.heapify(heap)
    in_doc: set[int] = set()
    in_item = bytearray(size)
    tiles = []
    while heap:
        length, j, i = heapq.heappop(heap)
        length = -length
        free = [not in_item[j + k] and i + k not in in_doc for k in range(length)]
        if all(free):
            tiles.append((i, j, length))
            in_item[j : j + length] = b"\x01" * length
            in_doc.update(range(i, i + length))
            continue
        start = None
        for k in range(length + 1):
            open_ = k < length and free[k]
            if open_ and start is None:
                start = k
            elif not open_ and start is not None:
                if k - start >= width:
                    heapq.heappush(heap, (start - k, j + start, i + start))
                start = None
    return tiles


def _seeds(least: int):
    """(item_no, size, width, place, hash) of items; those of fewer than ``least`` tokens are matched whole."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers = _Numbers()
        for batch in batches:
            for no, text in zip(batch["item_no"], batch["t"]):
                item = numbers.of(tokens(text))
                width = min(least, len(item))
                if width:
                    h = rolling(item, width)
                    yield pd.DataFrame({"item_no": no, "size": len(item), "width": width, "place": np.arange(len(h)), "hash": h.view(np.int64)})

    return cut


def _bit_table(seeds: DataFrame) -> np.ndarray:
    """Two bits set for each seed; the driver gets a long for each 64 bits at most."""
    bit = F.explode(F.array(F.pmod("hash", F.lit(BITS)), F.pmod(F.shiftrightunsigned("hash", 32), F.lit(BITS)))).alias("bit")
    longs = seeds.select(bit).groupBy(F.expr("bit div 64").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits")).toArrow()
    table = np.zeros(BITS // 64, dtype=np.int64)
    table[longs["at"].to_numpy()] = longs["bits"].to_numpy()
    return table.view(np.uint64)


def _hits(table, widths: list[int]):
    """(file, place, width, at, hash): the seeds of whole texts that the bit table does not rule out."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers, bits = _Numbers(), table.value
        held: list[tuple[int, int, np.ndarray]] = []

        def maybe(h: np.ndarray) -> np.ndarray:
            at = h & np.uint64(BITS - 1)
            some = np.nonzero(bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1))[0]
            at = h[some] >> np.uint64(32) & np.uint64(BITS - 1)
            return some[(bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)]

        def out() -> Iterator[pd.DataFrame]:
            starts = np.cumsum([0] + [len(x) + 1 for *_, x in held])
            joined = np.zeros(starts[-1], dtype=np.uint64)
            for (*_, x), start in zip(held, starts):
                joined[start : start + len(x)] = x
            files, places = np.array([x[0] for x in held]), np.array([x[1] for x in held])
            real = np.concatenate([[0], np.cumsum(joined > 0)])
            for width in widths:
                if len(joined) < width:
                    continue
                h = rolling(joined, width)
                at = maybe(h)
                at = at[real[at + width] - real[at] == width]
                owner = np.searchsorted(starts, at, "right") - 1
                yield pd.DataFrame({"file": files[owner], "place": places[owner], "width": width, "at": at - starts[owner], "hash": h[at].view(np.int64)})
            held.clear()

        size = 0
        for batch in batches:
            for file, place, text in zip(batch["file"], batch["place"], batch["t"]):
                words = tokens(text)
                if words:
                    held.append((file, place, numbers.of(words)))
                    size += len(words)
                if size >= CHUNK:
                    yield from out()
                    size = 0
        if held:
            yield from out()

    return find


TILED = "file long, place long, item_no long, coverage double, tokens int, tiles array<struct<doc_start:int,item_start:int,tokens:int>>"


def _tiled(coverage: float):
    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for file, place, no, size, width, met in zip(*[batch[c] for c in ("file", "place", "item_no", "size", "width", "met")]):
                met = np.asarray(met, dtype=np.int64)
                tiles = tile(np.stack([met >> 32, met & 0xFFFFFFFF], axis=1), int(width), int(size))
                covered = sum(t[2] for t in tiles) / size
                if covered >= coverage:
                    out.append((file, place, no, covered, size, [dict(zip(("doc_start", "item_start", "tokens"), t)) for t in sorted(tiles)]))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in ("file", "place", "item_no", "coverage", "tokens", "tiles")])

    return mark


def _items(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    items = benchmark.select(F.col(item).alias("item_id"), F.col(text).alias("t")).where("t is not null")
    return written(items.withColumn("item_no", F.monotonically_increasing_id()), "benchmark")


def _leaked(rows: DataFrame, items: DataFrame, least: int, coverage: float) -> DataFrame:
    """(file, place, item_no, coverage, tokens, tiles) of rows (row_id, t) and items whose tiles cover enough."""
    seeds = items.select("item_no", "t").mapInPandas(_seeds(least), "item_no long, size int, width int, place int, hash long")
    seeds = written(seeds, "seeds")
    widths = sorted(r.width for r in seeds.select("width").distinct().collect())
    table = rows.sparkSession.sparkContext.broadcast(_bit_table(seeds))
    found = rows.select("row_id.file", "row_id.place", "t").mapInPandas(_hits(table, widths), "file long, place long, width int, at int, hash long")
    met = written(found, "seed-hits").join(seeds.withColumnRenamed("place", "item_at"), ["hash", "width"])
    both = F.shiftleft(F.col("at").cast("long"), 32).bitwiseOR(F.col("item_at").cast("long"))
    pairs = met.groupBy("file", "place", "item_no", "size", "width").agg(F.collect_list(both).alias("met"))
    # Tiles cover the item's places of seeds at most, each as many tokens as a seed has.
    reach = F.size(F.array_distinct(F.transform("met", lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))))
    pairs = pairs.where(reach * F.col("width") >= F.lit(coverage) * F.col("size"))
    return written(pairs.mapInPandas(_tiled(coverage), TILED), "leaks")


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", least: int = LEAST_MATCH, coverage: float = COVERAGE) -> DataFrame:
    """(key, item_id, coverage, tokens, tiles) of each document row and item whose tiles cover enough of the item.

    Keys are of any type. Places and lengths are in tokens. Tokens are told apart by 64-bit hashes.
    Null and empty texts and items leak nothing; null keys are returned; repeated rows give a pair
    each; no documents or no items: no rows.
    """
    rows = with_row_id(docs.select(F.col(key).alias("key"), F.col(text).alias("t")))
    items = _items(benchmark, item, item_text)
    found = _leaked(rows, items, least, coverage).withColumn("row_id", F.struct("file", "place")).drop("file", "place")
    named = rows.select("row_id", "key").join(found.hint("shuffle_hash") if found.count() > BROADCAST_IDS // 8 else F.broadcast(found), "row_id").join(items.select("item_no", "item_id"), "item_no")
    return named.select(F.col("key").alias(key), "item_id", "coverage", "tokens", "tiles")


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", least: int = LEAST_MATCH, coverage: float = COVERAGE) -> DataFrame:
    """The rows of ``docs`` into which no item leaked, all columns kept."""
    row = "row"
    while row.lower() in (c.lower() for c in docs.columns):
        row = f"_{row}"
    rows = with_row_id(docs, row)
    found = _leaked(rows.select(F.col(row).alias("row_id"), F.col(text).alias("t")), _items(benchmark, item, item_text), least, coverage)
    gone = written(found.select(F.struct("file", "place").alias(row)).distinct(), "leaked-rows")
    return rows.join(sent(gone, BROADCAST_IDS), row, "left_anti").select(*docs.columns)
