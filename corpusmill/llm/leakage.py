"""Problem 7: passages of evaluation items inside training documents.

A prefix-filtered set join. Items and documents become words without case, accents, punctuation, markup and escapes
(single signs in scripts without spaces), and three-word shingles of them. A leak is a window of an item in which about
one word in ten differs, two of 13 at most. Three shingles that do not overlap cannot all be broken by two differing
words, so the necessary prefix of an item is a set of places of which every window holds three that do not overlap; among
all such sets it is the rarest, rarity being the number of documents that hold a shingle, counted over all documents.

The documents are read once. A filter of bounded size over the items' shingles tells which positions may hold one; only
documents in which as many lie together as a leak must leave keep their text. Their hits are joined to the table
(shingle, item, position) of the prefixes, both sides salted, and a hit's diagonal gives the window of the document that
the item's length allows. An alignment over that window verifies it exactly. No step reads the documents again for a part
of the items, and neither items nor documents are collected.

Defined results: null or blank items and texts give no row; an item listed under several ids gives a row for each; an
item of fewer words than a window counts as a whole, one of fewer than six only without any difference; repeated
documents give repeated results; empty tables give an empty table.
"""

from __future__ import annotations

import hashlib
import html
import math
import re
import sys
import unicodedata
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.blocks import cut
from corpusmill.plans.lineage import materialize

WIDTH = 3
#: Words of a window, and signs of one where most of an item is in a script without spaces.
WINDOW, WINDOW_SIGNS = 13, 21
MAX_DIFFERENT, EXACT_BELOW = 0.1, 6
#: Wording that so many items share is nobody's own where it runs on for SHARED_RUN words, seen through shingles of STOCK.
SEVERAL, SHARED_RUN, STOCK = 3, 8, 4
SALTS = 16
PAIRS_PER_TASK = 20_000
#: Items of more words are aligned without looking at all of their spans before.
SPANS_UP_TO = 400
#: Bits of the filter: 32 a shingle, between these powers of two.
FILTER_BITS = (16, 29)
PROBES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)
_TAG = re.compile(r"</?[a-zA-Z!][^<>\n]{0,200}>|<!--|-->")
_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})|\\[nrtfv\"'/\\]")
_HIDDEN = re.compile("[\u00ad\u200b-\u200d\u2060\ufeff]")
_COMBINING = re.compile("[\u0300-\u036f]")
#: Scripts without spaces between words: Thai, Lao, Myanmar, Khmer, kana and Chinese characters.
_UNSPACED = "ก-ໟက-႟ក-៿ぁ-ヿㇰ-ㇿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003134f"


def _marks() -> str:
    """All signs that belong to the letter before them, as a character class."""
    spans: list[list[int]] = []
    for c in range(0x300, sys.maxunicode):
        if unicodedata.category(chr(c))[0] == "M":
            if spans and spans[-1][1] == c - 1:
                spans[-1][1] = c
            else:
                spans.append([c, c])
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in spans)


_MARKS = _marks()
_WORD = re.compile(r"[^\W_]+")
#: Blocks that hold marks or scripts without spaces: few spans, as every text that is not ASCII is searched.
_SPECIAL = re.compile("[\u0300-\u036f\u0483-\u0489\u0590-\u1c7f\u1cd0-\u1dff\u20d0-\u20f0\u2e80-\ud7ff\uf900-\ufaff\ufe20-\ufe2f\U00010000-\U0010ffff]")
_SPECIAL_WORD = re.compile(rf"[{_UNSPACED}][{_MARKS}]*|(?:(?![{_UNSPACED}_])[\w{_MARKS}])+")
_SIGN = re.compile(f"[{_UNSPACED}]")


def _unescape(m: re.Match) -> str:
    code = m[1] or m[2]
    return chr(int(code, 16)) if code and not 0xD800 <= int(code, 16) < 0xE000 else " "


def raw_words(text: str) -> list[str]:
    """Words without punctuation, markup and escapes, as written; single signs of scripts without spaces."""
    if "\\" in text:
        text = _ESCAPE.sub(_unescape, text)
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if not text.isascii():
        if _HIDDEN.search(text):
            text = _HIDDEN.sub("", text)
        if _COMBINING.search(text):
            text = unicodedata.normalize("NFC", text)
        if _SPECIAL.search(text):
            return _SPECIAL_WORD.findall(text)
    return _WORD.findall(text)


def plain(word: str) -> str:
    """A word without case and accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", word.lower()) if not unicodedata.combining(c))


def words_of(text: str | None) -> list[str]:
    return [plain(w) for w in raw_words(text or "")]


class Remembered(dict):
    """A function of a written word; a bounded number of results is remembered."""

    LIMIT = 300_000

    def __init__(self, of):
        super().__init__()
        self.of = of

    def __missing__(self, word: str):
        value = self.of(word)
        if len(self) < self.LIMIT:
            self[word] = value
        return value


class Numbers(dict):
    """Place of a written word's number in ``table``; forgets all words beyond a bound."""

    def __init__(self):
        super().__init__()
        self.known: list[int] = []
        self.table = np.zeros(0, np.uint64)

    def __missing__(self, word: str) -> int:
        self.known.append(word_number(word))
        self[word] = place = len(self.known) - 1
        return place

    def of(self, documents: list[list[str]]) -> np.ndarray:
        """Numbers of the words of all documents, end to end."""
        if len(self) > Remembered.LIMIT:
            self.clear()
            self.known.clear()
            self.table = np.zeros(0, np.uint64)
        place = np.fromiter(map(self.__getitem__, chain.from_iterable(documents)), np.int64)
        if len(self.known) > len(self.table):
            self.table = np.concatenate([self.table, np.array(self.known[len(self.table) :], np.uint64)])
        return self.table[place]


def word_number(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(plain(word).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def shingle_keys(numbers: np.ndarray, width: int) -> np.ndarray:
    """64-bit key of every run of ``width`` words, given as numbers."""
    n = len(numbers) - width + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    key = np.full(n, width, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            key = (key ^ numbers[i : i + n]) * np.uint64(0x9FB21C651E98DF25)
            key ^= key >> np.uint64(29)
    return key


def edits(words: int) -> int:
    """How many words of so many may differ."""
    return 0 if words < EXACT_BELOW else math.ceil(MAX_DIFFERENT * words)


def window_of(words: list[str]) -> int:
    """Words of the shortest passage of an item that counts as a leak: a window, or all of a shorter item."""
    signs = sum(bool(_SIGN.match(w)) for w in words)
    return min(len(words), WINDOW_SIGNS if 2 * signs > len(words) else WINDOW)


def surviving(window: int) -> int:
    """Shingles that a window keeps at least when as many words differ as may."""
    return max(1, window - WIDTH + 1 - WIDTH * edits(window)) if window >= WIDTH else 1


def prefix(cost: list[int], size: int, need: int, width: int = WIDTH) -> list[int]:
    """Cheapest places of which every run of ``size`` places holds ``need`` that are ``width`` apart.

    A chain of places, at least ``width`` apart: the one ``need`` places on is at most ``size`` on. States are the last
    ``need`` places of a chain.
    """
    m = len(cost)
    if m < size or need < 1:
        return []
    last_first = size - 1 - width * (need - 1)
    layer: list[dict[tuple[int, ...], tuple[float, tuple | None]]] = [{} for _ in range(m)]
    for q in range(min(last_first, m - 1) + 1):
        layer[q][(q,)] = (cost[q] + 1, None)
    best: tuple[float, tuple[int, ...]] | None = None
    for p in range(m):
        for state, (total, _) in layer[p].items():
            if len(state) == need and state[0] >= m - size and (best is None or total < best[0]):
                best = (total, state)
            most = state[0] + size if len(state) == need else size - 1 - width * (need - 1 - len(state))
            for q in range(p + width, min(most, m - 1) + 1):
                following = (*state, q)[-need:]
                sum_ = total + cost[q] + 1
                if following not in layer[q] or sum_ < layer[q][following][0]:
                    layer[q][following] = (sum_, state)
    out: list[int] = []
    state = best[1] if best else None
    while state:
        out.append(state[-1])
        state = layer[state[-1]][state][1]
    return sorted(out)


@lru_cache(256)
def _spans(words: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all spans of a window or more, and the words that each has to keep."""
    lo, hi = np.triu_indices(words + 1, window)
    return lo, hi, hi - lo - np.array([edits(n) for n in range(words + 1)])[hi - lo]


def worth_aligning(item: list[str], own: list[bool], named: list[bool], words: list[str]) -> bool:
    """Whether some span of own words, a window or longer, can meet the bounds if order is left out of account.

    As many of its words as may not differ have to occur at all, and 60 % of its names and figures.
    """
    present = np.fromiter(map(set(words).__contains__, item), bool, len(item))
    mine, name = np.array(own), np.array(named)
    total = lambda x: np.concatenate([[0], np.cumsum(x)])
    p, o, n, m = total(present), total(mine), total(name), total(name & present)
    window = window_of(item)
    if window == len(item):
        return bool(o[-1] == window and p[-1] >= window - edits(window) and m[-1] >= 1)
    if p[-1] < window - edits(window) or not m[-1]:
        return False
    if len(item) > SPANS_UP_TO:
        return True
    lo, hi, least = _spans(len(item), window)
    keep = np.flatnonzero(p[hi] - p[lo] >= least)
    lo, hi = lo[keep], hi[keep]
    keep = o[hi] - o[lo] == hi - lo
    lo, hi = lo[keep], hi[keep]
    return bool((m[hi] - m[lo] >= np.maximum(1, 0.6 * (n[hi] - n[lo]) - 1e-9)).any())


def stock_wording(shared: dict[int, int], words: int) -> list[bool]:
    """Whether each word is the item's own. ``shared``: items that hold the STOCK words from each place on, if several.

    Words inside a long run of wording that several items share are nobody's own. A stock opening is as frequent
    throughout; the beginning of a task's form behind it is not.
    """
    own, run = [True] * words, []
    for p in range(words + 1):
        if p in shared:
            run.append((p, shared[p]))
            continue
        inside = {q + i for q, n in run if 2 * n >= max(n for _, n in run) for i in range(STOCK)}
        if len(inside) >= SHARED_RUN:
            for q in inside:
                own[q] = False
        run = []
    return own


def own_segments(own: list[bool]) -> list[tuple[int, int]]:
    out, lo = [], 0
    for hi in range(len(own) + 1):
        if hi == len(own) or not own[hi]:
            if hi > lo:
                out.append((lo, hi))
            lo = hi + 1
    return out


def verify(item: list[str], own: list[bool], named: list[bool], words: list[str]) -> tuple[int, int, int] | None:
    """Longest span of own item words that runs in the given words with at most one in ten different.

    Returns the span's length, the matching words, and the place in ``words``; None if it is too short. A task of the
    same form has other names and figures: of those in the span 60 % must agree.
    """
    need = window_of(item)
    short = need == len(item)
    best = None
    for lo, hi in own_segments(own):
        # a short item counts as a whole; a remainder of an item with shared wording does not
        segment = item[lo:hi]
        if len(segment) < need:
            continue
        names = [p for p in range(len(segment)) if named[lo + p]]
        blocks = [b for b in SequenceMatcher(None, segment, words, False).get_matching_blocks() if b.size]
        for i in range(len(blocks)):
            matched = different = met = 0
            for j in range(i, len(blocks)):
                if j > i:
                    last = blocks[j - 1]
                    different += max(blocks[j].a - last.a - last.size, blocks[j].b - last.b - last.size)
                matched += blocks[j].size
                met += sum(blocks[j].a <= p < blocks[j].a + blocks[j].size for p in names)
                span = blocks[j].a + blocks[j].size - blocks[i].a
                inside = sum(blocks[i].a <= p < blocks[i].a + span for p in names)
                missing = len(segment) - span if short else 0
                allowed = edits(len(item) if len(item) < EXACT_BELOW else span)
                if span + missing >= need and different + missing <= allowed and met >= max(1, 0.6 * inside) and (best is None or span > best[0]):
                    best = (span, matched, blocks[i].b)
    return best


class Filter:
    """Bits of a set of keys, of bounded size: what it refuses is in no item."""

    def __init__(self, power: int):
        self.power = power
        self.bits = np.zeros(1 << (power - 6), np.uint64)

    def places(self, keys: np.ndarray, probe: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys * PROBES[probe]) >> np.uint64(64 - self.power)

    def among(self, keys: np.ndarray) -> np.ndarray:
        """Indices of the keys that may be in the set."""
        at = np.arange(len(keys))
        for probe in range(len(PROBES)):
            where = self.places(keys[at], probe)
            at = at[(self.bits[(where >> np.uint64(6)).astype(np.int64)] >> (where & np.uint64(63))) & np.uint64(1) > 0]
        return at


def _filter(keys: DataFrame, n: int) -> Filter:
    """The filter of a table of ``n`` rows with a column ``key``: bits are set by tasks and united in the cluster."""
    power = min(max(FILTER_BITS[0], math.ceil(math.log2(max(32 * n, 1)))), FILTER_BITS[1])
    out = Filter(power)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            where = np.unique(np.concatenate([out.places(k, i) for i in range(len(PROBES))]))
            word, at = np.unique(where >> np.uint64(6), return_index=True)
            bits = np.bitwise_or.reduceat(np.uint64(1) << (where & np.uint64(63)), at) if len(at) else where
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(bits.view(np.int64))], names=["word", "bits"])

    got = keys.select("key").mapInArrow(run, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out.bits[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return out


def _salted(many: DataFrame, few: DataFrame, key: str, by: Column, how: str = "inner") -> DataFrame:
    """Join by ``key`` in which no key is one task's alone: ``many`` is dealt over SALTS, ``few`` is repeated for each."""
    salt = F.explode(F.array(*(F.lit(i) for i in range(SALTS))))
    return many.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(few.withColumn("__salt", salt), [key, "__salt"], how).drop("__salt")


def item_words(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``k, words`` of the distinct items, and ``item_id, k`` of the listed ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([words_of(t) for t in b.column(1).to_pylist()], pa.list_(pa.string()))], names=["item_id", "words"])

    kind = benchmark.schema["item_id"].dataType.simpleString()
    listed = benchmark.where(F.col("text").isNotNull()).select("item_id", "text").mapInArrow(run, f"item_id {kind}, words array<string>").where(F.size("words") > 0)
    listed = materialize(listed.withColumn("k", F.md5(F.concat_ws(" ", "words"))))
    return listed.groupBy("k").agg(F.min("words").alias("words")), listed.select("item_id", "k").distinct()


def item_places(items: DataFrame) -> DataFrame:
    """``k, kind, p, key, width, window``: the pairs (kind 2), stock shingles (STOCK) and join shingles (0) of every item.

    Items of fewer words than WIDTH have one join shingle, the whole item.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, parts = [], []
            for k, words in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                numbers, window = np.array([word_number(w) for w in words], np.uint64), window_of(words)
                for kind, width in ((2, 2), (STOCK, STOCK), (0, min(WIDTH, len(words)))):
                    keys = shingle_keys(numbers, width)
                    names += [k] * len(keys)
                    parts.append((np.full(len(keys), kind), np.arange(len(keys)), keys, np.full(len(keys), width), np.full(len(keys), window)))
            kind, p, key, width, window = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 5
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(kind, pa.int32()), pa.array(p, pa.int32()), pa.array(key.view(np.int64)), pa.array(width, pa.int32()), pa.array(window, pa.int32())], names=["k", "kind", "p", "key", "width", "window"])

    return items.select("k", "words").mapInArrow(run, "k string, kind int, p int, key bigint, width int, window int")


def _hits(documents: DataFrame, shared, widths: list[int], together: int, span: int, text: str, keep: str) -> DataFrame:
    """``keep, __text, at, keys``: item shingles of every document that has any.

    The text is kept only where ``together`` hits lie within ``span`` positions, as every leak leaves them.
    """
    kind = documents.schema[keep].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        numbers = Numbers()
        for batch in cut(batches, "__text", 1 << 17):
            documents = [raw_words(t) for t in batch.column(1).to_pylist()]
            sizes = np.array([len(d) for d in documents], np.int64)
            start = np.concatenate([[0], np.cumsum(sizes)])
            flat = numbers.of(documents)
            rows, at, found = [], [], []
            for width in widths:
                keys = shingle_keys(flat, width)
                pos = known.among(keys)
                row = np.searchsorted(start, pos, "right") - 1
                inside = pos + width <= start[row + 1]
                rows.append(row[inside])
                at.append((pos - start[row])[inside])
                found.append(keys[pos[inside]])
            row, pos, key = np.concatenate(rows), np.concatenate(at), np.concatenate(found)
            order = np.lexsort((pos, row))
            row, pos, key = row[order], pos[order], key[order].view(np.int64)
            dense = np.zeros(batch.num_rows, bool)
            if len(row) >= together:
                a, b = slice(0, len(row) - together + 1), slice(together - 1, None)
                dense[row[a][(row[a] == row[b]) & (pos[b] - pos[a] <= span)]] = True
            index, first = np.unique(row, return_index=True)
            cutting = pa.array(np.concatenate([first, [len(row)]]), pa.int32())
            lists = [pa.ListArray.from_arrays(cutting, pa.array(x)) for x in (pos.astype(np.int32), key)]
            again = pa.array([i if dense[i] else None for i in index.tolist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(index, pa.int64())), batch.column(1).take(again), *lists], names=[keep, "__text", "at", "keys"])

    read = documents.where(F.col(text).isNotNull()).select(F.col(keep), F.col(text).alias("__text"))
    hits = read.mapInArrow(scan, f"`{keep}` {kind}, __text string, at array<int>, keys array<bigint>")
    return materialize(hits.withColumn("row", F.monotonically_increasing_id()))


def _planned(items: DataFrame, places: DataFrame, frequency: DataFrame) -> DataFrame:
    """``k, n, words, own, named, prefix``: what verification needs of an item, and the places of its necessary prefix.

    Words are one string, and so are the flags of the words: lists of many short values are dear to hand to Python.
    """
    shared = places.where("kind > 0").select("kind", "key", "k").distinct().groupBy("kind", "key").agg(F.count("*").alias("n")).where(F.col("n") >= SEVERAL)
    told = _salted(places.where("kind > 0"), shared.withColumnRenamed("kind", "__kind"), "key", F.col("k")).where("kind = __kind").select("k", "kind", "p", "n", "key")
    counted = _salted(places.where("kind = 0"), frequency, "key", F.col("k"), "left").select("k", "kind", "p", F.coalesce("n", F.lit(0)).alias("n"), "key")
    per = told.unionByName(counted).groupBy("k").agg(F.collect_list(F.struct("kind", "p", "n", "key")).alias("marks"))
    place = pa.struct([("p", pa.int32()), ("key", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines, owns, names, prefixes = [], [], [], []
            for words, marks in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                own = stock_wording({m["p"]: m["n"] for m in marks if m["kind"] == STOCK}, len(words))
                pairs = {m["p"] for m in marks if m["kind"] == 2}
                cost = {m["p"]: m["n"] for m in marks if m["kind"] == 0}
                key = {m["p"]: m["key"] for m in marks if m["kind"] == 0}
                window, out = window_of(words), []
                for lo, hi in own_segments(own):
                    if hi - lo >= window:
                        size = max(window - WIDTH + 1, 1)
                        out += [lo + p for p in prefix([cost[p] for p in range(lo, max(hi - WIDTH + 1, lo + 1))], size, edits(window) + 1)]
                owns.append("".join("01"[x] for x in own))
                names.append("".join("10"[p - 1 in pairs or p in pairs] for p in range(len(words))))
                lines.append(" ".join(words))
                prefixes.append([{"p": p, "key": key[p]} for p in out])
            sizes = pa.array([len(x) for x in owns], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), sizes, *(pa.array(x, pa.string()) for x in (lines, owns, names)), pa.array(prefixes, pa.list_(place))], names=["k", "n", "words", "own", "named", "prefix"])

    schema = "k string, n int, words string, own string, named string, prefix array<struct<p:int,key:bigint>>"
    return materialize(items.join(per, "k").select("k", "words", "marks").mapInArrow(run, schema))


def _candidates(hits: DataFrame, planned: DataFrame) -> DataFrame:
    """``row, k, n, diagonals``: documents and items that share a shingle of the item's prefix."""
    table = planned.select("k", "n", F.explode("prefix").alias("x")).select("k", "n", F.col("x.p").alias("p"), F.col("x.key").alias("key"))
    single = hits.where("__text is not null").select("row", F.explode(F.arrays_zip("at", "keys")).alias("x")).select("row", F.col("x.at").alias("at"), F.col("x.keys").alias("key"))
    return _salted(single, table, "key", F.struct("row", "at")).groupBy("row", "k", "n").agg(F.sort_array(F.collect_set(F.col("at") - F.col("p"))).alias("diagonals"))


def _windows(hits: DataFrame, candidates: DataFrame, keep: str) -> DataFrame:
    """``keep, row, k, at, window``: the words of a document around each group of neighbouring diagonals."""
    kind = hits.schema[keep].dataType.simpleString()
    # alignment is dear and its rows are small: so many tasks as there is work, not as there are bytes
    tasks = max(candidates.sparkSession.sparkContext.defaultParallelism, candidates.count() // PAIRS_PER_TASK)
    per = candidates.repartition(tasks, "row").groupBy("row").agg(F.collect_list(F.struct("k", "n", "diagonals")).alias("items"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain_of = Remembered(plain).__getitem__
        for batch in batches:
            index, out = [], []
            for i, (t, items) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                raw = raw_words(t)
                for item in items:
                    slack = max(3, item["n"] // 6)
                    last = None
                    for d in item["diagonals"]:
                        if last is None or d - last > slack:
                            last = d
                            lo, hi = max(d - 2 * slack, 0), d + item["n"] + 2 * slack
                            index.append(i)
                            out.append((item["k"], lo, " ".join(map(plain_of, raw[lo:hi]))))
            take = pa.array(index, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.string())],
                names=[keep, "row", "k", "at", "window"],
            )

    return hits.select(keep, "row", "__text").join(per, "row").select(keep, "row", "__text", "items").mapInArrow(run, f"`{keep}` {kind}, row bigint, k string, at bigint, window string")


def _verified(windows: DataFrame, planned: DataFrame, keep: str) -> DataFrame:
    """``keep, row, k, span_words, matched_words, word_pos`` of the windows that hold a leak."""
    kind = windows.schema[keep].dataType.simpleString()
    both = _salted(windows, planned.select("k", "words", "own", "named"), "k", F.struct("row", "at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            index, out = [], []
            for i, (at, window, words, own, named) in enumerate(zip(*(b.column(j).to_pylist() for j in range(3, 8)))):
                words, window, own, named = words.split(" "), window.split(" "), [x == "1" for x in own], [x == "1" for x in named]
                if worth_aligning(words, own, named, window) and (got := verify(words, own, named, window)):
                    index.append(i)
                    out.append((got[0], got[1], got[2] + at))
            take = pa.array(index, pa.int64())
            numbers = [pa.array([x[j] for x in out], t) for j, t in enumerate((pa.int32(), pa.int32(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(b.column(j).take(take) for j in range(3)), *numbers], names=[keep, "row", "k", "span_words", "matched_words", "word_pos"])

    schema = f"`{keep}` {kind}, row bigint, k string, span_words int, matched_words int, word_pos bigint"
    return both.select(keep, "row", "k", "at", "window", "words", "own", "named").mapInArrow(run, schema)


def joined(documents: DataFrame, benchmark: DataFrame, text: str = "text", keep: str = "doc_id") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The listed items, the planned items, the hits and the candidates: the join before its verification."""
    items, listed = item_words(benchmark)
    items = materialize(items)
    places = materialize(item_places(items))
    joining = places.where("kind = 0")
    # both sets are small: a width is WIDTH or less, and a window is WINDOW_SIGNS or less
    met = joining.agg(F.count("*").alias("n"), F.sort_array(F.collect_set("width")).alias("widths"), F.collect_set("window").alias("sizes")).first()
    widths, sizes = met.widths, met.sizes
    shared = documents.sparkSession.sparkContext.broadcast(_filter(joining, met.n))
    together, span = min(map(surviving, sizes), default=1), max((w + edits(w) for w in sizes), default=1)
    hits = _hits(documents, shared, widths or [WIDTH], together, span, text, keep)
    frequency = hits.select(F.explode(F.array_distinct("keys")).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    planned = _planned(items, places, frequency)
    return listed, planned, hits, materialize(_candidates(hits, planned))


def leaks(documents: DataFrame, benchmark: DataFrame, text: str = "text", keep: str = "doc_id") -> DataFrame:
    """Rows ``doc_id, item_id, span_words, matched_words, word_pos``: the longest leaked span of each item in each document."""
    listed, planned, hits, candidates = joined(documents, benchmark, text, keep)
    found = _verified(_windows(hits, candidates, keep), planned, keep)
    best = found.groupBy("row", "k").agg(F.max_by(F.struct(keep, "span_words", "matched_words", "word_pos"), F.struct("span_words", -F.col("word_pos"))).alias("r"))
    return _salted(best, listed, "k", F.col("row")).select(F.col(f"r.{keep}").alias(keep), "item_id", "r.span_words", "r.matched_words", "r.word_pos")


def figures(documents: DataFrame, benchmark: DataFrame, text: str = "text", keep: str = "doc_id") -> dict[str, float]:
    """Share of the items' shingle places in a prefix, documents whose text is kept, and candidate pairs."""
    _, planned, hits, candidates = joined(documents, benchmark, text, keep)
    s = planned.agg(F.sum(F.size("prefix")).alias("p"), F.sum(F.greatest(F.col("n") - WIDTH + 1, F.lit(1))).alias("n")).first()
    return {"prefix_share": s.p / max(s.n, 1), "documents_kept": hits.where("__text is not null").count(), "candidate_pairs": candidates.count()}
