"""Problem 4: the language of each document and of each passage, with a confidence.

A document is a mixture of languages. Its pieces (sentences, or lines where sentences have no ends) get a likelihood
under every language from hashed letter trigrams, words and scripts. Expectation-maximisation estimates the document's
proportions. The document's set of languages is then chosen by penalised likelihood: from the smallest share up, a
language goes unless the mixture without it, its proportions fitted again, is less likely by more than PENALTY. Pieces
take their language from the mixture over that set; a run of pieces that is no passage of two sentences joins a
neighbour, and the choice is repeated over the languages that still have a passage. The n-gram model starts from short
lists of function words and is refined on a bounded sample of the corpus itself, whose delivered labels are not trusted.

A passage in a language outside the model is ``und``: its letters or most of its words are unknown to the nearest one.

Defined results: null and blank texts give no row; a text without letters gives language ``und`` and confidence 0;
repeated rows get equal results; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import lexicon
from corpusmill.llm.blocks import CAP, LETTER, NEWLINE, SPACE, Block, cut, span_hashes

#: Languages told apart by n-grams; the others by their script alone.
LATIN = ["it", "en", "fr", "es", "pt", "de", "ro"]
SCRIPTS = ["latin", "cyrillic", "greek", "arabic", "devanagari", "thai", "kana", "han", "hangul"]
BY_SCRIPT = {"ru": {"cyrillic": 1}, "el": {"greek": 1}, "ar": {"arabic": 1}, "hi": {"devanagari": 1}, "th": {"thai": 1}, "ja": {"kana": 0.55, "han": 0.45}, "zh": {"han": 1}, "ko": {"hangul": 0.95, "han": 0.05}}
LANGUAGES = LATIN + list(BY_SCRIPT)
NAMES = {
    "it": "ita italian italiano", "en": "eng english inglese", "fr": "fra fre french francais français francese", "es": "spa spanish espanol español castellano spagnolo",
    "pt": "por portuguese portugues português portoghese", "de": "deu ger german deutsch tedesco", "ro": "ron rum romanian romeno română", "ru": "rus russian russo русский",
    "el": "ell gre greek greco", "ar": "ara arabic arabo", "hi": "hin hindi", "th": "tha thai", "ja": "jpn japanese giapponese jp", "zh": "zho chi chinese cinese cn", "ko": "kor korean",
}
BUCKETS = 1 << 16
SAMPLE_PER_LABEL = 120
SAMPLE_CHARS = 6000
PENALTY = 20.0
#: Signs of a language outside the model: the share of words that the nearest language knows, the share of letters that
#: no modelled language of the script has; decided from so many words and letters on.
KNOWN_SHARE, FOREIGN_SHARE, DECIDING_WORDS, DECIDING_LETTERS = 0.25, 0.015, 12, 40
_FOREIGN = "іїєґўђјљњћџѓќѕқғңөүұһәӣӯҳҷ" + "پچژگکیٹڈڑںےۆۇېە" + "łąężźćńśőűğıčřůňěťďļņģķėųįūāēīåøæðþœ".replace("œ", "")
#: Signs without width inside words.
HIDDEN = re.compile("[\u00ad\u200b-\u200d\u2060\ufeff]")
LONG = 90
_STOP = np.zeros(0x10001, bool)
_STOP[[ord(c) for c in ".!?…。！？।؟;"]] = True
_RANGES = [("latin", 0x41, 0x250), ("latin", 0x1E00, 0x1F00), ("cyrillic", 0x400, 0x530), ("greek", 0x370, 0x400), ("greek", 0x1F00, 0x2000), ("arabic", 0x600, 0x700), ("devanagari", 0x900, 0x980), ("thai", 0xE00, 0xE80), ("kana", 0x3041, 0x3100), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7A4)]


@lru_cache(1)
def _script_table() -> np.ndarray:
    t = np.full(0x10001, len(SCRIPTS), np.uint8)
    for name, lo, hi in _RANGES:
        t[lo:hi] = SCRIPTS.index(name)
    return t


@lru_cache(1)
def _script_likelihood() -> np.ndarray:
    """Log share of each script among the letters of a language; Latin names and terms occur in all of them."""
    p = np.full((len(LANGUAGES), len(SCRIPTS) + 1), 0.001)
    p[:, SCRIPTS.index("latin")] = 0.02
    for i, lang in enumerate(LANGUAGES):
        for script, share in BY_SCRIPT.get(lang, {"latin": 1}).items():
            p[i, SCRIPTS.index(script)] = share * 0.97
    p[:, -1] = 0.5
    return np.log(p)


@lru_cache(1)
def _foreign_table() -> np.ndarray:
    t = np.zeros(0x10001, bool)
    t[[ord(c) for c in _FOREIGN + _FOREIGN.upper() if len(c) == 1 and c not in "Iİ"]] = True
    return t


def normalised_label(label: Column) -> Column:
    """Two-letter code of a label in any spelling; null where it is missing, a placeholder or no language known here."""
    key = F.regexp_extract(F.lower(F.trim(label)), r"^([\p{L}]+)", 1)
    found = F.lit(None).cast("string")
    for code, names in NAMES.items():
        found = F.when(key.isin(code, *names.split()), F.lit(code)).otherwise(found)
    return found


class Pieces:
    """Pieces of a block: spans, their row, letters, sentence ends and the features' buckets."""

    def __init__(self, texts: list[str]):
        b = self.block = Block(texts)
        n = len(b.cp)
        kind = b.kind
        low = np.minimum(b.cp, 0x10000)
        letter = (kind >= LETTER) & (kind <= CAP)
        edge = np.zeros(n + 1, bool)
        edge[b.start] = True
        after_space = np.concatenate([kind[1:] <= NEWLINE, [True]]) & np.concatenate([kind[1:] >= 1, [True]])
        stop = _STOP[low] & (after_space | (low > 0x2000))
        pos = np.flatnonzero(stop | (kind == NEWLINE) | edge[1:]) + 1
        lo = np.concatenate([[0], pos[:-1]])
        long = np.flatnonzero(pos - lo > 2 * LONG)
        if len(long):  # unpunctuated text: cut at the next space after every LONG signs
            wish = np.concatenate([np.arange(lo[i] + LONG, pos[i] - LONG // 2, LONG) for i in long])
            gaps = np.flatnonzero(kind == SPACE) + 1
            at = gaps[np.minimum(np.searchsorted(gaps, wish), len(gaps) - 1)] if len(gaps) else wish[:0]
            pos = np.unique(np.concatenate([pos, at[at > wish - 1]]))
            lo = np.concatenate([[0], pos[:-1]])
        c_letter = np.concatenate([[0], np.cumsum(letter, dtype=np.int32)])
        keep = c_letter[pos] > c_letter[lo]
        self.lo, self.hi = lo[keep], pos[keep]
        self.row = b.rows_of(self.lo)
        self.letters = c_letter[self.hi] - c_letter[self.lo]
        self.ended = stop[self.hi - 1]
        p = len(self.lo)
        # letters of every script in every piece
        at = np.flatnonzero(letter)
        piece = np.repeat(np.arange(p), self.letters)
        script = _script_table()[low[at]]
        self.foreign = np.bincount(piece, _foreign_table()[low[at]], minlength=p)
        self.scripts = np.bincount(piece * (len(SCRIPTS) + 1) + script, minlength=p * (len(SCRIPTS) + 1)).reshape(p, len(SCRIPTS) + 1)
        # of every Latin word: the trigrams at both edges, the last three letters, and the word itself
        latin = letter & (low < 0x250)
        sign = np.where(latin, b.low, 32).astype(np.uint32)
        h = np.concatenate([sign, [32]]).astype(np.uint32)
        h[1:] += sign * np.uint32(1021)
        h[2:] += sign[:-1] * np.uint32(1042441)
        h *= np.uint32(2654435761)
        h >>= np.uint32(16)
        self.word_at = ws = np.flatnonzero(latin & np.concatenate([[True], ~latin[:-1]]))
        we = np.flatnonzero(latin & np.concatenate([~latin[1:], [True]])) + 1
        self.features = np.column_stack([h[np.minimum(ws + 1, n)], h[we], h[we - 1], (span_hashes(b.low, ws, we) >> np.uint64(48)) + np.uint64(BUCKETS)]).astype(np.int32)
        self.from_word, self.to_word = np.searchsorted(ws, self.lo), np.searchsorted(ws, self.hi)

    def score(self, model: np.ndarray) -> np.ndarray:
        """Log likelihood of every piece under every language, up to a constant of the piece."""
        out = self.scripts @ _script_likelihood().T
        own = np.flatnonzero(self.to_word > self.from_word)
        if len(own):
            f = self.features
            words = (model[f[:, 0]] + model[f[:, 1]] + model[f[:, 2]]) * np.float32(0.6) + model[f[:, 3]]
            out[own, : len(LATIN)] += np.add.reduceat(words, self.from_word[own], 0)
        return out


    def known(self, model: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Latin words of every piece that the piece's language knows better than others, and all of them."""
        piece = np.repeat(np.arange(len(self.lo)), self.to_word - self.from_word)
        word = np.arange(len(piece)) + np.repeat(self.from_word - np.cumsum(self.to_word - self.from_word) + (self.to_word - self.from_word), self.to_word - self.from_word)
        own = model[self.features[word, 3], np.minimum(best[piece], len(LATIN) - 1)] > 0.3
        return np.bincount(piece, own, minlength=len(self.lo)), np.bincount(piece, minlength=len(self.lo))


def _tables(counts: np.ndarray) -> np.ndarray:
    """Log likelihood ratios against the mean of the languages, for trigrams and words apart."""
    out = np.zeros_like(counts, np.float32)
    for half, smooth in ((slice(0, BUCKETS), 0.05), (slice(BUCKETS, 2 * BUCKETS), 0.02)):
        c = counts[half] + smooth
        p = c / c.sum(0)
        out[half] = np.clip(np.log(p) - np.log(p.mean(1, keepdims=True)), -6, 6)
    return out


def _seed_counts() -> np.ndarray:
    counts = np.zeros((2 * BUCKETS, len(LATIN)))
    for i, lang in enumerate(LATIN):
        p = Pieces([" " + " ".join(w for w in lexicon.FUNCTION_WORDS[lang].split()) + " "])
        np.add.at(counts[:, i], p.features[:, 3], 1.0)
        np.add.at(counts[:, i], p.features[:, :3].ravel(), 0.3)
    return counts


def fit_ngrams(documents: DataFrame, text: str = "text", label: str = "lang", per_label: int = SAMPLE_PER_LABEL, rounds: int = 3) -> np.ndarray:
    """N-gram table from a sample of at most about ``per_label`` texts for each known label, none over SAMPLE_CHARS.

    The labels only spread the sample over the languages; which language a piece counts for is decided by the model of
    the round before, starting from function words.
    """
    known = documents.select(F.col(text).alias("t"), normalised_label(F.col(label)).alias("l")).where(F.col("t").isNotNull() & (F.length("t") <= SAMPLE_CHARS) & F.col("l").isin(LATIN))
    sizes = {r.l: r["count"] for r in known.groupBy("l").count().collect()}
    rate = F.lit(0.0)
    for lang, n in sizes.items():
        rate = F.when(F.col("l") == lang, F.lit(min(1.0, per_label / n))).otherwise(rate)
    draw = F.pmod(F.xxhash64("t"), F.lit(1_000_000)) < rate * 1_000_000
    texts = sorted(r.t for r in known.where(draw).select("t").collect())
    counts = _seed_counts()
    model = _tables(counts)
    if not texts:
        return model
    blocks = [Pieces(texts[i : i + 100]) for i in range(0, len(texts), 100)]
    for _ in range(rounds):
        counts = _seed_counts()
        for p in blocks:
            ll = p.score(model)
            # a text counts as a whole, and only if most of it agrees: odd sentences are learned from their surroundings
            if not len(p.lo):
                continue
            first = np.flatnonzero(np.concatenate([[True], p.row[1:] != p.row[:-1]]))
            whole = np.add.reduceat(np.maximum(ll - ll.max(1, keepdims=True), -30), first, 0).argmax(1)
            main = np.repeat(whole, np.diff(np.concatenate([first, [len(p.row)]])))
            agree = np.add.reduceat(p.letters * (ll.argmax(1) == main), first) >= 0.7 * np.add.reduceat(p.letters, first)
            sure = (main < len(LATIN)) & np.repeat(agree, np.diff(np.concatenate([first, [len(p.row)]])))
            best = np.minimum(main, len(LATIN) - 1)
            piece = np.maximum(np.searchsorted(p.lo, p.word_at, "right") - 1, 0)
            good = sure[piece]
            flat = (p.features[good] * len(LATIN) + best[piece[good]][:, None]).ravel()
            counts += np.bincount(flat, minlength=counts.size).reshape(counts.shape)
        model = _tables(counts)
    return model


def _fit(like: np.ndarray, share: np.ndarray, row: np.ndarray, first: np.ndarray, weight: np.ndarray, iterations: int) -> np.ndarray:
    """Proportions per document (``share``, one row for each entry of ``first``) by expectation-maximisation."""
    for _ in range(iterations):
        r = share[row] * like
        r *= (weight / np.maximum(r.sum(1), 1e-300))[:, None]
        got = np.add.reduceat(r, first, 0)
        share = (got + 1e-6) * (share > 0)
        share /= np.maximum(share.sum(1, keepdims=True), 1e-300)
    return share


def _likelihood(like: np.ndarray, share: np.ndarray, row: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Log likelihood of every document's pieces under its mixture."""
    return np.add.reduceat(np.log(np.maximum((share[row] * like).sum(1), 1e-300)), first)


def choose(like: np.ndarray, share: np.ndarray, row: np.ndarray, first: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Proportions over the set of penalised likelihood: backward from the smallest share, all documents side by side.

    Every language of a document is tried once; a trial refits the proportions of the others.
    """
    untried = share > 0
    base = _likelihood(like, share, row, first)
    count = np.diff(np.concatenate([first, [len(row)]]))
    while True:
        trial = np.flatnonzero(((share > 0).sum(1) > 1) & untried.any(1))
        if not len(trial):
            return share
        part = np.concatenate([np.arange(first[i], first[i] + count[i]) for i in trial])
        local, start = np.repeat(np.arange(len(trial)), count[trial]), np.concatenate([[0], np.cumsum(count[trial])[:-1]])
        k = np.where(untried[trial], share[trial], np.inf).argmin(1)
        without = share[trial].copy()
        without[np.arange(len(trial)), k] = 0
        without /= without.sum(1, keepdims=True)
        without = _fit(like[part], without, local, start, weight[part], 4)
        other = _likelihood(like[part], without, local, start)
        untried[trial, k] = False
        drop = base[trial] - other < PENALTY
        share[trial[drop]], base[trial[drop]] = without[drop], other[drop]
        untried &= share > 0


class Runs:
    """Runs of one language in one text; those that are no passage join a neighbour, the smallest first."""

    def __init__(self, lang: np.ndarray, ll: np.ndarray, letters: np.ndarray, ended: np.ndarray):
        total = lambda x: np.concatenate([np.zeros((1, *x.shape[1:]), x.dtype), np.cumsum(x, 0)])
        self.lang, self.letters, self.ended = lang, letters, ended
        self.c_letters, self.c_ll = total(letters), total(ll)
        counted = ended | (ended.sum() < 0.25 * len(ended))
        # a Chinese or Japanese sign holds about as much as three letters
        self.c_sentences = {d: total(((letters * d >= 12) & counted).astype(np.int64)) for d in (1, 3)}

    def weak(self, lo: int, hi: int, k: int) -> bool:
        """Whether a run is less than two sentences."""
        dense = 3 if LANGUAGES[k] in ("zh", "ja") else 1
        n = int(self.c_letters[hi] - self.c_letters[lo]) * dense
        sentences = int(self.c_sentences[dense][hi] - self.c_sentences[dense][lo]) + int(not self.ended[hi - 1] and self.letters[hi - 1] * dense >= 12 and hi - lo > 1)
        return n < 40 or max(sentences, n // (50 if LANGUAGES[k] == "th" else 90)) < 2

    def settle(self) -> np.ndarray:
        """Language of each piece once every run is a passage, or one run is left: n log n in the runs."""
        lang = self.lang
        edge = np.flatnonzero(np.concatenate([[True], lang[1:] != lang[:-1]]))
        begin = edge.tolist()
        end = edge[1:].tolist() + [len(lang)]
        kind = lang[edge].tolist()
        before, after = list(range(-1, len(begin) - 1)), [*range(1, len(begin)), -1]
        live = [True] * len(begin)
        size = lambda i: int(self.c_letters[end[i]] - self.c_letters[begin[i]])
        heap = [(size(i), begin[i], i, end[i]) for i in range(len(begin)) if self.weak(begin[i], end[i], kind[i])]
        heapq.heapify(heap)
        while heap:
            _, lo, i, hi = heapq.heappop(heap)
            if not live[i] or (begin[i], end[i]) != (lo, hi) or before[i] < 0 and after[i] < 0:
                continue
            sides = [j for j in (before[i], after[i]) if j >= 0]
            own = self.c_ll[hi] - self.c_ll[lo]
            kind[i] = max((kind[j] for j in sides), key=lambda k: own[k])
            for j in sides:
                if kind[j] == kind[i]:
                    live[j] = False
                    begin[i], end[i] = min(begin[i], begin[j]), max(end[i], end[j])
                    if j == before[i]:
                        before[i] = before[j]
                        if before[j] >= 0:
                            after[before[j]] = i
                    else:
                        after[i] = after[j]
                        if after[j] >= 0:
                            before[after[j]] = i
            if self.weak(begin[i], end[i], kind[i]):
                heapq.heappush(heap, (size(i), begin[i], i, end[i]))
        out = np.empty(len(lang), np.int64)
        for i, alive in enumerate(live):
            if alive:
                out[begin[i] : end[i]] = kind[i]
        return out


def _languages(p: Pieces, ll: np.ndarray) -> np.ndarray:
    """Language of every piece of a block."""
    first = np.flatnonzero(np.concatenate([[True], p.row[1:] != p.row[:-1]]))
    count = np.diff(np.concatenate([first, [len(p.row)]]))
    row = np.repeat(np.arange(len(first)), count)
    like = np.exp(np.maximum(ll - ll.max(1, keepdims=True), -60))
    weight = np.minimum(p.letters, 200).astype(float)
    share = _fit(like, np.full((len(first), ll.shape[1]), 1 / ll.shape[1]), row, first, weight, 12)
    best = (np.log(np.maximum(share[row], 1e-9)) + ll).argmax(1)
    pending = np.flatnonzero(np.maximum.reduceat(best, first) != np.minimum.reduceat(best, first))
    held = np.zeros(share.shape, bool)
    held[row, best] = True
    while len(pending):
        part = np.concatenate([np.arange(first[i], first[i] + count[i]) for i in pending])
        local, start = np.repeat(np.arange(len(pending)), count[pending]), np.concatenate([[0], np.cumsum(count[pending])[:-1]])
        s = np.where(held[pending], np.maximum(share[pending], 1e-9), 0)
        s = choose(like[part], s / s.sum(1, keepdims=True), local, start, weight[part])
        best[part] = np.where(s[local] > 0, np.log(np.maximum(s[local], 1e-9)) + ll[part], -np.inf).argmax(1)
        share[pending] = s
        again = []
        for i in pending:
            lo, hi = first[i], first[i] + count[i]
            if (best[lo:hi] != best[lo]).any():
                best[lo:hi] = Runs(best[lo:hi], ll[lo:hi], p.letters[lo:hi], p.ended[lo:hi]).settle()
            now = np.zeros(share.shape[1], bool)
            now[best[lo:hi]] = True
            # fewer languages than the mixture has: their choice is repeated without those that have no passage
            if 1 < now.sum() < (share[i] > 0).sum():
                again.append(i)
            held[i] = now
        pending = np.array(again, np.int64)
    return best


def passages_of(texts: list[str], model: np.ndarray) -> list[list[tuple[int, int, str, float]]]:
    """For each text its passages: start, end, language and confidence."""
    hidden = {i for i, t in enumerate(texts) if not t.isascii() and HIDDEN.search(t)}
    p = Pieces([HIDDEN.sub("", t) if i in hidden else t for i, t in enumerate(texts)])
    out: list[list[tuple[int, int, str, float]]] = [[] for _ in texts]
    if len(p.lo):
        ll = p.score(model)
        best = _languages(p, ll)
        begin = np.flatnonzero(np.concatenate([[True], (p.row[1:] != p.row[:-1]) | (best[1:] != best[:-1])]))
        end = np.concatenate([begin[1:], [len(best)]]) - 1
        # posterior of each passage, softened by length: neighbouring n-grams repeat evidence
        letters = np.add.reduceat(p.letters, begin)
        total = np.add.reduceat(ll, begin, 0) / np.maximum(1.0, np.sqrt(letters / 12))[:, None]
        e = np.exp(total - total.max(1, keepdims=True))
        sure = e[np.arange(len(begin)), best[begin]] / e.sum(1)
        unknown = (letters >= DECIDING_LETTERS) & (np.add.reduceat(p.foreign, begin) > FOREIGN_SHARE * letters)
        known, of = p.known(model, best)
        known, of = np.add.reduceat(known, begin), np.add.reduceat(of, begin)
        unknown |= (best[begin] < len(LATIN)) & (of >= DECIDING_WORDS) & (known < KNOWN_SHARE * of)
        base = p.block.start[p.row[begin]]
        for row, lo, hi, k, c, u in zip(p.row[begin].tolist(), (p.lo[begin] - base).tolist(), (p.hi[end] - base).tolist(), best[begin].tolist(), sure.tolist(), unknown.tolist()):
            out[row].append((lo, hi, "und", 0.0) if u else (lo, hi, LANGUAGES[k], c))
    for i in hidden:  # back to places in the text as delivered
        kept = [k for k, c in enumerate(texts[i]) if not HIDDEN.match(c)] + [len(texts[i])]
        out[i] = [(kept[lo], kept[hi], lang, c) for lo, hi, lang, c in out[i]]
    for i, t in enumerate(texts):
        if not out[i] and t.strip():
            out[i] = [(0, len(t), "und", 0.0)]
        elif out[i]:
            out[i][0] = (0, *out[i][0][1:])
            s, _, lang, c = out[i][-1]
            out[i][-1] = (s, len(t), lang, c)
            for k in range(1, len(out[i])):
                out[i][k - 1] = (out[i][k - 1][0], out[i][k][0], *out[i][k - 1][2:])
    return out


def passages(documents: DataFrame, model: np.ndarray, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per passage: columns ``keep``, ``passage``, ``start_pos``, ``end_pos``, ``language``, ``confidence``."""
    keep = keep or ["doc_id"]
    kept = documents.where(F.col(text).isNotNull()).select(*keep, F.col(text).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]) + ", passage int, start_pos bigint, end_pos bigint, language string, confidence double"
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in cut(batches, "__text", 1 << 16):
            found = passages_of(batch.column(batch.num_columns - 1).to_pylist(), table)
            index = [i for i, f in enumerate(found) for _ in f]
            flat = [(k, *x) for f in found for k, x in enumerate(f)]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.float64()]
            columns = [pa.array([x[j] for x in flat], kind) for j, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(index, pa.int64())) for c in batch.columns[:-1]), *columns], names=[*keep, "passage", "start_pos", "end_pos", "language", "confidence"])

    return kept.mapInArrow(run, schema)
