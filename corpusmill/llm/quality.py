"""Problem 2: statistics of each text, and the documents that are not natural prose.

``text_statistics`` gives one row per document. ``fit_mixture`` fits a Gaussian mixture to the standardised statistics
of *all* documents by expectation-maximisation: every iteration is one job that adds the tasks' sufficient statistics up
in the cluster. Components start from the inspected examples of ``EXAMPLES`` and are named after the examples
that fall into them. ``classify`` gives the class and its probability.

Defined results: null and blank texts get zero statistics and the class ``blank``; repeated rows get equal results;
extra columns pass through untouched; an empty table gives an empty table.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import lexicon
from corpusmill.llm.blocks import CAP, DIGIT, LETTER, MARK, NEWLINE, OTHER, SPACE, Block, cut, member, runs, span_hashes, word_hash

STATS = ["n_chars", "n_words", "mean_word_length", "symbol_ratio", "digit_ratio", "punctuated_lines", "common_words", "prose_share", "distinct_share", "line_length"]
CLASSES = ["prose", "list", "table", "junk"]
PROSE_DENSITY = 0.17
FAR_DENSITY = 0.06
FAR_LINE = 14


@lru_cache(1)
def _common() -> tuple[np.ndarray, np.ndarray]:
    words = sorted({word_hash(w) for s in lexicon.FUNCTION_WORDS.values() for w in s.split()})
    chars = np.zeros(0x10001, bool)
    chars[[ord(c) for c in lexicon.FUNCTION_CHARS]] = True
    return np.array(words, np.uint64), chars


@lru_cache(1)
def _scripts() -> tuple[np.ndarray, np.ndarray]:
    """Letters of scripts without spaces: Chinese and Japanese; Thai and its neighbours."""
    han, thai = np.zeros(0x10001, bool), np.zeros(0x10001, bool)
    han[0x3041:0x3100] = han[0x3400:0x9FFF] = True
    thai[0x0E01:0x0EE0] = thai[0x1000:0x10A0] = thai[0x1780:0x17D4] = True
    return han, thai


_HIDDEN = re.compile("[\u00ad\u200b-\u200d\u2060\ufeff]")
_MARKUP, _ENTITY = re.compile(r"</?[a-zA-Z][^<>]{0,300}>"), re.compile(r"&(#\d+|#x[0-9a-fA-F]+|[a-zA-Z]+);")
_ENDS = np.zeros(0x10001, bool)
_ENDS[[ord(c) for c in ".!?…。！？।؟;:»”’\"')」』"]] = True
_SEPARATORS = np.zeros(0x10001, bool)
_SEPARATORS[[ord(c) for c in "|»>+#=_[]{}<@*•▸→~^$%&/"]] = True
_STOPS = np.zeros(0x10001, bool)
_STOPS[[ord(c) for c in ".!?…。！？।؟\n"]] = True


def statistics(texts: list[str]) -> np.ndarray:
    """One row of STATS per text; blank texts give zeros."""
    out = np.zeros((len(texts), len(STATS)))
    texts = [_HIDDEN.sub("", t) if not t.isascii() and _HIDDEN.search(t) else t for t in texts]
    b = Block([_MARKUP.sub(" ", html.unescape(t)) if "</" in t or "&" in t and _ENTITY.search(t) else t for t in texts])
    n, rows = len(b.cp), len(texts)
    if not n:
        return out
    common, function_char = _common()
    han_of, thai_of = _scripts()
    kind, doc_start = b.kind, b.start
    low = np.minimum(b.cp, 0x10000) if b.cp.max() > 0x10000 else b.cp
    foreign = bool((low >= 0x0E00).any())
    han, thai, fchar = (han_of[low], thai_of[low], function_char[low]) if foreign else (np.zeros(n, bool),) * 3
    letter = (kind >= LETTER) & (kind <= CAP)
    csum = lambda x: np.concatenate([[0], np.cumsum(x, dtype=np.int32)])
    doc_edge = np.zeros(n + 1, bool)
    doc_edge[doc_start] = True

    # words: runs of letters of spaced scripts, never across rows; signs of unspaced scripts count by the pair
    spaced = letter & ~(han | thai) if foreign else letter
    ws = np.flatnonzero(spaced & (np.concatenate([[True], ~spaced[:-1]]) | doc_edge[:-1]))
    stop = np.flatnonzero(spaced & (np.concatenate([~spaced[1:], [True]]) | doc_edge[1:])) + 1
    hashes = span_hashes(b.low, ws, stop)
    is_common = member(hashes, common)
    varied = np.ones(rows, bool)
    far_words = np.flatnonzero(low[ws] > 0x370)
    if len(far_words):  # a few words over and over are no sentences, whatever ends them
        wdoc = b.rows_of(ws[far_words])
        with np.errstate(over="ignore"):
            once = np.unique(hashes[far_words] ^ (wdoc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
        of = np.bincount(wdoc, minlength=rows)
        varied = (of < 40) | (np.bincount(wdoc[once], minlength=rows) >= 0.2 * np.minimum(of, 200))
    blank = np.concatenate([(kind == SPACE) | (kind == NEWLINE), [True]])
    short = stop - ws == 1
    is_common &= ~short | ((blank[stop] | doc_edge[stop]) & (blank[ws - 1] | doc_edge[ws]))
    solid = ~blank[:-1]
    c_words = np.zeros(n + 1, np.int32)
    c_words[ws + 1] = 1
    c_words = np.cumsum(c_words, dtype=np.int32)
    c_common = np.zeros(n + 1, np.int32)
    c_common[ws[is_common] + 1] = 1
    c_common = np.cumsum(c_common, dtype=np.int32)
    c_solid, c_digit, c_letter, c_other = csum(solid), csum(kind == DIGIT), csum(letter), csum(kind == OTHER)
    c_separator, c_far = csum(_SEPARATORS[low]), csum((low > 0x370) & letter)
    if foreign:
        c_pairs, c_signs, c_thai = csum(han | thai), csum(fchar), csum(thai)
    over = lambda c, lo, hi: c[hi] - c[lo]
    words = lambda lo, hi: over(c_words, lo, hi) + (over(c_pairs, lo, hi) * 0.5 if foreign else 0)
    commons = lambda lo, hi: over(c_common, lo, hi) + (over(c_signs, lo, hi) * 0.6 + over(c_thai, lo, hi) * 0.15 if foreign else 0)

    def pieces(cut_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Spans between the cuts that hold a sign."""
        pos = np.flatnonzero(cut_at | doc_edge[1:]) + 1
        lo = np.concatenate([[0], pos[:-1]])
        keep = over(c_solid, lo, pos) > 0
        return lo[keep], pos[keep]

    ls, le = pieces(kind == NEWLINE)
    if not len(ls):
        return out
    ldoc = b.rows_of(ls)
    place = np.maximum.accumulate(np.where(solid, np.arange(n, dtype=np.int32), -1))
    ends = _ENDS[low[place[le - 1]]]
    n_lines = np.maximum(np.bincount(ldoc, minlength=rows), 1)
    lwords, lcommon, lsolid = words(ls, le), commons(ls, le), over(c_solid, ls, le)

    # a clause is prose-like by its share of common words, with few figures and separators; it counts once
    cs, ce = pieces(_STOPS[low] | (kind == NEWLINE))
    cdoc, csolid = b.rows_of(cs), over(c_solid, cs, ce)
    squeezed = b.low[letter]
    with np.errstate(over="ignore"):
        key = span_hashes(squeezed, c_letter[cs], c_letter[ce]) ^ (cdoc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    first = np.zeros(len(cs), bool)
    first[np.unique(key, return_index=True)[1]] = True
    repeated = ~first & (over(c_letter, cs, ce) >= 12)
    line_of = np.searchsorted(ls, cs, "right") - 1
    far = over(c_far, cs, ce) * 2 > over(c_letter, cs, ce)
    cw = words(cs, ce)
    dense = np.maximum(commons(cs, ce) / np.maximum(cw, 1), np.where(cw < 5, (lcommon / np.maximum(lwords, 1))[line_of], 0))
    clean = (over(c_other, cs, ce) + over(c_digit, cs, ce) < 0.45 * csolid) & ((over(c_separator, ls, le) < 0.05 * lsolid) & (over(c_digit, ls, le) < 0.4 * lsolid))[line_of]
    prose = clean & np.where(far, (dense >= FAR_DENSITY) | (ends & (over(c_far, ls, le) >= FAR_LINE))[line_of] & varied[cdoc], dense >= PROSE_DENSITY) & (lwords[line_of] >= 4)
    total = np.maximum(np.bincount(cdoc, csolid, minlength=rows), 1)

    lo, hi = doc_start[:-1], doc_start[1:]
    n_words, n_solid = words(lo, hi), np.maximum(over(c_solid, lo, hi), 1)
    out[:, 0] = hi - lo
    out[:, 1] = n_words
    out[:, 2] = over(c_letter, lo, hi) / np.maximum(n_words, 1)
    out[:, 3] = over(c_other, lo, hi) / n_solid
    out[:, 4] = over(c_digit, lo, hi) / n_solid
    out[:, 5] = np.bincount(ldoc, ends, minlength=rows) / n_lines
    out[:, 6] = commons(lo, hi) / np.maximum(n_words, 1)
    out[:, 7] = np.bincount(cdoc, csolid * (prose & ~repeated), minlength=rows) / total
    out[:, 8] = 1 - np.bincount(cdoc, csolid * repeated, minlength=rows) / total
    out[:, 9] = np.log1p(np.bincount(ldoc, lsolid, minlength=rows) / n_lines)
    out[np.bincount(ldoc, minlength=rows) == 0] = 0
    return out


#: Inspected examples, written for this purpose: class and text. They seed the mixture and name its components.
EXAMPLES = [
    ("prose", "The committee met on Monday and decided to repair the old bridge before winter. Nobody knew who would pay for it. The mayor said that the money had been set aside, but the clerk could not find the papers."),
    ("prose", "Il sindaco ha aperto la riunione con un lungo discorso sulla strada. Nessuno sapeva che il ponte era stato chiuso da due anni. La maestra ha chiesto perché i lavori non erano ancora finiti."),
    ("prose", "so we went down to the river and it was cold and the boat was not there anymore and then my brother said that we should have asked the man at the shop because he knows about the boats\nand so we went back to the house and nobody was there"),
    ("prose", "La semana pasada el consejo habló de las cuentas del año. Según el alcalde, no hay dinero para el tren. ¿Quién lo va a pagar?"),
    ("prose", "Nach der Sitzung ging der Lehrer mit den Kindern an den See. Sie haben dort eine alte Mühle gesehen, und niemand wusste davon.\nAm Abend kam der Bus nicht, weil die Brücke gesperrt war."),
    ("prose", "Le maire a lu le rapport devant le conseil. « Qui va payer ? » demanda le médecin. Personne ne le savait encore."),
    ("prose", "Никто не знал, что мост был закрыт. Учитель рассказал об этом детям, когда они пришли в школу.\nВесной город починил дорогу у реки."),
    ("prose", "昨日、先生は子供たちと湖へ行った。古い水車がそこにあったことを誰も知らなかった。橋が閉まっていたので、バスは来なかった。"),
    ("prose", "去年冬天，市长在会议上说要修好那座旧桥。没有人知道钱从哪里来。老师问为什么工作还没有完成。"),
    ("prose", "A shopping trip ended badly for us in the rain.\n- bread\n- oil\n- two apples\nThat was all we had on the list, and the man at the shop said that he would not sell it on a Sunday. We walked home along the river and talked about the winter that was coming."),
    ("list", "bread, oil, salt, apples, rope, nails, hammer, lamp, paint, glass, wool, honey, soap, boots, tent, clock, ladder, bottle, candle, chair, table"),
    ("list", "- pane\n- olio\n- sale\n- mele rosse\n- corda\n- chiodi\n- martello\n- lampada\n- vernice\n- vetro"),
    ("list", "1. Hammer Alfodex\n2. Lamp Brunax\n3. Rope Candex;\n4. Soap Dorvex.\n5. Honey Elnox\n6. Tent Fargex"),
    ("list", "Home / Shop / Lamps / Sale\nHome | News | Contact | Help\nHome > Shop > Tents > Sale\nHome » Help » Login » News"),
    ("list", "Alvardi M., 12 Bronetale, 021-334\nBrunelli S., 48 Cormont, 044-981\nCarvoni L., 7 Doristel, 033-120\nDelmar P., 91 Fasnago, 027-556"),
    ("list", "#alba #mare sole #vento!!! @carla :-) #luna #notte pane #riva @bruno #cielo :-) #estate!!! #casa"),
    ("table", "id,name,price,count,date\n1,lamp,120.50,44,12/03/2019\n2,rope,8.90,310,02/11/2020\n3,tent,89.00,12,30/06/2018\n4,soap,2.35,800,17/01/2021"),
    ("table", "lamp        120.5     44      1201.3\nrope        8.9       310     77.02\ntent        89        12      640.118\nsoap        2.35      800     5.5"),
    ("table", "| item | price | stock |\n|---|---|---|\n| lamp | 120.5 | 44 |\n| rope | 8.9 | 310 |\n| tent | 89.0 | 12 |"),
    ("table", "[08:12:44] INFO disk=44 rc=0\n[08:13:01] WARN queue=981 rc=3\n[08:13:09] ERR node=120 rc=7\n[08:14:55] INFO disk=47 rc=0"),
    ("table", "Name: ____\nStreet: ____\nTown = ?\nPhone: n/a\nSigned [ ]\nPaid [ ]\nDate: ....\nNotes: n/a"),
    ("junk", "q8Zt4LkVn2RwXc7YpBd1MfGh5JsKa9TuEiOo3PzWvQxNr6CmSbDyHlFg+/aTeUjI2oPkL8mNqZxWcErVtBy7UiOp4AsDfGhJkLzXcVbNm"),
    ("junk", "#~*xx-~+¬&¬ = 7**~~§z_&^z~@-$z§*k^x^>=>$ ?@$^1?§-@z_~¬=x+*q$&#¬k@+^z-q§%¬ _¬*q §x§z&<"),
    ("junk", "Click here to read the offer of the day. Click here to read the offer of the day. Click here to read the offer of the day. Click here to read the offer of the day. Click here to read the offer of the day. Click here to read the offer of the day. Click here to read the offer of the day."),
    ("junk", "4f9a 77b2 0c1d e5a8 9f30 11cc 82de 6b4a 90f1 3d2e aa07 5c68 f1e2 0b9d 47a3 c8e6 2d15 7fb0"),
]

#: Dimensions of the mixture: all statistics but the character count, the word count by its logarithm.
DIMENSIONS = STATS[1:]
COMPONENTS = len(EXAMPLES)
SMOOTHING = 0.05


def _vectors(stats: np.ndarray) -> np.ndarray:
    x = stats[:, 1:].copy()
    x[:, 0] = np.log1p(x[:, 0])
    x[:, 1] = np.log1p(np.minimum(x[:, 1], 200))
    return x


def _seed() -> tuple[np.ndarray, list[str]]:
    return _vectors(statistics([t for _, t in EXAMPLES])), [c for c, _ in EXAMPLES]


def log_density(x: np.ndarray, model: dict) -> np.ndarray:
    """Log of weight times density of every component."""
    out = np.empty((len(x), len(model["weight"])))
    for k in range(out.shape[1]):
        y = (x - model["mean"][k]) @ model["whiten"][k]
        out[:, k] = model["constant"][k] - 0.5 * np.einsum("ij,ij->i", y, y)
    return out


def _with_densities(model: dict) -> dict:
    whiten, constant = [], []
    for k, cov in enumerate(model["cov"]):
        chol = np.linalg.cholesky(cov)
        whiten.append(np.linalg.inv(chol).T)
        constant.append(np.log(max(model["weight"][k], 1e-12)) - np.log(np.diag(chol)).sum() - 0.5 * len(cov) * np.log(2 * np.pi))
    return model | {"whiten": np.array(whiten), "constant": np.array(constant)}


def _responsibility(x: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray]:
    ll = log_density(x, model)
    top = ll.max(1, keepdims=True)
    r = np.exp(ll - top)
    total = r.sum(1, keepdims=True)
    return r / total, (top + np.log(total))[:, 0]


def text_statistics(documents: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default ``doc_id``) and one column per statistic; null and blank texts get zeros."""
    keep = keep or ["doc_id"]
    kept = documents.select(*keep, F.col(text).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]) + ", " + ", ".join(f"{c} double" for c in STATS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches, "__text", 1 << 16):
            stats = statistics([t or "" for t in batch.column(batch.num_columns - 1).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(stats[:, i]) for i in range(len(STATS)))], names=[*keep, *STATS])

    return kept.mapInArrow(run, schema)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in STATS])


def _added(parts: DataFrame) -> np.ndarray:
    """Sum of the arrays ``s`` of all tasks, place by place: one job, and the driver gets one number a place."""
    rows = parts.select(F.posexplode("s").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(len(rows))
    for r in rows:
        out[r["at"]] = r["v"]
    return out


def fit_mixture(stats: DataFrame, iterations: int = 8, tolerance: float = 1e-3) -> dict:
    """Mixture over the standardised statistics of all rows that are not blank.

    One job for mean and scale, then one per iteration; the sufficient statistics of the tasks are added up in the
    cluster, so the driver gets ``K * (1 + d + d*d)`` numbers an iteration. On an empty table the seeds alone are the model.
    """
    seeds, labels = _seed()
    d, live = len(DIMENSIONS), stats.where("n_words > 0 or symbol_ratio > 0 or digit_ratio > 0").select(*STATS)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = np.zeros(1 + 2 * d)
        for b in batches:
            x = _vectors(_matrix(b))
            s += np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)])
        yield pa.RecordBatch.from_arrays([pa.array([s.tolist()], pa.list_(pa.float64()))], names=["s"])

    s = _added(live.mapInArrow(moments, "s array<double>"))
    s = s if len(s) else np.zeros(1 + 2 * d)
    s += np.concatenate([[len(seeds)], seeds.sum(0), (seeds * seeds).sum(0)])
    center = s[1 : 1 + d] / s[0]
    scale = np.sqrt(np.maximum(s[1 + d :] / s[0] - center**2, 1e-4))
    z = (seeds - center) / scale
    model = _with_densities({"center": center, "scale": scale, "weight": np.full(len(z), 1 / len(z)), "mean": z, "cov": np.array([np.eye(d) * 0.3] * len(z))})
    before = -np.inf
    for _ in range(iterations):

        def gather(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            k = len(model["weight"])
            total = np.zeros((k, 1 + d + d * d))
            like = 0.0
            for b in batches:
                x = (_vectors(_matrix(b)) - model["center"]) / model["scale"]
                r, ll = _responsibility(x, model)
                like += ll.sum()
                total[:, 0] += r.sum(0)
                total[:, 1 : 1 + d] += r.T @ x
                total[:, 1 + d :] += r.T @ (x[:, :, None] * x[:, None, :]).reshape(len(x), -1)
            yield pa.RecordBatch.from_arrays([pa.array([[like, *total.ravel()]], pa.list_(pa.float64()))], names=["s"])

        got = _added(live.mapInArrow(gather, "s array<double>"))
        got = got if len(got) else np.zeros(1 + len(z) * (1 + d + d * d))
        like, total = got[0] / s[0], got[1:].reshape(len(z), -1)
        # one pseudo-row at the seed with a round covariance keeps rare components in place
        n = total[:, 0] + 1
        mean = (total[:, 1 : 1 + d] + z) / n[:, None]
        cov = (total[:, 1 + d :].reshape(-1, d, d) + z[:, :, None] * z[:, None, :] + 0.3 * np.eye(d)) / n[:, None, None] - mean[:, :, None] * mean[:, None, :] + SMOOTHING * np.eye(d)
        model = _with_densities(model | {"weight": n / n.sum(), "mean": mean, "cov": cov})
        if abs(like - before) < tolerance:
            break
        before = like
    # each component is named after the examples that fall into it; one without examples after the nearest
    r, _ = _responsibility(z, model)
    names = []
    for k in range(len(z)):
        votes = {c: r[[i for i, x in enumerate(labels) if x == c], k].sum() for c in CLASSES}
        best = max(votes, key=votes.get)
        names.append(best if votes[best] > 0.05 else labels[int(np.argmin(((z - model["mean"][k]) ** 2).sum(1)))])
    return model | {"names": names}


def classify(stats: DataFrame, model: dict) -> DataFrame:
    """Adds ``text_class`` (prose, list, table, junk or blank) and ``class_probability``."""
    fields = stats.schema.fields
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", text_class string, class_probability double"
    of_class = np.array([[n == c for c in CLASSES] for n in model["names"]], float)
    names = np.array(CLASSES, object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            s = _matrix(b)
            r, _ = _responsibility((_vectors(s) - model["center"]) / model["scale"], model)
            p = r @ of_class
            best = p.argmax(1)
            blank = (s[:, 1] == 0) & (s[:, 3] == 0) & (s[:, 4] == 0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.where(blank, "blank", names[best]).tolist(), pa.string()), pa.array(np.where(blank, 1.0, p.max(1)))], names=[*b.schema.names, "text_class", "class_probability"])

    return stats.mapInArrow(run, schema)


def not_prose(classified: DataFrame) -> DataFrame:
    """Rows that the mixture gives a class other than prose."""
    return classified.where("text_class not in ('prose', 'blank')")
