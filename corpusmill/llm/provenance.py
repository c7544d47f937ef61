"""Problem 5: source files that nobody wrote by hand.

Two linear support-vector classifiers, each over one view of a file, trained on a bounded sample of the corpus:

* the body view: hashed character n-grams of the code and of its shape, path components, leading parts of function names.
  All comment lines are masked, in training and in scoring, so it learns what such files look like, not what they say;
* the comment view: hashed character n-grams of single comment lines; a file scores as its highest line. It decides the
  files whose body is like any other and which only say where they come from.

Labels come from telling paths, the file's form, and the few announcements that are common everywhere (``MARKER``). Only
the body's labels are taken as complete. For comment lines they are not: a file that announces itself in other words is
unlabelled, so the lines of all other files are down-weighted (positive and unlabelled learning), a line counts as often
as files hold it up to that weight, and of a file whose path tells only its most telling line is a positive one (multiple
instances). So announcements in words that no list has are learned from the files whose path tells.

Whole repositories are held out: the body's threshold is chosen on them, and ``validation`` reports on them.

Defined results: null and blank texts are never cases; repeated rows get equal results; an empty table gives an empty
table; without labelled files of both kinds nothing is found.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.blocks import Block, cut

SAMPLE_PER_STRATUM = 2500
SAMPLE_CHARS = 20_000
BITS = 16
CODE, SHAPE, PATH, NAME = range(4)
SPACES = 4
#: What a labelled line weighs against an unlabelled one.
LABELLED_WEIGHT = 30
REMEMBERED_LINES = 100_000
COMMENT = re.compile(r"^[^\S\n]*(?://+!?|#(?!include|define|pragma|if|el|endif|undef|error|!?\[)|/\*+|\*(?!/)|--|<!--)[^\S\n]?(.*)$", re.M)
FUNCTION = re.compile(r"\b([A-Za-z_][A-Za-z0-9_]{3,})\s*(?:<[^<>;]{0,40}>)?\(|\bconst ([A-Za-z_][A-Za-z0-9_]{3,}) = \(")
PART = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+(?![a-z])")
#: Announcements in common use everywhere, in the two languages of the corpus.
MARKER = re.compile(
    r"(?i)^\W*(?:(?:this|the) (?:file|code|module) (?:is|was|has been) |code |file |questo file è stato )?(?:auto(?:matically)?[-\s]?)?(?:generated|generato)(?: automaticamente)? (?:by|from|da)\b"
    r"|@generated\b|<auto-?generated|^\W*autogenerat(?:ed|o)\b|\bauto-?generated file\b|third[- ]party (?:component|library|code)|\bvendored\b|\bamalgamation\b|\bbundled copy\b"
)
BY_HAND = re.compile(r"(?i)\bby hand\b|\ba mano\b")
#: Whether a text may hold an announcement, for drawing the sample.
MAY_SAY = r"(?i)generat|third.party|vendored|amalgamation|bundled copy"
TELLING_PATH = re.compile(r"(?i)(?:^|/)(?:vendor|third_party|3rdparty|deps|external|node_modules|contrib)/\w+/|(?:^|/)dist/|\.min\.\w+$|_pb\.\w+$|_autogen\.\w+$|\.gen\.\w+$")


def parts(text: str) -> tuple[str, str]:
    """Code without full-line comments, and the comment lines."""
    notes = [m for m in COMMENT.finditer(text)]
    if not notes:
        return text, ""
    code, at = [], 0
    for m in notes:
        code.append(text[at : m.start()])
        at = m.end()
    code.append(text[at:])
    return "".join(code), "\n".join(m[1] for m in notes)


_DIGIT = np.zeros(0x10001, bool)
_DIGIT[48:58] = True


def _grams(texts: list[str], order: int, shape: bool, salt: int) -> np.ndarray:
    """Presence of every hashed n-gram: one row per text."""
    seen = np.zeros((len(texts), 1 << BITS), bool)
    b = Block(texts)
    n = len(b.cp)
    if n < order:
        return seen
    sign = np.where(_DIGIT[np.minimum(b.cp, 0x10000)], 48, b.cp)
    if shape:
        kind = b.kind
        sign = np.where(kind == 6, 65, np.where(kind == 4, 97, sign))
    sign = sign.astype(np.uint32)
    h = np.full(n - order + 1, salt * 2246822519 & 0xFFFFFFFF, np.uint32)
    for i in range(order):
        h = (h ^ sign[i : n - order + 1 + i]) * np.uint32(16777619)
        h ^= h >> np.uint32(15)
    h *= np.uint32(2654435761)
    at = np.arange(n - order + 1)
    row = np.repeat(np.arange(len(texts)), np.diff(b.start))[: n - order + 1]
    inside = at + order <= b.start[row + 1]
    seen[row[inside], (h[inside] >> np.uint32(32 - BITS)).astype(np.int64)] = True
    return seen


def _hash(token: str) -> int:
    h = 2166136261
    for c in token.encode():
        h = ((h ^ c) * 16777619) & 0xFFFFFFFF
    return (h * 2654435761 & 0xFFFFFFFF) >> (32 - BITS)


def path_tokens(path: str | None) -> list[str]:
    """Components of a path, the pieces of its file name and its ending."""
    if not path:
        return ["none"]
    *folders, name = path.lower().split("/")
    stem, *ends = name.split(".")
    return [f"d:{f}" for f in folders] + [f"p:{a}/{b}" for a, b in zip(folders, folders[1:])] + [f"s:{x}" for x in re.split(r"[_\W]", stem)] + [f"e:{x}" for x in ends] + [f"t:{stem.rsplit('_', 1)[-1]}", f"n:{len(ends)}"]


def name_tokens(code: str, frequent: set[str]) -> list[str]:
    """The leading part of function names of three parts or more; a part that few files share may be a library's prefix."""
    lead = Counter()
    total = 0
    for m in FUNCTION.finditer(code):
        pieces = PART.findall(m[1] or m[2])
        if len(pieces) >= 3:
            lead[pieces[0].lower()] += 1
            total += 1
    out = [f"l:{w}" for w in lead]
    rare = sum(n for w, n in lead.items() if w not in frequent)
    if rare:
        out += ["rare", f"rare:{min(rare, 4)}"] + ["mostly rare"] * (2 * rare > total)
    return out


def leading_parts(code: str) -> set[str]:
    return {p[0].lower() for m in FUNCTION.finditer(code) if len(p := PART.findall(m[1] or m[2])) >= 2}


def features(texts: list[str | None], paths: list[str | None], frequent: set[str]) -> list[np.ndarray]:
    """Sorted feature numbers of every file's body and path in one space of SPACES * 2**BITS; comment lines are masked."""
    code = ["\n".join(x for x in parts(t or "")[0].split("\n") if x and not x.isspace()) for t in texts]
    dense = np.concatenate([_grams(code, 5, False, 1), _grams(code, 6, True, 2)], 1)
    row, column = np.nonzero(dense)
    first = np.searchsorted(row, np.arange(len(texts) + 1))
    out = []
    for i, (path, c) in enumerate(zip(paths, code)):
        extra = [(PATH << BITS) + _hash(x) for x in path_tokens(path)] + [(NAME << BITS) + _hash(x) for x in name_tokens(c, frequent)]
        out.append(np.concatenate([column[first[i] : first[i + 1]], np.unique(np.array(extra, np.int64))]))
    return out


def comment_lines(text: str | None) -> list[str]:
    """Distinct comment lines of a file, figures as zeros, without the comment's end."""
    return sorted({x for n in parts(text or "")[1].split("\n") if (x := re.sub(r"\d", "0", re.sub(r"\*+/\s*$", "", n)).strip())})


def line_features(lines: list[str]) -> list[np.ndarray]:
    """Sorted numbers of the n-grams of every line."""
    b = Block([f"\n{x}\n" for x in lines])
    n = len(b.cp) - 4
    if n < 1:
        return [np.zeros(0, np.int64) for _ in lines]
    h = np.zeros(n, np.uint32)
    for i in range(5):
        h = (h ^ b.cp[i : n + i]) * np.uint32(16777619)
        h ^= h >> np.uint32(15)
    h *= np.uint32(2654435761)
    row = np.repeat(np.arange(len(lines)), np.diff(b.start))[:n]
    inside = np.arange(n) + 5 <= b.start[row + 1]
    pair = np.unique((row[inside] << BITS) + (h[inside] >> np.uint32(32 - BITS)).astype(np.int64))
    return np.split(pair & ((1 << BITS) - 1), np.searchsorted(pair >> BITS, np.arange(1, len(lines))))


def _values(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Each space counts as one unit vector, weighted by rarity."""
    v = idf[x]
    space = x >> BITS
    norm = np.sqrt(np.bincount(space, v * v, minlength=SPACES))
    norm[norm == 0] = 1
    return v / norm[space]


def form(text: str) -> str:
    """What the form of a file tells: minified, data, made by a tool, or nothing."""
    code, _ = parts(text)
    lines = [x for x in code.split("\n") if x.strip()]
    solid = sum(map(len, lines)) or 1
    if max(map(len, lines), default=0) > 400 and code.count(" ") < 0.18 * solid:
        return "minified"
    if sum(c.isdigit() for c in code) > 0.3 * solid or re.search(r"[A-Za-z0-9+/]{56,}={0,2}[\"']?\s*[\"'\n+]", code) and len(re.findall(r"[A-Za-z0-9+/]{40,}", code)) >= 3:
        return "data"
    shapes = Counter(re.sub(r"[A-Za-z_]\w*", "a", re.sub(r"\d+", "0", x.strip())) for x in lines if len(x.strip()) > 3).most_common(2)
    told = sum(len(x.strip()) > 3 for x in lines)
    if told >= 14 and (shapes[0][1] >= 0.6 * told or sum(n for _, n in shapes) >= 0.75 * told):
        return "tool"
    return ""


def announces(line: str) -> bool:
    """Whether a comment line is a common announcement; one that adds that the file is kept by hand is none."""
    return bool(MARKER.search(line)) and not BY_HAND.search(line)


def _svm(x: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, weight: np.ndarray, size: int, epochs: int = 12, c: float = 2e-5) -> tuple[np.ndarray, float]:
    """Averaged stochastic subgradients of the weighted hinge loss."""
    rng = np.random.default_rng(7)
    w, total, bias, bias_total, steps = np.zeros(size), np.zeros(size), 0.0, 0.0, 0
    scale = 1.0
    for epoch in range(epochs):
        rate = 0.5 / (1 + epoch)
        for i in rng.permutation(len(x)):
            scale *= 1 - rate * c
            f, v = x[i], values[i]
            if y[i] * (scale * (w[f] @ v) + bias) < 1:
                w[f] += rate * weight[i] * y[i] / scale * v
                bias += 0.1 * rate * weight[i] * y[i]
        if epoch >= epochs // 2:
            total += w * scale
            bias_total += bias
            steps += 1
    return total / steps, bias_total / steps


def _idf(x: list[np.ndarray], size: int) -> np.ndarray:
    return np.log((1 + len(x)) / (1 + np.bincount(np.concatenate(x), minlength=size))) + 0.1


def _unit(f: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = idf[f]
    return v / (np.sqrt(v @ v) or 1.0)


def _best_threshold(score: np.ndarray, truth: np.ndarray) -> float:
    """Threshold of the best F1, of several the one nearest to the margin's middle; 0 without both kinds."""
    if not truth.any() or truth.all():
        return 0.0
    order = np.unique(score)
    cuts = np.concatenate([[0.0], (order[1:] + order[:-1]) / 2])
    above = score[None, :] > cuts[:, None]
    f1 = 2 * (above & truth).sum(1) / (above.sum(1) + truth.sum())
    top = cuts[f1 >= f1.max() - 1e-9]
    return float(top[np.abs(top).argmin()])


def _fit_body(rows: list[tuple], told: np.ndarray, says: np.ndarray, held: np.ndarray) -> dict:
    """The body view. Files that only announce themselves are neither kind here: their bodies are like any other."""
    size = SPACES << BITS
    # a part that begins names in many files is a verb; libraries' prefixes stay in few
    seen = Counter(w for (t, _, _), a in zip(rows, told | says) if not a for w in leading_parts(parts(t)[0]))
    frequent = {w for w, n in seen.items() if n >= max(3, 0.004 * (~(told | says)).sum())}
    x: list[np.ndarray] = []
    for i in range(0, len(rows), 50):
        x += features([r[0] for r in rows[i : i + 50]], [r[1] for r in rows[i : i + 50]], frequent)
    idf = _idf(x, size)
    values = [_values(f, idf) for f in x]
    learn, y = np.flatnonzero(~held & (told | ~says)), np.where(told, 1, -1)
    score = np.zeros(len(x))
    for _ in range(2):  # files that nothing tells may still be copies: those the first fit is sure of change sides
        share = (y[learn] > 0).mean()
        weight = np.where(y[learn] > 0, 0.5 / max(share, 1e-3), 0.5 / max(1 - share, 1e-3))
        w, bias = _svm([x[i] for i in learn], [values[i] for i in learn], y[learn], weight, size)
        score = np.array([w[f] @ v for f, v in zip(x, values)]) + bias
        y = np.where((y < 0) & ~says & (score > 0.5), 1, y)
    valid = held & (told | ~says)
    threshold = _best_threshold(score[valid], y[valid] > 0)
    found, truth = score > threshold, y > 0
    report = {
        "files": int(valid.sum()),
        "precision": float((found & truth & valid).sum() / max((found & valid).sum(), 1)),
        "recall": float((found & truth & valid).sum() / max((truth & valid).sum(), 1)),
        "recall_where_only_comments_tell": float((found & says & ~told).sum() / max((says & ~told).sum(), 1)),
    }
    return {"weight": w.astype(np.float32), "idf": idf.astype(np.float32), "bias": float(bias), "threshold": threshold, "frequent": frequent, "validation": report}


def _fit_lines(bags: list[list[str]], by_path: np.ndarray, told: np.ndarray, held: np.ndarray) -> dict:
    """The comment view over distinct lines. ``by_path``: the path tells; ``told``: path or form tell."""
    size = 1 << BITS
    names = sorted({x for b in bags for x in b})
    none = {"line_weight": np.zeros(size, np.float32), "line_idf": np.zeros(size, np.float32), "line_bias": -1.0, "line_validation": {}}
    if not names:
        return none
    number = {x: i for i, x in enumerate(names)}
    inside = [np.array([number[x] for x in b], np.int64) for b in bags]
    x = [f for i in range(0, len(names), 500) for f in line_features(names[i : i + 500])]
    marked = np.array([announces(n) for n in names])
    open_ = [i for i, b in enumerate(inside) if len(b) and not held[i] and not told[i] and not marked[b].any()]
    files = np.bincount(np.concatenate([inside[i] for i in open_]), minlength=len(names)) if open_ else np.zeros(len(names), int)
    unlabelled = np.flatnonzero(files > 0)
    learned = np.unique(np.concatenate([inside[i] for i in range(len(bags)) if not held[i]] or [np.zeros(0, np.int64)]))
    sure = np.intersect1d(np.flatnonzero(marked), learned)
    evident = [inside[i] for i in np.flatnonzero(by_path & ~held) if len(inside[i])]
    if not len(unlabelled) or not len(sure) and not evident:
        return none
    idf = _idf(x, size)
    values = [_unit(f, idf) for f in x]
    # of a file whose path tells, the line with most n-grams that no other file has, unless others have the line itself
    known = np.bincount(np.concatenate([x[i] for i in unlabelled]), minlength=size) > 0
    score = np.array([1 - known[f].mean() if len(f) else 0.0 for f in x])
    chosen = [b[score[b].argmax()] for b in evident]
    positive = np.union1d(sure, [i for i in chosen if not files[i]]).astype(np.int64)
    for _ in range(3):
        if not len(positive):
            return none
        negative = np.setdiff1d(unlabelled, positive)
        use = np.concatenate([positive, negative])
        y = np.concatenate([np.ones(len(positive)), -np.ones(len(negative))])
        weight = np.concatenate([np.full(len(positive), float(LABELLED_WEIGHT)), np.minimum(files[negative], LABELLED_WEIGHT)]) * 2 / (1 + LABELLED_WEIGHT)
        w, bias = _svm([x[i] for i in use], [values[i] for i in use], y, weight, size)
        score = np.array([w[f] @ v for f, v in zip(x, values)]) + bias
        chosen = [b[score[b].argmax()] for b in evident]
        positive = np.unique(np.concatenate([sure, [i for i in chosen if score[i] > 0], unlabelled[score[unlabelled] > 0.5]])).astype(np.int64)
    best = np.array([score[b].max() if len(b) else -1.0 for b in inside])
    says = np.array([marked[b].any() for b in inside])
    report = {"files": int(held.sum()), "recall_of_announcements": float((says & held & (best > 0)).sum() / max((says & held).sum(), 1)), "found_without": int((~says & held & (best > 0)).sum())}
    return {"line_weight": w.astype(np.float32), "line_idf": idf.astype(np.float32), "line_bias": float(bias), "line_validation": report}


def fit_rows(rows: list[tuple[str, str | None, str]]) -> dict:
    """Both views from rows of text, path and repository."""
    size = SPACES << BITS
    empty = {"weight": np.zeros(size, np.float32), "idf": np.zeros(size, np.float32), "bias": -1.0, "threshold": 0.0, "frequent": set(), "validation": {}} | _fit_lines([], *[np.zeros(0, bool)] * 3)
    if len(rows) < 20:
        return empty
    bags = [comment_lines(t) for t, _, _ in rows]
    by_path = np.array([bool(p and TELLING_PATH.search(p)) for _, p, _ in rows])
    told = by_path | np.array([bool(form(t)) for t, _, _ in rows])
    says = np.array([any(map(announces, b)) for b in bags])
    # whole repositories are held out
    held = np.array([_hash(d) % 5 == 0 for _, _, d in rows])
    kinds = told[~held & (told | ~says)]
    body = _fit_body(rows, told, says, held) if kinds.any() and not kinds.all() else {k: v for k, v in empty.items() if not k.startswith("line")}
    return body | _fit_lines(bags, by_path, told, held)


def fit(files: DataFrame, per_stratum: int = SAMPLE_PER_STRATUM) -> dict:
    """Classifiers from at most about ``per_stratum`` files that path or words may tell and as many others.

    Files over SAMPLE_CHARS stay out of the sample; all files are classified.
    """
    may = F.coalesce(F.col("file_path").rlike(TELLING_PATH.pattern), F.lit(False)) | F.col("text").rlike(MAY_SAY)
    pool = files.where(F.length("text").between(20, SAMPLE_CHARS)).select("text", "file_path", "domain", may.alias("may"))
    sizes = {r.may: r["count"] for r in pool.groupBy("may").count().collect()}
    draw = F.pmod(F.xxhash64("text", "file_path"), F.lit(1_000_000)) / 1_000_000
    rate = F.when(F.col("may"), min(1.0, per_stratum / max(sizes.get(True, 0), 1))).otherwise(min(1.0, per_stratum / max(sizes.get(False, 0), 1)))
    drawn = pool.where(draw < rate).select("text", "file_path", "domain").collect()
    return fit_rows(sorted({(r.text, r.file_path, r.domain or "") for r in drawn}, key=lambda r: (r[0], r[1] or "", r[2])))


def scores(texts: list[str | None], paths: list[str | None], model: dict) -> np.ndarray:
    """Body score less its threshold, comments masked."""
    w, idf = model["weight"], model["idf"]
    return np.array([float(w[f] @ _values(f, idf)) + model["bias"] - model["threshold"] for f in features(texts, paths, model["frequent"])])


class LineScores(dict):
    """Scores of comment lines; a bounded number of them is remembered."""

    def __init__(self, model: dict):
        super().__init__()
        self.model = model

    def of(self, texts: list[str | None]) -> np.ndarray:
        """Highest line of every file, -1 where it has none."""
        bags = [comment_lines(t) for t in texts]
        new = sorted({x for b in bags for x in b if x not in self})
        if new:
            w, idf = self.model["line_weight"], self.model["line_idf"]
            fresh = dict(zip(new, (float(w[f] @ _unit(f, idf)) + self.model["line_bias"] for f in line_features(new))))
            out = [max((fresh[x] if x in fresh else self[x] for x in b), default=-1.0) for b in bags]
            if len(self) < REMEMBERED_LINES:
                self.update(fresh)
            return np.array(out)
        return np.array([max((self[x] for x in b), default=-1.0) for b in bags])


def score(files: DataFrame, model: dict, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default ``doc_id``), ``body_score``, ``comment_score`` and ``by_hand`` of every file with text.

    A file is not by hand if either score is positive.
    """
    keep = keep or ["doc_id"]
    kept = files.where(F.col("text").isNotNull()).select(*keep, F.col("text").alias("__text"), F.col("file_path").alias("__path"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-2]) + ", body_score double, comment_score double, by_hand boolean"
    shared = files.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        lines = LineScores(model)
        for batch in cut(batches, "__text", 1 << 16):
            n = batch.num_columns
            texts = batch.column(n - 2).to_pylist()
            body, said = scores(texts, batch.column(n - 1).to_pylist(), model), lines.of(texts)
            hand = (np.maximum(body, said) <= 0) | np.array([not t.strip() for t in texts])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(body), pa.array(said), pa.array(hand)], names=[*keep, "body_score", "comment_score", "by_hand"])

    return kept.mapInArrow(run, schema)
