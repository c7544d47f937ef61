"""Problem 8: sentence ends in many languages and scripts.

A pushdown automaton runs over the signs of a paragraph that can matter: terminators, quotes, brackets and, in Thai,
spaces. Its stack holds the open quotes and brackets; a terminator inside them ends nothing, so a quotation stays with
the words around it. A second stack holds the open list levels: a marker (figure, single letter or roman numeral) that
begins a line's sentence opens a level, the next in order continues it, also within the line, and the stop of a marker is
part of its item. Whether a full stop ends a sentence is decided by tries of abbreviations, read backwards from the
stop, by initials, numbers and ordinals, and by what follows.

Defined results: null and blank texts give no row; a blank line always ends a unit; trailing white space belongs to no
sentence; repeated rows give repeated results; an empty table gives an empty table.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import lexicon
from corpusmill.llm.blocks import cut

#: Abbreviations after which no sentence ends: titles, references, units before figures.
NEVER = """sig sigg sig.ra sig.na dott dott.ssa dr dra prof prof.ssa ing arch avv geom rag cav mons comm col gen capt sgt lt magg cfr cf vgl v ej es ed edd mr mrs ms messrs st ste rev hon fr
hr bldg rm apt ave dept i.e e.g viz vs approx ca c.a circa env bd av al m mm mme mlle mgr pr abbé sr sra srta d dña da dn ud uds sres avda av.da c.so v.le p.za p.zza l.go s.a.r.l
ee bzw z z.b d.h u.a u.s.w.x evtl ggf med jur rer phil nat abs ziff kap mio mrd co dl dna dlui проф г-н г-жа см стр рис табл им ул акад доц гл т д.р σελ βλ κ κκ κα δρ αρ ص د أ م डॉ
सं श्री पृ प्रो सेंट e t.d ss s.s ph gr ibid""".split()
#: Abbreviations of references: a figure or a small letter goes on, a capital that is no numeral begins a sentence.
NUMBER = """no nn n nr núm num art artt par ex ext int fig figg tab tabb vol voll eq eqs sec cap p pp pag pagg pág págs sez tel str""".split()
#: Abbreviations that may end a sentence: one ends if a capital, a figure or a quotation follows.
MAYBE = """ecc etc usw s.p.a s.r.l s.n.c inc ltd corp bros jr sr.x a.c d.c p.m a.m a.d b.c u.n u.s u.s.a u.k p.v c.m u.s gg lb oz kg km cm h min sq rd ltda s.a uu gmbh ag kg st.x s jh jhd ff f uhr izq dcha г гг в вв д др руб тыс млн π.χ μ.χ κ.λπ κ.ά p.s n.b ș.a.m.d lei r.l dic sept lun mar mer gio ven sab dom mon tue wed thu fri sat sun jan feb apr jun jul aug oct nov dec gen giu lug ago set ott""".split()
#: Words before a capital letter that make the letter a name of a part, not an initial.
PART = frozenset("scala scale interno int blocco block lotto classe class tipo type serie vitamina vitamin appendice appendix section sezione gruppo group level livello reparto padiglione binario gate hall wing aula sala corte".split())
#: German: words that can stand before an ordinal, and months, which can follow one. A capitalised function word behind
#: the figure opens a sentence.
BEFORE_ORDINAL = frozenset("am der den dem des die das vom zum zur im in ins beim ab bis seit und oder dieser diesem diesen dieses jeder jedem jeden jedes mein meinem meinen sein seinem seinen seiner ihr ihrem ihren ihrer unser unserem unseren".split())
GERMAN_MONTHS = frozenset("Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember".split())
GERMAN_FUNCTION_WORDS = frozenset(lexicon.FUNCTION_WORDS["de"].split())
ROMAN = re.compile(r"[IVXLC]+\b")
GERMAN = re.compile(r"(?i)\b(?:der|die|und|nicht|wurde|wird|eine?[rnms]?|mit|für|auf|von|am|im|ist)\b")
OPEN = {"(": ")", "[": "]", "{": "}", "«": "»", "“": "”", "„": "“”", "‹": "›", "「": "」", "『": "』", "（": "）", "【": "】", "《": "》", "‚": "‘’"}
CLOSERS = frozenset("\"')]}»”“’›」』）】》")
EVENTS = re.compile(r"[.!?…。！？।؟；;]+(?:\s?[.!?…]+)*|[\"'‘’()\[\]{}«»“”„‹›「」『』（）【】《》‚]|(?<=[ก-๛])[  \n\r]+(?=[ก-๛A-ZÀ-Þ\"“«])")
#: What stands between the start of a sentence and the stop of a list marker: bullet and figure, letter or numeral.
MARKER = re.compile(r"\s*(?:[-–—*•·▪‣◦]\s+)?((?:\d{1,3}\.)*\d{1,3}|[^\W\d_]|[ivxlc]{2,7}|[IVXLC]{2,7})")
NEXT_MARKER = re.compile(r"(?=\s)" + MARKER.pattern + r"\.\s")
ROMAN_NUMBER = re.compile(r"(?:XC|XL|L?X{0,3})(?:IX|IV|V?I{0,3})|C")
DEEPEST, REACH = 64, 120
BLANK_LINE = re.compile(r"(?:\r\n?|\n|\u2028)[^\S\n\r\u2028\u2029]*(?:\r\n?|\n|\u2028)\s*|\u2029\s*")
INVISIBLE = "\ufeff\u200b\u200c\u200d\u2060\u00ad"


def _trie(kinds: dict[str, list[str]]) -> dict:
    root: dict = {}
    for kind, words in kinds.items():
        for word in words:
            node = root
            for c in reversed(word):
                node = node.setdefault(c, {})
            node[""] = kind
    return root


ABBREVIATIONS = _trie({"maybe": MAYBE, "number": NUMBER, "never": NEVER})


def abbreviation(text: str, stop: int, start: int = 0) -> str:
    """``never``, ``maybe`` or an empty string for the longest abbreviation that ends before the stop."""
    node, i, kind = ABBREVIATIONS, stop - 1, ""
    while i >= start:
        node = node.get(text[i].lower())
        if node is None:
            break
        if "" in node and (i == start or not (text[i - 1].isalnum() and text[i - 1] < "\u2e80" or text[i - 1] in ".-" or unicodedata.category(text[i - 1])[0] == "M")):
            kind = node[""]
        i -= 1
    return kind


def _pairs(text: str, events: list[tuple[int, int]]) -> dict[int, int]:
    """Matched opening and closing signs, by event: the stack pass. What stays open or never opened counts as a plain sign."""
    stack: list[tuple[str, int]] = []
    match: dict[int, int] = {}
    for k, (lo, hi) in enumerate(events):
        c = text[lo]
        if len(stack) > DEEPEST:  # the outermost of so many is a sign left open
            del stack[0]
        if hi - lo != 1:
            continue
        before, after = text[lo - 1] if lo else " ", text[hi] if hi < len(text) else " "
        for depth in range(len(stack) - 1, -1, -1):
            if c in stack[depth][0] and not (c == "'" and after.isalpha()) and not (c in "'’" and before.isalpha() and stack[depth][0] in ("'", "’")):
                match[stack[depth][1]] = k
                match[k] = stack[depth][1]
                del stack[depth:]
                break
        else:
            if c in OPEN:
                stack.append((OPEN[c], k))
            elif c == '"' and not (before.isdigit() and not after.isalnum()):
                stack.append(('"', k))
            elif c in "'‘" and not before.isalnum() and (after.isupper() or after in "¿¡"):
                stack.append(("'" if c == "'" else "’", k))
    return match


def _opens(text: str, i: int) -> bool:
    """Whether what stands at i can open a sentence: no lower-case letter, but a brand such as eName can."""
    c = text[i]
    if c.islower():
        return i + 1 < len(text) and text[i + 1].isupper()
    return True


def _skip(text: str, i: int) -> int:
    while i < len(text) and (text[i].isspace() or text[i] in INVISIBLE):
        i += 1
    return i


def _stop_ends(text: str, start: int, lo: int, hi: int, german: bool) -> bool:
    """Whether the single full stop at lo ends the sentence that began at start; hi is behind closing signs."""
    nxt = _skip(text, hi)
    if nxt >= len(text):
        return True
    c = text[nxt]
    i = lo
    while i > max(start, lo - REACH) and not text[i - 1].isspace() and text[i - 1] not in "(«“\"„'’[":
        i -= 1
    word = text[i:lo]
    if nxt == hi:  # nothing between: inside a number, name or address, or a forgotten space
        if c.isdigit() or not (c.isupper() or c in OPEN or c in "¿¡\"") or "/" in word or "@" in word or word.startswith("www"):
            return False
        follows = text[nxt + 1] if nxt + 1 < len(text) else ""
        tail = re.search(r"[^\W\d_]*$", word)[0]
        long_word = len(tail) >= 2 and tail[-1].islower() and "." not in word
        return (long_word or text[lo - 1 : lo] in CLOSERS) and (not c.isupper() or follows.islower() or follows in " '’") and abbreviation(text, lo, start) == ""
    if not _opens(text, nxt) and not (c in CLOSERS):
        return False
    if c in ",;:)]":
        return False
    bare = c in OPEN or c in "\"'"
    if len(word) == 1 and word.isupper():
        before = re.search(r"(\w+)[^\w]*$", text[max(start, i - REACH) : i])
        before = before[1].lower() if before else ""
        return before in PART or word == "C" and text[max(i - 3, 0) : i].strip() in ("a.", "d.")
    if re.fullmatch(r"(?:\w\.-?)+\w", word) and word.isupper() and "-" in word:
        return False
    kind = abbreviation(text, lo, start)
    if kind == "never" or german and len(word) > 3 and word.endswith("str"):  # a street's name
        return False
    if kind == "number":
        return (c.isupper() or bare or c in "¿¡") and not ROMAN.match(text, nxt)
    if word in ("l'on", "L'on") or word == "on" and text[i - 1 : i] in ("'", "’"):
        return False
    if kind == "maybe":
        return c.isupper() or bare or c in "¿¡" or not c.isalnum() and not c.isspace() or not word.lower().isalpha() and c.isdigit() or c.islower()
    if word.isdigit():
        if c.isdigit():
            return False
        if german and c.isupper():
            following = re.match(r"\w+", text[nxt : nxt + REACH])[0]
            before = re.search(r"(\w+)\W*$", text[max(start, i - REACH) : i])
            return following not in GERMAN_MONTHS and (following.lower() in GERMAN_FUNCTION_WORDS or not before or before[1].lower() not in BEFORE_ORDINAL and not before[1].isdigit())
    return True


def _roman(word: str) -> int:
    """Value of a roman numeral up to 100, or 0."""
    if not word or not ROMAN_NUMBER.fullmatch(word.upper()):
        return 0
    values = [{"I": 1, "V": 5, "X": 10, "L": 50, "C": 100}[c] for c in word.upper()]
    return sum(-v if v < max(values[i:]) else v for i, v in enumerate(values))


def _counts(word: str) -> list[tuple[str, int]]:
    """The orders a marker can stand in, each with its place: a single letter may be a numeral, too."""
    head, _, last = word.rpartition(".")
    if last.isdigit():
        return [(f"{head}.1", int(last))]
    case = "A" if word[0].isupper() else "a"
    out = [(f"{case} letter", ord(word))] if len(word) == 1 else []
    return out + ([(f"{case} roman", n)] if (n := _roman(word)) else [])


def _marks(text: str, start: int, lo: int, levels: list[list[tuple[str, int]]]) -> bool:
    """Whether the stop at lo belongs to a list marker at the sentence's start; keeps the stack of list levels.

    At a line's start any marker opens an item; within a line only the next in the order of an open level does.
    """
    m = MARKER.fullmatch(text, start, lo)
    if m is None or lo + 1 >= len(text) or not text[lo + 1].isspace() or not (counts := _counts(m[1])):
        return False
    for depth in range(len(levels) - 1, -1, -1):
        if following := [(k, n) for k, n in counts if (k, n - 1) in levels[depth]]:
            levels[depth:] = [following]
            return True
    if text[:start].strip() and not re.search(r"[\n\r\u2028]", text[start : m.start(1)]):
        return False
    if len(levels) == DEEPEST:
        del levels[0]
    levels.append(counts)
    return True


def _item_follows(text: str, hi: int, levels: list[list[tuple[str, int]]]) -> bool:
    """Whether an item's marker stands behind hi: the next of an open level, or on a new line the first of one."""
    m = NEXT_MARKER.match(text, hi)
    if m is None:
        return False
    counts, new_line = _counts(m[1]), re.search(r"[\n\r\u2028]", text[hi : m.start(1)])
    return any((k, n - 1) in level for level in levels for k, n in counts) or bool(new_line) and any(n == 1 or n == ord("a") for _, n in counts)


def boundaries(text: str, base: int = 0) -> list[int]:
    """End offsets of the sentences of one paragraph."""
    events = [m.span() for m in EVENTS.finditer(text)]
    out: list[int] = []
    if events:
        match = _pairs(text, events)
        german = bool(len(GERMAN.findall(text)) * 12 > text.count(" "))
        start, depth, opened, k = 0, 0, 0, 0
        levels: list[list[tuple[str, int]]] = []
        while k < len(events):
            lo, hi = events[k]
            c = text[lo]
            k += 1
            end = -1
            if k - 1 in match:
                other = match[k - 1]
                if other > k - 1:
                    if depth == 0:
                        opened = lo
                    depth += 1
                    continue
                depth = max(0, depth - 1)
                if depth:
                    continue
                inner = lo
                while inner > opened and text[inner - 1].isspace():
                    inner -= 1
                if inner and text[inner - 1] in ".!?…。！？।؟" and not (text[inner - 1] == "." and text[inner - 2 : inner - 1] != "." and abbreviation(text, inner - 1) and text[opened] in "(["):
                    nxt = _skip(text, hi)
                    introduced = bool(text[max(start, opened - REACH) : opened].strip(" \t\n\r -–—*•"))
                    if nxt >= len(text):
                        end = hi
                    else:
                        n = text[nxt]
                        if n.islower() and _opens(text, nxt):
                            end = hi
                        elif n.islower() or n in ".,;:!?。，；：！？、—–-)]»”" or (n in "\"'" and nxt == hi):
                            pass
                        elif n.isupper() or n.isdigit() or n in OPEN or n in "¿¡\"'‘":
                            end = hi if text[opened] not in "([（【" or not introduced or n.isupper() else -1
                            if n in "「“" and not introduced:
                                end = hi
                        elif unicodedata.category(n) == "Lo":
                            end = hi if introduced and not ("ぁ" <= n <= "ゟ") else -1
                        else:
                            end = hi
            elif depth:
                continue
            elif c.isspace():
                end = lo
            elif c == "." and hi - lo == 1 and lo - start < REACH and _marks(text, start, lo, levels):
                continue
            elif c in ".!?…。！？।؟；;":
                run = text[lo:hi]
                while hi < len(text) and text[hi] in CLOSERS and not (k < len(events) and events[k][0] == hi and match.get(k, -1) > k):
                    hi += 1
                    if k < len(events) and events[k][0] < hi:
                        k += 1
                nxt = _skip(text, hi)
                gap = nxt > hi or nxt >= len(text)
                n = text[nxt] if nxt < len(text) else ""
                if set(run) <= set(";；"):
                    if lo and ("Ͱ" <= text[lo - 1] <= "Ͽ" or "ἀ" <= text[lo - 1] <= "῿") and gap and (not n or not n.islower()):
                        end = hi
                elif not n:
                    end = hi
                elif set(run) & set("。！？।"):
                    end = -1 if n in "，、,;：:" else hi
                elif run == ".":
                    end = hi if _stop_ends(text, start, lo, hi, german) else -1
                elif "!" in run or "?" in run or "؟" in run:
                    if n in "—–-" and gap:
                        after = _skip(text, nxt + 1)
                        end = hi if after < len(text) and _opens(text, after) and not text[after].islower() else -1
                    elif n in ",;:)]" or (n.islower() and not _opens(text, nxt)):
                        end = -1
                    elif gap or n.isupper() or n in OPEN or n in "¿¡\"":
                        end = hi
                elif gap and _opens(text, nxt) and n not in ",;:" and unicodedata.category(n) != "Lo":
                    end = hi
                elif not gap and n.isupper() and nxt + 1 < len(text) and text[nxt + 1].islower():
                    end = hi
                if end < 0 and run[-1] in ".!?" and not (run == "." and abbreviation(text, lo, start)) and _item_follows(text, hi, levels):
                    end = hi
            if end >= 0 and text[start:end].strip().strip(INVISIBLE):
                out.append(end)
                start = end
                opened = end
    if not out or text[out[-1] :].strip().strip(INVISIBLE):
        end = len(text)
        while end and (text[end - 1].isspace() or text[end - 1] in INVISIBLE):
            end -= 1
        if end and (not out or end > out[-1]):
            out.append(end)
    return [base + x for x in out]


def sentence_ends(text: str | None) -> list[int]:
    """End offsets, in code points, of all sentences of a text."""
    if not text or text.isspace():
        return []
    out: list[int] = []
    at = 0
    for m in BLANK_LINE.finditer(text):
        out += boundaries(text[at : m.start()], at) if m.start() > at else []
        at = m.end()
    return out + (boundaries(text[at:], at) if at < len(text) else [])


def sentences(documents: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per sentence: columns ``keep``, ``sentence`` (from 0) and ``end_pos``."""
    keep = keep or ["doc_id"]
    kept = documents.where(F.col(text).isNotNull()).select(*keep, F.col(text).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]) + ", sentence int, end_pos bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches, "__text"):
            ends = [sentence_ends(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            index = pa.array([i for i, e in enumerate(ends) for _ in e], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(c.take(index) for c in batch.columns[:-1]), pa.array([k for e in ends for k in range(len(e))], pa.int32()), pa.array([x for e in ends for x in e], pa.int64())],
                names=[*keep, "sentence", "end_pos"],
            )

    return kept.mapInArrow(run, schema)
