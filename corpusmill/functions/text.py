"""Column expressions on text: Unicode white space, words, cleaning, normal form, n-grams, keyed hashes.

All of them stay inside the JVM but for the normal form of the few texts that can change under it. A null text gives a
null result unless a function says otherwise.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.ml.feature import NGram
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed value: what Python's str.isspace() accepts, as a character class body for Java and RE2.
SPACE_BODY = r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
W = f"[{SPACE_BODY}]"
NOT_W = f"[^{SPACE_BODY}]"

#: What makes a text count as code.
C_KEYWORDS = [
    "#include", "#define", "#ifdef", "#ifndef", "#endif", "#pragma", "int main", "void ", "printf", "scanf", "malloc", "free", "sizeof", "struct ", "typedef", "enum ", "union ", "FILE *",
    "fopen", "fclose", "fprintf", "return 0;", "->", "calloc", "realloc", "extern ", "static ", "const ", "volatile ",
]
GENERAL_KEYWORDS = ["def ", "class ", "function ", "import ", "from ", "package ", "module ", "fn ", "pub fn", "let mut", "async ", "await ", "=>", "func ", "void "]
CODE_SIGNS = r"{}();=<>\[\]+\-*/&|!#"
CODE_PATH_MARKERS = ["c_code", "cpp_code", "other_code", "multi_code", "/code/", "github-code", "the-stack", "vault", "starcoderdata", "stack-dedup"]


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A{W}+|{W}+\z", "")


def words(c: Column) -> Column:
    """Words between Unicode white space; an empty array for a text without any."""
    return F.filter(F.split(c, f"{W}+"), lambda x: x != "")


def without_urls(c: Column) -> Column:
    return F.regexp_replace(c, f"https?://{NOT_W}+", "")


def clean(c: Column) -> Column:
    """Prose: no addresses, at most one blank line, single spaces, no white space at the ends."""
    return strip(F.regexp_replace(F.regexp_replace(without_urls(c), "\n{3,}", "\n\n"), "[ \t]+", " "))


def clean_code(c: Column) -> Column:
    """Code: no addresses, at most two blank lines, indentation kept."""
    return strip(F.regexp_replace(without_urls(c), "\n{4,}", "\n\n\n"))


def contains_any(c: Column, needles: list[str]) -> Column:
    """Whether any of the strings occurs literally: one pattern, so the plan stays small."""
    return c.rlike("|".join(rf"\Q{n}\E" for n in needles))


def is_code(c: Column) -> Column:
    """Sign share over 15 %, or a keyword among the first 500 characters; never for texts under 20 characters."""
    total = F.length(F.translate(c, " \n", ""))
    signs = F.length(F.regexp_replace(c, f"[^{CODE_SIGNS}]", ""))
    return F.coalesce((F.length(c) >= 20) & (total > 0) & ((signs / F.greatest(total, F.lit(1)) > 0.15) | contains_any(F.substring(c, 1, 500), C_KEYWORDS + GENERAL_KEYWORDS)), F.lit(False))


def is_code_path(c: Column) -> Column:
    return F.coalesce(contains_any(F.lower(c), CODE_PATH_MARKERS), F.lit(False))


@F.pandas_udf(StringType())
def _nfc(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield s.map(lambda t: unicodedata.normalize("NFC", t) if t is not None else None)


def nfc(c: Column) -> Column:
    """Normal form C. Texts of code points below U+0300 are stable and never leave the JVM."""
    return F.when(~c.rlike(r"[^\x{0}-\x{2ff}]"), c).otherwise(_nfc(F.when(c.rlike(r"[^\x{0}-\x{2ff}]"), c)))


def with_ngrams(df: DataFrame, tokens: str, out: str, n: int) -> DataFrame:
    """Adds the array of n-grams joined by single spaces; empty where there are fewer tokens than n."""
    return NGram(n=n, inputCol=tokens, outputCol=out).transform(df)


def md5_mod(c: Column, modulus: int = 100_000) -> Column:
    """The 128-bit MD5 of a string modulo a number below 2**31, folded from four 32-bit words."""
    h = F.md5(c)
    total = F.lit(0).cast("bigint")
    for i in range(4):
        total = F.pmod(total * F.lit((1 << 32) % modulus).cast("bigint") + F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("bigint"), F.lit(modulus).cast("bigint"))
    return total


def source_hash(name: str) -> int:
    """Position-weighted sum of the bytes of a source's name."""
    return sum(b * (i + 1) for i, b in enumerate(name.encode())) % 100_000
