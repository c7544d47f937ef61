"""Problem 1: tokens of every document under an existing byte-level BPE tokenizer, and totals per slice.

The texts are cut into pieces in the JVM; only distinct pieces are tokenised. They are range-partitioned, so a partition
is a contiguous part of the prefix trie; walking it in order, the exact tokenisation of every prefix (its last token and
its token count) is kept on a stack and shared by all pieces that begin alike. The counts then return to the documents:
the most frequent pieces, a fixed number, through a broadcast, all others through a shuffle.

Defined results: a null text has null tokens, an empty one 0; repeated rows count each; ids of the vocabulary's special
tokens in a text are ordinary text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.plans.lineage import materialize

HEAD = 32_768
_SPACE = r"\p{IsWhite_Space}"
#: Fixed value: the usual pre-splitting, with the white-space class of its definition written out.
PIECES = rf"('s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|{_SPACE}+(?!\P{{IsWhite_Space}})|{_SPACE}+)"


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of every byte: itself where it prints, else the next free sign from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in shown}
    free = 256
    for b in range(256):
        if b not in shown:
            table[chr(free)] = b
            free += 1
    return table


class Tokenizer:
    """Vocabulary and merges over bytes, with exact incremental tokenisation."""

    def __init__(self, vocabulary: list[tuple[int, str]], merges: list[tuple[int, str, str]]):
        alphabet = byte_alphabet()
        as_bytes = lambda s: bytes(alphabet[c] for c in s)
        ids = {s: i for i, s in vocabulary}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, left, right in sorted(merges):
            self.merges.setdefault((ids[left], ids[right]), (rank, ids[left + right]))
        self.base = {bytes([b]): ids[c] for c, b in alphabet.items() if c in ids}
        made = {m for _, m in self.merges.values()} | set(self.base.values())
        self.bytes = {i: as_bytes(s) for i, s in vocabulary if i in made}
        # a token that its own bytes do not tokenise to can never come out
        self.whole = {b: i for i, b in self.bytes.items() if self.encode(b) == [i]}
        self.longest = max(map(len, self.whole), default=1)
        self.pairs: dict[tuple[int, int], bool] = {}

    def encode(self, piece: bytes) -> list[int]:
        """Tokens of one piece by applying the merge of lowest rank, leftmost first, until none applies."""
        tokens = [self.base[piece[i : i + 1]] for i in range(len(piece))]
        while len(tokens) > 1:
            best = min(((self.merges[p][0], i) for i, p in enumerate(zip(tokens, tokens[1:])) if p in self.merges), default=None)
            if best is None:
                break
            pair = (tokens[best[1]], tokens[best[1] + 1])
            new, out, i = self.merges[pair][1], [], 0
            while i < len(tokens):
                if i + 1 < len(tokens) and (tokens[i], tokens[i + 1]) == pair:
                    out.append(new)
                    i += 2
                else:
                    out.append(tokens[i])
                    i += 1
            tokens = out
        return tokens

    def stands(self, left: int, right: int) -> bool:
        """Whether the two tokens survive side by side; remembered."""
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            known = self.pairs[key] = self.encode(self.bytes[left] + self.bytes[right]) == [left, right]
        return known


class Walk:
    """Tokenisation states along the current path of the trie: last token and number of tokens of every prefix."""

    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer = tokenizer
        self.path = b""
        self.last: list[int] = [-1]
        self.count: list[int] = [0]

    def tokens(self, piece: bytes) -> int:
        path, last, count = self.path, self.last, self.count
        whole, stands, longest = self.tokenizer.whole, self.tokenizer.stands, self.tokenizer.longest
        shared, most = 0, min(len(path), len(piece))
        while shared < most and path[shared] == piece[shared]:
            shared += 1
        del last[shared + 1 :], count[shared + 1 :]
        for end in range(shared + 1, len(piece) + 1):
            for start in range(max(0, end - longest), end):
                token = whole.get(piece[start:end])
                if token is not None and (start == 0 or stands(last[start], token)):
                    last.append(token)
                    count.append(count[start] + 1)
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
        self.path = piece
        return count[-1]


def load(vocabulary: DataFrame, merges: DataFrame, most: int = 1_000_000) -> Tokenizer:
    """The tokenizer of two tables of fixed size; refused beyond ``most`` rows."""
    v = vocabulary.select("token_id", "token").where("token is not null").limit(most + 1).collect()
    m = merges.select("merge_rank", "left_piece", "right_piece").limit(most + 1).collect()
    if len(v) > most or len(m) > most:
        raise ValueError("a tokenizer of that size does not fit the executors")
    return Tokenizer([tuple(r) for r in v], [tuple(r) for r in m])


def pieces(text: Column) -> Column:
    """Pieces of a text, to which a space is added in front unless it begins with one or is empty."""
    return F.regexp_extract_all(F.when(text.startswith(" ") | (text == ""), text).otherwise(F.concat(F.lit(" "), text)), F.lit(PIECES), F.lit(1))


def piece_tokens(counted: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """``piece, n, tokens``: each distinct piece with its token count, by walks over contiguous parts of the trie."""
    shared = counted.sparkSession.sparkContext.broadcast(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = Walk(shared.value)
        for batch in batches:
            tokens = [walk.tokens(p.encode()) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tokens, pa.int64())], names=["piece", "n", "tokens"])

    return counted.select("piece", "n").repartitionByRange("piece").sortWithinPartitions("piece").mapInArrow(run, "piece string, n bigint, tokens bigint")


def token_counts(documents: DataFrame, tokenizer: Tokenizer, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """``doc_id, digest, tokens`` of every text that has a piece; rows of one id and text are one row here."""
    key = [id_column, "digest"]
    exploded = documents.where(F.col(text).isNotNull()).select(id_column, F.xxhash64(text).alias("digest"), F.posexplode(pieces(F.col(text))).alias("at", "piece"))
    table = materialize(piece_tokens(exploded.groupBy("piece").agg(F.count("*").alias("n")), tokenizer))
    head = table.orderBy(F.desc("n"), "piece").limit(HEAD).select("piece", F.col("tokens").alias("head_tokens"))
    rest = F.when(F.col("head_tokens").isNull(), F.col("piece")).alias("rest")
    # a document's frequent pieces fold into one row before anything is shuffled
    parts = exploded.join(F.broadcast(head), "piece", "left").groupBy(*key, rest).agg(F.sum("head_tokens").alias("known"), F.count("*").alias("times"), F.count_if(F.col("at") == 0).alias("rows"))
    parts = materialize(parts)
    tail = parts.where("rest is not null").select(*key, F.col("rest").alias("piece"), "times", "rows").join(table.select("piece", "tokens"), "piece")
    both = parts.where("rest is null").select(*key, F.col("known").alias("tokens"), "rows").unionByName(tail.select(*key, (F.col("times") * F.col("tokens")).alias("tokens"), "rows"))
    # every row has one first piece, so their number is the number of equal rows
    return both.groupBy(*key).agg((F.sum("tokens") / F.sum("rows")).cast("bigint").alias("tokens"))


def with_tokens(documents: DataFrame, tokenizer: Tokenizer, columns: list[str], text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """``doc_id``, the given columns, ``n_chars`` of the text and ``n_tokens``."""
    base = documents.select(id_column, *columns, F.length(text).cast("bigint").alias("n_chars"), F.xxhash64(text).alias("__digest"))
    counts = token_counts(documents, tokenizer, text, id_column).select(F.col(id_column).alias("__id"), F.col("digest").alias("__of"), F.col("tokens").alias("__tokens"))
    joined = base.join(counts, F.col(id_column).eqNullSafe(F.col("__id")) & (F.col("__digest") == F.col("__of")), "left")
    return joined.select(id_column, *columns, "n_chars", F.when(F.col("n_chars").isNotNull(), F.coalesce("__tokens", F.lit(0))).alias("n_tokens"))


def domain_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), r"^www\.", "")


def totals(counted: DataFrame, *keys: str) -> DataFrame:
    return counted.groupBy(*keys).agg(F.count("*").alias("documents"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("characters"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens"))
