"""Tokens, fixed-length sequences, loss masks.

Documents are laid end to end in a given order, each between a begin and an end token, and cut every ``length`` tokens;
the remainder is dropped. Null texts give no tokens and no document. Token ids must fit 16 unsigned bits.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType
from corpusmill.functions.ranges import edges_of, range_of

SEQUENCE = 1025
BOS, EOS, FIRST_BYTE = 1, 2, 4
MAX_VOCABULARY = 65_535


def byte_tokens(text: Column) -> Column:
    """Ids of the bytes of a text: a vocabulary without merges, byte b being FIRST_BYTE + b."""
    signs = F.split(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), "")
    return F.transform(F.filter(signs, lambda x: x != ""), lambda x: F.ascii(x) + FIRST_BYTE)


def framed(ids: Column, bos: int = BOS, eos: int = EOS) -> Column:
    return F.concat(F.array(F.lit(bos)), ids, F.array(F.lit(eos)))


def _tokenizer_file(path: str, needed: tuple[str, ...] = ()) -> str:
    with open(path, encoding="utf-8") as f:
        content = f.read()
    spec = json.loads(content)
    names = {**spec["model"]["vocab"], **{t["content"]: t["id"] for t in spec.get("added_tokens", [])}}
    if max(names.values(), default=0) >= MAX_VOCABULARY:
        raise ValueError("token ids do not fit 16 bits")
    if absent := [n for n in needed if n not in names]:
        raise ValueError(f"the vocabulary lacks {absent}")
    return content


def bpe_tokens(df: DataFrame, path: str, text: str = "text", out: str = "ids", needed: tuple[str, ...] = ()) -> DataFrame:
    """Adds the ids of a byte-level tokenizer stored as a JSON file that the driver can read; executors get its content.

    Refused if the ids do not fit 16 bits or if the vocabulary lacks one of the tokens named in ``needed``.
    """
    content = _tokenizer_file(path, needed)
    schema = StructType([*df.schema.fields, StructField(out, ArrayType(IntegerType()))])
    names = df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(content)
        t.encode_special_tokens = True
        for pdf in batches:
            encoded = t.encode_batch(pdf[text].fillna("").tolist(), add_special_tokens=False)
            yield pdf.assign(**{out: [e.ids for e in encoded]})[[*names, out]]

    return df.mapInPandas(run, schema)


def decoded(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded", skip: int | None = None) -> DataFrame:
    """Adds the text of the ids; ``skip`` is the id of a begin token to leave out."""
    schema = StructType([*df.schema.fields, StructField(out, StringType())])
    names = df.columns
    content = _tokenizer_file(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(content)
        for pdf in batches:
            yield pdf.assign(**{out: [t.decode([int(i) for i in x if i != skip]) for x in pdf[ids]]})[[*names, out]]

    return df.mapInPandas(run, schema)


def offsets(sized: DataFrame, size: str = "n_tokens", order: str = "doc_id", keys: tuple[str, ...] = ("split",)) -> DataFrame:
    """Adds ``offset``, the tokens before each document within its keys.

    Running sums are local to ranges of the order column; the ranges' totals, at most a thousand or so, are summed on top.
    """
    ranged = sized.withColumn("__b", range_of(order, edges_of(sized, order)))
    totals = ranged.groupBy(*keys, "__b").agg(F.sum(size).alias("__t"))
    before = totals.withColumn("__before", F.coalesce(F.sum("__t").over(Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__t")
    local = F.coalesce(F.sum(size).over(Window.partitionBy(*keys, "__b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn("__local", local).join(before, [*keys, "__b"]).withColumn("offset", F.col("__local") + F.col("__before")).drop("__local", "__before", "__b")


def pack(tokenised: DataFrame, ids: str = "ids", order: str = "doc_id", keys: tuple[str, ...] = ("split",), length: int = SEQUENCE) -> DataFrame:
    """``keys, seq_id, tokens``: one slice per document and sequence is moved, never single tokens."""
    sized = tokenised.select(*keys, order, ids).withColumn("n_tokens", F.size(ids).cast("bigint"))
    placed = offsets(sized, "n_tokens", order, keys).where("n_tokens > 0")
    first, last = F.floor(F.col("offset") / length), F.floor((F.col("offset") + F.col("n_tokens") - 1) / length)

    def part(s: Column) -> Column:
        start = F.greatest(s * length - F.col("offset"), F.lit(0))
        stop = F.least((s + 1) * length - F.col("offset"), F.col("n_tokens"))
        return F.struct(s.alias("seq_id"), (F.col("offset") + start).alias("at"), F.slice(ids, (start + 1).cast("int"), (stop - start).cast("int")).alias("piece"))

    # sliced before it is exploded, so no row carries more of a document than its own part
    piece = placed.select(*keys, F.explode(F.transform(F.sequence(first, last), part)).alias("x")).select(*keys, "x.seq_id", "x.at", "x.piece")
    rows = piece.groupBy(*keys, "seq_id").agg(F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("p"))
    return rows.select(*keys, "seq_id", F.flatten(F.transform("p", lambda x: x["piece"])).alias("tokens")).where(F.size("tokens") == length)


def input_and_target(packed: DataFrame, tokens: str = "tokens") -> DataFrame:
    n = F.size(tokens)
    return packed.withColumn("x", F.slice(tokens, 1, n - 1)).withColumn("y", F.slice(tokens, 2, n - 1))


def boundary_mask(tokens: Column, bos: int = BOS, eos: int = EOS) -> Column:
    """False where the token before is a begin or end token: a prediction across documents."""
    return F.transform(F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0))), lambda t: (t != bos) & (t != eos))


def distance_mask(mask: Column, offset: int) -> Column:
    """Valid only if all of ``offset`` consecutive positions are; null where the mask is shorter than that."""
    n = F.greatest(F.size(mask) - offset + 1, F.lit(0))
    out = F.slice(mask, F.lit(1), n)
    for k in range(1, offset):
        out = F.zip_with(out, F.slice(mask, F.lit(k + 1), n), lambda a, b: a & b)
    return F.when(n > 0, out)


def distant_targets(targets: Column, offset: int) -> Column:
    """Targets of the extra head that predicts ``offset`` tokens ahead, as executed: one position further."""
    return F.slice(targets, F.lit(offset + 1), F.greatest(F.size(targets) - offset, F.lit(0)))


def write_binary(packed: DataFrame, folder: str, order: tuple[str, ...] = ("seq_id",), sequences_per_file: int = 1 << 18) -> int:
    """Little-endian 16-bit token files without any frame, ``part-00000.bin`` on in the given order; returns their number.

    Every task writes under a name of its own and renames at the end, so a task that runs again leaves one whole file.
    ``folder`` is a path or address that every executor reaches.
    """
    files = max(1, -(-packed.count() // sequences_per_file))
    ordered = packed.repartitionByRange(files, *order).sortWithinPartitions(*order).select("tokens")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        name = f"{root}/part-{TaskContext.get().partitionId():05d}.bin"
        draft, n = f"{root}/.{uuid.uuid4().hex}", 0
        with fs.open_output_stream(draft) as out:
            for pdf in batches:
                for t in pdf["tokens"]:
                    a = np.asarray(t, np.int64)
                    if len(a) and (a.min() < 0 or a.max() > MAX_VOCABULARY):
                        raise ValueError("token ids do not fit 16 bits")
                    out.write(a.astype("<u2").tobytes())
                    n += 1
        fs.move(draft, name)
        yield pd.DataFrame({"name": [name], "sequences": [n]})

    return ordered.mapInPandas(run, "name string, sequences bigint").count()


def read_binary(spark, path: str, length: int = SEQUENCE, sequences_per_task: int = 1 << 14) -> DataFrame:
    """``path, seq_id, tokens`` of flat 16-bit token files: one file, or all of a folder with their sequences numbered through.

    A file is read in stretches by many tasks; the driver sees names and sizes only. Tokens behind a file's last whole
    sequence are left out.
    """
    fs, root = FileSystem.from_uri(path)
    info = fs.get_file_info(root)
    found = [info] if info.type == FileType.File else sorted((f for f in fs.get_file_info(FileSelector(root)) if f.base_name.endswith(".bin")), key=lambda f: f.path)
    stretches, first = [], 0
    for f in found:
        whole = f.size // (2 * length)
        stretches += [(f.path, at, min(sequences_per_task, whole - at), first + at) for at in range(0, whole, sequences_per_task)]
        first += whole

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, _ = FileSystem.from_uri(path)
        for pdf in batches:
            for name, at, n, number in pdf.itertuples(index=False):
                with fs.open_input_file(name) as f:
                    f.seek(int(at) * 2 * length)
                    a = np.frombuffer(f.read(int(n) * 2 * length), "<u2").astype(np.int32).reshape(-1, length)
                for lo in range(0, len(a), 1024):
                    part = a[lo : lo + 1024]
                    yield pd.DataFrame({"path": name, "seq_id": np.arange(number + lo, number + lo + len(part)), "tokens": list(part)})

    table = spark.createDataFrame(stretches, "path string, at bigint, n bigint, first bigint").repartition(max(1, len(stretches)))
    return table.mapInPandas(run, "path string, seq_id bigint, tokens array<int>")


def epochs(packed: DataFrame, count: int, seed: int = 42) -> DataFrame:
    """Every sequence once per epoch, in an order of its own for each: ordered by ``epoch`` and ``rank_key``."""
    dealt = packed.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).withColumn("rank_key", F.md5(F.concat_ws("/", F.lit(str(seed)), F.col("epoch").cast("string"), F.col("seq_id").cast("string"))))
    return dealt.orderBy("epoch", "rank_key", "seq_id")


def micro_batches(ordered: DataFrame, position: str = "position", size: int = 4) -> DataFrame:
    """Adds ``batch``; rows of the last, incomplete batch go."""
    total = ordered.agg(F.floor(F.count("*") / size).alias("__full"))
    return ordered.withColumn("batch", F.floor(F.col(position) / size)).join(F.broadcast(total)).where("batch < __full").drop("__full")
