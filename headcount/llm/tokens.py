"""Token counts kept up to date by signed deltas.

Totals by source, language and tokenizer version are sums, so a change is a row with a
sign: an insert adds, a delete takes away, and a revised count does both. A batch of
changes is summed, written, and committed by creating one small file that names what
was written. A batch that is delivered again finds its file and changes nothing; one
that dies before the file is there has not happened.
"""

from __future__ import annotations

import base64
import os
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headcount.session import remove

#: Default vocabulary: one "base64 rank" pair a line.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that cuts texts into pieces for this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

KEYS = ["source", "lang", "tokenizer"]
SUMS = ["n_docs", "n_tokens", "n_bytes"]


@lru_cache(maxsize=4)
def _encoding(vocabulary: bytes, pattern: str) -> tiktoken.Encoding:
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def version(path: str = VOCABULARY) -> str:
    """The tokenizer version: the name of its file and the checksum of what is in it."""
    with open(path, "rb") as file:
        check = zlib.crc32(file.read())
    return f"{os.path.basename(path).split('.')[0]}-{check:08x}"


def _facts(docs: DataFrame, tokenizer: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"),
        F.lit(tokenizer).alias("tokenizer"),
        text.alias("text"),
        F.octet_length(text).cast("long").alias("n_bytes"),
    )


def counted(docs: DataFrame, path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(source, lang, tokenizer, n_tokens, n_bytes) per row of `docs`, whole texts.

    The vocabulary is read once by the driver and sent along; its size is that of its
    file. Null texts have no tokens; null sources and languages are kept.
    """
    with open(path, "rb") as file:
        vocabulary = file.read()

    @F.pandas_udf("long")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = _encoding(vocabulary, pattern)
        for batch in texts:
            yield pd.Series([len(encoding.encode_ordinary(t)) for t in batch], dtype="int64")

    return _facts(docs, version(path)).select(*KEYS, count("text").alias("n_tokens"), "n_bytes")


def estimated(docs: DataFrame, path: str = VOCABULARY, bytes_per_token: float = 4.0) -> DataFrame:
    """Like `counted`, by the length alone: a first figure, to be revised."""
    return _facts(docs, version(path)).select(
        *KEYS,
        F.ceil(F.col("n_bytes") / F.lit(bytes_per_token)).cast("long").alias("n_tokens"),
        "n_bytes",
    )


def signed(facts: DataFrame, sign: int) -> DataFrame:
    """`facts` as inserts (sign 1) or deletes (sign -1)."""
    return facts.select(
        *KEYS,
        F.lit(sign).cast("long").alias("n_docs"),
        (F.col("n_tokens") * sign).alias("n_tokens"),
        (F.col("n_bytes") * sign).alias("n_bytes"),
    )


def revised(old: DataFrame, new: DataFrame) -> DataFrame:
    """The changes that put `new` facts in place of `old` ones."""
    return signed(old, -1).union(signed(new, 1))


def summed(changes: DataFrame) -> DataFrame:
    return changes.groupBy(*KEYS).agg(*[F.sum(s).cast("long").alias(s) for s in SUMS])


class Rollup:
    """Additive totals below a folder that all executors reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def _file(self, name: str) -> tuple[object, object]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _names(self, folder: str) -> dict[str, str]:
        """File name -> content of the small files in a folder."""
        system, path = self._file(folder)
        if not system.exists(path):
            return {}
        files = self.spark.read.text(f"{self.path}/{folder}", wholetext=True)
        rows = files.select(F.col("_metadata.file_name").alias("name"), "value").collect()
        return {r["name"]: r["value"] for r in rows}

    def _create(self, name: str, content: str) -> bool:
        """Create a file; False if it is there already, which the file system decides."""
        system, path = self._file(name)
        if system.exists(path):
            return False
        try:
            out = system.create(path, False)
        except Exception as error:
            if system.exists(path):
                return False
            raise error
        out.write(bytearray(content.encode()))
        out.close()
        return True

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch of signed changes once; False if it had been committed before.

        A batch name is letters, digits, dots and dashes.
        """
        if not batch or any(not (c.isalnum() or c in ".-") for c in batch):
            raise ValueError("a batch name is made of letters, digits, dots and dashes")
        system, path = self._file(f"commits/{batch}")
        if system.exists(path):
            return False
        folder = f"deltas/{batch}-{uuid.uuid4().hex}"
        summed(changes).write.parquet(f"{self.path}/{folder}")
        if self._create(f"commits/{batch}", folder):
            return True
        remove(self.spark, f"{self.path}/{folder}")
        return False

    def _parts(self) -> tuple[list[str], dict[str, str], str | None]:
        """Folders to add up, all commits, and the folder of the last base."""
        commits, bases = self._names("commits"), self._names("bases")
        if not bases:
            return list(commits.values()), commits, None
        base, *covered = bases[max(bases)].split("\n")
        rest = [f for b, f in commits.items() if b not in set(covered)]
        return [base, *rest], commits, base

    def totals(self) -> DataFrame:
        """The sums of all committed changes; groups that have come to nothing are left out."""
        folders, _, _ = self._parts()
        if not folders:
            return self.spark.createDataFrame(
                [], "source string, lang string, tokenizer string, n_docs long, n_tokens long, n_bytes long"
            )
        parts = self.spark.read.parquet(*[f"{self.path}/{f}" for f in folders])
        return summed(parts).where(" or ".join(f"{s} <> 0" for s in SUMS))

    def compact(self) -> None:
        """Fold what is committed into one base; names of its batches are remembered."""
        folders, commits, _ = self._parts()
        if len(folders) < 2:
            return
        folder = f"deltas/base-{uuid.uuid4().hex}"
        parts = self.spark.read.parquet(*[f"{self.path}/{f}" for f in folders])
        summed(parts).write.parquet(f"{self.path}/{folder}")
        number = len(self._names("bases"))
        if not self._create(f"bases/{number:08d}", "\n".join([folder, *commits])):
            remove(self.spark, f"{self.path}/{folder}")
