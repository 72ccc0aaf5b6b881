"""Word valences of any number in a file that all workers of a machine map into memory, one copy between them.

The file holds the words' digests in order, their valences, and the words themselves by which a hit is made sure.  A worker holds
nothing of it but the pages that it touches, which the workers of a machine share, and the words that it looked up last.
"""

from __future__ import annotations

import functools
import hashlib
import os
import tempfile
import uuid
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import bound_batches

#: Words that a worker remembers, found or not.
REMEMBERED = 1 << 16
_HEADER = np.dtype([("words", "<u8"), ("bytes", "<u8")])


def _digest(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


class WordFile(Mapping):
    """A read-only mapping of words to valences; what is sent to workers is the file's name alone."""

    def __init__(self, name: str) -> None:
        self.name = name
        self._lookup = None

    def __getstate__(self) -> dict:
        return {"name": self.name, "_lookup": None}

    def _opened(self):
        """The file's arrays, mapped on first use."""
        path = SparkFiles.get(self.name)
        n, size = (int(x) for x in np.fromfile(path, _HEADER, 1)[0])
        parts, at = [], _HEADER.itemsize
        for kind, count in (("<u8", n), ("<f8", n), ("<u8", n + 1), ("u1", size)):
            parts.append(np.memmap(path, kind, "r", at, (count,)) if count else np.zeros(0, kind))
            at += np.dtype(kind).itemsize * count
        return parts

    def _find(self, word: str) -> float | None:
        if self._lookup is None:
            digests, values, begins, letters = self._opened()

            def find(word: str) -> float | None:
                data = word.encode("utf-8", "surrogatepass")
                wanted = np.uint64(_digest(data))
                at = int(np.searchsorted(digests, wanted))
                while at < len(digests) and digests[at] == wanted:
                    if letters[int(begins[at]) : int(begins[at + 1])].tobytes() == data:
                        return float(values[at])
                    at += 1
                return None

            self._lookup = functools.lru_cache(REMEMBERED)(find)
        return self._lookup(word)

    def __getitem__(self, word: str) -> float:
        found = self._find(word)
        if found is None:
            raise KeyError(word)
        return found

    def __contains__(self, word: object) -> bool:
        return isinstance(word, str) and self._find(word) is not None

    def __len__(self) -> int:
        return len(self._opened()[0])

    def __iter__(self) -> Iterator[str]:
        _, _, begins, letters = self._opened()
        for k in range(len(begins) - 1):
            yield letters[int(begins[k]) : int(begins[k + 1])].tobytes().decode("utf-8", "surrogatepass")


def ship(words: DataFrame, token: str = "token", valence: str = "valence", most: int = 5_000_000) -> WordFile:
    """Make the file of a table of words and ship it to all workers, once a session.

    The last valence of a token by value counts.  A dictionary is configuration: it comes to the driver (some hundred bytes
    a word), and more than ``most`` words are an error.
    """
    spark = words.sparkSession
    bound_batches(spark)
    rows = words.where(F.col(token).isNotNull() & F.col(valence).isNotNull()).groupBy(F.col(token).alias("t")).agg(F.max(F.col(valence).cast("double")).alias("v"))
    found = rows.limit(most + 1).toArrow()
    if found.num_rows > most:
        raise ValueError(f"a dictionary of more than {most} words")
    tokens = [t.encode("utf-8", "surrogatepass") for t in found["t"].to_pylist()]
    values = found["v"].to_numpy()
    digests = np.fromiter((_digest(t) for t in tokens), "<u8", len(tokens))
    order = np.argsort(digests, kind="stable")
    lengths = np.fromiter((len(tokens[k]) for k in order), "<u8", len(tokens))
    header = np.array([(len(tokens), int(lengths.sum()))], _HEADER)
    folder = tempfile.mkdtemp(prefix="tindera-words-")  # of the driver alone; addFile hands the file to the workers
    path = os.path.join(folder, f"words-{uuid.uuid4().hex}.bin")
    with open(path, "wb") as out:
        for part in (header, digests[order], values.astype("<f8")[order], np.concatenate([np.zeros(1, "<u8"), np.cumsum(lengths, dtype="<u8")])):
            out.write(part.tobytes())
        out.write(b"".join(tokens[k] for k in order))
    spark.sparkContext.addFile(path)
    return WordFile(os.path.basename(path))


def word_sums(text: Column, words: WordFile, pattern: str = "[a-z]+") -> Column:
    """How many words of a text (in small letters) the file holds, and the sum of their valences."""
    import re

    found = re.compile(pattern)

    def run(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            values = [v for v in map(words._find, found.findall((text or "").lower())) if v is not None]
            out.append((len(values), float(sum(values))))
        return pd.DataFrame(out, columns=["known", "total"])

    return F.pandas_udf(run, "known long, total double")(text)
