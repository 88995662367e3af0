"""Words of a text: runs of anything but space, tab, line feed, vertical tab, form feed and carriage return."""

import numpy as np
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"
_BLANK_RUN = r"[\x20\x09-\x0D]+"


def words_column(text: Column) -> Column:
    """The words of a text as an array; empty for null and for a text without words."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _BLANK_RUN))


def words_of(text: str | None) -> list[bytes]:
    """The same words as UTF-8; ``bytes.split`` cuts at exactly these six characters."""
    return (text or "").encode("utf-8", "surrogatepass").split()


class WordHashes(dict):
    """64-bit hashes of words: a word's place in a table of hashes is kept, and all start anew beyond LIMIT words."""

    LIMIT = 1_000_000

    def __init__(self):
        super().__init__()
        self._table = np.empty(1024, dtype=np.uint64)

    def __missing__(self, word: bytes) -> int:
        place = len(self)
        if place == len(self._table):
            self._table = np.concatenate([self._table, np.empty_like(self._table)])
        self._table[place] = xxhash.xxh64_intdigest(word)
        self[word] = place
        return place

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) >= self.LIMIT:
            self.clear()
        # Small numbers go through Python faster than the hashes themselves.
        return self._table_at(np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words)))

    def _table_at(self, places: np.ndarray) -> np.ndarray:
        return self._table[places]


_STEP = 0x9E3779B97F4A7C15


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """64-bit hash of every run of ``size`` consecutive words, in order (none if the text is shorter)."""
    count = len(words) - size + 1
    if count <= 0:
        return np.empty(0, dtype=np.uint64)
    total = np.zeros(count, dtype=np.uint64)
    for k in range(size):
        # An odd factor of its own for each place: exchanged words give another sum.
        factor = np.uint64((pow(_STEP, k + 1, 2**64)) | 1)
        total += words[k : k + count] * factor
    return mixed(total)


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (one to one)."""
    x = values ^ (values >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))
