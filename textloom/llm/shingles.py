"""Word shingles of texts and their MinHash signatures, with numpy."""

import numpy as np

from textloom.llm.common import WORD_HASHES, gram_hashes, mixed

SHINGLE = 5
#: Bits of a signature component that are kept.
BITS = 16


def words_of(text: str | None) -> list[bytes]:
    """A-Z in lower case, split at ASCII white space; no words for null."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles_of(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The distinct shingles as sorted 64-bit hashes; a text of fewer words has its whole sequence as one."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(gram_hashes(WORD_HASHES.of(words), min(size, len(words))))


def signature_seeds(components: int) -> tuple[np.ndarray, np.ndarray]:
    numbers = mixed(np.arange(2 * components, dtype=np.uint64), 31)
    return numbers[:components], numbers[components:] | np.uint64(1)


def signature(shingles: np.ndarray, seeds: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """BITS bits of the least hash of the set under each seed."""
    adds, factors = seeds
    least = None
    for start in range(0, len(shingles), 1024):
        some = ((shingles[None, start : start + 1024] ^ adds[:, None]) * factors[:, None]).min(1)
        least = some if least is None else np.minimum(least, some)
    return (mixed(least, 5) >> np.uint64(64 - BITS)).astype(np.uint16)
