"""Token ids of whole texts by the tokenizers library, with caches of words in each worker.

Some tokenizer files drop white space, so that it never is part of a token, and split a run of letters from the marks behind
it. With these the ids of a text are those of its chunks between spaces and line ends, one after the other, and a chunk of
Latin letters and plain marks has the ids of both. Any other chunk goes to the library whole. A file is known for one of
these by its normaliser, its pattern and its mark of word ends, which are read when it is loaded; with any other file, whole
texts go to the library. Tests compare the results with those of the library for whole texts. Every id comes from the
library; nothing is cut, filled up or left out.

Defined cases: a null text is an empty one, without ids; an empty list gives none; words over LONGEST_WORD characters are
encoded and not kept.
"""

import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

MOST_WORDS = 300_000
LONGEST_WORD = 48
#: Letters that are their own NFC form and have one lower-case letter; marks that are in no added token and no contraction.
LETTERS = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$"
MARKS = ".,;:!?*$%&#"


# Fixed values of the file format: the parts of a tokenizer that drops white space and splits letters from marks.
NORMALISER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
WORD_END = "</w>"


def drops_space(parts: dict) -> bool:
    """Whether a tokenizer file's chunks between spaces can be encoded one by one. Added tokens must hold no white space and no letter apart from marks of their own."""
    added = all(not x["normalized"] and not x["lstrip"] and not x["rstrip"] and not x["single_word"] and x["content"].startswith("<|") and not any(c.isspace() for c in x["content"]) for x in parts["added_tokens"])
    model = parts["model"]
    plain = model["type"] == "BPE" and model.get("end_of_word_suffix") == WORD_END and not model.get("continuing_subword_prefix") and not model.get("dropout")
    return added and plain and parts["normalizer"] == NORMALISER and parts["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": [SPLIT, BYTES]}


@cache
def tokenizer(path: str) -> Tokenizer:
    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def batches_of(texts: list[str], most: int, most_chars: int) -> Iterator[list[str]]:
    """Up to `most` texts of about most_chars characters together; one longer text stands alone."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= most_chars or i - start + 1 >= most:
            yield texts[start : i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield texts[start:]


def chunks(texts: list[str | None]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct chunks between spaces and line ends, the place of each chunk among them, and where each text's begin."""
    column = pc.replace_substring(pc.fill_null(pa.array(texts, pa.large_string()), ""), "\n", " ")
    split = pc.split_pattern(column, " ")
    coded = split.values.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), split.offsets.to_numpy()


def listed(column: pa.Array) -> list:
    """The values of a column without nulls. to_pylist would make an Arrow object of each, which costs more than to look it up."""
    return column.to_numpy(zero_copy_only=False).tolist()


def gathered(numbers: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The runs of numbers that the codes name, one after the other."""
    starts, own = np.cumsum(lengths) - lengths, lengths[codes]
    ends = np.cumsum(own)
    return numbers[np.repeat(starts[codes] - ends + own, own) + np.arange(ends[-1] if len(ends) else 0)]


class Encoder:
    """Holds the ids of two generations of at most MOST_WORDS words (and a batch's own): used words move to the younger one."""

    def __init__(self, path: str):
        self.library = tokenizer(path)
        self.chunked = drops_space(json.loads(self.library.to_str()))
        vocabulary = self.library.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for word, i in vocabulary.items() if word.endswith(WORD_END)]] = True
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        """Some at a time, as encodings are large."""
        return [np.array(x.ids, np.uint32).tobytes() for some in batches_of(texts, 2_000, 500_000) for x in self.library.encode_batch_fast(some, add_special_tokens=False)]

    def _learned(self, words: list[str]) -> dict[str, bytes]:
        """Words of letters only are one pre-token each, whose last token marks its end; so they may share a call."""
        out = {}
        groups = [words[i : i + 256] for i in range(0, len(words), 256)]
        for group, ids in zip(groups, self._ids([" ".join(x) for x in groups]), strict=True):
            cuts = [0, *(4 * (np.flatnonzero(self.ends[np.frombuffer(ids, np.uint32)]) + 1)).tolist()]
            if len(cuts) != len(group) + 1 or cuts[-1] != len(ids):
                out.update(zip(group, self._ids(group), strict=True))
            else:
                out.update((w, ids[a:b]) for w, a, b in zip(group, cuts, cuts[1:], strict=False))
        return out

    def _of(self, words: list[str], letters: bool) -> list[bytes]:
        """Ids of distinct words."""
        known, older = self.words, self.older
        new = [w for w in words if w not in known]
        if new:
            if len(known) > MOST_WORDS:
                self.older, self.words = known, {}
                known, older, new = self.words, self.older, words
            known.update((w, older[w]) for w in new if w in older)
            if new := [w for w in new if w not in known]:
                known.update(self._learned(new) if letters else zip(new, self._ids(new), strict=True))
        out = [known[w] for w in words]
        for w in new:
            if len(w) > LONGEST_WORD:
                del known[w]
        return out

    def of_chunks(self, distinct: pa.Array) -> list[bytes]:
        """Ids of each chunk."""
        stems = pc.utf8_rtrim(distinct, MARKS)
        plain = pc.match_substring_regex(stems, LETTERS)
        where = plain.to_numpy(zero_copy_only=False)
        out = np.empty(len(distinct), object)
        others = listed(distinct.filter(pc.invert(plain)))
        out[~where] = np.fromiter(self._of(others, False), object, len(others))
        whole, stem = distinct.filter(plain), stems.filter(plain)
        marks = pc.replace_substring_regex(whole, "^[^.,;:!?*$%&#]*", "")
        parts = []
        for words, letters in ((pc.utf8_lower(stem), True), (marks, False)):
            coded = words.dictionary_encode()
            ids = self._of(listed(coded.dictionary), letters)
            parts.append(map(ids.__getitem__, listed(coded.indices)))
        out[where] = np.fromiter((a + b for a, b in zip(*parts, strict=True)), object, len(stem))
        return out.tolist()

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts as 32-bit numbers, and where each text's begin (one more entry than texts)."""
        if not self.chunked:
            whole = self._ids([t or "" for t in texts])
            return np.frombuffer(b"".join(whole), np.uint32), np.concatenate([[0], np.cumsum([len(x) // 4 for x in whole])]).astype(np.int64)
        distinct, codes, offsets = chunks(texts)
        ids = self.of_chunks(distinct)
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        counts = np.concatenate([[0], np.cumsum(lengths[codes])])
        return gathered(np.frombuffer(b"".join(ids), np.uint32), lengths, codes), counts[offsets]


@cache
def encoder(path: str) -> Encoder:
    """One in each Python worker."""
    return Encoder(path)
