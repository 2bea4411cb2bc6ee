"""SentencePiece encoding and decoding on the tokenizers library.

The model file's protobuf is read here, and its normaliser, white-space marker, pieces with their scores and byte fallback
are rebuilt as a tokenizer of that library: unigram models by their scores, BPE models by merges in the order of the scores.
Parity is verified: each new chunk of text is encoded by the sentencepiece library too, and the column n_different tells in how
many of a document's chunks the rebuilt tokenizer's ids were not the same; there, sentencepiece's ids stand. Ids are decoded
through a table of the pieces' bytes, which is held against the rebuilt tokenizer's own decoder and the sentencepiece library
for every piece when a model is loaded; a model for which they differ is refused.

Where no piece joins a letter to a marker behind it, and the normaliser leaves texts alone, a text's ids are those of its
chunks between single spaces, and workers keep chunks' ids; other texts go through the library whole.

Defined cases: a null text is an empty one, without pieces; repeated rows are encoded each; an empty table gives no rows; a
text that itself holds the marker comes back with spaces for it, as from sentencepiece, and has round_trip false.
"""

import re
import struct
import zlib
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

from textloom.llm.common import by_name, released
from textloom.llm.pretokens import LONGEST_WORD, batches_of, gathered

MARK = "▁"
#: Chunks in each of a worker's two generations.
MOST_CHUNKS = 80_000
#: Chunks that are encoded as one text.
GROUP = 64
#: Fixed values of the model format: kinds of pieces and of models.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


class Model(NamedTuple):
    pieces: list[tuple[str, float, int]]
    kind: int
    byte_fallback: bool
    unknown: int
    charsmap: bytes
    dummy_prefix: bool
    trims: bool


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a protobuf message's fields."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
            continue
        size = number() if tag & 7 == 2 else {1: 8, 5: 4}[tag & 7]
        yield tag >> 3, data[at : at + size]
        at += size


def parsed(data: bytes) -> Model:
    pieces, trainer, normaliser = [], {}, {}
    for field, value in fields(data):
        if field == 1:
            piece = dict(fields(value))
            pieces.append((piece[1].decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, piece.get(3, NORMAL)))
        elif field == 2:
            trainer = dict(fields(value))
        elif field == 3:
            normaliser = dict(fields(value))
    return Model(pieces, trainer.get(3, UNIGRAM), bool(trainer.get(35, 0)), trainer.get(40, 0), normaliser.get(2, b""), bool(normaliser.get(3, 1)), bool(normaliser.get(4, 1)))


def merges(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """All ways to join two pieces to a third, the third's better scores first, of equal scores the longer ones."""
    scores = {p: s for p, s, kind in pieces if kind in (NORMAL, USER_DEFINED)}
    found = []
    for piece, score in scores.items():
        found += [(-score, -len(piece), piece[:i], piece[i:]) for i in range(1, len(piece)) if piece[:i] in scores and piece[i:] in scores]
    found.sort(key=lambda x: (x[0], x[1], -len(x[2])))
    return [(a, b) for _, _, a, b in found]


def rebuilt(model: Model) -> Tokenizer:
    if model.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], model.unknown, model.byte_fallback)
    elif model.kind == BPE:
        core = models.BPE({p: i for i, (p, _, _) in enumerate(model.pieces)}, merges(model.pieces), unk_token=model.pieces[model.unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        raise ValueError("only unigram and BPE models are known")
    out = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.trims:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
    steps += [normalizers.Prepend(MARK)] if model.dummy_prefix else []
    out.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    steps = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    out.decoder = decoders.Sequence(steps + ([decoders.Strip(" ", 1, 0)] if model.dummy_prefix else []))
    if own := [AddedToken(p, normalized=True) for p, _, kind in model.pieces if kind == USER_DEFINED]:
        out.add_tokens(own)
    return out


class Codec:
    def __init__(self, data: bytes):
        self.model = parsed(data)
        self.library = rebuilt(self.model)
        self.other = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.bytes_of = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else p.replace(MARK, " ").encode() for p, _, kind in self.model.pieces]
        joins = any(re.search(f"[^{MARK}]{MARK}", p) for p, _, kind in self.model.pieces if kind in (NORMAL, USER_DEFINED))
        self.chunked = self.model.dummy_prefix and not (joins or self.model.charsmap or self.model.trims or any(kind == USER_DEFINED for _, _, kind in self.model.pieces))
        self.begins = np.array([p.startswith(MARK) for p, _, _ in self.model.pieces])
        self._compare_decoders()
        #: Ids of chunks, and whether the sentencepiece library has others.
        self.known: dict[str, tuple[bytes, bool]] = {}
        self.older: dict[str, tuple[bytes, bool]] = {}

    def _compare_decoders(self) -> None:
        """Every piece behind another one, as the first loses its space."""
        ids = [i for i, (_, _, kind) in enumerate(self.model.pieces) if kind in (NORMAL, USER_DEFINED, BYTE)]
        pairs = [[ids[-1], i] for i in ids]
        for pair, own, other in zip(pairs, self.library.decode_batch(pairs, skip_special_tokens=False), self.other.decode(pairs), strict=True):
            if not own == other == self.decode(np.array(pair)):
                raise ValueError(f"the rebuilt decoder differs for the pieces {pair}: {own!r}, {other!r}")

    def checked(self, texts: list[str]) -> list[tuple[bytes, bool]]:
        """Ids of texts by the rebuilt tokenizer, and whether sentencepiece's differ, which then stand; some at a time, as encodings are large."""
        out = []
        for some in batches_of(texts, 2_000, 500_000):
            for found, other in zip(self.library.encode_batch_fast(some, add_special_tokens=False), self.other.encode(some), strict=True):
                ids = found.ids
                differs = ids != other
                out.append((np.array(other if differs else ids, np.uint32).tobytes(), differs))
        return out

    def checked_chunks(self, chunks: list[str]) -> list[tuple[bytes, bool]]:
        """What `checked` gives for chunks between spaces, GROUP of them in one text: no piece reaches over a space, so that
        each begins with the only piece that has a mark in front. Where that does not count up, or the libraries differ, a
        group's chunks go one by one."""
        filled = [x for x in chunks if x]
        groups, out = [filled[i : i + GROUP] for i in range(0, len(filled), GROUP)], {}
        single = [] if len(filled) == len(chunks) else [""]
        for group, (ids, differs) in zip(groups, self.checked([" ".join(x) for x in groups]), strict=True):
            cuts = [*(4 * np.flatnonzero(self.begins[np.frombuffer(ids, np.uint32)])).tolist(), len(ids)]
            if differs or len(cuts) != len(group) + 1 or cuts[0]:
                single += group
            else:
                out.update((x, (ids[a:b], False)) for x, a, b in zip(group, cuts, cuts[1:], strict=False))
        out.update(zip(single, self.checked(single), strict=True))
        return [out[x] for x in chunks]

    def of_chunks(self, distinct: list[str]) -> list[tuple[bytes, bool]]:
        new = [x for x in distinct if x not in self.known]
        if len(self.known) > MOST_CHUNKS and new:
            self.older, self.known, new = self.known, {}, distinct
        self.known.update((x, self.older[x]) for x in new if x in self.older)
        if rest := [x for x in new if x not in self.known]:
            self.known.update(zip(rest, self.checked_chunks(rest), strict=True))
        out = [self.known[x] for x in distinct]
        for x in new:
            if len(x) > LONGEST_WORD:
                del self.known[x]
        return out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, where each text's begin (one more entry than texts), and the number of each text's chunks that differ."""
        column = pc.fill_null(pa.array(texts, pa.large_string()), "")
        whole = pc.match_substring_regex(column, f"^ | $|  |{MARK}") if self.chunked else pa.array([True] * len(texts))
        # A text that goes through whole stands as one chunk, told apart by a space before it.
        parts = pc.split_pattern(pc.if_else(whole, "", column), " ")
        coded = parts.values.dictionary_encode()
        codes, offsets = coded.indices.to_numpy(zero_copy_only=False), parts.offsets.to_numpy()
        distinct = coded.dictionary.to_pylist()
        found = self.of_chunks(distinct)
        if len(apart := np.flatnonzero(whole.to_numpy(zero_copy_only=False))):
            codes = codes.copy()
            codes[offsets[apart]] = len(found) + np.arange(len(apart))
            found += self.checked([texts[i] or "" for i in apart])
        ids, wrong = [x for x, _ in found], np.fromiter((x for _, x in found), np.int64, len(found))
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        counts = np.concatenate([[0], np.cumsum(lengths[codes])])
        return gathered(np.frombuffer(b"".join(ids), np.uint32), lengths, codes), counts[offsets], np.diff(np.concatenate([[0], np.cumsum(wrong[codes])])[offsets])

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text


@cache
def codec(path: str) -> Codec:
    with open(path, "rb") as f:
        return Codec(f.read())


def encoded(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ids, n_pieces, n_byte_pieces (by byte fallback), ids_crc32, decoded (text), round_trip, n_different, and the columns to carry."""
    given = by_name(docs, id=id_col, text=text_col, **{f"carried_{i}": c for i, c in enumerate(carry)})
    carried = [given.schema[f"carried_{i}"] for i in range(len(carry))]
    names = ["doc_id", "ids", "n_pieces", "n_byte_pieces", "ids_crc32", "decoded", "round_trip", "n_different", *[x.name for x in carried]]
    schema = f"doc_id {given.schema['id'].dataType.simpleString()}, ids array<int>, n_pieces long, n_byte_pieces long, ids_crc32 long, decoded string, round_trip boolean, n_different long"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        is_byte = np.array([kind == BYTE for _, _, kind in own.model.pieces])
        for batch in batches:
            for part in slices(batch):
                texts = part.column(1).to_pylist()
                ids, offsets, wrong = own.encode(texts)
                runs = [ids[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]
                decoded = [own.decode(x) for x in runs]
                bytes_before = np.concatenate([[0], np.cumsum(is_byte[ids])])[offsets]
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.view(np.int32)))
                crc = pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in runs], pa.int64())
                same = pa.array([d == (t or "") for d, t in zip(decoded, texts, strict=True)])
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(np.diff(offsets)), pa.array(np.diff(bytes_before)), crc, pa.array(decoded, pa.string()), same, pa.array(wrong), *part.columns[2:]], names)

    found = given.select("id", "text", *[x.name for x in carried]).mapInArrow(encode, ", ".join([schema, *[f"{x.name} {x.dataType.simpleString()}" for x in carried]]))
    return found.select(*names[:8], *[F.col(x.name).alias(c) for x, c in zip(carried, carry, strict=True)])


def slices(batch: pa.RecordBatch, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of about `most` bytes of text (the second column)."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // most
    cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)
    released()
