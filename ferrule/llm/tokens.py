"""Exact ids of whole texts, many texts at a time, from a vocabulary file of the tokenizers library.

A byte-pair vocabulary whose pre-tokenizer never lets a token cross white space can be applied word by
word. Arrow splits a batch of texts and finds its distinct words; a worker keeps the ids of the words it
has met in flat arrays of bounded size, so that only new words meet the library, and NumPy lays the ids
out again in text order. Any other vocabulary file goes through ``encode_batch``.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

VOCAB = "word_bpe_49k.json"
#: Words and pieces whose ids a worker keeps (about 30 and 250 bytes each); it starts anew beyond them.
CACHE_WORDS, CACHE_PIECES = 800_000, 150_000
#: UTF-8 bytes of text that are laid out at once; a single longer text is taken alone.
CHUNK_BYTES = 6_000_000

_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words of these characters alone need no normalisation but lower case, and their pieces are plain runs.
_SAFE = "^[!-&(-;=-~ß-öø-ÿÀ-ÖØ-Þ]+$"
_PIECE = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|\n|[^a-zß-öø-ÿ0-9\n]+")


def vocab_path(vocab: str = VOCAB) -> str:
    if os.path.sep in vocab:
        return vocab
    import public_tokenizers

    return public_tokenizers.path(vocab)


def _byte_chars() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Encoder:
    """Ids of texts. One per worker process, by ``encoder()``."""

    def __init__(self, vocab: str = VOCAB):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        path = vocab_path(vocab)
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.cache: dict[str, tuple[int, ...]] = {}
        self._forget()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_word = _splits_at_space(spec)
        stand_in = _byte_chars()
        self.table = {c: "".join(stand_in[b] for b in chr(c).encode()) for c in range(128, 256)}

    def _forget(self) -> None:
        self.known, self.lengths, self.starts, self.flat = pa.array([], pa.large_string()), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.uint32)

    def _learn(self, words: pa.Array) -> np.ndarray:
        """Where each of these distinct words stands among the known ones, after adding the new ones."""
        if len(self.known) > CACHE_WORDS:
            self._forget()
        if len(self.cache) > CACHE_PIECES:
            self.cache.clear()
        place = pc.index_in(words, self.known)
        new = words.filter(pc.is_null(place))
        lengths, ids = self._words(new)
        ends = len(self.flat) + np.cumsum(lengths, dtype=np.int64)
        self.flat = np.concatenate([self.flat, ids])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.starts = np.concatenate([self.starts, (ends - lengths).astype(np.int32)])
        out = pc.fill_null(place, -1).to_numpy(zero_copy_only=False).copy()
        out[out < 0] = len(self.known) + np.arange(len(lengths))
        self.known = pa.concat_arrays([self.known, new])
        return out

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and ids of words without ASCII white space."""
        safe = pc.match_substring_regex(words, _SAFE).to_numpy(zero_copy_only=False)
        pieces = _PIECE.findall("\n".join(words.filter(pa.array(safe)).to_pylist()).lower())
        cache = self.cache
        for piece in set(pieces).difference(cache):
            cache[piece] = tuple(t.id for t in self.model.tokenize(piece if piece.isascii() else piece.translate(self.table)))
        cache["\n"] = ()
        ids = list(map(cache.__getitem__, pieces))
        n = np.fromiter(map(len, ids), np.int32, len(ids))
        if safe.all() and len(safe):
            end = np.fromiter(map("\n".__eq__, pieces), bool, len(ids))
            return np.diff(np.cumsum(n)[np.append(np.flatnonzero(end), len(ids) - 1)], prepend=0).astype(np.int32), np.fromiter(chain.from_iterable(ids), np.uint32, int(n.sum()))
        end = [-1, *(k for k, x in enumerate(pieces) if x == "\n"), len(pieces)]
        word, each = 0, []
        for ok, text in zip(safe.tolist(), words.to_pylist(), strict=True):
            if ok:
                each.append(tuple(chain.from_iterable(ids[end[word] + 1 : end[word + 1]])))
                word += 1
            else:
                each.append(tuple(self.tokenizer.encode(text, add_special_tokens=False).ids) if text else ())
        n = np.fromiter(map(len, each), np.int32, len(each))
        return n, np.fromiter(chain.from_iterable(each), np.uint32, int(n.sum()))

    def texts(self, texts: pa.Array, end_id: int | None = None):
        """For each run of consecutive texts: (their number, offsets int64, ids uint32); null counts as empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        at = 0
        while at < len(texts):
            upto = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:]), CHUNK_BYTES, side="right")) + at)
            part = texts.slice(at, upto - at)
            yield (upto - at, *(self._by_word(part, end_id) if self.by_word else self._whole(part, end_id)))
            at = upto
        pa.default_memory_pool().release_unused()

    def _whole(self, texts: pa.Array, end_id: int | None):
        end = () if end_id is None else (end_id,)
        ids = [(*e.ids, *end) for e in self.tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)]
        offsets = np.zeros(len(ids) + 1, np.int64)
        np.cumsum([len(x) for x in ids], out=offsets[1:])
        return offsets, np.fromiter(chain.from_iterable(ids), np.uint32, offsets[-1])

    def _by_word(self, texts: pa.Array, end_id: int | None):
        words = pc.ascii_split_whitespace(texts)
        bounds = words.offsets.to_numpy() - words.offsets[0].as_py()
        coded = words.flatten().dictionary_encode()
        codes = self._learn(coded.dictionary)[coded.indices.to_numpy()]
        lengths, starts, flat = self.lengths, self.starts, self.flat
        if end_id is not None:
            codes = np.insert(codes, bounds[1:], len(lengths))
            bounds = bounds + np.arange(len(bounds))
            lengths, starts, flat = np.append(lengths, np.int32(1)), np.append(starts, np.int32(len(flat))), np.append(flat, np.uint32(end_id))
        n = lengths[codes]
        ends = np.cumsum(n, dtype=np.int64)
        where = np.repeat((starts[codes] - (ends - n)).astype(np.int32), n)
        where += np.arange(len(where), dtype=np.int32)
        return np.concatenate([[0], ends])[bounds], flat[where]


def _splits_at_space(spec: dict) -> bool:
    steps = spec.get("normalizer") or {}
    kinds = [x.get("type") for x in steps.get("normalizers", [steps])]
    before = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    return (
        kinds == ["NFC", "Replace", "Lowercase"]
        and before[0].get("pattern") == {"Regex": _SPLIT}
        and before[0].get("behavior") == "Removed"
        and [x.get("type") for x in before] == ["Split", "ByteLevel"]
        and spec["model"].get("type") == "BPE"
        and not any(x.get("lstrip") or x.get("rstrip") or "<" not in x["content"] for x in spec.get("added_tokens", []))
    )


_ENCODERS: dict[str, Encoder] = {}


def encoder(vocab: str = VOCAB) -> Encoder:
    if vocab not in _ENCODERS:
        _ENCODERS[vocab] = Encoder(vocab)
    return _ENCODERS[vocab]
