"""Token ids by a public tokenizer: the library's own ids, each distinct plain word encoded once.

Texts are cut into words, and words are looked up, by array operations on their bytes; Python sees
a word when it is new to the worker."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from curioshelf.llm.shingles import chunks

# Letters are one unit to the tokenizer wherever they stand, and so are signs other than the
# apostrophe; the last piece of a unit, and no other, ends in ``</w>``.
_PLAIN = re.compile(r"([a-zß-öø-ÿ]*)([!-&(-/:-@\[-`{-~]*)")
# Marks that a letter may be composed with.  The tokenizer composes before it lowers, and some small
# letters have a composed form where the capital has none: words with a mark are left as they are.
_MARK = re.compile("[\u0300-\u036f]")
# Only A-Z is lowered, and only \n and space part words: the tokenizer sees to the rest.
_LOWER = bytes([32 if c == 10 else c + 32 if 65 <= c <= 90 else c for c in range(256)])
# Kinds of bytes: 1 a-z, 2 signs as above, 3 space.  Signs that follow a letter are cut off, so that
# a word is known whatever follows it.
_KINDS = bytes([1 if 97 <= c <= 122 else 3 if c == 32 else 2 if 32 < c < 127 and c != 39 and not chr(c).isalnum() else 0 for c in range(256)])
_U = np.uint64
_PARTS = 4  # 8 bytes each; the last byte holds the length of the word
_SPREAD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], _U)
CACHED_WORDS = 1_000_000
RUN = 512
RUN_BYTES = 1 << 22


def runs(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(first row, rows) of runs of rows with about RUN_BYTES of text: one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + RUN_BYTES, "right")))
        yield at, to - at
        at = to


def _in_bytes(text: str) -> str:
    """The characters that stand for the bytes of plain units, as the byte-level cut has them: three
    of the second bytes of plain letters are not printed."""
    if text.isascii():
        return text
    return text.encode().decode("latin-1").replace("\x9f", "\u0141").replace("\xa0", "\u0142").replace("\xad", "\u0143")


def _room(array: np.ndarray, n: int) -> np.ndarray:
    """The array with room for ``n`` elements, and for half as many again if it grows."""
    if n <= len(array):
        return array
    out = np.zeros((n * 3 // 2, *array.shape[1:]), array.dtype)
    out[: len(array)] = array
    return out


class _Words:
    """Places of words of up to 31 bytes, which are told apart by all their bytes."""

    def __init__(self):
        self.parts, self.n = np.zeros((1024, _PARTS), _U), 0
        self.slots = np.full(4096, -1, np.int32)

    def _slot(self, mixed: np.ndarray) -> np.ndarray:
        return (mixed >> _U(65 - len(self.slots).bit_length())).astype(np.int64)

    @staticmethod
    def _mixed(parts: np.ndarray) -> np.ndarray:
        mixed = parts[:, 0] * _SPREAD[0]
        for k in range(1, _PARTS):
            mixed += parts[:, k] * _SPREAD[k]
        return (mixed ^ (mixed >> _U(32))) * _SPREAD[0]

    def find(self, parts: np.ndarray) -> np.ndarray:
        """The place of each word, -1 if it has none."""
        out = np.full(len(parts), -1, np.int32)
        at, slot, last = None, self._slot(self._mixed(parts)), len(self.slots) - 1
        while len(slot):
            held = self.slots.take(slot)
            same = (self.parts.take(held, axis=0, mode="clip") == parts).view(np.uint32)[:, 0] == 0x01010101
            free = held < 0
            same &= ~free
            if at is None:
                np.copyto(out, held, where=same)
            else:
                out[at[same]] = held[same]
            left = np.flatnonzero(~(same | free))
            at, slot, parts = left if at is None else at[left], (slot[left] + 1) & last, parts[left]
        return out

    def add(self, parts: np.ndarray, places: np.ndarray) -> None:
        """Gives distinct new words their places, which are above all places given before."""
        self.n = int(places[-1]) + 1
        self.parts = _room(self.parts, self.n)
        self.parts[places] = parts
        if 2 * self.n > len(self.slots):
            self.slots = np.full(1 << (3 * self.n).bit_length(), -1, np.int32)
            places = np.flatnonzero(self.parts[: self.n, -1])
        place, slot = places.astype(np.int32), self._slot(self._mixed(self.parts[places]))
        while len(place):
            free = self.slots.take(slot) < 0
            self.slots[slot[free]] = place[free]
            left = np.flatnonzero(self.slots.take(slot) != place)
            place, slot = place[left], (slot[left] + 1) & (len(self.slots) - 1)


def _cut(low: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the words of rows of lowered bytes."""
    kind = np.frombuffer(low.translate(_KINDS), np.uint8)
    inside = kind != 3
    edge = np.zeros(len(low) + 1, bool)
    edge[offsets] = True
    edge[1:-1] |= (kind[:-1] == 1) & (kind[1:] == 2)
    edge[1:-1] |= inside[1:] != inside[:-1]
    edge[0] = edge[-1] = True
    at = np.flatnonzero(edge)
    own = inside.take(at[:-1])
    return at[:-1][own], at[1:][own]


def _parts(low: bytes, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of each word of up to 31 bytes, and its length, as numbers."""
    wide = -(-len(low) // 8) + _PARTS
    padded = low + bytes(8 * (wide + 1) - len(low))
    shifted = np.stack([np.frombuffer(padded, "<u8", wide, k) for k in range(8)])
    first = (starts & 7) * wide + (starts >> 3)
    parts = np.zeros((len(starts), _PARTS), _U)
    at = None
    for k in range(_PARTS):
        if k:
            at = np.flatnonzero(sizes > 8 * k)
        left = np.minimum((sizes if at is None else sizes[at]) - 8 * k, 8)
        found = shifted.take((first if at is None else first[at]) + k) & (~_U(0) >> (64 - 8 * left).astype(_U))
        if at is None:
            parts[:, k] = found
        else:
            parts[at, k] = found
    parts[:, -1] |= sizes.astype(_U) << _U(56)
    return parts


class WordTokenizer:
    """Ids of texts, the same as ``Tokenizer.encode(text, add_special_tokens=False)`` of a lower-case
    word tokenizer whose last piece of a word ends in ``</w>``."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.plain = self._for_plain_units()
        self._reset()

    def _for_plain_units(self):
        """The library's tokenizer with the same merges, but cutting at spaces alone and changing no
        letter: all that is left to do for units of lower-case letters or of signs.  It is given the
        characters that stand for bytes, and keeps no words, as each comes once."""
        from tokenizers import Tokenizer, models, pre_tokenizers

        parts = json.loads(self.tokenizer.to_str())
        steps, model = (parts["pre_tokenizer"] or {}).get("pretokenizers", []), parts["model"]
        if [s["type"] for s in steps] != ["Split", "ByteLevel"] or steps[1]["add_prefix_space"] or steps[1].get("use_regex", True) or model["type"] != "BPE":
            return None
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        options = {k: v for k, v in model.items() if k not in ("type", "vocab", "merges") and v is not None}
        plain = Tokenizer(models.BPE(vocab=model["vocab"], merges=merges, cache_capacity=0, **options))
        plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        return plain

    def _reset(self) -> None:
        self.words = _Words()
        self.long: dict[bytes, int] = {}  # places of longer words
        # Ids of all words, and of each place where they start and how many they are.
        self.flat, self.starts, self.sizes = np.zeros(1 << 12, np.int32), np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int64)
        self.ids, self.known = 0, 0

    @property
    def places(self) -> dict[bytes, int]:
        """The words of the cache and their places in it."""
        parts = self.words.parts[: self.words.n].astype("<u8")
        short = ((row.tobytes(), place) for place, row in enumerate(parts))
        return {**{w[: w[-1]]: place for w, place in short if w[-1]}, **self.long}

    def _learn(self, words: list[bytes]) -> dict[bytes, int]:
        """Adds words to the cache: the place of each."""
        plain, units, rest = [], [], []
        match = _PLAIN.fullmatch
        for w in words:
            found = match(w.decode("utf-8", "surrogatepass"))
            if found is None or not w or self.plain is None:
                rest.append(w)
            else:
                plain.append(w)
                units.append(found.groups())
        ids, sizes, names = [], [], []
        firsts = range(0, len(plain), RUN)
        joined = [" ".join([f"{a} {b}" if a and b else a or b for a, b in units[i : i + RUN]]) for i in firsts]
        joined = [_in_bytes(j) for j in joined]
        for i, got in zip(firsts, self.plain.encode_batch_fast(joined, add_special_tokens=False) if joined else [], strict=True):
            found = np.array(got.ids, np.int32)
            ends = np.flatnonzero(self.ends[found])
            last = np.cumsum([2 if a and b else 1 for a, b in units[i : i + RUN]])
            if len(ends) == last[-1]:
                ids.append(found)
                sizes.append(np.diff(np.concatenate(([-1], ends[last - 1]))))
                names += plain[i : i + RUN]
            else:
                rest += plain[i : i + RUN]
        texts = [w.decode("utf-8", "surrogatepass") for w in rest]
        for w, got in zip(rest, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids.append(np.array(got.ids, np.int32))
            sizes.append(np.array([len(got.ids)]))
            names.append(w)
        new, size, first, start = np.concatenate(ids), np.concatenate(sizes), self.known, self.ids
        self.known, self.ids = first + len(size), start + len(new)
        self.flat, self.starts, self.sizes = _room(self.flat, self.ids), _room(self.starts, self.known), _room(self.sizes, self.known)
        self.flat[start : self.ids] = new
        self.sizes[first : self.known] = size
        self.starts[first : self.known] = start + np.cumsum(size) - size
        return dict(zip(names, range(first, self.known), strict=True))

    def _lowered(self, data: np.ndarray, offsets: np.ndarray) -> bytes:
        raw = data.tobytes()
        low = raw.translate(_LOWER)
        if b"\xcc" not in raw and b"\xcd" not in raw:  # lead bytes of all combining marks that may follow A-Z
            return low
        raw, texts = raw.replace(b"\n", b" "), []
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            both = zip(raw[a:b].split(b" "), low[a:b].split(b" "), strict=True)
            texts.append(b" ".join([w if _MARK.search(w.decode("utf-8", "surrogatepass")) else own for w, own in both]))
        return b"".join(texts)

    def _places(self, low: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Places in the cache of words, which it learns if they are new."""
        sizes = ends - starts
        whole = sizes < 8 * _PARTS
        longer = np.flatnonzero(~whole)
        short = np.flatnonzero(whole) if len(longer) else slice(None)
        parts = _parts(low, starts[short], sizes[short])
        found = self.words.find(parts)
        missed = np.flatnonzero(found < 0)
        new: dict[bytes, int] = {}
        for n, a, b in zip(missed.tolist(), starts[short][missed].tolist(), ends[short][missed].tolist(), strict=True):
            new.setdefault(low[a:b], n)
        names = [low[a:b] for a, b in zip(starts[longer].tolist(), ends[longer].tolist(), strict=True)]
        unknown = [w for w in dict.fromkeys(names) if w not in self.long]
        if new or unknown:
            places = self._learn([*new, *unknown])
            self.long.update((w, places.pop(w)) for w in unknown)
            if new:
                self.words.add(parts[[new[w] for w in places]], np.array([*places.values()], np.int64))
                found[missed] = self.words.find(parts[missed])
        out = np.empty(len(starts), np.int64)
        out[short] = found
        out[longer] = [self.long[w] for w in names]
        return out

    def _look_up(self, texts: pa.Array | list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], dict[int, np.ndarray]]:
        """(by run of texts, places in the cache of all words and number of words before each text;
        ids of texts that only the library can encode, by number).  Those have no words."""
        if not isinstance(texts, pa.Array):
            texts = pa.array([t.encode("utf-8", "surrogatepass") for t in texts], pa.large_binary())
        texts, whole, found = texts.cast(pa.large_binary()), {}, []
        odd = np.zeros(len(texts), bool)
        for start in {s[:2].lower() for s in self.specials}:
            odd |= pc.fill_null(pc.match_substring(texts, start), False).to_numpy(zero_copy_only=False)
        for n in np.flatnonzero(odd).tolist():
            text = texts[n].as_py().decode("utf-8", "surrogatepass")
            whole[n] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)
        if whole:
            texts = pc.if_else(pa.array(odd), pa.scalar(b"", pa.large_binary()), texts)
        if self.known > CACHED_WORDS:
            self._reset()
        for _, _, data, offsets in chunks(texts):
            low = self._lowered(data, offsets)
            starts, ends = _cut(low, offsets)
            places = self._places(low, starts, ends) if len(starts) else np.zeros(0, np.int64)
            found.append((places, np.searchsorted(starts, offsets)))
        return found, whole

    def encode(self, texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids of each text)."""
        found, whole = self._look_up(texts)
        parts, counts = [self.flat[:0]], [np.zeros(0, np.int64)]
        for at, before in found:
            starts, sizes = self.starts.take(at), self.sizes.take(at)
            ends = np.concatenate(([0], np.cumsum(sizes)))
            parts.append(self.flat.take(np.arange(ends[-1]) + np.repeat(starts - ends[:-1], sizes)))
            counts.append(np.diff(ends[before]))
        ids, sizes = np.concatenate(parts), np.concatenate(counts)
        if not whole:
            return ids, sizes
        ends = np.cumsum(sizes)
        parts = [whole[n] if n in whole else ids[ends[n] - sizes[n] : ends[n]] for n in range(len(sizes))]
        return np.concatenate(parts), np.array([len(p) for p in parts])

    def lengths(self, texts: pa.Array | list[str]) -> np.ndarray:
        """Number of ids of each text, as ``encode`` gives them."""
        found, whole = self._look_up(texts)
        out = [np.zeros(0, np.int64)]
        for at, before in found:
            out.append(np.diff(np.concatenate(([0], np.cumsum(self.sizes.take(at))))[before]))
        out = np.concatenate(out)
        for n, ids in whole.items():
            out[n] = len(ids)
        return out


@lru_cache(maxsize=4)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)
