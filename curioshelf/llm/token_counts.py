"""Token counts without encoding: most words are known to be one token each.

Byte-pair merges work inside one pre-token, so how a pre-token is encoded does not depend on what
stands around it.  Before any text is read, each string of the vocabulary is encoded by itself;
where that gives just its own id, the string is a whole token wherever it stands as a pre-token.
A text is then normalized and cut into pre-tokens, whole tokens are counted as they are, and only
distinct other pre-tokens are merged by the library, once in each worker.

Texts of letters up to U+024F are cut by one pattern.  Its character classes are asked from the
tokenizer itself.  Other texts are normalized and cut by the library's own parts, and texts that
hold a special string are encoded by it as a whole.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curioshelf.llm.shingles import slices

LIMIT = 2048
CACHED = 500_000
RUN = 512
# Characters up to here, but the dotted capital I, are not changed by composition, and each is
# lowered to one character.
PLAIN_END = 0x250
_BEYOND = re.compile("[^\x00-įı-ɏ]")
# The endings that the tokenizer cuts off as pre-tokens of their own.
ENDINGS = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d"]
SPLIT = "|".join(ENDINGS) + r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def whole_tokens(path: str) -> list[str]:
    """The strings of the vocabulary, as pre-tokens, that the merges turn into one token: proved by
    encoding each by itself.  There are no more than the vocabulary has, so they fit anywhere."""
    tokenizer = _load(path)
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    suffix = getattr(tokenizer.model, "end_of_word_suffix", None) or ""
    names = [(v, i) for v, i in tokenizer.get_vocab().items() if v not in special and v.endswith(suffix)]
    pieces = [v[: len(v) - len(suffix)] for v, _ in names]
    return [p for p, (_, i) in zip(pieces, names, strict=True) if p and [t.id for t in tokenizer.model.tokenize(p)] == [i]]


def _bytes_as_letters() -> dict[int, str]:
    """The letters by which a byte-level tokenizer names bytes: printable ones are themselves, the
    others follow from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + n) for n, b in enumerate(others)}


class Counting:
    """Token counts of texts: the same as ``len(Tokenizer.encode(text, add_special_tokens=False).ids)``."""

    def __init__(self, path: str, whole: Iterable[str]):
        import json

        self.tokenizer = _load(path)
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.normalize = self.tokenizer.normalizer.normalize_str if self.tokenizer.normalizer else str
        # Without a cut into pre-tokens there is nothing to count one by one.
        self.cuts = parts["model"]["type"] == "BPE" and self.tokenizer.pre_tokenizer is not None and not parts.get("post_processor")
        self.one = dict.fromkeys(whole) if self.cuts else {}
        self.rest: dict[str, int] = {}
        self.plain, self.plain_rest = {}, {}
        self.find = self._pattern(parts) if self.cuts else None
        if self.find:
            raw = {letter: b for b, letter in _bytes_as_letters().items()}
            spelled = {}
            for w in self.one:
                try:
                    spelled[bytes([raw[c] for c in w]).decode()] = None
                except (KeyError, UnicodeDecodeError):
                    pass  # not a text by itself, so no pre-token of a text is it
            self.plain = spelled
            vocabulary, suffix = self.tokenizer.get_vocab(), self.tokenizer.model.end_of_word_suffix
            self.ends = None
            if suffix:
                self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
                self.ends[[i for v, i in vocabulary.items() if v.endswith(suffix)]] = True

    def _pattern(self, parts: dict):
        """``findall`` of pre-tokens for texts of plain characters, or None for a tokenizer that cuts
        in another way."""
        cut, normal = parts["pre_tokenizer"], parts["normalizer"] or {}
        steps = cut.get("pretokenizers", [])
        known = (
            [s["type"] for s in steps] == ["Split", "ByteLevel"]
            and steps[0]["pattern"].get("Regex") == SPLIT
            and (steps[0]["behavior"], steps[0]["invert"]) == ("Removed", True)
            and not steps[1]["add_prefix_space"]
            and not steps[1].get("use_regex", True)
            and [n["type"] for n in normal.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        )
        if not known:
            return None
        pieces = self.tokenizer.pre_tokenizer.pre_tokenize_str
        classes: dict[str, list[str]] = {"letter": [], "number": [], "sign": []}
        for c in map(chr, range(PLAIN_END)):
            if pieces(c):
                kind = "letter" if len(pieces("a" + c)) == 1 else "sign" if len(pieces("!" + c)) == 1 else "number"
                classes[kind].append(c)
        letter, number, sign = ("[" + "".join(map(re.escape, classes[k])) + "]" for k in ("letter", "number", "sign"))
        return re.compile("|".join(ENDINGS) + f"|{letter}+|{number}|{sign}+").findall

    def _learn(self, cuts: list[Counter], whole: dict[str, None], rest: dict[str, int], count) -> None:
        """Has the pre-tokens that are no whole tokens merged, each once."""
        others = set().union(*cuts) - whole.keys()
        new = others - rest.keys()
        if new:
            if len(rest) > CACHED:
                rest.clear()
                new = others
            names = list(new)
            rest.update(zip(names, count(names), strict=True))

    def _encoded(self, words: list[str]) -> list[int]:
        """Merged in joined runs, for speed: the last token of a pre-token, and no other, has an end mark."""
        runs = [words[i : i + RUN] for i in range(0, len(words), RUN)] if self.ends is not None else [[w] for w in words]
        counts: list[int] = []
        for run, got in zip(runs, self.tokenizer.encode_batch_fast([" ".join(r) for r in runs], add_special_tokens=False), strict=True):
            if len(run) > 1:
                ends = np.flatnonzero(self.ends[np.array(got.ids, np.int64)])
                if len(ends) == len(run):
                    counts += np.diff(ends, prepend=-1).tolist()
                else:
                    counts += [len(e.ids) for e in self.tokenizer.encode_batch_fast(run, add_special_tokens=False)]
            else:
                counts.append(len(got.ids))
        return counts

    def _tokenized(self, pieces: list[str]) -> list[int]:
        return [len(self.tokenizer.model.tokenize(p)) for p in pieces]

    def counts(self, texts: list[str]) -> list[int]:
        """Number of tokens of each text."""
        found: list[int] = [0] * len(texts)
        plain, other = [], []
        for n, text in enumerate(texts):
            if not self.cuts or any(s in text for s in self.special):
                found[n] = len(self.tokenizer.encode(text, add_special_tokens=False).ids)
            elif self.find and not _BEYOND.search(text):
                plain.append((n, Counter(self.find(text.lower()))))
            else:
                normal = self.normalize(text)
                if any(s in normal for s in self.special):
                    found[n] = len(self.tokenizer.encode(text, add_special_tokens=False).ids)
                else:
                    other.append((n, Counter(piece for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal))))
        for cuts, whole, rest, count in ((plain, self.plain, self.plain_rest, self._encoded), (other, self.one, self.rest, self._tokenized)):
            self._learn([cut for _, cut in cuts], whole, rest, count)
            for n, cut in cuts:
                # One for each whole token, and what the merges leave for each other pre-token.
                found[n] = cut.total() + sum((rest[w] - 1) * cut[w] for w in cut if w not in whole)
        return found


@lru_cache(maxsize=2)
def _counting(path: str, whole: tuple[str, ...]) -> Counting:
    return Counting(path, whole)


def token_counts(documents: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """Number of tokens of each of ``documents`` (doc_id, text) by the tokenizer file ``path``.

    Returns doc_id, n_bytes (of UTF-8), n_tokens, over_limit (more tokens than ``limit``).  Begin,
    end and other special tokens are not added; special strings inside texts are what the library
    takes them for.  Null texts are empty and have no tokens.  Each row gives a row: null and
    repeated doc_ids too; an empty table gives none.  A very long text is cut at once, but only its
    distinct pre-tokens are kept.  Other columns are not looked at.  Nothing is shuffled.
    """
    whole = tuple(whole_tokens(path))  # at most the vocabulary

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counting = _counting(path, whole)
        for batch in slices(batches):
            counts = pa.array(counting.counts(batch.column(1).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), counts], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce("text", F.lit(""))
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    counted = rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
