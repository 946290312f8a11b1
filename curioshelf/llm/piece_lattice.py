"""SentencePiece encoding by N-best search over the piece lattice, and decoding.

A text's lattice has an edge for every piece of the model that stands in it.  Forward Viterbi gives
the best score of reaching each place; these are exact heuristics for an A* search that walks back
from the end, so that paths come out best first and no path is finished that is not asked for.

A place where no piece of the model crosses cuts the lattice in two.  The search is done once for
each distinct run between cuts, and a text's N best paths are put together from those of its runs:
of the runs with other paths only the N - 1 that lose least can differ from their best path.

Characters without a piece of their own become byte pieces.  A space is written as U+2581, and one
is put before the text; a U+2581 in a text comes back as a space, as with the public library.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
N_BEST = 3
CACHED_RUNS = 800_000
CHUNK_CHARS = 1 << 18

Path = tuple[float, tuple[int, ...]]


class Lattice:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i) for i in range(size)]
        self.pieces = {model.id_to_piece(i): (i, model.get_score(i)) for i in range(size) if not special[i]}
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_score = min(s for _, s in self.pieces.values() if s > -1e8) - 1
        self.longest = max(map(len, self.pieces))
        self.raw = [b"" if s else model.id_to_piece(i).replace(SPACE, " ").encode() for i, s in enumerate(special)]
        for b, i in enumerate(self.bytes):
            self.raw[i] = bytes([b])
        # Which characters follow each other within a piece.
        met = {p[k : k + 2] for p in self.pieces for k in range(len(p) - 1)}
        letters = sorted({c for pair in met for c in pair})
        self.letter = np.zeros(0x110000, np.int16)
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.joined = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        for a, b in met:
            self.joined[self.letter[ord(a)], self.letter[ord(b)]] = True
        self._reset()

    def _reset(self) -> None:
        self.known: dict[str, int] = {}
        self.losses: list[tuple[float, ...]] = []  # of each run's paths, against the best
        self.flat, self.bounds = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.score, self.loss = np.zeros(0), np.zeros(0)

    def edges(self, run: str) -> list[list[tuple[int, float, tuple[int, ...]]]]:
        """For each place after the first, the edges that end there: start, score, ids."""
        into: list[list[tuple[int, float, tuple[int, ...]]]] = [[] for _ in range(len(run) + 1)]
        get, longest = self.pieces.get, self.longest
        for i in range(len(run)):
            if run[i] not in self.pieces:
                raw = run[i].encode("utf-8", "surrogatepass")
                into[i + 1].append((i, self.byte_score * len(raw), tuple(self.bytes[b] for b in raw)))
            for j in range(i + 1, min(i + longest, len(run)) + 1):
                piece = get(run[i:j])
                if piece is not None:
                    into[j].append((i, piece[1], (piece[0],)))
        return into

    def search(self, run: str, n: int) -> list[Path]:
        """The n best (score, ids) of a run, best first."""
        if len(run) == 1 and run in self.pieces:
            i, s = self.pieces[run]
            return [(s, (i,))]
        into = self.edges(run)
        # origin: the edge by which the best path comes to a place.  What it loses is nothing, also
        # where the difference of two sums of fractions would not be nothing.
        best, origin = [0.0], [0]
        for edges in into[1:]:
            totals = [best[i] + s for i, s, _ in edges]
            best.append(max(totals))
            origin.append(totals.index(best[-1]))
        # What is waiting, by what it loses against the best path.  The heuristic is exact, so each
        # stands for a whole path that loses just that, and no more than are asked for need wait.
        waiting: list[tuple] = [(0.0, 0, len(run), None)]
        out: list[Path] = []
        pushed = 0
        while waiting and len(out) < n:
            loss, _, j, link = waiting.pop(0)
            room = n - len(out) - 1
            while j:
                # On along the best edge, which loses nothing; the others wait.
                straight = origin[j]
                for k, (i, s, ids) in enumerate(into[j]):
                    if k == straight:
                        onward = (i, (ids, link))
                        continue
                    more = loss + max(best[j] - best[i] - s, 0.0)
                    if len(waiting) < room or (room and more < waiting[-1][0]):
                        pushed += 1
                        bisect.insort(waiting, (more, pushed, i, (ids, link)))
                        del waiting[room:]
                j, link = onward
            ids = []
            while link is not None:
                ids += link[0]
                link = link[1]
            out.append((best[-1] - loss, tuple(ids)))
        return out

    def runs(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """(runs of all texts, number of runs of each)."""
        whole = "".join([SPACE + t.replace(" ", SPACE) for t in texts if t])
        sizes = np.array([len(t) + 1 if t else 0 for t in texts])
        code = self.letter[np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)]
        cut = np.ones(len(whole) + 1, bool)
        cut[1:-1] = ~self.joined[code[:-1], code[1:]] if len(whole) else False
        ends = np.cumsum(sizes)
        cut[ends] = True
        places = np.flatnonzero(cut)
        at = places.tolist()
        found = [whole[i:j] for i, j in zip(at[:-1], at[1:], strict=True)] if len(whole) else []
        return found, np.diff(np.concatenate(([0], np.searchsorted(places, ends))))

    def learn(self, runs: Iterable[str]) -> None:
        ids, sizes, scores, losses = [], [], [], []
        for run in runs:
            paths = self.search(run, N_BEST)
            self.known[run] = len(self.losses)
            self.losses.append(tuple([p[0] - paths[0][0] for p in paths]))
            ids += paths[0][1]
            sizes.append(len(paths[0][1]))
            scores.append(paths[0][0])
            losses.append(paths[0][0] - paths[1][0] if len(paths) > 1 else np.inf)
        if sizes:
            self.flat = np.concatenate((self.flat, np.array(ids, np.int32)))
            self.bounds = np.concatenate((self.bounds, self.bounds[-1] + np.cumsum(sizes)))
            self.score = np.concatenate((self.score, scores))
            self.loss = np.concatenate((self.loss, losses))

    def encode(self, texts: list[str], n: int = N_BEST) -> Iterator[tuple[np.ndarray, list[float], list[dict[int, int]]]]:
        """For each text: ids of its best path, scores of its n best (at most N_BEST) paths, and for
        each of them which runs take which other path than their best."""
        runs, counts = self.runs(texts)
        if len(self.known) > CACHED_RUNS:
            self._reset()
        self.learn(r for r in set(runs) if r not in self.known)
        all_places = np.fromiter(map(self.known.__getitem__, runs), np.int64, len(runs))
        flat, bounds, score, loss = self.flat, self.bounds, self.score, self.loss
        ends = np.cumsum(counts)
        for a, b in zip(ends - counts, ends, strict=True):
            at = all_places[a:b]
            starts, sizes = bounds[at], bounds[at + 1] - bounds[at]
            before = np.cumsum(sizes) - sizes
            ids = flat[np.arange(sizes.sum()) + np.repeat(starts - before, sizes)] if len(at) else flat[:0]
            total, losses = float(score[at].sum()), loss[at]
            few = np.argsort(losses, kind="stable")[: n - 1] if len(at) <= 4 * n else np.argpartition(losses, n - 1)[: n - 1]
            best: list[tuple[float, dict[int, int]]] = [(total, {})]
            for k in sorted(few.tolist()):
                best = sorted(((s + more, c | ({k: m} if m else {})) for s, c in best for m, more in enumerate(self.losses[at[k]])), key=lambda x: -x[0])[:n]
            yield ids, [s for s, _ in best], [c for _, c in best]

    def n_best(self, text: str, n: int = N_BEST) -> list[Path]:
        """The n best (score, ids) of a text, n at most N_BEST; an empty text has one path without ids."""
        _, scores, changes = next(self.encode([text], n))
        runs, _ = self.runs([text])
        paths = [self.search(run, n) for run in runs]
        return [(s, tuple(i for k, p in enumerate(paths) for i in p[c.get(k, 0)][1])) for s, c in zip(scores, changes, strict=True)]

    def decode(self, ids: Iterable[int]) -> str:
        raw = b"".join(map(self.raw.__getitem__, ids))
        return raw.decode("utf-8", "replace").removeprefix(" ")


@lru_cache(maxsize=2)
def lattice(path: str) -> Lattice:
    return Lattice(path)


def _encode(path: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lattice(path)
        for batch in batches:
            docs, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            at = 0
            while at < len(texts):
                to, held = at, 0
                while to < len(texts) and (held < CHUNK_CHARS or to == at):
                    held += len(texts[to])
                    to += 1
                found = list(model.encode(texts[at:to]))
                ids = [f[0] for f in found]
                scores = [f[1] for f in found]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(i) for i in ids]))).astype(np.int32)), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([docs.slice(at, to - at), lists, pa.array(scores, pa.list_(pa.float64()))], ["doc_id", "ids", "scores"])
                at = to

    return run


def encode(documents: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, scores): ids of the best path of each text of ``documents`` (doc_id, text), and
    the scores of its N_BEST best paths, fewer if it has fewer.

    Null texts are empty: no ids, one score of 0.  Each repeated row is encoded; other columns are
    not looked at."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(_encode(path), f"doc_id {kind}, ids array<int>, scores array<double>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids are an empty text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lattice(path)
        for batch in batches:
            texts = [model.decode(i or ()) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def digests(documents: DataFrame, path: str) -> DataFrame:
    """What ``encode`` and ``decode`` make of each text, in one pass: doc_id, n_pieces, ids_crc32,
    score, next_score (null without a second path), round_trip."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lattice(path)
        for batch in batches:
            at = 0
            texts = batch.column(1).to_pylist()
            for part in _encode(path)([batch]):
                bounds, flat = part.column(1).offsets.to_numpy(), part.column(1).values.to_numpy()
                raw, listed = flat.astype("<u4"), flat.tolist()
                pairs = list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
                scores = part.column(2).to_pylist()
                same = [model.decode(listed[a:b]) == (texts[at + k] or "") for k, (a, b) in enumerate(pairs)]
                at += len(pairs)
                arrays = [
                    part.column(0),
                    pa.array([b - a for a, b in pairs], pa.int64()),
                    pa.array([zlib.crc32(raw[a:b]) for a, b in pairs], pa.int64()),
                    pa.array([s[0] for s in scores]),
                    pa.array([s[1] if len(s) > 1 else None for s in scores], pa.float64()),
                    pa.array(same, pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_pieces", "ids_crc32", "score", "next_score", "round_trip"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_pieces long, ids_crc32 long, score double, next_score double, round_trip boolean"
    return documents.select("doc_id", "text").mapInArrow(run, schema)
