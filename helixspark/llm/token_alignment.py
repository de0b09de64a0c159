"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text.

Both tokenizers run over each text, and groups and links are made by Spark's higher-order functions.  Byte offsets where tokens of
both end (``array_intersect`` of the end arrays) cut the tokens into groups; tokens of both sides in one group are linked.
An id pair's count is the number of documents that hold it linked.

Tokenising is done by stretch: between a non-space and a non-space character of the ranges in ``SAFE``, a single space
starts a new token in both tokenizers, whatever stands around it, so a text's tokens are those of its stretches one after
the other, and a worker need not encode a stretch again that it remembers.  (Vocabularies for which that does not hold are
recognised when they are loaded; texts are then one stretch.)

Which tokens share a group follows from where tokens end, not from their ids.  The ends of both sides are the shape of a
stretch; many stretches have one shape.  A task makes groups and links once a shape, of the tokens' places; ids are put into
these places for each stretch that it meets, and a document's groups are those of its stretches.

End, side and place of a token are packed into one long.  Sorting both sides' tokens and the common ends yields the groups
as runs, in time linear but for the sort.  Pair counts are joined to the links in two ways: the ``HOT_PAIRS`` most
frequent pairs are broadcast (their number bounds the table), and all others meet by a shuffle, in which no key can be hot.

Defined cases: texts that are null or empty, or that a tokenizer changes (its tokens' bytes are not those of a space and
the text), have no tokens: zeros, and an empty digest.  A null id is kept; rows that repeat an id are documents of their
own; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixspark.plans.scratch import keep

from .tables import slim

BLOCK_CHARS = 1_000_000
BATCH_ROWS = 500  # documents given to Python at a time
BLOCK_PARTS = 1 << 17  # stretches of the documents put together at a time, unless one has more
REMEMBERED = 150_000  # stretches that a task remembers
SHAPES = 60_000  # shapes that a task remembers
HOT_PAIRS = 65_536
PLACE_BITS = 32  # of a packed token: the side in the highest, then the place; all ones mark a common end
MARK = (1 << PLACE_BITS) - 1
SIDE = 1 << (PLACE_BITS - 1)

SAFE = "[!-~¡-ɏ]"
_BREAK = re.compile(f"(?<={SAFE}) (?={SAFE})")
_WHOLE = re.compile(f"{SAFE}(?:.*{SAFE})?", re.S)
_ODD = re.compile(f"[^ \n{SAFE[1:-1]}]")


@dataclass
class Tokenizers:
    """The two vocabulary files; the libraries are opened in each worker."""

    byte_level: str
    pieces: str

    def __post_init__(self):
        a, b = self._open()
        self.sizes = a.get_vocab_size(), b.get_piece_size()
        if max(self.sizes) >= 1 << 31:
            raise ValueError(f"ids must be below {1 << 31}")

    def _open(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        a = Tokenizer.from_file(self.byte_level)
        a.encode_special_tokens = True
        return a, sentencepiece.SentencePieceProcessor(model_file=self.pieces)

    def worker(self) -> _Worker:
        key = self.byte_level, self.pieces
        if key not in _WORKERS:
            _WORKERS.clear()
            _WORKERS[key] = _Worker(self)
        return _WORKERS[key]


class _Worker:
    """Both tokenizers of a Python worker, and the tokens of stretches it has seen."""

    def __init__(self, files: Tokenizers):
        self.a, self.b = files._open()
        byte_of = {c: b for b, c in _byte_letters().items()}
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for entry, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(byte_of[c] for c in entry) if all(c in byte_of for c in entry) else entry.encode()
        entries = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in entries]
        self.n_bytes = [np.array([len(x) for x in t], dtype=np.int64) for t in (self.bytes_a, self.bytes_b)]
        with open(files.byte_level, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        one_break = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
        self.splits = one_break and not any(re.search("[^▁]▁", p) for p in entries)
        #: ids of stretches by side, as :meth:`learn` met them; None where a tokenizer changes the text
        self.known: dict[str, tuple[np.ndarray, np.ndarray] | None] = {}

    def stretches(self, text: str) -> list[str]:
        if not self.splits:
            return [text]
        # of such a text every space is a break
        plain = not (text[:1] == " " or text[-1:] == " " or "  " in text or " \n" in text or "\n " in text or _ODD.search(text))
        return text.split(" ") if plain else _BREAK.split(text)

    def encoded(self, new: list[str]) -> Iterator[tuple[list[str], list[tuple[np.ndarray, np.ndarray]]]]:
        """(stretches, of each side their ids one after the other and how many each has), in other order and some thousands at
        a time.  A stretch that a tokenizer changes has none.

        Many are encoded in one call where they begin and end safely.
        """
        joined = [x for x in new if self.splits and _WHOLE.fullmatch(x)]
        runs = [joined[i : i + 256] for i in range(0, len(joined), 256)]
        if len(joined) < len(new):
            runs += [[x] for x in set(new).difference(joined)]
        for at in range(0, len(runs), 64):
            some = runs[at : at + 64]
            texts = [" ".join(run) for run in some]
            of_a = [e.ids for e in self.a.encode_batch_fast([" " + x for x in texts], add_special_tokens=False)]
            found = [x for run, text, *ids in zip(some, texts, of_a, self.b.encode(texts, num_threads=1), strict=True) for x in self._cut(run, (" " + text).encode(), ids)]
            sides = [(np.concatenate([f[side][0] for f in found]), np.concatenate([f[side][1] for f in found])) for side in (0, 1)]
            yield [x for run in some for x in run], sides

    def _cut(self, run: list[str], raw: bytes, ids: list[list[int]]) -> list[list[tuple[np.ndarray, np.ndarray]]]:
        """The tokens of a run of stretches, and of each of these alone where a tokenizer changes the run."""
        if any(b"".join(map(table.__getitem__, own)) != raw for table, own in zip((self.bytes_a, self.bytes_b), ids, strict=True)):
            if len(run) == 1:
                return [[(np.empty(0, dtype=np.int64), np.zeros(1, dtype=np.int64))] * 2]
            return [y for x in run for y in self._cut([x], (" " + x).encode(), [self.a.encode(" " + x, add_special_tokens=False).ids, self.b.encode(x)])]
        upto = np.cumsum([len(x) + 1 if x.isascii() else len(x.encode()) + 1 for x in run])
        cut = []
        for table, own in zip(self.n_bytes, ids, strict=True):
            own = np.array(own, dtype=np.int64)
            cut.append((own, np.diff(np.searchsorted(np.cumsum(table[own]), upto, side="right"), prepend=0)))
        return [cut]

    def learn(self, stretches: set[str]) -> None:
        """Have the tokens of the stretches in ``known``."""
        for some, sides in self.encoded(list(stretches - self.known.keys())):
            own = [np.split(ids, np.cumsum(n)[:-1]) for ids, n in sides]
            self.known.update((x, (a, b) if len(a) else None) for x, a, b in zip(some, *own, strict=True))

    def tokens(self, parts: list[str]) -> list[np.ndarray]:
        """Ids of both sides of successive stretches that were learnt; none if a tokenizer changes one of them."""
        found = [self.known[x] for x in parts]
        whole = all(f is not None for f in found)
        return [np.concatenate([np.empty(0, dtype=np.int64), *([f[side] for f in found] if whole else [])]) for side in (0, 1)]


_WORKERS: dict[tuple[str, str], _Worker] = {}


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


TOKENS = "number int, id long, parts array<int>, ends_a array<int>, ends_b array<int>, shapes array<int>, ids array<int>"
NAMES = [x.split()[0] for x in TOKENS.split(", ")]
LINKED = "id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<{}>"


def _lists(values: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(values))


class _Numbers:
    """Numbers of the stretches that a task remembers.

    Beyond ``most`` stretches, or 32 letters for each, those met in the fewest blocks since the last time are forgotten, and
    their numbers are given anew.
    """

    def __init__(self, most: int):
        self.most = most
        self.of: dict[str, int] = {}
        self.letters = 0
        self.free: list[int] = []
        self.met = np.zeros(0, dtype=np.int32)

    def give(self, new: list[str]) -> np.ndarray:
        n = len(new)
        reused = self.free[len(self.free) - min(n, len(self.free)) :]
        del self.free[len(self.free) - len(reused) :]
        numbers = reused + list(range(len(self.met), len(self.met) + n - len(reused)))
        self.met = np.concatenate([self.met, np.zeros(n - len(reused), dtype=np.int32)])
        self.of.update(zip(new, numbers, strict=True))
        self.letters += sum(map(len, new))
        return np.array(numbers, dtype=np.int32)

    def forget(self) -> None:
        if len(self.of) <= self.most and self.letters <= 32 * self.most:
            return
        stays = 2
        while stays < 64:
            kept = {x: i for x, i in self.of.items() if self.met[i] >= stays}
            letters = sum(map(len, kept))
            if len(kept) <= self.most // 2 and letters <= 16 * self.most:
                break
            stays *= 2
        else:
            kept, letters = {}, 0
        self.of, self.letters = kept, letters
        gone = np.ones(len(self.met), dtype=bool)
        gone[list(kept.values())] = False
        self.free = np.flatnonzero(gone).tolist()
        self.met[:] = 0


class _Shapes:
    """Numbers of the shapes that a task remembers.  Beyond ``most``, or 64 bytes for each, all are forgotten."""

    def __init__(self, n_bytes: list[np.ndarray], most: int):
        self.n_bytes, self.most = n_bytes, most
        self.of: dict[tuple, int] = {}
        self.bytes = 0

    def of_stretches(self, sides: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, list[list[np.ndarray]]]:
        """(number of each stretch's shape, the numbers that are new, of each side the ends of these)."""
        if len(self.of) > self.most or self.bytes > 64 * self.most:
            self.of, self.bytes = {}, 0
        ends, masks, brief = [], [], True
        for table, (ids, n) in zip(self.n_bytes, sides, strict=True):
            upto = np.concatenate([[0], np.cumsum(table[ids])])
            first = np.cumsum(n) - n
            own = (upto[1:] - np.repeat(upto[first], n)).astype(np.int32)
            # up to 63 bytes the bits at the ends are the shape
            mask = np.zeros(len(n), dtype=np.uint64)
            mask[n > 0] = np.bitwise_or.reduceat(np.uint64(1) << (own & 63).astype(np.uint64), first[n > 0]) if len(own) else 0
            brief = brief & (upto[first + n] - upto[first] < 64) & (np.bitwise_count(mask) == n)
            ends.append((own, first, n))
            masks.append(mask.tolist())
        keys = list(zip(*masks, strict=True))
        for i in np.flatnonzero(~brief).tolist():
            keys[i] = tuple(own[first[i] : first[i] + n[i]].tobytes() for own, first, n in ends)
            self.bytes += 0 if keys[i] in self.of else len(keys[i][0]) + len(keys[i][1])
        before, of = len(self.of), self.of
        numbers = np.array([of.setdefault(key, len(of)) for key in keys], dtype=np.int32)
        late = np.flatnonzero(numbers >= before)
        new, at = np.unique(numbers[late], return_index=True)
        return numbers, new, [[own[first[i] : first[i] + n[i]] for i in late[at].tolist()] for own, first, n in ends]


def tokenised(docs: DataFrame, files: Tokenizers, remembered: int = REMEMBERED) -> DataFrame:
    """Rows of shapes, of stretches and of documents, each before those that name it, of ``id, text``.

    A shape has a ``number`` and the byte offsets where its tokens end (``ends_a, ends_b``; none if a tokenizer changes the
    text).  A row of stretches has their numbers as ``parts``, their ``shapes`` and ``ids``: of each stretch those of a, then of b.  A
    document has ``id`` and ``parts``, the numbers of its stretches.  A number stands for the last shape, or stretch, that had
    it in the task; a task makes a row again only of what it has forgotten.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker, numbers = files.worker(), _Numbers(remembered)
        shapes = _Shapes(worker.n_bytes, SHAPES)
        held: list[tuple[int | None, str]] = []
        chars = 0
        for batch in batches:
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                held.append((i, text.as_py() or ""))
                chars += len(held[-1][1]) + 64
                if chars >= BLOCK_CHARS:
                    yield from block(worker, held, numbers, shapes)
                    held, chars = [], 0
        if held:
            yield from block(worker, held, numbers, shapes)

    def block(worker: _Worker, rows: list[tuple[int | None, str]], numbers: _Numbers, shapes: _Shapes) -> Iterator[pa.RecordBatch]:
        parts = [worker.stretches(text) if text else [] for _, text in rows]
        numbers.forget()
        for some, sides in worker.encoded(list(set().union(*parts).difference(numbers.of))):
            yield from stretch_rows(numbers.give(some), sides, shapes)
        lengths = np.array([len(own) for own in parts])
        flat = np.fromiter(map(numbers.of.__getitem__, chain.from_iterable(parts)), dtype=np.int32, count=lengths.sum())
        met = np.zeros(len(numbers.met), dtype=bool)
        met[flat] = True
        numbers.met += met
        yield rows_of(len(rows), id=pa.array([r[0] for r in rows], pa.int64()), parts=_lists(flat, lengths))

    def stretch_rows(number: np.ndarray, sides: list[tuple[np.ndarray, np.ndarray]], shapes: _Shapes) -> Iterator[pa.RecordBatch]:
        own, new, ends = shapes.of_stretches(sides)
        if len(new):
            of_side = [_lists(np.concatenate(x), np.array([len(y) for y in x])) for x in ends]
            yield rows_of(len(new), number=pa.array(new), ends_a=of_side[0], ends_b=of_side[1])
        (a, n_a), (b, n_b) = sides
        ids = np.empty(len(a) + len(b), dtype=np.int32)
        ids[np.arange(len(a)) + np.repeat(np.cumsum(n_b) - n_b, n_a)] = a
        ids[np.arange(len(b)) + np.repeat(np.cumsum(n_a), n_b)] = b
        yield rows_of(1, **{name: _lists(x, np.array([len(x)])) for name, x in (("parts", number), ("shapes", own), ("ids", ids))})

    def rows_of(n: int, **cols: pa.Array) -> pa.RecordBatch:
        kinds = {"number": pa.int32(), "id": pa.int64()}
        return pa.RecordBatch.from_arrays([cols[c] if c in cols else pa.nulls(n, kinds.get(c, pa.list_(pa.int32()))) for c in NAMES], NAMES)

    return docs.mapInArrow(run, TOKENS)


def _binaries(data: bytes | np.ndarray, ends: np.ndarray) -> pa.LargeBinaryArray:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(data)])


class _Assembler:
    """What a task keeps of the shapes, by number, and of the stretches, by number."""

    def __init__(self, size_b: int, own: np.dtype):
        self.size_b, self.own = size_b, own
        #: of a shape: its text with ``%d`` for ids, the places these are taken from, and its links' places
        self.shapes: list[tuple[bytes, np.ndarray, np.ndarray]] = []
        self.shape_counts = np.zeros((0, 3), dtype=np.int64)
        #: of a stretch: where its text, with a ``;`` behind, and its links are
        self.n = 0
        self.at = np.zeros(0, dtype=np.int64)
        self.counts = np.zeros((0, 3), dtype=np.int64)
        self.texts = self.links = pa.array([], pa.large_binary())

    def learn_shapes(self, rows: pa.RecordBatch) -> None:
        number = rows.column("number").to_numpy()
        self.shape_counts = _longer(self.shape_counts, int(number.max()) + 1)
        self.shapes += [None] * (len(self.shape_counts) - len(self.shapes))
        self.shape_counts[number] = np.stack([rows.column(c).to_numpy() for c in ("n_a", "n_b", "n_groups")], axis=1)
        flat, ends = zip(*[(np.array(x.flatten()), np.cumsum(x.value_lengths().to_numpy()).tolist()) for x in (rows.column("order"), rows.column("links"))], strict=True)
        a = b = 0
        for i, text, end_a, end_b in zip(number.tolist(), rows.column("text").to_pylist(), *ends, strict=True):
            self.shapes[i] = text.encode(), flat[0][a:end_a], flat[1][b:end_b]
            a, b = end_a, end_b

    def learn_stretches(self, number: np.ndarray, own: np.ndarray, ids: np.ndarray) -> None:
        """The stretches of these numbers and shapes, whose ids follow each other."""
        n = self.shape_counts[own]
        base = np.cumsum(n[:, 0] + n[:, 1]) - n[:, 0] - n[:, 1]
        used, own = np.unique(own, return_inverse=True)
        texts, order, links = zip(*[self.shapes[i] for i in used.tolist()], strict=True)

        def of_each(places: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """(places of each stretch's shape, where its ids begin, the places' ends)."""
            sizes = np.array([len(x) for x in places])
            first, size = (np.cumsum(sizes) - sizes)[own], sizes[own]
            ends = np.cumsum(size)
            return np.concatenate(places)[np.repeat(first - ends + size, size) + np.arange(ends[-1])], np.repeat(base, size), ends

        place, begin, _ = of_each(order)
        text = np.frombuffer(b"\n".join([*map(texts.__getitem__, own.tolist()), b""]) % tuple(ids[begin + place].tolist()), dtype=np.uint8)
        behind = text == ord("\n")
        place, begin, ends = of_each(links)
        pairs = ids[begin + (place >> (PLACE_BITS - 1))].astype(np.int64) * self.size_b + ids[begin + (place & (SIDE - 1))]
        self.counts = _longer(self.counts, int(number.max()) + 1)
        self.at = _longer(self.at, len(self.counts))
        self.counts[number] = n
        self.at[number] = np.arange(len(number)) + len(self.texts)
        self.texts = pa.concat_arrays([self.texts, _binaries(np.where(behind, np.uint8(ord(";")), text), np.flatnonzero(behind) + 1)])
        self.links = pa.concat_arrays([self.links, _binaries(pairs.astype(self.own), ends * self.own.itemsize)])
        self.n = max(self.n, int(number.max()) + 1)
        if len(self.texts) > 1.5 * self.n + 20_000:  # of numbers given anew the former stretches go
            self.texts, self.links = (x.take(pa.array(self.at[: self.n])) for x in (self.texts, self.links))
            self.at[: self.n] = np.arange(self.n)

    def documents(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        flat, lengths = rows.column("parts").flatten().to_numpy(), rows.column("parts").value_lengths().to_numpy()
        upto = np.concatenate([[0], np.cumsum(lengths)])
        a = 0
        while a < len(rows):
            b = max(a + 1, int(np.searchsorted(upto, upto[a] + BLOCK_PARTS, side="right")) - 1)
            yield self._documents(rows.column("id").slice(a, b - a), flat[upto[a] : upto[b]], upto[a : b + 1] - upto[a])
            a = b

    def _documents(self, ids: pa.Array, parts: np.ndarray, upto: np.ndarray) -> pa.RecordBatch:
        n, some = self.counts[parts], np.flatnonzero(upto[:-1] < upto[1:])
        sums, whole = np.zeros((len(ids), 3), dtype=np.int64), np.zeros(len(ids), dtype=bool)
        if len(some):
            sums[some] = np.add.reduceat(n, upto[some], axis=0)
            whole[some] = np.minimum.reduceat(n[:, 2], upto[some]) > 0  # else a tokenizer changes one of the stretches
        sums[~whole] = 0
        at = pa.array(self.at[parts])
        (text, to_text), (link, to_link) = (self._joined(x.take(at), upto) for x in (self.texts, self.links))
        digests, pairs = [""] * len(ids), np.frombuffer(link, dtype=self.own).copy()
        to_link //= self.own.itemsize
        for i in np.flatnonzero(whole).tolist():
            digests[i] = hashlib.sha256(text[to_text[i] : to_text[i + 1] - 1]).hexdigest()
            pairs[to_link[i] : to_link[i + 1]].sort()
        n_links = np.diff(to_link)
        pairs, n_links = pairs[np.repeat(whole, n_links)], n_links * whole
        cols = [ids, *[pa.array(sums[:, j]) for j in range(3)], pa.array(n_links), pa.array(digests), _lists(pairs, n_links)]
        return pa.RecordBatch.from_arrays(cols, ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"])

    @staticmethod
    def _joined(each: pa.LargeBinaryArray, upto: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """(the values one behind the other, where those of each document begin and the end)."""
        ends = np.frombuffer(each.buffers()[1], dtype=np.int64)[: len(each) + 1] if len(each) else np.zeros(1, dtype=np.int64)
        return memoryview(each.buffers()[2] or b"")[: ends[-1]], ends[upto]


def _longer(x: np.ndarray, n: int) -> np.ndarray:
    """At least ``n`` long, with zeros behind; room is doubled."""
    return x if len(x) >= n else np.concatenate([x, np.zeros((max(n, 2 * len(x)) - len(x), *x.shape[1:]), dtype=x.dtype)])


def assembled(each: DataFrame, size_b: int, kind: str) -> DataFrame:
    """The documents of ``number, id, parts, shapes, ids, n_a, n_b, n_groups, text, order, links``, in which rows stand as in :func:`tokenised`.

    ``text``, ``order`` and ``links`` are the shapes'.  Both tokenizers end a token with each stretch, so a document's groups
    are those of its stretches one after the other.  No shuffle lies between, so rows come in the order in which the task
    made them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Assembler(size_b, np.dtype(np.int32 if kind == "int" else np.int64))
        for batch in batches:
            of_shape, of_stretches = (batch.column(c).is_valid().to_numpy(zero_copy_only=False) for c in ("number", "shapes"))
            role = of_shape * 2 + of_stretches
            cuts = [0, *(np.flatnonzero(role[1:] != role[:-1]) + 1).tolist(), len(batch)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                rows = batch.slice(a, b - a)
                if of_shape[a]:
                    known.learn_shapes(rows)
                elif of_stretches[a]:
                    for i in range(len(rows)):
                        known.learn_stretches(*[rows.column(c)[i].values.to_numpy() for c in ("parts", "shapes", "ids")])
                else:
                    yield from known.documents(rows)

    return each.mapInArrow(run, LINKED.format(kind))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def groups(stream: str) -> Column:
    """The groups of a sorted stream of packed tokens and marks as ``text`` (``%d`` for ids), ``order`` (the places of these) and
    ``links`` (place in a * ``SIDE`` + place in b)."""
    place = lambda x: x.bitwiseAND(F.lit(SIDE - 1))
    is_a = lambda x: x.bitwiseAND(F.lit(SIDE)) == 0
    link = lambda x, y: place(x) * F.lit(SIDE) + place(y)

    def group(text: Column, order: Column, links: Column) -> Column:
        return F.struct(text.alias("text"), order.alias("order"), links.alias("links"))

    tokens = F.col(stream)

    def between(first: Column, mark: Column) -> Column:
        """The group of the tokens from ``first`` up to the place of a mark; most have two or three tokens."""
        x, y, z = tokens[first], tokens[first + 1], tokens[first + 2]
        two = group(F.lit("%d|%d"), F.array(place(x), place(y)), F.array(link(x, y)))
        # of three tokens the last two end together
        split_a = group(F.lit("%d,%d|%d"), F.array(place(x), place(y), place(z)), F.array(link(x, z), link(y, z)))
        split_b = group(F.lit("%d|%d,%d"), F.array(place(y), place(x), place(z)), F.array(link(y, x), link(y, z)))
        side = lambda of_a: F.filter(F.slice(tokens, first + 1, mark - first), lambda t: is_a(t) if of_a else ~is_a(t))
        ids = lambda own: F.array_join(F.array_repeat(F.lit("%d"), F.size(own)), ",")
        more = _let(
            F.struct(side(True).alias("a"), side(False).alias("b")),
            lambda g: group(
                F.concat(ids(g["a"]), F.lit("|"), ids(g["b"])),
                F.transform(F.concat(g["a"], g["b"]), place),
                F.flatten(F.transform(g["a"], lambda s: F.transform(g["b"], lambda t: link(s, t)))),
            ),
        )
        return F.when(mark - first == 2, two).when(mark - first == 3, F.when(is_a(x), split_a).otherwise(split_b)).otherwise(more)

    places = F.filter(F.sequence(F.lit(0), F.size(stream) - 1), lambda p: tokens[p].bitwiseAND(F.lit(MARK)) == MARK)
    firsts = lambda m: F.slice(F.concat(F.array(F.lit(0)), F.transform(m, lambda p: p + 1)), F.lit(1), F.size(m))
    return F.when(F.size(stream) > 0, _let(places, lambda m: F.zip_with(firsts(m), m, between)))


def linked(docs: DataFrame, files: Tokenizers, id_col: str = "doc_id", text_col: str = "text", remembered: int = REMEMBERED) -> DataFrame:
    """``id, n_a, n_b, n_groups, n_links, groups_sha256, links``: all links of a document as pair numbers, in order of these."""
    kind = "int" if files.sizes[0] * files.sizes[1] < 1 << 31 else "long"
    rows = slim(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), "text")
    place = ["number", "id", "parts", "shapes", "ids"]
    # each step names what the one before it made more than once, so that Spark keeps the steps apart
    shared = tokenised(rows, files, remembered).select(*place, "ends_a", "ends_b", F.array_intersect("ends_a", "ends_b").alias("common"))
    packed = lambda c, first: F.transform(c, lambda e, i: F.shiftleft(e.cast("long"), PLACE_BITS) + first + i)
    marks = F.transform("common", lambda e: F.shiftleft(e.cast("long"), PLACE_BITS) + F.lit(MARK))
    counts = [F.size(c).cast("long").alias(n) for c, n in (("ends_a", "n_a"), ("ends_b", "n_b"), ("common", "n_groups"))]
    streams = shared.select(*place, *counts, F.sort_array(F.concat(packed("ends_a", F.lit(0)), packed("ends_b", F.size("ends_a") + F.lit(SIDE)), marks)).alias("stream"))
    each = streams.select(*place, "n_a", "n_b", "n_groups", groups("stream").alias("g"))
    places = [F.coalesce(F.flatten(f"g.{c}"), F.array().cast("array<bigint>")).alias(c) for c in ("order", "links")]
    done = each.select(*place, "n_a", "n_b", "n_groups", F.coalesce(F.array_join("g.text", ";"), F.lit("")).alias("text"), *places)
    return assembled(done, files.sizes[1], kind)


def pair_counts(held: DataFrame, size_b: int) -> DataFrame:
    """``pair, n, best``: in how many documents a pair is linked, and whether no pair of the same a id is in more."""
    counts = held.select(F.explode(F.array_distinct("links")).alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    of_a = Window.partitionBy(F.floor(F.col("pair") / size_b))
    return counts.select("pair", "n", (F.col("n") == F.max("n").over(of_a)).cast("int").alias("best"))


def align(docs: DataFrame, files: Tokenizers, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of each document."""
    spark, rows_a_batch = docs.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = int(spark.conf.get(rows_a_batch))
    # rows are whole texts and all stretches of a block: a batch of the usual number holds a task's
    spark.conf.set(rows_a_batch, str(min(usual, BATCH_ROWS) if usual > 0 else BATCH_ROWS))
    try:
        held = keep(linked(docs, files, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "aligned")
    finally:
        spark.conf.set(rows_a_batch, str(usual))
    counts = keep(pair_counts(held, files.sizes[1]), "pair-counts")
    hot = F.broadcast(keep(counts.orderBy(F.col("n").desc(), "pair").limit(HOT_PAIRS), "hot-pairs"))
    each = held.select("row", F.explode("links").alias("pair"))
    sums = lambda joined: joined.groupBy("row").agg(F.sum("best").alias("n_best"), F.sum("n").alias("count_sum"))
    frequent, others = sums(each.join(hot, "pair")), sums(each.join(hot.select("pair"), "pair", "left_anti").join(counts, "pair"))
    both = frequent.unionByName(others).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    done = held.select("row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(both, "row", "left")
    return done.select("id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
