"""Substring dedup: passages of text that occur in several documents.

Two kinds of passage are looked for, and one occurrence of each, in the document with the smallest id, stays.

* Paragraphs (lines of at least ``min_paragraph`` words, by default those with a shingle) that are near copies of each other: MinHash bands tuned for
  high recall bring them together, the exact Jaccard similarity of their word shingles decides, and connected
  components of the verified links are the clusters.
* Verbatim passages that start and end anywhere in a line.  A window of ``window`` words is taken at every anchor, an
  anchor being the word position with the smallest shingle hash among ``spread`` neighbours.  Anchors depend only on
  the words around them, so any passage of ``window + spread`` words or more holds at least one window, the same one
  in every document, wherever the passage was inserted.  Equal windows are a cluster.  Where the words around a
  cluster's windows differ, a passage ends: there every window within ``spread`` words of the anchors is
  compared as well, so a passage is found from its first word to its last.  Overlapping windows join to a span.

The defaults find every word of every verbatim passage of 51 words, and of every line of 5 words and more that stands in several documents.  Words are runs of bytes other than space and 0x09-0x0D, and
compare without case in A-Z.  Repeats inside one document are left alone.

Defined cases: null and blank texts, and rows with a null id, have no passages and stay as they are; rows that repeat
an id are one document with several texts; extra columns are kept by :func:`drop_repeats`; a text of which nothing is
left is dropped by it; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixspark.plans.scratch import Run, keep
from .near_dedup import MinHash, full_sets, groups_of, signatures
from .shingling import _PLACE, U, _powers, mix, text_chunks, word_starts, words
from .sieve import bitmap, part, sift
from .tables import slim, unused

PARAGRAPH_HASH = MinHash(rows=3, bands=10, bits=4)


def _slide(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum (maximum) of ``width`` successive values by doubling; shorter by ``width - 1``."""
    pick = np.minimum if least else np.maximum
    have = 1
    while have * 2 <= width:
        x = pick(x[:-have], x[have:])
        have *= 2
    return pick(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def every_anchor(hashed: np.ndarray, first: np.ndarray, window: int, spread: int) -> np.ndarray:
    """Word positions at which a window is taken; of equal shingles in one neighbourhood all are."""
    n = len(hashed) - 4
    if len(hashed) < window + spread - 1:
        return np.empty(0, dtype=np.int64)
    rolled = hashed[:n] * _PLACE[0]
    for j in range(1, 5):
        rolled = rolled + hashed[j : n + j] * _PLACE[j]
    rolled = mix(rolled) | U(1)
    lows = _slide(rolled, spread, True)
    # a neighbourhood counts only if all of its windows lie in one text
    ends = np.repeat(first[1:], np.diff(first))
    whole = np.arange(len(lows)) + window + spread - 1 <= ends[: len(lows)]
    lows = np.where(whole, lows, U(0))
    padded = np.concatenate([np.zeros(spread - 1, dtype=np.uint64), lows, np.zeros(spread - 1, dtype=np.uint64)])
    return np.flatnonzero(_slide(padded, spread, False)[:n] == rolled)


def window_hashes(hashed: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and 32-bit check of the ``window`` words at each position."""
    k, c = (_range_hashes(hashed, at, at + window, salt) for salt in (U(0), U(0x632BE59BD9B4E019)))
    return k, (c >> U(32)).astype(np.uint32)


def _range_hashes(hashed: np.ndarray, start: np.ndarray, end: np.ndarray, salt: np.uint64 = _PLACE[0]) -> np.ndarray:
    """64-bit hash of the words from ``start`` to ``end`` at each place."""
    up, down = _powers(len(hashed))
    total = np.concatenate([[U(0)], np.cumsum(mix(hashed ^ salt) * up[: len(hashed)])])
    return mix((total[end] - total[start]) * down[start])


def contexts(hashed: np.ndarray, at: np.ndarray, begin: np.ndarray, end: np.ndarray, window: int, spread: int) -> tuple[np.ndarray, np.ndarray]:
    """Positive hashes of each window with up to ``spread`` words of its text to the left and to the right."""
    left = _range_hashes(hashed, np.maximum(at - spread, begin), at + window)
    right = _range_hashes(hashed, at, np.minimum(at + window + spread, end))
    return left >> U(1) | U(1), right >> U(1) | U(1)


def chains(at: np.ndarray, row: np.ndarray, k: np.ndarray, c: np.ndarray, window: int, *around: np.ndarray) -> tuple[np.ndarray, ...]:
    """(index of the first window, words) of each chain: equal windows of a text that overlap or touch.

    Of the values ``around`` each that all windows of a chain have is returned as well, and 0 where they differ.

    A chain's windows cover the words from the first to the last, so a text that repeats itself has few chains and loses no
    position.
    """
    by = np.lexsort((at, c, k, row))
    at, row, k, c = at[by], row[by], k[by], c[by]
    head = np.ones(len(at), dtype=bool)
    head[1:] = (row[1:] != row[:-1]) | (k[1:] != k[:-1]) | (c[1:] != c[:-1]) | (at[1:] - at[:-1] > window)
    start = np.flatnonzero(head)
    last = np.append(start[1:], len(at)) - 1
    alike = [np.where(np.minimum.reduceat(x[by], start) == np.maximum.reduceat(x[by], start), x[by[start]], U(0)) if len(at) else x for x in around]
    return by[start], at[last] - at[start] + window, *alike


def anchors(hashed: np.ndarray, first: np.ndarray, window: int, spread: int) -> np.ndarray:
    """Word positions of the first window of each chain."""
    at = every_anchor(hashed, first, window, spread)
    head, _ = chains(at, np.searchsorted(first, at, side="right"), *window_hashes(hashed, at, window), window)
    return np.sort(at[head])


def windows(docs: DataFrame, window: int, spread: int, hashes_only: bool = False) -> DataFrame:
    """``id, th, start, n_words, k, c, l, r, behind``: the chains of equal windows of ``id, th, text``, the words around
    them (0 where a chain's windows differ in them) and how many there are behind, up to ``spread``.

    With ``hashes_only`` it is ``id, k, c``, and what stands around is not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, th = batch.column("id").to_numpy(), batch.column("th").to_numpy()
            for a, b, data, offsets in text_chunks(batch.column("text")):
                hashed, _, first = words(data, offsets)
                at = every_anchor(hashed, first, window, spread)
                if not len(at):
                    continue
                k, c = window_hashes(hashed, at, window)
                row = np.searchsorted(first, at, side="right") - 1
                if hashes_only:
                    head, _ = chains(at, row, k, c, window)
                    cols = [ids[a:b][row[head]], k[head].view(np.int64), c[head].view(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["id", "k", "c"])
                    continue
                head, n, left, right = chains(at, row, k, c, window, *contexts(hashed, at, first[row], first[row + 1], window, spread))
                at, row = at[head], row[head]
                cols = [ids[a:b][row], th[a:b][row], (at - first[row]).astype(np.int32), n.astype(np.int32), k[head].view(np.int64), c[head].view(np.int32)]
                cols += [left.view(np.int64), right.view(np.int64), np.minimum(first[row + 1] - at - n, spread).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["id", "th", "start", "n_words", "k", "c", "l", "r", "behind"])

    return docs.mapInArrow(run, "id long, k long, c int" if hashes_only else "id long, th long, start int, n_words int, k long, c int, l long, r long, behind int")


def edge_windows(docs: DataFrame, window: int) -> DataFrame:
    """``id, th, start, n_words, k, c``: the chains of all windows of ``id, th, text, places`` that start in a place.

    A place is ``lo, hi``, the first and last word; what lies outside the text is cut off.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, th = batch.column("id").to_numpy(), batch.column("th").to_numpy()
            places, of = batch.column("places").flatten(), np.concatenate([[0], np.cumsum(batch.column("places").value_lengths().to_numpy())])
            lo, hi = (places.field(j).to_numpy() for j in range(2))
            for a, b, data, offsets in text_chunks(batch.column("text")):
                hashed, _, first = words(data, offsets)
                row = np.repeat(np.arange(b - a), np.diff(of[a : b + 1]))
                begin = first[row] + np.maximum(lo[of[a] : of[b]], 0)
                end = np.minimum(first[row] + hi[of[a] : of[b]], first[row + 1] - window) + 1
                some = begin < end
                step = np.zeros(len(hashed) + 1, dtype=np.int64)
                np.add.at(step, begin[some], 1)
                np.add.at(step, end[some], -1)
                at = np.flatnonzero(np.cumsum(step))
                if not len(at):
                    continue
                k, c = window_hashes(hashed, at, window)
                row = np.searchsorted(first, at, side="right") - 1
                head, n = chains(at, row, k, c, window)
                at, row = at[head], row[head]
                cols = [ids[a:b][row], th[a:b][row], (at - first[row]).astype(np.int32), n.astype(np.int32), k[head].view(np.int64), c[head].view(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["id", "th", "start", "n_words", "k", "c"])

    return docs.mapInArrow(run, "id long, th long, start int, n_words int, k long, c int")


def extended(rows: DataFrame, found: DataFrame, window: int, spread: int) -> DataFrame:
    """The shared windows where passages begin and end: ``id, th, start, n_words, keep_id``.

    If all occurrences of a window agree in the ``spread`` words to one side, those words belong to the passage and the
    next anchor there is shared by all of them; elsewhere (``left``, ``right``) all windows up to it are compared.
    """
    place = F.struct(
        (F.col("start") - F.when(F.col("left"), spread).otherwise(0)).alias("lo"),
        (F.col("start") + F.col("n_words") - window + F.when(F.col("right"), spread).otherwise(0)).alias("hi"),
    )
    near = keep(found.where("left or right").groupBy("id", "th").agg(F.collect_list(place).alias("places")), "places")
    wins = keep(edge_windows(sift(rows, bitmap(near, "id", "th"), "id", "th").join(near, ["id", "th"]), window), "edges")
    shared = wins.groupBy("k", "c").agg(F.min("id").alias("keep_id"), F.max("id").alias("last_id")).where("keep_id <> last_id")
    shared = keep(shared.select("k", "c", "keep_id"), "edges-shared")
    return with_owner(wins, shared).select("id", "th", "start", "n_words", "keep_id")


def texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, th, text`` of the rows with an id and a text; ``th`` tells apart the texts of one id."""
    rows = slim(docs, id=id_col, text=text_col).where("id is not null and text is not null and text <> ''")
    return rows.select(F.col("id").cast("long").alias("id"), F.xxhash64("text").alias("th"), "text")


def lines(batch: pa.RecordBatch, min_words: int) -> Iterator[pa.RecordBatch]:
    """``pid, doc, th, start, n_words, text`` of the lines of at least ``min_words`` words; ``start`` is in words of the text."""
    ids, th = (batch.column(c).to_numpy() for c in ("id", "th"))
    for a, b, data, offsets in text_chunks(batch.column("text")):
        begin = np.unique(np.concatenate([offsets[:-1][offsets[:-1] < offsets[1:]], np.flatnonzero(data[:-1] == 10) + 1]))
        if not len(begin):
            continue
        at = word_starts(data, offsets)
        upto = np.searchsorted(at, np.append(begin, len(data)))
        n = np.diff(upto)
        row = np.searchsorted(offsets, begin, side="right") - 1
        start = upto[:-1] - np.searchsorted(at, offsets[row])
        long = np.flatnonzero(n >= max(1, min_words))
        row, start = row[long], start[long].astype(np.int32)
        doc, own = ids[a:b][row], th[a:b][row]
        pid = mix(mix(doc.view(np.uint64) ^ U(0x3C6EF372FE94F82B)) + mix(own.view(np.uint64)) + start.astype(np.uint64))
        every = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(np.append(begin, len(data)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
        cols = [pid.view(np.int64), doc, own, start, n[long].astype(np.int32)]
        yield pa.RecordBatch.from_arrays([*[pa.array(x) for x in cols], every.take(pa.array(long))], ["id", "doc", "th", "start", "n_words", "text"])


def near_paragraphs(rows: DataFrame, min_words: int, params: MinHash) -> DataFrame:
    """``id, th, start, n_words, keep_id`` of the paragraphs that are near copies of one in another document."""
    with Run() as tables:
        cut = partial(lines, min_words=min_words)
        sig = keep(signatures(rows, params, cut, "id long, doc long, th long, start int, n_words int"), "paragraphs")
        where = sig.select(F.col("id").alias("pid"), "doc", "th", "start", "n_words")

        def sets_of(nodes: DataFrame) -> DataFrame:
            texts_of = sift(where.select(F.col("pid").alias("id"), F.col("doc"), "th"), bitmap(nodes, "id"), "id").select(F.col("doc").alias("id"), "th").distinct()
            sets = full_sets(sift(rows, bitmap(texts_of, "id", "th"), "id", "th"), params, cut)
            # most lines of these texts are no nodes
            return sift(sets, bitmap(nodes, "id"), "id").join(nodes, "id", "left_semi")

        grouped = groups_of(sig.drop("doc", "th", "start", "n_words"), sets_of, params).select("id", "component_id")
        counts = grouped.groupBy("component_id").agg(F.count("*").alias("n")).where("n > 1")
        near = keep(sift(grouped, bitmap(counts, "component_id"), "component_id").select(F.col("id").alias("pid"), "component_id"), "near")
        placed = keep(sift(where, bitmap(near, "pid"), "pid").join(near, "pid"), "placed")
        tables.release(placed)
    owners = placed.groupBy("component_id").agg(F.min("doc").alias("keep_id"), F.max("doc").alias("last_id")).where("keep_id <> last_id")
    whole = placed.join(owners.drop("last_id"), "component_id")
    return whole.select(F.col("doc").alias("id"), "th", "start", "n_words", "keep_id")


def pieces(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 26, spread: int = 25, min_paragraph: int = 5, params: MinHash = PARAGRAPH_HASH
) -> DataFrame:
    """Occurrences of passages that two or more documents share: ``id, th, start, n_words, keep_id`` (in words)."""
    rows = texts(docs, id_col, text_col)
    with Run() as tables:
        verbatim = keep(shared_windows(rows, window, spread), "verbatim")
        tables.release(verbatim)
    return verbatim.unionByName(near_paragraphs(rows, min_paragraph, params))


def shared_windows(rows: DataFrame, window: int, spread: int) -> DataFrame:
    """``id, th, start, n_words, keep_id`` of the windows that two or more documents share, with what they have around them in common."""
    shared = windows(rows, window, spread, hashes_only=True).groupBy("k", "c").agg(F.min("id").alias("keep_id"), F.max("id").alias("last_id")).where("keep_id <> last_id")
    held = keep(with_owner(windows(rows, window, spread), keep(shared.drop("last_id"), "shared")), "found")
    # what stands around is compared among the shared windows only, which are few
    ends = held.groupBy("k", "c").agg(*[f(x).alias(f"{x}_{f.__name__}") for x in ("l", "r") for f in (F.min, F.max)])
    open_ends = [F.expr(f"{x}_min = 0 or {x}_min <> {x}_max").alias(side) for x, side in (("l", "left"), ("r", "right"))]
    found = keep(held.join(ends.select("k", "c", *open_ends), ["k", "c"]).select("id", "th", "start", "n_words", "keep_id", "behind", "left", "right"), "found-ends")
    ahead, behind = F.when(F.col("left"), 0).otherwise(F.least("start", F.lit(spread))), F.when(F.col("right"), 0).otherwise(F.col("behind"))
    whole_sides = found.select("id", "th", (F.col("start") - ahead).alias("start"), (F.col("n_words") + ahead + behind).alias("n_words"), "keep_id")
    return whole_sides.unionByName(extended(rows, found, window, spread))


def with_owner(wins: DataFrame, shared: DataFrame) -> DataFrame:
    """The windows that are among the ``shared`` ones, with these' other columns.

    Those of a common passage may be very many: both sides are plain shuffles, so adaptive execution splits them.
    """
    return sift(wins, bitmap(shared, "k", "c"), "k", "c").join(shared, ["k", "c"])


def spans(found: DataFrame) -> DataFrame:
    """Overlapping pieces of a text joined: ``id, th, start, n_words, removed, keep_id, n_pieces``.

    ``removed`` spans repeat what document ``keep_id`` (the smallest, where pieces differ) has; the others are where
    the passages stay.
    """
    marked = found.withColumn("removed", F.col("id") != F.col("keep_id")).withColumn("end", F.col("start") + F.col("n_words"))
    own = Window.partitionBy("id", "th", "removed").orderBy("start", "end")
    before = F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1))
    isles = marked.withColumn("fresh", (before.isNull() | (F.col("start") > before)).cast("int")).withColumn("isle", F.sum("fresh").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    joined = isles.groupBy("id", "th", "removed", "isle").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("keep_id").alias("keep_id"), F.count("*").alias("n_pieces"))
    return joined.select("id", "th", "start", (F.col("end") - F.col("start")).alias("n_words"), "removed", "keep_id", "n_pieces")


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", **options) -> DataFrame:
    """The table with every removed span cut out of its text; all columns stay, and ``chars_col`` follows a text that is cut.

    A text loses its words from the first to the last of a span and the white space behind them.  A text with nothing
    left but white space goes, if something was cut from it.
    """
    columns = docs.columns
    text_at = columns.index(text_col)
    chars_at = columns.index(chars_col) if chars_col in columns else None
    key, th, starts, counts = unused(docs, "key", "th", "starts", "counts")
    with Run() as tables:
        found = spans(pieces(docs, id_col, text_col, **options)).where("removed").groupBy("id", "th").agg(F.array_sort(F.collect_list(F.struct("start", "n_words"))).alias("spans"))
        cuts = keep(found.select(F.col("id").alias(key), F.col("th").alias(th), F.col("spans.start").alias(starts), F.col("spans.n_words").alias(counts)), "cuts")
        tables.release(cuts)
    keyed = docs.withColumns({key: F.col(f"`{id_col}`").cast("long"), th: F.xxhash64(F.col(f"`{text_col}`"))})
    maybe, whole = part(keyed, bitmap(cuts, key, th), key, th)
    joined = maybe.join(cuts, [key, th], "left").select(*[f"`{c}`" for c in columns], starts, counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, n = batch.column(len(columns)), batch.column(len(columns) + 1)
            text = batch.column(text_at).to_pylist() if at.null_count < len(at) else None
            keep_row = np.ones(len(batch), dtype=bool)
            cols = [batch.column(j) for j in range(len(columns))]
            if text is not None:
                chars = None if chars_at is None else cols[chars_at].to_pylist()
                for i in np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False)):
                    text[i] = cut_words(text[i], at[i].as_py(), n[i].as_py())
                    keep_row[i] = bool(text[i].strip(" \t\n\v\f\r"))
                    if chars is not None and chars[i] is not None:
                        chars[i] = len(text[i])
                cols[text_at] = pa.array(text, type=cols[text_at].type)
                if chars is not None:
                    cols[chars_at] = pa.array(chars, type=cols[chars_at].type)
            yield pa.RecordBatch.from_arrays(cols, schema=pa.schema([batch.schema.field(j) for j in range(len(columns))])).filter(pa.array(keep_row))

    return whole.select(*[f"`{c}`" for c in columns]).unionByName(joined.mapInArrow(run, docs.schema))


def cut_words(text: str, starts: list[int], counts: list[int]) -> str:
    """The text without the spans of words given by ascending ``starts`` and ``counts``."""
    raw = text.encode()
    data = np.frombuffer(raw, dtype=np.uint8)
    _, at, first = words(data, np.array([0, len(data)]))
    out, done = [], 0
    for s, n in zip(starts, counts, strict=True):
        a = int(at[s])
        b = int(at[s + n]) if s + n < len(at) else len(raw)
        out.append(raw[done:a])
        done = max(done, b)
    return (b"".join(out) + raw[done:]).decode()
