"""Ranked lexical search: the best documents for each item by an integer BM25-like score, score-at-a-time over impacts.

Terms are runs of characters other than the ASCII ones that are neither letter nor digit, compared without case in A-Z.
A posting's impact is the exact integer that its term frequency and its document's length make of it, before the term's
weight.  Documents are dealt into shards of bounded size.  In a shard, postings are grouped by term and impact; an
item's groups are processed by falling contribution (weight times impact) into one accumulator a document.  What a
document can still gain is at most the sum, over the item's terms, of the next group's contribution.  Only when that is
below the k-th best accumulator do no other documents come into question; those whose accumulator can still reach it
get their complete scores, and the shard's k best go on to a merge of all shards.

Shuffled are one row a document with the item terms it holds, and k rows an item and shard.  Which terms items have is
known to the first pass by a bitmap of at most ``2**MAX_BITS`` bits; a term that passes it by accident is dropped later.
Terms are compared as 64-bit hashes.

Defined cases: a null or blank text has no terms and is not counted as a document; an item without terms, or whose terms
occur nowhere, has no rows; rows that repeat a document id are documents of their own; rows that repeat an item id are one
item with the terms of all; documents with a null id are counted but not returned, items with a null id return nothing;
extra columns are ignored; an empty table of either kind gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixspark.plans.scratch import keep

from .shingling import U, text_chunks, words
from .tables import slim

SHARD_POSTINGS = 400_000
BLOCK_TERMS = 200_000
MAX_BITS = 24

# Fixed values of the score: saturation, length normalisation in percent, and the units of weights and impacts.
SATURATION, LENGTH_SHARE, WEIGHT_UNIT, IMPACT_UNIT = 8, 75, 1000, 1_000_000_000


class ImpactIndex:
    """Postings of one shard, by term and exact impact; ``touched`` counts the postings accumulated so far."""

    def __init__(self, document: np.ndarray, term: np.ndarray, impact: np.ndarray, n_documents: int, n_terms: int):
        """``document`` ascending; each (document, term) once; ``term`` below ``n_terms``."""
        self.first = np.searchsorted(document, np.arange(n_documents + 1))
        self.term, self.impact, self.n_documents = term, impact, n_documents
        order = np.lexsort((-impact, term))
        self.by_impact = document[order]
        term, impact = term[order], impact[order]
        fresh = np.ones(len(order), dtype=bool)
        fresh[1:] = (term[1:] != term[:-1]) | (impact[1:] != impact[:-1])
        self.start = np.flatnonzero(fresh)
        self.size = np.diff(np.append(self.start, len(order)))
        self.group_impact = impact[self.start]
        self.groups_of = np.searchsorted(term[self.start], np.arange(n_terms + 1))
        self.weight = np.zeros(n_terms, dtype=np.int64)
        self.touched = 0

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, exact scores) among which are the k best of those with a score above 0, all ties included."""
        begin, end = self.groups_of[terms], self.groups_of[terms + 1]
        groups, owner = _ranges(begin, end)
        gains = weights[owner] * self.group_impact[groups]
        order = np.argsort(-gains, kind="stable")
        groups, owner, gains = groups[order], owner[order], gains[order]
        upto = np.concatenate([[0], np.cumsum(self.size[groups])])
        scores = np.zeros(self.n_documents, dtype=np.int64)
        step = max(4096, int(upto[-1]) // 16)
        done = 0
        while done < len(groups):
            until = int(np.searchsorted(upto, upto[done] + step, side="left"))
            until = min(max(until, done + 1), len(groups))
            taken = groups[done:until]
            places, of = _ranges(self.start[taken], self.start[taken] + self.size[taken])
            np.add.at(scores, self.by_impact[places], gains[done:until][of])
            self.touched += len(places)
            done = until
            following = begin + np.bincount(owner[:done], minlength=len(terms))
            left = following < end
            remaining = int((weights[left] * self.group_impact[following[left]]).sum())
            kth = int(np.partition(scores, -k)[-k]) if len(scores) >= k else 0
            if remaining < kth:  # no document outside of the accumulators' best can reach the k-th
                return self._complete(np.flatnonzero(scores + remaining >= kth), terms, weights)
        kth = int(np.partition(scores, -k)[-k]) if len(scores) >= k else 0
        best = np.flatnonzero(scores >= max(kth, 1))
        return best, scores[best]

    def _complete(self, documents: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        self.weight[terms] = weights
        places, of = _ranges(self.first[documents], self.first[documents + 1])
        scores = np.zeros(len(documents), dtype=np.int64)
        np.add.at(scores, of, self.weight[self.term[places]] * self.impact[places])
        self.weight[terms] = 0
        return documents, scores


def _ranges(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(all integers of the ranges from ``begin`` up to ``end``, the number of the range that each is of)."""
    n = end - begin
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + begin[of], of


def term_counts(texts: DataFrame, wanted: np.ndarray | None = None) -> DataFrame:
    """``id, n, terms, counts`` of ``id, text``: all terms with repeats, and the distinct ones with their numbers.

    ``wanted`` is a bitmap of term hashes, a power of two of 64-bit words; terms outside of it count in ``n`` only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id")
            for a, b, data, offsets in text_chunks(batch.column("text")):
                term, _, first = words(data, offsets, alphanumeric=True)
                row = np.repeat(np.arange(b - a), np.diff(first))
                if wanted is not None:
                    hit = (wanted[((term >> U(6)) & U(len(wanted) - 1)).astype(np.int64)] >> (term & U(63))) & U(1) == 1
                    term, row = term[hit], row[hit]
                order = np.lexsort((term, row))
                term, row = term[order], row[order]
                fresh = np.ones(len(term), dtype=bool)
                fresh[1:] = (term[1:] != term[:-1]) | (row[1:] != row[:-1])
                at = np.flatnonzero(fresh)
                ends = pa.array(np.searchsorted(row[at], np.arange(b - a + 1)).astype(np.int32))
                counts = np.diff(np.append(at, len(term)))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (term[at].view(np.int64), counts.astype(np.int64))]
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(np.diff(first).astype(np.int64)), *lists], ["id", "n", "terms", "counts"])

    return texts.mapInArrow(run, "id long, n long, terms array<long>, counts array<long>")


def term_bitmap(terms: DataFrame, n_terms: int) -> np.ndarray:
    """The bits of the hashes ``term``, sixteen a term and up to ``2**MAX_BITS`` in all; that bounds what is collected."""
    bits = min(MAX_BITS, max(16, int(n_terms * 16).bit_length()))
    word = F.shiftrightunsigned("term", 6).bitwiseAND(F.lit((1 << (bits - 6)) - 1)).alias("word")
    out = np.zeros(1 << (bits - 6), dtype=np.uint64)
    rows = terms.select(word, F.col("term").bitwiseAND(F.lit(63)).cast("int").alias("at")).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, at)")).alias("bits"))
    for r in rows.collect():
        out[r["word"]] = r["bits"] & 0xFFFFFFFFFFFFFFFF
    return out


def document_frequencies(postings: DataFrame) -> DataFrame:
    """``term, df``: each batch sums its documents before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            term, n = np.unique(batch.column("terms").flatten().to_numpy(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(n)], ["term", "df"])

    return postings.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def top_documents(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``item_id, rank, id, score``: the ``k`` documents of highest score above 0 for each item, ties to the smaller id."""
    asked = term_counts(slim(items, id=item_col, text=item_text_col).where("id is not null").select(F.col("id").cast("long").alias("id"), "text"))
    asked = asked.select("id", F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy("id", F.col("x.terms").alias("term")).agg(F.sum("x.counts").alias("times"))
    asked = keep(asked, "item-terms")
    size = asked.agg(F.count("*").alias("rows"), F.count_distinct("term").alias("terms")).first()
    wanted = term_bitmap(asked.select("term").distinct(), size["terms"])
    texts = slim(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), "text")
    held = keep(term_counts(texts, wanted).where("n > 0"), "postings")
    total = held.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("postings")).first()
    n, length = total["n"], max(total["l"], 1)

    weight = F.floor(WEIGHT_UNIT * F.log((2.0 * n + 2) / (2.0 * F.col("df") + 1)))
    weighed = asked.join(document_frequencies(held), "term").withColumn("weight", F.col("times") * weight).where("weight > 0")
    blocks = max(1, -(-size["rows"] // BLOCK_TERMS))
    shards = max(1, -(-total["postings"] // SHARD_POSTINGS))
    dealt = lambda c, parts: F.pmod(F.xxhash64(F.lit(29), c), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    queries = weighed.groupBy("id").agg(F.collect_list(F.struct("term", "weight")).alias("x")).select(
        dealt("id", blocks).alias("block"), every(shards).alias("shard"), F.lit(True).alias("query"), "id", F.lit(0).cast("long").alias("norm"), F.col("x.term").alias("terms"), F.col("x.weight").alias("numbers")
    )
    norm = F.lit(100 - LENGTH_SHARE).cast("long") + F.expr(f"({LENGTH_SHARE}L * n * {n}L) div {length}L")
    mine = held.where("id is not null and size(terms) > 0").select(
        every(blocks).alias("block"), dealt(F.struct("id", "terms"), shards).alias("shard"), F.lit(False).alias("query"), "id", norm.alias("norm"), "terms", F.col("counts").alias("numbers")
    )

    def search(group: pa.Table) -> pa.Table:
        asking = group.column("query").to_numpy()
        own, other = group.filter(pa.array(~asking)).combine_chunks(), group.filter(pa.array(asking)).combine_chunks()
        found = best_of_shard(own, other, k) if len(own) and len(other) else [np.empty(0, np.int64)] * 3
        return pa.table([pa.array(x) for x in found], ["item_id", "id", "score"])

    local = mine.unionByName(queries).groupBy("shard", "block").applyInArrow(search, "item_id long, id long, score long")
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.col("score").desc(), "id"))
    return local.withColumn("rank", place).where(F.col("rank") <= k).select("item_id", "rank", "id", "score")


def best_of_shard(own: pa.Table, asking: pa.Table, k: int) -> list[np.ndarray]:
    """Items, documents and scores: the ``k`` best documents ``id, norm, terms, numbers`` for each item ``id, terms, numbers``."""
    flat = lambda t, c: (t.column(c).combine_chunks().flatten() if isinstance(t.column(c), pa.ChunkedArray) else t.column(c).flatten()).to_numpy()
    sizes = lambda t: t.column("terms").combine_chunks().value_lengths().to_numpy()
    vocabulary, asked = np.unique(flat(asking, "terms"), return_inverse=True)
    term, tf = flat(own, "terms"), flat(own, "numbers")
    document = np.repeat(np.arange(len(own)), sizes(own))
    number = np.minimum(np.searchsorted(vocabulary, term), len(vocabulary) - 1)
    known = vocabulary[number] == term
    document, number, tf = document[known], number[known], tf[known]
    impact = (IMPACT_UNIT * tf) // (WEIGHT_UNIT * tf + SATURATION * own.column("norm").to_numpy()[document])
    index = ImpactIndex(document, number, impact, len(own), len(vocabulary))
    ids, items, weights = own.column("id").to_numpy(), asking.column("id").to_numpy(), flat(asking, "numbers")
    ends = np.concatenate([[0], np.cumsum(sizes(asking))])
    out: list[list[np.ndarray]] = [[], [], []]
    for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
        documents, scores = index.search(asked[a:b], weights[a:b], k)
        best = np.lexsort((ids[documents], -scores))[:k]
        for column, values in zip(out, (np.full(len(best), items[i]), ids[documents[best]], scores[best]), strict=True):
            column.append(values)
    return [np.concatenate(x).astype(np.int64) for x in out]
