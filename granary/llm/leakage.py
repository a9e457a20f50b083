"""Evaluation texts leaking into a training corpus.

1. A pass over the corpus counts the five-word grams that also occur in some test item; the item grams are broadcast while
   their measured size is small, so nothing of the corpus is shuffled but these counts.
2. For verbatim runs, each window of ``run`` words of an item keeps as a seed the rarest of its grams that occur in the corpus.
   Whatever document holds the whole window holds its seed, so no verbatim run is lost; an edited copy may hold none of them.
   For edited copies every gram of an item is a seed, so whatever document keeps five consecutive words is met.
3. A second pass joins documents to items by the seeds. Each hit lies on a diagonal, the place in the document less that in
   the item; hits of neighbouring diagonals share one window of the document's words, which travels instead of the text and
   is made once per document, item and block of diagonals before anything is shuffled.
4. Smith-Waterman aligns windows with items, scores edited copies and measures the longest verbatim run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from granary.session import bounded, cut

GRAM = 5
MATCH, MISMATCH, GAP = 2, 1, 1


def words(text: Column) -> Column:
    """Unbroken runs of letters and digits in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), 0)


def _grams(df: DataFrame, keep: list[str], least: int) -> DataFrame:
    """``(keep, pos, gram)`` of all rows with at least ``least`` words ``w``; ``pos`` counts from 0.

    Words are hashed once; a gram is the hash of five neighbouring hashes, taken from a plain array of numbers.
    """
    hashed = df.where(F.size("w") >= least).withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    at = hashed.select(*keep, "h", F.explode(F.sequence(F.lit(0), F.size("w") - GRAM)).alias("pos"))
    return at.select(*keep, "pos", F.xxhash64(*[F.get("h", F.col("pos") + k) for k in range(GRAM)]).alias("gram"))


def align(left: list[np.ndarray], right: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smith-Waterman over many pairs of word-id arrays at once: best score, its end in ``left``, longest equal run.

    Equal ids match; ids below 0 never do. Gaps cost the same per word, so a row's gaps from the left are a running maximum.
    """
    n, rows, cols = len(left), max(map(len, left), default=0), max(map(len, right), default=0)
    a, b = np.full((n, rows), -1, np.int32), np.full((n, cols), -2, np.int32)
    for i, (x, y) in enumerate(zip(left, right)):
        a[i, : len(x)] = x
        b[i, : len(y)] = y
    b[b == -1] = -2
    slope = np.arange(cols, dtype=np.int32) * GAP
    score, run = np.zeros((n, cols + 1), np.int32), np.zeros((n, cols + 1), np.int32)
    best, at, longest = np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros(n, np.int32)
    for r in range(rows):
        same = a[:, r : r + 1] == b
        now = np.maximum(score[:, :-1] + np.where(same, MATCH, -MISMATCH), score[:, 1:] - GAP)
        np.maximum(now, 0, out=now)
        now = np.maximum.accumulate(now + slope, axis=1) - slope
        run[:, 1:] = np.where(same, run[:, :-1] + 1, 0)
        score[:, 1:] = now
        top = now.max(axis=1) if cols else best
        better = top > best
        best[better], at[better] = top[better], r
        if cols:
            np.maximum(longest, run.max(axis=1), out=longest)
    return best, at, longest


def _seeds(grams: DataFrame, counts: DataFrame, run: int) -> DataFrame:
    """The rarest gram that occurs of each window of ``run`` words of every item."""
    rated = grams.join(counts, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    span = run - GRAM
    ahead = f"over (partition by item, tid order by pos rows between current row and {span} following)"
    rare = rated.withColumn("rare", F.expr(f"min(if(n > 0, struct(n, gram, pos), null)) {ahead}"))
    full = rare.withColumn("full", F.expr(f"count(1) {ahead}")).where((F.col("full") == span + 1) & F.col("rare").isNotNull())
    return full.select("item", "tid", "item_words", F.col("rare.gram").alias("gram"), F.col("rare.pos").alias("pos")).distinct()


def leaks(docs: DataFrame, items: DataFrame, doc: str, item: str, text: str, run: int = 10, block: int = 128, edited: bool = False) -> DataFrame:
    """``(doc, item, score, verbatim_run, item_words)`` for every document window and item that share a seed: with ``edited``
    any gram of the item, else the rarest gram of each window of ``run`` words, which finds all pairs with
    ``verbatim_run >= run`` but not all edited copies. A pair has a row for each block of ``run`` neighbouring diagonals.

    ``docs`` and ``items`` have a key and ``text``; null and empty texts are in no pair, nor are texts below ``run`` words, or
    below five with ``edited``. Repeated keys with different texts are aligned each on their own. ``verbatim_run >= run`` in
    some row holds for exactly the pairs of which the document contains ``run`` consecutive words of the item. Item grams and
    items are broadcast while they are small and joined by shuffle beyond that.
    """
    least = GRAM if edited else run
    d = docs.where(F.col(doc).isNotNull()).select(F.col(doc).alias("doc"), words(F.col(text)).alias("w"))
    i = items.where(F.col(item).isNotNull()).select(F.col(item).alias("item"), words(F.col(text)).alias("w"))
    i = cut(i.where(F.size("w") >= least).distinct().withColumn("tid", F.xxhash64("w")).withColumn("item_words", F.size("w")))
    grams = cut(_grams(i, ["item", "tid", "item_words"], least))
    if edited:
        seeds = grams
    else:
        met = _grams(d, [], least).join(bounded(grams.select("gram").distinct()), "gram")
        seeds = cut(_seeds(grams, met.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), run))
    marked = bounded(seeds.withColumnRenamed("pos", "ipos"))
    hits = _grams(d, ["doc", "w"], least).join(marked, "gram").withColumn("diagonals", F.floor((F.col("pos") - F.col("ipos")) / run).cast("int"))
    first = F.greatest(F.col("diagonals") * run - run, F.lit(0))
    window = F.slice("w", first + 1, F.greatest((F.col("diagonals") + 2) * run + F.col("item_words") - first, F.lit(0)))
    regions = hits.select("doc", "item", "tid", "item_words", "diagonals", F.xxhash64("w").alias("text"), window.alias("region"))
    # a document's hits are in one task, so that all but one window of a block go before the shuffle
    regions = regions.groupBy("doc", "text", "item", "tid", "item_words", "diagonals").agg(F.first("region").alias("region"))
    pairs = regions.join(bounded(i.select("item", "tid", F.col("w").alias("iw"))), ["item", "tid"]).select("doc", "item", "item_words", "region", "iw")
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema}

    def run_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            regions, texts = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            score, longest = np.zeros(len(regions), np.int32), np.zeros(len(regions), np.int32)
            by_size = sorted(range(len(regions)), key=lambda x: len(regions[x]))
            for s in range(0, len(by_size), block):
                part = by_size[s : s + block]
                left, right = [], []
                for x in part:
                    ids: dict[str, int] = {}
                    right.append(np.array([ids.setdefault(t, len(ids)) for t in texts[x]], np.int32))
                    left.append(np.array([ids.get(t, -1) for t in regions[x]], np.int32))
                best, _, most = align(left, right)
                score[part], longest[part] = best, most
            columns = [batch.column(0), batch.column(1), pa.array(score), pa.array(longest), batch.column(2)]
            yield pa.RecordBatch.from_arrays(columns, names=[doc, item, "score", "verbatim_run", "item_words"])

    schema = f"`{doc}` {kinds['doc']}, `{item}` {kinds['item']}, score int, verbatim_run int, item_words int"
    return pairs.mapInArrow(run_batches, schema)
