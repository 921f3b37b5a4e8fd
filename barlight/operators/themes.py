"""Topics of short texts: TF-IDF weights, non-negative factors, and shares per event."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlight.functions.text import RANKING_STOPWORDS
from barlight.session import written


def grams(docs: DataFrame, key: str, text: Column, stop: list[str]) -> DataFrame:
    """(k, term), one row per occurrence: words of two or more letters or digits without stop words,
    and neighbouring pairs of them."""
    words = F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0)), lambda w: ~w.isin(stop))
    # a column of its own: inside the lambda below the words would be found anew for every word
    rows = docs.select(F.col(key).alias("k"), words.alias("w"))
    n = F.greatest(F.size("w") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("w", F.lit(1), n), F.slice("w", F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b))
    return rows.select("k", F.explode(F.concat("w", pairs)).alias("term"))


def tfidf(docs: DataFrame, key: str, text: Column, min_df: int = 5, max_df: float = 0.9, features: int = 5000, stop: list[str] | None = None) -> DataFrame:
    """(key, term, weight) with (1 + ln tf) * (1 + ln((1 + n) / (1 + df))), each document of length 1.

    Terms are words and pairs held by at least ``min_df`` documents and at most the share
    ``max_df``; of these the ``features`` most frequent (ties by term), which bounds what is
    broadcast. A document without such a term has no row.
    """
    counts = grams(docs, key, text, stop or RANKING_STOPWORDS).groupBy("k", "term").agg(F.count(F.lit(1)).alias("tf"))
    counts = written(counts, "gram-counts")
    n = docs.count()
    terms = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))
    kept = terms.where((F.col("df") >= min_df) & (F.col("df") <= max_df * n)).orderBy(F.desc("total"), "term").limit(features)
    raw = counts.join(F.broadcast(kept.select("term", "df")), "term")
    raw = raw.select("k", "term", ((F.log(F.col("tf").cast("double")) + 1) * (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1)).alias("raw"))
    length = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("k")))
    return raw.select(F.col("k").alias(key), "term", (F.col("raw") / length).alias("weight"))


class Topics:
    """Non-negative factors of a TF-IDF table by multiplicative updates (Lee and Seung, 2001).

    The topics' term weights (``topics`` x at most ``features`` numbers) are held by the driver and
    sent to the tasks; documents stay where they are. Each round a task finds its documents' weights
    and returns two sums whose size doesn't depend on the number of documents; with them the driver
    updates the term weights ``inner`` times as well, which needs no further pass. Rounds end when
    the error falls by less than the share ``tolerance`` in each of ten rounds in a row, or after
    ``rounds``. A single round isn't enough: errors stay on a level and fall again later.
    ``errors`` has the error of each round.
    """

    def __init__(self, weights: DataFrame, key: str, topics: int = 8, rounds: int = 500, inner: int = 15, seed: int = 42, tolerance: float = 1e-8) -> None:
        names = [r.term for r in weights.select("term").distinct().orderBy("term").collect()]  # at most ``features``
        self.key, self.terms, self.inner = key, names, inner
        place = weights.sparkSession.createDataFrame([(t, i) for i, t in enumerate(names)], "term string, i int") if names else None
        self.errors: list[float] = []
        self.h = np.zeros((topics, len(names)))
        self.docs = None
        if not names:
            return
        rows = weights.join(F.broadcast(place), "term").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "weight"))).alias("v"))
        self.docs = written(rows.select(key, F.col("v.i").alias("i"), F.col("v.weight").alias("x")), "doc-vectors")
        self.h = np.random.default_rng(seed).random((topics, len(names))) + 0.01
        for _ in range(rounds):
            a, b, error = self._sums()
            self.errors.append(error)
            for _ in range(inner):
                self.h *= a / (b @ self.h + 1e-12)
            last = np.array(self.errors[-11:])
            if len(last) == 11 and (np.abs(np.diff(last)) < tolerance * last[:-1]).all():
                break

    def _solver(self):
        h, inner = np.ascontiguousarray(self.h.T), self.inner
        hh = h.T @ h

        def solve(start: np.ndarray, i: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Weights of all documents of a batch, and their products with the topics. No document is empty."""
            top = np.add.reduceat(h[i] * x[:, None], start, axis=0)
            w = np.full(top.shape, 1.0 / h.shape[1])
            for _ in range(inner):
                w *= top / (w @ hh + 1e-12)
            return w, top

        return solve

    @staticmethod
    def _vectors(i: pa.ListArray, x: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each document starts, and the places and weights of all."""
        size = pc.list_value_length(i).to_numpy()
        return np.cumsum(size) - size, i.flatten().to_numpy(), x.flatten().to_numpy()

    def _sums(self) -> tuple[np.ndarray, np.ndarray, float]:
        solve, k, m = self._solver(), *self.h.shape
        hh, vectors = self.h @ self.h.T, self._vectors

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            a, b, error = np.zeros((k, m)), np.zeros((k, k)), 0.0
            for batch in batches:
                if not len(batch):
                    continue
                start, i, x = vectors(batch.column(0), batch.column(1))
                w, top = solve(start, i, x)
                size = np.diff(np.append(start, len(i)))
                for t in range(k):
                    a[t] += np.bincount(i, np.repeat(w[:, t], size) * x, m)
                own = w.T @ w
                b += own
                error += float(x @ x - 2 * (w * top).sum() + (own * hh).sum())
            flat = np.concatenate([a.ravel(), b.ravel(), [error]])
            yield pa.record_batch([pa.array(np.arange(len(flat))), pa.array(flat)], names=["at", "value"])

        total = np.zeros(k * m + k * k + 1)
        sums = self.docs.select("i", "x").mapInArrow(run, "at bigint, value double").groupBy("at").agg(F.sum("value").alias("v")).toArrow()
        total[sums["at"].to_numpy()] = sums["v"].to_numpy()
        return total[: k * m].reshape(k, m), total[k * m : -1].reshape(k, k), float(total[-1])

    def top_words(self, count: int = 15) -> list[tuple[int, int, str, float]]:
        """(topic, rank, word, weight), the greatest weights first, ties by word."""
        out = []
        for t, row in enumerate(self.h):
            order = sorted(range(len(row)), key=lambda i: (-row[i], self.terms[i]))[:count]
            out += [(t, r, self.terms[i], float(row[i])) for r, i in enumerate(order, 1)]
        return out

    def document_topics(self) -> DataFrame:
        """(key, weights, dominant_topic) of every document with a term."""
        solve, key, vectors = self._solver(), self.key, self._vectors

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not len(batch):
                    continue
                w = solve(*vectors(batch.column(1), batch.column(2)))[0].tolist()
                yield pa.record_batch([batch.column(0), pa.array(w, pa.list_(pa.float64()))], names=[key, "weights"])

        kind = self.docs.schema[key].dataType.simpleString()
        out = self.docs.select(key, "i", "x").mapInArrow(run, f"`{key}` {kind}, weights array<double>")
        return out.withColumn("dominant_topic", (F.array_position("weights", F.array_max("weights")) - 1).cast("int"))


def directions(pairs: DataFrame) -> DataFrame:
    """Pairs with the direction of their event, up before down; others and excluded ones are dropped,
    and a repeated event and article is taken once."""
    side = F.when(F.col("shift_1pct_up") == 1, "up").when(F.col("shift_1pct_down") == 1, "down").otherwise("other")
    return pairs.withColumn("direction", side).where(F.col("direction") != "other")


def group_shares(pairs: DataFrame, group: str, event: str = "event_date") -> DataFrame:
    """(direction, group, events, mean_article_share, total_article_matches).

    A group's share of an event is its pairs over all the event's pairs; the mean is over events
    that have the group, so means do not add up to 1.
    """
    size = pairs.groupBy(event, "direction", group).agg(F.count(F.lit(1)).alias("n"))
    share = size.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(event)))
    return share.groupBy("direction", group).agg(F.count_distinct(event).alias("events"), F.avg("share").alias("mean_article_share"), F.sum("n").alias("total_article_matches"))
