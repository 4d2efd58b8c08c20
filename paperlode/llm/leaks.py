"""Problem 7: passages of held-out test items inside a large corpus.

Texts are brought to their letters and digits, without case and width. Fixed masks (spaced seeds) lie over each
window of characters; the characters under a mask make a hash, those between are ignored, so a hit survives
substituted characters. Hashes of the test items and of the documents are joined, and around each hit the two
texts are compared along the hit's diagonal: the longest equal run, and the overlap that tolerates substitutions.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperlode.session import cut_lineage, spread

MIN_WORDS, MIN_CHARS = 12, 24
#: The masks. Each span is at most the shortest run that counts, so no such run can be missed.
MASKS = ("110110011010110110011011", "101011011100101101110101")
#: Up to so many hash rows and characters of test items (under 100 MB in all) these are sent to every task, and the
#: documents' hashes are sieved by them before they leave it; above, all hashes of the documents are joined. Both ways
#: give the same rows.
SIEVE_MOST, TEXT_MOST = 2_000_000, 20_000_000
#: Characters of documents that are hashed together.
TOGETHER = 1_000_000
SENTENCE_END = r"(?<=[。！？])|(?<=[.!?][\s])"
_MULTIPLIER = 0x9E3779B97F4A7C15


def plain(text: str | None) -> str:
    """Letters and digits of a text, case and width folded. Null gives an empty text."""
    if not text:
        return ""
    return "".join(filter(str.isalnum, unicodedata.normalize("NFKC", text).casefold()))


def word_ends(text: str) -> list[int]:
    """Where the words of a text end, counted in characters of plain(text)."""
    import regex

    at, ends = 0, []
    for word in regex.findall(r"[\p{L}\p{N}]+", unicodedata.normalize("NFKC", text).casefold()):
        at += len(word)
        ends.append(at)
    return ends


def hashes(text: str, mask: str) -> np.ndarray:
    """The hash under one mask at every place of a plain text where the mask fits."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)
    n = len(points) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    h = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k, bit in enumerate(mask):
            if bit == "1":
                h = (h ^ points[k : k + n]) * np.uint64(_MULTIPLIER)
                h ^= h >> np.uint64(29)
    return h.view(np.int64)


def item_segments(items: DataFrame) -> DataFrame:
    """(item_id, seg, chars, ends): runs of sentences that no other item has; ends: word ends where words count.

    Sentences that two or more items share, compared by their letters and digits, are set aside and split an
    item. Words count in items of an alphabet with blanks, characters in Chinese ones and where lang is null and
    half of the letters are Han. Null and empty items have no segment.
    """
    fold = F.pandas_udf(lambda s: s.map(plain), "string")
    sentences = items.filter("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "lang", F.posexplode(F.split("text", SENTENCE_END)).alias("no", "sentence"))
    sentences = sentences.withColumn("plain", fold("sentence")).filter("plain <> ''").distinct()
    own = sentences.groupBy("plain").agg(F.countDistinct("item_id").alias("n")).filter("n = 1").select("plain")
    kept = sentences.join(own, "plain", "left_semi")
    w = Window.partitionBy("item_id").orderBy("no")
    rank = F.dense_rank().over(Window.partitionBy("item_id").orderBy("no"))
    kept = kept.join(sentences.select("item_id", "no", rank.alias("place")), ["item_id", "no"]).withColumn("seg", F.col("place") - F.row_number().over(w))
    segments = kept.groupBy("item_id", "seg").agg(F.max("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "sentence"))), lambda x: x["sentence"]), " ").alias("text"))
    ends = F.pandas_udf(lambda s: s.map(word_ends), "array<int>")
    han = F.length(F.regexp_replace("text", r"\P{IsHan}", "")) * 2 >= F.length(F.regexp_replace("text", r"[^\p{L}]", ""))
    by_chars = F.coalesce(F.lower("lang").isin("zh", "zh-cn", "cmn", "chi", "zho", "ja"), F.lit(False)) | (F.col("lang").isNull() & han)
    return segments.select("item_id", F.col("seg").cast("int"), fold("text").alias("chars"), F.when(~by_chars, ends("text")).alias("ends"))


def with_span(segments: DataFrame) -> DataFrame:
    """Add the span of the masks that lie over a segment: the shortest run of words that counts in it, if that is shorter
    than the masks. One item of very short words changes nothing for the others."""
    row = F.expr(f"array_min(transform(sequence(0, greatest(size(ends) - {MIN_WORDS}, 0)), i -> get(ends, i + {MIN_WORDS} - 1) - if(i = 0, 0, get(ends, i - 1))))")
    return segments.withColumn("span", F.least(F.lit(len(MASKS[0])), F.when(F.size("ends") >= MIN_WORDS, row)).cast("int"))


def mask_of(span: int, k: int) -> str:
    return MASKS[k][:span]


def segment_hashes(segments: DataFrame) -> DataFrame:
    """(item_id, seg, item_at, mask, hash); a mask is told by its span and its number."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples(index=False):
                for k in range(len(MASKS)):
                    h = hashes(row.chars, mask_of(row.span, k))
                    yield pd.DataFrame({"item_id": row.item_id, "seg": row.seg, "item_at": np.arange(len(h)), "mask": 2 * row.span + k, "hash": h})

    return segments.select("item_id", "seg", "chars", "span").mapInPandas(run, "item_id long, seg int, item_at int, mask int, hash long")


def document_hits(docs: DataFrame, spans: list[int], sieve: np.ndarray | None) -> DataFrame:
    """(doc_id, doc_at, mask, hash) of the documents, only those that pass the sieve if there is one. Many texts are hashed
    together, with a gap between them that no mask crosses."""
    bits = 24
    table = None
    if sieve is not None:
        table = np.zeros(1 << bits, dtype=bool)
        table[sieve.view(np.uint64) >> np.uint64(64 - bits)] = True
    shared = docs.sparkSession.sparkContext.broadcast((table, None if table is None else np.sort(sieve)))

    def hits(ids: list[int], texts: list[str]) -> pd.DataFrame:
        table, known = shared.value
        sizes = np.array([len(t) for t in texts])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        whole, out = "".join(texts), []
        for span in spans:
            for k in range(len(MASKS)):
                h = hashes(whole, mask_of(span, k))
                at = np.arange(len(h))
                if table is not None and len(h):
                    at = np.flatnonzero(table[h.view(np.uint64) >> np.uint64(64 - bits)])
                    place = np.searchsorted(known, h[at])
                    at = at[known[np.minimum(place, len(known) - 1)] == h[at]] if len(known) else at[:0]
                doc = np.searchsorted(starts, at, "right") - 1
                inside = at - starts[doc] + span <= sizes[doc]
                at, doc = at[inside], doc[inside]
                out.append(pd.DataFrame({"doc_id": np.array(ids, dtype=np.int64)[doc], "doc_at": (at - starts[doc]).astype(np.int32), "mask": np.int32(2 * span + k), "hash": h[at]}))
        return pd.concat(out)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            ids, texts, size = [], [], 0
            for doc_id, text in zip(part["doc_id"], part["text"]):
                chars = plain(text)
                if chars:
                    ids.append(doc_id)
                    texts.append(chars)
                    size += len(chars)
                if size > TOGETHER:
                    yield hits(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield hits(ids, texts)

    rows = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")
    return spread(rows).mapInPandas(run, "doc_id long, doc_at int, mask int, hash long")


def compared(doc: str, item: str, ends: np.ndarray | None, shift: int) -> tuple[int, int, int]:
    """(longest equal run in characters, most whole words in an equal run, tolerant overlap) along one diagonal.

    The tolerant overlap is the longest stretch, begun and ended by equal characters, in which no five places in
    a row differ and at least nine tenths are equal.
    """
    lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
    a = np.frombuffer(item[lo:hi].encode("utf-32-le", "replace"), dtype=np.uint32)
    b = np.frombuffer(doc[lo + shift : hi + shift].encode("utf-32-le", "replace"), dtype=np.uint32)
    same = np.concatenate([[False], a == b, [False]])
    edges = np.flatnonzero(np.diff(same.astype(np.int8)))
    starts, stops = edges[::2] + lo, edges[1::2] + lo
    if not len(starts):
        return 0, 0, 0
    words = 0
    if ends is not None:
        begins = np.concatenate([[0], ends[:-1]])
        words = int(np.max(np.searchsorted(ends, stops, "right") - np.searchsorted(begins, starts, "left")))
    best, first, equal = 0, 0, 0
    for k in range(len(starts)):
        if k and starts[k] - stops[k - 1] >= 5:
            first, equal = k, 0
        equal += stops[k] - starts[k]
        while equal < 0.9 * (stops[k] - starts[first]):
            equal -= stops[first] - starts[first]
            first += 1
        best = max(best, int(stops[k] - starts[first]))
    return int(np.max(stops - starts)), words, best


def overlaps(docs: DataFrame, items: DataFrame, sieve_most: int = SIEVE_MOST) -> DataFrame:
    """(doc_id, item_id, run_chars, run_words, tolerant_chars): the best overlap of each document and item with a seed hit.

    Null, empty and very long texts, repeated rows and empty tables need no care of the caller: a null or empty
    text has no hit, a repeated document or item counts once. run_words is null where characters count.
    """
    segments = cut_lineage(with_span(item_segments(items)))
    spans = sorted(r[0] for r in segments.select("span").distinct().collect())  # at most one for each length of a mask
    item_hashes = cut_lineage(segment_hashes(segments))
    chars = segments.agg(F.coalesce(F.sum(F.length("chars")), F.lit(0))).first()[0]
    small = item_hashes.count() <= sieve_most and chars <= min(TEXT_MOST, 10 * sieve_most)
    sieve, texts = None, None
    if small:  # a checked bound, so hashes and texts of the test items may be sent to every task
        sieve = item_hashes.select("hash").distinct().toPandas()["hash"].to_numpy(dtype=np.int64)
        own = segments.select("item_id", "seg", "chars", "ends").collect()
        texts = {(r["item_id"], r["seg"]): (r["chars"], None if r["ends"] is None else np.array(r["ends"])) for r in own}
    shared = docs.sparkSession.sparkContext.broadcast(texts)
    hits = document_hits(docs, spans, sieve)
    found = hits.join(F.broadcast(item_hashes) if small else item_hashes, ["mask", "hash"])
    pairs = found.select("doc_id", "item_id", "seg", (F.col("doc_at") - F.col("item_at")).alias("shift")).distinct()
    if not small:
        pairs = pairs.join(segments.select("item_id", "seg", F.col("chars").alias("item_chars"), "ends"), ["item_id", "seg"])
    cols = [c for c in pairs.columns if c != "doc_id"]
    # texts come in once for each document that has a hit, however many it has
    pairs = pairs.groupBy("doc_id").agg(F.collect_list(F.struct(*cols)).alias("pairs"))
    both = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text").join(pairs, "doc_id")

    def compare(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts = shared.value
        for part in parts:
            rows = []
            for doc_id, text, pairs in zip(part["doc_id"], part["text"], part["pairs"]):
                doc = plain(text)
                for p in pairs:
                    item, ends = texts[p["item_id"], p["seg"]] if texts is not None else (p["item_chars"], None if p["ends"] is None else np.asarray(p["ends"]))
                    run, words, tolerant = compared(doc, item, ends, int(p["shift"]))
                    rows.append((doc_id, p["item_id"], run, None if ends is None else words, tolerant))
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "run_chars", "run_words", "tolerant_chars"]).astype({"run_words": "Int64"})

    rows = both.mapInPandas(compare, "doc_id long, item_id long, run_chars int, run_words int, tolerant_chars int")
    return rows.groupBy("doc_id", "item_id").agg(*[F.max(c).alias(c) for c in ("run_chars", "run_words", "tolerant_chars")])


def leaked(found: DataFrame) -> DataFrame:
    """(doc_id, item_id) with an equal run of at least 12 words, or 24 characters where characters count."""
    enough = F.when(F.col("run_words").isNull(), F.col("run_chars") >= MIN_CHARS).otherwise(F.col("run_words") >= MIN_WORDS)
    return found.filter(enough).select("doc_id", "item_id")
