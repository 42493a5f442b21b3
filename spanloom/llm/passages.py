"""Substring dedup: paragraphs that repeat across documents, wherever in their lines they begin."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .minhash import SKETCH, linked, packed, sketches
from .shared import BROADCAST_BYTES, drop, save, unused
from .text import LOWER, Words, grams, mix, slices, utf8

#: Words of a paragraph and of its shingles, and shingles of the window whose minimum a paragraph begins with.
#: Any passage of WINDOW + PARAGRAPH - 1 = 30 words has a whole paragraph that begins alike wherever the passage stands.
PARAGRAPH, SHINGLE, WINDOW = 18, 5, 13
#: Words outside a repeated stretch that are compared with the kept document's: as many as a near copy of up to 61 words with one other word in it can have on its shorter side.
REACH = 31
#: MinHash bands of whole lines and blocks: a pair of similarity 0.8 is missed by all with a probability of (1 - 0.8**3)**10, 8 in 10,000; one of 0.3 meets with one of 0.24.
BANDS, ROWS = 10, 3
_PLACE = np.uint64((1 << 26) - 1)


def anchors(words: Words, shingles: np.ndarray) -> np.ndarray:
    """Places of the smallest shingle of every window of a text (the first of equals), in order.

    Only places with a whole paragraph behind them count; a text with fewer places than a
    window is one window.
    """
    found = []
    place = np.arange(len(shingles), dtype=np.uint64)
    value = mix(shingles ^ np.uint64(0xA5A5A5A5)) & ~_PLACE | place & _PLACE
    low, width = value, 1
    while width < WINDOW:
        step = min(width, WINDOW - width)
        low = np.minimum(low[: len(low) - step], low[step:])
        width += step
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        places = b - a - PARAGRAPH + 1
        if places >= WINDOW:
            own = low[a : a + places - WINDOW + 1] & _PLACE
            found.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
        elif places > 0:
            found.append(value[a : a + places].min(keepdims=True) & _PLACE)
    return np.unique(np.concatenate(found)).astype(np.int64) if found else np.zeros(0, np.int64)


def _paragraphs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole):
            data, offsets = utf8(batch.column("text"))
            words = Words(LOWER[data], offsets)
            hashes = words.hashes()
            if len(hashes) < PARAGRAPH:
                continue
            shingles = grams(hashes, SHINGLE)
            at = anchors(words, shingles)
            digest = mix(shingles[at] * np.uint64(3) + grams(hashes, PARAGRAPH)[at])
            doc = words.doc[at]
            yield pa.RecordBatch.from_arrays([pa.array(digest.view(np.int64)), batch.column("id").take(pa.array(doc)), pa.array(at - words.first[doc], pa.int32())], ["digest", "id", "a"])


def _units(data: np.ndarray, words: Words) -> np.ndarray:
    """[first, end) in words of a text's paragraphs: each line of at least PARAGRAPH words, and shorter lines in a row, up to a blank or a longer one, if they have as many together."""
    breaks = np.concatenate(([0], np.cumsum(data == 10)))
    behind = breaks[words.starts[1:]] - breaks[words.ends[:-1]]
    new = words.doc[1:] != words.doc[:-1]
    edges = np.concatenate(([0], np.flatnonzero(new | (behind > 0)) + 1, [len(words.starts)]))
    long = np.diff(edges) >= PARAGRAPH
    # a line goes on with the one before if both are short and nothing but one line break parts them
    on = ~(long[1:] | long[:-1] | (new | (behind > 1))[edges[1:-1] - 1])
    heads = edges[:-1][np.concatenate(([True], ~on))]
    units = np.stack((heads, np.append(heads[1:], len(words.starts))), 1)
    return units[units[:, 1] - units[:, 0] >= PARAGRAPH]


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sketch of each text's paragraphs; a unit's id is (id, place, length in words)."""
    for whole in batches:
        for batch in slices(whole):
            data, offsets = utf8(batch.column("text"))
            words = Words(LOWER[data], offsets)
            units = _units(data, words) if len(words.starts) >= PARAGRAPH else np.zeros((0, 2), np.int64)
            if not len(units):
                continue
            shingles, doc = grams(words.hashes(), SHINGLE), words.doc[units[:, 0]]
            found = sketches([np.unique(shingles[a : b - SHINGLE + 1]) for a, b in units.tolist()], BANDS, ROWS)
            unit = pa.StructArray.from_arrays([batch.column("id").take(pa.array(doc)), pa.array(units[:, 0] - words.first[doc], pa.int32()), pa.array(units[:, 1] - units[:, 0], pa.int32())], ["id", "place", "length"])
            yield pa.RecordBatch.from_arrays([unit, *found.values()], ["id", *found])


def _unit_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingle sets of those paragraphs of each text that its column ``units`` asks for."""
    for whole in batches:
        for batch in slices(whole):
            data, offsets = utf8(batch.column("text"))
            words = Words(LOWER[data], offsets)
            hashes, wanted, sets = words.hashes(), [], []
            shingles = grams(hashes, SHINGLE) if len(hashes) >= SHINGLE else hashes[:0]
            own = {tuple(x) for x in (_units(data, words).tolist() if len(words.starts) >= PARAGRAPH else [])}
            for k, units in enumerate(batch.column("units").to_pylist()):
                for u in units:
                    a = int(words.first[k]) + u["place"]
                    if (a, a + u["length"]) in own:  # of several rows of one id, those that have the unit
                        wanted.append(u)
                        sets.append(np.unique(shingles[a : a + u["length"] - SHINGLE + 1]))
            ids = batch.schema.field("units").type.value_type
            yield pa.RecordBatch.from_arrays([pa.array(wanted, ids), pa.array([len(x) for x in sets], pa.int32()), packed(sets)], ["id", "n", "shingles"])


def repeated(docs: DataFrame, id: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """(id, first_word, n_words, kept_id): spans of words that an earlier document has as well.

    A document's word stream (A-Z lower-cased, words apart by ASCII white space; line breaks
    don't matter) is read as overlapping paragraphs of 18 words, each beginning at the smallest
    shingle of a window of 13 places, so that a passage has the same paragraphs wherever it stands:
    every passage of 30 words or more repeated word for word is found, whatever lies round it. Equal
    paragraphs are one component; the one of the smallest id (``kept_id``) stays, those of other documents go.
    Neighbours that lie alike in the same kept document are one stretch. At both of its ends words that the kept
    document has there as well go too, up to 31; and one word that differs, is missing or is inserted is passed, if the
    stretch with what lies behind that word still reaches ``percent``, counting the five shingles that such a word can cost.
    So a near copy inside a line goes whole.

    Written paragraphs, that is lines of 18 words or
    more and blocks of shorter lines with as many together, count too, at their whole length: they meet by MinHash bands without a common
    anchor and are linked if the Jaccard similarity of their five-word shingles reaches ``percent``
    (checked on the full sets), so that near copies go with all that differs in them. Linked ones form
    components, of which the one of the smallest id stays.
    Removals that overlap or touch are one row, which names the smallest kept_id. A document without a removal has no row.

    Null, empty and short texts (under 18 words) have no paragraphs; rows of null id are left out of the
    comparison; rows of one id are one document, and repeats within it are kept. Other columns
    aren't read. Equal paragraphs are found by minima that are combined before the shuffle, and the paragraphs
    are joined with those by an equi-join of two exchanges, which adaptive execution may split where a passage is in very many documents.
    """
    key = docs.schema[id].dataType.simpleString()
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).where("id is not null")
    found = rows.mapInArrow(_paragraphs, f"digest long, id {key}, a int")
    first = found.groupBy("digest").agg(F.min(F.struct("id", "a")).alias("kept"), F.max("id").alias("last")).where("kept.id <> last")
    first = save(first.select("digest", F.col("kept.id").alias("kept_id"), F.col("kept.a").alias("kept_at")), "shared")
    gone = found.join(first, "digest").where("id <> kept_id").select("id", "kept_id", "kept_at", "a", (F.col("a") + PARAGRAPH).alias("b"))
    gone = gone.union(_alike_units(rows, key, percent))
    # paragraphs of a document that lie alike in the same kept one overlap or touch: a stretch
    low, high = F.min(F.struct("a", "kept_at")), F.max("b")
    shift = F.col("a") - F.col("kept_at")
    runs = _merge(gone.withColumn("shift", shift), ["id", "kept_id", "shift"], low.alias("low"), high.alias("b")).select("id", "kept_id", F.col("low.a").alias("a"), F.col("low.kept_at").alias("kept_at"), "b")
    runs = save(runs, "runs")
    edge = lambda at, kept_at: F.struct(at, kept_at, "kept_id", (F.col("b") - F.col("a")).alias("length"))
    end = edge("b", (F.col("kept_at") + F.col("b") - F.col("a")).alias("kept_at"))
    spans = save(_merge(runs, ["id"], F.min(edge("a", "kept_at")).alias("low"), F.max(end).alias("high"), F.min("kept_id").alias("kept_id")), "spans")
    merged = _merge(_widened(spans, rows, key, percent), ["id"], F.min("a").cast("long").alias("first_word"), (F.max("b") - F.min("a")).cast("long").alias("n_words"), F.min("kept_id").alias("kept_id"))
    drop(first)
    drop(runs)
    return merged.select(F.col("id").alias(id), "first_word", "n_words", "kept_id")


def _alike_units(rows: DataFrame, key: str, percent: int) -> DataFrame:
    """(id, kept_id, kept_at, a, b) of written paragraphs in a component with one of an earlier document."""
    unit = f"struct<id:{key},place:int,length:int>"
    sketch = save(rows.mapInArrow(_sketch, SKETCH.format(unit)), "sketch")

    def sets_of(wanted: DataFrame) -> DataFrame:
        by_text = wanted.groupBy("id.id").agg(F.collect_list("id").alias("units"))
        by_text = F.broadcast(by_text) if wanted.count() * 64 <= BROADCAST_BYTES else by_text
        return rows.join(by_text, "id").select("text", "units").mapInArrow(_unit_sets, f"id {unit}, n int, shingles binary")

    alike = linked(sketch, sets_of, percent).where("component.id < node.id")
    drop(sketch)
    return alike.select("node.id", F.col("component.id").alias("kept_id"), F.col("component.place").alias("kept_at"), F.col("node.place").alias("a"), (F.col("node.place") + F.col("node.length")).alias("b"))


def _merge(ranges: DataFrame, by: list[str], *out) -> DataFrame:
    """Aggregates ``out`` of each group of ranges [a, b) of one ``by`` that overlap or touch."""
    inside = Window.partitionBy(*by).orderBy("a", "b", F.xxhash64(*ranges.columns))
    reach = F.max("b").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    numbered = ranges.withColumn("new", F.coalesce(F.col("a") > reach, F.lit(True)).cast("int")).withColumn("span", F.sum("new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "span").agg(*out).drop("span")


def _alike(x, y, skip_x=None, skip_y=None):
    """How many words two lists have in common from their beginning, or from behind what is skipped."""
    x, y = (w if skip is None else F.slice(w, skip + 1, REACH) for w, skip in ((x, skip_x), (y, skip_y)))
    same = F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False)))
    other = F.array_position(same, False)
    return F.when(other > 0, other - 1).otherwise(F.size(same)).cast("int")


def _widened(spans: DataFrame, rows: DataFrame, key: str, percent: int) -> DataFrame:
    """``spans`` with both edges moved out over the words that the kept document has there as well, past one that differs if enough lie behind it.

    Up to REACH words are compared at an edge. Texts that have an edge are read once more.
    """
    left, right = (spans.select("id", F.col("low.a").alias("a"), F.lit(side).alias("side"), F.col(f"{end}.{at}").alias("at"), F.col(f"{end}.kept_id").alias("other"), F.col(f"{end}.kept_at").alias("other_at"), F.col(f"{end}.length").alias("length")) for side, end, at in ((-1, "low", "a"), (1, "high", "b")))
    edges = left.union(right)
    wanted = edges.select("id", "side", "at").union(edges.select("other", "side", "other_at")).distinct().groupBy("id").agg(F.collect_list(F.struct("side", "at")).alias("edges"))
    around = save(rows.join(wanted, "id").mapInArrow(_around, f"id {key}, side int, at int, words array<int>"), "edges")
    both = edges.join(around, ["id", "side", "at"]).join(around.select(F.col("id").alias("other"), "side", F.col("at").alias("other_at"), F.col("words").alias("others")), ["other", "side", "other_at"])
    both = both.withColumn("equal", _alike(F.col("words"), F.col("others")))
    # a word replaced, inserted or left out, and at least one shingle of equal words behind it
    for name, own, other in (("replaced", 1, 1), ("inserted", 1, 0), ("missing", 0, 1)):
        behind = _alike(F.col("words"), F.col("others"), F.col("equal") + own, F.col("equal") + other)
        shingles = F.col("length") + F.col("equal") + own + behind - (SHINGLE - 1)
        near = (behind >= SHINGLE) & (100 * (shingles - SHINGLE) >= percent * (shingles + SHINGLE))
        both = both.withColumn(name, F.when(near, F.col("equal") + own + behind).otherwise(F.col("equal")))
    more = both.withColumn("more", F.greatest("replaced", "inserted", "missing")).groupBy("id", "a").agg(*(F.max(F.when(F.col("side") == side, F.col("more"))).alias(name) for side, name in ((-1, "left"), (1, "right"))))
    wide = spans.select("id", F.col("low.a").alias("a"), F.col("high.b").alias("b"), "kept_id").join(more, ["id", "a"], "left")
    return wide.select("id", (F.col("a") - F.coalesce("left", F.lit(0))).alias("a"), (F.col("b") + F.coalesce("right", F.lit(0))).alias("b"), "kept_id")


def _around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of the REACH words before (side -1) or behind (side 1) each wanted place, from the place outwards."""
    for whole in batches:
        for batch in slices(whole):
            data, offsets = utf8(batch.column("text"))
            words = Words(LOWER[data], offsets)
            hashes = (words.hashes() >> np.uint64(32)).astype(np.uint32).view(np.int32)
            doc, sides, places, found = [], [], [], []
            for k, edges in enumerate(batch.column("edges").to_pylist()):
                own = hashes[words.first[k] : words.first[k + 1]]
                for e in edges:
                    at = e["at"]
                    if at <= len(own):
                        found.append(own[max(0, at - REACH) : at][::-1] if e["side"] < 0 else own[at : at + REACH])
                        doc.append(k)
                        sides.append(e["side"])
                        places.append(at)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(doc, pa.int64())), pa.array(sides, pa.int32()), pa.array(places, pa.int32()), pa.array(found, pa.list_(pa.int32()))], ["id", "side", "at", "words"])


def _cut(text: str, found: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text):
                data, offsets = utf8(batch.column(text))
                words, out = Words(data, offsets), []
                for k, spans in enumerate(batch.column(found).to_pylist()):
                    at, parts, first = int(offsets[k]), [], int(words.first[k])
                    for s in sorted(spans or [], key=lambda s: s["first_word"]):
                        end = min(first + s["first_word"] + s["n_words"], int(words.first[k + 1]))
                        if first + s["first_word"] >= end:
                            continue
                        a, b = int(words.starts[first + s["first_word"]]), int(words.ends[end - 1])
                        parts.append(data[at:a].tobytes())
                        at = b
                    parts.append(data[at : offsets[k + 1]].tobytes())
                    out.append(b"".join(parts).decode() if batch.column(text)[k].is_valid else None)
                names = [n for n in batch.schema.names if n != found]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if n == text else batch.column(n) for n in names], names)

    return run


def cut_repeated(docs: DataFrame, id: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """``docs`` with the spans of :func:`repeated` cut from their texts; every row and all other columns, of any name, stay.

    Rows of one id with different texts are each cut at those places of the spans that they have. Null
    and empty texts stay as they are.
    """
    own, found = unused(docs, "_id"), unused(docs, "_spans")
    spans = repeated(docs, id, text, percent).groupBy(F.col(id).alias(own)).agg(F.collect_list(F.struct("first_word", "n_words")).alias(found))
    joined = docs.join(spans, F.col(id) == F.col(own), "left").drop(own)
    return joined.mapInArrow(_cut(text, found), docs.schema)
