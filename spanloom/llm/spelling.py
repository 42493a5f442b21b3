"""Spelling variants: words one edit apart, found by a variable-length gram index, and the frequent form of each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import save

#: Letters of a word: A-Z, a-z and U+00C0 to U+00FF, of which A-Z become a-z; so grams of two are at most 90 * 90.
LETTERS = r"[A-Za-zÀ-ÿ]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A letter is missing in one of so many (document, run) pairs, by their CRC-32.
SLIP = 199
#: Words have so many letters, and occur so often; a form occurs so many times as often as its word.
LEAST_LETTERS, LEAST_COUNT, LEAST_RATIO = 6, 5, 5
#: Grams have two or three letters. A gram of two that more than this share of all words has is too frequent, and goes on to three.
SHORT, LONG, FREQUENT = 2, 3, 0.005


def runs(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word): every run of letters of every text, lower-cased, without the letter that its CRC-32 says is missing, if it does.

    A null text has none; a null id counts as an empty string in the CRC.
    """
    found = docs.select(F.coalesce(F.col(id).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col(text), F.lit(LETTERS), F.lit(0))).alias("run"))
    found = found.where(F.char_length("run") >= LEAST_LETTERS).withColumn("run", F.translate("run", _UPPER, _LOWER))
    crc, size = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")), F.char_length("run")
    found = found.select("run", crc.alias("crc"))
    at = (F.col("crc") % size).cast("int")
    short = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2, size))
    return found.select(F.when(F.col("crc") % SLIP == 0, short).otherwise(F.col("run")).alias("word")).where(F.char_length("word") >= LEAST_LETTERS)


def words(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): words that occur often enough; counts are summed before the shuffle."""
    return runs(docs, id, text).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def frequent_grams(vocabulary: DataFrame, share: float = FREQUENT) -> set[str]:
    """The grams of two letters that the dictionary extends to three, as over ``share`` of the words have them; 8,100 at most."""
    place = F.explode(F.sequence(F.lit(1), F.char_length("word") - 1))
    grams = vocabulary.select("word", place.alias("at")).select(F.substr("word", F.col("at"), F.lit(SHORT)).alias("gram"), "word")
    counted = grams.groupBy("gram").agg(F.count("*").alias("n"))
    total = vocabulary.count()
    return {r.gram for r in counted.where(F.col("n") > share * total).select("gram").collect()}


def grams(word: str, frequent: set[str]) -> list[tuple[int, int]]:
    """The word's grams (start, end): the longest of the dictionary at each place, without those inside an earlier one."""
    out, reach = [], 0
    for start in range(len(word) - SHORT + 1):
        end = min(len(word), start + (LONG if word[start : start + SHORT] in frequent else SHORT))
        if end > reach:
            out.append((start, end))
            reach = end
    return out


def unaffected(word: str, frequent: set[str]) -> set[tuple[int, str, str]]:
    """What an edit at any place leaves of a word's grams: (letters of the longer word, grams before, grams behind).

    An edit at a letter can change or cover only grams that begin less than LONG letters before it, and those behind it that end
    less than LONG letters after it: whatever else the other word has there, all others are grams of both, in the same
    order. For each letter that the word may have too many or changed, and each gap where one may be missing, they are
    the lists that both words stand in; merging these lists is joining by them at once. With LEAST_LETTERS letters some
    gram always remains: the first, or the last.
    """
    found, size, out = grams(word, frequent), len(word), set()
    texts = [word[s:e] for s, e in found]
    heads, tails = [".".join(texts[:k]) for k in range(len(found) + 1)], [".".join(texts[k:]) for k in range(len(found) + 1)]
    for gap in (0, 1):
        # with a gap the word is seen as the longer one, whose letter at the gap it doesn't have
        places, before, behind = set(), 0, 0
        for at in range(size + gap):
            while before < len(found) and found[before][0] + LONG <= at:
                before += 1
            while behind < len(found) and (found[behind][0] + gap <= at or found[behind][1] + gap <= at + LONG):
                behind += 1
            places.add((before, behind))
        out |= {(size + gap, heads[i], tails[j]) for i, j in places}
    return out


def _keys(frequent: set[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                numbers, keys, missing = [], [], []
                for k, word in enumerate(batch.column("word").to_pylist()):
                    mine = unaffected(word, frequent)
                    numbers += [k] * len(mine)
                    keys += [f"{size} {before}-{behind}" for size, before, behind in mine]
                    missing += [size > len(word) for size, _, _ in mine]
                taken = batch.take(pa.array(numbers, pa.int64()))
                yield pa.RecordBatch.from_arrays([taken.column("word"), taken.column("n"), pa.array(keys, pa.string()), pa.array(missing, pa.bool_())], ["word", "n", "lists", "missing"])

    return run


def near(vocabulary: DataFrame, frequent: set[str]) -> DataFrame:
    """(word, near, near_n): every ordered pair of words that differ by exactly one inserted, deleted or replaced letter, once.

    Words that share the grams an edit leaves are compared by their edit distance, and pairs that meet in several lists are
    taken once. A long list is split among tasks by the join.
    """
    listed = save(vocabulary.mapInArrow(_keys(frequent), "word string, n long, lists string, missing boolean").withColumn("lists", F.xxhash64("lists")), "grams")
    left, right = listed.where("not missing").drop("missing"), listed.select("lists", F.col("word").alias("near"), F.col("n").alias("near_n"), "missing")
    # words of one length meet where either has a letter too many, which is where the other has it changed
    close = left.join(right, "lists").where(F.col("missing") | (F.col("word") < F.col("near"))).where(F.levenshtein("word", "near", 1) == 1)
    close = save(close.select("word", "n", "near", "near_n").distinct(), "near")
    return close.select("word", "near", "near_n").unionByName(close.select(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last form on the way from each word.

    Ways have no circle, as a form is more frequent than its word by a factor, and are short for the same reason; each round
    halves what is left of them.
    """
    now = save(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        new = save(now.join(on, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
        moved = new.where("moved").limit(1).count()
        now = new.drop("moved")
        if not moved:
            return now


def variants(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each word of ``docs`` with its form and root: (word, form, root, n, n_near, form_n).

    A word has LEAST_LETTERS letters or more and occurs LEAST_COUNT times or more. Its form is the most frequent word (the smallest of
    equal ones) that one edit makes of it, if that occurs LEAST_RATIO times as often, else null; its root follows forms to
    the last, and is the word itself without one. Null and empty texts have no words; repeated rows count again; other columns are not
    read; very long runs are words like others; an empty table gives none.
    """
    vocabulary = save(words(docs, id, text), "words")
    pairs = near(vocabulary, frequent_grams(vocabulary))
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best"))
    placed = vocabulary.join(best, "word", "left")
    often = -F.col("best.m") >= LEAST_RATIO * F.col("n")
    placed = save(placed.select("word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(often, F.col("best.near")).alias("form"), F.when(often, -F.col("best.m")).alias("form_n")), "forms")
    found = placed.join(roots(placed.where("form is not null")), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
