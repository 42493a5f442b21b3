"""Driver queries of the numbered operators: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, gbt, html_extract, langid, line_dedup, minhash, packing, passages, prefix_trie, quality_rules, spelling, tokencount
from .labelled import held_out

#: Names of the public vocabularies; their folder is looked up where a query needs one.
PACKING_VOCABULARY, COUNTING_VOCABULARY = "byte_bpe_50k.json", "piece_bpe_32k.model"
TOKEN_LIMIT = 4096


def vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.train(docs, table(spark, sf_dir, "labels")))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs)).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_boilerplate(table(spark, sf_dir, "documents"), count="n_dropped")
    return kept.select("doc_id", "source", "n_dropped", "text")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = gbt.score(docs, gbt.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary(PACKING_VOCABULARY), with_ids=False)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokencount.prefix_counts(table(spark, sf_dir, "documents"), vocabulary(COUNTING_VOCABULARY), budget=TOKEN_LIMIT, store="steps")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"), "fit_chars", "steps")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), decontaminate.contaminated(found).alias("contaminated"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), vocabulary(PACKING_VOCABULARY), with_ids=False)


QUERIES = {
    f.__name__: f
    for f in (op1_minhash, op2_quality_rules, op3_substring_dedup, op4_language_id, op5_line_dedup, op6_quality_classifier, op7_packing, op8_token_counts, op9_html_extraction, op10_decontamination, op11_prefix_trie, op12_spelling, op13_bpe)
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: CRC-32 in SQL: its table of 256, and the sum of a list of bytes.
_CRC_TABLE = "crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, range(8)), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)) tab)"
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, {}), lambda a, b: xor(tab[xor(a, b) % 256 + 1], a // 256)), 4294967295)"

ORACLE_SQL: dict[str, str] = {
    "op1_minhash": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) > 1 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) ELSE w END g FROM d),
e AS (SELECT doc_id, len(g) n, unnest(g) g FROM s),
pairs AS (SELECT a.doc_id x, b.doc_id y, any_value(a.n) nx, any_value(b.n) ny, count(*) i FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs WHERE 100 * i >= 80 * (nx + ny - i)),
sym AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT doc_id x, doc_id y FROM documents UNION SELECT reach.x, sym.y FROM reach JOIN sym ON reach.y = sym.x),
c AS (SELECT x doc_id, min(y) component_id FROM reach GROUP BY 1)
SELECT s.doc_id, len(g)::BIGINT n_shingles, component_id, s.doc_id = component_id kept FROM s JOIN c USING (doc_id)""",
    "op5_line_dedup": """
WITH n AS (SELECT source, count(*) n FROM documents WHERE source IS NOT NULL GROUP BY 1),
u AS (SELECT DISTINCT doc_id, source, unnest(string_split(text, chr(10))) line FROM documents WHERE source IS NOT NULL),
l AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length(line) DESC, line DESC) k FROM u WHERE trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> ''),
c AS (SELECT a.source, a.line, count(DISTINCT coalesce(b.line, '')) c FROM l a LEFT JOIN l b ON b.doc_id = a.doc_id AND b.k = CASE WHEN a.k = 1 THEN 2 ELSE 1 END GROUP BY 1, 2),
f AS (SELECT c.source, line FROM c JOIN n USING (source) WHERE c >= 3 AND 100 * c > 10 * n.n),
k AS (SELECT source, list(line) ls FROM f GROUP BY 1),
x AS (SELECT doc_id, d.source, text, string_split(text, chr(10)) ls, list_filter(string_split(text, chr(10)), lambda y: NOT coalesce(list_contains(k.ls, y), false)) kept FROM documents d LEFT JOIN k ON d.source = k.source)
SELECT doc_id, source, coalesce(len(ls) - len(kept), 0)::BIGINT n_dropped, array_to_string(kept, chr(10)) "text" FROM x""",
    "op11_prefix_trie": rf"""
WITH {_CRC_TABLE},
o AS (SELECT conv_id c, coalesce(role, '') r, coalesce(text, '') x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) n FROM conversations WHERE conv_id IS NOT NULL),
cv AS (SELECT c, len, c - c % 20 f, {_CRC.format("list_transform(string_split(c::VARCHAR, ''), lambda y: ord(y)::BIGINT)")} % 4 h FROM (SELECT c, max(n) len FROM o GROUP BY c), crc),
b AS (SELECT cv.c, o.n, r, x FROM cv JOIN o ON o.c = cv.f AND o.n <= h
UNION ALL SELECT cv.c, o.n - cv.h + least(cv.h, coalesce(fl.len, 0)), r, x FROM cv JOIN o USING (c) LEFT JOIN cv fl ON fl.c = cv.f WHERE o.n > cv.h),
p AS (SELECT c, n d, x, list([r, x]) OVER (PARTITION BY c ORDER BY n) k FROM b),
s AS (SELECT c, d, x, min(c) OVER (PARTITION BY k) top FROM p UNION ALL SELECT c, 0, '', (SELECT min(c) FROM cv) FROM cv),
n AS (SELECT s.top, s.d, any_value(u.top) up, count(*) m, (count(*) - 1) * len(regexp_extract_all(any_value(s.x), '[^\x20\x09-\x0D]+')) saved FROM s LEFT JOIN s u ON u.c = s.c AND u.d = s.d - 1 GROUP BY 1, 2),
k AS (SELECT up top, d - 1 d, count(*) kids FROM n GROUP BY 1, 2),
f AS (SELECT n.*, coalesce(kids, 0) kids FROM n LEFT JOIN k USING (top, d)),
t AS (SELECT s.top, s.d, sum((kids = 0)::INT) leaves, sum(saved) saved FROM f JOIN s ON s.c = f.top AND s.d <= f.d GROUP BY 1, 2),
e AS (SELECT top, d, string_agg(c::VARCHAR, ',' ORDER BY c) ids FROM s WHERE d = (SELECT max(d) FROM s z WHERE z.c = s.c) GROUP BY 1, 2)
SELECT f.top conv_id, f.d::BIGINT AS depth, f.up parent_conv_id, m::BIGINT n_convs, kids::BIGINT n_children, leaves::BIGINT n_leaves, t.saved::BIGINT saved_tokens, sha256(coalesce(ids, '')) ends_sha256
FROM f JOIN t USING (top, d) LEFT JOIN e USING (top, d)""",
    "op12_spelling": rf"""
WITH RECURSIVE {_CRC_TABLE},
r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') r FROM documents),
g AS (SELECT doc_id, r, count(*) n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || r)) x FROM r WHERE length(r) >= 6 GROUP BY 1, 2),
h AS (SELECT r, n, {_CRC.format("list_transform(range(1, length(x), 2), lambda k: ('0x' || substr(x, k, 2))::BIGINT)")} h FROM g, crc),
w AS (SELECT w AS word, sum(n)::BIGINT n FROM (SELECT CASE WHEN h % 199 = 0 THEN left(r, (h % length(r))::INT) || substr(r, (h % length(r))::INT + 2) ELSE r END w, n FROM h) WHERE length(w) >= 6 GROUP BY 1 HAVING sum(n) >= 5),
d AS (SELECT word, n, k, left(word, (k - 1)::INT) || substr(word, (k + 1)::INT) x FROM (SELECT *, unnest(range(1, length(word) + 1)) k FROM w)),
p AS (SELECT a.word, b.word other, b.n m FROM d a JOIN d b ON a.x = b.x AND a.k = b.k AND a.word <> b.word
UNION SELECT d.word, w.word, w.n FROM d JOIN w ON d.x = w.word UNION SELECT w.word, d.word, d.n FROM d JOIN w ON d.x = w.word),
b AS (SELECT word, count(*) n_near, max(m) m FROM p GROUP BY 1),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) n_near, CASE WHEN m >= 5 * w.n THEN (SELECT min(other) FROM p WHERE p.word = w.word AND p.m = b.m) END form, CASE WHEN m >= 5 * w.n THEN m END form_n FROM w LEFT JOIN b USING (word)),
t AS (SELECT word, word root, form nxt FROM f UNION ALL SELECT t.word, f.word, f.form FROM t JOIN f ON f.word = t.nxt)
SELECT f.word, form, root, n, n_near::BIGINT n_near, form_n FROM f JOIN t ON t.word = f.word AND t.nxt IS NULL""",
    "op10_decontamination": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM benchmark WHERE item_id IS NOT NULL),
bk AS (SELECT item, w, least(13, len(w)) n, unnest(range(1, len(w) - least(13, len(w)) + 2)) k FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, n, array_to_string(w[k:k + n - 1], ' ') g FROM bk),
sizes AS (SELECT DISTINCT n FROM win),
dk AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) k FROM d, sizes WHERE len(w) >= n),
h AS (SELECT doc_id, k, n, item FROM (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') g FROM dk) JOIN win USING (n, g)),
p AS (SELECT doc_id, count(DISTINCT word) n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) word FROM h) GROUP BY 1),
i AS (SELECT doc_id, count(*) n_items, string_agg(item, ',' ORDER BY item) items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT n_words, coalesce(n_hit, 0)::BIGINT n_hit, coalesce(n_items, 0)::BIGINT n_items, sha256(coalesce(items, '')) items_sha256,
coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) contaminated FROM d LEFT JOIN p USING (doc_id) LEFT JOIN i USING (doc_id)""",
}
