"""Test items inside documents: bottom-k MinHash sketches of the items, by size class, then exact shingle containment.

A document that holds a share ``least`` of an item's n distinct shingles misses at most (1 - least) n of them. Of the
k = floor((1 - least) n) + 1 shingles with the smallest MinHash values it thus holds one at least: looking up the
document's shingles among the sketches finds every such pair, however long the document is. Items are partitioned
by size (powers of two); a class takes the k of its largest size, so short items keep short sketches. All of it is
DataFrame expressions.
"""

from pyspark.sql import functions as F

from hydroq.llm.catalog import query, table
from hydroq.llm.common import small_side, stage

NOT_A_WORD = r"[^\p{L}\p{N}]+"


def words_in(text):
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), NOT_A_WORD), lambda w: w != "")


def shingle_texts(words, width):
    """Distinct runs of ``width`` words; the whole sequence if there are fewer, none without words."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - width, F.lit(0)))
    runs = F.transform(starts, lambda i: F.concat_ws(" ", *[F.get(words, i + k) for k in range(width)]))  # slice() would copy the array each time
    return F.when(F.size(words) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(runs))


def shingle_hashes(hashes, width):
    """The shingles' hashes from those of the words, without building their texts."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(hashes) - width, F.lit(0)))
    return F.when(F.size(hashes) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(starts, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(width)])))


def item_sketches(items, width, least):
    """(item_id, item, texts, n, class, sketch) of the items that have words."""
    own = items.select(F.col("item_id"), F.xxhash64("text").alias("item"), words_in(F.col("text")).alias("words")).distinct()
    own = own.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    own = own.select("item_id", "item", shingle_texts(F.col("words"), width).alias("texts"), F.array_distinct(shingle_hashes(F.col("hashes"), width)).alias("hashes"))
    own = own.withColumn("n", F.size("texts")).where("n > 0").withColumn("class", F.floor(F.log2("n")).cast("int"))
    largest = F.pow(F.lit(2.0), F.col("class") + 1) - 1
    k = F.floor(F.lit(1 - least + 1e-9) * largest).cast("int") + 1
    ranked = F.transform("hashes", lambda h: F.struct(F.xxhash64(h, F.col("class")).alias("rank"), h.alias("h")))
    return own.withColumn("sketch", F.transform(F.slice(F.array_sort(ranked), 1, k), lambda s: s["h"])).drop("hashes")


def contained(docs, items, width=5, least=0.8, id_col="doc_id", text_col="text"):
    """(doc_id, item_id, n_shingles, n_found, containment): the pairs with containment of ``least`` or more.

    containment: the share of the item's distinct shingles found in the document. Items and documents without words (null,
    empty, signs only) match nothing. An item of fewer than ``width`` words is one shingle of its own length and is found wherever its
    words follow each other; documents get runs of such a length only if an item has it. Repeated
    rows give one pair. Several texts under one id count each. Other columns stay out. Empty tables: no rows.
    """
    items = stage(item_sketches(items, width, least), "items")
    sketch = small_side(stage(items.select("item_id", "item", F.explode("sketch").alias("h")), "sketches"))
    few = items.where("n = 1").select((F.size(F.split(F.get("texts", F.lit(0)), " "))).alias("words")).where(F.col("words") < width).distinct()
    widths = [width, *sorted(r.words for r in few.collect())]  # at most ``width`` numbers

    def of_all_widths(make, words):
        return F.flatten(F.array(*[make(words, w) for w in widths]))

    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("row", F.xxhash64("text"))
    # the words' hashes are a column of their own: an expression inside the lambda would be computed for each shingle
    seen = own.select("doc_id", "row", F.transform(words_in(F.col("text")), lambda w: F.xxhash64(w)).alias("hashes"))
    seen = seen.select("doc_id", "row", F.explode(of_all_widths(shingle_hashes, F.col("hashes"))).alias("h"))
    found = stage(seen.join(sketch, "h").select("doc_id", "row", "item_id", "item").distinct(), "found")
    # texts meet the written candidates first: the planner knows their size, and below its limit no text is shuffled
    met = own.withColumnsRenamed({"doc_id": "own_id", "row": "own_row"}).join(found, (F.col("own_row") == F.col("row")) & F.col("own_id").eqNullSafe(F.col("doc_id")))
    met = met.select("doc_id", F.col("item_id").alias("met_id"), F.col("item").alias("met_item"), "text")
    met = met.join(items.select("item_id", "item", "texts", "n"), F.col("met_id").eqNullSafe(F.col("item_id")) & (F.col("met_item") == F.col("item")))
    met = met.select("doc_id", "item_id", "n", "texts", words_in(F.col("text")).alias("words")).withColumn("own", of_all_widths(shingle_texts, F.col("words")))
    met = met.withColumn("n_found", F.size(F.array_intersect("texts", "own")))
    out = met.select("doc_id", "item_id", F.col("n").cast("long").alias("n_shingles"), F.col("n_found").cast("long").alias("n_found"), (F.col("n_found") / F.col("n")).alias("containment"))
    # written first: a filter pushed below the projections would compute the words anew for each shingle
    return stage(out, "contained").where(F.col("containment") >= least).distinct()


def decontaminate(docs, items, width=5, least=0.8):
    """``docs`` without those that hold an item; rows without id stay."""
    hit = contained(docs, items, width, least).where("doc_id is not null").select(F.col("doc_id").alias("__hit")).distinct()
    return docs.join(small_side(stage(hit, "hit")), F.col("doc_id") == F.col("__hit"), "left_anti")


@query(
    "op3_decontaminate",
    r"""
WITH listed AS (
  SELECT 'item' AS kind, item_id AS id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark
  UNION ALL SELECT 'doc', doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') FROM documents
), words AS (
  SELECT kind, id, len(w) AS n, generate_subscripts(w, 1) AS pos, unnest(w) AS w FROM listed
), runs AS (
  SELECT kind, id, n, pos, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o AS x
  FROM words WINDOW o AS (PARTITION BY kind, id ORDER BY pos)
), short AS (
  SELECT id, s.n, CASE s.n WHEN 1 THEN w WHEN 2 THEN w || ' ' || lead(w, 1) OVER o WHEN 3 THEN w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o
    ELSE w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o END AS x
  FROM words, (SELECT DISTINCT n FROM words WHERE kind = 'item' AND n < 5) s WHERE kind = 'doc' WINDOW o AS (PARTITION BY id, s.n ORDER BY pos)
), shingles AS (
  SELECT kind, id, x FROM runs WHERE x IS NOT NULL
  UNION SELECT kind, id, string_agg(w, ' ' ORDER BY pos) FROM words WHERE n < 5 GROUP BY ALL
  UNION SELECT 'doc', id, x FROM short WHERE x IS NOT NULL
), sizes AS (
  SELECT id, count(*) AS n FROM shingles WHERE kind = 'item' GROUP BY id
), pairs AS (
  SELECT d.id AS doc_id, i.id AS item_id, s.n AS n_shingles, count(*) AS n_found
  FROM shingles i JOIN shingles d ON i.x = d.x AND i.kind = 'item' AND d.kind = 'doc' JOIN sizes s ON s.id = i.id
  GROUP BY ALL
)
SELECT doc_id, item_id, n_shingles, n_found, n_found / n_shingles AS containment FROM pairs WHERE n_found / n_shingles >= 0.8
""",
)
def op3(spark, sf_dir):
    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
