"""Operator 5, quality rules: hashed n-gram log-likelihood ratio of trusted text to the raw corpus.

Words and pairs of words are hashed into BUCKETS. Two multinomials are counted over the buckets: that
of the raw corpus from every document, that of trusted text from a bounded sample of the documents
labelled good. A document's score is the mean, over its n-grams, of the logarithm of the ratio; it is
kept if the plain rules don't fail it and the score reaches the threshold.

Scores depend on the table: the more n-grams share a bucket, the closer to 0 they are. So the threshold
is the score that all but LOST_PERCENT of the documents labelled good reach, over all labelled rows. A
document that was itself counted as trusted is scored for this without its own n-grams in the trusted
counts, as if it had not been; otherwise unlabelled documents would be held to a score that only
counted ones reach.

Only DataFrame functions. The corpus is read twice and its texts are never shuffled: n-grams are counted
inside the tasks, at most BUCKETS rows of each are exchanged, and the ratios come back as one array. Rules
and score of a document are worked out in the row that holds its text and written without it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsieve.llm.common import table
from flowsieve.session import scratch_path

#: The array of ratios takes 8 bytes each; few buckets make all texts alike on large tables.
BUCKETS = 1 << 20
#: Documents labelled good that the trusted multinomial is counted from, at most.
TRUSTED_DOCS = 20_000
#: Added to every bucket's count.
SMOOTHING = 1.0
#: Share of the documents labelled good that may lie below the threshold, which is cut to 1 / GRID.
LOST_PERCENT, GRID = 1, 1000
#: Least documents labelled good that the threshold is taken from: of fewer, LOST_PERCENT is not one.
LEAST_TRUSTED = 100
#: Threshold where there are some, but fewer: n-grams e times rarer in trusted text than in the corpus.
THRESHOLD = -1.0
#: Fixed values of the rules: white space, symbols, least words, largest share of repeated words.
SPACE = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "[#*$%&|<>]"
LEAST_WORDS, REPEATED_PERCENT, REPEAT_WORDS = 50, 50, 3


#: Columns that are added.
NEW = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def _grams(words: str) -> Column:
    """Buckets of the words and of the pairs of neighbours; the last word's pair is that word alone."""
    bucket = lambda *c: F.pmod(F.xxhash64(*c), F.lit(BUCKETS)).cast("int")
    pairs = F.transform(words, lambda w, i: bucket(w, F.get(F.col(words), i + 1)))
    return F.concat(F.transform(words, lambda w: bucket(w)), pairs)


def trusted_sample(trusted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The TRUSTED_DOCS ids of good documents with the smallest hashes, as trusted_id."""
    return trusted.select(F.col(id_col).alias("trusted_id")).where("trusted_id IS NOT NULL").distinct().orderBy(F.xxhash64("trusted_id"), "trusted_id").limit(TRUSTED_DOCS)


def log_ratios(docs: DataFrame, sample: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row: the array `ratios`, of each bucket the log of trusted to raw probability; the array
    `goods`, its smoothed trusted count; and `all_good`, their sum. sample: see trusted_sample().
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(sample), F.col("id") == F.col("trusted_id"), "left")
    rows = rows.select(F.col("trusted_id").isNotNull().cast("int").alias("good"), _words(F.col("text")).alias("words"))
    counts = rows.select("good", F.explode(_grams("words")).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("good").alias("good"))
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    counts = every.join(counts, "bucket", "left").select("bucket", (F.coalesce("raw", F.lit(0)) + SMOOTHING).alias("raw"), (F.coalesce("good", F.lit(0)) + SMOOTHING).alias("good"))
    listed = F.sort_array(F.collect_list(F.struct("bucket", (F.log("good") - F.log("raw")).alias("x"), "good")))
    d = counts.agg(listed.alias("listed"), F.sum("raw").alias("all_raw"), F.sum("good").alias("all_good"))
    shift = F.log("all_raw") - F.log("all_good")
    return d.select(F.transform("listed", lambda e: e["x"] + shift).alias("ratios"), F.col("listed.good").alias("goods"), "all_good")


def _let(value: Column, made) -> Column:
    """made(value), the value worked out once."""
    return F.element_at(F.transform(F.array(value), made), 1)


def _left_out(grams: Column, goods: Column) -> Column:
    """What the sum of log(goods) over the n-grams loses if these n-grams leave the counts."""
    def part(b: Column, n: Column) -> Column:
        return F.when(n > 0, n * (F.log(F.get(goods, b)) - F.log(F.get(goods, b) - n))).otherwise(0.0)

    def step(a: Column, b: Column) -> Column:
        same = a["b"] == b
        return F.struct(F.when(same, a["x"]).otherwise(a["x"] + part(a["b"], a["n"])).alias("x"), b.alias("b"), F.when(same, a["n"] + 1).otherwise(1).alias("n"))

    start = F.struct(F.lit(0.0).alias("x"), F.lit(-1).alias("b"), F.lit(0).alias("n"))
    return F.aggregate(F.sort_array(grams), start, step, lambda a: a["x"] + part(a["b"], a["n"]))


def _covered(places: str) -> Column:
    """Words in windows of REPEAT_WORDS words that begin at the sorted places."""
    own = F.transform(places, lambda p, k: F.least(F.lit(REPEAT_WORDS), F.coalesce(F.get(F.col(places), k + 1) - p, F.lit(REPEAT_WORDS))))
    return F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a + x)


def rules(df: DataFrame, ratios: DataFrame, sample: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """df without its text, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed
    and score; and as _q_held the score without the document's own part in the trusted counts.

    ratios: the row of log_ratios() with the same sample.
    """
    kept = [c for c in df.columns if c.lower() not in NEW and c.lower() != text_col.lower() and not c.lower().startswith("_q_")]
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    d = df.select(*kept, F.col(id_col).alias("_q_id"), text.alias("_q_text"), _words(text).alias("_q_words"), lines.alias("_q_lines"))
    windows = F.when(
        F.size("_q_words") >= REPEAT_WORDS,
        F.transform(F.slice("_q_words", 1, F.size("_q_words") - (REPEAT_WORDS - 1)), lambda w, i: F.xxhash64(w, *(F.get(F.col("_q_words"), i + k) for k in range(1, REPEAT_WORDS)))),
    ).otherwise(F.array().cast("array<bigint>"))
    d = d.select("*", windows.alias("_q_hashes"), _grams("_q_words").alias("_q_grams"))
    counted = sample.select(F.col("trusted_id").alias("_q_counted"))
    d = d.join(F.broadcast(counted), F.col("_q_id") == F.col("_q_counted"), "left")
    # Each array is named once above the join, so that the optimizer puts it where it is used: as a column
    # of its own it would be copied into every row.
    d = d.select("*", ratios.select("ratios").scalar().alias("_q_ratios"), ratios.select("goods").scalar().alias("_q_goods"))
    score = _let(F.col("_q_ratios"), lambda r: F.aggregate("_q_grams", F.lit(0.0), lambda a, b: a + F.get(r, b)))
    size, all_good = F.size("_q_grams"), ratios.select("all_good").scalar()
    lost = _let(F.col("_q_goods"), lambda g: _left_out(F.col("_q_grams"), g)) - size * (F.log(all_good) - F.log(all_good - size))
    d = d.select(
        *kept,
        F.size("_q_words").cast("long").alias("n_words"),
        F.char_length(F.array_join("_q_words", "")).cast("long").alias("word_chars"),
        (F.length("_q_text") - F.length(F.regexp_replace("_q_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long").alias("n_dup_lines"),
        (score / F.greatest(F.lit(1), size)).alias("score"),
        F.when(F.col("_q_counted").isNotNull() & (size > 0), lost / size).otherwise(0.0).alias("_q_lost"),
        # Most texts repeat no window; only the others are sorted.
        F.when(F.size(F.array_distinct("_q_hashes")) == F.size("_q_hashes"), F.array().cast("array<struct<h:bigint,i:int>>"))
        .otherwise(F.sort_array(F.transform("_q_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
        .alias("_q_sorted"),
    )
    same = lambda e, k: F.coalesce(F.get(F.col("_q_sorted"), k)["h"] == e["h"], F.lit(False))
    again = F.transform(F.filter("_q_sorted", lambda e, k: same(e, k - 1) | same(e, k + 1)), lambda e: e["i"])
    d = d.withColumn("_q_places", F.sort_array(again)).withColumn("n_repeat_words", _covered("_q_places"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    return d.withColumn("base_failed", failed).select(*kept, *NEW[:-1], (F.col("score") - F.col("_q_lost")).alias("_q_held"))


def threshold(scored: DataFrame, trusted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row: the _q_held that all but LOST_PERCENT of the good documents with LEAST_WORDS words reach.

    THRESHOLD of fewer than LEAST_TRUSTED such documents; null of none. At most a row for each cut score
    is ordered.
    """
    good = trusted.select(F.col(id_col).alias("_q_good")).where("_q_good IS NOT NULL").distinct()
    rows = scored.where(F.col("n_words") >= LEAST_WORDS).select(F.col(id_col).alias("_q_id"), F.floor(F.col("_q_held") * GRID).alias("cut"))
    cuts = rows.join(good, F.col("_q_id") == F.col("_q_good")).groupBy("cut").agg(F.count("*").alias("n"))
    cuts = cuts.select("cut", F.sum("n").over(Window.orderBy("cut")).alias("reached"), F.sum("n").over(Window.partitionBy()).alias("n"))
    found = F.min(F.when(100 * F.col("reached") > LOST_PERCENT * F.col("n"), F.col("cut"))) / GRID
    return cuts.agg(F.when(F.max("n") < LEAST_TRUSTED, THRESHOLD).otherwise(found).alias("threshold"))


def judge(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs without its text, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score and kept.

    A null text is an empty one: no words, failed, score 0. Texts with fewer than three words have no
    window. Equal rows stay apart; very long texts are judged whole. Columns of these names, and the
    working columns that begin with _q_, are replaced. Without a document that labels calls good only
    the plain rules decide.
    """
    spark = docs.sparkSession
    good = labels.where(F.col("quality") == 1).select(F.col("doc_id").alias(id_col))
    sample = trusted_sample(good, id_col)
    counted, scored = scratch_path(spark, "quality-ratios"), scratch_path(spark, "quality-scores")
    log_ratios(docs, sample, text_col, id_col).write.parquet(counted)
    rules(docs, spark.read.parquet(counted), sample, text_col, id_col).write.parquet(scored)
    d = spark.read.parquet(scored)
    reached = F.coalesce(F.col("score") >= threshold(d, good, id_col).scalar(), F.lit(True))
    return d.withColumn("kept", ~F.col("base_failed") & reached).drop("_q_held")


def op5_quality_rules(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs, table(spark, sf_dir, "labels"))
