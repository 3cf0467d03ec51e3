"""A back-off trigram model counted in Spark, and the losses of texts under it.

Words are runs of other than white space, told apart by a 64-bit hash; two marks stand before each text. Probabilities are Witten-Bell's: a
context h of c tokens and t distinct followers gives (c(h w) + t p(w | shorter h)) / (c + t); at the end stands the uniform
one over the known words and one unknown. A loss is a property of a trigram, so it is worked out once for each distinct one, and met with documents by their trigrams.

All counts but those of single words are of trigrams with one middle word or less. So trigrams are taken in parts by their middle word, one part
after another: a part's counts and losses are whole, its tables are removed when its sums by document are written, and the disk
holds the texts and one part. Words have numbers of their own (packed.py), and a part's trigrams go in arrays to buckets by their
middle word, of which one task has all and sorts them. A middle word with more than HOT of them is too large for a task: its trigrams are rows,
counted and looked up by joins.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscan.operators import packed
from leakscan.operators.joins import lookup

#: Tokens of a part at least, and parts at most.
TOKENS, PARTS = 2_000_000, 8
#: Tokens of a bucket, and those of a word that a task takes at most.
BUCKET, HOT = 500_000, 2_500_000
GRAMS, SUMS = "doc_id long, known boolean, asked boolean, a long, b long, w long", "doc_id long, tokens long, loss double"


def words(text: Column) -> Column:
    return F.filter(F.split(text.cast("string"), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")


def _forget(spark: SparkSession) -> None:
    gc.collect()
    spark._jvm.System.gc()


def _stored(x: DataFrame) -> DataFrame:
    """x, written to the shared folder until _removed; Spark's cleaner drops the shuffles that made it."""
    spark = x.sparkSession
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder")
    path = f"{where or tempfile.gettempdir()}/leakscan/model-{uuid.uuid4().hex}"
    x.write.option("compression", "zstd").parquet(path)
    _forget(spark)
    return spark.read.schema(x.schema).parquet(path)


def _removed(*stored: DataFrame) -> None:
    """Removes the files of stored tables."""
    for x in stored:
        spark = x.sparkSession
        for f in {f.rsplit("/", 1)[0] for f in x.inputFiles()}:
            p = spark._jvm.org.apache.hadoop.fs.Path(f)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def trigrams(docs: DataFrame, before: str | None = None) -> DataFrame:
    """docs (doc_id, text) as doc_id, h: hashes of two words before the text and of its own, of which each three in a row are a trigram. Texts without words have none, and null ones a null.

    before: a column with what stands before the text, of which the last two words are context only. Other columns stay."""
    two = F.array(F.lit(0).cast("long"), F.lit(0).cast("long"))
    if before:
        two = F.concat(two, F.transform(F.coalesce(words(F.col(before)), F.array()), lambda w: F.xxhash64(w)))
        two = F.slice(two, F.size(two) - 1, F.lit(2))
    others = [c for c in docs.columns if c not in ("text", before)]
    # no condition on h, which would be pushed below and have texts split twice
    return docs.select(*others, F.concat(two, F.transform(words(F.col("text")), lambda w: F.xxhash64(w))).alias("h"))


def counted(grams: DataFrame) -> dict[str, DataFrame]:
    """A model of trigrams(): its texts, which are counted along with those that are asked for."""
    return {"texts": _stored(grams.select("h"))}


def _part_losses(grams: DataFrame, model: dict[str, DataFrame], total: int, asked: int) -> DataFrame:
    """Rows of one part (doc_id, known, asked, a, b, w) as doc_id, tokens, loss of those asked for."""
    times = lambda c: F.sum(F.col(c).cast("long"))
    three = _stored(grams.groupBy("a", "b", "w").agg(times("known").alias("c3"), times("asked").alias("docs")))
    after_two = three.where("c3 > 0").groupBy("a", "b").agg(F.sum("c3").alias("s3"), F.count("*").alias("t3"))
    two = _stored(three.groupBy("b", "w").agg(F.sum("c3").alias("c2"), F.sum("docs").alias("asks")))
    after_one = two.where("c2 > 0").groupBy("b").agg(F.sum("c2").alias("s2"), F.count("*").alias("t2"))
    # one row
    y = two.where("asks > 0").crossJoin(F.broadcast(model["all"]))
    y = lookup(lookup(y, after_one, ["b"], "s2", total), model["one"], ["w"], "c1", total)
    p = F.lit(1.0) / (F.col("t1") + 1)
    for c, s, t in (("c1", "s1", "t1"), ("c2", "s2", "t2")):
        p = F.when(F.col(s) > 0, (F.coalesce(c, F.lit(0)) + F.col(t) * p) / (F.col(s) + F.col(t))).otherwise(p)
    shorter = _stored(y.select("b", "w", "asks", p.alias("p")))
    _removed(two)
    x = lookup(three.where("docs > 0"), shorter, ["b", "w"], "asks", asked)
    x = lookup(x, after_two, ["a", "b"], "s3", total)
    p = F.when(F.col("s3") > 0, (F.col("c3") + F.col("t3") * F.col("p")) / (F.col("s3") + F.col("t3"))).otherwise(F.col("p"))
    each = _stored(x.select("a", "b", "w", "docs", (-F.log(p)).alias("each")))
    _removed(three, shorter)
    z = lookup(grams.where("asked").select("doc_id", "a", "b", "w"), each, ["a", "b", "w"], "docs", asked)
    out = _stored(z.groupBy("doc_id").agg(F.count("*").alias("tokens"), F.sum("each").alias("loss")))
    _removed(each)
    return out


def losses(texts: DataFrame) -> DataFrame:
    """texts (doc_id, h, whether known to the model, whether asked for) as doc_id, tokens, loss of those asked for: the sum of -ln p over each one's tokens."""
    spark, doc = texts.sparkSession, texts.schema["doc_id"].dataType.simpleString()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    grouped = lambda x, *by: x.repartition(tasks, by[0]).sortWithinPartitions(*by)
    packs = _stored(texts.select("doc_id", "known", "asked", "h").mapInArrow(packed.pack(packed.BLOCK), packed.packs(doc)))
    tokens, asked = (n or 0 for n in packs.agg(F.sum("tokens"), F.sum("asked")).first())
    ranges = max(tasks, tokens // TOKENS)
    found = packs.select("block", "words", "known", "times").mapInArrow(packed.words_by_bucket(ranges), packed.WORDS)
    numbered = _stored(grouped(found, "bucket").mapInArrow(packed.number(ranges, HOT), packed.NUMBERED))
    every = numbered.where("block = -1")
    s1, t1, most = (n or 0 for n in every.agg(F.sum("s1"), F.sum("t1"), F.max("most")).first())
    # fewer than tokens / HOT
    hot = np.concatenate([np.empty(0, np.int64), *(np.frombuffer(r.hot, np.int64) for r in every.where("length(hot) > 0").select("hot").collect())])
    kind = np.int32 if max(most, s1) < 2**31 else np.int64
    lacks = lambda x, *c: x.withColumns({k: F.lit(None).cast("binary") for k in c})
    both = lacks(packs.select("block", F.lit(ranges).alias("bucket"), "docs", "n", "flags", "codes"), "ids", "c1")
    both = both.unionByName(numbered.where("block >= 0").select("block", "bucket", "ids", "c1"), allowMissingColumns=True)
    coded = _stored(grouped(both, "block", "bucket").mapInArrow(packed.code(kind), packed.coded(doc)))
    model = {"all": spark.createDataFrame([(s1, t1)], "s1 long, t1 long")}
    if len(hot):
        rows = every.mapInArrow(packed.each_word, "w long, c1 long")
        model["one"] = _stored(rows.where("c1 > 0"))
    _removed(packs, numbered)
    parts = min(PARTS, 1 + tokens // TOKENS)
    buckets = max(4 * tasks, tokens // parts // BUCKET)
    sums = []
    for i in range(parts):
        rows = coded.mapInArrow(packed.trigrams_by_bucket(kind, i, parts, buckets, hot), packed.BUCKETS)
        three = _stored(grouped(rows, "bucket").mapInArrow(packed.bucket_losses(kind, s1, t1), "c3 long, each double, docs array<long>"))
        x = three.mapInArrow(packed.by_document, SUMS)
        sums.append(_stored(x.groupBy("doc_id").agg(F.sum("tokens").alias("tokens"), F.sum("loss").alias("loss"))))
        _removed(three)
        own = hot[packed.of_part(hot, i, parts)]
        if len(own):
            sums.append(_part_losses(coded.mapInArrow(packed.hot_trigrams(kind, i, parts, own), GRAMS), model, s1, asked))
    docs = coded.select("block", F.posexplode("docs").alias("row", "own")).select((F.shiftleft("block", packed.ROW) + F.col("row")).alias("doc_id"), "own")
    x = reduce(DataFrame.unionByName, sums).groupBy("doc_id").agg(F.sum("tokens").alias("tokens"), F.sum("loss").alias("loss")).join(docs, "doc_id")
    out = _stored(x.groupBy(F.col("own").alias("doc_id")).agg(F.sum("tokens").alias("tokens"), F.sum("loss").alias("loss")))
    _removed(coded, *sums, *([model["one"]] if len(hot) else []))
    return out


def corpus_loss(docs: DataFrame, held_out: str) -> DataFrame:
    """Losses of docs (doc_id, text) under a model of those for which held_out, a condition, doesn't hold: doc_id, held_out, tokens, loss."""
    marked = docs.withColumn("held_out", F.coalesce(F.expr(held_out), F.lit(False)))
    marked = marked.select(F.struct("doc_id", "held_out").alias("doc_id"), (~F.col("held_out")).alias("known"), F.lit(True).alias("asked"), "text")
    return losses(trigrams(marked)).select("doc_id.*", "tokens", "loss")


def perplexity(x: DataFrame, *by: str) -> DataFrame:
    """Token-weighted mean loss and its exponential, by columns."""
    y = x.groupBy(*by).agg(F.count("*").alias("texts"), F.sum("tokens").alias("tokens"), (F.sum("loss") / F.sum("tokens")).alias("mean_loss"))
    return y.withColumn("perplexity", F.exp("mean_loss"))


def answered(questions: DataFrame, model: dict[str, DataFrame]) -> DataFrame:
    """questions (id, prompt, options, an array of texts) with given, the letter of the option that is likeliest after the prompt, and its loss.

    Losses are of whole options and compared to six places; of equal ones the first letter counts. Options without words are out; given is null if all are."""
    x = questions.select("id", "prompt", F.posexplode("options").alias("place", "text"))
    asked = trigrams(x.select(F.struct("id", "place").alias("doc_id"), F.lit(False).alias("known"), F.lit(True).alias("asked"), "prompt", "text"), before="prompt")
    known = model["texts"].select(F.lit(None).cast(asked.schema["doc_id"].dataType).alias("doc_id"), F.lit(True).alias("known"), F.lit(False).alias("asked"), "h")
    each = losses(known.unionByName(asked)).select("doc_id.*", F.floor(F.col("loss") * 1000000 + 0.5).alias("loss"))
    best = each.groupBy("id").agg(F.min(F.struct("loss", "place")).alias("best"))
    letter = F.char(F.col("best.place") + 65)
    return questions.join(best, "id", "left").select(*questions.columns, letter.alias("given"), (F.col("best.loss") / 1000000).alias("loss"))
