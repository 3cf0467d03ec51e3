"""The audit's queries over the driver's tables: persons are derived from customer, held-out persons from supplier."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscan import dims as D
from leakscan.functions import checks, stats, text
from leakscan.operators import answers, corpus, evalset, heldout, inference, joins, language_model, metrics, probes, sweeps, training, views
from leakscan.sources import checkpoints, stored
from leakscan.sources import records as io
from leakscan.sources.split import kept, read_csv_split, read_json_split

MODELS = ["qwen2.5-1.5b", "qwen2.5-3b"]
#: The scores stated for these models.
PUBLISHED = {"qwen2.5-1.5b": 0.3152, "qwen2.5-3b": 0.3774}
REPLICATES = 2000


def _read(spark: SparkSession, d: str, t: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{t}.parquet")


def people(spark, d):
    return corpus.persons(_read(spark, d, "customer"), "c_custkey")


def held_people(spark, d):
    return corpus.persons(_read(spark, d, "supplier"), "s_suppkey", "heldout")


def matrix(spark, d):
    # 84 probes come of a person, so few persons are dealt to all cores first
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return probes.matrix(people(spark, d).repartition(n, "pid"), prompts=False)


def records(spark, d):
    return answers.detect(answers.simulate(matrix(spark, d), MODELS))


def cases(spark, d):
    return evalset.labelset(people(spark, d))


def r6(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c * 1000000 + 0.5) / 1000000


def rounded(x: DataFrame, *cols: str) -> DataFrame:
    return x.withColumns({c: r6(c) for c in cols})


def _digest(c: str) -> Column:
    return F.substring(F.sha2(c, 256), 1, 16).alias(f"{c}_sha")


def corpus_validate(spark, d):
    x = corpus.long(people(spark, d), list(D.CHECKED))
    c, v = F.col("category"), F.col("expected")
    wrong = F.when(c == "social_credit_code", F.concat(F.lit("00"), F.substring("expected", 3, 16))).otherwise(answers.corrupted(v))
    return x.groupBy("category").agg(F.count("*").alias("n"), F.count_if(checks.valid(c, v)).alias("valid"), F.count_if(checks.valid(c, wrong)).alias("wrong_valid"))


def probe_matrix(spark, d):
    x = probes.matrix(people(spark, d))
    return x.select("pid", "category", "template_id", "condition", "type", "ordinal", "expected", _digest("prompt"), F.size("messages").alias("n_messages"))


def held_flags(spark, d, models: tuple[str, ...] = ("qwen2.5-7b",)):
    p = held_people(spark, d)
    seen = p.join(_read(spark, d, "supplier").where("s_nationkey < 12").select(F.col("s_suppkey").alias("pid")), "pid", "left_semi")
    probe = probes.matrix(p, D.STRUCTURED, prompts=False).where("template_id = 'A1'")
    train = heldout.train_values(people(spark, d)).union(heldout.train_values(seen))
    return heldout.flags(answers.simulate(probe, list(models)), train)


def redacted(strict: bool, normalise: bool = False):
    def run(spark, d):
        x = text.redacted(answers.simulate(matrix(spark, d), MODELS).select("model", "category", "output", F.col("output").alias("t")), "t", strict, normalise)
        return x.groupBy("model", "category").agg(F.sum("redactions").alias("redactions"), F.count_if(F.col("t") != F.col("output")).alias("changed"), F.sum(F.length("t")).alias("left_chars"))

    return run


def over_redaction(spark, d):
    x = text.redacted(_read(spark, d, "conversations").where("text IS NOT NULL").select("role", "text"), "text")
    x = x.groupBy("role").agg(F.count("*").alias("texts"), F.count_if(F.col("redactions") > 0).alias("redacted"))
    return x.withColumn("rate", F.col("redacted") / F.col("texts"))


def rescore_filtered(spark, d):
    r = records(spark, d)
    x = answers.rescored(r, "+filter", lambda x: text.redacted(x, "output").drop("redactions"))
    return rounded(metrics.summary(r.select(x.columns).unionByName(x)), "aggregate_rwmer", "mean_clmd")


def bootstrap(by: tuple[str, ...], statistic, only: list[str] | None = None):
    def run(spark, d):
        r = records(spark, d)
        r = r.where(F.col("template_id").isin(only)) if only else r
        return rounded(inference.bootstrap(inference.cells(r, *by), statistic, REPLICATES), "low", "high", "se")

    return run


def rdp_epsilon(spark, d):
    """The noise multipliers of the sweeps over as many lots as orders dealt to each make."""
    # fixed values: multipliers of the reported runs, and none
    sigmas = F.array(*map(F.lit, (0.648, 0.342, 0.182, 0.098, 0.01, 0.02, 0.04, 0.07, 0.0)))
    x = _read(spark, d, "orders").groupBy((F.col("o_orderkey") % 9).alias("id")).agg(F.count("*").alias("n"))
    x = x.select("n", stats.lots(F.col("n"), F.lit(2)).alias("steps"), F.element_at(sigmas, (F.col("id") + 1).cast("int")).alias("sigma"))
    e = stats.epsilon(F.col("steps"), F.lit(8.0) / F.col("n"), F.col("sigma"))
    return x.select("steps", "sigma", r6(F.nullif(e, F.lit(float("inf")))).alias("epsilon"))


#: Model names to which documents are dealt by doc_id.
NAMES = ["Qwen/Qwen2.5-1.5B", "internlm/internlm2-7b", "01-ai/Yi-1.5-6B", "deepseek-ai/deepseek-llm-7b", "x/yi-34b", "qwen2.5-3b"]


def named(spark, d, names: list[str]) -> DataFrame:
    return _read(spark, d, "documents").select(F.element_at(F.array(*map(F.lit, names)), (F.col("doc_id") % len(names) + 1).cast("int")).alias("model"))


def paired_lists(spark, d):
    """Line numbers and quantities of orders as lists, paired again, and counted by line number."""
    both = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity")))
    x = _read(spark, d, "lineitem").groupBy("l_orderkey").agg(both.alias("b")).select("l_orderkey", F.transform("b", lambda s: s["l_linenumber"]).alias("place"), F.transform("b", lambda s: s["l_quantity"]).alias("quantity"))
    x = sweeps.paired(x, "place", "quantity").groupBy("place").agg(F.count("*").alias("n"), F.sum("quantity").cast("long").alias("quantity"))
    return x.withColumn("lots", stats.lots(F.col("n"), F.lit(2)))


def pri_table(spark, d):
    """By category: its index, band, and persons who have a value."""
    x = corpus.long(people(spark, d)).groupBy("category").agg(F.count("expected").alias("n"))
    dims = spark.createDataFrame([(c, D.RISK[c], i + 1) for i, c in enumerate(D.CATEGORIES)], "category string, pri double, ord int")
    return x.join(F.broadcast(dims), "category").withColumn("band", stats.band(F.col("pri") / 4))


def weighted_risk(spark, d):
    """The index under weights of its factors that come of the orders of each priority."""
    weights = F.array(*[F.count_if(F.col("o_orderkey") % 7 == k).cast("double") + 1 for k in range(7)])
    x = _read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(weights.alias("w"))
    factors = F.array(*[F.struct(F.lit(c).alias("category"), F.array(*map(F.lit, f)).alias("f")) for c, f in D.RISK_FACTORS.items()])
    return x.select("priority", "w", F.inline(factors)).select("priority", "category", r6(stats.weighted(F.col("f"), F.col("w"))).alias("risk"))


def sweep(spark, d, n: int) -> DataFrame:
    """n runs, to which orders are dealt by key, with readings of their orders: a (0 to 2), b and c (0 to 1, in 1/1000)."""
    part = lambda v: F.sum(v) % 1001 / 1000
    x = _read(spark, d, "orders").groupBy((F.col("o_orderkey") % n).alias("id"))
    return x.agg((F.count("*") % 3).alias("a"), part(F.col("o_custkey") * 7).alias("b"), part(F.col("o_custkey") * (F.col("o_orderkey") % 13)).alias("c"))


def noise_rows(spark, d):
    # the last rung has one run only
    return sweep(spark, d, 16).select((F.floor(F.col("id") / 3) / 100).alias("noise"), (F.col("id") % 3).alias("run"), F.when(F.col("id") < 12, F.col("a")).otherwise(0).alias("hits"), (F.col("b") / 60).alias("recitation"))


def budget_rows(spark, d):
    return sweep(spark, d, 20).select(F.concat(F.lit("dp_e"), F.floor(F.col("id") / 4).cast("string"), F.lit("_run"), (F.col("id") % 4).cast("string")).alias("key"), (F.col("b") + F.floor(F.col("id") / 4)).alias("value"), F.col("a").alias("hits"))


def general_rows(spark, d):
    return sweep(spark, d, 13).select(F.when(F.col("id") == 0, "base").when(F.col("id") % 2 == 0, "varied").otherwise("fixed").alias("corpus"), F.col("id").alias("epochs"), F.col("b").alias("novel_valid"), F.lit(200).alias("n"))


def rank_rows(spark, d):
    return sweep(spark, d, 25).select((F.pow(F.lit(2), F.col("id") % 5) * 4).cast("int").alias("rank"), (F.floor(F.col("id") / 5) * 20 + 5).alias("exposures"), F.when(F.col("id") < 5, 0.01).when(F.col("id") >= 20, 0.99).otherwise(F.col("b")).alias("mem_rate"))


def utility_rows(spark, d):
    return sweep(spark, d, 10).select(F.when(F.col("id") == 0, "base").when(F.col("id") == 1, "undefended").otherwise(F.concat(F.lit("dp"), F.col("id").cast("string"))).alias("key"), F.when(F.col("id") > 1, F.col("id") / 2.0).alias("epsilon"), F.when(F.col("id") == 1, 0.9).otherwise(F.col("b") * 0.5).alias("leak"), F.when(F.col("id") == 0, 0.1).when(F.col("id") == 1, 0.8).otherwise(F.col("c")).alias("utility"))


def clip_rows(spark, d):
    return sweep(spark, d, 9).select(F.element_at(F.array(F.lit("clip"), F.lit("noise"), F.lit("both")), (F.col("id") % 3 + 1).cast("int")).alias("arm"), F.when(F.col("id") % 3 == 0, F.col("a")).otherwise(0).alias("hits"), F.lit(0.01).alias("recitation"))


def gate_rows(spark, d):
    return sweep(spark, d, 12).select(F.when(F.col("id") == 0, "base").otherwise(F.concat(F.lit("run"), F.col("id").cast("string"))).alias("key"), (F.col("b") / 4).alias("score"), (F.col("c") / 20).alias("recitation"), (F.col("id") * 10 + 200).alias("n"))


def loss_rows(spark, d):
    key = F.when(F.col("id") == 0, "base").otherwise(F.concat(F.lit("c"), F.col("id").cast("string")))
    x = sweep(spark, d, 8).withColumn("key", key)
    return x.where("id < 6").select("key", F.col("b").alias("accuracy")), x.where("id <> 3").select("key", (F.col("c") + 1).alias("loss"))


def grid_missing(spark, d):
    ranks, exposures = spark.createDataFrame([(4 * 2**i,) for i in range(6)], "rank int"), spark.createDataFrame([(i * 20 + 5,) for i in range(6)], "exposures int")
    done = rank_rows(spark, d).select("rank", F.col("exposures").cast("int").alias("exposures"))
    return sweeps.missing_cells(ranks.crossJoin(F.broadcast(exposures)), done, ["rank", "exposures"])


def quota_sample(spark, d):
    r = records(spark, d)
    x = probes.stratified(r, ["model", "category", "hit"], F.col("ordinal").cast("string"), quota=25)
    return x.groupBy("model", "category", "hit").agg(F.count("*").alias("n"), F.sum("ordinal").alias("ordinals"))


def persona_messages(spark, d):
    """By template with a system message: distinct user and system messages over all persona families."""
    each = [probes.matrix(people(spark, d), family=f).where("size(messages) = 2").select("pid", "category", "template_id", F.col("messages")[1]["content"].alias("u"), F.col("messages")[0]["content"].alias("s")) for f in D.PERSONAS]
    x = each[0]
    for y in each[1:]:
        x = x.union(y)
    x = x.groupBy("pid", "category", "template_id").agg(F.count_distinct("u").alias("u"), F.count_distinct("s").alias("s"))
    return x.groupBy("template_id").agg(F.count("*").alias("probes"), F.max("u").alias("users"), F.max("s").alias("systems"))


def _scratch(spark: SparkSession, name: str) -> str:
    """A folder that driver and executors share."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder")
    return f"{where or tempfile.gettempdir()}/leakscan/{name}-{uuid.uuid4().hex}"


def checkpoint_rename(spark, d):
    """Budget runs as a JSON map, read again, with a key renamed."""
    path = _scratch(spark, "runs")
    io.write_json_map(budget_rows(spark, d), path)
    return io.renamed_key(io.read_map(spark, path, "value double, hits bigint"), "dp_e0_run0", "dp_e0_first")


def checkpoint_append(spark, d):
    """Budget runs in two writes to a checkpoint table, read again."""
    path, x = _scratch(spark, "checkpoint"), budget_rows(spark, d)
    checkpoints.write_checkpoint(x.where("hits = 0"), path)
    checkpoints.write_checkpoint(x.where("hits > 0"), path)
    return checkpoints.read_checkpoint(spark, path)


def checkpoint_replaced(spark, d):
    """Documents by source as conditions: all written, then those of each second source anew with their long texts only, then one emptied."""
    path = _scratch(spark, "replaced")
    x = _read(spark, d, "documents").select("doc_id", "source", "n_chars", F.lit(1).alias("run"))
    checkpoints.write_checkpoint(x, path, "source")
    again = x.where("char_length(source) % 2 = 0 AND n_chars > 500").withColumn("run", F.lit(2))
    checkpoints.write_checkpoint(again, path, "source")
    first = x.agg(F.min("source")).first()[0]
    checkpoints.write_checkpoint(x.limit(0), path, "source", [first])
    y = checkpoints.read_checkpoint(spark, path, "doc_id long, source string, n_chars long, run int")
    return y.groupBy("source", "run").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"), F.sum("n_chars").alias("chars"))


def checkpoint_todo(spark, d):
    """Probes of conditions (category) that a checkpoint table lacks: those of few leaks were written."""
    path, r = _scratch(spark, "todo"), records(spark, d)
    few = r.groupBy("category").agg(F.avg(F.col("hit").cast("int")).alias("rate")).where("rate < 0.2").select("category")
    checkpoints.write_checkpoint(r.select("model", "pid", "category", "hit").join(F.broadcast(few), "category", "left_semi"), path, "category")
    return checkpoints.todo(r.select("model", "category"), path, "category").groupBy("model", "category").agg(F.count("*").alias("n"))


_STORED = ["model", "pid", "category", "template_id", "condition", "type", "expected", "output", "hit", "match_method"]


def stored_records(spark, d):
    """Stored answers of one model in two categories, by the data source, which has the filters."""
    path = _scratch(spark, "stored")
    checkpoints.write_checkpoint(records(spark, d).select(_STORED), path, "category")
    stored.register(spark)
    x = spark.read.format(stored.FORMAT).option("key", "category").load(path)
    x = x.where((F.col("model") == MODELS[1]) & F.col("category").isin("mobile_phone", "full_name"))
    return x.groupBy("model", "category", "template_id").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"))


def stored_stream(spark, d):
    """Stored answers as a stream that stops and goes on: one model's, then the other's after it was written."""
    path, out, state = (_scratch(spark, n) for n in ("stored", "streamed", "state"))
    stored.register(spark)
    for m in MODELS:
        checkpoints.write_checkpoint(records(spark, d).where(F.col("model") == m).select(_STORED), path, "model")
        x = spark.readStream.format(stored.FORMAT).option("key", "model").option("schema", "model string, category string, hit boolean").load(path)
        x.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).groupBy("model", "category").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"))


def pages_csv(spark, d):
    """Pages as one quoted CSV file, read again by ranges."""
    path = _scratch(spark, "pages")
    _read(spark, d, "pages").select("page_id", "url", "html").repartition(1).write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    x = read_csv_split(spark, path, "page_id long, url string, html string, lang string")
    return x.select("page_id", F.md5("url").alias("url_md5"), F.md5("html").alias("html_md5"), "lang")


def conversations_json(spark, d):
    """Conversations as one JSON array, read again by ranges."""
    path = _scratch(spark, "conversations")
    io.write_array(_read(spark, d, "conversations"), path)
    x = read_json_split(spark, path, "conv_id long, turn long, role string, text string")
    return x.select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))


def corpus_roundtrip(lines: bool):
    def run(spark, d):
        path = _scratch(spark, "corpus")
        io.write_corpus(people(spark, d), path, lines=lines)
        return io.read_corpus(spark, path, lines)

    return run


def cases_roundtrip(spark, d):
    """The labelled set and a sample of stored answers as a document, of which the labelled cases are read."""
    path = _scratch(spark, "cases")
    first = records(spark, d).where(F.col("model") == MODELS[0])
    x = evalset.labelset(corpus.first_persons(people(spark, d), 140), 6).unionByName(evalset.sampled(first, 140))
    io.write_cases(x, path)
    return io.read_cases(spark, path).groupBy("kind").agg(F.count("*").alias("n"), F.count_if("label_leak").alias("leaks"))


def sweep_array(spark, d):
    """Generalization runs as a JSON array; rows without epochs are left out when read."""
    path = _scratch(spark, "sweep")
    io.write_array(general_rows(spark, d).withColumn("epochs", F.when(F.col("epochs") % 5 != 0, F.col("epochs"))), path)
    return io.read_rows(spark, path, "corpus string, epochs bigint, novel_valid double, n int", ("epochs",))


def utility_roundtrip(spark, d):
    """Held-out flags as task-utility records, read again and counted."""
    path = _scratch(spark, "utility")
    x = held_flags(spark, d).select("pid", "category", F.col("well_formed").alias("adheres"), "valid", "leaks_training", F.col("extracted").alias("emitted"), F.substring("output", 1, 160).alias("output"))
    x.write.json(path)
    y = spark.read.schema("pid bigint, category string, adheres boolean, valid boolean, leaks_training boolean, emitted string, output string").json(path)
    return y.groupBy("category").agg(F.count("*").alias("n"), F.count_if("adheres").alias("adheres"), F.count_if("valid").alias("valid"), F.count_if("leaks_training").alias("leaks"), F.count("emitted").alias("emitted"))


def bundle_roundtrip(spark, d):
    """The summary of a results bundle, read from its JSON."""
    path = _scratch(spark, "bundle")
    x = metrics.summary(records(spark, d))
    x.agg(F.to_json(F.struct(F.collect_list(F.struct(*x.columns)).alias("summary"))).alias("value")).write.text(path)
    return io.read_bundle(spark, path)


def replay(spark, d):
    x = answers.replayed(records(spark, d).drop("type"))
    return x.select("model", "n", "hits", F.size("examples").alias("shown"), F.col("examples")[0]["pid"].alias("pid"), F.col("examples")[0]["category"].alias("category"), F.col("examples")[0]["template_id"].alias("template_id"))


def replayed_answers(spark, d):
    """Stored answers joined to probes again and judged."""
    stored = records(spark, d).select(*probes.KEYS, "output")
    asked = matrix(spark, d).withColumn("model", F.explode(F.array(*map(F.lit, MODELS))))
    return metrics.grouped(answers.detect(answers.replay(asked, stored)), "model", "category")


def case_sample(spark, d):
    x = evalset.sampled(records(spark, d).where(F.col("model") == MODELS[0]), 140)
    return x.groupBy("kind", "category").agg(F.count("*").alias("n"), F.sum("pid").alias("pids"))


def exact_bootstrap(spark, d):
    return rounded(inference.exact_bootstrap(inference.cells(records(spark, d)), inference.rate_statistic, REPLICATES), "low", "high", "se")


def document_loss(spark, d):
    """Losses of documents under a model of four fifths of them."""
    return language_model.corpus_loss(_read(spark, d, "documents").select("doc_id", "text"), "doc_id % 5 = 0")


def corpus_loss(spark, d):
    x = document_loss(spark, d).join(_read(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    x = language_model.perplexity(x, "lang", "held_out")
    return rounded(x, "mean_loss").withColumn("perplexity", F.floor(F.col("perplexity") * 1000 + 0.5) / 1000)


def option_likelihood(spark, d):
    """Documents left out of the model as questions: which two words follow the first eight, of four pairs of the text, the right one placed by doc_id."""
    x = _read(spark, d, "documents").select("doc_id", "lang", "text")
    model = language_model.counted(language_model.trigrams(x.where("doc_id % 5 <> 0")))
    w, at = F.col("w"), lambda i: F.array_join(F.slice("w", i, 2), " ")
    q = x.where("doc_id % 5 = 0").withColumn("w", language_model.words(F.col("text"))).where("size(w) >= 40")
    # turned by doc_id, so that the right one stands at each letter
    turned = [F.element_at(F.array(*[at(i) for i in (9, 21, 31, 39)]), ((F.lit(k) + F.col("doc_id")) % 4 + 1).cast("int")) for k in range(4)]
    q = q.select(F.col("doc_id").alias("id"), F.col("lang").alias("subject"), F.array_join(F.slice(w, 1, 8), " ").alias("prompt"), F.array(*turned).alias("options"), F.char((F.lit(4) - F.col("doc_id") % 4) % 4 + 65).alias("correct"))
    return sweeps.exam_scores(language_model.answered(q, model))


def private_training(spark, d):
    """Quality of documents by a linear model trained with noise: its losses over steps 0, 4 and 8, broken off and resumed, and what it spends."""
    s, path = training.Settings(lot=128, noise=1.0), _scratch(spark, "training")
    labels = _read(spark, d, "labels").select("doc_id", F.col("quality").alias("label"))
    x = kept(training.examples(_read(spark, d, "documents").select("doc_id", "text"), labels, s.features))
    n, out = x.count(), None
    for steps in (0, 4, 8):
        w = training.train(x, steps, path, s)
        row = training.loss(x, w).select(F.lit(steps).alias("steps"), "n", "loss", "right", F.lit(training.spent(spark, n, steps, s) if steps else 0.0).alias("epsilon"))
        out = row if out is None else out.unionByName(row)
    return out


def unlearning(spark, d):
    """Losses of a few labelled documents and of the others before and after the few are unlearned."""
    s = training.Settings()
    labels = _read(spark, d, "labels").select("doc_id", F.col("quality").alias("label"))
    x = kept(training.examples(_read(spark, d, "documents").select("doc_id", "text"), labels, s.features))
    w = np.zeros(s.features)
    for _ in range(4):
        g, n = training.gradient(x, w, s.clip)
        w = w - 4.0 * g / max(n, 1)
    forget, retain, out = x.where("doc_id % 50 = 0"), x.where("doc_id % 50 <> 0"), None
    target = (training.loss(forget, w).first().loss or 0.0) + 0.05
    for when, v in (("before", w), ("after", training.unlearn(w, forget, retain, target, 0.1, steps=6))):
        for part, rows in (("forget", forget), ("retain", retain)):
            row = training.loss(rows, v).select(F.lit(when).alias("time"), F.lit(part).alias("part"), "n", "loss", "right")
            out = row if out is None else out.unionByName(row)
    return out


def near_prices(tolerance: float):
    """Orders with lines whose price is within a tolerance of theirs, and of those the nearest difference."""

    def run(spark, d):
        o = _read(spark, d, "orders").select("o_orderkey", "o_totalprice")
        x = joins.within(o, _read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), "o_totalprice", "l_extendedprice", tolerance)
        return x.groupBy("o_orderkey").agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("lines"), r6(F.min(F.abs(F.col("o_totalprice") - F.col("l_extendedprice")))).alias("nearest"))

    return run


def line_overlaps(spark, d):
    """Lines of one supplier that are under way at once, each for as many days as its quantity: how many pairs of lines by supplier."""
    x = _read(spark, d, "lineitem").select(F.col("l_suppkey").alias("key"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("start"), "l_quantity")
    x = x.withColumn("end", F.col("start") + F.col("l_quantity") * 86_400_000_000)
    pairs = joins.overlapping(x, x).where("left_id < right_id")
    return pairs.groupBy(F.col("key").alias("supplier")).agg(F.count("*").alias("pairs"), F.sum(F.col("left_id") + F.col("right_id")).alias("ids"))


def observed_progress(spark, d):
    """What a job counts of the records that pass while it writes them, beside what it wrote."""
    path = _scratch(spark, "observed")
    x, told = metrics.observed(records(spark, d))
    x.select("model", "hit").write.parquet(path)
    seen = told()
    y = spark.read.parquet(path).groupBy("model").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"))
    return y.withColumns({"all_n": F.lit(seen["n"]), "all_hits": F.lit(seen["hits"]), "errors": F.lit(seen["errors"])})


def corpus_dense(spark, d):
    n = _read(spark, d, "customer").count() * 9 // 10
    return corpus.dense_persons(people(spark, d), n).select("pid", "full_name", "national_id", "mobile_phone")


ARMS = ("qwen2.5-7b", *MODELS)


def direct_rates(spark, d):
    x = records(spark, d).where(F.col("template_id").isin(*D.SCOPES["ab"]))
    return x.groupBy(F.col("model").alias("key")).agg(metrics.rate().alias("rate"))


def differences(spark, d):
    return metrics.paired_overall(records(spark, d)).select(F.col("model").alias("key"), F.col("mean_of_pairs").alias("value"), F.col("unpaired").alias("other"))


def carried(spark, d):
    x = metrics.summary(records(spark, d))
    none = x.limit(1).select(F.lit("pilot").alias("model"), F.lit(0.0).alias("aggregate_rwmer"), F.lit(0.0).alias("mean_clmd"), F.lit("Low").alias("risk_band"))
    return rounded(views.carry_over(x.unionByName(none), "pilot", "commercial"), "aggregate_rwmer", "mean_clmd")


def exam_prompts(spark, d):
    """An exam made of documents: questions with the subject's first two worked examples before them."""
    path = _scratch(spark, "exam")
    at = lambda s: F.element_at(F.array(*map(F.lit, "ABCDa")), (text.hashed("exam", s, F.col("doc_id").cast("string")) % 5 + 1).cast("int"))
    x = _read(spark, d, "documents").where("text IS NOT NULL").select(F.col("lang").alias("subject"), F.when(F.col("doc_id") % 7 == 0, "dev").otherwise("val").alias("split"), F.col("doc_id").alias("id"), F.sha2("text", 256).alias("question"), *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in "ABCD"], at("correct").alias("answer"))
    x.write.parquet(path)
    return io.read_exam(spark, path, 2).select("subject", "id", "answer", _digest("prompt"))


def distances(spark, d):
    x = people(spark, d).select(F.levenshtein("soe_employee_id", F.lit("ENG201500000")).alias("distance"))
    return x.groupBy("distance").agg(F.count("*").alias("n"))


def scales(spark, d):
    x = named(spark, d, [*MODELS, "Yi-1.5-6B", "base", "deepseek-llm-7b"])
    return x.groupBy(views.model_scale(F.col("model")).alias("scale")).agg(F.count("*").alias("n"))


def exam(spark, d):
    at = lambda s: F.element_at(F.array(*map(F.lit, "ABCD")), (text.hashed("exam", s, F.col("doc_id").cast("string")) % 4 + 1).cast("int"))
    return _read(spark, d, "documents").select(F.col("lang").alias("subject"), at("given").alias("given"), at("correct").alias("correct"))


def luhn_documents(spark, d):
    x = _read(spark, d, "documents").select("source", F.explode(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0))).alias("v")).where(F.length("v").between(13, 19))
    return x.groupBy("source").agg(F.count("*").alias("numbers"), F.count_if(checks.luhn_valid(F.col("v"))).alias("valid"))


def families(spark, d):
    return named(spark, d, NAMES).groupBy(probes.family_of(F.col("model")).alias("family")).agg(F.count("*").alias("n"))


def csv_roundtrip(spark, d):
    path = _scratch(spark, "records")
    cols = ["model", "category", "condition", "type", "template_id", "pid", "hit", "match_method", "expected", "output"]
    # a person's values stand in 168 rows, so that compressed parts are a small share of plain ones
    io.write_csv(records(spark, d).select(cols), path, "gzip")
    return io.read_csv(spark, path).groupBy("model").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"))


def sample_io(spark, d):
    return probes.first_each(records(spark, d), ["model", "category", "condition", "hit"], 2).select("model", "category", "condition", "hit", "ordinal", "output")


def stratified(spark, d):
    m = matrix(spark, d)
    x = probes.stratified(m, ["template_id"], F.col("ordinal").cast("string"), fraction=0.25)
    return x.groupBy("template_id").agg(F.count("*").alias("n"), F.sum("ordinal").alias("ordinals"))


def resume_todo(spark, d):
    r = records(spark, d).select(*probes.KEYS, "hit")
    return probes.todo(r, r.where("hit")).groupBy("model", "category").agg(F.count("*").alias("n"))


def first_hits(spark, d):
    return records(spark, d).where("hit").orderBy("model", "ordinal").select("model", "ordinal", "expected", F.substring("output", 1, 160).alias("output")).limit(12)


QUERIES = {
    "corpus_persons": people,
    "corpus_validate": corpus_validate,
    "corpus_disjoint": lambda s, d: heldout.shared_values(people(s, d), held_people(s, d)).groupBy("category").agg(F.count("*").alias("shared")),
    "probe_matrix": probe_matrix,
    "training_docs_fixed": lambda s, d: corpus.training_texts(people(s, d), 2).select("pid", "rep", "kind", _digest("text")),
    "training_docs_varied": lambda s, d: corpus.training_texts(people(s, d), 3, True).select("pid", "rep", "kind", _digest("text")),
    "simulated_answers": lambda s, d: answers.simulate(matrix(s, d), MODELS).select("model", "pid", "category", "template_id", "output"),
    "detect_records": lambda s, d: records(s, d).select("model", "pid", "category", "template_id", "match_method", "hit"),
    "mer_long": lambda s, d: metrics.mer_long(records(s, d)),
    "per_category": lambda s, d: metrics.per_category(records(s, d)),
    "model_summary": lambda s, d: rounded(metrics.summary(records(s, d)), "aggregate_rwmer", "mean_clmd"),
    "scope_rates": lambda s, d: metrics.scope_rates(records(s, d)),
    "per_template": lambda s, d: metrics.grouped(records(s, d), "model", "template_id"),
    "type_template": lambda s, d: metrics.grouped(records(s, d), "type", "template_id"),
    "type_by_category": lambda s, d: metrics.type_by_category(records(s, d)),
    "defense_comparison": lambda s, d: metrics.grouped(records(s, d), "model"),
    "crosstabs": lambda s, d: metrics.crosstabs(records(s, d)),
    "paired_clmd_category": lambda s, d: metrics.paired_by_category(records(s, d)),
    "paired_clmd_overall": lambda s, d: rounded(metrics.paired_overall(records(s, d)), "pooled", "mean_of_pairs", "unpaired"),
    "mcnemar": lambda s, d: rounded(inference.mcnemar(records(s, d)), "p"),
    "wilson_rates": lambda s, d: rounded(inference.wilson_rates(records(s, d), "model", "category"), "low", "high"),
    "person_spread": lambda s, d: rounded(inference.person_spread(records(s, d)), "mean_rate", "sd", "expected_sd", "ratio"),
    "units": lambda s, d: inference.units(records(s, d)),
    "bootstrap_rate": bootstrap((), inference.rate_statistic),
    "bootstrap_rwmer": bootstrap(("category", "condition"), inference.rwmer_statistic),
    "bootstrap_clmd": bootstrap(("template_id",), inference.clmd_statistic, ["C1", "C2", "D1", "D2"]),
    "bootstrap_exact": exact_bootstrap,
    "document_loss": lambda s, d: rounded(document_loss(s, d), "loss"),
    "corpus_loss": corpus_loss,
    "option_likelihood": option_likelihood,
    "private_training": private_training,
    "unlearning": unlearning,
    "equal_prices": near_prices(1e-9),
    "near_prices": near_prices(1.0),
    "line_overlaps": line_overlaps,
    "observed_progress": observed_progress,
    "corpus_dense": corpus_dense,
    "first_disagreements": lambda s, d: evalset.first_disagreements(records(s, d)),
    "inspector_first": lambda s, d: views.inspected(records(s, d), MODELS[0], "mobile_phone", hit=False).orderBy("ordinal").limit(3).select("pid", "template_id", F.substring("output", 1, 150).alias("output")),
    "ranked_summary": lambda s, d: views.ranked(metrics.summary(records(s, d))),
    "category_order": lambda s, d: rounded(views.category_order(records(s, d)), "mer_worst"),
    "second_score": lambda s, d: rounded(views.second_score(records(s, d)), "first", "second"),
    "verbatim_rate": lambda s, d: metrics.verbatim(records(s, d).where("template_id = 'A1'"), "model", "category"),
    "validity_pivot": lambda s, d: rounded(views.validity_pivot(held_flags(s, d, ARMS), list(ARMS)).toDF("category", "large", "small", "middle"), "large", "small", "middle"),
    "rdp_epsilon": rdp_epsilon,
    "degeneracy": lambda s, d: metrics.degeneracy(records(s, d)),
    "sample_io": sample_io,
    "first_hits": first_hits,
    "canary": lambda s, d: probes.canary(matrix(s, d)).select("pid", "category", "template_id", "ordinal"),
    "stratified_sample": stratified,
    "resume_todo": resume_todo,
    "heldout_flags": lambda s, d: held_flags(s, d).select("pid", "category", "extracted", "well_formed", "valid", "recited", "novel_valid", "leaks_training"),
    "heldout_rollup": lambda s, d: heldout.rollup(held_flags(s, d)),
    "redact_loose": redacted(False),
    "redact_strict": redacted(True),
    "redact_normalised": redacted(True, True),
    "over_redaction": over_redaction,
    "rescore_filtered": rescore_filtered,
    "labelset": lambda s, d: cases(s, d).groupBy("kind", "category").agg(F.count("*").alias("n"), F.count_if("label_leak").alias("leaks"), F.sum(F.length("output")).alias("chars")),
    "selftest_confusion": lambda s, d: evalset.confusion(evalset.judged(cases(s, d))),
    "selftest_by_kind": lambda s, d: evalset.by_kind(evalset.judged(cases(s, d))),
    "disagreement_audit": lambda s, d: evalset.disagreement(records(s, d)),
    "floor_delta": lambda s, d: rounded(metrics.summary(evalset.by_rule(records(s, d)), ("rule",)), "aggregate_rwmer", "mean_clmd"),
    "noise_ladder": lambda s, d: sweeps.noise_ladder(noise_rows(s, d)),
    "noise_bracket": lambda s, d: sweeps.noise_bracket(sweeps.noise_ladder(noise_rows(s, d))),
    "budget_groups": lambda s, d: rounded(sweeps.budget_groups(budget_rows(s, d)), "mean", "sd"),
    "spread_verdict": lambda s, d: rounded(sweeps.spread_verdict(sweeps.budget_groups(budget_rows(s, d))), "within", "between"),
    "generalization_verdict": lambda s, d: rounded(sweeps.generalization(general_rows(s, d)), "gain", "z", "p"),
    "rank_grid": lambda s, d: rounded(sweeps.rank_grid(rank_rows(s, d)), "rise"),
    "privacy_utility": lambda s, d: rounded(sweeps.privacy_utility(utility_rows(s, d)), "closed", "kept"),
    "clipping_verdict": lambda s, d: sweeps.clipping_verdict(clip_rows(s, d)),
    "exam_accuracy": lambda s, d: sweeps.exam_scores(exam(s, d)),
    "letter_distribution": lambda s, d: sweeps.letters(exam(s, d)),
    "luhn_documents": luhn_documents,
    "family_of": families,
    "pri_table": pri_table,
    "csv_roundtrip": csv_roundtrip,
    "scope_scores": lambda s, d: rounded(views.scope_scores(records(s, d)), "aggregate_rwmer"),
    "scope_difference": lambda s, d: rounded(views.scope_difference(records(s, d), *MODELS), "first", "second", "difference"),
    "scope_categories": lambda s, d: views.scope_categories(records(s, d)),
    "pair_mean_categories": lambda s, d: rounded(views.pair_mean_categories(records(s, d)), "clmd"),
    "published_check": lambda s, d: rounded(views.published_check(metrics.summary(records(s, d)), PUBLISHED), "aggregate_rwmer"),
    "profile": lambda s, d: rounded(views.profile(records(s, d)), "aggregate_rwmer", "mean_clmd", "mean_of_pairs"),
    "width_ratio": lambda s, d: rounded(views.width_ratio(records(s, d), REPLICATES), "clustered", "wilson", "ratio"),
    "template_spread": lambda s, d: rounded(views.template_spread(records(s, d)), "sd", "gap", "width", "ratio"),
    "gate": lambda s, d: rounded(views.gate(gate_rows(s, d)), "grew", "se"),
    "recovery": lambda s, d: rounded(views.recovery(gate_rows(s, d).select("key", F.col("score").alias("value")), "base", "run1"), "recovered"),
    "noise_extent": lambda s, d: rounded(views.extent(noise_rows(s, d), "noise", "recitation"), "low", "mean", "high", "range"),
    "run_spread": lambda s, d: rounded(views.extent(budget_rows(s, d).withColumn("budget", F.element_at(F.split("key", "_run"), 1)), "budget", "value"), "mean", "range"),
    "model_match": lambda s, d: metrics.grouped(views.matching(records(s, d), "2.5-3B"), "model"),
    "model_fallback": lambda s, d: metrics.grouped(views.matching(records(s, d), "no such model"), "model"),
    "inspector": lambda s, d: views.inspected(records(s, d), MODELS[1], "national_id", "B", True).select("pid", "template_id", "output"),
    "heat_map": lambda s, d: views.heat_map(records(s, d), "zh2zh"),
    "risk_landscape": lambda s, d: views.risk_landscape(records(s, d)),
    "rate_intervals": lambda s, d: rounded(views.rate_intervals(records(s, d)), "low", "high"),
    "validity_grid": lambda s, d: views.validity_grid(held_flags(s, d)),
    "loss_against_base": lambda s, d: rounded(views.loss_against_base(*loss_rows(s, d)), "accuracy_change", "loss_change"),
    "grid_missing": grid_missing,
    "quota_sample": quota_sample,
    "capped_progress": lambda s, d: metrics.progress(records(s, d).where("ordinal < 5000")),
    "persona_messages": persona_messages,
    "checkpoint_rename": checkpoint_rename,
    "model_scale": scales,
    "checkpoint_append": checkpoint_append,
    "checkpoint_replaced": checkpoint_replaced,
    "checkpoint_todo": checkpoint_todo,
    "stored_records": stored_records,
    "stored_stream": stored_stream,
    "pages_csv": pages_csv,
    "conversations_json": conversations_json,
    "corpus_roundtrip": corpus_roundtrip(False),
    "corpus_lines_roundtrip": corpus_roundtrip(True),
    "cases_roundtrip": cases_roundtrip,
    "sweep_array": sweep_array,
    "utility_roundtrip": utility_roundtrip,
    "bundle_roundtrip": lambda s, d: rounded(bundle_roundtrip(s, d), "aggregate_rwmer", "mean_clmd"),
    "replay": replay,
    "replayed_answers": replayed_answers,
    "case_sample": case_sample,
    "selftest_362": lambda s, d: evalset.confusion(evalset.judged(evalset.labelset(corpus.first_persons(people(s, d), 140), 6))),
    "first_persons": lambda s, d: corpus.first_persons(people(s, d), 40).select("pid"),
    "raw_scores": lambda s, d: views.raw_scores(records(s, d)),
    "run_meta": lambda s, d: views.run_meta(records(s, d)),
    "run_gap": lambda s, d: rounded(views.run_gap(records(s, d), *MODELS), "gap", "width", "run_over_probe"),
    "size_sensitivity": lambda s, d: rounded(views.size_sensitivity(records(s, d), people(s, d), 40, 140), "few_rate", "more_rate", "change"),
    "combined": lambda s, d: rounded(views.combined(records(s, d)), "aggregate_rwmer", "mean_clmd"),
    "carry_over": carried,
    "model_contains": lambda s, d: metrics.grouped(views.containing(records(s, d), "2.5-3b"), "model"),
    "replication": lambda s, d: rounded(sweeps.replication(direct_rates(s, d), MODELS[1], MODELS[0], 0.01), "first", "second", "difference"),
    "stability": lambda s, d: rounded(sweeps.stability(differences(s, d), -0.048), "value", "other", "moved"),
    "near_key": lambda s, d: sweeps.near_key(noise_rows(s, d).withColumn("noise", F.col("noise") + 1e-12), "noise", 0.03).select("run", "hits"),
    "paired_lists": paired_lists,
    "sweep_order": lambda s, d: sweeps.ordered(utility_rows(s, d), "epsilon", True).select("key", "epsilon", "place"),
    "window_series": lambda s, d: sweeps.window_series(general_rows(s, d)).select("corpus", "above", "base_rate", F.expr("array_join(transform(series, s -> cast(s.epochs AS string)), ',')").alias("epochs")),
    "exam_prompts": exam_prompts,
    "edit_distance": distances,
    "weighted_risk": weighted_risk,
}
