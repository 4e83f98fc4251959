"""Mixing sources to target weights: hierarchical budgets over a domain-language-source tree.

A node's budget is shared among its children by weight. What a child cannot use (its documents, over the allowed epochs,
have fewer tokens) goes to its siblings by weight; only when all of them are full does the shortage reach the node
above, because a node's own capacity is the sum of its children's. This is one pass of sums upwards and one of
water-filling downwards, each a window over the (small) table of nodes.

A leaf with budget b and t tokens takes all documents for b // t epochs and, in one more, the longest prefix of a seeded
random order whose tokens fit in what is left. The prefix is found by sums over hash buckets, about the square root of
the leaf's documents in number; only the one bucket in which the prefix ends is ordered. A leaf that holds a third of
all rows is thus dealt over many tasks.

Defined results: null text has no tokens; null lang or source count as the empty string. Leaves without tokens take no
epoch but keep their empty documents in the prefix. Repeated rows are drawn one by one. Weights that are null or not
positive count as zero: such nodes get nothing. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import discard, materialize, words

TREE = ("domain", "lang", "source")


def water_fill(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """Adds ``share``: each node's part of its parent's ``budget``, by ``weight`` and at most ``capacity``.

    Children fill up in order of capacity over weight. The water level is what is left for those that do not fill,
    divided by their weights, at the first child that does not fill."""
    order = W.partitionBy(*parents).orderBy("fills_at", name)
    before = F.coalesce(F.sum("capacity").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    nodes = nodes.withColumn("weight", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)))
    nodes = nodes.withColumn("fills_at", F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")).otherwise(F.lit(1e300)))
    nodes = nodes.withColumn("level", F.when(after > 0, (F.col("budget") - before) / after).otherwise(F.lit(0.0)))
    whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    water = F.first(F.when(F.col("fills_at") > F.col("level"), F.col("level")), ignorenulls=True).over(whole)
    nodes = nodes.withColumn("water", water)
    share = F.when(F.col("water").isNull(), F.col("capacity")).otherwise(F.least(F.col("capacity"), F.col("water") * F.col("weight")))
    return nodes.withColumn("share", F.greatest(share, F.lit(0.0))).drop("fills_at", "level", "water")


def leaf_budgets(leaves: DataFrame, budget: Column, weights: dict[str, Column], epochs: int) -> DataFrame:
    """leaves (domain, lang, source, tokens, n_docs) with a whole number ``tokens_due`` for each."""
    leaves = leaves.withColumn("capacity", (F.col("tokens") * epochs).cast("double"))
    by_lang = leaves.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity"))
    by_domain = by_lang.groupBy("domain").agg(F.sum("capacity").alias("capacity"))
    total = leaves.agg(budget.cast("double").alias("budget"))
    domains = water_fill(by_domain.withColumn("weight", weights["domain"]).crossJoin(F.broadcast(total)), [], "domain")  # total is one row
    langs = by_lang.join(domains.select("domain", F.col("share").alias("budget")), "domain").withColumn("weight", weights["lang"])
    langs = water_fill(langs, ["domain"], "lang")
    sources = leaves.join(langs.select("domain", "lang", F.col("share").alias("budget")), ["domain", "lang"]).withColumn("weight", weights["source"])
    sources = water_fill(sources, ["domain", "lang"], "source")
    return sources.select(*TREE, "tokens", "n_docs", F.floor(F.col("share") + 1e-6).alias("tokens_due"))


def place(seed: int, epoch: Column, key: str) -> Column:
    """A row's place in the random order of an epoch."""
    return F.md5(F.concat_ws(":", F.lit(seed), epoch, F.col(key)).cast("binary"))


def mix(rows: DataFrame, budget: Column, weights: dict[str, Column], epochs: int = 4, seed: int = 17, key: str = "doc_id") -> DataFrame:
    """rows (key, domain, lang, source, n_tokens) as drawn, once for each epoch; ``budget`` is an aggregate over leaves."""
    leaves = materialize(rows.groupBy(*TREE).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_docs")), "leaves")
    due = leaf_budgets(leaves, budget, weights, epochs)
    due = due.withColumn("full", F.when(F.col("tokens") > 0, F.floor(F.col("tokens_due") / F.col("tokens"))).otherwise(0).cast("int"))
    due = due.withColumn("rest", F.col("tokens_due") - F.col("full") * F.col("tokens")).withColumn("n_buckets", F.ceil(F.sqrt("n_docs")))
    due = materialize(due.select(*TREE, "full", "rest", "n_buckets", (F.col("full") < epochs).alias("more")), "budgets")
    drawn = rows.join(due, list(TREE))
    whole = drawn.filter("full > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("full") - 1)))
    # The epoch that is not whole: sums by bucket tell in which one the prefix ends.
    part = drawn.filter("more").withColumn("epoch", F.col("full")).withColumn("place", place(seed, F.col("epoch"), key))
    part = part.withColumn("bucket", F.floor(F.conv(F.substring("place", 1, 8), 16, 10).cast("double") / 2**32 * F.col("n_buckets")))
    sums = part.groupBy(*TREE, "bucket").agg(F.sum("n_tokens").alias("held"), F.first("rest").alias("limit"))
    upto = F.sum("held").over(W.partitionBy(*TREE).orderBy("bucket"))
    sums = sums.withColumn("before", upto - F.col("held")).filter("before <= limit")
    sums = materialize(sums.withColumn("inside", F.col("before") + F.col("held") <= F.col("limit")).drop("limit", "held"), "buckets")
    part = part.join(sums, [*TREE, "bucket"])
    end = part.filter("not inside").withColumn("run", F.col("before") + F.sum("n_tokens").over(W.partitionBy(*TREE, "bucket").orderBy("place", key, "n_tokens").rowsBetween(W.unboundedPreceding, 0)))
    columns = [key, "epoch", *TREE, "n_tokens"]
    return whole.select(columns).unionByName(part.filter("inside").select(columns)).unionByName(end.filter("run <= rest").select(columns))


def mixing_rows(docs: DataFrame, domain: Column, key: str = "doc_id") -> DataFrame:
    """The key, the tree's names and the number of words of each document."""
    named = docs.withColumns({"lang": F.coalesce("lang", F.lit("")), "source": F.coalesce("source", F.lit("")), "text": F.coalesce("text", F.lit(""))})
    rows = named.withColumn("domain", domain).select(key, *TREE, F.size(words(F.col("text"))).cast("long").alias("n_tokens"))
    return materialize(rows, "mixing-rows")


#: Which of three domains a source belongs to, by its last character, and the weights of domains and languages that the query and the pipeline aim at; all sources weigh the same.
DOMAINS = {"web": "012", "news": "3456"}
WEIGHTS = {"domain": {"web": 5.0, "news": 3.0, "forum": 2.0}, "lang": {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 2.0}}


def domain_of_source(source: Column | None = None) -> Column:
    last = F.substring(F.col("source") if source is None else source, -1, 1)
    return F.when(last.isin(*DOMAINS["web"]), "web").when(last.isin(*DOMAINS["news"]), "news").otherwise("forum")


def target_weights() -> dict[str, Column]:
    def table(name: str, other: float) -> Column:
        found = F.lit(other)
        for key, weight in WEIGHTS[name].items():
            found = F.when(F.col(name) == key, F.lit(weight)).otherwise(found)
        return found

    return {"domain": table("domain", 1.0), "lang": table("lang", 1.0), "source": F.lit(1.0)}


def mix_documents(docs: DataFrame, share: float = 0.5, epochs: int = 4, seed: int = 17) -> DataFrame:
    """The draws of docs, for a budget of ``share`` of all their words."""
    return mix(mixing_rows(docs, domain_of_source()), F.floor(F.sum("tokens") * share), target_weights(), epochs, seed)


def keep_drawn(docs: DataFrame, share: float, seed: int = 17) -> DataFrame:
    """The rows of docs that one epoch draws, all columns as they are: in each leaf those before the last place drawn, and of
    those at it as many as are drawn there.

    A row's place follows from its doc_id and a hash of all its columns, so only equal rows share one; null doc_ids are no
    exception. Only the table of leaves is joined to the texts; Spark broadcasts it where its threshold allows."""
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.xxhash64(*docs.columns))
    keyed = docs.withColumn("__mix_key", key)
    drawn = mix(mixing_rows(keyed, domain_of_source(), "__mix_key"), F.floor(F.sum("tokens") * share), target_weights(), 1, seed, "__mix_key")
    drawn = materialize(drawn.select(*TREE, place(seed, F.col("epoch"), "__mix_key").alias("at")), "drawn")
    last = materialize(drawn.groupBy(*TREE).agg(F.max("at").alias("last")), "last-places")
    ends = drawn.join(last, list(TREE)).filter("at = last").groupBy(*TREE, "last").agg(F.count("*").alias("n"))
    ends = materialize(ends, "last-places")
    discard(drawn, last)
    ends = ends.select(*(F.col(c).alias(f"__leaf_{c}") for c in TREE), F.col("last").alias("__last"), F.col("n").alias("__n"))
    own = {"__mix_lang": F.coalesce("lang", F.lit("")), "__mix_source": F.coalesce("source", F.lit("")), "__mix_domain": domain_of_source(F.coalesce("source", F.lit(""))), "__at": place(seed, F.lit(0), "__mix_key")}
    met = keyed.withColumns(own).join(ends, [F.col(f"__leaf_{c}") == F.col(f"__mix_{c}") for c in TREE])
    at_last = W.partitionBy(*(f"__mix_{c}" for c in TREE)).orderBy("__mix_key")
    tied = met.filter("__at = __last").withColumn("__rank", F.row_number().over(at_last)).filter("__rank <= __n")
    return met.filter("__at < __last").select(docs.columns).unionByName(tied.select(docs.columns))
