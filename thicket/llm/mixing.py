"""Mixing sources to target weights through a domain-language-source tree, in DataFrame functions only.

A budget of tokens (words) runs down the tree. At every node the children share it by weight, but none gets more than its subtree
holds in ``epochs`` passes; what such children leave goes to their siblings, and only what a whole subtree can't take
goes to its ancestors' other children. Shares are whole numbers, rounded down.

A leaf's stream is its documents in seeded order, epoch after epoch; its share is the longest prefix that fits. To find where the
prefix ends, documents fall into 4096 buckets of their order key; Spark sums the buckets, and only the rows of the bucket
with the cut are sorted. So a source with a third of all rows is no task of its own, and texts are only read, never shuffled.

Defined cases: a null language or source is a node of its own, named empty, with the default weight; null texts have no tokens;
documents without tokens cost nothing. Rows of equal doc_id stay or go together. Nodes of weight 0 get nothing
unless all siblings are full. The input's columns come back as they were, whatever their names: a row travels as one struct, and the columns
that are added get underscores after their names where the input has such a column. Texts of any length are only counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thicket.llm.shared import free_name, materialise

#: Weights of the queries, in thousandths; other nodes weigh ``default``.
DOMAINS = {"web": 500, "books": 300, "reference": 200}
LANGUAGES = {"en": 550, "de": 150, "fr": 150, "es": 150}
DEFAULT, EPOCHS, SEED, SHARE = 100, 2, 17, 0.8
WORDS = r"[^\x20\x09-\x0D]+"
TREE = ("_mix_domain", "_mix_lang", "_mix_source")


def domain_of(source: Column) -> Column:
    """The queries' domains: of the number in a source's name, modulo 3."""
    number = F.coalesce(F.regexp_extract(source, "([0-9]{1,9})", 1).try_cast("long"), F.lit(0))
    return F.element_at(F.array(F.lit("web"), F.lit("books"), F.lit("reference")), (number % 3 + 1).cast("int"))


def _weight(column: str, weights: dict[str, int], default: int) -> Column:
    out = F.lit(default)
    for name, w in weights.items():
        out = F.when(F.col(column) == name, F.lit(w)).otherwise(out)
    return out.cast("long")


def _share(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """``nodes`` has parent columns, name, weight, cap and budget (of the parent): adds share. Children fill up in order of
    cap by weight; the first that doesn't fill sets the level for the rest."""
    by = [*parent] or [F.lit(1)]
    weight = F.greatest(F.col("weight"), F.lit(0))
    order = Window.partitionBy(*by).orderBy(F.when(weight > 0, F.col("cap").cast("double") / weight).otherwise(F.lit(float("inf"))), name)
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*by)
    nodes = nodes.withColumns({"w0": F.coalesce(F.sum("weight").over(before), F.lit(0)), "c0": F.coalesce(F.sum("cap").over(before), F.lit(0)), "w": F.sum("weight").over(everything)})
    full = (F.col("cap") * (F.col("w") - F.col("w0")) <= F.col("weight") * (F.col("budget") - F.col("c0"))) & (F.col("weight") > 0)
    nodes = nodes.withColumn("full", full)
    left = nodes.withColumns({"c1": F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(everything), F.lit(0)), "w1": F.coalesce(F.sum(F.when(F.col("full"), F.col("weight"))).over(everything), F.lit(0))})
    # nodes of weight 0 share what is left when all others are full, in order of name
    spare = F.coalesce(F.sum(F.when(F.col("weight") == 0, F.col("cap"))).over(Window.partitionBy(*by).orderBy(name).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.when(F.col("w") == F.col("w1"), F.greatest(F.least(F.col("cap"), F.col("budget") - F.col("c1") - spare), F.lit(0))).otherwise(F.lit(0))
    level = F.expr("weight * (budget - c1) div nullif(w - w1, 0)")
    share = F.when(F.col("full"), F.col("cap")).when(F.col("weight") == 0, rest).otherwise(F.coalesce(level, F.lit(0)))
    return left.withColumn("share", share.cast("long")).drop("w0", "c0", "w", "full", "c1", "w1")


def budgets(leaves: DataFrame, share: float, epochs: int, domains: dict[str, int], languages: dict[str, int], sources: dict[str, int], default: int) -> DataFrame:
    """Of leaves (tree columns, tokens): quota of each, its whole epochs and the tokens of its last, partial one."""
    d, l, s = TREE
    sums = leaves.withColumn("cap", F.col("tokens") * epochs)
    budget = sums.groupBy().agg(F.floor(F.coalesce(F.sum("tokens"), F.lit(0)) * F.lit(share)).cast("long").alias("budget"))
    top = sums.groupBy(d).agg(F.sum("cap").alias("cap")).withColumn("weight", _weight(d, domains, default))
    top = _share(top.withColumn("one", F.lit(1)).join(budget.withColumn("one", F.lit(1)), "one").drop("one"), [], d)
    mid = sums.groupBy(d, l).agg(F.sum("cap").alias("cap")).withColumn("weight", _weight(l, languages, default)).join(top.select(d, F.col("share").alias("budget")), d)
    mid = _share(mid, [d], l)
    low = sums.withColumn("weight", _weight(s, sources, default)).join(mid.select(d, l, F.col("share").alias("budget")), [d, l])
    low = _share(low, [d, l], s)
    whole = F.expr("coalesce(share div nullif(tokens, 0), 0)")
    return low.select(*TREE, "tokens", F.col("share").alias("quota"), whole.alias("whole")).withColumn("rest", F.col("quota") - F.col("whole") * F.col("tokens"))


def _key(seed: int, epoch: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(epoch).cast("string"), F.coalesce(F.col("_mix_id").cast("string"), F.lit("null"))))


def mix(
    docs: DataFrame,
    share: float = SHARE,
    epochs: int = EPOCHS,
    seed: int = SEED,
    domain: Column | None = None,
    domains: dict[str, int] = DOMAINS,
    languages: dict[str, int] = LANGUAGES,
    sources: dict[str, int] | None = None,
    default: int = DEFAULT,
    epoch_column: str = "epoch",
) -> DataFrame:
    """The chosen rows of ``docs`` (doc_id, text, lang, source), each once for every epoch that takes it, with ``epoch_column``
    and the tree columns. The budget is ``share`` of all tokens."""
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    tagged = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_mix_row"),
        F.col("doc_id").alias("_mix_id"),
        F.coalesce(domain if domain is not None else domain_of(source), F.lit("")).alias("_mix_domain"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("_mix_lang"),
        source.alias("_mix_source"),
        F.col("text").alias("_mix_text"),
    )
    tokens = F.coalesce(F.regexp_count(F.col("_mix_text").cast("string"), F.lit(WORDS)), F.lit(0)).cast("long")
    small = materialise(tagged.select("_mix_id", *TREE, tokens.alias("tokens")), "mix-tokens")
    leaves = small.groupBy(*TREE).agg(F.sum("tokens").alias("tokens"))
    quotas = materialise(budgets(leaves, share, epochs, domains, languages, sources or {}, default), "mix-quotas")

    # where each leaf's last epoch ends
    keyed = small.join(quotas.select(*TREE, "whole", "rest"), [*TREE]).withColumn("key", _key(seed, "whole")).withColumn("bucket", F.substring("key", 1, 3))
    sums = keyed.groupBy(*TREE, "rest", "bucket").agg(F.sum("tokens").alias("n"))
    running = sums.withColumn("upto", F.sum("n").over(Window.partitionBy(*TREE).orderBy("bucket")))  # 4096 rows of a leaf at most
    cuts = running.where("upto > rest").groupBy(*TREE).agg(F.min(F.struct("bucket", (F.col("upto") - F.col("n")).alias("before"))).alias("cut"))
    inside = keyed.join(cuts.select(*TREE, F.col("cut.bucket").alias("at"), F.col("cut.before").alias("before")), [*TREE]).where("bucket = at")
    taken = inside.withColumn("upto", F.sum("tokens").over(Window.partitionBy(*TREE).orderBy("key")) + F.col("before")).where("upto <= rest")
    last = taken.groupBy(*TREE).agg(F.max("key").alias("last"))
    # a leaf without a cut takes all of its last epoch, which then has no tokens; one whose bucket keeps nothing ends before it
    ends = quotas.join(cuts.select(*TREE, F.col("cut.bucket").alias("at")), [*TREE], "left").join(last, [*TREE], "left")
    ends = ends.select(*TREE, "whole", F.coalesce("last", "at", F.lit("g")).alias("end"))
    ends = materialise(ends, "mix-ends")

    each = tagged.drop("_mix_text").join(ends, [*TREE]).withColumn("_mix_epoch", F.explode(F.sequence(F.lit(0), F.col("whole").cast("int"))))
    chosen = each.where((F.col("_mix_epoch") < F.col("whole")) | ((F.col("_mix_epoch") < F.lit(epochs)) & (_key(seed, "_mix_epoch") <= F.col("end"))))
    names = list(docs.columns)
    added = []
    for column, name in (("_mix_epoch", epoch_column), *((c, c) for c in TREE)):
        names.append(free_name(name, names))
        added.append(F.col(column).alias(names[-1]))
    return chosen.select(*(F.col("_mix_row").getField(c).alias(c) for c in docs.columns), *added)


def sql(share: float = SHARE, epochs: int = EPOCHS, seed: int = SEED) -> str:
    """DuckDB SQL for the rows of the query."""
    case = lambda column, weights: "CASE " + " ".join(f"WHEN {column} = '{k}' THEN {w}" for k, w in weights.items()) + f" ELSE {DEFAULT} END"

    def level(source: str, parent: str, name: str) -> str:
        by = f"PARTITION BY {parent}" if parent else ""
        return f"""SELECT *, CASE WHEN filled THEN cap ELSE (weight * (budget - coalesce(c1, 0))) // (w - coalesce(w1, 0)) END AS share FROM (
            SELECT *, sum(CASE WHEN filled THEN cap END) OVER ({by}) AS c1, sum(CASE WHEN filled THEN weight END) OVER ({by}) AS w1 FROM (
            SELECT *, cap * (w - coalesce(w0, 0)) <= weight * (budget - coalesce(c0, 0)) AS filled FROM (
            SELECT *, sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS w0, sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c0, sum(weight) OVER ({by}) AS w
            FROM {source} WINDOW o AS ({by} ORDER BY CAST(cap AS DOUBLE) / weight, {name}))))"""

    return rf"""
        WITH t AS (SELECT doc_id, lang, source, ['web', 'books', 'reference'][coalesce(TRY_CAST(regexp_extract(source, '([0-9]{{1,9}})', 1) AS BIGINT), 0) % 3 + 1] AS domain,
            len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS tokens FROM documents),
        leaf AS (SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(tokens) * {epochs} AS BIGINT) AS cap FROM t GROUP BY ALL),
        top0 AS (SELECT domain, sum(cap)::BIGINT AS cap, {case('domain', DOMAINS)} AS weight, (SELECT CAST(floor(sum(tokens) * {share}) AS BIGINT) FROM leaf) AS budget FROM leaf GROUP BY domain),
        top AS ({level('top0', '', 'domain')}),
        mid0 AS (SELECT l.domain, lang, sum(l.cap)::BIGINT AS cap, {case('lang', LANGUAGES)} AS weight, any_value(top.share)::BIGINT AS budget FROM leaf l JOIN top ON l.domain = top.domain GROUP BY l.domain, lang),
        mid AS ({level('mid0', 'domain', 'lang')}),
        low0 AS (SELECT l.domain, l.lang, source, tokens, l.cap, {DEFAULT} AS weight, mid.share::BIGINT AS budget FROM leaf l JOIN mid ON l.domain = mid.domain AND l.lang = mid.lang),
        low AS ({level('low0', 'domain, lang', 'source')}),
        quota AS (SELECT domain, lang, source, tokens AS all_tokens, share::BIGINT AS share, CASE WHEN tokens > 0 THEN share::BIGINT // tokens ELSE 0 END AS whole FROM low),
        each AS (SELECT t.doc_id, t.tokens, t.domain, t.lang, t.source, q.whole, q.share - q.whole * q.all_tokens AS rest, e.epoch
            FROM t JOIN quota q ON t.domain = q.domain AND t.lang = q.lang AND t.source = q.source JOIN (SELECT unnest(range({epochs})) AS epoch) e ON e.epoch <= q.whole),
        run AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source, epoch ORDER BY md5('{seed}:' || epoch || ':' || doc_id)) AS upto FROM each)
        SELECT doc_id, CAST(epoch AS INTEGER) AS epoch, domain, lang, source, CAST(tokens AS BIGINT) AS n_tokens FROM run WHERE epoch < whole OR upto <= rest
    """
