"""Mixing sources to target weights by hierarchical budgeting [DataFrame functions only].

A tree of domain, language and source carries integer weights. The token budget is passed down from the
root; a subtree whose supply (its tokens times ``max_epochs``) is short gives the rest to its siblings
in proportion to their weights, and only what no sibling can take goes to the level above, since a
subtree is never handed more than it can hold. A leaf's budget is a number of whole epochs and a prefix
of the next one, in the order of md5(seed, epoch, doc_id).

Tokens and budgets are whole numbers; a level is a quotient in double precision and a share of it is rounded down, so about
one token for each node of the tree goes unspent. Nulls: null language or source are ``und`` and ``none``; a null text has no tokens;
null ids count as empty. Documents without tokens are taken when their place in the order lies before
the cut. Repeated rows count once each; equal ones have their places one after the other. An empty table gives no rows; a weight of 0 takes nothing; names
that the weights don't list have the weight ``default``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import WORD, aside, clean_name, stage
from lodestone.llm.prefix import before

SEED = 20240601
MAX_EPOCHS = 2
#: The budget in hundredths of all tokens.
BUDGET_PERCENT = 90
DOMAINS = {"web": 60, "books": 40}
LANGS = {"en": 60, "de": 15, "fr": 15, "es": 10}
SOURCES: dict[str, int] = {"src0": 7}
DEFAULT = 1
TREE = ["domain", "language", "src"]
#: Leaves that may be broadcast: about 100 bytes each.
LEAVES = 200_000


def domain_of(source: Column) -> Column:
    """The tables name no domain: half of all sources, by the first hexadecimal digit of the md5, are web."""
    return F.when(F.substring(F.md5(source), 1, 1) < "8", "web").otherwise("books")


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def weight_of(col: Column, weights: dict[str, int], default: int) -> Column:
    out = F.lit(default)
    for name, w in weights.items():
        out = F.when(col == name, w).otherwise(out)
    return out.cast("long")


def share(nodes: DataFrame, parent: list[str], budget: str, out: str) -> DataFrame:
    """Divides each parent's ``budget`` among its rows by ``weight``, none above its ``cap``.

    In the order of cap / weight, t = (budget - caps before) / (weights not before) is the level if all
    rows before are full; the greatest t is the true level, and a row gets the lesser of cap and t * weight."""
    w = Window.partitionBy(*parent)
    order = w.orderBy(F.col("cap") / F.col("weight"), *[c for c in TREE if c in nodes.columns])
    prior = order.rowsBetween(Window.unboundedPreceding, -1)
    t = (F.col(budget) - F.coalesce(F.sum("cap").over(prior), F.lit(0))) / (F.sum("weight").over(w) - F.coalesce(F.sum("weight").over(prior), F.lit(0)))
    level = nodes.filter("weight > 0").withColumn("_t", t).withColumn("_level", F.max("_t").over(w))
    return level.withColumn(out, F.least(F.col("cap"), F.floor(F.col("_level") * F.col("weight")))).drop("_t", "_level")


def leaf_budgets(leaves: DataFrame, domains: dict, langs: dict, sources: dict, default: int, max_epochs: int, budget_percent: int) -> DataFrame:
    """leaves: domain, language, src, supply. Adds the budget; the tables here have a row for each node."""
    weighted = {"domain": domains, "language": langs, "src": sources}
    total = leaves.agg(F.floor(F.coalesce(F.sum("supply"), F.lit(0)) * budget_percent / 100).alias("budget0"))
    upper = total
    for depth, name in enumerate(TREE, 1):
        keys = TREE[:depth]
        nodes = leaves.groupBy(*keys).agg((F.sum("supply") * max_epochs).alias("cap"), F.sum("supply").alias("supply"))
        nodes = nodes.withColumn("weight", weight_of(F.col(name), weighted[name], default))
        nodes = nodes.join(upper, TREE[: depth - 1]) if depth > 1 else nodes.crossJoin(F.broadcast(upper))  # one row
        upper = share(nodes, TREE[: depth - 1], f"budget{depth - 1}", f"budget{depth}").select(*keys, f"budget{depth}", *(["supply"] if depth == len(TREE) else []))
    return upper.withColumnRenamed(f"budget{len(TREE)}", "leaf_budget")


def _at_leaf(d: DataFrame, leaves: DataFrame) -> DataFrame:
    """d with its leaf's columns. A tree has few leaves, and a counted few are broadcast, so that no row of d moves; where
    sources are so many that they may not be, the join deals by leaf and AQE splits a hot one."""
    return d.join(F.broadcast(leaves) if leaves.count() <= LEAVES else leaves, TREE, "left")


def _placed(docs: DataFrame, domains: dict, langs: dict, sources: dict, default: int, max_epochs: int, budget_percent: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Each document's start in its leaf's order, and the leaves' budgets. What they need of a document is computed once and
    written to the shared folder."""
    d = stage(_narrow(docs), "mix")
    leaves = d.select(*TREE, "tokens").groupBy(*TREE).agg(F.sum("tokens").alias("supply"))
    budgets = stage(_budgeted(leaf_budgets(leaves, domains, langs, sources, default, max_epochs, budget_percent)), "mix-budgets")
    d = _with_key(_at_leaf(d, budgets), seed)
    d = d.withColumns({"_d0": F.substring("_key", 1, 2), "_d1": F.substring("_key", 3, 2)})
    # By five keys, so that a leaf is dealt out whatever the join has left of it in one place.
    return before(d.repartition(*TREE, "_d0", "_d1"), TREE, ["_d0", "_d1"], ["_key", "tokens", "_text"], "tokens", "_start"), budgets


def _narrow(docs: DataFrame, *more: str) -> DataFrame:
    d = docs.select("doc_id", F.coalesce(F.col("lang"), F.lit("und")).alias("language"), F.coalesce(F.col("source"), F.lit("none")).alias("src"), n_tokens(F.col("text")).alias("tokens"), F.xxhash64("text").alias("_text"), *more)
    return d.withColumn("domain", domain_of(F.col("src")))


def _budgeted(leaves: DataFrame) -> DataFrame:
    """full_epochs and _tail, the tokens of the last epoch's prefix, of each leaf's budget."""
    some = F.col("supply") > 0
    epochs = F.when(some, F.expr("leaf_budget div supply")).otherwise(F.lit(0)).cast("long")
    return leaves.select(*TREE, F.col("leaf_budget").cast("long"), epochs.alias("full_epochs"), F.when(some, F.col("leaf_budget") % F.col("supply")).otherwise(F.lit(0)).cast("long").alias("_tail"))


def _with_key(d: DataFrame, seed: int) -> DataFrame:
    """Leaves without a budget take nothing; _key places a document in its leaf's last epoch."""
    d = d.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("leaf_budget", "full_epochs", "_tail")})
    return d.withColumn("_key", F.md5(F.concat(F.lit(f"{seed}|"), F.col("full_epochs").cast("string"), F.lit("|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))


def mix(docs: DataFrame, domains: dict = DOMAINS, langs: dict = LANGS, sources: dict = SOURCES, default: int = DEFAULT, max_epochs: int = MAX_EPOCHS, budget_percent: int = BUDGET_PERCENT, seed: int = SEED) -> DataFrame:
    """A row for each document: domain, language, src, tokens, leaf_budget, full_epochs, tail_tokens (its
    tokens within the prefix of the last epoch) and copies (how often it is taken; a document that the
    cut runs through is taken whole)."""
    d, _ = _placed(docs, domains, langs, sources, default, max_epochs, budget_percent, seed)
    d = d.withColumn("tail_tokens", F.greatest(F.lit(0), F.least(F.col("tokens"), F.col("_tail") - F.col("_start"))).cast("long"))
    d = d.withColumn("copies", (F.col("full_epochs") + F.when(F.col("_start") < F.col("_tail"), 1).otherwise(0)).cast("long"))
    return d.select("doc_id", *TREE, "tokens", "leaf_budget", "full_epochs", "tail_tokens", "copies")


def mixed_documents(docs: DataFrame, domains: dict = DOMAINS, langs: dict = LANGS, sources: dict = SOURCES, default: int = DEFAULT, max_epochs: int = MAX_EPOCHS, budget_percent: int = BUDGET_PERCENT, seed: int = SEED) -> DataFrame:
    """The documents themselves, with all their columns, whatever they are called, each as often as :func:`mix` has copies
    of it. A leaf's prefix ends at one place of its order, so a table with one row for each leaf says all that a document must
    know, and texts stay where they are. Only rows at that very place, which are alike in leaf, id and text, are
    gathered: they are taken as often as the prefix has them, one row standing for all."""
    placed, budgets = _placed(docs, domains, langs, sources, default, max_epochs, budget_percent, seed)
    place = F.struct("_key", "tokens", "_text").alias("_place")
    placed = stage(placed.select(*TREE, place, (F.col("_start") < F.col("_tail")).alias("_in")), "mix-placed")
    cut = stage(placed.filter("_in").groupBy(*TREE).agg(F.max("_place").alias("_cut")), "mix-cut")
    at_cut = _at_leaf(placed, cut).filter("_place = _cut").groupBy(*TREE).agg(F.count("*").alias("_n_at"), F.count_if("_in").alias("_n_in"))
    leaves = stage(budgets.join(cut, TREE, "left").join(at_cut, TREE, "left"), "mix-leaves")
    rows = _with_key(_at_leaf(_narrow(aside(docs, "doc_id", "lang", "source", "text"), "row"), leaves), seed).withColumn("_place", place)
    rows = rows.withColumn("_last", F.coalesce((F.col("_place") == F.col("_cut")) & (F.col("_n_at") > 1), F.lit(False)))
    copies = F.col("full_epochs") + F.when(F.col("_place") <= F.col("_cut"), 1).otherwise(0)
    plain = rows.filter("not _last").select("row", copies.cast("int").alias("_copies"))
    taken = plain
    if not leaves.filter("_n_at > 1").isEmpty():
        last = rows.filter("_last").groupBy(*TREE).agg(F.first("row").alias("row"), F.first(F.col("full_epochs") * F.col("_n_at") + F.col("_n_in")).cast("int").alias("_copies"))
        taken = plain.unionByName(last.select("row", "_copies"))
    taken = taken.filter("_copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("row.*")


def query(docs: DataFrame) -> DataFrame:
    return mix(clean_name(docs, "doc_id", "text", "lang", "source"))


def _case(col: str, weights: dict[str, int]) -> str:
    return f"CASE {col} {' '.join(f"WHEN '{k}' THEN {w}" for k, w in weights.items())} ELSE {DEFAULT} END" if weights else str(DEFAULT)


def _level(name: str, depth: int, weights: dict[str, int], upper: str) -> str:
    keys, parent = ", ".join(TREE[:depth]), ", ".join(TREE[: depth - 1])
    part = f"PARTITION BY {parent} " if parent else ""
    join = f"JOIN {upper} USING ({parent})" if parent else f"CROSS JOIN {upper}"
    w = f"({part}ORDER BY cap / weight, {keys} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""n{depth} AS (SELECT {keys}, sum(supply)::BIGINT AS supply, (sum(supply) * {MAX_EPOCHS})::BIGINT AS cap, {_case(TREE[depth - 1], weights)}::BIGINT AS weight FROM leaves GROUP BY {keys}),
t{depth} AS (SELECT n{depth}.*, budget{depth - 1}, (budget{depth - 1} - coalesce(sum(cap) OVER {w}, 0))::DOUBLE / (sum(weight) OVER ({part}) - coalesce(sum(weight) OVER {w}, 0))::DOUBLE AS t FROM n{depth} {join} WHERE weight > 0),
{name} AS (SELECT {keys}, supply, least(cap, floor(max(t) OVER ({part}) * weight))::BIGINT AS budget{depth} FROM t{depth})"""


ORACLE_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(lang, 'und') AS language, coalesce(source, 'none') AS src, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS tokens FROM documents
), e AS (SELECT *, CASE WHEN substr(md5(src), 1, 1) < '8' THEN 'web' ELSE 'books' END AS domain FROM d),
leaves AS (SELECT domain, language, src, sum(tokens)::BIGINT AS supply FROM e GROUP BY ALL),
total AS (SELECT floor(coalesce(sum(supply), 0) * {BUDGET_PERCENT} / 100)::BIGINT AS budget0 FROM leaves),
{_level("b1", 1, DOMAINS, "total")}, {_level("b2", 2, LANGS, "b1")}, {_level("b3", 3, SOURCES, "b2")},
f AS (SELECT e.*, coalesce(budget3, 0)::BIGINT AS leaf_budget, coalesce(supply, 0)::BIGINT AS supply FROM e LEFT JOIN b3 USING (domain, language, src)),
g AS (SELECT *, CASE WHEN supply > 0 THEN leaf_budget // supply ELSE 0 END AS full_epochs, CASE WHEN supply > 0 THEN leaf_budget % supply ELSE 0 END AS tail FROM f),
h AS (SELECT *, md5('{SEED}|' || full_epochs || '|' || coalesce(doc_id::VARCHAR, '')) AS k FROM g),
i AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY domain, language, src ORDER BY k, tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM h)
SELECT doc_id, domain, language, src, tokens, leaf_budget, full_epochs::BIGINT AS full_epochs, greatest(0, least(tokens, tail - start))::BIGINT AS tail_tokens,
  (full_epochs + CASE WHEN start < tail THEN 1 ELSE 0 END)::BIGINT AS copies FROM i
"""
