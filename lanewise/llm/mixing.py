"""Mixing sources to target weights: hierarchical budgets over a domain-language-source tree and seeded token-prefixes.

The budget goes down the tree level by level. Siblings share their parent's tokens by weight; one that can't supply its
share (tokens times the allowed epochs) is filled and the shortage is shared out anew among its siblings, so that a
shortage leaves a node for its ancestors' other children only if all siblings are exhausted: a parent's own supply is
the sum of its children's, and the parent was capped by it one level up. A leaf orders its documents in each epoch by
an md5 of seed, epoch and id, and takes them until its budget is met; the document that meets it is taken whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stage, table, words_of

LEVELS = ("domain", "lang", "source")
#: Relative weights of the production mix, by level; any value that isn't listed weighs 2.
WEIGHTS = {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 6, "de": 2, "fr": 2, "es": 2}, "source": {"src0": 3}}
SEED, BUDGET_SHARE, MAX_EPOCHS = 17, 0.5, 2
#: Documents of one stretch of a leaf's order, on average.
STRETCH_ROWS = 2048


def domain_of(source: Column) -> Column:
    """The stand-in for a catalogue of domains: four domains by the source's number (d0 for sources without one)."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), r"(\d{1,9})$", 1)
    return F.concat(F.lit("d"), F.when(number == "", F.lit(0)).otherwise(F.pmod(number.try_cast("int"), F.lit(4))).cast("string"))


def weight_of(level: str, weights: dict[str, dict[str, int]]) -> Column:
    out = F.lit(2)
    for name, w in weights.get(level, {}).items():
        out = F.when(F.col(level) == name, F.lit(w)).otherwise(out)
    return out.cast("long")


def fill(nodes: DataFrame, parent: Sequence[str], name: str) -> DataFrame:
    """Share `budget` of each parent among its children by `weight`, none beyond `capacity`; adds `tokens`.

    Children come in ascending order of capacity to weight: those before the first that its fair share doesn't exhaust
    are full, and the rest share what is left by weight.
    """
    order = Window.partitionBy(*parent).orderBy(F.col("capacity") / F.col("weight"), name)
    full, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("budget") - F.coalesce(F.sum("capacity").over(full), F.lit(0))) / F.sum("weight").over(rest)
    whole = Window.partitionBy(*parent)
    return (
        nodes.withColumn("level", level)
        .withColumn("share", F.min(F.when(F.col("level") * F.col("weight") < F.col("capacity"), F.struct(F.col("capacity") / F.col("weight"), F.col(name), F.col("level")))).over(whole)["level"])
        .withColumn("tokens", F.when(F.col("share").isNull() | (F.col("share") * F.col("weight") >= F.col("capacity")), F.col("capacity")).otherwise(F.floor(F.greatest(F.col("share"), F.lit(0.0)) * F.col("weight"))).cast("long"))
        .drop("level", "share")
    )


def budgets(leaves: DataFrame, total: Column, weights: dict[str, dict[str, int]], max_epochs: int) -> DataFrame:
    """leaves: LEVELS and supply. Returns LEVELS, supply and tokens, the leaf's budget."""
    for level in LEVELS:
        leaves = leaves.withColumn(f"w_{level}", weight_of(level, weights))
    out = None
    for depth, level in enumerate(LEVELS):
        keys = list(LEVELS[: depth + 1])
        nodes = leaves.groupBy(*keys, F.col(f"w_{level}").alias("weight")).agg((F.sum("supply") * max_epochs).alias("capacity"), F.sum("supply").alias("supply"))
        parent = keys[:-1]
        nodes = nodes.withColumn("budget", total) if out is None else nodes.join(out.select(*parent, F.col("tokens").alias("budget")), parent)
        out = fill(nodes.withColumn("_all", F.lit(0)), [*parent, "_all"], level)
    return out.select(*LEVELS, "supply", "tokens")


def select_mix(docs: DataFrame, weights: dict | None = None, budget_share: float = BUDGET_SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED, stretch_rows: int = STRETCH_ROWS) -> DataFrame:
    """All columns of docs and `epoch` (from 0): one row for each time that a document is taken.

    The budget is budget_share of all tokens (words). Null lang or source is the value '' of its level; null texts and
    texts without a word have no tokens and are never taken; ids order ties, repeated rows of one id go together, null
    ids are ordered as ''; further columns pass through, but for one named epoch, which is replaced. An empty table
    gives no rows.
    """
    weights = WEIGHTS if weights is None else weights
    own = docs.withColumn("_mix", F.struct(
        domain_of(F.col("source")).alias("domain"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"),
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
    ))
    order = lambda epoch: F.md5(F.concat(F.lit(f"{seed}-"), epoch.cast("string"), F.lit("-"), F.col("id")).cast("binary"))
    ids = stage(own.select("_mix.*", F.size(words_of(F.col("text"))).cast("long").alias("n")).where("n > 0"), "mix-ids")
    leaves = ids.groupBy(*LEVELS).agg(F.sum("n").alias("supply"), F.count("*").alias("docs"))
    leaves = stage(leaves, "mix-leaves")
    total = leaves.agg(F.sum("supply")).first()[0] or 0
    budget = int(total * budget_share)
    plan = budgets(leaves.drop("docs"), F.lit(budget).cast("long"), weights, max_epochs)
    plan = plan.join(leaves.select(*LEVELS, "docs"), list(LEVELS)).select(
        *LEVELS, "tokens", "supply",
        F.floor(F.col("tokens") / F.col("supply")).cast("int").alias("whole"),
        (F.col("tokens") % F.col("supply")).alias("rest"),
        # Stretches are a power of 16 up to 16 ** 6: leading hex digits of the order key.
        F.least(F.lit(6), F.greatest(F.lit(0), F.ceil(F.log(16.0, F.col("docs") / F.lit(stretch_rows))))).cast("int").alias("digits"),
    )
    plan = stage(plan, "mix-plan")
    # The last, partial epoch of each leaf: find the key at which its tokens are met. Sums by stretch of the order come
    # first, so that only the one stretch in which the budget ends is ordered by row.
    part = ids.join(plan.where("rest > 0"), list(LEVELS)).withColumn("key", order(F.col("whole"))).withColumn("stretch", F.expr("substring(key, 1, digits)"))
    sums = part.groupBy(*LEVELS, "stretch", "rest").agg(F.sum("n").alias("n"))
    before = Window.partitionBy(*LEVELS).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    ends = sums.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).where("before < rest and before + n >= rest")
    ends = stage(ends.select(*LEVELS, "stretch", "before"), "mix-ends")
    inside = part.join(ends, [*LEVELS, "stretch"]).groupBy(*LEVELS, "key", "rest", "before").agg(F.sum("n").alias("n"))
    row = Window.partitionBy(*LEVELS).orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    last = inside.withColumn("met", F.col("before") + F.coalesce(F.sum("n").over(row), F.lit(0))).where("met < rest").groupBy(*LEVELS).agg(F.max("key").alias("last"))
    plan = stage(plan.select(*LEVELS, "whole").join(last, list(LEVELS), "left"), "mix-cuts")
    cuts = plan.select(F.struct(*LEVELS).alias("_leaf"), F.col("whole").alias("_whole"), F.col("last").alias("_last"))
    joined = own.where(F.size(words_of(F.col("text"))) > 0).join(cuts, F.struct(*(F.col(f"_mix.{c}") for c in LEVELS)) == F.col("_leaf"))
    key = F.md5(F.concat(F.lit(f"{seed}-"), F.col("_whole").cast("string"), F.lit("-"), F.col("_mix.id")).cast("binary"))
    takes = F.col("_whole") + F.when(key <= F.col("_last"), 1).otherwise(0)
    epochs = F.when(takes > 0, F.sequence(F.lit(0), takes - 1)).otherwise(F.array().cast("array<int>"))
    return joined.withColumn("epoch", F.explode(epochs)).drop("_mix", "_leaf", "_whole", "_last")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_mix(table(spark, sf_dir, "documents")).select("doc_id", "lang", "source", "epoch")


#: The same selection by plain windows: no stretches, whole leaves at once.
OP9_SQL = """
with d as (
  select doc_id, lang, source, coalesce(lang, '') l, coalesce(source, '') s,
    'd' || case when regexp_extract(coalesce(source, ''), '([0-9]{1,9})$', 1) = '' then 0 else cast(regexp_extract(coalesce(source, ''), '([0-9]{1,9})$', 1) as integer) % 4 end m,
    coalesce(cast(doc_id as varchar), '') id,
    cast(len(list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '')) as bigint) n
  from documents),
leaf as (select m, l, s, sum(n)::bigint supply from d where n > 0 group by all),
w as (select *, case m when 'd0' then 4 when 'd1' then 3 when 'd2' then 2 when 'd3' then 1 else 2 end wm,
  case l when 'en' then 6 else 2 end wl, case s when 'src0' then 3 else 2 end ws from leaf),
b as (select cast(floor(sum(supply) * 0.5) as bigint) budget from leaf),
m0 as (select m, wm weight, sum(supply)::bigint * 2 capacity, any_value(budget) budget from w, b group by m, wm),
m1 as (select *, (budget - coalesce(sum(capacity) over (order by capacity / weight, m rows between unbounded preceding and 1 preceding), 0))::double
  / (sum(weight) over (order by capacity / weight, m rows between current row and unbounded following))::double lev from m0),
m2 as (select *, (select arg_min(lev, (capacity / weight, m)) from m1 where lev * weight < capacity) share from m1),
mm as (select m, case when share is null or share * weight >= capacity then capacity else floor(greatest(share, 0.0) * weight)::bigint end tokens from m2),
l0 as (select w.m, l, wl weight, sum(supply)::bigint * 2 capacity, any_value(tokens) budget from w join mm on w.m = mm.m group by w.m, l, wl),
l1 as (select *, (budget - coalesce(sum(capacity) over (partition by m order by capacity / weight, l rows between unbounded preceding and 1 preceding), 0))::double
  / (sum(weight) over (partition by m order by capacity / weight, l rows between current row and unbounded following))::double lev from l0),
l2 as (select *, arg_min(lev, (capacity / weight, l)) filter (where lev * weight < capacity) over (partition by m) share from l1),
ll as (select m, l, case when share is null or share * weight >= capacity then capacity else floor(greatest(share, 0.0) * weight)::bigint end tokens from l2),
s0 as (select w.m, w.l, s, ws weight, supply, supply * 2 capacity, tokens budget from w join ll on w.m = ll.m and w.l = ll.l),
s1 as (select *, (budget - coalesce(sum(capacity) over (partition by m, l order by capacity / weight, s rows between unbounded preceding and 1 preceding), 0))::double
  / (sum(weight) over (partition by m, l order by capacity / weight, s rows between current row and unbounded following))::double lev from s0),
s2 as (select *, arg_min(lev, (capacity / weight, s)) filter (where lev * weight < capacity) over (partition by m, l) share from s1),
ss as (select m, l, s, supply, case when share is null or share * weight >= capacity then capacity else floor(greatest(share, 0.0) * weight)::bigint end tokens from s2),
e as (select d.*, tokens // supply whole, tokens % supply rest, unnest(range(0, tokens // supply + 1)) epoch from d join ss on d.m = ss.m and d.l = ss.l and d.s = ss.s where n > 0),
k as (select *, md5('17-' || epoch || '-' || id) k from e),
c as (select *, coalesce(sum(n) over (partition by m, l, s, epoch order by k range between unbounded preceding and current row exclude group), 0) met from k)
select doc_id, lang, source, epoch::integer epoch from c where epoch < whole or met < rest
"""
