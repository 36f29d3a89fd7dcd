"""How filters interact: every order of them replayed over every document.

Each document gets a flag for each filter (one bit of an integer). The flags are crossed with all orders of the
filters, 120 rows for five, which are sent to every executor; the step at which an order removes the document is that
of its first filter with a flag. A row for each step is exploded and summed by (part, order, step). The sums are made
in the map tasks, so what is shuffled are some 600 rows for each part and task, whatever the number of documents; a
part may hold any share of them.

Copies: the smallest id of each text is found by its SHA-256, again with map-side minima; only texts that occur under several ids
are joined back, map-side where they are proven few and otherwise by a join that Spark may split.

Defined results: null text is empty (and so equal to other empty texts), a null part is ''; a row without id is never
a copy, nor does it make others copies, and it has no label; rows that repeat an id are rows of their own and no
copies of one another; of several labels of an id the largest counts; an empty table gives no rows. Other columns take no part.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, store

#: Copied texts, and labelled ids, up to which their table may be sent to every executor.
MAX_SENT = 500_000
WORD = r"[^\x20\x09-\x0D]+"
#: Fixed values of the registered audit.
LETTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 100, 80, 10


def rules(text: Column) -> dict[str, Column]:
    """The failure conditions that look at one text alone."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return {
        "A": F.size("words") < LEAST_WORDS,
        "B": F.size(F.array_distinct("words")) * 100 < F.size("words") * DISTINCT_PERCENT,
        "C": F.regexp_count(text, F.lit("[A-Z]")) * 100 > F.length(text) * CAPITAL_PERCENT,
        "D": text.rlike("[#$%&*|]"),
        "words": words,
    }


def flags(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(k, part, hash, bits): a stored row for each document, with bit i set where it fails the i-th of A to D."""
    own = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    tests = rules(F.col("t"))
    own = own.withColumn("words", tests.pop("words"))
    bits = sum((F.when(c, F.lit(1 << LETTERS.index(x))).otherwise(F.lit(0)) for x, c in tests.items()), F.lit(0))
    return store(own.select("k", "part", F.unhex(F.sha2("t", 256)).alias("hash"), bits.alias("bits")), "audit-flags")


def copies(rows: DataFrame) -> DataFrame:
    """(hash, first): the smallest id of each text that stands under several ids."""
    return rows.where("k is not null").groupBy("hash").agg(F.min("k").alias("first"), F.max("k").alias("last")).where("first < last").drop("last")


def labelled(rows: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """``rows`` with good and toxic, each 0 or 1, by the id ``k``."""
    is_one = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    of = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("k")).agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic")).where("good = 1 or toxic = 1")
    return rows.join(small(store(of, "audit-labels"), MAX_SENT), "k", "left").fillna(0, ["good", "toxic"])


def orders(rows: DataFrame, letters: str) -> DataFrame:
    """(o, filter_order, masks): all orders of the filters, the bits of each in its order."""
    all_orders = ["".join(p) for p in permutations(letters)]
    masks = lambda p: F.array(*[F.lit(1 << letters.index(x)) for x in p])
    table = F.array(*[F.struct(F.lit(i).alias("o"), F.lit(p).alias("filter_order"), masks(p).alias("masks")) for i, p in enumerate(all_orders)])
    return rows.sparkSession.range(1).select(F.inline(table))


def replay(rows: DataFrame, letters: str = LETTERS) -> DataFrame:
    """The audit of rows (part, bits, good, toxic): one row for each part, order and step."""
    n = len(letters)
    of = orders(rows, letters)
    first = F.lit(n + 1)
    for i in range(n, 0, -1):
        first = F.when(F.expr(f"bits & masks[{i - 1}]") != 0, F.lit(i)).otherwise(first)
    crossed = rows.select("part", "bits", "good", "toxic").crossJoin(F.broadcast(of.select("o", "masks"))).select("part", "o", "bits", "good", "toxic", "masks", first.alias("first"))  # a factorial of few filters
    steps = crossed.select("part", "o", "bits", "good", "toxic", "first", F.posexplode("masks").alias("at", "mask"))
    fails, here = F.expr("bits & mask") != 0, F.col("first") == F.col("at") + 1
    total = lambda c, name: F.sum(F.when(c, F.lit(1)).otherwise(F.lit(0))).alias(name)
    sums = steps.groupBy("part", "o", "at").agg(
        total(F.col("first") > F.col("at") + 1, "kept"), total(here, "removed"), total(fails & (F.col("first") <= F.col("at")), "redundant"), total(F.col("bits") == F.col("mask"), "unique_fails"),
        total(here & (F.col("good") == 1), "good_lost"), total(here & (F.col("toxic") == 1), "toxic_lost"))
    named = sums.join(F.broadcast(of.select("o", "filter_order")), "o").withColumn("letter", F.expr("substring(filter_order, at + 1, 1)"))
    return named.withColumn("shapley", F.expr("sum(removed) over (partition by part, letter)")).select("part", "filter_order", (F.col("at") + 1).alias("step"), "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rows = flags(docs)
    again = small(store(copies(rows), "audit-copies"), MAX_SENT)
    e = F.when(F.col("k") > F.col("first"), F.lit(1 << LETTERS.index("E"))).otherwise(F.lit(0))
    return replay(labelled(rows.join(again, "hash", "left").select("k", "part", (F.col("bits") + e).alias("bits")), labels))


def _oracle() -> str:
    bit = {x: 1 << i for i, x in enumerate(LETTERS)}
    mask = lambda i: "case substr(filter_order, {}, 1) {} end".format(i, " ".join(f"when '{x}' then {b}" for x, b in bit.items()))
    chain = " union all ".join(f"select '{x}' as x, {b} as b" for x, b in bit.items())
    return f"""
with l as materialized ({chain}),
orders as (select a.x || b.x || c.x || d.x || e.x as filter_order from l a, l b, l c, l d, l e where a.b + b.b + c.b + d.b + e.b = 31 and (a.b | b.b | c.b | d.b | e.b) = 31),
docs as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
firsts as (select t, min(doc_id) as least from docs group by t),
lab as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id),
f as (select part, (len(w) < {LEAST_WORDS})::int + 2 * (100 * len(list_distinct(w)) < {DISTINCT_PERCENT} * len(w))::int + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > {CAPITAL_PERCENT} * length(t))::int
  + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(doc_id > least, false)::int as bits, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic
  from docs join firsts using (t) left join lab using (doc_id)),
x as (select f.*, filter_order, [{", ".join(mask(i) for i in range(1, 6))}] as m from f, orders),
y as (select *, case when bits & m[1] <> 0 then 1 when bits & m[2] <> 0 then 2 when bits & m[3] <> 0 then 3 when bits & m[4] <> 0 then 4 when bits & m[5] <> 0 then 5 else 6 end as first from x),
z as (select part, filter_order, s as step, count(*) filter (first > s) as kept, count(*) filter (first = s) as removed, count(*) filter (first < s and bits & m[s] <> 0) as redundant,
  count(*) filter (bits = m[s]) as unique_fails, count(*) filter (first = s and good = 1) as good_lost, count(*) filter (first = s and toxic = 1) as toxic_lost
  from y, (select unnest([1, 2, 3, 4, 5]) as s) group by 1, 2, 3)
select part, filter_order, step::int as step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails, good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost,
  (sum(removed) over (partition by part, substr(filter_order, step, 1)))::bigint as shapley from z
"""


ORACLE = _oracle()
