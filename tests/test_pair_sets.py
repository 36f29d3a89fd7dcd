"""Pair sets by name, as SQL table functions."""

from loomline.operators import pair_sets as PS
from loomline.sources import sinks

KIND = "name string, grp string, source string, summary string"


def test_sets_and_variants_by_name(spark, tmp_path):
    a = spark.createDataFrame([("a1", "g", "one two three", "one two"), ("a2", "g", None, "x"), ("a3", "h", "one", "x y"), ("a4", "h", "one two three", "")], KIND)
    b = spark.createDataFrame([("b1", None, "s", "t")], KIND)
    path = f"file://{tmp_path}/folds"
    sinks.upsert_variants(spark.createDataFrame([("w1", "u", "src words", "fold", "prose"), ("w2", "u", "src", "other", "it's"), ("w3", "u", "hidden", "x", "b")], "win string, who string, src string, text string, variant string"), path, "t", "2026-01-01")
    PS.register(spark, {"a": a, "b": b}, PS.from_variants(spark.read.parquet(f"{path}/rows"), "win", "who", "src"), "some_pairs")

    ask = lambda q: {tuple(r) for r in spark.sql(q).collect()}
    assert ask("select name, reason from some_pairs('a', 2, 2)") == {("a1", None), ("a2", "no source"), ("a3", "short source"), ("a4", "no summary")}
    assert ask("select name, grp, summary from some_pairs('b')") == {("b1", None, "t")}  # the variant of that name is hidden
    assert ask("select pair_set, name, source, summary from some_pairs('it\\'s')") == {("it's", "w2", "src", "other")}
    assert ask("select name from some_pairs('none')") == set()
    assert ask("select pair_set, count(*) from some_pairs(null) group by 1") == {("a", 4), ("b", 1), ("prose", 1), ("it's", 1)}

    # only what is asked for is read: one set's plan, or one variant's folder
    plan = spark.sql("select summary from some_pairs('prose')")._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" in plan and "Union" not in plan and "LogicalRDD" not in plan and "src" not in plan.split("Relation")[0]

    # a variant that is written later is a set without more code
    sinks.upsert_variants(spark.createDataFrame([("w9", "u", "s", "t", "later")], "win string, who string, src string, text string, variant string"), path, "t", "2026-01-02")
    PS.register(spark, {"a": a}, PS.from_variants(spark.read.parquet(f"{path}/rows"), "win", "who", "src"), "some_pairs")
    assert ask("select name from some_pairs('later')") == {("w9",)} and ask("select name from some_pairs('b')") == {("w3",)}
