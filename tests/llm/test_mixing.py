from pyspark.sql import functions as F

from fichero.llm import mixing


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    """Targets by sharing again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, open_ = {}, share * sum(sizes.values()), set(names)
    while open_:
        part = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if part[s] >= cap * sizes[s]}
        if not over:
            return target | part
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def docs(spark):
    rows = [(i, f"src{i % 4}", "w " * (1 + i * 7 % 60)) for i in range(600)] + [(1000 + i, "src0", "a b c") for i in range(900)]
    rows += [(2000, None, "one two"), (2001, None, None), (2002, "empty", ""), (2003, "é", "x y"), (2004, "É", "x"), (1, "src1", "w w")]
    return spark.createDataFrame(rows, "doc_id long, source string, text string")


def test_mix(spark):
    mixed = mixing.mix(docs(spark).withColumn("size", F.lit("kept")).withColumn("weight", F.lit(1))).cache()
    assert mixed.count() == docs(spark).count() and [r[0] for r in mixed.select("size").distinct().collect()] == ["kept"]
    per = mixed.groupBy("source").agg(F.sum("mix_size").alias("n"), F.min("mix_target").alias("t"), F.sum(F.col("mix_size") * F.col("mix_copies")).alias("taken"), F.max("mix_source_size").alias("s"), F.max("mix_size").alias("most"), F.sum(F.col("mix_size") * F.col("mix_rate")).alias("rate"))
    rows = {r["source"]: r for r in per.collect()}
    want = plain_targets({s: r["n"] for s, r in rows.items()})
    for s, r in rows.items():
        assert abs(r["t"] - want[s]) < 1e-6 * max(1, want[s]) and r["s"] == r["n"]
        assert abs(r["rate"] - want[s]) <= 1e-4 * max(1, want[s])
        assert abs(r["taken"] - want[s]) <= max(1, r["most"])
    assert mixed.agg(F.min("mix_copies"), F.max("mix_copies")).first()[0:2] >= (0, 1) and mixed.filter("mix_copies not in (0, 1, 2)").isEmpty()
    again = mixing.mix(docs(spark).repartition(7).withColumn("size", F.lit("kept")).withColumn("weight", F.lit(1)))
    key = ["doc_id", "mix_size", "mix_copies"]
    assert sorted(mixed.select(key).collect()) == sorted(again.select(key).collect())


def test_empty_and_repeat(spark):
    none = docs(spark).limit(0)
    assert mixing.mix(none).count() == 0 and mixing.repeat(none).columns == none.columns
    assert mixing.repeat(docs(spark)).count() > 0
