from pyspark.sql import functions as F

from inkgrove.operators import audit as A
from inkgrove.operators import index as I
from inkgrove.operators import ingest as G
from inkgrove.operators import retrieval as R
from inkgrove.streaming import twins


def corpus(spark):
    rows = [(1, "a", 0, "x", "alpha beta gamma", "2024-01-01", "c1"), (2, "b", 3, "y", "alpha alpha delta", "2024-01-05", "c2"), (3, "c", 4, None, "omega", "2024-02-01", "c3")]
    return spark.createDataFrame(rows, "id int, name string, ring int, bereich string, text string, updated string, citation string").withColumn("updated", F.to_timestamp("updated"))


def test_filter_stands_before_limit(spark):
    b = corpus(spark)
    assert [r.citation for r in R.bm25(b, "alpha", 1).collect()] == ["c2"]
    hidden = R.bm25(b, "alpha", 1, F.col("id") != 2).collect()
    assert [r.citation for r in hidden] == ["c1"] and R.bm25(b, "alpha", 1).where("id <> 2").count() == 0


def test_scopes(spark):
    b = corpus(spark)
    assert R.in_scope(b, scope=[]).count() == 0 and R.in_scope(b, scope=["x", "y"]).count() == 2 and R.in_scope(b, ring=4).count() == 1


def test_query_syntax_never_breaks(spark):
    for q in ("", "\"", "a AND (", "*", "😀", "NEAR(x y)"):
        R.bm25(corpus(spark), q).collect()


def test_supersession_truth_table(spark):
    ts = lambda d: f"timestamp'{d}'"
    n = spark.sql(f"""SELECT * FROM VALUES
        ('old1', 2, 'new1', array(), {ts('2024-01-01')}, null), ('new1', 4, null, array(), {ts('2024-01-02')}, null),
        ('old2', 1, null, array(), {ts('2024-01-01')}, null), ('claim2', 3, null, array('old2'), {ts('2024-01-01')}, null),
        ('old3', 3, null, array(), {ts('2024-01-01')}, null), ('claim3', 1, null, array('old3'), {ts('2024-01-01')}, {ts('2024-06-01')}),
        ('self', 1, 'self', array(), {ts('2024-01-01')}, null), ('lost', 1, 'nowhere', array('gone'), {ts('2024-01-01')}, null)
        AS t(name, ring, superseded_by, supersedes, created, valid_from)""")
    at = lambda d: {(r.old, r.new) for r in R.superseded(n, F.lit(d).cast("timestamp")).collect()}
    assert at("2024-03-01") == {("old1", "new1"), ("lost", "nowhere"), ("gone", "lost")}
    assert ("old3", "claim3") in at("2024-07-01") and ("old2", "claim2") not in at("2024-07-01")


def test_tampered_chains(spark):
    log = spark.range(1, 21).select(F.col("id").alias("seq"), F.lit("d").alias("device"), F.lit("a").alias("actor"), F.lit("x").alias("action"), F.lit(None).cast("string").alias("subject"), F.lit("{}").alias("detail"))
    sealed = A.seal(log).cache()
    first = lambda df: A.verify_chain(df).first().first_break
    assert first(sealed) is None
    assert first(sealed.withColumn("actor", F.when(F.col("seq") == 7, "b").otherwise(F.col("actor")))) == 7
    assert first(sealed.where("seq <> 9")) == 10
    swapped = sealed.withColumn("seq", F.when(F.col("seq") == 3, 4).when(F.col("seq") == 4, 3).otherwise(F.col("seq")))
    assert first(swapped) == 3
    floor = sealed.where("seq = 5").select("device", F.col("hash").alias("floor_hash"))
    assert A.verify_chain(sealed.where("seq > 5"), anchors=floor).first().first_break is None
    assert A.forks(sealed.union(sealed.where("seq = 4"))).count() == 1
    lines = [r.value for r in A.export_lines(sealed).collect()]
    assert len(lines) == 22 and '"rows":20' in lines[-1]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101)], "a int, b int")
    nodes = spark.createDataFrame([(i,) for i in [*range(31), 100, 101, 200]], "node int")
    roots = {r.node: r.root for r in I.connected(nodes, edges).collect()}
    assert set(roots[i] for i in range(31)) == {0} and roots[101] == 100 and roots[200] == 200


def test_lossless_cut_and_hash_names(spark):
    f = spark.createDataFrame([("p", "intro\n# A\nx\n## B\ny")], "path string, content string")
    parts = [r.part for r in G.cut_sections(f).orderBy("idx").collect()]
    assert "".join(parts) == "intro\n# A\nx\n## B\ny" and len(parts) == 3
    items = spark.createDataFrame([("n", "a", "1"), ("n", "b", "2"), ("m", "c", "1")], "name string, path string, body string")
    named = {r.path: r.final_name for r in G.resolve_collisions(items, "hash").collect()}
    assert named["c"] == "m" and named["a"] != named["b"] and named["a"].startswith("n-")


def test_streams(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", "u", "x", "{}", 1.0, "recall"), (2, "2024-01-01 00:00:01", "u", "x", "{}", 1.0, "recall"), (3, "2024-01-02 00:00:00", "u", "x", "{}", 2.0, "recall"), (4, "2024-01-09 00:00:00", "v", "x", "{}", 2.0, "find")]
    schema = "seq long, at timestamp, actor string, action string, detail string, value double, op string"
    spark.createDataFrame([(s, __import__("datetime").datetime.fromisoformat(t), *r) for s, t, *r in rows], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))

    def run(df, name, mode="append"):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name).collect()

    assert sorted(str(r["at"]) for r in run(twins.drop_repeats(stream()), "t1")) == ["2024-01-01 00:00:00", "2024-01-02 00:00:00", "2024-01-09 00:00:00"]
    assert ("recall", 2) in {(r.op, r.ops) for r in run(twins.daily_usage(stream()), "t2")}
    assert len(run(twins.session_counts(stream()), "t3")) >= 1
    chain = spark.createDataFrame([("d", 1, None, "h1"), ("d", 2, "h1", "h2"), ("d", 3, "hx", "h3"), ("d", 4, "h2", "h4")], "device string, seq long, prev string, hash string")
    chain.write.parquet(str(tmp_path / "chain"))
    delivered = spark.readStream.schema(chain.schema).parquet(str(tmp_path / "chain"))
    assert {(r.seq, r.accepted) for r in run(twins.accept_deliveries(delivered), "t4")} == {(1, True), (2, True), (3, False), (4, True)}
    numbered = twins.arrival_order(spark.range(100).repartition(3), 7)
    assert sorted(r.sync_seq for r in numbered.collect()) == list(range(8, 108))
