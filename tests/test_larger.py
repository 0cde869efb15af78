"""What goes wrong only on larger tables: rarer texts, full batches, tables that the driver can't hold."""

import duckdb
import pyarrow as pa

import __spark_entry__ as entry
from paperweir.sources import markup
from paperweir.storage import steps

ODD = "<h1>a &quot;b&quot; &amp;&amp</h1><ul><li>x &eacute; &copy; &amp;lt;</li></ul><p>&lt;&#x27;&#39;&nbsp;y &amp</p>"


def against_sql(spark, tmp_path, name, table, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{table}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    df = entry.queries()[name](spark, str(tmp_path))
    found = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    return sorted(map(tuple, df.select(*names).collect())), sorted(found.fetchall())


def test_html_blocks_references(spark, tmp_path):
    got, want = against_sql(spark, tmp_path, "html_blocks", "pages", [(1, ODD)], "page_id long, html string")
    assert got == want


def test_html_headings_references(spark, tmp_path):
    got, want = against_sql(spark, tmp_path, "html_headings", "pages", [(1, ODD)], "page_id long, html string")
    assert got == want
    made = markup.html_blocks(spark.createDataFrame([(1, ODD)], "doc_id long, text string"), tables=False).orderBy("at").collect()
    assert made[0]["text"] == 'a "b" &&' and made[1]["text"] == "- x é © &lt;"  # the reader knows every reference


def test_pages_of_a_full_batch_are_taken_in_steps(spark):
    texts = ["x" * n for n in (0, 5, 900, 2_000, 1, 1, 1_100)] + [None]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(8)), "text": pa.array(texts)})
    cut = [s.column("doc_id").to_pylist() for s in steps(batch, "text", 1_000)]
    assert cut == [[0, 1, 2], [3], [4, 5], [6], [7]]
    page = "<h2>t</h2><table><tr><td>a</td><td colspan=2>b</td></tr></table><p>" + "word " * 60_000
    many = spark.createDataFrame([(i, page if i % 3 else "<p>p") for i in range(12)], "doc_id long, text string").coalesce(1)
    made = markup.html_blocks(many).groupBy("doc_id").count().collect()
    assert sorted((r["doc_id"], r["count"]) for r in made) == [(i, 3 if i % 3 else 1) for i in range(12)]


def test_tables_of_words_stay_off_the_driver(spark):
    from paperweir.operators import words

    names = spark.range(3_000).selectExpr("concat('n', id) AS w")
    rows = spark.range(40_000).selectExpr("id", "CASE WHEN id % 5 = 0 THEN NULL WHEN id % 5 < 3 THEN 'n7' ELSE concat('n', id) END AS value")
    want = {r["id"] for r in rows.collect() if r["value"] and int(r["value"][1:]) < 3_000}
    for how, ids in (("left_semi", want), ("left_anti", set(range(40_000)) - want)):
        made = words.among(rows, "value", names, how, 0)
        assert {r["id"] for r in made.collect()} == ids and made.count() == len(ids)
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan and "strategy=merge" in plan  # neither repeated for salts nor left to Spark's guess


def test_letters_of_one_small_file_are_dealt_to_tasks(spark, tmp_path):
    from paperweir.plans import queries

    spark.range(12_000).selectExpr("id AS c_custkey", "concat('c', id) AS c_name", "'x' AS c_mktsegment").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    assert queries.people(spark, str(tmp_path)).rdd.getNumPartitions() == 3


def test_matches_of_steps_and_batches_stay_together(spark):
    """Texts beyond one step, and chains of overlapping matches cut by batches, give the findings of each text alone."""
    from paperweir.operators import redaction

    chain = "123456-1234567-" + "-".join("123456" for _ in range(40))
    texts = [chain, "성명: 김철수 a@b.co " + "x " * 400_000, chain + " 김철수", None, "성명: 홍길동 " + "y " * 400_000 + chain]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    alone = sorted((i, r["kind"], r["start"], r["end"], r["placeholder"]) for i in range(5) for r in redaction.detect(docs.where(f"doc_id = {i}")).collect())
    assert redaction.matches(docs).groupBy("doc_id").count().count() == 4
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
        assert sorted((r["doc_id"], r["kind"], r["start"], r["end"], r["placeholder"]) for r in redaction.detect(docs).collect()) == alone
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_containers_of_one_small_file_are_dealt_to_tasks(spark, tmp_path):
    from paperweir.plans import containers

    spark.range(5_000).selectExpr("id AS c_custkey", "concat('c', id) AS c_name", "'x' AS c_mktsegment").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    assert containers._files(spark, str(tmp_path)).rdd.getNumPartitions() == 3
