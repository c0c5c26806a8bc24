import json

import pytest
from pyspark.sql import functions as F

from tessella.sources import sinks, tables, web
from tessella.streaming import ingest

PAGE = "<html><head><title>A &amp; B</title><script>var x=1</script></head><body><nav>Menu</nav><article><p>First.</p><p>Second <b>bold</b></p></article><footer>©</footer></body></html>"


def test_page_text():
    assert web.page_text(PAGE) == ("A & B", "First.\nSecond bold")
    assert web.page_text("") == (None, None)


def test_extract_pages(spark):
    rows = web.extract_pages(spark.createDataFrame([(1, PAGE), (2, None)], "id int, html string"), "id", "html").orderBy("id").collect()
    assert rows[0].fetched_title == "A & B" and rows[1].article_text is None


def test_statuses():
    def gone(url):
        raise ConnectionError(url)

    long = "<p>" + "word " * 200 + "</p>"
    assert web.classify(lambda u: long, None, "u")[0] == "OK"
    assert web.classify(gone, lambda u: long, "u")[0] == "OK_WAYBACK"
    assert web.classify(lambda u: "<p>short</p>", None, "u")[0] == "TOO_SHORT"
    assert web.classify(lambda u: "<p></p>", None, "u")[0] == "NO_TEXT"
    assert web.classify(gone, gone, "u")[0] == "WAYBACK_ERR:ConnectionError"
    assert web.classify(gone, None, "u")[0] == "FAILED:ConnectionError"


def test_retry_waits_longer_each_time():
    waits, calls = [], []

    def fetch(url):
        calls.append(url)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert web.with_retry(fetch, sleep=waits.append)("u") == "ok" and waits == [1.0, 2.0]


def test_fetch_and_label_rows(spark):
    got = web.fetch_rows(spark.createDataFrame([("u",), (None,)], "url string"), lambda u: "<p>" + "w " * 300 + "</p>").collect()
    assert sorted(r.fetch_status for r in got) == ["NO_TEXT", "OK"]

    def label(text):
        if "bad" in text:
            raise ValueError("no answer")
        return "not json" if "odd" in text else web.stub_label(text)

    rows = {r.id: r for r in web.label_rows(spark.createDataFrame([(1, "#x"), (2, "bad"), (3, "odd"), (4, None)], "id int, t string"), "id", "t", label).collect()}
    assert rows[1].is_about_movement and rows[1].llm_error is None
    assert rows[2].llm_error.startswith("ValueError") and "schema" in rows[3].llm_error and rows[4].llm_error == "no text"


def test_csv_round_trip_with_line_breaks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "quoted"\nline', ["x", "y"]), (2, None, [])], "id int, t string, l array<string>")
    sinks.write_csv(df, str(tmp_path / "c"), one_file=True)
    back = tables.read_csv(spark, str(tmp_path / "c" / "*.csv"), "id int, t string, l string").orderBy("id").collect()
    assert back[0].t == 'a "quoted"\nline' and back[0].l == "x | y"


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([(1, "<b>&</b>")], "n int, t string")
    assert json.loads(sinks.to_json({"a": df})) == {"a": [{"n": 1, "t": "<b>&</b>"}]}
    sinks.write_html({"a": df}, str(tmp_path / "r.html"))
    sinks.write_cards(df, str(tmp_path / "c.html"), "n", "t")
    assert "&lt;b&gt;" in (tmp_path / "c.html").read_text() and "</b>" not in (tmp_path / "r.html").read_text()
    assert sinks.text_table(df, {"n": 3, "t": 4}).splitlines()[2] == "1    <b>&"
    with pytest.raises(ValueError):
        sinks.rows_of(spark.range(5), limit=2)


def test_tolerant_and_fallback(spark, tiny):
    df = spark.createDataFrame([(1,)], "a int")
    assert tables.tolerant(df, ["a", "b", "c"], {"b": "UNKNOWN"}).first().asDict() == {"a": 1, "b": "UNKNOWN"}
    assert tables.first_available(spark, tiny, ["absent", "nation"]).count() == 25
    with pytest.raises(FileNotFoundError):
        tables.first_available(spark, tiny, ["absent"])


def test_partition_pruning_reaches_the_scan(spark, tiny):
    df = tables.scan_between(tables.load(spark, tiny, "articles_v3", ["url", "published"]), "published", "2018-01-01 00:00:00", "2018-02-01 00:00:00")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(published" in plan and "title" not in plan


def test_stream_of_articles(spark, tiny, tmp_path):
    source = spark.read.parquet(f"{tiny}/articles_v3.parquet").select("url", "outlet", "ingested_at", "published")
    source.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = ingest.article_stream(spark, str(tmp_path / "in"), source.schema, 1)
    ingest.run_available(stream, str(tmp_path / "cp"), ingest.upsert_to(str(tmp_path / "out"), "url", "ingested_at"))
    assert ingest.latest(spark, str(tmp_path / "out"), "url", "ingested_at").count() == source.select("url").distinct().count()
    counted = ingest.windowed_counts(ingest.article_stream(spark, str(tmp_path / "in"), source.schema), "outlet", "ingested_at", "30 days")
    query = counted.writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.sql("select sum(n) from w").first()[0] == source.count()
    once = ingest.without_copies(ingest.article_stream(spark, str(tmp_path / "in"), source.schema))
    query = once.writeStream.format("memory").queryName("o").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.sql("select count(*) - count(distinct url) from o").first()[0] == 0
