import json
import shutil

import pytest
from pyspark.sql import functions as F

from quillmill import jobs
from quillmill.operators import bpe, spell
from quillmill.sources import files, wiki
from quillmill.streaming import enrich, merge


def test_tables_and_reports(spark, tmp_path):
    df = spark.createDataFrame([("a", "t", "u", "x")], files.TEXTS)
    files.write_table(df, f"{tmp_path}/t")
    assert files.read_table(spark, f"{tmp_path}/t", files.TEXTS).collect() == df.collect()
    assert files.read_table(spark, f"{tmp_path}/none", files.TEXTS).count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.read_table(spark, f"{tmp_path}/none")
    files.write_report(df, f"{tmp_path}/r")
    assert files.read_json(spark, f"{tmp_path}/r").select("author").first()[0] == "a"
    points = spark.createDataFrame([(2, 2, 0.5, 0.5), (1, 1, 0.0, 0.0)], files.GROWTH_POINTS)
    files.write_csv(points, f"{tmp_path}/c", "tokens")
    assert files.read_csv(spark, f"{tmp_path}/c", files.GROWTH_POINTS).orderBy("tokens").collect() == points.orderBy("tokens").collect()
    files.write_lines(bpe.merge_lines(bpe.merge_table(spark, [("a", "b"), ("ab", "c")])), f"{tmp_path}/m")
    assert [r.value for r in spark.read.text(f"{tmp_path}/m").collect()] == ["#version: 0.2", "a b", "ab c"]
    assert files.report_line(points.orderBy("tokens"), "%d of %d", "types", "tokens").first().value == "1 of 1"


def test_swap_keeps_a_backup(spark, tmp_path):
    for n in (1, 2):
        files.write_table(spark.range(n), f"{tmp_path}/{n}")
    files.swap(spark, f"{tmp_path}/2", f"{tmp_path}/1", f"{tmp_path}/old")
    assert spark.read.parquet(f"{tmp_path}/1").count() == 2 and spark.read.parquet(f"{tmp_path}/old").count() == 1


def test_a_swap_that_is_cut_short_loses_nothing(spark, tmp_path):
    for n in (1, 2):
        files.write_table(spark.range(n), f"{tmp_path}/{n}")
    table = f"{tmp_path}/1"
    with pytest.raises(OSError, match="cannot move"):
        files.swap(spark, f"{tmp_path}/none", table)
    assert spark.read.parquet(table).count() == 1
    (tmp_path / "1").rename(tmp_path / f"1{files.ASIDE}")  # as if it had been stopped between two moves
    assert files.restore(spark, table) and not files.restore(spark, table) and spark.read.parquet(table).count() == 1
    (tmp_path / "1").rename(tmp_path / f"1{files.ASIDE}")
    files.swap(spark, f"{tmp_path}/2", table)
    assert spark.read.parquet(table).count() == 2 and not (tmp_path / f"1{files.ASIDE}").exists()


def test_a_table_that_cannot_be_read_is_set_aside(spark, tmp_path):
    path, schema = f"{tmp_path}/t", "id long"
    assert files.read_or_set_aside(spark, path, schema).count() == 0
    files.write_table(spark.range(3), path)
    assert files.read_or_set_aside(spark, path, schema).count() == 3
    for n in (1, 2):
        shutil.rmtree(path, ignore_errors=True)
        (tmp_path / "t").mkdir()
        (tmp_path / "t" / "part-0.parquet").write_bytes(b"no table" * n)
        assert files.read_or_set_aside(spark, path, schema).count() == 0
        assert not (tmp_path / "t").exists() and (tmp_path / f"t{files.BACKUP}" / "part-0.parquet").read_bytes() == b"no table" * n


def test_columns_are_asked_for_before_any_work(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, Text string")
    assert files.missing_columns(df, ["text", "doc_id", "other"]) == ["other"]
    assert files.require_columns(df, ["text"]) is df
    with pytest.raises(ValueError, match="poems lacks other, more"):
        files.require_columns(df, ["other", "doc_id", "more"], "poems")


def test_jobs_write_what_they_name(spark, data, tmp_path):
    table = f"{tmp_path}/docs"
    spark.read.parquet(f"{data}/documents.parquet").where("doc_id < 60").select("doc_id", F.col("text").alias("body")).write.parquet(table)
    run = lambda *args: jobs.main([*args, "--input", table, "--out-dir", f"{tmp_path}/out", "--text-col", "body"], spark)
    run("heaps", "--step", "100")
    points = spark.read.parquet(f"{tmp_path}/out/heaps_points")
    fit = files.read_json(spark, f"{tmp_path}/out/heaps_fit").first()
    assert points.count() == fit.num_points > 3 and 0 < fit.beta < 1.2
    run("tokens")
    run("clean")
    run("segments")
    assert files.read_json(spark, f"{tmp_path}/out/token_stats").first().n_rows == files.read_json(spark, f"{tmp_path}/out/cleaning_report").first().n_rows == 60
    run("bpe", "--vocab-size", "120")
    merges = [r.value for r in spark.read.text(f"{tmp_path}/out/bpe_merges").collect()]
    assert merges[0] == "#version: 0.2" and len(merges) == files.read_json(spark, f"{tmp_path}/out/bpe_stats").first().num_merges + 1
    (tmp_path / "tests.json").write_text('[{"input": "zzzzzzzzzzzzzz", "expected": "a", "type": "x"}]')
    run("spelling", "--tests", f"{tmp_path}/tests.json")
    assert spark.read.parquet(f"{tmp_path}/out/spelling_results").first().tier == "none"
    with pytest.raises(ValueError, match="lacks other"):
        jobs.main(["tokens", "--input", table, "--out-dir", "x", "--text-col", "other"], spark)
    with pytest.raises(SystemExit):
        run("nothing")


def test_requests_get_answers_or_errors(spark):
    vocab = spark.createDataFrame([("kitab", 4), ("kital", 7), ("kitabça", 1), ("ev", 9)], "word string, freq long")
    bodies = ['{"word": " Kitab "}', '{"word": "xital", "max_distance": 1}', '{"word": "xxtal", "max_distance": 1}', '{"word": ""}', "{}", "no", None, '{"word": "ev", "max_distance": -1}', '{"word": "xxtal"}', '{"word": "qqqqqqqqq", "max_distance": 0}']
    got = {r.id: (r.code, json.loads(r.answer)) for r in spell.answer(spark.createDataFrame(list(enumerate(bodies)), "id int, body string"), vocab).collect()}
    assert [got[i][0] for i in range(10)] == [200, 200, 200, 400, 400, 400, 400, 400, 200, 200]
    assert got[0][1] == {"input_word": "Kitab", "exists_in_vocab": True, "word_frequency": 4, "correction": "Kitab", "distance": 0.0, "alternatives": [], "max_distance_used": 3}
    assert (got[1][1]["correction"], got[1][1]["distance"], got[1][1]["alternatives"]) == ("kital", 1.0, [])
    assert got[2][1]["correction"] is None and got[2][1]["alternatives"] == [{"word": "kital", "distance": 2.0, "frequency": 7}]
    assert got[3][1] == got[4][1] == {"error": "No word provided"} and got[5][1] == got[6][1] == got[7][1] == {"error": "Invalid request"}
    assert (got[8][1]["correction"], got[8][1]["max_distance_used"]) == ("kital", 3)
    assert got[9][1]["correction"] is None and got[9][1]["alternatives"] == []


def test_settings_and_tests(spark, tmp_path):
    (tmp_path / "env").write_text("A = 'x'\n# no\n\nB=\"y=z\"\nno\nC=1\n")
    assert files.read_settings(spark, str(tmp_path / "env"), {"C": "2"}) == {"A": "x", "B": "y=z", "C": "2"}
    (tmp_path / "t.json").write_text('[{"input": "Asiq", "expected": "Aşiq", "type": "anglicization"}, {"input": "a", "expected": "b"}]')
    assert [r.type for r in files.read_tests(spark, str(tmp_path / "t.json")).collect()] == ["anglicization", "unknown"]


def test_fetch_tries_again_and_keeps_errors_apart(spark):
    def transport(url):
        if url == "bad":
            raise OSError("down")
        return (429, "") if url == "busy" else (404, "") if url == "gone" else (200, f"<{url}>")

    urls = spark.createDataFrame([("ok",), ("bad",), ("busy",), ("gone",)], "url string")
    got = {r.url: (r.body, r.error) for r in wiki.fetch(urls, transport, wait=0, slow_down=0).collect()}
    assert got == {"ok": ("<ok>", None), "bad": (None, "OSError: down"), "busy": (None, "status 429"), "gone": (None, "status 404")}


def test_enrichment_resumes_and_sets_errors_aside(spark, tmp_path):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "boom", "", None, "b", "c"])], "doc_id long, text string")

    def broken(t):
        if t in ("boom", "c"):
            raise ValueError(t)
        return t * 2

    enrich.run(docs, str(tmp_path), broken, "doc_id", "text", every=2, tries=2, wait=0)
    done = spark.read.parquet(f"{tmp_path}/values")
    assert {r.doc_id: r.value for r in done.collect()} == {0: "aa", 2: "", 3: "", 4: "bb"}
    assert sorted(r.doc_id for r in spark.read.json(f"{tmp_path}/errors").collect()) == [1, 5]
    assert sorted(r.doc_id for r in enrich.pending(docs, done, "doc_id").collect()) == [1, 2, 3, 5]
    enrich.run(docs, str(tmp_path), lambda t: t.upper(), "doc_id", "text", tries=1, wait=0)
    got = {r.doc_id: r.modern_text for r in enrich.enriched(docs, spark.read.parquet(f"{tmp_path}/values"), "doc_id").collect()}
    assert got == {0: "aa", 1: "BOOM", 2: "", 3: "", 4: "bb", 5: "C"}


def test_enrichment_takes_ids_of_any_kind_and_spread(spark, tmp_path):
    docs = spark.createDataFrame([(f"k{i}" if i else "z" * 300, "x") for i in range(7)], "name string, text string")
    enrich.run(docs, str(tmp_path / "a"), lambda t: t * 2, "name", "text", every=2)
    assert spark.read.parquet(f"{tmp_path}/a/values").where("value = 'xx'").count() == 7
    far = spark.createDataFrame([(1, "x"), (10**15, "y")], "doc_id long, text string")
    enrich.run(far, str(tmp_path / "b"), lambda t: t * 2, "doc_id", "text", every=1)
    assert sorted(r.value for r in spark.read.parquet(f"{tmp_path}/b/values").collect()) == ["xx", "yy"]
    enrich.run(far, str(tmp_path / "b"), lambda t: 1 / 0, "doc_id", "text", tries=1)  # nothing is left to do
    assert spark.read.parquet(f"{tmp_path}/b/values").count() == 2


def test_results_must_match_their_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    done = lambda *ids: spark.createDataFrame([(i, "v") for i in ids], "doc_id long, value string")
    assert sorted(tuple(r) for r in enrich.align(docs, done(2, 1), "doc_id").collect()) == [(1, "a", "v"), (2, "b", "v")]
    for ids, said in (((1,), "1 keys without a result"), ((1, 2, 3), "1 results without a row"), ((1, 2, 2), "1 repeated keys")):
        with pytest.raises(ValueError, match=said):
            enrich.align(docs, done(*ids), "doc_id")
    assert enrich.row_at(docs, "doc_id", 1).first().text == "b" and enrich.row_at(docs, "doc_id", 2).first() is None


def test_limits_of_a_resumed_run(spark):
    docs = spark.range(10).withColumnRenamed("id", "doc_id")
    done = spark.createDataFrame([(4, "x"), (5, " ")], "doc_id long, value string")
    assert [r.doc_id for r in enrich.pending(docs, done, "doc_id", start=3, limit=3).collect()] == [3, 5, 6]


def test_stream_merges_without_duplicates(spark, tmp_path):
    schema = "author string, title string, n long"
    for k, rows in enumerate([[("a", "t", 2), ("a", "t", 1)], [("a", "t", 3), ("b", "t", 4), (None, "x", 5)], [(None, "x", 6), ("c", "t", 7)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        merge.merge_stream(spark, source, f"{tmp_path}/table", schema, ["author", "title"], "n", f"{tmp_path}/state").awaitTermination()
    assert sorted(r.n for r in spark.read.parquet(f"{tmp_path}/table").select(F.col("n")).collect()) == [1, 4, 5, 7]


def test_a_model_gets_few_rows_at_once(spark):
    """Texts of a batch are held several times, so batches are bounded."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    docs = spark.range(5).select(F.col("id").alias("doc_id"), F.lit("a").alias("text"))
    assert enrich.enrich(docs, str.upper, "doc_id", "text").count() == 5
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
