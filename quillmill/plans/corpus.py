"""Queries on tokens, vocabulary growth, gathering and segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmill.functions.clean import clean_wikitext
from quillmill.functions.text import normalised_tokens, pair_key, preserve_case, setting, titled, url_path, url_query
from quillmill.operators import corpus, ingest, segments
from quillmill.plans.common import WS, inline, lower_sql, normal_sql, read, strip_sql, tokens_sql, values_sql

#: Small inputs for what the tables do not have.
RESTORED = [("aşiq", "Asiq"), ("ışıq", "Isiq"), ("iynə", "İyne"), ("söz", "soz"), ("Bakı", "Baki"), ("", "Abc"), ("abc", ""), (None, "Abc")]
WIKI = [
    (1, "{{Başlıq|ad=x}}\n==Qəzəl==\n<poem>\n  Ey '''gül''' [[Bakı|şəhər]] [[Gəncə]]  \n\n İkinci<br/>sətir </poem>"), (2, "[[Şəkil:a.jpg]]mətn[[Kateqoriya:Şeir]][[en:Poem]]<ref name=a>qeyd\nqeyd</ref> son<references/>"),
    (3, "{{a{{b}}c}}\n=== Bir ===\nsətir\n== iki == üç"), (4, ""), (5, None), (6, "[[a|b]c]] [[File:x]y [[az-x:q]] [[ d ]]"),
]
LINKS = [
    ("A", '{"parse":{"links":[{"ns":0,"*":"Bir"},{"ns":14,"*":"Kateqoriya:X"},{"ns":0,"*":"Şəkil:y"},{"ns":0,"*":"İki söz"}]}}'), ("B", '{"parse":{"links":[]}}'), ("C", "{}"), ("D", "no json"), ("E", None),
    ("F", '{"parse":{"links":[{"ns":0,"*":"Author:z"},{"ns":0,"*":"Üç & dörd"}]}}'),
]
RESPONSES = [
    ("A", "Bir söz", '{"parse":{"wikitext":{"*":"[[a|b]]\\n\\n<poem>c</poem>"}}}'), ("A", "X & Y/z", '{"error":{"code":"missing","info":"no page"}}'), ("B", "Q", None), ("B", "R", "{}"),
    ("C", "Ş", '{"parse":{"wikitext":{"*":"{{x}}== h ==\\n  iki  "}}}'),
]
METADATA = [
    (1, "{{x\n| a=1\n| b=2\n}}\npoem\nline"), (2, "| a=1\n}}\npoem"), (3, "{{x\n}}\npoem"), (4, "* a\n* b\n* c\n* d\n* e\n* f\nTitle"), (5, "* a\n* b\n* c\n* d\n* e\nA long heading of more than six words here\n"),
    (6, "poem\r\nline\r\n"), (7, "  \n poem"), (8, "{{x\n| a\nno end"), (9, ""), (10, None), (11, "* a\n* b\n* c\n* d"), (12, "{{x\n| a\n}}\n\n* a\n* b\n* c\n* d\n* e"), (13, "* a\n\n* b\n* c\n* d\n* e\n"), (14, "}}\nx"), (15, "a * b"),
]
VERSES = [
    (1, "Bir... iki! Üç? dörd"), (2, "birinci sətir\nikinci sətir"), (3, "!"), (4, "Stanza bir.\nSon\n\n. .\n \nüç? "), (5, "x" * 120 + "; " + "y" * 120 + "; z"), (6, "a" * 90 + "; " + "b" * 90), (7, ""), (8, None),
    (9, "Salam dünya. Necəsən؟ Yaxşı۔ Son"), (10, "a.b.c. d"),
]
SETTINGS = [(1, "KEY=value"), (2, "  A = 'x y' "), (3, "# no"), (4, ""), (5, "no sign"), (6, 'B="q=r"'), (7, "C="), (8, None)]
TITLES = [("Aşiq oldum",), ("a+b & c/d",), ("x~y*z (1)",), ("50%",), ("a:b@c=$d",)]


def _docs(spark, sf_dir, *columns):
    return read(spark, sf_dir, "documents", *columns)


def _versed(spark, *methods):
    return segments.segmented(inline(spark, VERSES, "doc_id int, text string"), {"verse": "text"}, methods=methods or segments.METHODS)


def _of_docs(spark, sf_dir, *methods):
    return segments.segmented(_docs(spark, sf_dir, "doc_id", "text"), {"original": "text"}, methods=methods or segments.METHODS)


def _measures(spark, sf_dir):
    return segments.measures_of(_docs(spark, sf_dir, "doc_id", "text"), {"original": "text"})


def _method(m):
    def run(spark, sf_dir):
        return _of_docs(spark, sf_dir, m).unionByName(_versed(spark, m)).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text_type", F.array_join("segments", "␞").alias("segments"), F.size("segments").cast("bigint").alias("n"))

    return run


def _cleaned(spark):
    return ingest.clean_column(inline(spark, METADATA, "id int, text string"))


def _split(spark, sf_dir):
    docs = read(spark, sf_dir, "conversations", "role", "text", "conv_id", "turn")
    texts = _docs(spark, sf_dir, "lang", "text", "doc_id").select(F.col("lang").alias("role"), "text", F.col("doc_id").alias("n"))
    return texts, docs.select("role", "text", (F.col("conv_id") * 1000 + F.col("turn")).alias("n")).unionByName(texts)


QUERIES = {
    "token_frequencies": lambda s, d: corpus.token_frequencies(_docs(s, d, "text")),
    "token_top_k": lambda s, d: corpus.ranked_tokens(_docs(s, d, "doc_id", "text"), 20),
    "token_tail": lambda s, d: corpus.ranked_tokens(_docs(s, d, "doc_id", "text"), 10, last=True),
    "token_stats": lambda s, d: corpus.token_stats(_docs(s, d, "text")),
    "type_token_ratio_by_lang": lambda s, d: corpus.token_stats(_docs(s, d, "lang", "text"), ["lang"]),
    "conversation_token_stats": lambda s, d: corpus.token_stats(read(s, d, "conversations", "role", "text"), ["role"]),
    "corpus_profile": lambda s, d: corpus.corpus_profile(_docs(s, d, "source", "text")),
    "vocab_growth": lambda s, d: corpus.vocabulary_growth(_docs(s, d, "doc_id", "text")).select("tokens", "types", F.round("log_tokens", 6).alias("log_tokens"), F.round("log_types", 6).alias("log_types")),
    "heaps_fit": lambda s, d: corpus.fit_heaps(corpus.vocabulary_growth(_docs(s, d, "doc_id", "text"))).select(F.round("k", 6).alias("k"), F.round("beta", 6).alias("beta"), F.round("r2", 6).alias("r2"), "num_points"),
    "heaps_predicted": lambda s, d: (lambda g: corpus.predict_heaps(g, corpus.fit_heaps(g)).withColumn("predicted", F.round("predicted", 3)))(corpus.vocabulary_growth(_docs(s, d, "doc_id", "text"))),
    "normalised_vocab": lambda s, d: corpus.vocabulary(_docs(s, d, "text"), normalised_tokens),
    "normalised_vocab_joined_hyphens": lambda s, d: corpus.vocabulary(_docs(s, d, "text"), lambda c: normalised_tokens(c, False)),
    "frequent_vocab": lambda s, d: corpus.vocabulary(_docs(s, d, "text"), lambda c: normalised_tokens(c, False), least_count=3, least_length=2),
    "preserve_case": lambda s, d: inline(s, RESTORED, "corrected string, original string").select("corrected", "original", preserve_case(F.col("corrected"), F.col("original")).alias("restored")),
    "wikitext_clean": lambda s, d: inline(s, WIKI, "id int, text string").select("id", clean_wikitext(F.col("text")).alias("text")).unionByName(read(s, d, "pages", "page_id", "html").select(F.col("page_id").alias("id"), clean_wikitext(F.col("html")).alias("text"))).select(F.col("id").cast("bigint").alias("id"), "text"),
    "link_titles": lambda s, d: ingest.link_titles(inline(s, LINKS, "author string, body string")),
    "page_texts": lambda s, d: ingest.page_texts(inline(s, RESPONSES, "author string, title string, body string")),
    "token_report_json": lambda s, d: corpus.token_stats(_docs(s, d, "text")).select(F.to_json(F.struct(F.lit("documents").alias("dataset"), F.col("n_rows").alias("rows"), "total_tokens", "unique_types")).alias("report")),
    "poem_quality_filter": lambda s, d: ingest.keep_long(_docs(s, d, "doc_id", "text")).select("doc_id"),
    "template_removed": lambda s, d: _cleaned(s).select("id", "text", "template_removed"),
    "toc_removed": lambda s, d: _cleaned(s).select("id", "text", "toc_removed"),
    "cleaning_report": lambda s, d: ingest.cleaning_report(inline(s, METADATA, "id int, text string")),
    "cleaning_report_documents": lambda s, d: ingest.cleaning_report(_docs(s, d, "text")),
    "merge_dedup": lambda s, d: ingest.merge_new(*_split(s, d), ["role", "text"], "n").groupBy("role", "text").agg(F.count("*").alias("n_rows"), F.min("n").alias("n")),
    "segments_basic": _method("basic"),
    "segments_poetry": _method("poetry_aware"),
    "segments_advanced": _method("advanced"),
    "segment_metrics": lambda s, d: _measures(s, d).unionByName(segments.measured(_versed(s))).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text_type", "method", "num_segments", F.round("avg_length", 6).alias("avg_length"), "median_length", F.round("std_length", 6).alias("std_length"), "min_length", "max_length", "empty_segments", "total_chars"),
    "segmentation_stats": lambda s, d: segments.statistics(_measures(s, d)).withColumns({c: F.round(c, 6) for c in ("avg_segments", "avg_segment_length", "median_segment_length")}),
    "segment_box": lambda s, d: segments.box(_measures(s, d)).withColumns({c: F.round(c, 6) for c in ("least", "q1", "q2", "q3", "most")}),
    "segmentation_examples": lambda s, d: segments.examples(_docs(s, d, "doc_id", "text"), {"original": "text"}).select("doc_id", *(F.array_join(F.col(f"original.{m}"), "␞").alias(m) for m in segments.SEGMENTERS)),
    "settings_lines": lambda s, d: inline(s, SETTINGS, "id int, line string").select("id", setting(F.col("line")).alias("s")).where("s IS NOT NULL").select("id", "s.key", "s.value"),
    "url_forms": lambda s, d: inline(s, TITLES, "title string").select("title", url_query(F.col("title")).alias("as_query"), url_path(F.col("title")).alias("as_path")),
    "display_labels": lambda s, d: segments.measured(_versed(s)).groupBy("text_type", "method").agg(F.sum("num_segments").alias("n")).select(titled(F.concat_ws("_", "text_type", "method")).alias("label"), pair_key(F.col("text_type"), F.col("method")).alias("pair"), F.format_number("n", 0).alias("shown")),
}

TOKENS = tokens_sql("text")
GROWTH = f"""
tokens AS (SELECT doc_id, unnest({TOKENS}) AS token, generate_subscripts({TOKENS}, 1) AS pos FROM documents),
placed AS (SELECT token, row_number() OVER (ORDER BY doc_id, pos) AS place FROM tokens),
firsts AS (SELECT min(place) AS place FROM placed GROUP BY token),
total AS (SELECT count(*) AS n FROM placed),
points AS (SELECT least(b * 1000, n) AS tokens FROM total, range(1, 1000000) t(b) WHERE (b - 1) * 1000 < n),
growth AS (SELECT tokens, (SELECT count(*) FROM firsts WHERE place <= tokens) AS types FROM points)
"""
FIT = "fit AS (SELECT exp(regr_intercept(ln(types), ln(tokens))) AS k, regr_slope(ln(types), ln(tokens)) AS beta, regr_r2(ln(types), ln(tokens)) AS r2, count(*) AS n FROM growth)"
RANKED = f"""
WITH tokens AS (SELECT doc_id, unnest({TOKENS}) AS token, generate_subscripts({TOKENS}, 1) AS pos FROM documents),
counted AS (SELECT token, count(*) AS frequency, min((doc_id, pos)) AS first FROM tokens GROUP BY token)
"""


def _stats_sql(table: str, by: str) -> str:
    group, head = (f"GROUP BY {by}", f"{by}, ") if by else ("", "")
    return f"""
    WITH t AS (SELECT {head}{TOKENS} AS tokens FROM {table})
    SELECT {head}count(*) AS n_rows, sum(len(tokens))::BIGINT AS total_tokens, len(list_distinct(flatten(list(tokens)))) AS unique_types,
           len(list_distinct(flatten(list(tokens)))) / sum(len(tokens)) AS type_token_ratio
    FROM t {group}"""


def _vocab_sql(hyphen: str, having: str = "") -> str:
    return f"SELECT word, count(*) AS freq FROM (SELECT unnest({normal_sql('text', hyphen)}) AS word FROM documents) GROUP BY word {having}"


BOUNDARY = rf"[.!?؟۔](?:{WS}+|\z)"


def _trimmed_sql(parts: str) -> str:
    return f"list_filter(list_transform({parts}, lambda x: {strip_sql('x')}), lambda x: x <> '')"


def _basic_sql(text: str) -> str:
    return _trimmed_sql(f"string_split_regex({strip_sql(text)}, '{BOUNDARY}')")


SEGMENTS = f"""
texts AS (
  SELECT doc_id, 'original' AS text_type, coalesce(text, '') AS text FROM documents
  UNION ALL SELECT doc_id, 'verse', coalesce(text, '') FROM {values_sql(VERSES, "doc_id", "text")}),
poetry AS (
  SELECT doc_id, text_type, text, flatten(list_transform(string_split_regex({strip_sql("text")}, '\\n{WS}*\\n'), lambda s:
         CASE WHEN len({_basic_sql("s")}) > 0 THEN {_basic_sql("s")} ELSE {_trimmed_sql("string_split(s, chr(10))")} END)) AS segments FROM texts),
segs AS (
  SELECT doc_id, text_type, 'basic' AS method, {_basic_sql("text")} AS segments FROM texts
  UNION ALL SELECT doc_id, text_type, 'poetry_aware', segments FROM poetry
  UNION ALL SELECT doc_id, text_type, 'advanced', flatten(list_transform(segments, lambda s:
         CASE WHEN length(s) > 200 AND len(string_split_regex(s, '[;،]{WS}+')) > 1 THEN {_trimmed_sql(f"string_split_regex(s, '[;،]{WS}+')")} ELSE [s] END)) FROM poetry)
"""
MEASURES = """
sized AS (SELECT doc_id, text_type, method, list_transform(list_filter(segments, lambda s: s <> ''), lambda s: length(s)) AS l, len(segments) AS num_segments FROM segs),
measures AS (
  SELECT doc_id, text_type, method, num_segments, coalesce(list_avg(l), 0) AS avg_length, coalesce(list_median(l), 0) AS median_length,
         CASE WHEN len(l) > 1 THEN list_stddev_pop(l) ELSE 0 END AS std_length, coalesce(list_min(l), 0) AS min_length, coalesce(list_max(l), 0) AS max_length,
         num_segments - len(l) AS empty_segments, coalesce(list_sum(l), 0)::BIGINT AS total_chars
  FROM sized)
"""


def _segments_sql(method: str) -> str:
    return f"WITH {SEGMENTS} SELECT doc_id, text_type, array_to_string(segments, chr(9246)) AS segments, len(segments) AS n FROM segs WHERE method = '{method}'"


def _lines_sql(text: str) -> str:
    ends = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
    return f"string_split_regex(regexp_replace({text}, '(?:{ends})\\z', ''), '{ends}')"


def _cleaned_sql(source: str) -> str:
    bullet = f"regexp_matches(x, '\\A{WS}*\\*')"
    return f"""
started AS (SELECT id, regexp_replace(regexp_replace(coalesce(text, ''), '\\r\\n|\\r', chr(10), 'g'), '\\A{WS}+', '') AS a, coalesce(text, '') AS before FROM {source}),
lined AS (SELECT *, {_lines_sql("a")} AS ls FROM started),
opened AS (SELECT *, CASE WHEN regexp_matches(ls[1], '\\A{WS}*\\{{\\{{') THEN 1 ELSE 0 END AS i0 FROM lined),
counted AS (SELECT *, coalesce(list_position(list_transform(ls[i0 + 1:], lambda x: regexp_matches(x, '\\A{WS}*\\|')), false) - 1, len(ls) - i0) AS m FROM opened),
closed AS (SELECT *, a <> '' AND (m > 0 OR i0 > 0) AND coalesce(regexp_matches(ls[i0 + m + 1], '\\A{WS}*\\}}\\}}'), false) AS template_removed FROM counted),
bodies AS (SELECT id, before, template_removed, regexp_replace(CASE WHEN template_removed THEN coalesce(array_to_string(ls[i0 + m + 2:], chr(10)), '') ELSE a END, '\\A\\n+', '') AS b FROM closed),
filled AS (SELECT *, list_filter({_lines_sql("b")}, lambda x: {strip_sql("x")} <> '') AS f FROM bodies),
split AS (SELECT *, list_filter(f, lambda x: NOT {bullet}) AS other FROM filled),
judged AS (
  SELECT *, len(f) >= 5 AND len(f) - len(other) >= 5 AND (len(f) - len(other)) / len(f) >= 0.6 AS toc_removed,
         len(list_filter(other, lambda x: length({strip_sql("x")}) > 40)) = 0 AND coalesce(list_sum(list_transform(other, lambda x: len({tokens_sql("x")}))), 0) <= 6 AS headings FROM split),
cleaned AS (
  SELECT id, before, template_removed, toc_removed, CASE WHEN NOT toc_removed THEN b WHEN headings THEN '' ELSE regexp_replace(coalesce(array_to_string(other, chr(10)), ''), '\\A\\n+|\\n+\\z', '', 'g') END AS text FROM judged)
"""


REPORT = f"SELECT count(*) AS n_rows, count_if(before <> text) AS changed_rows, count_if(template_removed) AS template_removed_rows, count_if(toc_removed) AS toc_removed_rows, count_if({strip_sql('text')} = '') AS empty_after_cleaning FROM cleaned"


def _wiki_sql(text: str) -> str:
    from quillmill.functions.clean import WIKI_STEPS

    out = f"coalesce({text}, '')"
    for pattern, by in WIKI_STEPS:
        by = by.replace("$1", "\\1")
        out = f"regexp_replace({out}, '{pattern.removeprefix('(?d)')}', {'chr(10)' if by == chr(10) else repr(by)}, 'g')".replace("'\\\\1'", "'\\1'")
    return f"coalesce(array_to_string({_trimmed_sql(f'string_split({out}, chr(10))')}, chr(10)), '')"


ORACLE_SQL = {
    "token_frequencies": f"SELECT token, count(*) AS frequency FROM (SELECT unnest({TOKENS}) AS token FROM documents) GROUP BY token",
    "token_top_k": f"{RANKED} SELECT row_number() OVER (ORDER BY frequency DESC, first) AS rank, token, frequency FROM counted QUALIFY rank <= 20",
    "token_tail": f"{RANKED} SELECT row_number() OVER (ORDER BY frequency, first DESC) AS rank, token, frequency FROM counted QUALIFY rank <= 10",
    "token_stats": _stats_sql("documents", ""),
    "type_token_ratio_by_lang": _stats_sql("documents", "lang"),
    "conversation_token_stats": _stats_sql("conversations", "role"),
    "corpus_profile": f"SELECT count(*) AS n_rows, count(DISTINCT source) AS n_groups, sum(length(text))::BIGINT AS n_chars, count_if({strip_sql("coalesce(text, '')")} <> '') AS n_filled, max(length(text)) AS longest FROM documents",
    "vocab_growth": f"WITH {GROWTH} SELECT tokens, types, round(ln(tokens), 6) AS log_tokens, round(ln(types), 6) AS log_types FROM growth",
    "heaps_fit": f"WITH {GROWTH}, {FIT} SELECT round(k, 6) AS k, round(beta, 6) AS beta, round(r2, 6) AS r2, n AS num_points FROM fit",
    "heaps_predicted": f"WITH {GROWTH}, {FIT} SELECT tokens, types, round(k * pow(tokens, beta), 3) AS predicted FROM growth, fit",
    "normalised_vocab": _vocab_sql("-"),
    "normalised_vocab_joined_hyphens": _vocab_sql(""),
    "frequent_vocab": _vocab_sql("", "HAVING count(*) >= 3 AND length(word) >= 2"),
    "preserve_case": f"""
        SELECT corrected, original, CASE WHEN regexp_matches(original, '^\\p{{Lu}}') AND regexp_matches(corrected, '^\\p{{Ll}}')
               THEN (CASE substr(corrected, 1, 1) WHEN 'ı' THEN 'I' WHEN 'i' THEN 'İ' ELSE upper(substr(corrected, 1, 1)) END) || substr(corrected, 2) ELSE corrected END AS restored
        FROM {values_sql(RESTORED, "corrected", "original")}""",
    "wikitext_clean": f"SELECT id::BIGINT AS id, {_wiki_sql('text')} AS text FROM {values_sql(WIKI, 'id', 'text')} UNION ALL SELECT page_id, {_wiki_sql('html')} FROM pages",
    "link_titles": f"""
        WITH r AS (SELECT author, CASE WHEN json_valid(body) THEN body::JSON END AS j FROM {values_sql(LINKS, "author", "body")}),
        l AS (SELECT author, unnest(from_json(j->'$.parse.links', '["JSON"]')) AS link FROM r)
        SELECT author, json_extract_string(link, '/*') AS title FROM l WHERE (link->>'$.ns')::INT = 0 AND NOT starts_with(title, 'Kateqoriya:') AND NOT starts_with(title, 'Şəkil:') AND NOT starts_with(title, 'Author:')""",
    "page_texts": f"""
        WITH r AS (SELECT author, title, body::JSON AS j FROM {values_sql(RESPONSES, "author", "title", "body")}),
        p AS (SELECT *, json_extract_string(j, '/error/code') AS code, json_extract_string(j, '/error/info') AS info, json_extract_string(j, '/parse/wikitext/*') AS w FROM r)
        SELECT author, title, 'https://example.org/wiki/' || replace(url_encode(title), '%26', '&') AS url, CASE WHEN code IS NULL AND w IS NOT NULL THEN {_wiki_sql("w")} END AS text,
               CASE WHEN code IS NOT NULL THEN code || ': ' || info WHEN w IS NULL THEN 'no text' END AS error FROM p""",
    "token_report_json": f"""
        WITH t AS ({_stats_sql("documents", "")}) SELECT '{{"dataset":"documents","rows":' || n_rows || ',"total_tokens":' || total_tokens || ',"unique_types":' || unique_types || '}}' AS report FROM t""",
    "poem_quality_filter": "SELECT doc_id FROM documents WHERE strlen(text) >= 300 AND length(text) - length(replace(text, chr(10), '')) >= 10",
    "template_removed": f"WITH {_cleaned_sql(values_sql(METADATA, 'id', 'text'))} SELECT id, text, template_removed FROM cleaned",
    "toc_removed": f"WITH {_cleaned_sql(values_sql(METADATA, 'id', 'text'))} SELECT id, text, toc_removed FROM cleaned",
    "cleaning_report": f"WITH {_cleaned_sql(values_sql(METADATA, 'id', 'text'))} {REPORT}",
    "cleaning_report_documents": f"WITH {_cleaned_sql('(SELECT doc_id AS id, text FROM documents)')} {REPORT}",
    "merge_dedup": """
        WITH old AS (SELECT lang AS role, text, doc_id AS n FROM documents),
        new AS (SELECT role, text, conv_id * 1000 + turn AS n FROM conversations UNION ALL SELECT * FROM old),
        fresh AS (SELECT role, text, min(n) AS n FROM new WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.role = new.role AND old.text = new.text) GROUP BY role, text)
        SELECT role, text, count(*) AS n_rows, min(n) AS n FROM (SELECT * FROM old UNION ALL SELECT * FROM fresh) GROUP BY role, text""",
    "segments_basic": _segments_sql("basic"),
    "segments_poetry": _segments_sql("poetry_aware"),
    "segments_advanced": _segments_sql("advanced"),
    "segment_metrics": f"WITH {SEGMENTS}, {MEASURES} SELECT doc_id, text_type, method, num_segments, round(avg_length, 6) AS avg_length, median_length, round(std_length, 6) AS std_length, min_length, max_length, empty_segments, total_chars FROM measures",
    "segmentation_stats": f"""
        WITH {SEGMENTS}, {MEASURES} SELECT text_type, method, count(*) AS total_texts, sum(num_segments)::BIGINT AS total_segments, sum(total_chars)::BIGINT AS total_chars, round(avg(num_segments), 6) AS avg_segments,
               round(avg(avg_length) FILTER (avg_length > 0), 6) AS avg_segment_length, round(median(median_length) FILTER (median_length > 0), 6) AS median_segment_length, sum(empty_segments)::BIGINT AS empty_segments_total
        FROM measures WHERE text_type = 'original' GROUP BY text_type, method""",
    "segment_box": f"""
        WITH {SEGMENTS}, {MEASURES}, spread AS (SELECT text_type, method, unnest(list_resize([avg_length], num_segments, avg_length)) AS v FROM measures WHERE num_segments > 0 AND text_type = 'original')
        SELECT text_type, method, round(min(v), 6) AS least, round(quantile_cont(v, 0.25), 6) AS q1, round(quantile_cont(v, 0.5), 6) AS q2, round(quantile_cont(v, 0.75), 6) AS q3, round(max(v), 6) AS most FROM spread GROUP BY text_type, method""",
    "segmentation_examples": f"""
        WITH {SEGMENTS} SELECT doc_id, max(array_to_string(segments, chr(9246))) FILTER (method = 'basic') AS basic, max(array_to_string(segments, chr(9246))) FILTER (method = 'poetry_aware') AS poetry_aware,
               max(array_to_string(segments, chr(9246))) FILTER (method = 'advanced') AS advanced
        FROM segs WHERE text_type = 'original' AND doc_id IN (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 3) GROUP BY doc_id""",
    "settings_lines": f"""
        SELECT id, {strip_sql("string_split(line, '=')[1]")} AS key, regexp_replace({strip_sql("substr(line, instr(line, '=') + 1)")}, '\\A["'']+|["'']+\\z', '', 'g') AS value
        FROM {values_sql(SETTINGS, "id", "line")} WHERE instr(line, '=') > 0 AND NOT starts_with({strip_sql("line")}, '#')""",
    "url_forms": f"""
        SELECT title, replace(url_encode(title), '%20', '+') AS as_query,
               replace(replace(replace(replace(replace(replace(url_encode(title), '%24', '$'), '%26', '&'), '%2B', '+'), '%3D', '='), '%3A', ':'), '%40', '@') AS as_path
        FROM {values_sql(TITLES, "title")}""",
    "display_labels": f"""
        WITH {SEGMENTS} SELECT 'Verse ' || CASE method WHEN 'basic' THEN 'Basic' WHEN 'advanced' THEN 'Advanced' ELSE 'Poetry Aware' END AS label, text_type || '->' || method AS pair, sum(len(segments))::BIGINT::VARCHAR AS shown
        FROM segs WHERE text_type = 'verse' GROUP BY text_type, method""",
}
