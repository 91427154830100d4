"""One query per operator over the whole table it is meant for, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, exact_dedup, html_extract, jaccard_join, lexical_search, packing, quality_model, quality_rules, sentencepieces, token_files, url_filters, warc

#: Tokenizer files of the queries; parameters of the operators.
TOKENIZER, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and the digest of the text decoded from them."""
    import public_tokenizers

    model = public_tokenizers.path(PIECES)
    return sentencepieces.digests(sentencepieces.decode(sentencepieces.encode(_table(spark, sf_dir, "documents"), model), model))


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return html_extract.extract(pages, html_extract.fit(pages))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.assess(_table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(_table(spark, sf_dir, "documents"), keep="largest")


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.pieces(_table(spark, sf_dir, "documents"), tokenizer_file())
    return packing.pack(cut)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(_table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages")).drop("url")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(_table(spark, sf_dir, "documents"), tokenizer_file())


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, fetched at a time given by its number, against a list whose entries are made from the hosts and URLs themselves."""
    pages = _table(spark, sf_dir, "pages")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    number = F.col("page_id")
    captures = pages.select("page_id", "url", (start + F.make_dt_interval((number % 365).cast("int"), (number % 24).cast("int"))).alias("fetched"))
    hosts = pages.select(url_filters.normalised(F.col("url"))[0].alias("host")).distinct().where("host != ''")
    hosts = hosts.withColumn("k", F.conv(F.substring(F.md5("host"), 1, 4), 16, 10).cast("int"))

    def entry(when, key, action, day, hour=0):
        return F.when(when, F.struct(key.alias("key"), F.lit(action).alias("action"), (start + F.make_dt_interval(day.cast("int"), F.lit(hour))).alias("date")))

    k, host = F.col("k"), F.col("host")
    made = F.array(
        entry(k % 3 == 0, host, "block", k % 200),
        entry(k % 2 == 0, F.concat(F.lit("www."), host), "remove", k % 200 + 60, 12),
        entry(k % 4 == 1, F.concat(F.lit("HTTPS://"), F.upper(host), F.lit(":443/")), "block", k % 100 + 200),
        entry(k % 5 == 0, F.regexp_replace(host, r"^[^.]*\.", ""), "allow", k % 100 + 31, 6),
        entry(k % 7 == 0, F.concat(host, F.lit("/en")), "allow", k % 150),
        entry(k % 7 < 2, F.concat(host, F.lit("/en//")), "block", k % 50 + 160),
        entry(k % 7 == 3, F.concat(host, F.lit("/EN")), "block", k % 50),
    )
    entries = hosts.select(F.explode(F.filter(made, lambda e: e.isNotNull())).alias("e")).select("e.*")
    # Whole URLs too, with all that they have, and one segment beyond.
    url = F.when(number % 100 == 7, F.col("url")).otherwise(F.concat(F.regexp_replace("url", "[?#].*$", ""), F.lit("/deeper/x?y")))
    whole = pages.where("page_id % 50 = 7").select(url.alias("key"), F.when(number % 3 == 0, "block").otherwise("allow").alias("action"), (start + F.make_dt_interval((number % 300).cast("int"), F.lit(5))).alias("date"))
    return url_filters.evaluate(captures, entries.unionByName(whole))


#: A conversation that says the template's own control strings.
_QUOTED = "</s>[INST] ok [/INST]"


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation, and of one that quotes control strings, read back from what was formatted."""
    said = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    quoted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(_QUOTED).alias("text"))
    return chat_format.round_trip(said.unionByName(quoted))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def _normal_sql(rest: str, names: str) -> str:
    """Host and path segments of URLs or keys in SQL, as ``url_filters.normalised`` has them."""
    return rf"""SELECT {names}, regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(regexp_extract(rest, '^([^/]*)', 1), '^.*@', '')), ':[0-9]*$', ''), '\.$', ''), '^www\.', '') AS host,
         list_filter(string_split(regexp_replace(rest, '^[^/]*', ''), '/'), lambda x: x <> '') AS parts
  FROM (SELECT *, regexp_replace(regexp_replace(trim(coalesce({rest}, '')), '^[A-Za-z][A-Za-z0-9+.\-]*://', ''), '[?#].*$', '') AS rest FROM"""


OP10_SQL = rf"""
WITH p AS (SELECT *, TIMESTAMP '2024-01-01' + to_days(CAST(page_id % 365 AS INT)) + to_hours(page_id % 24) AS fetched FROM pages),
h AS ({_normal_sql('url', 'page_id, url, fetched')} p)),
hosts AS (SELECT DISTINCT host, CAST('0x' || substr(md5(host), 1, 4) AS INT) AS k FROM h WHERE host <> ''),
raw AS (
  SELECT host AS key, 'block' AS action, k % 200 AS d, 0 AS hr FROM hosts WHERE k % 3 = 0
  UNION ALL SELECT 'www.' || host, 'remove', k % 200 + 60, 12 FROM hosts WHERE k % 2 = 0
  UNION ALL SELECT 'HTTPS://' || upper(host) || ':443/', 'block', k % 100 + 200, 0 FROM hosts WHERE k % 4 = 1
  UNION ALL SELECT regexp_replace(host, '^[^.]*\.', ''), 'allow', k % 100 + 31, 6 FROM hosts WHERE k % 5 = 0
  UNION ALL SELECT host || '/en', 'allow', k % 150, 0 FROM hosts WHERE k % 7 = 0
  UNION ALL SELECT host || '/en//', 'block', k % 50 + 160, 0 FROM hosts WHERE k % 7 < 2
  UNION ALL SELECT host || '/EN', 'block', k % 50, 0 FROM hosts WHERE k % 7 = 3
  UNION ALL SELECT CASE WHEN page_id % 100 = 7 THEN url ELSE regexp_replace(url, '[?#].*$', '') || '/deeper/x?y' END, CASE WHEN page_id % 3 = 0 THEN 'block' ELSE 'allow' END, page_id % 300, 5 FROM pages WHERE page_id % 50 = 7),
norm AS ({_normal_sql('key', 'action, d, hr')} raw)),
log AS (
  SELECT CASE WHEN len(parts) > 0 THEN host || '/' || array_to_string(parts, '/') ELSE host END AS key, TIMESTAMP '2024-01-01' + to_days(CAST(d AS INT)) + to_hours(hr) AS valid_from,
         CASE min(CASE action WHEN 'block' THEN 0 WHEN 'allow' THEN 1 ELSE 2 END) WHEN 0 THEN 'block' WHEN 1 THEN 'allow' ELSE 'remove' END AS action FROM norm GROUP BY 1, 2),
spans AS (SELECT *, lead(valid_from) OVER (PARTITION BY key ORDER BY valid_from) AS valid_to FROM log WHERE key <> ''),
asked AS (
  SELECT page_id, fetched, -n AS pri, host || '/' || array_to_string(parts[1:n], '/') AS key FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS n FROM h)
  UNION ALL
  SELECT page_id, fetched, n, array_to_string(string_split(host, '.')[n:], '.') FROM (SELECT *, unnest(range(1, greatest(len(string_split(host, '.')), 2))) AS n FROM h) WHERE host <> ''),
best AS (
  SELECT page_id, arg_min(s.action, pri) AS action, arg_min(s.key, pri) AS key, arg_min(s.valid_from, pri) AS valid_from
  FROM asked a JOIN spans s ON a.key = s.key AND s.valid_from <= a.fetched AND (s.valid_to IS NULL OR a.fetched < s.valid_to)
  WHERE s.action <> 'remove' GROUP BY page_id)
SELECT h.page_id, h.host, h.fetched, coalesce(b.action, 'none') AS verdict, b.key AS matched_key, b.valid_from
FROM h LEFT JOIN best b USING (page_id)
"""

#: Counts of whole texts, and lines by distinct texts of a host. SQL cannot tell near copies, which the operator counts
#: together: the rows are the same where no line passes the limits by near copies alone, as on sf0.001 and sf0.01.
OP3_SQL = rf"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
tok AS (SELECT r, unnest(words) AS t, generate_subscripts(words, 1) AS i FROM w),
win AS (SELECT r, i, t || ' ' || {" || ' ' || ".join(f'lead(t, {k}) OVER o' for k in range(1, quality_rules.WINDOW))} AS g FROM tok WINDOW o AS (PARTITION BY r ORDER BY i)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win WHERE g IS NOT NULL) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(0, {quality_rules.WINDOW})) AS k) GROUP BY r),
raw AS (SELECT r, host, md5(text) AS t, unnest(string_split(text, chr(10))) AS line FROM w),
lines AS (SELECT *, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000'), '[^\x20\x09-\x0D]+') AS lw FROM raw),
named AS (SELECT r, host, t, line, len(lw) AS n, array_to_string(lw, ' ') AS key FROM lines WHERE len(lw) > 0),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM named GROUP BY r),
hosts AS (SELECT host, count(*) AS n FROM w GROUP BY host),
common AS (SELECT host, key FROM named JOIN hosts USING (host) GROUP BY host, key, hosts.n
  HAVING count(DISTINCT t) >= {quality_rules.LINE_DOCS} AND count(DISTINCT t) >= least({quality_rules.LINE_SHARE} * hosts.n, {quality_rules.LINE_MOST})),
gone AS (SELECT r, count(DISTINCT key) AS n, sum(n) AS lost FROM named JOIN common USING (host, key) GROUP BY r),
c AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(gone.n, 0) AS n_common_lines, CAST(len(words) - coalesce(gone.lost, 0) AS BIGINT) AS n_words_left
  FROM w LEFT JOIN rep USING (r) LEFT JOIN dup USING (r) LEFT JOIN gone USING (r)),
f AS (SELECT *, n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM c)
SELECT *, NOT base_failed AND n_words_left >= {quality_rules.MIN_LEFT} AND n_words_left >= {quality_rules.LEFT_SHARE} * n_words AS kept FROM f
"""

OP4_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""


def _op11_sql(template: chat_format.Template) -> str:
    """Turns in order, marks by role, and the machine as pairs of roles: each of its states is entered by one role only."""
    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"

    entered = {to: role for step in template.follows.values() for role, to in step.items()}
    pairs = [(None if state == template.start else entered[state], role) for state, step in template.follows.items() for role in step]
    legal = " OR ".join(f"(p IS {'NULL' if before is None else 'NOT DISTINCT FROM ' + quoted(before)} AND role = {quoted(role)})" for before, role in pairs)
    marks = " ".join(f"WHEN {quoted(role)} THEN {len(before) + len(after)}" for role, (before, after) in template.turns.items())
    escapes = f"len(regexp_extract_all({{}}, '{template.pattern}'))"
    other = f"{sum(map(len, template.other))} + length(role) + {escapes.format('role')}"
    final = ", ".join(quoted(entered[s]) for s in template.final)
    learned = ", ".join(map(quoted, template.learned))
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{_QUOTED}' UNION ALL SELECT -7, 1, 'assistant', '{_QUOTED}'),
o AS (SELECT *, row_number() OVER w - 1 AS seq, lag(role) OVER w AS p FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
t AS (SELECT *, CASE WHEN {legal} THEN NULL ELSE seq END AS refused, CASE role {marks} ELSE {other} END + length(text) + {escapes.format('text')} AS chars FROM o)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY seq)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role IN ({learned})), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY seq) FILTER (role IN ({learned})), '')) AS loss_sha256,
  CAST({len(template.begin)} + sum(chars) AS BIGINT) AS formatted_chars, min(refused) IS NULL AND arg_max(role, seq) IN ({final}) AS valid, min(refused) AS refused_at
FROM t GROUP BY conv_id
"""


OP11_SQL = _op11_sql(chat_format.INSTRUCTIONS)

OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
q AS (SELECT row_number() OVER () AS i, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
asked AS (SELECT i, item_id, t, count(*) AS times FROM q GROUP BY ALL),
whole AS (SELECT count(*) AS n_docs, CAST(sum(len(words)) AS BIGINT) AS n_terms FROM d WHERE len(words) > 0),
tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(words) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
w AS (SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, whole GROUP BY t, n_docs),
m AS (SELECT r, doc_id, CAST(25 + (75 * len(words) * n_docs) // n_terms AS BIGINT) AS m FROM d, whole),
s AS (SELECT i, item_id, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM asked JOIN w USING (t) JOIN tf USING (t) JOIN m USING (r) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS place FROM s WHERE score > 0)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM k WHERE place <= 10
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sentencepiece, op2_html_extract, op3_quality_rules, op4_exact_dedup, op5_best_fit_packing, op6_quality_classifier, op7_jaccard_join, op8_warc, op9_token_files, op10_url_filters, op11_chat_format, op12_lexical_search)}


def oracle_sql() -> dict[str, str]:
    return {"op3_quality_rules": OP3_SQL, "op4_exact_dedup": OP4_SQL, "op10_url_filters": OP10_SQL, "op11_chat_format": OP11_SQL, "op12_lexical_search": OP12_SQL}
