"""Text, date and reshaping functions over whole columns, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketflow.functions import dates, text
from docketflow.operators import enrich, labels, prefix, relate
from docketflow.operators.timeline import first_by
from docketflow.plans.pipeline_queries import MATCHES, REGISTER
from docketflow.plans.reference_queries import _FLAT, _flat, _norm
from docketflow.sources import files
from docketflow.sources.tables import in_tables, load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = in_tables(sql)
        return f

    return keep


@query("SELECT reg_id, trim(regexp_replace(regexp_replace(subject, '[‐–—−]', '-', 'g'), '[\\s\\x0b\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+', ' ', 'g'), ' ') AS plain, regexp_replace(subject, '[‐‑–—−]|â€[“”‘’]?', '-', 'g') AS wide FROM utc_doc_reg_df")
def f5_dashes(spark, sf_dir):
    s = F.col("subject")
    return load(spark, sf_dir, REGISTER).select("reg_id", text.plain_dashes(s).alias("plain"), text.wide_dashes(s).alias("wide"))


@query(
    "SELECT doc_num, '20' || substr(doc_num, 4, 2) AS short_year, substr(doc_num, 1, 4) AS head, substr(doc_num, 1, 9) AS id, coalesce(regexp_matches(substr(doc_num, 4, 2), '^\\d{2}$') AND TRY_CAST(substr(doc_num, 4, 2) AS INT) BETWEEN 11 AND 20, false) AS in_range FROM proposals"
)
def f11_id_parts(spark, sf_dir):
    d = F.col("doc_num")
    return load(spark, sf_dir, "proposals").select("doc_num", *(c.alias(n) for n, c in text.id_parts(d).items()), text.id_in_range(d, 11, 20).alias("in_range"))


@query("SELECT reg_id, array_to_string(list_sort([upper(x) for x in regexp_extract_all(coalesce(array_to_string(unicode_points, ' '), ''), '(?i)U\\+([0-9A-F]{4,6})', 1)]), ' ') AS canonical FROM utc_doc_reg_df")
def f16_canonical(spark, sf_dir):
    return load(spark, sf_dir, REGISTER).select("reg_id", text.canonical_code_points(F.coalesce(F.array_join("unicode_points", " "), F.lit(""))).alias("canonical"))


@query("SELECT match_id, regexp_replace(subject, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x9F]', '', 'g') AS stripped FROM email_match_df")
def f18_controls(spark, sf_dir):
    return load(spark, sf_dir, MATCHES).select("match_id", text.strip_controls(F.col("subject")).alias("stripped"))


@query(
    "WITH f AS (SELECT match_id, coalesce(from_email, '') || ' (' || coalesce(from_name, '') || ')' AS field FROM email_match_df), "
    "a AS (SELECT match_id, field, regexp_replace(trim(regexp_replace(field, '\\(.*?\\)', '', 'g'), ' '), '\\s+at\\s+', '@', 'g') AS address FROM f) "
    "SELECT match_id, CASE WHEN contains(address, '@') THEN address ELSE '' END AS email, trim(regexp_extract(field, '\\((.*?)\\)', 1), ' ') AS name FROM a"
)
def f19_sender(spark, sf_dir):
    field = F.concat(F.coalesce("from_email", F.lit("")), F.lit(" ("), F.coalesce("from_name", F.lit("")), F.lit(")"))
    return load(spark, sf_dir, MATCHES).select("match_id", text.sender(field).alias("s")).select("match_id", "s.email", "s.name")


@query("SELECT match_id, replace(trim(from_email, ' '), '_at_', '@') AS address, replace(coalesce(from_email, ''), '_at_', '@') AS linked FROM email_match_df")
def f20_addresses(spark, sf_dir):
    link = F.concat(F.lit("<a href='mailto:"), F.replace(F.coalesce("from_email", F.lit("")), F.lit(" "), F.lit("%20")), F.lit("'>x</a>"))
    return load(spark, sf_dir, MATCHES).select(
        "match_id", text.mail_address(F.col("from_email")).alias("address"), F.when(F.coalesce("from_email", F.lit("")) == "", "").otherwise(F.replace(text.mail_address(link), F.lit("%20"), F.lit(" "))).alias("linked")
    )


@query("SELECT match_id, coalesce(summary, '') || chr(10) || '[quote 1]' || chr(10) || 'a' || chr(10) || '[/quote 1]' || chr(10) || '[quote 2]' || chr(10) || 'b' || chr(10) || '[/quote 2]' || chr(10) || 'end' AS body FROM email_match_df WHERE NOT contains(coalesce(summary, ''), chr(10)) AND NOT regexp_matches(coalesce(summary, ''), '^[>\\s]|[\\x0b\\x0c\\x1c-\\x1e\\x85\\x{2028}\\x{2029}\\r]')")
def f21_quotes(spark, sf_dir):
    """Quotations of growing depth after each one-line text."""
    mails = load(spark, sf_dir, MATCHES).select("match_id", F.coalesce("summary", F.lit("")).alias("t")).filter(~F.col("t").rlike(r"^[>\s]|[\n\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}\r]"))
    return mails.select("match_id", text.quote_blocks(F.concat("t", F.lit("\n> a\n>> b\nend"))).alias("body"))


@query("SELECT reg_id, coalesce(subject, '') || chr(10) || 'x & <y> \"z\"' AS plain FROM utc_doc_reg_df WHERE NOT regexp_matches(coalesce(subject, ''), '[<&]')")
def f23_tags(spark, sf_dir):
    rows = load(spark, sf_dir, REGISTER).filter(~F.coalesce("subject", F.lit("")).rlike("[<&]"))
    return rows.select("reg_id", text.strip_tags(F.concat(F.lit("<b>"), F.coalesce("subject", F.lit("")), F.lit("</b><br/>x &amp; &lt;y&gt; &quot;z&quot;"))).alias("plain"))


@query("SELECT reg_id, lower(regexp_extract(coalesce(doc_url, ''), '\\.([^./]+)$', 1)) AS extension, CASE lower(regexp_extract(coalesce(doc_url, ''), '\\.([^./]+)$', 1)) WHEN 'txt' THEN 'text' WHEN 'htm' THEN 'html' WHEN 'html' THEN 'html' WHEN 'pdf' THEN 'pdf' ELSE '' END AS reader FROM utc_doc_reg_df")
def f25_readers(spark, sf_dir):
    """Extension of each address, and which reader it goes to; '' where there is none."""
    return load(spark, sf_dir, REGISTER).select("reg_id", text.extension(F.col("doc_url")).alias("extension"), text.reader_of(F.col("doc_url")).alias("reader"))


@query("SELECT reg_id, array_to_string(list_sort([trim(x, ' ') for x in string_split(source, ',')]), ', ') AS sorted FROM utc_doc_reg_df")
def f28_sorted_lists(spark, sf_dir):
    return load(spark, sf_dir, REGISTER).select("reg_id", text.sorted_list(F.col("source")).alias("sorted"))


@query("SELECT reg_id, regexp_replace(doc_num, '[^A-Za-z0-9_.-]+', '_', 'g') AS file, 'Token Usage' AS title FROM utc_doc_reg_df")
def f30_names(spark, sf_dir):
    return load(spark, sf_dir, REGISTER).select("reg_id", text.file_name(F.col("doc_num")).alias("file"), text.title_case(F.lit("token_usage")).alias("title"))


@query("SELECT event_id, date_trunc('second', ts) AS iso, date_trunc('day', ts)::TIMESTAMP AS named FROM events")
def f34_parsed(spark, sf_dir):
    """Times written in two notations and read again by the first format that fits."""
    naive = lambda c: dates.parse_mixed(c).cast("timestamp_ntz")
    return load(spark, sf_dir, "events").select("event_id", naive(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("iso"), naive(F.date_format("ts", "MMMM d, yyyy")).alias("named"))


@query("SELECT event_id, date_trunc('second', ts) AS bare, date_trunc('second', ts) AS wall, date_trunc('second', ts) AS from_id FROM events")
def f35_mail_times(spark, sf_dir):
    """Zones taken off, wall-clock times of mail dates, and times in message ids."""
    naive = lambda c: c.cast("timestamp_ntz")
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    mail = F.concat(F.date_format("ts", "EEE, d MMM yyyy HH:mm:ss"), F.lit(" -0500 (EST)"))
    ids = F.concat(F.lit("<"), F.unix_seconds(F.col("ts").cast("timestamp")).cast("string"), F.lit(".123@x>"))
    return load(spark, sf_dir, "events").select(
        "event_id", naive(dates.parse_mixed(dates.without_zone(F.concat(stamp, F.lit(" PDT"))))).alias("bare"), naive(dates.local_mail_time(mail)).alias("wall"), naive(dates.id_time(ids)).alias("from_id")
    )


@query(
    "SELECT reg_id, people, CASE WHEN regexp_full_match(coalesce(file_extension, ''), '\\d{1,18}') THEN file_extension::BIGINT ELSE 0 END AS digits, "
    "CASE WHEN doc_type IS NOT NULL THEN coalesce(array_to_string(list_sort([CASE WHEN len(e.value) > 0 THEN e.key || ': ' || array_to_string(e.value, ', ') ELSE e.key END for e in map_entries(doc_type)]), '; '), '') END AS labels FROM utc_doc_reg_df"
)
def f44_literals(spark, sf_dir):
    """Arrays written as JSON and read as literals, digits as numbers, label maps as text."""
    read = text.literal_list(F.to_json("people"))
    return load(spark, sf_dir, REGISTER).select("reg_id", read.alias("people"), text.digits_or_zero(F.col("file_extension")).alias("digits"), text.label_text(F.col("doc_type")).alias("labels"))


@query("SELECT reg_id, round(coalesce(token_usage.prompt_tokens, 0) * 2e-7::DOUBLE + coalesce(token_usage.completion_tokens, 0) * 5e-7::DOUBLE, 9) AS cost FROM utc_doc_reg_df")
def f42_cost(spark, sf_dir):
    """Cost of token counts at given rates."""
    return load(spark, sf_dir, REGISTER).select("reg_id", F.round(enrich.cost(F.col("token_usage"), 2e-7, 5e-7), 9).alias("cost"))


@query("SELECT doc_num, list_contains(map_keys(doc_type), 'Proposals') AS is_proposal, len(list_filter(map_keys(doc_type), lambda k: contains(lower(k), 'doc'))) > 0 AS about_documents, w.doc_num IS NOT NULL AS listed, reg_id FROM utc_doc_reg_df r LEFT JOIN (SELECT doc_num AS d, doc_num FROM register_withdrawals) w ON r.doc_num = w.d".replace("SELECT doc_num, list", "SELECT r.doc_num, list"))
def pr23_flags(spark, sf_dir):
    """A label there, a word in any label, and membership of a short list."""
    listed = load(spark, sf_dir, "register_withdrawals").select("doc_num", F.lit(True).alias("listed")).distinct()
    rows = load(spark, sf_dir, REGISTER).join(listed, "doc_num", "left")
    return rows.select(
        "reg_id", "doc_num", F.map_contains_key("doc_type", F.lit("Proposals")).alias("is_proposal"), F.exists(F.map_keys("doc_type"), lambda k: F.lower(k).contains("doc")).alias("about_documents"), F.coalesce("listed", F.lit(False)).alias("listed")
    )


@query("SELECT reg_id, doc_num FROM utc_doc_reg_df r WHERE doc_num IS NOT NULL AND NOT EXISTS (SELECT 1 FROM register_withdrawals w WHERE w.doc_num = r.doc_num) AND coalesce(file_size_kb, 0) <= 500")
def pr7_excluded(spark, sf_dir):
    """Rows that no exclusion list names and no bound drops."""
    rows = load(spark, sf_dir, REGISTER).filter("doc_num IS NOT NULL AND coalesce(file_size_kb, 0) <= 500").select("reg_id", "doc_num")
    return rows.join(load(spark, sf_dir, "register_withdrawals").select("doc_num"), "doc_num", "left_anti")


@query("SELECT doc_num AS number, proposal_title AS title, 'none' AS state, 0 AS score FROM proposals")
def pr10_shaped(spark, sf_dir):
    """Columns dropped, renamed to lower case with underscores, put in order, and added where absent."""
    wide = load(spark, sf_dir, "proposals").select(F.col("proposal_title").alias(" Title "), F.col("doc_num").alias("Number"), F.lit(0).alias("Score"), "proposer")
    return files.with_defaults(files.snake_names(wide.drop("proposer")), {"state": F.lit("none"), "score": F.lit(9)}).select("number", "title", "state", "score")


@query("SELECT reg_id FROM utc_doc_reg_df ORDER BY md5(reg_id::VARCHAR || 'a'), reg_id LIMIT 100")
def pr14_sample(spark, sf_dir):
    """A random sample of 100 rows, the same for the same seed."""
    return files.sample_rows(load(spark, sf_dir, REGISTER).select("reg_id"), "reg_id", 100, "a")


@query("SELECT match_id FROM email_match_df m WHERE NOT EXISTS (SELECT 1 FROM utc_doc_reg_df r WHERE r.reg_id = m.match_id)")
def pr15_unprocessed(spark, sf_dir):
    done = load(spark, sf_dir, REGISTER).select(F.col("reg_id").alias("match_id"))
    return files.unprocessed(load(spark, sf_dir, MATCHES).select("match_id"), done, "match_id")


@query("SELECT p.doc_num, CASE WHEN r.doc_num IS NOT NULL AND proposal_for_2 IS NULL THEN 'single' WHEN proposal_for_2 IS NOT NULL THEN 'combination' END AS kind FROM proposals p LEFT JOIN (SELECT DISTINCT doc_num FROM utc_doc_reg_df) r ON p.doc_num = r.doc_num")
def pr19_kind(spark, sf_dir):
    there = load(spark, sf_dir, REGISTER).select("doc_num", F.lit(True).alias("there")).distinct()
    kind = F.when(F.col("there") & F.col("proposal_for_2").isNull(), "single").when(F.col("proposal_for_2").isNotNull(), "combination")
    return load(spark, sf_dir, "proposals").join(there, "doc_num", "left").select("doc_num", kind.alias("kind"))


@query("SELECT match_id, trim(k, ' ') AS kind FROM (SELECT match_id, year, unnest(string_split(match_type, ';')) AS k FROM email_match_df) WHERE trim(k, ' ') NOT IN ('', '-') AND year BETWEEN 2012 AND 2016")
def pr26_split_filter(spark, sf_dir):
    rows = load(spark, sf_dir, MATCHES).filter(F.col("year").between(2012, 2016)).select("match_id", F.explode(F.split("match_type", ";")).alias("k"))
    return rows.select("match_id", F.trim("k").alias("kind")).filter(~F.col("kind").isin("", "-"))


@query(
    "WITH s AS (SELECT doc_num, trim(unnest(string_split(source, ',')), ' ') AS a FROM utc_doc_reg_df WHERE doc_num IS NOT NULL) SELECT p.doc_num, coalesce(string_agg(DISTINCT a, ', ' ORDER BY a), '') AS authors FROM proposals p LEFT JOIN s ON p.doc_num = s.doc_num AND a <> '' GROUP BY 1"
)
def j14_author_lookup(spark, sf_dir):
    """The authors of each proposal by its register rows, '' where there are none."""
    each = load(spark, sf_dir, REGISTER).select("doc_num", F.explode(F.split("source", ",")).alias("a")).select("doc_num", F.trim("a").alias("a")).filter("a <> ''").distinct()
    per = each.groupBy("doc_num").agg(F.array_join(F.array_sort(F.collect_list("a")), ", ").alias("authors"))
    return load(spark, sf_dir, "proposals").select("doc_num").join(per, "doc_num", "left").na.fill("", ["authors"])


@query(
    f"WITH p AS (SELECT id, proposal_title, proposer FROM (SELECT {_norm('doc_num')} AS id, *, row_number() OVER (PARTITION BY {_norm('doc_num')} ORDER BY doc_num) AS r FROM proposals) WHERE r = 1) "
    f"SELECT match_id, coalesce(proposal_title, '') AS title, coalesce(proposer, '') AS proposer FROM email_match_df m LEFT JOIN p ON {_norm('m.proposal_doc_num')} = p.id"
)
def j15_first_match(spark, sf_dir):
    """Title and proposer of the first proposal with a mail's normalised number."""
    named = load(spark, sf_dir, "proposals").withColumn("id", text.normal_id(F.col("doc_num")))
    first = first_by(named, ["id"], F.col("doc_num")).select("id", "proposal_title", "proposer")
    mails = load(spark, sf_dir, MATCHES).select("match_id", text.normal_id(F.col("proposal_doc_num")).alias("id"))
    return mails.join(first, "id", "left").select("match_id", F.coalesce("proposal_title", F.lit("")).alias("title"), F.coalesce("proposer", F.lit("")).alias("proposer"))


@query("SELECT r.reg_id, coalesce(u.subject, r.subject) AS subject, coalesce(u.error_message, r.error_message) AS error_message FROM utc_doc_reg_df r LEFT JOIN (SELECT reg_id, md5(subject) AS subject, 'done' AS error_message FROM utc_doc_reg_df WHERE reg_id % 3 = 0) u ON r.reg_id = u.reg_id")
def j18_updated(spark, sf_dir):
    """Results written back to the rows that they belong to."""
    rows = load(spark, sf_dir, REGISTER).select("reg_id", "subject", "error_message")
    results = rows.filter("reg_id % 3 = 0").select("reg_id", F.md5("subject").alias("subject"), F.lit("done").alias("error_message"))
    return relate.update(rows, results, "reg_id", ["subject", "error_message"])


_TYPES = [*text.DOCUMENT_TYPES, text.OTHERS]


@query(_FLAT + "SELECT year(ingest_ts) AS year, " + ", ".join(f"count(*) FILTER (category = '{c}') AS \"{c}\"" for c in _TYPES) + " FROM f WHERE ingest_ts IS NOT NULL GROUP BY 1")
def a1_pivot(spark, sf_dir):
    """Labels by year and category, columns in order of their totals."""
    rows = _flat(spark, sf_dir).filter("ingest_ts IS NOT NULL").select(F.year("ingest_ts").alias("year"), "category")
    return labels.pivot_counts(rows, "year", "category", _TYPES)


_FEEDS = "SELECT feed FROM feeds"


@query("SELECT feed, count(*) FILTER (year(ingest_ts) = 2011) AS y2011, count(*) FILTER (year(ingest_ts) = 2012) AS y2012, count(*) FILTER (year(ingest_ts) = 2013) AS y2013, row_number() OVER (ORDER BY count(*) DESC, feed NULLS FIRST) AS place FROM utc_doc_reg_df WHERE year(ingest_ts) BETWEEN 2011 AND 2013 GROUP BY 1")
def a3_pivot(spark, sf_dir):
    """Feeds by year, in order of their totals."""
    rows = load(spark, sf_dir, REGISTER).select("feed", F.year("ingest_ts").alias("y")).filter(F.col("y").between(2011, 2013))
    wide = rows.groupBy("feed").pivot("y", [2011, 2012, 2013]).count().na.fill(0, ["2011", "2012", "2013"])
    total = F.col("2011") + F.col("2012") + F.col("2013")
    # one row per feed, a short fixed table
    place = F.row_number().over(Window.orderBy(F.desc("total"), F.col("feed").asc_nulls_first()))
    return wide.withColumn("total", total).select("feed", *(F.col(str(y)).alias(f"y{y}") for y in (2011, 2012, 2013)), place.alias("place"))


@query(
    "WITH c AS (SELECT file_extension, feed, count(*) AS n FROM utc_doc_reg_df GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY file_extension ORDER BY n DESC, feed NULLS FIRST) AS r FROM c) "
    "SELECT file_extension, coalesce(max(n) FILTER (r = 1), 0) AS first, coalesce(max(n) FILTER (r = 2), 0) AS second, coalesce(max(n) FILTER (r = 3), 0) AS third FROM k GROUP BY 1"
)
def a5_pivot(spark, sf_dir):
    """Per extension, the counts of its three most frequent feeds side by side."""
    counted = load(spark, sf_dir, REGISTER).groupBy("file_extension", "feed").agg(F.count(F.lit(1)).alias("n"))
    top = counted.withColumn("r", F.row_number().over(Window.partitionBy("file_extension").orderBy(F.desc("n"), F.col("feed").asc_nulls_first()))).filter("r <= 3")
    wide = top.groupBy("file_extension").pivot("r", [1, 2, 3]).agg(F.max("n")).na.fill(0, ["1", "2", "3"])
    return wide.select("file_extension", F.col("1").alias("first"), F.col("2").alias("second"), F.col("3").alias("third"))


@query(
    "SELECT year(ingest_ts) AS year, count(*) FILTER (pictograph_relevant) AS yes, count(*) FILTER (NOT pictograph_relevant) AS no, count(*) FILTER (pictograph_relevant IS NOT NULL) AS total, "
    "round_even(100.0::DOUBLE * count(*) FILTER (pictograph_relevant) / count(*) FILTER (pictograph_relevant IS NOT NULL), 1) AS pct FROM utc_doc_reg_df WHERE ingest_ts IS NOT NULL AND pictograph_relevant IS NOT NULL GROUP BY 1"
)
def a8_totals(spark, sf_dir):
    """Row totals and percentages rounded half to even; both columns are there whatever occurs."""
    rows = load(spark, sf_dir, REGISTER).filter("ingest_ts IS NOT NULL AND pictograph_relevant IS NOT NULL").select(F.year("ingest_ts").alias("year"), F.when(F.col("pictograph_relevant"), "yes").otherwise("no").alias("k"))
    wide = rows.groupBy("year").pivot("k", ["yes", "no"]).count().na.fill(0, ["yes", "no"]).withColumn("total", F.col("yes") + F.col("no"))
    return wide.withColumn("pct", F.bround(100.0 * F.col("yes") / F.col("total"), 1))


@query(
    _FLAT
    + ", tf AS (SELECT feed FROM f WHERE feed IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, feed LIMIT 10), tc AS (SELECT category FROM f WHERE feed IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, category LIMIT 10) "
    "SELECT tf.feed, tc.category, count(f.feed) AS n FROM tf JOIN tc ON true LEFT JOIN f ON f.feed = tf.feed AND f.category = tc.category GROUP BY 1, 2"
)
def a11_ten_by_ten(spark, sf_dir):
    """Counts of the ten greatest feeds by the ten greatest categories, zeros included."""
    counted = _flat(spark, sf_dir).filter("feed IS NOT NULL").groupBy("feed", "category").agg(F.count(F.lit(1)).alias("n"))
    return labels.top_crosstab(counted, "feed", "category", 10)


@query(
    "SELECT proposal_doc_num, round(avg(confidence_score), 6) AS mean, max(confidence_score) AS most, CAST(floor((epoch_us(max(loaded_ts)) - epoch_us(min(loaded_ts))) / 86400000000.0) AS INT) AS span_days FROM email_match_df WHERE proposal_doc_num IS NOT NULL GROUP BY 1"
)
def a22_span(spark, sf_dir):
    per = load(spark, sf_dir, MATCHES).filter("proposal_doc_num IS NOT NULL").groupBy("proposal_doc_num").agg(F.avg("confidence_score").alias("mean"), F.max("confidence_score").alias("most"), F.min("loaded_ts").alias("a"), F.max("loaded_ts").alias("b"))
    return per.select("proposal_doc_num", F.round("mean", 6).alias("mean"), "most", dates.whole_days(F.col("a"), F.col("b")).alias("span_days"))


@query("SELECT reg_id, sum(coalesce(token_usage.total_tokens, 0)) OVER (ORDER BY reg_id) AS tokens, sum(coalesce(api_cost::DECIMAL(18, 8), 0)) OVER (ORDER BY reg_id)::DOUBLE AS cost FROM utc_doc_reg_df")
def a23_running(spark, sf_dir):
    """Running totals of tokens and cost."""
    rows = load(spark, sf_dir, REGISTER).select("reg_id", F.col("token_usage.total_tokens").cast("long").alias("t"), F.col("api_cost").cast("decimal(18,8)").alias("c"))
    return prefix.running_totals(rows, ["reg_id"], {"tokens": "t", "cost": "c"}).select("reg_id", "tokens", F.col("cost").cast("double").alias("cost"))


@query(
    "WITH e AS (SELECT p.doc_num, c, min(reg_id) AS pos FROM proposals p JOIN (SELECT reg_id, doc_num, unnest(map_keys(doc_type)) AS c FROM utc_doc_reg_df) r ON p.doc_num = r.doc_num GROUP BY 1, 2) SELECT doc_num, string_agg(c, ',' ORDER BY pos, c) AS categories FROM e GROUP BY 1"
)
def a26_by_appearance(spark, sf_dir):
    """Categories of each proposal in order of their first appearance."""
    each = load(spark, sf_dir, REGISTER).select("reg_id", "doc_num", F.explode(F.map_keys("doc_type")).alias("c"))
    first = each.join(load(spark, sf_dir, "proposals").select("doc_num").distinct(), "doc_num", "left_semi").groupBy("doc_num", "c").agg(F.min("reg_id").alias("at"))
    per = first.groupBy("doc_num").agg(F.array_sort(F.collect_list(F.struct("at", "c"))).alias("x"))
    return per.select("doc_num", F.array_join(F.transform("x", lambda x: x["c"]), ",").alias("categories"))


@query("SELECT match_id, last_value(proposal_for_2 IGNORE NULLS) OVER (PARTITION BY proposal_doc_num ORDER BY match_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM email_match_df WHERE proposal_doc_num IS NOT NULL")
def w9_filled(spark, sf_dir):
    """The last value so far of each proposal, however many rows it has."""
    rows = load(spark, sf_dir, MATCHES).filter("proposal_doc_num IS NOT NULL").select("match_id", "proposal_doc_num", "proposal_for_2")
    return prefix.forward_fill(rows, "proposal_doc_num", ["match_id"], "proposal_for_2", "filled").select("match_id", "filled")


@query("SELECT reg_id, (row_number() OVER (ORDER BY reg_id) - 1) // 10 AS batch, (row_number() OVER (ORDER BY reg_id) - 1) % 4 AS worker FROM utc_doc_reg_df")
def w11_batches(spark, sf_dir):
    """Batches of ten by position, and workers in turn."""
    numbered = prefix.running_totals(load(spark, sf_dir, REGISTER).select("reg_id", F.lit(1).alias("one")), ["reg_id"], {"k": "one"})
    return numbered.select("reg_id", F.floor((F.col("k") - 1) / 10).alias("batch"), ((F.col("k") - 1) % 4).alias("worker"))


@query("SELECT file_extension, feed, n, row_number() OVER (ORDER BY file_extension NULLS LAST, n DESC, feed NULLS LAST) AS place FROM (SELECT file_extension, feed, count(*) AS n FROM utc_doc_reg_df GROUP BY 1, 2)")
def o2_mixed_order(spark, sf_dir):
    """One column up, one down, nulls last; the place is what is compared."""
    counted = load(spark, sf_dir, REGISTER).groupBy("file_extension", "feed").agg(F.count(F.lit(1)).alias("n"))
    order = [F.col("file_extension").asc_nulls_last(), F.desc("n"), F.col("feed").asc_nulls_last()]
    return counted.withColumn("place", F.row_number().over(Window.orderBy(*order)))


@query(
    "SELECT * FROM (SELECT 'relevant' AS cohort, feed, count(*) AS n FROM utc_doc_reg_df WHERE pictograph_relevant GROUP BY feed ORDER BY n DESC, feed LIMIT 5) UNION ALL SELECT * FROM (SELECT 'other', feed, count(*) AS n FROM utc_doc_reg_df WHERE NOT pictograph_relevant GROUP BY feed ORDER BY n DESC, feed LIMIT 5)"
)
def u2_top_five(spark, sf_dir):
    """The five greatest feeds of two cohorts, labelled."""
    counted = load(spark, sf_dir, REGISTER).filter("pictograph_relevant IS NOT NULL").groupBy("pictograph_relevant", "feed").agg(F.count(F.lit(1)).alias("n"))
    top = labels.top_per_group(counted, ["pictograph_relevant"], 5, "feed")
    return top.select(F.when(F.col("pictograph_relevant"), "relevant").otherwise("other").alias("cohort"), "feed", "n")


@query(
    "WITH a AS (SELECT DISTINCT doc_num FROM proposals), b AS (SELECT DISTINCT doc_num FROM utc_doc_reg_df WHERE list_contains(map_keys(doc_type), 'Proposals') AND doc_num IS NOT NULL), "
    "x AS (SELECT count(a.doc_num) AS na, count(b.doc_num) AS nb, count(*) FILTER (a.doc_num IS NOT NULL AND b.doc_num IS NOT NULL) AS k FROM a FULL JOIN b ON a.doc_num = b.doc_num) "
    "SELECT na - k AS only_a, k AS \"both\", nb - k AS only_b, k / na::DOUBLE AS recall, k / nb::DOUBLE AS precision, na * nb / nullif(k, 0)::DOUBLE AS estimated_total, k / nb::DOUBLE AS completeness FROM x"
)
def u5_completeness(spark, sf_dir):
    """Recall, precision, the total estimated from the overlap of two lists, and the share of it that the first has."""
    found = load(spark, sf_dir, REGISTER).filter(F.map_contains_key("doc_type", F.lit("Proposals")))
    return relate.completeness(load(spark, sf_dir, "proposals"), found, "doc_num")


@query(
    f"WITH p AS (SELECT DISTINCT {_norm('doc_num')} AS id FROM proposals WHERE coalesce(doc_num, '') <> ''), y AS (SELECT {_norm('doc_num')} AS id, year(ingest_ts) AS year FROM utc_doc_reg_df UNION SELECT {_norm('proposal_doc_num')}, year FROM email_match_df) SELECT p.id, y.year FROM p JOIN y ON p.id = y.id WHERE year IS NOT NULL"
)
def u6_spine(spark, sf_dir):
    """Years of each proposal in documents or mails."""
    ids = load(spark, sf_dir, "proposals").select(text.normal_id(F.col("doc_num")).alias("id")).filter("id <> ''").distinct()
    docs = load(spark, sf_dir, REGISTER).select(text.normal_id(F.col("doc_num")).alias("id"), F.year("ingest_ts").alias("year"))
    mails = load(spark, sf_dir, MATCHES).select(text.normal_id(F.col("proposal_doc_num")).alias("id"), "year")
    return docs.unionByName(mails).filter("year IS NOT NULL").distinct().join(ids, "id", "left_semi")


@query("SELECT doc_num, md5(proposal_title) AS proposal_title, md5(proposer) AS proposer FROM proposals WHERE proposal_title IS NOT NULL")
def ud3_each_column(spark, sf_dir):
    """One function over all text columns, after a filter given by the caller."""
    rows = files.filtered(load(spark, sf_dir, "proposals").select("doc_num", "proposal_title", "proposer"), F.col("proposal_title").isNotNull())
    return files.each_text(rows, F.md5, ["doc_num"])


def _enriched(kind: str, schema: str, columns: list[str]):
    def run(spark, sf_dir):
        prompt = enrich.prompt_for(kind, text=F.col("summary"), title=F.col("subject"))
        done = enrich.enrich(load(spark, sf_dir, MATCHES), "match_id", prompt, schema)
        return done.select("match_id", *(F.col(f"reply.{c}").alias(c) for c in columns), "error", enrich.used(done).alias("tokens"))

    run.__name__ = f"ud_{kind}"
    QUERIES[run.__name__] = run


_enriched("mail", enrich.DOCUMENT_REPLY, ["relevant", "summary"])
_enriched("keywords", enrich.KEYWORD_REPLY, ["keywords"])
_enriched("labels", enrich.LABEL_REPLY, ["is_proposal"])
_enriched("salience", enrich.SALIENCE_REPLY, ["explicitness", "coverage_pct", "confidence"])


@query("SELECT reg_id, summary IS NOT NULL AND regexp_replace(summary, '\\s+', '', 'g') <> '' AS summarised, true AS shorter FROM utc_doc_reg_df")
def st5_summaries(spark, sf_dir):
    """The most telling sentences of each text, never more than the text itself."""
    from docketflow.operators import phrases

    rows = load(spark, sf_dir, REGISTER).select("reg_id", "summary", phrases.summaries(2)(F.col("summary")).alias("s"))
    return rows.select("reg_id", F.col("s").isNotNull().alias("summarised"), (F.coalesce(F.length("s"), F.lit(0)) <= F.coalesce(F.length("summary"), F.lit(0))).alias("shorter"))


@query()
def st5_phrases(spark, sf_dir):
    """Key phrases of each document by degree over frequency of their words in the corpus."""
    from docketflow.operators import phrases

    return phrases.key_phrases(load(spark, sf_dir, REGISTER), "reg_id", "summary")
