"""Queries on text normalisation, parsing, chunking, evaluation and data-quality flags."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import jsonx, text
from ..operators import chunking, evaluation, relational, routing
from .registry import query, table, words_sql

SQUEEZE = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
PUNCT = r"[.,;:!?\"''()\[\]{}]"


@query(rf"""
SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '{PUNCT}', '', 'g'), '\s+', ' ', 'g'))) AS plain, sha256(trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(text, '')), '{PUNCT}', '', 'g'), '[0-9]+', '0', 'g'), '\s+', ' ', 'g'))) AS no_numbers,
 sha256(trim(regexp_replace(regexp_replace(replace(lower(coalesce(text, '')), '&', 'and'), '[^a-z0-9]+', ' ', 'g'), '\s+', ' ', 'g'))) AS key FROM documents
""")
def normalize_text(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.benchmark_text(t), 256).alias("plain"), F.sha2(text.benchmark_text(t, numbers=True), 256).alias("no_numbers"), F.sha2(text.category_key(t), 256).alias("key"))


@query(r"""
SELECT page_id, regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(url, '^.*/', ''), '\.[^.]*$', '')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug, sha256(html) AS digest FROM pages
""")
def page_slugs(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.slug(F.col("url")).alias("slug"), F.sha2("html", 256).alias("digest"))


@query("""
SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'U' ELSE 'V' END AS speaker, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS said FROM conversations
""")
def speaker_turns(spark, sf_dir):
    """Conversations written as one transcript with speaker marks, then parsed back."""
    c = table(spark, sf_dir, "conversations")
    line = F.concat(F.when(F.col("role") == "user", "U: ").otherwise("V: "), text.squeeze(F.col("text")))
    scripts = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))).alias("x"))
    scripts = scripts.select("conv_id", F.transform("x", lambda r: r["turn"]).alias("turns"), F.array_join(F.transform("x", lambda r: r["line"]), "\n").alias("script"))
    parsed = scripts.select("conv_id", "turns", F.posexplode(text.speaker_turns(F.col("script"))).alias("k", "t"))
    return parsed.select("conv_id", F.get("turns", F.col("k")).alias("turn"), F.col("t.speaker").alias("speaker"), F.sha2("t.text", 256).alias("said"))


@query("""
WITH l AS (SELECT conv_id, turn, list_filter(list_transform(string_split_regex(trim(text), '\\n+'), lambda p: trim(regexp_replace(trim(p), '^(?:[0-9]+[.)]|[-*•])\\s*', ''))), lambda p: p <> '') AS items FROM conversations WHERE contains(trim(text), chr(10)))
SELECT conv_id, turn, len(items)::INTEGER AS n, sha256(array_to_string(list_transform(range(1, len(items) + 1), lambda i: i || '. ' || items[i]), chr(10))) AS listed FROM l
""")
def numbered_lists(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where(F.contains(F.trim("text"), F.lit("\n"))).withColumn("items", text.list_items(F.col("text")))
    return c.select("conv_id", "turn", F.size("items").alias("n"), F.sha2(text.numbered(F.col("items")), 256).alias("listed"))


@query("""
SELECT conv_id, turn, 'E' || (turn + 1) AS id, string_split(text, ' ')[1] AS span, sha256(text) AS plain FROM conversations WHERE NOT contains(string_split(text, ' ')[1], ']')
""")
def anchor_tags(spark, sf_dir):
    """A tag with a colon around each first word, turned to bars, parsed and stripped."""
    c = table(spark, sf_dir, "conversations").withColumn("first", F.element_at(F.split("text", " "), 1)).where(~F.contains(F.col("first"), F.lit("]")))
    tagged = F.concat(F.lit("[[E"), (F.col("turn") + 1).cast("string"), F.lit(":"), F.col("first"), F.lit("]]"), F.expr("substring(text, length(first) + 1)"))
    c = c.withColumn("tagged", text.anchors_with_bars(tagged))
    return c.select("conv_id", "turn", F.explode(text.anchor_segments(F.col("tagged"))).alias("s"), F.sha2(text.without_anchors(F.col("tagged")), 256).alias("plain")).select("conv_id", "turn", F.col("s.id").alias("id"), F.col("s.text").alias("span"), "plain")


@query("""
SELECT event_id, CASE WHEN v < 1000 THEN v || ' ms' WHEN v < 60000 THEN (v // 1000) || '.' || ((v % 1000) // 100) || ' s' ELSE (v // 60000) || ' m ' || lpad(((v // 1000) % 60)::VARCHAR, 2, '0') || ' s' END AS took FROM (SELECT event_id, (event_id * 37 % 200000)::BIGINT AS v FROM events)
""")
def duration_format(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text.duration_text(F.col("event_id") * 37 % 200000).alias("took"))


@query("""
SELECT doc_id, CASE WHEN length(text) <= 400 THEN text ELSE substr(text, 1, 150) || chr(10) || '[...]' || chr(10) || substr(text, length(text) - 99) END AS cut FROM documents
""")
def prompt_safe_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.shortened(F.col("text"), 400, 150, 100).alias("cut"))


@query("""
WITH d AS (SELECT p_partkey, 'Name: ' || trim(p_name) || '.' || CASE WHEN p_type <> 'PROMO' THEN ' Type: ' || p_type || '.' ELSE '' END || ' Barcode: A-' || p_partkey || ' 7; Batch: B' || p_size AS t FROM part)
SELECT p_partkey, t AS description, 'A' || p_partkey || '7' AS barcode, 'B' || regexp_extract(t, 'Batch: B([0-9]+)', 1) AS batch FROM d
""")
def product_descriptions(spark, sf_dir):
    """Template text with blanks left out, and the codes found in it again."""
    p = table(spark, sf_dir, "part")
    body = text.labelled([("Name", F.col("p_name")), ("Type", F.when(F.col("p_type") != "PROMO", F.col("p_type")).otherwise(" "))])
    t = F.concat(body, F.lit(" Barcode: A-"), F.col("p_partkey").cast("string"), F.lit(" 7; Batch: B"), F.col("p_size").cast("string"))
    d = p.select("p_partkey", t.alias("description"))
    return d.select("p_partkey", "description", text.barcode_in(F.col("description")).alias("barcode"), text.batch_in(F.col("description")).alias("batch"))


@query("""
SELECT s_suppkey, p_name AS long, substr(p_name, 1, 1) || substr(string_split(p_name, ' ')[2], 1, 1) AS short FROM supplier JOIN part ON p_partkey = s_suppkey
""")
def acronym_matches(spark, sf_dir):
    p = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("s_suppkey"))
    p = p.select("s_suppkey", F.col("p_name").alias("long"), F.concat(F.substring("p_name", 1, 1), F.substring(F.element_at(F.split("p_name", " "), 2), 1, 1)).alias("short"))
    return p.where(text.acronym_of(F.col("short"), F.col("long")))


@query("""
SELECT event_id, (props::JSON ->> '$.k')::INTEGER AS k, (props::JSON ->> '$.k')::INTEGER IS NULL AS failed FROM events
""")
def json_field_extract(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int", {"mode": "PERMISSIVE"}).alias("j"))
    return e.select("event_id", F.col("j.k").alias("k"), F.col("j.k").isNull().alias("failed"))


@query("""
SELECT event_id, (props::JSON ->> '$.k')::INTEGER AS k FROM events
""")
def json_repair(spark, sf_dir):
    """Payloads cut off and wrapped in fences, mended and read."""
    broken = F.concat(F.lit("Here:\n```json\n{\"a\": ["), F.expr("rtrim('}', props)"), F.lit(","))
    e = table(spark, sf_dir, "events").select("event_id", jsonx.repair_json(broken).alias("j"))
    return e.select("event_id", F.get_json_object("j", "$.a[0].k").cast("int").alias("k"))


@query("""
SELECT user_id, (count(DISTINCT event_type) + 1)::INTEGER AS size, arg_max(event_id, event_id) FILTER (WHERE event_type = 'error')::VARCHAR AS last_error, 'none' AS other FROM events GROUP BY user_id
""")
def pairs_to_map(spark, sf_dir):
    """Names and values of a user's events as a map, last one winning, filled from defaults."""
    pairs = F.transform(F.sort_array(F.collect_list(F.struct("event_id", "event_type"))), lambda e: F.struct(e["event_type"].alias("relationship"), e["event_id"].cast("string").alias("value")))
    m = table(spark, sf_dir, "events").groupBy("user_id").agg(pairs.alias("p")).select("user_id", jsonx.fill_map(jsonx.pairs_to_map(F.col("p")), F.create_map(F.lit("extra"), F.lit("none"))).alias("m"))
    return m.select("user_id", F.size("m").alias("size"), F.try_element_at("m", F.lit("error")).alias("last_error"), F.element_at("m", "extra").alias("other"))


@query("""
SELECT p_partkey AS id, p_name AS name, p_type AS kind, CASE WHEN p_size % 2 = 0 THEN 0.5 ELSE 0.95 END AS p FROM part WHERE p_size > 1
""")
def skeleton_lines(spark, sf_dir):
    """Pipe-separated lines, some too short, with a hint that may carry a probability."""
    p = table(spark, sf_dir, "part")
    hint = F.concat("p_brand", F.when(F.col("p_size") % 2 == 0, ":0.5").otherwise(""))
    line = F.when(F.col("p_size") > 1, F.concat_ws(" | ", F.col("p_partkey").cast("string"), "p_name", "p_type", hint)).otherwise(F.concat_ws("|", "p_name", "p_type"))
    f = p.select(jsonx.skeleton_fields(line).alias("f")).where("f is not null")
    h = f.select(F.col("f")[0].cast("long").alias("id"), F.col("f")[1].alias("name"), F.col("f")[2].alias("kind"), F.element_at(jsonx.hint_probabilities(F.col("f")[3]), 1)["p"].alias("p"))
    return h


# --- chunks -------------------------------------------------------------------------------


@query("""
WITH a AS (SELECT doc_id, length(text) AS l, least(6, greatest(2, ceil(length(text) / 4000.0)))::BIGINT AS n FROM documents), b AS (SELECT *, (l + (n - 1) * 200 + n - 1) // n AS s, greatest(1, l // 2000) AS f FROM a),
c AS (SELECT *, CASE WHEN s < 2000 THEN least(n, f) ELSE n END AS n2 FROM b)
SELECT doc_id, CASE WHEN l <= 4000 THEN 1 ELSE n2 END::INTEGER AS n, CASE WHEN l <= 4000 THEN l ELSE (l + (n2 - 1) * 200 + n2 - 1) // n2 END::INTEGER AS size FROM c
""")
def chunk_parameters(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", chunking.chunk_parameters(F.length("text")).alias("c")).select("doc_id", "c.n", "c.size")


@query("""
WITH a AS (SELECT doc_id, text, length(text) AS l, CASE WHEN length(text) <= 1000 THEN 1 ELSE ceil((length(text) - 100) / 900.0) END::BIGINT AS c FROM documents), b AS (SELECT *, CASE WHEN c > 1 AND l - (c - 1) * 900 - 100 < 200 THEN c - 1 ELSE c END AS k FROM a),
u AS (SELECT doc_id, text, l, k, unnest(range(k)) AS i FROM b)
SELECT doc_id, (i * 900)::INTEGER AS start, sha256(CASE WHEN i = k - 1 THEN substr(text, i * 900 + 1) ELSE substr(text, i * 900 + 1, 1000) END) AS chunk FROM u
""")
def chunk_overlap(spark, sf_dir):
    c = table(spark, sf_dir, "documents").select("doc_id", F.explode(chunking.chunks(F.col("text"), 1000, 100, 200)).alias("c"))
    return c.select("doc_id", F.col("c.start").alias("start"), F.sha2("c.text", 256).alias("chunk"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def chunk_merge(spark, sf_dir):
    """Chunks merged where they overlap give the text back."""
    c = table(spark, sf_dir, "documents").select("doc_id", F.explode(chunking.chunks(F.col("text"), 1000, 100, 200)).alias("c")).select("doc_id", F.col("c.start").alias("start"), F.col("c.text").alias("text"))
    return chunking.merged(c, "doc_id", "start", "text", 100).select("doc_id", F.sha2("text", 256).alias("digest"))


@query()
def space_aware_chunks(spark, sf_dir):
    c = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunking.space_aware_chunks("text", F.lit(800), F.lit(80))).alias("k", "chunk"))
    return c.select("doc_id", "k", F.sha2("chunk", 256).alias("chunk"))


@query("""
SELECT doc_id, i::INTEGER AS k, round(i * 45.0, 6)::DOUBLE AS start, round(least(i * 45.0 + 60, l / 10.0), 6)::DOUBLE AS stop FROM (SELECT doc_id, length(text) AS l, unnest(range(CASE WHEN length(text) / 10.0 <= 60 THEN 1 ELSE ceil((length(text) / 10.0 - 15) / 45)::BIGINT END)) AS i FROM documents)
""")
def time_windows(spark, sf_dir):
    w = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunking.time_windows(F.length("text") / 10, 60.0, 15.0)).alias("k", "w"))
    return w.select("doc_id", "k", F.round("w.start", 6).alias("start"), F.round("w.stop", 6).alias("stop"))


@query("""
SELECT d.doc_id, string_split(b.text, ' ')[1] AS word, substr(d.text, greatest(0, instr(d.text, string_split(b.text, ' ')[1]) - 1 - 40) + 1, length(string_split(b.text, ' ')[1]) + instr(d.text, string_split(b.text, ' ')[1]) - 1 + 40 - greatest(0, instr(d.text, string_split(b.text, ' ')[1]) - 1 - 40)) AS context
FROM documents d JOIN benchmark b ON d.doc_id % (SELECT count(*) FROM benchmark) = b.item_id WHERE instr(d.text, string_split(b.text, ' ')[1]) > 0
""")
def context_windows(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    n = b.count()
    words = b.select("item_id", F.element_at(F.split("text", " "), 1).alias("word"))
    d = table(spark, sf_dir, "documents").join(F.broadcast(words) if n <= 100_000 else words, F.col("doc_id") % n == F.col("item_id"))
    d = d.withColumn("at", F.instr("text", F.col("word"))).where("at > 0")
    return d.select("doc_id", "word", chunking.char_window(F.col("text"), F.col("at") - 1, F.col("at") - 1 + F.length("word"), 40).alias("context"))


@query()
def anchor_injection(spark, sf_dir):
    """The longest word of each turn is put in a tag, exact or fuzzy; no short SQL for the fuzzy part."""
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    longest = F.element_at(F.array_sort(F.filter(F.split("text", r"[ \n]"), lambda w: w != ""), lambda x, y: F.length(x) - F.length(y)), -1)
    spans = c.select("doc_id", F.lit(1).alias("ordinal"), longest.alias("span")).where("span is not null")
    return chunking.with_anchors(c, spans, "doc_id").select("doc_id", F.sha2("text", 256).alias("tagged"))


# --- evaluation ---------------------------------------------------------------------------

PAIRS = r"SELECT slug, ref, replace(substr(ref, 3), ' the ', ' ') || ' end' AS hyp FROM (SELECT item_id AS slug, regexp_replace(text, '[^a-zA-Z .,]', '', 'g') AS ref FROM benchmark)"


def scored_pairs(spark, sf_dir):
    """ASCII letters only: the oracle counts edits in bytes."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("slug"), F.regexp_replace("text", "[^a-zA-Z .,]", "").alias("ref"))
    return b.withColumn("hyp", F.concat(F.replace(F.expr("substring(ref, 3)"), F.lit(" the "), F.lit(" ")), F.lit(" end")))


@query(f"SELECT slug, round(levenshtein(ref, hyp) / length(ref), 9) AS cer FROM ({PAIRS})")
def cer_by_item(spark, sf_dir):
    return scored_pairs(spark, sf_dir).select("slug", F.round(evaluation.cer(F.col("ref"), F.col("hyp")), 9).alias("cer"))


@query()
def wer_by_item(spark, sf_dir):
    return evaluation.error_rates(scored_pairs(spark, sf_dir)).select("slug", "hits", "substitutions", "deletions", "insertions", F.round("wer", 9).alias("wer"))


@query(f"SELECT count(*) AS n, round(avg(levenshtein(ref, hyp) / length(ref)), 9) AS mean, round(median(levenshtein(ref, hyp) / length(ref)), 9) AS middle FROM ({PAIRS})")
def corpus_error_rates(spark, sf_dir):
    return scored_pairs(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(evaluation.cer(F.col("ref"), F.col("hyp"))), 9).alias("mean"), F.round(F.median(evaluation.cer(F.col("ref"), F.col("hyp"))), 9).alias("middle"))


@query("""
WITH g AS (SELECT o_custkey AS k, p_name AS name FROM orders JOIN part ON p_partkey = o_orderkey % (SELECT count(*) FROM part)), f AS (SELECT o_custkey AS k, string_split(p_name, ' ')[2] AS found FROM orders JOIN part ON p_partkey = (o_orderkey + 1) % (SELECT count(*) FROM part)),
t AS (SELECT k, count(DISTINCT name) AS tp FROM g JOIN f USING (k) WHERE contains(name, found) OR contains(found, name) GROUP BY k), a AS (SELECT g.k, g.n AS ng, f.n AS nf FROM (SELECT k, count(*) AS n FROM g GROUP BY k) g LEFT JOIN (SELECT k, count(*) AS n FROM f GROUP BY k) f USING (k))
SELECT a.k, coalesce(tp, 0) AS tp, round(coalesce(tp, 0) / nf, 9) AS precision, round(coalesce(tp, 0) / ng, 9) AS recall, CASE WHEN coalesce(tp, 0) = 0 THEN 0.0 ELSE round(2 * (tp / nf) * (tp / ng) / (tp / nf + tp / ng), 9) END AS f1 FROM a LEFT JOIN t ON a.k = t.k
""")
def entity_f1(spark, sf_dir):
    o, p = table(spark, sf_dir, "orders"), table(spark, sf_dir, "part")
    n = p.count()
    gold = o.join(p, F.col("p_partkey") == F.col("o_orderkey") % n).select(F.col("o_custkey").alias("k"), F.col("p_name").alias("name"))
    found = o.join(p, F.col("p_partkey") == (F.col("o_orderkey") + 1) % n).select(F.col("o_custkey").alias("k"), F.element_at(F.split("p_name", " "), 2).alias("name"))
    s = evaluation.entity_scores(gold, found, "k")
    return s.select("k", "tp", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"), F.round("f1", 9).alias("f1"))


@query(rf"""
WITH f AS (SELECT conv_id, turn, list_filter(string_split(regexp_replace(text, '\n', ' ', 'g'), '. '), lambda s: trim(s) <> '')[1] AS fact FROM conversations), n AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) FILTER (WHERE role = 'assistant') AS note FROM conversations GROUP BY conv_id),
j AS (SELECT f.conv_id, coalesce(contains(trim(regexp_replace(regexp_replace(lower(coalesce(note, '')), '{PUNCT}', '', 'g'), '\s+', ' ', 'g')), trim(regexp_replace(regexp_replace(lower(fact), '{PUNCT}', '', 'g'), '\s+', ' ', 'g'))), false) AS hit FROM f JOIN n USING (conv_id) WHERE fact IS NOT NULL)
SELECT conv_id, count(*) FILTER (WHERE hit) AS found, count(*) AS total, round(count(*) FILTER (WHERE hit) / count(*), 9) AS recall FROM j GROUP BY conv_id
""")
def fact_recall(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    first = F.try_element_at(F.filter(F.split(F.regexp_replace("text", r"\n", " "), r"\. "), lambda s: F.trim(s) != ""), F.lit(1))
    facts = c.select("conv_id", first.alias("fact")).where("fact is not null")
    said = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("role") == "assistant", F.struct("turn", "text")))), lambda x: x["text"]), " ")
    s = evaluation.fact_recall(facts, c.groupBy("conv_id").agg(said.alias("note")), "conv_id")
    return s.select("conv_id", "found", "total", F.round("recall", 9).alias("recall"))


@query("""
WITH m AS (SELECT event_type AS metric, round(avg(value) FILTER (WHERE event_id % 2 = 0), 6) AS current, round(avg(value) FILTER (WHERE event_id % 2 = 1), 6) AS baseline FROM events GROUP BY event_type)
SELECT metric, current, baseline, NOT CASE WHEN metric IN ('error', 'view') THEN current > baseline ELSE current < baseline END AS passed FROM m
""")
def quality_gate(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    half = lambda k: e.where(F.col("event_id") % 2 == k).groupBy(F.col("event_type").alias("metric")).agg(F.round(F.avg("value"), 6).alias("value"))
    return evaluation.gate(half(0), half(1), ["error", "view"])


@query(f"""
WITH d AS (SELECT doc_id, text, len({words_sql("text")}) AS n FROM documents), l AS (SELECT doc_id, CASE WHEN trim(text) = '' THEN ['EMPTY_TRANSCRIPT'] ELSE [] END || CASE WHEN trim(text) <> '' AND n < 25 THEN ['SHORT_TRANSCRIPT'] ELSE [] END || CASE WHEN regexp_matches(text, '(?i)\\[(?:unclear|inaudible)\\]') THEN ['UNCLEAR_AUDIO_MARKERS'] ELSE [] END
 || CASE WHEN len(list_distinct(list_filter({words_sql("text")}, lambda w: length(w) >= 12 AND length(regexp_replace(w, '[^aeiou]', '', 'g')) <= greatest(1, length(w) // 5)))) >= 2 THEN ['SUSPECT_ASR_TOKENS'] ELSE [] END AS codes FROM d)
SELECT doc_id, array_to_string(codes, ',') AS codes, CASE WHEN list_contains(codes, 'EMPTY_TRANSCRIPT') THEN 'failing' WHEN list_contains(codes, 'SHORT_TRANSCRIPT') OR list_contains(codes, 'UNCLEAR_AUDIO_MARKERS') OR list_contains(codes, 'SUSPECT_ASR_TOKENS') THEN 'degraded' ELSE 'healthy' END AS overall FROM l
""")
def health_flags(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", evaluation.transcript_flags(F.col("text")).alias("f"))
    return d.select("doc_id", F.array_join(F.transform("f", lambda x: x["code"]), ",").alias("codes"), evaluation.overall(F.col("f")).alias("overall"))


@query("""
WITH u AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS linked, count(*) FILTER (WHERE event_type = 'error') AS unlinked FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN linked = 0 AND unlinked / greatest(linked + unlinked, 1) >= 0.6 THEN 'HIGH_UNLINKED_RATE' WHEN unlinked / greatest(linked + unlinked, 1) >= 0.35 THEN 'PARTIAL_UNLINKED' ELSE '' END AS codes FROM u
""")
def link_rate_flags(spark, sf_dir):
    u = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("linked"), F.count_if(F.col("event_type") == "error").alias("unlinked"))
    return u.select("user_id", F.array_join(F.transform(evaluation.link_flags(F.col("linked"), F.col("unlinked")), lambda x: x["code"]), ",").alias("codes"))


STAGES = ["view", "click", "signup", "purchase", "error"]


@query("""
SELECT event_type AS stage, count(*) AS n, round(avg(ms), 6) AS mean, round(median(ms), 6) AS p50, max(ms) AS max FROM (SELECT user_id, event_type, sum(value) AS ms FROM events GROUP BY ALL) GROUP BY event_type
""")
def stage_latency_summary(spark, sf_dir):
    """One wide report a user, unpivoted and summed up by stage."""
    wide = table(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", STAGES).agg(F.sum("value"))
    s = evaluation.stage_summary(wide, STAGES)
    return s.select("stage", "n", F.round("mean", 6).alias("mean"), F.round("p50", 6).alias("p50"), F.round("max", 9).alias("max"))


@query("""
WITH w AS (SELECT user_id, sum(value) FILTER (WHERE event_type = 'view') AS a, sum(value) FILTER (WHERE event_type = 'click') AS b, sum(value) FILTER (WHERE event_type = 'signup') AS c, sum(value) FILTER (WHERE event_type = 'purchase') AS d, sum(value) FILTER (WHERE event_type = 'error') AS e FROM events GROUP BY user_id)
SELECT user_id, round(coalesce(a, 0) + coalesce(b, 0) + greatest(coalesce(c, 0), coalesce(d, 0)) + coalesce(e, 0), 6) AS critical FROM w
""")
def critical_path(spark, sf_dir):
    w = table(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", STAGES).agg(F.sum("value"))
    return w.select("user_id", F.round(evaluation.critical_path(*map(F.col, STAGES)), 6).alias("critical"))


@query("""
SELECT doc_id, CASE WHEN regexp_matches(lower(substr(text, 1, 1000)), 'the |of ') THEN CASE WHEN regexp_matches(lower(substr(text, 1, 1000)), ' der | die ') THEN 'english,german' ELSE 'english' END WHEN regexp_matches(lower(substr(text, 1, 1000)), ' der | die ') THEN 'german' ELSE 'general' END AS domains FROM documents
""")
def domain_keywords(spark, sf_dir):
    found = routing.detected_domains(F.col("text"), {"english": ["the ", "of "], "german": [" der ", " die "]})
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(found, ",").alias("domains"))


@query("""
SELECT doc_id, (contains(lower(text), 'give') OR false) AS has_give FROM documents
""")
def keyword_scan(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.contains(F.lower("text"), F.lit("give")).alias("has_give"))


@query("""
WITH w AS (SELECT doc_id, lang, len(string_split(text, ' ')) AS n FROM documents) SELECT lang, doc_id, n::INTEGER AS n FROM w QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, doc_id) <= 10
""")
def longest_by_language(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("lang", "doc_id", F.size(F.split("text", " ")).alias("n"))
    return relational.top_per_key(d, ["lang"], 10, F.desc("n"), F.asc("doc_id")).drop("rank")
