"""Queries over the driver's tables, one for each operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, fill_in_middle, html_text, huffman, ngram_join, packing, personal_data, quality, resharding, source_audit, tokens, tool_calls, toxicity
from .store import Scratch, table


def op1_ngram_join(spark, sf_dir):
    return ngram_join.report(table(spark, sf_dir, "documents"))


def op2_tool_calls(spark, sf_dir):
    return tool_calls.link(tool_calls.from_turns(table(spark, sf_dir, "conversations")))


def op3_resharding(spark, sf_dir):
    return resharding.report(table(spark, sf_dir, "documents"))


def op4_toxicity(spark, sf_dir):
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op6_decontamination(spark, sf_dir):
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_html_text(spark, sf_dir):
    return html_text.report(table(spark, sf_dir, "pages"))


def op8_token_ids(spark, sf_dir):
    return huffman.report(table(spark, sf_dir, "documents"))


def op9_quality(spark, sf_dir):
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_source_audit(spark, sf_dir):
    return source_audit.report(table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark, sf_dir):
    return fill_in_middle.report(table(spark, sf_dir, "documents"))


def op13_personal_data(spark, sf_dir):
    return personal_data.report(table(spark, sf_dir, "documents"))


def personal_data_base(spark, sf_dir):
    """Op 13 without the spans that its method adds: SQL can express these."""
    return personal_data.report(table(spark, sf_dir, "documents")).drop("spans")


# Laws that results keep where SQL can't make the results themselves: one row each, of counts and whether all holds.


def resharding_laws(spark, sf_dir):
    """No row is lost, slots are gapless, shards are even up to the largest row."""
    found = resharding.report(table(spark, sf_dir, "documents"))
    shards = found.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.max("size").alias("largest"), F.max("slot").alias("last"), F.min("slot").alias("first"), F.count_distinct("slot").alias("slots"))
    gapless = F.bool_and((F.col("first") == 0) & (F.col("last") == F.col("n") - 1) & (F.col("slots") == F.col("n")))
    return shards.agg(F.sum("n").alias("n_docs"), F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("shards"), gapless.alias("gapless"), (F.max("bytes") - F.min("bytes") <= F.max("largest")).alias("even"))


def packing_laws(spark, sf_dir):
    """Every document is there whole, pieces and places are gapless, no sequence is too long, waste is under 1 %."""
    found = Scratch(spark, "packing-laws").save(packing.pack(table(spark, sf_dir, "documents")), "packed")
    docs = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("piece").alias("last"), F.sum("length").alias("tokens"), F.sum(F.when(F.col("piece") == 0, F.col("length"))).alias("head"), F.max(F.col("start") + F.col("length")).alias("end"), F.count_distinct("start").alias("starts"))
    whole = docs.agg(F.count(F.lit(1)).alias("n_docs"), F.bool_and((F.col("last") == F.col("n") - 1) & (F.col("end") == F.col("tokens")) & (F.col("starts") == F.col("n")) & (F.col("tokens") == F.col("head") + (F.col("n") - 1) * packing.SEQUENCE)).alias("whole"))
    own = found.groupBy("sequence_id").agg(F.sum("length").alias("tokens"), F.max(F.col("offset") + F.col("length")).alias("end"), F.min("offset").alias("first"), F.count(F.lit(1)).alias("n"), F.count_distinct("offset").alias("offsets"))
    fits = own.agg(F.bool_and((F.col("tokens") <= packing.SEQUENCE) & (F.col("end") == F.col("tokens")) & (F.col("first") == 0) & (F.col("offsets") == F.col("n"))).alias("fits"), (F.count(F.lit(1)) * packing.SEQUENCE * 0.99 <= F.sum("tokens") + packing.SEQUENCE).alias("full"))
    return whole.crossJoin(fits)  # one row each


def token_file_laws(spark, sf_dir):
    """Documents stand in ascending order, each right after the one before, and the codes are a full prefix code."""
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "token-laws")
    huffman.write(docs, scratch.path("file"), tokens.vocabulary("word_bpe_49k.json"), False, 1)
    found = scratch.save(huffman.read(spark, scratch.path("file")), "found")
    ends = found.select((F.col("start") + F.col("n_tokens")).alias("start"), F.col("doc_id").alias("before"))
    joined = found.join(ends, "start", "left").agg(F.count(F.lit(1)).alias("n_docs"), F.count("before").alias("n_followers"), F.bool_and(F.col("before").isNull() | (F.col("before") < F.col("doc_id"))).alias("ascending"), F.min("start").alias("first"))
    kraft = spark.read.parquet(scratch.path("file") + "/codes").agg((F.round(F.sum(F.pow(F.lit(2.0), -F.col("length").cast("double"))), 9) == 1.0).alias("full_code"))
    return joined.crossJoin(kraft)  # one row each


def _held_out(report, label: str, least: float):
    def laws(spark, sf_dir):
        known = table(spark, sf_dir, "labels")
        found = report(table(spark, sf_dir, "documents"), known).join(known.select("doc_id", F.col(label).alias("y")), "doc_id", "left")
        right = (F.col("predicted") == F.col("y")).cast("double")
        shares = [F.avg(F.when(F.col("held_out") & (F.col("y") == y), right)) for y in (0, 1)]
        precise = F.avg(F.when(F.col("held_out") & F.col("y").isNotNull() & (F.col("predicted") == 1), right))
        return found.agg(F.count(F.lit(1)).alias("n_docs"), F.bool_and(F.col("score").between(0, 1)).alias("in_range"), F.count("y").alias("labelled"), ((shares[0] + shares[1]) / 2 >= least).alias("accurate"), (precise >= least).alias("precise"))

    laws.__doc__ = f"Scores lie in 0 to 1; of held-out labelled rows at least {least:.0%} of each label, on average of the two, are told right (one answer for all: 50 %), and as many of those told 1 are."
    return laws


toxicity_held_out = _held_out(toxicity.report, "toxic", 0.75)
quality_held_out = _held_out(quality.report, "quality", 0.75)

CHECKS = {"resharding_laws": resharding_laws, "packing_laws": packing_laws, "token_file_laws": token_file_laws, "toxicity_held_out": toxicity_held_out, "quality_held_out": quality_held_out, "personal_data_base": personal_data_base}

QUERIES = {f.__name__: f for f in (op1_ngram_join, op2_tool_calls, op3_resharding, op4_toxicity, op5_exact_dedup, op6_decontamination, op7_html_text, op8_token_ids, op9_quality, op10_packing, op11_source_audit, op12_fill_in_middle, op13_personal_data)}

ORACLES = {
    "op1_ngram_join": r"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
            ELSE list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) END) AS shingle FROM d),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
        e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * c >= 80 * (x.n + y.n - c)),
        r AS (SELECT doc_id AS v, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON r.v = e.a)
        SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.root) AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.v = d.doc_id GROUP BY d.doc_id""",
    "op2_tool_calls": r"""
        WITH RECURSIVE t AS (SELECT conv_id, turn::BIGINT AS turn, role, text, len(regexp_extract_all(text, '[^ \n\t\r]+')) AS words FROM conversations),
        c AS (SELECT *, EXISTS (SELECT 1 FROM t s WHERE s.conv_id = t.conv_id AND s.role = 'system') AS has_schema, EXISTS (SELECT 1 FROM t n WHERE n.conv_id = t.conv_id AND n.turn = t.turn + 1 AND n.role NOT IN ('assistant', 'system')) AS answered FROM t WHERE role = 'assistant'),
        depth AS (SELECT conv_id, turn, 0 AS depth FROM c x WHERE turn % 16 < 2 OR NOT EXISTS (SELECT 1 FROM c y WHERE y.conv_id = x.conv_id AND y.turn = x.turn - 2)
            UNION ALL SELECT c.conv_id, c.turn, depth + 1 FROM depth JOIN c ON c.conv_id = depth.conv_id AND c.turn = depth.turn + 2 WHERE c.turn % 16 >= 2),
        results AS (SELECT t.*, d.depth FROM t LEFT JOIN depth d ON d.conv_id = t.conv_id AND d.turn = t.turn - 1 WHERE role NOT IN ('assistant', 'system') AND t.turn > 0)
        SELECT conv_id, turn, 0::INTEGER AS item, 'message' AS kind, NULL AS call_id, turn AS anchor_turn, 0::INTEGER AS anchor_item, 0::INTEGER AS depth, false AS linked, true AS valid, NULL AS problem,
            '{"content":' || coalesce(to_json(text)::VARCHAR, 'null') || ',"role":' || to_json(role)::VARCHAR || ',"turn":' || turn || '}' AS json FROM t WHERE role IN ('assistant', 'system') OR turn = 0
        UNION ALL SELECT c.conv_id, c.turn, 1, 'call', 'c' || c.turn, c.turn, 1, depth.depth, answered, NOT (has_schema AND words < 12), CASE WHEN has_schema AND words < 12 THEN '$.words: minimum' END,
            '{"arguments":{"turn":' || c.turn || ',"words":' || words || '},"id":"c' || c.turn || '","name":"reply","role":"assistant","turn":' || c.turn || '}' FROM c JOIN depth USING (conv_id, turn)
        UNION ALL SELECT conv_id, turn, 0, 'result', 'c' || (turn - 1), CASE WHEN depth IS NULL THEN turn ELSE turn - 1 END, CASE WHEN depth IS NULL THEN 0 ELSE 1 END, coalesce(depth, 0), depth IS NOT NULL, depth IS NOT NULL, CASE WHEN depth IS NULL THEN 'no call' END,
            '{"content":' || coalesce(to_json(text)::VARCHAR, 'null') || ',"role":' || to_json(role)::VARCHAR || ',"tool_call_id":"c' || (turn - 1) || '","turn":' || turn || '}' FROM results""",
    "op5_exact_dedup": """
        WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
        FROM d""",
    "op6_decontamination": r"""
        WITH bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        win AS (SELECT DISTINCT item_id, least(13, len(w)) AS k, unnest(list_transform(generate_series(1, greatest(1, len(w) - 12)), lambda i: array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' '))) AS win FROM bw WHERE len(w) > 0),
        dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        ks AS (SELECT DISTINCT k FROM win),
        pos AS (SELECT doc_id, k, w, unnest(generate_series(1, len(w) - k + 1)) AS i FROM dw, ks WHERE len(w) >= k),
        hits AS (SELECT p.doc_id, p.i, p.k, win.item_id FROM (SELECT doc_id, i, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS win FROM pos) p JOIN win ON p.k = win.k AND p.win = win.win),
        covered AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS j FROM hits) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
        SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op7_html_text": r"""
        WITH a AS (SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '\s+', ' ', 'g') AS x FROM pages),
        b AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '</?b>', '', 'g'), '</?(p|h1)>', chr(10), 'g') AS x FROM a),
        c AS (SELECT page_id, url, regexp_replace(replace(replace(replace(x, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g') AS x FROM b),
        d AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(x, ' +', ' ', 'g'), ' *\n[ \n]*', chr(10), 'g'), chr(10) || ' ') AS text FROM c)
        SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM d""",
    "op11_source_audit": r"""
        WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
        g AS (SELECT DISTINCT lang, source FROM d),
        df AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM d) GROUP BY ALL HAVING count(*) >= 10),
        c AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(w) AS term FROM d) JOIN df USING (lang, term) GROUP BY ALL),
        v AS (SELECT lang, count(*) AS v FROM df GROUP BY lang),
        gn AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
        ln AS (SELECT lang, sum(n) AS total FROM c GROUP BY lang),
        p AS (SELECT gn.lang, gn.source, df.term, coalesce(c.n, 0) AS n, (1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (gn.total + 2 * v.v))::BIGINT AS p FROM gn JOIN df USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = df.term),
        q AS (SELECT df.lang, df.term, (1 + (1000000000::HUGEINT * (sum(c.n) + 2)) // (any_value(ln.total) + 2 * any_value(v.v)))::BIGINT AS q FROM df JOIN v USING (lang) JOIN ln USING (lang) JOIN c USING (lang, term) GROUP BY ALL),
        pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce((SELECT sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
        term AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
        SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
        WHERE part = 'pair' OR rank <= 10""",
    "op12_fill_in_middle": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS h FROM documents),
        u AS (SELECT *, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
        k AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b, CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
        o AS (SELECT *, substring(text, 1, a) AS pre, substring(text, a + 1, b - a) AS mid, substring(text, b + 1) AS suf FROM k)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN concat('<P>', pre, '<S>', suf, '<M>', mid) ELSE concat('<S>', suf, '<P>', pre, '<M>', mid) END) AS output_sha256, sha256(text) AS restored_sha256 FROM o""",
    "personal_data_base": r"""
        WITH k(ord, kind, re) AS (VALUES (0, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+'), (1, 'ip', '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+'), (2, 'card', '[0-9](?:[ -]?[0-9])+'), (3, 'phone', '\+[0-9][ ().0-9-]+[0-9]')),
        m AS (SELECT doc_id, ord, kind, regexp_extract_all(coalesce(text, ''), re) AS found, list_transform(regexp_split_to_array(coalesce(text, ''), re), lambda x: length(x)) AS gaps FROM documents CROSS JOIN k),
        s AS (SELECT doc_id, ord, kind, found[i] AS hit, list_sum(gaps[1:i]) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS start FROM (SELECT *, unnest(generate_series(1, len(found))) AS i FROM m WHERE len(found) > 0)),
        t AS (SELECT *, regexp_replace(hit, '[^0-9]', '', 'g') AS digits FROM s),
        luhn AS (SELECT *, list_sum(list_transform(generate_series(1, length(digits)), lambda j: CASE WHEN j % 2 = 1 THEN digits[length(digits) + 1 - j]::INT ELSE (digits[length(digits) + 1 - j]::INT * 2) // 10 + (digits[length(digits) + 1 - j]::INT * 2) % 10 END)) AS total FROM t),
        b AS (SELECT doc_id, ord, kind, start, start + length(hit) AS stop FROM luhn WHERE CASE kind WHEN 'email' THEN true WHEN 'ip' THEN list_bool_and(list_transform(string_split(hit, '.'), lambda x: x::HUGEINT <= 255)) WHEN 'card' THEN length(digits) BETWEEN 14 AND 19 AND total % 10 = 0 ELSE length(digits) BETWEEN 10 AND 15 END)
        SELECT d.doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
            sha256(coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord), '')) AS base_sha256 FROM documents d LEFT JOIN b USING (doc_id) GROUP BY d.doc_id""",
    "resharding_laws": "SELECT count(*) AS n_docs, sum(strlen(coalesce(text, '')) + 1)::BIGINT AS bytes, 16::BIGINT AS shards, true AS gapless, true AS even FROM documents",
    "packing_laws": 'SELECT count(*) AS n_docs, true AS whole, true AS fits, true AS "full" FROM documents',
    "token_file_laws": "SELECT count(*) AS n_docs, count(*) - 1 AS n_followers, true AS ascending, 0::BIGINT AS first, true AS full_code FROM documents",
    "toxicity_held_out": "SELECT count(*) AS n_docs, true AS in_range, count(toxic) AS labelled, true AS accurate, true AS precise FROM documents LEFT JOIN labels USING (doc_id)",
    "quality_held_out": "SELECT count(*) AS n_docs, true AS in_range, count(quality) AS labelled, true AS accurate, true AS precise FROM documents LEFT JOIN labels USING (doc_id)",
}
