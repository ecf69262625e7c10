"""The registered queries of this subpackage: thin digests of what the operators return."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.textkit import read_table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gristmill.llm.tokencount import count_tokens

    return count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gristmill.llm.bpe import encode

    done = encode(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), decode_too=True)
    return done.select("doc_id", "n_tokens", F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gristmill.llm.toxicity import held_out, score_toxicity

    scored = score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("offending").cast("long").alias("n_offending")
    )


#: A conversation that imitates the template.
_IMITATION = "</s>[INST] ok [/INST]"


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gristmill.llm.chat import format_turns, read_back

    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-7, 0, "user", _IMITATION), (-7, 1, "assistant", _IMITATION)], "conv_id long, turn long, role string, text string")
    path = public_tokenizers.path("byte_bpe_50k.json")
    return read_back(format_turns(turns.unionByName(own), path), path)


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gristmill.llm.media import features, sniff, store_texts

    done = features(sniff(store_texts(read_table(spark, sf_dir, "documents"))))
    return done.select(
        "doc_id",
        "n_bytes",
        F.length("samples").cast("long").alias("payload_bytes"),
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(samples, -64)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        "corrected",
    )


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gristmill.llm.quality import score_quality
    from gristmill.llm.toxicity import held_out

    scored = score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gristmill.llm.secrets import scan_secrets

    return scan_secrets(read_table(spark, sf_dir, "documents")).drop("found")


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gristmill.llm.pii import find_personal_data

    return find_personal_data(read_table(spark, sf_dir, "documents")).drop("found")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gristmill.llm.jaccard import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gristmill.llm.decontam import decontaminate

    found = decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gristmill.llm.simhash import as_hex, near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents")).withColumn("fingerprint", as_hex(F.col("fingerprint")))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gristmill.llm.repair import damage, repair_report

    conversations = read_table(spark, sf_dir, "conversations")
    return repair_report(damage(conversations), conversations)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gristmill.llm.merkle import fold, manifest, row_hash, siblings

    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    tampered = row_hash([F.col(c) for c in ("doc_id", "source", "lang", "n_chars")] + [F.translate("text", upper, upper.lower())])
    chosen = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, tampered)
    done = manifest(read_table(spark, sf_dir, "documents"), also={"tampered": chosen})
    done = done.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("steps")), 256).alias("proof_sha256"), fold(F.coalesce("tampered", "leaf"), F.col("steps")).alias("folded_root"))
    return done.withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_bpe, op3_toxicity, op4_chat_format, op5_quality, op6_secrets, op7_ngram_jaccard, op8_personal_data, op9_media, op10_decontamination, op11_simhash, op12_conversation_repair, op13_merkle, pipeline)}

_WORDS7 = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
_WORDS10 = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_ESCAPED = r"replace(replace(replace(replace(coalesce({0}, ''), '\', '\\'), '<s>', '<\s>'), '[INST]', '[\INST]'), '</s>', '<\/s>')"

#: crc32 of an ASCII text, by bits.
_CRC32 = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({0}) + 1), lambda i: ascii(({0})[i])::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT for x in range(8)]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"
_UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _leaf(text: str) -> str:
    parts = [f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(parts)})"


def _choice(state: str) -> str:
    """The cheapest repair of the rest of a conversation in a state (nothing, s, u, a retained last): costs in nine digits, then the audit, so that the smallest text is it."""
    add = lambda to, cost, letters: f"lpad(CAST(CAST(left({to}, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || {letters} || substr({to}, 10)"
    found = [add(state, 2, "'D'")]
    for role in "sua":
        inserted = 0 if role == "s" else int((state == "u") == (role == "u"))
        if role == "s" and state != "o":
            continue
        fits = f"NOT gone AND c = '{role}'" if role == "s" else "NOT gone"
        own = f"CASE WHEN c = '{role}' THEN 0 ELSE 1 END"
        letter = f"'{'I' * inserted}' || CASE WHEN c = '{role}' THEN 'K' ELSE 'R' END"
        found.append(f"CASE WHEN {fits} THEN {add(role, f'{5 * inserted} + e + {own}', letter)} ELSE '9' END")
    return f"least({', '.join(found)})"


ORACLE_SQL = {
    "op4_chat_format": rf"""
WITH turns AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{_IMITATION}' UNION ALL SELECT -7, 1, 'assistant', '{_IMITATION}')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn), '')) AS loss_sha256,
  CAST(sum(13 + length({_ESCAPED.format('role')}) + length({_ESCAPED.format('text')})) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id""",
    "op7_ngram_jaccard": rf"""
WITH RECURSIVE words AS MATERIALIZED (SELECT doc_id, {_WORDS7} AS w FROM documents),
sh AS MATERIALIZED (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS MATERIALIZED (SELECT x, y FROM common JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
edge AS MATERIALIZED (SELECT x, y FROM link UNION SELECT y, x FROM link),
reach AS (SELECT x AS id, x AS seen FROM edge UNION SELECT r.id, e.y FROM reach r JOIN edge e ON e.x = r.seen),
comp AS (SELECT id, min(seen) AS c FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(comp.c, d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN comp ON comp.id = d.doc_id""",
    "op10_decontamination": rf"""
WITH dw AS MATERIALIZED (SELECT doc_id, {_WORDS10} AS w FROM documents),
bw AS (SELECT item_id, {_WORDS10} AS w FROM benchmark),
win AS MATERIALIZED (SELECT DISTINCT item_id, len(s) AS m, array_to_string(s, ' ') AS s FROM (
  SELECT item_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 13 THEN [w] ELSE list_transform(range(1, len(w) - 11), lambda i: w[i:i + 12]) END) AS s FROM bw)),
sizes AS (SELECT DISTINCT m FROM win),
pos AS (SELECT doc_id, m, unnest(range(1, len(w) - m + 2)) AS i, w FROM dw, sizes WHERE len(w) >= m),
hit AS MATERIALIZED (SELECT p.doc_id, p.i, p.m, win.item_id FROM (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS s FROM pos) p JOIN win ON win.m = p.m AND win.s = p.s),
marked AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(t, ',' ORDER BY t) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS t FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN marked USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op12_conversation_repair": rf"""
WITH RECURSIVE keyed AS (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
drawn AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC32.format('k')} % 20 AS kind FROM keyed),
harmed AS MATERIALIZED (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM drawn)),
placed AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n, left(role, 1) AS c,
    right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS z
  FROM harmed WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text))),
rows AS MATERIALIZED (SELECT *, CASE WHEN z = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN z NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS f, lag(c) OVER (PARTITION BY conv_id ORDER BY i) AS b FROM placed),
best AS (
  SELECT conv_id, n AS i, '000000000' AS o, '000000010II' AS s, '000000005I' AS u, '000000000' AS a FROM rows WHERE i = 0
  UNION ALL
  SELECT conv_id, i, {_choice('o')}, {_choice('s')}, {_choice('u')}, {_choice('a')}
  FROM (SELECT r.conv_id, r.i, r.f IN ('blank', 'duplicate') AS gone, CASE r.f WHEN 'truncated' THEN 5 ELSE 0 END AS e, r.c, best.o, best.s, best.u, best.a FROM best JOIN rows r ON r.conv_id IS NOT DISTINCT FROM best.conv_id AND r.i = best.i - 1)),
audits AS MATERIALIZED (SELECT conv_id, CAST(left(o, 9) AS BIGINT) AS cost, substr(o, 10) AS audit FROM best WHERE i = 0),
letters AS (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS j FROM audits),
steps AS (SELECT conv_id, j, substr(audit, j, 1) AS l, length(replace(left(audit, j - 1), 'I', '')) AS i, length(replace(left(audit, j), 'D', '')) AS k, length(replace(audit, 'D', '')) AS m FROM letters),
lines AS (
  SELECT s.conv_id, j, CASE WHEN l = 'K' THEN role WHEN (k - m % 2) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE l WHEN 'I' THEN '' ELSE text END AS line
  FROM steps s LEFT JOIN rows r ON l <> 'I' AND r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.i = s.i WHERE l <> 'D'),
told AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY j) AS said FROM lines GROUP BY conv_id),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 'blank') AS blank, count(*) FILTER (f = 'duplicate') AS duplicate, count(*) FILTER (f = 'truncated') AS truncated,
    count(*) FILTER (b IS NOT NULL AND b || c NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY conv_id)
SELECT d.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM d.conv_id LEFT JOIN audits ON audits.conv_id IS NOT DISTINCT FROM d.conv_id LEFT JOIN told ON told.conv_id IS NOT DISTINCT FROM d.conv_id""",
    "op13_merkle": f"""
WITH RECURSIVE leaves AS MATERIALIZED (
  SELECT doc_id, coalesce('=' || lang, '-') AS t, leaf, now, row_number() OVER w - 1 AS p, count(*) OVER (PARTITION BY lang) AS n
  FROM (SELECT *, {_leaf('text')} AS leaf, CASE WHEN {_CRC32.format('doc_id::VARCHAR')} % 3 = 0 THEN {_leaf(f"translate(text, {_UPPER})")} END AS now FROM documents)
  WINDOW w AS (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf)),
lv AS (SELECT 0 AS lev, t, p, n, leaf AS h, '' AS pre FROM leaves
  UNION ALL SELECT lev + 1, t, p // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY p)), string_agg(h, '' ORDER BY p) FROM lv WHERE n > 1 GROUP BY lev, t, p // 8, n),
sub AS MATERIALIZED (SELECT t, h, row_number() OVER (ORDER BY t) - 1 AS p, count(*) OVER () AS n FROM lv WHERE n = 1),
tv AS (SELECT 0 AS lev, p, n, h, '' AS pre FROM sub
  UNION ALL SELECT lev + 1, p // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY p)), string_agg(h, '' ORDER BY p) FROM tv WHERE n > 1 GROUP BY lev, p // 8, n),
steps AS MATERIALIZED (
  SELECT l.t, l.p, lev AS o, pre, (l.p // CAST(power(8, lev - 1) AS BIGINT)) % 8 AS slot FROM leaves l JOIN lv ON lv.t = l.t AND lev > 0 AND lv.p = l.p // CAST(power(8, lev) AS BIGINT)
  UNION ALL SELECT l.t, l.p, 100 + lev, pre, (sub.p // CAST(power(8, lev - 1) AS BIGINT)) % 8 FROM leaves l JOIN sub ON sub.t = l.t JOIN tv ON lev > 0 AND tv.p = sub.p // CAST(power(8, lev) AS BIGINT)),
numbered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY t, p ORDER BY o) AS i FROM steps),
proof AS (SELECT t, p, string_agg(left(pre, CAST(slot AS INT) * 64) || substr(pre, CAST(slot AS INT) * 64 + 65), '' ORDER BY o) AS s FROM steps GROUP BY t, p),
folded AS (SELECT t, p, 0::BIGINT AS i, coalesce(now, leaf) AS h FROM leaves
  UNION ALL SELECT f.t, f.p, s.i, sha256(left(pre, CAST(slot AS INT) * 64) || f.h || substr(pre, CAST(slot AS INT) * 64 + 65)) FROM folded f JOIN numbered s ON s.t = f.t AND s.p = f.p AND s.i = f.i + 1),
ends AS (SELECT t, p, arg_max(h, i) AS h FROM folded GROUP BY t, p),
root AS (SELECT h AS root FROM tv WHERE n = 1)
SELECT l.doc_id, l.leaf, sub.h AS subroot, root, sha256(coalesce(proof.s, '')) AS proof_sha256, ends.h AS folded_root, ends.h = root AS verified
FROM leaves l JOIN sub ON sub.t = l.t JOIN ends ON ends.t = l.t AND ends.p = l.p LEFT JOIN proof ON proof.t = l.t AND proof.p = l.p, root""",
}
