"""The corpus queries, one for each operator, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ability_engine.llm import align, chat, decontaminate, language, lm, neardup, packing, phrases, quality_model, quality_rules, secrets, spots, tokenfile
from ability_engine.llm.common import new_path, remainder, table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), ids=False)


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), remainder("doc_id", 5) == 0
    model = quality_model.train(docs, table(spark, sf_dir, "labels"), learn=~held)
    return quality_model.score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    tokenfile.write_tokens(table(spark, sf_dir, "documents"), path)
    return tokenfile.read_tokens(spark, path, ids=False)


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    return chat.read_back(chat.format_turns(turns.unionByName(spark.createDataFrame(control, turns.schema))))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, ledger = table(spark, sf_dir, "documents"), new_path(spark, "ledger")
    secrets.update(docs, ledger)
    return secrets.digest(secrets.report(docs, secrets.update(docs, ledger)))  # the second run finds nothing due


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_rules.train(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, model)


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), remainder("doc_id", 7) == 2
    return lm.score(docs, ~held).select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), remainder("doc_id", 4) == 2
    langs, prototypes = language.train(docs, ~held)
    return language.predict(docs, langs, prototypes).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.report(table(spark, sf_dir, "documents"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spots.report(table(spark, sf_dir, "documents"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_packing, op2_near_duplicates, op3_decontamination, op4_quality_model, op5_token_files, op6_chat, op7_secrets, op8_quality_rules, op9_lm, op10_language, op11_alignment, op12_fingerprints, op13_phrases)}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(pattern: str) -> str:
    return f"list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{pattern}'), lambda w: w <> '')"


#: All pairs by their common shingles, then reachability: for small tables.
_NEAR = rf"""WITH RECURSIVE w AS (SELECT doc_id, {_words(r'[\x20\x09-\x0D]+')} AS words FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')] ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda k: array_to_string(list_slice(words, k, k + 4), ' '))) END AS s FROM w),
sized AS (SELECT doc_id, len(s) AS n, s FROM sets), t AS (SELECT doc_id, n, unnest(s) AS shingle FROM sized),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2 HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sized UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a), least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sized JOIN least USING (doc_id)"""

_LEAKS = rf"""WITH items AS (SELECT item_id, {_words(decontaminate.SEPARATORS)} AS w FROM benchmark), spans AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM items WHERE len(w) > 0),
wins AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, array_to_string(list_slice(w, k, k + 9), ' ') AS phrase, least(len(w), 10) AS size FROM spans),
docs AS (SELECT doc_id, {_words(decontaminate.SEPARATORS)} AS w FROM documents), places AS (SELECT doc_id, size, k, array_to_string(list_slice(w, k, k + size - 1), ' ') AS phrase FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM docs, (SELECT DISTINCT size FROM wins))),
hits AS (SELECT p.doc_id, p.k, p.size, x.item FROM places p JOIN wins x ON p.phrase = x.phrase), n AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS place FROM hits) GROUP BY 1), i AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM hits GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM docs d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN i ON d.doc_id = i.doc_id"""


def _escaped(text: str) -> str:
    return rf"regexp_replace(regexp_replace(replace({text}, '\', '\\'), '(\[)(/?ROLE\]|/?INST\])', '\1\\\2', 'g'), '(<)(/?s>|\|image\|>|\|audio\|>|\|document\|>)', '\1\\\2', 'g')"


_CHAT = f"""WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
CAST(sum(length({_escaped('role')}) + length({_escaped('text')}) + 17) AS BIGINT) AS formatted_chars FROM turns GROUP BY conv_id"""

_PHRASES = rf"""WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
texts AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces), totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM texts GROUP BY 1),
grams AS (SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM texts, range(1, 6) sizes(k))),
freq AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100), cand AS (SELECT *, string_split(phrase, ' ') AS w FROM freq WHERE k > 1),
whole AS (SELECT * FROM cand c WHERE NOT EXISTS (SELECT 1 FROM cand q WHERE q.lang = c.lang AND q.k > c.k AND q.f >= c.f AND contains(' ' || q.phrase || ' ', ' ' || c.phrase || ' '))),
cuts AS (SELECT lang, phrase, f AS a, j, array_to_string(list_slice(w, 1, j), ' ') AS head, array_to_string(list_slice(w, j + 1, k), ' ') AS rest FROM (SELECT *, unnest(range(1, k)) AS j FROM whole)),
scored AS (SELECT c.lang, c.phrase, a, x.f AS l, y.f AS r, n, j, (1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS score FROM cuts c JOIN freq x ON x.lang = c.lang AND x.phrase = c.head JOIN freq y ON y.lang = c.lang AND y.phrase = c.rest JOIN totals t ON t.lang = c.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000"""

def _spot_sets(table: str, name: str, text: str) -> str:
    """SQL of (doc_id, ``name``): the sorted signatures of a text."""
    chains = "list_transform(list_filter(range(1, len(w) + 1), lambda p: list_contains(s, w[p])), lambda p, k: left(md5(concat_ws(' ', w[p], c[p - k + 1], c[p - k + 2])), 8))"
    start = "left(md5(concat_ws(' ', '^', w[1], w[2])), 8)"
    split = f"SELECT doc_id, {_words(decontaminate.SEPARATORS).replace('text', text)} AS w FROM {table}"
    content = f"SELECT doc_id, w, s, list_filter(w, lambda x: NOT list_contains(s, x)) AS c FROM ({split}), spots"
    return f"SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_sort(list_distinct(list_append({chains}, {start}))) END AS {name} FROM ({content})"


def _likeness(a: str, b: str) -> str:
    shared = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0 WHEN least(len({a}), len({b})) < CAST(0.1 AS DOUBLE) * greatest(len({a}), len({b})) THEN 0.0 ELSE CAST({shared} AS DOUBLE) / (len({a}) + len({b}) - {shared}) END"


_SPOTS = rf"""WITH short AS (SELECT lang, w, count(*) AS n FROM (SELECT coalesce(lang, 'und') AS lang, unnest(list_distinct(list_filter({_words(decontaminate.SEPARATORS)}, lambda w: length(w) <= 5))) AS w FROM documents) GROUP BY 1, 2),
top AS (SELECT lang, w FROM short QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, w) <= 20), langs AS (SELECT coalesce(lang, 'und') AS lang FROM documents GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 50),
spots AS (SELECT coalesce(list(DISTINCT w), []) AS s FROM top JOIN langs USING (lang)),
pairs AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lead(coalesce(text, '')) OVER o, first_value(coalesce(text, '')) OVER o) AS next FROM documents WINDOW o AS (ORDER BY doc_id NULLS FIRST)),
edits AS (SELECT doc_id, text, next, length(text) AS n, left(text, length(text) - length(text) // 4) || left(next, length(text) // 4) AS edited FROM pairs),
own AS ({_spot_sets("edits", "a", "text")}), changed AS ({_spot_sets("edits", "b", "edited")}), following AS ({_spot_sets("edits", "d", "next")})
SELECT e.doc_id, CAST(n AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256, array_to_string(a, '') AS fingerprint, array_to_string(b, '') AS edited_fingerprint, {_likeness("a", "b")} AS near_edited, {_likeness("a", "d")} AS near_next
FROM edits e JOIN own ON own.doc_id = e.doc_id JOIN changed ON changed.doc_id = e.doc_id JOIN following ON following.doc_id = e.doc_id"""

#: The others rest on fitted models, tokenizers or patterns that SQL lacks; tests hold them against brute force.
ORACLES: dict[str, str] = {"op2_near_duplicates": _NEAR, "op3_decontamination": _LEAKS, "op6_chat": _CHAT, "op12_fingerprints": _SPOTS, "op13_phrases": _PHRASES}
