"""Topic, text, parsing and reason queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions import columns as c
from tallyforge.functions import parsing as p
from tallyforge.operators import relational as rel
from tallyforge.operators import sampling, textmodels
from tallyforge.operators import texts as ops
from tallyforge.operators import votes as vote_ops
from tallyforge.plans import views as v
from tallyforge.plans.declare import query
from tallyforge.sources.files import table


@query("""WITH t AS (SELECT note_id, ord1, ord2, ord3, list_filter([CASE WHEN not_helpful_incorrect = 1 THEN 'Factual error' END, CASE WHEN not_helpful_missing_key_points = 1 THEN 'Missing context' END,
  CASE WHEN raw_label_id = 2 OR helpful_addresses_claim = 1 THEN 'Not misleading' END], lambda x: x IS NOT NULL) AS labels FROM votes),
u AS (SELECT note_id, ord1, ord2, ord3, CASE WHEN len(labels) = 0 THEN ['Other'] ELSE labels END AS labels FROM t)
SELECT note_id, ord1, ord2, ord3, labels[1] AS primary_topic, CAST(len(labels) AS INT) AS topic_count, concat('["', array_to_string(labels, '","'), '"]') AS all_topics_json FROM u""")
def primary_topic(spark, d):
    flags = [(F.col("not_helpful_incorrect"), "Factual error"), (F.col("not_helpful_missing_key_points"), "Missing context")]
    labels = ops.flag_topics(flags, (F.col("raw_label_id") == 2) | (F.col("helpful_addresses_claim") == 1))
    t = v.votes(spark, d).select("note_id", "ord1", "ord2", "ord3", labels.alias("labels"))
    return t.select("note_id", "ord1", "ord2", "ord3", F.col("labels")[0].alias("primary_topic"), F.size("labels").alias("topic_count"), F.to_json("labels").alias("all_topics_json"))


def _like(pattern: str) -> str:
    """A pattern for an engine without look-around: the characters beside a word are matched, too."""
    start, end = pattern.startswith(r"\b"), pattern.endswith(r"\b")
    text = ("(?:^|[^\\p{L}\\p{N}_])" if start else "") + pattern[2 * start : len(pattern) - 2 * end] + ("(?:$|[^\\p{L}\\p{N}_])" if end else "")
    return f"regexp_matches(text, '{text}', 'i')"


_HITS = {name: "(" + " OR ".join(map(_like, ps)) + ")" for name, ps in ops.TOPICS.items()}
_FIRST = " ".join(f"WHEN {hit} THEN '{name}'" for name, hit in _HITS.items())
_COUNTS = {name: " + ".join(f"CAST({_like(x)} AS INT)" for x in ps) for name, ps in ops.TOPICS.items()}
_SCORES = "concat('{', " + ", ',', ".join(f"'\"{name}\":', CAST(CAST({hit} AS INT) AS STRING)" for name, hit in _HITS.items()) + ", '}')"


@query(f"SELECT doc_id, CASE {_FIRST} ELSE 'other_misc' END AS topic FROM documents", views=False)
def semantic_topic(spark, d):
    return table(spark, d, "documents").select("doc_id", ops.semantic_topic(F.col("text")).alias("topic"))


@query(f"SELECT conv_id, turn, {_SCORES} AS scores FROM conversations", views=False)
def semantic_topic_scores(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", ops.bucket_scores(F.col("text")).alias("scores"))


@query(f"WITH n AS (SELECT doc_id, {', '.join(f'{x} AS {n}' for n, x in _COUNTS.items())} FROM documents) SELECT *, CASE WHEN greatest({', '.join(_COUNTS)}) = 0 THEN 'other_misc' {' '.join(f'WHEN {n} = greatest({", ".join(_COUNTS)}) THEN {chr(39)}{n}{chr(39)}' for n in _COUNTS)} END AS topic FROM n", views=False)
def semantic_topic_counts(spark, d):
    counts = ops.pattern_counts(F.col("text"))
    n = table(spark, d, "documents").select("doc_id", *[x.alias(k) for k, x in counts.items()])
    return n.withColumn("topic", ops.most_matched({k: F.col(k) for k in counts}))


_ENT = "regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'gis'), '<[^>]+>', ' ', 'gs')"
for _e, _ch in c.ENTITIES.items():
    _ENT = f"replace({_ENT}, '{_e}', '{_ch.replace(chr(39), chr(39) * 2)}')"


@query(f"SELECT page_id, trim(regexp_replace({_ENT}, '\\s+', ' ', 'g')) AS text FROM pages", views=False)
def strip_html(spark, d):
    return table(spark, d, "pages").select("page_id", c.strip_html(F.col("html")).alias("text"))


@query("WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS s FROM documents) SELECT doc_id, CASE WHEN length(s) <= 80 THEN s ELSE concat(substr(s, 1, 77), '...') END AS short FROM t", views=False)
def shorten_text(spark, d):
    return table(spark, d, "documents").select("doc_id", c.shorten(F.col("text"), 80).alias("short"))


@query("SELECT p_partkey, regexp_replace(regexp_replace(lower(concat(' ', p_name, ' - ', p_brand, '!')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM part", views=False)
def slugify(spark, d):
    return table(spark, d, "part").select("p_partkey", c.slugify(F.concat(F.lit(" "), F.col("p_name"), F.lit(" - "), F.col("p_brand"), F.lit("!"))).alias("slug"))


@query("SELECT conv_id, string_agg(concat('[', role, '] [C=', least(turn * 20, 100), '] ', trim(regexp_replace(text, '\\s+', ' ', 'g'))), ' [SEP] ' ORDER BY turn) AS text FROM conversations GROUP BY conv_id", views=False)
def rationale_text(spark, d):
    squeezed = F.trim(F.regexp_replace("text", r"\s+", " "))
    piece = F.format_string("[%s] [C=%d] %s", F.col("role"), F.least(F.col("turn") * 20, F.lit(100)), squeezed)
    return vote_ops.ordered_text(table(spark, d, "conversations"), piece, ["turn"], "conv_id")


_WRAPPED = "concat('Reply: ', raw_completion, ' Done.')"
_V = "replace(replace(upper(trim(coalesce(level, ''))), '-', '_'), ' ', '_')"


@query(f"""WITH blobs AS (SELECT vote_id, {_WRAPPED} AS raw, regexp_extract({_WRAPPED}, '\\{{.*\\}}', 0, 's') AS blob FROM replies), fields AS (SELECT vote_id, upper(raw) AS r, json_extract_string(blob, '$.helpfulnessLevel') AS level, json_extract_string(blob, '$.agree') AS agree, TRY_CAST(json_extract_string(blob, '$.confidence') AS DOUBLE) AS conf FROM blobs),
named AS (SELECT *, {_V} AS v, upper(trim(coalesce(agree, ''))) AS yn FROM fields),
rated AS (SELECT *, CASE WHEN v IN ('HELPFUL', 'CURRENTLY_RATED_HELPFUL') THEN 'HELPFUL' WHEN v IN ('NOT_HELPFUL', 'NOTHELPFUL', 'CURRENTLY_RATED_NOT_HELPFUL') THEN 'NOT_HELPFUL' WHEN contains(v, 'SOMEWHAT') OR contains(v, 'PARTLY') OR contains(v, 'PARTIALLY') OR contains(r, 'SOMEWHAT') THEN 'SOMEWHAT_HELPFUL'
  WHEN contains(r, 'NOT_HELPFUL') OR contains(r, 'NOT HELPFUL') THEN 'NOT_HELPFUL' WHEN contains(r, 'HELPFUL') THEN 'HELPFUL' ELSE 'UNKNOWN' END AS rating FROM named)
SELECT vote_id, rating, CAST(CASE rating WHEN 'HELPFUL' THEN 1 WHEN 'SOMEWHAT_HELPFUL' THEN 0.5 WHEN 'NOT_HELPFUL' THEN 0 ELSE -1 END AS DOUBLE) AS score, CASE WHEN yn IN ('YES', 'Y', 'TRUE', '1') THEN 1 WHEN yn IN ('NO', 'N', 'FALSE', '0') THEN 0 ELSE -1 END AS agree,
  CASE WHEN yn IN ('YES', 'Y', 'TRUE', '1') THEN 1 WHEN yn IN ('NO', 'N') THEN 0 ELSE -1 END AS agree_compat, CASE WHEN conf IS NULL OR isnan(conf) THEN -1 ELSE CAST(least(greatest(round_even(conf, 0), 0), 100) AS INT) END AS confidence FROM rated""")
def parse_votes(spark, d):
    raw = F.concat(F.lit("Reply: "), F.col("raw_completion"), F.lit(" Done."))
    # the object is cut out and parsed once; a projection of its own keeps Spark from repeating that per field
    parsed = v.replies(spark, d).select("vote_id", "raw_completion", F.from_json(p.json_blob(raw), "helpfulnessLevel string, agree string, confidence string").alias("f")).where("vote_id IS NOT NULL")
    agree = F.col("f.agree")
    rating = p.rating(F.col("f.helpfulnessLevel"), F.col("raw_completion"), three_way=True)
    named = parsed.select("vote_id", rating.alias("rating"), agree.alias("agree"), F.col("f.confidence").alias("confidence"))
    return named.select("vote_id", "rating", p.rating_score(F.col("rating")).alias("score"), p.yes_no(F.col("agree")).alias("agree"), p.yes_no(F.col("agree"), "compat").alias("agree_compat"), p.score_100(F.col("confidence")).alias("confidence"))


@query("SELECT vote_id, coalesce(nullif(trim(json_extract_string(raw_completion, '$.text')), ''), nullif(trim(json_extract_string(raw_completion, '$.helpfulnessLevel')), ''), json_extract_string(raw_completion, '$.props.k')) AS found FROM replies")
def json_find(spark, d):
    paths = ["$.text", "$.helpfulnessLevel", "$.props.k"]
    first = F.coalesce(*[F.when(F.trim(F.get_json_object("raw_completion", x)) != "", F.trim(F.get_json_object("raw_completion", x))) for x in paths])
    return v.replies(spark, d).select("vote_id", first.alias("found"))


@query("""WITH k AS (SELECT vote_id, raw_completion, unnest(json_keys(raw_completion)) AS top, unnest(range(len(json_keys(raw_completion)))) AS i FROM replies),
p AS (SELECT vote_id, i, list_prepend(top, list_transform(coalesce(json_keys(json_extract(raw_completion, '$.' || top)), []), lambda x: top || '.' || x)) AS names FROM k)
SELECT vote_id, array_to_string(flatten(list(names ORDER BY i)), ',') AS paths FROM p GROUP BY vote_id""")
def json_key_paths(spark, d):
    return v.replies(spark, d).select("vote_id", F.array_join(ops.json_paths(F.col("raw_completion")), ",").alias("paths"))


@query("SELECT vote_id, coalesce(nullif(trim(json_extract_string(raw_completion, '$.helpfulnessLevel')), ''), json_extract_string(raw_completion, '$.props.k')) AS found FROM replies")
def json_deep_search(spark, d):
    return v.replies(spark, d).select("vote_id", ops.json_search(F.col("raw_completion"), ["text", "helpfulnessLevel", "k"]).alias("found"))


_H, _N = v.HELPFUL, v.NOT_HELPFUL
# a vote stands on a side by its rating or by its own flag, so it can stand on both
_HS, _NS = "(raw_label_id >= 1 OR ord1 % 9 = 0)", "(raw_label_id = 0 OR ord2 % 8 = 0)"
_SUMS = ", ".join([f"CAST(sum(CASE WHEN {_HS} THEN greatest({r}, 0) ELSE 0 END) AS BIGINT) AS {r}" for r in _H] + [f"CAST(sum(CASE WHEN {_NS} THEN greatest({r}, 0) ELSE 0 END) AS BIGINT) AS {r}" for r in _N])
_REASONS = f"counts AS (SELECT note_id, count(CASE WHEN {_HS} THEN 1 END) AS helpful_side_votes, count(CASE WHEN {_NS} THEN 1 END) AS not_helpful_side_votes, {_SUMS} FROM votes GROUP BY note_id)"
_LONG = " UNION ALL ".join(f"SELECT note_id, '{r}' AS reason, {r} AS n FROM counts" for r in (*_H, *_N))
_CHOSEN = f"""pairs AS ({_LONG}), ranked AS (SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY n DESC, reason) AS k FROM pairs WHERE n > 0),
chosen AS (SELECT note_id, string_agg(reason, ';' ORDER BY k) FILTER (WHERE k <= 3 AND n >= 2) AS good, min(reason) FILTER (WHERE k = 1) AS top FROM ranked GROUP BY note_id)"""


def reasons(spark, d):
    votes = vote_ops.with_cleaned(v.votes(spark, d), [*_H, *_N])
    return vote_ops.reason_sums(votes, _H, _N, helpful_flag=F.col("ord1") % 9 == 0, not_helpful_flag=F.col("ord2") % 8 == 0)


@query(f"WITH {_REASONS} SELECT * FROM counts")
def reason_counts(spark, d):
    return reasons(spark, d)


@query(f"WITH {_REASONS}, {_CHOSEN} SELECT n.note_id, coalesce(c.good, c.top, '') AS reason_labels FROM notes n LEFT JOIN chosen c ON n.note_id = c.note_id")
def reason_labels(spark, d):
    labels = vote_ops.ranked_reasons(reasons(spark, d), [*_H, *_N])
    joined = rel.one_to_one(v.notes(spark, d).select("note_id"), labels, ["note_id"], "left")
    return joined.select("note_id", F.coalesce(F.array_join("reasons", ";"), F.lit("")).alias("reason_labels"))


@query(f"WITH {_REASONS}, {_CHOSEN}, kept AS (SELECT note_id, unnest(string_split(coalesce(good, top), ';')) AS reason FROM chosen) SELECT reason, count(*) AS n_notes, round(count(*) / (SELECT count(*) FROM counts), 6) AS share FROM kept GROUP BY reason")
def reason_prevalence(spark, d):
    labelled = vote_ops.ranked_reasons(reasons(spark, d), [*_H, *_N])
    total = labelled.agg(F.count(F.lit(1)).alias("total"))
    counted = labelled.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n_notes"))
    return counted.crossJoin(F.broadcast(total)).select("reason", "n_notes", c.r6(F.col("n_notes") / F.col("total")).alias("share"))


@query(f"""WITH {_REASONS}, {_CHOSEN} SELECT n.current_status, count(*) AS notes, count(c.note_id) AS with_reason, round(avg(coalesce(len(string_split(coalesce(c.good, c.top), ';')), 0)), 6) AS mean_reasons
FROM notes n LEFT JOIN chosen c ON n.note_id = c.note_id GROUP BY n.current_status""")
def reason_coverage(spark, d):
    labelled = vote_ops.ranked_reasons(reasons(spark, d), [*_H, *_N]).select("note_id", F.size("reasons").alias("k"))
    joined = v.notes(spark, d).join(labelled, "note_id", "left").withColumn("k", F.coalesce("k", F.lit(0)))
    return joined.groupBy("current_status").agg(F.count(F.lit(1)).alias("notes"), F.count_if(F.col("k") > 0).alias("with_reason"), c.r6(F.avg("k")).alias("mean_reasons"))


_TT = " UNION ALL ".join(f"SELECT agent_id, '{r}' AS name, avg(greatest({r}, 0)) AS x FROM votes GROUP BY agent_id" for r in (*_H, *_N))


@query(f"WITH long AS ({_TT}), k AS (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY x DESC, name) AS r FROM long WHERE x > 0) SELECT agent_id, string_agg(concat(name, '=', format('{{:.4f}}', x)), ';' ORDER BY r) AS terms FROM k WHERE r <= 3 GROUP BY agent_id")
def top_terms(spark, d):
    rates = vote_ops.with_cleaned(v.votes(spark, d), [*_H, *_N]).groupBy("agent_id").agg(*[F.avg(r).alias(r) for r in (*_H, *_N)])
    return rates.select("agent_id", ops.top_terms([*_H, *_N], 3).alias("terms"))


@query("""SELECT count(*) AS notes, 16 * count(*) AS calls, round(avg(length(text)), 4) AS mean_chars, round((1200 + avg(length(text))) / 4 * 16 * count(*), 2) AS input_tokens,
  round((1200 + avg(length(text))) / 4 * 16 * count(*) * 0.15 / 1e6, 6) AS input_cost FROM documents""", views=False)
def cost_estimate(spark, d):
    n, mean = F.count(F.lit(1)), F.avg(F.length("text"))
    tokens = (1200 + mean) / 4 * 16 * n
    return table(spark, d, "documents").agg(n.alias("notes"), (16 * n).alias("calls"), F.round(mean, 4).alias("mean_chars"), F.round(tokens, 2).alias("input_tokens"), F.round(tokens * 0.15 / 1e6, 6).alias("input_cost"))


def _tfidf_sql(terms: str, features: int) -> str:
    return f"""words AS (SELECT conv_id, turn, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM conversations), grams AS (SELECT conv_id, unnest({terms}) AS term FROM words),
tf AS (SELECT conv_id, term, count(*) AS tf FROM grams GROUP BY 1, 2), n AS (SELECT count(DISTINCT conv_id) AS n FROM conversations), df AS (SELECT term, count(*) AS df FROM tf, n GROUP BY term, n HAVING count(*) >= 2 AND count(*) <= 0.98 * n ORDER BY sum(tf) DESC, term LIMIT {features}),
w AS (SELECT conv_id, term, (1 + ln(tf)) * (ln((1.0 + n) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term), n),
x AS (SELECT conv_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY conv_id)) AS weight FROM w), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY round(weight, 9) DESC, term) AS rank FROM x)
SELECT conv_id, term, round(weight, 6) AS weight, CAST(rank AS INT) AS rank FROM r WHERE rank <= 10"""


_BIGRAMS = "list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))"
_CHARS = "flatten(list_transform(w, lambda x: flatten(list_transform([3, 4, 5], lambda k: list_transform(range(1, greatest(length(x) + 4 - k, 1)), lambda i: substr(' ' || x || ' ', i, k))))))"
FEATURES = 2000


@query(f"WITH {_tfidf_sql(_BIGRAMS, FEATURES)}", views=False)
def tfidf_terms(spark, d):
    words = F.split(F.lower("text"), "[^a-z0-9]+")
    return ops.tfidf(table(spark, d, "conversations"), "conv_id", ops.word_grams(words), top=10, features=FEATURES).select("conv_id", "term", c.r6(F.col("weight")).alias("weight"), "rank")


@query(f"WITH {_tfidf_sql(_CHARS, FEATURES)}", views=False)
def tfidf_chars(spark, d):
    words = F.split(F.lower("text"), "[^a-z0-9]+")
    return ops.tfidf(table(spark, d, "conversations"), "conv_id", ops.char_grams(words), top=10, features=FEATURES).select("conv_id", "term", c.r6(F.col("weight")).alias("weight"), "rank")


TEXT_FEATURES = 3000


@query()
def text_model(spark, d):
    """The class of each labelled text (poor, toxic, good) by word 1-2 and character 3-5 grams, from models that left its fold out."""
    label = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    docs = v.texts(spark, d).where(F.col("quality").isNotNull()).select("doc_id", "text", label.alias("label"))
    # folds are dealt on narrow rows, one for an id; the texts are stored once for the scans that count their terms
    dealt = sampling.folds(docs.select("doc_id", "label"), "label", "doc_id", 5, 13).groupBy("doc_id").agg(F.min("fold").alias("fold"))
    docs = rel.stable(docs.join(dealt, "doc_id").repartition("doc_id"))
    words = F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}_]+")
    blocks = {"word": ops.word_grams(F.filter(words, lambda w: F.length(w) > 1)), "char": words}
    out = textmodels.text_model(docs, "doc_id", "label", "fold", blocks, TEXT_FEATURES, inside={"char": (3, 4, 5)})
    return out.select(F.col("key").alias("doc_id"), F.col("fold").alias("outer_fold"), "terms", *[c.r6(F.col(p)).alias(p) for p in ("p_nh", "p_nmr", "p_h")], "pred")
