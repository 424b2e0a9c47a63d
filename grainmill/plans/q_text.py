"""Queries of tokens, n-grams, term weights and their flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import scratch
from ..functions import python_udfs
from ..operators import text
from .base import query, rounded

STOP = ["the", "of", "and", "to", "in"]
_TOK = "regexp_extract_all(text, '([A-Za-z]{2,}[0-9]{0,1})', 1)"
_LOW = f"list_transform({_TOK}, lambda x: lower(x))"
_KEPT = f"list_filter({_LOW}, lambda x: x NOT IN ('the', 'of', 'and', 'to', 'in'))"
_COUNTS = f"(SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest({_LOW}) AS term FROM documents) GROUP BY ALL)"
_BIGRAMS = "list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])"
_LANG = f"(SELECT lang, term, sum(n)::BIGINT AS n FROM (SELECT lang, unnest({_LOW}) AS term, 1 AS n FROM documents) GROUP BY ALL)"


def _counts(t):
    return text.term_counts(t.documents, ["doc_id"], "text")


def _by_lang(t):
    return text.term_counts(t.documents, ["lang"], "text")


@query("tokenize", f"SELECT doc_id, len({_TOK})::BIGINT AS n, md5(array_to_string({_TOK}, ' ')) AS h FROM documents")
def _(t):
    a = text.tokens(F.col("text"), lower=False)
    return t.documents.select("doc_id", a.alias("a")).select("doc_id", F.size("a").cast("long").alias("n"), F.md5(F.array_join("a", " ").cast("binary")).alias("h"))


@query("tokens_no_stop", f"SELECT doc_id, len({_KEPT})::BIGINT AS n FROM documents")
def _(t):
    return t.documents.select("doc_id", F.size(text.tokens(F.col("text"), stop_words=STOP)).cast("long").alias("n"))


@query("doc_tokens", f"SELECT conv_id, turn, i - 1 AS pos, ws[i] AS token FROM (SELECT conv_id, turn, {_LOW} AS ws FROM conversations), unnest(range(1, len(ws) + 1)) AS u(i)")
def _(t):
    return text.exploded(t.conversations, ["conv_id", "turn"], text.tokens(F.col("text"))).withColumn("pos", F.col("pos").cast("long"))


@query("cluster_tokens", f"SELECT role, token, count(*) AS n FROM (SELECT role, unnest({_LOW}) AS token FROM conversations) GROUP BY ALL")
def _(t):
    return text.exploded(t.conversations, ["role"], text.tokens(F.col("text"))).groupBy("role", "token").agg(F.count("*").alias("n"))


@query("bow", r"SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '\w\w+')) AS term FROM conversations) GROUP BY term")
def _(t):
    low = t.conversations.select(F.regexp_extract_all(F.lower("text"), F.lit(r"([0-9A-Za-z_][0-9A-Za-z_]+)"), 1).alias("a"))
    return low.select(F.explode("a").alias("term")).groupBy("term").agg(F.count("*").alias("n"))


@query("doc_term_counts", f"SELECT * FROM {_COUNTS}")
def _(t):
    return _counts(t)


@query("ngrams_2", f"SELECT conv_id, turn, term, count(*) AS n FROM (SELECT conv_id, turn, unnest({_BIGRAMS}) AS term FROM (SELECT conv_id, turn, {_KEPT} AS ws FROM conversations)) GROUP BY ALL")
def _(t):
    return text.term_counts(t.conversations, ["conv_id", "turn"], "text", (2,), stop_words=STOP)


@query("ngrams_min_df", f"SELECT term, count(DISTINCT doc_id) AS df, sum(n)::BIGINT AS total FROM {_COUNTS} GROUP BY term HAVING count(DISTINCT doc_id) >= 5")
def _(t):
    return text.vocabulary(_counts(t), "doc_id", min_df=5, max_df=10**12)


@query("ngrams_max_features", f"SELECT term, count(DISTINCT doc_id) AS df, sum(n)::BIGINT AS total FROM {_COUNTS} GROUP BY term HAVING count(DISTINCT doc_id) <= 0.5 * (SELECT count(DISTINCT doc_id) FROM {_COUNTS}) ORDER BY total DESC, term LIMIT 50")
def _(t):
    return text.vocabulary(_counts(t), "doc_id", 1, 0.5, max_features=50)


@query("ngram_row_freq", f"SELECT lang, term, round(n / sum(n) OVER (PARTITION BY lang), 9) AS freq FROM {_LANG}")
def _(t):
    return rounded(text.row_frequency(_by_lang(t), ["lang"]).select("lang", "term", "freq"), "freq", digits=9)


@query("tfidf", f"WITH c AS {_COUNTS}, d AS (SELECT count(DISTINCT doc_id) AS d FROM c), f AS (SELECT term, count(*) AS f FROM c GROUP BY term), w AS (SELECT doc_id, term, n * (ln((1 + d) / (1 + f)) + 1) AS w FROM c JOIN f USING (term), d) SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS tfidf FROM w")
def _(t):
    return rounded(text.tfidf(scratch.written(_counts(t), "counts"), "doc_id"), "tfidf")  # read three times: the texts once


@query("topk_terms", f"SELECT lang, term, n FROM {_LANG} QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, term) <= 20")
def _(t):
    return text.top_terms(_by_lang(t), ["lang"], 20).select("lang", "term", "n")


@query("cluster_ngrams", f"SELECT lang, upper(term[1]) || term[2:] AS term, n, place::INT AS place, round(n / sum(n) OVER (PARTITION BY lang), 9) AS share FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, term) AS place FROM {_LANG}) WHERE place <= 15")
def _(t):
    return rounded(text.group_terms(_by_lang(t), ["lang"], 15), "share", digits=9)


@query("cluster_text_ngrams", f"SELECT lang, doc_id, term, n FROM (SELECT lang, doc_id, term, count(*) AS n FROM (SELECT lang, doc_id, unnest({_LOW}) AS term FROM documents) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY lang, doc_id ORDER BY n DESC, term) <= 5")
def _(t):
    counts = text.term_counts(t.documents, ["lang", "doc_id"], "text")
    return text.top_terms(counts, ["lang", "doc_id"], 5).select("lang", "doc_id", "term", "n")


_TURNS = f"(SELECT least(turn, 3)::BIGINT AS period, unnest({_LOW}) AS term FROM conversations)"
_TOPS = f"(SELECT period, term, n, row_number() OVER (PARTITION BY period ORDER BY n DESC, term) AS place FROM (SELECT period, term, count(*) AS n FROM {_TURNS} GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY period ORDER BY n DESC, term) <= 25)"


def _period_counts(t):
    return text.term_counts(t.conversations.withColumn("period", F.least(F.col("turn"), F.lit(3)).cast("long")), ["period"], "text")


def _tops(t):
    return text.top_terms(_period_counts(t), ["period"], 25)


@query("term_share_by_period", f"SELECT period, term, round(n / sum(n) OVER (PARTITION BY period), 9) AS share FROM (SELECT period, term, count(*) AS n FROM {_TURNS} GROUP BY ALL)")
def _(t):
    return rounded(text.row_frequency(_period_counts(t), ["period"]).select("period", "term", F.col("freq").alias("share")), "share", digits=9)


@query("term_transitions", f"SELECT coalesce(a.period, b.period - 1) AS period, coalesce(a.term, '') AS term_from, coalesce(b.term, '') AS term_to FROM (SELECT * FROM {_TOPS} WHERE period < 3) a FULL JOIN (SELECT * FROM {_TOPS} WHERE period > 0) b ON a.period = b.period - 1 AND a.term = b.term")
def _(t):
    return text.transitions(_tops(t), "period", 3)


@query("anti_join_new_terms", f"SELECT period, term FROM {_TOPS} a WHERE period > 0 AND NOT EXISTS (SELECT 1 FROM {_TOPS} b WHERE b.period = a.period - 1 AND b.term = a.term)")
def _(t):
    return text.new_terms(_tops(t), "period")


@query("sankey_positions", f"SELECT period, term, round(least(0.999, greatest(0.001, place / max(place) OVER (PARTITION BY period))), 6) AS y FROM {_TOPS}")
def _(t):
    return rounded(text.positions(_tops(t), ["period"]).select("period", "term", "y"), "y")


@query("cluster_term_flows", f"SELECT lang, term, round(100 * n / sum(n) OVER (PARTITION BY lang), 6) AS value FROM {_LANG} QUALIFY term IN (SELECT term FROM (SELECT term, sum(n) AS s FROM {_LANG} GROUP BY term ORDER BY s DESC, term LIMIT 20))")
def _(t):
    counts = _by_lang(t)
    best = counts.groupBy("term").agg(F.sum("n").alias("s")).orderBy(F.col("s").desc(), "term").limit(20)
    flow = text.row_frequency(counts, ["lang"]).join(F.broadcast(best.select("term")), "term", "left_semi")
    return rounded(flow.select("lang", "term", (100 * F.col("freq")).alias("value")), "value")


@query("pattern_mentions", r"SELECT doc_id, i - 1 AS pos, ms[i] AS match FROM (SELECT doc_id, regexp_extract_all(text, '([A-Z]{3,})', 1) AS ms FROM documents), unnest(range(1, len(ms) + 1)) AS u(i)")
def _(t):
    return text.mentions(t.documents, ["doc_id"], "text", "([A-Z]{3,})").withColumn("pos", F.col("pos").cast("long"))


@query("tok_whitespace", r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> ''))::BIGINT AS n FROM documents")
def _(t):
    return t.documents.select("doc_id", F.size(text.white_space(F.col("text"))).cast("long").alias("n"))


@query("tok_wordpunct", r"SELECT conv_id, turn, len(regexp_extract_all(text, '[0-9A-Za-z_]+|[^0-9A-Za-z_ \t\n\x0B\f\r]+'))::BIGINT AS n FROM conversations")
def _(t):
    return t.conversations.select("conv_id", "turn", F.size(text.word_and_punctuation(F.col("text"))).cast("long").alias("n"))


@query("tok_blankline", r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]*\n[ \t\n\x0B\f\r]*\n[ \t\n\x0B\f\r]*'), lambda x: x <> ''))::BIGINT AS n FROM documents")
def _(t):
    return t.documents.select("doc_id", F.size(text.paragraphs(F.col("text"))).cast("long").alias("n"))


@query("sentence_count", r"SELECT doc_id, len(list_filter(string_split(regexp_replace(trim(text, ' '), '([.!?])[ \t\n\x0B\f\r]+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> ''))::BIGINT AS n FROM documents")
def _(t):
    return t.documents.select("doc_id", F.size(text.sentences(F.col("text"))).cast("long").alias("n"))


@query("vocabulary", f"SELECT DISTINCT unnest({_LOW}) AS term FROM documents")
def _(t):
    return t.documents.select(F.explode(text.tokens(F.col("text"))).alias("term")).distinct()


@query("porter_stem")
def _(t):
    words = t.conversations.select(F.explode(text.tokens(F.col("text"))).alias("term")).distinct()
    return words.select("term", python_udfs.porter_stem(F.col("term")).alias("stem"))


@query("entity_replace", """SELECT conv_id, turn, trim(replace(replace(replace(' ' || array_to_string(list_transform(regexp_extract_all(coalesce(text, ''), '([A-Za-z]{2,}[0-9]{0,1})', 1), lambda x: lower(x)), '  ') || ' ',
  ' of  the ', ' of_the '), ' in ', ' IN '), '  ', ' ')) AS text FROM conversations""")
def _(t):
    a = python_udfs.entities(text.tokens(F.col("text")), {"of the": "of_the", "in": "IN"})
    return t.conversations.select("conv_id", "turn", F.array_join(a, " ").alias("text"))


def _folds(t):
    rows = t.documents.select("doc_id", "text").join(t.labels, "doc_id")
    return rows.where("doc_id % 3 <> 0"), rows.where("doc_id % 3 = 0")


@query("nb_classify", f"""WITH l AS (SELECT doc_id, {_LOW} AS ws, quality FROM documents JOIN labels USING (doc_id)),
  c AS (SELECT w, count(*) FILTER (quality = 1) AS a, count(*) FILTER (quality = 0) AS b FROM (SELECT quality, unnest(ws) AS w FROM l WHERE doc_id % 3 <> 0) GROUP BY w),
  s AS (SELECT w, ln((a + 1) / (sa + v)) - ln((b + 1) / (sb + v)) AS s FROM c, (SELECT sum(a) AS sa, sum(b) AS sb, count(*) AS v FROM c)),
  o AS (SELECT doc_id, sum(s) AS o FROM (SELECT doc_id, unnest(ws) AS w FROM l WHERE doc_id % 3 = 0) JOIN s USING (w) GROUP BY doc_id),
  p AS (SELECT doc_id, coalesce(o, 0) + (SELECT ln(count(*) FILTER (quality = 1) / count(*) FILTER (quality = 0)) FROM l WHERE doc_id % 3 <> 0) AS m FROM l LEFT JOIN o USING (doc_id) WHERE doc_id % 3 = 0)
  SELECT doc_id, (m > 0)::INT AS predicted, round(1 / (1 + exp(-least(greatest(m, -500), 500))), 6) AS score FROM p""")
def _(t):
    from ..operators import classify

    learn, rest = _folds(t)
    return rounded(classify.naive_bayes(learn, rest, "doc_id", "text", "quality"), "score")


@query("tree_classify")
def _(t):
    from ..operators import classify

    return rounded(classify.classify(*_folds(t), "doc_id", "text", "quality", "tree"), "score")


@query("maxent_classify")
def _(t):
    from ..operators import classify

    return rounded(classify.classify(*_folds(t), "doc_id", "text", "quality", "maxent"), "score", digits=4)
